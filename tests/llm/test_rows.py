"""Language identification, page text, archives, mixing and sharding on hard rows."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressweave.llm import html_main, langid, mixing, sharding, warc
from pressweave.llm import queries as q
from pressweave.sources.tables import shared_dir


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = q.op1_language_id(spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 250 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_hard_rows(nasty, no_docs):
    model = langid.train(nasty)
    assert model.languages == ["en", "fr"]
    rows = langid.identify(nasty, model).collect()
    assert len(rows) == nasty.count() and set(rows[0].asDict()) == {*nasty.columns, "lang_pred", "ambiguous", "runner_up"}
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    by_text = {r.text: r.lang_pred for r in rows}
    assert by_text["le chat est sur la table et il regarde"] == "fr"
    assert langid.identify(nasty, langid.train(no_docs)).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(no_docs, model).count() == 0
    one = langid.train(nasty.filter("lang = 'fr'"))
    assert langid.identify(nasty, one).filter("lang_pred NOT IN ('fr', 'und')").count() == 0


@pytest.mark.parametrize("n", [2, 4, 5, 9, 30])
def test_codewords_differ_and_every_bit_splits(n):
    codes = langid.codewords(n)
    assert len({tuple(c) for c in codes}) == n
    assert (np.abs(codes.sum(axis=0)) < n).all()
    if n == 4:
        assert min((codes[i] != codes[j]).sum() for i in range(4) for j in range(i)) == 4


def test_ambiguity_is_flagged(spark):
    a, b = "aba bab aab " * 200, "cdc dcd ccd " * 200
    model = langid.train(spark.createDataFrame([(1, a, "x"), (2, b, "y")], "doc_id long, text string, lang string"))
    assert not model.decide(a)[2] and model.decide(a)[0] == "x"
    assert model.decide("aba cdc bab dcd aab ccd " * 50)[2]


PAGES = [
    ("<nav><a href=/>x</a></nav><article><h1>Head</h1><p>First, one.<br>More<p>Second &amp; last</article><footer>f</footer>",
     "Head\nFirst, one. More\nSecond & last"),
    ("<body><div id=menu><ul><li><a>Home</a><li><a>News</a></ul></div><div class=content><p>Long text, with commas, here.</p>"
     "<ul><li>point one</li><li>point two</li></ul><div class='comments'><p>A reader says, hello, nice.</p></div></div>"
     "<div class=sidebar><p>Other things, to read, too.</p></div></body>", "Long text, with commas, here.\npoint one\npoint two"),
    ("<div><div class=part><p>Part one, of the text, is this.</p></div><div class=part><p>Part two, of the text, is that.</p></div></div>"
     "<div class='cookie-notice'>We use cookies, and more, really.</div><form><p>Sign in, please, now.</p></form>",
     "Part one, of the text, is this.\nPart two, of the text, is that."),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><p>Only</p><!-- <p>gone</p> -->", "Only"),
    ("plain words &lt;here&gt;", "plain words <here>"), ("", ""), (None, ""), ("<nav>menu</nav>", ""),
    ("<article><p>" + "deep " * 3 + "<div>" * 3000 + "x" + "</div>" * 3000 + "</article>", "deep deep deep\nx"),
    ("<article><header><h1>Title</h1></header><p>Text, in it, goes on.</p><ul><li><a>r1</a></li><li><a>r2</a></li><li><a>r3</a></li></ul>"
     "</article>", "Title\nText, in it, goes on."),
    ("<table><tr><td>a, cell, one<td>two</table>", "a, cell, one\ntwo"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert html_main.main_text(html) == text


def test_main_text_column(spark):
    df = spark.createDataFrame([(i, h, "old") for i, (h, _) in enumerate(PAGES)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_main.extract_main(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html_main.extract_main(df.limit(0)).count() == 0


PARAGRAPHS = [f"Paragraph {i} of the text, which is long, goes on, and on, " + "with more words in it " * 9 + "to its end." for i in range(12)]
BODY, LINES = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), "\n".join(PARAGRAPHS)
LONG_PAGES = [
    (f"<article><h1>Head</h1><div class=entry-content>{BODY}</div></article>", f"Head\n{LINES}"),
    (f"<article><header><h1>Head</h1></header><p>Short lead.</p><div>{BODY}</div><figure><img><figcaption>Caption</figcaption></figure>"
     "<ul><li>one</li><li>two</li></ul></article><div class=related><p>Other, text.</p></div>", f"Head\nShort lead.\n{LINES}\nCaption\none\ntwo"),
    (f"<article><section>{BODY}</section><section><p>One short paragraph.</p></section></article>", f"{LINES}\nOne short paragraph."),
    (f"<main><h1>Head</h1><div><div>{BODY}</div></div><div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul></div></main>", f"Head\n{LINES}"),
    (f"<div><h1>Head</h1><p>Short lead.</p><div class=content>{BODY}</div><p>Last.</p><ul><li>one</li></ul><div><a href=/>more of this</a></div></div>",
     f"Head\nShort lead.\n{LINES}\nLast.\none"),
]


@pytest.mark.parametrize("html,text", LONG_PAGES)
def test_main_text_of_long_articles_is_whole(html, text):
    assert html_main.main_text(html) == text


ARTICLE, READ = f"<article><h1>Head</h1>{BODY}</article>", f"Head\n{LINES}"
SIDE = "<div class=sidebar><p>Other things, to read, too, and more.</p></div>"
COMMENTS = "<div id=comments>" + f"<div class=comment><div class=text>{BODY}</div></div>" * 3 + "</div>"
WRAPPED_PAGES = [
    (f"<div class='page has-sidebar'>{SIDE}<div class=text>{BODY}</div></div>", LINES),
    (f"<div class='page sidebar'>{SIDE}<h1>Head</h1>{BODY}</div><div class=footer><p>Some words, at the foot, of it.</p></div>", READ),
    (f"<div class='content with-ads'>{BODY}<div class=ads><p>Buy this, and that, and more.</p></div></div>", LINES),
    (f"<article class='post no-comments'><h1>Head</h1>{BODY}</article>{SIDE}", READ),
    (f"<article class='post comments-closed'><h1>Head</h1>{BODY}<div class=comments><p>A reader says, hello, nice text.</p></div></article>", READ),
    (f"<form id=aspnetForm action=/><div class=menu><a>x</a></div>{ARTICLE}<input name=q><button>Go</button></form>", READ),
    (f"<form><fieldset>{BODY}</fieldset></form>", LINES),
    (f"<div class='layout sidebar'><form><div class='page ads'>{ARTICLE}{SIDE}</div></form></div><p>A plain line, on the page, of some length.</p>", READ),
    (f"<div class='page overlay'><main><p>A short text, of one line, in all.</p></main></div><div class=cookies>{BODY}</div>", "A short text, of one line, in all."),
    (f"<div class='page sidebar'><article><p>A short text, of one line, in all.</p></article></div><div class=cookies>{BODY}</div>",
     "A short text, of one line, in all."),
    (f"<div class=content><p>A short text, of one line, in all.</p></div><div class=sidebar>{BODY}</div>{COMMENTS}", "A short text, of one line, in all."),
    (f"<div><p>A short text, of one line, in all.</p></div>{COMMENTS}", "A short text, of one line, in all."),
    (f"<div id=wrap>{BODY}</div><div class=related><article><p>A short text, of one line, in all.</p></article></div>", LINES),
    (f"<div class='page sidebar'><article><p>A short text, of one line, in all.</p></article><div class=cookies>{BODY}</div></div>",
     "A short text, of one line, in all."),
    (f"<article><h1>A headline of more than a few words</h1><form>{BODY}</form></article>", f"A headline of more than a few words\n{LINES}"),
    ("<div class=ad>Buy this thing, and that, and more of it.</div><article><h1>Head</h1><p>Short.</p></article>", "Head\nShort."),
    ("<div class='page sidebar'><article><h1>Head</h1><p>Short.</p></article></div>", "Head\nShort."),
    (f"<div class=content><p>A short text, of one line, in all.</p></div><div class=sidebar><div class=text>{BODY}</div></div>",
     "A short text, of one line, in all."),
    ("<form><label>Name</label><input></form>", ""),
    (f"<div><div>Sign up for our letter, it is free, and good.</div>{ARTICLE}<div>Some rights, of some kind, are kept.</div></div>", READ),
    (f"<div><h1>Above it</h1><article>{BODY}</article><article><h2>Another story</h2><p>A teaser, of one line, for it.</p></article></div>", f"Above it\n{LINES}"),
    (f"<main><article>{BODY}</article></main><div class=related-story><p>Other, text, of a story.</p></div>", LINES),
    (f"<article><div class=header><h1>Head</h1></div>{BODY}<div class=story-tags><p>one, two, three</p></div><p class=share>Share this, with all, now.</p></article>", READ),
    (f"<article><div class=article-header><h1>Head</h1></div>{BODY}<div class='reader-feedback'><p>I liked it, a lot, really.</p></div></article>", READ),
    (f"<div class='main-menu'><p>Home, news, and sport.</p></div><div class=story>{BODY}</div>", LINES),
]


@pytest.mark.parametrize("html,text", WRAPPED_PAGES)
def test_main_text_under_marked_wrappers(html, text):
    assert html_main.main_text(html) == text


NOISE = [
    "<nav><ul><li><a href=/>Home, sweet</a><li><a href=/n>News, all</a></ul></nav>", "<script>var p = '<p>Not, a, text</p>'</script>", "<style>p, q {}</style>",
    "<aside><p>Read this, and that, as well.</p></aside>", "<div class='ad-box'><p>Buy it, now, for less, today.</p></div>", "<!-- <p>gone, long, ago</p> -->",
    "<div id=cookie-notice><p>We use cookies, and more, really.</p><button>OK</button></div>", "<form><label>Mail, please</label><input><button>Go</button></form>",
    "<div class=newsletter><p>Our letter, every week, for free.</p></div>", "<div class='related-story'><p>Another, older, story.</p></div>",
    "<div class=comments><div class=comment><p>A reader says, hello, nice, and so on.</p></div></div>", "<div role=navigation><a>more</a> of it, here</div>",
]
INLINE = ["plain {}", "<b>{}</b> bold", "<a href=/x>{}</a> linked, as words go, in a longer line of text", "{}&nbsp;&amp; <i>more</i>", "{}<br>below"]


@pytest.mark.parametrize("seed", range(40))
def test_main_text_of_pages_put_together(seed):
    """An article of known blocks among everything that is not the article: its blocks come back, in order, and nothing else."""
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(300)]
    blocks, shown = ["<h1>The headline of it</h1>"], ["The headline of it"]
    for i in range(int(rng.integers(3, 9))):
        said = ", ".join(" ".join(rng.choice(words, 6)) for _ in range(int(rng.integers(3, 8)))) + "."
        form = INLINE[int(rng.integers(len(INLINE)))].format(said)
        tag = ["p", "blockquote", "h2", "pre"][min(3, int(rng.exponential(0.7)))]
        blocks.append(f"<{tag}>{form}</{tag}>")
        shown.append(" ".join(re.sub(r"<[^>]*>", "", form.replace("<br>", " ").replace("&nbsp;", "\u00a0").replace("&amp;", "&")).split()))

    def some(n):
        return "".join(NOISE[int(i)] for i in rng.integers(0, len(NOISE), n))

    inside = "".join(block + (some(1) if rng.random() < 0.3 else "") for block in blocks)
    article = [f"<article>{inside}</article>", f"<main><div class=entry-content>{inside}</div></main>", f"<div class='post body'>{inside}</div>"][seed % 3]
    page = f"<html><head><title>No</title></head><body><header><p>The site, its name, and more.</p></header>{some(2)}<div id=wrap>{article}</div>{some(3)}<footer>(c), all, rights</footer></body></html>"
    assert html_main.main_text(page) == "\n".join(shown)


def plain_grams(text):
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    text = f" {' '.join(text.split())} " + " " * text.endswith(" ")  # a run that ends the text counts beside the end
    return [text[i:i + n] for n in langid.ORDERS for i in range(len(text) - n + 1)] if text.strip() else []


def plain_bucket(gram):
    h = 0
    for c in gram:
        h = (h + ord(c) + len(gram)) * 0x9E3779B97F4A7C15 % 2 ** 64
    return (h >> 40) % langid.BUCKETS


def test_language_decisions_equal_a_plain_computation(spark):
    """Counts, codewords, bit classifiers and loss-weighted decoding once more, with dictionaries and loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, rows = langid.train(docs.filter(~langid.held_out())), docs.collect()
    counts = {}
    for r in docs.filter(~langid.held_out()).collect():
        counts.setdefault(r.lang, Counter()).update(plain_bucket(g) for g in plain_grams(r.text))
    names = sorted(counts)
    assert model.languages == names
    share = {n: (lambda b, total=sum(counts[n].values()) + langid.SMOOTHING * langid.BUCKETS, c=counts[n]: (c[b] + langid.SMOOTHING) / total) for n in names}
    bits = model.codes.shape[1]

    def odds(bucket, bit):
        ones, zeros = ([n for n, code in zip(names, model.codes) if (code[bit] > 0) == side] for side in (True, False))
        return np.log(np.mean([share[n](bucket) for n in ones]) / np.mean([share[n](bucket) for n in zeros]))

    known = {}
    for r in rows[::7]:
        found = [plain_bucket(g) for g in plain_grams(r.text or "")]
        if not found:
            assert model.decide(r.text)[0] == "und"
            continue
        margins = []
        for bit in range(bits):
            total = sum(known.setdefault((b, bit), odds(b, bit)) for b in found)
            margins.append(total / len(found) * model.scale[bit])
        losses = [sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(model.trust, code, margins)) for code in model.codes]
        best = int(np.argmin(losses))
        name, score, ambiguous, second = model.decide(r.text)
        assert name == names[best] and score == pytest.approx(1 / sum(np.exp(losses[best] - x) for x in losses), abs=1e-4)
        assert second == names[int(np.argsort(losses)[1])] and ambiguous == (sorted(losses)[1] - losses[best] < langid.AMBIGUOUS * model.trust.sum())


def test_archive_round_trip_of_hard_payloads(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (4, "u\r\nEvil: 1", None), (5, "", ""),
            (6, "h", "short"), (7, "h", "short"), (8, "z", big), (9, "long", "y" * 300_000), (None, "n", big), (None, None, None)]
    df = spark.createDataFrame(rows, "key long, url string, payload string").withColumn("digest", F.lit("clash"))
    path = shared_dir(spark, "warc")
    warc.write_archive(df, path, records_per_file=5)
    records = warc.read_archive(spark, path)
    assert records.count() == 3 * len(rows) and warc.orphans(records).count() == 0
    got = {}
    for r in warc.assemble(records).withColumn("key", warc.capture_key(F.col("record_id"))).collect():
        got.setdefault(r.key, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for key, url, payload in rows:
        raw = (payload or "").encode()
        mine = [r for r in got[key] if r.response.payload_bytes == len(raw)]
        assert mine and all(r.response.payload_digest == hashlib.sha1(raw).hexdigest() for r in mine)
        if key is not None:
            r = mine[0]
            original = 8 if payload == big and key != 8 else None
            assert r.response.type == ("revisit" if original else "response")
            assert r.response.refers_to == (f"<urn:capture:{original}:response>" if original else None)
            assert r.response.payload == (None if original else raw)
            assert r.n_request == r.n_metadata == 1 and r.request.block.startswith("GET ")
    path = shared_dir(spark, "warc")
    warc.write_archive(df.limit(0), path)
    assert warc.assemble(warc.read_archive(spark, path)).count() == 0


def test_orphans_and_several_requests(spark):
    path = shared_dir(spark, "warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "p"), (2, "v", "q")], "key long, url string, payload string"), path)
    records = warc.read_archive(spark, path)
    more = records.unionByName(records.filter("type = 'request'").withColumn("record_id", F.lit("<z>")))
    assert sorted((r.n_request, r.request.record_id) for r in warc.assemble(more).collect()) == [
        (2, "<urn:capture:1:request>"), (2, "<urn:capture:2:request>")]
    left = records.filter("NOT (type = 'response' AND target_uri = 'u')")
    assert warc.orphans(left).count() == 2 and warc.assemble(left).count() == 1


def test_mixing_hard_rows(nasty, no_docs):
    rows = mixing.mix(nasty).collect()
    assert len(rows) == nasty.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mix(nasty).collect()))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert Counter(r.size for r in rows) == Counter(len(word.findall(r.text or "")) for r in nasty.collect())
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and None in target
    assert mixing.mix(no_docs).count() == 0
    mixed = mixing.mixed_documents(nasty)
    assert mixed.columns == nasty.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(word.findall(r.text))
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_water_filling_shares_excess_again(spark):
    rows = [("a", 10, 5), ("b", 1000, 2), ("c", 40, 1)]
    got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "source string, size long, weight int")).collect()}
    assert got == {"a": 20.0, "b": 1475.0, "c": 80.0}


def test_sharding(spark, nasty, no_docs):
    names = [f"s{i}" for i in range(7)]
    table = {r.slot: r.shard for r in sharding.lookup_table(spark, names, 101).collect()}
    assert sorted(table) == list(range(101)) and max(Counter(table.values()).values()) - min(Counter(table.values()).values()) <= 1
    fewer = {r.slot: r.shard for r in sharding.lookup_table(spark, names[:-1], 101).collect()}
    kept = [s for s in table if table[s] != "s6"]
    assert sum(table[s] == fewer[s] for s in kept) > 0.7 * len(kept)
    placed = sharding.place(nasty, F.col("doc_id"), names, 101)
    assert placed.count() == nasty.count() and placed.filter("shard IS NULL").count() == 0
    assert placed.filter("doc_id = 2").select("shard").distinct().count() == 1
    assert sharding.place(no_docs, F.col("doc_id"), names, 101).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(spark, bad, 101)
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 100)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan
