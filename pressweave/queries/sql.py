"""SQL snippets shared by the oracle queries."""
from pressweave import fixed_values as fv

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


DOCS = """docs AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS summary, lang AS language,
  source, n_chars FROM documents)"""

CRED = "coalesce((SELECT 3.0 + 2 * quality - toxic FROM labels l WHERE l.doc_id = d.doc_id), 3.0)"


def fold(x: str) -> str:
    return f"regexp_replace(strip_accents(replace(coalesce({x}, ''), '…', '...')), '[^\\x00-\\x7F]+', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({fold(x)}), '[^a-z0-9_]+', ' ', 'g'))"


def key_text(x: str) -> str:
    return (f"trim(regexp_replace(strip_accents(lower(trim(coalesce({x}, ''), {WS}))), '[^a-z0-9]+', '_', 'g'), '_')")


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def clean_value(x: str) -> str:
    t = strip(f"coalesce({x}, '')")
    return f"(CASE WHEN lower({t}) IN {lst(fv.EMPTY_WORDS)} THEN '' ELSE {t} END)"


def polish(x: str) -> str:
    t = collapse(clean_value(x))
    for pattern in fv.GLUED_PATTERNS:
        t = f"regexp_replace({t}, {q(pattern)}, '\\1 \\2', 'g')"
    return strip(t)


def shorten(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substr({x}, 1, {n - 1}), {WS}) || '…' END)"


def clean_text(x: str) -> str:
    t = collapse(f"regexp_replace(coalesce({x}, ''), '[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f]', '', 'g')")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, {q(a)}, {q(b)})"
    return strip(t)


def all_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({clean_text(x)}), '[a-z0-9\\x{{c0}}-\\x{{24f}}\\x{{600}}-\\x{{6ff}}]{{3,}}')"


def tokens(x: str, stop=fv.STOP_WORDS) -> str:
    return f"list_distinct(list_filter({all_tokens(x)}, lambda t: NOT list_contains({arr(stop)}, t)))"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def any_pattern(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in patterns) + ")"


def values(rows, names: str, alias: str) -> str:
    def one(v):
        return q(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({names})"


def terms(rows) -> str:
    """Dictionary terms (rank, term, canonical) as a table expression."""
    return values([(t.rank, t.term, t.canonical) for t in rows], "rank, term, canonical", "terms")


def hit(norm_col: str, rows) -> str:
    """Whether any term occurs as a whole phrase."""
    return "(" + " OR ".join(f"contains(' ' || {norm_col} || ' ', {q(' ' + t.term + ' ')})" for t in rows) + ")"


def numeric_fee(x: str) -> str:
    return (f"(CASE WHEN {contains_any(f'lower({x})', fv.FREE_WORDS)} THEN 0.0 ELSE coalesce(try_cast(replace("
            f"regexp_extract(lower({x}), '([0-9]+[\\.,]?[0-9]*)', 1), ',', '.') AS DOUBLE), 0.0) END)")


def fee_text(x: str) -> str:
    tries = [f"nullif(regexp_extract({x}, {q('(?i)' + p)}, 1), '')" for p in fv.FEE_PATTERNS]
    return f"coalesce({', '.join(tries)})"


def status_of(title: str, words) -> str:
    cases = " ".join(f"WHEN {contains_any(f'lower({title})', ws)} THEN {q(label)}" for label, ws in words.items())
    return f"(CASE {cases} ELSE {q(fv.STATUS_RUMOUR)} END)"


def classify(n: str, classes, default: str) -> str:
    cases = " ".join(f"WHEN {contains_any(n, ws)} THEN {q(c)}" for c, ws in classes.items())
    return f"(CASE {cases} ELSE {q(default)} END)"


def story_key(e: str, f: str, t: str) -> str:
    parts = [key_text(f"coalesce(nullif({x}, ''), 'unknown')") for x in (e, f, t)]
    return " || '__' || ".join(parts)


def parse_date(x: str) -> str:
    t = f"substr({strip(f'coalesce({x}, chr(32))')}, 1, 10)"
    return ("coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches({t}, {q(shape)}) THEN try_strptime({t}, {q(fmt)}) END"
        for shape, fmt in (("^\\d{4}-\\d{1,2}-\\d{1,2}$", "%Y-%m-%d"), ("^\\d{1,2}/\\d{1,2}/\\d{4}$", "%d/%m/%Y"),
                           ("^\\d{4}/\\d{1,2}/\\d{1,2}$", "%Y/%m/%d"))) + ")")


