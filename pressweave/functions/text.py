"""Text clean-up, folding and tokenising as Column expressions."""
from __future__ import annotations

import html.entities
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv

# every character Python and Unicode treat as white space
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


SEPARATOR = "\u0001"


def lit_array(values) -> Column:
    """A literal array<string>: one string that the optimizer splits once, not a node per value."""
    values = list(values)
    return F.split(F.lit(SEPARATOR.join(values)), SEPARATOR) if values else F.array().cast("array<string>")


def lit_map(table: dict[str, str]) -> Column:
    """A literal map<string,string>, folded once like ``lit_array``."""
    return F.map_from_arrays(lit_array(table), lit_array(table.values()))


def materialize(df: DataFrame, keep=("*",), **columns: Column) -> DataFrame:
    """Add columns that later steps read but never recompute.

    A filter or projection above a plain projection is merged with it, and a
    costly expression is then evaluated once per use.  The one-row ``inline`` is
    a boundary the optimizer keeps; it adds no shuffle.  The values are computed
    in the projection below it, which shares common subexpressions.
    """
    computed = df.select(*keep, *[c.alias("_m_" + n) for n, c in columns.items()])
    rest = [c for c in computed.columns if not c.startswith("_m_")]
    return computed.select(*rest, F.inline(F.array(F.struct(*[F.col("_m_" + n).alias(n) for n in columns]))))


def bind(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` evaluated once, where ``fn`` uses it several times inside one expression."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def unquoted(c: Column) -> Column:
    """Percent-encoded bytes decoded; a lone % and a + stay as they are."""
    safe = F.replace(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(safe), c)).otherwise(c)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(F.translate(c, WHITESPACE, " " * len(WHITESPACE)), "  +", " ")


def non_empty(c: Column) -> Column:
    """The value, or NULL when it is the empty string (for coalesce chains)."""
    return F.nullif(c, F.lit(""))


def contains_any(c: Column, words) -> Column:
    """True when the text contains one of the words as a plain substring."""
    test = F.lit(False)
    for word in words:
        test = test | c.contains(word)
    return test


def clean_value(c: Column) -> Column:
    """Trimmed text; missing markers (nan, none, null, nat) become ''."""
    t = strip(text_or_empty(c))
    longest = max(len(w) for w in fv.EMPTY_WORDS)
    return F.when((F.length(t) <= longest) & F.lower(t).isin(fv.EMPTY_WORDS), "").otherwise(t)


def polish_text(c: Column, cleaned: bool = False) -> Column:
    """Repair glued text: single blanks, a blank after punctuation, split aB / 1x / x1.

    ``cleaned`` says that the value already went through ``clean_value``.
    """
    t = collapse(c if cleaned else clean_value(c))
    for pattern in fv.GLUED_PATTERNS:
        t = F.regexp_replace(t, pattern, "$1 $2")
    return strip(t)


def shorten(c: Column, limit: int) -> Column:
    cut = F.rtrim(F.substring(c, 1, limit - 1), F.lit(WHITESPACE))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def shorten_clean(c: Column, limit: int) -> Column:
    """The report variant: clean and collapse first."""
    return shorten(strip(collapse(clean_value(c))), limit)


def clean_text(c: Column) -> Column:
    t = F.regexp_replace(text_or_empty(c), r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "")
    t = collapse(t)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return strip(t)


REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unescape(c: Column) -> Column:
    """Resolve named and numeric character references; only those present are looked at."""
    names = {k: chr(v) for k, v in html.entities.name2codepoint.items()} | {"apos": "'"}
    table = lit_map(names)

    def value(ref: Column) -> Column:
        hexed = F.conv(F.substring(ref, 3, 6), 16, 10)
        number = F.when(F.lower(ref).startswith("#x"), hexed).otherwise(F.substring(ref, 2, 7)).try_cast("bigint")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.when(ref.startswith("#"), char).otherwise(F.element_at(table, ref))

    def resolved(t: Column) -> Column:
        found = F.array_except(F.array_distinct(F.regexp_extract_all(t, F.lit(REFERENCE), 1)), lit_array(["amp"]))
        text = F.reduce(found, t, lambda acc, ref: F.coalesce(
            F.replace(acc, F.concat(F.lit("&"), ref, F.lit(";")), value(ref)), acc))
        return F.when(t.contains("&"), F.replace(text, F.lit("&amp;"), F.lit("&"))).otherwise(t)

    return bind(c, resolved)


def drop_elements(c: Column, *names: str) -> Column:
    """Remove whole elements, content included."""
    return F.regexp_replace(c, rf"(?is)<({'|'.join(names)})\b[^>]*>.*?</\1\s*>", " ")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")


def clean_html(c: Column) -> Column:
    """Visible text of an html fragment."""
    def stripped(t: Column) -> Column:
        body = F.regexp_replace(t, r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", "")
        return F.when(t.contains("<"), strip_tags(body)).otherwise(t)

    return strip(collapse(unescape(bind(text_or_empty(c), stripped))))


def _decompositions():
    """Characters of the basic plane whose compatibility form has ASCII in it."""
    single, several = {}, {}
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single[chr(cp)] = plain
        elif plain:
            several[chr(cp)] = plain
    return single, several


_SINGLE, _SEVERAL = _decompositions()


# a few wide ranges that cover every key of _SEVERAL; a long list of characters is slow to test
_MAY_EXPAND = r"[\u00bc-\u00be\u0132\u0133\u01c4-\u01f3\u2025-\u33ff\ufb00-\uffff]"
_NON_WORD = "".join(ch for ch in map(chr, range(128)) if not (ch.isalnum() or ch == "_"))


def non_ascii(c: Column) -> Column:
    """Two lengths, which is far cheaper than a pattern over the text."""
    return F.octet_length(c) != F.length(c)


def _expanded(c: Column) -> Column:
    """Replace the characters that expand to several; rows without one pass through."""
    table = lit_map(_SEVERAL)
    present = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({_MAY_EXPAND})"), 1))
    replaced = F.reduce(present, c, lambda acc, ch: F.replace(acc, ch, F.coalesce(F.element_at(table, ch), ch)))
    return F.when(non_ascii(c) & c.rlike(_MAY_EXPAND), replaced).otherwise(c)


def _drop_non_ascii(c: Column) -> Column:
    return F.when(non_ascii(c), F.regexp_replace(c, r"[^\x00-\x7F]+", "")).otherwise(c)


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition, then drop whatever is not ASCII."""
    return _drop_non_ascii(F.translate(_expanded(c), "".join(_SINGLE), "".join(_SINGLE.values())))


def norm_text(c: Column) -> Column:
    """ASCII words separated by single blanks, lower case.

    One character map folds the letters and blanks the punctuation; patterns
    run only for what is left, because a pattern that matches at every word is
    several times slower than the map.
    """
    targets = {ch: v if v.isalnum() or v == "_" else " " for ch, v in _SINGLE.items()} | dict.fromkeys(_NON_WORD, " ")
    mapped = F.translate(_expanded(text_or_empty(c)), "".join(targets), "".join(targets.values()))
    return F.trim(F.regexp_replace(F.lower(_drop_non_ascii(mapped)), "  +", " "))


def norm_words(value: str) -> str:
    """``norm_text`` for dictionary terms, which are parameters held by the driver."""
    plain = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode().lower()
    return " ".join("".join(ch if ch.isalnum() or ch == "_" else " " for ch in plain).split())


_MARKED = {
    ch: base
    for ch in map(chr, list(range(0x80, 0xD800)) + list(range(0xE000, 0x10000)))
    if len(base := "".join(x for x in unicodedata.normalize("NFD", ch) if not "\u0300" <= x <= "\u036f")) == 1
    and base.isascii() and base != ch
}


def key_text(c: Column) -> Column:
    """Letters and digits joined by single underscores, marks removed."""
    t = F.lower(strip(text_or_empty(c)))
    plain = F.regexp_replace(F.translate(t, "".join(_MARKED), "".join(_MARKED.values())), r"[\u0300-\u036f]", "")
    t = F.when(non_ascii(t), plain).otherwise(t)
    return F.btrim(F.regexp_replace(t, "[^a-z0-9]+", "_"), F.lit("_"))


TOKEN = r"[a-z0-9\u00c0-\u024f\u0600-\u06ff]{3,}"


def all_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(clean_text(c)), F.lit(f"({TOKEN})"), 1)


def tokenize(c: Column, stop_words=fv.STOP_WORDS) -> Column:
    """Distinct tokens of three characters or more, stop-words removed."""
    return F.array_except(all_tokens(c), lit_array(stop_words))


def detect_language(c: Column, french=fv.FRENCH_WORDS) -> Column:
    """Arabic by share of letters, French by its articles in the first five words, else English."""
    title = text_or_empty(c)
    total = F.length(F.replace(title, F.lit(" "), F.lit("")))
    arabic = F.length(F.regexp_replace(title, r"[^\u0600-\u06ff]", ""))
    head = F.slice(F.split(strip(F.lower(title)), WS + "+"), 1, 5)
    return (F.when(total == 0, "fr").when(arabic / total > 0.25, "ar")
            .when(F.arrays_overlap(head, lit_array(french)), "fr").otherwise("en"))


def category_slug(c: Column) -> Column:
    slug = F.btrim(F.regexp_replace(clean_value(c), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(non_empty(slug), F.lit("categorie"))


def normalize_category(c: Column) -> Column:
    return F.coalesce(non_empty(clean_value(c)), F.lit(fv.DEFAULT_CATEGORY))


def current_org(c: Column, pattern=fv.BIO_ORG_PATTERN) -> Column:
    """The organisation named in a biography sentence, '' when there is none."""
    found = strip(F.regexp_extract(text_or_empty(c), pattern, 1))
    return F.when((F.length(found) > 2) & ~found.isin("the", "a", "national team"), found).otherwise("")
