"""Numbers, dates, keys and amounts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import contains_any, key_text, non_empty, strip, text_or_empty

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_float(c: Column) -> Column:
    t = strip(text_or_empty(c))
    return F.when(t.rlike(NUMBER), t.try_cast("double")).otherwise(F.lit(0.0))


def parse_date(c: Column, rfc822: bool = False) -> Column:
    """First ten characters as yyyy-m-d, d/m/yyyy or yyyy/m/d; NULL otherwise."""
    t = strip(text_or_empty(c))
    token = F.substring(t, 1, 10)
    tries = [
        F.when(token.rlike(shape), F.try_to_date(token, fmt))
        for shape, fmt in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
                           (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
                           (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"))
    ]
    if rfc822:
        day = F.regexp_extract(t, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1)
        tries.append(F.when(day != "", F.try_to_date(day, "d MMM yyyy")))
    return F.coalesce(*tries).cast("timestamp_ntz")


def external_key(source: Column, title: Column, url: Column, raw_date: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[text_or_empty(c) for c in (source, title, url, raw_date)]))


def title_key(title: Column, length: int = 60) -> Column:
    """Letters and digits of the lower-cased title."""
    return F.substring(F.regexp_replace(F.lower(text_or_empty(title)), r"[^\p{L}\p{N}_]+", ""), 1, length)


def story_key(entity: Column, org_from: Column, org_to: Column) -> Column:
    parts = [key_text(F.coalesce(non_empty(c), F.lit("unknown"))) for c in (entity, org_from, org_to)]
    return F.concat_ws("__", *parts)


def numeric_fee(c: Column) -> Column:
    """Millions in a fee text; free moves and loans are 0."""
    t = F.lower(text_or_empty(c))
    number = F.replace(F.regexp_extract(t, r"([0-9]+[\.,]?[0-9]*)", 1), F.lit(","), F.lit("."))
    return F.when(contains_any(t, fv.FREE_WORDS), 0.0).otherwise(F.coalesce(number.try_cast("double"), F.lit(0.0)))


def fee_text(c: Column, patterns=fv.FEE_PATTERNS) -> Column:
    """First pattern that matches gives the fee text; NULL when none does."""
    t = text_or_empty(c)
    return F.coalesce(*[non_empty(F.regexp_extract(t, "(?i)" + p, 1)) for p in patterns])


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)
