"""Topic filter, blocked sources and the purge / skip predicates built on them."""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import contains_any, materialize, non_empty, norm_text, text_or_empty
from pressweave.operators.match import Term, has_hit, with_hits


@dataclass(frozen=True)
class TopicRules:
    """Entities and organisations are terms, or tables (rank, term, canonical) of any size."""

    entities: list[Term] | DataFrame = field(default_factory=list)
    orgs: list[Term] | DataFrame = field(default_factory=list)
    blocked: list[str] = field(default_factory=lambda: fv.BLOCKED_SOURCES)
    patterns: list[str] = field(default_factory=lambda: fv.TOPIC_PATTERNS)
    raw_words: list[str] = field(default_factory=lambda: fv.TOPIC_RAW_WORDS)
    off_topic: list[str] = field(default_factory=lambda: fv.OFF_TOPIC_PATTERNS)


def any_pattern(c: Column, patterns) -> Column:
    """One alternation, so the text is walked once."""
    return c.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def is_blocked(source: Column, title: Column, blocked=fv.BLOCKED_SOURCES) -> Column:
    """The normalised source (the title when there is none) contains a blocked term."""
    name = norm_text(F.coalesce(non_empty(text_or_empty(source)), title))
    return name.rlike("|".join(re.escape(b) for b in blocked)) if blocked else F.lit(False)


def flag_topic(df: DataFrame, rules: TopicRules, title="title", summary="summary", source="source", key: str | None = None) -> DataFrame:
    """Add ``_norm`` and ``on_topic``; with dictionary tables ``key`` names the rows.

    Keep rule: not empty, not blocked, and (entity or organisation or (positive
    and not negative)).  Cheap tests come first; CASE branches are evaluated
    only when reached.
    """
    raw = F.concat_ws(" ", text_or_empty(F.col(title)), text_or_empty(F.col(summary)))
    rows = df if "_norm" in df.columns else materialize(df, _norm=norm_text(raw))
    norm = F.col("_norm")
    positive = any_pattern(norm, rules.patterns) | contains_any(raw, rules.raw_words)
    tables = [t for t in (rules.entities, rules.orgs) if isinstance(t, DataFrame)]
    for i, terms in enumerate(tables):
        rows = with_hits(rows, "_norm", f"_known{i}", terms, key)
    listed = [t for t in (rules.entities, rules.orgs) if not isinstance(t, DataFrame)]
    known = has_hit(norm, sum(listed, []))
    for i in range(len(tables)):
        known = known | (F.size(f"_known{i}") > 0)
    keep = (F.when(norm == "", False)
            .when(is_blocked(F.col(source), F.col(title), rules.blocked), False)
            .when(known, True)
            .otherwise(positive & ~any_pattern(norm, rules.off_topic)))
    return materialize(rows, on_topic=keep).drop(*[f"_known{i}" for i in range(len(tables))])


def keep_on_topic(df: DataFrame, rules: TopicRules, title="title", summary="summary", source="source",
                  keep_norm: bool = False, key: str | None = None) -> DataFrame:
    """Rows on topic.  Blocked sources are dropped before any text is normalised.

    ``keep_norm`` leaves the normalised text for the annotation that follows.
    """
    open_sources = df.filter(~is_blocked(F.col(source), F.col(title), rules.blocked))
    kept = flag_topic(open_sources, rules, title, summary, source, key).filter("on_topic")
    return kept.drop("on_topic", *([] if keep_norm else ["_norm"]))


def purge_counts(df: DataFrame, rules: TopicRules) -> DataFrame:
    """Dry run of a purge: what would go and what would stay."""
    return flag_topic(df, rules).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("on_topic")).alias("purged"),
        F.count_if("on_topic").alias("remaining"),
    )


def keyword_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Case-insensitive pattern search in one column."""
    return df.filter(F.col(column).rlike("(?i)" + pattern))
