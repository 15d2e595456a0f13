"""Whole-phrase dictionary matching.

After ``norm_text`` a text is words with single blanks, so "term occurs as a
whole phrase" is "`` term `` occurs in `` text ``".

Two plans give the same rows:

* ``phrase_hits`` takes terms that are parameters of a job and stays inside the
  row.  Words of the text that start some term are found with one hash
  intersection, and only the terms behind those words are looked up.
* ``phrase_hits_join`` takes a dictionary table of any size: word n-grams of the
  text are equi-joined to it.  A filter of fixed size over the terms' first words,
  lengths and whole terms is applied before an n-gram is made and before it is
  shuffled.  The join sorts, so no side need fit in memory, and adaptive execution
  splits frequent n-grams.

``with_hits`` adds the hits by the plan that fits what it is given.
"""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressweave.functions.text import lit_array, materialize, norm_text, norm_words
from pressweave.operators.keyfilter import distinct_values, key_filter, may_hold

MIN_ALIAS = 4


@dataclass(frozen=True)
class Term:
    term: str
    canonical: str
    rank: int


def entity_terms(entities: dict) -> list[Term]:
    """Terms of ``{name: {"aliases": [...], ...}}``; rank orders the names, longest first."""
    names = sorted(entities, key=lambda n: -len(n))
    terms = []
    for rank, name in enumerate(names):
        spellings = [norm_words(name)]
        spellings += [a for a in map(norm_words, entities[name].get("aliases", [])) if len(a) >= MIN_ALIAS]
        terms += [Term(t, name, rank) for t in dict.fromkeys(spellings) if t]
    return terms


def org_terms(aliases: dict[str, str]) -> list[Term]:
    """Terms of ``{alias: canonical}``; rank orders the aliases, longest first.

    Aliases are matched as written: one that holds an accent or a hyphen cannot
    occur in a normalised text.
    """
    ordered = sorted(aliases, key=lambda a: -len(a))
    return [Term(a, aliases[a], rank) for rank, a in enumerate(ordered) if a.strip()]


HITS = "array<struct<rank:bigint,term:string,canonical:string,plain:string>>"


def phrase_hits(norm: Column, terms: list[Term]) -> Column:
    """array<struct<rank,term,canonical,plain>> of the terms that occur in the text.

    ``plain`` is the normalised canonical name.
    """
    if not terms:
        return F.array().cast(HITS)
    by_word: dict[str, list[dict]] = {}
    for t in terms:
        by_word.setdefault(t.term.split(" ")[0], []).append(
            {"rank": t.rank, "term": t.term, "canonical": t.canonical, "plain": norm_words(t.canonical)})
    # one JSON literal; the optimizer turns it into a constant map
    table = F.from_json(F.lit(json.dumps(by_word)), f"map<string,{HITS}>")
    starts = F.array_intersect(F.split(norm, " "), lit_array(by_word))
    candidates = F.flatten(F.transform(starts, lambda w: F.element_at(table, w)))
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    return F.filter(candidates, lambda t: F.contains(padded, F.concat(F.lit(" "), t["term"], F.lit(" "))))


def has_hit(norm: Column, terms: list[Term]) -> Column:
    return F.size(phrase_hits(norm, terms)) > 0


def best_entity(hits: Column) -> Column:
    """The longest canonical name that matched (dictionary order on ties); NULL without a hit."""
    return F.array_min(F.transform(hits, lambda h: F.struct(h["rank"], h["canonical"])))["canonical"]


def orgs_in_order(hits: Column, norm: Column) -> Column:
    """Canonical organisations by position; each is placed at its longest alias."""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    ranked = F.sort_array(hits)
    names = F.transform(ranked, lambda h: h["canonical"])
    first = F.filter(ranked, lambda h, i: F.array_position(names, h["canonical"]) == i + 1)
    placed = F.transform(first, lambda h: F.struct(
        (F.instr(padded, F.concat(F.lit(" "), h["term"], F.lit(" "))) - 1).alias("position"),
        h["rank"].alias("rank"), h["canonical"].alias("canonical"), h["plain"].alias("plain")))
    return F.sort_array(placed)


def terms_table(spark: SparkSession, terms: list[Term]) -> DataFrame:
    """Terms as a table."""
    return spark.createDataFrame([(t.rank, t.term, t.canonical) for t in terms], "rank long, term string, canonical string")


def with_hits(df: DataFrame, norm: str, into: str, terms: list[Term] | DataFrame, key: str | None = None) -> DataFrame:
    """Adds the hits of ``phrase_hits``; for a table (rank, term, canonical) rows need a unique ``key``.

    The hits of a text are gathered by key, so a group holds the terms of one text.
    """
    if not isinstance(terms, DataFrame):
        return materialize(df, **{into: phrase_hits(F.col(norm), terms)})
    if key is None:
        raise ValueError("a dictionary table needs the key of the rows")
    hits = phrase_hits_join(df, key, norm, terms)
    gathered = hits.groupBy(key).agg(F.collect_list(F.struct(
        F.col("rank").cast("long").alias("rank"), "term", "canonical", norm_text(F.col("canonical")).alias("plain"))).alias(into))
    return df.join(gathered, key, "left").withColumn(into, F.coalesce(into, F.array().cast(HITS)))


def phrase_hits_join(texts: DataFrame, key: str, norm: str, terms: DataFrame) -> DataFrame:
    """(key, rank, term, canonical, word_position) per matched term, first position in the text; ``key`` is unique.

    A word is followed up only where some term starts with it, at the lengths of such
    terms, and an n-gram leaves the row once, and only where the filter knows it.  Only
    the key, the n-gram and, where it is asked for, its position leave the row, never
    the text.  N-grams outnumber what Spark expects of the texts, so they are never the
    side that is broadcast or hashed: the join sorts, and spills.
    """
    sized = terms.select("term", F.split("term", " ").alias("_w")).select("term", F.get("_w", F.lit(0)).alias("_first"), F.size("_w").alias("_n"))
    known = key_filter(sized.select(F.explode(F.array(F.xxhash64("_first"), F.xxhash64("_first", "_n"), F.xxhash64("term"))).alias("h")))
    lengths = distinct_values(sized, F.col("_n"))
    words = texts.select(key, F.col(norm).alias("_norm"), F.split(norm, " ").alias("_w"))
    # where all terms are single words, a word is tried once and its place is looked up only if it is asked for
    single = F.array_max(lengths) == 1
    starts = words.select("*", F.posexplode(F.when(single, F.array_distinct("_w")).otherwise(F.col("_w"))).alias("_at", "_first")).filter(may_hold(known, F.xxhash64("_first")))
    spans = starts.select("*", F.explode(lengths).alias("_n")).filter(
        (F.col("_at") + F.col("_n") <= F.size("_w")) & may_hold(known, F.xxhash64("_first", "_n")))
    gram = F.when(F.col("_n") == 1, F.col("_first")).otherwise(F.array_join(F.slice("_w", F.col("_at") + 1, F.col("_n")), " "))
    before = F.call_function("substring_index", F.concat(F.lit(" "), "_norm", F.lit(" ")), F.concat(F.lit(" "), "_gram", F.lit(" ")), F.lit(1))
    place = F.size(F.split(before, " ")) - 1
    grams = (spans.select(key, "_norm", "_at", gram.alias("_gram")).filter(may_hold(known, F.xxhash64("_gram")))
             .filter(single | (F.col("_at") == place)).select(key, place.alias("word_position"), "_gram"))
    entries = terms.select("rank", "term", "canonical").distinct()
    return grams.join(entries.hint("merge"), F.col("_gram") == F.col("term")).select(key, "rank", "term", "canonical", "word_position")
