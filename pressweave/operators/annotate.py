"""Annotation of an article: entity, organisations, direction, status, class, sentiment, fee."""
from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import (contains_any, lit_array, lit_map, materialize, non_empty, norm_text,
                                       text_or_empty, unquoted)
from pressweave.functions.values import fee_text, numeric_fee, story_key
from pressweave.operators.match import best_entity, entity_terms, org_terms, orgs_in_order, phrase_hits, with_hits
from pressweave.sources.dictionaries import entity_term_rows, org_term_rows
from pressweave.sources.tables import settle


def classify(norm: Column, classes: dict[str, list[str]] = fv.CLASS_KEYWORDS, default: str = fv.DEFAULT_LEAGUE) -> Column:
    """First class, in order, with a keyword inside the normalised text."""
    chosen = F.lit(None).cast("string")
    for name, words in reversed(list(classes.items())):
        chosen = F.when(contains_any(norm, words), name).otherwise(chosen)
    return F.coalesce(chosen, F.lit(default))


def classify_text(raw: Column, classes: dict[str, list[str]] = fv.CLASS_KEYWORDS, default: str = fv.DEFAULT_LEAGUE) -> Column:
    """``classify`` of a text as it came, in which characters may be percent-encoded."""
    return classify(norm_text(unquoted(raw)), classes, default)


def lexicon_sentiment(text: Column, up=fv.SENTIMENT_UP_WORDS, down=fv.SENTIMENT_DOWN_WORDS) -> Column:
    low = F.lower(text)
    return (F.when(contains_any(low, up), fv.SENTIMENT_UP)
            .when(contains_any(low, down), fv.SENTIMENT_DOWN).otherwise(fv.DEFAULT_SENTIMENT))


def status_sentiment(status: Column) -> Column:
    done = status.contains("OFFICIEL") | status.contains("HERE WE GO")
    return F.when(done, fv.SENTIMENT_POSITIVE).otherwise(fv.DEFAULT_SENTIMENT)


def status_of(title: Column, words: dict[str, list[str]] = fv.STATUS_WORDS, default: str = fv.STATUS_RUMOUR) -> Column:
    low = F.lower(title)
    chosen = F.lit(default)
    for label, group in reversed(list(words.items())):
        chosen = F.when(contains_any(low, group), label).otherwise(chosen)
    return chosen


def name_pair(title: Column) -> Column:
    return F.regexp_extract(title, r"(?U)\b([A-ZÀ-ÿ][a-zà-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zà-ÿ]+))\b", 1)


def fallback_entity(title: Column, known_org, default: str = fv.DEFAULT_ENTITY) -> Column:
    """First capitalised word pair of the title unless it names an organisation."""
    pair = name_pair(title)
    return F.when((pair != "") & ~known_org(F.lower(pair)), pair).otherwise(default)


def direction(norm: Column, norm_title: Column, first_org: Column, second_org: Column, current: Column,
              extension=fv.EXTENSION_WORDS, towards=fv.TOWARDS_WORDS, leaves=fv.LEAVES_WORDS) -> Column:
    """struct(org_from, org_to) from the first two organisations, the known current one and the wording.

    The organisations are structs (canonical, plain) as ``orgs_in_order`` gives them.

    Wordings are literal text around an organisation, so each is one substring
    test with a concatenated operand; no pattern is built per row.
    """
    none = F.lit("")
    first, second = first_org["canonical"], second_org["canonical"]

    def pair(a, b):
        return F.struct(a.alias("org_from"), b.alias("org_to"))

    def said(prefixes, org):
        test = F.lit(False)
        for p in prefixes:
            test = test | F.contains(norm, F.concat(F.lit(p + " "), org["plain"]))
        return test

    def pays(org):
        before, after = fv.PAYS_ORG_FOR
        return said(fv.PAYS_ORG_PREFIXES, org) | F.contains(
            norm, F.concat(F.lit(before + " "), org["plain"], F.lit(" " + after)))

    anchor = F.coalesce(non_empty(current), first, none)
    two = (F.when(pays(second_org), pair(second, first))
           .when(pays(first_org), pair(first, second))
           .when(said([fv.OFFER_FROM_PREFIX], first_org), pair(second, first))
           .when(said([fv.OFFER_FROM_PREFIX], second_org), pair(first, second))
           .when(said(fv.TOWARDS_ORG_PREFIXES, second_org), pair(first, second))
           .when(said(fv.TOWARDS_ORG_PREFIXES, first_org), pair(second, first))
           .when(current == second, pair(second, first))
           .otherwise(pair(first, second)))
    one = (F.when(current == first, pair(current, none))
           .when(non_empty(current).isNotNull(), pair(current, first))
           .when(contains_any(norm_title, towards), pair(none, first))
           .when(contains_any(norm_title, leaves), pair(first, none))
           .otherwise(pair(none, first)))
    return (F.when(contains_any(norm_title, extension), pair(anchor, anchor))
            .when(second.isNotNull(), two)
            .when(first.isNotNull(), one)
            .otherwise(pair(F.coalesce(current, none), none)))


def attribute(name: Column, table: dict[str, str]) -> Column:
    """Exact lookup in a small parameter table; NULL when absent."""
    return F.element_at(lit_map(table), name) if table else F.lit(None).cast("string")


ANNOTATED = ["entity", "nationality", "org_from", "org_to", "status", "league", "fee_text", "sentiment", "fee_numeric", "story_key"]
BASES = {"sentiment": ["status"], "fee_numeric": ["fee_text"], "story_key": ["entity", "org_from", "org_to"]}


def annotate(df: DataFrame, entities: dict | DataFrame, org_aliases: dict[str, str] | DataFrame,
             classes: dict[str, list[str]] = fv.CLASS_KEYWORDS, default_class: str = fv.DEFAULT_LEAGUE,
             status_words: dict[str, list[str]] = fv.STATUS_WORDS, wording: dict[str, list[str]] | None = None,
             keep_norm: bool = False, key: str | None = None, fields: Iterable[str] = ANNOTATED) -> DataFrame:
    """Add the local annotation to rows with ``title`` and ``summary``.

    ``entities``: ``{name: {"org": current, "nationality": text, "aliases": [..]}}``.
    ``wording`` replaces the extension, towards or leaves words of ``direction``.
    With dictionaries that are parameters it is row-local: no join and no shuffle.
    Both may instead be tables of any size, (name, org, nationality, aliases, ord)
    and (alias, canonical, ord), which are joined; rows then need a unique ``key``.
    ``fields`` names the columns that are wanted; nothing is worked out for others.
    """
    wanted = set(fields)
    if wanted - set(ANNOTATED):
        raise ValueError(f"unknown fields {sorted(wanted - set(ANNOTATED))}")
    made = wanted.union(*[BASES.get(f, []) for f in wanted])
    directed, named = bool(made & {"org_from", "org_to"}), bool(made & {"entity", "nationality"})
    title, summary = text_or_empty(F.col("title")), text_or_empty(F.col("summary"))
    norm, said = F.col("_norm"), F.concat_ws(" ", title, summary)
    step = df
    if "_norm" not in df.columns and (directed or named or "league" in made):
        step = materialize(df, _norm=norm_text(said))
    listed = not isinstance(org_aliases, DataFrame)
    if directed and not listed or (directed or named) and isinstance(entities, DataFrame):
        step = settle(step, "normalised")  # each dictionary reads the normalised texts, and so does the result
    if directed:
        step = with_hits(step, "_norm", "_hits", org_terms(org_aliases) if listed else org_term_rows(org_aliases), key)
    if directed or named:
        if isinstance(entities, DataFrame):
            step = with_hits(step, "_norm", "_found", entity_term_rows(entities), key)
            known = entities.select(F.col("name").alias("_entity"), non_empty(F.col("org")).alias("_current"), non_empty(F.col("nationality")).alias("_nation"))
            step = step.withColumn("_entity", best_entity(F.col("_found"))).drop("_found").join(known, "_entity", "left")
        else:
            step = materialize(step, _entity=best_entity(phrase_hits(norm, entity_terms(entities))))
            step = step.withColumns({f"_{to}": attribute(F.col("_entity"), {n: a[c] for n, a in entities.items() if a.get(c)})
                                     for to, c in (("current", "org"), ("nation", "nationality"))})
    if directed:
        step = materialize(step, _norm_title=norm_text(title), _orgs=orgs_in_order(F.col("_hits"), norm))
        step = materialize(step, _direction=direction(
            norm, F.col("_norm_title"), F.try_element_at("_orgs", F.lit(1)), F.try_element_at("_orgs", F.lit(2)),
            F.col("_current"), **(wording or {})))
    if "entity" in made and listed:
        def known_org(pair: Column) -> Column:
            return F.array_contains(lit_array(org_aliases), pair)
    elif "entity" in made:
        step = step.withColumn("_pair", F.lower(name_pair(title)))
        names = org_aliases.select(F.col("alias").alias("_pair"), F.lit(True).alias("_is_org")).distinct()
        step = step.join(names, "_pair", "left").drop("_pair")

        def known_org(pair: Column) -> Column:
            return F.coalesce("_is_org", F.lit(False))
    columns = {}
    if "entity" in made:
        columns["entity"] = F.coalesce("_entity", fallback_entity(title, known_org))
    if "nationality" in made:
        columns["nationality"] = F.coalesce("_nation", F.lit(fv.DEFAULT_NATIONALITY))
    columns |= {f: F.col("_direction")[f] for f in ("org_from", "org_to") if f in made}
    if "status" in made:
        columns["status"] = status_of(title, status_words)
    if "league" in made:
        columns["league"] = F.when(said.contains("%"), classify_text(said, classes, default_class)).otherwise(classify(norm, classes, default_class))
    if "fee_text" in made:
        columns["fee_text"] = F.coalesce(fee_text(said), F.lit(fv.UNKNOWN_FEE))
    out = step.drop(*[c for c in made if c in df.columns])
    out = materialize(out, **columns) if columns else out
    if "sentiment" in made:
        out = out.withColumn("sentiment", status_sentiment(F.col("status")))
    if "fee_numeric" in made:
        out = out.withColumn("fee_numeric", numeric_fee(F.when(F.col("fee_text") != fv.UNKNOWN_FEE, F.col("fee_text"))))
    if "story_key" in made:
        out = out.withColumn("story_key", story_key(F.col("entity"), F.col("org_from"), F.col("org_to")))
    drop = ["_norm_title", "_entity", "_hits", "_orgs", "_current", "_nation", "_is_org", "_direction"]
    return out.drop(*drop, *([] if keep_norm else ["_norm"]))


def headline(status: Column, entity: Column, org_from: Column, org_to: Column, fee: Column, title: Column) -> Column:
    """Headline by status and by what is known."""
    header = F.lit(fv.STATUS_HEADERS[""])
    for word, text in reversed([kv for kv in fv.STATUS_HEADERS.items() if kv[0]]):
        header = F.when(status.contains(word), text).otherwise(header)
    moves = (entity != "") & (org_to != "") & (org_from != "") & (org_from != org_to)
    return (F.when(moves, F.format_string("%s %s quitte %s pour %s — %s", header, entity, org_from, org_to, fee))
            .when((entity != "") & (org_to != ""), F.format_string("%s %s en route vers %s", header, entity, org_to))
            .when(entity != "", F.format_string("%s Mise à jour sur l'avenir de %s", header, entity))
            .otherwise(F.format_string("%s %s", header, title)))


def bullet_summary(entity: Column, org_from: Column, org_to: Column, fee: Column, title: Column) -> Column:
    """Bullets separated by blank lines; unknown facts give no bullet."""
    lead = (F.when((entity != "") & (org_to != ""), F.format_string("🚨 %s a trouvé un accord pour %s.", org_to, entity))
            .when(entity != "", F.format_string("🚨 Mise à jour importante sur l'avenir de %s.", entity))
            .otherwise(F.concat(F.lit("🚨 "), title)))
    parties = (F.when((org_from != "") & (org_to != "") & (org_from != org_to),
                      F.format_string("🤝 Négociations avancées entre %s et %s.", org_from, org_to))
               .when((org_from == org_to) & (org_from != ""),
                     F.format_string("📝 Prolongation de contrat avec %s.", org_from)))
    amount = F.when((fee != "") & (fee != fv.UNKNOWN_FEE),
                    F.format_string("💶 Montant convenu : %s + bonus et variables.", fee))
    return F.concat_ws("\n\n", lead, parties, amount,
                       F.lit("🩺 Visite médicale prévue, termes personnels acceptés."),
                       F.lit("💬 Note ce transfert de 1 à 10 ! ⏬"))


ANNOTATION_FIELDS = ["entity", "org_from", "org_to", "fee_text", "league", "status", "nationality"]


def skip_off_topic(rows: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """Rows that the external annotation does not call off topic; before the local annotation, so nothing is spent on them."""
    return rows.join(external.filter(~F.col("is_topic")).select(key), key, "left_anti")


def merge_annotations(local: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """Prefer an externally computed annotation, with per-field defaults; else the local one.

    ``external`` has the key, ``is_topic`` and any of the annotation fields.
    Rows it marks as off topic are dropped.
    """
    defaults = {"entity": "", "org_from": "", "org_to": "", "fee_text": fv.UNKNOWN_FEE,
                "league": fv.DEFAULT_REMOTE_LEAGUE, "status": fv.STATUS_RUMOUR, "nationality": ""}
    ext = external.select(
        F.col(key), F.lit(True).alias("_ext"), F.col("is_topic").alias("_topic"),
        *[(F.col(f) if f in external.columns else F.lit(None)).cast("string").alias("_" + f)
          for f in [*ANNOTATION_FIELDS, "story_key"]],
        *[(F.col(f) if f in external.columns else F.lit(None)).cast("double").alias("_" + f)
          for f in ["fee_numeric", "credibility"]])
    has = F.col("_ext").isNotNull()
    out = local.join(ext, key, "left").filter(F.coalesce("_topic", F.lit(True)))
    for f in ANNOTATION_FIELDS:
        out = out.withColumn(f, F.when(has, F.coalesce(non_empty(F.col("_" + f)), F.lit(defaults[f]))).otherwise(F.col(f)))
    recomputed = story_key(F.col("entity"), F.col("org_from"), F.col("org_to"))
    out = (out
           .withColumn("fee_numeric", F.when(has, F.coalesce("_fee_numeric", F.lit(0.0))).otherwise(F.col("fee_numeric")))
           .withColumn("credibility", F.when(has, F.coalesce(F.nullif("_credibility", F.lit(0.0)), F.lit(4.0)))
                       .otherwise(F.col("credibility")))
           .withColumn("story_key", F.when(has, F.coalesce(non_empty(F.col("_story_key")), recomputed))
                       .otherwise(F.col("story_key")))
           .withColumn("annotated_by", F.when(has, "external").otherwise("local"))
           .withColumn("sentiment", status_sentiment(F.col("status"))))
    return out.drop("_ext", "_topic", "_story_key", "_fee_numeric", "_credibility", *["_" + f for f in ANNOTATION_FIELDS])


def fill_placeholders(df: DataFrame, entities: dict | DataFrame, org_aliases: dict[str, str] | DataFrame, key: str | None = None) -> DataFrame:
    """Replace empty or placeholder fields of stored rows by the local annotation.

    Only those fields are worked out, and a row without a gap is annotated as an empty text.
    """
    fields = ["entity", "org_from", "org_to", "status", "fee_text"]
    gaps = {f: F.col("_in_" + f).isNull() | F.col("_in_" + f).isin(*fv.PLACEHOLDERS.get(f, []), "", "nan") for f in fields}
    rows = df.select("*", *[F.col(f).alias("_in_" + f) for f in fields])
    rows = rows.withColumn("_gap", reduce(lambda a, b: a | b, gaps.values()))
    rows = rows.withColumns({"_in_title": F.col("title"), "_in_summary": F.col("summary")}).withColumns(
        {c: F.when(F.col("_gap"), F.col(c)).otherwise("") for c in ("title", "summary", *(["_norm"] if "_norm" in df.columns else []))})
    done = annotate(rows, entities, org_aliases, key=key, fields=fields)
    filled = {f: F.when(gap, F.col(f)).otherwise(F.col("_in_" + f)) for f, gap in gaps.items()}
    kept = {c: F.col("_in_" + c) for c in ("title", "summary")}
    return done.withColumns(filled | kept).drop("_gap", *["_in_" + c for c in (*fields, "title", "summary")])
