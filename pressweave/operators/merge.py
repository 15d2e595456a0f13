"""Story merge: one row per story key, best row first, fields filled from the others.

The rule is a fold over the rows of a story in order of quality.  Every field
of the fold is "first acceptable value in that order" or a maximum.  A row's place in
the order is one decimal number, so the aggregate's state is of fixed width and Spark
hashes instead of sorting: it is combined on the map side, one shuffle carries one
row per (task, key), and a hot story is no problem.  What the aggregate finds are the
places of the rows that give each field; their values, and the best row's texts, are
fetched by joins afterwards.  Rows that are alone in their story are never aggregated
into anything: they are the result.
"""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import key_text, materialize, strip, text_or_empty
from pressweave.operators.score import quality_score
from pressweave.sources.tables import settle

FILLED = ["entity", "org_from", "org_to", "fee_text", "nationality", "league"]


def merge_key(key: Column, entity: Column | None = None) -> Column:
    """Cleaned story key; NULL when the row has no usable key.

    With ``entity`` given, keys of unknown or placeholder entities are unusable
    as well, so unrelated rows do not fall into one story.
    """
    raw = strip(text_or_empty(key))
    usable = key.isNotNull() & ~raw.isin(fv.INVALID_STORY_KEYS)
    cleaned = F.nullif(key_text(raw), F.lit(""))
    if entity is not None:
        usable = usable & ~strip(text_or_empty(entity)).isin([*fv.PLACEHOLDERS["entity"], "unknown"])
    return F.when(usable, cleaned)


def _number(c: Column) -> Column:
    return F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


PLACES = 1 << 64
STEPS = 1e9
LIMIT = 1e6


def place_of(quality: Column, order: Column) -> Column:
    """A number that is smaller for higher quality (told apart to nine decimals) and, at equal quality, for the smaller order."""
    steps = F.round((F.lit(LIMIT) - F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), quality))) * STEPS).cast("decimal(16,0)")
    after = order.cast("long").cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    return (steps * F.lit(Decimal(PLACES)) + after).cast("decimal(38,0)")


def order_at(place: Column) -> Column:
    """The order that a place holds."""
    return (F.pmod(place, F.lit(Decimal(PLACES)).cast("decimal(38,0)")) - F.lit(Decimal(1 << 63))).cast("long")


def merge_stories(df: DataFrame, order: str, key: str = "story_key", strict: bool = True,
                  placeholders: dict[str, list[str]] = fv.PLACEHOLDERS,
                  status_priority: dict[str, int] = fv.STATUS_PRIORITY) -> DataFrame:
    """Merge rows with the same story key; rows without a usable key pass through.

    ``order`` is a unique column of whole numbers that settles ties in quality.  The
    rows are written once to the shared folder, as they are read three times.
    """
    columns, types = df.columns, {f.name: f.dataType for f in df.schema}
    if types[order].typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{order} must hold whole numbers")
    filled = [f for f in FILLED if f in columns]
    rows = materialize(df, _key=merge_key(F.col(key), F.col("entity") if strict else None), _place=place_of(quality_score(df), F.col(order)))
    rows = settle(rows, "stories")
    keyed = rows.filter("_key IS NOT NULL")

    values = {f: strip(text_or_empty(F.col(f))) for f in filled}
    places = {f: F.when(~values[f].isin(placeholders[f]), F.col("_place")) for f in filled}
    if "status" in columns:
        levels = sorted({0, *status_priority.values()}, reverse=True)
        level = F.lit(levels.index(0))
        for label, p in status_priority.items():
            level = F.when(F.col("status") == label, levels.index(p)).otherwise(level)
        values["status"] = F.col("status")
        places["status"] = (level.cast("decimal(3,0)") * F.lit(Decimal(10 ** 35)) + F.col("_place")).cast("decimal(38,0)")
    if "image_url" in columns:
        image = strip(text_or_empty(F.col("image_url")))
        values |= {"_image_http": image, "_image_any": image}
        places["_image_http"] = F.when(image.startswith("http"), F.col("_place"))
        places["_image_any"] = F.when(~image.isin(placeholders["image_url"]), F.col("_place"))
    highest = [c for c in ("fee_numeric", "credibility") if c in columns]
    stories = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_best"),
                                        *[F.min(place).alias("_at_" + f) for f, place in places.items()],
                                        *[F.max(_number(F.col(f))).alias("_max_" + f) for f in highest])
    stories = settle(stories.filter("_rows > 1"), "merged-stories")
    givers = stories.select("_key", F.inline(F.filter(F.array(*[
        F.struct(F.lit(f).alias("_field"), order_at(F.pmod(F.col("_at_" + f), F.lit(Decimal(10 ** 35)).cast("decimal(38,0)"))).alias("_order"),
                 F.col("_at_" + f).isNotNull().alias("_given")) for f in places]), lambda x: x["_given"])))
    held = keyed.select(F.col(order).cast("long").alias("_order"), F.create_map(*[x for f in values for x in (F.lit(f), values[f].cast("string"))]).alias("_values"))
    found = (givers.join(held, "_order").groupBy("_key")
             .agg(F.map_from_entries(F.collect_list(F.struct("_field", F.element_at("_values", F.col("_field")).alias("_value")))).alias("_found")))
    best = stories.select("_key", "_rows", order_at(F.col("_best")).alias("_order"), *["_max_" + f for f in highest]).join(found, "_key", "left")
    merged = keyed.join(best, "_key", "left").filter(F.col("_rows").isNull() | (F.col("_order") == F.col(order).cast("long")))

    def result(c: str) -> Column:
        own = F.col(c)
        if c in filled:
            # a good value of the best row is kept as it is, untrimmed
            return F.when(~values[c].isin(placeholders[c]), own).otherwise(F.coalesce(F.element_at("_found", c), own))
        if c in highest:
            return F.when(_number(own) < F.col("_max_" + c), F.col("_max_" + c)).otherwise(own)
        if c == "status":
            return F.when(F.col("_rows").isNull(), own).otherwise(F.element_at("_found", "status"))
        if c == "image_url":
            return (F.when(image.startswith("http"), own)
                    .otherwise(F.coalesce(F.element_at("_found", "_image_http"), F.when(~image.isin(placeholders["image_url"]), own),
                                          F.element_at("_found", "_image_any"), own)))
        return own

    return merged.select(*[result(c).cast(types[c]).alias(c) for c in columns]).unionByName(rows.filter("_key IS NULL").select(*columns))
