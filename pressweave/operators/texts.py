"""Keywords, extractive summary, polarity, relevance, reviews and digests of articles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import all_tokens, collapse, contains_any, lit_array, strip, text_or_empty
from pressweave.functions.values import total


def word_counts(c: Column, stop_words=fv.STOP_WORDS) -> Column:
    """array<struct<count,word>> of the tokens, most frequent first, then by word.

    Row-local: the sorted tokens are one string, in which a repeated word is a
    run.  No token leaves the row, so nothing is shuffled.
    """
    ordered = F.array_join(F.sort_array(all_tokens(c)), " ")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?<![^ ])([^ ]+)(?: \1(?![^ ]))*+"), 0)
    counted = F.transform(runs, lambda r: F.struct(
        (-F.size(F.split(r, " "))).alias("n"), F.substring_index(r, " ", 1).alias("word")))
    stop = lit_array(stop_words)
    kept = F.filter(counted, lambda x: ~F.array_contains(stop, x["word"]))
    return F.transform(F.sort_array(kept), lambda x: F.struct((-x["n"]).alias("count"), x["word"].alias("word")))


def top_keywords(df: DataFrame, key: str, text: str, k: int = 5, stop_words=fv.STOP_WORDS) -> DataFrame:
    """(key, rank, word, count): the k most frequent words of each text."""
    best = F.slice(word_counts(F.col(text), stop_words), 1, k)
    return df.select(key, F.posexplode(best).alias("rank", "w")).select(
        key, (F.col("rank") + 1).alias("rank"), F.col("w.word").alias("word"), F.col("w.count").alias("count"))


def extract_summary(c: Column, sentences: int = 3, limit: int = 500) -> Column:
    """The first sentences of a text, at most ``limit`` characters."""
    text = strip(collapse(text_or_empty(c)))
    # a split mark is put after each sentence end, so the end stays with its sentence
    parts = F.split(F.regexp_replace(text, r"([.!?]) ", "$1\u0001"), "\u0001")
    return F.substring(F.array_join(F.slice(parts, 1, sentences), " "), 1, limit)


def polarity(c: Column, positive, negative) -> Column:
    """struct(positive_count, negative_count, polarity, sentiment) over the words of a text."""
    words = all_tokens(c)
    up = F.size(F.filter(words, lambda w: F.array_contains(lit_array(positive), w)))
    down = F.size(F.filter(words, lambda w: F.array_contains(lit_array(negative), w)))
    score = F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0)
    label = F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral")
    return F.struct(up.alias("positive_count"), down.alias("negative_count"), score.alias("polarity"), label.alias("sentiment"))


def relevance(title: Column, body: Column, query: str, title_weight: float = 2.0, body_weight: float = 0.5) -> Column:
    """Weighted hits of the query words in title and body."""
    t, b = F.lower(text_or_empty(title)), F.lower(text_or_empty(body))
    return total([
        F.when(contains_any(t, [w]), title_weight).otherwise(0.0) + F.when(contains_any(b, [w]), body_weight).otherwise(0.0)
        for w in query.lower().split()])


def review_averages(articles: DataFrame, reviews: DataFrame, key: str, rating: str = "rating") -> DataFrame:
    """Review count and mean rating per article; articles without reviews stay.

    Reviews are aggregated before the join, so a much-reviewed article is one row in it.
    """
    per_article = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("review_count"), F.avg(rating).alias("avg_rating"))
    return (articles.join(per_article, key, "left")
            .withColumn("review_count", F.coalesce("review_count", F.lit(0).cast("bigint")))
            .withColumn("avg_rating", F.coalesce("avg_rating", F.lit(0.0))))


def press_digest(articles: DataFrame) -> DataFrame:
    """Digest lines: the total, then the count of every category and every source, each as JSON.

    One scan; the lines roll up from the (category, source) sub-totals.
    """
    base = articles.groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"))
    sets = base.groupingSets([[], ["category"], ["source"]], "category", "source").agg(
        F.grouping_id().alias("g"), F.sum("n").alias("articles"))
    section = F.when(F.col("g") == 3, "total_articles").when(F.col("g") == 1, "category").otherwise("source")
    label = F.when(F.col("g") == 1, F.col("category")).when(F.col("g") == 2, F.col("source")).otherwise("")
    return sets.select(section.alias("section"), label.alias("label"), "articles").withColumn(
        "line", F.to_json(F.struct("section", "label", "articles")))
