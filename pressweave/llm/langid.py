"""Language identification by error-correcting output codes.

Every language has a codeword.  For each bit of the code a binary classifier over
character n-grams says how much a text speaks for a one; decoding adds up, for each
language, the losses of its bits, weighted by how well each bit's classifier tells
its two sides apart, and takes the nearest codeword.  A text whose two nearest codewords lie
close together is flagged as ambiguous.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressweave.llm.common import importable

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 2_000
SMOOTHING = 0.5
SHARPNESS = 4.0
AMBIGUOUS = 0.02
UNDETERMINED = "und"
MOST_EXHAUSTIVE = 5
DECISION = "lang_pred string, score double, ambiguous boolean, runner_up string"
NAMES = tuple(field.split()[0] for field in DECISION.split(", "))


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """An n x bits matrix of +1 and -1.

    Up to five languages have the exhaustive code (every way to split them in two);
    more have a seeded random code of 10 log2 n bits, the best of 64 by the least
    distance between two rows.
    """
    if n == 1:
        return np.ones((1, 1))
    if n <= MOST_EXHAUSTIVE:
        return np.array([[1.0] * (2 ** (n - 1) - 1)] + [[1.0 if split >> i & 1 else -1.0 for split in range(2 ** (n - 1) - 1)]
                                                        for i in range(n - 1)])
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    codes = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(64)]
    codes = [c for c in codes if (abs(c.sum(axis=0)) < n).all()] or codes
    return max(codes, key=lambda c: min((c[i] != c[j]).sum() for i, j in combinations(range(n), 2)))


def letters() -> np.ndarray:
    """For every code point whether it is a letter; worked out once per process."""
    kept = sys.modules[__name__].__dict__
    if "_letters" not in kept:
        kept["_letters"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return kept["_letters"]


def grams(text: str, buckets: int = BUCKETS, orders=ORDERS) -> np.ndarray:
    """Hashed letter n-grams of a whole text: lower case, every run of other characters one blank; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    points = np.where(is_letter, points, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint64)
    out = []
    for n in orders:
        if len(points) >= n:
            h = np.zeros(len(points) - n + 1, np.uint64)
            for k in range(n):
                h = (h + points[k:k + len(h)] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((h >> np.uint64(40)) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    """Languages, their codewords, a weight of every n-gram for every bit, and how far each bit is to be trusted."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    scale: np.ndarray

    def margins(self, found: np.ndarray) -> np.ndarray:
        return self.weights[found].mean(axis=0, dtype=np.float64) * self.scale

    def decide(self, text: str | None) -> tuple[str, float, bool, str | None]:
        found = grams(text) if text else ()
        if not len(found) or not self.languages:
            return UNDETERMINED, 0.0, False, None
        losses = np.logaddexp(0, -self.codes * self.margins(found)) @ self.trust
        order = np.argsort(losses, kind="stable")
        odds = np.exp(losses[order[0]] - losses)
        score = float(odds[order[0]] / odds.sum())
        if len(order) == 1:
            return self.languages[0], score, False, None
        gap = losses[order[1]] - losses[order[0]]
        return self.languages[order[0]], score, bool(gap < AMBIGUOUS * self.trust.sum()), self.languages[order[1]]


def fit(counts: dict[str, np.ndarray]) -> Model:
    """The model of n-gram counts per language.

    A bit's classifier is the log odds of an n-gram between the languages with a
    one and those without, each language weighing the same.  Its scale brings the
    mean margin of a whole language to about ``SHARPNESS``, and its trust is the
    lesser of the mean margins of the two sides.
    """
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    codes = codewords(len(languages))
    shares = np.array([(counts[name] + SMOOTHING) / (counts[name] + SMOOTHING).sum() for name in languages])
    ones, zeros = codes > 0, codes < 0

    def side(mask: np.ndarray) -> np.ndarray:
        return (mask.T @ shares) / np.maximum(mask.sum(axis=0), 1)[:, None]

    weights = (np.log(np.where(ones.any(axis=0)[:, None], side(ones), 1.0))
               - np.log(np.where(zeros.any(axis=0)[:, None], side(zeros), shares.mean(axis=0)))).T
    if len(languages) == 1:
        weights = np.ones_like(weights)
    means = codes * (shares @ weights)
    least = np.maximum(means.min(axis=0), 1e-3)
    return Model(languages, codes, weights.astype(np.float32), least / least.sum() * codes.shape[1], SHARPNESS / np.maximum(means.mean(axis=0), 1e-3))


def train(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows per language, chosen by a hash of the id; counting runs in Spark.

    Rows with null text or language are left out.  What reaches the driver is one
    number per language and n-gram bucket.
    """
    importable(labelled.sparkSession)
    rows = labelled.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit({})
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, 2 * sample_rows / n)]), F.col("lang"))
    likely = rows.filter(place < share)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit("sample")), "id")
    sample = likely.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= sample_rows).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    spread = sample.repartition(F.col("lang"), F.xxhash64("text"))
    counts: dict[str, np.ndarray] = {}
    for r in spread.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r.lang, np.zeros(BUCKETS))[r.bucket] = r.n
    return fit(counts)


def identify(docs: DataFrame, model: Model, text_column: str = "text", names: tuple[str, ...] = NAMES) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1), ``ambiguous`` and ``runner_up`` under ``names`` (columns of these names are replaced).

    The whole text is read and nothing else.  A text that is null, empty or
    without a letter, and every text where nothing could be learnt, is ``und`` with score 0.
    """
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DECISION)
    def decide(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        return pd.DataFrame([known.decide(t) for t in texts], columns=list(NAMES))

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    decided = docs.select(*rest, decide(F.col(text_column)).alias("_decision"))
    named = F.struct(*[F.col("_decision")[own].alias(name) for own, name in zip(NAMES, names)])
    # a generator is a boundary for filters, which would otherwise run the decision twice
    return decided.select(*rest, F.inline(F.array(named)))


def held_out(id_column: str | Column = "doc_id") -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text, modulo 3, is 1; false for a null id."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))
