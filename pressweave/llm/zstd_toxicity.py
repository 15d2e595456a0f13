"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on the
words and stems that set toxic text apart, those that recur in different surroundings
of toxic rows and hardly ever in ordinary ones.  Words that both sides use say nothing, and left
in they would fill the toxic dictionary.  A window is compressed once against the
ordinary dictionary and once against both; what the toxic one saves, in bytes, speaks
for toxicity.  A text's saving is summed over its windows, set against the square root
of their number, and turned into a probability on rows kept out of the training.
"""
from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressweave.llm.common import importable, settled
from pressweave.operators.dedup import first_per_group

WINDOW_WORDS = 6
PIECE_BYTES = 64
MOST_SAVED = 4
TOXIC_ROWS, ORDINARY_ROWS = 4_000, 12_000
CALIBRATION_SHARE = 4
SURROUNDINGS = 5
STEMS = (4, 6, 8)
CONTRAST = 20
UNITS, CANDIDATES = 4_000, 100_000
DOCS_PER_FRAME = 100
ORDINARY_WINDOWS = 40_000
ORDINARY_BYTES, TOXIC_BYTES = 112_640, 8_192
REPEATS = 50
THRESHOLD = 0.7
RIDGE = 1e-2
SEARCH = {"window_log": 18, "hash_log": 17, "chain_log": 18, "search_log": 7, "min_match": 5, "target_length": 64}


def words_of(text: str | None) -> list[bytes]:
    """Runs between white space in lower case and UTF-8; a longer one is cut into pieces of ``PIECE_BYTES``."""
    found = [w.encode("utf-8", "surrogatepass") for w in (text or "").lower().split()]
    if any(len(w) > PIECE_BYTES for w in found):
        found = [w[i:i + PIECE_BYTES] for w in found for i in range(0, len(w), PIECE_BYTES)]
    return found


def windows_of(text: str | None) -> list[bytes]:
    """The whole text in windows of ``WINDOW_WORDS`` words, with a blank at both ends."""
    words = words_of(text)
    return [b" " + b" ".join(words[i:i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def units_of(word: bytes) -> list[bytes]:
    """A word between blanks, and the blank with each of its stems."""
    return [b" " + word + b" ", *(b" " + word[:n] for n in STEMS if len(word) > n)]


def trained(samples: list[bytes], size: int, **how) -> bytes:
    """A zstandard dictionary of the samples, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    frame = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0,
                                                write_checksum=0, write_dict_id=0, **SEARCH)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=frame)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=frame)


@dataclass(frozen=True)
class Model:
    """The two dictionaries and the calibrated probability: 1 / (1 + exp(-(start + slope * saving))).

    The toxic dictionary stands before the ordinary one, so that what the ordinary one matches costs the same in both.
    """

    ordinary: bytes
    toxic: bytes
    start: float = 0.0
    slope: float = 1.0

    def compressors(self) -> tuple:
        """Made once per worker process."""
        kept = sys.modules[__name__].__dict__.setdefault("_compressors", {})
        key = (hash(self.ordinary), hash(self.toxic))
        if key not in kept:
            kept.clear()
            kept[key] = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        return kept[key]

    def saving(self, text: str | None) -> float:
        """Bytes that the toxic dictionary saves, at most ``MOST_SAVED`` a window, by the square root of the number of windows."""
        windows = windows_of(text) if self.toxic else []
        if not windows:
            return 0.0
        plain, both = self.compressors()
        saved = sum(min(MOST_SAVED, max(0, len(plain.compress(w)) - len(both.compress(w)))) for w in windows)
        return saved / len(windows) ** 0.5

    def probability(self, saving: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.start + self.slope * saving, -30, 30)))) if self.toxic else 0.0


def calibrated(model: Model, savings: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> Model:
    """A logistic fit of the label on the saving, with a ridge on the slope; each row weighs what it stands for."""
    x = np.column_stack([np.ones(len(savings)), savings])
    w, beta = weights / weights.sum() * len(weights), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (p - toxic)) + [0, RIDGE * beta[1]]
        step = np.linalg.solve((x.T * (w * np.maximum(p * (1 - p), 1e-9))) @ x + np.diag([1e-9, RIDGE]), gradient)
        beta -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.ordinary, model.toxic, float(beta[0]), max(float(beta[1]), 0.0))


def recurring(fit: DataFrame) -> list[tuple[bytes, int]]:
    """Units of toxic words with the number of their surroundings: those that recur, and that ordinary rows hardly have.

    A copy of a text adds nothing, as the surroundings are the same.  Most surroundings come first; at most ``UNITS``.
    """
    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), DOCS_PER_FRAME):
                rows = set()
                for text in batch["text"][start:start + DOCS_PER_FRAME]:
                    words = words_of(text)
                    for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
                        place = zlib.crc32(before + b" " + after)
                        rows.update((unit, place) for unit in units_of(word))
                yield pd.DataFrame(list(rows), columns=["unit", "place"])

    bad = fit.filter("toxic").select("text").mapInPandas(around, "unit binary, place long").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    bad = settled(bad, "toxic-units")
    total = bad.agg(F.sum("n")).first()[0] or 1
    likely = bad.filter(F.col("n") >= SURROUNDINGS).orderBy(F.desc("n"), "unit").limit(CANDIDATES).collect()
    shared = fit.sparkSession.sparkContext.broadcast({bytes(r.unit) for r in likely})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, found, everything = shared.value, Counter(), 0
        for batch in batches:
            for text in batch["text"]:
                units = [unit for word in words_of(text) for unit in units_of(word)]
                everything += len(units)
                found.update(unit for unit in units if unit in wanted)
        yield pd.DataFrame({"unit": [b"", *found], "n": [everything, *found.values()]})

    good = fit.filter(~F.col("toxic")).select("text").mapInPandas(met, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect()
    ordinary = {bytes(r.unit): r.n for r in good}
    rate = CONTRAST * total / max(1, ordinary.get(b"", 0))
    return [(bytes(r.unit), r.n) for r in likely if r.n >= rate * ordinary.get(bytes(r.unit), 0)][:UNITS]


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", toxic_column: str = "toxic",
          toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Fit on at most ``toxic_rows`` and ``ordinary_rows`` documents of the classes, chosen by a hash of the id.

    ``labels`` may name an id several times: one toxic label makes it toxic.  Null
    texts, ids and labels are left out, and of rows that repeat an id one is learnt from.  One row in
    ``CALIBRATION_SHARE`` is kept for the calibration.  Only ids meet the labels; the
    texts of the chosen ids are picked out of the documents in one scan.  Counting runs
    in Spark; the driver gets at most ``CANDIDATES`` words and stems,
    ``ORDINARY_WINDOWS`` windows and one number per calibration row.  Without rows of
    both classes nothing is learnt and every score is 0.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    known = labels.select(F.col(id_column).alias("id"), (F.col(toxic_column) > 0).alias("toxic")).filter("toxic IS NOT NULL")
    known = settled(known.groupBy("id").agg(F.max("toxic").alias("toxic")).join(rows.select("id"), "id", "left_semi"), "labelled")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(b"", b"")
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    most = F.when(F.col("toxic"), toxic_rows).otherwise(ordinary_rows)
    share = F.when(F.col("toxic"), 2.0 * toxic_rows / sizes[True]).otherwise(2.0 * ordinary_rows / sizes[False])
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("id", F.lit("sample")), "id")
    chosen = known.filter(place < share).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    chosen = settled(chosen.select("id", "toxic", (F.col("_n") % CALIBRATION_SHARE == 0).alias("spare")), "toxicity-ids")
    picked = rows.join(F.broadcast(chosen), "id")  # at most toxic_rows + ordinary_rows ids
    sample = settled(first_per_group(picked, ["id"], [F.xxhash64("text")]).repartition(F.xxhash64("text")), "toxicity-sample")
    fit = sample.filter(~F.col("spare"))

    said = [unit for unit, n in recurring(fit) for _ in range(min(n, REPEATS))]
    said = [said[i] for i in np.random.default_rng(1).permutation(len(said))]
    toxic = trained([b"".join(said[i:i + 8]) for i in range(0, len(said), 8)], TOXIC_BYTES, k=16, d=6) if said else b""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), DOCS_PER_FRAME):
                yield pd.DataFrame({"window": [w for text in batch["text"][start:start + DOCS_PER_FRAME] for w in windows_of(text)]}, dtype=object)

    windows = fit.filter(~F.col("toxic")).select("text").mapInPandas(cut, "window binary")
    n = windows.count()
    likely = windows.filter(F.pmod(F.xxhash64("window"), F.lit(1_000_000)) < 1_500_000.0 * ORDINARY_WINDOWS / max(n, 1))
    chosen = likely.distinct().orderBy(F.xxhash64("window"), "window").limit(ORDINARY_WINDOWS).collect()
    model = Model(trained([bytes(r.window) for r in chosen], ORDINARY_BYTES), toxic)

    spare = sample.filter("spare").select("toxic", saving(model, sample)(F.col("text")).alias("saving")).collect()
    if len({r.toxic for r in spare}) < 2:
        return model
    labels = np.array([r.toxic for r in spare], float)
    weights = np.where(labels > 0, sizes[True] / labels.sum(), sizes[False] / (1 - labels).sum())
    return calibrated(model, np.array([r.saving for r in spare]), labels, weights)


def saving(model: Model, df: DataFrame):
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([known.saving(t) for t in texts], dtype=float)

    return run


def score(docs: DataFrame, model: Model, text_column: str = "text", into: str = "score") -> DataFrame:
    """Adds ``into``: the probability, 0 to 1, that a text is toxic (a column of that name is replaced).

    The whole text is read and nothing else.  A text that is null, empty or without a
    word saves nothing and has the probability of such a text; where nothing could be
    learnt the score is 0.
    """
    importable(docs.sparkSession)
    saved = saving(model, docs)(F.col(text_column))
    shown: Column = F.lit(0.0)
    if model.toxic:
        shown = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(model.start) + F.lit(model.slope) * saved))))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != into]
    # a generator is a boundary for filters, which would otherwise compress twice
    return docs.select(*rest, shown.alias("_score")).select(*rest, F.explode(F.array("_score")).alias(into))
