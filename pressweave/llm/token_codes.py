"""Directly addressable codes for token ids.

An id is split into chunks of eight bits.  Level 0 holds the low chunk of every id
and a bitmap that says where an id goes on; level 1 holds the next chunk of those
ids alone, and so on.  A rank directory over each bitmap gives an id's place on the
next level, so any id, and any range of ids, is read without decoding what is before it.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressweave.llm.common import framed, importable, shuffle_partitions, whole
from pressweave.llm.tokens import encoder

MAGIC = b"PWDAC001"
RANK_BYTES = 64
FILE_IDS = 2_000_000
POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)
MANIFEST = "part long, seq long, path string, n_docs long, n_ids long, n_bytes long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def encode_codes(ids: np.ndarray, doc_ids: list, ends: list[int]) -> bytes:
    """A file: header, document directory, then chunks, bitmap and rank directory of each level."""
    rest = ids.astype(np.uint32)
    levels = []
    while True:
        chunks, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % RANK_BYTES, np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(POPCOUNT[bits].reshape(-1, RANK_BYTES).sum(axis=1))]).astype("<u8")
        levels.append((chunks, bits, ranks))
        rest = rest[more]
        if not len(rest):
            break
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    out = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)), names.tobytes(), padded(known.tobytes()),
           np.array(ends, "<u8").tobytes()]
    for chunks, bits, ranks in levels:
        last = len(levels) == 1 or chunks is levels[-1][0]
        out += [struct.pack("<Q", len(chunks)), padded(chunks.tobytes())]
        out += [] if last else [bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Codes:
    """Reads a file of codes: ``codes[i]`` is one id, ``codes.range(i, j)`` some, without decoding the others."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a file of codes")
        self.n_docs, self.n_ids, n_levels = struct.unpack_from("<QQQ", raw, 8)
        self.raw, self.at = raw, 32
        names = self.part("<i8", self.n_docs)
        known = self.part(np.uint8, self.n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known)]
        self.ends = self.part("<u8", self.n_docs).astype(np.int64)
        self.levels = []
        for level in range(n_levels):
            n = int(self.part("<u8", 1)[0])
            chunks, bits, ranks = self.part(np.uint8, n), None, None
            if level < n_levels - 1:
                n_bytes = -(-(-(-n // 8)) // RANK_BYTES) * RANK_BYTES
                bits, ranks = self.part(np.uint8, n_bytes), self.part("<u8", n_bytes // RANK_BYTES + 1)
            self.levels.append((chunks, bits, ranks))

    def part(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes + -out.nbytes % 8
        return out

    def rank(self, level: int, i: int) -> int:
        """Ids among the first i of this level that go on to the next."""
        _, bits, ranks = self.levels[level]
        block, byte = i // (8 * RANK_BYTES), i // 8
        n = int(ranks[block]) + int(POPCOUNT[bits[block * RANK_BYTES:byte]].sum())
        return n + (int(POPCOUNT[bits[byte] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if bits is None or not bits[i // 8] >> i % 8 & 1:
                break
            i = self.rank(level, i)
        return value

    def range(self, i: int, j: int) -> np.ndarray:
        return self.level_range(0, i, j)

    def level_range(self, level: int, i: int, j: int) -> np.ndarray:
        chunks, bits, _ = self.levels[level]
        out = chunks[i:j].astype("<u4")
        if bits is not None and j > i:
            goes_on = np.unpackbits(bits[i // 8:-(-j // 8)], bitorder="little")[i % 8:i % 8 + j - i].astype(bool)
            first = self.rank(level, i)
            out[goes_on] |= self.level_range(level + 1, first, first + int(goes_on.sum())) << 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_codes(docs: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
                end_id: int = 1, file_ids: int = FILE_IDS, partitions: int | None = None) -> DataFrame:
    """Write the ids of all documents below ``path``, in ascending id order over the files; returns the files' manifest.

    Documents are dealt by range of (id, text hash), so that an id that many rows
    repeat does not load one task.  Null ids come first, equal ids by text hash, a
    null text is empty (the end id alone), an empty table gives an empty manifest;
    other columns are not read.  Only files that the stored manifest lists count:
    a task that runs again writes new files, and those of a lost attempt are ignored.
    ``path`` is a folder that all executors share.
    """
    spark = docs.sparkSession
    importable(spark)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, context = encoder(tokenizer), TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        part, seq, names, ends, held, n = context.partitionId(), 0, [], [], [], 0

        def close() -> tuple:
            raw = encode_codes(np.frombuffer(b"".join(held), "<u4"), names, ends)
            target = f"{folder}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(target) as f:
                f.write(raw)
            return part, seq, target, len(names), n, len(raw)

        done = []
        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"]):
                ids = encode.ids(text or "") + end
                held.append(ids)
                n += len(ids) // 4
                names.append(whole(doc_id))
                ends.append(n)
                if n >= file_ids:
                    done.append(close())
                    seq, names, ends, held, n = seq + 1, [], [], [], 0
        if names:
            done.append(close())
        yield pd.DataFrame(done, columns=[f.split()[0] for f in MANIFEST.split(", ")])

    fs_, folder_ = fs.FileSystem.from_uri(path)
    fs_.create_dir(folder_, recursive=True)
    order = ["id", F.xxhash64("text")]
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    files = (rows.repartitionByRange(partitions or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
             .select(F.col("id").cast("string"), "text").mapInPandas(run, MANIFEST))
    files.write.parquet(f"{path}/manifest")
    return read_manifest(docs.sparkSession, path)


def read_manifest(spark, path: str) -> DataFrame:
    """The files in order, with ``first``: the ids in all files before.

    Totals per part (as many as the write had tasks) are added up in one window;
    inside a part the window is over that part's files.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_part")).select(
        "part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("before_part"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (files.withColumn("before_file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
            .withColumn("first", F.col("before_part") + F.col("before_file")).drop("before_part", "before_file"))


def read_codes(manifest: DataFrame, path: str, with_ids: bool = True, docs_per_batch: int = 2000) -> DataFrame:
    """One row per document of the files: id, first position over all files, number of ids, their CRC-32, and the ids."""
    importable(manifest.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for target, first in zip(batch["path"], batch["first"]):
                with store.open_input_file(target) as f:
                    codes = Codes(f.read())
                rows, start = [], int(first)
                for k in range(codes.n_docs):
                    ids = codes.document(k)
                    rows.append((codes.doc_ids[k], start, len(ids), zlib.crc32(ids.tobytes()), ids.astype("i4") if with_ids else None))
                    start += len(ids)
                    if len(rows) >= docs_per_batch or k == codes.n_docs - 1:
                        yield framed(rows, [f.split()[0] for f in DOCS.split(", ")], "doc_id")
                        rows = []

    spread = manifest.select("path", "first").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return spread.mapInPandas(run, DOCS)
