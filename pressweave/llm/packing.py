"""Hierarchical packing of documents into context windows of several lengths.

One pass over the table's own partitions, nothing is shuffled.  A document's full
long windows stand alone; what is left of it is routed to the smallest tier that
holds it.  A window of a long tier is closed by filling its gap from shorter tiers
and, where no shorter piece fits, by cutting one.  Windows of one tier are dealt to
step groups of equal token counts.
"""
from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave.llm.common import framed, importable, whole
from pressweave.llm.tokens import LEARNT_BYTES, encoder

TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 8192
POOL_TOKENS = 1 << 19
FRAME_ROWS, FRAME_TOKENS = 4_096, 1 << 18
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, tier int, step_group long, ids array<int>")
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]


class Packer:
    """Packs the pieces of one task; holds at most ``POOL_TOKENS`` tokens and one document."""

    def __init__(self, task: int, tiers=TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = True):
        self.tiers, self.step, self.with_ids = sorted(tiers), step_tokens, with_ids
        self.pools = {t: deque() for t in self.tiers}
        self.held, self.next_id, self.high = 0, 0, task << 33
        self.steps: dict[int, list[int]] = {}
        self.next_step = 0
        self.rows: list[tuple] = []
        self.pending = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        """A document of at least one token."""
        long, total = self.tiers[-1], len(ids)
        whole = total - total % long
        for start in range(0, whole, long):
            self.emit([(doc_id, start, ids[start:start + long], total)])
        if whole < total:
            self.route((doc_id, whole, ids[whole:].copy(), total))
        if self.held > POOL_TOKENS:
            self.close()

    def route(self, piece: tuple) -> None:
        n = len(piece[2])
        tier = next(t for t in self.tiers if t >= n)
        if n == tier:
            self.emit([piece])
        else:
            self.pools[tier].append(piece)
            self.held += n

    def take(self, room: int) -> tuple | None:
        """A piece of a tier that surely fits, else a cut of any piece of the shortest tier there is."""
        tier = next((t for t in reversed(self.tiers) if t <= room and self.pools[t]), None)
        tier = tier or next((t for t in self.tiers if self.pools[t]), None)
        if tier is None:
            return None
        doc_id, start, ids, total = self.pools[tier].popleft()
        self.held -= len(ids)
        if len(ids) > room:
            self.route((doc_id, start + room, ids[room:], total))
        return doc_id, start, ids[:room], total

    def close(self) -> None:
        """Fill windows, longest tier first, until no piece is left."""
        for window in reversed(self.tiers):
            while self.pools[window]:
                self.fill(window)

    def fill(self, window: int) -> None:
        piece = self.pools[window].popleft()
        self.held -= len(piece[2])
        content, room = [piece], window - len(piece[2])
        while room and (more := self.take(room)):
            content.append(more)
            room -= len(more[2])
        if not room:
            self.emit(content)
            return
        # The last pieces of the task: cut into lengths that are powers of two, which need no padding.
        rest = window - room
        for bit in reversed(range(window.bit_length())):
            size, part = rest & (1 << bit), []
            while size:
                doc_id, start, ids, total = content.pop(0)
                part.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    content.insert(0, (doc_id, start + size, ids[size:], total))
                size -= len(part[-1][2])
            if part:
                self.emit(part)

    def emit(self, content: list[tuple]) -> None:
        length = sum(len(p[2]) for p in content)
        tier = next(t for t in self.tiers if t >= length)
        group = self.steps.setdefault(tier, [-1, self.step])
        if group[1] + length > self.step:
            group[:] = [self.high + self.next_step, 0]
            self.next_step += 1
        group[1] += length
        offset = 0
        for doc_id, start, ids, total in content:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.high + self.next_id, offset,
                              length, tier, group[0], ids.astype("i4") if self.with_ids else None))
            offset += len(ids)
        self.next_id += 1
        self.pending += length

    def frame(self) -> pd.DataFrame:
        rows, self.rows, self.pending = self.rows, [], 0
        return framed(rows, COLUMNS, "doc_id")


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0,
         tiers=TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = True, learnt_bytes: int = LEARNT_BYTES) -> DataFrame:
    """One row per piece of a document in a sequence, with the piece's ids.

    ``tiers`` are powers of two.  A null text is empty: its document is the end id
    alone.  A worker keeps the ids of frequent words in tables of twice ``learnt_bytes``.
    A null id is kept as null; repeated rows are packed each by itself; an
    empty table gives no rows; other columns are not read.  Sequence and step ids
    are made of the task's number, so reading the same files gives the same ids;
    ``docs`` should be a stored table, as a task that runs again must see the same rows.
    """
    importable(docs.sparkSession)
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, learnt_bytes)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens, with_ids)
        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"]):
                ids = np.frombuffer(encode.ids(text or "") + end, "<u4")
                packer.add(whole(doc_id), ids)
                if len(packer.rows) >= FRAME_ROWS or packer.pending >= FRAME_TOKENS:
                    yield packer.frame()
        packer.close()
        yield packer.frame()

    text: Column = F.col(text_column)
    return docs.select(F.col(id_column).cast("long").cast("string").alias("id"), text.alias("text")).mapInPandas(run, SCHEMA)
