"""Ranked lexical search by the Best Position Algorithm.

A block of documents has one list per query term: its documents by falling impact,
the term's part of their scores.  A search reads the lists of its terms from the top.
Every document that comes up is looked up in all of them (direct access), which gives
its whole score and marks its positions there as seen.  A list's best position is the
end of the run of seen positions from its top, which is never before the last position
read: what has not come up yet scores at most the sum of the impacts at the best
positions, and the search stops once that is strictly below the k-th score.

Blocks are runs of rows of the stored term counts, so no document moves; each sends
the k best of every item.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressweave.llm.common import importable, settled
from pressweave.operators.dedup import first_per_group

# Fixed value: bytes of letters, digits and every character beyond ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
K1_SCALE, TF_SCALE, LENGTH_SHARE = 20, 1_000_000_000, 50
ITEM_BYTES = 4 << 20
BLOCK_POSTINGS = 1_000_000
FIRST_READ = 32
ROWS, LENGTH = -1, -2


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in UTF-8; only A-Z are lower-cased."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, places, counts) of every document with a term: its number of terms, and how often it has each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            kept, n, places, counts = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                found = terms(text.as_py())
                if found:
                    hits = [(known[t], c) for t, c in Counter(found).items() if t in known]
                    kept.append(row)
                    n.append(len(found))
                    places.append(np.array([p for p, _ in hits], "<i4").tobytes())
                    counts.append(np.array([c for _, c in hits], "<i4").tobytes())
            ids = batch.column("doc_id").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())],
                                             ["doc_id", "n", "places", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, places binary, counts binary")


def statistics(counted: DataFrame, words: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each word; at most ``words`` + 2 numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, length = np.zeros(words, np.int64), 0, 0
        for batch in batches:
            rows += batch.num_rows
            length += sum(n.as_py() for n in batch.column("n"))
            for places in batch.column("places"):
                held[np.frombuffer(places.as_py(), "<i4")] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [ROWS, LENGTH]]), pa.int64()),
                                          pa.array(np.concatenate([held[at], [rows, length]]), pa.int64())], ["place", "n"])

    sums = counted.select("n", "places").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found, held = {r.place: r.n for r in sums}, np.zeros(words, np.int64)
    for place, n in found.items():
        if place >= 0:
            held[place] = n
    return found.get(ROWS, 0), found.get(LENGTH, 0), held


@dataclass
class ImpactList:
    """Documents of one term by falling impact, and the place that each has in this order, by document."""

    docs: np.ndarray
    impacts: np.ndarray
    by_doc: np.ndarray
    position: np.ndarray

    def find(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access: which of these documents are in the list, and where."""
        at = np.minimum(np.searchsorted(self.by_doc, docs), len(self.by_doc) - 1)
        hit = self.by_doc[at] == docs
        return hit, self.position[at[hit]]


def impact_lists(n: np.ndarray, places: list[bytes], counts: list[bytes], documents: int, length: int, weights: np.ndarray) -> dict[int, ImpactList]:
    """The lists of a block by the term's place; documents are numbered in the order given, which breaks ties."""
    size = np.array([len(p) // 4 for p in places], np.int64)
    term, tf = np.frombuffer(b"".join(places), "<i4").astype(np.int64), np.frombuffer(b"".join(counts), "<i4").astype(np.int64)
    doc = np.repeat(np.arange(len(n)), size)
    norm = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(x) * documents // length for x in n], np.int64)
    impact = weights[term] * (TF_SCALE * tf // (1000 * tf + K1_SCALE * norm[doc]))
    useful = impact > 0
    doc, term, impact = doc[useful], term[useful], impact[useful]
    by_doc = np.argsort(term, kind="stable")
    doc, term, impact = doc[by_doc], term[by_doc], impact[by_doc]
    falling = np.lexsort((-impact, term))
    position = np.empty(len(falling), np.int64)
    names, first, sizes = np.unique(term, return_index=True, return_counts=True)
    position[falling] = np.arange(len(falling)) - np.repeat(first, sizes)
    return {int(name): ImpactList(doc[falling[f:f + s]], impact[falling[f:f + s]], doc[f:f + s], position[f:f + s])
            for name, f, s in zip(names, first, sizes)}


def best_positions(lists: list[ImpactList], documents: int, k: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, positions read) of the k best of a block: highest score, then smallest number.

    Reads run deeper by doubling steps.  A list that is seen to its end adds nothing
    to the threshold: all its documents have come up.
    """
    seen, marks = np.zeros(documents, bool), [np.zeros(len(x.docs), bool) for x in lists]
    best, depth, step = [0] * len(lists), 0, first_read
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    longest = max((len(x.docs) for x in lists), default=0)
    while depth < longest:
        new = np.unique(np.concatenate([x.docs[depth:depth + step] for x in lists]))
        new = new[~seen[new]]
        seen[new] = True
        score = np.zeros(len(new), np.int64)
        for one, mark in zip(lists, marks):
            hit, position = one.find(new)
            score[hit] += one.impacts[position]
            mark[position] = True
        docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        depth, step, threshold = depth + step, step * 2, 0
        for i, (one, mark) in enumerate(zip(lists, marks)):
            rest = mark[best[i]:]
            best[i] = best[i] + int(rest.argmin()) if not rest.all() else len(mark)
            threshold += int(one.impacts[best[i] - 1]) if best[i] < len(mark) else 0
        if len(docs) == k and threshold < scores[-1]:
            break
    return docs, scores, depth


def rank_documents(docs: DataFrame, items: DataFrame, k: int, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", item_bytes: int = ITEM_BYTES, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item, ties to the smaller id.

    A null or empty text has no terms: such a document does not count and is never
    found, and such an item has no rows.  Rows that repeat a document's id rank each
    by themselves; a null id comes last among ties.  Items with equal id and text
    count once; of those with one id and different texts each has its own ranks, also
    where the id is null.  Empty tables give no rows; other columns are not read.

    Items are taken in turns of about ``item_bytes`` of text, dealt by hash, and only a
    turn's terms are broadcast; every turn reads the documents once.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    turns = max(1, math.ceil(total / item_bytes))
    results = []
    for turn in range(turns):
        batch = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == turn).collect()
        results.append(turn_of(rows, batch, k, block_postings).withColumn("_turn", F.lit(turn)))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    best = first_per_group(out, ["_turn", "item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank")
    return best.select("item_id", "rank", "doc_id", "score")


def turn_of(rows: DataFrame, batch: list, k: int, block_postings: int) -> DataFrame:
    """(item, item_id, doc_id, score): the k best of every block of documents for each item of the batch."""
    spark = rows.sparkSession
    wanted = [sorted(set(terms(r.text))) for r in batch]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    counted = settled(term_counts(rows, vocabulary), "term-counts")
    documents, length, held = statistics(counted, len(vocabulary))
    weights = np.array([weight(documents, int(n)) for n in held], np.int64)
    shared = spark.sparkContext.broadcast(([r.item_id for r in batch], [[vocabulary[t] for t in found] for found in wanted], weights))

    def search(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        names, asked, weigh = shared.value
        block = pa.Table.from_batches(parts).sort_by("doc_id").combine_chunks()
        ids = block.column("doc_id").combine_chunks()
        lists = impact_lists(block.column("n").to_numpy(), block.column("places").to_pylist(), block.column("counts").to_pylist(), documents, length, weigh)
        items, found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for item, places in enumerate(asked):
            docs, score, _ = best_positions([lists[p] for p in places if p in lists], len(ids), k)
            items.append(np.full(len(docs), item))
            found.append(docs)
            scores.append(score)
        item = np.concatenate(items)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(names, pa.int64()).take(pa.array(item, pa.int64())),
                                           ids.take(pa.array(np.concatenate(found), pa.int64())), pa.array(np.concatenate(scores), pa.int64())],
                                          ["item", "item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in batches:
            parts.append(part)
            held += sum(map(len, part.column("places").to_pylist())) // 4
            if held >= block_postings:
                yield search(parts)
                parts, held = [], 0
        if parts:
            yield search(parts)

    return counted.mapInArrow(run, "item long, item_id long, doc_id long, score long")
