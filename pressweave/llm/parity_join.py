"""N-gram Jaccard join by parity sketches.

A document is its set of word n-grams.  A sketch XORs the n-grams' hashes, so what
two sets share cancels out and only their symmetric difference D is left.

* The bit sketch toggles one bit per n-gram: the Hamming distance of two bit
  sketches is at most |D|.
* The block sketch deals the n-grams to P blocks and XORs whole hashes per block: at
  most |D| blocks differ.  A link at similarity t allows |D| <= (1-t)/(1+t) (a+b), so with
  more blocks than that, at least one is equal (pigeonhole).  P is set per size band.

Sets that are equal in a block form a class, whose smallest set is its center; all
classes of one center are one group, so that every candidate pair meets in a group.
The bit sketch rules out most wrong pairs, and the rest are verified on the n-grams
themselves, inside the group: what leaves a group is a forest of links, never its pairs.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave.llm.common import framed, importable, settled, shuffle_partitions, whole
from pressweave.llm.components import connected_components
from pressweave.operators.dedup import first_per_group

WORDS, PERCENT = 5, 80
GROWTH = 1.4
SKETCH_BITS = 256
DOCS_PER_BUCKET = 8_000
BUCKET_PAIRS = 4_000_000
KEYS_PER_BATCH = 1_000_000
TILE_ROWS = 4_096
TILE_GRAMS = 1 << 20
CELLS = 1 << 20
U = np.uint64
SIGNS = "doc_id long, row long, n_shingles long, set_id long, sketch array<long>, bucket long, pairs binary"
PAIR = [("key", "<u4"), ("set", "<i8")]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit given."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BYTES[65:91] = BYTES[97:123]
STEP = U(0xD6E8FEB86659FD93)


def powers(n: int) -> np.ndarray:
    out = np.full(n, STEP)
    out[:1] = 1
    return np.multiply.accumulate(out)


SHORT_POWERS = powers(4096)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each run of bytes other than space and 09-0D, with A-Z read as a-z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    is_word = ~WHITE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).view(np.int8)))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.empty(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    weight = SHORT_POWERS if longest <= len(SHORT_POWERS) else powers(longest)
    return mixed(np.add.reduceat(BYTES[raw[is_word]] * weight[place], starts) + lengths.astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct n-gram hashes of a whole text; a text with fewer words is one n-gram, one without words none."""
    found = word_hashes(text) if text else np.empty(0, np.uint64)
    n = min(words, len(found))
    if not n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(found) - n + 1, np.uint64)
    for k in range(n):
        total = (total + found[k:k + len(total)]) * STEP
    return np.unique(mixed(total + U(n)))


def set_name(found: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets, and no others but by chance, have the same."""
    return int(mixed(np.array([mixed(found ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + U(len(found))], np.uint64))[0].astype(np.int64))


def bit_sketch(found: np.ndarray, least: int = SKETCH_BITS) -> np.ndarray:
    """One bit per n-gram, in as many bits as the next power of two; the halves of a longer sketch XOR to the shorter one."""
    bits = max(least, 1 << (len(found) - 1).bit_length())
    at = (mixed(found + U(0x1234567)) % U(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").view("<i8")


def folded(sketch: np.ndarray, length: int) -> np.ndarray:
    while len(sketch) > length:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


class Bands:
    """Size bands: band j holds pairs whose smaller set has g^j to g^(j+1) n-grams."""

    def __init__(self, percent: int = PERCENT, growth: float = GROWTH):
        self.t, self.growth = percent / 100, growth
        if percent <= 50 or growth * self.t < 1:
            raise ValueError("links need more than half of the n-grams, and bands must grow by more than 1 / similarity")
        self.plans: dict[int, tuple[int, int]] = {}

    def plan(self, band: int) -> tuple[int, int]:
        """(most differing blocks, blocks); no blocks if only equal sets can link."""
        if band not in self.plans:
            top = self.growth ** (band + 1)
            most = math.floor((1 - self.t) / (1 + self.t) * (top + top / self.t) + 1e-9)
            empty = (most + 1) * math.exp(-(self.growth ** band) / (most + 1))
            blocks = most + 1 + math.ceil(empty + 3 * math.sqrt(empty))  # room for blocks that stay empty, which are no keys
            self.plans[band] = (most, blocks if most else 0)
        return self.plans[band]

    def of(self, n: int) -> list[int]:
        """The bands that a set of n belongs to, as the smaller or the larger of a pair."""
        band = math.floor(math.log(n) / math.log(self.growth) + 1e-12)
        low = max(0, band - 2)
        return [j for j in range(low, band + 2) if self.growth ** j <= n * (1 + 1e-12) and n * (1 - 1e-12) <= self.growth ** (j + 1) / self.t]

    def keys(self, found: np.ndarray) -> np.ndarray:
        """One key for each block of each band that is not empty; the empty ones too if there are too many of them."""
        out = []
        for band in self.of(len(found)):
            most, blocks = self.plan(band)
            if not blocks:
                continue
            h = mixed(found + U((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            block = ((h >> U(32)) * U(blocks)) >> U(32)
            order = np.argsort(block, kind="stable")
            names, first = np.unique(block[order], return_index=True)
            sums = np.bitwise_xor.reduceat(mixed(found + U(0xABCDEF))[order], first)
            if blocks - len(names) >= blocks - most:
                names = np.concatenate([names, np.setdiff1d(np.arange(blocks, dtype=np.uint64), names)])
                sums = np.concatenate([sums, np.zeros(len(names) - len(sums), np.uint64)])
            out.append(mixed(sums + mixed(names + U(band << 32))))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def row_name(id_column: str, text_column: str) -> Column:
    """A 64-bit name of a row's id and text."""
    return F.xxhash64(F.col(id_column).cast("long"), F.col(text_column))


def sign(docs: DataFrame, buckets: int, words: int, percent: int) -> DataFrame:
    """Of (doc_id, row, text): a row with the set's name, size and sketch for every document, and rows (bucket, pairs).

    ``pairs`` are the (key, set) pairs of many documents, packed; a task sends each set's once.
    """
    names = [f.split()[0] for f in SIGNS.split(", ")]
    numbers = ("doc_id", "row", "n_shingles", "set_id", "bucket")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, seen, keys, sets, held = Bands(percent), set(), [], [], 0

        def packed() -> pd.DataFrame:
            key = np.concatenate(keys)
            pairs = np.empty(len(key), PAIR)
            pairs["key"], pairs["set"] = key & U(0xFFFFFFFF), np.repeat([s for s, _ in sets], [n for _, n in sets])
            bucket = (((key >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            parts = np.split(pairs[order], first[1:])
            return framed([(None, None, None, None, None, int(b), p.tobytes()) for b, p in zip(found, parts)], names, *numbers)

        for batch in batches:
            rows = []
            for doc_id, row, text in zip(batch["doc_id"], batch["row"], batch["text"]):
                found = shingles(text, words)
                name = set_name(found) if len(found) else None
                rows.append((whole(doc_id), row, len(found), name, bit_sketch(found) if len(found) else None, None, None))
                if name is not None and name not in seen:
                    seen.add(name)
                    new = bands.keys(found)
                    if len(new):
                        keys.append(new)
                        sets.append((name, len(new)))
                        held += len(new)
                if held >= KEYS_PER_BATCH:
                    yield packed()
                    keys, sets, held = [], [], 0
            yield framed(rows, names, *numbers)
        if held:
            yield packed()

    return docs.select(F.col("doc_id").cast("string"), "row", "text").mapInPandas(run, SIGNS)


def unpacked(rows: pd.DataFrame) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(rows["pairs"]), PAIR))


def stars(packs: DataFrame, bucket_pairs: int | None = None) -> DataFrame:
    """(x, center): every set with the smallest set of each of its classes, once each; ``packs`` has bucket and pairs, stored.

    A bucket is one group.  One that holds more than ``bucket_pairs`` pairs, because a
    class is very large, is cut into rows, so that Spark combines and splits the class.
    """
    held = packs.groupBy("bucket").agg((F.sum(F.octet_length("pairs")) / 12).alias("_held"))
    sized = packs.join(held, "bucket")
    small, large = (sized.filter(test).drop("_held") for test in (F.col("_held") <= (bucket_pairs or BUCKET_PAIRS), F.col("_held") > (bucket_pairs or BUCKET_PAIRS)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = unpacked(rows)
        same = pairs["key"][1:] == pairs["key"][:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(np.concatenate([first, [len(pairs)]]))
        first, size = first[size > 1], size[size > 1]
        starts = np.repeat(first, size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        x, center = pairs["set"][starts + within][within > 0], pairs["set"][starts][within > 0]
        return pd.DataFrame({"x": x, "center": center}).drop_duplicates()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, packed in zip(batch["bucket"], batch["pairs"]):
                pairs = np.frombuffer(packed, PAIR)
                yield pd.DataFrame({"key": bucket << 32 | pairs["key"].astype(np.int64), "x": pairs["set"]})

    out = small.groupBy("bucket").applyInPandas(lambda rows: run(rows), "x long, center long")
    rows = large.mapInPandas(cut, "key long, x long")
    centers = rows.groupBy("key").agg(F.min("x").alias("center"), F.max("x").alias("_last")).filter("center <> _last").drop("_last")
    return out.unionByName(rows.join(centers, "key").filter("x <> center").select("x", "center")).distinct()


def most_difference(a, b, percent: int = PERCENT):
    """The largest symmetric difference that sets of these sizes may have."""
    return (100 - percent) * (a + b) / (100 + percent)


def allowed_pairs(n: np.ndarray, sketches: list[np.ndarray], labels: np.ndarray, mine: np.ndarray, others: np.ndarray,
                  percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of places in ``mine`` and ``others`` with different labels that sizes and sketches allow to link.

    Each pair comes once, and at most ``CELLS`` are looked at together.  Sizes that may
    link are within a factor of two, and so are the sketches' lengths.
    """
    lengths = np.array([len(s) for s in sketches])
    for la in np.unique(lengths[mine]):
        for lb in (la // 2, la, 2 * la):
            one, two = mine[lengths[mine] == la], others[lengths[others] == lb]
            if not len(one) or not len(two):
                continue
            shared = min(la, lb)
            left, right = (np.stack([folded(sketches[i], shared) for i in part]).view(np.uint64) for part in (one, two))
            step = max(1, CELLS // len(two))
            for start in range(0, len(one), step):
                own = one[start:start + step]
                ok = np.minimum(n[own, None], n[None, two]) * 100 >= np.maximum(n[own, None], n[None, two]) * percent
                ok &= labels[own, None] != labels[None, two]
                if mine is others:
                    ok &= own[:, None] < two[None]
                a, b = np.nonzero(ok)
                far = np.zeros(len(a), np.int64)
                for w in range(shared):
                    far += np.bitwise_count(left[start + a, w] ^ right[b, w])
                    if w % 4 == 3 or w == shared - 1:
                        near = far * (100 + percent) <= (100 - percent) * (n[own[a]] + n[two[b]])
                        a, b, far = a[near], b[near], far[near]
                yield own[a], two[b], far


def sides(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the rows to be compared: for each center of a group those of side 0 with those of side 1, or all with all."""
    center, side = rows["center"].to_numpy(), rows["side"].to_numpy()
    order = np.argsort(center, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(center[order])) + 1):
        if len(places) and side[places[0]] == 2:
            yield places, places
        elif len(places):
            yield places[side[places] == 0], places[side[places] == 1]


def with_partner(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of a group's rows (center, set_id, label, n, sketch, side), the (center, set_id) that have a pair to be verified."""
    n, labels, sketches = rows["n"].to_numpy(), rows["label"].to_numpy(), list(rows["sketch"])
    marked = np.zeros(len(rows), bool)
    for mine, others in sides(rows):
        for i, j, _ in allowed_pairs(n, sketches, labels, mine, others, percent):
            marked[i] = marked[j] = True
    return rows.loc[marked, ["center", "set_id"]].drop_duplicates()


def linked(g: np.ndarray, h: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted n-gram hashes link."""
    g, h = (g, h) if len(g) <= len(h) else (h, g)
    both = int((h[np.minimum(np.searchsorted(h, g), len(h) - 1)] == g).sum())
    return 100 * both >= percent * (len(g) + len(h) - both)


class Forest:
    """Labels joined by links; ``roots`` follows many at once."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def roots(self, labels: np.ndarray) -> np.ndarray:
        found = self.up[labels]
        while (self.up[found] != found).any():
            found = self.up[found]
        return found

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.roots(np.array([a]))[0]), int(self.roots(np.array([b]))[0])
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of a group's rows (center, set_id, label, grams, side), a forest of links between labels.

    For every pair of components the nearest pairs of sets are verified first, and twice
    as many in each turn; as soon as one links, the others need no test.  A pair that
    could join two components is never left out.
    """
    grams = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
    n, sketches, names = np.array([len(g) for g in grams]), [bit_sketch(g) for g in grams], rows["set_id"].to_numpy()
    labels, codes = rows["label"].to_numpy(), pd.factorize(rows["label"])[0]
    out = []
    for mine, others in sides(rows):
        forest = Forest(codes.max() + 1 if len(codes) else 0)
        for i, j, far in allowed_pairs(n, sketches, labels, mine, others, percent):
            order = np.argsort(far, kind="stable")
            i, j, turn = i[order], j[order], 1
            while len(i):
                a, b = forest.roots(codes[i]), forest.roots(codes[j])
                i, j, a, b = i[a != b], j[a != b], a[a != b], b[a != b]
                pair = np.minimum(a, b) * len(codes) + np.maximum(a, b)
                order = np.argsort(pair, kind="stable")  # nearest first within a pair of components
                i, j, pair = i[order], j[order], pair[order]
                test = np.arange(len(pair)) - np.searchsorted(pair, pair) < turn
                for x, y in zip(i[test], j[test]):
                    if forest.up[codes[x]] != forest.up[codes[y]] and linked(grams[x], grams[y], percent) and forest.join(codes[x], codes[y]):
                        out.append((names[x], names[y]))
                i, j, turn = i[~test], j[~test], 2 * turn
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def dealt(members: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Members (center, set_id, label, ...) in groups of bounded weight: adds ``group``, ``first``, ``second`` and ``side``.

    Small centers share a group.  Of a large one, the members that link with the center
    (side 1) and the others (side 0) are dealt to tiles by hash; every tile of others
    meets every tile, so linked members are never compared among themselves.
    """
    rows = members.withColumn("_w", weight).withColumn("_in", (F.col("label") == F.col("center")).cast("int"))
    totals = settled(rows.groupBy("center").agg(F.sum("_w").alias("_all"), F.sum(F.col("_w") * F.col("_in")).alias("_linked")), "weights")
    small = totals.filter(F.col("_all") <= limit).agg(F.ceil(F.sum("_all") / limit).cast("long")).first()[0] or 1
    rows = rows.join(totals, "center")
    whole_group = rows.filter(F.col("_all") <= limit).select(
        *members.columns, F.pmod(F.xxhash64("center"), F.lit(small)).alias("group"), F.lit(-1).alias("first"), F.lit(-1).alias("second"), F.lit(2).alias("side"))
    tiles = {"_in": F.ceil(F.col("_linked") / limit), "_out": F.ceil((F.col("_all") - F.col("_linked")) / limit)}
    wide = rows.filter(F.col("_all") > limit).withColumns({"_ti": tiles["_in"].cast("int"), "_to": F.greatest(tiles["_out"], F.lit(1)).cast("int")})
    wide = wide.withColumn("_own", F.pmod(F.xxhash64("set_id", F.lit("tile")), F.when(F.col("_in") == 1, F.col("_ti")).otherwise(F.col("_to"))).cast("int"))
    every = {c: F.sequence(F.lit(0), F.col(c) - 1) for c in ("_ti", "_to")}
    # first: a tile of others; second: a tile of linked members, numbered after those of the others, or another tile of others
    met = (F.when(F.col("_in") == 1, F.transform(every["_to"], lambda o: F.struct(o.alias("first"), (F.col("_to") + F.col("_own")).alias("second"), F.lit(1).alias("side"))))
           .otherwise(F.concat(
               F.when(F.col("_ti") > 0, F.transform(every["_ti"], lambda i: F.struct(F.col("_own").alias("first"), (F.col("_to") + i).alias("second"), F.lit(0).alias("side"))))
               .otherwise(F.array().cast("array<struct<first:int,second:int,side:int>>")),
               F.transform(every["_to"], lambda o: F.struct(F.least(o, F.col("_own")).alias("first"), F.greatest(o, F.col("_own")).alias("second"),
                                                            F.when(o == F.col("_own"), 2).when(o > F.col("_own"), 0).otherwise(1).alias("side"))))))
    spread = wide.select(*members.columns, F.col("center").alias("group"), F.inline(met))
    return whole_group.unionByName(spread.select(*whole_group.columns))


def link_sets(docs: DataFrame, packs: DataFrame, sets: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, label): components of the sets that link with other sets.

    docs has row and text; packs are the stored rows (bucket, pairs) of ``sign``; sets
    has set_id, rep (the name of a row), n and sketch, stored.  Each set is tested
    against the centers of its classes; then the groups of the centers are searched for
    further links, first by sketches, which leave few members, then by n-grams.
    """
    found = settled(stars(packs), "centers")
    left = sets.select(F.col("set_id").alias("x"), F.col("n").alias("_n"), F.col("sketch").alias("_s"))
    right = sets.select(F.col("set_id").alias("center"), F.col("n").alias("_m"), F.col("sketch").alias("_t"))
    likely = found.join(left, "x").join(right, "center").filter(F.least("_n", "_m") * 100 >= F.greatest("_n", "_m") * percent)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for n, m, s, t in zip(batch["_n"], batch["_m"], batch["_s"], batch["_t"]):
                length = min(len(s), len(t))
                far = int(np.bitwise_count((folded(s, length) ^ folded(t, length)).view(np.uint64)).sum())
                keep.append(far <= most_difference(n, m, percent))
            yield batch.loc[keep, ["x", "center"]]

    likely = settled(likely.mapInPandas(near, "x long, center long"), "likely-stars")

    def texts_of(names: DataFrame) -> DataFrame:
        """(set_id, grams) of named sets, from the text of one row of each."""
        wanted = names.join(sets.select("set_id", "rep"), "set_id").select("set_id", F.col("rep").alias("row"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set = set()
            for batch in batches:
                rows = []
                for name, text in zip(batch["set_id"], batch["text"]):
                    if name not in seen:
                        seen.add(name)
                        rows.append((name, shingles(text, words).tobytes()))
                yield pd.DataFrame(rows, columns=["set_id", "grams"])

        grams = docs.join(wanted, "row").select("set_id", "text").mapInPandas(run, "set_id long, grams binary")
        return settled(first_per_group(grams, ["set_id"], ["set_id"]), "grams")

    named = likely.select(F.explode(F.array("x", "center")).alias("set_id")).distinct()
    grams = texts_of(named)

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [linked(np.frombuffer(g, np.uint64), np.frombuffer(h, np.uint64), percent) for g, h in zip(batch["_g"], batch["_h"])]
            yield batch.loc[keep, ["x", "center"]]

    one, other = (grams.select(F.col("set_id").alias(c), F.col("grams").alias(g)) for c, g in (("x", "_g"), ("center", "_h")))
    links = settled(likely.join(other, "center").join(one, "x").mapInPandas(verified, "x long, center long"), "star-links")

    joined = found.join(links.withColumn("_linked", F.lit(True)), ["x", "center"], "left")
    members = joined.select("center", F.col("x").alias("set_id"), F.when(F.col("_linked"), F.col("center")).otherwise(F.col("x")).alias("label"))
    open_centers = members.filter("label <> center").select("center").distinct()
    members = settled(members.unionByName(found.select("center").distinct().select("center", F.col("center").alias("set_id"), F.col("center").alias("label")))
                      .join(open_centers, "center"), "members")
    sketched = members.join(sets.select("set_id", "n", "sketch"), "set_id")
    keys = ["group", "first", "second"]
    marked = (dealt(sketched, F.lit(1), TILE_ROWS).groupBy(*keys).applyInPandas(lambda rows: with_partner(rows, percent), "center long, set_id long"))
    marked = settled(marked.distinct().join(members, ["center", "set_id"]), "open-members")
    missing = marked.select("set_id").distinct().join(named, "set_id", "left_anti")
    known = grams.unionByName(texts_of(missing))
    held = marked.join(known, "set_id")
    forest = (dealt(held, F.greatest(F.octet_length("grams") / 8, F.lit(TILE_GRAMS // TILE_ROWS)), TILE_GRAMS).groupBy(*keys)
              .applyInPandas(lambda rows: spanning_links(rows, percent), "a long, b long"))
    return connected_components(links.select(F.col("x").alias("a"), F.col("center").alias("b")).unionByName(forest))


def components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n_shingles, label) for every row: rows with one label are linked; ``row`` is ``row_name`` of the row.

    An empty set's label is that of the row alone, which it shares with rows of the same id and text.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), row_name(id_column, text_column).alias("row"))
    buckets = max(shuffle_partitions(spark), math.ceil(rows.count() / DOCS_PER_BUCKET))
    signed = settled(sign(rows, buckets, words, percent), "signs")
    signs, packs = signed.filter("bucket IS NULL").drop("bucket", "pairs"), signed.filter("bucket IS NOT NULL").select("bucket", "pairs")
    full = signs.filter("n_shingles > 0")
    sets = settled(full.groupBy("set_id").agg(F.min("row").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "sets")
    near = link_sets(rows.select("row", "text"), packs, sets, words, percent)
    named = sets.select("set_id").join(near.select(F.col("node").alias("set_id"), "label"), "set_id", "left")
    named = settled(named.select("set_id", F.coalesce("label", "set_id").alias("label")), "labelled")
    empty = signs.filter("n_shingles = 0").select("doc_id", "row", "n_shingles", F.xxhash64("row", F.lit("empty")).alias("label"))
    return full.join(named, "set_id").select("doc_id", "row", "n_shingles", "label").unionByName(empty)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): ``component_id`` is the smallest id that links reach.

    A text that is null or has no word has an empty set, links with nothing and is
    its own component.  Equal texts link whatever their length.  A row whose id is null
    passes links on, but is no component's smallest id and has none itself.  Rows that
    repeat an id count as one document each in the result; an empty table gives no
    rows; other columns are not read.  N-grams are compared by 64-bit hashes.
    """
    rows = settled(components(docs, id_column, text_column, words, percent), "components")
    smallest = rows.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    full = rows.filter("n_shingles > 0").join(smallest, "label")
    out = full.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
