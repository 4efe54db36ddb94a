"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Documents with equal shingle sets are one class, named by the set's digest; links are sought between classes, so doc_id may be of
any type that has an order.

Of n shingles a linked set lacks at most d = n - ceil(0.85 n), so of the 2 d + 1 shingles with the least hashes both
sets hold at least min(d, d') + 1 in common.  Shingles of one set only are dropped; a set left with too few has no
partner.  What remains is dealt into blocks of bounded size, sets with the same common shingle together.  A
set asks each block that holds enough of its least shingles.  In a block, inverted lists are searched as DivideSkip does:
of the asking set's lists the L longest are set aside, the others are merged by a heap, which skips what cannot occur T - L times,
and only candidates that do are looked up in the L long lists by binary search, where T is the overlap that the pair needs.  Pairs that are already connected are passed over, so a block
reports a forest and not all pairs of a group.  Blocks and askers are both cut to bounded size, by hashes, so no group of
copies lands in one task; every shingle of a set takes part in the count.

Null or empty texts have no shingles and link with nothing; texts with fewer words than a shingle have their whole
sequence as one; every row has its own set, also of repeated doc_ids; a null doc_id links but is no component_id; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, small, written
from .components import Forest, components
from .wordhash import U64, chunks, mix, split, windows

#: Sets in a block, and askers that meet a block in one group, about.
BLOCK = 2048
#: Weight of a long list's binary search against an entry of a merge, for the number of lists that are set aside.
PROBE = 0.01
#: Units that one shingle is looked up in before a set has asked by its rarer ones.
SPREAD = 64


def needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b for a similarity of ``percent`` %."""
    return -(-(a + b) * percent // (100 + percent))


def slack(n, percent: int):
    """Shingles of n that a linked set may lack."""
    return n - -(-n * percent // 100)


def sets_of(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted hashes of the distinct shingles) of each text."""
    for i, j in chunks(texts):
        w = split(texts.slice(i, j - i), lower=True)
        hashed = windows(w.hash, width) if len(w.hash) else w.hash
        for k in range(j - i):
            a, b = w.first[k], w.first[k + 1]
            if b - a >= width:
                yield i + k, np.unique(hashed[a : b - width + 1])
            elif b > a:
                yield i + k, windows(w.hash[a:b], int(b - a), int(b - a) + 100)[:1]
            else:
                yield i + k, np.zeros(0, U64)


def _digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    if not len(own):
        return 0, 0
    return int(mix(own).sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(own ^ U64(0x5851F42D4C957F2D))).view(np.int64))


def _signatures(width: int):
    """doc_id, text hash, size and digest of the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, digests = [], [], []
            for row, own in sets_of(batch.column("text"), width):
                rows.append(row)
                sizes.append(len(own))
                digests.append(_digest(own))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "v")), pa.array(sizes, pa.int64()), *(pa.array([x[k] for x in digests], pa.int64()) for k in range(2))], ["doc_id", "v", "n", "s1", "s2"])

    return run


def _least(width: int, percent: int):
    """(t, s1): the 2 d + 1 least hashes of each text's set, with the set's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, classes = [np.zeros(0, np.int64)], []
            for _, own in sets_of(batch.column("text"), width):
                if len(own):
                    tokens.append(own[: 2 * slack(len(own), percent) + 1].view(np.int64))
                    classes.append((_digest(own)[0], len(tokens[-1])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array([c for c, _ in classes], np.int64), [n for _, n in classes]))], ["t", "s1"])

    return run


def _full(width: int):
    """Class and set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own for _, own in sets_of(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x)[0] for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["id", "own"])

    return run


def merged(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Numbers that stand in ``least`` of the sorted lists or more, and in how many, by a heap that skips (MergeSkip)."""
    at = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap)[1])
        if len(popped) >= least:
            yield top, len(popped)
            for k in popped:
                at[k] += 1
                if at[k] < len(lists[k]):
                    heappush(heap, (lists[k][at[k]], k))
            continue
        # the next number that can stand in enough lists is the least one after ``least`` - 1 of them are set aside
        while heap and len(popped) < least - 1:
            popped.append(heappop(heap)[1])
        if not heap:
            return
        to = heap[0][0]
        for k in popped:
            at[k] = bisect_left(lists[k], to, at[k])
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))


class Index:
    """Inverted lists of one block's sets."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = np.array(ids, np.int64), sets
        self.sizes = np.array([len(x) for x in sets], np.int64)
        token = np.concatenate(sets)
        order = np.argsort(token, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.token, self.at, self.count = np.unique(token[order], return_index=True, return_counts=True)
        # a place in the lists: token, then set
        self.place = np.repeat(np.arange(len(self.token)), self.count) * len(sets) + self.owner
        self.shortest = int(self.sizes.min())

    def search(self, own: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Places of the sets that link with ``own``; ``skip(place)``: pass a candidate over."""
        spot = np.searchsorted(self.token, own)
        spot[spot == len(self.token)] = 0
        spot = spot[self.token[spot] == own]
        least = needed(len(own), max(self.shortest, -(-len(own) * percent // 100)), percent)  # T of the smallest partner
        if len(spot) < least:
            return
        spot = spot[np.argsort(self.count[spot], kind="stable")]
        aside = min(least - 1, int(least / (PROBE * log2(1 + int(self.count[spot[-1]])) + 1)))
        short, long = spot[: len(spot) - aside], spot[len(spot) - aside :] * len(self.sets)
        lists = [self.owner[a : a + n].tolist() for a, n in zip(self.at[short].tolist(), self.count[short].tolist(), strict=True)]
        for c, n in merged(lists, least - aside):
            size = int(self.sizes[c])
            wanted = needed(len(own), size, percent)
            if n + aside < wanted or 100 * min(size, len(own)) < percent * max(size, len(own)) or skip(c):
                continue
            probe = np.searchsorted(self.place, long + c)
            probe[probe == len(self.place)] = 0
            if n + int((self.place[probe] == long + c).sum()) >= wanted:
                yield c


class Block:
    """One block's sets and the forest of the links found so far."""

    def __init__(self, percent: int, first: bool):
        self.percent, self.first, self.ids, self.sets, self.forest, self.index = percent, first, [], [], Forest(), None
        self.links: list[tuple[int, int]] = []

    def close(self) -> None:
        """All sets are there; in the block's first part they ask each other."""
        if self.index is None and self.sets:
            self.index = Index(self.ids, self.sets)
            if self.first:
                for doc, own in zip(self.ids, self.sets, strict=True):
                    self.ask(doc, own)

    def ask(self, doc: int, own: np.ndarray) -> None:
        self.close()
        if self.index is not None:
            forest, ids = self.forest, self.ids
            for c in self.index.search(own, self.percent, lambda c: forest.root(ids[c]) == forest.root(doc)):
                if forest.join(doc, ids[c]):
                    self.links.append((doc, ids[c]))


def _blocks(percent: int):
    """For each (block, part) the block's sets come first, then the askers; gives a forest of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, Block(percent, False)
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("block", "part", "asks", "id")), strict=True)
            values, offsets = batch.column("own").values.to_numpy().view(U64), batch.column("own").offsets.to_numpy()
            for row, (name, part, asks, doc) in enumerate(keys):
                own = values[offsets[row] : offsets[row + 1]]
                if (name, part) != key:
                    block.close()
                    yield pack(block.links)
                    key, block = (name, part), Block(percent, part == 0)
                if asks:
                    block.ask(doc, own)
                else:
                    block.ids.append(doc)
                    block.sets.append(own.copy())
            yield pack(block.links)
            block.links = []
        block.close()
        yield pack(block.links)

    def pack(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    return run


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """A forest (a, b) with the same components as all links between the classes (id, n, and doc_id and v of a row of each) of docs (doc_id, v, text)."""
    d = F.expr(f"n - cast(ceil(n * {percent} / 100.0) as long)")
    # a partner may be smaller: both hold at least min(d, d') + 1 of each other's least shingles
    least = F.expr(f"least(d, cast(floor(n * {percent} / 100.0) as long) - cast(ceil(floor(n * {percent} / 100.0) * {percent} / 100.0) as long)) + 1")
    # shingles of one class only, counted by class
    lone = (docs.select("text").mapInArrow(_least(width, percent), "t long, s1 long").groupBy("t").agg(F.min("s1").alias("s1"), F.max("s1").alias("_m"))
            .where("s1 = _m").groupBy(F.col("s1").alias("id")).agg(F.count("*").alias("lone")))
    left = cut(classes.where("n > 0").withColumn("d", d).join(lone, "id", "left").where(F.least(F.col("n"), 2 * F.col("d") + 1) - F.coalesce("lone", F.lit(0)) >= least).select("id", "n", "d", "doc_id", "v"))
    rows = left.select(F.col("doc_id").alias("_d"), F.col("v").alias("_v"))
    texts = docs.join(small(rows), docs.doc_id.eqNullSafe(F.col("_d")) & (docs.v == F.col("_v")), "left_semi")
    full_sets = written(texts.select("text").mapInArrow(_full(width), "id long, own array<long>"))
    left = left.select("id", "n", "d")
    tokens = full_sets.join(small(left.select("id", "d")), "id").select("id", F.explode(F.expr("slice(own, 1, cast(2 * d + 1 as int))")).alias("t"))
    shared = tokens.groupBy("t").agg(F.count("*").alias("c"), F.min("id").alias("pivot")).where("c > 1").drop("c")
    tokens = written(tokens.join(shared, "t"))
    # sets that have the same pivot for most of their shingles lie together; large groups are cut by a hash
    home = (tokens.groupBy("id", "pivot").agg(F.count("*").alias("k"))
            .groupBy("id").agg(F.max(F.struct("k", (-F.col("pivot")).alias("p"))).alias("m"), F.sum("k").alias("held"))
            .join(left.withColumn("least", least), "id").where("held >= least").select("id", "least", (-F.col("m.p")).alias("pivot")))
    home = cut(home)
    # a unit is a large group, which has several blocks, or a hash of small ones, which has one
    crowd = home.groupBy("pivot").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    small_units = -(-max(1, home.count()) // BLOCK)
    home = home.join(crowd, "pivot", "left").select(
        "id", "least", F.when(F.col("size").isNull(), F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("pivot"), F.lit(small_units)))).otherwise(F.xxhash64("pivot")).alias("unit"),
        F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("long").alias("blocks"))
    home = cut(home.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    units = home.groupBy("unit").agg(F.max("blocks").alias("blocks"))
    where = tokens.select("id", "t").join(home.select("id", "least", "unit"), "id")
    posting = where.groupBy("t", "unit").agg(F.count("*").alias("c")).select("t", "unit")
    wide = posting.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") > SPREAD).select("t", F.lit(1).alias("wide"))
    asked = where.join(wide, "t", "left").select("id", "least", "unit", "t", F.coalesce("wide", F.lit(0)).alias("wide"))
    asked = written(asked.join(asked.groupBy("id").agg(F.sum("wide").alias("l")), "id"))
    # shingles of many units are left out, and as many fewer must be met; a set that has too many of them asks by all.
    # Of two units, or two blocks of one, the lesser one's sets ask the greater one; a block's own sets are there already.
    asks = asked.where("l < least AND wide = 0").withColumn("k", F.col("least") - F.col("l")).unionByName(asked.where("l >= least").withColumn("k", F.col("least")))
    others = posting.select("t", F.col("unit").alias("other"))
    far = asks.join(others, "t").where("unit < other").groupBy("id", "other").agg(F.count("*").alias("c"), F.min("k").alias("k")).where("c >= k").select("id", F.col("other").alias("unit"))
    far = far.join(units, "unit").select("id", "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    near = home.where("block < blocks - 1").select("id", "unit", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"))
    ask = cut(far.unionByName(near))
    place = ["unit", "block"]
    crowd = ask.groupBy(place).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    rows = home.join(crowd, place, "left").select("id", *place, F.explode(F.expr("sequence(0L, coalesce(parts, 1L) - 1)")).alias("part"), F.lit(False).alias("asks")).unionByName(
        ask.join(crowd, place).select("id", *place, F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).alias("part"), F.lit(True).alias("asks")))
    rows = rows.select("id", F.xxhash64(*place).alias("block"), "part", "asks")
    return (full_sets.join(small(rows), "id").repartition("block", "part").sortWithinPartitions("block", "part", "asks")
            .select("block", "part", "asks", "id", "own").mapInArrow(_blocks(percent), "a long, b long"))


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links lead to) of every row."""
    bounded(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.xxhash64("text").alias("v"), "text")
    rows = cut(docs.mapInArrow(_signatures(width), f"doc_id {kind}, v long, n long, s1 long, s2 long"))
    key = ["n", "s1", "s2"]
    # one row of each class gives its text; its least doc_id is the one that is not null
    classes = cut(rows.where("n > 0").groupBy(key).agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "v")).alias("f")).select(*key, F.col("s1").alias("id"), "least", "f.*"))
    found = components(links(docs, classes, width, percent))
    linked = classes.join(found, classes.id == found.node).select(*key, "root", "least")
    linked = linked.join(linked.groupBy("root").agg(F.min("least").alias("first")), "root").select(*key, "first")
    rep = classes.select(*key, "least").join(linked, key, "left").select(*key, F.coalesce("first", "least").alias("root"))
    return rows.join(rep, key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The documents that are the least of their component, with all their columns; those without an id stay."""
    gone = join(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
