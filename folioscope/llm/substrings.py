"""Substring dedup by level-wise doubling.

A window of ``length`` consecutive words repeats only if each shorter window in it repeats.  So windows are searched
for at a short length first, and those that repeat at one length alone are extended to twice that length, up to the
length asked for or until no candidate survives.  Below the last length a whole window is stood for by one of its
short windows, the one with the least hash, which equal whole windows choose alike.

At each level only counts by hash and the least position meet in a shuffle; repeated hashes are summed before it, so
a passage that millions of documents share is one row from each task.  Positions found unique, or first, return to
their documents.  A row whose whole text equals that of a row with a smaller doc_id needs no search: all its windows
start earlier.

doc_id is the order of documents (null: least); rows that share one and have different texts are documents of their own, in the
order of a hash of the text, and equal rows are one document.  Each row gives its own result.  Null texts have no words and lose
nothing; texts shorter than the window lose nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut
from .wordhash import Words, chunks, extend, minimizers, sliding, split, windows

SPAN = "array<struct<first:int,last:int>>"


def lengths(whole: int, levels: int) -> list[int]:
    """``whole`` halved ``levels`` - 1 times as long as it is even, shortest first."""
    out = [whole]
    while len(out) < levels and out[0] % 2 == 0 and out[0] > 2:
        out.insert(0, out[0] // 2)
    return out


class Levels:
    """The windows of one chunk of texts at every level."""

    def __init__(self, w: Words, steps: list[int]):
        self.w, self.steps, self.rest = w, steps, w.rest
        self.hashes = [windows(w.hash, steps[0])]
        for n in steps[:-1]:
            self.hashes.append(extend(self.hashes[-1], n))

    def chosen(self, level: int, wanted: np.ndarray | None) -> np.ndarray:
        return minimizers(self.hashes[level], self.rest, self.steps[level], self.steps[-1], wanted)

    def wanted(self, known: list[list[np.ndarray]]) -> np.ndarray:
        """Whole windows that the unique positions found so far, by level and text, do not rule out."""
        whole = self.steps[-1]
        out = self.rest >= whole
        for level, unique in enumerate(known):
            # a whole window is ruled out if its least short window is unique
            alone = np.zeros(len(out), bool)
            if positions := [self.w.first[k] + x for k, x in enumerate(unique) if len(x)]:
                alone[np.concatenate(positions)] = True
            hashed = self.hashes[level]
            width = whole - self.steps[level] + 1
            least = sliding(hashed, width, np.minimum)
            single = np.where(alone, hashed, np.iinfo(np.uint64).max)
            out &= sliding(single, width, np.minimum) != least
        return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist(), strict=True)]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _search(docs: DataFrame, steps: list[int], level: int) -> DataFrame:
    """At ``level``, each distinct candidate of each document, once at its first place: doc_id, v, place, hashes.

    ``docs``: doc_id, v (a hash of the text), text and, for each level before, u0, u1, ...: the unique places.
    """
    last = level == len(steps) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, versions = batch.column("text"), batch.column("doc_id"), batch.column("v")
            known = [_lists(batch.column(f"u{k}")) for k in range(level)]
            for i, j in chunks(texts):
                w = split(texts.slice(i, j - i))
                if len(w.hash) < steps[-1]:
                    continue
                x = Levels(w, steps)
                wanted = x.wanted([u[i:j] for u in known])
                at = np.flatnonzero(wanted) if last else x.chosen(level, wanted)
                if not len(at):
                    continue
                doc = np.searchsorted(w.first, at, side="right") - 1
                hashed = x.hashes[level][at]
                if last:
                    # the last level needs each hash of a document once, at its first place: sorting keeps it first
                    own = hashed ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    once = np.argsort(own, kind="stable")
                    once = once[np.diff(own[once], prepend=~own[once[:1]]) != 0]
                    at, doc, hashed = at[once], doc[once], hashed[once]
                rows = pa.array(doc + i)
                out = {"doc_id": ids.take(rows), "v": versions.take(rows), "place": pa.array((at - w.first[doc]).astype(np.int32)), "h": _long(hashed)}
                if last:
                    out["g"] = _long(windows(w.hash, steps[-1], 77)[at])  # a second hash: 128 bits decide
                yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, v long, place int, h long" + ", g long" * last)


def _returned(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("doc_id", "v").agg(F.collect_list("place").alias(name))


def _unique(found: DataFrame) -> DataFrame:
    """Places of the hashes that occur once."""
    return found.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("v").alias("v"), F.min("place").alias("place")).where("n = 1").drop("h", "n")


def _first(found: DataFrame) -> DataFrame:
    """The first place of each hash."""
    return found.groupBy("h", "g").agg(F.min(F.struct("doc_id", "v", "place")).alias("f")).select("f.*")


def _with(docs: DataFrame, found: list[DataFrame]) -> DataFrame:
    for x in found:
        x = x.withColumnsRenamed({"doc_id": "_d", "v": "_v"})
        docs = docs.join(x, docs.doc_id.eqNullSafe(x._d) & (docs.v == x._v), "left").drop("_d", "_v")
    return docs


def repeats(docs: DataFrame, whole: int = 20, levels: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text without repeated words) and spans (words removed) of each row.

    A word is removed if a window of ``whole`` words over it also starts earlier.
    """
    steps = lengths(whole, levels)
    bounded(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("v"), "text")
    same = rows.where("text IS NOT NULL").groupBy(F.md5("text").alias("_m"), F.char_length("text").alias("_n")).agg(F.min(F.struct("doc_id", "v")).alias("f"))
    firsts = cut(same.select("f.*").distinct().withColumn("own", F.lit(True)))
    found: list[DataFrame] = []
    marked = _with(rows, [firsts])
    for level in range(len(steps) - 1):
        source = rows if level == 0 else _with(marked.where("own").drop("own"), found)
        unique = _returned(_unique(_search(source, steps, level)), f"u{level}")
        # the first level reads the source; the others share one exchange of the texts, so they stay in one plan
        found.append(cut(unique) if level == 0 else unique)
    known = _with(marked, found)
    first = _returned(_first(_search(known.where("own").drop("own"), steps, len(steps) - 1)), "first")
    return _with(known, [first]).mapInArrow(_remover(steps), _schema(docs))


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string, spans {SPAN}"


def _remover(steps: list[int]):
    whole = steps[-1]

    def covered(w: Words, batch: pa.RecordBatch, i: int, j: int, own: np.ndarray) -> np.ndarray:
        """Words of rows that hold the first copy of their text, covered by windows that are not first."""
        n = len(w.hash)
        if n < whole:
            return np.zeros(n, bool)
        x = Levels(w, steps)
        again = x.wanted([_lists(batch.column(f"u{k}").slice(i, j - i)) for k in range(len(steps) - 1)])
        for k, places in enumerate(_lists(batch.column("first").slice(i, j - i))):
            again[w.first[k] + places] = False
        again &= np.repeat(own, np.diff(w.first))
        again[np.repeat(~own, np.diff(w.first)) & (x.rest >= whole)] = True
        edge = np.zeros(n + whole + 1, np.int32)
        at = np.flatnonzero(again)
        edge[at] += 1
        np.add.at(edge, at + whole, -1)
        return np.cumsum(edge)[:n] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            own = np.array([bool(x) for x in batch.column("own").to_pylist()])
            for i, j in chunks(texts):
                w = split(texts.slice(i, j - i))
                gone = covered(w, batch, i, j, own[i:j])
                raw = w.data.tobytes()
                sums = np.concatenate([[0], np.cumsum(gone)])
                kept, spans = [], []
                for k in range(j - i):
                    a, b = w.first[k], w.first[k + 1]
                    words = raw[w.base[k] : w.base[k + 1]].split()
                    removed = sums[b] - sums[a]
                    if removed:
                        words = compress(words, (~gone[a:b]).tolist())
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
                        spans.append([{"first": int(f), "last": int(t) - 1} for f, t in zip(edges[::2], edges[1::2], strict=True)])
                    else:
                        spans.append([])
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(w.first)), pa.array(sums[w.first[1:]] - sums[w.first[:-1]]), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                    ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
