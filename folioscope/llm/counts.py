"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revisions) becomes signed rows: what a document counted so far with sign -1, what it
counts now with sign +1.  Their sums by source, language and tokenizer version are the batch's delta, and totals are the sum of
the committed deltas; nothing is counted anew.  A batch is written to a folder named by its id and becomes part of the totals
when its marker file exists, which is created last: a batch that failed half-way counts for nothing and is written over,
and one that is committed again changes nothing.  Of two batches that are prepared side by side the second to finish fails, and
is to be sent again.

Rows of the ledger lie in ``BUCKETS`` folders by doc_id, and a batch reads those of its own documents.  ``compact`` replaces what was
committed so far by one row for each counted document.  All state lies in a folder of the shared store.  Deletes of unknown documents change nothing; an insert of a known document
revises it; of a doc_id's repeated rows in a batch the one that counts most tokens holds (and a delete goes before any); null
texts count 0 tokens; null sources, languages and doc_ids are values like others; empty batches commit an empty delta.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded, shared_folder
from .wordhash import chunks

KEYS = ["source", "lang", "tokenizer_version"]
NUMBERS = ["n_docs", "n_tokens", "n_chars"]
#: Folders that a batch's ledger rows are dealt to.
BUCKETS = 64

#: Public byte-level vocabulary and its split pattern's module, by its place on the driver.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def count_tokens(docs: DataFrame, version: str, path: str = RANKS) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens and n_chars of every row."""
    bounded(docs.sparkSession)
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            for i, j in chunks(batch.column("text")):
                part = batch.slice(i, j - i)
                n = [len(encode(x)) if x else 0 for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("lang"), pa.array(n, pa.int64()), pa.compute.utf8_length(part.column("text")).cast(pa.int64()).fill_null(0)],
                                                 ["doc_id", "source", "lang", "n_tokens", "n_chars"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, n_tokens long, n_chars long").withColumn("tokenizer_version", F.lit(version))


class Rollup:
    """Totals by source, language and tokenizer version in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        path, fs = self._path(*names)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def committed(self) -> list[str]:
        return self._names("commits")

    def _bases(self) -> list[str]:
        return self._names("bases")

    def _read(self, kind: str) -> DataFrame | None:
        """The last base's rows and those of batches that it does not hold."""
        bases, batches = self._bases(), self.committed()
        if bases:
            held = {r["batch"] for r in self.spark.read.parquet(f"{self.folder}/base-{bases[-1]}/holds").collect()}
            batches = [b for b in batches if b not in held]
        paths = [f"{self.folder}/base-{b}/{kind}" for b in bases[-1:]] + [f"{self.folder}/{kind}/{b}" for b in batches]
        rows = [self.spark.read.parquet(p) for p in paths]  # each by itself, for a batch may have no bucket at all
        out = None
        for x in rows:
            out = x if out is None else out.unionByName(x, allowMissingColumns=True)
        return out

    def current(self, buckets: list[int] | None = None) -> DataFrame | None:
        """What each document counts now, of some buckets or of all."""
        ledger = self._read("ledger")
        if ledger is None:
            return None
        if buckets is not None:
            ledger = ledger.where(F.col("bucket").isin(buckets))
        return ledger.groupBy("doc_id", *KEYS, "n_tokens", "n_chars").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")

    def _put(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")

    def commit(self, batch: str, changed: DataFrame, deleted: DataFrame | None = None) -> bool:
        """Apply inserted or revised counts and deleted doc_ids (doc_id, tokenizer_version); False if the batch was applied before."""
        if not batch or "/" in batch:
            raise ValueError("a batch id names a folder")
        marker, fs = self._path("commits", batch)
        if fs.exists(marker):
            return False
        turn = len(self._names("turns"))
        columns = ["doc_id", *KEYS, "n_docs", "n_tokens", "n_chars"]
        best = W.partitionBy("doc_id", "tokenizer_version").orderBy(F.desc("n_tokens"), F.desc("n_chars"), "source", "lang")
        # counted once: the texts are not tokenised again for what the rows are asked below
        new = self._put(changed.withColumn("n_docs", F.lit(1).cast("long")).withColumn("_k", F.row_number().over(best)).where("_k = 1").select(columns), f"{self.folder}/new/{batch}")
        touched = new.select("doc_id", "tokenizer_version")
        if deleted is not None:
            touched = touched.unionByName(deleted.select("doc_id", "tokenizer_version"))
        touched = touched.distinct()
        rows = new
        if self.committed():
            buckets = [r["b"] for r in touched.select(self._bucket().alias("b")).distinct().collect()]  # BUCKETS at most
            touched = touched.select(F.col("doc_id").alias("_d"), F.col("tokenizer_version").alias("_v"))
            known = self.current(buckets)
            old = known.join(touched, known.doc_id.eqNullSafe(F.col("_d")) & known.tokenizer_version.eqNullSafe(F.col("_v")), "left_semi")
            rows = new.unionByName(old.withColumn("n_docs", -F.col("n_docs")).select(columns))
        ledger = f"{self.folder}/ledger/{batch}"
        rows.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(ledger)
        signed = self.spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)).parquet(ledger)
        self._put(self._sums(signed), f"{self.folder}/delta/{batch}")
        # the turn is taken by one batch only: another that has read the same state finds it taken
        path, _ = self._path("turns", f"{turn:09d}")
        if fs.exists(path):
            raise RuntimeError("another batch was committed meanwhile; send this one again")
        fs.create(path, False).close()
        fs.create(marker, False).close()
        fs.delete(self._path("new", batch)[0], True)
        return True

    @staticmethod
    def _sums(signed: DataFrame) -> DataFrame:
        return signed.groupBy(KEYS).agg(F.sum("n_docs").alias("n_docs"), *[F.sum(F.col(c) * F.signum("n_docs").cast("long")).alias(c) for c in NUMBERS[1:]])

    def compact(self) -> None:
        """One row for each counted document and one for each total in place of all batches' rows; batches stay known as committed."""
        batches, name = self.committed(), f"{len(self._bases()):09d}"
        if not batches:
            return
        turn = len(self._names("turns"))
        columns = ["doc_id", *KEYS, "n_docs", "n_tokens", "n_chars"]
        self.current().select(columns).withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base-{name}/ledger")
        self._put(self.totals(), f"{self.folder}/base-{name}/delta")
        self._put(self.spark.createDataFrame([(b,) for b in batches], "batch string"), f"{self.folder}/base-{name}/holds")
        path, fs = self._path("turns", f"{turn:09d}")
        fs.create(path, False).close()
        fs.create(self._path("bases", name)[0], False).close()
        for b in batches:
            for kind in ("ledger", "delta"):
                fs.delete(self._path(kind, b)[0], True)

    def totals(self) -> DataFrame:
        delta = self._read("delta")
        if delta is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long")
        return delta.groupBy(KEYS).agg(*[F.sum(c).alias(c) for c in NUMBERS]).where("n_docs <> 0 OR n_tokens <> 0")


def replayed(spark: SparkSession, sf_dir: str) -> Rollup:
    """All documents inserted in one batch, a tenth of them in an earlier wording; these revised in the next; those labelled toxic
    deleted in the third; and the first batch sent once more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rollup = Rollup(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")
    revised = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 3, F.lit(False))
    earlier = F.when(revised, F.expr("left(text, char_length(text) div 2)")).otherwise(F.col("text"))
    inserted = count_tokens(docs.withColumn("text", earlier), "byte_bpe_50k")
    rollup.commit("0-insert", inserted)
    rollup.commit("1-revise", count_tokens(docs.where(revised), "byte_bpe_50k"))
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id", F.lit("byte_bpe_50k").alias("tokenizer_version"))
    rollup.commit("2-delete", inserted.limit(0), toxic)
    rollup.commit("0-insert", inserted)
    return rollup


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after inserts, revisions, deletes and a repeated batch: those of the documents as they are, without the toxic."""
    return replayed(spark, sf_dir).totals()
