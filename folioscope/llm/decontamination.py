"""Benchmark decontamination: containment of test items in documents by size-partitioned MinHash sketches.

Items are partitioned by their number of distinct five-word shingles (``PARTITIONS``).  Each keeps a MinHash sketch: its least
hashes.  Of n shingles, a document that contains at least t n lacks at most n - ceil(t n), so of the n - ceil(t n) + m least ones
at least m are in it; a partition's m, the hits that it asks for, is larger where items are.  A document's sketch is its hashes up to
the greatest of the items' sketches.  So nothing is lost by chance.  Candidates are verified by exact containment of shingle strings.  DataFrame functions
only.

Words are runs of letters, digits and non-ASCII characters, lower-cased.  An item with fewer words than a
shingle has no shingle and is never found; null texts have no words; a document repeated in the table counts once (the words of
rows that share a doc_id count together); rows of a null doc_id contain nothing; an empty table on either side gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, small

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Partitions of the items: least number of shingles, and hits that are asked for.
PARTITIONS = ((1, 1), (16, 2), (64, 4), (256, 8))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def _each(width: int, expression: str) -> Column:
    """``expression`` of i for each start of a ``width``-word window of the column w, from 0."""
    return F.expr(f"CASE WHEN size(w) >= {width} THEN transform(sequence(0, size(w) - {width}), i -> {expression}) ELSE array() END")


def shingle_hashes(width: int) -> Column:
    return _each(width, f"xxhash64({', '.join(f'get(w, i + {k})' if k else 'get(w, i)' for k in range(width))})")


def shingles(width: int) -> Column:
    return F.array_distinct(_each(width, f"array_join(slice(w, i + 1, {width}), ' ')"))


def contained(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) where a document contains at least ``threshold`` of an item."""
    item = (items.where("text IS NOT NULL").select("item_id", words(F.col("text")).alias("w"))
            .select("item_id", F.explode(shingles(width)).alias("shingle")).distinct())
    least = W.partitionBy("item_id").orderBy("h", "shingle")
    item = (item.withColumn("h", F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(k)) for k in range(width)]))
            .withColumn("n_shingles", F.count("*").over(W.partitionBy("item_id"))).withColumn("rank", F.row_number().over(least)))
    needed = F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9)
    partition = F.greatest(*[F.when(F.col("n_shingles") >= n, k).otherwise(0) for k, (n, _) in enumerate(PARTITIONS)], F.lit(0))
    hits = F.element_at(F.array(*[F.lit(m) for _, m in PARTITIONS]), F.col("partition") + 1)
    item = cut(item.withColumn("needed", needed).withColumn("partition", partition).withColumn("hits", F.least(hits, "needed")))
    sketch = item.where(F.col("rank") <= F.col("n_shingles") - F.col("needed") + F.col("hits")).select("h", "item_id", "hits")
    # a document's sketch: its hashes up to the greatest of the items' sketches
    bound = sketch.agg(F.max("h").alias("h")).first()["h"]
    probe = (docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", words(F.col("text")).alias("w"))
             .select("doc_id", F.explode(shingle_hashes(width)).alias("h")).where(F.col("h") <= F.lit(bound)))
    # each hash once, so that a shingle that many items share does not multiply the probes
    met = probe.join(small(sketch.select("h").distinct()), "h", "left_semi").distinct()
    met = met.join(small(sketch), "h").groupBy("doc_id", "item_id", "hits").agg(F.count("*").alias("met"))
    candidates = cut(met.where("met >= hits").select("doc_id", "item_id"))

    ids = candidates.select("doc_id").distinct()
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(small(ids), "doc_id", "left_semi")
    held = texts.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(shingles(width)).alias("shingle"))
    known = small(item.select("shingle").distinct())
    held = held.join(known, "shingle", "left_semi").distinct()
    wanted = candidates.join(small(item.select("item_id", "shingle", "n_shingles", "needed")), "item_id")
    shared = wanted.join(held, ["doc_id", "shingle"]).groupBy("doc_id", "item_id", "n_shingles", "needed").agg(F.count("*").alias("n_shared"))
    return (shared.where("n_shared >= needed")
            .select("doc_id", "item_id", "n_shingles", "n_shared", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment")))


def clean(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that contain no item, with all their columns; documents without an id stay."""
    found = cut(contained(docs, items, width, threshold).select("doc_id").distinct())
    return docs.join(small(found), "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, n.n_shingles, count(*) AS n_shared, round(count(*) / n.n_shingles::DOUBLE, 6) AS containment
FROM ds JOIN bs USING (s) JOIN n ON n.item_id = bs.item_id
GROUP BY ds.doc_id, bs.item_id, n.n_shingles HAVING count(*) >= ceil(n.n_shingles * 0.8 - 1e-9)
"""
