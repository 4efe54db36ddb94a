"""Files of a folder tree as documents, and tables of the engine's own."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.functions.columns import any_glob


def walk_order(path: str | Column) -> Column:
    """Sorts paths as a walk does that visits each folder's entries in order."""
    return F.split(path, "/")


def read_tree(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), suffix: str | None = None) -> DataFrame:
    """path (below the root) and source of every file; what does not pass is not read: content is decoded after the filters."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        files = files.option("pathGlobFilter", f"*{suffix}")
    files = files.load(root).where(F.instr("path", base) > 0).select(F.expr(f"substring(path, instr(path, '{base}') + {len(base)})").alias("path"), "content")
    return pre_filter(files, include, exclude).select("path", F.decode("content", "UTF-8").alias("source"))


def pre_filter(files: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files that an include pattern matches (all, if there is none) and no exclude pattern does."""
    if include:
        files = files.where(any_glob(F.col("path"), include))
    return files.where(~any_glob(F.col("path"), exclude)) if exclude else files


def page(entities: DataFrame, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    """A page of entities, in the order of their ids."""
    return entities.orderBy(key).offset(offset).limit(limit)


def merge_first(*files: DataFrame, key: str = "path") -> DataFrame:
    """Rows of several tables; of those with one key the first table's."""
    out = None
    for k, f in enumerate(files):
        f = f.withColumn("_rank", F.lit(k))
        out = f if out is None else out.unionByName(f)
    columns = [c for c in files[0].columns if c != key]
    return out.groupBy(key).agg(F.min_by(F.struct(*columns), "_rank").alias("_r")).select(key, "_r.*")


def upsert(current: DataFrame, patch: DataFrame, key: str = "id", delete: DataFrame | None = None) -> DataFrame:
    """A table after a patch: new keys are added, null columns of known ones are left, deleted keys go."""
    p = patch.select([F.col(c).alias(f"_p_{c}") for c in patch.columns])
    out = current.join(p, current[key] == F.col(f"_p_{key}"), "full_outer")
    out = out.select([F.coalesce(F.col(f"_p_{c}"), current[c]).alias(c) if c in patch.columns else current[c] for c in current.columns])
    return out if delete is None else out.join(delete.select(key).distinct(), key, "left_anti")


def changes(current: DataFrame, patch: DataFrame, key: str = "id", delete: DataFrame | None = None) -> DataFrame:
    """What ``upsert`` does to each key: created, updated or deleted; a key that is patched and deleted counts as deleted if it was there."""
    known, new = current.select(key, F.lit(True).alias("_known")), patch.select(key, F.lit(True).alias("_new")).distinct()
    gone = (current.select(key).limit(0) if delete is None else delete.select(key)).distinct().withColumn("_gone", F.lit(True))
    both = known.join(new, key, "full_outer").join(gone, key, "left")
    kind = F.when(F.col("_gone") & F.col("_known"), "deleted").when(F.col("_gone"), None).when(F.col("_known").isNull(), "created").when(F.col("_new"), "updated")
    return both.select(key, kind.alias("change")).where("change IS NOT NULL")


def numbered_slugs(df: DataFrame, name: str, order: str, slug_of: Column) -> DataFrame:
    """Rows with ``slug_id``: the slug of the name, and -2, -3 and so on for later rows (by ``order``) with the same one."""
    n = F.row_number().over(W.partitionBy("_slug").orderBy(order))
    out = df.withColumn("_slug", slug_of).withColumn("_n", n)
    return out.withColumn("slug_id", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), F.col("_n").cast("string")))).drop("_slug", "_n")


def external_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings that another engine wrote as a JSON array."""
    from folioscope.operators.validate import FINDINGS

    raw = spark.read.schema("id string, level string, path string, message string, hint string, pos struct<line:int,col:int>").option("multiLine", "true").json(path)
    return raw.select(F.col("path"), "id", "level", F.col("pos.line").alias("line"), F.col("pos.col").alias("col"), "message", "hint", F.lit(0).alias("emitted")).selectExpr(*[c.split()[0] for c in FINDINGS])


def resolve_inside(root: str, path: str) -> str:
    """The place of ``path`` below ``root``; ValueError if it leads out of it."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} leads out of {root}")
    return full


POINTER = "_current"


def save_table(df: DataFrame, path: str) -> None:
    """Replace a small table: its rows are written to a folder of their own, and then a pointer is moved there at once.

    Readers meet the old rows or the new, whenever they come and wherever this breaks off; the version before stays for those that
    have begun to read it.
    """
    spark, name = df.sparkSession, f"v-{time.time_ns():020d}"
    df.write.parquet(f"{path}/{name}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda x: jvm.org.apache.hadoop.fs.Path(f"{path}/{x}")
    fs = at(name).getFileSystem(conf)
    out = fs.create(at(f".{name}"), True)
    out.write(name.encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(at(f".{name}"), at(POINTER), options)
    versions = sorted(x.getPath().getName() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if x.getPath().getName().startswith("v-"))
    for old in versions[: max(0, versions.index(name) - 1)]:
        fs.delete(at(old), True)


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small table, or an empty one if it is not there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    into = fs.open(at)
    name = bytes(into.readAllBytes()).decode()
    into.close()
    return spark.read.schema(schema).parquet(f"{path}/{name}")
