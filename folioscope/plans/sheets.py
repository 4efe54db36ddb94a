"""Rows of orders and line items rendered as Markdown sheets, one for each order, within Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its lines in a fixed order: one aggregation of lineitem, one join on the order's key.

    The number of partitions is given, so that adaptive execution does not put the rows, which are small before they are
    rendered and parsed, into a few tasks.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))).alias("lines"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    orders = orders.repartition(n, "o_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").drop("l_orderkey").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def lines_table(lines: Column) -> Column:
    row = lambda x: text("| ", x.l_linenumber, " | ", x.l_partkey, " | ", x.l_returnflag, " | ", x.l_linestatus, " |\n")
    return text("| line | part | flag | status |\n|---|---|---|---|\n", F.array_join(F.transform(lines, row), ""), "^lines\n")


def sheet() -> Column:
    """Frontmatter, a summary with an anchor, the table of lines and a checklist."""
    shipped = F.forall("lines", lambda x: x.l_linestatus == "F")
    return text("---\norder: ", F.col("o_orderkey"), "\nstatus: ", F.col("o_orderstatus"), "\npriority: ", F.col("o_orderpriority"), "\n---\n# Order ", F.col("o_orderkey"),
                "\n\n## Summary\n\nOrder of customer ", F.col("o_custkey"), " with ", F.size("lines"), " lines. ^summary\n\n## Lines\n\n", lines_table(F.col("lines")),
                "\n## Checklist\n\n", F.when(shipped, "- [x] shipped\n").otherwise("- shipped\n"), F.when(shipped, "\n## Shipped\n\nAll lines. See [[#^lines]].\n").otherwise("\nSee [[#^shipped]].\n"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_with_lines(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), sheet().alias("source"))


def flag_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each line, named by its flag, in line order."""
    body = F.array_join(F.transform("lines", lambda x: text("## ", x.l_returnflag, "\n\nPart ", x.l_partkey, ".\n\n")), "")
    return orders_with_lines(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), text("# Order\n\n", body).alias("source"))
