"""What the operators of this subpackage share: lineage cuts and checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

#: A side of a join is broadcast only if it has been counted and has at most this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 24 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset and all is on one machine (tests) a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


#: Bytes of a batch of rows that is sent to a Python worker, about.
BATCH_BYTES = "1m"
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with batches for Python workers bounded by bytes, for texts may be long; a bound set before stays."""
    if spark.conf.get(SETTING, None) is None:
        spark.conf.set(SETTING, BATCH_BYTES)
    return spark


def release(spark: SparkSession) -> bool:
    """Give the system back what the driver's two processes have freed; whether the JVM could (a JDK without the command goes on as it is).

    The C library keeps what planning, compiling and collecting have freed in the arenas of some hundred threads.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    try:
        jvm = spark._jvm
        array = spark.sparkContext._gateway.new_array
        asked = array(jvm.java.lang.Object, 4)
        asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        asked[2], asked[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        # by the interface, for the server's own class is not public
        ask = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        ask.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
    except Py4JError:
        return False
    return True


#: Bytes of an array, and of freed memory in all, up to which a Python worker keeps memory for its next arrays.
ARRAY, KEPT = 8 << 20, 32 << 20


def keep_memory() -> None:
    """Let this process keep the memory of its arrays for the next ones, which otherwise come from the system page by page each time."""
    if option := getattr(ctypes.CDLL(None), "mallopt", None):
        option(-3, ARRAY)  # M_MMAP_THRESHOLD
        option(-1, KEPT)  # M_TRIM_THRESHOLD


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    release(df.sparkSession)
    return out


#: Folders that this program has written.
_written: list[str] = []


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean() -> None:
    """Delete what ``written`` has left, if there is a session still; tables that read it are gone with it."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _written:
        drop(spark, _written.pop())


atexit.register(clean)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, for larger tables: compressed columns in a folder of the shared one, until the program ends or ``clean``."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcasting if a count proves that it has at most ``rows`` rows and ``most`` bytes; else as it is."""
    sizes = [_bytes(f"`{x.name}`", x.dataType) for x in df.schema]
    n, size = df.select(*(x.alias(f"_{k}") for k, x in enumerate(sizes))).limit(rows + 1).agg(F.count("*"), F.sum(sum((F.col(f"_{k}") for k in range(len(sizes))), F.lit(0)))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most else df


def _bytes(name: str, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)).cast("long") + 16
    if isinstance(kind, ArrayType):
        inner = F.size(name) * 32 if not isinstance(kind.elementType, (StringType, BinaryType)) else F.octet_length(F.array_join(name, "")) + 16 * F.size(name)
        return F.coalesce(inner, F.lit(0)).cast("long") + 16
    return F.lit(8).cast("long")
