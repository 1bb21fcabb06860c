"""What the operators of this subpackage share: shared-folder stages, text columns, names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: blank and the control characters from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"
#: Internal columns start with this, so that no column of a caller's table clashes with them.
OWN = "__lx_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lithic-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, and outlives a lost executor.

    What isn't unstaged before (results that are read from it later) is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)
    out = spark.read.schema(df.schema).parquet(path)
    out._lithic_path = path
    return out


def unstage(df: DataFrame | None) -> None:
    """Deletes what stage() wrote, once nothing reads it any more."""
    path = getattr(df, "_lithic_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a batch that is sent to a Python worker. Texts are long: batches by rows alone would have hundreds of MB.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends batches of BATCH_BYTES at most to Python workers; a smaller setting stays. Results don't depend on it."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = str(conf.get(name, "64m")).lower().removesuffix("b")
    held = int(held[:-1]) << {"k": 10, "m": 20, "g": 30}[held[-1]] if held[-1] in "kmg" else int(held)
    if held > BATCH_BYTES or held <= 0:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def fold(value: Column) -> Column:
    """Remainder source of the contracts: crc32 of an id as text; null counts as the empty text."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
