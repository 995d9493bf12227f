"""Small helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into arrays at once.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; in local mode a temporary one if none is named, elsewhere an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(context, "_sieveworks_scratch", None):
        context._sieveworks_scratch = tempfile.mkdtemp(prefix="sieveworks-")
    return context._sieveworks_scratch


def materialize(df: DataFrame, tag: str, tidy: bool = False) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    tidy: df shuffles much.  Spark deletes shuffle files when the driver's garbage is collected, and a driver with
    little garbage keeps them to the end; so it is asked to collect now that no later step reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    if tidy:
        spark.sparkContext._jvm.System.gc()
    return out


def discard(tables: list[DataFrame]) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, as all that was made of them is written itself."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._table_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    tables.clear()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col):
    """Rows whose labels training never sees: crc32 of the id as text, modulo 5, is 0 (null ids count as the empty text)."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def chunks(texts, limit: int = CHUNK_BYTES):
    """Index ranges (lo, hi) of consecutive texts holding about ``limit`` characters; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


WORD = re.compile(r"[^\W_]+")
