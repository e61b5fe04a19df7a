"""What the operators of this subpackage share: reading tables, shared storage, batching of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word ends at a space or one of the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch that carries whole texts.
TEXT_ROWS, TEXT_BYTES = 512, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS, size: int = TEXT_BYTES) -> None:
    """Whole texts need batches bounded in rows and bytes, which bound a worker's memory. Holds for the session's later queries too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session of one machine that names none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="inkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of WORD matches, as a long; null counts 0. Each word becomes one letter, then gaps go."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), GAP, "")), F.lit(0)).cast("long")


def least_hashed(rows: DataFrame, key: str, most: int, count: int) -> DataFrame:
    """Of rows (count of them) those with the least hash of key, most at most. A threshold keeps about that many before they are sorted."""
    share = min(1.0, (most + 6 * most**0.5 + 10) / max(count, 1))
    few = rows if share == 1.0 else rows.where(F.xxhash64(key) <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1))))
    return few.orderBy(F.xxhash64(key), key).limit(most)


def text_key(text: Column) -> Column:
    """64 bits of a text, 0 for null: with doc_id it names a row's content where doc_id alone may repeat."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text)).cast("long")


def grouped(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive items whose sizes sum to at most limit; a larger item stands alone."""
    i = total = 0
    for j, size in enumerate(sizes):
        if j > i and total + size > limit:
            yield i, j
            i, total = j, 0
        total += size
    if i < len(sizes):
        yield i, len(sizes)
