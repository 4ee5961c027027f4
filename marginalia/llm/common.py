"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word cache may hold before it is emptied.
CACHE_ENTRIES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. A folder of this machine is taken only
    where the setting is missing and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Folders written by this process, in order.
_made: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends
    there, and a lost executor costs no recomputation. The folder stays until `release`."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many folders were written so far; for `release`."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes folders that were written after `since`, but for those that `keep` reads. What was
    made of them must have been written elsewhere."""
    kept = keep.inputFiles() if keep is not None else []
    for path in [p for p in _made[since:] if not any(p in f for f in kept)]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _made.remove(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the DataFrame doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes: split(), strip() and lower() of bytes act on
    ASCII alone, as the contracts ask."""
    return column.cast(pa.large_binary()).to_pylist()


def spread_rank(df: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """Rows dealt by range of `order`, sorted, written to the shared folder with
    ``_part`` (range number) and ``_at`` (place inside it), so that a place in the
    whole order is an offset per range plus ``_at``. Ties must be broken by `order`.
    """
    n = n or parts(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return materialize(dealt.withColumns({"_part": F.spark_partition_id(), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
