"""Tables in the cluster's shared folder, and bounded hash filters."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of a filter's size: 2**27 bits are 16 MB, whatever the data's size.
MOST_BITS = 27
_own: dict[str, str] = {}
#: Where stored tables are, as long as somebody holds them.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master without it."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, any executor may be lost."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more: what follows from them has been written."""
    for table in tables:
        if table is not None and (path := _paths.pop(table, None)):
            remove(table.sparkSession, path)


def filter_bits(expected: int, per_value: int = 64) -> int:
    """Bits (as a power of two) for about `expected` values, at most MOST_BITS."""
    return min(MOST_BITS, max(16, int(expected * per_value).bit_length()))


def hash_filter(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits in which the low bits of every hash are set.

    Built by a Spark aggregation; the driver receives at most 2**bits / 8 bytes.
    A false positive only costs work: every hit is joined or compared exactly.
    """
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = (
        values.where(F.col(column).isNotNull())
        .groupBy(F.bitmap_bucket_number(place).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.collect():
        at = (row["part"] - 1) * 4096
        part = np.frombuffer(bytes(row["bitmap"]), np.uint8)[: max(0, len(out) - at)]
        out[at : at + len(part)] = part
    return out


def in_filter(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap may hold."""
    place = hashes.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def maybe_in(df: DataFrame, key: str, bitmap: np.ndarray, wanted: bool = True) -> DataFrame:
    """The rows whose 64-bit hash `key` the bitmap may hold, or those that it surely doesn't: a filter without a shuffle."""
    seen = df.sparkSession.sparkContext.broadcast(bitmap)
    place = df.columns.index(key)

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(seen.value, batch.column(place).to_numpy()) == wanted))

    return df.mapInArrow(chosen, df.schema)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for further columns that no column of `df` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
