"""Helpers shared by the operators: stored intermediate tables, Arrow buffers, word rules."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A run of characters other than ASCII white space.
NON_SPACE = r"[^\x20\x09-\x0D]+"


#: A key is hot with more than this share of all rows (and more than HOT_ROWS rows): at most 1 / HOT_SHARE keys are.
HOT_SHARE, HOT_ROWS = 1e-4, 1000


def shared_dir(spark) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; without it, one in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: computed once, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small tables of iterative jobs."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """left joined on keys with right, which has a row for each key and in `n` the key's number of rows in left.

    A hot key is dealt over tasks in proportion to its rows: left by a hash of `spread`, right's row to each of them. Hot
    keys and all copies of their rows number 2 / HOT_SHARE at most, so that the list of them is safe to broadcast.
    """
    right = stored(right)
    total = right.agg(F.sum("n")).first()[0] or 0
    most = max(float(HOT_ROWS), HOT_SHARE * total)
    hot = F.broadcast(right.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(F.lit(3), *spread), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    parts = F.when(F.col("n") > most, F.ceil(F.col("n") / most).cast("int")).otherwise(1)
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    # a merge join at every size: a right side that is small today would be broadcast, and take another way when it grows
    return dealt.join(copies.hint("merge"), [*keys, "_part"], how).drop("_part")


def row_key(df: DataFrame) -> dict[str, Column]:
    """128 bits over all cells of a row, as columns _row_a and _row_b; rows that are equal in every column share them."""
    plain = {f.name: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields}
    cells = [x for c in plain.values() for x in (c.isNull(), c)]
    return {"_row_a": F.xxhash64(*cells), "_row_b": F.xxhash64(F.lit(1), *reversed(cells))}


def chosen(key: Column, rate: float) -> Column:
    """True for about `rate` of all keys, by a 63-bit hash; null keys count too."""
    if rate >= 1:
        return F.lit(True)
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(int(rate * (1 << 63)))


def ascii_lower(text: Column) -> Column:
    """Null becomes the empty text; only A-Z change."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels must not be learned from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array, without a copy; null rows are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = 1 << 21):
    """Row ranges of about `most` bytes; a longer row stands alone and whole."""
    start, n = 0, len(at) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
