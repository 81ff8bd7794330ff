"""Sharding by extendible hashing.

The directory is indexed by the first bits of a hash of the key. It starts with one bucket; as long
as a bucket holds more bytes than a shard may have, that bucket alone is split on its next hash bit.
Splits are decided on byte sums per hash prefix, which Spark adds up, never on documents; only where
the prefixes at hand are too short are the rows of the oversized buckets added up anew by longer
ones. Further bits end where all rows of a bucket share one hash. Such a bucket is chained into pages
by a running sum of bytes; so a shard exceeds the limit only if it is a single document that does.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import col, row_of, stage

LIMIT = 64 * 2 ** 20
LEAST_SHARDS = 64   # a table of fewer full shards gets a lower limit, its bytes over this number
BITS = 60           # bits of the hash
SPARE_BITS = 2      # the first prefixes are so many bits longer than evenly filled shards need
MORE_BITS = 8       # and those of an oversized bucket so many longer again


def assign(docs: DataFrame, limit: int | None = None, key: str = "doc_id", text: str = "text",
           carry_text: bool = False) -> DataFrame:
    """Row struct, id, bytes, hash, bucket (the prefix), all (its bytes), page, shard_bytes."""
    digest = F.md5(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary"))
    df = docs.select(row_of(docs, () if carry_text else (text,)).alias("row"), col(key).alias("id"),
                     F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long").alias("bytes"),
                     F.lpad(F.conv(F.substring(digest, 1, BITS // 4), 16, 2), BITS, "0").alias("hash"))
    total = df.agg(F.sum("bytes")).first()[0] or 0
    limit = limit or limit_for(total)
    deep, depth, levels, open_ = min(BITS, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS), 0, [], None
    while True:
        directory, open_ = _split(df, open_, depth, deep, limit, len(levels))
        levels.append((deep, directory))
        if open_ is None:
            break
        depth, deep = deep + 1, min(BITS, deep + MORE_BITS)
    left, placed = df, None
    for deep, directory in levels:
        met = left.withColumn("prefix", F.substring("hash", 1, deep)).join(directory, "prefix", "left").drop("prefix")
        here = met.where(F.col("bucket").isNotNull())
        placed = here if placed is None else placed.unionByName(here)
        left = met.where(F.col("bucket").isNull()).select(df.columns)
    if all(d.where((F.col("all") > limit) & (F.col("rows") > 1)).isEmpty() for _, d in levels):
        return placed.select("*", F.lit(0).cast("long").alias("page"), F.col("all").alias("shard_bytes"))
    return _chained(placed, limit)


def limit_for(total: int) -> int:
    """``LIMIT``, or what cuts a smaller table into ``LEAST_SHARDS`` shards if they fill evenly."""
    return max(1, min(LIMIT, -(-total // LEAST_SHARDS)))


def _split(df: DataFrame, open_: DataFrame | None, depth: int, deep: int, limit: int, nth: int):
    """Splits all rows, or those of the buckets in ``open_``, from ``depth`` down to ``deep`` bits. Returns
    the directory (prefix of ``deep`` bits, bucket, all, rows) and the buckets still too large, or None."""
    rows = df if open_ is None else df.withColumn("bucket", F.substring("hash", 1, depth - 1)).join(open_, "bucket", "left_semi")
    parts = stage(rows.groupBy(F.substring("hash", 1, deep).alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi")), f"prefixes-{nth}")
    # A bucket splits while it is too large and holds several hashes. The buckets of all depths are added
    # up at once; a prefix belongs to the first of its buckets, from short to long, that need not split.
    at = parts.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deep)))).withColumn(
        "bucket", F.expr("substring(prefix, 1, depth)"))
    sums = at.groupBy("bucket").agg(F.sum("bytes").alias("all"), F.sum("n").alias("rows"),
                                    F.min("lo").alias("least"), F.max("hi").alias("most"))
    final = (F.col("all") <= limit) | (F.col("least") == F.col("most"))
    first = F.min(F.when(final, F.struct("depth", "bucket", "all", "rows"))).alias("b")
    directory = stage(at.select("prefix", "depth", "bucket").join(sums, "bucket").groupBy("prefix").agg(first)
                      .select("prefix", "b.bucket", "b.all", "b.rows"), f"directory-{nth}")
    wide = directory.where(F.col("bucket").isNull()).select(F.col("prefix").alias("bucket"))
    return directory.where(F.col("bucket").isNotNull()), None if wide.isEmpty() else wide


def _chained(df: DataFrame, limit: int) -> DataFrame:
    """Buckets too large although all rows share one hash: a hot key. Their rows are dealt over chunks,
    each chunk is laid out by a running sum, and a page takes what starts in one half-limit of it;
    documents of more than half a limit have pages of their own. A rerun may deal them otherwise."""
    over = (F.col("all") > limit) & (F.col("rows") > 1)
    df = df.withColumn("chunk", F.when(over, F.pmod(
        F.xxhash64(F.monotonically_increasing_id()), F.ceil(2 * F.col("all") / limit))).otherwise(0))
    large = 2 * F.col("bytes") > limit
    line = Window.partitionBy("bucket", "chunk").orderBy("hash", "bytes").rowsBetween(Window.unboundedPreceding, 0)
    small = F.when(large, 0).otherwise(F.col("bytes"))
    start = F.floor((F.sum(small).over(line) - small) * 2 / limit)
    page = F.when(large, F.lit(1 << 31) + F.count("*").over(line)).otherwise(start)
    df = stage(df.withColumn("page", F.when(over, 1 + F.col("chunk") * F.lit(1 << 32) + page)
                             .otherwise(0).cast("long")), "paged")
    pages = df.groupBy("bucket", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return df.join(pages, ["bucket", "page"])


def shards(docs: DataFrame, limit: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, bytes, shard (hash prefix in bits, empty for a single shard),
    page, shard_bytes.

    ``limit`` is the bytes a shard may hold; without one it is 64 MiB, or a 64th of a smaller table's
    bytes, so that every table is split. Bytes are those of the text in UTF-8; null has none. Null keys
    share a hash. Pages of a key that many rows share may differ between runs; all else is
    repeatable. An empty table gives no rows; other columns, of any name, are ignored.
    """
    out = assign(docs.select(col(key), col(text)), limit, key, text)
    return out.select(F.col("id").alias(key), "bytes", F.col("bucket").alias("shard"), "page", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Parquet files under ``path``, one folder per shard; every shard is written by one task."""
    out = assign(docs, limit, key, text, carry_text=True)
    name = F.concat(F.lit("s"), "bucket", F.lit("-"), "page")
    (out.select("row.*", name.alias("_shard")).repartition("_shard")
     .write.partitionBy("_shard").parquet(path))
