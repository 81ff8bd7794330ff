"""Exact deduplication by content sort.

Sampled splitters range-partition the texts, an external sort inside each partition puts equal
texts side by side, and every row is compared in full with its neighbour. The splitters are taken
from (first bytes, hash), never from whole texts, so that what the driver samples stays small; the
hash also keeps texts that share a beginning apart.

A text with very many copies would fill one partition. Such texts are found by a count per hash
first (16 bytes a row, summed before the shuffle) and their copies are dealt over runs of about
``run_rows`` rows, by key and place in the input, so that rows that repeat the key too are dealt as well. The heads of these runs, at most two per ``run_rows`` rows, are joined
again by their SHA-256.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import col, row_of, stage


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", carry_text: bool = False,
           heads_only: bool = False, run_rows: int = 128, hot_texts: int = 200_000) -> DataFrame:
    """Row struct, decision columns and, if asked for, the text. ``heads_only`` leaves out rows
    that certainly do not stay. ``hot_texts`` bounds the broadcast list of split texts: a text is
    split from total / hot_texts copies on, and there are fewer than ``hot_texts`` such texts."""
    df = docs.select(row_of(docs, (text,)).alias("row"), col(key).alias("id"),
                     F.coalesce(col(text), F.lit("")).alias("body"),
                     col(text).isNull().alias("absent")).withColumn("hash", F.xxhash64("body"))
    run = max(run_rows, math.ceil(docs.count() / hot_texts))
    hot = df.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > run)
    runs = F.ceil(F.col("n") / F.lit(run))
    df = (df.join(F.broadcast(hot), "hash", "left")
          .withColumn("salt", F.when(F.col("n").isNull(), F.lit(0).cast("long"))
                      .otherwise(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), runs)))
          .withColumn("start", F.substring("body", 1, 8)))
    equal = Window.partitionBy("start", "hash", "salt", "body")
    largest_first = equal.orderBy(F.col("id").desc_nulls_last())
    df = df.repartitionByRange("start", "hash", "salt").select(
        "row", "id", "body", "absent", "salt", F.col("n").isNotNull().alias("split"),
        F.row_number().over(largest_first).alias("place"),
        F.first("id").over(largest_first).alias("run_keep"),
        F.count("*").over(largest_first.rowsBetween(Window.unboundedPreceding,
                                                    Window.unboundedFollowing)).alias("run_size"))
    if heads_only:
        df = df.where("place = 1")
    df = df.withColumn("text_sha256", F.sha2("body", 256))
    df = stage(df if carry_text else df.drop("body", "absent"), "exact-runs")
    whole = (df.where("split AND place = 1").groupBy("text_sha256")
             .agg(F.max(F.struct("run_keep", "salt")).alias("keep"), F.sum("run_size").alias("size")))
    return (df.join(F.broadcast(whole), "text_sha256", "left")
            .withColumn("keep_id", F.when(F.col("size").isNull(), F.col("run_keep"))
                        .otherwise(F.col("keep.run_keep")))
            .withColumn("group_size", F.coalesce("size", "run_size"))
            .withColumn("kept", (F.col("place") == 1) & (F.col("size").isNull() | (F.col("salt") == F.col("keep.salt")))))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row per document, dropped ones too: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without any change; null counts as empty, so null and empty
    texts are one group. The row with the largest key stays. Rows repeating key and text count
    one by one and exactly one of a group is ``kept``; null keys sort below all others. An empty
    table gives no rows. Other columns of ``docs``, of any name, are ignored.
    """
    out = decide(docs.select(col(key), col(text)), key, text, **settings)
    return out.select(F.col("id").alias(key), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The kept rows with all columns of ``docs``, by the rules of :func:`exact_groups`. A null
    text that stays remains null."""
    out = decide(docs, key, text, carry_text=True, heads_only=True, **settings).where("kept")
    body = F.when(~F.col("absent"), F.col("body")).alias(text)
    return out.select(*[body if c == text else F.col("row").getField(c) for c in docs.columns]
                      ).toDF(*docs.columns)
