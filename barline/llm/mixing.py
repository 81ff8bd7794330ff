"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule over training time t in [0, 1]. Its documents stand in a
line in hash order; the schedule's integral says how many words of that line are due by time t,
and its inverse gives each document the time at which it is due. A source whose target is larger
than its size starts over, at most once.

The line of a source is cut into hash slots: words are summed per (source, slot), the slots are
added up, and a running sum inside each slot does the rest, so that a source with a third of all
rows is spread over all slots.

The mix itself is one row per use of a document, sorted by time over sampled ranges: with whole texts
for training (``mixed``), or without them (``schedule``), from which ``mix_plan`` counts per document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import col, row_of, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
# Tilt of a source's schedule w(t) = 1 + tilt (1 - 2 t), by its rank: early, even, late.
TILTS = (0.5, 0.0, -0.5)
BUDGET = 1.5
REPEATS = 2


def targets(sizes: DataFrame) -> DataFrame:
    """(line, source, source_size) with target and tilt. The budget is shared by weight; a target stops
    at ``REPEATS`` times the source's size and the excess goes to the others by weight. One row
    per source, so the windows run over the list of sources only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))
    df = (sizes.withColumn("rank", rank).withColumn("weight", pick(WEIGHTS))
          .withColumn("tilt", pick(TILTS)))
    # Full sources are those with the least room per weight; in that order, `level` is what is
    # left per weight once all before are full, and the first source above it ends the filling.
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    df = (df.withColumn("place", F.row_number().over(fill))
          .withColumn("filled", F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * REPEATS)
          .withColumn("open", F.sum("weight").over(whole)
                      - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
          .withColumn("level", (F.sum("source_size").over(whole) * BUDGET - F.col("filled"))
                      / F.col("open"))
          .withColumn("full", F.col("source_size") * REPEATS <= F.col("level") * F.col("weight")))
    level = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(whole).getField("level")
    return df.select("line", "source", "source_size", "tilt", F.when(
        F.col("full"), F.col("source_size") * F.lit(float(REPEATS)))
        .otherwise(level * F.col("weight")).alias("target"))


def due(words: Column) -> Column:
    """Training time at which ``words`` of the source's target are due: the schedule's integral
    t + tilt (t - t^2) set equal to the share and solved for t."""
    a, share = F.col("tilt"), words / F.col("goal")
    t = 2 * share / ((1 + a) + F.sqrt(F.greatest((1 + a) * (1 + a) - 4 * a * share, F.lit(0.0))))
    return F.floor(t * 1e9 + 0.5) / 1e9


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text",
           source: str = "source", carry_text: bool = False) -> DataFrame:
    """Row struct and: size, source, source_size, target, first and second (words taken in the
    first and second pass), taken, position (time of the first use), position_2."""
    other = (() if carry_text else (text,))
    size = F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")
    digits = min(6, max(1, math.ceil(math.log(max(docs.count() / 2_000, 1), 16))))
    df = docs.select(row_of(docs, other).alias("row"), col(key).alias("id"),
                     col(source).cast("string").alias("source"), size.alias("size"),
                     F.md5(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")).alias("hash"))
    # The source as a key without nulls: rows that the window has placed by (line, slot) then meet
    # the offsets of their slot where they are.
    line = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source")))
    df = df.withColumn("line", line).withColumn("slot", F.substring("hash", 1, digits))
    if not carry_text:  # words are counted once; three passes read these few bytes a row
        df = stage(df, "sizes")
    slots = df.groupBy("line", "slot").agg(F.sum("size").alias("words"))
    before = slots.withColumn("before", F.sum("words").over(Window.partitionBy("line").orderBy("slot")) - F.col("words"))
    name = F.when(F.col("line") != "null", F.substr("line", F.lit(2)))
    sizes = slots.groupBy("line").agg(F.sum("words").alias("source_size")).withColumn("source", name)
    offsets = (before.select("line", "slot", "before").join(targets(sizes).drop("source"), "line")
               .withColumn("goal", F.floor("target")))
    inside = Window.partitionBy("line", "slot").orderBy("hash", "size")
    df = df.withColumn("own", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
                       - F.col("size"))
    df = df.join(offsets, ["line", "slot"])
    clip = lambda x: F.greatest(F.least(x, F.col("size")), F.lit(0))
    return (df.withColumn("place", F.col("before") + F.col("own"))
            .withColumn("first", clip(F.col("goal") - F.col("place")))
            .withColumn("second", clip(F.col("goal") - F.col("source_size") - F.col("place")))
            .withColumn("taken", F.col("first") + F.col("second"))
            .withColumn("position", F.when(F.col("first") > 0, due(F.col("place") + F.col("first") / 2)))
            .withColumn("position_2", F.when(F.col("second") > 0, due(
                F.col("source_size") + F.col("place") + F.col("second") / 2))))


def uses(df: DataFrame) -> DataFrame:
    """``assign``'s rows once per use of a document, with pass (1 or 2), words taken by that use and
    its training time ``at``; a document in no mix keeps one row, where these are null."""
    use = lambda n, words, at: F.struct(F.lit(n).alias("pass"), F.col(words).alias("words"), F.col(at).alias("at"))
    both = F.array(use(1, "first", "position"), use(2, "second", "position_2"))
    return df.select("*", F.inline_outer(F.filter(both, lambda u: u["words"] > 0)))


def in_order(df: DataFrame, at: str = "at") -> DataFrame:
    """Rows in training order: dealt over tasks by sampled ranges of time, sorted inside each.
    Ties, and rows without a time, which come last, are in hash order."""
    order = (F.col(at).asc_nulls_last(), F.col("hash"))
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text",
             source: str = "source") -> DataFrame:
    """The mix without its texts, as a written table in training order: one row per use of a document,
    with its words and time; documents in no mix stand behind it. ``line`` and ``place`` name a
    document that has words: its source and the words before it there."""
    df = uses(assign(docs.select(col(key), col(text), col(source)), key, text, source))
    return stage(in_order(df.select("id", "hash", "line", "place", "size", "source_size", "target",
                                    "pass", "words", "at")), "mix")


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text",
             source: str = "source") -> DataFrame:
    """One row per document: key, size, source_size, target, taken, position, position_2, counted
    from the mix (``schedule``) and in training order of the first use; documents in no mix come last.

    Size is the number of words (runs without white space); a null text has none and is never
    taken. Sources rank by code point, the null source last, and is a source of its own. Documents
    stand in the order of the MD5 of their key, then size; rows that repeat both are alike, so
    which of them comes first does not matter, and reruns agree. Only the document at the end of
    a target is taken in part. Words taken of a source add up to its target, rounded down. An
    empty table gives no rows; other columns, of any name, are ignored.
    """
    mix = schedule(docs, key, text, source)
    same = ["id", "hash", "size", "source_size", "target"]
    at = lambda n: F.max(F.when(F.col("pass") == n, F.col("at")))
    used = mix.where("pass IS NOT NULL").groupBy("line", "place", *same).agg(
        F.sum("words").alias("taken"), at(1).alias("position"), at(2).alias("position_2"))
    none = F.lit(None).cast("double")
    out = used.drop("line", "place").unionByName(mix.where("pass IS NULL").select(
        *same, F.lit(0).cast("long").alias("taken"), none.alias("position"), none.alias("position_2")))
    return in_order(out, "position").select(F.col("id").alias(key), "size", "source_size", "target",
                                            "taken", "position", "position_2")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """The documents of the mix in training order, with the columns of ``docs``: once or twice
    each, always whole. The document at the end of a target stays if at least half of it is due."""
    df = uses(assign(docs, key, text, source, carry_text=True).where("taken > 0"))
    return in_order(df.where("2 * words >= size").select("row", "hash", "at")).select("row.*")
