"""What the operators of this package share: tables, stage boundaries, folds, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import checkpoint_root
from barline.sources.stored import stage  # noqa: F401

# Rows of an Arrow batch; documents can be long, so a batch stays at a few megabytes as a rule.
BATCH_ROWS = 256


def ready(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on."""
    checkpoint_root(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All other columns of a row as one struct, so that no name of theirs can clash with ours."""
    kept = [col(c) for c in df.columns if c not in without]
    return F.struct(*kept) if kept else F.struct(F.lit(0).alias("_"))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text, modulo ``folds``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents as (id, label, body): those with the smallest hash of
    their key among the labels that ``keep`` admits. Only this bounded list of ids is broadcast.
    An id that several rows share counts once, with the text of smallest hash (ties are equal
    texts); tasks keep one text per admitted id before anything is shuffled. An id with several
    labels has the largest; null ids and labels take no part."""
    ids = (labels.where(keep & col(key).isNotNull() & col(label).isNotNull())
           .groupBy(col(key).alias("id")).agg(F.max(col(label).cast("int")).alias("label"))
           .orderBy(F.xxhash64("id"), "id").limit(rows))
    return (docs.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("body"))
            .join(F.broadcast(ids), "id").groupBy("id")
            .agg(F.max("label").alias("label"), F.min_by("body", F.xxhash64("body")).alias("body")))
