"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Equal vectors are one entry with its six smallest ids, so a vector that fills a third of the table
is searched once. Entries go to the list of their nearest centroid. Inside a list vectors are
rotated at random and scanned in blocks of columns: after d of D columns a candidate is abandoned
when its partial distance, scaled to D, rejects at the confidence of ``EPSILON`` the hypothesis that
it is closer than the query's k-th best so far. Survivors are scored by exact cosine of the original
vectors in double precision. Lists and their queries are cut into tiles of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import col, stage

SAMPLE = 20_000        # vectors the centroids are fitted on and queries take their first bound from
LISTS = 4096           # at most so many lists
LIST_ROWS = 64         # and at least so many entries per list on average
PROBE_RECALL = 0.98    # share of the sample's neighbours that the probed lists must hold
TILE_ROWS, TILE_QUERIES = 4096, 512
COLUMNS = 16
EPSILON = 2.1


def dense(column, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors; lists that lose all their vectors are left out."""
    c = x[:: max(1, len(x) // lists)][:lists]
    for _ in range(rounds):
        near = np.concatenate([(x[i:i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros((len(c), x.shape[1]))
        np.add.at(total, near, x)
        c = units(total[np.abs(total).max(axis=1) > 1e-12])
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """Lists to probe so that the sample's own neighbours are found with PROBE_RECALL. A sample is
    sparser than the table, its neighbours lie farther away, so this errs on the safe side."""
    q = x[:: max(1, len(x) // 256)][:256]
    home = np.concatenate([(x[i:i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    near = np.argsort(-(q @ x.T), axis=1)[:, 1:k + 1]
    order = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(order, home[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(PROBE_RECALL * len(ranks)))]) + 1 if len(ranks) else 1


def scan(q: np.ndarray, c: np.ndarray, bound: float, k: int) -> np.ndarray:
    """Rows of ``c`` (rotated, as ``q``) that may be among the k nearest within ``bound``
    (squared distance). ``c`` is a list of column blocks."""
    rows, dim = len(c[0]), sum(b.shape[1] for b in c)
    found, at = np.zeros(0), np.zeros(0, dtype=np.int64)
    for lo in range(0, rows, 1024):
        alive = np.arange(lo, min(rows, lo + 1024))
        part, done = np.zeros(len(alive)), 0
        for block in c:
            d = block[alive] - q[done:done + block.shape[1]]
            part += np.einsum("ij,ij->i", d, d)
            done += block.shape[1]
            limit = bound if done == dim else bound * done / dim * (1 + EPSILON / math.sqrt(done)) ** 2
            keep = part <= limit + 1e-9
            alive, part = alive[keep], part[keep]
            if not len(alive):
                break
        if len(alive):
            found, at = np.concatenate([found, part]), np.concatenate([at, alive])
            if len(found) > k:
                bound = min(bound, float(np.partition(found, k - 1)[k - 1]) + 1e-9)
                at, found = at[found <= bound], found[found <= bound]
    return at


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines in double precision; a row's value does not depend on the other rows. Each vector is
    brought near 1 by a power of two first, which is exact, so that no square overflows or vanishes."""
    def near_one(x):
        return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])
    q, c = near_one(q), near_one(c)
    return (c * q).sum(axis=1) / (np.sqrt((c * c).sum(axis=1)) * np.sqrt((q * q).sum()))


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and their dimension: the most frequent one."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = (vectors.select(col(key).cast("long").alias("vec_id"), col(vector).alias("v"))
          .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))
                 & F.exists("v", lambda x: x != 0)))
    top = df.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = top["dim"] if top else 0
    return df.where(F.size("v") == dim), dim


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """For each row of ``vectors`` for which ``is_query`` (over the column vec_id) holds, its k
    nearest other rows found: query_id, rank (from 1), vec_id, score (cosine).

    Rows that are null, zero, or have null or non-finite components or no id take no part; nor do
    those of another dimension than most. Equal scores go by smaller id. Fewer candidates than k
    give fewer rows; an empty table gives none. Rows repeating an id count as one per distinct
    vector. Other columns, of any name, are ignored.
    """
    df, dim = usable(vectors, key, vector)
    spark, more = df.sparkSession, k + 1
    schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    df = df.withColumn("h", F.xxhash64("v"))
    smallest = Window.partitionBy("h", "v").orderBy("vec_id")
    entries = (df.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= more)
               .groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    entries = stage(entries.select(F.col("ids")[0].alias("entry"), "h", "v", "ids"), "vectors")
    queries = stage(df.where(is_query).select("vec_id", "h", "v").join(entries.select("h", "v", "entry"), ["h", "v"])
                    .select("vec_id", "entry").distinct(), "queries")
    asked = queries.select("entry").distinct().join(entries, "entry").select("entry", "v")

    total = entries.count()
    sample = entries.select("entry", "v").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).toArrow()
    x = units(dense(sample["v"], dim))
    c = centroids(x, max(1, min(LISTS, math.isqrt(total), total // LIST_ROWS)))
    probe = probes_needed(x, c, k)
    # A query's first bound is that of the sample's vectors in its probed lists, which the scan will
    # meet again; twice as many as needed, for some may be abandoned by chance.
    home, spare = (x @ c.T).argmax(axis=1), 2 * more
    turn = rotation(dim)
    vtype = entries.schema["v"].dataType.simpleString()

    def listed(batches):
        for b in batches:
            near = (units(dense(b.column("v"), dim)) @ c.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column("entry"), b.column("v")],
                                             names=["list", "entry", "v"])

    def probed(batches):
        for b in batches:
            u = units(dense(b.column("v"), dim))
            lists = np.argsort(-(u @ c.T), axis=1)[:, :probe]
            held_here = np.zeros((len(u), len(c)), dtype=bool)
            np.put_along_axis(held_here, lists, True, axis=1)
            far = np.sort(np.where(held_here[:, home], 2 - 2 * (u @ x.T), np.inf), axis=1)
            bound = far[:, spare - 1] + 1e-9 if len(x) >= spare else np.full(len(u), np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(lists), pa.list_(pa.int32())), pa.array(bound, pa.float64()), b.column("entry"),
                 b.column("v")], names=["lists", "bound", "entry", "v"])

    held = stage(entries.select("entry", "v").mapInArrow(listed, f"list int, entry long, v {vtype}"), "lists")
    asks = stage(asked.mapInArrow(probed, f"lists array<int>, bound double, entry long, v {vtype}")
                 .select(F.explode("lists").alias("list"), "bound", "entry", "v"), "probes")
    # At most LISTS rows: how many tiles a list has on either side.
    tiles = (held.groupBy("list").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("down"))
             .join(asks.groupBy("list").agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("across")), "list"))
    tiles = F.broadcast(stage(tiles, "tiles"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("entry"), F.col(n)).cast("int")
    left = held.join(tiles, "list").select("list", part("down").alias("row"), spread("across").alias("column"), "entry", "v")
    right = asks.join(tiles, "list").select("list", part("across").alias("column"), spread("down").alias("row"),
                                            "entry", "v", "bound")

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            v, ids = dense(rows["v"], dim), rows["entry"].to_numpy()
            turned = units(v) @ turn
            blocks = [np.ascontiguousarray(turned[:, i:i + COLUMNS]) for i in range(0, dim, COLUMNS)]
            w = dense(asked["v"], dim)
            for q, u, bound, e in zip(w, units(w) @ turn, asked["bound"].to_pylist(), asked["entry"].to_pylist(), strict=True):
                at = scan(u, blocks, bound, more)
                score = cosines(q, v[at])
                for i in np.lexsort((ids[at], -score))[:more]:
                    out.append((e, int(ids[at[i]]), float(score[i])))
        e, i, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"entry": pa.array(e, pa.int64()), "near": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    tile = ["list", "row", "column"]
    found = (left.groupBy(*tile).cogroup(right.groupBy(*tile))
             .applyInArrow(search, "entry long, near long, score double"))
    best = Window.partitionBy("entry").orderBy(F.desc("score"), "near")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= more)
    # Entries back to ids: at most (k + 1)^2 per asked vector, of which the first k + 1 count.
    lists = (found.join(entries.select(F.col("entry").alias("near"), "ids"), "near")
             .select("entry", F.col("score"), F.explode("ids").alias("vec_id"))
             .groupBy("entry").agg(F.slice(F.array_sort(F.collect_list(F.struct(
                 (-F.col("score")).alias("minus"), "vec_id"))), 1, more).alias("near")))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (queries.withColumnRenamed("vec_id", "query_id").join(lists, "entry")
            .select("query_id", F.posexplode(others).alias("n", "x"))
            .select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    (-F.col("x.minus")).alias("score")))
