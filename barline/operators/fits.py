"""Many fits over one assembled table, side by side.

Windows, folds, symbols and parameter choices each want a fit of their own. Their rows are imputed
and assembled once, in one table with a folder per group, and the fits run as concurrent jobs whose
small tasks share the executors. Splits follow time, never chance.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import scratch_path

PARALLEL = 8           # fits under way at once
SLICE_ROWS = 50_000    # rows of a group that share a file, so a large group is read by many tasks
LATE = "_late"         # rows a fit holds back to decide when to stop


def concurrently(spark: SparkSession, jobs: Sequence[Callable], parallel: int = PARALLEL) -> list:
    """The results of ``jobs``, run side by side; each keeps the session's properties and has a pool
    of its own, so that a FAIR scheduler lets no fit starve."""
    def in_pool(k, job):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{k % parallel}")
            return job()
        return inheritable_thread_target(spark)(run)
    with ThreadPoolExecutor(min(parallel, max(1, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(in_pool(k, job)) for k, job in enumerate(jobs)]]


def valued(name: str) -> Column:
    """A feature as a double, NaN as a missing value."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def imputer(means: dict[str, float | None], names: Sequence[str]) -> list:
    """MLlib trees take no missing values: the mean of the training rows stands in, or 0 for a
    feature that they lack altogether (a long window early in a series)."""
    fill = ", ".join(f"coalesce(nanvl(CAST(`{n}` AS DOUBLE), CAST(NULL AS DOUBLE)), {float(means.get(n) or 0.0)!r}D) AS `{n}__f`"
                     for n in names)
    return [SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__"),
            VectorAssembler(inputCols=[f"{n}__f" for n in names], outputCol="features", handleInvalid="keep")]


class Groups:
    """An assembled table: a folder per value of ``by``, each with features, label, ``_train`` and what
    is carried, and the means that filled its gaps."""

    def __init__(self, rows: DataFrame, names: Sequence[str], by: str, train: Column, carry: Sequence[str] = (),
                 label: str = "label", late: Column | None = None):
        self.spark, self.names, self.by = rows.sparkSession, list(names), by
        rows = rows.withColumns({"_train": F.coalesce(train, F.lit(False)),
                                 LATE: F.coalesce(late, F.lit(False)) if late is not None else F.lit(False)})
        per = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"), F.count(F.when(F.col("_train"), 1)).alias("_fitted"),
                                   *[F.avg(F.when(F.col("_train"), valued(n))).alias(n) for n in names])
        found = per.orderBy(by).collect()  # one row per fit
        self.values = [r[by] for r in found]
        self.means = {r[by]: r.asDict() for r in found}
        self.rows = {r[by]: (r["_rows"], r["_fitted"]) for r in found}
        means = per.select(by, "_rows", *[F.coalesce(n, F.lit(0.0)).alias(f"_m{i}") for i, n in enumerate(names)])
        full = rows.join(F.broadcast(means), by).select(  # one row per fit
            by, "_train", LATE, F.col(label).cast("double").alias(label), *carry, "_rows",
            *[F.coalesce(valued(n), F.col(f"_m{i}")).alias(f"_f{i}") for i, n in enumerate(names)])
        full = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(names))], outputCol="features").transform(full)
        slices = F.pmod(F.xxhash64(*[F.col(f"_f{i}") for i in range(min(4, len(names)))]), F.ceil(F.col("_rows") / SLICE_ROWS))
        self.path = scratch_path(self.spark, "assembled")
        (full.withColumn("_slice", slices).repartition(by, "_slice")
         .drop("_slice", "_rows", *[f"_f{i}" for i in range(len(names))]).write.partitionBy(by).parquet(self.path))

    def part(self, value) -> DataFrame:
        """The rows of one group; only its folder is read."""
        return self.spark.read.parquet(self.path).where(F.col(self.by) == F.lit(value))

    def whole_model(self, value, tree) -> PipelineModel:
        """A fitted tree behind the imputer of its group, for rows as they come."""
        return PipelineModel(stages=[*imputer(self.means[value], self.names), tree])


def boosted(train: DataFrame, label: str = "label", trees: int = 50, depth: int = 6, rate: float = 0.1, seed: int = 42,
            stop: bool = False, tolerance: float = 0.001, **params):
    """Boosted trees on assembled rows. With ``stop`` the rows marked late judge each round, and the model is
    cut at the round from which their loss no longer falls by ``tolerance``."""
    if stop:
        params |= {"validationIndicatorCol": LATE, "validationTol": tolerance}
    return GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, **params).fit(train)


def scored(model, rows: DataFrame) -> DataFrame:
    """Class, both probabilities, confidence, and score 2 * class - 1."""
    out = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    return (out.withColumn("predicted", F.col("prediction").cast("int"))
            .withColumn("probability_up", F.col("_p")[1])
            .withColumn("confidence", F.greatest(F.col("_p")[0], F.col("_p")[1]))
            .withColumn("score", F.col("prediction") * 2 - 1)
            .drop("_p", "probability", "rawPrediction", "prediction", "features"))


def fit_groups(groups: Groups, keep: Sequence[str], label: str = "label", parallel: int = PARALLEL, stop: bool = False, **params):
    """One fit per group on its training rows: {value: model}, and the other rows of all groups scored,
    as a written table with the group's column and ``keep``. A group whose training rows have one class
    only predicts that class."""
    path = scratch_path(groups.spark, "group-scores")

    def job(value):
        def run():
            part = groups.part(value)
            train = part.where("_train")
            low, high, late, all_ = train.agg(F.min(label), F.max(label), F.count(F.when(F.col(LATE), 1)), F.count(F.lit(1))).first()
            held = part.where("NOT _train")
            if low is None or low == high:
                model, out = None, held.withColumns({"predicted": F.lit(low).cast("int"), "probability_up": F.lit(low).cast("double")})
            else:
                # without rows to judge by, or to fit on beside them, all rounds are made
                model = boosted(train, label, stop=True, **params) if stop and 0 < late < all_ else boosted(train, label, **params)
                out = scored(model, held)
            out.select(groups.by, *keep, "predicted", "probability_up").write.mode("append").parquet(f"{path}/{value_name(value)}")
            return model
        return run
    models = concurrently(groups.spark, [job(v) for v in groups.values], parallel)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.part(groups.values[0]).select(groups.by, *keep).schema) \
        if groups.values else f"`{groups.by}` string"
    schema += ", predicted int, probability_up double"
    scores = (groups.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if groups.values
              else groups.spark.createDataFrame([], schema))
    return dict(zip(groups.values, models, strict=True)), scores


def value_name(value) -> str:
    return "g-" + "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in str(value))


# ---- parameter search ------------------------------------------------------------------------

# Range of each of the nine parameters, and whether it is drawn on a logarithmic scale.
SPACE = {"trees": (20, 60, False), "depth": (3, 7, False), "rate": (0.01, 0.3, True), "minInstancesPerNode": (1, 30, True),
         "subsamplingRate": (0.6, 1.0, False), "featureSubsetStrategy": (0.3, 1.0, False), "minInfoGain": (1e-6, 0.01, True),
         "maxBins": (16, 64, False), "minWeightFractionPerNode": (1e-6, 0.02, True)}
WHOLE = ("trees", "depth", "minInstancesPerNode", "maxBins")


def drawn(n: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """``n`` choices from the space. The same seed draws the same choices."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        choice = {}
        for name, (low, high, log) in (space or SPACE).items():
            x = math.exp(rng.uniform(math.log(low), math.log(high))) if log else rng.uniform(low, high)
            choice[name] = int(round(x)) if name in WHOLE else str(round(x, 2)) if name == "featureSubsetStrategy" else float(f"{x:.6g}")
        out.append(choice)
    return out


def rungs(n: int, keep: int = 3, first_trees: int = 2) -> list[tuple[int, int | None]]:
    """(choices, trees) per rung: each keeps one in ``keep`` and grows ``keep`` times as many trees; the
    last one fits its choices in full (None)."""
    out, trees = [], first_trees
    while n > keep:
        out.append((n, trees))
        n, trees = -(-n // keep), trees * keep
    return [*out, (n, None)]


def halving_search(groups: Groups, value, choices: Sequence[dict], keep: int = 3, first_trees: int = 2,
                   parallel: int = PARALLEL, label: str = "label") -> list[dict]:
    """Successive halving: all choices with few trees first; the most accurate on the later rows go on to
    more, and the last rung fits its choices with their own number of trees. One entry per choice and
    rung, best of the last rung first: choice, rung, trees, accuracy, survives, params."""
    rows = groups.part(value)
    train, held = rows.where("_train"), rows.where("NOT _train")
    alive, out = list(range(len(choices))), []
    plan = rungs(len(choices), keep, first_trees)
    for r, (_, trees) in enumerate(plan):
        def job(i):
            size = choices[i]["trees"] if trees is None else min(trees, choices[i]["trees"])
            params = {k: v for k, v in choices[i].items() if k != "trees"}

            def run():
                model = boosted(train, label, trees=size, **params)
                hit = model.transform(held).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
                return size, float(hit or 0.0)
            return run
        found = concurrently(groups.spark, [job(i) for i in alive], parallel)
        ranked = sorted(zip(alive, found, strict=True), key=lambda x: (-x[1][1], x[0]))
        left = plan[r + 1][0] if r + 1 < len(plan) else 1
        out = [{"choice": i, "rung": r, "trees": size, "accuracy": hit, "survives": k < left, "params": choices[i]}
               for k, (i, (size, hit)) in enumerate(ranked)] + out
        alive = sorted(i for i, _ in ranked[:left])
    return out
