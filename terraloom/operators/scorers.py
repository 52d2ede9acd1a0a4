"""A store of fitted scorers: versions with their held-out scores, and which of them is in service.

The store is a folder of two tables that are only added to. ``versions`` has one row for each fitted scorer: its
weights and the names of its inputs. ``service`` is the log of promotions, one row for each, numbered upwards; the last row of a task
names the version in service. A promotion is one written row, which readers see whole or not at all, so a job that fails
before it leaves the former version in service, and a job that is run again writes the same decision once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from terraloom.operators import scene as sc
from terraloom.operators import skill as sk
from terraloom.operators import spectral as sp

VERSIONS = "task string, version string, features array<string>, weights array<array<double>>, bias array<double>"
SERVICE = "task string, no long, version string, accuracy double, grouped_accuracy double, replaced string"


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of the store; an empty one before the first row is written."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def save(spark: SparkSession, path: str, task: str, version: str, features: list[str], weights: list[list[float]], bias: list[float]) -> None:
    """Store a fitted scorer. A version that is there already stays as it is: versions are never changed."""
    known = _table(spark, path, "versions", VERSIONS).filter((F.col("task") == task) & (F.col("version") == version))
    if known.isEmpty():
        spark.createDataFrame([(task, version, features, weights, bias)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def in_service(spark: SparkSession, path: str) -> DataFrame:
    """One row for each task: its version in service and the scores it was promoted with."""
    log = _table(spark, path, "service", SERVICE)
    last = F.max(F.struct("no", "version", "accuracy", "grouped_accuracy", "replaced")).alias("_l")
    return log.groupBy("task").agg(last).select("task", "_l.*")


def score(spark: SparkSession, path: str, task: str, version: str, rows: DataFrame) -> Column:
    """The class that a stored version gives rows which have its features."""
    v = _table(spark, path, "versions", VERSIONS).filter((F.col("task") == task) & (F.col("version") == version)).first()
    if v is None:
        raise ValueError(f"the store has no version {version} of {task}")
    return sp.argmax(sc.linear_scorer(v.weights, v.bias)(F.array(*[rows[f] for f in v.features])))


def held_out_scores(rows: DataFrame, label: str, preds: dict[str, Column], groups: int = 5) -> DataFrame:
    """(role, accuracy, grouped_accuracy, n) of several predictions of the same rows, in one pass. Grouped accuracy folds
    classes to ``groups`` remainders."""
    long = rows.select(F.col(label).alias("_t"), F.explode(F.array(*[F.struct(F.lit(k).alias("role"), p.cast("int").alias("pred")) for k, p in preds.items()])).alias("_p"))
    hit = (F.col("_t") == F.col("_p.pred")).cast("double")
    near = (F.pmod("_t", F.lit(groups)) == F.pmod(F.col("_p.pred"), F.lit(groups))).cast("double")
    return long.groupBy("_p.role").agg(F.avg(hit).alias("accuracy"), F.avg(near).alias("grouped_accuracy"), F.count(F.lit(1)).alias("n"))


def challenge(spark: SparkSession, path: str, task: str, version: str, held_out: DataFrame, label: str) -> DataFrame:
    """Score a stored version beside the one in service on rows that neither was fitted on, and put it into service if
    its pair of accuracies is greater. A first version is put into service at once; one that is in service is scored and stays.

    Returns (task, role, version, accuracy, grouped_accuracy, n, promote)."""
    now = in_service(spark, path).filter(F.col("task") == task).first()
    preds = {"challenger": score(spark, path, task, version, held_out)}
    if now is not None:
        preds["champion"] = score(spark, path, task, now.version, held_out)
    scored = held_out_scores(held_out, label, preds).withColumn("task", F.lit(task)).collect()  # a row for each role
    table = spark.createDataFrame(scored) if scored else None
    if table is None:  # nothing was held out: nothing shows that the new version is better
        return spark.createDataFrame([], "task string, role string, version string, accuracy double, grouped_accuracy double, n long, promote boolean")
    wins = bool(sk.promote(table).first().promote) and (now is None or now.version != version)
    if wins:
        mine = next(r for r in scored if r.role == "challenger")
        row = (task, 1 if now is None else now.no + 1, version, mine.accuracy, mine.grouped_accuracy, None if now is None else now.version)
        spark.createDataFrame([row], SERVICE).coalesce(1).write.mode("append").parquet(f"{path}/service")
    named = F.when(F.col("role") == "challenger", F.lit(version)).otherwise(F.lit(None if now is None else now.version))
    return table.select("task", "role", named.alias("version"), "accuracy", "grouped_accuracy", "n", F.lit(wins).alias("promote"))
