"""Metrics, validation and models of the ranker and the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running


def ranking_metrics(rows: DataFrame, by: list[str], score: str, truth: str, tie: str) -> DataFrame:
    """One row: groups, top-1 accuracy and mean NDCG; groups without a true row count 0."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    ideal = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col(truth).cast("int")), tie))
    hit = F.col(truth).cast("int")
    gains = rows.withColumn("_p", place).withColumn("_i", ideal).groupBy(by).agg(F.max(F.when(F.col("_p") == 1, hit).otherwise(0)).alias("top"), F.sum(hit / F.log2(F.col("_p") + 1)).alias("dcg"), F.sum(hit / F.log2(F.col("_i") + 1)).alias("idcg"))
    ndcg = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    return gains.agg(F.count("*").alias("n_groups"), F.avg("top").alias("accuracy"), F.avg(ndcg).alias("ndcg"))


def binary_metrics(rows: DataFrame, score: str, truth: str, cut: float = 0.5) -> DataFrame:
    """One row: confusion counts, precision, recall, F1 and the area under the curve, by mean ranks of equal scores; null
    where a share has no denominator."""
    per = rows.groupBy(score).agg(F.sum(F.col(truth).cast("int")).alias("pos"), F.sum(1 - F.col(truth).cast("int")).alias("neg"))
    ranked = running(per, [score], F.col("neg"), "_upto").withColumn("_b", F.col("_upto") - F.col("neg"))
    area = ranked.agg(F.sum(F.col("pos") * (F.col("_b") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    positive, true = F.col(score) >= cut, F.col(truth).cast("boolean")
    count = lambda c: F.sum(c.cast("int"))
    confusion = rows.agg(count(positive & true).alias("tp"), count(positive & ~true).alias("fp"), count(~positive & true).alias("fn"), count(~positive & ~true).alias("tn"))
    share = F.try_divide  # null where nothing is predicted, or true
    return confusion.join(area).select("tp", "fp", "fn", "tn", share("tp", F.col("tp") + F.col("fp")).alias("precision"), share("tp", F.col("tp") + F.col("fn")).alias("recall"), share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), share("wins", F.col("p") * F.col("n")).alias("auc"))


def confidence_histogram(rows: DataFrame, score: str) -> DataFrame:
    part = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    s = F.col(score)
    return rows.agg(part(s > 0.8)("high"), part((s >= 0.2) & (s <= 0.8))("middle"), part(s < 0.2)("low"))


def target_distribution(rows: DataFrame, target: str) -> DataFrame:
    total = F.broadcast(rows.agg(F.count("*").alias("_n")))  # one row
    return rows.groupBy(target).agg(F.count("*").alias("n")).join(total).select(target, "n", (100 * F.col("n") / F.col("_n")).alias("percent"))


def missing_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*(F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns))


def group_statistics(rows: DataFrame, group: str, truth: str) -> DataFrame:
    """One row: groups, their smallest, largest and mean size, and how many have no true row."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.max(F.col(truth).cast("int")).alias("t"))
    return per.agg(F.count("*").alias("n_groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"), F.sum((F.col("t") == 0).cast("int")).alias("without_truth"))


def validate(rows: DataFrame, features: tuple[str, ...], target: str, least: int = 10) -> list[str]:
    """What is wrong with a training set; empty if nothing is."""
    lost = [c for c in (*features, target) if c not in rows.columns]
    if lost:
        return [f"missing column {c}" for c in lost]
    stats = rows.agg(F.count("*").alias("_n"), *(F.sum(F.col(c).isNull().cast("int")).alias(c) for c in (*features, target)), *(F.count_distinct(c).alias(f"_d_{c}") for c in features)).first()
    wrong = [f"only {stats['_n']} rows"] if stats["_n"] < least else []
    wrong += [f"{stats[c]} nulls in {c}" for c in (*features, target) if stats[c]]
    return wrong + [f"{c} is constant" for c in features if stats["_n"] and stats[f"_d_{c}"] <= 1]


def boosted_trees(features: tuple[str, ...], target: str, rounds: int = 20, depth: int = 6, seed: int = 1):
    """A pipeline of assembled features and gradient-boosted trees. Rankers are trained pointwise on the correct sense;
    their raw score ranks within a group."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    trees = GBTClassifier(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), trees])


def cross_validated(rows: DataFrame, features: tuple[str, ...], target: str, fold: str, k: int = 5, **settings) -> DataFrame:
    """Out-of-fold predictions: (all columns, raw, score: the probability of 1); null where nothing is left to train on."""
    from functools import reduce

    from pyspark.ml.functions import vector_to_array

    parts = []
    for i in range(k):
        rest = rows.where(F.col(fold) != i)
        if rest.isEmpty():
            parts.append(rows.where(F.col(fold) == i).withColumns({"raw": F.lit(None).cast("double"), "score": F.lit(None).cast("double")}))
            continue
        out = boosted_trees(features, target, **settings).fit(rest).transform(rows.where(F.col(fold) == i))
        parts.append(out.withColumn("raw", vector_to_array("rawPrediction")[1]).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction"))
    return reduce(DataFrame.unionByName, parts)


def importances(model, features: tuple[str, ...]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: -x[1])
