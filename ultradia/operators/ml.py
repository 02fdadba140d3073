"""Models on the feature tables: principal components, forests, boosted trees. Spark fits them over all rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``features``; rows with a null or NaN in a column are left out."""
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


def principal_components(df: DataFrame, columns: Sequence[str], k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with pc1 to pck, share of variance of each, loadings columns x k): centred, signs such that the largest loading of each is positive."""
    rows = assembled(df, columns)
    centred = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="centred", outputCol="pcs").fit(centred)
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    scores = model.transform(centred).withColumn("_pcs", vector_to_array("pcs"))
    scores = scores.select(*df.columns, *[(F.col("_pcs")[i] * F.lit(float(sign[i]))).alias(f"pc{i + 1}") for i in range(k)])
    return scores, model.explainedVariance.toArray(), loadings * sign


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2) -> DataFrame:
    """Adds is_test: the first ``test`` share of each class in hashed order of the key; the same for any partitioning.

    Decided by the hash value itself, so no class is sorted or counted.
    """
    share = F.pmod(F.xxhash64(key, F.lit("split")), F.lit(1_000_000)) < int(test * 1_000_000)
    return df.where(F.col(label).isNotNull()).withColumn("is_test", share)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: n / (classes x n of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(counts.crossJoin(F.broadcast(total)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def forest(df: DataFrame, columns: Sequence[str], target: str, key: str, trees: int = 50, depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """(predictions of the test rows: key, target, predicted; importances: feature, importance, position)."""
    rows = assembled(stratified_split(df, target, key), columns)
    indexer = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    rows = indexer.transform(rows)
    model = RandomForestClassifier(labelCol="_label", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=42).fit(rows.where("not is_test"))
    labels = F.array(*[F.lit(x) for x in indexer.labels])
    tested = model.transform(rows.where("is_test")).select(key, target, F.element_at(labels, (F.col("prediction") + 1).cast("int")).alias("predicted"))
    return tested, _importances(df, columns, model.featureImportances.toArray())


def _importances(df: DataFrame, columns: Sequence[str], values: np.ndarray) -> DataFrame:
    found = df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, values)], "feature string, importance double")
    return found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def class_measures(predictions: DataFrame, target: str) -> DataFrame:
    """One row: n, accuracy, and precision, recall and f1 weighted by class, from the table of counts."""
    cells = predictions.groupBy(F.col(target).alias("t"), F.col("predicted").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hits = cells.where("t = p").select("t", F.col("n").alias("hit"))
    real = cells.groupBy("t").agg(F.sum("n").alias("real"))
    said = cells.groupBy(F.col("p").alias("t")).agg(F.sum("n").alias("said"))
    per = real.join(said, "t", "left").join(hits, "t", "left").na.fill(0)
    precision, recall = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("said").cast("double")), F.lit(0.0)), F.col("hit") / F.col("real").cast("double")
    per = per.withColumn("precision", precision).withColumn("recall", recall)
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    w = F.col("real")
    return per.agg(F.sum(w).alias("n"), (F.sum("hit") / F.sum(w)).alias("accuracy"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in ("precision", "recall", "f1")])


def boosted(df: DataFrame, columns: Sequence[str], label: str, key: str, rounds: int = 20, depth: int = 4) -> DataFrame:
    """Binary label (0, 1) by boosted trees with balanced weights, split by key: key, label, predicted, probability of the test rows."""
    rows = balanced_weights(assembled(stratified_split(df, label, key), columns), label)
    model = GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=42).fit(rows.where("not is_test"))
    return model.transform(rows.where("is_test")).select(key, label, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("probability"))


def regression_folds(df: DataFrame, columns: Sequence[str], label: str, group: str, folds: int = 3, trees: int = 30, depth: int = 10) -> DataFrame:
    """fold, n, mae, rmse, r2 of a regression forest; the rows of a group are in one fold."""
    rows = assembled(df.where(F.col(label).isNotNull()), columns).withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")).withColumn("_y", F.col(label).cast("double"))
    out = None
    for fold in range(folds):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        if train.isEmpty() or test.isEmpty():
            continue
        model = RandomForestRegressor(labelCol="_y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=42).fit(train)
        err = model.transform(test).withColumn("_e", F.col("prediction") - F.col("_y"))
        m = err.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), (1 - F.try_divide(F.avg(F.col("_e") * F.col("_e")), F.var_pop("_y"))).alias("r2"))
        m = m.select(F.lit(fold).alias("fold"), "*")
        out = m if out is None else out.unionByName(m)
    if out is None:
        return df.sparkSession.createDataFrame([], "fold int, n bigint, mae double, rmse double, r2 double")
    return out
