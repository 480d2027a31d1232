"""Models from the built-in library: k-means, bisecting trees, components, forests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="_features").transform(df)


def kmeans(df: DataFrame, columns: Sequence[str], k: int, seed: int = 1, bisecting: bool = False) -> DataFrame:
    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, featuresCol="_features", predictionCol="cluster")
    data = _assembled(df, columns)
    return model.fit(data).transform(data).drop("_features")


def nearest_centre(columns: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """The number of the nearest centre, the smaller on a tie."""
    gaps = [F.struct(sum(((F.col(c).cast("double") - F.lit(float(v))) ** 2 for c, v in zip(columns, centre)), F.lit(0.0)).alias("d"), F.lit(k).alias("k")) for k, centre in enumerate(centres)]
    return F.array_min(F.array(*gaps))["k"]


def lloyd(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]], rounds: int = 10) -> DataFrame:
    """``df`` with ``cluster``: k-means from stated centres, one aggregation a round; an empty cluster keeps its centre."""
    now = [list(map(float, c)) for c in centres]
    for _ in range(rounds):
        rows = df.groupBy(nearest_centre(columns, now).alias("k")).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).collect()  # one row a cluster
        moved = [list(c) for c in now]
        for r in rows:
            moved[r["k"]] = [r[c] for c in columns]
        if moved == now:
            break
        now = moved
    return df.withColumn("cluster", nearest_centre(columns, now))


def principal_components(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    data = _assembled(df, columns)
    out = PCA(k=k, inputCol="_features", outputCol="_pc").fit(data).transform(data).withColumn("_a", vector_to_array("_pc"))
    return out.select(*df.columns, *(F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)))


def importances(df: DataFrame, columns: Sequence[str], label: str, seed: int = 1, trees: int = 30) -> dict[str, dict[str, float]]:
    """One forest against the rest for each class: how much each column matters."""
    data, out = _assembled(df, columns), {}
    for row in df.select(label).distinct().orderBy(label).collect():  # one row a class
        one = data.withColumn("_y", (F.col(label) == row[0]).cast("double"))
        model = RandomForestClassifier(featuresCol="_features", labelCol="_y", numTrees=trees, seed=seed).fit(one)
        out[str(row[0])] = dict(zip(columns, model.featureImportances.toArray().tolist()))
    return out


def predict_class(df: DataFrame, columns: Sequence[str], label: str, seed: int = 1, trees: int = 30) -> DataFrame:
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df)
    data = _assembled(indexer.transform(df), columns)
    model = RandomForestClassifier(featuresCol="_features", labelCol="_y", numTrees=trees, seed=seed).fit(data)
    names = F.array(*map(F.lit, indexer.labels))
    return model.transform(data).withColumn("predicted", names[F.col("prediction").cast("int")]).select(*df.columns, "predicted")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Accuracy and Cohen's kappa of two labelings, as one row."""
    table = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n")).collect()
    total = sum(r.n for r in table)
    rows, cols = {}, {}
    for r in table:
        rows[r.a], cols[r.b] = rows.get(r.a, 0) + r.n, cols.get(r.b, 0) + r.n
    same = sum(r.n for r in table if r.a == r.b) / total
    chance = sum(v * cols.get(k, 0) for k, v in rows.items()) / total**2
    return df.sparkSession.createDataFrame([(same, (same - chance) / (1 - chance) if chance < 1 else 1.0)], "accuracy double, kappa double")
