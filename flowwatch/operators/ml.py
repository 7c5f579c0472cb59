"""Learning layer (G1-G8, F6, H4, B7) on Spark ML.

* Scaler (G3): mean and *population* std of each feature from one aggregate
  row; constant features get scale 1.  Applied as literal expressions
  (code-generated), so scoring needs no Python worker.
* Split (G4): deterministic hash split; stratified with exact per-label test
  counts, found from a 65,536-bucket histogram of the hash (no per-label sort
  of all rows).
* Forest (G6): ``RandomForestClassifier`` with 100 trees, seed 42, balanced
  class weights (G5), sqrt feature subsets.
* K-means (G8): best ``trainingCost`` of 10 seeded restarts.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.functions import scrub
from flowwatch.operators.rules import weak_label

SCALED = [f"{c}_z" for c in C.FEATURE_COLS]


def scrub_features(df: DataFrame) -> DataFrame:
    """C11 over the whole feature list in one projection."""
    return df.select(*[scrub(c).alias(c) if c in C.FEATURE_COLS else F.col(c) for c in df.columns])


def with_weak_label(flows: DataFrame) -> DataFrame:
    """G1."""
    return flows.withColumn("label", weak_label())


# ---------------------------------------------------------------------------
# G3 scaler
# ---------------------------------------------------------------------------

def fit_scaler(df: DataFrame) -> dict:
    """Mean / population std per feature (one aggregate row; bounded model)."""
    aggs = []
    for c in C.FEATURE_COLS:
        x = scrub(c)
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = df.agg(*aggs).first().asDict()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0)) for c in C.FEATURE_COLS}


def apply_scaler(df: DataFrame, scaler: dict) -> DataFrame:
    cols = []
    for c in C.FEATURE_COLS:
        mean, std = scaler[c]
        cols.append(((scrub(c) - F.lit(mean)) / F.lit(std if std != 0 else 1.0)).alias(f"{c}_z"))
    return df.select("*", *cols)


def scaled_features_exact(df: DataFrame) -> DataFrame:
    """G3 as a single distributed plan (stats as one scalar subquery)."""
    stats = df.agg(F.struct(*[F.avg(scrub(c)).alias(f"m_{c}") for c in C.FEATURE_COLS],
                            *[F.stddev_pop(scrub(c)).alias(f"s_{c}") for c in C.FEATURE_COLS]).alias("stats")).scalar()
    j = df.withColumn("_stats", stats)
    out = []
    for c in C.FEATURE_COLS:
        s = F.col(f"_stats.s_{c}")
        out.append(((scrub(c) - F.col(f"_stats.m_{c}")) / F.when(s == 0, F.lit(1.0)).otherwise(s)).alias(f"{c}_z"))
    keep = [c for c in df.columns if c not in C.FEATURE_COLS]
    return j.select(*keep, *out)


# ---------------------------------------------------------------------------
# G4 split, G5 weights
# ---------------------------------------------------------------------------

def _hash(key_cols: list[str], seed: int) -> F.Column:
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols])
    return F.md5(F.concat(key, F.lit(f"#{seed}")))


def train_test_split(df: DataFrame, key_cols: list[str], label: str = "label",
                     test_frac: float = 0.2, seed: int = 42, stratify: bool = True,
                     materialize: bool = True) -> DataFrame:
    """Adds ``is_test``.  Stratified: per label exactly ``round(frac * n_label)``
    rows with the smallest hashes; plain (or when a label has < 2 rows): hash
    below ``frac`` of the hash range.  The stratified/plain choice is made in
    the plan (a one-row aggregate), not on the driver.

    The stratified form reads its input several times (histogram, boundary,
    rows); with ``materialize`` the input is checkpointed once to the shared
    checkpoint folder so upstream work (flow features) is not recomputed.
    """
    h = _hash(key_cols, seed)
    df = df.withColumn("_h", h)
    if stratify and materialize:
        df = df.checkpoint(eager=True)
    plain_cut = format(int(test_frac * 0xFFFFFFFF), "08x")
    plain = F.substring("_h", 1, 8) < F.lit(plain_cut)
    if not stratify:
        return df.withColumn("is_test", plain).drop("_h")
    df = df.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    hist = df.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wl = Window.partitionBy(label)
    wc = wl.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (hist.withColumn("_cum", F.sum("_c").over(wc))
            .withColumn("_n", F.sum("_c").over(wl))
            .withColumn("_k", F.round(F.col("_n") * F.lit(test_frac)).cast("bigint")))
    # smallest class size decides stratified vs plain (scalar subquery, no driver action)
    smallest = hist.groupBy(label).agg(F.sum("_c").alias("_n")).agg(F.min("_n")).scalar()
    # boundary bucket per label: first bucket whose cumulative count reaches k
    bound = (hist.filter(F.col("_cum") >= F.col("_k"))
             .groupBy(label).agg(F.min(F.struct("_b", "_cum", "_c", "_k")).alias("_s"))
             .select(label, F.col("_s._b").alias("_bb"),
                     (F.col("_s._k") - (F.col("_s._cum") - F.col("_s._c"))).alias("_need")))
    # one row per label, broadcast: a shuffle by label would put a label's rows, here nearly all, in one task
    df = df.join(F.broadcast(bound), label, "left")
    # rank only the boundary bucket's rows (bounded by N / 65536 per label)
    wb = Window.partitionBy(label, "_b").orderBy("_h")
    inb = df.filter(F.col("_b") == F.col("_bb")).withColumn("_rn", F.row_number().over(wb))
    rest = df.filter(F.col("_bb").isNull() | (F.col("_b") != F.col("_bb"))).withColumn("_rn", F.lit(None).cast("int"))
    allr = inb.unionByName(rest)
    strat = (F.col("_bb").isNotNull() &
             ((F.col("_b") < F.col("_bb")) | ((F.col("_b") == F.col("_bb")) & (F.col("_rn") <= F.col("_need")))))
    is_test = F.when(smallest < 2, plain).otherwise(strat)
    return allr.withColumn("is_test", is_test).drop("_h", "_b", "_bb", "_need", "_rn")


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` from the training split."""
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n, k = per.agg(F.sum("n_c")).scalar(), per.agg(F.count(F.lit(1))).scalar()
    return per.select(label, "n_c", (n / (k * F.col("n_c"))).alias("weight"))


# ---------------------------------------------------------------------------
# G6/G7 forest, F6 scoring, H4 importances, B7 persistence
# ---------------------------------------------------------------------------

@dataclass
class FlowModel:
    scaler: dict
    pipeline: PipelineModel

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(os.path.join(path, "pipeline"))
        spark = _active()
        spark.createDataFrame([(json.dumps(self.scaler),)], "scaler string") \
            .write.mode("overwrite").json(os.path.join(path, "scaler"))

    @staticmethod
    def load(path: str) -> FlowModel:
        spark = _active()
        scaler = json.loads(spark.read.json(os.path.join(path, "scaler")).first()["scaler"])
        return FlowModel({k: tuple(v) for k, v in scaler.items()},
                         PipelineModel.load(os.path.join(path, "pipeline")))


@dataclass
class ClusterModel:
    """The unsupervised fallback: k-means and the scaler that its centres were fitted behind."""

    scaler: dict
    kmeans: KMeansModel

    def save(self, path: str) -> None:
        self.kmeans.write().overwrite().save(os.path.join(path, "kmeans"))
        _active().createDataFrame([(json.dumps(self.scaler),)], "scaler string") \
            .write.mode("overwrite").json(os.path.join(path, "scaler"))

    @staticmethod
    def load(path: str) -> ClusterModel:
        scaler = json.loads(_active().read.json(os.path.join(path, "scaler")).first()["scaler"])
        return ClusterModel({k: tuple(v) for k, v in scaler.items()}, KMeansModel.load(os.path.join(path, "kmeans")))

    def clusters(self, flows: DataFrame) -> DataFrame:
        data = VectorAssembler(inputCols=SCALED, outputCol="features").transform(apply_scaler(flows, self.scaler))
        return self.kmeans.transform(data).drop("features", *SCALED)


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def weighted(labelled: DataFrame, scaler: dict) -> DataFrame:
    """G3 + G5: scaled rows with their label's weight."""
    # one row per label, broadcast: rows shuffled by label would all be fitted in one task
    weights = F.broadcast(class_weights(labelled).select("label", "weight"))
    return apply_scaler(labelled, scaler).join(weights, "label")


def fit_forest(labelled: DataFrame, scaler: dict, num_trees: int = 100, max_depth: int = 30,
               seed: int = 42) -> FlowModel:
    """G5 + G6: weighted random forest on scaled features.

    Depth 30 is the most that the library's trees take (the original sets no bound)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                numTrees=num_trees, maxDepth=max_depth, featureSubsetStrategy="sqrt",
                                seed=seed, maxMemoryInMB=1024)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=SCALED, outputCol="features"), rf])
    return FlowModel(scaler, pipe.fit(weighted(labelled, scaler)))


def predict(model: FlowModel, flows: DataFrame) -> DataFrame:
    """Class + confidence (max class probability), one vectorised pass."""
    cols = flows.columns
    scored = model.pipeline.transform(apply_scaler(flows, model.scaler))
    return scored.select(*cols, F.col("prediction").cast("int").alias("prediction"),
                         F.array_max(vector_to_array("probability")).alias("model_confidence"))


def feature_importance(model: FlowModel) -> DataFrame:
    """H4: importance per feature, descending (18 rows; model metadata)."""
    imp = model.pipeline.stages[-1].featureImportances.toArray().tolist()
    return (_active().createDataFrame(list(zip(C.FEATURE_COLS, [float(v) for v in imp])),
                                      "feature string, importance double")
            .orderBy(F.col("importance").desc(), "feature"))


def fit_kmeans(flows: DataFrame, k: int = 3, restarts: int = 10, seed: int = 42):
    """K-means on scaled features, best of ``restarts`` seeds: the model with its scaler
    (``save`` keeps both), and the flows with their cluster."""
    # read by the scaler, by every restart and by the result: written once to the shared checkpoint folder
    flows = flows.checkpoint()
    scaler = fit_scaler(flows)
    data = VectorAssembler(inputCols=SCALED, outputCol="features").transform(apply_scaler(flows, scaler))
    data = data.select(*[c for c in data.columns if c not in SCALED])
    from concurrent.futures import ThreadPoolExecutor

    def fit(i):
        m = KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(data)
        return m.summary.trainingCost, i, m

    # restarts are independent Spark jobs: submit them concurrently
    with ThreadPoolExecutor(max_workers=min(restarts, 4)) as pool:
        fits = list(pool.map(fit, range(restarts)))
    best = min(fits, key=lambda f: (f[0], f[1]))
    best = (best[0], best[2])
    return ClusterModel(scaler, best[1]), best[1].transform(data).drop("features")
