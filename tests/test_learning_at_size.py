"""Learning steps whose tasks must not hold all rows, or read their input again and again."""

import random

import pytest
from pyspark.sql import functions as F

from flowwatch import config as C
from flowwatch.operators import ml


def _flows(spark, n, parts=6):
    rnd = random.Random(7)
    rows = [(i, f"10.0.0.{i % 50}", *[rnd.random() * 100 + (i % 3) * 500 for _ in C.FEATURE_COLS], 0 if i % 50 else 1)
            for i in range(n)]
    cols = ", ".join(f"{c} double" for c in C.FEATURE_COLS)
    return spark.createDataFrame(rows, f"window_id bigint, src_ip string, {cols}, label int").repartition(parts, "window_id")


@pytest.fixture()
def large_tables(spark):
    """Nothing counts as small by its size, as with large inputs."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def _largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_rows_of_a_common_label_are_split_in_many_tasks(spark, large_tables):
    split = ml.train_test_split(_flows(spark, 3000), ["window_id", "src_ip"])
    assert _largest_share(split) < 0.5
    tests = {r["label"]: r["n"] for r in split.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert tests == {0: 588, 1: 12}


def test_weighted_rows_of_a_common_label_are_fitted_in_many_tasks(spark, large_tables):
    flows = _flows(spark, 3000)
    rows = ml.weighted(flows, ml.fit_scaler(flows))
    assert _largest_share(rows) < 0.5
    weights = {r["label"]: (r["n"], round(r["weight"], 9)) for r in
               rows.groupBy("label", "weight").agg(F.count("*").alias("n")).collect()}
    assert weights == {0: (2940, round(3000 / (2 * 2940), 9)), 1: (60, 25.0)}


def test_flows_are_computed_once_for_the_clusters(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(x):
        seen.add(1)
        return x

    flows = _flows(spark, 300).withColumn("total_packets", F.udf(noted, "double")("total_packets"))
    _, clusters = ml.fit_kmeans(flows, restarts=2)
    assert clusters.select("window_id").distinct().count() == 300
    assert seen.value == 300
