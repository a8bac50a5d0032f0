from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimloom.operators import geometry, metrics, providers, records
from claimloom.sources import packages

from .conftest import DATA


def test_record_table(spark, tmp_path):
    caps = spark.read.parquet(f"{DATA}/capsules.parquet").dropDuplicates()
    packages.write_record_table(caps, str(tmp_path / "t"))
    back = packages.read_record_table(spark, str(tmp_path / "t"), caps.schema)
    h = lambda df: packages.content_hash(df.withColumn("_id", F.col("ids.capsule_id")), "_id")
    assert h(back) == h(caps)


def test_matrices(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.0, 1.0], [[1.0, 2.0, 0.0, 1.0], [1.0, 0.0, 3.0, 1.0]]), ([1.0, 2.0], []), (None, [])], "m array<double>, p array<array<double>>")
    r = df.select(geometry.loop_observables("m").alias("o"), geometry.composed("p", 2).alias("c")).collect()
    assert r[0]["o"]["holonomy_norm"] == pytest.approx(2.0) and r[0]["o"]["trace_normalized"] == 1.0 and r[0]["o"]["spectrum_abs_max"] == pytest.approx(1.0)
    assert r[0]["c"] == [7.0, 2.0, 3.0, 1.0] and r[1]["c"] == [1.0, 0.0, 0.0, 1.0]
    assert r[1]["o"]["holonomy_norm"] is None and r[2]["o"]["holonomy_norm"] is None


def test_curriculum(spark):
    df = spark.range(10)
    ramp = df.select(*[c.alias(n) for n, c in metrics.curriculum(F.col("id"), 10, "linear_complexity_ramp").items()]).collect()
    assert ramp[0]["structured"] == 0.1 and ramp[9]["geometry"] == 1.0 and ramp[3]["text_projection"] == 1.0
    ph = df.select(*[c.alias(n) for n, c in metrics.curriculum(F.col("id"), 10, "phases", (0, 3, 6)).items()]).collect()
    assert [r["relations"] for r in ph] == [0.0] * 3 + [1.0] * 7 and [r["geometry"] for r in ph] == [0.0] * 6 + [1.0] * 4


def test_masks_and_negatives(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "a int, b int")
    assert [r[0] for r in df.select(metrics.availability_masked(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    n = spark.createDataFrame([("temporal_distractor",), ("own",), (None,)], "t string")
    assert [r[0] for r in n.select(records.negative_type(F.col("t"))).collect()] == ["temporal_negative", "own", "unknown"]


def test_python_provider(spark, rows):
    req = spark.createDataFrame([("a", "x y")], "request_hash string, input string")
    cache = spark.createDataFrame([], "request_hash string, output string")
    answers, _ = providers.replay_or_run(req, cache, providers.python_provider("html:escape"))
    assert rows(answers, "request_hash", "output") == [("a", "x y")]
    with pytest.raises(ValueError):
        providers.python_provider("nothing")


def test_text_score(spark):
    df = spark.createDataFrame([(0.5, 0.0, None), (0.5, 100.0, None), (0.5, 0.0, 2.0)], "a double, c double, p double")
    got = [r[0] for r in df.select(metrics.text_score(F.col("a"), F.col("c"), F.col("p"))).collect()]
    assert got[0] == 1.5 and got[1] == pytest.approx(0.5, abs=1e-6) and got[2] == 1.0
