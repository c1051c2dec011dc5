from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from inkwell.operators import records, stylometry, verifier
from inkwell.plans import golden, style_queries

TERSE = "Stop now. Go on. It rains. We wait. He left. " * 20
FLOWING = "When the evening had settled over the quiet valley and all the lamps were lit, the old man, who had walked since morning, finally sat down beside the river and thought about nothing in particular. " * 12


def distance(spark, a, b):
    docs = spark.createDataFrame([(1, "a", a), (2, "b", b)], "doc_id long, corpus string, text string")
    return stylometry.overall(stylometry.corpus_distances(docs, "corpus", "a", "b")).first()[0]


def test_distance_contracts(spark):
    assert distance(spark, TERSE, TERSE) == pytest.approx(0.0, abs=1e-6)
    far = distance(spark, TERSE, FLOWING)
    assert 0.2 < far <= 1.0 and far == pytest.approx(distance(spark, FLOWING, TERSE), abs=1e-9)


def test_bootstrap_is_of_the_overall_distance(spark):
    """Each replicate is the style distance of its drawn texts."""
    import hashlib

    import numpy as np

    texts = {"a": [TERSE, "I think you don't know; really! " * 9, "Maybe (so). We wait? " * 12], "b": [FLOWING, "It's very quiet — perhaps. " * 15]}
    docs = lambda sides: spark.createDataFrame([(i, c, t) for c, ts in sides.items() for i, t in enumerate(ts)], "doc_id long, corpus string, text string")
    draw = lambda r, c, i: int(hashlib.md5(f"7|{r}|{c}|{i}".encode()).hexdigest()[:8], 16) % len(texts[c])
    each = [stylometry.overall(stylometry.corpus_distances(docs({c: [ts[draw(r, c, i)] for i in range(len(ts))] for c, ts in texts.items()}), "corpus", "a", "b")).first()[0] for r in range(3)]
    assert len(set(each)) > 1
    got = stylometry.bootstrap_ci(docs(texts), "corpus", "a", "b", "doc_id", replicates=3, seed=7).first()
    assert tuple(got) == pytest.approx(tuple(np.percentile(each, [2.5, 97.5])), abs=1e-4)


def test_js_divergence_extremes(spark):
    a = spark.createDataFrame([("b", "x", 1.0)], "block string, key string, p double")
    b = spark.createDataFrame([("b", "y", 1.0)], "block string, key string, p double")
    assert stylometry.js_divergence(a, b).first()["js"] == pytest.approx(1.0, abs=1e-6)
    assert stylometry.js_divergence(a, a).first()["js"] == 0.0


def test_auc_and_threshold(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1)], "label int, score double")
    assert verifier.roc_auc(rows).first()["auc"] == 0.875
    best = verifier.best_threshold(rows).first()
    assert best["threshold"] == 0.8 and best["accuracy"] == 0.75
    got = verifier.evaluate(rows, verifier.best_threshold(rows)).first()
    assert got["attribution_rate"] == 0.75 and got["n"] == 4


def test_echo_searches_all_other_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (100, [-1.0, -1.0]), (7, [0.0, 1.0]), (8, [1.0, 1.0])]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["echo"] for r in style_queries.semantic_echo(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({0: 1.0, 50: 1.0, 100: -0.707107}, abs=1e-6)


def test_rank_correlation(spark):
    frame = lambda a, b: spark.createDataFrame(list(zip(a, b)), "a double, b double")
    x = [1.0, 2.0, 3.0, 4.0]
    assert records.spearman(frame(x, x), "a", "b").first()["rank_disagreement"] == 0.0
    assert records.spearman(frame(x, x[::-1]), "a", "b").first()["rank_disagreement"] == 1.0
    assert records.spearman(frame(x, [5.0] * 4), "a", "b").first()["spearman"] == 1.0
    assert records.spearman(frame([1.0], [1.0]), "a", "b").count() == 0


def test_golden_records(spark):
    r = spark.createDataFrame(golden.records(), golden.RECORDS)
    manifest = spark.createDataFrame([(i, s[0], s[1], s[2]) for i, s in enumerate(golden.SWEEP)], "ord int, arm string, actual_words long, documents long")
    assert records.noise_floor(r).where("arm = 'full'").select("mean", "sd", "range").first() == (0.7857, 0.0069, 0.0119)
    swept = records.sweep_table(manifest, r)
    assert records.crossover(swept).first()["crossover"] == "15k"
    assert records.reference_arm(manifest, r, "3k").first()["arm"] == "full"
    flagged = records.flagged_runs(spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.4, 0.41), ("c", 0.9, 0.2), ("d", 0.3, 0.3)], "run string, x double, y double"), "run", "x", "y")
    assert [f["run"] for f in flagged.collect()] == ["c"]


def test_perplexity_and_gates(spark):
    got = {r["s"]: r["perplexity"] for r in records.perplexity(spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 2), ("b", 1.0, 0)], "s string, loss double, n_tokens long"), "s").collect()}
    assert got["a"] == pytest.approx(math.exp(1.5)) and math.isnan(got["b"])
    row = spark.createDataFrame([("PASS", None), ("fail: x", "PASS")], "f string, l string").select(records.gates_ok(F.col("f"), F.col("l")).alias("ok")).collect()
    assert [r["ok"] for r in row] == [True, False]


def test_update_norms(spark):
    rows = spark.createDataFrame([("model.layers.1.self_attn.q_proj", [[3.0, 4.0]], [[1.0], [0.0]], 2.0)], "module string, a array<array<double>>, b array<array<double>>, scale double")
    got = records.update_norms(rows).first()
    assert got["update_norm"] == pytest.approx(10.0) and got["kind"] == "attention" and got["layer"] == "1"
