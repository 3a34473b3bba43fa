import random
import threading
from concurrent.futures import ThreadPoolExecutor as threads

import numpy as np
import pytest

from order_rows import ago, by_key
from custscope.operators import segment
from custscope.schema import FEATURES, SEGMENT_ORDER

SCHEMA = "cliente_id string, recency double, frequency double, monetary double, dias_entre_compras double"


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(42)
    rows = zip(
        [f"C{i:04d}" for i in range(200)], rng.integers(1, 500, 200).astype(float).tolist(),
        (rng.poisson(5, 200) + 1).astype(float).tolist(), rng.lognormal(8, 1.2, 200).tolist(),
        rng.uniform(5, 200, 200).tolist())
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.fixture(scope="module")
def model(skewed):
    return segment.fit(skewed, "t1", n_init=3)


def test_fit_uses_five_balanced_clusters(skewed, model):
    labels = [r.segmento_cluster for r in segment.score(skewed, model).collect()]
    assert set(labels) == set(SEGMENT_ORDER)
    assert max(labels.count(s) for s in SEGMENT_ORDER) < 0.7 * len(labels)
    again = segment.fit(skewed, "t1", n_init=3)
    np.testing.assert_allclose(again.centroids, model.centroids)


def test_numbers_and_pipeline_agree(spark, skewed, model, tmp_path):
    model.save(spark, tmp_path.as_uri())
    loaded = segment.SegmentModel.load(spark, "t1", tmp_path.as_uri())
    assert loaded == model
    piped = {r.cliente_id: r.cluster_id for r in loaded.load_pipeline(tmp_path.as_uri()).transform(skewed).collect()}
    assert piped == {r.cliente_id: r.cluster_id for r in segment.score(skewed, loaded).collect()}
    with pytest.raises(FileNotFoundError):
        segment.SegmentModel.load(spark, "nope", tmp_path.as_uri())


def test_distances_equal_numpy(skewed, model):
    x = np.array([[r[f] for f in FEATURES] for r in skewed.collect()])
    z = (np.log1p(x) - model.mean) / model.std
    d = np.sort(np.linalg.norm(z[:, None, :] - np.array(model.centroids)[None], axis=2), axis=1)
    got = segment.score_with_frontier(skewed, model).collect()
    np.testing.assert_allclose([r.distancia_propia for r in got], d[:, 0])
    np.testing.assert_allclose([r.razon_distancias for r in got], d[:, 0] / d[:, 1])
    assert all(r.segmento_cluster != r.segmento_secundario and 0 <= r.razon_distancias <= 1 for r in got)
    assert "distancia_centroide" in segment.score(skewed, model, with_distance=True).columns


@pytest.mark.parametrize("bad", [None, -1.0])
def test_bad_features_are_rejected(spark, model, bad):
    df = spark.createDataFrame([("a", 1.0, 1.0, bad, 1.0)], SCHEMA)
    with pytest.raises(ValueError, match="null|negative"):
        segment.validate_features(df)
    with pytest.raises(Exception, match="null or negative"):
        segment.score(df, model).collect()
    with pytest.raises(ValueError, match="monetary"):
        segment.score(df.drop("monetary"), model)


def test_snapshot_agreement(skewed, model):
    scored = segment.score(skewed, model)
    assert tuple(segment.snapshot_agreement(scored, scored).first()) == (200, 200, 1.0)
    table = by_key(segment.segment_confusion(scored, scored), "snapshot")
    assert all(table[s][o] == 0 for s in table for o in SEGMENT_ORDER if s != o)
    assert tuple(segment.snapshot_agreement(scored, scored.limit(0)).first()) == (0, 0, 0.0)


def test_orders_to_segments(make_orders, ref):
    rng = random.Random(5)
    orders = make_orders([
        (f"C{c:03d}", ago(rng.randrange(1, 700)), rng.uniform(100, 50000))
        for c in range(300) for _ in range(rng.randrange(1, 11))])
    got = segment.segment_customers(orders, None, ref).collect()
    assert len(got) == 300 == len({r.cliente_id for r in got})
    assert all(0 <= r.cluster_id <= 4 and 0 <= r.razon_distancias <= 1 for r in got)


def test_a_pipeline_fitted_elsewhere_and_given_names(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", rng.randint(0, 300), rng.randint(1, 60), rng.random() * 1e4, rng.random() * 90, 0) for i in range(200)]
    rfm = spark.createDataFrame(rows, "cliente_id string, recency bigint, frequency bigint, monetary double, dias_entre_compras double, es_single_buyer int")
    pipeline = segment.build_pipeline(3).fit(rfm)
    model = segment.SegmentModel.from_fitted(pipeline, 200, "ajeno", {2: "alto", 0: "bajo", 1: "medio"})
    assert (model.cluster_names, model.version, model.n_clientes_entrenamiento) == (["bajo", "medio", "alto"], "ajeno", 200)
    want = {r.cliente_id: r.cluster_id for r in pipeline.transform(rfm).collect()}
    assert {r.cliente_id: r.cluster_id for r in segment.score(rfm, model).collect()} == want
    named = segment.fit(rfm, k=3, n_init=1, cluster_names=["x", "y", "z"])
    assert named.cluster_names == ["x", "y", "z"]
    for wrong in (["a", "b"], ["a", "a", "b"], {0: "a", 1: "b", 3: "c"}):
        with pytest.raises(ValueError, match="name of its own"):
            segment.SegmentModel.from_fitted(pipeline, 200, cluster_names=wrong)


def test_starts_run_side_by_side_and_equal_those_run_alone(skewed, monkeypatch):
    """Two fits wait for each other, which only ends if they run at the same time."""
    fit, meeting, met = segment.KMeans.fit, threading.Barrier(2), []

    def together(self, data, params=None):
        try:
            meeting.wait(20)
            met.append(True)
        except threading.BrokenBarrierError:
            met.append(False)
        return fit(self, data, params)

    monkeypatch.setattr(segment.KMeans, "fit", together)
    side = segment.k_scan(skewed, ks=[2, 3], n_init=2).collect()
    assert met == [True] * 4
    monkeypatch.setattr(segment.KMeans, "fit", fit)
    monkeypatch.setattr(segment, "ThreadPoolExecutor", lambda max_workers: threads(max_workers=1))
    alone = segment.k_scan(skewed, ks=[2, 3], n_init=2).collect()
    assert [tuple(r) for r in side] == [tuple(r) for r in alone]
