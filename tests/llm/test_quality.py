import zlib

import numpy as np
import pytest

from driftlog.llm import quality as Q
from driftlog.llm.queries import op8_quality

from .conftest import EDGES


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    count = np.array([1, 4, 2, 3])
    x, y = rng.normal(size=(int(count.sum()), Q.WIDTH)), np.array([0.0, 1.0, 1.0, 0.0])
    shapes = {"W": (Q.WIDTH, 5), "b": (5,), "V": (5, 3), "U": (5, 3), "w": (3,), "c": (5,), "d": ()}
    w = {k: np.asarray(rng.normal(0, 0.2, s)) for k, s in shapes.items()}
    model = Q.Model(np.zeros(Q.WIDTH), np.ones(Q.WIDTH), w)

    def loss():
        p = model.score(x, count)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    got = Q.gradients(model, x, count, y)
    for k, g in got.items():
        for at in [tuple(rng.integers(0, n) for n in w[k].shape) for _ in range(6)]:
            was, step = w[k][at].copy(), 1e-5
            w[k][at] = was + step
            up = loss()
            w[k][at] = was - step
            down = loss()
            w[k][at] = was
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-8), k


def test_long_texts_score_as_in_one_piece(monkeypatch):
    rng = np.random.default_rng(1)
    model = Q.fit([rng.normal(size=(3, Q.WIDTH)).astype(np.float32) for _ in range(20)], np.arange(20) % 2.0, epochs=2)
    text = rng.integers(32, 127, 20_000, dtype=np.uint8).tobytes()
    whole = model.score(*Q.encode([text]))[0]
    monkeypatch.setattr(Q, "ENCODED", 4 * Q.PASSAGE)
    assert model.score_long(text) == pytest.approx(whole, rel=1e-4)


def test_attention_model_learns_from_bag_labels():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(int(n), Q.WIDTH)).astype(np.float32) for n in rng.integers(1, 5, 40)]
    y = np.array([float(b[:, 0].max() > 0.5) for b in bags], np.float32)
    model = Q.fit(bags, y, epochs=60, rate=5e-3)
    p = model.score(np.concatenate(bags), np.array([len(b) for b in bags]))
    assert ((p > 0.5) == y).mean() > 0.9


def test_passages_cover_the_whole_text():
    x, count = Q.encode([b"", b"a" * Q.PASSAGE, b"a" * (Q.PASSAGE * 3 + 1)])
    assert count.tolist() == [1, 1, 4] and len(x) == 6 and not x[0, :-1].any()


def test_held_out_accuracy(spark):
    got = op8_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    m = got[got.held_out].merge(labels, on="doc_id")
    good, bad = m.score[m.quality == 1].to_numpy(), m.score[m.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert m.predicted[m.quality == 1].mean() > 0.97


def test_edges(make_docs, spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (6, None), (5, 1)], "doc_id long, quality int")
    got = Q.quality_scores(make_docs(EDGES), labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    again = Q.quality_scores(make_docs(EDGES), labels).collect()
    assert sorted(r.score for r in got) == pytest.approx(sorted(r.score for r in again))
    none = Q.quality_scores(make_docs(EDGES), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.quality_scores(make_docs([]), labels).count() == 0
    assert Q.good_documents(make_docs(EDGES), labels).columns == make_docs([]).columns
