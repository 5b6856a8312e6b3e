import random

import pytest

from driftlog.llm import common


@pytest.mark.parametrize("forest", [250_000, 40])
def test_components_of_paths_and_random_edges(spark, monkeypatch, forest):
    monkeypatch.setattr(common, "FOREST", forest)
    rng, up = random.Random(1), {}
    edges = [(k, k + 1) for k in range(300) if k % 50] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(1500)] + [(5, 5)]

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(9), "t").collect()
    assert {r.node: r.component for r in got} == {x: root(x) for e in edges for x in e}
    assert len(got) == len({r.node for r in got})
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
