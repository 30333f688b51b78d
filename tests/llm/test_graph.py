"""Components against a plain union-find."""

import random

import pytest

from flowlens.llm.graph import components, star_components


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_are_those_of_union_find(spark, seed):
    rng = random.Random(seed)
    hubs = [rng.randint(0, 200) for _ in range(4)]
    edges = [(rng.randint(0, 200), rng.choice(hubs)) for _ in range(60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    edges += [(k, k + 1) for k in range(500, 520)] + edges[:5] + [(7, 7), (None, 3), (3, None)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    for made in (components, star_components):
        rows = made(df).collect()
        assert len(rows) == len(root) and {r["node"]: r["component"] for r in rows} == {x: find(x) for x in root}
        assert made(df.limit(0)).count() == 0
