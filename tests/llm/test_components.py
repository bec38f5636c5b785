"""Connected components against union-find."""

import random

from folio.llm.components import components


def test_components_hubs_chains_and_trees(spark):
    """Hubs above and below the rest, a chain, a tree, loops and random edges."""
    r = random.Random(4)
    edges = [(0, i) for i in range(1, 1500)] + [(99999, 20000 + i) for i in range(300)] + [(5000 + i, 5001 + i) for i in range(40)]
    edges += [(9000 + i, 9000 + i // 2) for i in range(1, 200)] + [(r.randrange(30000, 30500), r.randrange(30000, 30500)) for _ in range(350)] + [(7, 7)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        u, v = top(u), top(v)
        root[max(u, v)] = min(u, v)
    got = {u: v for u, v in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
