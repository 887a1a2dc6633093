"""Components of long paths, which take many hops."""

import random

from chainspark.llm.components import connected_components


def test_long_paths_settle(spark):
    shuffled = list(range(1, 1001))
    random.Random(3).shuffle(shuffled)
    late = [*range(2002, 3001), 2001]  # the smallest stands at the far end
    edges = [(p[i], p[i + 1]) for p in (shuffled, late) for i in range(len(p) - 1)] + [(5001, 5000), (5002, 5001), (5000, 5002)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(v, 1) for v in shuffled} | {(v, 2001) for v in late} | {(v, 5000) for v in (5000, 5001, 5002)}
