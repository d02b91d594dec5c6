"""Components by stars against a plain union."""

import random

import pytest
import samples

from likewise.llm.graph import components


@pytest.mark.parametrize("case", ["two roots", "random", "chain", "empty"])
def test_components(spark, case):
    rng = random.Random(1)
    edges = {
        "two roots": [(5, 1), (5, 2), (7, 2), (7, 9), (8, 8), (9, 8), (20, 10), (20, 11), (21, 11)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "chain": [(i, i + 1) for i in range(40)] + [(3, 3)],
        "empty": [],
    }[case]
    union = samples.Union({x for e in edges for x in e})
    for a, b in edges:
        union.join(a, b)
    want = {x: union.find(x) for a, b in edges if a != b for x in (a, b)}
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want)
