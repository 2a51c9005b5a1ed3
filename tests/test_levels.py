"""Subtotals on several levels against brute force."""
from itertools import combinations

import pytest

from telemetra.operators.levels import multi_level

ROWS = [("a", 1, 2.0), ("a", 1, None), ("a", 2, float("nan")), ("b", None, 5.0), (None, 1, 7.0), (None, None, -1.5), ("b", 2, 4.0), ("b", 2, 4.0)]


@pytest.mark.parametrize("how", ["rollup", "cube"])
def test_equals_brute_force(spark, how):
    df = spark.createDataFrame(ROWS, "device_id string, h int, v double").repartition(3)
    sets = [(0, 1), (0,), ()] if how == "rollup" else [s for k in (2, 1, 0) for s in combinations((0, 1), k)]
    want = set()
    for s in sets:
        groups = {}
        for r in ROWS:
            groups.setdefault(tuple(r[i] if i in s else None for i in (0, 1)), []).append(r[2])
        for g, vs in groups.items():
            vs = [v for v in vs if v is not None and v == v]
            want.add((*g, sum(1 << (1 - i) for i in (0, 1) if i not in s), len(vs), sum(vs) / len(vs) if vs else None, min(vs, default=None), max(vs, default=None)))
    got = [tuple(r) for r in multi_level(df, ["device_id", "h"], "v", how).collect()]
    assert set(got) == want and len(got) == len(want)
    assert multi_level(df.filter("false"), ["device_id", "h"], "v", how).count() == 0


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        multi_level(spark.createDataFrame(ROWS, "a string, b int, v double"), ["a"], "v", "sets")
