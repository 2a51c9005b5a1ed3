"""Multiset reconciliation and first rows per group, against brute force."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from telemetra.operators import reconcile as R
from telemetra.operators.top import top_k

SCHEMA = "k int, a string, v double"


def table(seed):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(25)]), rng.choice(["x", "y", None]), rng.choice([1.0, 2.0, None])) for _ in range(400)]


def test_difference_counts_copies(spark):
    a, b = table(1), table(2) + table(1)[:200]
    got = R.multiset_difference(spark.createDataFrame(a, SCHEMA).repartition(3), spark.createDataFrame(b, SCHEMA).select("v", "k", "a")).collect()
    assert Counter({(r.k, r.a, r.v): r.copies for r in got if r.side == R.ONLY_LEFT}) == Counter(a) - Counter(b)
    assert Counter({(r.k, r.a, r.v): r.copies for r in got if r.side == R.ONLY_RIGHT}) == Counter(b) - Counter(a)
    same = spark.createDataFrame(a + [(1, "n", float("nan")), (2, "z", -0.0)], SCHEMA)
    assert R.multiset_difference(same, spark.createDataFrame([(1, "n", float("nan")), (2, "z", 0.0)] + a[::-1], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="columns differ"):
        R.multiset_difference(same, same.drop("v"))


def test_findings_name_the_columns(spark):
    left = [(i, f"a{i}", float(i)) for i in range(20)] + [(30, "r", 1.0)] * 3 + [(None, "n", 1.0)]
    right = [(i, f"a{i}" if i != 4 else None, float(i) + (i in (4, 5))) for i in range(2, 20)] + [(30, "r", 1.0)] * 5 + [(40, "new", 0.0), (None, "n", None)]
    got = {(r.finding, r.column_name): r.rows for r in R.reconciliation(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"]).collect()}
    assert got == {("missing", None): 2, ("extra", None): 3, ("changed", "a"): 1, ("changed", "v"): 3}
    empty = spark.createDataFrame([], SCHEMA)
    assert {r.finding: r.rows for r in R.reconciliation(empty, empty, ["k"]).collect()} == {"missing": 0, "extra": 0, "changed": 0}


@pytest.mark.parametrize("k", [0, 1, 3, 2000])
def test_first_rows(spark, k):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "cold", None]), rng.randrange(50), i) for i in range(3000)] + [("lone", 1, 9000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    out = top_k(df, k, [F.col("v").desc(), F.col("id").asc()], "g")
    want = {(g, v, i, n + 1) for g in ("hot", "cold", None, "lone") for n, (v, i) in enumerate(sorted(((v, i) for h, v, i in rows if h == g), key=lambda r: (-r[0], r[1]))[:k])}
    assert {tuple(r) for r in out.collect()} == want
    if 0 < k < 1000:
        assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
