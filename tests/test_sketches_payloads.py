"""Mergeable sketches within their error, and payloads as typed rows."""
import datetime as dt
import json
import random

from pyspark.sql import functions as F

from telemetra.operators import payloads as P, sketches as S

SCHEMA = "device_id string, timestamp timestamp_ntz, temperature_celsius double"
T0 = dt.datetime(2024, 1, 30)


def test_merged_sketches_stay_within_their_error(spark):
    rng = random.Random(1)
    rows = [(d, T0 + dt.timedelta(days=rng.randrange(4)), float(rng.randrange(span))) for d, span, n in (("hot", 5000, 20_000), ("few", 6, 500)) for _ in range(n)]
    rows += [("void", T0, None), ("void", T0, float("nan")), (None, T0, 1.0), ("few", None, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    daily = S.daily_sketches(df)
    got = {r.device_id: r for r in S.estimates(S.merge_sketches(daily, "device_id"), {"p50": 0.5, "p95": 0.95}).collect()}
    for d in ("hot", "few"):
        vs = sorted(v for e, t, v in rows if e == d and t is not None)
        assert got[d].n_values == len(vs) and abs(got[d].n_distinct - len(set(vs))) <= 0.05 * len(set(vs))
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            x = got[d][name]
            assert sum(v < x for v in vs) / len(vs) - 0.03 <= q <= sum(v <= x for v in vs) / len(vs) + 0.03
    assert (got["void"].n_values, got["void"].n_distinct, got["void"].p50) == (0, 0, None)
    months = S.merge_sketches(daily, "device_id", F.trunc("date", "month").alias("month"))
    direct = {r.device_id: r.n for r in S.estimates(S.merge_sketches(months, "device_id"), {}).withColumnRenamed("n_distinct", "n").collect()}
    assert direct == {d: got[d].n_distinct for d in got}                  # merged twice or once


def test_payloads(spark):
    texts = ['{"k": 1, "s": "a", "x": null, "l": [1, 2], "d": 1.5}', '{}', '[1]', '7', 'oops', '{"k": ', None, '{"k": "text"}', '', '{"o": {"p": true}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, props string")
    got = {(r.id, r.key, r.value_type, r.value) for r in P.typed_values(df, "props", ["id"]).collect()}
    assert {g[:3] for g in got if g[0] == 0} == {(0, "k", "BIGINT"), (0, "s", "STRING"), (0, "x", "VOID"), (0, "l", "ARRAY<BIGINT>"), (0, "d", "DECIMAL(2,1)")}
    assert {g for g in got if g[2] == P.MALFORMED} == {(4, None, P.MALFORMED, "oops"), (5, None, P.MALFORMED, '{"k": '), (8, None, P.MALFORMED, "")}
    assert {g[0] for g in got} == {0, 2, 3, 4, 5, 7, 8, 9} and (3, None, "BIGINT", "7") in got
    (o,) = [g for g in got if g[0] == 9]
    assert o[2] == "OBJECT<p: BOOLEAN>" and json.loads(o[3]) == {"p": True}
    one = P.payload_schema(df, "props").first()
    assert (one.n_payloads, one.n_malformed) == (9, 3)
