"""Windows, set operations and quality checks against brute force."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from equipoise.functions.ordering import ascending, descending
from equipoise.operators import quality as dq
from equipoise.operators import sets
from equipoise.operators import windows as wn

ROWS = [(1, 1, 10.0), (1, 2, None), (1, 3, 5.0), (None, 4, 7.0), (None, 5, 7.0), (2, 6, 1.0)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "g int, id int, v double")


def test_first_per_group_puts_nulls_last_and_keeps_the_null_group(small):
    assert rows(wn.first_per_group(small, ["g"], ["v", "id"])) == rows(small.where("id in (3, 4, 6)"))


def test_qualify_orders_nulls_like_the_source(small):
    top = wn.qualify_top(small, ["g"], [descending("v"), ascending("id")], 1)
    assert {r.id for r in top.collect()} == {2, 4, 6}
    low = wn.qualify_top(small, ["g"], [ascending("v"), ascending("id")], 1)
    assert {r.id for r in low.collect()} == {3, 4, 6}


def test_full_frame_values(small):
    out = wn.first_value(small, ["g"], "id", ["v", "id"], "a")
    out = wn.last_value(out, ["g"], "id", ["v", "id"], "z")
    out = wn.nth_value(out, ["g"], "id", [ascending("v"), ascending("id")], 2, "n")
    assert {(r.g, r.a, r.z, r.n) for r in out.collect()} == {(1, 3, 2, 1), (None, 4, 5, 5), (2, 6, 6, None)}
    assert out.count() == len(ROWS)


def test_shares(spark):
    df = spark.createDataFrame([(1, 100), (1, 300), (2, 0), (None, 5)], "g int, c int")
    got = wn.ratio_to_report(df, ["g"], F.col("c"), "share")
    assert {(r.g, r.c, r.share) for r in got.collect()} == {(1, 100, 0.25), (1, 300, 0.75), (2, 0, None), (None, 5, 1.0)}
    money = df.withColumn("c", F.col("c").cast("decimal(14,2)"))
    exact = wn.exact_ratio_to_report(money, ["g"], "c", "share", 8)
    assert {(r.g, str(r.share)) for r in exact.collect()} == {(1, "0.25000000"), (1, "0.75000000"), (2, "None"), (None, "1.00000000")}


@pytest.mark.parametrize("slice_seconds", [60, 61, 3600])
def test_rate_breaches_match_brute_force(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    start = datetime(2025, 1, 1)
    events = [(rng.choice(["a", "b"]), start + timedelta(seconds=rng.choice([rng.randrange(900), rng.randrange(15) * 60]), microseconds=rng.choice([0, 0, 1]))) for _ in range(250)]
    got = wn.rate_breaches(spark.createDataFrame(events, "u string, t timestamp_ntz"), ["u"], "t", 12, slice_seconds=slice_seconds)
    want = set()
    for u, t in events:
        n = sum(1 for x, s in events if x == u and t - timedelta(seconds=60) <= s <= t)
        if n > 12:
            want.add((u, t, n))
    assert want and {(r.u, r.t, r.events_in_window) for r in got.collect()} == want
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    instants = spark.createDataFrame(events, "u string, t timestamp")
    assert wn.rate_breaches(instants, ["u"], "t", 12, slice_seconds=slice_seconds).count() == len(want) == got.count()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(ValueError):
        wn.rate_breaches(got, ["u"], "t", 1, seconds=60, slice_seconds=10)


def test_quantiles_match_sorting(spark):
    rng = random.Random(1)
    data = [(g, rng.choice([rng.random() * 1e6, 5.0, None])) for g in (1, 2, None) for _ in range(301)] + [(9, 4.0)]
    df = spark.createDataFrame(data, "g int, v double")
    groups = defaultdict(list)
    for g, v in data:
        if v is not None:
            groups[g].append(v)
    for q in (0.0, 0.25, 0.5, 0.93, 1.0):
        got = {r.g: r.v_quantile for r in wn.exact_quantile(df, ["g"], "v", q).collect()}
        for g, values in groups.items():
            values.sort()
            at = q * (len(values) - 1)
            low = int(at)
            high = min(low + 1, len(values) - 1)
            assert got[g] == pytest.approx(values[low] + (values[high] - values[low]) * (at - low), rel=1e-12)


def test_quantiles_by_selection(spark):
    """Segments far smaller than the groups, so that many rounds are needed: outliers, common values, NaN and equal groups."""
    rng = random.Random(5)
    data = [("far", v) for v in [rng.random() for _ in range(900)] + [1e18, -1e18]] + [("tie", 7.0 if i % 3 else rng.random() * 20) for i in range(900)]
    data += [("one", 3.0)] * 400 + [(None, float(i % 250)) for i in range(700)] + [("nan", math.nan)] * 3 + [("nan", 1.0)] * 5 + [("few", 2.5), ("few", None)]
    qs = {"a": 0.0, "b": 0.13, "c": 0.5, "d": 0.75, "e": 1.0}
    for most in (6, 100, 100_000):
        got = {r["g"]: r for r in wn.exact_quantiles(spark.createDataFrame(data, "g string, v double").repartition(4), ["g"], "v", qs, most=most).collect()}
        assert got.keys() == {g for g, _ in data}
        for g in got:
            values = sorted((v for k, v in data if k == g and v is not None), key=lambda v: (math.isnan(v), v))
            for name, q in qs.items():
                at = q * (len(values) - 1)
                low, part = values[int(at)], at - int(at)
                want = low + (values[int(at) + 1] - low) * part if part else low
                assert got[g][name] == pytest.approx(want, rel=1e-12, nan_ok=True)
    assert rows(wn.exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"m": 0.5})) == []
    with pytest.raises(ValueError):
        wn.exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"m": 1.5})


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (2, "again")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (None, "none"), (5, "five")], "k int, v string")
    assert rows(sets.only_in(a, b, ["k"])) == [(1,)]
    assert rows(sets.difference(a, b, ["k"])) == [(1, "left"), (5, "right")]
    assert rows(sets.delete_insert(a, b, ["k"])) == [(1, "x"), (2, "new"), (5, "five"), (None, "none")]
    kept = sets.merge(a, b, ["k"], delete_when=F.col("v") == "new")
    assert rows(kept) == [(1, "x"), (5, "five"), (None, "none")]
    assert rows(sets.orphans(a, "k", b, "k")) == [(1, 1)]


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 9), (None, None, 2), (None, "q", None)], "id int, s string, fk int")
    parents = spark.createDataFrame([(1,), (2,)], "p int")
    tests = [
        dq.Unique(("id",)), dq.Unique(("id", "s")), dq.NotNull("id"), dq.Accepted("s", ("a", "b")),
        dq.Expression("small", F.col("fk") < 5), dq.References("fk", parents, "p"),
    ]
    got = {r.test: r.failing_rows for r in dq.check(df, "t", tests).collect()}
    assert got == {
        "unique_id": 1, "unique_id_s": 0, "not_null_id": 2, "accepted_values_s": 1, "expression_small": 1, "relationships_fk": 1,
    }
    twice = spark.createDataFrame([(None, 1), (None, 1), (None, None)], "a int, b int")
    assert rows(dq.check(twice, "t", [dq.Unique(("a", "b")), dq.Unique(("a",))]).select("failing_rows")) == [(0,), (1,)]
    assert rows(dq.count_failures(df.where("fk = 9"), "t", "mine")) == [("t", "mine", 1)]
