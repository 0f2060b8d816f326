import random

from pyspark.sql import functions as F

from equipoise.operators.positions import with_position, with_running_sum

from conftest import rows


def test_positions_over_all_rows(spark):
    values = random.Random(1).sample(range(10_000), 3000)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    assert sorted(rows(with_position(df, [F.col("v").desc()]))) == sorted((v, i + 1) for i, v in enumerate(sorted(values, reverse=True)))


def test_a_group_of_most_rows_lies_in_many_ranges(spark):
    draw = random.Random(2)
    data = [(draw.choice(["hot"] * 8 + ["a", None]), draw.randrange(10**6), i, "mine") for i in range(4000)]
    df = spark.createDataFrame(data, "g string, v int, id int, _equipoise string").repartition(5)
    want = []
    for g in ("hot", "a", None):
        own = sorted(x for x in data if x[0] == g) if g else sorted((x for x in data if x[0] is None), key=lambda x: x[1:])
        want += [(*x, i + 1) for i, x in enumerate(own)]
    got = with_position(df, ["v", "id"], ["g"])
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_no_rows_and_a_column_of_that_name(spark):
    assert with_position(spark.createDataFrame([], "v int, position string"), ["v"]).columns == ["v", "position"]
    assert rows(with_position(spark.createDataFrame([(3, "x"), (1, "y")], "v int, position string"), ["v"])) == [(1, 1), (3, 2)]


def test_running_sum_by_group(spark):
    draw = random.Random(3)
    data = [(draw.choice(["hot"] * 8 + ["a", None]), i, draw.choice([None, 0, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, id int, n long").repartition(5)
    want, sums = [], {}
    for g, i, n in sorted(data, key=lambda x: -x[1]):
        sums[g] = sums.get(g, 0) + (n or 0)
        want.append((g, i, n, sums[g]))
    assert sorted((tuple(r) for r in with_running_sum(df, "n", [F.col("id").desc()], ["g"]).collect()), key=str) == sorted(want, key=str)
    assert rows(with_running_sum(df.limit(0), "n", ["id"])) == []
