import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from narrprep.operators.scan import asof_backward, number_block, ordered_scan


def rows(seed, n=600):
    """One group holds more than a third of all rows."""
    rng = random.Random(seed)
    places = {}
    out = []
    for _ in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        places.setdefault(key, set())
        pos = rng.choice([p for p in range(2000) if p not in places[key]])
        places[key].add(pos)
        out.append((key, pos, rng.randrange(10), rng.choice([None, None, 1, 2, 3])))
    return out


@pytest.mark.parametrize("seed, block", [(1, 7), (2, 100), (3, 10_000)])
def test_scan_equals_plain_windows(spark, seed, block):
    data = rows(seed)
    df = spark.createDataFrame(data, "k string, pos int, v int, c int")
    got = ordered_scan(
        df, ["k"], ["pos"], number_block("pos", block),
        sum_before={"before": F.col("v")},
        last_before={"last": F.col("c")},
        previous={"prev": F.col("c")},
        following={"next": F.col("c")},
        group_sum={"total": F.col("v")},
    ).toPandas().sort_values(["k", "pos"]).reset_index(drop=True)

    want = pd.DataFrame(data, columns=["k", "pos", "v", "c"]).sort_values(["k", "pos"]).reset_index(drop=True)
    by = want.groupby("k")
    want["before"] = by["v"].cumsum() - want["v"]
    want["last"] = by["c"].transform(lambda s: s.ffill().shift())
    want["prev"] = by["c"].shift()
    want["next"] = by["c"].shift(-1)
    want["total"] = by["v"].transform("sum")
    for column in want.columns:
        a, b = got[column], want[column]
        if column != "k":
            a, b = a.astype("float"), b.astype("float")
        pd.testing.assert_series_equal(a, b, check_names=False)


@pytest.mark.parametrize("block", [5, 1000])
def test_asof_takes_the_last_earlier_row(spark, block):
    rng = random.Random(5)
    right = [("hot" if i % 2 else "b", p, i) for i, p in enumerate(rng.sample(range(300), 60))]
    left = [("hot" if rng.random() < 0.5 else "c", rng.randrange(320), i) for i in range(200)]
    got = asof_backward(
        spark.createDataFrame(left, "k string, pos int, id int"),
        spark.createDataFrame(right, "k string, at int, val int"),
        ["k"], "pos", "at", ["val"], block,
    ).collect()
    assert len(got) == len(left)
    for r in got:
        earlier = [(p, v) for k, p, v in right if k == r["k"] and p <= r["pos"]]
        assert r["val"] == (max(earlier)[1] if earlier else None)


def test_rows_of_equal_content_are_kept(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1)], "k string, pos int")
    right = spark.createDataFrame([("a", 0, 9)], "k string, at int, val int")
    got = asof_backward(left, right, ["k"], "pos", "at", ["val"], 10).collect()
    assert [r["val"] for r in got] == [9, 9]


@pytest.mark.parametrize("levels, block, fan", [(1, 2, 2), (2, 2, 4), (3, 3, 4)])
def test_null_keys_and_levels_of_blocks(spark, levels, block, fan):
    data = [(None if k == "hot" else k, *rest) for k, *rest in rows(4)]
    df = spark.createDataFrame(data, "k string, pos int, v int, c int")
    got = ordered_scan(
        df, ["k"], ["pos"], number_block("pos", block),
        sum_before={"before": F.col("v")}, last_before={"last": F.col("c")}, previous={"prev": F.col("c")},
        following={"next": F.col("c")}, group_sum={"total": F.col("v")}, levels=levels, fan=fan,
    )
    along = "over (partition by k order by pos"
    df.createOrReplaceTempView("scanned")
    want = spark.sql(
        f"select *, coalesce(sum(v) {along} rows between unbounded preceding and 1 preceding), 0) as before, "
        f"last(c, true) {along} rows between unbounded preceding and 1 preceding) as last, "
        f"lag(c) {along}) as prev, lead(c) {along}) as next, sum(v) over (partition by k) as total from scanned"
    )
    got = got.select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.count() == len(data)
