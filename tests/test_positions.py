"""Ordinals and ranges against plain Python, with buckets small enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

from rowgate.operators.positions import number_rows, range_label, row_ranges


def merged(numbers):
    """Ranges of a set of numbers: a number starts one when its predecessor is missing."""
    have = set(numbers)
    starts = sorted(n for n in have if n - 1 not in have)
    ends = sorted(n for n in have if n + 1 not in have)
    return list(zip(starts, ends))


@pytest.mark.parametrize("bucket_rows", [1, 3, 4, 1 << 16])
def test_number_rows(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    rows = [(g, p) for g in "abc" for p in rng.sample(range(-5, 60), 30)] + [("one", 7)]
    df = spark.createDataFrame(rows, "g string, p bigint")
    got = {(r.g, r.p): r.n for r in number_rows(df, ["g"], "p", "n", bucket_rows).collect()}
    assert got == {(g, p): sum(1 for h, q in rows if h == g and q <= p) for g, p in rows}


@pytest.mark.parametrize("bucket_rows", [1, 2, 3, 5, 1 << 16])
def test_row_ranges(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    rows = [(g, rng.randrange(2, 60)) for g in "abc" for _ in range(60)] + [("gap", n) for n in (2, 4, 6)] + [("run", n) for n in range(2, 40)]
    df = spark.createDataFrame(rows + [("none", None)], "g string, row_num bigint")
    got = {}
    for r in row_ranges(df, ["g"], sums={"n": F.lit(1).cast("bigint")}, bucket_rows=bucket_rows).collect():
        got.setdefault(r.g, []).append((r.range_start, r.range_end, r.n))
    for g in {g for g, _ in rows}:
        numbers = [n for h, n in rows if h == g]
        assert sorted(got[g]) == [(a, b, sum(a <= n <= b for n in numbers)) for a, b in merged(numbers)]
    assert "none" not in got


def test_range_labels(spark):
    df = spark.createDataFrame([(140620,), (140614,), (140615,), (140614,)], "row_num bigint").withColumn("g", F.lit(1))
    labels = row_ranges(df, ["g"]).orderBy("range_start").select(range_label().alias("t")).collect()
    assert [r.t for r in labels] == ["140614-140615", "140620"]
