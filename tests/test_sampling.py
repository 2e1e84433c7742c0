import hashlib
import math

import pytest
from pyspark.sql import functions as F

from claimsift.operators import sampling
from claimsift.operators.features import top_terms
from claimsift.operators.numbering import number_rows


def _hash(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def keys(spark):
    """3,000 rows, one class with most of them, one with a single row."""
    return spark.range(3000).select(
        F.col("id").alias("claim_id"),
        F.when(F.col("id") == 5, "single").when(F.col("id") % 10 < 7, "hot").otherwise(
            F.concat(F.lit("c"), F.col("id") % 3)).alias("tag_clean"),
    )


def _quotas(sizes, total):
    n = sum(sizes.values())
    base = {k: s * total // n for k, s in sizes.items()}
    order = sorted(sizes, key=lambda k: (-(sizes[k] * total % n), k))
    for k in order[: total - sum(base.values())]:
        base[k] += 1
    return base


def _brute_split(rows, total, seed=42):
    classes = {}
    for i, c in rows:
        classes.setdefault(c, []).append(i)
    quotas = _quotas({c: len(v) for c, v in classes.items()}, total)
    return {i for c, v in classes.items() for i in sorted(v, key=lambda i: (_hash(i, seed), i))[: quotas[c]]}


def test_split_equals_plain_ranking_whatever_the_partitioning(spark, keys):
    rows = [(r["claim_id"], r["tag_clean"]) for r in keys.collect()]
    expected = _brute_split(rows, math.ceil(0.2 * len(rows)))
    for df in (keys.repartition(1), keys.repartition(7), keys.repartition(64).orderBy(F.desc("claim_id"))):
        out = sampling.stratified_split(df).collect()
        assert len(out) == len(rows)
        assert {r["claim_id"] for r in out if r["split"] == "test"} == expected


def test_nested_sample(spark, keys):
    split = sampling.stratified_split(keys)
    out = sampling.nested_sample(split, 100).collect()
    test = [(r["claim_id"], r["tag_clean"]) for r in out if r["split"] == "test"]
    assert {r["claim_id"] for r in out if r["in_sample"]} == _brute_split(test, 100, "sample")
    with pytest.raises(ValueError, match="601"):
        sampling.nested_sample(split, 601)


def test_golden_quotas(spark):
    sizes = spark.createDataFrame([("a", 7), ("b", 5), ("c", 3), ("d", 1), ("e", 1)], "t string, size bigint")
    out = sampling.proportional_quotas(sizes, "t", F.ceil(F.col("n") * F.lit(0.2)))
    assert {r["t"]: r["quota"] for r in out.collect()} == {"a": 2, "b": 1, "c": 1, "d": 0, "e": 0}
    one = sampling.proportional_quotas(sizes, "t", F.lit(6))  # d and e tie for the last place
    assert {r["t"]: r["quota"] for r in one.collect()} == _quotas({"a": 7, "b": 5, "c": 3, "d": 1, "e": 1}, 6)


def test_quotas_do_not_overflow(spark):
    sizes = spark.createDataFrame([("a", 6 * 10**17), ("b", 4 * 10**17)], "t string, size bigint")
    out = sampling.proportional_quotas(sizes, "t", F.lit(10**17))
    assert {r["t"]: r["quota"] for r in out.collect()} == {"a": 6 * 10**16, "b": 4 * 10**16}


@pytest.mark.parametrize("n", [0, 1, 500, 2999, 3000, 5000])
def test_sample_n(keys, n):
    expected = set(sorted(range(3000), key=lambda i: (_hash(i), i))[:n])
    assert {r["claim_id"] for r in sampling.sample_n(keys, n).collect()} == expected


@pytest.mark.parametrize(("n", "share"), [(0, 2), (40, 2), (700, 7), (700, 1), (5000, 2)])
def test_sample_n_of_a_pool(keys, n, share):
    """Rows of a filtered table, found from the ids before the filter, whatever share of them passes it."""
    kept = [i for i in range(3000) if i % share == 0]
    expected = set(sorted(kept, key=lambda i: (_hash(i), i))[:n])
    drawn = sampling.sample_n(keys.where(F.col("claim_id") % share == 0), n, pool=keys.select("claim_id"))
    assert {r["claim_id"] for r in drawn.collect()} == expected


def test_balanced_small_and_large_limits(keys):
    rows = [(r["claim_id"], r["tag_clean"]) for r in keys.collect()]
    for limit in (10, 1500):
        out = sampling.balanced_per_class(keys, limit).collect()
        expected = set()
        for c in {c for _, c in rows}:
            members = sorted((i for i, k in rows if k == c), key=lambda i: (_hash(i), i))
            expected |= set(members[:limit])
        assert {r["claim_id"] for r in out} == expected


def test_top_up_reports_a_shortfall(spark):
    few = spark.range(30).select(F.col("id").alias("claim_id"), F.lit("a").alias("tag_clean"))
    out, shortfall = sampling.top_up(few, sampling.balanced_per_class(few), 100)
    assert out.count() == 30 and out.distinct().count() == 30 and shortfall == 70


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(13)
    rows = number_rows(df, ["k"], "n", start=11).collect()
    assert sorted((r["k"], r["n"]) for r in rows) == [(k, k + 11) for k in range(1000)]


def test_long_top_list_with_ties(spark):
    totals = spark.range(6000).select(
        F.concat(F.lit("t"), F.col("id")).alias("term"), F.when(F.col("id") < 900, F.col("id") + 10).otherwise(3).alias("n"))
    rows = [(r["term"], r["n"]) for r in totals.collect()]
    for size in (900, 2500, 6000, 9000):
        expected = set(sorted(rows, key=lambda r: (-r[1], r[0]))[:size])
        assert {(r["term"], r["n"]) for r in top_terms(totals, size).collect()} == expected


def test_null_is_a_stratum_in_every_path(spark):
    df = spark.range(3000).select(
        F.col("id").alias("claim_id"), F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("tag_clean"))
    for limit in (1000, 1001, 5):
        sizes = {r["tag_clean"]: r["count"] for r in sampling.balanced_per_class(df, limit).groupBy("tag_clean").count().collect()}
        assert sizes == dict.fromkeys((None, "a", "b"), min(limit, 1000))
    split = sampling.nested_sample(sampling.stratified_split(df), 60)
    assert split.count() == 3000 and split.where("split = 'test'").count() == 600
    assert {r["tag_clean"]: r["count"] for r in split.where("in_sample").groupBy("tag_clean").count().collect()} == dict.fromkeys((None, "a", "b"), 20)
