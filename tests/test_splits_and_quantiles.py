"""WIN-10 by size, exact quantiles by sketch and bracket, sparse histograms, last rows, coercion."""

import random
import statistics
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import datasets as D
from cohortlens.operators import dist
from cohortlens.operators import profile as P
from cohortlens.operators import splits as SPL

WANT = {"test": Fraction(1, 5), "validation": Fraction(1, 10), "train": Fraction(7, 10)}


def _frame(spark, groups):
    """groups: (rows, positive rows)"""
    rows = [(g, i, int(i < pos)) for g, (n, pos) in enumerate(groups) for i in range(n)]
    return spark.createDataFrame(rows, "person long, row int, label int")


def _shares(out):
    got = {s: [0, 0] for s in WANT}
    for r in out.groupBy("split", "label").count().collect():
        got[r["split"]][r["label"]] += r["count"]
    return got


def _greedy(groups):
    """Groups, largest first, each to the split that misses its rows of either label most (a search over all groups)."""
    rows = sum(n for n, _ in groups), sum(p for _, p in groups)
    have = {s: [0, 0] for s in WANT}
    for n, pos in sorted(groups, reverse=True):
        def cost(s):
            total = Fraction(0)
            for k in WANT:
                add = (n, pos) if k == s else (0, 0)
                for c, all_c in ((1, rows[1]), (0, rows[0] - rows[1])):
                    h = have[k][c] + (add[1] if c else add[0] - add[1])
                    total += (h - WANT[k] * all_c) ** 2
            return total
        best = min(WANT, key=cost)
        have[best][1] += pos
        have[best][0] += n - pos
    return have


def _miss(have, groups):
    rows = sum(n for n, _ in groups)
    return max(abs(sum(have[s]) - WANT[s] * rows) for s in WANT)



@pytest.mark.parametrize("make", [
    lambda rng: [(400, 130)] + [(n, rng.randrange(n + 1)) for n in (rng.randrange(1, 12) for _ in range(260))],
    lambda rng: [(n, rng.randrange(n + 1)) for n in (rng.randrange(1, 4) for _ in range(900))],
    lambda rng: [(n, n // 2) for n in [300, 250, 200, 120, 90, 60, 40, 30, 20, 10] + [5] * 60],
    lambda rng: [(10, 10 * (g % 2)) for g in range(120)],
    lambda rng: [(rng.randrange(20, 200), rng.randrange(20)) for _ in range(25)]])
def test_grouped_split_balances_rows_within_one_group_like_a_greedy_search(spark, make):
    groups = make(random.Random(4))
    out = D.grouped_split(_frame(spark, groups), "person", "label")
    assert D.leaks(out, "person").count() == 0
    have, largest = _shares(out), max(n for n, _ in groups)
    assert sum(map(sum, have.values())) == sum(n for n, _ in groups)
    assert _miss(have, groups) <= largest
    assert _miss(have, groups) <= _miss(_greedy(groups), groups) + max(10, largest // 10)
    pos = sum(p for _, p in groups)
    for s, share in WANT.items():
        assert abs(have[s][1] - share * pos) <= largest


def test_one_person_with_a_fifth_of_the_rows_does_not_skew_the_split(spark):
    rng = random.Random(1)
    groups = [(500, 200)] + [(n, rng.randrange(n + 1)) for n in (rng.randrange(1, 9) for _ in range(440))]
    have = _shares(D.grouped_split(_frame(spark, groups), "person", "label"))
    rows = sum(n for n, _ in groups)
    for s, share in WANT.items():
        assert abs(sum(have[s]) - share * rows) <= 9  # the others make up for it: within a light group


def test_splits_raise_on_short_or_one_class_input(spark):
    few = _frame(spark, [(5, 2)] * 7)
    with pytest.raises(ValueError, match="8 groups"):
        D.grouped_split(few, "person", "label")
    with pytest.raises(ValueError, match="2 labels"):
        D.grouped_split(_frame(spark, [(5, 0)] * 20), "person", "label")
    with pytest.raises(ValueError, match="needs the columns person_id"):
        D.grouped_split(few, "person_id", "label")
    with pytest.raises(ValueError, match="2 classes"):
        D.stratified_split(_frame(spark, [(5, 0)] * 20), "row", "label", least_rows=D.MIN_SPLIT_ROWS)
    with pytest.raises(ValueError, match="10 rows"):
        D.stratified_split(_frame(spark, [(3, 1)]), "row", "label", least_rows=D.MIN_SPLIT_ROWS)
    notes = spark.createDataFrame([("x" * 150,), ("y",)], "note_text string")
    assert D.candidate_pool(notes, at_least=1).count() == 1
    with pytest.raises(ValueError, match="2 notes wanted, 1 available"):
        D.candidate_pool(notes, at_least=2)


def test_need_places_a_group_that_no_split_can_hold():
    need = SPL.Need(*SPL.fold_weights((5, 8)), (50, 50))
    assert need.place((0, 90)) == "train"  # the least overshoot
    assert need.place((10, 0)) == "test" and need.have["test"] == [10, 0]


# ---------------------------------------------------------------- quantiles


def test_exact_quantiles_of_many_distinct_values(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=30_001), "b": np.round(rng.exponential(5, 8000)), "c": np.array([2.5]),
              "d": np.concatenate([np.full(500, 7.0), [1e18, -1e18]])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("e", None), (None, 4.0)],
                               "g string, v double")
    at = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "p99": 0.99, "lo": 0.0, "hi": 1.0}
    for sketch in (10_000, 50):  # a coarse sketch only widens the bracket
        got = {r["g"]: r for r in dist.exact_quantiles(df, ["g"], "v", at, sketch).collect()}
        assert set(got) == {"a", "b", "c", "d", None} and got[None]["q2"] == 4.0
        for g, vs in values.items():
            for name, q in at.items():
                assert got[g][name] == pytest.approx(float(np.quantile(vs, q)), rel=1e-12)
    one = dist.exact_quantiles(df.filter("g = 'a'"), [], "v", {"m": 0.5}, 100).first()
    assert one["m"] == pytest.approx(float(np.median(values["a"])))


def test_quantile_brackets_leave_most_values_unsorted(spark):
    df = spark.range(100_000).select((F.xxhash64("id") % 10 ** 9).cast("double").alias("v"))
    plan = dist.exact_quantiles(df, [], "v", {"m": 0.5}, 1000)
    assert plan.count() == 1
    inside = 6 / 1000 * 100_000
    values = sorted(r.v for r in df.collect())
    assert plan.first()["m"] == statistics.median(values) and inside < len(values) / 100


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert dist.exact_quantiles(none, [], "v", {"m": 0.5}).first()["m"] is None
    assert dist.exact_quantiles(none, ["g"], "v", {"m": 0.5}).count() == 0
    assert P.describe(none, "v").first().asDict() == {"n": 0, "min": None, "max": None, "mean": None, "median": None}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(-3, 3), st.integers(1, 5)), min_size=1, max_size=12))
def test_count_quantiles_equal_the_spelled_out_values(spark, rows):
    counts = {}
    for g, v, n in rows:
        counts[g, v] = counts.get((g, v), 0) + n
    df = spark.createDataFrame([(g, v, n) for (g, v), n in counts.items()], "g string, v int, n long")
    got = {r["g"]: (r["m"], r["q"]) for r in dist.count_quantiles(df, ["g"], "v", "n", {"m": 0.5, "q": 0.9}).collect()}
    for g in {g for g, _ in counts}:
        spelled = [v for (h, v), n in counts.items() if h == g for _ in range(n)]
        assert got[g] == pytest.approx((float(np.quantile(spelled, 0.5)), float(np.quantile(spelled, 0.9))))


def test_medians_of_two_columns(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 9, 30.0), ("b", None, 5.0)], "g string, x int, y double")
    got = {r["g"]: (r["mx"], r["my"]) for r in dist.exact_medians(df, ["g"], {"mx": "x", "my": "y"}).collect()}
    assert got == {"a": (2.0, 20.0), "b": (None, 5.0)}


# ---------------------------------------------------------------- histogram, last rows, coercion


def test_a_wild_value_makes_a_gap_and_not_a_row_per_integer(spark):
    df = spark.createDataFrame([("g", 3), ("g", 3), ("g", 5), ("g", 10 ** 18), ("h", -(2 ** 63)), ("h", 2 ** 63 - 1), ("h", None)],
                               "k string, v long")
    got = sorted((r.k, r.value, r.value_to, r.n) for r in P.unit_histogram(df, "v", ["k"]).collect())
    assert got == [("g", 3, 3, 2), ("g", 4, 4, 0), ("g", 5, 5, 1), ("g", 6, 10 ** 18 - 1, 0), ("g", 10 ** 18, 10 ** 18, 1),
                   ("h", -(2 ** 63), -(2 ** 63), 1), ("h", -(2 ** 63) + 1, 2 ** 63 - 2, 0), ("h", 2 ** 63 - 1, 2 ** 63 - 1, 1)]
    short = P.unit_histogram(df.filter("k = 'g'"), "v", dense_range=1)
    assert sorted((r.value, r.value_to) for r in short.filter("n = 0").collect()) == [(4, 4), (6, 10 ** 18 - 1)]


def test_last_rows_ties_repeats_and_null_keys(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 5, "p"), ("b", 5, "q"), (None, None, "n"), (None, 0, "m")]
    df = spark.createDataFrame(rows, "k string, o int, t string")
    got = {r.k: (r.o, r.t) for r in D.last_record(df, "k", "o").collect()}
    assert D.last_record(df, "k", "o").count() == 3
    assert got["a"] == (2, "y") and got[None] == (0, "m") and got["b"] in ((5, "p"), (5, "q"))
    plan = D.last_record(df.filter("k = 'b'"), "k", "o")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_coerced_dates_and_numbers(spark):
    df = spark.createDataFrame([("2024-02-29", "12"), ("2023-02-29", " 7 "), (" 2024-01-05 10:30:00", "NaN"), ("x", "-1"), ("", "0"),
                                (None, None), ("2024-1-5", "1e2")], "d string, n string")
    assert [str(r.d) for r in P.coerce_dates(df, ["d", "absent"]).collect()] == [
        "2024-02-29", "None", "2024-01-05", "None", "None", "None", "2024-01-05"]
    assert sorted(r.n_clean for r in P.coerce_positive(df, "n").collect()) == [7.0, 12.0, 100.0]
    tables = P.coerce_table_dates({"note": df.select(F.col("d").alias("note_date")), "person": df})
    assert tables["note"].dtypes == [("note_date", "date")] and tables["person"].dtypes == df.dtypes


def test_required_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in D.required_columns(df, ["a", "b", "c"]).collect()] == [("a", True, 0), ("b", True, 1), ("c", False, None)]
