"""WIN-05 against a plain selection, and the rule for broadcasts."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import judge as J
from cohortlens.session import bounded_broadcast


def _cases(rng, n, groups=("g", "h")):
    return [(rng.choice(groups), f"s{i:03d}", rng.choice(["test", "train", "external"]), rng.randrange(3), rng.randrange(3),
             rng.randrange(10) / 10, rng.randrange(4) / 10, rng.choice([0, 0, 0, 1, 2])) for i in range(n)]


def _plain(cases, budget):
    out = []
    for g in sorted({c[0] for c in cases}):
        mine = [c for c in cases if c[0] == g]
        order = lambda c: (c[5], c[6], c[2], c[1])
        wrong = lambda c: c[3] != c[4]
        prior = sorted((c for c in mine if wrong(c) or c[7] > 0 or c[4] == 1), key=lambda c: (not wrong(c), -c[7], *order(c)))
        taken = prior[:max(1, budget // 2)]
        reasons = ["misclassified_priority" if wrong(c) else "safety_flag_priority" if c[7] else "borderline_priority" for c in taken]
        buckets = {}
        for c in sorted((c for c in mine if c not in taken), key=order):
            buckets.setdefault((c[2], c[4]), []).append(c)
        turn = 0
        while len(taken) < budget and any(len(b) > turn for b in buckets.values()):
            for key in sorted(buckets):
                if len(buckets[key]) > turn and len(taken) < budget:
                    taken.append(buckets[key][turn])
                    reasons.append("split_class_representative")
            turn += 1
        out += [(g, c[1], k + 1, r) for k, (c, r) in enumerate(zip(taken, reasons))]
    return sorted(out)


@pytest.mark.parametrize("n, budget, salts", [(300, 24, 64), (300, 24, 2), (40, 24, 64), (5, 24, 4), (120, 1, 8), (120, 60, 3)])
def test_selected_cases_equal_a_plain_selection(spark, n, budget, salts):
    cases = _cases(random.Random(n + budget), n)
    df = spark.createDataFrame(cases, "model string, sample_id string, split string, true_label int, predicted_label int, "
                                      "confidence double, top_two_margin double, safety_flag_count int")
    got = J.select_cases(df, ["model"], budget, salts)
    assert got.columns == [*df.columns, "selection_order", "selection_reason"]
    assert sorted((r.model, r.sample_id, r.selection_order, r.selection_reason) for r in got.collect()) == _plain(cases, budget)
    first = J.priority_cases(df, ["model"], budget).collect()
    want = {x[:3] for x in _plain(cases, budget) if x[3] != "split_class_representative"}
    assert {(r.model, r.sample_id, r.selection_order) for r in first} == want


def test_no_broadcast_of_rows_that_the_estimate_does_not_count(spark):
    small = spark.range(10).withColumn("many", F.expr("sequence(1, 1000)"))
    hinted = lambda df: "strategy=broadcast" in bounded_broadcast(df)._jdf.queryExecution().analyzed().toString()
    assert hinted(small) and not hinted(small.select("id", F.explode("many")))
    assert not hinted(spark.range(10 ** 9))
