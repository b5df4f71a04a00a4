"""Grouped stratified splits that balance rows (WIN-10).

A group (a person) goes whole into one split, yet the splits should hold their
shares of the *rows* and of each label. Two kinds of groups are dealt apart:

* *Heavy groups* have more than 1 / ``HEAVY`` of all rows, so there are fewer
  than ``HEAVY`` of them. They are placed one after the other, largest first,
  where they overshoot the wanted rows of each label least, and among equals
  where the largest part of a split is still missing.
* *Light groups* fill what is missing. They are dealt inside strata of their
  label profile (share of positive rows in tenths): along a seeded order, the
  running sum of group sizes is cut where each split has its rows. Sums are
  distributed (``prefix_sum``); a group is never compared with another.
  The rounding of all strata together is then taken back in the largest one,
  so the splits miss their rows by about one light group, not one per stratum.

The driver sees the heavy groups and two sums per stratum, bounded whatever the
number of groups. The jobs run when the split is declared.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.dist import MAX_BROADCAST_GROUPS, prefix_sum, seeded_key
from cohortlens.session import checkpoint_dir

#: Groups of more than 1 / HEAVY of all rows are placed singly.
HEAVY = 200
#: Splits in the order in which light rows are cut off; the last takes the rest.
SPLITS = ("test", "validation", "train")


def fold_weights(folds: tuple[int, int]) -> tuple[int, dict[str, int]]:
    """Whole-number weights: one of ``folds[0]`` parts to test, one of ``folds[1]`` parts of the rest to validation."""
    outer, inner = folds
    total = outer * inner
    return total, {"test": inner, "validation": outer - 1, "train": total - inner - (outer - 1)}


@dataclass
class Need:
    """Rows of each label (positive, other) that the splits want and have; wants are scaled by ``total``."""

    total: int
    weights: dict[str, int]
    rows: tuple[int, int]
    have: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self):
        self.have = self.have or {k: [0, 0] for k in SPLITS}

    def missing(self, split: str, c: int) -> int:
        return self.weights[split] * self.rows[c] - self.total * self.have[split][c]

    def overshoot(self, split: str, group: tuple[int, int]) -> int:
        """Rows beyond the wanted ones of each label that the group would add to the split."""
        over = 0
        for c in (0, 1):
            m = self.missing(split, c)
            over += max(0, self.total * group[c] - m) - max(0, -m)
        return over

    def place(self, group: tuple[int, int]) -> str:
        """Put a (positive rows, other rows) group into the split that suits it best."""
        base = lcm(*self.weights.values())

        def cost(split: str):
            part_missing = (self.missing(split, 0) + self.missing(split, 1)) * (base // self.weights[split])
            return self.overshoot(split, group), -part_missing, SPLITS.index(split)

        best = min(SPLITS, key=cost)
        for c in (0, 1):
            self.have[best][c] += group[c]
        return best

    def share(self, split: str, c: int) -> float:
        """The part of the light rows of a label that the split takes."""
        left = {k: max(0, self.missing(k, c)) for k in SPLITS}
        whole = sum(left.values())
        return left[split] / whole if whole else self.weights[split] / self.total


def check_grouped_input(df: DataFrame, group: str, label: str) -> None:
    """Error unless there are 8 groups or more and both labels."""
    missing = sorted({group, label} - set(df.columns))
    if missing:
        raise ValueError(f"a grouped split needs the columns {', '.join(missing)}")
    stats = df.agg(F.countDistinct(group).alias("g"), F.countDistinct(label).alias("k")).first()
    _check(stats["g"], stats["k"])


def _check(n_groups: int, n_labels: int) -> None:
    if n_groups < 8:
        raise ValueError(f"a grouped split needs 8 groups or more, got {n_groups}")
    if n_labels < 2:
        raise ValueError(f"a grouped split needs 2 labels or more, got {n_labels}")


def _cut(groups: DataFrame, bounds: dict[int, list[float]]) -> F.Column:
    """The split of a light group: where the middle of its rows lies between the bounds of its stratum."""
    middle = 2 * F.col("n_cum") - F.col("n")

    def bound(i: int):
        pairs = [x for s, b in bounds.items() for x in (F.lit(s), F.lit(float(b[i])))]
        return 2 * F.element_at(F.create_map(*pairs), F.col("stratum"))

    return F.when(middle <= bound(0), SPLITS[0]).when(middle <= bound(1), SPLITS[1]).otherwise(SPLITS[2])


def assign_groups(df: DataFrame, group: str, label: str, seed: int | str, folds: tuple[int, int]) -> DataFrame:
    """(group, split) of every group; rows without a group are one group of their own."""
    missing = sorted({group, label} - set(df.columns))
    if missing:
        raise ValueError(f"a grouped split needs the columns {', '.join(missing)}")
    spark = df.sparkSession
    checkpoint_dir(spark)
    positive = F.count_if(F.col(label).cast("double") > 0)
    groups = (df.groupBy(F.col(group).alias("_group"))
              .agg(F.count(F.lit(1)).alias("n"), positive.alias("pos"),
                   F.count_if(F.col(label).cast("double") <= 0).alias("neg"))
              .withColumn("stratum", F.round(F.col("pos") * 10 / F.col("n")).cast("int"))
              .withColumn("k", F.coalesce(seeded_key("_group", seed), F.lit("")))
              .checkpoint(eager=True))  # narrow: one row per group
    total = groups.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                       F.count("_group").alias("groups")).first()
    _check(total["groups"], (1 if total["pos"] else 0) + (1 if total["neg"] else 0))
    scale, weights = fold_weights(folds)
    need = Need(scale, weights, (total["pos"], total["n"] - total["pos"]))
    heavy = F.col("n") * HEAVY > total["n"]
    placed = [(r["_group"], need.place((r["pos"], r["n"] - r["pos"])))
              for r in groups.filter(heavy).orderBy(F.desc("n"), "k").collect()]  # fewer than HEAVY rows
    schema = f"_group {groups.schema['_group'].dataType.simpleString()}, split string"
    out = spark.createDataFrame(placed, schema)

    light = groups.filter(~heavy)
    strata = {r["stratum"]: (r["n"], r["pos"]) for r in  # at most 11 rows
              light.groupBy("stratum").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()}
    if not strata:
        return out.withColumnRenamed("_group", group)
    cum = prefix_sum(light.select("_group", "n", "stratum", "k"), ["stratum"], [F.col("k"), F.col("_group")], ["n"])
    want = {s: [pos * need.share(k, 0) + (n - pos) * need.share(k, 1) for k in SPLITS] for s, (n, pos) in strata.items()}
    bounds = {s: [w[0], w[0] + w[1]] for s, w in want.items()}
    got = {r["split"]: r["n"] for r in  # three rows
           cum.groupBy(_cut(cum, bounds).alias("split")).agg(F.sum("n").alias("n")).collect()}
    largest = min(strata, key=lambda s: (-strata[s][0], s))
    first = got.get(SPLITS[0], 0) - sum(want[s][0] for s in sorted(want))
    second = got.get(SPLITS[1], 0) - sum(want[s][1] for s in sorted(want))
    bounds[largest] = [bounds[largest][0] - first, bounds[largest][1] - first - second]
    return out.unionByName(cum.select("_group", _cut(cum, bounds).alias("split"))).withColumnRenamed("_group", group)


def grouped_split(df: DataFrame, group: str, label: str, seed: int | str, folds: tuple[int, int]) -> DataFrame:
    """``df`` with a ``split`` column; no group in two splits, rows and labels in the shares of ``folds``."""
    assigned = assign_groups(df, group, label, seed, folds).withColumnRenamed(group, "_group")
    # Counted: a table of groups that is small enough spares the rows of a heavy group the shuffle.
    if assigned.count() <= MAX_BROADCAST_GROUPS:
        assigned = F.broadcast(assigned)
    return df.join(assigned, F.col(group).eqNullSafe(F.col("_group")), "inner").drop("_group")
