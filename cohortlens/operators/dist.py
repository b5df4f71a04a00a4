"""Distributed ordering helpers (global rank, prefix sums, seeded order).

A global rank or a running sum over a whole table is, written naively, a
window without ``partitionBy`` — Spark then moves every row into one task.
Here the frame is range-partitioned on the (total) order, fixed by a reliable
checkpoint so partition contents cannot change between passes, numbered
inside each partition, and shifted by the exclusive running total of the
partition sizes. Only the per-partition totals table (one row per partition
and group) is small enough to be windowed unpartitioned.

Callers rank narrow frames (keys and ids). Where only a cut through a seeded
order is wanted (splits, samples), ``seeded_cuts`` finds it from counts, and
wide rows are neither sorted nor moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import checkpoint_dir

#: One row per group, checked by a count, may be broadcast up to this many.
MAX_BROADCAST_GROUPS = 500_000
_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row index


def seeded_key(id_col, seed: int | str) -> Column:
    """Reproducible pseudo-random order key: sha256('<seed>:<id>')."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_GROUPS) -> DataFrame:
    """``df`` (one row per group), computed once; broadcast only when its counted rows are within ``max_rows``."""
    checkpoint_dir(df.sparkSession)
    fixed = df.checkpoint(eager=True)
    return F.broadcast(fixed) if fixed.count() <= max_rows else fixed


def _fixed_ranges(df: DataFrame, order: list[Column | str], partitions: int | None) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    # Without a count AQE merges small ranges; a large cluster sets the session's shuffle width.
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    # Reliable checkpoint: partition contents survive executor loss and stay
    # identical for the counting pass and the numbering pass.
    return ranged.sortWithinPartitions(*order).checkpoint(eager=True)


def dist_rank(df: DataFrame, order: list[Column | str], out: str = "rank",
              partitions: int | None = None) -> DataFrame:
    """1-based global rank by ``order`` (which must be a total order)."""
    fixed = _fixed_ranges(df, order, partitions)
    ided = (fixed.withColumn("_mid", F.monotonically_increasing_id())
            .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
            .withColumn("_loc", F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)))
    sizes = ided.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_size").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0))).select("_pid", "_off")
    return (ided.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_loc") + 1)
            .drop("_mid", "_pid", "_loc", "_off"))


def rank_within(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """1-based rank inside each key group, computed from one global rank.

    Large groups (a third of all rows in one class) are spread over many
    range partitions instead of one window task.
    """
    ranked = dist_rank(df, [F.col(k) for k in keys] + list(order), "_g", partitions)
    starts = ranked.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_g").alias("_start"))
    if starts.count() <= MAX_BROADCAST_GROUPS:  # the ranked rows are not moved again for a look-up per class
        starts = F.broadcast(starts)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (ranked.join(starts, same, "inner")
            .withColumn(out, F.col("_g") - F.col("_start") + 1).drop("_g", "_start", *[f"_k_{k}" for k in keys]))


def prefix_sum(df: DataFrame, by: list[str], order: list[Column | str], cols: list[str],
               partitions: int | None = None, suffix: str = "_cum", total_suffix: str | None = None) -> DataFrame:
    """Inclusive running sums of ``cols`` inside each ``by`` group along ``order``.

    ``df`` should already be aggregated to one row per (by, order) value. With
    ``total_suffix`` the group totals come along, from the same small table of
    per-partition sums, so no join on the (few, hot) group keys is needed.
    """
    keys = [F.col(k) for k in by] + list(order)
    fixed = _fixed_ranges(df, keys, partitions)
    tagged = fixed.withColumn("_pid", F.spark_partition_id())
    totals = tagged.groupBy("_pid", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w_all = Window.partitionBy(*by)
    w_off = w_all.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    small = totals.select(F.col("_pid").alias("_op"), *[F.col(k).alias(f"_o_by_{k}") for k in by],
                          *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}") for c in cols],
                          *[F.sum(f"_t_{c}").over(w_all).alias(f"_all_{c}") for c in cols])
    # Ranges are contiguous, so this has about as many rows as partitions plus groups.
    offsets = F.broadcast(small) if totals.count() <= MAX_BROADCAST_GROUPS else small
    w_in = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(c).over(w_in).alias(f"_l_{c}") for c in cols])
    same = [F.col("_pid") == F.col("_op")] + [F.col(k).eqNullSafe(F.col(f"_o_by_{k}")) for k in by]
    whole = [F.col(f"_all_{c}").alias(f"{c}{total_suffix}") for c in cols] if total_suffix else []
    return local.join(offsets, same, "inner").select(
        *df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"{c}{suffix}") for c in cols], *whole)


def last_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` per key (null keys are keys); equal orders: the greatest row hash.

    Only the keys, the order and a 64-bit row hash are aggregated; the chosen rows are met again by a join, so no text
    is sorted or buffered. Rows that agree in all columns are one.
    """
    checkpoint_dir(df.sparkSession)
    names = [*keys, *[c for c in df.columns if c not in keys]]
    hashed = df.withColumn("_last_row", F.xxhash64(*names))
    counts = hashed.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(order).alias("_last_order"), F.col("_last_row").alias("_last_hash")).agg(
        F.count(F.lit(1)).alias("_last_times"))
    own = [f"_k_{k}" for k in keys]
    last = counts.groupBy(*own).agg(F.max(F.struct("_last_order", "_last_hash", "_last_times")).alias("_last")).select(
        *own, "_last._last_order", "_last._last_hash", "_last._last_times")
    last = last.checkpoint(eager=True)  # narrow
    same = [*same_keys(keys, "_k_"), F.col(order).eqNullSafe(F.col("_last_order")), F.col("_last_row") == F.col("_last_hash")]
    chosen = hashed.join(last.filter("_last_times = 1"), same, "left_semi").select(names)
    repeated = last.filter("_last_times > 1")
    if repeated.isEmpty():
        return chosen
    return chosen.unionByName(hashed.join(repeated, same, "left_semi").select(names).dropDuplicates(keys))


#: Relative error of the quantile sketch that brackets a value; a bracket holds about 6 / SKETCH of a group's rows.
SKETCH = 10_000


def same_keys(by: list[str], prefix: str) -> list[Column]:
    """Join condition on ``by`` against columns of the same names behind ``prefix``; null keys meet."""
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in by]


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right`` (one row per group); null group keys are keys like others."""
    if not by:
        return left.join(F.broadcast(right), F.lit(True), how)  # one row
    named = right.select(*[F.col(k).alias(f"_j_{k}") for k in by], *[c for c in right.columns if c not in by])
    return left.join(named, same_keys(by, "_j_"), how).drop(*[f"_j_{k}" for k in by])


def exact_quantiles(df: DataFrame, by: list[str], col: str, at: dict[str, float], sketch: int = SKETCH) -> DataFrame:
    """Exact quantiles (linear interpolation) of ``col`` per group, one column per entry of ``at``.

    1. A mergeable sketch per group gives a bracket that surely holds the
       wanted ranks: its rank error is 1 / ``sketch``, the bracket is three
       times as wide to both sides.
    2. One count of the rows below each bracket and of every value inside.
       Values outside are only counted, so neither a group's values nor its
       distinct values are ever sorted or held in a buffer.

    Nulls are left out; groups without a value give no row (without ``by``: a row of nulls). The sketch (one row
    per group) is computed when the quantiles are declared.
    """
    spark = df.sparkSession
    values = df.select(*by, F.col(col).cast("double").alias("_v")).filter("_v IS NOT NULL")
    margin = 3.0 / sketch
    ends = [x for q in at.values() for x in (max(0.0, q - margin), min(1.0, q + margin))]
    groups = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"),
                                     F.percentile_approx("_v", [float(x) for x in ends], sketch).alias("_p"))
    bounds = [f"_{side}{i}" for i in range(len(at)) for side in ("lo", "hi")]
    groups = groups.select(*[F.col(k).alias(f"_s_{k}") for k in by], "_total",
                           *[F.col("_p")[i].alias(b) for i, b in enumerate(bounds)])
    if by:
        known = values.join(checked_broadcast(groups), same_keys(by, "_s_"))
    else:  # one row
        first = groups.first()
        if first[bounds[0]] is None:
            return spark.createDataFrame([tuple(None for _ in at)], ", ".join(f"{n} double" for n in at))
        known = values.select("_v", *[F.lit(first[c]).alias(c) for c in groups.columns])
    inside = [F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(at))]
    any_inside = F.lit(False)
    for x in inside:
        any_inside = any_inside | x
    # Outside values share the null key, whose row comes first in each group.
    counts = known.withColumn("_key", F.when(any_inside, F.col("_v"))).groupBy(*by, "_total", *bounds, "_key").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_b{i}") for i in range(len(at))])
    counts = counts.withColumnRenamed("_key", "_v")
    whole = Window.partitionBy(*by)
    running = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(*by, "_v", "_n", "_total", *[
        c for i in range(len(at)) for c in (
            inside[i].alias(f"_in{i}"),
            (F.sum(f"_b{i}").over(whole) + F.sum(F.when(inside[i], F.col("_n")).otherwise(0)).over(running)).alias(f"_c{i}"))])
    return _interpolated(ranked, by, at)


def count_quantiles(counts: DataFrame, by: list[str], col: str, n: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles where ``counts`` already has one row per group and value, ``n`` times each.

    For values that are few by their nature (counts per person, bands); a group's distinct values share a window.
    """
    whole = Window.partitionBy(*by)
    ranked = counts.filter(F.col(col).isNotNull()).select(
        *by, F.col(col).cast("double").alias("_v"), F.col(n).alias("_n"), F.sum(n).over(whole).alias("_total"),
        F.sum(n).over(whole.orderBy(col).rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"))
    for i in range(len(at)):
        ranked = ranked.withColumn(f"_in{i}", F.lit(True)).withColumn(f"_c{i}", F.col("_cum"))
    return _interpolated(ranked, by, at)


def _interpolated(ranked: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """Quantiles from values ``_v`` that end at the running count ``_c<i>`` where they are candidates (``_in<i>``)."""
    found, out = [F.max("_total").alias("_total")], []
    for i, (name, q) in enumerate(at.items()):
        place = F.lit(float(q)) * (F.col("_total") - 1)
        for side, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            holds = F.col(f"_in{i}") & (F.col(f"_c{i}") > index) & (F.col(f"_c{i}") - F.col("_n") <= index)
            found.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        mixed = (F.ceil(place) - place) * lo + (place - F.floor(place)) * hi
        out.append(F.when(F.col("_total").isNull(), F.lit(None).cast("double"))
                   .when(lo.isNull() | hi.isNull(), F.raise_error(F.lit("quantile outside the bracket of its sketch")))
                   .when(lo == hi, lo).otherwise(mixed).cast("double").alias(name))
    return ranked.groupBy(*by).agg(*found).select(*by, *out)


def exact_medians(df: DataFrame, by: list[str], cols: dict[str, str]) -> DataFrame:
    """Exact medians of several columns, named as in ``cols`` (name -> column), in the two passes of one."""
    tall = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("v")) for name, c in cols.items()])).alias("_x"))
    found = exact_quantiles(tall.select(*by, F.col("_x.name").alias("_name"), F.col("_x.v").alias("_value")),
                            [*by, "_name"], "_value", {"_median": 0.5})
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_median"))).alias(name) for name in cols])


#: Leading hex digits of the seeded key that are counted: about a million slots per class.
SLOT_DIGITS = 5


def order_key(id_col: str, seed: int | str) -> Column:
    """(seeded key, id) as one comparable value; rows without an id come first."""
    return F.struct(F.coalesce(seeded_key(id_col, seed), F.lit("")).alias("k"), F.col(id_col).alias("id"))


def seeded_cuts(df: DataFrame, by: list[str], id_col: str, seed: int | str, quotas: DataFrame) -> DataFrame:
    """(by..., cut): the ``order_key`` of the last row that each class's ``quota`` admits.

    ``quotas`` has (by..., quota). Rows are counted per class and leading
    digits of the key (combined before the shuffle); only the rows of the one
    slot where the quota ends are ordered. A quota beyond the class gives its
    last row, a quota of 0 no row. Rows with one id stand and fall together.
    """
    keyed = df.select(*by, order_key(id_col, seed).alias("_o")).withColumn(
        "_slot", F.substring("_o.k", 1, SLOT_DIGITS))
    slots = keyed.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*by).orderBy("_slot")
    wanted = quotas.select(*[F.col(k).alias(f"_q_{k}") for k in by], "quota")
    same = [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in by] or [F.lit(True)]
    ends = (slots.withColumn("_before", F.sum("_n").over(along) - F.col("_n"))
            .withColumn("_last", F.lead("_slot").over(along).isNull())
            .join(F.broadcast(wanted), same)  # one row per class
            .filter((F.col("_before") < F.col("quota"))
                    & ((F.col("_before") + F.col("_n") >= F.col("quota")) | F.col("_last")))
            .select(*[F.col(k).alias(f"_e_{k}") for k in by], F.col("_slot").alias("_e_slot"),
                    F.least(F.col("quota") - F.col("_before"), F.col("_n")).alias("_need")))
    here = [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in by] + [F.col("_slot") == F.col("_e_slot")]
    inside = keyed.join(F.broadcast(ends), here).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*by).orderBy("_o")))
    return inside.filter(F.col("_r") == F.col("_need")).select(*by, F.col("_o").alias("cut"))


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column | str], k: int, salt_by: str | None = None,
                    salts: int = 64, out: str = "rank") -> DataFrame:
    """Rows ranked 1..k inside each key group (``order`` must be total).

    Two stages so a hot group never lands in one task whole: first the top k
    of every (group, salt) slice, where the salt is a hash of ``salt_by``,
    then the top k of the at most ``k * salts`` survivors per group.
    """
    if salt_by is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_by)), F.lit(salts)))
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w2)).filter(F.col(out) <= k)
