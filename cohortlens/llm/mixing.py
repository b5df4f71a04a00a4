"""Mixing sources to target weights by hierarchical budgeting (operator 7).

The tree is root - domain - language - source. A node's capacity is the tokens
below it times ``max_epochs``. The root's budget is a share of the corpus; each
node deals its budget to its children by weight, a child that cannot use its
share takes its capacity, and what it leaves goes to its siblings by weight
again (water filling). Because a child's capacity is that of its whole
subtree, a shortage is made up among siblings first and reaches an ancestor
only when the whole subtree is used up.

A leaf's budget buys whole epochs and a prefix of one more: documents in an
order seeded by (seed, epoch, doc_id), as long as the running token count fits.
The running count never needs a leaf in one task: tokens are summed per (leaf,
leading digits of the order key), those sums are accumulated, and only rows
with the same leading digits are ordered.

Counts of tokens are integers and shares are integer divisions, so results do
not depend on partitioning. Edge cases: documents without words (null or blank
text) have no tokens and are not part of a mix; null lang or source count as
the value ``(none)``; rows with the same id tie in the order and are taken or
left together; weights default to 1, a weight of 0 gives nothing; an empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import n_words, stored

LEAF = ["domain", "lang", "source"]
NONE = "(none)"
#: Rows of the budget table (about 100 bytes each) that may be broadcast.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mix:
    """Target weights (by name, 1 where absent), budget and epochs."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    percent: int = 50  #: budget as a percentage of the corpus tokens
    max_epochs: int = 3
    seed: int = 7


def domain_of(source: Column) -> Column:
    """The domain of a source, where the table has none: four groups by the first digit of its MD5."""
    return F.concat(F.lit("d"), F.floor((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source), 1, 1)) - 1) / 4)
                    .cast("string"))


def _weight(names: dict[str, int], col: str) -> Column:
    out = F.lit(1)
    for name, w in names.items():
        out = F.when(F.col(col) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _deal(children: DataFrame, parent: list[str], names: list[str], budget: str) -> DataFrame:
    """Water filling inside every parent: adds ``alloc`` to rows with ``cap``, ``w`` and the parent's ``budget``.

    In the order of cap / w a child is full if, with everything smaller full,
    its proportional share of the rest covers its capacity.
    """
    num = lambda c: F.col(c).cast("decimal(38,0)")
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("w")).asc(), *names)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    used = F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    full = (F.col(budget) - used).cast("decimal(38,0)") * num("w") >= num("cap") * rest_w.cast("decimal(38,0)")
    marked = children.filter("w > 0").withColumn("_full", full)
    left = (F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0)))
    left_w = F.sum(F.when(~F.col("_full"), F.col("w"))).over(whole)
    share = F.expr("cast(floor(_left * w / _left_w) as long)")
    return (marked.withColumn("_left", left).withColumn("_left_w", left_w)
            .withColumn("alloc", F.when(F.col("_full"), F.col("cap")).otherwise(share))
            .drop("_full", "_left", "_left_w"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, alloc) from (domain, lang, source, tokens): one row per leaf."""
    leaf = leaves.select(*LEAF, "tokens", (F.col("tokens") * mix.max_epochs).alias("cap"))
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    dom = lang.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaf.agg(F.floor(F.sum("tokens") * mix.percent / 100).cast("long").alias("_b"))
    dom = dom.join(F.broadcast(total), F.lit(True)).withColumn("w", _weight(mix.domains, "domain"))  # one-row side
    dom = _deal(dom.withColumn("_root", F.lit(0)), ["_root"], ["domain"], "_b").select("domain", F.col("alloc").alias("_bd"))
    lang = _deal(lang.join(dom, "domain").withColumn("w", _weight(mix.langs, "lang")), ["domain"], LEAF[:2], "_bd")
    lang = lang.select("domain", "lang", F.col("alloc").alias("_bl"))
    out = _deal(leaf.join(lang, ["domain", "lang"]).withColumn("w", _weight(mix.sources, "source")),
                LEAF[:2], LEAF, "_bl")
    return out.select(*LEAF, "tokens", "alloc")


def _leaf_columns(docs: DataFrame) -> list[Column]:
    source = F.coalesce(F.col("source"), F.lit(NONE))
    return [domain_of(source).alias("domain"), F.coalesce(F.col("lang"), F.lit(NONE)).alias("lang"),
            source.alias("source")]


def choose(docs: DataFrame, mix: Mix = Mix(), keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies[, keep]) of every document in the mix.

    ``copies`` is how many epochs include it.
    """
    extra = keep or []
    base = docs.select(F.col("doc_id"), *_leaf_columns(docs), n_words(F.col("text")).alias("n_tokens"), *extra)
    base = stored(base.filter("n_tokens > 0"), "mix-tokens")
    names = base.columns
    sizes = base.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plan = stored(budgets(sizes, mix)
                  .select(*LEAF, F.expr("cast(alloc div tokens as long)").alias("_epochs"),
                          F.expr("alloc % tokens").alias("_rest")), "mix-plan")
    if plan.count() <= BROADCAST_LEAVES:  # else a shuffle join, whose hot leaves AQE splits
        plan = F.broadcast(plan)
    # Leading hex digits of the order key: a few thousand documents per group, whatever the corpus.
    digits = max(1, math.ceil(math.log(max(base.count(), 1) / 2048 + 1, 16)))
    key = F.sha2(F.concat_ws(":", F.lit(str(mix.seed)), F.col("_epochs").cast("string"),
                             F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))), 256)
    rows = (base.join(plan, LEAF).filter("_epochs > 0 OR _rest > 0")
            .withColumn("_key", key).withColumn("_slot", F.substring("_key", 1, digits)))
    slot = [*LEAF, "_slot"]
    sums = rows.groupBy(*slot).agg(F.sum("n_tokens").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*LEAF).orderBy("_slot")
                                           .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*slot, before.alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy(*slot).orderBy("_key")
                                    .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = rows.withColumn("_inside", inside).join(offsets, slot)
    copies = F.col("_epochs") + F.when(F.col("_before") + F.col("_inside") <= F.col("_rest"), 1).otherwise(0)
    return counted.withColumn("copies", copies.cast("long")).filter("copies > 0").select(*names, "copies")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Pipeline form: the chosen documents with their own columns, ``n_tokens`` and ``copies``."""
    names = [c for c in docs.columns if c not in ("n_tokens", "copies")]
    chosen = choose(docs, mix, [F.xxhash64("text").alias("_text")])
    chosen = chosen.select(F.col("doc_id").alias("_id"), "_text", F.col("n_tokens").alias("_tokens"),
                           F.col("copies").alias("_copies"), *[F.col(c).alias(f"_{c}") for c in LEAF]).distinct()
    leaf = _leaf_columns(docs)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    for c, col in zip(LEAF, leaf):
        same = same & (col == F.col(f"_{c}"))
    return docs.join(chosen, same).select(*names, F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"))


def _case(names: dict[str, int], col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{n}' THEN {w}" for n, w in names.items()) + " ELSE 1 END" \
        if names else "1"


def _deal_sql(name: str, source: str, parent: str, cols: str, budget: str) -> str:
    over = f"PARTITION BY {parent}"
    return f"""{name}0 AS (SELECT *, ({budget} - coalesce(sum(cap) OVER w1, 0))::HUGEINT * w >=
      cap::HUGEINT * (sum(w) OVER ({over}) - coalesce(sum(w) OVER w1, 0)) AS filled FROM {source} WHERE w > 0
      WINDOW w1 AS ({over} ORDER BY cap / w, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {name} AS (SELECT *, CASE WHEN filled THEN cap ELSE
      (({budget} - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({over}), 0)) * w) //
      (sum(CASE WHEN NOT filled THEN w END) OVER ({over})) END::BIGINT AS alloc FROM {name}0)"""


def sql(mix: Mix = Mix()) -> str:
    """The same rule in DuckDB."""
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
           WHERE text IS NOT NULL),
base AS (SELECT *, 'd' || ((strpos('0123456789abcdef', substr(md5(source), 1, 1)) - 1) // 4)::VARCHAR AS domain
         FROM t WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {mix.max_epochs} AS cap
         FROM base GROUP BY ALL),
lg AS (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaf GROUP BY ALL),
dm AS (SELECT domain, sum(cap)::BIGINT AS cap, {_case(mix.domains, 'domain')} AS w, 0 AS root,
         (SELECT (sum(tokens) * {mix.percent}) // 100 FROM leaf)::BIGINT AS b FROM lg GROUP BY domain),
{_deal_sql('da', 'dm', 'root', 'domain', 'b')},
lb AS (SELECT lg.*, {_case(mix.langs, 'lg.lang')} AS w, da.alloc AS b FROM lg JOIN da USING (domain)),
{_deal_sql('la', 'lb', 'domain', 'domain, lang', 'b')},
sb AS (SELECT leaf.*, {_case(mix.sources, 'leaf.source')} AS w, la.alloc AS b FROM leaf JOIN la USING (domain, lang)),
{_deal_sql('sa', 'sb', 'domain, lang', 'domain, lang, source', 'b')},
plan AS (SELECT domain, lang, source, alloc // tokens AS epochs, alloc % tokens AS rest FROM sa),
r AS (SELECT base.*, epochs, rest, sha256('{mix.seed}:' || epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '{NONE}'))
        AS k FROM base JOIN plan USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r)
SELECT doc_id, domain, lang, source, n_tokens, (epochs + (run <= rest)::BIGINT)::BIGINT AS copies
FROM c WHERE epochs + (run <= rest)::BIGINT > 0
"""
