"""Chat formatting by quotation linking (operator 5, DataFrame functions only).

A line that starts with one or more ``>`` (white space between them allowed)
is quoted; the number of ``>`` is its level. A line that ends in ``wrote:`` or
``writes:`` directly before a quoted line introduces the quote and belongs to it.

Lines are normalised (markers off, lower case, white space runs one space,
trimmed) and hashed; so are passages, consecutive non-blank lines of one level
joined by a space, so that a passage that was wrapped anew is still found. A
quoted passage links to the latest earlier message of its conversation that
says it; when no message says the whole passage, each of its lines links to the
latest earlier message that says the line. The look-up needs one row per
(conversation, hash, turn) and spreads a frequent line over many tasks; no join
multiplies rows. A message replies to the message that its level-1 lines link
to (most quoted characters; ties: the latest), or, when none links, to its
deepest linked quote; ``quoted_turns`` lists all linked messages.

Threads follow from the reply links by pointer doubling. In the result
messages of a conversation are ordered by (thread root, turn): a reply comes
after its message, and threads are not torn apart. ``reply_order`` is the rank
in that order, from a range-partitioned sort, so a conversation that holds a
large part of all rows is still spread over many tasks.

``body`` is the message without quoted lines and their introductions, blank
lines trimmed at both ends; quoted lines that link nowhere are kept, in order,
in ``unlinked_quotes``.

Edge cases: null text is null in ``body``, links to nothing and has no lines.
Rows with equal conv_id, turn, role and text are one message with ``copies`` of
it; several messages of one turn stay apart, a link leads to their turn. A null
conv_id is a conversation of its own; a null turn comes first and neither gives
nor gets links. Blank quoted lines link to nothing. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

QUOTED = r"^\s*>"
MARKERS = r"^(\s*>)+"
INTRODUCES = r"(?i)\b(wrote|writes)\s*:\s*$"


def normalise(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKERS, ""), r"\s+", " ")))


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKERS, 0), r"\s", ""))


def messages(conversations: DataFrame) -> DataFrame:
    """Distinct messages with their lines; ``_own`` marks the lines that are neither quoted nor introduce a quote."""
    base = (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
            .groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")))
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    with_lines = base.select("*", F.xxhash64("conv_id", "turn", "role", "text").alias("_m"), lines.alias("_lines"))
    following = lambda i: F.coalesce(F.get("_lines", i + 1), F.lit(""))
    own = F.transform("_lines", lambda x, i: ~x.rlike(QUOTED) & ~(x.rlike(INTRODUCES) & following(i).rlike(QUOTED)))
    return with_lines.withColumn("_own", own)


def passages(found: DataFrame) -> DataFrame:
    """(conv_id, turn, _m, first, level, parts, _p): runs of non-blank lines of one level (0: said by the message itself)
    with their normalised lines and the hash of the whole."""
    lines = found.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND _lines IS NOT NULL").select(
        "conv_id", "turn", "_m", F.transform("_lines", lambda x, i: F.struct(
            F.when(F.get("_own", i), 0).when(x.rlike(QUOTED), level(x)).otherwise(-1).alias("level"),
            normalise(x).alias("n"))).alias("_u"))
    at = lambda i: F.get("_u", i)
    apart = lambda i, j: (j < 0) | (j >= F.size("_u")) | (at(j)["n"] == "") | (at(i)["level"] != at(j)["level"])
    real = lambda i: (at(i)["n"] != "") & (at(i)["level"] >= 0)
    places = F.sequence(F.lit(0), F.size("_u") - 1)
    runs = F.arrays_zip(F.filter(places, lambda i: real(i) & apart(i, i - 1)).alias("a"),
                        F.filter(places, lambda i: real(i) & apart(i, i + 1)).alias("z"))
    each = lines.select("conv_id", "turn", "_m", "_u", F.explode(runs).alias("_r")).select(
        "conv_id", "turn", "_m", F.col("_r.a").alias("first"), at(F.col("_r.a"))["level"].alias("level"),
        F.transform(F.slice("_u", F.col("_r.a") + 1, F.col("_r.z") - F.col("_r.a") + 1), lambda x: x["n"]).alias("parts"))
    return each.withColumn("_p", F.xxhash64(F.array_join("parts", " ")))


def latest_sayers(asked: DataFrame, said: DataFrame) -> DataFrame:
    """(conv_id, turn, _h, said_turn): the latest turn before ``turn`` that says the hash, for distinct rows asked.

    Rows are range-partitioned on (conv_id, _h, turn) and written; a key that goes over a partition's edge is continued
    from the latest sayer before, one row per partition and key that starts it.
    """
    key = ["conv_id", "_h"]
    needed = said.join(asked.select(*key).distinct(), key, "left_semi")
    rows = (asked.withColumn("_said", F.lit(None).cast("long")).unionByName(needed.withColumn("_said", F.col("turn")))
            .groupBy(*key, "turn").agg(F.max("_said").alias("_said"), F.max(F.col("_said").isNull()).alias("_asked")))
    placed = stored(rows.repartitionByRange(*key, "turn").withColumn("_part", F.spark_partition_id()), "quote-sayers")
    inside = F.max("_said").over(Window.partitionBy("_part", *key).orderBy("turn")
                                 .rangeBetween(Window.unboundedPreceding, -1))
    ends = placed.groupBy("_part", *key).agg(F.max("_said").alias("_said"))
    before = F.max("_said").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # Only keys that go on from an earlier partition: at most one a partition.
    carried = (ends.withColumn("_before", before).filter("_before IS NOT NULL")
               .select(F.col("_part").alias("_q"), F.col("conv_id").alias("_c"), F.col("_h").alias("_k"), "_before"))
    return (placed.withColumn("_inside", inside)
            .join(F.broadcast(carried), (F.col("_part") == F.col("_q")) & (F.col("conv_id") == F.col("_c"))
                  & (F.col("_h") == F.col("_k")), "left")
            .filter("_asked").select("conv_id", "turn", "_h", F.coalesce("_inside", "_before").alias("said_turn"))
            .filter("said_turn IS NOT NULL"))


def links(found: DataFrame) -> DataFrame:
    """(_m, i, level, chars, said_turn): every non-blank quoted line, with the turn it quotes, if any."""
    each = passages(found)
    quoted = (each.filter("level > 0").select("conv_id", "turn", "_m", "level", "_p", "first", F.posexplode("parts").alias("_k", "_n"))
              .select("conv_id", "turn", "_m", (F.col("first") + F.col("_k")).alias("i"), "level",
                      F.length("_n").alias("chars"), F.xxhash64("_n").alias("_l"), "_p"))
    quoted = stored(quoted, "quote-quoted")
    hashes = F.explode(F.array_distinct(F.concat(F.array("_p"), F.transform("parts", lambda x: F.xxhash64(x))))).alias("_h")
    said = each.filter("level = 0").select("conv_id", "turn", hashes).distinct()
    asked = quoted.select("conv_id", "turn", F.explode(F.array("_l", "_p")).alias("_h")).distinct()
    sayers = stored(latest_sayers(asked, said), "quote-found")
    for name, by in (("_line_turn", "_l"), ("_passage_turn", "_p")):
        quoted = quoted.join(sayers.select("conv_id", "turn", F.col("_h").alias(by), F.col("said_turn").alias(name)),
                             ["conv_id", "turn", by], "left")
    return quoted.select("conv_id", "turn", "_m", "i", "level", "chars",
                         F.coalesce("_passage_turn", "_line_turn").alias("said_turn"))


def parents(linked: DataFrame) -> DataFrame:
    """(_m, parent_turn, quoted_turns, linked lines) of messages with a linked quote."""
    votes = (linked.filter("said_turn IS NOT NULL").groupBy("_m", "level", "said_turn")
             .agg(F.sum("chars").alias("chars"), F.collect_set("i").alias("lines")))
    best = F.max(F.struct((F.col("level") == 1).alias("direct"),
                          F.when(F.col("level") == 1, 0).otherwise(F.col("level")).alias("deep"), "chars", "said_turn"))
    return (votes.groupBy("_m")
            .agg(best["said_turn"].alias("parent_turn"), F.array_sort(F.collect_set("said_turn")).alias("quoted_turns"),
                 F.flatten(F.collect_list("lines")).alias("_linked")))


def thread_roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn) from (conv_id, turn, parent_turn) by pointer doubling.

    A parent's turn is smaller, so links never form a cycle and the number of
    rounds is the logarithm of the longest chain.
    """
    step = stored(replies.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up")), "quote-roots")
    while True:
        over = step.select(F.col("conv_id"), F.col("turn").alias("up"), F.col("up").alias("_next"))
        nxt = stored(step.join(over, ["conv_id", "up"], "left")
                     .select("conv_id", "turn", F.coalesce("_next", "up").alias("up"),
                             F.col("_next").isNotNull().alias("_moved")), "quote-roots")
        moved = nxt.filter("_moved").limit(1).count()
        step = nxt.drop("_moved")
        if not moved:
            return step.select("conv_id", "turn", F.col("up").alias("root_turn"))


def _ranked(rows: DataFrame) -> DataFrame:
    """``reply_order``: rank inside the conversation by (root_turn, turn, role, _m).

    Rows are range-partitioned on that order and written; a conversation that
    goes over a partition's edge is continued from the rows counted before, one
    offset per partition and conversation that starts it.
    """
    order = ["conv_id", "root_turn", "turn", "role", "_m"]
    placed = stored(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "quote-order")
    inside = F.row_number().over(Window.partitionBy("_p", "conv_id").orderBy(*order[1:]))
    sizes = placed.groupBy("_p", "conv_id").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_p")
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Only conversations that go on from an earlier partition: at most one a partition.
    offsets = (sizes.withColumn("_before", before).filter("_before > 0")
               .select(F.col("_p").alias("_q"), F.col("conv_id").alias("_c"), "_before"))
    ranked = placed.withColumn("_i", inside).join(
        F.broadcast(offsets), (F.col("_p") == F.col("_q")) & F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return ranked.withColumn("reply_order", (F.col("_i") + F.coalesce("_before", F.lit(0))).cast("long"))


def threads(conversations: DataFrame) -> DataFrame:
    """One row per message: (conv_id, turn, role, body, parent_turn, root_turn, quoted_turns, n_quoted_lines,
    unlinked_quotes, copies, reply_order)."""
    found = stored(messages(conversations), "quote-messages")
    linked = stored(links(found), "quote-links")
    up = parents(linked)
    counts = linked.groupBy("_m").agg(F.count(F.lit(1)).alias("n_quoted_lines"))
    joined = found.join(up, "_m", "left").join(counts, "_m", "left")
    # Only messages in a reply chain take part in the doubling.
    replies = joined.filter("parent_turn IS NOT NULL").select("conv_id", "turn", "parent_turn")
    roots = thread_roots(replies).withColumnRenamed("conv_id", "_c").withColumnRenamed("turn", "_t")
    rooted = joined.join(roots, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    own = F.filter(F.transform("_lines", lambda x, i: F.when(F.get("_own", i), x)), lambda x: x.isNotNull())
    lost = F.filter(
        F.transform("_lines", lambda x, i: F.when(x.rlike(QUOTED) & (normalise(x) != "") & ~F.coalesce(
            F.array_contains("_linked", i), F.lit(False)), x)), lambda x: x.isNotNull())
    body = F.regexp_replace(F.array_join(own, "\n"), r"^(\s*\n)+|(\n\s*)+$", "")
    rows = rooted.select("conv_id", "turn", "role", body.alias("body"), "parent_turn",
                         F.coalesce("root_turn", "turn").alias("root_turn"),
                         F.coalesce("quoted_turns", F.array().cast("array<long>")).alias("quoted_turns"),
                         F.coalesce("n_quoted_lines", F.lit(0)).cast("long").alias("n_quoted_lines"),
                         F.coalesce(lost, F.array().cast("array<string>")).alias("unlinked_quotes"), "copies", "_m")
    return _ranked(rows).select("conv_id", "turn", "role", "body", "parent_turn", "root_turn", "quoted_turns",
                                "n_quoted_lines", "unlinked_quotes", "copies", "reply_order")
