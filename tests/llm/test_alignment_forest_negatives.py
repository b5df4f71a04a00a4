"""Operators 11 to 13 against brute force, and their edge cases."""

import functools
import hashlib
import math
import os
import random
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from cohortlens.llm import hard_negatives as hn  # noqa: E402
from cohortlens.llm import lsh_forest as lf  # noqa: E402
from cohortlens.llm import queries  # noqa: E402
from cohortlens.llm import token_alignment as ta  # noqa: E402

SF = "/root/testdata/sf0.001"
CLASHING = ("key", "sig", "comp", "rid", "codes", "n", "cell", "order", "root", "shingles", "label_", "slot", "score", "r", "c")


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark):
    from cohortlens.session import checkpoint_dir
    checkpoint_dir(spark)


def documents(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({name: F.lit("x") for name in CLASHING})


# ---------------------------------------------------------------- op11


@functools.cache
def vocabularies():
    return ta.Words(f"{ta.VOCABULARIES}/byte_bpe_50k.json", f"{ta.VOCABULARIES}/piece_bpe_32k.model")


def plain_groups(text):
    """Token groups from the encodings of the whole text; None if it has no tokens."""
    w, y = vocabularies(), (" " + (text or "")).encode()
    a, b = w.side_a.encode(y.decode(), add_special_tokens=False).ids, w.side_b.encode(text or "")
    x, z = [w.bytes_a[i] for i in a], [w.bytes_b[i] for i in b]
    if not text or b"".join(x) != y or b"".join(z) != y:
        return None
    ends = [list(np.cumsum([len(t) for t in side])) for side in (x, z)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        one = ([], [])
        while i < len(a) and ends[0][i] <= end:
            one[0].append(a[i])
            i += 1
        while j < len(b) and ends[1][j] <= end:
            one[1].append(b[j])
            j += 1
        groups.append(one)
    return groups


def spelled(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def plain_alignment(rows):
    per = [(d, plain_groups(t)) for d, t in rows]
    links = [[(x, z) for a, b in g for x in a for z in b] if g else [] for _, g in per]
    count, best = Counter(), defaultdict(int)
    for doc in links:
        count.update(set(doc))
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (d, g), doc in zip(per, links):
        if not g:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(doc),
                    sum(count[p] == best[p[0]] for p in doc), sum(count[p] for p in doc),
                    hashlib.sha256(spelled(g).encode()).hexdigest()))
    return out


BITS = ["hello", "world", "Größe", "日本語テキスト", "don't", "<|endoftext|>", "<s>", "1234567", "  ", "\n", "\t", " ", "\xa0", "　",
        "émigré", "é́", "🙂👍🏽", "x" * 50, "antidisestablishmentarianism", "'s", "...", "\x00", "\x1c", "\r\n", "<0x0A>", "ﬁ", "​",
        "а б", "ÿþ"]


def odd_text(rng, n):
    return "".join(rng.choice(BITS) + rng.choice([" ", " ", " ", "", "  ", "\n"]) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    rows = [(i, odd_text(rng, rng.choice([0, 1, 3, 30, 200])) + ("▁" if i % 9 == 0 else "")) for i in range(70)]
    return rows + [(1000, None), (1001, ""), (None, "a null id"), (None, "a null id"), (5, rows[5][1]), (1002, "nospace" * 400),
                   (1003, "日本" * 700), (1004, " " * 900), (1005, "word " * 600), (1006, "ab▁ " * 300), (1007, "▁")]


@pytest.mark.parametrize("chunk, fan, most", [(1 << 15, 8, 4_000_000), (37, 2, 60), (200, 3, 1000)])
def test_alignment_equals_whole_encodings(spark, chunk, fan, most):
    rows = odd_rows()
    got = ta.digest(documents(spark, rows), chunk=chunk, fan=fan, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_alignment(rows), key=str)


def test_groups_of_whole_texts_are_given(spark):
    rows = [(1, "An émigré's 日本語"), (2, None)]
    got = {r.doc_id: r for r in ta.aligned(documents(spark, rows)).collect()}
    assert got[1].groups == spelled(plain_groups(rows[0][1])) and got[2].groups == "" and got[2].n_groups == 0


def test_alignment_of_an_empty_table_and_registered_query(spark):
    assert ta.digest(documents(spark, [])).count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op11_token_alignment"](spark, SF).collect()), key=str)
    assert got == sorted(plain_alignment(rows), key=str)


def _fragments(words, text, chunk):
    y = b" " + text.encode()
    return [ta.range_fragment(words, y[start:end], lo - start, hi - start)
            for start, end, lo, hi in ta.byte_ranges(text.encode(), chunk)]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(20, 120))
def test_fragments_compose_in_any_tree(seed, chunk):
    words, rng = vocabularies(), random.Random(seed + 1)
    text = odd_text(random.Random(seed), 40)
    parts = _fragments(words, text, chunk)
    assert sum(hi - lo for _, _, lo, hi in ta.byte_ranges(text.encode(), chunk)) == len(text.encode()) + 1
    while len(parts) > 1:  # any two neighbours
        k = rng.randrange(len(parts) - 1)
        if rng.random() < 0.2:
            parts.insert(k, ta.Fragment())  # the identity
        parts[k:k + 2] = [ta.compose(parts[k], parts[k + 1], words.size_b)]
    whole = ta.closed(parts[0], words.size_b)
    want = plain_groups(text)
    assert parts[0].ok and whole.n_groups == len(want) and ";".join(whole.groups) == spelled(want)
    links = Counter((x * words.size_b + z) for a, b in want for x in a for z in b)
    assert Counter(np.concatenate(whole.codes).tolist()) == links


def test_a_run_without_spaces_is_not_read_again_for_every_range():
    text = ("ab " * 40 + "x" * 5000 + " cd" * 40).encode()
    found = ta.byte_ranges(text, 100)
    assert sum(end - start for start, end, _, _ in found) < 2 * len(text)
    assert all(a[3] == b[2] for a, b in zip(found, found[1:])) and found[0][2] == 0 and found[-1][3] == len(text) + 1


def test_words_are_forgotten_beyond_those_kept():
    w = ta.Words(f"{ta.VOCABULARIES}/byte_bpe_50k.json", f"{ta.VOCABULARIES}/piece_bpe_32k.model", keep=3)
    w.add(["one", "two", " x", "three", "four", "b▁d"])
    before = {k: w.body([k])[1].groups for k in ("one", "two", "four")}
    assert not w.body(["b▁d"])[0]
    w.forget()
    assert len(w.at) == len(w.groups) == len(w.totals) == 3 and len(w.first) == 4 and len(w.pool) == w.first[-1]
    w.add(["four", "one"])
    assert w.body(["one"])[1].groups == before["one"] and w.body(["four"])[1].groups == before["four"]


# ---------------------------------------------------------------- op12


def plain_sets(rows):
    out = []
    for _, t in rows:
        w = [x for x in (t or "").encode().lower().split()]
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_components(rows, percent=85):
    sets, parent = plain_sets(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in held[x])
        for x in s:
            held[x].append(i)
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in members]
    return sorted(out, key=str)


def families(seed, n, sizes=(3, 5, 20, 80, 400), copies=(1, 1, 2, 5, 30), edits=0.04):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(300)]
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        for _ in range(rng.choice(copies)):
            x = list(base)
            for _ in range(rng.randrange(0, max(1, int(len(x) * edits)) + 1)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                x += [rng.choice(vocabulary) for _ in range(len(x) // 10)]
            text = " ".join(x)
            rows.append((len(rows), text if rng.random() < 0.7 else text.upper()))
    return rows


@pytest.mark.parametrize("region, weight", [(1024, 4_000_000), (8, 4_000_000), (1024, 3000)])
def test_forest_equals_all_pairs(spark, region, weight):
    rows = families(3, 45)
    rows += [(9000, None), (9001, ""), (9002, "  \n"), (None, rows[5][1]), (None, "alone and without any id at all"),
             (None, "alone and without any id at all"), (3, rows[3][1]), (9003, "one"), (9004, "ONE"), (9005, "é ñ"),
             (9006, " ".join(f"u{i}" for i in range(40_000))), (9007, " ".join(f"u{i}" for i in range(39_900)))]
    random.Random(1).shuffle(rows)
    got = lf.near_duplicates(documents(spark, rows).repartition(3), region=region, weight=weight)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = plain_components(rows)
    # nulls: kept says that nothing else names the row
    want = sorted(((a, b, c, True if a is None and c is None else d) for a, b, c, d in want), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_forest_of_one_large_loose_family(spark):
    """Copies of one text at similarities around the limit: many pairs are no links, none may be lost."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for k in range(260):
        x = list(base)
        for _ in range(rng.randrange(0, 6)):
            x[rng.randrange(len(x))] = f"e{rng.randrange(10 ** 6)}"
        rows.append((k, " ".join(x)))
    got = lf.near_duplicates(documents(spark, rows), region=64)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows)


def test_forest_empty_tables_and_registered_query(spark):
    assert lf.near_duplicates(documents(spark, [])).count() == 0
    assert sorted(map(tuple, lf.near_duplicates(documents(spark, [(1, None), (2, " ")])).collect())) == [
        (1, 0, 1, True), (2, 0, 2, True)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op12_lsh_forest"](spark, SF).collect()), key=str)
    assert got == plain_components(rows)
    with pytest.raises(ValueError, match="85 percent"):
        lf.near_duplicates(documents(spark, []), percent=50)


def loose(rng, name, n):
    """Texts of one family at a similarity of some 0.76: candidates, no links."""
    out = []
    for k in range(n):
        x = [f"{name}{i}" for i in range(150)]
        for at in rng.sample(range(5, 145), 2):
            x[at] = f"e{name}{k}at{at}"
        out.append(" ".join(x))
    return out


def test_forest_moves_sets_and_rows_once(spark, monkeypatch):
    """A refused pair's sets don't go to every cell where it meets, and crowded regions don't deal all rows again."""
    rng, moved, plans = random.Random(4), [], []
    sets_of, likely_rows = lf.sets_of, lf.likely_rows

    def counted(docs, classes, rows, *rest):
        moved.append(rows.count())
        return sets_of(docs, classes, rows, *rest)

    def planned(cells, classes):
        plans.append(cells._jdf.queryExecution().optimizedPlan().toString())
        return likely_rows(cells, classes)

    monkeypatch.setattr(lf, "sets_of", counted)
    monkeypatch.setattr(lf, "likely_rows", planned)
    rows = list(enumerate(t for f in range(40) for t in loose(rng, f"f{f}w", 2)))
    assert sorted(map(tuple, lf.near_duplicates(documents(spark, rows)).collect()), key=str) == plain_components(rows)
    assert sum(moved) < 3 * len(rows)
    plans.clear()
    rows = list(enumerate(loose(rng, "g", 20)))
    assert sorted(map(tuple, lf.near_duplicates(documents(spark, rows), region=8).collect()), key=str) == plain_components(rows)
    assert any("explode" in p for p in plans) and not any("MapInArrow" in p for p in plans)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 30), min_size=1, max_size=14), st.integers(0, 3), st.integers(0, 1)), min_size=2,
                max_size=14), st.booleans())
def test_links_of_a_cell_join_what_all_pairs_join(rows, across):
    sets = [np.array(sorted(s), np.uint64) for s, _, _ in rows]
    comp, own = np.array([c for _, c, _ in rows], np.int64), np.array([o for _, _, o in rows])
    links = lf.link_sets(sets, comp, own if across else None, 60)

    def classes(pairs):
        label = [f"c{c}" for c in comp]
        for i, j in pairs:
            label = [label[i] if x == label[j] else x for x in label]
        return sorted(tuple(i for i, x in enumerate(label) if x == y) for y in set(label))

    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (not across or own[i] != own[j])
             and 100 * len(rows[i][0] & rows[j][0]) >= 60 * len(rows[i][0] | rows[j][0])]
    assert classes(links) == classes(pairs) and len(links) <= len(set(comp.tolist())) - 1


def test_agreeing_minima_follow_the_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.85, 0.95):
        agree = []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = int(round(len(both) * 2 * share / (1 + share)))
            other = np.concatenate((both[:n], rng.integers(0, 1 << 63, 400 - n, dtype=np.uint64)))
            agree.append((lf.signature(both) == lf.signature(other)).mean())
        assert np.mean(agree) == pytest.approx(share, abs=0.03)


# ---------------------------------------------------------------- op13


def embeddings(spark, rows, kind="array<float>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int")
    return df.withColumns({name: F.lit("x") for name in CLASHING})


def plain_negatives(rows, every=100, k=5, n=10):
    live = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last = 2 ** 63
    held = lambda s: min(max(s, -last), last - 1)
    out, seen = [], set()
    for i, v, label in live:
        if i is None or i % every or (i, tuple(v), label) in seen:
            continue
        seen.add((i, tuple(v), label))
        order = lambda r: (-r[0], r[1] is None, r[1] or 0)
        scored = [(held(sum(a * b for a, b in zip(v, w))), j, m) for j, w, m in live if j != i and len(w) == len(v)]
        pos = sorted((r for r in scored if r[2] == label), key=order)[:k]
        neg = sorted((r for r in scored if r[2] != label), key=order)
        for s, p, _ in pos:
            took = [r for r in neg if 30 * s <= 100 * r[0] <= 90 * s][:n]
            out += [(i, p, rank + 1, j, s, t) for rank, (t, j, _) in enumerate(took)]
    return sorted(out, key=str)


def vectors(seed, n, width=6, labels=3, spread=4):
    """Few distinct values: many equal scores."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-spread, spread + 1) / 8 for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.fixture()
def small_cells(monkeypatch):
    def cut(rows, anchors):
        monkeypatch.setattr(hn, "ROWS", rows)
        monkeypatch.setattr(hn, "LEAST_ROWS", min(rows, hn.LEAST_ROWS))
        monkeypatch.setattr(hn, "ANCHORS", anchors)
        monkeypatch.setattr(hn, "BLOCK", 3)
    return cut


@pytest.mark.parametrize("rows, anchors", [(1 << 15, 1 << 14), (40, 3)])
def test_negatives_equal_brute_force(spark, small_cells, rows, anchors):
    small_cells(rows, anchors)
    table = vectors(1, 700)
    nan, inf = float("nan"), float("inf")
    table += [(701, None, 1), (702, [0.1] * 6, None), (800, [nan] + [0.1] * 5, 1), (900, [inf] + [0.1] * 5, 1), (901, [None] + [0.1] * 5, 1),
              (None, [0.5] * 6, 1), (None, [0.5] * 6, 0), (1000, [0.5] * 4, 1), (1001, [0.4] * 4, 1), (1002, [0.2] * 4, 2), (1100, [], 1),
              (1101, [], 1), (1102, [], 2), table[0], table[300], table[300], (table[1][0], [0.25] * 6, 2), (-100, [0.5] * 6, -3),
              (1200, [-0.5] * 6, 2), (2 ** 40, [0.125] * 6, 1)]
    got = hn.mine(embeddings(spark, table))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(table)
    assert want and sorted(map(tuple, got.collect()), key=str) == want


def test_scores_are_exact_and_held_at_the_ends_of_a_long(spark):
    big = [3e7, 2e6, 1e12, 3e38]
    table = [(0, [x, 1.5], 1) for x in big[:1]] + [(100 * (k + 1), [x, -2.25], 1) for k, x in enumerate(big)]
    table += [(1 + k, [x * f, 0.5], label) for k, (x, f, label) in enumerate(
        (x, f, label) for x in big for f in (0.4, 0.8, 1.0, -1.0) for label in (1, 2))]
    got = hn.mine(embeddings(spark, table, "array<double>"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_negatives(table)


def test_few_rows_and_empty_tables(spark):
    assert hn.mine(embeddings(spark, [])).count() == 0
    assert hn.mine(embeddings(spark, [(100, [1.0], 1)])).count() == 0
    assert hn.mine(embeddings(spark, [(100, [1.0], 1), (101, [1.0], 1), (102, [0.5], 2)])).collect()[0].negative_id == 102


def test_other_limits_and_counts(spark):
    table = vectors(4, 300, labels=2)
    got = hn.mine(embeddings(spark, table), every=50, n_positives=3, n_negatives=2, low=0, high=100, relabel_every=10 ** 9)
    plain = [(i, v, m) for i, v, m in table]
    live = [(i, [math.floor(256 * x) for x in v], m if i else (m + 1) % 10) for i, v, m in plain]
    rows = 0
    for i, v, m in live:
        if i % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, k) for j, w, k in live if j != i))
            for s, _, _ in [r for r in scored if r[2] == m][:3]:
                rows += min(2, sum(1 for r in scored if r[2] != m and 0 <= -r[0] <= -s))
    assert got.count() == rows


def test_first_rows_keep_ties_in_order():
    score = np.array([5, 7, 7, 5, 9, 7, 5])
    assert hn.first(score, np.arange(7), 3).tolist() == [4, 1, 2]
    assert hn.first(score, np.array([0, 3, 6]), 2).tolist() == [0, 3] and hn.first(score, np.array([], int), 2).tolist() == []


def test_registered_negatives_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = queries.QUERIES["op13_hard_negatives"](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL["op13_hard_negatives"])
    assert [d[0] for d in cursor.description] == got.columns
    assert sorted(cursor.fetchall()) == sorted(map(tuple, got.collect()))
