"""Small cases and brute-force twins of the training-data operators."""

import hashlib
import itertools
import os
import random
import sys
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from cohortlens.llm import (components, cotraining, cross_entropy, html_blocks, language_codes, mixing,  # noqa: E402
                            quality_ledger, queries, quote_links, simhash, spaced_seeds, suffix_index)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark):
    from cohortlens.session import checkpoint_dir
    checkpoint_dir(spark)


def frame(spark, texts, ids=None):
    """Documents, with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "d", "tag", "key", "n_words", "component_id", "spans", "target", "copies", "_key"):
        df = df.withColumn(name, F.lit("x"))
    return df


def words(n, seed=0, vocab=4000):
    rng = random.Random(seed)
    return " ".join("w" + "".join(chr(97 + int(c)) for c in str(rng.randrange(vocab))) for _ in range(n))


AWKWARD = [None, "", " \n\t ", "one", "a b", "é ñ 漢字", "x" * 20_000, words(6000, 5), words(40, 1), words(40, 1)]


# --- op2 ---------------------------------------------------------------------------------------

def test_quality_counts(spark):
    text = "a b c a b c\nline # two\nline # two\n\n  \nA!"
    got = quality_ledger.verdicts(frame(spark, [text])).first()
    assert (got.n_words, got.n_symbols, got.n_dup_lines) == (13, 2, 1)
    assert got.word_chars == sum(len(w) for w in text.split())
    # "a b c" twice: 6 words; "line # two" twice: 6 words, with no window shared beyond.
    assert got.n_repeat_words == 12
    assert got.base_failed and not got.kept


def test_quality_awkward_and_empty(spark):
    docs = frame(spark, AWKWARD, [None, 1, 2, 3, 3, 5, 6, 7, 8, 9])
    got = quality_ledger.verdicts(docs).collect()
    assert len(got) == len(AWKWARD)
    assert sorted(r.n_words for r in got) == sorted(len((t or "").split()) for t in AWKWARD)
    assert quality_ledger.verdicts(docs.limit(0)).count() == 0
    kept = quality_ledger.keep_passing(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [7]


def test_quality_ablations(spark):
    led = quality_ledger.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    rows = led.select("fail_bits").toPandas().fail_bits.to_numpy()
    bits = quality_ledger.rule_bits()
    for r in quality_ledger.ablations(led).collect():
        mask = quality_ledger.POLICIES[r.version].mask
        assert r.rejected_by_policy == ((rows & mask) != 0).sum()
        assert r.rejected_only_by_rule == ((rows & mask) == bits[r.rule]).sum()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(str(tuple(r)) for r in df.select(cols).collect()) == want


# --- op8 ---------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, k=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= k:
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(groups[find(i)]) for i in range(len(fps))}


def test_simhash_matches_brute_force(spark):
    base = words(300, 9)
    near = [" ".join(w if random.Random(s).random() > 0.01 or i else "Q" for i, w in enumerate(base.split()))
            for s in range(12)]
    texts = [t or "" for t in AWKWARD] + [base, base.upper(), base + " end"] + near
    texts += [base.replace(w, "zz", 1) for w in base.split()[:60]]
    got = {r.doc_id: r for r in simhash.digest(frame(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps, list(range(len(texts))))


@pytest.mark.parametrize("plan", [
    [simhash.Partition((u,), 0) for u in range(4)],
    [simhash.Partition((0, 1), 1), simhash.Partition((2, 3), 1)],
    [simhash.Partition((0,), 1), simhash.Partition((1,), 1)],
    [simhash.Partition((0, 1, 2), 2), simhash.Partition((3,), 0)],
])
def test_every_allotment_finds_all_links(spark, plan):
    rng = np.random.default_rng(3)
    core = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    fps = {int(c) for c in core}
    for c in core:
        for k in (1, 2, 3, 4):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    units = [list(range(i, i + 16)) for i in range(0, 64, 16)]
    hist = simhash.histograms(df, units)
    # block = 2 forces frequent values to be dealt over cells
    edges = simhash.links(simhash.probe(df, units, hist, plan, block=2), 3)
    root = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components.components(edges).collect()}
    want = brute_components(fps, fps)
    by_want, by_got = {}, {}
    for f in fps:
        by_want.setdefault(want[f], set()).add(f)
        by_got.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_thresholds_spend_all_errors():
    hist = np.ones((4, 1 << 16), np.int64)
    for k in (1, 3, 5):
        assert sum(p.threshold + 1 for p in simhash.plan_partitions(hist, k)) == k + 1
    hist[0, 0] = 10_000_000  # a useless unit is not asked for equality alone
    assert all(p.units != (0,) for p in simhash.plan_partitions(hist, 3))


def test_simhash_nulls_repeats_and_empty(spark):
    docs = frame(spark, [None, "", "a b c d", "a b c d", "a b c d"], [None, 4, 9, 9, None])
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.digest(docs).collect())
    assert got == [("4", 4), ("9", 9), ("9", 9), ("None", 4), ("None", 9)]
    assert simhash.digest(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "9", "None", "None"]


def test_components_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(1000, 1001), (5, 5), (None, 3)],
                                  "x long, y long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_keep_one_by_id_and_text(spark):
    a, b = words(200, 31), words(200, 32)
    near = a + " "  # the same shingles in another text
    # A kept id keeps neither its other text, which belongs to the group of id 0, nor a second text of its own group.
    docs = frame(spark, [b, a, b, near], [0, 1, 1, 1])
    got = [(r.doc_id, r.text.strip()) for r in simhash.keep_one(docs).collect()]
    assert sorted(got) == sorted([(0, b), (1, a)])


# --- op4 ---------------------------------------------------------------------------------------

def brute_dedup(rows, length=100):
    seen, out = {}, []
    for d, raw in sorted(rows):
        covered = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen.setdefault(raw[i:i + length], (d, i)) < (d, i):
                covered[i:i + length] = True
        runs = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
        out.append((d, len(raw), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def hard_texts():
    p = words(60, 11)
    edits = [p[:k] + "Z" + p[k + 1:] for k in (100, 130, 131, 200, 350)]
    return ([None, "", "short", p, p, "é" * 70 + p[30:160], p[50:149], p[50:150], p[50:151], "A" * 500, "AB" * 300,
             words(30, 2) + p[20:180] + words(30, 3), p + p, p[:99] + "!" + p[:100]] + edits
            + [words(20, s) + " " + p[:140] + " " + words(5, s) for s in range(20, 32)])


@pytest.mark.parametrize("batches,cell", [(1, 1 << 14), (5, 1 << 14), (4, 3)])
def test_suffix_dedup_matches_brute_force(spark, batches, cell):
    texts = hard_texts()
    raw = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    got = suffix_index.deduplicate(frame(spark, texts), batches=batches, cell=cell).collect()
    mine = sorted((r.doc_id, r.n_bytes, sum(b - a for a, b in r.runs), len(r.runs),
                   hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert mine == brute_dedup(raw)


def test_suffix_dedup_long_text_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_index, "PIECE", 4096)
    hasher = suffix_index._Hasher(4096)
    raw = (words(4000, 8) + words(500, 9)).encode()
    whole = suffix_index._Hasher(len(raw))
    h = whole.grams(np.frombuffer(raw, np.uint8), 32)
    want = set(suffix_index.anchor_positions(h, 69).tolist())
    got = set()
    for _, pos, key in suffix_index._anchors([raw], hasher, 100, 32):
        assert (h[pos] == key).all()
        got |= set(pos.tolist())
    assert got >= want


def test_suffix_dedup_ids(spark):
    p = words(40, 4)
    docs = frame(spark, [p, p, p, "x" + p], [None, 7, 7, 3])
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_index.digest(docs).collect())
    n = len(p)
    assert got == [("3", 0), ("7", n), ("7", n), ("None", n)]
    assert suffix_index.digest(docs.limit(0)).count() == 0
    clean = suffix_index.remove_repeats(docs)
    assert clean.columns == docs.columns
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in clean.collect()) == [
        ("3", "x" + p, n + 1), ("7", "", 0), ("7", "", 0), ("None", "", 0)]


@pytest.mark.parametrize("nulls", [2, 3])
def test_suffix_dedup_many_rows_without_id(spark, nulls):
    p = words(40, 4)
    docs = frame(spark, [p + x for x in "abcd"], [*([None] * nulls), *range(7, 11 - nulls)])
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_index.digest(docs).collect())
    assert [d for d, _ in got] == [*map(str, range(7, 11 - nulls)), *["None"] * nulls]
    assert sorted(n for _, n in got) == [0, len(p), len(p), len(p)]


@pytest.mark.parametrize("top", [(1 << 63) - 1, (1 << 63) - 2])
def test_suffix_dedup_largest_ids(spark, top):
    p = words(40, 4)
    got = suffix_index.digest(frame(spark, [p, p], [top - 1, top - 2])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(top - 2, 0), (top - 1, len(p))]


# --- op9 ---------------------------------------------------------------------------------------

def test_masks_are_lossless():
    placed = [{s + i for i, b in enumerate(m) if b == "1"} for m in spaced_seeds.MASKS
              for s in range(spaced_seeds.WINDOW - len(m) + 1)]
    for bad in itertools.combinations(range(spaced_seeds.WINDOW), spaced_seeds.WINDOW - spaced_seeds.MATCHES):
        assert any(not p & set(bad) for p in placed)


def brute_overlaps(docs, items):
    out = set()
    tok = lambda t: __import__("regex").findall(r"[\p{L}\p{N}]+", (t or "").lower())
    for d, t in docs:
        a = tok(t)
        for k, u in items:
            b = tok(u)
            hits = [(i, sum(x == y for x, y in zip(a[i:i + 13], b[j:j + 13])))
                    for i in range(len(a) - 12) for j in range(len(b) - 12)]
            good = [(i, n) for i, n in hits if n >= 11]
            if good:
                out.add((d, k, max(n for _, n in good), min(i for i, _ in good), max(i for i, _ in good) + 13))
    return out


@pytest.mark.parametrize("bound", [10**6, 0])
def test_spaced_seeds_match_brute_force(spark, bound):
    items = [(1, words(20, 1, 50)), (2, words(14, 2, 50)), (3, "too short"), (None, words(15, 3, 50)), (4, None)]
    base = items[0][1].split()
    texts = [None, "", "a b", words(400, 7, 50), words(30, 8) + " " + items[0][1].upper() + " " + words(9, 9)]
    for gone in ([3, 9], [0, 19], [3, 4, 5], [6, 12, 18]):
        texts.append("x, " + " ".join("SUB" if i in gone else w for i, w in enumerate(base)) + " y.")
    texts += [items[1][1], " ".join(items[1][1].split()[:12]), items[3][1] + " " + items[3][1]]
    docs = frame(spark, texts, [None, *range(1, len(texts))])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {tuple(r) for r in spaced_seeds.overlaps(docs, bench, bound).collect()}
    assert got == brute_overlaps([(r.doc_id, r.text) for r in docs.collect()], items)
    assert spaced_seeds.overlaps(docs.limit(0), bench, bound).count() == 0
    assert spaced_seeds.overlaps(docs, bench.limit(0), bound).count() == 0


def test_decontaminate(spark):
    item = words(20, 1)
    docs = frame(spark, [item, item, words(50, 2), None, words(10, 3)], [1, None, None, 4, 1])
    left = spaced_seeds.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "None"]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_short_items_match_as_a_whole(spark, bound):
    bench = spark.createDataFrame([(1, "What is the capital of Peru?"), (2, "Who won"), (3, ""), (4, None),
                                   (5, words(20, 1))], "item_id long, text string")
    docs = frame(spark, ["So, what is the CAPITAL of Peru? who won", "what is the capital of Chile", "Peru", None,
                         words(20, 1), words(12, 1), "who won, who won"])
    got = {tuple(r) for r in spaced_seeds.overlaps(docs, bench, bound).collect()}
    assert got == {(0, 1, 6, 1, 7), (0, 2, 2, 7, 9), (4, 5, 13, 0, 20), (6, 2, 2, 0, 4)}
    assert sorted(r.doc_id for r in spaced_seeds.decontaminate(docs, bench).collect()) == [1, 2, 3, 5]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_a_document_with_the_whole_benchmark_fits_memory(spark, bound):
    # 24,000 tokens and some 40,000 hits, which are never held each with the document's tokens.
    items = [words(40, 100 + k) for k in range(200)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {tuple(r) for r in spaced_seeds.overlaps(frame(spark, [" ".join(items * 3)]), bench, bound).collect()}
    assert got == {(0, k, 13, 40 * k, 16_040 + 40 * k) for k in range(200)}


def test_items_of_the_same_tokens_are_all_named(spark):
    item = words(20, 1)
    bench = spark.createDataFrame([(1, item), (2, item.upper()), (None, item + "."), (1, words(15, 2)), (1, item)],
                                  "item_id long, text string")
    got = sorted(map(str, spaced_seeds.overlaps(frame(spark, [item, words(15, 2)]), bench).collect()))
    assert got == sorted(f"Row(doc_id={d}, item_id={i}, best=13, token_start=0, token_end={n})"
                         for d, i, n in ((0, 1, 20), (0, 2, 20), (0, None, 20), (1, 1, 15)))


# --- op7 ---------------------------------------------------------------------------------------

def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000),
                                    ("d1", "en", "e", 2000)], "domain string, lang string, source string, tokens long")
    mix = mixing.Mix(domains={}, langs={}, sources={}, percent=25, max_epochs=1)
    got = {r.source: r.alloc for r in mixing.budgets(leaves, mix).collect()}
    # 1002 tokens: 501 per domain, 250 per language; a gives 10, b the rest of its language's share.
    assert got == {"a": 10, "b": 240, "c": 250, "e": 501}
    # The whole subtree is short: the other domain makes up for it.
    mix = mixing.Mix(domains={}, langs={}, sources={}, percent=90, max_epochs=1)
    got = {r.source: r.alloc for r in mixing.budgets(leaves.filter("source <> 'b' AND source <> 'c'"), mix).collect()}
    assert got == {"a": 10, "e": 1799}


def test_mix_edge_cases(spark):
    docs = frame(spark, AWKWARD + [words(50, s) for s in range(30)], [None, *range(1, len(AWKWARD) + 30)])
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big")).withColumn(
        "lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = mixing.choose(docs).collect()
    total = docs.agg(F.sum(F.expr("size(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n]+', 0))"))).first()[0]
    assert 0 < sum(r.n_tokens * r.copies for r in got) <= total // 2
    assert all(1 <= r.copies <= 3 and r.n_tokens > 0 for r in got)
    assert mixing.choose(docs.limit(0)).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == [c for c in docs.columns if c != "copies"] + ["n_tokens", "copies"]
    assert out.count() == len(got)


# --- op1 ---------------------------------------------------------------------------------------

LONG = "The people of the town walked up the hill to see the new light that had been put on the tower."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>", ""), ("<script>var t='</p>';</script>", ""), ("<article><p>x", "x"),
    (f"<nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<br>More.</p><p>Hi</p></article>"
     f"<aside>{LONG}</aside><div class='comments'><p>{LONG}</p></div><footer>{LONG}</footer>",
     f"T & U\n{LONG} More.\nHi"),
    (f"<body><div class='cookie-banner'>{LONG}</div><main><p>{LONG}</p><form>{LONG}</form><ul><li>a<li>b</ul></main>",
     f"{LONG}\na\nb"),
    (f"<article><p>a&nbsp;b\t c &lt;p&gt;</p><!-- <p>no</p> --><style>p{{}}</style><p data-x='>'>{LONG}</p></article>",
     f"a b c <p>\n{LONG}"),
])
def test_main_text(page, text):
    assert html_blocks.main_text(page) == text


def test_extract_rows(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "u", "<article>é 漢" + " w" * 50_000 + "</article>"),
                                   (1, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {(r.page_id, r.n_chars) for r in html_blocks.extract(pages).collect()}
    assert got == {(None, 0), (1, 100_003), (1, 0)}
    assert html_blocks.extract(pages.limit(0)).count() == 0
    assert all(html_blocks.classify(html_blocks.trained_tree(), x) == y for x, y in html_blocks.labelled_table())


def test_extract_finds_articles(spark):
    import re
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_blocks.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = __import__("html").unescape(re.sub(r"<[^>]+>", " ", body)).split()
        assert r.text.split() == want


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><p>{}</p></body>", "<body class='sidebar hidden menu-open'><article>{}</article></body>",
    "<article class='post comments-open tag-news'><p>{}</p></article>", "<main class='search'><p>{}</p></main>",
    "<div id='content' class='with-sidebar'><p>{}</p></div>", "<div style='overflow:hidden'><p>{}</p></div>",
    "<div style='backface-visibility:hidden'><p>{}</p></div>", "<div title='A hidden valley'><p>{}</p></div>",
    "<div data-id='footer' data-hidden='1' aria-hidden='false'><p>{}</p></div>",
])
def test_class_words_and_attributes_keep_main_text(page):
    assert html_blocks.main_text(page.format(LONG)) == LONG


@pytest.mark.parametrize("start", [
    "<div hidden>", "<div hidden=''>", "<div class=x hidden id=y>", "<div style='color:red; display : none'>",
    "<div style='visibility:hidden !important;'>", "<div aria-hidden=true>", "<div class='hidden'>",
    "<div class='cookie-banner x'>", "<div id='left-sidebar'>", "<div class='footerText'>", "<article hidden>",
])
def test_hidden_and_named_furniture_goes(start):
    assert html_blocks.main_text(f"{start}<p>{LONG}</p></{start[1:].split()[0].rstrip('>')}><main><p>x</p></main>") == "x"


# --- op3 ---------------------------------------------------------------------------------------

def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 40):
        code = language_codes.codewords(n).astype(int)
        assert (code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(n, dtype=bool)].min() >= 1
    assert (language_codes.codewords(5)[0] != language_codes.codewords(5)[1]).sum() == 8


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_codes.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == got.held_out.tolist()
    assert (held.lang_pred == held.lang).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    docs = frame(spark, [None, "", "12 34!", "der die das und ist nicht", "the and of to in is", "a", "x" * 30_000],
                 [None, 0, 1, 3, 4, 5, 6])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 3, "de").when(F.col("doc_id") == 4, "en"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_codes.identify(docs).collect()}
    assert [got[i] for i in (None, 0, 1)] == [("und", 0.0)] * 3
    assert {got[i][0] for i in (5, 6)} <= {"de", "en"}
    none = language_codes.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language_codes.identify(docs.limit(0)).count() == 0
    # The prediction sees the text only.
    other = docs.withColumn("doc_id", F.col("doc_id") + 0).withColumn("source", F.lit("zz"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_codes.identify(other).collect()} == got


# --- op5 ---------------------------------------------------------------------------------------

def test_quote_links(spark):
    rows = [(1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "> How are you?\nFine, thanks.\n> unknown line"),
            (1, 2, "u", "On Monday Bob wrote:\n> > How are you?\n> Fine, thanks.\n\nGood to hear.\n"),
            (1, 3, "u", "New topic"), (1, 3, "u", "New topic"), (1, 4, "u", "> hello   THERE.\nBye"), (1, 5, "x", None),
            (1, 6, "u", "> later line\nyes"), (1, 7, "u", "later line"), (None, 0, "u", "> Hello there."),
            (2, None, "u", "> a"), (2, 1, "u", "> Hello there.\n>\nno")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("_m", "level", "i", "up", "_p"):
        df = df.withColumn(c, F.lit("z"))
    got = {(r.conv_id, r.turn): r for r in quote_links.threads(df).collect()}
    assert len(got) == 11
    assert [got[1, t].parent_turn for t in range(8)] == [None, 0, 1, None, 0, None, None, None]
    assert [got[1, t].root_turn for t in range(8)] == [0, 0, 0, 3, 0, 5, 6, 7]
    assert sorted(range(8), key=lambda t: got[1, t].reply_order) == [0, 1, 2, 4, 3, 5, 6, 7]
    assert got[1, 2].body == "Good to hear." and got[1, 2].quoted_turns == [0, 1]
    assert got[1, 1].unlinked_quotes == ["> unknown line"] and got[1, 3].copies == 2 and got[1, 5].body is None
    assert got[2, 1].parent_turn is None and got[2, 1].body == "no"
    assert quote_links.threads(df.limit(0)).count() == 0


def test_hot_conversation_order(spark):
    n = 3000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"),
                               F.when(F.col("id") % 3 == 2, F.concat(F.lit("> line "), (F.col("id") - 1).cast("string")))
                               .otherwise(F.concat(F.lit("line "), F.col("id").cast("string"))).alias("text"))
    got = sorted(quote_links.threads(df).collect(), key=lambda r: r.reply_order)
    assert [r.reply_order for r in got] == list(range(1, n + 1))
    assert [(r.root_turn, r.turn) for r in got] == sorted((r.root_turn, r.turn) for r in got)


def test_quotes_link_to_the_latest_sayer_and_by_passage(spark):
    long = "The bridge will be closed from Monday on,\nand the ferry will not run either,\nso plan your way."
    rows = [(1, 0, "u", long + "\n\nAgreed."), (1, 1, "a", "Agreed."), (1, 2, "u", "Something else"),
            (1, 8, "a", "Agreed."), (1, 9, "u", "> Agreed.\nGood."), (1, 10, "a", "so plan your way."),
            (1, 11, "u", "> " + long.replace("\n", "\n> ") + "\nThanks"),  # as it stands
            (1, 12, "a", "> The bridge will be closed\n> from Monday on, and the ferry\n> will not run either, so\n> plan "
                         "your way.\nBad"),  # wrapped anew
            (1, 13, "u", "> Agreed.\nAgreed."), (2, 1, "u", "> Agreed.")]
    got = {(r.conv_id, r.turn): r for r in quote_links.threads(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 9].parent_turn == 8 and got[1, 9].quoted_turns == [8] and got[1, 9].root_turn == 8
    assert got[1, 11].quoted_turns == [0] and got[1, 12].quoted_turns == [0] and got[1, 12].unlinked_quotes == []
    assert got[1, 13].parent_turn == 8 and got[2, 1].parent_turn is None


def test_hot_line_links_across_partitions(spark):
    n = 4000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"),
                               F.when(F.col("id") % 4 == 0, F.lit("Agreed.")).otherwise(F.lit("> Agreed.\nno"))
                               .alias("text"))
    got = {r.turn: r.parent_turn for r in quote_links.threads(df).collect()}
    assert got == {t: t - t % 4 if t % 4 else None for t in range(n)}


# --- op6, op10 ---------------------------------------------------------------------------------

def test_cotraining_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = cotraining.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[[zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]]
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() >= 0.9


def test_cotraining_edge_cases(spark):
    docs = frame(spark, AWKWARD, [None, *range(1, len(AWKWARD))]).withColumn("label", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in cotraining.score(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1, 0), (4, None, 0), (None, 0, 0), (99, 0, 0)], none.schema)
    assert {r.score for r in cotraining.score(docs, one).collect()} == {1.0}
    two = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)], none.schema)
    got = cotraining.score(docs, two).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert cotraining.score(docs.limit(0), none).count() == 0


def test_cross_entropy_against_plain_models(spark):
    """Models and losses computed again with dictionaries."""
    import math
    from collections import Counter
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in cross_entropy.good_documents(labels).collect()}
    texts = {r.doc_id: (r.text or "").lower().split(" ") for r in docs.collect()}
    texts = {d: " ".join(t).encode().split() for d, t in texts.items()}
    n = Counter(w for t in texts.values() for w in t)
    total = sum(n.values())
    vocab = {w for w, c in n.items() if c >= cross_entropy.VOCAB_SHARE * total}
    norm = {d: [w if w in vocab else None for w in t] for d, t in texts.items()}
    sides = [[norm[d] for d in norm if d in good], list(norm.values())]
    uni = [Counter(w for t in s for w in t) for s in sides]
    bi = [Counter(p for t in s for p in zip(["<s>", *t], t) if None not in p) for s in sides]
    size = len(vocab) + 2
    tokens = [sum(u.values()) for u in uni]
    kept = {p for p in bi[1] if bi[1][p] >= cross_entropy.BIGRAM_SHARE * tokens[1]
            or bi[0][p] and bi[0][p] >= cross_entropy.BIGRAM_SHARE * tokens[0]}
    starts = [sum(1 for t in s if t) for s in sides]
    loss = {}
    for m in range(2):
        p1 = lambda w: (uni[m][w] + 1) / (tokens[m] - 1 + size)  # noqa: E731,B023
        ctx = lambda v: starts[m] if v == "<s>" else uni[m][v]  # noqa: E731,B023
        rate = {p: max(bi[m][p] - cross_entropy.DISCOUNT, 0) / max(ctx(p[0]), bi[m][p])
                if max(ctx(p[0]), bi[m][p]) else 0.0 for p in kept}
        back = Counter()
        for p, r in rate.items():
            back[p[0]] += r
        for d, t in norm.items():
            logs = 0.0
            for v, w in zip(["<s>", *t], t):
                rest = min(1.0, max(1e-6, 1 - back[v])) * p1(w)
                logs += math.log(rest + rate.get((v, w), 0.0) if (v, w) in kept else rest)
            loss[d, m] = -logs / len(t) if t else None
    for r in cross_entropy.score(docs, cross_entropy.good_documents(labels)).collect():
        if loss[r.doc_id, 0] is None:
            assert r.score is None
        else:
            assert r.score == pytest.approx(loss[r.doc_id, 0] - loss[r.doc_id, 1], abs=1e-6)


def test_cross_entropy_edge_cases(spark):
    docs = frame(spark, AWKWARD, [None, *range(1, len(AWKWARD))])
    targets = spark.createDataFrame([(8,), (8,), (None,), (77,)], "doc_id long")
    got = {r.doc_id: r for r in cross_entropy.score(docs, targets).collect()}
    assert len(got) == len(AWKWARD)
    assert got[None].score is None and got[1].score is None and got[2].n_tokens == 0
    assert got[8].score == got[9].score < got[7].score  # the same text, one of them the target
    assert cross_entropy.score(docs, targets.limit(0)).filter("score IS NOT NULL").count() == len(AWKWARD) - 3
    assert cross_entropy.score(docs.limit(0), targets).count() == 0


def test_cross_entropy_counts_rare_words(spark, monkeypatch):
    """Texts that differ only in rare words differ in their losses, at any size of the corpus, in any blocks."""
    common = "a b " * 300_000
    docs = frame(spark, [common, "a rare b", "a scarce b", "a rare b", "a b a"])
    targets = spark.createDataFrame([(1,)], "doc_id long")
    got = {r.doc_id: r for r in cross_entropy.score(docs, targets).collect()}
    assert got[1].loss_background < got[2].loss_background  # "rare" twice, "scarce" once
    assert all(r.n_unknown == 0 for r in got.values())
    monkeypatch.setattr(cross_entropy, "BLOCK", 1)
    again = {r.doc_id: r.score for r in cross_entropy.score(docs, targets).collect()}
    assert again == pytest.approx({d: r.score for d, r in got.items()}, abs=1e-9)


def test_cross_entropy_keeps_words_of_a_small_target(spark):
    """A word and a bigram that only a small target has lower the target loss, however rare in the corpus."""
    docs = frame(spark, ["a b " * 300_000, "a zebra zebra b", "a zebra zebra b", "a b zebra a b"])
    targets = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = {r.doc_id: r for r in cross_entropy.score(docs, targets).collect()}
    assert got[1].score == got[2].score < got[3].score < got[0].score
    assert got[1].n_unknown == 0


# --- pipeline ----------------------------------------------------------------------------------

def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality_ledger.verdicts(docs).collect() if r.kept}
    fps = [brute_fingerprint(rows[i].text) for i in sorted(kept)]
    comp = brute_components(fps, sorted(kept))
    kept = sorted(i for i in kept if comp[i] == i)
    texts, seen = {}, {}
    for i in kept:
        raw = rows[i].text.encode()
        covered = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if seen.setdefault(raw[p:p + 100], (i, p)) < (i, p):
                covered[p:p + 100] = True
        texts[i] = np.frombuffer(raw, np.uint8)[~covered].tobytes().decode("utf-8", "ignore")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, *_ in brute_overlaps([(i, texts[i]) for i in kept], items)}
    con = duckdb.connect()
    import pandas as pd
    left = pd.DataFrame([(i, texts[i], rows[i].lang, rows[i].source) for i in kept if i not in leaked],
                        columns=["doc_id", "text", "lang", "source"])
    con.register("documents", left)
    want = {r[0]: (r[4], r[5]) for r in con.execute(mixing.sql()).fetchall()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.copies) for r in got} == want
    assert all(r.text == texts[r.doc_id] for r in got)


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        assert i == 4 or docs.columns == columns


def test_cross_entropy_of_blank_texts_only(spark):
    docs = frame(spark, [None, "", " \n"])
    got = cross_entropy.score(docs, docs.select("doc_id")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.score) for r in got) == [(0, 0, None), (1, 0, None), (2, 0, None)]


def test_cross_entropy_packed_numbers():
    rng = np.random.default_rng(1)
    for kind in ("<u4", "<i8", "<f4", np.uint8):
        x = (rng.integers(0, 200, 77)).astype(kind)
        assert (cross_entropy.unpack(cross_entropy.pack(x), kind) == x).all()
    keys = np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    assert (cross_entropy.unpack_sorted(cross_entropy.pack_sorted(keys)) == keys).all()
    assert len(cross_entropy.unpack(cross_entropy.pack(keys[:0]), "<u8")) == 0
