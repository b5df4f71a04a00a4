"""SRC-09, SRC-10, SNK-01, JON-06, JON-01: logs by parts, checksums in pieces, committed writes, Bloom filter, layout."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import bloom as B
from cohortlens.operators import datasets as D
from cohortlens.operators import records as REC
from cohortlens.sources import files as IO
from cohortlens.sources import layout, logs
from cohortlens.sources import sinks as SNK
from cohortlens.sources.cdm import Cdm

from conftest import SF001

RANGES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture()
def small_ranges(spark):
    before = {n: spark.conf.get(n) for n in RANGES}

    def cut(n):
        spark.conf.set(RANGES[0], str(n))
        spark.conf.set(RANGES[1], "0")
    yield cut
    for n, v in before.items():
        spark.conf.set(n, v)


def _write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return path


# ---------------------------------------------------------------- logs


def _plain_metrics(text):
    """The same reading of a whole log, in one go."""
    out, section, lines = [], None, text.split("\n")
    for i, line in enumerate(lines):
        if logs.heading(line):
            section = logs.heading(line)
        elif line.startswith("COMPARISON") and i and logs.is_rule(lines[i - 1]):
            section = None
        elif section and logs.metric(line):
            out.append((section, *logs.metric(line)))
    return sorted(out)


LINES = ["BASE MODEL Results:", "FINE-TUNED MODEL Results:", "OTHER Results:  ", "  F1 : 0.5", "  F1 : 0.75 (best)", "Macro F1: .25",
         "  Loss : 1", "Loss : 1 of 2", "=====", "COMPARISON", "COMPARISON TABLE", "", "noise", "Balanced accuracy : -1.5",
         "base model Results:", "x" * 70, "Time : 12:30", "Results:"]


@pytest.mark.parametrize("seed", range(2))
def test_sections_carry_over_the_parts_of_a_log(spark, tmpdir_, small_ranges, seed):
    rng = random.Random(seed)
    texts = {f"{k}.log": "\n".join(rng.choice(LINES) for _ in range(rng.choice([3, 60, 200]))) for k in range(3)}
    for name, text in texts.items():
        _write(os.path.join(tmpdir_, "logs", name), text)
    want = sorted((n, *m) for n, text in texts.items() for m in _plain_metrics(text))
    for size in (1 << 20, 90, 13):
        small_ranges(size)
        got = IO.extract_log_metrics(IO.read_logs(spark, os.path.join(tmpdir_, "logs"))).collect()
        assert sorted((os.path.basename(r.source), r.section, r.metric, r.value) for r in got) == want
    whole = spark.createDataFrame(list(texts.items()), "source string, value string")
    assert sorted(tuple(r) for r in IO.extract_log_metrics(whole).collect()) == want


def test_log_bundles_have_the_tags_and_the_first_values(spark, tmpdir_, small_ranges):
    path = _write(os.path.join(tmpdir_, "a.log"), "F1 : 9\nBASE MODEL Results:\n  F1 : 0.5\n  F1 : 0.6\n  Loss : 3\n" + "pad\n" * 50
                  + "  ROC AUC: 0.7 +- 0.1\n=====\nCOMPARISON\nF1 : 1\nFINE-TUNED MODEL Results:\nAccuracy : 1\nEND Results:\nRecall : 1")
    small_ranges(40)
    got = {tuple(r)[:3] + tuple(r)[4:] for r in IO.collect_log_metrics(IO.read_logs(spark, path)).collect()}
    assert got == {("original", "base", "test", "f1", 0.5), ("original", "base", "test", "roc_auc", 0.7),
                   ("original", "fine_tuned", "test", "accuracy", 1.0)}


# ---------------------------------------------------------------- checksums


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_large_files_are_hashed_in_pieces(spark, tmpdir_, small_ranges, size):
    rng = random.Random(2)
    contents = {"a.bin": rng.randbytes(3000), "b.txt": b"line\n" * 100, "c.txt": b"line\n" * 100 + b"end", "d.txt": b"\n\n\n",
                "e.txt": b"\xef\xbb\xbfmark\r\nx\n", "f.txt": b"\xef\xbb\xbfmark", "g.txt": b"no feed", "h.txt": b"\r\n\r\n\r"}
    for name, data in contents.items():
        _write(os.path.join(tmpdir_, "in", name), data)
    small_ranges(size)
    for large in (0, 200, 1 << 20):
        got = {os.path.basename(r.path): (r.sha256, r.length) for r in IO.checksum_manifest(spark, f"{tmpdir_}/in", large).collect()}
        assert got == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in contents.items()}


# ---------------------------------------------------------------- committed writes


def _splits(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, label int, split string")


def test_splits_are_written_once_and_the_manifest_counts_them(spark, tmpdir_):
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    df = _splits(spark, [(str(i), i % 2, "test" if i % 5 == 0 else "train") for i in range(50)])
    once = df.mapInArrow(seen, df.schema)
    path = os.path.join(tmpdir_, "ds")
    man = SNK.write_splits(once, path, {"0": "no", "1": "yes"}).collect()
    assert ran.value == 50
    assert {r.split: (r.n_samples, r.class_counts) for r in man} == {"train": (40, {"0": 20, "1": 20}), "test": (10, {"0": 5, "1": 5})}
    assert spark.read.json(f"{path}/manifest").agg(F.sum("n_samples")).first()[0] == spark.read.parquet(f"{path}/samples").count() == 50
    again = SNK.write_splits(_splits(spark, [("a", 1, "train")]), path, {"0": "no", "1": "yes"})
    assert again.count() == 1 and spark.read.parquet(f"{path}/samples").count() == 1
    assert os.listdir(tmpdir_) == ["ds"]


def test_a_failed_write_leaves_what_was_there(spark, tmpdir_):
    path, names = os.path.join(tmpdir_, "ds"), {"0": "no", "1": "yes"}
    bad = _splits(spark, [("a", 1, "train"), ("b", 7, "train")])
    with pytest.raises(ValueError, match="1 rows have another split or label"):
        SNK.write_splits(bad, path, names)
    assert os.listdir(tmpdir_) == []
    SNK.write_splits(_splits(spark, [("a", 1, "train")]), path, names)
    broken = bad.withColumn("label", F.when(F.col("label") == 7, F.raise_error(F.lit("boom")).cast("int")).otherwise(1))
    with pytest.raises(Exception, match="boom"):
        SNK.write_splits(broken, path, names)
    assert os.listdir(tmpdir_) == ["ds"] and spark.read.parquet(f"{path}/samples").count() == 1


# ---------------------------------------------------------------- Bloom filter


def test_bloom_filter_never_misses_and_thins(spark):
    held = spark.range(0, 3000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    bits = B.filter_bits(3000)
    bitmaps = B.bloom_filter(held, "h", bits).checkpoint()
    probe = spark.range(0, 60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    probe = probe.union(spark.createDataFrame([(None, None)], "id long, h string"))
    got = B.maybe_in(probe, "h", bitmaps, bits, "maybe")
    assert got.filter("id < 3000 AND NOT maybe").count() == 0 and got.filter("maybe IS NULL").count() == 0
    assert got.filter("id >= 3000 AND maybe").count() < 0.03 * 57_000
    assert B.filter_bits(10 ** 12) == B.MAX_BITS  # 16 MB whatever is held


def test_overlap_is_exact_also_behind_a_full_filter(spark, monkeypatch):
    rng = random.Random(7)
    train = [(i, "\n".join(f"line {rng.randrange(400)}" for _ in range(3)) if i % 10 else None) for i in range(300)]
    test = [(f"line {rng.randrange(400)}",) for _ in range(60)] + [(None,), ("  \n",)] + [(train[i][1],) for i in (1, 2, 3)]
    a, b = spark.createDataFrame(train, "doc_id int, text string"), spark.createDataFrame(test, "text string")
    lines = {x.strip() for t, in test if t for x in t.split("\n") if x.strip()}
    norm = lambda t: " ".join(t.split()).lower()
    by_line = sorted(i for i, t in train if not t or not {norm(x) for x in t.split("\n")} & {norm(x) for x in lines})
    whole = {norm(t) for t, in test if t}
    by_doc = sorted(i for i, t in train if t is None or norm(t) not in whole)
    for most, sent in ((1 << 27, 0), (1 << 15, 0), (1 << 27, 10 ** 6)):
        monkeypatch.setattr(B, "MAX_BITS", most)
        monkeypatch.setattr(D, "MAX_BROADCAST_HASHES", sent)
        assert sorted(r.doc_id for r in D.remove_overlap(a, b, level="line").collect()) == by_line
        out = D.remove_overlap(a, b, level="document")
        assert out.columns == ["doc_id", "text"] and sorted(r.doc_id for r in out.collect()) == by_doc


# ---------------------------------------------------------------- layout by person


def test_histories_of_laid_out_facts_do_not_move_them(spark):
    cdm = Cdm(spark, SF001)
    tables = {n: cdm[n] for n in ("person", "concept", "measurement", "drug_exposure")}
    ids = cdm.person.select("person_id")
    saved = layout.lay_out(spark, tables, ["measurement", "drug_exposure"], 8, "t_layout")
    again = layout.laid_out(spark, tables, ["measurement", "drug_exposure"], "t_layout")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (None, 5):
            plain = REC.history(tables, "measurements", ids, limit=limit, sort=False)
            laid = REC.history(again, "measurements", ids, limit=limit, sort=False, laid_out=True)
            assert sorted(map(tuple, laid.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        newest = REC.newest(again["measurement"], "measurement_date", "measurement_id", 5, salted=False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both = again["measurement"].select("person_id", "measurement_id").join(
            again["drug_exposure"].select("person_id", "drug_exposure_id"), "person_id")
        for df in (newest, both):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("measurement", "drug_exposure"):
            spark.sql(f"DROP TABLE IF EXISTS t_layout_{name}")
    assert set(saved) == set(tables)


def test_cohort_wide_histories_have_no_global_sort(spark):
    import __spark_entry__ as E
    for name in ("jon_01_conditions", "jon_01_notes", "win_01_newest_measurements"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan
