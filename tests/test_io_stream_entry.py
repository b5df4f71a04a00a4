"""Sources, sinks, streaming restart, batch hooks, records and the driver contract."""

import json
import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators import records as REC
from cohortlens.operators import scoring as S
from cohortlens.sources import files as IO
from cohortlens.sources import sinks as SNK
from cohortlens.sources.catalog import load_tables, require_tables, table
from cohortlens.sources.cdm import Cdm
from cohortlens.streaming.labelling import label_stream, read_results

from conftest import SF001, SF01

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_jsonl_blank_lines_bad_line_and_empty(spark, tmpdir_):
    good = os.path.join(tmpdir_, "good.jsonl")
    _write(good, '{"id": 1, "text": "a"}\n\n{"id": 2, "text": "b"}\n')
    assert IO.read_jsonl(spark, good, SCHEMA).count() == 2
    bad = os.path.join(tmpdir_, "bad.jsonl")
    _write(bad, '{"id": 1, "text": "a"}\n\n{"id": 2, "text": \n')
    with pytest.raises(ValueError, match=r"bad.jsonl:3"):
        IO.read_jsonl(spark, bad, SCHEMA)
    empty = os.path.join(tmpdir_, "empty.jsonl")
    _write(empty, "\n\n")
    with pytest.raises(ValueError, match="no records"):
        IO.read_jsonl(spark, empty, SCHEMA)


def test_read_json_list_and_split(spark, tmpdir_):
    p = os.path.join(tmpdir_, "list.json")
    _write(p, "[]")
    with pytest.raises(ValueError):
        IO.read_json_list(spark, p, SCHEMA)
    sp = os.path.join(tmpdir_, "split.json")
    _write(sp, json.dumps({"task": "t", "split": "test", "samples": [
        {"sample_id": "a", "text": "x", "label": 0}, {"sample_id": "b", "text": "y", "label": 2}]}))
    assert IO.read_split(spark, sp, [0, 1, 2]).count() == 2
    with pytest.raises(ValueError, match="label_not_allowed"):
        IO.read_split(spark, sp, [0, 1])


def test_require_inputs_and_checksums(spark, tmpdir_):
    _write(os.path.join(tmpdir_, "a", "train.jsonl"), "{}\n")
    _write(os.path.join(tmpdir_, "b", "test.json"), "[]")
    IO.require_inputs(spark, tmpdir_, ["train.jsonl", "test.json"])
    _write(os.path.join(tmpdir_, "c", "train.jsonl"), "{}\n")
    with pytest.raises(ValueError, match="train.jsonl"):
        IO.require_inputs(spark, tmpdir_, ["train.jsonl", "test.json"])
    man = IO.checksum_manifest(spark, tmpdir_)
    assert man.count() == 3 and len(man.first().sha256) == 64


def test_metric_files_and_log_metrics(spark, tmpdir_):
    _write(os.path.join(tmpdir_, "pifu", "tuned", "external_metrics.json"), json.dumps({"metrics": {"f1": 0.9}}))
    _write(os.path.join(tmpdir_, "pifu", "base", "external_metrics.json"), "not json")
    long = IO.collect_metric_files(spark, os.path.join(tmpdir_, "pifu", "*", "*.json"),
                                   {"model": {"tuned": "tuned", "base": "base"}})
    rows = long.collect()
    assert len(rows) == 1 and rows[0].model == "tuned" and rows[0].value == 0.9
    log = os.path.join(tmpdir_, "eval.log")
    _write(log, "BASE MODEL Results:\n  F1                : 0.7831\n  Accuracy : 0.6578\n"
                "FINE-TUNED MODEL Results:\n  F1                : 0.8971\n")
    m = IO.extract_log_metrics(IO.read_logs(spark, log))
    got = {(r.section, r.metric): r.value for r in m.collect()}
    assert got == {("BASE MODEL", "f1"): 0.7831, ("BASE MODEL", "accuracy"): 0.6578, ("FINE-TUNED MODEL", "f1"): 0.8971}


def test_sinks(spark, tmpdir_):
    df = spark.createDataFrame([("a", 0, "train", ["x", "y"]), ("b", 1, "test", [])],
                               "sample_id string, label int, split string, flags array<string>")
    man = SNK.write_splits(df, os.path.join(tmpdir_, "ds"), {"0": "no", "1": "yes"})
    assert {r.split: r.n_samples for r in man.collect()} == {"train": 1, "test": 1}
    SNK.write_cases(df, os.path.join(tmpdir_, "cases"), ["sample_id", "flags"])
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_, "cases"))
    assert "x | y" in [r.flags for r in back.collect()]
    conf = spark.createDataFrame([("m", 0, 0, 3), ("m", 0, 1, 1), ("m", 1, 0, 0), ("m", 1, 1, 2)],
                                 "model string, true_label int, predicted_label int, n long")
    grid = SNK.confusion_grid(conf, ["model"], ["NO", "YES"]).orderBy("true/predicted").collect()
    assert (grid[0]["NO"], grid[0]["YES"]) == (3, 1)


def test_stream_restart_processes_only_new_notes(spark, tmpdir_):
    inp, out, ck = (os.path.join(tmpdir_, d) for d in ("in", "out", "ck"))
    os.makedirs(inp)
    _write(os.path.join(inp, "a.json"), "\n".join(json.dumps({"note_id": i, "person_id": 1, "text": "t" * i})
                                                 for i in range(1, 6)))
    calls = []

    def fn(text):
        calls.append(text)
        return len(text) % 2

    label_stream(spark, inp, out, ck, fn).awaitTermination()
    assert spark.read.parquet(out).count() == 5
    _write(os.path.join(inp, "b.json"), "\n".join(json.dumps({"note_id": i, "person_id": 1, "text": "t" * i})
                                                 for i in range(4, 9)))  # 4, 5 already done
    label_stream(spark, inp, out, ck, fn).awaitTermination()
    res = read_results(spark, out)
    assert res.count() == 8
    assert spark.read.parquet(out).count() == 8  # nothing labelled twice


def test_label_batches_retries_and_reasons(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "unsure")], "note_id long, text string")

    def fn(t):
        if t == "boom":
            raise ConnectionError("down")
        return None if t == "unsure" else 1

    rows = {r.note_id: r for r in S.label_batches(df, fn, "text", "note_id", base_wait=0).collect()}
    assert rows[1].status == "resolved" and rows[1].label == 1
    assert rows[2].unresolved_reason == "api_failure" and rows[2].attempts == 6
    assert rows[3].unresolved_reason == "labeller_uncertain"


def test_records_limits_order_and_missing(spark):
    cdm = Cdm(spark, SF001)
    ids = REC.first_ids(cdm.person, 5)
    assert ids.count() == 5
    assert REC.first_ids(cdm.person, 10_000).count() == 100  # service cap
    for n in (1, 5, 10):
        m = REC.history(cdm.tables(), "measurements", ids, limit=n)
        assert m.groupBy("person_id").count().agg(F.max("count")).first()[0] <= n
    cond = REC.history(cdm.tables(), "conditions", ids).collect()
    by_person = {}
    for r in cond:
        by_person.setdefault(r.person_id, []).append(r.condition_start_date)
    for dates in by_person.values():
        assert dates == sorted(dates, reverse=True)
    unknown = spark.createDataFrame([(10 ** 9,)], "person_id long")
    assert REC.missing_persons(cdm.tables(), unknown).count() == 1


def test_catalog(spark):
    tables = load_tables(spark, SF001)
    assert "lineitem" in tables
    with pytest.raises(ValueError, match="person"):
        require_tables(tables, ["person", "lineitem"])
    with pytest.raises(KeyError, match="Available"):
        table(spark, "no_such_table")


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "patient_count" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["agg_07_top_medications", "evl_06_roc_auc", "win_09_stratified_split",
                                  "qlt_04_14_person_flags", "win_05_select_cases"])
def test_oracle_agreement(spark, name):
    import __spark_entry__ as E
    sys_path_tools = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools")
    import sys
    sys.path.insert(0, sys_path_tools)
    from compare import TABLES, digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF01)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[name])
    drows = cur.fetchall()
    assert digest(srows, sdf.columns)[0] == digest(drows, [d[0] for d in cur.description])[0]
