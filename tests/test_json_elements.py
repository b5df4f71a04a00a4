"""SRC-05 / SRC-06: JSON lists read by byte ranges."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources import files as IO
from cohortlens.sources import sinks as SNK
from cohortlens.sources.json_elements import pieces, read_elements

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture()
def small_ranges(spark):
    """Files are cut into ranges of ``set(n)`` bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def cut(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "0")
    yield cut
    for n, v in before.items():
        spark.conf.set(n, v)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def _value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(['', '}', '{"a": [', 'q"uo\\te', '\\', '"}', 'é🙂', ',]', '\n}\n', 'x' * rng.randrange(80)])
    if kind == 1:
        return rng.randrange(-5, 10 ** 6)
    if kind == 2:
        return rng.choice([True, None, 1.5])
    if kind == 3:
        return {}
    if kind == 4:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(['a', 'b}', 'samples', '"']) + str(i): _value(rng, depth + 1) for i in range(rng.randrange(5))}


@pytest.mark.parametrize("seed", range(4))
def test_elements_of_any_ranges_equal_the_parsed_list(spark, tmpdir_, small_ranges, seed):
    rng = random.Random(seed)
    records = [{"id": i, "v": _value(rng), "w": _value(rng)} for i in range(rng.choice([1, 7, 40]))]
    style = rng.choice([{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
    path = _write(os.path.join(tmpdir_, "list.json"), rng.choice(["", "\n ", "﻿"]) + json.dumps(records, **style) + "\n")
    inner = {"task": "t}", "samples": records, "meta": {"samples": [{"id": -1}], "x": "}"}, "after": [{"a": 1}]}
    split = _write(os.path.join(tmpdir_, "split.json"), json.dumps(inner, **style))
    for size in (1 << 20, 37, 200):
        small_ranges(size)
        got, _ = read_elements(spark, path)
        assert sorted((json.loads(r.text) for r in got.collect()), key=lambda r: r["id"]) == records
        got, rest = read_elements(spark, split, "samples")
        assert sorted((json.loads(r.text) for r in got.collect()), key=lambda r: r["id"]) == records
        assert list(rest.values()) == [inner | {"samples": []}]


def test_one_file_is_read_by_many_tasks(spark, tmpdir_, small_ranges):
    path = _write(os.path.join(tmpdir_, "big.json"), json.dumps([{"id": i, "text": "x" * 100} for i in range(500)]))
    small_ranges(4096)
    tasks = pieces(spark, path, None).filter("kind = 'element'").groupBy(F.spark_partition_id()).count()
    assert tasks.count() >= 8
    assert IO.read_json_list(spark, path, SCHEMA).agg(F.sum("id")).first()[0] == sum(range(500))


@pytest.mark.parametrize("text, what", [
    ("[]", "an empty list"), ("", "not a list"), ("{}", "not a list"), ('{"a": [{}]}', "not a list"), ('"x"', "not a list"),
    ('[{"id": 1}', "broken JSON"), ('[{"id": 1}]]', "broken JSON"), ('[{"id": 1} {"id": 2}]', "broken JSON"),
    ('[{"id": 1},]', "broken JSON"), ('[,{"id": 1}]', "broken JSON"), ('[{"id": 1}, 5]', "broken JSON"),
    ('[{"id": 1}, [2]]', "broken JSON"), ('[{"id": 1, "text": "a]', "broken JSON"), ('[{"id": }]', "broken JSON"),
    ('[{"id": 1}] x', "broken JSON"), ('[{"id": 1},,{"id": 2}]', "broken JSON")])
def test_files_that_are_no_list_fail_with_their_path(spark, tmpdir_, small_ranges, text, what):
    _write(os.path.join(tmpdir_, "in", "good.json"), '[{"id": 1, "text": "a"}]')
    _write(os.path.join(tmpdir_, "in", "odd.json"), text)
    for size in (1 << 20, 5) if text in ("[]", "", '[{"id": 1}') else (5,):
        small_ranges(size)
        with pytest.raises(ValueError, match=f"odd.json: {what}"):
            IO.read_json_list(spark, os.path.join(tmpdir_, "in"), SCHEMA)


def test_split_payload_guards(spark, tmpdir_):
    sample = {"sample_id": "a", "text": "x", "label": 0}
    one = _write(os.path.join(tmpdir_, "one.json"), json.dumps({"split": "test", "samples": [sample]}))
    with pytest.raises(ValueError, match="two classes"):
        IO.read_split(spark, one, [0, 1])
    none = _write(os.path.join(tmpdir_, "none.json"), json.dumps({"split": "test"}))
    with pytest.raises(ValueError, match="none.json: not an object with a list"):
        IO.read_split(spark, none, [0, 1])
    both = _write(os.path.join(tmpdir_, "both.json"), json.dumps(
        {"samples": [sample, sample | {"sample_id": "b", "label": 1}], "split": "train"}))
    assert {(r.split, r.sample_id) for r in IO.read_split(spark, both, [0, 1]).collect()} == {("train", "a"), ("train", "b")}


def test_lists_are_written_row_by_row_and_read_back(spark, tmpdir_):
    rows = [(i, 'a"}],[{' + str(i) if i % 3 else None) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    for files in (1, 4, 200):
        path = os.path.join(tmpdir_, f"lists{files}")
        SNK.write_json_lists(df, path, files)
        parts = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")]
        assert len(parts) <= files and sum(len(json.load(open(p))) for p in parts) == 50
        assert sorted(map(tuple, IO.read_json_list(spark, path, SCHEMA).collect())) == rows
