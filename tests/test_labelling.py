"""STR-01, UDF-01, UDF-02: the labelling stream, the concurrent labeller, the model per worker."""

import glob
import json
import os
import time

import pytest

from cohortlens.operators import scoring as S
from cohortlens.streaming.labelling import label_stream, read_results, read_violations


def _lines(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows)


def _note(i, text=None):
    return {"note_id": i, "person_id": 1, "text": text or "t" * i}


def _called(path):
    """A labeller that leaves a line in ``path`` for every call."""
    def fn(text):
        with open(path, "a") as f:
            f.write(f"{len(text)}\n")
        return len(text) % 2
    return fn


def _calls(path):
    return sorted(int(x) for x in open(path)) if os.path.exists(path) else []


@pytest.fixture()
def places(tmpdir_):
    return [os.path.join(tmpdir_, d) for d in ("in", "out", "ck", "calls")]


def test_stream_sends_rows_that_cannot_be_labelled_to_the_violations(spark, places):
    inp, out, ck, calls = places
    _lines(f"{inp}/a.json", [_note(1), '{"note_id": 2, "text": \n', {"person_id": 3, "text": "no id"},
                             {"note_id": None, "text": "null id"}, {"note_id": 4, "person_id": 1}, _note(5), _note(5, "again")])
    label_stream(spark, inp, out, ck, _called(calls), base_wait=0).awaitTermination()
    assert sorted(r.note_id for r in read_results(spark, out).collect()) == [1, 5]
    reasons = sorted(r.reason for r in read_violations(spark, out).collect())
    assert reasons == ["broken_row", "missing_id", "missing_id", "missing_text"]


def test_killed_and_replayed_epoch_leaves_one_record_per_note(spark, places):
    inp, out, ck, calls = places
    _lines(f"{inp}/a.json", [_note(i) for i in range(1, 6)])
    label_stream(spark, inp, out, ck, _called(calls), base_wait=0).awaitTermination()
    _lines(f"{inp}/b.json", [_note(i) for i in range(4, 9)])
    label_stream(spark, inp, out, ck, _called(calls), base_wait=0).awaitTermination()
    assert _calls(calls) == list(range(1, 9))  # 4 and 5 were known from the state

    def forget(epoch):  # the batch was written, but the stream was killed before it was recorded
        for f in (f"{ck}/commits/{epoch}", f"{ck}/commits/.{epoch}.crc"):
            os.remove(f)

    forget(1)
    label_stream(spark, inp, out, ck, _called(calls), base_wait=0).awaitTermination()
    assert _calls(calls) == list(range(1, 9))  # the written epoch is not labelled again
    # Killed in the middle of the write: some rows are there, without the mark of a whole folder.
    forget(1)
    os.remove(glob.glob(f"{out}/stream=*/epoch=1/_SUCCESS")[0])
    parts = glob.glob(f"{out}/stream=*/epoch=1/part-*")
    for f in parts[1:]:
        os.remove(f)
    label_stream(spark, inp, out, ck, _called(calls), base_wait=0).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.note_id for r in rows) == list(range(1, 9))
    assert _calls(calls) == sorted([*range(1, 9), 6, 7, 8])


def test_batches_do_not_read_the_stored_results(spark, places):
    inp, out, ck, calls = places
    _lines(f"{inp}/a.json", [_note(1)])
    label_stream(spark, inp, out, ck, _called(calls), base_wait=0).awaitTermination()
    for f in glob.glob(f"{out}/stream=*/epoch=0/part-*"):  # unreadable results do not disturb a later batch
        with open(f, "wb") as g:
            g.write(b"not parquet")
    _lines(f"{inp}/b.json", [_note(1), _note(2)])
    label_stream(spark, inp, out, ck, _called(calls), base_wait=0).awaitTermination()
    assert _calls(calls) == [1, 2]
    assert glob.glob(f"{ck}/state/0/*/*.zip") or glob.glob(f"{ck}/state/0/**/*.changelog", recursive=True)  # RocksDB


def test_a_new_checkpoint_is_a_new_stream(spark, places):
    inp, out, ck, calls = places
    _lines(f"{inp}/a.json", [_note(1), _note(2)])
    for k in (1, 2):
        label_stream(spark, inp, out, f"{ck}{k}", _called(calls), base_wait=0).awaitTermination()
    assert spark.read.parquet(out).count() == 4 and read_results(spark, out).count() == 2


def test_labeller_keeps_null_and_large_ids(spark):
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(big, "a"), (None, "b"), (big + 2, None)], "note_id long, text string").coalesce(1)
    rows = S.label_batches(df, lambda t: None if t is None else 1, base_wait=0).collect()
    assert [(r.note_id, r.status) for r in rows] == [(big, "resolved"), (None, "resolved"), (big + 2, "unresolved")]


def test_labeller_empty_and_renamed_key(spark):
    df = spark.createDataFrame([], "letter long, body string")
    out = S.label_batches(df, len, "body", "letter")
    assert out.columns[0] == "letter" and out.count() == 0


def test_retries_of_one_task_overlap(spark):
    df = spark.createDataFrame([(i, "x") for i in range(8)], "note_id long, text string").coalesce(1)

    def down(text):
        raise ConnectionError

    S.label_batches(df, down, retries=1).collect()  # warm worker
    took = {}
    for concurrency in (1, 8):
        t0 = time.time()
        rows = S.label_batches(df, down, retries=2, base_wait=0.2, concurrency=concurrency).collect()
        took[concurrency] = time.time() - t0
        assert {(r.error_type, r.attempts, r.unresolved_reason) for r in rows} == {("ConnectionError", 2, "api_failure")}
    assert took[8] < took[1] / 2


def test_rate_limit_holds_for_all_threads_of_a_task(spark):
    df = spark.createDataFrame([(i, "x") for i in range(10)], "note_id long, text string").coalesce(1)
    t0 = time.time()
    S.label_batches(df, len, concurrency=8, per_second=10).collect()
    assert time.time() - t0 >= 0.9


def test_model_is_built_once_per_worker(spark, tmpdir_):
    built = os.path.join(tmpdir_, "built")

    def model():
        with open(built, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[float(len(t)), float(os.getpid())] for t in texts]

    df = spark.range(400).selectExpr("cast(id as string) as sample_id", "repeat('x', id % 7) as text").repartition(40)
    for _ in range(2):  # 40 tasks each
        workers = {int(r.scores[1]) for r in S.score_batches(df, model, n_classes=2).collect()}
    builds = [int(x) for x in open(built)]
    assert len(builds) == len(set(builds)) and workers <= set(builds) and len(builds) < 40


def test_another_model_never_answers(spark):
    df = spark.createDataFrame([("a", "xx")], "sample_id string, text string")

    def model(k):
        return lambda: lambda texts: [[float(k)] for _ in texts]

    for k in (1, 2, 3, 1):
        assert S.score_batches(df, model(k), n_classes=1).first().scores == [float(k)]
    with pytest.raises(Exception, match="3 scores"):
        S.score_batches(df, model(1), n_classes=3).collect()


def test_worker_keeps_a_bounded_number_of_models():
    S._models.clear()
    for name in ("a", "b", "a", "c"):
        S.worker_model(name, lambda name=name: name)
    assert list(S._models) == ["a", "c"] and S.worker_model("a", lambda: "new") == "a"
    S._models.clear()
