import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimsift.fixed_values import ANSWER_ERROR, ANSWER_QUOTA
from claimsift.operators import external, models, tagging
from claimsift.plans.tables import STOPS, split_table
from claimsift.session import new_path
from claimsift.streaming import auto_tag

SF = "/root/testdata/sf0.001"
EVENTS = "event_id bigint, ts timestamp_ntz, claim_id bigint, tag string, engine string, confidence double"


@pytest.fixture(scope="module")
def claims(spark):
    rows = [(1, "one one", "old"), (2, "two two", None), (3, "three", "old"), (4, "ab", None), (5, "   \t ", None), (6, "six", "keep")]
    return spark.createDataFrame(rows, "id bigint, content string, tag string")


@pytest.fixture(scope="module")
def model(spark):
    table = models.prepare_training(split_table(spark, SF), 500, STOPS, vectors=False)
    return models.train_naive_bayes(table.arrays.where("split = 'train'"), table.vectoriser, table.labels)


def _events(spark):
    day = [datetime(2024, 1, d) for d in range(1, 9)]
    rows = [
        (1, day[0], 1, "first", "manual", None), (2, day[1], 1, "second", "ml", 0.9),      # overwrite
        (3, day[2], 2, "x", "manual", None), (4, day[3], 2, None, "manual", None),         # cleared with null
        (5, day[4], 3, "  ", "manual", None),                                              # blanks stay a value
        (6, day[5], 99, "nowhere", "manual", None),                                        # unknown claim
        (7, day[6], 4, "tie low", "ml", 0.5), (8, day[6], 4, "tie high", "external", None),  # equal time
        (9, day[0], 3, "earlier", "ml", 0.1),                                              # late arrival, older
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_golden_events(spark, claims):
    events = tagging.manual_changes(_events(spark))
    out = tagging.apply_tags(claims, events)
    expected = {1: "second", 2: None, 3: "", 4: "tie high", 5: None, 6: "keep"}
    assert {r["id"]: r["tag"] for r in out.collect()} == expected
    again = tagging.apply_tags(out, events)
    assert {r["id"]: r["tag"] for r in again.collect()} == expected
    state = {r["claim_id"]: (r["tag"], r["engine"], r["confidence"]) for r in tagging.tag_state(events).collect()}
    assert state[1] == ("second", "ml", 0.9) and state[2] == (None, "manual", None) and state[4][1] == "external"


def test_inboxes(claims):
    assert [r["id"] for r in tagging.inbox_filter(claims, "all").collect()] == [6, 5, 4, 3, 2, 1]
    assert [r["id"] for r in tagging.inbox_filter(claims, "").collect()] == [6, 5, 4, 3, 2, 1]
    for name in ("null", "untagged"):
        assert {r["id"] for r in tagging.inbox_filter(claims, name).collect()} == {2, 4, 5}
    assert {r["id"] for r in tagging.inbox_filter(claims, "old").collect()} == {1, 3}
    assert tagging.claim_by_id(claims, 3).first()["content"] == "three" and tagging.claim_by_id(claims, 42).count() == 0


def test_lookup_is_pushed_to_the_scan(spark, claims):
    path = new_path(spark, "claims")
    claims.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = tagging.claim_by_id(stored, 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan
    plan = tagging.inbox_filter(stored, "untagged").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNull(tag)]" in plan


REQUESTS = [(1, "1abc"), (2, " 2"), (3, "-3.9"), (4, "abc"), (5, ""), (6, None), (7, "4"), (8, "5"), (9, "77"), (10, "1")]


def test_golden_requests(spark, claims, model):
    requests = spark.createDataFrame(REQUESTS, "request_id bigint, id string")
    status = {r["request_id"]: r["status"] for r in tagging.resolve_requests(requests, claims).collect()}
    assert status == {1: "found", 2: "found", 3: "not_found", 4: "invalid_id", 5: "invalid_id", 6: "invalid_id",
                      7: "found", 8: "found", 9: "not_found", 10: "found"}
    out = {r["request_id"]: r for r in tagging.auto_tag_ml(requests, claims, model).collect()}
    assert {k: r["status"] for k, r in out.items()} == {
        1: "tagged", 2: "tagged", 3: "not_found", 4: "invalid_id", 5: "invalid_id", 6: "invalid_id",
        7: "too_short", 8: "empty", 9: "not_found", 10: "tagged"}
    assert out[1]["tag"] == out[10]["tag"] and 0.25 <= out[1]["confidence"] <= 1 and out[1]["engine"] == "ml"
    table = tagging.apply_results(claims, tagging.auto_tag_ml(requests, claims, model))
    tags = {r["id"]: r["tag"] for r in table.collect()}
    assert tags[1] == out[1]["tag"] and tags[3] == "old" and tags[4] is None and tags[6] == "keep" and len(tags) == 6


def test_external_answers(spark, claims):
    requests = spark.createDataFrame([(1, "1"), (2, "2"), (3, "3"), (4, "x")], "request_id bigint, id string")
    answers = spark.createDataFrame([(1, " mortgage "), (2, None)], "claim_id bigint, prediction_raw string")
    out = {r["request_id"]: (r["status"], r["prediction_raw"], r["tag"])
           for r in tagging.auto_tag_external(requests, claims, answers).collect()}
    assert out == {1: ("tagged", "mortgage", "Mortgage"), 2: ("tagged", "", "Credit reporting"),
                   3: ("no_answer", None, None), 4: ("invalid_id", None, None)}
    assert tagging.prompts(requests, claims).count() == 3


def test_retries():
    waits = []

    def client(failures, message, answer="ok"):
        left = [failures]

        def call(prompt):
            if left[0] > 0:
                left[0] -= 1
                raise RuntimeError(message)
            return answer

        return call

    def run(c):
        waits.clear()
        return external.ask(c, "p", lambda: sum(waits), waits.append)

    assert run(client(0, "")) == ("ok", 0, 1)
    assert run(client(2, "HTTP 429")) == ("ok", 30, 3)
    assert run(client(9, "RESOURCE_EXHAUSTED")) == (ANSWER_QUOTA, 150, 5) and waits == [10, 20, 30, 40, 50]
    assert run(client(1, "broken")) == (ANSWER_ERROR, 0, 1)
    assert run(client(0, "", None))[0] == ANSWER_ERROR and run(client(0, "", " x\n"))[0] == "x"


def test_external_scoring_is_the_only_python(spark):
    df = spark.range(10).select(F.col("id").alias("claim_id"), F.lit("t").alias("claim"))
    out = external.score_external(df, lambda: len, pause=0.0, parallel_calls=3)
    assert "MapInPandas" in out._jdf.queryExecution().executedPlan().toString() and out.rdd.getNumPartitions() == 3


def test_stream_equals_batch_and_replay_changes_nothing(spark, model, claims):
    inbox, target, checkpoint = (new_path(spark, n) for n in ("arrivals", "tagged", "stream"))
    texts = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 AS claim_id", "text AS content", "doc_id AS arrived")
    both = texts.unionByName(claims.selectExpr("id AS claim_id", "content", "id AS arrived"))
    both.repartition(5).write.parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    query = auto_tag.auto_tag_stream(auto_tag.read_arrivals(spark, inbox, schema, 2), model, target, checkpoint)
    query.awaitTermination()

    def rows(df):
        return sorted(tuple(r) for r in df.select(
            "claim_id", "status", F.coalesce("tag", F.lit("")), F.coalesce("confidence", F.lit(-1.0))).collect())

    expected = rows(auto_tag.tag_batch(both, model))
    assert rows(auto_tag.read_tagged(spark, target)) == expected
    assert {r["status"] for r in auto_tag.read_tagged(spark, target).collect()} == {"tagged", "too_short", "empty"}
    other = new_path(spark, "stream")  # a lost checkpoint replays every file: same claims, same tags
    auto_tag.auto_tag_stream(auto_tag.read_arrivals(spark, inbox, schema, 2), model, target, other).awaitTermination()
    assert rows(auto_tag.read_tagged(spark, target)) == expected


def test_the_version_that_arrived_last_decides(spark, model):
    target, inbox = new_path(spark, "tagged"), new_path(spark, "arrivals")
    text = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 800").collect()}
    rows = [(1, text["de"], 5), (1, text["fr"], 9), (1, text["en"], 7), (2, text["es"], 1)]
    rows = spark.createDataFrame(rows, "claim_id long, content string, arrived long")
    rows.coalesce(1).write.parquet(inbox)
    older = spark.createDataFrame([(2, text["de"], 0)], rows.schema)
    for batch in (older, rows):
        other = new_path(spark, "arrivals")
        batch.coalesce(1).write.parquet(other)
        auto_tag.auto_tag_stream(
            auto_tag.read_arrivals(spark, other, rows.schema), model, target, new_path(spark, "stream")).awaitTermination()
    auto_tag.auto_tag_stream(auto_tag.read_arrivals(spark, other, rows.schema), model, target, new_path(spark, "stream")).awaitTermination()
    state = {r["claim_id"]: (r["tag"], r["arrived"]) for r in auto_tag.read_tagged(spark, target).collect()}
    assert state == {1: ("fr", 9), 2: ("es", 1)}
    auto_tag.compact_tagged(spark, target)
    assert {r["claim_id"]: (r["tag"], r["arrived"]) for r in auto_tag.read_tagged(spark, target).collect()} == state


def test_rows_without_id_or_order_are_not_lost(spark, model):
    rows = [(None, "a claim without id", 1), (None, "a claim without id", 1), (None, None, None), (1, "a claim without arrival", None),
            (2, "a claim without arrival", None), (2, "ab", 3), (3, "ab", None), (3, "ab", None)]
    inbox, target = new_path(spark, "arrivals"), new_path(spark, "tagged")
    batch = spark.createDataFrame(rows, "claim_id long, content string, arrived long")
    batch.write.parquet(inbox)
    want = [(1, None, "tagged"), (2, 3, "too_short"), (3, None, "too_short"), (None, 1, "invalid_id"), (None, 1, "invalid_id"), (None, None, "invalid_id")]
    seen = lambda df: sorted((tuple(r) for r in df.select("claim_id", "arrived", "status").collect()), key=str)
    assert seen(auto_tag.tag_batch(batch, model)) == sorted(want, key=str)
    auto_tag.auto_tag_stream(auto_tag.read_arrivals(spark, inbox, batch.schema), model, target, new_path(spark, "stream")).awaitTermination()
    assert seen(auto_tag.read_tagged(spark, target)) == sorted(want, key=str)
    auto_tag.compact_tagged(spark, target)
    assert seen(auto_tag.read_tagged(spark, target)) == sorted(want, key=str)


def test_events_without_ts_or_id_count(spark):
    day = datetime(2024, 1, 1)
    events = spark.createDataFrame([
        (1, None, 1, "a", "ml", None), (None, day, 2, "b", "ml", None), (None, None, 3, "c", "ml", None), (None, None, 3, "c", "ml", None),
        (7, None, 4, "older", "ml", None), (None, day, 4, "no id", "ml", None), (0, day, 4, "last", "ml", None)], EVENTS)
    assert sorted((r["claim_id"], r["tag"]) for r in tagging.tag_state(events).collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "last")]
    claims = spark.createDataFrame([(k, "x", "old") for k in range(1, 5)], "id bigint, content string, tag string")
    assert {r["id"]: r["tag"] for r in tagging.apply_tags(claims, events).collect()} == {1: "a", 2: "b", 3: "c", 4: "last"}


def test_repeated_answers_give_one_result_per_request(spark, claims):
    requests = spark.createDataFrame([(1, "1"), (2, "1"), (3, "2")], "request_id bigint, id string")
    given = [(1, "Student loan"), (1, "Mortgage"), (1, "Mortgage")]
    for rows in (given, given[::-1]):
        answers = spark.createDataFrame(rows, "claim_id bigint, prediction_raw string")
        found = tagging.auto_tag_external(requests, claims, answers).orderBy("request_id").collect()
        assert [(r["request_id"], r["status"], r["prediction_raw"]) for r in found] == [(1, "tagged", "Mortgage"), (2, "tagged", "Mortgage"), (3, "no_answer", None)]


def test_versions_of_one_time_are_told_apart_by_their_content(spark, model):
    rows = [(1, f"text number {k}", 5) for k in range(9)] + [(1, "older", 4)]
    schema = "claim_id bigint, content string, arrived bigint"
    got = {auto_tag.tag_batch(spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(3), model).first()["tag"] for k in range(3)}
    assert len(got) == 1


def test_the_stream_passes_on_changes_only(spark, model):
    """Versions of one time in two batches, a repeated file, an older version, and a lost checkpoint: one defined row."""
    schema = "claim_id bigint, content string, arrived bigint"
    batches = [
        [(1, "text one", 5), (2, "text two", None)], [(1, "text other", 5), (1, "older text", 4), (3, "text three", 1)],
        [(1, "text one", 5), (2, "text two", 3)]]
    states = []
    for order in (batches, batches[::-1]):
        inbox, target, checkpoint = (new_path(spark, n) for n in ("arrivals", "tagged", "stream"))
        written = []
        for rows in [*order, order[0]]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
            auto_tag.auto_tag_stream(auto_tag.read_arrivals(spark, inbox, spark.read.parquet(inbox).schema), model, target, checkpoint).awaitTermination()
            stored = spark.read.schema(auto_tag.TAGGED).option("recursiveFileLookup", "true").parquet(target)
            written.append(stored.count())
        assert written[-1] == written[-2] <= 5  # the repeated file changes nothing
        once = sorted(map(tuple, auto_tag.read_tagged(spark, target).collect()))
        again = auto_tag.read_arrivals(spark, inbox, spark.read.parquet(inbox).schema)
        auto_tag.auto_tag_stream(again, model, target, new_path(spark, "stream")).awaitTermination()
        assert sorted(map(tuple, auto_tag.read_tagged(spark, target).collect())) == once
        states.append(once)
    assert states[0] == states[1] and [(r[0], r[1]) for r in states[0]] == [(1, 5), (2, 3), (3, 1)]


def _service(folder, fails_at=None):
    """A client that notes every call as a file; ``fails_at``: the task dies at the prompt with this word."""
    def make():
        def call(prompt):
            if fails_at and fails_at in prompt:
                raise SystemExit("lost")
            if "busy" in prompt and not list(folder.glob("*busy*")):
                (folder / "busy").touch()
                raise RuntimeError("429")
            (folder / f"{abs(hash(prompt))}-{time.time_ns()}").write_text(prompt)
            if "broken" in prompt:
                raise RuntimeError("no")
            return f" Answer to {prompt.split(chr(10))[2]} "
        return call
    return make


def test_every_claim_gets_the_answer_to_its_own_text(spark, tmp_path):
    rows = [(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "broken"), (6, "busy"), (None, "two"), (1, "one")]
    df = spark.createDataFrame(rows, "claim_id bigint, claim string")
    want = {"one": ("Answer to one", 1), "two": ("Answer to two", 1), None: ("Answer to", 1), "broken": (ANSWER_ERROR, 1), "busy": ("Answer to busy", 2)}
    expected = sorted(((k, *want[t]) for k, t in rows), key=str)
    plain, logged, log = tmp_path / "plain", tmp_path / "logged", f"file:{tmp_path}/log"
    plain.mkdir(), logged.mkdir()
    shown = lambda out: sorted(((r["claim_id"], r["prediction_raw"], r["attempts"]) for r in out.collect()), key=str)
    calm = {"clock": _no_clock, "sleep": _no_sleep, "pause": 0.0}
    assert shown(external.score_external(df, _service(plain), parallel_calls=1, **calm)) == expected
    assert len(list(plain.glob("*-*"))) == 8
    assert shown(external.score_logged(df, _service(logged), log, tasks=3, **calm)) == expected
    assert len(list(logged.glob("*-*"))) == 5  # one call for each text
    assert shown(external.score_logged(df, _service(logged), log, tasks=2, **calm)) == expected
    assert len(list(logged.glob("*-*"))) == 6  # only the error is asked again
    assert external.score_logged(df.limit(0), _service(logged), log, **calm).count() == 0


def _no_clock():
    return 0.0


def _no_sleep(seconds):
    return None


def test_no_answered_call_is_repeated_after_a_failure_and_a_budget_holds(spark, tmp_path):
    df = spark.range(40).selectExpr("id AS claim_id", "concat('text number ', id) AS claim")
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    calm = {"clock": _no_clock, "sleep": _no_sleep, "pause": 0.0, "tasks": 2, "every": 7}
    asked = lambda: sorted(f.read_text() for f in calls.iterdir())
    with pytest.raises(Exception, match="lost|SystemExit|Python worker"):
        external.score_logged(df, _service(calls, "number 11"), log, **calm)
    before = asked()
    assert 0 < len(before) < 40
    out = external.score_logged(df, _service(calls), log, budget=3, **calm)
    assert len(asked()) == len(before) + 3 and out.where("prediction_raw IS NULL").count() == 40 - len(before) - 3
    out = external.score_logged(df, _service(calls), log, **calm).collect()
    assert len(asked()) == len(set(asked())) == 40  # each text was asked once
    assert {r["claim_id"]: r["prediction_raw"] for r in out} == {k: f"Answer to text number {k}" for k in range(40)}


def test_a_later_attempt_of_a_task_reads_what_the_first_one_wrote(tmp_path):
    first = external.AnswerFolder(str(tmp_path / "task"), 2)
    for k in range(3):
        first.add({"digest": f"d{k}"})
    assert external.AnswerFolder(str(tmp_path / "task"), 2).known() == {"d0", "d1"}
    first.flush()
    assert external.AnswerFolder(f"file:{tmp_path}/task", 2).known() == {"d0", "d1", "d2"}
