"""Scoring by an external service: the one operator that has to call Python per claim."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.fixed_values import ANSWER_ERROR, ANSWER_QUOTA, MAX_ATTEMPTS, WAIT_STEP_SECONDS
from claimsift.functions.answers import build_prompt
from claimsift.operators.sampling import sample_n
from claimsift.schemas import EXTERNAL_ANSWERS
from claimsift.session import materialise

# What marks a quota error in the message of an exception.
QUOTA_MARKS = ("429", "RESOURCE_EXHAUSTED")

Client = Callable[[str], str | None]
ANSWERED, BUSY, BROKEN = "answered", "busy", "broken"
LOGGED = "digest string, prediction_raw string, latency_sec double, attempts int, at double"


def outcome(client: Client, prompt: str) -> tuple[str, str]:
    """What one call came to, and the text that stands for it; the service decides what it raises."""
    try:
        reply = client(prompt)
    except Exception as error:
        busy = any(mark in str(error) for mark in QUOTA_MARKS)
        return (BUSY, ANSWER_QUOTA) if busy else (BROKEN, ANSWER_ERROR)
    return (ANSWERED, reply.strip()) if reply else (BROKEN, ANSWER_ERROR)


def ask(
    client: Client, prompt: str, clock: Callable[[], float], sleep: Callable[[float], None],
    attempts: int = MAX_ATTEMPTS, step: float = WAIT_STEP_SECONDS,
) -> tuple[str, float, int]:
    """(text, seconds, calls) of one claim: a busy service is waited for, longer by ``step`` each time and after the last call too."""
    start, text, calls = clock(), ANSWER_QUOTA, 0
    for calls in range(1, attempts + 1):
        kind, text = outcome(client, prompt)
        if kind != BUSY:
            break
        sleep(step * calls)
    return text, clock() - start, calls


def score_external(
    claims: DataFrame, make_client: Callable[[], Client],
    clock: Callable[[], float] = time.perf_counter, sleep: Callable[[float], None] = time.sleep,
    pause: float = 0.05, parallel_calls: int | None = None, text: str = "claim",
) -> DataFrame:
    """(claim_id, prediction_raw, latency_sec, attempts).

    ``make_client`` runs once per task.  ``parallel_calls`` partitions bound the call rate.  Write the
    result before using it twice: a lost task, or a second action, calls the service again.
    ``score_logged`` does not.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for claim_id, prompt in zip(batch["claim_id"], batch["prompt"], strict=True):
                rows.append((claim_id, *ask(client, prompt, clock, sleep)))
                if pause:
                    sleep(pause)
            yield pd.DataFrame(rows, columns=EXTERNAL_ANSWERS.names)

    asked = claims.select("claim_id", build_prompt(F.coalesce(text, F.lit(""))).alias("prompt"))
    if parallel_calls:
        asked = asked.repartition(parallel_calls, "claim_id")
    return asked.mapInPandas(run, EXTERNAL_ANSWERS)


class AnswerFolder:
    """The answers of one task: a file of JSON lines for every ``every`` of them, read again by a later attempt of the task."""

    def __init__(self, folder: str, every: int):
        uri = f"file://{folder}" if folder.startswith("/") else re.sub("^file:/+", "file:///", folder)
        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.path)
        self.every, self.held = every, []

    def known(self) -> set[str]:
        found = self.files.get_file_info(fs.FileSelector(self.path))
        lines = [line for f in found if f.path.endswith(".json") for line in self.files.open_input_stream(f.path).read().splitlines()]
        return {json.loads(line)["digest"] for line in lines}

    def add(self, row: dict) -> None:
        self.held.append(json.dumps(row))
        if len(self.held) >= self.every:
            self.flush()

    def flush(self) -> None:
        """A file gets its name once it is whole: readers pass over names that start with a dot."""
        if not self.held:
            return
        name = uuid.uuid4().hex
        with self.files.open_output_stream(f"{self.path}/.{name}") as out:
            out.write(("\n".join(self.held) + "\n").encode())
        self.files.move(f"{self.path}/.{name}", f"{self.path}/{name}.json")
        self.held = []


def read_answers(spark: SparkSession, log: str) -> DataFrame:
    """One row per prompt of the log: an answer if there is one, else what the last call came to."""
    try:
        rows = spark.read.schema(LOGGED).option("recursiveFileLookup", "true").json(log)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], LOGGED)
    good = ~F.col("prediction_raw").isin(ANSWER_ERROR, ANSWER_QUOTA)
    last = F.max_by(F.struct("prediction_raw", "latency_sec", "attempts"), F.struct(good, "at")).alias("last")
    return rows.groupBy("digest").agg(last).select("digest", "last.*")


def score_logged(
    claims: DataFrame, make_client: Callable[[], Client], log: str, budget: int | None = None, tasks: int = 8, every: int = 1,
    clock: Callable[[], float] = time.perf_counter, sleep: Callable[[float], None] = time.sleep, pause: float = 0.05, text: str = "claim",
) -> DataFrame:
    """(claim_id, prediction_raw, latency_sec, attempts) for every claim, from a log of answers that outlives tasks and jobs.

    Prompts are told by their digest: equal ones are asked once, those the log answers are not asked, and an error in
    the log is asked again by the next run.  A task writes its answers as it gets them, ``every`` of them a
    file, and a later attempt of it reads them before it calls; a killed task loses fewer than ``every`` answers,
    one that fails loses none.  ``budget`` is the number of prompts that all tasks together may ask, the first in
    hash order; claims that are left have null in the other columns until a later run.  Repeated rows
    stay; a missing text is an empty one.  ``log`` is a folder that every executor reaches, as is ``spark.checkpoint.dir``;
    one run uses it at a time, without speculative tasks.
    """
    spark = claims.sparkSession
    prompt = build_prompt(F.coalesce(text, F.lit("")))
    keys = materialise(claims.select("claim_id", F.sha2(prompt, 256).alias("digest")), "prompt-digests")
    done = read_answers(spark, log).where(~F.col("prediction_raw").isin(ANSWER_ERROR, ANSWER_QUOTA)).select("digest")
    left = materialise(keys.select("digest").distinct().join(done, "digest", "left_anti"), "open-prompts")
    if budget is not None:
        left = materialise(sample_n(left, budget, "digest"), "open-prompts")
    prompts = claims.select(F.sha2(prompt, 256).alias("digest"), F.col(text).alias("text")).join(left, "digest", "left_semi")
    prompts = materialise(prompts.groupBy("digest").agg(F.first("text").alias("text")).repartition(tasks, "digest"), "prompts")
    asked = prompts.select("digest", build_prompt(F.coalesce("text", F.lit(""))).alias("prompt")).repartition(tasks, "digest")
    run_log = f"{log}/{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, folder = make_client(), AnswerFolder(f"{run_log}-{TaskContext.get().partitionId()}", every)
        known = folder.known()
        try:
            for batch in batches:
                for digest, words in zip(batch["digest"], batch["prompt"], strict=True):
                    if digest in known:
                        continue
                    reply, seconds, calls = ask(client, words, clock, sleep)
                    folder.add({"digest": digest, "prediction_raw": reply, "latency_sec": seconds, "attempts": calls, "at": time.time()})
                    if pause:
                        sleep(pause)
                yield batch[["digest"]]
        finally:
            folder.flush()

    asked.mapInPandas(run, "digest string").write.format("noop").mode("overwrite").save()
    return keys.join(read_answers(spark, log), "digest", "left").select(*EXTERNAL_ANSWERS.names)
