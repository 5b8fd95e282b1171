"""Where models plug in: text generation and entailment. No model comes with this package.

Generation is a small state machine a prompt: it tries, waits, and tries again; a lost connection waits for
the server to answer before the next try, other errors wait a little longer each time. Finished prompts are
kept in a journal as they come, so a task that runs again, or a later run, doesn't ask for them twice.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import text as t, vocab as v
from . import extract, prompts

NLI = "gen_id long, kind string, entailment double, neutral double, contradiction double"


@dataclass(frozen=True)
class Policy:
    """How prompts are tried again: seconds, and numbers of tries. Backends that aren't local are asked once."""

    attempts: int = 3
    wait: float = 5.0  # times the number of tries so far
    restart: float = 15.0  # after a lost connection, before asking whether the server is there
    poll: float = 10.0  # between such questions
    polls: int = 6
    timeout: float = 300.0  # of one request; twice that for models that reason
    retried: tuple[str, ...] = ("ollama",)


@dataclass(frozen=True)
class Request:
    """What a caller is given. reasoning: the model thinks aloud first, so it gets twice the time and context bounds its memory."""

    backend: str
    model: str
    prompt: str
    timeout: float
    reasoning: bool


def reasons(model: str) -> bool:
    return "deepseek-r1" in model or "r1" in model.split(":")[-1]


def is_lost(error: Exception) -> bool:
    """A connection that broke, in contrast to an answer that failed."""
    return isinstance(error, ConnectionError) or "Connection" in str(error) or "Max retries" in str(error)


Call = Callable[[Request], str]
Ping = Callable[[Request], None]


def ask(request: Request, call: Call, ping: Ping | None = None, policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(text, None) or (None, the last error). call returns a text or raises; ping raises while the server is away."""
    state, tried, error = "try", 0, None
    most = policy.attempts if request.backend in policy.retried else 1
    while True:
        if state == "try":
            try:
                return call(request), None
            except Exception as e:  # noqa: BLE001
                error, tried = e, tried + 1
            state = "failed" if tried >= most else "lost" if is_lost(error) else "wait"
        elif state == "wait":
            sleep(policy.wait * tried)
            state = "try"
        elif state == "lost":
            sleep(policy.restart)
            state = "poll" if ping else "try"
        elif state == "poll":
            for _ in range(policy.polls):
                try:
                    ping(request)
                    break
                except Exception:  # noqa: BLE001
                    sleep(policy.poll)
            state = "try"  # whether or not it is back: the try itself tells
        else:
            return None, str(error)


def prompt_key(model: str, prompt: str) -> str:
    return hashlib.sha256(f"{model}\0{prompt}".encode()).hexdigest()


class Journal:
    """Finished prompts of one group of keys: small files of JSON lines, each written whole, in a folder that all executors share."""

    def __init__(self, folder: str, group: int):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.path, self.held = posixpath.join(path, f"{group:05d}"), []
        self.system.create_dir(self.path, recursive=True)

    def known(self) -> dict[str, tuple[str, float]]:
        """Text and latency by key."""
        out = {}
        for info in self.system.get_file_info(fs.FileSelector(self.path)):
            if info.path.endswith(".jsonl"):
                with self.system.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        x = json.loads(line)
                        out[x["key"]] = x["text"], x["latency_ms"]
        return out

    def keep(self, key: str, text: str, latency_ms: float, every: int) -> None:
        self.held.append(json.dumps({"key": key, "text": text, "latency_ms": latency_ms}))
        if len(self.held) >= every:
            self.flush()

    def flush(self) -> None:
        if self.held:
            name = posixpath.join(self.path, uuid.uuid4().hex)
            with self.system.open_output_stream(f"{name}.part") as f:
                f.write(("\n".join(self.held) + "\n").encode())
            self.system.move(f"{name}.part", f"{name}.jsonl")
            self.held = []


def in_turn(pool: ThreadPoolExecutor, one: Callable, items, at_once: int) -> Iterator[tuple]:
    """(name, one(value)) of (name, value) items in their order, no more than at_once begun and not yet taken."""
    begun: deque = deque()
    for name, value in items:
        begun.append((name, pool.submit(one, value)))
        if len(begun) >= at_once:
            name, done = begun.popleft()
            yield name, done.result()
    for name, done in begun:
        yield name, done.result()


def generate(
    work: DataFrame, call: Call, ping: Ping | None = None, policy: Policy = Policy(), journal: str | None = None, groups: int = 8, at_once: int = 1, keep_every: int = 20,
) -> DataFrame:
    """work (model, prompt, ...) with backend, raw_response, latency_ms, error, question and answer.

    Prompts are dealt by their content into groups; a task asks for at most at_once of its group's at a time, so
    no more than groups * at_once requests run. With a journal (a folder that driver and executors share) every
    keep_every finished prompts are written down; prompts found there, by model and text, aren't asked again.
    Errors are returned, not kept: a later run tries them again. Equal prompts of a group are asked once.
    """
    rows = work.drop("backend", "raw_response", "latency_ms", "error").withColumn("backend", prompts.backend(F.col("model")))
    rows = rows.withColumn("_key", F.sha2(F.concat(F.col("model"), F.lit("\0"), t.text(F.col("prompt"))).cast("binary"), 256))
    group = F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit(groups)).cast("int")
    rows = rows.withColumn("_group", group).repartition(groups, "_group")
    kept = [f for f in rows.schema if f.name not in ("_key", "_group")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, Journal] = {}
        known: dict[int, dict[str, tuple[str, float]]] = {}

        def one(row: tuple) -> tuple[str | None, float, str | None]:
            backend, model, prompt = row
            began = time.time()
            slow = reasons(model)
            text, error = ask(Request(backend, model, prompt, policy.timeout * (1 + slow), slow), call, ping, policy)
            return text, (time.time() - began) * 1000, error

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                columns = {c: batch.column(c).to_pylist() for c in ("backend", "model", "prompt", "_key", "_group")}
                for g in set(columns["_group"]) - set(known):
                    if journal:
                        books[g] = Journal(journal, g)
                    known[g] = books[g].known() if journal else {}
                asked, order = {}, list(zip(*columns.values()))
                for backend, model, prompt, key, g in order:
                    if key not in known[g]:
                        asked.setdefault((g, key), (backend, model, prompt or ""))
                failed = {}
                for (g, key), (text, ms, error) in in_turn(pool, one, asked.items(), at_once):
                    if error is None:
                        known[g][key] = text, ms
                        if journal:
                            books[g].keep(key, text, ms, keep_every)
                    else:
                        failed[key] = ms, error
                got = [(*known[g][key], None) if key in known[g] else (None, *failed[key]) for _, _, _, key, g in order]
                for book in books.values():
                    book.flush()
                more = [pa.array([x for x, _, _ in got], pa.string()), pa.array([x for _, x, _ in got], pa.float64()), pa.array([x for _, _, x in got], pa.string())]
                names = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], [*names, "raw_response", "latency_ms", "error"])

    more = [T.StructField("raw_response", T.StringType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("error", T.StringType())]
    out = rows.mapInArrow(run, T.StructType([*kept, *more]))
    out = out.withColumn("raw_response", extract.strip_think(F.col("raw_response"), F.col("model")))
    qa = extract.extract_qa(F.col("raw_response"))
    return out.withColumn("_qa", qa).select("*", "_qa.question", "_qa.answer").drop("_qa")


def nli_pairs(rows: DataFrame) -> DataFrame:
    """(gen_id, kind, premise, hypothesis) to score: the passage's first words against the answer, and against the question of Apply items."""
    premise = t.first_words(F.col("passage"), v.NLI_WORDS)
    sides = F.array(F.struct(F.lit("answer").alias("kind"), F.col("answer").alias("hypothesis")), F.struct(F.lit("question").alias("kind"), F.col("question").alias("hypothesis")))
    wanted = F.filter(sides, lambda s: ((s["kind"] == "answer") & F.col("level").isin(2, 6)) | ((s["kind"] == "question") & (F.col("level") == 3)))
    return rows.where(t.text(F.col("passage")) != "").select("gen_id", premise.alias("premise"), F.inline(wanted)).where(t.text(F.col("hypothesis")) != "")


Score = Callable[[list[str], list[str]], list[tuple[float, float, float]]]
_loaded: dict[str, Score] = {}


def loaded(model: str, load: Callable[[], Score]) -> Score:
    """In a Python worker: the model of this name, loaded for the worker's first task and kept for its next ones."""
    if model not in _loaded:
        _loaded.clear()  # one at a time
        _loaded[model] = load()
    return _loaded[model]


def _scored(pairs: DataFrame, model: str, load: Callable[[], Score]) -> DataFrame:
    """pair, premise, hypothesis: pair and its scores."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            if len(df):
                score = loaded(model, load)
                got = pd.DataFrame(score(df["premise"].tolist(), df["hypothesis"].tolist()), columns=["entailment", "neutral", "contradiction"], index=df.index)
                yield pd.concat([df[["pair"]], got], axis=1)

    return pairs.mapInPandas(run, "pair string, entailment double, neutral double, contradiction double")


def with_pair(pairs: DataFrame) -> DataFrame:
    """pairs with their address: a hash of premise and hypothesis."""
    side = lambda c: F.sha2(t.text(F.col(c)).cast("binary"), 256)
    return pairs.withColumn("pair", F.sha2(F.concat(side("premise"), side("hypothesis")).cast("binary"), 256))


def score_nli(pairs: DataFrame, load: Callable[[], Score], model: str = "nli", store: str | None = None) -> DataFrame:
    """Scores of pairs (gen_id, kind, premise, hypothesis); every different (premise, hypothesis) is scored once.

    load() gives a scorer, once for each Python worker and model; it takes batches and returns (entailment,
    neutral, contradiction). With a store (a Parquet folder, a partition a model) pairs that it holds aren't
    scored; new scores are added to it before they are read back, so that they survive this job.
    """
    keyed = with_pair(pairs)
    new = keyed.groupBy("pair").agg(F.first(t.text(F.col("premise"))).alias("premise"), F.first(t.text(F.col("hypothesis"))).alias("hypothesis"))
    if store is None:
        found = _scored(new, model, load)
    else:
        old = stored_scores(pairs.sparkSession, store, model)
        (new if old is None else new.join(old.select("pair"), "pair", "left_anti")).transform(_scored, model, load).withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(store)
        found = stored_scores(pairs.sparkSession, store, model)
    return keyed.select("gen_id", "kind", "pair").join(found, "pair").select("gen_id", "kind", "entailment", "neutral", "contradiction")


def stored_scores(spark: SparkSession, store: str, model: str) -> DataFrame | None:
    """One row a pair: jobs that ran side by side may have stored one twice."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema("pair string, entailment double, neutral double, contradiction double, model string").parquet(store).where(F.col("model") == model)
    return rows.groupBy("pair").agg(*(F.max(c).alias(c) for c in ("entailment", "neutral", "contradiction")))
