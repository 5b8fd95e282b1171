"""Envelope files: one JSON document a model and mode, written by tasks and put in place by the job.

``gen_<model>_<mode>.json`` holds model, mode, n_generations, timestamp and generations; ``eval_...`` holds
n_evaluated, prompt_pass_rate and evaluations instead. The rows of a document come to one task, sorted, and
are streamed into a file of their own under ``_envelopes/<job>``: a task holds one batch of rows, not the
document. Only when every task has ended does the job move the files to their names, one rename each, so
that a task or job that dies leaves the earlier documents whole; a file of a failed or repeated attempt is
never moved. The folder must be one that driver and executors share (a path or URI that Arrow can open).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.window import Window

from ..functions import text as t
from ..operators import evaluate, prompts
from . import files

#: What a task gets: the document's file name and first fields, each record as JSON, and whether it passed.
ROWS = "file string, head string, record string, passed boolean"


@dataclass
class Written(WriterCommitMessage):
    #: File names and where this task wrote them.
    files: dict[str, str] = field(default_factory=dict)


class EnvelopeWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, kind: str):
        self.folder, self.kind, self.job = folder, kind, uuid.uuid4().hex

    def _where(self) -> tuple[fs.FileSystem, str, str]:
        system, path = fs.FileSystem.from_uri(self.folder)
        return system, path, posixpath.join(path, "_envelopes", self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, own = self._where()
        system.create_dir(own, recursive=True)
        done, out, name, n, n_pass = Written(), None, None, 0, 0

        def close() -> None:
            if out is not None:
                end = {"n_generations": n} if self.kind == "generations" else {"n_evaluated": n, "prompt_pass_rate": n_pass / n if n else 0}
                out.write(("\n], " + json.dumps(end)[1:] + "\n").encode())
                out.close()

        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("file", "head", "record", "passed")]
            for file, head, record, passed in zip(*columns):
                if file != name:
                    close()
                    if file in done.files:
                        raise ValueError(f"the rows of {file} aren't sorted by file")
                    done.files[file] = posixpath.join(own, f"{uuid.uuid4().hex}.json")
                    out, name, n, n_pass = system.open_output_stream(done.files[file]), file, 0, 0
                    out.write((head[:-1] + f', "{self.kind}": [').encode())
                if record is not None:
                    out.write(((",\n" if n else "\n") + record).encode())
                    n, n_pass = n + 1, n_pass + bool(passed)
        close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, folder, own = self._where()
        moves = [(name, at) for m in messages if m for name, at in m.files.items()]
        if len({name for name, _ in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("the rows of one document were in several tasks")
        for name, at in moves:
            system.move(at, posixpath.join(folder, name))
        if moves:
            system.delete_dir(own)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, own = self._where()
        if system.get_file_info(own).type == fs.FileType.Directory:
            system.delete_dir(own)


class Envelopes(DataSource):
    """Spark's format "envelopes": rows of ROWS, clustered and sorted by file; option kind is generations or evaluations."""

    @classmethod
    def name(cls) -> str:
        return "envelopes"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> EnvelopeWriter:
        return EnvelopeWriter(self.options["path"], self.options.get("kind", "generations"))


def _write(spark: SparkSession, rows: DataFrame, order: list[str], folder: str, kind: str) -> None:
    """rows: file, head, record, passed and what orders a document's records."""
    spark.dataSource.register(Envelopes)
    ready = rows.repartition("file").sortWithinPartitions("file", *order).select("file", "head", "record", "passed")
    ready.write.format("envelopes").option("kind", kind).mode("append").save(folder)


def _file(prefix: str) -> Column:
    return F.concat(F.lit(prefix), prompts.safe_name(F.col("model")), F.lit("_"), F.col("mode"), F.lit(".json"))


def _head(now: str) -> Column:
    return F.to_json(F.struct("model", "mode", F.lit(now).alias("timestamp")))


def _record(rows: DataFrame, skip: set[str]) -> Column:
    return F.to_json(F.struct(*(c for c in rows.columns if c not in skip)), {"ignoreNullFields": "false"})


def _now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat()


def write_generations(rows: DataFrame, folder: str) -> None:
    """Adds generations (files.GENERATION) to the documents of their model and mode.

    Earlier records that have no error stay, in their order; of those that repeat a passage, level and mode the
    last one. Earlier errors go, as they are tried again. New records follow, and take the place of earlier
    ones of the same passage, level and mode. Only documents of the models and modes in rows are read and written.
    """
    spark = rows.sparkSession
    own = [x.split()[0] for x in files.GENERATION.split(", ")]
    new = rows.select(*own).withColumn("mode", F.coalesce("mode", F.lit("standard"))).withColumns({"_old": F.lit(0), "_at": F.monotonically_increasing_id()})
    kinds = [tuple(r) for r in new.select(_file("gen_").alias("file")).distinct().collect()]  # a row a model and mode
    there = files.existing(spark, [f"{folder}/{k[0]}" for k in kinds])
    if there:
        old = files.read_generation_files(spark, there).where(F.coalesce("error", F.lit("")) == "")
        new = old.select(*own, F.lit(-1).alias("_old"), F.col("read_order.at").cast("long").alias("_at")).union(new)
    key = ["model", "mode", "passage_id", "level"]
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_old").desc(), F.col("_at").desc()))
    kept = new.withColumn("_last", last).where("_last = 1")
    ready = kept.select(_file("gen_").alias("file"), _head(_now()).alias("head"), _record(kept.select(*own), set()).alias("record"), F.lit(None).cast("boolean").alias("passed"), "_old", "_at")
    _write(spark, ready, ["_old", "_at"], folder, "generations")


def write_evaluations(e: DataFrame, folder: str, order: str = "gen_id") -> None:
    """One document for each model and mode of evaluate.evaluated, in place of the earlier one; pass_rate with four digits. order sorts the records and isn't written if it is the reading order."""
    rows = e.withColumn("pass_rate", t.rounded(F.col("pass_rate")))
    skip = {evaluate.READ_ORDER, "model_safe", "file_mode"}
    record = _record(rows, skip | ({"evaluation_error"}))
    failed = _record(rows, skip)
    ready = rows.select(
        _file("eval_").alias("file"), _head(_now()).alias("head"), F.when(F.col("evaluation_error").isNull(), record).otherwise(failed).alias("record"), F.col("all_passed").alias("passed"), F.col(order).alias("_order"),
    )
    _write(e.sparkSession, ready, ["_order"], folder, "evaluations")
