"""Answers of external services, kept so that nothing is asked twice: not by a retry, not by a second use of the result.

A ledger is a folder. What is asked of a service is first written as its questions (a key: a hash of the service's name,
the kind and all columns of the question), without those that have an answer. The service sees that table, and its answers
are written before anybody uses them, each task's as soon as it is done: Spark's second file committer moves a task's file
in place at once and leaves it there if the job fails later. So a part that failed keeps the answers of its finished tasks,
and the next attempt asks the rest. Only what the failing task itself had asked is lost: questions are dealt to tasks of
`per_task`, and beyond MOST_TASKS of them, whose number must not grow with the questions, to as many larger ones. A part
that is whole also says which of its questions had no answer, and those aren't asked again either.

Defined results: questions that are equal in all columns are one. Answers find their questions by the columns named `on`;
questions of one call that agree in those share their answers. If a question was asked by two writers at once, one part's
answers are taken, the first by name. No questions ask nothing. A question that has a null in a column of `on` is asked,
but no answer finds it.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import external
from .graph import saved, shared_folder

#: Committer that moves a task's file in place when the task is done, not when the job is.
BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
KEY = "_question"
#: Tasks that ask at most. Each is a file, and its report goes to the driver.
MOST_TASKS = 1024
log = logging.getLogger(__name__)


class Ledger:
    """Answers by service, in a folder that all executors share. Without a root it lasts as long as the written tables of
    the session's operators (`graph.release`)."""

    def __init__(self, spark: SparkSession, root: str | None = None, per_task: int = 16):
        self.spark, self.per_task = spark, per_task
        self.root = root.rstrip("/") if root else shared_folder(spark, "ledger")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _table(self, name: str, what: str, schema: str) -> DataFrame:
        """Rows of all parts with the part they are of; none if nothing was written."""
        path = f"{self.root}/{name}/{what}"
        full = f"{schema}, part string" if schema else "part string"
        return self.spark.read.schema(full).parquet(path) if self._exists(path) else self.spark.createDataFrame([], full)

    def ask(self, kind: str, questions: DataFrame, service: external.Service | None, on: Sequence[str], name: str = "default", attempts: int = 1) -> DataFrame:
        """Answers to the questions, old and new, in the schema of their kind. `name` tells services of a kind apart.

        A service that fails is asked again for what has no answer yet, up to `attempts` times, then its error is raised.
        """
        if service is None:
            return external.ask(kind, questions)
        label = F.lit(f"{kind}:{name}")
        key = F.sha2(F.to_json(F.struct(label.alias("s"), *[F.col(c) for c in sorted(questions.columns)]), {"ignoreNullFields": "false"}), 256)
        asked = saved(questions.withColumn(KEY, key).dropDuplicates([KEY]))
        where = f"{kind}/{name}"
        keys = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in on) + f", {KEY} string"
        for attempt in range(1, attempts + 1):
            todo = saved(asked.join(self._answered(where, kind, on, keys), KEY, "left_anti"))
            if (n := todo.count()) == 0:
                break
            part = uuid.uuid4().hex
            todo.select(*on, KEY).write.parquet(f"{self.root}/{where}/questions/part={part}")
            try:
                answers = external.ask(kind, todo.drop(KEY).repartition(min(-(-n // self.per_task), MOST_TASKS)), service)
                answers.write.options(**BY_TASK).parquet(f"{self.root}/{where}/answers/part={part}")
                self.spark.createDataFrame([(True,)], "whole boolean").coalesce(1).write.parquet(f"{self.root}/{where}/whole/part={part}")
            except Exception:
                log.warning("attempt %d of %d to ask %s failed", attempt, attempts, where)
                if attempt == attempts:
                    raise
        of = asked.select(KEY, *on).join(self._first_parts(where, kind, on, keys), KEY)
        got = self._table(where, "answers", external.SCHEMAS[kind])
        return got.join(of.select("part", *on), ["part", *on], "left_semi").select(*external.ask(kind, questions).columns)

    def _places(self, where: str, kind: str, on: Sequence[str], keys: str) -> DataFrame:
        """part and question, perhaps repeated, wherever a question has been answered, or was left without an answer by a part that is whole."""
        put = self._table(where, "questions", keys)
        given = self._table(where, "answers", external.SCHEMAS[kind]).select("part", *on).distinct()
        return put.join(given, ["part", *on], "left_semi").unionByName(put.join(self._table(where, "whole", ""), "part", "left_semi"))

    def _answered(self, where: str, kind: str, on: Sequence[str], keys: str) -> DataFrame:
        return self._places(where, kind, on, keys).select(KEY)

    def _first_parts(self, where: str, kind: str, on: Sequence[str], keys: str) -> DataFrame:
        """Each question with the part that answered it: of several the first by name."""
        return self._places(where, kind, on, keys).groupBy(KEY).agg(F.min("part").alias("part"))
