"""Calls of outside services that are made once: a stored table of answers by what was asked.

`answered` joins each distinct request with the answers that a folder holds, calls the provider for those that are missing,
and appends what it gets. A second run makes no call; a request that failed is not stored and is tried again by the next run.
Within a task at most `at_once` calls are open, each is tried again after growing pauses, and a provider may have several ways, of
which the next is tried where one refuses a request (`Unsupported`).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow import shared
from inkflow.sources.providers import Unsupported

AT_ONCE, ATTEMPTS, PAUSE = 8, 4, 0.5


def tried(ways: Sequence[Callable], args: tuple, attempts: int, pause: float) -> tuple[object, str | None, int]:
    """(answer, error, calls): the first way that answers, each tried again if it fails, not if it refuses."""
    calls, error = 0, "no way"
    for way in ways:
        for k in range(attempts):
            calls += 1
            try:
                return way(*args), None, calls
            except Unsupported as e:
                error = f"{type(e).__name__}: {e}"[:200]
                break
            except Exception as e:  # noqa: BLE001  one request must not stop the others
                error = f"{type(e).__name__}: {e}"[:200]
                if k + 1 < attempts:
                    time.sleep(pause * 2**k)
    return None, error, calls


def request_id(name: str, *args: Column) -> Column:
    """A digest of a provider's name, with its version if it has one, and of all that it is asked."""
    parts = [F.sha2(F.coalesce(a.cast("binary"), F.lit("").cast("binary")), 256) for a in args]
    return F.sha2(F.concat_ws("\x1f", F.lit(name), *parts, *(a.isNull().cast("string") for a in args)), 256)


def _stored(rows: DataFrame, folder: str, kind: str) -> DataFrame:
    spark = rows.sparkSession
    spark.createDataFrame([], f"request string, answer {kind}").coalesce(1).write.mode("ignore").parquet(f"{folder}/answers/run=none")
    return spark.read.schema(f"request string, answer {kind}, run string").parquet(f"{folder}/answers").select("request", "answer")


def answered(
    rows: DataFrame, args: Sequence[str], ways: Sequence[Callable], kind: str, folder: str, name: str, at_once: int = AT_ONCE, attempts: int = ATTEMPTS, pause: float = PAUSE, tasks: int | None = None,
) -> DataFrame:
    """rows with answer (of the type `kind`) and error, from providers of the columns args.

    tasks: how many tasks call, so that at most tasks * at_once calls are open in all; the session's shuffle partitions unless given.
    """
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumn("_request", request_id(name, *(F.col(a) for a in args)))
    known = _stored(rows, folder, kind)
    asked = named.select(F.col("_request").alias("request"), *args).dropDuplicates(["request"]).join(known, "request", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                got = list(pool.map(lambda own: tried(ways, own, attempts, pause), zip(*(batch[a] for a in args), strict=True)))
                yield pd.DataFrame({"request": batch["request"], "answer": pd.Series([a for a, _, _ in got], dtype=object), "error": pd.Series([e for _, e, _ in got], dtype=object), "calls": [n for _, _, n in got]})

    schema = f"request string, answer {kind}, error string, calls int"
    # written once, so that nothing is asked twice because a later step reads it again
    fresh = shared.written(asked.repartition(tasks, "request").mapInPandas(call, schema), "answers")
    good = fresh.filter(F.col("error").isNull()).select("request", "answer")
    if not good.isEmpty():
        run = shared.new_folder(spark, "run").rpartition("/")[2]
        good.write.mode("overwrite").parquet(f"{folder}/answers/run={run}")
    every = known.select("request", "answer", F.lit(None).cast("string").alias("error")).unionByName(fresh.select("request", "answer", "error")).dropDuplicates(["request"])
    return named.join(every.withColumnRenamed("request", "_request"), "_request", "left").drop("_request")


def embedded(rows: DataFrame, text: str, model: Callable[[str], Sequence[float]], folder: str, name: str, **options) -> DataFrame:
    """rows with embedding and error: each distinct text is embedded once."""
    own = answered(rows, [text], [model], "array<float>", folder, name, **options)
    return own.withColumnRenamed("answer", "embedding")




def read_documents(files: DataFrame, ways: Sequence[Callable[[bytes, str], list[str]]], folder: str, name: str, **options) -> DataFrame:
    """files (content, file_type) with answer, the pages' texts, and error. ways: a service's text detection first, then its
    table analysis, then a local reader; a way that refuses a document leaves it to the next."""
    return answered(files, ["content", "file_type"], ways, "array<string>", folder, name, **options)
