"""An index of JSON metadata for containment filters: posting lists of (path, value) terms.

Each value of a row's metadata gives one term: the path of keys that leads to it, a mark for every array on the way, and
its type and value; objects and arrays give a term for being there. A row that holds a filter has every term of the
filter, so posting lists give candidates and `json_filter.contains` decides on these alone.

`append` writes two tables to a folder, for all rows or for later ones: postings (bucket, term, key, part), partitioned by
bucket and sorted by term, so that a filter reads its lists' buckets and there the row groups that its terms fall in; and
the rows themselves (key, metadata and whatever columns are kept), partitioned by `part`, so that only parts with candidates are
read. A table of counts tells which of a filter's terms are rare: lists of terms that are far more common than the rarest
are not read, because the exact check decides anyway; and where even the rarest term is in over COMMON of all rows,
the rows are scanned without any list.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from inkflow.functions import json_filter

#: Buckets of posting lists, and parts of the rows.
BUCKETS, PARTS = 64, 64
#: Lists of terms that are more than so many times as common as a filter's rarest term are left out.
RARE = 8
#: The share of all rows from which a list is worth less than a scan.
COMMON = 0.3

#: The term of a row whose metadata could not be taken apart: it is a candidate for every filter.
ANY = "*"
_BETWEEN, _ARRAY = "\x1f", "\x1e"


def _scalar(value) -> str:
    if value is None:
        return "z"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, int | float):
        try:
            return f"n{float(value) + 0.0!r}"
        except OverflowError:
            return "ninf"
    return f"s{value}"


def terms_of(value) -> set[str]:
    """The terms of parsed JSON, or of a filter. Numbers go by their value as doubles, so 1 and 1.0 are one term."""
    out: set[str] = set()
    left = [("", value)]
    while left:
        path, own = left.pop()
        if isinstance(own, Mapping):
            out.add(f"{path}{_BETWEEN}o")
            left += [(f"{path}{_BETWEEN}k{key}", x) for key, x in own.items()]
        elif isinstance(own, list | tuple):
            out.add(f"{path}{_BETWEEN}a")
            left += [(f"{path}{_ARRAY}", x) for x in own]
        else:
            out.add(f"{path}{_BETWEEN}{_scalar(own)}")
    return out


_DECODER = json.JSONDecoder(strict=False)


def text_terms(text: str | None) -> list[str]:
    """The terms of JSON text, sorted; of a text with more after its value, those of the value."""
    if text is None or not text.strip():
        return []
    try:
        return sorted(terms_of(_DECODER.raw_decode(text.strip())[0]))
    except (ValueError, RecursionError):
        return [ANY]


@F.pandas_udf(ArrayType(StringType()))
def _terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        memo = {t: text_terms(t) for t in texts.unique()}
        yield texts.map(memo)


def append(rows: DataFrame, folder: str, key: str = "id", metadata: str = "metadata") -> None:
    """Add rows (a unique key, metadata as JSON text, other columns) to the index in a folder."""
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    placed = rows.withColumn("part", part)
    terms = placed.select(F.col(key).alias("key"), "part", F.explode(_terms(F.col(metadata))).alias("_text"))
    lists = terms.select(F.xxhash64("_text").alias("term"), "key", "part").distinct().withColumn("bucket", F.pmod("term", F.lit(BUCKETS)))
    # sorted within files; a very common term may take several files, as its rows are dealt out by key, too
    dealt = lists.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("bucket", "term", "key")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")
    counts = lists.groupBy("term").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod("term", F.lit(BUCKETS)))
    counts.repartition("bucket").sortWithinPartitions("term").write.mode("append").partitionBy("bucket").parquet(f"{folder}/counts")
    placed.agg(F.count("*").alias("n")).write.mode("append").parquet(f"{folder}/sizes")
    placed.repartition("part").write.mode("append").partitionBy("part").parquet(f"{folder}/rows")


def _hashes(spark: SparkSession, terms: list[str]) -> list[int]:
    """The terms' hashes, by the function that the index was made with."""
    one = spark.range(1).select(*(F.xxhash64(F.lit(t)) for t in terms)).first()
    return list(one)


def _lists(table: DataFrame, hashes: list[int]) -> DataFrame:
    return table.filter(F.col("bucket").isin(sorted({h % BUCKETS for h in hashes})) & F.col("term").isin(hashes))


def plan_of(spark: SparkSession, folder: str, filters) -> list[int] | None:
    """The hashes of the terms whose lists are read for a filter, the rarest first; None: the rows are scanned."""
    own = json_filter.checked(filters)
    if own is None:
        return None
    hashes = _hashes(spark, sorted(terms_of(own)))
    counted = _lists(spark.read.parquet(f"{folder}/counts"), hashes).groupBy("term").agg(F.sum("n").alias("n"))
    known = {r.term: r.n for r in counted.collect()}
    rows = spark.read.parquet(f"{folder}/sizes").agg(F.sum("n")).first()[0] or 0
    by = sorted((known.get(h, 0), h) for h in hashes)
    least = by[0][0]
    if least > COMMON * rows:
        return None
    return [h for n, h in by if n <= RARE * max(1, least)]


def candidates(spark: SparkSession, folder: str, hashes: list[int]) -> DataFrame:
    """key and part of the rows that are in every one of the lists, or that could not be taken apart."""
    always = _hashes(spark, [ANY])[0]
    found = _lists(spark.read.parquet(f"{folder}/postings"), [*hashes, always])
    met = found.groupBy("key", "part").agg(F.count_if(F.col("term") != always).alias("n"), F.bool_or(F.col("term") == always).alias("any"))
    return met.filter(F.col("any") | (F.col("n") == len(set(hashes)))).select("key", "part")


def filtered(spark: SparkSession, folder: str, filters, key: str = "id", metadata: str = "metadata") -> DataFrame:
    """The indexed rows whose metadata holds the filter, as `json_filter.filtered` gives them."""
    rows = spark.read.parquet(f"{folder}/rows")
    hashes = plan_of(spark, folder, filters)
    if hashes is None:
        return json_filter.filtered(rows, filters, metadata).drop("part")
    own = candidates(spark, folder, hashes)
    # at most PARTS numbers
    parts = [r.part for r in own.select("part").distinct().collect()]
    held = rows.filter(F.col("part").isin(parts) if parts else F.lit(False))
    met = held.join(own.select(F.col("key").alias(key), "part"), [key, "part"], "left_semi")
    return json_filter.filtered(met, filters, metadata).select(*(c for c in rows.columns if c != "part"))


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """The index in a new folder: posting lists of many appends in one sorted file a bucket, counts summed."""
    for name in ("postings", "counts", "rows"):
        table = spark.read.parquet(f"{folder}/{name}")
        by = "part" if name == "rows" else "bucket"
        if name == "counts":
            table = table.groupBy("bucket", "term").agg(F.sum("n").alias("n"))
        order = [by, "term"] if name != "rows" else [by]
        table.repartition(by).sortWithinPartitions(*order).write.partitionBy(by).parquet(f"{to}/{name}")
    spark.read.parquet(f"{folder}/sizes").agg(F.sum("n").alias("n")).write.parquet(f"{to}/sizes")


def common_terms(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """The n most common terms' hashes with their counts and places: what filters will scan for."""
    summed = spark.read.parquet(f"{folder}/counts").groupBy("term").agg(F.sum("n").alias("n"))
    return summed.orderBy(F.desc("n"), "term").limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "term")))
