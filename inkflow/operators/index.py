"""Indexes over chunks: an inverted index of lexemes, and codes or hashes of vectors.

All are tables to write beside the chunks. The inverted index prunes a lexical query to the chunks that hold a term; codes
(or locality-sensitive hashes) give candidates for the nearest vectors; scores are exact in all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkflow.functions import vectors
from inkflow.operators import retrieval


#: Rows of a batch whose places are sorted at once.
PLACED = 500


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, term, positions) from (key, lex): the places of each term of each row."""
    for whole in batches:
        for start in range(0, whole.num_rows, PLACED):
            batch = whole.slice(start, PLACED)
            lists = batch.column("lex")
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            coded = lists.flatten().dictionary_encode(null_encoding="encode")
            if not len(coded):
                continue
            row, code = np.repeat(np.arange(len(lengths)), lengths), coded.indices.to_numpy().astype(np.int64)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            named = row * len(coded.dictionary) + code
            # a stable sort keeps places ascending
            order = np.argsort(named, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(named[order]) != 0))
            first, ends = order[starts], np.append(starts, len(order)).astype(np.int32)
            terms = coded.dictionary.take(pa.array(code[first]))
            positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order]))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row[first])), terms, positions], ["key", "term", "positions"])


def inverted_index(chunks: DataFrame, key: str = "id", lex: str = "content_lex") -> DataFrame:
    """term, key, positions (ascending, from 0), tf: one row for each term of a chunk.

    A chunk's places are found in its own row and nothing is shuffled but keys, to see whether any is of two rows; only then
    are places grouped by term and key."""
    if chunks.groupBy(key).count().filter("count > 1").isEmpty():
        own = chunks.select(F.col(key).alias("key"), F.col(lex).alias("lex"))
        placed = own.mapInArrow(_placed, f"key {dict(own.dtypes)['key']}, term string, positions array<int>")
        return placed.select("term", F.col("key").alias(key), "positions", F.size("positions").alias("tf"))
    placed = chunks.select(key, F.posexplode(lex).alias("position", "term"))
    return placed.groupBy("term", key).agg(F.array_sort(F.collect_list("position")).alias("positions")).withColumn("tf", F.size("positions"))


def matching(index: DataFrame, terms: Sequence[str], key: str = "id", every: bool = True) -> DataFrame:
    """key and tf (summed) of the chunks that hold every term, or any."""
    own = list(dict.fromkeys(terms))
    found = index.filter(F.col("term").isin(own)).groupBy(key).agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("_n"))
    return (found.filter(F.col("_n") == len(own)) if every else found).drop("_n")


def fit_lsh(chunks: DataFrame, embedding: str = "embedding", bucket: float = 1.0, tables: int = 12, seed: int = 7) -> BucketedRandomProjectionLSHModel:
    """Random projections for Euclidean distance; the vectors themselves are not needed to fit them, only their length."""
    sample = chunks.select(array_to_vector(F.col(embedding).cast("array<double>")).alias("_v")).limit(1)
    return BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(sample)


def near(chunks: DataFrame, model: BucketedRandomProjectionLSHModel, query: Sequence[float], k: int, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """key and distance of the k nearest of the chunks that share a bucket with the query; if too few do, the nearest others follow.

    Buckets prune only where vectors lie in clusters; `near_by_code` is for those that don't.
    """
    one = model.transform(chunks.sparkSession.createDataFrame([(Vectors.dense(list(query)),)], ["_v"])).first()
    hashed = model.transform(chunks.withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>"))))
    met = F.lit(False)
    for t, h in enumerate(one["_h"]):
        met = met | (vector_to_array(F.col("_h")[t])[0] == float(h[0]))
    scored = hashed.select(key, met.alias("_met"), vectors.l2_distance(F.col(embedding), vectors.literal(query)).alias("distance"))
    return scored.orderBy(F.desc("_met"), "distance", key).limit(k).drop("_met").orderBy("distance", key)


def quantised(chunks: DataFrame, embedding: str = "embedding") -> DataFrame:
    """chunks with `code` (each value in 255 steps of the vector's largest) and `step`; write them beside the embeddings.

    A null vector has a null code; a vector of zeros has step 0.
    """
    values = F.col(embedding)
    step = (F.array_max(F.transform(values, F.abs)) / 127).cast("float")
    with_step = chunks.withColumn("step", step)
    return with_step.withColumn("code", F.transform(values, lambda x: F.when(F.col("step") > 0, F.round(x / F.col("step"))).otherwise(0).cast("tinyint")))


def near_by_code(coded: DataFrame, query: Sequence[float], k: int, widened: int = 8, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """key and distance of the k nearest (L2): candidates by codes, then exact distances of these.

    The scan for candidates reads codes only, a fourth of the vectors' bytes or less; of each partition k * widened rows
    survive. That bounds the side that is broadcast, and the embeddings of the candidates are read by key.
    """
    about = vectors.l2_distance(F.transform("code", lambda c: c.cast("double") * F.col("step")), vectors.literal(query))
    candidates = coded.select(key, about.alias("_about")).filter("_about is not null").orderBy("_about", key).limit(k * widened).select(key)
    exact = coded.select(key, embedding).join(F.broadcast(candidates), key)
    return exact.select(key, vectors.l2_distance(F.col(embedding), vectors.literal(query)).alias("distance")).orderBy("distance", key).limit(k)


def near_by_code_many(coded: DataFrame, queries: DataFrame, k: int, widened: int = 8, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """query_id, key and distance of the k nearest (L2) of each row (query_id, embedding) of queries.

    Codes give k * widened candidates a query; their embeddings come by a join, and the k best are kept.
    """
    rough = coded.select(key, F.transform("code", lambda c: c.cast("float") * F.col("step")).alias(embedding))
    candidates = retrieval.vector_search_many(rough, queries, k * widened, "l2", key=key, embedding=embedding).select("query_id", key)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(embedding).alias("_q"))
    both = candidates.join(coded.select(key, F.col(embedding).alias("_v")), key).join(asked, "query_id")
    scored = both.select("query_id", key, vectors.l2_distance(F.col("_v"), F.col("_q")).alias("distance"))
    best = Window.partitionBy("query_id").orderBy("distance", key)
    return scored.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")
