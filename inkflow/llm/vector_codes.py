"""Vector code compression (operator 12): product codes by integer codebooks.

Components become integers, floor(256 x); a vector is cut into 16 equal consecutive parts, and each part position has a
codebook of up to 64 integer entries, at first those parts of the vectors of the least ids. The codebooks (16 x 64 entries
of a part's length: of fixed size) are broadcast; Arrow batches compute all distances of a part position by norm expansion,
|v|^2 - 2 v c + |c|^2, with an exact int64 matrix product, and take the first least one. In each of the rounds a task sums
the parts of each entry over all its batches, and the sums, at most 1,024 rows a task, are merged by a grouped shuffle;
the driver gets 1,024 rows. Every entry that parts were assigned to becomes the floor of their componentwise mean.

int64 wraps, so a distance that fits is exact. So that the sum over all parts fits, a component whose integer has
more than `bound(length)` in size (2^27 for 64 components: a component of 524,288) counts as not finite.

Defined results: rows without a vector, or with a null or non-finite component, are dropped; so are vectors of another
length than the longest kept one; a longest length that 16 does not divide raises ValueError. With fewer than 64 kept vectors codebooks have
as many entries. Equal vec_ids are ordered by their vectors, null ones come last. Repeated rows each get their row; an empty
table gives an empty result; a null label is a label of its own; a label's errors that do not fit a long sum to null; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256


def bound(length: int) -> int:
    """Integers within it keep the squared distance of two vectors of this length under 2^62."""
    return math.isqrt((1 << 60) // max(1, length))


def _filtered(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """_id, label and _v (double[]) of the rows that count."""
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("_v"))
    most = F.floor(F.sqrt(F.lit(2.0**60) / F.greatest(F.size("_v"), F.lit(1)))) / SCALE
    # not a number compares as greater than any bound
    return rows.filter(F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) <= most)))


def integers(column: pa.Array, length: int) -> np.ndarray:
    """[row, component] of a column of lists without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * float(SCALE)).astype(np.int64).reshape(len(column), length)


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the first of equal ones, and its squared distance: [row, part] both."""
    n, parts = len(vectors), len(books)
    cut = vectors.reshape(n, parts, -1)
    codes, errors = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for j, book in enumerate(books):
        own = np.ascontiguousarray(cut[:, j])
        far = (own * own).sum(1)[:, None] - 2 * (own @ book.T) + (book * book).sum(1)
        codes[:, j] = far.argmin(1)
        errors[:, j] = far[np.arange(n), codes[:, j]]
    return codes, errors


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """part, entry, n and componentwise sums of a task's parts."""
    parts, entries, width = books.shape
    sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        vectors = integers(batch.column("_v"), parts * width)
        codes, _ = assign(vectors, books)
        cut = vectors.reshape(len(vectors), parts, width)
        for j in range(parts):
            np.add.at(sums[j], codes[:, j], cut[:, j])
            counts[j] += np.bincount(codes[:, j], minlength=entries)
    part, entry = np.nonzero(counts)
    columns = [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, errors = assign(integers(batch.column("_v"), books.shape[0] * books.shape[2]), books)
        text = codes.astype(np.uint8).tobytes().hex()
        step = 2 * len(books)
        columns = [batch.column("_id"), batch.column("label"), pa.array([text[k : k + step] for k in range(0, len(text), step)], pa.string()), pa.array(errors.sum(1))]
        yield pa.RecordBatch.from_arrays(columns, ["_id", "label", "code", "error"])


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one more round over all rows."""
    width, shared = books.shape[2], rows.sparkSession.sparkContext.broadcast(books)
    sums = rows.select("_v").mapInArrow(lambda it: _sums(it, shared.value), "part long, entry long, n long, sums array<long>")
    merged = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"_{i}") for i in range(width)))
    out = books.copy()
    for part, entry, n, *total in merged.collect():
        out[part, entry] = [x // n for x in total]
    shared.unpersist()
    return out


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The rows that count (_id, label, _v) and the codebooks, [part, entry, component], fitted to all of them."""
    rows = _filtered(vectors, key, vector, label)
    length = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    if length % PARTS:
        raise ValueError(f"vectors of {length} components cannot be cut into {PARTS} equal parts")
    rows = rows.filter(F.size("_v") == length)
    numbers = F.transform("_v", lambda x: F.floor(x * SCALE))
    first = rows.select("_id", numbers.alias("_v")).orderBy(F.col("_id").asc_nulls_last(), "_v").limit(ENTRIES).collect()
    books = np.array([r._v for r in first], np.int64).reshape(len(first), PARTS, length // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        books = refined(rows, books)
    return rows, books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """_id, label, code and error of rows that `fit` gave (or of others like them)."""
    kind = rows.schema["label"].dataType.simpleString()
    if not books.size and not books.shape[1]:
        return rows.limit(0).select("_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    shared = rows.sparkSession.sparkContext.broadcast(books)
    return rows.mapInArrow(lambda it: _codes(it, shared.value), f"_id long, label {kind}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """codes with `vector`, the components (doubles) that a code stands for."""
    # at most 16 x 64 short arrays: an array literal of fixed size
    table = F.array(*(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in entry)) for entry in book)) for book in books))
    at = [F.conv(F.substring(code, 2 * j + 1, 2), 16, 10).cast("int") for j in range(len(books))]
    return codes.withColumn("vector", F.flatten(F.array(*(table[j][at[j]] for j in range(len(books))))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.with_checkpoints(spark)
    rows, books = fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # a label that very many rows have is summed before the shuffle, and joined by a key that Spark may split
    coded = encode(rows, books).withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))).checkpoint()
    sums = coded.groupBy("_key").agg(F.try_sum("error").alias("label_error")).withColumn("_key", F.reverse("_key"))
    out = coded.withColumn("_key", F.reverse("_key")).join(sums, "_key")
    return out.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    return f"""
a{n} as (select rid, p.j, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.e) as m from p join b{n} b on p.j = b.j group by rid, p.j),
s{n} as (select p.j, m % 64 as e, i, cast(floor(sum(p.x[i]) / count(*)) as bigint) as y from a{n} join p on a{n}.rid = p.rid and a{n}.j = p.j, unnest(range(1, len(p.x) + 1)) u(i) group by p.j, m % 64, i),
b{n + 1} as (select b.j, b.e, coalesce(any_value(s.x), any_value(b.x)) as x from b{n} b left join (select j, e, list(y order by i) as x from s{n} group by j, e) s on b.j = s.j and b.e = s.e group by b.j, b.e),"""


OP12_SQL = f"""
with k as (select *, row_number() over (order by vec_id, v) as rid from (select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
p as (select rid, j, v[j * (len(v) // 16) + 1 : (j + 1) * (len(v) // 16)] as x from k, unnest(range(16)) u(j)),
b0 as (select j, rid - 1 as e, x from p where rid <= 64),{_round_sql(0)}{_round_sql(1)}
a as (select rid, p.j, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.e) as m from p join b2 b on p.j = b.j group by rid, p.j),
c as (select rid, string_agg(printf('%02x', m % 64), '' order by j) as code, cast(sum(m // 64) as bigint) as error from a group by rid)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(y as varchar), ',' order by j, e, i)) from (select j, e, unnest(x) as y, generate_subscripts(x, 1) as i from b2)) as codebooks_sha256
from c join k on c.rid = k.rid
"""
