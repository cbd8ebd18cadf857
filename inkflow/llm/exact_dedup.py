"""Exact dedup by a stateful stream (operator 13).

Texts are equal when they are identical after white space is deleted. `update` streams the files of a folder that it has
not seen yet through a keyed aggregate whose state lives on disk (RocksDB, written to the shared folder) and never
expires. For each digest the state retains how many rows had it, and of the row that stays its stable identifier (length,
doc_id) and its content locator (file, row in the file); texts are not held. What a batch changes is appended as one
folder a batch, which a repeated batch overwrites, so a batch that is run again counts once.

A digest that was met again is a hit, and a hit is only a duplicate if its bytes are: `differing` reads the full text at
each hit's locator and compares every distinct text of that digest with it. Digests with different texts are classed by
digest and full text instead (`exact_dedup`), so results are exact for any digest. Everything is DataFrame and SQL
functions. Distinct texts of a hit are aggregated before they are shuffled, so a group that holds a third of all rows
sends one text a task; digests of hits are broadcast while they number at most BROADCAST_ROWS, which is counted first, and
joined by a shuffle beyond.

Defined results: null counts as empty; empty and blank texts are one group; a null doc_id comes after all others and is
null as keep_id; of rows with one length and doc_id the first by file and row stays; rows that repeat a doc_id each get
their row; an empty table gives an empty result; other columns are not read, whatever their names; very long texts are
digested whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .warc import shared_folder

#: Hits whose digests and locators are broadcast at most (about 40 MB).
BROADCAST_ROWS = 200_000
#: Bytes of files that one batch of the stream takes.
BATCH_BYTES = 256 << 30

_STATE = "key string, n long, best struct<less_chars:long,id:long,file:string,row:long>"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame, digest=sha256) -> DataFrame:
    """key, text (normalised), text_sha256, and place: length (negative), id and locator of each row of a file source."""
    at = docs.metadataColumn("_metadata")
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.struct((-F.length(text)).cast("long").alias("less_chars"), F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID)).alias("id"), at["file_path"].alias("file"), at["row_index"].alias("row"))
    rows = docs.select(F.regexp_replace(text, C.NOT_WORD, "").alias("text"), place.alias("place"))
    return rows.select(F.coalesce(digest(F.col("text")), F.lit("")).alias("key"), "text", F.sha2("text", 256).alias("text_sha256"), "place")


_COLUMNS = "doc_id long, text string"


def _documents(spark: SparkSession, path: str, digest) -> DataFrame:
    return located(spark.read.schema(_COLUMNS).parquet(path), digest)


def update(spark: SparkSession, path: str, folder: str, digest=sha256, batch_bytes: int = BATCH_BYTES) -> int:
    """Take the files of `path` that `folder` has not seen into its state and its table of changes; the number of rows read."""
    C.with_checkpoints(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    # all stores of an executor share one bounded memory; what does not fit is read from disk
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    # files grow as they are written; space set aside would be 4 MB for each of the stores, however little it holds
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    spark.createDataFrame([], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")
    # a stream's path is a folder or a pattern: the pattern matches a single file, or a folder, of just this name
    arriving = own.readStream.schema(_COLUMNS).option("maxBytesPerTrigger", batch_bytes).parquet(f"{path[:-1]}[{path[-1]}]")
    state = located(arriving, digest).groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("best"))
    query = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .foreachBatch(lambda changed, k: changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={k}"))
        .start()
    )
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """key, n and best of each digest after the last batch."""
    changes = spark.read.schema(f"{_STATE}, batch long").parquet(f"{folder}/changes")
    return changes.groupBy("key").agg(F.max_by(F.struct("n", "best"), "batch").alias("_last")).select("key", "_last.n", "_last.best")


def differing(texts: DataFrame, known: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The keys of hits whose full texts are not all equal to the text at the key's locator."""
    hits = known.filter("n > 1").select("key", F.col("best.file").alias("_file"), F.col("best.row").alias("_row"))
    if hits.count() <= broadcast_rows:
        hits = F.broadcast(hits)
    met = texts.join(hits, "key").withColumn("_held", (F.col("place.file") == F.col("_file")) & (F.col("place.row") == F.col("_row")))
    held = met.filter("_held").select("key", F.col("text").alias("_content"))
    arrived = met.filter(~F.col("_held")).select("key", "text").distinct()
    return arrived.join(held, "key").filter(F.col("text") != F.col("_content")).select("key").distinct()


def exact_dedup(spark: SparkSession, path: str, folder: str, digest=sha256, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document of `path`, all of which `update` has taken into `folder`."""
    docs, known = _documents(spark, path, digest), index(spark, folder)
    unlike = differing(docs, known, broadcast_rows).checkpoint()
    # joined by another key than the one that classes are grouped by, so that Spark may split a digest that very many rows have
    rows, classes = docs.drop("text").withColumn("_key", F.reverse("key")), known.select(F.reverse("key").alias("_key"), "n", "best")
    if unlike.isEmpty():
        joined = rows.join(classes, "_key")
    else:
        apart = docs.join(unlike, "key").withColumn("_key", F.concat("key", F.lit(" "), "text"))
        named = apart.groupBy("_key").agg(F.count("*").alias("n"), F.min("place").alias("best"))
        joined = rows.join(unlike, "key", "left_anti").join(classes, "_key").unionByName(apart.drop("text").join(named, "_key"))
    return joined.select(
        F.when(F.col("place.id") != C.NO_ID, F.col("place.id")).alias("doc_id"), F.when(F.col("best.id") != C.NO_ID, F.col("best.id")).alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("place") == F.col("best")).alias("kept"), "text_sha256", F.col("place.file").alias("file"), F.col("place.row").alias("row"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = f"{sf_dir}/documents.parquet", shared_folder(spark, "exact")
    update(spark, path, folder)
    return exact_dedup(spark, path, folder).drop("file", "row")


OP13_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as t from documents),
b as (select *, row_number() over (partition by t order by n desc, doc_id nulls last) as place from d)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, place = 1 as kept, sha256(t) as text_sha256
from b window w as (partition by t order by place)
"""
