"""Benchmark decontamination by SimHash of item-sized windows (operator 8), DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words; a shingle is five consecutive words (a shorter text: all of them as one). A
window is as many consecutive shingles of a document as a benchmark item has, at any place; a document shorter than the
item is one window. A window and an item are similar if the weighted similarity of their shingles (the sum of the lesser
counts over the sum of the greater) is `similar` or more.

1. Seeds: a similar window lacks so few of an item's shingles that it holds one of any `size - need + 1` of them; the
   rarest are taken. Documents meet items on seeds, at any offset.
2. Windows: of those pairs, every window with as many places in common as similarity asks for, found by a running sum over
   the places' first and last windows; occurrences are never paired with occurrences.
3. SimHash: 64-bit fingerprints of those windows from running sums of bit counts. Windows and their items meet on `radius` + 1
   blocks of a multi-index, which guarantees every pair within `radius` bits, and the Hamming distance is verified.
4. The exact weighted similarity of what is left decides: an occurrence of a shingle counts in the windows in which it is
   among the first as many as the item has, so the common weight is again a running sum.

Steps 1, 2 and 4 lose nothing; step 3 loses pairs beyond the radius (see RADIUS). Shingles are hashed to 64 bits. The seeds,
the items' shingles and the documents that meet any are broadcast only while they are under BROADCAST_ROWS, which is
counted first; beyond, joins are left to Spark. All windows of a document and item are verified; the best is reported.

Defined results: null texts have no words, nor windows, on either side; items without words are ignored; an item of under
five words is similar to texts of just those words only; rows that repeat a doc_id are texts of that document, an item_id's
rows are items of their own under that id; a null doc_id or item_id is kept as null; an empty table gives an empty
result; other columns are ignored. Texts may have up to 2^31 shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .quality_rules import window_hashes, word_array

SHINGLE = 5
#: Similarity as a fraction of integers, so that the border is exact.
SIMILAR = (8, 10)
#: Pairs at the least similarity differ in about 10 of 64 bits; test_recall_of_the_radius measures what lies beyond.
RADIUS = 20
BROADCAST_ROWS = 500_000


def lowered(text: Column) -> Column:
    """Text with A-Z in lower case and all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """The hashes of a text's n-word shingles in order; of all words if they are fewer; none without words."""

    def of(words: Column) -> Column:
        return F.when(F.size(words) >= n, window_hashes(words, n)).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(word_array(text)), of)[0]


#: Bits b and b + 32 of a hash are counted in one sum, 32 bits each.
_LANES = range(32)


def _votes() -> list[Column]:
    return [F.shiftrightunsigned("h", b).bitwiseAND(F.lit(0x100000001).cast("long")) for b in _LANES]


def _fingerprint(total: Column) -> Column:
    """The bits that are set in over half of the hashes."""
    out = F.lit(0).cast("long")
    for b in _LANES:
        for lane in range(2):
            count = F.shiftrightunsigned(f"v{b}", 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
            bit = b + 32 * lane
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(count * 2 > total, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _blocks(radius: int) -> Column:
    """(block, value) of each of radius + 1 blocks of fp."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))))


def _bounded(rows: DataFrame) -> DataFrame:
    """Rows that are counted already (a checkpoint), to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


_DOC = ["_id", "_text_hash"]
_PAIR = [*_DOC, "_item"]


def _seeds(item_counts: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(_item, h): the rarest shingles of each item, one of which every similar window holds."""
    rare = item_counts.join(item_counts.groupBy("h").agg(F.count(F.lit(1)).alias("f")), "h")
    before = F.sum("c").over(Window.partitionBy("_item").orderBy("f", "h").rowsBetween(Window.unboundedPreceding, -1))
    lack = F.col("size") - F.floor((F.col("size") * similar[0] + similar[1] - 1) / F.lit(similar[1]))
    return rare.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") <= lack).select("_item", "h")


def _running(events: DataFrame) -> DataFrame:
    """events (pair, s, delta, ...) with `sum`, of the deltas of the pair at s and before."""
    return events.withColumn("sum", F.sum("delta").over(Window.partitionBy(*_PAIR).orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)))


def _windows(hits: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(pair, size, total, start) of windows with enough hits, from rows (pair, size, n, at)."""
    ends = F.array(F.struct(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1).alias("s"), F.lit(1).alias("delta")), F.struct((F.col("at") + 1).alias("s"), F.lit(-1).alias("delta")))
    events = hits.select(*_PAIR, "size", "n", F.explode(ends).alias("e")).groupBy(*_PAIR, "size", "n", "e.s").agg(F.sum("e.delta").alias("delta"))
    total = F.least("size", "n")
    last = F.least(F.coalesce(F.lead("s").over(Window.partitionBy(*_PAIR).orderBy("s")), F.col("s") + 1) - 1, F.greatest(F.lit(0), F.col("n") - F.col("size")))
    enough = F.col("sum") * (similar[0] + similar[1]) >= (total + F.col("size")) * similar[0]
    ranges = _running(events).withColumn("last", last).filter(enough & (F.col("s") <= F.col("last")))
    return ranges.select(*_PAIR, "size", total.alias("total"), F.explode(F.sequence("s", "last")).alias("start"))


def _window_fingerprints(inside: DataFrame, windows: DataFrame) -> DataFrame:
    """(document, start, total, fp) of distinct windows, from running sums of the votes of the documents' hashes."""
    distinct = windows.select(*_DOC, "start", "total").distinct().checkpoint()
    owners = _bounded(distinct.select(*_DOC).distinct().checkpoint())
    none = F.lit(None).cast("int")
    spots = inside.join(owners, _DOC, "left_semi").select(*_DOC, F.posexplode("hs").alias("at", "h")).select("*", none.alias("start"), none.alias("total"), none.alias("sign"))
    ends = F.array(F.struct((F.col("start") + F.col("total") - 1).alias("at"), F.lit(1).alias("sign")), F.struct((F.col("start") - 1).alias("at"), F.lit(-1).alias("sign")))
    asked = distinct.select(*_DOC, "start", "total", F.explode(ends).alias("e")).select(*_DOC, "e.at", F.lit(None).cast("long").alias("h"), "start", "total", "e.sign")
    # the windows' ends are rows among the hashes, so sums of 32 numbers are made where they are asked for
    so_far = Window.partitionBy(*_DOC).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = spots.unionByName(asked).select(*_DOC, "start", "total", "sign", *(F.sum(v).over(so_far).alias(f"v{b}") for b, v in zip(_LANES, _votes(), strict=True)))
    votes = sums.filter(F.col("start").isNotNull()).groupBy(*_DOC, "start", "total").agg(*(F.sum(F.col(f"v{b}") * F.col("sign")).alias(f"v{b}") for b in _LANES))
    return votes.select(*_DOC, "start", "total", _fingerprint(F.col("total")).alias("fp"))


def _common(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with `common`, the exact common weight, from rows (pair, size, at, h, c) and (pair, start, ...)."""
    placed = hits.groupBy(*_PAIR, "size", "h", "c").agg(F.sort_array(F.collect_list("at")).alias("places")).select("*", F.posexplode("places").alias("j", "at"))
    earlier = F.when(F.col("j") >= F.col("c"), F.try_element_at("places", (F.col("j") - F.col("c") + 1).cast("int"))).otherwise(F.lit(-1))
    first = F.greatest(earlier, F.col("at") - F.col("size")) + 1
    ends = F.array(F.struct(F.greatest(F.lit(0), first).alias("s"), F.lit(1).alias("delta")), F.struct((F.col("at") + 1).alias("s"), F.lit(-1).alias("delta")))
    none = F.lit(None).cast("int")
    events = placed.select(*_PAIR, F.explode(ends).alias("e")).select(*_PAIR, "e.s", "e.delta", none.alias("total"), none.alias("size"))
    asked = windows.select(*_PAIR, F.col("start").alias("s"), F.lit(0).alias("delta"), "total", "size")
    return _running(events.unionByName(asked)).filter(F.col("total").isNotNull()).select(*_PAIR, F.col("s").alias("start"), "total", "size", F.col("sum").alias("common"))


def similar_windows(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """Each window and item that are similar: _id and _text_hash of the document, start, item_id, _item, common and union."""
    C.with_checkpoints(docs.sparkSession)
    keyed = items.select(F.xxhash64("item_id", "text").alias("_item"), F.col("item_id"), shingle_hashes(lowered(F.coalesce("text", F.lit(""))), shingle).alias("hs")).filter(F.size("hs") > 0)
    keyed = keyed.dropDuplicates(["_item"]).checkpoint()
    item_counts = keyed.select("_item", F.size("hs").alias("size"), F.explode("hs").alias("h")).groupBy("_item", "size", "h").agg(F.count(F.lit(1)).cast("int").alias("c")).checkpoint()
    of_items = _bounded(item_counts)

    def hashed(texts: DataFrame) -> DataFrame:
        return texts.select(*_DOC, shingle_hashes(lowered(F.col("_text")), shingle).alias("hs"))

    source = C.texts(docs).withColumn("_text_hash", F.xxhash64("_text"))
    # (1) documents meet items on seeds
    # (explode would have its array computed once more, to leave out rows of none)
    met = hashed(source).select(*_DOC, F.explode_outer("hs").alias("h")).join(_bounded(_seeds(item_counts, similar).checkpoint()), "h")
    pairs = _bounded(met.select(*_PAIR).distinct().checkpoint())
    wanted = _bounded(pairs.select(*_DOC).distinct().checkpoint())
    inside = hashed(source.join(wanted, _DOC, "left_semi")).dropDuplicates(_DOC).checkpoint()
    # (2) windows with as many hits as similarity asks for
    spots = inside.join(pairs, _DOC).select(*_PAIR, F.size("hs").alias("n"), F.posexplode("hs").alias("at", "h"))
    hits = spots.join(of_items, ["_item", "h"]).select(*_PAIR, "size", "n", "at", "h", "c").checkpoint()
    windows = _windows(hits, similar).checkpoint()
    # (3) fingerprints meet on blocks, and lie within the radius
    left = windows.join(_window_fingerprints(inside, windows), [*_DOC, "start", "total"])
    of_item = item_counts.groupBy("_item", "size").agg(*(F.sum(v * F.col("c")).alias(f"v{b}") for b, v in zip(_LANES, _votes(), strict=True)))
    blocks = of_item.select("_item", _fingerprint(F.col("size")).alias("fp")).select("_item", F.col("fp").alias("item_fp"), _blocks(radius).alias("b"))
    met_in_blocks = left.select(*_PAIR, "size", "total", "start", "fp", _blocks(radius).alias("b")).join(blocks, ["_item", "b"])
    close = met_in_blocks.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*_PAIR, "size", "total", "start").distinct()
    # (4) exact weighted similarity of the shingles
    weighed = _common(hits, close).withColumn("union", F.col("total") + F.col("size") - F.col("common"))
    return weighed.filter(F.col("common") * similar[1] >= F.col("union") * similar[0]).join(keyed.select("_item", "item_id"), "_item")


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, common, total, start_word): each document and item that are similar, by their best window.

    The similarity is common / total. Of windows of equal similarity, the first is reported.
    """
    named = similar_windows(docs, items, shingle, similar, radius)
    best = Window.partitionBy("_id", "item_id").orderBy((F.col("common") / F.col("union")).desc(), "start", "_text_hash", "_item")
    top = named.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1")
    return top.select(C.original_id(), "item_id", "common", F.col("union").alias("total"), F.col("start").cast("long").alias("start_word"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text is similar to no item; other texts of the same doc_id, or of none, stay."""
    found = similar_windows(docs, items).select("_id", F.col("_text_hash").alias("_hash")).distinct().checkpoint()
    return C.packed_texts(docs).join(_bounded(found), ["_id", "_hash"], "left_anti").select("_row.*")


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every window of every place that covers a common shingle, its exact similarity, and the best by document and item.
OP8_SQL = """
with dw as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
iw as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from benchmark),
ds as (select doc_id, greatest(1, len(w) - 4) as n, unnest(range(greatest(1, len(w) - 4))) as p, w from dw where len(w) > 0),
d as (select doc_id, n, p, w[p + 1:p + 5] as g from ds),
its as (select item_id, greatest(1, len(w) - 4) as size, unnest(range(greatest(1, len(w) - 4))) as o, w from iw where len(w) > 0),
ic as (select item_id, size, g, count(*) as c from (select item_id, size, w[o + 1:o + 5] as g from its) group by all),
hit as (select d.doc_id, d.n, ic.item_id, ic.size, d.p, d.g, ic.c from d join ic on d.g = ic.g),
place as (select doc_id, n, item_id, size, g, c, unnest(range(greatest(0, p - size + 1), least(p, greatest(0, n - size)) + 1)) as s from hit),
shared as (select doc_id, n, item_id, size, s, least(count(*), c) as k from place group by doc_id, n, item_id, size, s, g, c),
com as (select doc_id, item_id, s, least(size, n) + size as sizes, sum(k) as common from shared group by doc_id, item_id, s, size, n)
select doc_id, item_id, cast(common as bigint) as common, cast(sizes - common as bigint) as total, cast(s as bigint) as start_word from com
where common * 10 >= (sizes - common) * 8
qualify row_number() over (partition by doc_id, item_id order by common / (sizes - common) desc, s) = 1
"""
