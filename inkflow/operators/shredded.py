"""Metadata with columns of its own for the keys that filters ask for: files are pruned by them, the rest is a VARIANT.

`shred` parses the JSON text once: each hot key with a scalar becomes a typed column, null where the value has another type, and
the whole becomes a VARIANT column, so no later query parses text. `write` deals rows out by the hot keys, as partitions or
sorted within files, so that statistics of files and row groups tell values apart. `filtered` gives the rows that
`json_filter.filtered` gives: a hot key's condition is a comparison of its column, which reaches the scan, and what is left of the
filter is checked on the VARIANT.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.functions import json_filter

#: Types of hot keys, and what a value must be to go to the column.
KINDS = {"string": r"^STRING$", "double": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$", "boolean": r"^BOOLEAN$"}
#: Integers beyond it are not told apart by doubles, so they are checked on the VARIANT as well.
EXACT = 2**53


def column_of(key: str) -> str:
    return f"meta_{key}"


def shred(rows: DataFrame, hot: Mapping[str, str], metadata: str = "metadata") -> DataFrame:
    """rows with `variant` and a column for each hot key (name to string, double or boolean) in place of the JSON text."""
    for key, kind in hot.items():
        if kind not in KINDS:
            raise ValueError(f"a hot key is string, double or boolean, not {kind} ({key})")
    parsed = rows.withColumn("variant", json_filter.parsed(F.col(metadata)))

    def typed(key: str, kind: str) -> Column:
        own = F.try_variant_get("variant", json_filter.path(key), "variant")
        return F.when(F.schema_of_variant(own).rlike(KINDS[kind]), F.try_variant_get(own, "$", kind)).alias(column_of(key))

    return parsed.select(*(c for c in rows.columns if c != metadata), "variant", *(typed(k, t) for k, t in hot.items()))


def write(rows: DataFrame, hot: Mapping[str, str], folder: str, partitions: Sequence[str] = (), metadata: str = "metadata", files: int | None = None) -> None:
    """Shred rows and append them to a folder: a folder for each value of the hot keys in `partitions` (few values), files sorted by the others.

    A value that very many rows have is dealt out over several files by a second key."""
    own = shred(rows, hot, metadata)
    others = [column_of(k) for k in hot if k not in partitions]
    if others:
        # ranges of the sorted keys, so that a file holds few of their values
        own = own.repartitionByRange(files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *others, F.rand(7)).sortWithinPartitions(*others)
    writer = own.write.mode("append")
    (writer.partitionBy(*map(column_of, partitions)) if partitions else writer).parquet(folder)


def condition(filters, hot: Mapping[str, str]) -> Column | None:
    """A filter on shredded rows; None for an empty one."""
    own = json_filter.checked(filters)
    if own is None:
        return None
    out, rest = F.col("variant").isNotNull(), {}
    for key, value in own.items():
        kind = hot.get(key)
        fits = {"string": isinstance(value, str), "boolean": isinstance(value, bool), "double": isinstance(value, int | float) and not isinstance(value, bool)}.get(kind, False)
        if fits:
            out = out & (F.col(column_of(key)) == F.lit(float(value) if kind == "double" else value))
        if not fits or kind == "double" and abs(value) > EXACT:
            rest[key] = value
    return out & json_filter.contains(F.col("variant"), rest) if rest else out


def filtered(rows: DataFrame, filters, hot: Mapping[str, str]) -> DataFrame:
    """The shredded rows whose metadata holds the filter; all rows for an empty filter."""
    own = condition(filters, hot)
    return rows if own is None else rows.filter(own)
