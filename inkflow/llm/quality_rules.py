"""Quality rules as a bitmask ledger (operator 3), DataFrame functions only.

Every rule is evaluated once over the measurements of a text; its failure is one bit of `failed`. A policy is a named,
versioned set of rules, so a verdict is `failed & mask = 0`; ablations count, in one bitwise aggregation, what each rule
decides alone and what a policy would keep without it. The ledger is stored once, and policies and ablations read it.
Nothing but counts of bit patterns is shuffled: every measurement comes from its own row.

Defined results: a null text is measured as empty (no words, so it fails the base); empty and white-space texts too;
rows that repeat a doc_id each get their row; an empty table gives an empty result; other columns are ignored by
quality_ledger and kept by apply_policy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words in a window for repeated words.
REPEAT_WINDOW = 8
#: Characters of words that are neither letters nor outside ASCII.
NON_LETTERS = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, C.NOT_WORD), "")


def window_hashes(words: Column, n: int) -> Column:
    """A 64-bit hash of each n consecutive words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def _covered(places: Column, n: int) -> Column:
    """How many places the windows of n that start at these ascending places cover."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("to")),
        lambda a, p: F.struct((a["sum"] + p + n - F.greatest(a["to"], p)).alias("sum"), (p + n).alias("to")),
        lambda a: a["sum"],
    )


def repeated_words(words: Column, n: int = REPEAT_WINDOW) -> Column:
    """Words in n-word windows that occur twice or more in the text, the first occurrence included."""

    def places(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        last = F.size(hashes) - 1
        twice = let(placed, lambda s: F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"]))))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    return let(window_hashes(words, n), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(places(h), n)))


def measures(text: Column) -> Column:
    """The measurements of a text, a struct of longs."""

    def long(x: Column, name: str) -> Column:
        return x.cast("long").alias(name)

    words = let(word_array(text), lambda w: F.struct(long(F.size(w), "n"), long(F.length(F.array_join(w, "")), "chars"), long(F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)), "longest"), repeated_words(w).alias("repeats")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(C.WORD)), lambda x: F.struct(long(F.size(x) - F.size(F.array_distinct(x)), "dup"), long(F.size(x), "n")))
    return let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"),
            m["w"]["chars"].alias("word_chars"),
            long(F.regexp_count(text, F.lit("[#*$%&|<>]")), "n_symbols"),
            m["l"]["dup"].alias("n_dup_lines"),
            m["l"]["n"].alias("n_lines"),
            m["w"]["repeats"].alias("n_repeat_words"),
            long(F.regexp_count(text, F.lit(NON_LETTERS)), "n_non_letters"),
            m["w"]["longest"].alias("longest_word"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """A failure as a condition on measurements; `bit` never changes once it is in a ledger."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


#: Integer arithmetic only, so that a verdict never hangs on rounding.
RULES = (
    Rule(0, "too_few_words", lambda m: m["n_words"] < 20),
    Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule(2, "symbol_heavy", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule(3, "duplicate_lines", lambda m: (m["n_lines"] >= 4) & (10 * m["n_dup_lines"] > 6 * m["n_lines"])),
    Rule(4, "short_words", lambda m: (m["n_words"] >= 20) & (m["word_chars"] < 2 * m["n_words"])),
    Rule(5, "long_words", lambda m: (m["n_words"] >= 20) & (m["word_chars"] > 20 * m["n_words"])),
    Rule(6, "few_letters", lambda m: (m["n_words"] >= 20) & (2 * m["n_non_letters"] > m["word_chars"])),
    Rule(7, "one_long_word", lambda m: (m["n_words"] >= 20) & (2 * m["longest_word"] > m["word_chars"])),
)

#: Policies by name and version. A new version is a new entry; ledgers need not be written again.
POLICIES = {
    ("base", 1): ("too_few_words", "repeated_words"),
    ("web", 1): ("too_few_words", "repeated_words", "symbol_heavy", "duplicate_lines"),
    ("web", 2): ("too_few_words", "repeated_words", "symbol_heavy", "duplicate_lines", "short_words", "long_words", "few_letters", "one_long_word"),
}


def mask_of(names, rules=RULES) -> int:
    by = {r.name: r.bit for r in rules}
    return sum(1 << by[n] for n in names)


def failed_bits(m: Column, rules=RULES) -> Column:
    """Bit r.bit is set where rule r fails on the measurements m."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(m), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def quality_ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measurements, and `failed`: one row for each row of docs."""
    measured = C.texts(docs).select("_id", measures(F.col("_text")).alias("_m"))
    return measured.select(C.original_id(), "_m.*", failed_bits(F.col("_m"), rules).alias("failed"))


def passes(failed: Column, policy=("web", 2)) -> Column:
    return failed.bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablations(ledger: DataFrame, policy=("web", 2), rules=RULES) -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and are kept without it.

    Documents are counted by the bits of the policy that they fail, and rules are held against those patterns.
    """
    mask = mask_of(POLICIES[policy])
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bad")).agg(F.count(F.lit(1)).alias("n"))

    def number(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    def of(r: Rule) -> Column:
        bit = F.lit(1 << r.bit).cast("long")
        counts = (number(F.col("bad").bitwiseAND(bit) != 0, "n_failed"), number(F.col("bad") == bit, "n_failed_alone"), number((F.col("bad") == bit) | (F.col("bad") == 0), "n_kept_without"))
        return F.struct(F.lit(r.name).alias("rule"), *counts)

    return patterns.agg(F.array(*(of(r) for r in rules if mask >> r.bit & 1)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def stored_ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """quality_ledger, written once to the shared checkpoint folder: policies and ablations read it from there."""
    C.with_checkpoints(docs.sparkSession)
    return quality_ledger(docs, rules).checkpoint()


def apply_policy(docs: DataFrame, policy=("web", 2), rules=RULES) -> DataFrame:
    """The rows of docs, all columns, that a policy keeps; each row is judged by its own text."""
    failed = let(measures(F.coalesce(F.col("text"), F.lit(""))), lambda m: failed_bits(m, rules))
    return docs.filter(passes(failed, policy))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    ledger = stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(F.col("failed"), ("base", 1))).alias("base_failed"), passes(F.col("failed")).alias("kept"), "failed",
    )


#: Which rules decided, over the whole table.
def op3b_rule_ablations(spark, sf_dir: str) -> DataFrame:
    return ablations(stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_W = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
_LEDGER_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_W} as w, {_LINES} as l from documents),
win as (select r, i, w[i:i + 7] as g from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
cov as (select r, sum(least(8, coalesce(nxt - i, 8))) as n from (select r, i, lead(i) over (partition by r order by i) as nxt from rep) group by r),
m as (select d.r, doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
  cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, len(regexp_extract_all(text, '[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]')) as n_non_letters, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) as longest_word
  from d left join cov on d.r = cov.r),
led as (select *, (case when n_words < 20 then 1 else 0 end) + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
  + (case when 10 * n_symbols > 3 * n_words then 4 else 0 end) + (case when n_lines >= 4 and 10 * n_dup_lines > 6 * n_lines then 8 else 0 end)
  + (case when n_words >= 20 and word_chars < 2 * n_words then 16 else 0 end) + (case when n_words >= 20 and word_chars > 20 * n_words then 32 else 0 end)
  + (case when n_words >= 20 and 2 * n_non_letters > word_chars then 64 else 0 end) + (case when n_words >= 20 and 2 * longest_word > word_chars then 128 else 0 end) as failed from m)
"""
OP3_SQL = _LEDGER_SQL + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, cast(failed as bigint) as failed from led
"""
OP3B_SQL = _LEDGER_SQL + """
, r as (select * from (values ('too_few_words', 1), ('repeated_words', 2), ('symbol_heavy', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32), ('few_letters', 64), ('one_long_word', 128)) as t(rule, bit))
select rule, cast(count(*) filter (where (failed & bit) <> 0) as bigint) as n_failed, cast(count(*) filter (where failed = bit) as bigint) as n_failed_alone,
  cast(count(*) filter (where failed = bit or failed = 0) as bigint) as n_kept_without from led, r group by rule
"""
