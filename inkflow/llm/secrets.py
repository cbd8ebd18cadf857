"""Secret scans with a randomness test battery (operator 7), DataFrame functions only.

Three kinds are found by their form (assign, access, hex). The method adds kind `random`: tokens of 20 or more
characters of an encoding's alphabet whose encoding is inferred (hex and base36 of either case, base32 or base64; the smallest alphabet
that holds the token, with both letters and digits) and that pass as random:

* alphabet uniformity: chi-squared of the characters over eight equal parts of the inferred alphabet. Text uses an alphabet
  unevenly, by TEXT_SPREAD of noncentrality a character or more;
* runs: the runs of letters, digits and cases. Text changes class at a rate of TEXT_RATE or less; the deviate is the signed
  root of the likelihood ratio;
* serial correlation of neighbouring characters' places in the alphabet. Text stays within a class, so its neighbours
  correlate by TEXT_SERIAL or more.

Each test gives a normal deviate against "this is text"; they are combined by Stouffer's weighted sum into one p-value. A
token whose uniformity or correlation rejects randomness itself at level REJECT has p-value 1. False discoveries are
controlled by the Benjamini-Hochberg step-up at ALPHA over the tokens of one document, with weights in proportion to length,
so that long tokens are asked for less. Control is by document, not over the table: of the documents with tokens but no
secret, about ALPHA get a false span. Every span comes from its own row: nothing is shuffled.

Positions are code points, ends exclusive. Matches are leftmost and do not overlap within a kind; they come from one
lazy pattern that extracts each gap and match in turn, so a position is a sum of lengths. Texts without a match of a
kind are not scanned for its positions.

Defined results: a null text is empty and has no spans (their text is empty); rows that repeat a doc_id each get their
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality_rules import let

# The forms of the three kinds.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
#: A token ends at '=', which no encoding has but at its end, so that the value of name=value is a token of its own.
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}=*"
#: Of a run that is long enough, the leftmost match is the whole run, so these patterns hold the least length themselves;
#: a short value of an assignment is dropped after it is matched, for what it covers must not match again.
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 0), ("hex", HEX, 0))

#: Rate of class changes between neighbouring characters that text reaches at most, the least noncentrality a character of
#: its chi-squared, and the least correlation of its neighbours.
TEXT_RATE = 0.12
TEXT_SPREAD = 0.5
TEXT_SERIAL = 0.2
#: Weights of the runs, uniformity and serial deviates, by how well they tell short random tokens from text.
WEIGHTS = (1.0, 0.5, 0.25)
#: Level at which uniformity and serial correlation reject that a token is random.
REJECT = 0.001
#: False discovery rate over the tokens of a document.
ALPHA = 1e-4

#: Alphabets by inferred encoding, in order of size.
ALPHABETS = (("hex", "0123456789abcdef"), ("upper hex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("upper base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
PARTS = 8
_Z = 3.0902  # of a normal's upper tail REJECT


def matches(text: Column, pattern: str, least: int = 0) -> Column:
    """Array of (start, end, value) of a pattern's matches; with `least`, the value is the pattern's group, and those
    under `least` characters are dropped. What follows the last match is taken with the end of the text as an empty
    match, for else the lazy gap would be tried from each of its places."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    gaps = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(rf"(?s)(.*?)({pattern}|\z)"), F.lit(k)).alias(name) for k, name in ((1, "gap"), (2, "found"))))
    sized = F.transform(gaps, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("size"), (F.regexp_extract(x["found"], pattern, 1) if least else x["found"]).alias("value")))
    placed = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(F.length(x["value"]) >= max(1, least), F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(empty)


def _characters(token: Column, encoding: Column) -> Column:
    """The place of each character in the alphabet of the token's encoding, 0 to 1."""
    value = None
    plain = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    chars = F.filter(F.split(plain, ""), lambda c: c != "")

    def place_in(alphabet: str):
        return lambda c: (F.position(c, F.lit(alphabet)) - 1) / F.lit(float(len(alphabet)))

    for name, alphabet in ALPHABETS:
        own = F.transform(chars, place_in(alphabet))
        value = F.when(encoding == name, own) if value is None else value.when(encoding == name, own)
    return value


def encoding_of(token: Column) -> Column:
    """The inferred encoding; null for a token of letters or of digits only, or of no alphabet."""
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return (
        F.when(mixed & token.rlike("^[0-9a-f]+$"), "hex")
        .when(mixed & token.rlike("^[0-9A-F]+$"), "upper hex")
        .when(mixed & token.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(mixed & token.rlike("^[0-9a-z]+$"), "base36")
        .when(mixed & token.rlike("^[0-9A-Z]+$"), "upper base36")
        .when(mixed & token.rlike("^[A-Za-z0-9+/_-]+=*$") & token.rlike("[a-z]") & token.rlike("[A-Z]"), "base64")
    )


def _chi_squared(places: Column) -> Column:
    """Chi-squared over PARTS equal parts of the alphabet."""
    n = F.size(places).cast("double")

    def part(k: int):
        return lambda p: (p >= k / PARTS) & (p < (k + 1) / PARTS)

    counts = [F.size(F.filter(places, part(k))).cast("double") for k in range(PARTS)]
    total = counts[0] * counts[0]
    for c in counts[1:]:
        total = total + c * c
    return total * F.lit(float(PARTS)) / n - n


def _deviate(chi: Column) -> Column:
    """A chi-squared of a uniform sequence as an approximately normal deviate (Wilson and Hilferty)."""
    df = float(PARTS - 1)
    return (F.pow(F.greatest(chi, F.lit(0.0)) / F.lit(df), F.lit(1 / 3)) - F.lit(1 - 2 / (9 * df))) / F.lit(math.sqrt(2 / (9 * df)))


def _serial(places: Column) -> Column:
    """The lag-one correlation of a uniform sequence as an approximately normal deviate, without its sign."""
    n = F.size(places)
    pairs = F.zip_with(F.slice(places, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(places, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a - 0.5) * (b - 0.5))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)) * 12 / F.sqrt(F.greatest(n - 1, F.lit(1)).cast("double"))


def _runs(token: Column) -> Column:
    """The class changes of a token as a deviate from text, positive if there are more."""
    classes = F.translate(token, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "A" * 26 + "a" * 26 + "0" * 10 + "+" * 5)
    n = F.length(token) - 1
    changes = n - F.length(classes) + F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    rate = F.least(F.greatest(changes.cast("double") / n, F.lit(1e-9)), F.lit(1 - 1e-9))
    kl = rate * F.log(rate / F.lit(TEXT_RATE)) + (1 - rate) * F.log((1 - rate) / F.lit(1 - TEXT_RATE))
    root = F.sqrt(F.greatest(2 * n * kl, F.lit(0.0)))
    return F.when(rate > TEXT_RATE, root).otherwise(-root)


def _log_p(token: Column, places: Column) -> Column:
    """log of the p-value of "this is text" by the three tests together; 0 if the token can't be random."""
    n = F.size(places).cast("double")

    def combined(m: Column) -> Column:
        even = (n * TEXT_SPREAD + (PARTS - 1) - m["chi"]) / F.sqrt(2.0 * (PARTS - 1) + 4 * TEXT_SPREAD * n)
        apart = F.lit(TEXT_SERIAL) * F.sqrt(n) - m["serial"]
        z = (WEIGHTS[0] * m["runs"] + WEIGHTS[1] * even + WEIGHTS[2] * apart) / F.lit(math.sqrt(sum(w * w for w in WEIGHTS)))
        # the upper tail of a normal is at most half of exp(-z^2 / 2)
        return F.when((z > 0) & (_deviate(m["chi"]) <= _Z) & (m["serial"] <= _Z), F.lit(math.log(0.5)) - z * z / 2).otherwise(F.lit(0.0))

    return let(F.struct(_chi_squared(places).alias("chi"), _serial(places).alias("serial"), _runs(token).alias("runs")), combined)


def random_spans(text: Column, taken: Column) -> Column:
    """Array of (start, end) of the tokens that pass the battery and touch no span of `taken`."""
    candidates = F.transform(
        matches(text, TOKEN),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), encoding_of(x["value"]).alias("encoding")),
    )
    free = F.filter(candidates, lambda x: x["encoding"].isNotNull() & ~F.exists(taken, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"])))
    tested = F.transform(
        free,
        lambda x: let(
            _characters(x["value"], x["encoding"]),
            lambda p: F.struct(_log_p(x["value"], p).alias("log_p"), x["start"].alias("start"), x["end"].alias("end")),
        ),
    )

    def discovered(t: Column) -> Column:
        mean = F.aggregate(t, F.lit(0.0), lambda a, x: a + (x["end"] - x["start"])) / F.size(t)
        weighted = F.array_sort(F.transform(t, lambda x: F.struct((x["log_p"] - F.log((x["end"] - x["start"]) / mean)).alias("q"), x["log_p"].alias("log_p"), x["start"].alias("start"), x["end"].alias("end"))))

        def step_up(w: Column) -> Column:
            ok = F.transform(w, lambda x, i: F.when(x["q"] <= F.log(F.lit(ALPHA) * (i + 1) / F.size(w)), i + 1).otherwise(F.lit(0)))
            return F.transform(F.filter(F.slice(w, F.lit(1), F.array_max(ok)), lambda x: x["log_p"] < 0), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

        return let(weighted, step_up)

    return let(tested, lambda t: F.when(F.size(t) > 0, discovered(t)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))


def spans(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: _id, base and more: arrays of (start, rank of the kind, end, kind)."""
    text = F.col("_text")
    found = C.texts(docs).select("_id", "_text", *(matches(text, pattern, least).alias(kind) for kind, pattern, least in KINDS))

    def of(rank: int, kind: str, array: Column) -> Column:
        return F.transform(array, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.array_sort(F.concat(*(of(k, kind, F.col(kind)) for k, (kind, _, _) in enumerate(KINDS))))
    based = found.select("_id", "_text", base.alias("base"), *(F.size(kind).cast("long").alias(f"n_{kind}") for kind, _, _ in KINDS))
    return based.withColumn("more", of(len(KINDS), "random", random_spans(text, F.col("base")))).drop("_text")


def joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base and spans as text (kind:start:end, comma-joined)."""
    return spans(docs).select(
        C.original_id(), "n_assign", "n_access", "n_hex", F.size("more").cast("long").alias("n_random"), joined(F.col("base")).alias("base"), joined(F.array_sort(F.concat("base", "more"))).alias("spans")
    )


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")
