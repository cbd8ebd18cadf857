"""Lexemes and lexical scores. A score ranks and never filters; null lexemes (not analysed yet) score null, empty ones 0."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from inkflow.functions import spanish

WORD = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def stop_words(language: str = "spanish") -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


# Suffixes that Spanish inflection adds, longest first within a class.
VERB_ENDINGS = ("aríamos", "eríamos", "iríamos", "iéramos", "iésemos", "ábamos", "áramos", "ásemos", "asteis", "isteis", "aremos", "eremos", "iremos", "ando", "iendo", "aron", "ieron", "aban", "aba", "ado", "ido", "ada", "ida", "ados", "idos", "adas", "idas", "ían", "ía", "ar", "er", "ir", "amos", "emos", "imos")
NOUN_ENDINGS = ("amientos", "imientos", "amiento", "imiento", "aciones", "adoras", "adores", "adora", "ación", "ancias", "ancia", "idades", "idad", "mente", "ables", "ibles", "able", "ible", "istas", "ista", "ismos", "ismo", "osas", "osos", "oso", "osa", "icas", "icos", "ica", "ico")
ACCENTS = str.maketrans("áéíóúü", "aeiouu")


def light_stem(word: str) -> str:
    """A word without one derivational or verbal suffix, plural s and final vowel; three letters stay at least."""
    for ending in NOUN_ENDINGS + VERB_ENDINGS:
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            word = word.removesuffix(ending)
            break
    word = word.translate(ACCENTS)
    if len(word) > 4 and word.endswith("es"):
        word = word[:-2]
    elif len(word) > 3 and word.endswith("s"):
        word = word[:-1]
    return word[:-1] if len(word) > 3 and word[-1] in "aeo" else word


#: Stemmers by name: the published one, and a light one that takes off one ending.
STEMMERS = {"full": spanish.stem, "light": light_stem}


#: Words that a task remembers with their stems.
REMEMBERED = 200_000


def _stems(batches: Iterator[pa.Array], stemmer: str) -> Iterator[pa.Array]:
    """Lists of words as lists of stems. Lists stay Arrow's, so that Python holds distinct words only and not one object for each
    place; each distinct word is stemmed once and remembered."""
    memo: dict[str | None, str | None] = {None: None}
    for some in batches:
        if len(memo) > REMEMBERED:
            memo = {None: None}
        coded = some.flatten().dictionary_encode()
        stems = []
        for word in coded.dictionary.to_pylist():
            if word not in memo:
                memo[word] = STEMMERS[stemmer](word)
            stems.append(memo[word])
        # flattened lists begin at 0 and hold nothing for null rows
        lengths = np.asarray(pc.fill_null(pc.list_value_length(some), 0))
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(stems, pa.string()).take(coded.indices), mask=pc.is_null(some))


def _stemmed(lists: Column, stemmer: str) -> Column:
    @F.arrow_udf(ArrayType(StringType()))
    def own(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _stems(batches, stemmer)

    return own(lists)


def _stops(language: str | None, stops: Sequence[str] | None) -> Sequence[str]:
    return stops if stops is not None else stop_words(language) if language else ()


def lexemes(text: Column, language: str | None = "spanish", stemmed: bool = True, stops: Sequence[str] | None = None, stemmer: str = "full") -> Column:
    """The words of a text without stop words (those of the language, or `stops`), stemmed for Spanish; unstemmed lexemes
    need no Python."""
    own = words(text)
    if left_out := _stops(language, stops):
        stop = F.array(*(F.lit(w) for w in left_out))
        own = F.filter(own, lambda w: ~F.array_contains(stop, w))
    return _stemmed(own, stemmer) if stemmed and language == "spanish" else own


def placed_lexemes(text: Column, language: str | None = "spanish", stemmed: bool = True, stops: Sequence[str] | None = None, stemmer: str = "full") -> Column:
    """As lexemes, with a null in place of each stop word, so that a lexeme's index is its place in the text."""
    own = words(text)
    if left_out := _stops(language, stops):
        stop = F.array(*(F.lit(w) for w in left_out))
        own = F.transform(own, lambda w: F.when(~F.array_contains(stop, w), w))
    return _stemmed(own, stemmer) if stemmed and language == "spanish" else own


def query_lexemes(text: str, language: str | None = "spanish", stemmed: bool = True, stops: Sequence[str] | None = None, stemmer: str = "full") -> list[str]:
    own = dict.fromkeys(re.findall(r"[^\W_]+", text.lower()))
    stop = set(_stops(language, stops))
    return list(dict.fromkeys(STEMMERS[stemmer](w) if stemmed and language == "spanish" else w for w in own if w not in stop))


def matches(lex: Column, query) -> Column:
    """Whether lexemes satisfy a query: a term, or a tuple ("and", ...), ("or", ...) or ("not", q) of queries. An empty
    `and` holds always, an empty `or` never; null lexemes satisfy none."""
    if isinstance(query, str):
        return F.coalesce(F.exists(lex, lambda w: w == query), F.lit(False))
    kind, *parts = query
    if kind == "not":
        return lex.isNotNull() & ~matches(lex, parts[0])
    out = lex.isNotNull() & F.lit(kind == "and")
    for p in parts:
        out = out & matches(lex, p) if kind == "and" else out | matches(lex, p)
    return out


# Fixed values of the database's rank: the weight of an unlabelled lexeme, the rank of a text without any pair, the places
# of a lexeme that count and the last place.
WEIGHT, NO_PAIR, PLACES, LAST = 0.1, 1e-20, 256, 16_383


def positions(placed: Column, term: str) -> Column:
    """The first places of a term, from 1, the last ones being LAST."""
    own = F.filter(F.transform(placed, lambda w, i: F.when(w == term, F.least(i + 1, F.lit(LAST)))), lambda x: x.isNotNull())
    return F.slice(own, 1, PLACES)


def rank(placed: Column, terms: Sequence[str]) -> Column:
    """The database's rank of a text for a query of all terms, from `placed_lexemes`: null for null lexemes.

    Each pair of places of two different terms counts by their distance d, up to 100, with WEIGHT / sqrt(1.005 + 0.05 exp(d / 1.5 -
    2)), and the rank is one less the product of what these leave; a single term counts by the squares of its places' numbers.
    """
    own = list(dict.fromkeys(terms))
    if not own:
        return F.when(placed.isNotNull(), F.lit(0.0))
    if len(own) == 1:
        squares = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(positions(placed, own[0])), F.lit(1))), F.lit(0.0), lambda a, j: a + F.lit(1.0) / (j * j))
        return F.when(placed.isNotNull(), F.when(F.exists(placed, lambda w: w == own[0]), F.lit(WEIGHT) * squares / 1.64493406685).otherwise(F.lit(0.0)))

    def left(d: Column) -> Column:
        near = 1 - F.lit(WEIGHT) / F.sqrt(F.lit(1.005) + 0.05 * F.exp(d / 1.5 - 2))
        return F.when((d > 0) & (d <= 100), near).otherwise(F.lit(1.0))

    def left_by(a: Column, b: Column) -> Column:
        return F.aggregate(a, F.lit(1.0), lambda acc, x: F.aggregate(b, acc, lambda inner, y: inner * left(F.abs(x - y))))

    def apart(a: Column, b: Column) -> Column:
        return F.exists(a, lambda x: F.exists(b, lambda y: x != y))

    def whole(lists: Column) -> Column:
        product, any_pair = F.lit(1.0), F.lit(False)
        for i in range(len(own)):
            for k in range(i):
                product = product * left_by(lists[i], lists[k])
                any_pair = any_pair | apart(lists[i], lists[k])
        return F.when(any_pair, F.greatest(1 - product, F.lit(0.0))).otherwise(F.lit(NO_PAIR))

    # bound by a transform of one element, so that places are looked up once
    return F.when(placed.isNotNull(), F.transform(F.array(F.array(*(positions(placed, t) for t in own))), whole)[0])


def frequency(lex: Column, term: str) -> Column:
    return F.size(F.filter(lex, lambda w: w == term))


def tf_score(lex: Column, terms: list[str]) -> Column:
    """Share of a text's lexemes that are terms of the query; null for null lexemes."""
    hits = sum((frequency(lex, t) for t in terms), F.lit(0))
    return F.when(lex.isNotNull(), hits / F.greatest(F.size(lex), F.lit(1)))


def bm25(docs: DataFrame, lex: str, terms: list[str], k1: float = K1, b: float = B, score: str = "lexical") -> DataFrame:
    """docs with a BM25 score. Statistics of the corpus are one row of counts, so no text is shuffled."""
    own = F.col(lex)
    counted = docs.select("*", F.size(own).alias("_length"), *(frequency(own, t).alias(f"_tf{k}") for k, t in enumerate(terms)))
    stats = counted.agg(F.count("_length").alias("_n"), F.avg(F.when(F.col(lex).isNotNull(), F.col("_length"))).alias("_mean"), *(F.count_if(F.col(f"_tf{k}") > 0).alias(f"_df{k}") for k in range(len(terms))))
    both = counted.join(F.broadcast(stats))
    total = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"_tf{k}"), F.col(f"_df{k}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_length") / F.greatest(F.col("_mean"), F.lit(1e-9))))
    return both.select(*docs.columns, F.when(F.col(lex).isNotNull(), total).alias(score))
