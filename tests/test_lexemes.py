"""The Spanish stemmer against published pairs, the database's rank against its loop, boolean queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from inkflow.functions import lexical
from inkflow.functions.spanish import regions, stem

# Words of the published sample and their stems.
PAIRS = """
checa chec checar chec checo chec checoslovaquia checoslovaqui chefs chefs chelo chel chemical chemical chemise chemis cheque chequ chequeo cheque cheques chequ chester chest chetumal chetumal
chetumaleños chetumaleñ cheyenne cheyenn chía chi chiapaneca chiapanec chiapas chiap chica chic chicago chicag chicana chican chicas chic chicharrones chicharron chichen chich chichimecas chichimec
chicles chicl chico chic torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer toreros torer torio tori tormenta torment
tormentas torment tornado torn tornados torn tornar torn tornen torn torneo torne torneos torne tornillo tornill tornillos tornill torno torn toro tor toronto toront toros tor torpedearon torped
torpeza torpez torrado torr torralba torralb torre torr torrencial torrencial torrenciales torrencial torrente torrent torreon torreon torreón torreon torres torr torrescano torrescan
""".split()


def test_published_stems():
    assert {w: stem(w) for w in PAIRS[::2]} == dict(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    assert [stem(w) for w in ("amablemente", "soluciones", "biología", "diferencia", "nacionalidad", "creativas", "construyendo", "diciéndole", "paguemos", "", "a", "y", "oí")] == ["amabl", "solucion", "biolog", "diferent", "nacional", "creativ", "constru", "dic", "pag", "", "a", "y", "oi"]
    # RV of the words that the algorithm's description takes as examples
    assert [w[regions(w)[0] :] for w in ("macho", "oliva", "trabajo", "áureo")] == ["ho", "va", "bajo", "eo"]


def test_words_are_stemmed_alike_everywhere(spark):
    text = "Los GATOS comían rápidamente, y el gato comerá"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    lex, placed = (r.x for r in df.limit(1).select(F.array(lexical.lexemes(F.col("t")), lexical.placed_lexemes(F.col("t"))).alias("x")).select(F.explode("x").alias("x")).collect())
    assert [w for w in placed if w is not None] == lex and len(placed) == 8
    assert set(lexical.query_lexemes(text)) == set(lex) and stem("comerá") in lex
    assert [r.x for r in df.select(lexical.lexemes(F.col("t")).alias("x")).collect()][1:] == [None, []]


def plain_rank(lex: list[str | None], terms: list[str]) -> float:
    """The loop over pairs of places, as the database's documentation and source describe it."""
    places = {t: [min(i + 1, 16_383) for i, w in enumerate(lex) if w == t][:256] for t in terms}
    own = sorted(set(terms))
    if len(own) == 1:
        return 0.1 * sum(1 / (j + 1) ** 2 for j in range(len(places[own[0]]))) / 1.64493406685
    res = -1.0
    for i, a in enumerate(own):
        for b in own[:i]:
            for x in places[a]:
                for y in places[b]:
                    d = abs(x - y)
                    if d:
                        w = math.sqrt(0.1 * 0.1 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
                        res = w if res < 0 else 1 - (1 - res) * (1 - w)
    return 1e-20 if res < 0 else res


def test_rank(spark):
    texts = [["a", "b"], ["a", None, None, "b", "a"], ["a"] + ["x"] * 150 + ["b"], ["b", "c", "b", "a"] * 9, ["x"], [], ["a"] * 300 + ["b"], None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, lex array<string>")
    for terms in (["a", "b"], ["a", "b", "c"], ["a"], ["a", "a"], ["z", "a"]):
        got = {r.id: r.x for r in df.select("id", lexical.rank(F.col("lex"), terms).alias("x")).collect()}
        for k, t in enumerate(texts):
            assert got[k] is None if t is None else math.isclose(got[k], plain_rank(t, terms), rel_tol=1e-9, abs_tol=1e-12), (k, terms)
    assert {r.x for r in df.select(lexical.rank(F.col("lex"), []).alias("x")).collect()} == {0.0, None}


def test_boolean_queries(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", None]), (3, []), (4, None)], "id int, lex array<string>")

    def ids(q):
        return {r.id for r in df.filter(lexical.matches(F.col("lex"), q)).collect()}

    assert ids("a") == {1, 2} and ids(("and", "a", "b")) == {1} and ids(("or", "b", "z")) == {1}
    assert ids(("not", "b")) == {2, 3} and ids(("and",)) == {1, 2, 3} and ids(("or",)) == set()
    assert ids(("and", ("or", "a", "z"), ("not", ("and", "a", "b")))) == {2}
