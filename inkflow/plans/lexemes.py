"""Queries on the published Spanish stems and the database's rank, each with SQL of the same steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkflow.functions import lexical
from inkflow.functions import spanish as S
from inkflow.plans.catalogue import _Q, _V, _WORDS, TERMS, _hybrid, _texts, query, table
from inkflow.plans.records import STOPS, _list

_VOWEL = f"[{S.VOWELS}]"
_OTHER = f"[^{S.VOWELS}]"


def _ends(endings) -> str:
    return f"'({'|'.join(sorted(endings, key=len, reverse=True))})$'"


def _off(word: str, ending: str) -> str:
    return f"{word}[:length({word}) - length({ending})]"


def _less(word: str, endings, region: str = "r2") -> str:
    """The word without one of endings that lies in the region, else the word."""
    own = f"regexp_extract({word}, {_ends(endings)})"
    return f"case when {own} <> '' and length({word}) - length({own}) >= {region} then {_off(word, own)} else {word} end"


#: From t(w), the words, to stems(w, stem).
_STEMS = f"""
g0 as (select w, length(regexp_extract(w, '^{_OTHER}*{_VOWEL}+{_OTHER}')) as p from (select distinct w from t)), g1 as (select w, case when p > 0 then p else length(w) end as r1 from g0),
gq as (select w, r1, length(regexp_extract(w[r1 + 1:], '^{_OTHER}*{_VOWEL}+{_OTHER}')) as p from g1),
g2 as (select w, r1, case when p > 0 then r1 + p else length(w) end as r2,
  case when length(w) < 3 then 0 when not regexp_matches(w[2], '{_VOWEL}') then length(regexp_extract(w, '^..{_OTHER}*{_VOWEL}')) when regexp_matches(w[1], '{_VOWEL}') then length(regexp_extract(w, '^..{_VOWEL}*{_OTHER}')) else 3 end as v from gq),
g3 as (select w, r1, r2, case when v = 0 then length(w) else v end as rv, regexp_extract(w, {_ends(S.PRONOUNS)}) as own from g2),
g4 as (select *, {_off("w", "own")} as rest from g3), g5 as (select *, regexp_extract(rest[rv + 1:], {_ends([*S.GERUNDS_ACCENTED, *S.GERUNDS, "yendo"])}) as b from g4),
s0 as (select w, r1, r2, rv, case when own = '' then w when b in ({_list(S.GERUNDS_ACCENTED)[1:-1]}) then {_off("rest", "b")} || translate(b, 'áéí', 'aei')
  when b in ({_list(S.GERUNDS)[1:-1]}) or (b = 'yendo' and suffix(rest, 'uyendo')) then rest else w end as x from g5),
h1 as (select *, regexp_extract(x, {_ends([*S.PLAIN, *S.AFTER_IC, *S.REPLACED, *S.NOUNS_OF_QUALITY, *S.ADJECTIVES, "amente", "mente"])}) as own from s0),
h2 as (select *, {_off("x", "own")} as c from h1),
h3 as (select *, {_less("c", ["iv"])} as iv from h2),
h4 as (select *, case when own = '' or length(c) < (case when own = 'amente' then r1 else r2 end) then null
  {" ".join(f"when own = '{a}' then c || '{b}'" for a, b in S.REPLACED.items())} when own in ({_list(S.AFTER_IC)[1:-1]}) then {_less("c", ["ic"])}
  when own = 'amente' then (case when iv <> c then {_less("iv", ["at"])} else {_less("c", ["os", "ic", "ad"])} end)
  when own = 'mente' then {_less("c", ["ante", "able", "ible"])} when own in ({_list(S.NOUNS_OF_QUALITY)[1:-1]}) then {_less("c", ["abil", "ic", "iv"])}
  when own in ({_list(S.ADJECTIVES)[1:-1]}) then {_less("c", ["at"])} else c end as y from h3),
v1 as (select *, regexp_extract(x[rv + 1:], {_ends(S.Y_VERBS)}) as yv, regexp_extract(x[rv + 1:], {_ends([*S.VERBS, *S.GU_VERBS])}) as vb from h4),
v2 as (select *, {_off("x", "yv")} as yc, {_off("x", "vb")} as vc from v1),
s2 as (select w, rv, coalesce(y, case when yv <> '' and suffix(yc, 'u') then yc when vb in ({_list(S.GU_VERBS)[1:-1]}) and suffix(vc, 'gu') then vc[:length(vc) - 1] when vb <> '' then vc else x end) as x from v2),
e1 as (select *, regexp_extract(x, {_ends([*S.RESIDUAL, *S.RESIDUAL_E])}) as own from s2), e2 as (select *, {_off("x", "own")} as c from e1),
stems as (select w, translate(case when own = '' or length(c) < rv then x when own in ('e', 'é') and suffix(c, 'gu') and length(c) - 1 >= rv then c[:length(c) - 1] else c end, 'áéíóú', 'aeiou') as stem from e2)
"""


@query(f"""
with d as (select doc_id, list_filter({_WORDS}, lambda x: not list_contains({_list(STOPS)}, x)) as w from documents),
t as (select doc_id, unnest(w) as w, unnest(range(len(w))) as i from d), {_STEMS}
select d.doc_id, cast(count(stem) as int) as n, md5(coalesce(string_agg(stem, ' ' order by i), '')) as lexemes from d left join t using (doc_id) left join stems on stems.w = t.w group by d.doc_id
""")
def spanish_stems(spark, sf):
    """Lexemes of all texts by the published stemmer."""
    own = table(spark, sf, "documents").select("doc_id", lexical.lexemes(F.col("text"), stops=STOPS).alias("lex"))
    return own.select("doc_id", F.size("lex").alias("n"), F.md5(F.array_join("lex", " ")).alias("lexemes"))


def _rank_sql(terms) -> str:
    return f"""
p as (select doc_id, term, least(i, {lexical.LAST}) as i from (select doc_id, unnest(w) as term, unnest(range(1, len(w) + 1)) as i from (select doc_id, {_WORDS} as w from documents)) where term in ({_list(terms)[1:-1]})
  qualify row_number() over (partition by doc_id, term order by i) <= {lexical.PLACES}),
r as (select a.doc_id, 1 - product(case when abs(a.i - b.i) <= 100 then 1 - {lexical.WEIGHT} / sqrt(1.005 + 0.05 * exp(abs(a.i - b.i) / 1.5 - 2)) else 1 end) as x from p a join p b on a.doc_id = b.doc_id and a.term < b.term and a.i <> b.i group by a.doc_id)"""


@query(f"with {_rank_sql(TERMS)} select doc_id, round(greatest(coalesce(x, 0), 0), 6) as rank from documents left join r using (doc_id)")
def lex_rank(spark, sf):
    """The database's rank of all texts for a query of all terms."""
    own = table(spark, sf, "documents").select("doc_id", lexical.words(F.col("text")).alias("lex"))
    return own.select("doc_id", F.round(lexical.rank(F.col("lex"), TERMS), 6).alias("rank"))


_ONE = TERMS[-1]


@query(f"""
with t as (select doc_id, {_WORDS} as w from documents), n as (select *, least(len(list_filter(w, lambda x: x = '{_ONE}')), {lexical.PLACES}) as k from t)
select doc_id, round(0.1 * list_sum(list_transform(range(1, k + 1), lambda j: 1.0 / (j * j))) / 1.64493406685, 6) as rank, list_contains(w, 'et') and list_contains(w, 'la') as both,
  (list_contains(w, 'person') or list_contains(w, 'tiempo')) and not list_contains(w, 'the') as tree from n where k > 0
""")
def lex_rank_of_one(spark, sf):
    """The rank for one term where it is, and two boolean queries."""
    own = table(spark, sf, "documents").select("doc_id", lexical.words(F.col("text")).alias("lex")).filter(lexical.matches(F.col("lex"), _ONE))
    both, tree = lexical.matches(F.col("lex"), ("and", "et", "la")), lexical.matches(F.col("lex"), ("and", ("or", "person", "tiempo"), ("not", "the")))
    return own.select("doc_id", F.round(lexical.rank(F.col("lex"), [_ONE]), 6).alias("rank"), both.alias("both"), tree.alias("tree"))


@query(f"""
with {_rank_sql(TERMS)}, h as (select doc_id, 0.7 * (1 - list_distance({_V}, {_Q})) + 0.3 * greatest(coalesce(x, 0), 0) as score from documents left join r using (doc_id) join embeddings e on e.vec_id = doc_id % (select count(*) from embeddings))
select doc_id, round(score, 6) as hybrid_score from h order by score desc, doc_id limit 10
""")
def hybrid_rank_topk(spark, sf):
    """Hybrid search with the database's rank."""
    found = _hybrid(spark, sf, _texts(spark, sf), scorer="rank")
    return found.select(F.col("id").alias("doc_id"), F.round("hybrid_score", 6).alias("hybrid_score"))
