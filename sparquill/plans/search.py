"""Queries of the search layer: terms, phrases, Boolean trees, vocabulary patterns, scoring models, spans, parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as X
from ..operators import facets, parser, spans
from ..operators.index import Index
from ..operators.query import (
    Bool,
    Boosting,
    CommonTerms,
    Constant,
    DisMax,
    Function,
    FunctionScore,
    Fuzzy,
    MatchAll,
    MoreLikeThis,
    Phrase,
    SloppyPhrase,
    Synonyms,
    Term,
    Where,
    all_of,
    any_of,
    batch_search,
    prefix,
    regexp,
    search,
    term_range,
    terms_in,
    wildcard,
)
from ..sources import linedocs
from .registry import EXACT, LOSSY, TEXT, Tables, query, scored, top, words

# --- terms and conjunctions


def _and(*terms: str, k: int = 5, model: str = LOSSY) -> str:
    """SQL of a conjunction; a term given twice counts twice."""
    times = " + ".join(f"sum(case when term = {words(t)} then {terms.count(t)} * s else 0 end)" for t in dict.fromkeys(terms))
    return f"with {scored(*terms, model=model)} select doc_id, round({times}, 6) as score from s group by doc_id having count(*) = {len(set(terms))} {top(k)}"


@query(_and("the"))
def bm25_single_top5(t: Tables) -> DataFrame:
    return search(t.index, Term("the"))


@query(_and("the", "of"))
def bm25_and_top5(t: Tables) -> DataFrame:
    return search(t.index, all_of(["the", "of"]))


@query(_and("that", "with", "from", k=10))
def bm25_three_terms(t: Tables) -> DataFrame:
    return search(t.index, all_of(["that", "with", "from"]), 10)


@query(_and("the", "zzzabsent"))
def bm25_missing_term_empty(t: Tables) -> DataFrame:
    return search(t.index, all_of(["the", "zzzabsent"]))


@query(_and("the", "of", "the"))
def bm25_duplicate_term(t: Tables) -> DataFrame:
    return search(t.index, all_of(["the", "of", "the"]))


@query(_and("the", "of", model=EXACT))
def bm25_exact_length(t: Tables) -> DataFrame:
    return search(Index.build(t.documents, lossy=False), all_of(["the", "of"]))


@query(f"with {scored('the', 'de', 'of')} select doc_id, round(sum(s), 6) as score from s group by doc_id {top(10)}")
def bm25_or_top10(t: Tables) -> DataFrame:
    return search(t.index, any_of(["the", "de", "of"]), 10)


@query(f"with {scored('the', 'of', model='sqrt(tf) * (1 + ln(n / (df + 1))) / sqrt(dl)')} select doc_id, round(sum(s), 6) as score from s group by doc_id having count(*) = 2 {top()}")
def tfidf_legacy(t: Tables) -> DataFrame:
    return search(Index.build(t.documents, lossy=False), all_of(["the", "of"], similarity.tf_idf_legacy))


@query(f"with {TEXT} select w.term, coalesce(df, 0) as df from (select unnest([{words('the', 'de', 'zzzabsent')}]) as term) w left join df using (term)")
def doc_freq_lookup(t: Tables) -> DataFrame:
    return t.index.doc_freqs(["the", "de", "zzzabsent"])


@query(f"with {TEXT} select count(*) as terms from df")
def term_count(t: Tables) -> DataFrame:
    return t.index.vocabulary().agg(F.count("*").alias("terms"))


@query(f"with {TEXT} select n, round(a, 6) as avgdl, total from st")
def avg_doc_length(t: Tables) -> DataFrame:
    return t.index.stats().select("n", F.round("avgdl", 6).alias("avgdl"), "total")


@query(f"with {TEXT} select doc_id, cast(dl as integer) as dl, cast(dl_q as integer) as dl_q from dl")
def length_byte(t: Tables) -> DataFrame:
    return t.index.docs.select("doc_id", "dl", "dl_q")


@query(f"with {TEXT} select term, df, ctf from df order by df desc, term limit 50")
def high_freq_terms(t: Tables) -> DataFrame:
    return facets.frequent_terms(t.index.vocabulary(), 50)


@query(f"with {TEXT} select term, doc_id, cast(tf as integer) as tf from tf where term in ('the', 'de')")
def postings_lookup(t: Tables) -> DataFrame:
    return t.index.terms("the", "de").select("term", "doc_id", "tf")


@query(f"with {TEXT} select cast(count(*) as bigint) as postings, cast(sum(tf) as bigint) as occurrences, max(tf) as most from tf")
def postings_totals(t: Tables) -> DataFrame:
    return t.index.frequencies().agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"), F.max("tf").cast("long").alias("most"))


_BATCH = f"""
with {TEXT}, q as (
  select item_id as query_id, list_filter(string_split(text, ' '), lambda x: x <> '') as t from benchmark
), slots as (select query_id, unnest(t) as term, len(t) as n_slots from q),
s as (select doc_id, term, {LOSSY} as s from tf join df using (term) join dl using (doc_id) cross join st where term in (select term from slots)),
h as (select query_id, n_slots, doc_id, sum(s) as score, count(*) as met from slots join s using (term) group by all),
r as (select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from h where met = n_slots)
select query_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 5
"""


@query(_BATCH)
def batch_search_topk(t: Tables) -> DataFrame:
    """Every benchmark text as a query for all its words."""
    log = t.benchmark.select(F.col("item_id").alias("query_id"), X.split_space(F.col("text")).alias("terms"))
    return batch_search(t.index, log)


@query(f"with {TEXT}, s as (select doc_id, tf * 1e0 as s from tf where term = 'the'), best as (select doc_id, round(s, 6) as score from s {top()}) select doc_id, score, lang, source from best join documents using (doc_id)")
def late_fetch(t: Tables) -> DataFrame:
    """Stored fields are fetched for the top hits alone."""
    hits = search(t.index, Term("the", lambda s: s.tf * 1.0))
    return t.documents.select("doc_id", "lang", "source").join(F.broadcast(hits), "doc_id").select("doc_id", "score", "lang", "source")


# --- phrases

_AT = f"with {TEXT}, hit as (select a.doc_id, a.pos from pos a join pos b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the')"


@query(f"{_AT}, s as (select doc_id, term, {LOSSY} as s from tf join df using (term) join dl using (doc_id) cross join st where term in ('of', 'the')) select doc_id, round(sum(s), 6) as score from s where doc_id in (select doc_id from hit) group by doc_id {top()}")
def phrase_two_terms(t: Tables) -> DataFrame:
    return search(t.index, Phrase(["of", "the"]))


@query(f"with {TEXT}, hit as (select a.doc_id from pos a join pos b on a.doc_id = b.doc_id and b.pos = a.pos + 1 join pos c on a.doc_id = c.doc_id and c.pos = a.pos + 2 where a.term = 'of' and b.term = 'the' and c.term = 'the'), s as (select doc_id, term, {LOSSY} as s from tf join df using (term) join dl using (doc_id) cross join st where term in ('of', 'the')) select doc_id, round(sum(s * case when term = 'the' then 2 else 1 end), 6) as score from s where doc_id in (select doc_id from hit) group by doc_id {top(10)}")
def phrase_three_terms(t: Tables) -> DataFrame:
    return search(t.index, Phrase(["of", "the", "the"]), 10)


@query(f"{_AT} select doc_id, cast(pos as integer) as start from hit")
def phrase_positions(t: Tables) -> DataFrame:
    return Phrase(["of", "the"]).matches(t.index).select("doc_id", F.explode("starts").alias("start"))


@query(f"{_AT} select doc_id, count(*) as matches from hit group by doc_id")
def phrase_match_counts(t: Tables) -> DataFrame:
    return Phrase(["of", "the"]).matches(t.index).select("doc_id", F.size("starts").cast("long").alias("matches"))


@query(f"with tok as (select doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') as t from documents), held as (select * from tok where list_contains(t, 'of') and list_contains(t, 'the')), pos as (select doc_id, unnest(t) as term, unnest(range(len(t))) as pos from held), o as (select doc_id, term, pos, sum(len(term) + 1) over (partition by doc_id order by pos) - len(term) - 1 as start from pos) select a.doc_id, cast(a.start as integer) as start, cast(b.start + 2 as integer) as stop from o a join o b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the'")
def phrase_offsets(t: Tables) -> DataFrame:
    """Places of phrase matches in the token text."""
    return t.index.docs.select("doc_id", F.inline(linedocs.phrase_offsets(F.col("tokens"), ["of", "the"])))


@query(f"with {TEXT}, hit as (select distinct a.doc_id from pos a join pos b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term in ('of', 'to') and b.term = 'the') select doc_id from hit")
def multi_phrase(t: Tables) -> DataFrame:
    return Phrase([["of", "to"], "the"]).matches(t.index).select("doc_id")


_SLOPPY = f"""
with {TEXT}, m as (
  select a.doc_id, a.pos as p0, min(abs(b.pos - 1 - a.pos)) as moves from pos a join pos b on a.doc_id = b.doc_id
  where a.term = 'of' and b.term = 'and' and abs(b.pos - 1 - a.pos) <= 3 group by all
), f as (select doc_id, sum(1.0 / (1 + moves)) as tf from m group by doc_id),
w as (select count(*) as df from f)
select doc_id, round({LOSSY}, 6) as score from f join dl using (doc_id) cross join st cross join w {top(10)}
"""


@query(_SLOPPY)
def sloppy_phrase(t: Tables) -> DataFrame:
    return search(t.index, SloppyPhrase(["of", "and"], 3), 10)


# --- Boolean trees

_S = scored("the", "of", "de", "la", "with", "from")


@query(f"with {_S} select doc_id, round(sum(case when term in ('the', 'of', 'with') then s end), 6) as score from s group by doc_id having count_if(term = 'the') = 1 and count_if(term = 'from') = 0 and count_if(term = 'with') + count_if(term = 'of') >= 1 {top(10)}")
def bool_must_should_not(t: Tables) -> DataFrame:
    return search(t.index, Bool(must=[Term("the")], should=[Term("with"), Term("of")], must_not=[Term("from")], min_should=1), 10)


@query(f"with {_S} select doc_id, round(sum(s), 6) as score from s where term in ('the', 'of', 'with', 'from') group by doc_id having count(*) >= 3 {top(10)}")
def min_should_match(t: Tables) -> DataFrame:
    return search(t.index, Bool(should=[Term(x) for x in ("the", "of", "with", "from")], min_should=3), 10)


@query(f"with {_S} select doc_id, round(sum(case when term = 'of' then s else 0 end), 6) as score from s group by doc_id having count_if(term = 'the') = 1 and count_if(term = 'of') = 1 {top(10)}")
def bool_filter(t: Tables) -> DataFrame:
    return search(t.index, Bool(must=[Term("of")], filter=[Term("the")]), 10)


@query(f"with {TEXT} select doc_id, 1e0 as score from documents where false")
def pure_negation(t: Tables) -> DataFrame:
    return search(t.index, Bool(must_not=[Term("the")]))


@query(f"with {_S} select doc_id, round(max(s) + 0.3 * (sum(s) - max(s)), 6) as score from s where term in ('the', 'de', 'la') group by doc_id {top(10)}")
def dismax(t: Tables) -> DataFrame:
    return search(t.index, DisMax([Term("the"), Term("de"), Term("la")], 0.3), 10)


@query(f"with {TEXT} select doc_id, 2.5e0 as score from tf where term = 'with' {top(20)}")
def constant_score(t: Tables) -> DataFrame:
    return search(t.index, Constant(Term("with"), 2.5), 20)


@query(f"with {_S} select doc_id, round(3 * s, 6) as score from s where term = 'the' {top(10)}")
def boost_query(t: Tables) -> DataFrame:
    return search(t.index, Term("the").boosted(3.0), 10)


@query(f"with {_S} select a.doc_id, round(a.s * case when b.doc_id is not null then 0.25 else 1 end, 6) as score from s a left join (select doc_id from s where term = 'from') b using (doc_id) where a.term = 'the' {top(10)}")
def boosting_demote(t: Tables) -> DataFrame:
    return search(t.index, Boosting(Term("the"), Term("from"), 0.25), 10)


@query(f"with {scored('the', 'blees', 'inha', 'thble')}, r as (select term, df <= ceil(0.2 * n) as rare from df cross join st) select doc_id, round(sum(s), 6) as score from s join r using (term) group by doc_id having count_if(rare) >= 1 {top(10)}")
def common_terms(t: Tables) -> DataFrame:
    return search(t.index, CommonTerms(["the", "blees", "inha", "thble"], 0.2), 10)


@query(f"with {TEXT}, f as (select doc_id, sum(tf) as tf from tf where term in ('the', 'The', 'the.') group by doc_id), m as (select max(df) as df from df where term in ('the', 'The', 'the.')) select doc_id, round({LOSSY}, 6) as score from f cross join m join dl using (doc_id) cross join st {top(10)}")
def synonym_terms(t: Tables) -> DataFrame:
    return search(t.index, Synonyms(["the", "The", "the."]), 10)


@query(f"with {TEXT} select doc_id, 1e0 as score from tf where term in ('inha', 'blees', 'por') group by doc_id")
def terms_in_set(t: Tables) -> DataFrame:
    return terms_in(["inha", "blees", "por"]).hits(t.index)


@query("select doc_id, 1e0 as score from documents")
def match_all(t: Tables) -> DataFrame:
    return MatchAll().hits(t.index)


# --- patterns over the vocabulary


def _vocabulary(condition: str) -> str:
    return f"with {TEXT} select distinct doc_id, 1e0 as score from tf where {condition}"


@query(_vocabulary("starts_with(term, 'thr')"))
def prefix_terms(t: Tables) -> DataFrame:
    return prefix("thr").hits(t.index)


@query(_vocabulary("regexp_full_match(term, 't.*n[^ ]d', 's')"))
def wildcard_terms(t: Tables) -> DataFrame:
    return wildcard("t*n?d").hits(t.index)


@query(_vocabulary("regexp_full_match(term, '(in|on)(ing|ed)+')"))
def regexp_terms(t: Tables) -> DataFrame:
    return regexp("(in|on)(ing|ed)+").hits(t.index)


@query(_vocabulary("term >= 'thb' and term < 'thd'"))
def term_range_docs(t: Tables) -> DataFrame:
    return term_range("thb", "thd").hits(t.index)


@query(f"with {TEXT} select term, round(1 - levenshtein(term, 'inha') / least(len(term), 4), 6) as boost from df where levenshtein(term, 'inha') <= 1 and starts_with(term, 'i') order by boost desc, term limit 50")
def fuzzy_terms(t: Tables) -> DataFrame:
    return Fuzzy("inha", 1, prefix=1, transpositions=False).expand(t.index).select("term", F.round("boost", 6).alias("boost"))


@query(f"with {TEXT} select term, round(1 - damerau_levenshtein(term, 'thing') / least(len(term), 5), 6) as boost from df where damerau_levenshtein(term, 'thing') <= 1 order by boost desc, term limit 50")
def fuzzy_transpositions(t: Tables) -> DataFrame:
    return Fuzzy("thing", 1).expand(t.index).select("term", F.round("boost", 6).alias("boost"))


# --- columns of documents


@query("select doc_id, 1e0 as score from documents where n_chars between 500 and 900")
def point_range_docs(t: Tables) -> DataFrame:
    return Where(F.col("n_chars").between(500, 900)).hits(t.index)


@query("select doc_id, round(ln(1 + n_chars), 6) as score from documents order by score desc, doc_id limit 10")
def function_query(t: Tables) -> DataFrame:
    return search(t.index, Function(F.log(1 + F.col("n_chars"))), 10)


@query(f"with {_S} select s.doc_id, round(s * ln(1 + n_chars), 6) as score from s join documents using (doc_id) where term = 'the' {top(10)}")
def function_score(t: Tables) -> DataFrame:
    return search(t.index, FunctionScore(Term("the"), F.log(1 + F.col("n_chars"))), 10)


_SEED = ["thble", "thble", "ntti", "inha", "inha", "blees", "the", "the"]


@query(f"with {scored('thble', 'inha', 'the')}, w as (select term, 2 * (ln(n / (df + 1)) + 1) as w from df cross join st where term in ('thble', 'inha', 'the') and df >= 5 order by w desc, term limit 2) select doc_id, round(sum(s), 6) as score from s where term in (select term from w) group by doc_id {top(10)}")
def more_like_this(t: Tables) -> DataFrame:
    return search(t.index, MoreLikeThis(_SEED, most=2), 10)


# --- scoring models

_P = "((ctf + 1.0) / (total + 1))"
_N2 = "(tf * (ln(1 + a / dl) / ln(2)))"
_LAM = "((ctf + 1.0) / (n + ctf + 1))"
_N3 = "((tf + 800 * (ctf + 1.0) / (total + 1)) / (dl + 800) * 800)"
_MEAN = "((ctf + 1.0) / (n + 1))"
_ALL = f"(ctf + 1 + {_N2})"
_TTF = f"(case when {_MEAN} = 1 then 0.99 else {_MEAN} end)"


def _be(a: str, b: str) -> str:
    return f"(({b} + 0.5) * ln({a} / {b}) / ln(2) + ({a} - {b}) * ln({a}) / ln(2))"


_MODELS = {
    "classic": "sqrt(tf) * pow(ln((n + 1) / (df + 1)) + 1, 2) / sqrt(dl)",
    "lm_dirichlet": f"greatest(0.0, ln(1 + tf / (2000 * {_P})) + ln(2000 / (dl + 2000.0)))",
    "lm_jelinek_mercer": f"ln(1 + (0.3 * tf / dl) / (0.7 * {_P}))",
    "axiomatic_f2exp": "tf / (tf + 0.25 + 0.25 * dl / a) * pow((n + 1.0) / df, 0.35)",
    "dfr_in_l_h2": f"{_N2} * (ln((n + 1) / (df + 0.5)) / ln(2)) / ({_N2} + 1)",
    "dfr_if_b_h1": "(tf * a / dl) * (ln(1 + (n + 1) / (ctf + 0.5)) / ln(2)) * (ctf + 2) / ((df + 1) * ((tf * a / dl) + 1))",
    "dfr_g_l_z": f"(ln({_LAM} + 1) / ln(2) + (tf * pow(a / dl, 0.3)) * (ln((1 + {_LAM}) / {_LAM}) / ln(2))) / ((tf * pow(a / dl, 0.3)) + 1)",
    "axiomatic_f1log": "(1 + ln(1 + ln(tf))) * (a + 0.25) / (a + dl * 0.25) * ln((n + 1.0) / df)",
    "axiomatic_f3exp": "(1 + ln(1 + ln(tf))) * pow((n + 1.0) / df, 0.35) - (dl - 1) * 0.25 / a",
    "ib_ll_df_h2": f"-ln(((df + 1.0) / (n + 1)) / ({_N2} + (df + 1.0) / (n + 1)))",
    "dfi_standardized": "case when tf <= (ctf + 1.0) * dl / (total + 1) then 0 else ln((tf - (ctf + 1.0) * dl / (total + 1)) / sqrt((ctf + 1.0) * dl / (total + 1)) + 1) / ln(2) end",
    "dfi_saturated": "case when tf <= (ctf + 1.0) * dl / (total + 1) then 0 else ln((tf - (ctf + 1.0) * dl / (total + 1)) / ((ctf + 1.0) * dl / (total + 1)) + 1) / ln(2) end",
    "dfi_chisquared": "case when tf <= (ctf + 1.0) * dl / (total + 1) then 0 else ln(pow(tf - (ctf + 1.0) * dl / (total + 1), 2) / ((ctf + 1.0) * dl / (total + 1)) + 1) / ln(2) end",
    "boolean": "1e0",
    "axiomatic_f1exp": "(1 + ln(1 + ln(tf))) * (a + 0.25) / (a + dl * 0.25) * pow((n + 1.0) / df, 0.35)",
    "axiomatic_f2log": "tf / (tf + 0.25 + 0.25 * dl / a) * ln((n + 1.0) / df)",
    "axiomatic_f3log": "(1 + ln(1 + ln(tf))) * ln((n + 1.0) / df) - (dl - 1) * 0.25 / a",
    "dfr_ine_l_h2": f"{_N2} * (ln((n + 1) / (n * (1 - pow((n - 1.0) / n, ctf)) + 0.5)) / ln(2)) / ({_N2} + 1)",
    "dfr_p_l_h3": f"({_N3} * ln({_N3} / {_MEAN}) / ln(2) + ({_MEAN} + 1 / (12 * {_N3}) - {_N3}) / ln(2) + 0.5 * ln(2 * pi() * {_N3}) / ln(2)) / ({_N3} + 1)",
    "dfr_d_b_h2": f"(({_N2} / {_ALL} * ln({_N2} / {_ALL} * (n + 1)) + (1 - {_N2} / {_ALL}) * ln((1 - {_N2} / {_ALL}) / (1 - 1.0 / (n + 1)))) / ln(2) * {_ALL} + 0.5 * ln(1 + 2 * pi() * {_N2} * (1 - {_N2} / {_ALL})) / ln(2)) * (ctf + 2) / ((df + 1) * ({_N2} + 1))",
    "dfr_be_l_h2": f"({_be('(' + _ALL + ' + n + ' + _ALL + ' - 1)', '(' + _ALL + ' + n + ' + _ALL + f' - {_N2} - 2)')} - {_be(_ALL, f'({_ALL} - {_N2})')} - ln(({_ALL} + n - 1) * exp(1)) / ln(2)) / ({_N2} + 1)",
    "ib_spl_ttf_h2": f"-ln((pow({_TTF}, {_N2} / ({_N2} + 1)) - {_TTF}) / (1 - {_TTF}))",
    "sweet_spot": "case when tf = 0 then 0 else sqrt(tf) end * pow(ln((n + 1) / (df + 1)) + 1, 2) / sqrt(0.5 * (abs(dl - 10) + abs(dl - 100) - 90) + 1)",
    "sum_of_models": f"1e0 + sqrt(tf) * pow(ln((n + 1) / (df + 1)) + 1, 2) / sqrt(dl)",
}
for _name, _sql in _MODELS.items():

    def _run(t: Tables, _name: str = _name) -> DataFrame:
        return search(Index.build(t.documents, lossy=False), any_of(["inha", "blees", "with"], similarity.MODELS[_name]), 10)

    query(f"with {scored('inha', 'blees', 'with', model=_sql)} select doc_id, round(sum(s), 6) as score from s group by doc_id {top(10)}", f"model_{_name}")(_run)


@query(f"with {TEXT} select doc_id, cast(tf as integer) as tf, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf, round((tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl_q / a)), 6) as tfnorm, round({LOSSY}, 6) as score from tf join df using (term) join dl using (doc_id) cross join st where term = 'the' {top(10)}")
def explain(t: Tables) -> DataFrame:
    """The parts of a BM25 score."""
    rows = t.index.terms("the")
    df, stats = rows.agg(F.count_distinct("doc_id")).scalar(), t.index.stats()
    idf = similarity.bm25_idf(df, stats.select("n").scalar())
    tf = similarity.bm25_tf(F.col("tf"), F.col("dl_q"), stats.select("avgdl").scalar())
    return rows.select("doc_id", "tf", df.alias("df"), F.round(idf, 6).alias("idf"), F.round(tf, 6).alias("tfnorm"), F.round(idf * tf, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


# --- spans


def _span(select: str) -> str:
    return f"with {TEXT}, sp as (select doc_id, term, cast(pos as integer) as s, cast(pos + 1 as integer) as e from pos), a as (select * from sp where term = 'of'), b as (select * from sp where term = 'and'), c as (select * from sp where term = 'the') {select}"


@query(_span("select distinct a.doc_id, a.s as start, b.e as \"end\" from a join b on a.doc_id = b.doc_id and b.s >= a.e and b.s - a.e <= 2"))
def span_near_ordered(t: Tables) -> DataFrame:
    return spans.near([spans.term(t.index, "of"), spans.term(t.index, "and")], 2)


@query(_span("select distinct a.doc_id, least(a.s, b.s) as start, greatest(a.e, b.e) as \"end\" from a join b on a.doc_id = b.doc_id and (b.s >= a.e or a.s >= b.e) and greatest(a.e, b.e) - least(a.s, b.s) - 2 <= 2"))
def span_near_unordered(t: Tables) -> DataFrame:
    return spans.near([spans.term(t.index, "of"), spans.term(t.index, "and")], 2, ordered=False)


@query(_span("select doc_id, s as start, e as \"end\" from a union select doc_id, s, e from b"))
def span_or(t: Tables) -> DataFrame:
    return spans.either(spans.term(t.index, "of"), spans.term(t.index, "and"))


@query(_span("select doc_id, s as start, e as \"end\" from a where not exists (select 1 from c where c.doc_id = a.doc_id and c.s < a.e + 1 and c.e > a.s - 1)"))
def span_not(t: Tables) -> DataFrame:
    return spans.excluding(spans.term(t.index, "of"), spans.term(t.index, "the"), 1, 1)


@query(_span("select doc_id, s as start, e as \"end\" from a where e <= 10"))
def span_first(t: Tables) -> DataFrame:
    return spans.first(spans.term(t.index, "of"), 10)


@query(_span("select doc_id, s as start, e as \"end\" from a where s >= 5 and e <= 30"))
def span_position_range(t: Tables) -> DataFrame:
    return spans.between(spans.term(t.index, "of"), 5, 30)


_NEAR = "n as (select distinct a.doc_id, a.s as start, b.e as \"end\" from a join b on a.doc_id = b.doc_id and b.s >= a.e and b.s - a.e <= 4)"


@query(_span(f", {_NEAR} select n.* from n where exists (select 1 from c where c.doc_id = n.doc_id and n.start <= c.s and c.e <= n.\"end\")").replace("'the') ,", "'the'),"))
def span_containing(t: Tables) -> DataFrame:
    return spans.containing(spans.near([spans.term(t.index, "of"), spans.term(t.index, "and")], 4), spans.term(t.index, "the"))


@query(_span(f", {_NEAR} select c.doc_id, c.s as start, c.e as \"end\" from c where exists (select 1 from n where c.doc_id = n.doc_id and n.start <= c.s and c.e <= n.\"end\")").replace("'the') ,", "'the'),"))
def span_within(t: Tables) -> DataFrame:
    return spans.within(spans.near([spans.term(t.index, "of"), spans.term(t.index, "and")], 4), spans.term(t.index, "the"))


@query(f"with {TEXT} select doc_id, cast(pos as integer) as start, cast(pos + 1 as integer) as \"end\" from pos where starts_with(term, 'blee')")
def span_multi_term(t: Tables) -> DataFrame:
    return spans.multi_term(t.index, lambda x: x.startswith("blee"))


@query(_span("select doc_id, round(sum(1.0 / (w + 1)), 6) as freq from (select distinct a.doc_id, a.s, b.e, b.e - a.s - 2 as w from a join b on a.doc_id = b.doc_id and b.s >= a.e and b.s - a.e <= 2) group by doc_id"))
def span_sloppy_freq(t: Tables) -> DataFrame:
    found = spans.near([spans.term(t.index, "of"), spans.term(t.index, "and")], 2)
    return spans.sloppy_freq(found, 2).select("doc_id", F.round("freq", 6).alias("freq"))


# --- query languages


@query(f"with {_S} select doc_id, round(sum(case when term in ('the', 'with') then s when term = 'of' then 2 * s end), 6) as score from s group by doc_id having count_if(term = 'the') = 1 and count_if(term = 'from') = 0 {top(10)}")
def parse_classic(t: Tables) -> DataFrame:
    return search(t.index, parser.classic("+the of^2 with -from"), 10)


@query(f"with {_S} select doc_id, round(sum(s), 6) as score from s where term in ('the', 'of', 'de') group by doc_id having count_if(term = 'the') = 1 and count_if(term in ('of', 'de')) >= 1 {top(10)}")
def parse_classic_groups(t: Tables) -> DataFrame:
    return search(t.index, parser.classic("the AND (of OR de)"), 10)


@query(_span("select doc_id, cast(count(*) as double) as score from (select distinct a.doc_id, a.s, b.e from a join b on a.doc_id = b.doc_id and b.s >= a.e and b.s - a.e <= 2) group by doc_id " + top(10)))
def parse_surround(t: Tables) -> DataFrame:
    return search(t.index, parser.surround("of 3W and"), 10)


_XML = '<BooleanQuery><Clause occurs="must"><TermQuery>the</TermQuery></Clause><Clause occurs="must"><DisjunctionMaxQuery><TermQuery>of</TermQuery><TermQuery boost="2">de</TermQuery></DisjunctionMaxQuery></Clause></BooleanQuery>'


@query(f"with {_S}, m as (select doc_id, max(case when term = 'of' then s when term = 'de' then 2 * s end) as d from s where term in ('of', 'de') group by doc_id) select doc_id, round(s + d, 6) as score from s join m using (doc_id) where term = 'the' {top(10)}")
def parse_xml(t: Tables) -> DataFrame:
    return search(t.index, parser.from_xml(_XML), 10)
