"""Queries over text as a corpus: analysis, suggestions, classification, quality, query logs, snippets, line documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import classify, highlight, logs, suggest
from ..operators.query import Term, batch_search, search
from ..sources import linedocs
from .registry import LOSSY, TEXT, Tables, query, top

# --- analysis

_T = "list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')"


def _short(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.split_space(F.col("text")).alias("t"))


@query(f"with b as (select item_id, {_T} as t from benchmark) select item_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as token from b")
def shingles(t: Tables) -> DataFrame:
    return _short(t).select("item_id", F.explode(X.shingles(F.col("t"), 2, 2)).alias("token"))


@query(f"with {TEXT}, v as (select term from df where len(term) >= 3) select term, unnest(list_transform(range(1, len(term) - 1), lambda i: substr(term, i, 3))) as gram from v")
def char_ngrams(t: Tables) -> DataFrame:
    return t.index.vocabulary().select("term", F.explode(X.ngrams(F.col("term"), 3, 3)).alias("gram"))


@query(f"with {TEXT}, v as (select term from df where len(term) >= 2) select term, unnest(list_transform(range(2, least(len(term), 9) + 1), lambda i: substr(term, 1, i))) as gram from v")
def edge_ngrams(t: Tables) -> DataFrame:
    return t.index.vocabulary().select("term", F.explode(X.edge_ngrams(F.col("term"), 2, 9)).alias("gram"))


@query(f"with b as (select item_id, list_sort(list_distinct({_T})) as t from benchmark) select item_id, array_to_string(t, ' ') as fingerprint from b")
def fingerprint(t: Tables) -> DataFrame:
    return _short(t).select("item_id", X.fingerprint(F.col("t")).alias("fingerprint"))


_STOP = ", ".join(f"'{w}'" for w in X.ENGLISH_STOP_WORDS)


@query(f"with {TEXT}, k as (select doc_id, len(list_filter(t, lambda x: x not in ({_STOP}))) as n from tok) select doc_id, cast(n as integer) as n from k")
def stopword_filter(t: Tables) -> DataFrame:
    return t.index.docs.select("doc_id", F.size(X.stop(F.col("tokens"))).alias("n"))


@query("with p as (select page_id, string_split(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/') as p from pages), e as (select page_id, unnest(list_filter(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/')), lambda x: x <> '')) as path from p) select path, count(*) as n from e group by path")
def path_hierarchy(t: Tables) -> DataFrame:
    paths = t.pages.select(X.path_hierarchy(F.regexp_extract("url", "^[a-z]+://[^/?#]*(/[^?#]*)", 1)).alias("p"))
    return paths.select(F.explode("p").alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query(f"with {TEXT}, w as (select distinct lower(term) as term from df) select term, regexp_replace(term || '''s', '[''][sS]$', '') as bare from w")
def possessive_strip(t: Tables) -> DataFrame:
    v = t.index.vocabulary().select(F.lower("term").alias("term")).distinct()
    return v.select("term", F.get(X.possessive(F.array(F.concat("term", F.lit("'s")))), F.lit(0)).alias("bare"))


@query("select doc_id, len(regexp_extract_all(lower(text), '\\p{L}+')) as n from documents")
def letter_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.letters(F.lower("text"))).cast("long").alias("n"))


@query(f"with b as (select item_id, {_T} as t from benchmark), p as (select item_id, unnest(list_concat(t, list_filter(list_transform(range(1, len(t)), lambda i: case when t[i] in ('the', 'of') or t[i + 1] in ('the', 'of') then t[i] || '_' || t[i + 1] end), lambda x: x is not null))) as token from b) select item_id, token from p")
def common_grams(t: Tables) -> DataFrame:
    return _short(t).select("item_id", F.explode(X.common_grams(F.col("t"), ["the", "of"])).alias("token"))


@query("select page_id, regexp_replace(html, '<.*>', '', 'g') as text from pages")
def strip_tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query()
def porter_stems(t: Tables) -> DataFrame:
    """Stems of the vocabulary: each word is stemmed once, however often it occurs; what is no word of small letters stays."""
    return t.index.vocabulary().select("term", X.porter_stem("term").alias("stem"))


@query()
def english_analyzer(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.english(F.col("text")).alias("tokens"))


@query()
def min_hash(t: Tables) -> DataFrame:
    return t.index.docs.select("doc_id", X.min_hash(X.shingles(F.col("tokens"), 5, 5), 16).alias("hashes"))


@query("select item_id, lpad(cast(item_id as varchar), 6, '0') as padded, bit_length(text) // 8 as bytes from benchmark")
def fill_zeros(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.fill_zeros(F.col("item_id").cast("string"), 6).alias("padded"), F.octet_length("text").cast("long").alias("bytes"))


# --- suggestions


@query(f"with {TEXT} select term, df as weight from df where starts_with(term, 'th') order by (term = 'th') desc, weight desc, term limit 10")
def suggest_prefix(t: Tables) -> DataFrame:
    return suggest.complete(t.index.vocabulary().select("term", F.col("df").alias("weight")), "th", 10)


@query(f"with {TEXT}, m as (select term, df, list_aggregate([levenshtein(substr(term, 1, 3), 'tion'), levenshtein(substr(term, 1, 4), 'tion'), levenshtein(substr(term, 1, 5), 'tion')], 'min') as d from df where starts_with(term, 't')) select term, df as weight from m where d <= 1 order by weight desc, term limit 10")
def suggest_fuzzy(t: Tables) -> DataFrame:
    return suggest.complete_fuzzy(t.index.vocabulary().select("term", F.col("df").alias("weight")), "tion", 10)


@query("with p as (select p_name as term, sum(p_size) as weight from part group by p_name), a as (select term, weight, list_position(list_transform(string_split(term, ' '), lambda w: starts_with(w, 'wi')), true) - 1 as place from p) select term, cast(floor(weight * (1 - 0.1 * place)) as bigint) as score from a where place >= 0 order by score desc, term limit 10")
def suggest_infix(t: Tables) -> DataFrame:
    names = t.part.groupBy(F.col("p_name").alias("term")).agg(F.sum("p_size").alias("weight"))
    return suggest.complete_infix(names, "wi", 10)


@query(f"with {TEXT} select term, round(1 - damerau_levenshtein(term, 'thebl') / least(len(term), 5), 6) as score, df from df where damerau_levenshtein(term, 'thebl') <= 2 and starts_with(term, 't') and abs(len(term) - 5) <= 2 and term <> 'thebl' and 1 - damerau_levenshtein(term, 'thebl') / least(len(term), 5) >= 0.5 and not exists (select 1 from df where term = 'thebl') order by score desc, df desc, term limit 10")
def spell_candidates(t: Tables) -> DataFrame:
    v, n = t.index.vocabulary().select("term", "df"), t.index.stats().select("n").scalar()
    return suggest.spell_candidates(v, n, "thebl", 10).select("term", F.round("score", 6).alias("score"), "df")


@query(f"with {TEXT}, c as (select substr('thewith', 1, i) as l, substr('thewith', i + 1) as r from (select unnest(range(1, 7)) as i)), dw as (select term, count(distinct doc_id) as df from (select doc_id, unnest(list_filter(t, lambda x: starts_with('thewith', x) or ends_with('thewith', x))) as term from tok) group by term) select l as \"left\", r as \"right\", least(a.df, b.df) as df from c join dw a on a.term = l join dw b on b.term = r")
def word_break(t: Tables) -> DataFrame:
    return suggest.word_breaks(t.index.vocabulary(), "thewith")


@query(f"with {TEXT} select term, df from df cross join st where df >= 0.3 * n")
def frequent_dictionary(t: Tables) -> DataFrame:
    return suggest.frequent_dictionary(t.index.vocabulary(), t.index.stats().select("n").scalar(), 0.3).select("term", "df")


@query()
def jaro_winkler(t: Tables) -> DataFrame:
    return t.index.vocabulary().select("term", F.round(suggest.likeness("thinx", suggest.jaro_winkler)(F.col("term")), 6).alias("likeness"))


# --- classification and quality

_NB = f"""
with {TEXT}, lab as (select doc_id, toxic as label from labels where toxic is not null),
each as (select label, unnest(t) as term from tok join lab using (doc_id)),
c as (select term, label, count(*) as c from each group by all),
v as (select count(distinct term) as v from c),
cls as (select label, ln(count(*) / (select count(*) from lab)) as prior from lab group by label),
tot as (select label, sum(c) + (select v from v) as base from c group by label),
test as (select doc_id from labels where toxic is not null),
own as (select doc_id, term, tf from tf join test using (doc_id) where term in (select term from c)),
sc as (select doc_id, label, prior + coalesce(sum(tf * ln((coalesce(c, 0) + 1) / base)), 0) as score
  from test cross join cls join tot using (label) left join own using (doc_id) left join c using (term, label) group by doc_id, label, prior)
select doc_id, label, round(score, 4) as score from (select *, row_number() over (partition by doc_id order by score desc, label desc) as k from sc) where k = 1
"""


@query(_NB)
def naive_bayes(t: Tables) -> DataFrame:
    """Learned from the labelled documents and applied to them."""
    docs = t.index.docs.select("doc_id", "tokens").join(t.labels.filter("toxic is not null").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    out = classify.naive_bayes(docs, docs)
    return out.select("doc_id", "label", F.round("score", 4).alias("score"))


_HITS = f"""
with {TEXT}, q as (select item_id as query_id, {_T} as t from benchmark),
slots as (select query_id, unnest(t) as term, len(t) as m from q),
s as (select doc_id, term, {LOSSY} as s from tf join df using (term) join dl using (doc_id) cross join st where term in (select term from slots)),
h as (select query_id, m, doc_id, sum(s) as score, count(*) as met from slots join s using (term) group by all),
r as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from h where met = m),
hits as (select * from r where rank <= 10)
"""


def _hits(t: Tables) -> DataFrame:
    log = t.benchmark.select(F.col("item_id").alias("query_id"), X.split_space(F.col("text")).alias("terms"))
    return batch_search(t.index, log, 10)


@query(f"{_HITS}, v as (select query_id, source, count(*) as votes from hits join documents using (doc_id) group by all) select query_id, source, votes from (select *, row_number() over (partition by query_id order by votes desc, source) as k from v) where k = 1")
def knn_vote(t: Tables) -> DataFrame:
    return classify.vote(t.documents.select("doc_id", "source").join(F.broadcast(_hits(t)), "doc_id"), "source")


_QUALITY = f"""
{_HITS}, rel as (select query_id, doc_id from (select distinct query_id from hits) cross join labels where quality = 1),
j as (select query_id, doc_id, rank, case when doc_id in (select doc_id from labels where quality = 1) then 1 else 0 end as rel from hits),
c as (select *, sum(rel) over (partition by query_id order by rank) as so_far from j),
n as (select count(*) as total from (select distinct doc_id from labels where quality = 1))
select query_id, round(sum(case when rank <= 5 then rel else 0 end) / 5, 6) as p5, round(sum(rel) / any_value(total), 6) as recall,
  round(sum(case when rel = 1 then so_far / rank else 0 end) / any_value(total), 6) as average_precision,
  round(coalesce(1 / min(case when rel = 1 then rank end), 0), 6) as reciprocal_rank
from c cross join n group by query_id
"""


@query(_QUALITY)
def search_quality(t: Tables) -> DataFrame:
    """Documents of good quality as the relevant ones of every query."""
    good = t.labels.filter("quality = 1").select("doc_id").distinct()
    out = classify.quality(_hits(t), good, at=(5,))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("p5", "recall", "average_precision", "reciprocal_rank")])


@query()
def dataset_split(t: Tables) -> DataFrame:
    return classify.split(t.labels, "doc_id").groupBy("part").agg(F.count("*").alias("n"))


# --- logs

_LOG = f"(select conv_id, turn, {_T} as t from conversations where role = 'user')"


def _log(t: Tables) -> DataFrame:
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", X.split_space(F.coalesce("text", F.lit(""))).alias("t"))


@query("with e as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) select count(*) as total, count(distinct event_type) as \"distinct\", cast(count_if(b = event_type) as bigint) as repeats from e")
def log_stats(t: Tables) -> DataFrame:
    return logs.summary(t.events, "event_type", ["user_id", "ts", "event_id"])


@query(f"with l as {_LOG} select cast(len(t) as integer) as terms, count(*) as queries, round(count(*) / (select count(*) from l), 6) as share from l group by len(t)")
def log_terms_per_query(t: Tables) -> DataFrame:
    return logs.terms_per_query(_log(t), F.col("t")).select("terms", "queries", F.round("share", 6).alias("share"))


@query(f"with {TEXT}, top as (select term from df order by df desc, term limit 20), m as (select doc_id, term from tf where term in (select term from top)) select a.term as a, b.term as b, count(*) as n from m a join m b on a.doc_id = b.doc_id and a.term < b.term group by all")
def term_pair_cooccurrence(t: Tables) -> DataFrame:
    chosen = t.index.vocabulary().orderBy(F.desc("df"), "term").limit(20)
    return logs.pair_counts(t.index.docs, "doc_id", F.col("tokens"), chosen)


@query("with e as (select event_id - lag(event_id) over (partition by user_id order by event_id) as gap from events) select count(*) as events, cast(count_if(gap <= 50) as bigint) as local, round(count_if(gap <= 50) / count(*), 6) as share from e")
def locality_window(t: Tables) -> DataFrame:
    return logs.locality(t.events, "user_id", "event_id", 50).select("events", "local", F.round("share", 6).alias("share"))


@query(f"with {TEXT} select cast(len(cast(ctf as varchar)) - 1 as integer) as decade, count(*) as terms from df group by all")
def decade_histogram(t: Tables) -> DataFrame:
    return logs.decade_histogram(t.index.vocabulary(), "ctf")


@query("select 0.5e0 as p, round(quantile_cont(value, 0.5), 6) as value from events union all select 0.95e0, round(quantile_cont(value, 0.95), 6) from events union all select 0.99e0, round(quantile_cont(value, 0.99), 6) from events")
def latency_percentiles(t: Tables) -> DataFrame:
    return logs.percentiles(t.events, "value", [0.5, 0.95, 0.99]).select("p", F.round("value", 6).alias("value"))


@query("select cast(floor(ln(value) / ln(1.1)) as bigint) as bucket, count(*) as n from events where value > 0 group by all")
def latency_histogram(t: Tables) -> DataFrame:
    return logs.latency_buckets(t.events, "value", 0.1)


@query("with b as (select l_orderkey as o, cast(l_quantity * 512 as bigint) as s from lineitem), e as (select unnest(range(o * 1000 // 4096, (o * 1000 + greatest(s, 1) - 1) // 4096 + 1)) as block from b) select count(*) as touched, count(distinct block) as \"distinct\" from e")
def block_trace(t: Tables) -> DataFrame:
    trace = t.lineitem.select((F.col("l_orderkey") * 1000).alias("offset"), (F.col("l_quantity") * 512).cast("long").alias("size"))
    return logs.blocks(trace, "offset", "size").agg(F.count("*").alias("touched"), F.count_distinct("block").alias("distinct"))


@query(f"with {TEXT}, a as (select term, df from df), b as (select term, count(*) as df from (select distinct item_id, unnest({_T}) as term from benchmark) group by term) select coalesce(a.term, b.term) as term, coalesce(a.df, 0) as ours, coalesce(b.df, 0) as theirs from a full join b on a.term = b.term where coalesce(a.df, 0) <> coalesce(b.df, 0)")
def doc_freq_mismatch(t: Tables) -> DataFrame:
    theirs = _short(t).select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return logs.doc_freq_mismatch(t.index.vocabulary(), theirs)


@query("with recursive e as (select user_id, list(event_id order by event_id) as ids from events group by user_id), k as (select user_id, ids, 1 as i, ids[1] as last, true as kept from e union all select user_id, ids, i + 1, case when ids[i + 1] - last > 200 then ids[i + 1] else last end, ids[i + 1] - last > 200 from k where i < len(ids)) select user_id, ids[i] as event_id from k where kept")
def unique_in_window(t: Tables) -> DataFrame:
    return logs.unique_in_window(t.events, "user_id", "event_id", 200)


# --- snippets and line documents


@query(f"with {TEXT}, p as (select doc_id, list_filter(regexp_extract_all(text, '[^.]*\\.?'), lambda x: x <> '') as p from documents), e as (select doc_id, unnest(p) as passage, unnest(range(len(p))) as i from p) select doc_id, cast(coalesce(sum(len(passage)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as integer) as start, passage from e")
def passages(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(highlight.passages_of(F.col("text"))).alias("x"))
    return rows.select("doc_id", "x.start", "x.passage")


@query()
def snippets(t: Tables) -> DataFrame:
    """The top hits of a word with their best passages."""
    return highlight.highlight(search(t.index, Term("the")), t.documents, ["the"])


@query("with b as (select item_id, list_filter(string_split(regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g'), ' '), lambda x: x <> '') as t from benchmark), u as (select item_id, unnest(t) as term, unnest(range(len(t))) as pos from b) select item_id, term, cast(count(*) as integer) as tf, array_to_string(list(cast(pos as varchar) order by pos), ';') as positions from u group by all")
def line_doc_round_trip(t: Tables) -> DataFrame:
    """Benchmark texts as lines with offsets and positions, parsed back to postings."""
    lines = linedocs.lines(t.benchmark, "item_id", "text")
    docs = linedocs.parse(lines, "WITH_POSITIONS").withColumn("doc_id", F.col("title").cast("long"))
    rows = linedocs.postings(docs)
    return rows.select(F.col("doc_id").alias("item_id"), "term", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ";").alias("positions"))


@query("select item_id as query_id, text like '\"%' and text like '%\"' as is_phrase, cast(len(list_filter(string_split(trim(text), ' '), lambda x: x <> '')) as integer) as terms from benchmark")
def query_log_parse(t: Tables) -> DataFrame:
    log = linedocs.query_log(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("value")))
    return log.select("query_id", "is_phrase", F.size("terms").alias("terms"))
