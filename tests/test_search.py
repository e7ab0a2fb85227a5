"""Search on small corpora with known answers."""

import pytest
from pyspark.sql import functions as F

from sparquill.functions import similarity
from sparquill.functions import text as X
from sparquill.operators import highlight, parser, spans
from sparquill.operators.index import Index, open_index
from sparquill.operators.query import Bool, DisMax, Phrase, SloppyPhrase, Term, all_of, any_of, batch_search, edits, search


@pytest.fixture(scope="module")
def three(spark):
    return Index.build(spark.createDataFrame([(0, "hello world"), (1, "hello wisconsin"), (2, "hello world big world")], "doc_id long, text string"))


def found(df):
    return [(r.doc_id, float(f"{r.score:.3g}")) for r in df.collect()]  # known scores have three significant digits


def test_scores(three):
    assert found(search(three, Term("wisconsin"))) == [(1, 1.09)]
    assert found(search(three, Term("hello"))) == [(0, 0.149), (1, 0.149), (2, 0.111)]
    assert sorted(s for _, s in found(search(three, all_of(["hello", "world"])))) == [0.672, 0.677]
    assert three.vocabulary().count() == 4


def test_empty_answers(three):
    assert found(search(three, all_of([]))) == []
    assert found(search(three, all_of(["hello", "absent"]))) == []
    assert found(search(three, all_of(["hello"]), k=0)) == []


def test_duplicate_terms_count_twice(three):
    once, twice = ({r.doc_id: r.score for r in search(three, q, digits=None).collect()} for q in (Term("world"), all_of(["world", "world"])))
    assert len(once) == 2 and twice == pytest.approx({d: 2 * s for d, s in once.items()})


def test_table_and_arrays_agree(three, spark, tmp_path):
    three.save(str(tmp_path))
    saved = open_index(spark, f"index:saved:{tmp_path}")
    for q in (all_of(["hello", "world"]), any_of(["big", "wisconsin"]), Phrase(["hello", "world"]), Bool(must=[Term("hello")], must_not=[Term("big")])):
        assert found(search(three, q)) == found(search(saved, q))
    assert {(r.term, r.df) for r in saved.doc_freqs(["hello", "zzz"]).collect()} == {("hello", 3), ("zzz", 0)}
    with pytest.raises(ValueError):
        open_index(spark, "index:other:x")


def test_batch(three, spark):
    log = spark.createDataFrame([(7, ["hello", "world"]), (8, ["absent"]), (9, ["wisconsin"])], "query_id int, terms array<string>")
    got = [(r.query_id, r["rank"], r.doc_id) for r in batch_search(three, log).orderBy("query_id", "rank").collect()]
    assert sorted((q, d) for q, _, d in got) == [(7, 0), (7, 2), (9, 1)]


def test_batch_shuffles_no_postings(spark, tmp_path):
    """Queries of one frequent and one rare word: documents are never dealt out by term or by document, and a saved index answers alike."""
    index = Index.build(spark.createDataFrame([(i, f"the the w{i % 20}") for i in range(60)], "doc_id long, text string"))
    log = spark.createDataFrame([(q, ["the", f"w{q}", "the"]) for q in range(5)] + [(9, ["the", "absent"])], "query_id int, terms array<string>")
    out = batch_search(index, log, k=2)
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in out.collect())
    assert got == [(q, r, q + 20 * (r - 1)) for q in range(5) for r in (1, 2)]
    dealt = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "SortMergeJoin" in x or "Aggregate" in x]
    assert dealt and not any("doc_id" in x for x in dealt)
    index.save(str(tmp_path))
    assert sorted(batch_search(Index.load(spark, str(tmp_path)), log, k=2).collect()) == sorted(out.collect())


def test_frequencies_need_no_shuffle(spark):
    index = Index.build(spark.createDataFrame([(0, "b a b"), (1, ""), (2, None), (3, "a")], "doc_id long, text string"))
    rows = index.frequencies()
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 0, 1), ("a", 3, 1), ("b", 0, 2)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("a", "b", "n"),
    [([1, 3, 5], [4], 1), ([1, 8, 20], [0, 7, 19], 0), ([0], [0], 0), ([10], [], 0), ([10, 20, 100, 1000], [11, 21, 88, 101], 3)],
)
def test_phrase_positions(spark, a, b, n):
    size = max([*a, *b]) + 1
    words = ["a" if i in a else "b" if i in b else "x" for i in range(size)]
    if set(a) & set(b):
        return
    index = Index.build(spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string"))
    got = Phrase(["a", "b"]).matches(index).collect()
    assert sum(len(r.starts) for r in got) == n


def test_sloppy(spark):
    index = Index.build(spark.createDataFrame([(0, "a x b"), (1, "b a"), (2, "a x x x x b")], "doc_id long, text string"))
    assert sorted(d for d, _ in found(search(index, SloppyPhrase(["a", "b"], 1)))) == [0]
    assert sorted(d for d, _ in found(search(index, SloppyPhrase(["a", "b"], 2)))) == [0, 1]


def test_edits():
    assert edits("ab", "ba", 2) == 1
    assert edits("kitten", "sitting", 3) == 3
    assert edits("a", "abcdef", 2) == 3


def test_null_text_and_extra_columns(spark):
    index = Index.build(spark.createDataFrame([(0, None, 1.0), (1, "a", 2.0)], "doc_id long, text string, score double"))
    assert found(search(index, Term("a"), digits=None))[0][0] == 1
    assert index.stats().first().n == 2


def test_dismax_and_models(three):
    both = dict(found(search(three, DisMax([Term("hello"), Term("world")]))))
    assert both[0] == max(dict(found(search(three, Term("hello"))))[0], dict(found(search(three, Term("world"))))[0])
    for name in ("classic", "lm_dirichlet", "dfi_saturated", "ib_spl_ttf_h1", "dfr_ine_b_h3"):
        assert len(found(search(three, Term("world", similarity.MODELS[name])))) == 2


def test_bm25_parts(spark):
    row = spark.range(1).select(similarity.bm25_idf(F.lit(1), F.lit(1)).alias("a"), similarity.bm25_idf(F.lit(1), F.lit(3)).alias("b"), similarity.bm25_tf(F.lit(1), F.lit(3), F.lit(3)).alias("c"), similarity.bm25_tf(F.lit(1), F.lit(2), F.lit(8 / 3)).alias("d")).first()
    assert [round(x, 3) for x in (row.a, row.b, row.c)] == [0.288, 0.981, 1.0]
    assert round(row.d, 2) == 1.11


def test_basic_models(spark):
    import math

    n, ctf, f, log2 = 1000, 40, 2.5, math.log2
    total = ctf + 1 + f
    big = total + n
    part = lambda a, b: (b + 0.5) * log2(a / b) + (a - b) * log2(a)
    share, chance, mean, lam = f / total, 1 / (n + 1), (ctf + 1) / (n + 1), (ctf + 1) / (n + ctf + 1)
    want = {
        "be": -log2((big - 1) * math.e) + part(big + total - 1, big + total - f - 2) - part(total, total - f),
        "d": total * (share * log2(share / chance) + (1 - share) * log2((1 - share) / (1 - chance))) + 0.5 * log2(1 + 2 * math.pi * f * (1 - share)),
        "p": f * log2(f / mean) + (mean + 1 / (12 * f) - f) * log2(math.e) + 0.5 * log2(2 * math.pi * f),
        "g": log2(lam + 1) + f * log2((1 + lam) / lam),
    }
    one = F.lit(1.0)
    stats = similarity.Stats(one, one, F.lit(ctf), one, F.lit(n), one, one)
    row = spark.range(1).select(*[similarity.BASIC[k](stats, F.lit(f)).alias(k) for k in want]).first()
    assert row.asDict() == pytest.approx(want)


def test_length_byte(spark):
    got = [r.q for r in spark.createDataFrame([(x,) for x in (0, 1, 7, 8, 17, 0x85, 1000)], "n int").select(X.four_bits(F.col("n")).alias("q")).collect()]
    assert got == [0, 1, 7, 8, 16, 0x80, 960]


def test_snippets():
    mark = lambda text, *terms: highlight.snippet(text, highlight.found(text, terms))
    assert mark("hello world", "hello") == "<b>hello<\\b> world\n"
    assert mark("hello world", "hello", "world") == "<b>hello<\\b> <b>world<\\b>\n"
    assert mark("hello world big world", "hello", "world") == "<b>hello<\\b> <b>world<\\b> big <b>world<\\b>\n"
    assert mark("0", "0") == "<b>0<\\b>\n"
    assert mark("nothing here", "x") == ""
    assert highlight.snippet("a b. c d. a e.", highlight.found("a b. c d. a e.", ["a"]), 1).startswith("<b>a<\\b> b.")


def test_spans(spark):
    index = Index.build(spark.createDataFrame([(0, "a b c a x x b")], "doc_id long, text string"))
    a, b = spans.term(index, "a"), spans.term(index, "b")
    pairs = lambda df: sorted((r.start, r.end) for r in df.collect())
    assert pairs(spans.near([a, b], 0)) == [(0, 2)]
    assert pairs(spans.near([a, b], 2)) == [(0, 2), (3, 7)]
    assert pairs(spans.near([a, b], 1, ordered=False)) == [(0, 2), (1, 4)]
    assert pairs(spans.excluding(a, b, 0, 1)) == [(3, 4)]
    assert pairs(spans.first(a, 1)) == [(0, 1)]


@pytest.mark.parametrize(
    ("text", "ids"),
    [("hello", [0, 1, 2]), ("+hello -big", [0, 1]), ('"hello world"', [0, 2]), ("hello AND (big OR wisconsin)", [1, 2]), ("wis*", [1]), ("w?sconsin", [1]), ("worlt~1", [0, 2]), ('"world hello"~4', [0, 2]), ("[big TO hello}", [2]), ("hello NOT world", [1])],
)
def test_classic(three, text, ids):
    assert sorted(r.doc_id for r in parser.classic(text).hits(three).collect()) == ids


@pytest.mark.parametrize("text", ["(a", "a)", '"'])
def test_classic_errors(text):
    with pytest.raises(ValueError):
        parser.classic(text)


@pytest.mark.parametrize(("text", "ids"), [("hello AND world", [0, 2]), ("hello W world", [0, 2]), ("hello NOT world", [1]), ("world 2N hello", [0, 2]), ("or(big, wisconsin)", [1, 2]), ("wisc*", [1]), ("hello 3W big", [2])])
def test_surround(three, text, ids):
    assert sorted(r.doc_id for r in parser.surround(text).hits(three).collect()) == ids


def test_surround_errors():
    for text in ("ab*", "AND a", "(a"):
        with pytest.raises(ValueError):
            parser.surround(text)


def test_xml(three):
    ids = lambda x: sorted(r.doc_id for r in parser.from_xml(x).hits(three).collect())
    assert ids("<TermQuery>big</TermQuery>") == [2]
    assert ids('<BooleanQuery><Clause occurs="must"><TermQuery>hello</TermQuery></Clause><Clause occurs="mustNot"><TermQuery>world</TermQuery></Clause></BooleanQuery>') == [1]
    assert ids('<SpanNear slop="1" inOrder="true"><SpanTerm>hello</SpanTerm><SpanTerm>big</SpanTerm></SpanNear>') == [2]
    assert parser.template("<TermQuery>${w}</TermQuery>", {"w": "a<b"}) == "<TermQuery>a&lt;b</TermQuery>"
    with pytest.raises(ValueError):
        ids("<Nothing/>")
