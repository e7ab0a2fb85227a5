"""Column functions: expressions, places, dates, addresses, analysis, suggestions, sources, logs, streams."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparquill.functions import geo, values
from sparquill.functions import text as X
from sparquill.operators import classify, logs, ranking, suggest
from sparquill.operators.index import Index
from sparquill.sources import linedocs
from sparquill.streaming import search as streams


@pytest.mark.parametrize(
    ("text", "want"),
    [("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-2 ^ 1", -1), ("7 % 4", 3), ("1 / 0", math.inf), ("0x10 + 010", 24), ("1 < 2 && 2 < 1", 0), ("!0 ? 5 : 6", 5), ("~1", -2), ("1 << 3 >> 1", 4), ("max(1, min(5, 3))", 3), ("logn(2, 8)", 3), ("pow(2, 10)", 1024), ("sqrt(16) + abs(-1)", 5), ("x * 2", 10), ("a.b[1]", 8), ("1 == 1", 1), ("5 & 3 | 8", 9), ("-8 >>> 60", 15)],
)
def test_expression(spark, text, want):
    row = spark.range(1).select(F.lit(5).alias("x"), F.struct(F.array(F.lit(7), F.lit(8)).alias("b")).alias("a"))
    assert row.select(values.expression(text)).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("text", ["1 +", "foo(1)", "pow(1)", "(1", "1 2", "#"])
def test_expression_errors(spark, text):
    with pytest.raises(ValueError):
        values.expression(text)


def test_divide(spark):
    got = spark.range(1).select(*[values.divide(F.lit(a), F.lit(b)) for a, b in ((1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0))]).first()
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 0.25


def plain_geohash(lat, lon, length):
    ends, out = {0: [-180.0, 180.0], 1: [-90.0, 90.0]}, ""
    for k in range(length):
        code = 0
        for i in range(5 * k, 5 * k + 5):
            own, x = ends[i % 2], (lon, lat)[i % 2]
            half = sum(own) / 2
            code = code * 2 + (x >= half)
            own[int(x < half)] = half
        out += "0123456789bcdefghjkmnpqrstuvwxyz"[code]
    return out


def test_places(spark):
    p = spark.createDataFrame([(1, 48.85, 2.35), (2, 51.5, -0.12), (3, 0.0, 179.9), (4, 0.0, -179.9)], "id int, lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    ids = lambda c: sorted(r.id for r in p.filter(c).collect())
    assert ids(geo.near(lat, lon, 48.85, 2.35, 400_000)) == [1, 2]
    assert ids(geo.near(lat, lon, 0.0, 180.0, 50_000)) == [3, 4]
    assert ids(geo.box(lat, lon, -1, 1, 179, -179)) == [3, 4]
    assert ids(geo.in_polygon(lat, lon, [40, 40, 60, 60, 40], [-5, 10, 10, -5, -5])) == [1, 2]
    assert [r.id for r in geo.nearest(p, "lat", "lon", 50.0, 1.0, 2, "id").collect()] == [1, 2]
    assert [r[0] for r in p.orderBy("id").select(geo.geohash(lat, lon, 7)).collect()] == [plain_geohash(r.lat, r.lon, 7) for r in p.orderBy("id").collect()]
    assert p.filter("id = 1").select(geo.quad_key(lat, lon, 3)).first()[0] == "BAC"  # north-east; there the upper half, west; there the lower half, west
    lats, lons, holes = geo.polygons('{"type": "Polygon", "coordinates": [[[0, 1], [2, 1], [2, 3], [0, 1]]]}')[0]
    assert (lats, lons, holes) == ([1, 1, 3, 1], [0, 2, 2, 0], [])


def test_addresses(spark):
    rows = spark.createDataFrame([("10.1.2.3",), ("11.0.0.1",), ("::ffff:10.2.0.0",), ("x",), (None,)], "a string")
    assert [r.a for r in rows.filter(geo.inet_in(geo.inet(F.col("a")), "10.0.0.0/8")).collect()] == ["10.1.2.3", "::ffff:10.2.0.0"]


def test_dates(spark):
    assert geo.date_range("2024-02") == ("2024-02-01 00:00:00", "2024-03-01 00:00:00")
    assert geo.date_range("[2023 TO *]") == ("2023-01-01 00:00:00", None)
    row = spark.range(1).select(F.to_timestamp(F.lit("2024-05-06 07:08:09")).alias("t"))
    assert row.select(geo.date_string(F.col("t"), "hour")).first()[0] == "2024050607"
    assert str(row.select(geo.parse_date_string(F.lit("202405"))).first()[0]) == "2024-05-01 00:00:00"


def test_ranges(spark):
    r = spark.createDataFrame([(1, 0, 5), (2, 3, 9), (3, 4, 5), (4, 10, 12)], "id int, low int, high int")
    ids = lambda kind: sorted(x.id for x in r.filter(geo.range_relation([(F.col("low"), F.col("high"))], [(4, 6)], kind)).collect())
    assert (ids("intersects"), ids("within"), ids("contains"), ids("crosses")) == ([1, 2, 3], [3], [2], [1, 2])


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("conditional", "condit"), ("electriciti", "electr"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("happy", "happi")])
def test_porter(word, stem):
    assert X.porter(word) == stem


def test_analysis(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    tokens = F.array(*map(F.lit, ["the", "quick", "fox", "the"]))
    assert one(X.split_space(F.lit(" a  b "))) == ["a", "b"]
    assert one(X.split_strict(F.lit("a\t\tb"), "\t")) == ["a", "", "b"]
    assert one(X.stop(tokens)) == ["quick", "fox"]
    assert one(X.fingerprint(tokens)) == "fox quick the"
    assert one(X.shingles(tokens, 2, 3)) == ["the quick", "the quick fox", "quick fox", "quick fox the", "fox the"]
    assert one(X.ngrams(F.lit("abc"), 2, 3)) == ["ab", "abc", "bc"]
    assert one(X.ngrams(F.lit("a"), 2, 3)) == []
    assert one(X.edge_ngrams(F.lit("abc"), 1, 5)) == ["a", "ab", "abc"]
    assert one(X.path_hierarchy(F.lit("/a/b"))) == ["/a", "/a/b"]
    assert one(X.possessive(F.array(F.lit("dog's"), F.lit("dogs")))) == ["dog", "dogs"]
    assert one(X.synonyms(F.array(F.lit("a"), F.lit("b")), {"a": ["x", "y"]})) == ["a", "x", "y", "b"]
    assert one(X.ascii_fold(F.lit("Éléç"))) == "Elec"
    assert one(X.fill_zeros(F.lit("12345"), 3)) == "12345"
    assert one(X.fill_zeros(F.lit("7"), 3)) == "007"
    assert one(X.english(F.lit("The dog's <b>running</b>"))) == ["dog", "run"]
    assert one(X.trim_white(F.lit("\t a b \n"))) == "a b"


def test_likeness():
    assert suggest.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-3)
    assert suggest.jaro_winkler("DWAYNE", "DUANE") == pytest.approx(0.84, abs=5e-3)
    assert suggest.jaro_winkler("abc", "xyz") == 0
    assert suggest.ngram_likeness("abc", "abc") == 1
    assert suggest.ngram_likeness("university", "univearsitty") > 0.7
    assert suggest.ngram_likeness("", "a") == 0


def test_suggest(spark):
    d = spark.createDataFrame([("wide", 5), ("wife", 9), ("wire fox", 7), ("red wine", 20), ("w", 1)], "term string, weight long")
    names = lambda df: [r.term for r in df.collect()]
    assert names(suggest.complete(d, "w", 3)) == ["w", "wife", "wire fox"]
    assert names(suggest.complete(d, "w", 3, exact_first=False)) == ["wife", "wire fox", "wide"]
    assert names(suggest.complete_fuzzy(d, "wif", 5)) == ["wife", "wire fox", "wide"]
    assert names(suggest.complete_regex(d, "w.d", 5)) == ["wide"]
    assert names(suggest.complete_infix(d, "wi", 1)) == ["red wine"]
    v = spark.createDataFrame([("hello", 10), ("hallo", 3), ("help", 50), ("world", 2)], "term string, df long")
    assert names(suggest.spell_candidates(v, F.lit(100), "helol", 5)) == ["hello", "hallo", "help"]
    assert names(suggest.spell_candidates(v, F.lit(100), "hel", 5)) == []
    assert [(r.left, r.right) for r in suggest.word_breaks(v, "helloworld").collect()] == [("hello", "world")]
    assert names(suggest.word_joins(v, ["hel", "lo", "x"])) == ["hello"]


def test_lines(spark, tmp_path):
    lines = spark.createDataFrame([("FIELDS_HEADER_INDICATOR###\tdoctitle",), ("doc_1\ta a b\ta b\t0,1;2,3;.4,5;.\t0;1;.2;.\ta b!!\ta!a!",)], "value string")
    row = linedocs.parse(lines, "WITH_BI_BLOOM").first()
    assert row.tokens == ["a", "b"] and row.positions == [[0, 1], [2]] and row.phrase_ends == [["a", "b"], []] and row.phrase_begins == [["a"], ["a"]]
    docs = linedocs.parse(lines, "WITH_POSITIONS").withColumn("doc_id", F.lit(1))
    assert sorted((r.term, r.tf, r.positions) for r in linedocs.postings(docs).collect()) == [("a", 2, [0, 1]), ("b", 1, [2])]
    made = linedocs.lines(spark.createDataFrame([("t", "a a b")], "title string, body string"))
    assert made.first().value == "t\ta a b\ta b\t0,0;2,2;.4,4;.\t0;1;.2;."
    with pytest.raises(ValueError):
        linedocs.parse(lines, "OTHER")
    d = spark.createDataFrame([(i, f"t{i}", "d", f"x\ty {i}") for i in range(20)], "doc_id long, title string, date string, body string").orderBy("doc_id")
    linedocs.write(d, str(tmp_path / "lines"))
    back = linedocs.read(spark, str(tmp_path / "lines"))
    assert back.count() == 20 and sorted(r.doc_id for r in back.collect()) == list(range(20))


def test_query_log(spark):
    log = linedocs.query_log(spark.createDataFrame([(0, '"greek armi"  '), (1, "hello  world"), (2, '"')], "query_id long, value string")).orderBy("query_id").collect()
    assert [(r.terms, r.is_phrase) for r in log] == [(["greek", "armi"], True), (["hello", "world"], False), (['"'], False)]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(linedocs.clean_search_log(F.lit("12\tbig dog\t2006-03-01"))) == '"big" AND "dog"'
    assert one(linedocs.clean_trace(F.lit("http://x/?search=a+b&y=1"))) == "a b"
    assert one(linedocs.close_quote(F.lit('"a'))) == '"a"'


def test_trec(spark):
    text = spark.createDataFrame([("<DOC><DOCNO> A1 </DOCNO><HEADLINE>Head</HEADLINE><TEXT><P>Some text</P></TEXT></DOC><DOC><DOCNO>A2</DOCNO><TEXT>b</TEXT></DOC>",)], "value string")
    assert [(r.docno, r.title, r.body) for r in linedocs.trec_documents(text).collect()] == [("A1", "Head", "Some text"), ("A2", "", "b")]
    assert linedocs.trec_qrels(spark.createDataFrame([("101 0 A1 1",), ("bad",)], "value string")).collect()[0].relevant


def test_logs(spark):
    e = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "i long, t string")
    assert logs.locality(e, "t", "i", 2).first().local == 8
    assert [r.i for r in logs.unique_in_window(e, "t", "i", 3).orderBy("i").collect()] == [0, 1, 4, 5, 8, 9]
    assert [(r.decade, r.terms) for r in logs.decade_histogram(spark.createDataFrame([(1,), (9,), (10,), (1000,)], "n long"), "n").orderBy("decade").collect()] == [(0, 2), (1, 1), (3, 1)]


def test_quality(spark):
    ranked = spark.createDataFrame([(1, d, r) for r, d in enumerate([5, 6, 7, 8], 1)], "query_id int, doc_id int, rank int")
    rel = spark.createDataFrame([(1, 5), (1, 7), (1, 99)], "query_id int, doc_id int")
    row = classify.quality(ranked, rel, at=(2,)).first()
    assert (row.p2, row.reciprocal_rank) == (0.5, 1.0) and row.recall == pytest.approx(2 / 3) and row.average_precision == pytest.approx((1 + 2 / 3) / 3)


def test_quality_of_shared_documents(spark):
    """Documents relevant to every query are the same as a pair of each query and document, without the pairs."""
    ranked = spark.createDataFrame([(q, d, r) for q in (1, 2) for r, d in enumerate([5, 6, 7, 4 + q], 1)], "query_id int, doc_id int, rank int")
    good = spark.createDataFrame([(5,), (7,), (99,)], "doc_id int")
    pairs = ranked.select("query_id").distinct().crossJoin(good)
    assert sorted(classify.quality(ranked, good).collect()) == sorted(classify.quality(ranked, pairs).collect())
    none = classify.quality(ranked, good.filter("doc_id < 0")).collect()
    assert len(none) == 2 and all(r.recall == r.average_precision == r.reciprocal_rank == 0 for r in none)


def test_joins(spark):
    hits = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "k int, score double")
    to = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    got = {m: sorted((r.id, r.score) for r in ranking.key_join(to, "id", hits, "k", m).collect()) for m in ("avg", "max", "total")}
    assert got == {"avg": [(1, 3.0), (2, 1.0)], "max": [(1, 4.0), (2, 1.0)], "total": [(1, 6.0), (2, 1.0)]}
    assert [r.id for r in ranking.key_join(to, "id", hits, "k", least=2).collect()] == [1]


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"hello w{i}") for i in range(6)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, ["hello", "w3"])], "query_id long, terms array<string>").write.parquet(str(tmp_path / "queries"))
    q = streams.index_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "index"), str(tmp_path / "c1"), once=True)
    q.awaitTermination(60)
    index = streams.open_generations(spark, str(tmp_path / "index"))
    assert index.vocabulary().count() == 7
    got = []
    q = streams.search_stream(spark.readStream.schema("query_id long, terms array<string>").parquet(str(tmp_path / "queries")), index, lambda df, _: got.extend(df.collect()), str(tmp_path / "c2"), once=True)
    q.awaitTermination(60)
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 3)]


def test_empty_tables(spark):
    index = Index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert index.vocabulary().count() == 0 and index.stats().first().n == 0
    from sparquill.operators.query import all_of, search

    assert search(index, all_of(["a"])).collect() == []


def test_min_hash_hashes_a_token_once(spark):
    """The same values as a hash function each, from one hash of each token; lists longer than a piece, empty and null ones too."""
    rows = [(0, ["a", "b", "ñé"]), (1, []), (2, None), (3, [None, "x"]), (4, ["a b"] * 3), (5, [str(i) for i in range(70_000)]), (6, ["z"])]
    d = spark.createDataFrame(rows, "i int, t array<string>").coalesce(1)
    each = F.array(*[F.expr(f"array_min(transform(t, x -> xxhash64(x, {i})))") for i in range(5)])
    assert all(r.got == r.each for r in d.select(X.min_hash(F.col("t"), 5).alias("got"), each.alias("each")).collect())
    plan = d.select(X.min_hash(X.shingles(F.col("t"), 5, 5), 16))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("array_join(") < 5  # the shingles are not made anew for every hash


def test_offsets_of_long_texts(spark):
    """Offsets of more tokens than a block of running sums has; phrases at both ends, overlapping and beyond the BMP."""
    tokens = [["of", "the", "x" * (i % 7), "😀"][i % 4] or "y" for i in range(1000)] + ["of", "the"]
    texts = [tokens, ["of", "the"], ["the", "of"], [], None, ["a", "a", "a", "b"], ["of", "them", "xof", "the"], ["of"] * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t array<string>").select("i", "t", linedocs.token_offsets(F.col("t")).alias("at"), linedocs.phrase_offsets(F.col("t"), ["of", "the"]).alias("p"), linedocs.phrase_offsets(F.col("t"), ["a", "a"]).alias("q"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "slice" in plan  # arrays grow in blocks, not over a whole text
    for r in rows.collect():
        if r.t is None:
            assert r["at"] is None
            continue
        starts = [sum(map(len, r.t[:i])) + i for i in range(len(r.t))]
        assert [tuple(x) for x in r["at"]] == [(t, s, s + len(t) - 1) for t, s in zip(r.t, starts)]
        for got, pair in ((r.p, ["of", "the"]), (r.q, ["a", "a"])):
            assert [tuple(x) for x in got] == [(starts[i], starts[i] + len(" ".join(pair)) - 1) for i in range(len(r.t) - 1) if r.t[i : i + 2] == pair]


def test_english_keeps_distinct_words_only(spark):
    """Long and short texts, null and empty ones; Python gets the words as an Arrow array, not as a list for each text."""
    texts = ["The dogs' running dog " * 20_000, "", None, "the", "Running, the RUNNERS ran"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, x string").coalesce(1)
    got = {r.i: r.y for r in d.select("i", X.english(F.col("x")).alias("y")).collect()}
    assert got == {0: ["dog", "run", "dog"] * 20_000, 1: [], 2: None, 3: [], 4: ["run", "runner", "ran"]}
    assert "ArrowEvalPython" in d.select(X.english(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    kinds = []
    pieces = X._by_pieces(pa.array([["a"] * 70_000, [], None, ["b"]] * 3), lambda x: kinds.append(len(x)) or X._stemmed(x), pa.string())
    assert len(kinds) > 1 and pieces.to_pylist() == [["a"] * 70_000, [], None, ["b"]] * 3
