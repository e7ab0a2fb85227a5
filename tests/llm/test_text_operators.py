"""HTML extraction, chat formatting, fingerprints, substring deduplication, BPE and WARC against plain versions."""

import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparquill.llm import bpe, chat, gear, html, sketch, warc
from sparquill.llm.queries import vocabulary

# --- html

PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>Home<li>About</ul></nav><div class='ad'>Buy {n}</div><{tag}><h1>Head {n}</h1><p>First &amp; {n}<br>second</p><p>Third  <b>bold</b>\n {n}</p><div class='comments'><p>nice {n}</p></div></{tag}><footer>&copy; host</footer></body></html>"


def texts(spark, rows, **columns):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.extract(df).collect()}


def test_article(spark):
    got = texts(spark, [(i, f"http://h.com/{i}", PAGE.format(n=i, tag="article")) for i in range(6)])
    assert got == {i: f"Head {i}\nFirst & {i}\nsecond\nThird bold {i}" for i in range(6)}


def test_template_alone(spark):
    body = "<html><body><div id=x><span>Company</span></div><div id=y><p>Words of page {n} that go on for a while, as articles do, {n}.</p></div><div id=z>All rights {k}</div></body></html>"
    got = texts(spark, [(i, f"http://t.com/{i}", body.format(n=i, k="reserved")) for i in range(8)])
    assert got[3] == "Words of page 3 that go on for a while, as articles do, 3."


def test_copies_stay_whole(spark):
    got = texts(spark, [(i, f"http://c.com/{i}", PAGE.format(n=1, tag="article")) for i in range(5)])
    assert set(got.values()) == {"Head 1\nFirst & 1\nsecond\nThird bold 1"}


def test_names_of_wrappers(spark):
    for wrapper in ("class='layout has-sidebar'", "id='header-and-content'"):
        page = f"<body><div {wrapper}><{{tag}}><p>The long text of the page.</p><div class='comments'><p>nice</p></div></{{tag}}></div></body>"
        got = texts(spark, [(1, "http://a/1", page.format(tag="article")), (2, "http://b/1", page.format(tag="div")), (3, "http://c/1", f"<body><article><p>Short.</p></article><div {wrapper}><p>More than that, outside.</p></div></body>")])
        assert got == {1: "The long text of the page.", 2: "The long text of the page.", 3: "Short."}


def test_short_ends_stay(spark):
    body = "<body><div><h1>Short heading {n}</h1><p>" + "Long words of page {n}. " * 40 + "</p><p>End {n}.</p></div></body>"
    got = texts(spark, [(i, f"http://s.com/{i}", body.format(n=i)) for i in range(8)])
    assert got[3].split("\n")[0] == "Short heading 3" and got[3].split("\n")[-1] == "End 3." and len(got[3]) > 800


def test_copies_without_article_stay_whole(spark):
    body = "<body><div><p>First words.</p><p>Second words.</p></div><!-- {n} --></body>"
    for bodies in ([body.format(n=1)] * 5, [body.format(n=i) for i in range(5)]):
        assert set(texts(spark, [(i, f"http://d.com/{i}", x) for i, x in enumerate(bodies)]).values()) == {"First words.\nSecond words."}


def test_odd_pages(spark):
    got = texts(spark, [(1, None, None), (2, "x", ""), (3, "http://a", "<p>only"), (4, "http://a", "a < b &amp;amp; c"), (5, "http://a", "<div><p>x</div>y<script>z"), (5, "http://a", "<div><p>x</div>y<script>z")])
    assert got == {1: "", 2: "", 3: "only", 4: "a < b &amp; c", 5: "x\ny"}


def test_extra_columns_and_empty(spark):
    names = ["tokens", "pages", "host", "_host", "_own", "page", "template", "_Template", "found", "n", "class"]
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "old", *range(len(names)))], "page_id long, url string, html string, text string, " + ", ".join(f"{x} int" for x in names))
    row = html.extract(df).first()
    assert row.text == "a" and [row[x] for x in names] == list(range(len(names)))
    assert set(html.extract(df).columns) == set(df.columns)
    assert html.extract(df.limit(0)).collect() == []


SITE = (
    "<html><body><div id='top'><div>Daily {k}</div><ul><li>Home</li><li>World {n}</li></ul></div><div id='wrap'><div id='text'><h2>Heading {n}</h2>"
    "<p>The first words of page {n}, which are its own and go on for some time.</p><div><p class='side-story tags'>More of {n} in a paragraph of its own.</p></div><div>Share this</div></div>"
    "<div id='more'><p>Other {n}</p></div></div><div id='end'>Rights of {n}</div></body></html>"
)


def test_the_template_decides(spark):
    pages = [SITE.format(n=i * 7919, k="news") for i in range(9)]
    want = [f"Heading {i * 7919}\nThe first words of page {i * 7919}, which are its own and go on for some time.\nMore of {i * 7919} in a paragraph of its own." for i in range(9)]
    template = html.deduce(pages)
    assert [html.main_text(x, template) for x in pages] == want
    bare = html.main_text(pages[0], html.Template([]))
    assert bare.startswith("Daily news\nHome") and bare.endswith("Rights of 0")
    assert texts(spark, [(i, "http://site.org/x", x) for i, x in enumerate(pages)]) == dict(enumerate(want))


def test_article_tags_do_not_rule(spark):
    page = "<body><div class='main-story'><p>" + "The story of page {n} is long. " * 20 + "</p></div><article><p>Teaser {n}</p></article></body>"
    got = texts(spark, [(i, "http://s.org", page.format(n=i)) for i in range(5)])
    assert all("Teaser" not in x and x.startswith("The story") for x in got.values())


def test_article_keeps_paragraphs_of_any_name(spark):
    page = "<body><article><header><h1>Head</h1></header><p class='side-story'>One.</p><p class='social-history'>Two.</p><p class='tags'>Three.</p><figure><img src=x><figcaption>Caption.</figcaption></figure><ul class='facts'><li>Four.</li></ul><p>Read <a href=/x>this</a> <button>Share</button>now.</p></article></body>"
    assert texts(spark, [(1, "http://p.org", page)]) == {1: "Head\nOne.\nTwo.\nThree.\nCaption.\nFour.\nRead this now."}


def plain_classes(pages):
    """Classes by whole occurrence vectors, and the order of the first page that has them."""
    per = [[t for t, _, _ in html.tokenise(x).tokens] for x in pages]
    vectors = {t: tuple(x.count(t) for x in per) for x in per for t in x}
    kept = {t: v for t, v in vectors.items() if sum(c > 0 for c in v) >= 0.6 * len(pages)}
    out = {}
    for x in per:
        for t in x:
            if t in kept and t not in out.setdefault(kept[t], []):
                out[kept[t]].append(t)
    return sorted(tuple(x) for x in out.values() if len(x) > 1)


def test_classes_against_whole_vectors(spark):
    rng = random.Random(9)
    part = lambda n: "".join(rng.choice(["<p>a{0}</p>", "<div class=x><p>b{0}</p></div>", "<ul><li>c{0}<li>d</ul>"]).format(rng.random()) for _ in range(n))
    pages = [f"<html><body><div id=a>{part(rng.randint(0, 3))}</div><div id=b>{part(2)}</div>{'<hr><div id=c>z</div>' if i % 5 else ''}</body></html>" for i in range(12)]
    want = plain_classes(pages)
    assert sorted(map(tuple, html.deduce(pages).classes)) == want
    frame = spark.createDataFrame([("h", x) for x in [*pages, pages[0]]], "host string, html string")
    row = html.templates(frame, "host").first()
    found = html.Template(tuple(t[c] for c in html._COLUMNS) for t in row.tokens)
    assert sorted(map(tuple, found.classes)) == want and found.chain == html.deduce(pages).chain


def test_classes_keep_one_order_and_nest():
    a, b = "<div id=a><p>{0}</p></div>", "<div id=b>{0}</div>"
    pages = [f"<body>{a.format(i)}{b.format(i)}</body>" for i in range(6)]
    template = html.deduce(pages)
    assert len(template.classes) == 1
    turned = html.tokenise(f"<body>{b.format(1)}{a.format(1)}</body>").tokens
    valid = template.valid(turned)  # told apart into elements, which nest
    assert len(valid) == len(turned) and {c[0] for _, c, _ in valid} == {"pair"}
    rows = [(1, html.HOLDER, 0, 2, 5, 2, 0, 9, 0), (2, html.END, 1, 2, 5, 2, 4, 0, 0), (3, html.HOLDER, 1, 2, 6, 2, 1, 9, 9), (4, html.END, 3, 2, 6, 2, 6, 0, 0)]
    crossed = html.Template(rows)
    assert {c for _, c, _ in crossed.valid([(1, 0, False), (3, 1, False), (2, 0, True), (4, 1, True)])} == {0}
    assert len(crossed.valid([(1, 0, False), (3, 1, False), (4, 1, True), (2, 0, True)])) == 4


def test_long_and_deep_pages(spark):
    long, deep = "<body><article>" + "<p>word</p>" * 60_000 + "</article></body>", "<div>" * 20_000 + "deep" + "</div>" * 20_000
    got = texts(spark, [(1, "http://l", long), (2, "http://d", deep), (3, "http://d2", "<div>" * 20_000 + "<p>x")])
    assert got[1].count("\n") == 59_999 and got[2] == "deep" and got[3] == "x"


# --- chat

@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<|\\im_startend>a\n", max_size=30))
def test_chat_escapes(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.START not in chat.escape(text) and chat.END not in chat.escape(text)
    assert chat.parse(chat.turn("user", text) + chat.turn("a\n%x", text)) == [("user", text), ("a\n%x", text)]


def test_chat_examples(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>yes"), (1, 2, "user", "more"), (1, 3, "assistant", "ok"), (2, 0, "user", None), (3, 1, "assistant", "late"), (3, 0, None, "x"), (4, 0, "assistant", "a"), (4, 1, "user", "b")]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.example): r for r in made.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (4, 1)]
    loss = {k: chat.unescape(r.text[r.loss_start : r.loss_stop]) for k, r in got.items()}
    assert loss == {(1, 0): "<|im_end|>yes", (1, 1): "ok", (2, 0): "", (3, 0): "late", (4, 0): "a", (4, 1): ""}
    assert got[1, 1].text.startswith(got[1, 0].text)
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert back[1].loss_sha256 == sha("<|im_end|>yesok") and back[1].n_turns == 4
    assert back[2].turns_sha256 == sha("user\n\n") and back[3].turns_sha256 == sha("\nx\nassistant\nlate\n")


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra int")
    assert chat.examples(none).collect() == [] and chat.with_planted(none).count() == 2


# --- fingerprints


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for i in range(30)] + [(100, None), (101, "éé à ßß"), (None, "abc def"), (50, "one two three"), (51, "one two three")]
    rows = sketch.fingerprint_edits(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, sketch int")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    order = sorted(d for d, _ in docs if d is not None)
    text = {d: t or "" for d, t in docs}
    for k, d in enumerate(order):
        own, nxt = text[d], text[order[k - 1]]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + nxt[:cut]
        like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(own)
        assert got[d].near_edited == pytest.approx(like(shingles(own), shingles(edited)))
        assert got[d].near_next == pytest.approx(like(shingles(own), shingles(nxt)))
        assert got[d].distinct_shingles == len(shingles(own))
    assert got[50].fingerprint == got[51].fingerprint
    assert got[None].edited_sha256 == hashlib.sha256(b"abc d").hexdigest()


def test_ranges_are_even(spark):
    ids = sorted({int(1.0009**i * 1000) + i for i in range(30_000)})
    docs = spark.createDataFrame([(i, "") for i in ids], "doc_id long, text string")
    rows = sketch.with_ranges(docs, 1000).groupBy("_part").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("_part").collect()
    assert len(rows) > 500 and max(r.n for r in rows) <= 2 * len(ids) / len(rows)
    assert all(a.high < b.low for a, b in zip(rows, rows[1:]))
    same = sketch.with_ranges(spark.createDataFrame([(5, "x")] * 50 + [(None, "y")], "doc_id long, text string"), 1000).select("_part").distinct().collect()
    assert len(same) == 2


def test_long_texts(spark):
    text = "word " * 400_000 + "end"
    row = sketch.fingerprint_edits(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_chars == len(text) and row.distinct_shingles == 2
    got = bpe.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), vocabulary("byte_bpe_multi_50k.tiktoken")).first()
    assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints_one_and_none(spark):
    one = sketch.fingerprint_edits(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1
    assert sketch.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketch_merges(spark):
    rng = random.Random(1)
    parts = [" ".join(str(rng.randint(0, 5000)) for _ in range(300)) for _ in range(4)]
    df = sketch.with_sketch(spark.createDataFrame([("a", p) for p in parts], "k string, text string"), "text", "s", k=64)
    merged = sketch.merge(df, "k", "s", 64).first().s
    assert merged == sorted({h for r in df.collect() for h in r.s})[:64]
    est = spark.createDataFrame([(merged,)], "s array<long>").select(sketch.distinct(F.col("s"), 64)).first()[0]
    true = len(set().union(*map(shingles, parts)))
    assert abs(est - true) / true < 0.5


# --- substring deduplication


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_chunks_resist_shifts():
    rng = random.Random(2)
    text = words(rng, 400).encode()
    _, a = gear.chunks(text)
    _, b = gear.chunks(b"inserted words here " + text)
    assert len(set(a) & set(b)) >= len(a) - 2
    ends, _ = gear.chunks("é".encode() * 2000)
    assert ends[-1] == 4000 and all(e % 2 == 0 for e in ends)
    assert gear.chunks(b"") == ([], [])


def test_repeats_are_cut(spark):
    rng = random.Random(3)
    shared, a, b, c = words(rng, 120), words(rng, 150), words(rng, 150), words(rng, 200)
    docs = [(1, f"{a} {shared} {b}", 5), (2, f"{c} {shared} {words(rng, 80)}", 6), (3, c, 7), (4, c, 8), (5, None, 9), (6, "", 1), (7, words(rng, 90), 2)]
    out = {r.doc_id: r for r in gear.deduplicate(spark.createDataFrame(docs, "doc_id long, text string, repeat_spans int")).collect()}
    given = {d: t for d, t, _ in docs}
    assert out[1].text == given[1] and out[7].text == given[7] and out[5].text is None and out[6].text == ""
    assert shared[60:-60] not in out[2].text and len(out[2].text.split()) > 150
    assert len(out[4].text or "") == 0
    for d, r in out.items():
        if given[d]:
            kept, at = "", 0
            for s in r.repeat_spans:
                kept += given[d][at : s.start]
                at = s.stop
            assert kept + given[d][at:] == r.text


def plain_rolling(data, at):
    return sum(int(gear._GEAR[data[at - k]]) << k for k in range(min(16, at + 1))) * 2654435761 % (1 << 32)


def plain_boundaries(data):
    """Byte by byte: the definition in the docstring of boundaries()."""
    white = lambda i: data[i] in b" \t\n\r\x0b\x0c"
    value = [plain_rolling(data, i) if white(i) and not (i + 1 < len(data) and white(i + 1)) else 0 for i in range(len(data))]
    out, last = [], 0
    marks = [i + 1 for i, v in enumerate(value) if v and all(value[j] < v for j in range(max(0, i - gear.REACH), i)) and all(value[j] <= v for j in range(i + 1, min(len(data), i + gear.REACH + 1)))] if len(data) > 2 * gear.REACH else []
    for end in [*marks, len(data)]:
        while end - last > gear.LONGEST:
            cut = last + gear.LONGEST
            while cut > last + 1 and data[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(cut)
            last = cut
        if end > last:
            out.append(end)
            last = end
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab  \n\té", max_size=400), st.integers(1, 40))
def test_boundaries_byte_by_byte(text, times):
    data = (text * times).encode()[:6000].decode("utf-8", "ignore").encode()
    assert gear.boundaries(data) == plain_boundaries(data)


def plain_deduplicate(docs):
    """With dictionaries: chunks of earlier documents and of the text before, runs of MIN_WORDS words or more go."""
    own = {d: set(gear.chunks((t or "").encode())[1]) for d, t in docs if d is not None}
    out = []
    for d, t in docs:
        data, last, seen, runs = (t or "").encode(), 0, set(), []
        known = {h for e, hs in own.items() if d is not None and e < d for h in hs}
        for end, h in zip(*gear.chunks(data)):
            if h in known or h in seen:
                if runs and runs[-1][1] == last:
                    runs[-1] = (runs[-1][0], end)
                else:
                    runs.append((last, end))
            seen.add(h)
            last = end
        kept, last = b"", 0
        for a, b in runs:
            if len(data[a:b].split()) >= gear.MIN_WORDS:
                kept, last = kept + data[last:a], b
        out.append((d, None if t is None else (kept + data[last:]).decode()))
    return sorted(out, key=str)


def test_deduplicate_with_dictionaries(spark):
    rng = random.Random(8)
    parts = [words(rng, n) for n in (30, 60, 90, 200, 26)]
    docs = [(i if i % 7 else None, " ".join(rng.choice([*parts, words(rng, 40)]) for _ in range(rng.randint(0, 5)))) for i in range(40)] + [(3, parts[3]), (50, None), (None, None), (2, words(rng, 20_000) + " " + parts[2])]
    frame = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in docs], "doc_id long, text string, _known int, _doc int, known int, digest int")
    out = gear.deduplicate(frame)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == plain_deduplicate(docs)
    assert out.columns == [*frame.columns, "repeat_spans"] and out.first().known == 3


def test_repeats_within_and_empty(spark):
    rng = random.Random(4)
    p = words(rng, 100)
    text, spans = gear.repeats(f"{p}\n{words(rng, 30)}\n{p}\n", set())
    assert spans and len(text) < 1.5 * len(p)
    assert gear.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- byte-level BPE

TEXTS = ["", "Hello world's  best\n\n text!!  12345 é", "don't DON'T we'll 've'", "  leading", "trailing   ", "\t\n x y z", "日本語 テスト 🙂🙂", "a" * 200, "\x00\x01 nul", "ſ's ſt", "²³½ Ⅷ ١٢٣", "é combining"]


@pytest.fixture(scope="module")
def codecs():
    import public_tokenizers as P
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.Codec.from_file(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(codecs, texts):
    own, theirs = codecs
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == theirs.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()
        assert own.offsets(ids)[-1] == len(text.encode())


def test_bpe_known(codecs):
    check(codecs, TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]) | st.sampled_from(" '\n\tstmdrvel1a"), max_size=60), max_size=5))
def test_bpe_any(codecs, texts):
    check(codecs, texts)


def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while pairs := [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


def test_merging(codecs):
    own, theirs = codecs
    rng = random.Random(0)
    pieces = [bytes(rng.choice(rng.choice([b"abcdethe ing", bytes(range(256))])) for _ in range(n)) for n in (*range(1, 45), 60, 300) for _ in range(20)]
    got = [list(memoryview(x).cast("I")) for x in own._merger.merge(pieces)]
    assert got == [plain_merge(x, own.ranks) for x in pieces] == [list(theirs._encode_single_piece(x)) for x in pieces]
    assert [bpe.merge(x, own.ranks) for x in pieces] == got and own._merger.merge([]) == []


def test_bpe_frames(spark):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(1, "hello there", 3), (2, None, 4)], "doc_id long, text string, token_ids int")
    coded = bpe.encode(df, path)
    rows = {r.doc_id: r for r in bpe.decode(coded, path).collect()}
    assert rows[1].decoded == b"hello there" and rows[2].token_ids == [] and rows[2].token_offsets == [0]
    digest = {r.doc_id: r for r in bpe.round_trip(df, path).collect()}
    assert digest[2].n_tokens == 0 and digest[1].decoded_sha256 == hashlib.sha256(b"hello there").hexdigest()
    assert bpe.round_trip(df.limit(0), path).collect() == []


# --- WARC


def test_warc(spark):
    big = "x" * 10_000
    rows = [(3, "http://a", "same"), (1, "http://b\r\nX: y", "same"), (2, None, None), (5, "u", big), (9, "u", big), (7, "u", "éé"), (None, "u", "alone"), (7, "u", "éé")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record int")
    archive = warc.archive(pages, chunk=1000)
    assert archive.groupBy("record").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] == 10
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) for r in warc.read_chunks(archive).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    want = [(1, 4, digest("same"), "response", None, rows[1][1]), (2, 0, digest(None), "response", None, None), (3, 4, digest("same"), "revisit", 1, "http://a"), (5, 10_000, digest(big), "response", None, "u"), (7, 4, digest("éé"), "response", None, "u"), (7, 4, digest("éé"), "response", None, "u"), (9, 10_000, digest(big), "revisit", 5, "u"), (None, 5, digest("alone"), "response", None, "u")]
    assert got == want
    least = {r.page_id: r.record_type for r in warc.round_trip(pages, min_bytes=5).collect()}
    assert least[3] == least[1] == "response" and least[9] == "revisit"
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_finds_damage(spark):
    archive = warc.archive(spark.createDataFrame([(1, "u", "y" * 3000)], "page_id long, url string, html string"), chunk=1000)
    with pytest.raises(Exception, match="missing or out of order"):
        warc.read_chunks(archive.filter("chunk_no <> 1")).collect()
