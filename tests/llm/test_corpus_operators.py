"""Packing, top-k, toxicity, SimHash, components and the pipeline against plain versions."""

import os
import random
import zlib

import numpy as np
import pytest
import xxhash

from sparquill.llm import components, jaccard, packing, simhash, topk, toxicity
from sparquill.llm.common import materialize
from sparquill.llm.queries import PACK_SPECIAL, PACK_VOCABULARY, queries, vocabulary

DATA = "/root/testdata/sf0.001"

# --- packing


def test_packer_takes_the_tightest_bin():
    p = packing.Packer(10, 2)
    assert p.put(6, "a") == [] and p.put(7, "b") == []
    assert p.put(3, "c") == [[(7, "b"), (3, "c")]]
    assert p.put(5, "d") == []
    assert p.put(9, "e") == [[(6, "a")]]
    assert sorted(map(len, p.rest())) == [1, 1] and p.open == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the", "of", "zebra", "é", "12"]) for _ in range(rng.choice([0, 5, 300, 1500, 6000])))) for i in range(60)] + [(100, None), (101, "a <|endoftext|> b")]
    got = packing.pack_documents(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, offset int").repartition(6), vocabulary(PACK_VOCABULARY), PACK_SPECIAL).collect()
    coder = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {}
    for i, text in docs:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        start, stop, k = 0, (len(ids) - 1) % 2048 + 1, 0
        while start < len(ids):
            want[i, k] = (start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes()))
            start, stop, k = stop, stop + 2048, k + 1
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(n for _, n, _ in want.values()) // 2048)
    assert len(bins) <= least * 1.1 + 1


def plain_packing(sizes, length):
    """Best fit without a bound on open bins."""
    bins = []
    for n in sizes:
        fits = [b for b in bins if b + n <= length]
        if fits:
            bins.remove(max(fits))
        bins.append((max(fits) if fits else 0) + n)
    return len(bins)


def test_packing_in_levels(spark):
    rng = random.Random(6)
    rows = [(None if i % 9 == 0 else i // 2, 0, 0, rng.randint(1, 100), i) for i in range(900)]
    items = spark.createDataFrame(spark.sparkContext.parallelize(rows, 9), packing.PIECES)  # with two at a time: five levels
    got = packing.pack(items, 100, 4, 2).collect()
    assert sorted(r.ids_crc32 for r in got) == list(range(900))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 100 and [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] for b in bins.values())
    assert len(bins) <= 1.2 * plain_packing([r[3] for r in rows], 100)
    assert len({r.sequence_id >> 59 for r in got}) >= 3


def test_packing_too_long(spark):
    with pytest.raises(Exception, match="does not fit a sequence of 100"):
        packing.pack(materialize(spark.createDataFrame([(1, 0, 0, 101, 5)], packing.PIECES)), 100).collect()


def test_packing_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary(PACK_VOCABULARY)).collect() == []


# --- exact top-k


def brute(rows, k):
    v = {i: np.array([np.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows}
    out = set()
    for q in v:
        if q % 20 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [7, 1000])
def test_topk(spark, block):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(90)]
    bad = [(200, None), (220, [1.0, None, 2.0, 3.0]), (240, [float("nan")] * 4), (260, [float("inf")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame([(a, b, 0) for a, b in [*rows, *bad, rows[3]]], "vec_id long, embedding array<float>, rank int")
    got = {tuple(r) for r in topk.top_k(df, k=5, block=block, query_block=3).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, 5)


def test_topk_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.limit(0)).collect() == []


def clustered(n, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 100, (20, 6))[rng.integers(0, 20, n)] + rng.normal(0, 2, (n, 6))
    return np.floor(v / np.linalg.norm(v, axis=1)[:, None] * 200)


def test_pivots_eliminate():
    v = clustered(4000)
    ids, to, stats = np.arange(4000), topk._distances(v, v[:24]), {}
    rows, got, scores = topk.search(v[:40], ids[:40], to[:40], v, ids, to, 20, stats=stats)
    assert stats["evaluated"] < 0.5 * 40 * 4000
    for i in range(40):
        s = v @ v[i]
        s[i] = -np.inf
        want = np.lexsort((ids, -s))[:20]
        assert got[rows == i].tolist() == want.tolist()


def test_blocks_are_left_out(spark):
    rows = [(i, [float(x) for x in v / 64]) for i, v in enumerate(clustered(3000))]
    stats = {}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, block=100, query_block=20, stats=stats)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 5)
    assert stats["met"] < 0.7 * stats["pairs"], stats


def test_topk_equal_vectors_and_dimensions(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [float(i)] * (1 + i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, k=4, block=32, query_block=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, e in rows:
        if q % 20 == 0:
            of = lambda x: int(sum(np.floor(64 * np.array(e)) * np.floor(64 * np.array(x))))  # noqa: B023, E731
            best = sorted((-of(x), c) for c, x in rows if c != q and len(x) == len(e))[:4]
            assert sorted(got[q]) == [(i, c, -s) for i, (s, c) in enumerate(best, 1)]


# --- toxicity


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    texts, labels = [], []
    for i in range(400):
        sentences = [" ".join(word() for _ in range(8)) for _ in range(5)]
        if i % 4 == 0:
            sentences[rng.randrange(5)] += " you awfulword"
        texts.append(". ".join(sentences) + ".")
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts[:300], labels[:300])
    assert toxicity.fit(texts[:300], labels[:300]) == model
    assert [int(model.score(model.sentences(t)) >= 0.5) for t in texts[300:]] == labels[300:]
    df = spark.createDataFrame([*[(i, t, 1) for i, t in enumerate(texts[300:])], (900, None, 1), (901, "", 1)], "doc_id long, text string, score int")
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert out[900].score == out[901].score == 0 and out[900].worst_start is None
    assert "awfulword" in texts[300][out[0].worst_start : out[0].worst_stop]
    assert {r.doc_id for r in toxicity.offending_sentences(df, model).collect()} == {i for i in range(100) if labels[300 + i]}
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == 102 - sum(labels[300:])


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, None), (7, 1), (None, 1)], "doc_id long, toxic int"))
    assert [r.score < 0.01 for r in toxicity.score(docs, model).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_held_out(spark):
    ids = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    got = {r.doc_id: r.h for r in ids.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_toxicity_on_held_out_documents(spark):
    import pyarrow.parquet as pq

    rows = queries()["op9_toxicity"](spark, "/root/testdata/sf0.01").collect()
    labels = dict(zip(*[pq.read_table("/root/testdata/sf0.01/labels.parquet")[c].to_pylist() for c in ("doc_id", "toxic")]))
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert len(held) > 30 and sum(p == t for p, t in held) / len(held) > 0.9


# --- SimHash


def plain_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: 32 for i in range(9, 14)}).split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids, parent = list(fps), {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                a2, b2 = find(a), find(b)
                parent[max(a2, b2)] = min(a2, b2)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one two", "A b C d É", "x y z w", "a a a a a a", "ÀB Ça\x0bva\x1cbien là"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(80)]
    docs = {i: " ".join(rng.sample(base, 60)) for i in range(40)}
    docs |= {100 + i: docs[i] for i in range(10)} | {200 + i: f"{docs[i]} extra" for i in range(15)} | {300: "", 301: None, 302: "x"}
    rows = [(d, t, "c") for d, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = {d: plain_fingerprint(t or "") for d, t in docs.items()}
    want = plain_components(fps)
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in docs}
    kept = simhash.keep_one(df.union(df.limit(3)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_links_lose_nothing(spark, bucket):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = set()
    for s in seeds:
        fps |= {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(25)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = materialize(spark.createDataFrame([(x,) for x in signed], "fp long"))
    edges = simhash.links(df, bucket=bucket)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    got = {r.node: r.component for r in components.components(edges).collect()}
    parts = plain_components(dict(zip(signed, fps)))
    groups = {}
    for x in signed:
        groups.setdefault(parts[x], set()).add(x)
    ours = {}
    for x in signed:
        ours.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_thresholds_by_dynamic_programming():
    assert simhash.allocate([{-1: 0.0, 0: 9.0, 1: 50.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 8.0, 1: 60.0}], 0) == [-1, 1, 0]
    groups = simhash.group_bits(10, np.eye(64) * 5, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} <= {21, 22}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (7, 7), (300, 300), (None, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 300}


# --- near copies of the pipeline


def plain_near_copies(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in docs.items() if (w := t.lower().split()) is not None}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in docs}


def edited_documents():
    """Texts of 60 to 200 words, and copies of them with 1 to 3 words changed; one large group."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = {i: " ".join(word() for _ in range(rng.randint(60, 200))) for i in range(30)}
    for i in range(1000, 1220):
        words = docs[0 if i >= 1120 else i % 30].split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = word()
        docs[i] = " ".join(words)
    return docs | {2000: "", 2001: " ", 2002: "One two", 2003: "one  TWO", 2004: "one"}


def test_prefixes_and_places_lose_no_alike_pair(spark):
    rng = random.Random(12)
    counts = np.array([rng.randint(0, 3) for _ in range(jaccard.CELLS)])
    base = [[rng.getrandbits(64) for _ in range(n)] for n in (1, 2, 5, 9, 10, 47, 200)]
    sets = {}
    for i in range(240):
        own = base[i % len(base)]
        keep = rng.sample(own, max(1, int(len(own) * rng.uniform(0.75, 1))))
        sets[i] = np.unique(np.array(keep + [rng.getrandbits(64) for _ in range(rng.randint(0, len(own) // 6))], np.uint64))
    tokens = {i: jaccard.prefix(x, counts).view(np.int64).tolist() for i, x in sets.items()}
    rows = [(t, pos, i, len(sets[i]), i) for i, x in tokens.items() for pos, t in enumerate(x)]
    left = spark.createDataFrame(rows, "token long, pos int, node long, size int, component long")
    met = jaccard.rest_pairs(left).filter("node <> other").filter(jaccard.may_be_alike("size", "pos", "other_size", "other_pos"))
    met = {tuple(sorted(r)) for r in met.select("node", "other").distinct().collect()}
    want = {(i, j) for i in sets for j in sets if i < j and jaccard.alike(sets[i], sets[j])}
    every = {(i, j) for i in sets for j in sets if i < j and set(tokens[i]) & set(tokens[j])}
    assert want <= met < every and len(want) > 300


def test_frequencies_count_every_text(spark):
    texts = ["", None, "one two", *[f"a b c d e f{i}" for i in range(50)]]
    got = jaccard.frequencies(spark.createDataFrame([(x,) for x in texts], "text string").repartition(5))
    want = np.zeros(jaccard.CELLS, np.int64)
    for x in texts:
        for h in jaccard.shingles(x or "").tolist():
            want[h >> 46] += 1
    assert (got == want).all() and got.sum() == 101 and not jaccard.frequencies(spark.createDataFrame([], "text string")).any()


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    docs = edited_documents()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = plain_near_copies(docs)
    assert 30 < len(set(want.values())) < len(docs) - 60
    kept = corpus_pipeline.drop_near_duplicates(spark, df, DATA)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == df.columns


@pytest.mark.parametrize("keep_one", [simhash.keep_one, jaccard.keep_one])
def test_null_and_repeated_ids(spark, keep_one):
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (1, texts[2]), (5, texts[3]), (5, texts[4]), (5, texts[4]), (2, texts[4]), (7, texts[5])]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(0, texts[0]), (0, texts[1]), (1, texts[2]), (5, texts[3]), (2, texts[4]), (7, texts[5])])


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = materialize(stage(spark, docs, DATA))
        assert docs.columns == columns and 0 < docs.count() <= before, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, DATA)
    assert again.count() == packed.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_pipeline_batches_are_bounded_by_size(spark):
    import pyarrow as pa

    import corpus_pipeline
    from sparquill.llm import common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    seen = lambda df: df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    docs = spark.createDataFrame([(i, "word " * 2000) for i in range(400)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get(name, None)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            stage(spark, spark.read.parquet(f"{DATA}/documents.parquet").limit(0), DATA)
            rows = [r.n for r in seen(docs)]
            assert sum(rows) == 400 and max(rows) * 10_000 < 2 * common.BATCH_BYTES
        spark.conf.set(name, "4194304")
        common.small_batches(spark)
        assert spark.conf.get(name) == "4194304"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    import __spark_entry__

    assert {*names, "pipeline"} <= set(__spark_entry__.queries())


def test_nothing_else_imports_llm():
    import ast

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(f"{root}/sparquill"):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(f"{folder}/{f}") as text:
                    for node in ast.walk(ast.parse(text.read())):
                        named = [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                        assert not any("llm" in x.split(".") for x in named), f
