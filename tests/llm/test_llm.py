import hashlib
import io
import itertools
import json
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import encode, hot, jaccard_groups, knn_quality, license_scan, lm_lattice, pack_pow2, paragraph_dedup, rule_cascade, scratch, shingles, spaced_seeds, token_store, warc_zip
from weftline.llm.components import connected_components
from weftline.llm.encode import Encoder
from weftline.llm.queries import tokenizer
from weftline.llm.shingles import Block, shingle_set, shingle_sets, word_hashes
from weftline.llm.shingles import blocks as shingle_blocks

BYTES, WORDS_BPE = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, "   "), (4, "one"), (4, "one"), (5, "a b c d e f g h"), (None, "a b c d e f g h"), (6, "x " * 30_000), (7, "a<|endoftext|>b")]


def table(spark, rows):
    """Documents with an extra column whose name clashes with the operators' own."""
    return spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, score string")


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


# tokens ---------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from([*" \n\t.,'sé́İΣ<|>1x²", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", ".\n\n", "It's"]), st.characters(codec="utf-8")), max_size=30).map("".join), max_size=4))
def test_cached_encoder_equals_library(texts):
    for path in (BYTES, WORDS_BPE):
        if path not in _encoders:
            _encoders[path] = Encoder(path), Tokenizer.from_file(path)
        e, library = _encoders[path]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(e.encode(t), f"<u{e.width}").tolist() for t in texts] == want
        got = [x for _, ids, n in e.blocks(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert [x.tolist() for x in got] == want


_encoders: dict = {}


def test_encoder_in_small_blocks(monkeypatch):
    monkeypatch.setattr(encode, "BLOCK_BYTES", 50)
    monkeypatch.setattr(encode, "CACHE_ENTRIES", 20)
    texts = [None, "", *(" ".join([*words(n, n), "end.", "été!?", "x\n\ny."]) for n in range(30)), "", None]
    for path in (BYTES, WORDS_BPE):
        e, library = Encoder(path), Tokenizer.from_file(path)
        got = [x.tolist() for _, ids, n in e.blocks(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts] and len(e.later) <= 20
        assert list(e.blocks(pa.array([], pa.string()))) == []


def test_piece_lengths():
    for n in range(1, 70):
        got = pack_pow2.piece_lengths(n, 16)
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 16 for x in got)
        assert max(Counter(x for x in got if x < 16).values(), default=1) == 1


def test_pack_round_trip(spark):
    rows = pack_pow2.pack(table(spark, ODD), WORDS_BPE, 2, 64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    lib = Tokenizer.from_file(WORDS_BPE)
    docs = Counter()
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.offset == 0 and 1 << r.bucket == r.length
        docs[(r.doc_id, r.doc_tokens)] += r.length
    assert docs[(6, 30_001)] == 30_001 and docs[(4, 2)] == 4 and docs[(1, 1)] == 1
    five = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.start))
    assert np.frombuffer(five, "<u4").tolist() == [*lib.encode(ODD[5][1], add_special_tokens=False).ids, 2]
    assert pack_pow2.pack(table(spark, []), WORDS_BPE, 2).count() == 0


def test_store_round_trip_and_tampering(spark):
    shared = " ".join(words(800, 1))
    docs = [*ODD, (10, shared), (11, shared), (12, "other " + shared)]
    path = scratch.scratch_path(spark, "test-store")
    root = token_store.write_store(table(spark, docs), path, BYTES)
    rows = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    lib, at = Tokenizer.from_file(BYTES), 0
    want = Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in docs)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count() < sum(len(r.hashes) for r in spark.read.parquet(f"{path}/recipes").collect())
    again = scratch.scratch_path(spark, "test-store")
    assert token_store.write_store(table(spark, docs[::-1]).repartition(3), again, BYTES) is not None and len(root) == 32
    fs, folder = scratch.filesystem(f"{path}/packs")
    name = chunks.orderBy(F.desc("size")).head().pack
    data = bytearray(fs.open_input_file(f"{folder}/{name}").read())
    data[-1] ^= 1
    scratch.put(f"{path}/packs/{name}", bytes(data))
    with pytest.raises(Exception, match="chunk|Zstd|zstd|decompress|corrupt"):
        token_store.read_store(spark, path).collect()
    empty = scratch.scratch_path(spark, "test-store")
    token_store.write_store(table(spark, []), empty, BYTES)
    assert token_store.read_store(spark, empty).count() == 0


@pytest.mark.parametrize("table_name", ["recipes", "manifest"])
def test_store_misses_lost_rows(spark, table_name):
    path = scratch.scratch_path(spark, "test-store")
    token_store.write_store(table(spark, [(i, " ".join(words(20, i))) for i in range(40)]), path, BYTES)
    assert token_store.read_store(spark, path).count() == 40
    lost = spark.createDataFrame(spark.read.parquet(f"{path}/{table_name}").orderBy("part").collect()[1:], spark.read.parquet(f"{path}/{table_name}").schema)
    lost.write.mode("overwrite").parquet(f"{path}/{table_name}")
    with pytest.raises(token_store.StoreError):
        token_store.read_store(spark, path).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 6, 7, 8, 21])
def test_merkle_of_a_stream(n):
    leaves, tree = [b"%d" % k for k in range(n)], token_store.Merkle()
    for x in leaves:
        tree.add(x)
    assert tree.root() == token_store.merkle_root(leaves)


def test_store_of_one_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(token_store, "PACK_CHUNKS", 7)
    docs = [(None, "same words here")] * 60 + [(1, " ".join(words(400, 3)))] * 20
    path = scratch.scratch_path(spark, "test-store")
    token_store.write_store(table(spark, docs), path, BYTES)
    rows = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 60 + [1] * 20 and len({bytes(r.ids) for r in rows}) == 2
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()


def test_chunk_ends_shift():
    ids = np.random.default_rng(1).integers(0, 50_000, 30_000)
    a, b = token_store.chunk_ends(ids), token_store.chunk_ends(np.append(np.arange(77), ids))
    assert a[-1] == len(ids) and max(np.diff([0, *a])) <= token_store.MAX_IDS
    assert len(set(a) & {x - 77 for x in b}) > 0.8 * len(a)


# archives -------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "x" * 1500
    rows = [(1, big), (2, big), (3, "small"), (4, "small"), (5, None), (2, big), (None, big)]
    df = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows], "page_id long, url string, html string")
    folder = scratch.scratch_path(spark, "test-warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    packages = warc_zip.write_packages(warc_zip.assign_revisits(df, "page_id", payload), folder)
    got = warc_zip.read_packages(spark, packages, folder).collect()
    assert len(got) == 7
    for r in got:
        assert r.payload_digest == hashlib.sha1((dict(rows)[r.page_id] or "").encode()).hexdigest()
        assert (r.record_type == "revisit") == (r.page_id in (1, None)) and r.refers_to == (2 if r.page_id in (1, None) else None)
    assert warc_zip.read_packages(spark, packages.limit(0), folder).count() == 0


def test_zip64_directory_and_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("indexes/index.cdxj", "w", force_zip64=True) as f:
            f.write(b"abc")
        z.writestr("deflated", b"q" * 100, compress_type=zipfile.ZIP_DEFLATED)
        for k in range(66_000):  # more members than 16 bits count
            z.writestr(f"m{k}", b"%d" % k)
        z.comment = b"has PK\x05\x06 inside"
    data = out.getvalue()
    r = warc_zip.ZipReader(lambda n, at: data[at : at + n], len(data))
    assert r.read("indexes/index.cdxj") == b"abc" and r.read("m65999") == b"65999" and len(r.members) == 66_001
    with pytest.raises(warc_zip.PackageError):
        r.read("deflated")
    with pytest.raises(warc_zip.PackageError):
        warc_zip.ZipReader(lambda n, at: b"x" * n, 100)


# scores ---------------------------------------------------------------------------------------


def _brute(pieces, text, logp):
    """Sum over all segmentations, by recursion."""
    if not text:
        return 1.0
    return sum(np.exp(logp[i]) * _brute(pieces, text[len(p) :], logp) for p, i in pieces.items() if text.startswith(p))


def test_lattice_equals_enumeration():
    v = lm_lattice.load_vocabulary(tokenizer("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    logp = np.log(rng.dirichlet(np.ones(v.size)))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    pieces = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        b = sp.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in b[1:] and b == b.lower() and not any(c in b for c in b"\t\n\x0b\x0c\r"):
            pieces.setdefault(b, len(pieces))
    for b in range(256):
        pieces.setdefault(bytes([b]), len(pieces))
    for word in (b"the", b"\xc3\xa9t\xc3\xa9", b"in", b"q"):
        assert abs(lm_lattice.word_log10(v, logp, [word])[0] - np.log10(_brute(pieces, b" " + word, logp))) < 1e-9
    e = lm_lattice.word_expected(v, logp, [b"the", b"in"], np.array([2.0, 3.0]))
    lengths = np.zeros(v.size)
    for p, i in pieces.items():
        lengths[i] = len(p)
    assert abs((e * lengths).sum() - (2 * 4 + 3 * 3)) < 1e-9  # every byte is spelled once


def test_long_words_are_summed_over_whole(monkeypatch):
    v = lm_lattice.load_vocabulary(tokenizer("piece_bpe_32k.model"))
    logp = np.log(np.random.default_rng(4).dirichlet(np.ones(v.size)))
    long = [b"thequickbrownfox" * 30, b"\xe4\xb8\xad" * 100, b"a" * 255, b"ab" * 128, b"x" * 300]
    counts = np.array([1.0, 2.0, 1.0, 3.0, 1.0])
    monkeypatch.setattr(lm_lattice, "STRETCH", 1 << 20)
    want, uses = lm_lattice.word_log10(v, logp, long), lm_lattice.word_expected(v, logp, long, counts)
    for n in (1, 7, 256):
        monkeypatch.setattr(lm_lattice, "STRETCH", n)
        assert np.allclose(lm_lattice.word_log10(v, logp, long), want, rtol=0, atol=1e-9)
        assert np.allclose(lm_lattice.word_expected(v, logp, long, counts), uses, rtol=1e-9, atol=1e-12)
    # a segmentation alone weighs less than all of them
    single = {p: i for n, (h, ids) in enumerate(zip(v.hashes, v.ids), 1) if n == 1 for p, i in zip(h.tolist(), ids.tolist(), strict=True)}
    by_byte = sum(logp[single[int(lm_lattice._hash(np.array([[c]], np.uint8))[0])]] for c in b" " + long[4]) / np.log(10)
    assert want[4] > by_byte


def test_scores_of_whole_texts(spark):
    """Every text's score against the sum over its words of the enumerated probability, and the end."""
    rows = [(1, "in the in"), (2, "The\tq"), (3, None), (4, "été the")]
    cols = (F.col("doc_id"), F.col("text"), F.col("doc_id") == 4)
    df = table(spark, rows)
    path = tokenizer("piece_bpe_32k.model")
    model = lm_lattice.fit(df, path, *cols, rounds=2)
    v = lm_lattice.load_vocabulary(path)
    got = {r.doc_id: r.score for r in lm_lattice.score(df, model, *cols).collect()}
    known = {(n, h): i for n, (hs, ids) in enumerate(zip(v.hashes, v.ids, strict=True), 1) for h, i in zip(hs.tolist(), ids.tolist(), strict=True)}
    code = lambda b: int(lm_lattice._hash(np.frombuffer(b, np.uint8)[None])[0])

    def ways(b):
        if not b:
            return 1.0
        return sum(np.exp(model.logp[known[n, code(b[:n])]]) * ways(b[n:]) for n in range(1, min(len(b), len(v.hashes)) + 1) if (n, code(b[:n])) in known)

    for i, t in rows:
        want = sum(np.log10(ways(b" " + w)) for w in (t or "").encode().lower().split()) + model.logp[-1] / np.log(10)
        assert abs(got[i] - want) < 1e-9


def test_lm_counts(spark):
    rows = [*ODD, (20, "The THE cat"), (21, "unseen cat")]
    held = F.col("doc_id") == 21
    cols = (F.col("doc_id"), F.col("text"), held)
    df = table(spark, rows)
    out = lm_lattice.score(df, lm_lattice.fit(df, tokenizer("piece_bpe_32k.model"), *cols, rounds=1), *cols).collect()
    tok = lambda t: [*(t or "").encode().lower().split(), "end"]
    c = Counter(x for i, t in rows if i != 21 for x in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(tok(t)), sum(c[x] > 0 for x in tok(t)), round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tok(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert {r.train_tokens for r in out} == {n} and all(r.score < 0 for r in out)
    empty = table(spark, [])
    assert lm_lattice.score(empty, lm_lattice.fit(empty, tokenizer("piece_bpe_32k.model"), *cols), *cols).count() == 0


def test_quality_votes(spark):
    good = [(50 + i, " ".join(words(30, i))) for i in range(40)]
    bad = [(100 + i, " ".join(w + "$$$" for w in words(30, 100 + i))) for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:30]] + [(i, 0) for i, _ in bad[:30]] + [(57, None)], "doc_id long, label int")
    docs = table(spark, [*good, *bad, *ODD])
    model = knn_quality.fit(docs, labels, max_labelled=50)
    assert len(model.labels) == 50
    got = {r.doc_id: r.score for r in knn_quality.score(docs, model, F.col("text"), [F.col("doc_id")]).collect()}
    assert all(got[i] >= 0.5 for i, _ in good) and all(got[i] < 0.5 for i, _ in bad) and got[1] == got[2] == got[3] == 0
    x = knn_quality.features([t.encode() for _, t in good[:5]])
    q, k = model.project(x), model.neighbours
    sims = q @ model.vectors.T
    for row, s in zip(model.score(x), sims, strict=True):  # all cosines at once
        top = np.argsort(-s, kind="stable")[:k]
        w = np.maximum(s[top], 0).astype(float) ** 8 + 1e-9
        assert abs(row - (w * model.labels[top]).sum() / w.sum()) < 1e-6
    none = knn_quality.fit(docs, labels.limit(0))
    assert {r.score for r in knn_quality.score(docs.where("doc_id = 5"), none, F.col("text"), [F.col("doc_id")]).collect()} == {0.5}


# shingles -------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from([*" \n\t\x0b\x0cAaBb\0é\x1c\u00a0", "long" * 30, "abcdefgh", "abcdefghi"]), max_size=20).map("".join))), st.sampled_from([1, 30, 1 << 20]))
def test_words_are_hashed_alike_in_any_block(texts, size):
    kept, shingles.BLOCK_BYTES = shingles.BLOCK_BYTES, size
    try:
        column = pa.array([t if t is None else t.encode() for t in ["x", *texts]], pa.binary()).slice(1)
        got = [w for b in shingle_blocks(column) for w in b.texts()]
        sets = [x for b in shingle_blocks(column) for x in shingle_sets(b)]
    finally:
        shingles.BLOCK_BYTES = kept
    assert len(got) == len(sets) == len(texts)
    for t, w, x in zip(texts, got, sets, strict=True):
        want = (t or "").encode().lower().split()
        assert len(w) == len(want) and w.tolist() == word_hashes((t or "").encode()).tolist()
        for k, word in enumerate(want):
            assert _seen.setdefault(word, w[k]) == w[k]
        fives = {tuple(want[k : k + 5]) for k in range(max(1, len(want) - 4))} if want else set()
        assert len(x) == len(fives) and x.tolist() == sorted(x.tolist()) == shingle_set((t or "").encode()).tolist()
    assert len(set(_seen.values())) == len(_seen)


_seen: dict = {}


# text -----------------------------------------------------------------------------------------


def _repeats(w):
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_rules_against_python(spark):
    texts = [*ODD, (30, "a b c d e f a b c d e z"), (31, "x\nx\n\n \nx\ny"), (32, " ".join(words(50, 2))), (33, "AB CD! " * 20), (34, "é|ü #x")]
    for r in rule_cascade.cascade(table(spark, texts).drop("score")).collect():
        t = r.text or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars) == (len(w), sum(len(x.decode()) for x in w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == _repeats(w)
        assert r.base_failed == (len(w) < 10 or 100 * _repeats(w) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_cascade_order_changes_no_verdict(spark):
    df = table(spark, [(i, " ".join(words(20, i)) + ("!!" * 30 if i % 2 else "")) for i in range(20)])
    a = {r.doc_id: r.kept for r in rule_cascade.cascade(df).collect()}
    b = {r.doc_id: r.kept for r in rule_cascade.cascade(df, rules=rule_cascade.RULES[::-1]).collect()}
    assert a == b and a[0] and not a[1]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2001 + i) for i in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (3, 3)], "a long, b long")
    got = {x.node: x.root for x in connected_components(df).collect()}
    assert got == {n: find(n) for n in parent if find(n) != n}
    assert connected_components(df.limit(0)).count() == 0


def _families(seed):
    """Copies with a few words changed, so that pairs fall on both sides of the limit."""
    r, rows = random.Random(seed), []
    for f in range(6):
        base = words(60, seed + f)
        for k in range(12):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            rows.append((f * 100 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # every token of several classes in the sample is hot
        monkeypatch.setattr(hot, "LEAST", 2)
    monkeypatch.setattr(jaccard_groups, "SLICE", 3)
    monkeypatch.setattr(jaccard_groups, "ASKING", 2)
    rows = [*ODD, *_families(seed)]
    got = jaccard_groups.join(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = [(i, shingle_set((t or "").encode())) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i != j and len(a) and len(b):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    assert all(r.component_id == (find(r.doc_id) if r.doc_id is not None else None) for r in got)
    assert jaccard_groups.join(table(spark, [])).count() == 0


def test_asking_classes_meet_slices_in_any_partition(spark):
    """The two sides are dealt by the same types: with several partitions left as they are, each one meets."""
    rows = [(i, w) for k in range(30) for w in [" ".join(words(40, 700 + k))] for i in (2 * k, 2 * k + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    asks = spark.createDataFrame([(2 * k + 1, 2 * k, 1) for k in range(30)], "node long, h long, size long")
    grouped = spark.createDataFrame([], "node long, root long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in jaccard_groups._open(docs, asks, grouped, 80).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(2 * k + 1, 2 * k) for k in range(30)]


def test_repeated_words_give_few_rows():
    n = 2000
    block = next(shingle_blocks(pa.array([b"ab cd " * n, " ".join(words(60, 1)).encode()], pa.binary())))
    keys, texts, runs = paragraph_dedup.band_values(block)
    assert (texts == 0).sum() <= 8 * 2 * (2 * n // 46 + 2)
    at, start, length = paragraph_dedup.unpacked(runs)
    assert ((start <= at) & (at < start + 46) & (length >= 1) & (length <= 46)).all()
    for text, windows in ((0, 2 * n - 49), (1, 11)):  # every band covers every window once
        assert length[texts == text].sum() == 8 * windows


def test_periodic_passages(spark):
    rows = [(1, " ".join([*words(30, 1), *["ab", "cd"] * 80])), (2, " ".join([*words(37, 2), *["ab", "cd"] * 200, *words(10, 3)])), (3, "ab cd " * 60), (4, "ab " * 500), (5, " ".join([*words(9, 4), *["ab"] * 70]))]
    spans = [tuple(r) for r in paragraph_dedup.find(table(spark, rows)).collect()]
    assert _uncovered(rows, spans) == []


def test_hot_values_lose_nothing(spark, monkeypatch):
    """A passage in every document and one in a few, with and without hot values."""
    common, rare = words(55, 61), words(52, 62)
    rows = [(i, " ".join([*words(20 + i, 900 + i), *common, *(rare if i % 9 == 0 else []), *words(10, 990 + i)])) for i in range(60)]
    df, got = table(spark, rows), []
    for least in (1 << 30, 20, 1):
        monkeypatch.setattr(hot, "LEAST", least)
        got.append(sorted(tuple(r) for r in paragraph_dedup.find(df).collect()))
    assert got[0] == got[1] == got[2] and len({r[0] for r in got[0]}) == 59 and _uncovered(rows, got[0]) == []


def test_passages_of_whole_copies(spark):
    long, short = words(70, 31), words(49, 32)
    rows = [(9, " ".join(long)), (7, " ".join(long)), (8, " ".join(long)), (7, " ".join(long)), (5, " ".join(short)), (6, " ".join(short)), (None, " ".join(long)), (10, " ".join([*words(20, 33), *long]))]
    got = sorted(tuple(r) for r in paragraph_dedup.find(table(spark, rows)).collect())
    assert got == [(8, 0, 70, 7, 7), (9, 0, 70, 7, 7), (10, 20, 90, 7, 7)]


def test_passages(spark):
    p = words(60, 9)
    docs = [(20 + i, " ".join([*words(80 + i, 50 + i), *p, *words(70, 90 + i)])) for i in range(5)]
    boiler = " ".join(words(12, 77))
    clean = [(100 + i, " ".join(words(40, 300 + i)) + "\n" + boiler + "\n" + " ".join(words(40, 400 + i))) for i in range(8)]
    df = table(spark, [*ODD, *docs, *clean])
    spans = paragraph_dedup.find(df)
    got = sorted(tuple(r) for r in spans.collect())
    assert got == [(20 + i, 80 + i, 140 + i, 20, 20) for i in range(1, 5)]
    left = {(r.doc_id, r.text) for r in paragraph_dedup.cut(df, spans).collect()}
    assert all(row in left for row in clean) and docs[0] in left and (1, None) in left
    assert (22, " ".join([*words(82, 52), *words(70, 92)])) in left
    assert paragraph_dedup.find(table(spark, [])).count() == 0


def _uncovered(rows, spans):
    """Words of a 50-word window that an earlier document holds too, outside of the spans."""
    texts = {i: t.split() for i, t in rows if i is not None and t}
    first, lost = {}, []
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][k : k + 50]), i)
    held = {i: {k for d, s, e, *_ in spans if d == i for k in range(s, e)} for i in texts}
    for i, w in texts.items():
        lost += [(i, k) for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i and not held[i].issuperset(range(k, k + 50))]
    return lost


def _false_leaders():
    """X = H + W', A = junk + W, B = H + W and more such: W shares band values with W', and H with X."""
    rows = []
    for f in range(60):
        h, w, at = words(60, 3000 + f), words(50, 3100 + f), 4000 + 10 * f
        near = [f"y{k}" if k in (10, 30) else x for k, x in enumerate(w)]
        rows += [(at, h + near), (at + 1, words(70, 3200 + f) + w), (at + 2, h + w), (at + 3, near + words(9, 3300 + f) + w), (at + 4, w + words(3, 3400 + f) + near)]
    return [*((i, " ".join(x)) for i, x in rows), (5000, "x " * 300), (5001, "x " * 200 + rows[1][1][0])]


@pytest.mark.parametrize("n", [50, 55, 60])
def test_bands_retrieve_altered_passages(n):
    """One word changed, which the check at Jaccard 0.8 accepts; other words around the passage."""
    r, missed = np.random.default_rng(n), 0
    for _ in range(500):
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        b = a.copy()
        b[r.integers(5, n - 5)] = 7
        rows = [np.concatenate([r.integers(0, 2**63, 80, dtype=np.uint64), x, r.integers(0, 2**63, 80, dtype=np.uint64)]) for x in (a, b)]
        missed += not len(np.intersect1d(*(paragraph_dedup.band_values(Block(0, x, np.array([0, len(x)])))[0] for x in rows)))
    assert missed <= 2


@pytest.mark.parametrize("least", [400, 2])
def test_equal_passages_behind_a_false_leader(spark, least, monkeypatch):
    monkeypatch.setattr(hot, "LEAST", least)
    rows = _false_leaders()
    spans = [tuple(r) for r in paragraph_dedup.find(table(spark, rows)).collect()]
    assert _uncovered(rows, spans) == []
    texts = {i: t.split() for i, t in rows}
    fives = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    assert all(fives(texts[d][s:e]) & fives(texts[keeper]) and keeper < d for d, s, e, keeper, _ in spans)


def _altered(f):
    """Passages with one other word each, behind leaders with two other words, so that any band value has a false one."""
    r, at, w = random.Random(f), 6000 + 20 * f, words(50, 5000 + f)
    but = lambda *places: [f"q{r.randrange(10**6)}" if k in places else x for k, x in enumerate(w)]
    passages = [*(but(*r.sample(range(5, 45), 2)) for _ in range(12)), w, but(24 + f % 3), but(25), but(0, 4)]
    return [(at + k, " ".join(words(30 + k, 20 * f + k) * (k < 14) + x + words(k, 7000 + f))) for k, x in enumerate(passages)]


def _similar_windows(a, b):
    """Where a window of ``a`` shares 41 of 46 aligned shingles with one of ``b``."""
    a, b = (shingles.rolling(word_hashes(x.encode())) for x in (a, b))
    found = set()
    for d in range(-len(b), len(a)):
        lo, hi = max(0, d), min(len(a), len(b) + d)
        if hi - lo >= 46:
            n = np.convolve(a[lo:hi] == b[lo - d : hi - d], np.ones(46, int), "valid")
            found |= set((lo + np.flatnonzero(n >= 41)).tolist())
    return found


@pytest.mark.parametrize("least", [400, 2])
def test_altered_passages_behind_a_false_leader(spark, least, monkeypatch):
    """Every link that meets the threshold, against all windows of each family."""
    monkeypatch.setattr(hot, "LEAST", least)
    families = [_altered(f) for f in range(25)]
    got = paragraph_dedup.find(table(spark, [x for rows in families for x in rows])).collect()
    parts, held = {r.doc_id: r.component_id for r in got}, {}
    for r in got:
        held.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    lost = []
    for rows in families:
        for k, (i, x) in enumerate(rows):
            for j, y in rows[:k]:
                where = _similar_windows(x, y)
                if where and not (parts.get(i, i) <= j and parts.get(i) == parts.get(j, parts.get(i))):
                    lost.append((i, j))  # a document without removals has no row
                lost += [(i, j, s) for s in where if not any(a < s + 50 and s < b for a, b in held.get(i, []))]
    assert lost == []


def test_strangers_behind_one_leader_are_not_met_again(spark, monkeypatch):
    """Texts that share 15 words collide, and none passes with any other: nothing is sent out again."""
    seen, again = [], paragraph_dedup._again
    monkeypatch.setattr(paragraph_dedup, "_again", lambda docs, rows: seen.append((docs.count(), rows.count())) or again(docs, rows))
    rows = [(k, " ".join(words(45, 8000 + k) + words(15, 7999) + words(45, 9000 + k))) for k in range(1, 60)]
    assert paragraph_dedup.find(table(spark, rows)).count() == 0
    assert seen == [(59, 0)]


def test_windows_behind_several_leaders_are_met_again_once(spark, monkeypatch):
    """A document's windows are sent out once, however many leaders they failed with, and none of them is lost."""
    seen, again = [], paragraph_dedup._again
    monkeypatch.setattr(paragraph_dedup, "_again", lambda docs, rows: seen.extend(rows.collect()) or again(docs, rows))
    rows = [x for f in range(5) for x in _altered(f)]
    paragraph_dedup.find(table(spark, rows)).collect()
    assert len(seen) == len({(r.node, r.key, r.run, r.other) for r in seen}) > 0


def test_segments_hold_the_marked_windows():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 300):
        for p in (0.0, 0.3, 0.9, 1.0):
            marked, failed = r.random(n) < p, r.random(n) < 0.5
            windows, bad, length = paragraph_dedup.stretched(paragraph_dedup.segments(marked, failed))
            assert windows.tolist() == np.flatnonzero(marked).tolist() and bad.tolist() == failed[marked].tolist() and length.sum() == marked.sum()


@pytest.mark.parametrize("changed", [*([k] for k in range(50)), [0, 49], [1, 48], [0, 1, 2], [2, 47], [49, 48, 45]])
def test_windows_that_pass_share_a_part(changed):
    r = np.random.default_rng(1)
    for _ in range(20):
        a = r.integers(0, 1 << 63, 50).astype(np.uint64)
        b = a.copy()
        b[changed] += np.uint64(1)
        own = [shingles.rolling(x) for x in (a, b)]
        if (own[0] == own[1]).sum() >= 41:
            found = [paragraph_dedup.parts(x, np.array([0]), 7) for x in own]
            assert (found[0] == found[1]).any()
            keys, bad = paragraph_dedup.part_keys(own[1], np.ones(1, bool), np.ones(1, bool), 7)
            assert set(keys) == set(found[1].ravel()) and bad.all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "b\n", "c  d", ""]), max_size=12), st.integers(0, 6), st.integers(1, 4))
def test_cut_text_leaves_the_other_words(parts, start, n):
    text = " ".join(parts)
    w = text.encode().split()
    assert paragraph_dedup.cut_text(text, [(start, start + n)]).encode().split() == w[:start] + w[start + n :]


def test_seeds_find_substituted_items(spark):
    item = words(25, 4)
    r = random.Random(1)
    docs = [*ODD]
    for i in range(20):
        w = list(item)
        for k in r.sample(range(25), 3):
            w[k] = "zz"
        docs.append((50 + i, " ".join([*words(30, 1000 + i), *w, *words(10, 2000 + i)])))
    docs += [(200 + i, " ".join(words(80, 700 + i))) for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    got = {r.doc_id: r for r in spaced_seeds.find(table(spark, docs), items).collect()}
    same = lambda t: max((sum(a == b for a, b in zip(t[k : k + 15], item[j : j + 15])) for k in range(len(t) - 14) for j in range(11)), default=0)
    assert set(got) == {i for i, t in docs if i and i >= 50 and same(t.split()) >= 12} == set(range(50, 70))
    assert all(r.start_word == 30 and r.matched == 22 for r in got.values())
    assert spaced_seeds.find(table(spark, []), items).count() == 0 == spaced_seeds.find(table(spark, docs), items.limit(0)).count()


def test_seeds_find_every_short_item(spark):
    items, docs, want = [], [], set()
    for n in range(1, 15):
        item, strangers = words(n, 6000 + n), n * 20 // 100
        items.append((n, " ".join(item)))
        for j, gone in enumerate(itertools.combinations(range(n), strangers)):
            w = ["zz" if k in gone else x for k, x in enumerate(item)]
            docs.append((10_000 * n + j, " ".join([*words(6, 7000 + n), *w, *words(5, 8000 + n)])))
            want.add((10_000 * n + j, n))
    got = spaced_seeds.find(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.start_word == 6 for r in got)


def test_licenses(spark):
    docs = [*ODD]
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        docs.append((1000 + k, " ".join([*words(37 + k, k), t.upper(), *words(50, 99 + k)])))
    docs += [(3000 + i, " ".join(words(200, 900 + i)) + " license granted") for i in range(5)]
    got = license_scan.find(table(spark, docs)).collect()
    found = {(r.doc_id, r.template) for r in got}
    assert all((1000 + k, k) in found for k in range(len(license_scan.TEMPLATES)))
    assert all(r.doc_id >= 1000 and r.doc_id < 3000 and 100 * r.held >= 80 * r.template_shingles for r in got)
    assert license_scan.miss_bound() < 0.01
    with pytest.raises(ValueError):
        license_scan.find(table(spark, docs), [("X", "too short")])
    assert license_scan.find(table(spark, [])).count() == 0


def _fives(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_licenses_against_brute_force(spark, monkeypatch, broadcast):
    """Altered templates: every document whose best window of any class holds 80 % of a template's shingles is
    found but for a band's miss, and no other."""
    if not broadcast:
        monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 3)
    r, docs = random.Random(8), [*ODD]
    known = [(k, sorted(set(_fives(t)))) for k, (_, t) in enumerate(license_scan.TEMPLATES)]
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        for j in range(6):
            w = t.split()
            for _ in range(len(w) * j // 100 + (j > 0)):
                w[r.randrange(len(w))] = "zz"
            docs.append((1000 + 10 * k + j, " ".join([*words(r.randrange(90), 10 * k + j), *w, *words(40, 999 + j)])))
    want = set()
    for i, t in docs:
        fives = _fives(t or "")
        for k, own in known:
            c = 1 << (len(own) - 1).bit_length()
            best = max((len(set(fives[at : at + 2 * c]) & set(own)) for at in range(0, len(fives), c)), default=0)
            if i and 100 * best >= 80 * len(own):
                want.add((i, k, best))
    got = {(x.doc_id, x.template, x.held) for x in license_scan.find(table(spark, docs), short=[]).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 60


def test_short_statements(spark):
    docs = [*ODD, (50, "Some text.\nALL rights  reserved.\nMore. All rights reserved"), (51, "all rights are reserved"), (52, "all rights reserved"), (53, " ".join(words(30, 1)) + " (MIT license)")]
    got = {tuple(r) for r in license_scan.find(table(spark, docs)).collect()}
    n = len(license_scan.TEMPLATES)
    assert got == {(50, "All-Rights-Reserved", n, 1, 1, 2), (52, "All-Rights-Reserved", n, 1, 1, 0), (53, "MIT", n + 1, 1, 1, 30)}
    with pytest.raises(ValueError):
        license_scan.find(table(spark, docs), short=[("X", "this one has five words")])


def test_crc_and_json_helpers(spark):
    assert spark.range(1).select(F.crc32(F.lit("12"))).head()[0] == zlib.crc32(b"12")
    assert json.loads(json.dumps({"offset": 1})) == {"offset": 1} and public_tokenizers.path("x").endswith("x")
