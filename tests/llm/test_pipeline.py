"""Each stage of the pipeline, and the whole, against plain Python over a small corpus with odd rows."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm import knn_quality, pack_pow2, queries
from weftline.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, `row` int, `node` int, `Gone` int"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def corpus():
    """Good prose, marked junk, copies, near copies, shared passages, leaks; null and repeated ids, empty texts."""
    texts = {100 + i: " ".join(words(70 + i, i)) for i in range(24)}
    texts |= {200 + i: " ".join(w + "$$$#" for w in words(60, 300 + i)) for i in range(24)}
    texts[130] = texts[101]
    near = texts[102].split()
    near[3] = "other"
    texts[131] = " ".join(near)
    shared = words(60, 50)
    for i in range(4):
        texts[140 + i] = " ".join([*words(40 + i, 400 + i), *shared, *words(30, 500 + i)])
    texts[150] = " ".join([*words(30, 600), *item(), *words(30, 601)])
    altered = item()
    altered[4] = altered[9] = "zz"
    texts[151] = " ".join([*words(31, 602), *altered, *words(30, 603)])
    texts[160], texts[161], texts[162] = None, "", "one"
    texts[163] = " ".join(words(3000, 700))
    rows = [*texts.items(), (163, texts[163]), (164, " ".join(words(80, 800))), (164, " ".join(words(80, 801)))]
    rows += [(None, " ".join([*words(30, 900), *item()])), (None, " ".join(words(90, 901))), (None, None)]
    return rows


def item():
    return words(20, 4)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    frame(spark, corpus()).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(100, 124), *range(200, 224)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item())), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "kept", 7, 8, 9) for i, t in rows], SCHEMA)


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def good(spark, d, rows):
    """By all cosines at once."""
    model = queries.quality_model(frame(spark, rows), spark, d)
    labelled = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    known = {i for i, t in rows if t and t.strip()}
    assert len(model.labels) == len(labelled.keys() & known)
    out = Counter()
    for i, t in rows:
        x = knn_quality.features([(t or "").encode()])
        s = (model.project(x) @ model.vectors.T)[0]
        top = np.argsort(-s, kind="stable")[: model.neighbours]
        w = np.maximum(s[top], 0).astype(float) ** knn_quality.SHARPNESS + 1e-9
        if x.any() and (w * model.labels[top]).sum() / w.sum() >= 0.5:
            out[i, t] += 1
    return out


def fives(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def unlike(rows):
    """The rows that stay when one of each group of linked documents does, and one row of each doc_id."""
    texts, parent = {}, {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, []).append(fives(t))
            parent[i] = i

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in texts:
        for b in texts:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in texts[a] for y in texts[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in texts if find(i) == i}


def without_passages(rows):
    """Texts without the words of 50-word windows that an earlier document holds."""
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").lower().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = Counter()
    for i, t in rows:
        w = (t or "").split()
        gone = {j for k in range(len(w) - 49) if i is not None and first.get(tuple(x.lower() for x in w[k : k + 50]), i) < i for j in range(k, k + 50)}
        if gone:
            t = " ".join(x for k, x in enumerate(w) if k not in gone)
        if not gone or t:
            out[i, t] += 1
    return out


def leaks(text):
    w, it = (text or "").lower().split(), item()
    return any(sum(a == b for a, b in zip(w[k : k + 15], it[j : j + 15], strict=True)) >= 12 for k in range(len(w) - 14) for j in range(len(it) - 14))


def pieces(rows):
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    out = Counter()
    for i, t in rows:
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0
        for n in pack_pow2.piece_lengths(len(ids)):
            out[i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    return out


def test_quality(spark, tables):
    got = corpus_pipeline.quality(spark, frame(spark, corpus()), tables)
    assert rows_of(got) == good(spark, tables, corpus()) and got.columns == frame(spark, []).columns
    kept = {i for i, _ in rows_of(got)}
    assert kept >= set(range(100, 124)) and not kept & set(range(200, 224)) and not kept & {160, 161}
    assert corpus_pipeline.quality(spark, frame(spark, []), tables).count() == 0


def test_near_duplicates(spark, tables):
    got, stay = corpus_pipeline.near_duplicates(spark, frame(spark, corpus()), tables), unlike(corpus())
    assert got.columns == frame(spark, []).columns and not stay & {130, 131}
    found = rows_of(got)
    assert {i for i, _ in found} == stay | {None} and sum(found.values()) == len(stay) + 3
    assert all(r in {x: 1 for x in corpus()} for r in found)
    assert corpus_pipeline.near_duplicates(spark, frame(spark, []), tables).count() == 0


def test_passages(spark, tables):
    once = [r for k, r in enumerate(corpus()) if r[0] not in (130, 131, 163, 164)]
    got = corpus_pipeline.passages(spark, frame(spark, once), tables)
    assert got.columns == frame(spark, []).columns
    assert Counter({(i, None if t is None else " ".join(t.split())): n for (i, t), n in rows_of(got).items()}) == without_passages(once)
    assert all(r.n_chars == len(r.text) for r in got.where("text is not null").collect())
    assert corpus_pipeline.passages(spark, frame(spark, []), tables).count() == 0


def test_decontamination_judges_each_row(spark, tables):
    got = corpus_pipeline.decontaminate(spark, frame(spark, corpus()), tables)
    assert rows_of(got) == Counter(r for r in corpus() if not leaks(r[1])) and got.columns == frame(spark, []).columns
    assert (None, " ".join(words(90, 901))) in rows_of(got) and not {150, 151} & {i for i, _ in rows_of(got)}
    assert corpus_pipeline.decontaminate(spark, frame(spark, []), tables).count() == 0


def test_packing(spark, tables):
    got = corpus_pipeline.pack(spark, frame(spark, corpus()), tables)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect()) == pieces(corpus())
    assert corpus_pipeline.pack(spark, frame(spark, []), tables).count() == 0


def test_whole_pipeline(spark, tables):
    """Ids are unique here but for nulls, which the second stage leaves alone."""
    rows = [r for r in corpus() if r[0] not in (163, 164)]
    path = tables + "-unique"
    frame(spark, rows).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    kept = list(good(spark, path, rows).elements())
    stay = unlike(kept)
    kept = list(without_passages([r for r in kept if r[0] is None or r[0] in stay]).elements())
    kept = [r for r in kept if not leaks(r[1])]
    got = corpus_pipeline.run(spark, path)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect()) == pieces(kept)
    frame(spark, []).write.mode("overwrite").parquet(f"{path}-empty/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.mode("overwrite").parquet(f"{path}-empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{path}-empty").count() == 0


@pytest.mark.parametrize("stage", [corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.passages, corpus_pipeline.decontaminate, corpus_pipeline.pack])
def test_stages_begin_by_giving_heap_back(spark, monkeypatch, stage):
    """The heap is collected whole before the stage reads its documents."""
    seen, factory = [], spark.sparkContext._jvm.java.lang.management.ManagementFactory
    whole = lambda: sum(x.getCollectionCount() for x in factory.getGarbageCollectorMXBeans() if re.search("Old|MarkSweep", x.getName()))

    class Read(Exception):
        pass

    class Docs:
        def __getattr__(self, name):
            seen.append(whole())
            raise Read

    before = whole()
    with pytest.raises(Read):
        stage(spark, Docs(), "")
    assert seen[0] >= before + spark.sparkContext.defaultParallelism
