import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from keystrata.llm import fmindex, mailtext

texts = st.lists(st.lists(st.integers(1, 4), max_size=30), min_size=1, max_size=8)


def joined(docs):
    return np.concatenate([np.array([*d, 0], np.int32) for d in docs])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=120))
def test_suffix_array(x):
    got = fmindex.suffix_array(np.array(x, np.int32), 6)
    assert got.tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_wavelet_ranks(x):
    t = fmindex.WaveletMatrix(np.array(x, np.int32), 10)
    for c in range(10):
        i = np.arange(len(x) + 1)
        assert t.rank(np.full(len(i), c), i).tolist() == [x[:k].count(c) for k in i]
    c, r = t.access(np.arange(len(x)))
    assert c.tolist() == x and r.tolist() == [x[:i].count(v) for i, v in enumerate(x)]


@settings(max_examples=60, deadline=None)
@given(texts, st.lists(st.integers(1, 4), min_size=3, max_size=3), st.integers(1, 9))
def test_search_and_locate(docs, phrase, sample):
    x = joined(docs)
    index = fmindex.FMIndex(x, 5, sample)
    lo, hi = index.search(np.array([phrase], np.int32))
    at = index.locate(np.arange(lo[0], max(lo[0], hi[0])))
    s = x.tolist()
    assert sorted(at.tolist()) == [i for i in range(len(s) - 2) if s[i : i + 3] == phrase]


def mail(body, kind="text/plain", encoding="7bit"):
    return f"From: a@b.example\nSubject: x\nContent-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: {encoding}\n\n{body}"


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 14, 30])))) for i in range(12)] + [(90, None), (91, ""), (None, "x")]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary + ["zz", "yy"], k=rng.randrange(80))
        if d % 3 == 0:
            src = rng.choice(items[:12])[1].split()
            a = rng.randrange(max(1, len(src) - 12))
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randrange(8, 20)]
        docs.append((d, mail(" ".join(w).upper() if d % 2 else "\n> ".join(w))))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (0, docs[0][1])]
    phrase = {}
    for i, t in items:
        x = mailtext.words(t or "")
        if i is not None:
            for k in range(len(x) - 11):
                phrase.setdefault(tuple(x[k : k + 12]), set()).add(i)
    want, spans = set(), {}
    for d, t in docs:
        for p in mailtext.parts(t):
            x = mailtext.part_words(p)
            hit = [False] * len(x)
            for k in range(len(x) - 11):
                for i in phrase.get(tuple(x[k : k + 12]), ()):
                    want.add((d, i))
                    hit[k : k + 12] = [True] * 12
            spans[d] = hit
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).repartition(3)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1, 10**6):
        found = fmindex.leaked_spans(df, it, shard_words=size)
        assert {tuple(r) for r in fmindex.leaks(found).collect()} == want and len(want) > 5
    cut = {}
    for r in fmindex.merged_removals(found).collect():
        assert all(spans[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]])
        cut[r["doc_id"]] = cut.get(r["doc_id"], 0) + r["n_words"]
    assert {d: n for d, n in cut.items() if d} == {d: sum(h) for d, h in spans.items() if any(h) and d}
    assert fmindex.leaked_spans(df.limit(0), it).count() == 0 and fmindex.leaked_spans(df, it.limit(0)).count() == 0


def test_blocks_of_items(spark):
    """Each block is a pass over indexes that are built once, with the rows that a single block gives."""
    items = [(i, " ".join(f"i{i % 7}w{k}" for k in range(14))) for i in range(10)]
    docs = [(i, mail("see: " + items[i][1] + f" end{i}")) for i in range(10)] * 3 + [(None, mail(items[0][1]))]
    d, it = spark.createDataFrame(docs, "doc_id int, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    want = fmindex.leaked_spans(d, it)
    assert {tuple(r) for r in fmindex.leaks(want).collect()} >= {(i, i) for i in range(10)} | {(0, 7), (7, 0), (None, 0)}
    for chars in (200, 10**6):
        got = fmindex.leaked_spans(d, it, block_chars=chars)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    kept = fmindex.index(d, shard_words=200)
    assert 4 <= kept.count() <= 8
    assert sorted(map(str, fmindex.search(kept, items).collect())) == sorted(map(str, want.collect()))


def test_each_shard_is_indexed_once(spark, tmp_path, monkeypatch):
    """Counted by a file that each build leaves, however many blocks there are."""
    built = fmindex._shards

    def counted(batches, words, least):
        import uuid

        for shard in built(batches, words, least):
            (tmp_path / uuid.uuid4().hex).touch()
            yield shard

    monkeypatch.setattr(fmindex, "_shards", counted)
    monkeypatch.setattr(fmindex, "index", _local(fmindex.index, _shards=counted))
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(10)]
    d = spark.createDataFrame([(i, mail(items[i][1])) for i in range(10)], "doc_id int, text string").coalesce(2)
    got = fmindex.leaked_spans(d, spark.createDataFrame(items, "item_id bigint, text string"), block_chars=150)
    assert got.count() == 10
    builds = len(list(tmp_path.iterdir()))
    assert builds == fmindex.index(d).count() < 10


def _local(f, **names):
    """The function with some of its module's names replaced, so that what it sends to the workers carries them."""
    import types

    return types.FunctionType(f.__code__, f.__globals__ | names, f.__name__, f.__defaults__, f.__closure__)


def test_mails_of_the_smallest_tables_against_plain_python(spark):
    base = "/root/testdata/sf0.001"
    items = [(r[0], mailtext.words(r[1] or "")) for r in spark.read.parquet(f"{base}/eval_items.parquet").select("item_id", "text").collect()]
    phrase = {}
    for i, w in items:
        for k in range(len(w) - 11):
            phrase.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    for d, t in docs.collect():
        for p in mailtext.parts(t):
            w = mailtext.part_words(p)
            for k in range(len(w) - 11):
                want |= {(d, i) for i in phrase.get(tuple(w[k : k + 12]), ())}
    got = fmindex.leaks(fmindex.leaked_spans(docs, spark.read.parquet(f"{base}/eval_items.parquet")))
    assert {tuple(r) for r in got.collect()} == want and want
