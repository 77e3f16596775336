"""Evaluation texts leaking into training text: an FM-index per shard, searched with every test phrase."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keystrata._util import cut_lineage
from keystrata.llm import mailtext
from keystrata.llm._spread import spread

#: Consecutive words that make a leak.
PHRASE = 12
#: Words of a shard's text, distance of sampled suffix positions, characters of test items searched at a time.
SHARD_WORDS, SAMPLE, BLOCK_CHARS = 1 << 20, 16, 16 << 20


def suffix_array(x: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes of ``x`` (symbols 0..sigma-1) in order. Prefix doubling; each round sorts only suffixes still tied."""
    n = len(x)
    bits = max(1, int(sigma).bit_length())
    first = 63 // bits
    padded = np.concatenate([x.astype(np.int64) + 1, np.zeros(first, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(first):
        key = (key << bits) | padded[j : j + n]
    sa = np.argsort(key)
    key = key[sa]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    tied = ~(new & np.append(new[1:], True))
    slots, h = np.flatnonzero(tied), first
    while len(slots):
        at = sa[slots]
        nxt = at + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.empty(len(at), bool)
        new[:1] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        group = np.flatnonzero(new)
        rank[at] = np.repeat(slots[group], np.diff(np.append(group, len(at))))
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class _Bits:
    """A bit vector with rank: packed words and the number of ones before each."""

    def __init__(self, bits: np.ndarray | None, words: np.ndarray | None = None):
        if words is None:
            words = np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, bool)), bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class WaveletMatrix:
    def __init__(self, x: np.ndarray, sigma: int):
        self.n, self.depth = len(x), max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[_Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bit = ((x >> level) & 1).astype(bool)
            self.levels.append((_Bits(bit), int(len(x) - bit.sum())))
            x = np.concatenate([x[~bit], x[bit]])

    @classmethod
    def stored(cls, n: int, words: np.ndarray) -> "WaveletMatrix":
        """The tree of the rows of bit vectors, one per level."""
        tree = cls.__new__(cls)
        tree.n, tree.depth = n, len(words)
        bits = [_Bits(None, w) for w in words]
        tree.levels = [(b, n - b.ones) for b in bits]
        return tree

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol ``c`` before position ``i``."""
        start = np.zeros_like(i)
        for depth, (bits, zeros) in enumerate(self.levels):
            one = (c >> (self.depth - 1 - depth)) & 1 == 1
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and its rank before ``i``."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in self.levels:
            one, a, b = bits.get(i), bits.rank(start), bits.rank(i)
            c = (c << 1) | one
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return c, i - start


class FMIndex:
    """Index of a text of symbols 1..sigma-1 in which 0 separates documents. The text must end with a 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        apart = text == 0
        n_apart = int(apart.sum())
        unique = np.where(apart, np.cumsum(apart) - 1, text + (n_apart - 1))  # separators differ, so no tie runs past one
        sa = suffix_array(unique, sigma + n_apart)
        self.n, self.sigma = len(text), sigma
        bwt = text[sa - 1]
        counts = np.bincount(bwt, minlength=sigma)
        self.less = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        self.tree = WaveletMatrix(bwt, sigma)
        start = np.append(True, apart[:-1])
        keep = (sa % sample == 0) | start[sa]
        self.sampled, self.positions = _Bits(keep), sa[keep]

    def dump(self) -> tuple[bytes, ...]:
        return (
            self.less.tobytes(), np.stack([b.words for b, _ in self.tree.levels]).tobytes(), self.sampled.words.tobytes(), self.positions.astype(np.uint32 if self.n >> 32 == 0 else np.uint64).tobytes()
        )

    @classmethod
    def load(cls, n: int, less: bytes, tree: bytes, sampled: bytes, positions: bytes) -> "FMIndex":
        index = cls.__new__(cls)
        index.n, index.less = n, np.frombuffer(less, np.int64)
        index.sigma = len(index.less)
        index.tree = WaveletMatrix.stored(n, np.frombuffer(tree, np.uint64).reshape(max(1, int(index.sigma - 1).bit_length()), -1))
        index.sampled = _Bits(None, np.frombuffer(sampled, np.uint64))
        index.positions = np.frombuffer(positions, np.uint32 if n >> 32 == 0 else np.uint64).astype(np.int64)
        return index

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with each phrase, by backward search over all phrases at once."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        left = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[left, j].astype(np.int64)
            lo[left] = self.less[c] + self.tree.rank(c, lo[left])
            hi[left] = self.less[c] + self.tree.rank(c, hi[left])
            left = left[lo[left] < hi[left]]
            if not len(left):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled one, add the steps."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            hit = self.sampled.get(rows[left])
            found = left[hit]
            out[found] = self.positions[self.sampled.rank(rows[found])] + steps
            left = left[~hit]
            c, r = self.tree.access(rows[left])
            rows[left] = self.less[c] + r
            steps += 1
        return out


class Phrases:
    """The distinct phrases of a block of test items as numbers of the block's own vocabulary."""

    def __init__(self, items: list[tuple[int, str | None]], phrase: int = PHRASE):
        self.length, ids = phrase, {}
        texts = [[ids.setdefault(x, len(ids)) for x in mailtext.words(text or "")] for _, text in items]
        texts, owners = zip(*[(w, i) for w, (i, _) in zip(texts, items, strict=True) if len(w) >= phrase], strict=True) if any(len(w) >= phrase for w in texts) else ((), ())
        self.words = list(ids)
        rows = [np.lib.stride_tricks.sliding_window_view(np.array(w, np.int32), phrase) for w in texts]
        table = np.concatenate(rows) if rows else np.zeros((0, phrase), np.int32)
        item = np.repeat(np.array(owners, np.int64), [len(r) for r in rows])
        self.table, which = np.unique(table, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), item]), axis=1)
        self.items = pairs[1]
        self.first = np.searchsorted(pairs[0], np.arange(len(self.table) + 1))

    def symbols(self, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the phrases whose every word the vocabulary has, and these phrases in its symbols."""
        symbol = np.array([vocabulary.get(w, 0) for w in self.words], np.int64)
        if not len(self.table):
            return np.zeros(0, np.int64), self.table.astype(np.int64)
        got = np.flatnonzero((symbol > 0)[self.table].all(1))
        return got, symbol[self.table[got]]


class _Numbers(dict):
    """Words by their number, from 1, in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self) + 1
        return number


class Shard:
    """The indexed text of some mail parts. Its alphabet is its own words, so it serves any test items."""

    def __init__(self, index: FMIndex, vocabulary: dict[str, int], starts: np.ndarray, doc: np.ndarray, part: np.ndarray):
        self.index, self.vocabulary, self.starts, self.doc, self.part = index, vocabulary, starts, doc, part

    @classmethod
    def of(cls, texts: list[list[str]], doc: list[int | None], part: list[int]) -> "Shard":
        vocabulary = _Numbers()
        number = vocabulary.__getitem__
        n = np.array([len(w) + 1 for w in texts], np.int64)
        starts = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()), np.int32)
        for at, w in zip(starts.tolist(), texts, strict=True):
            flat[at : at + len(w)] = np.fromiter(map(number, w), np.int32, len(w))
        none = np.iinfo(np.int64).min  # a NULL id
        return cls(FMIndex(flat, len(vocabulary) + 1), vocabulary, starts, np.array([none if d is None else d for d in doc], np.int64), np.array(part, np.int32))

    def spans(self, p: Phrases) -> tuple[np.ndarray, ...]:
        """``doc, item, part, first word, words`` of every maximal run covered by an item's phrases."""
        which, phrases = p.symbols(self.vocabulary)
        lo, hi = self.index.search(phrases)
        got = np.flatnonzero(lo < hi)
        if not len(got):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        n = hi[got] - lo[got]
        rows = np.repeat(lo[got] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at, which = self.index.locate(rows), which[np.repeat(got, n)]
        k = p.first[which + 1] - p.first[which]
        item = p.items[np.repeat(p.first[which] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())]
        at = np.repeat(at, k)
        segment = np.searchsorted(self.starts, at, "right") - 1
        order = np.lexsort((at, item, segment))
        at, item, segment = at[order], item[order], segment[order]
        new = np.append(True, (segment[1:] != segment[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + p.length))
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        s = segment[begin]
        return self.doc[s], item[begin], self.part[s], at[begin] - self.starts[s], at[end] - at[begin] + p.length

    def row(self) -> dict[str, list]:
        cells = (self.index.n, *self.index.dump(), "\0".join(self.vocabulary).encode("utf-8", "surrogatepass"), self.starts.tobytes(), self.doc.tobytes(), self.part.tobytes())
        return {f.name: [c] for f, c in zip(_STORED, cells, strict=True)}

    @classmethod
    def read(cls, b: pa.RecordBatch, i: int) -> "Shard":
        n, less, tree, sampled, positions, words, starts, doc, part = (b.column(f.name)[i].as_py() for f in _STORED)
        vocabulary = {w: k + 1 for k, w in enumerate(words.decode("utf-8", "surrogatepass").split("\0"))}
        return cls(FMIndex.load(n, less, tree, sampled, positions), vocabulary, np.frombuffer(starts, np.int64), np.frombuffer(doc, np.int64), np.frombuffer(part, np.int32))


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("part", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32())])
SPANS = "doc_id bigint, item_id bigint, part int, first_word int, n_words int"
_STORED = pa.schema([("n", pa.int64()), *[(c, pa.binary()) for c in ("less", "tree", "sampled", "positions", "words", "starts", "doc", "part")]])
STORED = "n bigint, less binary, tree binary, sampled binary, positions binary, words binary, starts binary, doc binary, part binary"


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int, least: int) -> Iterator[Shard]:
    texts: list[list[str]] = []
    doc: list[int | None] = []
    number: list[int] = []
    held = 0
    for b in batches:
        for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for k, part in enumerate(mailtext.parts(text.as_py())):
                w = mailtext.part_words(part)
                if len(w) < least:
                    continue
                texts.append(w)
                doc.append(d)
                number.append(k)
                held += len(w)
                if held >= shard_words:
                    yield Shard.of(texts, doc, number)
                    texts, doc, number, held = [], [], [], 0
    if texts:
        yield Shard.of(texts, doc, number)


def _batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    none = found[0] == np.iinfo(np.int64).min
    cols = [pa.array(found[0], pa.int64(), mask=none), *[pa.array(x.astype(t.type.to_pandas_dtype())) for x, t in zip(found[1:], list(_OUT)[1:], strict=True)]]
    return pa.RecordBatch.from_arrays(cols, schema=_OUT)


def index(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", phrase: int = PHRASE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The FM-indexes of the documents' mail parts, a row per shard of about ``shard_words`` words: to be kept and searched often.

    A shard holds its suffix order as a wavelet tree, every ``SAMPLE``-th suffix position, its words, and whose they
    are; some 5 bytes a word. Parts of fewer than ``phrase`` words can't hold a phrase and are left out.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_words, phrase):
            yield pa.RecordBatch.from_pydict(shard.row(), schema=_STORED)

    return _rows(documents, text, doc_id).mapInArrow(go, STORED)


def search(indexes: DataFrame, items: list[tuple[int, str | None]], phrase: int = PHRASE) -> DataFrame:
    """``SPANS`` of a block of test items ``(item_id, text)``, which goes out with the tasks, in kept indexes."""
    p = Phrases(items, phrase)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield _batch(Shard.read(b, i).spans(p))

    return indexes.mapInArrow(go, SPANS)


def _rows(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    return spread(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()))


def leaked_spans(
    documents: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", phrase: int = PHRASE, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``(doc_id, item_id, part, first_word, n_words)``: the spans of documents that ``phrase`` or more words of an item cover.

    ``items`` has ``item_id, text``. Documents stay where they are read: each task cuts its stream of mail parts into
    shards of about ``shard_words`` words and indexes a shard over the shard's own words. Nothing of the corpus is
    shuffled, and memory depends on the shard alone (a part longer than a shard makes a larger one). Word positions count
    within the part, so spans can be cut out; spans of one item that touch are merged. NULL and empty texts have no
    spans; a document row that occurs twice reports its spans twice.

    Items go out with the tasks in blocks of about ``block_chars`` characters (an item longer than that is a block), so
    the driver and a task hold one block at a time. With one block a shard is searched as soon as it is indexed and then
    dropped. With more, the indexes are built once and kept in the checkpoint folder, and each block is a pass over them.
    """
    listed = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= block_chars:
        p = Phrases([(r[0], r[1]) for r in listed.collect()], phrase)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, shard_words, phrase):
                yield _batch(shard.spans(p))

        return _rows(documents, text, doc_id).mapInArrow(go, SPANS)
    kept = cut_lineage(index(documents, text, doc_id, phrase, shard_words))
    found = [cut_lineage(search(kept, held, phrase)) for held in _blocks(listed, block_chars)]
    return reduce(DataFrame.unionByName, found)


def _blocks(listed: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``block_chars`` characters; beside a block the driver holds one partition of the items."""
    held, n = [], 0
    for r in listed.toLocalIterator():
        held.append((r[0], r[1]))
        n += len(r[1])
        if n >= block_chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def merged_removals(spans: DataFrame) -> DataFrame:
    """``(doc_id, part, first_word, n_words)``: the union of all items' spans, overlapping or adjacent ones merged."""
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id", "part").orderBy("first_word", "n_words")
    end = F.col("first_word") + F.col("n_words")
    reach = spans.withColumn("before", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    runs = reach.withColumn("run", F.sum(F.when(F.col("before") >= F.col("first_word"), 0).otherwise(1)).over(w))
    joined = runs.groupBy("doc_id", "part", "run").agg(F.min("first_word").alias("first_word"), (F.max(end) - F.min("first_word")).alias("n_words"))
    return joined.select("doc_id", "part", "first_word", "n_words")


def leaks(spans: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``, each pair once."""
    return spans.select("doc_id", "item_id").distinct()
