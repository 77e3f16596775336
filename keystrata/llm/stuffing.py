"""Keyword-stuffed and link-list pages: a hidden Markov model labels lines, pages are flagged by non-prose word share."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keystrata._util import cut_lineage
from keystrata.llm import mailtext
from keystrata.llm._spread import spread

#: Labels of lines, and the hidden states behind them: prose is sentences, or the short lines and figures beside them.
STATES = ("prose", "links", "tags", "menu")
HIDDEN = ("sentence", "note", "links", "tags", "menu")
LABEL = (0, 0, 1, 2, 3)

#: A word of at least this share of a language's documents is a function word of it; share and documents are told apart
#: from chance by so many standard errors, and languages of fewer documents teach none.
COMMON_SHARE, ERRORS, LEAST_DOCS = 0.3, 3.0, 30
#: Words that a task counts before it passes its counts on.
HELD_WORDS = 500_000

_URL = re.compile(r"((?:https?://|www\.)[^\s)\]>\"']+)", re.I)
_TAG = re.compile(r"(?<!\w)#\w|\]\(|\b[A-Za-z]{2,6}-\d{3,}\b|[\w)] \| \w")
#: Distance in words within which a word counts as repeated.
NEAR = 30
#: A line of more than LONG words is labelled in pieces of CHUNK.
LONG, CHUNK = 20, 12
#: Levels of the features of a line; a symbol is their mixed-radix number.
LEVELS = (3, 3, 4, 3, 3)
N_SYMBOLS = math.prod(LEVELS)
SHARE = 0.5
FIT_ROUNDS = 8
#: Symbols of a sequence that are fitted in one piece, and pieces that are fitted together.
FIT_LINES, FIT_PIECES = 128, 8192
#: Steps of one in which expected counts are summed: sums of whole numbers are the same in any order.
UNIT = 1 << 20


class Line(NamedTuple):
    symbol: int
    words: int


def _level(x: float, *bounds: float) -> int:
    return bisect_right(bounds, x)


def part_lines(lines: list[str], common: frozenset[str] = frozenset()) -> list[Line]:
    """Symbol and word count of each line that has words; long lines come in pieces.

    ``common`` holds the function words. Features: share of words in link addresses; share of function words (but for those that follow the
    same word for the third time within ``NEAR`` words); share of other words that are repeated within ``NEAR`` words on either side; tag marks, or mostly figures; length.
    """
    rows: list[tuple[bool, int, int, int]] = []  # tag marks, words of links, begin and end among the text words
    text: list[str] = []
    for line in lines:
        pieces = _URL.split(line) if "://" in line or "www." in line or "WWW." in line else [line]
        counts = [(mailtext.words(pieces[0]), 0)]
        if len(pieces) > 1:
            counts += [(mailtext.words(p), len(mailtext.words(u))) for p, u in zip(pieces[2::2], pieces[1::2], strict=True)]
        total = sum(len(w) + n for w, n in counts)
        if not total:
            continue
        marked = bool(_TAG.search(line))
        begin, links = len(text), 0
        for w, n in counts:
            links += n
            while total > LONG and len(text) - begin + links + len(w) >= CHUNK:
                take = max(0, CHUNK - (len(text) - begin) - links)
                text += w[:take]
                w = w[take:]
                rows.append((marked, links, begin, len(text)))
                begin, links = len(text), 0
            text += w
        if links or len(text) > begin:
            rows.append((marked, links, begin, len(text)))
    near = bytearray(len(text))
    last: dict[str, int] = {}
    for i, w in enumerate(text):
        j = last.get(w)
        if j is not None and i - j <= NEAR:
            near[i] = near[j] = 1
        last[w] = i
    free = bytearray(len(text))  # function words, unless after the same word for the third time within NEAR
    pairs: dict[tuple[str, str], tuple[int, int]] = {}
    for i, w in enumerate(text):
        if w in common:
            pair = (text[i - 1] if i else "", w)
            before, latest = pairs.get(pair, (-NEAR, -NEAR))
            free[i] = i - before >= NEAR
            pairs[pair] = (latest, i)
    out = []
    for marked, links, begin, end in rows:
        own, total = text[begin:end], end - begin + links
        small = sum(free[begin:end])
        figures = sum(map(str.isdigit, own))
        rest = [near[begin + i] for i, w in enumerate(own) if w not in common and not w.isdigit()]
        marks = 2 if own and figures * 2 >= len(own) else 1 if marked else 0
        levels = (
            _level(links / total, 0.2, 0.5),
            _level(small / max(1, len(own)), 0.08, 0.2),
            _level(sum(rest) / max(1, len(rest)), 0.25, 0.55, 0.8),
            marks,
            _level(total, 4, 10),
        )
        symbol = 0
        for base, x in zip(LEVELS, levels, strict=True):
            symbol = symbol * base + x
        out.append(Line(symbol, total))
    return out


#: What a line of each state looks like before the model is fitted, per feature and level.
PRIOR = {
    "sentence": ((0.95, 0.03, 0.02), (0.02, 0.08, 0.90), (0.80, 0.15, 0.04, 0.01), (0.95, 0.02, 0.03), (0.10, 0.20, 0.70)),
    "note": ((0.96, 0.02, 0.02), (0.80, 0.10, 0.10), (0.70, 0.10, 0.04, 0.16), (0.78, 0.02, 0.20), (0.65, 0.30, 0.05)),
    "links": ((0.02, 0.23, 0.75), (0.85, 0.10, 0.05), (0.45, 0.20, 0.15, 0.20), (0.80, 0.18, 0.02), (0.05, 0.40, 0.55)),
    "tags": ((0.90, 0.08, 0.02), (0.75, 0.20, 0.05), (0.05, 0.07, 0.18, 0.70), (0.70, 0.28, 0.02), (0.08, 0.22, 0.70)),
    "menu": ((0.40, 0.30, 0.30), (0.85, 0.12, 0.03), (0.03, 0.07, 0.20, 0.70), (0.30, 0.68, 0.02), (0.20, 0.60, 0.20)),
}
STAY = 0.9
#: Weight of the prior tables, in sequences, moves and lines, against the counts of up to PRIOR_DOCS documents; of more, in proportion.
PRIOR_STARTS, PRIOR_MOVES, PRIOR_LINES, PRIOR_DOCS = 100.0, 500.0, 5000.0, 4000


class Model(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    features: tuple[np.ndarray, ...]  # per feature: states x levels
    common: frozenset[str] = frozenset()  # function words

    def emission(self) -> np.ndarray:
        """States x symbols: product of the features."""
        out = np.ones((len(HIDDEN), 1))
        for f in self.features:
            out = (out[:, :, None] * f[:, None, :]).reshape(len(HIDDEN), -1)
        return out


def prior() -> Model:
    n = len(HIDDEN)
    start = np.array([0.45, 0.46, 0.03, 0.03, 0.03])
    move = np.full((n, n), (1 - STAY) / (n - 1))
    np.fill_diagonal(move, STAY)
    move[:2, :2] = [[0.78, 0.18], [0.40, 0.56]]
    move[:2, 2:] = 0.04 / 3
    return Model(start, move, tuple(np.array([PRIOR[s][k] for s in HIDDEN]) for k in range(len(LEVELS))))


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of at most ``FIT_LINES`` symbols, longest first, padded: symbols, lengths, and which begin a sequence."""
    pieces = [(x[i : i + FIT_LINES], i == 0) for x in sequences for i in range(0, len(x), FIT_LINES)]
    pieces.sort(key=lambda p: -len(p[0]))
    n = np.array([len(x) for x, _ in pieces], np.int64)
    x = np.zeros((len(pieces), n[0] if len(n) else 0), np.int64)
    for row, (piece, _) in zip(x, pieces, strict=True):
        row[: len(piece)] = piece
    return x, n, np.array([b for _, b in pieces], bool)


def _times(v: np.ndarray, move: np.ndarray) -> np.ndarray:
    """``move.T @ v`` one product at a time, so that a column doesn't depend on those beside it."""
    out = v[0] * move[0][:, None]
    for i in range(1, len(v)):
        out += v[i] * move[i][:, None]
    return out


def expected(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Expected counts under the model in units of 1 / ``UNIT``: starts, moves and states of symbols, flat.

    A sequence adds the same whole numbers whatever it is counted with, so counts of parts of a corpus add up exactly.
    All pieces take a step at a time together; arrays are states x pieces.
    """
    k = len(HIDDEN)
    x, n, begins = _padded(sequences)
    steps = x.shape[1]
    open_ = np.searchsorted(-n, -np.arange(steps), "left").tolist()  # pieces longer than t
    e, move = np.ascontiguousarray(model.emission()), model.move
    start, moved, seen = np.zeros(k), np.zeros((k, k)), np.zeros((k, N_SYMBOLS))
    whole = lambda c: np.rint(c * UNIT)
    forward, scales = [], []
    for t in range(steps):
        m = open_[t]
        v = (model.start[:, None] if t == 0 else _times(forward[-1][:, :m], move)) * e[:, x[:m, t]]
        scale = sum(v[1:], v[0])
        forward.append(v / scale)
        scales.append(scale)
    b = np.ones((k, open_[-1] if steps else 0))
    for t in range(steps - 1, -1, -1):
        m = open_[t]
        b = np.concatenate([b, np.ones((k, m - b.shape[1]))], 1)
        g = forward[t] * b
        g = whole(g / sum(g[1:], g[0]))
        for s in range(k):
            seen[s] += np.bincount(x[:m, t], g[s], N_SYMBOLS)
        if t == 0:
            start += g[:, begins].sum(1)
        else:
            eb = e[:, x[:m, t]] * b / scales[t]
            for i in range(k):
                moved[i] += whole(forward[t - 1][i, :m] * move[i][:, None] * eb).sum(1)
            b = _times(eb, move.T)
    return np.concatenate([start, moved.ravel(), seen.ravel()]).astype(np.int64)


N_COUNTS = len(HIDDEN) * (1 + len(HIDDEN) + N_SYMBOLS)


def refitted(counts: np.ndarray, docs: int = 0) -> Model:
    """The model of the expected counts of ``docs`` documents, with the prior's tables as pseudo-counts so that states keep their meaning."""
    p, k, c = prior(), len(HIDDEN), counts / UNIT
    weight = max(1.0, docs / PRIOR_DOCS)
    start = p.start * PRIOR_STARTS * weight + c[:k]
    move = p.move * PRIOR_MOVES * weight + c[k : k + k * k].reshape(k, k)
    seen = c[k + k * k :].reshape(k, N_SYMBOLS)
    digits = np.array(np.unravel_index(np.arange(N_SYMBOLS), LEVELS))
    features = []
    for i, base in enumerate(LEVELS):
        f = np.stack([seen[:, digits[i] == level].sum(1) for level in range(base)], 1) + PRIOR_LINES * weight * p.features[i]
        features.append(f / f.sum(1, keepdims=True))
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), tuple(features))


def fit(sequences: list[np.ndarray], rounds: int = FIT_ROUNDS, docs: int = 0) -> Model:
    """Baum-Welch from the prior on sequences of ``docs`` documents in memory; ``fit_lines`` does it on a table."""
    model = prior()
    for _ in range(rounds):
        model = refitted(expected(model, sequences), docs)
    return model


class Labeller:
    """Most likely states of sequences of symbols (Viterbi in log space), all sequences a step at a time."""

    def __init__(self, model: Model):
        with np.errstate(divide="ignore"):
            self.start, self.e, self.move = np.log(model.start), np.log(model.emission()), np.log(model.move)

    def states(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        n = np.array([len(x) for x in sequences], np.int64)
        order = np.argsort(-n, kind="stable")
        flat = np.concatenate(sequences).astype(np.int64) if len(sequences) else np.zeros(0, np.int64)
        begin, length = (np.cumsum(n) - n)[order], n[order]
        steps = int(length[0]) if len(n) else 0
        open_ = np.searchsorted(-length, -np.arange(steps), "left").tolist()  # sequences longer than t
        out = np.zeros(len(flat), np.int8)
        v, back = np.zeros((len(HIDDEN), 0)), []
        ends = np.zeros(len(n), np.int8)
        for t in range(steps):
            m = open_[t]
            e = self.e[:, flat[begin[:m] + t]]
            if t == 0:
                v = self.start[:, None] + e
            else:
                ways = v[:, None, :m] + self.move[:, :, None]
                back.append(ways.argmax(0).astype(np.int8))
                v = ways.max(0) + e
            m_next = open_[t + 1] if t + 1 < steps else 0
            ends[m_next:m] = v[:, m_next:].argmax(0)
        at = ends.copy()
        for t in range(steps - 1, -1, -1):
            m = open_[t]
            out[begin[:m] + t] = at[:m]
            if t:
                at[:m] = back[t - 1][at[:m], np.arange(m)]
        return np.split(out, np.cumsum(n)[:-1]) if len(n) else []


def function_words(documents: DataFrame, text: str = "text", lang: str | None = None) -> frozenset[str]:
    """The function words of the corpus: those in at least ``COMMON_SHARE`` of the documents of a language.

    Languages are the values of the column ``lang`` up to the first hyphen, whatever their case, NULL being one more; wrong
    values do no harm as long as they are few in their language. Without ``lang`` the corpus counts as one language. All
    documents are counted, with sums that are combined in the task; what comes to the driver has at most as many words per
    language as a document has different ones on average, divided by the share. Numbers are no words. It is taken for
    granted that pages stuffed with the same words are less than that share of a language.
    """
    tag = F.lower(F.split(F.coalesce(F.col(lang).cast("string"), F.lit("")), "[-_]")[0]) if lang else F.lit("")
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()

        def told() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

        for b in batches:
            for t, language in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = {w for lines in mailtext.own_lines(t.as_py()) for line in lines for w in mailtext.words(line)}
                counts.update((language, w) for w in own if not w.isdigit())
                counts[language, ""] += 1  # the documents of the language
                if len(counts) > HELD_WORDS:
                    yield told()
                    counts.clear()
        yield told()

    rows = spread(documents.select(F.col(text).alias("text"), tag.alias("lang")).where(F.col("text").isNotNull()))
    counted = rows.mapInArrow(go, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    docs = counted.where("word = ''").select("lang", F.col("n").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    p, d, z = F.col("n") / F.col("docs"), F.col("docs"), ERRORS
    low = (p + z * z / (2 * d) - z * F.sqrt(p * (1 - p) / d + z * z / (4 * d * d))) / (1 + z * z / d)  # end of the score interval
    got = counted.where("word != ''").join(docs, "lang").where(low >= COMMON_SHARE).select("word").distinct().collect()
    return frozenset(r[0] for r in got)


def lines_of(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", common: frozenset[str] = frozenset()) -> DataFrame:
    """``(doc_id, sizes, symbols, words)``: of each document, lines per text part, and all lines' symbols and words.

    Numbers of 4, 2 and 4 bytes in binary columns. A NULL or empty text, or one without words, has no lines. Repeated
    rows come out repeatedly.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("sizes", pa.binary()), ("symbols", pa.binary()), ("words", pa.binary())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list[bytes], ...] = ([], [], [])
            for t in b.column(1):
                got = [part_lines(lines, common) for lines in mailtext.own_lines(t.as_py())]
                flat = [x for lines in got for x in lines]
                out[0].append(np.array([len(lines) for lines in got], np.uint32).tobytes())
                out[1].append(np.array([x.symbol for x in flat], np.uint16).tobytes())
                out[2].append(np.array([x.words for x in flat], np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.binary()) for x in out]], schema=schema)

    rows = spread(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInArrow(go, "doc_id bigint, sizes binary, symbols binary, words binary")


def _parted(sizes: bytes, numbers: np.ndarray) -> list[np.ndarray]:
    return np.split(numbers, np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64)[:-1]) if sizes else []


def fit_lines(lines: DataFrame, rounds: int = FIT_ROUNDS) -> Model:
    """Baum-Welch from the prior on all rows of ``lines_of``, which should be materialised: a pass over them each round.

    Each round's expected counts are summed as whole numbers, so the model depends on the rows alone, not on how they
    lie. Some 1,700 sums come to the driver a round. An empty table gives the prior.
    """
    docs, model = lines.count(), prior()
    for _ in range(rounds):

        def go(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total, held, n = np.zeros(N_COUNTS, np.int64), [], 0
            for b in batches:
                for sizes, symbols in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for x in _parted(sizes, np.frombuffer(symbols, np.uint16)):
                        held.append(x)
                        n += -(-len(x) // FIT_LINES)
                    if n >= FIT_PIECES:
                        total += expected(model, held)
                        held, n = [], 0
            total += expected(model, held)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_COUNTS, dtype=np.int32)), pa.array(total)], names=["cell", "n"])

        sums = lines.select("sizes", "symbols").mapInArrow(go, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(N_COUNTS, np.int64)
        for cell, n in sums:
            counts[cell] = n
        model = refitted(counts, docs)
    return model


def train(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", docs: int | None = None, lang: str | None = None) -> Model:
    """The model fitted on all documents, or on about ``docs`` of them, chosen by a hash of their id; function words are those of all."""
    common = function_words(documents, text, lang)
    if docs is not None:
        documents = documents.where(F.pmod(F.xxhash64(doc_id), F.lit(max(1, documents.count() // docs))) == 0)
    return fit_lines(cut_lineage(lines_of(documents, text, doc_id, common)))._replace(common=common)


def shares_of(lines: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_words, prose, links, tags, menu)``: words of each row of ``lines_of`` by the label of their line.

    The model (a few hundred numbers) goes out with the tasks.
    """
    labeller = Labeller(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), *[(s, pa.int64()) for s in STATES]])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [_parted(sizes, np.frombuffer(symbols, np.uint16)) for sizes, symbols in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            states = labeller.states([x for parts in held for x in parts])
            size = [np.frombuffer(w, np.uint32) for w in b.column(3).to_pylist()]
            doc = np.repeat(np.arange(b.num_rows), [len(w) for w in size])
            label = np.array(LABEL)[np.concatenate(states)] if states else np.zeros(0, np.int64)
            words = np.concatenate(size) if size else np.zeros(0, np.uint32)
            cols = [np.bincount(doc[label == k], words[label == k], b.num_rows).astype(np.int64) for k in range(len(STATES))]
            total = sum(cols)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (total, *cols)]], schema=schema)

    return lines.mapInArrow(go, "doc_id bigint, n_words bigint, " + ", ".join(f"{s} bigint" for s in STATES))


def line_shares(documents: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``shares_of`` the lines of documents, in one pass without a shuffle. A text without words has zeros."""
    return shares_of(lines_of(documents, text, doc_id, model.common), model)


def flagged(shares: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents of whose words more than ``share`` lie outside prose."""
    return shares.where((F.col("n_words") > 0) & (F.col("n_words") - F.col("prose") > F.lit(share) * F.col("n_words")))
