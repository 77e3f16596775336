"""Filling fixed-capacity containers with whole documents by sum-of-squares packing."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keystrata.llm._spread import spread

#: Rank file of a public byte-pair tokenizer, and the pattern that splits text before its merges (fixed value).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a packing shard; most targets in one call.
DOCS_PER_SHARD, MAX_TARGETS = 20_000, 1000
#: Tokens of a class of gaps. Of 1 to 64, 8 left the least space unused on the largest test texts.
GAP_WIDTH = 8


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", ranks: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)`` of whole texts; a NULL or empty text has none.

    ``ranks`` must lie on every executor; without it the session's ``spark.keystrata.ranks`` says where, or ``RANKS``.
    """
    ranks = ranks or documents.sparkSession.conf.get("spark.keystrata.ranks", RANKS)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if (t := v.as_py()) else 0 for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(go, "doc_id bigint, n_tokens bigint")


def pack(sizes: np.ndarray, capacity: int, width: int = GAP_WIDTH) -> np.ndarray:
    """Bin numbers of items of 1..capacity, placed one after the other.

    Gaps are counted in classes of ``width`` tokens; a bin whose gap lies in the lowest class is closed to the count.
    Each item goes where the sum over classes of N(class)^2, N being the number of open bins, becomes smallest: into an
    open bin or a new one. Of equal choices the open bin with the smallest gap wins, a new bin comes last.
    """
    kind = np.arange(capacity + 1) // width
    count = np.zeros(capacity + 1, np.int64)  # bins by exact gap
    open_ = np.zeros(kind[-1] + 1, np.int64)  # bins by class of gap
    bins: dict[int, list[int]] = {}
    out, used, never = np.empty(len(sizes), np.int64), 0, np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        # a bin that moves from class a to b changes the sum by 2 * (N(b) - N(a)) + 2, by nothing if a is b, and by
        # 1 - 2 * N(a), or nothing from the lowest class, if b is the lowest
        a, b = kind[s:], kind[: capacity - s + 1]
        cost = np.where(a == b, 0, np.where(b == 0, 1 - 2 * open_[a], 2 * (open_[b] - open_[a]) + 2))
        cost = np.where(count[s:] > 0, cost, never)
        j = int(cost.argmin())
        new = kind[capacity - s]
        if count[s + j] and cost[j] <= (2 * int(open_[new]) + 1 if new else 0):
            gap = s + j
            where = bins[gap].pop()
            count[gap] -= 1
            open_[kind[gap]] -= 1
        else:
            gap, where = capacity, used
            used += 1
        out[i] = where
        if gap > s:
            count[gap - s] += 1
            open_[kind[gap - s]] += 1
            bins.setdefault(gap - s, []).append(where)
    return out


def containers(counts: DataFrame, targets: DataFrame, docs_per_shard: int = DOCS_PER_SHARD, width: int = GAP_WIDTH) -> DataFrame:
    """``(target_id, shard, container, doc_id, piece, first_token, n_tokens)``: where each document goes for each target.

    ``targets`` has ``target_id, capacity_tokens``. A document longer than a container is cut into full containers and a
    rest that is packed like any other; all others stay whole. Documents without tokens come out with a NULL container.
    A hash spreads the documents over shards of about ``docs_per_shard``, each packed by itself in order of the hash, so
    the work grows in proportion and the unused space of a shard is a few open containers. Containers are named by
    target, shard and number. Targets of NULL or non-positive capacity are ignored. Repeated rows are packed repeatedly.
    """
    wanted = targets.where("target_id IS NOT NULL AND capacity_tokens > 0").select("target_id", "capacity_tokens").limit(MAX_TARGETS + 1).collect()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    shards = max(1, round(counts.count() / docs_per_shard))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target_id"), F.lit(c).cast("bigint").alias("capacity")) for t, c in wanted])) if wanted else None
    schema = "target_id bigint, shard int, container bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint"
    if each is None:
        return counts.sparkSession.createDataFrame([], schema)
    hashed = counts.select("doc_id", "n_tokens", F.xxhash64("doc_id").alias("h"))
    dealt = hashed.select("doc_id", "n_tokens", "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), each.alias("t"))
    dealt = dealt.select("t.target_id", "shard", "t.capacity", "doc_id", "n_tokens", "h")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["h", "doc_id", "n_tokens"])
        n, ids = pdf["n_tokens"].to_numpy(), pdf["doc_id"].to_numpy()
        pieces = np.maximum(1, -(-n // cap))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(cap, n[row] - piece * cap)
        order = np.flatnonzero(size > 0)
        where = np.full(len(row), -1, np.int64)
        where[order] = pack(size[order], cap, width)
        return pd.DataFrame(
            {
                "target_id": pdf["target_id"].iloc[0], "shard": pdf["shard"].iloc[0], "container": pd.array(where, dtype="Int64"), "doc_id": ids[row],
                "piece": piece.astype(np.int32), "first_token": piece * cap, "n_tokens": size,
            }
        ).assign(container=lambda x: x["container"].mask(x["container"] < 0))

    dealt = dealt.repartition(min(10_000, shards * len(wanted)), "target_id", "shard")  # few bytes, much work: not to be merged
    return dealt.groupBy("target_id", "shard").applyInPandas(one, schema)


def faults(packed: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target_id, overfull, split, tokens_off, documents)``: faults of a packing of ``counts``, and the documents it places.

    Containers that hold more than fits, documents in pieces that fit into one, and by how many tokens pieces and
    documents differ (over all documents, taken one by one). Sums per container and document with map-side combine.
    """
    sizes = targets.where("target_id IS NOT NULL AND capacity_tokens > 0").select("target_id", F.col("capacity_tokens").alias("capacity"))
    sizes = F.broadcast(sizes)  # at most MAX_TARGETS rows, or there is no packing
    held = packed.where("container IS NOT NULL").groupBy("target_id", "shard", "container").agg(F.sum("n_tokens").alias("t")).join(sizes, "target_id")
    over = held.groupBy("target_id").agg(F.count_if(F.col("t") > F.col("capacity")).cast("int").alias("overfull"))
    rows = counts.groupBy("doc_id").agg(F.sum("n_tokens").alias("want"), F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("copies"))
    placed = packed.groupBy("target_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"))
    both = placed.join(rows, placed["doc_id"].eqNullSafe(rows["doc_id"])).join(sizes, "target_id")
    split = F.count_if((F.col("longest") <= F.col("capacity")) & (F.col("pieces") > F.col("copies"))).cast("int")
    per = both.groupBy("target_id").agg(split.alias("split"), F.sum(F.abs(F.col("got") - F.col("want"))).cast("int").alias("tokens_off"), F.sum("copies").alias("documents"))
    return per.join(over, "target_id", "left").select("target_id", F.coalesce("overfull", F.lit(0)).alias("overfull"), "split", "tokens_off", "documents")


def fill(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: containers, tokens, share of the space that is used, and the fewest containers any packing needs."""
    used = packed.where("container IS NOT NULL")
    per = used.groupBy("target_id").agg(F.count_distinct("shard", "container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    got = per.join(targets.select("target_id", "capacity_tokens"), "target_id")
    return got.select(
        "target_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("at_least"),
    )
