"""Queries p3, p4, p7, p8 and p9."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from keystrata._util import cut_lineage
from keystrata.llm import fmindex, heavy_hitters, packing, seen_keys, stuffing
from keystrata.sources.tables import table

#: Promised rate of wrong answers of the seen-key chains.
BOUND = 1e-6
SHARE = Fraction(1, 200)


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    ops = table(spark, d, "kv_ops").select("user_key")
    shards = seen_keys.shards_for(ops.count())
    hashes = ops.where("user_key IS NOT NULL").select(seen_keys.key_hash(F.col("user_key")).alias("h"))
    return seen_keys.remember(hashes, shards, BOUND), shards


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    layers, shards = _history(spark, d)
    incoming = table(spark, d, "incoming_ops").select("op_id", "user_key")
    return seen_keys.seen_before(incoming, "user_key", "op_id", layers, shards, BOUND).where("maybe_seen").select("op_id")


P3_FOUND = """
SELECT op_id FROM incoming_ops i WHERE user_key IS NOT NULL AND (user_key IN (SELECT user_key FROM kv_ops WHERE user_key IS NOT NULL)
  OR op_id > (SELECT min(op_id) FROM incoming_ops j WHERE j.user_key = i.user_key))
"""


def p3_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the chain held against an exact join: rows asked, told seen, told wrongly, and the promised bound."""
    layers, shards = _history(spark, d)
    layers = cut_lineage(layers)
    incoming = table(spark, d, "incoming_ops").select("op_id", "user_key")
    told = seen_keys.seen_before(incoming, "user_key", "op_id", layers, shards, BOUND)
    first = incoming.where("user_key IS NOT NULL").groupBy("user_key").agg(F.min("op_id").alias("first"))
    new = first.join(table(spark, d, "kv_ops").select("user_key").where("user_key IS NOT NULL"), "user_key", "left_anti")
    wrong = told.where("maybe_seen").join(new, (told["user_key"] == new["user_key"]) & (F.col("op_id") == F.col("first")), "left_semi")
    asked, seen, bad = F.count(F.lit(1)).alias("asked"), F.count_if("maybe_seen").alias("told_seen"), F.count(F.lit(1)).alias("told_wrongly")
    held = seen_keys.error_bounds(layers).agg(F.sum("keys").alias("keys_held"), F.max("layers").alias("layers"), F.max("bound").alias("promised_rate"))

    def long(one: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in one.columns])
        return one.select(F.inline(pairs))

    return long(told.agg(asked, seen)).unionByName(long(wrong.agg(bad))).unionByName(long(held))


def p3_answers(spark: SparkSession, d: str) -> DataFrame:
    """Rows asked, told seen, and told seen though new: by the exact answers none is wrong but at the promised rate."""
    return p3_error_rate(spark, d).where(F.col("figure").isin("asked", "told_seen", "told_wrongly")).select("figure", F.col("value").cast("bigint").alias("n"))


P3_ANSWERS = f"SELECT 'asked' AS figure, count(*) AS n FROM incoming_ops UNION ALL SELECT 'told_seen', count(*) FROM ({P3_FOUND}) s UNION ALL SELECT 'told_wrongly', 0"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters.frequent(table(spark, d, "kv_ops"), "user_key", SHARE).select("user_key")


P4_FOUND = "SELECT user_key FROM kv_ops WHERE user_key IS NOT NULL GROUP BY user_key HAVING count(*) * 200 >= (SELECT count(*) FROM kv_ops)"


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """The keys in at least a thousandth of all rows with their counts."""
    return heavy_hitters.frequent(table(spark, d, "kv_ops"), "user_key", Fraction(1, 1000))


P4_COUNTS = "SELECT user_key, count(*) AS n FROM kv_ops WHERE user_key IS NOT NULL GROUP BY user_key HAVING count(*) * 1000 >= (SELECT count(*) FROM kv_ops)"

def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its container for every target size."""
    counts = cut_lineage(packing.token_counts(table(spark, d, "documents")))
    return packing.containers(counts, table(spark, d, "pack_targets"))


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    """Per target what must not be: containers above capacity, documents split though they fit, tokens lost or added."""
    counts = cut_lineage(packing.token_counts(table(spark, d, "documents")))
    targets = table(spark, d, "pack_targets")
    return packing.faults(packing.containers(counts, targets), counts, targets)


P7_FAULTS = "SELECT target_id, 0 AS overfull, 0 AS split, 0 AS tokens_off, (SELECT count(*) FROM documents) AS documents FROM pack_targets WHERE target_id IS NOT NULL AND capacity_tokens > 0"


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each target are, with gaps counted in classes and token by token."""
    counts = cut_lineage(packing.token_counts(table(spark, d, "documents")))
    targets = table(spark, d, "pack_targets")
    each = [packing.fill(packing.containers(counts, targets, width=w), targets).withColumn("gap_width", F.lit(w)) for w in (packing.GAP_WIDTH, 1)]
    return each[0].unionByName(each[1])


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return fmindex.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return fmindex.leaks(_spans(spark, d))


def p8_removals(spark: SparkSession, d: str) -> DataFrame:
    """The word spans to cut from each mail part."""
    return fmindex.merged_removals(_spans(spark, d))


def _line_shares(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    lines = cut_lineage(stuffing.lines_of(documents, common=stuffing.function_words(documents, lang="lang")))
    return stuffing.shares_of(lines, stuffing.fit_lines(lines))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.flagged(_line_shares(spark, d)).select("doc_id")


def p9_line_shares(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document by the label of their line."""
    return _line_shares(spark, d)


#: name -> (query, oracle or None)
CATALOGUE = {
    "p3_found": (p3_found, P3_FOUND),
    "p3_error_rate": (p3_error_rate, None),
    "p3_answers": (p3_answers, P3_ANSWERS),
    "p4_found": (p4_found, P4_FOUND),
    "p4_counts": (p4_counts, P4_COUNTS),
    "p7_containers": (p7_containers, None),
    "p7_faults": (p7_faults, P7_FAULTS),
    "p7_fill": (p7_fill, None),
    "p8_found": (p8_found, None),
    "p8_removals": (p8_removals, None),
    "p9_found": (p9_found, None),
    "p9_line_shares": (p9_line_shares, None),
}
