import pytest
from oracle import agree, connect
from pyspark.sql import functions as F

from keystrata.plans import storage
from keystrata.sources import runs
from keystrata.sources.tables import kv_versions, register_views, table
from keystrata.streaming import apply

BASE = "/root/testdata/sf0.001"


def test_runs(spark, tmp_path, rows):
    kv = kv_versions(table(spark, BASE, "kv_ops"))
    path = str(tmp_path / "run")
    runs.write_run(kv, path, level=2, partitions=4)
    back = runs.read_runs(spark, path)
    assert rows(back.select("user_key", "sequence")) == rows(kv.select("user_key", "sequence"))
    meta = runs.run_metadata(spark, path).orderBy("first_key").collect()
    assert len(meta) > 1 and all(a["last_key"] < b["first_key"] for a, b in zip(meta, meta[1:], strict=False))
    with pytest.raises(Exception, match="exist"):
        runs.write_run(kv, path)
    plan = back.where(F.col("user_key") == "k").select("sequence")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_key,k)" in plan and "op:" not in plan


def test_bloom_filters_are_written(spark, tmp_path):
    # a column whose dictionary stays small is looked up there; only beyond that a filter is written
    kv = spark.range(200_000).select(F.sha1(F.col("id").cast("string")).alias("user_key"), F.col("id").alias("sequence"), F.lit("PUT").alias("op"), F.lit("v").alias("value"))
    sizes = []
    for bloom in (False, True):
        path = tmp_path / str(bloom)
        runs.write_run(kv, str(path), level=2, partitions=1, bloom=bloom)
        sizes.append(sum(p.stat().st_size for p in path.glob("*.parquet")))
    assert sizes[1] > sizes[0]


@pytest.mark.parametrize("column", ["user_key", "value"])
def test_filters_pass_large_dictionaries(spark, tmp_path, rows, column):
    ids = spark.range(40_000)
    kv = ids.select(F.sha1((F.col("id") % 10_000).cast("string")).alias("user_key"), F.col("id").alias("sequence"), F.lit("PUT").alias("op"), F.sha1((F.col("id") % 8_000).cast("string")).alias("value"))
    wanted = kv.where(F.col(column).between("40", "41"))
    kv.coalesce(1).write.option("compression", "lz4_raw").parquet(str(tmp_path / "plain"))
    runs.write_run(kv, str(tmp_path / "run"), level=2, partitions=1)
    for name in ("plain", "run"):  # no other read of these files before: it would leave a decompressor that is large enough
        back = runs.read_runs(spark, str(tmp_path / name)).where(F.col(column).between("40", "41"))
        assert rows(back) == rows(wanted) and back.count() > 0


def test_run_range_read_of_one_file(spark):
    base, before = "/root/testdata/sf0.01", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        agree(spark, connect(base), *storage.CATALOGUE["run_range_read"], base)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_few_keys_get_a_bloom_filter(spark, tmp_path):
    path = tmp_path / "run"
    runs.write_run(kv_versions(table(spark, BASE, "kv_ops")), str(path), level=2, partitions=2)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in path.glob("*.parquet"):
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(f)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        try:
            assert all(b.getColumns().get(0).getBloomFilterOffset() > 0 for b in reader.getFooter().getBlocks())
        finally:
            reader.close()


def test_bucketed_reads_need_no_exchange(spark, rows):
    from keystrata.operators.reads import live

    kv = kv_versions(table(spark, BASE, "kv_ops"))
    spark.sql("DROP TABLE IF EXISTS ks_versions")
    try:
        runs.write_bucketed(kv, "ks_versions", 4)
        got = live(spark.table("ks_versions"))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got.select("user_key", "sequence")) == rows(live(kv).select("user_key", "sequence"))
    finally:
        spark.sql("DROP TABLE IF EXISTS ks_versions")


def test_objects(spark, tmp_path):
    store = runs.ObjectStore(spark, str(tmp_path))
    assert store.get("a/b") is None
    store.put("a/b", b"\x00hello\xff")
    assert store.get("a/b") == b"\x00hello\xff" and store.get_range("a/b", 1, 6) == b"hello" and store.get_range("a/b", 3, 3) == b""
    with pytest.raises(ValueError, match="range"):
        store.get_range("a/b", 5, 99)
    store.remove("a/b")
    assert store.get("a/b") is None


def test_views(spark):
    register_views(spark, BASE)
    got = spark.sql("SELECT op, count(*) AS n FROM kv_versions GROUP BY op").collect()
    assert {r["op"] for r in got} == {"PUT", "DELETE"}


def test_store_choice():
    assert runs.store_options() == {}
    assert runs.store_options("s3://x/y", "minio://k:s@h:1/b") == {"root": "s3a://x/y"}
    got = runs.store_options(minio="minio://key:secret@host:9000/bucket")
    assert got["root"] == "s3a://bucket" and got["fs.s3a.endpoint"] == "http://host:9000" and got["fs.s3a.secret.key"] == "secret"
    with pytest.raises(ValueError):
        runs.store_options(minio="http://x")


@pytest.mark.parametrize("every", [2, 16])
def test_stream_in_batches(spark, tmp_path, rows, monkeypatch, every):
    from keystrata.operators.changefeed import fold_changes, live

    monkeypatch.setattr(apply, "COMPACT_EVERY", every)
    schema = "op_type string, user_key string, op_value string, sequence bigint, op_idx int"
    batches = [
        [("PUT", "a", "1", 1, 0), ("delete", "b", None, 9, 0), ("GET", "a", None, 0, 0)],
        [("t_put", "b", "late", 5, 0), ("PUT", "a", "1", 1, 0), ("PUT", "c", "3", 3, 1), ("PUT", "c", "2", 3, 0)],
        [("DELETE", "c", None, 4, 0), ("PUT", "d", None, 2, 0), ("PUT", None, "x", 8, 0)],
    ]
    src = tmp_path / "in"
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
        apply.apply_changes(stream(), str(tmp_path / "state"), str(tmp_path / "c1"), ["user_key"], ["op_value"]).awaitTermination()
        apply.append_versions(stream(), str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    table = apply.StateTable(spark, str(tmp_path / "state"), ["user_key"], ["op_value"])
    state = table.read()
    before = rows(state)
    assert rows(live(state).select("user_key", "op_value")) == [("a", "1"), ("d", None)]
    assert rows(state.where("op = 'DELETE'").select("user_key", "sequence")) == [("b", 9), ("c", 4)]
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 8
    again = fold_changes(log, ["user_key"], ["sequence", "op_idx"], F.col("op"), ["value"])
    assert rows(live(again).select("user_key", "value")) == [("a", "1"), ("d", None)]
    table.apply(spark.createDataFrame(batches[2], schema), 2)  # a batch that runs again
    assert rows(table.read()) == before
    assert apply.StateTable(spark, str(tmp_path / "none"), ["user_key"], []).read() is None


def test_keyed_state(spark, tmp_path):
    from keystrata.streaming.stateful import newest_changes

    schema = "op_type string, user_key string, op_value string, sequence bigint, op_idx int"
    src, seen = tmp_path / "in", []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for b in (
            [("PUT", "a", "1", 1, 0), ("delete", "b", None, 9, 0), ("PUT", "a", "0", 0, 0)],
            [("t_put", "b", "late", 5, 0), ("PUT", "a", "1", 1, 0), ("PUT", "c", "3", 3, 1), (None, "c", "2", 3, 0)],
            [("DELETE", "c", None, 4, 0), ("PUT", None, "x", 8, 0), ("PUT", "a", None, 7, None)],
        ):
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
            stream = newest_changes(spark.readStream.schema(schema).parquet(str(src)))
            q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append(sorted(map(tuple, df.collect())))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    seen = [s for s in seen if s]
    assert seen == [[("a", 1, 0, "PUT", "1"), ("b", 9, 0, "DELETE", None)], [("c", 3, 1, "PUT", "3")], [("a", 7, 0, "PUT", None), ("c", 4, 0, "DELETE", None)]]
