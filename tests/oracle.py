"""A query's rows held against its SQL in DuckDB."""

import duckdb

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings kv_ops incoming_ops key_range raft_log log_runs manifest heartbeat eval_items pack_targets"


def connect(base=BASE):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return con


def normal(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(bytes(r[i]) if isinstance(r[i], bytearray) else r[i] for i in order)) for r in got)


def agree(spark, con, query, sql, base=BASE):
    df = query(spark, base)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert normal(df.columns, df.collect()) == normal(rel.columns, rel.fetchall())
