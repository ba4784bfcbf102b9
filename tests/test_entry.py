import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["q_id", "model", "cavity_group", "confidence", "top1_sim"] and df.count() == 500


def test_every_oracle_has_a_query_and_parses():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    for text in sql.values():
        con.execute(f"EXPLAIN {text}")


def test_stream_scoring(spark, tmp_path):
    from tarnwork.streaming.scoring import score_stream

    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    score_stream(source, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg({"count": "sum"}).first()[0] == rows.count()
