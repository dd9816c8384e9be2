from datetime import datetime, timedelta

from verbascope.streaming.windows import follow, windowed_counts, write_once

START = datetime(2025, 1, 1)


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, START + timedelta(minutes=7 * i), "ab"[i % 2]) for i in range(100)] + [(100, START + timedelta(days=3), "a"), (101, None, "a")]
    df = spark.createDataFrame(rows, "id int, ts timestamp, kind string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    write_once(windowed_counts(follow(spark, f"{tmp_path}/in", df), "ts", ["kind"]), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = {tuple(r) for r in windowed_counts(df, "ts", ["kind"]).collect()}
    assert got == {r for r in whole if r[0] < START + timedelta(days=2)}
    write_once(windowed_counts(follow(spark, f"{tmp_path}/in", df), "ts", ["kind"]), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == got
