from revlens.streaming import spans as S


def test_stream_equals_batch(spark, tmp_path):
    frame = spark.createDataFrame([(1, "2X Ø8 mm"), (2, "R.5"), (3, "")], "k int, text string")
    frame.where("k < 3").write.parquet(f"{tmp_path}/in/a")
    stream = S.read_spans(spark, f"{tmp_path}/in/*", frame.schema)
    S.write_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    frame.where("k = 3").write.parquet(f"{tmp_path}/in/b")
    S.write_available(S.read_spans(spark, f"{tmp_path}/in/*", frame.schema), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, S.fingerprints(frame).collect()))
