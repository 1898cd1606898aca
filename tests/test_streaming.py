from veinwork.streaming import live


def test_transitions_and_windows(spark, tmp_path):
    rows = spark.sql(
        "SELECT * FROM VALUES ('r', 0L, 'a', timestamp'2024-01-01 00:00:00'), ('r', 1L, 'b', timestamp'2024-01-01 00:01:00'), ('r', 2L, 'a', timestamp'2024-01-01 00:06:00') AS t(e, s, st, at)"
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.event_stream(spark, str(tmp_path / "in"), rows.schema, "parquet")
    q = live.transition_violations(stream, "e", "s", "st", {"a": ("b",)}).writeStream.format("memory").queryName("bad").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM bad").collect()] == [("r", 2, "b", "a")]
    q = live.windowed_counts(stream, "at", "st").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 3


def test_sink_sees_each_batch_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = live.event_stream(spark, str(tmp_path / "in"), spark.range(1).schema, "parquet")
    for _ in range(2):
        live.exactly_once_sink(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck")).awaitTermination()
    assert seen == [(0, 5)]
