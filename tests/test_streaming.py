from quillgraph.streaming import pages as P


def test_pages_arrive_in_files(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = "select 1L paper_id, 1 page, '{}' text, timestamp'{}' loaded_at"
    spark.sql(rows.format("a b c", "2024-01-01")).write.mode("append").parquet(src)
    P.write_chunks(P.chunk_stream(P.page_stream(spark, src), 2), out, ck).awaitTermination(120)
    spark.sql(rows.format("a b c", "2024-01-02") + " union all select 2L, 1, null, timestamp'2024-01-03' union all select 3L, 1, '# H', timestamp'2024-01-03'").write.mode("append").parquet(src)
    P.write_chunks(P.chunk_stream(P.page_stream(spark, src), 2), out, ck).awaitTermination(120)
    got = {(r["id"], r["text"]) for r in spark.read.parquet(out).collect()}
    assert got == {("1:1.0", "a b"), ("1:1.1", "c"), ("3:1.0", "# H")}
    assert spark.read.parquet(out).count() == 3
