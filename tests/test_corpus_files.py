"""Readers of many files."""

import pytest

from quillgraph.sources import corpus


def put(folder, name, data):
    path = folder / "papers" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_many_small_files_take_few_tasks(spark, tmp_path):
    for n in range(1, 61):
        put(tmp_path, f"{n:04d}/pages/001.md", f"page of {n}".encode())
    pages = corpus.paper_pages(spark, str(tmp_path))
    assert {(r["paper_id"], r["page"], r["text"]) for r in pages.collect()} == {(n, 1, f"page of {n}") for n in range(1, 61)}
    assert pages.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_files_are_those_that_spark_would_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "BYTES_AT_ONCE", 1)
    for name in ("0001/pages/001.md", "0001/pages/.002.md.crc", "0001/pages/_x.md", "0001/pages/notes.txt", "0001/pages/below/003.md", "x/pages/004.md", "0002/paper.json"):
        put(tmp_path, name, b"a\r\n" + "\u00e9\u3000".encode())
    put(tmp_path, "0003/pages/001.md", b"")
    put(tmp_path, "index.json", b"{}")
    got = corpus._paper_files(spark, f"file:{tmp_path}", "pages/*")
    monkeypatch.setattr(corpus, "_mounted", lambda *_: None)
    spark_s = corpus._paper_files(spark, str(tmp_path), "pages/*")
    rows = lambda df: {(r["path"].removeprefix("file:").replace("///", "/"), r["raw"]) for r in df.collect()}
    assert rows(got) == rows(spark_s) and len(rows(got)) == 4


@pytest.mark.parametrize("mounted", [True, False])
def test_missing_files(spark, tmp_path, monkeypatch, mounted):
    if not mounted:
        monkeypatch.setattr(corpus, "_mounted", lambda *_: None)
    put(tmp_path, "0001/paper.json", b"{}")
    for inside, ids in (("extraction.json", None), ("pages/*", None), ("paper.json", [1, 2])):
        with pytest.raises(corpus.NotFound):
            corpus._paper_files(spark, str(tmp_path), inside, ids)
    assert corpus._paper_files(spark, str(tmp_path), "paper.json", [1]).count() == 1
    with pytest.raises(corpus.NotFound):
        corpus._paper_files(spark, str(tmp_path / "none"), "paper.json")
