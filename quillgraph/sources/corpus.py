"""Readers and writers of the corpus layout on disk: ledger, papers, pages, extractions, normalization.

    papers/index.json                  papers/NNNN/paper.json        papers/NNNN/pages/NNN.md
    papers/NNNN/extraction.json        normalization/concepts.json   normalization/concept_relations.json

Pages and extractions are read by the executors, so a corpus of any size is; only single files and the names of
the papers' folders go through the driver. Paths may be of any file system that Spark knows (s3a:// with its jars on
the class path); folders of a file system that is mounted (file:) are listed and read by the executors, many in a task.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import page_file, paper_directory
from . import schemas
from .folders import written


#: Papers whose files a task reads, and bytes of files that it hands on at once.
PAPERS_A_TASK, BYTES_AT_ONCE = 2_000, 4_000_000


class SourceError(RuntimeError):
    """A stored artifact can't be used; location names it."""

    def __init__(self, location: str, problem: str):
        super().__init__(f"{location}: {problem}")
        self.location, self.problem = location, problem


class NotFound(SourceError):
    pass


class Unreadable(SourceError):
    pass


class Invalid(SourceError):
    pass


class Incompatible(SourceError):
    pass


def read_text(spark: SparkSession, path: str) -> str:
    """One whole file."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except PySparkException as e:
        raise (NotFound(path, "does not exist") if "PATH_NOT_FOUND" in str(e) else Unreadable(path, str(e).split("\n")[0])) from e
    return rows[0][0] if rows else ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one file through Hadoop's file system, so that any of its schemes works; it appears whole or not at all."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(part, True)
    try:
        data = text.encode()
        for lo in range(0, len(data), BYTES_AT_ONCE):  # py4j holds what passes it several times
            stream.write(data[lo : lo + BYTES_AT_ONCE])
    finally:
        stream.close()
    fs.delete(target, False)
    fs.rename(part, target)


def write_files(files: DataFrame) -> int:
    """Writes each row (path, text) as a file, on the executors and through Arrow's file systems; how many. A task that
    runs again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            made = set()
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
                if (folder := name.rsplit("/", 1)[0]) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(name) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "text").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_json(spark: SparkSession, path: str, schema: str) -> dict:
    """One JSON document, checked against its schema, unknown fields refused."""
    raw = read_text(spark, path)
    try:
        value = json.loads(raw)
    except ValueError as e:
        raise Unreadable(path, f"is not JSON: {e}") from e
    if found := schemas.problems(value, _type(schema)):
        raise Invalid(path, "; ".join(found))
    return value


def _type(schema: str) -> T.DataType:
    return schemas._schema(schema)


def paper_ledger(spark: SparkSession, data_dir: str) -> DataFrame:
    """(paper_id, title, corpus_pos) in the order of papers/index.json; repeated ids are refused."""
    path = f"{data_dir}/papers/index.json"
    papers = read_json(spark, path, schemas.LEDGER)["papers"]
    ids = [p["id"] for p in papers]
    if repeated := sorted(i for i, n in Counter(ids).items() if n > 1):
        raise Invalid(path, f"repeats paper ids {repeated}")
    if bad := [p["id"] for p in papers if p["id"] < 1 or not p["title"]]:
        raise Invalid(path, f"papers {bad} need an id from 1 and a title")
    return spark.createDataFrame([(p["id"], p["title"], n) for n, p in enumerate(papers)], "paper_id bigint, title string, corpus_pos int")


def _mounted(spark: SparkSession, data_dir: str) -> str | None:
    """The folder's name on this machine, if it is on a file system that is mounted."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(data_dir)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() != "file":
        return None
    return path.toUri().getPath()


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _below(folder: str) -> Iterator[str]:
    """All files in a folder and in those below it."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except (FileNotFoundError, NotADirectoryError):
        return
    for e in entries:
        if not _hidden(e.name):
            if e.is_dir():
                yield from _below(e.path)
            else:
                yield e.path


def _paper_files(spark: SparkSession, data_dir: str, inside: str, paper_ids: Sequence[int] | None = None) -> DataFrame:
    """(path, raw) of the file with this name in each paper's folder, or of the files below it (NAME/*); of all papers,
    or of the given ones, which must have it. NotFound if there is none.

    Spark would list the files one by one and, taking each for 4 MB, read a few in a task."""
    asked = None if paper_ids is None else [f"{i:04d}" for i in sorted(set(paper_ids))]
    patterns = [f"{data_dir}/papers/{x}/{inside}" for x in ("*",) * (asked is None) + tuple(asked or ())]
    if (base := _mounted(spark, f"{data_dir}/papers")) is None:
        try:
            return spark.read.text(patterns, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
        except PySparkException as e:
            raise NotFound(patterns[0], "does not exist") from e
    whole = inside.endswith("/*")
    at = inside.removesuffix("/*")
    there = lambda x: next(os.scandir(f"{base}/{x}/{at}"), None) if os.path.isdir(f"{base}/{x}/{at}") and whole else os.path.isfile(f"{base}/{x}/{at}")
    names = asked if asked is not None else sorted(e.name for e in os.scandir(base) if e.is_dir()) if os.path.isdir(base) else []
    if not names or not (any if asked is None else all)(map(there, names)):
        raise NotFound(patterns[0], "does not exist")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, raws, held = [], [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for path in _below(f"{base}/{name}/{at}") if whole else (f"{base}/{name}/{at}",):
                    try:
                        with open(path, "rb") as f:
                            raw = f.read()
                    except FileNotFoundError:
                        continue
                    if not raw:  # as Spark's readers do
                        continue
                    paths.append(f"file:{path}")
                    raws.append(raw)
                    held += len(raws[-1]) + 200
                    if held >= BYTES_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raws, pa.binary())], ["path", "raw"])
                        paths, raws, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raws, pa.binary())], ["path", "raw"])

    tasks = min(len(names), max(spark.sparkContext.defaultParallelism, -(-len(names) // PAPERS_A_TASK)))
    listed = spark.createDataFrame(pa.table({"name": pa.array(names, pa.string())})).repartition(tasks)
    return listed.mapInArrow(run, "path string, raw binary").select("path", F.col("raw").cast("string").alias("raw"))


def _documents(raw: DataFrame, schema: str) -> DataFrame:
    """(path, directory, value, problems) of many JSON documents (path, raw), checked on the executors."""
    kind = _type(schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column("raw").to_pylist():
                try:
                    found.append("; ".join(schemas.problems(json.loads(raw), kind)) or None)
                except ValueError as e:
                    found.append(f"is not JSON: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("raw"), pa.array(found, pa.string())], ["path", "raw", "problems"])

    checked = raw.mapInArrow(check, "path string, raw string, problems string")
    return checked.select("path", F.element_at(F.split("path", "/"), -2).alias("directory"), F.from_json("raw", schema).alias("value"), "problems")


def _sound(docs: DataFrame) -> DataFrame:
    """The documents, if all are sound; else an error that names some of those that aren't."""
    if bad := docs.where("problems is not null").select("path", "problems").limit(5).collect():
        raise Invalid(bad[0][0], "; ".join(f"{r[0]}: {r[1]}" for r in bad))
    return docs.select("path", "directory", "value.*")


def paper_meta(spark: SparkSession, data_dir: str, paper_ids: Sequence[int] | None = None) -> DataFrame:
    """The metadata of all papers, or of the given ones alone, without opening a page; an id must be that of its
    directory. Each document is read and checked once."""
    docs = _sound(written(_documents(_paper_files(spark, data_dir, "paper.json", paper_ids), schemas.PAPER), "paper-documents"))
    if bad := docs.where(paper_directory(F.col("id")) != F.col("directory")).select("path", "id").limit(5).collect():
        raise Invalid(bad[0][0], f"has the id {bad[0][1]}")
    return docs.withColumn("preprocess", F.struct("preprocess.tool", "preprocess.version", F.to_timestamp("preprocess.processed_at").alias("processed_at"))).drop("path", "directory")


def paper_pages(spark: SparkSession, data_dir: str) -> DataFrame:
    """(paper_id, page, text) of all page files with the name NNN.md."""
    parts = F.split(F.col("path"), "/")
    rows = _paper_files(spark, data_dir, "pages/*").select(F.element_at(parts, -3).alias("directory"), F.element_at(parts, -1).alias("name"), F.col("raw").alias("text"))
    return rows.select(F.expr("try_cast(directory as bigint)").alias("paper_id"), F.expr(r"try_cast(regexp_extract(name, '^([0-9]+)[.]md$', 1) as int)").alias("page"), "name", "text")


def page_gaps(meta: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, name, problem) of page files that are missing or unexpected; meta: id, page_count."""
    expected = meta.where("page_count >= 1").select(F.col("id").alias("paper_id"), F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page")).select("paper_id", page_file(F.col("page")).alias("name"))
    found = pages.select("paper_id", "name").distinct()
    keys = ["paper_id", "name"]
    return expected.join(found, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(found.join(expected, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def papers(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """(meta, pages), with every paper's page files complete."""
    meta, pages = paper_meta(spark, data_dir), paper_pages(spark, data_dir)
    if bad := page_gaps(meta, pages).limit(5).collect():
        raise Invalid(f"{data_dir}/papers", "; ".join(f"paper {r[0]} page file {r[1]} is {r[2]}" for r in bad))
    return meta, pages.drop("name")


def extraction_rows(spark: SparkSession, data_dir: str, paper_ids: DataFrame | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """One nested row per stored extraction; its paper_id must be that of its directory, its version ours. With only, no
    other files than these papers' are read."""
    docs = _sound(written(_documents(_paper_files(spark, data_dir, "extraction.json", only), schemas.EXTRACTION), "extraction-documents"))
    if bad := docs.where(f"schema_version <> {schemas.EXTRACTION_VERSION}").select("path", "schema_version").limit(1).collect():
        raise Incompatible(bad[0][0], f"has the version {bad[0][1]}")
    if bad := docs.where(paper_directory(F.col("paper_id")) != F.col("directory")).select("path", "paper_id").limit(1).collect():
        raise Invalid(bad[0][0], f"declares the paper {bad[0][1]}")
    return docs.join(paper_ids.select("paper_id"), "paper_id", "left_semi") if paper_ids is not None else docs


def flatten_extractions(rows: DataFrame) -> dict[str, DataFrame]:
    """papers, concepts, paper_concepts and concept_relations of nested extractions, with their positions."""
    concepts = rows.select("paper_id", F.posexplode("concepts").alias("pos", "c")).select("paper_id", "pos", "c.*")
    edges = rows.select("paper_id", F.posexplode("paper_concepts").alias("edge_pos", "e")).select("paper_id", "edge_pos", F.col("e.concept_id").alias("local_id"), "e.relation", "e.evidence")
    relations = rows.select("paper_id", F.posexplode("concept_relations").alias("edge_pos", "e")).select(
        "paper_id", "edge_pos", F.col("e.source_id").alias("source_local"), F.col("e.target_id").alias("target_local"), "e.relation", "e.evidence"
    )
    return {"papers": rows.select("paper_id", F.col("paper_id").alias("asked_id"), "summary_ja"), "concepts": concepts, "paper_concepts": edges, "concept_relations": relations}


def missing_extractions(ledger: DataFrame, rows: DataFrame) -> list[int]:
    """Every paper of the ledger without extraction, in ledger order."""
    return [r[0] for r in ledger.join(rows.select("paper_id"), "paper_id", "left_anti").orderBy("corpus_pos").select("paper_id").collect()]


def normalization(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """(concepts, general relations), both with their position; the versions of both files must be ours."""
    out = []
    for name, schema, field in (("concepts", schemas.CONCEPTS, "concepts"), ("concept_relations", schemas.GENERAL_RELATIONS, "concept_relations")):
        path = f"{data_dir}/normalization/{name}.json"
        try:
            raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
        except PySparkException as e:
            raise NotFound(path, "does not exist") from e
        docs = _sound(_documents(raw, schema))
        version = docs.select("schema_version").first()[0]
        if version != schemas.NORMALIZATION_VERSION:
            raise Incompatible(path, f"has the version {version}")
        out.append(docs.select(F.posexplode(field).alias("pos", "x")).select("pos", "x.*"))
    return out[0], out[1]


def save_extraction(spark: SparkSession, data_dir: str, extraction: dict) -> str:
    path = f"{data_dir}/papers/{extraction['paper_id']:04d}/extraction.json"
    write_text(spark, path, json.dumps(extraction, ensure_ascii=False, indent=2) + "\n")
    return path


def save_normalization(spark: SparkSession, data_dir: str, concepts: list[dict], relations: list[dict]) -> list[str]:
    """Both files; the vocabulary passed through the agent stages, so it is at hand as a whole."""
    paths = []
    for name, field, rows in (("concepts", "concepts", concepts), ("concept_relations", "concept_relations", relations)):
        paths.append(f"{data_dir}/normalization/{name}.json")
        write_text(spark, paths[-1], json.dumps({"schema_version": schemas.NORMALIZATION_VERSION, field: rows}, ensure_ascii=False, indent=2) + "\n")
    return paths
