"""The index on disk: parquet tables, and a manifest written last as the mark that the build ended."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import integrity
from ..operators.graph import Graph
from . import schemas
from .corpus import Incompatible, Invalid, NotFound, Unreadable, read_text, write_text

TABLES = {"chunks": schemas.CHUNK, "items": schemas.ITEM, "papers": schemas.LEDGER_ROWS, "concepts": schemas.NODE, "paper_concepts": schemas.PAPER_EDGE, "concept_relations": schemas.CONCEPT_EDGE}


@dataclass(frozen=True)
class Manifest:
    embedding_model: str
    embedding_dimension: int
    chunk_max_tokens: int
    paper_ids: list[int]
    schema_version: int = schemas.INDEX_VERSION
    domain_model_version: int = schemas.DOMAIN_VERSION


@dataclass(frozen=True)
class Index:
    """Everything a search reads. Tables are lazy."""

    manifest: Manifest
    chunks: DataFrame
    items: DataFrame
    graph: Graph


def folder(data_dir: str) -> str:
    return f"{data_dir}/index"


def artifact_paths(data_dir: str) -> list[str]:
    return [f"{folder(data_dir)}/manifest.json", *(f"{folder(data_dir)}/{t}" for t in TABLES)]


def write_index(spark: SparkSession, data_dir: str, tables: dict[str, DataFrame], manifest: Manifest) -> None:
    """All tables, their rules, then the manifest; the former manifest goes first, so that a broken build has none.

    Rules are checked on what was written, once, so that a search need not check them again.
    """
    base = folder(data_dir)
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(f"{base}/manifest.json")
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, False)
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{base}/{name}")
    check_index(_read_tables(spark, data_dir, manifest))
    write_text(spark, f"{base}/manifest.json", json.dumps(manifest.__dict__, indent=2) + "\n")


def read_manifest(spark: SparkSession, data_dir: str) -> Manifest:
    """The version is compared before anything else, so that another version is Incompatible and not Invalid."""
    path = f"{folder(data_dir)}/manifest.json"
    try:
        value = json.loads(read_text(spark, path))
    except ValueError as e:
        raise Unreadable(path, f"is not JSON: {e}") from e
    if not isinstance(value, dict):
        raise Invalid(path, "an object is expected")
    for name, ours in (("schema_version", schemas.INDEX_VERSION), ("domain_model_version", schemas.DOMAIN_VERSION)):
        if value.get(name) != ours:
            raise Incompatible(path, f"{name} is {value.get(name)!r}, expected {ours}")
    if set(value) != set(Manifest.__dataclass_fields__):
        raise Invalid(path, f"fields are {sorted(value)}")
    return Manifest(**value)


def read_index(spark: SparkSession, data_dir: str, check: bool = False) -> Index:
    """The index, lazily; with check, its rules are checked again, for files that others may have edited."""
    index = _read_tables(spark, data_dir, read_manifest(spark, data_dir))
    if check:
        check_index(index)
    return index


def check_index(index: Index) -> None:
    """Raises Invalid with a summary of all violations of the rules in and between the tables."""
    found = integrity.check_index(index.graph, index.chunks, index.items, index.manifest.embedding_dimension, len(index.manifest.paper_ids))
    listed = index.graph.papers.sparkSession.createDataFrame([(i,) for i in index.manifest.paper_ids], "paper_id bigint")
    found = integrity.all_of(found, integrity.dangling(listed, "manifest_paper", "paper_id", index.graph.papers, "paper_id", "the manifest's paper isn't declared"), integrity.dangling(index.graph.papers, "paper_listed", "paper_id", listed, "paper_id", "the manifest doesn't list the paper"))
    if rows := integrity.summary(found).orderBy("rule").collect():  # one row per broken rule
        raise Invalid("index", "; ".join(f"{r['rule']} ({r['message']}): {r['named']}" + (f" and {r['n'] - integrity.NAMED} more" if r["n"] > integrity.NAMED else "") for r in rows))


def _read_tables(spark: SparkSession, data_dir: str, manifest: Manifest) -> Index:
    t = {}
    for name, schema in TABLES.items():
        path = f"{folder(data_dir)}/{name}"
        try:
            t[name] = spark.read.schema(schema).parquet(path)
        except PySparkException as e:
            raise NotFound(path, "does not exist") from e
    return Index(manifest, t["chunks"], t["items"], Graph(t["papers"], t["concepts"], t["paper_concepts"], t["concept_relations"]))


def import_json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """(row_idx, line, fields) of a JSONL artifact: blank lines are skipped; row_idx counts the others from 0, line
    all from 1. A malformed line and a repeated key are errors that name their line. One file is one artifact: it
    is read whole, as only its order numbers the rows."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line", "value")).where(F.trim("value") != "")
    lines = whole.select((F.col("line") + 1).alias("line"), "value")
    parsed = lines.select("line", "value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    if bad := parsed.where("x._bad is not null or x is null").orderBy("line").select("line", "value").limit(1).collect():
        raise Invalid(path, f"has a malformed line {bad[0][0]}: {bad[0][1][:80]}")
    rows = parsed.select("line", "x.*").drop("_bad")
    if key and (twice := rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("line")).where("n > 1").orderBy("line").limit(1).collect()):
        raise Invalid(path, f"repeats {key} {twice[0][0]!r} in line {twice[0]['line']}")
    order = Window.orderBy("line")  # one file
    return rows.withColumn("row_idx", F.row_number().over(order) - 1).select("row_idx", "line", *[c for c in rows.columns if c != "line"])


def export_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def import_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, vector) of an .npy matrix, which is one file and goes through the driver, in slices; no pickles."""
    try:
        x = np.load(path, allow_pickle=False, mmap_mode="r")
    except FileNotFoundError as e:
        raise NotFound(path, "does not exist") from e
    except (ValueError, OSError) as e:
        raise Unreadable(path, str(e)) from e
    if x.ndim != 2:
        raise Invalid(path, f"has {x.ndim} dimensions")
    out = spark.createDataFrame([], "row_idx bigint, vector array<float>")
    for lo in range(0, len(x), 50_000):
        out = out.unionByName(spark.createDataFrame([(lo + n, v.tolist()) for n, v in enumerate(np.asarray(x[lo : lo + 50_000], dtype=np.float32))], out.schema))
    return out
