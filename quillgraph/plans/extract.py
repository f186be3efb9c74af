"""One paper's extraction by an agent: ask, validate, ask again with what was wrong."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import check_extractions
from ..operators.integrity import check_extraction_tables
from ..sources import corpus, schemas
from . import prompts
from .agents import StructuredAgent, json_schema
from .build_index import Rejected, findings


def validate_extraction(spark: SparkSession, data_dir: str, paper_id: int, payload: object) -> list[dict]:
    """All issues (path, message) of an answer: its form first; then its own rules and its agreement with the pages."""
    kind = schemas._schema(schemas.EXTRACTION)
    if found := schemas.problems(payload, kind):
        return [{"path": p.split(": ", 1)[0], "message": p.split(": ", 1)[1]} for p in found]
    if payload["schema_version"] != schemas.EXTRACTION_VERSION:
        return [{"path": "schema_version", "message": f"is {payload['schema_version']}, expected {schemas.EXTRACTION_VERSION}"}]
    rows = spark.createDataFrame([payload], kind)
    tables = corpus.flatten_extractions(rows)
    tables["papers"] = tables["papers"].withColumn("asked_id", F.lit(paper_id).cast("bigint"))
    if found := findings(check_extraction_tables(tables)):
        return found.each(lambda f: {"path": f["key"], "message": f["message"]})
    meta, pages = corpus.papers(spark, data_dir)
    own = F.lit(payload["paper_id"]).cast("bigint")  # quotes are held against the asked paper
    pages = pages.where(F.col("paper_id") == paper_id).withColumn("paper_id", own)
    counts = meta.where(F.col("id") == paper_id).select(own.alias("paper_id"), "page_count")
    return findings(check_extractions(tables, pages, counts)).each(lambda f: {"path": f["path"], "message": f["message"]})


def extract(spark: SparkSession, data_dir: str, paper_id: int, agent: StructuredAgent, max_attempts: int = 3) -> dict:
    """The saved extraction and the attempts it took; Rejected if the last attempt has issues too."""
    if max_attempts < 1:
        raise ValueError(f"max_attempts must be at least 1, got {max_attempts}")
    meta, pages = corpus.papers(spark, data_dir)
    own = meta.where(F.col("id") == paper_id).select("id", "title").first()
    if own is None:
        raise corpus.NotFound(f"{data_dir}/papers/{paper_id:04d}", "does not exist")
    texts = [(r["page"], r["text"]) for r in pages.where(F.col("paper_id") == paper_id).orderBy("page").collect()]  # one paper
    schema = json_schema(schemas._schema(schemas.EXTRACTION), schemas.OPTIONAL)
    previous, issues = None, []
    for attempt in range(1, max_attempts + 1):
        payload = agent.answer(prompts.extraction_prompt(own.asDict(), texts, previous, issues), schema)
        issues = validate_extraction(spark, data_dir, paper_id, payload)
        if not issues:
            return {"extraction": payload, "attempts": attempt, "path": corpus.save_extraction(spark, data_dir, payload)}
        previous = payload
    raise Rejected("extraction", issues)
