"""Declared schemas of everything on disk; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: The versions that files carry; others are refused, not migrated.
EXTRACTION_VERSION = NORMALIZATION_VERSION = INDEX_VERSION = DOMAIN_VERSION = 1


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # needs a running session


LEDGER = "papers array<struct<id:bigint,title:string>>"
PAPER = (
    "id bigint, title string, authors array<string>, year int, venue string, page_count int, doi string, arxiv_id string, s3_uri string, "
    "preprocess struct<tool:string,version:string,processed_at:string>"
)
_EVIDENCE = "array<struct<page:int,quote:string>>"
EXTRACTION = (
    "schema_version int, paper_id bigint, summary_ja string, concepts array<struct<local_id:string,name:string,type:string,aliases:array<string>,description:string>>, "
    f"paper_concepts array<struct<concept_id:string,relation:string,evidence:{_EVIDENCE}>>, "
    f"concept_relations array<struct<source_id:string,target_id:string,relation:string,evidence:{_EVIDENCE}>>"
)
CONCEPTS = (
    "schema_version int, concepts array<struct<id:string,canonical_name:string,type:string,aliases:array<string>,description:string,"
    "merged_from:array<struct<paper_id:bigint,local_id:string>>>>"
)
GENERAL_RELATIONS = "schema_version int, concept_relations array<struct<source_id:string,target_id:string,relation:string,rationale:string>>"
_CHUNK_EVIDENCE = "array<struct<page:int,quote:string,chunk_id:string>>"
CHUNK = "id string, paper_id bigint, idx int, page_start int, page_end int, text string"
ITEM = "row_idx bigint, kind string, ref string, paper_id bigint, text string, vector array<float>"
NODE = "id string, canonical_name string, type string, aliases array<string>, description string, paper_count int"
PAPER_EDGE = f"paper_id bigint, concept_id string, relation string, evidence {_CHUNK_EVIDENCE}"
CONCEPT_EDGE = f"source_id string, target_id string, relation string, origin string, paper_id bigint, evidence {_CHUNK_EVIDENCE}, rationale string"
LEDGER_ROWS = "paper_id bigint, corpus_pos int"

#: Fields that may be absent; all others of a document must be there.
OPTIONAL = frozenset({"doi", "arxiv_id", "s3_uri", "aliases", "description", "concept_relations", "evidence", "rationale", "paper_id?", "preprocess"})


def problems(value: object, kind: T.DataType, path: str = "") -> list[str]:
    """Everything that keeps a parsed JSON value from having the declared type, unknown and missing fields included."""
    at = path or "<root>"
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return [f"{at}: an object is expected"]
        out = [f"{(path + '.' if path else '') + k}: unknown field" for k in value if k not in kind.names]
        for f in kind.fields:
            where = f"{path}.{f.name}" if path else f.name
            if f.name in value and value[f.name] is not None:
                out += problems(value[f.name], f.dataType, where)
            elif f.name not in OPTIONAL:
                out.append(f"{where}: is required")
        return out
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            return [f"{at}: a list is expected"]
        return [p for n, v in enumerate(value) for p in problems(v, kind.elementType, f"{path}[{n}]")]
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return [] if isinstance(value, int) and not isinstance(value, bool) else [f"{at}: a whole number is expected"]
    if isinstance(kind, T.StringType):
        return [] if isinstance(value, str) else [f"{at}: text is expected"]
    return []
