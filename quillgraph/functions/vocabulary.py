"""The fixed vocabulary of the graph, its dimension tables, and the Markdown that describes it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Term:
    value: str
    meaning: str
    traversable: bool = True


#: Members in the order that defaults and descriptions follow.
CONCEPT_TYPES = (
    Term("problem", "what a paper wants to solve"),
    Term("method", "how a paper solves it"),
    Term("keyword", "a topic or term, too broad to walk through", traversable=False),
)
PAPER_RELATIONS = (
    Term("proposes", "the paper introduces the concept"),
    Term("uses", "the paper builds on the concept"),
    Term("addresses", "the paper works on the problem"),
    Term("mentions", "the paper names the concept in passing", traversable=False),
)
CONCEPT_RELATIONS = (
    Term("is_a", "the source is a kind of the target"),
    Term("part_of", "the source is a part of the target"),
    Term("used_for", "the source serves the target"),
    Term("related_to", "the source has to do with the target"),
)
ORIGINS = (Term("paper", "stated by a paper, with quotes"), Term("general_knowledge", "added with a rationale, without quotes"))
ITEM_KINDS = (Term("chunk", "a piece of a page"), Term("summary", "a paper's summary"), Term("concept", "a normalized concept"))

FAMILIES = {"concept_type": CONCEPT_TYPES, "paper_relation": PAPER_RELATIONS, "concept_relation": CONCEPT_RELATIONS, "origin": ORIGINS, "item_kind": ITEM_KINDS}


def traversable(terms: tuple[Term, ...]) -> tuple[str, ...]:
    return tuple(t.value for t in terms if t.traversable)


def vocabulary_table(spark: SparkSession) -> DataFrame:
    """(family, position, value, traversable), a dimension of a few rows."""
    rows = [(family, n, t.value, t.traversable) for family, terms in FAMILIES.items() for n, t in enumerate(terms)]
    return spark.createDataFrame(rows, "family string, position int, value string, traversable boolean")


def describe_term(term: Term) -> str:
    return f"- `{term.value}`: {term.meaning}" + ("" if term.traversable else " (not walked through)")


def describe_vocabulary() -> str:
    """The vocabulary as Markdown, for prompts and readers."""
    titles = {"concept_type": "Concept types", "paper_relation": "Paper to concept", "concept_relation": "Concept to concept", "origin": "Origins"}
    return "\n\n".join(f"## {title}\n\n" + "\n".join(describe_term(t) for t in FAMILIES[family]) for family, title in titles.items()) + "\n"
