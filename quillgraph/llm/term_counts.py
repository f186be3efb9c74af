"""Problem 4: frequency of every distinct term, kept by incremental signed deltas.

The persistent state has two tables in partitions by a hash of the term: the occurrences of each (term, record),
and the counts of each term. A change set (added, removed, or both for a changed record) is aggregated alone
into signed deltas; only the partitions that it touches are read. Its per-term changes of occurrences and of
records are merged into the counts. Record counts are exact under deletion because a record leaves a term's
count only when its multiplicity falls to zero. A manifest on disk names the folder of every partition, so a
store can be opened again, and a broken change set leaves the former state whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import NotFound, read_text, write_text
from ..sources.folders import delete_folder
from .common import WHITE_SPACE, shared_folder

#: Rows of the state per partition; the number of partitions is doubled until they fit.
ROWS_PER_PART = 1_000_000


def fold_id(value: Column) -> Column:
    """Ids that differ only in case, surrounding white space or _ for - get the same key; null stays null."""
    return F.translate(F.lower(F.regexp_replace(value, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")), "_", "-")


def signed_deltas(added: DataFrame | None, removed: DataFrame | None, term: str, record: str) -> DataFrame:
    """(term, record, n): by how much the occurrences of each term in each record change.

    Null terms are ignored; a null record counts as one record of its own. Repeated rows count as
    occurrences. Pre-aggregated map-side, so a hot term is spread over its records.
    """
    sides = [df.select(F.col(term).alias("term"), F.col(record).alias("record"), F.lit(sign).cast("long").alias("n")) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return rows.where(F.col("term").isNotNull()).groupBy("term", "record").agg(F.sum("n").alias("n")).where("n <> 0")


def merge_deltas(state: DataFrame | None, delta: DataFrame) -> DataFrame:
    """(term, record, was, n): the multiplicity before and after the delta. A negative multiplicity is kept, so
    that a deletion delivered before its addition cancels out later."""
    new = delta.select("term", "record", F.lit(0).cast("long").alias("was"), "n")
    if state is not None:
        new = new.unionByName(state.select("term", "record", F.col("n").alias("was"), "n"))
    return new.groupBy("term", "record").agg(F.sum("was").alias("was"), F.sum("n").alias("n"))


def term_changes(merged: DataFrame) -> DataFrame:
    """(term, occurrences, records): by how much the counts of each term change; pairs that don't count change nothing."""
    held = lambda c: F.greatest(F.col(c), F.lit(0))
    return merged.groupBy("term").agg(F.sum(held("n") - held("was")).alias("occurrences"), F.sum((F.col("n") > 0).cast("long") - (F.col("was") > 0).cast("long")).alias("records"))


def mark(counted: DataFrame, n_records: int, threshold: float) -> DataFrame:
    """Adds mark: rare (exactly one record), common (share of records above the threshold), else null.
    With no records at all, no term is common."""
    share = F.col("records") / F.lit(float(n_records)) if n_records else F.lit(0.0)
    return counted.withColumn("mark", F.when(share > F.lit(threshold), "common").when(F.col("records") == 1, "rare"))


_PAIRS = "term string, record long, n long, part int"
_COUNTS = "term string, occurrences long, records long, part int"


class TermCountStore:
    """The persistent partitioned counts, in a folder that all executors share. Opening a folder that has a store
    goes on with it.

    Each apply() writes the touched partitions of both tables into folders of its own and then a new manifest,
    which is what makes them the state. Partitions are doubled as the state grows beyond rows_per_part.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rows_per_part: int = ROWS_PER_PART):
        self.spark, self.path, self.rows_per_part = spark, path or shared_folder(spark, "term-counts"), rows_per_part
        try:
            kept = json.loads(read_text(spark, f"{self.path}/manifest.json"))
        except NotFound:
            kept = {"version": 0, "parts": 0, "rows": 0, "at": {}, "former": []}
        self.version, self.parts, self.rows = kept["version"], kept["parts"], kept["rows"]
        self.at: dict[int, str] = {int(p): folder for p, folder in kept["at"].items()}
        self.former: list[str] = kept["former"]

    def apply(self, added: DataFrame | None, removed: DataFrame | None, term: str, record: str) -> None:
        """One change set. It is aggregated once, into a table; the state is read in the partitions it touches."""
        self.version += 1
        there = f"{self.path}/v{self.version}-{uuid.uuid4().hex[:8]}"  # a change set that broke may have left its own
        signed_deltas(added, removed, term, record).write.parquet(f"{there}/delta")
        delta = self.spark.read.schema("term string, record long, n long").parquet(f"{there}/delta")
        grown = self.rows + delta.count()
        parts = max(1, self.parts)
        while grown > parts * self.rows_per_part:
            parts *= 2
        whole = parts != self.parts  # another number of partitions: all are written anew
        touched = sorted(self.at) if whole else [r[0] for r in delta.select(_part(parts)).distinct().collect()]  # a row per partition
        known = [p for p in touched if p in self.at]
        merged = merge_deltas(self._read(known, "pairs", _PAIRS) if known else None, delta).withColumn("part", _part(parts))
        self._write(merged, f"{there}/merged")
        merged = self.spark.read.schema("term string, record long, was long, n long, part int").parquet(f"{there}/merged")
        self._write(merged.where("n <> 0").select("term", "record", "n", "part"), f"{there}/pairs")
        changes = term_changes(merged)
        if known:
            changes = changes.unionByName(self._read(known, "counts", _COUNTS).select("term", "occurrences", "records")).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        self._write(changes.where("occurrences <> 0").withColumn("part", _part(parts)), f"{there}/counts")
        if whole:
            at = {p: there for p in range(parts)}
        else:
            at = self.at | {p: there for p in touched}
        before = 0 if not known else self._read(known, "pairs", _PAIRS).count()
        rows = self.rows - before + self.spark.read.schema(_PAIRS).parquet(f"{there}/pairs").count()
        former = sorted(set(self.at.values()) - set(at.values()))
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps({"version": self.version, "parts": parts, "rows": rows, "at": at, "former": former}))
        # what the last change set left may still be read; what the one before it left goes
        for done in (f"{there}/delta", f"{there}/merged", *(set(self.former) - set(at.values()))):
            delete_folder(self.spark, done)
        self.at, self.parts, self.rows, self.former = at, parts, rows, former

    def _write(self, df: DataFrame, path: str) -> None:
        """By partition, few files each; a partition with a hot term is split over several tasks."""
        df.hint("rebalance", "part").write.partitionBy("part").parquet(path)

    def _read(self, parts: list[int], table: str, schema: str) -> DataFrame:
        folders: dict[str, list[int]] = {}
        for p in parts:
            folders.setdefault(self.at[p], []).append(p)
        frames = [self.spark.read.schema(schema).parquet(f"{path}/{table}").where(F.col("part").isin(ps)) for path, ps in folders.items()]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def counts(self) -> DataFrame:
        """(term, occurrences, records) of every term with at least one occurrence."""
        if not self.at:
            return self.spark.createDataFrame([], "term string, occurrences long, records long")
        return self._read(sorted(self.at), "counts", _COUNTS).select("term", "occurrences", "records")


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")


def concept_counts(paper_concepts: DataFrame, concepts: DataFrame, papers: DataFrame, threshold: float) -> DataFrame:
    """(concept_id, edges, papers, mark) of every concept id in paper_concepts, counted from the edges alone.

    The store is loaded with the rows delivered on time, under their ids as they are written. It is then opened
    anew, and one change set adds the rows delivered late and moves each row whose id is another spelling:
    removed under the old one, added under the folded one. Ids are written as in concepts.id, or in folded form
    where concepts has none. Null ids are ignored; empty tables give no rows.
    """
    spark = paper_concepts.sparkSession
    edges = paper_concepts.select("concept_id", fold_id(F.col("concept_id")).alias("term"), F.col("paper_id").alias("record"), "recorded_at")
    cut = edges.agg(F.percentile_approx("recorded_at", 0.9, 1000).alias("q")).first()["q"]
    late = F.lit(False) if cut is None else F.coalesce(F.col("recorded_at") > F.lit(cut), F.lit(False))
    first = TermCountStore(spark)
    as_written = edges.where(~late).select(F.col("concept_id").alias("term"), "record")
    first.apply(as_written, None, "term", "record")
    store = TermCountStore(spark, first.path)
    respelled = edges.where(~late).where("concept_id <> term")
    store.apply(edges.where(late).select("term", "record").unionByName(respelled.select("term", "record")), respelled.select(F.col("concept_id").alias("term"), "record"), "term", "record")
    spelled = concepts.where("id is not null").groupBy(fold_id(F.col("id")).alias("term")).agg(F.min("id").alias("id"))
    counted = mark(store.counts(), papers.count(), threshold)
    return counted.join(spelled, "term", "left").select(
        F.coalesce("id", "term").alias("concept_id"), F.col("occurrences").alias("edges"), F.col("records").alias("papers"), "mark"
    )
