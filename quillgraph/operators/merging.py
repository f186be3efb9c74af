"""From per-paper concepts to one vocabulary: groups, solos, slug collisions and their components, and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug

#: Rounds of label propagation before a graph of collisions counts as broken; paths halve in each round.
MOST_ROUNDS = 40


def solo_concepts(concepts: DataFrame, grouped: DataFrame) -> DataFrame:
    """Concepts (paper_id, local_id, ...) that no group holds; grouped: paper_id, local_id."""
    return concepts.join(grouped.select("paper_id", "local_id").distinct(), ["paper_id", "local_id"], "left_anti")


def derive_solo(concepts: DataFrame) -> DataFrame:
    """Each concept as a normalized one of its own; a name without a-z and 0-9 is addressed by its place."""
    own = slug(F.coalesce("name", F.lit("")))
    return concepts.select(
        F.when(own != "", own).otherwise(F.concat_ws("-", F.lit("concept"), "paper_id", "local_id")).alias("id"),
        F.col("name").alias("canonical_name"), "type", "aliases", "description", F.array(F.struct("paper_id", "local_id")).alias("merged_from"),
    )


def group_members(grouping: DataFrame, concepts: DataFrame) -> DataFrame:
    """(group_id, pos, concept columns) of groups (group_id, refs array<struct<paper_id, local_id>>)."""
    refs = grouping.select("group_id", F.posexplode("refs").alias("pos", "r")).select("group_id", "pos", "r.paper_id", "r.local_id")
    return refs.join(concepts, ["paper_id", "local_id"])


def slug_collisions(claims: DataFrame) -> DataFrame:
    """(slug, group_ids) of slugs that more than one group claims; claims: slug, group_id. Null slugs are passed over."""
    return claims.where("slug is not null").distinct().groupBy("slug").agg(F.array_sort(F.collect_set("group_id")).alias("group_ids")).where(F.size("group_ids") > 1)


def collision_components(claims: DataFrame) -> DataFrame:
    """(group_id, component) of every group that shares a slug, directly or through others; component is its lowest group.

    Labels spread along slugs and then jump to the label of their label, so that long chains take few rounds.
    Each round is cut off from its lineage by checkpoint().
    """
    spark = claims.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        from ..sources.folders import shared_folder

        spark.sparkContext.setCheckpointDir(shared_folder(spark, "components"))
    rows = claims.where("slug is not null").select("slug", "group_id").distinct()
    shared = rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slug")
    rows = rows.join(shared, "slug").checkpoint()
    labels = rows.select("group_id", F.col("group_id").alias("component")).distinct().checkpoint()
    for _ in range(MOST_ROUNDS):
        labelled = rows.join(labels, "group_id")
        least = labelled.groupBy("slug").agg(F.min("component").alias("least"))
        # the old label comes along, so that the end is seen without a further join
        near = labelled.join(least, "slug").groupBy("group_id").agg(F.min("least").alias("component"), F.min("component").alias("old"))
        above = labels.select(F.col("group_id").alias("component"), F.col("component").alias("up"))
        new = near.join(above, "component", "left").select("group_id", F.least("component", F.coalesce("up", "component")).alias("component"), "old").checkpoint()
        labels = new.drop("old")
        if not new.where("component <> old").take(1):
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def combine_groups(members: DataFrame, components: DataFrame) -> DataFrame:
    """(group_id, refs, answered): untouched groups as they are; colliding ones joined under their lowest, end to end, unanswered."""
    joined = members.join(components, "group_id", "left")
    refs = F.array_sort(F.collect_list(F.struct("group_id", "pos", F.struct("paper_id", "local_id").alias("ref"))))
    return (
        joined.withColumn("to", F.coalesce("component", "group_id")).groupBy("to")
        .agg(refs.alias("x"), F.first("component").isNull().alias("answered"))
        .select(F.col("to").alias("group_id"), F.transform("x", lambda v: v["ref"]).alias("refs"), "answered")
    )


def collision_issues(claims: DataFrame, members: DataFrame) -> DataFrame:
    """(slug, message): each slug that groups claim apart, with their concepts spelled out."""
    hit = slug_collisions(claims)
    named = members.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paper_id", "local_id"))), lambda m: F.format_string("paper %d '%s'", m["paper_id"], m["local_id"])), ", ").alias("text"))
    spelled = hit.select("slug", F.posexplode("group_ids").alias("n", "group_id")).join(named, "group_id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "; ")
    return spelled.groupBy("slug").agg(F.format_string("'%s' is the id of a concept in %d groups that were merged apart: %s", F.first("slug"), F.count(F.lit(1)), listed).alias("message"))


def unknown_refs(refs: DataFrame, concepts: DataFrame) -> DataFrame:
    """(path, message) of references that no extraction has; refs: path, paper_id, local_id."""
    lost = refs.join(concepts.select("paper_id", "local_id").distinct(), ["paper_id", "local_id"], "left_anti")
    papers = concepts.select("paper_id", F.lit(True).alias("known")).distinct()
    return lost.join(papers, "paper_id", "left").select(
        "path", F.when(F.col("known"), F.format_string("paper %d has no concept '%s'", "paper_id", "local_id")).otherwise(F.format_string("there is no extraction for paper %d", "paper_id")).alias("message")
    )


def uncovered_concepts(concepts: DataFrame, refs: DataFrame) -> DataFrame:
    """(paper_id, local_id, message) of extracted concepts that no reference covers."""
    lost = concepts.select("paper_id", "local_id").distinct().join(refs.select("paper_id", "local_id").distinct(), ["paper_id", "local_id"], "left_anti")
    return lost.withColumn("message", F.format_string("paper %d '%s' is in no merged_from", "paper_id", "local_id"))


def type_issues(normalized: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, message) of merged concepts whose type none of their sources has; without a known source there is no issue."""
    refs = normalized.select("id", "type", F.explode("merged_from").alias("r")).select("id", F.col("type").alias("own"), "r.paper_id", "r.local_id")
    sources = refs.join(concepts.select("paper_id", "local_id", "type").distinct(), ["paper_id", "local_id"])
    found = sources.groupBy("id", "own").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return found.where(~F.array_contains("types", F.col("own"))).select(
        "id", F.format_string("is '%s', which none of the merged concepts has; they are %s", "own", F.array_join("types", ", ")).alias("message")
    )


def check_normalization(normalized: DataFrame, concepts: DataFrame) -> DataFrame:
    """(path, message): unknown references, types without source, uncovered concepts; normalized needs corpus position pos."""
    refs = normalized.select("pos", F.posexplode("merged_from").alias("n", "r")).select(F.format_string("concepts[%d].merged_from[%d]", "pos", "n").alias("path"), "r.paper_id", "r.local_id")
    types = type_issues(normalized, concepts).join(normalized.select("id", "pos"), "id").select(F.format_string("concepts[%d].type", "pos").alias("path"), "message")
    return unknown_refs(refs, concepts).unionByName(types).unionByName(uncovered_concepts(concepts, refs).select(F.lit("concepts").alias("path"), "message"))


def check_group_merge(merged: DataFrame, members: DataFrame) -> DataFrame:
    """The same for the merge of each group, whose members are its whole world; merged has group_id, members group_id, paper_id, local_id, type."""
    refs = merged.select("group_id", "pos", "type", F.posexplode("merged_from").alias("n", "r")).select("group_id", "pos", F.col("type").alias("own"), "n", "r.paper_id", "r.local_id")
    keys = ["group_id", "paper_id", "local_id"]
    joined = refs.join(members.select(*keys, "type"), keys, "left")
    outside = joined.where("type is null").select("group_id", F.format_string("concepts[%d].merged_from[%d]", "pos", "n").alias("path"), F.format_string("paper %d '%s' is not one of the grouped concepts", "paper_id", "local_id").alias("message"))
    found = joined.where("type is not null").groupBy("group_id", "pos", "own").agg(F.array_sort(F.collect_set("type")).alias("types")).where(~F.array_contains("types", F.col("own")))
    typed = found.select("group_id", F.format_string("concepts[%d].type", "pos").alias("path"), F.format_string("is '%s', which none of the merged concepts has; they are %s", "own", F.array_join("types", ", ")).alias("message"))
    lost = members.select(*keys).join(refs.select(*keys).distinct(), keys, "left_anti").select("group_id", F.lit("concepts").alias("path"), F.format_string("paper %d '%s' is in no merged_from", "paper_id", "local_id").alias("message"))
    return outside.unionByName(typed).unionByName(lost)


def check_relations(proposed: DataFrame, normalized: DataFrame, stated: DataFrame) -> DataFrame:
    """(path, message): ends that aren't declared, each by itself, and proposals that repeat what papers state. proposed: pos, source_id, target_id, relation."""
    ends = proposed.select("pos", F.explode(F.array(F.struct(F.lit("source_id").alias("field"), F.col("source_id").alias("slug")), F.struct(F.lit("target_id").alias("field"), F.col("target_id").alias("slug")))).alias("e")).select("pos", "e.field", "e.slug")
    unknown = ends.join(normalized.select(F.col("id").alias("slug")).distinct(), "slug", "left_anti").select(
        F.format_string("concept_relations[%d].%s", "pos", "field").alias("path"), F.format_string("is '%s', which is not one of the normalized concepts", "slug").alias("message")
    )
    papers = F.array_join(F.transform("paper_ids", lambda p: p.cast("string")), ", ")
    subject = F.when(F.size("paper_ids") == 1, F.concat(F.lit("paper "), papers, F.lit(" states"))).otherwise(F.concat(F.lit("papers "), papers, F.lit(" state")))
    repeated = proposed.join(stated, ["source_id", "target_id", "relation"]).select(
        F.format_string("concept_relations[%d]", "pos").alias("path"), F.format_string("repeats what %s: %s %s %s", subject, "source_id", "relation", "target_id").alias("message")
    )
    return unknown.unionByName(repeated)
