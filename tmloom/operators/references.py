"""Orphan references: children whose key names no usable parent.

``orphans`` anti-joins the distinct non-null foreign keys of a child table with
the parent keys, so the side that meets the parents has one row per key however
often a key is repeated, and joins the verdict back to the children.

Defined cases: a null or blank key is no reference; keys compare without letter
case and surrounding blanks; a record delivered several times is one record whose
arrival is the earliest; a parent present in its table is never ``deleted``; a
null arrival on either side is never ``late``; a null event time gives the period
null. Extra columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tmloom.functions.keys import first_delivery, norm_key


SALTS = 8


@dataclass(frozen=True)
class Reference:
    """A foreign key: child table, its id, key and event-time column, and the parent table."""

    child: str
    child_id: str
    key: str
    event_time: str
    parent: str
    parent_id: str = "id"
    arrived: str = "arrived_at"


REFERENCES = (
    Reference("translation_units", "id", "project_id", "created_at", "projects"),
    Reference("ai_usage_logs", "id", "segment_id", "logged_at", "segments"),
    Reference("context_chunks", "id", "file_id", "arrived_at", "project_files"),
)


def _children(df: DataFrame, ref: Reference) -> DataFrame:
    src = df.select(
        F.col(ref.child_id).cast("string").alias("child_id"),
        norm_key(ref.key).alias("ref_key"),
        F.col(ref.event_time).alias("event_time"),
        F.col(ref.arrived).alias("arrived"),
    ).filter(F.col("ref_key").isNotNull())
    # the chunk table has no time of its own: its event time is the first arrival, which min keeps
    return first_delivery(src, "arrived", "child_id", "ref_key", also=("event_time",))


def orphans(child: DataFrame, parent: DataFrame, deletions: DataFrame, ref: Reference) -> DataFrame:
    """``child_table, child_id, reason, period, ref_key`` of every orphan of ``ref``."""
    kids = _children(child, ref)
    parents = first_delivery(
        parent.select(norm_key(ref.parent_id).alias("ref_key"), F.col(ref.arrived).alias("p_arrived"))
        .filter(F.col("ref_key").isNotNull()), "p_arrived", "ref_key")
    gone = (deletions.filter(F.lower(F.trim("table_name")) == ref.parent)
            .select(norm_key("row_id").alias("ref_key"), F.lit(True).alias("was_deleted"))
            .filter(F.col("ref_key").isNotNull()).distinct())
    # one row per distinct key, with the first arrival among its children: a key whose
    # children all came after their parent drops out here and needs no join back
    keys = kids.groupBy("ref_key").agg(F.min("arrived").alias("first_child"))
    absent = keys.join(parents, "ref_key", "left_anti").join(gone, "ref_key", "left").select(
        "ref_key", F.when(F.col("was_deleted"), "deleted").otherwise("missing").alias("reason"),
        F.lit(None).cast("timestamp_ntz").alias("p_arrived"))
    early = keys.join(parents, "ref_key").filter(F.col("first_child") < F.col("p_arrived")).select(
        "ref_key", F.lit("late").alias("reason"), F.col("p_arrived").cast("timestamp_ntz"))
    # a key may have a third of all children: these are spread over SALTS tasks, and the verdict of each key goes to all
    verdict = absent.unionByName(early).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = kids.withColumn("salt", F.pmod(F.xxhash64("child_id"), F.lit(SALTS)).cast("int"))
    return (salted.join(verdict, ["ref_key", "salt"])
            .filter((F.col("reason") != "late") | (F.col("arrived") < F.col("p_arrived")))
            .select(F.lit(ref.child).alias("child_table"), "child_id", "reason",
                    F.date_format("event_time", "yyyy-MM").alias("period"), "ref_key"))


def all_orphans(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """The orphans of every reference; ``tables`` maps table names to DataFrames."""
    out = None
    for ref in references:
        part = orphans(tables[ref.child], tables[ref.parent], tables["deletion_log"], ref)
        out = part if out is None else out.unionByName(part)
    return out


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan counts and distinct dangling keys per table, period and reason."""
    return found.groupBy("child_table", "period", "reason").agg(
        F.count("*").alias("orphans"), F.countDistinct("ref_key").alias("dangling_keys"))
