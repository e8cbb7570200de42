"""Translation-memory operators: lookup, deduplication, repetition, re-matching.

Joins meet on keys that were aggregated first wherever one side can repeat a key, so
that a text that makes up a third of all rows costs one row per key on that side.

Defined cases: null and blank keys never match; ties are settled by id; empty inputs
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tmloom.functions import scoring, text as T
from tmloom.operators.ordered import positions
from tmloom.session import materialise


def exact_lookup(segments: DataFrame, units: DataFrame, keep: int = 5, strict: bool = False) -> DataFrame:
    """``id, unit_id, target_text, score, rank``: per segment the best units of its project with the same key.

    ``strict`` compares the stored ``source_hash`` with the hash of the text without
    outer white space only; otherwise both sides are collapsed.
    """
    key = F.sha2(T.strip(F.col("source")), 256) if strict else T.tm_key(F.col("source"))
    unit_key = F.col("source_hash") if strict else T.tm_key(F.col("source_text"))
    usable = units.filter((F.col("target_text") != "") & F.col("source_text").isNotNull()).select(
        "project_id", unit_key.alias("key"), F.struct((-scoring.origin_score(F.col("origin_type"))).alias("neg"), F.col("id").alias("unit_id"), "target_text").alias("u"))
    # at most `keep` units of a key can appear in any result
    best = smallest(usable, ["project_id", "key"], "u", keep)
    return (segments.filter(F.col("source").isNotNull()).select("id", "project_id", key.alias("key")).join(best, ["project_id", "key"])
            .select("id", F.posexplode("best").alias("pos", "u"))
            .select("id", F.col("u.unit_id").alias("unit_id"), F.col("u.target_text").alias("target_text"), (-F.col("u.neg")).alias("score"), (F.col("pos") + 1).alias("rank")))


def smallest(df: DataFrame, keys: list[str], struct: str, n: int, salts: int = 16) -> DataFrame:
    """``keys, best``: the ``n`` smallest structs per key; a hot key is cut into salts first."""
    cut = lambda c: F.slice(F.array_sort(c), 1, n)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(struct), F.lit(salts)))
    w = Window.partitionBy(*keys, "__salt").orderBy(struct)
    top = salted.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return top.groupBy(*keys).agg(cut(F.collect_list(struct)).alias("best"))


def priority(category, exact):
    """Rank of a candidate's kind: exact 4, mandatory or legal 3, user 2, other 1."""
    return F.when(exact, 4).when(category.isin("mandatory", "legal"), 3).when(category == "user", 2).otherwise(1)


def priority_distinct(candidates: DataFrame, keys: list[str], prio: str, position: str) -> DataFrame:
    """One candidate per key: the highest priority, the earliest among equals; ``first_position`` is that of the key."""
    rest = [c for c in candidates.columns if c not in keys]
    best = candidates.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(prio), (-F.col(position)).alias("p"))).alias("b"), F.min(position).alias("first_position"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest], "first_position")


def repetition_counts(segments: DataFrame) -> DataFrame:
    """``segments`` with ``repetitions``: rows of the project with the same source; only repeated ones."""
    n = segments.filter("source is not null").groupBy("project_id", "source").agg(F.count("*").alias("repetitions")).filter("repetitions > 1")
    return segments.join(n, ["project_id", "source"])


def first_occurrences(segments: DataFrame) -> DataFrame:
    """``project_id, source, id, idx, skipped``: the first row of each source and how many follow it."""
    return segments.filter("source is not null").groupBy("project_id", "source").agg(
        F.min(F.struct("idx", "id")).alias("f"), (F.count("*") - 1).alias("skipped")).select(
        "project_id", "source", F.col("f.id").alias("id"), F.col("f.idx").alias("idx"), "skipped")


def propagate(segments: DataFrame, overwrite: bool = False) -> DataFrame:
    """``id, new_target``: rows that take over the first translation of their source in the project.

    Where ``segments`` has a column ``fixed`` (locked, skipped or excluded rows), such rows
    stay as they are; their translations may still be taken over.
    """
    done = segments.filter("target is not null and target <> '' and source is not null").groupBy("project_id", "source").agg(F.min(F.struct("idx", "id", "target")).alias("f"))
    hit = segments.join(done, ["project_id", "source"]).filter(F.col("id") != F.col("f.id"))
    if not overwrite:
        hit = hit.filter("target is null or target = ''")
    if "fixed" in segments.columns:
        hit = hit.filter("not coalesce(fixed, false)")
    return hit.select("id", F.col("f.target").alias("new_target"))


def rematch(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new_id, old_id, tier``: rows of a new version with the rows of the old one they take over.

    First the n-th row of a text takes the n-th old row of the same text; what is left
    matches by its normalised form where that is unique on both sides. Both sides have
    ``project_id, idx, id, source``.
    """
    exact = T.strip(F.col("source"))
    side = lambda df, name: positions(df.filter("source is not null").select("project_id", "idx", F.col("id").alias(name), exact.alias("key"), T.match_key(F.col("source")).alias("norm")),
                                      ["project_id", "key"], "idx", name, "place", size=None)
    o, n = side(old, "old_id"), side(new, "new_id")
    first = n.join(o.select("project_id", "key", "place", "old_id"), ["project_id", "key", "place"]).select("project_id", "new_id", "old_id", F.lit("exact").alias("tier"))
    single = lambda df, name: df.join(first.select(name), name, "left_anti").groupBy("project_id", "norm").agg(F.count("*").alias("c"), F.min(name).alias(name)).filter("c = 1").drop("c")
    second = single(n, "new_id").join(single(o, "old_id"), ["project_id", "norm"]).select("project_id", "new_id", "old_id", F.lit("normalised").alias("tier"))
    return first.unionByName(second).select("new_id", "old_id", "tier")


def reinitialise(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new_id, old_id, tier``: rows of freshly parsed files with the stored rows they take over.

    Four tiers, each over what the ones before left: the same text in the same file, the
    same text among rows without a file (both in order), then the normalised text in the
    same file and among rows without a file where it is unique on both sides. ``old`` and
    ``new`` have ``id, project_id, file_id, idx, source``.
    """
    shape = lambda df, name: df.filter("source is not null and project_id is not null and idx is not null").select(
        "project_id", F.coalesce("file_id", F.lit("")).alias("file"), "idx", F.col("id").alias(name), T.strip(F.col("source")).alias("key"), T.match_key(F.col("source")).alias("norm"))
    o, n, found = materialise(shape(old, "old_id"), "old"), materialise(shape(new, "new_id"), "new"), None
    for tier, (column, orphans, unique) in enumerate((("key", False, False), ("key", True, False), ("norm", False, True), ("norm", True, True)), 1):
        left_o = o.filter(F.col("file") == "") if orphans else o.filter(F.col("file") != "")
        left_n = n
        if found is not None:
            left_o, left_n = left_o.join(found.select("old_id"), "old_id", "left_anti"), left_n.join(found.select("new_id"), "new_id", "left_anti")
        by = ["project_id", column] if orphans else ["project_id", "file", column]
        if unique:
            one = lambda df, name: df.groupBy(*by).agg(F.count("*").alias("c"), F.min(name).alias(name)).filter("c = 1").drop("c")
            hit = one(left_n, "new_id").join(one(left_o, "old_id"), by)
        else:
            at = lambda df, name: positions(df, by, "idx", name, "place").select(*by, "place", name)
            hit = at(left_n, "new_id").join(at(left_o, "old_id"), [*by, "place"])
        hit = materialise(hit.select("new_id", "old_id", F.lit(tier).alias("tier")), "tier")  # read again by every later tier
        found = hit if found is None else found.unionByName(hit)
    return found


def summary(matches: DataFrame) -> DataFrame:
    """``tier, rows``: how many rows each tier gave."""
    return matches.groupBy("tier").agg(F.count("*").alias("rows"))
