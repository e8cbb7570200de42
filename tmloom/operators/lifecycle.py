"""Changes to stored tables, as transformations from one snapshot to the next.

Nothing is updated in place: each operator gives the new rows of a table. New ids are
derived by hash from the old ones, so a repeated run gives the same result.

Defined cases: an update without a row changes nothing; a null in an update leaves the
old value; of several updates of a row the last by ``order`` counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def derived_id(scope: str, c: Column) -> Column:
    """A new id that depends on the old one and on the operation alone."""
    return F.substring(F.sha2(F.concat(F.lit(scope + "/"), c.cast("string")), 256), 1, 32)


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of a table whose ``key`` is not among the keys in ``gone``."""
    return df.join(gone.select(F.col(gone.columns[0]).alias(key)).distinct(), key, "left_anti")


def duplicated(df: DataFrame, scope: str, ids: dict[str, DataFrame | None]) -> DataFrame:
    """Copies of rows with new ids: each column in ``ids`` is mapped, a null stays null."""
    for c in ids:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), derived_id(scope, F.col(c))))
    return df


def patched(df: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with the values of ``updates`` where they are not null."""
    cols = [c for c in updates.columns if c not in (key, order)]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__u"))
    return df.join(last, key, "left").select(*[
        (F.coalesce(F.col(f"__u.{c}"), F.col(c)) if c in cols else F.col(c)).alias(c) for c in df.columns])


def upserted(df: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` without the rows that ``fresh`` replaces, and ``fresh``."""
    return df.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def copied_source(segments: DataFrame) -> DataFrame:
    """Every target set to its source."""
    return segments.withColumn("target", F.col("source"))


def cleared(segments: DataFrame, drafts: tuple[str, ...] = ("draft", "mt_draft", "error")) -> DataFrame:
    """Targets of draft rows removed, and what a model noted beside them (columns ``ai_*``); the rows are plain drafts again."""
    draft = F.coalesce(F.col("status").isin(*drafts), F.lit(False))
    gone = [c for c in segments.columns if c == "target" or c.startswith("ai_")]
    return segments.select(*[(F.when(~draft, F.col(c)) if c in gone else F.when(draft, "draft").otherwise(F.col(c)) if c == "status" else F.col(c)).alias(c) for c in segments.columns])


def copied_comments(segments: DataFrame) -> DataFrame:
    """The targets of comments (``is_comment``) set to their source; new and drafted ones count as translated."""
    c = F.col("is_comment")
    return segments.withColumn("target", F.when(c, F.col("source")).otherwise(F.col("target"))).withColumn(
        "status", F.when(c & F.col("status").isin("new", "draft"), "translated").otherwise(F.col("status")))


def guarded(segments: DataFrame, updates: DataFrame) -> DataFrame:
    """The updated rows (``updates``: ``id, new_target``) with ``rejected``: those of ``fixed`` rows keep their target."""
    return segments.join(updates, "id").withColumn("rejected", F.col("fixed")).withColumn("target", F.when(F.col("fixed"), F.col("target")).otherwise(F.col("new_target"))).drop("new_target")


def written_back(segments: DataFrame, drafts: DataFrame) -> DataFrame:
    """``segments`` with ``draft`` from ``drafts`` (``id, draft``); a target is filled only where there is none."""
    j = segments.join(drafts, "id", "left")
    return j.withColumn("target", F.when((F.coalesce("target", F.lit("")) == "") & F.col("draft").isNotNull(), F.col("draft")).otherwise(F.col("target")))


def results_written(segments: DataFrame, results: DataFrame, status: str = "mt_draft") -> DataFrame:
    """``segments`` with the outputs of ``results`` (``id, output``); blank outputs change nothing, others set the status."""
    j = segments.join(results.filter(F.trim("output") != ""), "id", "left")
    there = F.col("output").isNotNull()
    return j.withColumn("target", F.coalesce("output", "target")).withColumn("status", F.when(there, status).otherwise(F.col("status"))).drop("output")


def merged_json(old: Column, update: Column) -> Column:
    """A JSON object with the keys of another put in or replaced; an unreadable update changes nothing, an unreadable object counts as empty."""
    a, b = (F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>") for c in (old, update))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def drafted(rows: DataFrame, modes: tuple[str, ...] = ("copy_source", "analyze", "draft", "translate")) -> DataFrame:
    """``rows`` (``source, target, draft``) once for each mode: what it makes of the target and the draft."""
    m = F.col("mode")
    out = rows.withColumn("mode", F.explode(F.array(*[F.lit(x) for x in modes])))
    return out.withColumn("target", F.when(m == "copy_source", F.col("source")).when(m == "translate", F.coalesce("draft", "target")).otherwise(F.col("target"))).withColumn(
        "draft", F.when(m.isin("draft", "translate"), F.col("draft")))


#: the columns that hold ids, by table; a table lives as long as the project or file that it names
REFERENCES = {"projects": ("id",), "project_files": ("id", "project_id"), "segments": ("id", "project_id", "file_id"), "translation_units": ("id", "project_id"),
              "context_chunks": ("id", "file_id"), "ai_usage_logs": ("id", "project_id", "segment_id")}


def duplicated_tables(tables: dict[str, DataFrame], scope: str) -> dict[str, DataFrame]:
    """All tables of projects as copies: every id mapped by the same rule, so references hold among the copies."""
    return {name: duplicated(df, scope, {c: None for c in REFERENCES[name] if c in df.columns}) for name, df in tables.items()}


def deleted_tables(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """What stays of all tables when the projects in ``gone`` (a column ``id``) go with all that hangs on them."""
    out = {}
    for name, df in tables.items():
        if name == "projects":
            out[name] = without(df, "id", gone)
        elif "project_id" in df.columns:
            out[name] = without(df, "project_id", gone)
        else:
            lost = tables["project_files"].join(gone.select(F.col("id").alias("project_id")).distinct(), "project_id", "left_semi").select("id")
            out[name] = without(df, "file_id", lost)
    return out


def fingerprint(rows: DataFrame, group: str, order: list[str], parts: list[str], bucket: int = 1024) -> DataFrame:
    """``group, rows, fingerprint``: a digest over the ordered rows of each group.

    A digest of digests: each bucket of rows (by the first order column) is digested by
    itself, so no task holds a whole group; any change of a part, the order or the
    number of rows changes the result.
    """
    text = F.concat(*[x for p in parts for x in (F.coalesce(F.col(p).cast("string"), F.lit("")), F.lit("\x1f"))])
    line = F.sha2(text, 256)
    b = rows.filter(F.col(group).isNotNull()).groupBy(group, F.floor(F.coalesce(F.col(order[0]), F.lit(-1)) / bucket).alias("b")).agg(
        F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("l")))), lambda s: s["l"]), ""), 256).alias("h"))
    return b.groupBy(group).agg(F.sum("n").alias("rows"), F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), ""), 256), 1, 16).alias("fingerprint"))


def outdated(files: DataFrame, group: str, newest_first: Column, keep: int) -> DataFrame:
    """The rows of each group beyond the newest ``keep``; ``newest_first`` is a struct that orders them and is unique.

    The newest are found salted, so a group is never sorted in one task.
    """
    from tmloom.operators.tm import smallest

    ranked = files.withColumn("__order", newest_first)
    newest = smallest(ranked, [group], "__order", keep).select(group, F.explode("best").alias("__order"))
    return ranked.join(newest, [group, "__order"], "left_anti").filter(F.col(group).isNotNull()).drop("__order")
