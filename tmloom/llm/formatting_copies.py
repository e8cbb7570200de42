"""Copies hidden by formatting: records that differ only in how they are written.

Method: every record gets a canonical form; the records are range-partitioned by
(scope, canonical form, id) and sorted within the partitions, which spills to
disk; one scan over the sorted rows compares full neighbouring keys and finds the
runs. The id is part of the range key, so a group that holds a third of all rows
is spread over many partitions; the runs cut by a partition edge are put together
from at most two edge rows per partition.

Defined cases: a null text is no record; texts without any letter, digit or symbol
group by their bare canonical form (empty) like any other; ids compare as strings;
a record delivered several times counts once; blanks around and the letter case of
the scope key do not matter, a null scope is a scope of its own; extra columns are
ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tmloom.functions.keys import norm_key
from tmloom.session import materialise

# what formatting is: white space with zero-width and invisible marks, punctuation
_SPACE = r"\s\x{85}\x{A0}\x{AD}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}"
_NOISE = rf"[\p{{P}}{_SPACE}]+"
_TAG = r"</?\d+\s*/?>"
#: a comma or point between two digits belongs to the number: kept as these symbols, which are no punctuation
_COMMA, _POINT = "\x11", "\x12"
_FIELD = rf"^[{_SPACE}\p{{P}}]*[^\d:;|][^:;|]*:"


def fold(c: Column) -> Column:
    """Letter case folded; upper case first, so that letters with a two-letter capital meet it.

    The optimiser takes lower(upper(x)) for lower(x); the empty text between keeps them apart.
    """
    return F.lower(F.concat(F.upper(c), F.lit("")))


def bare(c: Column) -> Column:
    """A text without formatting: tags, white space, case and punctuation outside numbers removed."""
    c = F.regexp_replace(c, r"(?<=\d),(?=\d)", _COMMA)
    c = F.regexp_replace(c, r"(?<=\d)\.(?=\d)", _POINT)
    return fold(F.regexp_replace(c, _NOISE, ""))


def canonical(text: Column) -> Column:
    """The canonical form of a text; of a list of two or more fields, its sorted fields.

    Fields are separated by ``;``, ``|`` or a line break. A part without a colon
    continues the field before it (a line break may stand for a blank).
    """
    plain = F.regexp_replace(text, _TAG, "")
    parts = F.split(plain, r"[;|\r\n]+")
    named = F.filter(parts, lambda p: F.regexp_replace(p, _NOISE, "") != "")
    fields = F.aggregate(
        named, F.array().cast("array<string>"),
        lambda acc, p: F.when(p.rlike(_FIELD) | (F.size(acc) == 0), F.concat(acc, F.array(p))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), p)))))
    # name and value are kept apart, so that "ab: c" and "a: bc" differ
    keyed = F.array_sort(F.transform(fields, lambda p: F.concat(
        bare(F.substring_index(p, ":", 1)), F.lit("\x1e"), bare(F.regexp_replace(p, r"^[^:]*:", "")))))
    is_list = (F.size(fields) >= 2) & F.forall(fields, lambda p: p.rlike(_FIELD))
    may_be = plain.rlike(rf"^[^:]*:.*[;|\r\n]") | plain.rlike(r"(?s):.*[;|\r\n].*:")
    return F.when(may_be & plain.rlike(r"(?s):.*[;|\r\n].*:"), F.when(is_list, F.concat(F.lit("\x1d"), F.array_join(keyed, "\x1f")))
                  .otherwise(bare(plain))).otherwise(bare(plain))


_SCAN = "kind string, rtable string, scope string, canon string, head string, id string, part int"
_SCAN_ARROW = pa.schema([(c, pa.string()) for c in ("kind", "rtable", "scope", "canon", "head", "id")] + [("part", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in sorted rows.

    Emits ``member`` rows (a copy and the head of its run), and for the runs that
    touch the edges of the partition ``edge`` rows (key and head). Copies in the
    first run are ``open``: their head may lie in an earlier partition.
    """
    part = TaskContext.get().partitionId()
    key = head = last_id = None
    first_run = True
    edge_out: list[tuple] = []

    def rows(kind, t, s, c, h, i):
        n = len(i)
        fill = lambda v: v if isinstance(v, pa.Array) else pa.array([v] * n, pa.string())
        return pa.RecordBatch.from_arrays([fill(kind), fill(t), fill(s), fill(c), fill(h), i, pa.array([part] * n, pa.int32())], schema=_SCAN_ARROW)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(j) for j in range(4)]
        same = None
        for col in cols[:3]:
            eq = pc.equal(col.slice(1), col.slice(0, n - 1))
            same = eq if same is None else pc.and_(same, eq)
        starts = [j + 1 for j, x in enumerate(same.to_pylist()) if not x]
        k0 = tuple(c[0].as_py() for c in cols[:3])
        if k0 != key:
            starts.insert(0, 0)
        ids = cols[3].to_pylist()
        heads = [None] * n
        bounds = [*starts, n]
        opened = 0
        if not starts or starts[0] > 0:  # the run goes on from the batch before
            for j in range(0, bounds[0]):
                heads[j] = head
            if first_run:
                opened = bounds[0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if key is not None:
                if first_run:
                    edge_out.append((*key, head))
                first_run = False
            key, head = tuple(c[a].as_py() for c in cols[:3]), ids[a]
            if first_run:
                opened = b
            for j in range(a, b):
                heads[j] = head
        prev = [last_id, *ids[:-1]]
        begin = set(starts)
        # deliveries of one record are neighbours: same key, same id
        take = [j for j in range(n) if (ids[j] != heads[j] or j < opened) and (j in begin or ids[j] != prev[j])]
        if take:
            idx = pa.array(take)
            kinds = pa.array(["open" if j < opened else "member" for j in take], pa.string())
            yield rows(kinds, cols[0].take(idx), None, None, pa.array([heads[j] for j in take], pa.string()), cols[3].take(idx))
        last_id = ids[-1]
    if key is not None:
        if first_run:
            edge_out.append((*key, head))
        yield rows("first", edge_out[0][0], edge_out[0][1], edge_out[0][2], edge_out[0][3], pa.array([None], pa.string()))
        yield rows("last", key[0], key[1], key[2], head, pa.array([None], pa.string()))


def keyed_records(df: DataFrame, record_table: str, record_id: str, scope: str, text: str) -> DataFrame:
    """``rtable, scope, canon, id`` of every record with a text."""
    return df.filter(F.col(text).isNotNull()).select(
        F.lit(record_table).alias("rtable"), F.coalesce(norm_key(scope), F.lit("")).alias("scope"),
        canonical(F.col(text)).alias("canon"), F.col(record_id).cast("string").alias("id"))


def formatting_copies(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """``record_table, keep_id, copy_id``: each copy with the smallest id of its group.

    ``records`` has the columns of ``keyed_records``. ``partitions`` defaults to
    the session's number of shuffle partitions.
    """
    n = partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["rtable", "scope", "canon", "id"]
    # range partitioning reads its input twice; the canonical forms are made once
    scanned = materialise(records.select(order), "canonical").repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_scan, _SCAN)
    # both readers below must see the same partition edges, so the scan is written once
    scanned = materialise(scanned, "runs")
    edges = scanned.filter(F.col("kind").isin("first", "last"))
    heads = edges.groupBy("rtable", "scope", "canon").agg(F.min("head").alias("true_head"))
    # one row per partition: bounded by the number of partitions, whatever the data
    firsts = edges.filter(F.col("kind") == "first").join(heads, ["rtable", "scope", "canon"]).select("part", "true_head")
    opened = (scanned.filter(F.col("kind") == "open").join(F.broadcast(firsts), "part")
              .filter(F.col("id") != F.col("true_head"))
              .select(F.col("rtable").alias("record_table"), F.col("true_head").alias("keep_id"), F.col("id").alias("copy_id")))
    closed = scanned.filter(F.col("kind") == "member").select(
        F.col("rtable").alias("record_table"), F.col("head").alias("keep_id"), F.col("id").alias("copy_id"))
    # deliveries of one record are equal rows, which a range partitioning never separates
    return closed.unionByName(opened)


def collapsed(records: DataFrame, copies: DataFrame) -> DataFrame:
    """``record_table, keep_id, text, n_copies``: every text once, under the smallest id of its group, with its exact number of records.

    ``records`` has ``rtable, id, text``, ``copies`` is the result of ``formatting_copies``.
    """
    texts = records.groupBy(F.col("rtable").alias("record_table"), F.col("id").alias("keep_id")).agg(F.min("text").alias("text"))
    left = texts.join(copies.select("record_table", F.col("copy_id").alias("keep_id")), ["record_table", "keep_id"], "left_anti")
    return left.join(copy_counts(copies), ["record_table", "keep_id"], "left").select("record_table", "keep_id", "text", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def copy_counts(copies: DataFrame) -> DataFrame:
    """``record_table, keep_id, n_copies``: one representative per group with its exact number of records."""
    return copies.groupBy("record_table", "keep_id").agg((F.count("*") + 1).alias("n_copies"))
