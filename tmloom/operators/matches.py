"""Lists of translation matches held in a segment's metadata, worked on in place.

A row's list is as long as the retrieval kept (a handful), so higher-order functions
over it need no shuffle.

Defined cases: unreadable metadata gives no row; a single object is a list of one;
null entries are dropped and the places of the others kept; a null score counts as 0;
equal scores keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tmloom.operators.dates import readable_json


def match_lists(segments: DataFrame) -> DataFrame:
    """``id, matches``: array of ``pos, match_id, kind, filename, content, score, raw``."""
    v = (segments.filter(F.col("metadata_json").contains("context_matches")).select("id", "metadata_json").distinct()
         .select("id", F.try_variant_get(readable_json(F.col("metadata_json")), "$.context_matches", "variant").alias("m")))
    items = F.coalesce(F.try_variant_get("m", "$", "array<variant>"), F.when(F.schema_of_variant("m").startswith("OBJECT"), F.array("m")))
    get = lambda x, f, t: F.try_variant_get(x, f"$.{f}", t)
    rows = F.transform(items, lambda x, i: F.when(x.isNotNull() & ~F.is_variant_null(x), F.struct(
        i.alias("pos"), get(x, "id", "string").alias("match_id"), get(x, "type", "string").alias("kind"), get(x, "filename", "string").alias("filename"),
        get(x, "content", "string").alias("content"), F.coalesce(get(x, "score", "int"), F.lit(0)).alias("score"), get(x, "raw_logit", "double").alias("raw"))))
    return v.select("id", F.array_compact(rows).alias("matches")).filter("matches is not null")


def by_score(matches: Column) -> Column:
    """Highest score first, equal scores in their order."""
    return F.transform(F.array_sort(F.transform(matches, lambda m: F.struct((-m["score"]).alias("s"), m["pos"].alias("p"), m.alias("m")))), lambda x: x["m"])


def display_order(matches: Column) -> Column:
    """Machine translations first, then by score."""
    return F.transform(F.array_sort(F.transform(matches, lambda m: F.struct(
        F.when(m["kind"] == "mt", 0).otherwise(1).alias("k"), (-m["score"]).alias("s"), m["pos"].alias("p"), m.alias("m")))), lambda x: x["m"])


def visible(matches: Column, mandatory: int = 60, internal: int = 90, optional: int = 40) -> Column:
    """Matches whose score reaches the threshold of their kind; glossary never, machine translation always."""
    least = lambda k: F.when(k == "mandatory", mandatory).when(k == "internal", internal).otherwise(optional)
    return F.filter(matches, lambda m: (m["kind"] != "glossary") & ((m["kind"] == "mt") | (m["score"] >= least(m["kind"]))))


def prompt_matches(matches: Column, n: int = 3) -> Column:
    """Of the first ``n`` matches those that are neither glossary nor history nor exact."""
    return F.filter(F.slice(matches, 1, n), lambda m: ~m["kind"].isin("glossary", "history") & (m["score"] < 100))


def first_of(matches: Column, test) -> Column:
    """The first match that passes, or null."""
    return F.get(F.filter(matches, test), F.lit(0))


def replaced(old: Column, fresh: Column) -> Column:
    """The old machine translations, followed by the fresh matches."""
    return F.concat(F.filter(old, lambda m: m["kind"] == "mt"), fresh)


def with_variant(old: Column, fresh: Column, variant: str) -> Column:
    """``old`` with the machine translation of one variant (before or after changes) replaced; those of other variants and all else stay."""
    return F.concat(F.filter(old, lambda m: ~((m["kind"] == "mt") & m["variant"].eqNullSafe(F.lit(variant)))), fresh)


def shortcuts(matches: Column) -> Column:
    """What the keys of an editor insert: the first and second machine translation (else the first match), and the first three others."""
    mt, other = F.filter(matches, lambda m: m["kind"] == "mt"), F.filter(matches, lambda m: m["kind"] != "mt")
    at = lambda c, n: F.get(c, F.lit(n))["match_id"]
    return F.struct(F.coalesce(at(mt, 0), at(matches, 0)).alias("first_mt"), at(mt, 1).alias("second_mt"), *[at(other, n).alias(f"other_{n + 1}") for n in range(3)])
