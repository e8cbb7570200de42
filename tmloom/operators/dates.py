"""Normalised instants of draft requests and of document revisions.

Defined cases: unreadable or cut-off JSON gives no revisions; JSON text that
encodes JSON once more is read; a byte-order mark before the text is ignored; a
single object stands for a list of one; null entries and entries without a date
keep their place and give no row; deliveries of one record give one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tmloom.functions.instants import with_instant


#: text that encodes JSON is unwrapped so many times at most
UNWRAPS = 8


def readable_json(c: Column) -> Column:
    """The text of a JSON document as a variant: unwrapped if it is a string of JSON, null if unreadable."""
    bare = lambda x: F.regexp_replace(x, r"^\x{FEFF}+", "")
    inner = lambda t, _: F.when(F.substring(F.ltrim(t), 1, 1) == '"', bare(F.try_variant_get(F.try_parse_json(t), "$", "string"))).otherwise(t)
    return F.try_parse_json(F.aggregate(F.array_repeat(F.lit(0), UNWRAPS), bare(c), inner))


def revision_dates(segments: DataFrame) -> DataFrame:
    """``origin, record_id, pos, text, zone, locale`` of every dated revision and stage.

    Only texts that mention revisions at all are parsed, and only the two lists
    leave the parser.
    """
    meta = (segments.filter(F.col("metadata_json").contains("revision"))
            .select(F.col("id").cast("string").alias("record_id"), readable_json(F.col("metadata_json")).alias("v"))
            .select("record_id",
                    F.try_variant_get("v", "$.metadata.doc_tz", "string").alias("zone"),
                    F.try_variant_get("v", "$.metadata.doc_locale", "string").alias("locale"),
                    F.try_variant_get("v", "$.metadata.revisions", "variant").alias("r"),
                    F.try_variant_get("v", "$.metadata.revision_stages", "variant").alias("s")))
    pick = lambda c: F.coalesce(  # noqa: E731  a list, or a single object as a list of one
        F.try_variant_get(c, "$", "array<variant>"),
        F.when(F.schema_of_variant(F.col(c)).startswith("OBJECT"), F.array(F.col(c))))
    both = meta.select("record_id", "zone", "locale", F.explode(F.array(
        F.struct(F.lit("revision").alias("origin"), pick("r").alias("items")),
        F.struct(F.lit("stage").alias("origin"), pick("s").alias("items")))).alias("x"))
    return (both.filter(F.col("x.items").isNotNull())
            .select("record_id", "zone", "locale", F.col("x.origin").alias("origin"), F.posexplode("x.items").alias("pos", "item"))
            .select("origin", "record_id", F.col("pos").cast("bigint").alias("pos"),
                    F.try_variant_get("item", "$.date", "string").alias("text"), "zone", "locale")
            .filter(F.col("text").isNotNull()))


def request_dates(requests: DataFrame) -> DataFrame:
    """``origin, record_id, pos, text, zone, locale`` of every dated draft request."""
    return requests.filter(F.col("tc_date").isNotNull()).select(
        F.lit("tc_request").alias("origin"), F.col("request_id").cast("string").alias("record_id"), F.lit(0).cast("bigint").alias("pos"),
        F.col("tc_date").alias("text"), F.col("client_tz").alias("zone"), F.col("client_locale").alias("locale"))


def normalised_dates(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """``origin, record_id, pos, utc_us`` wherever the record fixes one instant."""
    both = request_dates(requests).unionByName(revision_dates(segments))
    # the filter stands behind the aggregate: pushed into the projections it would repeat their expressions
    return (with_instant(both, "text", "zone", "locale").groupBy("origin", "record_id", "pos")
            .agg(F.min("utc_us").alias("utc_us")).filter(F.col("utc_us").isNotNull()))
