"""Named queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tmloom.llm.alignment import align, filled_segments
from tmloom.llm.encodings import affected, repair
from tmloom.llm.eval_leaks import eval_leaks
from tmloom.llm.formatting_copies import collapsed, copy_counts, formatting_copies, keyed_records
from tmloom.llm.mixing import mix, mix_with_marginals
from tmloom.llm.neighbours import nearest, similar_pairs, usable
from tmloom.llm.oracles import ORACLES
from tmloom.session import materialise, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return align(table(spark, d, "context_chunks")).select(
        F.col("file").alias("file_id"), F.col("i").alias("source_index"), F.col("j").alias("target_index"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Both sentences of every link with the score and type computed anew."""
    chunks = table(spark, d, "context_chunks")
    return filled_segments(chunks, materialise(align(chunks), "alignment"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    records = keyed_records(table(spark, d, "segments"), "segments", "id", "project_id", "source_content").unionByName(
        keyed_records(table(spark, d, "translation_units"), "translation_units", "id", "project_id", "source_text"))
    return formatting_copies(records)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return copy_counts(p2_found(spark, d))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record for every text, with its number of copies."""
    texts = [table(spark, d, t).filter(F.col(c).isNotNull()).select(F.lit(t).alias("rtable"), F.col("id").cast("string").alias("id"), F.col(c).alias("text"))
             for t, c in (("segments", "source_content"), ("translation_units", "source_text"))]
    return collapsed(texts[0].unionByName(texts[1]), materialise(p2_found(spark, d), "copies"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 3 nearest chunks of every chunk at a cosine of at least 0.85, which is given to four digits."""
    near = nearest(materialise(usable(table(spark, d, "context_chunks"), "id", "embedding", 64), "vectors"), k=3, min_cosine=0.85)
    return near.withColumn("cosine", F.round("cosine", 4))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(p5_neighbours(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_similar(spark, d).filter("verbatim").select("doc_id", "item_id")


def p7_similar(spark: SparkSession, d: str) -> DataFrame:
    """All documents with windows like those of an item, verbatim or not."""
    return eval_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with their number of copies."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of the sources, languages and topics."""
    return mix_with_marginals(table(spark, d, "documents"), table(spark, d, "mix_targets"))[2]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return affected(table(spark, d, "documents"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return repair(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_counts, p2_collapsed, p5_found, p5_neighbours, p7_found, p7_similar, p8_shares, p8_mix, p8_marginals, p9_found, p9_restored)}

__all__ = ["ORACLES", "QUERIES"]
