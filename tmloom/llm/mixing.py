"""Mixing sources to target shares of tokens.

Method: documents are weighed in tokens of a public tokenizer and sorted into cells
of source, language and topic. Iterative proportional fitting rakes the tokens of
the cells to the marginals: the target shares of the sources, and the shares that
languages and topics have in the eligible corpus, unless others are given. A cell's
weight is the number of times its documents are read on average; a source is read
at most ``max_repeats`` whole times. A document gets the whole part of its weight,
and one copy more with the probability of the rest, drawn from a hash of its id; the
threshold of the draw is calibrated per source so that its tokens meet the target.

The total defaults to the largest at which every source that has documents can meet
its share within its repeats; with a larger ``total_tokens`` the sources that fall
short give all their passes and the others share the rest in proportion. The ceiling of
``max_repeats`` comes before the shares of languages and topics; how near these came is
reported (``marginals``).

Only counts per cell and a histogram per source reach the driver: at most (sources x
``LANGUAGES`` x ``TOPICS``) and (sources x ``BINS``) rows, and at most ``SOURCES`` sources
are taken. Languages beyond the most frequent ``LANGUAGES`` - 1 rake together as one. The
topic model is fitted on all eligible documents: its features are the token ids that the
weighing makes anyway, and every round of the k-means sums the features of all of them by
topic, in whole numbers, so that the order of the rows doesn't matter; only sums, at most
``TOPICS`` x ``TOPIC_DIM`` rows, reach the driver. The tokenizer's file is read on the driver
and goes to the executors with the job.

Defined cases: sources match without regard to letter case, blanks around and the
kind of separator; a null or unlisted source and a null or empty text take no part;
a null language is a language of its own; a target listed twice counts with its first
row; a listed source without documents gets nothing and its share is left out; a
repeated document row is a document of its own; no documents give no copies.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tmloom.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LANGUAGES = 16
TOPICS = 6
TOPIC_DIM = 512
#: tokens of lower ids, the first merges of the vocabulary, stand in texts of every topic
TOPIC_FROM = 2000
#: more sources than this are refused: their table is broadcast
SOURCES = 10_000
#: features are summed in whole numbers of this part
UNIT = 1 << 20
TOPIC_ROUNDS = 10
BINS = 4096
ROUNDS = 100


def source_key(c: Column) -> Column:
    """A source as compared: lower case, one underscore for any run of other characters."""
    k = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(k != "", k)


def load_tokenizer(raw: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(raw)
    tok.encode_special_tokens = True
    return tok


def token_ids(tok, texts: list[str]) -> list[list[int]]:
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    return [e.ids for s in range(0, len(texts), 256) for e in encode(texts[s:s + 256], add_special_tokens=False)]


def topic_features(ids: list[list[int]]) -> list[tuple[bytes, bytes]]:
    """Hashed bags of the rarer tokens, places and counts for each text."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((t for row in ids for t in row), np.int64, int(n.sum()))
    row = np.repeat(np.arange(len(ids)), n)
    keep = flat >= TOPIC_FROM
    at, count = np.unique(row[keep] * TOPIC_DIM + (flat[keep] * 2654435761 >> 7) % TOPIC_DIM, return_counts=True)
    cut = np.searchsorted(at, np.arange(1, len(ids)) * TOPIC_DIM)
    place, count = (at % TOPIC_DIM).astype(np.uint16), count.astype(np.uint32)
    return [(p.tobytes(), c.tobytes()) for p, c in zip(np.split(place, cut), np.split(count, cut))] if ids else []


def topics_of(places: pd.Series, counts: pd.Series, topics: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of the ``topics`` for each text (the first for one without rarer tokens); topic, place and value of all features, scaled to length one."""
    n = places.map(len).to_numpy(np.int64) // 2
    place, count = np.frombuffer(b"".join(places), np.uint16), np.frombuffer(b"".join(counts), np.uint32).astype(np.float64)
    full = np.flatnonzero(n)
    out = np.zeros(len(n), np.int32)
    if not len(full):
        return out, np.zeros(0, np.int32), place, count
    start = np.cumsum(n[full]) - n[full]
    value = count / np.repeat(np.sqrt(np.add.reduceat(count ** 2, start)), n[full])
    out[full] = np.add.reduceat(value[:, None] * topics.T[place], start, axis=0).argmax(1)
    return out, np.repeat(out, n), place, value


def fit_topics(features: DataFrame, k: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """Centroids of a spherical k-means over ``places, counts`` of all texts, begun from fixed directions."""
    c = np.random.default_rng(11).normal(size=(k, TOPIC_DIM))
    last = None
    for _ in range(rounds):
        def sums(batches: Iterator[pd.DataFrame], c: np.ndarray = c) -> Iterator[pd.DataFrame]:
            total = np.zeros(k * TOPIC_DIM, np.int64)
            for pdf in batches:
                _, topic, place, value = topics_of(pdf["places"], pdf["counts"], c)
                np.add.at(total, topic.astype(np.int64) * TOPIC_DIM + place, np.rint(value * UNIT).astype(np.int64))
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": at, "total": total[at]})

        total = np.zeros(k * TOPIC_DIM, np.int64)
        for r in features.select("places", "counts").mapInPandas(sums, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect():  # at most k x TOPIC_DIM rows
            total[r["at"]] = r["total"]
        if last is not None and (total == last).all():
            break
        last, means = total, total.reshape(k, TOPIC_DIM).astype(np.float64)
        used = means.any(1)
        c = c.copy()
        c[used] = means[used] / np.linalg.norm(means[used], axis=1, keepdims=True)
    return c


def weighed(documents: DataFrame, listed: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, lang, topic, tokens`` of the eligible documents: those of the ``listed`` sources with a text."""
    spark = documents.sparkSession
    names = spark.createDataFrame([(s,) for s in listed], "source string")
    docs = (documents.filter(F.col("text") != "").select("doc_id", source_key(F.col("source")).alias("source"),
                                                         F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), "text")
            .join(F.broadcast(names), "source", "left_semi"))  # at most SOURCES rows
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = load_tokenizer(shared.value)
        for pdf in batches:
            ids = token_ids(tok, pdf["text"].tolist())
            bags = topic_features(ids)
            yield pdf[["doc_id", "source", "lang"]].assign(tokens=[len(x) for x in ids], places=[p for p, _ in bags], counts=[c for _, c in bags])

    read = materialise(docs.select("doc_id", "source", "lang", "text").mapInPandas(tokenise, "doc_id long, source string, lang string, tokens long, places binary, counts binary"), "tokenised")
    topics = fit_topics(read)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "source", "lang"]].assign(topic=topics_of(pdf["places"], pdf["counts"], topics)[0], tokens=pdf["tokens"])

    return read.mapInPandas(label, "doc_id long, source string, lang string, topic int, tokens long")


def source_totals(available: np.ndarray, share: np.ndarray, repeats: np.ndarray, total: float | None) -> np.ndarray:
    """Tokens each source gives: its share of the total, or all its passes if those are fewer."""
    cap = available * repeats
    live = (cap > 0) & (share > 0)
    if not live.any():
        return np.zeros(len(cap))
    share = np.where(live, share, 0) / share[live].sum()
    if total is None:
        return share * (cap[live] / share[live]).min()
    out, full = np.zeros(len(cap)), ~live
    while True:
        rest = max(0.0, total - out[full].sum())
        out[~full] = share[~full] / share[~full].sum() * rest if (~full).any() else 0
        over = ~full & (out > cap)
        if not over.any():
            return out
        out[over] = cap[over]
        full |= over


def rake(tokens: np.ndarray, source: np.ndarray, lang: np.ndarray, topic: np.ndarray, want: np.ndarray, repeats: np.ndarray,
         lang_share: np.ndarray | None = None, topic_share: np.ndarray | None = None) -> np.ndarray:
    """Weights of the cells: copies of each document on average, by iterative proportional fitting."""
    w = np.ones(len(tokens))
    ceiling = repeats[source].astype(float)
    marginals = []
    for axis, given in ((lang, lang_share), (topic, topic_share)):
        natural = np.bincount(axis, tokens)
        marginals.append((axis, (natural / natural.sum() if given is None else given) * want.sum()))
    marginals.append((source, want))
    for _ in range(ROUNDS):
        for axis, goal in marginals:
            have = np.bincount(axis, w * tokens, minlength=len(goal))
            w = np.minimum(w * np.divide(goal, have, out=np.zeros_like(goal, dtype=float), where=have > 0)[axis], ceiling)
    # sources come last; what the ceiling cut off is made up within the source
    for _ in range(ROUNDS):
        have = np.bincount(source, w * tokens, minlength=len(want))
        if np.allclose(have, want, rtol=1e-9):
            break
        w = np.minimum(w * np.divide(want, have, out=np.zeros_like(have), where=have > 0)[source], ceiling)
    return w


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The copies of each document (``doc_id, source, tokens, copies``), and the report per source.

    The report has ``source, target_share, actual_share, available_tokens,
    used_tokens, documents, used_documents, copies, max_repeats``.
    """
    copies, report, _ = mix_with_marginals(documents, targets, total_tokens, tokenizer)
    return copies, report


def mix_with_marginals(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``mix`` and a third table ``axis, label, wanted_share, actual_share, used_tokens``: what was raked to, and what came out.

    ``axis`` is source, language or topic; languages that rake together have the label ``(others)``.
    """
    spark = documents.sparkSession
    goal: dict[str, tuple[float, int]] = {}
    for r in targets.select(source_key(F.col("source")).alias("s"), "target_share", "max_repeats").filter("s is not null and target_share is not null").limit(SOURCES + 1).collect():
        goal.setdefault(r.s, (max(0.0, float(r.target_share)), max(0, int(r.max_repeats or 0))))
    if len(goal) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    rows = materialise(weighed(documents, sorted(goal), tokenizer), "weighed")
    names = sorted(goal)
    place = {s: k for k, s in enumerate(names)}
    langs = [r.lang for r in rows.groupBy("lang").agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES - 1).collect()]
    lang_no = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in langs]).cast("array<string>"), F.col("lang")).cast("int"), F.lit(0))
    keyed = rows.select("doc_id", "source", "topic", "tokens", lang_no.alias("lang_no"))
    cells = keyed.groupBy("source", "lang_no", "topic").agg(F.sum("tokens").alias("n")).orderBy("source", "lang_no", "topic").collect()
    share, repeats = np.array([goal[s][0] for s in names]), np.array([goal[s][1] for s in names])
    column = lambda c, kind: np.array([getattr(x, c) for x in cells], kind)
    src, lang, topic, n = np.array([place[c.source] for c in cells], np.int64), column("lang_no", np.int64), column("topic", np.int64), column("n", float)
    have = np.bincount(src, n, minlength=len(names)) if cells else np.zeros(len(names))
    want = source_totals(have, share, repeats, total_tokens)
    w = rake(n, src, lang, topic, want, repeats) if cells else np.zeros(0)
    weights = spark.createDataFrame([(c.source, c.lang_no, c.topic, float(x)) for c, x in zip(cells, w)], "source string, lang_no int, topic int, weight double")
    # the draw: a document is taken once more if its number lies below the rest of its weight, times the source's calibration
    draw = F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << 30)) / float(1 << 30)
    drawn = keyed.join(F.broadcast(weights), ["source", "lang_no", "topic"]).select(  # at most SOURCES x LANGUAGES x TOPICS rows
        "doc_id", "source", "lang_no", "topic", "tokens", F.floor("weight").cast("int").alias("whole"), (F.col("weight") - F.floor("weight")).alias("rest"), draw.alias("u"))
    ratio = F.when(F.col("rest") > 0, F.least(F.floor(F.col("u") / F.col("rest") * (BINS // 4)), F.lit(BINS))).otherwise(F.lit(BINS)).cast("int")
    drawn = drawn.withColumn("bin", ratio)
    hist: dict[str, list] = {}
    for r in drawn.groupBy("source", "bin").agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * F.col("whole")).alias("base")).collect():
        hist.setdefault(r.source, []).append((r.bin, r.n, r.base))
    cut = []
    for k, s in enumerate(names):
        own = sorted(hist.get(s, []))
        used, best = sum(b for _, _, b in own), -1
        err = abs(used - want[k])
        for b, tokens, _ in own:
            if b >= BINS:
                break
            used += tokens
            if abs(used - want[k]) < err:
                best, err = b, abs(used - want[k])
        cut.append((s, best, *goal[s]))
    limits = spark.createDataFrame(cut, "source string, cut int, target_share double, max_repeats int")
    copies = (drawn.join(F.broadcast(limits), "source")  # at most SOURCES rows
              .select("doc_id", "source", "lang_no", "topic", "tokens", F.least(F.col("whole") + (F.col("bin") <= F.col("cut")).cast("int"), F.col("max_repeats")).alias("copies")))
    used = copies.groupBy("source").agg(
        F.sum("tokens").alias("available_tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("documents"),
        F.count_if(F.col("copies") > 0).alias("used_documents"), F.sum("copies").cast("bigint").alias("copies"))
    whole = Window.partitionBy(F.lit(0))  # over one row for each source, or each source, language and topic
    report = (limits.drop("cut").join(used, "source", "left").withColumn("total", F.sum("used_tokens").over(whole))
              .select("source", "target_share", F.round(F.coalesce(F.col("used_tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"),
                      *[F.coalesce(c, F.lit(0)).alias(c) for c in ("available_tokens", "used_tokens", "documents", "used_documents", "copies")], "max_repeats"))
    # what was raked to: the wanted shares of the sources, and the shares of languages and topics among the eligible tokens
    label = {"source": lambda k: names[k], "language": lambda k: langs[k - 1] if k else "(others)", "topic": str}
    wanted = []
    for axis, of, tokens in (("source", np.arange(len(names)), want), ("language", lang, n), ("topic", topic, n)):
        by = np.bincount(of, tokens) if len(of) else np.zeros(0)
        wanted += [(axis, int(k), label[axis](int(k)), float(by[k] / by.sum()) if by.sum() else 0.0) for k in sorted(set(of.tolist()))]
    numbered = copies.join(F.broadcast(spark.createDataFrame([(s, k) for s, k in place.items()], "source string, source_no int")), "source")
    by_axis = numbered.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).cast("int").alias("no")) for a, c in (("source", "source_no"), ("language", "lang_no"), ("topic", "topic"))])).alias("a"),
                              (F.col("tokens") * F.col("copies")).alias("t")).groupBy("a.axis", "a.no").agg(F.sum("t").alias("used"))
    marginals = (spark.createDataFrame(wanted, "axis string, no int, label string, wanted_share double").join(by_axis, ["axis", "no"], "left")
                 .withColumn("total", F.sum("used").over(Window.partitionBy("axis")))
                 .select("axis", "label", F.round("wanted_share", 6).alias("wanted_share"), F.round(F.coalesce(F.col("used") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"),
                         F.coalesce("used", F.lit(0)).alias("used_tokens")))
    return copies.filter(F.col("copies") > 0).select("doc_id", "source", "tokens", "copies"), report, marginals
