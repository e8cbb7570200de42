"""Batched calls of a text model from the executors, with a deterministic stand-in.

A model is a function from a list of (id, text) to a reply text. Rows go to it in
batches; what a reply lacks is asked for again in halves, a transient failure after a
pause; a row that never gets an answer comes back with an error. ``sequential`` feeds
each result to the next row of its group.

Defined cases: null texts are not sent; a quota error stops the job; answers for
unknown ids are ignored.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tmloom.functions.replies import parsed

Model = Callable[[list[tuple[str, str]]], str]
SCHEMA = "id string, output string, error string"


class QuotaExceeded(RuntimeError):
    """The model refuses any further call."""


def echo(batch: list[tuple[str, str]]) -> str:
    """The deterministic stand-in: each text with the target language before it."""
    return json.dumps({i: f"DE: {t}" for i, t in batch}, ensure_ascii=False)


def ask(model: Model, batch: list[tuple[str, str]], tries: int = 3, pause: float = 1.0, depth: int = 5) -> dict[str, str]:
    """The answers of a batch; missing ones are asked for in halves, at most ``depth`` deep."""
    reply = None
    for n in range(tries):
        try:
            reply = model(batch)
            break
        except QuotaExceeded:
            raise
        except Exception:
            if n + 1 == tries:
                return {}
            time.sleep(pause * 2 ** n)
    got = parsed(reply, [i for i, _ in batch])
    missing = [x for x in batch if x[0] not in got]
    if missing and depth > 0 and len(batch) > 1:
        half = max(1, len(missing) // 2)
        for part in (missing[:half], missing[half:]):
            if part:
                got |= ask(model, part, tries, pause, depth - 1)
    return got


def generated(df: DataFrame, model: Model = echo, size: int = 15, pause: float = 1.0) -> DataFrame:
    """``id, output, error`` for the rows of ``df`` (``id``, ``text``), batch by batch within a partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(zip(pdf["id"], pdf["text"]))
            out = []
            for s in range(0, len(rows), size):
                part = rows[s:s + size]
                got = ask(model, part, pause=pause)
                out += [(i, got.get(i), None if i in got else "no answer") for i, _ in part]
            yield pd.DataFrame(out, columns=["id", "output", "error"]).astype(object)

    return df.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text").mapInPandas(run, SCHEMA)


def sequential(df: DataFrame, step: Callable[[str, list[tuple[str, str]]], str], memory: int = 5) -> DataFrame:
    """``id, output``: the rows of a group in order, each seeing the last ``memory`` results.

    ``df`` has ``group, idx, id, text``. A text that a group has several times is answered
    once. The order is serial by nature, so a group's rows pass through one task; they are
    sorted outside memory and stream through it, and only the last results and the answers to
    repeated texts are held.
    """
    rows = df.filter("group is not null and idx is not null and text is not null").select("group", "idx", "id", "text")
    often = rows.groupBy("group", "text").agg((F.count("*") > 1).alias("again"))
    placed = rows.join(often, ["group", "text"]).repartition("group").sortWithinPartitions("group", "idx", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, done, seen = None, [], {}
        for pdf in batches:
            out = []
            for g, i, t, again in pdf[["group", "id", "text", "again"]].itertuples(index=False):
                if g != group:
                    group, done, seen = g, [], {}
                answer = seen.get(t) if again else None
                if answer is None:
                    answer = step(t, list(done))
                    if again:
                        seen[t] = answer
                done = [*done, (t, answer)][-memory:]
                out.append((i, answer))
            yield pd.DataFrame(out, columns=["id", "output"])

    return placed.mapInPandas(run, "id string, output string")
