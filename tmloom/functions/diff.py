"""Word differences and insert/delete markup."""

from __future__ import annotations

import difflib
import itertools
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_TOKEN = re.compile(r"\S+|\s+")


def opcodes(old: str, new: str) -> Iterable[tuple[str, str, str]]:
    """``(operation, old words, new words)`` of a word difference."""
    a, b = _TOKEN.findall(old), _TOKEN.findall(new)
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        yield op, "".join(a[i1:i2]), "".join(b[j1:j2])


def attr(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def markup(old: str | None, new: str | None, author: str = "", date: str = "") -> str:
    """The new text with what changed marked: deletions first, then insertions."""
    marks = "".join(f' {k}="{attr(v)}"' for k, v in (("author", author), ("date", date)) if v)
    out = []
    for op, gone, come in opcodes(old or "", new or ""):
        if op == "equal":
            out.append(gone)
            continue
        if gone:
            out.append(f"<del{marks}>{gone}</del>")
        if come:
            out.append(f"<ins{marks}>{come}</ins>")
    return "".join(out)


_PART = re.compile(r"(?s)<(ins|del)\b[^>]*>(.*?)</\1>")


def side(text: str, new: bool) -> str:
    """The old or the new text of a markup."""
    return _PART.sub(lambda m: m.group(2) if (m.group(1) == "ins") == new else "", text)


def accumulate(stages: list[tuple[str, str, str]]) -> str:
    """One document of several authors' changes in turn.

    ``stages`` are (text, author, date), the base first. Every word that ever stood in the
    text has a stage it came in with and, it may be, a stage it went out with. The words that
    are there before a stage are compared with its text: what is gone goes out with this
    stage, and what is new comes in behind the last word before it. A word that came in and
    went out has its insertion mark inside the deletion mark.
    """
    if not stages:
        return ""
    words = [(w, 0) for w in _TOKEN.findall(stages[0][0] or "")]
    came, gone = [0] * len(words), {}
    order = list(range(len(words)))  # all words ever, by number, in the order of the document
    for n, (text, _, _) in enumerate(stages[1:], 1):
        alive = [k for k in order if k not in gone]
        fresh = _TOKEN.findall(text or "")
        behind: dict[int, list[int]] = {}
        for op, a, b, c, d in difflib.SequenceMatcher(None, [words[k][0] for k in alive], fresh).get_opcodes():
            if op == "equal":
                continue
            gone |= dict.fromkeys(alive[a:b], n)
            anchor = alive[b - 1] if b else -1
            for w in fresh[c:d]:
                behind.setdefault(anchor, []).append(len(words))
                words.append((w, n))
                came.append(n)
        order = behind.get(-1, []) + [x for k in order for x in (k, *behind.get(k, ()))]
    mark = lambda tag, n, t: f'<{tag} author="{attr(stages[n][1] or "")}" date="{attr(stages[n][2] or "")}">{t}</{tag}>' if n else t
    out = []
    for (inside, outside), run in itertools.groupby(order, key=lambda k: (came[k], gone.get(k, 0))):
        out.append(mark("del", outside, mark("ins", inside, "".join(words[k][0] for k in run))))
    return "".join(out)


def letter_changes(old: str | None, new: str | None) -> str | None:
    """What changed letter by letter as HTML; null if nothing did. Equal runs of under three letters between changes are part of these."""
    a, b = old or "", new or ""
    if a == b:
        return None
    steps: list[list[str]] = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        kept = op == "equal" and (j - i > 2 or i == 0 or j == len(a))
        if kept or not steps or steps[-1][0] == "equal":
            steps.append(["equal" if kept else "change", a[i:j], b[k:m]])
        else:
            steps[-1][1] += a[i:j]
            steps[-1][2] += b[k:m]
    part = lambda tag, t: f"<{tag}>{attr(t)}</{tag}>" if t else ""
    return "".join(attr(x) if op == "equal" else part("del", x) + part("ins", y) for op, x, y in steps)


def attributes(c: Column) -> Column:
    """The attributes of an insert or delete mark as a map, entities resolved."""
    from tmloom.functions.text import unescaped

    value = lambda n: F.regexp_extract_all(c, F.lit(r'([A-Za-z_-]+)="([^"]*)"'), F.lit(n))
    return F.map_from_arrays(value(1), F.transform(value(2), unescaped))


def _markups(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None and b is None else markup(a, b) for a, b in zip(old, new)], dtype=object)


def change_markup(old: Column, new: Column) -> Column:
    return pandas_udf(_markups, StringType())(old, new)


def _accumulated(stages: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else accumulate([(x["text"], x["author"], x["date"]) for x in s]) for s in stages], dtype=object)


def accumulated(stages: Column) -> Column:
    """Of an array of structs ``text, author, date``."""
    return pandas_udf(_accumulated, StringType())(stages)


def annotated(c: Column, author: str, date: str) -> Column:
    """Plain ins and del marks with the author and date of the change."""
    return F.regexp_replace(c, r"<(ins|del)>", f'<$1 author="{attr(author)}" date="{attr(date)}">')
