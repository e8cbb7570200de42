"""Replies of text models: prompts in, structured answers out."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_PAIR = re.compile(r'"([^"\\]+)"\s*:\s*"((?:[^"\\]|\\.)*)"')


#: a string whose end is a quote before a sign of structure, or one that is cut off; or any other character
_LEXEME = re.compile(r'"((?:[^"\\]|\\.|"(?!\s*(?:[,:}\]]|$)))*)("|$)|([{}\[\]])|([^"{}\[\]]+)', re.S)
_CLOSING = {"{": "}", "[": "]"}


def repaired(text: str) -> str:
    """JSON text with bare line breaks and quotes in strings escaped, and cut-off ends closed."""
    out, due = [], []
    for m in _LEXEME.finditer(text):
        body, end, bracket, other = m.groups()
        if bracket:
            if bracket in _CLOSING:
                due.append(_CLOSING[bracket])
            elif due:
                due.pop()
            out.append(bracket)
        elif other is not None:
            out.append(other)
        else:
            inner = re.sub(r'\\.|"', lambda q: q.group() if len(q.group()) > 1 else '\\"', body or "", flags=re.S)
            out.append('"' + inner.translate({10: "\\n", 13: "\\r", 9: "\\t"}) + '"')
    whole = re.sub(r",\s*$", "", "".join(out)) + "".join(reversed(due))
    return re.sub(r",(\s*[}\]])", r"\1", whole)


# fixed values: what the fields of an answer are called
_ID_FIELDS = ("id", "segment_id")
_TEXT_FIELDS = ("target", "translation", "target_text", "text")


def _answers(found) -> Iterator[tuple[str, str]]:
    """Pairs of id and text of a parsed reply: a map, a list of objects with their id, or either under one name."""
    if isinstance(found, list):
        for x in found:
            if isinstance(x, dict):
                key = next((x[f] for f in _ID_FIELDS if f in x), None)
                text = next((x[f] for f in _TEXT_FIELDS if isinstance(x.get(f), str)), None)
                if key is not None and text is not None:
                    yield str(key), text
    elif isinstance(found, dict):
        if any(f in found for f in _ID_FIELDS):
            yield from _answers([found])
        for k, v in found.items():
            if isinstance(v, str):
                yield str(k), v
            elif isinstance(v, (list, dict)):
                yield from _answers(v)


def parsed(reply: str | None, ids: list[str]) -> dict[str, str]:
    """The answers by id: fenced or outer JSON, repaired if need be, else pairs, else plain text for one id."""
    if not reply:
        return {}
    fence = _FENCE.search(reply)
    body = (fence.group(1) if fence else reply).strip()
    lo = min((k for k in (body.find("{"), body.find("[")) if k >= 0), default=-1)
    hi = max(body.rfind("}"), body.rfind("]"))
    for cand in ([body[lo:hi + 1]] if 0 <= lo < hi else []) + ([body[lo:]] if lo >= 0 else []):
        for text in (cand, repaired(cand)):
            try:
                found = json.loads(text, strict=False)
            except ValueError:
                continue
            got = {k: v for k, v in _answers(found) if k in ids}
            if got:
                return got
    got = {k: json.loads(f'"{v}"', strict=False) for k, v in _PAIR.findall(body) if k in ids}
    if got:
        return got
    return {ids[0]: body} if len(ids) == 1 and "{" not in body else {}


def prompt(source: Column, matches: Column, terms: Column, preceding: Column, style: str = "") -> Column:
    """The prompt of a segment: style, at most three matches, the terms and the sentence before."""
    block = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(title + ":\n"), F.array_join(items, "\n")))
    return F.concat_ws("\n\n", F.lit(style) if style else F.lit(None).cast("string"), block("Matches", F.slice(matches, 1, 3)), block("Terms", terms),
                       F.when(preceding != "", F.concat(F.lit("Before: "), preceding)), F.concat(F.lit("Text: "), source))
