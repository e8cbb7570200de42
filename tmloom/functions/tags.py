"""Inline tags of segments: numbered pairs such as ``<1>…</1>`` and single ``<2/>``."""

from __future__ import annotations

import re

_TAG = re.compile(r"<(/?)(\d+)\s*(/?)>")


def repair(parts: list[str]) -> list[str]:
    """Parts of one text with tags closed at the end of a part and opened again in the next."""
    out, open_ = [], []
    for part in parts:
        text = "".join(f"<{t}>" for t in open_) + part
        for slash, t, single in _TAG.findall(part):
            if single:
                continue
            if not slash:
                open_.append(t)
            elif t in open_:
                del open_[len(open_) - 1 - open_[::-1].index(t)]
        out.append(text + "".join(f"</{t}>" for t in reversed(open_)))
    return out


def strip_wrappers(text: str, kinds: dict[str, str], keep_empty: tuple[str, ...] = ("footnote", "endnote", "comment"),
                   formatting: tuple[str, ...] = ("bold", "italic", "underline", "strike", "small_caps", "caps", "vertical", "color", "highlight", "size", "font", "link")) -> tuple[str, list[str]]:
    """The text without blank pairs and without pairs around all of it; those among the latter that carry formatting or a link are named."""
    wrappers = []
    while True:
        before = text
        text = re.sub(r"<(\d+)>(\s*)</\1>", lambda m: m.group() if kinds.get(m.group(1)) in keep_empty else m.group(2), text)
        m = re.fullmatch(r"(?s)\s*<(\d+)>(.*)</\1>\s*", text)
        if m and f"<{m.group(1)}>" not in m.group(2) and kinds.get(m.group(1)) not in keep_empty:
            text = m.group(2)
            if kinds.get(m.group(1)) in formatting:
                wrappers.append(m.group(1))
        if text == before:
            return text, wrappers


def merge_adjacent(text: str, same) -> str:
    """Neighbouring pairs of equal kind as one pair; ``same(a, b)`` compares two tag ids."""
    while True:
        m = next((m for m in re.finditer(r"</(\d+)><(\d+)>", text) if same(m.group(1), m.group(2))), None)
        if not m:
            return text
        a, b = m.group(1), m.group(2)
        text = text[:m.start()] + text[m.end():].replace(f"</{b}>", f"</{a}>", 1)


def drop_defaults(text: str, kinds: dict[str, str], values: dict[str, str], of: tuple[str, ...] = ("font", "size"), share: float = 0.95) -> str:
    """The text without the tags of a font or size that nearly all its letters and digits have."""
    total = sum(ch.isalnum() for ch in _TAG.sub("", text))
    covered: dict[tuple[str, str], int] = {}
    open_: list[str] = []
    at = 0
    for m in [*_TAG.finditer(text), None]:
        n = sum(ch.isalnum() for ch in (text[at:m.start()] if m else text[at:]))
        for t in {(kinds.get(t), values.get(t)) for t in open_}:
            covered[t] = covered.get(t, 0) + n
        if m:
            at = m.end()
            if not m.group(1) and not m.group(3):
                open_.append(m.group(2))
            elif m.group(1) and m.group(2) in open_:
                open_.remove(m.group(2))
    usual = {k for k, n in covered.items() if k[0] in of and total and n >= share * total}
    gone = {t for t in kinds if (kinds[t], values.get(t)) in usual}
    return _TAG.sub(lambda m: "" if m.group(2) in gone else m.group(), text)


def merged(parts: list[tuple[str, dict]], note_kinds: tuple[str, ...] = ("footnote", "endnote", "comment", "shape")) -> tuple[str, dict]:
    """The parts of a paragraph as one tagged text again, with the tags of all.

    ``parts`` are (text, tags); ``tags`` may hold ``wrappers``, ``space`` (before and after)
    and ``source``, the text before translation. Notes that a translation lost stand at its
    end if they stood in the second half of the source, else at its beginning.
    """
    out, known = [], {}
    for text, info in parts:
        marks = {n: t for n, t in info.items() if isinstance(t, dict)}
        known |= marks
        source = info.get("source") or ""
        for m in _TAG.finditer(source):
            n = m.group(2)
            if m.group(3) and marks.get(n, {}).get("type") in note_kinds and not re.search(rf"<{n}\s*/>", text):
                text = text + f"<{n}/>" if m.start() * 2 > len(source) else f"<{n}/>" + text
        for n in reversed(info.get("wrappers", ())):
            text = f"<{n}>{text}</{n}>"
        before, after = info.get("space", ("", ""))
        out.append(before + text + after)
    return re.sub(r"</(\d+)><\1>", "", "".join(out)), known


def shown(text: str) -> str:
    """Neighbouring opening tags, and closing tags, as one: ``<1><2>`` becomes ``<1,2>``."""
    for slash in ("", "/"):
        pattern = re.compile(rf"<{slash}([\d,]+)><{slash}([\d,]+)>")
        while pattern.search(text):
            text = pattern.sub(rf"<{slash}\1,\2>", text)
    return text


def label(ids: list[int]) -> str:
    """Tag ids as shown: runs of three or more as a range."""
    out, run = [], []
    for n in [*sorted(set(ids)), None]:
        if run and (n is None or n != run[-1] + 1):
            out += [f"{run[0]}-{run[-1]}"] if len(run) > 2 else [str(x) for x in run]
            run = []
        if n is not None:
            run.append(n)
    return ",".join(out)


def compress(text: str, first: int = 900) -> tuple[str, dict[str, str]]:
    """Runs of neighbouring tags as single tags with high numbers, and what they stand for."""
    known: dict[str, str] = {}

    def swap(m: re.Match) -> str:
        name = str(first + len(known))
        known[name] = m.group()
        return f"<{name}/>"

    return re.sub(r"(?:</?\d+\s*/?>){2,}", swap, text), known


def decompress(text: str, known: dict[str, str], first: int = 900) -> str:
    """The inverse of ``compress``; unknown high numbers vanish."""
    return re.sub(r"<(\d+)/>", lambda m: known.get(m.group(1), "" if int(m.group(1)) >= first else m.group()), text)


def balanced(text: str) -> bool:
    """Whether every opened tag is closed in order."""
    stack = []
    for slash, t, single in _TAG.findall(text):
        if single:
            continue
        if not slash:
            stack.append(t)
        elif not stack or stack.pop() != t:
            return False
    return not stack


def accepted(source: str, reply: str | None) -> str | None:
    """A text that tags were put back into, if it has all tags of the source and is balanced; else null."""
    ids = lambda t: {(slash, n, single) for slash, n, single in _TAG.findall(t)}
    return reply if reply and ids(source) <= ids(reply) and balanced(reply) else None
