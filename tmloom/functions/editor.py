"""Editor markup to tagged text and back."""

from __future__ import annotations

import html
import re

_KEEP = re.compile(r"</?\d+\s*/?>")


def from_html(text: str) -> str:
    """Editor HTML as tagged text: paragraphs become line breaks, other elements vanish, entities are decoded."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m.group())
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r'<span[^>]*data-tag="(\d+)"[^>]*>(.*?)</span>', r"<\1>\2</\1>", text, flags=re.S)
    text = _KEEP.sub(hide, text)
    text = re.sub(r"</p>\s*<p[^>]*>", "\n", text)
    text = re.sub(r"<br\s*/?>", "\n", text)
    text = re.sub(r"<[^>]+>", "", text)
    text = html.unescape(text).replace("\xa0", " ")
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], text).strip()


def to_html(text: str) -> str:
    """Tagged text as editor HTML; the inverse of ``from_html`` for balanced tags."""
    parts = re.split(r"(</?\d+>)", text)
    out = []
    for part in parts:
        m = re.fullmatch(r"<(/?)(\d+)>", part)
        out.append(("</span>" if m.group(1) else f'<span data-tag="{m.group(2)}">') if m else html.escape(part, quote=False).replace("\n", "</p><p>"))
    return "<p>" + "".join(out) + "</p>"


def highlighted(text: str, terms: list[str], mark: str = "mark") -> str:
    """The first whole-word occurrence of each term marked, longest term first, never inside a tag or another mark."""
    parts: list[tuple[str, bool]] = [(p, bool(_KEEP.fullmatch(p))) for p in re.split(r"(</?\d+\s*/?>)", text)]
    for term in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)):
        find = re.compile(rf"(?<!\w){re.escape(term)}(?!\w)", re.I)
        for k, (part, fixed) in enumerate(parts):
            m = None if fixed else find.search(part)
            if m:
                parts[k:k + 1] = [(part[:m.start()], False), (f"<{mark}>{m.group()}</{mark}>", True), (part[m.end():], False)]
                break
    return "".join(p for p, _ in parts)
