"""Structural index of a batch of JSON texts, with NumPy over the whole batch.

All texts of a batch stand in one byte buffer. A lookup table marks the bytes
that can carry structure; escaped quotes are dropped; the running count of quotes
tells which brackets, colons and commas lie inside strings; the running sum of
brackets gives the nesting depth; the last open bracket of each depth gives every
token its container. No text is walked byte by byte in Python.
"""

from __future__ import annotations

import json

import numpy as np

QUOTE, OBJ, OBJ_END, ARR, ARR_END, COLON, COMMA = range(1, 8)
_CLASS = np.zeros(256, np.uint8)
for _ch, _k in zip(b'"{}[]:,', range(1, 8)):
    _CLASS[_ch] = _k
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
_SCALAR = np.zeros(256, bool)
_SCALAR[list(b"0123456789+-.eEtrufalsn")] = True

# what may stand between two neighbouring tokens: 0 nothing may follow, 1 blanks only, 2 blanks or one scalar, 3 one scalar
# rows: the first token (QUOTE here a closing quote of a value; 8 a closing quote of a key; 9 an opening quote)
_NEXT = np.zeros((8, 8), np.uint8)
_NEXT[OBJ, [QUOTE, OBJ_END]] = 1
_NEXT[ARR, [QUOTE, OBJ, ARR]] = 1
_NEXT[ARR, ARR_END] = 2
_NEXT[ARR, COMMA] = 3
_NEXT[COLON, [QUOTE, OBJ, ARR]] = 1
_NEXT[COLON, [COMMA, OBJ_END]] = 3
for _close in (QUOTE, OBJ_END, ARR_END):
    _NEXT[_close, [COMMA, OBJ_END, ARR_END]] = 1
_NEXT[COMMA, [QUOTE, OBJ, ARR]] = 1
_NEXT[COMMA, [COMMA, ARR_END]] = 3


class JsonIndex:
    """Tokens of a batch of texts; ``ok`` tells which texts are well-formed objects.

    ``kind, pos, row, depth`` describe the tokens (a string is its two quotes);
    ``depth`` of a bracket is that inside it; ``inside[d]`` gives each token the
    open bracket of depth ``d`` it stands in (only for depths up to ``levels``).
    """

    def __init__(self, texts: list[bytes], levels: int = 6):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, self.n)
        self.start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.end = self.start + lengths
        self.levels = levels
        self._tokens()
        self._depths()
        self._validate()

    def _tokens(self) -> None:
        cls = _CLASS[self.buf]
        pos = np.flatnonzero(cls)
        kind = cls[pos]
        slashes = np.flatnonzero(self.buf == 92)
        self.slashes = np.concatenate([[0], np.cumsum(self.buf == 92)])
        if slashes.size:  # a quote after an odd run of backslashes is escaped
            new = np.concatenate([[True], np.diff(slashes) > 1])
            first = slashes[np.flatnonzero(new)][np.cumsum(new) - 1]
            odd = slashes[((slashes - first) & 1) == 0]
            escaped = np.zeros(self.buf.size + 1, bool)
            escaped[odd + 1] = True
            keep = ~((kind == QUOTE) & escaped[pos])
            pos, kind = pos[keep], kind[keep]
        row = np.searchsorted(self.start, pos, "right") - 1
        quote = kind == QUOTE
        before = np.cumsum(quote) - quote
        at = np.searchsorted(row, np.arange(self.n))
        base = np.concatenate([before, [quote.sum()]])[at] if pos.size else np.zeros(self.n, np.int64)
        parity = (before - base[row]) & 1 if pos.size else before
        self.even = np.bincount(row[quote], minlength=self.n) % 2 == 0 if pos.size else np.ones(self.n, bool)
        keep = quote | (parity == 0)
        self.pos, self.kind, self.row = pos[keep], kind[keep], row[keep]
        self.opening = (quote & (parity == 0))[keep]

    def _depths(self) -> None:
        m = self.pos.size
        up = (self.kind == OBJ) | (self.kind == ARR)
        down = (self.kind == OBJ_END) | (self.kind == ARR_END)
        total = np.cumsum(up.astype(np.int32) - down)
        self.first = np.searchsorted(self.row, np.arange(self.n + 1))
        base = np.concatenate([[0], total])[self.first[:-1]] if m else np.zeros(self.n, np.int32)
        self.depth = total - base[self.row] + down if m else total  # a closing bracket has the depth of its opening one
        self.up, self.down = up, down
        order = np.arange(m)
        self.inside = [np.full(m, -1)]
        for d in range(1, self.levels + 1):
            self.inside.append(np.maximum.accumulate(np.where(up & (self.depth == d), order, -1)) if m else order)

    def _validate(self) -> None:
        """``ok``: balanced, and every pair of neighbouring tokens and the gap between them allowed."""
        m = self.pos.size
        count = np.diff(self.first)
        ok = (count > 0) & self.even
        self.ok = ok
        self.close = np.full(m, -1)
        if not m:
            return
        f, last = np.minimum(self.first[:-1], m - 1), np.maximum(self.first[1:] - 1, 0)
        ok &= (self.kind[f] == OBJ) & (self.kind[last] == OBJ_END) & (self.depth[last] == 1)
        bad = np.zeros(self.n, bool)
        bad[self.row[self.depth < 1]] = True
        # the root closes only at the end
        early = self.down & (self.depth == 1)
        early[last] = False
        bad[self.row[early]] = True
        count_of = lambda mask: np.bincount(self.row[mask], minlength=self.n)
        bad |= count_of(self.up) != count_of(self.down)
        # in a balanced text the brackets of one depth alternate, so neighbours in that order are pairs
        br = np.flatnonzero((self.up | self.down) & ~bad[self.row])
        order = br[np.lexsort((br, self.depth[br], self.row[br]))]
        o, c = order[0::2], order[1::2]
        self.close[o] = c
        bad[self.row[o[self.kind[c] != self.kind[o] + 1]]] = True
        blank = np.concatenate([[0], np.cumsum(~_BLANK[self.buf])])
        scalar = np.concatenate([[0], np.cumsum(~(_BLANK | _SCALAR)[self.buf])])
        a, b = np.arange(m - 1), np.arange(1, m)
        gap = (self.row[a] == self.row[b]) & ~self.opening[a]
        a, b = a[gap], b[gap]
        lo, hi = self.pos[a] + 1, self.pos[b]
        filled, foreign = blank[hi] - blank[lo], scalar[hi] - scalar[lo]
        key_end = (self.kind[a] == QUOTE) & (self.kind[b] == COLON)
        rule = np.where(key_end, 1, _NEXT[self.kind[a], self.kind[b]])
        wrong = (rule == 0) | ((rule == 1) & (filled > 0)) | (foreign > 0) | ((rule == 3) & (filled == 0))
        bad[self.row[a[wrong]]] = True
        # an object has keys before colons, an array none: a string in an object is a key or follows a colon
        lead = blank[self.pos[f]] - blank[self.start]
        tail = blank[self.end] - blank[self.pos[last] + 1]
        self.ok = ok & ~bad & (lead == 0) & (tail == 0)

    def keys(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the keys of objects at ``depth``: token of the opening quote, start and end of the text."""
        i = np.flatnonzero(self.opening & (self.depth == depth))
        i = i[i + 2 < self.pos.size]
        i = i[(self.kind[i + 2] == COLON) & (self.row[i + 2] == self.row[i]) & self.ok[self.row[i]]]
        return i, self.pos[i] + 1, self.pos[i + 1]

    def value_of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of keys: the token the value begins with (a bracket or quote, else -1) and whether the value is null."""
        nxt = np.minimum(key + 3, self.pos.size - 1)
        lead = self.up[nxt] | self.opening[nxt]
        return np.where(lead, nxt, -1), ~lead & self.is_null(self.pos[key + 2] + 1, self.pos[nxt])

    def is_null(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the scalar between two byte positions is null: its first visible byte is an n."""
        out = np.zeros(lo.size, bool)
        at, todo = lo.copy(), np.arange(lo.size)
        while todo.size:
            todo = todo[at[todo] < hi[todo]]
            blank = _BLANK[self.buf[at[todo]]]
            seen = todo[~blank]
            out[seen] = self.buf[at[seen]] == 110
            todo = todo[blank]
            at[todo] += 1
        return out

    def named(self, lo: np.ndarray, hi: np.ndarray, name: str) -> np.ndarray:
        """Indices of the spans that read ``name``, whether or not they have escapes."""
        lit = name.encode()
        i = np.flatnonzero(hi - lo == len(lit))
        for k, byte in enumerate(lit):
            i = i[self.buf[lo[i] + k] == byte]
        longer = np.flatnonzero((hi - lo > len(lit)) & (hi - lo <= 6 * len(lit)))
        longer = longer[self.slashes[hi[longer]] > self.slashes[lo[longer]]] if longer.size else longer
        spelt = [k for k in longer.tolist() if self.text(int(lo[k]), int(hi[k])) == name]
        return np.sort(np.concatenate([i, np.array(spelt, np.int64)])) if spelt else i

    def elements(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the elements of arrays at ``depth``: array token, place, first token (or -1 for a scalar), null, the token before."""
        here = self.depth == depth
        comma = here & (self.kind == COMMA)
        opens = here & (self.kind == ARR)
        inside = self.inside[depth]
        is_arr = self.kind[np.maximum(inside, 0)] == ARR
        at = np.flatnonzero((opens | (comma & is_arr)) & self.ok[self.row])
        if not at.size:
            return at, at, at, np.zeros(0, bool), at
        arr = inside[at]
        nxt = np.minimum(at + 1, self.pos.size - 1)
        count = np.cumsum(comma)
        place = count[at] - count[arr]
        lead = self.up[nxt] | self.opening[nxt]
        blank = np.concatenate([[0], np.cumsum(~_BLANK[self.buf])])
        empty = ~lead & (blank[self.pos[nxt]] == blank[self.pos[at] + 1])  # [] has no element
        null = ~lead & ~empty & self.is_null(self.pos[at] + 1, self.pos[nxt])
        keep = ~empty
        return arr[keep], place[keep], np.where(lead, nxt, -1)[keep], null[keep], at[keep]

    def spans(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the values that follow the tokens ``before``, which are colons, commas or opening brackets."""
        nxt = np.minimum(before + 1, self.pos.size - 1)
        end = np.where(self.up[nxt], self.pos[self.close[nxt]] + 1, np.where(self.opening[nxt], self.pos[np.minimum(nxt + 1, self.pos.size - 1)] + 1, self.pos[nxt]))
        return self.pos[before] + 1, end

    def value(self, lo: int, hi: int) -> str:
        """The value between two byte positions: a string as it reads, anything else as its JSON text without needless blanks."""
        raw = self.buf[lo:hi].tobytes().strip()
        if raw[:1] == b'"':
            return json.loads(raw) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")
        text = raw.decode("utf-8", "replace")
        return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":")) if raw[:1] in (b"{", b"[") else text

    def text(self, lo: int, hi: int) -> str:
        """The string between two byte positions, escapes resolved."""
        raw = self.buf[lo:hi].tobytes()
        return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode("utf-8", "replace")
