"""Text decoded with the wrong character encoding: finding and undoing it.

Method: a multinomial classifier over hashed byte bigrams, trained on words that
are garbled on purpose with every known chain of encodings, predicts the exact
chain of each word that holds other than ASCII characters: the most probable of those
that do not fail to decode, unless clean text is more probable. The predicted chain is
inverted; the result counts only if every step is strictly decodable and gives
plausible letters, all of one script. The restored word is then diagnosed again, as it
may have been garbled more than once and in different ways; what is still garbled in
the end counts as found but not as restored. Replacement characters mark a chain that
cannot be inverted.

A chain is either UTF-8 read as a one-byte encoding, which strict decoding proves, or
one one-byte encoding read as another, which any text survives: of these a word is
only a case if the classifier says so and a character that no word of a language has
there (a symbol or a letter of another script) stands between two Latin letters.

The classifier is fitted on a sample of at most ``SAMPLE_DOCS`` documents, taken in
hash order, whose words are the labelled rows once garbled, and on ``SEEDS`` for
scripts that the documents may lack; this bound is its only sample. Every word of every document is classified, on the executors, without a
shuffle.

Defined cases: null, empty and pure ASCII texts are no case; foreign letters,
symbols, formulas and drawings are no case; a word that no chain inverts strictly
is no case unless it holds a replacement character; repeated rows repeat in the
result of ``repair`` and appear once in ``affected``; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SAMPLE_DOCS = 3000
BUCKETS = 1 << 14
CODECS = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859-15", "koi8-r")
#: chains by name: the wrong decodings of UTF-8 bytes, first to last
CHAINS: dict[str, tuple[str, ...]] = {c: (c,) for c in CODECS} | {f"{c}+{c}": (c, c) for c in ("latin-1", "cp1252", "cp437", "mac_roman")}
#: one-byte encodings read as another: written as, read as
SWAPS: dict[str, tuple[str, str]] = {f"{a}>{b}": (a, b) for a, b in (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "mac_roman"),
                                                                   ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"))}
CLEAN, LOST = "clean", "replaced"
LABELS = (CLEAN, LOST, *CHAINS, *SWAPS)
# fixed values: everyday words in other scripts, for the labelled rows
SEEDS = ("отчёт проект бюджет таблица средства название перевод договор заметки решение приложение город совет вода школа "
         "έκθεση έργο προϋπολογισμός πίνακας πόλη συμβούλιο νερό σχολείο μετάφραση σύμβαση απόφαση παράρτημα "
         "报告 项目 预算 表格 城市 翻译 合同 会议 決定 報告 予算 東京 データ テスト 日本語 보고서 예산 번역 회의").split()
_TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")


def _table(codec: str) -> tuple[str, ...]:
    """Character of each byte; a byte the codec leaves open stands for the control of that number."""
    return tuple(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))


_DECODE = {c: _table(c) for c in CODECS}
_ENCODE = {c: {ch: b for b, ch in reversed(list(enumerate(t)))} for c, t in _DECODE.items()}


def garble(word: str, chain: tuple[str, ...]) -> str:
    for codec in chain:
        word = "".join(_DECODE[codec][b] for b in word.encode())
    return word


def invert(word: str, chain: tuple[str, ...]) -> str | None:
    """The word before the chain, or null if a step is not strictly decodable."""
    for codec in reversed(chain):
        back = _ENCODE[codec]
        try:
            word = bytes(back[ch] for ch in word).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None
    return word


def swap(word: str, written: str, read: str) -> str | None:
    """A word written in one one-byte encoding and read as another; null if the first lacks a character."""
    back = _ENCODE[written]
    return "".join(_DECODE[read][back[ch]] for ch in word) if all(ch in back for ch in word) else None


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    """The script of a letter by its name: the ideographs, syllables and sounds of East Asia are one."""
    first = unicodedata.name(ch, "").split(" ")[0]
    return "CJK" if first in ("HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC", "KATAKANA-HIRAGANA") else first


def plausible(word: str) -> bool:
    """Whether a restored word has other than ASCII characters, all of them letters of one script, marks or usual signs."""
    scripts, seen = set(), False
    for ch in word:
        if ch > "\x7f":
            seen = True
            cat = unicodedata.category(ch)
            if cat in ("Cc", "Cn", "Co", "Cs") or ch == "�":
                return False
            if cat[0] == "L" and ch not in "ªº":
                scripts.add(script(ch))
    if scripts - {"LATIN", "CYRILLIC", "GREEK", "CJK"} or len(scripts) > 1:
        return False
    return seen


def latin(word: str) -> bool:
    return plausible(word) and all(script(ch) == "LATIN" for ch in word if ch > "\x7f" and ch.isalpha() and ch not in "ªº")


#: signs that people do write inside words and formulas
_USUAL = set("’‘·‧‐‑–—…“”„«»ªºµ²³¹×÷±™®©°¼½¾€§")


def out_of_place(word: str) -> bool:
    """Whether a word of four ASCII letters or more has, before a small one, a character that no word has there.

    That is a symbol, a control or a letter of another script after a Latin letter, or a
    capital beyond ASCII after a small letter.
    """
    if sum(ch.isalpha() for ch in word if ch < "\x80") < 4:
        return False
    for a, ch, b in zip(word, word[1:], word[2:]):
        if ch > "\x7f" and ch not in _USUAL and a.isalpha() and a < "\u0250" and "a" <= b <= "z":
            cat = unicodedata.category(ch)
            if cat[0] in "SP" or cat in ("No", "Cc") or cat[0] == "L" and script(ch) != "LATIN" or cat == "Lu" and a.islower():
                return True
    return False


class ChainClassifier:
    """Multinomial naive Bayes over hashed byte bigrams of a word."""

    def __init__(self, log_prob: np.ndarray):
        self.log_prob = log_prob

    @staticmethod
    def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all bigrams, and where each word begins; a word is framed by blanks."""
        raw = [b" " + w.encode("utf-8", "replace") + b" " for w in words]
        buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        lengths = np.array([len(r) for r in raw])
        ends = np.cumsum(lengths)
        gram = ((buf[:-1] << 8 | buf[1:]) * np.uint32(2654435761)) >> np.uint32(32 - 14)
        keep = np.ones(gram.size, bool)
        keep[ends[:-1] - 1] = False  # no bigram across two words
        return gram[keep], np.concatenate([[0], np.cumsum(lengths - 1)[:-1]])

    @classmethod
    def fit(cls, rows: dict[str, list[str]]) -> "ChainClassifier":
        counts = np.full((len(LABELS), BUCKETS), 0.05)
        for k, label in enumerate(LABELS):
            if rows.get(label):
                counts[k] += np.bincount(cls.features(rows[label])[0], minlength=BUCKETS)
        return cls(np.log(counts / counts.sum(1, keepdims=True)))

    def ranked(self, words: list[str]) -> np.ndarray:
        """Per word the labels from most to least probable."""
        gram, at = self.features(words)
        score = np.add.reduceat(self.log_prob[:, gram], at, axis=1)
        return np.argsort(-score, axis=0, kind="stable").T


def non_ascii_words(text: str | None) -> list[str]:
    return _TOKEN.findall(text) if text else []


def training_rows(texts: list[str]) -> dict[str, list[str]]:
    """Labelled words: those no chain explains are clean, and each is garbled by every chain."""
    words = sorted({w for t in texts for w in non_ascii_words(t)})
    clean = [w for w in words if "�" not in w and not any((r := invert(w, c)) is not None and plausible(r) and _shorter(r, w) for c in CHAINS.values())]
    usable = [w for w in clean if plausible(w)]
    own = [w for w in usable if latin(w)]
    rows = {CLEAN: clean + SEEDS, LOST: [w.encode("latin-1", "ignore").decode("utf-8", "replace") for w in own if not w.isascii()]}
    rows[LOST] = [w for w in rows[LOST] if "�" in w]
    rows |= {name: [g for w in own if (g := swap(w, *pair)) is not None and g != w and out_of_place(g)] for name, pair in SWAPS.items()}
    return rows | {name: [g for w in usable + SEEDS if (g := garble(w, chain)) != w] for name, chain in CHAINS.items()}


def _shorter(restored: str, word: str) -> bool:
    return len(restored) < len(word)


def diagnose(words: list[str], model: ChainClassifier) -> list[tuple[str, str | None]]:
    """Per word the chain and the restored word (null if it cannot be restored).

    A restored word is diagnosed again; every step shortens it, so this ends.
    """
    out = _one_step(words, model)
    again = [k for k, (label, back) in enumerate(out) if label in CHAINS and back is not None and not back.isascii()]
    if again:
        for k, (label, back) in zip(again, diagnose([out[k][1] for k in again], model)):
            if label != CLEAN:
                out[k] = (f"{label}+{out[k][0]}", back)
    return out


def _one_step(words: list[str], model: ChainClassifier) -> list[tuple[str, str | None]]:
    out: list[tuple[str, str | None]] = []
    if not words:
        return out
    for word, order in zip(words, model.ranked(words)):
        found: tuple[str, str | None] = (CLEAN, word)
        if "�" in word:
            found = (LOST, None)
        else:
            for k in order:
                label = LABELS[k]
                if label == CLEAN:
                    break
                if label in SWAPS:
                    if out_of_place(word) and (back := swap(word, *SWAPS[label][::-1])) is not None and latin(back):
                        found = (label, back)
                        break
                elif label != LOST and (back := invert(word, CHAINS[label])) is not None and plausible(back) and _shorter(back, word):
                    found = (label, back)
                    break
        out.append(found)
    return out


def fit_classifier(documents: DataFrame, doc_id: str, text: str, sample_docs: int = SAMPLE_DOCS) -> ChainClassifier:
    """A classifier fitted on at most ``sample_docs`` documents with other than ASCII characters."""
    rows = (documents.filter(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(text).alias("t"), F.xxhash64(doc_id).alias("h"), F.col(doc_id).alias("i"))
            .orderBy("h", "i").limit(sample_docs).select("t").collect())
    return ChainClassifier.fit(training_rows([r.t for r in rows]))


REPAIR_SCHEMA = "doc_id long, chains array<string>, garbled_words int, restored_words int, restored_text string"


def repair(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", model: ChainClassifier | None = None) -> DataFrame:
    """The affected documents: their chains, counts of words, and the text with every invertible word restored."""
    src = documents.filter(F.col(doc_id).isNotNull() & F.col(text).rlike(r"[^\x00-\x7f]"))
    model = model or fit_classifier(src, doc_id, text)
    shared = documents.sparkSession.sparkContext.broadcast(model.log_prob.astype(np.float32))  # LABELS x BUCKETS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = ChainClassifier(shared.value)
        for pdf in batches:
            yield repair_batch(pdf["doc_id"].tolist(), pdf["text"].tolist(), m)

    return src.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, REPAIR_SCHEMA)


def repair_batch(ids: list[int], texts: list[str], model: ChainClassifier) -> pd.DataFrame:
    per_doc = [non_ascii_words(t) for t in texts]
    distinct = list(dict.fromkeys(w for ws in per_doc for w in ws))
    verdict: dict[str, tuple[str, str | None]] = {}
    for lo in range(0, len(distinct), 20_000):
        part = distinct[lo:lo + 20_000]
        verdict |= zip(part, diagnose(part, model))
    rows = []
    for i, text, ws in zip(ids, texts, per_doc):
        hit = [verdict[w] for w in ws if verdict[w][0] != CLEAN]
        if hit:
            fixed = _TOKEN.sub(lambda m: verdict[m.group()][1] or m.group(), text)
            rows.append((i, sorted({c for c, _ in hit}), len(hit), sum(b is not None for _, b in hit), fixed))
    return pd.DataFrame(rows, columns=["doc_id", "chains", "garbled_words", "restored_words", "restored_text"])


def affected(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` of every document with a garbled passage."""
    return repair(documents, doc_id, text).select("doc_id").distinct()
