"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

import html
import re

import pandas as pd
import regex
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: white space as Unicode knows it, spelled so that Java and RE2 read it alike
WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ANY_TAG = r"<[^>]+>"
NUMBERED_TAG = r"</?\d+>"
#: words and the white space between them
TOKEN = rf"[^\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|{WS}+"
# fixed values: abbreviations after which no sentence ends, and month names that follow a day's full stop
ABBREVIATIONS = "Mr Mrs Ms Dr Prof St No Nos vol pp Fig Art Sec approx resp Hr Fr Nr Abs Bd bzw ca usw vgl z d u o M Mme MM Sr Sra n art e i a g B h".split()
MONTH_NAMES = ("January February March April May June July August September October November December "
               "Januar Februar März Mai Juni Juli Oktober Dezember Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Okt Nov Dec Dez").split()
#: a full stop that ends no sentence while the text is cut, and where it is cut
_HELD, _CUT = "\x11", "\x1e"
#: how a text is cut into sentences: pattern and replacement, one after the other, in the form that Java, RE2 and Python's regex share
SENTENCE_STEPS = (
    (rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(ABBREVIATIONS)})\.", rf"$1$2{_HELD}"),
    (r"(^|[^\p{L}\p{N}])(\p{Lu})\.(\s)", rf"$1$2{_HELD}$3"),
    (rf"(^|[^\p{{N}}])(\p{{Nd}}{{1,2}})\.(\s+(?:{'|'.join(MONTH_NAMES)}))", rf"$1$2{_HELD}$3"),
    (r"([.!?…]+[)\]\"'”’»]*(?:</\d+>)*\s+)([\p{Lu}\p{Nd}<\"'“„«(\[¿¡])", rf"$1{_CUT}$2"),
    (r"(\n+)", rf"$1{_CUT}"),
    (_HELD, "."),
)
#: digits, punctuation and currency signs only
NON_TEXT = r"^[\d\s.,;:!?%€$£¥+\-–—/()\[\]{}\\'\"&*#@=<>|~^_°±×÷]*$"


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends; letter case kept."""
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, ANY_TAG, "")


def strip_numbered_tags(c: Column) -> Column:
    return F.regexp_replace(c, NUMBERED_TAG, "")


def clean(c: Column) -> Column:
    """Tags and the bracketed placeholders of tabs, comments and shapes removed."""
    return strip(F.regexp_replace(strip_tags(c), r"\[(?:TAB|COMMENT|SHAPE)\]", ""))


def tm_key(c: Column) -> Column:
    """The lookup key of a text: SHA-256 of its collapsed form."""
    return F.sha2(collapse(c), 256)


def match_key(c: Column) -> Column:
    """A text as compared between two versions of a document."""
    return strip(F.translate(strip_tags(c), "‑ ", "- "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(strip(strip_tags(c)), rf"{WS}+"), lambda w: w != ""))


def tokens(c: Column) -> Column:
    """Words and the white space between them, in order; nothing is lost."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def sentence_parts(c: Column) -> Column:
    """Rule-based sentences with what stands between them; joined they are the text again.

    A sentence ends at closing marks before white space and a capital, digit, quote, bracket
    or tag, and at a line end; not after abbreviations, initials and the days of dates, and
    never inside a number or word.
    """
    for pattern, put in SENTENCE_STEPS:
        c = F.regexp_replace(c, pattern, put)
    return F.split(c, _CUT, -1)


def sentences(c: Column) -> Column:
    """The sentences without white space around them."""
    return F.filter(F.transform(sentence_parts(c), strip), lambda s: s != "")


def split_sentences(text: str) -> list[str]:
    """``sentence_parts`` of one text, for readers that work on the executors."""
    for pattern, put in SENTENCE_STEPS:
        text = regex.sub(pattern, re.sub(r"\$(\d)", r"\\\1", put), text)
    return [p for p in text.split(_CUT) if p]


def is_non_text(c: Column) -> Column:
    """Whether nothing but digits, punctuation and currency is left without tags."""
    return strip(strip_tags(c)).rlike(NON_TEXT)


def has_content(c: Column) -> Column:
    """Whether a text is more than numbered tags and white space."""
    return strip(strip_numbered_tags(c)) != ""


def prompt_safe(c: Column) -> Column:
    """Tabs as blanks, runs of blanks as one, control characters dropped."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\t", " "), r" +", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def unquoted(c: Column) -> Column:
    """Quotation marks and blanks around a reply removed."""
    return F.regexp_replace(c, rf"^(?:{WS}|[\"'“”„])+|(?:{WS}|[\"'“”„])+$", "")


def xml_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def attr_escaped(c: Column) -> Column:
    return F.replace(xml_escaped(c), F.lit('"'), F.lit("&quot;"))


def unescaped(c: Column) -> Column:
    """The five predefined entities and the no-break space, ampersand last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _unescape_all(c: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else html.unescape(x) for x in c], dtype=object)


def html_unescaped(c: Column) -> Column:
    """All named and numbered entities, in Arrow batches."""
    return pandas_udf(_unescape_all, StringType())(c)


def file_stem(c: Column, length: int = 40) -> Column:
    """A name as part of a file name: letters, digits, - and _, blanks as _."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}\-_ ]", "")
    return F.substring(F.replace(F.trim(kept), F.lit(" "), F.lit("_")), 1, length)


def author_id(c: Column, stage: Column | int) -> Column:
    """An author's name with the stage of the revision."""
    return F.concat(F.replace(F.lower(c), F.lit(" "), F.lit("_")), F.lit("__stage_"), F.lit(stage).cast("string") if isinstance(stage, int) else stage.cast("string"))


def export_date(c: Column, otherwise: Column) -> Column:
    """A date as a word processor takes it: ISO as it is, epoch milliseconds and the form with a blank as ISO, else the given one."""
    spaced = F.concat(F.replace(c, F.lit(" "), F.lit("T")), F.when(F.length(c) == 16, ":00").otherwise(""), F.lit("Z"))
    return (F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), c)
            .when(c.rlike(r"^\d{13}$"), F.date_format(F.timestamp_millis(F.when(c.rlike(r"^\d{13}$"), c).cast("bigint")).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2})?$"), spaced).otherwise(otherwise))


def unit_facts(c: Column) -> Column:
    """Amounts in lakh and crore spelled out: first all lakhs, then all crores."""
    def facts(unit: str, factor: int) -> Column:
        amounts = F.regexp_extract_all(c, F.lit(rf"(?i)(\d+(?:\.\d+)?)\s*{unit}s?\b"), F.lit(1))
        name = unit.capitalize()
        return F.transform(amounts, lambda a: F.concat(a, F.lit(f" {name} = "), F.format_number(F.floor(a.cast("decimal(20,4)") * factor), 0)))
    return F.concat(facts("lakh", 100_000), facts("crore", 10_000_000))


def error_class(c: Column) -> Column:
    """Kind of a service's error message: quota, transient or other."""
    low = F.lower(c)
    quota = low.contains("429") & low.rlike("quota|exhausted|rate limit|billing")
    return F.when(quota, "quota").when(low.rlike(r"\b(429|500|502|503|504)\b|timeout|timed out|temporar|connection|unavailable"), "transient").otherwise("other")


def clean_of_markup(c: Column) -> Column:
    """The final text of insert and delete markup."""
    kept = F.regexp_replace(F.regexp_replace(c, r"(?s)<del\b[^>]*>.*?</del>", ""), r"</?ins\b[^>]*>", "")
    return strip(F.regexp_replace(kept, r" {2,}", " "))


def valid_markup(c: Column) -> Column:
    """Whether insert and delete marks are balanced and not nested; text without marks is valid."""
    opened = lambda t: F.regexp_count(c, F.lit(rf"<{t}\b[^>]*>"))
    closed = lambda t: F.regexp_count(c, F.lit(rf"</{t}>"))
    marks = F.array_join(F.regexp_extract_all(c, F.lit(r"<(/?(?:ins|del))\b[^>]*>"), F.lit(1)), ",")
    return (opened("ins") == closed("ins")) & (opened("del") == closed("del")) & marks.rlike(r"^((ins,/ins|del,/del)(,|$))*$")
