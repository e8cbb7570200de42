"""Free-form dates to UTC instants, with integer arithmetic on the JVM side.

Every accepted spelling is a branch of one regular expression with named groups.
The expression is matched once per text: the match is rewritten to its groups,
the groups are split into an array, and calendar and clock are checked and put
together as integers. Zone names go through the engine's zone rules, which are
asked both ways round so that skipped and repeated local times show.

Defined cases: null, empty, unreadable text, a day or time that no calendar has,
a date without time of day, a missing or unknown zone, an undecidable slash date,
and a local time that does not exist or occurs twice all give null.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

SEP = "\x01"

# fixed values: month names and three-letter forms, English and German
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "januar": 1, "februar": 2, "märz": 3, "maerz": 3, "mai": 5, "juni": 6, "juli": 7,
    "oktober": 10, "dezember": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9,
    "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}

# fixed values: zone abbreviations (minutes east of UTC): universal, European, British, US Eastern and Central
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60,
    "mesz": 120, "eet": 120, "eest": 180, "bst": 60, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
}

_CLOCK = r"(?<h{0}>\d{{1,2}}):(?<mi{0}>\d{{2}})(?::(?<s{0}>\d{{2}})(?:[.,](?<f{0}>\d+))?)?"
_ZONE = (r"(?:\s*(?:(?<zs{0}>[+-])(?<zh{0}>\d{{2}}):?(?<zm{0}>\d{{2}})?(?:\[[^\]]*\])?|\[?(?<zn{0}>[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)\]?"
         r"|\[?(?<za{0}>[A-Za-z]{{1,5}})\]?))?")
_NAMES = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))

# each branch has its own number, which the groups carry; group order is that of the list below
BRANCHES = (
    # 2024-03-05T06:07[:08[.9]] with or without zone
    r"(?<y1>\d{4})-(?<mo1>\d{2})-(?<d1>\d{2})(?:[Tt]|\s+)" + _CLOCK.format(1) + _ZONE.format(1),
    # 20240305T060708
    r"(?<y2>\d{4})(?<mo2>\d{2})(?<d2>\d{2})[Tt](?<h2>\d{2})(?<mi2>\d{2})(?:(?<s2>\d{2})(?:[.,](?<f2>\d+))?)?" + _ZONE.format(2),
    # 5.3.2024, 06:07[:08] [Uhr]
    r"(?<d3>\d{1,2})\.(?<mo3>\d{1,2})\.(?<y3>\d{4}),?\s+" + _CLOCK.format(3) + r"(?:\s*[Uu]hr)?" + _ZONE.format(3),
    # 03/05/2024 6:07[:08] [AM]
    r"(?<p4>\d{1,2})/(?<q4>\d{1,2})/(?<y4>\d{4}),?\s+" + _CLOCK.format(4) + r"(?:\s*(?<ap4>[AaPp])\.?[Mm]\.?)?" + _ZONE.format(4),
    # [Tue,] 5[.] Mar[ch] 2024[,] 06:07[:08] [Uhr]
    r"(?:[A-Za-z]{2,9}\.?,\s*)?(?<d5>\d{1,2})\.?\s+(?<mn5>(?iu:" + _NAMES + r"))\.?\s+(?<y5>\d{4}),?\s+" + _CLOCK.format(5)
    + r"(?:\s*[Uu]hr)?" + _ZONE.format(5),
    # seconds, milliseconds or microseconds since the epoch
    r"(?<e6>\d{16}|\d{13}|\d{10})",
)
PATTERN = r"^(?U:\s*)(?:" + "|".join(BRANCHES) + r")(?U:\s*)$"

_GROUPS = {
    "y": (1, 2, 3, 4, 5), "mo": (1, 2, 3), "d": (1, 2, 3, 5), "p": (4,), "q": (4,), "mn": (5,),
    "h": (1, 2, 3, 4, 5), "mi": (1, 2, 3, 4, 5), "s": (1, 2, 3, 4, 5), "f": (1, 2, 3, 4, 5), "ap": (4,),
    "zs": (1, 2, 3, 4, 5), "zh": (1, 2, 3, 4, 5), "zm": (1, 2, 3, 4, 5), "zn": (1, 2, 3, 4, 5), "za": (1, 2, 3, 4, 5), "e": (6,),
}
#: only one branch matches, so the groups of one role can stand side by side in one field
REWRITE = SEP.join("".join(f"${{{role}{n}}}" for n in branches) for role, branches in _GROUPS.items())
_AT = {role: i for i, role in enumerate(_GROUPS)}


@lru_cache(maxsize=1)
def known_zones() -> tuple[str, ...]:
    """The region names of the platform's zone rules, in sorted order."""
    from zoneinfo import available_timezones

    return tuple(sorted(z for z in available_timezones() if ("/" in z or z == "UTC") and not z.startswith(("Etc/", "posix/", "right/", "SystemV/"))))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date of the year 1 or later, by integer arithmetic."""
    div = lambda a, n: F.call_function("div", a, F.lit(n))
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = div(yy, 400)
    yoe = yy - era * 400
    doy = div(153 * (m + F.when(m > 2, -3).otherwise(9)) + 2, 5) + d - 1
    return (era * 146097 + yoe * 365 + div(yoe, 4) - div(yoe, 100) + doy - 719468).cast("bigint")


def _as_zone(us: Column, zone: Column, safe: Column) -> Column:
    """Local microseconds of an instant; evaluated only for known zones."""
    return F.when(safe, F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)))


def with_instant(df: DataFrame, text: str, zone: str, locale: str, out: str = "utc_us") -> DataFrame:
    """``df`` with a bigint column ``out``: microseconds since 1970-01-01 UTC, or null.

    ``text``, ``zone`` and ``locale`` are column names. Temporary columns are
    prefixed so that they cannot clash with columns of ``df``.
    """
    t = "__instant_"
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    # a text that does not match stays as it is and gives one part; one with the separator in it is no date
    rewritten = F.split(F.regexp_replace(F.when(~F.contains(F.col(text), F.lit(SEP)), F.col(text)), PATTERN, REWRITE), SEP, -1)
    df = df.select(*keep, rewritten.alias(t + "p")).select(*keep, F.when(F.size(t + "p") == len(_GROUPS), F.col(t + "p")).alias(t + "g"))
    g = lambda role: F.col(t + "g")[_AT[role]]
    num = lambda role: F.when(g(role) != "", g(role).cast("int"))
    loc = F.lower(F.regexp_replace(F.trim(F.col(locale)), "_", "-"))
    slash = lambda us, gb: F.when(loc == "en-us", num(us)).when(loc == "en-gb", num(gb))
    month_map = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    abbr_map = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    hour12 = F.when(num("h").between(1, 12), num("h") % 12 + F.when(F.lower(g("ap")) == "p", 12).otherwise(0))
    df = df.select(
        *keep, F.col(t + "g"),
        num("y").alias(t + "y"),
        F.coalesce(num("mo"), slash("p", "q"), F.when(g("mn") != "", month_map[F.lower(g("mn"))])).alias(t + "m"),
        F.coalesce(num("d"), slash("q", "p")).alias(t + "d"),
        F.when(g("ap") == "", num("h")).otherwise(hour12).alias(t + "h"),
        num("mi").alias(t + "mi"), F.coalesce(num("s"), F.lit(0)).alias(t + "s"),
        F.coalesce(F.rpad(F.substring(g("f"), 1, 6), 6, "0").cast("int"), F.lit(0)).alias(t + "f"),
    )
    c = lambda n: F.col(t + n)
    leap = ((c("y") % 4 == 0) & (c("y") % 100 != 0)) | (c("y") % 400 == 0)
    last = F.when(c("m").isin(4, 6, 9, 11), 30).when(c("m") == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = (c("y").between(1, 9999) & c("m").between(1, 12) & (c("d") >= 1) & (c("d") <= last)
             & c("h").between(0, 23) & c("mi").between(0, 59) & c("s").between(0, 59))
    seconds = ((days_from_civil(c("y"), c("m"), c("d")) * 24 + c("h")) * 60 + c("mi")) * 60 + c("s")
    local = seconds.cast("bigint") * F.lit(1000000).cast("bigint") + c("f")
    offset_m = num("zh") * 60 + F.coalesce(num("zm"), F.lit(0))
    fixed = (F.when((g("zs") != "") & (num("zh") <= 18) & (F.coalesce(num("zm"), F.lit(0)) <= 59),
                    F.when(g("zs") == "-", -offset_m).otherwise(offset_m))
             .when(g("za") != "", abbr_map[F.lower(g("za"))]))
    has_zone = (g("zs") != "") | (g("za") != "")
    zones = list(known_zones())
    canon = F.create_map(*[F.lit(x) for z in ("UTC",) for x in ("utc", z)])
    named = F.when(g("zn") != "", g("zn")).otherwise(F.trim(F.col(zone)))
    df = df.select(
        *keep, F.col(t + "g"), F.when(valid, local).alias(t + "local"), fixed.alias(t + "fixed"), has_zone.alias(t + "has"),
        F.coalesce(canon[F.lower(named)], named).alias(t + "zone"))
    safe = c("zone").isin(zones) & c("local").isNotNull() & ~c("has")
    day = 86_400_000_000
    # the offsets in force a day before and a day after; a local time has at most these two readings
    before = _as_zone(c("local") - day, c("zone"), safe) - (c("local") - day)
    after = _as_zone(c("local") + day, c("zone"), safe) - (c("local") + day)
    df = df.select(*keep, F.col(t + "g"), c("local"), c("fixed"), c("has"), c("zone"), safe.alias(t + "safe"),
                   (c("local") - before).alias(t + "a"), (c("local") - after).alias(t + "b"))
    a_ok = _as_zone(c("a"), c("zone"), c("safe")) == c("local")
    b_ok = _as_zone(c("b"), c("zone"), c("safe")) == c("local")
    by_rule = (F.when(c("a") == c("b"), F.when(a_ok, c("a")))
               .when(a_ok & ~b_ok, c("a")).when(b_ok & ~a_ok, c("b")))
    e = F.col(t + "g")[_AT["e"]]
    epoch = F.when(F.length(e) == 10, e.cast("bigint") * 1000000).when(F.length(e) == 13, e.cast("bigint") * 1000).when(F.length(e) == 16, e.cast("bigint"))
    return df.select(*keep, F.when(e != "", epoch).when(c("has"), c("local") - c("fixed").cast("bigint") * 60000000).otherwise(by_rule).cast("bigint").alias(out))
