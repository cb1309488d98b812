"""Time stamps of many formats, precisions and zones, as one instant.

All formats are one regex alternation with named groups. It is run once per stamp: the replacement template writes the
components of whichever format matched in a fixed order, a split gives them back. Calendar ranges are then checked and the
instant is put together with integer day arithmetic; only local times of zones with rules ask the zone tables. All of it
is built-in expressions, so it stays in generated code and needs no shuffle beyond the join with the walls' zones.

Defined results: null, blank, relative or verbal stamps, dates without time of day, impossible dates or times and unknown
zones name no instant (null). A local time that a clock change skips is moved forward by the change; one that occurs twice
means the first. Of two stamps the one shown to the second counts before the one shown to the minute, then the first.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names by language, and what zone letters mean in minutes east of UTC.
MONTHS = [
    "january|jan|enero", "february|feb|pebrero|febrero", "march|mar|marso|marzo", "april|apr|abril", "may|mayo",
    "june|jun|hunyo|junio", "july|jul|hulyo|julio", "august|aug|agosto", "september|sept|sep|setyembre|septiembre",
    "october|oct|oktubre|octubre", "november|nov|nobyembre|noviembre", "december|dec|disyembre|diciembre",
]
LETTERS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "GST": 240, "PKT": 300, "IST": 330, "WIB": 420, "ICT": 420, "PHT": 480, "PHST": 480, "HKT": 480, "SGT": 480, "MYT": 480,
    "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540,
    "AKDT": -480, "HST": -600,
}
#: Where the same letters mean another zone, by the area of the wall's zone.
LOCAL_LETTERS = {
    "Asia": {"CST": 480, "PST": 480},
    "Australia": {"EST": 600, "EDT": 660, "CST": 570, "CDT": 630, "WST": 480},
}

_ZONE = r"Z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5}|[A-Z][A-Za-z]+(?:/[A-Za-z_+-]+)+"
_MONTH = "|".join(MONTHS)
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_BLANKS = "\u00a0\u2007\u2009\u202f\u3000\t"


def _clock(p: str) -> str:
    return (
        rf"(?<{p}h>\d{{1,2}}):(?<{p}n>\d{{2}})(?::(?<{p}s>\d{{2}})(?:[.,]\d+)?)?(?:\s*(?<{p}p>[ap])\.?m\b\.?)?(?:\s*(?<{p}z>{_ZONE}))?"
    )


#: The formats by the prefix of their groups.
FORMATS = {
    "a": r"(?<as>\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:\.\d+)?",
    "b": rf"(?<by>\d{{4}})-(?<bm>\d{{1,2}})-(?<bd>\d{{1,2}})(?:T|\s+){_clock('b')}",
    "c": rf"(?<cy>\d{{4}})(?<cm>\d{{2}})(?<cd>\d{{2}})T(?<ch>\d{{2}})(?<cn>\d{{2}})(?:(?<cs>\d{{2}})(?:[.,]\d+)?)?\s*(?<cz>{_ZONE})?",
    "d": rf"(?<di>\d{{1,2}})/(?<dj>\d{{1,2}})/(?<dy>\d{{4}}),?\s+{_clock('d')}",
    "e": rf"{_DAY}(?<em>{_MONTH})\.?\s+(?<ed>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<ey>\d{{4}}),?\s+(?:at\s+)?{_clock('e')}",
    "f": rf"{_DAY}(?:ika-)?(?<fd>\d{{1,2}})(?:st|nd|rd|th)?\s+(?:ng\s+|de\s+)?(?<fm>{_MONTH})\.?,?\s+(?:de\s+)?(?<fy>\d{{4}}),?\s+(?:at\s+|a\s+las\s+)?{_clock('f')}",
}
PATTERN = r"(?i)^\s*(?:" + "|".join(FORMATS.values()) + r")\s*$"
_PARTS = ["y", "m", "d", "h", "n", "s", "p", "z", "epoch", "i", "j"]


def _template() -> str:
    have = {
        "y": "bcdef", "m": "bcef", "d": "bcef", "h": "bcdef", "n": "bcdef", "s": "bcdef", "p": "bdef", "z": "bcdef",
    }
    cells = ["".join(f"${{{f}{part}}}" for f in fs) for part, fs in have.items()]
    return "|".join([*cells, "${as}", "${di}", "${dj}"]) + "|"


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers."""
    whole = lambda a, b: F.floor(a / b).cast("bigint")
    y = F.when(m <= 2, y - 1).otherwise(y)
    era = whole(y, F.lit(400))
    yoe = y - era * 400
    doy = whole(153 * (m + F.when(m > 2, -3).otherwise(9)) + 2, F.lit(5)) + d - 1
    return era * 146097 + yoe * 365 + whole(yoe, F.lit(4)) - whole(yoe, F.lit(100)) + doy - 719468


def _pin(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """df with further columns, made by a generator that gives one row per row."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names that the session's JVM has rules for (some hundred)."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def parse_stamps(df: DataFrame, stamps: list[str], zone: str, order: str) -> DataFrame:
    """df with, for each column s of ``stamps``, ``s_epoch`` (whole seconds, or null) and ``s_unit`` (second or minute).

    ``zone``: column with the zone name for stamps without one. ``order``: column with ``dmy`` or ``mdy`` for slash dates.
    """
    zones = known_zones(df.sparkSession)
    offsets = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v * 60)) for k, v in LETTERS.items()))
    months = F.create_map(*chain.from_iterable((F.lit(n), F.lit(i)) for i, names in enumerate(MONTHS, 1) for n in names.split("|")))
    area = F.split_part(F.col(zone), F.lit("/"), F.lit(1))
    blank = F.lit("")
    numeric = r"^(?i:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$"

    for s in stamps:
        # Each step is pinned by a generator of one row: what is used more than once is computed once, and neither merged
        # projections nor pushed-down filters can copy the expressions into each other.
        t = {k: F.col(f"_{s}_{k}") for k in ("text", "line", "c", *_PARTS, "month", "day", "hour", "wall", "shift", "named")}
        put = lambda **cols: _pin(df, {f"_{s}_{k}": v for k, v in cols.items()})  # noqa: E731, B023
        text = F.translate(F.col(s).cast("string"), _BLANKS, " " * len(_BLANKS))
        # Without a match the text comes back unchanged and is not taken apart.
        df = put(text=text)
        df = put(line=F.when(t["text"].rlike(r"\d"), F.regexp_replace(t["text"], PATTERN, _template())))
        df = put(c=F.when(t["line"].rlike(r"^(?:[^|]*\|){11}$"), F.split(t["line"], r"\|")))
        cell = {p: F.nullif(F.get(t["c"], F.lit(i)), blank) for i, p in enumerate(_PARTS)}
        df = put(**{p: cell[p].cast("bigint") if p in ("y", "d", "h", "n", "s", "i", "j") else cell[p] for p in _PARTS})
        slash, dmy, mdy = t["i"].isNotNull(), F.col(order) == "dmy", F.col(order) == "mdy"
        half = F.lower(t["p"])
        df = put(
            month=F.when(slash, F.when(dmy, t["j"]).when(mdy, t["i"]))
            .when(t["m"].rlike(r"^\d+$"), F.try_to_number(t["m"], F.lit("99")).cast("bigint"))
            .otherwise(F.try_element_at(months, F.lower(t["m"])).cast("bigint")),
            day=F.when(slash, F.when(dmy, t["i"]).when(mdy, t["j"])).otherwise(t["d"]),
            hour=F.when(half.isNull(), F.when(t["h"] <= 23, t["h"])).when(t["h"].between(1, 12), t["h"] % 12 + F.when(half == "p", 12).otherwise(0)),
        )
        leap = (t["y"] % 4 == 0) & ((t["y"] % 100 != 0) | (t["y"] % 400 == 0))
        last = F.when(t["month"] == 2, F.when(leap, 29).otherwise(28)).when(t["month"].isin(4, 6, 9, 11), 30).otherwise(31)
        second = F.coalesce(t["s"], F.lit(0))
        valid = t["month"].between(1, 12) & t["day"].between(1, last) & (t["n"] <= 59) & (second <= 59)
        minutes = F.regexp_extract(t["z"], numeric, 2).cast("int") * 60 + F.coalesce(F.nullif(F.regexp_extract(t["z"], numeric, 3), blank).cast("int"), F.lit(0))
        local = F.lit(None).cast("int")
        for name, own in LOCAL_LETTERS.items():
            for letters, m in own.items():
                local = F.when((area == name) & (F.upper(t["z"]) == letters), m * 60).otherwise(local)
        df = put(
            wall=F.when(valid, days_from_civil(t["y"], t["month"], t["day"]) * 86400 + t["hour"] * 3600 + t["n"] * 60 + second),
            shift=F.when(t["z"].rlike(numeric), F.when(minutes <= 14 * 60, F.when(F.regexp_extract(t["z"], numeric, 1) == "-", -minutes).otherwise(minutes) * 60))
            .when(~t["z"].contains("/"), F.coalesce(local, F.try_element_at(offsets, F.upper(t["z"])))),
            named=F.when(t["z"].isNull(), F.col(zone)).when(t["z"].contains("/"), t["z"]),
        )
        ruled = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(t["wall"]), F.when(t["named"].isin(zones), t["named"])))
        digits = F.length(t["epoch"])
        per = F.when(digits <= 10, 1).when(digits <= 13, 1000).when(digits <= 16, 1000000).otherwise(1000000000)
        df = _pin(
            df,
            {
                f"{s}_epoch": F.when(t["epoch"].isNotNull(), F.floor(t["epoch"].cast("decimal(20,0)") / per.cast("decimal(10,0)")).cast("bigint"))
                .when(t["named"].isNotNull(), ruled).otherwise(t["wall"] - t["shift"]),
                f"{s}_unit": F.when(t["epoch"].isNotNull() | t["s"].isNotNull(), "second").when(t["h"].isNotNull(), "minute"),
            },
        ).drop(*[f"_{s}_{k}" for k in t])
    return df


def one_instant(stamps: list[str]) -> Column:
    """The instant of the finest stamp, the first of equals, from the columns that parse_stamps adds."""
    seconds = [F.when(F.col(f"{s}_unit") == "second", F.col(f"{s}_epoch")) for s in stamps]
    return F.coalesce(*seconds, *[F.col(f"{s}_epoch") for s in stamps])
