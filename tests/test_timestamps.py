"""The one-pass parser against an independent parser built on datetime and zoneinfo."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

import pytest

from postloom.operators.timestamps import one_instant, parse_stamps

MON = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
TL = {m: i for i, m in enumerate("enero pebrero marso abril mayo hunyo hulyo agosto setyembre oktubre nobyembre disyembre".split(), 1)}
OFF = {"UTC": 0, "PHT": 8, "PHST": 8, "HKT": 8, "SGT": 8, "JST": 9, "AEST": 10, "AEDT": 11, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4}


def slow(text, tz, order):
    """(epoch, unit) by trying one format after another."""
    if text is None:
        return None
    t = text.strip()
    if re.fullmatch(r"\d+(\.\d+)?", t):
        n = t.split(".")[0]
        return (int(n) // {10: 1, 13: 10**3, 16: 10**6}[len(n)], "second") if len(n) in (10, 13, 16) else None
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?\s*(.*)", t) or re.fullmatch(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(.*)", t)
    ap = None
    if m:
        y, mo, d, h, mi = map(int, m.groups()[:5])
        s, z = m[6], m[7]
    elif m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4}) (\d+):(\d\d)(?::(\d\d))? ?(AM|PM)?", t):
        a, b, y, h, mi = map(int, m.groups()[:5])
        (d, mo), s, ap, z = ((a, b) if order == "dmy" else (b, a)), m[6], m[7], ""
    elif m := re.fullmatch(r"([A-Z][a-z]+) (\d+), (\d{4}) (\d+):(\d\d)(?::(\d\d))? (AM|PM) ?(.*)", t):
        mo, d, y, h, mi, s, ap, z = MON[m[1][:3].lower()], int(m[2]), int(m[3]), int(m[4]), int(m[5]), m[6], m[7], m[8]
    elif m := re.fullmatch(r"(?:\w{3}, )?(\d+) ([A-Z][a-z]+) (\d{4}) (?:at )?(\d+):(\d\d)(?::(\d\d))? ?(.*)", t):
        d, mo, y, h, mi, s, z = int(m[1]), MON[m[2][:3].lower()], int(m[3]), int(m[4]), int(m[5]), m[6], m[7]
    elif m := re.fullmatch(r"ika-(\d+) ng (\w+) (\d{4}), (\d+):(\d\d):(\d\d) (AM|PM)", t):
        d, mo, y, h, mi, s, ap, z = int(m[1]), TL[m[2].lower()], int(m[3]), int(m[4]), int(m[5]), m[6], m[7], ""
    else:
        return None
    if ap:
        h = h % 12 + 12 * (ap == "PM")
    try:
        wall = dt.datetime(y, mo, d, h, mi, int(s or 0))
    except ValueError:
        return None
    if z == "":
        zone = ZoneInfo(tz)
    elif "/" in z:
        zone = ZoneInfo(z)
    elif g := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d\d)?", z):
        zone = dt.timezone((1 if g[1] == "+" else -1) * dt.timedelta(hours=int(g[2]), minutes=int(g[3] or 0)))
    else:
        zone = dt.timezone.utc if z == "Z" else dt.timezone(dt.timedelta(hours=OFF[z]))
    return int(wall.replace(tzinfo=zone).timestamp()), "second" if s else "minute"


def test_whole_table_against_slow_parser(spark):
    from postloom.plans.instants import instants

    sf = "/root/testdata/sf0.01"
    got = {r.row_id: r for r in instants(spark, sf).collect()}
    walls = {r.source_code: (r.tz_name, r.date_order) for r in spark.read.parquet(f"{sf}/source_ref.parquet").collect()}
    rows = spark.read.parquet(f"{sf}/golden_input.parquet").select("row_id", "_test_source_code", "timestamp_iso", "timestamp_raw").collect()
    assert len(got) == len(rows) > 3000
    for r in rows:
        a, b = (slow(x, *walls[r["_test_source_code"]]) for x in (r.timestamp_iso, r.timestamp_raw))
        want = next((x[0] for x in (a, b) if x and x[1] == "second"), next((x[0] for x in (a, b) if x), None))
        assert got[r.row_id].epoch_s == want, r


@pytest.mark.parametrize(
    ("text", "tz", "order", "want"),
    [
        (None, "Asia/Manila", "mdy", None),
        ("", "Asia/Manila", "mdy", None),
        ("   ", "Asia/Manila", "mdy", None),
        ("3h", "Asia/Manila", "mdy", None),
        ("Yesterday at 5:14 PM", "Asia/Manila", "mdy", None),
        ("May be an image of 2 people", "Asia/Manila", "mdy", None),
        ("2024-06-02", "Asia/Manila", "mdy", None),
        ("2024-02-30 10:00:00", "Asia/Manila", "mdy", None),
        ("2024-06-02 25:00:00", "Asia/Manila", "mdy", None),
        ("13/13/2024 10:00:00", "Asia/Manila", "mdy", None),
        ("June 2, 2024 13:10 PM", "Asia/Manila", "mdy", None),
        ("June 2, 2024 1:10 PM XQZ", "Asia/Manila", "mdy", None),
        ("2024-06-02 10:00:00", None, "mdy", None),
        ("01/02/2024 00:00:00", "UTC", "dmy", 1706745600),
        ("01/02/2024 00:00:00", "UTC", "mdy", 1704153600),
        ("2024-02-29T23:59:59Z", "Asia/Manila", "mdy", 1709251199),
        ("1717226003.999", "Asia/Manila", "mdy", 1717226003),
        ("1717226003999", "Asia/Manila", "mdy", 1717226003),
        ("June 2, 2024 12:00 AM PST", "Asia/Manila", "mdy", 1717257600),
        ("June 2, 2024 12:00 AM PST", "America/New_York", "mdy", 1717315200),
        ("2024-06-16 01:33:59 America/New_York", "Asia/Manila", "mdy", 1718516039),
        ("March 10, 2024 2:30 AM", "America/New_York", "mdy", 1710055800),
        ("November 3, 2024 1:30 AM", "America/New_York", "mdy", 1730611800),
        ("1969-12-31 23:59:59 UTC", "Asia/Manila", "mdy", -1),
        ("x" * 100000, "Asia/Manila", "mdy", None),
    ],
)
def test_edges(spark, text, tz, order, want):
    df = spark.createDataFrame([(text, tz, order)], "s string, tz string, o string")
    assert parse_stamps(df, ["s"], "tz", "o").first().s_epoch == want


def test_finer_stamp_counts_and_empty_table(spark):
    df = spark.createDataFrame([("2024-06-01T10:00Z", "2024-06-01 10:00:30 UTC", "UTC", "mdy")], "a string, b string, tz string, o string")
    p = parse_stamps(df, ["a", "b"], "tz", "o").withColumn("e", one_instant(["a", "b"]))
    assert p.first().e == 1717236030
    assert p.limit(0).count() == 0
