"""Events over time: daily series, trailing windows, shares, alerts, feeds."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.functions.numbers import gini
from postloom.io import table
from postloom.operators import windows as win

DAY = 86400


def _events(spark: SparkSession, d: str):
    return table(spark, d, "events").withColumn("epoch", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint"))


def _daily(spark, d):
    return win.per_day(_events(spark, d), F.to_date("ts"), ["event_type"], F.col("value"))


def daily_rolling(spark, d):
    """Rolling mean over seven days of the daily means, on a dense axis."""
    dense = win.every_day(_daily(spark, d), ["event_type"])
    return win.rolling_mean(dense, ["event_type"], 7).select("event_type", F.col("day").cast("string").alias("day"), "n", F.round("mean", 4).alias("mean"), F.round("rolling", 4).alias("rolling"))


def quiet_spells(spark, d):
    """Runs of two or more days of a user group with less than three quarters of its usual volume."""
    e = _events(spark, d).withColumn("user_group", (F.col("user_id") % 20).cast("bigint"))
    dense = win.every_day(win.per_day(e, F.to_date("ts"), ["user_group"], F.col("value")), ["user_group"])
    s = win.quiet_spells(dense, ["user_group"], 2, 0.75)
    return s.select("user_group", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n_days")


def calendar(spark, d):
    """Events per calendar cell: week column and weekday from the first day on."""
    e = _daily(spark, d).groupBy("day").agg(F.sum("n").alias("n"))
    j = e.join(F.broadcast(e.agg(F.min("day").alias("first"))))  # one row
    offset = F.dayofweek("first") - 1 + F.datediff("day", "first")
    return j.select(F.col("day").cast("string").alias("day"), F.floor(offset / 7).cast("int").alias("week_col"), (F.dayofweek("day") - 1).alias("weekday"), "n")


def window_delta(spark, d):
    return win.window_delta(_events(spark, d), "epoch", F.col("value"), ["event_type"], 7, 20).select(
        "event_type", "n_now", "n_before", F.round("mean_now", 4).alias("mean_now"), F.round("mean_before", 4).alias("mean_before"), F.round("delta", 4).alias("delta")
    )


def week_figures(spark, d):
    """Events, distinct users and low values of the last seven days and of the seven before."""
    a = win.anchored(_events(spark, d), "epoch", [])
    week = F.when(F.col("age") < 7 * DAY, "now").when(F.col("age") < 14 * DAY, "before")
    return a.withColumn("week", week).where("week IS NOT NULL").groupBy("week").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("value") < 10).alias("n_low"))


def last_day_share(spark, d):
    """Share of each type in the last 24 hours."""
    a = win.anchored(_events(spark, d), "epoch", []).where(F.col("age") < DAY)
    n = a.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def scoped(spark, d):
    """Events of the last ten days whose properties hold a word, by type."""
    a = win.anchored(_events(spark, d), "epoch", []).where((F.col("age") <= 10 * DAY) & F.contains(F.lower("props"), F.lit("1")))
    return a.groupBy("event_type").agg(F.count("*").alias("n"))


def type_gini(spark, d):
    """How unevenly each type is spread over the days of the whole table, days without events included."""
    n = _daily(spark, d).select("event_type", "day", "n")
    days = n.agg(F.count_distinct("day").alias("days"))
    g = n.groupBy("event_type").agg(F.collect_list("n").alias("c")).join(F.broadcast(days))
    padded = F.concat("c", F.array_repeat(F.lit(0).cast("bigint"), (F.col("days") - F.size("c")).cast("int")))
    return g.select("event_type", F.round(gini(padded), 4).alias("gini"))


def concentrated_days(spark, d):
    n = _daily(spark, d).select("event_type", F.col("day").cast("string").alias("day"), "n")
    return win.concentrated(n, ["event_type"], "day", "n", 0.7)


def rule_alerts(spark, d):
    """Four rules over the last seven days as one union, worst first: high mean, one type dominating, many users, few events."""
    a = win.anchored(_events(spark, d), "epoch", []).where(F.col("age") < 7 * DAY)
    n = a.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.count_distinct("user_id").alias("u"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))
    rule = lambda name, rank, cond, value: n.where(cond).select(F.lit(name).alias("rule"), F.lit(rank).alias("rank"), "event_type", F.round(value, 4).alias("figure"))
    u = rule("high_mean", 1, "n >= 5 AND m > 50", F.col("m")).unionByName(rule("dominant", 0, "share >= 0.3", F.col("share")))
    u = u.unionByName(rule("wide", 2, "u >= 30", F.col("u").cast("double"))).unionByName(rule("thin", 2, "n < 20", F.col("n").cast("double")))
    return u.orderBy("rank", "rule", "event_type")


def leading_driver(spark, d):
    """The type with most events among those of high value, if it has five or more, and its share of them."""
    n = _events(spark, d).where("value >= 50").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))
    return n.where("n >= 5").orderBy(F.desc("n"), "event_type").limit(1)


def feed(spark, d):
    """The 60 events of highest value, newest first among equals."""
    return _events(spark, d).orderBy(F.desc(F.coalesce("value", F.lit(-99.0))), F.desc("epoch"), "event_id").limit(60).select("event_id", "event_type", "value")


def page_feed(spark, d):
    """The page's own feed: of the first 60 events in table order, the highest first."""
    first = _events(spark, d).orderBy("event_id").limit(60)
    return first.select("event_id", "value", F.row_number().over(W.orderBy(F.desc("value"), "event_id")).alias("place"))  # 60 rows


def top_users(spark, d):
    """The three users with most events of every type."""
    n = _events(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))).where("k <= 3")


def equal_bins(spark, d):
    """Ten bins of equal width over the whole time span."""
    e = _events(spark, d)
    j = e.join(F.broadcast(e.agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))))  # one row
    k = F.least(F.floor((F.col("epoch") - F.col("lo")) * 10 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(9)).cast("int")
    return j.groupBy("event_type", k.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def tumbling_day(spark, d):
    return _events(spark, d).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def sliding_week(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "7 days", "1 day")
    return _events(spark, d).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start_s"), "n")


def sessions(spark, d):
    """Sessions of a user: events no more than 30 minutes apart."""
    e = _events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("t"))
    s = e.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("most_events"))


def property_fields(spark, d):
    """The keys of the properties with the number of events and of distinct values."""
    m = _events(spark, d).select(F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return m.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("n_values"))


def star_revenue(spark, d):
    """Revenue by region and order year through the star schema."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    n = table(spark, d, "nation", "n_nationkey", "n_regionkey").join(table(spark, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("r_name", F.year("o_orderdate").alias("order_year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_lines"))


QUERIES = {
    f.__name__: f
    for f in (
        daily_rolling, quiet_spells, calendar, window_delta, week_figures, last_day_share, scoped, type_gini, concentrated_days, rule_alerts, leading_driver, feed, page_feed,
        top_users, equal_bins, tumbling_day, sliding_week, sessions, property_fields, star_revenue,
    )
}

_E = "e AS (SELECT *, floor(epoch_us(ts) / 1000000)::BIGINT AS epoch FROM events), top AS (SELECT max(epoch) AS top FROM e), aged AS (SELECT e.*, top - epoch AS age FROM e, top)"
_DAILY = "daily AS (SELECT event_type, ts::DATE AS day, count(*) AS n, avg(value) AS mean FROM events WHERE ts IS NOT NULL GROUP BY ALL)"
SQL = {
    "daily_rolling": f"""WITH {_DAILY}, sp AS (SELECT event_type, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY 1), x AS (SELECT sp.event_type, sp.day, coalesce(n, 0) AS n, mean FROM sp LEFT JOIN daily USING (event_type, day))
        SELECT event_type, day::VARCHAR AS day, n, round(mean, 4) AS mean, round(avg(mean) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling FROM x""",
    "quiet_spells": """WITH dl AS (SELECT user_id % 20 AS g, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), sp AS (SELECT g, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM dl GROUP BY 1),
        x AS (SELECT sp.g, sp.day, coalesce(n, 0) AS n FROM sp LEFT JOIN dl USING (g, day)), l AS (SELECT g, list_sort(list(n)) AS l FROM x WHERE n > 0 GROUP BY 1), lim AS (SELECT g, greatest(1.0, 0.75 * l[len(l) // 2 + 1]) AS lim FROM l),
        q AS (SELECT x.g, x.day, x.day - row_number() OVER (PARTITION BY x.g ORDER BY x.day)::INT AS run FROM x JOIN lim USING (g) WHERE n < lim)
        SELECT g AS user_group, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS n_days FROM q GROUP BY g, run HAVING count(*) >= 2""",
    "calendar": "WITH x AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), f AS (SELECT min(day) AS first FROM x) SELECT day::VARCHAR AS day, ((dayofweek(first) + (day - first)) // 7)::INT AS week_col, dayofweek(day)::INT AS weekday, n FROM x, f",
    "window_delta": """WITH e AS (SELECT *, floor(epoch_us(ts) / 1000000)::BIGINT AS epoch FROM events), a AS (SELECT e.*, max(epoch) OVER (PARTITION BY event_type) - epoch AS age FROM e),
        g AS (SELECT event_type, count(value) FILTER (age < 604800) AS n_now, count(value) FILTER (age >= 604800 AND age < 1209600) AS n_before, avg(value) FILTER (age < 604800) AS m, avg(value) FILTER (age >= 604800 AND age < 1209600) AS b FROM a GROUP BY 1)
        SELECT event_type, n_now, n_before, round(m, 4) AS mean_now, round(b, 4) AS mean_before, round(CASE WHEN n_now >= 20 AND n_before >= 20 THEN m - b END, 4) AS delta FROM g""",
    "week_figures": f"WITH {_E} SELECT CASE WHEN age < 604800 THEN 'now' ELSE 'before' END AS week, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (value < 10) AS n_low FROM aged WHERE age < 1209600 GROUP BY 1",
    "last_day_share": f"WITH {_E}, g AS (SELECT event_type, count(*) AS n FROM aged WHERE age < 86400 GROUP BY 1) SELECT event_type, n, round(n / sum(n) OVER (), 4) AS share FROM g",
    "scoped": f"WITH {_E} SELECT event_type, count(*) AS n FROM aged WHERE age <= 864000 AND contains(lower(props), '1') GROUP BY 1",
    "type_gini": f"""WITH {_DAILY}, days AS (SELECT DISTINCT day FROM daily), x AS (SELECT t.event_type, days.day, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM daily) t CROSS JOIN days LEFT JOIN daily USING (event_type, day)),
        r AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY n) AS i, count(*) OVER (PARTITION BY event_type) AS k FROM x)
        SELECT event_type, round(2 * sum(i * n) / (max(k) * sum(n)) - (max(k) + 1) / max(k), 4) AS gini FROM r GROUP BY 1""",
    "concentrated_days": f"""WITH {_DAILY}, r AS (SELECT event_type, day::VARCHAR AS day, n, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY n DESC, day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER (PARTITION BY event_type) AS t FROM daily)
        SELECT event_type, day, n FROM r WHERE b < 0.7 * t""",
    "rule_alerts": f"""WITH {_E}, g AS (SELECT event_type, count(*) AS n, avg(value) AS m, count(DISTINCT user_id) AS u FROM aged WHERE age < 604800 GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS share FROM g)
        SELECT 'high_mean' AS rule, 1 AS rank, event_type, round(m, 4) AS figure FROM s WHERE n >= 5 AND m > 50 UNION ALL SELECT 'dominant', 0, event_type, round(share, 4) FROM s WHERE share >= 0.3
        UNION ALL SELECT 'wide', 2, event_type, u::DOUBLE FROM s WHERE u >= 30 UNION ALL SELECT 'thin', 2, event_type, n::DOUBLE FROM s WHERE n < 20""",
    "leading_driver": "WITH g AS (SELECT event_type, count(*) AS n FROM events WHERE value >= 50 GROUP BY 1), s AS (SELECT event_type, n, round(n / sum(n) OVER (), 4) AS share FROM g) SELECT * FROM s WHERE n >= 5 ORDER BY n DESC, event_type LIMIT 1",
    "feed": "SELECT event_id, event_type, value FROM events ORDER BY coalesce(value, -99) DESC, floor(epoch_us(ts) / 1000000) DESC, event_id LIMIT 60",
    "page_feed": "SELECT event_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS place FROM (SELECT * FROM events ORDER BY event_id LIMIT 60)",
    "top_users": "SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS k FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) QUALIFY k <= 3",
    "equal_bins": "WITH e AS (SELECT *, floor(epoch_us(ts) / 1000000)::BIGINT AS epoch FROM events), l AS (SELECT min(epoch) AS lo, max(epoch) AS hi FROM e) SELECT event_type, least(((epoch - lo) * 10) // greatest(hi - lo, 1), 9)::INT AS bin, count(*) AS n, round(avg(value), 4) AS mean FROM e, l GROUP BY ALL",
    "tumbling_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sliding_week": "SELECT floor(epoch(ts::DATE))::BIGINT - 86400 * k AS start_s, count(*) AS n FROM events, (SELECT unnest(generate_series(0, 6)) AS k) GROUP BY 1",
    "sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x),
        g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS most_events FROM g GROUP BY 1""",
    "property_fields": "WITH m AS (SELECT unnest(map_entries(props::JSON::MAP(VARCHAR, VARCHAR))) AS e FROM events) SELECT e.key AS k, count(*) AS n, count(DISTINCT e.value) AS n_values FROM m GROUP BY 1",
    "star_revenue": """SELECT r_name, year(o_orderdate)::INT AS order_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
}
