"""The whole cleaning of posts: select, anonymise, remove noise, redact names, coerce, date, label, gate, deduplicate.

``clean`` runs any subset of the phases; every row that a phase turns away keeps its reason. What is kept has the seven
final columns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.functions.jsonx import nfkc
from postloom.io import table
from postloom.operators.anonymise import Rule, anonymised, load_schools, masked, rule_table, unmasked
from postloom.operators.dedup import keep_first, near_dedupe, without
from postloom.plans import instants
from postloom.plans.posts import _IN, WORDS
from postloom.session import materialise, spread

#: The made-up schools of this project's walls.
SCHOOLS = """
schools:
- {acronym: LIR, region: Hilaga, hashtag: '#Lirangan(?:CampusWall|FreedomWall|FW)\\d+', names: [Lirangan State University, Lirangan], markers: [{phrase: Science Hall}], cheers: [go lir], skip_acronym: true}
- {acronym: BAG, region: Hilaga, hashtag: '#Bagwisan(?:CampusWall|FreedomWall|FW)\\d+', names: [Bagwisan], markers: [{phrase: Main Building}], skip_acronym: true}
- {acronym: AMI, region: Gitna, hashtag: '#Amihara(?:CampusWall|FreedomWall|FW)\\d+', names: [Amihara], markers: [{phrase: computer lab, region_stands_in: false}], case_sensitive: true}
- {acronym: TUM, region: Gitna, hashtag: '#Tumalok(?:CampusWall|FreedomWall|FW)\\d+', names: [Tumalok], cheers: [lugaw]}
- {acronym: NSTP, region: Timog, hashtag: '#Sulimat(?:CampusWall|FreedomWall|FW)\\d+', names: [Sulimat], case_sensitive: true}
- {acronym: PE, region: Timog, hashtag: '#Pintahan(?:CampusWall|FreedomWall|FW)\\d+', names: [Pintahan], case_sensitive: true}
- {acronym: EAS, region: Timog, hashtag: '#Eastbridge(?:CampusWall|FreedomWall|FW)\\d+', names: [Eastbridge College, Eastbridge], markers: [{phrase: library}]}
ambiguous_cheers: [wallet, lugaw]
"""
DEPARTMENTS = ["CS", "CE", "ACCT", "ECON", "ARCH", "PSYCH"]
FINAL = ["post_id", "source_code", "text", "engagement", "timestamp_unix", "region", "language_detected"]
ALL = "1-10"
WITHOUT_FORMS = "1-4,6-10"  # all phases but the normalisation forms


def phases(text: str) -> set[int]:
    """``1-3,7,9`` as a set; blanks and empty parts are passed over."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        lo, dash, hi = part.partition("-")
        out |= set(range(int(lo), int(hi) + 1)) if dash else {int(lo)}
    return out


def _rules() -> list[Rule]:
    return rule_table(*load_schools(SCHOOLS))


def _names(spark: SparkSession, d: str) -> list[str]:
    return [r.given_name for r in table(spark, d, "given_names").where("given_name IS NOT NULL").select("given_name").distinct().toLocalIterator()]  # a fixed list


def redact(col: Column, names: list[str]) -> Column:
    """Titles with names, listed given names (as written, whole words) and departments as tags; repeated tags as one."""
    by_list = rf"\b(?:{'|'.join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))})\b"
    named = F.regexp_replace(T.redact_titles(col), by_list, "[REDACTED_NAME]") if names else T.redact_titles(col)
    return T.collapse_tags(T.redact_departments(named, DEPARTMENTS))


def gate(text: Column) -> Column:
    """Why a cleaned text is turned away, else null."""
    bare = F.trim(F.regexp_replace(text, T.PLACEHOLDER, ""))
    return F.when(text.rlike(T.PURE_MEDIA), "pure_media").when(F.length(bare) < 10, "too_short")


def language(text: Column) -> Column:
    """The language by the share of its function words."""
    ts = T.words(text, "[a-z']+")
    share = lambda w: F.size(F.filter(ts, lambda t: t.isin(w))) / F.greatest(F.size(ts), F.lit(1))
    tl, en, ceb = (share(WORDS[k]) for k in ("tl", "en", "ceb"))
    return (
        F.when(F.size(ts) < 4, "Unknown").when((ceb >= 0.05) & (ceb > tl), "Cebuano").when((tl >= 0.05) & (en >= 0.05), "Taglish")
        .when((tl > en) & (tl >= 0.03), "Filipino").when(en > tl, "English").otherwise("Other")
    )


def clean(spark: SparkSession, d: str, which: str = ALL) -> DataFrame:
    """Every post after the phases of ``which``, with ``reason`` (null: kept): 1 select, 2 anonymise, 3 noise, 4 names, 5 forms,
    6 stop words (counted elsewhere), 7 engagement, 8 instants, 9 language, 10 gate, region and exact duplicates."""
    on = phases(which)
    p = spread(table(spark, d, "golden_input", "row_id", "post_id", "_test_source_code", "text", "engagement"), "row_id").withColumnRenamed("_test_source_code", "source_code")
    raw = F.col("text")
    blank = raw.isNull() | (T.strip(nfkc(F.coalesce(raw, F.lit("")))) == "")
    p = p.withColumn("reason", F.when(blank, F.when(raw.isNull(), "null_text").otherwise("blank_text")) if 1 in on else F.lit(None).cast("string"))
    text = nfkc(raw) if 5 in on else raw
    p = p.withColumn("text", F.coalesce(text, F.lit("")))
    p = p.withColumn("anon", anonymised(F.col("text"), _rules() if 2 in on else []))
    cleaned = F.col("anon.text")
    if 3 in on:
        cleaned = T.noise_clean(cleaned)
    if 4 in on:
        cleaned = redact(cleaned, _names(spark, d))
    p = p.withColumn("text", cleaned).withColumn("regions", F.col("anon.regions")).drop("anon")
    if 7 in on:
        n = lambda c: F.coalesce(F.greatest(F.col("engagement")[c], F.lit(0)), F.lit(0)).alias(c)
        p = p.withColumn("engagement", F.struct(n("reactions"), n("comments"), n("shares")))
    if 8 in on:
        p = p.join(instants.found(spark, d).select("row_id", F.col("epoch_s").alias("timestamp_unix")), "row_id", "left")
    else:
        p = p.withColumn("timestamp_unix", F.lit(None).cast("bigint"))
    p = p.withColumn("language_detected", language(F.col("text")) if 9 in on else F.lit("Unknown"))
    ref = table(spark, d, "source_ref", "source_code", F.col("region_label").alias("region"))
    p = p.join(F.broadcast(ref), "source_code", "left")  # one row per source, a fixed table
    if 10 in on:
        p = p.withColumn("reason", F.coalesce("reason", gate(F.col("text")), F.when(F.col("source_code").isNull(), "no_source_code").when(F.col("region").isNull(), "no_region_assignable")))
        # The first of equal cleaned texts, over all sources in the order of their files.
        firsts = keep_first(p.where("reason IS NULL").select("row_id", "source_code", F.sha2(F.lower(F.trim("text")), 256).alias("k")), ["k"], [F.asc("source_code"), F.asc("row_id")])
        p = p.join(firsts.select("row_id", F.lit(True).alias("first")), "row_id", "left")
        p = p.withColumn("reason", F.coalesce("reason", F.when(F.col("first").isNull(), "exact_duplicate"))).drop("first")
    return p


def clean_posts(spark, d):
    """What is kept of all posts, in the final columns."""
    p = clean(spark, d, WITHOUT_FORMS).where("reason IS NULL")
    e = [F.col("engagement")[c].alias(c) for c in ("reactions", "comments", "shares")]
    return p.select(*[c for c in FINAL if c != "engagement"], *e)


def clean_rejects(spark, d):
    """Every row that is turned away, with its reason and the head of its text."""
    return clean(spark, d, WITHOUT_FORMS).where("reason IS NOT NULL").select("row_id", "post_id", "source_code", "reason", F.left("text", F.lit(60)).alias("text_preview"))


def clean_report(spark, d):
    """Kept and rejected rows, rows without an instant, and what regions the kept texts name, by source."""
    p = clean(spark, d, WITHOUT_FORMS)
    kept = F.col("reason").isNull()
    own = F.col("regions") == F.array("region")
    return p.groupBy("source_code", "region").agg(
        F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_rejected"), F.count_if(kept & F.col("timestamp_unix").isNull()).alias("n_without_instant"),
        F.count_if(kept & (F.size("regions") == 0)).alias("names_none"), F.count_if(kept & (F.size("regions") > 0) & own).alias("names_own"),
        F.count_if(kept & (F.size("regions") > 0) & ~own).alias("names_other"),
    )


def clean_fully(spark, d):
    """With all phases, normalisation forms included, and near-duplicates turned away after the exact ones."""
    p = materialise(clean(spark, d, ALL).where("reason IS NULL").select(F.col("row_id").alias("id"), *FINAL), "cleaned")
    return without(p, near_dedupe(p, "id", "text").where("NOT kept").select("id")).select(*FINAL)


def near_dedupe_documents(spark, d):
    """The documents that greedy near-duplicate removal keeps and drops: three-word shingles, similarity of 0.9."""
    return near_dedupe(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def anonymised_posts(spark, d):
    """Texts after all rules, the labels of the rules that matched and the regions that they name."""
    a = anonymised(F.col("text"), _rules())
    p = spread(table(spark, d, "golden_input", "row_id", "text").where("text IS NOT NULL"), "row_id").withColumn("a", a)
    return p.select("row_id", F.col("a.text").alias("anonymised_text"), F.array_join("a.labels", ",").alias("labels"), F.array_join("a.regions", ",").alias("regions"))


def redacted_names(spark, d):
    """Titles, listed names and departments as tags."""
    p = spread(table(spark, d, "golden_input", "row_id", "text").where("text IS NOT NULL"), "row_id")
    return p.select("row_id", redact(F.col("text"), _names(spark, d)).alias("redacted_text"))


def mask_round_trip(spark, d):
    """Redacted texts whose tags were hidden and put back: how many, how many held tags, how many came back unchanged."""
    p = redacted_names(spark, d)
    hidden, tags = masked(F.col("redacted_text"))
    back = p.withColumn("hidden", hidden).withColumn("tags", tags)
    return back.agg(F.count("*").alias("n"), F.count_if(F.size("tags") > 0).alias("n_tagged"), F.count_if(unmasked(F.col("hidden"), F.col("tags")) == F.col("redacted_text")).alias("n_same"))


QUERIES = {f.__name__: f for f in (clean_posts, clean_rejects, clean_report, clean_fully, near_dedupe_documents, anonymised_posts, redacted_names, mask_round_trip)}

# ---- SQL. RE2 has neither look-around nor back references: edges of words are matched and put back, in two passes since two
# neighbours may share an edge; runs of a character are cut by lists of characters.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _twice(t: str, pattern: str, to: str, flags: str) -> str:
    once = lambda x: f"regexp_replace({x}, '{_q(pattern)}', '\\1{_q(to)}\\2', '{flags}')"
    return once(once(t))


def _edged(r: Rule) -> str:
    return rf"(^|[^{'#' if r.kind == 'acronym' else ''}{_W}]){re.escape(r.what)}($|[^{_W}])"


def _anonymised_sql() -> str:
    steps = ["a0 AS (SELECT row_id, coalesce(text, '') AS t, []::VARCHAR[] AS l, []::VARCHAR[] AS g FROM golden_input)"]
    for i, r in enumerate(_rules()):
        flags = "gi" if r.any_case else "g"
        pattern = r.what if r.kind == "tag" else _edged(r)
        to = f"regexp_replace(t, '{_q(pattern)}', '{_q(r.to)}', '{flags}')" if r.kind == "tag" else _twice("t", pattern, r.to, flags)
        hit = f"regexp_matches(t, '{_q(pattern)}'{', ' + chr(39) + 'i' + chr(39) if r.any_case else ''})"
        more = f"CASE WHEN {hit} THEN list_append(g, '{r.region}') ELSE g END" if r.region else "g"
        steps.append(f"a{i + 1} AS (SELECT row_id, {to} AS t, CASE WHEN {hit} THEN list_append(l, '{_q(r.label)}') ELSE l END AS l, {more} AS g FROM a{i})")
    return ", ".join(steps) + f", anon AS (SELECT row_id, t, l, list_sort(list_distinct(g)) AS g FROM a{len(_rules())})"


def _noise_sql(t: str) -> str:
    """The steps of noise_clean but the cut of runs, which needs a list of its own; see _NOISE."""
    n = T.NOISE
    i = lambda x, p: f"regexp_replace({x}, '{_q(p.removeprefix('(?i)'))}', '', 'gi')"
    g = lambda x, p: f"regexp_replace({x}, '{_q(p)}', '', 'g')"
    x = i(i(i(i(t, n["footer"]), n["stamp"]), n["see_more"]), n["url"])
    x = g(x, rf"[{_W}][{_W}.+-]*@[{_W}-]+\.[{_W}.-]*[{_W}]")
    x = g(x, n["phone"])
    x = _twice(x, rf"(^|[^{_W}])\p{{Nd}}{{4,}}($|[^{_W}])", "", "g")
    return g(x, rf"#[{_W}]+")


def _squeezed(t: str) -> str:
    return f"trim(regexp_replace({t}, '[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', ' ', 'g'), ' ')"


def _noise_ctes(source: str, name: str) -> str:
    """From (row_id, t) to the cleaned (row_id, t)."""
    chars = f"{name}1 AS (SELECT row_id, string_split({_noise_sql('t')}, '') AS c FROM {source})"
    runs = f"{name}2 AS (SELECT row_id, array_to_string(list_filter(c, lambda x, i: i <= 3 OR x = chr(10) OR NOT (c[i - 1] = x AND c[i - 2] = x AND c[i - 3] = x)), '') AS t FROM {name}1)"
    dots = f"regexp_replace(t, '\\s*\\.{{3,}}\\s*$', '')"
    return f"{chars}, {runs}, {name} AS (SELECT row_id, {_squeezed(dots)} AS t FROM {name}2)"


_TAGS = ["REDACTED_NAME", "DEPARTMENT", "photo", "video", "image", "Hilaga", "Gitna", "Timog"]


def _redacted_sql(t: str) -> str:
    names = "(SELECT '\\b(?:' || string_agg(n, '|' ORDER BY length(n) DESC, n) || ')\\b' FROM (SELECT DISTINCT given_name AS n FROM given_names WHERE given_name IS NOT NULL))"
    x = f"regexp_replace({t}, '{_q(T.TITLE_NAME)}', '[REDACTED_NAME]', 'g')"
    x = f"regexp_replace({x}, {names}, '[REDACTED_NAME]', 'g')"
    x = f"regexp_replace({x}, '{_q(T.DEPARTMENT.removeprefix('(?i)'))}', '[DEPARTMENT]', 'gi')"
    x = _twice(x, rf"(^|[^#{_W}])(?:{'|'.join(sorted(DEPARTMENTS, key=lambda a: (-len(a), a)))})($|[^{_W}])", "[DEPARTMENT]", "g")
    return reduce(lambda y, tag: f"regexp_replace({y}, '\\[{tag}\\](?:\\s+\\[{tag}\\])+', '[{tag}]', 'g')", _TAGS, x)


def _language_sql(t: str) -> str:
    share = {k: f"len(list_filter(ts, lambda x: x IN ({_IN[k]}))) / greatest(len(ts), 1)" for k in WORDS}
    return f"""SELECT *, CASE WHEN n < 4 THEN 'Unknown' WHEN ceb >= 0.05 AND ceb > tl THEN 'Cebuano' WHEN tl >= 0.05 AND en >= 0.05 THEN 'Taglish' WHEN tl > en AND tl >= 0.03 THEN 'Filipino'
        WHEN en > tl THEN 'English' ELSE 'Other' END AS language FROM (SELECT *, len(ts) AS n, {", ".join(f"{v} AS {k}" for k, v in share.items())}
        FROM (SELECT row_id, regexp_extract_all(lower(t), '[a-z'']+') AS ts FROM {t}))"""


_CLEAN = f"""{_anonymised_sql()}, {_noise_ctes("anon", "nz")}, red AS MATERIALIZED (SELECT row_id, {_redacted_sql("t")} AS t FROM nz), lang AS ({_language_sql("red")}),
inst AS (SELECT row_id, epoch_s FROM ({instants.SQL["p6_found"]})),
judged AS (SELECT g.row_id, g.post_id, g._test_source_code AS source_code, red.t AS text, anon.g AS regions, s.region_label AS region, epoch_s AS timestamp_unix, language AS language_detected,
  coalesce(greatest(engagement.reactions, 0), 0) AS reactions, coalesce(greatest(engagement.comments, 0), 0) AS comments, coalesce(greatest(engagement.shares, 0), 0) AS shares,
  CASE WHEN g.text IS NULL THEN 'null_text' WHEN regexp_replace(g.text, '[\\s\\p{{Z}}\\x{{0b}}\\x{{85}}]+', '', 'g') = '' THEN 'blank_text'
    WHEN regexp_matches(red.t, '^\\s*(\\[photo\\]|\\[video\\]|\\[image\\]|\\[REDACTED_NAME\\])?\\s*$', 'i') THEN 'pure_media'
    WHEN length(trim(regexp_replace(red.t, '\\[[A-Z][A-Z0-9_]*\\]', '', 'g'), ' ')) < 10 THEN 'too_short'
    WHEN g._test_source_code IS NULL THEN 'no_source_code' WHEN s.region_label IS NULL THEN 'no_region_assignable' END AS why
  FROM golden_input g JOIN red USING (row_id) JOIN anon USING (row_id) JOIN lang USING (row_id) LEFT JOIN inst USING (row_id) LEFT JOIN source_ref s ON s.source_code = g._test_source_code),
done AS MATERIALIZED (SELECT *, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY why IS NULL, lower(trim(text, ' ')) ORDER BY source_code, row_id) > 1 THEN 'exact_duplicate' END) AS reason FROM judged)"""
SQL = {
    "clean_posts": f"WITH {_CLEAN} SELECT post_id, source_code, text, timestamp_unix, region, language_detected, reactions, comments, shares FROM done WHERE reason IS NULL",
    "clean_rejects": f"WITH {_CLEAN} SELECT row_id, post_id, source_code, reason, left(text, 60) AS text_preview FROM done WHERE reason IS NOT NULL",
    "clean_report": f"""WITH {_CLEAN} SELECT source_code, region, count(*) FILTER (reason IS NULL) AS n_kept, count(*) FILTER (reason IS NOT NULL) AS n_rejected,
        count(*) FILTER (reason IS NULL AND timestamp_unix IS NULL) AS n_without_instant, count(*) FILTER (reason IS NULL AND len(regions) = 0) AS names_none,
        count(*) FILTER (reason IS NULL AND regions = [region]) AS names_own, count(*) FILTER (reason IS NULL AND len(regions) > 0 AND regions <> [region]) AS names_other FROM done GROUP BY 1, 2""",
    "anonymised_posts": f"WITH {_anonymised_sql()} SELECT row_id, t AS anonymised_text, array_to_string(l, ',') AS labels, array_to_string(g, ',') AS regions FROM anon JOIN golden_input USING (row_id) WHERE text IS NOT NULL",
    "redacted_names": f"SELECT row_id, {_redacted_sql('text')} AS redacted_text FROM golden_input WHERE text IS NOT NULL",
    "mask_round_trip": f"SELECT count(*) AS n, count(*) FILTER (regexp_matches(r, '\\[[A-Z][A-Z0-9_]*\\]')) AS n_tagged, count(*) AS n_same FROM (SELECT {_redacted_sql('text')} AS r FROM golden_input WHERE text IS NOT NULL)",
    "noise_clean": f"WITH src AS (SELECT row_id, text AS t FROM golden_input), {_noise_ctes('src', 'nz')} SELECT src.row_id, CASE WHEN src.t IS NOT NULL THEN nz.t END AS clean_text FROM src JOIN nz USING (row_id)",
    "repeat_collapse": """SELECT row_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_filter(c, lambda x, i: i <= 3 OR x = chr(10) OR NOT (c[i - 1] = x AND c[i - 2] = x AND c[i - 3] = x)), '') END AS short_text
        FROM (SELECT row_id, text, string_split(text, '') AS c FROM golden_input)""",
}
