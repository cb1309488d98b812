"""Cleaning, identity, duplicates and counts of posts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.functions import text as T
from postloom.functions.numbers import as_count
from postloom.io import table
from postloom.operators.dedup import keep_first, near_duplicate_classes, new_rows, rejected
from postloom.session import spread

# Function words by language for the ratio rules.
WORDS = {
    "en": (
        "the a an of to in is that this you i my with for on but not be have do does did are was were will would could should can it he she they them his her their our us we me "
        "from by as if so or and"
    ).split(),
    "tl": (
        "ang ng mga sa ay na at kasi talaga naman lang din rin yung ito ako ikaw siya kami tayo kayo sila po opo hindi oo wala may yan yun ba eh pala daw raw ano kung para bakit "
        "kaya gusto ayoko talagang kahit pero ngunit"
    ).split(),
    "ceb": (
        "akong imong iyang atong inyong ilang ako ikaw siya kami kita kamo sila ko nako nimo niya namo nato ninyo nila kay og ug diay gani gud gyud jud bitaw bay pud sad lagi bana "
        "uy hala unsa kinsa asa kanus-a ngano giunsa pila dili di ayaw walay way naa anaa naay basin tabangi tagaa tagai buot buhi kuyaw lami nindot kuan aron tungod samtang human "
        "nga dayon ato ila akoa imoha ihaha padong padayon manggi makig magpa mag"
    ).split(),
}
STOP = "the and for that this with was are but not you have they from will can our has had his her she him its all any were there their who what when how why very just about into than then them also been being did does doing".split()
TOP = 80
LINE = r"(?i)\bSubmitted\s*:[^\n]*"
LINK = r"(?i)https?://\S+"
MAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
TAG = r"#[A-Za-z0-9_]+"


def _posts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "golden_input", "row_id", *columns)


def _light(c):
    """The RE2-safe part of the noise rules."""
    for p in (LINE, LINK, MAIL, TAG):
        c = F.regexp_replace(c, p, "")
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r]+", " "))


def post_identity(spark, d):
    return _posts(spark, d, "text").select("row_id", T.content_id(F.col("text")).alias("content_id"))


def light_clean(spark, d):
    return _posts(spark, d, "text").select("row_id", _light(F.col("text")).alias("clean_text"))


def noise_clean(spark, d):
    """All noise rules, also those that need look-around and back references."""
    return _posts(spark, d, "text").select("row_id", T.noise_clean(F.col("text")).alias("clean_text"))


def reject_blank(spark, d):
    t = F.col("text")
    why = F.when(t.isNull(), "null_text").when(F.regexp_replace(t, "[ \\t\\n\\r]+", "") == "", "blank_text").otherwise("kept")
    return _posts(spark, d, "text").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def quality_gate(spark, d):
    clean = _light(F.coalesce(F.col("text"), F.lit("")))
    bare = F.trim(F.regexp_replace(clean, r"\[[A-Z][A-Z0-9_]*\]", ""))
    media = clean.rlike(r"(?i)^\s*(\[photo\]|\[video\]|\[image\]|\[redacted_name\])?\s*$")
    why = F.when(media, "pure_media").when(F.length(bare) < 10, "too_short").otherwise("kept")
    return _posts(spark, d, "text", "_test_source_code").groupBy(F.col("_test_source_code").alias("source_code"), why.alias("verdict")).agg(F.count("*").alias("n"))


def exact_dedup(spark, d):
    p = _posts(spark, d, "post_id", "text").withColumn("k", F.sha2(F.lower(F.trim("text")), 256))
    return keep_first(p.where("text IS NOT NULL"), ["k"], [F.col("row_id")]).select("row_id", "post_id")


def dedup_rejects(spark, d):
    p = _posts(spark, d, "post_id", "text").where("text IS NOT NULL").withColumn("k", F.sha2(F.lower(F.trim("text")), 256))
    return rejected(p, ["k"], [F.col("row_id")], "exact_duplicate", "text").select("row_id", "post_id", "reason", "text_preview")


def last_per_post(spark, d):
    p = _posts(spark, d, "post_id", "source", "engagement")
    return keep_first(p, ["post_id"], [F.desc("row_id")]).select("post_id", "row_id", "source", F.col("engagement.reactions").alias("reactions"))


def delta_append(spark, d):
    """Posts of the documents' sources that a first batch (the scraper's own) has not brought yet."""
    p = _posts(spark, d, "post_id", "source")
    return new_rows(p.where("source <> 'graphql'"), p.where("source = 'graphql'"), "post_id", [F.col("row_id")]).select("row_id", "post_id", "source")


def near_duplicates(spark, d):
    return near_duplicate_classes(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def engagement(spark, d):
    e = F.col("engagement")
    n = lambda c: F.coalesce(F.greatest(e[c], F.lit(0)), F.lit(0)).cast("bigint")
    p = _posts(spark, d, "_test_source_code", "engagement")
    sums = [F.sum(n(c)).alias(c) for c in ("reactions", "comments", "shares")]
    return p.groupBy(F.col("_test_source_code").alias("source_code")).agg(*sums, F.max(n("reactions")).alias("most_reactions"))


def counted_text(spark, d):
    """Counts written as text (as 1.2K) read back: from the page's own numbers, shortened."""
    r = F.col("engagement.reactions")
    shown = F.when(r % 3 == 0, F.concat(F.round(r / 1000, 1).cast("string"), F.lit("K"))).when(r % 3 == 1, r.cast("string")).otherwise(F.lit("n/a"))
    return _posts(spark, d, "engagement").groupBy((r % 3).alias("kind")).agg(F.sum(as_count(shown)).alias("total"))


def qc_counts(spark, d):
    """Posts and missing stamps by source, by region, by label and in all, as grouping sets of one aggregation."""
    p = _posts(spark, d, "_test_source_code", "lang_label", "timestamp_iso", "timestamp_raw").join(
        table(spark, d, "source_ref", "source_code", "region_label"), F.col("_test_source_code") == F.col("source_code"), "left"
    )
    p = p.withColumn("label", F.coalesce(F.lower(F.trim("lang_label")), F.lit("")))
    p.createOrReplaceTempView("_qc_posts")
    return spark.sql("""
        SELECT source_code, region_label, label, count(*) AS n, count_if(timestamp_iso IS NULL AND timestamp_raw IS NULL) AS n_without_stamp
        FROM _qc_posts GROUP BY GROUPING SETS ((source_code), (region_label), (label), ())""")


def unknown_sources(spark, d):
    """Source codes of documents without a target and targets without documents."""
    have, want = table(spark, d, "documents", "source").distinct(), table(spark, d, "mix_targets", "source")
    return have.exceptAll(want.distinct()).select("source", F.lit("no_target").alias("side")).unionByName(want.distinct().exceptAll(have).select("source", F.lit("no_documents").alias("side")))


def common_sources(spark, d):
    return table(spark, d, "documents", "source").intersect(table(spark, d, "mix_targets", "source"))


def row_limit(spark, d):
    """The first 50 rows of every source: a limit per file, as the feature has it."""
    w = W.partitionBy("_test_source_code").orderBy("row_id")
    return _posts(spark, d, "_test_source_code").withColumn("k", F.row_number().over(w)).where("k <= 50").select(F.col("_test_source_code").alias("source_code"), "row_id", "k")


def seeded_sample(spark, d):
    """1,500 rows in an order that only their ids and a seed decide: the plot's sample."""
    key = F.sha2(F.concat(F.lit("42/"), F.col("row_id").cast("string")), 256)
    return _posts(spark, d).orderBy(key, "row_id").limit(1500).select("row_id")


def pii_reject(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    mail, phone = t.rlike(MAIL), t.rlike(r"(\+?63|0)9[0-9]{2}[- ]?[0-9]{3}[- ]?[0-9]{4}")
    why = F.when(mail & phone, "both").when(mail, "email").when(phone, "phone").otherwise("none")
    return _posts(spark, d, "text").groupBy(why.alias("hit")).agg(F.count("*").alias("n"))


def stopword_counts(spark, d):
    tokens = _posts(spark, d, "text").select("row_id", T.words(F.col("text"), "[a-z'-]+").alias("ts"))
    hits = lambda ws: F.filter("ts", lambda t: t.isin(ws))
    parts = [F.struct(F.lit(lang).alias("lang"), hits(ws).alias("hits")) for lang, ws in WORDS.items()]
    each = tokens.select("row_id", F.explode(F.array(*parts)).alias("p")).select("row_id", "p.lang", F.explode("p.hits").alias("word"))
    return each.groupBy("lang", "word").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_posts"))


def _ratios(spark, d):
    tokens = _posts(spark, d, "text").select("row_id", T.words(F.col("text"), "[a-z']+").alias("ts"))
    n = F.size("ts")
    share = lambda lang: F.size(F.filter("ts", lambda t: t.isin(WORDS[lang]))) / F.greatest(n, F.lit(1))
    return tokens.select("row_id", n.alias("n_tokens"), *[share(lang).alias(lang) for lang in WORDS])


def language_ratios(spark, d):
    return _ratios(spark, d).select("row_id", "n_tokens", *[F.round(lang, 4).alias(f"{lang}_ratio") for lang in WORDS])


def language_rule(spark, d):
    """The cascade of ratio rules: dialect first, then mixture, then the denser language."""
    r = _ratios(spark, d)
    tl, en, ceb = F.col("tl"), F.col("en"), F.col("ceb")
    label = (
        F.when(F.col("n_tokens") < 4, "Unknown").when((ceb >= 0.05) & (ceb > tl), "Cebuano").when((tl >= 0.05) & (en >= 0.05), "Taglish")
        .when((tl > en) & (tl >= 0.03), "Filipino").when(en > tl, "English").otherwise("Other")
    )
    return r.groupBy(label.alias("language")).agg(F.count("*").alias("n"))


def chart_terms(spark, d):
    terms = spread(_posts(spark, d, "text"), "row_id").select(F.explode(T.chart_terms(F.col("text"), STOP)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(TOP)


def repeat_collapse(spark, d):
    return _posts(spark, d, "text").select("row_id", T.collapse_repeats(F.col("text")).alias("short_text"))


def truncated(spark, d):
    t = F.col("text")
    return _posts(spark, d, "text").select("row_id", T.tail(t, 60, " [cut]").alias("tail_text"), T.head(t, 40).alias("head_text"))


def redacted_words(spark, d):
    """The listed flag terms as tags, with the number of replacements."""
    terms = [r.term for r in table(spark, d, "flag_terms").where("term IS NOT NULL").select("term").distinct().toLocalIterator()]  # a fixed list
    pattern = T.any_word(terms)
    p = _posts(spark, d, "text").where("text IS NOT NULL")
    return p.select("row_id", T.redact_words(F.col("text"), terms, "[TERM]").alias("redacted_text"), T.count_matches(F.col("text"), pattern).alias("n_terms"))


def nested_documents(spark, d):
    """One nested record per source: its kinds with counts, largest first."""
    n = table(spark, d, "documents", "source", "doc_kind").groupBy("source", "doc_kind").agg(F.count("*").alias("n"))
    kinds = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.coalesce("doc_kind", F.lit("")).alias("kind"), "n")))
    return n.groupBy("source").agg(F.sum("n").alias("n_docs"), F.to_json(F.transform(kinds, lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n")))).alias("kinds"))


QUERIES = {
    f.__name__: f
    for f in (
        post_identity, light_clean, noise_clean, reject_blank, quality_gate, exact_dedup, dedup_rejects, last_per_post, delta_append, near_duplicates, engagement,
        counted_text, qc_counts, unknown_sources, common_sources, row_limit, seeded_sample, pii_reject, stopword_counts, language_ratios, language_rule,
        chart_terms, repeat_collapse, truncated, redacted_words, nested_documents,
    )
}

_CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\\bSubmitted\\s*:[^\\n]*', '', 'gi'), 'https?://\\S+', '', 'gi'), "
    f"'{MAIL}', '', 'g'), '{TAG}', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ')"
)
_CLEAN_TEXT = _CLEAN.format(t="text")
_CLEAN_ANY = _CLEAN.format(t="coalesce(text, '')")
_IN = {k: ", ".join("'" + w.replace("'", "''") + "'" for w in v) for k, v in WORDS.items()}
_TOKENS = "SELECT row_id, regexp_extract_all(lower(coalesce(text, '')), '{p}') AS ts FROM golden_input"
_RATIO = (
    "r AS (SELECT row_id, len(ts) AS n_tokens, "
    + ", ".join(f"len(list_filter(ts, lambda x: x IN ({_IN[k]}))) / greatest(len(ts), 1) AS {k}" for k in WORDS)
    + " FROM (" + _TOKENS.format(p="[a-z'']+") + "))"
)
_SHINGLE_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ws FROM documents),
k AS (SELECT doc_id, ws, sha256(array_to_string(ws, ' ')) AS k, min(doc_id) OVER (PARTITION BY sha256(array_to_string(ws, ' '))) AS head FROM t),
h AS (SELECT doc_id, ws FROM k WHERE doc_id = head AND len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM h)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8),
bi AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT u, u AS v FROM bi UNION SELECT r.u, b.v FROM reach r JOIN bi b ON r.v = b.u),
root AS (SELECT u, min(v) AS root FROM reach GROUP BY u),
deg AS (SELECT u, count(DISTINCT v) AS n_links FROM bi GROUP BY u)
SELECT k.doc_id, k.head AS copy_of, coalesce(root.root, k.head) AS class_id, coalesce(deg.n_links, 0) AS n_links
FROM k LEFT JOIN root ON root.u = k.head LEFT JOIN deg ON deg.u = k.head"""
_STOP_IN = ", ".join(f"'{w}'" for w in STOP)

SQL = {
    "post_identity": "SELECT row_id, substr(sha256(lower(trim(text, ' '))), 1, 16) AS content_id FROM golden_input",
    "light_clean": f"SELECT row_id, {_CLEAN_TEXT} AS clean_text FROM golden_input",
    "reject_blank": "SELECT CASE WHEN text IS NULL THEN 'null_text' WHEN regexp_replace(text, '[ \\t\\n\\r]+', '', 'g') = '' THEN 'blank_text' ELSE 'kept' END AS reason, count(*) AS n FROM golden_input GROUP BY 1",
    "quality_gate": f"""WITH c AS (SELECT _test_source_code AS source_code, {_CLEAN_ANY} AS t FROM golden_input)
        SELECT source_code, CASE WHEN regexp_matches(t, '^\\s*(\\[photo\\]|\\[video\\]|\\[image\\]|\\[redacted_name\\])?\\s*$', 'i') THEN 'pure_media'
        WHEN length(trim(regexp_replace(t, '\\[[A-Z][A-Z0-9_]*\\]', '', 'g'), ' ')) < 10 THEN 'too_short' ELSE 'kept' END AS verdict, count(*) AS n FROM c GROUP BY ALL""",
    "exact_dedup": "SELECT row_id, post_id FROM golden_input WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(text, ' ')) ORDER BY row_id) = 1",
    "dedup_rejects": "SELECT row_id, post_id, 'exact_duplicate' AS reason, substr(text, 1, 120) AS text_preview FROM golden_input WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(text, ' ')) ORDER BY row_id) > 1",
    "last_per_post": "SELECT post_id, row_id, source, engagement.reactions AS reactions FROM golden_input QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY row_id DESC) = 1",
    "delta_append": """SELECT row_id, post_id, source FROM golden_input WHERE source <> 'graphql' AND post_id NOT IN (SELECT post_id FROM golden_input WHERE source = 'graphql')
        QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY row_id) = 1""",
    "near_duplicates": _SHINGLE_SQL,
    "engagement": """SELECT _test_source_code AS source_code, sum(coalesce(greatest(engagement.reactions, 0), 0))::BIGINT AS reactions, sum(coalesce(greatest(engagement.comments, 0), 0))::BIGINT AS comments,
        sum(coalesce(greatest(engagement.shares, 0), 0))::BIGINT AS shares, max(coalesce(greatest(engagement.reactions, 0), 0))::BIGINT AS most_reactions FROM golden_input GROUP BY 1""",
    "counted_text": """SELECT engagement.reactions % 3 AS kind, sum(CASE WHEN engagement.reactions % 3 = 0 THEN greatest(0, (round(engagement.reactions / 1000, 1) * 1000)::BIGINT)
        WHEN engagement.reactions % 3 = 1 THEN greatest(0, engagement.reactions) ELSE 0 END)::BIGINT AS total FROM golden_input GROUP BY 1""",
    "qc_counts": """SELECT source_code, region_label, label, count(*) AS n, count(*) FILTER (timestamp_iso IS NULL AND timestamp_raw IS NULL) AS n_without_stamp
        FROM (SELECT s.source_code, s.region_label, coalesce(lower(trim(lang_label, ' ')), '') AS label, timestamp_iso, timestamp_raw FROM golden_input LEFT JOIN source_ref s ON _test_source_code = s.source_code)
        GROUP BY GROUPING SETS ((source_code), (region_label), (label), ())""",
    "unknown_sources": """SELECT source, 'no_target' AS side FROM (SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM mix_targets)
        UNION ALL SELECT source, 'no_documents' FROM (SELECT source FROM mix_targets EXCEPT SELECT source FROM documents)""",
    "common_sources": "SELECT source FROM documents INTERSECT SELECT source FROM mix_targets",
    "row_limit": "SELECT _test_source_code AS source_code, row_id, row_number() OVER (PARTITION BY _test_source_code ORDER BY row_id) AS k FROM golden_input QUALIFY k <= 50",
    "seeded_sample": "SELECT row_id FROM golden_input ORDER BY sha256('42/' || row_id), row_id LIMIT 1500",
    "pii_reject": f"""SELECT CASE WHEN m AND p THEN 'both' WHEN m THEN 'email' WHEN p THEN 'phone' ELSE 'none' END AS hit, count(*) AS n FROM (
        SELECT regexp_matches(coalesce(text, ''), '{MAIL}') AS m, regexp_matches(coalesce(text, ''), '(\\+?63|0)9[0-9]{{2}}[- ]?[0-9]{{3}}[- ]?[0-9]{{4}}') AS p FROM golden_input) GROUP BY 1""",
    "stopword_counts": "WITH t AS (SELECT row_id, unnest(ts) AS word FROM (" + _TOKENS.format(p="[a-z''-]+") + ")) "
    + " UNION ALL ".join(f"SELECT '{k}' AS lang, word, count(*) AS n, count(DISTINCT row_id) AS n_posts FROM t WHERE word IN ({v}) GROUP BY word" for k, v in _IN.items()),
    "language_ratios": "WITH " + _RATIO + " SELECT row_id, n_tokens, round(en, 4) AS en_ratio, round(tl, 4) AS tl_ratio, round(ceb, 4) AS ceb_ratio FROM r",
    "language_rule": "WITH " + _RATIO + """ SELECT CASE WHEN n_tokens < 4 THEN 'Unknown' WHEN ceb >= 0.05 AND ceb > tl THEN 'Cebuano' WHEN tl >= 0.05 AND en >= 0.05 THEN 'Taglish'
        WHEN tl > en AND tl >= 0.03 THEN 'Filipino' WHEN en > tl THEN 'English' ELSE 'Other' END AS language, count(*) AS n FROM r GROUP BY 1""",
    "chart_terms": f"""WITH a AS (SELECT unnest(string_split_regex(trim(replace(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), '\\[[A-Z_]+\\]', ' ', 'gi'), 'https?://\\S+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\s'']', ' ', 'g'), '''', ''), ' '), '\\s+')) AS w FROM golden_input),
        b AS (SELECT w FROM a WHERE length(w) >= 3 AND w NOT IN ({_STOP_IN}) AND NOT regexp_full_match(w, '[0-9]+')),
        c AS (SELECT CASE WHEN length(w) < 4 THEN w WHEN w = 'children' THEN 'child' WHEN w = 'men' THEN 'man' WHEN w = 'women' THEN 'woman' WHEN w = 'people' THEN 'person' WHEN w = 'feet' THEN 'foot'
          WHEN w = 'teeth' THEN 'tooth' WHEN w = 'mice' THEN 'mouse' WHEN w = 'geese' THEN 'goose' WHEN w LIKE '%ies' AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y')
          WHEN regexp_matches(w, '(sses|ches|shes|xes)$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^sui]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS term FROM b)
        SELECT term, count(*) AS n FROM c WHERE length(term) >= 3 AND term NOT IN ({_STOP_IN}) GROUP BY 1 ORDER BY n DESC, term LIMIT {TOP}""",
    "truncated": "SELECT row_id, CASE WHEN length(text) > 60 THEN right(text, 60) || ' [cut]' ELSE text END AS tail_text, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS head_text FROM golden_input",
    "nested_documents": """WITH n AS (SELECT source, coalesce(doc_kind, '') AS kind, count(*) AS n FROM documents GROUP BY ALL)
        SELECT source, sum(n)::BIGINT AS n_docs, '[' || string_agg('{"kind":"' || kind || '","n":' || n || '}', ',' ORDER BY n DESC, kind) || ']' AS kinds FROM n GROUP BY 1""",
}
