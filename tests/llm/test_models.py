"""Problems 3, 5 and 7: held-out accuracy on made-up text, and edges."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postloom.llm import content as ct
from postloom.llm import languages as lg
from postloom.llm import personal as ps

# ---- problem 3


def test_skeletons():
    t = lambda s: ct.tokens(s)
    assert t("B0b0 ka") == t("bobo ka") and t("g@g0") == t("gago") and t("gaaago") == t("gago") and t("l i b o g") == t("libog") == t("l-i-b-o-g") == t("l*i*b*o*g")
    assert t("li­b​og") == t("libog") and t(None) == [] and t("") == [] and t("#Tag1 x") == ["x"]
    v = ct.Vocabulary({"gago": 3, "gabi": 1})
    assert v.resolve("ga*o") == "gago" and v.resolve("gab*") == "gabi" and v.resolve("plain") == "plain" and v.resolve("zz*z") == "zzz"
    assert ct.pieces("#Wall12 Isa. Dalawa!\nTatlo") == ["Isa. ", "Dalawa!\n", "Tatlo"] and ct.pieces(None) == []


@pytest.mark.parametrize("blank", ["\u00a0", "\u2007", "\u202f", "\u3000", "\t", " \u00a0", "\u00a0 "])
def test_tags_end_at_any_blank(blank):
    assert ct.pieces(f"#Wall12{blank}ikaw ay bobo. Dalawa") == ["ikaw ay bobo. ", "Dalawa"]
    assert ct.pieces(f"#Wall12{blank}ikaw{blank}bobo") == [f"ikaw{blank}bobo"] and ct.pieces(f"#Wall12{blank}") == ct.pieces("#") == []


def test_gradients():
    net = ct.Net(0)
    docs, y = [["a", "b", "c"], ["d"]], np.array([1, 0])

    def loss(n):
        p = n.probabilities(docs)
        return -np.log(p[np.arange(2), y]).mean()

    before = loss(net)
    net.fit(docs * 32, np.tile(y, 32), 40, 1)
    assert loss(net) < before / 2


def test_long_texts_equal_their_pieces():
    net = ct.Net(3)
    d = [f"w{i}" for i in range(1000)]
    whole = net.pool_all([d])[0]
    buckets, rows = ct._coded([d], {})
    assert np.allclose(whole, net.pooled(ct._padded(rows), np.concatenate(buckets), np.array([len(v) for v in buckets]))[0], atol=1e-5)


@pytest.fixture(scope="module")
def content_model():
    r = random.Random(2)
    good = ["ang haba ng pila sa library", "my grade went up this term", "the nude sketch class is open", "may aso sa gate namin", "i was stupidly happy"]
    bad = {"abusive": ["ang bobo mo talaga", "you are such an idiot"], "hateful": ["keep those people out they are filth"], "sexual": ["send me your nudes now"]}
    rows = []
    for i in range(500):
        g = [r.choice(good) for _ in range(3)]
        k = r.choice(list(bad)) if i % 4 == 0 else "clean"
        if k != "clean":
            g[r.randrange(3)] = r.choice(bad[k])
        rows.append((". ".join(g), k if r.random() > 0.03 else "clean", "tl" if i % 2 else "en"))
    return ct.train(pd.DataFrame(rows, columns=["text", "content_label", "lang"]), [("bobo", "abusive"), ("idiot", "abusive"), ("x", "other")])


def test_content_held_out(spark, content_model):
    rows = [(1, "ang b0b0 mo talaga", "tl"), (2, "you are such an id*ot", None), (3, "may aso sa gate namin", "tl"), (4, None, "tl"), (5, "", None), (6, "!!!", "en"), (7, "the nude sketch class is open. " * 3000 + "send me your nudes now", "en"), (1, "ang b0b0 mo talaga", "tl")]
    df = spark.createDataFrame([(*x, 9.0) for x in rows], "row_id long, text string, lang string, score double")
    got = ct.score_texts(df, content_model, "row_id", "text", "lang").collect()
    flags = {r.row_id: r.flagged for r in got}
    assert len(got) == 8 and flags == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True}
    assert content_model["held_out"]["precision"] > 0.9 and content_model["held_out"]["recall"] > 0.85
    assert ct.score_texts(df.limit(0), content_model, "row_id", "text", "lang").count() == 0
    assert not any(r.flagged for r in ct.score_texts(df, ct.train(pd.DataFrame({"text": [], "content_label": [], "lang": []}), []), "row_id", "text", "lang").collect())


def test_scores_do_not_depend_on_partitions_or_neighbours(spark, content_model):
    r = random.Random(4)
    words = "ang bobo mo talaga you are such an idiot nudes library gate class happy send me now".split()
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 40))) + r.choice([".", "! Isa pa. ", ""]), "tl") for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, text string, lang string")
    runs = [sorted((x.row_id, x.score, x.flagged) for x in ct.score_texts(df.repartition(n, "row_id"), content_model, "row_id", "text", "lang").collect()) for n in (1, 7, 64)]
    assert runs[0] == runs[1] == runs[2] and any(x[2] for x in runs[0])
    s = ct.Scorer(content_model)
    alone = s.probabilities(["ang bobo mo"])
    assert np.allclose(ct.Scorer(content_model).probabilities(["ang bobo mo", "w " * 150])[0], alone[0], atol=1e-6)


def test_long_words_differ_to_their_end():
    cache = {}
    a, b = (set(ct._ids("tanginamotalagangwalangkwenta" + x, cache).tolist()) for x in ("ngbobo", "saya"))
    assert len(a - b) >= 4 and len(b - a) >= 3


@pytest.mark.parametrize("n", [0, 1, 5, 25, 100, 400])
def test_one_rule_of_thresholds_at_every_size(n):
    score, bad = np.r_[np.full(n, 0.9), np.linspace(0, 0.1, 50)], np.r_[np.ones(n, bool), np.zeros(50, bool)]
    t = ct.best_threshold(score, bad, 0.5)
    assert abs(t - 0.5) <= 1e-9 + 0.5 * min(n, 50) / (min(n, 50) + ct.PRIOR)


def test_nets_fitted_in_tasks_are_those_fitted_here(spark):
    rows = pd.DataFrame([("you are an idiot now", "abusive", "en"), ("the class is open", "clean", "en")] * 10, columns=["text", "content_label", "lang"])
    a, b = ct.train(rows, [], spark=spark), ct.train(rows, [])
    assert np.allclose(a["params"]["out"], b["params"]["out"], atol=1e-3) and abs(a["overall"] - b["overall"]) < 1e-3


# ---- problem 5


@pytest.fixture(scope="module")
def built(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    return lg.build_filter(lg.count_words(docs))


def test_languages_held_out(spark, built):
    """On sentences of one language in documents of the next size, which the filter has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("lang").isin(lg.LANGUAGES)).select("text", "lang").orderBy("text").limit(1500).collect()
    d = lg.Decider(built)
    hits = n = 0
    for r in docs:
        if r.text:
            n += 1
            got = d.languages(r.text)
            hits += bool(got) and max(got, key=got.get) == r.lang
    assert hits / n > 0.95


def test_language_edges(spark, built):
    labels = ["EN", "Taglish", "ceb+en", "en + ceb", "fil", "und", "", None, "Tagalog", "unknown", "Filipino+English"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string")
    got = [r[0] for r in df.orderBy("i").select(lg.label_set(F.col("l"))).collect()]
    assert got == [["en"], ["en", "tl"], ["ceb", "en"], ["ceb", "en"], ["tl"], None, None, None, ["tl"], None, ["en", "tl"]]
    rows = [(1, None), (2, ""), (3, "12345 https://x.example"), (4, "The professor cancelled the class before it started. Ang haba ng pila sa library kaya hindi na ako nakapasok."), (5, "Ｔｈｅ ｐｒｏｆｅｓｓｏｒ cancelled the class before it started. " * 2000), (6, "zzq xxw")]
    t = spark.createDataFrame([(*x, "x") for x in rows], "row_id long, text string, langs string")
    r = {x.row_id: x for x in lg.detect(t, built, "text", ["row_id"], True).collect()}
    assert [r[i].langs for i in (1, 2, 3, 4, 5)] == ["", "", "", "en+tl", "en"] and r[6].confidence is None or r[6].langs == "" or r[6].confidence < 0.2
    assert r[4].segments[0].lang == "en" and len(r[5].segments) == 2000 and 0 < r[4].confidence <= 1
    assert lg.detect(t.limit(0), built, "text", ["row_id"]).count() == 0
    empty = lg.build_filter(lg.count_words(t.select("text", F.lit("en").alias("lang")).limit(0)))
    assert lg.Decider(empty).languages("the class is open") == {}


def test_known_words_are_scored_without_a_call_each(built):
    import sys

    d, words = lg.Decider(built), "the professor cancelled the class before it started ang haba ng pila sa library".split()
    want, calls = d.score(words), []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        got = d.score(words)
    finally:
        sys.setprofile(None)
    assert got == want and want[1] > 4 and len(calls) < len(words)


@pytest.mark.parametrize(
    ("piece", "want"),
    [
        ("Mail me.too@x.example now", ["mail", "now"]), ("ask x [at] y (dot) z today", ["ask", "today"]), ("see www.x.y and http://a.b/c d9e fine", ["see", "and", "fine"]),
        ("Posted: Jan 5, 2024 3:45pm PHT okay", ["okay"]), ("a1b2c three4 five٣x [six] (seven) 8", ["six", "seven"]), ("#tag @me mar 3 20 pm kumain", ["kumain"]), ("room: 12 left", ["room", "left"]),
    ],
)
def test_words_that_tell_a_language(piece, want):
    assert lg.words_of(piece) == want
    assert lg._ADDRESS_SIGNS.search(piece) or lg._SKIP.sub(" ", piece.casefold()) == lg._SKIP_FEW.sub(" ", piece.casefold())


def test_counts_of_held_segments():
    c = lg._Counts()
    c.add_held({"en": {"so so good": 1, "so good": 2}, "tl": {"so": 3}})
    assert c.seen == {"so": [4, 3, 0, 0, 0], "good": [3, 0, 0, 0, 0], "so so": [1, 0, 0, 0, 0], "so good": [3, 0, 0, 0, 0]}


# ---- problem 7


@pytest.fixture(scope="module")
def person_model():
    r = random.Random(4)
    given = {"Ana", "Joy", "Pablo", "Rosa", "Luz", "Maria"}
    last = ["Reyes", "Santoso", "Bautro", "Limueco", "Tanduay"]
    unlisted = ["Nestor", "Gemma"]
    plain = ["ang haba ng pila sa library.", "it was such a joy to hear the choir.", "the quota is 1500 slots for school year 2025-2026.", "pulong ng Mabini kanina.", "see you at the library."]
    texts = []
    for _ in range(900):
        n = f"{r.randrange(10**8, 10**9)}"
        phone = r.choice([f"09{n}", f"+63 9{n[:2]} {n[2:5]} {n[5:]}", f"09{n[:2]}-{n[2:5]}-{n[5:]}0"])
        name = f"{r.choice(sorted(given) + unlisted)} {r.choice(last)}"
        s = r.choice(
            [
                f"Salamat kay {name} na nagpahiram ng sulat.", f"I have a crush on {name} and I do not know.", f"Si Prof. {r.choice(last)} na naman ang huli.", f"Just text me at {phone} please.", f"again {phone}", phone,
                f"My ID no. is 2021-{r.randrange(10000, 99999)} in case.", f"Please write to ana{r.randrange(99)}@mail.example now.", f"Please deliver it to {r.randrange(1, 99)} Wiso Road, Rilube before noon.",
            ]
        )
        texts.append(f"{r.choice(plain)} {s} {r.choice(plain)}")
    return ps.learn(texts, given)


def test_personal_finds(person_model):
    f = ps.Finder(person_model)
    look = lambda t: {(k, t[a:b]) for a, b, k in f.find([t])[0]}
    assert look("Salamat kay Gemma Reyes na nagpahiram ng sulat.") == {("name", "Gemma Reyes")}
    assert look("Just text me at +63 900 123 4567 please.") == {("phone", "+63 900 123 4567")}
    assert look("Please write to a.b+c@mail.amihara.example. Thanks") == {("email", "a.b+c@mail.amihara.example")}
    assert look("Please write to ana (at) mail.example now.") == {("email", "ana (at) mail.example")}
    assert look("My ID no. is 2020-12345 in case.") == {("id_number", "2020-12345")}
    assert look("Please deliver it to 17 Wiso Road, Rilube before noon.") == {("address", "17 Wiso Road, Rilube")}
    assert look("Si Prof. Limueco na naman ang huli.") == {("name", "Limueco")}
    assert look("it was such a joy to hear the choir. the quota is 1500 slots for school year 2025-2026.") == set()
    assert look("Salamat kay A​na Rеyes na nagpahiram ng sulat.") == {("name", "A​na Rеyes")}
    assert f.find(["", "   ", "x"]) == [[], [], []] and f.find([]) == []


def test_the_field_decides_where_no_pattern_hits(person_model):
    f = ps.Finder(person_model)
    look = lambda t: {(k, t[a:b]) for a, b, k in f.find([t])[0]}
    for text, kind, span in (
        ("Please write to ana12 @ mail . example now.", "email", "ana12 @ mail . example"),
        ("Please deliver it to 17 Wiso Heights, Rilube before noon.", "address", "17 Wiso Heights, Rilube"),
    ):
        assert not any(m for m in ps._PATTERNS[kind].finditer(text)), text
        got = look(text)
        assert any(k == kind and x.split()[0] == span.split()[0] for k, x in got), (text, got)


def test_skip_edges_are_fitted(person_model):
    w = ps.Field().fit_skips([[5, 5], [5, 5, 5], [0, 0], [0, 0]]).skip
    assert w[5] > 0.3 and (w >= 0).all() and (w <= ps.MOST_SKIP).all() and (ps.Field().fit_skips([]).skip >= 0).all()
    assert person_model["skip"].shape == (6,)
    # What a sure name shares with a segment that has no sign of its own brings that segment in.
    f = ps.Finder({**person_model, "skip": np.full(6, 3.0, np.float32)})
    d = f._document("Si Prof. Limueco na naman ang huli.\nLimueco na naman siya.\nang haba ng pila.")
    assert len(d[1]) == 2 and d[2][1]


def test_word_lists_cover_all_posts(spark):
    """Words that the sample lacks are judged by all posts, by the same rule at every size."""
    posts = [f"plain {i}" for i in range(300)] + [f"we met at kubo {i} with Mr. Tanduay" for i in range(5)] + [f"{i} Rilube is far" for i in range(25)] + [f"oh Joy, {i}" for i in range(4)]
    df = spark.createDataFrame([(t,) for t in [*posts, *posts, None, ""]], "text string").repartition(5)
    lex = ps.corpus_lexicon(df, "text", {"Joy"})
    whole = ps.make_lexicon(ps.count_cases(posts, {"joy"}), len(posts), {"joy"})
    assert (lex.given, lex.common, lex.alone) == (whole.given, whole.common, whole.alone)
    assert {"kubo", "rilube"} <= lex.common and "tanduay" not in lex.common and lex.alone == {"joy"}
    model = ps.learn(posts[:50], {"Joy"}, lex=lex)
    assert model["common"] == lex.common and not ps.Finder(model).lex.rare("Kubo") and ps.Lexicon({"joy"}, ps.learn(posts[:50], {"Joy"})["common"]).rare("Kubo")
    assert ps.corpus_lexicon(df.limit(0), "text", {"Joy"}).common == set()
    n = ps.count_cases(posts, {"joy"})
    many = {c: ps.Counter({w: k * 1000 for w, k in n[c].items()}) for c in n}
    big, small = (ps.make_lexicon(x, k, {"joy"}) for x, k in ((many, 20_000_000), ({c: ps.Counter({w: k * 2 for w, k in n[c].items()}) for c in n}, 40_000)))
    assert big.common == small.common and big.alone == small.alone


def test_redaction_and_edges(spark, person_model):
    rows = [(1, "Just text me at 09001234567 please. Salamat kay Ana Reyes na nagpahiram ng sulat."), (2, None), (3, ""), (4, "plain words only"), (1, "again 09001234567"), (5, "plain words. " * 5000 + "Just text me at 09001234567 please.")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "row_id long, text string, kind string")
    r = ps.redact(df, person_model, "row_id", "text").collect()
    by = {x.row_id: x for x in r if not (x.row_id == 1 and x.redacted_text.startswith("again"))}
    assert by[1].redacted_text == "Just text me at [PHONE] please. Salamat kay [NAME] na nagpahiram ng sulat." and by[1].n_found == 2
    assert by[2].redacted_text is None and by[3].redacted_text == "" and by[4].redacted_text == "plain words only" and by[5].n_found == 1
    f = ps.find_personal(df, person_model, "row_id", "text")
    assert f.count() == 4 and ps.find_personal(df.limit(0), person_model, "row_id", "text").count() == 0
    assert ps.find_personal(df.where("row_id = 4"), person_model, "row_id", "text").count() == 0
    assert ps.Finder(ps.learn([], set())).find(["Ana Reyes 09001234567"]) is not None


def test_skip_edges_tie_repeats():
    """A word that is a name in one place pulls its repetition along."""
    field = ps.Field()
    b = ps.LABELS.index("B-name")
    field.emit[1, b], field.emit[2, 0] = 4.0, 0.6
    feats = np.zeros((3, ps.WIDTH), np.int64)
    feats[0, 0], feats[1, 0], feats[2, 0] = 1, 3, 2
    alone = field.decode([(feats, [True, False, True], [])])[0]
    tied = field.decode([(feats, [True, False, True], [[0, 2]])])[0]
    assert alone[0] == b and alone[2] == 0 and tied[0] == b and tied[2] == b
