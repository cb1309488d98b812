"""Problem 10: hand-cut sentences of several languages and scripts, and edges."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as stn

from postloom.llm import sentences as st
from postloom.llm.sentences import Splitter, learn, lines, sentence_ends

TRAIN = [
    "Dr. Reyes gave a 1.5 in MATH 21. The bus was late again. I had to run. We waited until 9 p.m. The food was cold.",
    "She said it was late... never mind that. The fee is 1,250.50 per unit, etc. before noon. We left. The end came.",
    "Sasabihin ko sana... pero huwag na lang. Ang haba ng pila. Sabi niya oo. Ang ingay dito. The bus was late.",
    "“Totoo ba?” tanong ni Ana. Ang bait nila. Meet us at Rm. 5 before 5 p.m. on Friday. The bus left. The rain stopped.",
    "我把雨伞忘在图书馆了。“真的吗？”室友问我。宿舍的网络又断了。今天食堂排队排了九分钟！",
    "バスを待ちました。「本当に？」と先輩に聞かれました。寮のお湯がまた出ません！",
    "ฉันลืมร่มไว้ที่ห้องเรียน รถเมล์มาช้าทุกวัน ฉันคิดถึงบ้านทุกวัน",
] * 6


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TRAIN, None, ""])], "doc_id long, text string")
    return learn(df)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The bus was late. I ran.", ["The bus was late.", "I ran."]),
        ("  Two  blanks.  Then more!!  ", ["Two  blanks.", "Then more!!"]),
        ("A heading\n\n1. first line\n2. second one.\na) third", ["A heading", "1. first line", "2. second one.", "a) third"]),
        ("It cost 1,250.50 vs. 3.75 last year. We paid.", ["It cost 1,250.50 vs. 3.75 last year.", "We paid."]),
        ("Dr. Cruz and Engr. Lim came, etc. before noon. We left.", ["Dr. Cruz and Engr. Lim came, etc. before noon.", "We left."]),
        ("We waited until 9 p.m. The bus left.", ["We waited until 9 p.m.", "The bus left."]),
        ("Meet us before 5 p.m. on Friday. We left.", ["Meet us before 5 p.m. on Friday.", "We left."]),
        ("J. R. Zamolupit won the no. 1 spot. The end.", ["J. R. Zamolupit won the no. 1 spot.", "The end."]),
        ("I met her at Annex B. The bus left.", ["I met her at Annex B.", "The bus left."]),
        ("“Totoo ba iyan?” tanong niya sa amin. Oo.", ["“Totoo ba iyan?” tanong niya sa amin.", "Oo."]),
        ('"I am done!" she shouted, then laughed. We left.', ['"I am done!" she shouted, then laughed.', "We left."]),
        ('She whispered, "Stay." The bus left.', ['She whispered, "Stay."', "The bus left."]),
        ("«¿Hablas en serio?», preguntó ella. No.", ["«¿Hablas en serio?», preguntó ella.", "No."]),
        ("I was going to say... never mind, it is late. We left.", ["I was going to say... never mind, it is late.", "We left."]),
        ("We ran... The bus left.", ["We ran...", "The bus left."]),
        ("wala pa kayo.Bumili kami.", ["wala pa kayo.", "Bumili kami."]),
        ("See portal.kampus.example for v2.24.1 of it. We left.", ["See portal.kampus.example for v2.24.1 of it.", "We left."]),
        ("gray. (Yes, I checked it twice.) The bus left.", ["gray.", "(Yes, I checked it twice.)", "The bus left."]),
        ("the bus was late. the food was cold! we left", ["the bus was late.", "the food was cold!", "we left"]),
        ("dr. cruz gave me 1.5 in ce 26. the bus left.", ["dr. cruz gave me 1.5 in ce 26.", "the bus left."]),
        ("Talaga?! Ang bait nila.", ["Talaga?!", "Ang bait nila."]),
        ("我的平均成绩是1.4分。“真的吗？”室友问我。宿舍的网络又断了。", ["我的平均成绩是1.4分。", "“真的吗？”室友问我。", "宿舍的网络又断了。"]),
        ("「本当に？」と先輩に聞かれました。寮のお湯がまた出ません！", ["「本当に？」と先輩に聞かれました。", "寮のお湯がまた出ません！"]),
        ("เกรดเฉลี่ยของฉันคือ1.8 อาหารที่โรงอาหารอร่อยมาก", ["เกรดเฉลี่ยของฉันคือ1.8", "อาหารที่โรงอาหารอร่อยมาก"]),
        ("डॉ. साहब ने 9 बजे बुलाया है। क्या कल कक्षा होगी?", ["डॉ. साहब ने 9 बजे बुलाया है।", "क्या कल कक्षा होगी?"]),
        ("", []), ("   \n \n", []), ("word", ["word"]), ("...", ["..."]),
    ],
)
def test_cuts(model, text, want):
    out, at = [], 0
    for e in Splitter(model).ends(text):
        out.append(text[at:e].strip())
        at = e
    assert out == want


def test_lattice_words(model):
    s = Splitter(model)
    for run in ("我把雨伞忘在图书馆了", "ฉันลืมร่มไว้ที่ห้องเรียน", "未知"):
        assert "".join(s.words(run)) == run


def test_table_edges(spark, model):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n ", "c"), (4, "The end. We left.", "d"), (4, "The end. We left.", "d"), (5, "Go. " * 20_000, "e")], "doc_id long, text string, end_pos string")
    got = sentence_ends(df.repartition(6), model).collect()
    assert sorted({r.doc_id for r in got}) == [4, 5] and sum(r.doc_id == 5 for r in got) == 20_000
    assert sorted(r.end_pos for r in got if r.doc_id == 4) == [8, 8, 17, 17]
    assert sentence_ends(df.limit(0), model).count() == 0 and learn(df.limit(0)) == {}
    assert Splitter({"gram": {}}).ends("Aa bbb. Cc ddd.") == [7, 15]
    assert list(lines("a\r\nb")) == [(0, "a"), (3, "b")]


def test_any_number_of_gaps_may_be_passed_over(model):
    text = "The paper by " + " ".join(f"{c}." for c in "ABCDEFGHKLMNPQRSTUVWXZ") + " lee is long and was read. We left."
    assert Splitter(model).ends(text) == [len(text) - 9, len(text)]
    quoted = "She wrote (" + "we ran. " * 30 + "we left) and went."
    brute = _brute(quoted, Splitter(model))
    assert Splitter(model).ends(quoted) == brute


def _brute(line, splitter):
    """The best path over all pairs of gaps, by the definition of its costs."""
    nodes, real = {}, Splitter._path

    def keep(line, given, last):
        nodes["n"] = (given, last)
        return real(line, given, last)

    splitter._path = keep
    splitter.ends(line)
    given, last = nodes["n"]
    points, gain = [0, *(e for e, _ in given), last], [0.0, *(g for _, g in given), 0.0]

    def cost(seg):
        if not any(c.isalnum() or c == "_" for c in seg):
            return 5.0
        return 3.0 * (seg.count('"') % 2) + sum(3.0 for a, b in st._PAIRS.items() if seg.count(a) != seg.count(b))

    best = [(0.0, 0)]
    for j in range(1, len(points)):
        best.append(max((best[i][0] + gain[j] - sum(max(0.0, g) for g in gain[i + 1 : j]) - cost(line[points[i] : points[j]]), i) for i in range(j)))
    out, j = [], len(points) - 1
    while j:
        out.append(points[j])
        j = best[j][1]
    return out[::-1]


@given(stn.lists(stn.sampled_from(['We ran. ', '"', "(", ")", "“", "”", "? ", "A. ", "e.g. this ", "so... ", "The end! ", "。", "我们了。", "「", "」", "5. "]), min_size=1, max_size=18))
@settings(max_examples=150, deadline=None)
def test_path_equals_brute_force(parts):
    line = "".join(parts).strip()
    if line:
        s = Splitter({"open": {"we": 9, "the": 9}})
        assert Splitter({"open": {"we": 9, "the": 9}}).ends(line) == _brute(line, s)


def test_words_decide_where_there_is_no_stop(model):
    """Another model, another cut: the odds of final and opening words count."""
    text = "我们去图书馆了 宿舍很吵"
    gram = {"我们": 9, "去": 9, "图书馆": 9, "了": 9, "宿舍": 9, "很": 9, "吵": 9}
    plain = {"gram": gram, "final": {"吵": 50}, "inner": {"了": 50, "去": 900}, "initial": {"我们": 50}, "later": {"宿舍": 50, "去": 900}}
    closing = {"gram": gram, "final": {"了": 50}, "inner": {"去": 900}, "initial": {"宿舍": 50}, "later": {"去": 900}}
    assert Splitter(plain).ends(text) == [len(text)] and Splitter(closing).ends(text) == [7, len(text)]
    thai = "ราคา ห้าบาท"
    gram = {"ราคา": 9, "ห้าบาท": 9}
    goes_on = {"gram": gram, "inner": {"ราคา": 99}, "final": {"ก": 99}, "later": {"ห้าบาท": 99}, "initial": {"ก": 99}}
    assert Splitter({"gram": gram}).ends(thai) == [4, len(thai)] and Splitter(goes_on).ends(thai) == [len(thai)]
    assert model["final"]["了"] >= 2 and Splitter(model)._leaning("了", "final", "inner") > 0


def test_time_is_linear_in_the_length_of_a_line(model):
    import time

    s = Splitter(model)
    for unit in ("a.b", "我们走了。", "คน ", "x... ", "(a. ", "? ", "“A. "):
        began = time.time()
        s.ends(unit * 20_000)
        assert time.time() - began < 6, unit
