import random

from aguayo.llm import canon
from aguayo.llm.canon import Near, Terms, allowance, edits, fold, map_values, unmatched

ENTRIES = [(1, "Másñimay", None), (2, "Másñimay Tardío", "Late Másñimay"), (3, "fibra de agave", "agave fiber"), (4, "tela llana", "plain weave"), (5, "seda", "silk"), (6, "capa corta", "short cape"), (7, "gorro", "cap"), (8, "anillado cruzado", "cross-knit looping")]
CASES = {
    "másñimay": 1, "¿Másñimay?": 1, "Masnimay (según ficha)": 1, "posiblemente MÁSÑIMAY": 1, "MÃ¡sÃ±imay": 1, "M·sÒimay": 1, "M�s�imay": 1, "Másñiamy": 1,
    "Másñimay Tadrío": 2, "Tardío, Másñimay": 2, "Másñ. Tardío": 2, "Late masnimay": 2, "Másñimay_Tardío": 2, "fibar de agave": 3, "agave, fibra de": 3, "FIBR. DE AGAVE": 3,
    "plain weave, two faces": 4, "telallana": 4, "sedda": 5, "silk": 5, "cap corta": 6, "cap": 7, "cross-knit looping (loom)": 8, "Qarborpé": 0, "#335-b": 0, "s/d": 0, "ver ficha": 0, "?": 0, "poliéster": 0,
}


def test_cases():
    t = Terms(ENTRIES)
    assert {v: t.match(v)[0] for v in CASES} == CASES


def test_mentions_in_long_values_and_sets_of_words():
    t = Terms([*ENTRIES, (9, "Paracas", None), (10, "tapiz ranurado", "slit tapestry"), (11, "tapiz", None)])
    want = {"Paracas periodo Horizonte Temprano costa sur": 9, "fragmento hallado en la tumba con un gorro pequeño": 7, "tapiz fino ranurado": 10, "ranuardo fino, tapiz": 10, "Másñimay muy Tardío": 2, "tapiz fino": 11, "manta fina ranurada": 0}
    assert {v: t.match(v)[0] for v in want} == want


def test_edits():
    assert [edits(a, b, 3) for a, b in [("abc", "abc"), ("abc", "acb"), ("abc", "abcd"), ("a�c", "abc"), ("abc", "xyz"), ("", "abcd")]] == [0, 1, 1, 0, 3, 4]
    assert fold("  «Raczóbor_Tardío» *") == "raczobor tardio"


def test_table(spark):
    terms = spark.createDataFrame([(e, "f", a, b) for e, a, b in ENTRIES] + [(99, "g", None, None)], "entry_id long, field_name string, label string, label_en string")
    rows = [(i, v, "g1") for i, v in enumerate(CASES)] + [(100, "Másñimay", None), (101, None, None), (102, " nan ", ""), (103, "seda " * 20_000, ""), (104, " tela  llana", "x"), (0, "másñimay", "")]
    df = spark.createDataFrame(rows, "row_id long, f string, g string").selectExpr("*", "1 AS entry_id", "'z' AS label")
    got = map_values(df, terms, "row_id", ["f", "g"]).cache()
    f = [(r.row_id, r.entry_id) for r in got.collect() if r.field_name == "f"]
    assert sorted(f) == sorted([(i, e) for i, e in enumerate(CASES.values())] + [(103, 5), (0, 1)])
    assert {r.entry_id for r in got.collect() if r.field_name == "g"} == {0}
    assert {r.value_text for r in unmatched(got).collect()} >= {"Qarborpé", "g1"}
    assert {r.entry_id for r in map_values(df, terms.limit(0), "row_id", ["f"]).collect()} == {0}
    assert map_values(df.limit(0), terms, "row_id", ["f"]).count() == 0


def test_reference_list_in_blocks(spark, monkeypatch):
    terms = spark.createDataFrame([(e, f, a, b) for e, a, b in ENTRIES for f in ("f", "g")], "entry_id long, field_name string, label string, label_en string")
    rows = [(i, v, "hot" if i % 2 else v) for i, v in enumerate(CASES)] * 2 + [(500 + i, "másñimay", None) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, f string, g string")
    one = sorted(map(tuple, map_values(df, terms, "row_id", ["f", "g"]).collect()))
    monkeypatch.setattr(canon, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, map_values(df, terms, "row_id", ["f", "g"]).collect())) == one and len(one) > 120


def test_values_with_other_words():
    t = Terms([*ENTRIES, (20, "Nasca", None), (21, "Wari", None), (22, "Wari Tardío", None), (23, "faja ancha", None)])
    want = {"probable Wari": 21, "Wari, costa sur, periodo medio": 21, "Nasca o Wari": 20, "Nasca o Wari tardío": 22, "posiblemente Másñiamy": 1, "M�s�imay (según ficha)": 1, "fajan cha": 23, "two faces Wari": 21, "MÃƒÂ¡sÃƒÂ±imay": 1}
    assert {v: t.match(v)[0] for v in want} == want
    assert Terms(ENTRIES, frozenset({"seda"})).match("seda lana")[0] == 0


def test_near_finds_what_counting_edits_finds():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 14)))
    words = {w: allowance(len(w)) for w in (word() for _ in range(400))}
    near = Near(words)
    for _ in range(300):
        w = list(r.choice(list(words)))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice(["", "a", "e", canon.ANY])
        w = "".join(w)
        if w.strip(canon.ANY):
            assert near.find(w) == sorted((edits(w, x, 9), x) for x, most in words.items() if edits(w, x, 9) <= most)
