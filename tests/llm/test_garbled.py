import random

from pyspark.sql import functions as F

from aguayo.llm.codecs import TRANSFORMS, garble
from aguayo.llm.garbled import _WORD, WORD, Mapping, aligned_runs, explanations, find_garbled

NAMES = ["Másñimay", "Sullquincó Tardío", "Vilñuquépé", "niños danzantes", "máscaras radiadas", "técnica de tapiz", "anotó «ver reverso»", "algodão e lã", "coleção de fios", "mãos hábeis", "ángulo de 48°", "diámetro varía", "según la ficha n.º 9"]
CLEAN = ["Étoffe façonnée", "Âncora bordada", "MANTA DE LÃ", "«LÃ CRUA, 2ª MÃO»", "Ångpå-vävnad", "Inscripción «ΑΡΓΟΣ»", "шерсть", "£4 ½", "±2 cm", "Fila A→B, 45° · sin", "Prix d’achat : 3 £, brûlé à gauche", "Vilñuquépé", "“São Lôr”", "", None, "TÚNICA DE CAÑÓN", "Densidad ≈ 12 (Δ < 1)"]
WAYS = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp437")]


def test_alignment():
    assert aligned_runs("MÃ¡sÃ±imay", "Másñimay") == [("Ã¡", "á"), ("Ã±", "ñ")]
    assert aligned_runs("Masñimay", "Másñimay") == []
    assert ("utf-8", "cp1252") in [TRANSFORMS[i] for i in explanations("MÃ¡sñimay", "Másñimay") if i >= 0]
    assert explanations("Mésñimay", "Másñimay") == []


def test_planted_values(spark):
    r = random.Random(3)
    rows, want = [], {}
    for i in range(1500):
        t = f"{r.choice(NAMES)} y {r.choice(NAMES)} {r.randint(1, 9)}"
        if i % 10 == 0:
            w, x = WAYS[(i // 10) % len(WAYS)]
            g = garble(t, w, x)
            if g is not None and g != t:
                want[i] = t
                t = g
        elif i % 97 == 0:
            want[i] = t
            t = t.replace("á", "�").replace("ñ", "�").replace("ó", "�")
            if "�" not in t:
                del want[i]
        rows.append((i, t))
    rows += [(2000 + i, t) for i, t in enumerate(CLEAN)]
    df = spark.createDataFrame(rows, "row_id long, title string").selectExpr("*", "'x' AS word", "'y' AS value")
    got = {x.row_id: x for x in find_garbled(df, "row_id", ["title"]).collect()}
    assert set(got) == set(want)
    right = sum(got[i].restored == t for i, t in want.items())
    assert right >= 0.85 * len(want), [(got[i].value_text, got[i].restored, t) for i, t in want.items() if got[i].restored != t][:5]


def test_clean_texts_stay():
    m = Mapping([TRANSFORMS.index(w) for w in WAYS])
    for t in CLEAN:
        if t:
            assert m.restore(t) == (False, t)
    assert m.restore("MÃƒÂ¡sÃƒÂ±imay") == (True, "Másñimay")


def test_filter_lets_through_what_words_tell(spark):
    m = Mapping(range(len(TRANSFORMS)), "áéíóúñüçãõàâêÁÉÍÓÚÑÜÇÃÕÀÂÊ")
    words = {g for t in "ALGODÓN SEÑOR TAPÍZ TÚNICA CAÑÓN ÁNGULO algodón señor Útil coleção MÃO".split() for w, r in TRANSFORMS if (g := garble(t, w, r)) and g != t}
    for m in (m, *(Mapping([i], "".join(m.alphabet)) for i in range(len(TRANSFORMS)))):
        told = {w for w in words if any(map(m.word, _WORD.findall(w)))}
        df = spark.createDataFrame([(w,) for w in sorted(told)] or [("",)], "value string")
        joined = F.array_join(F.regexp_extract_all("value", F.lit(WORD), F.lit(0)), " ")
        assert not told or df.filter(~joined.rlike(m.triggers())).collect() == []


def test_words_in_capitals(spark):
    rows = [t for t in ("ALGODÓN", "TÓRTOLA", "CORDÓN", "JERGÓN", "SEÑOR") for _ in range(5)]
    dirty = [garble(t, "cp1252", "cp850") for t in ("ALGODÓN", "TÓRTOLA", "CORDÓN", "JERGÓN")]
    assert dirty[0] == "ALGODËN"
    df = spark.createDataFrame([*enumerate(rows), *enumerate(dirty, 100)], "row_id long, title string")
    assert {r.row_id: r.restored for r in find_garbled(df, "row_id", ["title"]).collect()} == dict(enumerate(("ALGODÓN", "TÓRTOLA", "CORDÓN", "JERGÓN"), 100))


def test_runs_beyond_the_listed_encodings(spark):
    clean = "Perú Cañarú Tambú Nazcú año paño caña técnica édito médano crédito camión cordón algodón".split()
    rows = [t for t in clean for _ in range(4)] + "hiló hiló hilé bordó bordó bordé calló calló callé cœur 3£ «Tambú» Lima–Cusco".split()
    df = lambda dirty: spark.createDataFrame([*enumerate(rows), *enumerate(dirty, 1000)], "row_id long, title string")
    for written, read in (("cp437", "cp1252"), ("mac_roman", "cp1252")):
        dirty = {t: t.encode(written).decode(read) for t in "Perú Cañarú Tambú Nazcú año paño caña".split()}
        if written == "mac_roman":
            assert (dirty["Perú"], dirty["año"]) == ("Perœ", "a–o")
        got = {r.row_id: r.restored for r in find_garbled(df(dirty.values()), "row_id", ["title"]).collect()}
        assert got == dict(enumerate(dirty, 1000))
    alone = ["a¤o", "pa¤o", "ca¤a", "le¤a de Per£"]  # the last one has no twin
    got = {r.row_id: r.restored for r in find_garbled(df(alone), "row_id", ["title"]).collect()}
    assert got == {1000: "año", 1001: "paño", 1002: "caña", 1003: "leña de Per£"}


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ascii")], "row_id long, title string")
    assert find_garbled(df, "row_id", ["title"]).count() == 0 and find_garbled(df.limit(0), "row_id", ["title"]).count() == 0
    one = spark.createDataFrame([(1, "x�y " * 20_000), (2, "x�y")], "row_id long, title string")
    assert find_garbled(one, "row_id", ["title"]).count() == 2


def test_rarer_twins(spark):
    clean = "avô café coração lã ação irmão pão mãe".split()
    rows = [t for t in clean for _ in range(20)] + ["avó"] * 6 + ["PANTEÓN"] * 9 + ["PANTEÔN"] * 4
    ways = [("cp1252", "mac_roman"), ("cp1252", "iso8859-2")]
    dirty = [g for t in clean for w, x in ways if (g := garble(t, w, x)) != t and g != "l„"] + [garble("avó", *ways[0]), garble("PANTEÔN", *ways[0])]
    df = spark.createDataFrame([*enumerate(rows), *enumerate(dirty, 1000)], "row_id long, title string")
    got = {r.row_id: r.restored for r in find_garbled(df, "row_id", ["title"]).collect()}
    assert set(got) == set(range(1000, 1000 + len(dirty)))
    assert got[1000 + len(dirty) - 2] == "avó" and got[1000 + len(dirty) - 1] == "PANTEÔN"


def test_four_bytes_and_other_scripts():
    m = Mapping([TRANSFORMS.index(("utf-8", "cp1252")), TRANSFORMS.index(("utf-8", "latin-1"))])
    for t in ("nota \U0001f9f6 final", "日本の織物 x", "שלום manta", "Việt Nam", "\U0001d400bc"):
        g = garble(t, "utf-8", "cp1252")
        assert m.restore(g) == (True, t), t
    for t in ("un café”—dijo", "el té€… 3", "ä¿ qué?", "日本 café"):
        assert m.restore(t) == (False, t), t
    x = "Perú año"
    for _ in range(7):
        x = garble(x, "utf-8", "latin-1")
    assert m.restore(x) == (True, "Perú año")


def test_restoring_is_right_in_most_of_held_out_values(spark):
    """Values garbled in every listed way that changes them; those of which nothing is lost are restored as they were."""
    r, rows, want = random.Random(11), [], {}
    for i in range(4000):
        t = f"{r.choice(NAMES)} con {r.choice(NAMES)} {r.randint(1, 99)}"
        if i % 8 == 0:
            w, x = TRANSFORMS[(i // 8) % len(TRANSFORMS)]
            g = garble(t, w, x)
            if g is not None and g != t:
                want[i], t = t, g
        rows.append((i, t))
    got = {x.row_id: x.restored for x in find_garbled(spark.createDataFrame(rows, "row_id long, title string"), "row_id", ["title"]).collect()}
    assert len(set(want) & set(got)) >= 0.99 * len(want) and len(set(got) - set(want)) <= 0.01 * len(want)
    right = sum(got.get(i) == t for i, t in want.items())
    print("restored", right, "of", len(want))
    assert right >= 0.9 * len(want), [(got[i], t) for i, t in want.items() if got.get(i) not in (None, t)][:9]
