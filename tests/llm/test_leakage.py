import random

from aguayo.llm.leakage import Index, find_leaks, near, remove_leaks, word_spans, words

VOCAB = "lana seda tinte manto telar urdimbre trama nudo borla paño hilo aguja rueca madeja ovillo fleco orillo brocado gasa sarga estera cesta junco".split()
ITEM, DOC = "item_id long, text string", "doc_id long, text string, item string, n long"


def sentence(r, n):
    return " ".join(r.choice(VOCAB) + str(r.randint(0, 60)) for _ in range(n))


def build():
    r = random.Random(4)
    items = [(i, sentence(r, 60)) for i in range(20)]
    docs, want = [], set()
    for d in range(120):
        w = sentence(r, 80).split()
        it = r.randrange(20)
        v = items[it][1].split()
        kind = d % 6
        n = {0: 0, 1: 10, 2: 15, 3: 30, 4: 40, 5: 60}[kind]
        a = r.randrange(0, 61 - n)
        part = v[a : a + n]
        if kind == 3:  # single words differ
            for k in range(7, n - 7, 9):
                part[k] = "otra"
        if kind == 4:  # spelling and layout
            for k in range(6, n - 6, 7):
                part[k] = part[k][:2] + part[k][3:]
            part = ["  ".join(part).upper().replace("O", "Ó")]
        if kind == 5:
            part = [x[:3] + "-\n" + x[3:] if k % 11 == 5 and x[3:].isalpha() else x for k, x in enumerate(part)]
            part[20:20] = ["(pág.", "14)"]
        docs.append((d, " ".join(w[:40] + part + w[40:]), "c", d))
        if n >= 15:
            want.add((d, it))
    return items, docs, want


def test_planted_passages(spark):
    items, docs, want = build()
    di, dd = spark.createDataFrame(items, ITEM), spark.createDataFrame(docs, DOC)
    leaks = find_leaks(dd, di, "doc_id", "item_id").cache()
    assert {(r.doc_id, r.item_id) for r in leaks.collect()} == want
    clean = remove_leaks(dd, leaks, "doc_id")
    assert clean.columns == [*dd.columns, "removed_spans"] and clean.count() == 120
    assert find_leaks(clean, di, "doc_id", "item_id").count() == 0
    kept = {r.doc_id: r for r in clean.collect()}
    assert all(kept[d].text == t and not kept[d].removed_spans for d, t, _, _ in docs if d not in {x for x, _ in want})
    assert {r.doc_id for r in remove_leaks(dd, leaks, "doc_id", whole=True).collect()} == {d for d, *_ in docs} - {x for x, _ in want}


def test_standing_formula_is_no_leak(spark):
    r = random.Random(5)
    formula = " ".join(f"formula{i}" for i in range(18))
    items = [(1, sentence(r, 30) + " " + formula), (2, sentence(r, 40))]
    docs = [(d, sentence(r, 40) + " " + (formula if d % 3 == 0 else "")) for d in range(300)] + [(1000, items[1][1]), (1001, items[0][1])]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), "doc_id", "item_id", formula_share=0.05, formula_in_one_item=True)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(1000, 2), (1001, 1)}


def test_repeated_leaks_are_no_formulas(spark):
    r = random.Random(6)
    formula = " ".join(f"formula{i}" for i in range(9))
    items = [(i, f"{sentence(r, 30)} {formula} {sentence(r, 21)}") for i in range(4)]
    v = [t.split() for _, t in items]
    copied = f"{sentence(r, 20)} {' '.join(v[0][3:28])} {sentence(r, 20)}"
    docs = [(d, copied) for d in range(200)]  # one text on a third of all rows
    docs += [(1000 + d, f"{sentence(r, 30)} {items[1][1]} {sentence(r, 9)}") for d in range(60)]  # a whole item in many texts
    want = {(d, 0) for d in range(200)} | {(1000 + d, 1) for d in range(60)}
    for d in range(40):  # another part of an item in each text
        a = r.randrange(0, 12)
        docs.append((2000 + d, f"{sentence(r, 30)} {' '.join(v[2][a : a + 16 + d % 3])} {sentence(r, 9)}"))
        want.add((2000 + d, 2))
    docs += [(3000 + d, f"{sentence(r, 40)} {' '.join(v[3][24 : 39 + d % 2])} {sentence(r, 9)}") for d in range(20)]  # a short quotation with the formula
    docs += [(4000 + d, f"{sentence(r, 40)} {formula} {sentence(r, 9)}") for d in range(280)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), "doc_id", "item_id")
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want


def test_words_and_their_places():
    for t in ["Paño  «TEÑIDO»,\nde teji-\n do", "cami&oacute;n &amp; x", "época­ s", "AΣ İx", "ré-\ncto &nope; &copy 20"]:
        spans = word_spans(t)
        assert [w for w, _, _ in spans] == words(t)
        assert all(0 <= a < z <= len(t) for _, a, z in spans)
    assert near("granero", "graneró") and near("heredo", "ehredo") and not near("seda", "lana") and not near("de", "la")


def test_edge_cases(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, " ".join(VOCAB[:16]))], ITEM)
    docs = spark.createDataFrame([(1, None, "", 0), (2, "", "", 0), (3, " ".join(VOCAB[:16]) * 1, "", 0), (4, (" ".join(VOCAB[:16]) + " ") * 3000, "", 0)], DOC)
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items, "doc_id", "item_id", formula_share=2).collect()} == {(3, 3), (4, 3)}
    assert find_leaks(docs, items.limit(0), "doc_id", "item_id").count() == 0 and find_leaks(docs.limit(0), items, "doc_id", "item_id").count() == 0
    assert Index([]).hits([["a"] * 9]) == {} and Index([(1, " ".join(VOCAB[:9]))]).hits([[], VOCAB[:4], VOCAB[:2] + ["x"] + VOCAB[3:5]]) == {2: [(0, 0, 0)]}


def test_widespread_leaks_are_found(spark):
    """An item, and a fixed part of an item, in some and in all of many different texts."""
    r = random.Random(9)
    items = [(i, sentence(r, 40)) for i in range(3)]
    di = spark.createDataFrame(items, ITEM)
    for n in (30, 200):
        for part in (items[0][1], " ".join(items[1][1].split()[5:27])):
            docs = [(d, f"{sentence(r, 40)} {part if d < n else sentence(r, 22)} {sentence(r, 9)}") for d in range(200)]
            got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), di, "doc_id", "item_id").collect()
            assert {x.doc_id for x in got} == set(range(n)) and len({x.item_id for x in got}) == 1


def test_formulas_of_several_items_and_copies_with_changes(spark):
    r = random.Random(10)
    formula = " ".join(f"formula{i}" for i in range(18))
    items = [(1, f"{sentence(r, 30)} {formula}"), (2, f"{formula} {sentence(r, 40)}"), (3, sentence(r, 60))]
    docs = [(d, f"{sentence(r, 40)} {formula} {sentence(r, 5)}") for d in range(100)]
    quoted = " ".join(items[2][1].split()[20:44])
    docs += [(1000 + d, f"{sentence(r, 8)} copia {d} según {quoted} fin de la cita {d}") for d in range(100)]  # copies that are all distinct
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), "doc_id", "item_id")
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(1000 + d, 3) for d in range(100)}


def test_changes_at_every_third_word(spark):
    r = random.Random(12)
    items = [(1, sentence(r, 60))]
    v = items[0][1].split()
    docs = []
    for step in (3, 4, 5, 6):
        w = v[10:34]
        w = [x if (i + 1) % step else x[0] + "x" + x[2:] + "q" for i, x in enumerate(w)]
        docs.append((step, f"{sentence(r, 20)} {' '.join(w)} {sentence(r, 20)}"))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), "doc_id", "item_id")
    assert {x.doc_id for x in got.collect()} == {3, 4, 5, 6}
