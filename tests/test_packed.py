import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aguayo.operators.packed import candidates, cheapest, digest, literal_bits, long_form, unpack, value_codes

CASES = {
    '"hilo ""a dos cabos"""|tinte de añil': ['hilo "a dos cabos"', "tinte de añil"],
    "totora; cochinilla | madera | piel de zorro": ["totora", "cochinilla", "madera", "piel de zorro"],
    "['Resina vegetal', 'ALGODÓN; hilado fino']": ["Resina vegetal", "ALGODÓN; hilado fino"],
    '["ca\\u00f1a hueca", "hilo \\"a dos cabos\\""]': ["caña hueca", 'hilo "a dos cabos"'],
    '{cuentas,"LINO, x"}': ["cuentas", "LINO, x"],
    '{a,"b ""c"""}': ["a", 'b "c"'],
    "fibra (sin identificar; ver informe)": ["fibra (sin identificar; ver informe)"],
    "• a b • c d": ["a b", "c d"],
    "madera · ·yute": ["madera", "yute"],
    "hilo de 0,5 mm; torsión 2/2": ["hilo de 0,5 mm", "torsión 2/2"],
    "a||b||": ["a", "b"],
    "cáñamo\r\nyute\nseda": ["cáñamo", "yute", "seda"],
    "algodón y fibra de camélido": ["algodón y fibra de camélido"],
    "seda；lino、yute": ["seda", "lino", "yute"],
    '"unclosed, x': ['"unclosed', "x"],
    "": [],
}


def test_dialects():
    for t, want in CASES.items():
        assert cheapest(t, {}) == want, t


WORD = st.text("abcñé ", min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORD, min_size=2, max_size=5), st.sampled_from(["; ", "|", ", ", " / ", "\n", "\t", " · ", "||"]), st.data())
def test_round_trip(values, delim, data):
    values = [v + (data.draw(st.sampled_from(["", ", x", ' "q"', " (a/b)"]))) for v in values]
    packed = delim.join('"' + v.replace('"', '""') + '"' if any(c in v for c in ',"') else v for v in values)
    assert cheapest(packed, {}) == values
    assert cheapest(json.dumps(values), {}) == values
    assert cheapest(json.dumps(values, ensure_ascii=False), {}) == values


def test_unpack_edge_cases(spark):
    long = "; ".join(f"v{i}" for i in range(30_000))
    rows = [(1, "a; b", "z"), (2, None, "z"), (3, " nan ", "z"), (4, "", "z"), (5, "solo", "z"), (6, ";;", "z"), (7, long, "z"), (1, "a; b", "z")]
    df = spark.createDataFrame(rows, "row_id long, f string, value_text string").withColumnRenamed("value_text", "pos")
    got = unpack([("t", df, "row_id", ["f"])]).collect()
    assert sorted((r.row_id, r.pos, r.value_text) for r in got if r.row_id == 1) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert {r.row_id for r in got} == {1, 7} and max(r.pos for r in got) == 30_000
    assert unpack([("t", df.limit(0), "row_id", ["f"])]).count() == 0
    assert {r.row_id for r in unpack([("t", df, "row_id", ["f"])], 1).collect()} == {1, 5, 7}


def test_hot_value(spark):
    df = spark.createDataFrame([(i, "lana, sin teñir; seda" if i % 3 else "yute | seda") for i in range(900)], "row_id long, f string")
    got = unpack([("t", df, "row_id", ["f"])])
    assert got.count() == 600 * 3 + 300 * 2


def test_fields_of_the_same_name_keep_their_own_codes(spark):
    a = spark.createDataFrame([(1, "x; y")], "row_id long, f string")
    b = spark.createDataFrame([(i, "x, y") for i in range(50)], "row_id long, f string")
    both = [("a", a, "row_id", ["f"]), ("b", b, "row_id", ["f"])]
    books = value_codes(long_form(both), {"a": 1, "b": 50})
    assert set(books) == {("b", "f")} and digest("x") in books["b", "f"]
    got = {(r.src_table, r.row_id, r.pos): r.value_text for r in unpack(both).collect()}
    assert len(got) == 102 and got["a", 1, 2] == "y" and got["b", 49, 1] == "x"
    with pytest.raises(ValueError):
        unpack([both[0], both[0]])


def test_any_set_of_delimiters_and_long_values_have_codes(spark):
    parses = [v for _, v in candidates("a·b; c,d | e/f\tg")]
    assert len(parses) == 2**6 and ["a·b", "c,d", "e/f", "g"] in parses and ["a·b", "c,d", "e/f\tg"] in parses
    long = "v, " * 100 + "w"  # 301 characters that stand alone as one value, often
    rows = [(i, long) for i in range(0, 300)] + [(5000, f"{long}; x"), (5001, "x; y")]
    books = value_codes(long_form([("t", spark.createDataFrame(rows, "row_id long, f string"), "row_id", ["f"])]), {"t": 302})
    assert books["t", "f"][digest(long)] < literal_bits(long) / 50
