from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from aguayo.llm.packing import SumOfSquares, pack_rows, pack_texts
from aguayo.llm.tokens import RANKS, WORDS, tokenizer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=80))
def test_nothing_overlaps_or_is_lost(sizes):
    out = list(pack_rows(enumerate(sizes), 30, 0))
    fill, total = defaultdict(int), defaultdict(int)
    for i, piece, n, c, at in out:
        assert fill[c] == at, "items follow one another in a container"
        fill[c] += n
        total[i] += n
    assert all(f <= 30 for f in fill.values())
    assert [total[i] for i in range(len(sizes))] == sizes
    for i, s in enumerate(sizes):
        parts = [n for j, _, n, _, _ in out if j == i]
        assert len(parts) == 1 if s <= 30 else parts[:-1] == [30] * (len(parts) - 1)


def test_rule_against_all_levels():
    import random

    r, s = random.Random(1), SumOfSquares(40)
    for _ in range(500):
        size, before = r.randint(1, 39), s.levels.copy()

        def cost(h):
            n = before.copy()
            n[h] -= h > 0
            n[h + size] += h + size < 40
            return sum(int(x) ** 2 for x in n[1:40])

        best = min(cost(h) for h in range(0, 41 - size) if not h or before[h])
        _, at = s.place(size)
        assert cost(at) == best


def test_little_space_is_left():
    import random

    r = random.Random(2)
    sizes = [min(6000, int(r.lognormvariate(5.3, 1))) for _ in range(5000)]
    used = len({c for *_, c, _ in pack_rows(enumerate(sizes), 2048, 0)})
    assert sum(sizes) / used / 2048 > 0.97


def test_tokens_are_those_of_the_tokenizer():
    t = tokenizer(RANKS)
    for x in ["", "El orillo  se cosió,\n\n con 27 mm;\t¿sí? ", "K2S1" * 100, "it's «paño» 日本 \U0001f9f6", " \n \n x", "a" * 5000]:
        assert t.count(x) == len(t.encode(x)) and (len(x) > 300 or sum(t.parts(x)[1]) == t.count(x)), x
    assert tokenizer(WORDS).count("año 2½ n.º_x  ý") == len(["año", "2½", "n", ".", "º", "_", "x", "y", "́"])


def test_table_edge_cases(spark):
    rows = [(1, ""), (2, None), (3, "uno dos tres"), (3, "uno dos tres"), (4, "x " * 5000), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS piece", "1 AS k").coalesce(1)
    got = pack_texts(df, "doc_id", "text", capacity=100).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, None} and len([r for r in got if r.doc_id == 3]) == 2
    assert all(r.container_start + r.n_tokens <= 100 for r in got)
    assert pack_texts(df.limit(0), "doc_id", "text").count() == 0
    fills = pack_texts(df.repartition(3), "doc_id", "text", capacity=100).groupBy("container_id").sum("n_tokens").collect()
    assert all(r[1] <= 100 for r in fills)


def test_empty_items_open_one_container():
    assert [c for *_, c, _ in pack_rows([(1, 0), (2, 0), (3, 0), (4, 5), (5, 0)], 10, 0)] == [0] * 5
    assert [c for *_, c, _ in pack_rows([(1, 0), (2, 10), (3, 0), (4, 23)], 10, 0)] == [0, 0, 1, 1, 2, 3]
