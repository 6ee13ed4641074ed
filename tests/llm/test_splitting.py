from hypothesis import given, settings
from hypothesis import strategies as st

from aguayo.llm.splitting import split_spans, split_texts
from aguayo.llm.tokens import RANKS, WORDS, tokenizer

PART = st.sampled_from(["uno", "dos, ", "tres. ", "Cuatro. ", "\n", "\n\n", " ", "K2S1T3" * 20, "- item\n", "¿Qué? ", "日本語", "é ", "; ", "\r\n\r\n"])


@settings(max_examples=120, deadline=None)
@given(st.lists(PART, max_size=120).map("".join), st.sampled_from([WORDS, RANKS]), st.sampled_from([(20, 5), (40, 0), (12, 11)]))
def test_pieces_cover_the_text(text, ranks, size):
    limit, overlap = size
    tok = tokenizer(ranks)
    spans = split_spans(text, tok, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    if tok.count(text) <= limit:
        assert len(spans) == 1
        return
    for (a, z, n, rep), (b, y, m, again) in zip(spans, spans[1:]):
        assert a <= b <= z < y and again <= overlap
        if ranks == WORDS:
            assert tok.count(text[b:z]) == again == min(overlap, n)
    for a, z, n, _ in spans:
        if ranks == WORDS:
            assert n == tok.count(text[a:z]) <= limit
        else:
            assert n == tok.count(text[a:z]) <= limit


def test_weak_boundaries_merge_first():
    text = "\n\n".join(" ".join(f"Frase {p} {s} con palabras." for s in range(3)) for p in range(6))
    tok = tokenizer(WORDS)
    spans = split_spans(text, tok, 40, 0)
    assert all(text[a:z].startswith("Frase") and text[a:z].rstrip().endswith(".") for a, z, _, _ in spans)
    assert all(text[z - 1] == "\n" for _, z, _, _ in spans[:-1]), "paragraphs stay whole where they fit"


def test_table_edge_cases(spark):
    rows = [(1, "x " * 50), (2, None), (3, ""), (4, "corto"), (5, "K" * 3000), (6, "a b. " * 60_000), (1, "x " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS piece", "'t' AS t")
    got = split_texts(df, "doc_id", "text", limit=30, overlap=3).collect()
    assert {r.doc_id for r in got} == {1, 5, 6} and all(r.n_tokens <= 30 for r in got)
    tok = tokenizer(RANKS)
    assert all(tok.count(r.piece_text) <= 30 for r in got)
    assert split_texts(df.limit(0), "doc_id", "text").count() == 0
    six = sorted((r.piece, r.start_char, r.end_char) for r in got if r.doc_id == 6)
    assert [p for p, _, _ in six] == list(range(1, len(six) + 1)) and six[-1][2] == 300_000
