import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swipewatch.llm import tokens
from swipewatch.llm.tokens import _pieces, _tokenizer, count_tokens, op9_token_counts, spliced

ENCODE = _tokenizer("byte_bpe_50k.json").encode
whole = lambda t: len(ENCODE(t or "", add_special_tokens=False).ids)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\na", "it's we'll ' s", "x\u00a0 y", "x \u00a0y", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>c", "12 34  5", "\u2028 a b", "é ü ß 中文 字", "a\x1c b\x1d c", "a\x85 b", "😀 😀😀 é́ x", "\t\ta b\r\n c"]


@pytest.mark.parametrize("text", ODD)
def test_pieces_and_chunks_equal_whole_text(text):
    assert _pieces("byte_bpe_50k.json").count(text) == whole(text)
    for chunk, overlap in ((7, 2), (16, 4)):
        assert spliced(ENCODE, text * 9, chunk, overlap) == whole(text * 9)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab' \n\t.1é中\u00a0<|>s", max_size=200), st.integers(3, 40), st.integers(1, 9))
def test_random_texts(text, chunk, overlap):
    assert _pieces("byte_bpe_50k.json").count(text) == whole(text) == spliced(ENCODE, text, chunk, overlap)


def test_widening_without_any_boundary():
    for text in ("x" * 5000, "ab" * 3000, " " * 4000, "word " * 50 + "y" * 4000 + " word" * 50):
        assert spliced(ENCODE, text, 256, 16) == whole(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sl \n.,19é中文。，\u00a0<|>", max_size=300), st.integers(3, 60), st.integers(1, 9))
def test_random_texts_with_few_spaces(text, chunk, overlap):
    assert spliced(ENCODE, text, chunk, overlap) == whole(text)


@pytest.mark.parametrize("make", [
    lambda r: "".join(r.choice("的一是了我不人在他有这个上们来到时大地为子中你说生国年着就那和要她出也得里后自以会，。") for _ in range(1_000_000)),
    lambda r: "\n".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 12))) for _ in range(150_000)),
    lambda r: "".join(r.choice("etaoinshrdlu") for _ in range(300_000))])
def test_a_million_characters_without_spaces_cost_a_few_times_what_the_library_takes(make):
    import random
    import time

    text = make(random.Random(1))
    began = time.perf_counter()
    n = whole(text)
    library = time.perf_counter() - began
    began = time.perf_counter()
    assert spliced(ENCODE, text) == n
    assert time.perf_counter() - began < 6 * library + 1


def test_table(frame):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "two words", None), (3, "long text, " * 9000, "c")]
    out = count_tokens(frame(rows, "doc_id long, text string, N_TOKENS string"))
    assert out.columns == ["doc_id", "text", "N_TOKENS", "_n_tokens"]
    assert sorted((r[0] or 0, r[3]) for r in out.collect()) == sorted([(1, 0), (1, 0), (2, 0), (0, 2), (3, whole(rows[4][1]))])
    assert count_tokens(frame([], "text string")).count() == 0


def test_query_equals_library(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 2000)
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = op9_token_counts(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        n = whole(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    assert all(spliced(ENCODE, t, 500, 32) == whole(t) for t in list(texts.values())[:60])
