import random

import pyarrow as pa
import pytest

from larkspur.llm import tokenize
from larkspur.llm.piece_tokenizer import LONG, PieceModel
from larkspur.llm.queries import piece_model_path

spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=piece_model_path())


@pytest.fixture(scope="module")
def model():
    return PieceModel(tokenize.read_model(piece_model_path()))


CASES = [
    "", " ", "  ", "a", " a", "a ", "    b   c      d", "\n\n x\n", "▁a ▁", "日本語テキスト", "😀😀 emoji", "a" * 26, "the" * 50, "\t\tint x;\r\n", " " * 37 + "x", "\x00abc", "é́ñ",
    "<s> </s> <0x0A> <unk>", "ha" * 300, "=-" * 33 + "-----------=====", "x" * (LONG + 500), " " * (LONG + 100), "word " * 30_000, None,
]


def test_same_ids_and_texts_as_the_library(model, library):
    rnd = random.Random(5)
    texts = CASES + ["".join(rnd.choice("abcde ▁ \n th in er the日é0011--==  __") for _ in range(rnd.randint(1, 200))) for _ in range(400)]
    for text, ids in zip(texts, model.encode(pa.array(texts))):
        expected = library.encode(text or "", add_bos=True, add_eos=True)
        assert ids.tolist() == expected
        assert model.decode(ids) == library.decode(expected)


def test_long_words(model, library, monkeypatch):
    import larkspur.llm.piece_tokenizer as pt

    rnd = random.Random(3)
    english = "".join(rnd.choice(["the", "quick", "brown", "fox", "jumped", "over", "international", "ization", "s", "é", "日本"]) for _ in range(1500))
    words = ["abcab" * 2000, english, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)), "".join(rnd.choice("acgt") for _ in range(6000)), "=-" * 5000, "x" * 9001]
    for run in (pt.LONG_RUN, 700):
        monkeypatch.setattr(pt, "LONG_RUN", run)
        model.memo.clear()
        model.memo.__init__()
        for word, ids in zip(words, model.encode(pa.array(words))):
            assert ids.tolist() == library.encode(word, add_bos=True, add_eos=True)


def thue_morse(n: int) -> tuple[str, str]:
    a, b = "A", "B"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_a_polynomial_hash_confuses(model, library):
    texts = [*thue_morse(1024), *thue_morse(4096)]
    for text, ids in zip(texts, model.encode(pa.array(texts))):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_words_of_equal_hashes(library, monkeypatch):
    import larkspur.llm.piece_tokenizer as pt

    class Weak(pt.Spans):
        def both(self, start, end):
            h, check = super().both(start, end)
            return h % 5, check

    monkeypatch.setattr(pt, "Spans", Weak)
    own = PieceModel(tokenize.read_model(piece_model_path()))
    for text in ("one two three four five", "six", "two six seven eight one", "six"):
        assert next(own.encode(pa.array([text]))).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_memo_of_bounded_size(model, library, monkeypatch):
    import larkspur.llm.piece_tokenizer as pt

    monkeypatch.setattr(pt, "MEMO_LIMIT", 3)
    for text, ids in zip(["one two three four five", "two six seven eight"], model.encode(pa.array(["one two three four five", "two six seven eight"]))):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_operator(spark, library):
    rows = [(1, "a b", 9), (1, "a b", 9), (2, None, 9), (None, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    ids = tokenize.encode(df, piece_model_path())
    assert sorted(len(r["ids"]) for r in ids.collect()) == [2, 2, 4, 4]
    back = {(r["doc_id"], r["text"]) for r in tokenize.decode(ids, piece_model_path()).collect()}
    assert back == {(1, "a b"), (2, ""), (None, "")}
    assert tokenize.round_trip_digests(df, piece_model_path()).count() == 4
    assert tokenize.round_trip_digests(df.limit(0), piece_model_path()).count() == 0
