"""Encoding against the SentencePiece library, in one piece and in chunks of any size."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from allelegate.llm import piece_scan

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "  Hello  world\n\tx é中\x00", " ", "   ", "▁▁x ▁", "\n\n a\r\n", "a" * 300, "=" * 500, " " * 200 + "x", "<s> </s> <0x41> x", "🙂🙂 é", "ﬁ①" * 40]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return piece_scan.Pieces(PATH)


def in_chunks(pieces, text, size):
    text, side = piece_scan.SPACE + text.replace(" ", piece_scan.SPACE), pieces.longest
    chunks = [
        piece_scan.Chunk(pieces, text[max(0, i - side) : i], text[i : i + size], text[i + size : i + size + side])
        for i in range(0, len(text), size)
    ]
    states = piece_scan.scan([c.matrix() for c in chunks])
    return [i for c, (a, b) in zip(chunks, states, strict=True) for i in c.ids(a, b)]


@pytest.mark.parametrize("text", ODD)
def test_like_the_library(library, pieces, text):
    want = library.encode(text)
    assert pieces.encode(text) == want
    assert all(in_chunks(pieces, text, size) == want for size in (1, 2, 3, 7, 16, 40))
    assert pieces.decode(want) == library.decode(want) == text.replace("▁", " ")


def test_chunks_of_words_walk_the_words_at_their_cuts_only(library, pieces, monkeypatch):
    text = "Some words, näher\nbetween  two cuts 中x " * 60
    walked, lattice = [], piece_scan.Pieces.lattice
    monkeypatch.setattr(piece_scan.Pieces, "lattice", lambda self, t, start, stop, *rest: walked.append(stop - start) or lattice(self, t, start, stop, *rest))
    assert in_chunks(pieces, text, 300) == library.encode(text)
    assert 0 < sum(walked) < len(text) / 2


@pytest.mark.parametrize("cache", [0, 3, 1000])
def test_words_are_learned_together_and_a_full_memory_keeps_none(library, monkeypatch, cache):
    monkeypatch.setattr(piece_scan, "CACHE", cache)
    monkeypatch.setattr(piece_scan, "BLOCK", 40)
    own = piece_scan.Pieces(PATH)
    texts = [None, "", "a ab abc abcd abc.", "abc abcd\n\nabcde", *ODD, "ab abc"]
    assert [ids.tolist() for ids in own.encode_all(texts)] == [library.encode(t) if t else [] for t in texts]
    assert own.encode_all([]) == [] and (cache or not own.known)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("etaoin shrdlu.=-\né▁中"), min_size=1, max_size=60), st.integers(1, 20))
def test_any_text_and_cut(library, pieces, text, size):
    want = library.encode(text)
    assert pieces.encode(text) == want
    assert in_chunks(pieces, text, size) == want


def test_table(spark, library):
    texts = [None, "", *ODD, "the quick brown fox " * 50, "the quick brown fox " * 50, "x" * 700]
    docs = spark.createDataFrame([(i if i else None, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    rows = piece_scan.encoded(docs, PATH, chunk=128).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = got[i if i else None]
        assert r["ids"] == (library.encode(t) if t else []) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
    assert got[len(texts) - 1]["n_chunks"] == 6
    back = {r["doc_id"]: r["text"] for r in piece_scan.decoded(spark.createDataFrame(rows), PATH).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts) if t)


def test_empty_table(spark):
    assert piece_scan.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
