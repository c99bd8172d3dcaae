"""Token counts against the sentencepiece library."""

import heapq
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from allelegate.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
MERGES = tc.Merges(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "▁", "▁a", "a▁", "▁ a", "a▁ ▁b", "<s>", "</s>x", "<unk> x", "<0x0A>", "x²..", "m²2", "ﬁ", "ｆ",
    "\x00a", "a\tb\r\nc", " \n ", "한국", "😀 😀", "é é", "    def f():\n        return 1", "a" * 3000, " " * 3000, "ab" * 200 + " " * 90 + "b", "ÈMENT!!",
]


def test_odd_texts():
    assert [MERGES.count(t) for t in ODD] == [len(LIBRARY.encode(t)) for t in ODD]
    assert MERGES.count(None) == 0


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), st.text("aeth  inrÉ²▁\n.,!1_", max_size=300)))
def test_any_text(text):
    assert MERGES.count(text) == len(LIBRARY.encode(text))


@pytest.mark.parametrize("size", [1, 3, 17])
def test_slices_and_long_units(monkeypatch, size):
    monkeypatch.setattr(tc, "SLICE", size)
    monkeypatch.setattr(tc, "LONG", size)
    merges, rng = tc.Merges(PATH), random.Random(size)
    texts = ODD[:-5] + ["".join(rng.choice("aeth  inr.▁\nÉ") for _ in range(rng.randrange(200))) for _ in range(300)]
    assert [merges.count(t) for t in texts] == [len(LIBRARY.encode(t)) for t in texts]


def test_full_memory(monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 2)
    merges = tc.Merges(PATH)
    assert [merges.count(t) for t in ODD] == [len(LIBRARY.encode(t)) for t in ODD]
    assert len(merges.of_word) <= 2 and len(merges.of_unit) <= 2


def test_the_heap_joins_once_per_token_less(monkeypatch):
    popped = []
    monkeypatch.setattr(heapq, "heappop", lambda heap, pop=heapq.heappop: popped.append(1) or pop(heap))
    assert MERGES.merged("▁international") == len(LIBRARY.encode("international"))
    assert popped


def test_rows(spark):
    rows = [(1, None, "x"), (None, "", "y"), (2, "a b c", None), (2, "a b c", None), (3, "word " * 60000, "z"), (4, "ü" * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {tuple(r) for r in tc.counted(docs, PATH, 4096).collect()}
    size = lambda t: len(LIBRARY.encode(t)) if t else 0
    assert got == {(i, len((t or "").encode()), size(t), size(t) > 4096) for i, t, _ in rows}
    assert tc.counted(docs, PATH, 4096).count() == len(rows)
    assert tc.counted(docs.limit(0), PATH, 4096).count() == 0
