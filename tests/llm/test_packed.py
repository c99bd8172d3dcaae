"""Packed ids: exact round trips, and whole texts against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from allelegate.llm import packed_ids
from allelegate.plans.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.integers(0, 70), st.integers(0, 70))
def test_round_trip(bits, ids, start, stop):
    ids = np.array(ids, np.uint64).astype(np.uint32) & np.uint32((1 << bits) - 1)
    raw = packed_ids.pack(ids, bits)
    assert len(raw) == (bits * len(ids) + 7) // 8
    start, stop = min(start, len(ids)), min(stop, len(ids))
    assert list(packed_ids.unpack(raw, bits, start, stop)) == list(ids[start:stop])


def test_too_wide():
    with pytest.raises(ValueError, match="more than 3 bits"):
        packed_ids.pack(np.array([8]), 3)


TEXTS = [None, "", " \n ", "The cat\tsat.\nOn x\x1cy", "İstanbul ΣΑΣ", "<|endoftext|> x<|startoftext|>y", "it's   'll 12 ３", "a" * 5000, "long words " * 30_000]


def test_files(spark):
    """Ids, places and sums as the library's whole-text encoding gives them; a range from its block only."""
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 11, t) for i, t in enumerate(TEXTS)] + [(3, "twice"), (3, "twice"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    folder = scratch_path(spark, "ids")
    packed_ids.write_ids(docs, folder, PATH, 1)
    got = sorted((tuple(r) for r in packed_ids.read_documents(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    place, by_id = 0, {}
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        by_id.setdefault(doc, []).append((len(ids), zlib.crc32(ids.tobytes()), ids))
    for doc, start, n, crc in got:
        assert start == place and (n, crc) in [x[:2] for x in by_id[doc]]
        place += n
    one = rows[-4][0]
    assert list(packed_ids.read_range(spark, folder, [one])[one]) == list(by_id[one][0][2])


def test_empty_table(spark):
    assert packed_ids.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_are_encoded_many_at_a_time():
    encoder = packed_ids.Encoder(PATH)
    words = [f"{a}{b}x{c}" for a in "abcdefghijk" for b in "éüñopq" for c in "rstuvwß"]
    whole = Tokenizer.from_file(PATH)
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    found = encoder.encode([" ".join(words) + " A|B |, Word."])[0]
    assert list(found) == whole.encode(" ".join(words) + " A|B |, Word.", add_special_tokens=False).ids
    assert len(given) < 20 < len(words)
