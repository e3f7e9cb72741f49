"""Token operators against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from jobtide.llm import bpe_codec, packing, token_counts
from jobtide.llm.vocabulary import Vocabulary
from tests.llm.conftest import rows_by

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EDGES = [None, "", " ", "\n", "a", "  a  b\n\n c", "it's we'll", "x<|endoftext|>y<|endoftext|>", "é中\U0001f600", "a" * 3000, "-=" * 900, "the " * 30_000, "x" + " " * 70_000 + "y"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(BYTES)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(BYTES)


def ids(codec, text):
    return [int(i) for runs in codec.encode(text) for run in runs for i in run[1].split(b",")[:-1]]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text("ab 's\n\t  é1-=<|endoftxt>", max_size=80))
def test_any_text_is_encoded_and_counted_as_by_the_library(library, codec, counter, text):
    expected = library.encode(text, add_special_tokens=False).ids
    assert ids(codec, text) == expected
    assert counter.count(text) == len(expected)


def test_transducer_takes_parts_of_any_size_in_bounded_memory(library):
    vocabulary = Vocabulary(BYTES)
    transducer = bpe_codec.Transducer(vocabulary)
    piece = ("=-" * 2000).encode()
    whole = list(transducer.encode([piece]))
    assert whole == library.encode(piece.decode(), add_special_tokens=False).ids
    assert list(transducer.encode([piece[i : i + 7] for i in range(0, len(piece), 7)])) == whole
    stream = transducer.encode(b"=" for _ in range(1 << 30))
    assert [next(stream) for _ in range(5)]  # tokens come before the piece ends


def test_decoder_waits_for_unfinished_characters():
    vocabulary = Vocabulary(BYTES)
    decoder = bpe_codec.Decoder(vocabulary)
    parts = [decoder.feed([vocabulary.symbol[b]]) for b in "é€".encode()]
    assert parts == ["", "é", "", "", "€"]
    assert decoder.feed([vocabulary.symbol[0xE2]]) + decoder.close() == "�"


def test_digests_of_edge_cases(spark, docs, library):
    got = rows_by(bpe_codec.encode_decode_digests(docs(EDGES), BYTES), "doc_id")
    for i, text in enumerate(EDGES):
        expected = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(expected, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(expected)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_codec.encode_decode_digests(docs([]), BYTES).count() == 0


def test_ids_and_text_round_trip_and_replace_clashing_columns(docs):
    df = docs(["one two", None]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    encoded = bpe_codec.encode_ids(df, BYTES)
    back = rows_by(bpe_codec.decode_ids(encoded, BYTES), "doc_id")
    assert (back[0]["decoded"], back[1]["decoded"]) == ("one two", "")
    assert back[1]["ids"] == []


def test_counts_keep_rows_and_replace_clashing_columns(docs, library):
    df = docs([*EDGES, "same", "same"]).withColumnRenamed("lang", "n_tokens")
    got = token_counts.count_tokens(df, BYTES, max_tokens=100).collect()
    assert len(got) == len(EDGES) + 2
    for r in got:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 100)
    assert token_counts.count_tokens(docs([]), BYTES).count() == 0


def test_word_ids_by_chunks_are_those_of_whole_texts():
    library, words, rnd = Tokenizer.from_file(WORDS), packing.WordIds(WORDS), random.Random(5)
    assert words.by_chunk
    parts = ["a", "B", " ", "\n", "\t", "'s", "'LL", "É", "ß", "́", "İ", "Σ", "<|endoftext|>", ".", ",", "*", "1", "²", "中", "The"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert words.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_word_ids_of_special_spellings_and_letters_that_nfc_takes_apart():
    library, words, rnd = Tokenizer.from_file(WORDS), packing.WordIds(WORDS), random.Random(7)
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "A<|endoftext|>B", "X<|STARTOFTEXT|>.", "\u0958.", "\u095f!?", "\ufb2a,", "\ufb4e).", "e\u0301.", "\u212b;"]
    parts = ["a", "B", " ", ".", ",", ")", "\u0958", "\u095c", "\ufb2a", "\ufb1d", "\u2126", "\u0344", "<|", "|>", "EndOfText", "endoftext", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(2000)]
    for text in texts:
        assert words.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_packing_is_gapless_complete_and_tight(docs):
    library = Tokenizer.from_file(WORDS)
    texts = [*EDGES, *["word " * n for n in (1, 5, 60, 100, 900, 4094, 4095, 4096, 4097, 9000)], *["tie"] * 400]
    pieces = packing.pack_documents(docs(texts), WORDS).collect()
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for i, text in enumerate(texts):
        own = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        expected = [(k, s, len(own[s : s + 4096]), zlib.crc32(np.array(own[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(own), 4096))]
        assert sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in by_doc[i]) == expected
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.1 * sum(p["length"] for p in pieces) / 4096 + 1
    assert packing.pack_documents(docs([]), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plan_is_best_fit_from_the_largest_down(counts):
    plan = packing.best_fit_plan(counts, 50)
    used: dict[int, int] = {}
    placed: dict[int, int] = {}
    for size, rank, many, first, each, offset in plan:
        for k in range(many):
            sequence = first + k // each
            assert used.get(sequence, 0) == offset + k % each * size
            used[sequence] = used.get(sequence, 0) + size
        assert rank == placed.get(size, 0)
        placed[size] = rank + many
    assert placed == counts and all(v <= 50 for v in used.values())
    gaps: list[int] = []  # one by one
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= size), default=None)
        if fit is None:
            gaps.append(50 - size)
        else:
            gaps[gaps.index(fit)] -= size
    assert sorted(gaps) == sorted(50 - v for v in used.values())
