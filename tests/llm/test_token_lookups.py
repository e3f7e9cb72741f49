"""How often the token operators ask for what recurs or is rare, and that this changes no result."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from jobtide.llm import bpe_codec, common, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", " a", "a ", "a  b", "it's we'LL.", "<|endoftext|>", "<|ENDOFTEXT|> x", "É ß İ", "x y", "中 文", "a" * 700, "-=" * 400, "\n \n", "1 22 a1", "zq,zq.", "é."]


def made_up(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 14))) + rnd.choice(["", "", ".", ",", "!"]) for _ in range(n)]


def texts(seed):
    rnd = random.Random(seed)
    words = made_up(rnd, 3000)
    return [*ODD, *[rnd.choice([" ", " ", "\n"]).join(rnd.choice([*words, *ODD]) for _ in range(rnd.randint(1, 60))) for _ in range(120)]]


def test_rare_words_reach_the_library_many_at_a_time():
    words, library = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    calls = []

    class Counted:
        def encode(self, text, **how):
            calls.append(text)
            return library.encode(text, **how)

    words.library = Counted()
    rare = made_up(random.Random(3), 4000)
    got = [bytes(x) for x in words.encode_all(pa.array([" ".join(rare[i : i + 40]) for i in range(0, 4000, 40)]))]
    assert len(calls) < 100
    assert got == [np.array(library.encode(" ".join(rare[i : i + 40]), add_special_tokens=False).ids, "<u4").tobytes() for i in range(0, 4000, 40)]


def test_ids_of_many_texts_are_those_of_each(monkeypatch):
    library, given = Tokenizer.from_file(WORDS), texts(1)
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in given]
    assert [bytes(x) for x in packing.WordIds(WORDS).encode_all(pa.array(given))] == expected
    # Runs of a few bytes, a cache that keeps next to nothing.
    monkeypatch.setitem(common.slices.__globals__, "TOGETHER", 50)
    assert [bytes(x) for s in common.slices(pa.array(given), 50) for x in packing.WordIds(WORDS, 6).encode_all(s)] == expected
    assert list(packing.WordIds(WORDS).encode_all(pa.array([], pa.string()))) == []


def test_runs_of_many_texts_are_those_of_each(monkeypatch):
    library, codec, given = Tokenizer.from_file(BYTES), bpe_codec.Codec(BYTES), texts(2)
    expected = [library.encode(t, add_special_tokens=False).ids for t in given]
    for together in (1 << 23, 40):
        monkeypatch.setattr(bpe_codec, "TOGETHER", together)
        listed, raw = [b""] * len(given), [b""] * len(given)
        for place, _, ids, data in codec.encode_all(given):
            listed[place] += ids
            raw[place] += data
        assert listed == [b"".join(b"%d," % i for i in ids) for ids in expected]
        assert raw == [t.encode() for t in given]


def test_automaton_keeps_few_steps_and_finds_every_token(monkeypatch):
    tokens = {b"a": 0, b"b": 1, b"ab": 2, b"bab": 3, b"abba": 4}
    for most in (bpe_codec.STEPS, 0):
        monkeypatch.setattr(bpe_codec, "STEPS", most)
        step, ending = bpe_codec.automaton(tokens)
        state, data = 0, b"abbabbacabab"
        for end, byte in enumerate(data, 1):
            state = step[state << 8 | byte]
            assert list(ending[state]) == [(n, tokens[data[end - n : end]]) for n in range(min(4, end), 0, -1) if data[end - n : end] in tokens]
