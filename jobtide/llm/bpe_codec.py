"""Byte-pair encoding as a streaming transducer, decoding as a byte-to-text state machine."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import TOGETHER, Memo, map_batches, parts_at_spaces, put_in_place, worker_cache
from jobtide.llm.vocabulary import Vocabulary

_NEVER = 1 << 60
#: Steps of the automaton that are kept.
STEPS = 1_000_000


class Transducer:
    """Encodes a piece from left to right in memory that does not grow with it.

    An encoding is right exactly when each token pair in it is what merging the pair's own bytes gives.
    So the last token of every prefix is unique, and it follows from the last tokens of the ``lookahead``
    prefixes before it, where ``lookahead`` is the length of the longest token the merge list can make: no later
    token can begin earlier. Every continuation goes through one of these prefixes; tokens that the
    chains of all of them share are stable and are emitted. The tokens that end at a prefix come from an automaton of all tokens, byte by byte.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.merges = vocabulary.merges
        self.lookahead = sufficient_lookahead(vocabulary)
        self.step, self.ending = automaton({t: i for t, i in vocabulary.tokens.items() if len(t) <= self.lookahead})
        self.parts = {merged: pair for pair, (_, merged) in self.merges.items()}
        self.rank = {merged: rank for rank, merged in self.merges.values()}
        self.right = Memo(lambda t: self._spine(t, 1))
        self.left = Memo(lambda t: self._spine(t, 0))
        self.fits = Memo(self._fits)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Symbols at one edge of a token over its making, each with the rank of the merge that ends it."""
        found, end = [], _NEVER
        while True:
            found.append((token, end))
            if token not in self.parts:
                return found
            end = self.rank[token]
            token = self.parts[token][side]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """False if some merge across the border of two tokens would have come before the merges that made
        them: earlier than the left symbol's end, and not later than the right one's, as the leftmost goes first."""
        for a, a_ends in self.right[pair[0]]:
            for b, b_ends in self.left[pair[1]]:
                across = self.merges.get((a, b))
                if across and across[0] < a_ends and across[0] <= b_ends:
                    return False
        return True

    def short(self, piece: bytes) -> list[int]:
        """Token ids of a piece of at most ``lookahead`` bytes, whose prefix ends are all at hand."""
        step, ending, fits = self.step, self.ending, self.fits
        state, last, sizes = 0, [-1], [0]
        for end, byte in enumerate(piece, 1):
            state = step[state << 8 | byte]
            for size, token in ending[state]:
                left = last[end - size]
                if left < 0 or fits[left, token]:
                    last.append(token)
                    sizes.append(size)
                    break
            else:
                raise ValueError("the vocabulary cannot spell this piece")
        found, end = [], len(piece)
        while end:
            found.append(last[end])
            end -= sizes[end]
        return found[::-1]

    def encode(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece that arrives in parts of any size."""
        look, step, ending, fits = self.lookahead, self.step, self.ending, self.fits
        state = 0  # the longest token's beginning that ends here
        # One node per prefix end, the last ``look + 1`` of them: (token, node before it, depth).
        nodes = [(-1, None, 0)]
        emitted, steps = 0, 0
        for part in pieces:
            for begin in range(0, len(part), look):
                block = part[begin : begin + look]
                for byte in block:
                    state = step[state << 8 | byte]
                    # The longest token is most often the right one; which is tried first changes nothing else.
                    for size, token in ending[state]:
                        node = nodes[-size]
                        if node[0] < 0 or fits[node[0], token]:
                            nodes.append((token, node, node[2] + 1))
                            break
                    else:
                        raise ValueError("the vocabulary cannot spell this piece")
                steps += len(block)
                del nodes[: -look - 1]
                if steps > 2 * look:
                    steps = 0
                    shared = _shared(nodes)
                    yield from _tokens(shared, emitted)
                    emitted = shared[2]
                    nodes = _forget(nodes, shared)
        yield from _tokens(nodes[-1], emitted)


def automaton(tokens: dict[bytes, int]) -> tuple[dict[int, int], list[tuple[tuple[int, int], ...]]]:
    """``(step, ending)``: the state after ``state << 8 | byte``, and ``(bytes, id)`` of the tokens that end in a state, longest
    first. A state is the longest end of the bytes so far that begins a token; 0 is the empty one. Steps that lead
    out of a token's beginning are found when they are first taken and kept while there are fewer than ``STEPS``."""
    made: dict[bytes, int] = {b"": 0}
    for token in tokens:
        for size in range(len(token), 0, -1):
            if token[:size] in made:
                break
            made[token[:size]] = -1
    order = sorted(made, key=len)
    for state, name in enumerate(order):
        made[name] = state
    ending: list[tuple[tuple[int, int], ...]] = [()] * len(order)
    shorter = [0] * len(order)

    class Steps(dict):
        def __missing__(self, key: int) -> int:
            state = key >> 8
            to = self[shorter[state] << 8 | key & 255] if state else 0
            if len(self) < STEPS:
                self[key] = to
            return to

    step = Steps()
    for state, name in enumerate(order[1:], 1):
        before = made[name[:-1]]
        shorter[state] = step[shorter[before] << 8 | name[-1]] if before else 0
        own = ((len(name), tokens[name]),) if name in tokens else ()
        ending[state] = own + ending[shorter[state]]
        step[before << 8 | name[-1]] = state
    return step, ending


def _shared(nodes: list) -> tuple:
    """The deepest node that the chains of all given nodes go through."""
    level = {id(n): n for n in nodes}
    while len(level) > 1:
        deepest = max(level.values(), key=lambda n: n[2])
        del level[id(deepest)]
        level[id(deepest[1])] = deepest[1]
    return next(iter(level.values()))


def _forget(nodes: list, shared: tuple) -> list:
    """The same chains, with everything before the shared node let go."""
    made = {id(shared): (shared[0], None, shared[2])}

    def copy(node):
        chain = []
        while id(node) not in made:
            chain.append(node)
            node = node[1]
        for n in reversed(chain):
            made[id(n)] = (n[0], made[id(n[1])], n[2])

    for n in nodes:
        copy(n)
    return [made[id(n)] for n in nodes]


def _tokens(node: tuple, after: int) -> list[int]:
    found = []
    while node is not None and node[2] > after:
        found.append(node[0])
        node = node[1]
    return found[::-1]


def sufficient_lookahead(vocabulary: Vocabulary) -> int:
    """Bytes of the longest token that the merge list can make: as many prefix ends fix all later tokens."""
    longest = dict.fromkeys(vocabulary.symbol, 1)
    for (left, right), (_, merged) in vocabulary.merges.items():
        longest[merged] = longest[left] + longest[right]
    return max(longest.values())


class Decoder:
    """Ids to text, token by token: bytes of an unfinished character wait for the next token; malformed
    bytes become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def close(self) -> str:
        return self.state.decode(b"", True)


class Codec:
    """Encodes whole texts in blocks. What pieces and chunks give is kept in bounded caches, as runs: number
    of ids, their decimal text with a comma after each, their bytes, and the ids."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        transducer = Transducer(v)
        self.listed = {i: b"%d," % i for i in v.bytes_of}

        def encoded(piece: str) -> tuple[int, ...]:
            data = piece.encode()
            return tuple(transducer.short(data) if len(data) <= transducer.lookahead else transducer.encode([data]))

        self.piece = Memo(encoded, 800_000)
        # The pattern takes a space and ASCII letters as one piece.
        self.after_space = Memo(lambda s: self.made(self.piece[" " + s]) if s.isascii() and s.isalpha() else self.run(" " + s), 800_000)

    def run(self, block: str) -> tuple[int, bytes, bytes]:
        ids = tuple(i for p in self.vocabulary.cut(block) for i in self.piece[p])
        return self.made(ids)

    def made(self, ids: tuple[int, ...]) -> tuple[int, bytes, bytes]:
        return len(ids), b"".join(map(self.listed.__getitem__, ids)), b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def runs(self, blocks: list[tuple[bool, str]]) -> Iterator[tuple[int, bytes, bytes]]:
        """The run of each block, ``(is_special, text)``. A chunk that recurs in them is asked for once."""
        v = self.vocabulary
        whole = {k: self.made((v.special[b],)) if special else self.run(b) for k, (special, b) in enumerate(blocks) if special or not v.in_chunks(b)}
        chunks, at, edges = parts_at_spaces(pa.array(["" if k in whole else b for k, (_, b) in enumerate(blocks)], pa.string()))
        first = edges[:-1]
        begun = [whole[k] if k in whole else self.run(chunks[at[place]]) for k, place in enumerate(first.tolist())]
        at[first] = np.arange(len(chunks), len(chunks) + len(begun))
        sizes, listed, raw = zip(*map(self.after_space.__getitem__, chunks), *begun, strict=True)
        counts = np.add.reduceat(np.array(sizes)[at], first).tolist()
        texts = []
        for found in (listed, raw):
            data, begins = put_in_place(found, at)
            begins = begins[edges].tolist()
            texts.append([data[a:b] for a, b in zip(begins, begins[1:])])
        yield from zip(counts, *texts, strict=True)

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """``(place, *run)`` of every block of the texts in order; blocks are encoded several at a time."""
        blocks, places, size = [], [], 0
        for place, text in enumerate(texts):
            for special, segment in self.vocabulary.segments(text):
                for block in [segment] if special else self.vocabulary.blocks(segment):
                    blocks.append((special, block))
                    places.append(place)
                    size += len(block)
                    if size >= TOGETHER:
                        yield from ((p, *r) for p, r in zip(places, self.runs(blocks), strict=True))
                        blocks, places, size = [], [], 0
        if blocks:
            yield from ((p, *r) for p, r in zip(places, self.runs(blocks), strict=True))

    def encode(self, text: str) -> Iterator[list[tuple[int, bytes, bytes]]]:
        """Runs of a text, a list for each block."""
        for _, size, listed, raw in self.encode_all([text]):
            yield [(size, bytes(listed), bytes(raw))]


def encode_ids(df: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """``df`` plus ``ids`` (array of int), the tokens of its whole text. A null text counts as empty; a column
    of ``df`` named ``ids`` is replaced. Rows are encoded where they are read, without a shuffle."""
    kept = [c for c in df.columns if c != "ids"]
    packed = df.select(F.struct(*kept).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = worker_cache(f"codec {vocabulary_path}", lambda: Codec(vocabulary_path))
        ids = [[int(i) for runs in codec.encode(t) for run in runs for i in run[1].split(b",")[:-1]] for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["row", "ids"])

    return map_batches(packed, work, f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>").select("row.*", "ids")


def decode_ids(df: DataFrame, vocabulary_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` plus ``decoded``, the text of its ids; null ids give the empty text, an unknown id is an error."""
    kept = [c for c in df.columns if c != "decoded"]
    packed = df.select(F.struct(*kept).alias("row"), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = worker_cache(f"vocabulary {vocabulary_path}", lambda: Vocabulary(vocabulary_path))
        texts = []
        for ids in batch.column(1).to_pylist():
            decoder = Decoder(vocabulary)
            texts.append(decoder.feed(ids) + decoder.close())
        return pa.record_batch([batch.column(0), pa.array(texts, "string")], ["row", "decoded"])

    return map_batches(packed, work, f"row {packed.schema['row'].dataType.simpleString()}, decoded string").select("row.*", "decoded")


def encode_decode_digests(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256`` (decoded text in
    UTF-8), streamed block by block: neither the ids nor the decoded text of a document is held whole.

    A null or empty text has no tokens and the digests of the empty string. Each row, repeated ones too, gives
    one row; an empty table gives none; other columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = worker_cache(f"codec {vocabulary_path}", lambda: Codec(vocabulary_path))
        counts, id_digests, text_digests = [], [], []
        texts = batch.column(1).to_pylist()
        runs = codec.encode_all(texts)
        run = next(runs, None)
        for row in range(len(texts)):
            n, digest, decoded = 0, hashlib.sha256(), hashlib.sha256()
            state = codecs.getincrementaldecoder("utf-8")("replace")
            comma = b""
            while run is not None and run[0] == row:
                _, size, listed, raw = run
                if listed:
                    n += size
                    digest.update(comma)
                    digest.update(listed[:-1])
                    comma = b","
                    decoded.update(state.decode(raw).encode())
                run = next(runs, None)
            decoded.update(state.decode(b"", True).encode())
            counts.append(n)
            id_digests.append(digest.hexdigest())
            text_digests.append(decoded.hexdigest())
        return pa.record_batch([batch.column(0), pa.array(counts, "int64"), pa.array(id_digests), pa.array(text_digests)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
