"""Reading byte-level vocabularies and cutting texts as their pre-tokenizer does."""

from __future__ import annotations

import json

import regex

#: Unicode White_Space, which the pattern below calls white space. Fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: The pattern that cuts a text before byte pairs are merged. Fixed value.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: A space between two white-space characters: there a cut before the space is not a cut of the pattern.
_UNSAFE = regex.compile(rf"[{WHITE}] (?:[{WHITE}]|\Z)")
BLOCK = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabulary files: a printable Latin-1 character stands for
    itself, the others, in order, for the characters from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens as bytes, merges as ``(left id, right id) -> (rank, merged id)``, special tokens by content."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        if data["normalizer"] is not None or data["pre_tokenizer"]["type"] != "ByteLevel" or data["model"]["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        plain = {name: i for name, i in data["model"]["vocab"].items() if name not in special}
        self.tokens = {bytes(letters[c] for c in name): i for name, i in plain.items()}
        self.special = special
        self.bytes_of = {i: b for b, i in self.tokens.items()} | {i: s.encode() for s, i in special.items()}
        self.symbol = [self.tokens[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[plain[left], plain[right]] = rank, plain[left + right]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.cut = regex.compile(PATTERN).findall

    def segments(self, text: str):
        """``(is_special, segment)`` in order. A special token's string inside a text is that token."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield False, text
            return
        for i, part in enumerate(self.split_special.split(text)):
            if part:
                yield i % 2 == 1, part

    def blocks(self, segment: str):
        """A segment in blocks of about ``BLOCK`` characters, cut only before a space that both a non-space
        precedes and follows, where the pattern always cuts. A stretch without such a place stays whole."""
        begin, size = 0, len(segment)
        while size - begin > BLOCK:
            at = begin + BLOCK
            while True:
                at = segment.find(" ", at)
                if at < 0 or at + 1 >= size:
                    at = size
                    break
                if not segment[at - 1].isspace() and not segment[at + 1].isspace():
                    break
                at += 1
            yield segment[begin:at]
            begin = at
        if begin < size:
            yield segment[begin:]

    def in_chunks(self, block: str) -> bool:
        """Whether the cuts before each space are cuts of the pattern."""
        return not _UNSAFE.search(block)

    def chunks(self, block: str) -> tuple[str, list[str]] | None:
        """``(first, rest)``: the block cut before each space, the space taken off; None where such cuts
        are not cuts of the pattern. Chunks recur more often than texts, so their results are worth keeping."""
        if not self.in_chunks(block):
            return None
        first, *rest = block.split(" ")
        return first, rest
