"""Token ids of whole texts with a word-level BPE vocabulary, word by word from a bounded cache."""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np

#: Words and word parts that a task's cache holds at most.
CACHED = 100_000
_LETTERS = "a-zß-öø-ÿ"
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_PLAIN = re.compile(f"[!-~¡£§«°»¿{_LETTERS}]+")


class _Unusual(Exception):
    pass


class WordBpe:
    """Callable from a text to its ids as little-endian 32-bit unsigned integers.

    The vocabulary's rules never let a token cross white space, so a text's ids are those of its
    words in turn, and words repeat. Words of ASCII and Latin-1 letters and signs go through the
    cache; a text with any other character is given to the tokenizer whole, which also
    settles Unicode normalisation, special tokens and rare white space.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.merge = _merger(json.load(file)["model"]["vocab"])
        self.parts: dict[str, bytes] = {}
        self.words = _Words(self)

    @cached_property
    def whole(self):
        """The tokenizer itself; most tasks meet no text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> WordBpe:
        return WordBpe(path)

    def __call__(self, text: str) -> bytes:
        if not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
            try:
                return b"".join(map(self.words.__getitem__, text.lower().split()))
            except _Unusual:
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        known = self.parts.get(word)
        if known:
            return known
        if not word.isalpha():
            return b"".join([self.parts.get(p) or self.part(p) for p in _PART.findall(word)])
        return self.part(word)

    def part(self, part: str) -> bytes:
        if not _PLAIN.fullmatch(part) or "<|" in part:
            raise _Unusual
        out = array("I", self.merge(part.encode() + _END)).tobytes()
        if len(self.parts) < CACHED:
            self.parts[part] = out
        return out


class _Words(dict):
    def __init__(self, owner: WordBpe):
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        out = self.owner.word(word)
        if len(self) < CACHED:
            self[word] = out
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: Stands for the end of a word among the bytes of a part; no UTF-8 text has it.
_END = b"\xff"


def _merger(vocabulary: dict[str, int]):
    """A function from a part's bytes and _END to its ids, by merges in the order of ids."""
    import tiktoken

    byte = {letter: b for b, letter in enumerate(byte_letters())}
    ranks = {_END: max(vocabulary.values()) + 1}
    for token, i in vocabulary.items():
        if token.startswith("<|"):
            continue
        ends = len(token) > 4 and token.endswith("</w>")
        spelled = token[:-4] if ends else token
        if all(x in byte for x in spelled) and (ends or byte.get(spelled) != _END[0]):
            ranks[bytes(byte[x] for x in spelled) + _END * ends] = i
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
