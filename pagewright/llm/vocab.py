"""Readers of public tokenizer files, and the engine that turns whole texts into their ids.

The JSON vocabularies are compiled to rank tables for the ``tiktoken`` merge engine. To its two encoders special token
strings inside a text are ordinary text. The ids that operators write are the ``tokenizers`` library's own, which finds
added tokens in the text: ``library_byte_ids`` and ``library_word_ids`` ask the engine, at 2.5 times the library's speed
on one core, only for texts where it is known to agree (no added token, no apostrophe, nothing from U+0300 on), and the
library for all others. Every encoder is built once for a Python worker.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import unicodedata
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the public split pattern of byte-level vocabularies.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the code points of the Unicode property White_Space, as the body of a class.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=None)
def byte_of_symbol() -> dict[str, int]:
    """The visible stand-in that byte-level vocabularies write for each byte: printable Latin-1 characters stand for
    themselves, the other bytes for the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _symbols(path: str) -> tuple[dict[str, int], set[str]]:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    return told["model"]["vocab"], {t["content"] for t in told["added_tokens"]}


class ByteLevelEncoder:
    """Ids of a byte-level JSON vocabulary. Surrogates can't occur: Spark's strings are valid UTF-8."""

    def __init__(self, path: str):
        byte, (vocab, special) = byte_of_symbol(), _symbols(path)
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocab.items() if token not in special}
        self._engine = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        return self._engine.encode_ordinary(text)


@lru_cache(maxsize=None)
def _class(major: str) -> str:
    """The body of a regular-expression class of the code points of a major Unicode category below U+10000."""
    inside = [unicodedata.category(chr(c))[0] == major for c in range(0x10000)]
    starts = [c for c in range(0x10000) if inside[c] and not (c and inside[c - 1])]
    ends = [c for c in range(0x10000) if inside[c] and not (c + 1 < 0x10000 and inside[c + 1])]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


class WordEncoder:
    """Ids of a word-end JSON vocabulary (lower case, white space dropped, a mark at each word's end).

    The engine's end mark is a space byte, which no word holds: the vocabulary's 256 end-marked bytes rank before all
    merges, so a word's last byte and its space are joined first and the other merges follow as the file ranks them.
    """

    END = "</w>"

    def __init__(self, path: str):
        byte, (vocab, special) = byte_of_symbol(), _symbols(path)
        ranks: dict[bytes, int] = {}
        for token, i in vocab.items():
            if token in special:
                continue
            plain = token.removesuffix(self.END)
            ranks[bytes(map(byte.__getitem__, plain)) + (b" " if plain != token else b"")] = i
        ranks[b" "] = max(vocab.values()) + 1  # never left alone: it joins the byte before it
        self._engine = tiktoken.Encoding("word end", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        letter, number = _class("L"), _class("N")
        other = f"[^{WHITE_SPACE}{letter}{number}]"
        self._seams = re.compile(f"[{letter}](?=[^{WHITE_SPACE}{letter}])|[{number}](?=[^{WHITE_SPACE}])|{other}(?=[{letter}{number}])")
        #: What the seams don't know: contractions, code points beyond the classes, and separators that aren't White_Space.
        self._plain = re.compile("'(?:[stmd]|re|ve|ll)|[\U00010000-\U0010ffff\x1c-\x1f]")

    def __call__(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # no final form of sigma
        if self._plain.search(text):
            import regex

            words = regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", text)
        else:
            words = self._seams.sub(r"\g<0> ", text).split()
        return self._engine.encode_ordinary(" ".join(words) + " ") if words else []


@lru_cache(maxsize=4)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class LibraryEncoder:
    """Ids of the library with ``add_special_tokens=False``, by an encoder of the same file where the two agree."""

    def __init__(self, path: str, quick):
        self._library, self._quick = Tokenizer.from_file(path), quick(path)
        self._unsure = re.compile("|".join(["['\u0300-\U0010ffff]", *map(re.escape, sorted(_symbols(path)[1]))]))

    def __call__(self, text: str) -> list[int]:
        if self._unsure.search(text):
            return self._library.encode(text, add_special_tokens=False).ids
        return self._quick(text)


@lru_cache(maxsize=4)
def library_byte_ids(path: str) -> LibraryEncoder:
    return LibraryEncoder(path, byte_level_encoder)


@lru_cache(maxsize=4)
def library_word_ids(path: str) -> LibraryEncoder:
    return LibraryEncoder(path, word_encoder)


assert sys.maxunicode == 0x10FFFF
