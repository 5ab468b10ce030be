"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming UTF-8 decoder.

The method. The encoding of each prefix of a piece ends in one token: the one suffix that is a token and is compatible
with the token before it (encoding the two together gives the two). So a piece is read byte by byte; what may still
change is a short tail, the bytes since the last token emitted. A step adds a byte, finds the new prefix's last token,
and emits the tokens on which all live continuations agree: a continuation is live while the bytes
from its start are the beginning of some token, so lookahead is bounded by the longest token. States and steps are
worked out when first met and kept, up to ``MAX_STATES``; then the table is dropped and grows anew, as regular-expression
engines do. Paths of short pieces are kept as well, in a table with a bound of its own. Decoding runs an incremental UTF-8
state machine over the tokens as they come, whose steps by whole tokens are worked out lazily too (``Decoder``).

Defined results. Null text: as an empty one (no ids). Very long texts and words: time in proportion to their length. Null or repeated ids and repeated rows: a row each. An empty
table: no rows. Extra columns don't take part. Special-token strings are ordinary text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import blocks, table
from pagewright.llm.vocab import BYTE_LEVEL_SPLIT, WHITE_SPACE, _class, read_ranks

MAX_STATES, MAX_PATHS, MAX_ARCS, LONGEST_PATH = 200_000, 300_000, 300_000, 48
_NEVER = 1 << 60


@lru_cache(maxsize=None)
def splitter():
    """The public split pattern; texts within the basic plane take the standard library's engine, which is quicker."""
    import regex

    letter, number, space = _class("L"), _class("N"), WHITE_SPACE
    basic = re.compile(f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
    wide, beyond = regex.compile(BYTE_LEVEL_SPLIT), re.compile("[\U00010000-\U0010ffff]")
    return lambda text: (wide if beyond.search(text) else basic).findall(text)


class Transducer:
    """``encode(piece)`` for pieces of bytes, by ranks (token -> rank; each single byte must be a token).

    A state is (tail, lengths): the bytes since the last emitted token, and the length of the last token of each prefix
    of them that a live continuation goes through (0 for the others). A step depends on the last emitted token only
    through one guard: whether the token that would start right after it is compatible with it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self._spine: tuple[dict, dict] = ({}, {})
        self._reset()

    def _reset(self) -> None:
        self._fit: dict[tuple[bytes, bytes], bool] = {}
        self._number: dict[tuple[bytes, tuple[int, ...]], int] = {}
        self._states: list[tuple[bytes, tuple[int, ...]]] = []
        self._steps: list[dict[int, list]] = []
        self._ends: list[tuple[int, ...] | None] = []
        self._state(b"", ())

    def _state(self, tail: bytes, lengths: tuple[int, ...]) -> int:
        number = self._number.setdefault((tail, lengths), len(self._states))
        if number == len(self._states):
            self._states.append((tail, lengths))
            self._steps.append({})
            self._ends.append(None)
        return number

    def _edge(self, token: bytes, right: bool) -> list[tuple[int, bytes]]:
        """The parts that hold a token's last (first) byte while it is merged: (rank of the merge into it, part)."""
        kept = self._spine[right]
        if token not in kept:
            parts = [token[i : i + 1] for i in range(len(token))]
            edge = [(-1, parts[-right])]
            while len(parts) > 1:
                pairs = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
                least = min(pairs)
                if least == _NEVER:
                    break
                i = pairs.index(least)  # the pair of least rank first, the left one of equals
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if parts[-right] != edge[-1][1]:
                    edge.append((max(least, edge[-1][0]), parts[-right]))
            kept[token] = edge
        return kept[token]

    def _compatible(self, a: bytes, b: bytes) -> bool:
        """Whether merging the bytes of both never joins parts across the seam: neither side's next merge may come after
        the seam's. Of equal ranks the left one is first."""
        left, right, i, j = self._edge(a, True), self._edge(b, False), 0, 0
        while True:
            next_left = left[i + 1][0] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1][0] if j + 1 < len(right) else _NEVER
            seam = self.ranks.get(left[i][1] + right[j][1], _NEVER)
            if seam < next_left and seam <= next_right and seam != _NEVER:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _step(self, tail: bytes, lengths: tuple[int, ...], byte: int, after_last: bool) -> tuple[int, tuple[int, ...], bytes]:
        """The next state, what is emitted, and its last token. ``after_last``: the guard, whether a token may be the whole tail."""
        tail += bytes((byte,))
        n = len(tail)
        for start in range(not after_last, n):
            new = tail[start:]
            if new in self.ranks and (not start or self._compatible(tail[start - lengths[start - 1] : start], new)):
                break
        lengths += (n - start,)
        live = [p for p in range(n) if tail[p:] in self.prefixes] + [n]
        chains = []
        for p in live:
            stops = []
            while p > 0:
                stops.append(p)
                p -= lengths[p - 1]
            chains.append(stops[::-1])
        agreed = 0
        for stops in zip(*chains):
            if any(s != stops[0] for s in stops):
                break
            agreed = stops[0]
        emitted = [tail[s - lengths[s - 1] : s] for s in chains[-1] if s <= agreed]
        used = {s for stops in chains for s in stops}
        rest = tuple(lengths[s - 1] if s in used else 0 for s in range(agreed + 1, n + 1))
        return self._state(tail[agreed:], rest), tuple(self.ranks[t] for t in emitted), emitted[-1] if emitted else b""

    def _end(self, state: int) -> tuple[int, ...]:
        tail, lengths = self._states[state]
        out, p = [], len(tail)
        while p > 0:
            out.append(self.ranks[tail[p - lengths[p - 1] : p]])
            p -= lengths[p - 1]
        self._ends[state] = tuple(out[::-1])
        return self._ends[state]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(self._states) > MAX_STATES or len(self._fit) > 4 * MAX_STATES:
            self._reset()
        state, out, last, steps, fit = 0, [], b"", self._steps, self._fit
        for byte in piece:
            arc = steps[state].get(byte)
            if arc is None:
                tail, _ = self._states[state]
                whole_tail = tail + bytes((byte,))
                arc = steps[state][byte] = [whole_tail if tail and whole_tail in self.ranks or not tail else None, None, None]
            token, taken, refused = arc
            if token is not None and last:
                agrees = fit.get((last, token))
                if agrees is None:
                    agrees = fit[last, token] = self._compatible(last, token)
            else:
                agrees = True
            found = taken if agrees else refused
            if found is None:
                found = arc[1 if agrees else 2] = self._step(*self._states[state], byte, agrees)
                if len(self._states) > 2 * MAX_STATES:  # a very long piece goes on with a new table
                    at = self._states[found[0]]
                    self._reset()
                    found, steps, fit = (self._state(*at), *found[1:]), self._steps, self._fit
            state, emitted, final = found
            if emitted:
                out += emitted
                last = final
        return (*out, *(self._ends[state] or self._end(state)))


class Encoder:
    """Whole texts: ``paths(text)`` are its pieces' (ids, decimal ids)."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.transducer, self.split = Transducer(ranks), splitter()
        self.token = {i: t for t, i in ranks.items()}
        self.decoder = Decoder(self.token)
        self._paths: dict[str, tuple[tuple[int, ...], str]] = {}

    def paths(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        kept, out = self._paths, []
        if len(kept) > MAX_PATHS:
            kept.clear()
        for piece in self.split(text):
            found = kept.get(piece)
            if found is None:
                ids = self.transducer.encode(piece.encode())
                found = ids, ",".join(map(str, ids))
                if len(piece) <= LONGEST_PATH:
                    kept[piece] = found
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(p[0] for p in self.paths(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Of each lead byte, how many bytes follow and the range of the first of them (well-formed UTF-8).
_LEADS = {**{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, **{b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)}, 0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), **{b: (3, 0x80, 0xBF) for b in (0xF1, 0xF2, 0xF3)}, 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}


class Utf8Stream:
    """Incremental decoding: ``feed`` returns the characters that are complete, ``close`` what an unfinished one becomes.

    The state is how many bytes are still due, the range of the next, and the bytes of the unfinished character, three at
    most. A byte outside the range ends the character as one U+FFFD and is read anew.
    """

    def __init__(self, due: int = 0, low: int = 0, high: int = 0, held: bytes = b""):
        self.due, self.low, self.high, self.held = due, low, high, bytearray(held)

    def state(self) -> tuple[int, int, int, bytes]:
        return (self.due, self.low, self.high, bytes(self.held)) if self.due else (0, 0, 0, b"")

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.due:
                if self.low <= byte <= self.high:
                    self.held.append(byte)
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append(self.close())
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in _LEADS:
                self.due, self.low, self.high = _LEADS[byte]
                self.held.append(byte)
            else:
                out.append("\ufffd")
        return "".join(out)

    def close(self) -> str:
        unfinished, self.due = bool(self.due), 0
        self.held.clear()
        return "\ufffd" if unfinished else ""


class Decoder:
    """The UTF-8 machine over tokens: from each of its states an arc for each token, with the characters that the token's
    bytes complete. Arcs are worked out byte by byte when first met, and kept up to ``MAX_ARCS``. So a stream of tokens is
    decoded as they come; what is held between two tokens is one unfinished character."""

    def __init__(self, token: Mapping[int, bytes]):
        self.token = token
        self.rows: dict[tuple, dict] = {}
        self.arcs = 0

    def _row(self, state: tuple) -> dict:
        """The arcs of a state, which is kept among them."""
        return self.rows.setdefault(state, {_STATE: state})

    def _learn(self, row: dict, token: int) -> tuple[str, dict]:
        machine = Utf8Stream(*row[_STATE])
        text = machine.feed(self.token[token])
        if self.arcs >= MAX_ARCS:
            self.rows, self.arcs = {}, 0
        self.arcs += 1
        row[token] = arc = text, self._row(machine.state())
        return arc

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of a stream of tokens, a piece for each ``_PIECE`` of them and one for its end."""
        row, out = self._row(Utf8Stream().state()), []
        for i in ids:
            arc = row.get(i) or self._learn(row, i)
            out.append(arc[0])
            row = arc[1]
            if len(out) == _PIECE:
                yield "".join(out)
                out = []
        yield "".join(out) + Utf8Stream(*row[_STATE]).close()


#: Under what a state lies among its arcs: no token's id.
_STATE = -1
#: Tokens of a piece of decoded text.
_PIECE = 4096


def decoded(data: bytes) -> str:
    """The text of bytes, by the machine alone."""
    stream = Utf8Stream()
    return stream.feed(data) + stream.close()


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text: the round trip's digests."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in blocks(batches, text_col):
            counts, ids_sha, text_sha = [], [], []
            for text in b.column(text_col).to_pylist():
                paths = e.paths(text or "")
                ids = list(chain.from_iterable([p[0] for p in paths]))
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([p[1] for p in paths]).encode()).hexdigest())
                text = hashlib.sha256()
                for piece in e.decoder.pieces(ids):
                    text.update(piece.encode())
                text_sha.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
