"""Burrows-Wheeler transforms of sets of strings, and their merge by iterative interleave refinement (numpy, one task).

A set's suffixes (one empty suffix for each string) are ordered by (text, number of the string); the transform is the
byte before each. Merging keeps each shard's order and refines an interleave of the shards: ``Z`` says from which shard
each place's suffix comes. Given the interleave by the first h bytes, reading the shards' transforms along it and sorting
stably by the bytes read gives the interleave by h + 1 bytes, because a byte's suffixes follow the order of their tails.
No suffix is compared or sorted again. A step reads two bytes at once where their pairs fit 16 bits, so it goes from h to
h + 2. A place where blocks part at a step has a common prefix of less than the step's depth with the place before, so
the blocks that are left after ``depth`` bytes are the intervals of suffixes that share ``depth`` bytes.
"""

from __future__ import annotations

import numpy as np


def _concatenated(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (byte + 1; 0 ends each string), the string of each place, and where each string starts."""
    size = np.array([len(s) + 1 for s in strings], np.int64)
    start = np.cumsum(size) - size
    text = np.zeros(int(size.sum()), np.int64)
    body = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    text[:] = body
    text[start + size - 1] = 0
    return text, np.repeat(np.arange(len(strings)), size), start


def suffix_order(text: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places in the order of (suffix up to its string's end, string): prefix doubling from seven symbols on."""
    n = len(text)
    place = np.arange(n)
    left = np.flatnonzero(text == 0)
    until_end = left[np.searchsorted(left, place)] - place
    rank, width = np.zeros(n, np.int64), 7
    for i in range(width):
        rank = rank * 257 + np.where(i <= until_end, text[np.minimum(place + i, n - 1)], 0)
    longest = int(until_end.max()) + 1 if n else 0
    while True:
        order = np.argsort(rank, kind="stable")
        ranked = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if width >= longest:
            break
        after = np.where(width <= until_end, dense[np.minimum(place + width, n - 1)] + 1, 0)
        rank, width = dense * (n + 1) + after, 2 * width
    return np.lexsort((owner, dense))


class Shard:
    """A set of strings: its suffixes' places in order, and its transform (0 before a string's first byte)."""

    def __init__(self, strings: list[bytes]):
        self.text, self.owner, start = _concatenated(strings)
        self.order = suffix_order(self.text, self.owner)
        at = self.order - start[self.owner[self.order]]
        self.one = np.where(at > 0, self.text[self.order - 1], 0)
        self.two = np.where(at > 1, self.text[self.order - 2], 0)
        self.at = at  # of each suffix in its string
        self.last = self.text[start + np.diff(np.append(start, len(self.text))) - 2]  # of each string
        self.offset = np.arange(len(self.text)) - start[self.owner]
        self.strings = len(strings)


def _codes(shards: list[Shard], width: int, used: np.ndarray) -> list[np.ndarray]:
    """What is read along the interleave: the ``width`` bytes before each suffix as one number. The suffixes that have
    fewer before them stand for those without so many bytes of their own, which nothing leads to: the empty one and, for
    width 2, the last byte alone."""
    out = []
    for s in shards:
        one = np.searchsorted(used, s.one)
        if width == 1:
            out.append(one)
            continue
        code = np.searchsorted(used, s.two) * len(used) + one
        second = s.at == 1
        code[second] = np.searchsorted(used, s.last[s.owner[s.order[second]]]) * len(used)
        code[s.at == 0] = 0
        out.append(code)
    return out


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In merged order by ``depth`` bytes: each suffix's shard, its rank in the shard, and whether it shares ``depth`` bytes
    with the place before. Strings must not be empty."""
    sizes = [len(s.order) for s in shards]
    used = np.unique(np.concatenate([s.text for s in shards]))  # 0 first
    pairs = len(used) <= 256
    z = np.repeat(np.arange(len(shards)), sizes).astype(np.uint8)
    block = np.zeros(len(z), np.int32)
    parts = np.empty(len(z), bool)
    done = 0
    for width in (2, 1) if pairs else (1,):
        codes = [c.astype(np.uint16) for c in _codes(shards, width, used)]
        counts = np.bincount(np.concatenate(codes))
        starts = (np.cumsum(counts) - counts)[counts > 0]  # of each code's suffixes: a step never moves them
        # places of the suffixes that nothing leads to, which are all different; their shards, in order, code by code
        lone = [c[c % len(used) == 0] if width == 2 else c[c == 0] for c in codes]
        keys = np.concatenate(lone)
        order = np.argsort(keys, kind="stable")
        fixed = np.repeat(np.arange(len(shards)), [len(x) for x in lone])[order].astype(np.uint8)
        keys = keys[order].astype(np.int64)
        where = (np.cumsum(counts) - counts)[keys] + np.arange(len(keys)) - np.searchsorted(keys, keys)
        read = np.empty(len(z), np.uint16)
        while done + width <= depth:
            for i, c in enumerate(codes):  # the shards' transforms, read along the interleave
                read[z == i] = c
            by_code = np.argsort(read, kind="stable")
            z, old = z[by_code], block[by_code]
            np.not_equal(old[1:], old[:-1], out=parts[1:])
            z[where], parts[where], parts[starts] = fixed, True, True
            np.cumsum(parts, dtype=np.int32, out=block)
            done += width
            if int(block[-1]) == len(z):
                done = depth
    rank = np.empty(len(z), np.int64)
    for i, n in enumerate(sizes):
        rank[z == i] = np.arange(n)
    return z, rank, ~parts


def repeated(strings: list[bytes], depth: int, shards: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """The intervals of places that share ``depth`` bytes: for each, the strings and the offsets in them."""
    count = min(shards, len(strings))
    parts = [list(range(i, len(strings), count)) for i in range(count)]
    built = [Shard([strings[i] for i in p]) for p in parts]
    z, rank, shares = merged(built, depth)
    edges = np.flatnonzero(~shares)
    sizes = np.diff(np.concatenate((edges, [len(z)])))
    keep = sizes > 1
    inside = np.repeat(keep, sizes)
    interval = np.repeat(np.cumsum(keep) - 1, sizes)[inside]
    string, offset = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    for i, s in enumerate(built):
        own = z == i
        at = s.order[rank[own]]
        string[own], offset[own] = np.asarray(parts[i])[s.owner[at]], s.offset[at]
    string, offset = string[inside], offset[inside]
    cuts = np.searchsorted(interval, np.arange(1, int(keep.sum())))
    return list(zip(np.split(string, cuts), np.split(offset, cuts), strict=True)) if keep.any() else []
