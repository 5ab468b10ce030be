"""Document scores by masked pseudo-likelihood: a bidirectional window network, trained in numpy, over corpus counts.

The method. Words (ASCII letters lower-cased) are hashed to ``BUCKETS`` ids. For a masked word, the network adds up
embeddings of the ``WINDOW`` words on its left and, from another table, of those on its right; from a tanh layer a
softmax gives the word's class (a bin of equal corpus frequency), and a Huffman tree of each class the word: at every node
on the way a logistic unit over the layer's first ``INNER`` numbers, whose bias starts at the counts of both sides, turns
left or right. So context decides among all ids, whose probabilities add up to one. That is the network's pseudo-likelihood
(``network_log_prob``), and the prior of the word; what the corpus holds between the same two neighbours elsewhere updates it:
``(c(left, word, right) + PRIOR * p) / (c(left, any, right) + PRIOR)``, both counts without the word itself. A document's score
is the sum of the log-probabilities of all its words, each predicted from both sides.

Training. Each partition starts from the same weights and goes once through all words of its documents, each masked
once, in random order within a block, with Adagrad; the partitions' networks are averaged by trained words, in a tree
whose tasks add up ``FAN_IN`` networks or so.

Counting. What is counted grows with the corpus: a task packs the words of a block, with their priors (to 1/2048 nat),
by ranges of the hash of their two neighbours; a range counts its pairs and words in numpy and returns a sum for each
document. The hash tells 2**32 neighbours of a range and 2**16 words between them apart.

Scale. Three passes over the texts (counts, training, packing); words are shuffled once, as 8 bytes each. A range holds
about ``RANGE_WORDS`` words. Two neighbours with more than a quarter of that are found by a sample and counted exactly
while training; their words are dealt by (neighbours, word), and a word that is as frequent between them is scored where
it is read. The driver and each task hold one network (about 4 MB) with its trees, ``BUCKETS`` counts and at most ``MAX_HOT`` such counts.

Defined results. Null, empty or blank text: no words, a sum of 0.0, null mean. Very long texts: a block of their own.
Null or repeated ids and repeated rows: a row each, alike for equal texts. An empty table: no rows. Extra columns don't
take part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import PrefixHash, blocks, flat, mixed, parts_for, shared_folder, table, words_of

BUCKETS, INPUTS, WINDOW, WIDTH, CLASSES, INNER, RATE, BATCH, FAN_IN = 1 << 16, 1 << 13, 2, 16, 64, 8, 0.15, 2048, 8
#: So many rows of the softmax at a time, which stay in a core's cache.
ROWS = 512
_SIZES = {"near": (2 * (INPUTS + 1), WIDTH), "bias": (WIDTH,), "out": (WIDTH, CLASSES), "shift": (CLASSES,), "turns": (BUCKETS, INNER), "odds": (BUCKETS,)}
#: Types that hold a row of ``near`` and a node: numbers of 16 bits are sorted in time that is linear in them.
_INPUT, _NODE = np.min_scalar_type(2 * (INPUTS + 1)), np.min_scalar_type(BUCKETS - 1)
#: Greatest size of a logit that goes to ``exp`` as it is.
_SAFE = 60.0
PRIOR, RANGE_WORDS, MAX_HOT, SAMPLE, STEPS = 1.0, 1 << 21, 1 << 18, 256, 2048


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, and the n + 1 places where the texts' words start."""
    data, at = flat(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, row = words_of(data, at)
    return PrefixHash(data)(start, end), np.searchsorted(row, np.arange(len(at)))


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The id of each word, and the n + 1 places where the texts' words start."""
    hashes, edges = word_hashes(column)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), edges


def neighbours(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A hash of the two words beside each word; a text's ends count as words of their own."""
    left, right = np.empty_like(hashes), np.empty_like(hashes)
    left[1:], right[:-1] = hashes[:-1], hashes[1:]
    some = np.diff(edges) > 0
    left[edges[:-1][some]], right[edges[1:][some] - 1] = 1, 2
    with np.errstate(over="ignore"):
        return mixed(mixed(left) * np.uint64(0x9E3779B97F4A7C15) + right)


def contexts(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of ``near`` for the words around each word: left ones, then right ones (in the second half of the table);
    ``INPUTS`` beyond the text."""
    sizes = np.diff(edges)
    place = np.arange(len(ids)) + np.repeat(np.arange(1, len(edges)) * WINDOW, sizes)  # with a gap before each text
    spaced = np.full(len(ids) + len(edges) * WINDOW, INPUTS, _INPUT)
    spaced[place] = ids % INPUTS
    out = np.empty((len(ids), 2 * WINDOW), _INPUT)
    for k, step in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        out[:, k] = spaced.take(place + step)
    out[:, WINDOW:] += INPUTS + 1
    return out


@dataclass(frozen=True)
class Vocabulary:
    """Each id's class, and its way through the class's tree: ``turn`` (twice the node, and 1 if it is to the right) from
    ``start[id]`` to ``start[id + 1]``."""

    classes: np.ndarray
    start: np.ndarray
    turn: np.ndarray
    odds: np.ndarray

    def ways(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, node, right) of all turns of the ids, row by row."""
        n = self.start[ids + 1] - self.start[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(np.arange(len(ids)), n), self.turn[at] >> 1, (self.turn[at] & 1).astype(np.float32)

    def levels(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
        """(order, levels, node, right) of all turns of the ids: the rows in ``order``, longest way first, so that the k-th
        turns, which lie from ``levels[k][0]`` to ``levels[k][1]``, are those of its first rows."""
        first = self.start.take(ids)
        n = self.start.take(ids + 1) - first
        order = np.argsort((n.max(initial=0) - n).astype(_NODE), kind="stable")
        first = first.take(order)
        sizes = len(ids) - np.cumsum(np.bincount(n))[:-1]  # rows with more than k turns
        ends = np.cumsum(sizes)
        levels = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
        at = np.concatenate([first[: hi - lo] for lo, hi in levels] or [first[:0]])
        at += np.repeat(np.arange(len(levels)), sizes)
        turn = self.turn.take(at)
        return order, levels, turn >> 1, (turn & 1).astype(np.float32)


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """Classes of about equal mass, in order of frequency, and a Huffman tree of each by the ids' counts plus one."""
    order = np.argsort(-counts, kind="stable")
    smooth = counts + 1
    middle = np.cumsum(smooth[order]) - smooth[order] / 2
    of = np.empty(len(counts), np.int64)
    of[order] = np.minimum(CLASSES - 1, (middle * CLASSES / smooth.sum()).astype(np.int64))
    odds = np.zeros(len(counts), np.float32)
    above = np.full(2 * len(counts), -1, np.int64)  # ids, then inner nodes; of each the node above it
    side = np.zeros(2 * len(counts), bool)
    inner = 0
    for members in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        heap = [(int(smooth[i]), int(i)) for i in members[::-1]]  # ascending, so it is a heap
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            here = len(counts) + inner
            above[x] = above[y] = here
            side[y] = True
            odds[inner] = np.log(b / a)
            heapq.heappush(heap, (a + b, here))
            inner += 1
    ids = now = np.arange(len(counts))
    steps = []
    while (some := above[now] >= 0).any():  # a level of all trees at a time
        ids, now = ids[some], now[some]
        steps.append((ids, above[now] - len(counts), side[now]))
        now = above[now]
    ids, node, right = (np.concatenate([x[k] for x in steps] or [np.zeros(0, np.int64)]) for k in range(3))
    sorted_ = np.argsort(ids, kind="stable")
    return Vocabulary(of, np.searchsorted(ids[sorted_], np.arange(len(counts) + 1)), (node[sorted_] << 1 | right[sorted_]).astype(np.int32), odds)


def _taken(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of a table, each moved as one item: numbers that are moved one by one take twice the time or more."""
    if table.ndim == 1:
        return table.take(rows)
    return table.view(f"V{table.itemsize * table.shape[1]}")[:, 0].take(rows).view(table.dtype).reshape(len(rows), table.shape[1])


def _repeated(h: np.ndarray, order: np.ndarray, levels: list[tuple[int, int]]) -> np.ndarray:
    """What a tree reads of the hidden layer, for each turn of ``Vocabulary.levels``."""
    rows = _taken(np.ascontiguousarray(h[:, :INNER]), order)
    return np.concatenate([rows[: hi - lo] for lo, hi in levels] or [rows[:0]])


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Replaces rows of a table, as ``_taken`` reads them."""
    if table.ndim == 1:
        table[rows] = values
    else:
        item = f"V{table.itemsize * table.shape[1]}"
        table.view(item)[:, 0].put(rows, values.view(item)[:, 0])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The scalar product of each row of a with that of b."""
    return (a * b) @ np.ones(a.shape[1], a.dtype)


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, key): the places of the keys, those of a key together, where each key's start, and the keys; first
    come the keys that have one place, as most have."""
    order = np.argsort(keys, kind="stable")
    keys = keys.take(order)
    head = np.ones(len(keys) + 1, bool)
    np.not_equal(keys[1:], keys[:-1], out=head[1:-1])
    alone = head[:-1] & head[1:]
    shared = np.flatnonzero(~alone)
    alone = np.flatnonzero(alone)
    more = np.flatnonzero(head.take(shared))
    return order.take(np.concatenate((alone, shared))), np.concatenate((np.arange(len(alone)), more + len(alone))), keys.take(np.concatenate((alone, shared.take(more))))


def _row_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each key's rows, in the order of ``_by_key``, in the place of the first rows."""
    shared = np.flatnonzero(np.diff(starts, append=len(rows)) > 1)
    if len(shared):  # as pairs of numbers: the same sums, four times as quick
        alone = shared[0]
        rows[alone : len(starts)] = np.add.reduceat(rows[alone:].view(np.complex64), starts[alone:] - alone, axis=0).view(np.float32)
    return rows[: len(starts)]


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, odds: np.ndarray | None = None) -> Network:
        """With the same weights each time, and biases of the trees' turns."""
        draw = np.random.default_rng(7)
        weights = {k: (draw.normal(0, 0.1, s) if k in ("near", "out") else np.zeros(s)).astype(np.float32) for k, s in _SIZES.items()}
        if odds is not None:
            weights["odds"] = odds.copy()
        return cls(weights)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        near = self.weights["near"]
        total = _taken(near, around[:, 0])
        for k in range(1, 2 * WINDOW):
            total += _taken(near, around[:, k])
        total += self.weights["bias"]
        total *= 2
        with np.errstate(over="ignore"):
            np.exp(total, out=total)
        total += 1
        np.divide(-2, total, out=total)
        total += 1  # tanh, in half the time of numpy's own
        return total

    def _is_settled(self) -> bool:
        """Whether the classes' logits are within what ``exp`` can take, whatever the hidden layer, which is within 1."""
        return bool((np.abs(self.weights["out"]).sum(0) + np.abs(self.weights["shift"])).max() <= _SAFE)

    def log_classes(self, around: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Of the classes that have ids; the others have no share."""
        z = self.hidden(around) @ self.weights["out"] + self.weights["shift"]
        z[:, ~used] = -np.inf
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return z

    def log_turns(self, h: np.ndarray, ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
        """The log-probability of each id within its class."""
        order, levels, node, right = vocab.levels(ids)
        z = _products(_repeated(h, order, levels), _taken(self.weights["turns"], node))
        z += self.weights["odds"].take(node)
        z *= 1 - 2 * right
        told = np.abs(z)
        np.exp(np.negative(told, out=told), out=told)
        told += 1
        np.log(told, out=told)
        told += np.maximum(z, 0, out=z)
        sums, out = np.zeros(len(ids)), np.empty(len(ids))
        for lo, hi in levels:
            sums[: hi - lo] -= told[lo:hi]
        out[order] = sums
        return out

    def log_wanted(self, around: np.ndarray, ids: np.ndarray, vocab: Vocabulary, used: np.ndarray) -> np.ndarray:
        """The log-probability of the wanted id of each row; classes without ids have no share."""
        h = self.hidden(around)
        z = h @ self.weights["out"]
        z += self.weights["shift"]
        if not self._is_settled() and z.size and (z.max() > _SAFE or z.min() < -_SAFE):
            z -= z.max(1, keepdims=True)
        own = z.ravel().take(np.arange(0, z.size, CLASSES) + vocab.classes.take(ids))
        own -= np.log(np.exp(z, out=z) @ used.astype(np.float32))
        return own + self.log_turns(h, ids, vocab)

    def train(self, around: np.ndarray, ids: np.ndarray, vocab: Vocabulary, seen: dict[str, np.ndarray]) -> None:
        """One Adagrad step; ``seen`` holds the sums of squares."""
        w, m = self.weights, len(ids)
        h = self.hidden(around)
        back, classes = np.empty((m, WIDTH), np.float32), vocab.classes.take(ids)
        outer = np.concatenate((h, np.ones((m, 1), np.float32)), axis=1)  # the last number reads the shift
        weights, grads = np.concatenate((w["out"], w["shift"][None])), np.zeros((WIDTH + 1, CLASSES), np.float32)
        settled = self._is_settled()
        for i in range(0, m, ROWS):
            part, of = outer[i : i + ROWS], classes[i : i + ROWS]
            g = part @ weights
            if not settled and (g.max() > _SAFE or g.min() < -_SAFE):
                g -= g.max(1, keepdims=True)
            total = np.exp(g, out=g) @ np.ones(CLASSES, np.float32)
            g.ravel()[np.arange(0, g.size, CLASSES) + of] -= total
            share = (1 / (total * np.float32(m)))[:, None]  # goes to the narrower factors
            np.matmul(g, w["out"].T, out=back[i : i + ROWS])
            back[i : i + ROWS] *= share
            grads += (part * share).T @ g
        order, levels, node, right = vocab.levels(ids)
        if levels:
            upper = np.ascontiguousarray(h[:, :INNER])
            turns = _taken(w["turns"], node)
            t = _products(_repeated(upper, order, levels), turns)
            t += w["odds"].take(node)
            with np.errstate(over="ignore"):
                np.exp(np.negative(t, out=t), out=t)
            t += 1
            np.divide(1, t, out=t)
            t -= right
            t *= np.float32(1 / m)
            turns *= np.repeat(t, INNER).reshape(-1, INNER)
            sums, own = np.zeros((m, INNER), np.float32), np.empty((m, INNER), np.float32)
            for lo, hi in levels:
                sums[: hi - lo] += turns[lo:hi]
            _put(own, order, sums)
            back[:, :INNER] += own
            readers, starts, nodes = _by_key(node.astype(_NODE))
            t = t.take(readers)
            part = _taken(upper, np.concatenate([order[: hi - lo] for lo, hi in levels]).take(readers))
            part *= np.repeat(t, INNER).reshape(-1, INNER)
            self._step("turns", nodes, _row_sums(part, starts), seen)
            self._step("odds", nodes, np.add.reduceat(t, starts), seen)
        back *= 1 - h * h
        for k, grad in (("out", grads[:-1]), ("shift", grads[-1]), ("bias", outer[:, -1] @ back)):
            seen[k] += grad * grad
            w[k] -= RATE * grad / np.sqrt(seen[k] + 1e-8)
        readers, starts, rows = _by_key(around.astype(_INPUT, copy=False).ravel())
        self._step("near", rows, _row_sums(_taken(back, readers // (2 * WINDOW)), starts), seen)

    def _step(self, k: str, used: np.ndarray, grad: np.ndarray, seen: dict[str, np.ndarray]) -> None:
        """An Adagrad step of the rows ``used``."""
        total = _taken(seen[k], used)
        total += grad * grad
        _put(seen[k], used, total)
        total += np.float32(1e-8)
        np.sqrt(total, out=total)
        np.divide(RATE * grad, total, out=total)
        weights = _taken(self.weights[k], used)
        weights -= total
        _put(self.weights[k], used, weights)

    def pack(self) -> bytes:
        return b"".join(self.weights[k].tobytes() for k in _SIZES)

    @classmethod
    def unpack(cls, data: bytes) -> Network:
        out, at = {}, 0
        for k, s in _SIZES.items():
            n = 4 * int(np.prod(s))
            out[k] = np.frombuffer(data[at : at + n], np.float32).reshape(s).copy()
            at += n
        return cls(out)


def _counted(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words of all documents have each id; the neighbours, and the (neighbours, word), that a sample of the
    words finds often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, draw = np.zeros(BUCKETS, np.int64), np.random.default_rng(TaskContext.get().partitionId())
        for b in blocks(batches, text_col):
            hashes, edges = word_hashes(b.column(text_col))
            total += np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            drawn = np.flatnonzero(draw.integers(0, SAMPLE, len(hashes)) == 0)
            if len(drawn):
                around = neighbours(hashes, edges)[drawn]
                for kind, keys in ((1, around), (2, pair(around, hashes[drawn]))):
                    key, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["kind", "key", "n"])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(used), np.int32)), pa.array(used), pa.array(total[used])], ["kind", "key", "n"])

    folder = shared_folder(docs.sparkSession)
    docs.select(text_col).mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).write.parquet(folder)
    found = docs.sparkSession.read.parquet(folder)
    out = np.zeros(BUCKETS, np.int64)
    ids = found.filter("kind = 0").toArrow()  # BUCKETS rows at most
    out[ids.column("key").to_numpy()] = ids.column("n").to_numpy()
    often = found.filter((F.col("kind") > 0) & (F.col("n") >= hot_limit(int(out.sum())) / SAMPLE / 2)).toArrow()  # 4 * MAX_HOT rows or so at most
    kind, key = often.column("kind").to_numpy(), often.column("key").to_numpy().view(np.uint64)
    return out, np.sort(key[kind == 1]), np.sort(key[kind == 2])


def hot_limit(words: int) -> float:
    """More words than so between two neighbours make them hot: these are dealt by the word, too."""
    return max(RANGE_WORDS / 4, words / MAX_HOT)


def pair(around: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(around * np.uint64(0x9E3779B97F4A7C15) + hashes)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many words of all documents have each id."""
    return _counted(docs, text_col)[0]


def _summed(models: DataFrame) -> tuple[Network, np.ndarray]:
    """One network, and the sums of the counts, from all rows (part, words, weights, counts), added up in a tree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, counts = 0, None, 0
        for b in batches:
            for n, data, c in zip(b.column("words").to_pylist(), b.column("weights"), b.column("counts"), strict=True):
                x = np.frombuffer(data.as_buffer(), np.float32) * np.float64(n)
                total, words = x if total is None else total + x, words + n
                counts = counts + np.frombuffer(c.as_buffer(), np.int64)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([words], pa.int64()), pa.array([(total / words).astype(np.float32).tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["part", "words", "weights", "counts"])

    spark, folder, turn = models.sparkSession, shared_folder(models.sparkSession), 0
    models.write.parquet(f"{folder}/{turn}")
    while (n := (kept := spark.read.parquet(f"{folder}/{turn}")).count()) > 1:
        turn += 1
        kept.repartition(-(-n // FAN_IN)).mapInArrow(add, "part int, words long, weights binary, counts binary").write.parquet(f"{folder}/{turn}")
    row = kept.first()
    return (Network.unpack(row["weights"]), np.frombuffer(row["counts"], np.int64)) if row else (Network.fresh(), np.zeros(0, np.int64))


def _averaged(models: DataFrame) -> Network:
    return _summed(models)[0]


def _tally(counts: np.ndarray, wanted: np.ndarray, keys: np.ndarray) -> None:
    """Adds how often each of the wanted (ascending) is among the keys."""
    if len(wanted) and len(keys):
        at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        counts += np.bincount(at[wanted[at] == keys], minlength=len(wanted))


def _looked_up(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The keys' counts, 0 for those that aren't known."""
    wanted, counts = known
    if not len(wanted) or not len(keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return np.where(wanted[at] == keys, counts[at], 0)


def _trained(docs: DataFrame, vocab: Vocabulary, text_col: str, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.fresh(vocab.odds)
        seen = {k: np.zeros(s, np.float32) for k, s in _SIZES.items()}
        words = 0
        counts = [np.zeros(len(x), np.int64) for x in often]
        draw = np.random.default_rng(11)
        for b in blocks(batches, text_col):
            hashes, edges = word_hashes(b.column(text_col))
            ids = (hashes % np.uint64(BUCKETS)).astype(np.int64)
            masked = draw.permutation(len(ids))  # each word is a target once
            around = contexts(ids, edges)
            for i in range(0, len(masked), BATCH):
                m = masked[i : i + BATCH]
                net.train(_taken(around, m), ids.take(m), vocab, seen)
            words += len(masked)
            if len(often[0]):
                beside = neighbours(hashes, edges)
                _tally(counts[0], often[0], beside)
                _tally(counts[1], often[1], pair(beside, hashes))
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([words], pa.int64()), pa.array([net.pack()], pa.binary()), pa.array([np.concatenate(counts).tobytes()], pa.binary())], ["part", "words", "weights", "counts"])

    return docs.select(text_col).mapInArrow(fit, "part int, words long, weights binary, counts binary")


def trained(docs: DataFrame, vocab: Vocabulary, text_col: str = "text") -> Network:
    return _averaged(_trained(docs, vocab, text_col, (np.zeros(0, np.uint64),) * 2))


def log_probabilities(net: Network, vocab: Vocabulary, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The network's, of each word, given its neighbours on both sides."""
    out = np.zeros(len(ids))
    around = contexts(ids, edges)
    used = np.bincount(vocab.classes, minlength=CLASSES) > 0
    for i in range(0, len(ids), BATCH):
        out[i : i + BATCH] = net.log_wanted(around[i : i + BATCH], ids[i : i + BATCH], vocab, used)
    return out


def updated(steps: np.ndarray, count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Log-probabilities from priors (in steps of 1/STEPS nat) and the counts, the word itself among them."""
    return np.log((count - 1 + PRIOR * np.exp(steps / -STEPS)) / (of - 1 + PRIOR))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_prob, mean_log_prob, network_log_prob) of every document; the last is the sum by the network alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    counts, *often = _counted(docs, text_col)
    words = int(counts.sum())
    vocab = vocabulary(counts)
    net, exact = _summed(_trained(docs, vocab, text_col, tuple(often)))
    limit = hot_limit(words)
    hot = []  # neighbours, and (neighbours, word), over the limit with their counts
    for keys, n in zip(often, np.split(exact, [len(often[0])]) if len(exact) else ([], []), strict=True):
        over = np.asarray(n) > limit if len(keys) else np.zeros(0, bool)
        hot.append((keys[over], np.asarray(n, np.int64)[over]) if len(keys) else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    ranges = max(parts_for(docs), -(-words // RANGE_WORDS))
    names = ["range", "packet", "n", "doc", "words", "around", "id"]
    packed_schema = f"range int, packet long, n long, doc binary, words binary, around binary, id {kind}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range that a block has words of, a row with their documents (place in the block) and (neighbours,
        word, prior); and a row for each document, with what is scored already."""
        part, packet = TaskContext.get().partitionId(), 0
        for batch in blocks(batches, "text"):
            for first in range(0, batch.num_rows, 1 << 15):
                b = batch.slice(first, 1 << 15)
                number, packet = part << 33 | packet, packet + 1
                hashes, edges = word_hashes(b.column("text"))
                priors = log_probabilities(net, vocab, (hashes % np.uint64(BUCKETS)).astype(np.int64), edges)
                steps = np.clip(np.round(priors * -STEPS), 0, 65535).astype(np.uint64)
                doc = np.repeat(np.arange(b.num_rows), np.diff(edges))
                around = neighbours(hashes, edges)
                of = _looked_up(hot[0], around)
                key, known = around.copy(), np.zeros(len(hashes), bool)
                if of.any():
                    crowd = np.flatnonzero(of)
                    key[crowd] = pair(around[crowd], hashes[crowd])
                    count = np.zeros(len(hashes), np.int64)
                    count[crowd] = _looked_up(hot[1], key[crowd])
                    known = count > 0
                own = np.zeros((b.num_rows, 2))  # what is known already, and the network's sum
                own[:, 1] = np.bincount(doc, priors, b.num_rows)
                if known.any():
                    own[:, 0] = np.bincount(doc[known], updated(steps[known].astype(np.float64), count[known], of[known]), b.num_rows)
                left = np.flatnonzero(~known)
                where = (key[left] >> np.uint64(40)) % np.uint64(ranges)
                order = np.argsort(where.astype(np.uint16) if ranges <= 1 << 16 else where, kind="stable")
                left, where = left[order], where[order]
                entry = key[left] << np.uint64(32) | (hashes[left] & np.uint64(0xFFFF)) << np.uint64(16) | steps[left]
                cuts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(left) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(left))[: len(cuts)]
                step, total = doc[left].astype(np.uint16), of[left].astype("<u8")
                spans = list(zip(cuts.tolist(), ends.tolist(), strict=True))
                n = len(spans)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((where[cuts].astype(np.int32), ((number + np.arange(b.num_rows)) % ranges).astype(np.int32)))),
                    pa.array(np.full(n + b.num_rows, number)),
                    pa.array(np.concatenate((np.full(n, -1), np.diff(edges)))),
                    pa.array([np.diff(step[x:y], prepend=np.uint16(0)).tobytes() for x, y in spans] + [i.to_bytes(2, "little") for i in range(b.num_rows)], pa.binary()),
                    pa.array([entry[x:y].tobytes() for x, y in spans] + [x.tobytes() for x in own], pa.binary()),
                    pa.array([total[x:y].tobytes() if total[x:y].any() else None for x, y in spans] + [None] * b.num_rows, pa.binary()),
                    pa.concat_arrays([pa.nulls(n, b.column("id").type), b.column("id")]),
                ], names)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts a range, and returns a row of sums for each block; documents' rows pass."""
        now, held = None, []

        def counted() -> pa.RecordBatch:
            entry = np.frombuffer(b"".join(x[2] for x in held), np.uint64)
            size = [len(x[2]) // 8 for x in held]
            known, at, count = np.unique(entry >> np.uint64(16), return_inverse=True, return_counts=True)
            beside = known >> np.uint64(16)
            heads = np.flatnonzero(np.concatenate(([True], beside[1:] != beside[:-1])))
            of = np.repeat(np.add.reduceat(count, heads), np.diff(np.append(heads, len(known))))[at]
            told = np.concatenate([np.frombuffer(x[3], "<i8") if x[3] else np.zeros(m, np.int64) for x, m in zip(held, size, strict=True)])
            value = updated((entry & np.uint64(0xFFFF)).astype(np.float64), count[at], np.where(told > 0, told, of))
            docs_, sums, lo = [], [], 0
            for x, m in zip(held, size, strict=True):
                step = np.cumsum(np.frombuffer(x[1], np.uint16), dtype=np.uint16)  # ascending
                cut = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1])))
                docs_.append(step[cut].tobytes())
                sums.append(np.add.reduceat(value[lo : lo + m], cut).tobytes())
                lo += m
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([now] * n, pa.int32()), pa.array([x[0] for x in held], pa.int64()), pa.array([-1] * n, pa.int64()), pa.array(docs_, pa.binary()), pa.array(sums, pa.binary()), pa.nulls(n, ids)], told_names)

        ids = None
        for b in batches:
            ids = b.column("id").type
            mask = pa.compute.less(b.column("n"), 0)
            if (passed := b.filter(pa.compute.invert(mask))).num_rows:
                yield passed.select(told_names)
            for row in zip(*(b.filter(mask).column(x).to_pylist() for x in ("range", "packet", "doc", "words", "around")), strict=True):
                if held and row[0] != now:
                    yield counted()
                    held.clear()
                now = row[0]
                held.append(row[1:])
        if held:
            yield counted()

    told_names = [x for x in names if x != "around"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's sums, from all ranges, in order, and then its documents."""
        now, total, rows = None, np.zeros(0), []

        def out() -> pa.RecordBatch:
            place, n, own, id_ = zip(*rows, strict=True)
            n = np.array(n, np.int64)
            known = np.array(own)
            sums = np.round(total[list(place)] + known[:, 0], 6) + 0.0
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(id_, ids), pa.array(n), pa.array(sums), pa.array(np.round(sums / np.maximum(n, 1), 6), mask=n == 0), pa.array(np.round(known[:, 1], 6) + 0.0)], [id_col, "n_words", "log_prob", "mean_log_prob", "network_log_prob"])

        ids = None
        for b in batches:
            ids = b.column("id").type
            for packet, n, doc, body, id_ in zip(*(b.column(x).to_pylist() for x in ("packet", "n", "doc", "words", "id")), strict=True):
                if packet != now:
                    if rows:
                        yield out()
                    now, total = packet, np.zeros(1 << 15)
                if n < 0:
                    total[np.frombuffer(doc, np.uint16)] += np.frombuffer(body, np.float64)
                else:
                    rows.append((int.from_bytes(doc, "little"), n, np.frombuffer(body, np.float64), id_))
        if rows:
            yield out()

    told_schema = f"range int, packet long, n long, doc binary, words binary, id {kind}"
    packed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(pack, packed_schema)
    told = packed.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "packet").mapInArrow(tell, told_schema)
    gathered = told.repartition(parts_for(docs), "packet").sortWithinPartitions("packet", "n", "range", "doc")
    return gathered.mapInArrow(finish, f"`{id_col}` {kind}, n_words long, log_prob double, mean_log_prob double, network_log_prob double")


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
