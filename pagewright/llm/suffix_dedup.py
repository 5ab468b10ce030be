"""Removal of repeated 100-byte strings, by merging shard Burrows-Wheeler transforms.

The method. The suffix space is cut so that equal strings meet: each 100-byte window belongs to the least hash of its
40-byte substrings, which equal windows share, and neighbouring windows with one least hash form a segment. Of equal
segments under a hash the first (by document, then place) stands for all: the others' windows all start earlier
elsewhere. Distinct segments under one hash are put together; a task builds the Burrows-Wheeler transforms of shards of
them and merges these by interleave refinement (``bwt``), which gives the common prefixes and so the intervals of windows
that share 100 bytes. All of an interval but its first are repeats. No suffixes are sorted across shards.

Before a merge, windows with a substring that occurs once in the group go (they repeat nothing), and equal strings are
collapsed once more.

Scale. About one segment in 31 bytes moves, as 30 bytes, whatever its length; texts move once, keyed by document. A
segment under a hash of its own goes no further. A hash that a sample finds with more than ``HOT`` segments (a line that
very many documents hold) is dealt to many tasks by document, and what these leave is collapsed by a second, partial
aggregate. A hash with over ``CROWDED`` distinct segments (each with text of its own around the line) is cut again by the
least values of more hash functions, which again are equal for equal windows, so only windows that nearly agree stay
together; equal pieces are collapsed by an aggregate as well. A task holds one group of segments or ``GROUP_BYTES`` of
groups.

Defined results. Null or empty text: no bytes, nothing removed. Documents are ordered by id (null first). Rows that share
an id are different documents, in order of text, the later of equal rows being removed. Very long texts: a row held by one
task. Ties: the earlier place stays. An empty table: no rows. Extra columns stay out of the report; ``deduplicated`` keeps
the columns of documents, whatever their names, and a null text that it got.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.bwt import repeated
from pagewright.llm.common import PrefixHash, blocks, flat, mixed, parts_for, quantiles, range_of, renamed, shared_folder, table

LENGTH, GRAM, LONGEST_RUN, CROWDED, EXTRA_HASHES, GROUP_BYTES = 100, 40, 64, 4096, 4, 1 << 18
#: Bytes of text whose hashes a core's cache holds.
SMALL_BLOCK = 1 << 16
#: Segments that make a hash hot; a sample of one document in ``SAMPLE`` tells (at most ``MAX_HOT`` hashes).
HOT, SAMPLE, MAX_HOT = 8192, 32, 1 << 16
_NULL_ID = -(1 << 63)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on (those near the end run short and mean nothing)."""
    n = len(data)
    out, done = np.zeros(n, np.uint64), 0
    double, width, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        while True:
            if size & width:  # append this power of two after what is done
                tail = np.zeros(n, np.uint64)
                tail[: n - done] = double[done:] if done < n else 0
                out = out * np.uint64(pow(base, width, 1 << 64)) + tail
                done += width
            if 2 * width > size:
                return mixed(out)
            shifted = np.zeros(n, np.uint64)
            shifted[: max(0, n - width)] = double[width:]
            double = double * np.uint64(pow(base, width, 1 << 64)) + shifted
            width *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place on."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        some = max(0, len(out) - step)
        out[:some] = np.minimum(out[:some], out[step:])
        done += step
    return out


def window_runs(data: np.ndarray, at: np.ndarray, keys: np.ndarray, longest: int = LONGEST_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of windows with one key, none longer than ``longest`` nor beyond its text."""
    sizes = np.diff(at)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.arange(len(data)) + LENGTH <= at[1:][row_of] if len(data) else np.zeros(0, bool)
    place = np.flatnonzero(valid)
    if not len(place):
        return place, place
    first = np.ones(len(place), bool)
    first[1:] = (np.diff(place) != 1) | (keys[place[1:]] != keys[place[:-1]]) | (row_of[place[1:]] != row_of[place[:-1]])
    start = np.flatnonzero(first)
    length = np.diff(np.concatenate((start, [len(place)])))
    pieces = -(-length // longest)  # long runs (periodic text) are cut, from their start
    piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return place[np.repeat(start, pieces)] + piece * longest, np.minimum(longest, np.repeat(length, pieces) - piece * longest)


def recurring(grams: np.ndarray, start: np.ndarray, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each segment holds its key's substring more than once: only then can it repeat a window of its own."""
    out = np.zeros(len(start), bool)
    for lo in range(0, len(start), 1 << 13):
        s, size, key = start[lo : lo + (1 << 13)], n[lo : lo + (1 << 13)] + LENGTH - GRAM, keys[lo : lo + (1 << 13)]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(s - first, size)
        out[lo : lo + (1 << 13)] = np.add.reduceat((grams[place] == np.repeat(key, size)).astype(np.int32), first) > 1
    return out


def _segments(rows: DataFrame, hot: np.ndarray, slices: int) -> DataFrame:
    """(key, slice, same, d, start, n, own): the segments of each document; ``same`` hashes a segment's bytes, ``own`` says
    whether it may repeat a window of its own; ``slice`` is 0, or from 1 on by the document where the key is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", SMALL_BLOCK):
            data, at = flat(b.column("text"))
            grams = gram_hashes(data)
            keys = sliding_least(grams, LENGTH - GRAM + 1)
            start, n = window_runs(data, at, keys)
            own = recurring(grams, start, n, keys[start])
            row = np.searchsorted(at, start, "right") - 1
            same = PrefixHash(data)(start, start + n + LENGTH - 1)
            d = b.column("d").to_numpy()[row]
            key = keys[start].view(np.int64)
            part = np.zeros(len(key), np.int32)
            if len(hot):
                crowd = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key)
                part[crowd] = 1 + (mixed(d[crowd].view(np.uint64)) % np.uint64(slices)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(same.view(np.int64)), pa.array(d), pa.array((start - at[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own)], ["key", "slice", "same", "d", "start", "n", "own"])

    return rows.mapInArrow(run, "key long, slice int, same long, d long, start int, n int, own boolean")


def _hot_keys(rows: DataFrame) -> np.ndarray:
    """Keys of very many segments, ascending: this decides how they are dealt, and nothing else."""
    drawn = _segments(rows.filter(F.pmod(F.xxhash64("d"), F.lit(SAMPLE)) == 0), np.zeros(0, np.int64), 1)
    found = drawn.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= max(4, HOT // SAMPLE)).orderBy(F.desc("n"), "key").limit(MAX_HOT)
    return np.sort(np.array([r["key"] for r in found.collect()], np.int64))


def _sorted_out(segments: DataFrame) -> DataFrame:
    """From segments sorted by (key, slice, same, d, start): repeats of an equal segment (``again``), and the first of each
    of several distinct segments under a key, and any that may repeat a window of its own. The rows of a key are streamed;
    the first distinct one is held back. In a slice of a hot key every distinct segment goes on."""
    names = ["key", "slice", "same", "d", "start", "n", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the first segment of the last key, while it is the only distinct one
        last_key = last_same = None
        several = False
        for b in batches:
            if not b.num_rows:
                continue
            key, part, same = (b.column(c).to_numpy() for c in ("key", "slice", "same"))
            new_key, new = np.ones(len(key), bool), np.ones(len(key), bool)
            new_key[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            new_key[0] = (key[0], part[0]) != last_key
            new[1:] = new_key[1:] | (same[1:] != same[:-1])
            new[0] = new_key[0] or same[0] != last_same
            group = np.cumsum(new_key)  # 0: still the last batch's key
            firsts = np.flatnonzero(new)
            of = group[firsts]
            count = np.bincount(of, minlength=int(group[-1]) + 1)
            out = []
            alone = b.column("own").to_numpy(zero_copy_only=False)[firsts] | (part[firsts] > 0)
            go_on = (count[of] > 1) | alone
            if count[0]:  # more distinct segments of the key that is carried over
                if not several and held is not None:
                    out.append((held, False))
                several, held = True, None
                go_on |= of == 0
            out.append((b.take(pa.array(firsts[go_on])), False))
            out.append((b.filter(pa.array(~new)), True))
            for rows, again in out:
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([*rows.select(names).columns, pa.array([again] * rows.num_rows)], [*names, "again"])
            if group[-1]:
                several = bool(count[-1] > 1)
                first = np.flatnonzero(of == group[-1])[0]
                held = None if several or alone[first] else b.slice(int(firsts[first]), 1)
            last_key, last_same = (key[-1], part[-1]), same[-1]

    parts = segments.repartition(parts_for(segments), "key", "slice").sortWithinPartitions("key", "slice", "same", "d", "start")
    return parts.mapInArrow(run, "key long, slice int, same long, d long, start int, n int, own boolean, again boolean")


def _collapsed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, same, d, start, ...): the first of each (key, same) by document and place, and (d, start, n) of the others.
    Firsts are a partial aggregate, and the rows meet them in a join, which adaptive execution splits if it is skewed."""
    first = rows.groupBy("key", "same").agg(F.min(F.struct("d", "start")).alias("__first"))
    met = rows.join(first, ["key", "same"])
    is_first = (F.col("d") == F.col("__first.d")) & (F.col("start") == F.col("__first.start"))
    return met.filter(is_first).drop("__first"), met.filter(~is_first).select("d", "start", "n")


def _with_bytes(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, same, crowded, d, start, n, own, body): the wanted segments with their bytes, and a hash of these where they are
    pieces of segments under a crowded key, which come under finer keys."""
    asked = wanted.groupBy("d").agg(F.collect_list(F.struct("key", "start", "n", "own", "crowded")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            data, at = flat(b.column("text"))
            out = []
            asked = b.column("asked")
            part = asked.values.slice(asked.offsets[0].as_py(), asked.offsets[-1].as_py() - asked.offsets[0].as_py())
            key, start, n, own, crowded = (part.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            row = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()))
            d = b.column("d").to_numpy()
            begin = at[row] + start
            plain = np.flatnonzero(~crowded.astype(bool))
            out += zip(key[plain].tolist(), [False] * len(plain), d[row[plain]].tolist(), start[plain].tolist(), n[plain].tolist(), own[plain].tolist(), begin[plain].tolist(), strict=True)
            if len(plain) < len(row):  # the crowded segments alone, one after another
                rest = np.flatnonzero(crowded.astype(bool))
                size = n[rest] + LENGTH - 1
                first = np.cumsum(size) - size
                place = np.arange(int(size.sum())) + np.repeat(begin[rest] - first, size)
                grams = gram_hashes(data[place])
                with np.errstate(over="ignore"):
                    finer = np.zeros(len(place), np.uint64)
                    for i in range(EXTRA_HASHES):
                        finer = mixed(finer + sliding_least(mixed(grams + np.uint64(i + 1)), LENGTH - GRAM + 1))
                for j, f in zip(rest.tolist(), first.tolist(), strict=True):
                    a, m = int(begin[j]), int(n[j])
                    fine = mixed(finer[f : f + m] ^ key[j : j + 1].view(np.uint64)).view(np.int64)
                    cut = np.concatenate(([0], np.flatnonzero(fine[1:] != fine[:-1]) + 1, [m])).tolist()
                    out += [(int(fine[x]), True, int(d[row[j]]), int(start[j]) + x, y - x, bool(own[j]), a + x) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            if out:
                body = [data[a : a + m + LENGTH - 1].tobytes() for *_, m, _, a in out]
                k, c, d_, s, m, o, _ = zip(*out, strict=True)
                same = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) if y else 0 for x, y in zip(body, c, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(same, pa.int64()), pa.array(c, pa.bool_()), pa.array(d_, pa.int64()), pa.array(s, pa.int32()), pa.array(m, pa.int32()), pa.array(o, pa.bool_()), pa.array(body, pa.binary())], ["key", "same", "crowded", "d", "start", "n", "own", "body"])

    return rows.join(asked, "d").select("d", "text", "asked").mapInArrow(run, "key long, same long, crowded boolean, d long, start int, n int, own boolean, body binary")


def recurring_windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """String, place in it and bytes of the runs of windows whose ``GRAM``-byte substrings all occur in the strings more
    than once. A window with one that doesn't is no repeat, so it needs no place in a transform."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(data))
    grams = gram_hashes(data)
    order = np.argsort(grams)
    alike = grams[order[1:]] == grams[order[:-1]]
    again = np.zeros(len(data), bool)
    again[order[1:][alike]] = again[order[:-1][alike]] = True
    lone = np.concatenate(([0], np.cumsum(~again)))
    last = np.minimum(np.arange(len(data)) + LENGTH - GRAM + 1, len(data))
    place = np.flatnonzero((left >= LENGTH) & (lone[last] == lone[:-1]))
    if not len(place):
        return place, place, []
    first = np.flatnonzero(np.concatenate(([True], np.diff(place) != 1)))
    start, n = place[first], np.diff(np.append(first, len(place)))
    string = np.searchsorted(ends, start, "right")
    return string, start - (ends - size)[string], [data[a : a + m + LENGTH - 1].tobytes() for a, m in zip(start.tolist(), n.tolist(), strict=True)]


def _repeats(bodies: DataFrame) -> DataFrame:
    """(d, start, n): runs of windows that also start earlier, from segments that share a key."""

    def found(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        if not group:
            return
        of, begin, runs = recurring_windows([g[5] for g in group])
        if not runs:
            return
        d = np.array([g[1] for g in group])[of]
        start = np.array([g[2] for g in group])[of] + begin
        marks, known, distinct = [], set(), []
        for i in np.lexsort((start, d)).tolist():
            if runs[i] in known:  # the whole run starts earlier
                places = start[i] + np.arange(len(runs[i]) - LENGTH + 1)
                marks.append(np.stack((np.full(len(places), d[i]), places)))
            else:
                known.add(runs[i])
                distinct.append(i)
        if len(distinct) < len(runs):
            of, begin, runs = recurring_windows([runs[i] for i in distinct])
            d, start = d[distinct][of], start[distinct][of] + begin
        for string, offset in repeated(runs, LENGTH) if runs else ():
            order = np.lexsort((start[string] + offset, d[string]))
            s, o = string[order], offset[order]
            # the first stays, as does the same place in it under another segment
            later = (d[s] != d[s[0]]) | (start[s] + o != start[s[0]] + o[0])
            marks.append(np.stack((d[s[later]], start[s[later]] + o[later])))
        if marks:
            m = np.unique(np.concatenate(marks, 1), axis=1)
            cut = np.concatenate(([0], np.flatnonzero((np.diff(m[0]) != 0) | (np.diff(m[1]) != 1)) + 1, [m.shape[1]]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b > a:
                    yield int(m[0, a]), int(m[1, a]), int(b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = list(found(ready))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["d", "start", "n"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and row[0] != group[-1][0]:
                    if len(group) > 1 or group[0][4]:  # else it is alone under its key
                        ready += group
                        size += sum(len(g[5]) for g in group)
                    group = []
                    if size > GROUP_BYTES:
                        yield out()
                        ready, size = [], 0
                group.append(row)
        if group and (len(group) > 1 or group[0][4]):
            ready += group
        yield out()

    parts = bodies.repartition(parts_for(bodies), "key").sortWithinPartitions("key", "d", "start")
    return parts.mapInArrow(run, "d long, start int, n int")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, under names by place, with ``text`` in place of theirs, ``null`` (whether it was) and ``d``, which orders
    the documents: the id where ids are unique, else a number by (id, text)."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    rows = docs.withColumns({"d": key, "text": F.coalesce(F.col(text_col), F.lit("")), "null": F.col(text_col).isNull()}).drop(text_col)
    n, distinct = docs.agg(F.count("*"), F.count_distinct(key)).first()
    if n == distinct:
        return rows
    splitters = quantiles(rows.select("d"), "d", parts_for(docs))
    rows = rows.withColumn("__range", range_of(F.col("d"), splitters))
    sizes = {r["__range"]: r["count"] for r in rows.groupBy("__range").count().collect()}
    base = np.cumsum([0, *(sizes.get(i, 0) for i in range(len(splitters) + 1))]).tolist()
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if b.num_rows:
                at = base[b.column("__range")[0].as_py()] if at is None else at
                columns = [pa.array(np.arange(at, at + b.num_rows)) if c == "d" else b.column(c) for c in names]
                at += b.num_rows
                yield pa.RecordBatch.from_arrays(columns, names)

    spread = rows.repartitionById(len(splitters) + 1, F.col("__range")).sortWithinPartitions("d", "text")
    return spread.mapInArrow(number, rows.schema).drop("__range")


def _with_marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, under names by place, with ``__marks``: runs of windows (start, n) that start earlier elsewhere."""
    safe = renamed(docs)
    rows = _numbered(safe, *(f"u{docs.columns.index(c)}" for c in (id_col, text_col)))
    texts = rows.select("d", "text")
    hot, folder = _hot_keys(texts), shared_folder(docs.sparkSession)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")  # which lets go of what was shuffled for it
        return docs.sparkSession.read.parquet(f"{folder}/{name}")

    found = stored(_sorted_out(_segments(texts, hot, parts_for(docs))), "segments")
    firsts, again = found.filter("not again"), [found.filter("again").select("d", "start", "n")]
    wanted = firsts.filter("slice = 0").drop("slice", "again")
    if len(hot):
        left, more = _collapsed(firsts.filter("slice > 0").drop("slice", "again"))
        wanted = wanted.unionByName(left)
        again.append(more)
    wanted = wanted.select("key", "d", "start", "n", "own")
    crowded = wanted.groupBy("key").count().filter(F.col("count") > CROWDED).select("key", F.lit(True).alias("crowded"))
    wanted = wanted.join(crowded, "key", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    bodies = stored(_with_bytes(wanted, texts), "bodies")
    pieces, more = _collapsed(bodies.filter("crowded"))
    again.append(more)
    names = ["key", "d", "start", "n", "own", "body"]
    again.append(_repeats(bodies.filter("not crowded").select(*names).unionByName(pieces.select(*names))))
    marks = reduce(DataFrame.unionByName, again)
    marks = marks.groupBy("d").agg(F.collect_list(F.struct("start", "n")).alias("__marks"))
    return rows.join(marks, "d", "left")


def spans(marks: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the marked windows cover."""
    out: list[list[int]] = []
    for a, n in sorted((m["start"], m["n"]) for m in marks or []):
        b = a + n + LENGTH - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for cut in cuts for x in cut), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def reported(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    marked = _with_marks(docs.select(id_col, text_col), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            rows = []
            for text, marks in zip(b.column("text").to_pylist(), b.column("__marks").to_pylist(), strict=True):
                data, cuts = text.encode(), spans(marks)
                rows.append((len(data), sum(y - x for x, y in cuts), len(cuts), hashlib.sha256(without(data, cuts)).hexdigest()))
            size, removed, count, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("u0"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select("u0", "text", "__marks").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their repeats, in the columns that came in; characters that a cut splits stay whole. A
    document of which nothing but white space is left goes; one that came with none stays."""
    text_at = docs.columns.index(text_col)
    marked = _with_marks(docs, id_col, text_col)
    names = [f"u{i}" for i in range(len(docs.columns)) if i != text_at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            texts, keep = [], []
            for text, null, marks in zip(b.column("text").to_pylist(), b.column("null").to_pylist(), b.column("__marks").to_pylist(), strict=True):
                if marks:
                    data = text.encode()
                    cuts = []
                    for x, y in spans(marks):
                        while x < y and data[x] & 0xC0 == 0x80:
                            x += 1
                        while y > x and y < len(data) and data[y] & 0xC0 == 0x80:
                            y -= 1
                        cuts.append((x, y))
                    text = without(data, cuts).decode()
                texts.append(None if null else text)
                keep.append(not marks or bool(text.strip()))
            columns = [b.column(c) for c in names]
            columns.insert(text_at, pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, safe.names).filter(pa.array(keep, pa.bool_()))

    safe = renamed(docs).schema
    return marked.select(*names, "text", "null", "__marks").mapInArrow(run, safe).toDF(*docs.columns)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(table(spark, sf_dir, "documents"))


SQL = r"""with d as (
  select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents
), w as (
  select doc_id, i, hash(substr(h, 2 * i + 1, 200)) as a, md5(substr(h, 2 * i + 1, 200)) as b from (select doc_id, h, unnest(range(len(h) // 2 - 99)) as i from d where len(h) >= 200)
), again as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by a, b order by doc_id, i) as n from w) where n > 1
), opens as (
  select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true) as new from again
), runs as (
  select doc_id, min(i) as x, max(i) + 100 as y from (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as k from opens) group by doc_id, k
), gaps as (
  select doc_id, y as x, coalesce(lead(x) over (partition by doc_id order by x, y), len(h) // 2) as y from (select * from runs union all select doc_id, 0, 0 from d) join d using (doc_id)
), kept as (
  select doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as h from gaps join d using (doc_id) group by doc_id
), sums as (
  select doc_id, sum(y - x)::bigint as n_removed, count(*) as n_spans from runs group by doc_id
)
select doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(kept.h)) as kept_sha256
from d join kept using (doc_id) left join sums using (doc_id)
"""
