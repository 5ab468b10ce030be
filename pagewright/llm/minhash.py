"""MinHash near-dedup with sequential Bayesian verification.

The method. A text's words (ASCII letters lower-cased) give its set of distinct shingles, as 64-bit hashes. Texts with
equal sets form a class, and one row stands for it. A class's signature of ``BANDS * ROWS`` minimum hashes is cut into
bands; classes that agree in a band are candidates. A candidate pair's signatures are compared batch by batch: with m
agreements in n, under a uniform prior, the posterior chance that the similarity reaches t is
``P(Binomial(n + 1, t) <= m)``; a pair falls out when that is below ``MISS``. Survivors are verified on their full sets.
A pair at similarity 0.8 shares no band with a chance of 3e-6.

No bucket emits its pairs. First each member is compared with one leader of its bucket, the one that meets the most
others in all its bands: near copies of one text agree with that text more than with each other. The links give
components. Only classes of buckets that still hold several components go on. Of these, similar sets must share one of
their rarest shingles (about an eighth of the smaller set's, a fifth of the larger's; ``prefix_sizes``), in any one order:
here by how many sets hold a shingle. So texts of one template, which agree in most bands and are similar to none, part by
what is their own, and make no candidates; this filter loses no pair. Classes that share such a shingle are put into
blocks of about ``BLOCK`` (those of shingles with the same commonest component share blocks), once each whatever number of
shingles they have; the members outside a shingle's commonest component visit the blocks of its members. A task holds a block and
streams its visitors: signatures first, then the full sets, and only links that join two components become rows, so a
block emits fewer links than it has components. A link between classes that are in one component by other links isn't
looked for: it changes no component.

Scale. The row of a class moves as its bands (16 bytes each) and, if it shares a bucket with another, as its signature
and its set. Texts are read twice and moved once, those of shared buckets alone. Classes of unsettled buckets become a narrow
row for each rare shingle; a visit carries a set, and takes place only between classes that share one. Hot buckets and leaders
are sides of joins that adaptive execution splits; crowded blocks are split by their visitors. Counts and the ``SKETCH`` counters reach the driver.

Defined results. Null, empty or blank text: no shingles, linked with nothing. Fewer words than a shingle: one shingle of
them all. Very long texts: a row of the set is held by one task. Null id: as an id before all ids, null in the result.
Rows that share an id are one vertex, in a row each. Ties: the least id stands for a class or component. An empty table:
no rows. Extra columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import PrefixHash, blocks, checkpointed, flat, mixed, shared_folder, table, words_of
from pagewright.llm.components import components

BANDS, ROWS, BATCH, MISS, BLOCK = 42, 6, 36, 1e-9, 256
#: Counters of shingles: their number is a power of two, and bounds what the driver and the tasks hold.
SKETCH = 1 << 20
#: Most ids (about 50 bytes each) that a join broadcasts; beyond, both sides are shuffled.
MAX_BROADCAST = 500_000
_NULL_ID = -(1 << 63)


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    return (seeds[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[1::2] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = flat(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, row = words_of(data, at)
    word = PrefixHash(data)(start, end)
    out = []
    edges = np.searchsorted(row, np.arange(len(at)))
    with np.errstate(over="ignore"):
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            w = word[a:b]
            n = min(size, len(w))
            if not n:
                out.append(w)
                continue
            h = np.full(len(w) - n + 1, n, np.uint64)
            for i in range(n):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
            out.append(np.unique(h))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low byte of the minimum of each hash function over the set: unequal minima agree in it once in 256 times."""
    a, b = _family()
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), 256):
            least = np.minimum(least, (low[None, i : i + 256] * a[:, None] + b[:, None]).min(1))
    return (least & np.uint32(0xFF)).astype(np.uint8)


def _features(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            sets = shingle_sets(b.column("text"), size)
            with np.errstate(over="ignore"):
                keys = [[int(x) for x in (s.sum(), mixed(s).sum())] if len(s) else [0, 0] for s in sets]
            k = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["id", "n", "k1", "k2", "sig"])

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(band, id): a row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, _ = flat(b.column("sig"))
            sig = data.reshape(b.num_rows, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
            with np.errstate(over="ignore"):
                for i in range(ROWS):
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
            rows = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), b.column("id").take(rows)], ["band", "id"])

    return classes.select("id", "sig").mapInArrow(run, "band long, id long")


@lru_cache(maxsize=8)
def fewest_agreements(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch, the fewest agreements with which a pair goes on."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        upto, m = 0.0, -1
        while upto < miss:
            m += 1
            upto += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _agreeing(sig: np.ndarray, others: np.ndarray, live: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the rows ``live`` of ``others`` survive the comparison with ``sig`` (one signature, or one for each row)."""
    agreed = np.zeros(len(live), np.int64)
    for i, m in enumerate(least):
        if not len(live):
            break
        part = slice(i * BATCH, (i + 1) * BATCH)
        agreed = agreed + (others[live, part] == (sig[part] if sig.ndim == 1 else sig[live, part])).sum(1)
        live, agreed = live[agreed >= m], agreed[agreed >= m]
    return live


def _similar(both: int, n: int, m: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def _sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, n, sig, set) of the wanted classes, from the texts of their first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            sets = shingle_sets(b.column("text"), size)
            with np.errstate(over="ignore"):
                own = np.array([s.sum() for s in sets], np.uint64).view(np.int64) == b.column("k1").to_numpy()  # rows may share an id
            own &= np.array([len(s) for s in sets], np.int64) == b.column("n").to_numpy()
            keep = pa.array(np.flatnonzero(own))
            sets = [sets[i] for i in keep.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").take(keep), b.column("n").take(keep), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "sig", "set"])

    few = wanted.count() <= MAX_BROADCAST
    asked = rows.join(F.broadcast(wanted) if few else wanted, "id")
    return asked.select("id", "text", "k1", "n").mapInArrow(run, "id long, n long, sig binary, set binary")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that survive the Bayesian test and whose full sets have at least the similarity."""
    percent = round(100 * threshold)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = fewest_agreements(threshold)
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (flat(b.column(c))[0].reshape(b.num_rows, BANDS * ROWS) for c in ("sig_a", "sig_b"))
            keep = []
            for i in _agreeing(x, y, np.arange(b.num_rows), least).tolist():
                p, q = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
                if _similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    named = lambda x: sets.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("set").alias(f"set_{x}"))
    joined = pairs.join(named("a"), "a").join(named("b"), "b")
    return joined.select("a", "b", "sig_a", "sig_b", "set_a", "set_b").mapInArrow(check, "a long, b long").distinct()


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle, by shingles' hashes to ``SKETCH`` counters: 8 MB, whatever the input is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for b in batches:
            counts += np.bincount(_counter(np.frombuffer(flat(b.column("set"))[0].tobytes(), np.uint64)), minlength=SKETCH)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["at", "n"])

    total = sets.select("set").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # SKETCH rows at most
    out = np.zeros(SKETCH, np.int64)
    out[total.column("at").to_numpy()] = total.column("n").to_numpy()
    return out


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64)


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """Of a set of n, how many of its rarest shingles (in one order for all sets) must hold one of those of a similar set: of a
    set that isn't larger, and of any. Similar sets of n <= m share ``t / (1 + t) * (n + m)`` shingles or more, which is
    at least ``2 * t / (1 + t) * n`` and ``t * m``: so the smaller one's first ``n - 2 * t / (1 + t) * n + 1`` meet the larger one's
    first ``m - t * m + 1``."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def _prefixes(members: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """(token, id, c, n, short): a row for each of the rarest shingles that a set may meet a similar one in; ``short``: also as
    the smaller one."""
    held = members.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, rows, short = [], [], []
            data, at = flat(b.column("set"))
            hashes, edge = np.frombuffer(data.tobytes(), np.uint64), at // 8
            for i in range(b.num_rows):
                own = hashes[edge[i] : edge[i + 1]]
                few, most = prefix_sizes(len(own), percent)
                rare = own[np.lexsort((own, held.value[_counter(own)]))[:most]]
                tokens.append(rare)
                rows.append(np.full(len(rare), i))
                short.append(np.arange(len(rare)) < few)
            if tokens:
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), *(b.column(x).take(rows) for x in ("id", "c", "n")), pa.array(np.concatenate(short))], ["token", "id", "c", "n", "short"])

    return members.select("id", "c", "n", "set").mapInArrow(run, "token long, id long, c long, n long, short boolean")


def _meeting(live: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(token, id, c): the classes (id, c) by the rare shingles in which they may meet a similar class of another component."""
    rows = checkpointed(_prefixes(sets.join(live, "id"), _rarity(sets), round(100 * threshold)))
    shared = rows.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("short").alias("short")).filter("c0 < c1 and short").select("token")
    return checkpointed(rows.join(shared, "token").select("token", "id", "c"))


class _Block:
    """The members of a block, with their labels so far; ``links`` compares a visitor with all of them."""

    def __init__(self, rows: pa.Table, threshold: float):
        self.id, self.c, self.n = (rows.column(x).to_numpy().copy() for x in ("id", "c", "n"))
        self.sig = flat(rows.column("sig"))[0].reshape(len(self.id), BANDS * ROWS)
        data, at = flat(rows.column("set"))
        self.known, self.of = np.unique(np.frombuffer(data.tobytes(), np.uint64), return_inverse=True)
        self.edge = at // 8
        self.percent, self.least = round(100 * threshold), fewest_agreements(threshold)
        self.same: dict[int, int] = {}

    def label(self, c: int) -> int:
        while c in self.same:
            c = self.same[c]
        return c

    def links(self, vid: int, c: int, n: int, sig: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """A link for each component of which a member is similar to the visitor."""
        c = self.label(c)
        near = (self.c != c) & (100 * np.minimum(self.n, n) >= self.percent * np.maximum(self.n, n))
        live = _agreeing(sig, self.sig, np.flatnonzero(near), self.least)
        if not len(live):
            return
        held = np.zeros(len(self.known), bool)
        where = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        held[where[self.known[where] == hashes]] = True
        for j in live.tolist():
            if self.c[j] != c and _similar(int(held[self.of[self.edge[j] : self.edge[j + 1]]].sum()), n, int(self.n[j]), self.percent):
                yield min(vid, int(self.id[j])), max(vid, int(self.id[j]))
                old = int(self.c[j])
                self.same[old] = c
                self.c[self.c == old] = c


def _across(live: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the components ``c`` of the rows (token, id, c): enough to join all that a similar pair with a token in
    common joins."""
    commonest = live.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "c"))["c"].alias("top"))
    rows = checkpointed(live.join(commonest, "token"))
    home = rows.groupBy("id").agg(F.min("c").alias("c"), F.min("top").alias("place"))
    sizes = home.groupBy("place").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    home = checkpointed(home.join(sizes, "place").select("id", "c", "place", F.pmod(F.xxhash64("id"), "parts").alias("part")))
    blocks_of = rows.join(home.select("id", "place", "part"), "id").select("token", "place", "part").distinct()
    visits = rows.filter("c <> top").select("token", "id").join(blocks_of, "token").select("id", "place", "part").distinct()
    visits = checkpointed(visits)
    crowds = visits.groupBy("place", "part").agg(F.ceil(F.count("*") / BLOCK).alias("turns"))
    visitors = visits.join(crowds, ["place", "part"]).withColumn("turn", F.pmod(F.xxhash64("id", F.lit(1)), "turns")).join(home.select("id", "c"), "id")
    members = home.join(crowds, ["place", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    keys = ["place", "part", "turn"]
    both = members.select(*keys, F.lit(0).alias("role"), "id", "c").unionByName(visitors.select(*keys, F.lit(1).alias("role"), "id", "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, out = None, [], None, []
        for b in batches:
            k = list(zip(*(b.column(x).to_pylist() for x in keys), strict=True))
            role = b.column("role").to_pylist()
            for i in range(b.num_rows):
                if k[i] != key:
                    key, held, block = k[i], [], None
                if not role[i]:
                    held.append(b.slice(i, 1))
                    continue
                if held:
                    block, held = _Block(pa.Table.from_batches(held), threshold), []
                if block is None:
                    continue
                sig, hashes = (b.column(x)[i].as_buffer() for x in ("sig", "set"))
                out += block.links(b.column("id")[i].as_py(), b.column("c")[i].as_py(), b.column("n")[i].as_py(), np.frombuffer(sig, np.uint8), np.frombuffer(hashes, np.uint64))
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = both.join(sets, "id").repartition(*keys).sortWithinPartitions(*keys, "role", "id")
    return dealt.select(*keys, "role", "id", "c", "n", "sig", "set").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    folder = shared_folder(docs.sparkSession)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")  # which lets go of what was shuffled for it
        return docs.sparkSession.read.parquet(f"{folder}/{name}")

    features = stored(_features(rows, size), "features")
    grouped = features.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min_by("sig", "id").alias("sig"), F.min("id").alias("id"))
    classes = stored(grouped.select("id", "n", "k1", "k2", "sig"), "classes")
    crowded = _bands(classes).groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    buckets = stored(_bands(classes).join(crowded, "band"), "buckets")
    met = buckets.groupBy("id").agg(F.sum("m").alias("met"))  # the text that a group's copies were made from meets the most
    n, distinct = features.agg(F.count("*"), F.count_distinct("id")).first()
    wanted = classes.join(met.select("id"), "id", "left_semi").select("id", "k1", "n")
    sets = stored(_sets(rows if n == distinct else rows.dropDuplicates(["id", "text"]), wanted, size), "sets")

    percent = round(100 * threshold)
    weighed = buckets.select("band", "id").join(met, "id").join(classes.select("id", "n"), "id")
    leaders = weighed.groupBy("band").agg(F.max(F.struct("met", -F.col("id"), "id", "n")).alias("l")).select("band", F.col("l.id").alias("lead"), F.col("l.n").alias("m"))
    beside = weighed.join(leaders, "band").filter((F.col("id") != F.col("lead")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    pairs = checkpointed(beside.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct())
    first = components(_linked(pairs, sets, threshold))

    live = buckets.filter("m > 2").select("band", "id").join(first.withColumnsRenamed({"v": "id", "component": "c"}), "id", "left").withColumn("c", F.coalesce("c", "id"))
    unsettled = live.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("band")
    apart = checkpointed(live.join(unsettled, "band", "left_semi").select("id", "c").distinct())
    found = checkpointed(_across(_meeting(apart, sets, threshold), sets, threshold))
    label = lambda x: found.select(x).join(first.select(F.col("v").alias(x), F.col("component").alias(f"c{x}")), x, "left").select(x, F.coalesce(f"c{x}", x).alias(f"c{x}")).distinct()
    joined = found.join(label("a"), "a").join(label("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    second = components(joined).select(F.col("v").alias("component"), F.col("component").alias("last"))

    out = features.join(classes.select(F.col("id").alias("rep"), "k1", "k2", "n"), ["k1", "k2", "n"], "left").join(first.withColumnsRenamed({"v": "rep"}), "rep", "left")
    out = out.withColumn("component", F.coalesce("component", "rep")).join(second, "component", "left")
    component = F.coalesce("last", "component", "id")
    shown = lambda c: F.when(c != F.lit(_NULL_ID), c)
    return out.select(shown(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), shown(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


SQL = r"""with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w
), u as (
  select doc_id, len(s) as n, unnest(s) as x from s
), p as (
  select a.doc_id as a, b.doc_id as b from u a join u b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), l as (
  select a, b from p union all select b, a from p
), r as (
  select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on l.a = r.b
), c as (
  select a as doc_id, min(b) as component_id from r group by a
)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c using (doc_id)
"""
