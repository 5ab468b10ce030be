"""URL filter: fixed rules of hosts and paths, else association rules that are mined from labelled URLs.

The method. A URL's tokens are the parts of its host, path, query and fragment, each under its kind; a number counts as
``0``. A transaction is a distinct labelled URL: its tokens, bad or not. Mining level by level finds, however many tokens
a URL has, the combinations that at least ``min_support`` of the transactions hold and are bad; a combination is a rule if its
confidence is at least ``min_confidence`` and the lower Wilson bound of it (``z`` deviations) lies above the share of bad
URLs: among thousands of combinations some reach any confidence by chance. A rule with a more general one that is as
sure goes. Rules are looked up by an inverted index from each rule's rarest token; the rule's other tokens are then
looked for in the URL. Of the rules that match, the surest tells the verdict; without one the URL is allowed.

Scale. Pages are read for their URLs alone, and judged where they are, without a shuffle. Labelled URLs are joined and made
distinct, with partial aggregation. Fitting reads all tokens of a labelled URL, wherever they stand; a token has at most ``TOKEN``
characters (the hash of a longer one). URLs become their distinct sets of frequent tokens, in which each level is counted where
they are, ``CELLS`` combinations at once. A combination that holds as many good URLs as one of its parts is no surer than that part,
and neither is what extends it: it goes, so tokens that come together make no combinations. The driver holds the others, and tasks
are given them: no more than the labelled URLs tell apart, but with many tokens that come independently of each other their number is
exponential by nature. Nothing is capped then. The frequent tokens are as many as the tokens of a mean URL by ``min_support`` at most. Judging looks at all tokens.

Defined results. A null URL, or one without ``://``: host and path are empty, no rule fits, and no tokens, hence allowed.
Very long URLs: all tokens are looked up. Repeated URLs: a row each, one transaction, bad if any label says so. Ties of
confidence: larger support, then the rule's text. No labels, or fewer than ``least`` bad ones: no rules. Of fixed rules
the longest wins. Empty tables: no rows. Extra columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import shared_folder, table

#: Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Up to so many frequent tokens a URL, the tests compare with every combination; it limits nothing.
ITEMS = 8
#: Characters of a token; combinations that a task extends at once.
TOKEN, CELLS = 64, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Limits:
    min_support: float = 0.002
    least: int = 20
    min_confidence: float = 0.5
    z: float = 3.0


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later ones are asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, in its order."""
    after = _after(url)
    whole = {"h": host_of(url), "p": path_of(url), "q": F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1), "f": F.regexp_extract(after, "^[^#]*#(.*)", 1)}
    named = lambda x: F.when(F.length(x) > TOKEN, F.sha2(x, 256)).when(x.rlike("^[0-9]+$"), "0").otherwise(x)

    def tagged(kind: str, text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        return F.transform(words, lambda x: F.concat(F.lit(f"{kind}:"), named(x)))

    parts = [tagged(kind, text) for kind, text in whole.items()]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def wilson_lower(hits: float, n: float, z: float) -> float:
    """The lower bound of a share of which ``hits`` of ``n`` were seen."""
    share = hits / n
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def encoded(urls: DataFrame, tokens: list[str]) -> DataFrame:
    """(items, n, b): the distinct sets of the given tokens that URLs (t, bad) hold, as their sorted places, how many URLs hold
    them and how many of these are bad."""
    known = pa.array(tokens, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("t")
            rows = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
            place = pc.index_in(column.flatten(), value_set=known)
            held = place.is_valid().to_numpy(zero_copy_only=False)
            rows, place = rows[held], place.drop_null().to_numpy()
            order = np.lexsort((place, rows))
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(column))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order])), b.column("bad")], ["items", "bad"])

    return urls.select("t", "bad").mapInArrow(run, "items array<int>, bad boolean").filter(F.size("items") > 1).groupBy("items").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("b"))


def extensions(sets: DataFrame, levels: list[np.ndarray], good: np.ndarray, width: int, least: int) -> DataFrame:
    """(key, n, b) of the combinations with one token more than the last level's, and ``least`` bad URLs. A level has, sorted, the keys of its
    combinations: the place in the level before of what they are without their last token, times ``width``, plus that token;
    the first level's keys are tokens. A combination counts if each of its two parts without one of the last two tokens is one, and
it holds fewer good URLs than both: ``good`` has those of the last level's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, weight = b.column("items"), np.stack([b.column(c).to_numpy() for c in ("n", "b")])
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            items, ends = column.flatten().to_numpy().astype(np.int64), np.cumsum(sizes)
            # what is held: in which row, up to which place of the items, as which combination of the level
            todo = [(0, np.repeat(np.arange(len(sizes)), sizes), np.arange(len(items)), items)]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            while todo:
                level, row, at, combination = todo.pop()
                more = ends[row] - at - 1
                upto = np.cumsum(more)
                if len(row) > 1 and upto[-1] > CELLS:
                    half = len(row) // 2
                    todo += [(level, row[x], at[x], combination[x]) for x in (slice(half, None), slice(half))]
                    continue
                row, combination = np.repeat(row, more), np.repeat(combination, more)
                at = np.repeat(at + 1 - (upto - more), more) + np.arange(len(row))
                key = combination * width + items[at]
                # the combination with its last token replaced by the new one
                twin = _places(levels[level], (levels[level][combination] // width * width if level else 0) + items[at])
                there = twin >= 0 if level + 1 < len(levels) else (twin >= 0) & (good[combination] > 0) & (good[twin] > 0)
                row, at, key = row[there], at[there], key[there]
                if level + 1 < len(levels):
                    place = _places(levels[level + 1], key)
                    there = place >= 0
                    if there.any():
                        todo.append((level + 1, row[there], at[there], place[there]))
                elif len(key):
                    found.append(_summed(key, weight[:, row]))
                    if sum(len(k) for k, _ in found) > CELLS:
                        found = [_summed(np.concatenate([k for k, _ in found]), np.concatenate([w for _, w in found], axis=1))]
                        if len(found[0][0]) > CELLS // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found[0][0], *found[0][1])], ["key", "n", "b"])
                            found = []
            for key, sums in found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *sums)], ["key", "n", "b"])

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, bad = (b.column(c).to_numpy() for c in ("key", "n", "b"))
            last = levels[-1]
            twin = _places(last, (last[key // width] // width * width if len(levels) > 1 else 0) + key % width)
            yield b.filter(pa.array(n - bad < np.minimum(good[key // width], good[twin])))

    schema = "key long, n long, b long"
    summed = sets.mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    return summed.filter(F.col("b") >= least).mapInArrow(fewer, schema)


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(key, return_inverse=True)
    sums = np.zeros((2, len(keys)), np.int64)
    for out, w in zip(sums, weight, strict=True):
        np.add.at(out, place, w)
    return keys, sums


def _places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted known ones; -1 where it isn't one."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def mined(labelled: DataFrame, limits: Limits = Limits()) -> list[tuple[tuple[str, ...], float, int]]:
    """The rules (tokens, confidence, URLs that hold them) from (url, bad), the surest first."""
    spark, folder = labelled.sparkSession, shared_folder(labelled.sparkSession)
    once = labelled.filter("url is not null").groupBy("url").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    once.select(tokens_of(F.col("url")).alias("t"), "bad").write.parquet(f"{folder}/urls")
    urls = spark.read.parquet(f"{folder}/urls")
    n, bad = urls.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    least = max(limits.least, math.ceil(limits.min_support * n), 1)
    if bad < least:
        return []
    base = bad / n
    held = urls.select(F.explode("t").alias("t"), "bad").groupBy("t").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("b"))
    told = sorted((r["t"], r["n"], r["b"]) for r in held.filter((F.col("b") >= least) & (F.col("n") - F.col("b") < n - bad)).collect())
    tokens, width = [t for t, _, _ in told], len(told)
    live = {(i,): (n, b) for i, (_, n, b) in enumerate(told)}
    sets, levels, rules = None, [np.arange(width)], []
    while live:
        rules += [(tuple(tokens[i] for i in items), b / n, n) for items, (n, b) in live.items() if b / n >= limits.min_confidence and wilson_lower(b, n, limits.z) > base]
        if len(live) < len(levels) + 1:  # a combination has as many parts
            break
        if sets is None:
            encoded(urls, tokens).write.parquet(f"{folder}/sets")
            sets = spark.read.parquet(f"{folder}/sets")
        names, grown, keys = list(live), {}, []
        good = np.array([n - b for n, b in live.values()], np.int64)
        found = extensions(sets, levels, good, width, least).toArrow().sort_by("key")
        for key, n, b in zip(*(c.to_pylist() for c in found.columns), strict=True):
            items = (*names[key // width], key % width)
            parts = [live.get(items[:i] + items[i + 1 :]) for i in range(len(items))]
            if all(p and n - b < p[0] - p[1] for p in parts):
                grown[items] = (n, b)
                keys.append(key)
        live, levels = grown, [*levels, np.array(keys, np.int64)]
    return pruned(rules)


def pruned(rules: list[tuple[tuple[str, ...], float, int]]) -> list[tuple[tuple[str, ...], float, int]]:
    """The rules without those that a more general rule, as sure or surer, makes needless; the surest first."""
    best = {items: sure for items, sure, _ in rules}
    kept = [r for r in rules if not any(best.get(part, -1.0) >= r[1] for k in range(1, len(r[0])) for part in combinations(r[0], k))]
    return sorted(kept, key=lambda r: (-r[1], -r[2], r[0]))


class RuleIndex:
    """An inverted index of rules: postings from a rule's rarest token, and the tokens that remain to be found."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float, int]]):
        known = sorted({t for items, _, _ in rules for t in items})
        number = {t: i for i, t in enumerate(known)}
        uses = np.bincount([number[t] for items, _, _ in rules for t in items], minlength=len(known))
        anchors = [min((number[t] for t in items), key=lambda i: (uses[i], i)) for items, _, _ in rules]
        order = np.argsort(anchors, kind="stable") if rules else np.zeros(0, np.int64)
        self.tokens = pa.array(known, pa.string())
        self.postings = order.astype(np.int64)
        self.at = np.searchsorted(np.array(anchors, np.int64)[order], np.arange(len(known) + 1)) if rules else np.zeros(1, np.int64)
        self.items = np.array([number[t] for items, _, _ in rules for t in items], np.int64)
        self.ends = np.concatenate(([0], np.cumsum([len(items) for items, _, _ in rules]))).astype(np.int64)

    def first(self, column: pa.ListArray) -> np.ndarray:
        """Of each row of tokens, the first rule that it holds all tokens of; -1 where there is none."""
        out = np.full(len(column), -1, np.int64)
        if not len(self.tokens) or not len(column):
            return out
        rows = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        ids = pc.index_in(column.flatten(), value_set=self.tokens)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        rows, ids = rows[known], ids.drop_null().to_numpy().astype(np.int64)
        held = np.unique(rows * len(self.tokens) + ids)
        n = self.at[ids + 1] - self.at[ids]
        rule = self.postings[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        row = np.repeat(rows, n)
        size = self.ends[rule + 1] - self.ends[rule]
        item = self.items[np.repeat(self.ends[rule] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        want = np.repeat(row, size) * len(self.tokens) + item
        place = np.minimum(np.searchsorted(held, want), max(len(held) - 1, 0))
        missing = np.bincount(np.repeat(np.arange(len(rule)), size), weights=held[place] != want if len(held) else None, minlength=len(rule))
        row, rule = row[missing == 0], rule[missing == 0]
        best = np.full(len(column), np.iinfo(np.int64).max)
        np.minimum.at(best, row, rule)
        out[best < np.iinfo(np.int64).max] = best[best < np.iinfo(np.int64).max]
        return out


def judged(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, limits: Limits = Limits(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined_rule, confidence) of every page; ``labelled``: (url, bad)."""
    found = mined(labelled, limits)
    index = RuleIndex(found)
    names = pa.array([" & ".join(items) for items, _, _ in found], pa.string())
    sure = pa.array([c for _, c, _ in found], pa.float64())
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = index.first(b.column("t"))
            at = pa.array(first, mask=first < 0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("path"), names.take(at), sure.take(at)], ["id", "host", "path", "mined_rule", "confidence"])

    told = rows.mapInArrow(look_up, f"id {kind}, host string, path string, mined_rule string, confidence double")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return told.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "mined_rule", "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose document has a label: the document's number ends the path; bad is low quality or
    toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    urls = pages.select("url").distinct().withColumn("doc_id", F.when(number != "", number.cast("long"))).filter("doc_id is not null")
    told = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    return urls.join(told, "doc_id").select("url", "bad")


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))
