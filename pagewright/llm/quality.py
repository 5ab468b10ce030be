"""Quality rules: base measures of each text, and cross-document line frequency per host (DataFrame functions alone).

The method. A line is normalised (lower case, runs of white space to one space, trimmed) and hashed (MD5). For each
host, the distinct documents that hold a line are counted, and a line held by more than
``max(min_docs, max_share * the host's distinct documents)`` is boilerplate and is removed. A document left with less
than ``min_left`` of its words is depleted and rejected. Copies must not condemn each other: documents with the same set
of normalised lines count once; documents that differ in a line, as those built on one template do, count one by one.

Scale. Each count is a partial aggregate, keyed by (host, line, hash of the document's lines), so that a line that a third of all
documents hold is spread over many keys. At most ``avg lines per document / max_share`` lines of a host pass its
limit; they meet the lines again in a join, which broadcasts them only where their count was found small.

Defined results. Null or empty text: no words, rejected by the base rule. Null host: a host of its own. Null or repeated
ids, and repeated rows: each row is judged by itself and comes out once. Lines without a word don't count. Very long texts:
arrays of their words and lines in one row. Ties: a line at its limit stays. Extra columns stay, whatever their names, but
for those that ``judged`` adds (its own win); ``cleaned`` returns every column as it came, but for the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed, renamed, table

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Production parameters.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCS, MAX_SHARE, MIN_LEFT = 5, 0.1, 0.3
#: Most frequent lines (about 50 bytes each) that a join broadcasts.
MAX_BROADCAST = 100_000
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _spaced(text: Column) -> Column:
    """The text with each white-space character as a space: plain replacements, which are quicker than patterns."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", text)


def words(text: Column) -> Column:
    return F.filter(F.split(_spaced(text), " "), lambda w: w != "")


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def lines_with_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), WORD_GAP, " "))


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, by the windows' hashes. These are sorted with their places,
    so equal ones are neighbours; texts whose windows are all distinct, the most, skip the sort."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        repeated = F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, F.element_at(F.transform(F.array(placed), covered), 1)).otherwise(0)  # binds the sorted array


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The base columns beside the given ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"__w": words(text), "__l": lines_with_word(text)})
    out = out.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), F.size("__h") - 3), lambda i: F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2)))
    out = out.withColumn("__g", F.when(F.size("__h") > 3, windows).otherwise(F.array().cast("array<bigint>")))
    found = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(_without(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__g")).cast("long").alias("n_repeat_words"),
    )
    # a generator: filters on the measures stay above it, instead of being worked out again inside lambdas
    names = [c for c in docs.columns if c not in MEASURES]
    out = out.select(*names, F.explode(F.array(found)).alias("__m")).select(*names, "__m.*")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("__id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("__text")]


def _host(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("-")).alias("__host")


def _line_hashes(text_col: str) -> Column:
    return F.transform(lines_with_word(F.coalesce(F.col(text_col), F.lit(""))), lambda x: F.md5(normal_line(x)))


def frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(__host, line): the boilerplate of each host. One pass over the lines: an entry without a line counts the host's documents."""
    docs = docs.select(_host(host_col), F.array_sort(F.array_distinct(_line_hashes(text_col))).alias("__h")).filter(F.size("__h") > 0)
    docs = docs.withColumn("__doc", F.md5(F.concat_ws("", "__h")))
    held = docs.select("__host", "__doc", F.explode(F.concat("__h", F.array(F.lit("")))).alias("line"))
    held = held.groupBy("__host", "line").agg(F.count_distinct("__doc").alias("__held"))
    held = checkpointed(held.filter((F.col("__held") > min_docs) | (F.col("line") == "")))
    hosts = held.filter(F.col("line") == "").select("__host", F.col("__held").alias("__docs"))
    limit = F.greatest(F.lit(float(min_docs)), max_share * F.col("__docs"))
    return held.filter(F.col("line") != "").join(hosts, "__host").filter(F.col("__held") > limit).select("__host", "line")


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Rows under names by place, with MEASURES, n_removed_words, removed_lines and kept."""
    frequent = frequent_lines(docs, text_col, host_col, min_docs, max_share)
    if frequent.count() <= MAX_BROADCAST:  # else by a shuffled join, whose skewed keys adaptive execution splits
        frequent = F.broadcast(frequent)
    raw = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    placed = docs.select(*_row_key(id_col, text_col), _host(host_col), F.posexplode(raw).alias("__at", "__line"))
    placed = placed.filter(F.col("__line").rlike(r"[^\x20\x09-\x0D]"))
    placed = placed.withColumn("line", F.md5(normal_line(F.col("__line"))))
    hits = placed.join(frequent, ["__host", "line"], "left_semi").withColumn("__n", F.size(words(F.col("__line"))))
    hits = hits.groupBy("__id", "__text", "__at").agg(F.max("__n").alias("__n"))  # repeated rows count once
    hits = hits.groupBy("__id", "__text").agg(F.sum("__n").alias("n_removed_words"), F.sort_array(F.collect_list("__at")).alias("removed_lines"))
    base = measures(docs, text_col)
    key_id, key_text = _row_key(id_col, text_col)
    out = base.withColumns({"__k": key_id, "__t": key_text}).join(hits.withColumnsRenamed({"__id": "__hid", "__text": "__ht"}), F.col("__k").eqNullSafe(F.col("__hid")) & (F.col("__t") == F.col("__ht")), "left").drop("__k", "__t", "__hid", "__ht")
    removed = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    left = F.col("n_words") - removed
    return out.withColumns({"n_removed_words": removed, "kept": ~F.col("base_failed") & (left >= min_left * F.col("n_words"))})


def _by_place(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    return renamed(docs), [f"u{docs.columns.index(n)}" for n in names]


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents with MEASURES, n_removed_words, removed_lines (numbers of the lines to remove, from 0) and kept.
    ``limits``: min_docs, max_share, min_left."""
    safe, names = _by_place(docs, id_col, text_col, host_col)
    own = [*MEASURES, "n_removed_words", "removed_lines", "kept"]
    given = [F.col(f"u{i}").alias(c) for i, c in enumerate(docs.columns) if c not in own]
    return _judged(safe, *names, **limits).select(*given, *own)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that pass, without their boilerplate lines, in the columns that came in."""
    safe, names = _by_place(docs, id_col, text_col, host_col)
    out = _judged(safe, *names, **limits).filter("kept")
    left = F.filter(F.split(F.col(names[1]), "\n"), lambda x, i: ~F.array_contains("removed_lines", i))
    text = F.when(F.col("removed_lines").isNull(), F.col(names[1])).otherwise(F.array_join(left, "\n"))
    return out.withColumn(names[1], text).select(*safe.columns).toDF(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", *MEASURES, "kept", "n_removed_words")


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, coalesce('=' || source, '-') as host from documents
), w as (
  select doc_id, text, host, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d
), grams as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3
), g as (
  select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from grams
), r as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from g) where n > 1
), rw as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from r) group by doc_id
), lines as (
  select doc_id, host, md5(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as line,
         len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) as n
  from (select doc_id, host, unnest(l) as x from w)
), ds as (
  select doc_id, host, md5(string_agg(distinct line, '' order by line)) as own from lines group by doc_id, host
), hosts as (
  select host, count(distinct own) as docs from ds group by host
), frequent as (
  select lines.host, line from lines join ds using (doc_id) join hosts on hosts.host = lines.host
  group by lines.host, line, docs having count(distinct own) > greatest(5.0::double, 0.1::double * docs)
), hit as (
  select doc_id, sum(n) as removed from lines join frequent using (host, line) group by doc_id
), b as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(removed, 0)::bigint as n_removed_words
  from w left join rw using (doc_id) left join hit using (doc_id)
), f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and (n_words - n_removed_words) >= 0.3::double * n_words as kept, n_removed_words from f
"""
