"""Text functions, all JVM-side. Python's Unicode classes are written out, because Java's ``\\w``, ``\\s`` and ``trim`` differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that define tokens, white space, lines, page markers and source ids, and the answer without sources.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
PAGE_MARK = r"(?md)^<!--\s*PAGE\s+(\d+)\s*-->\s*$"
SOURCE_ID = r"\bS\d+\b"
REFUSAL = "No consta en los documentos recuperados."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def token_count(c: Column | str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(TOKEN), F.lit(0)))


def bm25_terms(c: Column | str) -> Column:
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def run_starts(ordered: str) -> Column:
    """The places in a sorted array column where another value begins."""
    t = F.col(ordered)
    new = lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0))), new)
    return F.when(F.size(t) > 0, places).otherwise(F.array().cast("array<int>"))


def coverage_tokens(c: Column | str) -> Column:
    return F.filter(bm25_terms(c), lambda t: F.length(t) >= 3)


def shorten(c: Column | str, limit: int, trim_cut: bool = False) -> Column:
    """Collapsed text of at most ``limit`` characters and three dots; ``trim_cut`` drops blanks before the dots."""
    flat = collapse(F.coalesce(_col(c), F.lit("")))
    cut = F.substring(flat, 1, limit)
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(cut) if trim_cut else cut, F.lit("..."))).otherwise(flat)


def lines(c: Column | str) -> Column:
    """Lines as Python's ``splitlines`` gives them."""
    parts = F.split(_col(c), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def completeness_issue(c: Column | str) -> Column:
    """Whether code fences or bold marks are left open."""
    fences = F.size(F.regexp_extract_all(_col(c), F.lit(r"(?<!\\)```"), F.lit(0)))
    bold = F.size(F.regexp_extract_all(_col(c), F.lit(r"(?<!\\)\*\*"), F.lit(0)))
    return (fences % 2 == 1) | (bold % 2 == 1)


def pages_of(markdown: Column | str) -> Column:
    """Array of (page_number, markdown): parts after page markers, or one page 1 where there is none and text is."""
    text = F.coalesce(_col(markdown), F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1))
    bodies = F.split(text, PAGE_MARK)
    marked = F.transform(numbers, lambda n, i: F.struct(n.cast("int").alias("page_number"), strip(F.get(bodies, i + 1)).alias("markdown")))
    whole = F.array(F.struct(F.lit(1).alias("page_number"), strip(text).alias("markdown")))
    none = F.array().cast("array<struct<page_number:int,markdown:string>>")
    return F.when(F.size(numbers) > 0, marked).when(strip(text) != "", whole).otherwise(none)


def markdown_of(pages: Column | str) -> Column:
    """The inverse: sections under page markers, parted by blank lines, with a final line end."""
    parts = F.transform(_col(pages), lambda p: F.concat(F.lit("<!-- PAGE "), p["page_number"].cast("string"), F.lit(" -->\n\n"), strip(p["markdown"])))
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))


def document_id(path: Column | str) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(_col(path), "/"), -1), r"\.[^.]*$", "")
    return F.concat(stem, F.lit("-"), F.substring(F.sha2(F.lower(_col(path)), 256), 1, 12))


def question_hash(question: Column | str) -> Column:
    return F.sha2(strip(question), 256)


def _listed(text: Column, key: str, pattern: str) -> Column:
    """The JSON list of strings that a text is, or holds under a key: the whole text, or else its part in brackets."""
    kind = "array<string>"
    part = F.regexp_extract(text, pattern, 0)
    found = [F.from_json(F.get_json_object(x, f"$.{key}"), kind) if whole else F.when(x.startswith("["), F.from_json(x, kind)) for x in (text, part) for whole in (True, False)]
    return F.coalesce(*found)


def source_ids(answer: Column | str) -> Column:
    """Cited ids in order: those of a JSON list (even an empty one), trimmed and not blank, else what looks like an id, once each."""
    text = strip(answer)
    listed = F.filter(F.transform(_listed(text, "used_source_ids", r"(?s)\{.*\}"), strip), lambda x: x != "")
    return F.coalesce(listed, F.array_distinct(F.regexp_extract_all(text, F.lit(SOURCE_ID), F.lit(0))))


def used_ids(answer: Column | str, allowed: Column | str) -> Column:
    return F.array_distinct(F.array_intersect(source_ids(answer), _col(allowed)))


def folded(c: Column | str) -> Column:
    """Case folded: lower of upper case, so that ``ß`` is ``ss`` as its upper case is; the dotless i, which folds to itself, stays.
    What stands between the two keeps the optimizer from taking them for a lower case alone."""
    return F.lower(F.replace(F.upper(F.replace(_col(c), F.lit("ı"), F.lit("\ue000"))), F.lit("\ue000"), F.lit("ı")))


def query_variants(answer: Column | str, question: Column | str, limit: int = 2) -> Column:
    """Rewritten questions from a model's answer: a JSON list's or else lines without bullets and quotes, white space
    collapsed, without the question, unique by case."""
    text = strip(answer)
    listed = _listed(text, "queries", r"(?s)(?:\{.*\}|\[.*\])")
    bullets = F.transform(lines(text), lambda x: F.regexp_replace(F.regexp_replace(x, rf"^{SPACE}*(?:[-*]|\d+[.)]){SPACE}*", ""), "^[ \t\"']+|[ \t\"']+$", ""))
    found = F.transform(F.when(F.size(F.coalesce(listed, F.array())) > 0, listed).otherwise(bullets), collapse)
    found = F.filter(found, lambda x: (x != "") & (folded(x) != folded(strip(question))))
    cases = F.transform(found, folded)
    return F.slice(F.filter(found, lambda x, i: F.array_position(cases, folded(x)) == i + 1), 1, limit)


def response_markdown(raw: Column | str) -> Column:
    """The markdown in the outermost braces of a model's response; null unless it is a string that isn't blank."""
    body = F.regexp_extract(_col(raw), r"(?s)\{.*\}", 0)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.markdown", "variant"))
    text = strip(F.replace(F.get_json_object(body, "$.markdown"), F.lit("&quot;"), F.lit('"')))
    return F.when((kind == "STRING") & (text != ""), text)


def truncated(c: Column | str, limit: int = 2500) -> Column:
    text = strip(F.coalesce(_col(c), F.lit("")))
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.substring(text, 1, limit), f"{SPACE}+$", ""), F.lit("..."))).otherwise(text)


def vector_score(distance: Column | str) -> Column:
    """Of a missing distance 0 (the greatest of null and 0 would be 0, and the score 1)."""
    return F.when(_col(distance).isNotNull(), 1 / (1 + F.greatest(_col(distance), F.lit(0.0)))).otherwise(F.lit(0.0))


def instructed(query: Column | str, instruction: str | None) -> Column:
    if not instruction or not instruction.strip():
        return _col(query)
    return F.concat(F.lit(f"Instruct: {instruction.strip()}\nQuery: "), _col(query))


def is_contextual(query: Column | str) -> Column:
    return F.contains(_col(query), F.lit("Previous user question:")) | F.contains(_col(query), F.lit("Latest follow-up question:"))


def contextual(previous: Column | str, latest: Column | str) -> Column:
    return F.concat(F.lit("Previous user question: "), _col(previous), F.lit("\nLatest follow-up question: "), _col(latest))


def grounded(answer: Column | str, citations: Column | str) -> Column:
    """The trimmed answer if there is one and it cites something, else the refusal."""
    return F.when((strip(F.coalesce(_col(answer), F.lit(""))) != "") & (F.size(_col(citations)) > 0), strip(answer)).otherwise(F.lit(REFUSAL))


def tag_filter(tag: Column | str, tags: Column | str) -> Column:
    """The tag, else the first of the tags that isn't blank."""
    blank = lambda x: F.nullif(strip(x), F.lit(""))
    return F.coalesce(blank(_col(tag)), F.get(F.filter(F.transform(F.coalesce(_col(tags), F.array()), strip), lambda x: x != ""), 0))


def context_block(source_id: Column, source: Column | str, page: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("["), source_id, F.lit("] "), _col(source), F.lit(" p."), _col(page).cast("string"), F.lit("\n"), _col(text))


def json_string(text: Column) -> Column:
    """A JSON string: characters stand for themselves, but for quotes, backslashes and those below U+0020."""
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    rare = out
    for i in range(32):
        if chr(i) not in "\n\r\t\b\f":
            rare = F.replace(rare, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))
