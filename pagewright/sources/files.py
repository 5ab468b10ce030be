"""Document folders, the index tables, and the page cache."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.sources.pointers import GRACE, Pointers

SCHEMA_VERSION = 3
PROVENANCE = ("document_id", "source_path", "source_sha256", "parser_model", "prompt_version", "schema_version")


#: Fixed value: what is read as a document.
SUFFIXES = ("pdf", "md")


def _named(files: DataFrame, folder: str) -> DataFrame:
    """With relative path, name, tag (first folder, or none) and extension."""
    root = folder.rstrip("/").split("://")[-1]
    relative = F.regexp_replace("path", "^.*?" + re.escape(root) + "/", "")
    parts = F.split(relative, "/")
    return files.withColumns({"relative_path": relative, "name": F.element_at(parts, -1), "tag": F.when(F.size(parts) > 1, parts[0]).otherwise(""), "extension": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))})


def _files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Files below the folder, which must exist; of the suffixes alone, in any case, so that no other is opened."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffixes:
        any_case = lambda x: "".join(f"[{c.lower()}{c.upper()}]" for c in x)
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(map(any_case, suffixes)) + "}")
    return reader.load(folder)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of every file below the folder, without reading contents: relative path, tag (first folder), extension, a
    quoted URL path and the time as ISO text."""
    files = _named(_files(spark, folder).select("path", "length", F.col("modificationTime").alias("modified")), folder)
    url = F.array_join(F.transform(F.split("relative_path", "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")
    return files.withColumns({"url": F.concat(F.lit("/files/"), url), "modified_iso": iso(F.col("modified"))})


def iso(time: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def as_markdown(files: DataFrame) -> DataFrame:
    """Documents with pages of Markdown files: read as UTF-8, line ends normalised, hashed by their bytes."""
    body = F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n")
    return files.select("path", T.document_id("path").alias("document_id"), F.sha2("content", 256).alias("source_sha256"), T.pages_of(body).alias("pages"), F.lit("direct-markdown").alias("parser_model"), F.lit("none").alias("prompt_version"), "tag", "name", "relative_path")


def load_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """The Markdown files below the folder as documents."""
    return as_markdown(_named(_files(spark, folder, ("md",)), folder))


def load_directory(spark: SparkSession, folder: str, parse_pdf: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All documents below the folder, by path: Markdown as it is, and PDF by ``parse_pdf``, which gets (path, content, tag,
    name, relative_path, document_id, source_sha256) and returns the columns that Markdown has."""
    files = _named(_files(spark, folder, SUFFIXES), folder)
    out = as_markdown(files.filter("extension = 'md'"))
    if parse_pdf is not None:
        pdf = files.filter("extension = 'pdf'").select("path", "content", "tag", "name", "relative_path", T.document_id("path").alias("document_id"), F.sha2("content", 256).alias("source_sha256"))
        out = out.unionByName(parse_pdf(pdf).select(*out.columns))
    return out.orderBy("path")


def totals(documents: DataFrame) -> DataFrame:
    """One row: (documents, pages)."""
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("pages")), F.lit(0)).alias("pages"))


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """The index tables below a folder, sorted."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()) if fs.exists(path) else []


def table_exists(spark: SparkSession, folder: str, name: str) -> bool:
    return name in list_tables(spark, folder)


def model_files(spark: SparkSession, folder: str, patterns: dict[str, str]) -> dict[str, str | None]:
    """Of each named pattern, the first file below the folder, by path, that is a model: 16 bytes at least, the first four
    being ``GGUF``; None where there is none. Only heads are read."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def is_model(status) -> bool:
        if not status.isFile() or status.getLen() < 16:
            return False
        stream = fs.open(status.getPath())
        try:
            return bytes(stream.read() for _ in range(4)) == b"GGUF"
        finally:
            stream.close()

    out: dict[str, str | None] = {}
    for name, pattern in patterns.items():
        found = sorted(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")) or [], key=lambda x: x.getPath().toString())
        out[name] = next((x.getPath().toString() for x in found if is_model(x)), None)
    return out


def safe_relative(path: str) -> str:
    """A relative path of an upload, checked: not absolute, no way up, a suffix that is read."""
    parts = path.replace("\\", "/").strip().split("/")
    if not parts[-1] or any(p in ("", ".", "..") for p in parts) or ":" in parts[0] or parts[-1].rsplit(".", 1)[-1].lower() not in SUFFIXES:
        raise ValueError(f"not a path of a document below the folder: {path!r}")
    return "/".join(parts)


def upload(spark: SparkSession, source: str, folder: str, relative: str, tag: str = "", overwrite: bool = False) -> str:
    """Copies a file to its place below the folder, and returns that; one that exists is an error unless ``overwrite``. The
    copy is streamed by the file systems to a hidden name, and then renamed, so readers see the old file or the whole new one;
    of two uploads that race for a new name, one gets the error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = "/".join(x for x in (safe_tag(tag), safe_relative(relative)) if x)
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    at, read = path(f"{folder.rstrip('/')}/{place}"), path(source)
    fs, from_fs = at.getFileSystem(conf), read.getFileSystem(conf)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(place)
    fs.mkdirs(at.getParent())
    hidden = path(f"{at.getParent()}/.{at.getName()}.{uuid.uuid4().hex}")
    try:
        jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, read, fs, hidden, False, True, conf)
        if overwrite:
            old = path(f"{at.getParent()}/.{at.getName()}.old-{uuid.uuid4().hex}")
            had = fs.exists(at) and fs.rename(at, old)
            if not fs.rename(hidden, at):
                if had:
                    fs.rename(old, at)
                raise OSError(f"{place} could not be replaced")
            if had:
                fs.delete(old, False)
        elif fs.exists(at) or not fs.rename(hidden, at):
            raise FileExistsError(place)
    finally:
        fs.delete(hidden, False)
    return place


def safe_tag(tag: str | None) -> str:
    """A tag is one folder name or nothing."""
    tag = (tag or "").strip()
    if "/" in tag or "\\" in tag or tag in (".", ".."):
        raise ValueError(f"not a tag: {tag!r}")
    return tag


def rendered(files: DataFrame, render: Callable[[bytes], list[tuple[int, bytes, str]]]) -> DataFrame:
    """Pages (page_number, image, reference) of binary files (document_id, content), by an injected renderer."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for key, content in zip(b.column("document_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = render(content)
                if rows:
                    n, image, text = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(n)), pa.array(n, pa.int32()), pa.array(image, pa.binary()), pa.array(text)], ["document_id", "page_number", "image", "reference"])

    return files.select("document_id", "content").mapInArrow(run, "document_id string, page_number int, image binary, reference string")


#: The columns that chunks of an index are clustered by, as far as they have them.
CLUSTERED = ("tag", "document_id", "page_start", "chunk_index")


def _plain(name: str) -> Column:
    return T.strip(F.coalesce(F.col(name).cast("string"), F.lit("")))


def write_index(chunks: DataFrame, folder: str, grace: float = GRACE) -> bool:
    """Replaces the index; an empty one leaves the old in place. False if so. Chunks are written in the order of tag and
    document, into a folder of their own, with a row for each file: the least and the greatest tag and document in it. A
    pointer then names the folder (``sources.pointers``), so there is no moment without an index."""
    spark, at = chunks.sparkSession, Pointers(chunks.sparkSession, folder)
    name = f"v-{uuid.uuid4().hex}"
    order = [c for c in CLUSTERED if c in chunks.columns]
    chunks.withColumn("schema_version", F.lit(SCHEMA_VERSION)).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{at.folder}/{name}/chunks")
    rows = spark.read.parquet(f"{at.folder}/{name}/chunks")
    if rows.isEmpty():
        at.fs.delete(at.path(name), True)
        return False
    ends = [f(_plain(c)).alias(f"{c}_{e}") for c in ("tag", "document_id") if c in rows.columns for f, e in ((F.min, "least"), (F.max, "most"))]
    rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(*ends, F.count("*").alias("n")).write.parquet(f"{at.folder}/{name}/files")
    at.commit({"version": (at.latest() or {"version": 0})["version"], "at": name, "schema_version": SCHEMA_VERSION, "columns": rows.columns})
    at.collect(lambda state: [state["at"]], grace)
    return True


def read_index(spark: SparkSession, folder: str, vectors: bool = False, tag: str = "", document_id: str = "") -> DataFrame:
    """The chunks, of one tag or document where given, after a check of their columns and version. Only the files that may
    hold the tag and the document are opened, and of these the row groups."""
    state = Pointers(spark, folder).latest()
    rows = spark.read.parquet(folder if state is None else f"{folder.rstrip('/')}/{state['at']}/chunks")
    missing = set(PROVENANCE) - set(rows.columns)
    stale = state["schema_version"] != SCHEMA_VERSION if state else not missing and not rows.filter(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION)).isEmpty()
    if missing or stale:
        raise RuntimeError(f"the index has another schema (missing: {sorted(missing)}); index the documents again")
    wanted = [(c, v.strip()) for c, v in (("tag", tag), ("document_id", document_id)) if v.strip()]
    if wanted and state:
        files = spark.read.parquet(f"{folder.rstrip('/')}/{state['at']}/files")
        for c, v in wanted:
            files = files.filter((F.col(f"{c}_least") <= v) & (F.col(f"{c}_most") >= v))
        paths = sorted(r["path"] for r in files.select("path").collect())  # as many as files hold the tag
        rows = spark.read.schema(rows.schema).parquet(*paths) if paths else spark.createDataFrame([], rows.schema)
    for c, v in wanted:
        rows = rows.filter(_plain(c) == v)
    return rows if vectors else rows.drop("vector")


CACHE_KEY = ["source_sha256", "parser_model", "prompt_version", "context_pages", "page_number"]


def write_cache(pages: DataFrame, folder: str) -> None:
    """Appends extracted pages, one row each under ``CACHE_KEY``, with the time; a later row replaces an earlier one."""
    pages.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(folder)


def read_cache(spark: SparkSession, folder: str) -> DataFrame | None:
    """The cached pages, the last written of each key; None where nothing has been written."""
    if not exists(spark, folder):
        return None
    last = F.row_number().over(Window.partitionBy(*CACHE_KEY).orderBy(F.desc("written_at")))
    return spark.read.parquet(folder).withColumn("__n", last).filter("__n = 1").drop("__n", "written_at")


def manifests(cache: DataFrame) -> DataFrame:
    """An entry for each source, model, prompt version and context size: page numbers in order, failed pages with their
    reasons, the total, and whether all are there."""
    pages = F.array_sort(F.collect_list(F.struct("page_number", "status", "issue")))
    told = cache.groupBy(*CACHE_KEY[:-1]).agg(pages.alias("__p"), F.max("total_pages").alias("total_pages"))
    failed = F.map_from_entries(F.transform(F.filter("__p", lambda p: p["status"] != "ok"), lambda p: F.struct(p["page_number"], p["issue"])))
    return told.select(*CACHE_KEY[:-1], F.transform("__p", lambda p: p["page_number"]).alias("page_numbers"), failed.alias("failed_pages"), "total_pages", (F.size("__p") == F.col("total_pages")).alias("complete"))


def ndjson(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Each event as a line of JSON, in order."""
    return events.orderBy(seq).select(F.to_json(F.struct(*[c for c in events.columns if c != seq])).alias("value"))
