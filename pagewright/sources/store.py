"""The evaluation store: tables under a folder, changed by writing new folders and adding a numbered pointer.

Relational rules (unique names, cascades, upserts) are the pure functions; ``Store`` keeps the tables. The driver is the
only writer. A change writes new folders and then commits a pointer (``sources.pointers``). Appends add a folder to a table,
and merge folders by tiers, so that n appends leave about ``FAN * log(n)`` of them; other changes write the table anew.
Folders that no kept pointer names are deleted after a grace, so readers under way keep theirs. Ids count on and are never used again.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.numbering import places
from pagewright.sources.pointers import GRACE, KEPT, Pointers
from pagewright.sources.shared import stored

TABLES = {
    "questions": "id long, question string, category string, notes string, active boolean, created_at timestamp, updated_at timestamp",
    "relevant_pages": "question_id long, document_id string, source string, source_path string, page int, reference_text string",
    "evaluations": "id long, name string, status string, config string, dataset_hash string, question_count long, metrics string, error string, created_at timestamp, completed_at timestamp",
    "evaluation_results": "id long, evaluation_id long, question_id long, question string, expected string, matches string, variants string, metrics string, latency_ms double, error string",
    "query_variants": "question_sha256 string, prompt_version string, variants string, created_at timestamp",
    "sessions": "session_id string, created_at timestamp",
    "messages": "session_id string, seq long, role string, content string",
}
#: Folders of one tier that are merged into one of the next.
FAN = 16


def questions_with_pages(questions: DataFrame, relevant: DataFrame) -> DataFrame:
    """Questions with their pages (document_id, page, source, source_path, reference_text) as an ordered array; those
    without pages have an empty one."""
    rest = [F.col(c) for c in ("source", "source_path", "reference_text")]
    gathered = F.array_sort(F.collect_set(F.struct(T.strip("document_id").alias("document_id"), "page", *rest)))
    pages = relevant.groupBy(F.col("question_id").alias("id")).agg(gathered.alias("pages"))
    return questions.join(pages, "id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(pages.schema["pages"].dataType)))


def dataset_items(questions: DataFrame, relevant: DataFrame) -> DataFrame:
    """(id, item) of each active question: its canonical JSON, with sorted keys."""
    rows = questions_with_pages(questions.filter("active"), relevant)
    pages = F.array_join(F.transform("pages", lambda p: F.concat(F.lit('{"document_id": '), T.json_string(p["document_id"]), F.lit(', "page": '), p["page"].cast("string"), F.lit("}"))), ", ")
    item = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "question": '), T.json_string(F.col("question")), F.lit(', "relevant_pages": ['), pages, F.lit("]}"))
    return rows.select("id", item.alias("item"))


def dataset_hash(questions: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: the hash of the JSON list of the active questions in order of id. The list is one text in one task, as a
    hash of it must be; a dataset of questions is small."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "item")))
    told = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["item"]), ", "), F.lit("]"))
    return dataset_items(questions, relevant).agg(F.sha2(told, 256).alias("dataset_hash"))


def question_counts(questions: DataFrame) -> DataFrame:
    """One row: (questions, active)."""
    return questions.agg(F.count("*").alias("questions"), F.count_if("active").alias("active"))


def new_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """The names that aren't taken, ignoring case and outer blanks."""
    key = F.lower(T.strip("name")).alias("__key")
    return wanted.withColumn("__key", key).join(taken.select(key).distinct(), "__key", "left_anti").drop("__key")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """An upsert: of each key, the row that was written last."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("__n", last).filter("__n = 1").drop("__n")


def without(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """A delete that cascades: parents and children without the keys in ``gone``."""
    return parents.join(gone, key, "left_anti"), children.join(gone.withColumnRenamed(key, foreign), foreign, "left_anti")


#: The columns of a results file, in order.
CSV_COLUMNS = ["id_pregunta", "pregunta", "páginas_esperadas", "páginas_recuperadas", "posición_primer_relevante", "recall_1", "recall_k", "precisión_k", "mrr_k", "falsos_positivos", "fallo", "latencia_ms", "error"]


def csv_rows(results: DataFrame) -> DataFrame:
    """The rows of a results file, from (question_id, question, expected and retrieved: arrays of (source, page) in order,
    metrics: a struct, latency_ms, error)."""
    shown = lambda pages: F.array_join(F.transform(pages, lambda p: F.concat(p["source"], F.lit(" p."), p["page"].cast("string"))), "; ")
    m = [F.col(f"metrics.{c}") for c in ("first_relevant_rank", "recall_at_1", "recall_at_k", "precision_at_k", "mrr_at_k", "false_positives", "failure")]
    columns = [F.col("question_id"), F.col("question"), shown("expected"), shown("retrieved"), *m, F.col("latency_ms"), F.coalesce("error", F.lit(""))]
    return results.select(*[c.alias(name) for c, name in zip(columns, CSV_COLUMNS, strict=True)])


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, in order of the first column; the first field name of each file starts with a
    byte-order mark."""
    first, *rest = rows.columns
    rows.orderBy(first).withColumnRenamed(first, "\ufeff" + first).select("\ufeff" + first, *rest).write.mode("overwrite").option("header", True).csv(path)


def _json_list(column: str) -> Column:
    """An array of texts as JSON, with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(column, T.json_string), ", "), F.lit("]"))


Page = tuple  # document_id, page[, source, source_path, reference_text]


def validated(question: str, pages: list[Page]) -> tuple[str, list[Page]]:
    """The trimmed question and its pages, trimmed before they are made unique; the last of equal ones counts."""
    text, kept = question.strip(), {}
    for p in pages:
        document, number, *rest = p
        kept[document.strip(), number] = tuple(x.strip() for x in (*rest, "", "", "")[:3])
    if not text or not kept or any(not d or n < 1 for d, n in kept):
        raise ValueError("a question needs a text and pages with a document and a number from 1")
    return text, [(d, n, *rest) for (d, n), rest in kept.items()]


PAGES = "array<struct<document_id:string,page:int,source:string,source_path:string,reference_text:string>>"


def checked_questions(rows: DataFrame) -> DataFrame:
    """(question, category, notes, pages, valid) from (question, pages[, category, notes]): what ``validated`` makes of each
    row. A question is valid if it has a text and pages, and these a document and a number from 1."""
    have = set(rows.columns)
    plain = lambda name: T.strip(F.coalesce(F.col(name), F.lit(""))) if name in have else F.lit("")
    text = lambda p, name: T.strip(F.coalesce(p[name], F.lit("")))
    fields = ("source", "source_path", "reference_text")
    trimmed = F.transform(F.col("pages").cast(PAGES), lambda p: F.struct(text(p, "document_id").alias("document_id"), p["page"].alias("page"), *[text(p, f).alias(f) for f in fields]))
    key = lambda p: F.struct(p["document_id"].alias("d"), F.coalesce(p["page"], F.lit(0)).alias("n"))
    out = rows.select(plain("question").alias("question"), plain("category").alias("category"), plain("notes").alias("notes"), F.coalesce(trimmed, F.array().cast(PAGES)).alias("pages"))
    last = F.filter("pages", lambda p, i: ~F.exists(F.slice(F.col("pages"), i + 2, F.greatest(F.size("pages"), F.lit(1))), lambda q: key(q) == key(p)))
    fits = (F.col("question") != "") & (F.size("pages") > 0) & F.forall("pages", lambda p: (p["document_id"] != "") & (F.coalesce(p["page"], F.lit(0)) >= 1))
    return out.withColumn("pages", last).withColumn("valid", fits)


class Store:
    def __init__(self, spark: SparkSession, folder: str, grace: float = GRACE):
        self.spark, self.folder, self.grace = spark, folder.rstrip("/"), grace
        self._at = Pointers(spark, self.folder)
        self._at.fs.mkdirs(self._at.path())

    def _state(self) -> dict:
        return self._at.latest() or {"version": 0, "tables": {}, "next_id": 1}

    def _commit(self, state: dict) -> None:
        self._at.commit(state)
        if state["version"] % KEPT == 0:
            self.collect()

    def collect(self) -> list[str]:
        """Deletes folders that no kept pointer names."""
        return self._at.collect(lambda state: [x for folders in state["tables"].values() for x in folders], self.grace)

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.folder}/{x}" for x in folders])

    def table(self, name: str) -> DataFrame:
        at = self._state()["tables"].get(name, [])
        return self._read(name, at) if at else self.spark.createDataFrame([], TABLES[name])

    def list_tables(self) -> list[str]:
        return sorted(self._state()["tables"])

    def table_exists(self, name: str) -> bool:
        return name in self._state()["tables"]

    def _written(self, name: str, rows: DataFrame, tier: int = 0) -> str:
        at = f"{name}-{tier}-{uuid.uuid4().hex}"
        rows.select(*[f.split()[0] for f in TABLES[name].split(", ")]).write.parquet(f"{self.folder}/{at}")
        return at

    def _compacted(self, name: str, folders: list[str]) -> list[str]:
        """The folders, where ``FAN`` of one tier are merged into one of the next: a table of n appends has at most
        ``FAN`` folders a tier, and a row is written again once a tier."""
        tier = lambda x: int(x.split("-")[1]) if x.count("-") > 1 else 0
        for t in range(64):
            same = [x for x in folders if tier(x) == t]
            if len(same) >= FAN:
                merged = self._written(name, self._read(name, same).coalesce(max(1, len(same) // FAN)), t + 1)
                folders = [x for x in folders if x not in same] + [merged]
            elif all(tier(x) <= t for x in folders):
                break
        return folders

    def _change(self, replaced: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None, new_id: int | None = None) -> None:
        state = self._state()
        for name, rows in (replaced or {}).items():
            state["tables"][name] = [self._written(name, rows)]
        for name, rows in (added or {}).items():
            state["tables"][name] = self._compacted(name, [*state["tables"].get(name, []), self._written(name, rows)])
        if new_id is not None:
            state["next_id"] = new_id + 1
        self._commit(state)

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, TABLES[name])

    def save_question(self, question: str, pages: list[Page], question_id: int | None = None, active: bool = True, category: str = "", notes: str = "") -> int:
        """Pages: (document_id, page[, source, source_path, reference_text]). An update must name a question that exists,
        and replaces its pages."""
        text, kept = validated(question, pages)
        questions, now = self.table("questions"), dt.datetime.now(dt.timezone.utc)
        key = self._state()["next_id"] if question_id is None else question_id
        old = None if question_id is None else questions.filter(F.col("id") == key).first()
        if question_id is not None and old is None:
            raise KeyError(question_id)
        new = self._rows("questions", [(key, text, category.strip(), notes.strip(), active, old["created_at"] if old else now, now)])
        new_pages = self._rows("relevant_pages", [(key, d, source, path, n, reference) for d, n, source, path, reference in kept])
        if old is None:
            self._change(added={"questions": new, "relevant_pages": new_pages}, new_id=key)
        else:
            self._change({"questions": questions.filter(F.col("id") != key).unionByName(new), "relevant_pages": self.table("relevant_pages").filter(F.col("question_id") != key).unionByName(new_pages)})
        return key

    def import_questions(self, rows: DataFrame) -> int:
        """Adds all questions (question, pages: an array of (document_id, page, source, source_path, reference_text)[, category,
        notes]) in one change, under the next ids, and returns their number; nothing where one of them is not valid."""
        checked = stored(checked_questions(rows))
        if bad := checked.filter("not valid").limit(5).collect():
            raise ValueError(f"a question needs a text and pages with a document and a number from 1: {[r['question'] for r in bad]}")
        n, first = checked.count(), self._state()["next_id"]
        if n:
            now = F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp")
            new = stored(places(checked, "__place").withColumn("id", F.col("__place") + first))
            pages = new.select(F.col("id").alias("question_id"), F.inline("pages"))
            self._change(added={"questions": new.withColumns({"active": F.lit(True), "created_at": now, "updated_at": now}), "relevant_pages": pages}, new_id=first + n - 1)
        return n

    def delete_question(self, key: int) -> bool:
        """Whether there was one. Its pages go with it; results of past evaluations stay."""
        known = not self.table("questions").filter(F.col("id") == key).isEmpty()
        if known:
            gone = self.spark.createDataFrame([(key,)], "id long")
            questions, relevant = without(self.table("questions"), self.table("relevant_pages"), gone, "id", "question_id")
            self._change({"questions": questions, "relevant_pages": relevant})
        return known

    def questions(self) -> DataFrame:
        return questions_with_pages(self.table("questions"), self.table("relevant_pages")).orderBy("id")

    def question(self, key: int) -> dict:
        row = self.questions().filter(F.col("id") == key).first()
        if row is None:
            raise KeyError(key)
        return row.asDict(recursive=True)

    def start_evaluation(self, name: str, config: dict) -> int:
        if not name.strip():
            raise ValueError("an evaluation needs a name")
        if new_names(self.spark.createDataFrame([(name,)], "name string"), self.table("evaluations").select("name")).isEmpty():
            raise ValueError(f"an evaluation is called {name!r} already")
        questions = self.table("questions")
        digest = dataset_hash(questions, self.table("relevant_pages")).first()[0]
        count = question_counts(questions).first()["active"]
        key = self._state()["next_id"]
        row = self._rows("evaluations", [(key, name.strip(), "running", json.dumps(config, sort_keys=True), digest, count, None, None, dt.datetime.now(dt.timezone.utc), None)])
        self._change(added={"evaluations": row}, new_id=key)
        return key

    def add_results(self, rows: DataFrame) -> None:
        self._change(added={"evaluation_results": rows})

    def end_evaluation(self, key: int, metrics: dict | None = None, error: str | None = None) -> None:
        """Completed with metrics, or failed with an error."""
        mine, text = F.col("id") == key, json.dumps(metrics, sort_keys=True) if metrics else None
        done = self.table("evaluations").withColumns({
            "status": F.when(mine, F.lit("failed" if error else "completed")).otherwise(F.col("status")),
            "metrics": F.when(mine, F.lit(text)).otherwise(F.col("metrics")),
            "error": F.when(mine, F.lit(error)).otherwise(F.col("error")),
            "completed_at": F.when(mine, F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp")).otherwise(F.col("completed_at")),
        })
        self._change({"evaluations": done})

    def delete_evaluation(self, key: int) -> bool:
        """Whether there was one; its results go with it."""
        known = not self.table("evaluations").filter(F.col("id") == key).isEmpty()
        if known:
            gone = self.spark.createDataFrame([(key,)], "id long")
            evaluations, results = without(self.table("evaluations"), self.table("evaluation_results"), gone, "id", "evaluation_id")
            self._change({"evaluations": evaluations, "evaluation_results": results})
        return known

    def evaluations(self) -> DataFrame:
        return self.table("evaluations").orderBy(F.desc("id"))

    def results(self, key: int) -> DataFrame:
        return self.table("evaluation_results").filter(F.col("evaluation_id") == key).orderBy("id")

    def evaluation(self, key: int) -> dict:
        """One evaluation with its results, JSON decoded."""
        row = self.table("evaluations").filter(F.col("id") == key).first()
        if row is None:
            raise KeyError(key)
        told = lambda r, names: {k: json.loads(v) if k in names and v else ({} if k in names else v) for k, v in r.asDict().items()}
        return told(row, ("config", "metrics")) | {"results": [told(r, ("expected", "matches", "variants", "metrics")) for r in self.results(key).collect()]}

    def save_variants(self, question: str, prompt_version: str, variants: list[str]) -> None:
        self.save_many_variants({question: variants}, prompt_version)

    def save_many_variants(self, found: dict[str, list[str]], prompt_version: str) -> None:
        """One upsert for all questions."""
        self.add_variants(self.spark.createDataFrame(list(found.items()), "question string, found array<string>"), prompt_version)

    def add_variants(self, found: DataFrame, prompt_version: str) -> None:
        """One upsert of (question, found: the variants); of questions that are equal when trimmed, one row counts."""
        hashed = found.select(T.question_hash("question").alias("question_sha256"), F.lit(prompt_version).alias("prompt_version"), _json_list("found").alias("variants"), F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp").alias("created_at"))
        new = hashed.dropDuplicates(["question_sha256"])
        self._change({"query_variants": latest(self.table("query_variants").unionByName(new), ["question_sha256", "prompt_version"], "created_at")})

    def known_variants(self, questions: DataFrame, prompt_version: str) -> DataFrame:
        """The questions with ``variants`` (JSON), null where none are kept."""
        kept = self.table("query_variants").filter(F.col("prompt_version") == prompt_version).select("question_sha256", "variants")
        return questions.withColumn("question_sha256", T.question_hash("question")).join(kept, "question_sha256", "left").drop("question_sha256")

    def variants(self, question: str, prompt_version: str) -> list[str] | None:
        found = self.known_variants(self.spark.createDataFrame([(question,)], "question string"), prompt_version).first()
        return json.loads(found["variants"]) if found["variants"] is not None else None

    def create_session(self) -> str:
        key = uuid.uuid4().hex
        self._change(added={"sessions": self._rows("sessions", [(key, dt.datetime.now(dt.timezone.utc))])})
        return key

    def resolve_session(self, session: str | None) -> str:
        """The session, or a new one where none is named; an unknown one is an error."""
        if session is None:
            return self.create_session()
        if self.table("sessions").filter(F.col("session_id") == session).isEmpty():
            raise KeyError(session)
        return session

    def append_messages(self, session: str, messages: list[tuple[str, str]]) -> None:
        """To a session, which is made if there is none."""
        if not messages:
            return
        n = self.table("messages").filter(F.col("session_id") == session).count()
        added = {"messages": self._rows("messages", [(session, n + i, r, c) for i, (r, c) in enumerate(messages)])}
        if self.table("sessions").filter(F.col("session_id") == session).isEmpty():
            added["sessions"] = self._rows("sessions", [(session, dt.datetime.now(dt.timezone.utc))])
        self._change(added=added)

    def messages(self, session: str) -> DataFrame:
        return self.table("messages").filter(F.col("session_id") == session).orderBy("seq")

    def delete_session(self, session: str) -> bool:
        """Whether there was one; its messages go with it."""
        known = not self.table("sessions").filter(F.col("session_id") == session).isEmpty()
        if known:
            self._change({"sessions": self.table("sessions").filter(F.col("session_id") != session), "messages": self.table("messages").filter(F.col("session_id") != session)})
        return known
