"""The revisioned document store: append, change feed, migration, archive, history, conversations, audit (D1-D8, F2-F3, J6-J8, N-3, ST1, ST3, ST4, A1-A2).

A store is a folder with a commit log: documents, archive and relations are tables of immutable parts, and a revision is a
manifest of their parts. A writer that fails, or that another one overtakes, leaves parts that no manifest lists: they are never
read. The history and each conversation have logs of their own.
"""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog, RevisionConflict

DOCUMENT = "id string, text string, source string, sequence long, added_revision long"
RELATION = "subject string, predicate string, object string, source string"
HISTORY = "prompt string, result string, at string, session string, revision long"
#: Fixed values of the format: most turns and bytes of a view of a conversation's history.
MOST_TURNS, MOST_VIEW_BYTES = 100, 1_000_000


class SnapshotRequired(ValueError):
    """The reader's revision lies before the last reset: it must read a whole snapshot."""


def digest() -> Column:
    """What equal documents share: a digest of text and source, so that no text goes through a shuffle."""
    return F.sha2(F.concat(F.sha2("text", 256), F.sha2("source", 256)), 256)


class DocumentStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = CommitLog(spark, self.folder)
        self.asked = CommitLog(spark, f"{self.folder}/history-log")

    def revisions(self) -> list[int]:
        return self.log.revisions()

    def revision(self) -> int:
        return max(self.revisions(), default=0)

    def documents(self, revision: int | None = None) -> DataFrame:
        """the documents of a snapshot."""
        return self.log.read("documents", DOCUMENT, self.log.latest() if revision is None else self.log.at(revision))

    def append(self, batch: DataFrame, *, expected_revision: int | None = None) -> dict[str, int]:
        """Appends the new rows of (id, text, source); the revision rises only if there are any.

        Of equal texts and sources the first id stays. Ids that come with other content, in the batch or in the store, are an error.
        """
        base = self.log.latest()
        if expected_revision is not None and expected_revision != base.revision:
            raise RevisionConflict(f"revision {base.revision}, not {expected_revision}")
        rows = batch.select("id", "text", "source")
        bad, total = rows.agg(F.count_if(F.expr("id IS NULL OR trim(id) = '' OR text IS NULL OR source IS NULL")), F.count("*")).first()
        if bad:
            raise ValueError("documents need an id that isn't blank, a text and a source")
        known = self.log.read("documents", f"{DOCUMENT}, digest string", base).select("id", "digest", "sequence")
        keyed = rows.withColumn("digest", digest())
        content = keyed.select("id", "digest").unionByName(known.select("id", "digest").join(keyed.select("id").distinct(), "id", "left_semi"))
        if not content.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").isEmpty():
            raise RevisionConflict("an id comes with other content")
        first = keyed.groupBy("digest").agg(F.min("id").alias("id")).join(known.select("digest"), "digest", "left_anti")
        last = known.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
        # an id has one content, so the id alone tells its digest: texts are dealt by id once
        fresh = keyed.dropDuplicates(["id"]).join(first, "id", "left_semi")
        numbered = fresh.select("id", "text", "source", (F.monotonically_increasing_id() + 1 + last).alias("sequence"), F.lit(base.revision + 1).cast("long").alias("added_revision"), "digest")
        part = self.log.write(numbered, "documents")
        added = self.spark.read.parquet(self.log.path(part)).count()
        if not added:
            return {"revision": base.revision, "added": 0, "existing": total}
        self.log.commit(base, add={"documents": [part]})
        return {"revision": base.revision + 1, "added": added, "existing": total - added}

    def add_one(self, text: str, source: str = "user", document_id: str | None = None) -> str:
        """Appends one document; without an id it gets the first free ``doc-N`` from the count of documents on."""
        if not text.strip():
            raise ValueError("a document must contain text")
        held = self.documents()
        if document_id is None:
            n = held.count() + 1
            taken = held.select(F.regexp_extract("id", r"^doc-([1-9]\d{0,17})$", 1).alias("n")).where("n <> ''").select(F.col("n").cast("long").alias("n")).where(F.col("n") >= n).distinct()
            # the first number that is free: the asked one, or the least successor of a taken one that isn't taken itself
            ends = taken.select((F.col("n") + 1).alias("n")).unionByName(self.spark.range(n, n + 1).select(F.col("id").alias("n"))).join(taken, "n", "left_anti")
            document_id = f"doc-{ends.agg(F.min('n')).first()[0]}"
        elif not held.where(F.col("id") == document_id).isEmpty():
            raise ValueError("the id exists already")
        self.append(self.spark.createDataFrame([(document_id, text, source)], "id string, text string, source string"))
        return document_id

    def migrate(self, prior: Column) -> dict[str, int]:
        """D3: moves the documents for which ``prior`` holds to the archive and starts a new generation of the rest; readers
        before the returned revision must read a snapshot. Without such documents nothing changes."""
        base = self.log.latest()
        held = self.log.read("documents", f"{DOCUMENT}, digest string", base)
        goes = F.coalesce(prior, F.lit(False))
        n_moved, n_kept = held.agg(F.count_if(goes), F.count_if(~goes)).first()
        if not n_moved:
            return {"revision": base.revision, "archived": 0, "retained": n_kept, "changed": 0}
        old = self._archived(base).select("id", "digest")
        gone = self.log.write(held.where(goes).select("id", "text", "source", "digest").join(old, ["id", "digest"], "left_anti"), "archive")
        kept = self.log.write(held.where(~goes), "documents")
        done = self.log.commit(base, add={"archive": [gone]}, replace={"documents": [kept]}, reset=True)
        return {"revision": done.revision, "archived": n_moved, "retained": n_kept, "changed": 1}

    def _archived(self, commit) -> DataFrame:
        return self.log.read("archive", "id string, text string, source string, digest string", commit)

    def archived(self) -> DataFrame:
        """The archive's rows (id, text, source), in order of id."""
        return self._archived(self.log.latest()).select("id", "text", "source").orderBy("id", "text", "source")

    def record_query(self, prompt: str, result: str, *, session: str | None = None, revision: int | None = None) -> None:
        """Appends a prompt and its result (JSON) to the history. Writers that overtake each other try again: the order of
        the history is that of its commits."""
        if not prompt.strip():
            raise ValueError("a prompt must contain text")
        json.loads(result, parse_constant=_no_constant)
        row = self.spark.range(1).select(F.lit(prompt).alias("prompt"), F.lit(result).alias("result"), utc_stamp().alias("at"), F.lit(session).cast("string").alias("session"), F.lit(revision).cast("long").alias("revision"))
        part = self.asked.write(row, "history")
        retried(lambda: self.asked.commit(self.asked.latest(), add={"history": [part]}))

    def history(self) -> DataFrame:
        """All recorded prompts."""
        return self.asked.read("history", HISTORY)

    def relations(self) -> DataFrame:
        """The relations (subject, predicate, object, source), in order."""
        return self.log.read("relations", RELATION).orderBy("subject", "object", "source")

    def add_relations(self, triples: DataFrame, *, most_nodes: int | None = None) -> dict[str, int]:
        """N-3: appends the ``is_a`` triples that aren't held yet, as a revision of the store; others are an error. ``most_nodes``
        bounds the graph."""
        names = ["subject", "predicate", "object", "source"]
        bad = " OR ".join(f"{c} IS NULL OR trim({c}) = ''" for c in names)
        total, wrong = triples.agg(F.count("*"), F.count_if(F.expr(f"{bad} OR coalesce(predicate, '') <> 'is_a'"))).first()
        if wrong:
            raise ValueError("relations need predicate is_a, and a subject, an object and a source")
        base = self.log.latest()
        held = self.log.read("relations", RELATION, base)
        part = self.log.write(triples.select(*names).distinct().join(held, names, "left_anti"), "relations")
        fresh = self.spark.read.schema(RELATION).parquet(self.log.path(part))
        added = fresh.count()
        if not added:
            return {"revision": base.revision, "added": 0, "existing": total}
        both = held.unionByName(fresh)
        if most_nodes is not None and both.select("subject").union(both.select("object")).distinct().count() > most_nodes:
            raise ValueError(f"the graph may have {most_nodes} nodes")
        done = self.log.commit(base, add={"relations": [part]})
        return {"revision": done.revision, "added": added, "existing": total - added}

    def _session(self, session: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.folder}/conversations/{_safe(session)}")

    def conversation(self, session: str) -> tuple[int, str]:
        """ST4: the revision and state (JSON) of a session; 0 and {} if it is new."""
        now = self._session(session).latest()
        return now.revision, now.properties.get("state", "{}")

    def commit_conversation(self, session: str, expected: int, state: str, *, prompt: str | None = None, result: str = "{}") -> int:
        """ST4: compare and set. State, prompt and result of a turn are one manifest, whole when it appears; of several writers
        one makes the revision, the others get a conflict and try again from the latest state (see :meth:`turn`)."""
        for text in (state, result):
            json.loads(text, parse_constant=_no_constant)
        log = self._session(session)
        base = log.latest()
        if base.revision != expected:
            raise RevisionConflict(f"revision {base.revision}, not {expected}")
        at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        return log.commit(base, properties={"state": state, "prompt": prompt, "result": result, "at": at}).revision

    def turn(self, session: str, prompt: str, answer, *, attempts: int = 5) -> int:
        """ST4: a turn with retries: ``answer(prompt, state)`` gives (result, state) as JSON and is asked again from the latest
        state after each conflict."""

        def once() -> int:
            revision, state = self.conversation(session)
            result, state = answer(prompt, state)
            return self.commit_conversation(session, revision, state, prompt=prompt, result=result)

        return retried(once, attempts)

    def conversation_history(self, session: str, limit: int = MOST_TURNS) -> dict:
        """ST4: the newest turns of a session, oldest first; at most ``limit``, and as many as fit the view."""
        if not 1 <= limit <= MOST_TURNS:
            raise ValueError(f"limit must be between 1 and {MOST_TURNS}")
        log = self._session(session)
        revisions, turns, size = log.revisions(), [], 0
        for r in reversed(revisions[-limit:]):
            p = log.at(r).properties
            turn = {"revision": r, "prompt": p.get("prompt"), "result": p.get("result"), "at": p.get("at")}
            size += len(json.dumps(turn, ensure_ascii=False).encode())
            if size > MOST_VIEW_BYTES:
                break
            turns.insert(0, turn)
        return {"session": session, "revision": max(revisions, default=0), "turns": turns, "truncated": len(turns) < len(revisions)}

    def changes_since(self, revision: int, *, reset_revision: int = 0) -> tuple[int, DataFrame]:
        """F3, ST1: the current revision and the documents added after ``revision``, both of one snapshot. After a reset (the
        store's own, or a later one that the reader knows of), readers of earlier revisions must read a snapshot."""
        now = self.log.latest()
        if revision < 0:
            raise ValueError("a revision isn't negative")
        if revision < (reset := max(now.reset, reset_revision)):
            raise SnapshotRequired(f"read a snapshot at {reset} first")
        if revision > now.revision:
            raise RevisionConflict(f"revision {revision} is ahead of {now.revision}")
        return now.revision, self.log.read("documents", DOCUMENT, now).where(F.col("added_revision") > revision)

    def statistics(self) -> DataFrame:
        """A1, A2: documents, bytes of text and the lower bound of a dense form."""
        d = self.documents()
        return d.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.max("added_revision"), F.lit(0)).alias("revision"))

    def page(self, after: int = 0, limit: int = 50, *, before: int | None = None, expected_revision: int | None = None) -> DataFrame:
        """IO15: a page by sequence (keyset paging): the next rows after one, or the last rows before one; in order. With
        ``expected_revision`` a conflict if the store has moved on since the first page."""
        if not 1 <= limit <= 200:
            raise ValueError("limit must be between 1 and 200")
        now = self.log.latest()
        if expected_revision is not None and expected_revision != now.revision:
            raise RevisionConflict(f"revision {now.revision}, not {expected_revision}")
        held = self.log.read("documents", DOCUMENT, now)
        if before is not None:
            return held.where(F.col("sequence") < before).orderBy(F.desc("sequence")).limit(limit).orderBy("sequence")
        return held.where(F.col("sequence") > after).orderBy("sequence").limit(limit)


def retried(work, attempts: int = 20):
    """``work`` again after each conflict, at most ``attempts`` times in all."""
    for k in range(attempts):
        try:
            return work()
        except RevisionConflict:
            if k + 1 == attempts:
                raise
            time.sleep(0.01 * 2 ** min(k, 6))


def _safe(session: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", session):
        raise ValueError("a session id has up to 64 letters, digits, hyphens and underscores")
    return session


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def utc_stamp(at: Column | None = None) -> Column:
    """A time as text with milliseconds, in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is gone: what a delete must take along."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")


def unpaired_only(documents: DataFrame, *, prior_source: str) -> DataFrame:
    """The documents that an active corpus must not have: with a prompt, or from a source that begins with ``prior_source``."""
    paired = F.trim(F.coalesce("prompt", F.lit(""))) != "" if "prompt" in documents.columns else F.lit(False)
    return documents.where(paired | F.startswith("source", F.lit(prior_source)))


def append_split(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each incoming row marked ``existing`` or ``added`` by (text, source); of equal new rows the first is added."""
    known = existing.select(F.xxhash64("text", "source").alias("k"), F.lit(True).alias("known")).distinct()
    rows = incoming.withColumn("k", F.xxhash64("text", "source"))
    first = rows.groupBy("k").agg(F.min("doc_id").alias("first"))
    marked = rows.join(known, "k", "left").join(first, "k")
    return marked.select("doc_id", F.when(F.coalesce("known", F.lit(False)) | (F.col("doc_id") != F.col("first")), "existing").otherwise("added").alias("state"))


def replace_leads(documents: DataFrame, full: DataFrame, suffix: str = "-lead") -> DataFrame:
    """Full articles take the place of their leads."""
    gone = full.select(F.concat("id", F.lit(suffix)).alias("id")).unionByName(full.select("id"))
    return documents.join(gone.distinct(), "id", "left_anti").unionByName(full.select(*documents.columns))


def archive(documents: DataFrame, archived: DataFrame) -> DataFrame:
    """Rows that the archive doesn't have yet, by all their fields."""
    names = ["id", "prompt", "text", "source"]
    same = [documents[n].eqNullSafe(archived[n]) for n in names]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return documents.join(archived, cond, "left_anti").dropDuplicates(names)


def audit_passages(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose passages, put together in order, differ from their text."""
    joined = passages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage", "body"))), lambda s: s["body"]), "").alias("whole"))
    both = docs.join(joined, "doc_id", "full_outer")
    return both.where(~F.col("text").eqNullSafe(F.col("whole"))).select("doc_id")


def uncovered(exported: DataFrame, documents: DataFrame) -> DataFrame:
    """Exported rows that the store doesn't hold."""
    return exported.join(documents.select("id"), "id", "left_anti")
