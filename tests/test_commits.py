"""The commit log, the store and the index: what a failure leaves behind is neither lost nor doubled."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import index as I
from lexstrata.operators import store as S
from lexstrata.sources import commits as C
from lexstrata.sources.shared import fresh_path

ROWS = "id string, text string, source string"


class Stopped(RuntimeError):
    pass


def stop_after(monkeypatch, n):
    """Every write of a part, and every publication, is counted; the one after ``n`` is stopped before it begins."""
    done = []
    for name in ("write", "_publish"):
        real = getattr(C.CommitLog, name)

        def guarded(self, *args, real=real, **kw):
            if len(done) == n:
                raise Stopped
            done.append(1)
            return real(self, *args, **kw)

        monkeypatch.setattr(C.CommitLog, name, guarded)


def test_commits_are_numbered_and_exclusive(spark, tmp_path):
    log = C.CommitLog(spark, f"file://{tmp_path}/log")
    base = log.latest()
    assert (base.revision, log.read("t", "n long").count()) == (0, 0)
    parts = [log.write(spark.range(k).select(F.col("id").alias("n")), "t") for k in (2, 3)]
    assert log.read("t", "n long").count() == 0  # not committed
    one = log.commit(base, add={"t": parts[:1]}, properties={"é": 1})
    with pytest.raises(C.RevisionConflict):
        log.commit(base, add={"t": parts[1:]})
    assert log.latest() == one == log.at(1) and log.read("t", "n long").count() == 2
    two = log.commit(one, add={"t": parts[1:]})
    three = log.commit(two, replace={"t": parts[1:]}, reset=True)
    assert [log.read("t", "n long", c).count() for c in (one, two, three)] == [2, 5, 3] and (two.reset, three.reset) == (0, 3)
    with pytest.raises(C.RevisionConflict):
        log.at(9)
    gone = log.clear()
    assert parts[0] in gone and log.revisions() == [3] and log.read("t", "n long").count() == 3


@pytest.mark.parametrize("n", range(3))
def test_stopped_migration_loses_nothing(spark, monkeypatch, n):
    held = S.DocumentStore(spark, fresh_path(spark, "store"))
    held.append(spark.createDataFrame([("a", "t1", "user"), ("b", "t2", "prior"), ("c", "t3", "prior")], ROWS))
    with monkeypatch.context() as m:
        stop_after(m, n)
        with pytest.raises(Stopped):
            held.migrate(F.col("source") == "prior")
    again = S.DocumentStore(spark, held.folder)
    assert (again.revision(), again.documents().count(), again.archived().count()) == (1, 3, 0)
    assert again.migrate(F.col("source") == "prior") == {"revision": 2, "archived": 2, "retained": 1, "changed": 1}
    assert [r["id"] for r in again.archived().collect()] == ["b", "c"] and [r["id"] for r in again.documents().collect()] == ["a"]
    assert again.documents(1).count() == 3  # an older snapshot stays
    with pytest.raises(S.SnapshotRequired):
        again.changes_since(1)
    now, rows = again.changes_since(2)
    assert now == 2 and rows.count() == 0
    again.append(spark.createDataFrame([("d", "t4", "user")], ROWS))
    assert [r["id"] for r in again.changes_since(2)[1].collect()] == ["d"]


@pytest.mark.parametrize("n", range(2))
def test_stopped_append_is_not_read(spark, monkeypatch, n):
    held = S.DocumentStore(spark, fresh_path(spark, "store"))
    rows = spark.createDataFrame([("a", "t1", "user"), ("b", "t1", "user")], ROWS)
    with monkeypatch.context() as m:
        stop_after(m, n)
        with pytest.raises(Stopped):
            held.append(rows)
    assert held.revision() == 0 and held.documents().count() == 0
    assert held.append(rows) == {"revision": 1, "added": 1, "existing": 1}
    assert [tuple(r) for r in held.documents().select("id", "sequence").collect()] == [("a", held.documents().first()["sequence"])]


DOCS = [(1, "alpha baum\nhaus"), (2, "baum see")]
MORE = [(3, "alpha alpha wald")]


@pytest.mark.parametrize("n", [1, 3, 5])
def test_failed_batch_of_the_index(spark, monkeypatch, n):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = I.TextIndex.build(frame(DOCS))
    with monkeypatch.context() as m:
        stop_after(m, n)
        with pytest.raises(Stopped):
            index.append(frame(DOCS + MORE))
    for i in (index, I.TextIndex(spark, index.folder)):
        assert [tuple(r) for r in i.frequencies(["alpha"]).collect()] == [("alpha", 1)] and i.texts() == 2
    index.append(frame(DOCS + MORE))
    assert [tuple(r) for r in index.frequencies(["alpha"]).collect()] == [("alpha", 2)] and index.texts() == 3
    assert sorted(map(tuple, index.postings(["alpha"]).collect())) == [("alpha", 1, 1), ("alpha", 3, 2)]
    assert sorted(map(tuple, index.terms_of(3).collect())) == [("alpha", 2), ("wald", 1)]


def test_replaced_files_are_indexed_anew(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(path)
    write(DOCS)
    name = [f for f in __import__("os").listdir(path) if f.startswith("part-")][0]
    first = I.index_of(spark.read.parquet(path))
    assert first.texts() == 2 and I.index_of(spark.read.parquet(path)) is first
    write(DOCS + MORE)  # the same name, other rows
    new = [f for f in __import__("os").listdir(path) if f.startswith("part-")][0]
    __import__("os").rename(f"{path}/{new}", f"{path}/{name}")
    spark.catalog.refreshByPath(path)
    assert I.index_of(spark.read.parquet(path)).texts() == 3


def test_short_items_are_found(spark):
    docs = spark.createDataFrame([(1, "Die Eisenbahn, fährt!"), (2, "ein Bahnhof"), (3, "zu %% viel"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "bahn"), (2, "Bahn"), (3, "%%"), (4, "u %"), (5, "bahn, f"), (6, "nie"), (7, "e")], "item_id long, text string")
    got = sorted(map(tuple, I.TextIndex.build(docs).holders_of(items, docs).collect()))
    want = sorted((d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if d["text"] and i["text"] in d["text"])
    assert got == want


def test_conversations_and_history(spark):
    held = S.DocumentStore(spark, fresh_path(spark, "store"))
    for k in range(3):
        assert held.turn("s-1", f"prompt {k}", lambda p, s: (json.dumps({"answer": p}), json.dumps({"n": json.loads(s).get("n", 0) + 1}))) == k + 1
    assert held.conversation("s-1") == (3, '{"n": 3}')
    tried = []

    def overtaken(prompt, state):
        if not tried:
            tried.append(1)
            held.commit_conversation("s-1", 3, '{"n": 40}')  # another writer is first
        return "{}", json.dumps({"n": json.loads(state)["n"] + 1})

    assert held.turn("s-1", "again", overtaken) == 5 and held.conversation("s-1") == (5, '{"n": 41}')
    view = held.conversation_history("s-1", 2)
    assert [t["revision"] for t in view["turns"]] == [4, 5] and view["truncated"] and view["turns"][1]["prompt"] == "again"
    assert held.conversation_history("new")["turns"] == []
    held.record_query("Was?", '{"a": 1}')
    held.record_query("Wer?", '{"a": 2}', session="s-1", revision=5)
    assert sorted(r["prompt"] for r in held.history().collect()) == ["Was?", "Wer?"] and held.revision() == 0


def test_pages_go_both_ways(spark):
    held = S.DocumentStore(spark, fresh_path(spark, "store"))
    held.append(spark.createDataFrame([(f"d{i:02}", f"t{i}", "u") for i in range(9)], ROWS).repartition(3))
    places = [r["sequence"] for r in held.page(0, 200).collect()]
    first = [r["sequence"] for r in held.page(0, 4, expected_revision=1).collect()]
    second = [r["sequence"] for r in held.page(first[-1], 4).collect()]
    assert first + second == places[:8] and [r["sequence"] for r in held.page(limit=4, before=second[0]).collect()] == first
    held.append(spark.createDataFrame([("x", "tx", "u")], ROWS))
    with pytest.raises(S.RevisionConflict):
        held.page(first[-1], 4, expected_revision=1)


def test_relations_are_revisions(spark):
    held = S.DocumentStore(spark, fresh_path(spark, "store"))
    rows = lambda *r: spark.createDataFrame(list(r), "subject string, predicate string, object string, source string")
    assert held.add_relations(rows(("a", "is_a", "b", "s"), ("b", "is_a", "c", "s"))) == {"revision": 1, "added": 2, "existing": 0}
    assert held.add_relations(rows(("a", "is_a", "b", "s"))) == {"revision": 1, "added": 0, "existing": 1}
    with pytest.raises(ValueError):
        held.add_relations(rows(("x", "is_a", "y", "s")), most_nodes=4)
    with pytest.raises(ValueError):
        held.add_relations(rows(("x", None, "y", "s")))
    assert held.revision() == 1 and [r["subject"] for r in held.relations().collect()] == ["a", "b"]
