"""Periodic runs against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lexstrata.llm import periodic
from lexstrata.llm.registry import queries

from .helpers import documents, with_clashes


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def plain_runs(w):
    """(start, length, period) of every maximal stretch with its smallest period, tried period by period."""
    out, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def changed(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]


def expected(doc_id, text):
    w = changed(doc_id, words_of(text))
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(rest).hexdigest())


def rows_of(df):
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return [(r["doc_id"], tuple(r[n] for n in names)) for r in df.collect()]


def repeating(seed):
    rng = random.Random(seed)
    out = []
    while len(out) < rng.choice((5, 30, 90, 250)):
        unit = [rng.choice("abcd") for _ in range(rng.choice((1, 1, 2, 3, 5, 9)))]
        unit = unit * rng.choice((1, 2, 4, 5))
        out += (unit * rng.choice((1, 1, 4, 5, 7)))[: rng.randrange(1, 80)]
    return " ".join(out)


@pytest.mark.parametrize("least", [2, 4])
def test_runs_of_random_sequences(least):
    rng = random.Random(5)
    for trial in range(150):
        parts = [[rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randrange(1, 70))] for _ in range(3)]
        parts += [(parts[0][:7] * 6)[: rng.randrange(1, 40)], parts[-1]]
        line, starts, sep = [3], [], 4
        for p in parts:
            starts.append(len(line))
            line += [*p, sep]
            sep += 1
        got = sorted(zip(*(x.tolist() for x in periodic.runs(np.array(line), 35, 2, least)), strict=True))
        want = set()
        for at, p in zip(starts, parts, strict=True):
            for q in range(1, len(p) // 2 + 1):
                i = 0
                while i + q < len(p):
                    j = i
                    while j + q < len(p) and p[j] == p[j + q]:
                        j += 1
                    if j + q - i >= least * q and not any(s == at + i and n == j + q - i for s, n, _ in want):
                        want.add((at + i, j + q - i, q))
                    i = max(j, i + 1)
        assert got == sorted(want), (trial, parts)


def test_report_equals_the_plain_version(spark):
    docs = [(i, repeating(i)) for i in range(200)] + [(900, None), (901, ""), (902, " \t\n"), (903, "a a a a a"), (904, "a " * 6), (905, "x y x y x y x y"), (906, "É\x0bé\rÉ é " * 9)]
    docs += [(907, "b " * 3000), (908, " ".join(f"w{i % 700}" for i in range(6000))), (3, repeating(77)), (3, repeating(77))]
    got = rows_of(periodic.report(documents(spark, docs)))
    assert sorted(got) == sorted((i, expected(i, t)) for i, t in docs)
    assert sorted(got) == sorted(rows_of(periodic.report(with_clashes(documents(spark, docs)))))
    assert sum(r[0] > 0 for _, r in got) > 100


def test_empty_table_and_null_ids(spark):
    assert periodic.report(documents(spark, [(1, "a")]).limit(0)).collect() == []
    got = periodic.report(documents(spark, [(None, "a b " * 5), (None, None)])).collect()
    assert sorted(r["n_runs"] for r in got) == [0, 1]


def test_run_rows_and_collapse(spark):
    docs = [(1, "say  it it it it it it twice"), (2, "no  runs here"), (3, None), (4, "x y " * 4 + "z"), (5, "")]
    rows = {tuple(r) for r in periodic.run_rows(documents(spark, docs)).collect()}
    assert rows == {(1, 1, 6, 1), (4, 0, 8, 2)}
    got = {r["doc_id"]: r["text"] for r in periodic.collapse(with_clashes(documents(spark, docs))).collect()}
    assert got == {1: "say it twice", 2: "no  runs here", 3: None, 4: "x y z", 5: ""}


def test_query_on_the_tables(spark):
    from ..conftest import SF

    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r["doc_id"], expected(r["doc_id"], r["text"])) for r in table.select("doc_id", "text").collect())
    assert sorted(rows_of(queries()["op13_periodic_runs"](spark, SF))) == want
