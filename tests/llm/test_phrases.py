"""Phrases against a plain version and against SQL."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from lexstrata.llm import phrases
from lexstrata.llm.registry import oracle_sql, queries

from ..conftest import SF
from .helpers import documents, low, with_clashes


def expected(docs, least, most):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    found = []
    often = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    for (lang, *w), a in often.items():
        longer = [b for (other, *x), b in often.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.append((lang, -score, -a, b" ".join(w), f[lang, *w[:k]], f[lang, *w[k:]]))
    out = []
    for lang in n:
        for rank, (_, score, a, phrase, l, r) in enumerate(sorted(x for x in found if x[0] == lang)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(seed, rows):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "état", "a-b", "x", "y", "z'", "q1"]
    fixed = ["new york state of", "the the the", "a-b x y z'", "état of the", "one two three four five"]
    def part():
        return rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary)
    return [(i, rng.choice(" \t") .join(part() + rng.choice(["", "", "", ",", ". ", "\n", "!\r\n", ";\x0b"]) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "de", None, "und"])) for i in range(rows)]


def test_phrases_equal_the_plain_version(spark):
    docs = [*texts(1, 300), (1000, None, "en"), (1001, "", None), (1002, "Alone", "fr"), (1003, "the " * 5000, "en"), (5, "same same row", "en"), (5, "same same row", "en")]
    want = expected(docs, 12, 25)
    assert len(want) > 40 and {len(x[2].split(" ")) for x in want} == {2, 3, 4}
    for bits in (15, 27):
        got = phrases.report(with_clashes(documents(spark, docs)), least=12, most=25, filter_bits=bits)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_large_counts_are_exact(spark):
    rows = [("en", 1, "a", 9 * 10**18), ("en", 1, "b", 3 * 10**18), ("en", 2, "a b", 3 * 10**18 - 1), ("en", 2, "b c", 3 * 10**18 - 2), ("en", 1, "c", 3 * 10**18 - 2), ("en", 3, "a b c", 24 * 10**17)]
    df = spark.createDataFrame(rows, "lang string, words int, phrase string, n long")
    got = {r["phrase"]: r for r in phrases.scored(df).collect()}
    assert got["a b"]["score"] == 2_000_000 * (3 * 10**18 - 1) // (12 * 10**18)
    assert got["a b c"]["score"] == min(2_000_000 * 24 * 10**17 // (12 * 10**18 - 2), 2_000_000 * 24 * 10**17 // (6 * 10**18 - 3))
    kept = {r["phrase"] for r in phrases.uncovered(phrases.scored(df)).collect()}
    assert kept == {"a b c"} | ({"a b"} if 100 * 24 * 10**17 < 80 * (3 * 10**18 - 1) else set()) | ({"b c"} if 100 * 24 * 10**17 < 80 * (3 * 10**18 - 2) else set())


def test_empty_table(spark):
    assert phrases.report(documents(spark, [(1, "a")]).limit(0)).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.sql(oracle_sql()["op12_phrases"])
    names = [d[0] for d in cursor.description]
    got = queries()["op12_phrases"](spark, SF).select(*names)
    assert sorted(tuple(r) for r in got.collect()) == sorted(cursor.fetchall())


def test_words_that_are_named_like_languages(spark):
    docs = [(i, "es de x", "en") for i in range(30)] + [(100 + i, "en de x", "es") for i in range(40)] + [(200 + i, "es en x", "de") for i in range(50)]
    got = phrases.report(documents(spark, docs).coalesce(1))
    assert sorted(tuple(r) for r in got.collect()) == expected(docs, 30, 2000)


def test_a_shard_takes_bounded_memory(spark):
    """Workers of two tasks and the JVM share an executor: the texts of a shard's phrases aren't put together at once."""

    class Held:
        def __init__(self, value=None):
            self.value = value

        def mapInArrow(self, work, schema):
            self.work = work
            return self

        def groupBy(self, *names):
            return self

        agg = groupBy

    rng = random.Random(3)
    words = [f"word{i:05d}" for i in range(50_000)]
    lines = [" ".join(rng.choices(words, k=1000)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array(["en"] * len(lines))], names=["text", "lang"])
    all_, held = Held(np.full(1 << 12, 255, np.uint8)), Held()
    phrases._counts(held, range(3, 5), all_, all_)
    tracemalloc.start()
    rows = sum(b.num_rows for b in held.work(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 390_000 and peak < 150 << 20
