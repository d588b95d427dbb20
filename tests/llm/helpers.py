"""Brute-force versions of the contracts, over plain Python lists."""

from __future__ import annotations

import re

A_Z = bytes(x + 32 if 65 <= x < 91 else x for x in range(256))


def low(text: str | None) -> bytes:
    return (text or "").encode().translate(A_Z)


def alnum_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def plain_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", low(text))


def components(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


DDL = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """``rows`` of (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DDL)


def with_clashes(df):
    """The same rows with extra columns whose names are apt to clash."""
    from pyspark.sql import functions as F

    names = ["id", "Text", "key", "score", "row", "component", "kept", "accepted", "lang_pred", "held_out", "gone", "n_words", "pieces", "c0"]
    return df.select("*", *[F.lit("x").alias(n) for n in names])
