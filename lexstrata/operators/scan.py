"""Searches by a pass over the texts (Q4, Q6, A3, A4, A19, J3, J16, K1, K2): what :class:`~.index.TextIndex` answers, for a table that
is asked once.

Only counts of the asked words leave a task, so a search writes and shuffles a small part of the texts; where whole documents
meet, they are dealt by id once. An index pays from many searches of the same texts on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import stored
from .retrieval import BM25_B, BM25_K1, passages, postings, query_terms

#: Words of an anchor: so many neighbouring inner words of an item name the documents that are compared with it.
ANCHOR_WORDS = 3


class TextScan:
    """Searches of a table of documents (doc_id, text); rows without id are left out."""

    def __init__(self, docs: DataFrame):
        self.spark, self.docs = docs.sparkSession, docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def _asked(self, prompt: str) -> list[str]:
        return sorted(r["term"] for r in query_terms(self.spark.range(0), prompt).collect())

    def idf_weights(self) -> DataFrame:
        """A19."""
        n = self.docs.count()
        df = postings(self.docs).groupBy("term").agg(F.count("*").alias("df"))
        return df.select("term", "df", (1 + F.log(F.lit(1.0 + n) / (1 + F.col("df")))).alias("weight"))

    def coverage_topk(self, prompt: str, *, k: int = 20, least: float = 0.6) -> DataFrame:
        """Documents by the weighted share of the prompt's terms they hold."""
        asked, n = self._asked(prompt), self.docs.count()
        some = F.array_distinct(F.filter(X.all_words(X.folded(F.col("text"))), lambda w: w.isin(*asked)))
        held = stored(self.docs.select("doc_id", F.explode(some).alias("term")).distinct(), "held")
        df = {r["term"]: r["df"] for r in held.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term of the prompt
        weights = self.spark.createDataFrame([(t, df.get(t, 0)) for t in asked], "term string, df long").select("term", (1 + F.log(F.lit(1.0 + n) / (1 + F.col("df")))).alias("weight"))
        whole = weights.agg(F.sum("weight")).first()[0] or 1.0
        got = held.join(F.broadcast(weights), "term").groupBy("doc_id").agg(F.sum("weight").alias("got"))
        return got.select("doc_id", F.round(F.col("got") / F.lit(whole), 6).alias("coverage")).where(F.col("coverage") >= least).orderBy(F.desc("coverage"), "doc_id").limit(k)

    def tf_cosine_topk(self, doc_id: int, *, k: int = 20) -> DataFrame:
        """Nearest documents of one document by cosine of log term frequencies."""
        weigh = lambda d: postings(d).select("doc_id", "term", (1 + F.log("tf")).alias("w"))
        own = stored(weigh(self.docs.where(F.col("doc_id") == doc_id)).select("term", F.col("w").alias("q")), "asked-document")
        mine = own.agg(F.sqrt(F.sum(F.col("q") * F.col("q")))).first()[0] or 1.0
        both = weigh(self.docs.where(F.col("doc_id") != doc_id)).join(F.broadcast(own), "term", "left")
        sums = both.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("dot IS NOT NULL")
        return sums.select("doc_id", F.round(F.col("dot") / (F.col("norm") * F.lit(mine)), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)

    def bm25_topk(self, prompt: str, *, k: int = 24, title_weight: float = 8.0) -> DataFrame:
        """Q6, K2: passages by BM25 over title and body, titles weighted; ties by document and passage."""
        asked = self._asked(prompt)
        if not asked:
            return self.spark.createDataFrame([], "doc_id long, passage int, bm25 double")
        # of each passage its length and, if it holds any asked term, how often it holds each
        seen = lambda c: X.bound(X.all_words(X.folded(F.col(c))), lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: x.isin(*asked)).alias("hits")))
        count = lambda c, t: F.size(F.filter(f"{c}.hits", lambda x: x == F.lit(t)))
        times = lambda c: F.array(*[count(c, t) for t in asked])
        cut = passages(self.docs).select("doc_id", F.col("passage").cast("int").alias("passage"), seen("title").alias("a"), seen("body").alias("b"))
        some = F.size("a.hits") + F.size("b.hits") > 0
        rows = stored(cut.select("doc_id", "passage", (F.col("a.n") + F.col("b.n")).alias("length"), F.when(some, times("a")).alias("title"), F.when(some, times("b")).alias("body")), "passage-counts")
        here = lambda i: F.col("title")[i] + F.col("body")[i] > 0
        n, mean, *df = rows.agg(F.count("*"), F.avg("length"), *[F.count_if(here(i)) for i in range(len(asked))]).first()
        bm25 = F.lit(0.0)
        for i, held in enumerate(df):
            idf = F.greatest(F.log((F.lit(float(n)) - held + 0.5) / F.lit(held + 0.5)), F.lit(1e-6))
            tf = title_weight * F.col("title")[i] + F.col("body")[i]
            bm25 = bm25 + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.lit(mean)))
        scored = rows.where("title IS NOT NULL").groupBy("doc_id", "passage").agg(F.round(F.sum(bm25), 5).alias("bm25"))
        return scored.orderBy(F.desc("bm25"), "doc_id", "passage").limit(k)

    def holders_of(self, items: DataFrame) -> DataFrame:
        """(doc_id, item_id) where the whole item stands in the document's text.

        An item's inner words stand in the document as neighbouring words: runs of up to ``ANCHOR_WORDS`` of them name the
        documents that are compared. The longest word of an item without inner ones is part of a word of the document: the words
        that contain it name them. An item without any word is compared with all documents.
        """
        items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.col("text").alias("item"))
        words = X.all_words(X.folded(F.col("item")))
        inner = F.greatest(F.size(words) - 2, F.lit(0))
        # of the runs the longest in letters is taken: it is likely to be rare
        size = F.least(inner, F.lit(ANCHOR_WORDS))
        runs = F.transform(F.sequence(F.lit(2), inner - size + 2), lambda i: F.concat_ws(" ", F.slice(words, i, size)))
        anchor = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
        longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        # one row an item: what finds it
        known = stored(items.select("item_id", "item", size.alias("size"), F.when(size > 0, anchor).alias("anchor"), F.when(size == 0, longest).alias("part")), "items")
        kinds = {r["size"] if r["size"] else ("part" if r["part"] else "all") for r in known.select("size", F.col("part").isNotNull().alias("part")).distinct().collect()}
        cut = self.docs.select("doc_id", X.all_words(X.folded(F.col("text"))).alias("w"))
        found = []
        grams = lambda w, n: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(n))))))
        for n in sorted(k for k in kinds if isinstance(k, int)):
            found.append(cut.select("doc_id", F.explode(grams(F.col("w"), n)).alias("anchor")).join(known.where(F.col("size") == n).select("item_id", "anchor"), "anchor").select("doc_id", "item_id"))
        if "part" in kinds:
            terms = cut.select(F.explode("w").alias("term")).distinct()
            # a word of three letters or more shares its first three with a place of the longer word; the words are compared then
            pieces = lambda c: F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))
            wide = terms.select("term", F.explode(F.array_distinct(pieces(F.col("term")))).alias("piece"))
            parts = known.where("length(part) >= 3").select("item_id", "part", F.substr("part", F.lit(1), F.lit(3)).alias("piece")).join(wide, "piece")
            held = parts.where(F.contains("term", F.col("part"))).select("item_id", "term")
            brief = terms.join(F.broadcast(known.where("length(part) < 3").select("item_id", "part")), F.contains("term", F.col("part"))).select("item_id", "term")
            found.append(cut.select("doc_id", F.explode(F.array_distinct("w")).alias("term")).join(held.unionByName(brief), "term").select("doc_id", "item_id"))
        exact = lambda rows: rows.where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
        out = self.spark.createDataFrame([], f"doc_id long, item_id {dict(items.dtypes)['item_id']}")
        for pairs in found:
            out = out.unionByName(exact(self.docs.join(pairs.distinct(), "doc_id").join(known.select("item_id", "item"), "item_id")))
        if "all" in kinds:
            whole = known.where("size = 0 AND part IS NULL").select("item_id", "item")
            out = out.unionByName(exact(self.docs.join(F.broadcast(whole), F.contains("text", F.col("item")))))
        return out
