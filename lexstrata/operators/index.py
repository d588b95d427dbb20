"""A stored inverted index (Q4, Q6, A3, A4, A19, J3, K1, K2, ST6).

Texts are cut into words once. Postings are written by term bucket and sorted by term, so a search
reads the bucket folders and row groups of its own terms only; the terms of a document stand in a
forward table, dealt and sorted by document. A batch is a set of new parts and counts with its commit:
a batch that fails leaves nothing that a search reads, and is indexed anew when it is tried again.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.commits import Commit, CommitLog
from ..sources.shared import fresh_path
from .retrieval import BM25_B, BM25_K1, passages, query_terms

#: A bucket has about this many bytes of texts; there are at least ``LEAST_BUCKETS``.
BUCKET_BYTES, LEAST_BUCKETS = 256 << 20, 32
TERMS = "term string, doc_id long, tf long, bucket int"
PASSAGES = "term string, doc_id long, passage int, title long, body long, bucket int"
LENGTHS = "doc_id long, passage int, length long"
DOCUMENTS = "doc_id long, norm double"
FORWARD = "doc_id long, term string, tf long, home int"
#: Indexes of a session that are kept for tables in use.
KEPT_INDEXES = 4


class TextIndex:
    """Tables of a commit log: terms (term, doc_id, tf), passages (term, doc_id, passage, title, body), lengths of passages,
    documents with their norms, and forward (doc_id, term, tf)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.log = CommitLog(spark, folder)
        self.now: Commit = self.log.latest()

    @classmethod
    def build(cls, docs: DataFrame, folder: str | None = None) -> TextIndex:
        index = cls(docs.sparkSession, folder or fresh_path(docs.sparkSession, "index"))
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        index._write(docs, {"buckets": max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))})
        return index

    def append(self, docs: DataFrame) -> int:
        """Indexes the documents whose id isn't indexed yet; the new revision. A conflict if another writer was first."""
        self.now = self.log.latest()
        self._write(docs.join(self._read("documents").select("doc_id"), "doc_id", "left_anti"), {})
        return self.now.revision

    def _write(self, docs: DataFrame, properties: dict) -> None:
        buckets = properties.get("buckets") or self.now.properties["buckets"]
        docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        words = docs.select("doc_id", F.explode_outer(X.all_words(X.folded(F.col("text")))).alias("term"))
        counted = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).where("term IS NOT NULL")
        forward = self.log.write(counted.withColumn("home", self._home(F.col("doc_id"), buckets)).repartition(F.col("home")).sortWithinPartitions("home", "doc_id"), "forward", partition_by=("home",))
        held = self.spark.read.schema(FORWARD).parquet(self.log.path(forward))
        terms = self._put(held.select("term", "doc_id", "tf"), "terms", buckets)
        cut = passages(docs)
        part = lambda c, w: cut.select("doc_id", "passage", F.explode(X.all_words(X.folded(F.col(c)))).alias("term"), F.lit(w).alias("body"))
        both = part("title", 0).unionByName(part("body", 1)).groupBy("doc_id", "passage", "term").agg(F.count_if(F.col("body") == 0).alias("title"), F.count_if(F.col("body") == 1).alias("body"))
        places = self._put(both.select("term", "doc_id", F.col("passage").cast("int").alias("passage"), "title", "body"), "passages", buckets)
        length = self.spark.read.schema(PASSAGES).parquet(self.log.path(places)).groupBy("doc_id", "passage").agg(F.sum(F.col("title") + F.col("body")).alias("length"))
        all_ = cut.select("doc_id", F.col("passage").cast("int").alias("passage")).join(length, ["doc_id", "passage"], "left").select("doc_id", "passage", F.coalesce("length", F.lit(0)).alias("length"))
        lengths = self.log.write(all_, "lengths")
        weight = 1 + F.log("tf")
        norms = held.where(~F.col("term").isin(*X.STOPWORDS)).groupBy("doc_id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
        documents = self.log.write(docs.select("doc_id").join(norms, "doc_id", "left"), "documents")
        parts = {"forward": [forward], "terms": [terms], "passages": [places], "lengths": [lengths], "documents": [documents]}
        self.now = self.log.commit(self.now, add=parts, properties=properties)

    def _put(self, rows: DataFrame, name: str, buckets: int) -> str:
        # a bucket is dealt to several tasks, so that no term's postings gather in one
        salts = max(4, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets))
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        dealt = dealt.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).sortWithinPartitions("bucket", "term")
        return self.log.write(dealt, name, partition_by=("bucket",))

    @staticmethod
    def _home(doc_id: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")

    def _read(self, name: str, terms: list[str] | None = None) -> DataFrame:
        schema = {"terms": TERMS, "passages": PASSAGES, "lengths": LENGTHS, "documents": DOCUMENTS, "forward": FORWARD}[name]
        rows = self.log.read(name, schema, self.now)
        if terms is not None:
            buckets = self.now.properties["buckets"]
            homes = self.spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms]).alias("b")).first()[0] if terms else []
            rows = rows.where(F.col("bucket").isin(*set(homes)) & F.col("term").isin(*terms)) if terms else rows.where("false")
        return rows

    def terms_of(self, doc_id: int) -> DataFrame:
        """(term, tf) of one document, from its home in the forward table."""
        home = self.spark.range(1).select(self._home(F.lit(doc_id).cast("long"), self.now.properties["buckets"])).first()[0]
        return self._read("forward").where((F.col("home") == home) & (F.col("doc_id") == doc_id)).select("term", "tf")

    def texts(self) -> int:
        return self._read("documents").count()

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """A4: (term, doc_id, tf)."""
        return self._read("terms", terms).select("term", "doc_id", "tf")

    def frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """A3: (term, df), without stop words unless they are asked for."""
        rows = self.postings(terms)
        return (rows if terms is not None else rows.where(~F.col("term").isin(*X.STOPWORDS))).groupBy("term").agg(F.count("*").alias("df"))

    def idf_weights(self) -> DataFrame:
        """A19."""
        n = self.texts()
        return self.frequencies().select("term", "df", (1 + F.log(F.lit(1.0 + n) / (1 + F.col("df")))).alias("weight"))

    def _asked(self, prompt: str) -> list[str]:
        return sorted(r["term"] for r in query_terms(self.spark.range(0), prompt).collect())

    def coverage_topk(self, prompt: str, *, k: int = 20, least: float = 0.6) -> DataFrame:
        """Documents by the weighted share of the prompt's terms they hold."""
        asked, n = self._asked(prompt), self.texts()
        df = {r["term"]: r["df"] for r in self.frequencies(asked).collect()}  # a row for each term of the prompt
        weights = self.spark.createDataFrame([(t, df.get(t, 0)) for t in asked], "term string, df long").select("term", (1 + F.log(F.lit(1.0 + n) / (1 + F.col("df")))).alias("weight"))
        whole = weights.agg(F.sum("weight")).first()[0] or 1.0
        got = self.postings(asked).join(F.broadcast(weights), "term").groupBy("doc_id").agg(F.sum("weight").alias("got"))
        return got.select("doc_id", F.round(F.col("got") / F.lit(whole), 6).alias("coverage")).where(F.col("coverage") >= least).orderBy(F.desc("coverage"), "doc_id").limit(k)

    def tf_cosine_topk(self, doc_id: int, *, k: int = 20) -> DataFrame:
        """Nearest documents of one document by cosine of log term frequencies; only the postings of its terms are read."""
        own = self.terms_of(doc_id).where(~F.col("term").isin(*X.STOPWORDS)).select(F.pmod(F.xxhash64("term"), F.lit(self.now.properties["buckets"])).cast("int").alias("bucket"), "term", (1 + F.log("tf")).alias("q"))
        norms = self._read("documents").select("doc_id", "norm")
        mine = norms.where(F.col("doc_id") == doc_id).agg(F.max("norm")).first()[0] or 1.0
        dots = self._read("terms").join(own, ["bucket", "term"]).groupBy("doc_id").agg(F.sum((1 + F.log("tf")) * F.col("q")).alias("dot"))
        score = F.round(F.col("dot") / (F.col("norm") * F.lit(mine)), 6).alias("score")
        return dots.where(F.col("doc_id") != doc_id).join(norms, "doc_id").select("doc_id", score).orderBy(F.desc("score"), "doc_id").limit(k)

    def bm25_topk(self, prompt: str, *, k: int = 24, title_weight: float = 8.0) -> DataFrame:
        """Q6, K2: passages by BM25 over title and body, titles weighted; ties by document and passage."""
        asked = self._asked(prompt)
        lengths = self._read("lengths")
        n, mean = lengths.agg(F.count("*"), F.avg("length")).first()
        hits = self._read("passages", asked)
        df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}
        idf = self.spark.createDataFrame([(t, df.get(t, 0)) for t in asked], "term string, df long").select("term", F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf"))
        tf = title_weight * F.col("title") + F.col("body")
        part = F.col("idf") * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.lit(mean)))
        scored = hits.join(F.broadcast(idf), "term").join(lengths.select("doc_id", "passage", "length"), ["doc_id", "passage"]).groupBy("doc_id", "passage").agg(F.round(F.sum(part), 5).alias("bm25"))
        return scored.orderBy(F.desc("bm25"), "doc_id", "passage").limit(k)

    def holders_of(self, items: DataFrame, docs: DataFrame) -> DataFrame:
        """(doc_id, item_id) where the whole item stands in the document's text.

        An item's inner words stand in the document as words; the rarest of them names the few documents that are compared.
        The outer words of an item without inner ones are parts of words of the document: the words of the vocabulary that
        contain its longest run of letters and digits name them. An item without any such run is compared with all documents.
        """
        items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.col("text").alias("item"))
        words = X.all_words(X.folded(F.col("item")))
        inner = items.select("item_id", F.explode(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))).alias("term")).distinct()
        df = self.postings().join(inner.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        anchors = inner.join(df, "term", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("a")).where("a.df > 0").select("item_id", F.col("a.term").alias("term"))
        pairs = anchors.join(self.postings(), "term").select("item_id", "doc_id").join(items, "item_id")
        found = docs.select("doc_id", "text").join(pairs, "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
        short = items.where(F.size(words) < 3)
        if short.isEmpty():
            return found
        longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        runs = short.select("item_id", "item", longest.alias("run"))
        # a run of letters is part of a word of the vocabulary: their three-letter pieces meet, then the words are compared
        pieces = lambda c: F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))
        vocabulary = self.postings().select("term").distinct()
        wide = vocabulary.select("term", F.explode(F.array_distinct(pieces(F.col("term")))).alias("piece"))
        known = runs.where(F.length("run") >= 3).select("item_id", "run", F.substr("run", F.lit(1), F.lit(3)).alias("piece")).join(wide, "piece").where(F.contains("term", F.col("run"))).select("item_id", "term")
        some = known.join(self.postings(), "term").select("item_id", "doc_id").distinct().join(short, "item_id")
        brief = runs.where("run IS NULL OR length(run) < 3").select("item_id", "item")
        exact = lambda rows: rows.where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
        all_ = found.unionByName(exact(docs.select("doc_id", "text").join(some, "doc_id")))
        return all_ if brief.isEmpty() else all_.unionByName(exact(docs.select("doc_id", "text").join(brief, F.contains("text", F.col("item")))))


_built: OrderedDict[tuple, TextIndex] = OrderedDict()


def _files(docs: DataFrame) -> list[tuple[str, int, int]]:
    """(path, size, time) of the files of a table; each folder is listed once."""
    spark, wanted = docs.sparkSession, set(docs.inputFiles())
    found = []
    for folder in sorted({f.rpartition("/")[0] for f in wanted}):
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place):
            found.append((s.getPath().getName(), s.getLen(), s.getModificationTime()))
    names = {f.rpartition("/")[2] for f in wanted}
    return sorted(x for x in found if spark._jvm.java.net.URI(None, None, f"/{x[0]}", None).getRawPath()[1:] in names or x[0] in names) + sorted((f, 0, 0) for f in wanted)


def index_of(docs: DataFrame) -> TextIndex:
    """The session's index of a table of documents, built at the first use; keyed by the table's files with their sizes and
    times, so files that are replaced are indexed anew. Rows that come from no file get an index of their own each time."""
    if not docs.inputFiles():
        return TextIndex.build(docs)
    key = (docs.sparkSession.sparkContext.applicationId, *_files(docs))
    if key not in _built:
        _built[key] = TextIndex.build(docs)
        while len(_built) > KEPT_INDEXES:
            _built.popitem(last=False)
    _built.move_to_end(key)
    return _built[key]
