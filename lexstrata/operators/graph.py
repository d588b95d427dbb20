"""Reachability over ``is_a`` edges with shortest proofs (N-1 to N-3, J9-J10, W7, U1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def edges(triples: DataFrame) -> DataFrame:
    """N-1, W7: one row for each (subject, object), with the smallest source as its witness."""
    rows = triples.where((F.col("predicate") == "is_a") & (F.trim("subject") != "") & (F.trim("object") != ""))
    return rows.groupBy("subject", "object").agg(F.min("source").alias("source"))


def nodes(edge_rows: DataFrame) -> DataFrame:
    """U1."""
    return edge_rows.select(F.col("subject").alias("node")).union(edge_rows.select(F.col("object").alias("node"))).distinct()


def reachable(edge_rows: DataFrame, *, max_hops: int = 8, starts: DataFrame | None = None) -> DataFrame:
    """N-2: (start, node, hops, path) of the shortest way to each node; of equally short ones the smallest path.

    Breadth first: each round joins only the newest nodes with the edges, keeps what wasn't reached yet,
    and writes that to shared storage, so plans don't grow from round to round.
    """
    first = (starts or nodes(edge_rows)).select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("path"))
    seen = frontier = stored(first, "reached")
    step = edge_rows.select(F.col("subject").alias("node"), F.col("object").alias("next"))
    for hops in range(1, max_hops + 1):
        grown = frontier.join(step, "node").groupBy("start", F.col("next").alias("node")).agg(F.min("path").alias("before"))
        fresh = grown.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = stored(fresh.select("start", "node", F.lit(hops).alias("hops"), F.concat("before", F.array("node")).alias("path")), "reached")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def infer(edge_rows: DataFrame, questions: DataFrame, *, max_hops: int = 8) -> DataFrame:
    """N-2: answers to (subject, target): status, path, proof (its edges) and their sources, and the reason: unknown_node,
    reflexivity, proved_by_transitivity, hop_limit (the search stopped with nodes still new) or no_path."""
    known = nodes(edge_rows)
    asked = questions.select("subject", "target").distinct().join(known.withColumnRenamed("node", "subject").withColumn("s", F.lit(True)), "subject", "left").join(known.withColumnRenamed("node", "target").withColumn("t", F.lit(True)), "target", "left")
    starts = questions.select(F.col("subject").alias("node")).distinct().join(known, "node", "left_semi")
    ways = reachable(edge_rows, max_hops=max_hops, starts=starts)
    step = edge_rows.select(F.col("subject").alias("node"), F.col("object").alias("next"))
    last = ways.where(F.col("hops") == max_hops).join(step, "node").select("start", F.col("next").alias("node")).join(ways.select("start", "node"), ["start", "node"], "left_anti").select(F.col("start").alias("subject")).distinct().withColumn("more", F.lit(True))
    out = asked.join(ways.select(F.col("start").alias("subject"), F.col("node").alias("target"), "hops", "path"), ["subject", "target"], "left").join(last, "subject", "left")
    pairs = F.when(F.size("path") > 1, F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("subject"), F.element_at("path", i + 1).alias("object"))))
    each = out.select("subject", "target", F.posexplode(pairs).alias("i", "e")).join(edge_rows.select(F.struct("subject", "object").alias("e"), "source"), "e")
    proof = F.transform(F.array_sort(F.collect_list(F.struct("i", "e", "source"))), lambda x: F.struct(x["e"]["subject"].alias("subject"), x["e"]["object"].alias("object"), x["source"].alias("source")))
    out = out.join(each.groupBy("subject", "target").agg(proof.alias("proof")), ["subject", "target"], "left")
    reason = F.when(F.col("s").isNull() | F.col("t").isNull(), "unknown_node").when(F.col("hops") == 0, "reflexivity").when(F.col("hops") > 0, "proved_by_transitivity").when(F.coalesce("more", F.lit(False)), "hop_limit").otherwise("no_path")
    none = F.array().cast("array<struct<subject:string,object:string,source:string>>")
    return out.select("subject", "target", F.col("hops").isNotNull().alias("proved"), F.when(F.col("hops").isNotNull(), "proved").otherwise("unknown").alias("status"), "hops", "path", F.coalesce("proof", none).alias("proof"), F.array_sort(F.array_distinct(F.transform(F.coalesce("proof", none), lambda x: x["source"]))).alias("sources"), reason.alias("reason"))


def parent_chains(messages: DataFrame) -> DataFrame:
    """(message_id, depth, roles) from each message up to its root; raises nothing, rows of broken chains have ``ok`` false.

    Each message holds a stretch of its chain and where it goes on; every round appends the stretch that the next one holds,
    so stretches double and a chain of n messages takes about log2(n) rounds. Where a stretch breaks or closes a ring, it ends.
    """
    up = messages.select(F.col("message_id").alias("at"), F.col("role").alias("at_role"), F.col("message_tree_id").alias("at_tree"))
    fine = F.coalesce((F.col("at_tree") == F.col("message_tree_id")) & (F.col("at_role") != F.col("role")) & (F.col("parent_id") != F.col("message_id")), F.lit(False))
    ok = F.col("parent_id").isNull() | fine
    step = messages.join(up, F.col("parent_id") == F.col("at"), "left")
    chains = step.select("message_id", F.when(fine, F.col("parent_id")).alias("next"), F.when(ok, F.array("role")).otherwise(F.array("role", "at_role")).alias("roles"), F.when(ok, F.array("message_id")).otherwise(F.array("message_id", "parent_id")).alias("seen"), ok.alias("ok"))
    chains = stored(chains, "chains")
    while not chains.where("next IS NOT NULL").isEmpty():
        on = chains.select(F.col("message_id").alias("at"), F.col("next").alias("then"), F.col("roles").alias("more"), F.col("seen").alias("met"), F.col("ok").alias("fine"))
        grown = chains.where("next IS NOT NULL").join(on, F.col("next") == F.col("at")).select("message_id", F.col("then").alias("next"), F.concat("roles", "more").alias("roles"), F.concat("seen", "met").alias("seen"), F.col("fine").alias("ok"))
        # a ring ends with the first message that comes again
        again = F.when(F.size(F.array_distinct("seen")) < F.size("seen"), F.array_min(F.filter(F.transform("seen", lambda x, i: F.when(F.array_position("seen", x) <= i, i + 1)), lambda i: i.isNotNull())))
        cut = lambda c: F.when(F.col("again").isNull(), F.col(c)).otherwise(F.slice(c, F.lit(1), F.col("again")))
        grown = grown.withColumn("again", again).select("message_id", F.when(F.col("again").isNull(), F.col("next")).alias("next"), cut("roles").alias("roles"), cut("seen").alias("seen"), (F.col("ok") & F.col("again").isNull()).alias("ok"))
        chains = stored(chains.where("next IS NULL").unionByName(grown), "chains")
    return chains.select("message_id", (F.size("roles") - 1).alias("depth"), "roles", "ok")
