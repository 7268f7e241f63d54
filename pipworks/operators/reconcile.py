"""Several transcripts of one match: which belong together, which is kept, and what the others add to it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.functions.text import normalise
from pipworks.kernels.sequences import SAME_MATCH, shared_rolls
from pipworks.operators.components import components
from pipworks.operators.transcripts import summaries, tokens

#: Ranks of a transcript (fixed values): checked, readable, refused.
RANKS = {"good": 3, "partial": 2, "error": 1}
FILLED = ("event", "round", "date")


def clusters(spark: SparkSession, rolls: DataFrame, ratio: float = SAME_MATCH) -> DataFrame:
    """(path, root, members) of transcripts (path, key, tokens) of which another of the same key shares at least `ratio` of the rolls.

    Equal token lists are put together by a digest first, so copies of one transcript make no pairs; what meets under a key
    are distinct transcripts of the same players and length.
    """
    marked = rolls.withColumn("digest", F.sha2(F.to_json("tokens"), 256))
    copies = marked.groupBy("key", "digest").agg(F.min("path").alias("first"))
    member = marked.join(copies, ["key", "digest"]).select("path", "first")
    one = marked.join(copies.select(F.col("first").alias("path")), "path").select("path", "key", "tokens")
    pairs = one.select("key", F.col("path").alias("a"), F.col("tokens").alias("ta")).join(one.select("key", F.col("path").alias("b"), F.col("tokens").alias("tb")), "key").filter("a < b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [shared_rolls([list(g) for g in x], [list(g) for g in y])[0] >= ratio for x, y in zip(batch["ta"], batch["tb"], strict=True)]
            yield batch.loc[near, ["a", "b"]]

    links = pairs.select("a", "b", "ta", "tb").mapInPandas(check, "a string, b string").unionByName(member.filter("path <> first").select(F.col("first").alias("a"), F.col("path").alias("b")))
    roots = components(spark, links).select(F.col("node").alias("path"), "root")
    return roots.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "root")


def keepers(grouped: DataFrame) -> DataFrame:
    """(root, path) of the member to keep: the one of the highest rank, if only one has it and it is readable; otherwise path is null and a person decides."""
    best = grouped.groupBy("root").agg(F.max("rank").alias("best"))
    top = grouped.join(best, "root").filter("rank = best").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("best").alias("best"), F.min("path").alias("path"))
    return top.select("root", F.when((F.col("n") == 1) & (F.col("best") > 1), F.col("path")).alias("path"))


def reconcile(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(root, path, decision, event, round, date) of the files (path, content) that have a counterpart: keep, superseded or tie. A kept transcript takes missing values from the others, the best ranked and then the first by path."""
    found = summaries(files)
    names = F.array_join(F.array_sort(F.array(*[F.coalesce(normalise(F.col(p)), F.lit("")) for p in ("p0", "p1")])), "|")
    keyed = found.select("path", F.concat_ws("|", names, F.col("match_length").cast("string")).alias("key"), F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("status")).alias("rank"), *FILLED)
    rolls = tokens(files).join(keyed.select("path", "key"), "path")
    grouped = clusters(spark, rolls).join(keyed.drop("key"), "path")
    kept = keepers(grouped).select("root", F.col("path").alias("keeper"))
    fills = grouped.groupBy("root").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.col("rank"), F.col("path")))).alias(f"fill_{c}") for c in FILLED])
    out = grouped.join(kept, "root").join(fills, "root")
    decision = F.when(F.col("keeper").isNull(), "tie").when(F.col("keeper") == F.col("path"), "keep").otherwise("superseded")
    return out.select("root", "path", decision.alias("decision"), *[F.when(decision == "keep", F.coalesce(c, f"fill_{c}")).otherwise(F.col(c)).alias(c) for c in FILLED])
