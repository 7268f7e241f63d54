"""Mixing sources to target shares of the total size, by fitting each source's budget exactly.

Documents of each source are counted by exact token length. The total is the largest for which no source has to be
repeated more often than allowed. A source's budget is met by as many whole passes over it as fit, and for the rest by
subsets of lengths, one more use of a document at a time: most of it is taken from all lengths in proportion, and what then remains is fitted by dynamic
programming over the bounded counts that are left, which hits it exactly if any choice of documents does. Which documents
of a length are used again is decided by a seeded hash of doc_id, so the histogram is all that the fitting sees.

The histogram of a source is fitted in one task; it has one row per distinct length, however many documents there are.

Defined cases: documents without text, without tokens or without a source, and sources without a target, are not used;
a target without documents gets nothing, and the others share what it leaves in proportion; a null or non-positive
target or max_repeats below 1 excludes its source; equal doc_ids of one source and length are selected one after another;
empty tables give an empty mixture.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipworks.llm.tokens import VOCABULARY, token_sizes
from pipworks.storage import Scratch

SEED = 23
#: Largest remainder, in tokens, that is fitted by dynamic programming; the proportional part leaves no more.
FIT_TOKENS = 1 << 16
_BINS = 1024


def fit(lengths: list[int], counts: list[int], budget: int, seed: int = SEED) -> list[int]:
    """How many documents of each length to take so that their sizes add up to `budget`, or as near below it as can be found."""
    take = [0] * len(lengths)
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    budget = min(budget, total)
    if total and budget > FIT_TOKENS:
        share = (budget - FIT_TOKENS // 2) / total
        take = [int(c * share) for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    # single documents in random order, until what remains is small enough to be fitted exactly
    order = np.random.default_rng(seed).permutation(len(lengths)).tolist()
    while left > FIT_TOKENS:
        before = left
        for k in order:
            if left - lengths[k] >= FIT_TOKENS // 4 and take[k] < counts[k]:
                take[k] += 1
                left -= lengths[k]
            if left <= FIT_TOKENS:
                break
        if left == before:
            break
    # bounded subset sum: bit s of `reached` says that s tokens can be made of what was gone through so far
    mask = (1 << (left + 1)) - 1
    reached, trail = 1, []
    for k in order:
        spare = counts[k] - take[k]
        part = 1
        while spare > 0 and lengths[k] <= left and not reached >> left & 1:
            part = min(part, spare)
            if part * lengths[k] > left:
                part = left // lengths[k]
                if not part:
                    break
            trail.append((k, part, reached))
            reached |= (reached << (part * lengths[k])) & mask
            spare -= part
            part *= 2
        if reached >> left & 1:
            break
    at = reached.bit_length() - 1
    for k, part, before in reversed(trail):
        if not before >> at & 1:
            take[k] += part
            at -= part * lengths[k]
    return take


def plan(spark: SparkSession, histogram: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, tokens, passes, extra): for every length of a source, how often all its documents are used and how many once more."""
    usable = targets.filter("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    have = histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("size")).join(usable, "source")
    rows = have.collect()  # one row per source with a target
    if not rows:
        return spark.createDataFrame([], "source string, tokens long, passes int, extra long")
    shares = sum(r["share"] for r in rows)
    largest = min(int(r["size"] * r["most"] / (r["share"] / shares)) for r in rows)
    total = largest if total is None else min(total, largest)
    budget = {r["source"]: round(total * r["share"] / shares) for r in rows}
    size = {r["source"]: int(r["size"]) for r in rows}
    most = {r["source"]: int(r["most"]) for r in rows}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        pdf = pdf.sort_values("tokens")
        passes = min(budget[source] // size[source], most[source])
        lengths, counts = pdf["tokens"].tolist(), pdf["n"].tolist()
        rest, uses = budget[source] - passes * size[source], [passes * c for c in counts]
        for _ in range(passes, most[source]):  # where long documents don't fit, short ones may be used again
            take = fit(lengths, counts, rest)
            rest -= sum(n * t for n, t in zip(lengths, take, strict=True))
            uses = [u + t for u, t in zip(uses, take, strict=True)]
            if rest <= 0 or not any(take):
                break
        return pd.DataFrame({"source": source, "tokens": lengths, "passes": [u // c for u, c in zip(uses, counts, strict=True)], "extra": [u % c for u, c in zip(uses, counts, strict=True)]})

    return histogram.join(F.broadcast(spark.createDataFrame([(s,) for s in budget], "source string")), "source").groupBy("source").applyInPandas(run, "source string, tokens long, passes int, extra long")


def mixture(spark: SparkSession, documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, repeats) of every document that is used."""
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(token_sizes(documents.filter("source is not null"), ["doc_id", "source"], vocabulary).filter("tokens > 0"), "sizes")
    histogram = sized.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"))
    chosen = scratch.save(plan(spark, histogram, targets, total), "plan")
    keyed = sized.join(chosen, ["source", "tokens"]).withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).withColumn("bin", F.pmod(F.shiftrightunsigned("h", 20), F.lit(_BINS)))
    # the `extra` least by (bin, hash): whole bins where they fit, an order only within the bin where they end
    group = Window.partitionBy("source", "tokens")
    filled = keyed.groupBy("source", "tokens", "bin").agg(F.count(F.lit(1)).alias("here"))
    filled = filled.withColumn("before", F.sum("here").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))).select("source", "tokens", "bin", F.coalesce("before", F.lit(0)).alias("before"), "here")
    placed = keyed.join(filled, ["source", "tokens", "bin"])
    inside = placed.filter("before < extra and before + here > extra").withColumn("at", F.row_number().over(Window.partitionBy("source", "tokens", "bin").orderBy("h", "doc_id")))
    edge = inside.select("doc_id", "source", "tokens", "passes", (F.col("before") + F.col("at") <= F.col("extra")).cast("int").alias("more"))
    whole = placed.filter("not (before < extra and before + here > extra)").select("doc_id", "source", "tokens", "passes", (F.col("before") + F.col("here") <= F.col("extra")).cast("int").alias("more"))
    return whole.unionByName(edge).select("doc_id", "source", "tokens", (F.col("passes") + F.col("more")).alias("repeats")).filter("repeats > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, actual_share) of every target."""
    used = mix.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    all_tokens = used.agg(F.sum("tokens").alias("all"))
    return targets.join(used, "source", "left").join(F.broadcast(all_tokens)).select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"))
