"""Covering locality-sensitive hashing: structured masks over a sketch, and links and pairs from its tables.

A record's features are reduced to a sketch of `WIDTH` coordinates, each the least value of one hash function over the
features (so two sketches agree at a coordinate with the probability of their Jaccard similarity). A family of bit masks
covers a radius r if for every choice of at most r coordinates some mask avoids all of them: two sketches that differ in
at most r coordinates then surely agree on everything that mask keeps, and meet in its table. The family here holds every
mask that keeps two coordinates; it covers r = WIDTH - 2, with WIDTH * (WIDTH - 1) / 2 tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 12
_MUL = np.random.default_rng(20_011).integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(20_012).integers(0, 2**63, WIDTH, dtype=np.uint64)
#: The masks as pairs of coordinates, and the distinct salt of each table.
MASKS = np.array(list(combinations(range(WIDTH), 2)))
#: Nodes of a bucket that are paired in one place; larger buckets are cut into blocks and every pair of blocks is made.
BLOCK = 256
#: Nodes of a bucket that are put in order in one place.
RUN = 4096
_SALT = np.random.default_rng(20_013).integers(0, 2**63, len(MASKS), dtype=np.uint64)


def radius() -> int:
    return WIDTH - 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def sketch(features: np.ndarray) -> np.ndarray:
    """WIDTH coordinates of a record with at least one 64-bit feature."""
    with np.errstate(over="ignore"):
        return mix(features.astype(np.uint64)[None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1)


def table_keys(features: np.ndarray, salt: int = 0) -> np.ndarray:
    """One 64-bit key per mask; `salt` separates records that must not meet (another number, another kind)."""
    s = sketch(features)
    with np.errstate(over="ignore"):
        kept = mix(s[MASKS[:, 0]] * np.uint64(3) + mix(s[MASKS[:, 1]]) + _SALT + np.uint64(salt & (2**64 - 1)))
    return kept.view(np.int64)


def table_links(keys: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """Distinct links (a < b) between nodes that share a table key.

    Every node of a bucket is linked to the bucket's least node and to the one before it: for up to three nodes these are
    all pairs, beyond that at most twice as many links as nodes, so a large bucket never multiplies. Nodes that belong
    together share many tables, each with other neighbours. What these links leave open is for `table_pairs`. A bucket
    of more than RUN nodes is put in order in runs of about that size, so a hot key is no task of its own.
    """
    size = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(node).alias("least")).filter("n > 1")
    run = F.pmod(F.xxhash64(node), F.ceil(F.col("n") / RUN)).alias("run")
    placed = keys.select(node, key).join(size, key).select(node, key, "least", run).repartition(key, "run")
    seen = placed.select(node, "least", F.lag(node).over(Window.partitionBy(key, "run").orderBy(node)).alias("before"))
    return seen.select(F.explode(F.array_distinct(F.array("least", F.coalesce("before", "least")))).alias("a"), F.col(node).alias("b")).filter("a <> b").distinct()


def table_pairs(keys: DataFrame, ratio: float = 0.0) -> DataFrame:
    """Distinct pairs (a < b) of nodes that share a table key and are not of one group yet, of `keys` (node, key, group, size).

    No pair of a bucket is left out but those of one group and those whose smaller size is below `ratio` of the larger.
    A bucket of more than BLOCK nodes is cut into blocks; each pair of blocks meets under a key of its own, so a hot
    bucket is spread over many tasks.
    """
    bucket = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high")
    mixed = keys.join(bucket.select("key", "n"), "key")
    blocks = F.ceil(F.col("n") / BLOCK)
    own = mixed.select("node", "key", "group", "size", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("own"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("node", "key", "group", "size", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    side = lambda name: spread.select("key", "lo", "hi", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "group", "size", "own")])
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("group_a") != F.col("group_b")) & ((F.col("lo") == F.col("hi")) | (F.col("own_a") != F.col("own_b")))
    sized = F.least("size_a", "size_b") >= ratio * F.greatest("size_a", "size_b") - 1e-9
    return side("a").join(side("b"), ["key", "lo", "hi"]).filter(apart & sized).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
