"""Filling containers of fixed capacity with documents, by a grouping genetic algorithm on islands.

Documents are items of their size in tokens; one above the capacity is cut into full pieces, which fill containers of
their own, and a rest, which is an item. Items are spread by hash over shards of about SHARD_ITEMS, a bound that does not
grow with the data. Every shard is evolved on ISLANDS islands: a solution is a set of groups (containers with their
items); crossover injects well-filled groups of one solution whole into another, groups that hold an item twice are
dissolved, their displaced items take the place of smaller ones where that fills a group better, and go to where they
fit best. Between epochs the best solution of each island migrates
to the next island of its shard. Containers that end up below FULL are pooled from all shards and packed again in the
same way, so what is left over does not add up over shards.

Defined cases: null texts are no items; texts without tokens are packed with size 0; a text of exactly the capacity fills
a container alone; a doc_id given twice is two items; capacities that are null or below 1 are not used; without documents
or capacities the result is empty. The result depends on the data and SEED only.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.llm.tokens import VOCABULARY, token_sizes
from pipworks.storage import Scratch

SHARD_ITEMS = 500
ISLANDS = 2
EPOCHS = 2
#: Generations of an epoch, and those without a better best solution after which it ends.
GENERATIONS, PATIENCE = 10, 4
POPULATION = 6
OFFSPRING = 3
FULL = 0.97
SEED = 17
#: Times that poorly filled containers are pooled and packed again.
POOLS = 2

Groups = list[list[int]]


def best_fit(sizes: list[int], capacity: int, items: list[int], groups: Groups) -> Groups:
    """Puts `items`, largest first, into the fullest of `groups` that has room, or into a new one."""
    room = sorted((capacity - sum(sizes[i] for i in g), k) for k, g in enumerate(groups))
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            groups.append([i])
            bisect.insort(room, (capacity - sizes[i], len(groups) - 1))
        else:
            left, k = room.pop(at)
            groups[k].append(i)
            bisect.insort(room, (left - sizes[i], k))
    return groups


def fitness(sizes: list[int], capacity: int, groups: Groups) -> float:
    """Mean squared filling: prefers full groups beside an empty one to evenly filled ones."""
    return sum((sum(sizes[i] for i in g) / capacity) ** 2 for g in groups) / max(1, len(groups))


def exchange(sizes: list[int], capacity: int, groups: Groups, displaced: list[int]) -> list[int]:
    """Fills groups better by exchanging one of their items for a larger displaced one that still fits; what is displaced then is returned."""
    pool = sorted((sizes[i], i) for i in displaced)
    for g in groups:
        room = capacity - sum(sizes[i] for i in g)
        while room > 0 and pool:
            gain, best = 0, None
            for k, i in enumerate(g):
                at = bisect.bisect_left(pool, (sizes[i] + room + 1, -1)) - 1
                if at >= 0 and pool[at][0] - sizes[i] > gain:
                    gain, best = pool[at][0] - sizes[i], (k, at)
            if best is None:
                break
            k, at = best
            (_, new), old = pool.pop(at), g[k]
            g[k] = new
            bisect.insort(pool, (sizes[old], old))
            room -= gain
    return [i for _, i in pool]


def crossover(sizes: list[int], capacity: int, into: Groups, source: Groups, rng: np.random.Generator) -> Groups:
    """Injects the best filled of a random choice of groups of `source` into `into`."""
    filled = sorted(source, key=lambda g: -sum(sizes[i] for i in g))
    count = max(1, int(len(filled) * rng.uniform(0.2, 0.6)))
    injected = [list(g) for g in filled[:count] if rng.random() < 0.8] or [list(filled[0])]
    taken = {i for g in injected for i in g}
    kept, displaced = [], []
    for g in into:
        if taken.isdisjoint(g):
            kept.append(list(g))
        else:
            displaced += [i for i in g if i not in taken]
    groups = injected + kept
    return best_fit(sizes, capacity, exchange(sizes, capacity, groups, displaced), groups)


def mutate(sizes: list[int], capacity: int, groups: Groups, rng: np.random.Generator) -> Groups:
    """Dissolves the emptiest group and a few others."""
    if len(groups) < 3:
        return groups
    order = sorted(range(len(groups)), key=lambda k: sum(sizes[i] for i in groups[k]))
    gone = {order[0], *rng.choice(len(groups), size=min(len(groups) - 1, 1 + len(groups) // 20), replace=False).tolist()}
    kept = [list(g) for k, g in enumerate(groups) if k not in gone]
    return best_fit(sizes, capacity, exchange(sizes, capacity, kept, [i for k in gone for i in groups[k]]), kept)


def evolve(sizes: list[int], capacity: int, population: list[Groups], rng: np.random.Generator, generations: int = GENERATIONS) -> list[Groups]:
    """The population after some generations, best first. It starts from best-fit solutions if it is empty."""
    items = list(range(len(sizes)))
    if not population:
        population = [best_fit(sizes, capacity, items, [])]
        for _ in range(POPULATION - 1):
            some = rng.permutation(len(items))[: len(items) // 3].tolist()
            start: Groups = []
            for i in some:  # a random first third, each in the first group with room
                if start and sum(sizes[j] for j in start[-1]) + sizes[i] <= capacity:
                    start[-1].append(i)
                else:
                    start.append([i])
            chosen = set(some)
            population.append(best_fit(sizes, capacity, [i for i in items if i not in chosen], start))
    least = max(1, -(-sum(sizes) // capacity))
    by_fitness = lambda scored: sorted(scored, key=lambda s: -s[0])
    ranked = by_fitness([(fitness(sizes, capacity, g), g) for g in population])
    best, waited = ranked[0][0], 0
    for _ in range(generations):
        if len(ranked[0][1]) <= least or waited >= PATIENCE:  # no solution has fewer groups, or none better was found for long
            break
        for _ in range(OFFSPRING):
            a, b = sorted(rng.choice(len(ranked), size=2, replace=len(ranked) < 2).tolist())
            child = crossover(sizes, capacity, ranked[b][1], ranked[a][1], rng)
            child = mutate(sizes, capacity, child, rng) if rng.random() < 0.5 else child
            ranked.append((fitness(sizes, capacity, child), child))
        ranked = by_fitness(ranked)[:POPULATION]
        now = ranked[0][0]
        best, waited = max(best, now), 0 if now > best + 1e-12 else waited + 1
    return [g for _, g in ranked]


def _encode(groups: Groups, n: int) -> list[int]:
    out = [0] * n
    for k, g in enumerate(groups):
        for i in g:
            out[i] = k
    return out


def _decode(code: list[int]) -> Groups:
    groups: dict[int, list[int]] = {}
    for i, k in enumerate(code):
        groups.setdefault(int(k), []).append(i)
    return list(groups.values())


def _epoch(epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for capacity, shard, island, sizes, population in zip(b["capacity"], b["shard"], b["island"], b["sizes"], b["population"], strict=True):
                sizes = [int(s) for s in sizes]
                rng = np.random.default_rng([SEED, epoch, int(capacity), int(shard), int(island)])
                start = [] if population is None else [_decode(p) for p in population]
                ended = evolve(sizes, int(capacity), start, rng)
                rows.append(([_encode(g, len(sizes)) for g in ended], fitness(sizes, int(capacity), ended[0]), len(ended[0])))
            yield b[["container", "capacity", "shard", "island", "sizes"]].assign(population=[r[0] for r in rows], best=[r[1] for r in rows], groups=[r[2] for r in rows])

    return run


_STATE = "container string, capacity int, shard long, island int, sizes array<int>, population array<array<int>>, best double, groups int"


def _pack_round(scratch: Scratch, items: DataFrame, tag: str) -> DataFrame:
    """(container, capacity, doc_id, piece, tokens, bin) of `items`, one round of sharding and evolution."""
    counts = items.groupBy("container").agg(F.count(F.lit(1)).alias("n"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("n") / SHARD_ITEMS))
    spread = items.join(F.broadcast(counts), "container").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(tag)), shards))  # one row per capacity
    grouped = spread.groupBy("container", "capacity", "shard").agg(F.sort_array(F.collect_list(F.struct("tokens", "doc_id", "piece")), asc=False).alias("items"))
    grouped = scratch.save(grouped, f"shards-{tag}")
    key = ["container", "capacity", "shard"]
    state = grouped.select(*key, F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.transform("items", lambda i: i["tokens"].cast("int")).alias("sizes"), F.lit(None).cast("array<array<int>>").alias("population"))
    # evolving is heavy for the bytes it reads: the number of tasks is given, so that adaptive execution does not put them together
    tasks = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    state = state.repartition(tasks, "shard", "island", "container")
    for epoch in range(EPOCHS):
        state = scratch.save(state.mapInPandas(_epoch(epoch), _STATE), f"epoch{epoch}-{tag}")
        if epoch == EPOCHS - 1:
            break
        elite = state.select(*key, F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population")[0].alias("elite"))
        joined = state.join(elite, [*key, "island"]).repartition(tasks, "shard", "island", "container")
        state = joined.select(*key, "island", "sizes", F.concat(F.slice("population", 1, POPULATION - 1), F.array("elite")).alias("population"))
    best = state.groupBy(*key).agg(F.max_by(F.col("population")[0], F.struct(-F.col("groups"), "best", -F.col("island"))).alias("code"))
    placed = grouped.join(best, key).select(*key, F.explode(F.arrays_zip("items", "code")).alias("z"))
    return placed.select("container", "capacity", F.col("z.items.doc_id").alias("doc_id"), F.col("z.items.piece").alias("piece"), F.col("z.items.tokens").alias("tokens"), F.concat_ws("-", F.lit(tag), F.col("shard").cast("string"), F.col("z.code").cast("string")).alias("bin"))


def pieces(documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, capacity, doc_id, piece, tokens): every document once per capacity, cut only where it is above it."""
    sized = token_sizes(documents, ["doc_id"], vocabulary)
    kinds = [(r["container"], r["capacity_tokens"]) for r in capacities.select("container", "capacity_tokens").collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0]  # one row per kind of container
    if not kinds:
        return sized.limit(0).select(F.lit("").alias("container"), F.lit(0).alias("capacity"), "doc_id", F.lit(0).alias("piece"), "tokens")
    each = F.array(*[F.struct(F.lit(name).alias("container"), F.lit(int(capacity)).alias("capacity")) for name, capacity in kinds])
    long = sized.select("doc_id", F.col("tokens").alias("whole"), F.explode(each).alias("c")).select("c.*", "doc_id", "whole")
    last = F.greatest(F.ceil(F.col("whole") / F.col("capacity")).cast("int") - 1, F.lit(0))
    cut = long.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return cut.select("container", "capacity", "doc_id", "piece", F.least(F.col("capacity").cast("long"), F.col("whole") - F.col("piece").cast("long") * F.col("capacity")).alias("tokens"))


def packed(spark: SparkSession, documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, bin, doc_id, piece, tokens): which container of each size holds which document, or piece of one."""
    scratch = Scratch(spark, "packing")
    all_pieces = scratch.save(pieces(documents, capacities, vocabulary), "pieces")
    out = ["container", "bin", "doc_id", "piece", "tokens"]
    done = all_pieces.filter("tokens = capacity").withColumn("bin", F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string"))).select(*out)
    open_items = all_pieces.filter("tokens < capacity")
    for k in range(POOLS + 1):
        placed = scratch.save(_pack_round(scratch, open_items, f"r{k}"), f"placed{k}")
        if k == POOLS:
            return done.unionByName(placed.select(*out))
        filling = placed.groupBy("container", "bin").agg((F.sum("tokens") < FULL * F.first("capacity")).alias("again"))
        judged = placed.join(filling, ["container", "bin"])
        done = done.unionByName(judged.filter("not again").select(*out))
        open_items = scratch.save(judged.filter("again").select("container", "capacity", "doc_id", "piece", "tokens"), f"pool{k}")
    raise AssertionError
