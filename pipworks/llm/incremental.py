"""Checking each new batch of matches against everything accepted so far, without going over the history again.

`MatchHistory` keeps three tables in the shared folder, each cut into parts of bounded size:

* the accepted rows, in parts of neighbouring row numbers;
* the blocking keys, one entry per key and distinct value, in parts by key;
* pointers of a union-find over rows, from a row to an earlier row of its match; only linked rows have one.

`accept` adds a batch. Its own keys name the parts of the key table that can hold a partner, and only those are read; the
candidates found name the parts of the row table to read. Rows read so grow with the batch: a part is read only if the
batch has a key in it. Candidates are scored with weights learned from the comparisons of the first batch that meets the
history (an EM fit of match and non-match frequencies over comparison patterns). Patterns that hardly any match shows are
no link, by the error bound `LOST`; all others are checked exactly: equal hashes, or at least SAME_ROLLS of the rolls of
the longer sequence in common, in order. Then pointers are written for the clusters that were touched, and no others.

Blocking keys are the start of the hash, the whole sequence of rolls, and selected runs of rolls: of the runs of `GRAM`
rolls, the one with the least hash in every window of `WINDOW` neighbouring runs. Sequences with GRAM + WINDOW - 1 = 8
equal rolls in a row therefore always share a key, and of 32 or more rolls any two that differ by at most a tenth of the
rolls, each replaced or left out, have such a stretch. Sequences of fewer than `SHORT` rolls also have every run of five
as a key, which does the same for them. In a link the stretch lies at most a tenth of the rolls further on in one
sequence than in the other, and the lengths differ by at most a tenth; entries that fail this are never fetched.

A match that makes up much of the history, with one and the same sequence or hash, is one entry under each of its keys
and is compared once. A key of many different sequences is met by a scan of its part, which is cut by file splits and
never gathered in one task.

Defined cases: rows without a content hash are known by the hex part of their id; without rolls only the hash counts; a
row with neither an id, a hash nor rolls repeats nothing; fewer than ten rolls are compared only if equal; repeated rows
repeat the first of them; a batch may be empty; the order of rows is (batch, position), of the first batch (time, id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipworks.llm.covering import mix
from pipworks.llm.sequences import common, lcs_length
from pipworks.operators.components import components
from pipworks.storage import Scratch

SAME_ROLLS = 0.9
#: Rolls in a run, and neighbouring runs of which one is selected.
GRAM, WINDOW = 6, 3
#: Sequences with fewer rolls have all runs of SHORT_GRAM rolls as keys besides.
SHORT, SHORT_GRAM = 32, 5
#: Key entries and rows in a part of the stored tables.
KEYS_PER_PART, ROWS_PER_PART = 400_000, 1 << 14
#: Most parts of the key table; beyond, parts grow.
MOST_PARTS = 20_000
#: Key entries of a batch (48 bytes each) up to which they are sent to every executor; beyond, keys are shuffled.
SENT_ENTRIES = 500_000
#: Share of the matches that may lie below the score from which candidates are checked.
LOST = 1e-5

ROW = "node long, batch int, seq long, id string, hash string, hex string, rolls string"
ENTRY = "node long, key long, ident long, runs int, size int, at int"


def hex_of(text: Column) -> Column:
    """The hexadecimal digits of a hash in any writing; null if there are none."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^(?:sha-?256|0x)\s*[:=]?\s*", ""), "[^0-9a-f]", "")
    return F.nullif(bare, F.lit(""))


def rolls_of(text: Column) -> Column:
    """Rolls with the larger die first and one blank between; null if there are none."""
    flat = F.regexp_replace(F.trim(text), r"[^0-9]+", " ")
    sorted_dice = F.transform(
        F.split(F.trim(flat), " "),
        lambda r: F.when(F.substring(r, 1, 1) < F.substring(r, 2, 1), F.reverse(r)).otherwise(r),
    )
    return F.nullif(F.array_join(sorted_dice, " "), F.lit(""))


def prepared(rows: DataFrame, batch: int, seq: Column) -> DataFrame:
    """Rows (id, content_hash, rolls) in the form that the history keeps, without node numbers."""
    after = F.element_at(F.split(F.col("id"), "/"), -1)
    return rows.select(
        F.lit(batch).alias("batch"), seq.cast("long").alias("seq"), "id",
        hex_of(F.col("content_hash")).alias("hash"), hex_of(after).alias("hex"), rolls_of(F.col("rolls")).alias("rolls"),
    )


def _exact_keys(rows: DataFrame) -> DataFrame:
    """(node, key, ident) for the start of the hash and for the whole sequence of rolls; rows of one ident are the same."""
    full = F.coalesce("hash", "hex")
    start = F.substring(full, 1, 16)
    entry = lambda key, ident: F.struct(key.alias("key"), ident.alias("ident"))
    keys = F.array(
        F.when(start.isNotNull(), entry(F.xxhash64(F.lit("hash"), start), F.xxhash64(full, F.col("hash").isNull()))),
        F.when(F.col("rolls").isNotNull(), entry(F.xxhash64(F.lit("rolls"), "rolls"), F.xxhash64("rolls"))),
    )
    return rows.select("node", F.explode(F.array_compact(keys)).alias("k")).select("node", "k.key", "k.ident")


def _runs(codes: np.ndarray, owner: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run of `gram` codes from each position, and whether it lies within one sequence."""
    whole = len(codes) - gram + 1
    if whole <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    packed = np.zeros(whole, np.uint64)
    for k in range(gram):
        packed = packed * np.uint64(101) + codes[k : k + whole]
    return mix(packed + np.uint64(gram)), owner[:whole] == owner[gram - 1 :]


def run_keys(sequences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the sequence, key, position) of the selected runs of many sequences, position 1 first."""
    parts = [s.split(" ") for s in sequences]
    sizes = np.array([len(p) for p in parts])
    codes = np.array([int(r) for p in parts for r in p], dtype=np.uint64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    hashes, inside = _runs(codes, owner, GRAM)
    chosen = np.zeros(len(hashes), bool)
    windows = len(hashes) - WINDOW + 1
    if windows > 0:
        least = np.stack([hashes[k : k + windows] for k in range(WINDOW)]).argmin(axis=0)
        full = inside[:windows] & inside[WINDOW - 1 :] & (owner[:windows] == owner[WINDOW - 1 : WINDOW - 1 + windows])
        chosen[(np.arange(windows) + least)[full]] = True
    picked = np.flatnonzero(chosen)
    short, within = _runs(codes, owner, SHORT_GRAM)
    extra = np.flatnonzero(within & (sizes[owner[: len(short)]] < SHORT)) if len(short) else np.empty(0, int)
    where = np.concatenate([picked, extra])
    keys = np.concatenate([hashes[picked], short[extra]]) if len(where) else np.empty(0, np.uint64)
    return owner[where], keys.view(np.int64), at[where]


def _run_entries(sequences: DataFrame) -> DataFrame:
    """Entries for the selected runs of distinct sequences (node, rolls)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            owner, keys, at = run_keys(list(batch["rolls"]))
            many = np.bincount(owner, minlength=len(batch)).astype(np.int32)
            sizes = (batch["rolls"].str.count(" ") + 1).to_numpy(np.int32)
            take = lambda c: batch[c].to_numpy()[owner]
            yield pd.DataFrame({"node": take("node"), "key": keys, "ident": take("ident"), "runs": many[owner], "size": sizes[owner], "at": at.astype(np.int32)})

    return sequences.select("node", "rolls", F.xxhash64("rolls").alias("ident")).mapInPandas(run, ENTRY)


def hash_relation(hash_a: Column, hex_a: Column, hash_b: Column, hex_b: Column) -> Column:
    """agree, differ or unknown. Where one side has only the start of a hash, agreeing means that the other begins with it."""
    full_a, full_b = F.coalesce(hash_a, hex_a), F.coalesce(hash_b, hex_b)
    both = hash_a.isNotNull() & hash_b.isNotNull()
    begins = F.startswith(full_a, full_b) | F.startswith(full_b, full_a)
    agree = F.when(both, hash_a == hash_b).otherwise(begins)
    return F.when(full_a.isNull() | full_b.isNull(), "unknown").when(agree, "agree").otherwise("differ")


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that are one match, with the share of the longer sequence of rolls that both have in common, in order."""
    for b in batches:
        holds, shares = [], []
        for relation, x, y in zip(b["relation"], b["rolls_a"], b["rolls_b"], strict=True):
            share = None
            if x is not None and y is not None:
                x, y = x.split(" "), y.split(" ")
                longer = max(len(x), len(y))
                # what can't reach the limit needs no exact share, unless the hash decides and it is only reported
                if relation == "agree" or common(x, y) >= SAME_ROLLS * longer - 1e-9:
                    share = lcs_length(x, y) / longer
            holds.append(relation == "agree" or (share is not None and share >= SAME_ROLLS - 1e-9))
            shares.append(share)
        out = pd.DataFrame({"a": b["a"], "b": b["b"], "relation": b["relation"], "share": pd.array(shares, dtype="Float64"), "weight": b["weight"]})
        yield out[np.array(holds, dtype=bool)]


PATTERNS = (("relation", ("agree", "differ", "unknown")), ("tenth", range(-1, 11)))


def chance(rows: int, hashed: int, rolled: int) -> list[dict]:
    """Frequencies of outcomes among pairs of unrelated rows, of `rows` of which so many have a hash and rolls: what agrees by chance has one part in `rows`."""
    rare = 1 / max(rows, 2)
    known, both = (hashed / max(rows, 1)) ** 2, (rolled / max(rows, 1)) ** 2
    u = [{"agree": rare, "differ": known, "unknown": 1 - known}, {t: 1 - both if t < 0 else both if t == 0 else rare for t in range(-1, 11)}]
    return [{v: max(p, rare) / sum(max(x, rare) for x in f.values()) for v, p in f.items()} for f in u]


def fit_weights(patterns: dict[tuple[str, int], int], u: list[dict], rounds: int = 50) -> tuple[dict[str, dict], float]:
    """Log-odds weights of the outcomes of each field, and the least score that is checked.

    EM over counted comparison patterns: the relation of the hashes, and the tenth of the longer sequence's selected runs
    that both have (-1: not known); `u` holds what chance gives, and matches are what it does not explain. The score is
    the largest below which patterns hold at most LOST of all matches.
    """
    m = [{"agree": 0.6, "differ": 0.3, "unknown": 0.1}, dict.fromkeys(range(-1, 11), 1 / 12)]
    prior, total = 0.5, sum(patterns.values())
    for _ in range(rounds if total else 0):
        sums, matched = [dict.fromkeys(f, 0.1) for f in m], 0.0
        for pattern, n in patterns.items():
            p = prior * math.prod(m[i][v] for i, v in enumerate(pattern))
            q = (1 - prior) * math.prod(u[i][v] for i, v in enumerate(pattern))
            share = n * p / (p + q)
            matched += share
            for i, v in enumerate(pattern):
                sums[i][v] += share
        m = [{v: c / sum(f.values()) for v, c in f.items()} for f in sums]
        prior = min(max(matched / total, 0.001), 0.999)
    weights = {name: {v: math.log2(m[i][v] / u[i][v]) for v in m[i]} for i, (name, _) in enumerate(PATTERNS)}
    scored = sorted((weights["relation"][r] + weights["tenth"][t], m[0][r] * m[1][t]) for r in m[0] for t in m[1])
    least, below = scored[0][0], 0.0
    for score, share in scored:
        least = score
        below += share
        if below > LOST:
            break
    return weights, least


class MatchHistory:
    """Accepted matches, their blocking keys and the pointers between rows of one match. `read` counts the parts read."""

    def __init__(self, spark: SparkSession, keys_per_part: int = KEYS_PER_PART, row_bits: int = ROWS_PER_PART.bit_length() - 1):
        self.spark, self.keys_per_part, self.row_bits = spark, keys_per_part, row_bits
        self.scratch = Scratch(spark, "history")
        self.parts = 0
        self.batches: list[int] = []
        self.pointers: list[str] = []
        self.weights: dict[str, dict] | None = None
        self.least: float | None = None
        self.read: list[dict[str, int]] = []

    def rows(self) -> DataFrame:
        """All accepted rows; `part` is a folder of neighbouring ones."""
        return self.spark.read.schema(ROW + ", part long").parquet(self.scratch.path("rows"))

    def keys(self) -> DataFrame:
        return self.spark.read.schema(ENTRY + ", part int").parquet(self.scratch.path("keys"))

    def _store_rows(self, rows: DataFrame) -> None:
        rows.withColumn("part", F.shiftright("node", self.row_bits)).write.mode("append").partitionBy("part").parquet(self.scratch.path("rows"))

    def _store_keys(self, entries: DataFrame) -> None:
        tasks = min(self.parts, 200)
        entries.repartition(tasks, "part").write.mode("append").partitionBy("part").parquet(self.scratch.path("keys"))

    def _pointers(self) -> DataFrame:
        """(child, parent) pointers of all batches; parents are earlier rows."""
        schema = "child long, parent long"
        return self.spark.read.schema(schema).parquet(*self.pointers) if self.pointers else self.spark.createDataFrame([], schema)

    def accept(self, incoming: DataFrame, batch: int) -> DataFrame:
        """Adds a batch, rows as from `prepared`; returns its links (a, b, relation, share, weight), b being the earlier row."""
        base, first = F.lit(batch * (1 << 52)), not self.batches
        if first:
            sorted_rows = incoming.repartitionByRange(F.col("seq"), F.col("id")).sortWithinPartitions("seq", "id")
            numbered = sorted_rows.withColumn("node", base + F.monotonically_increasing_id())
        else:  # seq is a row number
            numbered = incoming.withColumn("node", base + F.col("seq"))
        new = self.scratch.save(numbered.select("node", "batch", "seq", "id", "hash", "hex", "rolls"), f"new/{batch}")
        self._store_rows(new)
        self.batches.append(batch)
        exact = _exact_keys(new)
        none = F.lit(None).cast("int")
        whole = exact.groupBy("key", "ident").agg(F.min("node").alias("node")).select("node", "key", "ident", none.alias("runs"), none.alias("size"), none.alias("at"))
        runs = _run_entries(new.filter("rolls is not null").groupBy("rolls").agg(F.min("node").alias("node")))
        entries = self.scratch.save(whole.unionByName(runs), f"entries/{batch}")
        if first:
            self.parts = max(1, min(MOST_PARTS, -(-entries.count() // self.keys_per_part)))
        placed = entries.withColumn("part", F.pmod("key", F.lit(self.parts)).cast("int"))
        met = self._met(placed, batch, first)
        copies = exact.join(entries.select("key", "ident", F.col("node").alias("other")), ["key", "ident"]).filter("other < node")
        links = self._links(new, met, copies, batch)
        known = met.filter("known").select("node", F.explode("idents").alias("ident")).distinct()
        self._store_keys(placed if first else placed.join(known, ["node", "ident"], "left_anti"))
        return links

    def _met(self, probe: DataFrame, batch: int, first: bool) -> DataFrame:
        """(node, other, tenth, known, idents) of every earlier entry that shares a key and can be of one match with an entry of the batch."""
        counted = {r["part"]: r["n"] for r in probe.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_PARTS
        if first:  # rows accepted before are told apart by hashes and whole sequences only
            probe, counted = probe.filter("size is null"), {}
        mine = probe.select("node", "key", "ident", "runs", "size", "at")
        stored = mine if first else mine.unionByName(self.keys().filter(F.col("part").isin(*counted)).drop("part"))
        theirs = stored.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "ident", "runs", "size", "at")])
        if 0 < sum(counted.values()) <= SENT_ENTRIES:
            mine = F.broadcast(mine)
        long, short = F.greatest("size", "size_b"), F.least("size", "size_b")
        within = (1 - SAME_ROLLS) * long + 1e-9
        fits = F.col("size").isNull() | ((long - short <= within) & (F.abs(F.col("at") - F.col("at_b")) <= within))
        same = F.col("ident") == F.col("ident_b")
        pairs = theirs.join(mine, "key").filter((F.col("node_b") < F.col("node")) & fits)
        found = pairs.groupBy("node", F.col("node_b").alias("other")).agg(
            (F.count("size") / F.max(F.greatest("runs", "runs_b"))).alias("share"),
            F.bool_or(same).alias("known"), F.collect_set(F.when(same, F.col("ident"))).alias("idents"),
        )
        tenth = F.coalesce(F.floor(F.least(F.col("share"), F.lit(1.0)) * 10 + 1e-9), F.lit(-1)).cast("int")
        self.read.append({"batch": batch, "key_parts": len(counted)})
        return self.scratch.save(found.select("node", "other", tenth.alias("tenth"), "known", "idents"), f"met/{batch}")

    def _links(self, new: DataFrame, met: DataFrame, copies: DataFrame, batch: int) -> DataFrame:
        near = met.select("node", "other", "tenth").unionByName(copies.select("node", "other", F.lit(-1).alias("tenth")))
        near = self.scratch.save(near.groupBy(F.col("node").alias("a"), F.col("other").alias("b")).agg(F.max("tenth").alias("tenth")), f"near/{batch}")
        wanted = [r[0] for r in near.select(F.shiftright("b", self.row_bits)).distinct().collect()]  # row parts, ROWS_PER_PART rows each
        self.read[-1]["row_parts"] = len(wanted)
        side = lambda df, name: df.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("hash", "hex", "rolls")])
        both = near.join(side(new, "a"), "a").join(side(self.rows().filter(F.col("part").isin(*wanted)), "b"), "b")
        relation = hash_relation(F.col("hash_a"), F.col("hex_a"), F.col("hash_b"), F.col("hex_b"))
        pairs = self.scratch.save(both.select("a", "b", relation.alias("relation"), "tenth", "rolls_a", "rolls_b"), f"pairs/{batch}")
        if self.weights is None and batch > 0:
            counted = pairs.groupBy("relation", "tenth").count().collect()  # at most 3 x 12 patterns
            if counted:
                n = new.agg(F.count(F.lit(1)).alias("rows"), F.count(F.coalesce("hash", "hex")).alias("hashed"), F.count("rolls").alias("rolled")).first()
                self.weights, self.least = fit_weights({(r["relation"], r["tenth"]): r["count"] for r in counted}, chance(n["rows"], n["hashed"], n["rolled"]))
        score = F.lit(0.0)
        for name, _ in PATTERNS:
            for value, w in (self.weights or {}).get(name, {}).items():
                score = score + F.when(F.col(name) == F.lit(value), F.lit(w)).otherwise(F.lit(0.0))
        scored = pairs.withColumn("weight", score)
        if self.least is not None:
            scored = scored.filter(F.col("weight") >= self.least - 1e-9)
        checked = scored.select("a", "b", "relation", "rolls_a", "rolls_b", "weight")
        links = self.scratch.save(checked.mapInPandas(_check, "a long, b long, relation string, share double, weight double"), f"links/{batch}")
        self._unite(links, batch)
        for name in ("near", "pairs", "new", "entries"):
            if batch and len(self.batches) > 1:
                self.scratch.drop(f"{name}/{self.batches[-2]}")
        return links

    def _unite(self, links: DataFrame, batch: int) -> None:
        """Points each linked row to the earliest row its partners point to, and these to that one. No other cluster is read or written."""
        known = self._pointers().groupBy("child").agg(F.min("parent").alias("parent"))
        ends = links.join(known.withColumnRenamed("child", "b"), "b", "left").select("a", F.coalesce("parent", "b").alias("r"))
        low = ends.withColumn("low", F.min("r").over(Window.partitionBy("a")))
        pointer = lambda child: F.struct(F.col(child).alias("child"), F.col("low").alias("parent"))
        path = self.scratch.path(f"pointers/{batch}")
        low.select(F.explode(F.array(pointer("a"), pointer("r"))).alias("p")).select("p.child", "p.parent").filter("child <> parent").distinct().write.parquet(path)
        self.pointers.append(path)

    def representatives(self) -> DataFrame:
        """(node, root) of every row of a cluster of more than one: pointers followed to their ends, and clusters that share a row joined."""
        return components(self.spark, self._pointers(), "child", "parent")

    def repeats(self) -> DataFrame:
        """(batch, seq, first_id) of every row that repeats an earlier one: the id, as written, of the first row of its match."""
        rows = self.rows()
        ends = self.scratch.save(self.representatives().filter("root < node"), "repeats")
        member = ends.join(rows.select("node", "batch", "seq"), "node")
        return member.join(rows.select(F.col("node").alias("root"), F.col("id").alias("first_id")), "root").select("batch", "seq", "first_id")


def repeated_matches(spark: SparkSession, hashes: DataFrame, metas: DataFrame) -> DataFrame:
    """(row_id, first_id) of the rows of metas that repeat a row of hashes or an earlier row of metas; batches are accepted in order."""
    history = MatchHistory(spark)
    accepted = F.coalesce("accepted_at", F.lit("1970-01-01").cast("timestamp"))
    history.accept(prepared(hashes, 0, F.unix_micros(accepted)), 0)
    numbers = sorted(r[0] for r in metas.select("batch_no").distinct().collect() if r[0] is not None)
    for number in numbers:  # one per delivered batch
        history.accept(prepared(metas.filter(F.col("batch_no") == number), int(number), F.col("row_id")), int(number))
    return history.repeats().filter("batch > 0").select(F.col("seq").alias("row_id"), "first_id")
