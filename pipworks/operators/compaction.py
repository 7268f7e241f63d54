"""Size-tiered compaction of small files into containers, with a journal of transactions.

A store is a folder of containers, each one Parquet file holding whole stored files as rows (path, bytes, sha256,
content), and a journal. Level 0 puts new files into containers; each further level merges containers of similar size.
Units (files at level 0, containers above) are put into tiers by size, a factor of `FACTOR` apart, and the units of a
tier are laid one after another into containers of at most `target` bytes and `fan_in` units. A container of half the
target or more is full and is never read again by a merge; a tier of fewer than `LEAST` containers waits. So a batch of
small files rewrites the small containers it can join and nothing else, and what is written stays small: each record
moves at most once per tier.

One level is one transaction: its inputs and outputs are written to the journal, then a commit marker, then a new head
that lists the transactions in force. Heads are numbered and never written over, so a crash between two steps leaves the
head before. A transaction's id is a digest of its level and inputs, so a repeated or interrupted run finds the committed
ones, redoes the rest under the same names and never doubles a record. A file that comes again with other content takes
the place of the one held: its old row is listed in the journal as replaced, is not read any more, and is left out when
its container is merged. A reader follows the journal, not the folder.

Statistics per tier (at most 64 rows) are all that reaches the driver. Files are laid out in groups of about `GROUP`
containers, so a pass is one shuffle of the data it merges and no running total goes over all files.

Defined cases: the same file seen twice, also under another way of writing its path, is stored once (the sighting with
the latest modified_at, then the highest file_no); empty files are stored with 0 bytes; a null path is no file; null
content counts as empty; an empty table gives an empty store; a file above the target has a container of its own.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipworks.storage import delete, exists, names, read_text, write_text

MB = 1 << 20
TARGET = 128 * MB
#: Units in a container at most.
FAN_IN = 1024
#: Ratio of sizes within a tier.
FACTOR = 8
#: Containers of a tier from which on they are merged.
LEAST = 4
#: Containers laid out by one task.
GROUP = 16
STORED = ["path", "file_no", "bytes", "sha256", "content"]


def plain_path(path: Column) -> Column:
    """One way of writing a path: forward slashes, no empty or `.` segments, no slash at either end."""
    slashes = F.regexp_replace(path, r"\\", "/")
    return F.regexp_replace(F.regexp_replace(slashes, r"(?:(?<=/)|^)(?:\.?/)+", ""), r"/\.?$", "")


def stored_files(files: DataFrame) -> DataFrame:
    """Each file once, of all sightings in `files` (path, file_no, content, modified_at)."""
    content = F.coalesce(F.col("content"), F.lit(""))
    seen = files.filter(F.col("path").isNotNull()).select(plain_path(F.col("path")).alias("path"), "file_no", content.alias("content"), F.coalesce("modified_at", F.lit("1970-01-01").cast("timestamp")).alias("modified_at"))
    latest = F.max_by(F.struct("file_no", "content"), F.struct("modified_at", "file_no"))
    once = seen.groupBy("path").agg(latest.alias("f"))
    return once.select("path", F.col("f.file_no").alias("file_no"), F.octet_length("f.content").cast("long").alias("bytes"), F.sha2("f.content", 256).alias("sha256"), F.col("f.content").alias("content"))


@dataclass(frozen=True)
class Tier:
    """Units of similar size, and how they are laid into containers."""

    tier: int
    units: int
    files: int
    bytes: int
    largest: int
    target: int
    fan_in: int

    @property
    def room(self) -> int:
        """Bytes after which a container is closed, so that the unit that crosses it still fits."""
        return max(1, self.target - self.largest)

    @property
    def groups(self) -> int:
        return max(1, -(-self.bytes // (GROUP * self.room)), -(-self.units // (GROUP * self.fan_in)))


class CompactionStore:
    """Containers and journal under one folder of the shared storage."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in

    # Journal

    def _marker(self, txn: str) -> str:
        return f"{self.root}/journal/{txn}/committed.json"

    def committed(self, txn: str) -> dict | None:
        return json.loads(read_text(self.spark, self._marker(txn))) if exists(self.spark, self._marker(txn)) else None

    def _heads(self) -> list[str]:
        return sorted(n for n in names(self.spark, f"{self.root}/journal/heads") if n.endswith(".json"))

    def _head(self) -> list[str]:
        """Transactions in force, in order: those of the highest head."""
        heads = self._heads()
        return json.loads(read_text(self.spark, f"{self.root}/journal/heads/{heads[-1]}")) if heads else []

    def _set_head(self, txns: list[str]) -> None:
        heads = self._heads()
        number = int(heads[-1].split(".")[0]) + 1 if heads else 1
        write_text(self.spark, f"{self.root}/journal/heads/{number:010d}.json", json.dumps(txns))
        for old in heads[:-1]:  # the one before stays for readers that have just seen it
            delete(self.spark, f"{self.root}/journal/heads/{old}")

    def journal(self, txn: str, side: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/journal/{txn}/{side}")

    # Reading

    def _data(self, txn: str) -> DataFrame:
        """Files written by one transaction; `unit` names their container across transactions."""
        schema = "path string, file_no long, bytes long, sha256 string, content string, container string"
        read = self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{txn}").parquet(f"{self.root}/data/{txn}")
        return read.withColumn("unit", F.concat(F.lit(txn + "/"), F.col("container")))

    def replaced(self) -> DataFrame | None:
        """(unit, path, bytes) of stored files whose place was taken by a later one; None if there are none."""
        found = None
        for txn in self._head():
            if (self.committed(txn) or {}).get("replaced"):
                rows = self.journal(txn, "replaced")
                found = rows if found is None else found.unionByName(rows)
        return found

    def containers(self) -> DataFrame:
        """Current containers: unit (transaction/name), level, files and bytes that count: all outputs in the journal that no later transaction took in, without replaced files."""
        out = self.spark.createDataFrame([], "unit string, level int, files long, bytes long")
        taken = self.spark.createDataFrame([], "unit string")
        for txn in self._head():
            out = out.unionByName(self.journal(txn, "outputs"))
            if not txn.startswith("l0-"):
                taken = taken.unionByName(self.journal(txn, "inputs").select("unit"))
        current, gone = out.join(taken, "unit", "left_anti"), self.replaced()
        if gone is None:
            return current
        lost = gone.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
        less = lambda have, gone: (F.col(have) - F.coalesce(gone, F.lit(0))).alias(have)
        return current.join(lost, "unit", "left").select("unit", "level", less("files", "n"), less("bytes", "b"))

    def files(self) -> DataFrame:
        """All stored files, each once, with the container (`unit`) that holds them."""
        out = self.spark.createDataFrame([], "path string, file_no long, bytes long, sha256 string, content string, unit string")
        for txn in self._head():
            if exists(self.spark, f"{self.root}/data/{txn}"):  # else all of it was taken in
                out = out.unionByName(self._data(txn).drop("container"))
        live, gone = out.join(self.containers().select("unit"), "unit", "left_semi"), self.replaced()
        return live if gone is None else live.join(gone.select("unit", "path"), ["unit", "path"], "left_anti")

    # Writing

    def _tier(self) -> Column:
        return F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1))) / F.log(F.lit(float(FACTOR))) + 1e-9).cast("int")

    def _lot(self, tiers: dict[int, Tier]) -> Column:
        """Container of a unit: units of a group are laid one after another, and a container is closed when its bytes or its units are full."""
        of = lambda value: F.element_at(F.create_map(*[F.lit(x) for t in tiers.values() for x in (t.tier, value(t))]), F.col("tier"))
        before = Window.partitionBy("tier", "group").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
        laid = F.coalesce(F.sum("bytes").over(before), F.lit(0)) / of(lambda t: t.room) + F.count("unit").over(before) / F.lit(self.fan_in)
        return F.format_string("t%02d-%06d-%04d", F.col("tier"), F.col("group"), F.floor(laid).cast("int"))

    def _merge(self, level: int, files: DataFrame, units: DataFrame, replaced: DataFrame | None = None) -> str | None:
        """One transaction: moves the `files` of the tiers of `units` (unit, files, bytes) into new containers. None if there is nothing to do.

        At level 0 the units are the files themselves and all of them are stored, also those of a tier that can't be merged.
        """
        sized = units.withColumn("tier", self._tier())
        if level:
            sized = sized.filter(2 * F.col("bytes") < self.target)
        rows = sized.groupBy("tier").agg(
            F.count(F.lit(1)).alias("n"), F.sum("files").alias("f"), F.sum("bytes").alias("b"), F.max("bytes").alias("largest"),
            F.sum(F.xxhash64("unit", "bytes", "mark").cast("decimal(38,0)")).alias("digest"),
        ).collect()
        tiers = {r["tier"]: Tier(r["tier"], r["n"], r["f"], int(r["b"] or 0), int(r["largest"] or 0), self.target, self.fan_in) for r in rows}
        tiers = {k: t for k, t in tiers.items() if level == 0 or t.units >= LEAST}
        if not tiers:
            return None
        state = json.dumps([level, self.target, self.fan_in, sorted((r["tier"], r["n"], int(r["b"] or 0), str(r["digest"])) for r in rows if r["tier"] in tiers)])
        txn = f"l{level}-{hashlib.sha256(state.encode()).hexdigest()[:16]}"
        if self.committed(txn):
            return txn
        groups = F.element_at(F.create_map(*[F.lit(x) for t in tiers.values() for x in (t.tier, t.groups)]), F.col("tier"))
        in_group = F.pmod(F.xxhash64("unit"), groups.cast("long")).cast("int")
        delete(self.spark, f"{self.root}/data/{txn}")  # what an interrupted attempt left
        chosen = sized.filter(F.col("tier").isin(*tiers)).withColumn("group", in_group)
        if level == 0:  # laid out where they are written: one shuffle
            tasks = sum(t.groups for t in tiers.values())
            laid = files.withColumn("tier", self._tier()).withColumn("group", in_group).repartition(tasks, "tier", "group")
            placed = laid.select(*STORED, self._lot(tiers).alias("container"))
        else:
            placed = files.join(chosen.select("unit", self._lot(tiers).alias("container")), "unit").select(*STORED, "container")
            placed = placed.repartition(sum(t.groups for t in tiers.values()) * GROUP if sum(t.bytes for t in tiers.values()) > self.target else len(tiers), "container")
        placed.write.partitionBy("container").parquet(f"{self.root}/data/{txn}")
        made = self._data(txn).groupBy("unit").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
        made.select("unit", F.lit(level).alias("level"), "files", "bytes").write.mode("overwrite").parquet(f"{self.root}/journal/{txn}/outputs")
        chosen.select("unit", "bytes").write.mode("overwrite").parquet(f"{self.root}/journal/{txn}/inputs")
        gone = 0
        if replaced is not None:
            replaced.write.mode("overwrite").parquet(f"{self.root}/journal/{txn}/replaced")
            gone = self.journal(txn, "replaced").count()
        total = self.journal(txn, "outputs").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("containers")).first()
        expected = sum(t.files for t in tiers.values()), sum(t.bytes for t in tiers.values())
        if (int(total["files"] or 0), int(total["bytes"] or 0)) != expected:
            raise RuntimeError(f"transaction {txn} wrote {total['files']} files and {total['bytes']} bytes of {expected}")
        write_text(self.spark, self._marker(txn), json.dumps({"level": level, "files": expected[0], "bytes": expected[1], "containers": total["containers"], "replaced": gone}))
        return txn

    def _tidy(self) -> None:
        """Removes the data of transactions whose containers were all taken into later ones. The journal stays."""
        current = {r[0] for r in self.containers().select(F.substring_index("unit", "/", 1)).distinct().collect()}
        for txn in self._head():
            if txn not in current:
                delete(self.spark, f"{self.root}/data/{txn}")

    def compact(self, incoming: DataFrame) -> list[str]:
        """Stores those of `incoming` (the columns of STORED, each path once) that are not held yet, in place of an older content if there is one, and merges until no tier can be merged further. Returns the transactions committed now, in order."""
        held = self._head()
        files, replaced = incoming.withColumn("unit", F.col("path")), None
        if held:
            have = self.files().select("path", F.col("sha256").alias("had"), F.col("unit").alias("old"), F.col("bytes").alias("old_bytes"))
            files = files.join(have, "path", "left").filter(~F.col("had").eqNullSafe(F.col("sha256")))
            replaced = files.filter("had is not null").select(F.col("old").alias("unit"), "path", F.col("old_bytes").alias("bytes"))
        done: list[str] = []
        level = 0
        while True:
            if level == 0:
                txn = self._merge(0, files.select("unit", *STORED), files.select("unit", F.lit(1).alias("files"), "bytes", F.col("sha256").alias("mark")), replaced)
            else:
                txn = self._merge(level, self.files(), self.containers().select("unit", "files", "bytes", F.lit("").alias("mark")))
            if txn is None and level > 0:
                return done
            if txn is not None and txn not in held:
                held = [*held, txn]
                self._set_head(held)
                done.append(txn)
                if level:
                    self._tidy()
            level += 1


def listing_issues(paths: DataFrame, files: DataFrame) -> DataFrame:
    """What is wrong between the lists of `paths` (id, mat, meta) and the stored files, one row each: kind and path.

    `missing`: listed, but no file. `unlisted`: a file that no list names. `listed_twice`: named more than once. `seen_twice`: more than one sighting. `empty`: a stored file of 0 bytes.
    """
    listed = paths.select(F.explode(F.array("mat", "meta")).alias("path")).filter("path is not null").select(plain_path(F.col("path")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("listed"))
    seen = files.filter("path is not null").groupBy(plain_path(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("seen"), F.max(F.octet_length(F.coalesce("content", F.lit("")))).alias("bytes"))
    both = listed.join(seen, "path", "full_outer")
    kinds = F.array(
        F.when(F.col("seen").isNull(), "missing"), F.when(F.col("listed").isNull(), "unlisted"), F.when(F.col("listed") > 1, "listed_twice"),
        F.when(F.col("seen") > 1, "seen_twice"), F.when(F.col("bytes") == 0, "empty"),
    )
    return both.select(F.explode(F.array_compact(kinds)).alias("kind"), "path")
