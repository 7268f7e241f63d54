"""Overlays of enrichments on stored matches, erasures, and the lists that keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipworks.functions.query import FLAGS

LINKS = "array<struct<url:string,game:int,title:string>>"
ATTACHMENTS = "array<struct<kind:string,bytes:long,sha256:string>>"
SCHEMA = f"id string, ord long, links {LINKS}, tags array<string>, attachments {ATTACHMENTS}, meta map<string,string>"
#: Reasons for an erasure (fixed values).
REASONS = ["player-request", "contributor-withdrawal", "rights", "legal"]


def merged(records: DataFrame) -> DataFrame:
    """One record per id from several, in the order `ord`: of links with one url and game the first, all tags in order of first mention, of attachments of one kind the last, and meta key by key the last, null included.

    Each part is merged on its own keys before the parts are collected, so no shuffle holds an id's whole history in one value."""
    ids = records.select("id").distinct()
    link = records.select("id", "ord", F.posexplode("links").alias("at", "l")).groupBy("id", F.col("l.url").alias("u"), F.col("l.game").alias("g")).agg(F.min(F.struct("ord", "at", "l")).alias("x"))
    links = link.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]).alias("links"))
    tag = records.select("id", "ord", F.posexplode("tags").alias("at", "t")).groupBy("id", "t").agg(F.min(F.struct("ord", "at")).alias("o"))
    tags = tag.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]).alias("tags"))
    file = records.select("id", "ord", F.explode("attachments").alias("a")).groupBy("id", F.col("a.kind").alias("k")).agg(F.max_by("a", "ord").alias("a"))
    files = file.groupBy("id").agg(F.array_sort(F.collect_list("a")).alias("attachments"))
    value = records.select("id", "ord", F.explode("meta").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "ord").alias("v"))
    meta = value.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("meta"))
    out = ids
    for part in (links, tags, files, meta):
        out = out.join(part, "id", "left")
    empty = {"links": LINKS, "tags": "array<string>", "attachments": ATTACHMENTS}
    return out.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in empty.items()})


def enriched(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """Catalog rows with the flags that links and attachments give, and event, round and date where the overlay has the key."""
    m = merged(records)
    joined = catalog.join(m, "id", "left")
    has = lambda k: F.coalesce(F.map_contains_key("meta", F.lit(k)), F.lit(False))
    bit = lambda test, name: F.when(test, FLAGS[name]).otherwise(0)
    flags = F.coalesce("flags", F.lit(0)).bitwiseOR(bit(F.size(F.coalesce("links", F.array())) > 0, "video")).bitwiseOR(bit(F.size(F.coalesce("attachments", F.array())) > 0, "attachment"))
    fixed = {k: F.when(has(k), F.element_at("meta", F.lit(k))).otherwise(F.col(k)) for k in ("event", "round", "date") if k in catalog.columns}
    return joined.select(*[flags.alias(c) if c == "flags" else fixed[c].alias(c) if c in fixed else F.col(c) for c in catalog.columns])


def additions(have: DataFrame, add: DataFrame) -> DataFrame:
    """(id, links, tags) that `add` brings beyond `have`."""
    pair = add.select("id", F.col("links").alias("nl"), F.col("tags").alias("nt")).join(have.select("id", "links", "tags"), "id", "left")
    known = F.transform(F.coalesce("links", F.array().cast(LINKS)), lambda x: F.struct(x["url"], x["game"]))
    fresh = F.filter(F.coalesce("nl", F.array().cast(LINKS)), lambda x: ~F.array_contains(known, F.struct(x["url"], x["game"])))
    return pair.select("id", fresh.alias("links"), F.array_except(F.coalesce("nt", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>"))).alias("tags")).filter("size(links) > 0 or size(tags) > 0")


def read_erased(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash, id, date, reason) of a tab-separated list; lines that begin with # are comments, and the last entry of a hash counts."""
    raw = spark.read.schema("content_hash string, id string, date string, reason string").option("sep", "\t").option("comment", "#").csv(path)
    w = Window.partitionBy("content_hash").orderBy(F.desc("date"))
    return raw.filter("content_hash is not null").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def read_hash_lists(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash, id, shard) of the lists of shards that lie elsewhere, one file per shard."""
    raw = spark.read.schema("content_hash string, id string").option("sep", "\t").csv(path)
    return raw.select("content_hash", "id", F.regexp_extract(F.input_file_name(), r"([0-9]{4,})[^/]*$", 1).alias("shard"))


def write_hash_list(metas: DataFrame, path: str) -> None:
    metas.select("content_hash", "id").write.mode("overwrite").option("sep", "\t").csv(path)


def erase(matches: DataFrame, erased: DataFrame, ids: list[str], date: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """The matches without those in `ids`, and the erased list with them added. Any notation of an erased match has its hash, so it stays refused."""
    if reason not in REASONS:
        raise ValueError(f"{reason} is none of {', '.join(REASONS)}")
    gone = matches.filter(F.col("id").isin(ids)).select("content_hash", "id", F.lit(date).alias("date"), F.lit(reason).alias("reason"))
    whole = erased.unionByName(gone.join(erased.select("content_hash"), "content_hash", "left_anti"))
    return matches.join(whole.select("content_hash"), "content_hash", "left_anti"), whole
