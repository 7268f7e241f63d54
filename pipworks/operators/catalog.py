"""Operators on the catalog: order, pages, facets, suggestions, dictionary codes, summaries, overlays and identity lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipworks.functions.query import FLAGS, parse, predicate
from pipworks.functions.text import display_key, natural_key, normalise, year_of
from pipworks.operators.ranking import global_rank

PAGE = 50


def found(catalog: DataFrame, text: str) -> DataFrame:
    return catalog.filter(predicate(parse(text)))


def result_order() -> list[Column]:
    """Date descending with undated rows last, then event, then round by numbers, then id."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.nullif(F.col("date"), F.lit("")).desc_nulls_last(), normalise(blank("event")), natural_key(normalise(blank("round"))), F.col("id"), F.col("row_id")]


def page(catalog: DataFrame, text: str, number: int, size: int = PAGE) -> DataFrame:
    """One page of results, planned as a top-k of the rows up to its end."""
    return found(catalog, text).orderBy(*result_order()).limit(number * size).offset((number - 1) * size)


def sides(catalog: DataFrame) -> DataFrame:
    """One row per side with a name: its display and normal form, with the keys of the row."""
    both = F.array(F.struct(F.col("p0").alias("name"), F.col("n0").alias("norm")), F.struct(F.col("p1").alias("name"), F.col("n1").alias("norm")))
    return catalog.select("row_id", F.posexplode(both).alias("side", "s")).select("row_id", "side", "s.name", "s.norm").filter("norm is not null and norm <> ''")


def player_facet(catalog: DataFrame) -> DataFrame:
    """(norm, name, matches) of every player; the display form is that of the first row."""
    return sides(catalog).groupBy("norm").agg(F.min_by("name", F.struct("row_id", "side")).alias("name"), F.count(F.lit(1)).alias("matches"))


def value_facet(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def suggest_players(players: DataFrame, fragment: str, limit: int = 8) -> DataFrame:
    """Players with a word that begins with the fragment, then those that contain it; the most frequent first."""
    want = normalise(F.lit(fragment))
    starts = F.contains(F.concat(F.lit(" "), "norm"), F.concat(F.lit(" "), want))
    if len(fragment.strip()) < 2:
        return players.limit(0).withColumn("place", F.lit(0))
    hit = players.filter(F.contains("norm", want)).withColumn("place", F.when(starts, 0).otherwise(1))
    return hit.orderBy("place", F.desc("matches"), "norm").limit(limit)


def suggest_values(values: DataFrame, fragment: str, limit: int = 8) -> DataFrame:
    return values.filter(F.contains(normalise(F.col("value")), normalise(F.lit(fragment)))).orderBy("value").limit(limit)


def dictionary(catalog: DataFrame, column: str) -> DataFrame:
    """(shard, value, code): codes 0, 1, ... in the order of first occurrence within the shard. Only distinct values are numbered."""
    first = catalog.filter(F.col(column).isNotNull()).groupBy(shard_of().alias("shard"), F.col(column).alias("value")).agg(F.min("row_id").alias("first"))
    return first.select("shard", "value", (F.row_number().over(Window.partitionBy("shard").orderBy("first", "value")) - 1).alias("code"))


def encoded(catalog: DataFrame, column: str) -> DataFrame:
    """(row_id, shard, code) of every row, -1 where it has no value."""
    codes = dictionary(catalog, column).withColumnRenamed("value", column)
    return catalog.select("row_id", shard_of().alias("shard"), column).join(codes, ["shard", column], "left").select("row_id", "shard", F.coalesce("code", F.lit(-1)).alias("code"))


def shard_of(column: str = "id") -> Column:
    return F.substring_index(F.col(column), "/", 1)


def shard_summary(catalog: DataFrame) -> DataFrame:
    """Per shard: matches, games, first and last date, distinct events and players."""
    players = sides(catalog.select("row_id", "p0", "p1", "n0", "n1")).join(catalog.select("row_id", shard_of().alias("shard")), "row_id").groupBy("shard").agg(F.count_distinct("norm").alias("players"))
    main = catalog.groupBy(shard_of().alias("shard")).agg(
        F.count_distinct("id").alias("matches"), F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("games", F.lit(0)).cast("long")).alias("games"),
        F.min(F.nullif(F.col("date"), F.lit(""))).alias("first_date"), F.max(F.nullif(F.col("date"), F.lit(""))).alias("last_date"), F.count_distinct("event").alias("events"),
    )
    return main.join(players, "shard", "left").select(*main.columns, F.coalesce("players", F.lit(0)).alias("players"))


def length_histogram(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(shard_of().alias("shard"), "len").agg(F.count(F.lit(1)).alias("rows"))


def record_flags(records: DataFrame) -> DataFrame:
    """(row_id, flags): the catalog's bits that games and remarks of a record give."""
    any_game = lambda test: F.exists(F.coalesce("games", F.array().cast(records.schema["games"].dataType)), test)
    bit = lambda name, test: F.when(test, FLAGS[name]).otherwise(0)
    gammon = any_game(lambda g: F.coalesce(g["kind"].isin("gammon", "backgammon"), F.lit(False)))
    cube = any_game(lambda g: F.coalesce(g["cube"] > 1, F.lit(False)))
    resign = any_game(lambda g: F.coalesce(g["how"] == "resign", F.lit(False)))
    return records.select("row_id", (bit("gammon", gammon) + bit("cube", cube) + bit("resign", resign)).alias("flags"))


def tree_digest(files: DataFrame, shard: str = "shard") -> DataFrame:
    """(shard, files, digest): one digest over the sorted (path, digest of content) lines of a shard.

    The lines of one shard are joined on one executor; a shard is a bounded unit of storage."""
    line = F.struct(F.col("path"), F.concat_ws("\t", "path", F.sha2(F.coalesce("content", F.lit("")), 256)).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return files.groupBy(shard).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def latest_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by `order`, by an aggregation that combines before the shuffle."""
    whole = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(key).agg(whole).select("r.*")


def overlays(reviews: DataFrame) -> DataFrame:
    """(file, fix): reviewed values by file as a map, later rows winning key by key. A key with a null value clears what is stored; one that is absent leaves it."""
    reviewed = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("event", "round", "date")])
    keyed = reviews.filter("file is not null").select("file", "row_id", "from_src", F.explode(reviewed).alias("x"))
    # a null counts as reviewed only where a person has set the values
    said = keyed.filter(F.col("x.v").isNotNull() | (F.col("from_src") == "sidecar")).groupBy("file", "x.k").agg(F.max_by("x.v", "row_id").alias("v"))
    return said.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fix"))


def apply_overlay(rows: DataFrame, fixes: DataFrame, key: str = "file") -> DataFrame:
    """`rows` with event, round and date replaced where the overlay has the key, even by null; year follows the date."""
    joined = rows.join(fixes, key, "left")
    has = lambda k: F.coalesce(F.map_contains_key("fix", F.lit(k)), F.lit(False))
    fixed = {k: F.when(has(k), F.element_at("fix", F.lit(k))).otherwise(F.col(k)) for k in ("event", "round", "date")}
    out = joined.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in rows.columns])
    return out.withColumn("year", year_of(F.col("date")))


def look_alikes(catalog: DataFrame) -> DataFrame:
    """(row_id, first_row, copies) of the rows whose display key an earlier row with another id has."""
    keyed = catalog.select("row_id", "id", display_key(F.col("p0"), F.col("p1"), F.col("date"), F.col("event"), F.col("round"), F.col("len")).alias("key"))
    group = keyed.groupBy("key").agg(F.min_by(F.struct("row_id", "id"), "row_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return keyed.join(group, "key").filter((F.col("id") != F.col("first.id")) & (F.col("row_id") > F.col("first.row_id"))).select("row_id", F.col("first.row_id").alias("first_row"), "copies")


def by_prefix(hashes: DataFrame, prefix: str) -> DataFrame:
    """(id, hits) of the matches whose content hash begins with a prefix of at least eight digits; `hits` tells whether it is unique."""
    if len(prefix) < 8:
        return hashes.limit(0).select("id", F.lit(0).alias("hits"))
    hit = hashes.filter(F.startswith("content_hash", F.lit(prefix))).select("id")
    return hit.select("id", F.count(F.lit(1)).over(Window.partitionBy()).alias("hits"))


def unique_prefixes(hashes: DataFrame, least: int = 8, step: int = 2, most: int = 64) -> DataFrame:
    """(id, prefix): the shortest start of the content hash, from `least` digits in steps, that no other hash of the table has.

    The neighbour in sorted order shares the longest start, so one sorted pass within the hashes that begin alike decides it; `least` is not below the four digits that are partitioned by."""
    order = Window.partitionBy(F.substring("content_hash", 1, 4)).orderBy("content_hash", "id")
    near = hashes.select("id", "content_hash", F.lag("content_hash").over(order).alias("before"), F.lead("content_hash").over(order).alias("after"))
    shared = lambda other: F.coalesce(F.when(F.col(other) == F.col("content_hash"), most).otherwise(F.length(F.regexp_extract(F.concat_ws("|", "content_hash", other), r"^([^|]*)[^|]*\|\1", 1))), F.lit(0))
    longest = F.greatest(shared("before"), shared("after"))
    size = F.least(F.greatest(F.lit(least), least + F.ceil((longest + 1 - least) / step) * step), F.lit(most))
    return near.select("id", F.substring(F.col("content_hash"), F.lit(1), size.cast("int")).alias("prefix"))


def filled_shards(spark: SparkSession, rows: DataFrame, order: list[str], per_shard: int) -> DataFrame:
    """(row keys, shard number): shards of `per_shard` rows in order within each source; sealing by count.

    Rows are ranked over all sources by range partitions and the rank of a source's first row is taken off, so a source with most of the rows is no task of its own."""
    ranked = global_rank(spark, rows, [F.col("source_key"), *[F.col(c) for c in order]], "_rank")
    first = ranked.groupBy("source_key").agg(F.min("_rank").alias("_first"))
    return ranked.join(first, "source_key").select(*rows.columns, F.floor((F.col("_rank") - F.col("_first")) / per_shard).cast("int").alias("shard_no"))


def shard_problems(files: DataFrame) -> DataFrame:
    """(shard, hash, problem) of stored matches (path, shard, hash, ext, content) that do not hold together.

    `no_meta`, `no_mat`: one of the two files is missing; `empty`: one is empty; `unreadable`: the metadata are no JSON with an id; `hash`: their content hash does not begin with the name of the file; `id`: their id is not shard and hash.
    """
    meta = F.from_json("content", "id string, contentHash string")
    side = lambda ext, value: F.max(F.when(F.col("ext") == ext, value))
    both = files.groupBy("shard", "hash").agg(
        side("mat", F.length("content")).alias("mat"), side("meta.json", F.length("content")).alias("meta"),
        side("meta.json", F.coalesce(meta["id"], F.lit(""))).alias("id"), side("meta.json", F.coalesce(meta["contentHash"], F.lit(""))).alias("content_hash"),
    )
    there, named = F.col("meta") > 0, F.col("id") != ""
    problems = F.array(
        F.when(F.col("meta").isNull(), "no_meta"), F.when(F.col("mat").isNull(), "no_mat"), F.when((F.col("mat") == 0) | (F.col("meta") == 0), "empty"), F.when(there & ~named, "unreadable"),
        F.when(there & named & ~F.startswith("content_hash", F.col("hash")), "hash"), F.when(there & named & (F.col("id") != F.concat_ws("/", "shard", "hash")), "id"),
    )
    return both.select("shard", "hash", F.explode(F.array_compact(problems)).alias("problem"))
