"""The review of a set of files before they are stored: what their headers and names say, and which of them nothing tells apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipworks.functions.text import display_key
from pipworks.operators.ranking import global_rank

# Servers and programs that write their own name where the place of a match stands, as patterns.
SERVERS = [
    "backgammon studio", "gamesgrid games server", "gamesgrid", "gridgammon", "extreme gammon", "xg mobile", "backgammongalaxy", "backgammon galaxy", "galaxy backgammon", "play\\.backgammongalaxy\\.com",
    "playok", "opengammon", "foxamon", "choue\\.net", "choue", "fibs", "dailygammon", "gnu backgammon", "gnubg", "bgblitz", "heroes", "safe harbor games",
]
BETWEEN = "[\\s:,;/-]"


def site_says(site: Column) -> Column:
    """(kind, value) of a Site tag: none; a server; a server with an event, whose value is what is left; or a place, whole."""
    text = F.trim(F.regexp_replace(site, "\\s+", " "))
    names = "|".join(SERVERS)
    before = F.regexp_extract(text, f"(?i)^(?:{names}){BETWEEN}(.*)$", 1)
    after = F.regexp_extract(text, f"(?i)^(.*){BETWEEN}(?:{names})$", 1)
    rest = F.regexp_replace(F.when(before != "", before).otherwise(after), f"^{BETWEEN}+|{BETWEEN}+$", "")
    begins, ends = text.rlike(f"(?i)^(?:{names}){BETWEEN}"), text.rlike(f"(?i){BETWEEN}(?:{names})$")
    event = rest.rlike("\\p{L}{3}")
    kind = F.when(text.isNull() | (text == ""), "none").when(text.rlike(f"(?i)^(?:{names})$"), "server").when(begins | ends, F.when(event, "event").otherwise("server")).otherwise("place")
    return F.struct(kind.alias("kind"), F.when(kind == "event", rest).when(kind == "place", text).alias("value"))


def plan(spark: SparkSession, items: DataFrame, stored: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(item_id, status, group_no, event, round, date, copy_of) of the items that a person or the next step has to look at.

    `items` (item_id, file, players, match_length, date, time, event, round, moves); `stored` (id and the columns of a
    display key: p0, p1, date, event, round, len); `names` what file names propose (item_id, event, round, date, time,
    number, of). Of items with the same moves the first by file is planned, the others are `duplicate`. Values that the
    headers lack are taken from the name (`name`). Items that look the same, or like a stored match, are a group: a number
    in the name tells them apart, else their times, if all have different ones (`series`); otherwise they are `same`.

    Copies and groups are found by aggregation, and only groups are numbered over all items. Null moves are no copies;
    without items the plan is empty.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    here = items.select("item_id", blank("file").alias("file"), F.col("players")[0].alias("p0"), F.col("players")[1].alias("p1"), F.col("match_length").alias("len"), "date", "time", "event", "round", "moves")
    place = F.struct("file", "item_id")
    first = here.filter("moves is not null and moves <> ''").groupBy(F.xxhash64("moves").alias("digest"), "moves").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("moves", "first")
    marked = here.join(first, "moves", "left")
    copies = marked.filter(F.col("first.item_id") != F.col("item_id"))
    wanted = ["event", "round", "date", "time", "number", "of"]
    originals = marked.filter(F.col("first").isNull() | (F.col("first.item_id") == F.col("item_id")))
    if names is None:
        named = originals.select("*", *[F.lit(None).cast("int" if c in ("number", "of") else "string").alias(f"n_{c}") for c in wanted])
    else:
        named = originals.join(names.select("item_id", *[F.col(c).alias(f"n_{c}") for c in wanted]), "item_id", "left")
    key = lambda event, round_, date: display_key(F.col("p0"), F.col("p1"), F.col(date), F.col(event), F.col(round_), F.col("len"))
    proposed = {f"p_{c}": F.coalesce(F.nullif(F.col(c), F.lit("")), f"n_{c}") for c in ("event", "round", "date")}
    keyed = named.withColumns(proposed | {"key": key("event", "round", "date")})
    taken = stored.select(display_key(*[F.col(c) for c in ("p0", "p1", "date", "event", "round", "len")]).alias("key"), "id").groupBy("key").agg(F.min("id").alias("clash"))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first_place")).join(taken, "key", "left").filter("size > 1 or clash is not null")
    numbered = global_rank(spark, groups, [F.col("first_place.file"), F.col("first_place.item_id")]).withColumnRenamed("rank", "group_no")
    joined = keyed.join(numbered.select("key", "group_no", "clash"), "key", "left")
    series = F.concat(F.col("round"), F.lit(" - Match "), F.col("n_number").cast("string"), F.coalesce(F.concat(F.lit(" of "), F.col("n_of").cast("string")), F.lit("")))
    told = F.col("group_no").isNotNull() & (F.coalesce("round", F.lit("")) != "")
    joined = joined.withColumn("p_round", F.when(told & F.col("n_number").isNotNull(), series).when(told & F.col("n_round").rlike("[0-9]"), F.col("n_round")).otherwise(F.col("p_round")))
    alike = joined.withColumn("key2", key("p_event", "p_round", "p_date"))
    moments = {"in_file": F.when(blank("time") != "", F.concat_ws(" ", blank("date"), "time")), "in_name": F.when(F.col("n_time").isNotNull(), F.concat_ws(" ", blank("n_date"), "n_time"))}
    alike = alike.withColumns(moments)
    whole = alike.filter("group_no is not null").groupBy("group_no", "key2").agg(
        F.count(F.lit(1)).alias("alike"), *[(F.count_distinct(c) == F.count(F.lit(1))).alias(f"by_{c}") for c in moments]
    )
    ties = alike.join(whole, ["group_no", "key2"], "left")
    when = F.when(F.col("alike") > 1, F.when(F.col("by_in_file"), F.col("in_file")).when(F.col("by_in_name"), F.col("in_name")))
    nth = F.row_number().over(Window.partitionBy("group_no", "key2").orderBy("when", "file", "item_id"))
    counted = ties.withColumn("when", when).withColumn("nth", nth)
    by_time = F.concat(F.coalesce(F.concat(F.nullif(F.col("p_round"), F.lit("")), F.lit(" - ")), F.lit("")), F.lit("Match "), F.col("nth").cast("string"), F.lit(" of "), F.col("alike").cast("string"))
    ended = counted.withColumn("p_round", F.when(F.col("when").isNotNull() & F.col("group_no").isNotNull(), by_time).otherwise(F.col("p_round")))
    differs = lambda c: ~F.col(f"p_{c}").eqNullSafe(F.nullif(F.col(c), F.lit("")))
    changed = differs("event") | differs("round") | differs("date")
    grouped = F.col("group_no").isNotNull()
    same = grouped & ((F.coalesce("alike", F.lit(1)) > 1) & F.col("when").isNull() | F.col("clash").isNotNull() & ~changed)
    status = F.when(same, "same").when(grouped, "series").when(changed, "name")
    planned = ended.select("item_id", status.alias("status"), F.col("group_no").cast("long").alias("group_no"), F.col("p_event").alias("event"), F.col("p_round").alias("round"), F.col("p_date").alias("date"), F.lit(None).cast("string").alias("copy_of")).filter("status is not null")
    plain = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    doubled = copies.select("item_id", F.lit("duplicate").alias("status"), F.lit(None).cast("long").alias("group_no"), plain("event"), plain("round"), plain("date"), F.col("first.file").alias("copy_of"))
    return planned.unionByName(doubled)


def sheet_lines(reviews: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(row_id, raw): rows as lines of a sheet that the loader reads back. `columns` names the column of each cell, in order; a cell that begins with a quote or holds a tab or a line end is quoted."""

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('^"|[\\t\\r\\n]'), quoted).otherwise(text)

    return reviews.select("row_id", F.concat_ws("\t", *[cell(c) for c in columns.values()]).alias("raw"))
