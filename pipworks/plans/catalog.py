"""Queries on the catalog, its records and overlays, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipworks.functions import text as T
from pipworks.operators import catalog as C
from pipworks.operators import folds
from pipworks.operators.components import components
from pipworks.operators.sketches import bloom_filter, bloom_might_contain
from pipworks.sources.tables import table

KEY = bytes(range(32))

SEARCHES = {
    "search_player": "player:warden",
    "search_pair": "player:warden player:doldibur",
    "search_three": "player:a player:b player:c",
    "search_event_round": 'event:"grand prix" round:final',
    "search_year_length": "year:2005..2015 len:5..",
    "search_money": "len:money",
    "search_month": "date:2006-02..2006-11",
    "search_day": "date:24-02-2006",
    "search_flags": "has:cube,gammon",
    "search_by": "by:Quill77",
    "search_words": "warden cup",
    "search_all": 'player:warden event:cup year:2000.. len:..11 has:cube vs:""',
}

_FOLD = "lower(strip_accents(coalesce({}, '')))"
_HIT = "SELECT row_id, id, p0, p1 FROM match_catalog WHERE "
_NAME = "(contains(n0, '{0}') OR contains(n1, '{0}'))"
SEARCH_SQL = {
    "search_player": _HIT + _NAME.format("warden"),
    "search_pair": _HIT + "(contains(n0, 'warden') AND contains(n1, 'doldibur')) OR (contains(n0, 'doldibur') AND contains(n1, 'warden'))",
    "search_three": _HIT + "false",
    "search_event_round": _HIT + f"contains({_FOLD.format('event')}, 'grand prix') AND contains({_FOLD.format('round')}, 'final')",
    "search_year_length": _HIT + "year BETWEEN 2005 AND 2015 AND len >= 5",
    "search_money": _HIT + "len = 0",
    "search_month": _HIT + "length(date) >= 7 AND substr(date, 1, 7) BETWEEN '2006-02' AND '2006-11'",
    "search_day": _HIT + "length(date) >= 10 AND date = '2006-02-24'",
    "search_flags": _HIT + "(flags & 3) = 3",
    "search_by": _HIT + "lower(by_login) = 'quill77'",
    "search_words": _HIT + "contains(hay, 'warden') AND contains(hay, 'cup')",
    "search_all": _HIT + _NAME.format("warden") + f" AND contains({_FOLD.format('event')}, 'cup') AND year >= 2000 AND len <= 11 AND (flags & 2) = 2",
}


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "match_catalog")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "match_records")


def _search(text: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return C.found(_catalog(spark, folder), text).select("row_id", "id", "p0", "p1")

    return run


def search_page(spark, folder):
    """The second page of the matches of one player, in the order of results."""
    return C.page(_catalog(spark, folder), "player:warden", 2).select("row_id", "id", "date", "event", "round")


def normal_names(spark, folder):
    """The normal form of both names, as the catalog stores it."""
    return _catalog(spark, folder).select("row_id", T.normalise(F.col("p0")).alias("n0"), T.normalise(F.col("p1")).alias("n1"), T.normalise(F.col("event")).alias("event_norm"))


def natural_rounds(spark, folder):
    """Distinct rounds with a key that sorts numbers as numbers."""
    return _catalog(spark, folder).select("round").distinct().select("round", T.natural_key(F.col("round")).alias("sort_key"))


def player_facet(spark, folder):
    return C.player_facet(_catalog(spark, folder))


def event_facet(spark, folder):
    return C.value_facet(_catalog(spark, folder), "event")


def suggest_players(spark, folder):
    return C.suggest_players(C.player_facet(_catalog(spark, folder)), "Do").select("norm", "matches", "place")


def suggest_events(spark, folder):
    return C.suggest_values(C.value_facet(_catalog(spark, folder), "event"), "cup")


def encoded_events(spark, folder):
    return C.encoded(_catalog(spark, folder), "event")


def shard_summary(spark, folder):
    return C.shard_summary(_catalog(spark, folder))


def length_histogram(spark, folder):
    return C.length_histogram(_catalog(spark, folder))


def record_flags(spark, folder):
    return C.record_flags(_records(spark, folder))


def tree_digest(spark, folder):
    return C.tree_digest(C.latest_by(table(spark, folder, "match_files").select("path", "shard", "content", "file_no"), "path", ["file_no"]))


def stored_bytes(spark, folder):
    return table(spark, folder, "match_files").groupBy("shard", "ext").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def latest_delivery(spark, folder):
    """Every match once, as delivered last."""
    return C.latest_by(_catalog(spark, folder).select("id", "row_id", "p0", "p1", "date", "flags"), "id", ["row_id"])


def repeated_ids(spark, folder):
    """Rows that deliver a match again, numbered."""
    w = Window.partitionBy("id").orderBy("row_id")
    return _catalog(spark, folder).select("row_id", "id", F.row_number().over(w).alias("nth")).filter("nth > 1")


def known_content(spark, folder):
    """Records whose content hash is among the accepted ones, with the id it has there."""
    known = table(spark, folder, "hashes").select("content_hash", F.col("id").alias("known_id"))
    return _records(spark, folder).select("row_id", "id", "content_hash").join(known, "content_hash").select("row_id", "id", "known_id")


def new_content(spark, folder):
    """Records that are not among the accepted ones."""
    return _records(spark, folder).select("row_id", "id", "content_hash").join(table(spark, folder, "hashes").select("content_hash"), "content_hash", "left_anti").select("row_id", "id")


def erased_refused(spark, folder):
    """Rows of metas split by a list of erased hashes: here those accepted before 2024-06."""
    erased = table(spark, folder, "hashes").filter("accepted_at < timestamp '2024-06-01'").select("content_hash").distinct()
    metas = table(spark, folder, "metas").select("row_id", F.lower("content_hash").alias("content_hash"))
    refused = metas.join(erased, "content_hash", "left_semi").select("row_id", F.lit("erased").alias("status"))
    return refused.unionByName(metas.join(erased, "content_hash", "left_anti").select("row_id", F.lit("good").alias("status")))


def hash_index(spark, folder):
    """One id per content hash: local records first, then the lists of shards that are not local."""
    local = _records(spark, folder).groupBy("content_hash").agg(F.min("id").alias("id"))
    shards = _records(spark, folder).select(C.shard_of().alias("shard")).distinct()
    listed = table(spark, folder, "hashes").select("content_hash", "id", C.shard_of().alias("shard")).join(shards, "shard", "left_anti").join(local.select("content_hash"), "content_hash", "left_anti")
    return local.unionByName(listed.select("content_hash", "id"))


def look_alikes(spark, folder):
    return C.look_alikes(_catalog(spark, folder))


def hash_prefix(spark, folder):
    return C.by_prefix(table(spark, folder, "hashes"), "67381ce9")


def unique_prefixes(spark, folder):
    return C.unique_prefixes(table(spark, folder, "hashes"))


def reviewed_values(spark, folder):
    """The overlay of every reviewed file: later sheets win key by key, a reviewed null clears."""
    fixes = C.overlays(table(spark, folder, "meta_review"))
    has = lambda k: F.map_contains_key("fix", F.lit(k))
    return fixes.select("file", *[F.element_at("fix", F.lit(k)).alias(k) for k in ("event", "round", "date")], *[has(k).alias(f"has_{k}") for k in ("event", "round", "date")])


def corrected_inbox(spark, folder):
    """inbox_items with reviewed values in place of the stored ones."""
    items = table(spark, folder, "inbox_items").select("item_id", "file", "event", "round", "date")
    return C.apply_overlay(items, C.overlays(table(spark, folder, "meta_review")))


def orphan_reviews(spark, folder):
    """Reviewed files that no inbox item has."""
    return table(spark, folder, "meta_review").select("file").filter("file is not null").distinct().join(table(spark, folder, "inbox_items").select("file"), "file", "left_anti")


def unioned_versions(spark, folder):
    """Catalog rows of two versions, the older one without rounds and submitters. Rows without a year are of the older version."""
    rows = _catalog(spark, folder).select("row_id", "p0", "p1", "event", "round", "by_login", "year")
    old = rows.filter("year < 2010 or year is null").drop("round", "by_login")
    return old.unionByName(rows.filter("year >= 2010"), allowMissingColumns=True).select("row_id", "p0", "p1", "event", "round", "by_login", "year")


def remark_changes(spark, folder):
    """Remarks of a record that an earlier delivery of the same match does not have."""
    rows = _records(spark, folder).select("id", "row_id", F.coalesce("remarks", F.array().cast("array<string>")).alias("remarks"))
    before = F.lag("remarks").over(Window.partitionBy("id").orderBy("row_id"))
    changed = rows.withColumn("before", before).filter("before is not null")
    return changed.select("row_id", F.explode(F.array_except("remarks", "before")).alias("remark"))


def running_score(spark, folder):
    return folds.running_score(_records(spark, folder))


def crawford_games(spark, folder):
    return folds.crawford_games(_records(spark, folder))


def score_gaps(spark, folder):
    return folds.score_gaps(_records(spark, folder))


def cube_carried(spark, folder):
    return folds.cube_carried(_records(spark, folder))


def winning_streaks(spark, folder):
    return folds.streaks(_records(spark, folder))


def match_results(spark, folder):
    return folds.match_result(_records(spark, folder))


def points_differ(spark, folder):
    """The first game in which two deliveries of one match differ in points."""
    rows = _records(spark, folder).select("id", "row_id", F.transform("games", lambda g: F.coalesce(g["points"], F.lit(0))).alias("points"))
    first, last = C.latest_by(rows.withColumn("o", -F.col("row_id")), "id", ["o"]), C.latest_by(rows, "id", ["row_id"])
    return folds.points_differ(first.select("id", "points"), last.select("id", "points"), "id")


def series_numbers(spark, folder):
    """Match i of n among inbox items of the same players and day, where every one has its own time."""
    items = table(spark, folder, "inbox_items").select("item_id", F.array_join(F.array_sort("players"), "|").alias("who"), "date", "time").filter("who is not null and date is not null")
    return folds.series(items, ["who", "date"], "time", "item_id")


def sealed_shards(spark, folder):
    rows = _catalog(spark, folder).select("row_id", C.shard_of().alias("source_key"))
    return C.filled_shards(spark, rows, ["row_id"], 250)


def rating(spark, folder):
    """Decision summary of the events table: value as error, type as kind."""
    decisions = table(spark, folder, "events").select("user_id", "event_type", (F.col("value") / 100).alias("error"), (F.col("event_type") != "view").alias("counted"))
    return folds.rating(decisions, ["user_id"]).select("user_id", "decisions", F.round("total", 6).alias("total"), "blunder", "error", "inaccuracy", F.round("rating", 4).alias("rating"))


def sidecar_values(spark, folder):
    """Values of the sidecar JSON files."""
    schema = "id string, contentHash string, matchLength int, date string, event string, sides array<struct<name string>>, provenance struct<contributor string>"
    files = table(spark, folder, "match_files").filter("ext = 'meta.json' and content <> ''").select("file_no", F.from_json("content", schema).alias("j"))
    return files.select("file_no", "j.id", F.col("j.contentHash").alias("content_hash"), F.col("j.matchLength").alias("match_length"), "j.date", "j.event", F.col("j.sides")[0]["name"].alias("p0"), F.col("j.provenance.contributor").alias("contributor"))


def pseudonyms(spark, folder):
    """A keyed digest for every distinct normal name."""
    names = C.sides(_catalog(spark, folder)).select("norm").distinct()
    return names.select("norm", T.hmac_sha256(KEY, F.col("norm")).alias("code"))


def near_components(spark, folder):
    """Catalog matches connected by equal content or equal display: components of both kinds of links."""
    rows = _catalog(spark, folder).select("row_id", "id", T.display_key(F.col("p0"), F.col("p1"), F.col("date"), F.col("event"), F.col("round"), F.col("len")).alias("key"))
    by = lambda c: rows.withColumn("first", F.min("row_id").over(Window.partitionBy(c))).filter("first < row_id").select(F.col("first").alias("a"), F.col("row_id").alias("b"))
    found = components(spark, by("id").unionByName(by("key")))
    return found.select(F.col("node").alias("row_id"), F.col("root").alias("first_row"))


def bloom_semi(spark, folder):
    """Catalog rows whose id is stored as a record: a Bloom filter first, then exactly."""
    ids = _records(spark, folder).select("id").distinct()
    bloom = bloom_filter(ids, "id")
    return bloom_might_contain(_catalog(spark, folder).select("row_id", "id"), "id", bloom).join(ids, "id", "left_semi").select("row_id", "id")


def submission_verdicts(spark, folder):
    """Per contributor of metas: rows, distinct hashes, rows without a hash, and the first verdict that holds."""
    rows = table(spark, folder, "metas").groupBy("contributor").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.lower("content_hash")).alias("hashes"), F.count_if(F.col("content_hash").isNull()).alias("unhashed"), F.count_if(F.col("license").isNull()).alias("unlicensed"))
    verdict = F.when(F.col("unhashed") * 10 > F.col("rows"), "errors").when(F.col("unlicensed") * 2 > F.col("rows"), "rights").when(F.col("hashes") < F.col("rows") - F.col("unhashed"), "duplicates").otherwise("ready")
    return rows.withColumn("verdict", verdict)


def header_events(spark, folder):
    """Events and rounds of records without placeholders, blanks collapsed."""
    tidy = lambda c: F.trim(F.regexp_replace(F.col(c), "[ \\t\\r\\n]+", " "))
    keep = lambda c, pattern: F.when(~F.lower(tidy(c)).rlike(pattern), F.nullif(tidy(c), F.lit("")))
    return _records(spark, folder).select("row_id", keep("event", "^(online match|unknown|none|n/?a|event|-+|\\?+)$").alias("event"), keep("round", "^((round *)?0|unknown|none|n/?a|-+|\\?+)$").alias("round"))


def file_name_parts(spark, folder):
    """Dates, numbers and lengths that names of inbox files give."""
    part = lambda pattern: F.nullif(F.regexp_extract("file", pattern, 1), F.lit(""))
    iso, dmy = part("([12][0-9]{3}-[0-9]{2}-[0-9]{2})"), part("([0-9]{2}\\.[0-9]{2}\\.[12][0-9]{3})")
    date = F.coalesce(iso, F.concat_ws("-", F.substring(dmy, 7, 4), F.substring(dmy, 4, 2), F.substring(dmy, 1, 2)))
    return table(spark, folder, "inbox_items").select("item_id", F.nullif(date, F.lit("")).alias("date"), F.coalesce(part("#([0-9]+)"), part("match([0-9]{1,2})\\."), part("([0-9]+)\\. Match")).cast("int").alias("number"), part("([0-9]+)p(?:nts)?\\.").cast("int").alias("length"), F.lower(part("\\.([A-Za-z]+)$")).alias("kind"))


def slugs(spark, folder):
    return _catalog(spark, folder).select("event").distinct().select("event", T.slug(F.col("event")).alias("slug"))


def nation_revenue(spark, folder):
    """Orders and line items by nation: two joins and an aggregation over the star schema."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o, c, n = table(spark, folder, "orders").select("o_orderkey", "o_custkey"), table(spark, folder, "customer").select("c_custkey", "c_nationkey"), table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


QUERIES = {name: _search(text) for name, text in SEARCHES.items()} | {
    f.__name__: f
    for f in (
        search_page, normal_names, natural_rounds, player_facet, event_facet, suggest_players, suggest_events, encoded_events, shard_summary, length_histogram, record_flags, tree_digest, stored_bytes, latest_delivery, repeated_ids, known_content, new_content,
        erased_refused, hash_index, look_alikes, hash_prefix, unique_prefixes, reviewed_values, corrected_inbox, orphan_reviews, unioned_versions, remark_changes, running_score, crawford_games, score_gaps, cube_carried, winning_streaks, match_results,
        points_differ, series_numbers, sealed_shards, rating, sidecar_values, pseudonyms, near_components, bloom_semi, submission_verdicts, header_events, file_name_parts, slugs, nation_revenue,
    )
}

_NORM = "trim(regexp_replace(lower(strip_accents({})), '\\s+', ' ', 'g'))"
_SHARD = "split_part(id, '/', 1)"
_NAT = "regexp_replace(regexp_replace({}, '([0-9]+)', '0000000000\\1', 'g'), '[0-9]*([0-9]{{10}})([^0-9]|$)', '\\1\\2', 'g')"
_SIDES = "SELECT row_id, id, 0 AS side, p0 AS name, n0 AS norm FROM match_catalog UNION ALL SELECT row_id, id, 1, p1, n1 FROM match_catalog"
_FACET = f"SELECT norm, arg_min(name, row_id * 2 + side) AS name, count(*) AS matches FROM ({_SIDES}) WHERE norm <> '' GROUP BY norm"
_DISPLAY = "list_aggregate(list_sort([coalesce({0}, ''), coalesce({1}, '')]), 'string_agg', ' / ') || ' | ' || coalesce(date, '') || ' | ' || coalesce({2}, '') || ' | ' || coalesce({3}, '') || ' | ' || coalesce(CAST(len AS VARCHAR), '')".format(*[_NORM.format(c) for c in ("p0", "p1", "event", "round")])
_GAMES = """games AS (SELECT row_id, match_length, generate_subscripts(games, 1) - 1 AS "at", unnest(games, max_depth := 1) AS g FROM match_records)"""
_SCORE = f"""{_GAMES}, score AS (SELECT row_id, "at", match_length,
  CAST(sum(CASE WHEN g.winner = 0 THEN coalesce(g.points, 0) ELSE 0 END) OVER w AS BIGINT) AS after0, CAST(sum(CASE WHEN g.winner = 1 THEN coalesce(g.points, 0) ELSE 0 END) OVER w AS BIGINT) AS after1,
  CASE WHEN g.winner = 0 THEN coalesce(g.points, 0) ELSE 0 END AS q0, CASE WHEN g.winner = 1 THEN coalesce(g.points, 0) ELSE 0 END AS q1 FROM games WINDOW w AS (PARTITION BY row_id ORDER BY "at"))"""
_OVERLAY = """said AS (SELECT file, k, arg_max_null(v, row_id) AS v FROM (
    SELECT file, row_id, from_src, 'event' AS k, event AS v FROM meta_review UNION ALL SELECT file, row_id, from_src, 'round', round FROM meta_review UNION ALL SELECT file, row_id, from_src, 'date', date FROM meta_review)
  WHERE file IS NOT NULL AND (v IS NOT NULL OR from_src = 'sidecar') GROUP BY file, k),
fix AS (SELECT file, max(v) FILTER (k = 'event') AS event, max(v) FILTER (k = 'round') AS round, max(v) FILTER (k = 'date') AS date, count(*) FILTER (k = 'event') > 0 AS has_event, count(*) FILTER (k = 'round') > 0 AS has_round, count(*) FILTER (k = 'date') > 0 AS has_date FROM said GROUP BY file)"""
_EVENT_ORDER = _NORM.format("coalesce(event, '')")
_ROUND_ORDER = _NAT.format(_NORM.format("coalesce(round, '')"))
_INNER, _OUTER = bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex(), bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex()

ORACLE = SEARCH_SQL | {
    "search_page": "SELECT row_id, id, date, event, round FROM match_catalog WHERE " + _NAME.format("warden") + f" ORDER BY nullif(date, '') DESC NULLS LAST, {_EVENT_ORDER}, {_ROUND_ORDER}, id, row_id LIMIT 50 OFFSET 50",
    "normal_names": "SELECT row_id, " + ", ".join(f"{_NORM.format(c)} AS {a}" for c, a in (("p0", "n0"), ("p1", "n1"), ("event", "event_norm"))) + " FROM match_catalog",
    "natural_rounds": f"SELECT DISTINCT round, {_NAT.format('round')} AS sort_key FROM match_catalog",
    "player_facet": _FACET,
    "event_facet": "SELECT event AS value, count(*) AS rows FROM match_catalog WHERE event IS NOT NULL GROUP BY 1",
    "suggest_players": f"SELECT norm, matches, CASE WHEN contains(' ' || norm, ' do') THEN 0 ELSE 1 END AS place FROM ({_FACET}) WHERE contains(norm, 'do') ORDER BY place, matches DESC, norm LIMIT 8",
    "suggest_events": f"SELECT event AS value, count(*) AS rows FROM match_catalog WHERE contains({_FOLD.format('event')}, 'cup') GROUP BY 1 ORDER BY 1 LIMIT 8",
    "encoded_events": f"""WITH d AS (SELECT shard, value, row_number() OVER (PARTITION BY shard ORDER BY first, value) - 1 AS code FROM (SELECT {_SHARD} AS shard, event AS value, min(row_id) AS first FROM match_catalog WHERE event IS NOT NULL GROUP BY 1, 2))
      SELECT row_id, {_SHARD} AS shard, coalesce(d.code, -1) AS code FROM match_catalog m LEFT JOIN d ON d.shard = split_part(m.id, '/', 1) AND d.value = m.event""",
    "shard_summary": f"""WITH p AS (SELECT {_SHARD} AS shard, count(DISTINCT norm) AS players FROM ({_SIDES}) WHERE norm <> '' GROUP BY 1)
      SELECT s.*, coalesce(p.players, 0) AS players FROM (SELECT {_SHARD} AS shard, count(DISTINCT id) AS matches, count(*) AS rows, CAST(sum(coalesce(games, 0)) AS BIGINT) AS games, min(nullif(date, '')) AS first_date, max(nullif(date, '')) AS last_date, count(DISTINCT event) AS events FROM match_catalog GROUP BY 1) s LEFT JOIN p USING (shard)""",
    "length_histogram": f"SELECT {_SHARD} AS shard, len, count(*) AS rows FROM match_catalog GROUP BY 1, 2",
    "record_flags": "SELECT row_id, CASE WHEN len(list_filter(games, lambda g: g.kind IN ('gammon', 'backgammon'))) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(games, lambda g: g.cube > 1)) > 0 THEN 2 ELSE 0 END + CASE WHEN len(list_filter(games, lambda g: g.how = 'resign')) > 0 THEN 8 ELSE 0 END AS flags FROM match_records",
    "tree_digest": "SELECT shard, count(*) AS files, sha256(string_agg(path || chr(9) || sha256(coalesce(content, '')), chr(10) ORDER BY path)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY file_no DESC) AS rn FROM match_files) WHERE rn = 1 GROUP BY shard",
    "stored_bytes": "SELECT shard, ext, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM match_files GROUP BY 1, 2",
    "latest_delivery": "SELECT id, row_id, p0, p1, date, flags FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id DESC) AS rn FROM match_catalog) WHERE rn = 1",
    "repeated_ids": "SELECT row_id, id, nth FROM (SELECT row_id, id, row_number() OVER (PARTITION BY id ORDER BY row_id) AS nth FROM match_catalog) WHERE nth > 1",
    "known_content": "SELECT r.row_id, r.id, h.id AS known_id FROM match_records r JOIN hashes h USING (content_hash)",
    "new_content": "SELECT row_id, id FROM match_records r WHERE NOT EXISTS (SELECT 1 FROM hashes h WHERE h.content_hash = r.content_hash)",
    "erased_refused": "SELECT row_id, CASE WHEN EXISTS (SELECT 1 FROM hashes h WHERE h.accepted_at < TIMESTAMP '2024-06-01' AND h.content_hash = lower(m.content_hash)) THEN 'erased' ELSE 'good' END AS status FROM metas m",
    "hash_index": f"WITH l AS (SELECT content_hash, min(id) AS id FROM match_records GROUP BY 1) SELECT * FROM l UNION ALL SELECT content_hash, id FROM hashes WHERE {_SHARD} NOT IN (SELECT {_SHARD} FROM match_records) AND content_hash NOT IN (SELECT content_hash FROM l)",
    "look_alikes": f"WITH k AS (SELECT row_id, id, {_DISPLAY} AS key FROM match_catalog), g AS (SELECT key, min(row_id) AS first_row, arg_min(id, row_id) AS first_id, count(*) AS copies FROM k GROUP BY 1 HAVING count(*) > 1) SELECT row_id, first_row, copies FROM k JOIN g USING (key) WHERE id <> first_id AND row_id > first_row",
    "hash_prefix": "SELECT id, count(*) OVER () AS hits FROM hashes WHERE starts_with(content_hash, '67381ce9')",
    "unique_prefixes": """WITH n AS (SELECT s.n, substr(content_hash, 1, s.n) AS p, count(*) AS c FROM hashes, (SELECT unnest(generate_series(8, 64, 2)) AS n) s GROUP BY 1, 2)
      SELECT h.id, substr(h.content_hash, 1, coalesce(min(n.n) FILTER (n.c = 1), 64)) AS prefix FROM hashes h JOIN n ON n.p = substr(h.content_hash, 1, n.n) GROUP BY h.id, h.content_hash""",
    "reviewed_values": f"WITH {_OVERLAY} SELECT * FROM fix",
    "corrected_inbox": f"""WITH {_OVERLAY} SELECT item_id, i.file, CASE WHEN has_event THEN f.event ELSE i.event END AS event, CASE WHEN has_round THEN f.round ELSE i.round END AS round, CASE WHEN has_date THEN f.date ELSE i.date END AS date,
      try_cast(substr(CASE WHEN has_date THEN f.date ELSE i.date END, 1, 4) AS INT) AS year FROM inbox_items i LEFT JOIN fix f ON f.file = i.file""",
    "orphan_reviews": "SELECT DISTINCT file FROM meta_review m WHERE file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inbox_items i WHERE i.file = m.file)",
    "unioned_versions": "SELECT row_id, p0, p1, event, CASE WHEN year >= 2010 THEN round END AS round, CASE WHEN year >= 2010 THEN by_login END AS by_login, year FROM match_catalog",
    "remark_changes": "SELECT DISTINCT row_id, unnest(remarks) AS remark FROM (SELECT row_id, list_filter(coalesce(remarks, []), lambda x: NOT list_contains(before, x)) AS remarks FROM (SELECT row_id, remarks, lag(coalesce(remarks, [])) OVER (PARTITION BY id ORDER BY row_id) AS before FROM match_records) WHERE before IS NOT NULL)",
    "running_score": f"""WITH {_SCORE} SELECT row_id, "at", after0 - q0 AS s0, after1 - q1 AS s1, after0, after1 FROM score""",
    "crawford_games": f"""WITH {_SCORE} SELECT row_id, min("at") AS "at" FROM score WHERE match_length > 1 AND ((match_length - (after0 - q0) = 1) <> (match_length - (after1 - q1) = 1)) GROUP BY row_id""",
    "score_gaps": f"""WITH {_GAMES} SELECT row_id, "at", i - b AS step FROM (SELECT row_id, "at", g.game_index AS i, lag(g.game_index) OVER (PARTITION BY row_id ORDER BY "at") AS b FROM games) WHERE i <> b + 1""",
    "cube_carried": f"""WITH {_GAMES} SELECT row_id, "at", coalesce(last_value(CASE WHEN g.cube > 1 THEN g.cube END IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY "at" ROWS UNBOUNDED PRECEDING), 1) AS carried FROM games""",
    "winning_streaks": f"""WITH {_GAMES}, i AS (SELECT row_id, g.winner AS side, row_number() OVER (PARTITION BY row_id ORDER BY "at") - row_number() OVER (PARTITION BY row_id, g.winner ORDER BY "at") AS k FROM games WHERE g.winner IS NOT NULL) SELECT row_id, side, max(n) AS longest FROM (SELECT row_id, side, k, count(*) AS n FROM i GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "match_results": f"WITH {_GAMES}, t AS (SELECT row_id, max(match_length) AS len, CAST(sum(CASE WHEN g.winner = 0 THEN coalesce(g.points, 0) ELSE 0 END) AS BIGINT) AS s0, CAST(sum(CASE WHEN g.winner = 1 THEN coalesce(g.points, 0) ELSE 0 END) AS BIGINT) AS s1 FROM games GROUP BY 1) SELECT row_id, s0, s1, CASE WHEN len > 0 AND s0 >= len THEN 0 WHEN len > 0 AND s1 >= len THEN 1 END AS winner, (len > 0 AND (s0 >= len OR s1 >= len)) AS finished FROM t",
    "points_differ": """WITH p AS (SELECT id, arg_min(games, row_id) AS a, arg_max(games, row_id) AS b FROM match_records GROUP BY id), z AS (SELECT id, unnest(generate_series(1, greatest(len(a), len(b)))) AS i, a, b FROM p) SELECT id, min(i) - 1 AS "at" FROM z WHERE (CASE WHEN i <= len(a) THEN coalesce(a[i].points, 0) END) IS DISTINCT FROM (CASE WHEN i <= len(b) THEN coalesce(b[i].points, 0) END) GROUP BY id""",
    "series_numbers": """WITH k AS (SELECT item_id, array_to_string(list_sort(players), '|') AS who, date, time FROM inbox_items), w AS (SELECT item_id, row_number() OVER (PARTITION BY who, date ORDER BY time NULLS FIRST, item_id) AS number, count(*) OVER (PARTITION BY who, date) AS "of", count(time) OVER (PARTITION BY who, date) AS timed, count(DISTINCT time) OVER (PARTITION BY who, date) AS d FROM k WHERE who IS NOT NULL AND date IS NOT NULL) SELECT item_id, number, "of" FROM w WHERE "of" > 1 AND timed = "of" AND d = "of" """,
    "sealed_shards": f"SELECT row_id, {_SHARD} AS source_key, CAST((row_number() OVER (PARTITION BY {_SHARD} ORDER BY row_id) - 1) // 250 AS INT) AS shard_no FROM match_catalog",
    "rating": """WITH d AS (SELECT user_id, value / 100 AS e, event_type <> 'view' AS c FROM events), k AS (SELECT *, CASE WHEN e >= 0.1599995 THEN 'blunder' WHEN e >= 0.0799995 THEN 'error' WHEN e >= 0.0399995 THEN 'inaccuracy' ELSE 'fine' END AS cls FROM d)
      SELECT user_id, count(*) FILTER (c) AS decisions, round(sum(e), 6) AS total, count(*) FILTER (cls = 'blunder') AS blunder, count(*) FILTER (cls = 'error') AS error, count(*) FILTER (cls = 'inaccuracy') AS inaccuracy, round(500 * sum(e) / nullif(count(*) FILTER (c), 0), 4) AS rating FROM k GROUP BY user_id""",
    "sidecar_values": "SELECT file_no, j->>'$.id' AS id, j->>'$.contentHash' AS content_hash, CAST(j->>'$.matchLength' AS INT) AS match_length, j->>'$.date' AS date, j->>'$.event' AS event, j->>'$.sides[0].name' AS p0, j->>'$.provenance.contributor' AS contributor FROM (SELECT file_no, CAST(content AS JSON) AS j FROM match_files WHERE ext = 'meta.json' AND content <> '')",
    "pseudonyms": f"SELECT norm, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(norm)))) AS code FROM (SELECT DISTINCT norm FROM ({_SIDES}) WHERE norm <> '')",
    "near_components": f"""WITH RECURSIVE k AS (SELECT row_id, id, {_DISPLAY} AS key FROM match_catalog), l AS (SELECT a, b FROM (SELECT min(row_id) OVER (PARTITION BY id) AS a, row_id AS b FROM k UNION SELECT min(row_id) OVER (PARTITION BY key), row_id FROM k) WHERE a < b),
      e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l), r AS (SELECT DISTINCT u AS n, u AS x FROM e UNION SELECT r.n, e.v FROM r JOIN e ON r.x = e.u) SELECT n AS row_id, min(x) AS first_row FROM r GROUP BY n""",
    "bloom_semi": "SELECT row_id, id FROM match_catalog m WHERE EXISTS (SELECT 1 FROM match_records r WHERE r.id = m.id)",
    "submission_verdicts": "SELECT *, CASE WHEN unhashed * 10 > rows THEN 'errors' WHEN unlicensed * 2 > rows THEN 'rights' WHEN hashes < rows - unhashed THEN 'duplicates' ELSE 'ready' END AS verdict FROM (SELECT contributor, count(*) AS rows, count(DISTINCT lower(content_hash)) AS hashes, count(*) FILTER (content_hash IS NULL) AS unhashed, count(*) FILTER (license IS NULL) AS unlicensed FROM metas GROUP BY 1)",
    "header_events": "SELECT row_id, " + ", ".join(f"CASE WHEN NOT regexp_full_match(lower(trim(regexp_replace({c}, '[ \\t\\r\\n]+', ' ', 'g'))), '{p}') THEN nullif(trim(regexp_replace({c}, '[ \\t\\r\\n]+', ' ', 'g')), '') END AS {c}" for c, p in (("event", "online match|unknown|none|n/?a|event|-+|\\?+"), ("round", "(round *)?0|unknown|none|n/?a|-+|\\?+"))) + " FROM match_records",
    "file_name_parts": "WITH x AS (SELECT item_id, regexp_extract(file, '([12][0-9]{3}-[0-9]{2}-[0-9]{2})', 1) AS iso, regexp_extract(file, '([0-9]{2}\\.[0-9]{2}\\.[12][0-9]{3})', 1) AS dmy, file FROM inbox_items) SELECT item_id, CASE WHEN iso <> '' THEN iso WHEN dmy <> '' THEN substr(dmy, 7, 4) || '-' || substr(dmy, 4, 2) || '-' || substr(dmy, 1, 2) END AS date, CAST(coalesce(nullif(regexp_extract(file, '#([0-9]+)', 1), ''), nullif(regexp_extract(file, 'match([0-9]{1,2})\\.', 1), ''), nullif(regexp_extract(file, '([0-9]+)\\. Match', 1), '')) AS INT) AS number, CAST(nullif(regexp_extract(file, '([0-9]+)p(?:nts)?\\.', 1), '') AS INT) AS length, lower(nullif(regexp_extract(file, '\\.([A-Za-z]+)$', 1), '')) AS kind FROM x",
    "slugs": f"SELECT event, CASE WHEN coalesce(s, '') = '' THEN 'match' ELSE s END AS slug FROM (SELECT event, rtrim(substr(trim(regexp_replace({_NORM.format('event')}, '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') AS s FROM (SELECT DISTINCT event FROM match_catalog))",
    "nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
