"""Queries on what is published and reviewed, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.operators import publishing as P
from pipworks.functions.text import length_text, moves_fingerprint, normalise, time_label, video_seconds
from pipworks.operators import enrichment, reconcile, review, transcripts
from pipworks.operators.catalog import latest_by, shard_of
from pipworks.operators.catalog import shard_problems as catalog_shard_problems
from pipworks.plans.catalog import _DISPLAY, _INNER, _NORM, _OUTER, _SHARD, _SIDES, KEY
from pipworks.plans.transcripts import _SCAN, _files
from pipworks.sources.reject_loader import SHEET_COLUMNS
from pipworks.sources.tables import table

#: Columns of meta_review for the cells of a sheet.
SHEET = dict(zip(SHEET_COLUMNS, ["status", "action", "group_no", "file", "players", "length", "date", "time", "event", "round", "from_src", "note"], strict=True))


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the catalog as they go into it, each match as it was delivered last."""
    rows = latest_by(table(spark, folder, "match_catalog").select("id", "row_id", "p0", "p1", "event", "round", F.col("by_login").alias("by"), "date", "len"), "id", ["row_id"])
    return P.catalog_order(rows.withColumn("shard", shard_of()))


def catalog_dictionaries(spark: SparkSession, folder: str) -> DataFrame:
    """The four dictionaries of every shard's columnar catalog."""
    return P.dictionaries(_published(spark, folder))


def catalog_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of every shard's columnar catalog, with codes."""
    ordered = _published(spark, folder)
    return P.encoded_rows(ordered, P.dictionaries(ordered)).select("shard", "n", "id", "p0", "p1", "event", "round", "by", "len")


def catalog_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The columnar catalog read back: the names of every row."""
    ordered = _published(spark, folder)
    codes = P.dictionaries(ordered)
    return P.decoded_rows(P.encoded_rows(ordered, codes), codes).select("id", "p0", "p1", "event", "round", "by")


def player_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The bits of the published player filter of every shard."""
    each = table(spark, folder, "match_catalog").select(shard_of().alias("shard"), F.explode(F.array("n0", "n1")).alias("name"))
    return P.filter_positions(each.filter("name <> ''"))


def published_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Bits of every record with the links that documents about it have, and analysis files found beside it."""
    url = F.regexp_extract("text", "https?://[^ \\t\\r\\n]+", 0)
    links = table(spark, folder, "documents").filter("match_id is not null").select(F.col("match_id").alias("id"), url.alias("url")).filter("url <> ''").groupBy("id").agg(F.collect_set("url").alias("links"))
    kinds = table(spark, folder, "match_files").filter("ext <> 'mat'").select(F.col("hash").alias("h"), F.struct(F.col("ext").alias("kind"), (F.col("ext") == "sgf").alias("analysis")).alias("a")).groupBy("h").agg(F.collect_set("a").alias("attachments"))
    records = table(spark, folder, "match_records").select("row_id", "id", "games", F.substring_index("id", "/", -1).alias("h")).join(links, "id", "left").join(kinds, "h", "left")
    return records.select("row_id", P.flags_of(F.col("games"), F.col("attachments"), F.col("links")).alias("flags"))


def listings_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of metas that count if every batch is a source and the first one that lists a shard has it."""
    rows = table(spark, folder, "metas").select("row_id", "batch_no", shard_of().alias("shard"))
    return P.first_listings(rows, "batch_no", "shard").select("row_id", "shard")


def site_events(spark: SparkSession, folder: str) -> DataFrame:
    """What the Site tag of every record says."""
    return table(spark, folder, "match_records").select("row_id", review.site_says(F.col("provenance.site")).alias("s")).select("row_id", "s.kind", "s.value")


def _reviewed(spark: SparkSession, folder: str, named: bool) -> DataFrame:
    items = table(spark, folder, "inbox_items")
    return review.plan(spark, items, table(spark, folder, "match_catalog"), transcripts.proposals(items) if named else None)


def review_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The review of the inbox by headers and moves."""
    return _reviewed(spark, folder, False)


def review_plan_named(spark: SparkSession, folder: str) -> DataFrame:
    """The review of the inbox with what file names propose."""
    return _reviewed(spark, folder, True)


def review_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Every reviewed row as a line of a sheet."""
    return review.sheet_lines(table(spark, folder, "meta_review"), SHEET)


def score_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Start score of every game of the .mat files beside the one after the game before it: `kept` if one side has the stated points more and the other as many."""
    score = lambda at, k: F.split_part(F.col("starts")[at], F.lit("-"), F.lit(k)).cast("int")
    each = transcripts.scan(_files(spark, folder)).select("path", "starts", "points", F.explode(F.sequence(F.lit(0), F.size("starts") - 1)).alias("game"))
    before = [F.when(F.col("game") > 0, score(F.col("game") - 1, k)) for k in (1, 2)]
    gained = [F.coalesce(score(F.col("game"), k) - before[k - 1], F.lit(0)) for k in (1, 2)]
    stated = F.when(F.col("game") > 0, F.col("points")[F.col("game") - 1]).otherwise(0)
    kept = (F.least(*gained) == 0) & (F.greatest(*gained) == stated)
    return each.select("path", "game", score(F.col("game"), 1).alias("s0"), score(F.col("game"), 2).alias("s1"), stated.alias("stated"), kept.alias("kept"))


def _enrichments(spark: SparkSession, folder: str) -> DataFrame:
    """What documents bring to the matches they are about: the first link of each, and its source as a tag."""
    url = F.nullif(F.regexp_extract("text", "https?://[^ \\t\\r\\n]+", 0), F.lit(""))
    docs = table(spark, folder, "documents").filter("match_id is not null").select(F.col("match_id").alias("id"), F.col("doc_id").alias("ord"), url.alias("url"), "source")
    link = F.struct(F.col("url"), F.lit(None).cast("int").alias("game"), F.lit(None).cast("string").alias("title"))
    none = lambda kind: F.array().cast(kind)
    links = F.when(F.col("url").isNotNull(), F.array(link)).otherwise(none(enrichment.LINKS))
    tags = F.when(F.col("source").isNotNull(), F.array("source")).otherwise(none("array<string>"))
    return docs.select("id", "ord", links.alias("links"), tags.alias("tags"), none(enrichment.ATTACHMENTS).alias("attachments"), F.lit(None).cast("map<string,string>").alias("meta"))


def enrichments_merged(spark: SparkSession, folder: str) -> DataFrame:
    """One enrichment per match from all documents about it: tags in order of first mention, and links."""
    return enrichment.merged(_enrichments(spark, folder)).select("id", "tags", F.transform("links", lambda x: x["url"]).alias("urls"))


def catalog_enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows with the bits that the merged enrichments add."""
    return enrichment.enriched(table(spark, folder, "match_catalog").select("row_id", "id", "flags", "event"), _enrichments(spark, folder))


def enrichment_additions(spark: SparkSession, folder: str) -> DataFrame:
    """Tags and links that crawled documents bring beyond those of the others."""
    every = _enrichments(spark, folder).withColumn("crawled", F.array_contains("tags", "crawl"))
    have, add = (enrichment.merged(every.filter(test).drop("crawled")) for test in ("not crawled", "crawled"))
    return enrichment.additions(have, add).select("id", "tags", F.transform("links", lambda x: x["url"]).alias("urls"))


def transcript_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts of the .mat files of which another with the same players and length has nearly the same rolls: how many belong together."""
    files = _files(spark, folder)
    names = F.array_join(F.array_sort(F.array(*[F.coalesce(normalise(F.col(p)), F.lit("")) for p in ("p0", "p1")])), "|")
    scanned = transcripts.scan(files).select("path", F.concat_ws("|", names, F.col("match_length").cast("string")).alias("key"), F.array(F.split("rolls", " ")).alias("tokens"))
    return reconcile.clusters(spark, scanned).select("path", "members")


def moves_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of the moves of every .mat file."""
    return _files(spark, folder).filter("content is not null").select("path", moves_fingerprint(F.col("content")).alias("fingerprint"))


def shard_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Stored matches whose two files do not hold together."""
    latest = latest_by(table(spark, folder, "match_files").select("path", "shard", "hash", "ext", "content", "file_no"), "path", ["file_no"])
    return catalog_shard_problems(latest)


def shown_texts(spark: SparkSession, folder: str) -> DataFrame:
    """How lengths of matches, and times of day as places in a recording, are shown, and the seconds read back."""
    rows = table(spark, folder, "match_catalog").select("row_id", "len", (F.unix_seconds("submitted_at") % 86_400).alias("s"))
    spoken = F.format_string("%dh%dm%ds", F.floor(F.col("s") / 3600), F.floor(F.col("s") % 3600 / 60), F.col("s") % 60)
    return rows.select("row_id", length_text(F.col("len")).alias("length"), time_label(F.col("s")).alias("label"), video_seconds(spoken).alias("seconds"))


def names_hidden(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every .mat file when its names are hidden: the last digits of both pseudonyms, length, and rolls."""
    hidden = transcripts.scan(transcripts.hidden_texts(_files(spark, folder), KEY, "name:").withColumnRenamed("text", "content"))
    code = lambda c: F.regexp_extract(c, "^[a-z]+-[a-z]+-([0-9a-f]{4})$", 1)
    return hidden.select("path", code("p0").alias("code0"), code("p1").alias("code1"), "match_length", "date", "event", "rolls")


def match_json(spark: SparkSession, folder: str) -> DataFrame:
    """Every .mat file as JSON, read back by its schema: names, length, games, plays of each game, and stated points."""
    schema = "sides array<struct<name:string>>, matchLength int, date string, games array<struct<startScore:array<int>,actions:array<struct<kind:string,dice:array<int>>>,result:struct<points:int>>>"
    back = transcripts.json_texts(_files(spark, folder)).select("path", F.from_json("json", schema).alias("j"))
    plays = F.transform("j.games", lambda g: F.size(F.filter(g["actions"], lambda a: a["kind"] == "move")))
    points = F.transform("j.games", lambda g: F.coalesce(g["result"]["points"], F.lit(0)))
    return back.select("path", F.col("j.sides")[0]["name"].alias("p0"), F.col("j.sides")[1]["name"].alias("p1"), F.col("j.matchLength").alias("match_length"), "j.date", F.aggregate(plays, F.lit(0), lambda x, y: x + y).alias("plays"), points.alias("points"))


QUERIES = {
    f.__name__: f
    for f in (match_json, names_hidden, moves_fingerprints, shard_problems, shown_texts, enrichments_merged, catalog_enriched, enrichment_additions, transcript_copies, catalog_dictionaries, catalog_columns, catalog_decoded, player_filters, published_flags, listings_loaded, site_events, review_plan, review_plan_named, review_sheet, score_ledger)
}

_LATEST = f"""WITH latest AS (SELECT *, {_SHARD} AS shard FROM match_catalog QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1),
 ordered AS (SELECT *, by_login AS "by", row_number() OVER (PARTITION BY shard ORDER BY nullif(date, '') DESC NULLS LAST, id) - 1 AS n FROM latest),
 cells AS (SELECT shard, 'players' AS dictionary, n * 2 AS place, p0 AS value FROM ordered UNION ALL SELECT shard, 'players', n * 2 + 1, p1 FROM ordered UNION ALL SELECT shard, 'events', n * 2, event FROM ordered
   UNION ALL SELECT shard, 'rounds', n * 2, round FROM ordered UNION ALL SELECT shard, 'contributors', n * 2, "by" FROM ordered),
 codes AS (SELECT shard, dictionary, value, row_number() OVER (PARTITION BY shard, dictionary ORDER BY place) - 1 AS code FROM (SELECT shard, dictionary, value, min(place) AS place FROM cells WHERE value <> '' GROUP BY ALL))
"""
_CODE4 = f"substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('name:' || {_NORM.format('{0}')})))), 5, 4)"
_CODE = "coalesce((SELECT code FROM codes c WHERE c.shard = o.shard AND c.dictionary = '{}' AND c.value = o.{}), -1) AS \"{}\""
_FNV = "list_reduce(list_prepend({}::UBIGINT, list_transform(string_split(norm, ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_SITE = "(?:" + "|".join(review.SERVERS) + ")"
_INBOX_KEY = _DISPLAY.replace("p0", "players[1]").replace("p1", "players[2]").replace("len AS", "match_length AS")

_ENRICHED = """WITH d AS (SELECT match_id AS id, doc_id AS ord, nullif(regexp_extract(text, 'https?://[^ \\t\\r\\n]+'), '') AS url, source FROM documents WHERE match_id IS NOT NULL),
 t AS (SELECT id, list(source ORDER BY ord, source) AS tags FROM (SELECT id, source, min(ord) AS ord FROM d WHERE source IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 l AS (SELECT id, list(url ORDER BY ord, url) AS urls FROM (SELECT id, url, min(ord) AS ord FROM d WHERE url IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
"""

ORACLE = {
    "catalog_dictionaries": _LATEST + "SELECT * FROM codes",
    "catalog_columns": _LATEST
    + "SELECT shard, n, id, "
    + ", ".join(_CODE.format(d, f'"{c}"' if c == "by" else c, c) for d, columns in P.DICTIONARIES.items() for c in columns)
    + ", len FROM ordered o",
    "catalog_decoded": _LATEST + 'SELECT id, ' + ", ".join(f"nullif({c}, '') AS {c}" for c in ("p0", "p1", "event", "round", '"by"')) + " FROM ordered",
    "player_filters": f"""WITH names AS (SELECT DISTINCT {_SHARD} AS shard, norm FROM ({_SIDES}) WHERE norm <> ''), size AS (SELECT shard, greatest(256, cast(ceil(count(*) * 10 / 8.0) * 8 AS BIGINT)) AS bits FROM names GROUP BY 1),
      hashed AS (SELECT shard, bits, {_FNV.format(P.SEEDS[0])} AS h1, {_FNV.format(P.SEEDS[1])} | 1 AS h2 FROM names JOIN size USING (shard))
      SELECT DISTINCT shard, bits, cast(((h1 + i * h2) % 4294967296) % bits AS BIGINT) AS position FROM hashed, range(5) t(i)""",
    "published_flags": """WITH l AS (SELECT DISTINCT match_id AS id FROM documents WHERE match_id IS NOT NULL AND regexp_matches(text, 'https?://[^ \\t\\r\\n]+')), a AS (SELECT hash, bool_or(ext = 'sgf') AS an FROM match_files WHERE ext <> 'mat' GROUP BY 1)
      SELECT row_id, (CASE WHEN len(list_filter(games, lambda g: g.kind <> 'single')) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(games, lambda g: g.cube > 1)) > 0 THEN 2 ELSE 0 END + CASE WHEN a.an THEN 4 ELSE 0 END
        + CASE WHEN len(list_filter(games, lambda g: g.how IN ('resign', 'forfeit'))) > 0 THEN 8 ELSE 0 END + CASE WHEN a.hash IS NOT NULL THEN 16 ELSE 0 END + CASE WHEN l.id IS NOT NULL THEN 32 ELSE 0 END)::INT AS flags
      FROM match_records r LEFT JOIN l ON r.id = l.id LEFT JOIN a ON a.hash = split_part(r.id, '/', -1)""",
    "listings_loaded": f"SELECT row_id, shard FROM (SELECT row_id, batch_no, {_SHARD} AS shard FROM metas) QUALIFY batch_no = min(batch_no) OVER (PARTITION BY shard)",
    "site_events": f"""WITH s AS (SELECT row_id, trim(regexp_replace(provenance.site, '\\s+', ' ', 'g')) AS t FROM match_records),
      r AS (SELECT *, regexp_matches(t, '(?i)^{_SITE}[\\s:,;/-]') AS b, regexp_matches(t, '(?i)[\\s:,;/-]{_SITE}$') AS e,
        regexp_replace(CASE WHEN regexp_matches(t, '(?i)^{_SITE}[\\s:,;/-].') THEN regexp_extract(t, '(?i)^{_SITE}[\\s:,;/-](.*)$', 1) ELSE regexp_extract(t, '(?i)^(.*)[\\s:,;/-]{_SITE}$', 1) END, '^[\\s:,;/-]+|[\\s:,;/-]+$', '', 'g') AS rest FROM s),
      k AS (SELECT *, CASE WHEN t IS NULL OR t = '' THEN 'none' WHEN regexp_full_match(t, '(?i){_SITE}') THEN 'server' WHEN b OR e THEN CASE WHEN regexp_matches(rest, '\\p{{L}}{{3}}') THEN 'event' ELSE 'server' END ELSE 'place' END AS kind FROM r)
      SELECT row_id, kind, CASE kind WHEN 'event' THEN rest WHEN 'place' THEN t END AS value FROM k""",
    "review_plan": f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY moves ORDER BY coalesce(file, ''), item_id) AS nth, first_value(coalesce(file, '')) OVER (PARTITION BY moves ORDER BY coalesce(file, ''), item_id) AS first_file, {_INBOX_KEY} AS key FROM inbox_items),
      stored AS (SELECT {_DISPLAY} AS key, min(id) AS clash FROM match_catalog GROUP BY 1),
      originals AS (SELECT * FROM o WHERE moves IS NULL OR moves = '' OR nth = 1),
      sized AS (SELECT key, count(*) AS n, min(struct_pack(f := coalesce(file, ''), i := item_id)) AS place, count(DISTINCT CASE WHEN time <> '' THEN coalesce(date, '') || ' ' || time END) = count(*) AS timed FROM originals GROUP BY key),
      grouped AS (SELECT *, row_number() OVER (ORDER BY place) AS group_no FROM sized LEFT JOIN stored USING (key) WHERE n > 1 OR clash IS NOT NULL),
      p AS (SELECT x.*, g.group_no, g.n, g.clash, g.n > 1 AND g.timed AS told, row_number() OVER (PARTITION BY x.key ORDER BY coalesce(x.date, '') || ' ' || x.time, coalesce(x.file, ''), x.item_id) AS i FROM originals x JOIN grouped g USING (key))
      SELECT item_id, CASE WHEN n > 1 AND NOT told OR clash IS NOT NULL AND NOT told THEN 'same' ELSE 'series' END AS status, group_no, nullif(event, '') AS event,
        CASE WHEN told THEN coalesce(nullif(round, '') || ' - ', '') || 'Match ' || i || ' of ' || n ELSE nullif(round, '') END AS round, nullif(date, '') AS date, cast(NULL AS VARCHAR) AS copy_of FROM p
      UNION ALL SELECT item_id, 'duplicate', NULL, nullif(event, ''), nullif(round, ''), nullif(date, ''), first_file FROM o WHERE moves <> '' AND nth > 1""",
    "enrichments_merged": _ENRICHED + "SELECT id, coalesce(tags, []) AS tags, coalesce(urls, []) AS urls FROM (SELECT DISTINCT id FROM d) LEFT JOIN t USING (id) LEFT JOIN l USING (id)",
    "catalog_enriched": _ENRICHED + "SELECT row_id, m.id, coalesce(flags, 0) | CASE WHEN l.id IS NOT NULL THEN 32 ELSE 0 END AS flags, event FROM match_catalog m LEFT JOIN l USING (id)",
    "enrichment_additions": """WITH d AS (SELECT match_id AS id, doc_id AS ord, nullif(regexp_extract(text, 'https?://[^ \\t\\r\\n]+'), '') AS url, source, coalesce(source = 'crawl', false) AS crawled FROM documents WHERE match_id IS NOT NULL),
      a AS (SELECT DISTINCT id FROM d WHERE crawled),
      u AS (SELECT id, list(url ORDER BY ord, url) AS urls FROM (SELECT id, url, min(ord) AS ord FROM d x WHERE crawled AND url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d y WHERE NOT y.crawled AND y.id = x.id AND y.url = x.url) GROUP BY 1, 2) GROUP BY 1)
      SELECT id, ['crawl'] AS tags, coalesce(urls, []) AS urls FROM a LEFT JOIN u USING (id)""",
    "transcript_copies": _SCAN
    + f"""SELECT path, members FROM (SELECT path, count(*) OVER (PARTITION BY list_sort([coalesce({_NORM.format("p0")}, ''), coalesce({_NORM.format("p1")}, '')]), match_length, rolls) AS members FROM scan) WHERE members > 1""",
    "names_hidden": _SCAN + f"SELECT path, {_CODE4.format('p0')} AS code0, {_CODE4.format('p1')} AS code1, match_length, date, cast(NULL AS VARCHAR) AS event, rolls FROM scan",
    "match_json": _SCAN + "SELECT path, p0, p1, match_length, date, len(string_split(rolls, ' '))::INT AS plays, points FROM scan",
    "moves_fingerprints": """SELECT concat_ws('#', file_no::VARCHAR, path) AS path, sha256(array_to_string(list_filter(list_transform(string_split(replace(content, chr(13), ''), chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))),
      lambda l: l <> '' AND NOT starts_with(l, ';') AND NOT regexp_full_match(l, '\\[[^\\]]*\\]')), chr(10))) AS fingerprint FROM match_files WHERE ext = 'mat' AND content IS NOT NULL""",
    "shard_problems": """WITH f AS (SELECT * FROM match_files QUALIFY row_number() OVER (PARTITION BY path ORDER BY file_no DESC) = 1), j AS (SELECT *, CASE WHEN ext = 'meta.json' AND json_valid(content) THEN content END AS js FROM f),
      g AS (SELECT shard, hash, max(CASE WHEN ext = 'mat' THEN length(content) END) AS mat, max(CASE WHEN ext = 'meta.json' THEN length(content) END) AS meta, max(CASE WHEN ext = 'meta.json' THEN coalesce(js->>'$.id', '') END) AS id,
        max(CASE WHEN ext = 'meta.json' THEN coalesce(js->>'$.contentHash', '') END) AS ch FROM j GROUP BY 1, 2)
      SELECT shard, hash, 'no_meta' AS problem FROM g WHERE meta IS NULL UNION ALL SELECT shard, hash, 'no_mat' FROM g WHERE mat IS NULL UNION ALL SELECT shard, hash, 'empty' FROM g WHERE mat = 0 OR meta = 0
      UNION ALL SELECT shard, hash, 'unreadable' FROM g WHERE meta > 0 AND id = '' UNION ALL SELECT shard, hash, 'hash' FROM g WHERE meta > 0 AND id <> '' AND NOT starts_with(ch, hash) UNION ALL SELECT shard, hash, 'id' FROM g WHERE meta > 0 AND id <> '' AND id <> concat_ws('/', shard, hash)""",
    "shown_texts": """SELECT row_id, CASE WHEN len = 0 THEN 'money game' WHEN len > 0 THEN len || ' pt' END AS length, CASE WHEN s >= 3600 THEN format('{}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{}:{:02d}', s // 60, s % 60) END AS label, s AS seconds
      FROM (SELECT row_id, len, epoch_us(submitted_at) // 1000000 % 86400 AS s FROM match_catalog)""",
    "review_sheet": "SELECT row_id, concat_ws(chr(9), "
    + ", ".join(f"CASE WHEN regexp_matches(coalesce({c}::VARCHAR, ''), '^\"|[\\t\\r\\n]') THEN '\"' || replace({c}::VARCHAR, '\"', '\"\"') || '\"' ELSE coalesce({c}::VARCHAR, '') END" for c in SHEET.values())
    + ") AS raw FROM meta_review",
    "score_ledger": _SCAN
    + """, g AS (SELECT path, starts, points, unnest(range(len(starts))) AS game FROM scan),
      v AS (SELECT path, game::INT AS game, split_part(starts[game + 1], '-', 1)::INT AS s0, split_part(starts[game + 1], '-', 2)::INT AS s1, CASE WHEN game > 0 THEN split_part(starts[game], '-', 1)::INT ELSE split_part(starts[1], '-', 1)::INT END AS b0,
        CASE WHEN game > 0 THEN split_part(starts[game], '-', 2)::INT ELSE split_part(starts[1], '-', 2)::INT END AS b1, CASE WHEN game > 0 THEN points[game] ELSE 0 END AS stated FROM g)
      SELECT path, game, s0, s1, stated, least(s0 - b0, s1 - b1) = 0 AND greatest(s0 - b0, s1 - b1) = stated AS kept FROM v""",
}
