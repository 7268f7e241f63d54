import json

from pyspark.sql import functions as F

from pipworks.operators import catalog, publishing, review, transcripts
from pipworks.plans import publishing as plans
from pipworks.sources.reject_loader import SHEET_COLUMNS, load_lines

ITEMS = "item_id long, file string, players array<string>, match_length int, date string, time string, event string, round string, moves string, key string"
STORED = "id string, p0 string, p1 string, date string, event string, round string, len int"
NAMES = "item_id long, event string, round string, date string, time string, number int, of int"


def _plan(spark, items, stored=(), names=None):
    frame = spark.createDataFrame([(*i, "clash") for i in items], ITEMS)
    said = spark.createDataFrame(names, NAMES) if names is not None else None
    rows = review.plan(spark, frame, spark.createDataFrame(list(stored), STORED), said).collect()
    return {r.item_id: (r.status, r.group_no, r.event, r.round, r.date, r.copy_of) for r in rows}


def test_review_tells_copies_series_and_look_alikes(spark):
    both = ["Ann", "Bob"]
    items = [
        (1, "a.mat", both, 5, "2020-01-01", "10:00", "Cup", None, "m1"), (2, "b.mat", both[::-1], 5, "2020-01-01", "12:00", "Cup", "", "m2"), (3, "c.mat", both, 5, "2020-01-01", "10:00", "Cup", None, "m1"),
        (4, "d.mat", ["Cal", "Dee"], 7, None, None, None, None, None), (5, "e.mat", ["Cal", "Dee"], 7, None, None, None, None, None), (6, "f.mat", ["Eve", None], 3, "2021", None, "Open", "R1", "m6"),
        (7, None, None, None, None, None, None, None, ""), (8, "h.mat", ["Gus", "Hal"], 9, None, None, "", None, "m8"),
    ]
    got = _plan(spark, items, [("1/x", "eve", None, "2021", "open", "r1", 3), ("1/y", "Eve", "", "2021", "Open", "R1", 3)])
    assert got == {
        1: ("series", 1, "Cup", "Match 1 of 2", "2020-01-01", None), 2: ("series", 1, "Cup", "Match 2 of 2", "2020-01-01", None), 3: ("duplicate", None, "Cup", None, "2020-01-01", "a.mat"),
        4: ("same", 2, None, None, None, None), 5: ("same", 2, None, None, None, None), 6: ("same", 3, "Open", "R1", "2021", None),
    }
    names = [(4, None, "Match 1", None, None, 1, None), (5, None, "Match 2", None, None, 2, None), (6, "No", "Final - Match 4 of 5", None, None, 4, 5), (8, "Harbor", None, "2019", None, None, None)]
    got = _plan(spark, items, [("1/x", "eve", None, "2021", "open", "r1", 3)], names)
    assert got[4] == ("series", 2, None, "Match 1", None, None) and got[5][3] == "Match 2"
    assert got[6] == ("series", 3, "Open", "R1 - Match 4 of 5", "2021", None)
    assert got[8] == ("name", None, "Harbor", None, "2019", None)
    assert _plan(spark, []) == {}


def test_times_of_a_name_order_a_series(spark):
    items = [(k, f"{k}.mat", ["Ann", "Bob"], 5, None, None, None, "Final", f"m{k}") for k in (1, 2)]
    names = [(1, None, None, "2020-01-01", "18:00", None, None), (2, None, None, "2020-01-01", "09:30", None, None)]
    got = _plan(spark, items, names=names)
    assert got[1][3] == "Final - Match 2 of 2" and got[2][3] == "Final - Match 1 of 2"


def test_sites(spark):
    said = {None: ("none", None), "  ": ("none", None), "FIBS": ("server", None), "Backgammon Galaxy  River Cup 2025": ("event", "River Cup 2025"), "gridgammon: 12": ("server", None), "Autumn Open, PlayOK": ("event", "Autumn Open"), "Monte  Carlo": ("place", "Monte Carlo"), "Fibsburg": ("place", "Fibsburg")}
    df = spark.createDataFrame([(k,) for k in said], "site string").select("site", review.site_says(F.col("site")).alias("s"))
    assert {r.site: (r.s.kind, r.s.value) for r in df.collect()} == said


def test_sheet_lines_are_read_back(spark):
    rows = [(1, 'say "x"', '"quoted"', "a\tb", None), (2, "", None, "plain", "é")]
    df = spark.createDataFrame(rows, "row_id long, file string, players string, event string, note string").withColumn("none", F.lit(None).cast("string"))
    columns = {c: c if c in ("file", "players", "event", "note") else "none" for c in SHEET_COLUMNS}
    lines = review.sheet_lines(df, columns).select(F.col("row_id").alias("line_id"), F.lit("s").alias("sheet"), F.lit(2).alias("line_no"), "raw")
    back = {r.line_id: (r.file, r.players, r.event, r.note) for r in load_lines(lines).filter("reason is null").collect()}
    assert back == {1: ('say "x"', '"quoted"', "a\tb", None), 2: (None, None, "plain", "é")}


def test_columnar_catalog_is_read_back(spark):
    rows = [("1/b", "Ann", None, "Cup", "", "x", None), ("1/a", "Bob", "Ann", None, "R1", None, None), ("1/c", "Ann", "Ann", "Cup", "R1", "y", "2020"), ("2/a", "", "Zoe", None, None, None, "1999-01")]
    df = spark.createDataFrame(rows, "id string, p0 string, p1 string, event string, round string, by string, date string").withColumn("shard", F.substring_index("id", "/", 1)).withColumn("code", F.lit(7))
    ordered = publishing.catalog_order(df)
    assert [r.id for r in ordered.orderBy("shard", "n").collect()] == ["1/c", "1/a", "1/b", "2/a"]
    codes = publishing.dictionaries(ordered)
    players = {(r.shard, r.value): r.code for r in codes.filter("dictionary = 'players'").collect()}
    assert players == {("1", "Ann"): 0, ("1", "Bob"): 1, ("2", "Zoe"): 0}
    back = {r.id: (r.p0, r.p1, r.event, r.round, r.by) for r in publishing.decoded_rows(publishing.encoded_rows(ordered, codes), codes).collect()}
    assert back == {i: tuple(v or None for v in rest[:5]) for i, *rest in rows}
    assert publishing.dictionaries(publishing.catalog_order(df.limit(0))).count() == 0


def test_filter_positions_hold_every_name(spark):
    names = [("1", n) for n in ("ann", "bob", "zoë", "𝔞", "")] + [("2", None)]
    got = publishing.filter_positions(spark.createDataFrame(names, "shard string, name string"))
    rows = got.collect()
    assert {r.shard for r in rows} == {"1"} and {r.bits for r in rows} == {256}
    h = 0x811C9DC5
    for c in "ann":
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    assert h % 256 in {r.position for r in rows} and len(rows) <= 25


def test_flags_of_missing_parts(spark):
    schema = "games array<struct<kind:string,how:string,cube:int>>, attachments array<struct<kind:string,analysis:boolean>>, links array<string>, illegal array<string>"
    rows = [(None, None, None, None), ([("gammon", "bearOff", 1)], [("sgf", True)], ["u"], ["p"]), ([(None, None, None), ("single", "forfeit", 4)], [("xg", None)], [], [])]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(publishing.flags_of(*[F.col(c) for c in ("games", "attachments", "links", "illegal")])).collect()]
    assert got == [0, 1 + 4 + 16 + 32 + 64, 2 + 8 + 16]
    assert df.select(publishing.flags_of(F.col("games"))).count() == 3


def test_first_listing_wins(spark):
    rows = spark.createDataFrame([(1, "b", 2), (2, "a", 1), (3, "b", 1), (4, "b", 1)], "row_id long, shard string, source int")
    assert {r.row_id for r in publishing.first_listings(rows, "source", "shard").collect()} == {2, 3, 4}


def test_names_are_hidden_and_plays_stay(spark):
    text = '; [Event "Cup"]\n; [EventDate "2020.01.02"]\n; [Remark "Ann was late"]\n3 point match\n\n Game 1\n Ann, 1800 : 0                 Bob : 0\n  1) 31: 8/5 6/5                64: 24/14\n'
    files = spark.createDataFrame([("a", text), ("b", "no match"), ("c", None)], "path string, content string")
    hidden = {r.path: r.text for r in transcripts.hidden_texts(files, b"k" * 32, "d:").collect()}
    assert set(hidden) == {"a"} and not any(w in hidden["a"] for w in ("Ann", "Bob", "Cup", "1800", "late"))
    assert "31: 8/5 6/5" in hidden["a"] and "2020.01.02" in hidden["a"]
    assert transcripts.hidden_texts(files.limit(0), b"k" * 32, "d:").count() == 0
    got = json.loads(transcripts.json_texts(files).first().json)
    assert [s["name"] for s in got["sides"]] == ["Ann", "Bob"] and got["games"][0]["actions"][0] == {"side": 0, "kind": "move", "dice": [3, 1], "moves": "8/5 6/5"} and got["games"][0]["result"] is None


def test_stored_matches_that_do_not_hold_together(spark):
    meta = lambda s, h: json.dumps({"id": f"{s}/{h}", "contentHash": h + "00"})
    rows = [("1", "aa", "mat", "x"), ("1", "aa", "meta.json", meta("1", "aa")), ("1", "bb", "mat", ""), ("1", "bb", "meta.json", "{"), ("1", "cc", "meta.json", meta("2", "dd")), ("1", "ee", "mat", None)]
    files = spark.createDataFrame(rows, "shard string, hash string, ext string, content string")
    got = {(r.hash, r.problem) for r in catalog.shard_problems(files).collect()}
    assert got == {("bb", "empty"), ("bb", "unreadable"), ("cc", "no_mat"), ("cc", "hash"), ("cc", "id"), ("ee", "no_meta"), ("ee", "no_mat")}
    assert catalog.shard_problems(files.limit(0)).count() == 0


def test_shards_are_filled_in_order_within_sources(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 5 else "cold") for k in range(100)], "row_id long, source_key string")
    got = {r.row_id: (r.source_key, r.shard_no) for r in catalog.filled_shards(spark, rows, ["row_id"], 30).collect()}
    hot = [k for k in range(100) if k % 5]
    assert all(got[k] == ("hot", n // 30) for n, k in enumerate(hot)) and all(got[k] == ("cold", 0) for k in range(0, 100, 5))


def _documents(spark, folder):
    """Documents whose keys are beyond 32 bits, where 2**31 + 5 would come first and 2**33 second if only those were kept."""
    rows = [(2**33, "https://b.example/1 x", "crawl", "0001/a"), (3, "see http://a.example/2", "forum", "0001/a"), (2**31 + 5, "http://a.example/2 again", "crawl", "0001/a"), (2**40, None, None, "0001/b"), (2**40 + 1, "https://c.example", "crawl", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, match_id string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_catalog_is_enriched_from_documents_with_large_keys(spark, tmp_path):
    folder = _documents(spark, tmp_path)
    rows = [(2**40, "0001/a", 1, "Cup"), (2**40 + 1, "0001/b", None, None), (1, "0001/c", 2, "Open")]
    spark.createDataFrame(rows, "row_id long, id string, flags int, event string").write.parquet(f"{folder}/match_catalog.parquet")
    got = {(r.row_id, r.id, r.flags, r.event) for r in plans.catalog_enriched(spark, folder).collect()}
    assert got == {(2**40, "0001/a", 33, "Cup"), (2**40 + 1, "0001/b", 0, None), (1, "0001/c", 2, "Open")}


def test_additions_from_documents_with_large_keys(spark, tmp_path):
    got = [(r.id, r.tags, r.urls) for r in plans.enrichment_additions(spark, _documents(spark, tmp_path)).collect()]
    assert got == [("0001/a", ["crawl"], ["https://b.example/1"])]


def test_enrichments_of_documents_with_large_keys_are_merged(spark, tmp_path):
    got = {r.id: (r.tags, r.urls) for r in plans.enrichments_merged(spark, _documents(spark, tmp_path)).collect()}
    assert got == {"0001/a": (["forum", "crawl"], ["http://a.example/2", "https://b.example/1"]), "0001/b": ([], [])}
