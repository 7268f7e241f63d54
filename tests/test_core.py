import json

import pytest
from pyspark.sql import functions as F

from pipworks.functions.query import current_token, iso_date, number_range, parse, predicate, to_text
from pipworks.functions.text import hmac_sha256, natural_key, normalise, time_label, video_link, video_seconds
from pipworks.operators.compaction import CompactionStore, listing_issues, plain_path, stored_files
from pipworks.operators.components import components, group_pairs
from pipworks.operators.ranking import global_rank
from pipworks.operators.sketches import bloom_filter, bloom_might_contain
from pipworks.operators.transcripts import summaries
from pipworks.sources.reject_loader import SHEET_COLUMNS, accepted, load_lines, refused
from pipworks.storage import Scratch, exists, shared_root, write_text
from pipworks.streaming.inbox import ingest


def _sheet(spark, lines):
    rows = [(k, "s", n, raw, "extra") for k, (n, raw) in enumerate(lines)]
    return spark.createDataFrame(rows, "line_id long, sheet string, line_no int, raw string, reason string")


def test_reject_reasons(spark):
    row = lambda **c: "\t".join(c.get(x, "") for x in SHEET_COLUMNS)
    cases = [
        (1, "status\taction"), (2, row(status="name")), (3, row(action=" REJECT ")), (4, row(action="no")), (5, row(date="2021-02-29")), (6, row(date=" 2020-02-29 ")), (7, row(date="2020-13")), (8, row(round="x" * 121)), (9, row(round="x" + " \t"[0] * 200 + "y")),
        (10, row(round="a\x07b")), (11, row(status="n")[:-1]), (12, row(status="n") + "\t"), (13, '"open' + row()), (14, '"a"b' + row()), (15, '"a\tb"' + row()), (16, None), (17, " \t "), (18, ""), (19, row(note='say "x"') + "\r"), (20, row(action="x", date="y")), (21, row(round="a\x0bb")), (22, row(status='"')), (23, '"""q"""' + row()), (24, row(date="0000")),
    ]
    got = {r.line_id: r.reason for r in load_lines(_sheet(spark, cases)).collect()}
    want = {2: None, 3: None, 4: "action", 5: "date", 6: None, 7: "date", 8: "round", 9: None, 10: "round", 11: "columns", 12: "columns", 13: "quoting", 14: "quoting", 15: None, 19: None, 20: "action", 21: None, 22: "quoting", 23: None, 24: None}
    assert {cases[k][0]: v for k, v in got.items()} == want


def test_private_use_characters_stay_as_they_are(spark):
    cell = "a\ue000b\ue001\rc"
    raw = "\t".join([*SHEET_COLUMNS[:11], cell])
    got = load_lines(_sheet(spark, [(2, raw.replace("action", "").replace("date", ""))])).first()
    assert got.reason is None and got.note == cell


def test_loader_edges(spark):
    loaded = load_lines(_sheet(spark, []))
    assert loaded.count() == 0 and refused(loaded).count() == 0 and accepted(loaded).count() == 0
    long = "x" * 200_000
    one = accepted(load_lines(_sheet(spark, [(2, "\t".join([long, "Reject", "7", *[""] * 9]))] * 2))).collect()
    assert [(r.status, r.action, r.group_no) for r in one] == [(long, "reject", 7)] * 2


def _files(spark, rows):
    return spark.createDataFrame([(k, p, c, None) for k, (p, c) in enumerate(rows)], "file_no long, path string, content string, modified_at timestamp")


def test_compaction_keeps_each_file_once(spark, tmp_path):
    rows = [(f"data/{k}.mat", "x" * (k % 700)) for k in range(400)] + [("./data//3.mat", "new"), ("data\\4.mat", "y"), (None, "z"), ("data/null", None)]
    store = CompactionStore(spark, f"file://{tmp_path}/store", target=30_000, fan_in=16)
    once = stored_files(_files(spark, rows))
    done = store.compact(once)
    assert len(done) >= 2
    held = {r.path: r.content for r in store.files().collect()}
    assert store.files().count() == len(held) == 401
    assert held["data/3.mat"] == "new" and held["data/4.mat"] == "y" and held["data/null"] == ""
    assert store.containers().count() < 40
    assert store.compact(once) == []
    more = stored_files(_files(spark, [("later/1", "a"), ("data/1.mat", "b"), ("data/2.mat", "xx")]))
    store.compact(more)
    held = {r.path: r.content for r in store.files().collect()}
    assert store.files().count() == len(held) == 402 and held["data/1.mat"] == "b" and held["data/2.mat"] == "xx"
    assert store.containers().agg(F.sum("files")).first()[0] == 402
    for k in range(4):  # merging drops what was replaced
        store.compact(stored_files(_files(spark, [(f"more/{k}/{j}", "y" * 90) for j in range(3)] + [("data/1.mat", f"c{k}")])))
    held = {r.path: r.content for r in store.files().collect()}
    assert store.files().count() == len(held) == 414 and held["data/1.mat"] == "c3"


def test_small_batches_leave_full_containers_alone(spark, tmp_path):
    store = CompactionStore(spark, f"file://{tmp_path}/full", target=4_000, fan_in=16)
    store.compact(stored_files(_files(spark, [(f"f{k}", "x" * 500) for k in range(200)])))
    sizes = [r.bytes for r in store.containers().collect()]
    assert max(sizes) <= 4_000 and len(sizes) <= 50
    full = {r.unit for r in store.containers().filter("bytes >= 2000").collect()}
    assert len(full) > 20
    store.compact(stored_files(_files(spark, [(f"g{k}", "y" * 500) for k in range(4)])))
    assert full <= {r.unit for r in store.containers().collect()} and store.files().count() == 204


def test_a_crash_between_two_steps_loses_nothing(spark, tmp_path, monkeypatch):
    store = CompactionStore(spark, f"file://{tmp_path}/crash", fan_in=8)
    store.compact(stored_files(_files(spark, [(f"f{k}", "x" * 50) for k in range(20)])))
    real = CompactionStore._set_head
    monkeypatch.setattr(CompactionStore, "_set_head", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.compact(stored_files(_files(spark, [("g", "new")])))
    monkeypatch.setattr(CompactionStore, "_set_head", real)
    assert store.files().count() == 20
    store.compact(stored_files(_files(spark, [("g", "new")])))
    assert store.files().count() == 21
    with pytest.raises(FileExistsError):
        write_text(spark, f"file://{tmp_path}/crash/journal/heads/{store._heads()[-1]}", "[]")


def test_compaction_survives_an_interruption(spark, tmp_path, monkeypatch):
    once = stored_files(_files(spark, [(f"f{k}", "x" * 50) for k in range(60)]))
    store = CompactionStore(spark, f"file://{tmp_path}/s", fan_in=8)
    monkeypatch.setattr("pipworks.operators.compaction.write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    try:
        store.compact(once)
        raise AssertionError
    except OSError:
        pass
    monkeypatch.undo()
    assert store.files().count() == 0
    store.compact(once)
    assert store.files().count() == 60


def test_compaction_of_nothing(spark, tmp_path):
    store = CompactionStore(spark, f"file://{tmp_path}/e")
    assert store.compact(stored_files(_files(spark, []))) == [] and store.files().count() == 0


def test_plain_path(spark):
    df = spark.createDataFrame([("./a//b/./c/",), ("/a\\b",), ("a.b/c.d",)], "p string")
    assert [r[0] for r in df.select(plain_path(F.col("p"))).collect()] == ["a/b/c", "a/b", "a.b/c.d"]


def test_listing_issues(spark):
    paths = spark.createDataFrame([("1", "a", "b"), ("2", "./a", None)], "id string, mat string, meta string")
    got = {tuple(r) for r in listing_issues(paths, _files(spark, [("a", ""), ("a", ""), ("c", "x")])).collect()}
    assert got == {("missing", "b"), ("unlisted", "c"), ("listed_twice", "a"), ("seen_twice", "a"), ("empty", "a")}


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(spark, links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(spark, links.limit(0)).count() == 0
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 9)], "g int, k int")
    assert group_pairs(members, "g", "k").count() == 3


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = global_rank(spark, df, [F.col("v").desc()]).collect()
    assert sorted((r["rank"], r["v"]) for r in got) == [(k + 1, 999 - k) for k in range(1000)]


def test_bloom_has_no_false_negatives(spark):
    items = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom = bloom_filter(items, "k")
    assert bloom_might_contain(items, "k", bloom).count() == 2000
    others = spark.range(5000, 9000).select(F.concat(F.lit("k"), "id").alias("k"))
    assert bloom_might_contain(others, "k", bloom).count() < 200


def test_search_text_round_trip():
    for text in ['player:smith player:"Dale H" year:2019.. has:gammon,cube', "date:2026-02..2026-03 len:money final", "by:octocat year:..2020"]:
        assert to_text(parse(text)) == text
    assert parse("vs:x by:@y").by == ["y"] and parse("vs:x").player == ["x"]
    assert (iso_date("24.2.2026"), iso_date("2026/2"), iso_date("31-02-2026"), iso_date("1-13-2026"), iso_date("2026")) == ("2026-02-24", "2026-02", "2026-02-31", None, None)
    assert (number_range("5..9"), number_range("..3"), number_range(".."), number_range("money", True)) == ((5, 9), (None, 3), None, (0, 0))
    assert current_token('a player:"Da le') == (2, "player", "Da le") and current_token("a ") is None
    assert parse("foo:1 has:x len:a").errors


def test_predicate_edges(spark):
    rows = [(1, None, "ann ash", "", None, "2020", 2020, 5, 3, None, "ann ash"), (2, "ann ash", "bob", "Cup", "R", "2020-05-06", 2020, 0, 0, "Oct", "ann ash bob cup"), (3, "ann ash", "ann ash", "", None, "", None, 7, 1, "x", "ann ash ann ash")]
    df = spark.createDataFrame(rows, "row_id long, n0 string, n1 string, event string, round string, date string, year int, len int, flags int, by_login string, hay string")
    hit = lambda text: {r.row_id for r in df.filter(predicate(parse(text))).collect()}
    assert hit("") == {1, 2, 3} and hit("player:ANN") == {1, 2, 3} and hit("player:ann player:bob") == {2} and hit("player:ann player:ann") == {3}
    assert hit("date:2020-05") == {2} and hit("year:..2020") == {1, 2} and hit("len:money") == {2} and hit("has:gammon,cube") == {1} and hit("by:OCT") == {2} and hit("player:a player:b player:c") == set()


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ž^Ř  é`ø ", "Round 10", "1h2m3s", "https://youtu.be/abcdefghijk?t=3")], "a string, b string, c string, d string")
    row = df.select(normalise(F.col("a")), natural_key(F.col("b"), 4), video_seconds(F.col("c")), video_link(F.col("d")), time_label(F.lit(3723))).first()
    assert tuple(row) == ("zr eø", "Round 0010", 3723, "https://www.youtube.com/watch?v=abcdefghijk", "1:02:03")
    want = "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"  # RFC 2104 with SHA-256
    assert spark.range(1).select(hmac_sha256(b"key", F.lit("The quick brown fox jumps over the lazy dog"))).first()[0] == want


def test_stream_stores_each_match_once(spark, tmp_path):
    text = "3 point match\n\n Game 1\n A : 0                                 B : 0\n  1) 31: 8/5 6/5                        Doubles => 2\n  2)  Drops\n                                        Wins 1 point\n"
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.mat").write_text(text)
    (inbox / "b.mat").write_text(text.replace("31: 8/5 6/5", "13: 6/5 8/5"))
    (inbox / "bad.mat").write_text("?")
    run = lambda: ingest(spark, str(inbox), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1
    (inbox / "c.mat").write_text(text)
    (inbox / "d.mat").write_text(text.replace("31: 8/5 6/5", "64: 24/14 "))
    run()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_summaries_report_bad_files(spark):
    files = spark.createDataFrame([("a", b"\x00\xff"), ("b", b""), ("c", b"(;GM[6]")], "path string, content binary")
    assert {r.path: r.status for r in summaries(files).collect()} == {"a": "error", "b": "error", "c": "error"} or summaries(files).count() == 3


def test_scratch(spark):
    scratch = Scratch(spark, "test")
    assert scratch.save(spark.range(3), "x").count() == 3
    assert scratch.root.startswith(shared_root(spark))
    scratch.drop()
    assert not exists(spark, scratch.path("x"))


def test_registry():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    json.dumps(sorted(sql))
