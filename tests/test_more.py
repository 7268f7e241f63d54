from pyspark.sql import functions as F

from pipworks.functions.pseudonyms import ADJECTIVES, ANIMALS, hide_names, is_pseudonym, pseudonym
from pipworks.kernels.file_names import propose
from pipworks.kernels.sequences import lcs_length, shared_rolls
from pipworks.operators import enrichment
from pipworks.operators.reconcile import reconcile


def test_words():
    assert len(set(ADJECTIVES)) == len(set(ANIMALS)) == 64


def test_pseudonyms(spark):
    import hashlib
    import hmac

    key = bytes(range(32))
    df = spark.createDataFrame([("Sam ",), ("sam",), ("Zoë",), (None,), ("",), ("brave-fox-00ff",)], "name string")
    got = [r[0] for r in df.select(pseudonym(F.col("name"), key, "NAME\n")).collect()]
    h = hmac.new(key, b"NAME\nsam", hashlib.sha256).digest()
    assert got[0] == got[1] == f"{ADJECTIVES[h[0] & 63]}-{ANIMALS[h[1] & 63]}-{h[2:4].hex()}" and got[2] != got[0] and got[3:] == [None, "", "brave-fox-00ff"]
    assert df.filter(is_pseudonym(F.col("name"))).count() == 1
    hidden = hide_names(df.withColumn("event", F.lit("x")), key, ["name"], ["event"], "NAME\n").collect()
    assert sorted(map(str, got)) == sorted(str(r["name"]) for r in hidden) and {r["event"] for r in hidden} == {None}


def test_file_name_proposals():
    a = propose("2006 Ash-Birch Harbor Winter Trophy Last 16 #4 9pnts", ["Ann Ash", "Bob Birch"])
    assert (a.date, a.number, a.event) == ("2006", 4, "Harbor Winter Trophy Last 2006")
    b = propose("Ash vs Birch 2. Match 28.12.2022 Harbor Cup", ["Ann Ash", "Bob Birch"])
    assert (b.date, b.number, b.round, b.event) == ("2022-12-28", 2, "Match 2", "Harbor Cup")
    c = propose("Harbor_Open_2023_Semi-final_Ash_Birch_match3", ["Ann Ash", "Bob Birch"])
    assert (c.stage, c.round, c.event) == ("Semi-final", "Semi-final - Match 3", "Harbor Open 2023")
    d = propose("2026-01-20T15-36-47-ash-birch", ["ash", "birch"])
    assert (d.date, d.time, d.event) == ("2026-01-20", "15:36", None)
    assert propose("match_14045043").event is None and propose("").event is None
    assert propose("Cup 2 of 5").of == 5 and propose("20209931 Cup").date is None


def test_shared_rolls():
    assert shared_rolls([], []) == (1.0, None)
    assert shared_rolls([["a", "b"]], [["a", "c"]]) == (0.5, (0, 1))
    assert shared_rolls([["a"]], [["a"], ["b"]]) == (0.5, (1, 0))
    assert lcs_length("abcbdab", "bdcaba") == 4


def _text(rows, event=None, start="0"):
    head = f'; [Event "{event}"]\n' if event else ""
    return head + f"3 point match\n\n Game 1\n Ann : {start}                               Bob : 0\n" + "\n".join(rows) + "\n"


def test_reconcile(spark):
    rows = ["  1) 31: 8/5 6/5                        Doubles => 2", "  2)  Drops", "                                        Wins 1 point"]
    more = ["  1) 31: 8/5 6/5                        Doubles => 2", "  2)  Drops", "                                        Wins 3 points"]
    files = spark.createDataFrame([("a.mat", _text(rows)), ("b.mat", _text(more, "Harbor Cup")), ("c.mat", _text(["  1) 64: 24/14"])), ("d.mat", "?")], "path string, content string")
    got = {r.path: (r.decision, r.event) for r in reconcile(spark, files).collect()}
    assert got == {"a.mat": ("keep", "Harbor Cup"), "b.mat": ("superseded", "Harbor Cup")}


def test_enrichments(spark):
    link = lambda u, g=None: (u, g, None)
    rows = [("1", 1, [link("u")], ["x", "y"], [("sgf", 1, "a")], {"event": "E", "round": None}), ("1", 2, [("u", None, "second"), link("v", 2)], ["z", "x"], [("sgf", 2, "b")], {"event": None}), ("2", 1, None, None, None, None)]
    records = spark.createDataFrame(rows, enrichment.SCHEMA)
    one = enrichment.merged(records).filter("id = '1'").first()
    assert [(x.url, x.title) for x in one.links] == [("u", None), ("v", None)] and one.tags == ["x", "y", "z"] and one.attachments[0].sha256 == "b" and one.meta == {"event": None, "round": None}
    catalog = spark.createDataFrame([("1", "old", "r", "2020", 1), ("2", "old", "r", None, 0), ("3", "old", "r", None, None)], "id string, event string, round string, date string, flags int")
    got = {r.id: (r.event, r.round, r.date, r.flags) for r in enrichment.enriched(catalog, records).collect()}
    assert got == {"1": (None, None, "2020", 49), "2": ("old", "r", None, 0), "3": ("old", "r", None, 0)}
    added = enrichment.additions(enrichment.merged(records.filter("ord = 1")), records.filter("ord = 2")).first()
    assert [x.url for x in added.links] == ["v"] and added.tags == ["z"]


def test_erasure(spark, tmp_path):
    path = tmp_path / "erased.tsv"
    path.write_text("# kept for refusals\nh9\t0001/h9\t2020-01-01\trights\n")
    erased = enrichment.read_erased(spark, str(path))
    matches = spark.createDataFrame([("h1", "0001/h1"), ("h2", "0001/h2"), ("h9", "0002/h9")], "content_hash string, id string")
    left, whole = enrichment.erase(matches, erased, ["0001/h1"], "2024-01-01", "legal")
    assert [r.id for r in left.collect()] == ["0001/h2"] and whole.count() == 2
    enrichment.write_hash_list(left, str(tmp_path / "0007.tsv"))
    assert [(r.content_hash, r.id) for r in enrichment.read_hash_lists(spark, str(tmp_path / "0007.tsv")).collect()] == [("h2", "0001/h2")]


def test_command_line_is_described(capsys):
    from pipworks.cli import main

    try:
        main(["--help"])
    except SystemExit as e:
        assert e.code == 0
    assert "reconcile" in capsys.readouterr().out
