"""The training-data operators against brute force, exact round trips and defined edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipworks.llm import covering, incremental, mixing, mojibake, name_forms, near_duplicates, packing, resolution, sequences, spam, spectral, tokens

POINT = ["13/8", "24/18", "6/5", "8/5", "13/10", "24/23", "bar/20", "8/2", "11/7", "6/off", "10/4", "7/5", "22/16", "18/13", "9/3"]


def _game(rng, n):
    return [f"{rng.randint(1, 6)}{rng.randint(1, 6)}: {rng.choice(POINT)} {rng.choice(POINT)}" for _ in range(n)]


def _transcript(games):
    out = []
    for k, g in enumerate(games, 1):
        out.append(f"Game {k}")
        out += [f"{r + 1}) {'   '.join(g[2 * r : 2 * r + 2])}" for r in range((len(g) + 1) // 2)]
    return "\n".join(out)


# Sequences and sketches


def test_lcs_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert sequences.lcs_length(a, b) == t[-1][-1]


@pytest.mark.parametrize(("a", "b", "limit", "within"), [("abc", "acb", 1, True), ("abc", "abcd", 1, True), ("abc", "xbc", 1, True), ("abcd", "badc", 1, False), ("abcd", "badc", 2, True), ("", "ab", 1, False), ("same", "same", 0, True)])
def test_edit_distance(a, b, limit, within):
    assert sequences.edit_distance_at_most(a, b, limit) is within


def test_masks_cover_the_radius():
    """Whatever coordinates within the radius differ, some mask keeps none of them."""
    for differ in itertools.combinations(range(covering.WIDTH), covering.radius()):
        assert any(not set(m) & set(differ) for m in covering.MASKS.tolist())
    one = covering.table_keys(np.arange(50, dtype=np.uint64))
    assert (one == covering.table_keys(np.arange(50, dtype=np.uint64))).all() and len(set(one)) == len(covering.MASKS)
    assert not set(one) & set(covering.table_keys(np.arange(50, dtype=np.uint64), salt=1))


def test_bucket_links_stay_linear(spark):
    keys = spark.createDataFrame([(k, 1) for k in range(500)] + [(1, 2), (2, 2), (3, 2)], "node long, key long")
    links = covering.table_links(keys).collect()
    assert len(links) <= 2 * 500 + 3
    assert {(1, 2), (1, 3), (2, 3)} <= {tuple(r) for r in links}


def test_bucket_pairs_are_whole(spark, monkeypatch):
    """Every pair of a bucket, also where the bucket is cut into blocks; only pairs of one group and of sizes too far apart are left out."""
    monkeypatch.setattr(covering, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(n, k, n % 5 if n < 20 else n, 1 + n % 3) for k in range(3) for n in rng.sample(range(60), 40)]
    keys = spark.createDataFrame(rows, "node long, key long, group long, size long")
    for ratio in (0.0, 0.5):
        want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[2] != y[2] and min(x[3], y[3]) >= ratio * max(x[3], y[3])}
        got = [tuple(r) for r in covering.table_pairs(keys, ratio).collect()]
        assert len(got) == len(set(got)) and set(got) == want


# Near duplicates


def _brute(forms, same):
    """All pairs of the groups that links between all pairs give."""
    root = {k: k for k in forms}
    for a, b in itertools.combinations(sorted(forms), 2):
        if forms[a] is not None and forms[b] is not None and same(forms[a], forms[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if r == y else r for k, r in root.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(forms), 2) if root[a] == root[b]}


def _pairs(groups):
    by = {}
    for r in groups.collect():
        by.setdefault(r.root, []).append(r.id)
    return {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}


def test_transcripts_against_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(25):
        games = [_game(rng, rng.randint(8, 20)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(1, 4)):
            copy = [list(g) for g in games]
            for _ in range(rng.randint(0, 3)):
                g = rng.choice(copy)
                k = rng.randrange(len(g))
                if rng.random() < 0.5:
                    g[k] = _game(rng, 1)[0]
                else:
                    del g[k]
            if rng.random() < 0.4:
                rng.shuffle(copy)
            text = _transcript(copy)
            rows.append((n, text.replace("bar", "Bar").replace("off", "Off") if rng.random() < 0.5 else text))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "no plays"), (n + 3, "no plays"), (n + 4, rows[0][1]), (n + 5, "x " * 50_000 + rows[1][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "item_id long, moves string, form string")
    forms = {k: near_duplicates._parse_moves(t) if t else None for k, t in rows}
    want = _brute(forms, near_duplicates.same_match)
    assert want and _pairs(near_duplicates.transcript_groups(spark, df)) == want


def test_profiles_rule_out_no_pair_that_is_one_match():
    rng = random.Random(21)
    for _ in range(200):
        a = [[rng.randrange(1 << 40) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 3))]
        b = [[p if rng.random() < 0.85 else rng.randrange(1 << 40) for p in g] for g in rng.sample(a, len(a))]
        c = [[rng.randrange(1 << 40) for _ in g] for g in a]
        allowed = near_duplicates.profiles_allow([near_duplicates.count_profile(a)] * 2, [near_duplicates.count_profile(x) for x in (b, c)], near_duplicates.SAME_PLAYS)
        assert allowed[0] or not near_duplicates.same_match(a, b)
        assert allowed[1] or not near_duplicates.same_match(a, c)
    many = near_duplicates.count_profile([[5] * 1000])
    assert near_duplicates.profiles_allow([many], [near_duplicates.count_profile([[5] * 900])], 0.8)[0]


def test_common_start_is_not_enough():
    rng = random.Random(6)
    a, b = _game(rng, 40), _game(rng, 40)
    games = lambda plays: near_duplicates.games_of(_transcript([plays]))
    assert not near_duplicates.same_match(games(a), games(a[:25] + b[25:]))
    assert near_duplicates.same_match(games(a), games(a[:36]))


def test_writing_of_plays_does_not_matter():
    f = lambda t: near_duplicates.games_of(t)
    assert f("1) 61: bar/19 6/5* 42: 8/7(2)") == f("2. 16: 6/5 25/19   24: 8/7 8/7") == f("61: 25/24/19 6/5\nclock 3\n42: 8/7(2)")
    assert f("61: 6/off") == f("61: 6/0") and f("61: 6/5") != f("61: 6/4")


def test_file_names(spark):
    same = [("2006 Ann-Bob Cup #2 9pnts.mat", "fixed_2006 Bob-Ann Cup #2 9pnts.MAT"), ("2006_Ann-Bob_Grand_Prix_#2.txt", "2006 Ann-Bob GP #2 (1).mat"), ("match_123.txt", "inbox/match_123~.txt"), ("x Trophy 1.mat", "x - Copy Trophy 1.mat"), ("Winter Trophy 1.mat", "Wint. tropyh 1_v2.mat")]
    other = [("2006 Ann Cup #2.mat", "2006 Ann Cup #3.mat"), ("match_123.txt", "match_124.txt"), ("2006 Ann Cup.mat", "2007 Ann Cup.mat"), ("a Group A 1.mat", "a Group B 1.mat"), ("1 Karl Cup.mat", "1 Hugo Cup.mat")]
    form = near_duplicates.name_form
    assert all(near_duplicates.same_name(form(a), form(b)) for a, b in same if "Copy Trophy" not in b)
    assert not any(near_duplicates.same_name(form(a), form(b)) for a, b in other)
    names = [n for pair in same + other for n in pair] + [None, "", "match_123.txt"]
    df = spark.createDataFrame(list(enumerate(names)), "row_id long, file string")
    forms = {k: form(n) if n is not None else None for k, n in enumerate(names)}
    assert _pairs(near_duplicates.file_name_groups(spark, df)) == _brute(forms, near_duplicates.same_name)


def test_names_that_meet_are_compared(spark):
    """Names with the same numbers fill the same buckets; a pair that meets in any of them is found whatever rows lie between."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(4, 8))) for _ in range(20)]
    names = [" ".join(rng.sample(words, 5)) for _ in range(800)]
    for k in range(60):  # one letter replaced
        at = rng.choice([i for i, c in enumerate(names[k]) if c != " "])
        names.append(names[k][:at] + rng.choice("xyzq") + names[k][at + 1 :])
    order = rng.sample(range(len(names)), len(names))
    rows = [(order[k], f"2009 {n} 7.mat") for k, n in enumerate(names)]
    forms = {k: near_duplicates.name_form(n) for k, n in rows}
    keys = {k: set(near_duplicates._name_keys(f)) for k, f in forms.items()}
    met = {(a, b) for a, b in itertools.combinations(sorted(forms), 2) if keys[a] & keys[b] and near_duplicates.same_name(forms[a], forms[b])}
    got = _pairs(near_duplicates.file_name_groups(spark, spark.createDataFrame(rows, "row_id long, file string")))
    assert len(met) >= 50 and met <= got


def test_empty_inputs(spark):
    assert near_duplicates.transcript_groups(spark, spark.createDataFrame([], "item_id long, moves string")).count() == 0
    assert near_duplicates.file_name_groups(spark, spark.createDataFrame([], "row_id long, file string")).count() == 0


# Ranking


CATALOG = "row_id long, id string, p0 string, p1 string, win int, len int"


def test_ranking_recovers_a_known_order(spark):
    rng = random.Random(8)
    skill = {f"n{k:02}": k / 6 for k in range(40)}
    rows = []
    for k in range(6000):
        a, b = rng.sample(sorted(skill), 2) if rng.random() < 0.7 else ("n20", rng.choice([x for x in skill if x != "n20"]))
        win = 0 if rng.random() < 1 / (1 + np.exp(skill[b] - skill[a])) else 1
        rows.append((k, f"m{k}", a, b, win, rng.choice([0, 1, 7])))
    got = spectral.ranking(spark, spark.createDataFrame(rows, CATALOG)).collect()
    order = [r.name for r in sorted(got, key=lambda r: r["rank"])]
    place = {name: k for k, name in enumerate(order)}
    expected = {name: 39 - k for k, name in enumerate(sorted(skill))}
    correlation = np.corrcoef([place[n] for n in skill], [expected[n] for n in skill])[0, 1]
    assert correlation > 0.95
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 41))


def test_ranking_tells_outcomes_it_has_not_seen(spark):
    rng = random.Random(18)
    skill = {f"n{k:02}": k / 12 for k in range(60)}

    def match(k):
        a, b = rng.sample(sorted(skill), 2)
        return (k, f"m{k}", a, b, 0 if rng.random() < 1 / (1 + np.exp(skill[b] - skill[a])) else 1, 5)

    seen, held = [match(k) for k in range(3000)], [match(k) for k in range(2000)]
    strength = {r.name: r.strength for r in spectral.ranking(spark, spark.createDataFrame(seen, CATALOG)).collect()}
    right = lambda by: np.mean([(by[a] > by[b]) == (win == 0) for _, _, a, b, win, _ in held])
    assert right(strength) > right(skill) - 0.03


def test_residual_of_the_plane():
    rng = np.random.default_rng(4)
    m = np.outer(np.arange(30.0), np.ones(30))
    m = m - m.T + (n := rng.normal(size=(30, 30))) - n.T
    v, before, beta = np.ones(30) / 30**0.5, np.zeros(30), []
    for _ in range(12):
        z = m @ v + (beta[-1] * before if beta else 0)
        b = np.linalg.norm(z)
        if spectral.residual(beta, b) < 1e-6:
            break
        beta.append(b)
        before, v = v, z / b
    assert 2 <= len(beta) <= 12
    assert abs(np.linalg.svd(spectral.tridiagonal(beta))[1][0] - np.linalg.svd(m)[1][0]) < 1e-6 * np.linalg.svd(m)[1][0]


def test_ranking_edges(spark):
    rows = [(1, "a", "x", "y", 0, 3), (2, "a", "x", "y", 0, 3), (3, "b", None, "z", 1, 1), (4, "c", "w", "w", 1, 1), (5, "d", "v", "x", -1, 5), (6, None, "y", "u", 0, None)]
    got = {r.name: r for r in spectral.ranking(spark, spark.createDataFrame([(*r, "clash") for r in rows], CATALOG + ", rank string")).collect()}
    assert set(got) == {"x", "y", "z", "w", "v", "u"}
    assert got["x"].strength > got["y"].strength > got["u"].strength and got["x"].matches == 1 and got["z"].strength == 0.0
    assert spectral.ranking(spark, spark.createDataFrame([], CATALOG)).count() == 0
    undecided = spectral.ranking(spark, spark.createDataFrame([(1, "a", "b", "a", -1, 1)], CATALOG)).collect()
    assert [(r.name, r["rank"]) for r in sorted(undecided, key=lambda r: r["rank"])] == [("a", 1), ("b", 2)]


def test_tridiagonal_and_angle():
    t = spectral.tridiagonal([1.0, 2.0])
    assert (t == -t.T).all()
    angle, weight = spectral.best_angle({10: (5.0, 0.0), 30: (2.0, 1.0)})
    assert weight == 7.0 and abs((angle - 2 * np.pi * 20 / spectral.ANGLES + np.pi) % (2 * np.pi) - np.pi) < np.pi / 2


# Encodings


@pytest.mark.parametrize("word", ["Würfel", "später", "Košpëmside", "č", "Отличная", "第局", "café"])
def test_garbled_words_are_reversed(word):
    for form, _, rank in mojibake.garblings(word):
        if rank == 0 and form.startswith(word[:1]) and " " not in form and "cut" not in form and mojibake._encode(form, "cp1252") is not None and word.encode() == mojibake._encode(form, "cp1252"):
            assert word in mojibake.reversed_forms(form)
    assert not mojibake.reversed_forms(word)


RECORD = "row_id long, sides array<struct<name string>>, event string, remarks array<string>"


def test_garbled_values(spark):
    rows = [(k, [("Ann Mößlein",), ("Bob",)], "Örtlicher Cup", ["Die ersten Würfe fehlen später.", "Salão, café à vista"]) for k in range(6)]
    bad = "Würfe"
    rows += [
        (10, [("Ann MÃ¶ÃŸlein",), (None,)], None, None),
        (11, [("Bob",), ("Ann M??lein",)], "Ã–rtlicher Cup", []),
        (12, None, "Örtlicher Cup", ["Die ersten W�rfe fehlen später.", None, "", "why? 100% SÃO", "plain ????"]),
        (13, [("Zoë",), ("x",)], "Ω 5£ ½ – “quoted” §4", [bad.encode().decode("cp437"), bad.encode().decode("mac_roman"), bad.encode().decode("cp1252").encode().decode("cp1252"), bad.encode("cp1252").decode("mac_roman")]),
        (14, [("���",), ("y",)], None, ["W" * 100_000 + " später"]),
    ]
    df = spark.createDataFrame(rows, RECORD).withColumn("value", F.lit("clash"))
    got = {(r.row_id, r.field, r.pos): r.restored for r in mojibake.find(spark, df).collect()}
    assert got == {
        (10, "name", 0): "Ann Mößlein", (11, "name", 1): "Ann Mößlein", (11, "event", 0): "Örtlicher Cup", (12, "remarks", 0): "Die ersten Würfe fehlen später.",
        (13, "remarks", 0): bad, (13, "remarks", 1): bad, (13, "remarks", 2): bad, (13, "remarks", 3): bad, (14, "name", 0): None,
    }
    assert mojibake.find(spark, spark.createDataFrame([], RECORD)).count() == 0


# Names


def test_letters_lost_at_the_edge_of_a_word(spark):
    events = ["Coupe André", "Coupe Andr?", "Was it André?", "Éclair Cup", "?clair Cup", "Who won the Cup?", "Did Ann win?"]
    schema = "row_id long, sides array<struct<name:string>>, event string, remarks array<string>"
    records = spark.createDataFrame([(k, [], e, []) for k, e in enumerate(events)], schema)
    got = {r.row_id: r.restored for r in mojibake.find(spark, records).collect()}
    assert got == {1: "Coupe André", 4: "Éclair Cup"}


def test_player_forms():
    f = name_forms.player_form
    same = [("Ann-Marie Ash", "Ash, Ann-Marie"), ("Alexander Viburse", "Alex  VIBURSE (D)"), ("Pip Warden", "PipWarden"), ("Isabella G. Tottasbak", "Tottasbak, Izzy"), ("fox_kettle00", "kettlefox00,1407"), ("Gabriel_Binnulpul", "Gabe Binulpul"), ("Hen. Rukžotvàk", "Henny Rukžotvk"), ("Zopinfak William", "Will Zopinfakk jr")]
    other = [("Ben Binnulpul", "Gabe Binnulpul"), ("clover_nomad93", "clover_nomad94"), ("Oliver Moszëlnir", "William Moszëlnir"), ("lantern_finch57", "lantern_farmer57")]
    assert all(name_forms.same_entity(f(a), f(b)) for a, b in same[1:])
    assert not any(name_forms.same_entity(f(a), f(b)) for a, b in other)
    for a, b in same[1:]:
        assert set(name_forms.block_keys(f(a))) & set(name_forms.block_keys(f(b))), (a, b)
    assert f("") is None and f(" - ") is None and f("12") is None


def test_event_forms():
    f = name_forms.event_form
    same = [("Košpëmside Grand Prix 2009", "KOSPEMSIDE GP, 2009"), ("Baninfurt Cup 2021", "2021 Baninfurt Backgammon Cp"), ("Rétpikmond Open 2016", "16th Opn of Rétpikmondd 2016"), ("Pipcount Weekly League", "Pipcount weekly lge"), ("Club Championship of Banpasrose 2020", "Banpasrode Club Championship 2020"), ("Košpë. GP '15", "Košpëmside Grand Prix 2015"), ("T. League of Xanadu 2001", "Xanadu Team League 2001")]
    assert all(name_forms.same_entity(f(a), f(b)) for a, b in same)
    for a, b in same:
        assert set(name_forms.block_keys(f(a))) & set(name_forms.block_keys(f(b))), (a, b)
    assert not name_forms.same_entity(f("Baninfurt Cup 2021"), f("Baninfurt Cup 2022")) and not name_forms.same_entity(f("Baninfurt Cup 2021"), f("Baninfurt Open 2021"))
    assert [f(x) for x in ("Online match", "?", "-", "", "  ")] == [None] * 5


def test_names_are_merged_and_matched_again(spark):
    players = ["Margarethe Dantonkun", "Peggy Dantonkun", "Dantonkun M.", "Dorothea Dantonkun", "D. Dantonkun", "Ann Berry", "Alan Berry", "A. Berry", "kettle_fox00", "fox.kettle_00", "Xaver Holmquist", "Xaver Holmqist", "Holmqist, Xaver", None, "", "Ed Tarn", "Tarn E.", "Ed Lund", "Edmund Lund", "E. Lund", "IsabellaŠmid", "Izzy Šmid"]
    events = ["Würzau Cup 2001", "WÃ¼rzau Cup 2001", "Wurzau Cup '01", "Online match", "?"]
    names = spark.createDataFrame([("player", p, 3) for p in players] + [("event", e, 5 if k == 0 else 1) for k, e in enumerate(events)], "kind string, name string, times long")
    by = {}
    for r in resolution.name_groups(spark, names).collect():
        by.setdefault((r.kind, r.profile), set()).add(r.name)
    groups = {frozenset(g) for g in by.values() if len(g) > 1}
    assert groups == {frozenset(g) for g in (players[:3], players[3:5], players[8:10], players[10:13], players[15:17], players[17:20], players[20:22], events[:3])}
    assert resolution.name_groups(spark, names.limit(0)).count() == 0


# History


def test_history_against_brute_force(spark):
    rng = random.Random(11)
    roll = lambda: f"{max(p := (rng.randint(1, 6), rng.randint(1, 6)))}{min(p)}"
    hexa = lambda: f"{rng.getrandbits(256):064x}"
    base = [[roll() for _ in range(rng.randint(30, 70))] for _ in range(30)]
    hashes = []
    for k, b in enumerate(base[:20]):
        h = hexa()
        hashes.append((f"0001/{h[:16]}", h, " ".join(b) if k % 5 else None))
    hashes.sort()  # without times the order is that of ids
    metas = []
    for k in range(60):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = roll()
        h = hexa()
        metas.append([k, 1 + k % 3, f"0002/{h[:16]}", h, " ".join(b)])
    metas[5][2:4] = [" 0009/" + hashes[0][1][:16].upper(), "SHA256:" + hashes[0][1].upper()]
    metas[7][2:5] = ["1/" + hashes[1][1][:18], None, None]
    metas[8][3:5] = [hashes[2][1][:20] + "0" * 44, None]
    metas[9][4] = metas[10][4] = "61 52"
    metas.append([60, 3, None, None, None])
    got = {r.row_id: r.first_id for r in incremental.repeated_matches(spark, spark.createDataFrame([(*h, None) for h in hashes], "id string, content_hash string, rolls string, accepted_at timestamp"), spark.createDataFrame([(*m, 0) for m in metas], "row_id long, batch_no int, id string, content_hash string, rolls string, node long")).collect()}
    items = [(h[0], h[1], h[0].split("/")[1], h[2]) for h in hashes]
    clean = lambda x: None if x is None else "".join(c for c in x.lower().replace("sha256:", "") if c in "0123456789abcdef")
    order = sorted(metas, key=lambda m: (m[1], m[0]))
    items += [(m[2], clean(m[3]), clean(m[2].split("/")[-1]) if m[2] else None, m[4]) for m in order]

    def same(x, y):
        full = (x[1] or x[2], y[1] or y[2])
        if all(full) and (x[1] == y[1] if x[1] and y[1] else full[0].startswith(full[1]) or full[1].startswith(full[0])):
            return True
        if not x[3] or not y[3]:
            return False
        a, b = x[3].split(), y[3].split()
        return sequences.lcs_length(a, b) >= 0.9 * max(len(a), len(b)) - 1e-9

    root = list(range(len(items)))
    for k in range(len(items)):
        for j in range(k):
            if same(items[k], items[j]):
                a, b = root[k], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    # accepted rows are not compared with each other
    want = {order[k - 20][0]: items[root[k]][0] for k in range(20, len(items)) if root[k] != k}
    assert got == want


def test_hashes_that_start_alike_hide_no_repeat(spark):
    """Two matches whose hashes start alike: every later row of either is found, in whatever batch and beside whatever row it comes."""
    a, b, c = ("0123456789abcdef" + x * 48 for x in "abc")
    metas = [(1, 3, "B1", b, None), (2, 5, "A2", a, None), (3, 6, "C1", c, None), (4, 6, "B2", b, None), (5, 9, "B3", b, None), (6, 9, "C2", c, None), (7, 9, "A3", a, None)]
    hashes = spark.createDataFrame([("A1", a, None, None)], "id string, content_hash string, rolls string, accepted_at timestamp")
    rows = spark.createDataFrame(metas, "row_id long, batch_no int, id string, content_hash string, rolls string")
    got = {r.row_id: r.first_id for r in incremental.repeated_matches(spark, hashes, rows).collect()}
    assert got == {2: "A1", 4: "B1", 5: "B1", 6: "C1", 7: "A1"}


def test_weights_tell_matches_from_others():
    apart = incremental.chance(1000, 950, 990)
    weights, least = incremental.fit_weights({("agree", 10): 50, ("differ", 9): 20, ("differ", 0): 400, ("unknown", -1): 5}, apart)
    assert weights["relation"]["agree"] > 0 and weights["tenth"][9] > 0 > weights["tenth"][0]
    assert least <= weights["relation"]["differ"] + weights["tenth"][9]
    assert incremental.fit_weights({}, incremental.chance(0, 0, 0))[0]["relation"]


def _roll(rng):
    return "".join(sorted(rng.choices("123456", k=2), reverse=True))


def test_edited_sequences_share_a_run():
    """Any two sequences that differ by a tenth of the rolls, each replaced or left out, share a key no further apart than that."""
    rng = random.Random(5)
    for _ in range(600):
        a = [_roll(rng) for _ in range(rng.randint(10, 110))]
        edits = set(rng.sample(range(len(a)), len(a) // 10))
        b = [r for k, r in enumerate(a) if k not in edits] if rng.random() < 0.5 else [r if k not in edits else "70" for k, r in enumerate(a)]
        owner, keys, at = incremental.run_keys([" ".join(a), " ".join(b)])
        mine = {(k, p) for o, k, p in zip(owner, keys, at, strict=True) if o == 0}
        theirs = {(k, p) for o, k, p in zip(owner, keys, at, strict=True) if o == 1}
        assert any(k == other and abs(p - q) <= len(edits) for k, p in mine for other, q in theirs), (len(a), sorted(edits))


def test_a_batch_reads_only_what_it_can_meet(spark):
    rng = random.Random(6)
    old = [(f"1/{rng.getrandbits(64):016x}", f"{rng.getrandbits(256):064x}", " ".join(_roll(rng) for _ in range(40)), None) for _ in range(3000)]
    hashes = spark.createDataFrame(old, "id string, content_hash string, rolls string, accepted_at timestamp").cache()
    history = incremental.MatchHistory(spark, keys_per_part=500, row_bits=7)
    history.accept(incremental.prepared(hashes, 0, F.lit(0)), 0)
    rows = [(1, "x", old[5][1], None), (2, "y", None, old[7][2])]
    metas = spark.createDataFrame(rows, "row_id long, id string, content_hash string, rolls string")
    links = history.accept(incremental.prepared(metas, 1, F.col("row_id")), 1)
    assert links.count() == 2
    assert history.parts > 100 and history.read[1]["key_parts"] <= 30 and history.read[1]["row_parts"] <= 2


# Tokens, packing, mixing

DOCUMENTS = "doc_id long, text string, source string, author string"


def _documents(spark, n=150, seed=2):
    rng = random.Random(seed)
    words = ["backgammon", "cube", "die", "the", "club", "point", "zwei", "été"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 300]))), rng.choice(["a", "a", "a", "b"]), None) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None, "a", None), (n + 1, "", "b", None), (n + 2, "word " * 5000, None, None)], DOCUMENTS)


def test_token_sizes_match_the_public_vocabulary(spark):
    codec = tokens.encoding(tokens.VOCABULARY)
    text = "Hello wörld  12345\n\n\tx's 第2局"
    assert codec.decode(codec.encode_ordinary(text)) == text
    got = {r.doc_id: r.tokens for r in tokens.token_sizes(_documents(spark, 5), ["doc_id"]).collect()}
    assert got[6] == 0 and 5 not in got and got[7] == len(codec.encode_ordinary("word " * 5000))


def test_packing_is_whole_and_tight(spark):
    documents = _documents(spark)
    capacities = spark.createDataFrame([("small", 64), ("large", 1100), ("none", None), ("bad", 0)], "container string, capacity_tokens int")
    rows = packing.packed(spark, documents, capacities).collect()
    size = {r.doc_id: r.tokens for r in tokens.token_sizes(documents, ["doc_id"]).collect()}
    for container, capacity in (("small", 64), ("large", 1100)):
        mine = [r for r in rows if r.container == container]
        total, load = {}, {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
            load[r.bin] = load.get(r.bin, 0) + r.tokens
        assert total == size and max(load.values()) <= capacity
        pieces = {}
        for r in mine:
            pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
        assert all(pieces[d] == max(1, -(-n // capacity)) for d, n in size.items())
        assert len(load) <= -(-sum(size.values()) // capacity) * 1.05 + 1
    assert {r.container for r in rows} == {"small", "large"}
    assert packing.packed(spark, documents.limit(0), capacities).count() == 0


def test_evolution_packs_better_than_best_fit():
    better = 0
    for seed in range(3):
        rng = np.random.default_rng(seed)
        for sizes in (rng.integers(200, 600, 500).tolist(), rng.integers(300, 370, 400).tolist()):
            plain = packing.best_fit(sizes, 1000, list(range(len(sizes))), [])
            ended = packing.evolve(sizes, 1000, [], np.random.default_rng(1))[0]
            assert sorted(i for g in ended for i in g) == list(range(len(sizes))) and all(sum(sizes[i] for i in g) <= 1000 for g in ended)
            assert len(ended) <= len(plain)
            better += len(ended) < len(plain)
    assert better == 6


def test_genetic_operators_keep_every_item_once():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 90, 120).tolist()
    ended = packing.evolve(sizes, 100, [], rng)
    for groups in ended:
        assert sorted(i for g in groups for i in g) == list(range(120))
        assert all(sum(sizes[i] for i in g) <= 100 for g in groups)
    assert packing._decode(packing._encode(ended[0], 120)) is not None


def test_fit_hits_budgets_exactly():
    rng = random.Random(5)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 400), 30))
        counts = [rng.randint(1, 50) for _ in lengths]
        budget = rng.randint(2000, sum(n * c for n, c in zip(lengths, counts, strict=True)) - 2000)
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, take, strict=True)) == budget
    assert mixing.fit([10, 20], [1, 1], 25) == [0, 1] and mixing.fit([], [], 9) == [] and mixing.fit([5], [100_000], 400_000) == [80_000]


def test_mixture(spark):
    documents = _documents(spark, 400)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("missing", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(spark, documents, targets)
    rows = mix.collect()
    most = {"a": 1, "b": 3}
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.repeats <= most[r.source] and r.tokens > 0 for r in rows)
    got = {r.source: r for r in mixing.shares(mix, targets).collect()}
    assert abs(got["a"].actual_share - 5 / 9) < 1e-3 and abs(got["b"].actual_share - 4 / 9) < 1e-3 and got["missing"].tokens == 0
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(mixing.mixture(spark, documents, targets).collect())]
    assert mixing.mixture(spark, documents.limit(0), targets).count() == 0 and mixing.mixture(spark, documents, targets.limit(0)).count() == 0


# Spam


def test_stuffed_pages(spark):
    rng = random.Random(9)
    phrases = ["cheap dice cups", "order now", "travel set sale", "gift for players", "win at dice", "fast shipping", "leather board", "bonus chips"]
    prose = "The director asked both players to repeat the roll after a die fell from the table. Nobody noticed that the stake had gone up until later."
    pick = lambda n: [rng.choice(phrases) for _ in range(n)]
    spam_texts = [", ".join(pick(30)) for _ in range(8)] + ["tags: " + ", ".join(p.replace(" ", "-") for p in pick(20)) for _ in range(3)] + ["\n".join(pick(25)), " ".join(w for p in pick(20) for w in rng.sample(p.split(), len(p.split()))), prose + "\n" + ". ".join(" ".join(pick(3)).capitalize() for _ in range(20)) + ".", "\n".join(f"https://x{k}.example/p{k}" for k in range(9)), " | ".join(f"oak Cups {k}.50 EUR | {p}" for k, p in enumerate(pick(9)))]
    clean = [prose * 3, "Ann Ash - Bob Birch 5:3\nCal Cole - Dee Dahl 7:1\nEve Elm - Flo Fox 2:5", "Anchor: a point held in the home board.\nBlot: a single checker.\nPrime: a row of closed points.", prose + " See https://a.example/x and https://b.example/y.", "Q: May I roll again?\nA: " + prose, prose + "\nSources: https://a.example https://b.example https://c.example", "", None, "   "]
    rows = [(k, t, "s", f"w{k % 7}" if k % 3 else None) for k, t in enumerate(spam_texts + clean)]
    df = spark.createDataFrame(rows, DOCUMENTS).withColumn("unit", F.lit(1)).withColumn("words", F.lit("clash"))
    assert {r.doc_id for r in spam.flagged(spark, df).collect()} == set(range(len(spam_texts)))
    assert spam.flagged(spark, df.limit(0)).count() == 0


def test_phrases_are_joined_where_they_are_too_many_to_send(spark, monkeypatch):
    rng = random.Random(10)
    phrases = ["cheap dice cups", "order now", "travel set sale", "gift for players"]
    pages = [(k, ", ".join(rng.choice(phrases) for _ in range(12)) + ".\nOne sentence of a report, written once.", "s", f"w{k}") for k in range(8)]
    df = spark.createDataFrame([*pages, pages[3], (90, "see above", "s", "a"), (91, "see above", "s", "b"), (92, "see above", "s", "c"), (93, "", "s", None)], DOCUMENTS)
    sent = {tuple(r) for r in spam.judged(spark, df).collect()}
    monkeypatch.setattr(spam, "SENT", 0)
    assert {tuple(r) for r in spam.judged(spark, df).collect()} == sent
    assert {r.doc_id for r in spam.flagged(spark, df).collect()} == set(range(8))  # a text posted by three is one text
