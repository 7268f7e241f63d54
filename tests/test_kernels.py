import random

import pytest

from pipworks.kernels import sgf
from pipworks.kernels.identity import content_hash, roll_tokens
from pipworks.kernels.ids import Context, parse_gnubg_id, parse_xgid, to_gnubg_id, to_position_id, to_xgid
from pipworks.kernels.match_text import FormatError, decode, kind_of, parse, parse_steps, steps_text, write
from pipworks.kernels.rules import BAR, OFF, START, apply_written, fault, hits_between, is_unfinished, legal_plays, moved, pips, win_size
from pipworks.kernels.validate import read

MATCH = """; [Site "A Place"]
; [Event "Örtlicher Cup"]
; [EventDate "2020.05.06"]
; [Crawford "On"]

3 point match

 Game 1
 Ann Ash : 0                           Bob Birch : 0
  1) 31: 8/5 6/5                        Doubles => 2
  2)  Takes                             52: 13/8 24/22
  3)  Doubles => 4                       Takes
  4) 61: 13/7 8/7
"""


def _match(*rows: str, start="Ann Ash : 0                           Bob Birch : 0") -> str:
    return "3 point match\n\n Game 1\n " + start + "\n" + "\n".join(rows) + "\n"


def test_start_position():
    assert pips(START[0]) == pips(START[1]) == 167
    assert fault(START) is None
    assert len(legal_plays(START, 0, (6, 5))[0]) == 7
    assert len(legal_plays(START, 0, (3, 1))[0]) == 16


def test_every_random_play_keeps_the_position_possible():
    rng = random.Random(5)
    for _ in range(30):
        position, side = START, 0
        for _ in range(60):
            plays, _ = legal_plays(position, side, (rng.randint(1, 6), rng.randint(1, 6)))
            after = rng.choice(sorted(plays))
            assert fault(after) is None
            assert hits_between(position, after, side) is not None
            position, side = after, 1 - side
            if max(position[0][OFF], position[1][OFF]) == 15:
                break


def _side(**points) -> tuple:
    counts = [0] * 26
    for p, n in points.items():
        counts[int(p[1:])] = n
    counts[0] = 15 - sum(counts[1:])
    return tuple(counts)


def test_larger_die_when_only_one_can_be_played():
    position = (_side(p10=1), _side(p17=2, p22=2))  # 10 goes by 6 or by 5, then neither other die
    plays, used = legal_plays((_side(p13=1), _side(p14=2, p19=2)), 0, (6, 5))
    assert used == 2 or all(p[0][7] for p in plays)
    assert legal_plays(position, 0, (6, 5))[1] >= 1


def test_bearing_off_from_the_highest_point_only():
    position = (_side(p4=1, p2=1), _side(p24=2))
    after, used = legal_plays(position, 0, (6, 5))
    assert used == 2 and {p[0][OFF] for p in after} == {15}
    assert moved(position, 0, 2, OFF)[0][OFF] == 14


def test_bar_first_and_hits():
    position = (_side(p25=1, p6=14), _side(p5=1, p6=14))
    done = apply_written(position, 0, [(6, 1), (BAR, 20)])
    assert done is not None
    assert (25, 20, True) in done[1]
    assert done[0][1][BAR] == 1


def test_unfinished_play():
    assert is_unfinished(START, 0, (3, 1), [(8, 5)])
    assert not is_unfinished(START, 0, (3, 1), [(8, 5), (6, 5)])
    assert not is_unfinished(START, 0, (3, 1), [(8, 4)])


def test_win_size():
    done = _side()
    assert win_size((done, _side(p1=1)), 0) == 1
    assert win_size((done, (0, 15, *[0] * 24)), 0) == 2
    assert win_size((done, (0, *[0] * 23, 15, 0)), 0) == 3


@pytest.mark.parametrize(("text", "steps"), [("24/18/15 13/10*(2) bar/20 6/off", [(24, 18), (18, 15), (13, 10), (13, 10), (25, 20), (6, 0)]), ("0/0", []), ("", [])])
def test_parse_steps(text, steps):
    assert parse_steps(text) == steps


@pytest.mark.parametrize("text", ["10/12", "x", "30/2", "5"])
def test_bad_steps(text):
    with pytest.raises(FormatError):
        parse_steps(text)


def test_steps_text_groups_equal_steps():
    assert steps_text([(13, 10), (25, 20), (13, 10), (6, 0), (8, 3, True)]) == "13/10(2) bar/20 6/off 8/3*"


def test_read_and_write_is_a_fixed_point():
    match, found = read(MATCH)
    assert [d["severity"] for d in found] == ["warning"]
    text = write(match)
    again, _ = read(text)
    assert write(again) == text
    assert content_hash(again) == content_hash(match)
    assert match["event"] == "Örtlicher Cup" and match["date"] == "2020-05-06"


def test_identity_does_not_depend_on_names_notation_or_order():
    one = read(_match("  1) 31: 8/5 6/5                        64: 24/14"))[0]
    two = read(_match("  1) 13: 6/5 8/5                        46: 24/18/14", start="X : 0                                 Y : 0"))[0]
    swapped = read(_match("  1)                                    31: 8/5 6/5", "  2) 64: 24/14"))[0]
    other = read(_match("  1) 31: 8/5 6/5                        64: 24/18 13/9"))[0]
    assert content_hash(one) == content_hash(two) == content_hash(swapped) != content_hash(other)


def _codes(*rows):
    return {d["code"] for d in read(_match(*rows))[1] if d["severity"] == "error"}


def test_diagnostics():
    assert _codes("  1) 31: 8/4 6/5") == {"V-LEGAL"}
    assert _codes("  1) 31: 8/5 6/5", "  2) 31: 6/5 6/3") == {"V-TURN", "V-LEGAL"} or "V-TURN" in _codes("  1) 31: 8/5 6/5", "  2) 31: 13/10 6/5")
    assert _codes("  1) 31: 8/5 6/5                        Takes") == {"V-CUBE"}
    assert _codes("  1) 31: 8/5 6/5                        Doubles => 4") == {"V-CUBE"}
    assert _codes("  1) nonsense") == {"V-FORMAT"}
    assert _codes("  1) 31: 8/5 6/5                        Doubles => 2", "  2)  Drops", "                                        Wins 1 point") == set()
    assert _codes("  1) 31: 8/5 6/5                        Doubles => 2", "  2)  Drops", "                                        Wins 3 points") == {"V-SCORE"}


def test_hidden_last_play_is_a_resignation():
    match, found = read(_match("  1) 31: 8/5 6/5                        64: ????", "      Wins 2 points"))
    assert not [d for d in found if d["severity"] == "error"]
    assert match["games"][0]["result"] == {"winner": 0, "points": 2, "kind": "gammon", "how": "resign", "cube": 1, "ends_match": False}


def test_crawford_game_once():
    text = "3 point match\n\n" + "\n".join(f" Game {k}\n A : {a}          B : {b}\n  1) 31: 8/5 6/5       64: ????\n      Wins {p} point\n" for k, a, b, p in ((1, 0, 0, 2), (2, 2, 0, 1)))
    match, _ = read(text)
    assert [g["crawford"] for g in match["games"]] == [False, True]


def test_unreadable_inputs_are_errors_not_exceptions():
    for text in ("", "abc", "Game 1", "5 point match", "5 point match\n Game 1\n no score"):
        match, found = read(text)
        assert match is None and found[0]["code"] == "V-FORMAT"


def test_encodings_and_kinds():
    assert decode("é".encode("cp1252")) == ("é", "cp1252")
    assert decode("é".encode()) == ("é", "utf-8")
    assert decode(b"\xff\xfe" + "é".encode("utf-16-le")) == ("é", "utf-16-le")
    assert (kind_of(b" (;GM[6])"), kind_of(b"RGMH1"), kind_of(b"5 point match")) == ("sgf", "xg", "mat")


def test_sgf_is_the_same_match():
    text = "(;GM[6]PB[Ann]PW[Bob]MI[length:3][game:0][ws:0][bs:0]RE[W+1R];B[31qtst];W[64xrrn])"
    match = sgf.parse(text)
    from pipworks.kernels.validate import validate

    done, found = validate(match)
    assert [s["name"] for s in done["sides"]] == ["Ann", "Bob"]
    assert done["games"][0]["declared"]["winner"] == 1
    assert roll_tokens(done) == [["m0:31", "m1:64"]]
    assert sgf.trees("(;A[x\\]y][z];B[1])(;C[2])") == [[{"A": ["x]y", "z"]}, {"B": ["1"]}], [{"C": ["2"]}]]
    with pytest.raises(FormatError):
        sgf.parse("(;GM[1])")


def test_identifiers_round_trip():
    assert to_position_id(START, 0) == "4HPwATDgc/ABMA"
    rng = random.Random(3)
    position, side = START, 0
    for _ in range(40):
        plays, _ = legal_plays(position, side, (rng.randint(1, 6), rng.randint(1, 6)))
        position, side = rng.choice(sorted(plays)), 1 - side
        context = Context(side, 4, 1 - side, (6, 2), (3, 5), 11, False)
        assert parse_gnubg_id(to_gnubg_id(position, context)) == (position, Context(side, 4, 1 - side, (6, 2), (3, 5), 11))
        again, got = parse_xgid(to_xgid(position, context))
        assert again == (position if side == 0 else position[::-1])
        assert (got.cube, got.dice, got.length) == (4, (6, 2), 11)
    with pytest.raises(ValueError):
        parse_xgid("XGID=x")


def test_parse_keeps_side_by_column():
    match = parse(_match("  1)                                    31: 8/5 6/5"))
    assert match["games"][0]["actions"][0]["side"] == 1


def test_declared_illegal_play_is_kept():
    rows = ["  1) 31: 8/4 6/5                        64: 24/14"]
    text = '; [IllegalPlay "Game 1, Move 1 of Ann Ash"]\n' + _match(*rows)
    match, found = read(text)
    assert {d["code"] for d in found} == {"V-ILLEGAL", "V-RESULT"} and match["games"][0]["actions"][0]["illegal"]
    again, _ = read(write(match))
    assert content_hash(again) == content_hash(match)
    assert "V-LEGAL" in {d["code"] for d in read(_match(*rows))[1]}
    unused = read('; [IllegalPlay "Game 1, Move 9"]\n' + _match("  1) 31: 8/5 6/5"))[1]
    assert "V-ILLEGAL" in {d["code"] for d in unused}


def test_dump_of_an_illegal_play():
    from pipworks.kernels.match_text import dumped_position, parse_dump

    board = [0, -2, 0, 0, 0, 5, 1, 0, 3, 0, 0, 0, -5, 4, 0, 0, 0, -3, 0, -5, 0, 0, 0, 0, 2, 0]
    values = ["3", "0", "1", "0", "0", "Ann Ash", "Bob Birch", "0", "0", "0", "1", "0", *map(str, board), "6", "4"]
    dump = parse_dump(";".join(values) + ";")
    position = dumped_position(dump, 0)
    assert fault(position) is None and dumped_position(dump, 1) == position[::-1]
    assert parse_dump("1;2") is None
    match, found = read(_match(f"  1) 31: Illegal play ({';'.join(values)};)   64: 24/14"))
    assert match is not None and any(d["code"] in ("V-DAMAGED", "V-ILLEGAL") for d in found)


def test_salvage():
    good = " Game 1\n Ann : 0                               Bob : 0\n  1) 31: 8/5 6/5                        Doubles => 2\n  2)  Drops\n                                        Wins 1 point\n\n"
    bad = " Game 2\n Ann : 0                               Bob : 1\n  1) 31: 20/17 6/5\n                                        Wins 2 points and the match\n"
    match, found = read("3 point match\n\n" + good + bad)
    assert any(d["severity"] == "error" for d in found)
    match, found = read("3 point match\n\n" + good + bad, salvaged=True)
    assert not any(d["severity"] == "error" for d in found) and match["result"] == {"score": [0, 3], "winner": 1, "finished": True}
    assert match["games"][1]["actions"] == [] and len(content_hash(match)) == 64
    cut = " Game 2\n Ann : 0                               Bob : 1\n  1) 31: 8/5 6/5\n"
    match, found = read("3 point match\n\n" + good + cut, salvaged=True)
    assert len(match["games"]) == 1 and any(d["code"] == "V-PARTIAL" for d in found)


def test_decisions_of_an_analysed_game():
    from pipworks.kernels.analysis import EquityTable, decisions

    play = lambda eq: f"aabb E ver 3 0.5 0.1 0.0 0.1 0.0 {eq} 2C 0 1 0.0 1"
    cube = "E ver 3 2C 0 1 0.0 " + " ".join(["0"] * 6 + ["0.4"] + ["0"] * 6 + ["0.7"])
    text = f"(;GM[6]MI[length:0];B[31qtst]A[1][{play(0.2)}][{play(0.05)}];W[double]DA[{cube}];B[take];W[64xrrn]A[0][{play(0.1)}])"
    got = decisions(text)
    assert [(d["side"], d["kind"], round(d["error"], 3), d["plies"], d["counted"]) for d in got] == [(0, "move", 0.15, 3, True), (1, "double", 0.0, 3, True), (0, "take", 0.0, 3, True), (1, "move", 0.0, 3, False)]
    even = EquityTable([[0.5, 0.7], [0.3, 0.5]], [0.5, 0.5])
    assert even.chance(0, 2, False) == 1 and even.chance(1, 0, True) == 0 and even.chance(2, 1, False) == 0.3 and even.chance(2, 1, True) == 0.5
    assert abs(even.normalised(0.5, 2, 2, 1)) < 1e-9
    assert decisions(text.replace("length:0", "length:2")) and len(decisions(text.replace("length:0", "length:2"))) == 2


# Binary files


def _record(kind, **fields):
    import struct

    rec = bytearray(2560)
    rec[8] = kind
    for at, (code, *values) in ((int(k[1:]), v) for k, v in fields.items()):
        struct.pack_into(code, rec, at, *values)
    return bytes(rec)


def _binary(*records):
    import zlib

    return b"RGMH" + b"\0" * 40 + zlib.compress(b"x" * 100) + b"\x78\x9cbroken" + zlib.compress(b"".join(records))


def test_binary_match():
    from pipworks.kernels import xg

    name = lambda s: ("41p", s.encode("cp1252"))
    head = _record(0, _9=name("Ann"), _50=name("Jos\u00e9"), _92=("<i", 3), _100=("3B", 1, 0, 0), _128=("<d", 43831.5), _283=name("Harbor"))
    play = _record(3, _64=("<i", 1), _68=("<8i", 7, 4, 5, 4, -1, -1, -1, -1), _100=("<2i", 3, 1))
    double, end = _record(2, _12=("<i", -1), _16=("<2i", 1, 0), _200=("<f", 0.4)), _record(4, _24=("<3i", -1, 1, 0))
    data = _binary(head, _record(1, _12=("<2i", 0, 0), _48=("<i", 1)), play, double, end, _record(5))
    m = xg.parse(data)
    assert [s["name"] for s in m["sides"]] == ["Ann", "Jos\u00e9"] and (m["match_length"], m["date"], m["time"], m["site"], m["analysed"]) == (3, "2020-01-01", "12:00", "Harbor", True)
    assert [(a["kind"], a["side"]) for a in m["games"][0]["actions"]] == [("move", 0), ("double", 1), ("drop", 0)]
    assert m["games"][0]["actions"][0]["steps"] == [(8, 5), (6, 5)]
    from pipworks.operators.transcripts import read_bytes

    match, kind, found = read_bytes(data)
    assert kind == "xg" and match["result"]["score"] == [0, 1] and not [d for d in found if d["severity"] == "error"]
    for bad in (b"RGMH", _binary(head, play, end), _binary(head, _record(1), play), _binary(_record(0), _record(1), end)):
        assert read_bytes(bad)[0] is None
        assert read_bytes(bad)[2][0]["code"] == "V-FORMAT"


def _plain_game(rows, wins, length=5, start=(0, 0)):
    return f"{length} point match\n\n Game 1\n Ann : {start[0]}                               Bob : {start[1]}\n" + "\n".join(rows) + f"\n{wins}\n"


def test_played_points_stay_where_a_site_caps_them():
    from pipworks.operators.transcripts import read_bytes

    rows = ["  1) 31: 8/5 6/5                         Doubles => 2", "  2) Takes                               64: 24/14", "  3)  Doubles => 4                       Drops"]
    match, _, found = read_bytes(_plain_game(rows, "      Wins 1 point and the match", start=(4, 0)).encode())
    assert match["result"]["score"] == [6, 0] and ("info", "V-SCORE") in {(d["severity"], d["code"]) for d in found}
    match, _, found = read_bytes(_plain_game(rows, "      Wins 1 point", start=(0, 0)).encode())
    assert match["result"]["score"] == [2, 0] and ("error", "V-SCORE") in {(d["severity"], d["code"]) for d in found}
    resigned = ["  1) 31: 8/5 6/5"]
    match, _, found = read_bytes(_plain_game(resigned, "      Wins 2008 points", length=2).encode())
    assert match["result"]["score"] == [2, 0]
    match, _, found = read_bytes(_plain_game(resigned, "      Wins 4 points", length=9).encode())
    assert match["result"]["score"] == [3, 0] and ("warning", "V-SCORE") in {(d["severity"], d["code"]) for d in found}


def test_decisions_of_a_binary_match():
    from pipworks.kernels.analysis import binary_errors

    name = lambda s: ("41p", s.encode())
    head = _record(0, _9=name("Ann"), _50=name("Bob"), _92=("<i", 3))
    play = lambda error, dice, cells: _record(3, _9=("26b", *cells), _64=("<i", 1), _68=("<8i", 7, 4, 5, 4, -1, -1, -1, -1), _100=("<2i", *dice), _2312=("<d", error), _2472=("<i", 1002))
    start = [0, -2, 0, 0, 0, 0, 5, 0, 3, 0, 0, 0, -5, 5, 0, 0, 0, -3, 0, -5, 0, 0, 0, 0, 2, 0]
    closed = [0, 15, *[0] * 23, 0]
    cubes = [_record(2, _12=("<i", 1), _16=("<2i", 0, 0), _92=("<i", 2), _152=("<3f", 0.3, 0.2, 1.0), _200=("<d", 0.0), _216=("<d", -1000)), _record(2, _12=("<i", -1), _16=("<2i", 1, 0), _92=("<i", 2), _152=("<3f", 0.9, 1.1, 1.0), _200=("<d", -0.02), _216=("<d", 0.1)), _record(2, _16=("<i", -2))]
    got = binary_errors(_binary(head, _record(1), cubes[0], play(-0.05, (3, 1), start), play(-1000, (3, 1), start), play(0.0, (3, 1), closed), cubes[2], cubes[1], _record(4)))
    assert [tuple(r) for r in got[["game", "side", "kind", "plies", "counted"]].to_numpy().tolist()] == [(1, 0, "no-double", 3, True), (1, 0, "move", 7, True), (1, 0, "move", 7, False), (1, 1, "double", 3, True), (1, 0, "pass", 3, True)]
    assert got["error"].round(3).tolist() == [0.0, 0.05, 0.0, 0.02, 0.1]
    assert binary_errors(_binary(head, _record(1), _record(4))).empty


def test_a_hidden_last_play_that_bears_off_all_checkers():
    from pipworks.kernels import rules
    from pipworks.kernels.validate import _Game

    def ended(dice, winner):
        left = [0] * 26
        left[3], left[1], left[rules.OFF] = 1, 1, 13
        other = [0] * 26
        other[2], other[rules.OFF] = 2, 13
        play = {"side": 0, "kind": "move", "dice": dice, "steps": [], "hidden": True, "line": 3}
        game = {"actions": [play], "declared": {"winner": winner, "points": 1, "ends_match": False, "line": 4}, "start": [0, 0]}
        state = _Game({"match_length": 5, "rules": {}, "sides": [{"name": "a"}, {"name": "b"}]}, game, 0, False, [])
        state.position = (tuple(left), tuple(other))
        state.run()
        return state.result([0, 0], None), play

    result, play = ended([4, 4], 0)
    assert (result["winner"], result["points"], result["how"]) == (0, 1, "bearOff") and play["reconstructed"] and sorted(play["steps"]) == [(1, 0), (3, 0)]
    assert ended([2, 1], 0)[0]["how"] == "resign" and ended([4, 4], 1)[0] == {"winner": 1, "points": 1, "kind": "single", "how": "resign", "cube": 1}
