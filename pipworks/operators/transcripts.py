"""Match files in bulk: one file per row in, one summary, its diagnostics or its actions per row out.

Files are read whole (they are a few KB) and each is handled by the kernels inside Arrow batches; nothing is shuffled
until results are grouped. A file that can't be read gives a row with an error, never an exception.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.functions.pseudonyms import hide_names
from pipworks.kernels import analysis, sgf, xg
from pipworks.kernels.analysis import EquityTable
from pipworks.kernels.file_names import propose
from pipworks.kernels.identity import content_hash, roll_tokens
from pipworks.kernels.ids import Context, to_gnubg_id, to_xgid
from pipworks.kernels.match_text import FormatError, decode, kind_of, parse, steps_text, write
from pipworks.kernels.sequences import shared_rolls
from pipworks.kernels.validate import diagnostic, salvage, validate

#: Bounds of an archive (fixed values): entries, bytes of an entry, bytes of all.
ARCHIVE_LIMITS = (500, 10_000_000, 50_000_000)

_DIAGNOSTICS = "array<struct<severity:string,code:string,message:string,game:int,action:int>>"
SUMMARY = f"path string, format string, dialect string, p0 string, p1 string, match_length int, date string, event string, round string, games int, s0 int, s1 int, winner int, status string, content_hash string, diagnostics {_DIAGNOSTICS}"
ACTIONS = "path string, game int, at int, side int, kind string, dice string, cube int, xgid string, gnubg_id string"


def parsed(data: bytes, kind: str, text: str) -> dict:
    """The match of a file as it is written, not validated."""
    return xg.parse(data) if kind == "xg" else sgf.parse(text) if kind == "sgf" else parse(text)


def read_bytes(data: bytes, salvaged: bool = False) -> tuple[dict | None, str, list[dict]]:
    """Match, format and diagnostics of one file."""
    kind = kind_of(data)
    text, encoding = ("", "utf-8") if kind == "xg" else decode(data)
    try:
        match, found = (salvage if salvaged else validate)(parsed(data, kind, text))
    except (FormatError, ValueError, KeyError, IndexError) as e:
        return None, kind, [diagnostic("error", "V-FORMAT", str(e)[:200])]
    if not encoding.startswith("utf"):
        found.append(diagnostic("info", "V-FORMAT", f"read as {encoding}"))
    return match, kind, found


def _summary(path: str, data: bytes, salvaged: bool) -> tuple:
    match, kind, found = read_bytes(data, salvaged)
    bad = any(d["severity"] == "error" for d in found)
    if match is None:
        return (path, kind, *[None] * 11, "error", None, found)
    status = "error" if bad else "partial" if any(d["code"] == "V-PARTIAL" for d in found) else "good"
    result = match["result"]
    return (path, kind, match["dialect"], *(s["name"] for s in match["sides"]), match["match_length"], match["date"], match["event"], match["round"], len(match["games"]), *result["score"], result["winner"], status, None if bad else content_hash(match), found)


def _run(files: DataFrame, schema: str, rows) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for path, content in zip(b["path"], b["content"], strict=True) for r in rows(path, content.encode() if isinstance(content, str) else bytes(content))]
            yield pd.DataFrame(out, columns=columns)

    chosen = files.filter("content is not null").select("path", "content")
    cores = files.sparkSession.sparkContext.defaultParallelism
    if chosen.rdd.getNumPartitions() < cores:  # replaying costs far more than moving a few files
        chosen = chosen.repartition(cores)
    return chosen.mapInPandas(run, schema)


def summaries(files: DataFrame, salvaged: bool = False) -> DataFrame:
    """One row per file (path, content as text or binary): what it is, its result, its status and its identity."""
    return _run(files, SUMMARY, lambda path, data: [_summary(path, data, salvaged)])


def diagnostics(found: DataFrame) -> DataFrame:
    return found.select("path", F.explode("diagnostics").alias("d")).select("path", "d.*")


def actions(files: DataFrame) -> DataFrame:
    """Every action of every readable file, with the identifiers of the position it was taken in."""

    def rows(path: str, data: bytes) -> list[tuple]:
        match, _, _ = read_bytes(data)
        out = []
        for g, game in enumerate(match["games"] if match else [], 1):
            from pipworks.kernels.rules import START

            position, cube, owner, score = START, 1, None, tuple(game["start"])
            for k, a in enumerate(game["actions"], 1):
                dice = tuple(a["dice"]) if a["kind"] == "move" and not a.get("hidden") else None
                here = Context(a["side"], cube, owner, dice, score, match["match_length"], game.get("crawford", False))
                ids = (to_xgid(position, here), to_gnubg_id(position, here)) if a["kind"] in ("move", "double") else (None, None)
                out.append((path, g, k, a["side"], a["kind"], "".join(map(str, dice)) if dice else None, a.get("cube"), *ids))
                if a["kind"] == "move":
                    position = a.get("position", position)
                elif a["kind"] == "take":
                    cube, owner = 2 * cube, a["side"]
        return out

    return _run(files, ACTIONS, rows)


def scan(files: DataFrame) -> DataFrame:
    """(path, p0, p1, match_length, date, event, games, starts, points, rolls): files parsed without replaying them.

    Points are those stated at the end of a game, 0 where none are; rolls are those of all plays, in order. A file that can't be parsed gives no row.
    """
    schema = "path string, p0 string, p1 string, match_length int, date string, event string, games int, starts array<string>, points array<int>, rolls string"

    def rows(path: str, data: bytes) -> list[tuple]:
        kind = kind_of(data)
        try:
            m = parsed(data, kind, "" if kind == "xg" else decode(data)[0])
        except (FormatError, ValueError, KeyError, IndexError):
            return []
        games = m["games"]
        rolls = " ".join(f"{a['dice'][0]}{a['dice'][1]}" for g in games for a in g["actions"] if a["kind"] == "move")
        stated = [(g["declared"] or {"points": 0})["points"] for g in games]
        return [(path, *(s["name"] for s in m["sides"]), m["match_length"], m["date"], m["event"], len(games), ["-".join(map(str, g["start"])) for g in games], stated, rolls)]

    return _run(files, schema, rows)


def as_json(match: dict) -> str:
    """A match as JSON: people, length, rules, date, event, and every game with its start score, actions in order, and what the file says of its result."""

    def action(a: dict) -> dict:
        out = {"side": a["side"], "kind": a["kind"]}
        if a["kind"] == "move":
            out |= {"dice": a["dice"], "moves": None if a.get("hidden") else steps_text(a.get("played") or a["steps"])}
        return out | ({"cube": a["cube"]} if a["kind"] == "double" else {})

    def result(g: dict) -> dict | None:
        found = g.get("result") or g["declared"]
        return found and {k: found[k] for k in ("winner", "points", "kind", "how", "cube") if k in found}

    games = [{"index": g["index"], "startScore": g["start"], "actions": [action(a) for a in g["actions"]], "result": result(g)} for g in match["games"]]
    head = {"sides": match["sides"], "matchLength": match["match_length"], "rules": match["rules"], **{k: match[k] for k in ("date", "time", "event", "round")}}
    return json.dumps(head | {"games": games, "remarks": match["remarks"]}, ensure_ascii=False)


def json_texts(files: DataFrame) -> DataFrame:
    """(path, json) of every file that can be parsed, not validated."""

    def rows(path: str, data: bytes) -> list[tuple]:
        kind = kind_of(data)
        try:
            return [(path, as_json(parsed(data, kind, "" if kind == "xg" else decode(data)[0])))]
        except (FormatError, ValueError, KeyError, IndexError):
            return []

    return _run(files, "path string, json string", rows)


def hidden_texts(files: DataFrame, key: bytes, domain: str) -> DataFrame:
    """(path, text): every file that can be parsed, in the normal layout, with pseudonyms in place of names and without what points to the people or the place: event, round, site, time, ratings and remarks. Plays and date stay.

    Pseudonyms are made once per distinct name and joined back; a path given twice must be one file.
    """
    names = hide_names(scan(files).select("path", "p0", "p1"), key, ["p0", "p1"], [], domain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content, *new in zip(b["path"], b["content"], b["p0"], b["p1"], strict=True):
                data = content.encode() if isinstance(content, str) else bytes(content)
                kind = kind_of(data)
                match = parsed(data, kind, "" if kind == "xg" else decode(data)[0])
                match |= {"sides": [{"name": n, "rating": None} for n in new], "event": None, "round": None, "site": None, "time": None, "remarks": []}
                out.append((path, write(match)))
            yield pd.DataFrame(out, columns=["path", "text"])

    return files.select("path", "content").join(names, "path").mapInPandas(run, "path string, text string")


def written(files: DataFrame) -> DataFrame:
    """(path, text) of every file that can be parsed, in the normal layout, whether its plays are legal or not."""

    def rows(path: str, data: bytes) -> list[tuple]:
        kind = kind_of(data)
        try:
            return [(path, write(parsed(data, kind, "" if kind == "xg" else decode(data)[0])))]
        except (FormatError, ValueError, KeyError, IndexError):
            return []

    return _run(files, "path string, text string", rows)


def tokens(files: DataFrame) -> DataFrame:
    """(path, tokens): what was rolled and doubled in every game, for comparing transcripts."""
    return _run(files, "path string, tokens array<array<string>>", lambda path, data: [(path, roll_tokens(m))] if (m := read_bytes(data)[0]) else [])


def decisions(files: DataFrame, table: EquityTable | None = None) -> DataFrame:
    """(path, game, side, kind, error, plies, counted) of every analysed decision in SGF and binary files."""

    def rows(path: str, data: bytes) -> list[tuple]:
        kind = kind_of(data)
        if kind == "mat":
            return []
        try:
            found = analysis.binary_errors(data) if kind == "xg" else analysis.errors(analysis.judgements(decode(data)[0]), table)
            return [(path, *d.values()) for d in found.to_dict("records")]
        except (FormatError, ValueError, IndexError, KeyError):
            return []

    return _run(files, "path string, game int, side int, kind string, error double, plies int, counted boolean", rows)


def normal_texts(files: DataFrame) -> DataFrame:
    """(path, text) of every file without errors, in the normal layout."""

    def rows(path: str, data: bytes) -> list[tuple]:
        match, _, found = read_bytes(data)
        return [(path, write(match))] if match and not any(d["severity"] == "error" for d in found) else []

    return _run(files, "path string, text string", rows)


def proposals(items: DataFrame) -> DataFrame:
    """(item_id, event, round, date, time, number, of, stage) that the names of files (item_id, file, players) propose."""
    columns = ["event", "round", "date", "time", "number", "of", "stage"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [propose(name.rsplit(".", 1)[0], list(players) if players is not None else None) for name, players in zip(b["file"], b["players"], strict=True)]
            yield pd.DataFrame([(i, *(getattr(p, c) for c in columns)) for i, p in zip(b["item_id"], found, strict=True)], columns=["item_id", *columns]).astype({"number": "Int64", "of": "Int64"})

    return items.filter("file is not null").select("item_id", "file", "players").mapInPandas(run, "item_id long, event string, round string, date string, time string, number int, of int, stage string")


def roll_shares(pairs: DataFrame) -> DataFrame:
    """Adds `share`, the part of the rolls of the longer sequence that `rolls_a` and `rolls_b` have in common, in order; null where one is missing."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        split = [(x.split(), y.split()) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)]
        return pd.Series([shared_rolls([p[0]], [p[1]])[0] if p else None for p in split], dtype="float64")

    return pairs.withColumn("share", share("rolls_a", "rolls_b"))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder, archives unpacked on the way: path, content, problem. An archive beyond ARCHIVE_LIMITS, or a damaged one, is one row with a problem."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most, each, whole = ARCHIVE_LIMITS
        for b in batches:
            rows = []
            for name, data in zip(b["path"], b["content"], strict=True):
                if not name.lower().endswith(".zip"):
                    rows.append((name, bytes(data), None))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        entries = [i for i in z.infolist() if not i.is_dir()]
                        if len(entries) > most or any(i.file_size > each for i in entries) or sum(i.file_size for i in entries) > whole:
                            raise ValueError("the archive is too large")
                        if len({i.filename.rsplit("/", 1)[-1] for i in entries}) < len(entries):
                            raise ValueError("a name occurs twice")
                        rows += [(f"{name}/{i.filename.rsplit('/', 1)[-1]}", z.read(i), None) for i in entries]
                except (zipfile.BadZipFile, ValueError, RuntimeError, NotImplementedError, zipfile.zlib.error) as e:
                    rows.append((name, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "content", "problem"])

    return raw.mapInPandas(unpack, "path string, content binary, problem string")
