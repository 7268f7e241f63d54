"""Groups of records that are the same but for small edits: transcripts of matches, and file names.

Equal records (after normalisation) are put together by a hash first, so copies cost one shuffle of (hash, id) rows.
The distinct ones are sketched and meet in the tables of `covering`. A few links per bucket are checked exactly first;
then every pair of a bucket that these have not put into one group is checked too, and groups are the connected
components of the links that hold.

Defined cases: null texts belong to no group; a transcript without plays, however long, belongs to no group; equal rows
form a group; ids are compared as numbers; further columns of the input are not looked at; empty tables give no groups.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.llm.covering import table_keys, table_links, table_pairs
from pipworks.llm.sequences import common, edit_distance_at_most, lcs_length
from pipworks.operators.components import components
from pipworks.storage import Scratch

#: Share of the longer transcript's plays that must be in the other.
SAME_PLAYS = 0.8
#: Transcripts with fewer plays are short.
SHORT_PLAYS = 24

_ROLL = re.compile(r"(?<![\d/])([1-6])\s*([1-6])\s*:")
_STEP = re.compile(r"(bar|off|\d+)((?:/(?:bar|off|\d+)\*?)+)(?:\((\d+)\))?", re.IGNORECASE)
_GAME = re.compile(r"^\s*game\s+\d+", re.IGNORECASE)


def _point(word: str) -> int:
    word = word.lower().rstrip("*")
    return 25 if word == "bar" else 0 if word == "off" else int(word)


@lru_cache(maxsize=1 << 17)
def play_token(dice: tuple[str, str], body: str) -> int:
    """A play as a number that does not depend on the order of dice and steps, on hit marks, or on how steps, bar and off are written."""
    net: Counter = Counter()
    for first, rest, times in _STEP.findall(body):
        n = int(times or 1)
        net[_point(first)] += n
        net[_point(rest.rsplit("/", 1)[1])] -= n
    moved = ",".join(f"{p}:{n}" for p, n in sorted(net.items()) if n)
    return xxhash.xxh3_64_intdigest(f"{max(dice)}{min(dice)} {moved}") >> 1


def games_of(text: str) -> list[list[int]]:
    """The plays of each game of a transcript, in order. Lines that are no plays count for nothing but the border between games."""
    games: list[list[int]] = [[]]
    for line in text.splitlines():
        rolls = list(_ROLL.finditer(line))
        if not rolls:
            if _GAME.match(line) and games[-1]:
                games.append([])
            continue
        for here, after in pairwise([*rolls, None]):
            games[-1].append(play_token(here.groups(), line[here.end() : after.start() if after else len(line)]))
    return [g for g in games if g]


def same_match(a: list[list[int]], b: list[list[int]]) -> bool:
    """Whether at least SAME_PLAYS of the plays of the longer transcript are in the other, in order or with whole games moved."""
    flat_a, flat_b = [p for g in a for p in g], [p for g in b for p in g]
    need = SAME_PLAYS * max(len(flat_a), len(flat_b)) - 1e-9
    if not need > 0 or common(flat_a, flat_b) < need:
        return False
    if lcs_length(flat_a, flat_b) >= need:
        return True
    scores = sorted(((lcs_length(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if common(x, y)), reverse=True)
    used_a, used_b, total = set(), set(), 0
    for n, i, j in scores:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            total += n
    return total >= need


def _bigrams(games: list[np.ndarray]) -> np.ndarray:
    """Pairs of neighbouring plays within games; single plays where a game has one."""
    parts = []
    with np.errstate(over="ignore"):
        for g in games:
            g = np.asarray(g, dtype=np.uint64)
            parts.append(g[:-1] * np.uint64(0x9E3779B97F4A7C15) + g[1:] if len(g) > 1 else g)
    return np.unique(np.concatenate(parts))


def _transcript_keys(games: list[np.ndarray]) -> np.ndarray:
    """Keys by pairs of neighbouring plays. In a short transcript few edits break most pairs, so it also gets keys by single plays."""
    keys = table_keys(_bigrams(games))
    plays = np.concatenate([np.asarray(g, dtype=np.uint64) for g in games])
    return np.concatenate([keys, table_keys(np.unique(plays), salt=1)]) if len(plays) < SHORT_PLAYS else keys


#: Cells of a count profile, and the count at which a cell is full and says no more.
CELLS, FULL_CELL = 128, 255


def count_profile(games: list[np.ndarray]) -> bytes:
    """How many plays fall into each of CELLS cells by hash."""
    plays = np.concatenate([np.asarray(g, dtype=np.uint64) for g in games])
    return np.minimum(np.bincount((plays % np.uint64(CELLS)).astype(int), minlength=CELLS), FULL_CELL).astype(np.uint8).tobytes()


def profiles_allow(a: list[bytes], b: list[bytes], ratio: float) -> np.ndarray:
    """Whether two transcripts can have `ratio` of the longer one's plays in common: no more than the lesser counts of all cells together, unless a cell is full."""
    x, y = (np.frombuffer(b"".join(p), dtype=np.uint8).reshape(-1, CELLS).astype(np.int32) for p in (a, b))
    full = ((x == FULL_CELL) | (y == FULL_CELL)).any(axis=1)
    return full | (np.minimum(x, y).sum(axis=1) >= ratio * np.maximum(x.sum(axis=1), y.sum(axis=1)) - 1e-9)


def _groups(spark: SparkSession, rows: DataFrame, parsed_schema: str, parse, keys_of, same, size_of=lambda _: 0, ratio: float = 0.0, profile_of=None) -> DataFrame:
    """(id, root) of every row of `rows` (id, value) that has a partner.

    `parse` makes the normal form of a value, or None where it belongs to no group; `keys_of` gives the table keys of a
    normal form, `same` decides on two of them. It never holds where the smaller `size_of` is below `ratio` of the larger, or the profiles by `profile_of` rule it out;
    pairs that profiles rule out never fetch the normal forms.
    """
    scratch = Scratch(spark, "near-duplicates")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = [parse(v) for v in batch["value"]]
            keep = [f is not None for f in forms]
            forms = [f for f in forms if f is not None]
            yield pd.DataFrame({"id": batch["id"][keep].to_numpy(dtype=np.int64), "sha": [xxhash.xxh3_128_hexdigest(repr(f)) for f in forms], "form": forms})

    parsed = scratch.save(rows.filter("value is not null").mapInPandas(read, f"id long, sha string, form {parsed_schema}"), "parsed")
    copies = parsed.groupBy("sha").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    member = parsed.select("id", "sha").join(copies, "sha").select("id", "node", "n")
    one = parsed.join(copies.select(F.col("node").alias("id")), "id").select(F.col("id").alias("node"), "form")

    def hash_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "size": [size_of(f) for f in batch["form"]], "keys": [keys_of(f) for f in batch["form"]]})

    one = scratch.save(one, "distinct")
    keys = scratch.save(one.mapInPandas(hash_forms, "node long, size long, keys array<long>").select("node", "size", F.explode("keys").alias("key")), "keys")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            holds = [same(x, y) for x, y in zip(batch["form_a"], batch["form_b"], strict=True)]
            yield batch.loc[holds, ["a", "b"]]

    if profile_of is not None:

        def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"node": batch["node"], "profile": [profile_of(f) for f in batch["form"]]})

        profiles = scratch.save(one.mapInPandas(profile, "node long, profile binary"), "profiles")

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                yield batch.loc[profiles_allow(list(batch["pa"]), list(batch["pb"]), ratio), ["a", "b"]]

    def holding(pairs: DataFrame, name: str) -> DataFrame:
        if profile_of is not None:
            both = pairs.join(profiles.select(F.col("node").alias("a"), F.col("profile").alias("pa")), "a").join(profiles.select(F.col("node").alias("b"), F.col("profile").alias("pb")), "b")
            pairs = scratch.save(both.mapInPandas(possible, "a long, b long"), f"possible-{name}")
        sides = pairs.join(one.select(F.col("node").alias("a"), F.col("form").alias("form_a")), "a").join(one.select(F.col("node").alias("b"), F.col("form").alias("form_b")), "b")
        return scratch.save(sides.mapInPandas(check, "a long, b long"), name)

    links = holding(table_links(keys), "links")
    roots = components(spark, links)
    labelled = keys.join(roots, "node", "left").select("node", "key", "size", F.coalesce("root", "node").alias("group"))
    rest = holding(table_pairs(labelled, ratio), "rest")
    if not rest.isEmpty():
        roots = components(spark, links.unionByName(rest))
    grouped = member.join(roots, "node", "left").filter("n > 1 or root is not null").select("id", F.coalesce("root", "node").alias("root"))
    out = scratch.save(grouped, "groups")
    for name in ("parsed", "distinct", "keys", "links", "rest", "profiles", "possible-links", "possible-rest"):
        scratch.drop(name)
    return out


def _parse_moves(text: str) -> list[list[int]] | None:
    return games_of(text) or None


def transcript_groups(spark: SparkSession, items: DataFrame, key: str = "item_id", text: str = "moves") -> DataFrame:
    """(id, root) of the rows whose transcripts are of the same match as another row's."""
    rows = items.select(F.col(key).cast("long").alias("id"), F.col(text).alias("value"))
    return _groups(spark, rows, "array<array<long>>", _parse_moves, _transcript_keys, same_match, lambda games: sum(map(len, games)), SAME_PLAYS, count_profile)


# Words at either end of a file name that only mark a copy or version.
EDGE_MARKS = ["copy", "kopie", "copie", "copia", "fixed", "checked", "corrected", "edited", "revised", "old", "new", "ok", "backup", "bak", "version", "final version", "latest", "duplicate", "dup", "tmp", "temp", "inbox", "final"]

_MARK = rf"(?:{'|'.join(sorted(EDGE_MARKS, key=len, reverse=True))})(?: \d{{1,2}}\b)?|v(?:er)?(?: ?\d{{1,2}})?"
_EDGE = re.compile(rf"^(?:{_MARK})(?= )|(?<= )(?:{_MARK})$")
_PARENTHESES = re.compile(r"[\(\[](?:\d{1,2}|copy|kopie|copie|copia|old|new|ok)[\)\]]")


def name_form(name: str) -> list[list[str]] | None:
    """A file name as [numbers, words], without folder, extension, accents, case, order and marks of copies; None if nothing is left."""
    base = re.split(r"[/\\]", name.strip())[-1]
    base = re.sub(r"(?:\.(?:mat|txt|sgf|xg|xgp|bak|old|tmp|json))+~?$", "", base, flags=re.IGNORECASE)
    base = "".join(c for c in unicodedata.normalize("NFD", base.lower()) if not unicodedata.combining(c))
    base = _PARENTHESES.sub(" ", base)
    base = re.sub(r"[^\w.]|_", " ", base)
    base = re.sub(r"\.(?=\w)", " ", base)
    base = re.sub(r"\s+", " ", base).strip()
    while (shorter := _EDGE.sub("", base).strip()) != base:
        base = shorter
    numbers = sorted(re.findall(r"\d+", base))
    words = sorted(re.findall(r"[^\W\d]+\.?", base))
    return [numbers, words] if numbers or words else None


def _word_features(form: list[list[str]]) -> np.ndarray:
    grams = {w[max(0, i - 1) : i + 1] if i else "^" + w[0] for w in (x.rstrip(".") for x in form[1]) for i in range(len(w))} | {"#"}
    return np.array([xxhash.xxh3_64_intdigest(g) for g in sorted(grams)], dtype=np.uint64)


def _name_keys(form: list[list[str]]) -> np.ndarray:
    """Keys by the letters of the words, apart for different numbers."""
    return table_keys(_word_features(form), salt=xxhash.xxh3_64_intdigest(" ".join(form[0])))


def _close_words(x: str, y: str) -> bool:
    """One word for another: a typing error (one, two in words of nine letters or more, none between words of two letters or less), or an abbreviation that ends in a dot."""
    if x.endswith(".") or y.endswith("."):
        short, long = sorted((x.rstrip("."), y.rstrip(".")), key=len)
        if long.startswith(short) and len(short) >= 2:
            return True
    x, y = x.rstrip("."), y.rstrip(".")
    least = min(len(x), len(y))
    return least >= 2 and max(len(x), len(y)) >= 3 and edit_distance_at_most(x, y, 2 if least >= 9 else 1)


def _initials(words: list[str], others: list[str]) -> bool:
    """Whether `words`, of two or three letters without a dot, are the initials of `others`, in any order, one letter for each."""
    return bool(words) and all(2 <= len(w) <= 3 and w.isalpha() for w in words) and sorted("".join(words)) == sorted(w[0] for w in others)


def same_name(a: list[list[str]], b: list[list[str]]) -> bool:
    """Whether two file names are one: the same numbers, and words that pair up but for typing errors, abbreviations and initials."""
    if list(a[0]) != list(b[0]):
        return False
    left, right = Counter(a[1]), Counter(b[1])
    x, y = sorted((left - right).elements(), key=len, reverse=True), list((right - left).elements())
    if "".join(sorted("".join(a[1]))) == "".join(sorted("".join(b[1]))) and len(x) + len(y) <= 3:
        return True  # words run together or taken apart
    if max(len(x), len(y)) > 4:
        return False
    left_over = []
    for word in x:
        partner = next((w for w in y if _close_words(word, w)), None)
        if partner is None:
            left_over.append(word)
        else:
            y.remove(partner)
    if not left_over and not y:
        return len(x) <= 3
    return _initials(left_over, y) or _initials(y, left_over)


def file_name_groups(spark: SparkSession, rows: DataFrame, key: str = "row_id", name: str = "file") -> DataFrame:
    """(id, root) of the rows whose file name is that of another row but for differences of writing."""
    chosen = rows.select(F.col(key).cast("long").alias("id"), F.col(name).alias("value"))
    return _groups(spark, chosen, "array<array<string>>", name_form, _name_keys, same_name)
