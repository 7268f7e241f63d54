"""Column expressions on names and texts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that count as accents when they stand alone (fixed values).
LONE_ACCENTS = "^`¨´·¯¸ˆ˜˘˙˚˛˝"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters with accents and the letters that remain without them, by decomposing every letter of the basic plane."""
    source, target = [], []
    for code in range(0x00C0, 0x2000):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) > 1 and unicodedata.category(parts[0])[0] == "L":
            rest = "".join(c for c in parts if not unicodedata.combining(c))
            if len(rest) == 1:
                source.append(letter)
                target.append(rest)
    return "".join(source), "".join(target)


def normalise(text: Column) -> Column:
    """The form in which names are compared: no accents, lower case, single blanks, none outside. Null stays null."""
    source, target = _accents()
    marks = "[\\p{Mn}" + "".join("\\" + c if c in "^" else c for c in LONE_ACCENTS) + "]"
    bare = F.translate(F.regexp_replace(text, marks, ""), source, target)
    return F.trim(F.regexp_replace(F.lower(bare), "\\s+", " "))


def natural_key(text: Column, width: int = 10) -> Column:
    """A key that sorts runs of digits as numbers: every run padded to `width` digits."""
    padded = F.regexp_replace(text, "([0-9]+)", "0" * width + "$1")
    return F.regexp_replace(padded, f"[0-9]*([0-9]{{{width}}})(?![0-9])", "$1")


def display_key(p0: Column, p1: Column, date: Column, event: Column, round_: Column, length: Column) -> Column:
    """What a match looks like to a reader: the two names in alphabetical order, date, event, round and length."""
    names = F.array_join(F.array_sort(F.array(*[F.coalesce(normalise(p), F.lit("")) for p in (p0, p1)])), " / ")
    rest = [F.coalesce(c, F.lit("")) for c in (date, normalise(event), normalise(round_), length.cast("string"))]
    return F.concat_ws(" | ", names, *rest)


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def slug(text: Column, longest: int = 40) -> Column:
    """Lower-case ASCII letters, digits and hyphens; `match` where nothing is left."""
    plain = F.regexp_replace(normalise(text), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, longest), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", "match").otherwise(cut)


def video_seconds(text: Column) -> Column:
    """`90`, `90s`, `1m30s`, `1h2m3s` in seconds; null for anything else."""
    ok = text.rlike("^(?:[0-9]+|(?=[0-9])(?:[0-9]+h)?(?:[0-9]+m)?(?:[0-9]+s)?)$")
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, f"([0-9]+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    return F.when(text.rlike("^[0-9]+$"), text.cast("long")).when(ok, part("h") * 3600 + part("m") * 60 + part("s"))


def time_label(seconds: Column) -> Column:
    """Seconds as m:ss, or h:mm:ss from an hour on."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def video_link(url: Column) -> Column:
    """The canonical address of a video on one of the hosts known here, or null."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^(?:www|m)\\.", "")
    path = F.try_parse_url(url, F.lit("PATH"))
    key = F.when(host == "youtu.be", F.regexp_extract(path, "^/([A-Za-z0-9_-]{11})/?$", 1)).when(
        host == "youtube.com", F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")), F.regexp_extract(path, "^/(?:live|shorts|embed)/([A-Za-z0-9_-]{11})/?$", 1))
    )
    return F.when((F.lower(F.substring(url, 1, 8)) == "https://") & key.rlike("^[A-Za-z0-9_-]{11}$"), F.concat(F.lit("https://www.youtube.com/watch?v="), key))


def moves_fingerprint(text: Column) -> Column:
    """A digest of a transcript without its headers: lines with blanks collapsed, without empty ones, comments and lines that are one bracket."""
    lines = F.transform(F.split(F.regexp_replace(text, "^\\uFEFF", ""), "\\r?\\n"), lambda line: F.trim(F.regexp_replace(line, "\\s+", " ")))
    kept = F.filter(lines, lambda line: (line != "") & ~F.startswith(line, F.lit(";")) & ~line.rlike("^\\[[^\\]]*\\]$"))
    return F.sha2(F.array_join(kept, "\n"), 256)


def length_text(length: Column) -> Column:
    return F.when(length == 0, "money game").when(length > 0, F.concat(length.cast("string"), F.lit(" pt")))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal, from two nested digests with constant pads."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
