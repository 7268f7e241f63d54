"""Text that was decoded with the wrong character encoding: the values concerned, and the text as it was.

The corpus is its own dictionary. Its distinct words (runs without blanks, outer ASCII punctuation stripped) that hold a
character beyond ASCII are judged once each; the clean ones, and the originals that reversing a suspicious one proposes,
form the table of originals. Every original is garbled along every chain of `CHAINS`, and the words of the corpus are
hash-joined against that table. A hit is verified: the original must look no worse than the word, and for chains that
map one byte to one character, or lose characters, it must occur in the corpus more often than the garbled form.

Words of all rows are counted; nothing is sampled, and only tables of distinct words are joined. A word with U+FFFD,
or with signs, controls or capitals where ordinary writing has none, is reported even where no original is found.

Defined cases: null, empty and pure ASCII values without `?` beside a letter are not concerned; a value is reported once
however many of its words are garbled; restored is null where some word has no verified original; ties between originals
go to the more frequent, then to the smaller by code point; rows given twice are reported twice.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipworks.storage import Scratch

#: Single-byte encodings that text in UTF-8 gets read as.
READ_AS = ["cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "mac_latin2", "iso8859-2", "cp1254", "iso8859-15"]
#: Two rounds of the same mistake.
TWICE = [("cp1252", "cp1252"), ("latin-1", "latin-1"), ("cp1252", "latin-1"), ("latin-1", "cp1252"), ("mac_roman", "mac_roman"), ("cp1250", "cp1250"), ("cp437", "cp437")]
#: Pairs (written in, read as) of single-byte encodings.
SWAPPED = [
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"),
    ("iso8859-2", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1254", "cp1252"), ("mac_latin2", "cp1250"), ("cp1250", "mac_latin2"), ("cp852", "cp1250"), ("cp1250", "cp852"), ("cp1250", "mac_roman"),
]
#: Encodings whose bytes were read as UTF-8 and replaced.
LOST_IN = ["cp1252", "cp1250", "cp1251", "mac_roman", "iso8859-2"]
FFFD = "�"

# Punctuation and signs beyond ASCII that occur in ordinary text.
_SIGNS = set("‘’‚“”„«»‹›–—…¿¡·•§¶©®™°ºª¹²³½¼¾±×÷£€¥¢µ№†")
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_NOT_ASCII = "[^\\x00-\\x7F]"
#: A question mark where a letter may be lost.
_ASKED = r"[A-Za-z]\?|\?[A-Za-z]"


def _encode(text: str, codec: str) -> bytes | None:
    """Bytes of `text`; where the code page leaves a byte undefined, the control character of the same number stands for it."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) <= 0x9F:
                return None
            out.append(ord(c))
    return bytes(out)


@lru_cache(maxsize=64)
def _decode_table(codec: str) -> list[str]:
    table = []
    for b in range(256):
        try:
            table.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            table.append(chr(b))
    return table


def _decode(data: bytes, codec: str) -> str:
    table = _decode_table(codec)
    return "".join(table[b] for b in data)


def garblings(word: str) -> list[tuple[str, str, int]]:
    """(garbled form, as written, rank) of a word; rank 0: UTF-8 read as another encoding, 1: one byte for another, 2: characters lost.

    The form is what the split into words yields; as written it is longer where a no-break space became a plain one.
    """
    utf8 = word.encode("utf-8", "surrogatepass")
    out: dict[str, tuple[str, int]] = {}
    for codec in READ_AS:
        out.setdefault(_decode(utf8, codec), (f"utf-8>{codec}", 0))
    for first, second in TWICE:
        out.setdefault(_decode(_decode(utf8, first).encode("utf-8"), second), (f"utf-8>{first}>utf-8>{second}", 0))
    for written, read in SWAPPED:
        try:
            out.setdefault(_decode(word.encode(written), read), (f"{written}>{read}", 1))
        except UnicodeEncodeError:
            pass
    for codec in LOST_IN:
        try:
            out.setdefault(word.encode(codec).decode("utf-8", "replace"), (f"{codec}>utf-8", 2))
        except UnicodeEncodeError:
            pass
    out.setdefault(utf8.decode("ascii", "replace"), ("utf-8>ascii", 2))
    out.setdefault(re.sub(_NOT_ASCII, FFFD, word), ("lost", 2))
    asked = re.sub(_NOT_ASCII, "?", word)
    if len(re.findall("[A-Za-z]", asked)) >= 3:
        out.setdefault(asked, ("asked", 2))
    out.pop(word, None)
    forms = [(form, form, rank) for form, (_, rank) in out.items() if rank < 2 or 2 * len(re.sub("[?\ufffd]", "", form)) > len(form)]
    for form, _, rank in list(forms):  # a no-break space is often made a plain one, which ends the word
        head = form.split("\u00a0", 1)[0]
        if head != form and len(head) >= 3 and re.search(_NOT_ASCII, head) and head not in out:
            forms.append((head, form.replace("\u00a0", " "), rank))
    return forms


def oddness(word: str) -> int:
    """How unlike ordinary writing a word is: signs between letters, controls, capitals inside, mixed scripts."""
    odd, before, scripts = 0, "", set()
    for c in word:
        if ord(c) < 128:
            before = c
            continue
        kind = unicodedata.category(c)
        if kind[0] == "L":
            scripts.add(unicodedata.name(c, "?").split()[0])
            odd += kind == "Lu" and before.islower()
        elif kind[0] == "M":
            pass
        elif c == FFFD or kind == "Cc":
            odd += 3
        elif c not in _SIGNS:
            odd += 2
        elif before.isalpha() and c not in "’ºª…”“»–—™®":
            odd += 1
        before = c
    return odd + 2 * (len(scripts & {"GREEK", "CYRILLIC", "LATIN"}) > 1)


def _plausible(c: str) -> bool:
    return ord(c) < 128 or c in _SIGNS or (unicodedata.category(c)[0] in "LM" and unicodedata.name(c, "?").split()[0] in {"LATIN", "GREEK", "CYRILLIC", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "HEBREW", "ARABIC", "THAI", "COMBINING", "ARMENIAN", "GEORGIAN", "DEVANAGARI", "KATAKANA-HIRAGANA"} and not 0x0250 <= ord(c) <= 0x02FF)


_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def reversed_forms(word: str, depth: int = 2) -> set[str]:
    """Originals that UTF-8 read as some encoding would explain: every valid sequence inside the word put back."""
    found: set[str] = set()
    if depth == 0 or not re.search(_NOT_ASCII, word):
        return found
    for codec in READ_AS:
        data = _encode(word, codec)
        if data is None or not _SEQUENCE.search(data):
            continue
        parts, at, sane = [], 0, True
        for m in _SEQUENCE.finditer(data):
            try:
                c = m.group().decode("utf-8")
            except UnicodeDecodeError:
                sane = False
                break
            sane &= _plausible(c) or depth == 2
            parts += [_decode(data[at : m.start()], codec), c]
            at = m.end()
        if not sane:
            continue
        fixed = "".join(parts) + _decode(data[at:], codec)
        deeper = reversed_forms(fixed, depth - 1)
        if all(map(_plausible, fixed)):
            found.add(fixed)
        found |= deeper
    return found - {word}


def originals_of(word: str) -> list[str]:
    """What a distinct word of the corpus contributes to the table of originals: itself if it looks clean, else the forms it may come from."""
    back = [f for f in reversed_forms(word) if oddness(f) <= oddness(word)]
    if back:
        return sorted(back)
    return [word] if FFFD not in word and all(map(_plausible, word)) else []


def core(token: str) -> str:
    return token.strip(_PUNCTUATION)


def values_of(records: DataFrame) -> DataFrame:
    """(row_id, field, pos, value) of the names, events and remarks of match_records that can be concerned."""
    named = records.select("row_id", F.posexplode(F.transform("sides", lambda s: s["name"])).alias("pos", "value")).select("row_id", F.lit("name").alias("field"), "pos", "value")
    event = records.select("row_id", F.lit("event").alias("field"), F.lit(0).alias("pos"), F.col("event").alias("value"))
    remarks = records.select("row_id", F.posexplode("remarks").alias("pos", "value")).select("row_id", F.lit("remarks").alias("field"), "pos", "value")
    return named.unionByName(event).unionByName(remarks).filter(F.col("value").rlike(_NOT_ASCII) | F.col("value").rlike(_ASKED))


def _words(value: Column) -> Column:
    """Words of a value without outer ASCII punctuation, and with it where that is a question mark: it may stand for a lost letter."""
    tokens = F.split(value, "[ \\t\\r\\n]+")
    stripped = lambda signs: F.transform(tokens, lambda t: F.regexp_replace(t, f"^{signs}+|{signs}+$", ""))
    each = F.array_union(stripped(r"[\p{Punct}&&\p{ASCII}]"), stripped(r"[\p{Punct}&&\p{ASCII}&&[^?]]"))
    return F.filter(each, lambda w: w.rlike(_NOT_ASCII) | w.rlike(_ASKED))


def garbled_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(word, written, original) of the garbled ones among distinct `words` (word, n): original is null where none could be verified."""
    scratch = Scratch(spark, "mojibake")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(o, n if o == w else 0) for w, n in zip(batch["word"], batch["n"], strict=True) if not w.isascii() for o in originals_of(w)]
            yield pd.DataFrame(rows, columns=["original", "seen"])

    originals = words.mapInPandas(judge, "original string, seen long").groupBy("original").agg(F.max("seen").alias("seen"))

    def garble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(form, written, o, seen, rank, oddness(o)) for o, seen in zip(batch["original"], batch["seen"], strict=True) for form, written, rank in garblings(o)]
            yield pd.DataFrame(rows, columns=["word", "written", "original", "seen", "rank", "odd"])

    table = originals.mapInPandas(garble, "word string, written string, original string, seen long, rank int, odd int")
    hits = scratch.save(words.join(table, "word"), "hits")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shape = b["word"].map(oddness)
            bytes_gone = (b["rank"] == 0) & (b["odd"] <= shape)
            swapped = (b["rank"] == 1) & ((b["odd"] < shape) & (b["seen"] >= b["n"]) | (b["odd"] == shape) & (b["seen"] >= 5 * b["n"]))
            lost = (b["rank"] == 2) & (b["seen"] > 0)
            yield b.loc[bytes_gone | swapped | lost, ["word", "written", "original", "seen"]]

    good = hits.mapInPandas(verify, "word string, written string, original string, seen long")
    # the most frequent original; of equals the smallest by code point
    best = F.min_by(F.struct("written", "original"), F.struct(-F.col("seen"), "original", "written"))
    chosen = good.groupBy("word").agg(best.alias("b")).select("word", "b.written", "b.original")

    def misshapen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[FFFD in w or oddness(w) >= 2 for w in b["word"]], ["word"]]

    broken = words.select("word").mapInPandas(misshapen, "word string")
    return chosen.join(broken, "word", "full_outer").select("word", "written", "original")


def restored_values(spark: SparkSession, values: DataFrame) -> DataFrame:
    """(value, restored) of the garbled ones among distinct values (value, times)."""
    tokens = values.select("value", "times", F.explode(_words(F.col("value"))).alias("word"))
    words = tokens.groupBy("word").agg(F.sum("times").alias("n"))
    bad = Scratch(spark, "mojibake").save(garbled_words(spark, words), "words")
    pairs = tokens.join(bad, "word").groupBy("value").agg(F.collect_list(F.struct("word", "written", "original")).alias("pairs"))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            restored = []
            for value, pairs in zip(batch["value"], batch["pairs"], strict=True):
                for p in sorted((p for p in pairs if p["original"] is not None), key=lambda p: -len(p["written"])):
                    value = value.replace(p["written"] if p["written"] in value else p["word"], p["original"])
                if any(p["original"] is None and p["word"] in value for p in pairs):
                    restored.append(None)
                    continue
                value = re.sub("Ã\u00a0|Ã (?= )", "à", value)  # à alone, whose second byte became a blank
                restored.append(value)
            yield pd.DataFrame({"value": batch["value"], "restored": restored})

    return pairs.mapInPandas(restore, "value string, restored string")


def find(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(row_id, field, pos, value, restored) of the values of match_records that were decoded wrongly."""
    values = values_of(records)
    found = restored_values(spark, values.groupBy("value").agg(F.count(F.lit(1)).alias("times")))
    return values.join(found, "value").select("row_id", "field", "pos", "value", "restored")
