"""Pages stuffed with keywords, links, product tags or offers rather than written.

Texts are split into units (lines, and sentences within lines) once, and their words kept as 64-bit hashes. A unit is
dense in list form if it is mostly a link, has bars, arrows or link markup, or falls into many short pieces. Phrases
(shingles of one and of two words) are counted by the distinct hosts (authors; a text without one is its own host) that
use them in dense units and elsewhere, over all documents. A phrase is replicated if at least MIN_HOSTS hosts use it in
dense units of as many different texts (a text posted again is one text), and at least DENSE_SHARE of all its hosts do.
A unit counts as stuffed if replicated phrases cover STUFFED of its words, or if it is mostly link in a text with
several links. A document is flagged if stuffed units make up more than half of it.

Counting emits each (phrase, host, text) of an Arrow batch once, so a phrase, an author or a text that makes up much of
the crawl is combined before the shuffle. The replicated phrases are sent to every task if they are at most SENT hashes
(counted first); beyond that the shingles are joined with them.

Defined cases: null and blank texts are never flagged; copies of a text are judged alike; a text of any length is read
whole; the same doc_id given twice is judged as one document with both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.llm.covering import mix
from pipworks.storage import Scratch

MIN_HOSTS = 3
#: Share of a phrase's hosts that must use it in dense units.
DENSE_SHARE = 0.5
#: Share of a unit's words that replicated phrases must cover.
STUFFED = 0.33
#: Words from which on a unit outside lists is judged.
LEAST_WORDS = 4
#: Links from which on a text's links count as a list.
MIN_LINKS = 3
#: Replicated phrases (8 bytes each) up to which they are sent to every task.
SENT = 4_000_000

# Links, and hash tags, which are links by another name.
_URL = r"(?:https?://|www\.)\S+|#\p{L}\S*"
_MARKUP = _URL + r"|\[/?url[^\]]*\]|</?a\b[^>]*>"
_UNITS = "doc_id long, host long, text long, at int, chars int, url_chars int, links int, dense boolean, words array<long>"


def units(documents: DataFrame) -> DataFrame:
    """Every unit of `documents` (doc_id, text, author): the columns of _UNITS."""
    host = F.when(F.col("author").isNull(), F.xxhash64(F.lit("own"), "doc_id")).otherwise(F.xxhash64("author"))
    parts = F.split("text", r"\R|(?<=[.!?])\s+")
    # hashed before they are split, so that no unit carries the whole text
    hashed = documents.filter("text is not null").select("doc_id", host.alias("host"), F.xxhash64("text").alias("key"), "text")
    each = hashed.select("doc_id", "host", F.col("key").alias("text"), F.posexplode(parts).alias("at", "u"))
    has = lambda sign: F.contains("u", F.lit(sign))
    count = lambda sign: (F.length("u") - F.length(F.replace("u", F.lit(sign), F.lit("")))) / len(sign)
    each = each.filter(F.trim("u") != "").withColumn("signs", has("[") | has("<") | has("#") | has("://") | has("www."))
    linked = lambda e, plain: F.when(F.col("signs"), e).otherwise(plain)
    bare = F.lower(linked(F.regexp_replace("u", _MARKUP, " "), F.col("u")))
    words = F.array_remove(F.split(bare, r"[^\p{L}\p{M}']+"), "")
    url_chars = linked(F.length("u") - F.length(F.regexp_replace("u", _URL, "")), F.lit(0))
    each = each.select("doc_id", "host", "text", "at", "u", F.length("u").alias("chars"), url_chars.alias("url_chars"), linked(F.regexp_count("u", F.lit(_URL)), F.lit(0)).alias("links"), words.alias("words"))
    n, pieces = F.size("words"), 1 + count(",") + count("|") + count(";") + count("->")
    short_line = n.between(1, 5) & ~F.col("u").rlike(r"[0-9:]|[.!?]$")
    marked = has("|") | has("->") | has("[url") | (has("<a") & F.col("u").rlike(r"<a\b"))
    dense = (2 * F.col("url_chars") > F.col("chars")) | marked | ((pieces >= 5) & (n <= 3.5 * pieces)) | short_line
    return each.select("doc_id", "host", "text", "at", "chars", "url_chars", "links", dense.alias("dense"), F.transform("words", lambda w: F.xxhash64(w)).alias("words"))


def shingles(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of neighbouring words, and whether both lie in one unit; one less than there are words."""
    with np.errstate(over="ignore"):
        pairs = mix(words[:-1].view(np.uint64) * np.uint64(3) + mix(words[1:].view(np.uint64)))
    return pairs.view(np.int64), owner[:-1] == owner[1:]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Words of all units of a batch, and the unit each is of."""
    lists = batch.column(batch.schema.get_field_index("words"))
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _uses(each: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(phrase, host, text) of the phrases of units, each once per batch; only those of the sorted `among`, if given."""
    kept = None if among is None else each.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, owner = _flat(batch)
            pairs, whole = shingles(words, owner) if len(words) else (words, words.astype(bool))
            phrase, unit = np.concatenate([words, pairs[whole]]), np.concatenate([owner, owner[:-1][whole]]) if len(words) else owner
            if kept is not None:
                known = contained(phrase, kept.value)
                phrase, unit = phrase[known], unit[known]
            rows = np.unique(np.stack([phrase, _column(batch, "host")[unit], _column(batch, "text")[unit]], axis=1), axis=0) if len(phrase) else np.empty((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], names=["phrase", "host", "text"])

    return each.select("host", "text", "words").mapInArrow(run, "phrase long, host long, text long")


def contained(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array `among`."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _collected(phrases: DataFrame) -> np.ndarray | None:
    """The phrases sorted, if they are at most SENT."""
    if phrases.count() > SENT:
        return None
    return np.sort(phrases.select("phrase").toPandas()["phrase"].to_numpy(np.int64))


def replicated_phrases(scratch: Scratch, each: DataFrame) -> DataFrame:
    """(phrase, dense_hosts, other_hosts) of the phrases that several hosts use in dense units of different texts, mostly there."""
    dense = _uses(each.filter("dense")).groupBy("phrase").agg(F.count_distinct("host").alias("dense_hosts"), F.count_distinct("text").alias("texts"))
    in_dense = scratch.save(dense.filter(F.least("dense_hosts", "texts") >= MIN_HOSTS), "in_dense")
    other = each.filter("not dense")
    known = _collected(in_dense)
    used = _uses(other, known) if known is not None else _uses(other).join(in_dense.select("phrase"), "phrase", "left_semi")
    elsewhere = used.select("phrase", "host").distinct().groupBy("phrase").agg(F.count(F.lit(1)).alias("other_hosts"))
    both = in_dense.join(elsewhere, "phrase", "left").select("phrase", "dense_hosts", F.coalesce("other_hosts", F.lit(0)).alias("other_hosts"))
    return both.filter(F.col("dense_hosts") >= DENSE_SHARE * (F.col("dense_hosts") + F.col("other_hosts")))


def _covered(each: DataFrame, phrases: np.ndarray) -> DataFrame:
    """Units with `n` words, `covered` of them in replicated phrases."""
    sent = each.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, owner = _flat(batch)
            hit = contained(words, sent.value)
            if len(words) > 1:
                pairs, whole = shingles(words, owner)
                both = contained(pairs, sent.value) & whole
                hit[:-1] |= both
                hit[1:] |= both
            count = lambda of: pa.array(np.bincount(owner[of], minlength=batch.num_rows).astype(np.int32))  # noqa: B023, E731
            rest = batch.select(["doc_id", "chars", "url_chars", "links", "dense"])
            yield pa.RecordBatch.from_arrays([*rest.columns, count(np.ones(len(words), bool)), count(hit)], names=[*rest.schema.names, "n", "covered"])

    return each.mapInArrow(run, "doc_id long, chars int, url_chars int, links int, dense boolean, n int, covered int")


def _covered_by_join(each: DataFrame, phrases: DataFrame) -> DataFrame:
    """As `_covered`, for any number of phrases: every word, with the pairs it is in, is joined with them."""
    keys, rest = ["doc_id", "text", "at"], ["chars", "url_chars", "links", "dense"]
    once = each.groupBy(*keys).agg(*[F.first(c).alias(c) for c in [*rest, "words"]], F.count(F.lit(1)).alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, owner = _flat(batch)
            pairs, whole = shingles(words, owner) if len(words) else (words, words.astype(bool))
            place = np.arange(len(words))
            word = np.concatenate([place, place[:-1][whole], place[1:][whole]]) if len(words) else place
            phrase = np.concatenate([words, pairs[whole], pairs[whole]])
            unit = owner[word]
            columns = [pa.array(_column(batch, k)[unit]) for k in keys] + [pa.array(word), pa.array(phrase)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "word", "phrase"])

    schema = "doc_id long, text long, at int, word long, phrase long"
    found = once.select(*keys, "words").mapInArrow(run, schema).join(phrases.select("phrase"), "phrase", "left_semi")
    hit = found.groupBy(*keys).agg(F.count_distinct("word").cast("int").alias("covered"))
    scored = once.join(hit, keys, "left").withColumns({"n": F.size("words"), "covered": F.coalesce("covered", F.lit(0))})
    return scored.select("doc_id", *[(F.col(c) * F.col("times")).alias(c) for c in ("chars", "url_chars", "links")], "dense", "n", "covered")


def judged(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, chars, stuffed_chars) of every document with a text that is not blank."""
    scratch = Scratch(spark, "spam")
    each = scratch.save(units(documents.select("doc_id", "text", "author")), "units")
    phrases = scratch.save(replicated_phrases(scratch, each), "phrases")
    known = _collected(phrases)
    scored = _covered(each, known) if known is not None else _covered_by_join(each, phrases)
    worded = (F.col("covered") >= STUFFED * F.col("n")) & (F.col("n") > 0) & ((F.col("n") >= LEAST_WORDS) | F.col("dense"))
    linked = 2 * F.col("url_chars") > F.col("chars")
    by_doc = scored.groupBy("doc_id").agg(
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum(F.when(worded, F.col("chars")).otherwise(0)).alias("worded"),
        F.sum(F.when(~worded & linked, F.col("chars")).when(~worded, F.col("url_chars")).otherwise(0)).alias("linked"),
    )
    return by_doc.select("doc_id", "chars", (F.col("worded") + F.when(F.col("links") >= MIN_LINKS, F.col("linked")).otherwise(0)).alias("stuffed_chars"))


def flagged(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id of the documents of which stuffed units make up more than half."""
    return judged(spark, documents).filter(2 * F.col("stuffed_chars") > F.col("chars")).select("doc_id")
