"""Queries on the content of match files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.operators import transcripts
from pipworks.sources.tables import table


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "match_files").filter("ext = 'mat'").select(F.concat_ws("#", F.col("file_no").cast("string"), "path").alias("path"), "content")


def transcript_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Every .mat file read and checked: format, result, status and identity."""
    return transcripts.summaries(_files(spark, folder)).drop("diagnostics")


def transcript_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Diagnostics by severity and code."""
    return transcripts.diagnostics(transcripts.summaries(_files(spark, folder))).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def transcript_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Every action with the identifiers of its position."""
    return transcripts.actions(_files(spark, folder))


def transcript_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every .mat file parsed without replaying it: names, length, date, event, start scores, stated points and rolls."""
    return transcripts.scan(_files(spark, folder))


def transcript_written(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every .mat file when it is written in the normal layout and parsed again."""
    again = transcripts.scan(transcripts.written(_files(spark, folder)).withColumnRenamed("text", "content"))
    return again.select("path", "p0", "p1", "match_length", "games", "starts", "points", "rolls")


def known_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Sightings of each match among the .mat files, by length and rolls of the files as parsed."""
    scanned = transcripts.scan(_files(spark, folder))
    return scanned.groupBy("match_length", "rolls").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))


def file_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """What the names of inbox files propose."""
    return transcripts.proposals(table(spark, folder, "inbox_items"))


def roll_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Rolls that rows of metas share with the accepted match whose hash begins alike."""
    start = lambda c: F.substring(F.lower(F.trim(F.element_at(F.split(c, "/"), -1))), 1, 16)
    a = table(spark, folder, "metas").select("row_id", start("id").alias("start"), F.col("rolls").alias("rolls_a"))
    b = table(spark, folder, "hashes").select(start("id").alias("start"), F.col("id").alias("accepted_id"), F.col("rolls").alias("rolls_b"))
    return transcripts.roll_shares(a.join(b, "start")).select("row_id", "accepted_id", F.round("share", 6).alias("share"))


QUERIES = {f.__name__: f for f in (transcript_summaries, transcript_problems, transcript_actions, transcript_scan, transcript_written, known_matches, file_proposals, roll_shares)}

# Files with a length line, a game line and a score line after it, read by patterns. Rolls of nothing (00) can't occur here.
_SCAN = r"""WITH f AS (
  SELECT concat_ws('#', file_no::VARCHAR, path) AS path, replace(content, chr(13), '') AS t FROM match_files WHERE ext = 'mat' AND content IS NOT NULL),
 scored AS (
  SELECT *, regexp_extract_all(t, '(?m)^ *Game +\d+ *
(.*)$', 1) AS lines FROM f WHERE regexp_matches(t, '(?m)^ *\d+ point match *$|^ *(?i:money|unlimited)') AND regexp_matches(t, '(?m)^ *Game +\d+ *$')),
 scan AS (
  SELECT path, regexp_extract(lines[len(lines)], '^ *(.*?\S) *: *\d+ +', 1) AS p0, regexp_extract(lines[len(lines)], ' : *\d+ +(\S.*?) *: *\d+ *$', 1) AS p1,
    coalesce(try_cast(regexp_extract(t, '(?m)^ *(\d+) point match *$', 1) AS INT), 0) AS match_length,
    nullif(replace(regexp_extract(t, '\[EventDate "([^"]*)"\]', 1), '.', '-'), '') AS date, nullif(trim(regexp_extract(t, '\[Event "(.*)"\]', 1)), '') AS event, len(lines)::INT AS games,
    list_transform(lines, lambda l: regexp_extract(l, ': *(\d+) +\S', 1) || '-' || regexp_extract(l, ': *(\d+) *$', 1)) AS starts,
    list_transform(regexp_split_to_array(t, '(?m)^ *Game +\d+ *$')[2:], lambda g: coalesce(try_cast(regexp_extract(g, 'Wins +(\d+) +point', 1) AS INT), 0)) AS points,
    array_to_string(regexp_extract_all(t, '(?:^|\s)([0-6][0-6]):', 1), ' ') AS rolls FROM scored)
"""

ORACLE: dict[str, str] = {
    "transcript_scan": _SCAN + "SELECT * FROM scan",
    "transcript_written": _SCAN + "SELECT path, p0, p1, match_length, games, starts, points, rolls FROM scan",
    "known_matches": _SCAN + "SELECT match_length, rolls, count(*) AS files, min(path) AS first_path FROM scan GROUP BY 1, 2",
}
