"""Queries of the training-data operators and, where it can be said so, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.llm import incremental, mixing, mojibake, near_duplicates, packing, resolution, spam, spectral
from pipworks.operators.components import group_pairs
from pipworks.sources.tables import table


def p1_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """All names of match_catalog by strength."""
    return spectral.ranking(spark, table(spark, folder, "match_catalog"))


def p1_tallies(spark: SparkSession, folder: str) -> DataFrame:
    """What the ranking counts for every name: decided matches and those won."""
    return p1_ranking(spark, folder).select("name", "matches", F.col("won").cast("long").alias("won"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of inbox_items with the same match in `moves`, and of meta_review with the same name in `file`."""
    moves = near_duplicates.transcript_groups(spark, table(spark, folder, "inbox_items"))
    names = near_duplicates.file_name_groups(spark, table(spark, folder, "meta_review"))
    kinds = [group_pairs(g, "root", "id").select(F.lit(k).alias("field"), "key_a", "key_b") for k, g in (("moves", moves), ("file", names))]
    return kinds[0].unionByName(kinds[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different spellings of one player of match_catalog, or of one event of match_records."""
    names = resolution.occurring_names(table(spark, folder, "match_catalog"), table(spark, folder, "match_records"))
    pairs = group_pairs(resolution.name_groups(spark, names).select("name", F.struct("kind", "profile").alias("entity")), "entity", "name")
    return pairs.select(F.col("entity.kind").alias("kind"), F.col("key_a").alias("name_a"), F.col("key_b").alias("name_b"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of match_records that were decoded wrongly."""
    return mojibake.find(spark, table(spark, folder, "match_records")).select("row_id", "field", "pos")


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The same values with the text as it was, null where it can't be had."""
    return mojibake.find(spark, table(spark, folder, "match_records"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of metas that repeat an earlier match, and the id of its first row."""
    return incremental.repeated_matches(spark, table(spark, folder, "hashes"), table(spark, folder, "metas"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Which container of each size holds which document."""
    return packing.packed(spark, table(spark, folder, "documents"), table(spark, folder, "capacities"))


def p8_covered(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that containers of each size hold: every one with a text."""
    return p8_packed(spark, folder).select("container", "doc_id").distinct()


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents used to reach the shares of mix_targets, with their repeats."""
    return mixing.mixture(spark, table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached."""
    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.mixture(spark, table(spark, folder, "documents"), targets), targets)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents made mostly of repeated keywords, links, tags or offers."""
    return spam.flagged(spark, table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_ranking, p1_tallies, p2_found, p3_found, p5_found, p5_restored, p7_found, p8_packed, p8_covered, p9_mixture, p9_shares, p10_found)}

ORACLE: dict[str, str] = {
    "p1_tallies": """WITH d AS (SELECT coalesce(id, 'row ' || row_id) AS k, p0, p1, win, row_id FROM match_catalog WHERE win IN (0, 1) AND p0 IS NOT NULL AND p1 IS NOT NULL AND p0 <> p1),
      m AS (SELECT arg_min(struct_pack(a := p0, b := p1, win := win), row_id) AS x FROM d GROUP BY k), e AS (SELECT x.a AS name, x.win = 0 AS w FROM m UNION ALL SELECT x.b, x.win = 1 FROM m),
      t AS (SELECT name, count(*) AS matches, count(*) FILTER (w) AS won FROM e GROUP BY 1)
      SELECT name, coalesce(matches, 0) AS matches, coalesce(won, 0) AS won FROM (SELECT p0 AS name FROM match_catalog UNION SELECT p1 FROM match_catalog) LEFT JOIN t USING (name) WHERE name IS NOT NULL""",
    "p8_covered": "SELECT container, doc_id FROM documents, capacities WHERE text IS NOT NULL AND capacity_tokens > 0",
}
