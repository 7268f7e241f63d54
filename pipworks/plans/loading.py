"""Queries for loading sheets with rejects and for consolidating small files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.operators.compaction import CompactionStore, listing_issues, stored_files
from pipworks.sources.reject_loader import MAX_ROUND, accepted, load_lines, refused
from pipworks.sources.tables import table
from pipworks.storage import shared_root


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """line_id and reason of every line of sheet_lines that is refused.

    Broken quoting is told by a pattern over the whole vector before the CSV reader, which accepts it silently; wrong cell counts come from the reader's callback, the other reasons from the cells.
    """
    return refused(load_lines(table(spark, folder, "sheet_lines")))


def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The accepted lines of sheet_lines as a table."""
    return accepted(load_lines(table(spark, folder, "sheet_lines")))


def _store(spark: SparkSession, folder: str) -> CompactionStore:
    store = CompactionStore(spark, f"{shared_root(spark)}/pipworks/compacted-{uuid.uuid4().hex[:12]}")
    store.compact(stored_files(table(spark, folder, "match_files")))
    return store


def p6_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored file, read back from the containers that hold it."""
    return _store(spark, folder).files().select("path", "file_no", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """What the containers made of match_files hold together: files, bytes, and how many are above the target size."""
    store = _store(spark, folder)
    return store.containers().agg(F.sum("files").alias("files"), F.sum("bytes").cast("long").alias("bytes"), F.count_if(F.col("bytes") > store.target).alias("above_target"))


def p6_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Where match_paths and match_files disagree."""
    return listing_issues(table(spark, folder, "match_paths"), table(spark, folder, "match_files"))


QUERIES = {f.__name__: f for f in (p4_found, p4_rows, p6_compacted, p6_containers, p6_issues)}

_CELLS = r"""
WITH lines AS (
  SELECT line_id, sheet, line_no, regexp_replace(raw, '\r$', '') AS raw FROM sheet_lines
  WHERE line_no <> 1 AND NOT regexp_full_match(regexp_replace(raw, '\r$', ''), '[ \t]*')),
split AS (
  SELECT *, regexp_full_match(raw, '(?s)(?:"(?:[^"]|"")*"|[^"\t][^\t]*)?(?:\t(?:"(?:[^"]|"")*"|[^"\t][^\t]*)?)*') AS quoted,
    regexp_extract_all(chr(9) || raw, '\t("(?:[^"]|"")*"|[^\t]*)', 1) AS cells FROM lines),
plain AS (
  SELECT *, list_transform(cells, lambda c: CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, len(c) - 2), '""', '"') ELSE c END) AS v FROM split),
shaped AS (SELECT *, trim(v[7], ' ' || chr(9)) AS d, trim(regexp_replace(v[10], '[\x{0009}-\x{000D}\x{0020}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS r FROM plain),
judged AS (
  SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(v) <> 12 THEN 'columns'
    WHEN lower(trim(v[2], ' ' || chr(9))) NOT IN ('', 'reject') THEN 'action'
    WHEN d <> '' AND NOT coalesce(CASE length(d) WHEN 4 THEN regexp_full_match(d, '[0-9]{4}') WHEN 7 THEN regexp_full_match(d, '[0-9]{4}-(0[1-9]|1[0-2])') WHEN 10 THEN regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(d AS DATE) IS NOT NULL END, false) THEN 'date'
    WHEN length(r) > MAXROUND OR regexp_matches(r, '[\x00-\x1f]') THEN 'round' END AS reason FROM shaped)
""".replace("MAXROUND", str(MAX_ROUND))

_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(replace(P, '\', '/'), '^(\.?/)+', ''), '/(\.?/)+', '/', 'g'), '/\.?$', '')"


def _plain(column: str) -> str:
    return _PLAIN.replace("P", column)


ORACLE = {
    "p4_found": _CELLS + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_rows": _CELLS
    + """SELECT line_id, sheet, line_no, nullif(v[1], '') AS status, nullif(lower(trim(v[2])), '') AS action, try_cast(nullif(v[3], '') AS INT) AS group_no, nullif(v[4], '') AS file, nullif(v[5], '') AS players,
      try_cast(nullif(v[6], '') AS INT) AS length, nullif(trim(v[7]), '') AS date, nullif(v[8], '') AS time, nullif(v[9], '') AS event, nullif(r, '') AS round, nullif(v[11], '') AS from_src, nullif(v[12], '') AS note
      FROM judged WHERE reason IS NULL""",
    "p6_compacted": f"""SELECT path, file_no, bytes, sha256 FROM (
      SELECT {_plain("path")} AS path, file_no, strlen(coalesce(content, '')) AS bytes, sha256(coalesce(content, '')) AS sha256,
        row_number() OVER (PARTITION BY {_plain("path")} ORDER BY modified_at DESC NULLS LAST, file_no DESC) AS rn FROM match_files WHERE path IS NOT NULL) WHERE rn = 1""",
    "p6_containers": f"""SELECT cast(count(*) AS BIGINT) AS files, cast(sum(bytes) AS BIGINT) AS bytes, cast(0 AS BIGINT) AS above_target FROM (SELECT path, file_no, bytes, sha256 FROM (
      SELECT {_plain("path")} AS path, file_no, strlen(coalesce(content, '')) AS bytes, sha256(coalesce(content, '')) AS sha256,
        row_number() OVER (PARTITION BY {_plain("path")} ORDER BY modified_at DESC NULLS LAST, file_no DESC) AS rn FROM match_files WHERE path IS NOT NULL) WHERE rn = 1)""",
    "p6_issues": f"""WITH listed AS (SELECT {_plain("path")} AS path, count(*) AS n FROM (SELECT mat AS path FROM match_paths UNION ALL SELECT meta FROM match_paths) WHERE path IS NOT NULL GROUP BY 1),
      seen AS (SELECT {_plain("path")} AS path, count(*) AS m, max(strlen(coalesce(content, ''))) AS b FROM match_files WHERE path IS NOT NULL GROUP BY 1),
      pair AS (SELECT coalesce(l.path, s.path) AS path, n, m, b FROM listed l FULL JOIN seen s ON l.path = s.path)
      SELECT 'missing' AS kind, path FROM pair WHERE m IS NULL UNION ALL SELECT 'unlisted', path FROM pair WHERE n IS NULL UNION ALL SELECT 'listed_twice', path FROM pair WHERE n > 1
      UNION ALL SELECT 'seen_twice', path FROM pair WHERE m > 1 UNION ALL SELECT 'empty', path FROM pair WHERE b = 0""",
}
