"""Loading tab-separated sheets while setting aside the lines that cannot be accepted.

Every physical line is one candidate row. Lines come in as strings with an id; one pass over Arrow batches returns each
data line once, either with its cells or with the first reason for refusal:

`quoting`  a cell begins with a double quote that is not closed, or text follows the closing quote;
`columns`  the number of cells is not that of the header;
`action`, `date`, `round`  the cell does not hold what its column allows.

Cells are split by the CSV reader of pyarrow, whose callback for invalid rows reports wrong cell counts; values are then
checked column by column on the string vectors. Nothing is shuffled and no line depends on another.

Defined cases: a null line, and one of blanks and tabs only, is no row and yields nothing; header lines (line_no 1)
yield nothing; one carriage return at the end is dropped; empty cells come back as null; an empty table gives an empty
result; further input columns are ignored; the same line twice gives two rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHEET_COLUMNS = ["status", "action", "group", "file", "players", "length", "date", "time", "event", "round", "from", "note"]
MAX_ROUND = 120
ACCEPTED_ACTIONS = ["", "reject"]

# One cell: quoted, with doubled quotes inside, or plain, not beginning with a quote.
_CELL = '(?:"(?:[^"]|"")*"|[^"\t][^\t]*)?'
_WELL_QUOTED = f"^{_CELL}(?:\t{_CELL})*$"
# White space as in the ECMAScript class \s, without the line ends' special role.
_SPACE = "[\\x{0009}-\\x{000D}\\x{0020}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
# Line ends inside a line are carried through the CSV reader as private-use characters that the lines do not have.
_HIDDEN = "\r\n"
_DATE = "^[0-9]{4}(?:-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12][0-9]|3[01]))?)?$"
_MONTH_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])

OUT_SCHEMA = ", ".join(["line_id long", "sheet string", "line_no int", "reason string", *(f"`{c}` string" for c in SHEET_COLUMNS)])


def _hiding(lines: pa.Array) -> list[tuple[str, str]]:
    """A private-use character for each line end; none that occurs in `lines`."""
    free = (c for c in map(chr, range(0xE000, 0xF900)) if not pc.any(pc.match_substring(lines, c)).as_py())
    return [(end, next(free)) for end in _HIDDEN]


def _split(lines: pa.Array) -> tuple[list[pa.Array], np.ndarray, list[int]]:
    """Cells of well-quoted lines by column, the positions of the lines they belong to, and those of lines with a wrong number of cells."""
    wrong: list[int] = []

    def invalid(row: pacsv.InvalidRow) -> str:
        wrong.append(int(row.text.split("\t", 1)[0]))
        return "skip"

    hiding = _hiding(lines)
    for plain, hidden in hiding:
        lines = pc.replace_substring(lines, plain, hidden)
    numbered = pc.binary_join_element_wise(pc.cast(pa.array(np.arange(len(lines))), pa.string()), lines, "\t")
    text = "\n".join(numbered.to_pylist()).encode()
    names = ["#", *SHEET_COLUMNS]
    table = pacsv.read_csv(
        io.BytesIO(text + b"\n"),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(text) + 2),
        parse_options=pacsv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    ).combine_chunks()
    cells = []
    for name in names[1:]:
        col = table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
        for plain, hidden in hiding:
            col = pc.replace_substring(col, hidden, plain)
        cells.append(col)
    return cells, np.array(table["#"].to_pylist(), dtype=np.int64), wrong


def _bad_action(cell: pa.Array) -> np.ndarray:
    value = pc.utf8_lower(pc.utf8_trim(cell, characters=" \t"))
    return ~pc.is_in(value, pa.array(ACCEPTED_ACTIONS)).to_numpy(zero_copy_only=False)


def _bad_date(cell: pa.Array) -> np.ndarray:
    value = pc.utf8_trim(cell, characters=" \t")
    empty = pc.equal(pc.utf8_length(value), 0).to_numpy(zero_copy_only=False)
    shaped = pc.match_substring_regex(value, _DATE).to_numpy(zero_copy_only=False)
    whole = shaped & pc.equal(pc.utf8_length(value), 10).to_numpy(zero_copy_only=False)
    bad = ~empty & ~shaped
    if whole.any():
        picked = value.filter(pa.array(whole))
        year, month, day = (pc.cast(pc.utf8_slice_codeunits(picked, a, b), pa.int32()).to_numpy(zero_copy_only=False) for a, b in ((0, 4), (5, 7), (8, 10)))
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        bad[whole] = day > _MONTH_DAYS[month] + (leap & (month == 2))
    return bad


def _bad_round(cell: pa.Array) -> np.ndarray:
    value = pc.utf8_trim(pc.replace_substring_regex(cell, f"{_SPACE}+", " "), characters=" ")
    too_long = pc.greater(pc.utf8_length(value), MAX_ROUND)
    control = pc.match_substring_regex(value, "[\\x{0000}-\\x{001F}]")
    return pc.or_(too_long, control).to_numpy(zero_copy_only=False)


def load_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The data lines of a batch with columns line_id, sheet, line_no, raw, in the order of OUT_SCHEMA."""
    table = pa.table({n: batch.column(batch.schema.get_field_index(n)) for n in ("line_id", "sheet", "line_no", "raw")})
    raw = pc.replace_substring_regex(pc.cast(table["raw"], pa.string()), "\r$", "").combine_chunks()
    data = pc.and_kleene(pc.invert(pc.match_substring_regex(raw, "^[ \t]*$")), pc.not_equal(pc.fill_null(table["line_no"], 0), 1))
    keep = pc.fill_null(data, False).combine_chunks() if isinstance(data, pa.ChunkedArray) else pc.fill_null(data, False)
    table, raw = table.filter(keep), raw.filter(keep)
    n = len(raw)
    reason = np.full(n, None, dtype=object)
    cells: list[np.ndarray] = [np.full(n, None, dtype=object) for _ in SHEET_COLUMNS]
    if n:
        quoted = pc.match_substring_regex(raw, _WELL_QUOTED).to_numpy(zero_copy_only=False)
        reason[~quoted] = "quoting"
        at = np.flatnonzero(quoted)
        if len(at):
            split, got, wrong = _split(raw.take(pa.array(at)))
            rows = at[got]
            reason[at[wrong]] = "columns"
            verdict = np.full(len(rows), None, dtype=object)
            for name, bad in (("round", _bad_round), ("date", _bad_date), ("action", _bad_action)):  # the first reason is set last
                if len(rows):
                    verdict[bad(split[SHEET_COLUMNS.index(name)])] = name
            reason[rows] = verdict
            for target, source in zip(cells, split, strict=True):
                values = source.to_numpy(zero_copy_only=False).astype(object)
                values[values == ""] = None
                target[rows] = values
    return pa.RecordBatch.from_arrays(
        [pc.cast(table["line_id"], pa.int64()).combine_chunks(), pc.cast(table["sheet"], pa.string()).combine_chunks(), pc.cast(table["line_no"], pa.int32()).combine_chunks(), pa.array(reason, pa.string()), *(pa.array(c, pa.string()) for c in cells)],
        names=["line_id", "sheet", "line_no", "reason", *SHEET_COLUMNS],
    )


def load_lines(lines: DataFrame) -> DataFrame:
    """Each data line of `lines` (line_id, sheet, line_no, raw) once: its cells and, if it is refused, the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield load_batch(batch)

    return lines.select("line_id", "sheet", F.col("line_no").cast("int").alias("line_no"), "raw").mapInArrow(run, OUT_SCHEMA)


def _clean(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def accepted(loaded: DataFrame) -> DataFrame:
    """The valid rows with typed columns: lower-case action, numbers as integers (null where they are none), one blank for runs of white space in the round."""
    return loaded.filter(F.col("reason").isNull()).select(
        "line_id", "sheet", "line_no", "status", F.lower(_clean("action")).alias("action"), F.col("group").try_cast("int").alias("group_no"), "file", "players",
        F.col("length").try_cast("int").alias("length"), _clean("date").alias("date"), "time", "event", F.nullif(F.trim(F.regexp_replace("round", "(?U)\\s+", " ")), F.lit("")).alias("round"), F.col("from").alias("from_src"), "note",
    )


def refused(loaded: DataFrame) -> DataFrame:
    """line_id and reason of every refused line."""
    return loaded.filter(F.col("reason").isNotNull()).select("line_id", "reason")
