"""Ordered folds over the games of a match and over decisions, as windows and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least errors of the classes of a decision, in normalised equity, and the tolerance at a border (fixed values).
ERROR_CLASSES = [("blunder", 0.16), ("error", 0.08), ("inaccuracy", 0.04)]
TOLERANCE = 5e-7
#: Performance rating: thousandths of equity per decision, halved.
RATING_SCALE = 500.0


def games(records: DataFrame) -> DataFrame:
    """One row per game of match_records, in order."""
    return records.select("row_id", "match_length", F.posexplode("games").alias("at", "g")).select("row_id", "match_length", "at", "g.*")


def _match() -> Window:
    return Window.partitionBy("row_id").orderBy("at")


def running_score(records: DataFrame) -> DataFrame:
    """(row_id, at, s0, s1, after0, after1): the score before and after each game."""
    g = games(records)
    points = lambda side: F.when(F.col("winner") == side, F.coalesce("points", F.lit(0))).otherwise(0).cast("long")
    after = lambda side: F.sum(points(side)).over(_match())
    return g.select("row_id", "at", (after(0) - points(0)).alias("s0"), (after(1) - points(1)).alias("s1"), after(0).alias("after0"), after(1).alias("after1"))


def crawford_games(records: DataFrame) -> DataFrame:
    """(row_id, at) of the first game of a match to more than one point in which exactly one side needs one point."""
    score = running_score(records).join(records.select("row_id", "match_length"), "row_id")
    one = lambda s: F.col("match_length") - F.col(s) == 1
    candidate = score.filter((F.col("match_length") > 1) & (one("s0") != one("s1")))
    return candidate.groupBy("row_id").agg(F.min("at").alias("at"))


def score_gaps(records: DataFrame) -> DataFrame:
    """(row_id, at, step) where the number of a game does not follow that of the game before."""
    g = games(records).select("row_id", "at", "game_index", F.lag("game_index").over(_match()).alias("before"))
    return g.filter("before is not null and game_index <> before + 1").select("row_id", "at", (F.col("game_index") - F.col("before")).alias("step"))


def cube_carried(records: DataFrame) -> DataFrame:
    """(row_id, at, carried): the last cube above 1 seen so far, 1 before any."""
    turned = F.when(F.col("cube") > 1, F.col("cube"))
    return games(records).select("row_id", "at", F.coalesce(F.last(turned, ignorenulls=True).over(_match()), F.lit(1)).alias("carried"))


def streaks(records: DataFrame) -> DataFrame:
    """(row_id, side, longest): the longest run of games won by one side: gaps and islands over the order of games."""
    g = games(records).filter("winner is not null")
    island = F.row_number().over(_match()) - F.row_number().over(Window.partitionBy("row_id", "winner").orderBy("at"))
    runs = g.select("row_id", "winner", island.alias("island")).groupBy("row_id", "winner", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("row_id", F.col("winner").alias("side")).agg(F.max("n").alias("longest"))


def match_result(records: DataFrame) -> DataFrame:
    """(row_id, s0, s1, winner, finished): points of the sides; a side has won when it reached the length."""
    side = lambda s: F.sum(F.when(F.col("winner") == s, F.coalesce("points", F.lit(0))).otherwise(0)).cast("long")
    total = games(records).groupBy("row_id").agg(side(0).alias("s0"), side(1).alias("s1"), F.first("match_length").alias("length"))
    won = F.when((F.col("length") > 0) & (F.col("s0") >= F.col("length")), 0).when((F.col("length") > 0) & (F.col("s1") >= F.col("length")), 1)
    return total.select("row_id", "s0", "s1", won.alias("winner"), won.isNotNull().alias("finished"))


def points_differ(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, at): the first position at which the lists of points (`points`) of two sources differ, for keys in both that do."""
    pair = a.select(key, F.col("points").alias("x")).join(b.select(key, F.col("points").alias("y")), key)
    at = F.array_position(F.transform(F.arrays_zip("x", "y"), lambda z: z["x"].eqNullSafe(z["y"])), False) - 1
    return pair.select(key, at.alias("at")).filter("at >= 0")


def series(rows: DataFrame, group: list[str], time: str, key: str) -> DataFrame:
    """(key, number, of): match i of n within a group, where all members have a time and no two the same."""
    w = Window.partitionBy(*group)
    numbered = rows.select(key, F.row_number().over(w.orderBy(time, key)).alias("number"), F.count(F.lit(1)).over(w).alias("of"), F.count(time).over(w).alias("timed"), F.size(F.collect_set(time).over(w)).alias("distinct"))
    return numbered.filter("of > 1 and timed = of and distinct = of").select(key, "number", "of")


def error_class(error: Column) -> Column:
    out = F.lit("fine")
    for name, least in reversed(ERROR_CLASSES):
        out = F.when(error >= least - TOLERANCE, name).otherwise(out)
    return out


def rating(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Per group of decisions (error, counted): counted decisions; over all of them total error and classes;  and the rating, null without counted decisions."""
    cls = error_class(F.col("error"))
    classes = [F.count_if(cls == name).alias(name) for name, _ in ERROR_CLASSES]
    n = F.count_if("counted")
    return decisions.groupBy(*by).agg(n.alias("decisions"), F.sum("error").alias("total"), *classes, (RATING_SCALE * F.sum("error") / F.nullif(n, F.lit(0))).alias("rating"))
