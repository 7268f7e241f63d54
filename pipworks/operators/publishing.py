"""What is published of stored matches: the columnar catalog of a shard, its player filter, and what a reader makes of several listings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipworks.functions.query import FLAGS
from pipworks.operators.sketches import HASHES, LEAST_BITS, fnv1a

#: Dictionaries of a catalog and the columns coded by them, in the order in which a row fills them.
DICTIONARIES = {"players": ["p0", "p1"], "events": ["event"], "rounds": ["round"], "contributors": ["by"]}
#: Start values of the two hashes of a published filter (fixed values).
SEEDS = (0x811C9DC5, 0x811C9DC5 ^ 0x9E3779B9)
BITS_PER_ITEM = 10


def flags_of(games: Column, attachments: Column | None = None, links: Column | None = None, illegal: Column | None = None) -> Column:
    """All bits of a catalog row: from its games (kind, how, cube), attachments (kind, analysis), links and declared illegal plays. What is null or not given counts as empty."""
    some = lambda array, test: F.coalesce(F.exists(array, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
    filled = lambda array: F.coalesce(F.size(array) > 0, F.lit(False)) if array is not None else F.lit(False)
    tests = {
        "gammon": some(games, lambda g: g["kind"] != "single"), "cube": some(games, lambda g: g["cube"] > 1), "resign": some(games, lambda g: g["how"].isin("resign", "forfeit")),
        "analysis": some(attachments, lambda a: a["analysis"]) if attachments is not None else F.lit(False),
        "attachment": filled(attachments), "video": filled(links), "illegal": filled(illegal),
    }
    total = F.lit(0)
    for name, test in tests.items():
        total = total + F.when(test, FLAGS[name]).otherwise(0)
    return total


def catalog_order(rows: DataFrame) -> DataFrame:
    """`rows` (shard, id, date) with their place `n` in the catalog of their shard: newest first, undated last, then by id. A shard is a bounded unit of storage."""
    order = Window.partitionBy("shard").orderBy(F.nullif(F.col("date"), F.lit("")).desc_nulls_last(), "id")
    return rows.withColumn("n", F.row_number().over(order) - 1)


def dictionaries(ordered: DataFrame) -> DataFrame:
    """(shard, dictionary, value, code): distinct values of each dictionary, numbered as the rows in order bring them. Null and empty values have no code."""
    cells = [(F.lit(d), F.col("n") * 2 + k, F.col(c)) for d, columns in DICTIONARIES.items() for k, c in enumerate(columns)]
    each = F.explode(F.array(*[F.struct(d.alias("dictionary"), place.alias("place"), value.alias("value")) for d, place, value in cells])).alias("c")
    first = ordered.select("shard", each).select("shard", "c.*").filter("value is not null and value <> ''").groupBy("shard", "dictionary", "value").agg(F.min("place").alias("place"))
    code = F.row_number().over(Window.partitionBy("shard", "dictionary").orderBy("place")) - 1
    return first.select("shard", "dictionary", "value", code.alias("code"))


def encoded_rows(ordered: DataFrame, codes: DataFrame) -> DataFrame:
    """`ordered` with every dictionary column as its code, -1 where it has none."""
    out = ordered
    for dictionary, columns in DICTIONARIES.items():
        for column in columns:
            of = codes.filter(F.col("dictionary") == dictionary).select("shard", F.col("value").alias(column), F.col("code").alias(f"{column}_code"))
            out = out.join(of, ["shard", column], "left")
    named = {c: F.coalesce(f"{c}_code", F.lit(-1)).alias(c) for columns in DICTIONARIES.values() for c in columns}
    return out.select(*[named.get(c, F.col(c)) for c in ordered.columns])


def decoded_rows(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """The rows of a columnar catalog with names in place of codes; null where the code is -1 or unknown."""
    out = rows
    for dictionary, columns in DICTIONARIES.items():
        for column in columns:
            of = codes.filter(F.col("dictionary") == dictionary).select("shard", F.col("code").alias(column), F.col("value").alias(f"{column}_value"))
            out = out.join(of, ["shard", column], "left")
    named = {c: F.col(f"{c}_value").alias(c) for columns in DICTIONARIES.values() for c in columns}
    return out.select(*[named.get(c, F.col(c)) for c in rows.columns])


def first_listings(rows: DataFrame, source: str, shard: str) -> DataFrame:
    """The rows that count where several sources, in the order of `source`, list the same shards: those of the first source that lists a shard."""
    first = rows.groupBy(shard).agg(F.min(source).alias("_first"))
    return rows.join(first, shard).filter(F.col(source) == F.col("_first")).drop("_first")


def filter_positions(names: DataFrame, shard: str = "shard", name: str = "name") -> DataFrame:
    """(shard, bits, position): the bits that are set in the published filter of each shard's distinct names. Any reader that hashes UTF-16 code units in this way can test names against it."""
    items = names.filter(F.col(name).isNotNull()).select(shard, name).distinct()
    size = F.greatest(F.lit(LEAST_BITS), F.ceil(F.count(F.lit(1)) * BITS_PER_ITEM / 8) * 8).cast("long")
    sizes = items.groupBy(shard).agg(size.alias("bits"))

    @F.pandas_udf("array<long>")
    def hashes(text: pd.Series) -> pd.Series:
        units = [memoryview(t.encode("utf-16-le", "surrogatepass")).cast("H") for t in text]
        return pd.Series([[fnv1a(u, seed) for seed in SEEDS] for u in units])

    hashed = items.withColumn("h", hashes(name)).join(sizes, shard)
    step = F.col("h")[1].bitwiseOR(F.lit(1))
    at = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.pmod(F.pmod(F.col("h")[0] + i * step, F.lit(1 << 32)), F.col("bits")))
    return hashed.select(shard, "bits", F.explode(at).alias("position")).distinct()
