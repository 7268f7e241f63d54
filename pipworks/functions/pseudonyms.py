"""Names replaced by keyed pseudonyms: an adjective, an animal and four hexadecimal digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipworks.functions.text import hmac_sha256, normalise

# The words of pseudonyms, in order.
ADJECTIVES = (
    "amber azure bold brave brisk calm clever cosmic crimson curious daring dusty eager early fancy gentle gilded glad golden grand happy hardy hidden humble icy jolly keen kind lively lucky lunar mellow "
    "merry misty modest nimble noble olive patient plucky polar proud quick quiet rapid rosy royal rustic sandy silent silver sly snowy solar steady stormy sunny swift tidy vivid wild witty zesty velvet"
).split()
ANIMALS = (
    "badger bear beaver bison boar camel cobra cougar coyote crab deer dingo dolphin donkey eel elk ferret fox gecko gibbon goat gopher hare hippo horse hyena ibex iguana impala jackal jaguar koala "
    "lemur leopard lion llama lynx marmot mink mole moose newt ocelot okapi orca otter panda panther puma rabbit raccoon seal shark skunk sloth tapir tiger toad turtle walrus weasel whale wolf zebra"
).split()


def is_pseudonym(name: Column) -> Column:
    words = F.split(F.regexp_replace(name, "^anon-", ""), "-")
    known = lambda at, words_: F.element_at(words, at).isin(words_)
    return F.coalesce(name.rlike("^(?:anon-)?[a-z]+-[a-z]+-[0-9a-f]{4}$") & known(1, ADJECTIVES) & known(2, ANIMALS), F.lit(False))


def pseudonym(name: Column, key: bytes, domain: str) -> Column:
    """The pseudonym of a name under a key; tools that put the same `domain` before a name give the same one; one name in all its ways of writing gets one pseudonym, and pseudonyms, null and empty names stay."""
    digest = hmac_sha256(key, F.concat(F.lit(domain), normalise(name)))
    byte = lambda k: F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")
    word = lambda words, k: F.element_at(F.array(*map(F.lit, words)), byte(k).bitwiseAND(63) + 1)
    made = F.concat_ws("-", word(ADJECTIVES, 0), word(ANIMALS, 1), F.substring(digest, 5, 4))
    return F.when(name.isNull() | (name == "") | is_pseudonym(name), name).otherwise(made)


def hide_names(matches: DataFrame, key: bytes, names: list[str], drop: list[str], domain: str) -> DataFrame:
    """`matches` with the columns `names` replaced and the columns `drop`, which point to the people or the place, cleared. Distinct names are mapped once and joined back."""
    out = matches
    for column in names:
        mapped = matches.select(F.col(column).alias("_name")).distinct().withColumn("_new", pseudonym(F.col("_name"), key, domain))
        out = out.join(mapped, out[column].eqNullSafe(mapped["_name"]), "left").drop("_name").withColumn(column, F.col("_new")).drop("_new")
    return out.withColumns({c: F.lit(None).cast(matches.schema[c].dataType) for c in drop})
