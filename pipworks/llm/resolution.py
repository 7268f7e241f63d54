"""Which spellings stand for one player or event, by merging and matching again.

Distinct strings are reduced to forms (`name_forms`); equal forms are one profile. In every round profiles meet under
blocking keys, matches are checked, and the connected profiles are merged: the merged profile has the spellings, given
names and surnames of all its members, so it can match what none of them matched alone. Merged profiles enter the next
round, together with the profiles that are known only in part (an initial, a nickname of several names, an abbreviated
place). Those are merged only into the one better known profile that they fit; once spellings of an entity have been merged, what had
seemed ambiguous often is no more. Rounds end when nothing merges.

Only distinct strings and forms are shuffled; profiles are written to the shared folder after every round.

Defined cases: null and blank strings, and placeholders of events, belong to no entity; a string that occurs in several
columns counts once; equal strings are never a pair; an empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.llm.mojibake import restored_values
from pipworks.llm.name_forms import event_form, player_form, profile_keys, same_profile, vagueness
from pipworks.operators.components import components
from pipworks.storage import Scratch, spread

#: More rounds than chains of partly known names need; not settling by then is an error.
MAX_ROUNDS = 60


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        forms = [(player_form if kind == "player" else event_form)(text) for kind, text in zip(b["kind"], b["text"], strict=True)]
        yield pd.DataFrame({"kind": b["kind"], "name": b["name"], "form": forms})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys = [profile_keys(list(f)) for f in b["forms"]]
        vague = [min(map(vagueness, f)) for f in b["forms"]]
        yield pd.DataFrame({"profile": b["profile"], "changed": b["changed"], "vague": vague, "keys": keys})


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        holds, sure = [], []
        for x, y, vx, vy in zip(b["forms_a"], b["forms_b"], b["vague_a"], b["vague_b"], strict=True):
            # where a profile has full given names, members known only in part say nothing for it but their surnames
            same = same_profile(list(x), vx, list(y), vy)
            # two that may stand for the same several given names are alike in what they leave open
            open_alike = [next(f for f in fs if vagueness(f) == least).split("|")[1] for fs, least in ((x, vx), (y, vy))]
            holds.append(same)
            sure.append(same and vx == vy and (vx == 0 or vx == 1 and open_alike[0] == open_alike[1]))
        yield b.assign(sure=sure).loc[holds, ["a", "b", "vague_a", "vague_b", "sure"]]


def merge_and_rematch(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(form, profile) of distinct `forms` (form)."""
    scratch = Scratch(spark, "resolution")
    member = forms.select("form", F.col("form").alias("profile"))
    state = forms.select(F.col("form").alias("profile"), F.array("form").alias("forms"), F.lit(True).alias("changed"))
    for k in range(MAX_ROUNDS):
        state = scratch.save(state, f"state{k}")
        keyed = scratch.save(state.mapInPandas(_keys, "profile string, changed boolean, vague int, keys array<long>"), f"keys{k}")
        flat = keyed.select("profile", "vague", "changed", F.explode("keys").alias("key"))
        left = flat.filter("changed or vague > 0").select("key", F.col("profile").alias("p"), F.col("vague").alias("vp"))
        right = flat.select("key", F.col("profile").alias("q"), F.col("vague").alias("vq"))
        met = left.join(right, "key").filter("p <> q")
        first = F.col("p") < F.col("q")
        pairs = met.select(F.when(first, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("b"), F.when(first, F.col("vp")).otherwise(F.col("vq")).alias("vague_a"), F.when(first, F.col("vq")).otherwise(F.col("vp")).alias("vague_b")).distinct()
        side = lambda s: state.select(F.col("profile").alias(s), F.col("forms").alias(f"forms_{s}"))
        matches = scratch.save(spread(pairs.join(side("a"), "a").join(side("b"), "b")).mapInPandas(_check, "a string, b string, vague_a int, vague_b int, sure boolean"), f"matches{k}")
        strong = matches.filter("sure").select("a", "b")
        part = matches.filter("vague_a <> vague_b").select(F.when(F.expr("vague_a > vague_b"), F.col("a")).otherwise(F.col("b")).alias("part"), F.when(F.expr("vague_a > vague_b"), F.col("b")).otherwise(F.col("a")).alias("whole"))
        # only where nothing else merges any more are the ambiguous ones known to be so
        fits = part.groupBy("part").agg(F.count_distinct("whole").alias("n"), F.min("whole").alias("whole")).filter("n = 1").select(F.col("part").alias("a"), F.col("whole").alias("b"))
        links = strong if not strong.isEmpty() else fits
        links = scratch.save(links, f"links{k}")
        if links.isEmpty():
            return member
        root = components(spark, links)
        step = root.select(F.col("node").alias("profile"), "root")
        member = scratch.save(member.join(step, "profile", "left").select("form", F.coalesce("root", "profile").alias("profile")), f"member{k}")
        merged = state.join(step, "profile", "left").select(F.coalesce("root", "profile").alias("profile"), F.explode("forms").alias("form"), F.col("root").isNotNull().alias("moved"))
        state = merged.groupBy("profile").agg(F.array_sort(F.collect_set("form")).alias("forms"), F.max("moved").alias("changed"))
        for name in ("state", "keys", "matches", "links"):
            if k:
                scratch.drop(f"{name}{k - 1}")
    raise RuntimeError(f"names did not settle in {MAX_ROUNDS} rounds")


def name_groups(spark: SparkSession, names: DataFrame) -> DataFrame:
    """(kind, name, profile) of the distinct strings in `names` (kind: player or event, name, times) that belong to an entity."""
    scratch = Scratch(spark, "names")
    distinct = scratch.save(names.filter("name is not null").groupBy("kind", "name").agg(F.sum("times").alias("times")), "distinct")
    events = distinct.filter("kind = 'event'").select(F.col("name").alias("value"), "times")
    restored = restored_values(spark, events).filter("restored is not null").select(F.lit("event").alias("kind"), F.col("value").alias("name"), "restored")
    text = distinct.join(restored, ["kind", "name"], "left").select("kind", "name", F.coalesce("restored", "name").alias("text"))
    parsed = scratch.save(text.mapInPandas(_parse, "kind string, name string, form string").filter("form is not null"), "parsed")
    member = merge_and_rematch(spark, parsed.select("form").distinct())
    return parsed.join(member, "form").select("kind", "name", "profile")


def occurring_names(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """(kind, name, times): players of match_catalog and events of match_records."""
    players = catalog.select(F.explode(F.array("p0", "p1")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("times")).select(F.lit("player").alias("kind"), "name", "times")
    events = records.groupBy(F.col("event").alias("name")).agg(F.count(F.lit(1)).alias("times")).select(F.lit("event").alias("kind"), "name", "times")
    return players.unionByName(events)
