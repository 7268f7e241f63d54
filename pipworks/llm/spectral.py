"""One ranking of all items from pairwise outcomes, by the leading singular plane of a skew-symmetric margin matrix.

Outcomes of a pair are added up (a third of all rows may be of one item, but a pair is one row), weighted by the square
root of the match length. With a for the weight won and b for the weight lost, the margin of a pair is (a - b) / sqrt(a + b), normalised by
the regularised degrees of both items: x = margin / sqrt((d_i + t)(d_j + t)), t half the mean degree, which keeps items
with one comparison from forming singular vectors of their own. For a ranking by strengths r, the margins r_i - r_j span
the plane of r and the constant vector; Lanczos steps on the skew-symmetric matrix find that plane. Of the directions in
it the one is taken that agrees with the most outcome weight, found by sweeping a histogram of angles.

A Lanczos step is one join of the edges with a vector and one aggregation. Edges are stored once, bucketed by the item
whose value they need; items with many edges are spread over salted copies. The vectors stay distributed: the driver
holds the tridiagonal coefficients, a matrix of at most MOST_STEPS x MOST_STEPS and the histogram. Steps end when the
residual of the plane is below TOLERANCE, which takes some more of them on larger graphs.

Defined cases: rows with a null name, the same name on both sides, or win other than 0 or 1 are no outcomes; an id that
was delivered again counts once; unknown or zero lengths weigh as one; names without any outcome are ranked with strength
0; equal strengths are ordered by name; an empty table gives an empty ranking.
"""

from __future__ import annotations

import math
import uuid
import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.operators.ranking import global_rank
from pipworks.storage import Scratch

#: Share of the leading singular value that the residual of the plane may have, and steps after which a warning says that it is not.
TOLERANCE = 1e-3
MOST_STEPS = 80
#: Degree regularisation, in mean degrees.
REGULAR = 0.5
#: Edges of one item from which on they are spread over further salts.
HUB_EDGES = 20_000
ANGLES = 1440
#: Entries of the margin matrix in a bucket.
PER_BUCKET = 250_000


def outcomes(catalog: DataFrame) -> DataFrame:
    """(winner, loser, weight) of every decided match, each id once."""
    decided = catalog.filter("win in (0, 1) and p0 is not null and p1 is not null and p0 <> p1")
    key = F.coalesce("id", F.concat(F.lit("row "), F.col("row_id").cast("string")))
    once = decided.groupBy(key.alias("id")).agg(F.min_by(F.struct("p0", "p1", "win", "len"), "row_id").alias("m")).select("m.*")
    first = F.col("win") == 0
    weight = F.sqrt(F.greatest(F.coalesce("len", F.lit(1)), F.lit(1)).cast("double"))
    return once.select(F.when(first, F.col("p0")).otherwise(F.col("p1")).alias("winner"), F.when(first, F.col("p1")).otherwise(F.col("p0")).alias("loser"), weight.alias("weight"))


def tridiagonal(beta: list[float]) -> np.ndarray:
    """The skew-symmetric matrix of the Lanczos coefficients."""
    t = np.zeros((len(beta) + 1, len(beta) + 1))
    for i, b in enumerate(beta):
        t[i + 1, i], t[i, i + 1] = b, -b
    return t


def residual(beta: list[float], following: float) -> float:
    """How far the leading plane of the coefficients so far is from one of the whole matrix, in parts of its singular value; `following` is the next coefficient."""
    if len(beta) < 2:
        return math.inf
    vectors, values, _ = np.linalg.svd(tridiagonal(beta))
    return following * float(np.abs(vectors[-1, :2]).max()) / float(values[0])


def best_angle(histogram: dict[int, tuple[float, float]]) -> tuple[float, float]:
    """The direction, as an angle, that agrees with the most weight, and that weight. `histogram`: by bin of the angle of the winner's lead, weight of outcomes for it and against it."""
    weight = np.zeros(ANGLES)
    for k, (agree, against) in histogram.items():
        weight[k % ANGLES] += agree
        weight[(k + ANGLES // 2) % ANGLES] += against
    half = ANGLES // 2
    ring = np.concatenate([weight, weight, weight])
    total = np.concatenate([[0.0], np.cumsum(ring)])
    start = ANGLES + np.arange(ANGLES) - half // 2
    sums = total[start + half] - total[start]
    # equally good directions lie side by side: take the middle of their run
    top = np.flatnonzero(sums >= sums.max() - 1e-9)
    k = top[len(top) // 2]
    return 2 * math.pi * k / ANGLES, float(sums.max())


def ranking(spark: SparkSession, catalog: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(name, rank, strength, matches, won) of all names in p0 and p1. Strengths have mean 0 and deviation 1 over names with outcomes; larger is stronger."""
    scratch = Scratch(spark, "spectral")
    result = outcomes(catalog)
    pair = result.groupBy(F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")).agg(
        F.sum(F.when(F.col("winner") < F.col("loser"), F.col("weight")).otherwise(0.0)).alias("wa"), F.sum(F.when(F.col("winner") > F.col("loser"), F.col("weight")).otherwise(0.0)).alias("wb"),
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("winner") < F.col("loser"), 1).otherwise(0)).alias("na"),
    )
    pairs = scratch.save(pair, "pairs")
    ends = F.array(F.struct(F.col("a").alias("name"), F.col("na").alias("won")), F.struct(F.col("b").alias("name"), (F.col("n") - F.col("na")).alias("won")))
    per_name = pairs.select(F.explode(ends).alias("e"), "n", F.sqrt(F.col("wa") + F.col("wb")).alias("d")).groupBy("e.name").agg(F.sum("d").alias("degree"), F.count(F.lit(1)).alias("edges"), F.sum("n").alias("matches"), F.sum("e.won").alias("won"))
    nodes = scratch.save(per_name.select(F.monotonically_increasing_id().alias("i"), "*", F.ceil(F.col("edges") / HUB_EDGES).cast("int").alias("salts")), "nodes")
    mean = nodes.agg(F.avg("degree")).first()[0]
    names = catalog.select(F.explode(F.array("p0", "p1")).alias("name")).filter("name is not null").distinct()
    if mean is None:
        return global_rank(spark, names.select("name", F.lit(0.0).alias("strength"), F.lit(0).cast("long").alias("matches"), F.lit(0).cast("long").alias("won")), [F.col("name")])
    scale = 1 / F.sqrt(F.col("degree") + REGULAR * mean)

    end = lambda name: nodes.select(F.col("name").alias(name), F.col("i").alias(f"i{name}"), scale.alias(f"s{name}"), F.col("salts").alias(f"salts{name}"))
    numbered = scratch.save(pairs.join(end("a"), "a").join(end("b"), "b").select("ia", "ib", "sa", "sb", "saltsa", "saltsb", "wa", "wb"), "numbered")
    x = (F.col("wa") - F.col("wb")) / F.sqrt(F.col("wa") + F.col("wb")) * F.col("sa") * F.col("sb")
    both = F.array(F.struct(F.col("ia").alias("i"), F.col("ib").alias("j"), x.alias("x"), F.col("saltsb").alias("salts")), F.struct(F.col("ib").alias("i"), F.col("ia").alias("j"), (-x).alias("x"), F.col("saltsa").alias("salts")))
    edges = numbered.select(F.explode(both).alias("e")).select("e.i", "e.j", "e.x", F.pmod(F.xxhash64("e.i"), F.col("e.salts")).cast("int").alias("salt")).filter("x <> 0")
    table = f"margins_{uuid.uuid4().hex[:12]}"
    buckets = max(12, -(-2 * numbered.count() // PER_BUCKET))
    edges.repartition(buckets, "j", "salt").write.bucketBy(buckets, "j", "salt").option("path", scratch.path("margins")).saveAsTable(table)
    edges = spark.table(table)

    # The start vector is the image of the constant; the first step then yields the margins won.
    norm = math.sqrt(nodes.agg(F.sum(F.col("degree") + REGULAR * mean)).first()[0])
    basis = nodes.select("i", "salts", (1 / scale / norm).alias("v0"))
    beta: list[float] = []
    for k in range(1, MOST_STEPS + 1):
        spread = basis.select(F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col(f"v{k - 1}").alias("v"))
        image = edges.join(spread, ["j", "salt"]).groupBy("i").agg(F.sum(F.col("x") * F.col("v")).alias("y"))
        back = F.lit(beta[-1]) * F.col(f"v{k - 2}") if k > 1 else F.lit(0.0)
        step = scratch.save(basis.join(image, "i", "left").select(*basis.columns, (F.coalesce("y", F.lit(0.0)) + back).alias("z")), f"step{k}")
        b = math.sqrt(step.agg(F.sum(F.col("z") * F.col("z"))).first()[0] or 0.0)
        if b < 1e-9 or residual(beta, b) <= tolerance:  # the plane is exhausted, or known well enough
            break
        beta.append(b)
        if k > 1:
            scratch.drop(f"step{k - 1}")
        basis = step.withColumn(f"v{k}", F.col("z") / b).drop("z")
    else:
        warnings.warn(f"the leading plane is not known to {tolerance} after {MOST_STEPS} steps", stacklevel=2)
    plane = np.linalg.svd(tridiagonal(beta))[0][:, :2] if beta else np.array([[1.0, 0.0]])
    mixed = [sum((F.col(f"v{k}") * float(plane[k, c]) for k in range(len(plane))), F.lit(0.0)) for c in (0, 1)]
    place = scratch.save(basis.select("i", mixed[0].alias("x0"), mixed[1].alias("y0")).join(nodes, "i").select("i", "name", "matches", "won", (F.col("x0") * scale).alias("x"), (F.col("y0") * scale).alias("y")), "plane")

    at = lambda s: place.select(F.col("i").alias(f"i{s}"), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    lead = numbered.select("ia", "ib", "wa", "wb").join(at("a"), "ia").join(at("b"), "ib").select(F.atan2(F.col("ya") - F.col("yb"), F.col("xa") - F.col("xb")).alias("phi"), "wa", "wb")
    sector = F.pmod(F.floor(F.col("phi") / (2 * math.pi / ANGLES)), F.lit(ANGLES)).cast("int")
    histogram = {r["k"]: (r["a"], r["b"]) for r in lead.groupBy(sector.alias("k")).agg(F.sum("wa").alias("a"), F.sum("wb").alias("b")).collect()}
    angle, _ = best_angle(histogram)
    raw = place.select("name", "matches", "won", (F.col("x") * math.cos(angle) + F.col("y") * math.sin(angle)).alias("raw"))
    centre = raw.agg(F.avg("raw"), F.stddev_pop("raw")).first()
    strength = (F.col("raw") - (centre[0] or 0.0)) / (centre[1] or 1.0)
    scored = names.join(raw, "name", "left").select("name", F.coalesce(strength, F.lit(0.0)).alias("strength"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("won", F.lit(0)).alias("won"))
    ranked = global_rank(spark, scored, [F.col("strength").desc(), F.col("name")])
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    return ranked
