"""Choices over lattices and groups of sites: near-cubic supercells, groups that sum to a target, groups that fit a template."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from mortise.operators.structures import least_cost


def lattice_vectors(cells: DataFrame) -> DataFrame:
    """key and m, the three lattice vectors of (key, a, b, c, alpha, beta, gamma): the first along x, the second in the plane of x and y."""
    ca, cb, cg, sg = (f(F.radians(n)) for f, n in ((F.cos, "alpha"), (F.cos, "beta"), (F.cos, "gamma"), (F.sin, "gamma")))
    y = (ca - cb * cg) / sg
    zero = F.lit(0.0)
    rows = F.array(F.array(F.col("a"), zero, zero), F.array(F.col("b") * cg, F.col("b") * sg, zero), F.array(F.col("c") * cb, F.col("c") * y, F.col("c") * F.sqrt(F.greatest(1 - cb * cb - y * y, zero))))
    return cells.select("key", rows.alias("m"))


def _dot(u: Column, v: Column) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def near_cubic(cells: DataFrame, most: int = 2, largest: int = 16, length_tolerance: float = 0.02, angle_tolerance: float = 1.0) -> DataFrame:
    """key, rows (three integer vectors), det, score, lengths, angles, within: for each cell the supercell nearest to a cube.

    Candidates are all integer matrices with entries from -most to most and a determinant from 1 to largest. The score is the mean absolute
    deviation of the three lengths from their mean, in shares of it, and the summed deviation of the angles from 90 degrees over 270; ties go to
    the smaller determinant, then the earlier vectors. Order and signs of the vectors don't change the score, so each triple of
    directions is looked at once, and the last vector is turned where the determinant would be negative.

    A diagonal supercell gives a score that the best one does not exceed; pairs of vectors whose angle alone costs more are dropped before
    triples are formed. A cell has at most ((2 most + 1)^3 - 1) / 2 directions, however many cells there are.
    """
    span = range(-most, most + 1)
    directions = [v for v in ((i, j, k) for i in span for j in span for k in span) if v > (0, 0, 0)]
    known = lattice_vectors(cells.dropna(subset=["a", "b", "c", "alpha", "beta", "gamma"]))
    each = known.select("key", "m", F.posexplode(F.array(*(F.array(*map(F.lit, v)) for v in directions))).alias("n", "h"))
    xyz = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.col("h")[0] * F.col("m")[0][k] + F.col("h")[1] * F.col("m")[1][k] + F.col("h")[2] * F.col("m")[2][k])
    vectors = each.select("key", "n", "h", xyz.alias("x")).withColumn("len", F.sqrt(_dot(F.col("x"), F.col("x")))).where("len > 0")

    def angle(u: str, v: str) -> Column:
        return F.degrees(F.acos(F.least(F.greatest(_dot(F.col(f"{u}.x"), F.col(f"{v}.x")) / (F.col(f"{u}.len") * F.col(f"{v}.len")), F.lit(-1.0)), F.lit(1.0))))

    def score(lengths: list[Column], angles: list[Column]) -> Column:
        mean = (lengths[0] + lengths[1] + lengths[2]) / 3
        return sum((F.abs(x - mean) for x in lengths[1:]), F.abs(lengths[0] - mean)) / (3 * mean) + sum((F.abs(x - 90) for x in angles[1:]), F.abs(angles[0] - 90)) / 270

    one = F.struct("n", "h", "x", "len")
    axis = {k: vectors.where(F.col("h") == F.array(*(F.lit(int(i == k)) for i in range(3)))).select("key", one.alias("uvw"[k])) for k in range(3)}
    unit = axis[0].join(axis[1], "key").join(axis[2], "key").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("l", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(most))))
    scaled = [F.col("u.len") * F.col("k"), F.col("v.len") * F.col("l"), F.col("w.len") * F.col("o")]
    bound = unit.where(F.col("k") * F.col("l") * F.col("o") <= largest).groupBy("key").agg((F.min(score(scaled, [angle("v", "w"), angle("u", "w"), angle("u", "v")])) + 1e-9).alias("bound"))
    some = vectors.join(bound, "key").select("key", "bound", one.alias("e"))
    pairs = some.select("key", "bound", F.col("e").alias("u")).join(some.select("key", F.col("e").alias("v")), "key").where("u.n < v.n")
    pairs = pairs.withColumn("uv", angle("u", "v")).where(F.abs(F.col("uv") - 90) / 270 <= F.col("bound"))
    second = pairs.select("key", F.col("u.n").alias("vn"), F.col("v").alias("w"), F.col("uv").alias("vw"))
    triples = pairs.withColumn("vn", F.col("v.n")).join(second, ["key", "vn"]).withColumn("uw", angle("u", "w"))
    h = [[F.col(f"{v}.h")[k] for k in range(3)] for v in "uvw"]
    det = h[0][0] * (h[1][1] * h[2][2] - h[1][2] * h[2][1]) - h[0][1] * (h[1][0] * h[2][2] - h[1][2] * h[2][0]) + h[0][2] * (h[1][0] * h[2][1] - h[1][1] * h[2][0])
    lengths = [F.col(f"{v}.len") for v in "uvw"]
    scored = triples.withColumn("signed", det).where(F.abs("signed").between(1, largest)).withColumn("score", score(lengths, [F.col("vw"), F.col("uw"), F.col("uv")]))
    best = scored.groupBy("key").agg(F.min_by(F.struct("u", "v", "w", "signed", "score", "vw", "uw", "uv"), F.struct(F.round("score", 9), F.abs("signed"), "u.n", "v.n", "w.n")).alias("b")).select("key", "b.*")
    last = F.when(F.col("signed") > 0, F.col("w.h")).otherwise(F.transform("w.h", lambda x: -x))
    turned = lambda a: F.when(F.col("signed") > 0, F.col(a)).otherwise(180 - F.col(a))
    a, b, c = lengths
    near = (F.abs(a - b) / ((a + b) / 2) <= length_tolerance) & (F.abs(a - c) / ((a + c) / 2) <= length_tolerance)
    square = (F.abs(F.col("vw") - 90) <= angle_tolerance) & (F.abs(F.col("uw") - 90) <= angle_tolerance) & (F.abs(F.col("uv") - 90) <= angle_tolerance)
    return best.select("key", F.array("u.h", "v.h", last).alias("rows"), F.abs("signed").alias("det"), "score", F.array(*lengths).alias("lengths"), F.array(turned("vw"), turned("uw"), F.col("uv")).alias("angles"), (near & square).alias("within"))


def groups_near(groups: DataFrame, target: Column | int) -> DataFrame:
    """groups (key, at, size) -> key, target, total, chosen: for each key groups whose sizes sum to the largest total up to the target.

    One fold over a key's groups in order of at keeps, for every total up to the target, the group that first reached it; a second one, from the last
    group back, reads the choice off. Work is groups x target for a key. Of several choices it is the one whose last group comes first, then the one before it, and
    so on. Sizes that are null, under 1 or over the target take no part; no total but 0 gives an empty choice.
    """
    goal = target if isinstance(target, Column) else F.lit(target)
    all_ = groups.groupBy("key").agg(F.max(goal).cast("int").alias("target"), F.array_sort(F.collect_list(F.struct("at", F.col("size").cast("int").alias("size")))).alias("g"))
    rows = all_.withColumn("target", F.greatest("target", F.lit(0))).withColumn("g", F.filter("g", lambda x: (x["size"] >= 1) & (x["size"] <= F.col("target"))))
    numbered = rows.withColumn("g", F.transform("g", lambda x, i: F.struct(x["at"].alias("at"), x["size"].alias("size"), i.alias("i"))))
    start = F.transform(F.sequence(F.lit(0), F.col("target")), lambda s: F.when(s == 0, -1).otherwise(-2))  # -2: not reached, -1: the empty sum

    def add(by: Column, x: Column) -> Column:
        return F.transform(by, lambda old, s: F.when((old == -2) & (s >= x["size"]) & (F.coalesce(F.get(by, s - x["size"]), F.lit(-2)) != -2), x["i"]).otherwise(old))

    reached = numbered.withColumn("by", F.aggregate("g", start, add))
    total = F.array_max(F.transform("by", lambda v, s: F.when(v != -2, s)))
    first = F.struct(F.col("total").alias("left"), F.array().cast(f"array<{dict(groups.dtypes)['at']}>").alias("chosen"))

    def back(s: Column, x: Column) -> Column:
        taken = F.get("by", s["left"]) == x["i"]
        return F.when(taken, F.struct((s["left"] - x["size"]).alias("left"), F.concat(F.array(x["at"]), s["chosen"]).alias("chosen"))).otherwise(s)

    return reached.withColumn("total", total).select("key", "target", "total", F.aggregate(F.reverse("g"), first, back)["chosen"].alias("chosen"))


def centroids(sites: DataFrame, group: str) -> DataFrame:
    """key, at, size, x, y: each group's sites and the mean of their wrapped in-plane coordinates."""
    wrapped = lambda c: F.col(c) - F.floor(c)
    return sites.groupBy("key", F.col(group).alias("at")).agg(F.count(F.lit(1)).alias("size"), F.avg(wrapped("fx")).alias("x"), F.avg(wrapped("fy")).alias("y"))


def fit_template(groups: DataFrame, template: list[tuple[float, float]], target: int) -> DataFrame:
    """key, at, matched: of the groups (key, at, size, x, y) near the target sum those that fit the template's points.

    Groups are paired one to one with points at the least total periodic distance in the plane. In order of at, paired groups are taken, and
    others while the target is not reached; the taking ends once it is. Without points, or where none can be paired, the groups near the target are the answer.
    """
    near = groups_near(groups.select("key", "at", "size"), target)
    some = groups.join(near.select("key", F.explode("chosen").alias("at")), ["key", "at"])

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        frame = frame.sort_values("at")
        paired = np.zeros(len(frame), dtype=bool)
        if template:
            d = np.abs(frame[["x", "y"]].to_numpy(dtype=float)[:, None] - np.array(template)[None])
            cost = np.sqrt((np.minimum(d, 1 - d) ** 2).sum(2))
            paired[np.arange(len(frame)) if cost.shape[0] <= cost.shape[1] else least_cost(cost.T)] = True
        take, total = [], 0
        for is_paired, size in zip(paired, frame["size"], strict=True):
            take.append(total < target)
            total += size if take[-1] else 0
        keep = np.array(take)
        return pd.DataFrame({"key": frame["key"].to_numpy()[keep], "at": frame["at"].to_numpy()[keep], "matched": paired[keep]})

    s = groups.schema
    return some.groupBy("key").applyInPandas(of, StructType([s["key"], s["at"]]).add("matched", "boolean"))


def balanced_quota(hosts: DataFrame, side: str, fraction: float, sides: tuple[str, str] = ("top", "bottom")) -> DataFrame:
    """key, first_side, second_side, quota, half, reason: how many of each key's sites to take from each of two sides.

    The quota is the fraction of both sides' sites, rounded half to even, at least one, and made even downwards; half of it is taken from each
    side. reason is no_host without sites, insufficient where half is 0 or a side has fewer, else null.
    """
    count = lambda v: F.count_if(F.col(side) == v)
    got = hosts.groupBy("key").agg(count(sides[0]).alias("first_side"), count(sides[1]).alias("second_side"))
    many = F.col("first_side") + F.col("second_side")
    quota = F.greatest(F.lit(1), F.rint(many * fraction).cast("long"))
    got = got.withColumn("quota", quota - quota % 2).withColumn("half", F.floor(F.col("quota") / 2))
    short = (F.col("half") == 0) | (F.least("first_side", "second_side") < F.col("half"))
    return got.withColumn("reason", F.when(many == 0, "no_host").when(short, "insufficient"))


def best_alternative(candidates: DataFrame, wanted: int | None) -> DataFrame:
    """candidates (key, at, layers, share, terminated) -> one row a key, with exact: the first, in order of at, with the wanted layers (any, if None) and a
    terminated surface; else the one whose layers differ least, then with the largest share, then the first."""
    off = F.lit(0) if wanted is None else F.abs(F.col("layers") - wanted)
    exact = (off == 0) & F.coalesce(F.col("terminated"), F.lit(False))
    order = F.struct((~exact).alias("e"), F.when(exact, 0).otherwise(off).alias("off"), F.when(exact, 0.0).otherwise(-F.col("share")).alias("low"), "at")
    rows = candidates.groupBy("key").agg(F.min_by(F.struct(*[c for c in candidates.columns if c != "key"], exact.alias("exact")), order).alias("b"))
    return rows.select("key", "b.*")
