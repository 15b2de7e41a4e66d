"""Tables of atomic sites: structure_id, idx, symbol, fx, fy, fz (fractional), with cells a, b, c, alpha, beta, gamma.

Every operator works on many structures at once, keyed by structure_id; a structure has at most some thousand sites, so per-structure
windows and groups are bounded by the structure, not by the table. Sites with a null coordinate are left out of distances.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

SITE = ("fx", "fy", "fz")


def wrap(x: Column) -> Column:
    """A fractional coordinate in [0, 1)."""
    w = x - F.floor(x)
    return F.when(w >= 1, 0.0).otherwise(w)


def matrix(df: DataFrame) -> DataFrame:
    """df with the cell's vectors in Cartesian axes: ax; bx, by; cx, cy, cz (a along x, b in the xy plane)."""
    ca, cb, cg, sg = (F.cos(F.radians("alpha")), F.cos(F.radians("beta")), F.cos(F.radians("gamma")), F.sin(F.radians("gamma")))
    cx, cy = F.col("c") * cb, F.col("c") * (ca - cb * cg) / sg
    return df.withColumns({"ax": F.col("a"), "bx": F.col("b") * cg, "by": F.col("b") * sg, "cx": cx, "cy": cy, "cz": F.sqrt(F.greatest(F.col("c") * F.col("c") - cx * cx - cy * cy, F.lit(0.0)))})


def _length(d: list[Column]) -> Column:
    x = d[0] * F.col("ax") + d[1] * F.col("bx") + d[2] * F.col("cx")
    y, z = d[1] * F.col("by") + d[2] * F.col("cy"), d[2] * F.col("cz")
    return F.sqrt(x * x + y * y + z * z)


def neighbours(sites: DataFrame, cells: DataFrame, cutoff: float, images: int = 1) -> DataFrame:
    """structure_id, i, j, symbol_i, symbol_j, dist: ordered pairs of sites no farther apart than cutoff, over every periodic image within images cells of the nearest one; an atom and its own images included.

    Fractional differences are rounded to the nearest cell first. images = 1 finds all pairs while cutoff is at most half the smallest
    distance between opposite faces; raise it beyond that. The join is on structure_id.
    """
    left = sites.dropna(subset=list(SITE)).select("structure_id", F.col("idx").alias("i"), F.col("symbol").alias("symbol_i"), *(F.col(f).alias("i" + f) for f in SITE))
    right = sites.dropna(subset=list(SITE)).select("structure_id", F.col("idx").alias("j"), F.col("symbol").alias("symbol_j"), *(F.col(f).alias("j" + f) for f in SITE))
    span = F.sequence(F.lit(-images), F.lit(images))
    pairs = left.join(right, "structure_id").join(matrix(cells), "structure_id")
    pairs = pairs.withColumns({"d" + f: F.col("j" + f) - F.col("i" + f) - F.rint(F.col("j" + f) - F.col("i" + f)) for f in SITE})
    for axis in "xyz":
        pairs = pairs.withColumn("k" + axis, F.explode(span))
    pairs = pairs.withColumn("dist", _length([F.col("df" + x) + F.col("k" + x) for x in "xyz"]))
    return pairs.where((F.col("dist") <= cutoff) & (F.col("dist") > 1e-9)).select("structure_id", "i", "j", "symbol_i", "symbol_j", "dist")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k shortest of each site's pairs, ties by j, with their place."""
    w = Window.partitionBy("structure_id", "i").orderBy("dist", "j")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def bond_statistics(pairs: DataFrame) -> DataFrame:
    """Per structure n, min, max, mean, population std and quartiles of distances, and mean and std of the coordination number of sites that have neighbours."""
    q = lambda p: F.percentile("dist", F.lit(p))
    own = pairs.groupBy("structure_id").agg(F.count("dist").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"), F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("std"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))
    coordination = pairs.groupBy("structure_id", "i").count().groupBy("structure_id").agg(F.avg("count").alias("coordination"), F.stddev_pop("count").alias("coordination_std"))
    return own.join(coordination, "structure_id")


def composition(sites: DataFrame, properties: DataFrame, value: str) -> DataFrame:
    """Per structure: sites, species, mean and std of an element property weighted by the share of sites; symbols without the property are left out of both."""
    counts = sites.groupBy("structure_id", "symbol").agg(F.count(F.lit(1)).alias("n")).join(properties, "symbol", "left")
    known = F.when(F.col(value).isNotNull(), F.col("n"))
    s = counts.groupBy("structure_id").agg(F.sum("n").alias("sites"), F.count(F.lit(1)).alias("species"), F.sum(known).alias("w"), F.sum(known * F.col(value)).alias("s1"), F.sum(known * F.col(value) * F.col(value)).alias("s2"))
    mean = F.try_divide(F.col("s1"), "w")
    return s.select("structure_id", "sites", "species", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(F.col("s2"), "w") - mean * mean, F.lit(0.0))).alias("std"))


def supercell(sites: DataFrame, na: int, nb: int, nc: int = 1) -> DataFrame:
    """The sites of na x nb x nc cells, fractions of the larger cell; idx counts on, image by image."""
    out = sites
    for n, k in ((na, "ka_"), (nb, "kb_"), (nc, "kc_")):
        out = out.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    size = F.max(F.col("idx") + 1).over(Window.partitionBy("structure_id"))
    moved = {f: (F.col(f) + F.col(k)) / n for f, k, n in (("fx", "ka_", na), ("fy", "kb_", nb), ("fz", "kc_", nc))}
    return out.withColumn("idx", ((F.col("ka_") * nb + F.col("kb_")) * nc + F.col("kc_")) * size + F.col("idx")).withColumns(moved).select(*sites.columns)


def surface(sites: DataFrame, z: str, tol: float) -> DataFrame:
    """sites with top and bottom: whether within tol of the structure's highest or lowest site."""
    w = Window.partitionBy("structure_id")
    return sites.withColumns({"top": F.max(z).over(w) - F.col(z) <= tol, "bottom": F.col(z) - F.min(z).over(w) <= tol})


def termination(sites: DataFrame, z: str, tol: float, topmost: float = 1e-3, symbol: str = "O", share: float = 0.5) -> DataFrame:
    """structure_id, share, terminated: the symbol's share of sites in the top window; terminated if that reaches share and every site within topmost of the highest has the symbol."""
    marked = surface(sites, z, tol).withColumn("d_", F.max(z).over(Window.partitionBy("structure_id")) - F.col(z))
    got = marked.where("top").groupBy("structure_id").agg(F.avg((F.col("symbol") == symbol).cast("double")).alias("share"), F.bool_and(F.when(F.col("d_") <= topmost, F.col("symbol") == symbol)).alias("all_"))
    return got.select("structure_id", "share", (F.col("all_") & (F.col("share") >= share)).alias("terminated"))


def layers(sites: DataFrame, z: str, tol: float) -> DataFrame:
    """structure_id, layers: a new layer starts where z exceeds the start of the present layer by more than tol."""
    zs = sites.where(F.col(z).isNotNull()).groupBy("structure_id").agg(F.array_sort(F.collect_list(F.col(z).cast("double"))).alias("zs"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("at"))
    fold = F.aggregate("zs", start, lambda a, x: F.when(a["at"].isNull() | (x - a["at"] > tol), F.struct((a["n"] + 1).alias("n"), x.alias("at"))).otherwise(a))
    return zs.select("structure_id", fold["n"].alias("layers"))


def remove_top(sites: DataFrame, z: str, symbol: str = "O") -> DataFrame:
    """sites without each structure's highest site of the symbol; ties: the largest idx."""
    w = Window.partitionBy("structure_id", "symbol").orderBy(F.col(z).desc_nulls_last(), F.col("idx").desc())
    return sites.withColumn("k_", F.row_number().over(w)).where((F.col("k_") > 1) | ~F.col("symbol").eqNullSafe(F.lit(symbol))).drop("k_")


def substitute(sites: DataFrame, chosen: DataFrame) -> DataFrame:
    """sites with the symbols that chosen (structure_id, idx, new_symbol) gives; changed marks real changes."""
    both = sites.join(chosen.dropDuplicates(["structure_id", "idx"]), ["structure_id", "idx"], "left")
    changed = F.col("new_symbol").isNotNull() & ~F.col("new_symbol").eqNullSafe(F.col("symbol"))
    return both.withColumn("changed", changed).withColumn("symbol", F.coalesce("new_symbol", "symbol")).select(*sites.columns, "changed")


def _points(frame: pd.DataFrame):  # noqa: ANN202
    return frame[list(SITE)].to_numpy(dtype=float)


def farthest_points(sites: DataFrame, k: int) -> DataFrame:
    """structure_id, idx, place: k sites of each structure, first the one farthest from the centroid, then always the one farthest from those chosen (fractional distance, ties by idx)."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        frame = frame.dropna(subset=list(SITE)).sort_values("idx")
        x = _points(frame)
        taken: list[int] = []
        far = np.linalg.norm(x - x.mean(0), axis=1).round(12) if len(x) else np.empty(0)
        while len(taken) < min(k, len(x)):
            taken.append(int(far.argmax()))
            near = np.linalg.norm(x - x[taken[-1]], axis=1).round(12)
            far = near if len(taken) == 1 else np.minimum(far, near)
            far[taken] = -1
        return pd.DataFrame({"structure_id": frame["structure_id"].iloc[taken].to_numpy(), "idx": frame["idx"].iloc[taken].to_numpy(), "place": range(1, len(taken) + 1)})

    return sites.groupBy("structure_id").applyInPandas(of, StructType([sites.schema["structure_id"], sites.schema["idx"], StructField("place", LongType())]))


def least_cost(cost):  # noqa: ANN001, ANN201
    """For each row of a cost table (no more rows than columns) the column of a cheapest one-to-one assignment, by shortest augmenting paths with dual prices."""
    import numpy as np

    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        at, base, last = row, 0.0, -1
        while at >= 0:
            through = base + cost[at] - u[at] - v
            better = ~done & (through < dist)
            dist[better], back[better] = through[better], last
            last = int(np.where(done, np.inf, dist).argmin())
            base, at = dist[last], owner[last]
            done[last] = True
        seen = np.flatnonzero(done & (np.arange(m) != last))
        u[row] += base
        u[owner[seen]] += base - dist[seen]
        v[seen] -= base - dist[seen]
        while last >= 0:
            owner[last] = owner[back[last]] if back[last] >= 0 else row
            last = back[last]
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def assign(left: DataFrame, right: DataFrame, farthest: float) -> DataFrame:
    """structure_id, symbol, i, j, dist: within a structure and a symbol, sites of left paired one to one with sites of right at the least total periodic distance (fractional); pairs farther apart than farthest are dropped."""
    columns = ["structure_id", "symbol", "idx", *SITE]
    both = left.select(*columns, F.lit(0).alias("side")).unionByName(right.select(*columns, F.lit(1).alias("side"))).dropna()

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        frame = frame.sort_values(["side", "idx"])
        a, b = frame[frame["side"] == 0], frame[frame["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"structure_id": frame["structure_id"].iloc[:0], "symbol": frame["symbol"].iloc[:0], "i": frame["idx"].iloc[:0], "j": frame["idx"].iloc[:0], "dist": np.empty(0)})
        d = _points(b)[None] - _points(a)[:, None]
        cost = np.sqrt(((d - np.rint(d)) ** 2).sum(2))
        rows, cols = (np.arange(len(a)), least_cost(cost)) if len(a) <= len(b) else (least_cost(cost.T), np.arange(len(b)))
        dist = cost[rows, cols]
        keep = dist <= farthest
        return pd.DataFrame({"structure_id": frame["structure_id"].iloc[0], "symbol": frame["symbol"].iloc[0], "i": a["idx"].to_numpy()[rows[keep]], "j": b["idx"].to_numpy()[cols[keep]], "dist": dist[keep]})

    s = left.schema
    schema = StructType([s["structure_id"], s["symbol"], StructField("i", s["idx"].dataType), StructField("j", s["idx"].dataType)]).add("dist", "double")
    return both.groupBy("structure_id", "symbol").applyInPandas(of, schema)


def multipliers(targets: DataFrame, most: int = 8) -> DataFrame:
    """targets (key, a, b, least): for each row the in-plane repeats ia, ib up to most with ia a and ib b at least least, of the smallest product (ties: ia, ib); else those of the least shortfall."""
    grid = targets.withColumn("ia", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("ib", F.explode(F.sequence(F.lit(1), F.lit(most))))
    short = F.greatest(F.col("least") - F.col("ia") * F.col("a"), F.lit(0.0)) + F.greatest(F.col("least") - F.col("ib") * F.col("b"), F.lit(0.0))
    best = F.min(F.struct(F.round(short, 9).alias("short"), (F.col("ia") * F.col("ib")).alias("cost"), "ia", "ib")).alias("best")
    return grid.groupBy("key").agg(best).select("key", "best.ia", "best.ib", (F.col("best.short") == 0).alias("feasible"))
