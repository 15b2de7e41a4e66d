"""Queries over tables of sites, with SQL twins.

The test tables hold no crystals. sites() reads embeddings as sites: twenty vectors make a structure, the first three numbers of a vector
(times 5, wrapped) are its fractional coordinates, its label the symbol. The cell follows from the structure's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.operators import structures as sx
from mortise.plans.statistics import rounded
from mortise.session import table

SYMBOLS = ("O", "Ti", "Fe")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    f = [F.round(sx.wrap(F.get("embedding", F.lit(i)).cast("double") * 5), 6).alias(n) for i, n in enumerate(sx.SITE)]
    return e.select(F.floor(F.col("vec_id") / 20).alias("structure_id"), (F.col("vec_id") % 20).alias("idx"), F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("vec_id") % 3 + 1).cast("int")).alias("symbol"), *f)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    s = sites(spark, sf).select("structure_id").distinct()
    return s.select("structure_id", (6.0 + F.col("structure_id") % 3).alias("a"), F.lit(7.0).alias("b"), F.lit(8.0).alias("c"), F.lit(90.0).alias("alpha"), F.lit(90.0).alias("beta"), F.lit(90.0).alias("gamma"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sx.neighbours(sites(spark, sf), cells(spark, sf), 3.0).withColumn("dist", F.round("dist", 6))


def periodic_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return sx.nearest(_pairs(spark, sf), 4).select("structure_id", "i", "j", "symbol_j", "dist", "place")


def bond_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sx.bond_statistics(_pairs(spark, sf)), 4)


def composition_properties(spark: SparkSession, sf: str) -> DataFrame:
    # Pauling electronegativities.
    known = spark.createDataFrame([("O", 3.44), ("Ti", 1.54), ("Fe", 1.83)], "symbol string, x double")
    return rounded(sx.composition(sites(spark, sf), known, "x"), 5)


def supercell(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sx.supercell(sites(spark, sf), 2, 3), 8)  # sites have 6 places, so no halves to round


def surface_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sx.surface(sites(spark, sf), "fz", 0.2).groupBy("structure_id", "symbol").agg(F.count_if("top").alias("n_top"), F.count_if("bottom").alias("n_bottom"))


def oxygen_termination(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sx.termination(sites(spark, sf), "fz", 0.2, 0.02))


def layer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sx.layers(sites(spark, sf), "fz", 0.1)


def remove_top_oxygen(spark: SparkSession, sf: str) -> DataFrame:
    return sx.remove_top(sites(spark, sf), "fz").select("structure_id", "idx", "symbol")


def substitution(spark: SparkSession, sf: str) -> DataFrame:
    s = sites(spark, sf)
    top = sx.surface(s, "fz", 0.2).where("top and symbol <> 'O'").select("structure_id", "idx", F.lit("Ti").alias("new_symbol"))
    return sx.substitute(s, top).select("structure_id", "idx", "symbol", "changed")


def farthest_sites(spark: SparkSession, sf: str) -> DataFrame:
    return sx.farthest_points(sites(spark, sf), 4)


def site_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Each structure's sites matched with those of the next structure."""
    s = sites(spark, sf)
    after = s.withColumn("structure_id", F.col("structure_id") - 1)
    return rounded(sx.assign(s, after, 0.4))


def supercell_search(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).select(F.col("structure_id").alias("key"), "a", "b", (10.0 + F.col("structure_id") % 50).alias("least"))
    return sx.multipliers(c)


QUERIES = {f.__name__: f for f in (
    periodic_neighbours, bond_statistics, composition_properties, supercell, surface_windows, oxygen_termination, layer_counts, remove_top_oxygen, substitution, farthest_sites, site_assignment, supercell_search)}
_F = lambda i: f"round(5 * CAST(embedding[{i}] AS DOUBLE) - floor(5 * CAST(embedding[{i}] AS DOUBLE)), 6)"
_S = f"s AS (SELECT vec_id // 20 AS structure_id, vec_id % 20 AS idx, ['O', 'Ti', 'Fe'][vec_id % 3 + 1] AS symbol, {_F(1)} AS fx, {_F(2)} AS fy, {_F(3)} AS fz FROM embeddings)"
_P = f"""WITH {_S}, d AS (SELECT i.structure_id, i.idx AS i, j.idx AS j, j.symbol AS symbol_j, j.fx - i.fx - round_even(j.fx - i.fx, 0) AS dx, j.fy - i.fy - round_even(j.fy - i.fy, 0) AS dy, j.fz - i.fz - round_even(j.fz - i.fz, 0) AS dz FROM s i JOIN s j ON j.structure_id = i.structure_id),
  k AS (SELECT unnest([-1, 0, 1]) AS k), x AS (SELECT structure_id, i, j, symbol_j, sqrt(pow((dx + a.k) * (6 + structure_id % 3), 2) + pow((dy + b.k) * 7, 2) + pow((dz + c.k) * 8, 2)) AS r FROM d, k a, k b, k c),
  p AS (SELECT structure_id, i, j, symbol_j, round(r, 6) AS dist FROM x WHERE r <= 3 AND r > 1e-9)"""
_TOP = f"WITH {_S}, w AS (SELECT *, max(fz) OVER (PARTITION BY structure_id) - fz AS d, fz - min(fz) OVER (PARTITION BY structure_id) AS e FROM s)"
#: farthest_sites and site_assignment have no twin; tests hold them against brute force.
ORACLES = {
    "periodic_neighbours": f"{_P} SELECT structure_id, i, j, symbol_j, dist, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, i ORDER BY dist, j) AS place FROM p) WHERE place <= 4",
    "bond_statistics": f"""{_P}, n AS (SELECT structure_id, avg(c) AS m, stddev_pop(c) AS s FROM (SELECT structure_id, i, count(*) AS c FROM p GROUP BY 1, 2) GROUP BY 1)
      SELECT p.structure_id, count(*) AS n, round(min(dist), 4) AS low, round(max(dist), 4) AS high, round(avg(dist), 4) AS mean, round(stddev_pop(dist), 4) AS std, round(quantile_cont(dist, 0.25), 4) AS q1, round(quantile_cont(dist, 0.5), 4) AS median, round(quantile_cont(dist, 0.75), 4) AS q3,
        round(any_value(m), 4) AS coordination, round(any_value(s), 4) AS coordination_std FROM p JOIN n ON n.structure_id = p.structure_id GROUP BY 1""",
    "composition_properties": f"WITH {_S}, x AS (SELECT structure_id, symbol, CASE symbol WHEN 'O' THEN 3.44::DOUBLE WHEN 'Ti' THEN 1.54 ELSE 1.83 END AS x FROM s) SELECT structure_id, count(*) AS sites, count(DISTINCT symbol) AS species, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std FROM x GROUP BY 1",
    "supercell": f"WITH {_S}, n AS (SELECT structure_id, max(idx) + 1 AS n FROM s GROUP BY 1) SELECT s.structure_id, (a.k * 3 + b.k) * n + idx AS idx, symbol, round((fx + a.k) / 2, 8) AS fx, round((fy + b.k) / 3, 8) AS fy, round(fz, 8) AS fz FROM s JOIN n ON n.structure_id = s.structure_id, range(2) a(k), range(3) b(k)",
    "surface_windows": f"{_TOP} SELECT structure_id, symbol, count(*) FILTER (WHERE d <= 0.2::DOUBLE) AS n_top, count(*) FILTER (WHERE e <= 0.2::DOUBLE) AS n_bottom FROM w GROUP BY 1, 2",
    "oxygen_termination": f"{_TOP}, g AS (SELECT structure_id, avg(CAST(symbol = 'O' AS INT)) AS share, bool_and(symbol = 'O') FILTER (WHERE d <= 0.02::DOUBLE) AS o FROM w WHERE d <= 0.2::DOUBLE GROUP BY 1) SELECT structure_id, round(share, 6) AS share, o AND share >= 0.5 AS terminated FROM g",
    "layer_counts": f"""WITH RECURSIVE {_S}, z AS (SELECT structure_id, fz, row_number() OVER (PARTITION BY structure_id ORDER BY fz) AS k FROM s),
      f AS (SELECT structure_id, k, fz AS at, CAST(1 AS BIGINT) AS n FROM z WHERE k = 1 UNION ALL SELECT z.structure_id, z.k, CASE WHEN z.fz - f.at > 0.1::DOUBLE THEN z.fz ELSE f.at END, f.n + CAST(z.fz - f.at > 0.1::DOUBLE AS BIGINT) FROM f JOIN z ON z.structure_id = f.structure_id AND z.k = f.k + 1)
      SELECT structure_id, max(n) AS layers FROM f GROUP BY 1""",
    "remove_top_oxygen": f"WITH {_S} SELECT structure_id, idx, symbol FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, symbol ORDER BY fz DESC, idx DESC) AS k FROM s) WHERE k > 1 OR symbol <> 'O'",
    "substitution": f"{_TOP} SELECT structure_id, idx, CASE WHEN d <= 0.2::DOUBLE AND symbol <> 'O' THEN 'Ti' ELSE symbol END AS symbol, d <= 0.2::DOUBLE AND symbol = 'Fe' AS changed FROM w",
    "supercell_search": f"""WITH {_S}, c AS (SELECT DISTINCT structure_id AS key, CAST(6 + structure_id % 3 AS DOUBLE) AS a, CAST(10 + structure_id % 50 AS DOUBLE) AS l FROM s),
      g AS (SELECT key, x.k AS ia, y.k AS ib, round(greatest(l - x.k * a, 0) + greatest(l - y.k * 7.0::DOUBLE, 0), 9) AS short FROM c, range(1, 9) x(k), range(1, 9) y(k)), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY short, ia * ib, ia, ib) AS n FROM g)
      SELECT key, CAST(ia AS INT) AS ia, CAST(ib AS INT) AS ib, short = 0 AS feasible FROM r WHERE n = 1""",
}
