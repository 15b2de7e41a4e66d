"""Readers of simulation files and marked-up documents, and writers of training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _whole(spark: SparkSession, root: str, glob: str) -> DataFrame:
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), "value")


def _numbers(line: Column, n: int) -> Column:
    parts = F.split(F.trim(line), r"\s+")
    return F.transform(F.slice(parts, 1, n), lambda x: x.try_cast("double"))


def read_poscar_sites(spark: SparkSession, root: str, glob: str = "*POSCAR*") -> DataFrame:
    """path, scale, lattice (three vectors, scaled), direct, idx, symbol, x, y, z: one row an atom.

    Line 2 is the scale, lines 3 to 5 the lattice, then symbols (absent in old files: 'X1', 'X2', ...) and counts, an optional
    'Selective dynamics' line and the kind of coordinates. A negative scale is a volume and is taken as 1.
    """
    files = _whole(spark, root, glob).select("path", F.split(F.regexp_replace("value", "\r", ""), "\n").alias("l"))
    named = ~F.get("l", F.lit(5)).rlike(r"^\s*[0-9]")
    counts_at = F.when(named, 6).otherwise(5)
    files = files.withColumn("c", F.transform(F.filter(F.split(F.trim(F.get("l", counts_at)), r"\s+"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int")))
    files = files.withColumn("s", F.when(named, F.split(F.trim(F.get("l", F.lit(5))), r"\s+")).otherwise(F.transform("c", lambda _, i: F.concat(F.lit("X"), (i + 1).cast("string")))))
    kind_at = counts_at + 1 + F.get("l", counts_at + 1).rlike(r"^\s*[Ss]").cast("int")
    scale = F.coalesce(F.trim(F.get("l", F.lit(1))).try_cast("double"), F.lit(1.0))
    files = files.withColumn("scale", F.when(scale > 0, scale).otherwise(1.0)).withColumn("kind_at", kind_at)
    symbols = F.flatten(F.zip_with("s", "c", lambda s, n: F.array_repeat(s, n)))
    lattice = F.transform(F.slice("l", 3, 3), lambda v: F.transform(_numbers(v, 3), lambda x: x * F.col("scale")))
    each = files.select("path", "scale", lattice.alias("lattice"), F.get("l", F.col("kind_at")).rlike(r"^\s*[Dd]").alias("direct"), F.posexplode(symbols).alias("idx", "symbol"), "l", "kind_at")
    xyz = _numbers(F.get("l", F.col("kind_at") + 1 + F.col("idx")), 3)
    return each.select("path", "scale", "lattice", "direct", F.col("idx").cast("long").alias("idx"), "symbol", *(F.get(xyz, F.lit(i)).alias(n) for i, n in enumerate("xyz")))


def read_last_energy(spark: SparkSession, root: str, glob: str = "*OSZICAR*") -> DataFrame:
    """path, energy, steps: the last 'E0=' of each file (Fortran's D exponents too; null where there is none) and how many there are."""
    found = F.regexp_extract_all(F.col("value"), F.lit(r"E0=\s*([-+]?[0-9]*\.?[0-9]+(?:[EeDd][-+]?[0-9]+)?)"), F.lit(1))
    return _whole(spark, root, glob).select("path", F.regexp_replace(F.try_element_at(found, F.lit(-1)), "[Dd]", "E").try_cast("double").alias("energy"), F.size(found).cast("long").alias("steps"))


def read_paragraphs(spark: SparkSession, root: str, tag: str = "p", glob: str = "*.xml") -> DataFrame:
    """path, ordinal, head, text: the paragraphs of marked-up documents, each with the nearest head before it. Inner tags are dropped, white space is single; broken files give what can be read."""
    text = _whole(spark, root, glob)
    found = F.regexp_extract_all(F.col("value"), F.lit(rf"(?s)<(?:head|{tag})(?:\s[^>]*)?>.*?</(?:head|{tag})>"), F.lit(0))
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " "))
    each = text.select("path", found.alias("all_"), F.posexplode(found).alias("at_", "x_"))
    before = F.filter(F.slice("all_", F.lit(1), F.col("at_") + 1), lambda x: x.startswith("<head"))
    rows = each.where(~F.col("x_").startswith("<head")).select("path", F.col("at_").cast("long").alias("ordinal"), F.coalesce(plain(F.try_element_at(before, F.lit(-1))), F.lit("BODY")).alias("head"), plain(F.col("x_")).alias("text"))
    return rows.where("text <> ''")


def instruction_records(df: DataFrame, instruction: str, output: str, given: str | None = None) -> DataFrame:
    """value: JSON objects {instruction, input, output}, for rows whose instruction and output are not blank."""
    ask = F.coalesce(F.col(given), F.lit("")) if given else F.lit("")
    record = F.struct(F.col(instruction).alias("instruction"), ask.alias("input"), F.col(output).alias("output"))
    return df.where((F.trim(instruction) != "") & (F.trim(output) != "")).select(F.to_json(record).alias("value"))


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends those rows of df, as JSON lines, whose key the folder does not hold yet; how many. A second call with the same rows adds none."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = df.dropDuplicates([key])
    if system.exists(target):
        fresh = fresh.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti")
    before = spark.read.schema(df.schema).json(path).count() if system.exists(target) else 0
    fresh.select(*df.columns).write.mode("append").json(path)
    return spark.read.schema(df.schema).json(path).count() - before
