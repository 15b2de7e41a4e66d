"""Readers and writers: each returns or takes a DataFrame and leaves the work to Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By extension: csv (with header), tsv, json, jsonl, parquet, orc, xml (rows named 'row')."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "tsv"):
        reader = spark.read.option("header", True).option("sep", "," if kind == "csv" else "\t").option("mode", "PERMISSIVE")
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if kind in ("json", "jsonl"):
        reader = spark.read.option("mode", "DROPMALFORMED").option("multiLine", kind == "json")
        return (reader.schema(schema) if schema else reader).json(path)
    if kind == "xml":
        return spark.read.option("rowTag", "row").format("xml").load(path)
    return spark.read.format(kind).load(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines read tolerantly: blank, malformed and non-object lines are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value")
    return rows.where(F.col("value").rlike(r"^\s*\{") & F.expr("try_parse_json(value) is not null")).select("r.*")


def read_energies(spark: SparkSession, path: str) -> DataFrame:
    """id, value (null where missing or not a number), status: tables of white-space separated text."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("id"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 1) as double)").alias("value"), F.get(parts, F.lit(2)).alias("status"))


def read_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, paper_id (16 hex digits of the content's SHA-1), content: every file under root that fits the glob."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select("path", F.substring(F.sha1("content"), 1, 16).alias("paper_id"), "content")


def read_cif_sites(spark: SparkSession, root: str) -> DataFrame:
    """structure_id, a, b, c, alpha, beta, gamma, idx, symbol, fx, fy, fz: the atom-site loops of CIF files, one row an atom."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.cif").text(root, wholetext=True)
    text = text.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.cif$", 1).alias("structure_id"), "value")
    cell = {n: F.expr(f"try_cast(regexp_extract(value, '_cell_{k}\\\\s+([-0-9.]+)', 1) as double)") for n, k in (("a", "length_a"), ("b", "length_b"), ("c", "length_c"), ("alpha", "angle_alpha"), ("beta", "angle_beta"), ("gamma", "angle_gamma"))}
    loop = F.regexp_extract("value", r"(?s)((?:\s*_atom_site_\w+)+\s*\n.*?)(?:\nloop_|\n_|\n#|\z)", 1)
    heads, rows = F.regexp_extract_all(loop, F.lit(r"_atom_site_(\w+)"), F.lit(1)), F.filter(F.split(loop, "\n"), lambda x: ~x.rlike(r"^\s*(_|$|loop_)"))
    each = text.select("structure_id", *(v.alias(k) for k, v in cell.items()), heads.alias("h"), F.posexplode(rows).alias("idx", "row"))
    field = lambda name: F.get(F.split(F.trim("row"), r"\s+"), (F.array_position("h", name) - 1).cast("int"))
    number = lambda name: F.regexp_replace(field(name), r"\(\d+\)$", "").try_cast("double")
    return each.select("structure_id", *cell, F.col("idx").cast("long"), F.regexp_extract(F.coalesce(field("type_symbol"), field("label")), "^([A-Z][a-z]?)", 1).alias("symbol"), number("fract_x").alias("fx"), number("fract_y").alias("fy"), number("fract_z").alias("fz"))


def write_by_group(df: DataFrame, path: str, group: str, order: str) -> None:
    """JSON, one folder for each value of group, rows sorted by order, descending, inside a file."""
    df.repartition(group).sortWithinPartitions(group, F.col(order).desc()).write.partitionBy(group).mode("overwrite").json(path)


def point_ids(df: DataFrame, view: str, key: str) -> DataFrame:
    """df with point_id: the first 16 hex digits of SHA-1(view:key) as a number, in text."""
    return df.withColumn("point_id", F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(view), F.col(key).cast("string"))), 1, 16), 16, 10))
