"""Exports: safe CSV, published at once; a vault layout; checks of what was exported."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls


def safe_strings(rows: DataFrame) -> DataFrame:
    """All string columns with the guard against formulas."""
    return rows.select(*(text.csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """A folder of CSV parts with headers, put in place of what was there only when it is whole.

    It is written beside its place; then the old folder is moved aside, the new one into place, and the old one removed. If the job
    fails, the old export is still there. With ``bom`` each part begins with a byte order mark, for spreadsheets.
    """
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    shown = safe_strings(rows)
    if bom and shown.columns:
        shown = shown.withColumnRenamed(shown.columns[0], "\ufeff" + shown.columns[0])
    shown.write.option("header", True).option("escape", '"').option("nullValue", "").csv(beside)
    put_in_place(rows.sparkSession, beside, path)


def put_in_place(spark: SparkSession, new: str, path: str) -> None:
    """Renames a finished folder to its place; one that is there goes when the new one stands, and comes back if that fails."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{new}.old"
    had = system.exists(make(path)) and system.rename(make(path), make(old))
    if not system.rename(make(new), make(path)):
        if had:
            system.rename(make(old), make(path))
        raise RuntimeError(f"{new} can't be renamed to {path}")
    if had:
        system.delete(make(old), True)


def promotable(artifacts: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Quarantined artifacts that may be promoted, with the path that they get: allowed by the gate, official, verified over HTTPS, and the file's hash and size still as recorded.

    Where two contents have one name, the hash in the path keeps them apart.
    """
    there = files.select(F.col(key).alias("f_key"), F.col("sha256").alias("f_sha"), F.col("length").alias("f_size"))
    rows = artifacts.join(there, artifacts[key] == there["f_key"])
    fit = (F.col("gate_status") == "allowed") & (F.col("source_role") == "official") & F.col("origin_verified") & urls.is_https(F.col("source_url"))
    same = (F.col("f_sha") == F.col("sha256")) & (F.col("f_size") == F.col("size"))
    return rows.where(fit & same).withColumn("vault_path", vault_path(F.col("sha256"), F.col("original_name"))).drop("f_key", "f_sha", "f_size")


def vault_path(sha256: Column, name: Column) -> Column:
    """Content-addressed: two digits, the hash, the safe name."""
    return F.concat_ws("/", F.substring(sha256, 1, 2), sha256, text.safe_component(name))


def verified_now(versions: DataFrame, current: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Versions that are their reference's current content, allowed, official and fetched over HTTPS."""
    trusted = versions.where((F.col("gate_status") == "allowed") & (F.col("source_role") == "official") & urls.is_https(F.col("source_url")))
    return trusted.join(current.select(*keys), list(keys), "left_semi")


def violations(artifacts: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, problem) for artifacts (key, sha256, size, status, gate_status) against the files (key, sha256, length) that are there."""
    there = files.select(F.col(key).alias("f_key"), F.col("sha256").alias("f_sha"), F.col("length").alias("f_size"))
    rows = artifacts.join(there, artifacts[key] == there["f_key"], "left")
    tests = (
        ("missing_file", F.col("f_key").isNull()),
        ("hash_differs", F.col("f_sha") != F.col("sha256")),
        ("size_differs", F.col("f_size") != F.col("size")),
        ("delivered_without_gate", (F.col("status") == "delivered") & (F.coalesce("gate_status", F.lit("")) != "allowed")),
    )
    found = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests)))
    return rows.select(F.col(key), F.explode(found).alias("problem"))


def export_rows(catalogue: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """The catalogue with one row for each link; notices without a link stay, with nulls. links: key and columns of their own."""
    own = links.withColumnRenamed(key, "link_of")
    return catalogue.join(own, catalogue[key] == own["link_of"], "left").drop("link_of")


def export_counts(rows: DataFrame, key: str, url: str) -> DataFrame:
    """(notices, rows, with_url) of an export."""
    return rows.agg(F.count_distinct(key).alias("notices"), F.count("*").alias("rows"), F.count_if(F.coalesce(F.col(url), F.lit("")) != "").alias("with_url"))
