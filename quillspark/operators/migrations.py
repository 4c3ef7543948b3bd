"""Bringing the catalogue's older tables to what today's rules say, step by step, and publishing all of them at once.

A step is a function of all tables and a time to all tables; steps follow each other in the order of MIGRATIONS, and a
step that meets tables that it has brought up already changes nothing. Rows are changed by conditions on them; what one
table's change means for another is a join on the rows that still hold. Tables of a store are written beside the old ones,
and only when all are there does the store's pointer name them: a step that fails leaves everything as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..shared import read_json, write_json

Tables = dict[str, DataFrame]
SCHEMAS = {"notices": model.NOTICES, "artifacts": model.ARTIFACTS, "versions": model.VERSIONS}
KEY = ("notice_identity", "source_url", "sha256")

# What columns that older tables lack are filled with, statuses, codes, and the message of a revocation.
DEFAULTS = {"document_kind": "legacy_unverified", "source_role": "unknown", "origin_verified": False, "gate_status": "legacy_unverified", "delivery_eligible": False}
REVOKED, REVOKED_CODE = "revoked_insecure_transport", "INSECURE_ORIGIN_TRANSPORT"
REVOKED_MESSAGE, JOINT = "官方原件使用非 HTTPS 传输，已撤销验证与交付资格", "；"
UNRESOLVED, LEGACY, LEGACY_DELIVERED, ALLOWED = "unresolved_official_source", "legacy_unverified", "legacy_delivered_unverified", "allowed"
SHOWN = ("delivered", "review")


def changed(rows: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """rows with new values in the columns named, where the condition holds; a null condition doesn't."""
    holds = F.coalesce(where, F.lit(False))
    return rows.select(*(F.when(holds, values[c]).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in values else F.col(c) for c in rows.columns))


def without(rows: DataFrame, others: DataFrame, key: str, other: str) -> DataFrame:
    """rows with ``none``: whether no row of others has their key."""
    found = others.select(F.col(other).alias("x_key")).distinct()
    return rows.join(found, F.col(key) == F.col("x_key"), "left").withColumn("none", F.col("x_key").isNull()).drop("x_key")


def delivered(artifacts: DataFrame) -> DataFrame:
    """Artifacts that are verified originals and may be delivered."""
    return artifacts.where(F.col("delivery_eligible") & F.col("origin_verified") & (F.col("gate_status") == ALLOWED))


def insecure(*urls: str) -> Column:
    out = F.lit(False)
    for u in urls:
        out = out | F.coalesce(F.lower(u).startswith("http://"), F.lit(False))
    return out


def conformed(tables: Tables, now: Column) -> Tables:
    """Every table with today's columns; what an older one lacks has its default. Further columns stay."""
    out = {}
    for name, rows in tables.items():
        schema = SCHEMAS[name]
        fill = {k: v for k, v in DEFAULTS.items() if k in schema.fieldNames() and name != "notices"}
        out[name] = rows.select(*(_column(f, rows, fill) for f in schema.fields), *(c for c in rows.columns if c not in schema.fieldNames()))
    return out


def _column(field, rows: DataFrame, fill: Mapping[str, object]) -> Column:
    have = F.col(field.name).try_cast(field.dataType) if field.name in rows.columns else F.lit(None).cast(field.dataType)
    return (F.coalesce(have, F.lit(fill[field.name]).cast(field.dataType)) if field.name in fill else have).alias(field.name)


def backfilled(tables: Tables, now: Column) -> Tables:
    """Each current artifact is a version too; versions that are there stay as they are."""
    rows = tables["artifacts"].withColumns({"final_url": F.coalesce("final_url", "source_url"), "original_name_raw": F.coalesce("original_name_raw", "original_name"), "first_seen_at": now})
    old, known = tables["versions"], tables["versions"].select(*(F.col(k).alias(f"x_{k}") for k in KEY))
    missing = rows.join(known, [rows[k].eqNullSafe(known[f"x_{k}"]) for k in KEY], "left_anti")
    return tables | {"versions": old.unionByName(missing.select(old.columns))}


def revoked(tables: Tables, now: Column) -> Tables:
    """What came over HTTP is no verified original any more, and notices that rest on nothing else aren't resolved."""
    error = F.coalesce("error", F.lit(""))
    said = F.when(error == "", REVOKED_MESSAGE).when(F.contains(error, F.lit(REVOKED_MESSAGE)), error).otherwise(F.concat(error, F.lit(JOINT + REVOKED_MESSAGE)))
    values = {"origin_verified": F.lit(False), "delivery_eligible": F.lit(False), "gate_status": F.lit(REVOKED), "gate_code": F.lit(REVOKED_CODE), "status": F.lit(REVOKED), "error": said, "updated_at": now}
    hit = F.col("delivery_eligible") & insecure("source_url", "final_url", "official_notice_url")
    out = tables | {name: changed(tables[name], hit, values) for name in ("artifacts", "versions")}
    rows = without(tables["notices"], delivered(out["artifacts"]), "identity", "notice_identity")
    hit = F.col("origin_verified") & insecure("publication_url", "origin_url") & F.col("none")
    return out | {"notices": changed(rows, hit, {"origin_verified": F.lit(False), "status": F.lit(UNRESOLVED)}).drop("none")}


def legacy(tables: Tables, now: Column) -> Tables:
    """Old deliveries that no gate has seen are shown as such; a notice under review stays so if it was only scanned, or rests on a verified original."""
    hit = ~F.col("delivery_eligible") & (F.col("gate_status") == LEGACY) & F.col("status").isin(*SHOWN)
    out = tables | {name: changed(tables[name], hit, {"status": F.lit(LEGACY_DELIVERED), "updated_at": now}) for name in ("artifacts", "versions")}
    rows = without(tables["notices"], out["artifacts"], "identity", "notice_identity").withColumnRenamed("none", "bare")
    rows = without(rows, delivered(out["artifacts"]), "identity", "notice_identity")
    scanned = (F.col("status") == "review") & F.coalesce("origin_verified", F.lit(False)) & F.get_json_object("metadata_json", "$.scan_sha256").isNotNull() & F.col("bare")
    return out | {"notices": changed(rows, F.col("status").isin(*SHOWN) & ~scanned & F.col("none"), {"status": F.lit(LEGACY)}).drop("none", "bare")}


Step = Callable[[Tables, Column], Tables]
MIGRATIONS: tuple[tuple[str, Step], ...] = (("columns", conformed), ("versions", backfilled), ("insecure_transport", revoked), ("legacy_statuses", legacy))


def migrated(tables: Tables, now: Column, steps: tuple[tuple[str, Step], ...] = MIGRATIONS) -> Tables:
    """The tables (notices with identity, artifacts, versions) after all steps; with the same ``now`` once more, the same."""
    for _, step in steps:
        tables = step(tables, now)
    return tables


class Store:
    """Tables under a folder, in versions; the file ``current`` names the one that counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> dict | None:
        """What the pointer says: the version's folder, its tables, and the steps that were applied to it."""
        return read_json(self.spark, f"{self.path}/current")

    def tables(self) -> Tables:
        """The tables of the version that counts."""
        said = self.current() or {"tables": []}
        return {name: self.spark.read.parquet(f"{self.path}/{said['version']}/{name}") for name in said["tables"]}

    def publish(self, tables: Tables, applied: list[str]) -> None:
        """Writes all tables as a new version, then moves the pointer to it; readers of the old version still find it."""
        version = f"version-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/{version}/{name}")
        write_json(self.spark, f"{self.path}/current", {"version": version, "tables": sorted(tables), "applied": applied})

    def migrate(self, now: Column, steps: tuple[tuple[str, Step], ...] = MIGRATIONS) -> list[str]:
        """Applies the steps that the current version hasn't seen, in their order, and publishes the result; the names of those applied now."""
        said = self.current()
        if said is None:
            raise ValueError(f"{self.path} has no tables yet")
        todo = tuple(s for s in steps if s[0] not in said["applied"])
        if todo:
            self.publish(migrated(self.tables(), now, todo), [*said["applied"], *(name for name, _ in todo)])
        return [name for name, _ in todo]
