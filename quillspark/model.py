"""Schemas of the catalogue's tables, and bringing older data to them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOOLS, _LONGS = {"origin_verified", "delivery_eligible", "relevant", "ai_confirmed", "needs_review", "verified", "reached_start", "reached_end", "truncated"}, {"authority_rank", "size", "pages", "notices", "details_ok", "attachments_found", "restricted_files", "downloads_ok", "downloads_failed", "blocked"}


def _schema(names: str) -> T.StructType:
    kind = lambda n: T.BooleanType() if n in _BOOLS else T.LongType() if n in _LONGS or n.endswith("_minor") else T.TimestampType() if n in ("first_seen_at", "updated_at") else T.DoubleType() if n == "confidence" else T.StringType()
    return T.StructType([T.StructField(n, kind(n)) for n in names.split()])


NOTICES = _schema("source authority_rank external_id title published_at url region notice_type buyer body_text metadata_json discovery_url publication_url origin_url source_role origin_verified status")
ARTIFACTS = _schema("notice_identity source_url sha256 final_url size original_name original_name_raw vault_path content_type document_kind source_role origin_verified gate_status gate_code delivery_eligible discovery_url official_notice_url delivery_path status error updated_at")
VERSIONS = T.StructType([*ARTIFACTS.fields, T.StructField("first_seen_at", T.TimestampType())])
REFS = _schema("notice_identity source_url original_name label access status error updated_at")
ALIASES = _schema("alias_identity canonical_identity reason updated_at")
CLASSIFICATIONS = T.StructType([*_schema("notice_identity relevant confidence industry reason method ai_confirmed needs_review").fields, T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("evidence", T.ArrayType(T.StringType()))])
FIELDS = T.StructType([*_schema("notice_identity event_type project_code package_no intention_amount_minor budget_amount_minor max_price_minor award_amount_minor contract_amount_minor winning_vendor city project_summary published_at bid_deadline opening_at award_at expected_purchase_date").fields, T.StructField("evidence", T.MapType(T.StringType(), T.StringType()))])
EDGES = _schema("lead_identity discovery_url official_url relation method evidence verified updated_at")
COVERAGE = _schema("run_id source status target_start target_end first_date last_date message reached_start reached_end truncated pages notices details_ok attachments_found restricted_files downloads_ok downloads_failed blocked updated_at")


def identity(source: Column, external_id: Column) -> Column:
    return F.concat(source, F.lit(":"), external_id)


def conform(rows: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """rows with exactly the schema's columns: cast, missing ones null, nulls filled with defaults. Values that don't cast become null."""
    have, fill = set(rows.columns), defaults or {}
    out = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        c = c.try_cast(f.dataType) if not isinstance(f.dataType, (T.ArrayType, T.MapType)) else c.cast(f.dataType)
        out.append((F.coalesce(c, F.lit(fill[f.name]).cast(f.dataType)) if f.name in fill else c).alias(f.name))
    return rows.select(*out)
