"""One object for what a user does with a catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import money, text
from .operators import catalog, upsert
from .sources import sinks


@dataclass(frozen=True)
class Catalog:
    """Tables with the schemas of model.py: notices need an ``identity``; the others refer to it as ``notice_identity``."""

    notices: DataFrame
    fields: DataFrame
    classifications: DataFrame
    refs: DataFrame
    artifacts: DataFrame
    versions: DataFrame
    coverage_rows: DataFrame

    def rows(self) -> DataFrame:
        """Every notice with fields, verdict, counts, labels and primary amount."""
        n = self.notices.alias("n")
        f, c = self.fields.withColumnRenamed("notice_identity", "f_id").alias("f"), self.classifications.withColumnRenamed("notice_identity", "c_id").alias("c")
        joined = n.join(f, F.col("n.identity") == F.col("f.f_id"), "left").join(c, F.col("n.identity") == F.col("c.c_id"), "left")
        amount, kind = money.primary({name: F.col(f"f.{name}") for name, _ in money.PRECEDENCE})
        base = joined.select(
            "n.identity", "n.source", "n.external_id", "n.title", "n.buyer", "n.status", "n.metadata_json",
            F.coalesce("f.event_type", "n.notice_type", F.lit("")).alias("notice_type"),
            F.coalesce("f.published_at", "n.published_at", F.lit("")).alias("published_at"),
            F.coalesce("f.city", "n.region", F.lit("")).alias("city"),
            "f.winning_vendor", "f.project_code", "c.relevant", "c.confidence", "c.industry", "c.categories", "c.needs_review", "c.ai_confirmed",
            amount.alias("amount_minor"), kind.alias("amount_type"),
        )
        failed = F.count_if(F.col("status").isin("failed", "blocked", "restricted", "unverified_origin"))
        counted = catalog.with_counts(base, "identity", self.refs.where("status <> 'invalid_link'"), "notice_identity", {"refs": F.count("*"), "failed": failed})
        own = F.count_if(F.col("source_url") != F.coalesce("official_notice_url", F.lit("")))
        counted = catalog.with_counts(counted, "identity", self.eligible(), "notice_identity", {"files": F.count("*"), "attachments": own})
        counts = [F.col(x) for x in ("files", "attachments", "refs", "failed")]
        judged = catalog.judged_label(F.col("relevant"), F.col("needs_review"), F.col("ai_confirmed"))
        return counted.withColumn("download_status", catalog.download_label(*counts)).withColumn("ai_status", judged).withColumn("amount", money.yuan(F.col("amount_minor")))

    def eligible(self) -> DataFrame:
        """Files that may be handed out."""
        a = self.artifacts
        fit = a["delivery_eligible"] & a["origin_verified"] & (a["gate_status"] == "allowed") & (a["source_role"] == "official")
        return a.where(fit & F.lower("source_url").startswith("https://") & a["status"].isin("delivered", "review", "verified", "downloaded") & a["delivery_path"].isNotNull())

    def matching(self, query: str = "", notice_type: str = "", industry: str = "", category: str = "", city: str = "", status: str = "", exact: bool = False, download_status: str = "", source: str = "", date_from: str = "", date_to: str = "", relevance: str = "all", query_id: str = "") -> DataFrame:
        """The notices that meet all filters; with ``exact`` type, industry and city are the whole value."""
        c = F.col
        scope = [F.get_json_object("metadata_json", "$.query_id") == query_id, c("status") != "alias"] if query_id else []
        return catalog.filtered(
            self.rows(),
            *scope,
            catalog.free_text(query, c("title"), c("buyer"), c("winning_vendor"), c("project_code")),
            text.matches_filter(c("notice_type"), notice_type, exact),
            text.matches_filter(c("industry"), industry, exact),
            text.matches_filter(F.array_join("categories", ","), category),
            text.matches_filter(c("city"), city, exact),
            c("status") == status.strip() if status.strip() else None,
            c("source") == source.strip() if source.strip() else None,
            catalog.day_between(c("published_at"), date_from, date_to),
            catalog.relevance(relevance, c("relevant"), c("needs_review"), c("status")),
            catalog.download_filter(download_status, c("files"), c("attachments"), c("refs"), c("failed")),
        )

    def list_notices(self, page: int = 1, page_size: int = 50, **filters: str | bool) -> tuple[DataFrame, DataFrame]:
        """(one page, totals) of the notices that meet all filters of matching(), newest first."""
        where, found = catalog.Page(page, page_size), self.matching(**filters)
        return catalog.paged(found, where, F.col("published_at").desc(), F.col("source"), F.col("external_id")), catalog.totals(found, page_size)

    def links(self) -> DataFrame:
        """One row for each reference, and one for each notice without any, with state and reason."""
        got = self.artifacts.select(F.col("notice_identity").alias("a_id"), F.col("source_url").alias("a_url"), "delivery_path", "gate_status", "delivery_eligible", "sha256")
        named = self.refs.select("notice_identity", F.col("source_url").alias("attachment_url"), "original_name", F.col("status").alias("ref_status"), "error")
        both = named.join(got, (named["notice_identity"] == got["a_id"]) & (named["attachment_url"] == got["a_url"]), "left")
        rows = self.notices.select("identity", "title", "url", "origin_verified", "source_role").join(both, F.col("identity") == F.col("notice_identity"), "left")
        there = F.coalesce("attachment_url", F.lit("")) != ""
        done = F.coalesce(F.col("delivery_path").isNotNull() & (F.col("gate_status") == "allowed") & F.col("delivery_eligible"), F.lit(False))
        verified = F.coalesce(F.col("origin_verified") & (F.col("source_role") == "official"), F.lit(False))
        shown = rows.withColumn("state", catalog.link_state(there, done, F.col("ref_status"))).withColumn("reason", catalog.link_reason(there, done, verified, F.col("error")))
        return shown.select("identity", "title", "url", "attachment_url", "original_name", "state", "reason", F.when(done, F.col("sha256")).alias("sha256"))

    def manifest(self, verified: bool = False) -> DataFrame:
        """Every version; with ``verified`` only what is current, allowed, official and came over HTTPS."""
        keys = ("notice_identity", "source_url", "sha256")
        return sinks.verified_now(self.versions, self.artifacts, keys) if verified else self.versions.join(self.notices.select(F.col("identity").alias("notice_identity")), "notice_identity", "left_semi")

    def current(self) -> DataFrame:
        """Notices that aren't aliases, with their fields and each amount in yuan beside its cents."""
        rows = self.notices.where("status <> 'alias'").join(self.fields.withColumnRenamed("notice_identity", "identity").drop("published_at"), "identity", "left")
        kinds = [name for name, _ in money.PRECEDENCE]
        return rows.select(*(c for c in rows.columns if c not in kinds), *(x for n in kinds for x in (F.col(n), money.yuan(F.col(n)).alias(n.replace("_minor", "_yuan")))))

    def coverage(self) -> DataFrame:
        """The last known coverage of each source; ties stay."""
        return catalog.latest_per_group(self.coverage_rows, "source", "updated_at")

    def upserted(self, notices: DataFrame) -> Catalog:
        """The catalogue with new or newer notices; source, rank and external id never change."""
        return Catalog(upsert.upserted(self.notices, notices, ["identity"], keep=("source", "authority_rank", "external_id")), self.fields, self.classifications, self.refs, self.artifacts, self.versions, self.coverage_rows)

    def export(self, path: str, **filters) -> DataFrame:
        """Writes all notices that meet the filters with their links as CSV, and returns (notices, rows, with_url)."""
        rows = sinks.export_rows(self.matching(**filters).drop("metadata_json").withColumn("categories", F.array_join("categories", " | ")), self.links().select("identity", "attachment_url", "state", "reason"), "identity")
        sinks.write_csv(rows, path)
        return sinks.export_counts(rows, "identity", "attachment_url")
