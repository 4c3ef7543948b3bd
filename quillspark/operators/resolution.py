"""The way from a lead to its official original, attempt by attempt, over recorded responses.

A lead's candidates are tried in the order of their kinds. They are tried in a few rounds of growing width (ROUNDS), and
a round takes only leads that no earlier one has resolved, so that most leads cost one look and none more than twenty. Of
a round's attempts those after a lead's first success don't count. Each attempt leaves an edge, so that what was tried
and why it failed can be read afterwards; a round's edges are written before the next one starts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gate, html, urls
from ..shared import shared_dir
from . import provenance

# The relations of edges, and how many candidates of a lead are tried.
UNRESOLVED, DISCOVERED, ORIGINAL = "unresolved", "discovered_official_candidate", "official_original"
GROUP, GROUP_UNRESOLVED = "official_group_intermediate", "official_group_unresolved"
MOST = 20
#: Ranks of the candidates that a round tries.
ROUNDS = ((1, 1), (2, 4), (5, MOST))
EDGE = ("lead_identity", "attempt", "step", "discovery_url", "official_url", "relation", "method", "evidence", "verified")


def tried(found: DataFrame) -> DataFrame:
    """Candidates with ``attempt``, from 1 on, in the order in which a lead's are tried: attachments aren't, and of the others only the first twenty."""
    notices = found.where(F.col("kind") != provenance.KINDS[3])
    order = Window.partitionBy("lead_identity").orderBy(provenance.ranked(found))
    return notices.withColumn("attempt", F.row_number().over(order)).where(F.col("attempt") <= MOST)


def fetched(asked: DataFrame, responses: DataFrame, url: str) -> DataFrame:
    """asked with final_url, content_type, body and failure, from what was recorded of the address: a text that is empty for none.

    responses: (requested_url, final_url, status, content_type, body, error), one row for each address.
    """
    own = responses.select(F.col("requested_url").alias("x_url"), "final_url", "status", "content_type", "body", "error")
    rows = asked.join(own, F.col(url) == F.col("x_url"), "left")
    failure = F.when(F.col("x_url").isNull(), "no response recorded").when(F.coalesce("error", F.lit("")) != "", F.col("error")).when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("?")))).otherwise("")
    return rows.withColumn("failure", failure).drop("x_url", "status", "error")


def from_groups(groups: DataFrame, registry: DataFrame) -> DataFrame:
    """Group pages with project_url, the address of the one row that is the lead's project (null where none is), and project_key, the source that it is registered for (null where it is no page of a notice)."""
    key = F.concat_ws(" ", "lead_identity", "attempt")
    pages = groups.withColumn("x_key", key)
    links = provenance.row_links(pages, "x_key", "body", F.col("title"), F.col("buyer"), F.col("code"), F.col("content_type")).withColumnRenamed("url", "x_link")
    rows = pages.drop("body", "content_type").join(links, "x_key", "left")
    target = F.try_element_at(html.resolved_targets(F.coalesce("final_url", "official_url"), F.coalesce("x_link", F.lit(""))), F.lit(1))
    rows = provenance.addressed(rows.withColumn("x_target", F.when(F.col("x_link").isNotNull(), target)).withColumnsRenamed({"official_url": "group_url", "official_host": "group_host", "transport_upgraded": "x_up", "original_url": "x_original"}), "x_target")
    rows = urls.registered(rows, "official_host", registry.select("domain", "exact_only", F.col("role").alias("x_role"), F.col("key").alias("x_own")), ("x_role", "x_own"), "x_key")
    kind = provenance.kind(F.col("official_url"), F.col("official_host"), urls.path(F.col("official_url")))
    fits = (F.col("official_url") != "") & (F.col("x_role") == "official") & kind.isin(provenance.KINDS[0], provenance.KINDS[2])
    rows = rows.withColumn("project_url", F.when(F.col("x_link").isNotNull(), F.coalesce(F.nullif("official_url", F.lit("")), "x_target"))).withColumn("project_key", F.when(fits, F.col("x_own"))).withColumn("project_kind", F.when(fits, kind))
    return rows.select("lead_identity", "lead_url", "attempt", F.col("group_url").alias("official_url"), "source_key", "kind", "method", "title", "buyer", "code", "document_kind", "project_url", "project_key", "project_kind")


def judged(rows: DataFrame, trusted: tuple[str, ...], redirects: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """rows with ``codes``: what the content gate has against a response; it is asked only where there is one."""
    items = rows.withColumns({"source_role": F.lit("official"), "origin": F.col("asked_url"), "analysis_body": F.lit(None).cast("binary"), "expected_title": F.col("title"), "expected_buyer": F.col("buyer"), "expected_project_code": F.col("code")})
    fine = gate.verdicts(items.where("failure = ''"), trusted, redirects).withColumn("codes", F.array_join("error_codes", ","))
    own = [*rows.columns, "codes"]
    return fine.select(own).unionByName(rows.where("failure <> ''").withColumn("codes", F.lit("")).select(own))


def _edges(rows: DataFrame, step: int, url: str, relation, evidence, verified=False, method="method") -> DataFrame:
    as_column = lambda x: x if not isinstance(x, (str, bool)) else F.lit(x)
    return rows.select("lead_identity", "attempt", F.lit(step).alias("step"), F.col("lead_url").alias("discovery_url"), F.col(url).alias("official_url"), as_column(relation).alias("relation"), F.col(method).alias("method"), as_column(evidence).alias("evidence"), as_column(verified).alias("verified"))


def attempts(rows: DataFrame, responses: DataFrame, registry: DataFrame, trusted: tuple[str, ...], redirects: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The edges of candidates with what their leads expect (title, buyer, code, document_kind), each taken by itself."""
    first = fetched(rows, responses, "official_url")
    group = F.col("kind") == provenance.KINDS[1]
    notices = first.where(~group).withColumn("asked_url", F.col("official_url"))
    unread = first.where(group & (F.col("failure") != ""))
    # written, so that conditions on what a row led to don't repeat how it was found
    groups = _kept(from_groups(first.where(group & (F.col("failure") == "")), registry), "groups")
    none, other, right = F.col("project_url").isNull(), F.col("project_url").isNotNull() & F.col("project_key").isNull(), F.col("project_key").isNotNull()
    projects = groups.where(right).withColumns({"asked_url": F.col("project_url"), "source_key": F.col("project_key"), "kind": F.col("project_kind"), "method": F.lit("group_row")})
    projects = fetched(projects, responses, "asked_url")
    own = ["lead_identity", "lead_url", "attempt", "source_key", "kind", "method", "title", "buyer", "code", "document_kind", "asked_url", "final_url", "content_type", "body", "failure"]
    seen = judged(notices.select(*own, F.lit(0).alias("step")).unionByName(projects.select(*own, F.lit(2).alias("step"))), trusted, redirects)
    passed = (F.col("failure") == "") & (F.col("codes") == "")
    why = F.when(F.col("failure") != "", F.col("failure")).when(F.col("codes") != "", F.concat(F.lit("gate: "), F.col("codes"))).otherwise(F.concat(F.lit("source="), F.col("source_key"), F.lit(";kind="), F.col("kind"), F.lit(";transport=https")))
    last = seen.select("lead_identity", "attempt", "step", F.col("lead_url").alias("discovery_url"), F.col("asked_url").alias("official_url"), F.when(passed, ORIGINAL).otherwise(DISCOVERED).alias("relation"), "method", why.alias("evidence"), passed.alias("verified"))
    return (
        last.unionByName(_edges(unread, 0, "official_url", DISCOVERED, F.col("failure")))
        .unionByName(_edges(groups.where(none), 0, "official_url", GROUP_UNRESOLVED, "no row of the group page is the one project"))
        .unionByName(_edges(groups.where(~none), 0, "official_url", GROUP, F.concat(F.lit("not delivered; project_url="), F.col("project_url"))))
        .unionByName(_edges(groups.where(other).withColumn("by", F.lit("group_row")), 1, "project_url", GROUP_UNRESOLVED, "the row leads to no official page of a notice", method="by"))
    )


def resolution(leads: DataFrame, found: DataFrame, responses: DataFrame, registry: DataFrame, trusted: tuple[str, ...], redirects: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Edges of all leads: (lead_identity, attempt, step, discovery_url, official_url, relation, method, evidence, verified).

    leads: (lead_identity, lead_url, title, buyer, code, document_kind), one row each; found: what provenance.candidates() gives.
    A lead without candidates, or whose own address the policy refuses, has one edge, ``unresolved``, with attempt 0. An attempt
    has one edge, or through a group page several (``step``): the intermediate page, then the project. The last edge of a resolved lead is
    ``official_original``, and the only verified one. Leads resolve independently; the order of rows changes nothing.
    """
    wanted = leads.select("lead_identity", "lead_url", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "buyer", "code", "document_kind")))
    # written, so that conditions on what the policy says don't repeat its expressions
    wanted, refused = _kept(wanted.withColumn("refused", urls.policy_error(F.col("lead_url"))), "leads"), F.col("refused")
    fine = wanted.where(refused == "").drop("refused")
    order = tried(found.drop("lead_url").join(fine.select("lead_identity", "lead_url"), "lead_identity"))
    order = _kept(order.join(fine.drop("lead_url"), "lead_identity"), "tried")
    reason = F.when(refused != "", F.concat(F.lit("address: "), refused)).otherwise("no official link on the page")
    without = wanted.join(order.select("lead_identity").distinct(), "lead_identity", "left_anti").withColumns({"attempt": F.lit(0), "method": F.lit("official_link_extraction"), "none": F.lit("")})
    edges, open_ = _edges(without, 0, "none", UNRESOLVED, reason), order
    for first, last in ROUNDS:
        now = _kept(attempts(open_.where(F.col("attempt").between(first, last)), responses, registry, trusted, redirects), "attempts")
        done = now.where("verified").groupBy("lead_identity").agg(F.min("attempt").alias("success"))
        done = _kept(done, "resolved")
        counted = now.join(done, "lead_identity", "left").where(F.col("success").isNull() | (F.col("attempt") <= F.col("success"))).drop("success")
        edges = edges.unionByName(counted)
        open_ = open_.where(F.col("attempt") > last).join(done, "lead_identity", "left_anti")
        if last < MOST:
            open_ = _kept(open_, "open")
            if open_.isEmpty():
                break
    return edges.select(*EDGE)


def _kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: the next round starts from it, not from the beginning."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
