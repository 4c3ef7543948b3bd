"""One query opN_<name> for each corpus operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, deltalloyd, langid, lattice, linerules, merkle, mixing, orderminhash, seedextend, urltrees, warc, weaklabel, wordbpe
from .oracle import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings."""
    return lattice.linked(table(spark, sf_dir, "embeddings"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a mix of sources by weight."""
    return mixing.plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules."""
    return linerules.clean(table(spark, sf_dir, "documents"), texts=False)


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion record of each page."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")), "page_id")


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by the scorer that the posterior of the heuristic labellers trains."""
    docs = table(spark, sf_dir, "documents")
    return weaklabel.scored(docs, *weaklabel.fit(docs))


#: The rules that the URL filter starts from.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op7_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL."""
    return urltrees.judged(table(spark, sf_dir, "pages"), URL_RULES)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of each page's URL, and the verdict that the rule gives: what op7 has before its trees."""
    return urltrees.placed(table(spark, sf_dir, "pages"), URL_RULES).select(F.col("key").alias("page_id"), "host", "path", "rule", "listed")


def op8_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat earlier documents."""
    return seedextend.without_repeats(table(spark, sf_dir, "documents"), digest=True)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens and of their decoding."""
    import public_tokenizers

    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of each document."""
    found = orderminhash.classes(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "class_id", "coalesce(doc_id = class_id, true) as kept")


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each embedding after ten rounds, with the clusters' inertia and centroids."""
    return deltalloyd.described(*deltalloyd.cluster(table(spark, sf_dir, "embeddings")))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens, with word ends, and of their decoding."""
    import public_tokenizers

    return wordbpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of each document against the manifest's root, after tampering with some texts."""
    docs = table(spark, sf_dir, "documents")
    changed = {"text": merkle.tampered_text(docs["doc_id"], docs["text"])}
    made = merkle.manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], changed)
    return merkle.checked(made).withColumnRenamed("row", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice, op2_language, op3_mixing, op4_warc_derivatives, op5_line_rules, op6_weak_labels, op7_url_trees, op8_seed_extend, op9_byte_bpe, op10_order_minhash, op11_delta_lloyd, op12_word_bpe, op13_merkle, url_rules)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
