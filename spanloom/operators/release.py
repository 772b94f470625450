"""Release metadata: links and evidence for reconstructing source texts, and decisions from licence evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import doi_url, europe_pmc_url, first_filled, pmc_url, pubmed_url

# The columns of the reconstruction table, in order.
COLUMNS = (
    "doc_id", "split", "source_file", "source_text_decision", "source_title", "doi", "doi_url", "pmid", "pubmed_url", "pmcid", "pmc_url", "europe_pmc_url", "source_url",
    "publication_year", "journal", "publisher", "license_evidence", "match_confidence", "match_reason", "normalized_document_sha256", "sentence_count", "reconstruction_note",
)

# The notes of the reconstruction table.
INCLUDED = "source text redistributed"
EXCLUDED = "retrieve source text from the linked publication under your own access rights; verify normalized text against checksums"


def sentence_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("doc_id").agg(F.count("*").alias("sentence_count"))


def reconstruction_note(decision: Column) -> Column:
    return F.when(decision == "include_text", INCLUDED).otherwise(EXCLUDED)


def reconstruction_sources(audit: DataFrame, manifest: DataFrame) -> DataFrame:
    """The reconstruction table: COLUMNS for each row of the audit, with its number of sentences (0 if none)."""
    doi, pmid, pmcid = F.col("doi"), F.col("pmid"), F.col("pmcid")
    given = F.col("source_url") if "source_url" in audit.columns else F.lit("")
    new = {
        "doi_url": doi_url(doi),
        "pubmed_url": pubmed_url(pmid),
        "pmc_url": pmc_url(pmcid),
        "europe_pmc_url": europe_pmc_url(pmid, pmcid, doi),
        "source_url": first_filled(given, doi_url(doi), pmc_url(pmcid), pubmed_url(pmid)),
        "license_evidence": first_filled(*[F.col(c) for c in ("epmc_license", "openalex_licenses", "unpaywall_licenses", "crossref_license_urls")]),
        "normalized_document_sha256": F.col("sha256_txt"),
        "sentence_count": F.coalesce("sentence_count", F.lit(0)).cast("long"),
        "reconstruction_note": reconstruction_note(F.col("source_text_decision")),
    }
    return audit.join(sentence_counts(manifest), "doc_id", "left").withColumns(new).select(*COLUMNS)


def licence_decision(evidence: Column) -> Column:
    """include_text for permissive evidence; everything else, and none, is excluded. Rules inferred from published outcomes."""
    text = F.lower(F.coalesce(evidence, F.lit("")))
    closed = F.rlike(text, F.lit(r"(^|[^a-z])(nc|nd)([^a-z]|$)|closed|bronze|tdm"))
    open_ = F.rlike(text, F.lit(r"cc0|public.?domain|cc.?by|creativecommons\.org/licenses/by/"))
    return F.when(closed, "exclude_text").when(open_, "include_text").otherwise("exclude_text")


def frequencies(audit: DataFrame, column: str) -> DataFrame:
    return audit.groupBy(column).agg(F.count("*").alias("n"))
