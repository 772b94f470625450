"""Scalar text functions: names, identifiers, links, digests, slices, codecs and roles. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's str methods and \s know, as regular-expression class contents.
SPACE_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def doc_id_from_name(name: Column) -> Column:
    """Digits of <prefix>text<digits>.txt or .ann at the end of a file name; null if it has none."""
    return blank_to_null(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"text(\d+)\.(?:txt|ann)$", 1))


def doc_id_in_text_name(name: Column) -> Column:
    """Digits of text<digits>.txt anywhere in a name; null if it has none."""
    return blank_to_null(F.regexp_extract(name, r"text(\d+)\.txt", 1))


def record_doc_id(meta_doc_id: Column, record_id: Column) -> Column:
    """The record's own document id, or else its record id up to the first underscore."""
    return F.coalesce(blank_to_null(meta_doc_id.cast("string")), F.element_at(F.split(record_id, "_"), 1))


def link(prefix: str, identifier: Column, suffix: str = "") -> Column:
    return F.when(F.coalesce(identifier, F.lit("")) != "", F.concat(F.lit(prefix), identifier, F.lit(suffix))).otherwise("")


# Where the identifiers of publications resolve.
DOI, PUBMED, PMC = "https://doi.org/", "https://pubmed.ncbi.nlm.nih.gov/", "https://www.ncbi.nlm.nih.gov/pmc/articles/"
EUROPE_MED, EUROPE_PMC, EUROPE_SEARCH = "https://europepmc.org/article/MED/", "https://europepmc.org/article/PMC/", "https://europepmc.org/search?query=DOI:"


def doi_url(doi: Column) -> Column:
    return link(DOI, doi)


def pubmed_url(pmid: Column) -> Column:
    return link(PUBMED, pmid, "/")


def pmc_url(pmcid: Column) -> Column:
    return link(PMC, pmcid, "/")


def europe_pmc_url(pmid: Column, pmcid: Column, doi: Column) -> Column:
    bare = F.regexp_replace(pmcid, "^PMC", "")
    return first_filled(link(EUROPE_MED, pmid), F.when(F.coalesce(pmcid, F.lit("")) != "", F.concat(F.lit(EUROPE_PMC), bare)), link(EUROPE_SEARCH, doi))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def piece(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points."""
    return F.substring(text, start + 1, end - start)


#: Code points of a block of text, where whole texts would be walked for each of their parts.
BLOCK = 256


def text_blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, for block_piece()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def block_piece(blocks: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points from text_blocks(): reads the blocks of the piece alone, not the text before them."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0))
    return F.substring(F.array_join(F.slice(blocks, first + 1, count), ""), start % BLOCK + 1, end - start)


def joined_pieces(text: Column, spans: Column) -> Column:
    """The pieces of (start, end) pairs in the order given, joined by a space."""
    return F.array_join(F.transform(spans, lambda s: piece(text, s[0], s[1])), " ")


def pack_index(index: Column, kind: Column) -> Column:
    """i-j-...-#-kind"""
    return F.concat(F.array_join(F.transform(index, lambda i: i.cast("string")), "-"), F.lit("-#-"), kind.cast("string"))


def unpack_index(packed: Column) -> Column:
    return F.transform(F.split(F.element_at(F.split(packed, "-#-"), 1), "-"), lambda i: i.cast("int"))


def unpack_kind(packed: Column) -> Column:
    return F.element_at(F.split(packed, "-#-"), 2).cast("int")


def token_role(token_start: Column, token_end: Column, span_start: Column, span_end: Column) -> Column:
    """N for an empty token, O outside of the span, I inside, B at its start; the first that holds."""
    return (
        F.when(token_end <= token_start, "N")
        .when((token_start < span_start) | (token_end > span_end), "O")
        .when(token_start > span_start, "I")
        .otherwise("B")
    )


def begin_id(label_id: Column) -> Column:
    return label_id * 2 + 1


def inside_id(label_id: Column) -> Column:
    return label_id * 2 + 2


def parse_numbers(text: Column) -> Column:
    """The numbers of a comma list, blank entries left out; an error where none is left."""
    kept = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.transform(kept, lambda x: x.cast("double"))).otherwise(F.raise_error(F.lit("no numbers in the list")).cast("array<double>"))


def plain_name(name: Column) -> Column:
    """A label or type name without underscores, hyphens, commas and blanks."""
    return F.replace(F.trim(F.replace(F.translate(name, "_-", "  "), F.lit(","), F.lit(""))), F.lit(" "), F.lit(""))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def harmonic(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def count_scores(correct: Column, predicted: Column, relevant: Column) -> dict[str, Column]:
    """precision, recall and f1 of counts; all 0 where nothing is predicted or relevant."""
    some = (predicted > 0) & (relevant > 0)
    p, r = F.when(some, correct / predicted).otherwise(F.lit(0.0)), F.when(some, correct / relevant).otherwise(F.lit(0.0))
    return {"precision": p, "recall": r, "f1": harmonic(p, r)}
