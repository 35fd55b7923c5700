"""Identifier cells as exact tokens: extraction, canonical form, kinds.

All are built-in column expressions, so they stay inside generated code. The patterns use Java's
Unicode classes, which read digits and white space as Python does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of accession, as patterns, and the pattern of a DOI's prefix.
ACCESSION_KINDS = [
    r"GS[EM]\d+",
    r"E-[A-Z]{4}-\d+",
    r"[SED]R[APRSX]\d+",
    r"PRJ[NED][A-Z]?\d+",
    r"EGA[SD]\d+",
    r"SCP\d+",
    r"HRA\d+",
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
]
DOI = r"10\.\d{4,9}/[^\s|;,]+"
EXACT_KEYS = ["accession", "doi", "pmid"]
WEAK_KEYS = ["keyword", "title"]

# An accession, a UUID and a PMID by themselves, what a person may type, which cache an identifier belongs to and what it can look up.
ACCESSION = r"(?iU)(?<![A-Za-z0-9])(" + "|".join(ACCESSION_KINDS) + r")(?![0-9A-Za-z])"
UUID = r"(?iU)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
PMID = r"(?U)(?<![\d.])(\d{1,9})(?![\d.])"
TYPED_PMID = r"(?iU)^(?:pmid:?\s*)?(\d{1,9})$"
PUBMED_ADDRESS = r"(?iU)pubmed\.ncbi\.nlm\.nih\.gov/(\d{1,9})"
CACHES = {"geo": r"(?iU)^GS[EM]\d+$", "arrayexpress": r"(?iU)^E-[A-Z]{4}-\d+$", "doi": r"(?iU)^10\.\d{4,}/\S+$", "pubmed": r"(?U)^\d+$"}
EXPANDABLE = r"(?iU)^(GS[EM]\d+|E-[A-Z]{4}-\d+|\d{1,9}|10\.\d{4,}/\S+)$"


def stripped(cell: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(cell, r"(?U)^\s+|\s+$", "")


def text(cell: Column) -> Column:
    """A cell as text: null is empty, a number keeps no decimal point that says nothing."""
    return F.regexp_replace(stripped(F.coalesce(cell.cast("string"), F.lit(""))), r"(?U)^(\d+)\.0$", "$1")


def accession(value: Column) -> Column:
    """Canonical case: UUIDs lower, all others upper."""
    value = stripped(value)
    return F.when(value.rlike(UUID), F.lower(value)).otherwise(F.upper(value))


def accessions(cell: Column) -> Column:
    """Every accession that stands by itself in a cell, in order, once."""
    # A token holds no white space, and a UUID has 36 characters.
    cased = lambda t: F.when((F.length(t) == 36) & t.rlike(UUID), F.lower(t)).otherwise(F.upper(t))
    return F.array_distinct(F.transform(F.regexp_extract_all(text(cell), F.lit(ACCESSION), 1), cased))


def doi(value: Column) -> Column:
    """A given DOI; a dot at its end is kept."""
    return F.lower(stripped(value))


def dois(cell: Column) -> Column:
    """Every DOI in a cell, without dots at the end."""
    found = F.regexp_extract_all(text(cell), F.lit(f"(?iU)({DOI})"), 1)
    return F.array_distinct(F.transform(found, lambda d: F.lower(F.regexp_replace(d, r"\.+$", ""))))


def pmids(cell: Column) -> Column:
    """Runs of up to nine digits beside no digit or dot, once DOIs are taken out."""
    rest = F.regexp_replace(text(cell), f"(?iU){DOI}", " ")
    return F.array_distinct(F.regexp_extract_all(rest, F.lit(PMID), 1))


def cells(value: Column) -> Column:
    """A count: the whole part of a plain decimal number; anything else is null."""
    t = text(value)
    number = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return number.try_cast("long")


def identifier_key(kind: Column) -> Column:
    """Identifier type to match key; a URL has none."""
    return F.when(kind.isin("pmid", "doi"), kind).when(kind != "url", F.lit("accession"))


def canonical(key: Column, value: Column) -> Column:
    """An identifier's value as its key's tokens are written."""
    return F.when(key == "accession", accession(value)).when(key == "doi", doi(value)).otherwise(stripped(value))


def accession_type(token: Column) -> Column:
    """Catalog type of a canonical accession."""
    t, kind = F.upper(token), F.when(token.rlike("(?-i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "cellxgene_dataset")
    # Prefixes and the types they stand for, in order.
    for prefix, name in (("GS", "geo"), ("E-", "arrayexpress"), ("PRJ", "bioproject"), ("EGA", "ega"), ("SCP", "scp"), ("HRA", "gsa")):
        kind = kind.when(t.startswith(prefix), name)
    return kind.otherwise("sra")


def parse(raw: Column) -> Column:
    """struct<accession, doi, pmid: array>: what one line of input names.

    PMIDs only come from a bare number or a PubMed address, and may repeat.
    """
    line = stripped(raw)
    bare = F.regexp_extract(line, TYPED_PMID, 1)
    linked = F.regexp_extract_all(line, F.lit(PUBMED_ADDRESS), 1)
    own = F.when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>"))
    return F.struct(accessions(line).alias("accession"), dois(line).alias("doi"), F.concat(own, linked).alias("pmid"))


def classify(identifier: Column) -> Column:
    """struct<kind, value>: which cache an identifier belongs to; null for none."""
    s = stripped(identifier)
    kind = F.coalesce(*(F.when(s.rlike(shape), name) for name, shape in CACHES.items()))
    value = F.when(kind.isin("geo", "arrayexpress"), F.upper(s)).when(kind == "doi", F.lower(s)).otherwise(s)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), value.alias("value")))


def encode_doi(value: Column) -> Column:
    """A DOI as a file name that can be read back."""
    return F.replace(F.replace(F.lower(stripped(value)), F.lit("_"), F.lit("~5f")), F.lit("/"), F.lit("_"))


def decode_doi(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("_"), F.lit("/")), F.lit("~5f"), F.lit("_"))


def expandable(token: Column) -> Column:
    """Whether a token can be looked up in the crosswalk; a DOI's prefix may be of any length here."""
    return token.rlike(EXPANDABLE)


def ecitmatch(reply: Column) -> Column:
    """The PMID at the end of a citation match reply, or null."""
    last = F.element_at(F.split(stripped(reply), r"\|"), -1)
    return F.when(last.rlike(r"(?U)^\d+$"), last)
