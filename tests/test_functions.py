"""Scalar functions on cells with all the shapes that lists carry."""

import datetime

import pytest
from pyspark.sql import functions as F

from provena.functions import identifiers as ids
from provena.functions import wording


def each(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v string")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


ACCESSIONS = [
    ("GEO-GSE133344", ["GSE133344"]), ("gse1; GSE1 | gsm22", ["GSE1", "GSM22"]), ("AE-E-MTAB-11536", ["E-MTAB-11536"]), ("DISCO-HRA000123", ["HRA000123"]), ("GSE90546x", []), ("xGSE9", []),
    ("PRJNA12 SRP3 ERR4 EGAS5 EGAD6 SCP7 PRJE8", ["PRJNA12", "SRP3", "ERR4", "EGAS5", "EGAD6", "SCP7", "PRJE8"]), (None, []), ("", []), ("BD65A70F-b274-4133-b9dd-0d1431b6af34", ["bd65a70f-b274-4133-b9dd-0d1431b6af34"]), ("GSE٣", ["GSE٣"]),
]


@pytest.mark.parametrize("k", range(len(ACCESSIONS)))
def test_accessions(spark, k):
    cell, want = ACCESSIONS[k]
    assert each(spark, [cell], ids.accessions) == [want]


def test_pmids_and_dois(spark):
    cells = ["31067475 || 33521016", "31924475;34099645", "doi:10.1016/j.jhep.2020.05.039", "31395745.0", "31395745.", "1234567890", "", None, " 12 ", "10.1000/A.|10.1000/a"]
    assert each(spark, cells, ids.pmids) == [["31067475", "33521016"], ["31924475", "34099645"], [], ["31395745"], [], [], [], [], ["12"], []]
    assert each(spark, cells, ids.dois) == [[], [], ["10.1016/j.jhep.2020.05.039"], [], [], [], [], [], [], ["10.1000/a"]]
    assert each(spark, [" 10.1/X. "], ids.doi) == ["10.1/x."]


def test_text_and_cells(spark):
    assert each(spark, ["  x\t", "12.0", "a.0", None, "1.5"], ids.text) == ["x", "12", "a.0", "", "1.5"]
    assert each(spark, ["12.0", "1.9", "5d", "inf", "nan", "", None, "1e3", "x", "-2", "1e400"], ids.cells) == [12, 1, None, None, None, None, None, 1000, None, -2, None]


def test_kinds(spark):
    assert each(spark, ["pmid", "doi", "url", "geo", "hca"], ids.identifier_key) == ["pmid", "doi", None, "accession", "accession"]
    assert each(spark, ["GSE1", "E-MTAB-1", "PRJNA1", "EGAS1", "SCP1", "HRA1", "SRP1", "bd65a70f-b274-4133-b9dd-0d1431b6af34"], ids.accession_type) == ["geo", "arrayexpress", "bioproject", "ega", "scp", "gsa", "sra", "cellxgene_dataset"]
    assert each(spark, ["gse1", "e-mtab-1", "10.1000/X", "12", "x"], lambda c: ids.classify(c)["value"]) == ["GSE1", "E-MTAB-1", "10.1000/x", "12", None]
    names = each(spark, ["10.1000/a_b/c"], ids.encode_doi)
    assert names == ["10.1000_a~5fb_c"] and each(spark, names, ids.decode_doi) == ["10.1000/a_b/c"]
    assert each(spark, ["a|b|123", "a|NOT_FOUND", ""], ids.ecitmatch) == ["123", None, None]


def test_parse(spark):
    lines = ["PMID: 123", "123", "https://pubmed.ncbi.nlm.nih.gov/77/", "see 123", "GSE1 10.1000/x."]
    assert each(spark, lines, lambda c: ids.parse(c)["pmid"]) == [["123"], ["123"], ["77"], [], []]
    assert each(spark, lines[-1:], lambda c: ids.parse(c)["accession"]) == [["GSE1"]] and each(spark, lines[-1:], lambda c: ids.parse(c)["doi"]) == [["10.1000/x"]]


def test_wording(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), ([],)], "v array<string>")
    assert [tuple(r) for r in df.select(wording.examples(F.col("v")), wording.shown_list(F.col("v"))).collect()] == [("a, b, c and 1 more", "['a', 'b', 'c', 'd']"), ("", "[]")]
    c = each(spark, ["Litviňuková, M. et al. Cells of the heart. Nature 588, 466–472 (2020).", "not a citation"], wording.citation)
    assert c[0].author == "Litviňuková" and c[0].first_page == "466" and c[0].year == "2020" and c[1] is None
    assert each(spark, ["Litviňuková", "Nat. Methods", "中", None], wording.slug) == ["litvinukova", "nat-methods", "x", None]
    today = F.lit(datetime.date(2026, 10, 1))
    assert each(spark, ["2025-09-30", "2026-10-31", "bad", None], lambda c: wording.months_since(c, today)) == [13, 0, None, None]
    assert each(spark, ["10.1/a b"], lambda c: wording.identifier_url(F.lit("doi"), c)) == ["https://doi.org/10.1/a%20b"]
    assert each(spark, ["hca"], lambda c: wording.identifier_url(c, c)) == [None]
    why = ["no exact key could be attempted: x", "no match on ['a'], but this manifest needs ['b']", "other", None]
    assert [bool(x) for x in each(spark, why, wording.why)] == [True, True, False, False]
