import pytest
from pyspark.sql import functions as F

from evisift.functions import text
from evisift.functions.quantities import number_value, plain_scale, scale_value, unit_words


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(x,) for x in rows], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_doi(spark):
    got = values(spark, text.normal_doi, ["https://doi.org/10.1234/ABC.", "doi:10.1234/x", "DOI 10.12345/a(b)", "10.12/x", "", None])
    assert got == ["10.1234/abc", "10.1234/x", "10.12345/a(b", None, None, None]


def test_title(spark):
    got = values(spark, text.normal_title, ["Effect &amp; <i>Cause</i>: Été–Étude", "", None, "  A—B  "])
    assert got == ["effect cause ete etude", "", None, "a b"]


def test_family_key_drops_one_leading_particle(spark):
    assert values(spark, text.family_key, ["van der Berg", "De", "Le Blanc", "Müller-Lüdenscheid", None]) == ["der berg", "de", "blanc", "muller ludenscheid", None]


def test_year_takes_the_first_plausible_run(spark):
    assert values(spark, lambda c: text.normal_year(c, 2025), ["c. 1399-1401", "in 20123", "2028", "2027", None]) == [1401, 2012, None, 2027, None]


def test_jaccard_and_ratio(spark):
    df = spark.createDataFrame([([], [], "", ""), (["a", "b"], ["b", "c"], "abcd", "abce")], "a array<string>, b array<string>, s string, t string")
    got = df.select(text.jaccard(F.col("a"), F.col("b")), text.edit_ratio(F.col("s"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (1 / 3, 0.75)]


def test_base32_id_matches_a_plain_computation(spark):
    import hashlib

    alphabet = "0123456789abcdefghjkmnpqrstvwxyz"

    def plain(key):
        n = int.from_bytes(hashlib.sha256(key.encode()).digest()[:10], "big")
        return "rec_" + "".join(alphabet[(n >> (75 - 5 * i)) & 31] for i in range(16))

    keys = ["10.1234/abc", "", "é", "x" * 500]
    assert values(spark, text.base32_id, keys) == [plain(k) for k in keys]


@pytest.mark.parametrize(("families", "year", "label"), [(["A"], 2001, "A (2001)"), (["A", "B"], None, "A & B (n.d.)"), (["A", "B", "C"], 1999, "A et al. (1999)"), ([], 2000, "(no author)"), (None, 2000, "(no author)")])
def test_citation_label(spark, families, year, label):
    df = spark.createDataFrame([(families, year)], "f array<string>, y int")
    assert df.select(text.citation_label(F.col("f"), F.col("y"))).first()[0] == label


def test_numbers_with_commas(spark):
    assert values(spark, number_value, ["1,234", "1,234,567.5", "0,5", "12,34", "1.5e3", "x", None]) == [1234.0, 1234567.5, 0.5, 12.34, 1500.0, None, None]


def test_scales(spark):
    got = values(spark, lambda c: scale_value(plain_scale(c)), ["×10", "x1000", "x10⁻³", "10^-2", "10^3", "hundred", "thousand", "", None, "odd"])
    assert [None if x is None else round(x, 9) for x in got] == [10, 1000, 0.001, 0.01, 1000, 100, 1000, 1, 1, None]


def test_unit_words(spark):
    assert values(spark, unit_words, ["mg·kg⁻¹", "g per kg", "ug / kg", "min.", None]) == ["mg/kg", "g/kg", "ug/kg", "min", None]
