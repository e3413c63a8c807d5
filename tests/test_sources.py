import io
import zipfile

import pytest

from evisift.sources import formats, readers

RIS = "TY  - JOUR\nAU  - Doe, J.\nAU  - WHO\nTI - A title\n that goes on\nPY  - 2001/03//\nJO  - J Test\nVL  - 3\nSP  - 10\nEP  - 19\nDO  - 10.1234/x\nKW  - a\nKW  - b\nTY  - JOUR\nAU  - Roe, R.\nTI  - Second\nER  - \nTY  - JOUR\nAU  - No, T.\nER  - \n"
BIB = "@article{k1, author = {Doe, Jane and Roe, Richard and {World Group}}, title = {The {RCT} of things}, journal=\"J\", year = 1999, pages = {1--9}}\n@article{k2, title = {broken"
NBIB = "PMID- 123\nTI  - A long\n      title.\nFAU - Doe, Jane\nAU  - Doe J\nDP  - 2010 Jan\nJT  - Journal\nAID - 10.1234/y [doi]\nMH  - x\nMH  - y\n\nPMID- 124\nAU  - Roe R\n"
XML = "<xml><records><record><titles><title><style>Some</style> title</title></titles><contributors><authors><author>Doe, J</author></authors></contributors><dates><year>2003</year></dates></record><record><titles><title>bad<b></title></titles></record></records></xml>"
CSV = "Authors,Title,Year,Source title,Volume,Issue,Page start,Page end,DOI,EID\n\"Doe, J.; Roe, R.\",A &amp; B,2004,J,1,2,3,9,10.1234/z,e1\n,,2005,,,,,,,e2\n"
LIST = "1. Doe J, Roe R. A title here. J Test. 2001;3(2):10-19.\n2. Smith, A. (1999). Another title. Journal, 4(1), 5-9.\n"


def parsed(kind, text):
    rows = list(formats.PARSERS[kind](text))
    return [r for r, _ in rows if r], [e for _, e in rows if e]


def test_ris():
    good, bad = parsed("ris", RIS)
    assert [g["title"] for g in good] == ["A title that goes on", "Second"] and bad == ["no title"]
    assert good[0]["page"] == "10-19" and good[0]["year"] == 2001 and good[0]["authors"][1]["literal"] == "WHO" and good[0]["keywords"] == "a; b"


def test_bibtex():
    good, bad = parsed("bibtex", BIB)
    assert good[0]["title"] == "The RCT of things" and good[0]["page"] == "1-9" and [a["family"] or a["literal"] for a in good[0]["authors"]] == ["Doe", "Roe", "World Group"] and len(bad) == 1


def test_medline():
    good, bad = parsed("medline", NBIB)
    assert good[0]["title"] == "A long title." and good[0]["doi"] == "10.1234/y" and good[0]["authors"][0]["given"] == "Jane" and bad == ["no title"]


def test_endnote():
    good, bad = parsed("endnote-xml", XML)
    assert good[0]["title"] == "Some title" and len(bad) == 1
    assert parsed("endnote-xml", "<!DOCTYPE x><record/>")[1]


def test_csv():
    good, bad = parsed("csv", CSV)
    assert good[0]["title"] == "A & B" and good[0]["page"] == "3-9" and len(good[0]["authors"]) == 2 and bad == ["no title"]
    assert formats.profile([*CSV.split("\n")[0].split(","), "Author Keywords"]) == "scopus" and formats.profile(["Title"]) is None


def test_citations():
    good, _ = parsed("citation-list", LIST)
    assert [(g["title"], g["year"], g["volume"]) for g in good] == [("A title here", 2001, "3"), ("Another title", 1999, "4")]


def test_json():
    good, bad = parsed("csl-json", '[{"title": "T", "issued": {"date-parts": [[2001]]}, "author": [{"literal": "G"}]}, 3, {"DOI": "x"}]')
    assert good[0]["year"] == 2001 and bad == ["not an object", "no title"]


@pytest.mark.parametrize(("data", "text", "used"), [(b"\xef\xbb\xbfa\r\nb", "a\nb", "utf-8-sig"), (b"\x93x\x94", "“x”", "cp1252"), (b"\x81", "\x81", "latin-1"), ("é".encode("utf-16"), "é", "utf-16")])
def test_decode(data, text, used):
    assert formats.decode(data) == (text, used)


def test_xlsx():
    buf = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Title</t></si><si><t>A</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Year</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2001</v></c></row></sheetData></worksheet>')
    assert formats.xlsx(buf.getvalue()) == "Title\tYear\nA\t2001"


def test_screening_exports():
    rayyan = 'title,doi,notes\nT,10.1/x,"RAYYAN-INCLUSION: {""Ann""=>""Included"", ""Bob""=>""Maybe""}"\n'
    assert [(r["reviewer"], r["decision"]) for r in formats.screening_export("rayyan", rayyan)] == [("Ann", "include"), ("Bob", "maybe")]
    assert [r["decision"] for r in formats.screening_export("covidence", "excluded\nTitle,DOI\nT,x\n")] == ["include", "exclude"]


def test_files(spark, tmp_path):
    (tmp_path / "a.ris").write_text(RIS)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("nothing known")
    got = readers.read_records(spark, str(tmp_path))
    assert got.where("error is null").count() == 2 and {r["error"] for r in readers.rejected(got).collect()} >= {"no title"} and readers.rejected(got).count() == 2


def test_events(spark, tmp_path):
    (tmp_path / "e.ndjson").write_text('{"ev":"screen","id":"1"}\n\n{bad}\n{"ev":"note","id":"2"}\n{"ev":"scr')
    got = readers.read_events(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["id"], r["bad"]) for r in got] == [("1", False), (None, True), ("2", False)]
