"""Bibliographic exchange formats as row generators, and their detection.

Each parser takes the text of a file and yields ``(record, error)``: a dictionary in the common shape, or a message for a rejected part. A record needs a title.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

Parsed = Iterator[tuple[dict | None, str | None]]

# Tags of the exchange formats.
RIS_FIELDS = {"TI": "title", "T1": "title", "JO": "journal", "JF": "journal", "T2": "journal", "JA": "journal", "VL": "volume", "IS": "issue", "SP": "first", "EP": "last", "DO": "doi", "AB": "abstract", "N2": "abstract", "LA": "language", "UR": "url", "SN": "issn"}
MEDLINE_FIELDS = {"TI": "title", "JT": "journal", "VI": "volume", "IP": "issue", "PG": "pages", "AB": "abstract", "LA": "language", "PMID": "pmid"}
CSV_COLUMNS = {
    "title": "title", "article title": "title", "document title": "title", "authors": "authors", "author": "authors", "year": "year", "published year": "year", "publication year": "year",
    "source title": "journal", "journal": "journal", "publication title": "journal", "volume": "volume", "issue": "issue", "page start": "first", "page end": "last", "pages": "pages",
    "doi": "doi", "pubmed id": "pmid", "abstract": "abstract", "author keywords": "keywords", "keywords": "keywords", "language": "language", "url": "url", "link": "url",
}
PROFILES = {
    "scopus": {"eid", "source title", "author keywords"}, "web-of-science": {"ut (unique wos id)", "article title", "source title"}, "ebscohost": {"article title", "accession number"},
    "proquest": {"storeid", "title", "pubtitle"}, "dimensions": {"publication id", "dimensions url"}, "publish-or-perish": {"cites", "gsrank", "title"},
}


def decode(data: bytes) -> tuple[str, str]:
    """Text and encoding: byte order mark, then UTF-8, then CP1252, then Latin-1; line ends become one kind."""
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        text, used = data.decode("utf-16"), "utf-16"
    else:
        for used in ("utf-8-sig", "cp1252", "latin-1"):
            try:
                text = data.decode(used)
                break
            except UnicodeDecodeError:
                continue
    return text.replace("\r\n", "\n").replace("\r", "\n"), used


def detect(name: str, text: str) -> str:
    """The format of a file, by its extension; for plain text by its first lines."""
    end = name.lower().rpartition(".")[2]
    known = {"ris": "ris", "bib": "bibtex", "nbib": "medline", "xml": "endnote-xml", "json": "csl-json", "csv": "csv", "tsv": "tsv", "tab": "tsv", "xlsx": "xlsx"}
    if end in known:
        return known[end]
    head = text.lstrip()[:2000]
    if re.search(r"^PMID\s*-", head, re.M):
        return "medline"
    if re.search(r"^TY\s*-", head, re.M):
        return "ris"
    if re.match(r"\s*@\w+\s*[{(]", head):
        return "bibtex"
    if re.match(r"\[?\d+[.)\]]\s", head) or "\n\n" in head:
        return "citation-list"
    raise ValueError(f"unknown format of {name}")


def _name(text: str) -> dict:
    family, comma, given = text.strip().partition(",")
    return {"family": family.strip(), "given": given.strip() or None, "literal": None} if comma else {"family": None, "given": None, "literal": family.strip()}


def _year(*texts: str | None) -> int | None:
    for t in texts:
        m = re.search(r"\b(1[4-9]\d\d|20\d\d)\b", t or "")
        if m:
            return int(m[1])
    return None


def _finish(r: dict) -> tuple[dict | None, str | None]:
    pages = r.pop("pages", None)
    first, last = r.pop("first", None), r.pop("last", None)
    r["page"] = pages or ("-".join(x for x in (first, last) if x) or None)
    if not (r.get("title") or "").strip():
        return None, "no title"
    r["title"] = re.sub(r"\s+", " ", r["title"]).strip()
    return r, None


def ris(text: str) -> Parsed:
    """A record runs from one TY to the next; the spacing of tags may vary and ER may be missing."""
    current: dict[str, list[str]] | None = None
    tag = None

    def close(c: dict[str, list[str]]) -> tuple[dict | None, str | None]:
        r: dict = {"authors": [_name(a) for t in ("AU", "A1", "A2") for a in c.get(t, [])], "keywords": "; ".join(c.get("KW", [])) or None}
        for t, field in RIS_FIELDS.items():
            if t in c:
                r.setdefault(field, " ".join(c[t]))
        r["year"] = _year(*(c.get(t, [""])[0] for t in ("PY", "Y1", "DA")))
        return _finish(r)

    for line in text.split("\n"):
        m = re.match(r"\s*([A-Z][A-Z0-9])\s{0,3}-\s?(.*)$", line)
        if m:
            tag, value = m[1], m[2].strip()
            if tag == "TY":
                if current is not None:
                    yield close(current)
                current = {"TY": [value]}
            elif tag == "ER":
                if current is not None:
                    yield close(current)
                current = None
            elif current is not None:
                current.setdefault(tag, []).append(value)
        elif current is not None and tag in current and line.strip():
            current[tag][-1] += " " + line.strip()
    if current is not None:
        yield close(current)


def medline(text: str) -> Parsed:
    """Blocks between blank lines; indented lines go on; full author names are preferred to short ones."""
    for block in re.split(r"\n\s*\n", text):
        if not block.strip():
            continue
        c: dict[str, list[str]] = {}
        tag = None
        for line in block.split("\n"):
            m = re.match(r"([A-Z]{2,4})\s*-\s?(.*)$", line)
            if m:
                tag = m[1]
                c.setdefault(tag, []).append(m[2].strip())
            elif tag and line.strip():
                c[tag][-1] += " " + line.strip()
        names = c.get("FAU") or [re.sub(r"^(\S+(?: \S+)*?) ([A-Z]+)$", r"\1, \2", a) for a in c.get("AU", [])]
        r: dict = {"authors": [_name(a) for a in names] + [{"family": None, "given": None, "literal": a} for a in c.get("CN", [])], "keywords": "; ".join(c.get("MH", [])) or None}
        for t, field in MEDLINE_FIELDS.items():
            if t in c:
                r[field] = " ".join(c[t])
        r.setdefault("journal", (c.get("TA") or [None])[0])
        r["doi"] = next((m[1] for t in ("LID", "AID") for v in c.get(t, []) if (m := re.match(r"(\S+) \[doi\]", v))), None)
        r["year"] = _year(*(c.get(t, [""])[0] for t in ("DP", "DA", "DEP")))
        yield _finish(r)


def bibtex(text: str) -> Parsed:
    """Entries with braces counted; a broken entry is rejected alone."""
    for m in re.finditer(r"@(\w+)\s*[{(]\s*([^,\s]*)\s*,", text):
        if m[1].lower() in ("comment", "preamble", "string"):
            continue
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        if depth:
            yield None, f"entry {m[2]}: braces do not close"
            continue
        fields, body = {}, text[m.end() : at - 1]
        for f in re.finditer(r"(\w+)\s*=\s*(?:\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}|\"([^\"]*)\"|(\w+))", body):
            value = next(x for x in f.groups()[1:] if x is not None)
            fields[f[1].lower()] = re.sub(r"\s+", " ", value)
        clean = {k: v.replace("{", "").replace("}", "").strip() for k, v in fields.items()}
        authors = []
        for a in re.split(r"\s+and\s+", fields.get("author", "")):
            if a.strip():
                whole = a.strip().startswith("{")
                a = a.replace("{", "").replace("}", "").strip()
                if "," not in a and not whole and " " in a:
                    given, _, family = a.rpartition(" ")
                    a = f"{family}, {given}"
                authors.append(_name(a))
        r = {"authors": authors, "keywords": clean.get("keywords"), "title": clean.get("title"), "journal": clean.get("journal") or clean.get("booktitle"), "volume": clean.get("volume"), "issue": clean.get("number"), "pages": re.sub("-+", "-", clean["pages"]) if "pages" in clean else None, "doi": clean.get("doi"), "abstract": clean.get("abstract"), "year": _year(clean.get("year"), clean.get("date"))}
        yield _finish(r)


def endnote_xml(text: str) -> Parsed:
    """Records one by one, so that bad markup rejects only its own; entity declarations are refused."""
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text):
        yield None, "document type declarations are refused"
        return
    for part in re.findall(r"<record\b.*?(?:</record>|(?=<record\b)|\Z)", text, re.S):
        try:
            e = ET.fromstring(re.sub(r"&(?!#?\w+;)", "&amp;", part))
        except ET.ParseError as err:
            yield None, f"record: {err}"
            continue
        get = lambda *path: next((" ".join("".join(x.itertext()).split()) for p in path for x in e.iterfind(p)), None)
        r = {"authors": [_name("".join(a.itertext()).strip()) for a in e.iterfind("contributors/authors/author")], "title": get("titles/title"), "journal": get("periodical/full-title", "titles/secondary-title"), "volume": get("volume"), "issue": get("number"), "pages": get("pages"), "doi": get("electronic-resource-num"), "abstract": get("abstract"), "keywords": "; ".join("".join(k.itertext()).strip() for k in e.iterfind("keywords/keyword")) or None, "year": _year(get("dates/year"))}
        yield _finish(r)


def csl_json(text: str) -> Parsed:
    data = json.loads(text)
    for x in data if isinstance(data, list) else [data]:
        if not isinstance(x, dict):
            yield None, "not an object"
            continue
        date = ((x.get("issued") or {}).get("date-parts") or [[None]])[0]
        r = {"authors": [{k: a.get(k) for k in ("family", "given", "literal")} for a in x.get("author", [])], "title": x.get("title"), "journal": x.get("container-title"), "volume": x.get("volume"), "issue": x.get("issue"), "pages": x.get("page"), "doi": x.get("DOI"), "pmid": x.get("PMID"), "abstract": x.get("abstract"), "keywords": x.get("keyword"), "language": x.get("language"), "year": date[0] if date else None}
        yield _finish(r)


def profile(header: list[str]) -> str | None:
    """The platform whose signature the header holds."""
    have = {h.strip().lower() for h in header}
    return next((name for name, need in PROFILES.items() if need <= have), None)


def delimited(text: str, sep: str = ",", mapping: dict[str, str] | None = None) -> Parsed:
    """Columns by an explicit mapping or by the usual names."""
    rows = csv.DictReader(io.StringIO(text), delimiter=sep)
    names = {h: (mapping or {}).get(h) or CSV_COLUMNS.get(h.strip().lower()) for h in rows.fieldnames or []}
    for row in rows:
        r: dict = {}
        for h, field in names.items():
            if field and row.get(h):
                r.setdefault(field, html.unescape(row[h]))
        r["authors"] = [_name(a) for a in re.split(r";\s*", r.get("authors") or "") if a.strip()]
        r["year"] = _year(r.get("year"))
        yield _finish(r)


def xlsx(data: bytes, sheet: int = 1) -> str:
    """A sheet as tab-separated text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
        out = []
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str] = {}
            for c in row.iterfind("m:c", ns):
                col = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    col = col * 26 + ord(ch) - 64
                v = c.find("m:v", ns)
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                cells[col] = shared[int(text)] if c.get("t") == "s" and text else text
            out.append("\t".join(re.sub(r"[\t\r\n]+", " ", cells.get(k, "")) for k in range(1, max(cells, default=0) + 1)))
    return "\n".join(out)


def citation_list(text: str) -> Parsed:
    """Numbered or separate paragraphs in Vancouver or APA style; a best effort."""
    entries = re.split(r"(?m)^\s*\[?\d+[.)\]]\s+", text) if re.search(r"(?m)^\s*\[?\d+[.)\]]\s+", text) else re.split(r"\n\s*\n", text)
    for e in (" ".join(x.split()) for x in entries):
        if not e:
            continue
        apa = re.match(r"(?P<who>.+?) \((?P<y>\d{4})[a-z]?\)\. (?P<t>.+?[.?!]) (?P<j>[^,.]+), (?P<v>\d+)(?:\((?P<i>[^)]+)\))?,? ?(?P<p>[\d–-]+)?", e)
        van = re.match(r"(?P<who>.+?)\. (?P<t>.+?[.?!]) (?P<j>[^.;]+)\. (?P<y>\d{4})[^;]*;(?P<v>\d+)(?:\((?P<i>[^)]+)\))?:?(?P<p>[\w–-]+)?", e)
        m = apa or van
        doi = re.search(r"10\.\d{4,9}/\S+", e)
        if not m:
            yield ({"authors": [], "title": e, "best_effort": True, "year": _year(e), "doi": doi[0].rstrip(".") if doi else None, "page": None}, None) if len(e) > 20 else (None, "not a citation")
            continue
        who = re.split(r", (?=[A-Z][\w'-]+,)|, & | & ", m["who"]) if apa else [re.sub(r"^(.+) ([A-Z]+)$", r"\1, \2", a) for a in m["who"].split(", ")]
        yield _finish({"authors": [_name(a) for a in who], "title": m["t"].rstrip("."), "journal": m["j"].strip(), "year": int(m["y"]), "volume": m["v"], "issue": m["i"], "pages": m["p"], "doi": doi[0].rstrip(".") if doi else None, "best_effort": True})


PARSERS = {"ris": ris, "medline": medline, "bibtex": bibtex, "endnote-xml": endnote_xml, "csl-json": csl_json, "csv": delimited, "tsv": lambda t: delimited(t, "\t"), "citation-list": citation_list}


def screening_export(kind: str, text: str) -> Iterator[dict]:
    """Decisions in exports of screening tools: ``rayyan`` (per reviewer, in notes), ``covidence`` (one per list, named in ``text`` before the first line break), ``eppi`` (codes)."""
    if kind == "rayyan":
        for row in csv.DictReader(io.StringIO(text)):
            for name, decision in re.findall(r'"([^"]+)"\s*=>\s*"(Included|Excluded|Maybe)"', row.get("notes") or ""):
                yield {"title": row.get("title"), "doi": row.get("doi"), "reviewer": name, "stage": "title-abstract", "decision": {"Included": "include", "Excluded": "exclude", "Maybe": "maybe"}[decision]}
    elif kind == "covidence":
        listed, _, rest = text.partition("\n")
        stages = {"irrelevant": {"title-abstract": "exclude"}, "excluded": {"title-abstract": "include", "full-text": "exclude"}, "included": {"title-abstract": "include", "full-text": "include"}}[listed.strip().lower()]
        for row in csv.DictReader(io.StringIO(rest)):
            for stage, decision in stages.items():
                yield {"title": row.get("Title"), "doi": row.get("DOI"), "reviewer": None, "stage": stage, "decision": decision}
    elif kind == "eppi":
        data = json.loads(text)
        types = {a["AttributeId"]: (a.get("AttributeType") or a.get("AttributeName", "")).lower() for s in data.get("CodeSets", []) for a in s.get("Attributes", {}).get("AttributesList", [])}
        for ref in data.get("References", []):
            kinds = {("exclude" if "exclude" in t else "include" if "include" in t else None) for c in ref.get("Codes", []) if (t := types.get(c["AttributeId"], ""))} - {None}
            if kinds:
                yield {"title": ref.get("Title"), "doi": ref.get("DOI"), "reviewer": None, "stage": "title-abstract", "decision": kinds.pop() if len(kinds) == 1 else "maybe"}
    else:
        raise ValueError(kind)
