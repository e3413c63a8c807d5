"""Column expressions for bibliographic text; all run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name particles and journal abbreviations of the record key rules.
PARTICLES = ("van", "von", "de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "le", "ter", "ten")
JOURNAL_WORDS = {
    "j": "journal", "ann": "annals", "arch": "archives", "int": "international", "rev": "review", "proc": "proceedings", "am": "american",
    "br": "british", "eur": "european", "med": "medicine", "clin": "clinical", "res": "research", "sci": "science",
}

# Latin letters whose compatibility decomposition starts with an ASCII letter, by rule.
_ACCENTED = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
_PAIRS = [(a, d[0]) for a, d in _ACCENTED if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])]
_FROM, _TO = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)


def strip_accents(c: Column) -> Column:
    """Accented Latin letters without their accents."""
    return F.translate(c, _FROM, _TO)


def unescape(c: Column) -> Column:
    """The five predefined entities, ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def normal_title(c: Column) -> Column:
    """Entities, tags, accents, case and punctuation do not count; single spaces between runs of letters and digits."""
    t = F.lower(strip_accents(strip_tags(unescape(c))))
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def normal_doi(c: Column) -> Column:
    """A DOI without resolver or label and one closing mark, in lower case; null if it is none."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://[^/]+/|doi[: ]\s*)", "")
    t = F.regexp_replace(t, r"[.,;)]$", "")
    return F.when(t.rlike(r"^10\.\d{4,9}/\S+$"), t)


def normal_year(c: Column, as_of_year: int) -> Column:
    """The first run of four digits from 1400 to two years after ``as_of_year``; null if none."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d{4})"), F.lit(1))
    return F.get(F.filter(F.transform(runs, lambda x: x.cast("int")), lambda y: (y >= 1400) & (y <= as_of_year + 2)), F.lit(0))


def first_number(c: Column) -> Column:
    """The first run of digits as text; null if none."""
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit(""))


def digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit(""))


def family_key(c: Column) -> Column:
    """A family name folded, without a leading particle if more than one word is left."""
    # one expression, as it is computed anew at each mention for each author
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9]+", " ")), f"^(?:{'|'.join(PARTICLES)}) ", "")


def journal_key(c: Column) -> Column:
    """A journal title folded, its usual abbreviations written out."""
    table = F.create_map(*[F.lit(x) for kv in JOURNAL_WORDS.items() for x in kv])
    return F.array_join(F.transform(F.split(normal_title(c), " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(0.0))


def base32_id(key: Column, prefix: str = "rec_") -> Column:
    """``prefix`` and the first ten bytes of SHA-256 of the key, in Crockford's base 32, lower case."""
    alphabet = "0123456789abcdefghjkmnpqrstvwxyz"
    bits = F.lpad(F.conv(F.substring(F.sha2(key, 256), 1, 10), 16, 2), 40, "0")
    more = F.lpad(F.conv(F.substring(F.sha2(key, 256), 11, 10), 16, 2), 40, "0")
    both = F.concat(bits, more)
    letters = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substring(F.lit(alphabet), F.conv(F.substring(both, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.concat(F.lit(prefix), F.array_join(letters, ""))


def citation_label(families: Column, year: Column) -> Column:
    """``A (y)``, ``A & B (y)``, ``A et al. (y)`` or ``(no author)``; ``n.d.`` without a year."""
    n = F.size(families)
    who = F.when(n == 1, F.get(families, F.lit(0))).when(n == 2, F.concat_ws(" & ", families)).otherwise(F.concat(F.get(families, F.lit(0)), F.lit(" et al.")))
    return F.when((n < 1) | families.isNull(), F.lit("(no author)")).otherwise(F.concat(who, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")")))


def sha(c: Column) -> Column:
    return F.sha2(c, 256)
