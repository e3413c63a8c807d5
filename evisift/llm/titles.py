"""Folding of bibliographic titles and names, and the exact comparison of two titles."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

_TAG = re.compile(r"<[^<>]{1,40}>")
_NO_LETTER = re.compile(r"[\W_]+")
#: ASCII letters in lower case and digits; all else becomes a space.
_ASCII = {k: chr(k).lower() if chr(k).isalnum() else " " for k in range(128)}
_MARKS_ON_LETTERS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_BAD = re.compile(r"[â€Ã�]")
_JOINED = re.compile(r"(?<=[a-z])['’](?=[a-z])")
#: What aggregators put behind a title.
_NOISE = re.compile(r"\s*(?:\[[^\]]*\]|\(article in [^)]*\)|full text available\.?|available online\.?)\s*$", re.I)
_ENDS_CUT = re.compile(r"(?:…|\.\.\.|\[\.\.\.\])\s*$")

# Marks by which one publication says it is another one about the same work.
_MARKS = [
    ("correction", re.compile(r"^publisher correction\b|\b(?:correction|corrigendum|erratum)(?: to\b|$)|^(?:correction|corrigendum|erratum)\b")),
    ("retraction", re.compile(r"^(?:retraction|retracted|withdrawn)\b|\b(?:retraction|retracted|expression of concern)$")),
    ("comment", re.compile(r"\b(?:comment|commentary) on\b|\b(?:reply|response) to\b|^(?:comment|commentary|reply|response|letter)\b")),
    ("protocol", re.compile(r"\b(?:study protocol|protocol and analysis plan|protocol for|statistical analysis plan|rationale and design|a protocol|protocol)\b")),
    ("follow", re.compile(r"\b(?:\w+ (?:year|month|week)|long term|extended|longer) (?:follow up|followup|outcomes|results)\b")),
    ("cost", re.compile(r"\b(?:cost analysis|cost effectiveness analysis|economic evaluation|cost utility analysis)\b")),
    ("secondary", re.compile(r"\b(?:secondary analysis|post hoc analysis|subgroup analysis|sub study|substudy|qualitative sub study)\b$")),
    ("edition", re.compile(r"\b(?:\w+ edition|updated? (?:review|edition)|an update)\b")),
]
_MARKING = ("correction", "corrigendum", "retraction", "retracted", "comment", "commentary", "response", "protocol", "erratum", "edition")
_ANY_MARK = re.compile("corr|errat|retract|withdrawn|concern|comment|reply|response|letter|protocol|plan|design|follow|extended|long|cost|economic|secondary|post hoc|sub ?stud|subgroup|edition|update|part ")
_PART = re.compile(r"\bpart (one|two|three|four|i{1,3}|iv|v|\d+)\b")
_NUMBERS = {"one": "1", "two": "2", "three": "3", "four": "4", "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}


@lru_cache(200_000)
def fold(text: str) -> str:
    """The words of a name in lower case, without accents; letters of other scripts stay."""
    return " ".join(text.translate(_ASCII).split()) if text.isascii() else _plain(repair(text))


def _plain(text: str) -> str:
    """The same for a text that is not ASCII: compatibility forms are opened, marks on letters left out."""
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).lower())
    t = _MARKS_ON_LETTERS.sub("", t)
    return _NO_LETTER.sub(" ", t).strip()


def repair(text: str) -> str:
    """Undo UTF-8 read as CP1252, where that is what happened."""
    if "â" in text or "Ã" in text or "Â" in text:
        try:
            return text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            fixed = text.replace("â€œ", '"').replace("â€\x9d", '"').replace("â€“", "-").replace("â€”", "-").replace("â€™", "'").replace("â€˜", "'").replace("Â\xa0", " ").replace("Â ", " ")
            return fixed
    return text


def normal(title: str | None) -> str:
    """A title as folded words: entities, tags, mojibake, ligatures, accents, case and punctuation do not count. Null gives ''."""
    if not title:
        return ""
    t = title
    if "&" in t:
        t = html.unescape(html.unescape(t))
    if "<" in t:
        t = _TAG.sub("", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", repair(t))
    t = t.lower()
    if "'" in t or "’" in t:
        t = _JOINED.sub("", t)
    if t.endswith(("]", ")", "available", "available.", "online")):
        t = _NOISE.sub("", t)
    return " ".join(t.translate(_ASCII).split()) if t.isascii() else _plain(t)


def marks(words: str) -> str:
    """The marks in a folded title, as a sorted text; '' for none."""
    if not _ANY_MARK.search(words):
        return ""
    out = [name for name, p in _MARKS if p.search(words)]
    m = _PART.findall(words)
    if m:
        out.append("part " + _NUMBERS.get(m[-1], m[-1]))
    return ",".join(out)


def close(a: str, b: str, most: int) -> bool:
    """Edit distance (with swaps of neighbours) of at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    k, end = 0, min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    n = 0
    while n < end - k and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[k : len(a) - n], b[k : len(b) - n]
    if len(a) <= 1 and len(b) <= 1 or not a or not b:
        return max(len(a), len(b)) <= most
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return False
        before, row = row, new
    return row[-1] <= most


def unmatched(a: str, b: str) -> tuple[list[str], list[str], int]:
    """Words (of three letters or more) of each title that have no counterpart in the other, up to two slips; and the number matched."""
    left: dict[str, int] = {}
    for w in b.split():
        left[w] = left.get(w, 0) + 1
    only_a, same = [], 0
    for w in a.split():
        if left.get(w, 0):
            left[w] -= 1
            same += len(w) > 2
        elif len(w) > 2:
            only_a.append(w)
    only_b = [w for w, n in left.items() for _ in range(n) if len(w) > 2]
    if only_a and only_b:
        for w in list(only_a):
            hit = next((x for x in only_b if close(w, x, 1 if len(w) < 5 else 2)), None)
            if hit:
                only_a.remove(w)
                only_b.remove(hit)
                same += 1
    return only_a, only_b, same


def marking(words: list[str]) -> bool:
    """Whether one of the words is, up to two slips, one that marks another publication."""
    return any(len(w) > 6 and close(w, m, 2) for w in words for m in _MARKING)


# Signs of damage in a title.
_DANGLING = frozenset("a an and the of in on with for from by to or among versus plus at after".split())
_GARBLED = re.compile(r"�|â€|Ã.|Â|ï¬|&#\d+;|\?{2,}")
_MARKUP = re.compile(r"<[^<>]{1,40}>|&(?:[a-z]{2,8}|#\d+|#x[0-9a-f]+);", re.I)
_NOTE = re.compile(r"\s\((?:article|abstract|author|in |english|german|french|spanish|full text|retracted|withdrawn)[^()]*\)$", re.I)
_OFFERED = re.compile(r"\s(?:(?:full text|abstract|pdf)(?: (?:available|only|online))?|available online|available)$", re.I)


def evident_damage(title: str | None) -> bool:
    """Whether a title shows by itself that it is cut, shouted, garbled, marked up or annotated; a blank one counts as damaged."""
    t = (title or "").strip()
    if not t:
        return True
    if t[:20].isupper() and len(t) > 8:
        letters = [c for c in t if c.isalpha()]
        if len(letters) > 8 and sum(map(str.isupper, letters)) > 0.7 * len(letters):
            return True
    if ("&" in t or "<" in t) and _MARKUP.search(t) or (not t.isascii() or "&#" in t or "??" in t) and _GARBLED.search(t):
        return True
    if t.endswith(("…", "...", ":", "–", " -")):
        return True
    t = t.rstrip(". ")
    last = t[t.rfind(" ") + 1 :].lower()
    if last in _DANGLING:
        return " " in t
    if last.endswith("]"):
        return t.rfind("[") > 0
    if last.endswith(")"):
        return _NOTE.search(t) is not None
    return last in ("text", "abstract", "pdf", "available", "only", "online") and _OFFERED.search(t) is not None
