"""Problem 8: the reading level of each document.

Gradient-boosted regression trees, trained here, over distributions of sentence lengths, vocabulary, syntax and cohesion of a document's
English prose. Lists of references, tables, logs, queries and other languages are set aside sentence by sentence. The grade of a word
is the mean level of the labelled documents that hold it. Predictions for the labelled documents come from models that never saw their source
(folds by source); the cut points between levels are set on them, which calibrates the grades.

Distribution: labels are few; a bounded sample of labelled documents (``LABELLED_MOST``, by hash of the key) is joined to the
corpus and reduced to word grades (words of three or more of these documents) and feature vectors, which go to the driver, where the trees are grown. Scoring is one map over the whole corpus,
with arrays over all sentences of a batch of documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("plain", "general", "academic", "specialist")
LABELLED_MOST = 12_000
LEAST_WORDS = 40
FOLDS = 5
TREES, DEPTH, RATE, BINS, LEAF = 120, 4, 0.08, 32, 8

# Frequent function words by language.
ENGLISH = frozenset("the of and to in was were for with is that on are be by from not or an as at it this their they but had have has who which because could may might whether between after where when than we you your all no if some our there would should can will did do does about into only also more most such other than its these those been being among through during under over against without within across per i a he she his her them then so".split())
FOREIGN = frozenset("de la el los las un una que en por con del se para como su al lo más fue le les des du et à aux dans sur est une pas nous ont été par qui au sans der die das und ist nicht mit von zu den dem ein eine wurde wurden auf für im bei nach aus durch oder o os as um uma não foi foram com dos das no na nos nas e y ou sont avec pour cette ces il y los sus é são mais entre sobre cada".split()) - {"a", "in", "no", "as", "on", "is", "do", "an", "me", "i", "so", "per", "sur"} | {"en", "y", "e", "o", "die"}

_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,60}>")
_BREAK = re.compile(r"(?<=[a-z])[-‐]\n(?=[a-z])|[­​‌‍﻿]")
_END = re.compile(r"(?<=[.!?…])[\"”’')\]]*\s+|\n\s*\n|\n(?=\s*(?:[•*\-–#]|\d+[.)])\s)|(?<=</p>)")
_HEAD = re.compile(r"^\s*(?:[•*\-–]|\d+[.)])\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_REFERENCE = re.compile(r"\b(?:19|20)\d\d;\s*\d+|\bdoi:|\bet al\b.*\b(?:19|20)\d\d\b|^\s*\d+\.\s+[A-Z][\w'’-]+ [A-Z]{1,2}[,.]")
_CODE = re.compile(r"[{}]|\"\s*:\s*|\*\.\w\w,|\bexp .*/|^\s*#\d+\b|^\s*\d{4}-\d\d-\d\d[T ]|\||\t.*\t|;.*;.*;|={4,}|\b(?:INFO|WARN|ERROR|DEBUG)\b")
#: Without one of these, or one of a few words, neither of the two patterns above can hold.
_SIGN = re.compile(r"[{}\"*#|\t;=0-9]")
_REFHEAD = re.compile(r"^\s*(?:references|bibliography|literature cited)\s*:?\s*$", re.I | re.M)
_ENTRY = re.compile(r"\b(?:19|20)\d\d\b|^\s*\[?\d+[\].]|\bdoi\b|https?:")
_VOWELS = re.compile(r"[aeiouy]+")


class Prose:
    """Sentences of English prose: folded words and counts of commas, brackets and numbers."""

    __slots__ = ("sentences", "marks", "words")

    def __init__(self, text: str | None):
        self.sentences: list[list[str]] = []
        self.marks: list[tuple[int, int, int]] = []
        self.words = 0
        if not text or not text.strip():
            return
        t = text.replace("\r\n", "\n").replace("\r", "\n")
        if "&" in t:
            t = html.unescape(t)
        if "<" in t:
            t = _TAG.sub("\n\n", re.sub(r"</?(?:b|i|em|strong|sub|sup|u|span|a)\b[^<>]*>", "", t))
        if not t.isascii():
            t = unicodedata.normalize("NFKC", t)
        t = _BREAK.sub("", t)
        refs = _REFHEAD.search(t)
        if refs:
            # entries of the list go, whatever stands behind it stays
            t = t[: refs.start()] + "\n\n" + "\n".join("" if len(x) < 40 or _ENTRY.search(x) else x for x in t[refs.end() :].split("\n"))
        for s in _END.split(t):
            if not s or len(s) < 12:
                continue
            if not s[0].isalpha():
                s = _HEAD.sub("", s)
            if (_SIGN.search(s) or "exp " in s or "doi:" in s or "INFO" in s or "WARN" in s or "ERROR" in s or "DEBUG" in s) and (_CODE.search(s) or _REFERENCE.search(s)):
                # a line of prose may stand next to one that is none
                for line in s.split("\n"):
                    if line.strip() and not (_CODE.search(line) or _REFERENCE.search(line)):
                        self._take(line)
            else:
                self._take(s)

    def _take(self, s: str) -> None:
        low = s.lower()
        w = _WORD.findall(low)
        n = len(w)
        if n < 4:
            return
        own, other = sum(map(ENGLISH.__contains__, w)), sum(map(FOREIGN.__contains__, w))
        latin = n if s.isascii() else sum(map(str.isascii, w))
        if latin < 0.8 * n or other > own or own == 0 or sum(map(len, w)) < 0.5 * len(s.replace(" ", "")):
            return
        commas, brackets, numbers = s.count(","), s.count("("), sum(map(str.isdigit, s))
        # an unpunctuated text is one long sentence; the statistics take stretches of it
        for k in range(0, n, 60):
            part = w[k : k + 60]
            if len(part) >= 4:
                self.sentences.append(part)
                f = len(part) / n
                self.marks.append((round(commas * f), round(brackets * f), round(numbers * f)))
                self.words += len(part)


def _spread(x: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Weighted mean, deviation and quantiles of each document's values (docs x 7); rows of a document stand together, in order of documents."""
    total = np.bincount(doc, weight, docs)
    mean = np.bincount(doc, x * weight, docs) / total
    var = np.bincount(doc, (x - mean[doc]) ** 2 * weight, docs) / total
    order = np.lexsort((x, doc))
    run = np.cumsum(weight[order])
    before = np.cumsum(total) - total
    last = np.cumsum(np.bincount(doc, minlength=docs)) - 1
    q = [x[order[np.minimum(np.searchsorted(run, before + p * total - 1e-9), last)]] for p in (0.1, 0.25, 0.5, 0.75, 0.9)]
    return np.stack([mean, np.sqrt(var), *q], 1)


def _distinct(first: np.ndarray, second: np.ndarray, most: int) -> np.ndarray:
    """Sorted distinct pairs of numbers as one number each; ``second`` is below ``most``."""
    return np.unique(first.astype(np.int64) * most + second)


def features(proses: list[Prose], grades: dict[str, float]) -> np.ndarray:
    """The feature vectors of documents with prose, one row each. All sentences of all documents lie in one array, reduced at their starts."""
    flat = [w for p in proses for s in p.sentences for w in s]
    words = list(set(flat))
    number = dict(zip(words, range(len(words))))
    at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    length = np.fromiter(map(len, words), float, len(words))
    vowels = np.array([max(1, len(_VOWELS.findall(w))) for w in words], float)
    english = np.fromiter(map(ENGLISH.__contains__, words), bool, len(words))
    grade = np.array([grades.get(w, np.nan) for w in words], float)
    known = ~np.isnan(grade)
    docs = len(proses)
    n = np.array([len(s) for p in proses for s in p.sentences], float)
    doc = np.repeat(np.arange(docs), [len(p.sentences) for p in proses])
    start = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)

    def per(value: np.ndarray) -> np.ndarray:
        return np.add.reduceat(value[at], start)

    marks = np.array([m for p in proses for m in p.marks], float)
    graded = per(known.astype(float))
    g = np.where(graded > 0, per(np.where(known, grade, 0.0)) / np.maximum(graded, 1), 1.5)
    mean_length = per(length) / n
    columns = [n, mean_length, per((length >= 7).astype(float)) / n, per((length >= 11).astype(float)) / n, np.maximum.reduceat(length[at], start), per(vowels) / n, per(english.astype(float)) / n, *(marks / n[:, None]).T, g]
    out = [_spread(c, np.ones(len(n)) if k == 0 else n, doc, docs) for k, c in enumerate(columns)]
    # shares of the prose by the grade of its sentences and by length of words
    total = np.bincount(doc, n, docs)
    bands = [(g, lo, 0.3) for lo in np.arange(0.0, 3.0, 0.3)] + [(mean_length, lo, 0.75) for lo in np.arange(3.0, 9.0, 0.75)]
    out.append(np.stack([np.bincount(doc, n * ((x >= lo) & (x < lo + wide)), docs) / total for x, lo, wide in bands], 1))
    # content words that a sentence shares with the next one of its document
    sentence = np.repeat(np.arange(len(n)), n.astype(np.int64))
    content = _distinct(sentence[~english[at]], at[~english[at]], len(words))
    size = np.bincount(content // len(words), minlength=len(n)) if len(content) else np.zeros(len(n), np.int64)
    again = content[np.isin(content + len(words), content, assume_unique=True)]
    common = np.bincount(again // len(words), minlength=len(n)) if len(again) else np.zeros(len(n), np.int64)
    next_ = np.flatnonzero(doc[1:] == doc[:-1])
    link = common[next_] / np.maximum(1, np.minimum(size[next_], size[next_ + 1]))
    links = np.bincount(doc[next_], link, docs) / np.maximum(1, np.bincount(doc[next_], minlength=docs))
    kinds = np.bincount(_distinct(doc[sentence], at, len(words)) // len(words), minlength=docs) / total
    out.append(np.stack([links, kinds, np.log(total), total / np.bincount(doc, minlength=docs)], 1))
    return np.concatenate(out, 1)


class Trees:
    """Boosted regression trees on binned features, squared loss."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1)
        self.base, (n, f) = float(y.mean()), x.shape
        flat = b + np.arange(f) * BINS
        pred = np.full(n, self.base)
        self.nodes = []
        for _ in range(self.trees):
            r, node = y - pred, np.zeros(n, np.int64)
            splits = {}
            value = {0: 0.0}
            live = [0]
            for _level in range(self.depth):
                grown = []
                for k in live:
                    idx = np.flatnonzero(node == k)
                    if len(idx) < 2 * LEAF:
                        continue
                    cells = flat[idx].ravel()
                    cnt = np.bincount(cells, minlength=f * BINS).reshape(f, BINS).cumsum(1)
                    tot = np.bincount(cells, np.repeat(r[idx], f), f * BINS).reshape(f, BINS).cumsum(1)
                    nl, sl = cnt[:, :-1], tot[:, :-1]
                    nr, sr = len(idx) - nl, r[idx].sum() - sl
                    gain = np.where((nl >= LEAF) & (nr >= LEAF), sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1), -np.inf)
                    j = int(gain.argmax())
                    if gain.flat[j] <= r[idx].sum() ** 2 / len(idx) + 1e-9:
                        continue
                    c, e = divmod(j, BINS - 1)
                    splits[k] = (c, e)
                    right = b[idx, c] > e
                    node[idx] = np.where(right, 2 * k + 2, 2 * k + 1)
                    grown += [2 * k + 1, 2 * k + 2]
                live = grown
            for k in np.unique(node):
                idx = node == k
                value[int(k)] = float(self.rate * r[idx].sum() / (idx.sum() + 1.0))
                pred[idx] += value[int(k)]
            self.nodes.append((splits, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1)
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.nodes:
            # a full tree of arrays: a node that is not split hands its value down to the left
            n = 2**self.depth - 1
            column, edge, leaf = np.zeros(n, np.int64), np.full(n, BINS), np.zeros(2 * n + 1)
            for k in range(2 * n + 1):
                if k in value:
                    leaf[k] = value[k]
                if k < n:
                    if k in splits:
                        column[k], edge[k] = splits[k]
                    else:
                        leaf[2 * k + 1] = leaf[k]
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[row, column[node]] > edge[node])
            out += leaf[node]
        return out


def cut_points(pred: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The three cuts between levels that name most held-out documents rightly; for each pair of neighbours, halfway among equally good ones."""
    cuts = []
    for k in range(len(LEVELS) - 1):
        lo, hi = pred[level <= k], pred[level > k]
        grid = np.linspace(k, k + 1, 101)
        if len(lo) and len(hi):
            wrong = np.array([(lo > g).sum() + (hi <= g).sum() for g in grid]) + 1e-3 * np.abs(grid - k - 0.5)
            cuts.append(float(grid[wrong.argmin()]))
        else:
            cuts.append(k + 0.5)
    return np.maximum.accumulate(np.array(cuts))


class Reader:
    """A fitted model: grades of words, trees, cut points; ``held_out`` accuracy against single labels."""

    def __init__(self, grades: dict[str, float], trees: Trees, cuts: np.ndarray, held_out: float):
        self.grades, self.trees, self.cuts, self.held_out = grades, trees, cuts, held_out

    def levels(self, texts: list[str | None]) -> tuple[list[int], list[int], list[float]]:
        """Of each text: words of prose, level (-1 if too few words), grade."""
        prose = [Prose(t) for t in texts]
        at = [k for k, p in enumerate(prose) if p.words >= LEAST_WORDS]
        level, grade = [-1] * len(texts), [float("nan")] * len(texts)
        if at:
            pred = self.trees.predict(features([prose[k] for k in at], self.grades))
            for k, g in zip(at, pred):
                level[k], grade[k] = int(np.searchsorted(self.cuts, g)), float(g)
        return [p.words for p in prose], level, grade


def train(docs: DataFrame, labels: DataFrame) -> Reader | None:
    """Fit to the labelled documents; None if fewer than two have prose and a known level."""
    code = F.create_map(*[x for k, s in enumerate(LEVELS) for x in (F.lit(s), F.lit(float(k)))])
    y = labels.where("doc_id is not null").select("doc_id", F.try_element_at(code, F.lower(F.trim("level_name"))).alias("y")).where("y is not null")
    y = y.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_MOST)
    # the bound makes the labelled side small enough to be sent to every task
    chosen = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")).join(F.broadcast(y), "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [sorted({w for s in Prose(t).sentences for w in s}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("y"), pa.array(held, pa.list_(pa.string()))], names=["fold", "y", "words"])

    per = chosen.mapInArrow(words, "fold int, y double, words array<string>").select("fold", "y", F.explode("words").alias("w")).groupBy("w", "fold").agg(F.count("y").alias("n"), F.sum("y").alias("s"))
    top = per.groupBy("w").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "s")))).alias("by")).where("n >= 3")
    vocab = {r["w"]: (r["n"], r["s"], {k: (v["n"], v["s"]) for k, v in r["by"].items()}) for r in top.collect()}
    mean = y.agg(F.avg("y")).first()[0]
    if mean is None:
        return None

    def graded(without: int | None) -> dict[str, float]:
        out = {}
        for w, (n, s, by) in vocab.items():
            cut = by.get(without, (0, 0.0))
            out[w] = (s - cut[1] + 4 * mean) / (n - cut[0] + 4)
        return out

    by_fold = [graded(k) for k in range(FOLDS)]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, v, p) for t, f, v in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), b.column("y").to_pylist()) if (p := Prose(t)).words >= LEAST_WORDS]
            for f in sorted({r[0] for r in rows}):  # each fold with the word grades that leave it out
                own = [r for r in rows if r[0] == f]
                x = features([r[2] for r in own], by_fold[f]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(own), pa.int32()), pa.array([r[1] for r in own], pa.float64()), pa.array(x, pa.list_(pa.float64()))], names=["fold", "y", "x"])

    data = chosen.mapInArrow(vectors, "fold int, y double, x array<double>").toPandas()
    if len(data) < 2:
        return None
    x, y_, fold = np.array(data["x"].tolist()), data["y"].to_numpy(), data["fold"].to_numpy()
    order = np.lexsort((*x.T[:3], y_, fold))
    x, y_, fold = x[order], y_[order], fold[order]
    held = np.full(len(y_), y_.mean())
    for k in np.unique(fold):
        rest = fold != k
        if rest.sum() >= 4 * LEAF:
            held[~rest] = Trees().fit(x[rest], y_[rest]).predict(x[~rest])
    level = np.rint(y_).astype(int)
    cuts = cut_points(held, level)
    return Reader(graded(None), Trees().fit(x, y_), cuts, float((np.searchsorted(cuts, held) == level).mean()))


def reading_levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, level_name, grade, words)`` of every document with ``LEAST_WORDS`` or more words of English prose.

    Null, empty and blank texts, and texts of lists, tables, logs, references or other languages, give no row; nor does anything if
    no labelled document has prose. Two labels of one document count with their mean. Texts are read whole.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, level_name string, grade double, words int"
    reader = train(docs, labels)
    if reader is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                words, level, grade = reader.levels(b.column("text").to_pylist())
                keep = [k for k, x in enumerate(level) if x >= 0]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([LEVELS[level[k]] for k in keep], pa.string()), pa.array([grade[k] for k in keep], pa.float64()), pa.array([words[k] for k in keep], pa.int32())],
                    names=["doc_id", "level_name", "grade", "words"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
