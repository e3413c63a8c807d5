"""Problem 7: evaluation texts that leaked into a corpus.

Wu-Manber multi-pattern search over words. Patterns are all runs of five words of the held-out items. A block of two
words at the end of the window gives the shift; where no pattern ends in the block the search skips ahead, otherwise the
bucket of the block holds the patterns to compare. Found runs are the candidates; an item's sentence then counts as
taken over if it can be laid over the document so that its telling words agree: words weigh by their rarity in the corpus,
as texts of one kind share phrases, and a sentence all of whose runs are common in the corpus is a stock sentence.

Distribution: one map over the corpus folds and searches every text and writes what it found; the folded words stay only of documents with a run of an item.
From this table come, for the words and runs of the items, the numbers of distinct texts
that hold them (patterns of a text meet by its hash, then partial sums per task, one number a pattern), for runs of many texts the numbers of
distinct surroundings they stand in, and the decision on each document. The items travel with the tasks, in blocks of at most ``BLOCK_WORDS`` words,
so their size is bounded; each block is another pass. No pair of documents is formed.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.plans.lineage import Workspace

RUN = 5
BLOCK_WORDS = 2_000_000
#: Least words taken over.
WORDS = 24
#: Words found in place that are enough, as up to a tenth may be changed.
FOUND = 22
#: A run is rare if at most this share of distinct texts (and at least so many) hold it, or if it stands in at most so many different surroundings:
#: copies of a document count once, and a passage that was copied into many documents brings the sentences around it along, which a stock sentence does not.
RARE_SHARE, RARE_LEAST = 0.002, 4
#: Words looked at on each side of a sentence.
AROUND = 3
#: Least share of the weight of a sentence's words that must agree where it lies over the document.
AGREE = 0.82
#: Least share of each sentence of those that stand one behind the other, and their least average, for three or more and for two.
LIKE, EDITED, EDITED_TWO = 0.55, 0.7, 0.85

_TAG = re.compile(r"<[^<>\n]{1,60}>")
_BREAK = re.compile(r"(?<=[a-z])[-‐]\s*\n\s*(?=[a-z])|[­​‌‍﻿]")
_WORD = re.compile(r"[^\W_]+")
_MARKS_ON_LETTERS = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.combining(c)) + "]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def words_of(text: str | None) -> list[str]:
    """Folded words: typesetting (case, punctuation, markup, entities, ligatures, accents, broken lines) does not count."""
    if not text:
        return []
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    t = t.lower()
    if not t.isascii():
        t = _MARKS_ON_LETTERS.sub("", unicodedata.normalize("NFKD", t))
    return _WORD.findall(_BREAK.sub("", t))


class Patterns:
    """Sentences of items, their runs of words, and the tables of the search."""

    def __init__(self, items: list[tuple[str, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[str] = []
        self.sentences: list[tuple[int, list[int]]] = []  # (item, word numbers)
        runs: dict[tuple[int, ...], int] = {}
        self.where: list[list[tuple[int, int]]] = []  # of each run: (sentence, position)
        for item, text in items:
            self.items.append(item)
            for s in _SENTENCE.split(text):
                w = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words_of(s)]
                if len(w) < RUN:
                    continue
                k = len(self.sentences)
                self.sentences.append((len(self.items) - 1, w))
                for p in range(len(w) - RUN + 1):
                    r = runs.setdefault(tuple(w[p : p + RUN]), len(runs))
                    if r == len(self.where):
                        self.where.append([])
                    self.where[r].append((k, p))
        self.n_runs = len(runs)
        # the same by item, and the places and lengths alone, as many items share a stock sentence
        self.of_item: list[dict[int, list[tuple[int, int]]]] = []
        self.spots: list[list[tuple[int, int]]] = []
        for places in self.where:
            mine: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for k, q in places:
                mine[self.sentences[k][0]].append((k, q))
            self.of_item.append(dict(mine))
            self.spots.append(sorted({(q, len(self.sentences[k][1])) for k, q in places}))
        size = self.size = len(self.vocabulary) + 1
        # shifts by block of two words; zero where a run ends in the block, whose bucket maps the words before it to the run
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        for run, r in runs.items():
            for q in range(1, RUN):
                block = run[q - 1] * size + run[q]
                self.shift[block] = min(self.shift.get(block, RUN), RUN - 1 - q)
            self.bucket[run[-2] * size + run[-1]][run[:-2]] = r
        self.bucket = dict(self.bucket)

    def numbers(self, text: str | None) -> list[int]:
        """Word numbers of a document; words that no item has share one number."""
        return self.numbered(words_of(text))

    def numbered(self, words: list[str]) -> list[int]:
        get, other = self.vocabulary.get, len(self.vocabulary)
        return [get(w, other) for w in words]

    def search(self, w: list[int]) -> list[tuple[int, int]]:
        """(position, run) of every run of the items in the document."""
        out, shift, bucket, size, far = [], self.shift.get, self.bucket, self.size, RUN - 1
        p, n = RUN - 1, len(w)
        while p < n:
            block = w[p - 1] * size + w[p]
            step = shift(block, far)
            if step:
                p += step
                continue
            r = bucket[block].get(tuple(w[p - RUN + 1 : p - 1]))
            if r is not None:
                out.append((p - RUN + 1, r))
            p += 1
        return out


def _most_rare(n: int) -> float:
    """Most texts, of ``n``, or surroundings of a rare run."""
    return max(RARE_LEAST, RARE_SHARE * n)


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def searched(docs: DataFrame, patterns: Patterns, key: str, text: str) -> DataFrame:
    """What the items' patterns find in each text with words: ``key, hash, has`` (numbers of item words and, behind them, of runs; null for a text that the task has met), and for texts with a run ``words``, ``at`` and ``run``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task counts a text once, so a group of copies, however large, sends few rows to its bucket
        seen: set[int] = set()
        for batch in batches:
            row, rows = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                words = words_of(t)
                if not words:
                    continue
                h = _hash(words)
                w = patterns.numbered(words)
                hits = patterns.search(w)
                has = None if h in seen else [0, *(1 + x for x in set(w)), *{1 + patterns.size + r for _, r in hits}]
                seen.add(h)
                row.append(k)
                rows.append((h, has, " ".join(words) if hits else None, [p for p, _ in hits], [r for _, r in hits]))
            cols = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(list(c), x) for c, x in zip(cols, types)]], names=["key", "hash", "has", "words", "at", "run"])

    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, hash bigint, has array<int>, words string, at array<int>, run array<int>")


def corpus_counts(found: DataFrame, patterns: Patterns) -> tuple[int, np.ndarray, np.ndarray]:
    """Numbers of distinct texts (``found``: of :func:`searched`): with words, with each item word, with each item run; of a run in many texts the number of surroundings if that is less."""
    size = 1 + patterns.size + patterns.n_runs

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        all_ = np.zeros(size, np.int64)
        for batch in batches:
            for h, has in zip(batch.column(0).to_pylist(), batch.column(1)):
                if h not in seen:
                    seen.add(h)
                    all_[has.values.to_numpy()] += 1
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(all_[at])], names=["at", "n"])

    texts = found.where("has is not null").select("hash", "has").repartition("hash")
    got = texts.mapInArrow(once, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    all_ = np.zeros(size, np.int64)
    all_[got["at"].to_numpy()] = got["n"].to_numpy()
    n, words, runs = int(all_[0]), all_[1 : 1 + patterns.size], all_[1 + patterns.size :]
    often = np.flatnonzero(runs > _most_rare(n))
    if len(often):
        around = surroundings(found, patterns, set(often.tolist()))
        runs[often] = np.minimum(runs[often], around[often])
    return n, words, runs


def surroundings(found: DataFrame, patterns: Patterns, runs: set[int]) -> np.ndarray:
    """For each of ``runs``, the number of different words around the sentence it belongs to, as this lies in the documents.

    Where a document begins or ends with the sentence, the document's text stands for what is around it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for h, text, ats, rs in zip(*(c.to_pylist() for c in batch.columns)):
                words, whole, place = None, [str(h)], {}
                for at, r in zip(ats, rs):
                    if r not in runs:
                        continue
                    words = words or text.split(" ")
                    for q, n in patterns.spots[r]:
                        lo, hi = at - q, at - q + n
                        if (lo, hi) not in place:
                            before = words[max(0, lo - AROUND) : lo] if lo > 0 else whole
                            place[lo, hi] = _hash([*before, "|", *(words[hi : hi + AROUND] or whole)])
                        out.add((r, place[lo, hi]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.int64())], names=["run", "place"])

    got = found.where("words is not null").select("hash", "words", "at", "run").mapInArrow(run, "run int, place bigint").distinct().groupBy("run").count().toPandas()
    out = np.zeros(patterns.n_runs, np.int64)
    out[got["run"].to_numpy()] = got["count"].to_numpy()
    return out


class Judge:
    """Decides, given the corpus counts, how many words of an item stand in a document."""

    def __init__(self, patterns: Patterns, n: int, words: np.ndarray, runs: np.ndarray):
        self.p = patterns
        self.weight = np.log((n + 1) / (words + 0.5)).clip(0.05).tolist()
        self.rare = (runs <= _most_rare(n)).tolist()

    @staticmethod
    def _window(sentence: list[int], w: list[int], at: int) -> list[int]:
        """The part of a document over which a sentence that seems to begin at ``at`` is laid."""
        return w[max(0, at - 4) : max(0, at + len(sentence) + 6)]

    def laid_over(self, sentence: list[int], w: list[int], at: int) -> tuple[int, float, int, int]:
        """The sentence over the document around ``at``: words found in order, the share of weight that agrees between the
        first and last of them, and where in the document these stand."""
        lo, window = max(0, at - 4), self._window(sentence, w, at)
        blocks = [b for b in SequenceMatcher(None, sentence, window, autojunk=False).get_matching_blocks() if b.size]
        # single words far from the rest are chance, not the ends of a copied part
        while len(blocks) > 1 and blocks[0].size == 1 and blocks[1].a - blocks[0].a > 2:
            blocks.pop(0)
        while len(blocks) > 1 and blocks[-1].size == 1 and blocks[-1].a - blocks[-2].a - blocks[-2].size > 1:
            blocks.pop()
        if not blocks:
            return 0, 0.0, 0, 0
        weight = self.weight
        found = sum(b.size for b in blocks)
        got = sum(weight[sentence[i]] for b in blocks for i in range(b.a, b.a + b.size))
        share = got / sum(weight[x] for x in sentence[blocks[0].a : blocks[-1].a + blocks[-1].size])
        return found, share, lo + blocks[0].b, lo + blocks[-1].b + blocks[-1].size

    def _goes_on(self, a: int, b: int, parts: dict[int, tuple[int, float, int, int]]) -> bool:
        """Whether sentence ``b`` of the item follows ``a`` in the document too."""
        return self.p.sentences[a][0] == self.p.sentences[b][0] and min(parts[a][1], parts[b][1]) >= LIKE and abs(parts[b][2] - parts[a][3]) <= 5

    def leaked(self, text: str | None) -> list[tuple[str, int]]:
        """(item, words taken over) of the items that leaked into the text."""
        words = words_of(text)
        return self.found(" ".join(words), self.p.search(self.p.numbered(words)))

    def found(self, words: str, hits: list[tuple[int, int]]) -> list[tuple[str, int]]:
        """The same of folded words with single spaces between them and the runs found in them."""
        p = self.p
        items = {i for _, r in hits if self.rare[r] for i in p.of_item[r]}
        if not items:
            return []
        w = p.numbered(words.split(" "))
        if len(w) < FOUND:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        rare: dict[int, list[int]] = defaultdict(list)
        for at, r in hits:
            mine = p.of_item[r]
            for i in items if len(items) < len(mine) else [i for i in mine if i in items]:
                for k, q in mine.get(i, ()):
                    starts[k].add(at - q)
                    if self.rare[r]:
                        rare[k].append(at)
        # words of a sentence that stand near one of its places bound what can be found there; an item that cannot reach enough is not laid over
        most: Counter = Counter()
        for k, ats in starts.items():
            s = p.sentences[k][1]
            most[p.sentences[k][0]] += max(sum(map(set(self._window(s, w, at)).__contains__, s)) for at in ats)
        parts, agree = {}, []
        for k, ats in starts.items():
            if most[p.sentences[k][0]] < FOUND:
                continue
            places = [self.laid_over(p.sentences[k][1], w, at) for at in ats]
            parts[k] = max(places)
            # the place with most words may agree less than another one; a place counts by itself if a rare run lies in it
            agree += [(x[0], k, x[2], x[3]) for x in set(places) if x[1] >= AGREE and any(x[2] <= at <= x[3] - RUN for at in rare[k])]
        # words of each sentence that are taken over; a part of the document counts for one sentence of an item only
        got: dict[int, int] = {}
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, k, lo, hi in sorted(agree, reverse=True):
            used = spans[p.sentences[k][0]]
            if k not in got and all(2 * (min(hi, y) - max(lo, x)) <= hi - lo for x, y in used):
                got[k] = n
                used.append((lo, hi))
        # neighbours that stand one behind the other in the document as in the item were copied together, even if much edited
        # or, as a cut first or last part, without a telling word
        for k in sorted(parts):
            if k - 1 in parts and self._goes_on(k - 1, k, parts):
                continue
            chain = [k]
            while chain[-1] + 1 in parts and self._goes_on(chain[-1], chain[-1] + 1, parts):
                chain.append(chain[-1] + 1)
            if len(chain) > 1 and any(rare[c] for c in chain):
                if sum(parts[c][1] for c in chain) >= (EDITED if len(chain) > 2 else EDITED_TWO) * len(chain):
                    # stock sentences at full length do not count in a chain either
                    for c in chain:
                        if rare[c] or parts[c][0] < len(p.sentences[c][1]):
                            got[c] = max(got.get(c, 0), parts[c][0])
        taken: Counter = Counter()
        for k, n in got.items():
            taken[p.sentences[k][0]] += n
        return [(p.items[i], n) for i, n in taken.items() if n >= FOUND]


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, item_id, words)``: documents that hold at least ``WORDS`` words of an item, each pair once.

    Null and empty texts hold nothing; an item with a null key or text leaks nowhere; repeated rows count once. Long texts are searched whole.
    """
    spark = docs.sparkSession
    rows = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("string"), item_text).distinct().orderBy(item, item_text)
    kind, out, block, size = docs.schema[key].dataType.simpleString(), None, [], 0
    for r in [*rows.toLocalIterator(), None]:
        if r is not None:
            block.append((r[0], r[1]))
            size += len(r[1].split())
        if block and (r is None or size >= BLOCK_WORDS):
            found = _leaks(docs, Patterns(block), key, text, kind)
            out, block, size = found if out is None else out.unionByName(found), [], 0
    if out is None:
        return spark.createDataFrame([], f"{key} {kind}, item_id string, words int")
    return out.groupBy(key, "item_id").agg(F.max("words").alias("words"))


def _leaks(docs: DataFrame, patterns: Patterns, key: str, text: str, kind: str) -> DataFrame:
    ws = Workspace(docs.sparkSession, "leakage")
    table = ws.write(searched(docs, patterns, key, text), "searched")
    with ws.tidy():
        judge = Judge(patterns, *corpus_counts(table, patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, item, n = [], [], []
            for k, (words, at, r) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                for i, x in judge.found(words, list(zip(at, r))):
                    row.append(k)
                    item.append(i)
                    n.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.string()), pa.array(n, pa.int32())], names=["key", "item_id", "words"])

    hit = table.where("words is not null").select("key", "words", "at", "run")
    return hit.mapInArrow(run, f"key {kind}, item_id string, words int").withColumnRenamed("key", key)
