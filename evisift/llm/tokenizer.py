"""Problem 6: ids of every text by a public byte-level BPE.

Backtracking encoder. All vocabulary strings go into one Aho-Corasick automaton;
one pass over a piece of text gives the longest token at every offset. The encoder
walks forward by longest tokens and takes a token only if it can stand after its
predecessor: the pair is compatible if merging the bytes of both alone gives back
just these two. Compatible neighbours throughout mean the sequence is what the
merge rules give, so the result is exact; a bit for each offset that led nowhere keeps
the walk linear. Shorter choices come from a table of the next shorter prefix token.
Pieces repeat, so their ids are kept in a bounded dictionary of each worker.

Decoding reads one byte string of all tokens through a table of offsets.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_PIECES = 400_000
MEMO_PAIRS = 2_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabulary lies; another path can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


class BacktrackingEncoder:
    """Exact byte-level BPE with ranks read from a file of ``base64 rank`` lines."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import numpy as np
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.machine = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.machine.add_word(t.decode("latin-1"), (i, len(t)))
        self.machine.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        size = max(self.bytes_of) + 1
        lengths = np.zeros(size + 1, dtype=np.int64)
        for i, t in self.bytes_of.items():
            lengths[i + 1] = len(t)
        self.offsets = np.cumsum(lengths)
        self.blob = b"".join(self.bytes_of.get(i, b"") for i in range(size))

    def _merged(self, data: bytes) -> list[int]:
        """The merge rules themselves, for the short strings of the pair table."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.rank
        while len(parts) > 1:
            low, at = min(((rank.get(parts[i] + parts[i + 1], 1 << 40)), i) for i in range(len(parts) - 1))
            if low == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > MEMO_PAIRS:
                self.fits.clear()
            one = self.bytes_of[b]
            known = self.fits[a, b] = self._merged(self.bytes_of[a] + one if a >= 0 else one) == ([a, b] if a >= 0 else [b])
        return known

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            t = self.bytes_of[token]
            self.shorter[token] = next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), None)
        return self.shorter[token]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece that the split pattern gives."""
        whole = self.rank.get(data)
        self_bytes, n = self.bytes_of, len(data)
        if whole is not None and self._alone(whole):
            return [whole]
        longest = [-1] * n
        best = [0] * n
        for end, (token, size) in self.machine.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > best[start]:
                best[start], longest[start] = size, token
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token is not None:
                end = at + len(self_bytes[token])
                if open_at[end] and (self._fits(out[-1], token) if out else self._alone(token)):
                    break
                token = self._shorter(token)
            if token is not None:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(self_bytes[token])
                token = self._shorter(token)
        return out

    def _alone(self, token: int) -> bool:
        return self._fits(-1, token)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or null text has none. A lone surrogate counts as U+FFFD."""
        if not text:
            return []
        out: list[int] = []
        memo = self.memo
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                if len(memo) > MEMO_PIECES:
                    memo.clear()
                ids = self.encode_piece(piece.encode("utf-8", "surrogatepass") if piece.isascii() else piece.encode("utf-8", "replace"))
                if len(piece) < 64:
                    memo[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text of ids, through the table of offsets."""
        o, blob = self.offsets, self.blob
        return b"".join(blob[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


_made: dict[tuple[str, str], BacktrackingEncoder] = {}


def encoder(path: str | None = None, pattern: str | None = None) -> BacktrackingEncoder:
    """The worker's encoder; made once in each Python process."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    path = path or vocabulary_path()
    if (path, pattern) not in _made:
        _made[path, pattern] = BacktrackingEncoder(path, pattern)
    return _made[path, pattern]


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(key, ids)`` of every row of ``docs``, without special tokens.

    A null or empty text gives an empty list; strings of special tokens in a text
    are ordinary text; repeated rows give repeated rows; other columns are ignored.
    A map over partitions: nothing is shuffled, sent to the driver or broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = pa.array([encode(t) for t in part.column(1).to_pylist()], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
