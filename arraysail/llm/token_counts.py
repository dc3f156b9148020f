"""Token counts of byte-pair tokenizers by merging on a heap and a linked list.

A piece of text starts as its bytes in a doubly linked list; the adjacent pair
of lowest rank is popped from a heap and merged until none is left. The count
is the number of bytes less the merges; no ids are made. Counts of stretches
that occur again are kept in a bounded table.
"""

from __future__ import annotations

import base64
import os
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraysail.llm import _common as C

RANKS = os.environ.get("ARRAYSAIL_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merging never crosses from other characters to one of these, so texts can be cut there.
_CUT = regex.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space beyond these four may form one run with them, and those texts aren't cut.
_OTHER_SPACE = regex.compile(r"[^\S \n\t\r]|[\x1c-\x1f\x85]")
_HELD = 250_000


class Counter:
    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(pattern).findall
        self.pieces = C.Memo(self.count_piece, _HELD)
        self.stretches = C.Memo(self._stretch, _HELD)

    def count_piece(self, piece: str) -> int:
        """Symbols of one piece less its merges."""
        b = piece.encode("utf-8", "replace")
        n, ranks = len(b), self.ranks
        if n < 2 or b in ranks:
            return min(n, 1)
        end = list(range(1, n + 1))  # end[i]: where the symbol that starts at i stops; 0 once it is merged
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(b[i : i + 2])) is not None]
        heapify(heap)
        count = n
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            count -= 1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(b[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(b[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        return count

    def _stretch(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.words(text)))

    def count(self, text: str) -> int:
        if _OTHER_SPACE.search(text):
            return self._stretch(text)
        return sum(map(self.stretches.__getitem__, _CUT.findall(text)))


_COUNTERS: dict = {}


def counter(path: str = RANKS, pattern: str = PATTERN) -> Counter:
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = Counter(path, pattern)
    return _COUNTERS[path, pattern]


def counts(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every row.

    Null and empty texts have no tokens. Texts are ordinary text throughout;
    strings of special tokens are not special. Repeated rows give a row each;
    whole texts are read, other columns ignored; an empty table gives an empty result.
    """

    def f(text: pa.Array) -> pa.Array:
        count = counter(ranks, pattern).count
        return pa.array(C.by_slices(text, lambda texts: [count(t) if t else 0 for t in texts]), pa.int64())

    return docs.select("doc_id", F.arrow_udf(f, "long").asNondeterministic()("text").alias("n_tokens"))
