"""SentencePiece encoding and decoding with a suffix array over the batch.

The texts of a batch are cut where no piece can cross (before a run of spaces,
around characters that no piece holds) and the distinct stretches are
concatenated. Their suffixes are sorted by as many characters as the longest
piece has; every piece of the vocabulary is binary-searched for its range of
occurrences; each occurrence is an edge. The edges are sorted by their end and
relaxed for all stretches at once: an edge extends the encoding of the prefix
before it when its piece and the last one of that prefix are what the model
makes of the two together, which holds for exactly one edge at each end. So the
result is the model's own merge order, not just a best path.
"""

from __future__ import annotations

import heapq
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraysail.llm import _common as C

MODEL = os.environ.get("ARRAYSAIL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "\u2581"
#: Stretches that are held at most, and indexed at once.
MOST_HELD, AT_ONCE = 300_000, 15_000


def _fields(b: bytes):
    """(field number, value) of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        x = s = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << s
            s += 7
            if c < 128:
                return x

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            value = b[i : i + n]
            i += n
        yield key >> 3, value


class Model:
    """The pieces of a merge model: text, score and kind (1 ordinary, 2 unknown, 3 control, 6 byte)."""

    def __init__(self, path: str = MODEL):
        self.text, score, kind = [], [], []
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self._check(dict(fields))
        for field, piece in fields:
            if field == 1:
                got = dict(_fields(piece))
                self.text.append(got[1].decode())
                score.append(float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]))
                kind.append(got.get(3, 1))
        if unread := set(kind) - {1, 2, 3, 6}:
            raise ValueError(f"pieces of kinds {sorted(unread)} (user-defined or unused) are not supported")
        self.kind, self.score = np.array(kind), score
        self.id = {t: i for i, t in enumerate(self.text) if kind[i] == 1}
        self.byte = np.full(256, -1)
        for i, t in enumerate(self.text):
            if kind[i] == 6:
                self.byte[int(t[3:5], 16)] = i
        self.unknown = kind.index(2)
        self.length = np.array([len(t) if k == 1 else 0 for t, k in zip(self.text, kind)] + [0])
        self.longest = int(self.length.max())
        self.chars = set("".join(self.id))
        self.ordinary = np.flatnonzero((self.kind == 1) & (self.length[:-1] > 0))
        self.code = np.zeros((len(self.ordinary), self.longest), np.int64)
        for row, i in enumerate(self.ordinary):
            t = self.text[i]
            self.code[row, : len(t)] = [ord(c) for c in t]
        self.out = [t.encode() if k == 1 else bytes([int(t[3:5], 16)]) if k == 6 else " \u2047 ".encode() if k == 2 else b"" for t, k in zip(self.text, kind)]

    @staticmethod
    def _check(fields: dict) -> None:
        """Refuses models whose training or normaliser settings would give other ids than these functions do."""
        trainer, normaliser = dict(_fields(fields.get(2, b""))), dict(_fields(fields.get(3, b"")))
        for wrong, what in (
            (trainer.get(3, 1) != 2, "models that don't merge pairs"),
            (trainer.get(24, 0), "white space as a suffix"),
            (normaliser.get(2, b""), "normalisers other than identity"),
            (not normaliser.get(3, 1), "models without a space before the text"),
            (normaliser.get(4, 1), "removal of extra white space"),
            (not normaliser.get(5, 1), "white space that is not escaped"),
        ):
            if wrong:
                raise ValueError(f"{what} are not supported")

    def merge(self, text: str) -> list[str]:
        """The model's merges, one best pair after the other (the first of equals); the plain way, for pairs and tests."""
        parts: list = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list = []

        def offer(i, j):
            if i >= 0 and j < len(parts) and (p := self.id.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.score[p], i, j, len(parts[i]) + len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, n = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or len(parts[i]) + len(parts[j]) != n:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte[0] >= 0:
                out += [int(self.byte[b]) for b in p.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


class Pairs:
    """Which pairs of pieces stay apart, in an open hash table that numpy probes."""

    def __init__(self, model: Model, bits: int = 20):
        self.model, self.size = model, 0
        self.key, self.ok, self.mask = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool), (1 << bits) - 1
        self.alone = np.array([k == 1 and len(t) > 0 and (len(t) == 1 or model.merge(t) == [t]) for t, k in zip(model.text, model.kind)])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        at = (key * 0x9E3779B97F4A7 >> 15) & self.mask
        todo = np.arange(len(key))
        while len(todo):
            k = self.key[at[todo]]
            todo = todo[(k != -1) & (k != key[todo])]
            at[todo] = (at[todo] + 1) & self.mask
        return at

    def _add(self, keys: np.ndarray) -> None:
        text, merge = self.model.text, self.model.merge
        new = np.fromiter((merge(text[k >> 20] + text[k & 0xFFFFF]) == [text[k >> 20], text[k & 0xFFFFF]] for k in keys.tolist()), bool, len(keys))
        while 2 * (self.size + len(keys)) > len(self.key):
            old = self.key >= 0
            k, v, size = self.key[old], self.ok[old], self.size
            self.key, self.ok, self.mask, self.size = np.full(2 * len(self.key), -1, np.int64), np.zeros(2 * len(self.key), bool), 2 * self.mask + 1, 0
            self._put(k, v)
            assert self.size == size
        self._put(keys, new)

    def _put(self, keys, values):
        mask, table, ok = self.mask, self.key, self.ok
        for k, a, v in zip(keys.tolist(), ((keys * 0x9E3779B97F4A7 >> 15) & mask).tolist(), values.tolist()):
            while table[a] != -1:
                a = (a + 1) & mask
            table[a], ok[a] = k, v
        self.size += len(keys)

    def apart(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = self.alone[p]
        inner = np.flatnonzero(out & (q >= 0))
        key = (q[inner].astype(np.int64) << 20) | p[inner]
        at = self._slot(key)
        if (new := self.key[at] == -1).any():
            self._add(np.unique(key[new]))
            at = self._slot(key)
        out[inner] = self.ok[at]
        return out


def _bounds(keys: list[np.ndarray], wanted: list[np.ndarray], past: bool) -> np.ndarray:
    """For each wanted tuple of keys, how many of the sorted tuples are less (or, ``past``, not greater)."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k, w in zip(keys, wanted):
            a, b = k[mid], w[open_]
            less |= same & (a < b)
            same &= a == b
        if past:
            less |= same
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


class Encoder:
    def __init__(self, path: str = MODEL):
        self.model = Model(path)
        self.pairs = Pairs(self.model)
        self.local = np.zeros(0x110000, np.int64)
        # white space that is in no longer piece stands alone; no piece has a space after another character
        alone = "".join(c for c in "\n\t\r" if not any(c in t for t in self.model.id if len(t) > 1))
        assert not any(SPACE in t.lstrip(SPACE) for t in self.model.id)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of all occurrences of pieces in the characters ``text``, where 0 separates."""
        seen = np.zeros(0x110000, bool)
        seen[text] = True
        chars = np.flatnonzero(seen)
        self.local[chars] = np.arange(len(chars)) + (chars[0] != 0)
        width = 8 if len(chars) < 255 else 16
        per, n_keys = 64 // width, -(-self.model.longest * width // 64)
        wide = np.concatenate([self.local[text], np.zeros(per * n_keys, np.int64)]).astype(np.uint64)
        packed = np.zeros(len(wide) - per + 1, np.uint64)
        for i in range(per):
            packed = (packed << np.uint64(width)) | wide[i : len(wide) - per + 1 + i]
        keys = [packed[i * per : i * per + len(text)] for i in range(n_keys)]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        rows = np.flatnonzero(seen[self.model.code].all(axis=1) | ((self.model.code == 0) | seen[self.model.code]).all(axis=1))
        code = self.model.code[rows]
        end = np.uint64((1 << width) - 1)
        low = [np.zeros(len(rows), np.uint64) for _ in keys]
        high = [np.zeros(len(rows), np.uint64) for _ in keys]
        for i in range(per * n_keys):
            c = code[:, i] if i < code.shape[1] else np.zeros(len(rows), np.int64)
            v = np.where(c > 0, self.local[c], 0).astype(np.uint64)
            low[i // per] = (low[i // per] << np.uint64(width)) | v
            high[i // per] = (high[i // per] << np.uint64(width)) | np.where(c > 0, v, end)
        a, b = _bounds(keys, low, False), _bounds(keys, high, True)
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return order[at], np.repeat(self.model.ordinary[rows], n)

    def add(self, stretches: list[str]) -> None:
        """Encodes stretches that are not held yet; a character that no piece holds is a boundary inside them."""
        chars, at = self.model.chars, self.at
        mixed = {s: self.runs(s) for s in stretches if not chars.issuperset(s)}
        plain = {s for s in stretches if s not in mixed}
        plain.update(r for runs in mixed.values() for r in runs if r not in at and chars.issuperset(r))
        # long ones come last and together: there are as many rounds as characters in the longest
        plain = sorted(plain, key=len)
        for i in range(0, len(plain), AT_ONCE):
            self._relax(plain[i : i + AT_ONCE])
        if mixed:
            parts = [[self._held(r) if r in at else self.model.ids([r]) for r in runs] for runs in mixed.values()]
            done = [[x for p in x for x in p] for x in parts]
            self._hold(list(mixed), np.array([x for d in done for x in d], np.int32), np.array([len(d) for d in done]))

    def runs(self, s: str) -> list[str]:
        """The longest stretches of characters that pieces hold, and the other characters one by one."""
        out, start, chars = [], 0, self.model.chars
        for i, c in enumerate(s):
            if c not in chars:
                out += [s[start:i], c] if i > start else [c]
                start = i + 1
        return out + [s[start:]] if start < len(s) else out

    def _held(self, stretch: str) -> list[int]:
        i = self.at[stretch]
        return self.flat[self.start[i] : self.start[i] + self.count[i]].tolist()

    def _relax(self, stretches: list[str]) -> None:
        text = np.frombuffer("\0".join(stretches).encode("utf-32-le") + b"\0\0\0\0", np.uint32).astype(np.int64)
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        start, piece = self.edges(text)
        length = self.model.length[piece]
        end = (start - np.repeat(first, size + 1)[start] + length).astype(np.int32)
        order = np.argsort(end, kind="stable")
        start, piece, length = start[order], piece[order], length[order]
        stops = np.cumsum(np.bincount(end))
        last = np.full(len(text) + 1, -2)
        last[first] = -1
        for r in range(1, len(stops)):
            i, j = stops[r - 1], stops[r]
            if i < j:
                ok = self.pairs.apart(last[start[i:j]], piece[i:j])
                last[start[i:j][ok] + length[i:j][ok]] = piece[i:j][ok]
        at, who, found, whose = first + size, np.arange(len(stretches)), [], []
        while len(who):
            p = last[at]
            found.append(p)
            whose.append(who)
            at = at - self.model.length[p]
            more = at > first[who]
            at, who = at[more], who[more]
        found, whose = np.concatenate(found[::-1]), np.concatenate(whose[::-1])
        order = np.argsort(whose, kind="stable")
        self._hold(stretches, found[order].astype(np.int32), np.bincount(whose, minlength=len(stretches)))

    def _hold(self, stretches, flat, count):
        base = len(self.at)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])
        self.at.update(zip(stretches, range(base, base + len(stretches))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has)."""
        if len(self.at) > MOST_HELD:
            self.clear()
        cut = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set()
        for c in cut:
            new.update(c)
        self.add(list(new.difference(self.at)))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        get = self.at.__getitem__
        i = np.fromiter((x for c in cut for x in map(get, c)), np.int64, int(n.sum()))
        k = self.count[i]
        at = np.repeat(self.start[i] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        ends = np.concatenate([[0], np.cumsum(k)])[np.concatenate([[0], np.cumsum(n)])]
        return self.flat[at], np.diff(ends)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = MODEL) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): the ids of each whole text, and whether they decode to the text again.

    Null and empty texts have no ids. A text that holds U+2581 decodes to a
    space in its place, so its ``round_trip`` is false. Stretches of any length
    are encoded alike. Repeated rows give a row each; other columns are ignored; an empty table gives an empty result.
    """

    def f(batches):
        e = encoder(model)
        decode = e.model.decode
        for b in batches:
            for i, j, texts in C.text_slices(b.column(1), 2_000_000):
                ids, n = e.encode(texts)
                ends = np.concatenate([[0], np.cumsum(n)])
                every = ids.tolist()
                same = [decode(every[a:z]) == t for a, z, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts)]
                del every
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                    pa.array(n.astype(np.int32)), pa.array(same),
                ], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(f, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def f(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else encoder(model).model.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.select("doc_id", F.arrow_udf(f, "string")("ids").alias("text"))
