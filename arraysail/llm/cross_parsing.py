"""Language-model scoring by Ziv-Merhav cross-parsing.

The reference text of the corpus is that of the documents labelled as good, or
of all. A document is factored greedily, longest match after longest match,
against all of it but its own text, so nothing is measured against itself. With
``c`` phrases over ``n`` words and a reference of ``N`` words the cross entropy
is ``c log2 N / n`` bits a word; less the entropy of the document's own
incremental parsing it is the relative entropy.

A suffix automaton of a large text does not fit a task, so all suffixes of the
reference are sorted once, in pieces that each hold a range of the hashes of
their first two words, and kept as one index of files in the shared folder. A
task holds many documents, maps the files and searches the pairs of words of all
its places in their order; a place whose pair the reference lacks is a phrase of
one word. Longer matches are measured at the starts of phrases alone: in every
document walkers start at each ``STRIDE``-th word and go from phrase to phrase
until they meet a place where another one was. Pieces, walkers and batches change
no result. A search costs the logarithm of the reference, whatever the pieces.

With ``block_chars`` documents and reference are dealt to blocks of that size
instead, each with two suffix automata over words, one for each half of its
reference; a document meets the half of its block that it is not in.
"""

from __future__ import annotations

import gc
import math
import os
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraysail.llm import _common as C

#: Characters of reference text for which the index has PIECES pieces, and words that a task holds at once.
SHARD_CHARS, PIECES, TASK_WORDS = 48_000_000, 4, 3_000_000
#: Words between two walkers of a document, and words that are compared at once in long matches.
STRIDE, _BLOCK = 512, 64
#: Characters of all text that a block holds on average, where blocks are asked for.
BLOCK_TEXT = 24_000_000
SEED = 5
words_of = re.compile(r"\w+|[^\w\s]").findall


def automaton(texts: list[list[str]]) -> dict:
    """The start of a suffix automaton of word lists; a state is a dictionary from a word to the next state.

    Lists are kept apart by symbols of their own that no word equals.
    """
    moves: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for mark, words in enumerate(texts):
        for w in (*words, mark):
            cur = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in moves[p]:
                moves[p][w] = cur
                p = link[p]
            if p != -1:
                q = moves[p][w]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(moves)
                    moves.append(moves[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and moves[p].get(w) == q:
                        moves[p][w] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
    for d in moves:
        for w, to in d.items():
            d[w] = moves[to]
    return moves[0]


def cross_phrases(start: dict, words: list[str]) -> int:
    """Phrases of the greedy longest-match factoring; a word that the reference lacks is a phrase."""
    n, at = 0, start
    for w in words:
        to = at.get(w)
        if to is None:
            if at is not start:
                n += 1
                to = start.get(w)
            if to is None:
                n += 1
                to = start
        at = to
    return n + (at is not start)


def own_phrases(words: list[str]) -> int:
    """Phrases of the incremental parsing of the words themselves: each is an earlier one and a word more."""
    start: dict = {}
    n, at = 0, start
    for w in words:
        to = at.get(w)
        if to is None:
            at[w] = {}
            n += 1
            to = start
        at = to
    return n + (at is not start)


def _bits(phrases: int, size: int, n: int) -> float:
    return phrases * math.log2(max(size, 2)) / n


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_phrases", pa.int64()), ("reference_words", pa.int64()), ("cross_entropy", pa.float64()), ("relative_entropy", pa.float64())])


def score_block(ids: list, texts: list[str | None], halves: list[int], good: set) -> list[tuple]:
    """A row for each document of a block."""
    words = [words_of(t or "") for t in texts]
    out: list = [None] * len(ids)
    for half in (0, 1):
        reference = [w for i, w, h in zip(ids, words, halves) if h != half and i in good]
        start, size = automaton(reference), sum(map(len, reference))
        for k, (i, w, h) in enumerate(zip(ids, words, halves)):
            if h == half:
                n = len(w)
                c, own = cross_phrases(start, w), own_phrases(w)
                cross = _bits(c, size, n) if n else None
                out[k] = (i, n, c, size, cross, cross - _bits(own, own, n) if n else None)
        # states point at states: taken apart here, the memory is free at once
        todo = [start]
        while todo:
            d = todo.pop()
            todo += [x for x in d.values() if x]
            d.clear()
    return out


def _score(left: pa.Table, right: pa.Table) -> pa.Table:
    gc.disable()  # hundreds of thousands of dictionaries without a cycle
    try:
        rows = score_block(left["doc_id"].to_pylist(), left["text"].to_pylist(), left["half"].to_pylist(), set(right["doc_id"].to_pylist()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA.types)], schema=_SCHEMA)
    finally:
        gc.enable()


def codes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word; none is 0, which ends a text."""
    row = np.empty(len(words), object)
    row[:] = words
    at, distinct = pd.factorize(row)
    h = pd.util.hash_array(distinct, categorize=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    h[h == 0] = 1
    return h[at]


def _coded(texts: list[list[str]]) -> list[np.ndarray]:
    return np.split(codes([w for t in texts for w in t]), np.cumsum([len(t) for t in texts])[:-1]) if texts else []


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one row, each with a 0 behind it, and their starts."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    row, start = np.zeros(ends[-1] if len(ends) else 0, np.int64), np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    for t, b in zip(texts, start):
        row[b : b + len(t)] = t
    return row, start


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of words."""
    x, y = a.view(np.uint64), b.view(np.uint64)
    x = x * np.uint64(0x9E3779B97F4A7C15) + ((y << np.uint64(31)) | (y >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _pairs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two words of a text stand, and their keys."""
    at = np.flatnonzero((row[:-1] != 0) & (row[1:] != 0))
    return at, _key(row[at], row[at + 1])


def _piece(key: np.ndarray, pieces: int) -> np.ndarray:
    """The piece of the index that a key is in; a piece holds a range of keys."""
    return ((key >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)


def _same(left: np.ndarray, a: np.ndarray, right: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """How many words from place ``a`` of one row on are those from each of ``places`` of the other on."""
    out, todo, width = np.zeros(len(a), np.int64), np.arange(len(a)), 8
    while len(todo):
        steps, done = np.arange(width), out[todo]
        x = left[(a[todo] + done)[:, None] + steps]
        differ = x == 0
        for b in places:
            differ |= x != right[(b[todo] + done)[:, None] + steps]
        n = np.where(differ.any(1), differ.argmax(1), width)
        out[todo] += n
        todo, width = todo[n == width], _BLOCK
    return out


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words pairs of places of a row have in common. Pairs at one distance that lie in one match are measured once, so that copies cost their length and not its square."""
    if not len(a):
        return np.zeros(0, np.int64)
    by = np.lexsort((a, a - b))
    a, b = a[by], b[by]
    new = np.concatenate([[True], ((a - b)[1:] != (a - b)[:-1]) | ((a >> 12)[1:] != (a >> 12)[:-1])])
    at, run = np.flatnonzero(new), np.cumsum(new) - 1
    end, now, where = np.append(at[1:], len(a)), np.arange(len(at)), (run << 40) | a
    stop, measured = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    while len(at):
        to = a[at] + _same(text, a[at], text, b[at])
        stop[at], measured[at] = to, at
        at = np.maximum(np.searchsorted(where, (now << 40) | to), at + 1)
        go = at < end[now]
        at, now = at[go], now[go]
    out = np.empty(len(a), np.int64)
    out[by] = stop[np.maximum.accumulate(measured)] - a
    return out


def suffixes(text: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their keys and then of the words that follow up to the end of their text, and the keys."""
    by = np.argsort(key, kind="stable")
    order, key = at[by].astype(np.int64), key[by]
    n = len(order)
    del by
    slots, depth, turn = np.arange(n), np.full(n, 2), 0
    first = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    ended = np.zeros(n, bool)
    while True:
        # groups of places that are not told apart yet
        go = ~(first & np.concatenate([first[1:], [True]])) & ~ended if len(first) else ended
        slots, depth, first = slots[go], depth[go], first[go]
        if not len(slots):
            return order, key
        group = np.cumsum(first) - 1
        place = order[slots]
        if turn > 1:
            # words that all of a group share are passed over at once
            heads, others = np.flatnonzero(first), np.flatnonzero(~first)
            n = np.full(len(slots), np.iinfo(np.int64).max)
            n[others] = _shared(text, place[others] + depth[others], place[heads][group[others]] + depth[others])
            depth = depth + np.minimum.reduceat(n, heads)[group]
        word = text[place + depth]
        by = np.lexsort((word, group))
        order[slots], word = place[by], word[by]
        first = np.concatenate([[True], (word[1:] != word[:-1]) | (group[1:] != group[:-1])])
        ended, depth, turn = word == 0, depth + 1, turn + 1


def _next(owner: np.ndarray) -> np.ndarray:
    """The next slot of another owner, or the end."""
    n = len(owner)
    last = np.concatenate([owner[1:] != owner[:-1], [True]]) if n else np.zeros(0, bool)
    return np.minimum.accumulate(np.where(last, np.arange(n), n)[::-1])[::-1] + 1 if n else np.zeros(0, np.int64)


def _sizes(start: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners of texts and the words of each."""
    who, at = np.unique(owner, return_inverse=True)
    return who, np.bincount(at, weights=np.diff(start, append=size) - 1, minlength=len(who)).astype(np.int64)


#: Files of the index: the text, starts and owners of its parts, owners with their words; in the order of the suffixes
#: keys of their first two words, places, and the next slot of another owner. A file of places is "i4" while that does.
_KINDS = {"text": "i8", "start": "i8", "owner": "i8", "who": "i8", "words": "i8", "key": "u8", "order": "i8", "next": "i8"}


def index(texts: list[np.ndarray], owners: np.ndarray) -> dict[str, np.ndarray]:
    """The sorted suffixes of texts, each of a document."""
    row, start = _joined(texts)
    text = np.concatenate([row, np.zeros(_BLOCK, np.int64)])
    order, key = suffixes(text, *_pairs(row))
    who, words = _sizes(start, owners, len(row))
    return {"text": text, "start": start, "owner": owners, "who": who, "words": words, "key": key, "order": order, "next": _next(owners[np.searchsorted(start, order, "right") - 1])}


class Shard:
    """An index, for a batch of texts in one row; ``text`` has the text of each place, ``ids`` and ``known`` are by text."""

    def __init__(self, arrays: dict[str, np.ndarray], row: np.ndarray, text: np.ndarray, ids: np.ndarray, known: np.ndarray):
        self.__dict__.update(arrays)
        self.row, self.of, self.ids = row, text, ids
        at = np.minimum(np.searchsorted(self.who, ids), max(len(self.who) - 1, 0))
        self.member = known & (self.who[at] == ids) if len(self.who) else np.zeros(len(ids), bool)
        self.size = np.where(self.member, self.words[at], 0) if len(self.who) else np.zeros(len(ids), np.int64)

    def _others(self, at, lo, hi) -> np.ndarray:
        """Whether slots hold a suffix of another document."""
        out = np.ones(len(at), bool)
        i = np.flatnonzero(self.member[self.of[at]])
        i = i[self.next[lo[i]] >= hi[i]]
        out[i] = self.owner[np.searchsorted(self.start, self.order[lo[i]], "right") - 1] != self.ids[self.of[at[i]]]
        return out

    def _bound(self, lo, hi, depth, target, past: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while open_.size:
            mid = (lo[open_] + hi[open_]) >> 1
            x = self.text[self.order[mid] + depth[open_]]
            less = x <= target[open_] if past else x < target[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def _narrow(self, at, lo, hi, depth) -> tuple:
        """Those of the slots whose suffixes have the next word of the text as well, one of another document among them."""
        target = self.row[at + depth]
        i = np.flatnonzero(target != 0)
        lo, hi = lo.copy(), hi.copy()
        many = i[hi[i] - lo[i] > 1]
        lo[many] = self._bound(lo[many], hi[many], depth[many], target[many], False)
        i = i[lo[i] < hi[i]]
        i = i[self.text[self.order[lo[i]] + depth[i]] == target[i]]
        many = i[hi[i] - lo[i] > 1]
        hi[many] = self._bound(lo[many] + 1, hi[many], depth[many], target[many], True)
        i = i[self._others(at[i], lo[i], hi[i])]
        return i, lo[i], hi[i]

    def pairs(self, at: np.ndarray, key: np.ndarray) -> tuple:
        """Of places in the order of their keys those of two words, and those of three with their slots."""
        lo = np.searchsorted(self.key, key)
        i = np.flatnonzero(lo < len(self.key))
        i = i[self.key[lo[i]] == key[i]]
        at, key, lo = at[i], key[i], lo[i]
        hi = lo + 1
        more = np.flatnonzero(hi < len(self.key))
        more = more[self.key[hi[more]] == key[more]]
        hi[more] = np.searchsorted(self.key, key[more], "right")
        i = np.flatnonzero(self._others(at, lo, hi))
        at, lo, hi = at[i], lo[i], hi[i]
        i, low, high = self._narrow(at, lo, hi, np.full(len(at), 2))
        return at, at[i], low, high

    def match(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Longest matches at places with suffixes of three words in common."""
        out, i, depth = np.zeros(len(at), np.int64), np.arange(len(at)), np.full(len(at), 3)
        while len(i):
            # what the first and the last suffix share with the text, all between them do
            n = np.zeros(len(i), np.int64)
            one, many = np.flatnonzero(hi - lo == 1), np.flatnonzero(hi - lo > 1)
            n[one] = _same(self.row, at[i[one]] + depth[one], self.text, self.order[lo[one]] + depth[one])
            # both at once: one of them may be the text itself
            n[many] = _same(self.row, at[i[many]] + depth[many], self.text, self.order[lo[many]] + depth[many], self.order[hi[many] - 1] + depth[many])
            depth = depth + n
            out[i] = depth
            i, lo, hi, depth = i[many], lo[many], hi[many], depth[many]
            go, lo, hi = self._narrow(at[i], lo, hi, depth)
            i, depth = i[go], depth[go] + 1
        return out


def parsed(texts: list[np.ndarray], ids: list, shards: list[dict[str, np.ndarray]]) -> tuple[list[int], list[int]]:
    """For each text of a batch the phrases of its factoring against all shards but its own document, and the words of that document in them."""
    row, begin = _joined(texts)
    length = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), length + 1)
    places, key = _pairs(row)
    by = np.argsort(key)
    places, key = places[by], key[by]
    row = np.concatenate([row, np.zeros(_BLOCK, np.int64)])
    del by
    known = np.array([i is not None for i in ids], bool)
    number = np.array([i or 0 for i in ids], np.int64)
    # a word is a phrase whether the reference has it or not; 0 is a match yet to be measured
    jump, opened, deep, size = np.ones(len(row), np.int32), [Shard(x, row, text, number, known) for x in shards], [], np.zeros(len(texts), np.int64)
    for s in opened:
        size += s.size
        two, three, lo, hi = s.pairs(places, key)
        jump[two] = 2
        sort = np.argsort(three)
        deep.append((three[sort], lo[sort], hi[sort]))
        del two, three, lo, hi, sort
    del places, key
    for three, _, _ in deep:
        jump[three] = 0
    walkers = -(-length // STRIDE)
    of = np.repeat(np.arange(len(texts)), walkers)
    at = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(walkers) - walkers, walkers)) * STRIDE
    seen = np.zeros(len(row), bool)
    while len(at):
        seen[at] = True
        new = at[jump[at] == 0]
        most = np.zeros(len(new), np.int64)
        for s, (three, lo, hi) in zip(opened, deep):
            if len(three) and len(new):
                k = np.minimum(np.searchsorted(three, new), len(three) - 1)
                i = np.flatnonzero(three[k] == new)
                most[i] = np.maximum(most[i], s.match(new[i], lo[k[i]], hi[k[i]]))
        jump[new] = most
        at = at + jump[at]
        # a place behind the last word is a 0; two walkers that meet go on as one
        at = at[(row[at] != 0) & ~seen[at]]
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) and (at[1:] >= at[:-1]).all() else np.unique(at)
    phrases = []
    for b, n in zip(begin.tolist(), length.tolist()):
        step, p, c = jump[b : b + n].tolist(), 0, 0
        while p < n:
            p += step[p]
            c += 1
        phrases.append(c)
    return phrases, size.tolist()


def _put(folder: str, kind: str, a: np.ndarray, first: int) -> None:
    """Writes ``a`` into the file of its kind from item ``first`` on; where files can't be shared so, into one of its own. Doing it twice changes nothing."""
    files, path = FileSystem.from_uri(folder)
    a = np.ascontiguousarray(a)
    if not isinstance(files, LocalFileSystem):
        with files.open_output_stream(f"{path}/{kind}-{first:020d}") as f:
            f.write(a)
        return
    f, rest, to = os.open(f"{path}/{kind}", os.O_WRONLY | os.O_CREAT, 0o644), memoryview(a.view(np.uint8)), first * a.itemsize
    try:
        while len(rest):
            n = os.pwrite(f, rest[: 1 << 28], to)
            rest, to = rest[n:], to + n
    finally:
        os.close(f)


def _read(folder: str, kind: str, dtype: str, whole: bool = False) -> np.ndarray:
    """A file, mapped where the shared folder is mounted, else read; ``whole``: all that ``_put`` has written."""
    files, path = FileSystem.from_uri(folder)
    if isinstance(files, LocalFileSystem):
        at = f"{path}/{kind}"
        return np.asarray(np.memmap(at, dtype, "r")) if os.path.getsize(at) else np.empty(0, dtype)
    names = sorted(x.path for x in files.get_file_info(FileSelector(path)) if x.base_name.startswith(f"{kind}-")) if whole else [f"{path}/{kind}"]
    parts = []
    for name in names:
        with files.open_input_file(name) as f:
            parts.append(np.frombuffer(f.read(), dtype))
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _opened(folder: str, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {k: _read(folder, k, t, True) for k, t in kinds.items()}


_WRITTEN = pa.schema([("name", pa.string()), ("n", pa.int64()), ("texts", pa.int64()), ("counts", pa.list_(pa.int64()))])


def _words(batches):
    """(id, words, codes) of every row, slice by slice."""
    for b in batches:
        ids = b.column(0).to_pylist()
        for i, j, texts in C.text_slices(b.column(1)):
            words = [words_of(t) for t in texts]
            del texts
            yield list(zip(ids[i:j], words, _coded(words)))


def _writing(folder: str, pieces: int, most: int):
    """Writes the texts of a partition in parts of about ``most`` words, each with its pairs dealt to the pieces."""

    def part(held: list) -> pa.RecordBatch:
        # the name is this attempt's own; the driver uses those of attempts that came to an end
        name = uuid.uuid4().hex
        files, path = FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        row, start = _joined([x[1] for x in held])
        at, key = _pairs(row)
        piece = _piece(key, pieces)
        del key
        counts = np.bincount(piece, minlength=pieces)
        arrays = {"text": row, "start": start, "owner": np.array([x[0] for x in held], np.int64), "at": at[np.argsort(piece, kind="stable")].astype(np.int32)}
        for kind, a in arrays.items():
            with files.open_output_stream(f"{path}/part-{name}-{kind}") as f:
                f.write(np.ascontiguousarray(a))
        C._trim()
        return pa.RecordBatch.from_pylist([{"name": name, "n": len(row), "texts": len(start), "counts": counts.tolist()}], schema=_WRITTEN)

    def f(batches):
        held, n = [], 0
        for rows in _words(batches):
            for i, _, t in rows:
                held.append((i, t))
                n += len(t) + 1
                if n >= most:
                    yield part(held)
                    held, n = [], 0
            del rows
        if held:
            yield part(held)

    return f


def _laying(folder: str, parts: list[tuple]):
    """Lays the parts of the text behind one another."""

    def f(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                name, base, first, last = parts[k]
                _put(folder, "text", _read(folder, f"part-{name}-text", "i8"), base)
                _put(folder, "start", _read(folder, f"part-{name}-start", "i8") + base, first)
                _put(folder, "owner", _read(folder, f"part-{name}-owner", "i8"), first)
                if last:
                    _put(folder, "text", np.zeros(_BLOCK, np.int64), last)
            yield b

    return f


def _sorting(folder: str, parts: list[tuple], counts: np.ndarray, place: str, size: int):
    """Sorts pieces of the index, each the suffixes of a range of keys."""
    ends = np.cumsum(counts, axis=1)
    slot = np.concatenate([[0], np.cumsum(counts.sum(0))])

    def f(batches):
        text, start, owner = (_read(folder, k, "i8", True) for k in ("text", "start", "owner"))
        for b in batches:
            for q in b.column(0).to_pylist():
                at = [_read(folder, f"part-{p[0]}-at", "i4")[e[q] - c[q] : e[q]].astype(place) + p[1] for p, e, c in zip(parts, ends, counts)]
                at = np.concatenate(at)
                order, key = suffixes(text, at, _key(text[at], text[at + 1]))
                _put(folder, "key", key, slot[q])
                _put(folder, "order", order.astype(place), slot[q])
                _put(folder, "next", (_next(owner[np.searchsorted(start, order, "right") - 1]) + slot[q]).astype(place), slot[q])
                if q == 0:
                    for kind, a in zip(("who", "words"), _sizes(start, owner, size)):
                        _put(folder, kind, a, 0)
                del at, order, key
                C._trim()
            yield b

    return f


def _against(folder: str, kinds: dict[str, str], size: int, most: int):
    def scored(held: list[tuple]) -> pa.RecordBatch:
        phrases, own_size = parsed([x[1] for x in held], [x[0] for x in held], [_opened(folder, kinds)] if size else [])
        rows = []
        for (i, t, own), c, mine in zip(held, phrases, own_size):
            n, reference = len(t), size - mine
            cross = _bits(c, reference, n) if n else None
            rows.append((i, n, c, reference, cross, cross - _bits(own, own, n) if n else None))
        C._trim()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    def f(batches):
        held, n = [], 0
        for rows in _words(batches):
            for i, words, t in rows:
                held.append((i, t, own_phrases(words)))
                n += len(t) + 1
                if n >= most:
                    yield scored(held)
                    held, n = [], 0
            del rows
        if held:
            yield scored(held)

    return f


_COLUMNS = "doc_id long, n_words long, n_phrases long, reference_words long, cross_entropy double, relative_entropy double"


def _whole(rows: DataFrame, reference: DataFrame, chars: int, shard_chars: int, task_words: int) -> DataFrame:
    spark = rows.sparkSession
    pieces = max(1, math.ceil(chars / shard_chars)) * PIECES
    folder = re.sub("^file:/+", "file:///", f"{C.checkpoint_dir(spark)}/reference-{uuid.uuid4().hex}")
    # a row for each part of the text comes back
    written = sorted(reference.select("doc_id", "text").mapInArrow(_writing(folder, pieces, task_words), "name string, n long, texts long, counts array<long>").collect())
    total, words = sum(r["n"] for r in written), sum(r["n"] - r["texts"] for r in written)
    place = "i4" if total < 2**31 - _BLOCK else "i8"
    kinds = _KINDS | {"order": place, "next": place}
    if words:
        bases, firsts = (np.concatenate([[0], np.cumsum([r[k] for r in written])]).tolist() for k in ("n", "texts"))
        parts = [(r["name"], bases[k], firsts[k], total if k == len(written) - 1 else 0) for k, r in enumerate(written)]
        counts = np.array([r["counts"] for r in written], np.int64)
        each = lambda n, f: spark.range(0, n, 1, n).mapInArrow(f, "id long").count()
        drop = lambda *kinds: [C.delete(spark, f"{folder}/part-{p[0]}-{k}") for p in parts for k in kinds]
        each(len(parts), _laying(folder, parts))
        drop("text", "start", "owner")
        each(pieces, _sorting(folder, parts, counts, place, total))
        drop("at")
    return rows.mapInArrow(_against(folder, kinds, words, task_words), _COLUMNS)


def scores(docs: DataFrame, labels: DataFrame | None = None, block_chars: int | None = None, block_text: int = BLOCK_TEXT, shard_chars: int = SHARD_CHARS, task_words: int = TASK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_phrases, reference_words, cross_entropy, relative_entropy) of every row.

    The reference is all documents labelled with quality 1 and not as toxic;
    without ``labels``, or where none is labelled so, all documents with an id.
    Every document meets all of the reference but the rows of its own id; with
    ``block_chars`` only that of the other half of its block. Null, empty and blank texts have no words, no phrases and null scores. Rows
    with a null id are scored and are no reference. Repeated rows are scored alike. Texts are read whole; other
    columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    good, chars = None, 0
    if labels is not None:
        good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) <> 1").select("doc_id")
        chars = sizes.join(good, "doc_id", "left_semi").agg(F.sum("n")).first()[0] or 0
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not chars:
        good, chars = rows.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), total
    if block_chars is None:
        # the ids grow with the corpus: they are shuffled at every size
        return _whole(rows, rows.join(good.hint("merge"), "doc_id", "left_semi"), chars, shard_chars, task_words)
    blocks = max(1, math.ceil(chars / block_chars), math.ceil(total / block_text))
    mix = lambda x: F.xxhash64(x, F.lit(SEED))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text")), F.lit(""))
    block = lambda h: F.pmod(F.shiftright(h, 1), F.lit(blocks)).cast("int")
    rows = rows.select("doc_id", "text", block(mix(own)).alias("block"), mix(own).bitwiseAND(F.lit(1)).cast("int").alias("half"))
    good = good.select("doc_id", block(mix(F.col("doc_id").cast("string"))).alias("block"))
    return rows.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(_score, _COLUMNS)
