"""Byte-pair encoding of many whole texts at once, as array operations.

Texts are cut into the tokenizer's own pieces (words with their space, numbers, marks, white space) by
comparing character classes of neighbours. Equal pieces of a step are found by two 64-bit hashes, and
only pieces that this worker has not met before are merged, all of them at once: each round merges, in
every piece, the leftmost pair of lowest rank. The result equals the tokenizers library's ids. Texts
with the tokenizer's special tokens and pieces over ``WIDE`` code points are left to the library, or to
``long_ids`` where given.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Code points that one step of a task works on; distinct pieces a worker keeps.
STEP, KEPT = 1_000_000, 600_000
#: Code points of the longest piece that is merged here.
WIDE = 40

_SPACE, _LETTER, _NUMBER, _OTHER, _GAP = range(5)
_U = np.uint64
_encoders: dict[tuple, Encoder] = {}
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point: white space, letter, number, other."""
    if not _classes:
        kind = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        for c in range(sys.maxunicode + 1):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                kind[c] = _LETTER if k == "L" else _NUMBER
        # White space by Unicode's property; Python counts four control characters more.
        kind[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _classes.append(kind)
    return _classes[0]


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit mixing of integers."""
    x = (x.astype(_U) + _U(salt)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    out[1:] = base
    return np.cumprod(out, dtype=_U)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def byte_names() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``words``: lower-case word-level vocabulary with word ends; else byte-level with spaces."""

    def __init__(self, path: str, long_ids: Callable | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, ending = model["vocab"], model["end_of_word_suffix"] or ""
        self.words, self.long_ids = bool(ending), long_ids
        names = byte_names()
        self.byte_id = np.zeros(256, np.int64)
        self.last_id = np.zeros(256, np.int64)
        for name, byte in names.items():
            self.byte_id[byte] = vocab[name]
            self.last_id[byte] = vocab[name + ending]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a.removesuffix(ending) + b if ending else a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.first_hash, self.second_hash = powers(0xBF58476D1CE4E5B9, WIDE), powers(0x94D049BB133111EB, WIDE)
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.pool = np.zeros(0, np.int32)

    @classmethod
    def shared(cls, path: str, long_ids: Callable | None = None) -> Encoder:
        """One per worker process."""
        key = (path, long_ids)
        if key not in _encoders:
            _encoders[key] = cls(path, long_ids)
        return _encoders[key]

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _starts(self, cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pieces begin, by the tokenizer's split pattern."""
        before = np.r_[np.uint8(_GAP), kind[:-1]]
        start = kind != before
        if self.words:
            start |= kind == _NUMBER
        else:
            after = np.r_[kind[1:], np.uint8(_GAP)]
            # The last white space before something else stands apart, or goes with it if it is a space.
            start |= (kind == _SPACE) & (after != _SPACE) & (after != _GAP)
            start &= ~((before == _SPACE) & (kind != _SPACE) & (kind != _GAP) & (np.r_[np.uint32(0), cp[:-1]] == 32))
        at = np.flatnonzero((cp == 39) & start)
        if len(at):  # 's 't 'm 'd 're 've 'll
            padded = np.r_[cp, np.zeros(4, cp.dtype)]
            one, two = padded[at + 1], padded[at + 2]
            short = np.isin(one, [115, 116, 109, 100])
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            start[at[short | long] + 1] = False
            for hit, n in ((short, 2), (long, 3)):
                ends = at[hit] + n
                start[ends[ends < len(start)]] = True
        return start

    def _merged(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, padded by -1, after all merges."""
        def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            wanted = a << 20 | b
            at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
            return np.where((a >= 0) & (b >= 0) & (self.pair[at] == wanted), at, -1)

        none = np.int64(1) << 40
        pad = np.full((len(symbols), 1), -1, np.int64)
        at = np.concatenate([look(symbols[:, :-1], symbols[:, 1:]), pad], 1)
        best = np.where(at >= 0, self.rank[at], none)
        active = np.arange(len(symbols))
        out, width = symbols, np.arange(symbols.shape[1])
        while True:
            m = best.argmin(1)
            row = np.arange(len(m))
            go = best[row, m] < none
            if not go.all():
                out[active[~go]] = symbols[~go] if symbols is not out else out[active[~go]]
                active, symbols, at, best, m = active[go], symbols[go], at[go], best[go], m[go]
                row = np.arange(len(m))
            if not len(m):
                return out
            symbols = symbols.copy() if symbols is out else symbols
            symbols[row, m] = self.made[at[row, m]]
            take = width + (width > m[:, None])
            take[:, -1] = np.minimum(take[:, -1], len(width) - 1)
            last = m < len(width) - 1
            symbols, at, best = (np.take_along_axis(x, take, 1) for x in (symbols, at, best))
            symbols[last, -1], at[last, -1], best[last, -1] = -1, -1, none
            for side in (m - 1, m):
                ok = np.flatnonzero(side >= 0)
                s = side[ok]
                right = np.where(s + 1 < len(width), symbols[ok, np.minimum(s + 1, len(width) - 1)], -1)
                at[ok, s] = found = look(symbols[ok, s], right)
                best[ok, s] = np.where(found >= 0, self.rank[found], none)

    def _learn(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given as byte ranges: places in the pool and counts."""
        place, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        held = len(self.pool)
        parts = []
        low = 0
        for high in (2, 4, 6, 8, 12, 16, 24, 40, 80, 4 * WIDE + 1):
            here = np.flatnonzero((size > low) & (size <= high))
            low = high
            for some in np.array_split(here, max(1, len(here) * high // 2_000_000)):
                if not len(some):
                    continue
                grid = begin[some, None] + np.arange(high)
                inside = np.arange(high) < size[some, None]
                raw = data[np.minimum(grid, len(data) - 1)]
                symbols = np.where(inside, self.byte_id[raw], -1)
                ends = size[some] - 1
                symbols[np.arange(len(some)), ends] = self.last_id[raw[np.arange(len(some)), ends]]
                symbols = self._merged(symbols)
                n = (symbols >= 0).sum(1)
                place[some], count[some] = held + np.cumsum(n) - n, n
                parts.append(symbols[symbols >= 0].astype(np.int32))
                held += int(n.sum())
        self.pool = np.concatenate([self.pool, *parts])
        return place, count

    def _known(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, count = np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64)
        for first, second, where, n in self.runs:
            at = np.minimum(np.searchsorted(first, a), len(first) - 1)
            hit = (first[at] == a) & (second[at] == b)
            place[hit], count[hit] = where[at[hit]], n[at[hit]]
        return place, count

    def _keep(self, run: tuple[np.ndarray, ...]) -> None:
        order = np.argsort(run[0])
        self.runs.append(tuple(x[order] for x in run))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            joined = [np.concatenate(x) for x in zip(self.runs.pop(), self.runs.pop(), strict=True)]
            order = np.argsort(joined[0])
            self.runs.append(tuple(x[order] for x in joined))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (int32), and where each text's ids begin and end."""
        if sum(len(r[0]) for r in self.runs) > KEPT:
            self.runs, self.pool = [], np.zeros(0, np.int32)
        odd = {i: self.whole(t) for i, t in enumerate(texts) if "<|" in t and any(s in t for s in self.special)}
        texts = ["" if i in odd else t for i, t in enumerate(texts)]
        if self.words:
            texts = [(t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))
                     .replace("Σ", "σ").lower() for t in texts]
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "\n".join(texts)
        cp, raw = code_points(joined), np.frombuffer(joined.encode(), np.uint8)
        kind = classes()[cp]
        gaps = np.cumsum(sizes + 1)[:-1] - 1
        kind[gaps] = _GAP
        edges = np.r_[0, gaps + 1]
        begin = np.flatnonzero(self._starts(cp, kind))
        end = np.r_[begin[1:], len(cp)]
        keep = kind[begin] != _GAP
        if self.words:
            keep &= kind[begin] != _SPACE
        begin, end = begin[keep], end[keep]
        if len(raw) == len(cp):
            at_byte = np.arange(len(cp) + 1)
        else:
            at_byte = np.r_[0, np.cumsum(1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000))]
        place, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        small = np.flatnonzero(end - begin <= WIDE)
        if len(small):
            a, b = self._hashes(cp, begin[small], end[small])
            order = np.argsort(a)
            new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
            group = np.empty(len(a), np.int64)
            group[order] = np.cumsum(new) - 1
            one = order[new]
            where, n = self._known(a[one], b[one])
            miss = np.flatnonzero(where < 0)
            if len(miss):
                x, y = at_byte[begin[small][one[miss]]], at_byte[end[small][one[miss]]]
                where[miss], n[miss] = self._learn(raw, x, y - x)
                self._keep((a[one[miss]], b[one[miss]], where[miss], n[miss]))
            place[small], count[small] = where[group], n[group]
        pool = self.pool
        if len(small) < len(begin):
            extra, held = [], len(pool)
            for i in np.flatnonzero(end - begin > WIDE):
                piece = joined[begin[i] : end[i]]
                ids = self.long_ids(self.library, piece) if self.long_ids else self.whole(piece)
                place[i], count[i] = held, len(ids)
                held += len(ids)
                extra.append(np.array(ids, np.int32))
            pool = np.concatenate([pool, *extra])
        last = np.cumsum(count)
        ids = pool[np.repeat(place - last + count, count) + np.arange(last[-1] if len(last) else 0)]
        cuts = np.r_[0, last][np.r_[np.searchsorted(begin, edges), len(begin)]]
        if odd:
            parts = [np.array(odd[i], np.int32) if i in odd else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
            return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, cuts

    def _hashes(self, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - begin
        first = np.cumsum(size) - size
        offset = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
        value = mixed(cp[np.repeat(begin, size) + offset], 1)
        a = np.add.reduceat(value * self.first_hash[offset], first)
        b = np.add.reduceat(value * self.second_hash[offset], first)
        return mixed(a, 3), b


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null as empty), about ``most`` code points each."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most or i + 1 == len(texts):
            yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
            begin, size = i + 1, 0
