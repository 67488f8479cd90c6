"""One pass over texts for a block of patterns: the task's side of the search in `match`.

A long text is taken in stretches of characters, short ones stand in line up to as many. Each place of its bytes is looked up by the first bytes of what is
searched, as many as all of a class have, in a table of bits; what is left is looked up by more bytes where the class has them, so that beginnings which many
patterns share make no pairs, and compared whole. UTF-8 finds a text's bytes at the starts of characters only. Within z differences one of
z + 1 parts of a pattern stands there unchanged, so parts are looked up, and the windows around them are counted letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Classes of what is looked up by its bytes, and as many bytes as every place is looked up by.
KEYS, FIRST = (48, 32, 16, 8, 4, 2, 1), 16
#: Characters of a text that are in hand at once; pairs of places and patterns that are.
STRETCH, PAIRS = 1 << 18, 1 << 20


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number: a view of data, which has eight zeros at its end."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _keys(words: np.ndarray, at: np.ndarray | slice, k: int) -> np.ndarray:
    """A digest of the k bytes at places."""
    h = words[at] if k >= 8 else words[at] & np.uint64((1 << 8 * k) - 1)
    h = h * np.uint64(0x9E3779B97F4A7C15)
    if k > 8:
        far = slice(at.start + k - 8, at.stop + k - 8) if isinstance(at, slice) else at + (k - 8)
        h = (h ^ words[far]) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _longer(h: np.ndarray, words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Digests of the k bytes at places, from those of the FIRST ones."""
    for j in range(FIRST, k, 8):
        h = (h ^ words[at + j]) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(32))
    return h


class Patterns:
    """Patterns (ids, an Arrow array, and their texts), all of one character or more, and what is looked up of them."""

    def __init__(self, ids: pa.Array, texts: list[str], z: int | None = None) -> None:
        self.ids, self.z = ids, z
        parts, count = [], 1 if z is None else z + 1
        for i, t in enumerate(texts):
            ends = [j * len(t) // count for j in range(count + 1)]
            parts += [(i, a, e, t[a:e].encode()) for a, e in zip(ends, ends[1:], strict=False)]
        self.owner, self.begin, self.end = (np.array([p[c] for p in parts], dtype=np.int64) for c in range(3))
        self.size = np.array([len(p[3]) for p in parts], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1].astype(np.int64)
        self.data = b"".join(p[3] for p in parts) + bytes(8)
        self.longest = max((len(t) for t in texts), default=0)
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        if z is not None:
            self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
            self.first = np.concatenate(([0], np.cumsum(self.length)))[:-1].astype(np.int64)
        self.classes = []
        todo = self.size > 0
        for k in KEYS:
            own = np.flatnonzero(todo & (self.size >= k))
            todo[own] = False
            if len(own):
                front = _keys(_words(self.data), self.start[own], min(k, FIRST))
                h = _longer(front, _words(self.data), self.start[own], k)
                order = np.argsort(h, kind="stable")
                keys, at, n = np.unique(h[order], return_index=True, return_counts=True)
                bits = np.uint64(64 - min(24, max(16, len(keys).bit_length() + 5)))
                table = np.zeros(1 << (64 - int(bits)), dtype=bool)
                table[(front >> bits).astype(np.int64)] = True
                self.classes.append((k, keys, at, n, own[order], bits, table))

    def _pairs(self, words: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(part, place) of every part that stands in the bytes, PAIRS or a place's own at a time."""
        by = h = None
        for k, keys, first, n, parts, bits, table in self.classes:
            if size < k:
                continue
            if by != min(k, FIRST):
                by = min(k, FIRST)
                h = _keys(words, slice(0, size - by + 1), by)
            at = np.flatnonzero(table[(h[: size - k + 1] >> bits).view(np.int64)])
            key = _longer(h[at], words, at, k)
            j = np.searchsorted(keys, key)
            j[j == len(keys)] = 0
            same = keys[j] == key
            at, j = at[same], j[same]
            if not len(at):
                continue
            block = np.cumsum(n[j]) // PAIRS
            for b in np.unique(block):
                of, places = j[block == b], at[block == b]
                many = n[of]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                part, place = parts[np.repeat(first[of], many) + nth], np.repeat(places, many)
                yield self._equal(words, part, place, size)

    def _equal(self, words: np.ndarray, part: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose bytes are equal, eight at a time."""
        fits = place + self.size[part] <= size
        part, place, done, mine = part[fits], place[fits], 0, _words(self.data)
        out = []
        while len(part):
            left = self.size[part] - done
            shift = (8 * np.maximum(0, 8 - left)).astype(np.uint64)
            same = ((words[place + done] ^ mine[self.start[part] + done]) << shift) == 0
            ends = same & (left <= 8)
            out.append((part[ends], place[ends]))
            part, place, done = part[same & ~ends], place[same & ~ends], done + 8
        return np.concatenate([o[0] for o in out] or [np.zeros(0, np.int64)]), np.concatenate([o[1] for o in out] or [np.zeros(0, np.int64)])

    def _near(self, codes: np.ndarray, part: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pattern, place, differences) of the windows around parts at places, in characters."""
        owner = self.owner[part]
        place, m = place - self.begin[part], self.length[owner]
        ok = (place >= 0) & (place + m <= len(codes))
        part, owner, place, m = part[ok], owner[ok], place[ok], m[ok]
        end, rest, out = self.end[part], m - (self.end[part] - self.begin[part]), []
        d, t = np.zeros(len(part), np.int64), 0
        while len(part):
            last = rest <= t
            out.append((owner[last], place[last], d[last]))
            go = ~last
            part, owner, place, m, end, rest, d = (x[go] for x in (part, owner, place, m, end, rest, d))
            j = end + t
            j[j >= m] -= m[j >= m]
            d = d + (codes[place + j] != self.codes[self.first[owner] + j])
            go = d <= self.z
            part, owner, place, m, end, rest, d = (x[go] for x in (part, owner, place, m, end, rest, d))
            t += 1
        if not out:
            return (np.zeros(0, np.int64),) * 3
        owner, place, d = (np.concatenate([o[c] for o in out]) for c in range(3))
        return owner, place, d

    def found(self, text: str, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(pattern, place in the text, differences) of what begins at characters [begin, end) of a text."""
        before = 0 if self.z is None else min(begin, self.longest)
        s = text[begin - before : end + self.longest]
        data = s.encode()
        chars = codes = None
        own = end - begin
        near = []
        for part, place in self._pairs(np.ascontiguousarray(_words(data + bytes(8))), len(data)):
            if len(part) and len(data) > len(s):
                if chars is None:
                    chars = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80) - 1
                place = chars[place]
            if self.z is None:
                mine = place < own
                yield self.owner[part[mine]], place[mine] + begin, None
            elif len(part):
                codes = np.frombuffer(s.encode("utf-32-le"), dtype="<u4") if codes is None else codes
                near.append(self._near(codes, part, place))
        if near:
            owner, place, d = (np.concatenate([x[c] for x in near]) for c in range(3))
            mine = (place >= before) & (place < before + own)
            # a window that several parts have found is one
            rows = np.unique(np.stack([owner[mine], place[mine], d[mine]]), axis=1)
            yield rows[0], rows[1] + (begin - before), rows[2]


def _in_line(texts: Iterator[str], limit: int) -> Iterator[tuple[int, list[str]]]:
    """Texts that follow each other, up to `limit` characters or one text: the number of the first, and they."""
    first, line, size = 0, [], 0
    for t in texts:
        if line and size + len(t) > limit:
            yield first, line
            first, line, size = first + len(line), [], 0
        line.append(t)
        size += len(t)
    if line:
        yield first, line


def scan(held, names: list[str], before: int = 0, after: int = 0, at: str | None = None):
    """For mapInArrow over (seq_id, seq): a row for each hit of a broadcast `Patterns`, under the names. With a column `at` of
    arrays, of those alone that stand at these places."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        step = max(STRETCH, p.longest)

        def made(hits: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
            which, row, pos, d = (np.concatenate([h[c] for h in hits]) for c in range(4))
            columns = [p.ids.take(pa.array(which)), b.column("seq_id").take(pa.array(row)), pa.array(pos.astype(np.int64))]
            if before or after:
                texts = {i: b.column("seq")[i].as_py() for i in set(row.tolist())}
                at = list(zip(row.tolist(), pos.tolist(), strict=True))
                if before:
                    columns.append(pa.array([texts[i][max(0, x - before) : x] for i, x in at], pa.string()))
                if after:
                    columns.append(pa.array([texts[i][x : x + after] for i, x in at], pa.string()))
            if p.z is not None:
                columns.append(pa.array(d.astype(np.int32)))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            hits, size = [], 0
            for first, line in _in_line((t.as_py() or "" for t in b.column("seq")), STRETCH):
                text, ends = "".join(line), np.cumsum([len(t) for t in line])
                starts = np.concatenate(([0], ends[:-1]))
                if at is not None:
                    places = zip(starts.tolist(), line, b.column(at).slice(first, len(line)).to_pylist(), strict=True)
                    places = np.array([s + x for s, t, own in places for x in own or () if 0 <= x < len(t)], dtype=np.int64)
                for begin in range(0, len(text), step):
                    for which, pos, d in p.found(text, begin, min(len(text), begin + step)):
                        row = np.searchsorted(ends, pos, side="right")
                        mine = pos + p.length[which] <= ends[row]
                        if at is not None:
                            mine &= np.isin(pos, places)
                        which, row, pos, d = which[mine], row[mine], pos[mine], d if d is None else d[mine]
                        if len(which):
                            pos = pos - starts[row]
                            hits.append((which, row + first, pos, pos if d is None else d))
                            size += len(which)
                        if size > 100_000:
                            yield made(hits, b)
                            hits, size = [], 0
            if hits:
                yield made(hits, b)

    return rows
