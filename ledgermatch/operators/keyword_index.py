"""Many keywords in many texts: an index of keywords, read by every task over its own texts.

Texts and keywords are compared as UTF-8 bytes, which finds the same places as comparing
characters.  A keyword is filed under one run of ``RUN`` bytes (a shorter keyword under all
of its bytes), the one that the fewest keywords have.  A text's runs are read as whole
numbers, one at each byte; a table of bits passes those that may be in the index, a sorted
lookup settles it, and at each run that is left its keywords are compared run by run.  Work
is in proportion to the bytes of the texts and to the runs found there, whatever the number
of keywords.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

RUN = 8
#: Positions of the texts worked on at once, and comparisons of one step.
POSITIONS, COMPARED = 1 << 20, 1 << 21
#: The bits table has so many entries a run of the index, at least.
BITS_PER_RUN = 16


def runs_at(data: np.ndarray) -> np.ndarray:
    """The run at each byte of ``data``, whose last ``RUN`` bytes are padding: a view, no copy."""
    return np.ndarray((len(data) - RUN,), "<u8", buffer=data, strides=(1,))


def _first(length: int) -> np.uint64:
    """Mask of a run's first bytes."""
    return np.uint64((1 << 8 * length) - 1)


def _padded(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts) + bytes(RUN), np.uint8)


def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): owners (0, 0, 1, 1, 1) and numbers (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class KeywordIndex:
    """Index of ``keywords``, in the order in which they are to be named (repeats are kept)."""

    def __init__(self, keywords: list[str]):
        self.keywords = keywords
        self.names = pa.array(keywords, pa.string())
        self.everywhere = np.array([i for i, k in enumerate(keywords) if k == ""], np.int64)
        found = [(i, k.encode()) for i, k in enumerate(keywords) if k != ""]
        self.number = np.array([i for i, _ in found], np.int64)
        self.size = np.array([len(b) for _, b in found], np.int64)
        self.data = _padded([b for _, b in found])
        self.start = np.cumsum(self.size) - self.size
        self.classes = [self._file(length) for length in range(1, RUN + 1)
                        if (np.minimum(self.size, RUN) == length).any()]

    def _file(self, length: int):
        """The keywords filed under runs of a length: (length, sorted runs, first place of
        each in the keyword list, keyword list, run's offset in each keyword, bits)."""
        own = np.flatnonzero(np.minimum(self.size, RUN) == length)
        windows = self.size[own] - length + 1
        owner, offset = _each(windows)
        runs = runs_at(self.data)[self.start[own][owner] + offset] & _first(length)
        _, at = np.unique(runs, return_inverse=True)
        # a keyword's own repeats of a run and repeated keywords count as well: any choice is right
        order = np.lexsort((np.bincount(at)[at], owner))
        best = order[np.cumsum(windows) - windows]
        runs, offset = runs[best], offset[best]
        by_run = np.argsort(runs, kind="stable")
        values, first = np.unique(runs[by_run], return_index=True)
        bits = max(16, int(len(values) * BITS_PER_RUN).bit_length())
        table = np.zeros(1 << bits, bool)
        table[_slot(values, bits)] = True
        return length, values, np.append(first, len(own)), own[by_run], offset[by_run], bits, table

    def _met(self, data: np.ndarray, low: int, high: int):
        """(position, keyword) candidates for the runs that begin at low..high, in steps."""
        for length, values, first, words, offsets, bits, table in self.classes:
            codes = runs_at(data[low:high + RUN])
            codes = codes & _first(length) if length < RUN else codes.copy()
            at = np.flatnonzero(table[_slot(codes, bits)])
            run = np.searchsorted(values, codes[at])
            held = (run < len(values)) & (values[np.minimum(run, len(values) - 1)] == codes[at])
            at, run = at[held] + low, run[held]
            many = first[run + 1] - first[run]
            ends = np.cumsum(many)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COMPARED, "right")))
                owner, k = _each(many[a:b])
                entry = first[run[a:b]][owner] + k
                yield at[a:b][owner] - offsets[entry], words[entry]
                a = b

    def _equal(self, data: np.ndarray, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which keywords stand whole at their positions (they end before the padding)."""
        text, key = runs_at(data), runs_at(self.data)
        left = np.arange(len(at))
        done = 0
        while len(left):
            rest = self.size[word[left]] - done
            # the last run of a longer keyword overlaps the one before it
            step = np.where((rest < RUN) & (done > 0), done + rest - RUN, done)
            short = np.minimum(self.size[word[left]], RUN)
            differ = (text[at[left] + step] ^ key[self.start[word[left]] + step]) & _MASKS[short]
            at[left[differ != 0]] = -1
            left = left[(differ == 0) & (rest > RUN)]
            done += RUN
        return at >= 0

    def find(self, texts: pa.Array) -> pa.Array:
        """For each text the keywords in it, in the order of the index (null text: none)."""
        texts = texts.cast(pa.large_string())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        raw = np.frombuffer(body, np.uint8)[edges[0]:edges[-1]] if body and len(edges) and edges[-1] > edges[0] else np.empty(0, np.uint8)
        data = np.append(raw, np.zeros(RUN, np.uint8))
        edges = edges - edges[0]
        found = [np.empty((0,), np.int64)]
        n = max(1, len(self.keywords))
        for low in range(0, len(raw), POSITIONS):
            for at, word in self._met(data, low, min(len(raw), low + POSITIONS)):
                row = np.searchsorted(edges, np.maximum(at, 0), "right") - 1
                inside = (at >= edges[row]) & (at + self.size[word] <= edges[row + 1])
                at, word, row = at[inside], word[inside], row[inside]
                whole = self._equal(data, at.copy(), word)
                found.append(np.unique(row[whole] * n + self.number[word[whole]]))
        if len(self.everywhere):
            rows = np.flatnonzero(~np.asarray(texts.is_null()))
            found.append((rows[:, None] * n + self.everywhere[None, :]).ravel())
        hits = np.unique(np.concatenate(found))
        row, word = hits // n, hits % n
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.names.take(pa.array(word)))


_MASKS = np.array([_first(length) for length in range(RUN + 1)], np.uint64)
