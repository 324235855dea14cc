"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A text is cut into pre-tokens without a regex.  Every code point gets a class (a table
that is read off the tokenizer library once, see ``class_table``).  A small automaton
over the classes knows in which kind of pre-token a position lies.  Its transition
functions compose associatively: a batch of texts is cut into blocks of ``WIDTH``
positions, the function of each block is composed column by column for all blocks at
once, the block functions are scanned by doubling, and a last sweep gives the state at
each position.  Boundaries follow from the states of neighbouring positions.

The slices go through a cache from slice to ids; a slice that is not cached is merged
pair by pair.  Slice offsets are kept, so that any range of pre-tokens can be decoded
without the rest (``decode_range``).

Defined results: null text is empty text, which has no ids; special strings inside a text
are ordinary text; equal texts have equal ids.  The rank file is read on the driver and
travels with the function (under 1 MB), so executors need no copy of it.
"""

from __future__ import annotations

import base64
import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgermatch.llm.common import pieces, replace_columns, ship, utf8_lists

# Classes of code points.
OTHER_LETTER, C_STMD, C_RV, C_E, C_L, NUMBER, APOSTROPHE, OTHER, SPACE, WHITE, RESET, PAD = range(12)
# States: what the position's pre-token is.  Q: an apostrophe that opens a pre-token;
# QE, QL: a letter after it that completes a contraction if e, or l, follows; DONE: the
# last letter of a contraction.
START, LETTERS, NUMBERS, MARKS, AT_SPACE, AT_WHITE, Q, QE, QL, DONE = range(10)
N_STATES = 10
WIDTH = 64
#: Code points handled at once; longer texts go through in such parts with their state.
PART = 1 << 19
#: Slices that a worker keeps; beyond it the cache starts anew (results do not change).
CACHE_SLICES = 300_000
CACHE_CHARS = 12_000_000
#: Bytes beyond which a slice is merged by itself.
LONG_SLICE = 64
NO_PAIR = 1 << 40


def _transitions() -> np.ndarray:
    t = np.zeros((12, N_STATES), np.uint8)
    for c in (OTHER_LETTER, C_STMD, C_RV, C_E, C_L):
        t[c] = LETTERS
    t[C_STMD, Q] = DONE
    t[C_RV, Q] = QE
    t[C_L, Q] = QL
    t[C_E, QE] = DONE
    t[C_L, QL] = DONE
    t[NUMBER] = NUMBERS
    t[OTHER] = MARKS
    t[APOSTROPHE] = Q
    t[APOSTROPHE, [MARKS, Q, AT_SPACE]] = MARKS
    t[SPACE] = AT_SPACE
    t[WHITE] = AT_WHITE
    t[RESET] = START
    t[PAD] = np.arange(N_STATES)
    return t


_T = _transitions()
_FLAT = _T.tobytes().ljust(256, b"\0")


def _step(at: np.ndarray) -> np.ndarray:
    """The transition table at flat offsets (one byte each)."""
    return np.frombuffer(at.tobytes().translate(_FLAT), np.uint8).reshape(at.shape)


def class_table() -> np.ndarray:
    """The class of every code point, as the library's own ``\\p{L}``, ``\\p{N}`` and ``\\s``
    see it: each pattern is run over all code points and keeps those that match."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))

    def matching(pattern: str) -> np.ndarray:
        enc = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        return np.frombuffer(enc.decode_bytes(enc.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)

    table = np.full(0x110000, OTHER, np.uint8)
    table[matching(r"\p{L}")] = OTHER_LETTER
    table[matching(r"\p{N}")] = NUMBER
    table[matching(r"\s")] = WHITE
    for chars, c in (("stmd", C_STMD), ("rv", C_RV), ("e", C_E), ("l", C_L), ("'", APOSTROPHE), (" ", SPACE)):
        table[[ord(x) for x in chars]] = c
    return table


def scan_states(classes: np.ndarray, start: int = START) -> np.ndarray:
    """The automaton's state after each position, by an associative scan over blocks."""
    n = len(classes)
    rows = -(-n // WIDTH)
    padded = np.full(rows * WIDTH, PAD, np.uint8)
    padded[:n] = classes
    # column j holds position j of every block, as offsets into the flat transition table
    cols = np.ascontiguousarray(padded.reshape(rows, WIDTH).T) * np.uint8(N_STATES)
    fun = np.tile(np.arange(N_STATES, dtype=np.uint8)[:, None], (1, rows))
    for j in range(WIDTH):
        fun = _step(cols[j] + fun)
    fun = np.ascontiguousarray(fun.T)
    step = 1
    while step < rows:  # inclusive scan of the block functions by doubling
        later = np.take_along_axis(fun[step:], fun[:-step].astype(np.intp), axis=1)
        fun = np.concatenate([fun[:step], later])
        step *= 2
    state = np.concatenate([[start], fun[:-1, start]]).astype(np.uint8)
    out = np.empty((WIDTH, rows), np.uint8)
    for j in range(WIDTH):
        state = _step(cols[j] + state)
        out[j] = state
    return np.ascontiguousarray(out.T).ravel()[:n]


_GROUP = np.array([0, 1, 2, 3, 4, 4, 3, 1, 1, 5], np.uint8)  # of each state: letters, numbers, marks, white, contraction end


def boundaries(classes: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; positions of class RESET stand between texts."""
    n = len(classes)
    s = np.empty(n, np.uint8)
    carry = START
    for a in range(0, n, PART):
        s[a:a + PART] = scan_states(classes[a:a + PART], carry)
        carry = int(s[min(a + PART, n) - 1])
    prev = np.concatenate([[START], s[:-1]]).astype(np.uint8)
    nxt = np.concatenate([s[1:], [START]]).astype(np.uint8)
    g, gp = _GROUP[s], _GROUP[prev]
    white, white_before = g == 4, gp == 4
    b = g != gp
    # a letter after an opening apostrophe joins it only if the contraction gets complete
    joins = (prev == Q) & ((s == DONE) | (((s == QE) | (s == QL)) & (nxt == DONE)))
    b |= (prev == Q) & (g == 1)
    b &= ~joins
    b &= ~(((prev == QE) | (prev == QL)) & (s == DONE))
    # an apostrophe opens a pre-token only where its state says so
    b |= (s == Q)
    # the last of several white-space characters stands apart if something follows ...
    b |= white & white_before & (_GROUP[nxt] != 4) & (nxt != START)
    # ... and a space goes to what follows it
    b &= ~((prev == AT_SPACE) & ~white & (s != START))
    b |= (s == START) | (prev == START)
    return b


class Merger(dict):
    """Slice -> ids as little-endian unsigned 32-bit integers, for the slices seen so far."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        # every way to put a token together from two others, sorted by the pair of ids
        pairs = {(left << 32) | right: r for token, r in ranks.items() for i in range(1, len(token))
                 if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}
        self.pairs = np.array([*sorted(pairs), np.iinfo(np.int64).max], np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs[:-1].tolist()] + [NO_PAIR], np.int64)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def learn(self, slices: set[str]) -> None:
        """Merge all slices of the set and keep their ids."""
        short: list[str] = []
        for x in slices:
            data = x.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self[x] = whole.to_bytes(4, "little")
            elif len(data) <= LONG_SLICE:
                short.append(x)
            else:
                self[x] = np.array(self._merge_long(data), np.uint32).tobytes()
        if short:
            self.update(zip(short, self._merge_short([x.encode() for x in short])))

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], NO_PAIR)

    def _merge_short(self, data: list[bytes]) -> list[bytes]:
        """Pair merging of many slices side by side: in each round every slice joins its
        adjacent pair of lowest rank (the leftmost), until it has none."""
        out: list[bytes] = [b""] * len(data)
        names = np.arange(len(data))
        lengths = np.array([len(x) for x in data])
        ids = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        first = np.cumsum(lengths) - lengths
        rank = np.append(self._pair_ranks(ids[:-1], ids[1:]), NO_PAIR)
        rank[first + lengths - 1] = NO_PAIR  # a slice's last part has no right neighbour
        while len(names):
            best = np.minimum.reduceat(rank, first)
            done = best == NO_PAIR
            if done.any():
                small = ids.astype(np.uint32)
                for k, a, n in zip(names[done].tolist(), first[done].tolist(), lengths[done].tolist()):
                    out[k] = small[a:a + n].tobytes()
                stay = np.repeat(~done, lengths)
                ids, rank = ids[stay], rank[stay]
                names, lengths, best = names[~done], lengths[~done], best[~done]
                if not len(names):
                    break
                first = np.cumsum(lengths) - lengths
            own = np.repeat(np.arange(len(names)), lengths)
            hits = np.flatnonzero(rank == best[own])
            at = hits[np.append(True, own[hits[1:]] != own[hits[:-1]])]  # the leftmost of each slice
            ids[at] = best
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            ends = at + 1 == first + lengths - 1
            ids, rank = ids[left], rank[left]
            at -= np.arange(len(at))  # one part went from each slice before
            lengths = lengths - 1
            first = np.cumsum(lengths) - lengths
            rank[at] = np.where(ends, NO_PAIR, self._pair_ranks(ids[at], ids[np.minimum(at + 1, len(ids) - 1)]))
            before = at > first
            rank[at[before] - 1] = self._pair_ranks(ids[at[before] - 1], ids[at[before]])
        return out

    def _merge_long(self, data: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank (leftmost first) until none is left, with a
        heap over linked parts: n log n for one long slice."""
        ranks, n = self.ranks, len(data)
        part = [data[i:i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (r := ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]), len(part[j])))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j < 0 or len(part[i]) != a or len(part[j]) != b:
                continue  # one of the two has been merged since
            part[i], part[j] = part[i] + part[j], None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [ranks[p] for p in part if p is not None]


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, rank_file: bytes, classes: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        self.table = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.cache = Merger(self.ranks)
        self.held = 0  # characters of its slices
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.vocabulary[i] = token

    def slices(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pre-tokens of all texts in a row, their starts in the text joined by one
        separator each, and for every text the index of its first pre-token (and the end)."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.table[points]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # the separators
        classes[ends] = RESET
        starts = np.flatnonzero(boundaries(classes))
        cut = starts.tolist()
        found = [joined[a:b] for a, b in zip(cut, [*cut[1:], len(joined)])]
        return found, starts, np.searchsorted(starts, np.concatenate([[-1], ends]), side="right")

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
        """Ids of each text, and where its pre-tokens begin (in code points)."""
        out, offsets = [], []
        for a, b in pieces(texts, len, PART):
            found, starts, first = self.slices(texts[a:b])
            new = set(found).difference(self.cache)
            size = sum(map(len, new))
            if len(self.cache) + len(new) > CACHE_SLICES or self.held + size > CACHE_CHARS:
                self.cache.clear()
                new = set(found)
                self.held, size = 0, sum(map(len, new))
            self.held += size
            self.cache.learn(new)
            get, base = self.cache.__getitem__, 0
            for k in range(b - a):
                i, j = first[k], first[k + 1] - 1  # the last one is the separator
                out.append(b"".join(map(get, found[i:j])))
                offsets.append(starts[i:j] - base)
                base += len(texts[a + k]) + 1
        return out, offsets

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, np.uint32).tolist()))

    def decode_range(self, text_ids: bytes, offsets: np.ndarray, first: int, last: int) -> bytes:
        """Bytes of the pre-tokens ``first`` to ``last`` (exclusive) alone."""
        whole = [self.vocabulary[i] for i in np.frombuffer(text_ids, np.uint32).tolist()]
        heads = np.array([sum((x & 0xC0) != 0x80 for x in t) for t in whole], np.int64)
        inside = np.array([(t[0] & 0xC0) == 0x80 for t in whole], np.int64)
        # twice the code point at which a token begins, less one if it begins inside the one before
        at = 2 * (np.cumsum(heads) - heads) - inside
        lo, hi = (np.searchsorted(at, 2 * offsets[k]) if k < len(offsets) else len(whole) for k in (first, last))
        return b"".join(whole[lo:hi])


_CODECS: dict[tuple[int, int], Codec] = {}


def codec(rank_file: bytes, classes: bytes) -> Codec:
    """One codec for each worker process and rank file."""
    key = (zlib.crc32(rank_file), zlib.crc32(classes))
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, classes)
    return _CODECS[key]


def load_codec_files(path: str) -> tuple[bytes, bytes]:
    """What a codec is made of, read on the driver: the rank file and the packed class table."""
    ship()
    with open(path, "rb") as f:
        return f.read(), zlib.compress(class_table().tobytes())


ENCODED = "struct<ids: binary, n_tokens: bigint, offsets: array<bigint>>"


def encoder(path: str):
    """Column function: text -> struct of ids (binary), n_tokens and pre-token offsets."""
    files = load_codec_files(path)

    @arrow_udf(ENCODED)
    def encode(text: pa.Array) -> pa.Array:
        ids, offsets = codec(*files).encode(utf8_lists(text))
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.binary()), pa.array(lengths), pa.array(offsets, pa.list_(pa.int64()))],
            ["ids", "n_tokens", "offsets"])

    return encode


def decoder(path: str):
    """Column function: ids (binary) -> bytes."""
    files = load_codec_files(path)

    @arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        c = codec(*files)
        return pa.array([None if x is None else c.decode(x) for x in ids.to_pylist()], pa.binary())

    return decode


def round_trip(path: str):
    """Column function: text -> struct of ids, n_tokens and the bytes decoded from the ids,
    in one pass through a Python worker."""
    files = load_codec_files(path)

    @arrow_udf("struct<ids: binary, n_tokens: bigint, decoded: binary>")
    def run(text: pa.Array) -> pa.Array:
        c, done = codec(*files), []
        sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
        for a, b in pieces(sizes, int, PART):  # Python objects of one part at a time
            ids, _ = c.encode(utf8_lists(text.slice(a, b - a)))
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            done.append(pa.StructArray.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(lengths), pa.array([c.decode(x) for x in ids], pa.binary())],
                ["ids", "n_tokens", "decoded"]))
        return pa.concat_arrays(done) if done else pa.array([], pa.struct(
            [("ids", pa.binary()), ("n_tokens", pa.int64()), ("decoded", pa.binary())]))

    return run


def encode_decode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded`` (rows, repeated ones too, stay as
    they are; input columns of those names are replaced)."""
    made = docs.withColumn("__lm_bpe", round_trip(path)(F.col(text_col)))
    b: Column = F.col("__lm_bpe")
    return replace_columns(made, ids=b["ids"], n_tokens=b["n_tokens"], decoded=b["decoded"]).drop("__lm_bpe")
