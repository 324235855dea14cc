"""Token counts of texts with a whole-token shortcut.

The model's pieces never hold a space mark after another character, so no merge crosses
the start of a run of spaces; nor does one touch a character that is in no longer piece
(such as a line feed).  A text therefore falls apart into pre-tokens whose counts add up.
Both facts are read off the vocabulary when the counter is made, and a model without them
is refused.  On the driver, every vocabulary string that can be a pre-token is encoded
alone once; those that come out as one token form the table of whole tokens.  A worker
counts a pre-token of that table as one and hands only the rest to the library's merging,
keeping what it has learnt.

Defined results: null text is empty text; empty text has no tokens; no begin, end or
other special tokens; special strings in a text are ordinary text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgermatch.llm.common import pieces, replace_columns, ship, utf8_lists

#: Pre-tokens a worker keeps; beyond it the cache starts anew (results do not change).
CACHE_PRETOKENS = 600_000
CACHE_CHARS = 24_000_000
#: Characters handled at once.
PART = 1 << 20
MARK = "▁"


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def prove(model: bytes) -> tuple[str, list[str]]:
    """The pattern that cuts texts into pre-tokens, and the pre-tokens that alone are one
    token.  Raises ValueError if the model does not allow to cut at spaces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(model)
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix \
            or not norm.escape_whitespaces or spec.trainer_spec.model_type != pb.TrainerSpec.BPE:
        raise ValueError("the model changes texts before it splits them, or is no BPE model")
    normal = [p.piece for p in spec.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL]
    if any(p.type in (4, 5) for p in spec.pieces) or any(re.search(f"[^{MARK}]{MARK}", p) for p in normal):
        raise ValueError("the model has pieces that cross the start of a run of spaces")
    joined = {ch for p in normal if len(p) > 1 for ch in p}
    alone = "".join(ch for ch in "\n\r\t" if ch not in joined)
    if "\n" not in alone:
        raise ValueError("the model has pieces with line feeds")
    cut = f"[{alone}]| +[^ {alone}]*|[^ {alone}]+"
    sp = _processor(model)
    spaced = [p.replace(MARK, " ") for p in normal]
    candidates = [x for x in spaced if re.fullmatch(" +[^ ]+", x) and not set(x) & set(alone)]
    # the library puts one space mark before what it encodes: the pre-token's first
    whole = [x for x, ids in zip(candidates, sp.encode([x[1:] for x in candidates])) if len(ids) == 1]
    return cut, whole


class Counter(dict):
    """Pre-token -> number of tokens, in one worker process."""

    def __init__(self, model: bytes, cut: str, whole: list[str]):
        super().__init__()
        self.sp = _processor(model)
        self.find = re.compile(cut).findall
        self.whole = dict.fromkeys(whole, 1)
        self.update(self.whole)
        self.held = 0  # characters kept
        self.line = self.sp.encode("\n")[1:]  # without the space mark put first

    def learn(self, pretokens: set[str]) -> None:
        """Have the library merge the pre-tokens, one a line (line feeds never merge), and
        keep their counts: what lies between the ids of two line feeds."""
        if "\n" in pretokens:
            self["\n"] = len(self.line)
        rest = [x for x in pretokens if x != "\n"]
        for a in range(0, len(rest), 4096):
            some = rest[a:a + 4096]
            ids = np.array(self.sp.encode("\n" + "\n".join(some) + "\n"))
            ends = np.flatnonzero(ids == self.line[-1])
            self.update(zip(some, (np.diff(ends) - len(self.line)).tolist()))

    def count(self, texts: list[str]) -> np.ndarray:
        out: list[int] = []
        for a, b in pieces(texts, len, PART):
            found = [self.find(" " + t.replace(MARK, " ")) if t else [] for t in texts[a:b]]
            every = set().union(*found)
            new = every.difference(self)
            size = sum(map(len, new))
            if len(self) + len(new) > CACHE_PRETOKENS or self.held + size > CACHE_CHARS:
                self.clear()
                self.update(self.whole)
                new = every.difference(self)
                self.held, size = 0, sum(map(len, new))
            self.held += size
            self.learn(new)
            out += [sum(map(self.__getitem__, f)) for f in found]
        return np.array(out, np.int64)


_COUNTERS: dict[int, Counter] = {}


def counter(model: bytes, cut: str, whole: list[str]) -> Counter:
    key = zlib.crc32(model)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(model, cut, whole)
    return _COUNTERS[key]


def token_counter(path: str):
    """Column function: text -> number of tokens by the model at ``path``."""
    with open(path, "rb") as f:
        model = f.read()
    cut, whole = prove(model)
    ship()

    @arrow_udf("bigint")
    def count(text: pa.Array) -> pa.Array:
        return pa.array(counter(model, cut, whole).count(utf8_lists(text)))

    return count


def count_tokens(docs: DataFrame, path: str, limit: int, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.  Repeated rows
    stay; input columns of these names are replaced."""
    made = docs.withColumn("__lm_n", token_counter(path)(F.col(text_col)))
    return replace_columns(
        made, n_bytes=F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint"),
        n_tokens=F.col("__lm_n"), over_limit=F.col("__lm_n") > F.lit(limit)).drop("__lm_n")
