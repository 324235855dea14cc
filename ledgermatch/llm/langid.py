"""Language identification by known words, backing off to character n-grams.

Fit: from labelled texts, the frequency of every word by language, and the frequencies of
character n-grams (words padded by ``_``) of ``NGRAMS`` lengths, weighted by how often
the word occurs.  The classifier is fitted on a bounded sample: at most about
``docs_per_language`` documents of each language, chosen by a hash of their id, so that
the choice does not depend on the partitioning.  Every word and n-gram of the sample is kept,
with its counts in every language; the sample bounds what is sent to the workers.

Predict: a word of the table adds its smoothed log frequency for each language.  A word
that no language knows is read by the longest n-grams; where none is known, by the next
shorter ones, at a cost of ``BACKOFF`` each step; its score is the mean over its
positions.  The language of the highest sum wins (ties: the first by code point).
``score`` is its share after a softmax of the sums.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is every
text if there is nothing to learn from.  Repeated rows get the same answer.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgermatch.llm.common import ship

NGRAMS = (4, 3, 2, 1)
BACKOFF = math.log(0.4)
UNSEEN = 0.5
#: Words a worker keeps; beyond it the cache starts anew (results do not change).
CACHE_WORDS = 400_000
CACHE_CHARS = 16_000_000
#: Least share of a text's words that its language knows, for texts of ``ENOUGH_WORDS`` and more.
KNOWN_SHARE, ENOUGH_WORDS = 0.25, 5
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


class Counts(Mapping):
    """Entry -> its counts by language, held as columns: a Python object an entry takes
    several times the memory."""

    def __init__(self, entries: pa.Array, counts: np.ndarray):
        self.entries, self.counts, self._at = entries, counts, None

    @classmethod
    def of(cls, counts: DataFrame, langs: list[str]) -> Counts:
        t = counts.groupBy("entry").agg(*[
            F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, k in enumerate(langs)]).toArrow()
        return cls(t["entry"], np.stack([t[f"n{i}"].to_numpy() for i in range(len(langs))], axis=1))

    @classmethod
    def none(cls) -> Counts:
        return cls(pa.array([], pa.string()), np.zeros((0, 0), np.int64))

    def __len__(self):
        return len(self.entries)

    def __iter__(self):
        return iter(self.entries.to_pylist())

    def __getitem__(self, entry: str) -> list[int]:
        if self._at is None:
            self._at = {k: i for i, k in enumerate(self)}
        return self.counts[self._at[entry]].tolist()


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_language: int = 4000) -> dict:
    """A model (bounded, see above) from the rows that have a language."""
    d = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"langs": [], "words": Counts.none(), "ngrams": Counts.none()}
    langs = sorted(sizes)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, docs_per_language / sizes[k])))])
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    found = (d.where(spot < share[F.col("lang")])
             .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("entry"))
             .groupBy("lang", "entry").agg(F.count(F.lit(1)).alias("n")).persist())
    padded = F.concat(F.lit("_"), F.col("entry"), F.lit("_"))

    def of_length(k: int) -> Column:
        # a lambda with a second parameter would be handed the position there
        last = F.length(padded) - (k - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(
            F.lit(k).alias("k"), F.substring(padded, i, F.lit(k)).alias("entry")))).otherwise(
            F.array().cast("array<struct<k:int,entry:string>>"))

    grams = (found.select("lang", "n", F.explode(F.flatten(F.array(*[of_length(k) for k in NGRAMS]))).alias("g"))
             .select("lang", "n", "g.k", "g.entry").groupBy("lang", "k", "entry").agg(F.sum("n").alias("n")))
    model = {"langs": langs, "words": Counts.of(found, langs), "ngrams": Counts.of(grams, langs)}
    found.unpersist()
    return model


def pack(model: dict) -> dict:
    """The model as a few long strings: what is sent to the workers."""
    def table(c: Counts, rows=slice(None)) -> tuple[str, bytes]:
        entries = c.entries.to_pylist() if isinstance(rows, slice) else c.entries.take(pa.array(rows)).to_pylist()
        return "\n".join(entries), c.counts[rows].astype(np.int64).tobytes()

    grams = model["ngrams"]
    sizes = np.array([len(k) for k in grams], np.int64)
    return {"langs": model["langs"], "words": table(model["words"]),
            "ngrams": [table(grams, np.flatnonzero(sizes == size)) for size in NGRAMS]}


class Predictor:
    """The packed model in one worker process, with the scores of the words seen so far."""

    def __init__(self, packed: dict):
        self.langs = packed["langs"]
        n = len(self.langs)
        self.known, self.logs = self._table(packed["words"])
        counts = np.frombuffer(packed["words"][1], np.int64)
        self.occurs = counts.reshape(-1, n) > 0 if n else np.zeros((0, 0), bool)
        # one table for the n-grams of all lengths, the cost of backing off included; its last
        # row stands for places where no n-gram is known
        self.grams: dict[str, int] = {}
        logs = []
        for step, t in enumerate(packed["ngrams"]):
            rows, log = self._table(t)
            before = len(self.grams)
            self.grams.update((g, before + i) for g, i in rows.items())
            logs.append(log + step * BACKOFF)
        floor = logs[-1].min() + BACKOFF if len(logs[-1]) else math.log(UNSEEN) + len(NGRAMS) * BACKOFF
        self.gram_logs = np.concatenate([*logs, np.full((1, n), floor)])
        self.rows: dict[str, int] = {}
        self.held = 0  # characters of the words kept
        self.table = np.zeros((1 << 12, n))
        self.seen = np.zeros((1 << 12, n), bool)  # languages that know the word

    def _table(self, packed: tuple[str, bytes]) -> tuple[dict[str, int], np.ndarray]:
        """Row numbers of the entries, and their smoothed log frequencies by language."""
        if not packed[0]:
            return {}, np.zeros((0, len(self.langs)))
        m = np.frombuffer(packed[1], np.int64).reshape(-1, len(self.langs)) + UNSEEN
        return {k: i for i, k in enumerate(packed[0].split("\n"))}, np.log(m / m.sum(axis=0))

    def word(self, w: str) -> np.ndarray:
        hit = self.known.get(w)
        if hit is not None:
            return self.logs[hit]
        p, get, at = f"_{w}_", self.grams.get, []
        for i in range(max(1, len(p) - NGRAMS[0] + 1)):
            for size in NGRAMS:
                g = get(p[i:i + size]) if i + size <= len(p) else None
                if g is not None:
                    at.append(g)
                    break
            else:
                at.append(-1)
        return self.gram_logs[at].mean(axis=0)

    def row(self, w: str) -> int:
        k = len(self.rows)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        self.table[k] = self.word(w)
        hit = self.known.get(w)
        self.seen[k] = False if hit is None else self.occurs[hit]
        self.held += len(w)
        self.rows[w] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score, share of the words that the language knows, and their number."""
        ws = _WORD.findall((text or "").lower())
        if not self.langs or not any(c.isalpha() for w in ws for c in w):
            return UNDETERMINED, 0.0, 0.0, len(ws)
        if len(self.rows) > CACHE_WORDS or self.held > CACHE_CHARS:
            self.rows.clear()
            self.held = 0
        get = self.rows.get
        at = [get(w, -1) for w in ws]
        if -1 in at:
            at = [k if k >= 0 else (get(w, -1) if w in self.rows else self.row(w)) for k, w in zip(at, ws)]
        sums = self.table[at].sum(axis=0)
        best = int(sums.argmax())
        return self.langs[best], float(1 / np.exp(sums - sums[best]).sum()), float(self.seen[at, best].mean()), len(ws)


_PREDICTORS: dict[str, Predictor] = {}


def predictor(packed: dict, key: str) -> Predictor:
    if key not in _PREDICTORS:
        _PREDICTORS.clear()
        _PREDICTORS[key] = Predictor(packed)
    return _PREDICTORS[key]


def language(model: dict):
    """Column function: text -> struct of lang_pred, score, known (share of the text's words
    that the language knows) and n_words."""
    ship()
    packed = pack(model)
    key = hashlib.sha256(pickle.dumps(packed)).hexdigest()

    @arrow_udf("struct<lang_pred: string, score: double, known: double, n_words: bigint>")
    def predict(text: pa.Array) -> pa.Array:
        p = predictor(packed, key)
        got = [p.predict(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64()))],
            ["lang_pred", "score", "known", "n_words"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: CRC-32 of the id as text (null: empty text) divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """``docs`` with a struct ``__lm_lang`` of lang_pred and score, learnt from the rows that
    are not held out."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **limits)
    return docs.withColumn("__lm_lang", language(model)(F.col(text_col)))


def keep_identified(docs: DataFrame, least: float = 0.5, known: float = KNOWN_SHARE, **limits) -> DataFrame:
    """``docs`` without the rows whose language is undetermined, scored below ``least``, or
    knows less than ``known`` of their words.  The last does not depend on a text's length:
    however long, text in no learnt language goes; texts of under ``ENOUGH_WORDS`` words are
    too short to tell and go by the score alone."""
    got = F.col("__lm_lang")
    marked = identify(docs, **limits)
    familiar = (got["known"] >= known) | (got["n_words"] < ENOUGH_WORDS)
    return marked.where((got["lang_pred"] != UNDETERMINED) & (got["score"] >= least) & familiar).drop("__lm_lang")
