"""The pipeline's stages on rows of all kinds, each against plain Python."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as C
from ledgermatch.llm import simhash
from ledgermatch.session import materialize

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, __lm_note string"


def doc_rows():
    rng = random.Random(12)
    words = {"en": ["".join(rng.choices("etaoinsh", k=rng.randint(2, 6))) for _ in range(300)],
             "de": ["".join(rng.choices("ernscüßd", k=rng.randint(2, 6))) for _ in range(300)]}
    rows = []
    for i in range(300):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randint(8, 80))) + ".", lang, f"s{i % 3}" if i % 7 else None))
    gibberish = [" ".join("".join(rng.choices("qxzvwkjf", k=rng.randint(3, 9))) for _ in range(k)) for k in (20, 300, 4000)]
    rows += [(1000 + k, t, None, "s0") for k, t in enumerate(gibberish)]
    rows += [(2000, None, "en", "s1"), (2001, "", "en", "s1"), (2002, " \n 12 ##", None, None), (2003, rows[4][1].upper(), "en", "s2"),
             (2004, rows[4][1], "en", "s2"), (2005, rows[6][1] + " " + rows[8][1], "en", None), (None, rows[10][1] + " extra", None, "s0"),
             (2006, " ".join(words["en"]) * 60, "en", "s0"), rows[12], rows[12]]
    return [(a, b, c, d, len(b or ""), "x", "note") for a, b, c, d in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(doc_rows(), DOCS).repartition(3), "test-pipeline")


@pytest.fixture(scope="module")
def staged(spark, docs):
    out, now = {}, docs
    for name, stage in C.STAGES:
        out[name] = (now, now := materialize(stage(spark, now, ""), f"test-{name}"))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stage_names_and_columns(docs, staged):
    assert [n for n, _ in C.STAGES] == ["language", "neardup", "mixture", "tokens"]
    for name in ("language", "neardup", "mixture"):
        assert staged[name][1].columns == docs.columns


def test_language_drops_letterless_and_gibberish_alone(staged):
    before, after = (Counter((r["doc_id"], r["text"]) for r in rows(d)) for d in staged["language"])
    gone = before - after
    assert {k[0] for k in gone} == {1000, 1001, 1002, 2000, 2001, 2002} and not after - before


def test_neardup_keeps_one_of_each_group(staged):
    before, after = (rows(d) for d in staged["neardup"])
    prints = [simhash.fingerprint_of((r["text"] or "").encode(), 3) for r in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    assert len(after) == len(set(group))
    at = {}
    for g, r in zip(group, before):
        at.setdefault((r["doc_id"], r["text"]), g)
    assert len({at[r["doc_id"], r["text"]] for r in after}) == len(after)


def test_mixture_comes_near_its_targets(staged):
    before, after = (rows(d) for d in staged["mixture"])
    size = lambda r: len(r["text"].split())
    copies = Counter((r["doc_id"], r["text"]) for r in after)
    assert set(copies) <= {(r["doc_id"], r["text"]) for r in before} and max(copies.values()) <= 3
    had, has = Counter(), Counter()
    for r in before:
        had[r["source"]] += size(r)
    for r in after:
        has[r["source"]] += size(r)
    total, largest = sum(had.values()), max(map(size, before))
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(had, key=lambda s: (s is None, s or "")))}
    target, left = {}, set(had)
    while left:  # over the limit first, the excess reshared
        level = (total - sum(target.values())) / sum(weights[s] for s in left)
        over = {s for s in left if level * weights[s] > 3 * had[s]}
        target |= {s: 3 * had[s] for s in over} if over else {s: level * weights[s] for s in left}
        left -= over or left
    assert all(abs(has[s] - target[s]) <= largest for s in had)


def test_tokens_are_those_of_the_library(staged):
    import tiktoken

    before, after = (rows(d) for d in staged["tokens"])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in before:
        ids = np.array(enc.encode_ordinary(r["text"]), "<u4")
        want[r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert want == Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after)


def test_empty_tables_stay_empty(spark, docs):
    now = docs.limit(0)
    for name, stage in C.STAGES:
        now = materialize(stage(spark, now, ""), f"test-empty-{name}")
        assert now.isEmpty()
