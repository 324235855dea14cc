"""Operators against plain Python on small tables with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns whose names clash."""

import base64
import bisect
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgermatch.llm import bpe, chat, langid, mixing, pivots, simhash, sketch, token_counts, training_order, url_templates
from ledgermatch.session import materialize

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, N_TOKENS string, size string"


def docs_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    base = " ".join(word() for _ in range(60))
    texts = [None, "", " \n\t ", "One", "one two", base, base, base.upper(), base + " tail", base.replace("a", "b", 1),
             "it's\n\n  I'll 're 12三4 ''s <|endoftext|> ▁x　y​", "x" * 30000, "a b " * 9000, "12 ## !!"]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(5, base, None, None), (5, base, None, None), (None, "null id " + base, None, "s0"), (None, None, None, None), (3, "other text", "en", "s1")]
    return [(a, b, c, d, None, "x", "y", "z") for a, b, c, d in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(docs_rows(), DOCS), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_token_counts(docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(token_counts.count_tokens(docs, path, 100))
    assert len(got) == len(docs_rows())
    for r in got:
        n = len(sp.encode(r["text"] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 100)
    assert token_counts.count_tokens(empty, path, 1).count() == 0
    assert [c.lower() for c in token_counts.count_tokens(docs, path, 1).columns].count("n_tokens") == 1


def test_pretokens_fuzz():
    import sentencepiece
    import tiktoken

    rng = random.Random(3)
    parts = ["'s", "'", " the", "▁", "r", "l", "e", "v", "ll", "1", "٣", " ", "  ", "\n", "\t", "　", "é", "!", "<s>", "中", "\U0001f600", "\xa0", "\0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(5000)] + ["ab" * 5000, "= " * 900]
    model = open(P.path("piece_bpe_32k.model"), "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert token_counts.counter(model, *token_counts.prove(model)).count(texts).tolist() == [len(x) for x in sp.encode(texts)]
    c = bpe.codec(*bpe.load_codec_files(P.path("byte_bpe_50k.tiktoken")))
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    ids, offsets = c.encode(texts)
    for t, i, o in zip(texts, ids, offsets):
        assert np.frombuffer(i, np.uint32).tolist() == enc.encode_ordinary(t)
        assert c.decode(i).decode() == t
        if len(o) > 3:
            assert c.decode_range(i, o, 1, 3).decode() == t[o[1]:o[3]]


def test_byte_bpe(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(bpe.encode_decode(docs, path)):
        want = enc.encode_ordinary(r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode_decode(empty, path).count() == 0
    e = docs.select(bpe.encoder(path)("text").alias("e")).select("e.ids", bpe.decoder(path)("e.ids").alias("d"), "e.offsets")
    assert e.where("d is null or offsets is null").count() == 0


def plain_fingerprint(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_groups(values, close):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1:]:
            if close(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


def near(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2


def test_simhash(docs, empty):
    got = rows(simhash.near_duplicates(docs))
    data = docs_rows()
    groups = plain_groups({plain_fingerprint(r[1]) for r in data}, near)
    least = {}
    for r in data:
        if r[0] is not None:
            g = groups[plain_fingerprint(r[1])]
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(((r[0], plain_fingerprint(r[1]), least.get(groups[plain_fingerprint(r[1])])) for r in data), key=repr)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(groups[plain_fingerprint(r["text"])] for r in rows(kept)) == sorted(set(groups.values()))
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("cap", [0, 3, 64])
def test_simhash_links_with_any_cap(spark, cap):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for _ in range(120)}
    values |= {rng.getrandbits(64) for _ in range(60)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    from ledgermatch.llm.components import components

    got = {r["node"]: r["root"] for r in rows(components(simhash.links(fps, 2, cap)))}
    want = plain_groups({signed(v) for v in values}, near)
    assert {v: got.get(v, v) for v in want} == want


def test_language(spark, docs, empty):
    vocabulary = {"en": "the of and house river".split(), "de": "der die und haus fluss".split()}
    rng = random.Random(1)
    data = []
    for i in range(300):
        lang = "en" if i % 3 else "de"
        data.append((i, " ".join(rng.choices(vocabulary[lang], k=12)), lang))
    data += [(900, None, "en"), (901, "12 34 !!", "en"), (902, "riverhouse", None), (903, "", None), (900, None, "en"), (None, "der fluss", "de")]
    d = spark.createDataFrame(data, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    found = langid.identify(d).select("doc_id", "text", langid.held_out().alias("held"), F.col("__lm_lang.lang_pred").alias("p"), F.col("__lm_lang.score").alias("s"))
    for r in rows(found):
        assert r["held"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["s"] <= 1
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["p"], r["s"]) == ("und", 0.0)
        elif r["text"] == "riverhouse":
            assert r["p"] == "en"
        else:
            assert r["p"] == ("en" if set(r["text"].split()) & set(vocabulary["en"]) else "de")
    assert langid.keep_identified(d).count() == len(data) - 4
    assert langid.keep_identified(d).columns == d.columns
    assert langid.identify(empty).count() == 0
    assert {r["__lm_lang"]["lang_pred"] for r in rows(langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


def test_language_ngrams_of_all_lengths(spark):
    d = spark.createDataFrame([(1, "river Riverbed a", "en"), (2, "fluss", "de")], "doc_id bigint, text string, lang string")
    model = langid.fit(d)
    want = {}
    for w, at in (("river", 1), ("riverbed", 1), ("a", 1), ("fluss", 0)):  # languages in order: de, en
        p = f"_{w}_"
        for k in langid.NGRAMS:
            for i in range(len(p) - k + 1):
                want.setdefault(p[i:i + k], [0, 0])[at] += 1
    assert model["langs"] == ["de", "en"] and model["ngrams"] == want


def test_language_keeps_every_entry(spark):
    # 21000 words and 7000 letters a language: more than 20000 words, more than 5000 1-grams
    letters = {"aa": [chr(0x4E00 + i) for i in range(7000)], "bb": [chr(0xAC00 + i) for i in range(7000)]}
    data = [(i + 1, " ".join(c + c[:1] * k for c in cs for k in (0, 1, 2)), lang) for i, (lang, cs) in enumerate(letters.items())]
    model = langid.fit(spark.createDataFrame(data, "doc_id bigint, text string, lang string"))
    assert model["words"] == {w: [int(lang == "aa"), int(lang == "bb")] for _, t, lang in data for w in t.split()}
    assert {k: n for k, n in model["ngrams"].items() if len(k) == 1 and k != "_"} == {
        c: [6 * (lang == "aa"), 6 * (lang == "bb")] for lang, cs in letters.items() for c in cs}


def plain_sketch(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if x]
    xx = lambda v, s: xxhash.xxh64(v, seed=s).intdigest()

    def chain(hs):
        s = 42
        for v in hs:
            s = xx(struct.pack("<Q", v), s)
        return s

    h = [xx(x, 42) for x in w]
    a = {chain(h[i:i + 5]) for i in range(len(h) - 4)} if len(h) >= 5 else {chain(h)} if h else set()
    return sorted(x - (1 << 64) if x >> 63 else x for x in a)[:sketch.K]


def plain_likeness(a, b):
    u = sorted(set(a) | set(b))[:sketch.K]
    return len(set(a) & set(b) & set(u)) / len(u) if u else 1.0


def order_of_rows(r):
    h = xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()
    return r[0] is not None, r[0] or 0, h - (1 << 64) if h >> 63 else h, (r[1] or "").encode()


@pytest.mark.parametrize("per_range", [1, 4, 4096])
def test_fingerprints(docs, empty, per_range, monkeypatch):
    monkeypatch.setattr(sketch.with_next, "__defaults__", sketch.with_next.__defaults__[:-1] + (per_range,))
    data = sorted(((r[0], r[1] or "") for r in docs_rows()), key=order_of_rows)
    want = []
    for i, (k, t) in enumerate(data):
        after = data[(i + 1) % len(data)][1]
        h = len(t) // 2
        e = t[:len(t) - h] + after[:h]
        s = plain_sketch(t)
        want.append((k, len(t), e, s, plain_sketch(e), plain_likeness(s, plain_sketch(e)), plain_likeness(s, plain_sketch(after))))
    got = [(r["doc_id"], r["n_chars"], r["edited"], r["sketch"], r["edited_sketch"], r["near_edited"], r["near_next"])
           for r in rows(sketch.edit_likeness(docs))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sketch.edit_likeness(empty).count() == 0


@pytest.mark.parametrize("hot", [None, -3, 900, 5000])
def test_next_rows_of_hot_ids(spark, hot):
    """One id (or null; the first, one in between, the last) holds a third of all rows: several
    ranges share it, every row has its one next, and no range holds more than a few times its share."""
    data = [(i, f"t {i}") for i in range(1200)] + [(hot, f"hot {i % 550}") for i in range(600)] + [(None, "n"), (7, ""), (7, "")]
    d = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in sketch.with_next(d, rows_per_range=20).collect()]
    data.sort(key=order_of_rows)
    assert sorted(got, key=repr) == sorted(((*r, data[(i + 1) % len(data)][1]) for i, r in enumerate(data)), key=repr)
    cuts, _ = sketch.find_cuts(d, 20)
    keys = [order_of_rows(r)[:3] for r in data]
    edges = [bisect.bisect_left(keys, (c[0] is not None, c[0] or 0, c[1])) for c in cuts]
    sizes = [b - a for a, b in zip([0, *edges], [*edges, len(data)])]
    assert len([c for c in cuts if c[0] == hot]) >= 10 and min(sizes) >= 1 and max(sizes) < 4 * 42


def test_containment(spark):
    w = [f"w{i}" for i in range(3000)]
    d = spark.createDataFrame([(" ".join(w[:1000]), " ".join(w)), (" ".join(w), " ".join(w[:1000])), ("", "a"), ("a b", ""), ("a b", "a b")], "a string, b string")
    got = [r[0] for r in d.select(sketch.containment(sketch.sketch("a"), sketch.sketch("b"))).collect()]
    assert got[0] > 0.75 and abs(got[1] - 1 / 3) < 0.15 and got[2:] == [1.0, 0.0, 1.0]


def test_sketch_parts_merge(spark):
    w = [f"w{i}" for i in range(900)]
    parts = [(1, " ".join(w[i:i + 34])) for i in range(0, 900, 30)]  # overlap by four words
    d = spark.createDataFrame(parts * 5, "k int, text string").withColumn("s", sketch.sketch("text"))
    whole = spark.createDataFrame([(" ".join(w),)], "text string").select(sketch.sketch("text").alias("s"), sketch.distinct_shingles(sketch.sketch("text")).alias("n"))
    r = whole.first()
    assert sketch.merge_all(d, "k", "s").first()["s"] == r["s"]
    assert abs(r["n"] - 896) < 250


def test_mixing(docs, empty):
    got = rows(mixing.take_counts(docs))
    data = docs_rows()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    per = {}
    for r in data:
        per[r[3]] = per.get(r[3], 0) + size(r[1])
    names = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(per.values()) - sum(3 * per[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * per[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * per[s] if s in capped else level * weight[s] for s in names}
    taken = {}
    for r in got:
        assert r["size"] <= r["source_size"] == per[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in names:  # as near as the documents allow: half the largest group of equal rows
        assert abs(taken[s] - target[s]) <= max(sum(size(x[1]) for x in data if x[:2] == y[:2] and x[3] == s) for y in data if y[3] == s)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(size(r["text"]) for r in rows(mixed)) == sum(r["taken"] for r in got)
    assert mixing.take_counts(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_refines_the_boundary_bucket(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL_BITS", 4)
    d = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "case when id % 3 = 0 then 'a' else 'b' end as source")
    for r in rows(mixing.take_counts(d).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"))):
        assert abs(r["t"] - r["g"]) <= 3.5


def test_chats(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", None),
             (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", ""), (4, 5, "user", "hi"), (5, 0, None, "a <|im_end|> b"), (6, 0, None, "a <|im_end|> b"),
             (None, 0, "user", "hi"), (None, None, "user", "first"), (7, 0, "user", "z"), (7, 0, "user", "z"), (8, 0, "user", "z")]
    d = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("key", F.lit("clash"))
    for block, part in ((1, 1), (2, 2), (4096, 256)):
        got = rows(chat.format_chats(d, block, part))
        whole = {}
        for r in sorted(got, key=lambda r: r["part"]):
            whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["text"]
        assert set(whole) == {2, 3, 5, None, 7}
        assert whole[5] == "<|im_start|>unknown\na <| im_end|> b<|im_end|>\n"
        assert whole[2].endswith("<|im_start|>user\n<|im_end|>\n") and whole[None].startswith("<|im_start|>user\nfirst")
    assert chat.format_chats(d.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://badexample.org/en/1",
            "http://x.com/fr/1", "http://x.com/de/1", "http://com/fr/", "http://x.net/a/" + "b/" * 300, "http://x.net?q=/z", "http://é.net/päth#x"]
    urls += [f"http://big.com/{'de' if i % 2 else 'en'}/{i}" for i in range(60)] + ["http://x.com/fr/1"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    got = {r["page_id"]: r for r in rows(url_templates.judge(d))}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fit)[1] if fit else None)
        assert r["verdict"] == (max(fit)[2] if fit else r["verdict"]) and r["verdict"] in ("allow", "block")
    assert got[13]["template"] != got[14]["template"]  # en and de differ in their labels
    assert url_templates.judge(d.limit(0)).count() == 0


def test_url_sections_have_no_share_or_depth_limit(spark):
    deep = "/".join("abcdefgh")
    urls = [(f"http://h.x/s{k}/{i}", 1 if k == 7 and i < 40 else 0 if i < 40 else None) for k in range(60) for i in range(100)]
    urls += [(f"http://d.x/{deep}/{'bad' if i % 2 else 'good'}/{i}", i % 2 if i < 90 else None) for i in range(100)]
    urls += [("http://e.x/" + "q/" * 200, b) for b in (0, 1, None, None)]
    d = spark.createDataFrame(urls, "url string, bad int").select(
        "url", url_templates.host_of("url").alias("host"), url_templates.path_of("url").alias("path"), "bad")
    t = url_templates.templates(d)
    p = {(r["host"], r["template"]): r["purity"] for r in rows(url_templates.purities(t))}
    got = {r["url"]: p[r["host"], r["template"]] >= 0.5 for r in rows(t)}
    assert t.count() == len(urls) and len(got) == len({u for u, _ in urls})
    for u, _ in urls[:6100]:
        assert got[u] == ("/s7/" in u or "/bad/" in u), u


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    data = []
    for i in range(500):
        v = centres[i % 40] + rng.normal(size=24) * (0.25 if i % 40 else 0.02)
        data.append((i, [float(x) for x in v], i % 3 if i % 17 != 5 else None))
    data += [(500 + i, data[0][1], 0) for i in range(50)]
    data += [(600, None, 0), (601, [0.0] * 24, 0), (602, [float("nan")] + [1.0] * 23, 0), (603, [None] + [1.0] * 23, 0), (604, [1.0, 2.0], 0),
             (605, [1.0, 2.0], 0), (606, [float("inf")] + [1.0] * 23, 0), (None, data[1][1], 1)]
    d = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    fine = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in data
            if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {}, {i: i for i, _, _ in data if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (i, v, l) in enumerate(fine):
        for j, w, m in fine[x + 1:]:
            if l == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for block in (16, 2048):  # 16: lists are cut into chunks
        got = {r["vec_id"]: r for r in rows(pivots.near_vectors(d, block=block))}
        assert len(got) == len(data)
        assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(links.values())
        assert all(r["n_links"] <= links.get(i, 0) for i, r in got.items())
        assert np.mean([got[i]["component_id"] == find(i) for i in root]) >= 0.95
        assert got[0]["n_links"] == links[0] and got[604]["n_links"] == 1
    assert pivots.near_vectors(d.limit(0)).count() == 0


def test_pivots_of_one_cluster(spark):
    rng = np.random.default_rng(11)
    centre = rng.normal(size=16)
    x = centre + 0.3 * rng.normal(size=(120, 16)) * np.linalg.norm(centre) / 4
    x[:40] = x[40:80] + 0.05 * rng.normal(size=(40, 16))
    pair = [[1.0, 2.0], [1.0, 2.2]]
    data = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)] + [(900 + i, v, 0) for i, v in enumerate(pair)]
    d = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")
    assert {k: len(p) for k, p in pivots.choose_pivots(pivots.entries_of(d, "vec_id", "embedding", "label").withColumn(
        "dim", F.size("embedding"))).items()} == {16: 1, 2: 1}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert links.sum() > 100
    for block in (16, 2048):
        got = {r["vec_id"]: r for r in rows(pivots.near_vectors(d, block=block))}
        assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()
        assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in (900, 901)] == [(1, 900, True), (1, 900, False)]


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        for key in (0, 5, 1 << 70):
            assert sorted(training_order.permute(np.arange(n), n, key).tolist()) == list(range(n))
    assert training_order.permute(np.arange(1000), 1000, 1).tolist() != training_order.permute(np.arange(1000), 1000, 2).tolist()


def test_training_order(spark, docs, empty):
    import tiktoken

    rank_path, length, end = P.path("byte_bpe_50k.tiktoken"), 64, 50256
    path = training_order.shards_folder(spark, "test-shards")
    assert training_order.write_shards(docs, path, rank_path, P.PATTERN, end, 9, length, 4) == -(-len(docs_rows()) // 4)
    got = sorted(rows(training_order.read_sequences(spark, path, length)), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(len(got)))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    every = sum(len(enc.encode_ordinary(r[1] or "")) + 1 for r in docs_rows())
    assert sum(r["n_ids"] for r in got) == every and all(len(r["ids"]) == 2 * length for r in got)
    streams = {}
    for r in docs_rows():
        streams.setdefault(r[0], []).append([*enc.encode_ordinary(r[1] or ""), end])
    for r in got:  # a record begins with the ids its header names
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert any(s[r["offset"]:][:r["n_ids"]] == ids[:min(r["n_ids"], len(s) - r["offset"])] for s in streams[r["doc_id"]])
    middle = rows(training_order.read_sequences(spark, path, length, 3, 9))
    assert sorted(r["slot"] for r in middle) == list(range(3, 9))
    again = training_order.shards_folder(spark, "test-shards")
    training_order.write_shards(docs, again, rank_path, P.PATTERN, end, 9, length, 4)
    digest = lambda x: sorted((r["slot"], hashlib.sha256(r["ids"]).hexdigest()) for r in rows(training_order.read_sequences(spark, x, length)))
    assert digest(path) == digest(again)
    # nor does it matter when the sorts spill
    spill = "spark.shuffle.spill.numElementsForceSpillThreshold"
    spilled = training_order.shards_folder(spark, "test-shards")
    spark._jsc.sc().conf().set(spill, "10")
    try:
        training_order.write_shards(docs, spilled, rank_path, P.PATTERN, end, 9, length, 4)
    finally:
        spark._jsc.sc().conf().remove(spill)
    assert digest(path) == digest(spilled)
    nothing = training_order.shards_folder(spark, "test-none")
    empty.write.parquet(nothing)
    assert training_order.write_shards(spark.read.parquet(nothing), path + "x", rank_path, P.PATTERN, end, 9) == 0
