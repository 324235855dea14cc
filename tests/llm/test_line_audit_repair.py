"""Line index, source divergence and conversation repair against plain Python."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from ledgermatch.llm import chat_repair, divergence, line_index
from ledgermatch.session import ensure_checkpoint_dir

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, N_LINES string, kept int"


def new_path(spark):
    return f"{ensure_checkpoint_dir(spark)}/test-lines-{uuid.uuid4().hex}"


# ---- op11 ----

def line_rows():
    rng = random.Random(5)
    shared = [f"A line that many documents hold, number {i}" for i in range(6)] + ["ÄÖÜ" * 7, "ÄÖÜ" * 6, "short one"]
    rows = [(None, "\n".join(shared)), (None, shared[0]), (1, None), (2, ""), (3, "\n\n"), (4, "x" * 50000 + "\n" + shared[1].upper() + " \t")]
    for i in range(5, 60):
        lines = rng.choices(shared, k=rng.randint(0, 6)) + [f"line of document {i} alone, {rng.random()}" for _ in range(3)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(x if rng.random() < 0.6 else "\x0b " + x.upper() + "\r" for x in lines)))
    return rows + [(7, "\n".join(shared)), rows[20], rows[20]]


def cleaned(rows, index_rows, at_least=3, least=20):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for d, t in index_rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(-1 if d is None else d)
    there = {d for d, _ in index_rows}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: d in there and len(holders[key(x)]) >= at_least and max(holders[key(x)]) != (-1 if d is None else d)
        kept = [x for x in lines if not gone(x)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def read(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(a, b, None, None, "x", 1) for a, b in rows], DOCS)


def test_line_index_grows_and_shrinks(spark):
    rows = line_rows()
    docs, path = frame(spark, rows), new_path(spark)
    index = line_index.LineIndex(spark, path, shards=3)
    first, rest = [r for r in rows if (r[0] or 0) % 2], [r for r in rows if not (r[0] or 0) % 2]
    index.insert(frame(spark, first))
    assert read(index.clean(frame(spark, first))) == cleaned(first, first)
    index.insert(frame(spark, rest), rounds=2)
    index.insert(frame(spark, rest[:4]))  # ids that are there already
    got = index.clean(docs)
    assert read(got) == cleaned(rows, rows)
    assert [c.lower() for c in got.columns].count("n_lines") == 1
    # deletions undo insertions: exact counts, filters and results are those of the rest
    index.delete(spark.createDataFrame([(None,), (59,), (58,), (999,)] + [(k,) for k in range(5, 30)], "id bigint"))
    left = [r for r in rows if r[0] is not None and r[0] not in (58, 59) and not 5 <= r[0] < 30]
    again = line_index.LineIndex(spark, path, shards=3)  # opened as it was left
    assert read(again.clean(frame(spark, left))) == cleaned(left, left)
    fresh = line_index.LineIndex(spark, new_path(spark), shards=3)
    fresh.insert(frame(spark, left))
    table = lambda x: sorted((r.key, r.n, r.last) for r in x.counts().collect())
    assert table(again) == table(fresh)
    used = lambda x: sum(int(np.count_nonzero(np.frombuffer(r.slots, "<u2"))) for r in x.filters().collect())
    assert used(again) == used(fresh) == len(table(fresh))
    again.insert(frame(spark, [r for r in rows if r not in left]))
    assert read(again.clean(docs)) == cleaned(rows, rows)


def test_lines_of_empty_tables(spark):
    assert line_index.dedup_lines(frame(spark, []), new_path(spark)).count() == 0
    some = frame(spark, [(1, None), (2, "a")])
    assert read(line_index.dedup_lines(some, new_path(spark))) == [(1, 1, 0, ""), (2, 1, 0, "a")]


def test_cuckoo_filter_holds_every_key():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(60000)]
    f = line_index.Cuckoo.sized(40000)
    assert f.insert(keys[:30000]) and f.insert(keys[30000:40000])
    assert f.probe(keys[:40000]).all() and f.probe(keys[40000:]).mean() < 0.002
    f.delete(keys[:20000])
    assert f.probe(keys[20000:40000]).all() and f.probe(keys[:20000]).mean() < 0.002
    assert f.insert(keys[:20000]) and line_index.Cuckoo.load(f.dump()).probe(keys[:40000]).all()
    assert not line_index.Cuckoo.sized(10).insert(keys[:500])  # too full: told, not dropped


# ---- op12 ----

def audit_rows():
    rng = random.Random(11)
    vocabulary = ["a", "Bee", "straße", "abcdefgh", "abcdefghi", "sixteenletterswd", "seventeenletters1", "é" * 9, "漢字" * 40, "x" * 300]
    rows = []
    for i in range(200):
        lang = ["en", "de", None, "xx"][i % 4] if i < 150 else "en"
        words = rng.choices(vocabulary, weights=range(1, 11), k=rng.randint(0, 30))
        rows.append((i, " 1,".join(w.upper() if rng.random() < 0.3 else w for w in words), lang, rng.choice(["s1", "s2", None, "s3"])))
    rows += [(900, None, "en", "silent"), (901, "", "zz", "alone"), (902, "lonely", "yy", "b"), (903, "lonely", "yy", "a")]
    return rows + [rows[3], (None, "a a a", "en", "s1"), (905, "a " * 50000 + "ab" * 40000, "en", "s2")]


def audited(rows, least, top):
    langs = defaultdict(list)
    for _, text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        langs[lang or ""].append((source or "", terms))
    out = []
    for lang, docs in langs.items():
        df = Counter(t for _, terms in docs for t in set(terms))
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for s, terms in docs:
            counts[s].update(t for t in terms if t in kept)
        every = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s in counts:
            pairs = [(-sum(abs(share(counts[s], t) - share(counts[o], t)) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(share(every, t) - share(counts[s], t), t.encode()) for t in counts[s] if share(counts[s], t) > share(every, t)]
            for part, found in (("pair", pairs), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(sorted(found), 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top,sides", [(30, 50, (256, 2048)), (2, 3, (2, 3)), (10**6, 50, (256, 2048))])
def test_source_divergence(spark, monkeypatch, least, top, sides):
    monkeypatch.setattr(divergence, "SOURCES", sides[0])
    monkeypatch.setattr(divergence, "TERMS", sides[1])
    docs = spark.createDataFrame([(*r, "x", 1) for r in audit_rows()], "doc_id bigint, text string, lang string, source string, term string, N int")
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(docs, least, top).collect())
    assert got == audited(audit_rows(), least, top)
    if top == 50:
        assert divergence.audit(docs.limit(0), least, top).count() == 0


def test_term_buckets():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abzé .漢", weights=[9, 9, 9, 3, 2, 1, 1], k=rng.randint(0, 400))).encode() for _ in range(300)]
    group = np.array([rng.randrange(3) for _ in texts], np.uint16)
    g, terms, n, docs = divergence.count_terms(texts, group)
    want, seen = Counter(), defaultdict(set)
    for k, t in enumerate(texts):
        for term in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.decode()):
            want[group[k], term] += 1
            seen[group[k], term].add(k)
    got = {(a, b): (c, d) for a, b, c, d in zip(g.tolist(), terms.to_pylist(), n.tolist(), docs.tolist())}
    assert len(got) == len(g) and got == {k: (v, len(seen[k])) for k, v in want.items()}
    assert len(divergence.count_terms([b"", b"1 2"], np.zeros(2, np.uint16))[0]) == 0


# ---- op13 ----

def cheapest(rows):
    """Plain alignment of (letter, fault) rows with every sound role sequence."""
    best = None
    for pairs in range(len(rows) + 2):
        for head in ("", "s") if pairs else ("",):
            target = head + "ua" * pairs

            @lru_cache(None)
            def least(i, j):
                ways = []
                if i == len(rows) and j == len(target):
                    return 0, ""
                if j < len(target) and target[j] in "ua":
                    c, a = least(i, j + 1)
                    ways.append((c + 2, "I" + a))
                if i < len(rows):
                    letter, fault = rows[i]
                    c, a = least(i + 1, j)
                    ways.append((c + 3, "D" + a))
                    if fault in ("fine", "truncated") and j < len(target):
                        c, a = least(i + 1, j + 1)
                        c += fault == "truncated"
                        if letter == target[j]:
                            ways.append((c, "K" + a))
                        if target[j] in "ua":
                            ways.append((c + 2, "R" + a))
                return min(ways, default=(10**9, ""))

            got = (*least(0, 0), target)
            best = min(best or got, got)
    return best


def test_parser_and_blocks_against_alignment():
    rng = random.Random(4)
    for _ in range(1500):
        rows = [(rng.choice("suaua-"), rng.choice(["fine"] * 5 + ["blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 8))]
        want = cheapest(rows)[:2]
        codes = "".join(chat_repair.code(*r) for r in rows)
        ends = chat_repair.parse(codes, "")
        assert min(ends[t] for t in chat_repair.ENDS if t in ends) == want
        cuts = sorted(rng.choices(range(len(codes) + 1), k=3))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        blocks = [[{"entry": e, "top": t, "cost": c, "audit": a} for e in chat_repair.TOPS for t, (c, a) in chat_repair.parse(p, e).items()] for p in parts]
        assert chat_repair.join_blocks(blocks) == want


def talk_rows():
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), role, rng.choice(["Hi.", "What?  ", "cut off", "  ", "A. B! C?\n", "ü漢."]) + str(rng.choice(["", turn, "."]))))
    rows += [(None, 0, "system", "Be kind."), (None, 1, "user", "Hi!"), (None, None, "tool", None), (None, None, None, "x."), (70, None, None, None)]
    rows += [(71, 1, "user", "Same."), (71, 1, "user", "Same."), (72, 5, "user", "z" * 50000 + "."), (72, 9, "assistant", "ok.")]
    return rows + [(80, t, ["user", "assistant", "assistant"][t % 3], f"Turn {t // 4}" + "." * (t % 5 > 0)) for t in range(300)]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(original, search):
    rows = defaultdict(list)
    for r in damaged(original):
        rows[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in original}:
        got = sorted(rows[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, coded = set(), []
        for _, _, role, text in got:
            last = text.rstrip(SPACE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "fine"
            seen.add((role, text))
            coded.append((role[:1], fault))
        turns = [r[1] for r in got if r[1] is not None]
        cost, audit = search(coded)
        k, lines = 0, []
        odd = (len(audit) - audit.count("D")) % 2
        for e in audit:
            role, text = (None, "") if e == "I" else got[k][2:]
            k += e != "I"
            if e != "D":
                lines.append(f"{role if e == 'K' else ['user', 'assistant'][(len(lines) - odd) % 2]}:{text}")
        n = Counter(f for _, f in coded)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_conversation_repair(spark, monkeypatch, block):
    monkeypatch.setattr(chat_repair, "BLOCK", block)
    data = spark.createDataFrame([(*r, "x", 1) for r in talk_rows()], "conv_id bigint, turn bigint, role string, text string, CONV string, cost int").repartition(5)
    want = repaired(talk_rows(), lambda rows: cheapest(rows)[:2] if len(rows) < 20 else _long(rows))
    got = chat_repair.with_digests(chat_repair.damage(data), data).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[1:]) == want[r.conv_id], r.conv_id
    assert chat_repair.with_digests(chat_repair.damage(data.limit(0)), data.limit(0)).count() == 0


def _long(rows):
    """Left-to-right search over how far the role sequence has come."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def grow(at):
        for _ in range(4):
            for (x, role), y in step.items():
                if x in at and role != "s":
                    at[y] = min(at.get(y, (10**9, "")), (at[x][0] + 2, at[x][1] + "I"))
        return at

    at = grow({"": (0, "")})
    for letter, fault in rows:
        new = {x: (c + 3, a + "D") for x, (c, a) in at.items()}
        for (x, role), y in step.items():
            if x in at and fault in ("fine", "truncated"):
                c, a = at[x][0] + (fault == "truncated"), at[x][1]
                if role == letter:
                    new[y] = min(new.get(y, (10**9, "")), (c, a + "K"))
                if role != "s":
                    new[y] = min(new.get(y, (10**9, "")), (c + 2, a + "R"))
        at = grow(new)
    return min(at[x] for x in ("", "a") if x in at)
