"""Conversation structure repair by a generalised LR parse with weighted edits.

A sound conversation is empty or an optional system turn and then (user, assistant) pairs;
the grammar works on the first letters of the roles:

    conversation ->  | s pairs | pairs          pairs -> pairs u a | u a

The parser reads one row at a time and keeps a graph-structured stack: a node is a stack
top with the node below it, so stacks share what lies beneath.  Every top may keep the row
(0), rerole it to user or assistant (2), delete it (3; the only way for a blank or repeated
row), and may anywhere take an inserted user or assistant turn (2); a truncated row that is
not deleted adds 1.  An action that the grammar's table does not allow for a top ends there.
After ``a`` the pair, and the pairs below it, are reduced.  Equal tops are merged by the
minimum (cost, audit); the audit has one letter an edit (Delete, Insert, Keep, Rerole).
That is safe: of two audits of equal cost for the same rows none begins the other, so what
follows cannot turn their order.

A conversation may hold a third of all rows.  Rows are numbered by range partitions and cut
into blocks of ``BLOCK``; a block becomes a string of one letter a row and is parsed alone,
from each top that it may be entered with.  The blocks of a conversation are then joined by
the same minimum, at a cost of a few string additions a block.  What meets in one task is the
conversation's audit, one byte a row, which is one cell of the result anyway.

Defined results: null conv_id is a conversation of its own; other nulls are one space;
rows are taken by turn (nulls first), ties by role, then text; rows with the same turn all
stay; input columns beside conv_id, turn, role and text are not read; empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgermatch.llm.common import key_of, ship
from ledgermatch.operators.ordering import with_row_index
from ledgermatch.session import materialize

BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1

#: What a stack top may be: nothing, a system turn, a user turn, whole pairs.
TOPS = ("", "s", "u", "p")
#: (top, next letter) -> new top; after ``a`` the reduction to pairs is done at once.
SHIFT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("p", "u"): "u", ("u", "a"): "p"}
#: Tops with which a conversation may end.
ENDS = ("", "p")

LETTERS, FAULTS = "sua-", ("fine", "blank", "duplicate", "truncated")
Node = namedtuple("Node", "top below cost audit")


def code(letter: str, fault: str) -> str:
    """One letter for a row: its role's first letter (``-``: another) and first fault."""
    return chr(65 + 4 * LETTERS.index(letter) + FAULTS.index(fault))


def _merge(tops: dict[str, Node], new: Node) -> bool:
    old = tops.get(new.top)
    if old is None or (new.cost, new.audit) < (old.cost, old.audit):
        tops[new.top] = new
        return True
    return False


def _shift(node: Node, letter: str, cost: int, edit: str) -> Node | None:
    top = SHIFT.get((node.top, letter))
    if top is None:
        return None
    below = node
    if top == "p":  # reduce: pop the user turn and the pairs before it, if this block saw them
        below = node.below
        if below is not None and below.top == "p":
            below = below.below
    return Node(top, below, node.cost + cost, node.audit + edit)


def _inserts(tops: dict[str, Node]) -> None:
    """Add what turns inserted here lead to; costs rise, so this ends."""
    open_ = list(tops.values())
    while open_:
        node = open_.pop()
        for letter in "ua":
            new = _shift(node, letter, INSERT, "I")
            if new is not None and _merge(tops, new):
                open_.append(new)


def parse(codes: str, entry: str) -> dict[str, tuple[int, str]]:
    """Top -> cheapest (cost, audit) after the rows, entered with the stack top ``entry``."""
    tops = {entry: Node(entry, None, 0, "")}
    _inserts(tops)
    for c in codes:
        k = ord(c) - 65
        letter, fault = LETTERS[k // 4], FAULTS[k % 4]
        after: dict[str, Node] = {}
        for node in tops.values():
            _merge(after, Node(node.top, node.below, node.cost + DELETE, node.audit + "D"))
            if fault not in ("blank", "duplicate"):
                cut = CUT if fault == "truncated" else 0
                for new in (_shift(node, letter, KEEP + cut, "K"), *(_shift(node, x, REROLE + cut, "R") for x in "ua")):
                    if new is not None:
                        _merge(after, new)
        _inserts(after)
        tops = after
    return {t: (n.cost, n.audit) for t, n in tops.items()}


def join_blocks(blocks: list[list[dict]]) -> tuple[int, str]:
    """Cheapest (cost, audit) through blocks given as rows (entry, top, cost, audit)."""
    tops = {"": (0, "")}
    for rows in blocks:
        after: dict[str, tuple[int, str]] = {}
        for r in rows:
            if r["entry"] in tops:
                cost, audit = tops[r["entry"]]
                # audits are only built where the cost is not beaten already
                if r["top"] not in after or cost + r["cost"] <= after[r["top"]][0]:
                    new = (cost + r["cost"], audit + r["audit"])
                    after[r["top"]] = min(after.get(r["top"], new), new)
        tops = after
    return min(tops[t] for t in ENDS if t in tops)


WAYS = "array<struct<entry: string, top: string, cost: bigint, audit: string>>"


def _parse_column():
    @arrow_udf(WAYS)
    def ways(codes: pa.Array, first: pa.Array) -> pa.Array:
        out = []
        for c, f in zip(codes.to_pylist(), first.to_pylist()):
            out.append([{"entry": e, "top": t, "cost": cost, "audit": audit}
                        for e in (TOPS[:1] if f else TOPS) for t, (cost, audit) in parse(c, e).items()])
        kind = pa.list_(pa.struct([("entry", pa.string()), ("top", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
        return pa.array(out, kind)

    return ways


def _join_column():
    @arrow_udf("struct<cost: bigint, audit: string>")
    def best(blocks: pa.Array) -> pa.Array:
        got = [join_blocks(b.as_py()) for b in blocks]
        return pa.StructArray.from_arrays([pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())], ["cost", "audit"])

    return best


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its
    text, 2 removes its full stops, 3 repeats it, 4 makes its role user."""
    t = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    t = t.withColumn("__lm_kind", F.crc32(name.cast("binary")) % 20).where("__lm_kind != 0")
    kind = F.col("__lm_kind")
    t = t.withColumn("text", F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    t = t.withColumn("role", F.when(kind == 4, "user").otherwise(F.col("role")))
    return t.withColumn("__lm_copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__lm_kind", "__lm_copy")


def _coded(rows: DataFrame) -> DataFrame:
    """(conv, place, letter, fault, turn) of numbered rows; no texts."""
    letter = F.substring("role", 1, 1)
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    thin = rows.select("__lm_conv", "__lm_place", "turn", F.when(letter.isin("s", "u", "a"), letter).otherwise("-").alias("letter"),
                       F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("fine").alias("fault"),
                       F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("same"))
    many = thin.groupBy("__lm_conv", "same").agg(F.min("__lm_place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = materialize(many.drop("n"), "repair-repeats")
    repeat = (F.col("fault") != "blank") & (F.col("__lm_place") > F.col("first"))
    return thin.join(many, ["__lm_conv", "same"], "left").select(
        "__lm_conv", "__lm_place", "turn", "letter", F.when(repeat, "duplicate").otherwise(F.col("fault")).alias("fault"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations given as rows (conv_id, turn, role, text).  Returns

    report   conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    turns    conv_id, place, edit, turn, role, text: the repaired turns in order; an inserted
             turn has a null turn and an empty text
    """
    ship()
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       key_of("conv_id").alias("__lm_conv"))
    placed = materialize(with_row_index(rows, ["turn", "role", "text"], "__lm_place", ["__lm_conv"]), "repair-rows")
    coded = materialize(_coded(placed), "repair-codes")
    letters = F.expr("char(65 + 4 * (locate(letter, 'sua-') - 1) + case fault when 'fine' then 0 when 'blank' then 1 when 'duplicate' then 2 else 3 end)")
    blocks = coded.groupBy("__lm_conv", F.expr(f"(__lm_place - 1) div {BLOCK}").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("__lm_place", letters.alias("c"), "letter"))).alias("r"))
    pair = F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1),
                      lambda x, y: F.when(F.concat(x["letter"], y["letter"]).isin("su", "ua", "au"), 0).otherwise(1))
    blocks = blocks.select("__lm_conv", "blk", F.array_join("r.c", "").alias("codes"),
                           F.aggregate(pair, F.lit(0), lambda s, x: s + x).alias("illegal"),
                           F.element_at("r.letter", 1).alias("head"), F.element_at("r.letter", -1).alias("tail"))
    blocks = materialize(blocks.withColumn("ways", _parse_column()("codes", F.col("blk") == 0)), "repair-blocks")
    convs = blocks.groupBy("__lm_conv").agg(F.sum("illegal").alias("inner"), F.array_sort(
        F.collect_list(F.struct("blk", "head", "tail", "ways"))).alias("b"))
    seam = F.zip_with(F.slice("b", 1, F.size("b") - 1), F.slice("b", 2, F.size("b") - 1),
                      lambda x, y: F.when(F.concat(x["tail"], y["head"]).isin("su", "ua", "au"), 0).otherwise(1))
    convs = convs.select("__lm_conv", (F.col("inner") + F.aggregate(seam, F.lit(0), lambda s, x: s + x)).alias("illegal"),
                         _join_column()(F.col("b.ways")).alias("best"))
    convs = materialize(convs.select("__lm_conv", "illegal", "best.*"), "repair-best")
    counts = coded.groupBy("__lm_conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).cast("bigint").alias("span"),
        *(F.count_if(F.col("fault") == f).cast("bigint").alias(f) for f in FAULTS[1:]))
    turns = coded.where("turn is not null").select("__lm_conv", "turn").distinct().groupBy("__lm_conv").agg(F.count(F.lit(1)).alias("seen"))
    ids = rows.select("__lm_conv", "conv_id").distinct()
    report = ids.join(counts, "__lm_conv").join(turns, "__lm_conv", "left").join(convs, "__lm_conv").select(
        "conv_id", (F.col("span") - F.coalesce("seen", F.lit(0))).alias("gaps"), *FAULTS[1:], F.col("illegal").cast("bigint").alias("illegal"),
        "cost", "audit")
    return report, _turns(placed, convs, ids)


def _walk(batches):
    """Rows (conversation, place, edit, row it takes, role it gets) of audits.  A sound
    conversation of odd length begins with its system turn, so places tell the roles."""
    for b in batches:
        for conv, audit in zip(*(c.to_pylist() for c in b.columns)):
            edits = np.frombuffer(audit.encode(), np.uint8)
            row, stays = np.cumsum(edits != ord("I")), edits != ord("D")
            edits, row = edits[stays], row[stays]
            place = np.arange(1, len(edits) + 1)
            user = (place - len(edits)) % 2 == 1
            for a in range(0, len(edits), 10_000):
                some = slice(a, a + 10_000)
                n = len(edits[some])
                yield pa.RecordBatch.from_arrays([
                    pa.array([conv] * n, pa.string()), pa.array(place[some], pa.int64()),
                    pa.array([chr(e) for e in edits[some]], pa.string()), pa.array(row[some], pa.int64(), mask=edits[some] == ord("I")),
                    pa.array(np.where(user[some], "user", "assistant"), pa.string())], ["conv", "place", "edit", "row", "as_role"])


def _turns(placed: DataFrame, convs: DataFrame, ids: DataFrame) -> DataFrame:
    """The repaired turns: audits are walked in parts, texts joined by (conversation, row),
    which is even however long a conversation is."""
    edits = convs.select("__lm_conv", "audit").mapInArrow(_walk, "conv string, place bigint, edit string, row bigint, as_role string")
    own = placed.select(F.col("__lm_conv").alias("conv"), F.col("__lm_place").alias("row"), "turn", "role", "text")
    made = edits.join(own, ["conv", "row"], "left").join(ids.withColumnRenamed("__lm_conv", "conv"), "conv")
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("as_role"))
    return made.select("conv_id", "place", "edit", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _digests(batches):
    conv = h = None
    for b in batches:
        names, texts = [], []
        for name, line in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            if name == conv:
                h.update(b"\n" + line)
                continue
            if conv is not None:
                names.append(conv)
                texts.append(h.hexdigest())
            conv, h = name, hashlib.sha256(line)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["conv", "digest"])
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([h.hexdigest()], pa.string())], ["conv", "digest"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv, digest): SHA-256 of each conversation's ``role:text`` lines; ``conv`` is the
    conversation's ``key_of``.  The hash runs over sorted rows as they stream by; no
    conversation is held."""
    lines = turns.select(key_of("conv_id").alias("conv"), "place", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "line").mapInArrow(_digests, "conv string, digest string")


def with_digests(rows: DataFrame, original: DataFrame) -> DataFrame:
    """Report of ``repair(rows)`` with ``repaired_sha256`` for every conv_id of ``original``;
    conversations without rows get zeros and empty texts."""
    report, turns = repair(rows)
    told = report.withColumn("conv", key_of("conv_id")).drop("conv_id").join(digests(turns), "conv", "left")
    ids = original.select("conv_id", key_of("conv_id").alias("conv")).distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *FAULTS[1:], "illegal", "cost")]
    return ids.join(told, "conv", "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(nothing)).alias("repaired_sha256"))
