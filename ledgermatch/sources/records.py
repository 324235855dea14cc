"""CSV records of files that are split over many tasks, quoted line feeds included.

A line feed belongs to a cell when an odd number of quotes stands before it in its file
(a doubled quote counts twice).  So a line needs to know no more of what is before it than
one bit, and files need not be read whole by one task:

1. one pass gives a row for each split: the parity of its quotes, the number of records
   that begin in it if it begins outside quotes and if inside, and a file's first record;
2. the quote parities of a file's splits give, by an exclusive prefix sum over that small
   table, the bit with which each split begins, and so its number of records;
3. a second pass puts the lines of each split together to records as they come (a task reads a
   split in order).  Lines are not shuffled; only the pieces of records that lie in several
   splits, at most two a split, are grouped.

Record numbers within a file are the split's offset plus the place in the split; offsets
are a prefix sum over the same small table.  Blank lines outside quotes are skipped
everywhere, before the header, too, and have no number.  A file that ends inside quotes
raises, with its name.  Both line ends, ``\\n`` and ``\\r\\n``, are taken; a byte-order mark is
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermatch.session import materialize, ship_code

LINE, FILE, SPLIT, MONO = "__lm_line", "__lm_file", "__lm_split", "__lm_mono"
#: Splits up to which their table goes to every task; beyond, the lines are sorted to it.
SPLITS_TO_TASKS = 1 << 18
BLANK = ["", "\r", "\ufeff", "\ufeff\r"]


def _lines(spark: SparkSession, path, keep: Column | None) -> DataFrame:
    """Lines with their file and split; files that fail ``keep`` (a condition on ``FILE``)
    are not opened."""
    read = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    read = read.select(F.col("value").alias(LINE), F.col("_metadata.file_path").alias(FILE),
                       F.col("_metadata.file_block_start").alias(SPLIT))
    if keep is not None:
        read = read.where(keep)
    return read.withColumn(MONO, F.monotonically_increasing_id())


def _clean(text) -> Column:
    """Without the carriage return of its line end."""
    return F.regexp_replace(F.col(text), "\r\\z", "")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of each split in order, a part of a split at a time: (is it a new split, rows)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, split = batch.column(FILE), batch.column(SPLIT).to_numpy()
        change = (split[1:] != split[:-1]) | pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            key = file[i].as_py(), int(split[i])
            yield key != last, key, batch.slice(i, j - i)
            last = key


def _parities(lines: pa.Array, quoted: bool, start: int) -> tuple[np.ndarray, int]:
    """Parity of the quotes before each line, and after the last."""
    if not quoted:
        return np.zeros(len(lines), np.int64), 0
    odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    upto = start + np.cumsum(odd)
    return (upto - odd) & 1, int(upto[-1] & 1)


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.is_in(lines, value_set=pa.array(BLANK, lines.type)).to_numpy(zero_copy_only=False)


def _text(parts: list[pa.Array]) -> str:
    return "\n".join(x for part in parts for x in part.to_pylist())


SPLITS = f"{FILE} string, {SPLIT} bigint, odd int, outside bigint, inside bigint, head string"


def _summary(quoted: bool):
    """A row for each split: ``outside`` and ``inside`` count the records that begin in it if it
    begins there; ``head`` is a file's first record if it ends in the file's first split."""
    def row(key: tuple, odd: int, counts: list, head: list, done: bool) -> dict:
        known = key[1] == 0 and head and (done or not odd)
        return {FILE: key[0], SPLIT: key[1], "odd": odd, "outside": counts[0], "inside": counts[1], "head": _text(head) if known else None}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(FILE, pa.string()), (SPLIT, pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()),
                            ("inside", pa.int64()), ("head", pa.string())])
        state = None
        for new, key, rows in _segments(batches):
            if new:
                if state:
                    yield pa.RecordBatch.from_pylist([row(*state)], schema)
                state = (key, 0, [0, 0], [], False)
            _, odd, counts, head, done = state
            lines = rows.column(LINE)
            before, odd = _parities(lines, quoted, odd)
            full = ~_blank(lines)
            begins = np.flatnonzero(full & (before == 0))
            if key[1] == 0 and not done and (head or len(begins)):
                first = 0 if head else begins[0]
                ends = begins if head else begins[1:]
                done = len(ends) > 0
                here = slice(first, ends[0] if done else len(lines))
                kept = full[here] | (before[here] == 1)
                head = [*head, lines.slice(first, here.stop - first).filter(pa.array(kept))]
            counts = [counts[0] + len(begins), counts[1] + int((full & (before == 1)).sum())]
            state = (key, odd, counts, head, done)
        if state:
            yield pa.RecordBatch.from_pylist([row(*state)], schema)

    return of


RECORDS = "file string, rec bigint, split bigint, text string, piece boolean"


def _assemble(quoted: bool):
    """Records of the splits' lines, which come with their split's bit and offset; ``piece``:
    the record began in a split before or goes on behind this one."""
    def rows_of(key: tuple, recs, texts, piece: bool) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0], pa.string()), n), pa.array(recs, pa.int64()),
                                           pa.repeat(pa.scalar(key[1], pa.int64()), n), texts, pa.repeat(piece, n)],
                                          names=["file", "rec", "split", "text", "piece"])

    def one(key: tuple, rec: int, parts: list, piece: bool) -> pa.RecordBatch:
        return rows_of(key, [rec], pa.array([_text(parts)], pa.string()), piece)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for new, at, rows in _segments(batches):
            if new:
                if key and held:
                    yield one(key, off + begun, held, begun == 0 or odd == 1)
                key, begun, held = at, 0, []  # ``held``: the lines of the record that is open
                odd, off = rows.column("inside")[0].as_py(), rows.column("off")[0].as_py()
                if odd is None:
                    raise ValueError(f"the splits of {at[0]} have changed while it was read")
            lines = rows.column(LINE).cast(pa.string())
            before, odd = _parities(lines, quoted, odd)
            full = ~_blank(lines)
            keep = full | (before == 1)
            begins = (full & (before == 0))[keep]
            if not keep.all():
                lines = lines.filter(pa.array(keep))
            starts = np.flatnonzero(begins)
            if not len(starts):
                held += [lines] if len(lines) else []
                continue
            held += [lines.slice(0, starts[0])] if starts[0] else []
            if held:
                yield one(key, off + begun, held, begun == 0)
            ends = starts[1:]
            if len(ends):
                texts = lines.slice(starts[0], ends[-1] - starts[0])
                if len(texts) > len(ends):
                    cuts = np.concatenate([starts[:1], ends]) - starts[0]
                    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), texts), "\n")
                yield rows_of(key, off + begun + 1 + np.arange(len(ends)), texts, False)
            begun += len(starts)
            held = [lines.slice(starts[-1])]
        if key and held:
            yield one(key, off + begun, held, begun == 0 or odd == 1)

    return of


def read_records(spark: SparkSession, path, keep: Column | None = None, quoted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(file, rec, text): the non-blank records of every file, numbered from 1, and
    (file, records, head): every file's number of records and first record; files without
    a record are in neither.  ``quoted=False``: every line is a record."""
    ship_code(spark)
    lines = _lines(spark, path, keep)
    splits = materialize(lines.select(FILE, SPLIT, LINE).mapInArrow(_summary(quoted), SPLITS), "csv-splits")
    open_ = [r[0] for r in splits.groupBy(FILE).agg((F.sum("odd") % 2).alias("left")).where("left = 1")
             .orderBy(FILE).limit(5).select(FILE).collect()]
    if open_:
        raise ValueError(f"a quote is not closed in: {', '.join(open_)}")

    # one row a split
    before = Window.partitionBy(FILE).orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    bit = (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int")
    splits = splits.withColumn("bit", bit).withColumn("records", F.when(F.col("bit") == 0, F.col("outside")).otherwise(F.col("inside")))
    splits = materialize(splits.select(FILE, SPLIT, F.col("bit").alias("inside"), F.col("odd"), "records", "head",
                                       F.coalesce(F.sum("records").over(before), F.lit(0)).alias("off")), "csv-offsets")
    few = splits.count() <= SPLITS_TO_TASKS

    def assembled(offsets: DataFrame, how: str) -> DataFrame:
        # lines stay in the order in which a task reads them, or are put into it again
        offsets = offsets.select(FILE, SPLIT, "inside", "off")
        if few:
            placed = lines.join(F.broadcast(offsets), [FILE, SPLIT], how)
        else:
            placed = lines.join(offsets, [FILE, SPLIT], how).repartition(FILE, SPLIT).sortWithinPartitions(FILE, SPLIT, MONO)
        return placed.select(FILE, SPLIT, LINE, "inside", "off").mapInArrow(_assemble(quoted), RECORDS)

    cut = splits.where((F.col("inside") == 1) | (F.col("odd") == 1))
    records = assembled(splits, "left").where("not piece").select("file", "rec", "text")
    if not cut.isEmpty():
        # a group is one record: its pieces
        pieces = assembled(cut, "inner").where("piece").groupBy("file", "rec").agg(
            F.array_sort(F.collect_list(F.struct("split", "text"))).alias("l"))
        records = records.unionByName(pieces.select("file", "rec", F.array_join("l.text", "\n").alias("text")))
    files = splits.groupBy(F.col(FILE).alias("file")).agg(F.sum("records").alias("records"), F.max("head").alias("head")).where("records > 0")
    late = materialize(files.where("head is null").select("file"), "csv-late-heads")
    if not late.isEmpty():
        heads = records.where("rec = 1").join(late, "file").select("file", F.col("text").alias("late"))
        files = files.join(heads, "file", "left").select("file", "records", F.coalesce("head", "late").alias("head"))
    files = files.select("file", "records", F.regexp_replace(_clean("head"), "^\ufeff", "").alias("head"))
    return records.select("file", "rec", _clean("text").alias("text")), materialize(files, "csv-files")
