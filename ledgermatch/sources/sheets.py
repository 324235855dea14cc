"""Sheet sources and sinks.

Canonical column names used by the operators:

* master:  ``row_pos, supplier, default_payment_method, invoice_total`` (+ pass-through)
* sheets:  ``sheet_id, row_pos, vendor, invoice_amount``

``read_sheet_csv`` maps the spreadsheet headers (``Vendor``, ``Invoice Amount``,
``Supplier``, ``Default payment method``, ``Invoice Total``) to these names.  All
cells are read as text; parsing happens in the operators.
"""

from __future__ import annotations

import csv
import io
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermatch.functions.render import csv_header, csv_line
from ledgermatch.session import ensure_checkpoint_dir, materialize
from ledgermatch.sources.records import FILE, read_records

# --- fixed values (must equal the reference behaviour) -----------------------------
MASTER_HEADERS = ["Supplier", "Default payment method", "Invoice Total"]
SHEET_HEADERS = ["Vendor", "Invoice Amount"]
DEFAULT_MASTER_SHEET = "Universal Database"
MISSING_COLUMNS = "{} missing columns: {}"
NO_SHEET = 'Sheet "{}" not found. Available sheets: {}'
# ---------------------------------------------------------------------------------

HEADER_TO_COLUMN = {
    "Supplier": "supplier",
    "Default payment method": "default_payment_method",
    "Invoice Total": "invoice_total",
    "Vendor": "vendor",
    "Invoice Amount": "invoice_amount",
}
COLUMN_TO_HEADER = {v: k for k, v in HEADER_TO_COLUMN.items()}
MASTER_COLUMNS = ["supplier", "default_payment_method", "invoice_total"]
SHEET_COLUMNS = ["vendor", "invoice_amount"]


def require_columns(df: DataFrame, required, label: str) -> None:
    """S3: raise ``ValueError("<label> missing columns: a, b")`` before any job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(MISSING_COLUMNS.format(label, ", ".join(COLUMN_TO_HEADER.get(c, c) for c in missing)))


def with_canonical_names(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(HEADER_TO_COLUMN.get(c, c)) for c in df.columns])


def with_header_names(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(COLUMN_TO_HEADER.get(c, c)) for c in df.columns])


def _header_names(head: str, file: str) -> list[str]:
    """Column names of a header record, read by the CSV parser (a name may be quoted and
    hold line feeds).  An empty name becomes its place; names that sheets use themselves get
    the ending ``_cell``.  Repeated names raise."""
    names = [n or f"column {i}" for i, n in enumerate(next(csv.reader(io.StringIO(head, newline=""))), 1)]
    known = [HEADER_TO_COLUMN.get(n, n) for n in names]
    known = [f"{n}_cell" if n in ("sheet_id", "row_pos") else n for n in known]
    repeated = sorted({n for n, k in zip(names, known) if known.count(k) > 1})
    if repeated:
        raise ValueError(f"repeated headers: {', '.join(repeated)} (in {file})")
    return known


def _sheet_of(file: Column) -> Column:
    """The text behind ``sheet_id=`` in a file's path (null for Spark's null folder), else the
    path.  A partition folder escapes its value, and a path as a URI escapes that once more."""
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    part = F.regexp_extract(file, r"/sheet_id=([^/]*)/", 1)
    return F.when(part == "__HIVE_DEFAULT_PARTITION__", F.lit(None)).when(part != "", plain(plain(part))).otherwise(file)


def sheet_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(sheet_id, file, size) of the files below ``path``; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    file = F.col("_metadata.file_path")
    return listed.select(_sheet_of(file).alias("sheet_id"), file.alias("file"), F.col("_metadata.file_size").alias("size"))


def read_sheet_csv(spark: SparkSession, path: str, multiline: bool = True, sheet: str | None = None,
                   one_sheet: bool = False) -> DataFrame:
    """CSV sheets (header row, UTF-8, all cells text) with file order as ``row_pos``.

    Files may be of any size and are read by many tasks, quoted line feeds and all (see
    ``sources.records``; ``multiline=False`` takes every line for a record).  Every file's
    first non-blank record is its header; the distinct headers reach the driver, no list of
    files.  A sheet has all columns that any file has, null where its own file has none.
    ``sheet_id`` is the text behind ``sheet_id=`` in the path, else the file path;
    ``row_pos`` counts from 1 within a sheet by (file, record).  ``sheet``: only the files of
    this sheet are opened.  ``one_sheet``: all files are parts of one sheet (null id).
    """
    keep = None if sheet is None else _sheet_of(F.col(FILE)) == F.lit(sheet)
    records, files = read_records(spark, path, keep, multiline)
    heads = files.groupBy("head").agg(F.min("file").alias("file")).orderBy("head").collect()
    if not heads:
        raise ValueError(f"no sheets below {path}")
    layouts = [_header_names(r["head"], r["file"]) for r in heads]
    columns = list(dict.fromkeys(n for names in layouts for n in names))
    # written parts by their number ("part-100000" comes after "part-99999"), other files by name
    part = F.regexp_extract("file", r"/part-(\d+)[^/]*\z", 1).try_cast("bigint")
    w = Window.partitionBy("sheet_id").orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    layout = F.array_position(F.array(*[F.lit(r["head"]) for r in heads]), F.col("head")).alias("__lm_layout")
    # one row a file
    files = files.select("file", layout, "records",
                         (F.lit(None).cast("string") if one_sheet else _sheet_of(F.col("file"))).alias("sheet_id"))
    files = materialize(files.select("file", "__lm_layout", "sheet_id", F.coalesce(F.sum(F.col("records") - 1).over(w), F.lit(0)).alias("__lm_off")), "csv-sheets")
    cells = ", ".join(f"c{i} string" for i in range(max(map(len, layouts))))
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "true"}
    rows = records.where("rec > 1").join(files, "file").select(
        "sheet_id", (F.col("__lm_off") + F.col("rec") - 1).alias("row_pos"), "__lm_layout", F.from_csv("text", cells, options).alias("__lm_cells"))

    def cell(name: str) -> Column:
        places: dict[int, list[int]] = {}
        for k, names in enumerate(layouts, 1):
            if name in names:
                places.setdefault(names.index(name), []).append(k)
        found = [F.when(F.col("__lm_layout").isin(ks), F.col(f"__lm_cells.c{i}")) for i, ks in places.items()]
        return F.coalesce(*found).alias(name)

    return rows.select("sheet_id", "row_pos", *[cell(n) for n in columns])


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet below ``path``, the first when none is named, reading its files only;
    unknown names raise listing all available ones."""
    known = materialize(sheet_catalogue(spark, path).select("sheet_id").distinct(), "sheet-names")
    if sheet is None:
        sheet = known.agg(F.min("sheet_id")).first()[0]
    if known.where(F.col("sheet_id") == F.lit(sheet)).isEmpty():
        names = [str(r[0]) for r in known.orderBy("sheet_id").collect()]
        raise ValueError(NO_SHEET.format(sheet, ", ".join(names)))
    return read_sheet_csv(spark, path, sheet=sheet)


def select_sheet(sheets: DataFrame, sheet=None, check: bool = True) -> DataFrame:
    """One sheet of a table of sheets, the first when none is named; unknown names raise
    listing all available ones."""
    if sheet is None:
        sheet = sheets.agg(F.min("sheet_id")).first()[0]
    out = sheets.where(F.col("sheet_id") == F.lit(sheet))
    if check and out.isEmpty():
        names = [str(r[0]) for r in sheets.select("sheet_id").distinct().orderBy("sheet_id").collect()]
        raise ValueError(NO_SHEET.format(sheet, ", ".join(names)))
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_sheets_csv(sheets: DataFrame, path: str) -> None:
    """Write a table of sheets as CSV, one ``sheet_id=...`` folder per sheet, rows in order."""
    ordered = sheets.repartitionByRange("sheet_id", "row_pos").sortWithinPartitions("sheet_id", "row_pos")
    (with_header_names(ordered.drop("row_pos")).write.mode("overwrite").partitionBy("sheet_id")
     .option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_master(master: DataFrame, path: str, sheet_name: str | None = None,
                 fmt: str = "parquet") -> str:
    """Write the updated master into ``<path>/<sheet name>`` (default sheet name as in
    the reference), rows in master order.  Returns the folder written.  CSV files carry the
    sheet's own headers; other formats keep the canonical columns.  Beside the data goes a
    layout record (``<path>/_layout/<sheet name>``: format, and each column's place, name,
    header and type), by which ``read_master`` gives the table back as it was."""
    name = sheet_name or DEFAULT_MASTER_SHEET
    target = f"{path.rstrip('/')}/{name}"
    ordered = "row_pos" in master.columns
    rows = master.repartitionByRange("row_pos").sortWithinPartitions("row_pos") if ordered else master
    if fmt == "csv":
        out = with_header_names(rows.drop("row_pos"))
        out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(target)
    else:
        rows.write.mode("overwrite").format(fmt).save(target)
    layout = [(fmt, i, f.name, COLUMN_TO_HEADER.get(f.name, f.name), f.dataType.simpleString())
              for i, f in enumerate(master.schema.fields)]
    spark = master.sparkSession
    spark.createDataFrame(layout, LAYOUT).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/_layout/{name}")
    return target


LAYOUT = "format string, place int, name string, header string, type string"


def read_master(spark: SparkSession, path: str, sheet_name: str | None = None) -> DataFrame:
    """A master written by ``write_master``: its columns in their order, under canonical
    names and with their types, extra columns included.  From CSV, ``row_pos`` numbers the
    rows in the order written, and an empty text is null."""
    name = sheet_name or DEFAULT_MASTER_SHEET
    target = f"{path.rstrip('/')}/{name}"
    layout = sorted(spark.read.schema(LAYOUT).json(f"{path.rstrip('/')}/_layout/{name}").collect(), key=lambda r: r["place"])
    if layout[0]["format"] != "csv":
        return spark.read.format(layout[0]["format"]).load(target).select(*[F.col(f"`{r['name']}`") for r in layout])
    rows = read_sheet_csv(spark, target, one_sheet=True)
    kept = {n.lower() for n in rows.columns}
    cols = [F.col(f"`{r['name']}`").try_cast(r["type"]).alias(r["name"]) if r["name"].lower() in kept
            else F.lit(None).cast(r["type"]).alias(r["name"]) for r in layout]
    return rows.select(*cols)


def render_csv_lines(df: DataFrame, order_cols=("row_pos",), key_cols=()) -> DataFrame:
    """The reference's CSV text, one line per row (``line``), plus the header text."""
    cols = [c for c in df.columns if c not in set(order_cols) | set(key_cols)]
    return df.select(*key_cols, *order_cols, csv_line(*cols).alias("line"),
                     F.lit(csv_header([COLUMN_TO_HEADER.get(c, c) for c in cols])).alias("header"))
