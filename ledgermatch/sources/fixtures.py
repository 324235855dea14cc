"""Derived input tables built from the driver's parquet tables.

The SQL text below is shared: Spark runs it over temp views of the parquet tables,
and the DuckDB oracle inlines it as CTEs.  Every derived table grows with the base
tables (one master row per supplier, one sheet row per lineitem, ...).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ledgermatch.session import materialize

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

# Supplier master: one row per supplier, messy invoice_total text.
UNIVERSAL_SQL = """
select s_suppkey as row_pos,
  p_name || ' ' || n_name || ' ' || case s_suppkey % 5 when 0 then 'Foods' when 1 then 'Inc.'
    when 2 then 'LLC' when 3 then 'Company' else 'Ltd' end as supplier,
  case s_suppkey % 3 when 0 then 'ACH' when 1 then 'Check' else 'Card' end as default_payment_method,
  case s_suppkey % 4 when 0 then null when 1 then '$' || cast(s_suppkey * 100 as varchar(20)) || '.50'
    when 2 then '(' || cast(s_suppkey as varchar(20)) || ')' else 'N/A' end as invoice_total
from supplier join part on p_partkey = s_suppkey join nation on n_nationkey = s_nationkey
"""

# Vendor spellings: same / upper+hyphens / typo / reordered / suffix dropped / unrelated.
VENDOR_NAMES_SQL = """
select s_suppkey as k, case s_suppkey % 6 when 0 then supplier
  when 1 then upper(replace(supplier, ' ', '-'))
  when 2 then substr(supplier, 1, 3) || substr(supplier, 5)
  when 3 then n_name || ' ' || p_name
  when 4 then p_name || ' of ' || n_name
  else 'Vendor ' || cast(s_suppkey as varchar(20)) end as vendor
from supplier join part on p_partkey = s_suppkey join nation on n_nationkey = s_nationkey
  join universal on row_pos = s_suppkey
"""

# Invoice sheets: detail rows, a subtotal row (absent when k%7=0), a separator '0' row
# (k%11=0), a second block with a negative subtotal (k%13=0).
VENDOR_SHEET_SQL = """
with li as (select l_suppkey as k, l_orderkey % 16 as sheet_id, cast(l_extendedprice as decimal(12,2)) as p,
   row_number() over (partition by l_suppkey, l_orderkey % 16
     order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) as rn from lineitem),
 tot as (select li.k, sheet_id, vendor, floor(li.k / 1024) as part, cast(sum(p) as varchar(30)) as t, count(*) as n,
     count(*) + case when li.k % 7 <> 0 then 1 else 0 end + case when li.k % 11 = 0 then 1 else 0 end as first_rows,
     case when li.k % 13 = 0 then 2 else 0 end as second_rows
   from li join vendor_names v on v.k = li.k group by li.k, sheet_id, vendor),
 parts as (select sheet_id, part, sum(first_rows) as f, sum(second_rows) as s from tot group by sheet_id, part),
 begun as (select sheet_id, part, sum(f) over (partition by sheet_id order by part) - f as f,
     sum(f) over (partition by sheet_id) + sum(s) over (partition by sheet_id order by part) - s as s from parts),
 placed as (select tot.*, f + sum(first_rows) over (partition by tot.sheet_id, tot.part order by k) - first_rows as first_at,
     s + sum(second_rows) over (partition by tot.sheet_id, tot.part order by k) - second_rows as second_at
   from tot join begun on begun.sheet_id = tot.sheet_id and begun.part = tot.part),
 r as (select li.sheet_id, first_at + rn as pos, vendor, cast(p as varchar(30)) as amt
     from li join placed on placed.k = li.k and placed.sheet_id = li.sheet_id
  union all select sheet_id, first_at + n + 1, null, case when length(t) > 6
     then '$' || substr(t, 1, length(t) - 6) || ',' || substr(t, length(t) - 5) else t end from placed where k % 7 <> 0
  union all select sheet_id, first_at + first_rows, null, '0' from placed where k % 11 = 0
  union all select sheet_id, second_at + 1, vendor, '5.00' from placed where k % 13 = 0
  union all select sheet_id, second_at + 2, null, '(5.00)' from placed where k % 13 = 0)
select sheet_id, cast(pos as bigint) as row_pos, vendor, amt as invoice_amount from r
"""

# The same rows by Spark in steps: sums by vendor and sheet and their places are stored, so that
# ``lineitem`` is shuffled once, for the row numbers (in one query it is, for each use of ``tot``).
SHEET_SUMS_SQL = """
select l_suppkey as k, l_orderkey % 16 as sheet_id, sum(cast(l_extendedprice as decimal(12,2))) as p, count(*) as n
from lineitem group by l_suppkey, l_orderkey % 16
"""
SHEET_LINES_SQL = """
select k, sheet_id, p, row_number() over (partition by k, sheet_id
    order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) as rn
from (select l_suppkey as k, l_orderkey % 16 as sheet_id, cast(l_extendedprice as decimal(12,2)) as p, l_orderkey, l_linenumber,
  l_partkey, l_quantity, l_extendedprice, l_shipdate from lineitem)
"""


def _staged_sheet(spark: SparkSession) -> DataFrame:
    """``VENDOR_SHEET_SQL`` over the registered tables, its CTEs computed one after another."""
    materialize(spark.sql(SHEET_SUMS_SQL), "sheet-sums").createOrReplaceTempView("sheet_sums")
    text = VENDOR_SHEET_SQL.strip()
    at = [text.index(f"\n {name} as (") for name in ("tot", "parts", "r")]
    tot, places, rows = text[at[0]:at[1]], text[at[1]:at[2]], text[at[2]:]
    tot = tot.replace("count(*)", "sum(li.n)").replace("from li ", "from sheet_sums li ")
    placed = f"with {tot.strip()} {places.strip().rstrip(',')}\nselect * from placed"
    materialize(spark.sql(placed), "sheet-places").createOrReplaceTempView("sheet_places")
    return spark.sql(f"with li as ({SHEET_LINES_SQL}), placed as (select * from sheet_places),{rows}")


# Externally produced match decisions: supplier null (0) / wrong case (1) / no match_type (2)
# / fenced (3) / no vendor (4); amounts as text (k%10=5) or unreadable (k%10=6), score as
# text (k%10=7), further elements that are no objects (k%17=0), text behind the array (k%23=0),
# an object instead of an array (k%29=0).
MATCH_RESPONSES_SQL = """
select k as request_id, case when k % 29 = 0 then '{"vendor":"x"}' else case when k % 9 = 3 then '```json' || chr(10) else '' end
 || '[{' || case when k % 9 = 4 then '' else '"vendor":"' || vendor || '",' end
 || '"supplier":' || case when k % 9 = 0 then 'null' when k % 9 = 1 then '"' || lower(supplier) || '"'
      else '"' || supplier || '"' end
 || case when k % 9 = 2 then '' else ',"match_type":"fuzzy"' end
 || ',"score":' || case when k % 10 = 7 then '"' || cast(70 + k % 30 as varchar(10)) || '"' else cast(70 + k % 30 as varchar(10)) end
 || ',"amount":' || case when k % 10 = 5 then '"' || cast(k as varchar(20)) || '.25"' when k % 10 = 6 then '"abc"'
      when k % 10 = 8 then 'null' else cast(k as varchar(20)) || '.25' end || '}'
 || case when k % 17 = 0 then ',"x",7' else '' end || ']' || case when k % 23 = 0 then ' thanks' else '' end
 || case when k % 9 = 3 then chr(10) || '```' else '' end end as response
from vendor_names join universal on row_pos = k
"""

# Externally produced moderation verdicts, one per labelled document: fenced (id%5=0),
# severity missing (id%3=0), unparseable (id%11=0); blank lines around (id%7=0), text behind
# (id%13=0), flag as text (id%17=0) or number (id%19=0), no object (id%23=0), a second verdict
# (id%10=0); unlabelled documents have none.
MODERATION_RESPONSES_SQL = """
select doc_id as text_id, '{"isOffensive": true, "reason": "second"}' as response from labels where doc_id % 10 = 0
union all select doc_id as text_id, case when doc_id % 23 = 0 then '[1]' when doc_id % 11 = 0 then 'model unavailable' else
  case when doc_id % 5 = 0 then 'Verdict:' || chr(10) || '```json' || chr(10) else '' end
  || case when doc_id % 7 = 0 then chr(10) || ' ' else '' end
  || '{"isOffensive": ' || case when doc_id % 17 = 0 then '"true"' when doc_id % 19 = 0 then cast(toxic as varchar(10))
       when toxic = 1 then 'true' else 'false' end
  || case when doc_id % 3 = 0 then '' else ', "severity": "'
       || case when quality = 0 then 'high' else 'low' end || '"' end
  || ', "reason": "quality ' || cast(quality as varchar(10)) || '"'
  || ', "flaggedWords": ' || case when toxic = 1 then '["w' || cast(doc_id % 7 as varchar(10)) || '"]'
       else '[]' end || '}' || case when doc_id % 7 = 0 then chr(10) when doc_id % 13 = 0 then ' hope this helps' else '' end
  || case when doc_id % 5 = 0 then chr(10) || '```' else '' end end as response
from labels
"""

# Texts to screen: every document, and blank or missing texts beside them.
SCREEN_TEXTS_SQL = """
select doc_id as text_id, text from documents
union all select -1 - doc_id as text_id, case when doc_id % 20 = 0 then chr(9) || ' ' || chr(10) end as text
from labels where doc_id % 10 = 0
"""

# The sheets with line feeds, quotes and commas in cells.
QUOTED_SHEET_SQL = """
select sheet_id, row_pos, case when row_pos % 3 = 0 then vendor || chr(10) || '"a", ' || chr(10) || 'b' when row_pos % 5 = 0
    then chr(10) || vendor else vendor end as vendor, invoice_amount from vendor_sheet
"""

# Keywords of a caller's table: pieces of the benchmark passages, and words that no text has.
KEYWORD_TABLE_SQL = """
select item_id * 4 as place, lower(substr(text, 3, 11)) as keyword from benchmark where length(text) > 20
union all select item_id * 4 + 1, lower(substr(text, 17, 5 + item_id % 7)) from benchmark where length(text) > 40
union all select item_id * 4 + 2, lower(substr(text, 41, 24)) from benchmark where length(text) > 80
union all select item_id * 4 + 3, 'xq' || cast(item_id as varchar(20)) from benchmark
"""

# The master with a column of its own, whose cells and header need quotes.
NOTED_MASTER_SQL = """
select row_pos, supplier, invoice_total, case when row_pos % 3 = 0 then 'say "' || supplier || '",' || chr(10) || 'twice'
  when row_pos % 3 = 1 then default_payment_method end as notes, default_payment_method from universal
"""

FIXTURES = {
    "universal": UNIVERSAL_SQL,
    "vendor_names": VENDOR_NAMES_SQL,
    "vendor_sheet": VENDOR_SHEET_SQL,
    "quoted_sheet": QUOTED_SHEET_SQL,
    "keyword_table": KEYWORD_TABLE_SQL,
    "noted_master": NOTED_MASTER_SQL,
    "match_responses": MATCH_RESPONSES_SQL,
    "moderation_responses": MODERATION_RESPONSES_SQL,
    "screen_texts": SCREEN_TEXTS_SQL,
}

# dependency order for CTE inlining
_ORDER = ["universal", "vendor_names", "vendor_sheet", "quoted_sheet", "keyword_table", "noted_master", "match_responses", "moderation_responses", "screen_texts"]
_DEPS = {
    "universal": [],
    "vendor_names": ["universal"],
    "vendor_sheet": ["vendor_names", "universal"],
    "quoted_sheet": ["vendor_sheet"],
    "keyword_table": [],
    "noted_master": ["universal"],
    "match_responses": ["vendor_names", "universal"],
    "moderation_responses": [],
    "screen_texts": [],
}


def _closure(names):
    need = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n not in need:
            need.add(n)
            stack.extend(_DEPS[n])
    return [n for n in _ORDER if n in need]


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with CTEs for the named fixture tables (and their dependencies)."""
    ctes = ",\n".join(f"{n} as ({FIXTURES[n].strip()})" for n in _closure(names))
    body = body.strip()
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def register_base_tables(spark: SparkSession, sf_dir: str) -> None:
    for t in BASE_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        spark.read.parquet(path).createOrReplaceTempView(t)


_STORED: dict = {}


def _derived(spark: SparkSession, name: str) -> DataFrame:
    return _staged_sheet(spark) if name == "vendor_sheet" else spark.sql(FIXTURES[name])


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table computed from the base tables (lazy plan)."""
    register_base_tables(spark, sf_dir)
    for dep in _closure([name]):
        if dep == name:
            break
        _derived(spark, dep).createOrReplaceTempView(dep)
    return _derived(spark, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base parquet table, or a derived table.  A derived table is computed once per
    application and stored as parquet under the checkpoint directory; later queries
    read the stored copy."""
    if name in BASE_TABLES:
        return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        app = spark.conf.get("spark.app.id", "connect")
    key = (app, os.path.abspath(sf_dir), name)
    if key not in _STORED:
        _STORED[key] = materialize(derive(spark, sf_dir, name), f"input-{name}")
    return _STORED[key]
