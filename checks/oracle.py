"""DuckDB oracle SQL, one statement per registered query key.  Fixture tables are
inlined as CTEs so each statement runs on the driver's base views alone."""

from __future__ import annotations

from checks.sqltext import (BLANK, DEC, COMMON, CONTAINS_AS_WORD, EXACT, FUZZY, HAS, JT, KEYS, MARKED,
                            MW, NORM, PA, QW, RATIO, REPORT, SHARES3, SIM, SUPPLIERS, TOTALS, TSORT,
                            UPDATED)
from ledgermatch.sources.fixtures import with_fixtures

_SHEET = ("universal", "vendor_names", "vendor_sheet")


def _w(body: str, *fixtures: str) -> str:
    return with_fixtures(body, *(fixtures or _SHEET))


def _cte(*parts: str) -> str:
    return ",\n".join(p.strip() for p in parts)


NAME_PAIRS = f"""
pairs as (select v.k, {NORM('v.vendor')} as vendor_norm, {NORM('u.supplier')} as supplier_norm
      from vendor_names v join universal u on v.k = u.row_pos)"""

RECONCILE_DEFAULT = _cte(MARKED(), SUPPLIERS, KEYS, EXACT, FUZZY(None),
                         REPORT("select * from exact union all select * from fuzzy"), TOTALS)

SQL = {
    "normalize_names": _w(f"""
select sheet_id, row_pos, vendor, {NORM('vendor')} as vendor_norm from vendor_sheet
where vendor is not null"""),

    "parse_invoice_amounts": _w(f"""
select sheet_id, row_pos, vendor, {PA('invoice_amount')} as amount from vendor_sheet"""),

    "qualifying_words": _w(f"""
select row_pos, supplier_norm, array_to_string({QW('supplier_norm')}, ' ') as words_text,
  len({QW('supplier_norm')}) as n_words
from (select row_pos, {NORM('supplier')} as supplier_norm from universal)""", "universal"),

    "common_words": _w(f"""
with {NAME_PAIRS.strip()}
select k, array_to_string({COMMON(MW('vendor_norm'), MW('supplier_norm'))}, ' ') as common_text,
  len({COMMON(MW('vendor_norm'), MW('supplier_norm'))}) as n_common from pairs""",
                       "universal", "vendor_names"),

    "contains_as_word": _w(f"""
with {NAME_PAIRS.strip()}
select k,
  {CONTAINS_AS_WORD('supplier_norm', "array_to_string(" + QW('vendor_norm') + ", ' ')")} as vendor_in_supplier,
  {CONTAINS_AS_WORD('vendor_norm', "array_to_string(" + QW('supplier_norm') + ", ' ')")} as supplier_in_vendor
from pairs""", "universal", "vendor_names"),

    "similarity_scores": _w(f"""
with {NAME_PAIRS.strip()}
select k, {RATIO('vendor_norm', 'supplier_norm')} as edit_ratio,
  {RATIO(TSORT('vendor_norm'), TSORT('supplier_norm'))} as token_sort_ratio,
  {SIM('vendor_norm', 'supplier_norm')} as score,
  {SHARES3('vendor_norm', 'supplier_norm')} as shares_run from pairs""", "universal", "vendor_names"),

    "nonblank_vendors": _w(f"""
with {MARKED().strip()}
select sheet_id, row_pos, filled as vendor, amount from marked where not {BLANK('filled')}"""),

    "forward_fill_vendor": _w(f"""
with {MARKED().strip()}
select sheet_id, row_pos, filled as vendor, amount, is_total from marked"""),

    "subtotal_rows": _w(f"""
with {MARKED().strip()}
select sheet_id, row_pos, {JT('cur')} as block_vendor, invoice_amount, amount from marked where is_total"""),

    "distinct_vendors": _w(f"""
with {MARKED().strip()}
select sheet_id, vendor_norm, vendor, first_pos, last_pos from blocks"""),

    "vendor_subtotals": _w(f"""
with {MARKED().strip()}
select sheet_id, vendor_norm, vendor, amount from blocks"""),

    "section_totals": _w(f"""
with {MARKED().strip()}
select sheet_id, vendor_norm, detail_total, amount as stated_subtotal,
  cast({DEC('detail_total')} - {DEC('amount')} as double) as difference,
  {DEC('detail_total')} = {DEC('amount')} as is_consistent
from blocks"""),

    "supplier_index": _w(f"""
with {SUPPLIERS.strip()}
select supplier_norm, supplier_pos, supplier, n_rows from sup""", "universal"),

    "match_exact": _w(f"""
with {_cte(MARKED(), SUPPLIERS, KEYS, EXACT)}
select * from exact"""),

    "residual_vendors": _w(f"""
with {_cte(MARKED(), SUPPLIERS, KEYS, EXACT)}
select vendor_norm from resid"""),

    "match_fuzzy_best": _w(f"""
with {_cte(MARKED(), SUPPLIERS, KEYS, EXACT, FUZZY(None))}
select * from fuzzy"""),

    "match_edit_ratio_best": _w(f"""
with {_cte(MARKED(), SUPPLIERS, KEYS, EXACT, FUZZY(None, score=RATIO))}
select * from fuzzy"""),

    "matched_at_threshold": _w(f"""
with {_cte(MARKED(), SUPPLIERS, KEYS, EXACT, FUZZY(85),
           REPORT("select * from exact union all select * from fuzzy"))}
select * from report"""),

    "match_report": _w(f"""
with {RECONCILE_DEFAULT}
select * from report"""),

    "supplier_totals": _w(f"""
with {RECONCILE_DEFAULT}
select supplier_pos, added, n_matches from totals"""),

    "update_master": _w(f"""
with {_cte(MARKED(), SUPPLIERS, KEYS, EXACT, REPORT("select * from exact"), TOTALS)}
{UPDATED()}"""),

    "reconcile_master": _w(f"""
with {RECONCILE_DEFAULT}
{UPDATED()}"""),
}

_ = (HAS,)  # fragments kept importable for ad-hoc checks


# ---------------------------------------------------------------- later operator families
from checks import sqltext as _T  # noqa: E402
from checks.sqltext import ANY_FENCE, CSVLINE, LEAD_FENCE, NUMTEXT, SUBSTRING_MATCH  # noqa: E402
from ledgermatch.functions.screening import FALLBACK_KEYWORDS  # noqa: E402

_RES = _cte(MARKED(), SUPPLIERS, KEYS, EXACT)
_KW = "[" + ", ".join(f"'{k}'" for k in FALLBACK_KEYWORDS) + "]"
_WARN = f"'{_T.WARNING}{_T.REMOVED}'"

_PARSED = f"""
rt as (select request_id, {LEAD_FENCE('response')} as json_text from match_responses),
ok as (select request_id, cast(json_text as json) as arr from rt
       where case when json_valid(json_text) then json_type(json_text) = 'ARRAY' else false end),
el as (select request_id, unnest(range(json_array_length(arr)::bigint)) as idx, unnest(cast(arr as json[])) as d from ok),
fields as (select request_id, cast(idx as integer) as idx, json_type(d) as kind, d ->> '$.vendor' as vendor, d ->> '$.supplier' as supplier,
    coalesce(nullif(d ->> '$.match_type', ''), 'fuzzy') as match_type,
    case when coalesce(d ->> '$.score', '') = '' then 0.0::double else try_cast(d ->> '$.score' as double) end as score,
    case when coalesce(d ->> '$.amount', '') = '' then 0.0::double else try_cast(d ->> '$.amount' as double) end as amount from el),
judged as (select *, case when kind <> 'OBJECT' then 'element is not a JSON object'
    when score is null or amount is null or not isfinite(score) or not isfinite(amount) then 'score or amount is not a number' end as reason from fields),
parsed as (select request_id, idx, vendor, supplier, match_type, score, amount from judged where reason is null)"""

_DEC_REPORT = _PARSED + """,
names as (select supplier, min(row_pos) as supplier_pos from universal where supplier is not null
          group by supplier),
dj as (select p.*, n.supplier_pos,
         (p.match_type = 'no_match' or p.supplier is null or p.supplier = '' or n.supplier_pos is null) as nomatch
       from parsed p left join names n on p.supplier = n.supplier
       where p.vendor is not null and p.vendor <> ''),
report as (select request_id, idx, vendor, case when nomatch then null else supplier end as supplier,
    case when nomatch then 'no_match' else match_type end as match_type,
    case when nomatch then 0.0 else score end as score, amount as amount_added,
    case when nomatch then null else supplier_pos end as supplier_pos from dj)"""


def _screen(text: str, fallback_only: bool, keywords: str = _KW) -> str:
    """Verdict columns for texts; ``pv`` (parsed verdict) columns are used when present."""
    hit = f"len(list_filter({keywords}, lambda k: contains(lower({text}), k)))"
    flagged = f"array_to_string(list_filter({keywords}, lambda k: contains(lower({text}), k)), ', ')"
    if fallback_only:
        use_parsed = "false"
    else:
        use_parsed = "coalesce(pv_ok, false)"
    sev = "coalesce(nullif(pv_sev, ''), 'medium')"
    pmsg = (f"'{_T.WARNING}' || case when {sev} = 'high' then '{_T.SERIOUS}' else '' end "
            f"|| '{_T.REMOVED}'")
    pflag = "array_to_string(coalesce(pv_words, []::varchar[]), ', ')"
    off = f"coalesce(pv_off, false)"
    return f"""
  case when {BLANK(text)} then false when {use_parsed} then {off} else {hit} > 0 end as is_offensive,
  case when {BLANK(text)} then '{_T.VALID}'
       when {use_parsed} then case when {off} then {pmsg} else '{_T.APPROPRIATE}' end
       when {hit} > 0 then {_WARN} else '{_T.COMPLETED}' end as message,
  case when {BLANK(text)} then '{_T.INVALID}'
       when {use_parsed} then case when {off} then coalesce(nullif(pv_reason, ''), '{_T.OFFENSIVE}')
                                   else coalesce(nullif(pv_reason, ''), '{_T.NONE_FOUND}') end
       when {hit} > 0 then '{_T.FOUND}' else '{_T.NOT_OBVIOUS}' end as details,
  case when {BLANK(text)} then null when {use_parsed} then case when {off} then {sev} else 'none' end
       when {hit} > 0 then 'medium' else 'none' end as severity,
  case when {BLANK(text)} then '' when {use_parsed} then case when {off} then {pflag} else '' end
       when {hit} > 0 then {flagged} else '' end as flagged_text"""


def _with_warning(inner: str, keys: str) -> str:
    return f"""
select {keys}, is_offensive, message, details, severity, flagged_text,
  case when is_offensive and flagged_text <> '' then message || chr(10) || 'Flagged words: ' || flagged_text
       else message end as warning
from ({inner})"""


_NO_VERDICT = ("false as pv_ok, cast(null as boolean) as pv_off, cast(null as varchar) as pv_sev, "
               "cast(null as varchar) as pv_reason, cast(null as varchar[]) as pv_words")

_VERDICTS = f"""
vr as (select text_id, response, {ANY_FENCE('response')} as t from moderation_responses),
vk as (select text_id, response, t, coalesce(case when json_valid(t) then json_type(t) end, 'NULL') as kind from vr),
vo as (select *, case when kind = 'OBJECT' then case json_type(t, '$.isOffensive') when 'BOOLEAN' then json_extract_string(t, '$.isOffensive') = 'true'
      when 'VARCHAR' then json_extract_string(t, '$.isOffensive') <> '' when 'OBJECT' then true when 'ARRAY' then true
      when 'NULL' then false else coalesce(json_extract_string(t, '$.isOffensive')::double <> 0, false) end else false end as off from vk),
pv as (select text_id, true as pv_ok, off as pv_off,
    case when kind = 'OBJECT' then json_extract_string(t, '$.severity') end as pv_sev,
    case when kind = 'OBJECT' then json_extract_string(t, '$.reason') end as pv_reason,
    case when kind = 'OBJECT' then from_json(json_extract(t, '$.flaggedWords'), '["VARCHAR"]') end as pv_words
  from (select *, row_number() over (partition by text_id order by off desc, response) as n from vo where kind <> 'NULL') where n = 1)"""

_GIVEN = "['data', 'river', 'xyzzy', 'the']"

_BATCH = 50
_REQUESTS = f"""
with {MARKED().strip()},
num as (select sheet_id, first_pos, vendor, amount,
          row_number() over (partition by sheet_id order by first_pos) as n from blocks),
lines as (select sheet_id, (n - 1) // {_BATCH} as batch_no, n,
            format('{{}}. "{{}}" (Amount: {{}})', n, vendor, {NUMTEXT('amount')}) as line from num),
batches as (select sheet_id, batch_no, count(*) as n_vendors, min(n) as first_n,
              string_agg(line, chr(10) order by n) as vendor_lines from lines group by sheet_id, batch_no),
vt as (select sheet_id, count(*) as n_unique_vendors from blocks group by sheet_id),
names as (select supplier, min(row_pos) as supplier_pos from universal group by supplier),
nsup as (select count(*) as c from names),
sl as (select string_agg(format('{{}}. "{{}}"', rn, coalesce(supplier, 'null')), chr(10) order by rn) as t
       from (select supplier, row_number() over (order by supplier_pos) as rn from names) where rn <= 100),
mfull as (select 'Supplier,Default payment method,Invoice Total' || chr(10)
            || string_agg({CSVLINE('supplier', 'default_payment_method', 'invoice_total')}, chr(10) order by row_pos)
            as t from universal),
mcsv as (select case when length(t) > 5000 then substring(t, 1, 5000) || chr(10) || '... (truncated for display)'
            else t end as t from mfull),
sfull as (select sheet_id, 'Vendor,Invoice Amount' || chr(10)
            || string_agg({CSVLINE('vendor', 'invoice_amount')}, chr(10) order by row_pos) as t
          from vendor_sheet group by sheet_id),
scsv as (select sheet_id, case when length(t) > 5000 then substring(t, 1, 5000) || chr(10)
            || '... (truncated for display)' else t end as sheet_csv from sfull)
select b.sheet_id, b.batch_no, b.first_n, b.n_vendors, vt.n_unique_vendors, b.vendor_lines,
  nsup.c as n_suppliers, sl.t as supplier_lines,
  case when nsup.c > 100 then '... and ' || cast(nsup.c - 100 as varchar) || ' more suppliers' else '' end
    as supplier_overflow,
  mcsv.t as master_csv, scsv.sheet_csv
from batches b join vt on b.sheet_id = vt.sheet_id join scsv on b.sheet_id = scsv.sheet_id
  cross join nsup cross join sl cross join mcsv"""

_LEAD = ("Find the supplier of each of the {} vendors below. Take a supplier only if your score for it is at least 85 of 100; "
         "else answer match_type no_match with supplier null. Write supplier names exactly as they are listed. "
         "Answer with a JSON array of objects with the keys vendor, supplier, match_type, score and amount.")
_REQUESTS_WHOLE = f"""
with {MARKED().strip()},
num as (select sheet_id, first_pos, vendor, amount,
          row_number() over (partition by sheet_id order by first_pos) as n from blocks),
lines as (select sheet_id, n, format('{{}}. "{{}}" (Amount: {{}})', n, vendor, {NUMTEXT('amount')}) as line from num),
packed as (select *, (sum(length(line) + 1) over (partition by sheet_id order by n) - length(line) - 1) // 4000 as batch_no from lines),
batches as (select sheet_id, batch_no, count(*) as n_vendors, min(n) as first_n,
              string_agg(line, chr(10) order by n) as text from packed group by sheet_id, batch_no),
vt as (select sheet_id, count(*) as n_unique_vendors from blocks group by sheet_id),
names as (select supplier, min(row_pos) as supplier_pos from universal group by supplier),
context as (
  select 'suppliers' as part, null as scope, row_number() over (order by supplier_pos) as n,
    format('{{}}. "{{}}"', row_number() over (order by supplier_pos), coalesce(supplier, 'null')) as line, '' as header from names
  union all select 'master', null, row_number() over (order by row_pos),
    {CSVLINE('supplier', 'default_payment_method', 'invoice_total')},
    'Supplier,Default payment method,Invoice Total' || chr(10) from universal
  union all select 'sheet', sheet_id, row_number() over (partition by sheet_id order by row_pos),
    {CSVLINE('vendor', 'invoice_amount')}, 'Vendor,Invoice Amount' || chr(10) from vendor_sheet),
chunks as (select part, scope, (n - 1) // 100 as chunk_no,
    case when (n - 1) // 100 = 0 then any_value(header) else '' end || string_agg(line, chr(10) order by n) as text
  from context group by part, scope, (n - 1) // 100)
select 'batch' as kind, b.sheet_id, cast(batch_no as bigint) as batch_no, first_n, n_vendors, n_unique_vendors, (select count(*) from names) as n_suppliers,
  format('{_LEAD}', n_vendors) || chr(10) || text as text, null as part, cast(null as bigint) as chunk_no, null as chunk_id
  from batches b join vt on vt.sheet_id = b.sheet_id
union all select 'context', scope, null, null, null, null, null, null, part, chunk_no, sha256(text) from chunks
union all select distinct 'chunk', null, null, null, null, null, null, text, null, null, sha256(text) from chunks"""

_NOTED = UPDATED().replace("select u.row_pos, u.supplier, u.default_payment_method,", "select u.row_pos, u.supplier, u.notes, u.default_payment_method,").replace(
    "from universal u", "from noted_master u")

SQL.update({
    "flag_keyword_table": _w("""
select doc_id, coalesce(string_agg(keyword, '|' order by place), '') as flagged_text, cast(count(keyword) as integer) as n_flagged
from documents left join keyword_table on contains(lower(text), keyword) group by doc_id""", "keyword_table"),

    "master_round_trip": _w(f"""
with {_cte(MARKED(), SUPPLIERS, KEYS, EXACT, REPORT("select * from exact"), TOTALS)},
updated as ({_NOTED})
select f.format, 'row_pos,supplier,invoice_total,Notes, internal,default_payment_method' as columns,
  case when f.format = 'csv' then row_number() over (partition by f.format order by row_pos) else row_pos end as row_pos,
  supplier, invoice_total, notes, default_payment_method
from updated, (values ('csv'), ('parquet')) f(format)""", *_SHEET, "noted_master"),

    "match_substring_pairs": _w(f"""
with {_RES}
select r.vendor_norm, s.supplier_norm from resid r join sup s
  on {SUBSTRING_MATCH('r.vendor_norm', 's.supplier_norm')}"""),

    "match_substring_best": _w(f"""
with {_RES},
sp as (select r.vendor_norm, s.supplier_norm, s.supplier_pos, s.supplier,
         {SIM('r.vendor_norm', 's.supplier_norm')} as score
       from resid r join sup s on {SUBSTRING_MATCH('r.vendor_norm', 's.supplier_norm')})
select vendor_norm, supplier_norm, supplier_pos, supplier, 'substring' as match_type, score from
  (select *, row_number() over (partition by vendor_norm order by score desc, supplier_pos) as rn from sp)
where rn = 1"""),

    "match_report_three_tier": _w(f"""
with {_RES},
sp as (select r.vendor_norm, s.supplier_norm, s.supplier_pos, s.supplier,
         {SIM('r.vendor_norm', 's.supplier_norm')} as score
       from resid r join sup s on {SUBSTRING_MATCH('r.vendor_norm', 's.supplier_norm')}),
sub as (select vendor_norm, supplier_norm, supplier_pos, supplier, 'substring' as match_type, score from
  (select *, row_number() over (partition by vendor_norm order by score desc, supplier_pos) as rn from sp) where rn = 1),
resid2 as (select vendor_norm from resid where vendor_norm not in (select vendor_norm from sub)),
{_cte(FUZZY(None, "resid2"), REPORT("select * from exact union all select * from sub union all select * from fuzzy"))}
select * from report"""),

    "ranked_report": _w(f"""
with {RECONCILE_DEFAULT}
select row_number() over (order by case when match_type = 'exact' then 0 else 1 end, score desc,
         sheet_id, first_pos) as rank,
  sheet_id, first_pos, vendor_norm, coalesce(vendor, '') as vendor, coalesce(supplier, '') as supplier,
  match_type, score, amount_added from report"""),

    "match_counts": _w(f"""
with {RECONCILE_DEFAULT}
select match_type, count(*) as n_rows, count(distinct vendor_norm) as n_vendors,
  cast(sum({DEC('amount_added')}) as double) as amount from report group by match_type"""),

    "unmatched_vendors": _w(f"""
with {RECONCILE_DEFAULT}
select sheet_id, first_pos, vendor, amount_added as amount from report where match_type = 'no_match'"""),

    "distinct_suppliers": _w("""
select supplier, min(row_pos) as supplier_pos from universal group by supplier""", "universal"),

    "parse_responses": _w(f"""
with {_PARSED.strip()}
select * from parsed""", "match_responses"),

    "quarantine_decisions": _w(f"""
with {_PARSED.strip()}
select request_id, idx, reason from judged where reason is not null
union all select request_id, null, 'response is not a JSON array' from rt where request_id not in (select request_id from ok)""", "match_responses"),

    "ingest_decisions": _w(f"""
with {_DEC_REPORT.strip()}
select * from report""", "match_responses"),

    "apply_decisions": _w(f"""
with {_DEC_REPORT.strip()},
{TOTALS.strip()}
{UPDATED()}""", "match_responses"),

    "match_request_batches": _w(_REQUESTS),
    "match_request_whole": _w(_REQUESTS_WHOLE),

    "flag_keywords": f"""
select doc_id, array_to_string(list_filter({_KW}, lambda k: contains(lower(text), k)), ', ') as flagged_text,
  len(list_filter({_KW}, lambda k: contains(lower(text), k))) as n_flagged from documents""",

    "flag_given_keywords": f"""
select doc_id, array_to_string(list_filter({_GIVEN}, lambda k: contains(lower(text), k)), ', ') as flagged_text,
  len(list_filter({_GIVEN}, lambda k: contains(lower(text), k))) as n_flagged from documents""",

    "screen_given_keywords": _w(_with_warning(f"select text_id, {_screen('text', True, _GIVEN)} from (select *, {_NO_VERDICT} from screen_texts)",
                                              "text_id"), "screen_texts"),

    "screen_text": _with_warning(f"select conv_id, turn, {_screen('text', True)} from (select *, {_NO_VERDICT} from conversations)",
                                 "conv_id, turn"),

    "warning_messages": f"""
select doc_id, warning from ({_with_warning(f"select doc_id, {_screen('text', True)} from (select *, {_NO_VERDICT} from documents)", "doc_id")})""",

    "screen_text_with_responses": _w(f"""
with {_VERDICTS.strip()}
{_with_warning(f"select d.doc_id as text_id, {_screen('d.text', False)} from documents d left join pv on d.doc_id = pv.text_id", "text_id")}""",
                                     "moderation_responses"),

    "scan_vendor_sheet": _w("select sheet_id, row_pos, vendor, invoice_amount from vendor_sheet"),

    "scan_quoted_sheet": _w("select sheet_id, row_pos, vendor, invoice_amount from quoted_sheet", "quoted_sheet"),

    "read_one_sheet": _w("select sheet_id, row_pos, vendor, invoice_amount from quoted_sheet where sheet_id = 3", "quoted_sheet"),

    "select_sheet": _w("select * from vendor_sheet where sheet_id = 3"),

    "csv_render": _w(f"""
select sheet_id, row_pos, {CSVLINE('vendor', 'invoice_amount')} as line, 'Vendor,Invoice Amount' as header
from vendor_sheet"""),

    "sheet_head": _w("""
select sheet_id, row_pos, vendor, invoice_amount, row_idx from
  (select *, row_number() over (partition by sheet_id order by row_pos) as row_idx from vendor_sheet)
where row_idx <= 5"""),
})
