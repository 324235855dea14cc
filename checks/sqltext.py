"""DuckDB SQL fragments for the oracle queries (independent re-statement of the
semantics in plain SQL; used only for checking)."""

from __future__ import annotations

# --- fixed values, stated apart from the engine's so that a mistake there shows ---------
# Code points that a script's trim removes.
SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]))
# Company words that do not count as shared words.
STOP_WORDS = ["foods", "beverages", "inc", "llc", "corp", "company", "co", "ltd", "limited"]
# Texts of the screen.
WARNING = "⚠️ Using offensive language is prohibited. "
SERIOUS = "This is a serious violation. "
REMOVED = "If continued, you will be removed permanently."
VALID, INVALID = "Content is valid", "Empty or invalid input"
FOUND = "Detected potentially offensive content (fallback detection)"
COMPLETED = "Content check completed"
NOT_OBVIOUS = "API error, but no obvious offensive content detected"
APPROPRIATE, NONE_FOUND = "Content is appropriate", "No offensive content detected"
OFFENSIVE = "Contains offensive content"
# -----------------------------------------------------------------------------------------


def JT(x: str) -> str:
    return f"trim({x}, '{SPACES}')"


def BLANK(x: str) -> str:
    return f"(coalesce({JT(x)}, '') = '')"


def NORM(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def DEC(x: str) -> str:
    """Exact DOUBLE -> DECIMAL via the shortest decimal text (as Spark does)."""
    return f"cast(cast({x} as varchar) as decimal(38,10))"


def HAS(x: str) -> str:
    return f"coalesce({x} <> 0, false)"


def PA(x: str) -> str:
    t = JT(x)
    stripped = f"regexp_replace(regexp_replace({t}, '^\\(|\\)\\z', '', 'g'), '[^0-9.\\-]', '', 'g')"
    prefix = f"regexp_extract({stripped}, '^(-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1)"
    value = f"(case when {prefix} <> '' then cast({prefix} as double) end)"
    return (f"(case when {BLANK(x)} then cast(null as double) "
            f"when starts_with({t}, '(') and ends_with({t}, ')') then -{value} else {value} end)")


def WORDS(n: str) -> str:
    return f"(case when {n} = '' then []::varchar[] else string_split({n}, ' ') end)"


def QW(n: str) -> str:
    return f"list_filter({WORDS(n)}, lambda w: length(w) >= 4)"


STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def MW(n: str) -> str:
    return f"list_filter({QW(n)}, lambda w: not list_contains({STOP_LIST}, w))"


def COMMON(a: str, b: str) -> str:
    return f"list_filter({a}, lambda w: list_contains({b}, w))"


def RATIO(a: str, b: str) -> str:
    L = f"greatest(length({a}), length({b}))"
    return (f"(case when {L} = 0 then 100 else "
            f"cast((200 * ({L} - levenshtein({a}, {b})) + {L}) // (2 * {L}) as integer) end)")


def TSORT(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def SIM(a: str, b: str) -> str:
    return f"greatest({RATIO(a, b)}, {RATIO(TSORT(a), TSORT(b))})"


def SHARES3(a: str, b: str) -> str:
    return (f"(length({a}) >= 3 and len(list_filter(range(1, length({a}) - 1), "
            f"lambda i: contains({b}, substring({a}, i, 3)))) > 0)")


def CONTAINS_AS_WORD(t: str, s: str) -> str:
    pat = f"'(^| )' || array_to_string({WORDS(s)}, '( | .* )') || '( |$)'"
    return (f"coalesce({t} is not null and {s} is not null and {t} <> '' and {s} <> '' "
            f"and length({s}) >= 4 and len(list_filter({WORDS(s)}, lambda w: length(w) < 4)) = 0 "
            f"and regexp_matches({t}, {pat}), false)")


def SUBSTRING_MATCH(v: str, s: str) -> str:
    vq, sq = QW(v), QW(s)
    mv, ms = MW(v), MW(s)
    return (
        f"coalesce(length({v}) >= 4 and length({s}) >= 4 and len({vq}) > 0 and len({sq}) > 0 and ("
        f"(length({v}) > length({s}) and {CONTAINS_AS_WORD(v, 'array_to_string(' + sq + ', chr(32))')})"
        f" or (length({s}) > length({v}) and {CONTAINS_AS_WORD(s, 'array_to_string(' + vq + ', chr(32))')})"
        f" or (len({COMMON(mv, ms)}) >= 2 and len({mv}) >= 2 and len({ms}) >= 2)"
        f" or (least(length({v}), length({s})) >= 8 and (substring({v}, 1, 8) = substring({s}, 1, 8)"
        f" or right({v}, 8) = right({s}, 8)))), false)")


# Sheet scan as plain whole-sheet windows.
def MARKED(sheet: str = "vendor_sheet") -> str:
    return f"""
p as (select sheet_id, row_pos, vendor, invoice_amount, {PA('invoice_amount')} as amount,
        {BLANK('vendor')} as blank from {sheet}),
c as (select *, last_value(case when not blank then vendor end ignore nulls) over
          (partition by sheet_id order by row_pos rows between unbounded preceding and current row) as cur,
        lead(blank) over (partition by sheet_id order by row_pos) as nblank,
        lead(amount) over (partition by sheet_id order by row_pos) as namount from p),
m as (select *, blank and cur is not null and {HAS('amount')} as is_total,
        case when not blank then vendor when cur is not null and not {HAS('amount')} then cur
             else vendor end as filled from c),
marked as (select *, (not {BLANK('filled')} and not is_total) as named,
        case when coalesce(nblank, false) and {HAS('namount')} then namount else 0.0 end as sub_after
      from m),
blocks as (select sheet_id, {NORM('filled')} as vendor_norm, min(row_pos) as first_pos,
        max(row_pos) as last_pos, arg_max({JT('filled')}, row_pos) as vendor,
        arg_max(sub_after, row_pos) as amount,
        cast(sum({DEC('coalesce(amount, 0.0)')}) as double) as detail_total
      from marked where named group by sheet_id, {NORM('filled')})"""


SUPPLIERS = f"""
sup as (select supplier_norm, min(row_pos) as supplier_pos, arg_min(supplier, row_pos) as supplier,
        count(*) as n_rows
      from (select row_pos, supplier, {NORM('supplier')} as supplier_norm from universal
            where not {BLANK('supplier')}) where supplier_norm <> '' group by supplier_norm)"""

KEYS = "keys as (select distinct vendor_norm from blocks where vendor_norm <> '')"

EXACT = """
exact as (select k.vendor_norm, s.supplier_norm, s.supplier_pos, s.supplier, 'exact' as match_type,
        100 as score from keys k join sup s on k.vendor_norm = s.supplier_norm),
resid as (select vendor_norm from keys where vendor_norm not in (select vendor_norm from exact))"""


def FUZZY(min_score: int | None, source: str = "resid", name: str = "fuzzy", score=SIM) -> str:
    cond = f"and {score('r.vendor_norm', 's.supplier_norm')} >= {min_score}" if min_score is not None else ""
    return f"""
{name}_pairs as (select r.vendor_norm, s.supplier_norm, s.supplier_pos, s.supplier,
        {score('r.vendor_norm', 's.supplier_norm')} as score
      from {source} r join sup s on {SHARES3('r.vendor_norm', 's.supplier_norm')} {cond}),
{name} as (select vendor_norm, supplier_norm, supplier_pos, supplier, 'fuzzy' as match_type, score from
      (select *, row_number() over (partition by vendor_norm order by score desc, supplier_pos) as rn
       from {name}_pairs) where rn = 1)"""


def REPORT(decisions: str) -> str:
    return f"""
decisions as ({decisions}),
report as (select b.sheet_id, b.vendor_norm, b.first_pos, b.vendor,
        case when d.match_type is not null then d.supplier end as supplier,
        coalesce(d.match_type, 'no_match') as match_type, coalesce(d.score, 0) as score,
        b.amount as amount_added, case when d.match_type is not null then d.supplier_pos end as supplier_pos
      from blocks b left join decisions d on b.vendor_norm = d.vendor_norm)"""


TOTALS = f"""
totals as (select supplier_pos, cast(sum({DEC('coalesce(amount_added, 0.0)')}) as double) as added,
        count(*) as n_matches from report where match_type <> 'no_match' and supplier_pos is not null
      group by supplier_pos)"""


def UPDATED(totals: str = "totals") -> str:
    new_total = f"(coalesce({PA('u.invoice_total')}, 0.0) + coalesce(cast(t.added as double), 0.0))"
    return f"""
select u.row_pos, u.supplier, u.default_payment_method,
  case when {BLANK('u.invoice_total')} and {new_total} = 0 then null else {new_total} end as invoice_total
from universal u left join {totals} t on u.row_pos = t.supplier_pos"""


def CSVCELL(c: str) -> str:
    return (f"coalesce(case when regexp_matches({c}, '[,\"\\n]') then '\"' || replace({c}, '\"', '\"\"') || '\"' "
            f"else {c} end, '')")


def CSVLINE(*cols: str) -> str:
    return " || ',' || ".join(CSVCELL(c) for c in cols)


def NUMTEXT(x: str) -> str:
    return f"regexp_replace(cast({DEC(x)} as varchar), '(\\.[0-9]*[1-9])0+$|\\.0+$', '\\1')"


def LEAD_FENCE(x: str) -> str:
    t = JT(x)
    return (f"(case when starts_with({t}, '```json') then "
            f"regexp_replace(regexp_replace({t}, '^```json\\n?', ''), '\\n?```\\z', '') "
            f"when starts_with({t}, '```') then regexp_replace(regexp_replace({t}, '^```\\n?', ''), '\\n?```\\z', '') "
            f"else {t} end)")


def ANY_FENCE(x: str) -> str:
    x = JT(x)
    inner_json = f"split_part(split_part({x}, '```json', 2), '```', 1)"
    inner = f"split_part({x}, '```', 2)"
    return (f"(case when contains({x}, '```json') then {JT(inner_json)} "
            f"when contains({x}, '```') then {JT(inner)} else {x} end)")
