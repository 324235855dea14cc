"""Registered queries: one per operator key, each ``(spark, sf_dir) -> DataFrame`` over
the driver's tables (or tables Spark derives from them).  Computed columns carry the
same names as in the DuckDB oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgermatch.functions.amounts import parse_amount
from ledgermatch.functions.scoring import edit_ratio, similarity, token_sort_ratio
from ledgermatch.functions import screening as SC
from ledgermatch.functions import text as T
from ledgermatch.operators.ordering import first_rows_per_sheet
from ledgermatch.operators.rollup import supplier_totals
from ledgermatch.operators.screening import flag_by_table
from ledgermatch.operators import decisions as D
from ledgermatch.operators import matching as M
from ledgermatch.operators import reports as R
from ledgermatch.operators import sheet as S
from ledgermatch.plans.decisions import apply_decisions
from ledgermatch.plans.reconcile import reconcile
from ledgermatch.plans.process import prepare_requests
from ledgermatch.plans.requests import MAX_CHARS, MAX_SUPPLIERS, build_bounded_requests
from ledgermatch.plans.screening import screen_text
from ledgermatch.session import materialize
from ledgermatch.sources.fixtures import table
from ledgermatch.sources import sheets as IO


def _t(spark, sf, name):
    return table(spark, sf, name)


def _blocks(spark, sf):
    return materialize(S.vendor_blocks(S.mark_rows(_t(spark, sf, "vendor_sheet"))), "vendor-blocks")


def _suppliers(spark, sf):
    return materialize(M.supplier_index(_t(spark, sf, "universal")), "supplier-index")


def _name_pairs(spark, sf):
    """Vendor spelling k next to master row k (both normalised)."""
    v = _t(spark, sf, "vendor_names")
    u = _t(spark, sf, "universal")
    return v.join(u, v.k == u.row_pos).select(
        "k", T.normalize_name("vendor").alias("vendor_norm"), T.normalize_name("supplier").alias("supplier_norm"))


# ---------------------------------------------------------------- scalar functions

def normalize_names(spark, sf):
    s = _t(spark, sf, "vendor_sheet")
    return s.where(F.col("vendor").isNotNull()).select(
        "sheet_id", "row_pos", "vendor", T.normalize_name("vendor").alias("vendor_norm"))


def parse_invoice_amounts(spark, sf):
    s = _t(spark, sf, "vendor_sheet")
    return s.select("sheet_id", "row_pos", "vendor", parse_amount("invoice_amount").alias("amount"))


def qualifying_words(spark, sf):
    u = _t(spark, sf, "universal").select("row_pos", T.normalize_name("supplier").alias("supplier_norm"))
    q = T.qualifying_words("supplier_norm")
    return u.select("row_pos", "supplier_norm", F.array_join(q, " ").alias("words_text"),
                    F.size(q).alias("n_words"))


def common_words(spark, sf):
    p = _name_pairs(spark, sf)
    c = T.common_words(T.drop_stop_words(T.qualifying_words("vendor_norm")),
                       T.drop_stop_words(T.qualifying_words("supplier_norm")))
    return p.select("k", F.array_join(c, " ").alias("common_text"), F.size(c).alias("n_common"))


def contains_as_word(spark, sf):
    p = _name_pairs(spark, sf)
    return p.select(
        "k",
        T.contains_as_word("supplier_norm", F.array_join(T.qualifying_words("vendor_norm"), " "))
        .alias("vendor_in_supplier"),
        T.contains_as_word("vendor_norm", F.array_join(T.qualifying_words("supplier_norm"), " "))
        .alias("supplier_in_vendor"))


def similarity_scores(spark, sf):
    p = _name_pairs(spark, sf)
    return p.select("k", edit_ratio("vendor_norm", "supplier_norm").alias("edit_ratio"),
                    token_sort_ratio("vendor_norm", "supplier_norm").alias("token_sort_ratio"),
                    similarity("vendor_norm", "supplier_norm").alias("score"),
                    T.shares_ngram("vendor_norm", "supplier_norm", 3).alias("shares_run"))


# ---------------------------------------------------------------- sheet operators

def nonblank_vendors(spark, sf):
    return S.nonblank_vendors(_t(spark, sf, "vendor_sheet"))


def forward_fill_vendor(spark, sf):
    return S.forward_fill_vendor(_t(spark, sf, "vendor_sheet"))


def subtotal_rows(spark, sf):
    return S.subtotal_rows(_t(spark, sf, "vendor_sheet"))


def distinct_vendors(spark, sf):
    return S.distinct_vendors(_t(spark, sf, "vendor_sheet"))


def vendor_subtotals(spark, sf):
    return S.vendor_subtotals(_t(spark, sf, "vendor_sheet"))


def section_totals(spark, sf):
    return S.section_totals(_t(spark, sf, "vendor_sheet"))


# ---------------------------------------------------------------- matching

def supplier_index(spark, sf):
    return _suppliers(spark, sf)


def match_exact(spark, sf):
    return M.match_exact(M.vendor_keys(_blocks(spark, sf)), _suppliers(spark, sf))


def residual_vendors(spark, sf):
    keys = M.vendor_keys(_blocks(spark, sf))
    return M.residual(keys, M.match_exact(keys, _suppliers(spark, sf)))


def match_fuzzy_best(spark, sf):
    res, sup = _residual(spark, sf)
    return M.match_fuzzy(res, sup, min_score=None)


def match_edit_ratio_best(spark, sf):
    """Another scorer, searched by the bound that it declares."""
    res, sup = _residual(spark, sf)
    return M.match_fuzzy(res, sup, scorer=edit_ratio)


def matched_at_threshold(spark, sf):
    u, s = _t(spark, sf, "universal"), _t(spark, sf, "vendor_sheet")
    return reconcile(u, s, min_score=85).match_report


def match_report(spark, sf):
    return reconcile(_t(spark, sf, "universal"), _t(spark, sf, "vendor_sheet")).match_report


def match_report_three_tier(spark, sf):
    return reconcile(_t(spark, sf, "universal"), _t(spark, sf, "vendor_sheet"),
                     tiers=("exact", "substring", "fuzzy")).match_report


def supplier_totals_q(spark, sf):
    return supplier_totals(match_report(spark, sf))


def update_master_q(spark, sf):
    """Minimum slice: exact tier only."""
    return reconcile(_t(spark, sf, "universal"), _t(spark, sf, "vendor_sheet"),
                     tiers=("exact",)).updated_master


def reconcile_master(spark, sf):
    return reconcile(_t(spark, sf, "universal"), _t(spark, sf, "vendor_sheet")).updated_master


QUERIES = {
    "normalize_names": normalize_names,
    "parse_invoice_amounts": parse_invoice_amounts,
    "qualifying_words": qualifying_words,
    "common_words": common_words,
    "contains_as_word": contains_as_word,
    "similarity_scores": similarity_scores,
    "nonblank_vendors": nonblank_vendors,
    "forward_fill_vendor": forward_fill_vendor,
    "subtotal_rows": subtotal_rows,
    "distinct_vendors": distinct_vendors,
    "vendor_subtotals": vendor_subtotals,
    "section_totals": section_totals,
    "supplier_index": supplier_index,
    "match_exact": match_exact,
    "residual_vendors": residual_vendors,
    "match_fuzzy_best": match_fuzzy_best,
    "match_edit_ratio_best": match_edit_ratio_best,
    "matched_at_threshold": matched_at_threshold,
    "match_report": match_report,
    "match_report_three_tier": match_report_three_tier,
    "supplier_totals": supplier_totals_q,
    "update_master": update_master_q,
    "reconcile_master": reconcile_master,
}



# ---------------------------------------------------------------- substring tier

def _residual(spark, sf):
    keys = M.vendor_keys(_blocks(spark, sf))
    sup = _suppliers(spark, sf)
    return materialize(M.residual(keys, M.match_exact(keys, sup)), "residual"), sup


def match_substring_pairs(spark, sf):
    res, sup = _residual(spark, sf)
    return M.substring_pairs(res, sup)


def match_substring_best(spark, sf):
    res, sup = _residual(spark, sf)
    return M.match_substring(res, sup)


# ---------------------------------------------------------------- report views

def ranked_report(spark, sf):
    return R.ranked_report(match_report(spark, sf))


def match_counts(spark, sf):
    return R.match_counts(match_report(spark, sf))


def unmatched_vendors(spark, sf):
    return R.unmatched_vendors(match_report(spark, sf))


# ---------------------------------------------------------------- decisions

def distinct_suppliers(spark, sf):
    return D.first_row_by_name(_t(spark, sf, "universal"))


def parse_responses(spark, sf):
    return D.parse_decisions(_t(spark, sf, "match_responses"))


def quarantine_decisions(spark, sf):
    return D.quarantined_responses(_t(spark, sf, "match_responses")).select("request_id", "idx", "reason")


def ingest_decisions(spark, sf):
    return D.decisions_report(D.parse_decisions(_t(spark, sf, "match_responses")), _t(spark, sf, "universal"))


def apply_decisions_q(spark, sf):
    return apply_decisions(_t(spark, sf, "universal"), _t(spark, sf, "match_responses")).updated_master


def match_request_batches(spark, sf):
    """The context cut as in the reference."""
    return build_bounded_requests(_t(spark, sf, "universal"), _t(spark, sf, "vendor_sheet"),
                                  max_chars=MAX_CHARS, max_suppliers=MAX_SUPPLIERS)


def match_request_whole(spark, sf):
    """The three tables of the requests in one: batches, contexts and chunks."""
    r = prepare_requests(_t(spark, sf, "universal"), _t(spark, sf, "vendor_sheet"), similarity_threshold="85")
    parts = [r.batches.select(F.lit("batch").alias("kind"), "*"), r.contexts.select(F.lit("context").alias("kind"), "*"),
             r.chunks.select(F.lit("chunk").alias("kind"), "*")]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).drop("sheet_key")


# ---------------------------------------------------------------- screening

def flag_keywords(spark, sf):
    d = _t(spark, sf, "documents")
    f = SC.flag_keywords("text")
    return d.select("doc_id", F.array_join(f, ", ").alias("flagged_text"), F.size(f).alias("n_flagged"))


def flag_keyword_table(spark, sf):
    """The keywords of a table, found by an index of its keywords' rarest runs."""
    f = flag_by_table(_t(spark, sf, "documents").select("doc_id", "text"), _t(spark, sf, "keyword_table"))
    return f.select("doc_id", F.array_join("flagged", "|").alias("flagged_text"), F.size("flagged").alias("n_flagged"))


def _verdict_cols(df, key_cols):
    v = F.col("verdict")
    return df.select(*key_cols, v["is_offensive"].alias("is_offensive"), v["message"].alias("message"),
                     v["details"].alias("details"), v["severity"].alias("severity"),
                     F.array_join(v["flagged_words"], ", ").alias("flagged_text"), "warning")


def screen_text_q(spark, sf):
    c = _t(spark, sf, "conversations")
    return _verdict_cols(screen_text(c), ["conv_id", "turn"])


def warning_messages(spark, sf):
    d = _t(spark, sf, "documents")
    return screen_text(d).select("doc_id", "warning")


# Words that occur in the texts (the default list has none of them).
GIVEN_KEYWORDS = ["data", "river", "xyzzy", "the"]


def flag_given_keywords(spark, sf):
    f = SC.flag_keywords("text", GIVEN_KEYWORDS)
    return _t(spark, sf, "documents").select("doc_id", F.array_join(f, ", ").alias("flagged_text"), F.size(f).alias("n_flagged"))


def screen_given_keywords(spark, sf):
    """Documents, blank and missing texts by a caller's keywords."""
    return _verdict_cols(screen_text(_t(spark, sf, "screen_texts"), keywords=GIVEN_KEYWORDS), ["text_id"])


def screen_text_with_responses(spark, sf):
    d = _t(spark, sf, "documents").withColumnRenamed("doc_id", "text_id")
    out = screen_text(d, responses=_t(spark, sf, "moderation_responses"), id_col="text_id")
    return _verdict_cols(out, ["text_id"])


# ---------------------------------------------------------------- sheet sources and sinks

def scan_vendor_sheet(spark, sf):
    """Write the sheets as CSV (one folder per sheet) and read them back."""
    path = IO.scratch_path(spark, "sheets-csv")
    IO.write_sheets_csv(_t(spark, sf, "vendor_sheet"), path)
    back = IO.read_sheet_csv(spark, path)
    return back.select(F.col("sheet_id").cast("long").alias("sheet_id"), "row_pos", "vendor", "invoice_amount")


def scan_quoted_sheet(spark, sf):
    """The same with line feeds, quotes and commas in cells."""
    path = IO.scratch_path(spark, "sheets-csv")
    IO.write_sheets_csv(_t(spark, sf, "quoted_sheet"), path)
    back = IO.read_sheet_csv(spark, path)
    return back.select(F.col("sheet_id").cast("long").alias("sheet_id"), "row_pos", "vendor", "invoice_amount")


def read_one_sheet(spark, sf):
    """One sheet of a folder of CSV sheets; the other files are not opened."""
    path = IO.scratch_path(spark, "sheets-csv")
    IO.write_sheets_csv(_t(spark, sf, "quoted_sheet"), path)
    back = IO.read_sheet(spark, path, "3")
    return back.select(F.col("sheet_id").cast("long").alias("sheet_id"), "row_pos", "vendor", "invoice_amount")


def select_sheet(spark, sf):
    return IO.select_sheet(_t(spark, sf, "vendor_sheet"), 3)


def csv_render(spark, sf):
    return IO.render_csv_lines(_t(spark, sf, "vendor_sheet"), key_cols=("sheet_id",))


def sheet_head(spark, sf):
    return first_rows_per_sheet(_t(spark, sf, "vendor_sheet"), 5)


def master_round_trip(spark, sf):
    """The updated master written as CSV and as Parquet and read back by its layout."""
    master = reconcile(_t(spark, sf, "noted_master"), _t(spark, sf, "vendor_sheet"), tiers=("exact",)).updated_master
    master = materialize(master, "master").withColumnRenamed("notes", "Notes, internal")
    path = IO.scratch_path(spark, "master")
    back = []
    for fmt in ("csv", "parquet"):
        IO.write_master(master, f"{path}/{fmt}", fmt=fmt)
        again = IO.read_master(spark, f"{path}/{fmt}")
        order = F.lit(",".join(again.columns))
        back.append(again.withColumnRenamed("Notes, internal", "notes").select(F.lit(fmt).alias("format"), order.alias("columns"), "*"))
    return back[0].unionByName(back[1])


QUERIES.update({
    "flag_keyword_table": flag_keyword_table,
    "master_round_trip": master_round_trip,
    "match_substring_pairs": match_substring_pairs,
    "match_substring_best": match_substring_best,
    "ranked_report": ranked_report,
    "match_counts": match_counts,
    "unmatched_vendors": unmatched_vendors,
    "distinct_suppliers": distinct_suppliers,
    "parse_responses": parse_responses,
    "quarantine_decisions": quarantine_decisions,
    "ingest_decisions": ingest_decisions,
    "apply_decisions": apply_decisions_q,
    "match_request_batches": match_request_batches,
    "match_request_whole": match_request_whole,
    "flag_keywords": flag_keywords,
    "flag_given_keywords": flag_given_keywords,
    "screen_given_keywords": screen_given_keywords,
    "screen_text": screen_text_q,
    "warning_messages": warning_messages,
    "screen_text_with_responses": screen_text_with_responses,
    "scan_vendor_sheet": scan_vendor_sheet,
    "scan_quoted_sheet": scan_quoted_sheet,
    "read_one_sheet": read_one_sheet,
    "select_sheet": select_sheet,
    "csv_render": csv_render,
    "sheet_head": sheet_head,
})
