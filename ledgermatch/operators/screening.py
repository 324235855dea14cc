"""Text screening.

Each text gets a verdict struct.  Without an external verdict the keyword screen is
used (lower-case substring test per keyword, list order kept).  External verdicts are
JSON objects, possibly inside a code fence, joined by text id; a missing or
unparseable verdict falls back to the keyword screen.  Texts are processed whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgermatch.functions.responses import extract_fenced, json_kind, strict_json
from ledgermatch.functions.screening import screen_verdict, warning_message
from ledgermatch.functions.text import runs_of
from ledgermatch.operators.blocking import keyed_pairs
from ledgermatch.operators.keyword_index import KeywordIndex
from ledgermatch.session import materialize, ship_code

#: Length of the runs by which keywords of a table are found.
RUN = 3
#: Distinct runs of an index up to which texts are searched for these alone.
SHORT_INDEX = 4096
#: Tables of keywords up to this size (a keyword counts its bytes and its entry) go to every task.
INDEX_BYTES, ENTRY_BYTES = 32 << 20, 64


def _truthy(v) -> Column:
    """What a script takes for true: true, a number but 0, a text but the empty one, any
    object or array; null and a missing field are false."""
    kind = json_kind(v)
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
                      .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
                      .when(kind.isin("OBJECT", "ARRAY"), F.lit(True)).otherwise(number != 0), F.lit(False))


def parse_verdicts(responses: DataFrame, id_col: str = "text_id") -> DataFrame:
    """One row per id: ``id, parsed``.  ``parsed`` is null unless the whole text (trimmed, out
    of its fence) is JSON other than null; JSON that is no object has no fields and so counts
    as clean.  Of several verdicts for one id a usable one goes before others, then an
    offensive one, then the smallest text."""
    v = responses.select(id_col, "response", strict_json(extract_fenced("response")).alias("v"))
    field = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind).alias(name)
    usable = F.coalesce(json_kind("v") != "VOID", F.lit(False))
    offensive = _truthy(F.try_variant_get("v", "$.isOffensive", "variant"))
    parsed = F.when(usable, F.struct(offensive.alias("isOffensive"), field("severity", "string"),
                                     field("reason", "string"), field("flaggedWords", "array<string>")))
    ranked = F.struct((~usable).alias("unusable"), (~offensive).alias("clean"), "response", parsed.alias("parsed"))
    return v.groupBy(id_col).agg(F.min(ranked)["parsed"].alias("parsed"))


def screen_texts(texts: DataFrame, text_col: str = "text", keywords=None,
                 verdicts: DataFrame | None = None, id_col: str | None = None) -> DataFrame:
    """Append ``verdict`` (struct) and ``warning`` (display text) to every row of ``texts``."""
    if verdicts is None:
        out = texts.select("*", screen_verdict(F.col(text_col), None, keywords).alias("verdict"))
    else:
        j = texts.join(verdicts, id_col, "left")
        out = j.select(*texts.columns,
                       screen_verdict(F.col(text_col), F.col("parsed"), keywords).alias("verdict"))
    return out.select("*", warning_message("verdict").alias("warning"))


def flag_by_table(texts: DataFrame, keywords: DataFrame, text_col: str = "text",
                  pairs_per_cell: int | None = None, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``texts`` with ``flagged``: the keywords of a table (``place, keyword``; places unique)
    that occur in the lower-cased text, in the order of their places.  The same as
    ``flag_keywords`` with the keywords as a list, for tables too large for a plan.

    Every keyword is filed under its run that the fewest keywords have.  A table of at most
    ``index_bytes`` (its size is summed first) becomes an index that goes to the tasks, and
    texts stay where they are (``operators.keyword_index``).  A larger table is joined with
    the texts' runs.  Null keywords are ignored; the empty keyword occurs in every text but null."""
    named = keywords.where("keyword is not null").select(F.col("place").alias("__lm_place"), F.col("keyword").alias("__lm_word"))
    size = named.agg(F.sum(F.octet_length("__lm_word") + ENTRY_BYTES)).first()[0] or 0
    if size > index_bytes:
        return _flag_by_join(texts, named, text_col, pairs_per_cell)
    ship_code(texts.sparkSession)
    index = KeywordIndex([r[0] for r in named.orderBy("__lm_place").select("__lm_word").collect()])

    @arrow_udf("array<string>")
    def found(text: pa.Array) -> pa.Array:
        return index.find(text)

    return texts.select("*", found(F.lower(F.col(text_col))).alias("flagged"))


def _flag_by_join(texts: DataFrame, keywords: DataFrame, text_col: str, pairs_per_cell: int | None) -> DataFrame:
    """Texts meet keywords in an equi-join on the texts' distinct runs of three characters
    (shorter keywords: on themselves), hot runs cut into cells, and only then is the keyword
    looked for in the text."""
    rows = materialize(texts.withColumn("__lm_row", F.monotonically_increasing_id()), "screen-texts")
    low = F.lower(F.col(text_col))
    known = materialize(keywords, "screen-keywords")
    size = F.least(F.length("__lm_word"), F.lit(RUN))
    filed = known.where("__lm_word <> ''")
    runs = filed.select("__lm_place", F.explode(F.when(size < RUN, F.array("__lm_word")).otherwise(runs_of("__lm_word", [RUN]))).alias("g"))
    held = runs.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    index = materialize(runs.join(held, "g").groupBy("__lm_place").agg(F.min(F.struct("n", "g"))["g"].alias("g")), "screen-index")
    # one to three lengths
    lengths = sorted(r[0] for r in filed.select(size).distinct().collect())
    if not lengths:
        met = rows.select("__lm_row").limit(0).withColumn("__lm_place", F.lit(0))
    else:
        wanted = index.select("g").distinct()
        some = [r[0] for r in wanted.limit(SHORT_INDEX + 1).collect()]
        if len(some) <= SHORT_INDEX:
            own = rows.select("__lm_row", F.explode(runs_of(low, lengths, some)).alias("g"))
        else:
            own = rows.select("__lm_row", F.explode(runs_of(low, lengths)).alias("g")).join(wanted, "g", "left_semi")
        own = materialize(own, "screen-runs")
        met = keyed_pairs(own.select("g", F.col("__lm_row").alias("vendor_norm")), index.select("g", F.col("__lm_place").alias("supplier_norm")),
                          pairs_per_cell).select(F.col("vendor_norm").alias("__lm_row"), F.col("supplier_norm").alias("__lm_place"))
    # a group is one text's candidates
    found = met.join(known, "__lm_place").groupBy("__lm_row").agg(F.array_sort(F.collect_list(F.struct("__lm_place", "__lm_word"))).alias("__lm_c"))
    empty = F.array(*[F.struct(F.lit(r[0]).cast(known.schema["__lm_place"].dataType).alias("__lm_place"), F.lit("").alias("__lm_word"))
                      for r in known.where("__lm_word = ''").select("__lm_place").limit(1).collect()])
    out = rows.join(found, "__lm_row", "left")
    candidates = F.coalesce("__lm_c", F.array().cast(found.schema["__lm_c"].dataType))
    candidates = F.array_sort(F.concat(candidates, empty.cast(found.schema["__lm_c"].dataType)))
    # the lower-cased text is bound once, not at each candidate
    hits = F.get(F.transform(F.array(low), lambda t: F.filter(
        candidates, lambda k: F.coalesce(F.contains(t, k["__lm_word"]), F.lit(False)))), 0)
    return out.select(*texts.columns, F.transform(hits, lambda k: k["__lm_word"]).alias("flagged"))
