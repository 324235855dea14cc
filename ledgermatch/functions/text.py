"""Name handling: JavaScript-compatible trimming/blank tests, name normalisation,
qualifying words, stop-word removal, ordered whole-word containment and the
substring-tier predicate.  All functions take and return ``Column`` and compile to
built-in Spark SQL expressions.

Normalised names contain only ``[a-z0-9]`` runs separated by single spaces, which the
word-level functions rely on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference behaviour) -----------------------------
# Characters removed by JavaScript String.prototype.trim: TAB, LF, VT, FF, CR, SPACE,
# NBSP, OGHAM SPACE MARK, EN QUAD..HAIR SPACE, LINE SEPARATOR, PARAGRAPH SEPARATOR,
# NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE, BYTE ORDER MARK.
JS_SPACE_CLASS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Minimum word length for the substring tier.
MIN_WORD_LEN = 4
# Company words ignored when counting shared words in the substring tier.
STOP_WORDS = ["foods", "beverages", "inc", "llc", "corp", "company", "co", "ltd", "limited"]
# ---------------------------------------------------------------------------------

JS_TRIM_PATTERN = rf"^{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


JS_NON_SPACE = "[^" + JS_SPACE_CLASS[1:]


def js_trim(c) -> Column:
    """JavaScript ``trim``: strips Unicode spaces, NBSP and U+FEFF (Spark ``trim`` strips U+0020 only).
    Values without a space at either end skip the replacement."""
    x = _col(c)
    edge = F.substring(x, 1, 1).rlike(JS_SPACE_CLASS) | F.substring(x, -1, 1).rlike(JS_SPACE_CLASS)
    return F.when(edge, F.regexp_replace(x, JS_TRIM_PATTERN, "")).otherwise(x)


def is_blank(c) -> Column:
    """``String(v || '').trim() === ''`` for a string column: null, empty or only spaces
    (i.e. no character outside the space class; the search stops at the first one)."""
    return F.coalesce(~_col(c).rlike(JS_NON_SPACE), F.lit(True))


def normalize_name(c) -> Column:
    """trim, lower-case, every run of non ``[a-z0-9]`` characters becomes one space.

    One regex is equivalent to the reference's ``[-_]+`` / ``[^\\w\\s]`` / whitespace
    collapse chain because ``\\w`` is ASCII: accented letters split words.
    A null input yields null here (the reference would produce the text ``"null"``;
    declared deviation V4).
    """
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", " "))


def words(norm) -> Column:
    """Words of a normalised name; the empty name has no words."""
    n = _col(norm)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def qualifying_words(norm) -> Column:
    """Words of length >= 4, in order, duplicates kept."""
    return F.filter(words(norm), lambda w: F.length(w) >= MIN_WORD_LEN)


def drop_stop_words(ws) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(_col(ws), lambda w: ~F.array_contains(stop, w))


def common_words(left_words, right_words) -> Column:
    """Left words that occur in the right list; duplicates on the left are kept
    (``["acme","acme"]`` and ``["acme"]`` give two), unlike ``array_intersect``."""
    r = _col(right_words)
    return F.filter(_col(left_words), lambda w: F.array_contains(r, w))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, not at each of its places in the lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def _in_order(text_words: Column, search_words: Column) -> Column:
    """All search words occur among the text's words, in order, gaps allowed: one pass over
    the text's words counts how many search words were met."""
    met = F.aggregate(text_words, F.lit(0), lambda n, w: F.when(w == F.get(search_words, n), n + 1).otherwise(n))
    return met == F.size(search_words)


def contains_as_word(text_norm, search_norm) -> Column:
    """Ordered whole-word containment of ``search`` in ``text`` (both normalised).

    False when either is empty, ``search`` is shorter than 4 characters or any search
    word is shorter than 4.  One word: a whole-word hit.  Several: all words, in order,
    gaps allowed.
    """
    t, s = _col(text_norm), _col(search_norm)
    held = _once(F.struct(words(t).alias("t"), words(s).alias("s")), lambda x: (
        F.forall(x["s"], lambda w: F.length(w) >= MIN_WORD_LEN) & _in_order(x["t"], x["s"])))
    return F.coalesce((t != "") & (F.length(s) >= MIN_WORD_LEN) & held, F.lit(False))


def smart_substring_match(vendor_norm, supplier_norm) -> Column:
    """The substring-tier predicate on two normalised names.

    Both names need 4+ characters and a qualifying word; then any of
    (a)/(b) the longer name contains the shorter's qualifying words in order,
    (c) at least two shared non-stop qualifying words (vendor duplicates count) and at
        least two such words on each side,
    (d) both 8+ characters and equal first 8 or last 8 characters.
    """
    v, s = _col(vendor_norm), _col(supplier_norm)
    vq, sq = qualifying_words(v), qualifying_words(s)
    lists = F.struct(words(v).alias("v"), words(s).alias("s"), vq.alias("vq"), sq.alias("sq"),
                     drop_stop_words(vq).alias("vm"), drop_stop_words(sq).alias("sm"))
    lv, ls = F.length(v), F.length(s)
    span = 2 * MIN_WORD_LEN
    affix = (F.least(lv, ls) >= span) & (
        (F.substring(v, 1, span) == F.substring(s, 1, span))
        | (F.substring(v, -span, span) == F.substring(s, -span, span)))

    def holds(x: Column) -> Column:
        gate = (lv >= MIN_WORD_LEN) & (ls >= MIN_WORD_LEN) & (F.size(x["vq"]) > 0) & (F.size(x["sq"]) > 0)
        shared = ((F.size(x["vm"]) >= 2) & (F.size(x["sm"]) >= 2)
                  & (F.size(common_words(x["vm"], x["sm"])) >= 2))
        return gate & (affix | shared | ((lv > ls) & _in_order(x["v"], x["sq"]))
                       | ((ls > lv) & _in_order(x["s"], x["vq"])))

    return F.coalesce(_once(lists, holds), F.lit(False))


def ngrams(norm, n: int = 3) -> Column:
    """Distinct character n-grams of a string (empty when shorter than n)."""
    s = _col(norm)
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, n)))
    ).otherwise(F.array().cast("array<string>"))


def runs_of(text, lengths: list[int], among: list[str] | None = None) -> Column:
    """Distinct runs of the given lengths in a text of any length (``among``: those of a short
    list), in one pass over its characters (``ngrams`` looks up each run from the start of the
    text, which suits names)."""
    def of(chars: Column) -> Column:
        def runs(n: int) -> Column:
            last = F.size(chars) - n
            run = lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])
            return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), run)).otherwise(
                F.array().cast("array<string>"))

        found = F.concat(*[runs(n) for n in lengths])
        return F.array_distinct(found if among is None else F.filter(found, lambda r: r.isin(among)))

    return F.when(_col(text) == "", F.array().cast("array<string>")).otherwise(_once(F.split(_col(text), ""), of))


def shares_ngram(a, b, n: int = 3) -> Column:
    """True when ``a`` and ``b`` share a substring of length ``n`` (the minimum matched run)."""
    a, b = _col(a), _col(b)
    return F.coalesce((F.length(a) >= n) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - (n - 1), F.lit(1))),
        lambda i: F.instr(b, F.substring(a, i, n)) > 0), F.lit(False))
