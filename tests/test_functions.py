"""Golden cases for the scalar functions (FIXTURES.md G1, G2, G5 scores, G7)."""

import pytest
from pyspark.sql import functions as F

from ledgermatch.functions.amounts import parse_amount
from ledgermatch.functions.render import csv_line, display_number
from ledgermatch.functions.responses import extract_fenced, strip_code_fence
from ledgermatch.functions.scoring import edit_ratio, similarity, token_sort_ratio
from ledgermatch.functions.text import (common_words, contains_as_word, is_blank, js_trim,
                                        normalize_name, shares_ngram, smart_substring_match)


def _one(spark, col, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_normalize_g1(spark):
    got = _one(spark, normalize_name("x"), ["  The Maxwell-Hotel_LLC. ", "A&B  Foods, Inc.", "Café Déli",
                                            "---", "snake__case--x", "O'Neil"])
    assert got == ["the maxwell hotel llc", "a b foods inc", "caf d li", "", "snake case x", "o neil"]


@pytest.mark.parametrize("text,expected", [
    ("$1,234.50", 1234.5), ("(12.00)", -12.0), ("(-5)", 5.0), ("-(5)", -5.0), ("5-", 5.0),
    ("1.2.3", 1.2), ("12-34", 12.0), ("--5", None), ("1e5", 15.0), ("1.234,56", 1.23456),
    ("", None), ("   ", None), (None, None), ("N/A", None), ("-", None), (".", None), ("-.", None),
    (".-", None), ("-.5", -0.5), ("5.", 5.0), ("(7", 7.0), ("( 9 )", -9.0), ("0", 0.0),
    (" 12 ", 12.0),
])
def test_parse_amount_g2(spark, text, expected):
    assert _one(spark, parse_amount("x"), [text]) == [expected]


def test_js_trim_and_blank(spark):
    vals = ["  a ﻿", "　", None, "", "0", " x"]
    assert _one(spark, js_trim("x"), vals) == ["a", "", None, "", "0", "x"]
    assert _one(spark, is_blank("x"), vals) == [False, True, True, True, False, False]


@pytest.mark.parametrize("v,s,expected", [
    ("acme foods", "acme quality foods", True), ("win", "wine", False),
    ("american airlines", "american express", True), ("acme acme", "acme tools", True),
    ("blue foods", "blue limited", False), ("tools acme", "acme tools", True),
    ("beta corp", "corp beta gamma", False), ("acme north supply", "acme supply", True),
    ("big co acme", "acme", True), ("co op", "co op store", False),
])
def test_substring_predicate_g5(spark, v, s, expected):
    df = spark.createDataFrame([(v, s)], "v string, s string")
    assert df.select(smart_substring_match("v", "s")).first()[0] is expected


def test_scores_g5(spark):
    df = spark.createDataFrame([("blu bolt nation 16 llc", "blue bolt nation 16 llc"), ("tools acme", "acme tools"),
                                ("acme", "acme"), ("abcd", "wxyz")], "a string, b string")
    rows = df.select(edit_ratio("a", "b"), token_sort_ratio("a", "b"), similarity("a", "b")).collect()
    assert [tuple(r) for r in rows] == [(96, 96, 96), (0, 100, 100), (100, 100, 100), (0, 0, 0)]


def test_word_helpers(spark):
    df = spark.createDataFrame([("acme acme", "acme tools")], "a string, b string")
    r = df.select(F.size(common_words(F.split("a", " "), F.split("b", " "))),
                  contains_as_word("b", F.lit("acme")), contains_as_word("b", F.lit("win")),
                  shares_ngram("a", "b")).first()
    assert tuple(r) == (2, True, False, True)


def test_csv_and_numbers(spark):
    df = spark.createDataFrame([("a,b", 'say "hi"', None, "x\ny")], "a string, b string, c string, d string")
    assert df.select(csv_line("a", "b", "c", "d")).first()[0] == '"a,b","say ""hi""",,"x\ny"'
    assert _one(spark, display_number("x"), [12345.67, -5.0, 0.0, 1.5e7], "x double") == \
        ["12345.67", "-5", "0", "15000000"]


def test_fences(spark):
    assert _one(spark, strip_code_fence("x"), ['```json\n[1]\n```', '```\n[2]\n```', ' [3] ']) == ["[1]", "[2]", "[3]"]
    assert _one(spark, extract_fenced("x"), ['note\n```json\n{"a":1}\n```', 'x ```{"b":2}``` y', '{}']) == \
        ['{"a":1}', '{"b":2}', "{}"]
