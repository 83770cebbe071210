"""Document checks in SQL expressions: the first failure in a fixed order names the verdict."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_of

# Texts that hold one of these, in any case, are refused.
INJECTION = ("ignore previous instructions", "ignore all previous", "disregard the above", "you are now", "system prompt", "<|im_start|>", "[[system]]")
ERROR_PAGE = ("404 not found", "403 forbidden", "page not found", "access denied", "this page isn't working", "service unavailable", "under maintenance", "just a moment...")
BOILERPLATE = ("accept all cookies", "we use cookies", "cookie policy", "privacy policy", "terms of service", "skip to main content", "enable javascript", "your browser is not supported")
MOJIBAKE = ("\ufffd", "\u00e2\u20ac\u2122", "\u00e2\u20ac\u009c", "\u00e2\u20ac", "\u00c3\u00a9", "\u00c3\u00a8", "\u00c3\u00a2", "\u00c2\u00a0")
BINARY = ("image/", "video/", "audio/", "application/octet-stream")
TERMINATORS = ".!?)]}>\"'”’"


def input_verdict(text: Column, content_type: Column | None = None) -> Column:
    """The first that applies: null_text, empty, binary_type, control (over 5 % or a NUL), short (under 40), error_page, injection, mojibake (over 0.5 %), boilerplate (under 40 without it), truncated (160 or more, cut off), or ok."""
    body = F.trim(text)
    low, size = F.lower(body), F.length(body)
    control = size - F.length(F.regexp_replace(body, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    holds = lambda phrases: reduce(or_, (F.contains(low, F.lit(p)) for p in phrases))
    garbled = reduce(add, (count_of(body, m) for m in MOJIBAKE))
    residual = reduce(lambda t, p: F.replace(t, F.lit(p), F.lit(" ")), BOILERPLATE, low)
    bare = F.length(F.trim(F.regexp_replace(residual, r"\s+", " "))) < 40
    binary = F.lit(False) if content_type is None else F.coalesce(reduce(or_, (F.lower(content_type).startswith(p) for p in BINARY)), F.lit(False))
    return (
        F.when(text.isNull(), "null_text").when(body == "", "empty").when(binary, "binary_type").when((control > size * 0.05) | F.contains(text, F.lit("\x00")), "control")
        .when(size < 40, "short").when(holds(ERROR_PAGE), "error_page").when(holds(INJECTION), "injection").when(garbled > size * 0.005, "mojibake").when(holds(BOILERPLATE) & bare, "boilerplate")
        .when((size >= 160) & ~F.contains(F.lit(TERMINATORS), F.right(body, F.lit(1))), "truncated").otherwise("ok")
    )


def scores(rows: DataFrame, predicted: Column, expected: Column) -> DataFrame:
    """One row: true and false positives and negatives, precision, recall and F1; an empty denominator gives 1."""
    counts = rows.agg(
        F.count_if(predicted & expected).alias("tp"), F.count_if(predicted & ~expected).alias("fp"), F.count_if(~predicted & expected).alias("fn"), F.count_if(~predicted & ~expected).alias("tn"))
    share = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / b)
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall)), 4).alias("f1"))
