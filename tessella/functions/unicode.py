"""Case and marks of any script folded: rows of ASCII stay in the JVM, the others go through one Arrow function."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _casefolded(text: str) -> str:
    """Compatibility forms and case are one; letters keep their marks, composed again, so both spellings of a marked letter are equal."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", text).casefold())


def _bare(text: str) -> str:
    """As above, without any mark."""
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()) if not unicodedata.combining(c))


#: Letters of the Latin script that no decomposition takes apart, and what stands for them.
_LATIN = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i"})


def _latin(text: str) -> str:
    """Lower case; marks go from Latin letters only, other scripts keep theirs."""
    out: list[str] = []
    latin = False
    for c in unicodedata.normalize("NFKD", text.lower()):
        if unicodedata.combining(c):
            if latin:
                continue
        else:
            latin = "LATIN" in unicodedata.name(c, "")
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out)).translate(_LATIN)


@lru_cache(maxsize=None)
def _routed(fold: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.arrow_udf("string")
    def folded(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fold(t) for t in texts.to_pylist()], pa.string())

    def route(text: Column) -> Column:
        beyond = text.rlike(r"[^\x00-\x7F]")
        return F.when(beyond, folded(F.when(beyond, text))).otherwise(F.lower(text))

    return route


def casefolded(text: Column) -> Column:
    """One form for all spellings of a text that differ in case or in how characters are composed; marks stay."""
    return _routed(_casefolded)(text)


def without_marks(text: Column) -> Column:
    """The same without marks, in every script."""
    return _routed(_bare)(text)


def latin_folded(text: Column) -> Column:
    """Lower case, Latin letters without their marks; other scripts as they are."""
    return _routed(_latin)(text)
