"""Words, terms and visible text as column expressions.

The patterns spell out Unicode classes, because engines disagree on ``\\w`` and ``\\s``.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.params import STOPWORDS

SPACES = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = f"[^{SPACES}]+"
SPACE = f"[{SPACES}]+"
TERM = r"[\p{L}\p{N}_]+"
HIDDEN_MARKUP = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<![^>]*>|</?[a-z][^>]*>"
)


def words(text: Column) -> Column:
    """The maximal runs of anything but white space, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    """The index terms of a text in order: runs of letters, digits and underscores, each in lower case, without stop words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


TERM_RUN, _STOP = re.compile(r"\w+"), frozenset(STOPWORDS)


def term_list(text: str) -> list[str]:
    """The same terms of one text, for work in batches; where the JVM's tables of letters are older than Python's, Python's hold."""
    return [t for t in map(str.lower, TERM_RUN.findall(text)) if t not in _STOP]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Named and numeric references as the characters that they stand for, each decoded once."""
    return text.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def html_words(page: Column, references: dict[str, str] | None = None) -> Column:
    """Words of the visible strings of a page; every tag and comment is a word boundary. ``references``: the only ones that stand for
    characters, each written as given (that of & last, so that nothing is decoded twice); without it all that HTML knows do,
    some also without their semicolon."""
    shown = F.regexp_replace(page, HIDDEN_MARKUP, " ")
    if references is None:
        return words(unescape(shown))
    for reference, character in references.items():
        shown = F.replace(shown, F.lit(reference), F.lit(character))
    return words(shown)
