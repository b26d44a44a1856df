"""Plug points for models and what stands in for them offline.

embed_fn      Callable[[pd.Series], pd.Series]: texts to vectors, in order, one dimension.
summarize_fn  Callable[[Column], Column]: a source's text to a page reply (or a pandas UDF).
judge_fn      Callable[[Page, list[Story]], str | None]: a summary and its candidates in order, with texts, to one name or none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark.operators.evaluate import parse_labels
from kbspark.operators.stories import first_candidate
from kbspark.operators.vectors import default_embed

__all__ = ["default_embed", "default_summarize", "first_candidate", "parse_labels"]


def default_summarize(text: Column, sentences: int = 2) -> Column:
    """An extract as a reply: the first words as title, long words as identifiers, the first sentences as body."""
    # Each regular expression goes over the whole text once at most: title and sentences need its start only.
    text = F.btrim(text, F.lit(" \t\r\n"))
    flat = lambda x: F.regexp_replace(x, r"[ \t\r\n]+", " ")
    start = F.regexp_extract(text, r"\A(?:[^ \t\r\n]|[ \t\r\n]++){0,40}+", 0)
    title = F.trim(F.regexp_replace(flat(start), "[^A-Za-z0-9 .,]", ""))
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Za-z]{14,17})"), F.lit(1))))
    listed = F.array_join(F.transform(terms, lambda w: F.concat(F.lit("\n  - term:"), w)), "")
    ids = F.regexp_replace(listed, r"\A\z", " []")
    lead = flat(F.array_join(F.slice(F.split(text, r"\.[ \t\r\n]+", sentences + 1), 1, sentences), ". "))
    return F.concat(F.lit("---\ntitle: "), title, F.lit("\nidentifiers:"), ids, F.lit("\n---\n\n"), lead)
