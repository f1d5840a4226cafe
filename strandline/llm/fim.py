"""Fill-in-middle: a text is cut at two unit boundaries and its parts are put in another order, so that a
left-to-right model learns to fill the gap.

A unit is a run of ASCII letters or any other single code point. One Arrow-batched pandas UDF does the work: ``regex``
finds the units, their end offsets stand in one array of integers, two look-ups in it slice the text, and ``hashlib``
gives the seeds (of the row's own id, so a repeated run gives the same cut) and the digests.

Results in special cases: a null text is an empty one, and empty texts stay plain; a null id is seeded as the empty
string; repeated rows and ids are cut alike, each row for itself; empty tables give none; further columns stay as
they are (a column called as the result is replaced). Texts of any length are cut as a whole: a task holds one
Arrow batch, its units' offsets (4 bytes each) for one text at a time, and the results of the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import prepare

UNITS = regex.compile(r"[A-Za-z]+|[^A-Za-z]")

RESULT = "output string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Plan:
    """Share of texts (of 100) that stay plain and of the others that put the suffix first, the seed, and the
    marks before prefix, suffix and middle."""

    plain: int = 10
    suffix_first: int = 20
    seed: int = 1
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def unit_ends(text: str) -> np.ndarray:
    return np.fromiter((m.end() for m in UNITS.finditer(text)), np.int32)


def rearrange(text: str, key: str, plan: Plan = Plan()) -> tuple[str, int, str, int | None, int | None]:
    """(output, units, form, code points of the prefix, code points of the middle)."""
    seeds = hashlib.sha256(f"{plan.seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(seeds[i : i + 8], 16) for i in (0, 8, 16, 24))
    ends = unit_ends(text)
    n = len(ends)
    if not n or h3 % 100 >= 100 - plan.plain or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)):
        return text, n, "plain", None, None
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[i - 1]) if i else 0 for i in (one, two))
    before, within, after = plan.prefix + text[:a], plan.middle + text[a:b], plan.suffix + text[b:]
    if h4 % 100 < plan.suffix_first:
        return after + before + within, n, "spm", a, b - a
    return before + after + within, n, "psm", a, b - a


def restore(output: str, form: str, plan: Plan = Plan()) -> str:
    """The text from its output and form alone: the marks cannot stand inside the parts."""
    if form == "plain":
        return output
    marks = (plan.prefix, plan.suffix) if form == "psm" else (plan.suffix, plan.prefix)
    at, end = output.index(marks[1]), output.index(plan.middle)
    first, second, middle = output[len(marks[0]) : at], output[at + len(marks[1]) : end], output[end + len(plan.middle) :]
    return first + middle + second if form == "psm" else second + middle + first


def fill_in_middle(plan: Plan = Plan()) -> object:
    """The UDF over (text, id as text) columns; a struct of ``RESULT``."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for texts, keys in batches:
            rows = []
            for text, key in zip(texts, keys):
                output, n, form, prefix, middle = rearrange(text or "", key or "", plan)
                rows.append((output, n, form, prefix, middle, sha(output), sha(restore(output, form, plan))))
            out = pd.DataFrame(rows, columns=["output", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return F.pandas_udf(run, RESULT)


def transform(docs: DataFrame, plan: Plan = Plan(), text: str = "text", key: str = "doc_id", into: str = "fim") -> DataFrame:
    """``docs`` with the struct ``into`` (see ``RESULT``)."""
    prepare(docs.sparkSession)
    own: Column = fill_in_middle(plan)(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return docs.withColumn(into, own)
