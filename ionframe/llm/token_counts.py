"""Token counts by offset-mapped attribution.

A whole text is encoded once. The running sum of the tokens' byte widths gives
every token its byte span, a table of the text's byte positions turns that into
character spans, and the spans are interval-joined (both sides in order) with
the spans of fields or sections. A token that crosses a boundary is allocated
by a rule: ``first`` gives it to the section of its first character, ``last`` to
that of its last character, ``most`` to the section that holds most of its
characters (the earlier one on ties). Tokens outside all sections are counted
under section -1, so that a document's counts always add up to its tokens.

Edge cases: null text is empty, has one empty section and no tokens; null or
empty section lists leave all tokens to section -1, and sections that are null or
have a null bound are left out; sections must not overlap and are taken in order of
their start; texts of any length are encoded whole; repeated rows repeat; an empty
table gives no rows; further columns are ignored. Characters are code points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.llm.shared import rows_made, text_or_empty
from ionframe.llm.tokens import byte_encoder

RULES = ("first", "last", "most")
FIELDS = {"section": "int", "start": "long", "end": "long", "n_tokens": "long", "n_crossing": "long"}


def char_spans(text: bytes, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token, by the tokens' byte widths."""
    ends = np.cumsum(widths)
    char_of = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    return char_of[ends - widths], char_of[ends - 1]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section index (-1: none) of each token, and whether it crosses a boundary."""

    def at(chars: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, chars, "right") - 1
        return np.where((k >= 0) & (chars < ends[np.maximum(k, 0)]), k, -1) if len(starts) else np.full(len(chars), -1)

    a, b = at(first), at(last)
    if rule == "last":
        return b, a != b
    own = a.copy()
    if rule == "most":
        for t in np.flatnonzero(a != b).tolist():
            inside = at(np.arange(first[t], last[t] + 1))
            names, n = np.unique(inside, return_counts=True)
            best = n.max()
            own[t] = next(x for x in inside.tolist() if n[names == x][0] == best)
    return own, a != b


def newline_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(p) for p in text.split("\n")), np.int64) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    ends[-1] -= 1
    return starts, ends


def count_tokens(docs: DataFrame, sections: str | None = None, rule: str = "first", encoder: str | None = None) -> DataFrame:
    """Tokens by document and section.

    sections: a column of ``array<struct<start:long,end:long>>`` in characters;
    None takes the text's lines (a line feed belongs to the line it ends).
    Returns ``doc_id, section, start, end, n_tokens, n_crossing``; n_crossing
    counts allocated tokens that reach over the section's bounds.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def start() -> Callable:
        encoder_ = byte_encoder(encoder)

        def run(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
            texts = batch.column("text").to_pylist()
            given = batch.column("sections").to_pylist() if sections else [None] * len(texts)
            columns: dict[str, list] = {c: [np.array([], np.int64)] for c in ("of", *FIELDS)}
            for k, (text, spans, raw) in enumerate(zip(texts, given, encoder_.encode(texts), strict=True)):
                if sections:
                    told = sorted((s["start"], s["end"]) for s in spans or [] if s is not None and s["start"] is not None and s["end"] is not None)
                    starts, ends = np.array([s for s, _ in told], np.int64), np.array([e for _, e in told], np.int64)
                else:
                    starts, ends = newline_spans(text)
                ids = np.frombuffer(raw, "<u4")
                first, last = char_spans(text.encode(), encoder_.widths[ids]) if len(ids) else (np.array([], np.int64),) * 2
                own, crossing = allocate(first, last, starts, ends, rule)
                n, over = np.bincount(own + 1, minlength=len(starts) + 1), np.bincount(own[crossing] + 1, minlength=len(starts) + 1)
                outside = 0 if n[0] or not len(starts) else 1  # the row of section -1 only where it is needed
                for name, values in (("of", np.full(len(n), k)), ("section", np.arange(-1, len(starts))), ("start", np.concatenate(([-1], starts))), ("end", np.concatenate(([-1], ends))), ("n_tokens", n), ("n_crossing", over)):
                    columns[name].append(values[outside:])
            made = {c: np.concatenate(v) for c, v in columns.items()}
            return made.pop("of"), made

        return run

    cols = [F.col("doc_id"), text_or_empty().alias("text")] + ([F.col(sections).alias("sections")] if sections else [])
    return rows_made(docs.select(*cols), ["doc_id"], FIELDS, start)
