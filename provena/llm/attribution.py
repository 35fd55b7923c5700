"""Token counts by section: whole documents are encoded once, tokens are dealt to sections by their offsets.

The rule for a token that touches several sections: it counts for the one that holds most of its
code points, and of equal ones for the first. A token that touches none (between sections) counts for the
section number -1. So the counts of a document add up to its number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from provena.llm.common import only, text_of
from provena.llm.tokens import encoder

COUNTS = "doc_id long, section long, begin long, end long, n_tokens long, n_crossing long, first_token long"


def lines(text: str) -> np.ndarray:
    """The default sections: lines, each with its line break, as rows (begin, end) of code points."""
    ends = np.cumsum([len(line) + 1 for line in text.split("\n")])
    ends[-1] = len(text)
    return np.column_stack([np.concatenate([[0], ends[:-1]]), ends])


def dealt(tokens: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token (id, begin, end) its section or -1, and whether it touches several.

    Sections are sorted, apart, and may leave gaps; a token of no width counts where it stands.
    """
    if not len(sections):
        return np.full(len(tokens), -1), np.zeros(len(tokens), bool)
    begin, end = tokens[:, 1], np.maximum(tokens[:, 2], tokens[:, 1] + 1)
    first = np.searchsorted(sections[:, 1], begin, side="right")
    last = np.searchsorted(sections[:, 0], end, side="left") - 1
    owner, crossing = np.where(first <= last, first, -1), last > first
    for i in np.flatnonzero(crossing):
        over = sections[first[i] : last[i] + 1]
        owner[i] = first[i] + int(np.argmax(np.minimum(over[:, 1], end[i]) - np.maximum(over[:, 0], begin[i])))
    return owner, crossing


def token_counts(docs: DataFrame, tokenizer: str, sections: str | None = None) -> DataFrame:
    """(doc_id, section, begin, end, n_tokens, n_crossing, first_token) per document and section.

    ``sections`` names a column of arrays of (begin, end) in code points, sorted and apart; without it a
    section is a line. ``n_crossing`` of the section's tokens reach into others. Sections without
    tokens have rows too; -1 has one only if it has tokens. Null and empty texts have one empty
    line; null sections count as none; repeated rows give rows each; an empty table gives none;
    other columns are ignored.
    """
    chosen = only(docs, ("doc_id", "long"), ("text", "string"), *([(sections, "array<struct<begin:long,end:long>>")] if sections else []))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, offsets=True)
        for frame in frames:
            given = frame[sections] if sections else [None] * len(frame)
            parts = []
            for doc, text, own in zip(frame["doc_id"].tolist(), text_of(frame["text"]), given, strict=True):
                at = lines(text) if not sections else np.array([(x["begin"], x["end"]) for x in own] if own is not None else [], np.int64).reshape(-1, 2)
                tokens = enc.spans(text)
                owner, crossing = dealt(tokens, at)
                n = len(at)
                total, cross = np.bincount(owner + 1, minlength=n + 1), np.bincount(owner + 1, weights=crossing, minlength=n + 1).astype(np.int64)
                first = np.full(n + 1, -1)
                seen, where = np.unique(owner + 1, return_index=True)
                first[seen] = where
                rows = np.column_stack([np.arange(-1, n), np.concatenate([[-1], at[:, 0]]), np.concatenate([[-1], at[:, 1]]), total, cross, first])
                parts.append((doc, rows if total[0] else rows[1:]))
                if len(parts) >= 500:
                    yield table(parts)
                    parts = []
            if parts:
                yield table(parts)

    def table(parts: list) -> pd.DataFrame:
        rows = np.concatenate([r for _, r in parts])
        names = [x.split()[0] for x in COUNTS.split(", ")]
        docs_ = pd.Series([d for d, _ in parts], dtype="Int64").repeat([len(r) for _, r in parts]).reset_index(drop=True)
        return pd.DataFrame({"doc_id": docs_} | {n: rows[:, k] for k, n in enumerate(names[1:])})

    return chosen.mapInPandas(count, COUNTS)
