"""Counts over whole texts, from which quality models derive their features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, pieces_of, text_or_empty, trim

find_words = re.compile(WORD).findall
find_symbols = re.compile(r"[#*$%&|<>]").findall

#: Every count is a whole number, so that results don't depend on the order of sums.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_distinct", "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "longest_word", "longest_line", "text_chars",
)
WINDOW = 5


def repeated_words(words: list[str]) -> int:
    """Words that lie in a five-word window which the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, upto = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + WINDOW - max(at, upto)
            upto = at + WINDOW
    return covered


def counts_of(text: str, words: list[str] | None = None) -> tuple[int, ...]:
    words = find_words(text) if words is None else words
    lines = [line for line in text.split("\n") if find_words(line)] if "\n" in text else [text][: bool(words)]
    letters = text.encode("utf-32-le")
    codes = np.frombuffer(letters, np.uint32)
    return (
        len(words),
        sum(map(len, words)),
        len(find_symbols(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(set(words)),
        len(lines),
        int(np.count_nonzero((codes >= 65) & (codes <= 90))),
        int(np.count_nonzero((codes >= 48) & (codes <= 57))),
        text.count("!") + text.count("?"),
        text.count(".") + text.count(","),
        max(map(len, words), default=0),
        max(map(len, lines), default=0),
        len(codes),
    )


def document_counts(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, the extra columns and COUNTS of every whole text; a null text counts as empty."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *extra)
    names = [n for n in kept.columns if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                table = np.array([counts_of(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], [*names, *COUNTS])
        trim()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text"]
    return kept.mapInArrow(run, ", ".join([*fields, *(f"{n} long" for n in COUNTS)]))


def features_of(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Ratios and logarithms of the counts: their names and a row per document."""
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["text_chars"], 1), np.maximum(c["n_lines"], 1)
    made = {
        "log_words": np.log1p(c["n_words"]),
        "mean_word": c["word_chars"] / words,
        "symbols": c["n_symbols"] / words,
        "dup_lines": c["n_dup_lines"] / lines,
        "repeats": c["n_repeat_words"] / words,
        "distinct": np.log1p(c["n_distinct"]) / np.log1p(words),  # hardly falls with length
        "upper": c["n_upper"] / chars,
        "digits": c["n_digits"] / chars,
        "marks": c["n_marks"] / words,
        "stops": c["n_stops"] / words,
        "longest_word": np.log1p(c["longest_word"]),
        "words_a_line": c["n_words"] / lines,
    }
    return list(made), np.stack(list(made.values()), axis=1)
