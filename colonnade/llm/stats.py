"""Statistics of whole texts for the quality operators, one Arrow pass, nothing shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ready
from .text import as_bytes, windows, word_hashes

_CLASSES = {
    "n_space": b" \t\n\x0b\x0c\r", "n_symbols": b"#*$%&|<>", "n_upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "n_lower": b"abcdefghijklmnopqrstuvwxyz", "n_digits": b"0123456789", "n_marks": b".,;:", "n_exclaims": b"!?", "n_pipes": b"|",
}
_MASK = np.zeros((len(_CLASSES) + 1, 256), np.int64)
for _k, _chars in enumerate(_CLASSES.values()):
    _MASK[_k, list(_chars)] = 1
_MASK[-1, [i for i in range(256) if i < 128 or i >= 192]] = 1  # each code point once

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_exclaims", "n_pipes")
WINDOW = 5


def counts(text: bytes) -> tuple[int, ...]:
    """The numbers named in COUNTS, of words [^\\x20\\x09-\\x0D]+ and of code points."""
    by = dict(zip([*_CLASSES, "n_chars"], (_MASK @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist()))
    words = text.split()
    n = len(words)
    repeat = distinct = 0
    if n:
        hashes = word_hashes(words)
        distinct = len(set(words))
        if n > WINDOW:
            keys = windows(hashes, WINDOW)
            order = np.argsort(keys, kind="stable")
            same = keys[order[1:]] == keys[order[:-1]]
            if same.any():
                twice = np.zeros(len(keys), bool)
                twice[order[1:]] |= same
                twice[order[:-1]] |= same
                covered = np.zeros(n + 1, np.int64)  # +1 where a window begins, -1 behind its end
                at = np.flatnonzero(twice)
                covered[at] += 1
                np.subtract.at(covered, at + WINDOW, 1)
                repeat = int((np.cumsum(covered[:n]) > 0).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (n, by["n_chars"] - by["n_space"], by["n_symbols"], len(lines) - len(set(lines)), repeat, len(lines), distinct, by["n_upper"], by["n_lower"], by["n_digits"], by["n_marks"], by["n_exclaims"], by["n_pipes"])


def text_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and the COUNTS of each text; a null text has none of anything."""
    ready(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            found = [counts(t) for t in as_bytes(batch.column(len(keep)))]
            columns = zip(*found) if found else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, *COUNTS])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kinds, *(f"{c} long" for c in COUNTS)]))
