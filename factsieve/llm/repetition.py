"""Quality rules: characters covered by repeated n-grams and lines (operator 8).

Every whole text is cut into words and lines over its bytes; words and lines are numbered by their bytes, so that equal numbers mean
equal bytes, and rolling hashes of the word numbers, of several n-gram lengths, are compared inside the text, and the characters of the words that any repeated n-gram covers are counted.  Nothing leaves a row, so there is no
shuffle, and a task holds one chunk of texts (about 1 MB, or one longer text) at a time.

Defined results: a null or empty text, and one of white space only, has no words, zero counts, ``base_failed`` true and
``kept`` false.  Repeated rows get equal results.  An empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.llm import textbytes as tb

#: Word n-gram lengths with the largest share of a text's word characters that repeated n-grams of that length may cover.
COVER_LIMITS = {5: 0.50, 8: 0.45, 10: 0.45}
#: Largest share of a text's word characters in lines equal to an earlier line.
LINE_LIMIT = 0.35
#: Largest number of symbol characters to a word.
SYMBOL_LIMIT = 0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, in the order of the text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[:len(hashes) - n + 1].copy()
    for i in range(1, n):
        out = tb.mix(out * _STEP + hashes[i:len(hashes) - n + 1 + i])
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run bounds[i] to bounds[i + 1]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks keys found twice or more in their text, and those that are not the first of their kind."""
    scoped = tb.mix(keys ^ (owner.astype(np.uint64) * _STEP))
    order = np.argsort(scoped, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = (scoped[order][1:] == scoped[order][:-1]) if len(keys) else []
    found, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    found[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return found, later


def _covered(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Words inside an n-gram that its text holds twice or more."""
    keys = ngram_hashes(hashes, n)
    whole = text[:len(keys)] == text[n - 1:n - 1 + len(keys)]
    found = np.zeros(len(keys), bool)
    found[whole] = _repeated(keys[whole], text[:len(keys)][whole])[0]
    change = np.zeros(len(hashes) + 1, np.int32)
    change[:len(keys)] += found
    change[n:n + len(keys)] -= found
    return np.cumsum(change[:-1]) > 0 if len(hashes) else np.zeros(0, bool)


def measure_chunk(data: np.ndarray, offsets: np.ndarray, cover_limits: dict[int, float] = COVER_LIMITS,
                  line_limit: float = LINE_LIMIT, symbol_limit: float = SYMBOL_LIMIT, min_words: int = MIN_WORDS) -> dict:
    """All figures of a run of texts, as one array each."""
    count = len(offsets) - 1
    starts, ends, text = tb.words(data, offsets)
    bounds = np.searchsorted(text, np.arange(count + 1))
    hashes = tb.mix(tb.span_ids(data, starts, ends)[0].astype(np.uint64) + np.uint64(1))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    chars = points[ends] - points[starts]
    n_words, word_chars = np.diff(bounds), _sums(chars, bounds)

    line_ends = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets[:-1], line_ends + 1]))
    cuts = cuts[cuts < len(data)]
    stops = np.minimum(np.append(cuts[1:], len(data)), len(data))
    stops = stops - ((stops > cuts) & (data[np.maximum(stops, 1) - 1] == 10)) if len(data) else stops
    line_of_text = np.searchsorted(offsets, cuts, side="right") - 1
    line_words = np.searchsorted(starts, np.append(cuts, len(data)))
    lines = np.flatnonzero(np.diff(line_words) > 0)
    line_ids = tb.span_ids(data, cuts[lines], stops[lines])[0].astype(np.uint64)
    _, later = _repeated(line_ids, line_of_text[lines])
    line_chars = _sums(chars, line_words)[lines]
    per_text = lambda x: np.bincount(line_of_text[lines], weights=x, minlength=count).astype(np.int64)
    dup_lines, dup_line_chars = per_text(later), per_text(later * line_chars)

    repeat_words = _sums(_covered(hashes, text, 3), bounds)
    share = np.maximum(word_chars, 1)
    symbols = _sums(_IS_SYMBOL[data], offsets)
    base_failed = (n_words < min_words) | (100 * repeat_words > 50 * n_words)
    fine = (dup_line_chars <= line_limit * share) & (symbols <= symbol_limit * np.maximum(n_words, 1))
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
           "base_failed": base_failed, "dup_line_share": dup_line_chars / share}
    for n, limit in cover_limits.items():
        out[f"cover_{n}"] = _sums(_covered(hashes, text, n) * chars, bounds) / share
        fine &= out[f"cover_{n}"] <= limit
    return out | {"kept": fine & ~base_failed}


def repetition(text: Column, cover_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT,
               symbol_limit: float = SYMBOL_LIMIT, min_words: int = MIN_WORDS) -> Column:
    """Struct of counts, coverage shares and the verdict ``kept`` for each whole text."""
    limits = dict(cover_limits or COVER_LIMITS)
    kinds = (["n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long", "base_failed boolean",
              "dup_line_share double"] + [f"cover_{n} double" for n in limits] + ["kept boolean"])

    def run(texts: pa.Array) -> pa.Array:
        parts = [measure_chunk(data, offsets, limits, line_limit, symbol_limit, min_words)
                 for _, _, data, offsets in tb.text_chunks(texts)]
        to = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        names, types = zip(*[k.split() for k in kinds])
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([p[n] for p in parts]) if parts else [], to[t]) for n, t in zip(names, types)], list(names))

    return F.arrow_udf(run, "struct<" + ",".join(k.replace(" ", ":").replace("long", "bigint") for k in kinds) + ">")(text)
