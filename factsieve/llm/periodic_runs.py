"""Periodic runs of words (operator 13).

A run is a stretch of consecutive words with smallest period q (words q apart are the same) that no neighbouring word extends and
that is long enough.  It is found by a sparse diagonal dynamic programme: where a word meets an earlier occurrence of itself d words back,
the match length of diagonal d grows by one; the diagonal ends where the next word differs, and if it was long enough its run goes out.

Which earlier occurrences open a diagonal is what keeps this sparse.  A run of period d holds 3 d matches in a row, so a diagonal with
2**k <= d < 2**(k + 1) is only opened by an occurrence whose last 3 * 2**k words match too.  And of those only the nearest counts: were there
a nearer one, the stretch would have a smaller period (two periods of a stretch as long as their sum share a divisor that is
a period), and its run belongs to that diagonal.  So each word opens at most one diagonal in each of log n classes, whatever the text:
a word repeated a million times costs as much as a million different ones.  The last 2**k words of a place are named by
pairs of names of half the length; a place whose words occur once only is left out of all longer names.

Everything happens inside a row, over the bytes of about 1 MB of texts (or one longer text) at once; words are compared by their
bytes, never by a hash.

Defined results: a null or empty text, or one of white space only, has no words, no run, and collapses to the empty text.  Repeated rows
get equal results.  Of equally strong runs the first by start, then the smallest period is the strongest.  An empty table gives no
rows.  Other columns are never read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.llm import textbytes as tb

#: A run has at least this many words and this many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key is found twice or more, and their numbers; equal keys have equal numbers."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[number] > 1)
    return often, number[often]


def _nearest(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Distance from each place (rising) to the nearest earlier one with the same key, 0 where there is none."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    lag = np.zeros(len(keys), np.int64)
    lag[order[1:][same]] = (places[order][1:] - places[order][:-1])[same]
    return lag


def find_runs(ids: np.ndarray, text: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and period of each run, by first word and period; ids are word numbers, text the text of each word."""
    n, out = len(ids), []
    places, numbers = _names(text * (int(ids.max()) + 1 if n else 1) + ids)
    half, width = np.full(n, -1, np.int64), 1
    half[places] = numbers
    while len(places):
        # names of twice the width: both halves must occur elsewhere and lie in one text
        back = places - width
        fits = back >= 0
        fits[fits] = (half[back[fits]] >= 0) & (text[back[fits]] == text[places[fits]])
        pair, back = places[fits], back[fits]
        often, numbers = _names(half[back] * n + half[pair])
        places = pair[often]
        full = np.full(n, -1, np.int64)
        full[places] = numbers
        # the last 3 * width words: a piece of width, then one of twice the width
        gram, before = 3 * width, places - 2 * width
        fits = before >= 0
        fits[fits] = (half[before[fits]] >= 0) & (text[before[fits]] == text[places[fits]])
        at = places[fits]
        lag = _nearest(half[before[fits]] * n + full[at], at)
        active = (lag >= width) & (lag < 2 * width)
        at, lag = at[active], lag[active]
        # a diagonal goes on while the next word is matched at the same distance
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
        starts = np.flatnonzero(first)
        period = lag[starts]
        matched = np.diff(np.append(starts, len(at))) + gram - 1
        long = (matched >= (MIN_PERIODS - 1) * period) & (matched + period >= min_words)
        out.append(np.stack([at[starts] - gram + 1 - period, matched + period, period])[:, long])
        half, width = full, 2 * width
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return tuple(found[:, np.lexsort((found[2], found[0]))])


def _strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run with the greatest length / period, compared exactly."""
    ratio = length / period
    close = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12)).tolist()
    return max(close, key=lambda i: (Fraction(int(length[i]), int(period[i])), -int(start[i]), -int(period[i])))


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, kept: np.ndarray, count: int) -> pa.Array:
    """The kept words of each text with one space between them."""
    starts, ends, text = starts[kept], ends[kept], text[kept]
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    held = tb.span_values(np.append(np.where(tb.SPACE[data], np.uint8(0x20), data), np.uint8(0x20)), starts, ends + ~last)
    places = np.frombuffer(held.buffers()[1], np.int64)
    bounds = places[np.searchsorted(text, np.arange(count + 1))]
    return pa.Array.from_buffers(pa.large_string(), count, [None, pa.py_buffer(bounds), held.buffers()[2]]).cast(pa.string())


def run_chunk(data: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS) -> pa.StructArray:
    """Runs and collapsed texts of a run of texts."""
    count = len(offsets) - 1
    starts, ends, text = tb.words(data, offsets)
    bounds = np.searchsorted(text, np.arange(count + 1))
    start, length, period = find_runs(tb.span_ids(data, starts, ends)[0], text, min_words)
    edges = np.zeros(len(text) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.subtract.at(edges, start + length, 1)
    kept = np.cumsum(edges[:-1]) == 0
    owner = text[start]
    cuts = np.searchsorted(owner, np.arange(count + 1))
    local = start - bounds[owner]
    picked = np.array([low + _strongest(local[low:high], length[low:high], period[low:high]) if high > low else -1
                       for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist())], np.int64)
    runs = pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], fields=list(_RUN))
    best = runs.take(pa.array(picked, mask=picked < 0))
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs), best,
         _collapsed(data, starts, ends, text, kept, count)], ["n_words", "runs", "strongest", "collapsed"])


def periodic_runs(text: Column, min_words: int = MIN_WORDS) -> Column:
    """Struct of n_words, runs (start, length, period in words), the strongest run, and the text with each run cut to its first period."""
    def run(texts: pa.Array) -> pa.Array:
        parts = [run_chunk(data, offsets, min_words) for _, _, data, offsets in tb.text_chunks(texts)]
        return pa.concat_arrays(parts) if parts else run_chunk(np.zeros(0, np.uint8), np.zeros(1, np.int64), min_words)

    kind = f"struct<n_words:bigint,runs:array<{_RUN_SQL}>,strongest:{_RUN_SQL},collapsed:string>"
    return F.arrow_udf(run, kind)(text)


def plant_runs(text: Column, seed: Column) -> Column:
    """The text with a periodic tail: with a = seed % n, its words from a on repeat the 1 + (n - a) / (3 + seed % 8) words that begin there.

    A null seed leaves the text as it is.
    """
    def one(value: str | None, seed: int | None) -> str | None:
        words = (value or "").encode().split()
        if seed is None or not words:
            return value
        a = seed % len(words)
        tail = len(words) - a
        period = 1 + tail // (3 + seed % 8)
        return b" ".join(words[:a] + (words[a:a + period] * (tail // period + 1))[:tail]).decode()

    def run(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        return pa.array([one(t, g) for t, g in zip(texts.to_pylist(), seeds.to_pylist())], pa.string())

    return F.arrow_udf(run, "string")(text, seed)
