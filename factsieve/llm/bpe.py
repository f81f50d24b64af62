"""Byte-level BPE encoding and decoding over a lexicon automaton (operator 7).

Frequent words of the corpus are compiled with their ids into a minimal acyclic automaton: words share prefixes and suffixes, the
sum of the skips along a word's arcs is its number, and the number points at its ids.  The automaton is a few flat arrays in
one block of bytes, broadcast (its size is bounded by ``lexicon_words``) and memory-mapped in each Python worker.
Words outside it are merged exactly, many at once in numpy; a word longer than ``LONG`` bytes with a heap.

A text is cut at its special tokens, at white space, and then into words as the tokenizer does.  Each distinct piece of a chunk
of texts is coded once, in flat arrays, and a memo bounded in number and bytes keeps the ids of recent pieces in each worker.

Defined results: a null text counts as empty and has no ids; text of a special token gives that token's id.  Repeated
rows get equal results.  Other columns are never read.  An empty table gives no rows and an empty lexicon.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm import textbytes as tb
from factsieve.llm.pieces import MARKS, Memo, binary_rows, flat, letters_then_marks, ragged
from factsieve.plans.store import materialize

LEXICON_WORDS = 131_072
#: A word of the lexicon occurs this often at least.
MIN_COUNT = 8
#: Bound of the words counted in a task before they are handed on.
COUNTED = 200_000
LONG = 48
#: Texts coded together.
CHUNK_BYTES = 4 << 20

# Fixed values of the tokenizer: white space, and the pattern that cuts text before merging.
_WHITE = "\t-\r \x85\xa0  -     　"
_PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
# Pieces that the pattern cuts further but never joins: white space parts them.
_PIECE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
# The white space beyond ASCII, in UTF-8.
_ODD_WHITE = b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tables:
    """Vocabulary and merges of a byte-level tokenizer file as arrays."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        vocab, merges, letters = spec["model"]["vocab"], spec["model"]["merges"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text = [b""] * size
        for token, i in vocab.items():
            self.text[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.text[i] = token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        bits = max(8, int(len(keys) * 16).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.ranks = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._home(keys).tolist())):
            while self.slots[at] not in (-1, key):
                at = (at + 1) & self.mask
            if self.slots[at] == -1:  # the first rule of a pair holds
                self.slots[at], self.ranks[at] = key, rank
        self.none = len(keys)
        self.lengths = np.array([len(t) for t in self.text], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; ``none`` where no rule merges it or either is negative."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, self.none, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._home(keys.ravel()[todo])
        wanted, flat = keys.ravel()[todo], out.ravel()
        while len(todo):
            found = self.slots[at]
            hit = found == wanted
            flat[todo[hit]] = self.ranks[at[hit]]
            go = ~hit & (found != -1)
            todo, wanted, at = todo[go], wanted[go], (at[go] + 1) & self.mask
        return flat.reshape(keys.shape)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word by a heap over its neighbours; the time is near linear in its length."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        arr = np.array(ids)
        ranks = self.rank(arr[:-1], arr[1:]).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < self.none]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                pair = (ids[i], ids[j])
                if pair not in known:
                    known[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
                if known[pair] < self.none:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return np.array([x for x in ids if x >= 0], np.uint32)

    def merge(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words flat[start:start + size] one after the other and their numbers, merged exactly: the lowest rank first,
        the leftmost of equal ones."""
        counts, parts, rows_of = np.zeros(len(sizes), np.int64), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(sizes > LONG).tolist():
            parts.append(self.merge_long(flat[starts[i]:starts[i] + sizes[i]].tobytes()))
            rows_of.append(np.array([i]))
            counts[i] = len(parts[-1])
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes[order] <= LONG) & (sizes[order] > 0)]
        for low in range(0, len(order), 4096):
            picked = order[low:low + 4096]
            width = int(sizes[picked[-1]])
            ids = np.full((len(picked), width + 1), -1, np.int32)
            inside = np.arange(width + 1) < sizes[picked][:, None]
            ids[inside] = self.of_byte[ragged(flat, starts[picked], sizes[picked])]
            ranks = np.full((len(picked), width + 1), self.none, np.int32)
            ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
            rows, places = np.arange(len(picked)), np.arange(width + 1)
            while len(rows):
                at = ranks.argmin(1)
                here = np.arange(len(rows))
                best = ranks[here, at]
                done = best == self.none
                if done.any():
                    ended = ids[done]
                    parts.append(ended[ended >= 0].astype(np.uint32))
                    rows_of.append(picked[rows[done]])
                    counts[rows_of[-1]] = (ended >= 0).sum(1)
                    go = ~done
                    ids, ranks, rows, at, best = ids[go], ranks[go], rows[go], at[go], best[go]
                    here = np.arange(len(rows))
                if not len(rows):
                    break
                ids[here, at] = self.merged[best]
                source = np.minimum(places + (places > at[:, None]), width)
                gone = (places == width) & (at[:, None] < width)
                ids = np.where(gone, -1, np.take_along_axis(ids, source, 1))
                ranks = np.where(gone, self.none, np.take_along_axis(ranks, source, 1))
                ranks[here, at] = self.rank(ids[here, at], ids[here, np.minimum(at + 1, width)])
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
        done_order = np.concatenate(rows_of)
        begin = np.zeros(len(sizes), np.int64)
        begin[done_order] = np.cumsum(counts[done_order]) - counts[done_order]
        return ragged(np.concatenate(parts), begin, counts), counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids one after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()


def compile_lexicon(words: dict[bytes, bytes]) -> bytes:
    """The words with their ids as a minimal acyclic automaton in one block of bytes.

    Words are added in order; a state that no later word can change is replaced by an equal one already kept, so that equal
    suffixes are stored once.  Block: four counts, then arc keys (state << 8 | byte), arc targets, arc skips, final marks, id bounds, ids.
    """
    kept: dict[tuple, int] = {}
    states: list[tuple] = []

    def keep(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in kept:
            kept[key] = len(states)
            states.append(key)
        return kept[key]

    open_path: list[list] = [[False, []]]  # of the last word: final mark and closed arcs; the open arc's byte follows
    last = b""
    for word in sorted(words):
        same = len(os.path.commonprefix([word, last]))
        while len(open_path) > same + 1:
            final, arcs = open_path.pop()
            open_path[-1][1].append((last[len(open_path) - 1], keep(final, arcs)))
        open_path += [[False, []] for _ in range(len(word) - same)]
        open_path[-1][0] = True
        last = word
    while len(open_path) > 1:
        final, arcs = open_path.pop()
        open_path[-1][1].append((last[len(open_path) - 1], keep(final, arcs)))
    root = keep(*open_path[0])
    below = [0] * len(states)  # words readable from a state; targets are kept before their sources
    keys, targets, skips = [], [], []
    for s, (final, arcs) in enumerate(states):
        count = int(final)
        for byte, to in arcs:
            keys.append(s << 8 | byte)
            targets.append(to)
            skips.append(count)
            count += below[to]
        below[s] = count
    rows = [words[w] for w in sorted(words)]
    bounds = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)]).astype(np.int64)
    parts = [np.array([len(keys), len(states), len(rows), root], np.int64), np.array(keys, np.int64), np.array(targets, np.int64),
             np.array(skips, np.int64), np.array([s[0] for s in states], np.int64), bounds]
    return b"".join([p.tobytes() for p in parts] + rows)


class Lexicon:
    """Reads a compiled lexicon from a memory map."""

    def __init__(self, block: bytes) -> None:
        self.map = mmap.mmap(-1, max(len(block), 1))
        self.map.write(block)
        arcs, states, rows, self.root = np.frombuffer(self.map, np.int64, 4).tolist()
        sizes, at = [arcs, arcs, arcs, states, rows + 1], 32
        views = []
        for n in sizes:
            views.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        self.keys, self.targets, self.skips, self.final, self.bounds = views
        self.ids = np.frombuffer(self.map, np.uint32, int(self.bounds[-1]), at)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where it is not in the lexicon."""
        sizes = np.array([len(w) for w in words], np.int64)
        return self.walk(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def walk(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is not in the lexicon; all words walk the automaton together."""
        number = np.zeros(len(sizes), np.int64)
        state = np.full(len(sizes), self.root, np.int64)
        alive = np.flatnonzero(sizes > 0)
        dead = np.ones(len(sizes), bool)
        step = 0
        while len(alive) and len(self.keys):
            key = state[alive] << 8 | flat[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            number[alive] += self.skips[at]
            state[alive] = self.targets[at]
            step += 1
            ended = sizes[alive] == step
            dead[alive[ended]] = self.final[state[alive[ended]]] == 0
            alive = alive[~ended]
        number[dead] = -1
        return number


class Encoder:
    """Encodes texts of a worker; keeps the ids of recent pieces."""

    def __init__(self, file: bytes, block: bytes) -> None:
        self.tables, self.lexicon = Tables(file), Lexicon(block)
        self.memo = Memo(self.code)
        names = sorted(self.tables.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.odd = re.compile(b"|".join([_ODD_WHITE, *(re.escape(n.encode()) for n in names)]))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of the pattern and their numbers: from the lexicon, or merged."""
        data, bounds = flat(words)
        sizes = np.diff(bounds)
        number = self.lexicon.walk(data, bounds[:-1], sizes)
        new = np.flatnonzero(number < 0)
        merged, counts = self.tables.merge(data, bounds[:-1][new], sizes[new])
        known = np.maximum(number, 0)
        starts, lengths = self.lexicon.bounds[known].copy(), self.lexicon.bounds[np.minimum(known + 1, len(self.lexicon.bounds) - 1)].copy()
        lengths -= starts
        starts[new], lengths[new] = len(self.lexicon.ids) + np.cumsum(counts) - counts, counts
        return ragged(np.concatenate([self.lexicon.ids, merged]), starts, lengths), lengths

    def code(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and their numbers. Letters and then marks are two words, wherever they stand; other pieces are cut by the pattern."""
        data, low, simple, split = letters_then_marks(pieces, blank=True)
        counts = np.ones(len(pieces), np.int64)
        counts[simple] = 1 + (split[simple] < low[1:][simple])
        odd = np.flatnonzero(~simple)
        cut = [_PRETOKEN.findall(p.decode()) for p in pieces.take(pa.array(odd)).to_pylist()]
        counts[odd] = [len(c) for c in cut]
        begin = np.cumsum(counts) - counts
        # all words: those of simple pieces from the bytes, the others as cut
        two = np.flatnonzero(simple & (counts == 2))
        one = np.flatnonzero(simple)
        starts, ends = np.concatenate([low[one], split[two]]), np.concatenate([split[one], low[two + 1]])
        sizes = ends - starts
        parts = pa.concat_arrays([binary_rows(ragged(data, starts, sizes), np.concatenate([[0], np.cumsum(sizes)])),
                                  pa.array([w.encode() for c in cut for w in c], pa.large_binary())])
        slot = np.concatenate([begin[one], begin[two] + 1, ragged(np.arange(int(counts.sum())), begin[odd], counts[odd])])
        coded = parts.dictionary_encode()
        pool, lengths = self.words(coded.dictionary)
        word = np.zeros(int(counts.sum()), np.int64)
        word[slot] = coded.indices.to_numpy(zero_copy_only=False)
        first_id = np.cumsum(lengths) - lengths
        totals = np.concatenate([[0], np.cumsum(lengths[word])])
        return ragged(pool, first_id[word], lengths[word]), totals[begin + counts] - totals[begin]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out = [pa.array([], pa.large_binary())]
        for _, _, data, offsets in tb.text_chunks(texts, CHUNK_BYTES):
            cuts = self._cuts(data, offsets)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
            bounds = np.searchsorted(cuts, offsets)
            # texts with special tokens or rare white space are cut one by one
            found = np.fromiter((m.start() for m in self.odd.finditer(data)), np.int64)
            odd = np.unique(np.searchsorted(offsets, found, side="right") - 1).tolist()
            if not odd:
                out.append(binary_rows(*self.memo.ids(pieces, bounds)))
                continue
            stretches, more = {}, []
            for i in odd:
                stretches[i] = []
                for part in self._parts(data[offsets[i]:offsets[i + 1]].tobytes().decode()):
                    if isinstance(part, list):
                        stretches[i].append((len(cuts) - 1 + len(more), len(part)))
                        more += part
                    else:
                        stretches[i].append((None, part))
            ids, at = self.memo.ids(pa.concat_arrays([pieces, pa.array(more, pa.large_binary())]), np.arange(len(cuts) + len(more)))
            starts, lengths, ends = [], [], [0]
            for i, (low, high) in enumerate(zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist())):
                for first, n in stretches.get(i, [(low, high)]):
                    if first is None:  # special tokens stand behind all other ids
                        starts.append(len(ids) + n)
                        lengths.append(1)
                    else:
                        a, b = (first, n) if i not in stretches else (at[first], at[first + n])
                        starts.append(int(a))
                        lengths.append(int(b - a))
                ends.append(len(lengths))
            sizes = np.array(lengths, np.int64)
            whole = np.concatenate([[0], np.cumsum(sizes)])
            values = ragged(np.concatenate([ids, np.array(list(self.tables.special.values()), np.uint32)]), np.array(starts, np.int64), sizes)
            out.append(binary_rows(values, whole[ends]))
        return pa.concat_arrays(out)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bounds of the pieces of texts whose white space is ASCII: a word takes a blank before it along, the rest of the white space
        and its last character are pieces."""
        starts, ends, text = tb.words(data, offsets)
        before = np.maximum(starts - 1, 0)
        led = (starts > offsets[text]) & tb.SPACE[data[before]]
        # the last white space before a word parts from the rest, as part of the word if it is a blank
        marked = np.zeros(len(data) + 1, bool)
        for cuts in (offsets, starts[~led], starts[led] - 1, starts[led][data[before[led]] != 0x20], ends):
            marked[cuts] = True
        return np.flatnonzero(marked)

    def _parts(self, text: str) -> list:
        """Lists of pieces, and between them the places of special tokens."""
        names = list(self.tables.special)
        parts = self.cut.split(text) if self.cut else [text]
        return [names.index(x) if i % 2 else [p.encode() for p in _PIECE.findall(x)] for i, x in enumerate(parts)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    key, file, block = shared.value
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(file, block)
    return _ENCODERS[key]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        total: Counter = Counter()
        for piece, n in seen.items():
            word = piece.rstrip(MARKS)
            if word.isalpha():
                total[" " + word] += n
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            seen.update((text.as_py() or "").split())
            if len(seen) > COUNTED:
                yield rows()
    yield rows()


def frequent_words(docs: DataFrame, text_col: str = "text", count: int = LEXICON_WORDS, min_count: int = MIN_COUNT) -> list[str]:
    """Words of letters of all texts with a leading blank, by falling count: as many whole ranks as ``count`` holds.

    A threshold is read off the numbers of words of each count, so no task hands more than the answer to the driver.
    """
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "word string, n long")
    often = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "words")
    # counts in steps of a sixteenth of a power of two, so that their table is small
    step = F.floor(F.log2("n") * 16)
    ranks = often.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in ranks:
        total += r.words
        if total > count:
            break
        least = r.step
    if least is None:
        return []
    return [r.word for r in often.where(step >= least).orderBy(F.desc("n"), "word").select("word").collect()]


def read_bytes(spark, path: str) -> bytes:
    """A vocabulary file: from the installed package on the driver, or by Spark's reader if the path is a URL."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    with open(path, "rb") as f:
        return f.read()


def prepare(docs: DataFrame, tokenizer_path: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS):
    """Counts the corpus, compiles its lexicon and broadcasts it with the tokenizer file."""
    spark = docs.sparkSession
    file = read_bytes(spark, tokenizer_path)
    tables = Tables(file)
    words = [w.encode() for w in frequent_words(docs, text_col, lexicon_words)]
    sizes = np.array([len(w) for w in words], np.int64)
    ids, counts = tables.merge(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
    stops = np.cumsum(counts)
    block = compile_lexicon({w: ids[b - n:b].tobytes() for w, b, n in zip(words, stops.tolist(), counts.tolist())})
    return spark.sparkContext.broadcast((hashlib.sha256(file + block).hexdigest(), file, block))


def encode(shared, text: Column) -> Column:
    """Ids of a text as little-endian unsigned 32-bit numbers in one binary value."""

    def run(texts: pa.Array) -> pa.Array:
        return _encoder(shared).encode(texts).cast(pa.binary())

    return F.arrow_udf(run, "binary")(text)


def decode(shared, ids: Column) -> Column:
    """Text of the ids; bytes that are no UTF-8 become U+FFFD."""

    def run(rows: pa.Array) -> pa.Array:
        tables = _encoder(shared).tables
        return pa.array([tables.decode(np.frombuffer(r.as_buffer(), np.uint32)).decode("utf-8", "replace") for r in rows], pa.string())

    return F.arrow_udf(run, "string")(ids)


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
               lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Per row of ``docs``: id, ids as binary, the decoded text."""
    shared = prepare(docs, tokenizer_path, text_col, lexicon_words)
    coded = docs.select(F.col(id_col).alias(id_col), encode(shared, F.col(text_col)).alias("ids"))
    return coded.select(id_col, "ids", decode(shared, F.col("ids")).alias("decoded"))
