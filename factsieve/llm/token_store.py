"""Token ids in shards with a minimal perfect hash index (operator 5).

Documents are dealt to tasks by ranges of their ids and sorted; each task encodes them and cuts the stream into shards of
about ``SHARD_TOKENS`` ids.  A shard is one row of the written table: the range of its keys, its index, and the raw ids as
little-endian unsigned 32-bit numbers.  The index is a minimal perfect hash of the keys (hash and displace: a small pilot for
each bucket of keys) with a stored 32-bit fingerprint, offset and length for each, so that a key is found in constant time
and a foreign key is refused.  Spark's writer commits the files, so a lost executor leaves no half shard.

A key is the document id and the number of the row among rows of the same id.  Encoding is the tokenizers library's;
white space always parts its words, so the ids of a text are those of its words: each distinct word of a chunk of texts is coded
once, in flat arrays, and a memo bounded in number and bytes keeps recent ones in each worker.

Defined results: a null or empty text has only the end id; rows of one id follow each other in the order of their texts and are
told apart by number; rows without an id come first under the null key.  Other columns are never read.  An empty table
gives an empty store.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.llm import textbytes as tb
from factsieve.llm.bpe import read_bytes
from factsieve.llm.pieces import MARKS, Memo, binary_rows, letters_then_marks, ragged
from factsieve.llm.textbytes import mix
from factsieve.plans.store import materialize, new_path

END_ID = 1
SHARD_TOKENS = 1 << 18
#: Simple words in one call of the library, and bytes of text coded together.
GROUPED, CHUNK_BYTES = 128, 4 << 20
BUCKET = 4  # keys to a pilot, on average

SCHEMA = ("shard long, first_id long, last_id long, n_docs long, n_tokens long, ids array<long>, rows array<long>, "
          "index binary, payload binary")


# ---- minimal perfect hash -------------------------------------------------------------------------------------------------

def key_hashes(ids: np.ndarray, missing: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each key (id, row number); ``missing`` marks null ids."""
    base = np.where(missing, np.uint64(0x5bd1e995), mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED27)))
    return mix(base ^ mix(rows.astype(np.uint64) * np.uint64(2) + np.uint64(1)))


def _slots(hashes: np.ndarray, pilots: np.ndarray, count: int) -> np.ndarray:
    return (mix(hashes ^ mix(pilots.astype(np.uint64) + np.uint64(0x9E37))) % np.uint64(count)).astype(np.int64)


def _bucket(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(-(-count // BUCKET))).astype(np.int64)


def build_pilots(hashes: np.ndarray) -> np.ndarray:
    """A pilot for each bucket such that all keys fall on different slots of 0 to count - 1; the hashes must differ.

    Buckets are served from the largest; the many small ones try their pilots together.
    """
    count = len(hashes)
    if not count:
        return np.zeros(0, np.uint32)
    bucket = _bucket(hashes, count)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=-(-count // BUCKET))
    begins = np.cumsum(sizes) - sizes
    taken, pilots = np.zeros(count, bool), np.zeros(len(sizes), np.uint32)
    tries = np.arange(256, dtype=np.uint32)
    for b in np.argsort(-sizes, kind="stable").tolist():
        if not sizes[b]:
            break
        own = hashes[order[begins[b]:begins[b] + sizes[b]]]
        low = np.uint32(0)
        while True:
            slots = _slots(own[None, :], (tries + low)[:, None], count)
            free = ~taken[slots].any(1)
            if len(own) > 1:
                ranked = np.sort(slots, 1)
                free &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if free.any():
                at = int(free.argmax())
                pilots[b] = tries[at] + low
                taken[slots[at]] = True
                break
            low += np.uint32(len(tries))
    return pilots


def build_index(hashes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    """Index block: key count, pilot count, pilots, then fingerprint, offset and length of each slot."""
    count = len(hashes)
    pilots = build_pilots(hashes)
    entries = np.zeros((count, 3), np.uint32)
    if count:
        slots = _slots(hashes, pilots[_bucket(hashes, count)], count)
        entries[slots] = np.stack([hashes.astype(np.uint32), offsets.astype(np.uint32), lengths.astype(np.uint32)], 1)
    return np.array([count, len(pilots)], np.uint32).tobytes() + pilots.tobytes() + entries.tobytes()


class Shard:
    """Keyed access to one shard's ids."""

    def __init__(self, index: bytes, payload: bytes) -> None:
        self.count, pilots = np.frombuffer(index, np.uint32, 2).tolist()
        self.pilots = np.frombuffer(index, np.uint32, pilots, 8)
        self.entries = np.frombuffer(index, np.uint32, self.count * 3, 8 + 4 * pilots).reshape(-1, 3)
        self.payload = payload

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows (offset, length) of the keys, -1 for a key whose fingerprint is not the stored one."""
        if not self.count:
            return np.full((len(hashes), 2), -1, np.int64)
        slots = _slots(hashes, self.pilots[_bucket(hashes, self.count)], self.count)
        found = self.entries[slots].astype(np.int64)
        return np.where((found[:, 0] == (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64))[:, None], found[:, 1:], -1)

    def get(self, doc_id: int | None, row: int = 0) -> np.ndarray | None:
        """Ids of one document, end id included, or None if its key is not in the shard."""
        at, length = self.find(key_hashes(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([row])))[0].tolist()
        return None if at < 0 else np.frombuffer(self.payload, np.uint32, length, at * 4)


# ---- encoding -------------------------------------------------------------------------------------------------------------

class WordEncoder:
    """The library's ids of texts, by way of their words."""

    def __init__(self, file: bytes) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file.decode())
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo = Memo(self.code)

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def code(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and their numbers. Many simple words go in one call: each piece ends with the one id that carries the word end."""
        data, low, plain, split = letters_then_marks(words)
        strings = words.cast(pa.large_string()).to_pylist()
        kinds = np.where(plain, 1 + (split < low[1:]), 0)  # pieces of a simple word
        # a letter may turn into a letter and a mark, which would join the marks after it
        high = np.concatenate([[0], np.cumsum(data >= 0x80)])
        for i in np.flatnonzero(plain & (high[low[1:]] > high[low[:-1]])).tolist():
            if not unicodedata.normalize("NFC", strings[i].rstrip(MARKS)).lower().isalpha():
                kinds[i] = 0
        simple, odd = np.flatnonzero(kinds), np.flatnonzero(kinds == 0).tolist()
        groups = [simple[i:i + GROUPED] for i in range(0, len(simple), GROUPED)]
        lengths, parts, order = np.zeros(len(strings), np.int64), [np.zeros(0, np.uint32)], []
        for group, ids in zip(groups, self._ask([" ".join([strings[i] for i in g]) for g in groups])):
            stops = np.flatnonzero(self.ends[ids]) + 1
            pieces = np.cumsum(kinds[group])
            if len(stops) == pieces[-1]:
                lengths[group] = np.diff(stops[pieces - 1], prepend=0)
                parts.append(ids)
                order.append(group)
            else:
                odd += group.tolist()
        if odd:
            coded = self._ask([strings[i] for i in odd])
            lengths[odd] = [len(c) for c in coded]
            parts += coded
            order.append(np.array(odd))
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        begin = np.zeros(len(strings), np.int64)
        begin[order] = np.cumsum(lengths[order]) - lengths[order]
        return ragged(np.concatenate(parts), begin, lengths), lengths

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as little-endian unsigned 32-bit numbers.

        Words are cut at ASCII white space; other white space stands inside a word, which then goes to the library as it is.
        """
        out = [pa.array([], pa.large_binary())]
        for _, _, data, offsets in tb.text_chunks(texts, CHUNK_BYTES):
            starts, ends, text = tb.words(data, offsets)
            out.append(binary_rows(*self.memo.ids(tb.span_values(data, starts, ends), np.searchsorted(text, np.arange(len(offsets))))))
        return pa.concat_arrays(out)


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(file: bytes) -> WordEncoder:
    key = zlib.crc32(file)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(file)
    return _ENCODERS[key]


# ---- writing and reading --------------------------------------------------------------------------------------------------

def _shard_row(number: int, ids: list, rows: list, parts: list[bytes]) -> pa.RecordBatch:
    lengths = np.array([len(p) // 4 for p in parts], np.int64)
    offsets = np.cumsum(lengths) - lengths
    missing = np.array([i is None for i in ids])
    hashes = key_hashes(np.array([i or 0 for i in ids], np.int64), missing, np.array(rows, np.int64))
    real = [i for i in ids if i is not None]
    values = [number, real[0] if real else None, real[-1] if real else None, len(ids), int(lengths.sum()), ids, rows,
              build_index(hashes, offsets, lengths), b"".join(parts)]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def _write(shared, end_id: int, shard_tokens: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(shared.value), TaskContext.get().partitionId() << 32
        ids, rows, parts, tokens, last, row = [], [], [], 0, (), 0
        for batch in batches:
            coded = encoder.encode(batch.column(1))
            for doc_id, code in zip(batch.column(0).to_pylist(), coded):
                row = row + 1 if last == (doc_id,) else 0
                last = (doc_id,)
                ids.append(doc_id)
                rows.append(row)
                parts.append(code.as_py() + end)
                tokens += len(parts[-1]) // 4
                if tokens >= shard_tokens:
                    yield _shard_row(number, ids, rows, parts)
                    number, ids, rows, parts, tokens = number + 1, [], [], [], 0
        if ids:
            yield _shard_row(number, ids, rows, parts)

    return run


def write_store(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
                shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes all documents and writes the shards to ``path``, a folder that all executors share."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_bytes(spark, tokenizer_path))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    (rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(_write(shared, end_id, shard_tokens), SCHEMA)
     .write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Ids of the named documents (first rows of their ids); only shards whose range holds one are read."""
    wanted = None
    for i in doc_ids:
        here = (F.col("first_id") <= i) & (F.col("last_id") >= i)
        wanted = here if wanted is None else wanted | here
    out: dict[int, np.ndarray] = {}
    if wanted is not None:
        for r in read_store(spark, path).where(wanted).select("index", "payload").toLocalIterator():
            shard = Shard(bytes(r["index"]), bytes(r["payload"]))
            out |= {i: ids for i in doc_ids if (ids := shard.get(i)) is not None}
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "position", "id", "row", "offset", "n_tokens", "crc"]
    for batch in batches:
        for number, ids, rows, index, payload in zip(*[batch.column(i) for i in range(5)]):
            shard = Shard(index.as_buffer(), payload.as_buffer())
            listed = ids.values
            missing = np.asarray(listed.is_null())
            found = shard.find(key_hashes(np.asarray(listed.fill_null(0)), missing, np.asarray(rows.values)))
            if (found < 0).any():
                raise ValueError("a shard does not hold one of its own keys")
            view = memoryview(shard.payload)
            crc = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in found.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(crc), number.as_py())), pa.array(np.arange(len(crc))), listed, rows.values,
                 pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(crc, pa.int64())], names)


def store_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the store, found by its key: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    store = read_store(spark, path)
    # one narrow row a shard: the ids of all shards before it
    before = materialize(store.select("shard", "n_tokens").withColumn(
        "before", F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("shard").alias("of"), "before"), "starts")
    rows = store.select("shard", "ids", "rows", "index", "payload").mapInArrow(
        _digests, "shard long, position long, id long, row long, offset long, n_tokens long, crc long")
    return rows.join(before, F.col("shard") == F.col("of")).select(
        F.col("id").alias(id_col), (F.col("before") + F.col("offset")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def encode_store(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes a store (to a new folder unless ``path`` is given) and returns what reading it back gives."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_store(docs, tokenizer_path, path, id_col, text_col)
    return store_digests(docs.sparkSession, path, id_col)
