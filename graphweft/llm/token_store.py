"""Token-id files: concatenated ids per shard, with document boundaries in Elias-Fano code.

A store is a folder of Parquet files written by Spark's own committer, so that lost executors and retried tasks
leave no torn files, on any file system that Spark reaches. A record is a block of one shard:

    shard, block     place of the block; shards follow the ids' order, blocks too
    n_null, first    documents without an id, which come first, and the least id of the others
    id_*             ascending ids less the least, in Elias-Fano code of the same parts
    n_docs           documents of the block
    before, n_tokens ids of the shard before the block, and in it
    low_bits         bits of each boundary that are stored as they are
    low, high        those bits packed; the rest of each boundary in unary, as a bit vector
    samples          little-endian 32-bit places of every 256th one bit of `high`
    width, ids       bytes in an id (2 or 4), and the little-endian ids

Boundaries are the n + 1 offsets of the documents in the block's ids: about 2 + log2(ids / documents) bits each.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.llm.bpe import byte_symbols
from graphweft.llm.common import bounded_batches, scratch, table, text_blocks
from graphweft.llm.vocab import TwoGenerations, vocab_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Entries that each generation of a worker's caches holds.
CACHED = 400_000
#: Bytes of text in a block of the store.
STORED_BYTES = 8 << 20
#: One bits between sampled places.
SAMPLE = 256

_SCHEMA = "shard int, block int, n_docs int, n_null int, first long, id_low_bits int, id_low binary, id_high binary, id_samples binary, before long, n_tokens long, low_bits int, low binary, high binary, samples binary, width int, ids binary"


class EliasFano:
    """A non-decreasing sequence of whole numbers, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        bits = min(63, max(0, (universe // max(n, 1)).bit_length() - 1))
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes() if bits else b""
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, which: np.ndarray | int) -> np.ndarray:
        """The values at these places: jump to the sampled one bit before each, and count on from there."""
        which = np.atleast_1d(np.asarray(which, np.int64))
        if len(which) and not (0 <= which.min() and which.max() < self.n):
            raise IndexError(which)
        if not len(which):
            return np.zeros(0, np.uint64)
        padded = np.frombuffer(self.high + bytes(8 - len(self.high) % 8), "<u8")
        start = np.frombuffer(self.samples, "<u4").astype(np.int64)[which // SAMPLE]
        left, at = which % SAMPLE, start >> 6
        word = padded[at] >> (start & 63).astype(np.uint64) << (start & 63).astype(np.uint64)
        ones = np.bitwise_count(word).astype(np.int64)
        behind = np.flatnonzero(left >= ones)
        while len(behind):
            left[behind] -= ones[behind]
            at[behind] += 1
            word[behind] = padded[at[behind]]
            ones[behind] = np.bitwise_count(word[behind])
            behind = behind[left[behind] >= ones[behind]]
        place = np.zeros(len(which), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << half) - 1)
            lower = np.bitwise_count(word >> place.astype(np.uint64) & mask).astype(np.int64)
            up = left >= lower
            left, place = np.where(up, left - lower, left), np.where(up, place + half, place)
        upper = ((at << 6) + place - which).astype(np.uint64)
        if not self.low_bits:
            return upper
        bit = which * self.low_bits
        low = np.frombuffer(self.low + bytes(16), np.uint8)
        span = np.lib.stride_tricks.sliding_window_view(low, 9)[bit >> 3]
        shift = (bit & 7).astype(np.uint64)
        pieces = np.ascontiguousarray(span[:, :8]).view("<u8").ravel() >> shift
        pieces = np.where(shift > 0, pieces | span[:, 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), pieces)
        return upper << np.uint64(self.low_bits) | pieces & np.uint64((1 << self.low_bits) - 1)


def plain(text: str) -> bool:
    """Whether all characters are among the first 256."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Encodes with the tokenizers library's model, each distinct word once while it stays cached.

    Words are those of the byte-level pre-tokenizer's pattern; a text with a special token goes to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = regex.compile(PATTERN).findall
        # the same for texts of the first 256 characters, where the classes are short lists
        letters, digits, spaces = (re.escape("".join(c for c in map(chr, range(256)) if test(c))) for test in (lambda c: category(c)[0] == "L", lambda c: category(c)[0] == "N", lambda c: c in " \t\n\x0b\x0c\r\x85\xa0"))
        plain = {r"[^\s\p{L}\p{N}]": f"[^{spaces}{letters}{digits}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{digits}]", r"\s": f"[{spaces}]", r"\S": f"[^{spaces}]"}
        self.plain_words = re.compile(reduce(lambda x, kv: x.replace(*kv), plain.items(), PATTERN)).findall
        self.symbols = str.maketrans(dict(enumerate(byte_symbols())))
        self.cache = TwoGenerations(CACHED)

    def modelled(self, words: list[str]) -> list[bytes]:
        """Ids of words, as bytes: one call for all, whose tokens tell which word they come from."""
        if not words:
            return []
        mapped = [w.encode().decode("latin1").translate(self.symbols) for w in words]
        found = self.model.encode_batch([mapped], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(found.ids, self.dtype).tobytes()
        ends = np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))) * self.dtype.itemsize
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [(self.plain_words if plain(t) else self.words)(t) for t in texts]
        ids = self.cache.resolve(set(chain.from_iterable(cut)), self.modelled).__getitem__
        out = [b"".join(map(ids, c)) for c in cut]
        for k, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype).tobytes()
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> WordEncoder:
    return WordEncoder(vocab_path(path))


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append `end_id`, and write the ids in ascending order of the documents' ids.

    Range partitions make the shards. Null and empty texts hold the end id alone. Rows without an id come first.
    Rows that repeat an id lie side by side, in the order of their texts. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 2500)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = loaded(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        before = 0
        for block, rows in enumerate(text_blocks(batches, "text", STORED_BYTES)):
            ids = [x + end for x in encoder.encode(rows.column("text").to_pylist())]
            bounds = np.cumsum([0, *map(len, ids)]) // encoder.dtype.itemsize
            ef = EliasFano.encode(bounds)
            known = rows.column("doc_id").drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            least = int(known[0]) if len(known) else 0
            named = EliasFano.encode(known.view(np.uint64) - np.uint64(least % (1 << 64)))
            record = {"shard": shard, "block": block, "n_docs": rows.num_rows, "n_null": rows.num_rows - len(known), "first": least, "id_low_bits": named.low_bits, "id_low": named.low, "id_high": named.high, "id_samples": named.samples, "before": before, "n_tokens": int(bounds[-1]), "low_bits": ef.low_bits, "low": ef.low, "high": ef.high, "samples": ef.samples, "width": encoder.dtype.itemsize, "ids": b"".join(ids)}
            kinds = {"shard": pa.int32(), "block": pa.int32(), "n_docs": pa.int32(), "n_null": pa.int32(), "first": pa.int64(), "id_low_bits": pa.int32(), "before": pa.int64(), "n_tokens": pa.int64(), "low_bits": pa.int32(), "width": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in record.items()], list(record))
            before += int(bounds[-1])

    ordered.mapInArrow(encode, _SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of a store: doc_id, start, n_tokens, ids_crc32, and ids unless told otherwise.

    Starts come from the shards' lengths (one row a shard, as many as the writer's partitions), the blocks' places in
    their shards, and the boundaries in each block's Elias-Fano code.
    """
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    # bounded: one row for each partition that wrote
    placed = blocks.join(F.broadcast(before), "shard").withColumn("block_start", F.col("before") + F.col("shard_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                n, none = r["n_docs"], r["n_null"]
                bounds = EliasFano(n + 1, r["low_bits"], r["low"], r["high"], r["samples"]).select(np.arange(n + 1)).astype(np.int64)
                known = EliasFano(n - none, r["id_low_bits"], r["id_low"], r["id_high"], r["id_samples"]).select(np.arange(n - none))
                names = pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array((known + np.uint64(r["first"] % (1 << 64))).view(np.int64))])
                ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                arrays = [names, pa.array(bounds[:-1] + r["block_start"], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())]
                columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                    columns.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_tokens(spark, path, with_ids=False)
