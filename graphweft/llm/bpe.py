"""BPE encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.common import bounded_batches, table, text_blocks
from graphweft.llm.vocab import TwoGenerations, vocab_path

VOCABULARY = "word_bpe_49k.json"
#: Distinct words that each generation of a worker's cache holds.
CACHED_WORDS = 250_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return out


def ascii_pattern(split: str) -> str:
    """What a vocabulary's pattern means on ASCII text, for the faster standard module."""
    for name, letters in ((r"\p{L}", "a-zA-Z"), (r"\p{N}", "0-9"), (r"\s", r" \t-\r")):
        split = split.replace(name, letters)
    return split


class WordBPE:
    """Encoder and decoder for a word-level BPE vocabulary file (word ends marked, lower case, white space dropped)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = self.suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + suffix] for s in symbols]
        self.bits = max(self.vocab.values()).bit_length()
        #: (left id << bits | right id) -> rank << bits | merged id
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.vocab[a] << self.bits | self.vocab[b], rank << self.bits | self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.decimal = [str(i) for i in range(max([*self.vocab.values(), *self.special.values()]) + 1)]
        self.texts = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.any_words = regex.compile(split).findall
        self.ascii_words = re.compile(ascii_pattern(split)).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        #: a text without it has no special token
        self.hint = commonprefix(list(self.special))
        self.cache = TwoGenerations(CACHED_WORDS)

    def merge(self, word: bytes) -> list[int]:
        """Apply the lowest-ranked merge again and again, leftmost first.

        The queue holds rank, merged id and place of a pair in one integer (a rank has one id, so equals go by place).
        An entry is stale, and skipped, when the symbol at its place has gone or no longer forms that pair with its
        right neighbour.
        """
        inner, get, bits = self.inner, self.merges.get, self.bits
        n = len(word)
        ids = [inner[b] for b in word]
        ids[-1] = self.final[word[-1]]
        if n == 1:
            return ids
        mask = (1 << bits) - 1
        place = n.bit_length()
        at = (1 << place) - 1
        queue = []
        a = ids[0]
        for i in range(n - 1):
            b = ids[i + 1]
            m = get(a << bits | b)
            if m is not None:
                queue.append(m << place | i)
            a = b
        if not queue:
            return ids
        heapify(queue)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            top = heappop(queue)
            i = top & at
            a = ids[i]
            if a < 0 or (j := right[i]) >= n:
                continue
            m = top >> place
            if get(a << bits | ids[j]) != m:
                continue
            ids[i] = new = m & mask
            ids[j] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                m = get(new << bits | ids[k])
                if m is not None:
                    heappush(queue, m << place | i)
            h = left[i]
            if h >= 0:
                m = get(ids[h] << bits | new)
                if m is not None:
                    heappush(queue, m << place | h)
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str]:
        return self.ascii_words(text) if text.isascii() else self.any_words(text)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # each character by itself: no final sigma
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def has_special(self, text: str) -> bool:
        return self.specials is not None and self.hint in text and any(s in text for s in self.special)

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Words in order, and whether each is a special token."""
        if not self.has_special(text):
            for w in self.words(self.normal(text)):
                yield w, False
            return
        for k, part in enumerate(self.specials(text)):
            if k % 2:
                yield part, True
            else:
                for w in self.words(self.normal(part)):
                    yield w, False

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word, special in self.pieces(text):
            out += [self.special[word]] if special else self.merge(word.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, put together with one space between tokens, as this vocabulary's files ask for."""
        return " ".join(self.texts[i] for i in ids)

    def word_forms(self, word: str, special: bool) -> tuple[int, str, str]:
        """Tokens of a word, their ids in decimal and their strings, each joined by one space."""
        ids = [self.special[word]] if special else self.merge(word.encode())
        return len(ids), " ".join([self.decimal[i] for i in ids]), self.decode(ids)

    def forms(self, text: str) -> tuple[int, str, str]:
        """Token count, decimal ids and decoded text; each distinct word is merged once while it stays cached."""
        cache = self.cache
        young, fetch = cache.young, cache.fetch
        if self.has_special(text):
            found = [self.word_forms(w, s) for w, s in self.pieces(text)]
        else:
            found = []
            for w in self.words(self.normal(text)):
                f = young.get(w)
                if f is None:
                    f = fetch(w)
                    if f is None:
                        f = self.word_forms(w, False)
                        cache.put(w, f)
                    young = cache.young
                found.append(f)
        return sum(f[0] for f in found), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBPE:
    """One per worker process."""
    return WordBPE(vocab_path(path))


def bpe_digests(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with n_tokens, ids_sha256 and decoded_sha256 (these replace columns of those names).

    A null or empty text has no tokens; its digests are those of the empty string. Rows are taken one by one:
    order, ties and repeats change nothing, and an empty table stays empty.
    """
    return _mapped(docs, vocabulary, text_col, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, _digests)


def bpe_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with ids (array of int) and decoded (string); nulls and empty texts as in bpe_digests()."""
    return _mapped(docs, vocabulary, text_col, {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}, _tokens)


def _digests(bpe: WordBPE, text: str) -> tuple:
    n, ids, decoded = bpe.forms(text)
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _tokens(bpe: WordBPE, text: str) -> tuple:
    _, ids, decoded = bpe.forms(text)
    return [int(x) for x in ids.split()], decoded


def _mapped(docs: DataFrame, vocabulary: str, text_col: str, new: dict, make) -> DataFrame:
    old = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*old, *[T.StructField(k, t) for k, t in new.items()]])
    kinds = [pa.list_(pa.int32()) if isinstance(t, T.ArrayType) else pa.int64() if isinstance(t, T.LongType) else pa.string() for t in new.values()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for block in text_blocks(batches, "__text"):
            rows = [make(bpe, text or "") for text in block.column("__text").to_pylist()]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[block.column(f.name) for f in old], *made], [*[f.name for f in old], *new])
        bpe.cache.clear()  # the worker lives on, with other work

    bounded_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{f.name}`") for f in old], F.col(f"`{text_col}`").alias("__text"))
    return kept.mapInArrow(encode, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_digests(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
