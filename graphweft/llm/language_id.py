"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.common import bounded_batches, mix64, table, text_blocks, text_bytes

#: Hashed byte n-grams.
BUCKETS = 4096
SIZES = (1, 2, 3)
#: Documents of a language that its centroids are fitted on, at most.
TRAIN_PER_LANGUAGE = 400
#: Fitting rows of all languages, at most; and languages that are learned, the most frequent first.
TRAIN_ROWS = 16384
MOST_LANGUAGES = 512
#: Parts that a language's keys are ranked in before the whole.
PARTS = 64
CENTROIDS = 4
#: Lengths in characters of the pieces of training texts from which short texts' cosines are learned.
PIECES = (4, 12, 32, 100, 300, 1000)
#: Quantiles of the cosines of a language's own texts and of those of others, between which its bound lies.
OWN_LOW, OTHER_HIGH = 0.01, 0.99
#: A bound that the two quantiles do not enclose is this share of the lower one.
SLACK = 0.8
#: Bounds go by the number of known n-grams, in steps of a factor of two; one with fewer texts takes the next shorter's.
LEVELS = BUCKETS.bit_length() + 1
LEAST_TEXTS = 20
#: Counts are taken in blocks of this many documents.
ROWS = 256


def _letter_code() -> np.ndarray:
    """Lower-cased ASCII letters and all bytes from 0x80; 1 for all else."""
    code = np.ones(256, np.uint8)
    code[97:123] = np.arange(97, 123)
    code[65:91] = np.arange(97, 123)
    code[128:] = np.arange(128, 256)
    return code


LETTER_CODE = _letter_code()


def ngram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text. Whatever is no letter parts words, as a text's ends do."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    code = np.ones(len(data) + n + max(SIZES), np.uint8)
    code[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets)) + 1] = LETTER_CODE[data]
    bounds = offsets + np.arange(n + 1)
    out = np.zeros((n, BUCKETS), np.float32)
    letters = code > 1
    key = np.zeros(len(code), np.uint64)
    for size in range(1, max(SIZES) + 1):
        m = len(code) - size + 1
        key = key[:m] * np.uint64(257) + code[size - 1 : size - 1 + m]
        if size in SIZES:
            some = letters[:m].copy()
            for d in range(1, size):
                some |= letters[d : d + m]
            bucket = (mix64(key + np.uint64(size << 56)) >> np.uint64(40)).astype(np.int64) % BUCKETS
            bucket[~some] = BUCKETS
            for i in range(n):
                a, b = bounds[i], min(bounds[i + 1] + 2 - size, m)
                if b > a:
                    out[i] += np.bincount(bucket[a:b], minlength=BUCKETS + 1)[:BUCKETS]
    return out


def has_letter(texts: list) -> np.ndarray:
    return np.array([bool(t) and (any(c.isalpha() for c in t[:200]) or any(c.isalpha() for c in t[200:])) for t in texts], bool)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, out=counts)
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(norm, 1e-9)[:, None]


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the seeds are the first row and then the farthest from those chosen."""
    centroids = v[:1]
    for _ in range(min(k, len(v)) - 1):
        centroids = np.vstack([centroids, v[np.argmin((v @ centroids.T).max(1))]])
    for _ in range(rounds):
        own = np.argmax(v @ centroids.T, 1)
        sums = np.vstack([v[own == j].sum(0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    return centroids.astype(np.float32)


def unpack(packed: list[bytes], idf: np.ndarray) -> np.ndarray:
    return vectors(np.vstack([np.frombuffer(zlib.decompress(c), np.float32) for c in packed]), idf)


def level(v: np.ndarray) -> np.ndarray:
    """The binary order of the number of n-grams of each text; a text that repeats few words is as good as short."""
    return np.ceil(np.log2(1 + np.count_nonzero(v, axis=1))).astype(np.int64)


class Model:
    def __init__(self, idf: np.ndarray, names: list[str], rows: list[list[bytes]], pieces: list[list[list[bytes]]]):
        """rows: packed training counts of each language; pieces: those of pieces of each row."""
        self.idf, self.names = idf, names
        kept, halves = [], []
        for own in rows:
            v = unpack(own, idf)
            kept.append(cluster(v, CENTROIDS))
            halves.append([cluster(v[1 - h :: 2], CENTROIDS) if len(v) > 1 else kept[-1] for h in (0, 1)])
        self.centroids = np.vstack(kept) if kept else np.zeros((0, BUCKETS), np.float32)
        self.owner = np.repeat(np.arange(len(kept)), [len(c) for c in kept]) if kept else np.zeros(0, np.int64)
        self.least = self.bounds(kept, halves, rows, pieces)
        self.usual = int(np.argmax([len(v) for v in rows])) if rows else 0

    def bounds(self, kept: list[np.ndarray], halves: list[list[np.ndarray]], rows: list[list[bytes]], pieces: list[list[list[bytes]]]) -> np.ndarray:
        """The least cosine of a text of each language and level.

        Texts of a language meet the centroids of the half of its rows that they are not in, and all of other languages'.
        """
        own, other = [[] for _ in kept], [[] for _ in kept]
        for k, (full, parts) in enumerate(zip(rows, pieces, strict=True)):
            for h in (0, 1):
                some = [x for c, p in zip(full[h::2], parts[h::2], strict=True) for x in (c, *p)]
                for at in range(0, len(some), ROWS):
                    v = unpack(some[at : at + ROWS], self.idf)
                    at_level = level(v)
                    for j, c in enumerate(kept):
                        (own if j == k else other)[j].append((at_level, (v @ (halves[k][h] if j == k else c).T).max(1)))
        out = np.zeros((len(kept), LEVELS))
        for k in range(len(kept)):
            (size, cos), apart = (np.hstack(x) for x in zip(*own[k], strict=True)), [np.hstack(x) for x in zip(*other[k], strict=True)]
            for n in range(1, LEVELS):
                if (size == n).sum() < LEAST_TEXTS:
                    out[k, n] = out[k, n - 1]
                    continue
                low = np.quantile(cos[size == n], OWN_LOW)
                far = apart[1][apart[0] == n] if apart else cos[:0]
                high = np.quantile(far, OTHER_HIGH) if len(far) >= LEAST_TEXTS else 0.0
                out[k, n] = (low + high) / 2 if 0 < high < low else SLACK * low
        return out

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, cosine with its nearest centroid, and whether that is too far."""
        v = vectors(counts, self.idf)
        cos = v @ self.centroids.T
        best = np.argmax(cos, 1)
        score = np.clip(cos[np.arange(len(cos)), best].astype(np.float64), 0, 1)
        own = np.where(score > 0, self.owner[best], self.usual)
        return own, score, score < self.least[own, level(v)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Document frequencies come from all of `docs`; centroids from at most `per_language` documents of each language.

    The fitting rows are the first by a hash of the id and text; rows that repeat count once. Beyond MOST_LANGUAGES
    languages the rarest are not learned, and TRAIN_ROWS rows are shared out evenly, so that what comes to the driver
    is bounded whatever the table holds. Rows without a language count only for frequencies.
    """

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(BUCKETS, np.int64), 0
        for block in text_blocks(batches, "text"):
            for at in range(0, block.num_rows, ROWS):
                part = block.column(0).slice(at, ROWS)
                seen += (ngram_counts(part) > 0).sum(0)
                total += len(part)
        bucket = np.append(np.flatnonzero(seen), BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.append(seen[seen > 0], total), pa.int64())], ["bucket", "n"])

    bounded_batches(docs.sparkSession)
    text_col_ = F.col(f"`{text_col}`")
    text = text_col_.alias("text")
    df = np.zeros(BUCKETS + 1)
    for r in docs.select(text).mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r.bucket] = r.n
    idf = (np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1).astype(np.float32)

    labelled = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    ident, own = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`").cast("string")
    # bounded: MOST_LANGUAGES names
    names = [r.lang for r in labelled.groupBy(own.alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    if len(names) * per_language > TRAIN_ROWS:
        per_language = max(1, TRAIN_ROWS // len(names))
    labelled = labelled.select(F.xxhash64(ident, text_col_).alias("r1"), F.xxhash64(F.lit("second"), text_col_, ident).alias("r2"), text, own.alias("lang")).where(F.col("lang").isin(names))
    # first of each part of a language, then of the language: its one task reads PARTS * per_language keys at most
    chosen = labelled.select("r1", "r2", "lang").distinct().withColumn("part", F.pmod("r1", F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        order = Window.partitionBy(*keys).orderBy("r1", "r2")
        chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).drop("n")
    chosen = chosen.drop("part")
    # bounded: TRAIN_ROWS keys
    rows = labelled.join(F.broadcast(chosen), ["r1", "r2", "lang"]).dropDuplicates(["r1", "r2", "lang"]).select("text", "lang")

    def pack(counts: np.ndarray) -> bytes:
        return zlib.compress(counts.tobytes(), 1)

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            good = has_letter(block.column("text").to_pylist())
            counts = ngram_counts(block.column("text"))
            packed = [pack(c) if g else b"" for c, g in zip(counts, good, strict=True)]
            # from the middle, as texts may begin alike
            cuts = [[t[(len(t) - n) // 2 :][:n] for n in PIECES if n < len(t)] if g else [] for t, g in zip(block.column("text").to_pylist(), good, strict=True)]
            parts = [[pack(c) for c in ngram_counts(pa.array(x, pa.string())) if c.any()] for x in cuts]
            yield pa.RecordBatch.from_arrays([block.column("lang"), pa.array(packed, pa.binary()), pa.array(parts, pa.list_(pa.binary()))], ["lang", "counts", "parts"])

    by: dict[str, list] = {}
    for r in rows.mapInArrow(vectorise, "lang string, counts binary, parts array<binary>").collect():
        if r.counts:
            by.setdefault(r.lang, []).append((bytes(r.counts), [bytes(p) for p in r.parts]))
    names = sorted(by)
    # in a fixed order, whatever order tasks end in
    chosen = [sorted(by[x])[:per_language] for x in names]
    return Model(idf, names, [[c for c, _ in x] for x in chosen], [[p for _, p in x] for x in chosen])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with lang_pred, score and rejected (these replace columns of those names).

    A text that is null or has no letter gets `und`, 0 and true. Else lang_pred is the language of the nearest
    centroid and score its cosine; rejected tells that even this one is farther than texts of that language and as
    many n-grams are. A text without any known n-gram
    gets the most usual language, 0 and true. With nothing learned all texts are `und`. Equal cosines go to the
    first language by name. Rows are taken one by one: repeats and ids change nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids of fixed width for each language
    bounded_batches(docs.sparkSession)
    new = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    old = [f for f in docs.schema.fields if f.name not in new]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for block in text_blocks(batches, "__text"):
            texts = block.column("__text")
            good = has_letter(texts.to_pylist()) & bool(m.names)
            own, score, far = np.zeros(len(good), np.int64), np.zeros(len(good)), np.ones(len(good), bool)
            if m.names:
                for at in range(0, len(good), ROWS):
                    own[at : at + ROWS], score[at : at + ROWS], far[at : at + ROWS] = m.predict(ngram_counts(texts.slice(at, ROWS)))
            names = [m.names[k] if g else "und" for k, g in zip(own.tolist(), good.tolist(), strict=True)]
            made = [pa.array(names, pa.string()), pa.array(np.where(good, score, 0.0)), pa.array(far | ~good)]
            yield pa.RecordBatch.from_arrays([*[block.column(f.name) for f in old], *made], [*[f.name for f in old], *new])

    schema = T.StructType([*old, *[T.StructField(k, t) for k, t in new.items()]])
    return docs.select(*[F.col(f"`{f.name}`") for f in old], F.col(f"`{text_col}`").alias("__text")).mapInArrow(label, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
