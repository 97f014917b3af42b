"""MinHash near-dedup with sequential Bayesian verification.

Texts with the same shingle set are one class; only classes are compared. Signatures are cut into bands, and classes
that share a band meet in a bucket. In each bucket all are compared with one pivot, never all with all. A pair is
compared by a batch of signature values at a time, and dropped once the posterior chance that its similarity
reaches the threshold is below the chosen miss probability; the survivors are verified on full shingle sets.

A bucket that the pivots leave in several components is looked at again: each member outside its main component is
compared with all of other components. Where those are many, the bucket is split by further bands, and what even
then has many takes them in turn, round by round, until none is left to compare. So no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.llm.common import bounded_batches, byte_words, mix64, row_key, stored, table, text_blocks, text_bytes

BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
#: Signature values compared at a time.
BATCH = 16
#: Chance that a pair is dropped although it reaches the threshold.
MISS = 1e-6
#: Members of a star that one group streams past its pivot.
STAR = 1024
#: Members outside a bucket's main component that are compared with all of it in one round.
FEW = 1024
#: A shingle with more owners than this, among the classes of open buckets, counts as frequent.
RARE = 32
#: Parts that frequent shingles are counted in: two classes share at most the sum of the lesser counts.
PARTS = 16
#: Rows (40 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Further bands that a large bucket is split by, one after the other.
SPLITS = 2

_r = np.random.default_rng(20)
MULTIPLY = (_r.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
ADD = _r.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def _word_code() -> np.ndarray:
    """A-Z in lower case; white space parts words. No normalised byte is 0."""
    code = np.arange(256, dtype=np.uint8)
    code[65:91] += 32
    code[0] = 65
    code[[32, *range(9, 14)]] = 0
    return code


WORD_CODE = _word_code()


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, offsets = text_bytes(texts)
    hashes, of, _, _ = byte_words(data, offsets, WORD_CODE)
    counts = np.bincount(of, minlength=len(texts))
    ends = np.cumsum(counts)

    def joined(at: np.ndarray, size: int) -> np.ndarray:
        key = np.full(len(at), size, np.uint64)
        for d in range(size):
            key = mix64(key * np.uint64(0x100000001B3) + hashes[at + d])
        return key

    whole = joined(np.arange(max(0, len(hashes) - words + 1)), words)
    out = []
    for start, n in zip((ends - counts).tolist(), counts.tolist(), strict=True):
        out.append(np.unique(whole[start : start + n - words + 1]) if n >= words else joined(np.array([start]), n) if n else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(20)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        h = low[at : at + 2048] * MULTIPLY + ADD
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, h.min(1))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit bucket keys, a row a signature and a column a band."""
    s = signatures.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2])
    for d in range(BAND_ROWS):
        key = mix64(key * np.uint64(0x100000001B3) + s[:, :, d])
    return key.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch, the matches below which the posterior of similarity >= threshold is under `miss`.

    With a uniform prior the posterior after m matches in n is Beta(m + 1, n - m + 1), whose upper tail at t is the
    chance of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survive(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Indices of the signature pairs that no batch rules out."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for k, least in enumerate(least_matches(threshold, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(1)
        good = matches >= least
        alive, matches = alive[good], matches[good]
    return alive


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """id, row, n (shingles), ha, hb (which name the set) and sig, for each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            sets = shingle_sets(block.column("text"), words)
            ha = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            hb = np.array([mix64(s ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            sig = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([block.column("id"), block.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ha), pa.array(hb), pa.array(sig, pa.binary())], ["id", "row", "n", "ha", "hb", "sig"])

    return docs.mapInArrow(sign, "id long, row long, n long, ha long, hb long, sig binary")


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _bands(classes: DataFrame) -> DataFrame:
    """key, v: a row for each band of each class."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_sigs(batch.column("sig")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("v").to_numpy(), BANDS))], ["key", "v"])

    return classes.select("v", "sig").mapInArrow(spread, "key long, v long")


def _places(pairs: DataFrame) -> DataFrame:
    """For each class of the pairs (a: pivot, b: member), the groups of its stars and its part there."""
    sized = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("groups")), "a")
    dealt = sized.select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    members = dealt.select(F.col("b").alias("v"), F.struct("a", "part", F.lit(1).alias("member")).alias("place"))
    pivots = dealt.select("a", "part").distinct().select(F.col("a").alias("v"), F.struct("a", "part", F.lit(0).alias("member")).alias("place"))
    return members.unionByName(pivots)


def _streamed(rows: DataFrame) -> DataFrame:
    """Members behind their pivot: a, part, member, v and whatever is compared."""
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "member")


def _bayes(pairs: DataFrame, classes: DataFrame, similarity: int, miss: float) -> DataFrame:
    """The pairs that their signatures do not rule out."""
    rows = _places(pairs).join(classes.select("v", "n", "sig"), "v").select("place.*", "v", "n", "sig")
    threshold = similarity / 100

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_n, last = 0, np.zeros((1, HASHES), np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, n = np.vstack([last, _sigs(batch.column("sig"))]), np.append(last_n, batch.column("n").to_numpy())
            member = np.append(0, batch.column("member").to_numpy())
            pivot = np.maximum.accumulate(np.where(member == 0, np.arange(len(member)), 0))
            at = np.flatnonzero(member)
            small, large = np.minimum(n[at], n[pivot[at]]), np.maximum(n[at], n[pivot[at]])
            at = at[100 * small >= similarity * large]
            good = at[survive(sig[pivot[at]], sig[at], threshold, miss)] - 1
            last_n, last = n[pivot[-1]], sig[pivot[-1]][None]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good)), batch.column("v").take(pa.array(good))], ["a", "b"])

    return _streamed(rows).mapInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity. Texts are moved once, sets once a star."""
    wanted = _places(pairs).groupBy("v").agg(F.collect_list("place").alias("places"))
    keyed = wanted.join(classes.select("v", "id", "row"), "v")
    texts = docs.join(keyed, ["id", "row"]).select("v", "text", "places")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            sets = shingle_sets(block.column("text"), words)
            rows, size = [], 0
            for v, places, s in zip(block.column("v").to_pylist(), block.column("places").to_pylist(), sets, strict=True):
                packed = s.tobytes()
                for p in places:
                    rows.append((p["a"], p["part"], p["member"], v, packed))
                    size += len(packed)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["a", "part", "member", "v", "shingles"])
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["a", "part", "member", "v", "shingles"])

    rows = texts.mapInArrow(place, "a long, part long, member int, v long, shingles binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for k, (member, packed) in enumerate(zip(batch.column("member").to_pylist(), batch.column("shingles").to_pylist(), strict=True)):
                own = np.frombuffer(packed, np.uint64)
                if not member:
                    pivot = own
                    continue
                near = np.searchsorted(pivot, own)
                common = int((pivot[np.minimum(near, len(pivot) - 1)] == own).sum())
                if 100 * common >= similarity * (len(pivot) + len(own) - common):
                    good.append(k)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("v").take(take)], ["a", "b"])

    return _streamed(rows).mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """v, label: the least class reachable, for each class with a link. Labels spread and jump, round by round."""
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        spread = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("to")).agg(F.min("label").alias("near"))
        least = labels.join(spread, F.col("v") == F.col("to")).select("v", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("v").alias("at"), F.col("label").alias("far"))
        new = stored(least.join(jump, F.col("label") == F.col("at"), "left").select("v", F.least("label", F.coalesce("far", "label")).alias("label"), "was"), "labels")
        if new.where("label <> was").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components: with label, and whether it is not the bucket's most
    frequent one (stray), and how many strays the bucket has."""
    own = [c for c in members.columns if c not in ("label", "stray", "strays")]
    known = members.select(*own).join(labels, "v", "left").select(*own, F.coalesce("label", "v").alias("label"))
    shares = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = shares.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("strays")).where("strays > 0")
    return stored(known.join(main, "key").select(*own, "label", (F.col("label") != F.col("main.label")).alias("stray"), "strays"), "open")


def _shared_parts(members: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """What members (key, v, label, stray) of open buckets can still be linked by: (members, pairs).

    Take the shingles that more than RARE classes of open buckets have as frequent. Two linked classes have
    similarity / (100 + similarity) of the sum of their sizes in common; where one has fewer frequent shingles than
    that, they share rare ones, and enough of them. Such pairs (a, b) come from an index of the rare shingles, each of
    which has at most RARE owners. Only the other members, whose frequent shingles alone could do, remain in their
    buckets. This is exact, and most of what strays from a group of near copies by edits of its own falls here.
    """
    wanted = stored(members.groupBy("v").agg(F.first("label").alias("label"), F.max("stray").alias("stray")).join(classes.select("v", "n", "id", "row"), "v"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    at = wanted.select("v", "id", "row")
    texts = docs.join(F.broadcast(at) if few else at, ["id", "row"]).select("v", "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            sets = shingle_sets(block.column("text"), words)
            owner = np.repeat(block.column("v").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(sets).view(np.int64))], ["v", "shingle"])

    rows = stored(texts.mapInArrow(spread, "v long, shingle long"), "shingles")
    owners = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")
    shared = stored(rows.join(owners, "shingle"), "shared")
    part = F.pmod("shingle", F.lit(PARTS))
    frequent = shared.where(F.col("owners") > RARE).groupBy("v").agg(F.array(*[F.count_if(part == k) for k in range(PARTS)]).alias("frequent"))
    none = F.array_repeat(F.lit(0).cast("long"), PARTS)
    known = stored(wanted.join(frequent, "v", "left").select("v", "n", "label", "stray", F.coalesce("frequent", none).alias("frequent")), "known")

    # first by totals, which aggregate by hash; then by parts
    index = shared.where(F.col("owners") <= RARE).join(known, "v").select("shingle", "v", "n", "label", "stray", _common("frequent", "frequent").alias("f"))
    left = index.where("stray").select("shingle", *[F.col(c).alias(f"{c}_1") for c in ("v", "n", "label", "f")])
    # two strays meet once; every pair has a stray
    both = left.join(index, "shingle").where(F.col("label") != F.col("label_1")).where(~F.col("stray") | (F.col("v_1") < F.col("v")))
    counted = both.groupBy("v_1", "v", "n_1", "n", "f_1", "f").agg(F.count(F.lit(1)).alias("rare"))
    near = stored(counted.where(_enough(F.col("rare") + F.least("f", "f_1"), F.col("n") + F.col("n_1"), similarity)).select("v_1", "v", "n_1", "n", "rare"), "near")
    parts = known.select("v", "frequent")
    near = near.join(parts, "v").join(parts.select(F.col("v").alias("v_1"), F.col("frequent").alias("frequent_1")), "v_1")
    pairs = near.where(_enough(F.col("rare") + _common("frequent", "frequent_1"), F.col("n") + F.col("n_1"), similarity)).select(F.least("v", "v_1").alias("a"), F.greatest("v", "v_1").alias("b"))

    placed = members.select("key", "v").join(known.select("v", "n", "frequent"), "v")
    least = placed.groupBy("key").agg(F.min("n").alias("least"))
    rest = placed.join(least, "key").where(_enough(_common("frequent", "frequent"), F.col("n") + F.col("least"), similarity)).select("key", "v", "n", "frequent")
    return stored(rest, "rest"), stored(pairs, "alike")


def _common(a: str, b: str) -> Column:
    """The most that two classes can share, by their counts in each part."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)


def _enough(common: Column, sizes: Column, similarity: int) -> Column:
    return (100 + similarity) * common >= similarity * sizes


def _met(pivots: DataFrame, members: DataFrame, similarity: int) -> DataFrame:
    """Each pivot with all members of its bucket that are of another component, if their frequent shingles could do."""
    left = pivots.select("key", *[F.col(c).alias(f"{c}_1") for c in ("v", "label", "n", "frequent")])
    both = left.join(members.select("key", "v", "label", "n", "frequent"), "key").where(F.col("label") != F.col("label_1"))
    both = both.where(_enough(_common("frequent", "frequent_1"), F.col("n") + F.col("n_1"), similarity))
    return both.select(F.least("v", "v_1").alias("a"), F.greatest("v", "v_1").alias("b")).distinct()


def _split(large: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of large buckets by every further band: two alike share one of those, too."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_sigs(batch.column("sig"))).view(np.uint64)
                own = batch.column("key").to_numpy().view(np.uint64)[:, None]
                keys = mix64(own * np.uint64(0x9E3779B97F4A7C15) + keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("v").to_numpy(), BANDS))], ["key", "v"])

    return large.join(classes.select("v", "sig"), "v").select("key", "v", "sig").mapInArrow(spread, "key long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, row (its key), n_shingles, component_id (the least id reachable) and kept.

    Documents are linked when 100 * intersection >= `similarity` * union of their sets of `words`-word shingles; a
    shorter text is one shingle. Null and wordless texts have no shingles and no links. Equal sets are always
    linked. Rows that repeat an id are compared each by itself; they are kept together where their id is the least.
    A row without an id has no component, no links, and is kept. An empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"))
    signed = stored(_signed(base, words), "signed")
    named = signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = named.groupBy(F.col("ha").alias("v"), "hb", "n").agg(F.min(F.struct("id", "row")).alias("first"), F.first("sig").alias("sig"))
    classes = stored(classes.select("v", "hb", "n", "first.id", "first.row", "sig"), "classes")

    bands = _bands(classes)
    buckets = stored(bands.groupBy("key").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b"), "buckets")
    shared = stored(bands.join(buckets.where("size > 2").select("key", "size"), "key"), "shared")
    # the pivot is the member that meets most others: among near copies, one with few edits of its own
    weight = shared.groupBy("v").agg(F.sum("size").alias("weight"))
    members = stored(shared.join(weight, "v").select("key", "v", "weight"), "members")
    pivots = members.groupBy("key").agg(F.max(F.struct("weight", "v")).alias("top")).select("key", F.col("top.v").alias("p"))
    stars = members.join(pivots, "key").where("v <> p").select(F.least("p", "v").alias("a"), F.greatest("p", "v").alias("b"))
    pairs = buckets.where("size = 2").select("a", "b").unionByName(stars).distinct()

    def checked(pairs: DataFrame) -> DataFrame:
        return _verified(stored(pairs, "alike"), classes, base, words, similarity)

    links = stored(checked(_bayes(stored(pairs, "pairs"), classes, similarity, miss)), "links")
    labels = components(links)
    left, depth = _open(members.select("key", "v"), labels), 0
    if not left.isEmpty():
        rest, pairs = _shared_parts(left, classes, base, words, similarity)
        new = stored(checked(_bayes(pairs, classes, similarity, miss)), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = components(links)
        left = _open(rest, labels)
    while not left.isEmpty():
        # two of different components are never both of the main one: strays against all finds every link
        few, many = left.where(F.col("strays") <= FEW), left.where(F.col("strays") > FEW)
        found = _met(few.where("stray"), few, similarity)
        if depth < SPLITS:
            rest = _split(many, classes).join(many.select("v", "n", "frequent").distinct(), "v")
        else:
            turn = many.where("stray").withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("v"))).where(F.col("turn") <= FEW)
            turn = stored(turn.select("key", "v", "label", "n", "frequent"), "turn")
            found = found.unionByName(_met(turn, many, similarity))
            rest = many.select("key", "v", "n", "frequent").join(turn.select("key", "v"), ["key", "v"], "left_anti")
        rest = stored(rest, "rest")
        new = stored(checked(_bayes(stored(found, "pairs"), classes, similarity, miss)), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = components(links)
        if rest.isEmpty():
            break
        left, depth = _open(rest, labels), depth + 1

    label = F.coalesce("label", "v")
    reached = stored(classes.join(labels, "v", "left").select("v", "hb", "n", "id", label.alias("label")), "reached")
    least = reached.groupBy("label").agg(F.min("id").alias("component_id"))
    placed = reached.join(least, "label").select(F.col("v").alias("ha"), "hb", "n", "component_id")
    out = signed.select("id", "row", "n", "ha", "hb").join(placed, ["ha", "hb", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select("id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with their own columns, that near_duplicates() keeps."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("NOT kept").select(F.col("id").alias("__id"), F.col("row").alias("__row")).distinct()
    return docs.join(gone, (F.col(f"`{id_col}`") == F.col("__id")) & (row_key(id_col, text_col) == F.col("__row")), "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=4).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 4 THEN array_to_string(ws[i:i + 3], ' ') ELSE array_to_string(ws, ' ') END AS sh FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(id, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, b.y FROM reach r JOIN both_ways b ON r.far = b.x),
c AS (SELECT id, min(far) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
