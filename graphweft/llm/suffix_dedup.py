"""Verbatim-repeat removal with range-partitioned suffixes.

Every byte covered by a string of LENGTH bytes that also starts elsewhere is removed. Sorting all suffixes of a
corpus would move hundreds of bytes for each byte of text, so suffixes are taken in runs: each LENGTH-byte string
has an anchor, the place of the least hash among its GRAM-byte grams (the first of equals), which depends on its
content alone. Consecutive strings with one anchor form a run, about one in seventy bytes. Two equal strings lie in
runs whose anchors begin with the same gram; so

1. runs whose gram occurs once in the corpus hold no repeat and are dropped, counted before the shuffle;
2. equal runs (same bytes, same anchor place) that occur twice are repeats as a whole;
3. the distinct runs that share a gram are range-partitioned by its bytes with sampled splitters, so that no gram is
   parted; a bucket sorts the suffixes of its runs by multikey quicksort, 8 bytes a key, refining ties only, and
   equal neighbours are repeats. A gram with more than LARGE distinct runs, which would load one bucket, is split
   by ranges of distances to the anchor instead, which finds the same equals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.common import BYTE_VALUE, bounded_batches, mix64, stored, table, text_blocks, text_bytes

LENGTH = 200
GRAM = 64
#: Distinct runs of one gram that a bucket sorts at most.
LARGE = 1024
BLOCK = 1 << 20
#: Suffixes that one sort takes at a time.
SORTED = 1 << 18

_RUN = "id long, row long, row2 long, start int, size int, anchor int, reps int, g long, c long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, by doubling: no gram is read byte by byte."""
    h, size = BYTE_VALUE[data], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
        h ^= h >> np.uint64(32)
        size *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours: running minima of blocks from both sides."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def part_hash(h: np.ndarray, start: np.ndarray, size: np.ndarray, most: int, salt: int) -> np.ndarray:
    """Hash of data[start : start + size], from the grams that cover it (size >= GRAM, at most `most`)."""
    key = mix64(size.astype(np.uint64) + np.uint64(salt))
    last = start + size - GRAM
    for d in range(0, most, GRAM):
        key = mix64(key * np.uint64(0x100000001B3) + h[np.minimum(start + d, last)])
    return key


def runs(texts: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """For each run: text, first start in the text, starts, anchor's place in the run, repetitions, gram and content hash.

    Consecutive equal runs, as in periodic text, are one row with their number.
    """
    data, offsets = text_bytes(texts)
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    if len(data) < length:
        return none
    h = gram_hashes(data)
    width = length - GRAM + 1
    places = np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min((mix64(h) & np.uint64(0xFFFFFFFF00000000)) | places, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(offsets)
    end = np.repeat(offsets[1:], lengths)[: len(anchor)]
    starts = np.flatnonzero(np.arange(len(anchor)) + length <= end)
    if not len(starts):
        return none
    of, a = end[starts], anchor[starts]
    fresh = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (of[1:] != of[:-1])))
    first = starts[fresh]
    size = np.diff(np.append(fresh, len(starts)))
    at = a[fresh]
    g = mix64(h[at] + np.uint64(0xD1B54A32D192ED03))
    c = part_hash(h, first, size + length - 1, 2 * length, 0) + mix64((at - first).astype(np.uint64))
    text = np.searchsorted(offsets, first, side="right") - 1
    same = np.zeros(len(first), bool)
    same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1]) & (size[1:] == size[:-1]) & (text[1:] == text[:-1])
    head = np.flatnonzero(~same)
    reps = np.diff(np.append(head, len(first)))
    return text[head], (first - offsets[text])[head], size[head], (at - first)[head], reps, g[head].view(np.int64), c[head].view(np.int64)


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", BLOCK):
            text, start, size, anchor, reps, g, c = runs(block.column("text"), length)
            small = [pa.array(x.astype(np.int32)) for x in (start, size, anchor, reps)]
            owner = pa.array(text)
            yield pa.RecordBatch.from_arrays([*[block.column(k).take(owner) for k in ("id", "row", "row2")], *small, pa.array(g), pa.array(c)], ["id", "row", "row2", "start", "size", "anchor", "reps", "g", "c"])

    return docs.mapInArrow(find, _RUN)


def multikey_sort(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order places by group and then by `length` bytes; and which equal the one before them.

    Multikey quicksort, all segments a round: each is split three ways by 8 bytes of its middle member; the equal part
    goes on to the next 8 bytes, the other two stay at these. A segment of one, or one equal to the end, is done.
    """
    words = -(-length // 8)
    padded = np.concatenate([data, np.zeros(8 * words, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    by = np.argsort(group, kind="stable")
    order, own = at[by], group[by]
    segment = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), np.arange(len(at)), 0))  # its first place
    depth = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while True:
        sizes = np.bincount(segment[live], minlength=len(at))
        live = live[(sizes[segment[live]] > 1) & (depth[live] < words)]
        if not len(live):
            break
        place, d, seg = order[live], depth[live], segment[live]
        key = np.ascontiguousarray(view[place + 8 * d]).view(">u8").ravel().astype(np.uint64)
        if 8 * words > length:
            key[d == words - 1] >>= np.uint64(8 * (8 * words - length))
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        size = np.diff(np.append(first, len(seg)))
        pivot = np.repeat(key[first + size // 2], size)
        to, at_part = np.zeros(len(seg), np.int64), np.zeros(len(seg), np.int64)
        before = np.zeros(len(first), np.int64)
        for part in (key < pivot, key == pivot, key > pivot):
            upto = np.cumsum(part)
            ahead = upto[first] - part[first]
            nth = upto - 1 - np.repeat(ahead, size)
            base = np.repeat(before, size)
            to, at_part = np.where(part, base + nth, to), np.where(part, base, at_part)
            before = before + upto[first + size - 1] - ahead
        to += seg
        order[to], depth[to], segment[to] = place, d + (key == pivot), seg + at_part
    equal = np.zeros(len(at), bool)
    equal[1:] = segment[1:] == segment[:-1]
    return order, equal


def repeated_starts(contexts: list[bytes], sizes: np.ndarray, anchors: np.ndarray, groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each run, which of its starts have an equal suffix of `length` bytes in another run of its group."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum([0, *map(len, contexts)])[:-1]
    run = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # equal suffixes have the same distance to their anchors
    group = groups[run] * np.int64(2 * length) + (anchors[run] - inside)
    at = base[run] + inside
    order, equal = multikey_sort(data, at, group, length)
    marked = equal.copy()
    marked[:-1] |= equal[1:]
    where = np.zeros(len(data) + 1, bool)
    where[order[marked]] = True
    return [where[b : b + s] for b, s in zip(base.tolist(), sizes.tolist(), strict=True)]


def _intervals(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"s": int(s), "e": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]


_MARKS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_MARK_SCHEMA = "g long, c long, marks array<struct<s:int,e:int>>"


def _sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Marks of runs (g, c, size, anchor, lead, bytes), by local sorts of range partitions."""

    def compare(rows: list[dict]) -> pa.RecordBatch:
        sizes, anchors = (np.array([r[k] for r in rows], np.int64) for k in ("size", "anchor"))
        _, groups = np.unique(np.array([r["g"] for r in rows], np.int64), return_inverse=True)
        marks = repeated_starts([bytes(r["bytes"]) for r in rows], sizes, anchors, groups, length)
        kept = [(r["g"], r["c"], m) for r, f in zip(rows, marks, strict=True) if (m := _intervals(f))]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], _MARKS)], ["g", "c", "marks"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, suffixes = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if suffixes >= SORTED and held[-1]["g"] != r["g"]:  # never between runs of one gram
                    yield compare(held)
                    held, suffixes = [], 0
                held.append(r)
                suffixes += r["size"]
        if held:
            yield compare(held)

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartitionByRange(n, "lead").sortWithinPartitions("lead", "g").select("g", "c", "size", "anchor", "bytes").mapInArrow(work, _MARK_SCHEMA)


def _halved(contexts: DataFrame, length: int) -> DataFrame | None:
    """Marks of runs whose grams are too frequent for one bucket, by halving ranges of distances to the anchor.

    All strings of a range share a core. A part of a run is settled when no other run has its core, or when another
    run has all its bytes (then it is a repeat as a whole, and one of the equals goes on as a partner for others). The
    rest is halved, down to single strings. Most parts are settled early, so that a run makes a few rows, not one for
    each of its strings; equal parts are counted before the shuffle.
    """
    fields = ["g", "c", "x0", "xa", "xb", "anchor", "size", "k1", "k2", "u1", "u2", "bytes"]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, *[pa.int64()] * 4, pa.binary()]
    schema = "g long, c long, x0 int, xa int, xb int, anchor int, size int, k1 long, k2 long, u1 long, u2 long, bytes binary"

    def digest(*parts: object, data: bytes) -> tuple[int, int]:
        h = hashlib.blake2b(repr(parts).encode() + b"|" + data, digest_size=16).digest()
        return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)

    def halves(width: int):
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    a, data = r["anchor"], bytes(r["bytes"])
                    for x0 in (r["x0"], r["x0"] + width):
                        xa, xb = max(x0, a - r["size"] + 1), min(x0 + width - 1, a)
                        if xa > xb:
                            continue
                        core = digest(r["g"], x0, data=data[a - x0 : max(a - x0, a + length - x0 - width + 1)])
                        whole = digest(r["g"], xa, xb, data=data[a - xb : a + length - xa])
                        out.append((r["g"], r["c"], x0, xa, xb, a, r["size"], *core, *whole, data))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], fields)

        return split

    width = 1
    while width < length:
        width *= 2
    rows, marks = contexts.withColumn("x0", F.lit(0)), None
    while width > 1 and not rows.isEmpty():
        width //= 2
        parts = stored(rows.mapInArrow(halves(width), schema), "parts")
        equal = parts.groupBy("k1", "k2", "u1", "u2").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("one"))
        shared = equal.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1")
        open_ = stored(parts.join(equal, ["k1", "k2", "u1", "u2"]).join(shared, ["k1", "k2"]), "open")
        now = open_.where("n > 1").select("g", "c", F.array(F.struct((F.col("anchor") - F.col("xb")).alias("s"), (F.col("anchor") - F.col("xa") + 1).alias("e"))).alias("marks"))
        marks = now if marks is None else marks.unionByName(now)
        rows = open_.where("kinds > 1 AND c = one").select("g", "c", "size", "anchor", "bytes", "x0")
    return marks


def find_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """The rows of `docs` with spans (removed byte ranges, merged), n_bytes, n_removed and kept (binary).

    Those names replace columns of `docs`. Texts are UTF-8 bytes; a null is empty; matches never go across rows.
    A text shorter than `length` has no repeats. Rows that repeat an id are texts of their own, so a repeated row of
    `length` bytes or more is removed wholly, in both places. Null ids are as good as any. Empty tables stay empty.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    bounded_batches(docs.sparkSession)
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    # 128 bits that tell rows apart, whatever their ids are
    row, row2 = F.xxhash64(ident, text), F.xxhash64(F.lit("second"), text, ident)
    base = docs.select(ident.cast("long").alias("id"), row.alias("row"), row2.alias("row2"), text.alias("text"))
    found = _runs(base, length)
    frequent = found.groupBy("g").agg(F.sum("reps").alias("n")).where("n > 1").select("g")
    near = stored(found.join(frequent, "g"), "runs")

    classes = near.groupBy("g", "c", "size", "anchor").agg(F.sum("reps").alias("n"), F.min(F.struct("id", "row", "row2", "start")).alias("first"))
    classes = stored(classes, "classes")
    several = classes.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    whole = classes.where("n > 1").select("g", "c", F.array(F.struct(F.lit(0).alias("s"), F.col("size").alias("e"))).alias("marks"))

    wanted = classes.join(several, "g").select(F.col("first.id").alias("id"), F.col("first.row").alias("row"), F.col("first.row2").alias("row2"), F.struct("g", "c", "size", "anchor", F.col("first.start").alias("start"), "members").alias("run"))
    wanted = wanted.groupBy("id", "row", "row2").agg(F.collect_list("run").alias("runs"))
    texts = base.join(wanted.select(F.col("id").alias("w_id"), F.col("row").alias("w_row"), F.col("row2").alias("w_row2"), "runs"), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row")) & (F.col("row2") == F.col("w_row2"))).select("text", "runs")
    kinds = {"g": pa.int64(), "c": pa.int64(), "size": pa.int32(), "anchor": pa.int32(), "members": pa.int64(), "lead": pa.binary(), "bytes": pa.binary()}

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", BLOCK):
            out = []
            for t, rs in zip(block.column("text").to_pylist(), block.column("runs").to_pylist(), strict=True):
                data = (t or "").encode()
                for r in rs:
                    a = r["start"] + r["anchor"]
                    out.append((r["g"], r["c"], r["size"], r["anchor"], r["members"], data[a : a + GRAM], data[r["start"] : r["start"] + r["size"] + length - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds.values(), strict=True)], list(kinds))

    contexts = stored(texts.mapInArrow(fetch, "g long, c long, size int, anchor int, members long, lead binary, bytes binary").dropDuplicates(["g", "c"]), "contexts")
    parts = _sorted_buckets(contexts.where(F.col("members") <= large), length)
    hot = contexts.where(F.col("members") > large)
    marks, halved = whole.unionByName(parts), _halved(hot, length)
    marks = marks if halved is None else marks.unionByName(halved)
    marks = marks.groupBy("g", "c").agg(F.flatten(F.collect_list("marks")).alias("marks"))

    spans = near.join(marks, ["g", "c"]).select("id", "row", "row2", F.explode("marks").alias("m"), "start", "size", "reps")
    # a run that follows itself is marked as a whole
    spans = spans.select("id", "row", "row2", F.struct((F.col("start") + F.col("m.s")).alias("s"), F.when(F.col("reps") > 1, F.col("start") + F.col("size") * F.col("reps") + (length - 1)).otherwise(F.col("start") + F.col("m.e") + (length - 1)).alias("e")).alias("span"))
    spans = spans.groupBy("id", "row", "row2").agg(F.collect_set("span").alias("__spans")).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("row2").alias("__row2"), "__spans")
    new = T.StructType.fromDDL("spans array<struct<s:int,e:int>>, n_bytes long, n_removed long, kept binary")
    old = [f for f in docs.schema.fields if f.name not in new.names]
    joined = docs.join(spans, ident.eqNullSafe(F.col("__id")) & (row == F.col("__row")) & (row2 == F.col("__row2")), "left")
    joined = joined.select(*[F.col(f"`{f.name}`") for f in old], text.alias("__text"), "__spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "__text"):
            made = []
            for t, found in zip(block.column("__text").to_pylist(), block.column("__spans").to_pylist(), strict=True):
                data, merged, kept, at = (t or "").encode(), [], [], 0
                for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                    if merged and s <= merged[-1]["e"]:
                        merged[-1]["e"] = max(merged[-1]["e"], e)
                    else:
                        merged.append({"s": s, "e": e})
                for m in merged:
                    kept.append(data[at : m["s"]])
                    at = m["e"]
                kept = b"".join([*kept, data[at:]])
                made.append((merged, len(data), len(data) - len(kept), kept))
            columns = [pa.array(x, k) for x, k in zip(zip(*made, strict=True), (_MARKS, pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[block.column(f.name) for f in old], *columns], [*[f.name for f in old], *new.names])

    return joined.mapInArrow(remove, T.StructType([*old, *new.fields]))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict, length: int = LENGTH) -> dict:
    """id -> (n_bytes, n_removed, n_spans, kept_sha256), by a table of all strings of `length` bytes."""
    from collections import Counter

    data = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(hash(b[i : i + length]) for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in data.items():
        flags = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                flags[i] += 1
                flags[i + length] -= 1
        gone = np.cumsum(flags)[: len(b)] > 0
        runs_ = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), runs_, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out
