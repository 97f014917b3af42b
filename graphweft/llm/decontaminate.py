"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task cuts its rows into shards of a few MB, gives every word a number, and builds a word suffix array of
the shard. Every suffix of every test item is binary-searched in it. The array is sparse: it holds the suffixes
whose leading words lead some suffix of an item, since no other can match; it is sorted to the depth of the
longest item. No shuffle is needed while the items fit in one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.common import bounded_batches, byte_words, cut, table, text_blocks, text_bytes

#: Bytes of item text in one broadcast block; more items take more passes.
ITEM_BLOCK_BYTES = 16 << 20
#: Bytes of training text in one suffix array.
SHARD_BYTES = 2 << 20
#: Suffixes enter the array by so many leading words at most.
LEAD = 3

_SPANS = "array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"


def _word_code() -> np.ndarray:
    """Lower-cases A-Z; digits, letters and bytes from 0x80 are words, all else parts them."""
    code = np.arange(256, dtype=np.uint8)
    code[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return np.where(word, code, 0).astype(np.uint8)


WORD_CODE = _word_code()


class Items:
    """Test items as word numbers, one after the other, each followed by -1."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        hashes, of, _, _ = byte_words(data, offsets, WORD_CODE)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        self.counts = np.bincount(of, minlength=len(ids)).astype(np.int64)
        self.ids = np.array(ids, object)
        self.window = window
        starts = np.cumsum(self.counts) - self.counts
        self.words = np.full(int(self.counts.sum()) + len(ids) + 1, -1, np.int64)
        at = np.arange(len(numbers)) + of  # one gap after each item
        self.words[at] = numbers
        size = np.minimum(self.counts, window)  # words in a window
        last = self.counts - size
        #: Searched suffixes: those that hold a whole window.
        per = np.where(self.counts > 0, last + 1, 0)
        item = np.repeat(np.arange(len(ids)), per)
        word = np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
        start, length = (starts + np.arange(len(ids)))[item] + word, size[item]
        self.first = starts + np.arange(len(ids))
        #: Equal windows are searched once: a class has the places of its windows, in ascending order.
        self.places, edge = _classes(self.words, start, length, window)
        self.edge = np.append(edge, len(self.places))
        self.start, self.size = self.places[edge], length[np.searchsorted(start, self.places[edge])]
        self.depth = int(self.counts.max()) if len(ids) else 0
        self.lead = int(min([LEAD, *size[size > 0]])) if (size > 0).any() else 0
        self.leads = np.unique(self._key(self.words, self.start)) if self.lead else np.zeros(0, np.int64)

    def holders(self, classes: np.ndarray) -> np.ndarray:
        """Items that hold any of these classes' windows."""
        if not len(classes):
            return np.zeros(0, np.int64)
        places = np.concatenate([self.places[self.edge[c] : self.edge[c + 1]] for c in classes.tolist()])
        return np.unique(np.searchsorted(self.first, places, side="right") - 1)

    def matches(self, words: np.ndarray, at: np.ndarray, of: np.ndarray) -> list[tuple]:
        """Verbatim matches (item, word in the item, place, words) that cover windows of classes `of` found `at` places.

        From left to right: the items' places that hold the window are followed while any goes on, and the first that
        lasts longest is the match, grown to the left as far as it goes. The next begins at the first window after it.
        """
        out, k, n = [], 0, len(at)
        at_, of_ = at.tolist(), of.tolist()
        while k < n:
            held = self.places[self.edge[of_[k]] : self.edge[of_[k] + 1]]
            last = k
            while last + 1 < n and at_[last + 1] == at_[last] + 1:
                follow = self.places[self.edge[of_[last + 1]] : self.edge[of_[last + 1] + 1]]
                near = np.minimum(np.searchsorted(follow, held + 1), len(follow) - 1)
                going = held[follow[near] == held + 1] + 1
                if not len(going):
                    break
                held, last = going, last + 1
            place = int(held[0]) - (last - k)
            item = int(np.searchsorted(self.first, place, side="right")) - 1
            begin, back = at_[k], 0
            while place - back > self.first[item] and begin - back > 0 and words[begin - back - 1] == self.words[place - back - 1] and words[begin - back - 1] >= 0:
                back += 1
            out.append((item, place - back - int(self.first[item]), begin - back, at_[last] - begin + back + int(self.size[of_[last]])))
            k = last + 1
        return out

    def _key(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), np.uint64)
        for d in range(self.lead):
            key = key * np.uint64(0x9E3779B97F4A7C15) + (words[at + d] + 1).astype(np.uint64)
        return key

    def suffix_array(self, words: np.ndarray) -> np.ndarray:
        """Starts of the suffixes of `words` that may match, in the order of their words."""
        at = np.flatnonzero(words[: len(words) - self.lead] >= 0)
        for d in range(1, self.lead):
            at = at[words[at + d] >= 0]
        key = self._key(words, at)
        near = np.minimum(np.searchsorted(self.leads, key), len(self.leads) - 1)
        at = at[self.leads[near] == key]
        return sort_suffixes(words, at, self.depth, self.window)

    def search(self, words: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each searched suffix, the range of `suffixes` that begins with its window."""
        low, high = (self._bound(words, suffixes, after) for after in (False, True))
        return low, high

    def _bound(self, words: np.ndarray, suffixes: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(self.start), np.int64), np.full(len(self.start), len(suffixes), np.int64)
        last = len(words) - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            text = suffixes[np.minimum(mid, len(suffixes) - 1)]
            sign = np.zeros(len(lo), np.int8)
            for d in range(self.window):
                here = (sign == 0) & (d < self.size)
                if not here.any():
                    break
                a, b = words[np.minimum(text + d, last)], self.words[np.minimum(self.start + d, len(self.words) - 1)]
                sign = np.where(here, np.sign(a - b), sign).astype(np.int8)
            right = (sign < 0) | ((sign == 0) & after)
            lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        return lo


def _classes(words: np.ndarray, start: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows, equal ones together and ascending; and where each class of equals begins."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = len(words) - 1
    columns = [np.where(d < size, words[np.minimum(start + d, last)], -2) for d in range(window)]
    by = np.lexsort([start, *reversed(columns)])
    fresh = np.zeros(len(by), bool)
    fresh[0] = True
    for c in columns:
        fresh[1:] |= c[by][1:] != c[by][:-1]
    return start[by], np.flatnonzero(fresh)


def sort_suffixes(words: np.ndarray, at: np.ndarray, depth: int, step: int) -> np.ndarray:
    """Order suffix starts by their first `depth` words, refining only the ties, `step` words at a time."""
    last = len(words) - 1
    order, group, done = at, np.zeros(len(at), np.int64), 0
    tied = np.arange(len(at))
    while len(tied) > 1 and done < depth:
        upto = min(done + step, depth)
        part, own = order[tied], group[tied]
        columns = [words[np.minimum(part + d, last)] for d in range(done, upto)]
        by = np.lexsort([*reversed(columns), own])
        order[tied] = part[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = own[by][1:] != own[by][:-1]
        for c in columns:
            fresh[1:] |= c[by][1:] != c[by][:-1]
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.append(first, len(tied)))
        group[tied] = np.repeat(tied[first], sizes)
        ended = np.repeat(columns[-1][by][first] < 0, sizes)  # past the text's or the vocabulary's end: no item goes on
        tied = tied[(np.repeat(sizes, sizes) > 1) & ~ended]
        done = upto
    return order


def scan_shard(items: Items, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[tuple]]]:
    """For each text its words, those hit, the items found, and verbatim matches (item, word in the item, word in the text, words).

    What is held grows with the shard and the items found, not with items times occurrences.
    """
    data, offsets = text_bytes(texts)
    hashes, of, _, _ = byte_words(data, offsets, WORD_CODE)
    counts = np.bincount(of, minlength=len(texts)).astype(np.int64)
    hit, ids, found = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
    if not items.lead or not len(hashes):
        return counts, hit, ids, found
    near = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    numbers = np.where(items.vocabulary[near] == hashes, near, -1)
    words = np.full(len(numbers) + len(texts) + items.lead + 1, -1, np.int64)
    words[np.arange(len(numbers)) + of] = numbers  # a gap after each text: no match goes across
    suffixes = items.suffix_array(words)
    if not len(suffixes):
        return counts, hit, ids, found
    low, high = items.search(words, suffixes)
    n = high - low
    kind = np.repeat(np.arange(len(n)), n)
    if not len(kind):
        return counts, hit, ids, found
    # a place holds one class of each window size
    at = suffixes[np.arange(len(kind)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    by = np.lexsort((items.size[kind], at))
    at, kind = at[by], kind[by]
    size = items.size[kind]
    flags = np.zeros(len(words) + 1, np.int64)
    np.add.at(flags, at, 1)
    np.add.at(flags, at + size, -1)
    text_start = np.cumsum(counts) - counts + np.arange(len(texts))
    hit = np.add.reduceat(np.cumsum(flags)[: len(words)] > 0, text_start).astype(np.int64)
    text = np.searchsorted(text_start, at, side="right") - 1
    edges = np.append(np.flatnonzero(np.append(True, text[1:] != text[:-1])), len(text))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        t = int(text[a])
        ids[t] = sorted({items.ids[i] for i in items.holders(np.unique(kind[a:b])).tolist()})
        matched = []
        for z in np.unique(size[a:b]).tolist():
            mine = slice(a, b) if (size[a:b] == z).all() else a + np.flatnonzero(size[a:b] == z)
            matched += items.matches(words, at[mine], kind[mine])
        found[t] = [(items.ids[i], w, p - int(text_start[t]), k) for i, w, p, k in matched]
    return counts, hit, ids, found


def covered(matches: list[tuple]) -> int:
    """Words of the text inside any match."""
    total, end = 0, 0
    for _, _, at, n in sorted(matches, key=lambda m: m[2]):
        total += max(0, at + n - max(at, end))
        end = max(end, at + n)
    return total


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, most: int) -> Iterator[tuple[list[str], list[str]]]:
    """The query set in blocks of bounded size; only one is held at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{item_text}`")).toLocalIterator():
        if row[0] is None or row[1] is None:
            continue
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` with n_words, n_hit, items (sorted), longest and matches (these replace columns of those names).

    A window is `window` consecutive words of an item, or all words of a shorter one. A word inside any occurrence
    of a window is hit. matches holds verbatim matches with their places that cover all hit words, each as long as one
    item goes on, from left to right; longest is the longest of them. Items that share a window are searched as one and
    all named in items. A null or wordless text has
    no words and no hits; items that are null, have no id or no words match nothing; items that repeat are found
    each by its own id. Rows are judged one by one, so repeated rows and ids, null ids and ties change nothing.
    """
    own = {"n_words", "n_hit", "items", "longest", "matches"}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    out, following = _pass(kept, Items(*next(blocks), window), text_col, 0), 0
    for ids, texts in blocks:
        if ids:
            following += 1
            out = cut(_pass(out, Items(ids, texts, window), text_col, following))
    return out


def _pass(docs: DataFrame, items: Items, text_col: str, number: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(items)
    old = [f for f in docs.schema.fields if f.name not in ("n_words", "n_hit", "items", "longest", "matches")]
    schema = T.StructType([*old, *T.StructType.fromDDL(f"n_words long, n_hit long, items array<string>, longest int, matches {_SPANS}")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_col, SHARD_BYTES):
            counts, hit, ids, found = scan_shard(sent.value, block.column(text_col))
            if number:
                # a match holds all words that its block's items hit
                found = [[*map(lambda m: tuple(m.values()), was), *now] for was, now in zip(block.column("matches").to_pylist(), found, strict=True)]
                hit = np.array([covered(m) for m in found], np.int64)
                ids = [sorted({*was, *now}) for was, now in zip(block.column("items").to_pylist(), ids, strict=True)]
            names = ("item_id", "item_word", "doc_word", "n_words")
            yield pa.RecordBatch.from_arrays(
                [
                    *[block.column(f.name) for f in old],
                    pa.array(counts, pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array(ids, pa.list_(pa.string())),
                    pa.array([max((x[3] for x in m), default=0) for m in found], pa.int32()),
                    pa.array([[dict(zip(names, x, strict=True)) for x in m] for m in found], pa.list_(pa.struct([("item_id", pa.string()), *[(n, pa.int32()) for n in names[1:]]]))),
                ],
                [*[f.name for f in old], "n_words", "n_hit", "items", "longest", "matches"],
            )

    return docs.mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with their own columns, that hold no window of any item."""
    return find_contamination(docs, benchmark, **options).where("n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE = f"""
WITH d AS (SELECT doc_id, {_words_sql("text")} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql("text")} AS ws FROM benchmark),
k AS (SELECT item, ws, least(10, len(ws)) AS z, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, z, array_to_string(ws[i:i + z - 1], ' ') AS w FROM k),
sizes AS (SELECT DISTINCT z FROM win),
places AS (SELECT doc_id, ws, z, unnest(range(1, len(ws) - z + 2)) AS i FROM d, sizes WHERE len(ws) >= z),
hit AS (SELECT a.doc_id, a.i, a.z, win.item FROM places a JOIN win ON win.z = a.z AND win.w = array_to_string(a.ws[a.i:a.i + a.z - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + z)) AS p FROM (SELECT DISTINCT doc_id, i, z FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.list, '')) AS items_sha256, pos.n IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def brute_force(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """doc id -> (n_words, n_hit, items_sha256), by comparing every window with every place."""
    import re

    def words(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for i, text in items:
        w = words(text)
        size = min(len(w), window)
        for j in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + size]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for p in range(len(w)):
            for n in sizes:
                if (got := windows.get(tuple(w[p : p + n]))) and p + n <= len(w):
                    hit |= {*range(p, p + n)}
                    found |= got
        out[d] = (len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
