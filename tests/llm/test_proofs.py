"""Queries' own results against plain versions on whole small tables; long texts, hot groups and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from graphweft.llm import bpe, decontaminate, language_id, line_dedup, near_dedup, quality_model, quality_rules, registry, suffix_dedup, token_store
from graphweft.llm.common import mix64
from graphweft.llm.vocab import vocab_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op5_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, at, want = Tokenizer.from_file(vocab_path(token_store.VOCABULARY)), 0, []
    for d in sorted(texts):
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = registry.QUERIES["op5_token_store"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_op7_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(vocab_path(bpe.VOCABULARY)), []
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for d in sorted(texts):
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    got = registry.QUERIES["op7_bpe"](spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_op8_equals_brute_force(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["op8_suffix_dedup"](spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == suffix_dedup.brute_force(texts)


def plain_features(text):
    """Buckets of a text's features, one word and one character at a time."""
    scramble = lambda x: int(mix64(np.array([x % 2**64], np.uint64))[0])
    value = lambda c: scramble(ord(c) + 1)
    words, out = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w], []
    base, gap = 0x5851F42D4C957F2D, 0x1234567
    keys = [scramble(sum(value(c) * pow(base, k, 2**64) for k, c in enumerate(w))) for w in words]
    out += [(k >> 47) % quality_model.BUCKETS for k in keys]
    for lag in quality_model.LAGS:
        out += [(scramble(lag) >> 47) % quality_model.BUCKETS for k in range(lag, len(words)) if words[k] == words[k - lag]]
    for size in quality_model.SIZES:
        for w in words:
            marked = [gap, *map(value, w), gap]
            for k in range(len(marked) - size + 1):
                key = 0
                for v in marked[k : k + size]:
                    key = (key * 0x100000001B3 + v) % 2**64
                out.append((scramble(key + size) >> 47) % quality_model.BUCKETS)
    return out


def test_op4_features_gradients_and_scores(spark, texts):
    sample = ["", "a", "Zürich  日本語 ab\tab ab", "é" * 5, *[(texts[d] or "")[:400] for d in sorted(texts)[:6]]]
    buckets, owner = quality_model.features(pa.array(sample))
    for k, t in enumerate(sample):
        assert sorted(buckets[owner == k].tolist()) == sorted(plain_features(t))
    r = np.random.default_rng(3)
    e, w, b, share = r.normal(size=(5, 4)), r.normal(size=(2, 4)), r.normal(size=2), np.array([0.3, 0.1, 0.2, 0.2, 0.2])
    loss, *found = quality_model.Model.gradients(e, w, b, share, 1)
    for x, g in zip((e, w, b), found, strict=True):
        for at in np.ndindex(x.shape):
            old, x[at] = x[at], x[at] + 1e-6
            assert abs((quality_model.Model.gradients(e, w, b, share, 1)[0] - loss) / 1e-6 - g[at]) < 1e-4
            x[at] = old
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = quality_model.fit(docs, labels.where(~quality_model.held_out()))
    got = {r.doc_id: r for r in registry.QUERIES["op4_quality_model"](spark, SMALL).collect()}
    assert set(got) == set(texts)
    for d in sorted(texts)[:25]:
        own = plain_features(texts[d] or "")
        z = model.weights.astype(float) @ model.vectors[own].astype(float).mean(0) + model.bias if own else model.bias.astype(float)
        p = np.exp(z - z.max())
        assert abs(got[d].score - p[1] / p.sum()) < 1e-3 and got[d].predicted == int(got[d].score >= 0.7) and got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_op4_held_out(spark):
    """Rows that taught nothing, on a table of a thousand."""
    big = "/root/testdata/sf0.01"
    got = registry.QUERIES["op4_quality_model"](spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert min(len(good), len(bad)) > 5 and np.mean([a > b for a in good for b in bad]) > 0.97 and np.mean([x >= 0.7 for x in good]) > 0.97


def test_op4_fit_is_bounded(spark):
    """An id in very many rows, and one text far beyond the bound on features."""
    r = random.Random(2)
    rows = [(k, "good words " + str(k) if k % 2 else "bad $$$ " + str(k)) for k in range(40)] + [(3, f"copy {k}") for k in range(3000)] + [(40, " ".join(str(r.random()) for _ in range(60000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(41)], "doc_id long, quality int")
    for most in (quality_model.TRAIN_FEATURES, 50):
        model = quality_model.fit(docs, labels, most_features=most)
        assert np.isfinite(model.table).all()


def test_op10_equals_plain_cosines(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    from pyspark.sql import functions as F

    model = language_id.fit(docs.where(~language_id.held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    code = language_id.LETTER_CODE

    def plain(text):
        data = [1, *[int(code[b]) for b in (text or "").encode()], 1]
        count = {}
        for size in language_id.SIZES:
            for k in range(len(data) - size + 1):
                if any(x > 1 for x in data[k : k + size]):
                    key = 0
                    for x in data[k : k + size]:
                        key = (key * 257 + x) % 2**64
                    h = (int(mix64(np.array([key + (size << 56)], np.uint64))[0]) >> 40) % language_id.BUCKETS
                    count[h] = count.get(h, 0) + 1
        v = np.zeros(language_id.BUCKETS)
        for h, n in count.items():
            v[h] = np.log1p(n) * model.idf[h]
        cos = model.centroids.astype(float) @ (v / max(np.linalg.norm(v), 1e-9))
        return model.names[model.owner[int(np.argmax(cos))]], float(np.clip(cos.max(), 0, 1))

    got = {r.doc_id: r for r in registry.QUERIES["op10_language_id"](spark, SMALL).collect()}
    for d in sorted(texts)[:40]:
        if not texts[d] or not any(c.isalpha() for c in texts[d]):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        name, score = plain(texts[d])
        assert got[d].lang_pred == name and abs(got[d].score - score) < 1e-4 and got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)


def test_op10_held_out(spark):
    big = "/root/testdata/sf0.01"
    got = registry.QUERIES["op10_language_id"](spark, big).where("held_out").join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("lang is not null").collect()
    judged = [r.lang_pred == r.lang for r in got if r.lang_pred != "und"]
    assert len(judged) > 100 and np.mean(judged) > 0.99


def test_op10_fit_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 30)
    rows = [(k, f"word{'abcdefgh'[k % 8] * 3} text", f"l{k % 8}" if k % 8 < 3 or k < 8 else "l0") for k in range(400)] + [(1, "same row", "l1")] * 500
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["l0", "l1", "l2"] and all(np.isfinite(model.centroids).ravel())


def test_sketches_decide(spark):
    """The same share of symbols is usual in one language and strange in the other; no constant could tell."""
    r = random.Random(4)

    def text(marks):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(r.randint(60, 200))]
        for _ in range(marks):
            words[r.randrange(len(words))] += "#"
        return " ".join(words)

    rows = [(k, text(r.randint(15, 60)), "code", "a") for k in range(400)] + [(400 + k, text(0), "prose", "a") for k in range(2600)]
    rows += [(3000, text(40), "code", "a"), (3001, text(40), "prose", "a"), (3002, text(0), "code", "a"), (3003, text(2), "prose", "a")]
    out = {x.doc_id: x.kept for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[3001] and out[3002] and out[3003] and all(out[k] for k in range(400, 3000))


def test_sketches_of_copies(spark):
    """A group whose low end and centre fall together, as copies make them, drops nothing for being shorter."""
    r = random.Random(5)
    rows = [(k, "long copied text of one source " * 1 + " ".join(f"w{j}" for j in range(90)), "en", "hot") for k in range(900)]
    rows += [(900 + k, " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(55)) + ("#" if k % 3 == 0 else ""), "en", "hot") for k in range(300)]
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert out.where("NOT kept").count() == 0


def test_window_shared_by_many_items(spark):
    """A thousand items with one window that a text holds thousands of times."""
    window = "this window of ten words is part of every item"
    items = [(str(k), f"first{k} {window} last{k}") for k in range(1000)]
    text = f"{window} x " * 5000
    docs = [(1, text), (2, "clean words only"), (3, f"a first7 {window} last7 b")]
    got = {r.doc_id: r for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    want = decontaminate.brute_force([docs[1], docs[2]], items)
    for d in (2, 3):
        assert (got[d].n_words, got[d].n_hit, sha(",".join(got[d]["items"]))) == want[d]
    assert (got[1].n_hit, len(got[1]["items"]), len(got[1].matches)) == (50000, 1000, 5000)
    assert got[3].longest == 12 and (got[3].matches[0].item_id, got[3].matches[0].item_word, got[3].matches[0].doc_word) == ("7", 0, 1)


def test_long_texts(spark):
    """One text of some megabytes among short ones, through every operator on texts."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    long_ = "\n".join(" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(30000))
    rows = [(1, long_, "en", "s"), (2, long_ + " end", "en", "s"), (3, "short text", "en", "s"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(1)
    assert {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(docs).collect()}[2] > 29000
    assert {x.id: x.component_id for x in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {x.doc_id: x.n_words for x in quality_rules.judge(docs).collect()}[1] == 360000
    removed = {x.doc_id: x.n_removed for x in suffix_dedup.find_repeats(docs).collect()}
    assert removed == {1: len(long_), 2: len(long_), 3: 0, 4: 0}
    item = " ".join(long_.split()[1000:1030])
    hit = {x.doc_id: x.n_hit for x in decontaminate.find_contamination(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()}
    assert hit == {1: 30, 2: 30, 3: 0, 4: 0}
    model = language_id.fit(docs.where("lang is not null"))
    assert {x.doc_id: x.lang_pred for x in language_id.predict(docs, model).collect()}[1] == "en"
    scored = quality_model.score_quality(docs, quality_model.fit(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")))
    assert all(0 <= x.score <= 1 for x in scored.collect())
    tokens = {x.doc_id: x.n_tokens for x in bpe.bpe_digests(docs.where("doc_id <> 2")).collect()}
    assert tokens[1] > 360000 and tokens[4] == 0


def test_pipeline_stages_at_the_edges(spark):
    """Null ids, languages and texts, repeated rows, ties, missing and clashing columns, and empty tables."""
    schema = "score double, doc_id long, n_lines string, text string, lang string, own_0 int, hash string, words string, rejected string"
    r = random.Random(8)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(60))
    rows = [(0.5, k, "clash", make("abcdef" if k % 2 else "mnopqr"), ("x", "y")[k % 2 == 0], k, "h", "w", "no") for k in range(60)]
    rows += [(None, 60, None, None, None, None, None, None, None), (None, None, None, make("abcdef"), None, 1, "h", "w", "r"), (0.1, 61, "c", "", "x", 1, "h", "w", "r"), rows[4], rows[5]]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "bpe":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert {x.own_0 for x in out.where("doc_id between 0 and 59").collect()} <= set(range(60)) and out.where("n_lines = 'clash' and hash = 'h' and score = 0.5").count() >= 58
        else:
            assert out.count() == docs.count() and out.where("doc_id = 60").first().n_tokens == 0
        assert stage(spark, none, SMALL).count() == 0
    known = pipeline.identify(spark, docs, SMALL)
    assert known.where("doc_id in (60, 61)").count() == 0 and known.where("doc_id is null").first().lang == "x" and known.where("doc_id = 4").count() == 2
    lines = pipeline.dedup_lines(spark, docs, SMALL)
    assert lines.where("doc_id = 60").first().text == "" and lines.where("doc_id = 4").count() == 2
    near = pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert near.where("doc_id in (60, 61)").count() == 2 and near.where("doc_id = 4").count() == 2


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_queries_of_empty_tables(spark, tmp_path, name):
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, f"file://{tmp_path}").count() == 0
