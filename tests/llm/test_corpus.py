"""Each operator against brute force or a library, with nulls, empties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.llm import bpe, decontaminate, language_id, line_dedup, near_dedup, quality_model, quality_rules, suffix_dedup, token_store, warc
from graphweft.llm.vocab import vocab_path

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, row string, id string, spans string, items string"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus():
    r = random.Random(4)
    base = words(r, 300)
    passage = words(r, 80)
    texts = [None, "", " ", "\n\n", "a", "ÄÖ ü", base, base, base + " tail", words(r, 2000) + "\nshared line of text\n" + passage, passage + "\nshared line of text\nother", "Shared Line of TEXT  \nnew"]
    texts += [" ".join(w if r.random() > 0.01 else "edit" + str(k) for w in base.split()) for k in range(12)]
    texts += [words(r, 60) for _ in range(20)]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}", "clash", "clash", "clash", "clash", "clash") for k, t in enumerate(texts)]
    return rows + [rows[6], (6, "another text of id six", "de", None, None, None, None, None, None), (None, "shared line of text", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == docs.count() and line_dedup.dedup_lines(none).count() == 0
    holders = {}
    for d, t, *_ in corpus():
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").lower() if line.isascii() else line.strip()
            if len(key) >= 10 and d is not None:
                holders.setdefault(key, set()).add(d)
    for row, (d, t, *_) in zip(sorted(out, key=lambda x: (x.doc_id is None, x.doc_id or 0, x.n_lines, x.text)), sorted(corpus(), key=lambda x: (x[0] is None, x[0] or 0, (x[1] or "").count("\n"), x[1] or "")), strict=True):
        kept = [x for x in (t or "").split("\n") if not (d is not None and len(h := holders.get(x.strip(" \t\n\x0b\x0c\r").lower(), set())) > 1 and d != min(h))]
        if d != 6:
            assert row.text == "\n".join(kept) and row.n_dropped == (t or "").count("\n") + 1 - len(kept)


def brute_near(rows, size):
    sets = []
    for d, t in rows:
        w = (t or "").lower().split()
        sets.append((d, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (di, a) in enumerate(sets):
        for j, (dj, b) in enumerate(sets[:i]):
            if di is not None and dj is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least[find(i)] if d is not None else None) for i, (d, s) in enumerate(sets)), key=str)


def test_near_dedup(docs, none):
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, words=4).collect()), key=str)
    assert got == brute_near([(r[0], r[1]) for r in corpus()], 4)
    assert near_dedup.near_duplicates(none).count() == 0
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.where("doc_id = 7").count() == 0 and left.where("doc_id is null").count() == 1


@pytest.mark.parametrize("few,splits,rare", [(128, 2, 32), (1, 1, 1)])
def test_near_dedup_of_many_strays(spark, monkeypatch, few, splits, rare):
    """A group around a text that is not there, whose members stray by up to half: all paths of the residue."""
    for name, value in (("FEW", few), ("SPLITS", splits), ("RARE", rare)):
        monkeypatch.setattr(near_dedup, name, value)
    r = random.Random(5)
    base = words(r, 120).split()
    rows = [(k, " ".join(w if r.random() > k / 2500 else f"e{r.randint(0, 40)}" for w in base)) for k in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)
    assert sorted(((x.id, x.n_shingles, x.component_id) for x in got.collect()), key=str) == brute_near(rows, 4)


def test_bayes_bounds():
    least = near_dedup.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.8 * near_dedup.HASHES


def test_quality_rules(docs, none):
    out = {(r.doc_id, r.row_key): r for r in quality_rules.judge(docs).collect()}
    assert quality_rules.judge(none).count() == 0 and quality_rules.filter_quality(docs).columns == docs.columns
    r = next(v for k, v in out.items() if k[0] == 9)
    assert r.n_words == 2000 + 4 + 80 and not r.base_failed and r.kept
    assert all(v.base_failed for v in out.values() if v.n_words < 50)


def test_quality_rules_counts(spark):
    text = "a b c a b c d\nx # $ <y>\n\n a b c a b c d\nx # $ <y>"
    r = quality_rules.with_metrics(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert (r[0].n_words, r[0].n_symbols, r[0].n_dup_lines, r[0].n_word_lines) == (22, 8, 1, 4) and r[0].n_repeat_words == 22
    assert (r[1].n_words, r[1].word_chars, r[1].n_repeat_words) == (0, 0, 0)


def test_quality_rules_of_a_bad_source(spark):
    """Bad texts are dropped however many of their source they are."""
    r = random.Random(8)
    rows = []
    for source, n, bad in (("third", 1000, 350), ("most", 300, 270), ("good", 1700, 0)):
        for k in range(n):
            text = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) + ("#$%" * r.randint(1, 2) if k < bad and r.random() < 0.9 else "") for _ in range(55))
            rows.append((len(rows), text, "en", source, k < bad))
    alone = rows[:1000]
    for part in (rows, alone):
        out = {x.doc_id: x for x in quality_rules.judge(spark.createDataFrame(part, "doc_id long, text string, lang string, source string, bad boolean")).collect()}
        assert not any(x.base_failed for x in out.values())
        assert [d for d, _, _, _, bad in part if out[d].kept == bad] == []


def test_quality_model(spark, docs, none):
    r = random.Random(1)
    rows = [(k, words(r, 80) if k % 3 else "spam $$$ " * 40) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_model.fit(table, labels)
    scored = quality_model.score_quality(table, model).where("doc_id >= 200").collect()
    assert np.mean([x.predicted == int(x.doc_id % 3 > 0) for x in scored]) > 0.95
    assert all(0 <= x.score <= 1 for x in quality_model.score_quality(docs, model).collect())
    assert quality_model.score_quality(none, model).count() == 0
    assert quality_model.fit(none, labels).score(__import__("pyarrow").array(["x"]))[0] == 0.5


def test_token_store(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    token_store.write_tokens(docs, f"file://{tmp_path}/a")
    got = token_store.read_tokens(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    tokenizer, at = Tokenizer.from_file(vocab_path(token_store.VOCABULARY)), 0
    for r, (d, t, *_) in zip(got, sorted(corpus(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (d, at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_store.write_tokens(none, f"file://{tmp_path}/b")
    assert token_store.read_tokens(spark, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("n,most", [(1, 1), (700, 5000), (700, 100), (3, 10**9), (2000, 1)])
def test_elias_fano(n, most):
    v = np.sort(np.random.default_rng(n).integers(0, most, n))
    ef = token_store.EliasFano.encode(v)
    assert (ef.select(np.arange(n)) == v).all() and [int(ef.select(i)[0]) for i in range(n)] == v.tolist()


ALPHABET = ["a", "B", "é", " ", "  ", "\n", "\t", "\xa0", "'s", "’", "12", "²", "<|endoftext|>", "日本", "!", "...", "_", "\x1c", "ǅ", "Σ", "İ", "'LL", "\x85", "]", "^"]


def test_tokenizers_agree():
    from tokenizers import Tokenizer

    r = random.Random(2)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    ours, library = token_store.WordEncoder(vocab_path(token_store.VOCABULARY)), Tokenizer.from_file(vocab_path(token_store.VOCABULARY))
    assert [np.frombuffer(b, ours.dtype).tolist() for b in ours.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    own, library = bpe.WordBPE(vocab_path(bpe.VOCABULARY)), Tokenizer.from_file(vocab_path(bpe.VOCABULARY))
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.forms(t) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))


def test_bpe(docs, none):
    out = bpe.bpe_digests(docs).where("doc_id = 0 or text = ''").collect()
    assert all(r.n_tokens == 0 and r.ids_sha256 == hashlib.sha256(b"").hexdigest() for r in out) and bpe.bpe_tokens(none).count() == 0


@pytest.mark.parametrize("block", [decontaminate.ITEM_BLOCK_BYTES, 1])
def test_decontaminate(spark, docs, none, block):
    full = corpus()[9][1].split("\n")[2]
    items = [("long", full), ("part", " ".join(full.split()[10:25]).upper()), ("short", "tail"), ("null", None), ("blank", " "), (None, "a"), ("again", "tail")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_contamination(docs, bench, block_bytes=block).collect()
    want = decontaminate.brute_force([(k, r[1]) for k, r in enumerate(corpus())], [i for i in items if i[0] is not None])
    digest = lambda r: (r.n_words, r.n_hit, hashlib.sha256(",".join(r["items"]).encode()).hexdigest())
    assert sorted(map(digest, got)) == sorted(want.values())
    assert decontaminate.find_contamination(none, bench).count() == 0
    clean = decontaminate.find_contamination(docs, bench.limit(0))
    assert clean.where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns


@pytest.mark.parametrize("large", [1024, 1])
def test_suffix_dedup(spark, docs, none, large):
    r = random.Random(3)
    p, q = words(r, 60), words(r, 40)
    rows = [p, "x " + p + " y", p[30:] + q, q + p[:260] + q, "ab" * 400, "z" * 900, None, "", p[:199], words(r, 300), words(r, 10) + p[5:290] + words(r, 10), p + "\n" + p]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), hashlib.sha256(x.kept).hexdigest()) for x in suffix_dedup.find_repeats(table, large=large).collect()}
    assert got == suffix_dedup.brute_force(dict(enumerate(rows)))
    out = suffix_dedup.find_repeats(docs, large=large)
    assert out.count() == docs.count() and suffix_dedup.find_repeats(none).count() == 0


def test_warc(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"<p>é{k}</p>" * (k % 5)) for k in range(-40, 2100, 7)] + [(3, None, None), (3, None, None), (None, "u", "h"), (14, "http://x/14", "other")]
    records = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert records.count() == len(rows) and warc.audit(records, records).count() == 0
    wrong = sorted(r.key for r in warc.audit(records, warc.damaged(records)).collect())
    assert wrong == sorted({k for k, _, _ in rows if k is not None and k % 50 == 7})
    assert [r.key for r in warc.audit(records, records.where("id is null or id <> 16")).collect()] == [16]
    warc.write_files(records, f"file://{tmp_path}/w")
    back = warc.read_files(spark, f"file://{tmp_path}/w")
    own = records.withColumn("record", F.col("record").cast("binary")).select("id", "shard", "start", "length", "record")
    assert sorted(map(str, back.drop("valid").collect())) == sorted(map(str, own.collect())) and back.where("NOT valid").count() == 0
    assert warc.audit(records, back).count() == 0
    warc.write_files(warc.damaged(back), f"file://{tmp_path}/x", placed=True)
    spoilt = warc.read_files(spark, f"file://{tmp_path}/x")
    assert sorted(r.key for r in warc.audit(back, spoilt).collect()) == wrong and spoilt.where("NOT valid").count() == len(wrong)
    empty = warc.archive(spark.createDataFrame([], "page_id long, url string, html string, length int, record string"))
    warc.write_files(empty, f"file://{tmp_path}/e")
    assert warc.audit(empty, records.limit(0)).count() == 0 and warc.read_files(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_bodies_that_hold_heads(spark, tmp_path):
    """Bodies with record heads, blank lines and binary-like text; addresses with line breaks; a truncated file."""
    inner = "WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a\r\nContent-Length: 1", inner), (2, "b", "\r\n\r\n" + inner * 3), (3, None, "\n\n\x00é"), (4, "c", ""), (5, "d", "x" * 100)]
    records = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.write_files(records, f"file://{tmp_path}/w")
    back = {r.id: r for r in warc.read_files(spark, f"file://{tmp_path}/w").collect()}
    assert set(back) == {1, 2, 3, 4, 5} and all(r.valid for r in back.values())
    for ident, _, html in rows:
        assert bytes(back[ident].record).endswith((html + "\r\n\r\n").encode())
    whole = b"".join(bytes(back[k].record) for k in sorted(back))
    cut = list(warc.split_records(whole[:-50]))
    assert [x[2] for x in cut] == [1, 2, 3, 4, 5] and [x[3] for x in cut] == [True] * 4 + [False] and sum(x[1] for x in cut) == len(whole) - 50


def test_language_id(spark, docs, none):
    r = random.Random(7)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(k, make("abcdéf" if k % 2 else "mnopqr", 40), "x" if k % 2 else "y") for k in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table.where("doc_id < 80"))
    got = language_id.predict(table.where("doc_id >= 80"), model).collect()
    assert all(x.lang_pred == x.lang and 0 <= x.score <= 1 and not x.rejected for x in got)
    for x in language_id.predict(docs, model).collect():
        if not x.text or not any(c.isalpha() for c in x.text):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0.0, True)
    assert language_id.predict(none, model).count() == 0
    empty = language_id.fit(none)
    assert {x.lang_pred for x in language_id.predict(docs, empty).collect()} == {"und"}


def test_language_id_of_a_long_text(spark):
    """One n-gram that occurs more often than a half-precision number can tell."""
    r = random.Random(9)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(k, make("abcdef" if k % 2 else "mnopqr", 40), "x" if k % 2 else "y") for k in range(60)] + [(60, make("abcdef", 500) * 800, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table)
    assert np.isfinite(model.centroids).all() and np.isfinite(model.least).all()
    got = language_id.predict(table, model).collect()
    assert all(x.lang_pred == x.lang and 0 < x.score <= 1 and not x.rejected for x in got)


def test_language_id_fits_the_same_rows_in_parts(spark, monkeypatch):
    rng, rows = random.Random(3), []
    for i in range(300):
        rows.append((i % 250, " ".join("".join(rng.choices("abcdefgh" if i % 10 else "mnopqrst", k=5)) for _ in range(8)), "xx" if i % 10 else "yy"))
    table = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, lang string")
    models = []
    for parts in (1, 64):
        monkeypatch.setattr(language_id, "PARTS", parts)
        models.append(language_id.fit(table, per_language=20))
    assert models[0].names == models[1].names == ["xx", "yy"]
    assert np.array_equal(models[0].centroids, models[1].centroids) and np.array_equal(models[0].least, models[1].least)


def test_language_id_rejects_by_distance(spark):
    """Texts of a language that was not learned and random letters go; held-out texts of those learned stay."""
    r = random.Random(10)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").cache()
    model = language_id.fit(docs.where(~language_id.held_out() & (F.col("lang") != "fr")))
    noise = [(-k, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)), "noise") for k, n in enumerate([5, 30, 150, 1000] * 5)]
    far = {}
    for x in language_id.predict(docs.where(language_id.held_out() | (F.col("lang") == "fr")).union(spark.createDataFrame(noise, docs.schema)), model).collect():
        if len(x.text.split()) >= 30 or x.lang == "noise":
            far.setdefault(x.lang, []).append(x.rejected)
    assert all(far["noise"]) and np.mean(far["fr"]) > 0.95
    assert not any(far["en"] + far["de"] + far["es"])


def test_pipeline(spark):
    """run() against its stages' brute-force versions on the smallest tables."""
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in c.run(spark, d).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    docs = {k: t for k, t in docs.items() if any(x.isalpha() for x in t)}
    holders = {}
    low = lambda x: "".join(y.lower() if y.isascii() else y for y in x.strip(" \t\n\x0b\x0c\r"))
    for k, t in docs.items():
        for line in t.split("\n"):
            holders.setdefault(low(line), set()).add(k)
    docs = {k: "\n".join(x for x in t.split("\n") if len(low(x)) < 10 or min(holders[low(x)]) == k) for k, t in docs.items()}
    docs = {k: docs[k] for k, _, m in brute_near(sorted(docs.items()), 5) if k == m}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    hit = decontaminate.brute_force(list(docs.items()), bench)
    docs = {k: t for k, t in docs.items() if not hit[k][1]}
    assert set(out) == set(docs)
    tokenizer = Tokenizer.from_file(vocab_path(bpe.VOCABULARY))
    for k, t in docs.items():
        assert out[k].ids == " ".join(map(str, tokenizer.encode(t, add_special_tokens=False).ids))


def test_queries_read_whole_tables(spark):
    from graphweft.llm import registry

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    assert len(registry.QUERIES) == 10
    for name in ("op3_quality_rules", "op4_quality_model", "op10_language_id"):
        out = registry.QUERIES[name](spark, d)
        assert out.count() == n and out.select("doc_id").distinct().count() == n
    assert F is not None
