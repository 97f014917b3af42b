"""Quality rules whose thresholds follow the corpus, from mergeable quantile sketches per language and source.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.llm.common import cut, row_key, table

SPACE = "[ \\t-\\r]+"
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 3
#: Metric -> (count, what it is a share of, widths). High shares are bad. A limit lies so many widths above the centre of
#: the logarithms of its group's shares; a width is how far the low end lies below the centre.
METRICS = {
    "symbols": ("n_symbols", "word_chars", 4),
    "dup_lines": ("n_dup_lines", "n_word_lines", 2),
    "repeats": ("n_repeat_words", "n_words", 8),
}
#: Low end and centre in hundredths of a group's rows. Both lie low, so that bad rows, whose shares are high, move them
#: little even where they are a third of all.
LOW, CENTRE = 5, 25
#: Buckets of the sketches for each doubling of a share.
STEPS = 8
#: A group's sketch is merged with its language's as if that had this many rows, and a language's with that of all.
PRIOR_ROWS = 100
#: A text's share counts less so many standard deviations of its count: few hits are no sign.
DOUBT = 2.0


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with n_words, word_chars, n_symbols, n_dup_lines, n_word_lines and n_repeat_words.

    Repeats are found by sorting each text's hashed windows, so the work is n log n in its words.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    step = docs.withColumns({
        "__words": F.array_remove(F.split(text, SPACE, -1), ""),
        "__lines": F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
    })
    words = F.col("__words")

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + d) for d in range(WINDOW)])

    last = F.size(words) - WINDOW
    step = step.select(
        *docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_word_lines", "n_repeat_words").columns, "word_chars", "n_symbols",
        F.size(words).cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_word_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(F.array().cast("array<bigint>")).alias("__hashes"),
    )
    hashes = F.col("__hashes")
    pairs = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.withColumn("__pairs", pairs).drop("__hashes")
    sorted_ = F.col("__pairs")

    def again(x: Column, k: Column) -> Column:
        # get() past either end is null
        return F.coalesce(F.get(sorted_, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_, k + 1)["h"] == x["h"], F.lit(False))

    starts = F.filter(sorted_, again)
    places = F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(*[x["i"] + d for d in range(WINDOW)]))))
    return step.withColumn("n_repeat_words", F.coalesce(F.when(sorted_.isNotNull(), F.size(places)), F.lit(0)).cast("long")).drop("__pairs")


def share_level(count: str, total: str) -> Column:
    """The bucket of a share: whole steps of its logarithm, half a hit added, so that texts without hits differ by length."""
    share = (F.col(count) + 0.5) / (F.col(total) + 1)
    return F.floor(F.log2(share) * STEPS + 1e-9).cast("long")


def _blended(own: DataFrame, wide: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """Sketches of `own` groups, each merged with the one of `wide` above it at the weight of PRIOR_ROWS rows.

    Weights are whole numbers: a row counts as many as `wide` has rows.
    """
    whole = wide.groupBy(*shared, "metric").agg(F.sum("n").alias("total")).select(*[F.col(k).alias(f"t_{k}") for k in shared], F.col("metric").alias("t_metric"), "total")
    above = wide.select(*[F.col(k).alias(f"w_{k}") for k in shared], F.col("metric").alias("w_metric"), F.col("level").alias("w_level"), F.col("n").alias("w_n"))

    def same(prefix: str) -> Column:
        cond = F.col("metric") == F.col(f"{prefix}_metric")
        for k in shared:
            cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}_{k}"))
        return cond

    exact = "decimal(19,0)"
    mine = own.join(whole, same("t")).select(*keys, "metric", "level", (F.col("n").cast(exact) * F.col("total").cast(exact)).alias("w"))
    lent = own.select(*keys, "metric").distinct().join(above, same("w")).select(*keys, "metric", F.col("w_level").alias("level"), (F.col("w_n").cast(exact) * F.lit(PRIOR_ROWS).cast(exact)).alias("w"))
    return mine.unionByName(lent).groupBy(*keys, "metric", "level").agg(F.sum("w").alias("n"))


def _limits(sketches: DataFrame, keys: list[str], name: str) -> DataFrame:
    """For each group and metric the highest bucket that is no outlier, from the buckets of its low end and centre."""
    group = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(group.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    placed = sketches.withColumns({"upto": upto, "total": F.sum("n").over(group)})

    def at(percent: int) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("level")))

    ends = placed.groupBy(*keys, "metric").agg(at(LOW).alias("low"), at(CENTRE).alias("centre"))
    widths = F.create_map(*[F.lit(x) for m, (_, _, w) in METRICS.items() for x in (m, w)])
    return ends.select(*keys, "metric", (F.col("centre") + F.element_at(widths, F.col("metric")) * (F.col("centre") - F.col("low"))).alias(name))


def thresholds(counts: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per (language, source): g_lang, g_source and for each metric the bucket of the highest share allowed.

    A sketch is a histogram of logarithmic buckets: it merges by adding, gives each quantile to within one bucket (a
    factor of 2 ** (1 / STEPS)) and stays the same when a task is run again. Rows are counted into their group's
    buckets before the shuffle, so a source with a third of all rows is not hot; what follows has a few hundred rows
    for each group at most.

    No group's limit is above its language's or that of all documents, so bad rows widen the limit that judges them
    only where they are many in all of these. Null languages and sources are groups of their own.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), share_level(c, t).alias("level")) for m, (c, t, _) in METRICS.items()]))
    per = counts.select(F.col(f"`{lang_col}`").alias("g_lang"), F.col(f"`{source_col}`").alias("g_source"), rows.alias("x")).groupBy("g_lang", "g_source", "x.metric", "x.level").agg(F.count(F.lit(1)).alias("n"))
    per = cut(per)
    langs = per.groupBy("g_lang", "metric", "level").agg(F.sum("n").alias("n"))
    whole = per.groupBy("metric", "level").agg(F.sum("n").alias("n"))
    own = _limits(_blended(per, langs, ["g_lang", "g_source"], ["g_lang"]), ["g_lang", "g_source"], "own")
    lang = _limits(_blended(langs, whole, ["g_lang"], []), ["g_lang"], "lang").select(F.col("g_lang").alias("l_lang"), F.col("metric").alias("l_metric"), "lang")
    every = _limits(whole, [], "every").select(F.col("metric").alias("e_metric"), "every")
    all_ = own.join(lang, F.col("g_lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(every, F.col("metric") == F.col("e_metric"))
    most = F.least("own", "lang", "every")
    return all_.groupBy("g_lang", "g_source").agg(*[F.max(F.when(F.col("metric") == m, most)).alias(f"most_{m}") for m in METRICS])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 50) -> DataFrame:
    """One row per row of `docs`: its id, a row key, the counts, base_failed and kept.

    A text fails the base with fewer than `min_words` words (a null or empty text has none), or when more than half
    of its words lie in repeated windows. Else it is kept unless its share of symbols, repeated lines or repeated
    words, less DOUBT standard deviations of the count, is above the limit of its language and source. A limit is
    the centre of the group's sketch plus some widths, which are distances from the low end to the centre (see
    thresholds()): nothing but the sketches decides how high a share may be. Ties are kept; rows that repeat count
    each; an empty table stays empty.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), row_key(id_col, text_col).alias("row_key"), F.col(f"`{text_col}`").alias("text"))
    counts = with_metrics(named).drop("text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = cut(counts.withColumn("base_failed", failed))
    limit = thresholds(counts.where("NOT base_failed"))
    joined = counts.join(limit, counts.lang.eqNullSafe(limit.g_lang) & counts.source.eqNullSafe(limit.g_source), "left")
    over = F.lit(False)
    for m, (count, total, _) in METRICS.items():
        least = (F.col(count) - DOUBT * F.sqrt(F.col(count))) / (F.col(total) + 1)
        over = over | F.coalesce(least > F.pow(F.lit(2.0), (F.col(f"most_{m}") + 1) / F.lit(float(STEPS))), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("g_lang", "g_source", *[f"most_{m}" for m in METRICS])


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that judge() keeps."""
    kept = judge(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("row_key").alias("__kept_row")).distinct()
    return docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("__kept_id")) & (row_key(id_col, text_col) == F.col("__kept_row")), "left_semi")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    levels = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, CAST(floor(log2(({c} + 0.5) / ({t} + 1)) * {STEPS} + 1e-9) AS BIGINT) AS level FROM f WHERE NOT base_failed" for m, (c, t, _) in METRICS.items())
    widths = "CASE metric " + " ".join(f"WHEN '{m}' THEN {w}" for m, (_, _, w) in METRICS.items()) + " END"
    over = " OR ".join(f"coalesce(({c} - {DOUBT} * sqrt({c})) / ({t} + 1) > pow(2.0, (most_{m} + 1) / {float(STEPS)}), false)" for m, (c, t, _) in METRICS.items())
    most = ", ".join(f"max(most) FILTER (WHERE metric = '{m}') AS most_{m}" for m in METRICS)

    def limit(rows: str, keys: str) -> str:
        by = f"PARTITION BY {keys}metric"
        ends = f"SELECT {keys}metric, level, sum(n) OVER ({by} ORDER BY level) AS upto, sum(n) OVER ({by}) AS total FROM {rows}"
        return f"SELECT {keys}metric, c + {widths} * (c - l) AS most FROM (SELECT {keys}metric, min(level) FILTER (WHERE 100 * upto >= {LOW} * total) AS l, min(level) FILTER (WHERE 100 * upto >= {CENTRE} * total) AS c FROM ({ends}) GROUP BY ALL)"

    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wl AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) AS n_word_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM wl GROUP BY 1),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
m AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_word_lines, 0) AS n_word_lines,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
      FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
lv AS ({levels}),
own AS (SELECT lang, source, metric, level, CAST(count(*) AS HUGEINT) AS n FROM lv GROUP BY ALL),
lang AS (SELECT lang, metric, level, sum(n) AS n FROM own GROUP BY ALL),
every AS (SELECT metric, level, sum(n) AS n FROM own GROUP BY ALL),
own2 AS (SELECT lang, source, metric, level, sum(n) AS n FROM (
  SELECT o.lang, o.source, o.metric, o.level, o.n * t.n AS n FROM own o JOIN (SELECT lang, metric, sum(n) AS n FROM lang GROUP BY ALL) t ON t.metric = o.metric AND t.lang IS NOT DISTINCT FROM o.lang
  UNION ALL SELECT g.lang, g.source, g.metric, l.level, l.n * {PRIOR_ROWS} FROM (SELECT DISTINCT lang, source, metric FROM own) g JOIN lang l ON l.metric = g.metric AND l.lang IS NOT DISTINCT FROM g.lang) GROUP BY ALL),
lang2 AS (SELECT lang, metric, level, sum(n) AS n FROM (
  SELECT o.lang, o.metric, o.level, o.n * t.n AS n FROM lang o JOIN (SELECT metric, sum(n) AS n FROM every GROUP BY ALL) t ON t.metric = o.metric
  UNION ALL SELECT g.lang, g.metric, e.level, e.n * {PRIOR_ROWS} FROM (SELECT DISTINCT lang, metric FROM lang) g JOIN every e ON e.metric = g.metric) GROUP BY ALL),
k AS (SELECT o.lang, o.source, o.metric, least(o.most, l.most, e.most) AS most FROM ({limit("own2", "lang, source, ")}) o
  JOIN ({limit("lang2", "lang, ")}) l ON l.metric = o.metric AND l.lang IS NOT DISTINCT FROM o.lang JOIN ({limit("every", "")}) e ON e.metric = o.metric),
j AS (SELECT lang, source, {most} FROM k GROUP BY ALL)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept
FROM f LEFT JOIN j ON j.lang IS NOT DISTINCT FROM f.lang AND j.source IS NOT DISTINCT FROM f.source
"""


#: The sketches are histograms, whose counts SQL gives exactly; so both sides have the same limits at every size.
ORACLE = _oracle()
