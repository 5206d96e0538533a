"""Quality rules with host verdicts, in DataFrame functions only.

Per document: word and repetition features of the whole text, a base rule, and soft rules, of which ``excess`` tells how
many times over the worst is. Per host: the share of its documents that fail any rule, shrunk towards the corpus by a
beta prior. The prior is fitted to the hosts' counts by weighted moments: its mean is the corpus' share, and what the
hosts vary beyond the binomial noise of their sizes gives its strength. Verdicts are relative to it: a host whose shrunk
rate reaches halfway from the prior's mean to 1 loses all documents; of other hosts a document goes whose excess is over
``TOLERANCE`` times the prior's mean over the host's rate, so a soft failure is forgiven up to twice its limit on a host
like all others, not at all on one of twice that rate, and further on a cleaner one. Verdicts are joined back by host:
broadcast if there are at most ``MAX_HOSTS``, else by a sort-merge join whose hot hosts adaptive execution splits.

Windows of eight words are compared inside the row, by hash and then by word, so no word leaves its task.

Nulls: a null text has no words and fails the base rule; a null host is a host of its own. Repeated rows count each.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, TOLERANCE, MAX_HOSTS = 8, 2.0, 200_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_features(rows: DataFrame) -> DataFrame:
    """Adds the counts, ``base_failed`` and ``excess`` to rows that have ``__text``; drops ``__text``."""
    at = F.col
    rows = rows.withColumn("__text", F.coalesce("__text", F.lit(""))).withColumn("__words", common.ascii_words(at("__text")))
    has_word = lambda line: F.length(F.translate(line, common.WS, "")) > 0
    rows = rows.withColumn("__lines", F.filter(F.split("__text", "\n", -1), has_word))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("__text", "__lines")],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", common.WS, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    starts = F.when(F.size("__words") >= WINDOW, F.sequence(F.lit(0), F.size("__words") - WINDOW)).otherwise(F.expr("cast(array() as array<int>)"))
    rows = rows.withColumn("__wins", F.transform(starts, lambda i: F.xxhash64(F.slice("__words", i + 1, WINDOW))))
    # only documents with an equal pair of hashes go on: places sorted by hash, those with an equal neighbour, in order
    repeats = F.size(F.array_distinct("__wins")) < F.size("__wins")
    rows = rows.withColumn("__by_hash", F.when(repeats, F.array_sort(F.transform("__wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def same(x, other):
        return (other["h"] == x["h"]) & (F.slice("__words", other["i"] + 1, WINDOW) == F.slice("__words", x["i"] + 1, WINDOW))

    def has_twin(x, k):
        before, after = F.get("__by_hash", k - 1), F.get("__by_hash", k + 1)
        return F.coalesce(same(x, before), F.lit(False)) | F.coalesce(same(x, after), F.lit(False))

    rows = rows.withColumn("__places", F.array_sort(F.transform(F.filter("__by_hash", has_twin), lambda x: x["i"])))
    covered = F.aggregate(
        "__places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__words", "__wins", "__by_hash", "__places")
    base = (at("n_words") < 20) | (100 * at("n_repeat_words") > 30 * at("n_words"))
    over = lambda value, limit: F.coalesce(value / F.when(limit > 0, limit), F.lit(0.0))
    excess = F.greatest(over(3 * at("n_words"), at("word_chars")), over(at("word_chars"), 12 * at("n_words")), over(10 * at("n_symbols"), at("n_words")), over(10 * at("n_dup_lines"), 3 * at("__n_lines")))
    return rows.withColumn("base_failed", base).withColumn("excess", excess).drop("__n_lines")


def host_verdicts(features: DataFrame) -> DataFrame:
    """``__host``, ``__rejected`` and ``__tolerance`` of every host. The prior comes from one row of sums."""
    hosts = features.groupBy("__host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("base_failed") | (F.col("excess") > 1)).alias("f"))
    hosts = common.materialize(hosts, "hosts")
    c = F.col
    n, f, size, squares, h = hosts.agg(F.sum("n"), F.sum("f"), F.sum(c("f") * c("f") / c("n")), F.sum((c("n") * c("n")).cast("double")), F.count(F.lit(1))).first()
    mean, strength = (f / n if n else 0.0), 1e6
    spread = (n or 0) - (squares or 0.0) / (n or 1) - (h - 1)
    if 0 < mean < 1 and spread > 0:
        scatter = (size - n * mean * mean) / (mean * (1 - mean))
        strength = 1 / min(max((scatter - (h - 1)) / spread, 1e-6), 0.5) - 1
    rate = (c("f") + mean * strength) / (c("n") + strength)
    return hosts.select("__host", (rate >= (1 + mean) / 2).alias("__rejected"), F.greatest(F.lit(1.0), TOLERANCE * mean / F.when(rate > 0, rate)).alias("__tolerance"))


def with_verdict(features: DataFrame) -> DataFrame:
    """Adds ``kept`` to rows with ``__host`` and the rule columns (written rows: they are read twice)."""
    hosts = host_verdicts(features)
    hosts = F.broadcast(hosts) if common.bounded(hosts, MAX_HOSTS) else hosts
    rows = features.join(hosts, features["__host"].eqNullSafe(hosts["__host"]), "left").drop(hosts["__host"])
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("__rejected") & (F.col("excess") <= F.col("__tolerance")))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` without rejected documents. Same columns."""
    rows = common.pack(docs, __text=F.col(f"`{text_col}`"), __host=F.col(f"`{host_col}`"))
    return common.unpack(with_verdict(common.materialize(with_features(rows), "quality")).where("kept"))


def op2_host_quality(spark, sf_dir: str) -> DataFrame:
    """Features and verdicts of every whole text of ``documents``, by host (its ``source``)."""
    docs = spark.read.parquet(common.table_path(sf_dir, "documents"))
    rows = docs.select("doc_id", F.col("source").alias("__host"), F.col("text").alias("__text"))
    out = with_verdict(common.materialize(with_features(rows), "quality"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) > 0) AS l FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM w, unnest(generate_series(1, len(w) - 7)) AS t(i) WHERE len(w) >= 8),
twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM g JOIN twice USING (r, g), unnest(generate_series(i, i + 7)) AS t(p) GROUP BY r),
f AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  greatest(coalesce(3 * n_words / nullif(word_chars, 0), 0), coalesce(word_chars / nullif(12 * n_words, 0), 0), coalesce(10 * n_symbols / nullif(n_words, 0), 0), coalesce(10 * n_dup_lines / nullif(3 * n_lines, 0), 0)) AS excess FROM f),
h AS (SELECT source, count(*) AS n, count_if(base_failed OR excess > 1) AS f FROM b GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS n, sum(f) / sum(n) AS m, sum(f * f / n) AS size, sum((n * n)::DOUBLE) AS squares, count(*) - 1 AS d FROM h),
p AS (SELECT m, CASE WHEN m > 0 AND m < 1 AND n - squares / n - d > 0 THEN 1 / least(greatest(((size - n * m * m) / (m * (1 - m)) - d) / (n - squares / n - d), 1e-6), 0.5) - 1 ELSE 1e6 END AS s FROM t),
v AS (SELECT source, m, (f + m * s) / (n + s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate < (1 + m) / 2 AND excess <= greatest(1.0, 2.0 * m / nullif(rate, 0)) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
