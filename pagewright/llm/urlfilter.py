"""URL filters by association rules: token combinations that go with the label ``block``, mined by growing size.

A URL's tokens are the suffixes of its host, its path segments with their places (digits masked) and its query keys.
Labelled URLs are transactions of tokens and the label; rules ``tokens -> block`` are kept by support and confidence,
those that contain another kept rule's tokens are pruned, and the rest is matched by an inverted index from token to
rules. A list of host and path rules comes first: the longest that fits decides. Unless a table of labels is given, the
URLs that it blocks are the positive ones and all others, decided or not, the negative ones: a combination passes only
if nearly all URLs that have it are blocked, so a whole domain is not blocked for a folder of it. URLs that no rule of
either kind fits are allowed.

Only minimal combinations are mined: one that passes is not extended, nor one as frequent as a part of it. Support is
the same at every input size; distinct baskets are counted in Spark, and what comes to the driver is counts of frequent
combinations, which follow the support and not the number of URLs.

Nulls: a null URL, or one without ``://``, has empty host and path, no tokens, fits nothing and is allowed. Repeated
rows are judged each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path) of the rule list that the query applies.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.85


def parse(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` packed as ``__row`` with ``host``, ``path`` and ``tail`` (what follows the host)."""
    url = F.col(f"`{url_col}`")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rows = common.pack(urls, __rest=rest)
    host = F.regexp_extract("__rest", r"^([^/?#]*)", 1)
    rows = rows.withColumn("host", common.ascii_lower(host)).withColumn("tail", F.substring(F.col("__rest"), F.length(host) + 1, F.length("__rest")))
    return rows.withColumn("path", F.regexp_extract("tail", r"^([^?#]*)", 1)).drop("__rest")


def with_rule(rows: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and its ``verdict``; both null where no rule fits. Equal lengths go by the rule's text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("verdict", verdict)


def tokens():
    """Distinct tokens of a parsed URL as an array of strings."""
    labels = F.split("host", r"\.", -1)
    n = F.size(labels)
    suffixes = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -i, i), ".")))).otherwise(F.expr("cast(array() as array<string>)"))
    segments = F.filter(F.split(F.regexp_replace("path", r"[0-9]+", "#"), "/", -1), lambda s: s != "")
    places = F.transform(segments, lambda s, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), s))
    query = F.regexp_extract("tail", r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&", -1), lambda q: q != ""), lambda q: F.concat(F.lit("q:"), F.substring_index(q, "=", 1)))
    return F.array_distinct(F.concat(suffixes, places, keys))


def grown(sets: dict[tuple[str, ...], int]) -> list[tuple[str, ...]]:
    """Sorted sets of one token more whose subsets of one token less are all in ``sets``.

    Suffixes of one host imply each other, so a set has one of them at most: the longer stands for both.
    """
    by_head: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for s in sorted(sets):
        by_head[s[:-1]].append(s[-1])
    both = ((*head, x, y) for head, last in by_head.items() for x, y in combinations(last, 2) if not (x[:2] == y[:2] == "h:"))
    return [c for c in both if all(c[:i] + c[i + 1 :] in sets for i in range(len(c) - 2))]


def count_sets(baskets: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], tuple[int, int]]:
    """How many baskets, and how many blocked ones, contain each set; summed per task first."""
    sent = baskets.sparkSession.sparkContext.broadcast(sets)

    def count(batches):
        by_pair: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, s in enumerate(sent.value):
            by_pair[s[0]][s[1]].append(i)
        n, blocked = [0] * len(sent.value), [0] * len(sent.value)
        for batch in batches:
            for items, is_blocked, times in zip(*(batch.column(k).to_pylist() for k in range(3))):
                have = set(items)
                for first in have & by_pair.keys():
                    for second in have & by_pair[first].keys():
                        for i in by_pair[first][second]:
                            if have.issuperset(sent.value[i]):
                                n[i] += times
                                blocked[i] += times * is_blocked
        at = [i for i, x in enumerate(n) if x]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([n[i] for i in at], pa.int64()), pa.array([blocked[i] for i in at], pa.int64())], names=["i", "n", "b"])

    rows = baskets.select("items", "blocked", "times").mapInArrow(count, "i int, n long, b long")
    return {sets[r["i"]]: (r["n"], r["b"]) for r in rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()}


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[frozenset[str]]:
    """Minimal token combinations of rules for block, from ``items`` (tokens) and ``blocked`` (boolean)."""
    spark = labelled.sparkSession
    common.ship(spark)
    grouped = labelled.where((F.size("items") > 0) | F.col("blocked")).groupBy(F.array_sort(F.array_distinct("items")).alias("items"), "blocked").agg(F.count(F.lit(1)).alias("times"))
    baskets = common.materialize(grouped, "baskets")
    total = baskets.agg(F.sum("times")).first()[0]
    if not total:
        return []
    least = math.ceil(min(min_support, 1.0) * total)
    single = baskets.select(F.explode("items").alias("t"), "blocked", "times").groupBy("t").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("blocked"), F.col("times")).otherwise(0)).alias("b"))
    found = {(r["t"],): (r["n"], r["b"]) for r in single.where((F.col("b") >= least) & (F.col("b") > 0)).collect()}
    kept: list[frozenset[str]] = []
    while found:
        kept += [frozenset(s) for s, (n, b) in sorted(found.items()) if b >= min_confidence * n]
        # what passes is not extended: all of its supersets would be pruned
        open_sets = {s: n for s, (n, b) in found.items() if b < min_confidence * n}
        wanted = grown(open_sets)
        counts = count_sets(baskets, wanted) if wanted else {}
        # nor is a set as frequent as one of its subsets: the subset stands for it, in every superset too
        found = {s: (n, b) for s, (n, b) in counts.items() if b >= max(least, 1) and all(n < open_sets[s[:i] + s[i + 1 :]] for i in range(len(s)))}
    return [rule for rule in kept if not any(other != rule and all(implied(t, rule) for t in other) for other in kept)]


def implied(token: str, rule: frozenset[str]) -> bool:
    """Whether every URL with the tokens of ``rule`` has ``token``: it is one of them, or a shorter suffix of its host."""
    return token in rule or token[:2] == "h:" and any(t[:2] == "h:" and t.endswith("." + token[2:]) for t in rule)


def inverted(rules: list[frozenset[str]]) -> tuple[dict[str, list[int]], list[int]]:
    index: dict[str, list[int]] = defaultdict(list)
    for i, rule in enumerate(rules):
        for token in rule:
            index[token].append(i)
    return dict(index), [len(r) for r in rules]


def matches(found: list[str], index: dict[str, list[int]], sizes: list[int]) -> bool:
    counts: dict[int, int] = {}
    for token in found:
        for i in index.get(token, ()):
            n = counts[i] = counts.get(i, 0) + 1
            if n == sizes[i]:
                return True
    return False


def judge(urls: DataFrame, url_col: str = "url", rules=RULES, labels: DataFrame | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``urls`` packed as ``__row`` with host, path, rule and verdict. ``labels``: url, blocked; else what the rules block."""
    spark = urls.sparkSession
    common.ship(spark)
    rows = with_rule(parse(urls, url_col), rules).withColumn("items", tokens())
    if labels is None:
        labelled = rows.select("items", F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocked"))
    else:
        labelled = parse(labels, "url").select(tokens().alias("items"), F.col("__row.blocked").alias("blocked")).where("blocked is not null")
    sent = spark.sparkContext.broadcast(inverted(mine(labelled, min_support, min_confidence)))

    @F.pandas_udf("string")
    def by_index(items):
        index, sizes = sent.value
        return items.map(lambda found: "block" if matches(list(found), index, sizes) else "allow")

    return rows.withColumn("verdict", F.coalesce("verdict", by_index(F.when(F.col("verdict").isNull(), F.col("items")).otherwise(F.expr("cast(array() as array<string>)"))))).drop("items", "tail")


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    """Every ``pages`` url judged: page_id, host, path, rule, verdict."""
    pages = spark.read.parquet(common.table_path(sf_dir, "pages")).select("page_id", "url")
    return judge(pages).select(F.col("__row.page_id").alias("page_id"), "host", "path", "rule", "verdict")
