"""Quality rules judged per host, with shrunken failure rates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_sized, let, materialize, table, words

#: Fewest words, and most words in repeated windows of five in a hundred.
MIN_WORDS, MAX_REPEAT = 10, 20
#: A host whose shrunken failure rate of a rule is above this is held to the soft limits.
HOST_RATE = 0.5
#: Soft limits in a hundred words: symbols and repeated lines. They count on such hosts alone.
SOFT_SYMBOLS, SOFT_LINES = 30, 5
#: Strength of the prior where the hosts don't differ, and its bounds.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
RULES = ("short", "repeats", "symbols", "lines")


def repeat_words(found: Column) -> Column:
    """Words covered by windows of five words that occur twice or more.

    Windows are compared by 64-bit hashes within one text. Equal hashes are found by sorting
    (hash, position) pairs, so long and repetitive texts cost n log n.
    """

    def covered(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - 4), lambda i: F.xxhash64(F.slice(ws, i, 5)))
        return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(spread(hs)))

    def spread(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda a: let(F.sort_array(F.transform(F.filter(a, lambda x, i: same(a, x, i)), lambda x: x["i"])), total))

    def same(a: Column, x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(a, i - 1)["h"] == x["h"]).otherwise(False)
        return before | F.coalesce(F.get(a, i + 1)["h"] == x["h"], F.lit(False))

    def total(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - p, F.lit(5)))), F.lit(0), lambda s, x: s + x
        )

    return F.when(F.size(found) < 6, F.lit(0)).otherwise(covered(found))


def signals(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (null: empty)."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def made(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(ws).cast("long").alias("n_repeat_words"),
        )

    return let(words(text), made)


def fails(s: Column) -> dict[str, Column]:
    return {
        "short": s["n_words"] < MIN_WORDS,
        "repeats": 100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"],
        "symbols": 100 * s["n_symbols"] > SOFT_SYMBOLS * s["n_words"],
        "lines": 100 * s["n_dup_lines"] > SOFT_LINES * s["n_words"],
    }


def host_verdicts(scored: DataFrame) -> DataFrame:
    """(host, n_docs, worst_rate, host_rejected) from rows (host, s).

    Failures are counted per host and rule; each rate is shrunk by a beta prior whose mean is the
    rate over all documents and whose strength follows from the spread between hosts (moments).
    """
    by_host = scored.groupBy("host").agg(
        F.count("*").alias("n_docs"), *[F.sum(c.cast("long")).alias(r) for r, c in fails(F.col("s")).items()]
    )
    # per rule, one row of sums over hosts; a rate's expected square has a binomial part of m(1-m)/n
    sums = by_host.agg(
        F.count("*").alias("hosts"),
        F.sum("n_docs").alias("all_docs"),
        F.sum(1.0 / F.col("n_docs")).alias("inv"),
        *[F.sum(r).alias(f"all_{r}") for r in RULES],
        *[F.sum((F.col(r) / F.col("n_docs")) * (F.col(r) / F.col("n_docs"))).alias(f"sq_{r}") for r in RULES],
        *[F.sum(F.col(r) / F.col("n_docs")).alias(f"one_{r}") for r in RULES],
    )

    def rate(r: str) -> Column:
        m = F.col(f"all_{r}") / F.col("all_docs")
        var = F.col(f"sq_{r}") / F.col("hosts") - 2 * m * F.col(f"one_{r}") / F.col("hosts") + m * m
        between = var - m * (1 - m) * F.col("inv") / F.col("hosts")
        strength = F.when(
            between > 0, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), m * (1 - m) / between - 1))
        ).otherwise(F.lit(MOST_STRENGTH))
        return (F.col(r) + strength * m) / (F.col("n_docs") + strength)

    # the sums are one row by construction
    return (
        by_host.withColumn("one", F.lit(1))
        .join(F.broadcast(sums.withColumn("one", F.lit(1))), "one")
        .select("host", "n_docs", F.greatest(*[rate(r) for r in RULES]).alias("worst_rate"))
        .withColumn("host_rejected", F.col("worst_rate") > HOST_RATE)
    )


def host_of() -> Column:
    """The document's source; null counts as one host of its own."""
    return F.coalesce(F.col("source"), F.lit("\u0001"))


def score(docs: DataFrame) -> DataFrame:
    return docs.select("*", host_of().alias("host"), signals(F.col("text")).alias("s"))


def base_failed(s: Column) -> Column:
    f = fails(s)
    return f["short"] | f["repeats"]


def with_verdicts(rows: DataFrame) -> DataFrame:
    """A table of rows (host, s, ...) with kept: only rows beyond a soft limit are joined with their host's verdict."""
    f, failed = fails(F.col("s")), base_failed(F.col("s"))
    unsure = ~failed & (f["symbols"] | f["lines"])
    bad = host_verdicts(rows).where("host_rejected").select("host", "n_docs", F.lit(False).alias("kept"))
    judged = join_sized(rows.where(unsure), bad, "host", "n_docs", rows.count()).withColumn("kept", F.coalesce("kept", F.lit(True))).drop("n_docs")
    return rows.where(~unsure).withColumn("kept", ~failed).unionByName(judged)


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its counts, base_failed and kept.

    Null and empty texts have no words and fail; repeated rows are judged alike, each on its own;
    an empty table gives none; columns besides doc_id, text and source aren't read. A document
    without base failure goes only if its host's shrunken rate for a rule is above HOST_RATE and
    it breaks a soft limit itself, so clean documents of bad hosts stay.
    """
    ids = docs.select("doc_id", "text", "source")
    rows = materialize(score(ids).select("doc_id", "host", "s"), "quality")
    return with_verdicts(rows).select("doc_id", "s.*", base_failed(F.col("s")).alias("base_failed"), "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that judge() keeps, with the columns of docs; clashing names in docs are harmless.

    Null and empty texts go; repeated rows are judged alike, each on its own; an empty table stays empty. Each text
    is counted once, in a written table of the documents with their counts.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = materialize(score(docs.select(row, "text", "source")).drop("text", "source"), "quality")
    return with_verdicts(rows).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS ls FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, CAST(sum(least(5, coalesce(nx - i, 5))) AS BIGINT) AS n FROM r GROUP BY 1),
s AS (SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, CAST(n_words < {MIN_WORDS} AS INT) AS f1, CAST(100 * n_repeat_words > {MAX_REPEAT} * n_words AS INT) AS f2,
        CAST(100 * n_symbols > {SOFT_SYMBOLS} * n_words AS INT) AS f3, CAST(100 * n_dup_lines > {SOFT_LINES} * n_words AS INT) AS f4 FROM s),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, unnest([sum(f1), sum(f2), sum(f3), sum(f4)]) AS x, unnest([1, 2, 3, 4]) AS rule FROM f GROUP BY host),
p AS (SELECT rule, sum(x) / sum(n) AS m, avg((x / n) * (x / n)) AS sq, avg(x / n) AS one, avg(1 / n) AS inv FROM h GROUP BY rule),
q AS (SELECT rule, m, sq - 2 * m * one + m * m - m * (1 - m) * inv AS b FROM p),
z AS (SELECT rule, m, CASE WHEN b > 0 THEN greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, m * (1 - m) / b - 1)) ELSE {MOST_STRENGTH} END AS k FROM q),
v AS (SELECT host, max((x + k * m) / (n + k)) > {HOST_RATE} AS bad FROM h JOIN z USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 + f2 > 0 AS base_failed,
  f1 + f2 = 0 AND NOT (bad AND f3 + f4 > 0) AS kept FROM f JOIN v USING (host)
"""
