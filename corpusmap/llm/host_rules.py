"""Quality rules with verdicts for hosts, in DataFrame functions only.

Windows of five words are compared by a 64-bit hash. Most texts have no equal windows, which a hash set tells; only the
others are sorted. Every document is measured in one pass over its text; the small rows that come out are written once, so that
counting by host and joining the verdicts back never touch a text again. Failures are counted by host with
map-side partial sums, one row per host and task, and each host's failure rate is shrunk towards the rate of
all hosts by a beta prior fitted to the hosts by moments. A document is rejected when it fails a base rule,
or a host rule whose shrunk rate at its host exceeds ``host_limit``: a failure that a host hardly ever shows
is tolerated, one that it shows often is not.

Defined cases: a null text has no words, a null host is a host of its own, repeated rows are separate documents, an
empty table gives no rows. Extra columns do not matter; only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.common import NOT_SPACE, let, words
from corpusmap.scratch import Tables

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
HOST_RULES = ("symbols", "dup_lines", "word_length")
HOST_LIMIT = 0.02
PRIOR_RANGE = (1.0, 1e6)


def windows(found: Column) -> Column:
    """A 64-bit hash of every window of five words of an array column."""

    def of_hashes(hashes: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            return F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, 5)])

        return F.slice(F.transform(hashes, window), F.lit(1), F.greatest(F.size(hashes) - 4, F.lit(0)))

    return let(F.transform(found, lambda w: F.xxhash64(w)), of_hashes)


def repeat_words(found: Column) -> Column:
    """How many words of an array column lie in windows of five words that are found twice or more."""
    return let(
        windows(found),
        lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)),
    )


def covered(found: Column) -> Column:
    """Words that lie in windows found twice or more.

    Each start of such a window covers five words, or as many as there are to the next start.
    """

    def repeated(placed: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before, after = F.get(placed, k - 1)["g"], F.get(placed, k + 1)["g"]
            return before.eqNullSafe(x["g"]) | after.eqNullSafe(x["g"])

        return F.sort_array(F.transform(F.filter(placed, twice), lambda x: x["i"]))

    def steps(starts: Column) -> Column:
        return F.transform(starts, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(starts, k + 1) - p, F.lit(5))))

    placed = F.array_sort(F.transform(found, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.aggregate(let(let(placed, repeated), steps), F.lit(0), lambda a, x: a + x)


def document_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the measures of each text and the rules that it fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [F.col(c) for c in docs.columns if c != text_col]
    split = docs.select(
        *rest,
        words(text).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
    )
    measured = split.select(
        *rest,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("_words")).cast("bigint").alias("n_repeat_words"),
    )
    few = F.col("n_words") < MIN_WORDS
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    return measured.select(
        "*",
        (few | repeats).alias("base_failed"),
        (F.col("n_symbols") * 100 > F.col("word_chars") * 10).alias("symbols"),
        (F.col("n_dup_lines") * 100 > F.col("n_lines") * 30).alias("dup_lines"),
        ((F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20)).alias(
            "word_length"
        ),
    )


def host_verdicts(measured: DataFrame, host_col: str = "host", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: its documents, and for each rule the failures, the shrunk rate and the verdict.

    Only the moments of the rates, one row for all hosts, come to the driver.
    """
    hosts = measured.groupBy(host_col).agg(
        F.count("*").alias("n_docs"), *[F.count_if(F.col(r)).alias(f"{r}_failed") for r in HOST_RULES]
    )
    rate = {r: F.col(f"{r}_failed") / F.col("n_docs") for r in HOST_RULES}
    moments = hosts.agg(
        *[F.avg(rate[r]).alias(f"{r}_mean") for r in HOST_RULES],
        *[F.var_pop(rate[r]).alias(f"{r}_var") for r in HOST_RULES],
    ).first()
    low, high = PRIOR_RANGE
    for r in HOST_RULES:
        mean, var = moments[f"{r}_mean"] or 0.0, moments[f"{r}_var"] or 0.0
        weight = min(max(mean * (1 - mean) / var - 1, low), high) if var > 0 else high
        shrunk = (F.col(f"{r}_failed") + mean * weight) / (F.col("n_docs") + weight)
        hosts = hosts.withColumn(f"{r}_rate", shrunk).withColumn(f"{r}_verdict", shrunk > host_limit)
    return hosts.select(
        host_col, "n_docs", *[f"{r}{x}" for r in HOST_RULES for x in ("_failed", "_rate", "_verdict")]
    )


def host_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    host_limit: float = HOST_LIMIT,
) -> DataFrame:
    """Every document with its measures, ``base_failed``, the host rules it fails and ``kept``."""
    tables = Tables(docs.sparkSession, "host_rules")
    measured = tables.save(
        document_rules(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
                                   F.col(text_col).alias("text"))),
        "measured",
    )
    verdicts = host_verdicts(measured, "host", host_limit).select(
        F.col("host").alias("_host"), *[f"{r}_verdict" for r in HOST_RULES]
    )
    judged = measured.join(verdicts, measured["host"].eqNullSafe(F.col("_host")), "left").drop("_host")
    rejected = F.col("base_failed")
    for r in HOST_RULES:
        rejected = rejected | (F.col(r) & F.coalesce(F.col(f"{r}_verdict"), F.lit(False)))
    return judged.select("*", (~rejected).alias("kept"))


def filter_documents(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, whatever their other columns.

    Texts are measured twice, for the hosts and for the rows, instead of being joined by id.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    tables = Tables(docs.sparkSession, "host_rules")
    verdicts = tables.save(host_verdicts(document_rules(rows.select("host", "text")), "host", host_limit), "verdicts")
    bad = verdicts.select(F.col("host").alias("_host"), *[F.col(f"{r}_verdict") for r in HOST_RULES])
    bad = bad.filter(" OR ".join(f"{r}_verdict" for r in HOST_RULES))
    measured = document_rules(rows)
    judged = measured.join(bad, measured["host"].eqNullSafe(F.col("_host")), "left")
    rejected = F.col("base_failed")
    for r in HOST_RULES:
        rejected = rejected | (F.col(r) & F.coalesce(F.col(f"{r}_verdict"), F.lit(False)))
    # Not a filter: that would be pushed below the measures, and measure each text once more.
    return judged.select(F.explode(F.when(~rejected, F.array("row"))).alias("row")).select("row.*")
