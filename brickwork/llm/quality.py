"""Host-level quality rules.

Every text is measured and tested by itself, by several rules. Failures of each rule are then counted by host (here: the
document's source), each host's failure rate is drawn towards the rates of all hosts by an empirical beta prior of the
rule's own, and hosts for which any drawn-in rate is too high lose all their documents. The base rule also decides
single documents; the others decide hosts only.

Null text has no words. Documents without a host are judged by their text alone. Repeated rows count each. Windows
of words are compared by 64-bit hashes within one text. Texts are measured whole; work and memory of one grow with its
length. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.llm.native import let, positions, words
from brickwork.session import materialize

#: A text fails with fewer words, or if more than this many of 100 words lie in repeated windows.
MIN_WORDS, MAX_REPEATED = 10, 20
WINDOW = 5
#: A text also fails with more than this many symbols for 100 characters in words, or repeated lines of 100 lines.
MAX_SYMBOLS, MAX_DUP_LINES = 10, 30
#: A host fails when its drawn-in rate of documents that fail by one rule is higher.
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
#: Columns that say by which rules a document failed.
RULES = ("base_failed", "symbols_failed", "lines_failed")


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in windows found twice or more in the text."""

    def covered(at: Column) -> Column:
        """Words in the windows that begin at the sorted positions ``at``."""
        last = F.size(at) - 1
        return F.aggregate(
            positions(F.size(at)), F.lit(0), lambda sum_, i: sum_ + F.when(i == last, F.lit(window)).otherwise(F.least(F.lit(window), F.get(at, i + 1) - F.get(at, i)))
        )

    def repeats(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            positions(F.size(s)), lambda k: (F.get(s, k)["h"].eqNullSafe(F.get(s, k - 1)["h"])) | (F.get(s, k)["h"].eqNullSafe(F.get(s, k + 1)["h"]))
        )
        at = let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda k: F.get(s, k)["i"])))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(at, covered)).otherwise(0)

    hashed = F.transform(found, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(positions(F.size(h) - (window - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])))
    return let(windows, repeats)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each text, and by which of ``RULES`` it failed."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    size = lambda c: F.size(c).cast("long")
    counts = let(words(value), lambda w: F.struct(size(w).alias("n"), repeated_words(w).cast("long").alias("r")))
    out = docs.withColumns(
        {
            "_words": counts,
            "word_chars": F.length(F.translate(value, "\t\n\x0b\f\r ", "")).cast("long"),
            "n_symbols": (F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).cast("long"),
            "_lines": let(lines, lambda s: F.struct(size(s).alias("n"), (size(s) - size(F.array_distinct(s))).alias("d"))),
        }
    )
    out = out.withColumns({"n_words": F.col("_words.n"), "n_repeat_words": F.col("_words.r"), "n_lines": F.col("_lines.n"), "n_dup_lines": F.col("_lines.d")})
    failed = {
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        "symbols_failed": 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"),
        "lines_failed": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
    }
    return out.drop("_words", "_lines").withColumns(failed)


def beta_weight(failed: float, n: float, hosts: int, squares: float) -> tuple[float, float]:
    """Mean and weight of the prior, by moments of the hosts' rates; ``squares`` is the sum of failed² / documents.

    Without spread, or with a single host, the weight is so large that every host takes the overall rate.
    """
    mean = failed / max(n, 1)
    within = mean * (1 - mean)
    spread = max(squares / max(n, 1) - mean * mean, 0.0)  # variance of the rates, by documents
    noise = within * hosts / max(n, 1)  # what chance alone adds to it
    between = spread - noise
    return mean, within / between - 1 if between > 1e-12 and within > between else (0.0 if between >= within > 0 else 1e12)


def host_rates(rows: DataFrame, host: str = "source", rules: tuple[str, ...] = RULES) -> DataFrame:
    """Per host: documents ``n``, and for each rule the failures and the drawn-in rate, ``<rule>_rate``."""
    count = [F.sum(F.col(r).cast("long")).alias(r) for r in rules]
    hosts = rows.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n"), *count)
    moments = [m for r in rules for m in (F.sum(r).alias(f"{r}_f"), F.sum((F.col(r) * F.col(r)) / F.col("n")).alias(f"{r}_q"))]
    prior = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *moments).first()
    for r in rules:
        mean, weight = beta_weight(prior[f"{r}_f"] or 0, prior["n"] or 0, prior["hosts"], prior[f"{r}_q"] or 0.0)
        hosts = hosts.withColumn(f"{r}_rate", (F.col(r) + weight * mean) / (F.col("n") + weight))
    return hosts


def judge(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE, key: str = "doc_id") -> DataFrame:
    """Key, measures, ``RULES`` and ``kept``: neither the text fails the base rule nor its host any rule.

    The measures, a few numbers per document, are stored in the shared folder, since they are read twice.
    """
    rows = materialize(measured(docs.select(key, host, text), text).drop(text), "quality")
    worst = F.greatest(*[F.col(f"{r}_rate") for r in RULES])
    bad = host_rates(rows, host).where(worst > max_rate).select(F.col(host).alias("_host"), F.lit(True).alias("_bad"))
    out = rows.join(bad, F.col(host) == F.col("_host"), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")
