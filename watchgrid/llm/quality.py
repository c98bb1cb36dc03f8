"""Quality rules with host verdicts, in DataFrame functions only.

Three rules look at a document: symbols per word, share of repeated lines, mean word length. Each has a severe bound, which
decides on any host, and a mild one. Failures of the mild bounds are aggregated by host; each host's rate is shrunk towards
the rate of all documents by a beta prior whose strength comes from the spread between hosts (method of moments). A host
whose shrunk rate is over ``host_limit`` is condemned for that rule, and its documents are then held to the mild bound.
A document that breaks no bound stays, whatever its host.

Repeated five-word windows are found by sorting 64-bit window hashes inside the row, and only in documents in which two
hashes are equal; nothing is exploded or shuffled but one row per host and task.

Defined results: null, empty and blank texts have no words and fail the base rule; null hosts are one host; repeated rows
are judged, and counted for their host, one by one; an empty table gives none; columns other than those named are carried
only inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchgrid.llm.common import sent_if_small
from watchgrid.session import cut_lineage

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "lines", "length")
HOST_LIMIT = 0.5
#: The prior weighs as much as this many documents at least, so that no host is condemned on a few.
LEAST_STRENGTH = 10.0


def _bound(value: Column, found) -> Column:
    """``found`` applied to a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), found), F.lit(0))


def _word(words: Column, i: Column) -> Column:
    return F.get(words, i)


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), host_col: str = "source") -> DataFrame:
    """Per row: ``row`` (the carried columns), ``host``, and the counts that rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.struct(*carry).alias("row"), F.col(host_col).alias("host"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)) != "")
    split = read.select("row", "host", "text", words.alias("words"), lines.alias("lines"))
    windows = F.when(
        F.size("words") >= 5,
        F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[_word(F.col("words"), i + k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "row",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    placed = F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    repeated = _bound(
        F.sort_array(placed),
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"])), lambda x: x["i"]
            )
        ),
    )
    covered = F.aggregate(
        repeated,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 5 - F.greatest(a["end"], i)).alias("n"), (i + 5).alias("end")),
        lambda a: a["n"],
    )
    n_repeat = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), covered).otherwise(0)
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    found = F.struct(*names, n_repeat.cast("long").alias("n_repeat_words"))
    # A generator of one row: filters on the counts stay above it, where pushing them down would repeat the counting.
    return counted.select("row", "host", F.explode(F.array(found)).alias("found")).select("row", "host", "found.*")


def broken(mild: bool) -> dict[str, Column]:
    """Whether a document breaks each rule's mild or severe bound. The bounds."""
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    symbols, lines, shortest, longest = (0.1, 0.3, 2.5, 12.0) if mild else (0.3, 0.5, 1.5, 20.0)
    return {
        "symbols": F.col("n_symbols") > symbols * F.col("n_words"),
        "lines": F.col("n_dup_lines") > lines * F.col("n_lines"),
        "length": (F.col("n_words") > 0) & ((mean < shortest) | (mean > longest)),
    }


def host_verdicts(counts: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: documents ``n`` and, for each rule, the shrunk failure rate and whether the host is condemned."""
    mild = broken(mild=True)
    hosts = cut_lineage(
        counts.groupBy(F.col("host").alias("of_host")).agg(
            F.count("*").alias("n"), *[F.sum(mild[r].cast("long")).alias(f"failed_{r}") for r in RULES]
        )
    )
    totals = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *[F.sum(f"failed_{r}").alias(r) for r in RULES]).first()
    n, means = totals["n"] or 1, {r: (totals[r] or 0) / (totals["n"] or 1) for r in RULES}
    squares = [F.sum(F.pow(F.col(f"failed_{r}") - means[r] * F.col("n"), 2) / F.col("n")).alias(r) for r in RULES]
    spreads = hosts.agg(*squares).first()
    for r in RULES:
        noise = means[r] * (1 - means[r])
        between = max((spreads[r] or 0.0) / n - noise * totals["hosts"] / n, 1e-9)
        strength = min(max(noise / between - 1, LEAST_STRENGTH), 1e6)
        rate = (F.col(f"failed_{r}") + means[r] * strength) / (F.col("n") + strength)
        hosts = hosts.withColumn(f"rate_{r}", rate).withColumn(f"condemned_{r}", F.col(f"rate_{r}") > host_limit)
    return hosts


def judged(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``row``, the counts, ``base_failed`` and ``kept``. The counts are written once, with the row, for both passes."""
    counts = cut_lineage(measured(docs, carry))
    verdicts = host_verdicts(counts)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    mild, severe = broken(mild=True), broken(mild=False)
    fails = F.lit(False)
    for r in RULES:
        fails = fails | severe[r] | (mild[r] & F.col(f"condemned_{r}"))
    verdicts = sent_if_small(verdicts.select("of_host", *[f"condemned_{r}" for r in RULES]))
    joined = counts.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")))
    columns = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(*columns, base.alias("base_failed"), (~base & ~fails).alias("kept"))
