"""Quality rules with certified cutoffs.

Each rule is a rate of a document in whole percent (symbols, repeated lines, repeated words,
upper case). A rule rejects a document from a cutoff on. Cutoffs are not guessed: the labelled
documents are split in two by a digest of their id. The *proposal* half says which cutoff
removes most bad documents at the least loss of good ones. The *holdout* half certifies: for
the true share p of good documents that a cutoff loses, the hypothesis p > alpha is tested by
the exact binomial tail P(Bin(n, alpha) <= lost). Per stratum and rule the cutoffs are tested
from the mildest on and testing stops at the first failure (fixed sequence), which costs no
level; across strata and rules the level is divided (Bonferroni). ``alpha`` is divided among
the rules, so that by the union bound all rules together lose at most ``alpha`` of the good
documents of each stratum, in all strata at once, with probability ``1 - delta``.

Everything is Column expressions: word windows are compared inside the row's own arrays, so
texts are never shuffled and a document's cost is n log n in its own length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.llm.common import SPACE, only, text_of, words_of
from tabwarden.session import persisted_copy

RULES = ("symbols", "dup_lines", "repeat_words", "upper")


@dataclass(frozen=True)
class RiskControl:
    #: Largest share of good documents that the rules together may reject in a stratum.
    alpha: float = 0.05
    #: Probability that the bound fails in any stratum.
    delta: float = 0.05


def _same_as_neighbour(values: Column, key) -> Column:
    """Keep the elements of a sorted array whose key equals that of an element beside them."""

    def beside(element: Column, index: Column) -> Column:
        before, after = F.get(values, index - 1), F.get(values, index + 1)
        return F.coalesce(key(element) == key(before), F.lit(False)) | F.coalesce(
            key(element) == key(after), F.lit(False)
        )

    return F.filter(values, beside)


def features(documents: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``stratum`` (lang) and the counts of its text.

    A null text has no words. Rows that repeat stay rows of their own. A null ``lang`` is a
    stratum of its own. Texts of any length are taken whole.
    """
    text = text_of()
    rows = only(documents, "doc_id", "text", "lang").select(
        "doc_id",
        F.col("lang").alias("stratum"),
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )
    words, windows = F.col("words"), F.size("words") - 2
    # A window is first known by the high bits of a hash with its place in the low bits: arrays
    # of longs sort fast. Only windows that meet an equal hash are then compared as text.
    place_bits = F.when(windows < (1 << 22), 22).otherwise(31)
    rows = rows.select(
        "*",
        place_bits.alias("bits"),
        F.sort_array(
            F.transform(
                F.slice(words, 1, F.greatest(windows, F.lit(0))),
                lambda word, i: F.call_function(
                    "shiftleft",
                    F.call_function(
                        "shiftright", F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2)), place_bits
                    ),
                    place_bits,
                ).bitwiseOR(i.cast("long")),
            )
        ).alias("packed"),
    )
    bits = F.col("bits")
    rows = rows.select(
        "*",
        F.transform(
            _same_as_neighbour(F.col("packed"), lambda p: F.call_function("shiftright", p, bits)),
            lambda p: p.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int"),
        ).alias("places"),
    ).drop("packed", "bits")
    rows = rows.select(
        "*",
        F.sort_array(
            F.transform(
                "places",
                lambda i: F.struct(
                    F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("window"),
                    i.alias("at"),
                ),
            )
        ).alias("keyed"),
    )
    rows = rows.select(
        "*",
        F.sort_array(
            F.transform(_same_as_neighbour(F.col("keyed"), lambda e: e["window"]), lambda e: e["at"])
        ).alias("starts"),
    )
    starts = F.col("starts")
    covered = F.aggregate(
        F.transform(starts, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1), at + 3) - at)),
        F.lit(0),
        lambda total, step: total + step,
    )
    return rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
    )


def _percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.least(F.lit(100), F.floor(F.lit(100) * F.col(part) / F.col(whole)))).otherwise(
        0
    ).cast("int")


def with_rates(counted: DataFrame) -> DataFrame:
    """Add each rule's rate in whole percent (0 for texts without words)."""
    return counted.select(
        "*",
        _percent("n_symbols", "word_chars").alias("symbols"),
        _percent("n_dup_lines", "n_lines").alias("dup_lines"),
        _percent("n_repeat_words", "n_words").alias("repeat_words"),
        _percent("n_upper", "word_chars").alias("upper"),
        (
            (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
        ).alias("base_failed"),
    )


def _tail(lost: Column, good: Column, rate: float) -> Column:
    """P(Bin(good, rate) <= lost), summed in logarithms; 1 beyond the mean, where no test passes."""
    start = good * F.log(F.lit(1.0 - rate))
    step = F.log(F.lit(rate / (1.0 - rate)))

    def more(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((good - j + 1) / j) + step
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    upto = F.when(lost >= 1, F.sequence(F.lit(1).cast("long"), lost)).otherwise(F.array().cast("array<long>"))
    summed = F.aggregate(
        upto, F.struct(start.alias("term"), F.exp(start).alias("total")), more, lambda acc: acc["total"]
    )
    return F.when(lost > good * rate, F.lit(1.0)).otherwise(summed)


def certified_cutoffs(rated: DataFrame, labels: DataFrame, risk: RiskControl = RiskControl()) -> DataFrame:
    """``stratum, rule, cutoff``: the certified cutoff of each stratum and rule that has one.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); the worst of several labels
    counts, null labels don't. A stratum with too few labels gets no row, so nothing is
    rejected on its account.
    """
    marked = only(labels, "doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    each = rated.where(~F.col("base_failed")).join(marked, "doc_id").select(
        "stratum",
        "quality",
        (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").alias("holdout"),
        F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("cutoff")) for r in RULES))).alias("of"),
    )
    counted = each.groupBy("stratum", "of.rule", "of.cutoff").agg(
        *(
            F.count_if((F.col("holdout") == holdout) & (F.col("quality") == quality)).alias(name)
            for name, holdout, quality in (
                ("held_good", True, 1),
                ("own_good", False, 1),
                ("own_bad", False, 0),
            )
        )
    )
    family = Window.partitionBy("stratum", "rule")
    above = family.orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    tests = len(RULES) * F.col("strata")
    strata = counted.agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("null"))).alias("strata"))
    rate = risk.alpha / len(RULES)
    tested = (
        counted.select(
            "stratum",
            "rule",
            "cutoff",
            F.sum("held_good").over(family).alias("good"),
            F.sum("held_good").over(above).alias("lost"),
            (F.sum("own_bad").over(above) - F.sum("own_good").over(above)).alias("gain"),
        )
        .join(F.broadcast(strata))  # one row
        .where("cutoff >= 1")
        .withColumn("failed", (_tail(F.col("lost"), F.col("good"), rate) > risk.delta / tests).cast("int"))
        .withColumn("failed", F.max("failed").over(above))
    )
    best = family.orderBy(F.desc("gain"), F.desc("cutoff"))
    return (
        tested.where("failed = 0 AND gain > 0")
        .withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .select("stratum", "rule", "cutoff")
    )


def apply_quality_rules(documents: DataFrame, labels: DataFrame, risk: RiskControl = RiskControl()) -> DataFrame:
    """The counts of each document, ``base_failed``, the rules that reject it, and ``kept``.

    Empty tables give empty results; without labels only the base rule decides. Columns other
    than ``doc_id, text, lang`` are not looked at.
    """
    rated = persisted_copy(with_rates(features(documents)), "quality-rates")
    chosen = certified_cutoffs(rated, labels, risk).groupBy("stratum").agg(
        *(F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"{rule}_from") for rule in RULES)
    )
    chosen = persisted_copy(chosen, "quality-cutoffs").withColumnRenamed("stratum", "of_stratum")
    joined = rated.join(chosen, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    hits = F.array_compact(F.array(*(F.when(F.col(r) >= F.col(f"{r}_from"), F.lit(r)) for r in RULES)))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size(hits) == 0)).alias("kept"),
        F.array_join(hits, ",").alias("rejected_by"),
    )
