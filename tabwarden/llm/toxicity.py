"""Toxicity by weak supervision.

*Voters.* Lexicon voters fire on a word, pattern voters on one, two or four different words that begin
alike. They are chosen by the likelihood ratio of their firing in labelled documents, the labels of the held-out
and of the tuning fold apart; nobody votes for what is clean, silence is a vote only through the model.

*Label model.* A generative model says how often each voter fires on toxic and on clean
documents. It is fitted by expectation maximisation to the firing patterns of all documents,
labelled ones having their label as one more, fallible vote. Voters that err together on clean
documents are correlated, and so are those that are silent together on toxic ones; each
one's weight for firing, and for silence, is divided among those it doubles.

*Classifier.* The posteriors of the label model are the targets of a logistic regression on the
voters. Its probability, shifted to the operating point that the labels of the tuning fold choose, is the score.

Sizes: voters and labelled rows are bounded parameters and are what is broadcast. Patterns
are counted by Spark over all documents; only sums per voter or pair of voters come to the driver.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import slices
from tabwarden.session import persisted_copy


@dataclass(frozen=True)
class ToxicityRule:
    #: Most labelled rows that voters are chosen from (those with the least hashed ids).
    labelled: int = 40_000
    #: Most voters, and most candidates that they are chosen among.
    voters: int = 256
    candidates: int = 4000
    #: Characters of the beginnings that pattern voters look at.
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    #: Pattern voters also ask for so many different words that begin alike.
    least_words: tuple[int, ...] = (2, 4)
    #: Least likelihood ratio statistic of a voter, and least share of toxic among its documents.
    evidence: float = 25.0
    precision: float = 0.5
    #: A voter must see so many toxic labelled documents, less the cost of each clean one, that
    #: fewer than ``voters_each`` better voters see.
    least_new: int = 3
    clean_cost: float = 1.0
    voters_each: int = 2
    #: How often a label is taken to be right.
    label_accuracy: float = 0.95
    rounds: int = 6
    #: Most steps of Newton's method; it ends when no weight moves any more.
    newton: int = 12
    folds: int = 5
    #: The fold whose labels choose the operating point and nothing else.
    tuning_fold: int = 1


@dataclass(frozen=True)
class ToxicityModel:
    """Voters in order, and the classifier's weights for them."""

    voters: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def held_out(folds: int = 5, doc_id: str = "doc_id") -> Column:
    """Fold zero by crc32 of the id as text; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def usable_labels(labels: DataFrame, rule: ToxicityRule) -> DataFrame:
    """``doc_id, toxic, tuning`` of the labels that may be learned from, one row per document."""
    marked = labels.select("doc_id", "toxic").where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(rule.folds))
    tuning = F.crc32(F.col("doc_id").cast("string")) % rule.folds == rule.tuning_fold
    return marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("tuning", tuning)


_WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str) -> set[str]:
    """Runs of letters, lower-cased."""
    return set(_WORD.findall(text.lower()))


def signs(word: str, beginnings: tuple[int, ...]) -> list[str]:
    """What a word may make fire: its beginnings, and the whole word, closed by ``$``."""
    return [word[:n] for n in beginnings if n <= len(word)] + [word + "$"]


def _tally(beginnings, least_words):
    """(text, toxic) -> sign, documents with it that are toxic and that are not, per slice."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        known: dict[str, list[str]] = {}
        for batch in slices(batches, 2 << 20):
            counts = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own: Counter[str] = Counter()
                for word in distinct_words(text or ""):
                    if word not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[word] = signs(word, beginnings)
                    own.update(known[word])
                often = [f"{sign}#{k}" for sign, words in own.items() if words > 1 for k in least_words if words >= k]
                counts[toxic].update(own.keys())
                counts[toxic].update(often)
            all_signs = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(all_signs, pa.string()),
                    pa.array([counts[1][s] for s in all_signs], pa.int64()),
                    pa.array([counts[0][s] for s in all_signs], pa.int64()),
                ],
                ["sign", "toxic", "clean"],
            )

    return run


def choose_voters(documents: DataFrame, labels: DataFrame, rule: ToxicityRule) -> tuple[list[str], float]:
    """The voters, and the share of toxic rows among the labelled."""
    marked = usable_labels(labels, rule).where("NOT tuning").drop("tuning")
    # A bounded number of rows by construction, so it may be broadcast.
    marked = marked.orderBy(F.xxhash64("doc_id")).limit(rule.labelled)
    texts = documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", "toxic")
    whole = marked.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    n1, n = whole["toxic"] or 0, whole["n"] or 0
    if not n1 or n1 == n:
        return [], (n1 + 1) / (n + 2)
    n0 = n - n1
    tally = texts.mapInArrow(_tally(rule.beginnings, rule.least_words), "sign string, toxic long, clean long")
    tally = tally.groupBy("sign").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a"), F.col("b")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    both = a + b
    statistic = 2 * (
        part(a, both * n1 / n) + part(b, both * n0 / n) + part(n1 - a, (n - both) * n1 / n) + part(n0 - b, (n - both) * n0 / n)
    )
    top = (
        tally.where((a >= 3) & (a >= rule.precision * both))
        .withColumn("statistic", statistic)
        .where(F.col("statistic") >= rule.evidence)
        .orderBy(F.desc("statistic"), "sign")
        .limit(rule.candidates)
        .collect()
    )
    candidates, clean = [row["sign"] for row in top], [row["b"] for row in top]
    # Copies of one toxic text make all its words look telling; what better voters see already is no evidence.
    toxic = firing(texts.where("toxic = 1"), candidates, rule, carry=("toxic",)).select("fired").collect()
    seen_by: list[list[int]] = [[] for _ in candidates]
    for document, row in enumerate(toxic):
        for candidate in row["fired"]:
            seen_by[candidate].append(document)
    covered = [0] * len(toxic)

    def gain(candidate: int) -> float:
        return sum(covered[d] < rule.voters_each for d in seen_by[candidate]) - rule.clean_cost * clean[candidate]

    # Gains only fall, so a candidate is looked at again only when its last gain is the best.
    heap = [(-gain(c), c) for c in range(len(candidates))]
    heapq.heapify(heap)
    chosen, stems = [], []
    while heap and len(chosen) < rule.voters and -heap[0][0] >= rule.least_new:
        _, best = heapq.heappop(heap)
        now = gain(best)
        stem = re.sub(r"\$$|#\d+$", "", candidates[best])
        if any(stem.startswith(other) or other.startswith(stem) for other in stems):
            continue  # says the same as a better voter
        if heap and now < -heap[0][0]:
            heapq.heappush(heap, (-now, best))
        elif now >= rule.least_new:
            chosen.append(candidates[best])
            stems.append(stem)
            for d in seen_by[best]:
                covered[d] += 1
    return chosen, n1 / n


def _fire(voters, beginnings, carry):
    """Documents with the numbers of the voters that fire on them, ascending."""

    def run(batches):
        import pyarrow as pa

        # The signs that voters look at, and for each the voters with the words that they ask for.
        number: dict[str, list[tuple[int, int]]] = {}
        for i, voter in enumerate(voters.value):
            sign, _, least = voter.partition("#")
            number.setdefault(sign, []).append((int(least or 1), i))
        known: dict[str, tuple[str, ...]] = {}
        for batch in slices(batches, 2 << 20):
            fired = []
            for text in batch.column("text").to_pylist():
                own: dict[str, int] = {}
                for word in distinct_words(text or ""):
                    hit = known.get(word)
                    if hit is None:
                        if len(known) > 200_000:
                            known.clear()
                        hit = known[word] = tuple(s for s in signs(word, beginnings) if s in number)
                    for sign in hit:
                        own[sign] = own.get(sign, 0) + 1
                fired.append(sorted(i for sign, words in own.items() for least, i in number[sign] if words >= least))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(fired, pa.list_(pa.int32()))], [*carry, "fired"]
            )

    return run


def firing(documents: DataFrame, voters: list[str], rule: ToxicityRule, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``fired``."""
    shared = documents.sparkSession.sparkContext.broadcast(tuple(voters))
    rows = documents.select(*dict.fromkeys((*carry, "text")))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", fired array<int>"
    return rows.mapInArrow(_fire(shared, rule.beginnings, carry), schema)


class LabelModel:
    """How often each voter fires on toxic and clean documents, and how far voters double one
    another."""

    def __init__(self, n_voters: int, prior: float, rule: ToxicityRule):
        import numpy as np

        self.rule, self.prior = rule, prior
        self.toxic = np.full(n_voters, 0.3)
        self.clean = np.full(n_voters, 0.002)
        #: Voters that each one's firing on clean documents, and silence on toxic ones, counts for.
        self.err_together = np.ones(n_voters)
        self.miss_together = np.ones(n_voters)

    def weights(self):
        """(bias, weight of each voter's firing) of the posterior's log odds."""
        import numpy as np

        fires = np.log(self.toxic / self.clean) / self.err_together
        silent = np.log((1 - self.toxic) / (1 - self.clean)) / self.miss_together
        return float(np.log(self.prior / (1 - self.prior)) + silent.sum()), fires - silent

    def posterior(self) -> Column:
        bias, weights = self.weights()
        sure = self.rule.label_accuracy
        label = F.when(F.col("label") == 1, F.log(F.lit(sure / (1 - sure)))).when(F.col("label") == 0, -F.log(F.lit(sure / (1 - sure))))
        odds = _sum_of(weights, bias) + F.coalesce(label, F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def _sum_of(weights, bias: float) -> Column:
    table = F.array(*(F.lit(float(w)) for w in weights))
    if not len(weights):
        return F.lit(float(bias))
    return F.aggregate(
        F.transform("fired", lambda v: F.get(table, v)), F.lit(float(bias)), lambda total, weight: total + weight
    )


def _pairs(n_voters: int):
    """Documents on which a pair of voters fires, toxic and clean by the posterior, per task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        toxic, clean = np.zeros((n_voters, n_voters)), np.zeros((n_voters, n_voters))
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("fired", "n", "q")), strict=True)
            for fired, n, q in rows:
                if fired:
                    toxic[np.ix_(fired, fired)] += n * q
                    clean[np.ix_(fired, fired)] += n * (1 - q)
        j, k = np.nonzero(toxic + clean)
        yield pa.RecordBatch.from_arrays(
            [pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(toxic[j, k]), pa.array(clean[j, k])],
            ["j", "k", "toxic", "clean"],
        )

    return run


def _together(both, rate):
    """One, plus the correlations with the other voters in one class beyond chance."""
    import numpy as np

    spread = np.sqrt(rate * (1 - rate))
    correlation = (both - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    return 1 + np.where(correlation < 0.2, 0, correlation.clip(0, 1)).sum(axis=1)


def fit_label_model(patterns: DataFrame, n_voters: int, prior: float, rule: ToxicityRule) -> LabelModel:
    """Expectation maximisation over ``fired, label, n`` rows, from the rates of the labelled ones."""
    import numpy as np

    model = LabelModel(n_voters, prior, rule)
    for turn in range(rule.rounds + 1):
        if turn:
            scored = patterns.withColumn("q", model.posterior())
        else:
            scored = patterns.where("label IS NOT NULL").withColumn("q", F.col("label").cast("double"))
        whole = scored.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("q")).first()
        n, q = float(whole["n"] or 0), float(whole["q"] or 0)
        if not n:
            continue
        each = (
            scored.select(F.explode("fired").alias("voter"), "n", (F.col("n") * F.col("q")).alias("nq"))
            .groupBy("voter")
            .agg(F.sum("n").alias("n"), F.sum("nq").alias("nq"))
            .collect()
        )
        fires, on_toxic = np.zeros(n_voters), np.zeros(n_voters)
        for row in each:
            fires[row["voter"]], on_toxic[row["voter"]] = row["n"], row["nq"]
        model.toxic = np.clip((on_toxic + 0.1) / (q + 0.5), 1e-4, 0.995)
        model.clean = np.clip((fires - on_toxic + 0.1) / (n - q + 100), 1e-6, 0.995)
        model.clean = np.minimum(model.clean, model.toxic * 0.9)
        model.prior = min(max(q / n, 1e-3), 0.5)
        if turn == rule.rounds // 2:
            sums = scored.select("fired", F.col("n").cast("double").alias("n"), "q").mapInArrow(
                _pairs(n_voters), "j int, k int, toxic double, clean double"
            )
            both = np.zeros((2, n_voters, n_voters))
            for row in sums.groupBy("j", "k").agg(F.sum("toxic"), F.sum("clean")).collect():
                both[:, row[0], row[1]] = row[2], row[3]
            model.miss_together = _together(both[0] / max(q, 1e-9), model.toxic)
            model.err_together = _together(both[1] / max(n - q, 1e-9), model.clean)
    return model


def _newton_sums(w, n_voters: int):
    """Gradient and curvature of the logistic loss at ``w``, per task: rows (j, k, value), the gradient as k = -1."""

    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa

        size = n_voters + 1
        curvature, gradient = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for fired, n, q in zip(*(batch.column(c).to_pylist() for c in ("fired", "n", "q")), strict=True):
                at = [*fired, n_voters]
                p = 1 / (1 + math.exp(-min(max(w[at].sum(), -30), 30)))
                gradient[at] += n * (p - q)
                curvature[np.ix_(at, at)] += n * p * (1 - p) + 1e-9
        j, k = np.nonzero(curvature)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(j, np.arange(size)), pa.int32()),
                pa.array(np.append(k, np.full(size, -1)), pa.int32()),
                pa.array(np.append(curvature[j, k], gradient)),
            ],
            ["j", "k", "value"],
        )

    return run


def fit_classifier(scored: DataFrame, n_voters: int, rule: ToxicityRule) -> tuple[list[float], float]:
    """Logistic regression of the posteriors on the voters, by Newton's method over all patterns.

    Spark adds up gradient and curvature, so only sums for pairs of voters come to the driver.
    """
    import numpy as np

    rows = persisted_copy(scored.select("fired", F.col("n").cast("double").alias("n"), "q"), "posteriors")
    size = n_voters + 1
    w, ridge = np.zeros(size), np.full(size, 1.0)
    ridge[-1] = 1e-3
    for _ in range(rule.newton):
        sums = rows.mapInArrow(_newton_sums(w, n_voters), "j int, k int, value double")
        curvature, gradient = np.diag(ridge), ridge * w
        for row in sums.groupBy("j", "k").agg(F.sum("value")).collect():
            if row[1] < 0:
                gradient[row[0]] += row[2]
            else:
                curvature[row[0], row[1]] += row[2]
        moved = np.clip(w - np.linalg.solve(curvature, gradient), -20, 20)
        done = np.abs(moved - w).max() < 1e-6
        w = moved
        if done:
            break
    return w[:-1].tolist(), float(w[-1])


def set_operating_point(tuning: DataFrame, weights: list[float], bias: float) -> tuple[list[float], float]:
    """Shift the odds so that 0.5 is the cut with the least balanced error on the tuning labels.

    ``tuning`` has ``fired, label, n`` of labelled documents whose labels nothing else has seen. Errors on toxic
    and on clean documents weigh the same: toxic ones are few, and a cut for plain counts would leave out most
    of those that few voters see. Among the best cuts that in the middle of the widest gap is taken.
    """
    import numpy as np

    tenth = F.round(_sum_of(weights, bias), 1)
    rows = tuning.groupBy(tenth.alias("odds"), "label").agg(F.sum("n").alias("n")).orderBy("odds").collect()
    if len({row["label"] for row in rows}) < 2:
        return weights, bias
    levels = np.unique([row["odds"] for row in rows])
    share = np.zeros((2, len(levels)))
    for row in rows:
        share[row["label"], np.searchsorted(levels, row["odds"])] += row["n"]
    share /= share.sum(axis=1, keepdims=True)
    # Error of calling toxic what lies above level i.
    error = np.cumsum(share[1])[:-1] + 1 - np.cumsum(share[0])[:-1]
    if not len(error) or error.min() >= 1:
        return weights, bias
    gaps = np.where(error <= error.min() + 1e-9, np.diff(levels), 0)
    at = int(np.argmax(gaps))
    return weights, bias - float(levels[at] + levels[at + 1]) / 2


def train(documents: DataFrame, labels: DataFrame, rule: ToxicityRule = ToxicityRule()) -> ToxicityModel:
    """Voters, label model and classifier, from all documents and the labels of the folds that
    aren't held out. Without usable labels the model scores every text alike, by the prior."""
    import math

    voters, prior = choose_voters(documents, labels, rule)
    if not voters:
        return ToxicityModel((), (), math.log(prior / (1 - prior)) if 0 < prior < 1 else -3.0)
    marked = usable_labels(labels, rule).select("doc_id", F.col("toxic").alias("label"), "tuning")
    fired = firing(documents, voters, rule)
    seen = persisted_copy(
        fired.join(marked, "doc_id", "left").groupBy("fired", "label", "tuning").agg(F.count("*").alias("n")), "patterns"
    )
    known = F.when(~F.col("tuning"), F.col("label"))
    patterns = persisted_copy(seen.groupBy("fired", known.alias("label")).agg(F.sum("n").alias("n")), "known-patterns")
    model = fit_label_model(patterns, len(voters), prior, rule)
    weights, bias = fit_classifier(patterns.withColumn("q", model.posterior()), len(voters), rule)
    weights, bias = set_operating_point(seen.where("tuning"), weights, bias)
    return ToxicityModel(tuple(voters), tuple(weights), bias)


def score(documents: DataFrame, model: ToxicityModel, rule: ToxicityRule = ToxicityRule(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Only the text decides. Null and empty texts, on which no voter fires, have the base score.
    """
    odds = _sum_of(model.weights, model.bias)
    scored = firing(documents, list(model.voters), rule, carry).withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.drop("fired").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
