"""Mixing sources to target weights by soft domain membership, without Python on the executors.

A multinomial classifier on hashed words is fitted on a bounded sample of labelled rows and gives each document a
probability for each domain.  Projected-gradient least squares then finds document rates that are not negative and
whose expected domain token totals match the targets.  With ``p`` a document's probabilities and ``n`` its tokens the
step is ``rate = max(0, rate - p . s)``; ``s`` solves the token-weighted Gram matrix of the documents still above zero
against the residual, so a step is exact where nothing is cut off.  Each step is one aggregate of a few numbers over a
narrow stored table; only those numbers reach the driver.

A rate becomes copies: its whole part, and one more for the share of ids (by hash) that its fraction says.

Null text counts as empty and has 0 tokens; such a document keeps its rate and moves no total.  Rows with the same id
get the same treatment, and an id is learned from once per domain.  Labelled rows without a domain or an id are not
learned from; with one domain every document belongs to it, with none all rates are 1.  A target of a domain that no
labelled row has is left out, a domain without a target keeps the share it has, and the targets share what is left.
More than ``MOST_DOMAINS`` domains are an error.  Targets that no rates can meet give the nearest ones that the steps
reach; how far each domain is off is part of the result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import stored

#: The bounded training sample, and the buckets that words are hashed to.
TRAIN_ROWS, BUCKETS = 10_000, 1 << 12
STEPS, CLOSE = 25, 1e-9
#: Domains at most; each is a class of the classifier.
MOST_DOMAINS = 64
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


class Domains:
    """The fitted classifier: names of the domains, and a frame with ``_p`` (probabilities) and ``_n`` (tokens)."""

    def __init__(self, names: list[str], model) -> None:
        self.names, self.model = names, model

    def apply(self, docs: DataFrame) -> DataFrame:
        found = _tokens(docs)
        if len(self.names) < 2:
            return found.withColumn("_p", F.array(*[F.lit(1.0) for _ in self.names]).cast("array<double>")).drop("_words")
        scored = self.model.transform(_hashed(found))
        return scored.withColumn("_p", vector_to_array("_probability")).drop("_words", "_features", "_raw", "_probability", "_predicted")


def _tokens(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("_words", F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    return found.withColumn("_n", F.size("_words").cast("long"))


def _hashed(found: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, inputCol="_words", outputCol="_features", binary=True).transform(found)


def _quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows of each domain in proportion to all its rows, at least one, ``rows`` together."""
    total = sum(counts.values())
    if total <= rows:
        return counts
    quota = {d: max(1, rows * n // total) for d, n in counts.items()}
    while sum(quota.values()) > rows and max(quota.values()) > 1:
        quota[max(quota, key=lambda d: (quota[d], d))] -= 1
    return quota


def _last_orders(known: DataFrame, counts: dict[str, int], quota: dict[str, int]) -> DataFrame:
    """``domain, _last``: where in the hash order the quota of each domain ends; one row per domain."""
    # a hash below this share holds the quota but for a chance below 1e-9, so what is sorted stays bounded
    share = {d: min(1.0, (quota[d] + 6 * quota[d] ** 0.5 + 30) / n) for d, n in counts.items()}
    place = F.col("_order.place") / float(1 << 30)
    near = reduce(Column.__or__, [(F.col("domain") == d) & (place < x) for d, x in share.items()])
    ranked = known.filter(near).withColumn("_rank", F.row_number().over(Window.partitionBy("domain").orderBy("_order")))
    wanted = reduce(Column.__or__, [(F.col("domain") == d) & (F.col("_rank") <= n) for d, n in quota.items()])
    return ranked.filter(wanted).groupBy("domain").agg(F.max("_order").alias("_last"))


def fit_domains(labelled: DataFrame, rows: int = TRAIN_ROWS, docs: DataFrame | None = None) -> Domains:
    """Fit on ``rows`` rows of ``doc_id, domain`` at most, of each domain the first by a hash of their id.

    Counts and sample are taken from ids and domains alone; then one scan of ``docs`` (or of ``labelled``, if it has the texts
    itself) fetches the texts of the chosen ids, so no text outside the sample is ever moved.
    """
    order = F.struct(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)).alias("place"), "doc_id").alias("_order")
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
    known = stored(known.filter("domain IS NOT NULL AND doc_id IS NOT NULL").distinct().select("doc_id", "domain", order), "mix-known")
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(MOST_DOMAINS + 1).collect()}
    if len(counts) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains; join some of them first")
    names = sorted(counts)
    if len(names) < 2:
        return Domains(names, None)
    chosen = known
    if sum(counts.values()) > rows:
        last = _last_orders(known, counts, _quotas(counts, rows))
        chosen = known.join(F.broadcast(last), "domain").filter(F.col("_order") <= F.col("_last"))
    chosen = F.broadcast(stored(chosen.select("doc_id", "domain"), "mix-chosen"))  # at most ``rows``
    texts = (labelled if docs is None else docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # an id that several rows have is learned from once
    sample = texts.join(chosen, "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    sample = stored(_tokens(sample).select("_words", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("domain")).alias("_class")), "mix-train")
    if sample.isEmpty():  # none of the labelled ids is among the documents
        return Domains([], None)
    sample = _hashed(sample).withColumn("_label", (F.col("_class") - 1).cast("double")).filter("_label >= 0")
    logistic = LogisticRegression(
        featuresCol="_features", labelCol="_label", probabilityCol="_probability", rawPredictionCol="_raw",
        predictionCol="_predicted", family="multinomial", maxIter=20, regParam=1e-3, standardization=False,
    )
    return Domains(names, logistic.fit(sample))


def language_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: the labelled rows of ``docs`` with their language as domain; their texts stay where they are."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("domain")).join(ids, "doc_id")


def _dot(p: Column, step: np.ndarray) -> Column:
    return sum((p[i] * F.lit(float(x)) for i, x in enumerate(step)), F.lit(0.0))


def rate(steps: list[np.ndarray], p: Column) -> Column:
    now = F.lit(1.0)
    for step in steps:
        now = F.greatest(F.lit(0.0), now - _dot(p, step))
    return now


class Steps(list):
    """The steps that lead from rate 1 to the rates, and by which share of all tokens each domain misses its target."""

    missed: dict[str, float]


def wanted_shares(names: list[str], targets: dict[str, float], have: np.ndarray) -> np.ndarray:
    """The share of the tokens that each domain is to have: its target, or what it has where it has none."""
    listed = np.array([n in targets for n in names], bool)
    given = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    kept = np.where(listed, 0.0, have / have.sum())
    return kept + given / given.sum() * (1 - kept.sum()) if given.sum() else have / have.sum()


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float], tokens: float | None = None) -> Steps:
    """The steps that lead from rate 1 to the rates, from a stored frame of ``_n, _p``.

    ``tokens``: the expected total; by default the least at which no domain with a target must lose tokens, so
    documents are repeated rather than left out.
    """
    size, steps = len(names), Steps()
    steps.missed = dict.fromkeys(names, 0.0)
    if not size:
        return steps
    have = members.agg(*[F.sum(F.col("_n") * F.col("_p")[i]) for i in range(size)]).first()
    have = np.array([x or 0.0 for x in have])
    if not have.sum():
        return steps
    wanted = wanted_shares(names, targets, have)
    total = tokens or float((have[wanted > 0] / wanted[wanted > 0]).max())
    for k in range(STEPS + 1):
        now, p, n = rate(steps, F.col("_p")), F.col("_p"), F.col("_n").cast("double")
        active = members.select(F.col("_p"), n.alias("n"), (n * now).alias("mass"), F.when(now > 0, n).otherwise(0.0).alias("free"))
        sums = active.agg(
            *[F.sum(F.col("mass") * p[i]) for i in range(size)],
            *[F.sum(F.col("free") * p[i] * p[j]) for i in range(size) for j in range(i, size)],
        ).first()
        residual = np.array(sums[:size]) - wanted * total
        steps.missed = dict(zip(names, (residual / total).tolist()))
        if np.abs(residual).max() <= CLOSE * total or k == STEPS:
            break
        gram = np.zeros((size, size))
        gram[np.triu_indices(size)] = sums[size:]
        gram = gram + np.triu(gram, 1).T
        steps.append(np.linalg.lstsq(gram + np.eye(size) * 1e-12 * total, residual, rcond=None)[0])
    return steps


def copies(rates: Column, doc_id: Column) -> Column:
    """Whole copies of a document: the fraction of its rate is a chance that its id decides."""
    chance = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor(rates)
    return (whole + (chance < rates - whole).cast("long")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``doc_id, n_tokens, posterior, rate, copies, missed`` for every row.

    ``posterior`` maps domains to probabilities, ``missed`` to the share of all tokens by which they are off (all rows alike).
    """
    domains = fit_domains(labelled, docs=docs)
    members = stored(domains.apply(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_n", "_p"), "mix-members")
    steps = fit_rates(members, domains.names, targets)
    names = F.array(*[F.lit(n) for n in domains.names]).cast("array<string>")
    missed = F.array(*[F.lit(float(steps.missed[n])) for n in domains.names]).cast("array<double>")
    return members.select(
        "doc_id", F.col("_n").alias("n_tokens"), F.map_from_arrays(names, F.col("_p")).alias("posterior"), rate(steps, F.col("_p")).alias("rate"),
        F.map_from_arrays(names, missed).alias("missed"),
    ).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs`` as often as their copies say, all columns as they were.

    A row travels as one value beside its probabilities, so it is classified once and no column of it can be mistaken.
    """
    domains = fit_domains(labelled, docs=docs)
    scored = domains.apply(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"))
    scored = stored(scored.select("_row", "_n", "_p"), "mix-members")
    steps = fit_rates(scored, domains.names, targets)
    made = scored.withColumn("_copies", copies(rate(steps, F.col("_p")), F.col("_row.doc_id").cast("long"))).filter("_copies > 0")
    return made.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
