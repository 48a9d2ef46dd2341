"""Mixing to target weights with soft memberships, in DataFrame functions only.

A naive Bayes classifier, fitted on a labelled table, gives each document a posterior over domains. A
least-squares fit then finds nonnegative document rates whose expected domain token totals match the
targets. It is solved in its dual: the rates follow from one vector of multipliers, so the driver holds
such a vector and no rates.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Expected number of labelled documents that the classifier is fitted on, and of tokens it looks at.
SAMPLE_DOCS = 20_000
MARKERS = 64
#: Words in more than this share of the documents tell a text's length rather than its domain.
MAX_SHARE = 0.2
MAX_DOMAINS = 64
STEPS, TOLERANCE = 40, 1e-7
#: The fit's pull towards a rate of 1, from step to step, and its Newton steps at each.
RIDGES, NEWTON_STEPS = (1e-2, 1e-4, 1e-6, 1e-8, 1e-10), STEPS
#: Target shares of the expected tokens for the domains that :func:`label_domains` names.
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    bias: list[float]
    markers: list[str]
    weights: list[list[float]]  # by domain, by marker


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from a table of quality and toxicity marks; rows without marks are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")


def _band(name: str, x: Column, edges: list[float]) -> Column:
    found = F.lit(f"\x01{name}{len(edges)}")
    for i, edge in reversed(list(enumerate(edges))):
        found = F.when(x < edge, f"\x01{name}{i}").otherwise(found)
    return found


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x09-\\x0D ]+"))


def _with_tokens(docs: DataFrame) -> DataFrame:
    """``docs`` with _tokens, the number of words, and _types: distinct words, and bands of whole-text figures as tokens no word can equal."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("_words", _words(F.col("text")))
    found = found.withColumn("_tokens", F.size("_words").cast("double")).withColumn("_types", F.array_distinct("_words")).drop("_words")
    n = F.greatest(F.col("_tokens"), F.lit(1.0))
    marks = F.array(
        _band("symbols", F.regexp_count(text, F.lit("[!#$%&*|]{2,}|\\|")) / n, [0.001, 0.02, 0.2]),
        _band("capitals", F.regexp_count(text, F.lit("[A-Z]{4,}")) / n, [0.001, 0.02, 0.2]),
        _band("distinct", F.size("_types") / n, [0.2, 0.4, 0.6, 0.8]),
        _band("length", F.length(text) / n, [4.0, 6.0, 8.0, 12.0]),
        _band("words", n, [20.0, 100.0, 500.0, 2000.0]),
    )
    return found.withColumn("_marks", marks)


def fit(docs: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, markers: int = MARKERS) -> Classifier:
    """Bernoulli naive Bayes on the tokens that tell most about the domain (mutual information).

    ``labelled`` is (doc_id, domain); of several labels of a document the smallest counts; of more than
    MAX_DOMAINS domains the most frequent are learned, with a warning. Fitted on about ``sample_docs``
    labelled documents at most, picked by a hash of the id.
    """
    labelled = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sizes = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        warnings.warn(f"more than {MAX_DOMAINS} domains; documents of all but the most frequent count as unlabelled", stacklevel=2)
        sizes = dict(list(sizes.items())[:MAX_DOMAINS])
        labelled = labelled.filter(F.col("domain").isin(*sizes))
    share = min(1.0, sample_docs / max(1, sum(sizes.values())))
    draw = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(0x7FFFFFFF)
    sample = labelled.filter(draw < int(share * (1 << 31)))
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(sample), F.col("_id") == F.col("doc_id"))
    rows = common.stored(_with_tokens(rows).select("domain", F.concat("_types", "_marks").alias("tokens")), "sample")
    held = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    domains, total = sorted(held), sum(held.values())
    if not domains:
        return Classifier([], [], [], [])
    counts = rows.select("domain", F.explode("tokens").alias("token")).groupBy("token").agg(*(F.count_if(F.col("domain") == d).alias(f"d{i}") for i, d in enumerate(domains)))
    columns = {d: F.col(f"d{i}") for i, d in enumerate(domains)}
    df = sum(columns.values(), F.lit(0))

    def gain(joint: Column, side: Column, size: int) -> Column:
        return F.when(joint > 0, joint / total * F.ln(joint * total / (side * size))).otherwise(0.0)

    information = sum((gain(columns[d], df, held[d]) + gain(held[d] - columns[d], total - df, held[d]) for d in domains), F.lit(0.0))
    best = counts.withColumn("_gain", information).filter((df >= 5) & ((df <= MAX_SHARE * total) | F.startswith("token", F.lit("\x01")))).orderBy(F.desc("_gain"), "token").limit(markers).collect()
    p = {d: [(r[f"d{i}"] + 0.5) / (held[d] + 1.0) for r in best] for i, d in enumerate(domains)}
    bias = [math.log(held[d] / total) + sum(math.log(1 - x) for x in p[d]) for d in domains]
    weights = [[math.log(x) - math.log(1 - x) for x in p[d]] for d in domains]
    return Classifier(domains, bias, [r["token"] for r in best], weights)


def posteriors(docs: DataFrame, model: Classifier, prefix: str = "_p") -> DataFrame:
    """``docs`` with _tokens (words of the text) and _p0, _p1, ...: the posterior of each domain. A narrow projection."""
    markers = F.array(*(F.lit(x) for x in model.markers)) if model.markers else F.array().cast("array<string>")
    found = _with_tokens(docs).withColumn("_seen", F.concat(F.array_intersect("_types", markers), F.array_intersect("_marks", markers))).drop("_types", "_marks")
    k = len(model.domains)
    table = F.create_map(*(x for i, m in enumerate(model.markers) for x in (F.lit(m), F.array(*(F.lit(float(w[i])) for w in model.weights))))) if model.markers else None
    start = F.array(*(F.lit(float(b)) for b in model.bias))
    if table is not None:
        found = found.withColumn("_scores", F.aggregate("_seen", start, lambda acc, m: F.zip_with(acc, table[m], lambda a, b: a + b)))
    else:
        found = found.withColumn("_scores", start)
    found = found.withColumn("_odds", F.transform("_scores", lambda s: F.exp(s - F.array_max("_scores"))))
    found = found.withColumn("_sum", F.aggregate("_odds", F.lit(0.0), lambda a, b: a + b))
    found = found.withColumns({f"{prefix}{i}": F.col("_odds")[i] / F.col("_sum") for i in range(k)})
    return found.drop("_seen", "_scores", "_odds", "_sum")


def _rate(steps: list[np.ndarray], k: int, prefix: str = "_p") -> Column:
    """Rates after the given steps: rate = max(0, rate - p . step), from 1."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*(F.struct(*(F.lit(float(x)).alias(f"s{i}") for i, x in enumerate(step))) for step in steps))

    def move(rate: Column, step: Column) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((F.col(f"{prefix}{i}") * step[f"s{i}"] for i in range(k)), F.lit(0.0)))

    return F.aggregate(moves, F.lit(1.0), move)


def fit_rates(features: DataFrame, domains: list[str], targets: Mapping[str, float]) -> list[np.ndarray]:
    """One multiplier vector m, for rates max(0, 1 - p . m).

    Minimises |G^(-1/2) (A r - b)|^2 + e |r - 1|^2 over r >= 0, where A r are the expected tokens by
    domain, b the targets, G = sum of tokens x p p', and the last norm is weighted by tokens. The
    dual has one variable a domain, and Newton steps with a line search solve it; e falls until the
    targets are met, or ends at the last of RIDGES, where no rate is further from the optimum of the
    first term than e |r - 1| by its gradient. Totals further than TOLERANCE from the targets get a
    warning with the gaps.
    """
    k = len(domains)
    t, p = F.col("_tokens"), [F.col(f"_p{i}") for i in range(k)]
    sums = features.agg(F.sum(t), *(F.sum(t * p[i] * p[j]) for i in range(k) for j in range(k))).first()
    if not sums[0]:
        return []
    total = float(sums[0])
    gram = np.array(sums[1:], dtype=float).reshape(k, k) / total
    weights = np.array([max(0.0, float(targets.get(d, 0.0))) for d in domains])
    if weights.sum() <= 0:
        raise ValueError("no target weight falls on a domain of the labelled table")
    goal = weights / weights.sum()

    def value(m: np.ndarray, half_square: float, ridge: float) -> float:
        return half_square + float(goal @ m) + ridge / 2 * float(m @ gram @ m)

    def look(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the sum of squared rates, the domains' totals, and the Gram matrix of documents with a rate."""
        rate = _rate([m], k)
        held = F.when(rate > 0, t).otherwise(0.0)
        seen = features.select(t, *p, rate.alias("_r"), held.alias("_held"))
        found = seen.agg(
            F.sum(t * F.col("_r") * F.col("_r")),
            *(F.sum(t * F.col("_r") * x) for x in p),
            *(F.sum(F.col("_held") * p[i] * p[j]) for i in range(k) for j in range(k)),
        ).first()
        found = np.array(found, dtype=float) / total
        return found[0] / 2, found[1 : k + 1], found[k + 1 :].reshape(k, k)

    def squares(ms: list[np.ndarray]) -> np.ndarray:
        return np.array(features.agg(*(F.sum(t * _rate([m], k) * _rate([m], k)) for m in ms)).first(), dtype=float) / total / 2

    m = np.zeros(k)
    now = look(m)
    for ridge in RIDGES:
        for _ in range(NEWTON_STEPS):
            slope = goal - now[1] + ridge * gram @ m
            if np.abs(slope).max() <= TOLERANCE / 10:
                break
            step = -np.linalg.lstsq(now[2] + ridge * gram, slope, rcond=1e-15)[0]
            least = value(m, now[0], ridge) + 1e-4 * float(slope @ step)
            after = look(m + step)
            if value(m + step, after[0], ridge) > least:
                tried = [m + step / 2**i for i in range(1, 21)]
                values = [value(x, h, ridge) for x, h in zip(tried, squares(tried), strict=True)]
                best = int(np.argmin(values))
                if values[best] >= value(m, now[0], ridge):
                    break
                step = tried[best] - m
                after = look(tried[best])
            m, now = m + step, after
        if np.abs(now[1] - goal).max() <= TOLERANCE:
            break
    else:
        gaps = {d: float(x) for d, x in zip(domains, now[1] - goal, strict=True)}
        warnings.warn(f"the rates do not meet the target shares; remaining gaps in tokens over all tokens: {gaps}", stacklevel=2)
    return [m]


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], sample_docs: int = SAMPLE_DOCS, carry: list[str] | None = None) -> tuple[DataFrame, Classifier]:
    """row (the ``carry`` columns of ``docs``, all by default), _tokens, _p0..., _rate and _copies; and the classifier.

    _copies is the rate rounded down or up by a hash of id and text, so that its expectation is the
    rate. Null and empty texts have no tokens, prior-like posteriors and the rate those imply; repeated
    rows get equal rates; without labels, or where no target falls on a domain that the labelled sample
    holds, every rate is 1; the tokens of a domain without a target go to nothing, and a target whose
    domain is absent from the sample can't be met: the others are scaled up to one, with a warning that
    names it. An empty table gives no rows; a very long text is one row like any other. The carried
    columns travel in one struct, ``row``, so none of their names can clash. Texts are read once: what
    the fit and the result need is stored in the shared folder.
    """
    model = fit(docs, labelled, sample_docs)
    k = len(model.domains)
    draw = F.xxhash64(F.lit(17), "doc_id", "text").bitwiseAND(0x7FFFFFFF) / F.lit(float(1 << 31))
    scored = posteriors(docs.select(common.whole_row(docs, carry), "text", draw.alias("_draw")), model)
    scored = common.stored(scored.select("row", "_draw", "_tokens", *(f"_p{i}" for i in range(k))), "features")
    absent = sorted(d for d, x in targets.items() if x > 0 and d not in model.domains)
    if absent:
        warnings.warn(f"no labelled document of the sample belongs to {absent}; the other targets are scaled up", stacklevel=2)
    reachable = any(targets.get(d, 0) > 0 for d in model.domains)
    rate = _rate(fit_rates(scored, model.domains, targets) if reachable else [], k)
    mixed = scored.withColumn("_rate", rate).withColumn("_copies", F.floor(F.col("_rate") + F.col("_draw")).cast("long"))
    return mixed.drop("_draw"), model


def resample(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """Each document as many times as the mixture takes it; columns as in ``docs``."""
    mixed, _ = mix(docs, labelled, targets)
    copies = mixed.filter("_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return copies.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed, model = mix(docs, label_domains(common.read_table(spark, sf_dir, "labels")), TARGETS, carry=["doc_id"])
    shares = [F.col(f"_p{i}").alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return mixed.select(F.col("row.doc_id").alias("doc_id"), F.col("_tokens").cast("long").alias("n_tokens"), *shares, F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))
