"""Mixing sources to target weights by soft membership, in DataFrame functions alone.

A naive Bayes classifier over hashed words, trained on a labelled table, gives each document posteriors over domains.
Nonnegative document rates r then minimise the squared error between expected domain token totals, sum of
r * tokens * posterior, and the targets, by distributed projected gradient: each step subtracts from every rate the inner
product of its posteriors with one vector of the step and cuts at zero. That vector is the gradient of the K totals
preconditioned by their K x K Gram matrix over the rates that are above zero, so few steps are needed; a step costs one
aggregation of K + K * K sums and keeps nothing for a document but its posteriors.

Contract. A word is a run of letters and digits in lower case. Null and empty texts have no tokens and the prior as
posteriors. The classifier is trained on up to about ``labelled`` labelled rows, drawn by a hash of doc_id; a labelled
doc_id with several domains takes the smallest. More than ``MOST_DOMAINS`` domains are an error. Domains without labelled rows can't be targeted: their weight is left
out and the others are scaled up. Without labelled rows all rates are 1. Rows that repeat get equal rates. Where no rates
reach the targets the nearest totals that the steps found are kept.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drawn
from tessera.plans.staging import stage

BUCKETS = 4096
#: Domains that a mixture may have: the plan has BUCKETS numbers for each and a sum for each pair, and its making takes minutes beyond.
MOST_DOMAINS = 16
#: A document's evidence counts as that of so many tokens at most, which keeps memberships soft.
EVIDENCE = 10
STEPS = 12
CLOSE = 1e-6


def _words(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _buckets(text):
    return F.transform(_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _array(values: list[float]):
    return F.from_json(F.lit(json.dumps([round(x, 9) for x in values])), "array<double>")


def classifier(docs: DataFrame, domains: DataFrame, labelled: int = 4_000) -> tuple[list[str], list[float], list[list[float]]]:
    """(domains, log priors, for each domain the log chance of each word bucket), from domains(doc_id, domain)."""
    known = domains.select(F.col("doc_id").alias("_id"), F.col("domain").cast("string").alias("domain")).dropna().groupBy("_id").agg(F.min("domain").alias("domain"))
    total, kinds = known.agg(F.count("*"), F.count_distinct("domain")).first()
    if kinds > MOST_DOMAINS:
        raise ValueError(f"{kinds} domains; group them into {MOST_DOMAINS} at most")
    sample = drawn(docs.select("doc_id", "text"), total, labelled, "doc_id").join(drawn(known, total, labelled, "_id"), F.col("doc_id") == F.col("_id"))
    counted = sample.select("domain", F.explode(_buckets(F.col("text"))).alias("b")).groupBy("domain", "b").count().collect()  # BUCKETS rows a domain at most
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    names = sorted(sizes)
    words: dict[str, list[float]] = {k: [0.5] * BUCKETS for k in names}
    for r in counted:
        words[r["domain"]][r["b"]] += r["count"]
    prior = [math.log(sizes[k] / sum(sizes.values())) for k in names]
    return names, prior, [[math.log(x / sum(words[k])) for x in words[k]] for k in names]


def with_posteriors(docs: DataFrame, model: tuple[list[str], list[float], list[list[float]]]) -> DataFrame:
    """docs with _tokens and _posteriors (in the order of the model's domains)."""
    names, prior, chance = model
    counted = docs.withColumn("_b", _buckets(F.col("text")))
    zero = F.lit(0.0)

    def summed(logs: list[float]):
        return F.aggregate("_b", zero, lambda acc, b: acc + F.get(_array(logs), b))

    sums = counted.withColumn("_s", F.array(*map(summed, chance))).withColumn("_tokens", F.size("_b").cast("long")).drop("_b")
    scale = F.least(F.col("_tokens"), F.lit(EVIDENCE)) / F.greatest(F.col("_tokens"), F.lit(1))
    logs = sums.withColumn("_l", F.zip_with(_array(prior), "_s", lambda p, s: p + s * scale)).drop("_s")
    top = logs.withColumn("_l", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
    return top.withColumn("_posteriors", F.transform("_l", lambda x: x / F.aggregate("_l", zero, lambda a, b: a + b))).drop("_l")


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b for a small symmetric matrix, with a slight ridge against rank loss."""
    n = len(b)
    ridge = 1e-9 * (sum(a[i][i] for i in range(n)) / n + 1e-12)
    m = [[*(a[i][j] + ridge * (i == j) for j in range(n)), b[i]] for i in range(n)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(m[r][c]))
        m[c], m[p] = m[p], m[c]
        for r in range(n):
            if r != c:
                f = m[r][c] / m[c][c]
                m[r] = [x - f * y for x, y in zip(m[r], m[c], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def _rate(steps: list[list[float]]):
    rate = F.lit(1.0)
    for s in steps:
        move = F.aggregate(F.zip_with("_posteriors", _array(s), lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b)
        rate = F.greatest(F.lit(0.0), rate - move)
    return rate


def fit_rates(members: DataFrame, names: list[str], weights: dict[str, float]) -> tuple[list[list[float]], list[float], list[float]]:
    """(steps, targets, expected totals) for members(_tokens, _posteriors)."""
    k = len(names)
    p = [F.get("_posteriors", F.lit(i)) for i in range(k)]
    total = float(members.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0])
    given = [max(0.0, float(weights.get(n, 0.0))) for n in names]
    targets = [total * w / (sum(given) or 1.0) for w in given]
    steps: list[list[float]] = []
    best: tuple[float, list[list[float]], list[float]] = (math.inf, [], [0.0] * k)
    for _ in range(STEPS + 1):
        sums = [F.sum(F.col("_r") * F.col("_tokens") * x) for x in p]
        gram = [F.sum(F.when(F.col("_r") > 0, F.col("_tokens") * p[i] * p[j])) for i in range(k) for j in range(k)]
        got = [float(x or 0.0) for x in members.withColumn("_r", _rate(steps)).agg(*sums, *gram).first()]
        miss = [x - t for x, t in zip(got[:k], targets, strict=True)]
        error = math.sqrt(sum(x * x for x in miss)) / max(total, 1.0)
        if error < best[0]:
            best = (error, list(steps), got[:k])
        if error < CLOSE or total == 0 or error > 2 * best[0]:
            break
        steps.append(solve([got[k + i * k : k + (i + 1) * k] for i in range(k)], miss))
    return best[1], targets, best[2]


def mixing_rates(docs: DataFrame, domains: DataFrame, weights: dict[str, float], labelled: int = 4_000, columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns of it) with _tokens, _domains, _posteriors and _rate. Each text is scored once, and staged."""
    model = classifier(docs, domains, labelled)
    columns = [c for c in (docs.columns if columns is None else columns) if c not in ("_tokens", "_domains", "_posteriors", "_rate")]
    if not model[0]:
        empty = F.array().cast("array<double>")
        docs = docs.withColumns({"_tokens": F.size(_words(F.col("text"))).cast("long"), "_posteriors": empty, "_domains": empty.cast("array<string>"), "_rate": F.lit(1.0)})
        return docs.select(*columns, "_tokens", "_domains", "_posteriors", "_rate")
    scored = stage(with_posteriors(docs, model).select(*columns, "_tokens", "_posteriors"), "mixing-scored")
    steps, _, _ = fit_rates(scored.select("_tokens", "_posteriors"), model[0], weights)
    return scored.withColumn("_domains", F.array(*map(F.lit, model[0]))).withColumn("_rate", _rate(steps))


def mixed(docs: DataFrame, domains: DataFrame, weights: dict[str, float], labelled: int = 4_000) -> DataFrame:
    """docs, with its columns, each row as often as its rate says: the whole part for certain, one more by a hash of the row."""
    rated = mixing_rates(docs, domains, weights, labelled)
    draw = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0
    # The rate stands in one place and under no filter, since a filter would be pushed below it with the whole classifier in it.
    copies = F.floor(F.col("_rate") + draw).cast("int")
    return rated.withColumn("_copy", F.explode_outer(F.array_repeat(F.lit(1), copies))).where("_copy is not null").select(*docs.columns)
