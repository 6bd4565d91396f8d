"""Soft-membership mixing: domain posteriors from a labelled table, and document rates that meet domain targets."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, ordered_blocks, prefix_totals, text_or_empty

#: A mark is a run of signs that ordinary prose does not use.
MARKS = r"""[^\p{L}\p{N}\s.,;:'"()\-]+"""


def features(text: Column) -> Column:
    """The text's distinct lower-case words and marks."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.concat(words, F.regexp_extract_all(text, F.lit(MARKS), F.lit(0))))


class Classifier:
    """Bernoulli naive Bayes over a bounded vocabulary."""

    def __init__(self, domains: Sequence[str], base: Sequence[float], weights: Mapping[str, Sequence[float]]):
        self.domains, self.base, self.weights = list(domains), list(base), dict(weights)

    def posterior(self, text: Column) -> Column:
        """An array with the probability of each domain, which sum to 1."""
        base = F.array(*[F.lit(float(b)) for b in self.base])
        if self.weights:
            table = F.from_json(F.lit(json.dumps(self.weights)), "map<string,array<double>>")
            vocabulary = F.from_json(F.lit(json.dumps(list(self.weights))), "array<string>")
            hits = F.array_intersect(features(text), vocabulary)
            scores = F.aggregate(hits, base, lambda a, w: F.zip_with(a, table[w], lambda x, y: x + y))
        else:
            scores = base
        odds = let(scores, lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
        return let(odds, lambda o: F.transform(o, lambda x: x / F.aggregate(o, F.lit(0.0), lambda a, y: a + y)))


def train_domains(docs: DataFrame, labels: DataFrame, text: str = "text", most_rows: int = 20_000, vocabulary: int = 512, least: int = 5, lift: float = 4.0) -> Classifier:
    """Fit on at most about most_rows rows of labels (doc_id, domain), drawn by the hash of doc_id.

    The vocabulary holds the features that tell domains apart best by the G statistic, stand in `least` texts, and
    are `lift` times as frequent in one domain as in the others; common words, which only follow a text's length,
    stay out.
    Rows without doc_id, domain or text in docs teach nothing; of repeated labels the least domain counts.
    """
    labels = labels.where("doc_id is not null and domain is not null")
    total = labels.count()
    if total > most_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * most_rows / total)))
    labels = materialize(labels.groupBy("doc_id").agg(F.min("domain").alias("domain")), "labels")
    # labels has most_rows rows at most, give or take the spread of a hash
    rows = docs.where(F.col(text).isNotNull()).select("doc_id", F.col(text).alias("_text")).join(F.broadcast(labels), "doc_id")
    bags = materialize(rows.select("domain", features(F.col("_text")).alias("f")), "bags")
    size = {r["domain"]: r["n"] for r in bags.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(size)
    if not domains:
        return Classifier([], [], {})
    n = sum(size.values())
    counted = bags.select("domain", F.explode("f").alias("f")).where("f <> ''").groupBy("f").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"c{i}") for i, d in enumerate(domains)])
    present = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0))

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = F.lit(0.0)
    for i, d in enumerate(domains):
        g = g + term(F.col(f"c{i}"), F.col("k") * size[d] / n) + term(size[d] - F.col(f"c{i}"), (n - F.col("k")) * size[d] / n)
    rare = F.lit(False)
    for i, d in enumerate(domains):
        rare = rare | (F.col(f"c{i}") / size[d] >= lift * (F.col("k") - F.col(f"c{i}") + 0.5) / (n - size[d] + 1))
    best = counted.withColumn("k", present).where(F.col("k").between(least, n - 1)).where(rare).withColumn("g", g).where("g > 15").orderBy(F.desc("g"), "f").limit(vocabulary).collect()
    base = [math.log(size[d] / n) for d in domains]
    weights = {}
    for r in best:
        p = [(r[f"c{i}"] + 0.5) / (size[d] + 1) for i, d in enumerate(domains)]
        weights[r["f"]] = [math.log(x / (1 - x)) for x in p]
        base = [b + math.log(1 - x) for b, x in zip(base, p)]
    return Classifier(domains, base, weights)


def fit_rates(table: DataFrame, targets: Sequence[float], rounds: int = 20, tolerance: float = 1e-6) -> tuple[Column, list[list[float]], float]:
    """Rates x >= 0 for the rows of table (n: tokens, p: posteriors) with sum of n * p_d * x near targets[d].

    Projected gradient with momentum on the least-squares error, from x = 1. Errors are weighted by the inverse of
    H = sum of n * p p', and a row's step by 1 / n, so that a full step is the best one where no rate meets 0 and
    rows of equal posteriors get equal rates. A round is one aggregation of a few numbers; rates are a fold over
    the rounds' steps, so nothing but those leaves the table. Stops when the error is under tolerance, when
    three rounds in a row lower the objective by less than a thousandth, or after `rounds` of them. Returns the rate
    as a column of p, the steps (momentum, then direction), and the error relative to the targets.
    """
    k = len(targets)
    t = np.array(targets, float)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    h = table.agg(*[F.sum(F.col("n") * p[i] * p[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    H = np.array([[h[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(H, rcond=1e-9, hermitian=True)

    def state(steps: list[list[float]]) -> Column:
        """(x, y): the rate after these steps, and the point ahead of it that the next gradient is taken at."""
        table_ = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
        dot = lambda g, p: F.aggregate(F.zip_with(F.slice(g, 2, k), p, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

        def step(s: Column, g: Column, p: Column) -> Column:
            return let(F.greatest(F.lit(0.0), s["y"] - dot(g, p)), lambda x: F.struct(x.alias("x"), (x + g[0] * (x - s["x"])).alias("y")))

        # p is bound once a row: the optimizer may put the whole classifier in its place
        return let(F.col("p"), lambda p: F.aggregate(table_, F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")), lambda s, g: step(s, g, p)))

    steps: list[list[float]] = []
    best, least, error, momentum, stalled = [], math.inf, math.inf, 1.0, 0
    while True:
        at = table.withColumn("s", state(steps))
        row = at.agg(*[F.sum(F.col("n") * p[i] * F.col(f"s.{c}")).alias(f"{c}{i}") for i in range(k) for c in "xy"]).first()
        rx, ry = (np.array([row[f"{c}{i}"] or 0.0 for i in range(k)]) - t for c in "xy")
        value = float(rx @ inverse @ rx)
        stalled = stalled + 1 if value > least * (1 - 1e-3) else 0
        if value < least:
            best, least, error = list(steps), value, float(np.abs(rx).sum() / max(np.abs(t).sum(), 1.0))
        if stalled >= 3 or error <= tolerance or len(steps) >= rounds:
            return state(best)["x"], best, error
        ahead = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        steps.append([(momentum - 1) / ahead, *(inverse @ ry).tolist()])
        momentum = ahead


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] | Callable[[dict[str, float]], Mapping[str, float]], text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add n_tokens (words), domains (a map from domain to posterior) and rate to docs.

    targets gives the token total wanted of each domain, or is a function that makes it from the totals that the
    corpus has. A domain that it does not name keeps its total. rate says how many copies of the document a
    mixture holds on average; rates sum to the targets as near as nonnegative rates can. How near that is, relative
    to the targets, is the attribute `mixing_error` of the result.

    Each text is classified once: rows with their posteriors are written to the shared folder, with the columns
    `keep` of docs (all by default; leave the text out where it is not needed).

    A null or empty text has no tokens, the prior as posterior and a rate by it. Rows are rated one by one, equal
    texts equally. Without any labelled row no domain is known, `domains` is empty and every rate is 1. Columns
    with the added names are overwritten; all other names may be used.
    """
    classifier = train_domains(docs, labels, text)
    body = text_or_empty(text)
    tokens = F.size(F.filter(F.split(body, SPACE + "+"), lambda w: w != "")).cast("long")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "domains", "rate")]
    names = classifier.domains
    if not names:
        out = docs.select(*kept, tokens.alias("n_tokens"), F.create_map().cast("map<string,double>").alias("domains"), F.lit(1.0).alias("rate"))
        out.mixing_error = 0.0
        return out
    rated = materialize(docs.select(F.struct(*kept).alias("row"), tokens.alias("n"), classifier.posterior(body).alias("p")), "rated")
    # rates depend on posteriors alone, and texts with the same features of the vocabulary share theirs
    table = materialize(rated.groupBy("p").agg(F.sum("n").alias("n")), "posteriors")
    sums = table.agg(*[F.sum(F.col("n") * F.get("p", F.lit(i))).alias(f"t{i}") for i in range(len(names))]).first()
    have = {d: float(sums[f"t{i}"] or 0.0) for i, d in enumerate(names)}
    want = dict(targets(have) if callable(targets) else targets)
    rate, _, error = fit_rates(table, [want.get(d, have[d]) for d in names])
    domains = F.map_from_arrays(F.array(*[F.lit(d) for d in names]), "p")
    out = rated.select("row.*", F.col("n").alias("n_tokens"), domains.alias("domains"), rate.alias("rate"))
    out.mixing_error = error
    return out


def copies(rate: Column, key: Column) -> Column:
    """How many copies of a row a mixture takes: the rate rounded up or down by the row's hash, on average the rate.

    A row needs no other to be rounded, but sums miss by the root of what they add; systematic_copies() does not.
    """
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + draw).cast("int")


def systematic_copies(rated: DataFrame, ties: Sequence[str] = ("doc_id",), unit: int = 1_000_000) -> DataFrame:
    """Rows of mix() with copies, the rate rounded up or down so that sums of copies stay next to sums of rates.

    Rows are brought in order of their likeliest domain, then their tokens. The rates are summed along it, and a row has
    as many copies as whole numbers that its own part of the sum takes it past, half a copy being given at the start. So any
    run of rows has its rates' sum of copies but for one, and as neighbours have equal tokens or nearly, a domain's
    tokens miss the target by no more than about one document. Rates count in steps of 1 / unit. Rows equal in all of
    this and in ties may be told apart in any order; an empty table gives no rows.
    """
    columns = [c for c in rated.columns if c != "copies"]
    likeliest = F.array_position(F.map_values("domains"), F.array_max(F.map_values("domains")))
    order = ["_domain", "_size", *[f"_tie{i}" for i in range(len(ties))]]
    rows = rated.select(F.struct(*columns).alias("row"), F.coalesce(likeliest, F.lit(0)).alias("_domain"), F.col("n_tokens").alias("_size"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)], F.round(F.col("rate") * unit).cast("long").alias("_part"))
    blocks = ordered_blocks(rows, order, "by_domain")
    before = materialize(prefix_totals(blocks.groupBy("_block").agg(F.sum("_part").alias("part")), "_block", ["part"]), "rates_before")
    inside = F.sum("_part").over(Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    end = F.col("_inside") + F.col("before_part") + F.lit(unit // 2)
    whole = lambda x: F.floor(x / F.lit(unit))
    summed = blocks.withColumn("_inside", inside).join(before, "_block")
    out = summed.select("row.*", (whole(end) - whole(end - F.col("_part"))).cast("int").alias("copies"))
    return out


def admitted(rate: Column, least: float = 0.01) -> Column:
    """Whether the fitted mixture holds a row at all, where a document is kept or not: its rate is not nothing.

    The fit sets the rates of documents whose tokens would go to domains that are wanted at nothing to 0, and leaves no
    choice to chance.
    """
    return rate >= least


def kept_whole(domain: str, domains: Column, rate: Column) -> Column:
    """Whether a row of mix() stays, once, where a document is kept or not: if it is of the domain more likely than not.

    Nothing is left to chance. The rate decides only where no domain is known.
    """
    return F.when(F.size(domains) == 0, rate >= 0.5).otherwise(F.coalesce(domains[domain] > 0.5, F.lit(False)))


def quality_domains(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) as domains: toxic, low or clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


#: op10: the mixture's shares of all tokens.
SHARES = {"clean": 0.94, "low": 0.04, "toxic": 0.02}


def op10_soft_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = mix(docs, labels, lambda have: {d: SHARES.get(d, 0.0) * sum(have.values()) for d in have}, keep=["doc_id"])
    error, out = out.mixing_error, systematic_copies(out)
    posterior = [F.round(F.coalesce(F.col("domains")[d], F.lit(0.0)), 9).alias(f"p_{d}") for d in sorted(SHARES)]
    return out.select("doc_id", "n_tokens", *posterior, F.round("rate", 9).alias("rate"), "copies", F.lit(round(error, 9)).alias("mixing_error"))
