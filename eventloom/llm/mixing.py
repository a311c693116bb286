"""Mixing to target weights by soft domain membership, DataFrame functions only.

A classifier learnt from the labelled table predicts each document's posterior over domains. Nonnegative
document rates are then fitted by projected gradient so that the expected tokens of each domain, summed over
all documents with their posteriors, match target totals.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, fresh, table

#: Domains told apart by the labelled table, with the label condition that marks each.
DOMAINS = {"toxic": "toxic = 1", "low": "quality = 0", "clean": "true"}

#: Maps over which the classifier's words are dealt.
SHEETS = 64


@dataclass
class Mixture:
    """Posterior model: log scores of a document without telling words, and what the presence of each such word adds."""

    domains: list[str]
    base: list[float]
    ratios: dict[str, list[float]] = field(default_factory=dict)


@dataclass
class Fit:
    """How the descent ended: expected tokens of each domain beside their targets, and whether all of them are met."""

    expected: list[float]
    targets: list[float]
    settled: bool
    gradients: list[list[float]]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE + "+"), "")


def fit_domains(docs: DataFrame, labels: DataFrame, domains: dict[str, str] | None = None, rows: int = 20_000, vocabulary: int = 400) -> Mixture:
    """Naive Bayes over the presence of words, from at most ``rows`` labelled rows chosen by a hash of the id.

    A word is telling where the number of its documents in a domain lies over five standard deviations above, and by a
    factor over e above, what the domain's share of all documents makes likely; each domain names the ``vocabulary``
    furthest ones (words of five documents or fewer cannot lie that far above, so they are not counted further). Every domain judges the words that any of them names, absent ones too: a document without
    them is as unlikely for a domain as the domain's documents have them often.

    An id with several labels counts with the first domain that any of them meets; rows with null labels and
    ids are passed over. The driver receives at most (domains x vocabulary) words. Without labels the posterior is even.
    """
    domains = domains or DOMAINS
    names = list(domains)
    case = None
    for i, condition in enumerate(domains.values()):
        case = F.when(F.expr(condition), i) if case is None else case.when(F.expr(condition), i)
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", case.alias("domain")).where("domain is not null")
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    shares = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    prior = [math.log((shares.get(i, 0) + 1) / (total + len(names))) for i in range(len(names))]
    # at most ``rows`` rows of two numbers: a proven bound, so they may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    seen = sample.select("domain", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    n = [F.sum(F.when(F.col("domain") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(len(names))]
    counts = table(seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *n).where("n > 5"), "word-counts")
    in_sample = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = max(1, sum(in_sample.values()))
    ratios, absent, best = [], [], []
    for i in range(len(names)):
        expected = F.col("n") * in_sample.get(i, 0) / size
        # smoothed by one document at the word's rate in the whole sample
        rate = F.least(F.greatest((F.col(f"n{i}") + F.col("n") / size) / (in_sample.get(i, 0) + 1), F.lit(1e-6)), F.lit(1 - 1e-6))
        ratios.append(F.ln(rate / (1 - rate)).alias(f"w{i}"))
        absent.append(F.ln(1 - rate).alias(f"a{i}"))
        far = (F.col(f"n{i}") - expected) / F.sqrt(expected + 1)
        factor = F.ln((F.col(f"n{i}") + 1) / (expected + 1))
        best.append(counts.select("word", far.alias("z"), factor.alias("f")).where("z > 5 and f > 1").orderBy(F.desc("z"), "word").limit(vocabulary).select("word"))
    telling = reduce(DataFrame.union, best).distinct()
    chosen = counts.select("word", *ratios, *absent).join(F.broadcast(telling), "word").collect()
    base = [math.fsum([prior[i], *(r[f"a{i}"] for r in chosen)]) for i in range(len(names))]
    return Mixture(names, base, {r["word"]: [r[f"w{i}"] for i in range(len(names))] for r in chosen})


def posteriors(docs: DataFrame, model: Mixture) -> DataFrame:
    """(doc_id, n_tokens, p): words of the whole text and the posterior over ``model.domains``."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    known = sorted(model.ratios.items())
    # a map is searched from its start: the words are dealt to short maps by their crc32
    sheets = []
    for i in range(SHEETS if known else 0):
        pairs = [F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in known if zlib.crc32(pair[0].encode()) % SHEETS == i for x in pair]
        sheets.append(F.create_map(*pairs).cast("map<string,array<double>>"))
    if known:
        hits = F.array_intersect(F.col("w"), F.array(*[F.lit(w) for w, _ in known]))
        found = F.transform(hits, lambda x: F.element_at(F.array(*sheets)[(F.crc32(x.cast("binary")) % SHEETS).cast("int")], x))
    else:
        found = F.array().cast("array<array<double>>")

    def evidence(i: int) -> Column:
        return F.aggregate("h", F.lit(model.base[i]), lambda acc, x: acc + x[i])

    logs = rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), found.alias("h")).select("doc_id", "n_tokens", F.array(*map(evidence, range(len(model.domains)))).alias("l"))
    top = logs.withColumn("m", F.array_max("l")).withColumn("l", F.transform("l", lambda x: F.exp(x - F.col("m"))))
    whole = F.aggregate("l", F.lit(0.0), lambda a, x: a + x)
    return top.withColumn("z", whole).select("doc_id", "n_tokens", F.transform("l", lambda x: x / F.col("z")).alias("p"))


def fit_rates(members: DataFrame, targets: list[float], steps: int = 40, eta: float = 0.9) -> tuple[DataFrame, Fit]:
    """``members`` (doc_id, n_tokens, p) plus rate: nonnegative rates whose expected domain tokens approach ``targets``.

    Least squares over nonnegative rates: the sum over domains of (expected - target)^2 / tokens held now, each domain
    weighted by what it holds, by projected gradient from rate 1. The descent is scaled per document by its length, which
    keeps the projection separable; the step is set from a bound of the curvature. A step needs one aggregate of as many
    numbers as there are domains; the driver keeps those, and each document's rate is replayed from them, so no iterate is
    stored and a lost executor costs nothing.

    Each domain is judged by itself, however rare: it is settled within 0.1 % of its target or, where that is 0, when
    it keeps less than a 10^7th of its tokens. The descent ends when all are, or after ``steps``; the fit says which, and
    what is left: documents of uncertain domain can keep the targets apart.
    """
    k = len(targets)
    gradients: list[list[float]] = []

    def rate() -> Column:
        if not gradients:
            return F.lit(1.0)
        moves = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in gradients])
        dot = lambda g: sum((F.col("p")[i] * g[i] for i in range(1, k)), F.col("p")[0] * g[0])
        return F.aggregate(moves, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))

    def expected() -> list[float]:
        got = members.select("p", (F.col("n_tokens") * rate()).alias("x")).agg(*[F.sum(F.col("p")[i] * F.col("x")).alias(f"e{i}") for i in range(k)]).first()
        return [float(x or 0.0) for x in got]

    # curvature of each direction is at most the tokens that it holds
    held = now = expected()
    near = [1e-3 * targets[i] if targets[i] > 0 else 1e-7 * held[i] for i in range(k)]
    # a domain without any tokens cannot be moved
    met = lambda: all(abs(now[i] - targets[i]) <= near[i] for i in range(k) if held[i] > 0)
    while not met() and len(gradients) < steps:
        gradients.append([eta * (now[i] - targets[i]) / held[i] if held[i] > 0 else 0.0 for i in range(k)])
        now = expected()
        if len(gradients) > 5 and all(abs(x) < 1e-9 for x in gradients[-1]):
            break
    return members.withColumn("rate", rate()), Fit(now, targets, met(), gradients)


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domains: dict[str, str] | None = None, band: float = 0.0) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain>..., rate, copies.

    ``weights`` are the target shares of all tokens; by default what is not marked by a label condition gets
    everything. The token budget is what the domains with a target hold now, so a pure document of a wanted
    domain keeps a rate near 1. copies is the rate rounded down or up by a hash of the id, so that the expected
    number of copies is the rate; only with a ``band`` do rates within it of 1 give one copy. Null and empty texts have no tokens,
    the prior as posterior and rate as that implies; rows with a null doc_id are left out.
    """
    domains = domains or DOMAINS
    weights = weights or {list(domains)[-1]: 1.0}
    model = fit_domains(docs, labels, domains)
    members = table(posteriors(docs, model), "posteriors")
    names = model.domains
    held = members.agg(*[F.sum(F.col("p")[i] * F.col("n_tokens")).alias(n) for i, n in enumerate(names)]).first()
    budget = sum(float(held[n] or 0.0) for n in names if weights.get(n, 0) > 0)
    share = sum(weights.values())
    rated, _ = fit_rates(members, [budget * weights.get(n, 0.0) / share for n in names])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.when(F.abs(F.col("rate") - 1) <= band, 1).otherwise(F.floor(F.col("rate") + chance)).cast("int")
    return rated.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{n}") for i, n in enumerate(names)], "rate", copies.alias("copies"))


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domains: dict[str, str] | None = None, band: float = 0.0) -> DataFrame:
    """The rows of ``docs``, each as often as ``copies`` says, with all their columns; rows with a null doc_id are left out."""
    name, times, copy = fresh(docs, "mixed_id"), fresh(docs, "copies"), fresh(docs, "copy")
    rates = mixed(docs, labels, weights, domains, band).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias(times)).withColumnRenamed("doc_id", name)
    taken = docs.join(rates, docs["doc_id"] == rates[name])
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[docs[c] for c in docs.columns])
