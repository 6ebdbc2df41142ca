"""Mixing sources to target weights by soft membership, in DataFrame operations only.

1. A classifier learns the domains of a labelled table from a bounded sample of
   labelled documents (``SAMPLE_ROWS``, by hash of doc_id), copies of a text counting
   once. A word speaks for a domain if most of the documents that hold it are of
   that domain. In the texts of each domain, the number of such words given the
   text's tokens is negative binomial: a mean rate, and how much texts differ from it.
   A share of a domain's texts is silent: they have no such words beyond those of the
   commonest domain.
2. Every document gets its posterior from all its words, as log odds of how many
   speak for each domain among its tokens: three in 20,000 say less than three in 50.
3. Document rates r >= 0 are fitted so that the expected tokens of each domain,
   sum(r * tokens * posterior), match the targets in least squares. Each step is
   one aggregate over all documents (as many sums as domains) and one projected
   gradient update, in the metric that weighs a document by its tokens and scaled
   by the domains' Gram matrix, so few steps are needed.
4. A document is taken ``copies`` times: the whole part of its rate, and once more
   with the chance of the rest. Rates within ``SLACK`` of a whole number count as
   that number, so documents of a domain that is to stay as it is all stay.

Only the sums over domains reach the driver.

Defined cases: null and empty texts have no tokens and keep rate 1, as they weigh
nothing. Rows that repeat a doc_id and text get equal results. Labels with nulls
and repeated labels (beyond the first by domain) teach nothing. Without labels
every posterior is the even prior. Empty tables give no rows. Further columns of
the documents are kept by ``mix``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.batches import keyed, same, written

#: Labelled documents that the classifier learns from, about so many at most.
SAMPLE_ROWS = 20_000
#: Share of a word's documents (and how many) that make it speak; tokens at the overall rate that each domain's rate starts from.
PRECISION, SUPPORT, SMOOTHING = 0.8, 10, 100.0
#: Least and most shape of a domain's rates: the smaller, the more its texts differ.
SHAPES = (0.05, 1000.0)
STEPS, TOLERANCE, SLACK = 20, 1e-6, 0.1
#: Domains as conditions on the labels; the first that holds counts.
DOMAINS = {"toxic": "toxic = 1", "low": "quality = 0", "clean": "quality = 1"}
#: Target tokens of a domain as a share of the expected tokens it has.
TARGETS = {"toxic": 0.0, "low": 0.5, "clean": 1.0}


def word_list() -> Column:
    """The words of a text, lower-cased; marks at their ends go, symbols stay."""
    return F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z0-9#*$%&|<>-􏿿]+")


def _counts(rows: DataFrame, speakers: DataFrame, keep: list[str], n: int) -> DataFrame:
    """``keep``, tokens and ``n<k>``, the words that speak for domain k, of each row's text; ``rows`` has one line per word."""
    # The sample bounds the speakers, so they may be broadcast.
    return rows.join(F.broadcast(speakers), "word", "left").groupBy(*keep).agg(
        F.count_if(F.col("word") != "").alias("tokens"), *[F.count_if(F.col("speaks") == k).alias(f"n{k}") for k in range(n)])


def _law(n: float, t: float, nn: float, nt: float, tt: float, overall: float) -> tuple[float, float]:
    """(shape, tokens) of the gamma law of a domain's rates, by moments of its texts' counts n and tokens t."""
    mean = (n + SMOOTHING * overall) / (t + SMOOTHING)
    spread = nn - 2 * mean * nt + mean * mean * tt - mean * t
    shape = min(max(mean * mean * tt / spread, SHAPES[0]), SHAPES[1]) if spread > 0 else SHAPES[1]
    return shape, shape / mean


def _lgamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0 (Stirling from x + 4)."""
    y = x + 4
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - F.ln(x * (x + 1) * (x + 2) * (x + 3))


def train(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, tuple[list[list[tuple[float, float]]], list[float], int], list[float]]:
    """(speakers, (law of each domain's rate of words for each domain, share of its silent texts, commonest domain), prior): speakers has word and the number of the domain it speaks for."""
    ks = range(len(domains))
    kind = F.coalesce(*[F.when(F.expr(c), F.lit(k)) for k, c in enumerate(domains.values())])
    labels = labels.select("doc_id", kind.alias("domain")).where("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = min(1.0, sample_rows / max(labels.count(), 1))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000))
    # The sample is bounded by ``sample_rows``, so it may be broadcast and only its texts move.
    rows = keyed(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).dropDuplicates(["text_key"])
    per_domain = [F.count_if(F.col("domain") == k).alias(f"c{k}") for k in ks]
    words = written(rows.select("text_key", "domain", F.explode(word_list()).alias("word")), "sample")
    sums = words.groupBy("text_key").agg(F.min("domain").alias("domain")).agg(*per_domain).first()
    total = list(sums)
    prior = [(s + 1.0) / (sum(sums) + len(sums)) for s in sums]
    most = max(ks, key=lambda k: prior[k])
    counts = words.where("word <> ''").groupBy("text_key", "word").agg(F.min("domain").alias("domain")).groupBy("word").agg(*per_domain)
    every = sum((F.col(f"c{k}") for k in ks), F.lit(0))
    # The commonest domain needs no words of its own: it is what is left.
    speaks = F.coalesce(*[F.when(F.col(f"c{k}") >= PRECISION * every, F.lit(k)) for k in ks if k != most], F.lit(None))
    speakers = written(counts.where(every >= SUPPORT).select("word", speaks.alias("speaks")).where("speaks is not null"), "speakers")
    counts = _counts(words, speakers, ["text_key", "domain"], len(domains))
    t, n = F.col("tokens"), [F.col(f"n{k}") for k in ks]
    parts = [x for k in ks for x in (n[k], n[k] * n[k], n[k] * t)]
    speaking = [(F.col("domain") == d) & (n[d] > 0 if d != most else F.lit(True)) for d in ks]
    sums = [F.coalesce(F.sum(F.when(speaking[d], x)), F.lit(0)) for d in ks for x in (t, t * t, F.lit(1), *parts)]
    found = np.array(counts.agg(*sums).first(), float).reshape(len(domains), -1)
    overall = [(found[:, 3 + 3 * k].sum() + 0.5) / (found[:, 0].sum() + 1) for k in ks]
    laws = [[_law(row[3 + 3 * k], row[0], row[4 + 3 * k], row[5 + 3 * k], row[1], overall[k]) for k in ks] for row in found.tolist()]
    silent = [1.0 if d == most else (total[d] - row[2] + 0.5) / (total[d] + 1) for d, row in enumerate(found.tolist())]
    return speakers, (laws, silent, most), prior


def posteriors(docs: DataFrame, speakers: DataFrame, fitted: tuple[list[list[tuple[float, float]]], list[float], int], prior: list[float]) -> DataFrame:
    """doc_id, text_key, tokens and ``p`` (a number per domain), one row per input row."""
    laws, silent, most = fitted
    keep = ["row", "doc_id", "text_key"]
    # The row number is set before words multiply the rows.
    rows = keyed(docs).withColumn("row", F.monotonically_increasing_id()).select(*keep, F.explode(word_list()).alias("word"))
    found = _counts(rows, speakers, keep, len(prior))

    def score(d: int) -> Column:
        out = F.lit(0.0)
        for k, (a, b) in enumerate(laws[d]):
            n = F.col(f"n{k}").cast("double")
            # What does not depend on d is left out.
            out = out + _lgamma(n + a) - (n + a) * F.ln(F.col("tokens") + b) + (a * math.log(b) - math.lgamma(a))
        return out

    ds = range(len(prior))
    scored = found.select("doc_id", "text_key", "tokens", *[score(d).alias(f"s{d}") for d in ds])
    top = F.greatest(*[F.col(f"s{d}") for d in ds])
    scored = scored.select("doc_id", "text_key", "tokens", *[F.exp(F.col(f"s{d}") - top).alias(f"e{d}") for d in ds])
    shares = [prior[d] * (silent[d] * F.col(f"e{most}") + (1 - silent[d]) * F.col(f"e{d}")) for d in ds]
    total = sum(shares[1:], shares[0])
    return scored.select("doc_id", "text_key", "tokens", F.array(*[x / total for x in shares]).alias("p"))


def fit(members: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> Column:
    """The rate of each row of ``members`` (tokens, p), as an expression of p."""
    ks = range(len(targets))
    p = [F.col("p")[k] for k in ks]
    gram = members.agg(*[F.coalesce(F.sum(F.col("tokens") * p[i] * p[j]), F.lit(0.0)) for i in ks for j in ks]).first()
    gram = np.array(gram, float).reshape(len(targets), -1)
    held = gram.sum(axis=1)
    scale = np.linalg.pinv(gram + np.eye(len(targets)) * 1e-9 * max(gram.trace(), 1.0))
    wanted = held * np.array(targets)
    moves: list[np.ndarray] = []

    def rate() -> Column:
        start = F.lit(1.0)
        if not moves:
            return start
        step = lambda r, v: F.greatest(F.lit(0.0), r - sum((v[k] * p[k] for k in ks[1:]), v[0] * p[0]))
        return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves]), start, step)

    have = held
    for _ in range(steps):
        off = have - wanted
        if np.abs(off).max() <= tolerance * max(held.sum(), 1.0):
            break
        moves.append(scale @ off)
        have = np.array(members.withColumn("r", rate()).agg(*[F.sum(F.col("r") * F.col("tokens") * p[k]) for k in ks]).first(), float)
    return F.when(F.col("tokens") > 0, rate()).otherwise(1.0)


def rates(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, text_key, tokens, p_<domain>, rate and copies, one row per input row."""
    docs = docs.select("doc_id", "text")
    members = written(posteriors(docs, *train(docs, labels, domains)), "members")
    found = members.withColumn("rate", fit(members, [targets[d] for d in domains]))
    chance = F.pmod(F.xxhash64("text_key", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = F.abs(F.col("rate") - F.round("rate")) <= SLACK
    copies = F.when(near, F.round("rate")).otherwise(F.floor(F.col("rate") + chance)).cast("int")
    return found.select("doc_id", "text_key", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)], "rate", copies.alias("copies"))


def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, each row as often as its copies say."""
    found = written(rates(docs, labels), "rates").groupBy("doc_id", "text_key").agg(F.first("copies").alias("copies"))
    chosen = found.where("copies > 0").select(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_key"), F.col("copies").alias("mix_copies"))
    rows = keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    rows = rows.join(chosen, same(F.col("doc_id"), F.col("mix_id")) & (F.col("text_key") == F.col("mix_key")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies"))).alias("copy")).select("row.*")
