"""Toxicity scores by weak supervision.

Method: voters are mined from labelled rows: words (lexicon voters) and word beginnings of 3 to 6
letters (pattern voters) that stand in toxic documents far more often than in others. A voter says toxic
or abstains; one more voter says clean where no other speaks. A generative label model is fitted to the votes by
expectation maximisation: how often each voter speaks on toxic and on clean documents (its accuracy) and
how voters agree beyond that (pairwise correlation given the class); correlated voters share their weight.
A logistic regression over all mined terms is then trained on the model's posterior labels, and scores every
document.

Scale: one pass over the labelled sample for counts, one for votes, one map-only pass over all documents for
scores. The sample is bounded by ``MAX_ROWS`` labelled rows in the order of a hash of their id, and the terms by
``MAX_TERMS``; nothing else is bounded: every document is scored on its whole text.

Defined results: null text counts as empty; an empty text has the score of a document without any term;
labels that are null are not learned from; an id with several labels is toxic if one of them says so; rows that share an
id are scored each; without any toxic label every score is 0; an empty table gives an empty result; other columns are ignored
unless asked for in ``keep``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docutally.llm.common import text_or_empty

#: Labelled rows that are learned from at most, terms that are kept at most, and voters among them.
MAX_ROWS = 20_000
MAX_TERMS = 4_000
MAX_VOTERS = 120
#: Terms are kept that stand so many times as often in toxic documents as in others.
SURE = 25
BEGINNINGS = (3, 4, 5, 6)
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[str]:
    """Words of a text in lower case, and their beginnings, marked by a star."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*[{w[:n] + "*" for w in words if len(w) >= n} for n in BEGINNINGS])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _mined(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Terms that point to toxic documents, strongest first, by the likelihood ratio of their counts."""

    def count(batches):
        toxic, every = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                terms = terms_of(text)
                every.update(terms)
                if label:
                    toxic.update(terms)
        # Terms that are in no toxic document of this task can still be so in another one.
        names = list(every)
        if names:
            yield pa.RecordBatch.from_pydict({"term": names, "hits": [toxic[t] for t in names], "docs": [every[t] for t in names]}, schema=pa.schema([("term", pa.string()), ("hits", pa.int64()), ("docs", pa.int64())]))

    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not positive or positive == n:
        return [], np.zeros((0, 2))
    total = sample.mapInArrow(count, "term string, hits long, docs long").groupBy("term").agg(F.sum("hits").alias("hits"), F.sum("docs").alias("docs"))
    hit_rate, other_rate = (F.col("hits") + 0.5) / (positive + 1), (F.col("docs") - F.col("hits") + 0.5) / (n - positive + 1)
    strong = total.filter((F.col("hits") >= max(5, positive // 200)) & (hit_rate >= SURE * other_rate)).withColumn("gain", F.col("hits") * F.log(hit_rate / other_rate))
    top = strong.orderBy(F.desc("gain"), "term").limit(MAX_TERMS).select("term", hit_rate.alias("hit"), other_rate.alias("other")).collect()
    return [r.term for r in top], np.array([[r.hit, r.other] for r in top]).reshape(-1, 2)


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, accuracy table (rate on toxic, rate on clean) and pair correlations.

    ``votes`` is 0/1 (rows x voters), ``start`` a first guess of the rates. A voter that abstains says
    nothing, so that voters of one language don't count against documents in another. Expectation: posterior by the
    rates, the log-odds of a voter that speaks divided by one plus its correlations (given the class) with
    the others that speak. Maximisation:
    rates and correlations under the posterior.
    """
    rates = start.clip(1e-4, 1 - 1e-4)
    shared = np.ones_like(votes)
    posterior = correlation = None
    for _ in range(rounds):
        on = np.log(rates[:, 0] / rates[:, 1])
        logit = np.log(prior / (1 - prior)) + (votes / shared) @ on
        posterior = 1 / (1 + np.exp(-logit.clip(-30, 30)))
        both = np.stack([posterior, 1 - posterior], axis=1)
        mass = both.sum(axis=0) + 1
        rates = ((votes.T @ both + start * 1) / mass).clip(1e-4, 1 - 1e-4)
        rest = votes - both @ rates.T
        spread = np.sqrt((rest**2).sum(axis=0)) + 1e-9
        correlation = (rest.T @ rest) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        shared = 1 + votes @ np.where(correlation > 0.1, correlation, 0)
    return posterior, rates, correlation


def logistic(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, width: int, steps: int = 600, ridge: float = 1e-5) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on sparse 0/1 features and soft targets."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = -2
    n = len(target)
    for t in range(1, steps + 1):
        score = np.bincount(rows, w[columns], n) + w[-1]
        miss = (1 / (1 + np.exp(-score.clip(-30, 30))) - target) / n
        slope = np.append(np.bincount(columns, miss[rows], width), miss.sum())
        slope[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass(frozen=True)
class Model:
    """Weights of the terms; the sure voters and what any of them adds; the constant."""

    weights: dict[str, float]
    sure: frozenset[str]
    any_sure: float
    constant: float

    def logit(self, text: str) -> float:
        found = terms_of(text)
        total = self.constant + sum(sorted(self.weights[t] for t in found if t in self.weights))
        return total if self.sure.isdisjoint(found) else total + self.any_sure


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The classifier, learned from labelled rows that are not held out."""
    marked = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
    sample = sample.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    names, rates = _mined(sample)
    if not names:
        return Model({}, frozenset(), 0.0, -30.0)
    place = {t: i for i, t in enumerate(names)}

    def hits(batches):
        for batch in batches:
            found = [sorted(place[t] for t in terms_of(text) if t in place) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sample.mapInArrow(hits, f"doc_id {kind}, toxic int, terms array<int>").orderBy("doc_id", "terms").toArrow()
    lists = got.column("terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    columns = lists.flatten().to_numpy()
    voters = min(MAX_VOTERS, len(names))
    votes = np.zeros((len(lists), voters + 1))
    own = columns < voters
    votes[rows[own], columns[own]] = 1
    toxic = got.column("toxic").to_numpy()
    silent = np.zeros(voters, dtype=bool)
    for _ in range(3):
        # A voter that is mostly wrong where it speaks alone only repeats others: it is silenced.
        alone = votes[:, :-1] * (votes[:, :-1].sum(axis=1) == 1)[:, None]
        wrong = (alone.sum(axis=0) >= 3) & (toxic @ alone < 0.5 * alone.sum(axis=0))
        silent |= wrong
        votes[:, :-1][:, wrong] = 0
    votes[:, -1] = votes[:, :-1].sum(axis=1) == 0
    prior = float(np.mean(toxic))
    quiet = np.array([[0.1, 0.9]])  # the clean voter's first guess
    posterior, _, _ = label_model(votes, np.concatenate([rates[:voters], quiet]), prior)
    # One more feature: that any voter has spoken at all.
    sure = np.append(~silent, np.zeros(len(names) - voters, dtype=bool))
    any_sure = np.unique(rows[sure[columns]])
    weights = logistic(np.append(rows, any_sure), np.append(columns, np.full(len(any_sure), len(names))), posterior, len(names) + 1)
    return Model(dict(zip(names, weights.tolist())), frozenset(t for t, s in zip(names, sure) if s), float(weights[-2]), float(weights[-1]))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """Rows (id_col, *keep, score) with a score from 0 to 1 for every row of ``docs``."""
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*keep).alias("_keep") if keep else F.lit(0).alias("_keep"), text_or_empty(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double")

    def score(batches):
        for batch in batches:
            out = [model.logit(text) for text in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_keep"), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))), pa.float64())], names=["_id", "_keep", "score"])

    return rows.mapInArrow(score, schema).select(F.col("_id").alias(id_col), *[F.col("_keep")[c].alias(c) for c in keep], "score")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    prepare(spark)
    found = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
