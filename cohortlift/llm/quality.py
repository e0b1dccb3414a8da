"""A quality classifier learnt from trusted positives and unlabelled web text.

Documents become shape features: how the characters and words are made up and
how much repeats, never which document or source it is. Each feature is cut at
its quantiles into steps, and a logistic model over the steps minimises the
non-negative unbiased risk of positive-unlabelled learning. The class prior is
estimated without any negative label, from how the best scores of models that
judge rows they have not seen thin out among the unlabelled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.shared import portions, stored, text_of

FIT_ROWS = 40_000     # positives, and unlabelled texts, to fit on: at most so many of each
THRESHOLD = 0.7
# Quantiles at which features are cut: finer at the ends, where junk lies.
STEPS = np.unique(np.round(np.concatenate(
    [np.linspace(0.1, 0.9, 9), np.linspace(0.01, 0.1, 10), np.linspace(0.9, 0.99, 10), [0.003, 0.997]]), 3))
EPOCHS = 1000
ROUNDS = 3            # in which the class prior is estimated anew with a better model
PRIOR_EPOCHS = 300
NAMES = ("upper", "punctuation", "exclaimed", "symbols", "digits", "word_length", "distinct", "repeated",
         "commonest", "same_lines", "log_words", "words_a_line", "sentence_ends", "no_letters", "bars")

_HISTOGRAM = np.zeros((256, 7))
for _k, _set in enumerate((
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b".,;:'\"?-()",
        b"!", b"#$%&*+/<=>@[\\]^_`{}~", b"0123456789", b"|")):
    _HISTOGRAM[list(_set), _k] = 1


def features(text: str) -> list[float]:
    """One value per name in ``NAMES``; an empty text has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _HISTOGRAM
    upper, lower, points, exclaimed, symbols, digits, bars = counts.tolist()
    seen = max(sum(counts.tolist()), 1.0)
    n = len(words)
    lines = [line for line in text.split("\n") if line]
    ended = sum(w[-1] in ".?" for w in words)
    bare = sum(not (w[0].isalpha() or w[-1].isalpha() or w.isalnum()) for w in words)
    each = Counter(words)
    common = max(each.values())
    return [
        upper / max(upper + lower, 1), points / seen, exclaimed / seen, symbols / seen, digits / seen,
        len(data) / n, len(each) / n ** 0.8, sum(map(eq, words, words[1:])) / n, common / n,
        1 - len(set(lines)) / max(len(lines), 1), float(np.log(n)), n / max(len(lines), 1), ended / n, bare / n,
        bars / seen]


def featured(rows: DataFrame, keep: list[str], text_column: str) -> DataFrame:
    """``keep`` columns and ``features`` per row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            found = [features(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.float64()))],
                names=[*keep, "features"])

    source = rows.select(*keep, text_of(text_column).alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(work, ", ".join(f"{c} {types[c]}" for c in keep) + ", features array<double>")


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that teach nothing. A null id is not held out."""
    remainder = F.crc32(F.col(id_column).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


class Model:
    """A logistic model over the quantile steps of the features."""

    def __init__(self, sample: np.ndarray):
        self.cuts = [np.unique(np.quantile(sample[:, k], STEPS)) for k in range(sample.shape[1])]
        self.offsets = np.cumsum([0, *[len(c) + 1 for c in self.cuts]])
        self.weights = np.zeros(self.offsets[-1] + 1)

    def places(self, values: np.ndarray) -> np.ndarray:
        """The step of every feature, as places in the weights."""
        return np.stack([np.searchsorted(c, values[:, k], side="left") + self.offsets[k]
                         for k, c in enumerate(self.cuts)], axis=1)

    def margin(self, places: np.ndarray) -> np.ndarray:
        return self.weights[places].sum(axis=1) + self.weights[-1]

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.places(values)), -30, 30)))

    def _gradient(self, places: np.ndarray, pull: np.ndarray) -> np.ndarray:
        out = np.bincount(places.ravel(), np.repeat(pull, places.shape[1]), minlength=len(self.weights))
        out[-1] = pull.sum()
        return out

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None,
            epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-5) -> None:
        """Minimise the non-negative risk; without a prior, tell positives from unlabelled.

        Where the estimated risk of the negatives falls below zero, its
        gradient is followed upwards, so the model can't gain by fitting the
        unlabelled too closely.
        """
        p, u = self.places(positive), self.places(unlabelled)
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, epochs + 1):
            sp = 1 / (1 + np.exp(-np.clip(self.margin(p), -30, 30)))
            su = 1 / (1 + np.exp(-np.clip(self.margin(u), -30, 30)))
            as_positive = self._gradient(p, (sp - 1) / len(p))
            as_negative = self._gradient(u, su / len(u))
            if prior is None:
                gradient = as_positive + as_negative
            else:
                taken = prior * self._gradient(p, sp / len(p))
                risk = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
                gradient = prior * as_positive + as_negative - taken if risk >= 0 else taken - as_negative
            gradient = gradient + decay * self.weights
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient ** 2
            self.weights -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from a model's margins of both.

    In the region of the best scores there are hardly any negatives, so the
    unlabelled thin out against the positives by just that share. Of all
    regions, the one with the smallest upper bound of the share counts.
    """
    cuts = np.quantile(positive, np.linspace(0.05, 0.9, 86))   # regions with enough positives
    share_p = np.array([(positive >= c).mean() for c in cuts])
    share_u = np.array([(unlabelled >= c).mean() for c in cuts])
    error = np.sqrt(np.log(100) / (2 * len(positive))) + np.sqrt(np.log(100) / (2 * len(unlabelled)))
    best = int(np.argmin((share_u + error) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def cross_estimated_prior(positive: np.ndarray, web: np.ndarray, half_of_web: np.ndarray | None = None,
                          rounds: int = ROUNDS, epochs: int = PRIOR_EPOCHS) -> float:
    """The prior, each half of the rows judged by a model of the other half.

    The first model tells positives from the web; each later one is fitted with
    the prior found so far and so parts the classes better. Rows of ``web``
    that are copies of positives must lie in the positives' halves (even, odd).
    """
    if half_of_web is None:
        half_of_web = np.arange(len(web)) % 2
    prior: float | None = None
    for _ in range(rounds + 1):
        margins: list[list[np.ndarray]] = [[], []]
        for half in (0, 1):
            model = Model(web[half_of_web == half])
            model.fit(positive[half::2], web[half_of_web == half], prior, epochs)
            for out, rows in zip(margins, (positive[1 - half::2], web[half_of_web != half])):
                out.append(model.margin(model.places(rows)))
        prior = estimated_prior(*(np.concatenate(m) for m in margins))
    return prior


def _sampled(rows: DataFrame, most: int) -> np.ndarray:
    """Features of at most ``most`` rows, the same ones whatever the partitioning."""
    chosen = rows.orderBy(F.xxhash64("features", "id"), "id").limit(most).select("features")
    table = chosen.toArrow()["features"].combine_chunks()
    return np.asarray(table.values if hasattr(table, "values") else [], float).reshape(-1, len(NAMES))


def train(rows: DataFrame, labels: DataFrame, most: int = FIT_ROWS, label: str = "quality") -> Model | None:
    """Fit on featured rows (id, features) and labels (doc_id, ``label``).

    Positives are rows labelled 1; all other rows are unlabelled, whatever
    their label says: labels 0 are not read. Held-out rows take no part. Both
    kinds are bounded samples by hash, ``most`` rows each. With fewer than two
    positives or unlabelled rows there is no model.
    """
    open_ = rows.filter(~held_out("id"))
    trusted = labels.filter(F.col(label) == 1).select(F.col("doc_id").alias("id")).distinct()
    positive = _sampled(open_.join(trusted, "id", "left_semi"), most)
    unlabelled = _sampled(open_.join(trusted, "id", "left_anti"), most)
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    # The unlabelled must look like the web: the trusted rows are part of it.
    total = open_.count()
    others = open_.join(trusted, "id", "left_anti").count()
    extra = round(len(unlabelled) * (total - others) / max(others, 1))
    taken = np.resize(np.arange(len(positive)), extra)
    web = np.concatenate([unlabelled, positive[taken]])
    model = Model(web)
    halves = np.concatenate([np.arange(len(unlabelled)), taken]) % 2
    model.prior = cross_estimated_prior(positive, web, halves)
    model.fit(positive, web, model.prior)
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = FIT_ROWS,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row.

    Null and empty texts have all-zero features and get that score. A null id
    is scored like any other and is not held out. Repeated rows get equal
    scores. Where no label is 1, nothing can be learnt and every score is 0.5.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = stored(featured(docs.withColumn("id", F.col(id_column)), ["id"], text_column))
    model = train(rows, labels, most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("features").flatten(), float).reshape(-1, len(NAMES))
            score = model.score(values) if model else np.full(len(values), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32))],
                names=[id_column, "held_out", "score", "predicted"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.withColumn("held_out", held_out("id")).mapInArrow(
        work, f"{id_column} {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """``docs`` without the rows below ``threshold``; rows with a null id stay."""
    bad = stored(scored(docs, labels, threshold, id_column=id_column, text_column=text_column)
                 .filter(F.col(id_column).isNotNull() & (F.col("predicted") == 0)).select(id_column).distinct())
    return docs.join(bad, id_column, "left_anti")
