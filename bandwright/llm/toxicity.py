"""Toxicity by weak supervision.

1. Voters. Marks are words, word beginnings and pairs of neighbouring words, mined from
   a bounded sample of labelled rows, where equal texts count once. Each kind of mark
   makes a lexicon for each band of odds, and each lexicon is a voter. Pattern voters
   look at how many marks a text has, how dense and varied they are, and at its capitals
   and exclamation marks. The given labels are one more voter.
2. Label model. A generative model of the voters, fitted by expectation maximisation
   from the given labels on: a class share and, for each voter, how often it votes each
   way in either class. Correlation that is left between
   voters within a class lowers their weight, so that voters that repeat each other
   count once. Accuracies and correlations stay with the model; ``voters`` reports them.
3. Classifier. A linear model on the marks a text holds, trained on the label
   model's posterior labels, scores every text.

How rare and how telling a mark may be is chosen by cross-validation within the folds
that are learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bandwright.llm import texts as T
from bandwright.llm.quality import labelled_sample

# Labelled rows to learn from, at most.
SAMPLE_ROWS = 12_000
# Marks in the linear model, at most.
MARKS = 65_536
# Choices of a mark's least odds of a toxic text over the sample's, and of the fewest
# toxic texts that hold it; the strictest comes last.
LEAST_ODDS, SUPPORTS = (10.0, 50.0), (2, 5)
# A clean text taken for a toxic one counts as so many toxic ones missed, by shares.
FALSE_ALARM = 10
# Word beginnings, in bytes, that may be marks besides whole words.
BEGINNINGS = (4, 5, 6)
KINDS = ("words", *(f"beginnings of {size}" for size in BEGINNINGS), "pairs")
BANDS = ("weak", "middle", "strong")
PATTERNS = ("several marks", "dense marks", "varied marks", "hardly any marks", "capitals", "exclamations")
PENALTY = 0.05
FOLDS = 5

CLEAN, ABSTAIN, TOXIC = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented capitals that UTF-8 starts with C3."""
    data = T.LOWER[data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    return data + np.where(capital, 32, 0).astype(np.uint8)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash and kind of every word, word beginning and pair of words."""
    texts = T.column_bytes(column)
    data = folded(texts.data)
    found = T.runs(texts, T.LETTER[data])
    prefixes = T.Prefixes(data)
    where, lengths = found.text, found.ends - found.starts
    words = prefixes.hash(found.starts, found.ends)
    text, hashes = [where], [words]
    for size in BEGINNINGS:
        long = lengths > size
        starts = found.starts[long]
        text.append(where[long])
        hashes.append(T.mixed(prefixes.hash(starts, starts + size) + T.U64(size)))
    beside = where[1:] == where[:-1]
    text.append(where[:-1][beside])
    hashes.append(T.mixed(words[:-1] * T.U64(3) + words[1:])[beside])
    kinds = np.repeat(np.arange(len(KINDS), dtype=np.int8), [len(h) for h in hashes])
    return np.concatenate(text), np.concatenate(hashes), kinds


@dataclass
class Model:
    """Marks by hash, their weights, and the constant; both arrays in hash order."""

    marks: np.ndarray
    weights: np.ndarray
    constant: float
    # Of each voter its name, estimated accuracy, share of texts it votes on, and
    # correlations with all voters within a class.
    names: tuple[str, ...] = ()
    accuracy: np.ndarray | None = None
    coverage: np.ndarray | None = None
    correlation: np.ndarray | None = None
    # Least odds and fewest toxic texts of a mark, as chosen.
    chosen: tuple[float, int] | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        text, hashes, _ = features(column)
        place, known = lookup(self.marks, hashes)
        held = np.unique(text[known] * np.int64(len(self.marks) + 1) + place[known])
        total = np.full(len(column), self.constant)
        np.add.at(total, held // (len(self.marks) + 1), self.weights[held % (len(self.marks) + 1)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def lookup(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    place = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return place, table[place] == hashes


def once_per_text(sample: DataFrame) -> DataFrame:
    """``doc_id, text, label, fold``: equal texts are one row, toxic if any of them is."""
    return (
        sample.groupBy("text")
        .agg(F.min("doc_id").alias("doc_id"), F.max("label").cast("int").alias("label"))
        .withColumn("fold", (F.crc32(F.col("doc_id").cast("string")) % FOLDS).cast("int"))
    )


def mined_marks(sample: DataFrame, sizes: np.ndarray) -> pd.DataFrame:
    """``mark, kind, counts``: toxic texts by fold, then clean ones, of likely marks.

    Counts are added up within a batch before they are shuffled; the driver gets
    at most MARKS rows, those with the largest odds. ``sizes`` are texts by label and fold.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            text, hashes, kinds = features(batch.column("text"))
            toxic = batch.column("label").to_numpy(zero_copy_only=False) == 1
            cell = batch.column("fold").to_numpy() + np.where(toxic, 0, FOLDS)
            order = np.lexsort((text, hashes))
            text, hashes, kinds = text[order], hashes[order], kinds[order]
            new = np.ones(len(text), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            text, hashes, kinds = text[new], hashes[new], kinds[new]
            token, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            pairs, n = np.unique(which * (2 * FOLDS) + cell[text], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(T.signed(token)[pairs // (2 * FOLDS)]),
                    pa.array(kinds[first][pairs // (2 * FOLDS)].astype(np.int32)),
                    pa.array((pairs % (2 * FOLDS)).astype(np.int32)),
                    pa.array(n.astype(np.int64)),
                ],
                ["mark", "kind", "cell", "n"],
            )

    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)) for c in range(2 * FOLDS)]
    toxic, clean = (
        F.aggregate(F.slice("counts", first, FOLDS), F.lit(0).cast("long"), lambda a, x: a + x)
        for first in (1, FOLDS + 1)
    )
    # A mark that passes without one fold should not fail with it.
    least = min(LEAST_ODDS) / 2
    return (
        sample.mapInArrow(count, "mark bigint, kind int, cell int, n bigint")
        .groupBy("mark")
        .agg(F.min("kind").alias("kind"), F.array(*cells).alias("counts"))
        .withColumn("odds", odds(toxic, clean, *(int(n) for n in sizes.sum(axis=1))))
        .filter((toxic >= min(SUPPORTS)) & (F.col("odds") >= least))
        .orderBy(F.desc("odds"), "mark")
        .limit(MARKS)
        .drop("odds")
        .toPandas()
    )


def odds(toxic, clean, n_toxic, n_clean):
    return ((toxic + 0.25) / (n_toxic + 1)) / ((clean + 0.25) / (n_clean + 1))


@dataclass
class Seen:
    """The bounded sample: texts' numbers, and which marks they hold how often."""

    texts: pd.DataFrame
    row: np.ndarray
    mark: np.ndarray
    count: np.ndarray

    def of(self, texts: np.ndarray, marks: np.ndarray) -> Seen:
        """Of flagged texts and flagged marks, both numbered anew."""
        kept = texts[self.row] & marks[self.mark]
        row, mark = np.cumsum(texts) - 1, np.cumsum(marks) - 1
        return Seen(
            self.texts[texts], row[self.row[kept]], mark[self.mark[kept]], self.count[kept]
        )


def held_marks(sample: DataFrame, marks: np.ndarray) -> Seen:
    """What the label model and the classifier look at, of each text in the sample."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            n = batch.num_rows
            text, hashes, kinds = features(batch.column("text"))
            place, known = lookup(marks, hashes)
            pairs, often = np.unique(
                text[known] * np.int64(len(marks)) + place[known], return_counts=True
            )
            bounds = pa.array(np.searchsorted(pairs // len(marks), np.arange(n + 1)), pa.int32())
            texts = T.column_bytes(batch.column("text"))
            data = texts.data
            counted = (
                np.bincount(text[kinds == 0], minlength=n),
                texts.count((data >= 65) & (data <= 90)),
                texts.count((data >= 97) & (data <= 122)),
                texts.count(data == 33),
            )
            lists = (pairs % len(marks), often.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "label", "fold")),
                    *(pa.array(np.asarray(c, np.int64)) for c in counted),
                    *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in lists),
                ],
                ["doc_id", "label", "fold", *NUMBERS, "marks", "often"],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{name} bigint" for name in NUMBERS)
    schema = f"doc_id {kind}, label int, fold int, {numbers}, marks array<bigint>, often array<bigint>"
    found = (
        sample.select("doc_id", "text", "label", "fold")
        .mapInArrow(find, schema)
        .toPandas()
        .sort_values("doc_id", ignore_index=True, kind="stable")
    )
    sizes = found["marks"].map(len).to_numpy(np.int64)
    joined = [
        np.concatenate([np.asarray(x, np.int64) for x in found[c]] or [np.zeros(0, np.int64)])
        for c in ("marks", "often")
    ]
    return Seen(found.drop(columns=["marks", "often"]), np.repeat(np.arange(len(found)), sizes), *joined)


NUMBERS = ("n_words", "capitals", "small", "exclamations")


def lexicons(kind: np.ndarray, odds_of: np.ndarray) -> np.ndarray:
    """Of each mark the lexicon it is in: its kind and, within that, its third by odds."""
    order = np.lexsort((odds_of, kind))
    sizes = np.bincount(kind, minlength=len(KINDS))
    rank = np.empty(len(kind), np.int64)
    rank[order] = np.arange(len(kind)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return kind * len(BANDS) + rank * len(BANDS) // np.maximum(sizes[kind], 1)


def voter_names() -> tuple[str, ...]:
    named = (f"{band} {kind}" for kind in KINDS for band in BANDS)
    return (*named, *PATTERNS, "given labels")


def votes(seen: Seen, lexicon: np.ndarray) -> np.ndarray:
    """Texts by voters. A lexicon votes toxic or abstains; a pattern can vote clean."""
    texts, n = seen.texts, len(seen.texts)
    cast = np.full((n, len(KINDS) * len(BANDS)), ABSTAIN, np.int8)
    cast[seen.row, lexicon[seen.mark]] = TOXIC
    hits = np.bincount(seen.row, seen.count, n)
    varied = np.bincount(seen.row, minlength=n)
    n_words, capitals, small, exclamations = (texts[c].to_numpy() for c in NUMBERS)

    def pattern(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        return np.where(toxic, TOXIC, np.where(clean, CLEAN, ABSTAIN)).astype(np.int8)

    none = np.zeros(n, bool)
    patterns = (
        pattern(hits >= 3, hits == 0),
        pattern((hits * 100 >= n_words) & (n_words > 0), hits == 0),
        pattern(varied >= 3, varied <= 1),
        pattern(none, hits * 1000 < n_words),
        pattern((capitals >= 20) & (capitals > small), none),
        pattern((exclamations >= 3) & (exclamations * 20 >= n_words), none),
    )
    return np.column_stack([cast, *patterns])


def fit_label_model(
    cast: np.ndarray, labels: np.ndarray, rounds: int = 25
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class; accuracy of each voter and of the labels; correlations.

    The labels start the posterior and are one more voter, known to err rarely: voters
    mined from them can't tell their errors, and left to themselves call the texts toxic
    that hold a mark by chance.
    """
    one_hot = np.stack([cast == vote for vote in (CLEAN, ABSTAIN, TOXIC)], axis=2).astype(float)
    posterior = np.where(labels == 1, 0.95, 0.05)
    trust = np.ones(cast.shape[1])
    correlation = np.zeros((cast.shape[1],) * 2)
    label_odds = np.where(labels == 1, 1.0, -1.0) * np.log(0.95 / 0.05)
    for _ in range(rounds):
        share = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        rates = []
        for weight in (1 - posterior, posterior):
            counted = np.einsum("n,nvk->vk", weight, one_hot) + 0.5
            rates.append(counted / counted.sum(axis=1, keepdims=True))
        log_odds = np.log(rates[1]) - np.log(rates[0])
        # A lexicon that has none of a text's words says nothing of them.
        log_odds[:, ABSTAIN] = 0
        # What is left of the voters' correlation once the class is known.
        signed = cast - 1.0
        means = [(r[:, 2] - r[:, 0]) for r in rates]
        expected = np.outer(posterior, means[1]) + np.outer(1 - posterior, means[0])
        left = signed - expected
        spread = np.sqrt((left**2).mean(axis=0)) + 1e-6
        correlation = (left.T @ left) / len(cast) / np.outer(spread, spread)
        trust = 1 / (1 + np.clip(correlation, 0, 1).sum(axis=1) - np.clip(np.diag(correlation), 0, 1))
        total = np.einsum("nvk,vk->n", one_hot, log_odds * trust[:, None])
        odds = np.clip(total + label_odds + np.log(share / (1 - share)), -30, 30)
        posterior = 1 / (1 + np.exp(-odds))
    share = posterior.mean()
    accuracy = share * rates[1][:, TOXIC] + (1 - share) * (1 - rates[0][:, TOXIC])
    agreed = np.where(labels == 1, posterior, 1 - posterior).mean()
    return posterior, np.append(accuracy, agreed), correlation


def fit_linear(
    seen: Seen, posterior: np.ndarray, n_marks: int, rounds: int = 1000
) -> tuple[np.ndarray, float]:
    """Logistic regression on which marks a text holds, by accelerated gradients."""
    n, rows, flat = len(seen.texts), seen.row, seen.mark
    sizes = np.bincount(rows, minlength=n)
    ahead = weights = np.zeros(n_marks + 1)
    # In each weight the loss bends by a quarter of its texts' numbers of terms at most, so
    # rare marks take longer steps.
    terms = 1.0 + sizes
    step = 1 / (np.append(np.bincount(flat, terms[rows], n_marks), terms.sum()) / 4 + PENALTY)
    for turn in range(rounds):
        score = np.bincount(rows, ahead[flat], n) + ahead[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - posterior
        slope = np.append(np.bincount(flat, error[rows], n_marks), error.sum())
        slope[:-1] += PENALTY * ahead[:-1]
        moved = ahead - step * slope
        ahead = moved + turn / (turn + 3) * (moved - weights)
        weights = moved
    return weights[:-1], float(weights[-1])


def learned(
    seen: Seen, mined: pd.DataFrame, sizes: np.ndarray, folds: np.ndarray, chosen: tuple[float, int], rounds: int
) -> tuple[np.ndarray, np.ndarray, float, tuple[np.ndarray, ...]]:
    """Which marks pass, their weights, the constant, and what the label model found."""
    counts = np.stack(mined["counts"].to_numpy()).reshape(-1, 2, FOLDS)[:, :, folds].sum(axis=2)
    of_mark = odds(counts[:, 0], counts[:, 1], *sizes[:, folds].sum(axis=1))
    passed = (of_mark >= chosen[0]) & (counts[:, 0] >= chosen[1])
    part = seen.of(np.isin(seen.texts["fold"].to_numpy(), folds), passed)
    cast = votes(part, lexicons(mined["kind"].to_numpy(np.int64)[passed], of_mark[passed]))
    labels = part.texts["label"].to_numpy()
    posterior, accuracy, correlation = fit_label_model(cast, labels)
    weights, constant = fit_linear(part, posterior, int(passed.sum()), rounds)
    coverage = np.append((cast != ABSTAIN).mean(axis=0), 1.0)
    return passed, weights, constant, (accuracy, coverage, correlation)


def validated(seen: Seen, mined: pd.DataFrame, sizes: np.ndarray) -> tuple[float, int]:
    """The choice of least odds and support with the fewest errors on folds left out in turn."""
    inside = np.flatnonzero(sizes.sum(axis=0) > 0)
    fold, toxic = seen.texts["fold"].to_numpy(), seen.texts["label"].to_numpy() == 1
    best = None
    for chosen in ((o, n) for o in LEAST_ODDS for n in SUPPORTS):
        missed = false = 0
        for left in inside if len(inside) > 1 else ():
            passed, weights, constant, _ = learned(
                seen, mined, sizes, inside[inside != left], chosen, rounds=150
            )
            part = seen.of(fold == left, passed)
            score = np.bincount(part.row, weights[part.mark], len(part.texts)) + constant
            missed += ((score < 0) & toxic[fold == left]).sum()
            false += ((score >= 0) & ~toxic[fold == left]).sum()
        cost = missed / max(toxic.sum(), 1) + FALSE_ALARM * false / max((~toxic).sum(), 1)
        if best is None or cost <= best[0]:
            best = (cost, chosen)
    return best[1]


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    usable = labels.filter(~held_out(F.col("doc_id")))
    ids = labelled_sample(usable, "toxic", rows)
    sample = once_per_text(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))
    sizes = np.zeros((2, FOLDS), np.int64)
    for row in sample.groupBy("label", "fold").count().collect():
        sizes[0 if row["label"] == 1 else 1, row["fold"]] = row["count"]
    mined = mined_marks(sample, sizes)
    if not len(mined):
        return Model(np.zeros(0, T.U64), np.zeros(0), -30.0)
    mined["mark"] = mined["mark"].to_numpy(np.int64).view(T.U64)
    mined = mined.sort_values("mark", ignore_index=True)
    marks = mined["mark"].to_numpy()
    seen = held_marks(sample, marks)
    chosen = validated(seen, mined, sizes)
    passed, weights, constant, found = learned(
        seen, mined, sizes, np.flatnonzero(sizes.sum(axis=0) > 0), chosen, rounds=1000
    )
    return Model(marks[passed], weights, constant, voter_names(), *found, chosen)


def voters(spark: SparkSession, model: Model) -> DataFrame:
    """``voter, accuracy, coverage, like, correlation``: each voter, and the one it repeats most.

    Accuracy is over all texts, those without a vote included; the given labels are the
    last voter, which repeats none. A model without marks
    has no voters.
    """
    rows = []
    for k, name in enumerate(model.names):
        numbers = float(model.accuracy[k]), float(model.coverage[k])
        if k < len(model.correlation):
            others = np.delete(np.arange(len(model.correlation)), k)
            like = others[np.argmax(model.correlation[k, others])]
            rows.append((name, *numbers, model.names[like], float(model.correlation[k, like])))
        else:
            rows.append((name, *numbers, None, None))
    return spark.createDataFrame(
        rows, "voter string, accuracy double, coverage double, like string, correlation double"
    )


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """Every document with ``held_out``, ``score`` and ``predicted``, one row per input row.

    Columns of these names in the input are replaced.

    A null or empty text gets the score of a text without marks. A null id is
    not held out. Without usable labels every score is near 0.
    """
    kept = [c for c in documents.columns if c not in ("score", "predicted", "held_out")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            arrays = [*batch.columns, pa.array(model.score(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "score"])

    rows = documents.select(*kept)
    return (
        rows.mapInArrow(score, StructType([*rows.schema, StructField("score", DoubleType())]))
        .withColumn("held_out", held_out(F.col("doc_id")))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
