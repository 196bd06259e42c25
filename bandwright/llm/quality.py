"""Quality rules: a learned decision list over statistics of whole texts.

Sequential covering: grow a conjunction of thresholds by information gain on
two thirds of the labelled rows, prune it on the other third, keep it while it
is precise there, remove what it covers, go on. The list is emitted as one
ordered Spark conditional expression over the statistics.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm import texts as T

WINDOW_WORDS = 8
SYMBOLS = np.isin(T.BYTES, list(b"#*$%&|<>"))
UPPER = (T.BYTES >= 65) & (T.BYTES <= 90)
DIGIT = (T.BYTES >= 48) & (T.BYTES <= 57)

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_upper",
    "n_digits",
    "n_pipes",
    "n_exclamations",
    "n_stops",
)

# Statistics the rules test: numerator and denominator among COUNTS.
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "exclamations_per_word": ("n_exclamations", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
}

# Labelled rows that a list is learned from, at most; the first by hashed id.
SAMPLE_ROWS = 20_000
# Candidate thresholds per statistic and step; conditions per rule; rules.
THRESHOLDS, CONDITIONS, RULES = 64, 4, 16
# Share of bad rows among those a rule covers in the pruning rows, at least,
# and rows it covers there, at least.
PRECISION, SUPPORT = 0.95, 5


def count_batch(column: pa.Array) -> dict[str, np.ndarray]:
    """All counts of each text in a column."""
    texts = T.column_bytes(column)
    data, n = texts.data, len(texts)
    prefixes = T.Prefixes(data)
    spaces = T.SPACE[data]
    words = T.words(texts)
    hashes = prefixes.hash(words.starts, words.ends)
    salt = T.mixed(np.arange(n, dtype=T.U64) + T.U64(1))

    lines = T.lines(texts)
    solid = np.concatenate([[0], np.cumsum(~spaces, dtype=np.int64)])
    spoken = solid[lines.ends] > solid[lines.starts]
    line_text = lines.text[spoken]
    line_keys = prefixes.hash(lines.starts, lines.ends)[spoken] ^ salt[line_text]
    n_spoken = np.bincount(line_text, minlength=n)
    first_lines = np.unique(line_keys, return_index=True)[1]
    word_text = words.text
    first_words = np.unique(hashes ^ salt[word_text], return_index=True)[1]

    windows, starts = T.shingles(hashes, words.offsets, WINDOW_WORDS)
    repeated = starts[_repeated(windows ^ salt[word_text[starts]])]
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, repeated, 1)
    np.add.at(steps, repeated + WINDOW_WORDS, -1)
    covered = np.cumsum(steps[:-1]) > 0

    return {
        "n_words": np.diff(words.offsets),
        "word_chars": texts.count(~spaces & ~T.CONTINUATION[data]),
        "n_symbols": texts.count(SYMBOLS[data]),
        "n_dup_lines": n_spoken - np.bincount(line_text[first_lines], minlength=n),
        "n_repeat_words": T.per_text(covered, words.offsets),
        "n_lines": n_spoken,
        "n_distinct_words": np.bincount(word_text[first_words], minlength=n),
        "n_upper": texts.count(UPPER[data]),
        "n_digits": texts.count(DIGIT[data]),
        "n_pipes": texts.count(data == ord("|")),
        "n_exclamations": texts.count(data == ord("!")),
        "n_stops": texts.count(data == ord(".")),
    }


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Indices of keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return order[twice]


def statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and all counts of every whole text.

    A null text counts as empty: every count is 0. Repeated rows stay repeated;
    further columns of the input are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            counts = count_batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)],
                ["key", *COUNTS],
            )

    schema = f"key {documents.schema[key].dataType.simpleString()}, " + ", ".join(
        f"{c} bigint" for c in COUNTS
    )
    read = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(count, schema).withColumnRenamed("key", key)


def with_ratios(counted: DataFrame) -> DataFrame:
    """The counts and their ratios; 0 where the denominator is 0."""
    return counted.withColumns(
        {
            name: F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))
            for name, (top, bottom) in RATIOS.items()
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``statistic >= threshold`` or, not ``at_least``, ``statistic < threshold``."""

    statistic: str
    at_least: bool
    threshold: float

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        above = values[self.statistic] >= self.threshold
        return above if self.at_least else ~above

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= self.threshold if self.at_least else value < self.threshold


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions are bad."""

    conditions: tuple[Condition, ...]

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        covered = np.ones(len(next(iter(values.values()))), bool)
        for condition in self.conditions:
            covered &= condition.covers(values)
        return covered

    def column(self) -> Column:
        column = F.lit(True)
        for condition in self.conditions:
            column = column & condition.column()
        return column


def subset(values: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {name: column[rows] for name, column in values.items()}


def best_condition(values: dict[str, np.ndarray], bad: np.ndarray) -> Condition | None:
    """The threshold with the largest information gain for the bad rows."""
    p0, n0 = bad.sum(), (~bad).sum()
    if not p0 or not n0:
        return None
    best, best_gain = None, 1e-9
    start = np.log2(p0 / (p0 + n0))
    for name in sorted(values):
        column = values[name]
        levels = np.unique(np.quantile(column, np.linspace(0, 1, THRESHOLDS), method="nearest"))
        order = np.argsort(column, kind="stable")
        below = np.searchsorted(column[order], levels[1:])
        bad_below = np.concatenate([[0], np.cumsum(bad[order])])[below]
        for at_least, p, covered in (
            (True, p0 - bad_below, len(bad) - below),
            (False, bad_below, below),
        ):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / covered) - start), 0.0)
            if len(gain) and gain.max() > best_gain:
                place = int(gain.argmax())
                # The middle of the gap below the level, so that unseen rows near it fall either way.
                previous = column[order][below[place] - 1]
                best_gain = gain.max()
                best = Condition(name, at_least, float((levels[1:][place] + previous) / 2))
    return best


def grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    conditions: list[Condition] = []
    while len(conditions) < CONDITIONS:
        condition = best_condition(values, bad)
        if condition is None:
            break
        conditions.append(condition)
        kept = condition.covers(values)
        values, bad = subset(values, kept), bad[kept]
    return Rule(tuple(conditions))


def worth(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> float:
    covered = rule.covers(values)
    p, n = (covered & bad).sum(), (covered & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last conditions while that doesn't lower the worth on the pruning rows."""
    shorter = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    return max(shorter, key=lambda r: (worth(r, values, bad), -len(r.conditions)))


def learn(values: dict[str, np.ndarray], bad: np.ndarray, ids: np.ndarray) -> list[Rule]:
    """An ordered list of rules for bad rows; empty when there is nothing to learn from."""
    held = np.fromiter((zlib.crc32(str(i).encode()) % 3 == 0 for i in ids), bool, len(ids))
    rules: list[Rule] = []
    while len(rules) < RULES:
        growing, pruning = subset(values, ~held), subset(values, held)
        rule = grow(growing, bad[~held])
        if not rule.conditions:
            break
        rule = prune(rule, pruning, bad[held])
        covered = rule.covers(pruning)
        if covered.sum() < SUPPORT or bad[held][covered].mean() < PRECISION:
            break
        rules.append(rule)
        left = ~rule.covers(values)
        values, bad, held = subset(values, left), bad[left], held[left]
    return rules


def labelled_sample(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids, the first by hashed id.

    Null ids and labels are left out, and so are ids with two different labels.
    """
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .filter(F.col("label") == F.col("other"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select("doc_id", "label")
    )


def learn_rules(
    documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """Rules from a bounded sample of rows with ``quality`` 0 or 1 (0 is bad)."""
    sample = labelled_sample(labels, "quality", rows)
    # At most ``rows`` ids are broadcast, so only their texts are counted.
    chosen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left_semi")
    seen = (
        with_ratios(statistics(chosen))
        .join(F.broadcast(sample), "doc_id")
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .toPandas()
    )
    names = [*COUNTS, *RATIOS]
    values = {name: seen[name].to_numpy(float) for name in names}
    bad = seen["label"].to_numpy() == 0
    return learn(values, bad, seen["doc_id"].to_numpy())


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Whether a row is kept, and the number of the rule that rejects it (null: none)."""
    first = F.lit(None).cast("int")
    for number in reversed(range(len(rules))):
        first = F.when(rules[number].column(), F.lit(number)).otherwise(first)
    return first.isNull(), first


def judged(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every document's statistics, base result and verdict.

    One row per input row. Null and empty texts have no word and fail the base
    rule. Without labels there is no learned rule and the base rule decides.
    """
    rules = learn_rules(documents, labels, rows)
    good, rule = verdict(rules)
    return (
        with_ratios(statistics(documents))
        .withColumn("base_failed", base_failed())
        .withColumns({"rule": rule, "kept": ~F.col("base_failed") & good})
    )
