"""Marts that are kept, found again, and brought up to date year by year.

A set of marts belongs to the paths of its inputs and to the run's parameters. A stamp
of the input files (names, sizes, times) tells whether anything can have changed; if
not, the saved marts are read and nothing else runs. If so, observations are made
anew and digested per period. Every group lies within one period, so only periods
whose observations changed are computed and written, each change as a version of its
own; files of other periods stay as they are. A state file, written last, says which
version holds which period: readers see either the marts before or those after, and
those who still read an old version are not disturbed until ``vacuum``.

Files are laid out by version, period, aggregation and measure and sorted by region,
unit and category, so a slice lists the directories of its own and skips row groups.
"""

from __future__ import annotations

import hashlib
import json
import math
import posixpath
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwright.config import MODEL_GOAL_SD, PUBLISHED_NAMES
from bandwright.plans import marts
from bandwright.plans.pipeline import RubricRun
from bandwright.sources.workspace import delete, files_below, read_text, write_text

# To be raised when the same inputs would give other marts.
FORMAT = 1
VERSION = "version"
LAYOUT = tuple(PUBLISHED_NAMES[c] for c in ("period", "grain_display", "measure_display"))
WITHIN = ("region", PUBLISHED_NAMES["unit"], PUBLISHED_NAMES["category"])
BY_PERIOD = ("summaries", "scored")
DIGEST_PARTS = 4
# Rows of a mart that one task sorts and writes.
RANGE_ROWS = 250_000


class MartCatalogue:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def refreshed(
        self,
        paths: Sequence[str],
        make_run: Callable[[], RubricRun],
        models: Sequence[str] = (MODEL_GOAL_SD,),
        parameters: Sequence = (),
    ) -> dict[str, DataFrame]:
        """The published marts of the run, as saved if its inputs are unchanged.

        ``paths`` are the files and folders the run reads; ``parameters`` whatever else
        its results depend on. ``make_run`` is called only if an input changed.
        """
        folder = self.folder(paths, models, parameters)
        stamp = digest(sorted(line for path in paths for line in files_below(self.spark, path)))
        state = self.state(folder)
        if state is None or state["stamp"] != stamp:
            state = self.brought_up(folder, stamp, state, make_run(), models)
        return self.read(folder, state)

    def state(self, folder: str) -> dict | None:
        """The last state that was written; None if there is none."""
        names = [line.split("\t")[0] for line in files_below(self.spark, folder, deep=False)]
        states = sorted(n for n in names if posixpath.basename(n).startswith("state-"))
        return json.loads(read_text(self.spark, states[-1])) if states else None

    def brought_up(
        self, folder: str, stamp: str, state: dict | None, run: RubricRun, models: Sequence[str]
    ) -> dict:
        """Write the marts of changed periods, then the state that makes them count."""
        before = state or {"number": 0, "periods": {}, "schemas": {}, "rollup": None}
        now = period_digests(run.observations)
        number = before["number"] + 1
        version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        changed = [p for p, found in now.items() if before["periods"].get(p, [None])[0] != found]
        periods = {p: before["periods"][p] for p in now if p not in changed}
        after = before | {"number": number, "stamp": stamp, "periods": periods}
        if changed or state is None:
            built = marts.build_marts(run.only(changed), models)
            after["schemas"] = {n: marts.published(built[n]).schema.json() for n in built}
        if changed:
            for name in BY_PERIOD:
                write_by_period(marts.published(built[name]), posixpath.join(folder, name), version)
            periods |= {p: [now[p], version] for p in changed}
        if changed or periods.keys() != before["periods"].keys() or state is None:
            after["rollup"] = version
            summaries = self.read_by_period(folder, "summaries", after)
            back = {published: name for name, published in PUBLISHED_NAMES.items()}
            rollup = marts.rollup_mart(summaries.withColumnsRenamed(back))
            marts.published(rollup).write.parquet(posixpath.join(folder, "rollup", version))
        # Names in order of number; two writers of one number are two files, the later by name counts.
        write_text(self.spark, posixpath.join(folder, f"state-{version}.json"), json.dumps(after))
        run.workspace.remove()
        return after

    def read(self, folder: str, state: dict) -> dict[str, DataFrame]:
        found = {name: self.read_by_period(folder, name, state) for name in BY_PERIOD}
        path = posixpath.join(folder, "rollup", state["rollup"])
        found["rollup"] = self.spark.read.schema(schema_of(state, "rollup")).parquet(path)
        return found

    def read_by_period(self, folder: str, name: str, state: dict) -> DataFrame:
        """Periods from the versions that hold them; both are directories, so others aren't listed."""
        schema = schema_of(state, name)
        held: dict[str, list[str]] = {}
        for period, (_, version) in state["periods"].items():
            held.setdefault(version, []).append(period)
        if not held:
            return self.spark.createDataFrame([], schema)
        base = posixpath.join(folder, name)
        rows = (
            self.spark.read.schema(T.StructType([*schema, T.StructField(VERSION, T.StringType())]))
            .option("basePath", base)
            .parquet(*(posixpath.join(base, f"{VERSION}={version}") for version in held))
        )
        return rows.filter(current(held)).select(*schema.names)

    def vacuum(
        self, paths: Sequence[str], models: Sequence[str] = (MODEL_GOAL_SD,), parameters: Sequence = ()
    ) -> None:
        """Delete what the last state does not name; nobody may read it any more."""
        folder = self.folder(paths, models, parameters)
        state = self.state(folder)
        if state is None:
            return
        held = {(version, period) for period, (_, version) in state["periods"].items()}
        marker = posixpath.basename(folder) + "/"
        for line in files_below(self.spark, folder):
            path = line.split("\t")[0]
            name, *below = path.split(marker, 1)[1].split("/")
            if name in BY_PERIOD and len(below) > 2:
                version, period = (unquote(part.split("=", 1)[1]) for part in below[:2])
                gone = (version, period) not in held
            else:
                gone = name == "rollup" and below[0] != state["rollup"]
            if gone:
                delete(self.spark, path)

    def folder(self, paths: Sequence[str], models: Sequence[str], parameters: Sequence) -> str:
        return posixpath.join(self.root, digest([FORMAT, sorted(paths), models, parameters]))


def schema_of(state: dict, name: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(state["schemas"][name]))


def current(held: dict[str, Iterable[str]]) -> Column:
    period = F.col(LAYOUT[0])
    one_of = ((F.col(VERSION) == v) & period.isin(sorted(periods)) for v, periods in held.items())
    return reduce(Column.__or__, one_of)


def digest(what) -> str:
    return hashlib.sha256(json.dumps(what, default=repr).encode()).hexdigest()


def period_digests(observations: DataFrame) -> dict[str, str]:
    """A digest of every period's observations, whatever their order: one row per period.

    Sums of the parts of every row's SHA-256, and the number of rows.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(observations.columns))), 256)
    parts = [
        F.sum(F.conv(F.substring("row", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
        for k in range(DIGEST_PARTS)
    ]
    found = (
        observations.filter(F.col("period").isNotNull())
        .select("period", row.alias("row"))
        .groupBy("period")
        .agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *parts).alias("digest"))
    )
    return {str(r["period"]): r["digest"] for r in found.collect()}


def write_by_period(mart: DataFrame, path: str, version: str) -> None:
    """One version, laid out by LAYOUT; a range of rows is one task's, so no slice is one task.

    Ranges hold as many rows however many there are, as a task sorts its rows.
    """
    order = [*LAYOUT, *(c for c in WITHIN if c in mart.columns)]
    ranges = max(mart.sparkSession.sparkContext.defaultParallelism, math.ceil(mart.count() / RANGE_ROWS))
    (
        mart.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .write.partitionBy(*LAYOUT)
        .parquet(posixpath.join(path, f"{VERSION}={version}"))
    )

