"""Registered queries: each operator over the whole star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwright.config import GRAINS, MODEL_GOAL_SD, MODEL_KMEANS, MODEL_MEAN_SD
from bandwright.functions import round_half_up
from bandwright.functions.names import normalise_headers
from bandwright.operators.grains import grain_label, stack
from bandwright.operators.medians import exact_median
from bandwright.operators.models import (
    above_goal_summary,
    below_goal_summary,
    goal_sd_thresholds,
    mean_sd_thresholds,
)
from bandwright.operators.observe import (
    actuals_without_goals,
    clean_category,
    goals_without_actuals,
    tag_measure,
)
from bandwright.operators.score import scored_rows
from bandwright.plans import marts, report
from bandwright.registry import star
from bandwright.sources import delimited, rejects, relational
from bandwright.sources.preview import preview_all
from bandwright.sources.workspace import Workspace

MODELS = (MODEL_GOAL_SD, MODEL_MEAN_SD, MODEL_KMEANS)
ONE_MEASURE = star.STAR_MEASURES[0]
PLACES = 6
# The one school year that the relational query asks for.
SOURCE_YEAR = "1997"
PART_FILE = T.StructType(
    [
        T.StructField("key", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("kind", T.StringType()),
    ]
)
PREVIEWED = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey"}


def rounded(df: DataFrame) -> DataFrame:
    """All fractions to six places, so results compare by value."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({name: round_half_up(F.col(f"`{name}`"), PLACES) for name in doubles})


def with_grain(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("grain", grain_label()).drop("grain_id"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(star.star_observations(spark, folder))


def measure_union(spark: SparkSession, folder: str) -> DataFrame:
    cells = star.saved_cells(spark, folder)
    returned, urgent = star.STAR_MEASURES
    return rounded(
        stack(
            [
                tag_measure(star.returned_results(cells), returned),
                tag_measure(star.urgent_results(cells), urgent),
            ]
        )
    )


def coverage_goals_only(spark: SparkSession, folder: str) -> DataFrame:
    cells = star.saved_cells(spark, folder)
    missing = goals_without_actuals(star.goals(spark, folder, cells), star.actuals(cells))
    return rounded(missing.select("period", "region", "unit", "goal"))


def coverage_actuals_only(spark: SparkSession, folder: str) -> DataFrame:
    cells = star.saved_cells(spark, folder)
    return rounded(actuals_without_goals(star.goals(spark, folder, cells), star.actuals(cells)))


def trimmed_category(spark: SparkSession, folder: str) -> DataFrame:
    padded = star.table(spark, folder, "part").select(
        F.concat(F.repeat(F.lit(" "), F.length("p_type") % 3), "p_type", F.lit(" " * 10)).alias(
            "padded"
        )
    )
    return (
        padded.withColumn("category", clean_category(F.col("padded")))
        .groupBy("category")
        .agg(
            F.max(F.length("padded")).alias("padded_length"),
            F.max(F.length("category")).alias("trimmed_length"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


def goal_rule(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(star.goals(spark, folder, star.cell_counts(spark, folder)))


def grain_stats(spark: SparkSession, folder: str) -> DataFrame:
    return with_grain(star.star_run(spark, folder).exact_stats)


def grain_median_located(spark: SparkSession, folder: str) -> DataFrame:
    """The median as it is located, without the other statistics."""
    run = star.star_run(spark, folder)
    return with_grain(exact_median(run.counts, run.workspace.save))


def thresholds_sd(spark: SparkSession, folder: str) -> DataFrame:
    return with_grain(goal_sd_thresholds(star.star_run(spark, folder).stats))


def thresholds_mean_sd(spark: SparkSession, folder: str) -> DataFrame:
    return with_grain(mean_sd_thresholds(star.star_run(spark, folder).stats))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scored_rows(star.star_run(spark, folder).matched(MODEL_GOAL_SD)))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(star.star_run(spark, folder).summary(MODEL_GOAL_SD, "sd"))


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    return star.star_marts(spark, folder)["summaries"]


def labelled_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries(spark, folder))


def model_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rollup = star.star_marts(spark, folder)["rollup"]
    return rollup.orderBy("model", "persistence_type", "grouped_by")


def overview_table(spark: SparkSession, folder: str) -> DataFrame:
    return report.overview(model_rollup(spark, folder))


def slice_summary(spark: SparkSession, folder: str, aggregation: str) -> DataFrame:
    return report.slice_summary(summaries(spark, folder), aggregation, ONE_MEASURE.display)


def slice_reference_rounding(spark: SparkSession, folder: str) -> DataFrame:
    return report.slice_summary(
        summaries(spark, folder), GRAINS[0].display, ONE_MEASURE.display, reference_rounding=True
    )


def percent_display(spark: SparkSession, folder: str) -> DataFrame:
    return report.percent_display(slice_summary(spark, folder, GRAINS[1].display))


def scored_published(spark: SparkSession, folder: str) -> DataFrame:
    return star.star_marts(spark, folder)["scored"]


def slice_scored(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        report.one_slice(scored_published(spark, folder), GRAINS[3].display, ONE_MEASURE.display)
    )


def level_histogram(spark: SparkSession, folder: str) -> DataFrame:
    everything = scored_published(spark, folder)
    one = report.one_slice(everything, GRAINS[2].display, star.STAR_MEASURES[1].display)
    return report.level_histogram(one, star.CATEGORY_PANELS).orderBy("panel", "grade", "level")


def level_histogram_wide(spark: SparkSession, folder: str) -> DataFrame:
    return report.level_histogram_wide(level_histogram(spark, folder))


def choice_lists(spark: SparkSession, folder: str) -> DataFrame:
    return report.choices(
        summaries(spark, folder), ["persistence_type_display", "grouped_by_display"]
    )


def source_join(spark: SparkSession, folder: str) -> DataFrame:
    results, metrics, schools = star.metric_tables(spark, folder, star.cell_counts(spark, folder))
    found = relational.category_results(results, metrics, schools, SOURCE_YEAR)
    return relational.in_report_order(rounded(found))


def model_union(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(marts.published(marts.summaries_mart(star.star_run(spark, folder), MODELS)))


def kmeans_halves(spark: SparkSession, folder: str) -> DataFrame:
    clustered = star.star_run(spark, folder).clustered
    below = below_goal_summary(clustered).withColumn("half", F.lit("below"))
    above = above_goal_summary(clustered).withColumn("half", F.lit("above"))
    return with_grain(below.unionByName(above, allowMissingColumns=True))


def kmeans_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return with_grain(star.star_run(spark, folder).kmeans)


def kmeans_rollup(spark: SparkSession, folder: str) -> DataFrame:
    run = star.star_run(spark, folder)
    rollup = marts.rollup_mart(marts.summaries_mart(run, [MODEL_KMEANS]))
    return marts.published(rollup)


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes and line breaks, written and read back."""
    documents = star.table(spark, folder, "documents")
    path = Workspace(spark).path("documents.csv")
    delimited.write_csv(documents, path)
    return delimited.read_csv(spark, path, documents.schema, line_breaks=True)


def csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose key or size is spoilt, apart from those that can be read."""
    broken = F.col("p_partkey") % 7 == 0
    size = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("size "), "p_size"))
    parts = star.table(spark, folder, "part").select(
        F.when(broken, F.concat(F.lit("no. "), "p_partkey")).otherwise(F.col("p_partkey").cast("string")).alias("key"),
        F.coalesce(size, F.col("p_size").cast("string")).alias("size"),
        F.col("p_type").alias("kind"),
    )
    workspace = Workspace(spark)
    path = workspace.path("parts.csv")
    delimited.write_csv(parts, path)
    rows, unfit = rejects.read_csv_kept(spark, path, PART_FILE, workspace.save)
    kept = rows.select("key", "size", "kind", F.lit(None).cast("string").alias("record"))
    none = (F.lit(None).cast(kind).alias(c) for c, kind in (("key", "int"), ("size", "int"), ("kind", "string")))
    return kept.unionByName(unfit.select(*none, "record"))


def delimited_load(spark: SparkSession, folder: str) -> DataFrame:
    """One table in every separator and compression, loaded back as a folder."""
    suppliers = star.table(spark, folder, "supplier").withColumn(
        "s_name", F.replace("s_name", F.lit("#"), F.lit(" No "))
    )
    workspace = Workspace(spark)
    for name, separator, compression in (
        ("comma.csv", ",", "none"),
        ("semicolon.csv2.gz", ";", "gzip"),
        ("tabbed.tsv.bz2", "\t", "bzip2"),
        ("spaced.wsv", " ", "none"),
    ):
        delimited.write_csv(suppliers, workspace.path(name), separator, compression)
    names = ("comma", "semicolon", "tabbed", "spaced")
    schemas = dict.fromkeys(names, suppliers.schema)
    loaded = delimited.load_folder(spark, workspace.root, schemas)
    return rounded(
        stack([df.withColumn("dataset", F.lit(name)) for name, df in loaded.items()])
    )


def header_normalise(spark: SparkSession, folder: str) -> DataFrame:
    customers = star.table(spark, folder, "customer")
    messy = customers.toDF("CustKey", "Customer Name", "nation#", "22-23 Balance %", "mktSegment")
    return rounded(normalise_headers(messy))


def preview_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The head of several tables, a row per table, place and column."""
    tables = {name: star.table(spark, folder, name) for name in PREVIEWED}
    heads = preview_all(tables, {name: [key] for name, key in PREVIEWED.items()})
    return stack(cells_of_head(name, head) for name, head in heads.items())


def cells_of_head(name: str, head: DataFrame) -> DataFrame:
    def text(field: T.StructField) -> Column:
        exact = F.col(field.name)
        kind = "decimal(18,2)" if isinstance(field.dataType, T.DoubleType) else field.dataType
        return exact.cast(kind).cast("string")

    place = F.row_number().over(Window.orderBy(PREVIEWED[name]))
    columns = F.array(
        *(
            F.struct(F.lit(field.name).alias("column"), text(field).alias("text"))
            for field in head.schema
        )
    )
    placed = head.select(F.lit(name).alias("dataset"), place.alias("place"), columns.alias("shown"))
    return placed.withColumn("c", F.explode("shown")).select("dataset", "place", "c.*")


def scored_union(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows of all models, by their published names."""
    return rounded(marts.published(marts.scored_mart(star.star_run(spark, folder), MODELS)))


def mart_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """The rollup from marts that were written, read back and looked up by name."""
    run = star.star_run(spark, folder)
    built = marts.build_marts(run)
    path = run.workspace.path("marts")
    marts.write_marts(built, path)
    saved = marts.read_marts(spark, path, built)
    saved["rollup"].createOrReplaceTempView("saved_rollup")
    return relational.named_table(spark, "saved_rollup")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    slices = {
        f"slice_summary_{grain_key(grain)}": partial(slice_summary, aggregation=grain.display)
        for grain in GRAINS
    }
    return {
        "observations": observations,
        "measure_union": measure_union,
        "coverage_goals_only": coverage_goals_only,
        "coverage_actuals_only": coverage_actuals_only,
        "trimmed_category": trimmed_category,
        "goal_rule": goal_rule,
        "grain_stats": grain_stats,
        "grain_median_located": grain_median_located,
        "thresholds_sd": thresholds_sd,
        "thresholds_mean_sd": thresholds_mean_sd,
        "scored_rows": scored,
        "band_summary": summary,
        "labelled_summary": labelled_summary,
        "model_rollup": model_rollup,
        "overview_table": overview_table,
        **slices,
        "slice_reference_rounding": slice_reference_rounding,
        "slice_scored": slice_scored,
        "level_histogram": level_histogram,
        "level_histogram_wide": level_histogram_wide,
        "percent_display": percent_display,
        "choice_lists": choice_lists,
        "source_join": source_join,
        "model_union": model_union,
        "kmeans_halves": kmeans_halves,
        "kmeans_thresholds": kmeans_thresholds,
        "kmeans_rollup": kmeans_rollup,
        "csv_roundtrip": csv_roundtrip,
        "csv_rejects": csv_rejects,
        "delimited_load": delimited_load,
        "header_normalise": header_normalise,
        "preview": preview_tables,
        "scored_union": scored_union,
        "mart_reuse": mart_reuse,
    }


def grain_key(grain) -> str:
    return "_".join(k for k in grain.keys if k not in ("period", "measure_type")) or "all"
