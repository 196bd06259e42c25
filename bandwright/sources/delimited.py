"""Delimited text: the two school inputs, and whole folders of datasets."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Mapping, Sequence
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwright.config import Measure
from bandwright.functions import snake_case
from bandwright.functions.names import normalise_headers
from bandwright.operators.observe import tag_measure

# Headers of the two input files, with their types.
GOAL_FILE = T.StructType(
    [
        T.StructField("AcademicYear", T.StringType()),
        T.StructField("Region", T.StringType()),
        T.StructField("School_Name", T.StringType()),
        T.StructField("SchoolType", T.StringType()),
        T.StructField("n_students", T.IntegerType()),
        T.StructField("n_fam_med_movers", T.IntegerType()),
        T.StructField("n_movers", T.IntegerType()),
        T.StructField("n_leavers", T.IntegerType()),
        T.StructField("persistence_rate_all", T.DoubleType()),
        T.StructField("Quartile", T.StringType()),
        T.StructField("growth target", T.StringType()),
        T.StructField("22-23 Persistence Goal", T.DoubleType()),
    ]
)
RESULT_FILE = T.StructType(
    [
        T.StructField("academic_year", T.StringType()),
        T.StructField("campus", T.StringType()),
        T.StructField("grade", T.StringType()),
        T.StructField("grade_level_id", T.IntegerType()),
        T.StructField("results", T.DoubleType()),
    ]
)

# Separator by file extension; None is any run of white space.
SEPARATORS = {
    "csv": ",",
    "csv2": ";",
    "tsv": "\t",
    "tab": "\t",
    "wsv": None,
    "dat": None,
    "txt": None,
}
COMPRESSIONS = ("gz", "bz2")
NULL_TEXT = "NA"


# A quote inside a quoted field is doubled. Empty text is quoted, so it differs
# from a missing one; the text NA means null, quoted or not.
DIALECT = {"header": True, "quote": '"', "escape": '"', "nullValue": NULL_TEXT}


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    separator: str = ",",
    line_breaks: bool = False,
) -> DataFrame:
    """Rows of delimited files with a header; a row that doesn't fit the schema fails.

    ``line_breaks`` allows them inside quoted fields. A file is then read by one
    task, so large tables should be many files; without it, files are split and
    a broken row is an error.
    """
    return (
        spark.read.schema(schema)
        .options(
            **DIALECT, sep=separator, enforceSchema=False, mode="FAILFAST", multiLine=line_breaks
        )
        .csv(path)
    )


def read_goals(spark: SparkSession, path: str) -> DataFrame:
    return school_goals(normalise_headers(read_csv(spark, path, GOAL_FILE)))


def school_goals(raw: DataFrame) -> DataFrame:
    """Goals under their school column names as goals of the results' next period."""
    return raw.select(
        F.col("academic_year").alias("period"),
        "region",
        F.col("school_name").alias("unit"),
        F.col("school_type").alias("unit_type"),
        F.col("n_students").alias("n_total"),
        "n_fam_med_movers",
        "n_movers",
        "n_leavers",
        F.col("persistence_rate_all").alias("base_rate"),
        F.col("quartile").alias("tier"),
        "growth_target",
        F.col("x22_23_persistence_goal").alias("goal"),
    ).withColumn("applies_to", next_period(F.col("period")))


def next_period(period: Column) -> Column:
    """The school year after ``2021-2022``; other texts give null."""
    first, second = (
        F.regexp_extract(period, r"^(\d{4})-(\d{4})$", group).try_cast("int") + 1
        for group in (1, 2)
    )
    return F.concat(first.cast("string"), F.lit("-"), second.cast("string"))


def read_actuals(spark: SparkSession, path: str, measure: Measure) -> DataFrame:
    return school_actuals(normalise_headers(read_csv(spark, path, RESULT_FILE)), measure)


def school_actuals(results: DataFrame, measure: Measure) -> DataFrame:
    """Results under their school column names as actuals of one measure."""
    renamed = results.withColumnsRenamed(
        {
            "academic_year": "period",
            "campus": "unit",
            "grade": "category",
            "grade_level_id": "category_id",
            "results": "result",
        }
    )
    return tag_measure(renamed, measure)


def write_csv(df: DataFrame, path: str, separator: str = ",", compression: str = "none") -> None:
    """As ``read_csv`` reads it; blanks at either end of a text are kept."""
    df.write.options(
        **DIALECT,
        sep=separator,
        compression=compression,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def load_folder(
    spark: SparkSession,
    folder: str,
    schemas: Mapping[str, T.StructType] | None = None,
    infer_types: bool = True,
    ignore: Sequence[str] = (),
    line_breaks: bool = False,
) -> dict[str, DataFrame]:
    """Every delimited dataset in a folder, by its cleaned name.

    A dataset is a file, or a directory of part files, whose name ends in a
    known extension and, optionally, a compression. A schema under the cleaned
    name spares the pass that guesses types. Entries whose name matches a pattern
    in ``ignore`` (as file name patterns) are left out.
    """
    tables = {}
    for name in list_names(spark, folder):
        stem, extension = split_name(name)
        if extension is None or any(fnmatch(name, pattern) for pattern in ignore):
            continue
        [table] = snake_case([stem])
        schema = (schemas or {}).get(table)
        path = posixpath.join(folder, name)
        separator = SEPARATORS[extension]
        if separator is None:
            tables[table] = read_whitespace(spark, path, schema)
        elif schema is not None:
            tables[table] = read_csv(spark, path, schema, separator, line_breaks)
        else:
            tables[table] = spark.read.options(
                **DIALECT,
                sep=separator,
                inferSchema=infer_types,
                mode="FAILFAST",
                multiLine=line_breaks,
            ).csv(path)
    return tables


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Entry names of a folder on any file system Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in system.listStatus(path))


def split_name(name: str) -> tuple[str, str | None]:
    """Stem and known extension; the extension is None for other files."""
    pattern = rf"(.+)\.({'|'.join(SEPARATORS)})(?:\.({'|'.join(COMPRESSIONS)}))?"
    match = re.fullmatch(pattern, name, re.IGNORECASE)
    return (match[1], match[2].lower()) if match else (name, None)


def read_whitespace(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Columns separated by runs of white space; a quoted field may contain some.

    Each line is read as a single CSV field, so that the header of every file
    is dropped by the reader. Without a schema all columns are text.
    """
    lines = spark.read.options(header=True, sep="\u0001", quote="", escape="").csv(path)
    [header] = lines.columns
    names = [strip_quotes(token) for token in re.findall(r"\"[^\"]*\"|'[^']*'|\S+", header)]
    fields = F.regexp_extract_all(
        F.col(f"`{header}`"), F.lit("\"[^\"]*\"|'[^']*'|\\S+"), F.lit(0)
    )
    types = [field.dataType for field in schema] if schema else [T.StringType()] * len(names)
    table = lines.select(fields.alias("fields"))
    return table.select(
        *(
            whitespace_field(F.get("fields", F.lit(place))).cast(kind).alias(name)
            for place, (name, kind) in enumerate(zip(names, types))
        )
    )


def strip_quotes(token: str) -> str:
    return token[1:-1] if token[0] in "\"'" else token


def whitespace_field(token: Column) -> Column:
    return F.nullif(F.regexp_replace(token, r"^[\"']|[\"']$", ""), F.lit(NULL_TEXT))
