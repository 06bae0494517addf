"""Readers for folders of labelled series files. All files of a folder are read in one job."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.operators.joining import join_small
from strandlab.operators.ordering import number_rows
from strandlab.operators.prep import DATASET, LABEL, PART, SERIES, SERIES_ID

# File name patterns of the archive.
FILE_PATTERNS = {"train": "{dataset_name}_TRAIN.arff", "test": "{dataset_name}_TEST.arff"}


def _lines(spark: SparkSession, paths: str | Sequence[str], pattern: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths if isinstance(paths, str) else list(paths)).select(
        F.trim("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_order"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Row number in the file, from 0. A split of the file is one bucket, so no file is ordered in one task."""
    numbered = number_rows(rows, ["file"], ["_order"], F.col("_start"), "_row")
    return numbered.withColumn(SERIES_ID, F.col("_row") - 1).drop("_row", "_start", "_order")


def _fields(quotes: str = '"') -> Column:
    """Fields of a line; a comma inside quotes separates nothing. Lines without quotes take the plain split."""
    ahead = "".join(f"(?=(?:[^{q}]*{q}[^{q}]*{q})*[^{q}]*$)" for q in quotes)
    return F.when(F.col("line").rlike(f"[{quotes}]"), F.split("line", r"\s*,\s*" + ahead, -1)).otherwise(F.split("line", r"\s*,\s*", -1))


def _plain(c: Column) -> Column:
    """A field without the quotes around it; a doubled quote inside stands for one."""
    quoted = c.rlike('^".*"$')
    return F.when(quoted, F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)


def _of_width(fields: Column, width: Column) -> Column:
    """``fields`` if there are ``width`` of them; a line with more or fewer is an error that names its file."""
    message = F.concat(
        F.lit("a line of "), F.size(fields).cast("string"), F.lit(" fields, not "), width.cast("string"), F.lit(", in "), F.col("file")
    )
    return F.when(F.size(fields) == width, fields).otherwise(F.raise_error(message).cast("array<string>"))


def read_arff(
    spark: SparkSession, paths: str | Sequence[str], target: str = "target", pattern: str | None = None
) -> DataFrame:
    """Labelled series of ARFF files: ``dataset_name, file, series_id, series, label``.

    The header of every file gives the attribute names and types. A nominal
    target becomes the integer its text spells, numeric attributes become
    doubles, ``?`` becomes null. The data set name is the relation name.
    A line with more or fewer fields than attributes is an error.
    """
    lines = _lines(spark, paths, pattern).where((F.col("line") != "") & ~F.col("line").startswith("%"))
    lowered = F.lower(F.col("line"))
    attribute = r"(?i)^@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)$"
    unquoted = lambda c: F.regexp_replace(c, r"^['\"]|['\"]$", "")
    named = F.struct(
        "_start",
        "_order",
        unquoted(F.regexp_extract("line", attribute, 1)).alias("name"),
        F.when(F.regexp_extract("line", attribute, 2).startswith("{"), "nominal").otherwise("numeric").alias("type"),
    )
    # one row per file, as long as one series
    headers = lines.where(F.col("line").startswith("@")).groupBy("file").agg(
        F.sort_array(F.collect_list(F.when(lowered.startswith("@attribute"), named))).alias("attributes"),
        F.max(
            F.when(lowered.startswith("@relation"), unquoted(F.trim(F.regexp_replace("line", r"(?i)^@relation\s+", ""))))
        ).alias(DATASET),
    )
    data = _numbered(lines.where(~F.col("line").startswith("@")))
    rows = join_small(data, headers, "file", numbers=F.size("attributes") * 3).withColumn(
        "_fields", _of_width(_fields("\"'"), F.size("attributes"))
    )
    picked = F.zip_with(
        "_fields",
        "attributes",
        lambda v, a: F.struct(
            a["name"].alias("name"), a["type"].alias("type"), F.nullif(unquoted(F.trim(v)), F.lit("?")).alias("value")
        ),
    )
    rows = rows.withColumn("_cells", picked)
    numbers = F.transform(F.filter("_cells", lambda c: c["name"] != target), lambda c: c["value"].cast("double"))
    label = F.element_at(F.filter("_cells", lambda c: c["name"] == target), 1)["value"].cast("bigint")
    return rows.select(DATASET, "file", SERIES_ID, numbers.alias(SERIES), label.alias(LABEL))


def arff_types(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Attribute names and types of every file: ``file, name, type``."""
    lines = _lines(spark, paths, pattern).where(F.lower("line").startswith("@attribute"))
    attribute = r"(?i)^@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)$"
    return lines.select(
        "file",
        F.regexp_replace(F.regexp_extract("line", attribute, 1), r"^['\"]|['\"]$", "").alias("name"),
        F.when(F.regexp_extract("line", attribute, 2).startswith("{"), "nominal").otherwise("numeric").alias("type"),
    )


def read_wide_csv(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Wide CSV files of any widths to ``file, series_id, series, label``.

    The header of each file names its columns; columns starting ``Unnamed``
    are left out, an empty field is null. Without a header the label is last.
    Fields may stand in quotes. A line with more or fewer fields than the
    header, or than the longest line of a file without one, is an error.
    """
    lines = _lines(spark, paths, pattern).where(F.col("line") != "").withColumn("_fields", F.transform(_fields(), _plain))
    is_header = F.array_contains("_fields", LABEL)
    # one row per file, as long as one line
    headers = lines.groupBy("file").agg(
        F.first(F.when(is_header, F.col("_fields")), ignorenulls=True).alias("_names"), F.max(F.size("_fields")).alias("_width")
    )
    data = _numbered(lines.where(~is_header))
    data = join_small(data, headers, "file", "left", numbers=F.greatest(F.size("_names"), F.lit(0)))
    default = F.transform("_fields", lambda v, i: F.when(i == F.size("_fields") - 1, LABEL).otherwise(""))
    width = F.when(F.col("_names").isNotNull(), F.size("_names")).otherwise(F.col("_width"))
    named = data.withColumn("_fields", _of_width(F.col("_fields"), width)).withColumn("_names", F.coalesce("_names", default))
    cells = F.arrays_zip(F.col("_fields").alias("value"), F.col("_names").alias("name"))
    series = F.transform(
        F.filter(cells, lambda c: (c["name"] != LABEL) & ~c["name"].startswith("Unnamed")),
        lambda c: F.nullif(F.trim(c["value"]), F.lit("")).cast("double"),
    )
    label = F.element_at(F.filter(cells, lambda c: c["name"] == LABEL), 1)["value"].cast("double").cast("bigint")
    return named.select("file", SERIES_ID, series.alias(SERIES), label.alias(LABEL))


def part_pattern(part: str) -> str:
    """Glob of the processed files of one part."""
    return f"*_{part}.csv"


def base_name(path: str | Column = "file") -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def raw_name_columns(df: DataFrame, name: Column) -> DataFrame:
    """``{dataset}_{part}.csv`` to ``dataset_name`` and ``part``."""
    pieces = F.split(F.regexp_replace(name, r"\.csv$", ""), "_")
    return df.withColumn(DATASET, F.get(pieces, 0)).withColumn(PART, F.get(pieces, 1))


def representation_name_columns(df: DataFrame, name: Column) -> DataFrame:
    """``{dataset}_{model}_{encoder}.csv`` to three columns; any other number of pieces is an error."""
    pieces = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    checked = F.when(F.size(pieces) == 3, pieces).otherwise(
        F.raise_error(F.concat(F.lit("file name does not have three pieces: "), name)).cast("array<string>")
    )
    return (
        df.withColumn("_pieces", checked)
        .withColumn(DATASET, F.col("_pieces")[0])
        .withColumn("model_name", F.col("_pieces")[1])
        .withColumn("encoder_name", F.col("_pieces")[2])
        .drop("_pieces")
    )


def seed_of_path(path: str | Column, template: str = "run_{{seed_number}}") -> Column:
    """Seed in a run folder name, or null when the path has no such folder."""
    head, tail = template.split("{{seed_number}}")
    pattern = f"{re.escape(head)}(\\d+){re.escape(tail)}(?:/|$)"
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast("int")


def keep_seeds(df: DataFrame, path: str | Column, seeds: Iterable[int], template: str = "run_{{seed_number}}") -> DataFrame:
    return df.withColumn("seed", seed_of_path(path, template)).where(F.col("seed").isin(list(seeds)))


def read_dataset_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a headerless list, first column, each once."""
    names = spark.read.text(path).select(F.trim(F.get(F.split("value", ","), 0)).alias(DATASET))
    return names.where(F.col(DATASET) != "").dropDuplicates()


def part_files(datasets: DataFrame, folder: str = "", patterns: dict[str, str] = FILE_PATTERNS) -> DataFrame:
    """Path of every part file of every listed data set."""
    prefix = f"{folder.rstrip('/')}/" if folder else ""
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias(PART),
                F.concat(F.lit(prefix), F.replace(F.lit(t), F.lit("{dataset_name}"), F.col(DATASET))).alias("path"),
            )
            for p, t in patterns.items()
        ]
    )
    return datasets.select(DATASET, F.explode(rows).alias("_f")).select(DATASET, "_f.*")
