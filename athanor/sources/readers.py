"""Readers of molecule lists, mappings and sectioned substrate files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metabolize import parse_molecules

MAPPING = "subject_id string, predicate_id string, object_id string, mapping_justification string, subject_label string, object_label string, always_with string"


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """Lines "smiles [name]" with what parsing gives; "#" begins a comment line.  Errors stay as rows."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(value, '#')")
    cut = F.split(F.trim("value"), r"\s+", 2)
    return parse_molecules(lines.select(cut[0].alias("smiles"), F.try_element_at(cut, F.lit(2)).alias("name")))


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Tab separated (id, smiles) lines with comments."""
    return spark.read.option("sep", "\t").option("comment", "#").schema("id string, smiles string").csv(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(section, ord, smiles) of a file whose "[name]" or "# name" lines begin sections.  One small file in one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    head = F.regexp_extract("value", r"^(?:\[|#+\s*)([^\]]*?)\]?\s*$", 1)
    marked = lines.withColumn("head", F.when(F.col("value").rlike(r"^(\[|#)"), head))
    found = marked.withColumn("section", F.last("head", ignorenulls=True).over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    rows = found.filter("head is null and trim(value) <> ''")
    return rows.select("section", (F.row_number().over(Window.partitionBy("section").orderBy("line")) - 1).alias("ord"), F.trim("value").alias("smiles"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A tab separated mapping table (plain or gzip) with "#" header lines."""
    return spark.read.option("sep", "\t").option("comment", "#").option("header", True).schema(MAPPING).csv(path)


def write_smiles(df: DataFrame, path: str, smiles: str = "csmi", name: str | None = None) -> None:
    """One molecule a line."""
    columns = [F.col(smiles)] + ([F.col(name)] if name else [])
    df.select(F.concat_ws(" ", *columns).alias("value")).write.text(path)


def write_emissions(df: DataFrame, path: str) -> None:
    """Emissions as JSON lines, nested fields kept."""
    df.write.json(path)
