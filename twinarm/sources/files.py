"""Readers of alignments, sequences, genes and base pairs. Compressed files, folders and globs work as with any text source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizes import near


#: Bits of a line number that tell its place in its file; the bits above them number the files in order of their paths.
PLACE_BITS = 43
#: Paths are written with one slash or several after the scheme.
_ROOT = "^([A-Za-z0-9+.-]+):/+"


def _placed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """rows of a text scan with their number: rising with the file's path and with the place in the file, and unique.

    The place is the block's offset and the row's number in its task; a line has a byte at least, so numbers of different blocks don't meet, and no pass over
    the data counts lines. Only the list of files is known to the driver.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = rows.select((F.col("_metadata.file_block_start") + row).alias(name), F.regexp_replace("_metadata.file_path", _ROOT, "$1:/").alias("_path"), "value")
    paths = sorted(re.sub(_ROOT, r"\1:/", path) for path in rows.inputFiles())
    if len(paths) < 2:
        return numbered.drop("_path")
    order = spark.createDataFrame([(path, k) for k, path in enumerate(paths)], "_path string, _file bigint")
    known = F.coalesce("_file", F.raise_error(F.concat(F.lit("a file without a number: "), "_path")).cast("bigint"))
    return numbered.join(near(order, "_path"), "_path", "left").select((F.shiftleft(known, PLACE_BITS) + F.col(name)).alias(name), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_line, value) of a file, a folder or a glob."""
    return _placed(spark, spark.read.text(path), "file_line")


def sam_fields(lines: DataFrame) -> DataFrame:
    """Alignment lines (value, and what else they have) to columns; works on streams too. Numbers that don't parse are null."""
    f = F.split(F.rtrim(F.col("value")), "\t")

    def field(k: int) -> Column:
        return F.get(f, F.lit(k))

    def tag(k: int) -> Column:
        return F.try_element_at(F.split(field(k), ":", 3), F.lit(3)).try_cast("bigint")

    return lines.withColumns({
        "is_header": F.col("value").startswith("@"), "qname": field(0), "flag": field(1).try_cast("int"), "rname": field(2), "pos": field(3).try_cast("bigint"),
        "mapq": field(4).try_cast("int"), "cigar": field(5), "seq": field(9), "qual": field(10), "score": tag(13), "jm": field(17), "ji": field(18), "xg": field(19),
    })


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment file to columns, the line itself in ``value``."""
    return sam_fields(numbered_lines(spark, path))


def fasta_records(records: DataFrame) -> DataFrame:
    """Records without their leading ``>`` (ord, value) to (region, seq); a region given again replaces the earlier one, one without sequence is dropped."""
    lines = F.split("value", "\n")
    name = F.split(F.get(lines, F.lit(0)), "[ \r]")[0]
    seq = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"\s+$", "")), "")
    parsed = records.where(F.col("value") != "").select("ord", name.alias("region"), seq.alias("seq")).where("seq <> ''")
    return parsed.groupBy("region").agg(F.max_by("seq", "ord").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequence file to (region, seq): the record mark is the line separator, so the scan splits like any text file."""
    return fasta_records(_placed(spark, spark.read.option("lineSep", ">").text(path), "ord"))


def first_genes(rows: DataFrame) -> DataFrame:
    """(line, region, start, stop, gene), 1-based, to genes: the first row of a name in its region counts; gene_ord keeps the table's order."""
    at = Window.partitionBy("region", "gene").orderBy("line")
    first = rows.withColumn("k", F.row_number().over(at)).where("k = 1")
    return first.select("region", "gene", (F.col("start") - 1).alias("g_start"), (F.col("stop") - 1).alias("g_stop"), F.col("line").alias("gene_ord"))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene table (tab separated: region, start, stop, gene; 1-based inclusive)."""
    f = F.split("value", "\t")
    rows = numbered_lines(spark, path).where("value <> ''")
    return first_genes(rows.select(F.col("file_line").alias("line"), f[0].alias("region"), f[1].try_cast("bigint").alias("start"), f[2].try_cast("bigint").alias("stop"), F.rtrim(f[3]).alias("gene")))


def read_base_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Known base pairs (tab separated, 1-based; track lines skipped) to (line, region, l, r)."""
    f = F.split("value", "\t")
    rows = numbered_lines(spark, path).where(~F.col("value").contains("graphType=") & (F.col("value") != ""))
    return rows.select(F.col("file_line").alias("line"), f[0].alias("region"), f[1].try_cast("bigint").alias("l"), f[2].try_cast("bigint").alias("r"))
