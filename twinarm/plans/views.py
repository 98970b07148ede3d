"""Inputs derived from the test tables: reads, alignment records, genes, a region's sequence. Integer arithmetic only, so SQL gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases of the derived region.
REGION_LENGTH = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, length: int = REGION_LENGTH) -> DataFrame:
    """One region, base i being the (7 i + i i / 3) mod 4-th of ACGT."""
    base = f"array_join(transform(sequence(0, {length - 1}), i -> substr('ACGT', cast((7L * i + (1L * i * i) div 3) % 4 + 1 as int), 1)), '')"
    return spark.range(1).select(F.lit("chr1").alias("region"), F.expr(base).alias("seq"))


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads without sequences, one per event."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    e = e.select(F.col("event_id").alias("read_ord"), F.col("event_id").alias("read_id"), F.lit("chr1").alias("region"), (F.col("user_id") * 5 + F.col("event_id") % 5).alias("l_start"), F.col("event_type").alias("l_gene"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("r_gene"))
    e = e.withColumn("l_stop", F.col("l_start") + 11 + F.col("read_id") % 9)
    e = e.withColumn("r_start", F.col("l_stop") + 41 + F.col("read_id") * 7 % 6)
    return e.withColumn("r_stop", F.col("r_start") + 11 + F.col("read_id") * 3 % 11)


def bases(first: str, last: str) -> Column:
    """The region's bases between two positions, computed from them."""
    return F.expr(f"array_join(transform(sequence({first}, {last}), i -> substr('ACGT', cast((7 * i + (i * i) div 3) % 4 + 1 as int), 1)), '')")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with the sequences of their arms, computed base by base from their positions."""
    return arms(spark, sf_dir).withColumns({f"{s}_seq": bases(f"{s}_start", f"{s}_stop") for s in "lr"})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment records, some of them of shapes or tags that are rejected."""
    a = arms(spark, sf_dir)
    n_l, n_g, n_r = (F.col("l_stop") - F.col("l_start") + 1), (F.col("r_start") - F.col("l_stop") - 1), (F.col("r_stop") - F.col("r_start") + 1)
    s = lambda c: c.cast("string")
    normal = F.concat(s(F.col("read_id") % 3), F.lit("S"), s(n_l), F.lit("M"), s(n_g), F.lit("N"), s(n_r), F.lit("M"))
    kind = F.col("read_id") % 17
    cigar = (
        F.when(kind == 0, F.concat(s(n_l), F.lit("M1I"), s(n_r), F.lit("M")))
        .when(kind == 1, F.concat(F.lit("5H"), normal))
        .when(kind == 2, F.concat(s(n_l), F.lit("M"), s(n_r), F.lit("M")))
        .when(kind == 3, F.concat(F.lit("5M"), s(n_l - 5), F.lit("M"), s(n_g), F.lit("N"), s(n_r), F.lit("M")))
        .when(kind == 4, F.lit("*"))
        .otherwise(normal)
    )
    tag = F.col("read_id") % 7
    xg = F.when(tag == 0, "XG:i:2").when(tag == 1, "XG:i:1").when(tag == 2, F.lit(None)).otherwise("XG:i:0")
    seq = F.substring(F.expr("repeat('ACGTTGCAAC', 12)"), 1, 120)
    seq = F.substr(seq, (F.col("read_id") % 10 + 1).cast("int"), F.lit(80))
    return a.select(
        F.col("read_id").alias("file_line"), F.lit(False).alias("is_header"), F.concat(F.lit("q"), s(F.col("read_id") % 5000)).alias("qname"), F.col("region").alias("rname"), (F.col("l_start") + 1).alias("pos"),
        cigar.alias("cigar"), seq.alias("seq"), xg.alias("xg"), "read_id",
    )


def gene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a gene table, 1-based, overlapping and with names given twice."""
    p = table(spark, sf_dir, "part")
    start = F.col("p_partkey") * 4
    return p.select(F.col("p_partkey").alias("line"), F.lit("chr1").alias("region"), start.alias("start"), (start + 2 + F.col("p_size") % 9).alias("stop"), F.concat(F.lit("g"), (F.col("p_partkey") % 1900).cast("string")).alias("gene"))


def chimeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of chimeric pairs by event: flags 256 (left) and 0 (right); some pairs lack one, some have other flags or shapes."""
    a = arms(spark, sf_dir)
    n_l, n_r, x = F.col("l_stop") - F.col("l_start") + 1, F.col("r_stop") - F.col("r_start") + 1, F.col("read_id") % 3
    s = lambda c: c.cast("string")
    back = F.when(F.col("read_id") % 4 == 0, F.col("l_start") + 5).otherwise(F.col("r_start"))
    common = [F.concat(F.lit("c"), s(F.col("read_id"))).alias("qname"), F.col("region").alias("rname"), F.substring(F.expr("repeat('ACGTTGCAAC', 12)"), 1, 60).alias("seq"), F.substring(F.expr("repeat('ABCDEFGHIJ', 12)"), 1, 60).alias("qual"), F.lit("jM").alias("jm"), F.lit("jI").alias("ji")]
    left = a.select((F.col("read_id") * 2).alias("file_line"), F.lit(256).alias("flag"), (F.col("l_start") + 1).alias("pos"), F.concat(s(n_l), F.lit("M"), F.when(x > 0, F.concat(s(x), F.lit("S"))).otherwise("")).alias("cigar"), (F.col("read_id") % 50).alias("score"), *common)
    flag = F.when(F.col("read_id") % 11 == 0, 16).otherwise(0)
    right = a.where("read_id % 13 <> 0").select((F.col("read_id") * 2 + 1).alias("file_line"), flag.alias("flag"), (back + 1).alias("pos"), F.concat(s(n_l + x), F.lit("S"), s(n_r), F.when(F.col("read_id") % 19 == 0, "M2N5M").otherwise("M")).alias("cigar"), (F.col("read_id") % 31).alias("score"), *common)
    return left.unionByName(right)
