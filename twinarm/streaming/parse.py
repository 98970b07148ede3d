"""Streams of alignment lines. Parsing has no state; groups depend on all reads of a gene pair, so each micro-batch clusters the pairs that it touches anew.

Reads are kept in a table in a shared folder, dealt into buckets of gene pairs, beside an index of where each read lies, in buckets of reads. A batch writes its own folders of both, named
after its number, so a batch that is run again replaces what it wrote. Of a read with several lines the last one counts, in order of file and place, whenever it arrives; where that moves
a read to another gene pair, the pairs that it leaves get a row that says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import ensure_checkpoints
from ..operators.range_join import both_containing
from ..operators.reads import accepted_tag, with_arms
from ..sources.files import sam_fields

PAIR = ["l_gene", "r_gene"]
#: Folders of a batch; a batch reads those that its pairs and reads fall into.
BUCKETS = 64


def read_stream(spark: SparkSession, folder: str, genes: DataFrame) -> DataFrame:
    """Reads in files that arrive in a folder, with the genes of both arms as in a batch run, and path and block, where their file's part begins; genes is a static table."""
    ensure_checkpoints(genes)
    genes = genes.checkpoint()  # row numbers of a file scan can't stand in a stream's plan
    lines = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    records = sam_fields(lines).where(~F.col("is_header") & accepted_tag(F.col("xg")))
    arms = with_arms(records.select(F.col("qname").alias("read_id"), F.col("rname").alias("region"), "pos", "cigar", "seq", "path", "block"))
    return both_containing(arms, genes, True).where((F.col("l_gene") != "") & (F.col("r_gene") != ""))


def _bucket(*columns: str) -> Column:
    return F.pmod(F.hash(*columns), F.lit(BUCKETS))


def _part_of(spark: SparkSession, path: str, bucket: Column, rows: DataFrame) -> DataFrame:
    """The rows of a bucketed table in the buckets of rows; only those folders are read."""
    own = [r["bucket"] for r in rows.select(bucket.alias("bucket")).distinct().collect()]  # at most BUCKETS numbers
    return spark.read.parquet(path).where(F.col("bucket").isin(own))


def last_lines(new: DataFrame) -> DataFrame:
    """A batch's reads: the values of each one's last line, and version, its file and place."""
    place = F.col("block") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = new.withColumn("version", F.struct(F.col("path"), place.alias("place"))).drop("path", "block")
    rest = [c for c in placed.columns if c not in ("read_id", "version")]
    return placed.groupBy("read_id").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("_v")).select("read_id", "version", "_v.*")


def store_batch(new: DataFrame, number: int, store: str) -> tuple[DataFrame, DataFrame]:
    """Add a batch's reads to the tables in store; gives all reads, as they stand now, of the gene pairs that the batch touches, and those pairs. Running a batch again changes nothing."""
    spark = new.sparkSession
    ensure_checkpoints(new)
    rows = last_lines(new).checkpoint()
    where = rows.select("read_id", *PAIR, "version")
    where.withColumn("bucket", _bucket("read_id")).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/index/batch={number}")
    known = _part_of(spark, f"{store}/index", _bucket("read_id"), rows).join(rows.select("read_id"), "read_id", "left_semi").groupBy("read_id", *PAIR).agg(F.max("version").alias("version"))
    known = known.checkpoint()
    latest = known.groupBy("read_id").agg(F.max_by(F.struct(*PAIR), "version").alias("at"), F.max("version").alias("last"))
    left = known.join(latest, "read_id").where((F.col("at.l_gene") != F.col("l_gene")) | (F.col("at.r_gene") != F.col("r_gene")))
    gone = left.select("read_id", *PAIR, F.col("last").alias("version"), F.lit(True).alias("gone"))
    kept = rows.withColumn("gone", F.lit(False)).unionByName(gone, allowMissingColumns=True)
    kept.withColumn("bucket", _bucket(*PAIR)).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/reads/batch={number}")
    touched = known.select(*PAIR).distinct()
    held = _part_of(spark, f"{store}/reads", _bucket(*PAIR), touched).join(touched, PAIR, "left_semi")
    rest = [c for c in held.columns if c not in ("read_id", "version", "batch", "bucket", *PAIR)]
    # A read that comes back to a pair after it has left has a later version than what says that it left.
    now = held.groupBy(*PAIR, "read_id").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), F.struct("version", ~F.col("gone"))).alias("_v"))
    return now.select(*PAIR, "read_id", "version", "_v.*").where(~F.col("gone")).drop("gone"), touched


def cluster_batches(reads: DataFrame, store: str, checkpoint: str, cluster: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, DataFrame, int], None]):
    """A query that keeps reads in store and hands sink the clusters of the gene pairs that each batch touches, those pairs (one may have no reads left), and the batch's number."""

    def batch(new: DataFrame, number: int) -> None:
        if not new.isEmpty():
            rows, touched = store_batch(new, number, store)
            sink(cluster(rows), touched, number)

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
