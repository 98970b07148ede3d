"""From alignment records to reads with two arms in genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import cigar as cg
from .range_join import both_containing


def accepted_tag(xg: Column) -> Column:
    """Whether the XG tag lets a record through; absent counts as 0."""
    return F.coalesce(xg, F.lit("XG:i:0")).isin("XG:i:0", "XG:i:1")


def with_arms(records: DataFrame) -> DataFrame:
    """records (pos, cigar, seq, ...) of gapped shape with 0-based inclusive arm ends and arm sequences."""
    run = records.where(cg.is_gapped(F.col("cigar"))).withColumn("_run", cg.runs(F.col("cigar")))
    clip, left, gap, right = (cg.length(F.col("_run"), k) for k in range(4))
    starts = run.withColumns({"l_start": F.col("pos") - 1, "_clip": clip, "_left": left, "_gap": gap, "_right": right})
    ends = starts.withColumn("l_stop", F.col("l_start") + F.col("_left") - 1).withColumn("r_start", F.col("l_stop") + F.col("_gap") + 1)
    ends = ends.withColumn("r_stop", F.col("r_start") + F.col("_right") - 1)
    left_seq = F.substr("seq", (F.col("_clip") + 1).cast("int"), F.col("_left").cast("int"))
    right_seq = F.substr("seq", (F.col("_clip") + F.col("_left") + 1).cast("int"), F.col("_right").cast("int"))
    return ends.withColumns({"l_seq": left_seq, "r_seq": right_seq}).drop("_run", "_clip", "_left", "_gap", "_right")


def last_of_each(reads: DataFrame) -> DataFrame:
    """One row per read_id: the values of its last line, in the place of its first."""
    rest = [c for c in reads.columns if c not in ("read_id", "read_ord")]
    last = reads.groupBy("read_id").agg(F.min("read_ord").alias("read_ord"), F.max_by(F.struct(*rest), "read_ord").alias("_v"))
    return last.select("read_ord", "read_id", "_v.*")


#: What becomes of a line.
OUTCOMES = ("header", "other tag", "no cigar", "other shape", "no gene", "read")


def _early() -> Column:
    """What becomes of a line that doesn't get as far as the genes; null for the others."""
    return (
        F.when(F.col("is_header"), "header")
        .when(~accepted_tag(F.col("xg")), "other tag")
        .when(F.coalesce(F.col("cigar"), F.lit("*")) == "*", "no cigar")
        .when(~cg.is_gapped(F.col("cigar")), "other shape")
    )


class Seen:
    """Counts of outcomes, observed on the plan that parses: no line is read for them alone. They are there once that plan has run to its end."""

    def __init__(self) -> None:
        self.early, self.late = Observation(), Observation()

    def counts(self) -> dict[str, int]:
        """How many lines had each of OUTCOMES."""
        early, late = self.early.get, self.late.get
        return {k: early.get(k, late.get(k, 0)) for k in OUTCOMES}


def in_genes(sam: DataFrame, genes: DataFrame, small_genes: bool | None = None, seen: Seen | None = None) -> DataFrame:
    """Arms of the accepted lines with l_gene and r_gene, null where an arm lies in no gene; tag and shape filters come before the joins."""
    if seen:
        sam = sam.observe(seen.early, *[F.count_if(F.coalesce(_early() == k, F.lit(False))).alias(k) for k in OUTCOMES[:4]])
    records = sam.where(~F.col("is_header") & accepted_tag(F.col("xg")))
    arms = with_arms(records.select(F.col("file_line").alias("read_ord"), F.col("qname").alias("read_id"), F.col("rname").alias("region"), "pos", "cigar", "seq"))
    arms = both_containing(arms, genes, small_genes)
    if seen:
        arms = arms.observe(seen.late, *[F.count_if(c).alias(k) for k, c in (("no gene", ~_located()), ("read", _located()))])
    return arms


def _located() -> Column:
    return F.coalesce((F.col("l_gene") != "") & (F.col("r_gene") != ""), F.lit(False))


def parse(sam: DataFrame, genes: DataFrame, small_genes: bool | None = None, seen: Seen | None = None) -> DataFrame:
    """Alignment lines (see sources) to reads with both arms in genes."""
    kept = in_genes(sam, genes, small_genes, seen).where(_located())
    columns = ["read_ord", "read_id", "region", "l_start", "l_stop", "r_start", "r_stop", "l_gene", "r_gene", "l_seq", "r_seq"]
    return last_of_each(kept.select(*columns))


def outcomes(sam: DataFrame, genes: DataFrame) -> DataFrame:
    """(outcome, n) for each of OUTCOMES that lines have: headers, lines rejected for their tag, for a missing or other alignment shape or for arms in no gene, and reads."""
    early = sam.select(_early().alias("outcome")).where(F.col("outcome").isNotNull())
    late = in_genes(sam, genes).select(F.when(_located(), "read").otherwise("no gene").alias("outcome"))
    return early.unionByName(late).groupBy("outcome").agg(F.count("*").alias("n"))


def single_region(reads: DataFrame) -> str:
    """The only region of the reads; an error if there is none, or several."""
    found = [r["region"] for r in reads.select("region").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("reads of exactly one region are expected, found " + ("none" if not found else "several"))
    return found[0]


def restrict(reads: DataFrame, left: str, right: str) -> DataFrame:
    """Reads of one ordered gene pair; an error if there are none."""
    kept = reads.where((F.col("l_gene") == left) & (F.col("r_gene") == right))
    if kept.isEmpty():
        raise ValueError(f"no read has its arms in {left} and {right}")
    return kept
