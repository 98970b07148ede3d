"""Chimeric records merged into gapped alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg

#: Flags of the record of the right and of the left arm.
RIGHT, LEFT = 0, 256


def pairs(records: DataFrame) -> DataFrame:
    """Per qname with exactly the flags 0 and 256, both clipped matches: l_* and r_* of its last records. One shuffle, no self-join."""
    fields = F.struct("rname", "pos", "cigar", "seq", "qual", "score", "jm", "ji")
    met = records.groupBy("qname").agg(
        F.count_distinct("flag").alias("flags"),
        F.max_by(fields, F.when(F.col("flag") == LEFT, F.col("file_line"))).alias("l"),
        F.max_by(fields, F.when(F.col("flag") == RIGHT, F.col("file_line"))).alias("r"),
        F.max(F.when(F.col("flag") == LEFT, F.col("file_line"))).alias("file_line"),
        F.max((F.col("flag") == LEFT).cast("int")).alias("has_l"),
        F.max((F.col("flag") == RIGHT).cast("int")).alias("has_r"),
    )
    both = met.where("flags = 2 and has_l = 1 and has_r = 1").withColumns({"l_run": cg.runs(F.col("l.cigar")), "r_run": cg.runs(F.col("r.cigar"))})
    return both.where((cg.shape(F.col("l_run")) == "SMS") & (cg.shape(F.col("r_run")) == "SMS"))


def merged(records: DataFrame) -> DataFrame:
    """file_line, qname, rname, pos, cigar, seq, qual, score, md, jm, ji of each merged pair.

    The gap n is what lies between both matches and the left record's trailing clip x. Where x is 0 the result is a gap (or an insertion if n is negative);
    otherwise x mismatches and an insertion.
    """
    run = {f"{s}{k}": cg.length(F.col(f"{s}_run"), i) for s in "lr" for i, k in enumerate(("_clip", "_m", "_x"))}
    p = pairs(records).withColumns(run)
    p = p.withColumn("n", F.col("r.pos") - F.col("l.pos") - F.col("l_m") - F.col("l_x"))
    gap, size = F.abs("n"), [F.col(c).cast("string") for c in ("l_m", "l_x", "r_m")]
    plain = F.concat(size[0], F.lit("M"), gap.cast("string"), F.when(F.col("n") < 0, "I").otherwise("N"), size[2], F.lit("M"))
    mixed = F.concat(size[0], F.lit("M"), size[1], F.lit("X"), gap.cast("string"), F.lit("I"), size[2], F.lit("M"))

    def joined(c: str):
        text = F.col(f"r.{c}")
        return F.concat(F.substr(text, (F.col("l_clip") + 1).cast("int")), F.substr(text, (F.col("r_clip") + 1).cast("int"), F.col("r_m").cast("int")))

    return p.select(
        "file_line", "qname", F.col("r.rname").alias("rname"), F.col("l.pos").alias("pos"), "n",
        F.when(F.col("l_x") == 0, plain).otherwise(mixed).alias("cigar"),
        joined("seq").alias("seq"), joined("qual").alias("qual"),
        F.bround((F.col("l.score") + F.col("r.score")) / 2).cast("bigint").alias("score"),
        (F.col("l_m") + F.col("r_m")).alias("md"), F.col("r.jm").alias("jm"), F.col("r.ji").alias("ji"),
    )


def lines(records: DataFrame) -> DataFrame:
    """The merged pairs as alignment lines (file_line of the left record, qname, value)."""
    m = merged(records)
    tags = F.format_string("NH:i:1\tHI:i:1\tAS:i:%d\tnM:i:0\tNM:i:0\tMD:Z:%d", "score", "md")
    head = [F.col("qname"), F.lit("256"), F.col("rname"), F.col("pos").cast("string"), F.lit("255"), F.col("cigar"), F.lit("*"), F.lit("0"), F.lit("0")]
    return m.select("file_line", "qname", F.concat_ws("\t", *head, "seq", "qual", tags, F.coalesce("jm", F.lit("")), F.coalesce("ji", F.lit("")), F.lit("XG:i:1")).alias("value"))
