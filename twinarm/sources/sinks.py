"""Output lines in the text formats of the field, and their writing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digits import fixed16

#: The first lines of the track files and of the auxiliary table.
BP_TRACK = "track graphType=arc itemRgb=on"
AUX_HEADER = "Group_ID\tnum_reads\tUU_cl,UC_cl,num_basepairs\tL_start_min,L_start_max,L_start_std\tL_stop_min,L_stop_max,L_stop_std\tR_start_min,R_start_max,R_start_std\tR_stop_min,R_stop_max,R_stop_std"


def _text(*columns):
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])


def annotated(sam: DataFrame, groups: DataFrame, assigned: DataFrame) -> DataFrame:
    """(l_gene, r_gene, file_line, value): every line of a read in a surviving group, with its DG and NG tags; a read in several takes the least."""
    pair = ["l_gene", "r_gene"]
    first = assigned.join(groups.select(*pair, "dg", "ng"), [*pair, "dg"]).groupBy(*pair, "read_id").agg(F.min(F.struct("dg", "ng")).alias("g"))
    met = sam.where(~F.col("is_header")).join(first, F.col("qname") == F.col("read_id"))
    return met.select(*pair, "file_line", F.concat(F.rtrim("value"), F.format_string("\tDG:i:%d\tNG:i:%d", "g.dg", "g.ng")).alias("value"))


def headers(sam: DataFrame, pairs: DataFrame) -> DataFrame:
    """(l_gene, r_gene, file_line, value): the header lines of the input for each gene pair; each pair's output repeats them."""
    lines = sam.where("is_header").select("file_line", "value", F.lit(1).alias("_k"))
    return pairs.select("l_gene", "r_gene", F.lit(1).alias("_k")).join(lines, "_k").drop("_k")


def combined(sam: DataFrame, merged: DataFrame) -> DataFrame:
    """(part, file_line, value): headers as they are, aligned lines tagged XG:i:0, then merged chimeric lines (with the file_line of their left record), all in the order of their files."""
    head = sam.select(F.lit(0).alias("part"), "file_line", F.when(F.col("is_header"), F.col("value")).otherwise(F.concat(F.trim("value"), F.lit("\tXG:i:0"))).alias("value"))
    return head.unionByName(merged.select(F.lit(1).alias("part"), "file_line", "value"))


def group_bed(groups: DataFrame) -> DataFrame:
    """Twelve columns per duplex group; positions are 1-based. The coverage is printed with sixteen exact decimals."""
    start, stop = F.col("l_start") + 1, F.col("r_stop") + 1
    name = F.concat(F.lit("Group_"), F.col("dg").cast("string"), F.lit("_"), fixed16(F.col("coverage")))
    blocks = F.concat_ws(",", (F.col("l_stop") - F.col("l_start") + 1).cast("string"), (F.col("r_stop") - F.col("r_start") + 1).cast("string"))
    return groups.select("l_gene", "r_gene", "dg", _text("region", start, stop, name, "num_reads", F.lit("-"), start, start, F.lit("0,0,0"), F.lit("2"), blocks, F.concat(F.lit("0,"), (F.col("r_start") - F.col("l_start")).cast("string"))).alias("value"))


def pair_bed(stems: DataFrame) -> DataFrame:
    """One line per base pair (stems with basepairs)."""
    each = stems.select("l_gene", "r_gene", "ptile", "region", "dg", F.posexplode("basepairs").alias("i", "p"))
    return each.select("l_gene", "r_gene", "ptile", "dg", "i", _text("region", F.col("p.l") + 1, F.col("p.r") + 1, "dg").alias("value"))


def arc_bed(stems: DataFrame) -> DataFrame:
    """One line per stem group, from the middle of the left arm to that of the right one."""
    mid = [F.floor((F.col(f"{s}_start") + F.col(f"{s}_stop")) / 2) + 1 for s in "lr"]
    return stems.select("l_gene", "r_gene", "ptile", "dg", _text("region", *mid, "dg").alias("value"))


def aux_table(groups: DataFrame, stems: DataFrame, stats: DataFrame) -> DataFrame:
    """For each percentile of which a gene pair has stems, one line per duplex group: its stem group's reads, crosslinks and spread of ends; zeros where it has none."""
    key = ["l_gene", "r_gene", "ptile", "dg"]
    own = stems.select(*key, F.concat_ws(",", "uu", "uc", "n_bp").alias("links"))
    spread = stats.join(own, key)
    groups = groups.join(stems.select("l_gene", "r_gene", "ptile").distinct(), ["l_gene", "r_gene"])
    ends = [F.concat_ws(",", *[F.col(f"{c}_{k}").cast("string") for k in ("min", "max", "std")]) for c in ("l_start", "l_stop", "r_start", "r_stop")]
    spread = spread.select(*key, F.col("num_reads").cast("string").alias("n"), "links", *[e.alias(f"e{i}") for i, e in enumerate(ends)])
    joined = groups.select(*key).join(spread, key, "left")
    none = F.lit("0,0,0")
    return joined.select(*key, _text(F.concat(F.lit("Group_"), F.col("dg").cast("string")), F.coalesce("n", F.lit("0")), F.coalesce("links", none), *[F.coalesce(f"e{i}", none) for i in range(4)]).alias("value"))


def base_name(reads: str) -> str:
    """What the outputs of a reads file are named after: its name up to ``.sam``."""
    return re.split(r"\.sam", re.sub(r"/+$", "", reads).rsplit("/", 1)[-1])[0] or "reads"


def output_name(base: str, left: str, right: str, cluster: str, t_o: float, t_eig: float | None = None) -> str:
    """The common part of a gene pair's output names."""
    return f"{base}_twinarm.g{left},{right}.{clustering(cluster, t_o, t_eig)}"


def clustering(cluster: str, t_o: float, t_eig: float | None = None) -> str:
    """How a run clusters, for names."""
    return f"{cluster}.t_o{t_o}" + (f".t_eig{t_eig}" if t_eig is not None and cluster == "spectral" else "")


#: Names in a folder that a run has written.
_WRITTEN = re.compile(r"output=|part-|_SUCCESS$|\.")


def own_folder(spark: SparkSession, path: str) -> str:
    """path, if nothing is there or only what an earlier run has written, which may be replaced; an error if anything else lies in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        found = fs.getFileStatus(at)
        foreign = [path] if found.isFile() else [n for s in fs.listStatus(at) if not _WRITTEN.match(n := s.getPath().getName())]
        if foreign:
            raise FileExistsError(f"{path} holds what no run has written, such as {foreign[0]}; it stays as it is")
    return path


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write value in order; the sort is distributed, so the lines stand in order over the part files. An earlier run's folder is replaced, no other one."""
    lines.orderBy(*order).select("value").write.mode("overwrite").text(own_folder(lines.sparkSession, path))


def write_outputs(lines: DataFrame, path: str) -> None:
    """Write lines (output, part, ord, i, value) as a folder ``output=<name>`` for each output, in one job. An earlier run's folder is replaced, no other one.

    Rows are dealt out by ranges of output and place, so a large output has several files, whose lines stand in order over them.
    """
    order = ["output", "part", "ord", "i"]
    path = own_folder(lines.sparkSession, path)
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("output", "value").write.mode("overwrite").partitionBy("output").text(path)
