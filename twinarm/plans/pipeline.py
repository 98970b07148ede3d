"""From reads to duplex groups and stem groups, and to files."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chimeric, graph, groups, stems
from ..operators import reads as rd
from ..operators.components import ensure_checkpoints
from ..operators.sizes import near
from ..sources import files, sinks

log = logging.getLogger("twinarm")
PAIR = ["l_gene", "r_gene"]


@dataclass
class Config:
    """What a run needs. t_o defaults to 0.5 for spectral and 0.1 for clique clusters."""

    cluster: str = "spectral"
    t_o: float | None = None
    t_eig: float = 5.0
    arms: str = "left2"
    embedding: str = "columns"
    kernel: str = "duplex"
    genes: tuple[str, str] | None = None
    allow_multi_region: bool = False
    percentiles: tuple[int, ...] = field(default=stems.PERCENTILES)

    def __post_init__(self) -> None:
        if self.cluster not in ("spectral", "cliques"):
            raise ValueError(f"cluster must be 'spectral' or 'cliques', not {self.cluster!r}")
        if self.t_o is None:
            self.t_o = 0.5 if self.cluster == "spectral" else 0.1
        if not 0 <= self.t_o < 1:
            raise ValueError("t_o must lie between 0 and 1")


def duplex_groups(reads: DataFrame, config: Config) -> dict[str, DataFrame]:
    """members (reads with dg of valid groups), groups (statistics, coverage, colours) of gene pairs that pass, and failed reads of those that don't."""
    ensure_checkpoints(reads)
    assigned = graph.clustered(reads, config.t_o, config.cluster, config.t_eig, config.embedding)
    members = groups.valid_groups(reads.join(assigned.select("read_id", "dg", "component"), "read_id")).checkpoint()
    failed = groups.non_overlapping(members).checkpoint()
    stats = groups.colours(groups.coverage(groups.medians(members), members))
    stats = groups.without_failed_pairs(stats, failed).checkpoint()
    members = members.join(failed.select("l_gene", "r_gene").distinct(), ["l_gene", "r_gene"], "left_anti")
    return {"members": members, "groups": stats, "failed": failed}


def stem_groups(members: DataFrame, regions: DataFrame, config: Config) -> dict[str, DataFrame]:
    """stems of all percentiles with folds and crosslinks, and the spread of their ends. Envelopes of several percentiles are folded once."""
    chosen = stems.short_reads(members, stems.cutoffs(members, config.arms, config.percentiles))
    region = members.groupBy("l_gene", "r_gene").agg(F.max("region").alias("region"))
    envelope = stems.envelopes(chosen).join(region, ["l_gene", "r_gene"])
    folded = stems.folded(stems.sequences(envelope, regions), config.kernel)
    found = stems.stem_info(folded.withColumn("cut", F.length("l_seq").cast("bigint")).join(near(regions, "seq"), "region")).drop("seq")
    return {"stems": found.checkpoint(), "spread": stems.edge_stats(chosen).checkpoint()}


def pair_report(reads: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """Per gene pair: its reads, its duplex groups, its reads that don't overlap others of their group, and whether it is dropped for them."""
    n = reads.groupBy(*PAIR).agg(F.count("*").alias("n_reads"))
    failed = found["failed"].groupBy(*PAIR).agg(F.count("*").alias("n_apart"))
    groups = found["groups"].groupBy(*PAIR).agg(F.count("*").alias("n_groups"))
    joined = n.join(groups, PAIR, "left").join(failed, PAIR, "left").fillna(0, ["n_groups", "n_apart"])
    return joined.select(*PAIR, "n_reads", "n_groups", "n_apart", (F.col("n_apart") > 0).alias("dropped"))


def tell(report: DataFrame) -> None:
    """Log what became of each gene pair."""
    for r in report.orderBy(*PAIR).toLocalIterator():
        log.info("%s, %s: %d reads, %d duplex groups", r["l_gene"], r["r_gene"], r["n_reads"], r["n_groups"])
        if r["dropped"]:
            log.error("%s, %s: no output, as %d of %d reads share a group with a read that they don't overlap; try this pair alone with a t_o greater by 0.1, or with cliques", r["l_gene"], r["r_gene"], r["n_apart"], r["n_reads"])


def run(spark: SparkSession, reads_file: str, seq_file: str, gene_file: str, out: str | None = None, chimeric_file: str | None = None, config: Config | None = None) -> dict[str, DataFrame]:
    """The whole run over files. out is the folder in which the run makes one of its own, named after the reads and the clustering (:func:`run_folder`), or None to write nothing;
    nothing else in out is touched. Counts, dropped pairs and times go to the log ``twinarm``."""
    config, began = config or Config(), time.perf_counter()
    sam = files.read_sam(spark, reads_file)
    if chimeric_file:
        merged = chimeric.lines(files.read_sam(spark, chimeric_file).where("not is_header"))
        if out:
            sinks.write_lines(sinks.combined(sam, merged), f"{out}/{sinks.base_name(reads_file)}_twinarm.combined.sam", ["part", "file_line"])
        last = sam.agg(F.max("file_line")).first()[0] or 0
        sam = sam.unionByName(files.sam_fields(merged.select((F.col("file_line") + last + 1).alias("file_line"), "value")))
    regions, genes = files.read_fasta(spark, seq_file), files.read_genes(spark, gene_file)
    ensure_checkpoints(sam)
    seen = rd.Seen()
    reads = rd.parse(sam, genes, seen=seen).checkpoint()
    log.info("lines: %s", ", ".join(f"{n} {k}" for k, n in seen.counts().items()))
    if not config.allow_multi_region:
        rd.single_region(reads)
    if config.genes:
        reads = rd.restrict(reads, *config.genes)
    found = duplex_groups(reads, config)
    region = reads.groupBy(*PAIR).agg(F.max("region").alias("region"))
    found["groups"] = found["groups"].join(region, PAIR).checkpoint()
    found["pairs"] = pair_report(reads, found)
    if log.isEnabledFor(logging.ERROR):
        tell(found["pairs"])
    log.info("duplex groups after %.1f s", time.perf_counter() - began)
    found |= stem_groups(found["members"], regions, config)
    if out:
        write(sam, found, out, config, sinks.base_name(reads_file))
    log.info("all after %.1f s", time.perf_counter() - began)
    return found


def run_folder(out: str, base: str, config: Config) -> str:
    """The folder of a run's outputs."""
    return f"{out.rstrip('/') or '/'}/{base}_twinarm.{sinks.clustering(config.cluster, config.t_o, config.t_eig)}"


def write(sam: DataFrame, found: dict[str, DataFrame], out: str, config: Config, base: str = "reads") -> None:
    """All outputs in one job, a folder ``output=<name>`` for each gene pair and kind, below :func:`run_folder`."""
    group, stem = found["groups"], found["stems"]
    first, rest = sinks.output_name(base, "\0", "\0", config.cluster, config.t_o, config.t_eig).split("\0,\0")
    name = F.concat(F.lit(first), F.col("l_gene"), F.lit(","), F.col("r_gene"), F.lit(rest))

    def lines(df: DataFrame, kind: Column, part: int, place: Column, i: Column | None = None) -> DataFrame:
        return df.select(F.concat(name, kind).alias("output"), F.lit(part).alias("part"), place.cast("bigint").alias("ord"), (F.lit(0) if i is None else i).cast("bigint").alias("i"), "value")

    def of_percentile(kind: str) -> Column:
        return F.concat(F.lit("_sg_p"), F.col("ptile").cast("string"), F.lit(kind))

    percentiles, none = stem.select(*PAIR, "ptile").distinct(), F.lit(0)
    kinds = [
        lines(sinks.headers(sam, group.select(*PAIR).distinct()), F.lit(".sam"), 0, F.col("file_line")),
        lines(sinks.annotated(sam, group, found["members"]), F.lit(".sam"), 1, F.col("file_line")),
        lines(sinks.group_bed(group), F.lit("_dg.bed"), 1, F.col("dg")),
        *(lines(percentiles.withColumn("value", F.lit(top)), of_percentile(kind), 0, none) for kind, top in (("_arc.bed", sinks.BP_TRACK), ("_bp.bed", sinks.BP_TRACK), (".aux", sinks.AUX_HEADER))),
        lines(sinks.arc_bed(stem), of_percentile("_arc.bed"), 1, F.col("dg")),
        lines(sinks.pair_bed(stem), of_percentile("_bp.bed"), 1, F.col("dg"), F.col("i")),
        lines(sinks.aux_table(group, stem, found["spread"]), of_percentile(".aux"), 1, F.col("dg")),
    ]
    every = kinds[0]
    for k in kinds[1:]:
        every = every.unionByName(k)
    sinks.write_outputs(every, run_folder(out, base, config))
