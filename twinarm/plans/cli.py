"""Command line: python -m twinarm.plans.cli READS SEQUENCES GENES [options]."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import SparkSession

from .pipeline import Config, run


def parser() -> argparse.ArgumentParser:
    """The options."""
    p = argparse.ArgumentParser(description="Duplex and stem groups from aligned two-arm reads.")
    p.add_argument("reads")
    p.add_argument("sequences")
    p.add_argument("genes_table")
    p.add_argument("-out", help="folder in which the run makes one of its own; by default that of the reads")
    p.add_argument("-chimeric", help="chimeric alignments to merge and analyse with the reads")
    p.add_argument("-genes", help="left,right: only this gene pair")
    p.add_argument("-cluster", default="spectral", choices=["spectral", "cliques"])
    p.add_argument("-t_o", type=float, help="overlap threshold; 0.5 for spectral, 0.1 for cliques")
    p.add_argument("-t_eig", type=float, default=5.0, help="eigengap ratio")
    p.add_argument("-n", type=int, help="local cores; by default the session's master decides")
    return p


def main(argv: list[str] | None = None) -> None:
    """Run the pipeline over files."""
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    builder = SparkSession.builder.appName("twinarm")
    spark = (builder.master(f"local[{a.n}]") if a.n else builder).getOrCreate()
    pair = tuple(a.genes.split(",", 1)) if a.genes else None
    config = Config(cluster=a.cluster, t_o=a.t_o, t_eig=a.t_eig, genes=pair)
    run(spark, a.reads, a.sequences, a.genes_table, a.out or os.path.dirname(a.reads) or ".", a.chimeric, config)


if __name__ == "__main__":
    main()
