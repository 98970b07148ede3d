"""Joins on intervals, by bins: overlap joins, and points in intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import ensure_checkpoints
from .sizes import is_small, near


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int, condition: Column | None = None) -> DataFrame:
    """Rows of left and right (aliases ``a`` and ``b``) with equal keys and overlapping inclusive ranges.

    Both sides are spread over the bins that they touch and meet by keys and bin, so one huge key is shared by many tasks. A pair that shares several
    bins is kept only in the bin of the later start, which makes a distinct needless.
    """
    (ls, le), (rs, re) = left_range, right_range

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        w = F.lit(width)
        return df.where(F.col(s) <= F.col(e)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / w), F.floor(F.col(e) / w))))

    a, b = binned(left, ls, le).alias("a"), binned(right, rs, re).alias("b")
    on = (F.col("a._bin") == F.col("b._bin")) & (F.col(f"a.{ls}") <= F.col(f"b.{re}")) & (F.col(f"b.{rs}") <= F.col(f"a.{le}"))
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    on &= F.floor(F.greatest(F.col(f"a.{ls}"), F.col(f"b.{rs}")) / F.lit(width)) == F.col("a._bin")
    return a.join(b, on if condition is None else on & condition)


#: Rows of a cell that are one part of it; a fuller cell is shared by several tasks.
CELL_ROWS = 2048


def rectangle_pairs(rows: DataFrame, keys: list[str], name: str, sides: tuple[tuple[str, str], tuple[str, str]], width: int = 16, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs of rows (aliases ``a`` and ``b``, by name smaller and greater) with equal keys that overlap in both of the inclusive ranges of sides.

    Rows meet by the cells of a grid over both ranges, so what overlaps in one range only seldom meets. A pair that shares several cells is kept in the one of the later starts. Cells
    are counted first: a fuller one than cell_rows has parts, each smaller row lies in one of them and each greater row in all, so a pile-up is shared by as many tasks as it has parts.
    """

    def bins(s: str, e: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))

    (ls, le), (rs, re) = sides
    cells = rows.where((F.col(ls) <= F.col(le)) & (F.col(rs) <= F.col(re))).withColumn("_x", bins(ls, le)).withColumn("_y", bins(rs, re))
    at = [*keys, "_x", "_y"]
    full = cells.groupBy(*at).agg(F.count("*").alias("_n")).where(F.col("_n") > cell_rows).select(*at, F.ceil(F.col("_n") / cell_rows).cast("int").alias("_parts"))
    ensure_checkpoints(rows)
    full = full.checkpoint()  # few rows: at most one for cell_rows of the others
    if full.isEmpty():
        a = b = cells.withColumn("_part", F.lit(0))
        a, b = a.alias("a"), b.alias("b")
    else:
        counted = cells.join(near(full), at, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        a = counted.withColumn("_part", F.pmod(F.xxhash64(name), F.col("_parts")).cast("int")).drop("_parts").alias("a")
        b = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").alias("b")
    on = (F.col("a._part") == F.col("b._part")) & (F.col(f"a.{name}") < F.col(f"b.{name}"))
    for k in at:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    for (s, e), cell in zip(sides, ("_x", "_y")):
        on &= (F.col(f"a.{s}") <= F.col(f"b.{e}")) & (F.col(f"b.{s}") <= F.col(f"a.{e}"))
        on &= F.floor(F.greatest(F.col(f"a.{s}"), F.col(f"b.{s}")) / width) == F.col(f"a.{cell}")
    return a.join(b, on)


def last_containing(points: DataFrame, point: str, genes: DataFrame, name: str, small: bool | None = None, width: int = 4096) -> DataFrame:
    """points with column name: the gene of the greatest gene_ord whose range holds the point, null if none. points needs a unique ``read_ord``.

    A small gene table is broadcast (by its measured size, unless the caller says); otherwise both sides meet in bins.
    """
    g = genes.select(F.col("region").alias("_region"), F.col("gene").alias("_gene"), "g_start", "g_stop", "gene_ord")
    if is_small(genes) if small is None else small:
        hit = (F.col("region") == F.col("_region")) & F.col(point).between(F.col("g_start"), F.col("g_stop"))
        met = points.join(F.broadcast(g), hit, "left").select("read_ord", "_gene", "gene_ord")
    else:
        spread = genes.select("region", F.col("gene").alias("_gene"), "g_start", "g_stop", "gene_ord")
        met = overlap_join(points, spread, ["region"], (point, point), ("g_start", "g_stop"), width).select("a.read_ord", "b._gene", "b.gene_ord")
    best = met.groupBy("read_ord").agg(F.max_by("_gene", "gene_ord").alias(name))
    return points.join(best, "read_ord", "left")


#: Genes that a read's arms are held against one by one; more meet in bins.
LISTED_GENES = 4096


def both_containing(arms: DataFrame, genes: DataFrame, small: bool | None = None, width: int = 4096) -> DataFrame:
    """arms (l_start, r_start, region, and a unique read_ord) with l_gene and r_gene, as :func:`last_containing` finds them, in one join for both.

    A small gene table is broadcast as one row for each region, an array of its genes in order; a row then finds its genes without a shuffle of any arm.
    """
    if is_small(genes, rows=LISTED_GENES) if small is None else small:
        row = F.struct(F.col("gene_ord").alias("o"), F.col("g_start").alias("a"), F.col("g_stop").alias("b"), F.col("gene").alias("gene"))
        listed = genes.groupBy(F.col("region").alias("_region")).agg(F.sort_array(F.collect_list(row), asc=False).alias("_genes"))

        def last(point: str) -> Column:
            return F.get(F.filter("_genes", lambda g: F.col(point).between(g["a"], g["b"])), F.lit(0))["gene"]

        met = arms.join(F.broadcast(listed), F.col("region") == F.col("_region"), "left")
        return met.withColumns({"l_gene": last("l_start"), "r_gene": last("r_start")}).drop("_region", "_genes")
    for side in "lr":
        arms = last_containing(arms, f"{side}_start", genes, f"{side}_gene", False, width)
    return arms
