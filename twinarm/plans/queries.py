"""The queries of the main engine over the test tables, each with SQL of its own where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..operators import chimeric, components, graph, groups, stems, validation
from ..operators import reads as rd
from ..operators.range_join import last_containing
from ..operators.sizes import near
from ..sources import files, sinks
from . import pipeline, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- shared pieces of SQL ----------------------------------------------------------------------------------------------------

READS = """reads AS (
  SELECT event_id AS read_ord, event_id AS read_id, 'chr1' AS region, l_start, l_stop, r_start, r_start + 11 + (event_id * 3) % 11 AS r_stop, l_gene, r_gene
  FROM (SELECT *, l_stop + 41 + (event_id * 7) % 6 AS r_start FROM (SELECT *, l_start + 11 + event_id % 9 AS l_stop
  FROM (SELECT event_id, user_id * 5 + event_id % 5 AS l_start, event_type AS l_gene, 'p' || (user_id % 4) AS r_gene FROM events))))"""
RATIO = "(least(a.{0}_stop, b.{0}_stop) - greatest(a.{0}_start, b.{0}_start) + 1) / (greatest(a.{0}_stop, b.{0}_stop) - least(a.{0}_start, b.{0}_start) + 1)"
PAIRS = f"""{READS}, pairs AS (
  SELECT a.l_gene, a.r_gene, a.read_id AS src, b.read_id AS dst, {RATIO.format("l")} AS ratio_l, {RATIO.format("r")} AS ratio_r
  FROM reads AS a JOIN reads AS b ON a.l_gene = b.l_gene AND a.r_gene = b.r_gene AND a.read_id < b.read_id
   AND a.l_start <= b.l_stop AND b.l_start <= a.l_stop AND a.r_start <= b.r_stop AND b.r_start <= a.r_stop)"""
EDGES = PAIRS + ", edges AS (SELECT *, ratio_l + ratio_r AS weight FROM pairs WHERE ratio_l > {0} AND ratio_r > {0})"
COMPONENTS = EDGES.format(0.5) + """, ends AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
reach AS (SELECT read_id, read_id AS root FROM reads UNION SELECT ends.b, reach.root FROM reach JOIN ends ON ends.a = reach.read_id),
comp AS (SELECT read_id, min(root) AS component FROM reach GROUP BY read_id)"""
BASES = "array_to_string(list_transform(range({0}, {1} + 1), lambda i: substr('ACGT', CAST((7 * i + (i * i) // 3) % 4 + 1 AS INTEGER), 1)), '')"
MEMBERS = COMPONENTS + f""", grouped AS (
  SELECT r.*, component AS dg, {BASES.format("l_start", "l_stop")} || {BASES.format("r_start", "r_stop")} AS seq FROM reads AS r JOIN comp USING (read_id)
), valid AS (SELECT l_gene, r_gene, dg, count(*) AS num_reads, count(DISTINCT seq) AS n_seq FROM grouped GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT seq) > 1),
members AS (SELECT g.* FROM grouped AS g JOIN valid USING (l_gene, r_gene, dg))"""
MEDIANS = MEMBERS + """, medians AS (
  SELECT l_gene, r_gene, dg, CAST(trunc(median(l_start)) AS BIGINT) AS l_start, CAST(trunc(median(l_stop)) AS BIGINT) AS l_stop, CAST(trunc(median(r_start)) AS BIGINT) AS r_start,
         CAST(trunc(median(r_stop)) AS BIGINT) AS r_stop, count(*) AS num_reads, min(l_start) AS ext_min, max(r_stop) AS ext_max FROM members GROUP BY ALL)"""
COVERAGE = MEDIANS + """, nl AS (SELECT g.l_gene, g.r_gene, g.dg, count(*) AS n_l FROM medians AS g JOIN members AS m ON g.l_gene = m.l_gene AND g.r_gene = m.r_gene AND g.l_start <= m.l_stop AND m.l_start <= g.l_stop GROUP BY ALL),
nr AS (SELECT g.l_gene, g.r_gene, g.dg, count(*) AS n_r FROM medians AS g JOIN members AS m ON g.l_gene = m.l_gene AND g.r_gene = m.r_gene AND g.r_start <= m.r_stop AND m.r_start <= g.r_stop GROUP BY ALL),
covered AS (SELECT medians.*, coalesce(n_l, 0) AS n_l, coalesce(n_r, 0) AS n_r, num_reads / sqrt(coalesce(n_l, 0) * coalesce(n_r, 0)) AS coverage FROM medians LEFT JOIN nl USING (l_gene, r_gene, dg) LEFT JOIN nr USING (l_gene, r_gene, dg))"""
PTILES = ", ".join(str(p / 100) for p in stems.PERCENTILES)
CUTOFFS = MEMBERS + f""", lengths AS (SELECT l_gene, r_gene, l_stop - l_start + 1 AS n FROM members UNION ALL SELECT l_gene, r_gene, l_stop - l_start + 1 FROM members),
cuts AS (SELECT l_gene, r_gene, unnest([{", ".join(map(str, stems.PERCENTILES))}]) AS ptile, unnest(quantile_cont(n, [{PTILES}])) AS cutoff FROM lengths GROUP BY l_gene, r_gene),
chosen AS (SELECT m.*, ptile, cutoff FROM members AS m JOIN cuts USING (l_gene, r_gene) WHERE l_stop - l_start + 1 <= cutoff AND r_stop - r_start + 1 <= cutoff),
envelopes AS (SELECT l_gene, r_gene, ptile, dg, count(*) AS num_reads, min(l_start) AS l_start, least(max(l_stop), min(r_start)) AS l_stop, greatest(max(l_stop), min(r_start)) AS r_start, max(r_stop) AS r_stop FROM chosen GROUP BY ALL)"""
WITH = "WITH RECURSIVE "
RECORDS = f"""{READS}, lens AS (SELECT *, l_stop - l_start + 1 AS n_l, r_start - l_stop - 1 AS n_g, r_stop - r_start + 1 AS n_r FROM reads),
shaped AS (SELECT *, (read_id % 3) || 'S' || n_l || 'M' || n_g || 'N' || n_r || 'M' AS normal FROM lens),
records AS (SELECT read_id AS file_line, read_id, 'q' || (read_id % 5000) AS qname, region, l_start + 1 AS pos,
  CASE read_id % 17 WHEN 0 THEN n_l || 'M1I' || n_r || 'M' WHEN 1 THEN '5H' || normal WHEN 2 THEN n_l || 'M' || n_r || 'M' WHEN 3 THEN '5M' || (n_l - 5) || 'M' || n_g || 'N' || n_r || 'M' WHEN 4 THEN '*' ELSE normal END AS cigar,
  substr(substr(repeat('ACGTTGCAAC', 12), 1, 120), CAST(read_id % 10 + 1 AS INTEGER), 80) AS seq,
  CASE read_id % 7 WHEN 0 THEN 'XG:i:2' WHEN 1 THEN 'XG:i:1' WHEN 2 THEN NULL ELSE 'XG:i:0' END AS xg FROM shaped)"""
GAPPED = r"regexp_matches(cigar, '^(\d+S)*(\d+M)+(\d+N)+(\d+M)+(\d+S)*$')"
TOKENS = r"regexp_extract_all(cigar, '(\d+)(\D)', {})"
SUM_OF = r"list_sum([CAST(x AS BIGINT) FOR x IN regexp_extract_all(regexp_extract(cigar, '^(?:\d+S)*{}'{}), '\d+')])"
ARMS = RECORDS + r""", parts AS (
  SELECT *, regexp_extract(cigar, '^((?:\d+S)*)((?:\d+M)+)((?:\d+N)+)((?:\d+M)+)((?:\d+S)*)$', ['s', 'm', 'n', 'k', 't']) AS g FROM records WHERE """ + GAPPED + r"""
), sums AS (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(g.s, '\d+'), lambda x: CAST(x AS BIGINT))), 0) AS s, list_sum(list_transform(regexp_extract_all(g.m, '\d+'), lambda x: CAST(x AS BIGINT))) AS m,
  list_sum(list_transform(regexp_extract_all(g.n, '\d+'), lambda x: CAST(x AS BIGINT))) AS n, list_sum(list_transform(regexp_extract_all(g.k, '\d+'), lambda x: CAST(x AS BIGINT))) AS k FROM parts),
arms AS (SELECT *, pos - 1 AS l_start, pos - 1 + m - 1 AS l_stop, pos - 1 + m + n AS r_start, pos - 1 + m + n + k - 1 AS r_stop, substr(seq, CAST(s + 1 AS INTEGER), CAST(m AS INTEGER)) AS l_seq, substr(seq, CAST(s + m + 1 AS INTEGER), CAST(k AS INTEGER)) AS r_seq FROM sums)"""
GENE_ROWS = "gene_rows AS (SELECT p_partkey AS line, 'chr1' AS region, p_partkey * 4 AS start, p_partkey * 4 + 2 + p_size % 9 AS stop, 'g' || (p_partkey % 1900) AS gene FROM part)"
GENES = GENE_ROWS + ", genes AS (SELECT region, gene, arg_min(start, line) - 1 AS g_start, arg_min(stop, line) - 1 AS g_stop, min(line) AS gene_ord FROM gene_rows GROUP BY region, gene)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in valid groups, a group being a component at 0.5."""
    reads = views.reads(spark, sf_dir)
    placed = graph.with_components(reads, graph.edges(reads, 0.5))
    return groups.valid_groups(placed.withColumn("dg", F.col("component")))


def _chosen(members: DataFrame) -> DataFrame:
    return stems.short_reads(members, stems.cutoffs(members))


# --- records and reads -------------------------------------------------------------------------------------------------------


@query("cigar_tokens", f"WITH {RECORDS} SELECT read_id, CAST(len({TOKENS.format(1)}) AS INTEGER) AS n_tokens, array_to_string({TOKENS.format(2)}, '') AS ops, array_to_string({TOKENS.format(1)}, ',') AS lens FROM records")
def cigar_tokens(spark, sf_dir):
    t = cg.tokens(F.col("cigar"))
    return views.records(spark, sf_dir).select("read_id", F.size(t).alias("n_tokens"), F.array_join(F.transform(t, lambda x: x["op"]), "").alias("ops"), F.array_join(F.transform(t, lambda x: x["len"].cast("string")), ",").alias("lens"))


@query("cigar_rle", f"""WITH {RECORDS}, t AS (SELECT read_id, unnest({TOKENS.format(2)}) AS op, CAST(unnest({TOKENS.format(1)}) AS BIGINT) AS n, generate_subscripts({TOKENS.format(1)}, 1) AS i FROM records),
 marked AS (SELECT *, CASE WHEN op = lag(op) OVER (PARTITION BY read_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM t), runs AS (SELECT read_id, op, n, sum(fresh) OVER (PARTITION BY read_id ORDER BY i) AS r FROM marked),
 merged AS (SELECT read_id, r, any_value(op) AS op, sum(n) AS n FROM runs GROUP BY read_id, r),
 joined AS (SELECT read_id, string_agg(op, '' ORDER BY r) AS ops, string_agg(CAST(n AS VARCHAR), ',' ORDER BY r) AS lens FROM merged GROUP BY read_id)
 SELECT records.read_id, coalesce(CASE WHEN ops LIKE 'S%' THEN '' ELSE 'S' END || ops || CASE WHEN ops LIKE '%S' THEN '' ELSE 'S' END, '') AS ops,
  coalesce(CASE WHEN ops LIKE 'S%' THEN '' ELSE '0,' END || lens || CASE WHEN ops LIKE '%S' THEN '' ELSE ',0' END, '') AS lens FROM records LEFT JOIN joined USING (read_id)""")
def cigar_rle(spark, sf_dir):
    r = views.records(spark, sf_dir).withColumn("r", cg.runs(F.col("cigar")))
    return r.select("read_id", cg.shape(F.col("r")).alias("ops"), F.array_join(F.transform("r", lambda x: x["len"].cast("string")), ",").alias("lens"))


@query("sam_xg_filter", f"WITH {RECORDS} SELECT read_id, xg FROM records WHERE coalesce(xg, 'XG:i:0') IN ('XG:i:0', 'XG:i:1')")
def sam_xg_filter(spark, sf_dir):
    return views.records(spark, sf_dir).where(rd.accepted_tag(F.col("xg"))).select("read_id", "xg")


@query("sam_gapped_filter", f"WITH {RECORDS} SELECT read_id, cigar FROM records WHERE {GAPPED}")
def sam_gapped_filter(spark, sf_dir):
    return views.records(spark, sf_dir).where(cg.is_gapped(F.col("cigar"))).select("read_id", "cigar")


@query("arm_coordinates", f"WITH {ARMS} SELECT read_id, l_start, CAST(l_stop AS BIGINT) AS l_stop, CAST(r_start AS BIGINT) AS r_start, CAST(r_stop AS BIGINT) AS r_stop FROM arms")
def arm_coordinates(spark, sf_dir):
    return rd.with_arms(views.records(spark, sf_dir)).select("read_id", "l_start", "l_stop", "r_start", "r_stop")


@query("arm_sequences", f"WITH {ARMS} SELECT read_id, l_seq, r_seq FROM arms")
def arm_sequences(spark, sf_dir):
    return rd.with_arms(views.records(spark, sf_dir)).select("read_id", "l_seq", "r_seq")


@query("gene_first_wins_dedupe", f"WITH {GENES} SELECT region, gene, g_start, g_stop, gene_ord FROM genes")
def gene_first_wins_dedupe(spark, sf_dir):
    return files.first_genes(views.gene_rows(spark, sf_dir))


_LAST = "(SELECT r.read_id, arg_max(gene, gene_ord) AS gene FROM reads AS r JOIN genes AS g ON r.region = g.region AND r.{0}_start BETWEEN g_start AND g_stop GROUP BY r.read_id)"


@query("gene_assign_last_wins", f"WITH {READS}, {GENES} SELECT reads.read_id, l.gene AS l_hit, r.gene AS r_hit FROM reads LEFT JOIN {_LAST.format('l')} AS l USING (read_id) LEFT JOIN {_LAST.format('r')} AS r USING (read_id)")
def gene_assign_last_wins(spark, sf_dir):
    genes = files.first_genes(views.gene_rows(spark, sf_dir))
    r = views.arms(spark, sf_dir).select("read_ord", "read_id", "region", "l_start", "r_start")
    for s in "lr":
        r = last_containing(r, f"{s}_start", genes, f"{s}_hit")
    return r.select("read_id", "l_hit", "r_hit")


@query("stem_gene_lookup", f"WITH {READS}, {GENES}, hit AS (SELECT r.read_id, arg_min(gene, gene_ord) AS gene FROM reads AS r JOIN genes AS g ON r.region = g.region AND r.l_start BETWEEN g_start AND g_stop AND r.l_start + 4 BETWEEN g_start AND g_stop GROUP BY r.read_id) SELECT read_id AS stem_ix, gene FROM reads LEFT JOIN hit USING (read_id)")
def stem_gene_lookup(spark, sf_dir):
    genes = files.first_genes(views.gene_rows(spark, sf_dir))
    st = views.arms(spark, sf_dir).select(F.col("read_id").alias("stem_ix"), "region", "l_start", (F.col("l_start") + 4).alias("r_start"))
    return validation.stem_gene(st, genes).select("stem_ix", "gene")


@query("gene_pairs_distinct", f"WITH {READS} SELECT DISTINCT region, l_gene, r_gene FROM reads")
def gene_pairs_distinct(spark, sf_dir):
    return views.arms(spark, sf_dir).select("region", "l_gene", "r_gene").distinct()


@query("reads_per_pair", f"WITH {READS} SELECT l_gene, r_gene, count(*) AS n FROM reads GROUP BY ALL")
def reads_per_pair(spark, sf_dir):
    return views.arms(spark, sf_dir).groupBy("l_gene", "r_gene").agg(F.count("*").alias("n"))


@query("pair_restrict", f"WITH {READS}, one AS (SELECT min(l_gene) AS l, min(r_gene) AS r FROM reads) SELECT read_id, l_start, r_stop FROM reads, one WHERE l_gene = l AND r_gene = r")
def pair_restrict(spark, sf_dir):
    r = views.arms(spark, sf_dir)
    first = r.agg(F.min("l_gene").alias("l"), F.min("r_gene").alias("r")).first()
    return rd.restrict(r, first["l"], first["r"]).select("read_id", "l_start", "r_stop")


@query("read_dedupe_last_wins", f"WITH {RECORDS} SELECT qname AS read_id, min(file_line) AS read_ord, arg_max(pos, file_line) AS pos, arg_max(cigar, file_line) AS cigar FROM records GROUP BY qname")
def read_dedupe_last_wins(spark, sf_dir):
    r = views.records(spark, sf_dir).select(F.col("qname").alias("read_id"), F.col("file_line").alias("read_ord"), "pos", "cigar")
    return rd.last_of_each(r).select("read_id", "read_ord", "pos", "cigar")


@query("line_outcomes", f"""WITH {ARMS}, {GENES}, shaped_right AS (SELECT read_id, EXISTS (SELECT 1 FROM genes WHERE l_start BETWEEN g_start AND g_stop) AND EXISTS (SELECT 1 FROM genes WHERE r_start BETWEEN g_start AND g_stop) AS placed FROM arms),
 told AS (SELECT CASE WHEN coalesce(xg, 'XG:i:0') NOT IN ('XG:i:0', 'XG:i:1') THEN 'other tag' WHEN cigar = '*' THEN 'no cigar' WHEN NOT {GAPPED} THEN 'other shape' WHEN placed THEN 'read' ELSE 'no gene' END AS outcome FROM records LEFT JOIN shaped_right USING (read_id))
 SELECT outcome, count(*) AS n FROM told GROUP BY outcome""")
def line_outcomes(spark, sf_dir):
    return rd.outcomes(views.records(spark, sf_dir), files.first_genes(views.gene_rows(spark, sf_dir)))


@query("fasta_records", "SELECT CAST(doc_id AS VARCHAR) AS region, sha256(regexp_replace(regexp_replace(text, '[ \\t\\r]+(\\n|$)', '\\1', 'g'), '\\n+', '', 'g')) AS seq_sha256 FROM documents WHERE length(text) > 0")
def fasta_records(spark, sf_dir):
    """Documents as sequence records: the id as header, the text's lines as sequence lines."""
    d = views.table(spark, sf_dir, "documents").where(F.length("text") > 0)
    r = files.fasta_records(d.select(F.col("doc_id").alias("ord"), F.concat(F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("value")))
    return r.select("region", F.sha2(F.col("seq").cast("binary"), 256).alias("seq_sha256"))


# --- chimeric records --------------------------------------------------------------------------------------------------------

CHIMERIC = f"""{READS}, c AS (SELECT *, l_stop - l_start + 1 AS n_l, r_stop - r_start + 1 AS n_r, read_id % 3 AS x, CASE WHEN read_id % 4 = 0 THEN l_start + 5 ELSE r_start END AS back FROM reads),
 usable AS (SELECT *, back - l_start - n_l - x AS n FROM c WHERE read_id % 13 <> 0 AND read_id % 11 <> 0 AND read_id % 19 <> 0),
 merged AS (SELECT 'c' || read_id AS qname, l_start + 1 AS pos, n, CASE WHEN x = 0 THEN n_l || 'M' || abs(n) || CASE WHEN n < 0 THEN 'I' ELSE 'N' END || n_r || 'M' ELSE n_l || 'M' || x || 'X' || abs(n) || 'I' || n_r || 'M' END AS cigar,
  substr(repeat('ACGTTGCAAC', 12), 1, 60) || substr(substr(repeat('ACGTTGCAAC', 12), 1, 60), CAST(n_l + x + 1 AS INTEGER), CAST(n_r AS INTEGER)) AS seq,
  CAST(round_even((read_id % 50 + read_id % 31) / 2, 0) AS BIGINT) AS score, n_l + n_r AS md FROM usable)"""


@query("chimeric_pairs", f"WITH {CHIMERIC} SELECT qname FROM merged")
def chimeric_pairs(spark, sf_dir):
    return chimeric.pairs(views.chimeric(spark, sf_dir)).select("qname")


@query("chimeric_cigar", f"WITH {CHIMERIC} SELECT qname, pos, n, cigar, seq, score, md FROM merged")
def chimeric_cigar(spark, sf_dir):
    return chimeric.merged(views.chimeric(spark, sf_dir)).select("qname", "pos", "n", "cigar", "seq", "score", "md")


@query("aligned_union_chimeric", f"WITH {CHIMERIC}, recs AS (SELECT 'q' || read_id AS qname, l_start + 1 AS pos FROM reads) SELECT 'XG:i:0' AS xg, qname, pos FROM recs UNION ALL SELECT 'XG:i:1', qname, pos FROM merged")
def aligned_union_chimeric(spark, sf_dir):
    aligned = views.arms(spark, sf_dir).select(F.lit("XG:i:0").alias("xg"), F.concat(F.lit("q"), F.col("read_id").cast("string")).alias("qname"), (F.col("l_start") + 1).alias("pos"))
    parsed = files.sam_fields(chimeric.lines(views.chimeric(spark, sf_dir)).select("value"))
    return aligned.unionByName(parsed.select("xg", "qname", "pos"))


# --- the overlap graph -------------------------------------------------------------------------------------------------------

_R = "round(ratio_l, 6) AS ratio_l, round(ratio_r, 6) AS ratio_r"


@query("overlap_ratios", f"WITH {PAIRS} SELECT l_gene, r_gene, src, dst, {_R} FROM pairs")
def overlap_ratios(spark, sf_dir):
    return graph.overlapping_pairs(views.arms(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("ratio_l", "ratio_r")})


def _edges(t: float) -> Query:
    def run(spark, sf_dir):
        return graph.edges(views.arms(spark, sf_dir), t).select("src", "dst", F.round("weight", 6).alias("weight"))

    return query(f"overlap_edges_t0{int(t * 10)}", f"WITH {EDGES.format(t)} SELECT src, dst, round(weight, 6) AS weight FROM edges")(run)


_edges(0.5)
_edges(0.1)


@query("node_degrees", f"WITH {EDGES.format(0.5)}, ends AS (SELECT src AS read_id, weight FROM edges UNION ALL SELECT dst, weight FROM edges) SELECT read_id, count(*) AS degree, round(sum(weight), 6) AS weighted_degree FROM ends GROUP BY read_id")
def node_degrees(spark, sf_dir):
    return graph.degrees(graph.edges(views.arms(spark, sf_dir), 0.5)).withColumn("weighted_degree", F.round("weighted_degree", 6))


@query("connected_components", f"{WITH}{COMPONENTS} SELECT read_id, component FROM comp")
def connected_components(spark, sf_dir):
    r = views.arms(spark, sf_dir)
    return components.components(r, graph.edges(r, 0.5))


@query("cliques_dg")
def cliques_dg(spark, sf_dir):
    return graph.clustered(views.arms(spark, sf_dir), 0.1, "cliques")


@query("spectral_dg")
def spectral_dg(spark, sf_dir):
    return graph.clustered(views.arms(spark, sf_dir), 0.5)


@query("component_spectra")
def component_spectra(spark, sf_dir):
    r = views.arms(spark, sf_dir)
    components.ensure_checkpoints(r)
    rows = graph.quotient(r).checkpoint()
    edge = graph.edges(rows, 0.5).checkpoint()
    return graph.spectra(graph.with_components(rows, edge), edge).withColumn("eigenvalue", F.round("eigenvalue", 6))


@query("dg_offsets", f"{WITH}{COMPONENTS}, each AS (SELECT l_gene, r_gene, component, min(read_ord) AS o, count(*) % 3 + 1 AS k FROM reads JOIN comp USING (read_id) GROUP BY ALL) SELECT l_gene, r_gene, component, CAST(sum(k) OVER (PARTITION BY l_gene, r_gene ORDER BY o, component) - k AS BIGINT) AS dg FROM each")
def dg_offsets(spark, sf_dir):
    """Offsets of components that have as many clusters as their size modulo 3, and one more."""
    r = views.arms(spark, sf_dir)
    placed = graph.with_components(r, graph.edges(r, 0.5))
    each = placed.groupBy("l_gene", "r_gene", "component").agg(F.min("read_ord").alias("first_ord"), (F.count("*") % 3 + 1).cast("int").alias("k"), F.min("read_id").alias("read_id"))
    return graph.numbered(each.withColumn("label", F.lit(0))).select("l_gene", "r_gene", "component", "dg")


@query("eigengap_prefix_median", "WITH g AS (SELECT s_nationkey, s_suppkey, s_acctbal - lag(s_acctbal) OVER w AS gap, lag(s_suppkey) OVER w AS p FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)) SELECT s_nationkey, s_suppkey, round(gap, 4) AS gap, round(median(gap) OVER (PARTITION BY s_nationkey ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS prior FROM (SELECT g.*, row_number() OVER (PARTITION BY g.s_nationkey ORDER BY s.s_acctbal, g.s_suppkey) AS row FROM g JOIN supplier AS s USING (s_suppkey))")
def eigengap_prefix_median(spark, sf_dir):
    """Gaps of an ordered column and the median of the gaps before, the window form of choosing a number of clusters."""
    order = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    g = views.table(spark, sf_dir, "supplier").withColumn("gap", F.col("s_acctbal") - F.lag("s_acctbal").over(order))
    prior = F.percentile("gap", F.lit(0.5)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return g.select("s_nationkey", "s_suppkey", F.round("gap", 4).alias("gap"), F.round(prior, 4).alias("prior"))


# --- duplex groups -----------------------------------------------------------------------------------------------------------


@query("dg_filter", f"{WITH}{MEMBERS} SELECT l_gene, r_gene, dg, num_reads, n_seq FROM valid")
def dg_filter(spark, sf_dir):
    m = _members(spark, sf_dir)
    return m.groupBy("l_gene", "r_gene", "dg").agg(F.count("*").alias("num_reads"), F.count_distinct(F.concat("l_seq", "r_seq")).alias("n_seq"))


@query("dg_medians", f"{WITH}{MEDIANS} SELECT dg, l_start, l_stop, r_start, r_stop FROM medians")
def dg_medians(spark, sf_dir):
    return groups.medians(_members(spark, sf_dir)).select("dg", "l_start", "l_stop", "r_start", "r_stop")


@query("dg_extent", f"{WITH}{MEDIANS} SELECT dg, num_reads, ext_min, ext_max FROM medians")
def dg_extent(spark, sf_dir):
    return groups.medians(_members(spark, sf_dir)).select("dg", "num_reads", "ext_min", "ext_max")


@query("dg_coverage", f"{WITH}{COVERAGE} SELECT l_gene, r_gene, dg, num_reads, n_l, n_r, round(coverage, 6) AS coverage FROM covered")
def dg_coverage(spark, sf_dir):
    m = _members(spark, sf_dir)
    return groups.coverage(groups.medians(m), m).select("l_gene", "r_gene", "dg", "num_reads", "n_l", "n_r", F.round("coverage", 6).alias("coverage"))


_FIT = """, placed AS (SELECT l_gene, r_gene, dg, ext_min, ext_max, row_number() OVER (PARTITION BY l_gene, r_gene ORDER BY dg) AS k FROM medians),
fit AS (
  SELECT l_gene, r_gene, dg, ext_min, ext_max, k, CAST(0 AS BIGINT) AS ng, [{'c': CAST(0 AS BIGINT), 'a': ext_min, 'b': ext_max}] AS held FROM placed WHERE k = 1
  UNION ALL SELECT l_gene, r_gene, dg, ext_min, ext_max, k, ng, list_append(held, {'c': ng, 'a': ext_min, 'b': ext_max}) FROM (
    SELECT p.*, held, list_min(list_filter(range(0, len(held) + 1), lambda c: len(list_filter(held, lambda h: h.c = c AND least(h.b, p.ext_max) - greatest(h.a, p.ext_min) > 0)) = 0)) AS ng
    FROM fit JOIN placed AS p ON p.l_gene = fit.l_gene AND p.r_gene = fit.r_gene AND p.k = fit.k + 1))"""


@query("ng_first_fit", f"{WITH}{MEDIANS}{_FIT} SELECT l_gene, r_gene, dg, ext_min, ext_max, CAST(ng AS INTEGER) AS ng FROM fit")
def ng_first_fit(spark, sf_dir):
    return groups.colours(groups.medians(_members(spark, sf_dir))).select("l_gene", "r_gene", "dg", "ext_min", "ext_max", "ng")


@query("nonoverlap_reads", f"WITH {READS}, members AS (SELECT *, l_start // 60 AS dg FROM reads) SELECT l_gene, r_gene, dg, read_id FROM members AS a WHERE EXISTS (SELECT 1 FROM members AS b WHERE a.l_gene = b.l_gene AND a.r_gene = b.r_gene AND a.dg = b.dg AND ((a.l_start > b.l_stop AND a.r_start > b.r_stop) OR (b.l_start > a.l_stop AND b.r_start > a.r_stop)))")
def nonoverlap_reads(spark, sf_dir):
    """Reads that don't overlap another of their group, groups being stretches of 60 bases."""
    return groups.non_overlapping(views.arms(spark, sf_dir).withColumn("dg", F.expr("l_start div 60")))


@query("dg_bed", f"{WITH}{COVERAGE} SELECT dg, concat_ws(chr(9), 'chr1', l_start + 1, r_stop + 1, 'Group_' || dg || '_' || printf('%.16f', coverage), num_reads, '-', l_start + 1, l_start + 1, '0,0,0', '2', (l_stop - l_start + 1) || ',' || (r_stop - r_start + 1), '0,' || (r_start - l_start)) AS line FROM covered")
def dg_bed(spark, sf_dir):
    """Lines of the group table, whole."""
    m = _members(spark, sf_dir)
    lines = sinks.group_bed(groups.coverage(groups.medians(m), m).withColumn("region", F.lit("chr1")))
    return lines.select("dg", F.col("value").alias("line"))


@query("annotated_sam", f"{WITH}{MEDIANS}{_FIT} SELECT m.read_id AS file_line, 'q' || m.read_id || chr(9) || m.l_start || chr(9) || 'DG:i:' || m.dg || chr(9) || 'NG:i:' || fit.ng AS line FROM members AS m JOIN fit ON m.dg = fit.dg")
def annotated_sam(spark, sf_dir):
    """Lines of reads in surviving groups with their tags."""
    m = _members(spark, sf_dir)
    sam = views.arms(spark, sf_dir).select(F.col("read_ord").alias("file_line"), F.lit(False).alias("is_header"), F.col("read_id").alias("qname"), F.concat_ws("\t", F.concat(F.lit("q"), F.col("read_id").cast("string")), F.col("l_start").cast("string")).alias("value"))
    lines = sinks.annotated(sam, groups.colours(groups.medians(m)), m.select("l_gene", "r_gene", "read_id", "dg"))
    return lines.select("file_line", F.col("value").alias("line"))


# --- stem groups -------------------------------------------------------------------------------------------------------------


@query("sg_cutoffs_p10_p90", f"{WITH}{CUTOFFS} SELECT l_gene, r_gene, ptile, round(cutoff, 6) AS cutoff FROM cuts")
def sg_cutoffs(spark, sf_dir):
    return stems.cutoffs(_members(spark, sf_dir)).withColumn("cutoff", F.round("cutoff", 6))


@query("sg_reads", f"{WITH}{CUTOFFS} SELECT ptile, dg, read_id FROM chosen")
def sg_reads(spark, sf_dir):
    return _chosen(_members(spark, sf_dir)).select("ptile", "dg", "read_id")


@query("sg_envelope", f"{WITH}{CUTOFFS} SELECT ptile, dg, num_reads, l_start, l_stop, r_start, r_stop FROM envelopes")
def sg_envelope(spark, sf_dir):
    return stems.envelopes(_chosen(_members(spark, sf_dir))).select("ptile", "dg", "num_reads", "l_start", "l_stop", "r_start", "r_stop")


_ENDS = ("l_start", "l_stop", "r_start", "r_stop")
_SPREAD = ", ".join(f"min({c}) + 1 AS {c}_min, max({c}) + 1 AS {c}_max, round(stddev_pop({c}), 6) AS {c}_std" for c in _ENDS)


@query("sg_edge_stats", f"{WITH}{CUTOFFS} SELECT ptile, dg, count(*) AS num_reads, {_SPREAD} FROM chosen GROUP BY ptile, dg")
def sg_edge_stats(spark, sf_dir):
    s = stems.edge_stats(_chosen(_members(spark, sf_dir))).drop("l_gene", "r_gene")
    return s.withColumns({f"{c}_std": F.round(f"{c}_std", 6) for c in _ENDS})


@query("sg_aux_left_join", f"{WITH}{CUTOFFS}, own AS (SELECT ptile, dg, count(*) AS n, min(l_start) + 1 AS a, max(r_stop) + 1 AS b FROM chosen GROUP BY ptile, dg), every AS (SELECT valid.dg, ptile FROM valid, (SELECT unnest([{', '.join(map(str, stems.PERCENTILES))}]) AS ptile)) SELECT v.ptile, v.dg, coalesce(n, 0) AS num_reads, coalesce(a, 0) AS l_min, coalesce(b, 0) AS r_max FROM every AS v LEFT JOIN own ON v.dg = own.dg AND v.ptile = own.ptile")
def sg_aux_left_join(spark, sf_dir):
    m = _members(spark, sf_dir)
    spread = stems.edge_stats(_chosen(m))
    every = m.select("l_gene", "r_gene", "dg").distinct().select("*", F.explode(F.array(*map(F.lit, stems.PERCENTILES))).alias("ptile"))
    joined = every.join(spread, ["l_gene", "r_gene", "ptile", "dg"], "left")
    return joined.select("ptile", "dg", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(n) for c, n in (("num_reads", "num_reads"), ("l_start_min", "l_min"), ("r_stop_max", "r_max"))])


_AUX = ", ".join(f"min({c}) + 1 || ',' || (max({c}) + 1) || ',' || round(stddev_pop({c}), 4) AS e{i}" for i, c in enumerate(_ENDS))


@query("sg_aux_lines", f"{WITH}{CUTOFFS}, own AS (SELECT ptile, dg, count(*) AS n, {_AUX} FROM chosen WHERE dg % 3 <> 0 GROUP BY ptile, dg), every AS (SELECT v.dg, p.ptile FROM valid AS v JOIN (SELECT DISTINCT l_gene, r_gene, ptile FROM own JOIN valid USING (dg)) AS p ON v.l_gene = p.l_gene AND v.r_gene = p.r_gene) SELECT v.ptile, v.dg, concat_ws(chr(9), 'Group_' || v.dg, coalesce(n, 0), CASE WHEN n IS NULL THEN '0,0,0' ELSE (v.dg % 5) || ',' || (v.dg % 7) || ',' || (v.dg % 11) END, {', '.join(f"coalesce(e{i}, '0,0,0')" for i in range(4))}) AS line FROM every AS v LEFT JOIN own ON v.dg = own.dg AND v.ptile = own.ptile")
def sg_aux_lines(spark, sf_dir):
    """Lines of the auxiliary table, whole; groups whose number is no multiple of 3 have stems, with numbers of crosslinks that follow from it, and deviations are rounded."""
    m = _members(spark, sf_dir)
    spread = stems.edge_stats(_chosen(m)).where("dg % 3 <> 0")
    spread = spread.withColumns({f"{c}_std": F.round(f"{c}_std", 4) for c in _ENDS}).checkpoint()
    own = spread.select("l_gene", "r_gene", "ptile", "dg", (F.col("dg") % 5).alias("uu"), (F.col("dg") % 7).alias("uc"), (F.col("dg") % 11).alias("n_bp"))
    lines = sinks.aux_table(m.select("l_gene", "r_gene", "dg").distinct(), own, spread)
    return lines.select("ptile", "dg", F.col("value").alias("line"))


@query("sg_arc", f"{WITH}{CUTOFFS} SELECT ptile, dg, concat_ws(chr(9), 'chr1', (l_start + l_stop) // 2 + 1, (r_start + r_stop) // 2 + 1, dg) AS line FROM envelopes")
def sg_arc(spark, sf_dir):
    e = stems.envelopes(_chosen(_members(spark, sf_dir))).withColumn("region", F.lit("chr1"))
    return sinks.arc_bed(e).select("ptile", "dg", F.col("value").alias("line"))


def _patterned(spark, sf_dir) -> DataFrame:
    """Reads as stems under a structure that follows from their lengths: the first k bases of each arm, alternating in strength, are open or closed."""
    r = views.arms(spark, sf_dir).withColumns({"seq_start": F.col("l_start"), "seq": views.bases("l_start", "r_stop + 1")})
    n_l, n_r = F.col("l_stop") - F.col("l_start") + 1, F.col("r_stop") - F.col("r_start") + 1
    k = (F.col("read_id") % 9 + 2).cast("int")
    left = F.concat(F.lit("."), F.substring(F.lit("(((({(((((((((("), 1, 15), F.lit(""))
    left = F.rpad(F.substr(left, F.lit(1), k), n_l.cast("int"), F.lit("."))
    right = F.lpad(F.substr(F.lit("))}))))))))))))"), F.lit(1), k), n_r.cast("int"), F.lit("."))
    return r.select(F.col("read_id").alias("dg"), F.lit("x").alias("l_gene"), F.lit("y").alias("r_gene"), F.lit(50).alias("ptile"), "region", "l_start", "r_start", "seq_start", "seq", F.concat(left, right).alias("structure"), n_l.alias("cut"))


_BASE = "substr('ACGT', CAST((7 * ({0}) + (({0}) * ({0})) // 3) % 4 + 1 AS INTEGER), 1)"
_STEM = f"""WITH {READS}, s AS (
 SELECT read_id AS dg, l_start, r_start, l_stop - l_start + 1 AS cut, rpad(substr('.(((({{((((((((((', 1, CAST(read_id % 9 + 2 AS INTEGER)), CAST(l_stop - l_start + 1 AS INTEGER), '.') AS ls,
  lpad(substr('))}}))))))))))))', 1, CAST(read_id % 9 + 2 AS INTEGER)), CAST(r_stop - r_start + 1 AS INTEGER), '.') AS rs FROM reads),
 idx AS (SELECT dg, list_transform(list_filter(range(length(ls)), lambda i: substr(ls, CAST(i + 1 AS INTEGER), 1) IN ('(', '{{')), lambda i: i + l_start) AS lefts,
  list_reverse(list_transform(list_filter(range(length(rs)), lambda i: substr(rs, CAST(i + 1 AS INTEGER), 1) IN (')', '}}')), lambda i: i + r_start)) AS rights FROM s),
 bp AS (SELECT dg, len(lefts) AS n_bp, unnest(lefts[1:least(len(lefts), len(rights))]) AS l, unnest(rights[1:least(len(lefts), len(rights))]) AS r FROM idx)"""


@query("sg_bp", _STEM + " SELECT dg, concat_ws(chr(9), 'chr1', l + 1, r + 1, dg) AS line FROM bp")
def sg_bp(spark, sf_dir):
    return sinks.pair_bed(stems.stem_info(_patterned(spark, sf_dir))).select("dg", F.col("value").alias("line"))


@query("stem_info_crosslinks", _STEM + f""", m AS (SELECT dg, n_bp, CASE WHEN l < max(l) OVER (PARTITION BY dg) THEN {_BASE.format("l")} || {_BASE.format("r - 1")} ELSE '' END AS p,
  CASE WHEN l > min(l) OVER (PARTITION BY dg) THEN {_BASE.format("l")} || {_BASE.format("r + 1")} ELSE '' END AS q FROM bp)
 SELECT dg, CAST(any_value(n_bp) AS BIGINT) AS n_bp, CAST(sum((p = 'TT')::INT + (q = 'TT')::INT) AS BIGINT) AS uu, CAST(sum((p IN ('TC', 'CT'))::INT + (q IN ('TC', 'CT'))::INT) AS BIGINT) AS uc FROM m GROUP BY dg""")
def stem_info_crosslinks(spark, sf_dir):
    return stems.stem_info(_patterned(spark, sf_dir)).select("dg", "n_bp", "uu", "uc")


@query("fold_energy")
def fold_energy(spark, sf_dir):
    e = stems.envelopes(_chosen(_members(spark, sf_dir))).withColumn("region", F.lit("chr1"))
    return stems.folded(stems.sequences(e, views.regions(spark))).select("ptile", "dg", "structure", F.round("energy", 6).alias("energy"))


# --- validation --------------------------------------------------------------------------------------------------------------

_GOLD = "WITH p AS (SELECT o_orderkey AS line, o_custkey // 40 AS l, o_orderkey % 97 AS r FROM orders)"


@query("gold_stem_islands", _GOLD + ", m AS (SELECT *, CASE WHEN abs(l - lag(l) OVER (ORDER BY line)) > 3 AND abs(r - lag(r) OVER (ORDER BY line)) > 3 THEN 1 ELSE 0 END AS j FROM p), s AS (SELECT *, sum(j) OVER (ORDER BY line) AS stem_ix FROM m) SELECT CAST(stem_ix AS BIGINT) AS stem_ix, arg_min(l, line) - 1 AS l_start, arg_max(l, line) - 1 AS l_stop, min(r) - 1 AS r_start, max(r) - 1 AS r_stop FROM s GROUP BY stem_ix")
def gold_stem_islands(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return validation.gold_stems(o.select(F.col("o_orderkey").alias("line"), F.expr("o_custkey div 40").alias("l"), (F.col("o_orderkey") % 97).alias("r")))


@query("shift_candidates", f"WITH {READS}, s AS (SELECT read_id AS stem_ix, l_start, r_stop, l_start - 3 AS g_start, r_stop + read_id % 5 AS g_stop FROM reads), c AS (SELECT stem_ix, l_start, unnest(range(g_start, g_stop - (r_stop - l_start))) AS start FROM s) SELECT stem_ix, start FROM c WHERE start <> l_start")
def shift_candidates(spark, sf_dir):
    s = views.arms(spark, sf_dir).select(F.col("read_id").alias("stem_ix"), "l_start", "r_stop", (F.col("l_start") - 3).alias("g_start"), (F.col("r_stop") + F.col("read_id") % 5).alias("g_stop"))
    return validation.shift_candidates(s)


def _placed_envelopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Envelopes of the stem groups at all percentiles, written once, and a region that holds them all."""
    m = _members(spark, sf_dir).select(*stems.PAIR, "dg", *_ENDS).checkpoint()
    e = stems.envelopes(_chosen(m)).withColumn("region", F.lit("chr1")).checkpoint()
    reach = e.agg(F.max("r_stop")).first()[0] or 0
    return e, views.regions(spark, max(views.REGION_LENGTH, reach + 1))


@query("shuffle_null")
def shuffle_null(spark, sf_dir):
    """Null energies of the stem groups at all percentiles; a group whose arms are the same at several is shuffled once."""
    e, regions = _placed_envelopes(spark, sf_dir)
    s = stems.sequences(e, regions).groupBy("dg", "l_seq", "r_seq").agg(F.min("ptile").alias("first"), F.collect_set("ptile").alias("ptiles")).withColumn("stem_ix", F.col("dg") * 100 + F.col("first")).checkpoint()
    null = validation.shuffled(s.select("stem_ix", "l_seq", "r_seq"), 5).withColumn("energy", F.round("energy", 6))
    return s.select("stem_ix", "dg", F.explode("ptiles").alias("ptile")).join(null, "stem_ix").select("ptile", "dg", "rank", "energy")


@query("shift_null")
def shift_null(spark, sf_dir):
    """Energies of the stem groups at all percentiles, shifted within their gene pair's stretch."""
    e, regions = _placed_envelopes(spark, sf_dir)
    gene = e.groupBy("l_gene", "r_gene").agg(F.min("l_start").alias("g_start"), F.max("r_stop").alias("g_stop"))
    s = e.join(near(gene), ["l_gene", "r_gene"]).withColumn("stem_ix", F.col("dg") * 100 + F.col("ptile"))
    return validation.shifted(s.select("stem_ix", "region", "l_start", "l_stop", "r_start", "r_stop", "g_start", "g_stop"), regions, 3).withColumn("energy", F.round("energy", 6))


# --- end to end --------------------------------------------------------------------------------------------------------------


def _end_to_end(cluster: str) -> Query:
    def run(spark, sf_dir):
        found = pipeline.duplex_groups(views.reads(spark, sf_dir), pipeline.Config(cluster=cluster))
        return found["groups"].withColumn("coverage", F.round("coverage", 6))

    return query(f"pipeline_{cluster}")(run)


_end_to_end("cliques")
_end_to_end("spectral")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the duplex groups of all reads."""
    return QUERIES["dg_coverage"](spark, sf_dir)
