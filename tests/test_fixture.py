"""A hand-sized run from files, with worked answers for every path."""

import pytest
from pyspark.sql import functions as F

from twinarm.functions import fold
from twinarm.operators import chimeric, graph, groups, stems, validation
from twinarm.operators import reads as rd
from twinarm.plans import cli, pipeline
from twinarm.sources import files, sinks

SEQ = "".join("ACGT"[(7 * i + i * i // 3) % 4] for i in range(300))
READS = [
    ("r01", 11, "20M60N22M", None), ("r02", 12, "20M60N22M", "0"), ("r03", 13, "21M58N20M", "1"), ("r04", 11, "5S10M2M8M60N22M", None), ("r05", 45, "18M70N18M", None),
    ("r06", 46, "18M70N19M", None), ("r07", 20, "42M", None), ("r08", 30, "10M1I9M60N20M", None), ("r09", 14, "20M60N20M", "2"), ("r10", 14, "5H20M60N20M", None),
    ("r11", 250, "12M20N12M", None), ("r12", 60, "16M50N16M", None), ("r13", 12, "20M90N22M", None), ("r14", 22, "19M60N22M", None), ("r15", 27, "16M61N20M", None),
    ("r16", 27, "*", None),
]


def line(name, flag, pos, cigar, seq, xg=None, score=10):
    fields = [name, str(flag), "chr1", str(pos), "255", cigar, "*", "0", "0", seq, "I" * len(seq)]
    if xg is not None:
        fields += ["NH:i:1", "HI:i:1", f"AS:i:{score}", "nM:i:0", "NM:i:0", "MD:Z:1", "jM", "jI", f"XG:i:{xg}"]
    return "\t".join(fields)


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    d = tmp_path_factory.mktemp("fixture")
    texts = {n: (SEQ[i : i + 60] if n != "r04" else SEQ[0:60]) for i, (n, *_) in enumerate(READS)}
    (d / "reads.sam").write_text("@HD\tVN:1.4\n" + "\n".join(line(n, 0, p, c, texts[n], x) for n, p, c, x in READS) + "\n")
    (d / "ref.fa").write_text(">chr1 some region\n" + "\n".join(SEQ[i : i + 70] for i in range(0, 300, 70)) + "\n>other\nACGT\n")
    (d / "genes.bed").write_text("chr1\t1\t100\tgA\nchr1\t101\t260\tgB\nchr1\t90\t120\tgC\nchr1\t1\t5\tgA\n")
    return d


@pytest.fixture(scope="module")
def reads(spark, paths):
    return rd.parse(files.read_sam(spark, str(paths / "reads.sam")), files.read_genes(spark, str(paths / "genes.bed"))).cache()


def test_sources(spark, paths):
    assert {r["region"]: r["seq"] for r in files.read_fasta(spark, str(paths / "ref.fa")).collect()} == {"chr1": SEQ, "other": "ACGT"}
    genes = files.read_genes(spark, str(paths / "genes.bed")).orderBy("gene_ord").collect()
    assert [(g["gene"], g["g_start"], g["g_stop"]) for g in genes] == [("gA", 0, 99), ("gB", 100, 259), ("gC", 89, 119)]


def test_accepted_reads(reads):
    got = {r["read_id"]: (r["l_start"], r["l_stop"], r["r_start"], r["r_stop"], r["l_gene"], r["r_gene"]) for r in reads.collect()}
    assert got == {
        "r01": (10, 29, 90, 111, "gA", "gC"), "r02": (11, 30, 91, 112, "gA", "gC"), "r03": (12, 32, 91, 110, "gA", "gC"), "r04": (10, 29, 90, 111, "gA", "gC"), "r05": (44, 61, 132, 149, "gA", "gB"),
        "r06": (45, 62, 133, 151, "gA", "gB"), "r12": (59, 74, 125, 140, "gA", "gB"), "r13": (11, 30, 121, 142, "gA", "gB"), "r14": (21, 39, 100, 121, "gA", "gC"), "r15": (26, 41, 103, 122, "gA", "gC"),
    }
    assert rd.single_region(reads) == "chr1"


def test_genes_by_bins_as_by_broadcast(spark, paths, reads):
    genes = files.read_genes(spark, str(paths / "genes.bed"))
    again = rd.parse(files.read_sam(spark, str(paths / "reads.sam")), genes, small_genes=False)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, reads.collect()))


def test_edges(reads):
    got = {(r["src"], r["dst"]): (round(r["ratio_l"], 6), round(r["ratio_r"], 6), round(r["weight"], 6)) for r in graph.edges(reads, 0.1).collect()}
    assert len(got) == 17 and got["r01", "r03"] == (0.782609, 0.909091, 1.6917) and got["r02", "r15"] == (0.16129, 0.3125, 0.47379) and got["r06", "r12"] == (0.133333, 0.296296, 0.42963)
    assert len(graph.edges(reads, 0.5).collect()) == 8


def test_cliques_and_colours(reads):
    found = pipeline.duplex_groups(reads, pipeline.Config(cluster="cliques", t_o=0.5))
    got = {(r["l_gene"], r["r_gene"], r["dg"]): r for r in found["groups"].collect()}
    a, b, c = got["gA", "gC", 0], got["gA", "gC", 1], got["gA", "gB", 0]
    assert [a[x] for x in ("l_start", "l_stop", "r_start", "r_stop", "num_reads", "n_l", "n_r", "ng", "ext_min", "ext_max")] == [10, 29, 90, 111, 4, 6, 6, 0, 10, 112]
    assert [b[x] for x in ("l_start", "l_stop", "r_start", "r_stop", "num_reads", "n_l", "n_r", "ng")] == [23, 40, 101, 121, 2, 6, 6, 1]
    assert a["coverage"] == pytest.approx(2 / 3) and b["coverage"] == pytest.approx(1 / 3) and c["coverage"] == 1.0
    assert [c[x] for x in ("l_start", "l_stop", "r_start", "r_stop")] == [44, 61, 132, 150]


def test_spectral(reads):
    edge = graph.edges(reads, 0.1)
    placed = graph.with_components(reads, edge)
    label = graph.spectral_groups(placed, edge, 5.0)
    assert label.where("r_gene = 'gC'").select("dg").distinct().count() == 1
    values = [r["eigenvalue"] for r in graph.spectra(placed, edge).where("component = 'r01'").orderBy("rank").collect()]
    assert values == pytest.approx([0, 0.648980, 1.109511, 1.613894, 1.685034, 1.716446], abs=1e-5)
    edge = graph.edges(reads, 0.5)
    placed = graph.with_components(reads, edge)
    k = graph.spectral_groups(placed, edge, 5.0).where("component = 'r01'").select("dg").distinct().count()
    assert k <= 2


def test_clique_leftover_has_no_group(reads):
    edge = graph.edges(reads, 0.1)
    got = {r["read_id"]: r["dg"] for r in graph.clique_groups(graph.with_components(reads, edge), edge).where("r_gene = 'gB'").collect()}
    assert got["r05"] == got["r06"] and "r12" not in got and got["r13"] != got["r05"]


def test_stem_groups(reads, spark):
    found = pipeline.duplex_groups(reads, pipeline.Config(cluster="cliques", t_o=0.5))
    cut = {r["ptile"]: r["cutoff"] for r in stems.cutoffs(found["members"]).where("r_gene = 'gC'").collect()}
    assert cut[10] == pytest.approx(16.3) and cut[50] == pytest.approx(20) and cut[90] == pytest.approx(20.9)
    e = {(r["r_gene"], r["ptile"], r["dg"]): r for r in stems.envelopes(stems.short_reads(found["members"], stems.cutoffs(found["members"]))).collect()}
    assert ("gC", 10, 1) not in e and [e["gC", 90, 1][x] for x in ("l_start", "l_stop", "r_start", "r_stop")] == [26, 41, 103, 122]
    assert [e["gB", 50, 0][x] for x in ("l_start", "l_stop", "r_start", "r_stop")] == [44, 61, 132, 149]


def test_stem_info(spark):
    one = spark.createDataFrame([(0, ".((({..})))", 6, 2, 12, "ATTCTTGGCCAATTCTCTGA")], "dg int, structure string, cut bigint, l_start bigint, r_start bigint, seq string")
    r = stems.stem_info(one).first()
    assert (r["uu"], r["uc"], r["lefts"], r["rights"]) == (2, 3, [3, 4, 5, 6], [16, 15, 14, 13])


def test_chimeric(spark):
    rows = [("c1", 11, "20M", 91, "20S22M", 60, "20M60N22M", 10, 11, 10), ("c2", 11, "20M3S", 91, "23S22M", 57, "20M3X57I22M", 11, 12, 12), ("c3", 41, "5S20M", 50, "25S15M", -11, "20M11I15M", 1, 2, 2), ("c4", 41, "5S20M2S", 50, "27S15M", -13, "20M2X13I15M", 4, 4, 4)]
    lines = [x for n, lp, lc, rp, rc, _, _, a, b, _ in rows for x in (line(n, 256, lp, lc, SEQ[:60], 0, a), line(n, 0, rp, rc, SEQ[:60], 0, b))] + [line("lone", 0, 5, "5S10M", SEQ[:60], 0)]
    df = files.sam_fields(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "file_line bigint, value string"))
    got = {r["qname"]: r for r in chimeric.merged(df).collect()}
    assert {n: (r["n"], r["cigar"], r["score"]) for n, r in got.items()} == {n: (k, c, s) for n, _, _, _, _, k, c, _, _, s in rows}
    assert got["c3"]["seq"] == SEQ[5:60] + SEQ[25:40]
    back = files.sam_fields(chimeric.lines(df).select("value"))
    assert back.where("xg = 'XG:i:1' and cigar = '20M60N22M'").count() == 1


def test_nulls_empty_tables_and_ties(spark, reads):
    none = reads.where("false")
    assert graph.edges(none, 0.5).count() == 0
    assert pipeline.duplex_groups(none, pipeline.Config())["groups"].count() == 0
    twice = reads.union(reads.withColumn("read_ord", F.col("read_ord") + 1000))
    assert rd.last_of_each(twice).count() == reads.count()
    with pytest.raises(ValueError):
        rd.single_region(none)
    with pytest.raises(ValueError):
        pipeline.Config(cluster="other")


def text(folder):
    return [x for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines()]


def test_run_writes_files(spark, paths, tmp_path, caplog):
    out = tmp_path / "out"
    with caplog.at_level("INFO", "twinarm"):
        found = pipeline.run(spark, str(paths / "reads.sam"), str(paths / "ref.fa"), str(paths / "genes.bed"), str(out), config=pipeline.Config(cluster="cliques", t_o=0.5))
    out, base = out / "reads_twinarm.cliques.t_o0.5", "output=" + sinks.output_name("reads", "gA", "gC", "cliques", 0.5)
    sam = text(out / f"{base}.sam")
    assert sam[0].startswith("@HD") and len(sam) == 7 and sam[1].endswith("DG:i:0\tNG:i:0") and [x.split("\t")[0] for x in sam[1:]] == ["r01", "r02", "r03", "r04", "r14", "r15"]
    bed = text(out / f"{base}_dg.bed")
    assert bed[0].split("\t")[:3] == ["chr1", "11", "112"] and bed[0].split("\t")[4] == "4" and len(bed[0].split("\t")) == 12
    aux = [p for p in out.iterdir() if p.name.endswith(".aux")]
    assert aux and all(text(p)[0] == sinks.AUX_HEADER for p in aux)
    rows = [x.split("\t") for x in text(out / f"{base}_sg_p90.aux")[1:]]
    assert [r[0] for r in rows] == ["Group_0", "Group_1"] and rows[0][1:] == ["0"] + ["0,0,0"] * 5 and rows[1][1] == "1" and rows[1][3] == "27,27,0.0"
    assert all(text(p)[0] == sinks.BP_TRACK for p in out.iterdir() if p.name.endswith("_arc.bed") or p.name.endswith("_bp.bed"))
    assert found["failed"].count() == 0
    assert {(r["l_gene"], r["r_gene"]): (r["n_reads"], r["n_groups"], r["dropped"]) for r in found["pairs"].collect()} == {("gA", "gC"): (6, 2, False), ("gA", "gB"): (4, 1, False)}
    assert "lines: 1 header, 1 other tag, 1 no cigar, 3 other shape, 1 no gene, 10 read" in caplog.text and "gA, gC: 6 reads, 2 duplex groups" in caplog.text


def test_dropped_pairs_are_told(spark, reads, caplog):
    """Two reads of one group that don't overlap."""
    apart = reads.where("read_id in ('r01', 'r06')").withColumns({"l_gene": F.lit("a"), "r_gene": F.lit("b"), "dg": F.lit(0)})
    failed = groups.non_overlapping(apart)
    report = pipeline.pair_report(apart, {"failed": failed, "groups": groups.without_failed_pairs(groups.medians(apart), failed)})
    with caplog.at_level("INFO", "twinarm"):
        pipeline.tell(report)
    assert [tuple(r) for r in report.collect()] == [("a", "b", 2, 0, 2, True)] and "2 of 2 reads" in caplog.text


def test_lines_of_several_files(spark, tmp_path):
    """Numbers are unique over files and rise with path and place."""
    for name in ("b x.sam", "a.sam", "c.sam"):
        (tmp_path / name).write_text("".join(f"{name[0]}{i}\n" for i in range(5)))
    got = files.numbered_lines(spark, str(tmp_path)).orderBy("file_line").collect()
    assert [r["value"] for r in got] == [f"{f}{i}" for f in "abc" for i in range(5)] and len({r["file_line"] for r in got}) == 15


def test_base_pairs_and_combined_lines(spark, tmp_path):
    (tmp_path / "gold.bp").write_text("track graphType=arc\nchr1\t11\t112\nchr1\t12\t111\n\nchr1\t60\t70\n")
    assert [(r["region"], r["l"], r["r"]) for r in files.read_base_pairs(spark, str(tmp_path / "gold.bp")).orderBy("line").collect()] == [("chr1", 11, 112), ("chr1", 12, 111), ("chr1", 60, 70)]
    (tmp_path / "reads.sam").write_text("@HD\tVN:1.4\n" + line("r1", 0, 5, "20M60N22M", "A" * 42) + "  \n")
    mates = [line(n, f, p, c, SEQ[:60], 0) for n in ("z9", "a1", "m5") for f, p, c in ((256, 11, "20M"), (0, 91, "20S22M"))]
    (tmp_path / "chimeric.sam").write_text("@HD\n" + "\n".join(mates) + "\n")
    merged = chimeric.lines(files.read_sam(spark, str(tmp_path / "chimeric.sam")).where("not is_header"))
    sinks.write_lines(sinks.combined(files.read_sam(spark, str(tmp_path / "reads.sam")), merged), str(tmp_path / "out"), ["part", "file_line"])
    got = text(tmp_path / "out")
    assert got[0] == "@HD\tVN:1.4" and got[1] == line("r1", 0, 5, "20M60N22M", "A" * 42) + "\tXG:i:0" and [x.split("\t")[0] for x in got[2:]] == ["z9", "a1", "m5"] and got[2].endswith("XG:i:1")


def test_command_line(spark, paths, tmp_path):
    """Without -out the outputs go beside the reads, into a folder of their own; nothing else there changes, and an earlier run is replaced."""
    for name in ("reads.sam", "ref.fa", "genes.bed"):
        (tmp_path / name).write_bytes((paths / name).read_bytes())
    (tmp_path / "other.sam").write_bytes((paths / "reads.sam").read_bytes())
    (tmp_path / "notes.txt").write_text("mine")
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir() if p.is_file()}
    options = ["-genes", "gA,gC", "-cluster", "cliques", "-t_o", "0.5"]
    for reads in ("reads.sam", "other.sam", "reads.sam"):
        cli.main([str(tmp_path / reads), str(tmp_path / "ref.fa"), str(tmp_path / "genes.bed"), *options])
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir() if p.is_file()} == before
    for base in ("reads", "other"):
        assert {p.name.split(".cliques")[0] for p in (tmp_path / f"{base}_twinarm.cliques.t_o0.5").iterdir() if p.name.startswith("output=")} == {f"output={base}_twinarm.ggA,gC"}
    folder = tmp_path / "reads_twinarm.cliques.t_o0.5"
    (folder / "thesis.txt").write_text("mine too")
    with pytest.raises(FileExistsError):
        cli.main([str(tmp_path / "reads.sam"), str(tmp_path / "ref.fa"), str(tmp_path / "genes.bed"), *options])
    assert (folder / "thesis.txt").read_text() == "mine too"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["reads.sam"])


def test_shifts(spark):
    stem = spark.createDataFrame([(1, "chr1", 10, 19, 40, 49, 0, 99), (2, "chr1", 10, 19, 40, 49, 10, 49)], "stem_ix long, region string, l_start long, l_stop long, r_start long, r_stop long, g_start long, g_stop long")
    regions = spark.createDataFrame([("chr1", SEQ)], "region string, seq string")
    got = validation.shifted(stem, regions, 100).collect()
    want = sorted((fold.duplex(SEQ[s : s + 10], SEQ[s + 30 : s + 40])[1] for s in range(0, 60) if s != 10), reverse=True)
    assert [r["stem_ix"] for r in got] == [1] * 59 and [r["energy"] for r in sorted(got, key=lambda r: r["rank"])] == pytest.approx(want)
    assert validation.shifted(stem, regions, 7).count() == 7
    starts = sorted(r["start"] for r in validation.shift_starts(stem.where("stem_ix = 1"), 1000).collect())
    assert starts == [s for s in range(0, 60) if s != 10] == sorted(r["start"] for r in validation.shift_candidates(stem).collect())


def test_shift_starts_are_uniform(spark):
    """Each start of a range is drawn about as often as the others; long genes cost no more than short ones."""
    assert sorted(validation.permuted(k, 37, (0, 5)) for k in range(37)) == list(range(37)) and validation.permuted(0, 1, (0, 0)) == 0
    one = (F.lit("chr1").alias("region"), F.lit(10).alias("l_start"), F.lit(19).alias("l_stop"), F.lit(20).alias("r_start"), F.lit(29).alias("r_stop"), F.lit(0).alias("g_start"))
    stems_ = spark.range(4000).select(F.col("id").alias("stem_ix"), *one, F.lit(41).alias("g_stop"))
    n = {r["start"]: r["n"] for r in validation.shift_starts(stems_, 3).groupBy("start").agg(F.count("*").alias("n")).collect()}
    assert set(n) == set(range(22)) - {10} and sum((x - 12000 / 21) ** 2 / (12000 / 21) for x in n.values()) < 45
    far = validation.shift_starts(stems_.limit(5).withColumn("g_stop", F.lit(3 * 10**9)), 4).collect()
    assert len(far) == 20 and max(r["start"] for r in far) > 10**8 and len({(r["stem_ix"], r["start"]) for r in far}) == 20


@pytest.mark.parametrize("small", [True, False])
def test_observed_counts(spark, paths, tmp_path, small):
    """What the parsing plan observes is what a pass for it alone counts, with either gene join; a file of headers and an empty one have counts too."""
    genes = files.read_genes(spark, str(paths / "genes.bed"))
    (tmp_path / "headers.sam").write_text("@HD\n@SQ\n")
    (tmp_path / "none.sam").write_text("")
    for path in (paths / "reads.sam", tmp_path / "headers.sam", tmp_path / "none.sam"):
        sam, seen = files.read_sam(spark, str(path)), rd.Seen()
        rd.parse(sam, genes, small, seen).checkpoint()
        assert {k: n for k, n in seen.counts().items() if n} == {r["outcome"]: r["n"] for r in rd.outcomes(sam, genes).collect()}


def test_genes_option(reads):
    assert rd.restrict(reads, "gA", "gB").count() == 4
    with pytest.raises(ValueError):
        rd.restrict(reads, "gB", "gA")
    assert groups.non_overlapping(reads.where("read_id in ('r01', 'r06')").withColumn("l_gene", F.lit("a")).withColumn("r_gene", F.lit("b")).withColumn("dg", F.lit(0))).count() == 2
