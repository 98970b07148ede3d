"""Streams of alignment lines."""

import random

import pytest

from twinarm.operators import graph
from twinarm.operators import reads as rd
from twinarm.sources import files
from twinarm.streaming import parse

COLUMNS = ["read_id", "l_gene", "r_gene", "region", "l_start", "l_stop", "r_start", "r_stop", "l_seq", "r_seq"]


def line(name, pos, cigar="20M60N20M"):
    return "\t".join([name, "0", "chr1", str(pos), "255", cigar, "*", "0", "0", "ACGTTGCAAC" * 5, "I" * 50])


@pytest.fixture
def genes(spark, tmp_path):
    rows = ["chr1\t1\t100\ta", "chr1\t90\t300\tb", "chr1\t250\t600\tc", "chr1\t280\t290\td"]
    (tmp_path / "genes.bed").write_text("".join(f"{x}\n" for x in rows))
    return files.read_genes(spark, str(tmp_path / "genes.bed"))


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_stream_equals_batch(spark, genes, tmp_path, seed):
    """Files out of order, reads that move between gene pairs, and batches that are run again: the pairs in the end are those of one run over all files."""
    rng = random.Random(seed)
    source, arriving, store = tmp_path / "in", tmp_path / "arriving", str(tmp_path / "store")
    source.mkdir()
    arriving.mkdir()
    for name in "abcd":
        body = [line(f"r{rng.randrange(25)}", rng.choice([5, 60, 95, 170, 200, 240, 285]), rng.choice(["20M60N20M", "20M150N20M", "40M"])) for _ in range(30)]
        (source / f"{name}.sam").write_text("@HD\n" + "".join(x + "\n" for x in body))
    pairs = {}

    def batch(new, number):
        for _ in range(2):
            rows, touched = parse.store_batch(new, number, store)
            found = rows.collect()
        for key in touched.collect():
            pairs.pop(tuple(key), None)
        for r in found:
            pairs.setdefault((r["l_gene"], r["r_gene"]), []).append(tuple(r[c] for c in COLUMNS))

    for name in rng.sample("abcd", 4):
        (arriving / f"{name}.sam").write_bytes((source / f"{name}.sam").read_bytes())
        parse.read_stream(spark, str(arriving), genes).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    want = rows_of(rd.parse(files.read_sam(spark, str(source)), genes))
    assert sorted(r for own in pairs.values() for r in own) == want and len({r[1:3] for r in want}) > 2


def test_clusters_by_batch(spark, genes, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text("@HD\n" + "\n".join(line(f"r{i}", 10 + i) for i in range(4)) + "\n")
    seen = []
    q = parse.cluster_batches(parse.read_stream(spark, str(tmp_path / "in"), genes), str(tmp_path / "store"), str(tmp_path / "state"), lambda r: graph.edges(r, 0.5), lambda e, touched, n: seen.append((e.count(), touched.count(), n)))
    q.trigger(availableNow=True).start().awaitTermination(120)
    assert seen == [(6, 1, 0)]
