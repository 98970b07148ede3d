"""Queries use all rows of their tables, however far their keys and positions reach."""

from twinarm.plans import queries as main
from twinarm.plans import views


def base(i):
    return "ACGT"[(7 * i + i * i // 3) % 4]


def test_stems_at_any_position(spark, monkeypatch):
    events = spark.createDataFrame([(k, u, "a") for k, u in enumerate([5, 3990, 4000, 19_995, 50_000, 900_000])], "event_id bigint, user_id bigint, event_type string")
    monkeypatch.setattr(views, "table", lambda *_: events)
    pairs = {}
    for r in main.QUERIES["sg_bp"](spark, "").collect():
        pairs.setdefault(r["dg"], []).append(tuple(int(x) - 1 for x in r["line"].split("\t")[1:3]))
    assert sorted(pairs) == list(range(6)) and min(pairs[5])[0] > 4_500_000
    want = {}
    for k, p in pairs.items():
        lo, hi = min(p)[0], max(p)[0]
        met = [base(x) + base(y - 1) for x, y in p if x < hi] + [base(x) + base(y + 1) for x, y in p if x > lo]
        want[k] = (len(p), met.count("TT"), met.count("TC") + met.count("CT"))
    assert {r["dg"]: tuple(r)[1:] for r in main.QUERIES["stem_info_crosslinks"](spark, "").collect()} == want


def test_genes_of_all_rows(spark, monkeypatch):
    part = spark.createDataFrame([(k, k % 50) for k in (1, 2000, 2001, 20_000)], "p_partkey bigint, p_size int")
    monkeypatch.setattr(views, "table", lambda *_: part)
    assert sorted(r["line"] for r in views.gene_rows(spark, "").collect()) == [1, 2000, 2001, 20_000]


def twelfths(spark, monkeypatch, name, by):
    """A query over a few reads whose positions are moved by a multiple of 12, the period of the region."""
    events = spark.createDataFrame([(k, k % 7 + by, "ab"[k % 2]) for k in range(400)], "event_id bigint, user_id bigint, event_type string")
    monkeypatch.setattr(views, "table", lambda *_: events)
    return sorted(map(tuple, main.QUERIES[name](spark, "").collect()))


def test_shifts_at_any_position(spark, monkeypatch):
    near, far = (twelfths(spark, monkeypatch, "shift_null", by) for by in (0, 48_000))
    assert near == far and any(energy < 0 for *_, energy in near)


def test_shuffles_at_any_position(spark, monkeypatch):
    near, far = (twelfths(spark, monkeypatch, "shuffle_null", by) for by in (0, 48_000))
    assert near == far and any(energy < 0 for *_, energy in near)
