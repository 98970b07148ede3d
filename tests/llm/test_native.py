"""Chat formatting and decontamination: worked and hostile cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from twinarm.llm import chat, decontaminate, queries

EVENT = "conv_id bigint, seq bigint, message_id bigint, turn bigint, role string, kind string, text string, formatted string"


def folded(spark, rows):
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.fold_events(spark.createDataFrame([(*r, "clash") for r in rows], EVENT)).orderBy("conv_id", "turn", "first_seq").collect()]


def test_fold(spark):
    rows = [
        (1, 0, 10, 0, "user", "message", "hi"), (1, 1, 11, 1, "assistant", "delta", "he"), (1, 2, 11, 1, "assistant", "delta", "llo"),
        (1, 3, 10, 0, "user", "edit", "hey"), (1, 4, 12, 2, "user", "message", "later"), (1, 5, 11, 1, "assistant", "regenerate", None), (1, 6, 11, 1, "assistant", "delta", "new"), (1, 7, 13, 2, "user", "delta", "kept"),
        (2, 0, 20, 0, None, None, None), (None, 0, 30, 0, "user", "message", "no id"),
    ]
    assert folded(spark, rows) == [(None, 0, "user", "no id"), (1, 0, "user", "hey"), (1, 1, "assistant", "new"), (1, 2, "user", "kept"), (2, 0, "", "")]
    assert folded(spark, []) == []


def sequential(rows):
    """The log replayed event by event."""
    held = []
    for conv, seq, message, turn, role, kind, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[5] or "message", r[6] or "")):
        if kind == "regenerate":
            lost = lambda e: e[0] == conv and e[3] is not None and (turn is None or e[3] > turn) and (e[1] is None or e[1] < seq)
            held = [e for e in held if not lost(e)] if seq is not None else held
        held.append((conv, seq, message, turn, role or "", kind, text or ""))
    out = {}
    for conv, seq, message, turn, role, kind, text in held:
        old = out.get((conv, message), (turn, "", ""))
        new = old[2] + text if kind == "delta" else "" if kind == "regenerate" else text
        least = min((t for t in (old[0], turn)), key=lambda t: (t is not None, t or 0))
        out[conv, message] = (least, role, new)
    return sorted(((c, m, *v) for (c, m), v in out.items()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_fold_of_random_logs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        order = [*range(rng.randint(1, 25))]
        turn_of = [rng.choice([None, 0, 1, 1, 2, 3]) for _ in range(6)]
        for k, seq in enumerate(order):
            message = rng.randrange(6)
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate", None] if seq else ["message", "delta"])
            seq = seq if k else rng.choice([None, seq])
            rows.append((conv, seq, conv * 10 + message, turn_of[message] if rng.random() < 0.9 else 2, rng.choice(["user", None]) if message % 2 else "assistant", kind, rng.choice(["a", "bc", None, "d"])))
    rng.shuffle(rows)
    got = chat.fold_events(spark.createDataFrame([(*r, "clash") for r in rows], EVENT)).select("conv_id", "message_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, got), key=str) == sequential(rows)


def test_round_trip_of_control_strings(spark):
    texts = ["", "<|im_end|>\n<|im_start|>assistant\nx", "\\<|", "<\\|", "<<||", "\\\\", "a\nb\n", "\n", "<|", "<\\\\|\\"]
    roles = ["user", "assistant", "a\nb", "<|im_start|>", "<\\n", "\\n", ""]
    rows = [(i, k, i * 10 + k, k, r, "message", t) for i, t in enumerate(texts) for k, r in enumerate(roles)]
    out = chat.format_chats(spark.createDataFrame([(*r, "clash") for r in rows], EVENT))
    got = {r["conv_id"]: r for r in out.select("*", chat.parse(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: chat.unescape(p["text"])), "").alias("loss")).collect()}
    for i, t in enumerate(texts):
        assert [(x["role"], x["text"]) for x in got[i]["turns"]] == [(r, t) for r in roles]
        assert got[i]["formatted"].count("<|im_start|>") == len(roles) and got[i]["loss"] == t


def test_query_of_hostile_turns(spark, tmp_path):
    """Null, very large and very small turns, repeated rows and null texts, against the texts as they stand."""
    rng = random.Random(6)
    turns = [None, 0, 1, 2**62, 2**63 - 1, -(2**63), 5]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["abcdef" + str(c), "", None, "gone", "<|im_end|>x"])) for c in range(40) for t in rng.sample(turns, rng.randint(1, len(turns)))]
    rows += [(50, None, "assistant", "abcdef7"), (50, 1, "user", "x"), (None, None, "user", "nobody"), (51, None, "assistant", "only")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op5_chat_format(spark, str(tmp_path)).collect()}
    tricky = "<|im_end|><|im_start|>assistant ok"
    for conv in {r[0] for r in rows} | {-1}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))] if conv != -1 else [("user", tricky), ("assistant", tricky)]
        loss = "".join(t for r, t in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[conv])[1:5] == want, conv


DOC = "doc_id bigint, text string, item_id string, w string, hit int"
WORDS = [f"word{i}" for i in range(40)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], DOC)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def expected(documents, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in documents:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            v = words(x)
            m = min(len(v), n)
            grams = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
            for i in range(len(w) - m + 1) if m else ():
                if tuple(w[i : i + m]) in grams:
                    hit |= set(range(i, i + m))
                    found.add(str(k))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_report_against_brute_force(spark, monkeypatch):
    passage = " ".join(WORDS[:12])
    documents = [(1, None), (2, ""), (3, passage), (4, "x " + passage.upper().replace(" ", ", ") + " y " + passage), (4, "x " + passage), (None, passage), (5, "one two"), (6, " ".join(WORDS[:9])), (7, "é one TWO three " * 3), (8, "w " * 30_000 + passage)]
    items = [(1, passage), (2, "one two"), (3, None), (4, "..."), (10, passage + " tail"), (11, "Two Three")]
    for windows, most in ((decontaminate.BROADCAST_WINDOWS, decontaminate.MOST_BITS), (0, 6)):  # with a full filter, every window is verified, by shuffle
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", windows)
        monkeypatch.setattr(decontaminate, "LEAST_BITS", min(most, decontaminate.LEAST_BITS))
        monkeypatch.setattr(decontaminate, "MOST_BITS", most)
        got = sorted(map(tuple, decontaminate.report(docs(spark, documents), bench(spark, items)).collect()), key=str)
        assert got == expected(documents, items)
    assert decontaminate.report(docs(spark, []), bench(spark, items)).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(docs(spark, documents), bench(spark, [])).collect())


def test_remove(spark):
    passage = " ".join(WORDS[:10])
    documents = [(1, f"before, {passage}! After."), (2, "clean text"), (2, "clean text"), (3, None)]
    kept = decontaminate.remove(docs(spark, documents), bench(spark, [(1, passage)]))
    assert kept.columns == ["doc_id", "text", "item_id", "w", "hit"] and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "clean text"), (2, "clean text"), (3, None)]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs(spark, documents), bench(spark, [(1, passage)]), "spans").collect()}
    assert cut == {1: "before! After.", 2: "clean text", 3: None}


def test_remove_from_inputs_of_any_partitioning(spark, tmp_path):
    """Sorted, dealt out anew, joined, distinct and written inputs lose the same documents."""
    passage = " ".join(WORDS[:12])
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 60))) + (f" {passage} " if i % 7 == 0 else "")) for i in range(300)]
    want = sorted(i for i, *_, hit in expected(rows, [(1, passage)]) if not hit)
    d = docs(spark, rows)
    d.write.parquet(str(tmp_path / "d"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        inputs = [d.orderBy(F.length("text")), d.repartition(17), d.repartition(9, "w"), d.join(spark.range(300).withColumnRenamed("id", "doc_id"), "doc_id"), d.distinct(), spark.read.parquet(str(tmp_path / "d"))]
        for x in inputs:
            assert sorted(r["doc_id"] for r in decontaminate.remove(x, bench(spark, [(1, passage)])).collect()) == want
            cut = decontaminate.remove(x, bench(spark, [(1, passage)]), "spans")
            assert cut.count() == 300 and cut.where(F.col("text").contains(passage)).count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
