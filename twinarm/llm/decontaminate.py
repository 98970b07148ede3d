"""Benchmark decontamination: a hash set of normalised test n-grams against the token windows of training texts, in DataFrame functions only.

Words are maximal runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. An item gives its windows
of ``n`` consecutive words; an item of fewer words, but not none, is one window. A document word inside any occurrence of
a window is hit. The hashes of all windows stand in a Bloom filter of bounded size that every task holds; the windows of a document that pass it, hits
and a few others, are verified by their words against the table of windows. However large the benchmark is, only those leave the scan.

Defined results: null and empty texts have no words and no hits; repeated rows are judged one by one; null ids pass through;
an empty benchmark hits nothing; further columns are kept by :func:`remove`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Words of a window.
WINDOW = 10
#: Bits of the filter for each window, and the powers of two between which its size stays (2**24 bits are 2 MB). A fuller filter lets more through to be verified.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 12, 24
#: Up to so many windows (about 100 bytes each) or row numbers (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_ROWS = 60_000, 400_000

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), NOT_WORD), lambda w: w != "")


def _probes(h: Column, bits: int) -> list[Column]:
    """The two places of a hash in a filter of so many bits."""
    return [F.lit(bits - 1).cast("bigint").bitwiseAND(x) for x in (h, F.shiftrightunsigned(h, 32))]


def _filter(grams: DataFrame) -> tuple[Column, int]:
    """The Bloom filter of the windows as a constant array of 64-bit words, and its bits. At most bits / 64 numbers come to the driver."""
    bits = 1 << max(LEAST_BITS, min(MOST_BITS, (BITS_EACH * grams.count()).bit_length()))
    slot = grams.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    held = [0] * (bits // 64)
    for r in slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("value")).collect():
        held[r["word"]] = r["value"]
    return F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>"), bits


def _passes(h: Column, held: Column, bits: int) -> Column:
    """Whether the filter may hold a hash."""
    one, two = (F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _probes(h, bits))
    return one & two


def _windows(n: int, hashes: Column, held: Column, bits: int) -> Column:
    """Array of (pos, m, h) of the windows of n words that pass the filter."""
    last = F.size(hashes) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    each = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("m"), F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]).alias("h")))
    return F.filter(each, lambda x: _passes(x["h"], held, bits))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct (m, h, gram, items) of the benchmark: m words each, items being the ids that hold the window."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    m = F.least(F.size("w"), F.lit(n))
    rows = w.select("item_id", m.alias("m"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.slice("w", i, m))).alias("g"))
    hashed = rows.select("item_id", "m", F.transform("g", lambda x: F.xxhash64(x)).alias("hs"), F.array_join("g", " ").alias("gram"))
    by_length = F.lit(None).cast("bigint")
    for k in range(1, n + 1):
        by_length = F.when(F.col("m") == k, F.xxhash64(*[F.get("hs", F.lit(i)) for i in range(k)])).otherwise(by_length)
    return hashed.select("item_id", "m", by_length.alias("h"), "gram").groupBy("m", "h", "gram").agg(F.collect_set("item_id").alias("items"))


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, keep: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): the kept columns of every row with its number _row and n_words, and per row with hits its _row, hit and items.

    Rows are numbered once and written; what follows reads that table, so both results mean the same rows, whatever partitions docs has.
    """
    grams = materialise(benchmark_windows(benchmark, n), "windows")
    held, bits = _filter(grams)
    base = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, words(F.col("text")).alias("_w"))
    hashed = base.withColumn("_hs", F.transform("_w", lambda x: F.xxhash64(x)))
    found = F.array().cast("array<struct<pos:int,m:int,h:bigint>>")
    for r in grams.select("m").distinct().orderBy("m").collect():  # at most n rows
        found = F.concat(found, _windows(r["m"], F.col("_hs"), held, bits))
    gram = F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["m"].alias("m"), x["h"].alias("h"), F.array_join(F.slice("_w", x["pos"] + 1, x["m"]), " ").alias("gram")))
    rows = materialise(hashed.withColumn("_found", gram).withColumn("n_words", F.size("_w")).drop("_w", "_hs"), "scanned")
    open_ = rows.where(F.size("_found") > 0).select("_row", F.explode("_found").alias("x")).select("_row", "x.*")
    small = grams.count() <= BROADCAST_WINDOWS
    matched = open_.join(F.broadcast(grams) if small else grams, ["m", "h", "gram"]).groupBy("_row")
    spans = matched.agg(F.collect_set(F.struct("pos", "m")).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["m"] - 1))))
    hits = spans.select("_row", F.array_sort(covered).alias("hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    return rows.drop("_found"), materialise(hits, "hits")


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per row of docs (_row, doc_id): n_words, hit (sorted array of hit word positions), items (sorted ids as strings).

    The words of a document never leave its task; only windows that may be hits are joined.
    """
    rows, hits = _scanned(docs, benchmark, n, [F.col("doc_id")])
    joined = rows.join(hits, "_row", "left")
    return joined.select("_row", "doc_id", "n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find_hits(docs, benchmark, n).select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size("hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW) -> DataFrame:
    """docs without contaminated documents (mode "documents"), or with the hit words cut out of their texts (mode "spans")."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be 'documents' or 'spans', not {mode!r}")
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc")
    rows, hits = _scanned(docs, benchmark, n, [whole])
    if mode == "documents":
        gone = hits.select("_row")
        return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "_row", "left_anti").select("_doc.*")
    joined = rows.join(hits.select("_row", "hit"), "_row", "left").withColumn("text", F.col("_doc.text"))
    seps = F.regexp_extract_all("text", F.lit(f"({NOT_WORD})"), 1)
    seps = F.when(F.col("text").rlike(f"^{NOT_WORD}"), seps).otherwise(F.concat(F.array(F.lit("")), seps))
    kept_words = F.filter(F.split("text", NOT_WORD), lambda w: w != "")
    each = F.transform(kept_words, lambda w, i: F.concat(F.coalesce(F.get(seps, i), F.lit("")), w))
    cuts = F.concat(F.array(F.lit(-1)), F.coalesce("hit", F.array().cast("array<int>")), F.array(F.size(kept_words)))
    joined = joined.withColumns({"_each": each, "_cuts": cuts})
    runs = F.transform(F.sequence(F.lit(0), F.size("_cuts") - 2), lambda j: F.slice("_each", F.get("_cuts", j) + 2, F.get("_cuts", j + 1) - F.get("_cuts", j) - 1))
    tail = F.coalesce(F.get(seps, F.size(kept_words)), F.lit(""))
    text = F.when(F.col("hit").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.flatten(runs), ""), tail))
    return joined.withColumn("_text", text).select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in columns])
