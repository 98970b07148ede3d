"""The queries of the subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, dac, decontaminate, jaccard, mixture, packing, pii, quality, suffix_dedup, topk, toxicity, trie
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; a document's host is its source, the path below it its language."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model learned from the labels outside the held-out part."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as directly addressable codes and read back."""
    return dac.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every fiftieth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.search(vectors, F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""


def _logged(log: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as an event log: messages whole, streamed, edited or regenerated after a false start that had gone on to the next turn.

    Events are in order of turn and step, whatever the turn; a message of no turn, or of the last one that there can be, has no next turn and so no false start.
    """
    rows = log.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.left("text", half), F.substr("text", half + 1)

    def event(step: int, kind: str, text: Column, later: int = 0) -> Column:
        """An event of the row's message or, with later, of another one of the next turn."""
        return F.struct(F.struct("turn", F.lit(step).alias("step")).alias("seq"), (F.col("row") * 2 + later).alias("message_id"), F.try_add("turn", F.lit(later)).alias("turn"), F.lit(kind).alias("kind"), text.alias("text"))

    whole = F.array(event(0, "message", F.col("text")))
    edited = F.array(event(0, "delta", tail), event(1, "delta", head), event(2, "edit", head), event(3, "delta", tail))
    again = F.array(event(0, "message", tail), event(1, "message", F.lit("gone"), 1), event(2, "regenerate", F.lit(None)), event(3, "delta", head), event(4, "delta", tail))
    form = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    form = F.when((form == 2) & F.try_add("turn", F.lit(1)).isNull(), 1).otherwise(form)
    events = F.when(form == 0, whole).when(form == 1, edited).otherwise(again)
    return rows.select("conv_id", "role", F.explode(events).alias("e")).select("conv_id", "role", "e.*")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 of control strings, logged as events, folded, formatted and read back from the output."""
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    log = log.unionByName(spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], log.schema))
    events = _logged(log)
    out = chat.format_chats(events).select("conv_id", "formatted", "parts", chat.parse(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: chat.unescape(p["text"])), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_len,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n')) AS role_len FROM log
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + role_len + 1 + text_len + 10 + 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _equal(values: Column, value: str) -> Column:
    return F.filter(values, lambda v: v == value)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the base spans, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    text = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",") for c in ("base", "spans")}
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(_equal(kinds, k)).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text["base"].cast("binary"), 256).alias("base_sha256"), text["spans"].alias("spans"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity components of all documents."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS s
  FROM w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
overlap AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingle AS a JOIN shingle AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM overlap JOIN size AS p ON p.doc_id = x JOIN size AS q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach AS r JOIN link AS l ON l.x = r.y)
SELECT x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id FROM reach LEFT JOIN size ON size.doc_id = x GROUP BY x
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 100 bytes."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the windows of every benchmark item."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bg AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM bw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), dg AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM dw, (SELECT DISTINCT m FROM bg) AS ms, unnest(range(1, len(w) - m + 2)) AS t(i)
), hits AS (SELECT doc_id, i, dg.m AS m, item_id FROM dg JOIN bg USING (m, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + m)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: what is taken of each, beside its source's size and target."""
    return mixture.report(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie.report(table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [256 + unicode(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda crc, x: CASE WHEN x >= 256 THEN xor(crc, x - 256) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, role, text FROM (
    SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM convs AS c JOIN turns AS t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND t.pos > c.h)
), prefix AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS key, CAST(0 AS BIGINT) AS chars FROM convs
  UNION ALL SELECT p.conv_id, p.depth + 1, sha256(p.key || length(r.role) || ':' || r.role || r.text), CAST(length(r.text) AS BIGINT) FROM prefix AS p JOIN rebuilt AS r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1
), node AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM prefix GROUP BY depth, key),
placed AS (SELECT p.conv_id AS member, n.depth, n.conv_id FROM prefix AS p JOIN node AS n USING (depth, key)),
kids AS (SELECT up.conv_id, up.depth, count(*) AS n FROM node AS n JOIN placed AS up ON up.member = n.conv_id AND up.depth = n.depth - 1 GROUP BY ALL),
below AS (
  SELECT up.conv_id, up.depth, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM node AS n JOIN placed AS up ON up.member = n.conv_id AND up.depth <= n.depth LEFT JOIN kids AS k ON k.conv_id = n.conv_id AND k.depth = n.depth GROUP BY ALL
), ends AS (
  SELECT e.conv_id, e.depth, string_agg(CAST(e.member AS VARCHAR), ',' ORDER BY e.member) AS ids
  FROM placed AS e JOIN (SELECT conv_id AS member, max(depth) AS depth FROM prefix GROUP BY conv_id) USING (member, depth) GROUP BY e.conv_id, e.depth
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM node AS n JOIN below AS b USING (conv_id, depth) LEFT JOIN kids AS k USING (conv_id, depth) LEFT JOIN ends AS e USING (conv_id, depth)
LEFT JOIN placed AS up ON up.member = n.conv_id AND up.depth = n.depth - 1
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters over all documents, by language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f
    WHEN 'A' THEN len(w) < 100 WHEN 'B' THEN 100 * len(list_distinct(w)) < 80 * len(w)
    WHEN 'C' THEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text)
    WHEN 'D' THEN regexp_matches(text, '[#$%&*|]') ELSE coalesce(w.doc_id > first, false) END) AS fails
  FROM w LEFT JOIN known USING (doc_id)
), masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letter AS a, letter AS b, letter AS c, letter AS d, letter AS e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)
), met AS (
  SELECT part, o, s, o[s] AS f, n, good, toxic, len(list_intersect(o[1:s - 1], fails)) > 0 AS gone, list_contains(fails, o[s]) AS failed, len(fails) AS k
  FROM masks, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), summed AS (
  SELECT part, array_to_string(o, '') AS filter_order, s AS step, any_value(f) AS f,
         sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND k = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_toxicity": op2_toxicity,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_topk": op4_topk,
        "op5_chat_format": op5_chat_format,
        "op6_token_file": op6_token_file,
        "op7_pii": op7_pii,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_decontaminate": op10_decontaminate,
        "op11_mixture": op11_mixture,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk": OP4_SQL,
        "op5_chat_format": OP5_SQL,
        "op8_jaccard_join": OP8_SQL,
        "op10_decontaminate": OP10_SQL,
        "op12_prefix_trie": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
    }
