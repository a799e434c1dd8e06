"""The registered queries of this folder. Each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import (
    audit,
    bagminhash,
    decontaminate,
    forest,
    language,
    mixing,
    preference,
    quality,
    repair,
    rollups,
    substrings,
    tokens,
    warc,
)
from panelforge.session import scratch_path

# Shares of the mix, by rule: the large source gets 24, the others 1 to 4.
SHARES = {"src0": 24, **{f"src{i}": 1 + i % 4 for i in range(1, 20)}}


def vocabulary() -> str:
    """The public byte-level vocabulary that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_forest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest found for every fiftieth vector, by cosine."""
    vectors = table(spark, folder, "embeddings")
    return forest.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op2_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt, masked completions and trained characters of a pair per conversation."""
    found = preference.format_pairs(preference.sampled_pairs(table(spark, folder, "conversations")))
    spans = lambda c: F.array_join(
        F.transform(c, lambda m: F.concat_ws("-", m["low"].cast("string"), m["high"].cast("string"))), ","
    )
    return found.select(
        F.col("pair_id").alias("conv_id"),
        "n_prompt_turns",
        "prompt",
        "chosen",
        "rejected",
        spans("chosen_mask").alias("chosen_mask"),
        spans("rejected_mask").alias("rejected_mask"),
        "tied",
    )


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that repeat 13 or more words of a smaller document."""
    found = substrings.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside benchmark passages, and whether they condemn it."""
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    hit = decontaminate.covered_words("spans")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(hit, F.col("n_words")).alias("contaminated"),
    )


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select(
        F.col("_0").alias("doc_id"), language.held_out("_0").alias("held_out"), "lang_pred", "score"
    )


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from three quarters of the labels."""
    docs = table(spark, folder, "documents")
    found = quality.score(docs, quality.learn(docs, table(spark, folder, "labels")))
    return found.select(
        "doc_id",
        language.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Slot and position of every document in the mix."""
    found = mixing.positions(table(spark, folder, "documents").select("doc_id", "source"), SHARES)
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_row.source").alias("source"),
        F.col("_slot").alias("slot"),
        F.col("_position").alias("position"),
    )


def op7_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after inserts in four batches, deletes, revised counts and a batch sent twice."""
    docs = table(spark, folder, "documents")
    words, pieces = (rollups.count_tokens("text", v) for v in (rollups.WORDS, rollups.PIECES))
    store = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    inserts = [
        (f"insert-{k}", rollups.signed(docs.filter(part == k), 1, words, rollups.WORDS)) for k in range(4)
    ]
    short = rollups.signed(docs.filter(words < 20), -1, words, rollups.WORDS)
    kept = docs.filter(F.col("lang").isin("de", "es", "fr")).filter(words >= 20)
    recounted = rollups.revised(kept, words, rollups.WORDS, pieces, rollups.PIECES)
    for name, rows in [*inserts, ("delete-short", short), ("revise-langs", recounted), inserts[1]]:
        store.commit(name, rows)
    return store.totals()


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from the files written."""
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), path, vocabulary())
    files = spark.read.parquet(path)
    return tokens.with_starts(tokens.checksums(files), files).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


def op9_bagminhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    found = bagminhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes at each step of each order, by language."""
    text = F.coalesce("text", F.lit(""))
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return audit.filter_audit(
        table(spark, folder, "documents"),
        table(spark, folder, "labels"),
        audit.text_filters(text),
        "E",
        flags,
    )


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a record of an archive, as read back from the archives."""
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), path)
    found = warc.read_warc(spark, path, payloads=False, strict=True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest repair and its hash of every conversation after a fixed damage."""
    return repair.repair(repair.damaged(table(spark, folder, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_forest_neighbours,
        op2_preference_format,
        op3_substring_dedup,
        op4_decontamination,
        op5_language_id,
        op6_pfair_mixing,
        op7_token_rollups,
        op8_token_files,
        op9_bagminhash_dedup,
        op10_quality,
        op11_filter_audit,
        op12_warc,
        op13_conversation_repair,
    )
}

_OP2 = r"""
WITH ranked AS (
  SELECT conv_id, turn, role, text,
         max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last
  FROM conversations
), kept AS (
  SELECT conv_id, turn, text, last,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece
  FROM ranked WHERE turn <= last
), talks AS (
  SELECT conv_id, CAST(count(*) AS INTEGER) AS n,
         coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE turn < last), '') AS before,
         max(piece) FILTER (WHERE turn = last) AS own, max(text) FILTER (WHERE turn = last) AS reply
  FROM kept GROUP BY conv_id
), paired AS (
  SELECT *, coalesce(lead(own) OVER w, first_value(own) OVER w) AS other,
         coalesce(lead(reply) OVER w, first_value(reply) OVER w) AS other_reply
  FROM talks WINDOW w AS (ORDER BY conv_id)
)
SELECT conv_id,
       CASE WHEN own = other THEN n ELSE n - 1 END AS n_prompt_turns,
       CASE WHEN own = other THEN before || own ELSE before END AS prompt,
       CASE WHEN own = other THEN '' ELSE own END AS chosen,
       CASE WHEN own = other THEN '' ELSE other END AS rejected,
       CASE WHEN own = other THEN '' ELSE '14-' || CAST(22 + length(reply) AS VARCHAR) END AS chosen_mask,
       CASE WHEN own = other THEN '' ELSE '14-' || CAST(22 + length(other_reply) AS VARCHAR) END AS rejected_mask,
       own = other AS tied
FROM paired
UNION ALL
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_prompt_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn) AS prompt,
       '' AS chosen, '' AS rejected, '' AS chosen_mask, '' AS rejected_mask, true AS tied
FROM ranked WHERE last IS NULL GROUP BY conv_id
"""

_OP7 = r"""
WITH counted AS (
  SELECT source, lang,
         CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
         CAST(len(regexp_extract_all(text, '[0-9A-Za-z]+|[^\x00-\x7F]+')) AS BIGINT) AS pieces
  FROM documents
)
SELECT source, lang, CASE WHEN lang IN ('de', 'es', 'fr') THEN 'pieces_v2' ELSE 'words_v1' END AS tokenizer,
       CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(CASE WHEN lang IN ('de', 'es', 'fr') THEN pieces ELSE words END) AS BIGINT) AS n_tokens
FROM counted WHERE words >= 20 GROUP BY ALL
"""

_OP11 = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, a, b, c, d, e, good, toxic, CAST(count(*) AS BIGINT) AS n FROM (
    SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
           regexp_matches(t, '[#$%&*|]') AS d, coalesce(docs.doc_id > least, false) AS e,
           coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM docs LEFT JOIN said ON said.doc_id = docs.doc_id) AS f
  GROUP BY ALL
), fails AS (
  SELECT part, n, good, toxic,
         (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END)
         || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END)
         || (CASE WHEN e THEN 'E' ELSE '' END) AS failed
  FROM cells
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x
), plan AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own,
         substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) AS s
), told AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(failed, own) AS hit, failed = own AS single,
         failed <> '' AND translate(failed, earlier, '') <> failed AS gone
  FROM fails, plan
), counted AS (
  SELECT part, filter_order, step, own,
         CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (single), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM told GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""

_OP12 = r"""
WITH held AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT)
               >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM held
"""

ORACLES: dict[str, str] = {
    "op2_preference_format": _OP2,
    "op7_token_rollups": _OP7,
    "op11_filter_audit": _OP11,
    "op12_warc": _OP12,
}
