"""The registered queries of this package and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import chat, decontaminate, exact_dedup, jaccard, language_id, packing, prefix_trie, secret_scan, sharding, spelling, substring_dedup, token_counts, toxicity
from citeloom.llm.common import crc_mod, table
from citeloom.session import ship

#: The tokenizer files' folder; its module tells the place where it is installed.
TOKENIZERS = os.environ.get("CITELOOM_TOKENIZERS", "")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, shortest pack first."""
    ship(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


#: A conversation of control strings that every result must carry through.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what their formatted texts read back as."""
    ship(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(probe)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents by deterministic block naming."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("row")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a random field over their words."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents from averaged subword embeddings."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents alike in five-word shingles."""
    ship(spark)
    return jaccard.alike(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    ship(spark)
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the lower-casing word tokenizer."""
    ship(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    dealt = sharding.shards_by_bytes(table(spark, sf_dir, "documents"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents under a 100-byte string that stood earlier, by suffix arrays."""
    ship(spark)
    return substring_dedup.removed(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: fixed patterns and windows of high entropy."""
    ship(spark)
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with openings that families share."""
    ship(spark)
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the near word that is far more common."""
    ship(spark)
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_jaccard": op6_jaccard,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_shards": op9_shards,
    "op10_substrings": op10_substrings,
    "op11_secrets": op11_secrets,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling": op13_spelling,
}

def _escapes() -> str:
    """SQL for the number of backslashes that the chat template adds to `text`."""
    counts = [f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROL)]
    return " + ".join(counts)


ORACLE_SQL: dict[str, str] = {
    "op2_chat": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum({len(chat.TURN)} + length(role) + 1 + length(text) + {_escapes()} + {len(chat.END)} + 1)::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id
    """,
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op6_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[k:k + least(len(w), 5) - 1], ' ')) AS g
                   FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5 + 1, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
             n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
             e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
             e2 AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
             r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e2.b FROM r JOIN e2 ON e2.a = r.c)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
    """,
    "op7_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
                    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
             sizes AS (SELECT DISTINCT n FROM bw),
             dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
                    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
             m AS (SELECT dw.doc_id, dw.n, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
             hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
             its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
                     FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
               sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
    "op11_secrets": secret_scan.oracle(),
    "op12_prefix_trie": prefix_trie.oracle(),
    "op13_spelling": spelling.oracle(),
}
