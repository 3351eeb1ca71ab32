"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_trie, exact_dedup, html_text, jaccard_join, language_id, mpeg_audio, packing, piece_codec, quality, substring_dedup, toxicity, whitening
from .common import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _hex_sha(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return pieces.drop("doc_key")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.near_groups(table(spark, sf_dir, "documents"), shingle_words=4, num=85, den=100)
    return groups.select("doc_id", "n_shingles", "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    pieces = piece_codec.encode(table(spark, sf_dir, "documents"), model, keep=("doc_id",))
    # The spans cover each text without gaps; a hash of them stands for all.
    spans = pieces.select("doc_id", "ids", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64("starts", "ends").alias("spans_hash"))
    decoded = piece_codec.decode(spans, model)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _hex_sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _hex_sha(F.col("decoded")).alias("decoded_sha256"),
        "n_bytes",
        "spans_hash",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.text_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("doc_key")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", _hex_sha(F.col("kept_text")).alias("kept_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = F.lit("</s>[INST] ok [/INST]")
    two = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    extra = spark.range(1).select(two.alias("t")).select(F.lit(-1).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", hostile.alias("text"))
    made = chat_format.format_trees(chat_format.linear(rows.unionByName(extra)), best=1)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = made.select(F.col("tree").alias("conv_id"), "formatted", chat_format.turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _hex_sha(said).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        _hex_sha(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).drop("doc_key")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mpeg_audio.store(table(spark, sf_dir, "documents"))
    read = mpeg_audio.features(stored)
    size = F.octet_length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(octet_length(payload) - 63, 1), 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("doc_key")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, weights="one")
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(rows, family=20, heads=4))


def queries() -> dict:
    every = (
        op1_packing, op2_jaccard_join, op3_sentencepiece, op4_exact_dedup, op5_toxicity, op6_substring_dedup, op7_html_extraction,
        op8_chat_formatting, op9_language_id, op10_media_columns, op11_quality_classifier, op12_embedding_whitening, op13_conversation_trie,
    )
    return {f.__name__: f for f in every}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = r"regexp_replace(replace(coalesce({}, ''), '\', '\\'), '(<)(\||s>|/s>|<SYS|</SYS|start_of_turn|end_of_turn|bos>|eos>)|(\[)(INST|/INST|SYSTEM|AVAILABLE|TOOL)', '\1\3\\\2\4', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": rf"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
            s AS (
                SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS shingle
                FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
            ),
            n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
            o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
            e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.size + q.size - shared)),
            b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
            r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.node = b.x)
            SELECT r.doc_id, coalesce(any_value(n.size), 0)::BIGINT AS n_shingles, min(node) AS component_id
            FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
        """,
        "op4_exact_dedup": f"""
            WITH t AS (SELECT doc_id, {_LOWER} AS n FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(n) AS text_sha256
            FROM t WINDOW g AS (PARTITION BY n)
        """,
        "op6_substring_dedup": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            win AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
            later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
            gone AS (SELECT DISTINCT doc_id, s + i AS p FROM later, range(0, 20) AS r(i)),
            word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
            kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
            SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
            FROM w LEFT JOIN kept USING (doc_id)
        """,
        "op8_chat_formatting": f"""
            WITH c AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
                UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
            )
            SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum({len(chat_format.TURN + chat_format.TEXT + chat_format.END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
            FROM c GROUP BY conv_id
        """,
        "op13_conversation_trie": r"""
            WITH RECURSIVE o AS (
                SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
                FROM conversations WHERE conv_id IS NOT NULL
            ),
            crc AS (
                SELECT DISTINCT conv_id AS c, 0 AS k, 4294967295::BIGINT AS x FROM o
                UNION ALL
                SELECT c, k + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END
                FROM (SELECT c, k, CASE WHEN k % 8 = 0 THEN xor(x, ascii(substr(c::VARCHAR, k // 8 + 1, 1))::BIGINT) ELSE x END AS y FROM crc WHERE k < 8 * length(c::VARCHAR))
            ),
            h AS (SELECT c, xor(x, 4294967295) % 4 AS h FROM crc WHERE k = 8 * length(c::VARCHAR)),
            t AS (
                SELECT c, 0 AS own, p, role, text FROM h JOIN o ON o.conv_id = c - c % 20 WHERE p <= h
                UNION ALL SELECT c, 1, p, role, text FROM h JOIN o ON o.conv_id = c WHERE p > h
            ),
            s AS (SELECT c, row_number() OVER w AS d, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t WINDOW w AS (PARTITION BY c ORDER BY own, p)),
            path AS (SELECT c, d, key, words, left(key, length(key) - 64) AS up FROM s UNION ALL SELECT c, 0, '', 0, NULL FROM h),
            n AS (SELECT key, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs, min(c) AS conv_id, any_value(words) AS words FROM path GROUP BY key),
            k AS (SELECT up, count(*) AS n_children FROM n GROUP BY up),
            below AS (
                SELECT path.key, sum((k.up IS NULL)::INT)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
                FROM n LEFT JOIN k ON k.up = n.key JOIN path ON path.c = n.conv_id AND path.d <= n.depth GROUP BY path.key
            ),
            e AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, key FROM path QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY key)
            SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
            FROM n JOIN below USING (key) LEFT JOIN n q ON q.key = n.up LEFT JOIN k ON k.up = n.key LEFT JOIN e ON e.key = n.key
        """,
    }
