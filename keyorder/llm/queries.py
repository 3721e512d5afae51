"""Driver queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyorder.llm import packing
from keyorder.llm.common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> Column:
    """Documents that language models neither see nor learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyorder.llm import langid

    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), "text", model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyorder.llm import bpe

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(documents(spark, sf_dir), "doc_id", "text", path), "doc_id", path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.octet_length("piece_starts") / 4).cast("long").alias("n_pieces"),
    )


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyorder.llm import warc

    served = warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    return warc.derivatives(served, "page_id", "record").select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", "n_links",
        F.octet_length("block").cast("long").alias("content_length"),
        F.sha2("block", 256).alias("block_sha256"),
        F.sha2("record", 256).alias("record_sha256"),
    )


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyorder.llm import ngrams

    found = ngrams.score(documents(spark, sf_dir), "doc_id", "text")
    # Rounded, as sums of logarithms depend on the order of their terms in the last digits.
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("total_log_score", 4).alias("total_log_score"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyorder.llm import jaccard

    found = jaccard.join(documents(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(packing.pack(documents(spark, sf_dir), "doc_id", "text", tokenizer_path("word_bpe_49k.json")))


#: Few examples to a sequence, and a loss on at most half of its tokens.
INSTRUCTIONS = packing.Limits(tokens=2048, segments=24, loss=1024)


def packing_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as an example whose prompt is the turn before it; here all three limits bind."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    examples = turns.withColumn("prompt", before).filter("role = 'assistant'")
    made = packing.pack(examples, "conv_id", "text", tokenizer_path("word_bpe_49k.json"), limits=INSTRUCTIONS, prompt_col="prompt")
    return made.select("conv_id", "start", "length", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyorder.llm import sharding

    return sharding.shard(documents(spark, sf_dir), "doc_id", "text", 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_chat_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyorder.llm import chat

    said = r"</s>[INST] ok [/INST]"
    turns = chat.canonical(chat.gather(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conv_id", "record")
    probe = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"),
    )
    return _formatted(turns.unionByName(chat.canonical(probe, "conv_id", "record"))).drop("layout")


def _formatted(turns: DataFrame) -> DataFrame:
    """Digest columns of canonical turns, written and read back."""
    from keyorder.llm import chat

    formatted = chat.render(turns, "conv_id", keep=["layout"])
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return chat.read_back(formatted, "conv_id", keep=["layout"]).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def chat_mixed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, dealt to JSON records of every declared layout that can hold them, and formatted from those."""
    from keyorder.llm import chat

    turns = chat.canonical(chat.gather(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conv_id", "record")
    t, which = F.col("turns"), F.pmod("conv_id", F.lit(12))
    as_list = lambda role, text, *more: F.transform(t, lambda x: F.struct(x["role"].alias(role), x["text"].alias(text), *more))
    parts = F.transform(t, lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")))
    json = lambda *fields: F.to_json(F.struct(*fields))
    pair = (F.size(t) == 2) & (F.get(t, 0)["role"] == "user") & (F.get(t, 1)["role"] == "assistant")
    first, second, more = F.get(t, 0)["text"], F.get(t, 1)["text"], F.lit(1).alias("more")
    record = (
        F.when(pair & (which < 2), json(first.alias("prompt"), second.alias("response"), more))
        .when(pair & (which < 4), json(first.alias("prompt"), second.alias("completion")))
        .when(pair & (which < 6), json(more, first.alias("question"), second.alias("answer")))
        .when(pair & (which < 8), json(first.alias("instruction"), F.lit("").alias("input"), second.alias("output")))
        .when(pair & (which < 10), json(first.alias("instruction"), second.alias("output")))
        .when(which % 5 == 0, json(as_list("role", "content", more).alias("messages"), more))
        .when(which % 5 == 1, json(as_list("from", "value").alias("conversations"), more))
        .when(which % 5 == 2, json(parts.alias("messages")))
        .when(which % 5 == 3, F.to_json(as_list("role", "content")))
        .otherwise(json(as_list("role", "content").alias("messages")))
    )
    return _formatted(chat.canonical(turns.select("conv_id", record.alias("record")), "conv_id", "record"))


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyorder.llm import quality
    from keyorder.llm.common import materialize

    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    counts = materialize(quality.statistics(docs).drop("text"), "mcd-counts")
    judged = quality.judge(counts, quality.fit(counts))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyorder.llm import ann

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def packed(pieces: DataFrame) -> DataFrame:
    """Digest columns of packed pieces."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_warc_derivatives": op3_warc_derivatives,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_stupid_backoff": op5_stupid_backoff,
        "op6_vector_packing": op6_vector_packing,
        "op7_sampled_splitters": op7_sampled_splitters,
        "op8_chat_fingerprints": op8_chat_fingerprints,
        "op9_robust_outliers": op9_robust_outliers,
        "op10_cross_polytope": op10_cross_polytope,
        "packing_instructions": packing_instructions,
        "chat_mixed_layouts": chat_mixed_layouts,
    }


#: Digest columns of conversations by the default template: nine and eight characters around each turn, an escape
#: sign before each of its own kind, inside each "<|", and before a line break of a role.
_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  {probe}
), sized AS (
  SELECT *, length(role) + length(text) + 18
    + length(replace(role || text, '\', '\\')) - length(role || text)
    + (length(role) - length(replace(role, '<|', ''))) // 2 + (length(text) - length(replace(text, '<|', ''))) // 2
    + length(role) - length(replace(role, chr(10), '')) AS chars
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars,
    list(role ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars{more}
FROM joined"""

_PROBE_SQL = "UNION ALL SELECT -1, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(i, role)"

_LAYOUT_SQL = """,
  CASE WHEN roles = ['user', 'assistant'] AND conv_id % 12 < 10 THEN
    CASE conv_id % 12 // 2 WHEN 0 THEN 'prompt_response' WHEN 1 THEN 'prompt_completion' WHEN 2 THEN 'question_answer'
      WHEN 3 THEN 'instruction_input' ELSE 'instruction' END
  ELSE CASE conv_id % 12 % 5 WHEN 0 THEN 'messages' WHEN 1 THEN 'conversations' WHEN 2 THEN 'message_parts' WHEN 3 THEN 'message_list'
    ELSE 'messages' END END AS layout"""


_BACKOFF_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), tokens AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM texts
), grams AS (
  SELECT doc_id, i, w AS w3, lag(w) OVER t AS w2, lag(w, 2) OVER t AS w1 FROM tokens WINDOW t AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT *, count(*) OVER () AS total,
    count(*) OVER (PARTITION BY w3) AS c1, count(*) OVER (PARTITION BY w2, w3) AS c2, count(*) OVER (PARTITION BY w1, w2, w3) AS c3
  FROM grams
), ones AS (
  SELECT w3 AS a, count(*) AS n FROM grams GROUP BY 1
), twos AS (
  SELECT w2 AS a, w3 AS b, count(*) AS n FROM grams WHERE w2 IS NOT NULL GROUP BY 1, 2
), scored AS (
  SELECT doc_id, ln(CASE
    WHEN w1 IS NOT NULL AND c3 >= 2 THEN c3 / twos.n
    WHEN w2 IS NOT NULL AND c2 >= 2 THEN CASE WHEN w1 IS NOT NULL THEN 0.4 ELSE 1 END * c2 / ones.n
    ELSE CASE WHEN w1 IS NOT NULL THEN 0.16 WHEN w2 IS NOT NULL THEN 0.4 ELSE 1 END * c1 / total END::DOUBLE) AS score
  FROM counted LEFT JOIN ones ON ones.a = w2 LEFT JOIN twos ON twos.a = w1 AND twos.b = w2
), summed AS (
  SELECT doc_id, sum(score) AS total FROM scored GROUP BY 1
)
SELECT doc_id, len(words)::BIGINT AS n_words, round(total / len(words), 6) AS log_score, round(coalesce(total, 0), 4) AS total_log_score
FROM texts LEFT JOIN summed USING (doc_id)"""


_JACCARD_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM texts
), named AS (
  SELECT doc_id, s, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS class_id FROM sets
), shingles AS (
  SELECT class_id AS c, len(s) AS n, unnest(s) AS g FROM named WHERE doc_id = class_id
), links AS (
  SELECT a.c AS x, b.c AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT x, y FROM links UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y
), least AS (
  SELECT x, min(y) AS y FROM reached GROUP BY x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(class_id, coalesce(y, class_id)) AS component_id, class_id
FROM named LEFT JOIN least ON x = class_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard": _JACCARD_SQL,
        "op5_stupid_backoff": _BACKOFF_SQL,
        "op8_chat_fingerprints": _CHAT_SQL.format(probe=_PROBE_SQL, more=""),
        "chat_mixed_layouts": _CHAT_SQL.format(probe="", more=_LAYOUT_SQL),
    }
