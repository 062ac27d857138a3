"""The thin queries of the training-data operators, and the SQL that holds their results where SQL can."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, filter_audit, hard_negatives, mixing, ngram_lm, packing, prefix_hash, quality_crf, secret_scan, sharding, simhash, substring_dedup
from .common import table


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


#: Roles stay as the table has them.
PLAIN_ROLES = tuple(replace(m, roles={}) for m in chat_format.MAPPINGS)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.sql(f"SELECT -1L AS conv_id, x.turn, x.role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(turn, role)")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    records = rows.unionByName(own).groupBy("conv_id").agg(turns.alias("t"))
    # conversations come in three layouts, by their id, as those of several collections would
    listed = lambda role, text, *more: F.transform("t", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text), *more))
    kind = F.pmod("conv_id", F.lit(3))
    record = (
        F.when(kind == 0, F.to_variant_object(F.struct(listed("role", "content").alias("messages"))))
        .when(kind == 1, F.to_variant_object(F.struct(F.col("conv_id").alias("id"), listed("role", "text", F.lit("x").alias("name")).alias("turns"))))
        .otherwise(F.to_variant_object(F.struct(F.lit("table").alias("source"), listed("role", "content").alias("conversations"))))
    )
    chats = chat_format.format_chats(records.select("conv_id", record.alias("record")), mappings=PLAIN_ROLES)
    back = chats.select("conv_id", "schema_fingerprint", "layout", "formatted", chat_format.turns_of(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


def op2_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lang = secret_scan.language(docs)
    found = secret_scan.scan(docs, secret_scan.train(spark, lang=lang), lang=lang)
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "secret")


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), quality_crf.held_out(parts=7, part=2)
    model = ngram_lm.train(docs.where(~out))
    return ngram_lm.score(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = substring_dedup.span_report(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return report.select("doc_id", "n_chars", "n_removed", "removed_chars", listed.alias("removed"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), keep=["doc_id", "source"], repeat_limit=1.5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), quality_crf.held_out()
    chain = quality_crf.fit(docs, table(spark, sf_dir, "labels"), usable=~out)
    return quality_crf.score(docs, chain).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_prefix_hash": op2_prefix_hash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_ngram_lm": op5_ngram_lm,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_quality_crf": op9_quality_crf,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL = {
    "op1_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
             e AS (SELECT *, length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|n|>')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS n FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars, CASE WHEN conv_id % 3 = 0 THEN 'messages' WHEN conv_id % 3 = 1 THEN 'turns' ELSE 'conversations by role' END AS layout
        FROM e GROUP BY conv_id
    """,
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                          row_number() OVER (PARTITION BY t ORDER BY doc_id) AS nth FROM n)
        SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op11_filter_audit": r"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
             l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
             f AS (SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
                          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
                          coalesce(min(w.doc_id) OVER (PARTITION BY t) < coalesce(w.doc_id, 9223372036854775807), false) AS e FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
             m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
             i AS (SELECT x, substr('ABCDE', x + 1, 1) AS letter FROM range(5) t(x)),
             o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.x, q.x, r.x, s.x, t.x] AS xs FROM i p, i q, i r, i s, i t
                   WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
             s AS (SELECT filter_order, k::INT AS step, xs[k] AS x, list_sum(list_transform(xs[1:k - 1], lambda y: 1 << y))::BIGINT AS before FROM o, range(1, 6) t(k)),
             g AS (SELECT part, filter_order, step, x,
                          sum(CASE WHEN mask & (coalesce(before, 0) | (1 << x)) = 0 THEN n ELSE 0 END) AS kept,
                          sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & (1 << x) > 0 THEN n ELSE 0 END) AS removed,
                          sum(CASE WHEN mask & coalesce(before, 0) > 0 AND mask & (1 << x) > 0 THEN n ELSE 0 END) AS redundant,
                          sum(CASE WHEN mask = 1 << x THEN n ELSE 0 END) AS unique_fails,
                          sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & (1 << x) > 0 THEN good ELSE 0 END) AS good_lost,
                          sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & (1 << x) > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM m, s GROUP BY ALL)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
               toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g
    """,
    "op12_hard_negatives": r"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, a.label AS kind, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = kind QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE label <> kind AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
    """,
    "op13_sharding": r"""
        WITH t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda crc, k: xor(crc >> 1, 3988292384::BIGINT * (crc & 1))) AS v FROM range(256) r(i))),
             d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
             c AS (SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || bytes, lambda crc, x: xor(crc >> 8, tab[1 + (xor(crc, x) & 255)]))) AS text_crc32 FROM d, t),
             p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before, (sum(size) OVER ())::HUGEINT AS total FROM c),
             s AS (SELECT *, least(39, (2 * before + size) * 40 // (2 * total))::INT AS shard FROM p)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST) - 1 AS slot, NULL::INT AS grown_shard FROM s
    """,
}
