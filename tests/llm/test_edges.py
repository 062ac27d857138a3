"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, exact_dedup, mixing, packing, prefix_hash, quality_crf, queries, secret_scan, simhash, substring_dedup

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "a", 7), (2, "Alpha beta  gamma\tdelta epsilon zeta eta theta.", "en", "a", 7), (2, "Alpha beta  gamma\tdelta epsilon zeta eta theta.", "en", "a", 7),
    (3, None, "en", None, 0), (4, "", None, "b", 0), (None, "", "en", "b", 0), (None, None, None, None, None), (5, "x" * 50 + " " + "long words and words " * 20_000, "en", "b", 9), (6, "ü \n\n über 你好 \U0001f600 <|endoftext|> <|im_start|>", "de", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit(1) for c in ("kept", "keep_id", "score", "start", "length", "run", "digest", "fp", "component_id", "epoch", "removed", "id", "key", "row_key", "text_key")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert len(got) == len(ROWS)
    assert [g for g in got if g[0] in (1, 2)] == [(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False)]
    assert sorted(g[3] for g in got if g[2] == 4) == [False, False, False, True]  # the empty ones, kept: 3
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 5, 6]
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.drop_copies(none).count() == 0


def test_simhash(docs, none):
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in got if r["fp"] == 0} == {3}
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 5, 6]
    assert simhash.simhash_groups(none).count() == simhash.drop_near_copies(none).count() == 0


def test_large_anchors_are_split(spark, monkeypatch):
    """Groups far over the limit, in both segments and over many batches, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    low, high = np.uint64((1 << 31) - 1), np.uint64(((1 << 31) - 1) << 31)
    noise = rng.integers(0, 1 << 63, 1_500, np.uint64)
    prints = np.concatenate([base[0] & low | noise[:500] & ~low, base[1] & high | noise[500:1000] & ~high, noise[1000:]])
    near = prints[rng.integers(0, len(prints), 1_500)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)) * (rng.random(len(near)) < 0.7)
    prints = np.unique(np.concatenate([prints, near]))
    root = np.arange(len(prints))
    while True:  # labels fall to the least of all neighbours
        new = np.array([root[np.bitwise_count(prints ^ x) <= 3].min() for x in prints])
        if (new == root).all():
            break
        root = new
    from tessera.llm.components import components

    for large in (4_096, 40):
        monkeypatch.setattr(simhash, "LARGE", large)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
        try:
            got = components(simhash.links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint"))).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        of = {r["node"]: r["root"] for r in got}
        groups, want = {}, {}
        for x, k in zip(prints.view(np.int64).tolist(), root.tolist()):
            groups.setdefault(of.get(x, x), set()).add(x)
            want.setdefault(k, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())), large


def test_packing(docs, none):
    got = packing.pack(docs, queries.word_tokenizer()).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 1
    assert sorted(r["copy"] for r in got if r["doc_id"] == 2 and r["start"] == 0) == [0, 1]
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert packing.pack(none, queries.word_tokenizer()).count() == 0
    assert [packing.decompose(n) for n in (0, 1, 13, 2048, 5000)] == [[], [1], [8, 4, 1], [2048], [2048, 2048, 512, 256, 128, 8]]
    other = __import__("public_tokenizers").path("byte_bpe_50k.json")  # settings that the fast path doesn't stand for
    from tokenizers import Tokenizer

    plain, texts = Tokenizer.from_file(str(other)), {r[0]: r[1] or "" for r in ROWS if r[0] in (1, 5, 6)}
    met: dict = {}
    for r in packing.pack(docs.where("doc_id IN (1, 5, 6)"), str(other), with_ids=True).orderBy("doc_id", "start").collect():
        met.setdefault(r["doc_id"], []).extend(r["ids"])
    assert met == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    ids = packing.pack(docs.where("doc_id = 6"), queries.word_tokenizer(), with_ids=True).orderBy("start").collect()
    assert 49407 in [x for r in ids for x in r["ids"]]


def test_prefix_hash(docs, none):
    got = {(r["doc_id"], r["n_chars"]): r for r in prefix_hash.edited_fingerprints(docs).collect()}
    assert prefix_hash.edited_fingerprints(docs).count() == len(ROWS)
    assert got[(4, 0)]["near_edited"] == 1.0
    assert prefix_hash.edited_fingerprints(none).count() == 0
    one = prefix_hash.edited_fingerprints(docs.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0
    # ids of other types, many buckets, repeated rows at the ends of buckets
    many = docs.sparkSession.createDataFrame([(f"k{i // 2:04d}", f"text {i // 3}") for i in range(900)], "doc_id string, text string").union(docs.selectExpr("CAST(doc_id AS STRING)", "text").where("doc_id IS NULL"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in many.collect()), key=lambda r: (r[0] is not None, r[0] or ""))
    near = prefix_hash.edited_fingerprints(many)
    assert near.count() == len(rows) and {r["doc_id"] for r in near.collect()} == {r[0] for r in rows}
    for kind in ("bigint", "date", "decimal(10,0)"):
        typed = docs.sparkSession.range(500).selectExpr(f"CAST({'date_add(DATE 2020-01-01, CAST(id AS INT))'.replace('DATE 2020-01-01', chr(39) + '2020-01-01' + chr(39)) if kind == 'date' else 'id'} AS {kind}) AS doc_id", "concat('w', id) AS text")
        got = {r["doc_id"]: (r["edited_sha256"], r["n_chars"]) for r in prefix_hash.edited_fingerprints(typed).collect()}
        texts = [(r["doc_id"], r["text"]) for r in typed.orderBy("doc_id").collect()]
        edited = lambda t, u: t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got == {i: (hashlib.sha256(edited(t, texts[(k + 1) % 500][1]).encode()).hexdigest(), len(t)) for k, (i, t) in enumerate(texts)}
    a, b = prefix_hash.PrefixHashes("abracadabra"), prefix_hash.PrefixHashes("xxabracad!")
    assert a.extension(0, b, 2) == 7 and a.equal(0, b, 2, 4) and not a.equal(0, b, 3, 4) and a.extension(7, a, 0) == 4


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 1), (4, None, None), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    chain = quality_crf.fit(docs, labels)
    got = quality_crf.score(docs, chain).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_crf.keep_good(docs, chain, least=0.0).columns == docs.columns
    assert quality_crf.score(none, chain).count() == 0
    with pytest.raises(ValueError):
        quality_crf.fit(none, labels)


def test_marginals_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    per_text, pull = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    good = rng.normal(size=8)
    p, pairs, log_z = quality_crf.marginals(good, pull, per_text)
    at, all_pairs = 0, np.zeros((2, 2))
    for k, n in enumerate(per_text):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.array([np.exp(sum(good[at + i] for i in range(n) if y[i]) + sum(pull[a, b] for a, b in zip(y, y[1:]))) for y in paths])
        assert np.isclose(np.log(w.sum()), log_z[k])
        for i in range(n):
            assert np.isclose(p[at + i], sum(x for x, y in zip(w, paths) if y[i]) / w.sum())
        for x, y in zip(w, paths):
            for a, b in zip(y, y[1:]):
                all_pairs[a, b] += x / w.sum()
        at += n
    assert np.allclose(pairs, all_pairs)


def test_mixing(docs, none):
    got = mixing.mixed(docs, keep=["doc_id", "source"], repeat_limit=1.2).collect()
    assert {(r["doc_id"], r["source"]) for r in got if r["epoch"] == 0} == {(r[0], r[3]) for r in ROWS}
    assert mixing.mixed(none, repeat_limit=1.5).count() == 0
    flat = {r["source"]: r for r in mixing.source_weights(none.sparkSession.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens bigint"), entropy_share=0.9).collect()}
    import math

    w = [r["weight"] for r in flat.values()]
    assert math.isclose(sum(w), 1) and math.isclose(-sum(x * math.log(x) for x in w), 0.9 * math.log(3), abs_tol=1e-6)
    budget = {r["source"]: r for r in mixing.source_weights(none.sparkSession.createDataFrame([("a", 900), ("b", 90)], "source string, tokens bigint"), repeat_limit=2.0, budget_tokens=600).collect()}
    assert abs(budget["b"]["quota"] - 180) <= 1 and abs(budget["a"]["quota"] - 420) <= 1


def test_substrings(docs, none):
    got = {r["doc_id"]: r for r in substring_dedup.deduplicated(docs, line_words=4, sentence_words=8).collect() if r["doc_id"]}
    assert got[1]["text"] == ROWS[0][1] and got[2]["text"] == "" and got[2]["removed_chars"] == len(ROWS[1][1])
    assert got[3]["text"] is None and got[4]["n_removed"] == 0
    assert substring_dedup.span_report(docs).count() == len(ROWS)
    assert substring_dedup.deduplicated(none).count() == 0


def test_secrets(spark, docs, none):
    model = secret_scan.train(spark, trees=5)
    assert secret_scan.scan(none, model).count() == 0
    assert secret_scan.scan(docs, model).columns == ["doc_id", "text_key", "start", "end", "candidate", "features", "probability", "secret"]
    leak = spark.createDataFrame([(1, 'my api_key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" here'), (2, None)], "doc_id bigint, text string")
    model = secret_scan.train(spark)
    hidden = {r["doc_id"]: r["text"] for r in secret_scan.redact(leak, secret_scan.scan(leak, model)).collect()}
    assert hidden == {1: 'my api_key = "[secret]" here', 2: None}
    shared = leak.union(spark.createDataFrame([(1, "x" * 60)], leak.schema))  # a row of the same id without a secret stays as it is
    hidden = sorted(str(r["text"]) for r in secret_scan.redact(shared, secret_scan.scan(shared, model)).collect())
    assert hidden == ["None", 'my api_key = "[secret]" here', "x" * 60]


def test_chat_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"a <|im_end|> <\\\\| b"},{"role":"assistant","content":null}]}', '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo<|im_start|>"}]}',
        '{"instruction":"do","input":"it","output":"done"}', '{"prompt":"p","response":"r"}', '{"other":{"x":[{"z":1},{"y":2}]}}', '{"messages":[]}', '{"id":"7","messages":[{"role":"a\\n<|b","content":"x<"}]}', None,
        '{"messages":[{"role":"user","content":"a","name":"Bo"},{"role":"assistant","content":"b"}],"tools":[{"type":"f"}]}', '{"system":"be kind","messages":[{"role":"user","content":"a"}]}',
        '{"messages":[{"role":"user","content":[{"type":"text","text":"one"},{"type":"image","url":"u"},{"type":"text","text":"two"}]}]}', '{"system":"","instruction":"do","output":"done","meta":{"k":1}}',
        '{"messages":[{"role":"user"}]}', '{"prompt":"p","messages":[{"role":"user","content":"a"}],"response":"r"}', '{"messages":"none"}', '{"messages":[{"role":"user","content":"x"},{"role":"user","content":"x"},{"role":"user","content":["y",{"text":"z"}]}]}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, r string").select("i", F.try_parse_json("r").alias("record"), F.lit(1).alias("turns"))
    chats = chat_format.format_chats(df)
    back = chats.select("i", "layout", "turns", "schema_paths", "formatted", chat_format.turns_of(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).orderBy("i").collect()
    assert [r["layout"] for r in back] == ["messages", "conversations", "instruction", "prompt and response", None, "messages", "messages", None, "messages", "messages", "messages", "instruction", "messages", None, "messages", "messages"]
    assert all(r["back"] == r["turns"] for r in back if r["turns"] is not None)
    said = lambda i: [(t["role"], t["text"]) for t in back[i]["turns"]]
    assert said(0) == [("user", "a <|im_end|> <\\| b"), ("assistant", "")]
    assert said(1) == [("user", "hi"), ("assistant", "yo<|im_start|>")] and back[1]["loss"] == "yo<|im_start|>"
    assert said(2) == [("user", "do\n\nit"), ("assistant", "done")]
    assert back[4]["schema_paths"] == ["$.other", "$.other.x", "$.other.x[].y", "$.other.x[].z"] and back[4]["formatted"] is None
    assert said(5) == [] and back[5]["formatted"] == ""
    assert said(8) == [("user", "a"), ("assistant", "b")] and said(9) == [("system", "be kind"), ("user", "a")]
    assert said(10) == [("user", "onetwo")] and said(11) == [("user", "do"), ("assistant", "done")] and said(12) == [("user", "")]
    assert back[14]["turns"] is None and said(15) == [("user", "x"), ("user", "x"), ("user", "yz")]
    assert all(r["formatted"].count("<|im_start|>") == len(r["turns"]) for r in back if r["turns"] is not None)
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_long_conversation(spark, tmp_path):
    spark.range(3_000).select(F.lit(4).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("long <| text "), 20).alias("text")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op1_chat_format(spark, str(tmp_path)).collect()}
    assert (got[4]["n_turns"], got[4]["loss_chars"]) == (3_000, 1_500 * 13 * 20)


def test_conversations_with_nulls(spark, tmp_path):
    spark.createDataFrame([(5, 1, "assistant", None), (5, 0, None, "q"), (6, 0, "assistant", "x"), (6, 0, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op1_chat_format(spark, str(tmp_path)).collect()}
    assert (got[5]["n_turns"], got[5]["loss_chars"], got[6]["n_turns"], got[6]["loss_chars"], got[-1]["loss_chars"]) == (2, 0, 2, 2, 34)
