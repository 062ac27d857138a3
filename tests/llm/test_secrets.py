"""Values after announcing names are candidates, whatever their length and signs, with offsets of the value alone."""

from tessera.llm import secret_scan

LEAKS = [('password = "', "Tr0ub4dor&3", '"'), ("pwd: ", "S3cr3t!2024xyzAB#kd9", ""), ('api_key = "', "qwkzjxvbnmplokijuhyg", '"'), ("secret: ", "KJHGQWERTYUIOPLMNBVC", ""), ("use token=", "9f8a7b6c5d4e", ", then")]


def test_announced_values(spark):
    texts = [f"see {a}{v}{b} end" for a, v, b in LEAKS]
    assert [[t[a:b] for a, b in secret_scan.candidates(t)] for t in texts] == [[v] for _, v, _ in LEAKS]
    plain = ["password: required for everyone", "the key: information"]
    docs = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id bigint, text string")
    found = secret_scan.scan(docs, secret_scan.train(spark)).where("secret").collect()
    assert sorted((r["doc_id"], r["candidate"]) for r in found) == [(i, v) for i, (_, v, _) in enumerate(LEAKS)]


def test_findings_are_cut_as_in_texts():
    for c, left, right, _ in secret_scan.labelled_findings(400):
        assert not c.startswith(("token=", "password=", "secret=", "api_key="))


def test_held_out_findings(spark):
    """Findings of another seed than the training's: how many secrets are kept, how much of what is kept is one."""
    model = secret_scan.train(spark)
    unseen = secret_scan.labelled_findings(2_000, seed=99)
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([(secret_scan.features(c, a, b), y) for c, a, b, y in unseen], "f array<double>, label int").select(array_to_vector("f").alias("features"), "label")
    said = [(int(r["prediction"]), r["label"]) for r in model.transform(rows).select("prediction", "label").collect()]
    kept, true = sum(p for p, _ in said), sum(y for _, y in said)
    both = sum(p and y for p, y in said)
    print("recall", both / true, "precision", both / kept)
    assert both / true > 0.95 and both / kept > 0.9


def test_words_of_the_corpus(spark):
    """Words that the corpus has often count as words; a rare string doesn't become one."""
    docs = spark.createDataFrame([(i, f"Wolnkrath veshtimor und blargenheit zusammen {'qxzvkwpjrt' * (i == 3)}") for i in range(40)] + [(99, None)], "doc_id bigint, text string")
    lang = secret_scan.language(docs)
    assert {"wolnkrath", "veshtimor", "blargenheit"} < lang.words and "qxzvkwpjrt" not in lang.words
    assert lang.found("wolnkrathveshtimorxq") == ["wolnkrath", "veshtimor"] and secret_scan.PLAIN_WORDS.found("blargenheit") == []
    texts = ['token = "wolnkrathveshtimor"', 'token = "blargenheit"', 'token = "qxzvkwpjrtmlbdhgwq"', 'token = "9f86d081884c7d659a2feaa0c55ad015"']
    found = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), secret_scan.train(spark, lang=lang), lang=lang)
    assert {r["doc_id"] for r in found.where("secret").collect()} == {2, 3}
    assert secret_scan.language(docs.where("false")).words == secret_scan.PLAIN_WORDS.words


def test_features_and_votes_by_hand(spark):
    """Features are counted anew from their definitions, and each tree is walked from its root: the mean of the leaves' shares is the probability."""
    import math

    findings = secret_scan.labelled_findings(400)
    model = secret_scan.train(spark, findings, trees=7, depth=5)
    unseen = secret_scan.labelled_findings(30, seed=11)
    texts = [left + c + right for c, left, right, _ in unseen]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = secret_scan.scan(docs, model).collect()
    assert len(rows) >= 30

    def walk(node, x):
        while node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)

    roots = [t._java_obj.rootNode() for t in model.trees]
    for r in rows:
        c, x, text = r["candidate"], r["features"], texts[r["doc_id"]]
        assert text[r["start"] : r["end"]] == c
        named = dict(zip(secret_scan.FEATURES, x, strict=True))
        n = len(c)
        assert named["length"] == n
        for name, test in (("lower", str.islower), ("upper", str.isupper), ("digit", str.isdigit)):
            assert math.isclose(named[name], sum(map(test, c)) / n)
        assert math.isclose(named["hex"], sum(s in "0123456789abcdef" for s in c.lower()) / n)
        assert math.isclose(named["entropy"], -sum(c.count(s) / n * math.log2(c.count(s) / n) for s in set(c)), abs_tol=1e-12)
        pairs = [(0 if s.islower() else 1 if s.isupper() else 2 if s.isdigit() else 3) for s in c]
        assert math.isclose(named["changes"], sum(a != b for a, b in zip(pairs, pairs[1:])) / n)
        assert named["digits_only"] == float(c.isdigit()) and named["repeat"] == sum(a == b for a, b in zip(c, c[1:])) / n
        p = sum(walk(root, x) for root in roots) / len(roots)
        assert math.isclose(r["probability"], p, abs_tol=1e-9) and r["secret"] == (p >= 0.5)


def test_planted_findings_of_the_documents(spark):
    """Documents hold values of a token (hexadecimal, quoted), which are secrets, and numbers of cards, which are not: kinds that were planted by others, told apart by a rule over the text."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = secret_scan.language(docs)
    found = secret_scan.scan(docs, secret_scan.train(spark, lang=lang), lang=lang).select("doc_id", "start", "candidate", "secret").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    tokens = {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t, re.I)}
    kept = {(r["doc_id"], r["start"]) for r in found if r["secret"]}
    assert len(tokens) > 10 and tokens <= kept  # recall 1
    cards = [r["secret"] for r in found if re.fullmatch("[0-9]{13,19}", r["candidate"])]
    assert cards and not any(cards)
    assert len(tokens) / len(kept) > 0.9  # precision
