"""Substring dedup: passages of over 50 words made of short pieces."""

from tessera.llm import substring_dedup


def test_passages_of_short_pieces(spark):
    words = [f"w{i}" for i in range(400)]
    short = " ".join(f"{words[3 * i]} {words[3 * i + 1]} {words[3 * i + 2]}." for i in range(20))  # 60 words in one line
    lines = "\n".join(f"{words[100 + 2 * i]} {words[101 + 2 * i]}" for i in range(30))  # 60 words in lines of two
    few = " ".join(f"{words[300 + 3 * i]} {words[301 + 3 * i]} {words[302 + 3 * i]}." for i in range(10))  # 30 words: too short a passage
    mixed = "One two. Three four five six seven eight nine ten eleven. " + " ".join(f"x{i} y{i}." for i in range(22)) + " Last one of these has many words in it."
    texts, passages = [], [short, lines, few, mixed]
    for k, p in enumerate(passages):
        texts += [f"Own start {k}a here. {p} Own end {k}a.", f"Other beginning {k}b. {p} Other end {k}b, differing."]
    texts.append("Yes. No. " * 10 + "apart")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][x["start"] : x["end"]] for x in r["removed"]] for r in substring_dedup.span_report(docs).collect()}
    assert got[1] == [short] and got[7] == [mixed]
    assert got[3] == ["\n".join(lines.split("\n")[:-1])]  # the last line goes on with other words: cut mid-unit
    assert all(got[i] == [] for i in (0, 2, 4, 5, 6, 8))
    twice = docs.union(docs)  # equal rows are one document
    assert {(r["doc_id"], r["n_removed"]) for r in substring_dedup.span_report(twice).collect()} == {(i, len(x)) for i, x in got.items()}
