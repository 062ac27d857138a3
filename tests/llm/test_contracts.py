"""The operators' queries against brute force, on the smallest tables."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
    from oracle import same

    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_op2(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op2_prefix_hash(spark, SF).collect()}
    ids = sorted(docs)
    assert sorted(rows) == ids
    for i, n in zip(ids, [*ids[1:], ids[0]]):
        text, after = docs[i], docs[n]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["common_prefix"] == len(os.path.commonprefix([text, edited]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["near_next"] == 1 or text != after
        assert r["edited_fingerprint"] != r["fingerprint"] or text == edited
    by_text = {}
    for i in ids:
        assert by_text.setdefault(docs[i], rows[i]["fingerprint"]) == rows[i]["fingerprint"]
    long = [i for i in ids if len(docs[i]) > 400]
    assert np.mean([rows[i]["near_edited"] for i in long]) > 0.35
    assert np.median([rows[i]["near_next"] for i in long]) < 0.1


def test_op2_by_hand(spark, docs):
    """Fingerprints and likenesses of some documents from big integers alone, window by window."""
    (p, q), (b, c) = (2147483647, 2147483629), (911382323, 972663749)

    def whole(points):
        x = sum((v + 1) * pow(b, j, p) for j, v in enumerate(points)) % p
        return x << 31 | sum((v + 1) * pow(c, j, q) for j, v in enumerate(points)) % q

    def mixed(x):
        m = (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    def sketch(text):
        points, least = list(map(ord, text)), {}
        width = min(24, len(points))
        for i in range(max(1, len(points) - width + 1)):
            x = mixed(whole(points[i : i + width]))
            least[x % 128] = min(x >> 8, least.get(x % 128, 1 << 64))
        kept = [min(least[k] * 0x9E3779B97F4A7C15 % (1 << 64) >> 48, 0xFFFE) if k in least else 0xFFFF for k in range(128)]
        return f"{len(points):x}:{whole(points):016x}:" + "".join(f"{k:04x}" for k in kept), kept

    def like(x, y):
        if x[0].rsplit(":", 1)[0] == y[0].rsplit(":", 1)[0]:
            return 1.0
        used = [(u, v) for u, v in zip(x[1], y[1]) if (u, v) != (0xFFFF, 0xFFFF)]
        j = sum(u == v for u, v in used) / len(used) if used else 0.0
        return 2 * j / (1 + j)

    rows, ids = {r["doc_id"]: r for r in queries.op2_prefix_hash(spark, SF).collect()}, sorted(docs)
    some = [k for k in range(len(ids)) if len(docs[ids[k]]) < 1_500 and len(docs[ids[(k + 1) % len(ids)]]) < 1_500][:12]
    assert len(some) > 5
    for k in some:
        text, after = docs[ids[k]], docs[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        own, edit, following = sketch(text), sketch(text[: len(text) - half] + after[:half]), sketch(after)
        r = rows[ids[k]]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own[0], edit[0])
        assert r["near_edited"] == pytest.approx(like(own, edit)) and r["near_next"] == pytest.approx(like(own, following))


def test_op8(spark, docs):
    def fingerprint(text):
        w = WORD.findall(lowered(text))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = {r["doc_id"]: r for r in queries.op8_simhash(spark, SF).collect()}
    ids = sorted(docs)
    prints = np.array([fingerprint(docs[i]) for i in ids], np.uint64)
    assert [rows[i]["fingerprint"] for i in ids] == [f"{x:016x}" for x in prints]
    root = list(range(len(ids)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(ids)):
        for j in (np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3) + i + 1).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert [rows[i]["component_id"] for i in ids] == [ids[find(k)] for k in range(len(ids))]


def test_op9(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op9_quality_crf(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    unseen = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in unseen]) > 0.95


def test_op9_by_hand(spark, docs):
    """The query's scores from features counted line by line, the sample chosen by hand, and marginals by products of matrices."""
    from tessera.llm import quality_crf as Q

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    order = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i in labels], "doc_id bigint").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    chosen = sorted((i for i in labels if i in docs), key=lambda i: (order[i], i))
    chain = Q.fit_chain([docs[i] for i in chosen], np.array([labels[i] for i in chosen]))

    def features(line):
        data = line.encode()
        kind = lambda x: "l" if 97 <= x <= 122 else "u" if 65 <= x <= 90 else "d" if 48 <= x <= 57 else " " if x == 32 else "." if x < 128 and chr(x) in ".,;:?'\"()-" else "x" if x >= 128 else "c" if x < 32 else "m"
        k, n = [kind(x) for x in data], len(data)
        after, nxt = [*k[1:], "c"], [*data[1:], 10]
        some, words = max(n, 1), max(sum(a not in " c" and b in " c" for a, b in zip(k, after)), 1)
        pairs = lambda a, b: sum(x in a and y in b for x, y in zip(k, after))
        share = [k.count(x) / some for x in "lud .mx"]
        w = line.split(" ")
        return [*share, np.log1p(n) / 8, n / words / 20, pairs("m", "m") / words, pairs("m", " c") / words, pairs("u", "u") / some, sum(a == b and x == "l" for a, b, x in zip(data, nxt, k)) / some, pairs(".", " ") / words, pairs("l", "u") / words, float(n == 0), len(set(w)) / len(w)]

    rows = {r["doc_id"]: r for r in queries.op9_quality_crf(spark, SF).collect()}
    step = np.exp(chain.pull)
    for i in sorted(docs)[:40]:
        lines = docs[i].split("\n")
        x = np.array([features(s) for s in lines])
        zero = np.zeros((1, x.shape[1]))
        full = np.hstack([x, np.vstack([zero, x[:-1]]), np.vstack([x[1:], zero]), np.ones((len(x), 1))])
        good = np.exp(((full - chain.mean) / chain.scale) @ chain.w)
        ahead, back = [], [np.ones(2)]
        for g in good:
            v = np.array([1.0, g]) * (ahead[-1] @ step if ahead else np.ones(2))
            ahead.append(v / v.sum())
        for g in good[:0:-1]:
            v = step @ (np.array([1.0, g]) * back[-1])
            back.append(v / v.sum())
        p = [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, back[::-1])]
        weight = [max(len(s.encode()), 1) for s in lines]
        assert rows[i]["score"] == pytest.approx(np.dot(p, weight) / sum(weight), abs=1e-6), i


def test_op10(spark, docs):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(queries.word_tokenizer()), {}
    for r in queries.op10_packing(spark, SF).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    everything = [r for rs in rows.values() for r in rs]
    assert sorted(r["sequence_id"] for r in everything) == list(range(len(everything)))
    assert all(r["offset"] == 0 and bin(r["length"]).count("1") == 1 and r["length"] <= 2048 for r in everything)
    for i, text in docs.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], np.uint32)
        at = 0
        for r in sorted(rows[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def own_units(text, line_words=13, sentence_words=13):
    """(start, end, words) of lines and of sentences inside them, read sign by sign."""
    blank, out, begin = " \t\r\f\v", [], 0
    spans = []
    for line in [*text.split("\n")]:
        spans.append((begin, begin + len(line)))
        begin += len(line) + 1

    def trimmed(a, b):
        while a < b and text[a] in blank:
            a += 1
        while b > a and text[b - 1] in blank:
            b -= 1
        return a, b

    def words(a, b):
        return tuple(lowered(w) for w in WORD.findall(text[a:b]))

    for a, b in spans:
        whole = words(a, b)
        if len(whole) >= line_words:
            out.append((*trimmed(a, b), whole))
        if len(whole) <= sentence_words:
            continue
        at = a
        while at < b:
            while at < b and text[at] in ".!?":  # signs without a sentence before them
                at += 1
            end = at
            while end < b and text[end] not in ".!?":
                end += 1
            while end < b and text[end] in ".!?":
                end += 1
            inner = words(at, end)
            if sentence_words <= len(inner) < len(whole):
                out.append((*trimmed(at, end), inner))
            at = end
    return out


def own_pieces(text):
    """(start, end, words) of every sentence, in order; signs alone go with the later one."""
    out, begin = [], 0
    for line in text.split("\n"):
        at, held = begin, begin
        end_of_line = begin + len(line)
        while at < end_of_line:
            end = at
            while end < end_of_line and text[end] in ".!?":
                end += 1
            if end == end_of_line:
                break
            at = end
            while end < end_of_line and text[end] not in ".!?":
                end += 1
            while end < end_of_line and text[end] in ".!?":
                end += 1
            while end < end_of_line and text[end] in " \t\r\f\v":
                end += 1
            part = text[held:end]
            w = tuple(lowered(x) for x in WORD.findall(part))
            if w:
                left = held + len(part) - len(part.lstrip(" \t\r\f\v"))
                out.append((left, held + len(part.rstrip(" \t\r\f\v")), w))
            at = held = end
        begin = end_of_line + 1
    return out


def test_op6(spark, docs):
    """The earliest occurrence stays: plain dictionaries over units, and over pairs of neighbouring pieces, in the order of (doc_id, start)."""
    first, again, gone = {}, {}, {i: set() for i in docs}
    for i in sorted(docs):
        for a, b, data in sorted(own_units(docs[i]), key=lambda u: u[0]):
            if first.setdefault(("unit", data), (i, a)) != (i, a):
                gone[i].update(range(a, b))
        row = own_pieces(docs[i])
        for k, (x, y) in enumerate(zip(row, row[1:])):
            if first.setdefault(("pair", x[2], y[2]), (i, x[0])) != (i, x[0]):
                again.setdefault(i, set()).add(k)
    for i, marked in again.items():
        row = own_pieces(docs[i])
        for k in sorted(marked):
            if k - 1 not in marked:
                end = k
                while end + 1 in marked:
                    end += 1
                if sum(len(row[x][2]) for x in range(k, end + 2)) >= 50:
                    gone[i].update(range(row[k][0], row[end + 1][1]))
    rows = {r["doc_id"]: r for r in queries.op6_substring_dedup(spark, SF).collect()}
    for i in docs:
        spans = [tuple(map(int, s.split("-"))) for s in rows[i]["removed"].split(",") if s]
        got = {x for a, b in spans for x in range(a, b)}
        # neighbours that touch may be one span or two
        assert got == gone[i], i
        assert rows[i]["removed_chars"] == len(got)


def test_op4(spark, docs):
    found = queries.op4_secret_scan(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    got = {(r["doc_id"], r["start"], r["end"]) for r in found if r["secret"]}
    assert want <= got
    assert len(got - want) <= 0.1 * len(want) + 1


def test_op7(spark, docs):
    rows = queries.op7_mixing(spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    tokens = {i: len(WORD.findall(t)) for i, t in docs.items()}
    total = {}
    for i, s in source.items():
        total[s] = total.get(s, 0) + tokens[i]
    low, high = 0.0, 1.0
    rate = lambda a: {s: t ** (a - 1) for s, t in total.items()}
    for _ in range(60):
        mid = (low + high) / 2
        r = rate(mid)
        low, high = (mid, high) if max(r.values()) / min(r.values()) > 1.5 else (low, mid)
    r = rate(high)
    quota = {s: total[s] * r[s] / min(r.values()) for s in total}
    drawn, by_epoch = {}, {}
    for x in rows:
        drawn[x["source"]] = drawn.get(x["source"], 0) + x["n_tokens"]
        by_epoch.setdefault((x["source"], x["epoch"]), []).append(x)
        assert source[x["doc_id"]] == x["source"] and tokens[x["doc_id"]] == x["n_tokens"]
    assert {x["doc_id"] for x in rows if x["epoch"] == 0} == set(docs)
    longest = max(tokens.values())
    for s in total:
        assert quota[s] - 1 <= drawn[s] <= quota[s] + longest + 1, s
    for (s, e), xs in by_epoch.items():
        at = 0
        for x in sorted(xs, key=lambda x: (x["position"], x["n_tokens"])):
            assert x["position"] == at, (s, e)
            at += x["n_tokens"]
        assert len({x["doc_id"] for x in xs}) == len(xs)
