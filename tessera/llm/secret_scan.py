"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is the value after a name that announces a secret (6 or more signs, none of them white space), whatever its letters, or else a run
of 16 or more characters of the base64, hexadecimal and name alphabets that isn't plain lower-case, upper-case or capitalised letters; a
name and '=' before a value are no part of it. Features: length, class shares, class changes between neighbouring characters, entropy and mean surprise of its
character transitions, dictionary coverage (both from a `Language`: a fixed list of words of code and placeholders, and, with `language`, the words that the corpus itself has often), signs of a path or an address, and words beside it that
announce secrets or, on the other hand, digests, ids and examples. The forest (Spark ML) is trained on labelled findings.

`labelled_findings` makes a seeded set of known kinds (default 4,000 rows, the documented bound); a user's own reviewed findings, in
the same columns, go into `train` in its place or beside it.

Defined cases: null text is empty and has no candidates; candidates that overlap the same place occur once; repeated rows are
reported each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, text_of

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=\-]{16,}")
NEAR = 48
_NAME = r"(?:token|secret|passw(?:or)?d|pwd|passphrase|api[_\-]?key|credential|auth|bearer|private|key)"
# (a whole name is taken at once, from its first sign on, however long it is)
ANNOUNCED = re.compile(rf"(?<![A-Za-z0-9_\-])(?>[A-Za-z0-9_\-]*?{_NAME}[A-Za-z0-9_\-]*+)[\"'`]?[ \t]*(?::=|=>|=|:)[ \t]*(?:\"([^\s\"]{{6,}})\"|'([^\s']{{6,}})'|`([^\s`]{{6,}})`|([^\s\"'`]{{6,}}))", re.I)
_NAMED = re.compile(r"[A-Za-z_][A-Za-z0-9_\-]*=(?=[^=]{8})")
# Words that announce a secret, words that announce something else, words that occur in placeholders and names.
ANNOUNCE = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private", "credential", "auth", "bearer", "client_secret", "key")
OTHERWISE = ("sha", "sha1", "sha256", "md5", "digest", "checksum", "commit", "revision", "uuid", "guid", "etag", "hash", "id", "fingerprint", "example", "sample", "version", "build", "card", "phone", "isbn", "account", "iban")
DICTIONARY = ("example", "sample", "test", "your", "here", "change", "change_me", "placeholder", "default", "password", "secret", "token", "dummy", "fake", "value", "insert", "config", "application", "service", "settings", "static", "assets", "image", "images", "index", "main", "module", "package", "function", "class", "model", "controller", "component", "public", "private", "internal", "version", "release", "library", "system", "network", "server", "client", "request", "response", "handler", "manager", "factory", "builder", "context", "process", "database", "connection", "session", "object", "string", "number", "array", "license", "information", "national", "international", "the", "and", "for", "with", "tion", "ment", "ing")
PLAIN = ("optional", "missing", "invalid", "enabled", "disabled", "unknown", "expired", "available", "protected", "management", "security", "difference", "question", "finding", "people", "remember", "something", "together", "changed", "reset", "strength", "policy", "authority", "generated", "rotated", "stored", "encrypted", "authentication", "understanding", "however", "nothing", "length", "minimum", "character", "letters", "forever", "repeated", "business", "research", "learning", "quality", "government")
FEATURES = ["length", "lower", "upper", "digit", "mark", "hex", "changes", "entropy", "surprise", "coverage", "longest_word", "repeat", "path", "address", "assigned", "quoted", "announce", "otherwise", "digits_only"]
_WORDS_ONLY = re.compile(r"[A-Z]?[a-z]+|[a-z]+")


@dataclass(frozen=True)
class Language:
    """Words of three letters or more, and log2 probabilities of letter pairs in them (26: what is no letter), with one added to each count."""

    words: frozenset[str]
    pairs: np.ndarray

    @classmethod
    def of(cls, words) -> Language:
        counts = np.ones((27, 27))
        for word in sorted(words):
            codes = [26, *(ord(c) - 97 if "a" <= c <= "z" else 26 for c in word), 26]
            for a, b in zip(codes, codes[1:]):
                counts[a, b] += 1
        return cls(frozenset(words), np.log2(counts / counts.sum(axis=1, keepdims=True)))

    def found(self, low: str) -> list[str]:
        """Words in a lower-case text from left to right, the longest at each place."""
        out, i = [], 0
        while i < len(low) - 2:
            word = next((low[i : i + n] for n in range(min(20, len(low) - i), 2, -1) if low[i : i + n] in self.words), None)
            out += [word] if word else []
            i += len(word) if word else 1
        return out


PLAIN_WORDS = Language.of(DICTIONARY)


def language(docs: DataFrame, text_col: str = "text", most: int = 20_000, least: int = 20, letters: int = 5) -> Language:
    """PLAIN_WORDS and the words of `letters` letters or more, of any script, that at least `least` texts of the corpus have, at most the `most` that most have (what is collected)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(rf"(?<![\p{{L}}\p{{N}}])\p{{L}}{{{letters},20}}(?![\p{{L}}\p{{N}}])"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").count().where(F.col("count") >= least)
    return Language.of({*DICTIONARY, *counts.orderBy(F.desc("count"), "w").limit(most).select("w").toPandas()["w"]})


def features(candidate: str, left: str, right: str, lang: Language = PLAIN_WORDS) -> list[float]:
    n = len(candidate)
    low = candidate.lower()
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in candidate]
    share = [kinds.count(k) / n for k in range(4)]
    tally = [candidate.count(c) / n for c in set(candidate)]
    codes = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in low]
    found = lang.found(low)
    beside, after = left.lower()[-NEAR:], right.lower()[:NEAR]
    words = re.findall(r"[a-z_\-0-9]+", beside[-32:])[-3:] + re.findall(r"[a-z_\-0-9]+", after)[:1]
    return [
        float(n), *share, sum(c in "0123456789abcdef" for c in low) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, -sum(p * math.log2(p) for p in tally),
        -float(np.mean(lang.pairs[codes[:-1], codes[1:]])), sum(map(len, found)) / n, max(map(len, found), default=0) / n,
        sum(a == b for a, b in zip(candidate, candidate[1:])) / n, float(candidate.count("/") > 1 or beside.endswith(("/", "\\"))),
        float("://" in beside or "www." in beside or "@" in beside[-8:] or after.startswith("@")),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", beside))), float(beside[-1:] in "\"'`" and beside != ""),
        float(any(w.strip("-_") in ANNOUNCE or any(a in w for a in ANNOUNCE if len(a) > 4) for w in words)),
        float(any(w in OTHERWISE for w in words)), float(candidate.isdigit()),
    ]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    spans, found = [], []  # spans: with the names before the values
    for m in ANNOUNCED.finditer(text):
        a, b = m.span(m.lastindex)
        if m.lastindex == 4:  # without quotes: marks of the sentence around it go
            b = a + len(text[a:b].rstrip(".,;:)]}>"))
        if b - a >= 6:
            spans.append((m.start(), b))
            found.append((a, b))
    k = 0
    for m in CANDIDATE.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        # plain words, and rules made of one sign, are none; nor is what overlaps a value or the name before it
        if k < len(spans) and spans[k][0] < m.end():
            continue
        if not _WORDS_ONLY.fullmatch(m[0]) and not m[0].isupper() and len(set(m[0])) > 2 or m[0].isupper() and any(c.isdigit() for c in m[0]):
            named = _NAMED.match(m[0])
            found.append((m.start() + (named.end() if named else 0), m.end()))
    return iter(sorted(found))


def labelled_findings(rows: int = 4_000, seed: int = 7, lang: Language = PLAIN_WORDS) -> list[tuple[str, str, str, int]]:
    """(candidate, left, right, label) of seeded known kinds, cut by candidates(); half are secrets. A third of the plain words are the language's own."""
    r = random.Random(seed)
    own = sorted(lang.words.difference(DICTIONARY)) or list(PLAIN)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = [w[i : i + 3] for w in DICTIONARY for i in range(0, max(1, len(w) - 2), 2)]
    prose = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 6)))
    out = []

    def add(value: str, left: str, right: str, label: int) -> None:
        """The candidate that overlaps the value as it stands in its text, or the value itself."""
        text, begin, end = left + value + right, len(left), len(left) + len(value)
        a, b = next(((a, b) for a, b in candidates(text) if a < end and b > begin), (begin, end))
        out.append((text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], label))

    def password() -> str:
        word = r.choice(DICTIONARY + ("troubador", "dragon", "summer", "monkey")).translate(str.maketrans("aeio", r.choice(("4310", "@3!0", "43io"))))
        return word.capitalize() + r.choice("!&#$%@*") + pick("0123456789", r.randint(1, 4)) + r.choice(("", pick(b64 + "!#", r.randint(3, 9))))

    for i in range(rows):
        if i % 2:
            name = r.choice(("token", "api_key", "apikey", "secret", "password", "access_token", "client_secret", "auth_token", "SECRET_KEY", "aws_secret_access_key", "bearer"))
            sign = r.choice((" = ", "=", ": ", " := ", ' = "', '="', ': "', " ", "='"))
            value = r.choice((lambda: pick(hexa, r.choice((32, 40, 40, 64))), lambda: pick(b64, r.randint(20, 44)), lambda: "AKIA" + pick(b64[:26] + b64[52:], 16), lambda: "ghp_" + pick(b64, 36), lambda: pick(b64 + "+/", 40), lambda: "sk_live_" + pick(b64, 24), password, lambda: pick(b64 + "!#$%&*+-.:?@^_~", r.randint(9, 24)), lambda: pick(b64[26:52], r.randint(12, 28)), lambda: pick(b64[:26], r.randint(12, 28)), lambda: pick(hexa, r.randint(10, 16))))()
            quote = sign[-1] if sign[-1] in "\"'" else r.choice(("", ";"))
            add(value, f"{prose()} {name}{sign}", quote + " " + prose(), 1)
            continue
        kind = r.randrange(15)
        left, right = prose() + " ", " " + prose()
        if kind == 0:
            value, left = pick(hexa, r.choice((32, 40, 64))), left + r.choice(("commit ", "sha256: ", "md5 ", "checksum = ", "digest: ", "revision "))
        elif kind == 1:
            value, left = "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), left + r.choice(("uuid ", "id: ", "guid=", ""))
        elif kind == 2:
            value, left = pick("0123456789", r.randint(16, 20)), left + r.choice(("", "account ", "card ", "id "))
        elif kind == 3:
            value, left = "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))), left + r.choice(("/", "https://", "./", "C:/"))
        elif kind == 4:
            value = r.choice("-_").join(r.choice(DICTIONARY) for _ in range(r.randint(3, 5))) + "-words"
        elif kind == 5:
            value, left = r.choice(("your_api_key_here", "example_token_value", "change_me_password", "xxxxxxxxxxxxxxxxxxxx-xxxx", "dummy_secret_value_123", "0000000000000000abcd", "test_token_placeholder")), left + r.choice(("token = ", "api_key: ", 'password = "', "secret="))
        elif kind == 6:
            value = r.choice(DICTIONARY) + "".join(r.choice(DICTIONARY).capitalize() for _ in range(r.randint(3, 5)))
        elif kind == 7:
            value, left = "=" * 8 + r.choice(DICTIONARY) + "-" * 8, left
        elif kind >= 9:  # names before plain words, places of a value, code
            value = r.choice((lambda: r.choice(PLAIN), lambda: r.choice(own), lambda: r.choice(PLAIN).capitalize(), lambda: r.choice(own) + r.choice(own), lambda: r.choice(DICTIONARY) + r.choice(("", "s", "ed", "-")), lambda: "".join(r.choice(DICTIONARY) for _ in range(2)), lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 5))), lambda: "${" + r.choice(DICTIONARY).upper() + "_KEY}", lambda: "<" + r.choice(DICTIONARY) + "-" + r.choice(DICTIONARY) + ">", lambda: "get_" + r.choice(DICTIONARY) + "()", lambda: "https://" + r.choice(DICTIONARY) + ".org/" + r.choice(DICTIONARY), lambda: "********"))()
            value, left = value.ljust(6, "s"), left + r.choice(("password: ", "key: ", "token = ", "secret: ", "api_key=", "auth: ", "pwd: ", 'password = "'))
            right = ('"' if left.endswith('"') else "") + right
        else:
            value = "".join(r.choice(syllables) for _ in range(r.randint(5, 9))) + r.choice(("-", "_", "=", "/")) + "".join(r.choice(syllables) for _ in range(2)) + "word"
        add(value, left, right, 0)
    return out


def train(spark: SparkSession, findings=None, trees: int = 40, depth: int = 8, seed: int = 1, lang: Language = PLAIN_WORDS):
    """Random forest model, for one language, from (candidate, left, right, label) rows, a list or a DataFrame of reviewed findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    if isinstance(findings, DataFrame):
        rows = findings.select("candidate", "left", "right", "label").mapInPandas(_described(lang), f"{_SCHEMA}, label double")
    else:
        known = labelled_findings(lang=lang) if findings is None else findings
        rows = spark.createDataFrame([(features(c, a, b, lang), float(y)) for c, a, b, y in known], "features array<double>, label double")
    rows = rows.select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


_SCHEMA = "features array<double>"


def _described(lang: Language):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"features": [features(*x, lang) for x in zip(b["candidate"].fillna(""), b["left"].fillna(""), b["right"].fillna(""), strict=True)], "label": b["label"].astype(float)})

    return run


def scan(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", lang: Language = PLAIN_WORDS) -> DataFrame:
    """One row per candidate: id, text_key (a hash of the text), start, end, candidate, features, probability (of a secret), secret."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, key, text in zip(batch["id"], batch["text_key"], batch["text"], strict=True):
                for a, b in candidates(text):
                    for column, x in zip(rows, (doc, key, a, b, text[a:b], features(text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], lang)), strict=True):
                        column.append(x)
            out = pd.DataFrame(dict(zip(("id", "text_key", "start", "end", "candidate", "features"), rows, strict=True)))
            yield out.astype({"id": object, "candidate": object, "features": object})  # also where there are none

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text"))
    found = in_batches(rows, run, "text_key bigint, start bigint, end bigint, candidate string, features array<double>")
    scored = model.transform(found.withColumn("_v", array_to_vector("features")).withColumnRenamed("features", "_f").withColumnRenamed("_v", "features"))
    p = vector_to_array("probability")[1]
    return scored.select(F.col("id").alias(id_col), "text_key", "start", "end", "candidate", F.col("_f").alias("features"), p.alias("probability"), (p >= 0.5).alias("secret"))


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with the findings marked as secrets replaced. Rows that share an id are told apart by their texts."""
    spans = findings.where("secret").groupBy(F.col(id_col).alias("_of"), F.col("text_key").alias("_tk")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_s"))
    text = text_of(text_col)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_s", lambda x: x["end"]))
    begins = F.concat(F.transform("_s", lambda x: x["start"]), F.array(F.length(text).cast("long")))
    new = F.array_join(F.zip_with(ends, begins, lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))), mark)
    same = F.col(id_col).eqNullSafe(F.col("_of")) & (F.xxhash64(text) == F.col("_tk"))
    return docs.join(spans, same, "left").withColumn(text_col, F.when(F.col("_s").isNotNull(), new).otherwise(F.col(text_col))).drop("_of", "_tk", "_s")
