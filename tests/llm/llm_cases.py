"""Rows and brute-force versions that the tests of this folder share."""

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=60, words="the of and house garden river stone light water road tree wind hill field rain".split()):
    """Deterministic words without chance repeats of long runs."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(words[(x >> 8) % len(words)] + str((x >> 4) % 97))
    return " ".join(out)


EDGE_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one"),
    (None, prose(5)),
    (None, prose(5)),
    (6, prose(5)),
    (6, prose(9)),
    (7, "é ß 漢字 🙂 \x00 İΣ"),
    (8, prose(11, 40_000)),
    (9, "x" * 70_000),
    (10, " ".join(["same"] * 500)),
    (11, "!!! ??? 123"),
]


def edge_docs(spark):
    """Null, empty, long and repeated texts, with extra columns named like columns of the operators."""
    rows = [(i, t, None if t is None else len(t)) for i, t in EDGE_TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    clash = ["score", "n", "node", "token", "content", "comp", "Kept", "spans", "ids", "lang", "block", "a", "hit_starts", "N_TOKENS"]
    return docs.withColumns({c: F.lit("mine") for c in clash}).withColumn("source", F.lit("s"))


def no_docs(spark):
    return edge_docs(spark).where("false")


def shingles(text):
    words = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def near_components(rows):
    """Component of each row number, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(rows))], sets
