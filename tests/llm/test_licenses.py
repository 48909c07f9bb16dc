"""License scans against a version without gate and with suppression by comparing all pairs."""

import random
import re

import duckdb
import pytest
from llm_cases import EDGE_TEXTS, edge_docs, no_docs

from riskframe.llm import licenses
from riskframe.llm.license_rules import BASE, read_rules

SF = "/root/testdata/sf0.001"
RULES = read_rules()
SCANNER = licenses.Scanner()
PATTERNS = [re.compile(r.pattern.pattern.decode()) for r in RULES]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_by_hand(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def scan_by_hand(text):
    found = words_by_hand(text)
    line, base = " ".join(found), []
    for phrase, label in BASE:
        p = phrase.split()
        base += [(k, label) for k in range(len(found)) if found[k : k + len(p)] == p]
    every = []
    for k, rule in enumerate(RULES):
        for m in PATTERNS[k].finditer(line):
            version = (m["v"] or "x").replace(" ", ".").lstrip("v") if "{v}" in rule.label else ""
            first = line[: m.start()].count(" ")
            every.append((first, first + m[0].count(" "), k, rule.label.replace("{v}", version)))
    kept = [a for a in every if not any(b[0] <= a[0] and b[1] >= a[1] and (b[2], b[0], -b[1]) < (a[2], a[0], -a[1]) for b in every)]
    return len(found), sorted(base), sorted(kept)


def seen(text):
    n, base, finds = SCANNER.scan((text or "").encode())
    return n, base, sorted((f.first, f.last, f.rule, f.label) for f in finds)


def sample_of(pattern, rng):
    """A text that the pattern matches, by taking its options at random."""
    p = pattern.removeprefix("(?<![^ ])(?:").removesuffix(")(?![^ ])")
    while True:
        m = re.search(r"\((?:\?:|\?P<v>)([^()]*)\)(\?|\{\d+,\d+\}|\+)?", p)
        if not m:
            break
        body = rng.choice(m[1].split("|")).replace("[^ ]+", "word")
        times = rng.randint(0, 1) if m[2] == "?" else rng.randint(*map(int, m[2][1:-1].split(","))) if m[2] else 1
        p = p[: m.start()] + body * times + p[m.end() :]
    p = re.sub(r"\[([^]]+)\]\?", lambda m: rng.choice(["", m[1][0]]), p)
    p = re.sub(r"\[([^]]+)\]", lambda m: m[1][0], p)
    return re.sub(r"([a-z0 ])\?", lambda m: rng.choice(["", m[1]]), p)


def test_rules_are_many_gated_and_bounded():
    assert len(RULES) > 250 and all(r.keywords for r in RULES)
    assert all(0 < r.strength <= 1 for r in RULES) and {"*", "+ "}.isdisjoint(re.sub(r"\[\^ \]\+", "", r.pattern.pattern.decode()) for r in RULES)


def test_every_rule_finds_its_texts_and_the_gate_loses_none():
    rng = random.Random(5)
    for k, rule in enumerate(RULES):
        for _ in range(6):
            text = sample_of(rule.pattern.pattern.decode(), rng)
            assert rule.pattern.search(text.encode()), (rule.label, text)
            framed = f"// {text.replace(' ', rng.choice([' ', chr(10) + ' * ', '-']))}. other words"
            assert seen(framed) == scan_by_hand(framed), framed
            assert any(f[2] <= k for f in seen(framed)[2])


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY-NC 4.0", ["cc-by-nc-4.0"]),
        ("licensed under the GNU General Public License, version 3", ["gpl-3"]),
        ("# under the terms of the GNU General Public License\n# as published by the Free Software Foundation; either version 2 of\n# the License, or (at your option) any later version", ["gpl-2-or-later"]),
        ("Released under the MIT License", ["mit"]),
        ("SPDX-License-Identifier: BSD-3-Clause-Clear", ["bsd-3-clause-clear"]),
        ("https://creativecommons.org/licenses/by-sa/3.0/ and the MIT license", ["cc-by-sa-3.0", "mit"]),
        ("GPLv2 or LGPL v2.1", ["gpl-2", "lgpl-2.1"]),
        ("© 2019 Someone. Alle Rechte vorbehalten", ["copyright", "reserved"]),
        ("the general public of a free country with a license to roam", []),
        ("apache county, mit dem Wind, isc, zlib", []),
    ],
)
def test_labels(text, labels):
    assert [f[3] for f in seen(text)[2]] == labels and seen(text) == scan_by_hand(text)


def test_suppression_of_random_intervals():
    rng = random.Random(8)
    for _ in range(400):
        finds = []
        for _ in range(rng.randint(0, 25)):
            first = rng.randint(0, 12)
            finds.append(licenses.Find(first, first + rng.randint(0, 8), rng.randint(0, 5), ""))
        key = lambda f: (f.rule, f.first, -f.last)
        want = {a for a in finds if not any(b.first <= a.first and b.last >= a.last and key(b) < key(a) for b in finds)}
        assert set(licenses.outermost(finds)) == want


def test_edge_texts(spark):
    long = " ".join(["word " * 50 + "Apache License, Version 2.0; all rights reserved. "] * 3000)
    texts = [*EDGE_TEXTS, (20, long), (21, "ALL RIGHTS RESERVED"), (21, "ALL RIGHTS RESERVED"), (22, "all rights reserved"), (23, "CC-BY cc by CC\nBY")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, base, finds = scan_by_hand(r["text"]) if r["doc_id"] != 20 else (None, None, None)
        if n is None:
            assert r["n_base"] == 3000 and r["labels"] == "apache-2.0,reserved" and r["score"] == 0.9
            continue
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert r["labels"] == ",".join(sorted({x for _, x in base} | {f[3] for f in finds}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    clash = licenses.scan(edge_docs(spark))
    assert clash.columns.count("score") == 1 and clash.count() == len(EDGE_TEXTS)
    assert licenses.scan(no_docs(spark)).collect() == []


BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT * FROM (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) t(p, label)
), f AS (
  SELECT doc_id, label, k FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) + 1)) AS k FROM w, p) WHERE w[k : k + len(p) - 1] = p
)
SELECT w.doc_id, len(w.w) AS n_words, count(f.k) AS n_base, min(f.k) - 1 AS first_word, max(f.k) - 1 AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN f USING (doc_id) GROUP BY w.doc_id, w.w
"""


def test_query_by_sql_and_by_hand(spark):
    """The base columns against SQL, labels against the version without gate, on all documents."""
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = licenses.op12_licenses(spark, SF).collect()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert sorted(str(tuple(r[n] for n in names)) for r in rows) == sorted(map(str, duck.execute(BASE_SQL).fetchall()))
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in rows:
        _, base, finds = scan_by_hand(texts[r["doc_id"]])
        assert r["labels"] == ",".join(sorted({x for _, x in base} | {f[3] for f in finds}))
