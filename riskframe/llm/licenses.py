"""License scans: ordered signature rules behind a keyword gate, with nested finds suppressed.

A text is read as words; line breaks, comment signs and punctuation do not matter. Of each rule the words that all its
matches hold are known (`license_rules.keywords`): a rule is tried only on texts that hold all of them, which the set of
the text's words tells at once, so most texts meet no pattern at all. Each find is an interval of words. A find inside
the interval of a find of a rule above its own is suppressed: "gnu general public license version 3" leaves no find of
its parts. Base phrases are counted apart and always keep their labels.

The score is the strength of the surest find that stays, `BASE_STRENGTH` where only base phrases are found, else 0.

Defined results: NULL, empty and word-less texts have no finds, no first and last word, empty labels and score 0; equal
intervals go to the rule above; finds of one rule do not overlap (leftmost first); repeated rows are scanned each.
Extra columns pass through; one named like an output is replaced. A narrow pass; a text is read whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskframe.llm.arrow import SLICE_BYTES, add_columns, as_bytes, narrow
from riskframe.llm.decontaminate import words
from riskframe.llm.license_rules import BASE, Rule, read_rules

BASE_STRENGTH = 0.5


@dataclass(frozen=True)
class Find:
    """Words first..last (from 0, inclusive) found by the rule number `rule`."""

    first: int
    last: int
    rule: int
    label: str


def outermost(finds: Iterable[Find]) -> list[Find]:
    """The finds that lie in no find of a rule above their own (or, of one rule, in an equal one), in order of place.

    Rules are taken from the top; a tree over the first words holds the largest last word of the finds that stay. If a
    suppressed find holds another, what suppressed it holds that too, so finds that stay are enough.
    """
    order = sorted(set(finds), key=lambda f: (f.rule, f.first, -f.last))
    place = {w: k + 1 for k, w in enumerate(sorted({f.first for f in order}))}
    reach = [-1] * (len(place) + 1)
    kept = []
    for f in order:
        k, most = place[f.first], -1
        while k:
            most = max(most, reach[k])
            k &= k - 1
        if most >= f.last:
            continue
        kept.append(f)
        k = place[f.first]
        while k < len(reach):
            reach[k] = max(reach[k], f.last)
            k += k & -k
    return sorted(kept, key=lambda f: (f.first, f.last))


class Scanner:
    """Rules with their gate; lives in a task."""

    def __init__(self, rules: list[Rule] | None = None, base: tuple[tuple[str, str], ...] = BASE):
        self.rules = read_rules() if rules is None else rules
        self.base = [(re.compile(rf"(?<![^ ]){p}(?![^ ])".encode()), frozenset(p.encode().split()), label) for p, label in base]

    @cached_property
    def gate(self) -> dict[bytes, list[int]]:
        """Rules by one of their keywords: the one that the fewest rules share."""
        times: dict[bytes, int] = {}
        for rule in self.rules:
            for w in rule.keywords:
                times[w] = times.get(w, 0) + 1
        found: dict[bytes, list[int]] = {}
        for k, rule in enumerate(self.rules):
            found.setdefault(min(rule.keywords, key=lambda w: (times[w], w)), []).append(k)
        return found

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[Find]]:
        """Number of words, base places as (first word, label), and the finds that stay."""
        found = words(text)
        known = set(found)
        tried = [k for w in known & self.gate.keys() for k in self.gate[w] if self.rules[k].keywords <= known]
        phrases = [(pattern, label) for pattern, needed, label in self.base if needed <= known]
        if not tried and not phrases:
            return len(found), [], []
        line = b" ".join(found)
        starts = np.fromiter(accumulate((len(w) + 1 for w in found), initial=0), np.int64, len(found) + 1)
        word = lambda at: int(np.searchsorted(starts, at, "right")) - 1
        base = [(word(m.start()), label) for pattern, label in phrases for m in pattern.finditer(line)]
        finds = []
        for k in tried:
            for m in self.rules[k].pattern.finditer(line):
                label = self.rules[k].label
                if "{v}" in label:
                    version = (m["v"] or b"x").decode().replace(" ", ".")
                    label = label.replace("{v}", version.lstrip("v"))
                finds.append(Find(word(m.start()), word(m.end() - 1), k, label))
        return len(found), sorted(base), outermost(finds)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with the counts of base phrases, labels, score and the finds ("label:first:last", comma-joined)."""
    fields = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType())]
    fields += [("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("finds", T.StringType())]

    def start():
        scanner = Scanner()
        joined = lambda labels: ",".join(sorted(set(labels)))

        def run(part):
            out = [[] for _ in fields]
            for text in as_bytes(part, text_col):
                n, base, finds = scanner.scan(text)
                labels = [label for _, label in base]
                score = max([scanner.rules[f.rule].strength for f in finds] + [BASE_STRENGTH] * bool(base), default=0.0)
                row = [n, len(base), base[0][0] if base else None, base[-1][0] if base else None, joined(labels)]
                row += [joined([*labels, *(f.label for f in finds)]), score, ",".join(f"{f.label}:{f.first}:{f.last}" for f in finds)]
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return run

    return add_columns(df, text_col, fields, start, SLICE_BYTES)


def op12_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return scan(narrow(spark.read.parquet(f"{sf}/documents.parquet"))).drop("text")
