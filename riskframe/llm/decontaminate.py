"""Benchmark decontamination: windows of benchmark words, looked up in every text.

The windows (ten consecutive words of an item; an item of fewer words is one window) make a hash set that is
broadcast. Its source is measured first: items above `block_bytes` together are split into blocks of that size, and
the texts are passed over once per block, so no broadcast grows with the benchmark. In a text, words of the
benchmark's vocabulary become numbers, others break the run; rolling window hashes are looked up, each find is
verified word by word, and all words inside verified windows are hit.

Defined results: NULL and empty texts have no words and stay clean; items without words match nothing; equal items
each count; items with a NULL id count under the name "null"; repeated rows are each marked. Extra columns pass
through; one named like an output is replaced.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.arrow import SLICE_BYTES, add_columns, as_bytes, narrow
from riskframe.llm.hashing import mix, pieces
from riskframe.session import materialize

WINDOW = 10
BLOCK_BYTES = 16 << 20

#: Word bytes as they are, A-Z in lower case, all others to a space.
FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 text after lower-casing A-Z."""
    return text.translate(FOLD).split()


class Windows:
    """The hash set of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.of: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            numbers = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            size = min(window, len(numbers))
            for k in range(len(numbers) - size + 1 if size else 0):
                self.of.setdefault(tuple(numbers[k : k + size]), set()).add(name)
        self.salt = mix(np.arange(len(self.ids) + 1, dtype=np.uint64), 7) | np.uint64(1)
        self.hashes = {}
        for size in sorted({len(k) for k in self.of}):
            keys = np.array([k for k in self.of if len(k) == size], np.int64)
            self.hashes[size] = np.unique(self._roll(keys.T))

    def _roll(self, places) -> np.ndarray:
        total = np.zeros(len(places[0]), np.uint64)
        with np.errstate(over="ignore"):
            for column in places:
                total = total * np.uint64(0x9E3779B97F4A7C15) + self.salt[column]
        return total

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, verified windows as (first word, one past the last), and names of their items."""
        get = self.ids.get
        parts = []
        for piece in pieces(text.translate(FOLD)):
            found = piece.split()
            parts.append(np.fromiter(map(get, found, repeat(0)), np.int32, len(found)))
        numbers = np.concatenate(parts)
        hits, names = [], set()
        if numbers.any():
            breaks = np.concatenate([[0], np.cumsum(numbers == 0)])
            for size, known in self.hashes.items():
                if len(numbers) < size:
                    continue
                at = np.flatnonzero(breaks[size:] == breaks[:-size])
                if len(at):
                    rolled = self._roll([numbers[at + k] for k in range(size)])
                    near = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
                    for start in at[known[near] == rolled].tolist():
                        of = self.of.get(tuple(numbers[start : start + size].tolist()))
                        if of:
                            hits.append((start, start + size))
                            names |= of
        return len(numbers), hits, names


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items as lists of at most about `block_bytes` of text, one at a time."""
    slim = items.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("name"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).where("text != ''").distinct()  # copies of an item would all fall into one block
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // max(1, block_bytes // 2)))
    keyed = slim.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n))) if n > 1 else slim.withColumn("block", F.lit(0))
    for k in range(n):
        yield [(r["name"], r["text"].encode()) for r in keyed.where(F.col("block") == k).select("name", "text").collect()]


def mark(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with n_words, hit_starts and hit_ends (word ranges, merged, in order) and hit_items (sorted names)."""
    fields = [
        ("n_words", T.LongType()),
        ("hit_starts", T.ArrayType(T.IntegerType())),
        ("hit_ends", T.ArrayType(T.IntegerType())),
        ("hit_items", T.ArrayType(T.StringType())),
    ]
    sc = docs.sparkSession.sparkContext
    for k, block in enumerate(item_blocks(items, item_col, item_text_col, block_bytes)):
        if k:
            docs = materialize(docs)
        shared = sc.broadcast(block)

        def start(shared=shared, first=k == 0):
            table = Windows(shared.value, window)

            def run(part):
                before = [] if first else [part.column(part.schema.get_field_index(n)).to_pylist() for n, _ in fields[1:]]
                n, starts, ends, items = [], [], [], []
                for row, text in enumerate(as_bytes(part, text_col)):
                    size, hits, names = table.scan(text)
                    if not first:
                        hits += zip(before[0][row], before[1][row])
                        names |= set(before[2][row])
                    merged: list[list[int]] = []
                    for a, b in sorted(hits):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    n.append(size)
                    starts.append([a for a, _ in merged])
                    ends.append([b for _, b in merged])
                    items.append(sorted(names))
                return [n, starts, ends, items]

            return run

        docs = add_columns_keeping(docs, text_col, fields, start, k > 0)
    return docs


def add_columns_keeping(docs, text_col, fields, start, again):
    """In a later pass the earlier marks are read before they are replaced."""
    if not again:
        return add_columns(docs, text_col, fields, start, SLICE_BYTES)
    names = {n: f"{n}__before" for n, _ in fields}
    renamed = docs.withColumnsRenamed(names)

    def begin():
        run = start()

        def f(part):
            back = {v: k for k, v in names.items()}
            return run(part.rename_columns([back.get(n, n) for n in part.schema.names]))

        return f

    return add_columns(renamed, text_col, fields, begin, SLICE_BYTES, drop=tuple(names.values()))


def n_hit_words() -> Column:
    return F.aggregate(
        F.zip_with("hit_starts", "hit_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, action: str = "document", **settings) -> DataFrame:
    """The texts without benchmark passages, in the columns of `docs`.

    action "document" leaves out every text with a hit; "span" cuts the hit words out of the text, from the first
    hit word to the last of each range, and leaves a line break there.
    """
    text_col = settings.get("text_col", "text")
    marked = mark(docs, items, **settings)
    if action == "document":
        return marked.where(F.size("hit_starts") == 0).select(docs.columns)
    if action != "span":
        raise ValueError("action is document or span")

    def start():
        def run(part):
            texts = as_bytes(part, text_col)
            null = part.column(part.schema.get_field_index(text_col)).is_null().to_pylist()
            a, b = (part.column(part.schema.get_field_index(n)).to_pylist() for n in ("hit_starts", "hit_ends"))
            return [[None if z else cut(t, x, y) for t, z, x, y in zip(texts, null, a, b)]]

        return run

    columns = docs.columns
    return add_columns(marked, text_col, [(text_col, T.StringType())], start, SLICE_BYTES).select(columns)


def cut(text: bytes, starts: list[int], ends: list[int]) -> str:
    if starts:
        inside = np.frombuffer(text.translate(FOLD), np.uint8) != 0x20
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b in zip(reversed(starts), reversed(ends)):
            text = text[: first[a]] + b"\n" + text[last[b - 1] :]
    return text.decode()


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = narrow(spark.read.parquet(f"{sf}/documents.parquet"))
    marked = mark(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    return marked.select(
        "doc_id",
        "n_words",
        n_hit_words().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_starts") > 0).alias("contaminated"),
    )


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM sized)
), lengths AS (
  SELECT DISTINCT n FROM grams
), places AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)
), hits AS (
  SELECT p.doc_id, p.k, p.n, g.item_id FROM places p JOIN grams g ON p.n = g.n AND p.g = g.g
), hit_words AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
