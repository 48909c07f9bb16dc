"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where they agree.

The vocabulary is a byte-level BPE of the `tokenizers` library. Its merges never cross the parts that its pattern
cuts a text into, so the library's model encodes each distinct part once and a bounded table keeps its count.
A text above `chunk_chars` is never cut into parts in one go: chunks that overlap are encoded with the offsets of
their parts, and a chunk is joined to the one before it at an offset where both begin a part. The scan for parts
looks only forward from where it stands, so from a common offset on both go on alike, until the earlier chunk's
text ends; parts that touch the chunk's end are therefore never used for a splice. If no offset agrees (one part is
longer than the overlap), the later chunk is taken with twice the overlap, and so on up to the start of the part.

Defined results: NULL and empty texts have 0 tokens; repeated rows are counted each; the strings of special tokens
count as those tokens, the library's default. Extra columns pass through; one named like an output is replaced.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.arrow import SLICE_BYTES, add_columns, as_texts, held, narrow, vocabulary
from riskframe.llm.bpe import byte_letters

VOCABULARY = "byte_bpe_50k.json"
LIMIT_TOKENS = 512
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
TABLE_PARTS = 400_000

#: Fixed value: the pattern of byte-level pre-tokenisation.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Counts tokens of texts with one vocabulary; lives in a task."""

    def __init__(self, vocab: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        from tokenizers import Tokenizer

        path = vocabulary(vocab)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        kind = described["pre_tokenizer"]
        if described["normalizer"] or kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError(f"{vocab}: only byte-level vocabularies without a normaliser are counted here")
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = regex.compile(PARTS)
        self.letters = dict(enumerate(byte_letters()))
        self.special = [t["content"] for t in described["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.sizes: dict[str, int] = {}
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.widened = 0

    def _learn(self, parts) -> None:
        new = [p for p in set(parts) if p not in self.sizes]
        if len(self.sizes) + len(new) > TABLE_PARTS:
            self.sizes.clear()
            new = set(parts)
        tokenize = self.tokenizer.model.tokenize
        for p in new:
            self.sizes[p] = len(tokenize(p.encode().decode("latin-1").translate(self.letters)))

    def total(self, parts: list[str]) -> int:
        try:
            return sum(map(self.sizes.__getitem__, parts))
        except KeyError:
            self._learn(parts)
            return sum(map(self.sizes.__getitem__, parts))

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and how many of those there are."""
        if self.split is None or not any(s in text for s in self.special):
            return [text], 0
        found = self.split.split(text)
        return found, len(found) - 1

    def _encode(self, text: str, start: int, stop: int) -> tuple[list[int], list[str]]:
        """Offsets in the text and parts of one chunk."""
        parts = self.parts.findall(text[start:stop])
        offsets = np.cumsum([start, *map(len, parts)])
        return offsets.tolist(), parts

    def huge(self, text: str) -> int:
        """Tokens of one long segment, holding one chunk's parts at a time."""
        total, start = 0, 0
        offsets, parts = self._encode(text, 0, min(len(text), self.chunk))
        while offsets[-1] < len(text):
            end = offsets[-1]
            # a part that ends at the chunk's end, and the one before (it may look ahead), can still change
            usable = offsets[: max(1, len(parts) - 1)]
            overlap = self.overlap
            while True:
                at = max(usable[0], end - overlap)
                stop = min(len(text), end + self.chunk)
                more_offsets, more = self._encode(text, at, stop)
                # only offsets that begin a whole part in both; the first of the later chunk is where it was cut
                common = set(usable) & set(more_offsets[1:-2] if at > usable[0] else more_offsets[:-2])
                if common or (at == usable[0] and stop == len(text)):
                    break
                if at == usable[0]:
                    # one part from the chunk's start on: read on behind it
                    end = stop
                    continue
                self.widened += 1
                overlap *= 2
            splice = min(common) if common else usable[0]
            total += self.total(parts[: offsets.index(splice)])
            k = more_offsets.index(splice)
            offsets, parts = more_offsets[k:], more[k:]
        return total + self.total(parts)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Short ones share one look at the table for all their parts."""
        out = []
        for text in texts:
            found, n = self.segments(text)
            for segment in found:
                n += self.huge(segment) if len(segment) > self.chunk else self.total(self.parts.findall(segment))
            out.append(n)
        return out


def counter(*settings) -> Counter:
    """One per worker process and settings, so that its table serves all tasks."""
    return held(("counts", *settings), lambda: Counter(*settings))


def count_tokens(
    df: DataFrame,
    text_col: str = "text",
    vocab: str = VOCABULARY,
    limit: int = LIMIT_TOKENS,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """`df` with n_bytes, n_tokens and over_limit (n_tokens > limit). A narrow pass: no shuffle, no filter."""
    if overlap_chars < 1 or chunk_chars < overlap_chars:
        raise ValueError("chunk_chars must be at least overlap_chars, and that at least 1")

    def start():
        c = counter(vocab, chunk_chars, overlap_chars)
        return lambda part: [c.counts(as_texts(part, text_col))]

    out = add_columns(df, text_col, [("n_tokens", T.LongType())], start, SLICE_BYTES, drop=("n_bytes", "over_limit"))
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    return out.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = narrow(spark.read.parquet(f"{sf}/documents.parquet"))
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
