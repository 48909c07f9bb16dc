"""Quality rules on a tokeniser's fertility, after a few plain base rules.

A public vocabulary with byte fallback encodes every word. Four figures per text follow: characters per token, the same
over its words with letters beyond ASCII, the share of byte-fallback tokens, and the entropy of its tokens as a share of
the highest possible one. A text passes if all are inside the bands of its script (that of most of its letters).

The bands are parameters. Those for Latin text lie between the figures of 8,884 clean texts in four languages and those of
broken ones: clean texts have at least 1.65 characters per token and, over five words or more with letters beyond ASCII,
1.51; random letters have at most 1.59, and UTF-8 read as Latin-1 falls below 1.50 over such words for nearly all French
and most Spanish texts, but only for about half of the German ones (their marks are fewer). Encoded data stay below both.

The vocabulary never joins tokens over white space, so words (`[^\\x20\\x09-\\x0D]+`, as `bytes.split` cuts them) are encoded
one by one and kept in a bounded table; a text's figures are sums over the numbers of its words.

Defined results: NULL and empty texts have no words and fail the base rules; texts without letters are of script
"none", whose bands leave the decision to the base rules; repeated rows are each judged. Extra columns pass through;
one named like an output is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskframe.llm.arrow import SLICE_BYTES, add_columns, as_bytes, held, narrow, vocabulary
from riskframe.llm.hashing import PIECE, pieces, text_words, windows

VOCABULARY = "piece_bpe_32k.model"
TABLE_WORDS = 250_000
TABLE_IDS = 4_000_000
MIN_WORDS = 50
ODD_WORDS = 5
MAX_REPEAT_PERCENT = 50
SEPARATORS = [0x20, *range(0x09, 0x0E)]
SYMBOLS = list(b"#*$%&|<>")


@dataclass(frozen=True)
class Band:
    """Allowed figures: characters per token, byte-fallback share, entropy share, and characters per token of the words
    with letters beyond ASCII, where there are `ODD_WORDS` of them."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    least_odd: float = 0.0


#: Parameters, by script. Scripts that the vocabulary spells in bytes have bands of their own.
BANDS = {
    "latin": Band(1.62, 12.0, 0.25, 0.30, 1.50),
    "greek": Band(0.80, 8.0, 0.60, 0.30),
    "cyrillic": Band(1.00, 10.0, 0.35, 0.30),
    "hebrew": Band(0.40, 6.0, 0.95, 0.30),
    "arabic": Band(0.40, 6.0, 0.95, 0.30),
    "indic": Band(0.25, 6.0, 1.00, 0.25),
    "thai": Band(0.25, 6.0, 1.00, 0.25),
    "han": Band(0.25, 4.0, 1.00, 0.25),
    "hangul": Band(0.25, 4.0, 1.00, 0.25),
    "other": Band(0.20, 12.0, 1.00, 0.20),
    "none": Band(0.0, float("inf"), 1.00, 0.0),
}

#: First and last code points of the scripts' main blocks.
BLOCKS = [
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("han", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x323AF),
]
SCRIPTS = [*dict.fromkeys(name for name, _, _ in BLOCKS), "other"]


@functools.cache
def script_table() -> np.ndarray:
    """Number of the script of each letter's code point; one past the last for what is no letter."""
    table = np.full(0x110000, len(SCRIPTS), np.uint8)
    letters = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    table[letters] = SCRIPTS.index("other")
    for name, first, last in BLOCKS:
        part = table[first : last + 1]
        part[letters[first : last + 1]] = SCRIPTS.index(name)
    return table


class Fertility:
    """Encodes words with one vocabulary; lives in a task."""

    def __init__(self, vocab: str = VOCABULARY):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(vocab))
        n = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(k) for k in range(n)), bool, n)
        self.clear()

    def clear(self) -> None:
        self.table: dict[bytes, int] = {}  # numbers of the words known, in order of the arrays
        self.ids = np.zeros(0, np.uint16)  # ids of all known words, one word after the other
        self.first, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where a word's ids begin, how many they are
        self.odd = np.zeros(0, np.int64)  # characters of a word with letters beyond ASCII, 0 for others

    def learn(self, words: Iterable[bytes]) -> None:
        """Encodes the words that are not known; a full table is emptied first."""
        words = set(words)
        new = [w for w in words if w not in self.table]
        if self.table and (len(self.table) + len(new) > TABLE_WORDS or len(self.ids) > TABLE_IDS):
            self.clear()
            new = list(words)
        texts, ids = [w.decode() for w in new], []
        for start in range(0, len(texts), 10_000):
            ids += self.model.encode(texts[start : start + 10_000], num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.table.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(ids), np.uint16, int(sizes.sum())))
        self.odd = np.append(self.odd, np.fromiter((0 if t.isascii() else len(t) for t in texts), np.int64, len(texts)))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words, those not known included."""
        found = list(map(self.table.get, words))
        if None in found:
            self.learn(words)
            found = list(map(self.table.__getitem__, words))
        return np.array(found, np.int64)

    def figures(self, text: str, chars: int) -> tuple[int, float, float, float, float]:
        """Tokens, characters per token, byte-fallback share, entropy share (1 for fewer than two tokens), and characters
        per token of the words with letters beyond ASCII (NaN for fewer than `ODD_WORDS` of them)."""
        return self.all_figures([text.encode()], [chars])[0]

    def all_figures(self, texts: list[bytes], chars: list[int]) -> list[tuple[int, float, float, float, float]]:
        """`figures` of each text; what is new in a slice is encoded together."""
        split = [[t.split()] if len(t) <= PIECE else None for t in texts]
        self.learn(chain.from_iterable(words for s in split if s for words in s))
        # a long text a part at a time
        return [self._figures(s or map(bytes.split, pieces(t)), c) for t, s, c in zip(texts, split, chars)]

    def _figures(self, parts: Iterable[list[bytes]], chars: int) -> tuple[int, float, float, float, float]:
        ids, odd = [np.zeros(0, np.uint16)], np.zeros(3, np.int64)
        for words in parts:
            at = self.places(words)
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            n = int(ends[-1]) if len(ends) else 0
            ids.append(self.ids[np.repeat(self.first[at] - ends + sizes, sizes) + np.arange(n)])
            letters = self.odd[at]
            odd += (np.count_nonzero(letters), letters.sum(), sizes[letters > 0].sum())
        n_odd, odd_letters, odd_tokens = odd.tolist()
        odd_chars = odd_letters / odd_tokens if n_odd >= ODD_WORDS and odd_tokens else float("nan")
        found, times = np.unique(np.concatenate(ids), return_counts=True)
        n = int(times.sum())
        if not n:
            return 0, 0.0, 0.0, 0.0, odd_chars
        share = times / n
        entropy = float(-(share * np.log2(share)).sum() / np.log2(n)) if n > 1 else 1.0
        return n, chars / n, float(times[self.is_byte[found]].sum() / n), entropy, odd_chars


def script_of(text: str) -> str:
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text[:200]) or any(map(str.isalpha, text)) else "none"
    counts = np.bincount(script_table()[np.frombuffer(text.encode("utf-32-le"), "<u4")], minlength=len(SCRIPTS) + 1)
    return SCRIPTS[int(counts[:-1].argmax())] if counts[:-1].any() else "none"


def within(band: Band, chars: float, byte_share: float, entropy: float, odd_chars: float = float("nan")) -> bool:
    if odd_chars < band.least_odd:
        return False
    return band.least_chars <= chars <= band.most_chars and byte_share <= band.most_bytes and entropy >= band.least_entropy


def base_figures(texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words, firsts = text_words(texts)
    threes = windows(words, 3)
    out = []
    for text, a, b in zip(texts, firsts[:-1].tolist(), firsts[1:].tolist()):
        times = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        chars = len(text) - int(times[0x80:0xC0].sum()) - int(times[SEPARATORS].sum())
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\v\f")]
        repeated = 0
        if b - a > 3:
            _, which, counts = np.unique(threes[a : b - 2], return_inverse=True, return_counts=True)
            often = counts[which] > 1
            covered = np.zeros(b - a, bool)
            for k in range(3):
                covered[k : k + len(often)] |= often
            repeated = int(covered.sum())
        out.append((b - a, chars, int(times[SYMBOLS].sum()), len(lines) - len(set(lines)), repeated))
    return out


def judge(df: DataFrame, text_col: str = "text", vocab: str = VOCABULARY, bands: dict[str, Band] | None = None) -> DataFrame:
    """`df` with the base figures, base_failed, kept, and the figures behind it. A narrow pass that keeps all rows."""
    bands = bands or BANDS
    fields = [(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("script", T.StringType()), ("n_tokens", T.LongType())]
    fields += [(n, T.DoubleType()) for n in ("chars_per_token", "byte_share", "entropy_share", "odd_chars_per_token")]

    def start():
        model = held(("fertility", vocab), lambda: Fertility(vocab))

        def run(part):
            texts = as_bytes(part, text_col)
            out = [[] for _ in fields]
            plain = base_figures(texts)
            for raw, base, (n, *figures) in zip(texts, plain, model.all_figures(texts, [b[1] for b in plain])):
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                script = script_of(raw.decode())
                row = (*base, failed, not failed and within(bands.get(script, bands["other"]), *figures), script, n, *figures)
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return run

    return add_columns(df, text_col, fields, start, SLICE_BYTES)


def op6_fertility(spark: SparkSession, sf: str) -> DataFrame:
    return judge(narrow(spark.read.parquet(f"{sf}/documents.parquet"))).drop("text")
