"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that its encoding ends with. Going from left to right, the
tokens that end at the prefix are found by a suffix automaton of the vocabulary (each state knows the longest token
that is a suffix, each token the next shorter one). A token t that starts at position s is the last one exactly if
the pair (last token of the prefix s, t) stays a pair under the merges: cutting both tokens open from the seam
outwards, no merge across the seam comes before the merges that made the pieces next to it. The last tokens are
stored and followed back for the ids. The time is linear in the word; nothing is merged.

Symbols are the byte letters of the vocabulary, and the last letter of a word carries the word-end mark. Vocabulary
entries that the merges can't produce from their own letters are left out of the automaton.

Normalisation and cutting into words follow the vocabulary file's description (NFC, white space to a space, lower
case letter by letter; special strings first, in the raw text). Encodings of words are kept in a bounded table.

Defined results: NULL and empty texts have no ids; repeated rows are encoded each; ids outside the vocabulary
decode to nothing, as in the library. Extra columns pass through; one named like an output is replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import normalizers

from riskframe.llm.arrow import SLICE_BYTES, add_columns, as_texts, held, narrow, vocabulary

VOCABULARY = "word_bpe_49k.json"
#: Words in each of the two generations of the table: the newer one fills, then replaces the older.
TABLE_WORDS = 220_000
TABLE_STEPS = 400_000
KEEP_WORD_LENGTH = 64


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0x100
    for byte in range(256):
        letters.append(chr(byte if byte in plain else spare))
        spare += byte not in plain
    return letters


class PrefixBpe:
    """Encoder and decoder for one vocabulary; lives in a task."""

    def __init__(self, vocab: str = VOCABULARY):
        with open(vocabulary(vocab), encoding="utf-8") as f:
            described = json.load(f)
        model = described["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        steps = (described["normalizer"] or {}).get("normalizers", [])
        cut = described["pre_tokenizer"].get("pretokenizers", [{}])[0]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or cut.get("type") != "Split" or not cut["invert"]:
            raise ValueError(f"{vocab}: this kind of normalisation or splitting is not known here")
        self.words = regex.compile(cut["pattern"]["Regex"])
        self.compose = normalizers.NFC().normalize_str
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = byte_letters()
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        ids = model["vocab"]
        # a token is two parts (its one merge) or a single symbol
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair, token = (ids[a], ids[b]), ids[a + b]
            self.rank.setdefault(pair, rank)
            if token not in self.parts:
                self.parts[token], self.made[token] = pair, rank
        self.symbol = {t: i for t, i in ids.items() if i not in self.parts and len(t.removesuffix(self.suffix) or t) == 1}
        self.spelled: dict[int, list[int]] = {}
        for token in [*self.symbol.values(), *sorted(self.parts, key=self.made.get)]:
            if token in self.parts:
                a, b = self.parts[token]
                if a in self.spelled and b in self.spelled and self.pair_stays(a, b, self.made[token]):
                    self.spelled[token] = self.spelled[a] + self.spelled[b]
            else:
                self.spelled[token] = [token]
        self.inner = [self.symbol[x] for x in self.letters]
        self.final = [self.symbol[x + self.suffix] for x in self.letters]
        self._automaton()
        self.steps: dict[int, int] = {}
        self.stays: dict[int, bool] = {}
        self.table: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def pair_stays(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether tokens a and b, next to each other, are both left whole by the merges (up to rank `limit`)."""
        rank, parts, made = self.rank, self.parts, self.made
        if limit is None:
            limit = 1 << 60
        while True:
            over = rank.get((a, b))
            if over is not None and over < limit:
                return False
            # undo the later of the two merges next to the seam; left one first on a tie never occurs
            left, right = made.get(a, -1), made.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                limit, a = left, parts[a][1]
                # a merge across the seam of the same rank comes after the left one, which stands further left
                limit = left
            else:
                b = parts[b][0]
                # a merge across the seam of the same rank comes first, since it stands further left
                limit = right + 1

    def _automaton(self) -> None:
        """Suffix automaton of the spelled tokens: a trie with links to the longest proper suffix in it."""
        go: list[dict[int, int]] = [{}]
        ends = [-1]
        for token, symbols in self.spelled.items():
            state = 0
            for s in symbols:
                if s not in go[state]:
                    go.append({})
                    ends.append(-1)
                    go[state][s] = len(go) - 1
                state = go[state][s]
            ends[state] = token
        link, longest = [0] * len(go), [-1] * len(go)
        shorter: dict[int, int] = {}
        queue = deque(go[0].values())
        for state in queue:
            longest[state] = ends[state]
        while queue:
            state = queue.popleft()
            for s, child in go[state].items():
                back = link[state]
                while back and s not in go[back]:
                    back = link[back]
                link[child] = go[back].get(s, 0) if go[back].get(s, 0) != child else 0
                below = longest[link[child]]
                longest[child] = ends[child] if ends[child] >= 0 else below
                if ends[child] >= 0:
                    shorter[ends[child]] = below
                queue.append(child)
        self.go, self.link, self.longest, self.shorter = go, link, longest, shorter
        self.length = {t: len(s) for t, s in self.spelled.items()}

    def step(self, state: int, symbol: int) -> int:
        """The longest suffix of state + symbol that begins a token."""
        while state and symbol not in self.go[state]:
            state = self.link[state]
        return self.go[state].get(symbol, 0)

    def word(self, word: str) -> list[int]:
        """Ids of one word (a match of the word pattern), by back-pointers over its prefixes."""
        data = word.encode()
        symbols = [*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]]
        longest, shorter, length, steps, stays = self.longest, self.shorter, self.length, self.steps, self.stays
        if len(steps) > TABLE_STEPS:
            steps.clear()
        if len(stays) > TABLE_STEPS:
            stays.clear()
        last: list[int] = []
        state = 0
        for i, s in enumerate(symbols):
            at = state << 17 | s
            state = steps.get(at, -1)
            if state < 0:
                state = steps[at] = self.step(at >> 17, s)
            token = longest[state]
            while (start := i + 1 - length[token]) > 0:
                pair = last[start - 1] << 17 | token
                good = stays.get(pair)
                if good is None:
                    good = stays[pair] = self.pair_stays(last[start - 1], token)
                if good:
                    break
                token = shorter[token]
            last.append(token)
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at - 1])
            at -= length[ids[-1]]
        return ids[::-1]

    def normal(self, text: str) -> str:
        # 'Σ' is lowered letter by letter here, not by its place in a word
        # the library's own NFC: its Unicode version is older than Python's and differs in the order of some marks
        composed = text if text.isascii() else self.compose(text)
        return composed.replace("Σ", "σ").lower()

    def _entry(self, word: str) -> tuple[int, str, str]:
        entry = self.older.get(word)
        if entry is None:
            ids = self.word(word)
            names = self.names
            entry = len(ids), " ".join([str(i) for i in ids]), " ".join([names[i] for i in ids])
        if len(word) <= KEEP_WORD_LENGTH:
            if len(self.table) >= TABLE_WORDS:
                self.older, self.table = self.table, {}
            self.table[word] = entry
        return entry

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        """Number of ids, ids as text and decoded text of each word and special token of a text."""
        out: list[tuple[int, str, str]] = []
        chunks = self.split.split(text) if any(s in text for s in self.special) else [text]
        for chunk in chunks:
            if chunk in self.special:
                out.append((1, str(self.special[chunk]), chunk))
            else:
                out += [self.table.get(w) or self._entry(w) for w in self.words.findall(self.normal(chunk))]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for e in self.entries(text) for i in e[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder: tokens are joined by a space."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def coder(vocab: str) -> PrefixBpe:
    """One per worker process and vocabulary."""
    return held(("bpe", vocab), lambda: PrefixBpe(vocab))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_texts(df: DataFrame, text_col: str = "text", vocab: str = VOCABULARY, ids: bool = True, decoded: bool = False) -> DataFrame:
    """`df` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and the decoded text. A narrow pass."""
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] * ids + [("decoded", T.StringType())] * decoded

    def start():
        c = coder(vocab)

        def run(part):
            n, digests, back, lists, plain = [], [], [], [], []
            for text in as_texts(part, text_col):
                found = c.entries(text)
                n.append(sum([e[0] for e in found]))
                numbers = " ".join([e[1] for e in found])
                digests.append(sha(numbers))
                whole = " ".join([e[2] for e in found])
                back.append(sha(whole))
                if ids:
                    lists.append(np.array(numbers.split(), np.int32))
                if decoded:
                    plain.append(whole)
            out = [n, digests, back]
            if ids:
                ends = np.cumsum([0, *n], dtype=np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *lists])
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            return out + [plain] * decoded

        return run

    return add_columns(df, text_col, fields, start, SLICE_BYTES)


def decode_ids(df: DataFrame, ids_col: str = "ids", vocab: str = VOCABULARY) -> DataFrame:
    """`df` with the column decoded: the text of an array of ids (NULL: empty)."""
    kept = [f for f in df.schema.fields if f.name.lower() != "decoded"]
    schema = T.StructType([*kept, T.StructField("decoded", T.StringType())])
    names = [f.name for f in kept]

    def run(batches):
        c = coder(vocab)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            made = pa.array([c.decode(x or []) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), made], [*names, "decoded"])

    return df.mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = narrow(spark.read.parquet(f"{sf}/documents.parquet"))
    return encode_texts(docs, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
