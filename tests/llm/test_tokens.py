"""Token counts and BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from llm_cases import EDGE_TEXTS, edge_docs, no_docs, prose
from tokenizers import Tokenizer

from riskframe.llm import bpe, token_counts

SF = "/root/testdata/sf0.001"
ODD = [
    "",
    "  \n",
    "İstanbul ΑΣ ΟΔΟΣ Σ é ｆｕｌｌ ① 漢字 🙂👍🏽 don't we'll x<|endoftext|>y <|startoftext|> z<|endof",
    "ab" * 300,
    "!" * 90 + "\x1c\x85\xa0 end",
    "ThIs\tis\r\na test123 45٣",
    " " * 100 + "x" + " \n" * 50,
    "a" * 200 + " " * 300 + "b",
    "\n\n\n<|endoftext|>!!  <|endoftext|>",
]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    letters = "abcdeionrst \n'.,!?éßñ漢🙂0123İΣſ "
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + random_texts(800) + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_ids_and_decoded_text_are_the_librarys(texts):
    library, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.PrefixBpe()
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert len(own.word("ab" * 3000)) == len(library.encode("ab" * 3000, add_special_tokens=False).ids)


def test_counts_are_the_librarys_at_every_chunk_size(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.Counter().counts(texts) == wanted
    small = token_counts.Counter("byte_bpe_50k.json", 40, 4)
    assert small.counts(texts) == wanted
    assert small.widened > 100


def test_bpe_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op9_bpe(spark, SF).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_count_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = token_counts.op8_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)


def test_edges(spark):
    docs = edge_docs(spark)
    counted = token_counts.count_tokens(docs).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [r["n_tokens"] for r in counted] == [len(library.encode(t or "").ids) for _, t in EDGE_TEXTS]
    assert counted[0]["n_bytes"] == 0 and [c for c in counted[0].asDict() if c.lower() == "n_tokens"] == ["n_tokens"]
    coded = bpe.encode_texts(docs, decoded=True).collect()
    assert [r["n_tokens"] for r in coded] == [len(r["ids"]) for r in coded]
    back = bpe.decode_ids(bpe.encode_texts(docs, decoded=True).withColumnRenamed("decoded", "before")).collect()
    assert all(r["decoded"] == r["before"] for r in back)
    assert token_counts.count_tokens(no_docs(spark)).count() == 0 and bpe.encode_texts(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, chunk_chars=3, overlap_chars=9)
    assert bpe.coder(bpe.VOCABULARY).encode(prose(1))
