"""Quality, language, fertility, personal data: learned or ruled figures of single texts."""

import collections
import re

import numpy as np
import pytest
from llm_cases import EDGE_TEXTS, WORD, edge_docs, no_docs, prose

from riskframe.llm import fertility, language, pii, quality

SF = "/root/testdata/sf0.01"


# --- quality ---------------------------------------------------------------------------------------


def test_scores_are_the_plain_pairwise_sum():
    rng = np.random.default_rng(1)
    d = quality.dimensions()
    m = quality.Machine(0.3, rng.normal(size=d), rng.normal(size=(d, 3)) * 0.1)
    x = quality.features([prose(1).encode(), b"", b"a a a", "é!".encode()], np.array([5, -1, 5, 2]))
    for k, s in enumerate(m.scores(x)):
        i, v = x.index[x.firsts[k] : x.firsts[k + 1]], x.value[x.firsts[k] : x.firsts[k + 1]]
        total = m.intercept + (m.linear[i] * v).sum()
        total += sum((m.factors[i[a]] @ m.factors[i[b]]) * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert s == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-9)


def test_features_do_not_depend_on_the_slice():
    texts = [prose(k).encode() for k in range(5)] + [b"", b"A a A"]
    sizes = np.arange(7)
    together = quality.features(texts, sizes)
    for k, t in enumerate(texts):
        alone = quality.features([t], sizes[k : k + 1])
        part = slice(together.firsts[k], together.firsts[k + 1])
        assert together.index[part].tolist() == alone.index.tolist()
        assert together.value[part].tolist() == pytest.approx(alone.value.tolist())


def test_quality_held_out_accuracy(spark):
    large = "/root/testdata/sf0.1"  # a few hundred labels are too few to fit thousands of words
    found = quality.op1_quality(spark, large)
    labels = spark.read.parquet(f"{large}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert len(rows) > 50
    assert sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert found.count() == 10_000


def test_quality_edges(spark):
    machine = quality.constant(0.7)
    out = quality.score(edge_docs(spark), machine)
    rows = out.select("doc_id", "score", "predicted").collect()
    assert len(rows) == len(EDGE_TEXTS) and all(r["score"] == pytest.approx(0.7) for r in rows)
    assert quality.score(no_docs(spark), machine).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(edge_docs(spark), empty).intercept == 0
    ones = spark.createDataFrame([(4, 1), (5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert quality.fit(edge_docs(spark), ones).scores(quality.features([b""], np.array([-1])))[0] > 0.99


# --- language --------------------------------------------------------------------------------------


def test_language_held_out_accuracy_and_fold(spark):
    found = language.op2_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.select("held_out", "lang", "lang_pred", "score", "accepted").collect()
    held = [r for r in rows if r["held_out"]]
    assert 250 < len(held) < 420
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 and r["accepted"] for r in rows)


def test_language_mixture_proportions():
    english, german = "the house of the river and the thing with that " * 30, "das haus und der fluss mit dem weg nicht auch " * 30
    bins, firsts = language.gram_bins([english, german, english * 3 + german])
    counts = np.stack([np.bincount(bins[a:b], minlength=1 << language.BITS) for a, b in zip(firsts[:2], firsts[1:3])])
    model = language.Languages(["en", "de"], counts)
    chosen, _ = model.infer(bins[firsts[2] : firsts[3]])
    share = dict(chosen)
    assert share["en"] == pytest.approx(0.75, abs=0.06) and share["de"] == pytest.approx(0.25, abs=0.06)
    assert model.infer(bins[: firsts[1]])[0][0][0] == "en" and len(model.infer(bins[: firsts[1]])[0]) == 1


def test_language_edges(spark):
    docs = edge_docs(spark)
    model = language.learn(docs.withColumn("lang", docs["source"]))
    rows = language.predict(docs, model).select("doc_id", "text", "lang_pred", "score", "langs", "accepted").collect()
    assert len(rows) == len(EDGE_TEXTS)
    for r in rows:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] == ("s" if has_letter else "und")
        assert r["accepted"] or not has_letter or len(r["text"]) > 20
    nothing = language.learn(no_docs(spark))
    assert {r[0] for r in language.predict(docs, nothing).select("lang_pred").collect()} == {"und"}
    assert language.predict(no_docs(spark), model).count() == 0
    with pytest.raises(Exception, match="more than 2 languages"):
        language.learn(docs.withColumn("lang", docs["doc_id"].cast("string")), max_languages=2)


# --- fertility -------------------------------------------------------------------------------------


def base_by_hand(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    threes = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if threes[tuple(words[k : k + 3])] > 1 for j in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_base_figures_by_hand(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    texts += ["", "a b a b a b", "x\n\nx\n x\r\n\x0b\n", "é\x1cü|\xa0#", *[t or "" for _, t in EDGE_TEXTS]]
    assert fertility.base_figures([t.encode() for t in texts]) == [base_by_hand(t) for t in texts]


def test_fertility_figures_are_those_of_the_library():
    model = fertility.Fertility()
    text = prose(3, 80) + " wörter 漢字"
    ids = [i for w in text.split(" ") for i in model.model.encode(w)]
    n, chars, by, entropy, odd = model.figures(text, 100)
    share = np.array(list(collections.Counter(ids).values())) / len(ids)
    assert (n, chars) == (len(ids), 100 / len(ids)) and odd != odd
    again = model.figures("wörter für schöne große Bäume und Züge", 30)[4]
    assert again == pytest.approx(sum(map(len, "wörter für schöne große Bäume Züge".split())) / sum(len(model.model.encode(w)) for w in "wörter für schöne große Bäume Züge".split()))
    assert by == pytest.approx(sum(model.model.is_byte(i) for i in ids) / len(ids))
    assert entropy == pytest.approx(-(share * np.log2(share)).sum() / np.log2(len(ids)))


def test_bands_reject_encoded_data_and_keep_prose(spark):
    noise = " ".join("".join(chr(33 + (k * k * 7 + j * j * 13 + k * j) % 90) for j in range(40)) for k in range(80))
    rows = spark.createDataFrame([(1, prose(1, 300)), (2, noise), (3, "word " * 30), (4, "ありがとう 世界 " * 2 + prose(2, 60))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fertility.judge(rows).collect()}
    assert got[1]["kept"] and not got[1]["base_failed"]
    assert not got[2]["kept"] and not got[2]["base_failed"]
    assert got[3]["base_failed"] and not got[3]["kept"]


def test_bands_decide(spark):
    """Random letters and most broken UTF-8 go, every clean text stays: on the documents themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    clean = fertility.judge(docs).where("NOT base_failed")
    assert clean.where("NOT kept").count() == 0 and clean.count() > 800
    broken = [(r["doc_id"], r["text"].encode().decode("latin-1")) for r in clean.where("lang IN ('fr', 'es')").select("doc_id", "text").collect()]
    kept = {r["doc_id"]: r["kept"] for r in fertility.judge(spark.createDataFrame(broken, "doc_id long, text string")).collect()}
    assert len(kept) > 150 and sum(kept.values()) < 0.25 * len(kept)
    rng = np.random.default_rng(2)
    letters = [(k, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(150))) for k in range(50)]
    rows = fertility.judge(spark.createDataFrame(letters, "doc_id long, text string")).collect()
    assert not any(r["kept"] or r["base_failed"] for r in rows)


def test_fertility_edges(spark):
    rows = fertility.judge(edge_docs(spark)).collect()
    assert len(rows) == len(EDGE_TEXTS)
    assert [r["n_words"] for r in rows] == [len(WORD.findall(t or "")) for _, t in EDGE_TEXTS]
    assert "Kept" not in rows[0].asDict()
    assert fertility.judge(no_docs(spark)).count() == 0
    assert [fertility.script_of(t) for t in ("", "12 !", "abc", "жук", "漢字かな", "한글", "αβγ")] == ["none", "none", "latin", "cyrillic", "han", "hangul", "greek"]


# --- personal data ---------------------------------------------------------------------------------


def base_spans_by_hand(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub(r"[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_base_spans_by_hand():
    rng = np.random.default_rng(5)
    for _ in range(4000):
        t = "".join(rng.choice(list("ab.@@-+1 925é\n()x"), rng.integers(0, 40)))
        assert pii.base_spans(t) == base_spans_by_hand(t)
    t = "4111 1111 1111 1111 a@b.co 10.0.0.255 +1 (555) 123-4567, 4111 1111 1111 1112"
    assert [s[0] for s in pii.base_spans(t)] == ["email", "ip", "card", "phone"]


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("write john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("to john [at] mail.example.com!", "email", "john [at] mail.example.com"),
        ("by jоhn@exаmple.com here", "email", "jоhn@exаmple.com"),
        ("j.doe(at)ex(dot)org", "email", "j.doe(at)ex(dot)org"),
        ("ｊｏｈｎ＠ｅｘ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘ．ｃｏｍ"),
        ("a​b@c​.org", "email", "a​b@c​.org"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("+1 (５５５) 123-4567", "phone", "+1 (５５５) 123-4567"),
        ("four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
        ("four one one two 1111 1111 1111", "card", None),
        ("card four one one one one one one one 1111 1111 ok", "card", "four one one one one one one one 1111 1111"),
        ("host 10[.]0[.]0[.]1 up", "ip", "10[.]0[.]0[.]1"),
        ("look at home dot then", "email", None),
        ("meet me at example.com", "email", None),
        ("one two three four", "phone", None),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = pii.find(text)
    added = [s for s in every if s not in base]
    assert [(k, text[a:b]) for k, a, b in added] == ([(kind, found)] if found else [])
    if found:
        assert pii.mask(text, every) == text.replace(found, f"[{kind.upper()}]")


def test_pii_edges(spark):
    rows = pii.find_spans(edge_docs(spark)).collect()
    assert len(rows) == len(EDGE_TEXTS) and all(r["spans"] == pii.written(pii.find(r["text"] or "")[1]) for r in rows)
    assert pii.find_spans(no_docs(spark)).count() == 0
    docs = edge_docs(spark)
    assert sorted(map(str, pii.redact(docs).collect())) == sorted(map(str, docs.collect()))
    mailed = spark.createDataFrame([(1, "x a@b.co y", "k")], "doc_id long, text string, Spans string")
    assert pii.redact(mailed).collect()[0].asDict() == {"doc_id": 1, "text": "x [EMAIL] y", "Spans": "k"}


def test_pii_query_is_the_plain_scan(spark):
    got = {r["doc_id"]: r for r in pii.op10_pii(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        spans = base_spans_by_hand(d["text"])
        r = got[d["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(pii.written(spans).split(",")) - {""} <= set(r["spans"].split(","))
