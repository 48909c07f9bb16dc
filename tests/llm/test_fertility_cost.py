"""What a text costs: new words of a slice are encoded together, and the table stays bounded."""

from llm_cases import prose

from riskframe.llm import fertility


def counted(monkeypatch):
    calls, model = [], fertility.Fertility()
    encode = model.model.encode
    monkeypatch.setattr(model.model, "encode", lambda some, **how: calls.append(len(some)) or encode(some, **how))
    return model, calls


def test_words_of_a_slice_are_encoded_once_and_together(monkeypatch):
    texts = [prose(k, 60) + f" Zahl{k} schöne größe Bäume für Züge" for k in range(20)] + ["", " \n", "\x1c a\x85b"]
    model, calls = counted(monkeypatch)
    chars = [len("".join(t.split())) for t in texts]
    got = model.all_figures([t.encode() for t in texts], chars)
    assert calls == [len({w for t in texts for w in t.encode().split()})]
    alone = fertility.Fertility()
    assert list(map(repr, got)) == [repr(alone.figures(t, c)) for t, c in zip(texts, chars)]


def test_a_full_table_is_emptied(monkeypatch):
    """By its words and by its ids; figures stay the same, also of a text cut into pieces."""
    texts = [" ".join(f"w{k}x{j}é" for j in range(300)) for k in range(6)]
    want = [repr(fertility.Fertility().figures(t, 2000)) for t in texts]
    for name in ("TABLE_WORDS", "TABLE_IDS"):
        with monkeypatch.context() as bound:
            bound.setattr(fertility, name, 500)
            bound.setattr(fertility, "PIECE", 1000)
            bound.setattr(fertility, "pieces", cut)
            model = fertility.Fertility()
            got = []
            for t in texts:
                got.append(repr(model.figures(t, 2000)))
                assert len(model.table) <= 700 and len(model.ids) <= 5000
        assert got == want


def cut(text):
    words = text.split()
    return [b" ".join(words[k : k + 100]) for k in range(0, len(words), 100)]
