"""The cheap look before the rewrites must not be narrower than the rewrites."""

import time

import pytest

from riskframe.llm import pii


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("plus 49 170 555 01 seven", "phone", "plus 49 170 555 01 seven"),
        ("call +49 170 555 01 seven", "phone", "+49 170 555 01 seven"),
        ("card 4111 1111 1111 11 one1 ok", "card", "4111 1111 1111 11 one1"),
        ("÷plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("ip one nine two dot one six eight dot one two three dot one zero zero ok", "ip", "one nine two dot one six eight dot one two three dot one zero zero"),
        ("ip one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
        ("ip one zero [dot] 0 [dot] zero [dot] one ok", "ip", "one zero [dot] 0 [dot] zero [dot] one"),
        ("ip three zero zero dot one dot one dot one", "ip", None),
        ("one or two dot three", "ip", None),
    ],
)
def test_no_disguise_hides_from_the_hint(text, kind, found):
    base, every = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == ([(kind, found)] if found else [])


@pytest.mark.parametrize("text", ["card 4111 1111 1111 111 one", "plus 49 170 555 01 seven"])
def test_a_span_does_not_depend_on_other_words(text):
    assert set(pii.find(text)[1]) <= set(pii.find(text + " and then; two three")[1])


def test_letters_that_ignorecase_folds():
    text = "call plus one five five five one two three four five five ſix ok"
    assert [text[a:b] for _, a, b in pii.find(text)[1]] == ["plus one five five five one two three four five five ſix"]


def test_long_failing_runs_take_linear_time():
    start = time.process_time()
    assert pii.find("one " + "1" * 5000 + "x")[1] == []
    assert pii.find("one " + "1 " * 20000 + "1x")[1] == []
    assert time.process_time() - start < 5


@pytest.mark.parametrize(
    "text, found",
    [
        ("to a.b.c.d.e.f(at)x(dot)com ok", "a.b.c.d.e.f(at)x(dot)com"),
        ("to a dot b dot c dot d dot e dot f at x dot com ok", "a dot b dot c dot d dot e dot f at x dot com"),
        ("; a at b dot c dot d dot e dot f dot g dot h dot com", "a at b dot c dot d dot e dot f dot g dot h dot com"),
        ("; john at mail dot cz", "john at mail dot cz"),
        ("; anna at uni dot edu dot tr.", "anna at uni dot edu dot tr"),
        ("; john @ example . com now", "john @ example . com"),
        ("; john @ mail . example . co . uk", "john @ mail . example . co . uk"),
        ("ｊohn＠example。com", "ｊohn＠example。com"),
        ("; look at this dot on the page", None),
        ("; dinner @ noon . Bring wine", None),
    ],
)
def test_addresses_of_any_length_and_ending(text, found):
    base, every = pii.find(text)
    added = [text[a:b] for k, a, b in every if (k, a, b) not in base and k == "email"]
    assert added == ([found] if found else [])


def test_long_runs_without_an_address_take_linear_time():
    start = time.process_time()
    for text in ("a dot " * 40000 + "at", "a at b" + " dot b" * 40000 + " dot 1", "x at " * 40000 + "dot", "a.b" * 60000 + "(at)", "a @ b" + " . c" * 40000):
        pii.find(text)
    assert time.process_time() - start < 10
