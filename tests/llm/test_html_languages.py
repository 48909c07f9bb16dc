"""Pages in languages without stop-words, and skipped elements that are not closed."""

import time

import pytest

from riskframe.llm.html_text import main_text

POLISH = (
    "Rzeka płynie przez dolinę, a nad brzegiem stoją stare wierzby, których gałęzie dotykają wody. Wieczorem mieszkańcy wracają "
    "drogą przez pola, niosąc kosze pełne jabłek, podczas gdy dzieci biegną przodem i wołają psa, który znowu zniknął za stodołą."
)
SHORTER = "Zimą droga bywa zasypana śniegiem, więc wieś żyje wtedy własnym spokojnym rytmem."
CHINESE = "河水穿过山谷，岸边长着古老的柳树，树枝垂到水面。傍晚，村民们提着装满苹果的篮子沿着田间小路回家，孩子们跑在前面，呼唤着又躲到谷仓后面的小狗。冬天大雪封路，村子便按自己的节奏安静地生活。"
ENGLISH = "The river runs to the sea and it is the way that the people of the town have taken for years, as the road is not safe at night. " * 2


@pytest.mark.parametrize("text", [POLISH, CHINESE])
def test_long_paragraphs_of_other_languages_are_text(text):
    menu = "<ul>" + "".join(f'<li><a href="/{k}">Strona {k}</a></li>' for k in range(9)) + "</ul>"
    html = f"<body>{menu}<div>{text}</div><div>{SHORTER}</div><div>{text}</div><div class=footer>{text}</div></body>"
    assert main_text(html) == f"{text}\n{SHORTER}\n{text}"


def test_low_density_still_counts_where_the_language_is_known():
    junk = "Lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua"
    assert main_text(f"<body><div>{ENGLISH}</div><div>{junk}</div></body>") == ENGLISH.strip()


@pytest.mark.parametrize(
    "before",
    [
        "<head><title>T</title><p>",
        "<head><meta charset=utf-8><title>T</title><div>",
        "<body><svg/><p>",
        "<body><math/><p>",
        "<body><button class=x>Buy<p>",
        "<body><svg><svg></svg></svg><p>",
        "<html><head><title>T<body><p>",
    ],
)
def test_a_skipped_element_without_end_keeps_the_rest(before):
    text = ENGLISH.strip()
    assert main_text(f"{before}{text}</p><button>x</button>").split("\n")[-1] == text


def test_closed_skipped_elements_stay_out():
    html = "<head><title>T</title><script>var a = '<p>no</p>';</script></head><body><svg><text>no</text></svg>"
    assert main_text(f"{html}<p>{ENGLISH}</p><script>no") == ENGLISH.strip()


def test_many_unclosed_elements_take_linear_time():
    start = time.process_time()
    main_text("<svg><button>" * 20_000)
    assert time.process_time() - start < 5
