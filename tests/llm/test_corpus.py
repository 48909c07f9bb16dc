"""Decontamination, Jaccard join, chats, pages, the pipeline and the SQL of the queries."""

import hashlib
import html as html_lib
import re

import duckdb
import pytest
from llm_cases import EDGE_TEXTS, edge_docs, near_components, no_docs, prose
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm import bpe, chat, decontaminate, html_text, jaccard_join, language, pii, queries
from riskframe.llm.graph import components

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in df.collect())


# --- decontamination -------------------------------------------------------------------------------


def hits_by_hand(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate({k: k + 32 for k in range(65, 91)}))
        n = min(window, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                names.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_marks_by_hand(spark, block_bytes):
    passage = prose(77, 30)
    items = [(1, passage), (2, "Short, item!"), (3, None), (4, "... "), (None, prose(78, 12)), (5, passage)]
    texts = [*EDGE_TEXTS, (20, f"{prose(1)} {passage} {prose(2)}"), (21, passage.upper().replace(" ", "-")), (22, "a short item. b"), (23, prose(78, 12)), (24, " ".join(passage.split()[:9]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("hit_items", F.lit("mine"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.mark(docs, bench, block_bytes=block_bytes).withColumn("n_hit", decontaminate.n_hit_words()).collect()
    assert sorted((r["n_words"], r["n_hit"], r["hit_items"]) for r in rows) == sorted(hits_by_hand(t, items) for _, t in texts)
    left = decontaminate.remove_contaminated(docs, bench, block_bytes=block_bytes)
    assert left.columns == docs.columns and {r[0] for r in left.select("doc_id").collect()} & {20, 21, 22, 23} == set()
    cut = decontaminate.remove_contaminated(docs, bench, action="span", block_bytes=block_bytes)
    assert cut.count() == len(texts)
    assert all(hits_by_hand(r["text"], items)[1] == 0 for r in cut.collect())
    assert cut.where("doc_id = 20").first()["text"] == f"{prose(1)} \n {prose(2)}"


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark(edge_docs(spark), bench).where("size(hit_items) > 0").count() == 0
    assert decontaminate.mark(no_docs(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- Jaccard join ----------------------------------------------------------------------------------


def near_cases():
    """Exact and near copies, a group that hangs together by neighbours only, texts that share a passage."""
    rows = list(EDGE_TEXTS)
    base = prose(100, 120).split()
    for k in range(12):
        copy = list(base)
        for j in range(k):
            copy[7 * j + 3] = f"edit{j}"
        rows.append((100 + k, " ".join(copy)))
    passage = prose(200, 55)
    rows += [(200 + k, f"{prose(300 + k, 70)} {passage}") for k in range(30)]
    rows += [(300 + k, passage + f" tail{k}") for k in range(25)]
    return rows + [(400 + k % 2, prose(500, 40)) for k in range(6)] + [(500, prose(500, 40).upper())]


@pytest.mark.parametrize("pivots, bucket_rows", [((4, 16), 4096), ((1, 1), 1)])
def test_components_by_hand(spark, monkeypatch, pivots, bucket_rows):
    monkeypatch.setattr(jaccard_join, "FIRST_PIVOTS", pivots[0])
    monkeypatch.setattr(jaccard_join, "MORE_PIVOTS", pivots[1])
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(jaccard_join, "SMALL_ROWS", 0 if bucket_rows == 1 else 400_000)
    rows = near_cases()
    comp, sets = near_components(rows)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    wanted = sorted(str((i, len(s), least.get(c))) for (i, _), c, s in zip(rows, comp, sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("n", "node", "comp", "content", "token")})
    assert sorted(str(tuple(r)) for r in jaccard_join.near_groups(docs).collect()) == wanted
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(comp))
    by_text = {t: c for (_, t), c in zip(rows, comp) if t}
    for i, t in got:
        if t and t in by_text and by_text[t] in least:
            assert i == least[by_text[t]]


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.near_groups(no_docs(spark)).count() == 0
    assert jaccard_join.keep_one(no_docs(spark)).count() == 0


def test_sketch_never_counts_too_low(spark):
    docs = spark.createDataFrame(near_cases(), "doc_id long, text string")
    sketch = jaccard_join.token_sketch(docs, bits=14)
    total = sum(max(0, len((t or "").split()) - 4) or bool((t or "").split()) for _, t in near_cases())
    assert abs(int(sketch.sum()) - total) <= 5


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# --- chats -----------------------------------------------------------------------------------------


def chat_rows():
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "x")]
    rows = []
    for conv, n in ((10, 1), (11, 2), (12, 4), (13, 4), (14, 3)):
        rows += [(conv, k, *talk[k]) for k in range(n)]
    rows += [(20, 0, "user", "hi"), (20, 1, "assistant", "other"), (20, 1, "assistant", "other")]
    rows += [(21, None, "user", "hi"), (21, 5, "assistant", "hello"), (None, 0, "user", "lost")]
    rows += [(30, k, "user", f"t{k}") for k in range(40)] + [(31, k, "user", f"t{k}") for k in range(39)]
    rows += [(40, 0, "user", ""), (41, 0, "user", None), (42, 0, None, ""), (43, 0, "", "")]
    return rows


@pytest.mark.parametrize("block, segment", [(4096, 4096), (7, 8)])
def test_snapshots_collapse(spark, monkeypatch, block, segment):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("mine"))
    talks = {}
    low = lambda x: (x is not None, x or "")
    for conv, turn, role, text in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] is not None, r[1] or 0, low(r[2]), low(r[3]))):
        talks.setdefault(conv, []).append((role, text))
    groups = {}
    for conv, turns in talks.items():
        groups.setdefault(tuple(turns), []).append(conv)
    wanted = {}
    for turns, convs in groups.items():
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in groups):
            wanted[min(convs)] = "".join(f"<|im_start|>{r or 'unknown' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in turns)
    got = {}
    for r in sorted(chat.format_chats(df, segment_turns=segment).collect(), key=lambda r: (r["conv_id"], r["segment"])):
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["rendered"]
    assert got == wanted
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_plan_is_native(spark):
    turns = chat.placed_turns(spark.read.parquet(f"{SF}/conversations.parquet"))
    plan = chat.render(turns, chat.maximal(turns))._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow", plan)


# --- pages -----------------------------------------------------------------------------------------


def article_by_hand(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1].replace("<br>", " ")
    blocks = [" ".join(html_lib.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside)]
    return "\n".join(filter(None, blocks))


def test_page_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = html_text.op7_html(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article_by_hand(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


LONG = "the house of the river and the hill is on the road to the field " * 5


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just words", "just words"),
        ("<p>a&amp;b&nbsp; c<br>d<br><br>e", "a&b c d\ne"),
        ("<article><p>A &lt; B</p><aside>no</aside><div class='comments'><p>no</div><p>short</article><footer>no</footer>", "A < B\nshort"),
        (f"<div id=menu><a href=/>Home</a></div><div>Cookie text</div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><p><a href=x>links</a>", f"{LONG.strip()}\nShort.\n{LONG.strip()}"),
        ("<script>if (a<b) {'</p>'}</script><main><h1>T</h1><form>f<p>g</form><p hidden>h</p><p title='x>y'>ok</main>", "T\nok"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>x</p></article>", "Title\nx"),
        ("<p>a<script>never closed", "a"),
        ("<!-- open comment <p>a", ""),
    ],
)
def test_page_rules(page, text):
    assert html_text.main_text(page or "") == text


def test_page_edges(spark):
    rows = spark.createDataFrame([(1, "u", None, "mine"), (2, None, "", "mine"), (2, None, "<p>x", "mine"), (None, "u", f"<p>{LONG * 900}", "mine")], "page_id long, url string, html string, Text string")
    got = html_text.extract(rows).collect()
    assert [r["n_chars"] for r in got] == [0, 0, 1, len((LONG * 900).strip())]
    assert html_text.extract(rows.where("false")).count() == 0


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline_by_hand(spark):
    """Each stage's brute-force version, one after the other, on the small tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.orderBy("doc_id").collect()]
    model = language.learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    bins, firsts = language.gram_bins([t for _, t, _ in rows])
    rows = [r[:2] for r, a, b in zip(rows, firsts, firsts[1:]) if model.infer(bins[a:b])[0]]
    comp, _ = near_components(rows)
    first = {}
    for (i, _), c in zip(rows, comp):
        first[c] = min(i, first.get(c, i))
    rows = [r for r, c in zip(rows, comp) if first[c] == r[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not hits_by_hand(r[1], items)[1]]
    own = bpe.PrefixBpe()
    wanted = {}
    for i, t in rows:
        masked = pii.mask(t, pii.find(t)[1])
        wanted[i] = own.encode(masked)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r["ids"] for i, r in got.items()} == wanted
    assert all(r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() for r in got.values())


def test_stages_keep_the_columns_and_take_edges(spark):
    docs = edge_docs(spark)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for rows in (docs, no_docs(spark)):
        out = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            assert out.count() <= rows.count()
