from riskframe.llm import decontaminate


def test_copies_of_an_item_do_not_fill_a_block(spark):
    texts = [f"{k} " + " ".join(f"w{k}x{j}" for j in range(20)) for k in range(40)]
    rows = [(f"i{k}", t) for k, t in enumerate(texts)] + [("i0", texts[0])] * 400
    items = spark.createDataFrame(rows, "item_id string, text string")
    bound = 4000
    blocks = list(decontaminate.item_blocks(items, "item_id", "text", bound))
    assert sorted(x for b in blocks for x in b) == sorted((f"i{k}", t.encode()) for k, t in enumerate(texts))
    assert len(blocks) > 1 and max(sum(len(t) for _, t in b) for b in blocks) <= bound
