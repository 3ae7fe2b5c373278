import random

from pyspark.sql import functions as F

from palimpsest.operators import chunking, locators, parsing
from palimpsest.operators.locators import locator, merged


def test_offsets_cut_out_the_block():
    text = "# Head\n\nFirst line\nsecond line\n\n- one\n- two\n\n```py\ncode here\n```\n\nTail text."
    for b in parsing.text_to_blocks(text):
        assert b["text"] in text[b["off_from"] : b["off_to"]]


def test_merging():
    page, off = (lambda a, b: locator("page", None, a, b)), (lambda a, b: locator("offset", None, a, b))
    cell = lambda s, a, b: locator("sheet", s, None, None, a, b)
    assert merged([]) is None and merged([None]) is None
    assert merged([page(3, 3), None, page(1, 2)]) == page(1, 3)
    assert merged([off(5, 9), off(20, 30)]) == off(5, 30)
    assert merged([page(1, 1), off(1, 2)]) is None
    assert merged([cell("S", "A1", "C1"), cell("S", "A2", "B2")]) == cell("S", "A1", "B2")
    assert merged([cell("S", "A1", "C1"), cell("T", "A2", "B2")]) is None
    assert merged([locator("path", "/a"), locator("path", "/b")]) == locator("path", "/a")


def test_written_forms(spark):
    places = [locator("page", None, 3, 3), locator("page", None, 3, 4), locator("sheet", "S", None, None, "A1", "A1"), locator("sheet", "S", None, None, "A1", "B2"), locator("path", "/a/b"), locator("offset", None, 0, 7), None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(places)], f"i int, at {locators.LOCATOR}")
    got = [r.w for r in df.select("i", locators.written(F.col("at")).alias("w")).orderBy("i").collect()]
    assert got == ["p.3", "pp.3-4", "S!A1", "S!A1:B2", "/a/b", "chars 0-7", None]


def test_every_chunk_cites_its_place(spark):
    rng = random.Random(6)
    paragraphs = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 300))) for _ in range(30)]
    text = "\n\n".join(f"## H{i}\n\n{p}" if i % 7 == 0 else p for i, p in enumerate(paragraphs))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = chunking.chunk_page_blocks(parsing.markdown_blocks(docs)).collect()
    assert {r.doc_id for r in rows} == {1} and len(rows) > 5
    for r in rows:
        body = r.content.split("\n\n", 1)[1] if " > " in r.content.split("\n")[0] or r.content.startswith("H") else r.content
        cited = text[r.locator["first"] : r.locator["last"]]
        assert all(w in cited for w in body.split() if w.startswith("w"))


def test_blocks_without_locators_have_none(spark):
    df = spark.createDataFrame([(1, 0, "paragraph", None, "some text", None)], "doc_id long, pos int, kind string, level int, text string, header string")
    assert [(r.content, r.locator) for r in chunking.chunk_page_blocks(df).collect()] == [("some text", None)]


def test_json_blocks_carry_pointers(spark):
    df = spark.createDataFrame([(1, '{"a/b": {"c": 1}, "d": 2}'), (2, "[1, 2]"), (3, "not json")], "doc_id long, text string")
    got = {(r.doc_id, r.locator["place"]) for r in parsing.json_blocks(df).collect()}
    assert got == {(1, "/a~1b"), (1, "/d"), (2, "/")}


def test_page_rules(spark):
    long = "A para\u00adgraph of  quite   enough\ntext to be kept here.\n\n\n\nAnd another one\tof text."
    df = spark.createDataFrame([(1, 1, long), (1, 2, "short"), (1, 3, None), (2, 1, " \n "), (None, 1, "x" * 40)], "doc_id long, page int, text string")
    got = sorted(((r.doc_id, r.text, r.locator["first"]) for r in locators.page_blocks(df).collect()), key=repr)
    assert got == [(1, "A paragraph of quite enough text to be kept here.", 1), (1, "And another one of text.", 1), (None, "x" * 40, 1)]
    assert {(r.doc_id, r.extracted, r.skipped) for r in locators.page_units(df).collect()} == {(1, 1, 2), (2, 0, 1), (None, 1, 0)}
    assert locators.page_blocks(df.limit(0)).count() == 0 == locators.page_units(df.limit(0)).count()


def test_batches_are_cut_in_parts_of_bounded_size():
    """No row is lost or moved, and no part but a single long row is larger than the bound."""
    import pyarrow as pa

    texts = ["a" * 400_000, None, "", "b" * 3_000_000, *["c d " * 50] * 1_200, "e" * 700_000, "f" * 700_000]
    for column in (pa.array(texts), pa.array([[{"text": t}] for t in texts])):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), column], ["k", "t"])
        parts = [*chunking._parts(batch)]
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
        assert all(len(p) <= chunking.PART_ROWS for p in parts) and len(parts) > 3
    sizes = [sum(len(t or "") for t in p.column(1).to_pylist()) for p in chunking._parts(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"]))]
    assert sum(s > chunking.PART for s in sizes) == 1
