"""Items of few words and items behind headings."""

from __future__ import annotations

from abyssal.llm import decontaminate


def test_short_items_are_found_behind_anything(spark):
    bench = [(1, "The red gate stays open late"), (2, "Name three old rivers"), (3, "Solve 7 plus 5"), (4, "Km are longer than most people think"), (5, ""), (6, "Where did Anna leave her blue umbrella")]
    text = {
        1: "a heading\nThe red gate stays open late", 2: "said he, The red gate stays open late", 3: "The red gate stays open late", 4: "Part one Name three old rivers please",
        5: "and Solve 7 plus 5", 6: "and Solve 8 plus 5", 7: "for 12 Km are longer than most people think", 8: "Other words, nothing held", 9: "by the old red gate", 10: None,
        11: "a question Where did Anna leave her blue umbrella", 12: "a question Where did Tom leave her blue umbrella", 13: "a question Tom did Anna leave her",
    }
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["exact"], r["n_windows"]) for r in found}
    assert got == {(1, 1): (True, 2), (2, 1): (True, 2), (3, 1): (True, 2), (4, 2): (True, 1), (5, 3): (True, 1), (7, 4): (True, 3), (11, 6): (True, 3), (12, 6): (False, 3)}
