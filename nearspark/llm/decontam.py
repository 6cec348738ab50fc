"""Benchmark decontamination: which texts contain which test items.

Size-partitioned MinHash containment search (``windows.search``), then exact
containment: an item leaks into a text when at least ``threshold`` of the item's
distinct 5-word shingles occur in it. Null and empty texts and items match
nothing; an item of fewer than five words matches only a text that consists of
those words. Repeated rows give one result per distinct row; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm.windows import search


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8,
                 recall: float = 0.999999, max_hashes: int = 128) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared)`` of every leak."""
    found = search(docs, items, id_col, text_col, item_col, item_text_col, threshold, recall, max_hashes)
    return found.select("doc_id", F.col("item").alias("item_id"), "n_item", "n_shared").distinct()


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Rows of ``docs`` that hold no test item."""
    bad = contaminated(docs, items, id_col, **how).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[id_col] == F.col("_bad"), "left_anti")
