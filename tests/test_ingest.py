"""Ingest: insert-or-ignore into a stored page table."""

import pytest
from pyspark.sql import functions as F

from nearspark.sources import pages as PG

SCHEMA = "url string, html string, filename string, offset long"


def stored(spark, path):
    return {r.url: r.html for r in spark.read.parquet(path).collect()}


def test_insert_or_ignore_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "store")
    one = spark.createDataFrame([("a", "a1", "f", 1), ("a", "a0", "f", 0), ("b", "b1", "f", 2), (None, "x", "f", 3)], SCHEMA)
    two = spark.createDataFrame([("b", "b2", "f", 0), ("c", "c2", "g", 0), ("c", "c1", "f", 9)], SCHEMA)
    PG.insert_or_ignore(one, path, 1)
    assert stored(spark, path) == {"a": "a0", "b": "b1"}
    PG.insert_or_ignore(two, path, 2)
    assert stored(spark, path) == {"a": "a0", "b": "b1", "c": "c1"}
    PG.insert_or_ignore(two, path, 2)  # a repeated load changes nothing
    PG.insert_or_ignore(one, path, 1)
    assert spark.read.parquet(path).count() == 3 and stored(spark, path)["b"] == "b1"
    PG.insert_or_ignore(one.limit(0), path, 3)
    assert spark.read.parquet(path).count() == 3


def test_insert_reads_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    many = spark.range(400).select(F.concat(F.lit("http://x/"), "id").alias("url"), F.lit("h").alias("html"),
                                   F.lit("f").alias("filename"), F.col("id").alias("offset"))
    PG.insert_or_ignore(many, path, 1, buckets=16)
    all_files = len(spark.read.parquet(path).inputFiles())
    part = PG.stored_urls(spark, path, [3, 5], 2)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "html" not in plan.split("ReadSchema")[1].splitlines()[0]
    assert {r.bucket for r in part.select("bucket").distinct().collect()} == {3, 5}
    assert all_files == 16 and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_insert_into_a_new_table_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    PG.insert_or_ignore(spark.createDataFrame([], SCHEMA), path, 1)
    PG.insert_or_ignore(spark.createDataFrame([("a", "h", "f", 1)], SCHEMA), path, 2)
    assert stored(spark, path) == {"a": "h"}


def test_missing_table_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        PG.read_pages(spark, str(tmp_path / "none"))


def test_index_file_scan_keeps_corrupt_lines(spark, tmp_path):
    from nearspark.sources import index as IX
    (tmp_path / "idx.json").write_text('{"url": "https://a/", "status": "200", "offset": "5", "length": "7"}\nnot json\n{"url": "b"}\n')
    got = {(r.url, r.bad) for r in IX.read_index(spark, str(tmp_path), corrupt_col="bad").collect()}
    assert got == {("https://a/", None), (None, "not json"), ("b", None)}
    assert IX.byte_ranges(IX.read_index(spark, str(tmp_path))).filter("start IS NOT NULL").first().range == "bytes=5-11"


def test_warc_ranges_are_read_together(spark, sf, tmp_path, monkeypatch):
    from nearspark.sources import index as IX
    from nearspark.sources import warc as WA
    pages = spark.read.parquet(f"{sf}/pages.parquet").repartition(1)
    index = WA.write_warc(pages, f"file:{tmp_path}/w", broken_col=None).collect()
    plan = sorted((r.filename, int(r.offset), int(r.offset) + int(r.length) - 1) for r in index)
    runs = list(WA._adjacent(plan))
    assert len(runs) == 1 and len(runs[0][1]) == len(plan) == 2 * pages.count()
    single = [bytes(raw) for fn, ranges in WA._adjacent([plan[0], plan[2]]) for _, raw in WA._read_ranges(fn, ranges)]
    joined = [bytes(raw) for _, raw in WA._read_ranges(*runs[0])]
    assert single == [joined[0], joined[2]]
    gone = list(WA._read_ranges(f"{tmp_path}/none.gz", [(0, 3), (4, 9)]))
    assert [s for s, _ in gone] == [0, 4] and all(isinstance(e, Exception) for _, e in gone)
    df = spark.createDataFrame(index).union(spark.createDataFrame([("u", f"{tmp_path}/none.gz", "0", "9", "response")]))
    fetched = WA.fetch_records(IX.byte_ranges(df)).collect()
    assert sum(r.error is None for r in fetched) == pages.count() and sum(r.error is not None for r in fetched) == 1


def test_saved_pairs_join_without_a_shuffle(spark, tmp_path):
    pairs = spark.range(1000).selectExpr("id AS id1", "id + 1 AS id2", "0.9D AS value")
    PG.save_pairs(pairs, str(tmp_path / "p"), table="stored_pairs_test")
    stored = PG.load_pairs(spark, table="stored_pairs_test")
    comps = spark.range(2000).selectExpr("id AS id1", "0 AS c").repartition(3)
    joined = stored.hint("merge").join(comps, "id1")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert joined.count() == 1000
    spark.sql("DROP TABLE stored_pairs_test")


def test_stage_counts_come_with_the_stage(spark):
    from nearspark.operators.counts import StageCounts, rows
    counts = StageCounts()
    kept = counts.taken(spark.range(10).filter("id > 3"), kept=rows(), total=F.sum("id"))
    counts.taken(spark.range(0), none=F.sum("id"), zero=rows())
    assert kept.count() == 6 and counts.numbers == {"kept": 6, "total": 39, "none": 0, "zero": 0}
    assert [tuple(r) for r in counts.frame(spark).collect()] == [("kept", 6), ("total", 39), ("none", 0), ("zero", 0)]


def test_workflow_runs_by_method_name(spark, sf, tmp_path):
    from nearspark.operators.counts import StageCounts
    from nearspark.plans import workflow as WF
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for method, options in (("simhash", {}), ("minhash_lsh", {"jaccard_threshold": 0.5}), ("latent_semantic", {"n_components": 8, "n_iter": 1})):
        counts = StageCounts()
        row = WF.run(WF.page_bag(pages, method), method, "url", str(tmp_path / method), counts=counts, **options).first()
        stored = spark.read.parquet(str(tmp_path / method))
        assert row.n_results == stored.count() == counts.numbers["pairs"] and row.n_labels == counts.numbers["labels"]
        assert "rank" in stored.columns
    with pytest.raises(ValueError):
        WF.page_bag(pages, "nearest")
