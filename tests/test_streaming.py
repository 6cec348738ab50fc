"""A growing LSH store: pairs across batches, pruning, repeated batches."""

from nearspark.operators import minhash as MH
from nearspark.operators import text as TX
from nearspark.streaming import lsh_store as ST


def signatures(spark, rows):
    return MH.signatures(TX.bag_of_words(spark.createDataFrame(rows, "doc_id long, text string"))).cache()


def pairs(df):
    return sorted((r.id1, r.id2, round(r.value, 3)) for r in df.collect())


BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_a_later_batch_meets_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "store")
    one = signatures(spark, [(1, BASE), (2, BASE + " phi"), (9, "quite other words stand here")])
    two = signatures(spark, [(3, BASE), (4, "quite other words stand here")])
    want = pairs(ST.pairs_of_batch(one, path, 0))
    assert [p[:2] for p in want] == [(1, 2)]
    ST.append(one, path, 0)
    across = pairs(ST.pairs_of_batch(two, path, 1))
    assert [p[:2] for p in across] == [(1, 3), (2, 3), (4, 9)]
    ST.append(two, path, 1)
    ST.append(two, path, 1)  # a batch that is run again replaces its partitions
    entries = spark.read.parquet(path + "/entries")
    assert entries.count() == 5 * 16
    assert pairs(ST.pairs_of_batch(two, path, 1)) == across  # and does not meet itself
    assert pairs(ST.pairs_of_batch(one, path, 0)) == want


def test_a_batch_reads_only_its_prefixes(spark, tmp_path):
    path = str(tmp_path / "store")
    ST.append(signatures(spark, [(i, f"{BASE} word{i} more{i}") for i in range(20)]), path, 0)
    part = ST.stored_entries(spark, path, "bigint", 1, [3, 200])
    plan = part._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "prefix" in filters and "epoch" in filters
    assert {r.prefix for r in part.select("prefix").distinct().collect()} <= {3, 200}
    assert ST.stored_entries(spark, path, "bigint", 0, list(range(256))).count() == 0  # nothing before epoch 0


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    none = signatures(spark, [(1, "")])
    assert pairs(ST.pairs_of_batch(none, path, 0)) == []
    ST.append(none, path, 0)
    some = signatures(spark, [(1, BASE)])
    assert pairs(ST.pairs_of_batch(some, path, 1)) == []


def test_documents_in_a_folder_are_streamed(spark, tmp_path):
    from nearspark.plans.queries import QUERIES

    docs = spark.createDataFrame([(1, BASE), (2, BASE), (3, "quite other words"), (4, None)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "folder/documents.parquet"))
    (tmp_path / "file").mkdir()
    docs.toPandas().to_parquet(tmp_path / "file/documents.parquet")
    for kind in ("folder", "file"):
        got = QUERIES["stream_lsh_probe"][0](spark, str(tmp_path / kind)).collect()
        assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_signatures_are_made_once_for_store_and_index(spark, tmp_path):
    from pyspark.sql import functions as F
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<bigint>")
    def signature(i):
        made.add(1)
        return [i % 3] * 128

    from nearspark.streaming import lsh_probe as ST
    ST.save_index(spark.range(30).select(F.col("id").alias("doc_id"), signature("id").alias("signature")), str(tmp_path))
    index, sigs = ST.load_index(spark, str(tmp_path))
    assert (made.value, sigs.count(), index.count()) == (30, 30, 30 * 16)


def test_a_bag_that_is_read_once_is_not_stored(spark, sf, monkeypatch):
    from nearspark.plans import queries as Q

    def refused(*_args, **_options):
        raise AssertionError("the bag was stored")

    monkeypatch.setattr(Q, "materialize", refused)
    for name in ("minhash_pairs", "minhash_candidates", "minhash_pairs_match_fraction", "ranked_pairs", "minhash_pairs_tiled"):
        assert Q.QUERIES[name][0](spark, sf).count() > 0
