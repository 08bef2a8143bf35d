from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailmix.functions import norm_name
from trailmix.operators import generated, logs, sequences, toplists
from trailmix.sources import store

from conftest import rows_of


def test_cohort_and_split(make_log):
    log = make_log([("a", "x", "X", 3, 5), ("a", "y", "Y", 4, 5), ("a", "z", "Z", 5, 1), ("b", "x", "X", 1, 1),
                    (None, "x", "X", 1, 1), (None, "y", "X", 1, 1), (None, "z", "X", 1, 1)])
    kept = logs.cohort(log, 3)
    assert {r.user_id for r in kept.collect()} == {"a"}
    train, test = logs.leave_one_out(kept)
    assert rows_of(test, "user_id", "item_id") == [("a", "y")]      # same day: the later row
    assert rows_of(train, "item_id") == [("x",), ("z",)]
    assert train.count() + test.count() == kept.count()


def test_duplicates_names_and_means(make_log):
    log = make_log([("a", "x", "Old Name", 1, 1), ("a", "x", "New  Name", 5, 2), ("b", "x", "New Name", 3, 0)])
    assert rows_of(logs.dedupe_last(log), "user_id", "rating") == [("a", 5.0), ("b", 3.0)]
    assert logs.global_mean(log).first()["mu"] == 3.0
    assert rows_of(logs.item_stats(log)) == [("x", 2, 4.0)]
    assert rows_of(logs.item_names(log)) == [("x", "new name")]
    assert rows_of(logs.catalog(log)) == [("x", "New Name", "new name")]       # first row is b's


def test_mask_by_id_but_dedupe_by_name(spark, make_log):
    train = make_log([("a", "s1", "Subway", 3, 1), ("b", "s2", "Subway", 3, 1), ("b", "t", "Taco", 3, 2)])
    cands = spark.createDataFrame([("a", "s1", 9.0), ("a", "s2", 8.0), ("a", "t", 1.0)],
                                  "user_id string, item_id string, score double")
    lists = toplists.top_n_names(cands, train, logs.item_names(train))
    assert rows_of(lists, "rank", "name", "item_id") == [(1, "subway", "s2"), (2, "taco", "t")]
    by_name = toplists.mask_seen_names(lists, generated.history_names(train))
    assert rows_of(by_name, "name") == [("taco",)]


def test_cold_targets(make_log):
    train = make_log([("a", "x", "X", 1, 1), ("b", "y", "Y", 1, 1)])
    test = make_log([("a", "y2", "y ", 1, 2), ("b", "q", "New", 1, 2)])
    row = logs.cold_targets(test, train).first()
    assert (row.n_test, row.n_cold, row.cold_share, row.hit_ceiling) == (2, 1, 0.5, 0.5)


def test_examples_pairs_and_recent(make_log):
    log = make_log([("a", f"i{d}", f"N{d}", 3, d) for d in range(6)] + [("b", "i1", "N1", 3, 0)])
    rows = rows_of(sequences.sliding_examples(log, 3, 2), "user_id", "pos", "context", "target")
    assert rows == [("a", 4, ["N1", "N2"], "N3"), ("a", 5, ["N2", "N3"], "N4"), ("a", 6, ["N3", "N4"], "N5")]
    texts = sequences.instruction_examples(sequences.sliding_examples(log, 3, 2)).orderBy("pos").first()
    assert texts.input == "Restaurants visited: N1, N2" and texts.output == "N3"
    assert rows_of(sequences.consecutive_pairs(log), "q", "i") == [(f"i{d}", f"i{d + 1}") for d in range(5)]
    assert rows_of(sequences.recent_items(log, 2), "user_id", "recency", "item_id") == [
        ("a", 1, "i5"), ("a", 2, "i4"), ("b", 1, "i1")]
    assert rows_of(sequences.recent_context(log, 2), "user_id", "context") == [("a", ["N4", "N5"]), ("b", ["N1"])]


def test_no_leaks_and_a_planted_one(spark, make_log):
    log = make_log([("a", f"i{d}", f"N{d}", 3, d) for d in range(6)])
    train, test = logs.leave_one_out(log)
    examples = sequences.instruction_examples(sequences.sliding_examples(train))
    assert sequences.leakage_check(examples, test, train).first().leaks == 0
    planted = spark.createDataFrame([("a", "n5")], "user_id string, output string")
    assert sequences.leakage_check(planted, test, train).first().leaks == 1


def test_bad_rows_are_rejected(make_log):
    with pytest.raises(Exception, match="positive"):
        logs.checked(make_log([("a", "x", "X", 0, 1)])).collect()
    nothing = make_log([("a", "x", "X", 1, 1)]).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    with pytest.raises(Exception, match="timestamp"):
        logs.checked(nothing).collect()


def test_csv_and_stores(spark, tmp_path):
    csv = tmp_path / "reviews.csv"
    csv.write_text('user_id,business_id,business_name,stars,date,text\n'
                   'a,x,"Joe ""J"" Bar",4,2012-01-02,"two\nlines"\n'
                   'a,y,Cafe  Ole,5,2012-01-02,t\na,z,,3,2011-05-05,t\n')
    log = store.read_interactions(spark, str(csv))
    assert rows_of(log, "item_id", "name", "rating") == [
        ("x", 'Joe "J" Bar', 4.0), ("y", "Cafe Ole", 5.0), ("z", "nan", 3.0)]
    train, test = logs.leave_one_out(log)
    assert rows_of(test, "item_id") == [("y",)]              # same day: file order decides
    path = str(tmp_path / "h")
    store.write_histories(logs.ordered_history(train), test, path)
    history, held = store.read_histories(spark, path)
    assert rows_of(history, "user_id", "pos", "name") == [("a", 1, "nan"), ("a", 2, 'Joe "J" Bar')]
    assert rows_of(held) == [("a", "Cafe Ole")]
    store.write_catalog(logs.catalog(log), str(tmp_path / "c"))
    assert ("x", 'Joe "J" Bar', 'joe "j" bar') in rows_of(store.read_catalog(spark, str(tmp_path / "c")))
    recs = spark.createDataFrame([("a", 2, "q"), ("a", 1, "p")], "user_id string, rank int, name string")
    store.write_recs(recs, str(tmp_path / "r"), users=log, raw=recs)
    assert rows_of(store.read_recs(spark, str(tmp_path / "r"))) == [("a", 1, "p"), ("a", 2, "q")]
    assert store.read_recs(spark, str(tmp_path / "r"), "recs_raw").count() == 2
    with pytest.raises(ValueError, match="missing"):
        store.read_attributes(spark, str(csv))


def test_generated_lists(spark, make_log):
    train = make_log([("u", "b", "B", 3, 1)])
    raw = spark.createDataFrame([("u", 0, "A"), ("u", 1, "a "), ("u", 2, ""), ("u", 3, "B"), ("u", 4, "Zed")],
                                "user_id string, pos int, text string")
    history = generated.history_names(train)
    assert rows_of(generated.distinct_beams(raw), "rank", "name") == [(1, "a"), (2, "b"), (3, "zed")]
    kept = generated.clean_lists(raw, history)
    assert rows_of(kept, "rank", "name") == [(1, "a"), (2, "zed")]
    items = spark.createDataFrame([("1", "A", "a"), ("2", "B", "b")], "item_id string, name string, norm_name string")
    assert rows_of(generated.catalog_restrict(kept, items), "name") == [("a",)]
    assert rows_of(generated.candidate_counts(history, items)) == [("u", 1, 1)]
    row = generated.generation_diagnostics(generated.distinct_beams(raw), kept, train, items).first()
    assert (row.n_lists, row.full_lists, row.mean_length) == (1, 0, 2.0)
    assert round(row.in_catalog_share, 4) == 0.6667 and round(row.dropped_share, 4) == 0.3333


def test_names_of_targets(make_log):
    test = make_log([("a", "x", " A  b ", 1, 1)])
    assert test.select(norm_name(F.col("name"))).first()[0] == "a b"
