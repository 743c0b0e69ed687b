"""Evaluation rows: passages without a key, and subsections."""

from granary.operators import evaluation


def test_ranks_close_up_over_null_keys_and_subsections_have_a_recall(spark):
    cases = spark.createDataFrame([(1, [20], ["a", "b"]), (2, [], []), (3, [30], []), (4, [], []), (5, [50], None)], "item_id long, expected array<bigint>, expected_subsections array<string>")
    found = [(1, 1, None, "b"), (1, 2, 20, ""), (1, 3, 21, None), (1, 4, 22, "a"), (2, 1, None, None), (3, 1, 31, "c"), (3, 2, None, "c"), (3, 3, 30, "c")]
    retrieved = spark.createDataFrame(found, "item_id long, rank int, key bigint, subsection string")
    rows = evaluation.evaluation_rows(cases, retrieved, "item_id", [3, 5])
    got = {(r.item_id, r.top_k): (r.got, r.recall, r.reciprocal_rank, r.passed, r.got_subsections, r.subsection_recall) for r in rows.collect()}
    assert got[1, 3] == ([20, 21], 1.0, 1.0, True, ["b"], 0.5)
    assert got[1, 5] == ([20, 21, 22], 1.0, 1.0, True, ["b", "a"], 1.0)
    assert got[2, 3] == ([], None, None, False, [], None)  # a passage without a key is still a passage
    assert got[3, 3] == ([31, 30], 1.0, 0.5, True, ["c"] * 3, None)
    assert got[4, 3] == ([], None, None, True, [], None)
    assert got[5, 3] == ([], 0.0, 0.0, False, [], None)
    means = {r.top_k: r.subsection_recall for r in evaluation.evaluation_summary(rows, ["top_k"]).collect()}
    assert means == {3: 0.5, 5: 1.0}
    plain = evaluation.evaluation_rows(cases.drop("expected_subsections"), retrieved, "item_id", [3])
    assert "subsection_recall" not in plain.columns + evaluation.evaluation_summary(plain, ["top_k"]).columns
