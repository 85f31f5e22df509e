"""Rows with a null id in substring dedup."""

from larkspur.llm import phrases


def test_rows_with_a_null_id_stay_whole_and_own_nothing(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    rows = [(None, text), (None, text), (None, f"{other} {other}"), (5, text), (7, f"x {other}"), (8, f"y {other}")]
    got = phrases.repeated_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, 0), (0, 0), (5, 0), (7, 0), (8, 30)]
    assert "null id stay whole" in phrases.__doc__.replace("\n", " ")
