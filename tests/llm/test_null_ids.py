"""Near copies whose ids are null."""

from plotline.llm import ngram_join


def test_near_copies_of_which_one_has_no_id(spark):
    w = [f"w{i}" for i in range(60)]
    near = " ".join(["v0", *w[1:]])
    rows = [(7, " ".join(w)), (None, near), (None, near), (8, "alone in this table of few words"), (None, " ".join(f"x{i}" for i in range(60))), (None, " ".join(f"x{i}" for i in range(59)))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(7, 56, 7), (None, 56, 7), (None, 56, 7), (8, 3, 8), (None, 56, None), (None, 55, None)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)
