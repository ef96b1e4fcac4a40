"""Words made wholly of look-alikes, which only their skeleton's originals tell (problem 7)."""

from __future__ import annotations

from refrain.llm import lookalikes


def test_whole_words_of_lookalikes(spark, tmp_path):
    a = "А"  # Cyrillic
    titles = ["A Song", f"{a} Song", "Песня о тебе", "Песня o тебе", f"{a} Lone Song", "می‌روم", "میروم"]
    spark.createDataFrame(list(enumerate(titles)), "candidate_id long, title string").write.parquet(f"{tmp_path}/candidates.parquet")
    spark.createDataFrame([(1, "A Song", f"{a} Song"), (2, None, "A Song")], "track_id long, current_title string, filename string").write.parquet(f"{tmp_path}/tracks.parquet")
    got = {tuple(r) for r in lookalikes.found(spark, str(tmp_path)).collect()}
    assert got == {("candidates", 1, "title"), ("candidates", 3, "title"), ("tracks", 1, "filename")}
    n = {r["skeleton"]: (r["n_originals"], r["n_rows"]) for r in lookalikes.groups(spark, str(tmp_path)).collect()}
    assert n["A Song"] == (2, 5)
