"""Queries over whole tables and whole texts."""

from quarry.catalog import QUERIES


def test_proposals_are_judged_by_their_whole_texts(spark, tmp_path):
    same = " ".join(["alpha"] * 20)  # over 80 characters
    rows = [(1, 0, "user", f"{same} one"), (1, 1, "user", f"{same} two"), (1, 2, "user", f"{same} one"), (2, 0, "user", f"{same} " * 5), (2, 1, "user", f"{same} " * 2), (2, 2, "assistant", same)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["query_id"], r["n"]): r["reason"] for r in QUERIES["proposal_admission"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): "accepted", (1, 2): "duplicate", (2, 1): "word_budget"}
