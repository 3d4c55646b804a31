from checks import queries
from inkwell.sources import corpus


def test_documents_are_placed_before_pairs_are_made(spark, tmp_path, monkeypatch):
    """Over a table that scans in many partitions and so is not spread, no row per pair goes through a shuffle."""
    monkeypatch.setattr(corpus, "spread", lambda df, key: df)
    rows = [(1, "alpha beta gamma delta. beta gamma"), (1, "alpha beta"), (2, None), (None, "gamma delta"), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = queries.token_window_pairs(spark, str(tmp_path))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("w1" in line for line in exchanges)
    got = {(r["doc_id"], r["idx"], r["distance"], r["w1"], r["w2"]): r["n"] for r in pairs.collect()}
    assert got[1, 0, 1, "alpha", "beta"] == 2 and got[None, 0, 1, "gamma", "delta"] == 1
