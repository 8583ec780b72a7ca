"""Every labelled row outside the held-out fold is learned from."""

from levelloom.llm import toxicity


def test_rows_beyond_the_first_are_learned_from(spark, monkeypatch):
    sf, seen = "/root/testdata/sf0.01", []
    monkeypatch.setattr(toxicity, "_refine", lambda model, others, size, toxic: seen.append((others.count(), size)) or model)
    toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), per_class=5)
    assert seen and seen[0][0] > 0 and seen[0][1] > 0
