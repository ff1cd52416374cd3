"""What the near-duplicate join broadcasts."""

from skytile.llm import jaccard
from skytile.operators import graph


def test_no_table_that_grows_with_the_documents_is_broadcast(spark, monkeypatch):
    plans = []

    def noted(df, name="t", own=graph.stored):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return own(df, name)

    monkeypatch.setattr(jaccard, "stored", noted)
    monkeypatch.setattr(graph, "stored", noted)
    base = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{base} x{i % 3}" if i < 6 else f"{i} alone {i} here {i}") for i in range(9)], "doc_id long, text string")
    out = jaccard.join(docs, k=3, percent=80)
    assert {r.component_id for r in out.collect()} == {0, 6, 7, 8}
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert {"left", "sets", "index", "star", "edges"} <= {n for n, _ in plans}
    assert [n for n, p in plans if "BroadcastExchange" in p] == []
