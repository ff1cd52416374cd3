"""The pipeline's stages on a small corpus, against what each must keep and change."""

import re

import corpus_pipeline
from skytile.llm import surrogates


def brute_groups(rows, k, percent):
    """doc_id -> smallest id of its group."""
    sets, link = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])
        link[d] = d

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                link[y] = x
    return {d: root(d) for d in sets}


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").unionByName(
        spark.createDataFrame([(1000, None, "en", "src1", 0), (1001, "123 456", "en", "src1", 7), (1002, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    given = {r.doc_id: r.text for r in docs.collect()}

    kept = spark.createDataFrame(corpus_pipeline.identify(spark, docs, str(tmp_path)).collect(), docs.schema)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == set(given) - {1000, 1001, 1002}

    once = spark.createDataFrame(corpus_pipeline.near_duplicates(spark, kept, str(tmp_path)).collect(), docs.schema)
    groups = brute_groups([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert {r.doc_id for r in once.collect()} == set(groups.values())

    private = spark.createDataFrame(corpus_pipeline.personal_data(spark, once, str(tmp_path)).collect(), docs.schema)
    for r in private.collect():
        old = {e[4] for e in surrogates.entities(given[r.doc_id])}
        assert not old & {e[4] for e in surrogates.entities(r.text)} and (old or r.text == given[r.doc_id])

    mixed = corpus_pipeline.mixture(spark, private, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in private.collect()}

    pieces = corpus_pipeline.packed(spark, spark.createDataFrame(mixed, docs.schema), str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in mixed}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(p.length for p in whole) == sum(p.length for p in pieces)
