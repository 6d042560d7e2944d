import corpus_pipeline as C
from orderlens.llm.queries import ORACLE, QUERIES


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, columns = {r.doc_id for r in docs.select("doc_id").collect()}, docs.columns
    from orderlens.llm.jaccard_join import jaccard_classes
    from orderlens.llm.support import materialize

    for name, stage in C.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, folder), name)
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids
        if name == "quality":
            assert 0.7 * len(ids) < len(left) < len(ids)
        if name == "near_duplicates":
            want = {r.doc_id for r in jaccard_classes(before).where("doc_id = component_id").collect()}
            assert left == want and docs.count() == len(left)
        if name == "substring_dedup":
            assert left == ids and docs.where("char_length(text) <> n_chars").isEmpty()
        ids = left
    out = C.STAGES[-1][1](spark, docs, folder)
    assert out.count() == docs.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_operator_is_registered():
    assert {k.split("_")[0] for k in QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
    assert set(ORACLE) <= set(QUERIES)
