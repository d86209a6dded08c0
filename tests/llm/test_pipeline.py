import corpus_pipeline
import public_tokenizers
from landmarq.llm import mixing, simhash
from tokenizers import Tokenizer


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "mix_sources", "encode"]
    at, made = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = made[name] = stage(spark, at, sf).cache()
        if name != "encode":
            assert at.schema.names == docs.schema.names
    # Every text of this table is in a language, so none goes.
    assert {r.doc_id for r in made["language_id"].collect()} == {r.doc_id for r in docs.collect()}
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(made["language_id"]).collect()}
    assert sorted(r.doc_id for r in made["near_dedup"].collect()) == sorted(set(classes.values()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    least = {}
    for i, t in texts.items():
        least[t] = min(i, least.get(t, i))
    assert len({texts[r.doc_id] for r in made["near_dedup"].collect()}) == made["near_dedup"].count()
    copies = {r.doc_id: r.copies for r in mixing.mix(made["near_dedup"]).collect()}
    taken = [r.doc_id for r in made["mix_sources"].collect()]
    assert {i: taken.count(i) for i in set(taken)} == {i: n for i, n in copies.items() if n}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = made["encode"].collect()
    assert sorted(r.doc_id for r in rows) == sorted(taken)
    for r in rows[:200]:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, sf).count() == len(rows)


def test_odd_rows(spark, odd_docs, no_docs, sf):
    for start in (odd_docs, no_docs):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, sf)
            at.count()
