import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallymill.llm import decontaminate
from tallymill.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert seen[name].keys() <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "bpe_encoding":
            assert docs.columns == columns and docs.schema == before.schema
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]
    texts = [r.text for r in seen["simhash_near_dedup"].values()]
    assert len({" ".join(t.lower().split()) for t in texts}) == len(texts)
    assert seen["substring_dedup"].keys() == seen["simhash_near_dedup"].keys()
    clean = spark.createDataFrame([(r.doc_id, r.text) for r in seen["benchmark_decontamination"].values()], "doc_id long, text string")
    assert decontaminate.overlaps(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).isEmpty()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in seen["bpe_encoding"].items():
        text = seen["benchmark_decontamination"][i].text
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded == text and r.n_tokens == len(r.ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == seen["bpe_encoding"].keys()
