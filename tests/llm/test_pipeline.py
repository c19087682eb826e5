"""The pipeline stage by stage on the smallest tables."""

import corpus_pipeline
from vitrine.llm import common, decontam, linededup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    texts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        texts.append({r.doc_id: r for r in docs.collect()})
    first, lined, single, clean = texts
    assert lined.keys() == first.keys() and single.keys() <= lined.keys() and clean.keys() <= single.keys()
    assert all(r.n_chars == len(r.text or "") for r in lined.values())
    holders = {}
    for i, r in lined.items():
        for key in set(linededup.keys_of(r.text, 20)) - {None}:
            holders.setdefault(key, []).append(i)
    assert all(len(h) < 3 for h in holders.values())
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    plain = lambda t: " " + " ".join(decontam.WORD.findall((t or "").lower())) + " "
    held = {i for i, r in single.items() if any(plain(x) in plain(r.text) for x in items.values())}
    assert not held & clean.keys()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == clean.keys()


def test_empty_and_odd(spark, docs, no_docs):
    """Columns beyond those of documents stay too; empty tables pass."""
    for table in (no_docs, docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table.withColumn("n_chars", common.F.lit(1).cast("long")), SF)
            assert out.columns == [*table.columns, "n_chars"], name
            assert out.count() <= table.count()
