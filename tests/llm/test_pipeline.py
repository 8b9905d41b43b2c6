"""The pipeline's rows against its stages by brute force on the smallest tables."""

import corpus_pipeline
from shelfspark.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from shelfspark.llm.common import table

from llm.test_dedup import exact_brute, overlap_brute

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.scores(docs, table(spark, SF, "labels")).collect()}
    left = {i: t for i, t in rows.items() if not judged[i]}
    left = {i: left[i] for i, _, _, kept, _ in exact_brute(list(left.items())) if kept}
    near = near_dedup.near_classes(docs.filter(docs["doc_id"].isin(list(left)))).collect()
    left = {r["doc_id"]: left[r["doc_id"]] for r in near if r["kept"]}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = {i for i, _ in overlap_brute(list(left.items()), items)}
    want = set(left) - bad
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    tokens = {r["doc_id"]: r["n_tokens"] for r in bpe.digests(bpe.encode(docs)).collect()}
    assert all(r["n_tokens"] == tokens[r["doc_id"]] for r in got)


def test_stages_name_their_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe_encoding"]
    assert exact_dedup and decontaminate
