"""The pipeline's stages, each against its own input, and the whole run."""

from collections import Counter

import corpus_pipeline as cp
from procura.llm import mixing, packing
from test_operators import AWKWARD, brute_components, brute_fingerprint, docs, lower, words

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    previous = table
    for number, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, previous, SF)
        out.write.parquet(f"{tmp_path}/{number}")
        out = spark.read.parquet(f"{tmp_path}/{number}")
        before, after = previous.collect(), out.collect()
        if name != "best-fit packing":
            assert out.columns == table.columns
        if name == "exact dedup":
            best = {}
            for r in before:
                best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(best.values())
        elif name == "SimHash near-dedup":
            ordered = sorted(before, key=lambda r: r["doc_id"])
            roots = brute_components([brute_fingerprint(r["text"]) for r in ordered])
            assert sorted(r["doc_id"] for r in after) == sorted(ordered[i]["doc_id"] for i in set(roots))
        elif name == "mixing sources":
            total = sum(len((r["text"] or "").encode().split()) for r in before)
            taken = sum(len((r["text"] or "").encode().split()) for r in after)
            assert abs(total - taken) <= mixing.BLOCK * 60
        elif name == "best-fit packing":
            want = Counter()
            for r in before:
                want[r["doc_id"]] += len((r["text"] or "").encode().split())
            got = Counter()
            for r in after:
                got[r["doc_id"]] += r["length"]
            assert +got == +want and all(r["capacity"] in (*packing.CAPACITIES, None) for r in after)
        else:
            assert 0.5 * len(before) < len(after) < len(before)
        previous = out


def test_awkward_and_empty_documents_pass_all_stages(spark, tmp_path):
    for case, rows in (("awkward", AWKWARD), ("empty", [])):
        previous = docs(spark, rows)
        for number, (_, stage) in enumerate(cp.STAGES):
            mixed = previous.collect()
            stage(spark, previous, SF).write.parquet(f"{tmp_path}/{case}{number}")
            previous = spark.read.parquet(f"{tmp_path}/{case}{number}")
        packed = previous.collect()
        assert sum(r["length"] for r in packed) == sum(len(words(r["text"])) for r in mixed)
        assert len(packed) >= len(mixed) and bool(mixed) == bool(rows)


def test_run(spark):
    assert cp.run(spark, SF).count() > 50
