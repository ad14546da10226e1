"""Blocks of vectors against each other: every pair once, exactly, and no pair in a shuffle."""

import math
import random

import pyarrow as pa
import pytest

from procura.operators import cache as ca
from procura.operators.blocks import block_pairs


def unit(rng, terms):
    v = {t: rng.random() + 0.1 for t in terms}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / norm for t, x in v.items()}


def vectors(rng, n, name):
    words = [f"w{i}" for i in range(40)]
    out = {(rng.randrange(3), f"{name}{i:03}"): unit(rng, rng.sample(words[:6], 2) + rng.sample(words, rng.randrange(1, 5)))
           for i in range(n)}
    return out | {(t, f"{name}z{k}"): {"w0": 0.6, "w39": 0.8} for t in range(2) for k in range(t * 2, t * 2 + 2)}


def similar(p, c, threshold):
    out = {}
    for (t, x), v in p.items():
        for (u, y), w in c.items():
            s = sum(a * w.get(term, 0.0) for term, a in v.items())
            if t == u and s >= threshold:
                out[x, y] = s
    return out


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_blocks_of_any_size_find_every_pair(spark, block):
    rng = random.Random(block)
    p, c = vectors(rng, 90, "p"), vectors(rng, 60, "c")
    frames = [spark.createDataFrame([(t, i, term, w) for (t, i), v in side.items() for term, w in v.items()] + [(None, "none", "w0", 1.0)],
                                    f"tenant_id int, {name} string, term string, weight double")
              for side, name in ((p, "prompt_id"), (c, "cache_id"))]
    want = similar(p, c, 0.5)
    pairs = ca._met(*frames, 0.5, best=False, block=block)
    got = {(r.prompt_id, r.cache_id): r.similarity for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = {r.prompt_id: r.cache_id for r in ca._met(*frames, 0.5, best=True, block=block).groupBy("prompt_id")
            .agg({"similarity": "max"}).select("prompt_id", "max(similarity)").withColumnRenamed("max(similarity)", "cache_id").collect()}
    assert best.keys() == {x for x, _ in want} and all(abs(s - max(v for (a, _), v in want.items() if a == x)) < 1e-9 for x, s in best.items())
    ties = {r.prompt_id: r.cache_id for r in ca.semantic_matches(*frames, 0.5).collect()}
    assert (ties["pz0"], ties["pz1"], ties["pz2"]) == ("cz0", "cz0", "cz2")
    # Vectors are dealt to blocks and scored there: nothing is shuffled after the pairs are made.
    plan = ca.similar_pairs(*frames, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan[:plan.index("FlatMapCoGroupsInArrow")]


def test_dense_and_posting_terms_add_up(monkeypatch):
    from procura.operators import blocks
    rng = random.Random(3)
    p, c = ({i: unit(rng, rng.sample([f"w{k}" for k in range(12)], 4)) for i in range(n)} for n in (70, 45))
    tables = [pa.table({"id": list(side), "terms": [list(v) for v in side.values()], "weights": [list(v.values()) for v in side.values()]})
              for side in (p, c)]
    want = similar({(0, i): v for i, v in p.items()}, {(0, i): v for i, v in c.items()}, 0.4)
    for dense in (0, 3, 512):
        monkeypatch.setattr(blocks, "DENSE_TERMS", dense)
        for cells, expanded in ((100, 10), (10_000, 1_000)):
            monkeypatch.setattr(blocks, "CELLS", cells)
            monkeypatch.setattr(blocks, "EXPANDED", expanded)
            got = block_pairs(*tables, 0.4, best=False).to_pydict()
            found = dict(zip(zip(got["prompt_id"], got["cache_id"]), got["similarity"]))
            assert len(got["prompt_id"]) == len(found) and found.keys() == want.keys()
            assert all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert len(block_pairs(tables[0].slice(0, 0), tables[1], 0.4, best=True)) == 0
