"""Prompts of a batch answered in order, against a one-by-one model."""

import math
import random
import re
from collections import Counter

import pytest

from procura.operators.batch_cache import SIMILARITY_DIGITS, resolve_in_order
from procura.operators.conversation import prompt_key
from procura.operators.runs import PRIMARY_MODEL
from procura.operators.search import STOP_WORDS

WORDS = "price supplier contract invoice delivery steel copper freight tax audit".split()


def terms(text):
    return Counter(w for w in re.split(r"[^\w]+", text.lower()) if w and w not in STOP_WORDS)


def one_by_one(prompts, cache, threshold):
    """{prompt_id: (source, cache_id, answered_by, similarity)}: each prompt sees what those before it stored."""
    by_key = {}
    for cache_id, tenant, key, text, embedded in sorted(cache, key=lambda c: c[0]):
        by_key.setdefault((tenant, key), (cache_id, text, embedded))
    known = [terms(text) for _, text, embedded in by_key.values() if embedded]
    idf = {t: math.log((len([k for k in known if k]) + 1) / (sum(t in k for k in known) + 1)) for t in set().union(*known)}

    def vector(text):
        v = {t: n * idf[t] for t, n in terms(text).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    entries = [(t, 0, i, vector(text)) for (t, _), (i, text, embedded) in by_key.items() if embedded]
    stored, out = {}, {}
    for pid, _, tenant, text, key in sorted(prompts, key=lambda p: p[1]):
        v = vector(text)
        if (tenant, key) in by_key:
            out[pid] = ("cache_exact", by_key[tenant, key][0], None, None)
        elif (tenant, key) in stored:
            out[pid] = ("cache_exact", None, stored[tenant, key], None)
        else:
            found = []
            for t, own, i, w in entries:
                similarity = sum(x * w.get(term, 0.0) for term, x in v.items())
                if t == tenant and v and w and similarity >= threshold - 1e-12:
                    found.append((-round(similarity, SIMILARITY_DIGITS), own, i))
            if found:
                neg, own, i = min(found)
                out[pid] = ("cache_semantic", None if own else i, i if own else None, -neg)
            else:
                out[pid] = ("miss", None, None, None)
                stored[tenant, key] = pid
                entries.append((tenant, 1, pid, v))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75])
def test_batch_answers_later_prompts(spark, threshold):
    rng = random.Random(int(threshold * 100))

    def text():
        return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "?", " unknownword", " the"])

    asked = [(f"p{i:03}", i, rng.randrange(2), text()) for i in range(150)]
    asked += [(f"p{150 + i}", 150 + i, 1, "steel tax") for i in range(40)] + [("p190", 190, 0, "unheard of"), ("p191", 191, 0, "unheard  OF"), ("p192", 192, 1, "")]
    cached = [(f"c{i:02}", rng.randrange(2), text(), rng.random() < 0.8) for i in range(25)]
    cached += [(f"c9{i}", i % 2, w, True) for i, w in enumerate(WORDS)]
    from pyspark.sql import functions as F

    prompts = spark.createDataFrame(asked, "prompt_id string, seq long, tenant_id int, prompt string")
    cache = spark.createDataFrame([(*c[:3], "answer " + c[0], c[3]) for c in cached],
                                  "cache_id string, tenant_id int, prompt_text string, response_text string, has_embedding boolean") \
        .withColumn("query_hash", prompt_key(F.col("tenant_id"), F.col("prompt_text"), PRIMARY_MODEL))
    keys = {r["cache_id"]: r["query_hash"] for r in cache.collect()}
    asked_keys = {r["prompt_id"]: r["k"] for r in prompts.select(
        "prompt_id", prompt_key(F.col("tenant_id"), F.col("prompt"), PRIMARY_MODEL).alias("k")).collect()}
    want = one_by_one([(*a, asked_keys[a[0]]) for a in asked], [(c[0], c[1], keys[c[0]], c[2], c[3]) for c in cached], threshold)
    got = {r["prompt_id"]: r for r in resolve_in_order(prompts, cache, threshold).collect()}
    assert got.keys() == want.keys()
    for pid, (source, cache_id, answered_by, similarity) in want.items():
        r = got[pid]
        assert (r["source"], r["cache_id"], r["answered_by"]) == (source, cache_id, answered_by), pid
        assert (r["similarity"] is None) == (similarity is None) and (similarity is None or abs(r["similarity"] - similarity) < 1e-6)
        assert r["response_text"] == (f"answer {cache_id}" if cache_id else None)
    assert {s for s, *_ in want.values()} == {"cache_exact", "cache_semantic", "miss"}
    assert resolve_in_order(prompts.limit(0), cache, threshold).count() == 0
    assert resolve_in_order(prompts, cache.limit(0), threshold).count() == len(asked)
