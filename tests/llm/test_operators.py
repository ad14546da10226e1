"""The training-data operators against brute force, and on awkward rows."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from procura.llm import exact_dedup, licenses, mixing, packing, quality, registry, sharding, simhash, substring, topk, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def docs(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names clash with outputs."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), True, 7) for i, t, s in rows], DOC)


AWKWARD = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (None, "one two three", "b"), (4, "one two three", "b"),
           (4, "one two three", "b"), (5, "ONE two Three", None), (6, LONG, "a"), (7, LONG + " end", "a"), (8, "É é", "c")]


def lower(t):
    return (t or "").encode().lower().decode()


def words(t):
    return (t or "").encode().split()


def test_exact_dedup_matches_grouping_by_text(spark):
    for hashed in (False, True):
        table = docs(spark, AWKWARD).withColumn("digest", F.sha2(exact_dedup.lower_ascii(F.col("text")), 256))
        got = exact_dedup.exact_dedup(table, hash_col="digest" if hashed else None).collect()
        groups = defaultdict(list)
        for i, t, _ in AWKWARD:
            groups[lower(t)].append(i)
        want = Counter()
        for members in groups.values():
            top = max((m for m in members if m is not None), default=None)
            seen = set()
            for m in members:
                want[(m, top, len(members), m == top and m not in seen)] += 1
                seen.add(m)
        assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    kept = exact_dedup.drop_exact_copies(docs(spark, AWKWARD))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r["doc_id"], lower(r["text"])) for r in kept.collect()) == sorted(
        (max((m for m in ms if m is not None), default=None), t) for t, ms in groups.items())
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def brute_fingerprint(text):
    tokens = words(lower(text))
    if not tokens:
        return 0
    runs = [b" ".join(tokens[i:i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(5)
    rows = list(AWKWARD)
    for i in range(120):
        base = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(60)]
        for j in range(rng.choice((1, 1, 3))):
            copy = list(base)
            copy[rng.randrange(60)] = f"x{j}"
            rows.append((100 + 10 * i + j, " ".join(copy), "a"))
    got = simhash.simhash_groups(docs(spark, rows), leaf=16, task_members=20).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    roots = brute_components(fps)
    lowest = defaultdict(list)
    for (i, _, _), r in zip(rows, roots, strict=True):
        lowest[r] += [i] if i is not None else []
    want = Counter((i, f, min(lowest[r], default=None)) for (i, _, _), f, r in zip(rows, fps, roots, strict=True))
    assert Counter((r["id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    stay = simhash.drop_near_copies(docs(spark, rows)).collect()
    assert len(stay) == len(set(roots))
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_simhash_chain_and_dense_group(spark):
    """A chain of fingerprints three bits apart is one component; so is a dense ball dealt into pieces."""
    chain = [0]
    for i in range(20):
        chain.append(chain[-1] ^ (7 << (3 * i)))
    ball = [(1 << 63 | 0x5555 << 20) ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(40), 2)]
    fps = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(chain + ball)], "fp long")
    links = simhash.close_links(fps, leaf=8, task_members=50)
    roots = {r["node"]: r["root"] for r in simhash.connected(links).collect()}
    keys = sorted(set(chain + ball))
    groups = brute_components(keys)
    signed = [int(np.uint64(k).astype(np.int64)) for k in keys]
    named = [roots.get(s, s) for s in signed]
    assert len(set(named)) == len(set(groups))
    assert len(set(zip(named, groups, strict=True))) == len(set(groups))


def test_url_filter_cases(spark):
    urls = [None, "", "no scheme", "http://net/", "http://x.NET/a", "http://net", "http://example.net/en/1?q#z",
            "http://example.net/en", "https://a.example.com/de/x", "http://badexample.com/de/x", "http://q.org/fr/", "http://q.org/FR/",
            "http://example.net?en/", "http://x.com/http://y.net/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls[4:6])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(list(registry.URL_RULES), url_filter.RULE_SCHEMA)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules, payload=("page_id",)).collect()}
    want = [None, None, None, "net/", "net/", None, "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None]
    verdict = {None: "allow", "net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    assert got == {i: (w, verdict[w]) for i, w in enumerate(want + want[4:6])}
    star = spark.createDataFrame([("block", "", "/ads/*.gif"), ("block", "a.b", "/x*y/")], url_filter.RULE_SCHEMA)
    got = [r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(
        [("http://q.z/ads/1/k.gif",), ("http://c.a.b/x..y/",), ("http://a.bb/xy/",), ("http://q.z/ads/k.png",)], "url string"), star).collect()]
    assert sorted(got) == ["allow", "allow", "block", "block"]
    assert url_filter.filter_urls(pages, rules.limit(0), payload=("page_id",)).filter("verdict <> 'allow'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_packing_is_a_partition_of_all_words_and_bins_fit(spark):
    rng = random.Random(3)
    sizes = [rng.choice((0, 1, 7, 300, 300, 300, 511, 513, 900, 2_000, 4_096, 9_000)) for _ in range(400)] + [None]
    rows = spark.createDataFrame(list(enumerate(sizes)) + [(0, sizes[0])], "doc_id long, size long")
    got = packing.pack(rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, packing.pack(rows.repartition(5)).collect()))
    by_doc, bins = defaultdict(int), defaultdict(list)
    for r in got:
        by_doc[r["id"]] += r["length"]
        if r["length"]:
            bins[r["bin_id"]].append((r["position"], r["length"], r["capacity"]))
        else:
            assert r["bin_id"] is None and r["capacity"] is None
    assert all(by_doc[i] == (s or 0) * (2 if i == 0 else 1) for i, s in enumerate(sizes))
    for pieces in bins.values():
        pieces.sort()
        assert [p for p, _, _ in pieces] == [0, *itertools.accumulate(n for _, n, _ in pieces)][:-1]
        used, capacity = sum(n for _, n, _ in pieces), {c for _, _, c in pieces}
        assert capacity == {min(c for c in packing.CAPACITIES if c >= used)}
    assert sum(n for p in bins.values() for _, n, _ in p) >= 0.9 * sum(p[0][2] for p in bins.values())
    assert packing.pack(rows.limit(0)).count() == 0


def brute_best_fit(histogram, capacities):
    """Piece by piece, with the operator's choice of opening size."""
    costs, rooms = {c: c + packing.OVERHEAD for c in capacities}, []
    fillers = sum(n * c for n, c in histogram.items())
    used = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        fillers -= left * length
        while left:
            fits = [(room, b) for b, room in enumerate(rooms) if room >= length]
            if fits:
                b = min(fits)[1]
            else:
                size = packing.opening_size(length, left, fillers, capacities, costs)
                for _ in range(-(-left // (size // length))):
                    rooms.append(size)
                    used.append(0)
                continue
            rooms[b] -= length
            used[b] += length
            left -= 1
    return sorted(used)


def test_packing_plan_matches_piece_by_piece():
    rng = random.Random(9)
    for _ in range(300):
        histogram = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        plan, want = packing.plan_bins(histogram, (16, 32, 64)), brute_best_fit(histogram, (16, 32, 64))
        assert len(plan.length) <= 40 * len(histogram)
        ends = [*plan.bin_start[1:], len(want)]
        fills = [used for start, end, used in zip(plan.bin_start, ends, plan.bin_used, strict=True) for _ in range(end - start)]
        assert sorted(fills) == want and sum(fills) == sum(length * n for length, n in histogram.items())


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice((0, 3, 40, 900))) for i in range(600)] + [(1, "a", None)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix_sources(table, mixing.cyclic_weights(table)).collect()
    again = mixing.mix_sources(table.repartition(7), mixing.cyclic_weights(table)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, weights = Counter(), dict(zip(["a", "b", "c", None], [1, 2, 3, 1], strict=True))
    for _, s, n in rows:
        sizes[s] += n or 0
    open_, target, left = set(sizes), {}, sum(sizes.values())
    while True:  # cap, then reshare by weight, until none is above
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            target.update(share)
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= above
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in sizes)
    assert mixing.mix_sources(table.limit(0), mixing.cyclic_weights(table)).count() == 0


def test_mixing_small_source_beside_a_large_corpus(spark):
    """Cells of a row or two, smaller than a block: the source meets its target all the same."""
    for n, size, repeats in ((1_000, 2, 1), (1_000, 2, 3), (1_000, 4, 3)):
        rows = [(i, "small", size) for i in range(n)] + [(n + i, "large", 20_000) for i in range(4_000)]
        table = spark.createDataFrame(rows, "doc_id long, source string, size long")
        aim = 80_000_000.0 + n * size
        weights = spark.createDataFrame([("small", float(repeats * n * size)), ("large", aim - repeats * n * size)],
                                        "source string, weight double")
        got = mixing.mix_sources(table, weights).collect()
        small = [r for r in got if r["source"] == "small"]
        assert len(got) == len(rows) and small[0]["target"] == pytest.approx(repeats * n * size)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        assert abs(sum(r["taken"] for r in small) - small[0]["target"]) <= mixing.BLOCK
        assert abs(sum(r["taken"] for r in got) - aim) <= 2 * mixing.BLOCK


def test_mixing_query_and_sql_agree_where_cells_overflow(spark, tmp_path):
    """Shards whose cells of a small source are smaller than a block."""
    rows = [(i, "a small", 2) for i in range(1_000)] + [(1_000 + i, "b large", 2_000) for i in range(3_000)]
    table = pa.table({"doc_id": [r[0] for r in rows], "source": [r[1] for r in rows], "text": ["w " * r[2] for r in rows]})
    pq.write_table(table, tmp_path / "documents.parquet")
    got = sorted(tuple(r) for r in registry.op6_mixing(spark, str(tmp_path)).collect())
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert got == sorted(base.sql(registry.ORACLE_SQL["op6_mixing"]).fetchall())
    small = [r for r in got if r[0] < 1_000]
    assert abs(sum(r[4] for r in small) - small[0][3]) <= mixing.BLOCK


def test_sainte_lague_takes_the_highest_quotients(spark):
    rng = random.Random(4)
    for n, seats in ((3, 7), (12, 5), (40, 333)):
        weight = [rng.random() ** 3 for _ in range(n)]
        parties = spark.createDataFrame([(i, w) for i, w in enumerate(weight)], "p int, w double").withColumn("all", F.lit(0))
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(parties, F.col("w") / sum(weight) * seats, F.lit(seats).cast("long"),
                                                               F.lit(n), ["all"], ["p"]).collect()}
        quotients = sorted(((w / (2 * k + 1), i) for i, w in enumerate(weight) for k in range(seats)), reverse=True)[:seats]
        want = Counter(i for _, i in quotients)
        assert {i: got.get(i, 0) for i in range(n)} == {i: want[i] for i in range(n)}


def test_mixed_documents_repeat_and_cut(spark):
    table = docs(spark, [(i, " ".join(f"d{i}w{j}" for j in range(40)), "abc"[i % 3] if i % 5 else "a") for i in range(60)])
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns
    per = Counter()
    for r in out.collect():
        assert r["text"].split() == [f"d{r['doc_id']}w{j}" for j in range(len(r["text"].split()))]
        assert r["n_chars"] == len(r["text"])
        per[r["doc_id"]] += len(r["text"].split())
    sized = table.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    want = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(sized, mixing.cyclic_weights(table)).collect()}
    assert all(per[i] == want[i] for i in want)


def test_sharding_is_even_and_stratified(spark):
    rows = [(i, None if i % 50 == 0 else f"text {i % 90}", ["a"] * 6 + ["b", "c", None]) for i in range(900)]
    table = docs(spark, [(i, t, s[i % 9]) for i, t, s in rows] + [(5, "text 5", "a"), (None, "x", "b")]).select(
        "doc_id", "source", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    got = sharding.shard_rows(table, 40, tie_cols=("crc",)).collect()
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_rows(table.repartition(9), 40, tie_cols=("crc",)).collect()))
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    assert len(got) == 902 and set(shards) == set(range(40))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for members in shards.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert abs(sum(r["source"] == "a" for r in members) - len(members) * 6 / 9) <= 2
    assert sharding.shard_rows(table.limit(3), 40).count() == 3 and sharding.shard_rows(table.limit(0), 40).count() == 0
    text = registry.op7_sharding(spark, "/root/testdata/sf0.001").collect()
    source = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(source[r["doc_id"]].encode()) and r["size"] == len(source[r["doc_id"]].encode()) + 16
               for r in text)


def brute_substring(rows, k):
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - k + 1):
            key = tuple(w[a:a + k])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a:a + k])] < (math.inf if i is None else i):
                gone |= set(range(a, a + k))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("k,m", [(13, 5), (4, 2)])
def test_substring_matches_brute_force(spark, k, m):
    rng = random.Random(k)
    passages = [[f"p{i}x{j}" for j in range(40)] for i in range(5)]
    rows = [(i, t) for i, t, _ in AWKWARD] + [(20, "la " * 3_000), (21, "la " * 2_500 + "ti"), (22, "x " + "la " * 1_100)]
    for i in range(80):
        text = [f"r{rng.randint(0, 40)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at, p = rng.randint(0, len(text)), rng.choice(passages)
            a = rng.randint(0, 20)
            text[at:at] = p[a:a + rng.randint(5, 20)]
        rows.append((rng.choice((None, 100 + i, 100 + i // 2)) if i % 9 == 0 else 100 + i, "\t".join(text)))
    table = docs(spark, [(i, t, "a") for i, t in rows])
    got = [(r["id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.substring_dedup(table, k=k, m=m).collect()]
    assert sorted(got, key=str) == sorted(brute_substring(rows, k), key=str)
    assert substring.substring_dedup(docs(spark, [])).count() == 0


def test_substring_tells_many_texts_of_one_id_apart(spark):
    """Thousands of texts without an id (and of one id) have spans of their own, at places of their own."""
    rng = random.Random(8)
    passage = [f"p{j}" for j in range(30)]
    rows = [(1, " ".join(passage))]
    for i in range(6_000):
        own = [f"t{i}x{j}" for j in range(rng.randint(0, 60))]
        at, a = rng.randint(0, len(own)), rng.randint(0, 10)
        own[at:at] = passage[a:a + rng.randint(10, 20)]
        rows.append((7 if i % 2 else None, " ".join(own)))
    rows += rows[-3:]
    got = [(r["id"], r["n_words"], r["n_removed"], r["kept_text"])
           for r in substring.substring_dedup(docs(spark, [(i, t, "a") for i, t in rows])).collect()]
    assert sorted(got, key=str) == sorted(brute_substring(rows, substring.K), key=str)


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(600, None), (650, [1.0, None] * 8), (700, [float("nan")] * 16), (750, []), (None, rows[0][1]), (800, [1.0, 2.0]),
             (850, [3.0, 4.0]), (801, [1e13, 2.0]), (50, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, block=64).collect())
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in dict((i, v) for i, v in good if i % 50 == 0).items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    assert got == sorted(want)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_keeps_k_rows_a_query_and_task(spark, monkeypatch):
    """Candidates are scored where they are read, against all queries: no block is shuffled to queries, and a task reports
    k rows a query, however many blocks it met."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = topk.top_k(table, F.col("vec_id") % 50 == 0, block=16)
    assert "Join" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(topk, "QUERY_BYTES", 1)
    scans = topk.top_k(table, F.col("vec_id") % 50 == 0, block=4)  # a scan for each block of queries
    assert scans._jdf.queryExecution().executedPlan().toString().count("MapInArrow") > 1
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, scans.collect()))
    x = np.concatenate([rng.integers(-9, 9, (300, 8)), np.full((200, 8), 7)])
    xid = rng.permutation(len(x)).astype(np.int64)
    for scale in (1, 2**10, 2**24, 2**40):  # scores exact in single and double precision, in longs, and beyond
        search = topk._Search(xid[::10], x[::10] * scale, 5, topk.LEVELS)
        for at in range(0, len(x), 32):
            search.block(xid[at:at + 32], x[at:at + 32] * (scale if at % 64 else 1))
        sides = [[v * (scale if at // 32 % 2 else 1) for v in row] for at, row in enumerate(x.tolist())]
        for n, at in enumerate(range(0, len(x), 10)):
            q = [v * scale for v in x[at].tolist()]
            want = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for v, i in zip(sides, xid.tolist(), strict=True) if i != xid[at])[:5]
            assert [(-s, i) for s, i in zip(search.score[n].tolist(), search.id[n].tolist(), strict=True)] == want


def test_topk_fails_on_finite_components_out_of_range(spark):
    for kind, large in (("float", 3e38), ("double", 1e308), ("double", -2.0**55)):
        good = [(50, [1.0, 2.0]), (51, [float("inf"), large]), (52, [2.0, 1.0]), (None, [large, 1.0])]
        schema = f"vec_id long, embedding array<{kind}>"
        got = topk.top_k(spark.createDataFrame(good, schema), F.col("vec_id") % 50 == 0).collect()
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(50, 52, 4 * 256**2)]
        with pytest.raises(Exception, match="finite component beyond"):
            topk.top_k(spark.createDataFrame([*good, (53, [large, 1.0])], schema), F.col("vec_id") % 50 == 0).collect()


def test_licenses_found_and_spared(spark):
    long = dict((t, n) for n, t in licenses.NOTICES if len(t) > 150)
    altered = {t: t.replace(" the ", " a ", 1) for t in long}
    rows = [(1, None), (2, ""), (3, "mit license"), (4, "x " * 50 + "Released UNDER\nthe MIT-license! yes"), (4, "Released under the MIT License."),
            (5, "released under the old mit license"), (6, LONG + " Licensed under CC BY-NC 4.0. " + LONG)]
    rows += [(10 + i, f"start {t} end") for i, t in enumerate(altered.values())]
    got = licenses.scan_licenses(docs(spark, [(i, t, "a") for i, t in rows]), licenses.notices(spark)).collect()
    import regex

    def runs(t):
        w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    want = Counter()
    for i, t in rows:
        for name, notice in licenses.NOTICES:
            n, found = len(runs(notice)), len(runs(notice) & runs(t))
            if found >= 0.8 * n - 1e-9:
                want[(i, name, notice, n, found)] += 1
    assert Counter((r["id"], r["license"], r["template"], r["n_shingles"], r["n_found"]) for r in got) == want and want
    assert licenses.scan_licenses(docs(spark, []), licenses.notices(spark)).count() == 0
    assert licenses.scan_licenses(docs(spark, [(1, "a b", "x")]), licenses.notices(spark).limit(0)).count() == 0


def test_short_licenses_are_found(spark):
    rows = [(1, "text.\nAll rights reserved.\nmore"), (2, "all rights RESERVED"), (3, "all the rights reserved"), (4, "rights reserved"),
            (5, "The MIT License, as it is"), (6, "free"), (7, "this is free and unencumbered software released into the public domain"),
            (8, "GNU Lesser"), (9, None)]
    table = docs(spark, [(i, t, "a") for i, t in rows])
    got = licenses.scan_licenses(table, licenses.notices(spark, short=True)).collect()
    assert sorted((r["id"], r["license"], r["n_shingles"], r["n_found"], r["first_term"]) for r in got) == [
        (1, "All-rights-reserved", 1, 1, 1), (2, "All-rights-reserved", 1, 1, 0), (5, "MIT", 1, 1, 1), (7, "Unlicense", 7, 7, 0)]
    own = spark.createDataFrame([("x", "free"), ("y", "GNU lesser"), ("z", " . "), ("w", "all the rights reserved")], "license string, text string")
    got = licenses.scan_licenses(table, own).collect()
    assert sorted((r["id"], r["license"]) for r in got) == [(3, "w"), (6, "x"), (7, "x"), (8, "y")]


def _recalls(got):
    """Share of the good documents kept, share of the bad ones rejected."""
    good, bad = ([r["keep"] for r in got if r["label"] == c] for c in (1, 0))
    assert len(good) > 50 and len(bad) > 9
    return sum(good) / len(good), 1 - sum(bad) / len(bad)


def test_quality_held_out_by_class(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = labels.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    good, bad = _recalls(quality.classify(d, labels.filter("doc_id % 3 <> 0")).join(held, "id").collect())
    assert good >= 0.97 and bad >= 0.9


def test_quality_rejects_junk_of_kinds_left_out_of_training(spark):
    """Held-out junk in other marks and in lower case, and each kind of junk left out of the labels in turn."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = labels.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    other = d.join(held.filter("label = 0"), d["doc_id"] == held["id"], "left") \
        .withColumn("text", F.when(F.col("label") == 0, F.translate(F.lower("text"), "*$%&#!|", "~^?<>@=")).otherwise(F.col("text"))) \
        .drop("id", "label")
    good, bad = _recalls(quality.classify(other, labels.filter("doc_id % 3 <> 0")).join(held, "id").collect())
    assert good >= 0.97 and bad >= 0.9
    tagged = F.col("text").rlike(r"\w(\*\*\*|\$\$\$|%%%|&&&|###)")
    shouted = F.col("text").rlike("[A-Z]{3,}!!")
    for kind in (tagged, shouted):
        left_out = d.filter(kind).select("doc_id")
        train = labels.join(left_out, "doc_id", "left_anti")
        judged = labels.join(left_out, "doc_id").filter("quality = 0").select(F.col("doc_id").alias("id"))
        got = quality.classify(d, train).join(judged, "id").collect()
        assert len(got) > 9 and sum(not r["keep"] for r in got) / len(got) >= 0.9


def test_quality_awkward(spark):
    table = docs(spark, AWKWARD)
    bad = spark.createDataFrame([(1, None), (None, 1), (99, 1), (4, 5), (4, 1), (4, 1), (6, 0)], "doc_id long, quality int")
    for labelled in (bad, bad.limit(0)):
        assert quality.classify(table, labelled).count() == len(AWKWARD)
        assert quality.good_documents(table, labelled).columns == table.columns
    assert quality.classify(table.limit(0), bad).count() == 0


def test_site_posteriors_shrink_sparse_sites(spark):
    """Hosts with the same share of junk: the sparse one's posterior stays nearer the overall mean."""
    rows = [(i, "good plain words here " * 5 if i % 4 else "JUNK!! " * 20, "big") for i in range(400)]
    rows += [(1000 + i, "JUNK!! " * 20, "bad") for i in range(200)] + [(2000, "JUNK!! " * 20, "tiny")]
    labels = spark.createDataFrame([(i, int("good" in t)) for i, t, _ in rows[:80]], "doc_id long, quality int")
    model = quality.fit(quality._bins(docs(spark, rows), [0] * quality.GRAM_BUCKETS, "doc_id", "text", "source", "lang"), labels)
    rate = {r["site"].split("|")[0].split(":")[1]: r["host_rate"] for r in model.paths.collect()}
    assert rate["bad"] < rate["tiny"] < rate["big"] and rate["bad"] < 0.1
