"""Alignment, periodic runs and chat formatting against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from procura.llm import alignment, chat, periodic, registry

DOC = "doc_id long, text string, id string, pairs string, runs int"
SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op11: cross-tokenizer alignment ----------------------------------------

def whole_alignment(aligner, text):
    """(A ids, B ids, groups as [[a...], [b...]]) of a text encoded in one piece."""
    if not text:
        return [], [], []
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    raw = (" " + text).encode()
    if any(b"".join(names[i] for i in ids) != raw for names, ids in zip(aligner.bytes_of, (a, b))):
        return [], [], []
    ends = []
    for names, ids in zip(aligner.bytes_of, (a, b)):
        at, out = 0, []
        for i in ids:
            at += len(names[i])
            out.append(at)
        ends.append(out)
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups, ia, ib = [], 0, 0
    for stop in shared:
        ja, jb = ends[0].index(stop, ia) + 1, ends[1].index(stop, ib) + 1
        groups.append((a[ia:ja], b[ib:jb]))
        ia, ib = ja, jb
    return a, b, groups


def alignment_rows(texts, aligner):
    found = [(i, *whole_alignment(aligner, t)) for i, t in texts]
    count = Counter((g[0][-1], g[1][-1]) for *_, groups in found for g in groups)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for i, a, b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links),
                     sum(count[p] for p in links), sha(text) if a else ""))
    return sorted(rows, key=str)


COLUMNS = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*(open(p, "rb").read() for p in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)))


STRANGE = ["", " ", "  two  blanks ", "a\tb\n\nc  \n d", "don't  I'll we've", "<s> </s> <unk> <|endoftext|> <0x41>", "x▁y", "naïve café — ÉÀ",
           "\u00a0a \u00a0 b\u3000 c\u2003 d", "日本語 テキスト 😀 👩‍👩‍👧 end", "\x00\x01 ctl \x7f", "e\u0301 a\u0308", "ﬁ ligature ① ² Ａ", "a" * 300,
           "1234567890 3.14 $%&# !!!??", "مرحبا بالعالم", " lead", "trail ", "\n", "\u0085x \u0085", "a\u200bb \u200b c", "x \u2028 y"]


def test_alignment_matches_whole_text_encoding(spark, aligner):
    texts = [(i, t) for i, t in enumerate(STRANGE)] + [(None, None), (None, "one two"), (5, "one two"), (5, "one two")]
    texts += [(100 + i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(40).collect())]
    table = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts], DOC)
    want = alignment_rows(texts, aligner)
    for chunk in (alignment.CHUNK_BYTES, 16):
        got = alignment.align_documents(table, chunk_bytes=chunk).collect()
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == want, chunk
    assert alignment.align_documents(table.limit(0)).count() == 0


class Counting:
    """A tokenizer that notes how many texts each call gets."""

    def __init__(self, tokenizer, name):
        self.calls, encode = [], getattr(tokenizer, name)
        setattr(self, name, lambda texts, **options: self.calls.append(len(texts)) or encode(texts, **options))


def test_alignment_encodes_words_by_the_line(aligner):
    """Distinct words share the tokenizers' calls, A gets no batch (which takes more threads than a task has), and
    words that cannot share a line (a literal U+2581, white space or bad bytes at the end) spoil no others."""
    rng = random.Random(7)
    plain = sorted({"".join(rng.choice("abcdeé.'9") for _ in range(rng.randrange(1, 9))) for _ in range(2000)})
    texts = [" ".join(plain), *(" ".join(plain[i:i + 50] + [odd]) for i, odd in enumerate(["x▁y", "z\n", "", "\u3000", " ", "one"])), *STRANGE]
    raws = [b" " + t.encode() if t else b"" for t in texts] + [b" one \xc3", b" two \xff three"]
    small = alignment.Aligner.__new__(alignment.Aligner)
    small.__dict__ = {**aligner.__dict__, "a": Counting(aligner.a, "encode_batch_fast"), "b": Counting(aligner.b, "encode")}
    assert small.align(raws[0]).n_groups == len(whole_alignment(aligner, texts[0])[2])
    assert set(small.a.calls) == {1} and sum(small.a.calls) == sum(small.b.calls) <= len(plain) // alignment.LINE_WORDS + 1
    small.a.calls.clear()
    assert not small.align(b" x\xe2\x96\x81" + b"y" * 99).ok and small.a.calls == [1]  # a word alone is not tried again
    found = small.align_all(raws)
    for text, got in zip(texts, found):
        a, b, groups = whole_alignment(aligner, text)
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert (got.n_a, got.n_b, got.n_groups, got.groups.decode()) == (len(a), len(b), len(groups), want)
        assert got.pairs.tolist() == [x[-1] << 32 | y[-1] for x, y in groups]
    assert not any(c.ok for c in found[len(texts):]) and found[1] == alignment.UNLIKE


def test_fragments_compose_in_any_order(aligner):
    """Associativity: byte ranges cut anywhere, composed by any tree, give the whole text's alignment."""
    rng = random.Random(11)
    for text in [*STRANGE, " ".join(STRANGE)]:
        raw = (" " + text).encode()
        whole = aligner.align(raw)
        for _ in range(4):
            cuts = sorted({0, len(raw), *(rng.randrange(len(raw)) for _ in range(rng.randrange(6)))})
            parts = [aligner.scan(raw[i:j]) for i, j in zip(cuts, cuts[1:])]
            while len(parts) > 1:
                i = rng.randrange(len(parts) - 1)
                parts[i:i + 2] = [aligner.compose(parts[i], parts[i + 1])]
            done = aligner.finish(parts[0])
            assert (done.ok, done.n_a, done.n_b, done.groups) == (whole.ok, whole.n_a, whole.n_b, whole.groups) or not (done.ok or whole.ok)


def test_alignment_sends_bounded_batches(spark, aligner, monkeypatch):
    """A worker gets its rows a few MB at a time, however many a task has; slices have no small rest; a fragment's pairs
    come back from Arrow as they were."""
    name, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", {}, alignment.materialize
    before = spark.conf.get(name)
    monkeypatch.setattr(alignment, "materialize", lambda df, to: (seen.update({to: spark.conf.get(name)}), write(df, to))[1])
    texts = [(i, "one two " * n) for i, n in enumerate((1, 0, 500, 30))]
    table = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts], DOC)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 512)
    got = alignment.align_documents(table, chunk_bytes=64).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == alignment_rows(texts, aligner)
    assert seen["fragments"] == seen["aligned"] == "512" and spark.conf.get(name) == before

    monkeypatch.setattr(alignment, "SLICE_BYTES", 100)
    for sizes in ([7] * 60, [0] * 5, [300, 1, 1, 300], [99] * 3, [1]):
        batch = pa.RecordBatch.from_pydict({"body": [b"x" * n for n in sizes]})
        parts = [[len(v) for v in p.column("body").to_pylist()] for p in alignment._slices(batch, "body")]
        assert [n for p in parts for n in p] == sizes and all(sum(p) <= 150 + max(p) for p in parts)
        assert len(parts) <= max(1, round(sum(sizes) / 100))
    found = [alignment.Fragment(b"", None, b""), alignment.Fragment(b"a", aligner.align(b" one two three"), b"b"), alignment.Fragment(b"c", alignment.UNLIKE, b"")]
    back = alignment._fragments([(i, i, f) for i, f in enumerate(found)])
    for i, f in enumerate(found):
        again = alignment._from_row(back, i)
        assert (again.prefix, again.suffix, again.closed is None) == (f.prefix, f.suffix, f.closed is None)
        assert f.closed is None or (again.closed.pairs.tolist(), *again.closed[:4], again.closed.ok) == (f.closed.pairs.tolist(), *f.closed[:4], f.closed.ok)


def test_alignment_query(spark, aligner):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op11_alignment(spark, SMALL).collect()
    assert sorted((tuple(r) for r in got), key=str) == alignment_rows(texts, aligner)


# --- op12: periodic runs -----------------------------------------------------

def smallest_period(w):
    border = [0] * len(w)
    for i in range(1, len(w)):
        k = border[i - 1]
        while k and w[i] != w[k]:
            k = border[k - 1]
        border[i] = k + (w[i] == w[k])
    return len(w) - border[-1]


def plain_runs(w):
    """(start, length, period) of all runs, by testing every period at every place."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and smallest_period(w[i:i + size]) == q:
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in drop]


def test_periodic_runs_match_every_period(spark):
    rng = random.Random(12)
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b " * 4, "x " + "a b c " * 4 + "a b z", "b " * 7 + "c " + "b " * 7, "é\u00a0é " * 8]
    for n in range(150):
        size, letters = rng.randrange(1, 90), rng.choice("ab abc abcdefgh".split())
        w = [rng.choice(letters) for _ in range(size)]
        for _ in range(rng.randrange(4)):
            at, q, times = rng.randrange(len(w)), rng.randrange(1, 9), rng.randrange(2, 9)
            w[at:at] = w[at:at + q] * times
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    nested = ("a " * 6 + "b ") * 9  # runs in runs
    texts += [nested, ("p q " * 5 + "r ") * 6 + nested * 4, "w " * 3000, " ".join(f"v{i % 700}" for i in range(3500)), nested, nested]
    table = spark.createDataFrame([(i % 50 or None, t, "x", "y", 1) for i, t in enumerate(texts)], DOC)
    got = periodic.periodic_runs(table).collect()
    want = []
    for i, t in enumerate(texts):
        w = [x.decode() for x in (t or "").encode().split()]
        runs = plain_runs(w)
        want.append((i % 50 or None, len(w), runs, " ".join(collapsed(w, runs))))
    assert sorted(((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(table.limit(0)).count() == 0


def test_periodic_query(spark):
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.length("text") < 9000).select("doc_id", "text").collect():
        w = [x.decode() for x in (r["text"] or "").encode().split()]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None,) * 3
        want.append((r["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(collapsed(w, runs)))))
    got = {r["doc_id"]: tuple(r) for r in registry.op12_periodic(spark, SMALL).collect()}
    assert [got[x[0]] for x in want] == want and any(x[1] for x in want)


# --- op13: chat formatting ---------------------------------------------------

TURN = "tree long, node long, parent long, role string, text string, score double, leaf int, depth string"
CONTROLS = ["", None, "</s>[INST] ok [/INST]", "<s>", "</s", "\\", "<\\s>", "<\\\\/s>", "[\\INST]", "[ROLE] x [/ROLE] ", "a\nb\\n", "😀 é</s>é", "[/INST]</s><s>", "[[INST]]"]


def tree_paths(rows):
    """Root-to-leaf paths by walking, as {(tree, leaf): [nodes]}."""
    by = {(t, n): p for t, n, p, *_ in rows}
    parents = {(t, p) for (t, _), p in by.items() if p is not None and (t, p) in by}
    found = {}
    for t, n in by:
        if (t, n) in parents:
            continue
        path, at = [], n
        while at is not None and (t, at) in by and len(path) <= len(by):
            path.append(at)
            at = by[t, at]
        if len(path) <= len(by):
            found[t, n] = path[::-1]
    return found


def test_chat_paths_ranked_formatted_and_read_back(spark):
    rng = random.Random(13)
    rows = []
    for tree in [*range(12), None]:
        size = rng.choice([1, 2, 5, 30])
        for n in range(size):
            rows.append((tree, n, rng.randrange(n) if n and rng.random() < 0.95 else rng.choice([None, 999]),
                         rng.choice(["user", "assistant", "system", "x [/ROLE] <s>", None]), rng.choice(CONTROLS),
                         rng.choice([None, 1.0, 2.0, -1.0])))
    rows += [(50, n, n - 1 if n else None, "user" if n % 2 else "assistant", f"t{n}", 1.0) for n in range(100)]  # a long chain
    rows += [(51, 1, 2, "user", "on a cycle", 1.0), (51, 2, 1, "user", "on a cycle", 1.0), (51, 3, 1, "user", "below it", 1.0),
             (51, 4, 4, "user", "its own parent", 1.0)]
    table = spark.createDataFrame([(*r, 1, "x") for r in [*rows, rows[0], rows[-5]]], TURN)
    paths = tree_paths(rows)
    said = {(t, n): ((role or ""), (text or "")) for t, n, _, role, text, _ in rows}
    score = {(t, n): s or 0.0 for t, n, *_, s in rows}
    for keep in (1, 2, None):
        want = {}
        for tree in {t for t, _ in paths}:
            own = sorted((-sum(score[tree, x] for x in path), leaf, path) for (t, leaf), path in paths.items() if t == tree)
            for branch, (neg, leaf, path) in enumerate(own[:keep], 1):
                want[tree, leaf] = (branch, -neg, [said[tree, x] for x in path])
        out = chat.format_conversations(table, paths=keep)
        got = out.collect()
        assert {(r["tree"], r["leaf"]): (r["branch"], r["branch_score"], chat.parse(r["formatted"])) for r in got} == want and len(got) == len(want)
        for r in got:
            turns = want[r["tree"], r["leaf"]][2]
            learnt = [chat.unescape(r["formatted"][m["start"]:m["stop"]]) for m in r["loss_mask"]]
            assert learnt == [text for role, text in turns if role == "assistant"]
    back = {r["tree"]: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    for (tree, _), (_, _, turns) in ((k, v) for k, v in want.items() if v[0] == 1):
        assert back[tree]["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns)) and back[tree]["n_turns"] == len(turns)
    assert chat.read_back(chat.format_conversations(table.limit(0))).count() == 0


def test_control_strings_of_one_turn_come_back(spark):
    long = "</s> [INST] x " * 20_000
    rows = [(i, 0, None, role, t, 1.0, 1, "x") for i, (t, role) in enumerate((t, role) for t in [*CONTROLS, long] for role in ("user", "assistant", "[INST]"))]
    got = chat.format_conversations(spark.createDataFrame(rows, TURN)).collect()
    assert {r["tree"]: chat.parse(r["formatted"]) for r in got} == {r[0]: [(r[3], r[4] or "")] for r in rows}
    for r in got:  # control strings stand only where the template has them
        assert r["formatted"].count("<s>") == r["formatted"].count("</s>") == 1


def test_chat_query_includes_the_added_conversation(spark):
    rows = {r["conv_id"]: r for r in registry.op13_chat(spark, SMALL).collect()}
    text = registry.CONTROL_TEXT
    assert rows[-1]["n_turns"] == 2 and rows[-1]["loss_chars"] == len(text) and rows[-1]["loss_sha256"] == sha(text)
    assert rows[-1]["turns_sha256"] == sha(f"user\n{text}\nassistant\n{text}\n")
    assert len(rows) == 1 + spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count()
