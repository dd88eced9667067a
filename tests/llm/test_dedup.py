"""Exact, near, suffix and line dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from mosaiq.llm import exact, linededup, simhash, suffix
from mosaiq.llm.common import connected_components
from tests.llm.conftest import words

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
norm = lambda t: (t or "").encode().translate(LOW)


def test_exact(docs):
    rows = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    of = {}
    for d, t in rows:
        of.setdefault(t, []).append(d)
    expected = {d: (max(of[t]), len(of[t]), d == max(of[t]), hashlib.sha256(t).hexdigest()) for d, t in rows}
    got = {r["doc_id"]: tuple(r)[1:] for r in exact.exact_dedup(docs).collect()}
    assert got == expected
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, x in expected.items() if x[2]}


def test_exact_odd(odd, empty):
    got = sorted((tuple(r)[:4] for r in exact.exact_dedup(odd).collect()), key=repr)
    assert got == sorted([(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True), (None, None, 1, True)], key=repr)
    assert exact.exact_dedup(empty).count() == 0 and exact.keep_one(odd).count() == 4


def brute_removals(raws, length):
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, int)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[: len(r)] > 0
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"cap": 1}, {"bucket": 3}])
def test_suffix(docs, how):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    expected = dict(zip([d for d, _ in rows], brute_removals([r for _, r in rows], 400), strict=True))
    assert sum(x[1] for x in expected.values()) > 2000
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix.removals(docs, **how).collect()} == expected


def test_suffix_passages(docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    long, short = brute_removals([r for _, r in rows], 400), brute_removals([r for _, r in rows], 200)
    expected = {d: (*a, b[1]) for (d, _), a, b in zip(rows, long, short, strict=True)}
    got = suffix.removals(docs, passage=200)
    assert got.columns[-1] == "n_passage" and {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == expected


def test_suffix_thousands_with_a_hot_anchor(spark):
    """Passages of 51 to 120 words, and one string of 70 bytes in every text, at several thousand documents."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(51, 120))) for _ in range(40)]
    hot = "".join(rng.choice("xyz") for _ in range(70))
    texts = []
    for i in range(3000):
        middle = rng.choice(passages) if i % 3 == 0 else ""
        texts.append(" ".join([*(word() for _ in range(rng.randint(5, 60))), middle, hot, *(word() for _ in range(rng.randint(5, 60)))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    raws = [t.encode() for t in texts]
    long, short = brute_removals(raws, 400), brute_removals(raws, 200)
    for cap in (20_000, 500):
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix.removals(df, passage=200, cap=cap).collect()}
        assert got == {i: (*a, b[1]) for i, (a, b) in enumerate(zip(long, short, strict=True))}
    assert sum(b[1] >= 200 for b in short) >= 990


def test_suffix_short_windows(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(40)] + ["ab" * 90, "a" * 100, "é" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = dict(enumerate(brute_removals([t.encode() for t in texts], 40)))
    for cap in (20000, 2):
        assert {r["doc_id"]: tuple(r)[1:] for r in suffix.removals(df, 40, k=12, cap=cap).collect()} == expected


def test_suffix_family_of_many_batches():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(20)) for _ in range(300)]
    many, one = suffix.Family(12, 4), suffix.Family(12, 4)
    for i in range(0, 300, 7):
        part = [s.encode() for s in strings[i : i + 7]]
        many.add(part, [0] * len(part), [8] * len(part))
    one.add([s.encode() for s in strings], [0] * 300, [8] * 300)
    assert np.array_equal(many.marks, one.marks) and len(many.levels) < 8
    for i, s in enumerate(strings):  # a window of 12 bytes that begins d before place 8
        for d in range(9):
            assert many.marks[i, d] == any(j != i and t[8 - d : 20 - d] == s[8 - d : 20 - d] for j, t in enumerate(strings))


def test_suffix_odd(odd, empty):
    got = suffix.removals(odd).collect()
    assert len(got) == 5 and sum(r["n_removed"] == r["n_bytes"] > 0 for r in got) == (3 if len(odd.first()["text"].encode()) >= 400 else 0)
    assert suffix.removals(empty).count() == 0
    assert suffix.cut_repeats(odd).columns == odd.columns and suffix.cut_repeats(empty).count() == 0


def test_suffix_cut(docs):
    spans = {r["doc_id"]: r for r in suffix.removals(docs).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in suffix.cut_repeats(docs).collect()}
    assert set(before) - set(after) == {d for d, r in spans.items() if r["n_bytes"] and r["n_removed"] == r["n_bytes"]}
    assert all(r["text"] == before[d] for d, r in after.items() if not spans[d]["n_removed"])
    assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if spans[d]["n_removed"])


def brute_fingerprint(text):
    w = norm(text).split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_simhash(docs):
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    linked = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    top = components(fp, linked)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect()}
    assert got == {i: (f"{fp[i]:016x}", top[i]) for i in fp}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(top.values())


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)]))
    values = [int(x) for x in fps]
    expected = components(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])
    assert simhash.link_fingerprints(spark.createDataFrame([], "fp long"), 4).count() == 0
    src, dst = simhash.near_links(fps, None, 4, tile=16)
    assert components(values, zip(map(int, src), map(int, dst), strict=True)) == expected
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.link_fingerprints(df, 4, chunk=20).collect()
    un = lambda x: x % (1 << 64)
    assert components(values, [(un(r["src"]), un(r["dst"])) for r in links]) == expected


def test_simhash_odd(odd, empty):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(odd).collect())
    fp = {r["text"]: f"{brute_fingerprint(r['text']):016x}" for r in odd.collect()}
    one, two = [x for x in fp.values()][0], fp[odd.where("doc_id = 2").first()["text"]]
    assert got == Counter([(None, one, 1), (1, one, 1), (1, one, 1), (2, two, 2), (None, "0" * 16, None)])
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == ["1", "1", "2", "None", "None"]


def test_simhash_keeps_clean_row_of_shared_id(spark):
    copied, clean = " ".join(f"word{i}" for i in range(80)), " ".join(f"other{i * 7}" for i in range(80))
    df = spark.createDataFrame([(1, copied), (2, copied.upper()), (2, clean), (2, clean)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(df).collect()) == [(1, copied), (2, clean), (2, clean)]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 100), (50, 50)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_line_templates(spark):
    prose = [f"{'qrstuvwxyz'[i]}x{'abcdefghij'[i]} own line of document {'abcdefghij'[i] * 3}" for i in range(10)]
    texts = [f"Posted by user{i} on day {i}\n{prose[i]}\nAll rights reserved\n" for i in range(10)] + [None, "", "All rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df, min_docs=8).collect()}
    assert all(got[i]["kept"] == f"{prose[i]}\n" and got[i]["n_dropped"] == 2 and got[i]["n_lines"] == 3 for i in range(10))
    assert got[10]["kept"] is None and got[11]["kept"] == "" and got[12]["kept"] == "" and got[10]["n_lines"] == 0


def test_line_leaves(spark):
    lines = [f"we saw the {a} {b} near the old mill" for a in "red blue tan".split() for b in "cat dog hen".split()]
    found = linededup.generalise([x.encode().split() for x in sorted(lines)], 0.6)
    assert set(found) == {0}
    assert linededup.generalise([[b"a", b"b"], [b"c", b"d"], [b"a", b"b"]], 0.6) == [0, 1, 0]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    whole = linededup.dedup_lines(df, min_docs=9)
    assert {r["n_dropped"] for r in whole.collect()} == {1}


def brute_templates(lines, similar):
    made, out = [], []
    for x in lines:
        agree = [sum(a == b for a, b in zip(t, x, strict=True)) for t in made]
        if made and max(agree) >= similar * len(x):
            k = agree.index(max(agree))
            made[k] = [a if a == b else b"<*>" for a, b in zip(made[k], x, strict=True)]
        else:
            k = len(made)
            made.append(x)
        out.append(k)
    return out


@pytest.mark.parametrize("similar", [0.0, 0.3, 0.6, 1.0])
def test_templates_compare_all(similar):
    rng = random.Random(4)
    for width in (1, 4, 9):
        words = [[rng.choice([b"<*>", *(b"%c%d" % (97 + i, k) for k in range(1 + 3 * i))]) for i in range(width)] for _ in range(700)]
        lines = sorted(words, key=b" ".join)
        assert linededup.generalise(lines, similar) == brute_templates(lines, similar)


def test_large_leaf(spark):
    names = [a + b + c for a in "bdfgklmnpr" for b in "aeiou" for c in "bdfgklmnprst"]  # 600
    frame = "we saw the {} near the old {} mill"
    for n in (500, 600):
        lines = [frame.format(x, x[::-1]) for x in names[:n]]
        df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
        assert {r["n_dropped"] for r in linededup.dedup_lines(df).collect()} == {1}
        found = {r["rid"]["d"]: r["template"] for r in linededup.assign(df).collect()}
        assert len(set(found.values())) == len(set(brute_templates([x.encode().split() for x in sorted(lines)], 0.6))) == 1


@pytest.mark.parametrize("n", [500, 1000, 4000])
def test_shards_of_a_leaf(spark, n):
    """One template of many variants drops whatever its size and however it is sharded; others beside it stay."""
    lines = [f"we saw the {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} near the old mill" for i in range(n)]
    lines += [f"we saw the {'xyz'[i]}end of it all {'abc'[i] * 5}" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for shard in (20_000, 300, 40):
        got = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(df, shard=shard).collect()}
        assert all(got[i] == 1 for i in range(n)) and not any(got[n + i] for i in range(3)), shard


def test_line_query_equals_brute_force(spark):
    rng = random.Random(8)
    frames = ["copyright {} by {} press all rights reserved", "page {} of {}", "posted by {} in {} on day 7", "{} {} {}"]
    texts = []
    for _ in range(120):
        own = [f.format(*(rng.choice(["ann", "bob", "cy", "dee", "eve1", "77"]) for _ in range(3))) for f in rng.choices(frames, k=3)]
        texts.append("\n".join([*own, words(rng, 8), " \t", own[0]]))
    texts += [texts[0], None, "", "\n\n"]
    df = spark.createDataFrame([(i % 121, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    hide = lambda x: b" ".join(b"<*>" if any(48 <= c <= 57 for c in w) else w for w in x.split())
    of, leaves = {}, {}
    for i, t in enumerate(texts):
        for x in (t or "").encode().split(b"\n"):
            if x.split():
                leaves.setdefault((len(x.split()), *hide(x).split()[:3]), set()).add(hide(x))
    for leaf, kinds in leaves.items():
        own = sorted(kinds)
        of |= {x: (leaf, k) for x, k in zip(own, brute_templates([x.split() for x in own], 0.6), strict=True)}
    held = {}
    for i, t in enumerate(texts):
        for x in (t or "").encode().split(b"\n"):
            if x.split():
                held.setdefault(of[hide(x)], set()).add((i % 121, t))
    expected = []
    for i, t in enumerate(texts):
        if t is None:
            expected.append((i % 121, 0, 0, None))
            continue
        own = t.split("\n")
        drop = [bool(x.split()) and len(held[of[hide(x.encode())]]) >= 8 for x in own]
        expected.append((i % 121, sum(bool(x.split()) for x in own), sum(drop), "\n".join(x for x, d in zip(own, drop, strict=True) if not d)))
    assert sum(x[2] for x in expected) > 100
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in linededup.dedup_lines(df).collect())


def test_lines_odd(odd, empty, docs):
    assert linededup.dedup_lines(odd).count() == 5 and linededup.dedup_lines(empty).count() == 0
    assert linededup.dedup_lines(docs).count() == docs.count()
