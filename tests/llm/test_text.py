"""WARC, language, packing, quality, toxicity and SentencePiece against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import langid, packing, quality, queries, spiece, toxicity, warc
from mosaiq.llm.common import fitting
from tests.llm.conftest import words


def test_warc(spark):
    big = "é" * 400_000
    pages = [(3, "http://a/", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "http://b/", None), (5, "u\r\nX: y", ""), (9, "v", big), (8, "w", "two\r\n\r\nWARC/1.1"), (None, "z", "<p>one</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    bundles = warc.write_bundles(df, frame_bytes=100)
    got = {r["page_id"]: r for r in warc.read_bundles(bundles).collect()}
    first = {"<p>one</p>": 1, "": 2, big: 9, "two\r\n\r\nWARC/1.1": 8}
    assert len(got) == len(pages)
    for page, _, html in pages:
        raw, r = (html or "").encode(), got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        if page is not None:
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first[html or ""] == page else ("revisit", first[html or ""]))
        assert r["intact"] is not False and (r["record_type"] == "revisit" or bytes(r["payload"]) == raw)
    for b in bundles.collect():  # random access by the map
        for rid, frame, offset in zip(b["ids"], b["frames"], b["offsets"], strict=True):
            assert warc.read_record(bytes(b["data"]), frame, offset)[0]["WARC-Record-ID"] == rid
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0
    assert [r["record_type"] for r in warc.read_bundles(warc.write_bundles(df, min_payload=1000)).collect()].count("revisit") == 0
    wanted = spark.createDataFrame([("<urn:page:9>",), ("<urn:page:3>",), ("<urn:page:77>",), (None,)], "record_id string")
    assert {(r["page_id"], r["record_type"], len(r["payload"])) for r in warc.fetch(bundles, wanted).collect()} == {(9, "response", 800_000), (3, "revisit", 0)}
    with pytest.raises(ValueError):
        warc.seek_table(b"no bundle, but long enough for a footer")


def test_warc_odd(spark):
    """Page ids and whole rows that come twice: one response for each payload; null ids; columns of clashing names."""
    pages = [(1, "a", "same"), (1, "b", "same"), (1, "b", "same"), (2, "c", "same"), (None, "d", "same"), (1, "e", "other"), (None, "f", "lone"), (None, "f", "lone"), (4, None, None), (4, None, None)]
    extra = {c: F.lit(7) for c in ("key", "salt", "_salt", "first", "n", "payload", "revisit", "uri")}
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns(extra).repartition(3)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(warc.write_bundles(df)).collect())
    assert got == Counter([(1, 4, "response", None), (1, 4, "revisit", 1), (1, 4, "revisit", 1), (2, 4, "revisit", 1), (None, 4, "revisit", 1), (1, 5, "response", None), (None, 4, "response", None), (None, 4, "response", None), (4, 0, "response", None), (4, 0, "revisit", 4)])


def test_bundles_are_plain_zstandard():
    import zstandard

    b = warc.Bundle(frame_bytes=50)
    for i in range(9):  # two records of 45 bytes to a frame
        b.add(str(i), b"record %d " % i * 5)
    data = b.close()
    table = warc.seek_table(data)
    assert len(table) == 5 and b"".join(warc.read_frame(data, table, i) for i in range(5)) == b"".join(b"record %d " % i * 5 for i in range(9))
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(b"record %d " % i * 5 for i in range(9))


def test_ppm_code_lengths():
    texts, langs = ["abracadabra", "zyzzyva zyz"], ["a", "z"]
    model = langid.fit(texts, langs, least=1)
    data = b"\n\n\nabra"
    bits = langid.code_lengths(model, np.frombuffer(data, np.uint8), np.array([len(data)]))[0]
    # plain version: escape method C by dictionaries
    for k, t in enumerate(texts):
        raw, total = t.encode(), 0.0
        alphabet = len(set("".join(texts).encode())) + 1
        for i in range(3, len(data)):
            cost = 0.0
            for order in (3, 2, 1, 0):
                ctx = data[i - order : i]
                nxt = Counter(raw[j + order] for j in range(len(raw) - order) if raw[j : j + order] == ctx)
                n, d = sum(nxt.values()), len(nxt)
                if n and nxt[data[i]]:
                    cost -= np.log2(nxt[data[i]] / (n + d))
                    break
                cost -= np.log2(d / (n + d)) if n else 0.0
            else:
                cost += np.log2(alphabet)
            total += cost
        assert abs(total - bits[k]) < 1e-3


def test_language(spark, docs, odd, empty):
    rng = random.Random(0)
    train = [(i, words(rng, 40, "der die das und nicht".split()) if i % 2 else words(rng, 40, "le la les et pas".split()), "de" if i % 2 else "fr", "s", 1) for i in range(60)]
    df = spark.createDataFrame(train, docs.schema)
    model = langid.train(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert all(got[t[0]]["lang_pred"] == t[2] and 0.5 < got[t[0]]["score"] <= 1 for t in train)
    assert [langid.predict(model, [t])[0] for t in (None, "", "12 34 ..")] == [("und", 0.0)] * 3
    assert langid.predict(model, ["der die das " * 100_000])[0][0] == "de"
    assert langid.identify(empty, model).count() == 0 and langid.identify(odd, model).count() == 5
    assert langid.predict(langid.train(empty), ["some text"]) == [("und", 0.0)]
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and {r["text"] for r in docs.collect()} - {r["text"] for r in kept.collect()} == {None, "", "  \n\t ", "123 456 ..."}


def test_language_query_equals_plain_version(spark, tmp_path):
    """The query's predictions and scores, from a plain PPM of the training rows of a small table."""
    rng = random.Random(5)
    stems = {"de": "der die das und nicht ein zu".split(), "fr": "le la les et pas une du".split(), "en": "the of and not a to".split()}
    rows = [(i, words(rng, rng.randint(3, 30), stems[x]), x) for i in range(90) for x in [rng.choice(list(stems))]] + [(90, None, "de"), (91, "12 !", "fr"), (92, "the der la", None), (5, "und das nicht", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 3)) for r in queries.QUERIES["op5_language_id"](spark, str(tmp_path)).collect())
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    train = [(t, x) for d, t, x in rows if t is not None and x is not None and not held(d)]
    # texts of a language are told end to end in the model's own order, which its counts across texts depend on
    model = langid.train(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert model.langs == sorted({x for _, x in train})
    expected = Counter()
    for d, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            expected[d, held(d), "und", 0.0] += 1
            continue
        data = b"\n\n\n" + t.encode()
        bits = [sum(float(model.cost[model.context[(s[0] * model.base + s[1]) * model.base + s[2]] * model.base + s[3], k]) for s in ([int(model.symbol[b]) for b in data[i - 3 : i + 1]] for i in range(3, len(data)))) for k in range(len(model.langs))]
        best = min(range(len(bits)), key=bits.__getitem__)
        share = 1 / sum(2 ** (-(b - bits[best]) / np.sqrt(len(data) - 3)) for b in bits)
        expected[d, held(d), model.langs[best], round(share, 3)] += 1
    assert sum((got - expected).values()) <= 1  # a score may round the other way
    right = [r for r in got if r[2] == next((x for d, _, x in rows if d == r[0]), None)]
    assert len(right) > 80


def check_packing(rows, ids):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d])
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / total


def test_packing(docs, empty, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    assert check_packing(packing.pack(docs, path).collect(), ids) < 0.02
    assert packing.pack(empty, path).count() == 0
    sizes = [len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect()]
    rows = packing.pack(odd, path).collect()
    assert sum(r["length"] for r in rows) == sum(sizes) and {(r["doc_id"], r["doc_tokens"]) for r in rows} == {(r["doc_id"], n) for r, n in zip(odd.collect(), sizes, strict=True)}


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    import pyarrow as pa

    path = queries.tokenizer_file("word_bpe_49k.json")
    own, t = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["It's DON'T we'll I'D x's 'S ''", "Größe ÄÖÜ straße ÉTÉ", "İstanbul ΣΑΣ ﬁ é É H̱", "a<|endoftext|>b <|startoftext|> <|x", "1234 5a6 ½ ² x²", "tab\tnew\nline nbsp em\x85nel\x1cfs", "日本語 русский 😀👍🏽", "...!!! @#$ a.b,c;d", "¡Hola! ¿qué? «oui» ×÷", None, "", "   "]
    ids, ends = own.encode(pa.array(texts, pa.string()))
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == t.encode(text or "", add_special_tokens=False).ids + [1], text
        begin = end


@pytest.mark.parametrize("most", [300, 1500, 5000])
def test_harmonic_bins(most):
    packer, rng = packing.HarmonicPacker(0), np.random.default_rng(0)
    sizes = rng.integers(1, most, 1500).tolist()
    for d, n in enumerate(sizes):
        packer.add(d, np.arange(n, dtype=np.uint32))
    packer.finish()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = [dict(zip(names, r, strict=True)) for r in packer.take()]
    assert check_packing(rows, {d: list(range(n)) for d, n in enumerate(sizes)}) == 0
    whole = {r["doc_id"] for r in rows if r["length"] == r["doc_tokens"]}
    fitting_docs = [d for d, n in enumerate(sizes) if n <= 2048]
    assert len(whole) > 0.7 * len(fitting_docs)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for own in by_seq.values():  # a bin of class j holds j whole documents of that class, then pieces
        kinds = Counter(2048 // r["length"] for r in own if r["length"] == r["doc_tokens"] and r["length"] > 128)
        full = sum(r["length"] for r in own) == 2048 and own[0]["length"] == own[0]["doc_tokens"]
        if full and kinds and own[0]["length"] > 128 and len(kinds) == 1:
            assert max(kinds.values()) <= max(kinds)


def test_harmonic_ends():
    for sizes in ([1], [2048], [2049], [1, 1, 1], [2047, 2], [1025] * 40, [4096, 5]):
        packer = packing.HarmonicPacker(0)
        for d, n in enumerate(sizes):
            packer.add(d, np.arange(n, dtype=np.uint32))
        packer.finish()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert check_packing([dict(zip(names, r, strict=True)) for r in packer.take()], {d: list(range(n)) for d, n in enumerate(sizes)}) == 0


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if seen[x] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs, odd, empty):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for r in docs.collect():
        mine = got[r["doc_id"]]
        expected = base_counts(r["text"])
        assert tuple(mine[1:6]) == expected
        assert mine["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (mine["base_failed"] and mine["kept"])
    mine = sorted(((r["doc_id"], *tuple(r)[1:6]) for r in quality.quality(odd).collect()), key=repr)
    assert mine == sorted(((r["doc_id"], *base_counts(r["text"])) for r in odd.collect()), key=repr) and quality.quality(empty).count() == 0
    rng = random.Random(4)
    rows = [(i, words(rng, 120) + ".", "en", "s", 1) for i in range(30)] + [(99, " ".join(f"{w}###$$$" for w in words(rng, 120).split()), "en", "s", 1)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, docs.schema)).collect()}
    assert not kept.pop(99) and all(kept.values())


def plain_distance(a, b):
    p, q = np.array(a) / max(sum(a), 1e-12), np.array(b) / max(sum(b), 1e-12)
    m = (p + q) / 2
    half = lambda v: sum(x * np.log2(x / y) for x, y in zip(v, m, strict=True) if x > 0)
    return np.sqrt(max(0, (half(p) + half(q)) / 2))


def test_distance(spark):
    a, b = [3.0, 0.0, 5.0], [1.0, 1.0, 0.0]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    got = df.select(quality._jsd(F.col("a"), F.lit(8.0), F.col("b"), F.lit(2.0)).alias("d")).first()["d"]
    assert abs(got - plain_distance(a, b)) < 1e-12


def plain_quality(rows):
    """kept by (doc_id, lang, text), as quality() defines it, in plain Python."""
    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counted = {}
    for _, lang, text in rows:
        counted.setdefault(lang, Counter()).update(w for w in split(text or "") if len(w) <= quality.LONGEST)
    counted = {x: Counter({w: n for w, n in c.items() if n > 1}) for x, c in counted.items()}
    top = sorted((x for x in counted if counted[x]), key=lambda x: (-sum(counted[x].values()), x is not None, x or ""))[: quality.LANGUAGES]
    common = sorted({w for x in top for w, _ in sorted(counted[x].items(), key=lambda y: (-y[1], y[0]))[: quality.PER_LANGUAGE]})
    found = []
    for doc, lang, text in rows:
        text = text or ""
        kinds = [sum(map(text.count, k)) for k in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?\"'()-")] + [sum(ord(x) > 127 for x in text), sum(map(text.count, "\t\n\v\f\r ")), sum(map(text.count, "#*$%&|<>"))]
        of = Counter(split(text))
        found.append((doc, lang, base_counts(text), [*kinds, max(0, len(text) - sum(kinds))], [of[w] for w in common], len(text)))

    def measure(core):
        mean = lambda own: [np.mean([np.array(r[i], float) / r[2][0] for r in own], axis=0).tolist() for i in (3, 4)]
        long = [r for r in core if r[2][0] >= 50]
        refs = {x: mean([r for r in long if r[1] == x]) for x in {r[1] for r in long} - {None}}
        every = mean(long)
        return [[min(plain_distance(r[3 + i], ref[i]) for ref in ([refs[r[1]]] if r[1] in refs else []) + [every]) for i in (0, 1)] for r in found]

    core = [r for r, d in zip(found, measure(found), strict=True) if d[0] <= 0.2]
    out = []
    for r, (chars, word) in zip(found, measure(core), strict=True):
        n, again = r[2][0], r[2][4]
        failed = n < 50 or 100 * again > 50 * n
        far = r[5] >= 200 and chars > 0.15 or sum(r[4]) >= 20 and word > 0.75
        out.append((r[0], common, chars, word, failed, not failed and not far))
    return out


def test_quality_equals_plain_version(spark, docs):
    rng = random.Random(12)
    rows = [(i, rng.choice(["en", "de", None, "*"]), words(rng, rng.randint(40, 160)) + rng.choice(["", " 123 456", ". Über ÉTÉ", "\n\nA b c"])) for i in range(120)]
    rows += [(200 + i, "en", " ".join(f"{w}###$$$" for w in words(rng, 80).split())) for i in range(5)] + [(300, "fr", None), (301, None, ""), (302, "de", "9 8 7 " * 60), (303, "rare", words(rng, 90))]
    rows += [rows[0], rows[1]]
    df = spark.createDataFrame([(d, t, x) for d, x, t in rows], "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("words", "n", "top", "rank", "classes", "rest")})
    plain = plain_quality(rows)
    assert quality.common_words(df) == plain[0][1]
    got = sorted(tuple(r) for r in quality.quality(df).select("doc_id", "char_distance", "word_distance", "base_failed", "kept").collect())
    expected = sorted((x[0], x[2], x[3], x[4], x[5]) for x in plain)
    assert [(g[0], g[3], g[4]) for g in got] == [(e[0], e[3], e[4]) for e in expected]
    assert np.allclose([g[1:3] for g in got], [e[1:3] for e in expected], atol=1e-4) and {e[4] for e in expected} == {True, False}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *[0] * len(b)], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = {"trash": 1.0, "clown": 1.0, "idiot": 1.0, "bad": 1.0, "gross*": 1.0}
    a, rng = toxicity.Automaton(terms), random.Random(1)
    found = set()
    for t in [x.rstrip("*") for x in terms]:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(0, 2)):
                at, how = rng.randrange(len(w) + 1), rng.randrange(3)
                if how == 0:
                    w.insert(at, rng.choice("abtrsh"))
                elif at < len(w):
                    w[at : at + 1] = [] if how == 1 else [rng.choice("abtrsh")]
            w = "".join(w)
            near = {x: edits(w, x) for x in ("trash", "clown", "idiot")}
            expected = {x: d for x, d in near.items() if d <= 1} | ({"bad": 0} if w == "bad" else {}) | ({"gross*": 0} if w.startswith("gross") else {})
            got = a.match(w)
            assert (got is None) == (not expected), w
            if got:
                assert expected[got[0]] == got[1] == min(expected.values())
            found.add(got)
    assert len(found) > 5 and a.match("grossly") == ("gross*", 0) and a.match("") is None


def plain_features(text, terms):
    """Features by edit distance to every term and by marks walked one by one."""
    low, total, top, wrong, kinds = text.lower(), 0.0, 0.0, 0.0, {}
    found = list(toxicity.WORD.finditer(low))
    for m in found:
        w, near = m.group(), []
        for t in terms:
            if t.endswith("*"):
                near += [(0, t)] if w.startswith(t[:-1]) else []
            elif (d := edits(w, t)) == 0 or d == 1 and len(t) >= 5:
                near.append((d, t))
        if not near:
            continue
        d, t = min(near)
        before, after = low[max(0, m.start() - 48) : m.start()], low[m.end() : m.end() + 48]
        around = set(toxicity.WORD.findall(before)) | set(toxicity.WORD.findall(after))
        quoted = False
        for i, ch in enumerate(before):
            if ch in toxicity.PAIRS and not (i and re.match(r"\w", before[i - 1])) and not (before[i + 1 : i + 2] or "x").isspace():
                inside = before[i + 1 :]
                shut = any(c in toxicity.PAIRS[ch] and j and not inside[j - 1].isspace() and not re.match(r"\w", inside[j + 1 : j + 2]) for j, c in enumerate(inside))
                quoted |= not shut and any(c in toxicity.PAIRS[ch] and not re.match(r"\w", after[j + 1 : j + 2]) for j, c in enumerate(after))
        share = 0.2 if quoted or around & toxicity.REPORT else 1.25 if around & toxicity.ADDRESS else 1.0
        score = terms[t] * (0.5 if d else 1.0) * share
        total, top, wrong = total + score, max(top, score), wrong + share * (d > 0)
        kinds[t] = max(kinds.get(t, 0), min(1.0, share))
    return [np.log1p(total), top, np.log1p(100 * total / max(len(found), 1)), np.log1p(wrong), min(sum(kinds.values()), 4.0), 1.0]


def test_features_equal_plain_version():
    rng, terms = random.Random(6), {"trash": 2.0, "clown": 1.5, "bad": 1.0, "gross*": 3.0, "idiot": 2.5}
    bits = ["trash", "trsh", "clowns", "bad", "bat", "grossly", "idiot", "you", "said", "calm", "river", "don't", '"', " „", "“", " «", "» ", "'", ".", ", ", "\n", "é"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ['he is "trash" ok', 'the "river" trash "calm" bank', "«a clown» ran", "„bad“", "don't trash can't", "", "'trash'"]
    a, memory = toxicity.Automaton(terms), {}
    for t in texts:
        assert np.allclose(toxicity.features(t, a, memory), plain_features(t, terms)), t
    assert toxicity.in_quotation('he is "', '" ok') and not toxicity.in_quotation('the "river" ', ' "calm" bank')


def test_toxicity(spark, docs, odd, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        text = words(rng, 60)
        if bad:
            text = " ".join(f"{w} {rng.choice(['moronic', 'worthless', 'pathetic'])}" if rng.random() < 0.1 else w for w in text.split()) + " worthless"
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 1, int(bad)))
    df, lab = spark.createDataFrame(rows, docs.schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, model).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in labels) and all(0 <= r["score"] <= 1 for r in got.values())
    a, m = toxicity.Automaton(model.terms), {}
    assert toxicity.features("you are worthles", a, m)[0] > 0
    weigh = lambda t: toxicity.score(model, a, m, t)
    assert weigh("you are worthless and so") > weigh('all that they "worthless" wrote on') and weigh("you are worthless and so") > weigh("the word worthless was quoted")
    expected = Counter((r["doc_id"], round(weigh(r["text"]), 9)) for r in odd.collect())
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity(odd, model).collect()) == expected
    assert toxicity.toxicity(empty, model).count() == 0
    none = toxicity.train(empty, lab)
    assert toxicity.toxicity(docs, none).count() == docs.count()


def test_quality_many_languages(spark, docs):
    rows = [(i, words(random.Random(i), 60), f"x{i}", "s", 1) for i in range(1100)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, docs.schema)).collect()}
    assert len(got) == 1100 and all(r["char_distance"] < 1e-3 for r in got.values())  # each text is its language's reference
    common = quality.common_words(docs)
    measured = quality.counts(docs, common)
    near = lambda most: sorted(map(repr, quality._distances(measured, measured, len(common), most).collect()))
    assert near(0) == near(1000)


def test_training_texts_are_whole(spark):
    calm = "the river ran past the old mill and on to the sea " * 450  # over 20,000 characters
    rows = [(i, calm + ("you vermin" if i % 2 else "the end") + " żółw", "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert "vermin" in toxicity.train(df, lab).terms
    assert all(langid.train(df).symbol[b] for b in "ż".encode())


def test_training_sample_is_bounded(spark):
    sizes = spark.createDataFrame([(3, 30, 5), (1, 10, 4), (2, 20, 90), (4, 40, 3), (1, 10, 2)], "h long, doc_id long, bytes long")
    assert fitting(sizes, 12) == [10, 30] and fitting(sizes, 1) == [] and fitting(sizes, 1000) == [10, 20, 30, 40]


def test_sentencepiece(docs, texts, empty, odd):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), spiece.Encoder(path)
    hard = ["  two  spaces   here ", "\n\nlines\n", "tab\tx", "日本語 😀 ▁ mark", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "The the THE thethethe", " ", "<s> </s> <unk> <0x41>", "é é"]
    for t in [*hard, *(x for x in texts if x is not None and len(x) < 5000)]:
        ids = own.encode([t])[0]
        assert ids == sp.encode(t), t
        assert own.decode(ids) == sp.decode(ids)
    got = {r["doc_id"]: r for r in spiece.round_trip(docs, path).collect()}
    assert all(r["exact"] for r in got.values())
    back = {r["doc_id"]: r["text"] for r in spiece.decode(spiece.encode(docs, path), path).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert spiece.round_trip(empty, path).count() == 0 and spiece.round_trip(odd, path).count() == 5


def test_shared_prefixes_equal_merging():
    path = queries.tokenizer_file("piece_bpe_32k.model")
    own, rng = spiece.Encoder(path), random.Random(9)
    made = sorted({spiece.MARK + "".join(rng.choice("ethrinaos") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    got = own.viterbi.encode_sorted(made)
    assert all(got[w] == own.pieces.merged(w) for w in made)


def test_quality_every_language_has_common_words(spark, monkeypatch):
    """Junk in the smallest of 14 languages is found, and lists of words give what the table of words gives."""
    own = [["".join(random.Random(f"{x} {i}").choices("abcdefghijklmnopqrstuvwxyz", k=5)) for i in range(60)] for x in range(14)]
    rows = []
    for x, lex in enumerate(own):
        rng = random.Random(x)
        rows += [(100 * x + i, f"l{x:02}" if x != 9 else None, " ".join(rng.choices(lex, range(60, 0, -1), k=100))) for i in range(20 - x)]
    rows += [(5000, "l13", " ".join(f"{own[13][23]} {own[13][22]} " + "".join(random.Random(i).choices("klmnop", k=8)) for i in range(40))), (5001, "l13", ""), (5002, "new", " ".join(own[3]))]
    rows += [rows[0]]
    df = spark.createDataFrame([(d, t, x) for d, x, t in rows], "doc_id long, text string, lang string")
    assert quality.common_words(df) is None
    monkeypatch.setattr(quality, "LANGUAGES", None)
    expected = sorted((x[0], x[4], x[5], x[2], x[3]) for x in plain_quality(rows))
    assert {e[2] for e in expected if e[0] // 100 < 50 and e[0] // 100 != 9} == {True}  # null lang: far from all rows
    assert [e[1:3] for e in expected if e[0] == 5000] == [(False, False)]
    for most in (quality.WORDS, 10**6):
        got = sorted(tuple(r) for r in quality.quality(df, most=most).select("doc_id", "base_failed", "kept", "char_distance", "word_distance").collect())
        assert [g[:3] for g in got] == [e[:3] for e in expected] and np.allclose([g[3:] for g in got], [e[3:] for e in expected], atol=1e-6)


def test_quality_word_table_equals_lists(spark, docs, odd, empty):
    for df in (docs, odd, empty):
        near = lambda most: sorted((repr(tuple(r)[:7]), r["kept"], r["char_distance"], r["word_distance"]) for r in quality.quality(df, most=most).collect())  # noqa: B023, E731
        a, b = near(-1), near(quality.WORDS)
        assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2:] for x in a], [x[2:] for x in b], atol=1e-6)
    # references and words joined by shuffle
    words = quality.vocabulary(docs)
    near = lambda most: sorted((r["doc_id"], r["common_sum"], r["word_distance"]) for r in quality._by_table(docs, words, 0.2, most).collect())
    assert near(0) == near(10**6)
