"""The pipeline's stages, one by one, and the registered queries on small tables."""

from collections import Counter

import pytest

import corpus_pipeline
from mosaiq.llm import queries, suffix
from tests.llm.test_dedup import brute_fingerprint, components, norm
from tests.llm.test_text import check_packing


def plain_cut(texts, length):
    """Texts without the bytes that repeated strings cover; None for those that go wholly."""
    raws = [(t or "").encode() for t in texts]
    seen, out = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1)), []
    for t, r in zip(texts, raws, strict=True):
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        if any(gone):
            t = bytes(x for x, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore") or None
        out.append(t)
    return out


def plain_stages(rows):
    """{doc_id: text} after each stage that filters, in plain Python."""
    rows = {d: t for d, t in rows.items() if t and any(map(str.isalpha, t))}
    yield "language", rows
    last = {}
    for d in sorted(rows):
        last[norm(rows[d])] = d
    rows = {d: rows[d] for d in last.values()}
    yield "exact_dedup", rows
    fp = {d: brute_fingerprint(t) for d, t in rows.items()}
    top = components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    rows = {d: rows[d] for d in set(top.values())}
    yield "simhash", rows
    cut = dict(zip(rows, plain_cut(list(rows.values()), suffix.PASSAGE), strict=True))
    yield "suffix_dedup", {d: t for d, t in cut.items() if t is not None}


def test_pipeline(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "simhash", "suffix_dedup", "packing"]
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    expected = dict(plain_stages({r["doc_id"]: r["text"] for r in docs.collect()}))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in step.collect()} == expected[name], name
    t = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    ids = {d: t.encode(x, add_special_tokens=False).ids + [1] for d, x in expected["suffix_dedup"].items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert check_packing(rows, ids) < 0.02


def test_stages_keep_odd_rows(spark, odd, empty):
    """Null ids, whole rows twice and columns of clashing names go through every stage that filters."""
    kept = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").count() == 0, name
        kept = stage(spark, kept, "")
        assert kept.columns == odd.columns, name
        found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
        text = {r["doc_id"]: r["text"] for r in odd.collect() if r["text"]}
        if name == "language":
            assert found == sorted([(None, text[1]), (1, text[1]), (1, text[1]), (2, text[2])], key=repr)
        if name in ("exact_dedup", "simhash"):  # a winner that is there twice stays twice
            assert found == sorted([(1, text[1]), (1, text[1]), (2, text[2])], key=repr)
    long = len(text[1].encode()) >= suffix.PASSAGE
    assert found == sorted([(2, text[2])] if long else [(1, text[1]), (1, text[1]), (2, text[2])], key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert out.count() >= 0 and len(out.columns) == len(set(out.columns))
    if name in queries.ORACLE_SQL:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = con.execute(queries.ORACLE_SQL[name])
        cols = [x[0] for x in found.description]
        assert sorted(map(repr, map(tuple, out.select(*cols).collect()))) == sorted(map(repr, found.fetchall()))
