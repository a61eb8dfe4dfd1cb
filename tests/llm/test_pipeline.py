"""The pipeline's rows against a brute-force version on the smallest documents table."""

import re

import numpy as np
import pytest

import corpus_pipeline
from surmise.llm import lang_id, ngram_join
from surmise.llm.registry import byte_bpe_path, id_remainder

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _rejected_by_rules(text):
    ws = [w for w in SPACE.split(text or "") if w]
    n, grams = len(ws), {}
    for i in range(len(ws) - 2):
        grams.setdefault(tuple(ws[i : i + 3]), []).append(i)
    repeats = len({i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)})
    chars, letters = sum(map(len, ws)), re.findall(r"[A-Za-z]", text or "")
    symbols, marks, capitals = len(re.findall(r"[#*$%&|<>]", text or "")), (text or "").count("!"), sum(c <= "Z" for c in letters)
    return n < 50 or 100 * repeats > 50 * n or 10 * symbols > 3 * n or 2 * marks > n or 10 * capitals > 6 * len(letters) or chars > 12 * n or chars < 2 * n


def test_pipeline_equals_brute_force(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]

    rows = [r for r in rows if not _rejected_by_rules(r[1])]
    kept = table.where(table.doc_id.isin([i for i, _ in rows]))
    model = lang_id.train(kept, id_remainder("doc_id", 4) != 2)
    rows = [r for r in rows if (c := lang_id.bucket_counts(r[1])) is not None and model.probabilities(c).max() >= model.threshold]

    first = {}
    for i, t in sorted(rows):
        first.setdefault(SPACE.sub(" ", t), i)
    rows = [r for r in sorted(rows) if first[SPACE.sub(" ", r[1])] == r[0]]

    grams = [ngram_join.ngram_set(" ".join(SPACE.split(t)).strip().encode(), 5) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if 5 * both >= 4 * (len(grams[i]) + len(grams[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    rows = [r for i, r in enumerate(rows) if root[i] == i]

    library = tokenizers.Tokenizer.from_file(byte_bpe_path())
    got = sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: (r.sequence_id, r.offset))
    at, pieces = 0, {}
    for r in got:
        assert (r.sequence_id, r.offset) == divmod(at, 2048)
        at += r.length
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {i for i, _ in rows}
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert b"".join(bytes(p.ids) for p in sorted(pieces[i], key=lambda p: p.start)) == np.array(ids, "<u4").tobytes()


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_repeated_rows_stay_once(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " ", "en", "s", 1), (None, "other " + text[::-1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.exact(spark, docs, sf_dir)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect())[0] == ("1", text)
    assert kept.count() == 3 and corpus_pipeline.near(spark, kept, sf_dir).count() == 2


def test_one_row_of_a_class_stays_for_shared_and_null_ids(spark, monkeypatch):
    """Similar rows with one id, with null ids, and repeated rows whose other columns differ; columns with clashing names."""
    base = " ".join(f"word{i}" for i in range(200))
    near, other = base + " more", " ".join(f"other{i}" for i in range(200))
    rows = [(1, base, "b", "x"), (1, near, "a", "x"), (None, other, "b", "y"), (None, other + " end", "a", "y"), (7, "alone", "z", "z"), (7, "alone", "q", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, root string").withColumns({"digest": corpus_pipeline.F.lit("clash"), "row": corpus_pipeline.F.lit(1), "id": corpus_pipeline.F.lit(2)})
    kept = corpus_pipeline.near(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.root) for r in kept) == [("1", "x"), ("7", "z"), ("None", "y")]
    assert [r.lang for r in kept if r.doc_id == 7] == ["q"] and kept[0].__fields__ == docs.columns
    kept = corpus_pipeline.exact(spark, docs.unionByName(docs), "").collect()
    assert sorted((str(r.doc_id), r.text[:6]) for r in kept) == sorted([("1", "word0 "), ("1", "word0 "), ("None", "other0"), ("None", "other0"), ("7", "alone")])
    assert corpus_pipeline.near(spark, docs.limit(0), "").columns == docs.columns
