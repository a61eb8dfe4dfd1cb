"""The training-data operators against brute force on small fixtures: nulls, empties, long texts, ties, clashes."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest

from surmise.llm import _shared, bpe, chat, exact_dedup, lang_id, licenses, ngram_join, packing, quality_fm, quality_rules, registry, url_filter, url_labels
from surmise.llm.registry import URL_RULES, byte_bpe_path, url_model

tokenizers = pytest.importorskip("tokenizers")

RNG = random.Random(1)
WORDS = [f"w{i}" for i in range(300)] + ["été", "straße", "日本", "a'b", "it's"]


def words(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = words(6000)
BASE = words(120)
NEAR = BASE.rsplit(" ", 3)[0] + " changed end here"
TEXTS = [None, "", " \n\t ", "x", BASE, BASE, BASE.replace(" ", "\n  "), NEAR, LONG, LONG, "a\n\nb   c \n d  ", "<|endoftext|> x<|endoftext|>", words(80), words(80), "one two three four", "\x1c\x85 é 日本 \u2028 ok", "aaaa" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with ids, one repeated row, a null id, and extra columns with clashing names."""
    rows = [(i, t, "en", 1.0, True) for i, t in enumerate(TEXTS)] + [(3, "x", "en", 1.0, True), (None, "x", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(byte_bpe_path())


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


# -- 1: URL filters


def test_url_rules_and_model(spark):
    urls = ["http://A.b.COM/en/x?q", "https://www.Example.com/en/77#a", "http://example.com/en/8", "https://x.net/de/9", "https://m.example.net/de/81", "https://casino-win.example.org/fr/1", "https://ththre.example.org/fr/1", None, "no url", "http://", "x://h?p", "http://notcom/en/1"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in url_filter.judge(df, url_model(), URL_RULES).collect()}
    assert [(rows[i].host, rows[i].path) for i in range(3)] == [("a.b.com", "/en/x"), ("www.example.com", "/en/77"), ("example.com", "/en/8")]
    assert [rows[i].rule for i in range(5)] == ["com/en/", "example.com/en/7", "com/en/", "net/de/", "example.net/de/8"]
    assert [rows[i].verdict for i in range(7)] == ["block", "allow", "block", "allow", "block", "block", "allow"]
    assert all(rows[i].rule is None and (rows[i].host, rows[i].path) == ("", "") for i in (7, 8, 9))
    assert (rows[10].host, rows[10].path, rows[11].rule) == ("h", "", None)
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        z = url_model().bias + sum(url_model().weights[b] for b in url_filter.buckets(host, path))
        assert rows[i].score == pytest.approx(1 / (1 + np.exp(-z)))
    assert url_filter.judge(df.limit(0), url_model(), URL_RULES).count() == 0


def test_url_model_separates_hosts_it_has_not_seen():
    def share_right(rows):
        model = url_model()
        return sum((sum(model.weights[b] for b in url_filter.buckets(*url_filter.split_url(u))) + model.bias > 0) == bool(y) for u, y in rows) / len(rows)

    seen, unseen = url_labels.labelled_urls(), url_labels.held_out_urls()
    host = lambda u: url_filter.split_url(u)[0]
    assert not {host(u) for u, _ in seen} & {host(u) for u, _ in unseen}
    assert share_right(seen) == 1
    assert share_right([r for r in unseen if r[1]]) >= 0.95 and share_right([r for r in unseen if not r[1]]) >= 0.98


# -- 2 and 7: classifiers


def test_fm_identity():
    rng = np.random.default_rng(0)
    size = quality_fm.BUCKETS + len(quality_fm.STATS)
    model = quality_fm.FmModel(0.1, rng.normal(size=size) * 0.1, rng.normal(size=(size, 3)) * 0.1, np.zeros(len(quality_fm.STATS)), np.ones(len(quality_fm.STATS)))
    used, values, stats = quality_fm.features(BASE, 10)
    x = np.zeros(size)
    x[used], x[quality_fm.BUCKETS :] = values, stats
    at = np.flatnonzero(x)
    pairs = sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for k, i in enumerate(at) for j in at[:k])
    assert model.score(used, values, stats) == pytest.approx(1 / (1 + np.exp(-(model.bias + model.weights @ x + pairs))))


def test_features_equal_brute_force():
    text = "Ab cd cd!\n\nAb 1 | é\nAb 1 | é"
    used, values, stats = quality_fm.features(text, None)
    ws, raw = text.encode().split(), text.encode()
    counts = {}
    for w in ws:
        k = quality_fm.xxhash.xxh3_64_intdigest(w) % quality_fm.BUCKETS
        counts[k] = counts.get(k, 0) + 1
    assert dict(zip(used.tolist(), values.tolist(), strict=True)) == pytest.approx({k: (n / len(ws)) ** 0.5 for k, n in counts.items()})
    letters = sum(chr(c).isascii() and chr(c).isalpha() for c in raw)
    expected = [np.log1p(len(ws)), len(raw) / len(ws), 3 / letters, 2 / len(raw), 2 / len(ws), 1 / len(ws), 2 / len(ws), 4 / len(raw), np.log1p(3), 2 / 3, len(set(ws)) / len(ws), 0, 0, 1]
    assert stats.tolist() == pytest.approx(expected)


def test_quality_learns_and_scores_every_row(spark, docs, none):
    good, bad = [words(60) for _ in range(60)], ["BUY!! " * 30 + words(5) for _ in range(60)]
    table = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(good + bad)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    model = quality_fm.train(table, labels, labels.doc_id % 3 != 1)
    rows = quality_fm.score(table, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id < 60) for r in rows)
    odd = docs.selectExpr("*", "cast(null as long) as n_chars")
    scored = quality_fm.score(odd, model)
    assert scored.columns.count("score") == 1 and scored.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert quality_fm.score(odd.limit(0), model).count() == 0
    assert quality_fm.train(table, labels.limit(0), labels.doc_id > 0).score(*quality_fm.features("x", 1)) == pytest.approx(0.5)


def test_language_learns_rejects_and_handles_odd_texts(spark, docs, none):
    rows = [(i, " ".join(RNG.choice(["the", "thing", "other", "that"]) for _ in range(40)), "en") for i in range(80)] + [(100 + i, " ".join(RNG.choice(["été", "leçon", "quoi", "beau"]) for _ in range(40)), "fr") for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(table, table.doc_id % 4 != 2)
    assert all(r.lang_pred == r.lang and not r.rejected for r in lang_id.predict(table, model).collect())
    odd = lang_id.predict(docs, model)
    found = odd.collect()
    assert len(found) == docs.count() and odd.columns.count("score") == 1
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {0, 1, 2}
    assert lang_id.train(none, none.doc_id > 0) is None
    assert {r.lang_pred for r in lang_id.predict(docs, None).collect()} == {"und"}
    assert lang_id.predict(none, model).count() == 0


def test_language_counts_whole_texts():
    text = "abc déf ghi " * 40
    whole = lang_id.bucket_counts(text)
    assert lang_id.bucket_counts("12 34") is None and whole.sum() > 0
    assert (lang_id.bucket_counts(text * 2) >= 2 * whole).all()


def test_language_rejects_texts_in_no_learned_language():
    rng = random.Random(7)
    speech = {"en": ["the", "thing", "other", "that", "with"], "fr": ["été", "leçon", "quoi", "beau", "avec"]}
    texts = [(lang, " ".join(rng.choice(ws) for _ in range(60))) for lang, ws in speech.items() for _ in range(100)]
    x = np.array([lang_id.bucket_counts(t) for _, t in texts], np.float32)
    model = lang_id.fit([lang for lang, _ in texts], x / x.sum(axis=1, keepdims=True))
    score = lambda t: model.probabilities(lang_id.bucket_counts(t)).max()
    assert all(score(t) >= model.threshold for _, t in texts) and score("the thing q") >= model.threshold
    for other in ("suomen kieli on uralilaisten kielten ryhmään kuuluva kieli jota puhuvat pääosin suomalaiset", "a magyar nyelv az uráli nyelvcsalád tagja", "русский язык является одним из восточнославянских языков", "中文是世界上使用人数最多的语言之一我们今天去学校学习历史和地理"):
        assert score(other) < model.threshold, other


# -- 3: BPE


@pytest.mark.parametrize("kind", [bpe.ByteBpe, bpe.NativeBpe])
def test_bpe_equals_the_library(library, kind):
    own = kind(byte_bpe_path())
    odd = [*" \n\t\r", "  ", "   ", " \n ", "ab", "é", "1", ".", "'s", "\u3000", "\xa0", "<|endoftext|>", "\x1c", "\u0301", "😀", "x"]
    texts = [t or "" for t in TEXTS] + ["".join(RNG.choice(odd) for _ in range(RNG.randint(0, 25))) for _ in range(600)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, repr(t)
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)
    assert own.encode(None) == b""


def test_bpe_follows_the_files_settings(tmp_path, library):
    """A space in front is added if the file says so; what isn't supported is refused, not ignored."""
    spec = json.loads(open(byte_bpe_path(), encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "space.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    other = tokenizers.Tokenizer.from_file(path)
    for t in ("hello!", " hello", "a<|endoftext|>b", "", "\nx"):
        assert np.frombuffer(bpe.ByteBpe(path).encode(t), "<u4").tolist() == other.encode(t, add_special_tokens=False).ids, t
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"end_of_word_suffix": "</w>"}}):
        json.dump(spec | change, open(path, "w", encoding="utf-8"))
        with pytest.raises(ValueError, match="isn't supported"):
            bpe.ByteBpe(path)


def test_bpe_tables_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 5)
    own = bpe.ByteBpe(byte_bpe_path())
    assert np.frombuffer(own.encode(BASE), "<u4").tolist() == library.encode(BASE, add_special_tokens=False).ids
    assert len(own.after_space) <= 5


def test_bpe_frames(docs, none, library):
    out = bpe.decode(bpe.encode(docs, byte_bpe_path()), byte_bpe_path())
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            text = TEXTS[r.doc_id] or ""
            assert r.text == text and r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
    assert bpe.decode(bpe.encode(none, byte_bpe_path()), byte_bpe_path()).count() == 0
    both = bpe.round_trip(docs, byte_bpe_path())
    assert both.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted(map(repr, map(tuple, both.collect()))) == sorted(repr((r.doc_id, r.n_tokens, r.ids, r.text)) for r in rows)
    assert bpe.round_trip(none, byte_bpe_path()).count() == 0


def test_compiled_bpe_cuts_like_the_library(library):
    own = bpe.NativeBpe(byte_bpe_path())
    parts = ["a", "中", "7", " ", "\n", "\r\n", "\t", "\u00a0", "\u0085", "\u001c", "'s", "'ll", "'", "!", "\u0301", "<|endoftext|>", "\u3000", "½", "_"]
    rng = random.Random(11)
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    for t in (" " * 200_000, "\u00a0" * 200_000 + "x", "a" * 200_000):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


# -- 4: n-gram join


def test_band_counts_reach_the_recall():
    bands, rows = ngram_join.band_counts(0.8, 0.99, 256)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands * rows <= 256
    with pytest.raises(ValueError):
        ngram_join.band_counts(0.5, 0.9999, 2)


def _brute_classes(rows, similarity=0.8):
    """(class, whether it has a link) of each row number, from all pairs."""
    sets = [ngram_join.ngram_set(" ".join((t or "").encode().decode().split()).encode(), 5) for _, t in rows]
    keys = [b" ".join((t or "").encode().split()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if keys[i] == keys[j] or (both and both / len(sets[i] | sets[j]) >= similarity):
                root[find(i)] = find(j)
    return [min((rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None), default=None) for i in range(len(rows))]


def test_near_copies_equal_brute_force(spark, none):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is None or "\x1c" not in t]
    family = words(150).split()
    for i in range(60):  # a family that drifts: members differ from each other more than from their base
        copy = list(family)
        for _ in range(RNG.randint(0, 6)):
            copy[RNG.randrange(len(copy))] = f"edit{i}{RNG.random()}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(3, "x"), (None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", ngram_join.F.lit("clash"))
    got = ngram_join.classes(table).collect()
    assert len(got) == len(rows)
    expected = sorted(zip((str(r[0]) for r in rows), map(str, _brute_classes(rows)), strict=True))
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == expected
    links = {r.doc_id: r.n_links for r in got}
    assert links[12] == 0 and links[8] == 1 and links[0] == 2
    assert ngram_join.classes(none).count() == 0


@pytest.mark.parametrize("block", [16, 256])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng, rows = random.Random(4), []
    for size, most in ((300, 3), (150, 6)):  # all pairs of the first family are similar, some of the drifting one
        base = [f"b{size}x{i}" for i in range(size)]
        rows += [" ".join(base)] * 7
        for i in range(60):
            copy = list(base)
            for k in rng.sample(range(size), 3 if most == 3 else rng.randint(0, most)):
                copy[k] = f"e{size}x{i}x{k}"
            rows += [" ".join(copy)] * (1 + (i % 5 == 0))
    sets = [ngram_join.ngram_set(t.encode(), 5) for t in rows]
    expected = [sum(i != j and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = ngram_join.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert [r.n_links for r in sorted(got, key=lambda r: r.doc_id)] == expected
    assert set(expected[:79]) == {78} and len(set(expected)) > 3


# -- 5: quality rules


def _measures(text):
    text = text or ""
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 400 else None
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": None if covered is None else len(covered)}


def test_measures_equal_brute_force(spark):
    texts = [*TEXTS, "a b c a b c a b", "x\nx\n\n \nx y", "#*a |<> %", "a a a a a a", "a b c d a b c", " ".join(RNG.choice("abc") for _ in range(90))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    emit = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality_rules.apply_rules(df, emit=emit).collect():
        for name, value in _measures(texts[r.doc_id]).items():
            assert value is None or r[name] == value, (name, texts[r.doc_id][:60])


def test_order_never_changes_the_result(docs, none):
    rules = list(quality_rules.BASE_RULES + quality_rules.OWN_RULES)
    first = {(r.doc_id, r.kept) for r in quality_rules.apply_rules(docs, rules, sample_rows=0).collect()}
    assert first == {(r.doc_id, r.kept) for r in quality_rules.apply_rules(docs, rules[::-1], sample_rows=0).collect()}
    assert first == {(r.doc_id, r.kept) for r in quality_rules.apply_rules(docs, rules).collect()}
    assert {x.name for x in quality_rules.order_by_gain(docs, rules)} == {x.name for x in rules}
    assert quality_rules.apply_rules(none, rules).count() == 0


# -- 6: licenses


def test_licenses(spark, docs, none):
    texts = ["Licensed under the APACHE-License, version 2.0!", "the MIT license the mit license", "Relased under teh MIT License.", "This work is licenced under the GNU General Public License version 3", "the mit licenses", None, "cc-by-nc 4.0", "under the terms of the gnu lesser generel public license"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    scanned = licenses.scan(df)
    got = by_id(scanned.select("doc_id", "n_words", "spans", *(c.alias(n) for n, c in licenses.summary(scanned).items())).collect())
    assert [got[i].base_labels for i in range(8)] == ["apache-2", "mit", "", "", "", "", "cc-by-nc", ""]
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == (2, 0, 3, 6)
    assert "gpl-3" in got[3].labels and "lgpl" in got[7].labels and got[5].first_word is None and got[5].score == 0
    assert 0 < got[3].score < 1 and got[0].score == 1
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0


def test_phrase_places_equal_brute_force(spark):
    """All base columns of the scan against a plain search, over texts made of the phrases' words."""
    rng, vocabulary = random.Random(2), ["the", "mit", "license", "MIT", "apache", "Version", "2", "cc", "by", "nc", "é", "the mit license", "CC-BY-NC", "apache license, version 2"]
    texts = [None, "", *(rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    scanned = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"])
    got = by_id(scanned.select("doc_id", "n_words", *(c.alias(n) for n, c in licenses.summary(scanned).items())).collect())
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in at]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(ws), len(at), min(starts, default=None), max(starts, default=None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in at})) and set(got[i].base_labels.split(",")) <= {*got[i].labels.split(","), ""}


def test_license_query_keeps_its_contract(spark, tmp_path):
    """The query's base columns on odd texts: "the mit license" alone is a label, not a base place."""
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    parts = ["under", "the mit license", "under the MIT License", "Apache-License, Version 2", "2.0", "CC", "BY-NC", "cc\x00by\x7fnc", "\u0130", "\u212a", "the\u00a0mit license", "\u0085", "under\tthe\rmit\nlicense"]
    rng = random.Random(6)
    texts = [None, "", "the mit license", "under the mit license under the mit license", *(rng.choice([" ", "_", ""]).join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(80))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(registry.op6_license_scan(spark, str(tmp_path)).collect())
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for phrase, label in phrases.items() for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in at]
        expected = (len(ws), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == expected, t
    assert (got[2].n_base, got[2].labels, got[3].n_base, got[3].last_word) == (0, "mit", 2, 4)


@pytest.mark.parametrize(
    "text, label, edits",
    [
        ("relased under teh mit license", "mit", 3),
        ("permission to use copy and or distribute this software for any purpose with or without fee", "isc", 7),
        ("permission is granted free of charge to any person obtaining a copy", "mit", 7),
        ("redistribution and use in source or binary form with or without modifications is permitted", "bsd", 8),
    ],
)
def test_garbled_notices_are_found_up_to_a_tenth(text, label, edits):
    scanner = licenses.Scanner({}, licenses.NOTICES, licenses.ERROR_SHARE)
    assert all(k == len(n) // 10 for n, _, k in scanner.notices)
    assert min(_distance(n, text) for n, x, _ in scanner.notices if x == label) <= edits
    assert label in {s[2] for s in scanner.spans(f"some words {text} and more")}


def _distance(a, b):
    """Fewest edits of ``a`` to a substring of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_fuzzy_notices_equal_brute_force():
    scanner = licenses.Scanner({}, licenses.NOTICES, licenses.ERROR_SHARE)
    for _ in range(60):
        notice, _, k = RNG.choice(scanner.notices)
        text = list(f"some words {notice} and more")
        for _ in range(RNG.randint(0, k + 2)):
            text[RNG.randrange(11, 11 + len(notice))] = RNG.choice(["", "x", "zq"])
        text = "".join(text)
        expected = {label for n, label, errors in scanner.notices if _distance(n, text) <= errors}
        assert {s[2] for s in scanner.spans(text)} == expected, text


# -- 8: exact dedup


@pytest.mark.parametrize("memtable_rows", [3, 1000])
def test_exact_copies_equal_brute_force(docs, none, memtable_rows):
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    got = exact_dedup.dedup(docs, memtable_rows=memtable_rows).collect()
    expected = []
    for i, t in rows:
        ids = [x for x, s in rows if s == t]
        keep = min((x for x in ids if x is not None), default=None)
        expected.append((str(i), keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == sorted(expected)
    assert exact_dedup.dedup(none).count() == 0


def test_clashing_digests_are_told_apart_by_bytes(docs):
    weak = lambda text: exact_dedup.F.unhex(exact_dedup.F.lit("00"))
    strong = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup(docs).collect()}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup(docs, digest_of=weak).collect()} == strong


def test_index_keeps_smallest_over_batches(spark):
    index = exact_dedup.LsmIndex(spark, memtable_rows=2)
    for batch in ([(5, b"a"), (9, b"b")], [(3, b"a"), (7, b"c")]):
        index.flush(spark.createDataFrame(batch, "doc_id long, digest binary"))
    wanted = spark.createDataFrame([(b"a",), (b"z",)], "digest binary")
    assert [(r.keep_id, r.copies) for r in index.lookup(wanted).collect()] == [(3, 2)]
    assert index.lookup(spark.createDataFrame([(b"nowhere",)], "digest binary")).isEmpty() and index.skipped == 2
    assert {bytes(r.digest): (r.keep_id, r.copies) for r in index.compact(full=True).runs.collect()} == {b"a": (3, 2), b"b": (9, 1), b"c": (7, 1)}
    index.drop()


def test_every_memtable_is_a_sorted_run(spark):
    index = exact_dedup.LsmIndex(spark, memtable_rows=50)
    rows = [(i, hashlib.sha256(bytes([i % 90])).digest()) for i in range(200)]
    index.flush(spark.createDataFrame(rows, "doc_id long, digest binary").repartition(2))
    assert len(index.segments) == 1 and index.segments[0].level == 0
    files = index.segments[0].runs.inputFiles()
    assert len(files) >= 4
    for f in files:
        digests = [bytes(r.digest) for r in spark.read.parquet(f).collect()]
        assert digests == sorted(digests) and len(digests) <= 50
    expected = {d: (min(i for i, x in rows if x == d), sum(x == d for _, x in rows)) for _, d in rows}
    looked = index.lookup(spark.createDataFrame([(d,) for d in expected], "digest binary")).collect()
    assert {bytes(r.digest): (r.keep_id, r.copies) for r in looked} == expected
    assert {bytes(r.digest): (r.keep_id, r.copies) for r in index.compact(full=True).runs.collect()} == expected
    assert len(index.segments) == 1
    index.drop()


def test_levels_fill_up_and_lookups_skip_segments(spark):
    """Seven batches at a fan-out of two: levels 0, 1 and 2 hold a segment each, as the bits of seven do."""
    index, key = exact_dedup.LsmIndex(spark, memtable_rows=10, fanout=2), lambda k: hashlib.sha256(str(k).encode()).digest()
    for k in range(7):
        index.flush(spark.createDataFrame([(100 * k + i, key(10 * k + i)) for i in range(20)], "doc_id long, digest binary"))
        index.compact()
    assert sorted(s.level for s in index.segments) == [0, 1, 2]
    # only the last batch holds this one, and the filters tell
    assert [(r.keep_id, r.copies) for r in index.lookup(spark.createDataFrame([(key(79),)], "digest binary")).collect()] == [(619, 1)]
    assert index.skipped == 2
    # in two neighbouring batches
    assert [(r.keep_id, r.copies) for r in index.lookup(spark.createDataFrame([(key(35),)], "digest binary")).collect()] == [(215, 2)]
    index.drop()


def test_filters_never_exclude_a_key(spark):
    keys = spark.range(5000).selectExpr("cast(id * 7 as string) as k")
    bitmaps, bits = _shared.bit_filter(keys, "k")
    others = spark.range(5000).selectExpr("concat('x', id) as k")
    assert _shared.may_hold(keys, "k", bitmaps, bits).where("NOT may_hold").isEmpty()
    assert _shared.may_hold(others, "k", bitmaps, bits).where("may_hold").count() < 500
    empty, bits = _shared.bit_filter(keys.limit(0), "k")
    assert _shared.may_hold(keys, "k", empty, bits).where("may_hold").isEmpty()


# -- 9: chat


def test_chat_round_trip(spark):
    rows, nasty = [], ["<|im_end|>", "\\", "\\n", "<", "|", "<\\|", "\n", "<|im_start|>assistant\nno", "é😀"]
    for c in range(12):
        n = RNG.randint(1, 12)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else RNG.choice(["user", "assistant"])
            rows.append((c, t, role, None if RNG.random() < 0.05 else "".join(RNG.choice([*nasty, " word"]) for _ in range(RNG.randint(0, 12)))))
    rows += [(20, 0, "assistant", words(3000)), (20, 1, "assistant", "tie"), (20, 1, "assistant", "tie"), (None, None, None, None), (21, 0, "system", "alone")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", chat.F.lit("clash")).repartition(3)
    formatted = chat.windows(table, byte_bpe_path(), budget=120, history=50)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted((x for x in rows if x[0] == c), key=key)
        said = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    windows = formatted.collect()
    for w in windows:
        turns = chat.parse(w.text)
        assert w.tokens <= 120 or len(turns) - w.repeated <= 1 + (turns[0][0] == "system")
        assert all(w.text[s.start : s.stop] == chat.escape(chat.unescape(w.text[s.start : s.stop])) for s in w.loss)
    assert any(w.repeated > 1 for w in windows)
    assert chat.read_back(chat.windows(table.limit(0), byte_bpe_path())).count() == 0


def test_control_strings_in_the_registered_query(spark, sf_dir):
    got = by_id([r.asDict() | {"doc_id": r.conv_id} for r in registry.op9_chat_format(spark, sf_dir).collect()])
    said = registry.CONTROL_TEXT
    assert (got[-1]["n_turns"], got[-1]["loss_chars"], got[-1]["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


# -- 10: packing


def test_packing_is_one_gapless_stream(docs, none, library):
    out = packing.pack(docs, byte_bpe_path(), window=64)
    rows = sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        assert (r.sequence_id, r.offset) == divmod(at, 64) and r.length > 0 and r.offset + r.length <= 64
        at += r.length
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (i, n), parts in pieces.items():
        if i not in (None, 3):
            ids = [*library.encode(TEXTS[i] or "", add_special_tokens=False).ids, 1]
            assert n == len(ids) and b"".join(bytes(p.ids) for p in sorted(parts, key=lambda p: p.start)) == np.array(ids, "<u4").tobytes()
    assert at == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*TEXTS, "x", "x"])
    whole = packing.sequences(out, 64).collect()
    assert {len(bytes(s.ids)) for s in whole} == {256} and sum(s.n_tokens for s in whole) == at
    assert out.select(packing.F.crc32("ids").alias("c"), "ids").first()["c"] == zlib.crc32(bytes(out.first()["ids"]))
    assert packing.pack(none, byte_bpe_path()).count() == 0
