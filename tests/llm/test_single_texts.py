"""Operators that judge each text alone, and the one that looks at the next: held against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from held import frame, same

from factorloom.llm import bpe, exact, language, lexicon, neardup, prints, secrets, toxicity
from factorloom.llm.queries import tokenizer_file

sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# ---- language -----------------------------------------------------------------------------------


def test_language_is_right_on_held_out_rows(small, small_rows):
    got = frame(language.language_report(small), "doc_id").set_index("doc_id")
    assert len(got) == len(small_rows)
    judged = [(got.lang_pred[d], lang) for d, text, lang in small_rows if zlib.crc32(str(d).encode()) % 5 == 0 and lang and text and any(map(str.isalpha, text))]
    assert len(judged) > 10 and np.mean([a == b for a, b in judged]) > 0.9
    for d, text, _ in small_rows:
        assert got.held_out[d] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert (got.lang_pred[d] == "und") == (not text or not any(map(str.isalpha, text)))
    assert got.score.between(0, 1).all()


def test_language_odd_rows(odd, odd_rows, none):
    got = language.language_report(odd).toPandas()
    assert len(got) == len(odd_rows) and set(got.lang_pred) <= {"en", "de", "und"}
    assert language.language_report(none).count() == 0
    alone = language.identify(odd, {}).toPandas()
    assert set(alone.lang_pred) == {"und"} and set(alone.score) == {0.0}


def test_language_of_long_texts_of_many_letters(spark):
    rng = np.random.default_rng(4)
    words = [["".join(map(chr, 0x4E00 + 400 * k + rng.integers(0, 300, 3))) for _ in range(150)] for k in range(4)]
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    schema = "doc_id long, text string, lang string"
    short = spark.createDataFrame([(i, text(i % 4, 40), f"l{i % 4}") for i in range(200)], schema)
    long = [(i, text(i % 4, 2000), f"l{i % 4}") for i in range(12)]
    assert all(len(set(t)) > 200 for _, t, _ in long)
    parts = [(100 * (i + 1) + j, t[j * 80 : j * 80 + 80], lang) for i, t, lang in long for j in range(5)]
    got = language.identify(spark.createDataFrame(long + parts, schema), language.train(short)).toPandas().set_index("doc_id")
    assert [got.lang_pred[i] for i, _, _ in long + parts] == [lang for *_, lang in long + parts]
    one, two = language.Bundler(most_letters=20), language.Bundler()
    assert all(one.bundle(t) @ two.bundle(t) > 0.9999 for _, t, _ in parts)


# ---- secrets ------------------------------------------------------------------------------------

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16))


def plain_secrets(doc_id, text):
    found = [(m.start(), i, m.end()) for i, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n]
    said = ",".join(f"{BASE[i][0]}:{a}:{b}" for a, i, b in sorted(found))
    return (doc_id, *(sum(i == k for _, i, _ in found) for k in range(3)), sha(said))


@pytest.mark.parametrize("table", ["odd", "small", "none"])
def test_secrets_equal_plain_patterns(table, request):
    docs = request.getfixturevalue(table)
    got = secrets.secret_report(docs).toPandas()
    same(got[["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]], [plain_secrets(r["doc_id"], r["text"]) for r in docs.collect()])


def test_checksummed_tokens(spark):
    payload, digits, value = "a1B2c3D4e5" * 3, "", zlib.crc32(("a1B2c3D4e5" * 3).encode())
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = secrets.BASE62[d] + digits
    raw = b"\x04\x88\xad\xe4" + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    key, value = "", int.from_bytes(raw)
    while value:
        value, d = divmod(value, 58)
        key = secrets.BASE58[d] + key
    npm = f"npm_{payload}{digits}"
    texts = [f"é ghp_{payload}{digits} ghp_{payload}000000 {key} {key[:-1]}1", f"{npm}, {npm}x, ghx_{payload}{digits}", ""]
    plain = {"forge_token": (r"gh[opusr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", {f"ghp_{payload}{digits}"}), "package_token": (r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", {npm}), "extended_key": (r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])", {key})}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = frame(secrets.secret_report(docs), "doc_id")
    for i, text in enumerate(texts):
        good = [f"{kind}:{m.start()}:{m.end()}" for kind, (p, valid) in plain.items() for m in re.finditer(p, text) if m[0] in valid]
        assert [x for x in got.spans[i].split(",") if x and x.split(":")[0] in plain] == sorted(good, key=lambda x: int(x.split(":")[1]))
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert redacted[0] == f"é <forge_token> ghp_{payload}000000 <extended_key> {key[:-1]}1" and redacted[1] == f"<package_token>, {npm}x, ghx_{payload}{digits}"


# ---- exact dedup --------------------------------------------------------------------------------


def plain_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known, default=None)
        rest = 1
        for d in ids:
            kept = d == keep and rest > 0
            rest -= kept
            out.append((d, keep, len(ids), bool(kept), sha(t)))
    return out


@pytest.mark.parametrize("table", ["odd", "small", "none"])
def test_exact_dedup(table, request):
    docs = request.getfixturevalue(table)
    same(exact.exact_dedup(docs).toPandas(), plain_exact([(r["doc_id"], r["text"]) for r in docs.collect()]))
    stays = exact.keep_first_copies(docs)
    assert stays.columns == docs.columns and stays.count() == len({r["text"] or "" for r in docs.collect()})


def small_batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_index_is_kept_between_batches(spark, tmp_path):
    index = exact.DigestIndex(spark, path=str(tmp_path / "index"), buckets=4)
    index.admit(small_batch(spark, [(1, "a"), (2, "b")])).collect()
    got = frame(index.admit(small_batch(spark, [(3, "a"), (4, "c"), (5, "c")])), "doc_id")
    same(got[["doc_id", "keep_id", "group_size", "kept"]], [(3, 1, 1, False), (4, 5, 2, False), (5, 5, 2, True)])
    assert index.table().count() == 3
    spark.sql(f"drop table {index.name}")


def test_index_outlives_its_catalogue_entry(spark, tmp_path):
    path = str(tmp_path / "index")
    index = exact.DigestIndex(spark, "kept_index", path, buckets=4)
    index.admit(small_batch(spark, [(1, "a"), (2, "b")])).collect()
    spark.sql("drop table kept_index")  # as after a restart; the files stay
    index = exact.DigestIndex(spark, "kept_index", path)
    got = frame(index.admit(small_batch(spark, [(3, "a"), (4, "c")])), "doc_id")
    same(got[["doc_id", "keep_id", "kept"]], [(3, 1, False), (4, 4, True)])
    assert index.buckets == 4 and index.table().count() == 3
    assert "Exchange" not in index.table().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table kept_index")


@pytest.mark.parametrize("ranges", [1, 3])
def test_exact_dedup_by_ranges(spark, monkeypatch, ranges):
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(None, "text 3"), (None, "alone"), (12, "text 5"), (12, "text 5"), (5, None), (6, "")]
    plans, decide = [], exact.DigestIndex.decide

    def seen(self, part, batch):
        plans.append(self.exists())
        return decide(self, part, batch)

    monkeypatch.setattr(exact.DigestIndex, "decide", seen)
    same(exact.exact_dedup(small_batch(spark, rows), ranges=ranges).toPandas(), plain_exact(rows))
    assert plans == [False, *[True] * (ranges - 1)]  # later ranges meet the index


@pytest.mark.parametrize("fails_at", [2, 3])
def test_a_batch_that_failed_between_ranges_is_run_again(spark, monkeypatch, tmp_path, fails_at):
    rows = [(i, f"text {i % 11}") for i in range(30)] + [(None, "text 3"), (None, "alone"), (12, "text 1"), (12, "text 1"), (5, None)]
    docs, index = small_batch(spark, rows), exact.DigestIndex(spark, path=str(tmp_path / "index"), buckets=4)
    index.admit(small_batch(spark, [(99, "text 2")]), "before").collect()
    calls, decide = [], exact.DigestIndex.decide

    def failing(self, part, batch):
        calls.append(batch)
        if len(calls) == fails_at:
            raise RuntimeError("lost")
        return decide(self, part, batch)

    monkeypatch.setattr(exact.DigestIndex, "decide", failing)
    with pytest.raises(RuntimeError):
        exact.exact_dedup(docs, index, 3, "today")
    got = exact.exact_dedup(docs, index, 3, "today").toPandas()
    want = [(d, 99, n, False, h) if h == sha("text 2") else (d, k, n, kept, h) for d, k, n, kept, h in plain_exact(rows)]
    same(got, want)
    assert index.table().count() == len({t or "" for _, t in rows})
    assert not exact.exact_dedup(docs, index, 3, "tomorrow").where("kept").count()
    index.drop()
    assert not index.exists() and not (tmp_path / "index").exists()


def test_no_column_name_is_special(spark):
    own = spark.createDataFrame([(1, "x", "mine", 5, "k", "r"), (2, "x", "yours", 6, "l", "s")], "doc_id long, text string, _copy string, _kept_id long, key string, row string")
    for stays in (exact.keep_first_copies(own), neardup.keep_one_of_each(own)):
        assert stays.columns == own.columns
    assert tuple(exact.keep_first_copies(own).first()) == (2, "x", "yours", 6, "l", "s")
    assert tuple(neardup.keep_one_of_each(own).first()) == (1, "x", "mine", 5, "k", "r")


# ---- BPE ----------------------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("table", ["odd", "small", "none"])
def test_bpe_equals_the_library(table, request):
    docs, t, want = request.getfixturevalue(table), tokenizer(), []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False))))
    got = bpe.round_trip_report(docs, tokenizer_file()).toPandas()
    same(got[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]], want)


def test_encode_and_decode(odd):
    t = tokenizer()
    encoded = bpe.encode(odd, tokenizer_file())
    rows = {(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()}
    assert sorted(((r["doc_id"] or 0), r["ids"]) for r in encoded.collect()) == sorted(((r["doc_id"] or 0), t.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect())
    assert {(r["doc_id"], r["text"]) for r in bpe.decode(encoded, tokenizer_file()).collect()} == rows


def test_lexicon_finds_its_words_alone():
    words = sorted({w.encode() for w in ["a", "ab", "abc", "b", "stop", "top", "tops", "é"]})
    auto = lexicon.compile_words(words)
    assert lexicon.places_of(auto, words).tolist() == list(range(len(words)))
    assert (np.array(lexicon.places_of(auto, [b"abcd", b"sto", b"c", b"to"])) < 0).all()


# ---- toxicity -----------------------------------------------------------------------------------


def test_toxicity_grades(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_report(docs, labels).toPandas()
    assert len(got) == docs.count() and got.expected_severity.between(0, 2).all()
    truth = labels.toPandas().set_index("doc_id").toxic
    judged = got[got.doc_id.isin(truth.index)]
    hit = judged.toxic == (judged.doc_id.map(truth) > 0)
    assert hit.mean() > 0.9


def test_toxicity_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    got = toxicity.grade_toxicity(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").toPandas()
    assert ((got.p_toxic > 0.5) == (got.toxic > 0)).mean() > 0.9
    assert (np.diff(model.thresholds) > 0).all()


def test_severity_comes_from_other_folds():
    rng = np.random.default_rng(1)
    n, features = 400, 30
    toxic, fold = rng.integers(0, 2, n), rng.integers(0, toxicity.FOLDS, n)
    loud = toxic * rng.integers(1, 9, n)  # how many of the first ten features a toxic text has
    own = [np.concatenate([rng.permutation(10)[:k], 10 + rng.permutation(20)[:5]]) for k in loud]
    doc, feature = np.repeat(np.arange(n), [len(x) for x in own]), np.concatenate(own)
    value = np.ones(len(doc))
    scores = toxicity.cross_fitted(doc, feature, value, toxic, fold, features)
    changed = toxic.copy()
    changed[fold == 0] = 1 - changed[fold == 0]  # a fold's own labels do not reach its scores
    np.testing.assert_array_equal(toxicity.cross_fitted(doc, feature, value, changed, fold, features)[fold == 0], scores[fold == 0])
    grade = toxicity.severity_grades(scores, toxic, fold)
    assert set(grade[toxic == 0]) == {0} and set(grade[toxic == 1]) == {1, 2}
    assert loud[grade == 2].mean() > loud[grade == 1].mean() + 2
    alone = toxicity.cross_fitted(doc, feature, value, np.ones(n, int), fold, features)
    assert not alone.any() and set(toxicity.severity_grades(alone, np.ones(n, int), fold)) == {1}


def test_toxicity_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert toxicity.fit(odd, labels) is None
    got = toxicity.toxicity_report(odd, labels).toPandas()
    assert len(got) == len(odd_rows) and not got.toxic.any()
    assert toxicity.without_toxic(odd, None).count() == len(odd_rows)
    model = toxicity.OrdinalModel({"grain": 9.0}, np.array([1.0, 2.0]))
    stays = toxicity.without_toxic(odd, model)
    assert stays.columns == odd.columns and 0 < stays.count() < len(odd_rows)
    assert toxicity.toxicity_report(none, labels).count() == 0


# ---- fingerprints -------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["odd", "small", "none"])
def test_edits_follow_the_next_document(table, request):
    docs = request.getfixturevalue(table)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, near = [], []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((d, len(t), sha(edited)))
        near.append((t, edited, after))
    got = prints.fingerprint_edits(docs).toPandas()
    same(got[["doc_id", "n_chars", "edited_sha256"]], want)
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    if table == "small":
        assert got.near_edited.mean() > got.near_next.mean() + 0.2


def test_equal_texts_have_equal_fingerprints(odd):
    got = prints.fingerprint_documents(odd).join(odd.select("doc_id", "text"), "doc_id").toPandas()
    for _, group in got.assign(text=got.text.fillna("")).groupby("text"):
        assert group.fingerprint.nunique() == 1


def plain_print(text):
    """Length, whole hash and least span hashes by their definition, with Python's integers."""
    spans = lambda a, b: sum((ord(c) + 1) * pow(base, i, p) for i, c in enumerate(text[a:b])) % p
    both = []
    width = min(prints.SPAN, len(text))
    for k in range(len(text) - width + 1 if text else 0):
        h = 0
        for base, p in zip(prints.BASES, prints.MODULI):
            h = h << 31 | sum((ord(c) + 1) * pow(base, i, p) for i, c in enumerate(text[k : k + width])) % p
        m = (h ^ h >> 31) * 0x9E3779B97F4A7C15 % 2**64
        both.append((m ^ m >> 27) >> 64 - prints.BITS)
    return sorted(set(both))[: prints.SAMPLE]


def test_fingerprints_equal_plain_arithmetic(spark):
    texts = ["", "a", "ab" * 40, "naïve 😀 café, twice: naïve 😀 café", "the committee met in the old hall and talked for hours about grain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = frame(prints.fingerprint_edits(docs), "doc_id")
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sample, changed, following = (plain_print(t) for t in (text, edited, after))
        assert got.fingerprint[i].endswith("-" + "".join(f"{x:010x}" for x in sample))
        for other, words, found in ((changed, edited, got.near_edited[i]), (following, after, got.near_next[i])):
            least = sorted({*sample, *other})[: prints.SAMPLE]
            share = sum(x in sample and x in other for x in least) / len(least) if least else 1
            assert found == pytest.approx(1.0 if text == words else 2 * share / (1 + share))


def test_spans_and_extensions():
    a, b = (prints.PrefixHashes(prints.code_points(t)) for t in ("the same start, then one", "xx the same start, then two"))
    assert a.span(0, 10) == b.span(3, 13) and a.span(0, 10) != b.span(0, 10)
    assert a.extension(0, b, 3) == len("the same start, then ")
    assert a.extension(0, a, 0) == a.n
