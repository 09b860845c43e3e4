"""Token files, centroid clustering and fill-in-middle: held against the library, all comparisons and plain cutting."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from held import frame, same
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factorloom.llm import centroids, middles, tokenfile
from factorloom.llm.queries import tokenizer_file

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
WORDS = tokenizer_file("word_bpe_49k.json")


# ---- token files --------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 1, 5, 49407, 2**20, 2**30, 2**59, 2**60 - 1, 2**60, 2**64 - 1]), st.integers(1, 150)), max_size=12), st.sampled_from([1, 7, 64, 1024]))
def test_packed_ids_come_back(runs, block):
    ids = np.array([x for x, n in runs for _ in range(n)], np.uint64)
    packed = tokenfile.Packed(tokenfile.pack(ids, block))
    assert packed.n == len(ids) and (packed.all() == ids).all()
    for start, end in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))):
        assert (packed.span(start, end) == ids[start:end]).all()


def test_packing_takes_few_words():
    assert len(tokenfile.Packed(tokenfile.pack(np.zeros(5000, np.uint64), 5000)).words) == 1
    assert len(tokenfile.Packed(tokenfile.pack(np.full(600, 1, np.uint64))).words) == 10
    assert len(tokenfile.Packed(tokenfile.pack(np.full(900, 30000, np.uint64))).words) == 225
    rng = np.random.default_rng(0)
    wide = rng.integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2)
    assert (tokenfile.Packed(tokenfile.pack(wide, 16)).all() == wide).all()


def plain_tokens(rows):
    """(doc_id, start, n_tokens, ids) in order, by the library over whole texts."""
    tokenizer = Tokenizer.from_file(WORDS)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), ids))
        start += len(ids)
    return out


def test_token_report_equals_the_library(spark, small, small_rows):
    want = plain_tokens(sorted((d, t) for d, t, _ in small_rows))
    same(tokenfile.token_report(small, WORDS).toPandas(), [(d, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, s, n, ids in want])


def test_token_files_of_odd_rows(spark, odd, odd_rows, none, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(odd, WORDS, path, segment=300)
    got = sorted((tuple(r) for r in tokenfile.read_tokens(spark, path).collect()), key=lambda r: r[1])
    want = plain_tokens([r[:2] for r in odd_rows])
    assert sorted((str(d), n, ids) for d, _, n, ids in got) == sorted((str(d), n, ids) for d, _, n, ids in want)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    ids = [r[0] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    stored = spark.read.parquet(path)
    assert stored.where("n_ids > 300 and size(doc_ids) > 1").count() == 0 and stored.count() > 5
    assert tokenfile.token_report(none, WORDS).count() == 0


def test_words_are_encoded_as_whole_texts_are():
    texts = ["a\x1cb\x85c\xa0d e", "ΑΣ ΑΣΑ ΌΣΟΣ İx ǅ", "é ́x  ỵ̇", "don't I'LL '", "<|endoftext|> x<|startoftext|>y < |endoftext|>", "٣٤ ½ 漢字かな 😀😀 ‍", "x" * 3000, " a　b", "Å Å ﬁ ẞ"]
    texts += ["".join(map(chr, range(33, 127))) * 2, "it's I'LL 12a3'd ''s don't..\x1d'x A\x7fb c\x00d", "x1" * 2000, "<|ENDOFTEXT|>", "a<|endoftext|>9", "".join(map(chr, range(0xA0, 0x180))), "ÀÉ'S ŒUVRE İĲ ª²³¼ ¿qué? d'été ß"]
    texts += ["", " ", " a ", "\n\n"]
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    encoder = tokenfile.WordEncoder(WORDS)
    for _ in range(2):
        ids, sizes = encoder.encode(pa.array(texts))
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 0]
    with pytest.raises(ValueError):
        tokenfile.WordEncoder(tokenizer_file())


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 2)
    encoder = tokenfile.WordEncoder(WORDS)
    first = [encoder.encode(pa.array([t]))[0].tolist() for t in ("a b c", "d e", "a b c")]
    assert first[0] == first[2] and len(encoder.pieces) <= 2


def test_only_words_of_several_pieces_are_cut(monkeypatch):
    encoder, cut = tokenfile.WordEncoder(WORDS), []
    replace = tokenfile.pc.replace_substring_regex
    monkeypatch.setattr(tokenfile.pc, "replace_substring_regex", lambda words, *rest: cut.extend(words.to_pylist()) or replace(words, *rest))
    encoder.encode(pa.array(["Plain words don't need it", "caf\u00e9 12 end. \u6f22\u5b57"]))
    assert sorted(set(cut)) == ["12", "don't", "end."]


def test_blocks_are_walked_side_by_side():
    rng = np.random.default_rng(3)
    for n, block in ((0, 4), (1, 4), (1000, 64), (1000, 1024), (65, 64)):
        room = np.minimum(block - np.arange(n) % block, n - np.arange(n))
        step, want, at = np.minimum(rng.integers(1, 9, n), room), [], 0
        while at < n:
            want.append(at)
            at += int(step[at])
        assert tokenfile.walked(step, block).tolist() == want


# ---- centroid clustering ------------------------------------------------------------------------


def plain_clusters(rows, k, rounds=5, dims=64):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((r for r in kept), key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1]))
    at = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, o, d in found if o == j) for j in range(len(at))}
    return [(i, o, d, inertia[o], sum(inertia.values()), sha(",".join(map(str, at[o])))) for i, o, d in found]


def test_clusters_equal_all_comparisons(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    same(centroids.cluster_report(table).toPandas(), plain_clusters([(r["vec_id"], r["embedding"]) for r in table.collect()], 40))


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vec = lambda: (rng.integers(-3, 4, 64) / 256).tolist()
    one = vec()
    rows = [(i, vec()) for i in range(40)] + [(100 + i, one) for i in range(30)] + [(7, one), (None, one), (None, vec()), (50, None), (51, []), (52, one[:63]), (53, [*one[:63], None]), (54, [*one[:63], float("nan")]), (55, [*one[:63], float("inf")]), (56, one + [1.0])]
    schema = "vec_id long, embedding array<double>, label int, cluster int, v int, distance string"
    table = spark.createDataFrame([(i, v, None, 1, 2, "x") for i, v in rows], schema)
    same(centroids.cluster_report(table, k=9).toPandas(), plain_clusters(rows, 9))
    same(centroids.cluster_report(table.where("vec_id < 3"), k=9).toPandas(), plain_clusters(rows[:3], 9))
    assert centroids.cluster_report(spark.createDataFrame([], schema)).count() == 0
    assert centroids.cluster_report(table.where("vec_id between 50 and 56")).count() == 0
    wide = [(i, (np.array(vec()) * 2.0**15).tolist()) for i in range(30)]  # sums beyond 2^53: integers all the way
    same(centroids.cluster_report(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), k=4).toPandas(), plain_clusters(wide, 4))
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_report(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).count()


def test_bounds_spare_most_comparisons(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 64)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=64) * 0.1).tolist()) for i in range(400)]
    vectors = centroids.scaled_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    state, _ = centroids.cluster(vectors, np.array([np.floor(256 * c) for c in centres], np.int64))
    assert state.agg({"full_scans": "max"}).first()[0] == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_assignment_by_bounds_is_exact(seed):
    rng = np.random.default_rng(seed)
    x, at = rng.integers(-6, 7, (80, 3)), rng.integers(-6, 7, (7, 3))
    now = centroids.Centroids(at)
    own, distance, lower = now.scan(x)
    upper = np.sqrt(distance.astype(float)) * (1 + centroids.SLACK)
    for _ in range(4):
        at = at + rng.integers(-1, 2, at.shape)
        now = centroids.Centroids(at, now.at)
        own, upper, lower, distance, _ = now.assign(x, own, upper, lower)
        every = ((x[:, None] - at[None]) ** 2).sum(axis=2)
        assert (own == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


# ---- fill-in-middle -----------------------------------------------------------------------------

PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^\t-\r ]*[\t-\r ]+|[^\t-\r ]+", "chars": r"[\s\S]"}


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t😀é", max_size=40), st.sampled_from(sorted(PATTERNS)))
def test_runs_know_the_end_of_each_unit(text, kind):
    units = re.findall(PATTERNS[kind], text)
    runs = middles.Runs(middles.code_points(text), middles.UNITS[kind])
    assert runs.units == len(units) and "".join(units) == text
    assert [runs.end_of(i) for i in range(len(units) + 1)] == np.cumsum([0, *map(len, units)]).tolist()


def plain_middle(doc_id, text):
    text = text or ""
    lines = re.findall(PATTERNS["lines"], text)
    h = sha(f"7:{'null' if doc_id is None else doc_id}")
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(lines), "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = ("".join(part) for part in (lines[:low], lines[low:high], lines[high:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    return doc_id, len(lines), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_middles_equal_plain_cutting(spark, small, small_rows, odd, odd_rows, none):
    same(frame(middles.middle_report(small)), [plain_middle(d, t) for d, t, _ in small_rows])
    same(frame(middles.middle_report(odd)), [plain_middle(*r[:2]) for r in odd_rows])
    assert middles.middle_report(none).count() == 0
    marked = [(1, "has <P> in it"), (2, "ends in <"), (3, "<\nS>\n<\nM>\n"), (4, "P>S>M>\n<<<")]
    same(frame(middles.middle_report(spark.createDataFrame(marked, "doc_id long, text string"))), [plain_middle(*r) for r in marked])


def test_shares_units_and_bad_marks(spark, small, small_rows):
    plan = middles.Plan(units="words", prefix="<<pre>>", suffix="<<suf>>", middle="<<mid>>", transformed=50, suffix_first=0)
    out = middles.restore(middles.fill_in_middle(small, plan).withColumn("restored", middles.F.lit(0)), plan).toPandas()
    texts = {d: t or "" for d, t, _ in small_rows}
    assert (out.restored == out.doc_id.map(texts)).all() and set(out.form) == {"plain", "psm"} and 0.3 < (out.form == "psm").mean() < 0.7
    for bad in ({"prefix": ""}, {"prefix": "aba"}, {"prefix": "<S>"}, {"middle": "x<S>"}, {"units": "pages"}):
        with pytest.raises(ValueError):
            middles.Plan(**bad)
