"""Operators that compare texts with one another, and the pipeline: held against plain versions."""

import cProfile
import hashlib
import importlib
import pstats
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from held import same
from pyspark.sql import functions as F

from factorloom.llm import components, lines, neardup, packing, substrings
from factorloom.llm.common import BATCH_BYTES, map_batches, slices, written
from factorloom.llm.queries import tokenizer_file

sha = lambda b: hashlib.sha256(b).hexdigest()
TABLES = ["odd", "small", "none", "crafted"]


@pytest.fixture(scope="session")
def crafted(spark):
    """Short documents made of few passages and lines, so that all sorts of overlaps occur."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choice(words, 30)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.integers(1, 4)):
            own = passages[rng.integers(12)].split()
            if rng.random() < 0.5:
                own[rng.integers(len(own))] = f"n{rng.integers(1000)}"
            cut = rng.integers(0, 8) if rng.random() < 0.4 else 0
            parts.append(" ".join(own[cut:]))
        rows.append((int(i if i % 30 else 7), rng.choice(["\n", " "]).join(parts)))
    rows += [(200 + k, "ab" * (40 + k)) for k in range(8)] + [(300, "é" * 60), (301, "xé" * 30 + "é" * 50)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def order(d):
    return (d is not None, d or 0)


# ---- substrings ---------------------------------------------------------------------------------


def plain_repeats(rows):
    first = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            if s not in first or order(d) < order(first[s]):
                first[s] = d
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 49):
            if order(first[raw[i : i + 50]]) < order(d):
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((d, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), sha(kept)))
    return out


@pytest.mark.parametrize("table", TABLES)
def test_repeats_equal_all_windows(table, request):
    docs = request.getfixturevalue(table)
    same(substrings.repeat_report(docs).toPandas(), plain_repeats(rows_of(docs)))


def test_repeats_over_many_groups(crafted, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 1 << 10)
    same(substrings.repeat_report(crafted.repartition(9)).toPandas(), plain_repeats(rows_of(crafted)))


def test_repeats_in_several_passes_and_small_sorts(crafted, monkeypatch):
    """Windows beyond the texts' own bytes are compared in parts; the parts together are the whole."""
    monkeypatch.setattr(substrings, "WINDOW_BYTES", 6)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 1 << 10)
    same(substrings.repeat_report(crafted.repartition(3)).toPandas(), plain_repeats(rows_of(crafted)))


def test_packed_runs_stay_small():
    """A copy is one flag, whatever its runs; dealt to very many groups, runs keep under 25 bytes (36 before), and they come back as they were."""
    raw = np.random.default_rng(7).integers(32, 127, (40, 3000), np.uint8)
    found = [substrings.runs_of(r) for r in (*raw, raw[3])]
    rows, docs = np.random.default_rng(8).integers(-(2**62), 2**62, 41), np.array([substrings.LEAST_ID, *range(10, 50)])
    packed, flags = substrings.pack_block(rows, docs, found, 4)
    assert [tuple(map(int, f)) for f in flags] == [(rows[40], 0, 2951)]
    own = [substrings.unpack(pa.py_buffer(b)) for b in packed.values()]
    got = sorted((int(u["row"]), int(u["doc"]), int(r["low"])) for units, runs in own for u, r in zip(np.repeat(units, units["runs"]), runs, strict=True))
    assert got == sorted((int(rows[i]), int(docs[i]), int(low)) for i, f in enumerate(found[:40]) for low in f[2])
    # 500 groups of one run a row: the runs of each group's rows stand apart.
    apart = [tuple(c[:1] for c in substrings.runs_of(r)) for r in np.random.default_rng(9).integers(32, 127, (5000, 60), np.uint8)]
    packed, _ = substrings.pack_block(np.random.default_rng(1).integers(-(2**62), 2**62, 5000), np.arange(5000), apart, 4)
    assert sum(len(pa.compress(b, codec="lz4", asbytes=True)) for b in packed.values()) < 25 * 5000


def test_record_batches_have_bounded_bytes(spark):
    """A batch is held outside the heap and in the worker at once, so rows alone do not bound it."""
    wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("ten bytes "), 1000).alias("text"))
    sizes = map_batches(wide, lambda: lambda batch: pa.record_batch({"n": pa.array([batch.nbytes])}), "n long", 1 << 40).toPandas()["n"]
    assert sum(sizes) > 40e6 and max(sizes) < 1.25 * BATCH_BYTES


def test_slices_are_even():
    batch = pa.record_batch({"n": pa.array(range(1010))})
    assert [part.num_rows for part in slices(batch, 8 * 1000)] == [1010]  # no run of a few rows at the end
    assert [part.num_rows for part in slices(batch, 8 * 300)] == [337, 337, 336]


def test_shuffled_files_go_with_their_step(spark):
    blocks = lambda: sum("shuffle_" in str(b) for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()))
    before = blocks()
    written(spark.range(1000).repartition(4, "id"), "kept-files", free=True)
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before


def test_suffixes_come_out_sorted():
    raw = np.frombuffer(b"abracadabra" * 20, np.uint8)
    windows = np.arange(len(raw) - 49)
    got = substrings.SuffixSorter(raw).sort(windows, np.zeros(len(windows), np.int64))
    strings = [raw[w : w + 50].tobytes() for w in windows[got]]
    assert strings == sorted(strings)


# ---- lines --------------------------------------------------------------------------------------


def plain_lines(rows):
    places = []
    for d, t in rows:
        for i, line in enumerate((t or "").encode().split(b"\n")):
            places.append(((order(d), i), frozenset(line.lower().split())))
    first = {}
    for at, s in places:
        if s and (s not in first or at < first[s]):
            first[s] = at
    gone = {}
    for s in first:
        similar = [o for o in first if 100 * len(s & o) >= 80 * len(s | o)]
        gone[s] = min(first[o] for o in similar)
    out = []
    for d, t in rows:
        own = (t or "").encode().split(b"\n")
        keep = [line for i, line in enumerate(own) if not (s := frozenset(line.lower().split())) or not gone[s] < (order(d), i)]
        out.append((d, len(own), len(own) - len(keep), sha(b"\n".join(keep))))
    return out


@pytest.mark.parametrize("table", TABLES)
def test_lines_equal_all_pairs(table, request):
    docs = request.getfixturevalue(table)
    same(lines.line_report(docs).toPandas(), plain_lines(rows_of(docs)))


def test_lines_over_many_groups(crafted, monkeypatch):
    monkeypatch.setattr(lines, "GROUP_BYTES", 1 << 11)
    same(lines.line_report(crafted.repartition(9)).toPandas(), plain_lines(rows_of(crafted)))


@pytest.mark.parametrize("way", ["common words", "texts joined"])
def test_lines_of_common_words_and_many_sets(crafted, monkeypatch, way):
    monkeypatch.setattr(lines, *(("COMMON", 3) if way == "common words" else ("BROADCAST", 0)))
    monkeypatch.setattr(lines, "BLOCK", 4)
    same(lines.line_report(crafted).toPandas(), plain_lines(rows_of(crafted)))


def test_words_of_one_set_cost_no_step_each():
    """Most words of a group are in one set; candidates() once took a step in Python for each of them."""
    rows = np.zeros(30_004, lines.PREFIX)
    rows["word"], rows["line"], rows["doc"], rows["size"] = np.arange(len(rows)), np.arange(1, len(rows) + 1), np.arange(len(rows)), 1
    rows["word"][-2:] = rows["word"][:2]
    halves = [lines.packed_rows(half) for half in (rows[:20_000], rows[20_000:])]
    with cProfile.Profile() as calls:
        found = lines.candidates(pa.table({"group": pa.array([0, 0], pa.int32()), "blob": pa.array(halves, pa.binary())}), 80)
    assert found.select(["later", "earlier"]).to_pylist() == [{"later": 30_003, "earlier": 1}, {"later": 30_004, "earlier": 2}]
    assert pstats.Stats(calls).total_calls < 3000


def test_lines_are_removed(crafted):
    want = {}
    for d, n, gone, digest in plain_lines(rows_of(crafted)):
        want.setdefault((d, digest), []).append(n - gone)
    got = [(r["doc_id"], r["text"]) for r in lines.without_late_lines(crafted).collect()]
    assert len(got) == crafted.count() and all((d, sha(t.encode())) in want for d, t in got)


def test_words_are_those_of_bytes():
    texts = [" a\tB\x0bc\x0cd \x1ce\u00a0f\r\n\nX x\n", "", "\u00c9t\u00c9 A"]
    sets = lines.LineSets(pa.array(texts))
    want = [frozenset(lines.words_of(line)) for t in texts for line in t.encode().split(b"\n")]
    assert sets.lines.tolist() == [4, 1, 1] and [sets.size[i] for i in sets.of_line] == [len(w) for w in want]


# ---- near copies --------------------------------------------------------------------------------


def plain_near(rows, width):
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        w = min(width, len(words))
        sets.append(frozenset(tuple(words[i : i + w]) for i in range(len(words) - w + 1)) if words else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and (find(i) not in least or d < least[find(i)]):
            least[find(i)] = d
    return [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize("width", [4, 5])
def test_near_copies_equal_all_pairs(table, width, request):
    docs = request.getfixturevalue(table)
    same(neardup.near_dedup(docs, width=width).toPandas(), plain_near(rows_of(docs), width))


@pytest.mark.parametrize("table", ["odd", "small", "none"])
def test_one_of_each_stays(table, request):
    docs = request.getfixturevalue(table)
    stays = neardup.keep_one_of_each(docs)
    rows = list(dict.fromkeys(rows_of(docs)))
    want = {(d, t) for (d, t), (*_, kept) in zip(rows, plain_near(rows, 5), strict=True) if kept or d is None and kept}
    assert stays.columns == docs.columns
    same(stays.select("doc_id", "text").toPandas(), list(want))


def test_shingles_of_a_batch_are_those_of_each_text():
    texts = ["", " ", "a", "A b\tc", " x y  z w ", "a b c d e a b c d e", "\n", "\u00c9 \u00e9 X", "q w e r t y\x1cu i", "a"]
    shingles, sizes = neardup.shingle_arrays(pa.array(texts), 4)
    want = [n for _, n, *_ in plain_near(list(enumerate(texts)), 4)]
    assert sizes.tolist() == want and len(shingles) == sum(want)
    alone = [neardup.shingle_arrays(pa.array([t]), 4)[0].tolist() for t in texts]
    assert shingles.tolist() == [h for own in alone for h in own] and all(own == sorted(set(own)) for own in alone)
    keys = neardup.keys_of(shingles, sizes, 3)
    assert keys.tolist() == [row for own in alone for row in neardup.keys_of(np.array(own, np.uint64), np.array([len(own)])).tolist()]


def test_a_large_component_does_not_meet_itself(spark):
    rows = [(node, 0 if node < 100 else node, token, 0) for node in range(102) for token in range(5)]
    one, two = neardup.sides(spark.createDataFrame(rows, "node long, root long, token long, major long"))
    assert one.join(two, one["token_a"] == two["token_b"]).count() == 5 * 2 * 102


def test_cross_component_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 10**6, 60) for _ in range(3)]
    sets = [sorted({int(h) for h in np.where(rng.random(60) < rng.choice([0, 0.05, 0.15]), rng.integers(0, 10**6, 60), base[i % 3])}) for i in range(90)]
    roots = [int(r) for r in rng.choice([0, 0, 0, 1, 2, 3], 90)]
    left = spark.createDataFrame(list(enumerate(roots)), "node long, root long")
    table = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    found = neardup.confirmed(neardup.cross_component_pairs(left, table, 80), table, 80).collect()
    a = [set(x) for x in sets]
    want = {(i, j) for j in range(90) for i in range(j) if roots[i] != roots[j] and 100 * len(a[i] & a[j]) >= 80 * len(a[i] | a[j])}
    assert len(want) > 20 and sorted(map(tuple, found)) == sorted(want)


def test_sets_near_a_large_component_make_few_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**62, 400)
    copy = lambda share: [int(h) for h in np.where(rng.random(400) < share, rng.integers(0, 2**62, 400), base)]
    sets = [sorted(copy(0.04)) for _ in range(60)] + [sorted(copy(0.15)) for _ in range(30)]
    roots = [0] * 60 + list(range(60, 90))
    left = spark.createDataFrame(list(enumerate(roots)), "node long, root long")
    table = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    pairs = set(map(tuple, neardup.cross_component_pairs(left, table, 80).collect()))
    a = [set(x) for x in sets]
    links = {(i, j) for j in range(90) for i in range(j) if roots[i] != roots[j] and 100 * len(a[i] & a[j]) >= 80 * len(a[i] | a[j])}
    assert links <= pairs and len(pairs) < 100 + len(links)


def test_documents_without_an_id_of_their_own_stay(spark):
    rng = np.random.default_rng(11)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 5000, 60))
    clean, shared, twin = [text() for _ in range(12)], [text(), text()], text()
    rows = [(None, t) for t in clean] + [(7, t) for t in shared] + [(None, None), (None, ""), (None, " ")]
    near = [(9, twin), (3, twin + " end"), (3, text()), (None, twin + " too"), (None, twin)]
    repeats = [(None, clean[0]), (7, shared[1])]
    stays = neardup.keep_one_of_each(spark.createDataFrame(rows + near + repeats, "doc_id long, text string").repartition(3))
    same(stays.toPandas(), rows + near[1:3])


def test_components_end_when_stars_are_left(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(components, "written", lambda df, name: steps.append(name) or written(df, name))
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame([(1, 2), (1, 3), (4, 1), (9, 8)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} and len(steps) == 5


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= (root[a], root[b]) != (low, low)
            root[a] = root[b] = low
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


# ---- packing ------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["odd", "small", "none"])
def test_packing(table, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    t = Tokenizer.from_file(tokenizer_file())
    t.no_truncation()
    t.no_padding()
    want = Counter()
    for d, text in rows_of(docs):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) - 1024 * ((len(ids) - 1) // 1024)
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(ids[a:b])] += 1
    got = packing.pack_documents(docs, tokenizer_file()).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert_packed(got)


def assert_packed(rows):
    """Sequences are gapless, none is over the capacity, and best-fit decreasing would need no fewer."""
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    counts = [0] * 1025
    for r in rows:
        counts[r["length"]] += 1
    assert packing.lower_bound(counts, 1024) <= len(bins) <= sum(n for _, n in packing.best_fit_decreasing(counts, 1024))


def test_completion_finds_what_best_fit_misses():
    counts = [0] * 11
    for size in (6, 5, 5, 4, 3, 3, 2, 2):
        counts[size] += 1
    assert sum(n for _, n in packing.bin_completion(counts, 10)) == 3
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = [0, *rng.integers(0, 6, 10).tolist()]
        found = packing.bin_completion(counts, 10)
        placed = Counter(s for f, n in found for s in f for _ in range(n))
        assert all(placed[s] == counts[s] for s in range(1, 11)) and all(sum(f) <= 10 for f, _ in found)
        assert sum(n for _, n in found) <= packing.lower_bound(counts, 10) + 1


def fewest_bins(pieces, capacity):
    """By trying every bin for every piece."""
    best = [len(pieces)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= pieces[i]:
                rest = list(bins)
                rest[rest.index(room)] -= pieces[i]
                place(i + 1, rest)
        place(i + 1, [*bins, capacity - pieces[i]])

    place(0, [])
    return best[0]


def test_completion_needs_as_few_bins_as_any():
    rng = np.random.default_rng(8)
    for capacity in (12, 17, 30):
        for _ in range(25):
            pieces = sorted(rng.integers(2, capacity, rng.integers(4, 10)).tolist(), reverse=True)
            counts = [pieces.count(s) for s in range(capacity + 1)]
            assert sum(n for _, n in packing.bin_completion(counts, capacity, 10**6)) == fewest_bins(pieces, capacity)


def test_fillings_leave_out_only_dominated_ones():
    counts = [0, 2, 2, 1, 0, 1, 0, 1]
    assert list(packing.fillings(counts, 4)) == [(3, 1), (2, 2), (3,)]  # not (2, 1, 1): a 3 could stand for 2 and 1


def test_packing_keeps_columns_of_any_name(spark):
    pieces = spark.createDataFrame([(i, 300, None, "p", i) for i in range(7)] + [(0, 300, None, "p", 0)], "piece long, length long, part string, row string, low long")
    got = packing.pack(pieces)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"] and len({r["sequence_id"] for r in got.collect()}) == 3
    same(got.select(*pieces.columns).toPandas(), [tuple(r) for r in pieces.collect()])


# ---- the pipeline -------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from factorloom.llm import toxicity
    from test_single_texts import plain_exact

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {}
    now = docs
    for name, stage in pipeline.STAGES:
        now = got[name] = stage(spark, now, sf).cache()
        assert name == "packing" or now.columns == docs.columns
    clean = toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    same(got["toxicity"].select("doc_id", "text").toPandas(), rows_of(clean))
    rows = rows_of(got["toxicity"])
    keep = {d for d, _, _, kept, _ in plain_exact(rows) if kept}
    rows = [r for r in rows if r[0] in keep]
    same(got["exact_dedup"].select("doc_id", "text").toPandas(), rows)
    rows = [r for r, (*_, kept) in zip(rows, plain_near(rows, 5), strict=True) if kept]
    same(got["near_dedup"].select("doc_id", "text").toPandas(), rows)
    assert sorted(r["doc_id"] for r in got["secret_scan"].collect()) == sorted(d for d, _ in rows)
    assert {r["doc_id"] for r in got["packing"].collect()} == {d for d, _ in rows}
    assert_packed(got["packing"].collect())
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is pipeline.run


def test_pipeline_of_nothing_and_of_odd_rows(spark, none, odd):
    import corpus_pipeline as pipeline

    for docs in (none, odd):
        now = docs
        for name, stage in pipeline.STAGES:
            now = stage(spark, now, "/root/testdata/sf0.001").cache()
            assert name == "packing" or now.columns == docs.columns
        assert (now.count() > 0) == (docs is odd)
