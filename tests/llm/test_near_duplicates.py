from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelsight.llm import line_dedup, ngram_join, setjoin
from reelsight.llm.common import build_bloom, connected_components, in_bloom


def brute(texts, of, percent=75):
    """Component (index of the smallest member) of each text by comparing all pairs."""
    sets, up = [of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], sets


def shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def check_documents(docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    component, sets = brute([r.text for r in rows], shingles)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if component[j] == component[i] and rows[j].doc_id is not None]
        want.append((r.doc_id, len(sets[i]), min(ids, default=None) if sets[i] else r.doc_id))
    got = [tuple(r) for r in ngram_join.ngram_components(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_documents_equal_brute_force(odd_docs):
    check_documents(odd_docs)


def test_given_documents_equal_brute_force(some_docs):
    check_documents(some_docs)


def test_large_group_of_near_copies_and_common_passage(spark):
    draw = np.random.default_rng(2)
    base = [f"b{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(12)]
    texts = []
    for i in range(150):
        w = list(base)
        w[int(draw.integers(60))] = f"n{i}"
        texts.append(" ".join(w))
    for i in range(150):
        texts.append(" ".join([f"q{i}x{j}" for j in range(30)] + passage))
    check_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))


def test_chunks_of_large_components_lose_no_link(spark):
    draw = np.random.default_rng(3)
    base = set(range(1000, 1040))
    sets = []
    for i in range(120):
        s = set(base)
        for x in draw.choice(sorted(base), int(draw.integers(0, 9)), replace=False):
            s.discard(int(x))
        s |= {int(x) for x in draw.integers(10_000, 10_020, int(draw.integers(0, 6)))}
        sets.append(s)
    rows = [(i.to_bytes(4, "big"), 0, len(s), np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)]
    members = spark.createDataFrame([(bytearray(a), b, c, bytearray(d)) for a, b, c, d in rows],
                                    "node binary, component long, size long, payload binary")
    want, _ = brute(list(range(120)), lambda i: sets[i])
    for chunk in (1 << 20, 4_000):
        links = setjoin.linked(members, lambda p: np.frombuffer(p, np.uint64), 75, chunk_bytes=chunk)
        got = {int.from_bytes(r.node, "big"): int.from_bytes(r.component, "big")
               for r in connected_components(links).collect()}
        assert [got.get(i, i) for i in range(120)] == want


def test_one_document_of_each_group_stays(odd_docs):
    kept = ngram_join.keep_one_per_component(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == [1, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15]


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base), (1, "something else entirely is written in this row of the table"), (2, base), (3, None), (3, None),
            (4, ""), (4, base + " thirteen"), (None, base), (5, "a text that stands alone among all of these others")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, size int")
    kept = sorted(map(tuple, ngram_join.keep_one_per_component(docs).collect()), key=str)
    assert kept == sorted([(*r, 7) for r in rows if r not in ((2, base), (4, base + " thirteen"))], key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_packed_entries_come_back(n):
    rng = np.random.default_rng(n)
    hashes = np.sort(rng.integers(0, 2**64, n, np.uint64))      # the low 48 bits wrap around
    entries = (hashes << np.uint64(16)) | rng.integers(0, 2**16, n, np.uint64)
    assert ngram_join._from_steps(ngram_join._steps(entries)).tolist() == entries.tolist()
    for kind in (np.uint16, np.uint32, np.uint64):
        numbers = rng.integers(0, np.iinfo(kind).max, n, kind, endpoint=True)
        assert ngram_join.from_planes(ngram_join.planes(numbers), kind).tolist() == numbers.tolist()


def test_shared_shingles_sort_by_rarity():
    rare = ngram_join._rarity(np.array([2, 3, 5, 1000, 2**32]))
    assert rare.tolist() == sorted(rare.tolist()) and rare[0] < rare[1] < rare[2] and rare[-1] == 255
    codes = (rare << np.uint64(24) | np.uint64(7)).astype(np.uint32)
    far = ngram_join._numbered(codes, 2**31 - 1)
    near = ngram_join._numbered(codes, 0)
    assert (np.diff(far.astype(object)) > 0).all() and len(set(far.tolist()) | set(near.tolist())) == 10
    assert near.max() > far[0]           # rarity goes before the bucket


def test_empty_tables(no_docs):
    assert ngram_join.ngram_components(no_docs).count() == 0
    assert line_dedup.line_components(no_docs).count() == 0
    assert line_dedup.drop_repeated_lines(no_docs).count() == 0


# ------------------------------------------------------------------ lines

def line_shingles(line):
    k = line_dedup.SHINGLE_CHARS
    return frozenset(line[i:i + k] for i in range(max(1, len(line) - k + 1)))


def line_rows(docs):
    return [(r.doc_id, i, x) for r in docs.collect() for i, x in enumerate((r.text or "").split("\n"))
            if x.strip(" \t\n\r\x0b\x0c")]


def test_lines_equal_brute_force(odd_docs):
    docs = odd_docs.where("doc_id is null or doc_id not in (9, 10)")     # the long ones: slow by brute force
    rows = sorted(line_rows(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    component, _ = brute([x for _, _, x in rows], line_shingles)
    want = [(i, n, *rows[c][:2], component.count(c)) for (i, n, _), c in zip(rows, component)]
    got = [(r.doc_id, r.line_no, r.of_doc_id, r.of_line_no, r.lines) for r in line_dedup.line_components(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_given_lines_reach_recall(some_docs):
    """Every reported pair is in a brute-force component; nearly every brute-force link is found."""
    rows = sorted(line_rows(some_docs))
    by_gram = defaultdict(set)
    texts = sorted({x for _, _, x in rows})
    sets = [line_shingles(x) for x in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            by_gram[g].add(i)
    for i, s in enumerate(sets):
        near = defaultdict(int)
        for g in s:
            for j in by_gram[g]:
                near[j] += j < i
        for j, both in near.items():
            if both and 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    place = {t: find(i) for i, t in enumerate(texts)}
    first = {}
    for i, n, x in rows:
        first.setdefault(place[x], (i, n))
    got = {(r.doc_id, r.line_no): (r.of_doc_id, r.of_line_no) for r in line_dedup.line_components(some_docs).collect()}
    assert set(got) == {(i, n) for i, n, _ in rows}
    text_of = {(i, n): x for i, n, x in rows}
    assert all(place[text_of[k]] == place[text_of[v]] for k, v in got.items())
    assert sum(got[i, n] == first[place[x]] for i, n, x in rows) >= 0.97 * len(rows)


def test_lines_are_dropped_once(odd_docs):
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(odd_docs).where("doc_id >= 14").collect()}
    assert out[14] == "line one is here and long enough\n\nline two is here and long enough\nshort"
    assert out[15] == "other words entirely"
    assert line_dedup.drop_repeated_lines(odd_docs).columns == odd_docs.columns


# ------------------------------------------------------------------ helpers

def test_bloom_holds_every_member(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    bits = build_bloom(keys)
    inside = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    assert in_bloom(bits, inside).all()
    assert in_bloom(bits, inside + np.uint64(1)).mean() < 0.01


@pytest.mark.parametrize("parts", [1, 5])
def test_components_of_paths_stars_and_cycles(spark, parts):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (202, 201), (200, 202)]
    edges += [(5, 5), (300, None)]
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200 + i: 200 for i in range(3)}


def test_a_line_is_measured_as_in_a_batch():
    lines = ["a", "short", "12345678", "the same the same the same the same", "Été à la mer 你好 world", "x" * 40_000, "\x00\x01 y"]
    hashes, counts = line_dedup.char_shingles(lines)
    each = np.split(hashes, np.cumsum(counts)[:-1])
    for line, own in zip(lines, each):
        assert line_dedup._elements(line.encode()).tolist() == sorted(set(own.tolist()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array([x.encode() for x in lines], pa.binary())],
                                       names=["component", "payload"])
    sized, = line_dedup._sized([batch])
    assert sized.column("size").to_pylist() == [len(set(x.tolist())) for x in each]


def test_signatures_are_minima_of_each_line():
    lines = ["a", "the quick brown fox jumps", "y" * 3, "z0" * 20_000, "over the lazy dog and on"] * 3
    bands = line_dedup.signatures(lines)
    for line, got in zip(lines, bands):
        words = (line_dedup.char_shingles([line])[0] >> np.uint64(32)).astype(np.uint32)
        for b in range(line_dedup.BANDS):
            value = np.full(1, b + 1, np.uint64)
            for k in range(b * line_dedup.ROWS, (b + 1) * line_dedup.ROWS):
                value = line_dedup.mix64(value * np.uint64(0x9E3779B97F4A7C15)
                                         + (words * line_dedup._TIMES[k] + line_dedup._PLUS[k]).min())
            assert value[0] == got[b]
