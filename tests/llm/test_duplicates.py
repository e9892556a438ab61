import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, prose
from tidemark.llm import components, minhash, suffix_dedup


def near_rows(seed=5):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = prose(rng, 120).split()
        for k in range(8):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, 6, 10])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((i, " ".join(w).upper() if k == 3 else " ".join(w)))
            i += 1
    return rows


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split() if (t or "").isascii() else (t or "").split()
        n = min(width, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {rows[k][0]: (len(sets[k]), rows[find(k)][0]) for k in range(len(rows))}


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark, docs, width, 80).collect()}
    assert got == brute(rows, width, 80)


def test_a_large_group_of_near_copies(spark):
    """Some near the first, some only near each other, exact copies among them."""
    rng = random.Random(31)
    base, pool, rows = prose(rng, 100).split(), [prose(rng, 1) for _ in range(40)], []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(100)] = rng.choice(pool) if i % 2 else prose(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[7][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark, docs, 2, 80).collect()}
    assert got == brute(rows, 2, 80) and len({c for _, c in got.values()}) > 1


def test_exact_join_alone_finds_every_link(spark):
    """The last step, given every document as a component of its own in one bucket."""
    from pyspark.sql import functions as F

    rows = near_rows(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    open_ = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root"))
    pairs = {(r["a"], r["b"]) for r in minhash._across(spark, docs, open_, 2, 80)[0].collect()}
    sets = {i: set(zip(t.lower().split(), t.lower().split()[1:], strict=False)) for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links and links <= pairs


def test_awkward_rows(spark):
    got = minhash.near_duplicates(spark, awkward(spark), 2, 80).collect()
    assert len(got) == 18
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == by[13]["component_id"] == 1
    assert by[4]["n_shingles"] == 0 and by[4]["component_id"] == 4 and by[5]["component_id"] == 5
    assert by[6]["n_shingles"] == 1 and by[7]["component_id"] == 6
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(spark, awkward(spark).limit(0), 2, 80).count() == 0


def test_estimate_is_near_the_truth(spark):
    rng = np.random.default_rng(1)
    both, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    a, b = (minhash.signature(np.unique(np.concatenate([both, x]))) for x in (one, two))
    pack = lambda s: ((s & 15).astype(np.uint64).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(pack(a), pack(b))], "a array<long>, b array<long>")
    assert abs(df.select(minhash.estimate("a", "b").alias("e")).first()["e"] - 0.8) < 0.12


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["vertex"]: r["root"] for r in components.contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def removal(rows):
    """Windows of 100 bytes that start earlier, by plain code."""
    order, seen, out = sorted({(d, t) for d, t in rows}), set(), {}
    for d, t in order:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d, t] = (len(data), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_removal_equals_brute_force(spark, hot):
    rng = random.Random(9)
    passage, rows = prose(rng, 40), []
    for i in range(25):
        t = prose(rng, rng.randint(5, 60))
        if i % 2:
            t = t[: len(t) // 2] + " " + passage[rng.randint(0, 60) :] + t[len(t) // 2 :]
        if i % 5 == 0:
            t += " né" * 90
        rows.append((i, t))
    rows += [(30, rows[3][1]), (31, "Wher. " * 80), (32, "x" * 99), (33, "x" * 100), (34, "x" * 101), (35, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"]): (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removal_report(spark, docs, hot).collect()}
    assert got == {d: v for (d, _), v in removal(rows).items()}


def test_radix_passes_find_exactly_equal_windows():
    rng = np.random.default_rng(2)
    raw = np.concatenate([rng.integers(97, 99, 3000), np.tile(rng.integers(97, 99, 150), 3)]).astype(np.uint8)
    start = np.arange(len(raw) - 99)
    got = suffix_dedup.radix_repeats(raw, start, np.zeros(len(start), np.int64))
    seen, want = set(), []
    for s in start:
        w = raw[s : s + 100].tobytes()
        want.append(w in seen)
        seen.add(w)
    assert got.tolist() == want


def test_long_texts_are_cut_into_stretches_without_loss(monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(chr(c) for c in rng.integers(97, 123, 5000))
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    whole = [x for r, p, at, b in suffix_dedup._texts(batch) for x in [(p.tobytes(), b)]]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 600)
    parts = list(suffix_dedup._texts(batch))
    assert len(whole) == 1 and len(parts) > 1
    windows = {b + s for _, p, _, b in parts for s in range(len(p) - 99)}
    assert windows == set(range(len(text) - 99))


def test_repeats_of_awkward_rows(spark):
    out = suffix_dedup.remove_repeats(spark, awkward(spark))
    assert out.columns == awkward(spark).columns and out.count() == 18
    by = {(r["doc_id"], r["text"] is None): r for r in out.collect()}
    assert by[2, False]["text"] == "" and by[1, False]["text"] and by[4, True]["runs"] == "x"
    assert suffix_dedup.removal_report(spark, awkward(spark).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_rows_are_no_repeats_of_themselves(spark, hot, parts):
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (None, b), (None, b), (2, c), (2, d), (3, c + " end"), (3, c + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    want = {(i, len(t)): 0 if t in (a, b, c, d) else len(c) for i, t in rows}
    got = suffix_dedup.removal_report(spark, docs, hot).collect()
    assert len(got) == len(rows) and all(r["n_removed"] == want[r["doc_id"], r["n_bytes"]] for r in got)
    kept = [r["text"] for r in suffix_dedup.remove_repeats(spark, docs, hot).collect()]
    assert sorted(kept) == sorted([a, a, b, b, c, d, " end", " end"])


def test_texts_that_share_a_doc_id_are_judged_by_themselves(spark):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, c, d, e, f = (prose(rng, 120) for _ in range(6))
    # 7 and 9 have two texts each: of 7 one is a copy of 1's; those of 9 both have near copies.
    rows = [(1, a), (7, b), (7, a + " end"), (8, c), (8, c), (9, d), (9, e), (20, d + " end"), (30, e + " end"), (40, f), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    want = [(1, a), (7, b), (8, c), (9, d), (9, e), (40, f), (None, a)]
    assert sorted(kept, key=str) == sorted(want, key=str)
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, docs).collect()), key=str)
    root = {1: 1, 8: 8, 9: 9, 20: 9, 30: 9, 40: 40, None: None}
    # Sets of one smallest doc_id are one component, so 7 is with 1 as a whole.
    assert found == sorted([(i, root.get(i, 1), root.get(i, 1) == i) for i, _ in rows], key=str)
