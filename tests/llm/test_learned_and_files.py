import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, prose
from tidemark.llm import langid, packing, quality_classifier, token_scan, tokens, topk, warc
from tidemark.llm.common import shared_path


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "t"):
        plain_ids.t = Tokenizer.from_file(tokens.default_path())
    return plain_ids.t.encode(text or "", add_special_tokens=False).ids


def test_encoding_by_chunks_equals_whole_texts():
    import pyarrow as pa

    rng = random.Random(1)
    odd = ["it's we'll 12ab34 don't", "ÀÉ ß Ü naïve İstanbul ΣΑΣ", "a b c \x85 d", "<|endoftext|> x<|startoftext|>", "漢字 かな é ́x", "!!?? ### $5.00 --", "", None, "tab\tand\r\nline", "²³ ½ ª º µ", "  lead  and trail  "]
    texts = odd + [prose(rng, 200) for _ in range(5)]
    ids, at = tokens.encoder(tokens.default_path()).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain_ids(t), t


def test_packing_round_trip(spark):
    docs = awkward(spark)
    rows = [r.asDict() for r in packing.pack(spark, docs).collect()]
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(plain_ids(r["text"])) + 1) for r in docs.collect())
    starts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert starts == want
    text = {(r["doc_id"], len(plain_ids(r["text"])) + 1): r["text"] for r in docs.collect()}
    for r in rows:
        ids = np.array(plain_ids(text[r["doc_id"], r["doc_tokens"]]) + [2], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for _, g in pd.DataFrame(rows).groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096
    assert packing.pack(spark, docs.limit(0)).count() == 0


def test_plans_use_every_length_once_and_waste_little():
    rng = np.random.default_rng(0)
    for n in (3, 500, 60_000):
        lengths, counts = np.unique(np.clip(rng.gamma(2, 400, n).astype(int), 1, 4096), return_counts=True)
        hist = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        plan = packing.plan(hist)
        used = {}
        for often, parts in plan:
            assert often > 0 and sum(k * m for k, m in parts) <= 4096
            for k, m in parts:
                used[k] = used.get(k, 0) + often * m
        assert used == hist
        total = sum(k * v for k, v in hist.items())
        if n > 1000:
            assert sum(o for o, _ in plan) * 4096 < 1.01 * total


def test_packing_of_many_pieces_goes_by_the_plan(spark, monkeypatch):
    rng = random.Random(17)
    docs = spark.createDataFrame([(i, "a b " * rng.randint(1, 900)) for i in range(2600)], "doc_id long, text string")
    solved = []
    real = packing.nnls
    monkeypatch.setattr(packing, "nnls", lambda *a: solved.append(real(*a)) or solved[-1])
    rows = pd.DataFrame([r.asDict() for r in packing.pack(spark, docs).collect()])
    assert len(solved) == 1 and len(solved[0][0]) and len(rows) == 2600
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096
    assert rows["sequence_id"].nunique() * 4096 < 1.02 * rows["length"].sum()


def test_least_squares_matches_a_known_histogram():
    cols = packing.combinations(16)
    assert (cols.sum(1) == 16).all()
    truth = np.zeros(len(cols))
    truth[[3, 20, 40]] = [50, 70, 30]
    h = np.zeros(17)
    for c, x in zip(cols, truth, strict=True):
        for b in c[c > 0]:
            h[b] += x
    used, x = packing.nnls(cols, h)
    back = np.zeros(17)
    for j, v in zip(used, x, strict=True):
        for b in cols[j][cols[j] > 0]:
            back[b] += v
    assert (x > 0).all() and np.abs(back - h).max() < 2


@pytest.mark.parametrize("block", [4, 10, 64, 1 << 20])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files, want = [], {}
    for k in range(4):
        lens = [0, 0, *rng.integers(0, 60, 12).tolist()]
        ids = np.concatenate([np.append(rng.integers(0, 999, n), 49407) for n in lens]).astype("<u2")
        tail = 5 if k == 2 else 0
        ids = np.concatenate([ids, rng.integers(0, 999, tail).astype("<u2")])
        (tmp_path / f"f{k}").write_bytes(ids.tobytes())
        files.append((f"f{k}", len(ids) * 2))
        want |= {(f"f{k}", i): (n, True) for i, n in enumerate(lens)}
        if tail:
            want[f"f{k}", len(lens)] = (5, False)
    (tmp_path / "none").write_bytes(b"")
    df = spark.createDataFrame([*files, ("none", 0)], "file string, file_bytes long")
    got = {(r["file"], r["ordinal"]): (r["n_tokens"], r["terminated"]) for r in token_scan.count_tokens(spark, df, f"file://{tmp_path}", block_bytes=block).collect()}
    assert got == want


def test_token_writer_lists_in_slices_and_refuses_wide_ids(spark):
    docs = spark.createDataFrame([(i, "" if i % 3 else "some words") for i in range(25_000)], "doc_id long, text string").coalesce(1)
    root = shared_path(spark, "tok")
    rows = token_scan.write_token_files(spark, docs, root, tokens.default_path())
    assert sorted(r[0] for r in rows.filter("ordinal >= 0").select("doc_id").collect()) == list(range(25_000))
    counts = token_scan.count_tokens(spark, rows.filter("ordinal = -1").select("file", "file_bytes"), root)
    got = rows.filter("ordinal >= 0").join(counts, ["file", "ordinal"])
    assert got.filter((F.col("n_tokens") == 0) == (F.col("doc_id") % 3 > 0)).count() == 25_000
    with pytest.raises(Exception, match="does not fit"):
        token_scan.write_token_files(spark, docs, shared_path(spark, "tok"), tokens.default_path(), end=200, width=1).count()


def test_token_counts_of_awkward_rows(spark):
    docs, root = awkward(spark), shared_path(spark, "tok")
    rows = token_scan.write_token_files(spark, docs, root, tokens.default_path())
    counts = token_scan.count_tokens(spark, rows.filter("ordinal = -1").select("file", "file_bytes"), root)
    got = rows.filter("ordinal >= 0").join(counts, ["file", "ordinal"]).collect()
    want = sorted(((r["doc_id"] or -1), len(plain_ids(r["text"]))) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == want


def test_language_models(spark):
    rng = random.Random(2)
    sets = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "mnopqrst"}
    rows = [(i, prose(rng, rng.randint(3, 60), sets[lang]), lang) for i, lang in enumerate(rng.choice(list(sets)) for _ in range(150))]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 ## 9", "bb"), (902, "abc hgf", None)], "doc_id long, text string, lang string")
    model = langid.learn(spark, docs, F.col("doc_id") % 3 != 0)
    for table in (*model.grams, *model.contexts):
        assert (np.diff(table.astype(object)) > 0).all()  # sorted hash arrays
    got = {r["doc_id"]: r for r in langid.predict(spark, docs.select("doc_id", "text"), model).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if i % 3 == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0 and got[902]["lang_pred"] == "aa"
    assert langid.learn(spark, docs.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predict(spark, docs.select("doc_id", "text"), None).collect()} == {"und"}


def test_probabilities_sum_to_one():
    model = langid.fit({"aa": ["abab abba baab"], "bb": ["cdcd dccd"]})
    chars = [32, *map(ord, "abcd")]
    for ctx in ([32, 97, 98], [98, 97, 98], [100, 100, 99]):
        p = np.exp(langid.log_probs(model, np.array([[*ctx, c] for c in chars], np.uint64))).sum(0)
        assert (p < 1.0001).all() and (p > 0.5).all()


def test_letters_beyond_the_first_plane_are_scored_as_learned():
    adlam, gothic = ("".join(chr(base + j) for j in (3, 1, 2, 1, 3, 2)) for base in (0x1E922, 0x10330))
    model = langid.fit({"aa": [f"{adlam} {adlam}"], "bb": [f"{gothic} {gothic}"]})
    scorer, order = langid.Scorer(model), len(model.grams)
    for text in (adlam, gothic, f"ab {adlam}", "ab ba"):
        sym = langid.symbols([text])[0]
        pad = np.concatenate([np.full(order - 1, 32, np.uint64), sym])
        places = [i for i in range(1, len(sym)) if sym[i] != 32 or sym[i - 1] != 32]
        want = -langid.log_probs(model, np.array([pad[i : i + order] for i in places])).mean(0)
        for _ in range(2):  # the second time from the cache
            assert np.allclose(scorer.entropies([text])[0][0], want, atol=1e-5)
    assert scorer.entropies([adlam, gothic])[0].argmin(1).tolist() == [0, 1]


def learned_tables(spark, path, lang=lambda i, x: x, quality=lambda i, y: y):
    """documents and labels in three languages, good and bad, with awkward rows."""
    rng = random.Random(21)
    sets, docs, labels = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "mnopqrst"}, [], []
    for i in range(240):
        code = rng.choice(list(sets))
        t, y = prose(rng, rng.randint(20, 60), sets[code]), int(i % 3 > 0)
        docs.append((i, t if y else t.replace(" ", " ### "), lang(i, code), f"s{i % 2}", len(t)))
        labels.append((i, quality(i, y), 0))
    docs += [(500, None, "aa", None, 0), (501, "", None, "a", 0), (None, "abc abd", "aa", "a", 7), (3, "abc cab", "aa", "a", 7), (502, "9 ##", "bb", "b", 4), (503, "abc " * 30_000, None, "b", 120_000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return docs, labels


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


def by_text(rows, key):
    return sorted((str(r["doc_id"]), *(r[k] for k in key)) for r in rows)


def test_registered_classifier_learns_nothing_from_what_it_keeps_apart(spark, tmp_path):
    run = lambda: quality_classifier.op2_quality_classifier(spark, str(tmp_path)).collect()
    docs, labels = learned_tables(spark, tmp_path)
    one = run()
    assert len(one) == len(docs)
    truth = {i: y for i, y, _ in labels}
    for r in one:
        held = r["doc_id"] is not None and remainder(r["doc_id"], 5) == 0
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if held and r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
    learned_tables(spark, tmp_path, lang=lambda i, x: "zz", quality=lambda i, y: y if remainder(i, 5) else 1 - y)
    assert by_text(run(), ["score"]) == by_text(one, ["score"])


def test_registered_language_id_learns_nothing_from_what_it_keeps_apart(spark, tmp_path):
    run = lambda: langid.op7_langid(spark, str(tmp_path)).collect()
    docs, _ = learned_tables(spark, tmp_path)
    one = run()
    assert len(one) == len(docs)
    truth = {i: lang for i, _, lang, _, _ in docs if i is not None and i < 240}
    for r in one:
        assert r["held_out"] == (r["doc_id"] is not None and remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("und" if r["doc_id"] in (500, 501, 502) else r["lang_pred"]) and r["lang_pred"] in ("aa", "bb", "cc", "und")
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in one if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 3]
    assert sum(held) >= 0.95 * len(held)
    learned_tables(spark, tmp_path, lang=lambda i, x: x if remainder(i, 3) != 1 else "zz")
    assert by_text(run(), ["lang_pred", "score"]) == by_text(one, ["lang_pred", "score"])


def test_learned_operators_on_awkward_rows(spark, tmp_path):
    rows = awkward(spark)
    model = langid.learn(spark, rows, F.lit(True))
    assert langid.predict(spark, rows, model).count() == 18
    labels = spark.createDataFrame([(1, 1), (12, 0), (13, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    sure = quality_classifier.learn(spark, rows, labels, "quality")
    got = quality_classifier.score(spark, rows, sure).collect()
    assert len(got) == 18 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.score(spark, rows.limit(0), sure).count() == 0 and langid.predict(spark, rows.limit(0), model).count() == 0


def test_texts_of_no_known_language_are_rejected(spark):
    rng = random.Random(8)
    sets = {"aa": "abcdefgh", "bb": "ghijklmn"}
    rows = [(i, prose(rng, 30, sets[lang]), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame([*rows, *((1000 + i, prose(rng, 30, "uvwxyz"), None) for i in range(20))], "doc_id long, text string, lang string")
    model = langid.learn(spark, docs, F.lit(True))
    got = {r["doc_id"]: r["rejected"] for r in langid.predict(spark, docs, model).collect()}
    assert all(got[1000 + i] for i in range(20)) and sum(got[i] for i in range(120)) <= 3


def test_classifier_learns_and_folds(spark):
    rng = random.Random(4)
    good = [(i, prose(rng, 60, "abcdefg"), 1) for i in range(120)]
    bad = [(200 + i, " ".join(w + "###" for w in prose(rng, 60, "abcdefg").split()), 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad if i % 4] + [(1, 0), (2, None)], "doc_id long, quality int")
    model = quality_classifier.learn(spark, docs, labels, "quality")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(spark, docs, model).collect()}
    held = [(got[i], y) for i, _, y in good + bad if i % 4 == 0]
    assert all((s >= 0.3) == bool(y) for s, y in held)
    assert got[900] == got[901] and 0.5 < got[900] < 1
    idx, w = quality_classifier.bag("abc abc ###")
    import pyarrow as pa

    one = quality_classifier.scores(model, pa.array(["abc abc ###"]))[0]
    assert abs(one - 1 / (1 + np.exp(-(w @ model.table[idx] + model.bias)))) < 1e-5
    none = quality_classifier.learn(spark, docs, labels.limit(0), "quality")
    assert quality_classifier.scores(none, pa.array(["x"])).tolist() == [0.5]


def page(i, html, url="http://e.org"):
    return (i, url, html, "x")


def test_warc_round_trip_and_salvage(spark, tmp_path):
    big = "z" * 1500
    rows = [page(1, big), page(2, big), page(3, None), page(4, "small"), page(5, "small"), page(6, big), page(6, big), page(None, big), page(7, "né" * 900, None), page(8, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    root = f"file://{tmp_path}/a"
    manifest = warc.write_archives(spark, pages, root)
    got = warc.read_archives(spark, root, manifest, payloads=True).collect()
    assert {r["kind"] for r in got} == {"record"} and len(got) == 10
    by = {(r["page_id"], r["record_type"]) for r in got if r["page_id"] in (1, 2, 6)}
    assert by == {(1, "revisit"), (2, "revisit"), (6, "response")}
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["refers_to"] == 6 and r["payload_bytes"] == 1500
    # Damage: flip bytes in one member, cut another, add noise with false starts.
    recs = [warc.member(warc.record(i, "u", f"payload {i}".encode() * 50, hashlib.sha1(f"payload {i}".encode() * 50).hexdigest())) for i in range(6)]
    hurt = bytearray(recs[1])
    hurt[len(hurt) // 2] ^= 0xFF
    data = recs[0] + bytes(hurt) + recs[2] + recs[3][: len(recs[3]) // 2] + b"\x1f\x8b\x08 noise WARC/1." + recs[4] + recs[5] + b"trail"
    plain = warc.record(7, "u", b"x", hashlib.sha1(b"x").hexdigest())
    out = list(warc.salvage(data)) + [("split",)] + list(warc.salvage(plain + b"junk" + plain.replace(b"Content-Length: ", b"Content-Length: 9") + plain))
    cut = out.index(("split",))
    first, second = out[:cut], out[cut + 1 :]
    assert [warc._page(r[3]["warc-page-uri"]) for r in first if r[0] == "record"] == [0, 2, 4, 5]
    covered = sorted((r[1], r[2]) for r in first)
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
    assert [r[0] for r in second] == ["record", "gap", "record"]
    assert warc.write_archives(spark, pages.limit(0), f"file://{tmp_path}/b").count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12).round(1)]) for i in range(300)]
    rows += [(300, rows[5][1]), (5, rows[5][1]), (100, None), (200, [float("nan")] * 12), (302, [1.0] * 11), (400, [1.0] * 11), (500, []), (None, [1.0] * 12), (303, [float("inf")] + [0.0] * 11), (600, [None] + [0.0] * 11)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.top_k(spark, df, F.col("vec_id") % 20 == 0, 10).collect())
    con = duckdb.connect()
    con.register("emb", df.toPandas())
    sql = topk.OP10_SQL.replace("FROM embeddings", "FROM (SELECT vec_id, embedding::FLOAT[] AS embedding FROM emb)").replace("vec_id % 100", "vec_id % 20")
    assert got == sorted(con.execute(sql).fetchall())
    assert topk.top_k(spark, df.limit(0), F.lit(True)).count() == 0
    few = topk.top_k(spark, df.filter("vec_id < 4"), F.col("vec_id") == 0, 10).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]


def test_top_k_of_large_components_is_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.randint(0, 38) * (1 + rng.randrange(1 << 20) / (1 << 20)) for _ in range(6)]) for i in range(80)]
    rows += [(80 + i, [float(rng.randint(-5, 5)) for _ in range(6)]) for i in range(40)] + [(120, [1e30] * 6), (121, [-1e30] * 6), (122, [1e306] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(spark, df, F.col("vec_id") % 10 == 0, 7).collect())
    whole = {i: [int(np.floor(x * 1024)) if abs(x * 1024) < 2**53 else int(x * 1024) for x in v] for i, v in rows if i != 122}
    want = []
    for q in whole:
        if q % 10 == 0:
            scored = [(min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in whole.items() if i != q]
            best = sorted(scored, key=lambda x: (-x[0], x[1]))[:7]
            want += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_in_several_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>")
    got = topk.top_k(spark, df, F.col("vec_id") % 3 == 0, 4)
    assert got.count() == 20 * 4


def test_pipeline_equals_its_stages_in_plain_code(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_duplicates import brute, removal

    rng = random.Random(11)
    base, passage = prose(rng, 90), prose(rng, 60)
    texts = [base, base.replace(" ", " ", 1) + " end", prose(rng, 80) + " " + passage, passage + " " + prose(rng, 80), prose(rng, 10), " ".join(w + "###" for w in prose(rng, 80).split()), prose(rng, 120), None, prose(rng, 200)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    a = stages[0](spark, docs, "")
    assert sorted(r["doc_id"] for r in a.collect()) == [0, 1, 2, 3, 6, 8]
    b = stages[1](spark, a, "")
    links = brute([(r["doc_id"], r["text"]) for r in sorted(a.collect())], 5, 80)
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(i for i, (_, c) in links.items() if i == c) == [0, 2, 3, 6, 8]
    c = stages[2](spark, b, "")
    want = removal([(r["doc_id"], r["text"]) for r in b.collect()])
    for r in c.collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == next(v[3] for (d, _), v in want.items() if d == r["doc_id"]) and r["n_chars"] == len(r["text"])
    d = stages[3](spark, c, "")
    size = {r["doc_id"]: len(r["text"].split()) for r in c.collect()}
    from tidemark.llm import mixing

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(spark, c).collect()}
    got = {}
    for r in d.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {k: v for k, v in taken.items() if v} and all(v <= 3 * size[k] for k, v in got.items())
    assert all(x.columns == docs.columns for x in (a, b, c, d))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    e = corpus_pipeline.run(spark, str(tmp_path))
    total = sum(len(plain_ids(r["text"])) + 1 for r in d.collect())
    assert e.agg(F.sum("length")).first()[0] == total
    assert set(e.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
