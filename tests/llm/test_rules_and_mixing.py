import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward
from tidemark.llm import mixing, quality_rules


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_ledger_measures_against_plain_code(spark):
    rows = quality_rules.ledger(awkward(spark)).collect()
    assert len(rows) == 18
    for r in rows:
        w, t = words(r["text"]), r["text"] or ""
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 2000 else None
        lines = [x for x in t.split("\n") if words(x)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        if twice is not None:
            assert r["n_repeat_words"] == len(twice)
        assert bool(r["failed_bits"] & 1) == (len(w) < 50)


def test_policies_and_ablations_come_from_bits_alone(spark):
    led = quality_rules.ledger(awkward(spark)).select("failed_bits").cache()
    out = {r["rule"]: r for r in quality_rules.ablations(led, "v1").collect()}
    bits = [r["failed_bits"] for r in led.collect()]
    m = quality_rules.mask("v1")
    for i, name in enumerate(quality_rules.rule_names()):
        if name in out:
            assert out[name]["n_failed"] == sum(b >> i & 1 for b in bits)
            assert out[name]["n_failed_alone"] == sum(b & m == 1 << i for b in bits)
            assert out[name]["n_kept"] == sum(b & m == 0 for b in bits)
    assert [r.name for r in quality_rules.rules()] == quality_rules.rule_names()


def test_ledger_of_nothing(spark):
    assert quality_rules.ledger(awkward(spark).limit(0)).count() == 0


def test_filters_on_a_ledger_stay_above_it(spark):
    kept = quality_rules.ledger(awkward(spark)).filter(~quality_rules.fails("v1"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")


def test_mix_meets_targets_and_limits(spark):
    out = [r.asDict() for r in mixing.mix(spark, awkward(spark)).collect()]
    assert len(out) == 18
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        b = by.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        b[0] += r["taken"]
        b[3] += r["size"]
    for taken, target, size, total in by.values():
        assert total == size and target <= 3 * size + 1e-6 and abs(taken - target) <= 3
    again = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(spark, awkward(spark)).collect()}
    assert again == {(r["doc_id"], r["size"]): r["taken"] for r in out}


def test_mix_gives_the_place_in_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * (20 + i % 7), "ab"[i % 3 == 0]) for i in range(120)], "doc_id long, text string, source string")
    rows = sorted((r for r in mixing.mix(spark, docs).collect() if r["taken"]), key=lambda r: r["first_slot"])
    assert len({r["first_slot"] for r in rows}) == len(rows) and all(r["slots"] >= 1 for r in rows)
    # Both sources are spread over the whole schedule, near their weights (1 and 2).
    third = len(rows) // 3
    for i in range(3):
        words = {s: sum(min(r["taken"], r["size"]) for r in rows[i * third : (i + 1) * third] if r["source"] == s) for s in "ab"}
        assert min(words.values()) > 0.15 * sum(words.values())
    passes = mixing.passes(spark, docs).collect()
    per = {r["source"]: int(r["target"]) for r in rows}
    assert {s: sum(r["taken"] for r in passes if r["source"] == s) for s in per} == per


def test_mix_of_empty_tables(spark):
    assert mixing.mix(spark, awkward(spark).limit(0)).count() == 0
    empty = awkward(spark).withColumn("text", F.lit(None).cast("string"))
    assert {r["taken"] for r in mixing.mix(spark, empty).collect()} == {0}


def test_pipeline_mix_does_not_depend_on_the_slots(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(mixing, "MAX_SLOTS_LOG2", 3)
    rows = [(i, "w " * (40 + i), s) for i, s in enumerate("aabbccc")] + [(100, "one two three", "tiny"), (101, "", "void"), (102, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    target = {r["source"]: r["target"] for r in mixing.source_targets(mixing.sized(docs)).collect()}
    got = dict.fromkeys(target, 0)
    for r in corpus_pipeline.mixing_stage(spark, docs, "").collect():
        got[r["source"]] += len(words(r["text"]))
    assert got == {s: int(t) for s, t in target.items()} and got["tiny"] == 9


def test_schedule_is_spread_and_ranked(spark):
    src = spark.createDataFrame([(0, 0, 100), (1, 100, 256)], "source_id long, slot_lo long, slot_hi long")
    slots = sorted(mixing.schedule(spark, src, 8).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == list(range(256))
    for s in (0, 1):
        assert [r["rank"] for r in slots if r["source_id"] == s] == list(range(100 if s == 0 else 156))
    for i in range(0, 256, 32):  # every stretch has the sources near their weights
        assert abs(sum(r["source_id"] == 0 for r in slots[i : i + 32]) - 12.5) <= 2


@pytest.mark.parametrize("name", ["op1_quality_rules", "op8_mixing"])
def test_sql_agrees(spark, name, tmp_path):
    from tidemark.llm.queries import ORACLES, QUERIES

    rows = awkward(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES[name]).fetchdf()[list(got.columns)]
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert (a == b).all().all()
