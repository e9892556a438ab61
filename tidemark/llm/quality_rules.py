"""Quality rules as a bitmask ledger.

Every rule is evaluated once and leaves one bit of `failed_bits` (set: the rule
failed) beside the measurements it was based on. Policies are versioned masks
over those bits, so applying another policy, or asking what a rule changes,
reads the ledger and never the texts. Everything is a built-in expression.

Defined results: a null or empty text has no words, all measurements are 0 and
it fails `too_few_words`. Repeated rows are measured each on its own; an empty
table gives an empty ledger. Columns of the input are kept, and those named
like a ledger column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SEPARATORS, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def rules() -> list[Rule]:
    """In bit order; a bit's meaning never changes, new rules go to the end."""
    c = F.col
    return [
        Rule("too_few_words", c("n_words") < 50),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule("symbols", 10 * c("n_symbols") > 1 * c("n_words")),
        Rule("duplicate_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        Rule("upper_case", 10 * c("n_upper") > 3 * c("word_chars")),
        Rule("long_words", c("word_chars") > 20 * c("n_words")),
        Rule("few_distinct_words", 5 * c("n_distinct_words") < c("n_words")),
    ]


#: Versioned policies: the names of the rules that reject.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "upper_case", "long_words"),
    "v2": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case", "long_words", "few_distinct_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words", "n_distinct_words")


def mask(policy: str) -> int:
    bit = {rule: i for i, rule in enumerate(rule_names())}
    return sum(1 << bit[name] for name in POLICIES[policy])


def rule_names() -> list[str]:
    return ["too_few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case", "long_words", "few_distinct_words"]


def _chars_of(text: Column, chars: str) -> Column:
    """How many characters of a text are among these."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `failed_bits` (long)."""
    own = ("_w", "_lines", "_grams", "_at")
    docs = docs.drop(*own, *(m for m in (*MEASURES, "failed_bits") if m != text))
    t = F.coalesce(F.col(text), F.lit(""))
    lined = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SEPARATORS))) > 0)
    df = docs.withColumn("_w", words(F.col(text))).withColumn("_lines", lined)
    # Each three-word window with its place, sorted: equal windows are neighbours.
    gram = lambda x, i: F.struct(F.concat_ws(" ", x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("g"), i.alias("i"))
    grams = F.slice(F.transform("_w", gram), F.lit(1), F.greatest(F.lit(0), F.size("_w") - 2))
    df = df.withColumn("_grams", F.sort_array(grams))
    twice = lambda x, k: F.coalesce(x["g"] == F.get("_grams", k - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get("_grams", k + 1)["g"], F.lit(False))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_grams", twice), lambda x: x["i"])))
    # Windows cover three words; of one that overlaps the window before, only what is new counts.
    new = F.transform("_at", lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get("_at", k - 1), F.lit(-3))))
    measures = {
        "n_words": F.size("_w"),
        "word_chars": F.length(t) - _chars_of(t, SEPARATORS),
        "n_symbols": _chars_of(t, SYMBOLS),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_upper": _chars_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_repeat_words": F.aggregate(new, F.lit(0), lambda a, x: a + x),
        "n_distinct_words": F.size(F.array_distinct("_w")),
    }
    # Through a generator no filter on a measure is pushed, so each is computed once;
    # a filter below would repeat the expressions, the sorting inside their lambdas too.
    row = F.struct(*(x.cast("long").alias(c) for c, x in measures.items()))
    df = df.select(*docs.columns, F.inline(F.array(row)))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("failed_bits", bits)


def fails(policy: str, bits: Column | str = "failed_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that fail it alone
    (kept if the rule went), and that the policy keeps. One pass, no texts."""
    m, names = mask(policy), rule_names()
    hit = F.col("failed_bits").bitwiseAND(F.lit(m).cast("long"))
    used = [i for i, name in enumerate(names) if m >> i & 1]
    sums = [F.count_if(F.getbit("failed_bits", F.lit(i)) == 1).alias(f"any{i}") for i in used]
    sums += [F.count_if(hit == (1 << i)).alias(f"only{i}") for i in used]
    one = led.agg(F.count_if(hit == 0).alias("kept"), *sums)
    rows = [F.struct(F.lit(policy).alias("policy"), F.lit(names[i]).alias("rule"), F.col(f"any{i}").alias("n_failed"), F.col(f"only{i}").alias("n_failed_alone"), F.col("kept").alias("n_kept")) for i in used]
    return one.select(F.inline(F.array(*rows)))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    led = ledger(docs)
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails("base").alias("base_failed"), (~fails("v1")).alias("kept"), "failed_bits",
    )


_WS = r"[^\x20\x09-\x0D]+"
OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WS}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WS}')) AS ls
  FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM d, unnest(range(1, greatest(1, len(w) - 1))) AS u(i)),
twice AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(list_aggregate(list_concat([''], w), 'string_agg', ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_distinct(w))::BIGINT AS n_distinct_words, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
         + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
         + 16 * (10 * n_upper > 3 * word_chars)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
         + 64 * (5 * n_distinct_words < n_words)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 55) = 0 AS kept, failed_bits
FROM b
"""
