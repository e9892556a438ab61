"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order ORDER over letters (lower-cased, everything else
one space). The models share sorted arrays of context and n-gram hashes, one column
per language, and a probability is found by binary search. A text's language is the
one of the lowest cross-entropy per character; the margin to the others, scaled by a
temperature fitted on texts kept apart, gives a confidence. A text is rejected
(`rejected`, which leaves its prediction as it is) if the confidence is under the fitted
threshold, or if its cross-entropy is over the limit of its language: the quantile QUANTILE
of texts kept apart, and MARGIN times as much, as a text of no known language is.

The sample: about SAMPLE texts of each language, all of them where there are fewer,
drawn by a hash of doc_id at a rate that the languages' counts over all documents
give; of rows that share doc_id and language, one. It is the only part that is bounded; its size depends on the number of
languages, not of documents. Scoring reads every whole text.

Defined results: a null text, or one without a letter, is `und` with score 0. Rows
without a language, and those of doc_ids kept apart, teach nothing; if no row
teaches, every text is `und`. Ties go to the language first by code point. Repeated
rows are scored each; columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, crc32_mod, mix64

ORDER = 4
DISCOUNT = 0.75
#: Texts of each language to learn from.
SAMPLE = 400
#: Characters scored at once.
CHARS = 1 << 18
QUANTILE, MARGIN = 0.99, 1.25
UNKNOWN = "und"
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each between spaces, with 32 for all that is
    no letter; the offsets of the texts; whether each has a letter."""
    low = [t.lower() for t in texts]
    flat = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    letter = _letters()[flat]
    count = np.concatenate([[0], np.cumsum(letter)])
    return np.where(letter, flat, 32).astype(np.uint64), at, count[at[1:]] > count[at[:-1]]


def grams(sym: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n symbols that end at each place from n - 1 on."""
    h = np.zeros(len(sym) - n + 1, np.uint64)
    for i in range(n):
        h = mix64(h + sym[i : len(sym) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1)))
    return h


@dataclass
class Model:
    """Per order n: sorted hashes of n-grams with their discounted share by language,
    and sorted hashes of contexts (n - 1 symbols) with the weight of the shorter order."""

    languages: list[str]
    grams: list[np.ndarray]
    shares: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    uniform: float
    temperature: float = 1.0
    reject: float = 0.0
    limits: np.ndarray | None = None


def _counts(keys: np.ndarray, langs: np.ndarray, weight: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the weight of each by language."""
    uniq, inv = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(inv * n_langs + langs, weight, len(uniq) * n_langs).reshape(-1, n_langs)


def fit(samples: dict[str, list[str]], order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """Counts are of places for the highest order, and below it of the different
    symbols found before an n-gram, as Kneser and Ney count."""
    languages = sorted(samples)
    k = len(languages)
    seqs = {lang: symbols(samples[lang])[0] for lang in languages}
    model = Model(languages, [], [], [], [], 1.0 / (1 + len(np.unique(np.concatenate(list(seqs.values()))))))
    for n in range(1, order + 1):
        keys, ctx, langs, weight = [], [], [], []
        for j, lang in enumerate(languages):
            s = seqs[lang]
            if n == order:
                g, first = np.unique(grams(s, n), return_index=True)
                w = np.bincount(np.searchsorted(g, grams(s, n)), minlength=len(g))
            else:  # each distinct (n + 1)-gram is one way to continue into its last n symbols
                _, once = np.unique(grams(s, n + 1), return_index=True)
                short = grams(s, n)[once + 1]
                g, first, w = np.unique(short, return_index=True, return_counts=True)
                first = once[first] + 1
            keys.append(g)
            ctx.append(grams(s, n - 1)[first] if n > 1 else np.zeros(len(g), np.uint64))
            langs.append(np.full(len(g), j))
            weight.append(w)
        keys, ctx, langs, weight = (np.concatenate(x) for x in (keys, ctx, langs, weight))
        contexts, total = _counts(ctx, langs, weight, k)
        _, kinds = _counts(ctx, langs, np.ones(len(langs)), k)
        own = np.searchsorted(contexts, ctx)
        uniq, inv = np.unique(keys, return_inverse=True)
        share = np.zeros((len(uniq), k))
        share[inv, langs] = np.maximum(weight - discount, 0) / total[own, langs]
        model.grams.append(uniq)
        model.shares.append(share)
        model.contexts.append(contexts)
        model.backs.append(np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0))
    return model


def _find(table: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where((table[at] == keys)[:, None], values[at], missing)


def log_probs(model: Model, windows: np.ndarray) -> np.ndarray:
    """log p(last symbol | those before) by language, for rows of `order` symbols."""
    p = np.full((len(windows), len(model.languages)), model.uniform)
    for n in range(1, len(model.grams) + 1):
        tail = windows[:, windows.shape[1] - n :]
        hashes = lambda part: _hash_rows(part)
        share = _find(model.grams[n - 1], model.shares[n - 1], hashes(tail), 0.0)
        back = _find(model.contexts[n - 1], model.backs[n - 1], hashes(tail[:, :-1]) if n > 1 else np.zeros(len(p), np.uint64), 1.0)
        p = share + back * p
    return np.log(p)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        h = mix64(h + rows[:, i] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1)))
    return h


class Scorer:
    """Cross-entropies of texts. n-grams seen by a worker keep their log-probabilities
    in a sorted table of bounded size, so most places cost one binary search."""

    KEEP = 1 << 18

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros((0, len(model.languages)), np.float32)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By text and language, and whether the text has a letter."""
        order = len(self.model.grams)
        sym, at, any_letter = symbols(texts)
        # A run of spaces says nothing of the language: only one place of it counts.
        word = sym != 32
        counts = word.copy()
        counts[1:] |= word[:-1]
        counts[0] = False
        pad = np.concatenate([np.full(order - 1, 32, np.uint64), sym])
        used = np.flatnonzero(counts)
        packed = np.zeros(len(used), np.uint64)
        far = np.zeros(len(used), bool)
        for i in range(order):  # 16 bits a symbol; with symbols beyond the first plane, a hash
            c = pad[used + i]
            packed = (packed << np.uint64(16)) | (c & np.uint64(0xFFFF))
            far |= c > 0xFFFF
        places = np.arange(order)
        packed[far] = _hash_rows(pad[used[far][:, None] + places])
        uniq, first, inv = np.unique(packed, return_index=True, return_inverse=True)
        values = self._lookup(uniq, pad[used[first][:, None] + places])
        total = np.zeros((len(texts), values.shape[1]))
        row = np.searchsorted(at, used - 1, "right") - 1  # the space behind a text is its own
        n = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        for j in range(values.shape[1]):
            total[:, j] = np.bincount(row, values[:, j][inv], len(texts))
        return -total / n[:, None], any_letter

    def _lookup(self, uniq: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Values of keys, each with its row of symbols."""
        at = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
        known = self.keys[at] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        out = np.empty((len(uniq), len(self.model.languages)), np.float32)
        out[known] = self.values[at[known]]
        new = uniq[~known]
        if len(new):
            got = log_probs(self.model, rows[~known]).astype(np.float32)
            out[~known] = got
            if len(self.keys) > self.KEEP:
                self.keys, self.values = self.keys[:0], self.values[:0]
            keys = np.concatenate([self.keys, new])
            sort = np.argsort(keys)
            self.keys, self.values = keys[sort], np.concatenate([self.values, got])[sort]
        return out


def confidence(model: Model, entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number and its share of exp(-entropy / temperature)."""
    z = -entropy / model.temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return entropy.argmin(1), z.max(1) / z.sum(1)


def calibrate(model: Model, kept: dict[str, list[str]]) -> Model:
    """Temperature of the least log loss, the threshold under which the share of wrong
    predictions among the texts kept apart would exceed one half, and each language's
    limit of the cross-entropy."""
    scorer, all_e, truth = Scorer(model), [], []
    for j, lang in enumerate(model.languages):
        if kept.get(lang):
            e, ok = scorer.entropies(kept[lang])
            all_e.append(e[ok])
            truth += [j] * int(ok.sum())
    if not truth:
        return model
    e, y = np.concatenate(all_e), np.array(truth)
    own = e[np.arange(len(y)), y]
    model.limits = np.array([MARGIN * np.quantile(own[y == j], QUANTILE) if (y == j).any() else np.inf for j in range(len(model.languages))])
    best = None
    for t in np.geomspace(0.01, 2, 25):
        z = -e / t
        z -= z.max(1, keepdims=True)
        loss = (np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean()
        if best is None or loss < best[0]:
            best = loss, t
    model.temperature = float(best[1])
    pred, conf = confidence(model, e)
    wrong = np.sort(conf[pred != y])
    model.reject = next((float(c) for c in wrong[::-1] if (pred != y)[conf <= c].mean() > 0.5), 0.0)
    return model


def learn(spark: SparkSession, docs: DataFrame, teaches: Column, sample: int = SAMPLE) -> Model | None:
    """docs: doc_id, text, lang. Two passes: counts by language, then the drawn texts."""
    may = docs.filter(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in may.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rate = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, sample / n) * 2**20) + 1))])
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(2**20)) < F.element_at(rate, F.col("lang"))
    drawn = may.filter(draw).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.collect():
        texts.setdefault(r["lang"], []).append((r["h"], r["text"]))
    fitted, apart = {}, {}
    for lang, rows in texts.items():
        rows.sort()
        cut = max(1, len(rows) * 4 // 5)
        fitted[lang], apart[lang] = [t for _, t in rows[:cut]], [t for _, t in rows[cut:]]
    return calibrate(fit(fitted), apart)


def predict(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs (doc_id, text)."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = None if m is None else Scorer(m)
        for b in batches:
            ids, texts = b.column("doc_id"), [t or "" for t in b.column("text").to_pylist()]
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            i = 0
            while i < len(texts) and scorer is not None:
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHARS):
                    size += len(texts[j])
                    j += 1
                e, ok = scorer.entropies(texts[i:j])
                best, conf = confidence(m, e)
                for n in np.flatnonzero(ok):
                    lang[i + n] = m.languages[best[n]]
                score[i:j] = np.where(ok, conf, 0.0)
                rejected[i:j] = ~ok | (conf < m.reject)
                if m.limits is not None:
                    rejected[i:j] |= e.min(1) > m.limits[best]
                i = j
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    apart = crc32_mod(F.col("doc_id"), 3) == 1
    model = learn(spark, docs, ~apart)
    out = predict(spark, docs, model)
    return out.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
