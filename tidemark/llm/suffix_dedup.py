"""Removal of repeated byte strings by a depth-limited suffix sort.

Suffixes are ordered only through their first LENGTH bytes, by most-significant-digit
passes; the groups that are equal after the last pass are exactly the repeated
windows, and of each group all but the first occurrence are removed.

The first pass is spread over the cluster. Its digit is a window's anchor: the gram of
GRAM bytes whose hash is the smallest (leftmost if equal) of those in the window.
Equal windows have equal anchors, and neighbouring windows share theirs, so a run of
windows travels as one row of a few numbers; text isn't moved. A run whose anchor
occurs nowhere else is not repeated; one whose whole content occurred before is
repeated as a whole. Only the first occurrences of differing runs with one anchor go
on: their bytes are fetched, and the remaining passes, of eight bytes each, decide
window by window. An anchor with more than HOT such runs isn't gathered in one task;
its windows are counted as single rows, by two 64-bit hashes of their content.

Whole runs are compared within one anchor by a 64-bit hash of their content beside the
anchor's own 64 bits.

Defined results: null texts are empty; a text shorter than LENGTH loses nothing. Order
is by doc_id (null last), then start. Rows that repeat doc_id and text are one
document, and all of them get its result; rows that repeat a doc_id with other text are
documents of their own, in the order of a hash of their text. Bytes are judged on the
input. Other columns are not read, or kept as they are by remove_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ODD, SpanHash, bounded_batches, mix64, pieces, stored, text_view

LENGTH, GRAM = 100, 24
#: Bytes hashed at once; longer texts are taken in stretches.
CHUNK = 1 << 18
#: Runs that a map task compares among themselves before they are sent.
COMBINE = 1 << 19
HOT = 1000
BLOCK = 9
#: Windows sorted at once.
WINDOWS = 1 << 20
LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at each place, joining halves of known length."""
    done = {1: (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)}
    size = 1
    while size * 2 <= gram:
        h = done[size]
        done[size * 2] = h[:-size] * np.uint64(0xBF58476D1CE4E5B9 + 2 * size) + h[size:]
        size *= 2
    out, have = done[size], size
    for part in sorted((s for s in done if s < size), reverse=True):
        if have + part <= gram:
            n = len(raw) - have - part + 1
            out = out[:n] * np.uint64(0x94D049BB133111EB + 2 * part) + done[part][have : have + n]
            have += part
    return mix64(out)


def runs(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts that lie at `at` in raw: for each run of windows its text, first window,
    number of windows, the anchor's place from the first window, its hash, and the hash
    of the content."""
    if len(raw) < length:
        return (*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2)))
    h = _gram_hashes(raw, gram)
    m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    p = (m & _PLACE).astype(np.int64)
    lo = np.flatnonzero(np.diff(p, prepend=-1))
    hi = np.append(lo[1:], len(p)) - 1
    p = p[lo]
    row = np.searchsorted(at, p, "right") - 1
    lo, hi = np.maximum(lo, at[row]), np.minimum(hi, at[row + 1] - length)
    ok = lo <= hi
    lo, hi, row, p = lo[ok], hi[ok], row[ok], p[ok]
    return row, lo - at[row], hi - lo + 1, p - lo, h[p], SpanHash(raw)(lo, hi + length)


def _texts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows, bytes and offsets of stretches of a batch, and the place in the text where
    the stretch of a long one begins."""
    raw, offsets = text_view(b.column("text"))
    for i, j in pieces(offsets, CHUNK):
        a, z = offsets[i], offsets[j]
        if j == i + 1 and z - a > 2 * CHUNK:
            for s in range(0, z - a - LENGTH + 1, CHUNK):
                part = raw[a + s : min(z, a + s + CHUNK + LENGTH - 1)]
                yield np.array([i]), part, np.array([0, len(part)]), s
        else:
            yield np.arange(i, j), raw[a:z], offsets[i : j + 1] - a, 0


def _pos(first, anchor, count):
    return (first << 16) | (anchor << 8) | count


RUNS = "akey long, ckey long, doc long, tie long, pos long, known boolean"


def _map_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos holds the first window, the anchor's place from it and the number of windows
    (_pos). Runs that repeat another of this task are known to be removed and need no
    comparison any more."""
    held: list[tuple] = []
    n = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, n
        akey, ckey, doc, tie, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        held, n = [], 0
        order = np.argsort(ckey, kind="stable")
        same = ckey[order][1:] == ckey[order][:-1]
        twin = np.zeros(len(order), bool)
        twin[1:] |= same
        twin[:-1] |= same
        sub = order[twin]
        sub = sub[np.lexsort((pos[sub], tie[sub], doc[sub], akey[sub], ckey[sub]))]
        known = np.zeros(len(order), bool)
        known[sub[1:]] = (ckey[sub][1:] == ckey[sub][:-1]) & (akey[sub][1:] == akey[sub][:-1])
        akey = np.where(known, mix64(pos.view(np.uint64) + doc.view(np.uint64) * np.uint64(31)), akey)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (akey.view(np.int64), ckey.view(np.int64), doc, tie, pos, known)], ["akey", "ckey", "doc", "tie", "pos", "known"])

    for b in batches:
        docs, ties = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
        for rows, part, at, base in _texts(b):
            row, lo, count, anchor, akey, ckey = runs(part, at)
            own = rows[row]
            held.append((akey, ckey, docs[own], ties[own], _pos(lo + base, anchor, count)))
            n += len(row)
            if n >= COMBINE:
                yield flush()
    if n:
        yield flush()


def _sift(limit: int):
    """Rows come sorted by akey, ckey, doc, tie, pos; adds kind. A row whose ckey was
    there is removed; first rows of an akey with several ckeys are to be checked, or hot
    if they are more than limit. Holds at most limit rows of the akey in hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        last, hot = (None, None), False

        def out(kind: str, t: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in t.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(b), pa.string()), *b.columns], ["kind", *b.schema.names])

        for b in batches:
            t = pa.Table.from_batches([b])
            known = b.column("known").to_numpy(zero_copy_only=False).astype(bool)
            if known.any():
                yield from out("removed", t.filter(pa.array(known)))
                t = t.filter(pa.array(~known))
            if not len(t):
                continue
            akey, ckey = (t.column(c).to_numpy() for c in ("akey", "ckey"))
            again = np.zeros(len(akey), bool)
            again[1:] = (akey[1:] == akey[:-1]) & (ckey[1:] == ckey[:-1])
            again[0] = last == (akey[0], ckey[0])
            if again.any():
                yield from out("removed", t.filter(pa.array(again)))
            hot = hot and akey[0] == last[0]
            f = t.filter(pa.array(~again))
            f = f if held is None else pa.concat_tables([held, f])
            last = (akey[-1], ckey[-1])
            keys = f.column("akey").to_numpy()
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            start = np.flatnonzero(new)
            each = np.repeat(np.diff(np.append(start, len(keys))), np.diff(np.append(start, len(keys))))
            much = (each > limit) | (hot & (keys == akey[0]))
            open_ = keys == last[0]
            hot = (hot and akey[0] == last[0]) or bool((open_ & much).any())
            done = ~open_ | much
            for kind, pick in (("hot", done & much), ("check", done & ~much & (each > 1))):
                if pick.any():
                    yield from out(kind, f.filter(pa.array(pick)))
            held = f.filter(pa.array(~done)).combine_chunks()
        if held is not None and len(held) > 1:
            yield from out("check", held)

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs in `todo` of each text."""
    for b in batches:
        raw, offsets = text_view(b.column("text"))
        lists = b.column("todo")
        item, owner = lists.flatten(), np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
        akey, pos = (item.field(c).to_numpy(zero_copy_only=False) for c in ("akey", "pos"))
        kind = item.field("kind")
        doc, tie = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
        for i in range(0, len(pos), 20_000):
            o, p = owner[i : i + 20_000], pos[i : i + 20_000]
            lo, size = offsets[o] + (p >> 16), (p & 255) + LENGTH - 1
            text = [raw[s : s + n].tobytes() for s, n in zip(lo, size, strict=True)]
            yield pa.RecordBatch.from_arrays([kind[i : i + 20_000], pa.array(akey[i : i + 20_000]), pa.array(doc[o]), pa.array(tie[o]), pa.array(p), pa.array(text, pa.binary())], ["kind", "akey", "doc", "tie", "pos", "context"])


def _ranges(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, count[i] times i, and beside it 0 to count[i] - 1."""
    own = np.repeat(np.arange(len(count)), count)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hot runs cut where an anchor's place in the window, over BLOCK, changes: the bytes
    that all windows with such places share are the block's new key."""
    for b in batches:
        raw, at = text_view(b.column("context"))
        akey, doc, tie, pos = (b.column(c).to_numpy() for c in ("akey", "doc", "tie", "pos"))
        first, anchor, n = pos >> 16, pos >> 8 & 255, pos & 255
        # Window k of a run has its anchor at anchor - k; blocks hold places of one quotient.
        low, high = (anchor - n + 1) // BLOCK, anchor // BLOCK
        own, k = _ranges(high - low + 1)
        q = high[own] - k
        a = np.maximum(0, anchor[own] - (q * BLOCK + BLOCK - 1))
        z = np.minimum(n[own] - 1, anchor[own] - q * BLOCK)
        h = SpanHash(raw)
        base = at[own]
        # Shared by every place of the quotient, whether or not this run has all of them.
        shared = base + anchor[own] - q * BLOCK
        core = h(shared, shared - (BLOCK - 1) + LENGTH)
        # What precedes the anchor in the core tells blocks of one run apart, so q is in the key.
        key = mix64(core ^ mix64(akey[own].view(np.uint64) + q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        ckey = h(base + a, base + z + LENGTH)
        text = [raw[s:e].tobytes() for s, e in zip(base + a, base + z + LENGTH, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(ckey.view(np.int64)), pa.array(doc[own]), pa.array(tie[own]), pa.array(_pos(first[own] + a, anchor[own] - a, z - a + 1)), pa.array(np.zeros(len(own), bool)), pa.array(text, pa.binary())],
            ["akey", "ckey", "doc", "tie", "pos", "known", "context"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a context, as two hashes of its content."""
    for b in batches:
        raw, at = text_view(b.column("context"))
        doc, tie, pos = (b.column(c).to_numpy() for c in ("doc", "tie", "pos"))
        own, k = _ranges(pos & 255)
        s = at[own] + k
        w1, w2 = (SpanHash(raw, base)(s, s + LENGTH).view(np.int64) for base in (ODD, 0xC2B2AE3D27D4EB4F))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, doc[own], tie[own], (pos >> 16)[own] + k)], ["w1", "w2", "doc", "tie", "start"])


def radix_repeats(raw: np.ndarray, start: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows equal an earlier one (by index) of their group: passes over digits
    of eight bytes, most significant first, windows that are alone dropping out."""
    digits = np.zeros(len(raw) + 1, np.uint64)
    pad = np.concatenate([raw, np.zeros(8, np.uint8)])
    for i in range(8):
        digits |= pad[i : i + len(raw) + 1].astype(np.uint64) << np.uint64(56 - 8 * i)
    alive, gid = np.arange(len(start)), group
    for depth in range(0, length, 8):
        d = digits[start[alive] + depth]
        if length - depth < 8:
            d >>= np.uint64(8 * (8 - (length - depth)))
        order = np.lexsort((d, gid))  # stable: the earlier window stays first
        alive, gid, d = alive[order], gid[order], d[order]
        new = np.ones(len(alive), bool)
        new[1:] = (gid[1:] != gid[:-1]) | (d[1:] != d[:-1])
        gid = np.cumsum(new)
        keep = ~new
        keep[:-1] |= ~new[1:]
        alive, gid = alive[keep], gid[keep]
        if not len(alive):
            break
    out = np.zeros(len(start), bool)
    if len(alive):
        out[alive[1:][gid[1:] == gid[:-1]]] = True
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by akey, doc, tie, pos, with context; emits removed runs."""
    held: list[pa.RecordBatch] = []
    n = 0

    def judge(t: pa.Table) -> pa.RecordBatch:
        raw, at = text_view(t.column("context"))
        akey, doc, tie, pos = (t.column(c).to_numpy() for c in ("akey", "doc", "tie", "pos"))
        own, k = _ranges(pos & 255)
        group = np.cumsum(np.diff(akey, prepend=akey[0]) != 0)
        gone = radix_repeats(raw, at[own] + k, group[own])
        # Neighbouring removed windows of one run become one row.
        at_ = np.flatnonzero(gone)
        first = np.ones(len(at_), bool)
        first[1:] = (np.diff(at_) != 1) | (own[at_][1:] != own[at_][:-1])
        lead = at_[first]
        size = np.diff(np.append(np.flatnonzero(first), len(at_)))
        o = own[lead]
        return pa.RecordBatch.from_arrays([pa.array(doc[o]), pa.array(tie[o]), pa.array(_pos((pos[o] >> 16) + k[lead], 0, size))], ["doc", "tie", "pos"])

    for b in batches:
        held.append(b)
        n += int((b.column("pos").to_numpy() & 255).sum())
        if n < WINDOWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        akey = t.column("akey").to_numpy()
        cut = int(np.searchsorted(akey, akey[-1]))
        if cut:
            yield judge(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
            n = sum(int((x.column("pos").to_numpy() & 255).sum()) for x in held)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        if len(t):
            yield judge(t)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc (doc_id, null last), tie (0 unless a doc_id has several rows) and text; and
    whether rows may agree in doc and tie."""
    repeated = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    nulls = docs.filter(F.col("doc_id").isNull())
    plain = repeated.isEmpty() and nulls.isEmpty()
    tie = F.lit(0).cast("long") if plain else F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("tie", tie), not plain


def removed_runs(spark: SparkSession, keyed: DataFrame, hot_runs: int = HOT, repeated: bool = True) -> DataFrame:
    """doc, tie, pos (_pos): runs of windows that occur earlier. Rows that agree in doc
    and tie (repeated: there may be some) are read once, so none is its own repeat."""
    bounded_batches(spark)
    slim = keyed.select("doc", "tie", "text")
    if repeated:
        slim = slim.dropDuplicates(["doc", "tie"])
    order = ("akey", "ckey", "doc", "tie", "pos")
    found = slim.mapInArrow(_map_runs, RUNS).repartition("akey").sortWithinPartitions(*order)
    sifted = stored(found.mapInArrow(_sift(hot_runs), f"kind string, {RUNS}").drop("ckey", "known"), "suffix-runs")
    out = sifted.filter("kind = 'removed'").select("doc", "tie", "pos")
    todo = sifted.filter("kind <> 'removed'").groupBy("doc", "tie").agg(F.collect_list(F.struct("kind", "akey", "pos")).alias("todo"))
    work = slim.join(todo, ["doc", "tie"]).mapInArrow(_contexts, "kind string, akey long, doc long, tie long, pos long, context binary")
    work = stored(work, "suffix-contexts")
    check = work.filter("kind = 'check'")
    hot = work.filter("kind = 'hot'")
    if not hot.isEmpty():
        cut = hot.mapInArrow(_blocks, f"{RUNS}, context binary").repartition("akey").sortWithinPartitions(*order)
        again = stored(cut.mapInArrow(_sift(hot_runs), f"kind string, {RUNS}, context binary").drop("ckey", "known"), "suffix-blocks")
        out = out.unionByName(again.filter("kind = 'removed'").select("doc", "tie", "pos"))
        check = check.unionByName(again.filter("kind = 'check'"))
        windows = again.filter("kind = 'hot'").mapInArrow(_windows, "w1 long, w2 long, doc long, tie long, start long").distinct()
        windows = stored(windows, "suffix-windows")
        first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "tie", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        later = windows.join(first, ["w1", "w2"]).filter(F.struct("doc", "tie", "start") != F.col("first"))
        out = out.unionByName(later.select("doc", "tie", F.shiftleft("start", 16).bitwiseOR(F.lit(1).cast("long")).alias("pos")))
    check = check.drop("kind").repartition("akey").sortWithinPartitions("akey", "doc", "tie", "pos")
    return out.unionByName(check.mapInArrow(_compare, "doc long, tie long, pos long"))


def spans_of(pos: np.ndarray, n_bytes: int) -> np.ndarray:
    """Maximal removed byte runs (start, end) from removed runs of windows."""
    if not len(pos):
        return np.zeros((0, 2), np.int64)
    pos = np.sort(pos)
    start = pos >> 16
    end = np.minimum(np.maximum.accumulate(start + (pos & 255) - 1 + LENGTH), n_bytes)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return np.stack([start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1)


def _apply(kept_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_view(b.column("text"))
            lists = b.column("runs")
            cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            empty = ~lists.is_valid().to_numpy(zero_copy_only=False)
            n_removed, n_spans, sha, kept = [], [], [], []
            for i in range(len(b)):
                data = raw[at[i] : at[i + 1]]
                spans = spans_of(flat[cuts[i] : cuts[i + 1]] if not empty[i] else flat[:0], len(data))
                n_removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
                n_spans.append(len(spans))
                if len(spans):
                    mask = np.ones(len(data), bool)
                    for s, e in spans:
                        mask[s:e] = False
                    data = data[mask]
                data = data.tobytes()
                if kept_text:
                    kept.append(data.decode("utf-8", "ignore"))
                else:
                    sha.append(hashlib.sha256(data).hexdigest())
            if kept_text:
                old = b.column("text")
                text = [k if n else o for k, n, o in zip(kept, n_removed, old.to_pylist(), strict=True)]
                cols = {c: b.column(c) for c in b.schema.names if c != "runs"} | {"text": pa.array(text, pa.string())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _with_runs(spark: SparkSession, docs: DataFrame, hot_runs: int) -> DataFrame:
    keyed, repeated = _keyed(docs)
    gone = removed_runs(spark, keyed, hot_runs, repeated).groupBy("doc", "tie").agg(F.collect_list("pos").alias("runs"))
    return keyed.join(gone, ["doc", "tie"], "left").drop("doc", "tie")


def remove_repeats(spark: SparkSession, docs: DataFrame, hot_runs: int = HOT) -> DataFrame:
    """docs with the repeated bytes of `text` taken out; a character that loses some of
    its bytes goes as a whole. All rows and other columns stay."""
    clash = {c: f"_own_{c}" for c in docs.columns if c in ("doc", "tie", "runs")}
    wide = _with_runs(spark, docs.withColumnsRenamed(clash), hot_runs)
    schema = wide.drop("runs").schema
    return wide.mapInArrow(_apply(True), schema).withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def removal_report(spark: SparkSession, docs: DataFrame, hot_runs: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    wide = _with_runs(spark, docs.select("doc_id", "text"), hot_runs)
    return wide.select(F.col("doc_id").cast("long"), "text", "runs").mapInArrow(_apply(False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (
  SELECT doc_id, s, substr(x, 2 * s + 1, {2 * LENGTH}) AS g FROM d, unnest(range(0, n - {LENGTH - 1})) AS u(s)),
r AS (
  SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
i AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {LENGTH} THEN 0 ELSE 1 END AS new FROM r),
j AS (
  SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM i),
spans AS (
  SELECT doc_id, run, min(s) AS a, max(s) + {LENGTH} AS b FROM j GROUP BY ALL),
parts AS (
  SELECT spans.doc_id, run, coalesce(lag(b) OVER (PARTITION BY spans.doc_id ORDER BY run), 0) AS prev, a, b FROM spans),
kept AS (
  SELECT p.doc_id, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY run) AS head,
         max(b) AS last, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed
  FROM parts p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
