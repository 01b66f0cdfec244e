"""Removal of byte strings that an earlier document has, by run-length indexes of the repeated parts.

A 50-byte string is filed under the smallest hash of its 16-byte grams, its anchor; neighbours with
the same anchor form one segment. Equal strings have equal anchors, so anchors that two documents
have lead to every repeat, and only their segments are indexed. Equal segments meet first as one row
with the smallest id that has them. For each group of anchors a run-compressed Burrows-Wheeler
transform is built over the distinct segments, with samples of the least id at the heads of the intervals of
rows that agree on 50 bytes; every segment is streamed backwards through it in lockstep, and where
its row lies in such an interval the match there has at least 50 bytes and the sample says since which document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, release, text_of, written

LENGTH, GRAM = 50, 16
#: Windows of a segment at most; a longer run of one anchor is cut into several.
SEGMENT = 256
#: Bytes of distinct segments that are indexed together; an anchor that has more goes by parts of the
#: hashes of its windows, each with its own index.
INDEX_BYTES = 1 << 20
#: An anchor that more texts than this have is hot: its windows are filed one by one under keys of their own, so that no task gets them all.
HOT = 20_000
#: Bytes of texts in a partition, about.
PART_BYTES = 16 << 20
_MUL = np.array([0x9E3779B97F4A7C15], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def window_anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window of length bytes, by its start; data is uint8."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    h, m, size = data.astype(np.uint64) + np.uint64(1), _MUL, 1
    while size < gram:
        h, m, size = h[:-size] * m + h[size:], m * m, 2 * size
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h &= ~np.uint64(1)  # the last bit marks hot anchors in lists
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    return np.minimum(h[: len(h) - (width - size)], h[width - size :])


def segments(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and end of windows of each segment of data."""
    a = window_anchors(np.frombuffer(data, np.uint8), length)
    if not len(a):
        return a, np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(len(a), bool)
    change[0] = True
    np.not_equal(a[1:], a[:-1], out=change[1:])
    first = change.nonzero()[0]
    end = np.empty_like(first)
    end[:-1], end[-1] = first[1:], len(a)
    if (end - first).max() > SEGMENT:
        pieces = -(-(end - first) // SEGMENT)
        n = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stop, first = np.repeat(end, pieces), np.repeat(first, pieces) + n * SEGMENT
        end = np.minimum(first + SEGMENT, stop)
    return a[first], first, end


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of segments, each ended by its own sign.

    Rows are the suffixes in order. Kept are the runs of the transform (first row, where the run maps to) and, of the rows that agree
    on length bytes, an interval with one sample at its end: the least id among them. length is 7 at least.
    """

    def __init__(self, parts: list[bytes], ids: np.ndarray, length: int = LENGTH):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        stops = np.cumsum(sizes + 1) - 1
        n = int(stops[-1]) + 1
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
        text[stops] = 0
        of = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + 1)
        left = (np.repeat(stops, sizes + 1) - np.arange(n)).astype(np.int32)  # bytes up to the sign

        # rank by 7 bytes, then 14, 28, 56 and so on; a suffix that reaches its sign is unlike any other.
        # A rank is the first row of its group, and only groups of several rows are sorted again.
        size, key = 7, text.astype(np.int64)
        for step, cut in ((1, 0), (2, 0), (4, 1)):  # 2, 4 and 7 bytes
            tail = key[step:] * (left[:-step] >= step)
            key <<= 9 * (step - cut)
            key[:-step] |= tail >> 9 * cut
        order = np.argsort(key)
        short = left[order] < size
        at = np.flatnonzero(short)
        order[at] = order[at][np.lexsort((order[at], key[order[at]]))]
        new = np.ones(n, bool)
        sorted_key = key[order]
        new[1:] = (sorted_key[1:] != sorted_key[:-1]) | short[1:]
        rank = np.empty(n, np.int32)  # an index has far fewer bytes
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
        half = None
        while True:
            if half is None and size <= length < 2 * size:
                half, half_size = rank.copy(), size
            tied = np.flatnonzero(~new | np.r_[~new[1:], False])
            if not len(tied):
                if half is not None:
                    break
                size *= 2
                continue
            own = order[tied]
            pair = rank[own].astype(np.int64) * (n + 1) + np.where(left[own] >= size, rank[np.minimum(own + size, n - 1)], 0)
            sort = np.argsort(pair)
            order[tied], own, pair = own[sort], own[sort], pair[sort]
            new[tied] = np.r_[True, pair[1:] != pair[:-1]]
            rank[own] = np.maximum.accumulate(np.where(new[tied], tied, 0))
            size *= 2
        before = text[order - 1]  # 0 for the first byte of a part, as a sign (the last one, for the first part) is before it

        head = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        counts = np.bincount(before, minlength=257)
        starts = np.cumsum(counts) - counts
        run_sizes, signs = np.diff(np.r_[head, n]), before[head]
        by_sign = np.argsort(signs, kind="stable")
        to = np.empty(len(head), np.int64)
        to[by_sign] = np.cumsum(run_sizes[by_sign]) - run_sizes[by_sign]
        self.head, self.to = head, to
        self.run_of = np.repeat(np.arange(len(head), dtype=np.int32), run_sizes)  # where a row's run is found

        second = half[np.minimum(order + length - half_size, n - 1)]
        a, full = half[order], left[order] >= length
        new = np.r_[True, (a[1:] != a[:-1]) | (second[1:] != second[:-1]) | ~full[1:] | ~full[:-1]]
        self.interval = np.flatnonzero(new)
        self.least = np.minimum.reduceat(ids[of[order]], self.interval)
        self.interval_of = np.cumsum(new, dtype=np.int32) - 1
        self.sizes = sizes
        self.length = length

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Least id that has each window: values of all parts in turn, and where each part's begin.

        The row of sign i is row i; each step maps the rows of all parts one byte back.
        """
        windows = np.maximum(self.sizes - self.length + 1, 0)
        begin = np.cumsum(windows) - windows
        out = np.empty(int(windows.sum()), np.int64)
        by_size = np.argsort(-self.sizes, kind="stable")
        sorted_sizes = -self.sizes[by_size]
        rows = by_size.astype(np.int64)
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            alive = int(np.searchsorted(sorted_sizes, -step, "right"))
            rows = rows[:alive]
            run = self.run_of[rows]
            rows = self.to[run] + rows - self.head[run]
            if step >= self.length:
                which = by_size[:alive]
                out[begin[which] + self.sizes[which] - step] = self.least[self.interval_of[rows]]
        return out, begin


def least_ids(parts: list[bytes], ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """RunIndex(parts).stream(). More parts than an index should have go by their windows, sorted in shares of equal hashes: time in proportion to size."""
    total = sum(map(len, parts))
    if total <= 2 * INDEX_BYTES:
        return RunIndex(parts, ids, length).stream()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    n = np.maximum(sizes - length + 1, 0)
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(parts)), n)
    at = (np.cumsum(sizes) - sizes)[of] + np.arange(len(of)) - begin[of]  # where each window begins in all bytes
    data = np.frombuffer(b"".join(parts), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    h, m, size = data.astype(np.uint64) + np.uint64(1), _MUL, 1
    while 2 * size <= length:  # equal windows have equal hashes of their first 32 bytes
        h, m, size = h[:-size] * m + h[size:], m * m, 2 * size
    order = np.argsort(h[at], kind="stable")
    hs = h[at][order]
    group = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    out = np.empty(len(of), np.int64)
    step = max(1, INDEX_BYTES // length)
    cuts = [0]
    for g in group:  # shares of whole groups
        if g - cuts[-1] >= step:
            cuts.append(int(g))
    for a, z in zip(cuts, [*cuts[1:], len(of)]):
        own = order[a:z]
        rows = np.ascontiguousarray(windows[at[own]]).view(f"V{length}").ravel()
        _, same = np.unique(rows, return_inverse=True)
        least = np.full(int(same.max()) + 1, LAST_ID, np.int64)
        np.minimum.at(least, same, ids[of[own]])
        out[own] = least[same]
    return out, begin


def _bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [b or b"" for b in batch[column].cast(pa.binary()).to_pylist()]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows h, th in order: the distinct rows of each h that has two th; of one that has over HOT, h with its last bit set.

    Holds a batch and HOT rows of one h at most: once an h is known to be hot, its rows are passed on as they come.
    """
    h0, p0 = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot = False  # whether the h that is held is hot; then only its last row is held

    def sent(h: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"th": p, "h": h})

    for batch in batches:
        held = len(h0)
        h, p = np.r_[h0, batch["h"].to_numpy()], np.r_[p0, batch["th"].to_numpy()]
        new = np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])]
        h, p = h[new], p[new]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        number = np.repeat(np.arange(len(start)), size)
        marked = np.where(size > HOT, 1, 0)
        use = size[number] > 1
        if hot:  # the row that is held was passed on before
            marked[0] = 1
            use[start[0] : start[0] + size[0]] = True
            use[: min(held, 1)] = False
        last = number == len(start) - 1
        hot = bool(marked[-1])
        now = use if hot else use & ~last
        yield sent(h[now] | marked[number[now]], p[now])
        h0, p0 = (h[-1:], p[-1:]) if hot else (h[last], p[last])
    if not hot and len(h0) > 1:
        yield sent(h0, p0)


def _seg_hash(seg: bytes) -> int:
    return xxhash.xxh3_64_intdigest(seg) - 2**63


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows anchor, seg, low, high in order of anchor and seg: runs of windows and the least id of each."""
    held: list[list] = []

    def flush(rows: list[list]) -> pa.RecordBatch:
        anchor, seg, low, high = zip(*rows)
        low, high = np.array(low), np.array(high)
        values, begin = least_ids(list(seg), low)
        of = np.repeat(np.arange(len(rows)), np.r_[begin[1:], len(values)] - begin)
        new = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (of[1:] != of[:-1])])
        stop = np.r_[new[1:], len(values)]
        use = values[new] < high[of[new]]
        new, stop = new[use], stop[use]
        o = of[new]
        hashes = np.fromiter(map(_seg_hash, seg), np.int64, len(seg))
        return pa.record_batch({"anchor": (np.array(anchor, np.int64)[o] & 0x7FFFFFFF).astype(np.int32), "seg_hash": hashes[o], "f": (new - begin[o]).astype(np.int32), "t": (stop - begin[o]).astype(np.int32), "m": values[new]})

    size = 0
    for batch in batches:
        for anchor, seg, low, high in zip(*(batch[c].to_numpy(zero_copy_only=False).tolist() for c in ("anchor", "seg", "low", "high"))):
            last = held[-1] if held else None
            if last and last[0] == anchor and last[1] == seg:
                last[2], last[3] = min(last[2], low), max(last[3], high)
                continue
            if size >= INDEX_BYTES and anchor != last[0]:
                yield flush(held)
                held, size = [], 0
            held.append([anchor, seg, low, high])
            size += len(seg)
    if held:
        yield flush(held)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            b = batch.slice(i, 500)
            own = [np.unique(window_anchors(np.frombuffer(t, np.uint8))) for t in _bytes_of(b, "text")]
            sizes = [len(o) for o in own]
            if sum(sizes):
                yield pa.record_batch({"h": np.concatenate(own).view(np.int64), "th": np.repeat(b["th"].to_numpy(), sizes)})


def _shared_segments(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Row of batch (text, hs), and anchor, first window and bytes of each segment whose anchor is in hs.

    Segments of hot anchors come as single windows, each under a key of its own bytes: equal ones meet all the same.
    """
    for i in range(0, batch.num_rows, 200):
        b = batch.slice(i, 200)
        for j, (text, hs) in enumerate(zip(_bytes_of(b, "text"), b["hs"])):
            a, first, end = segments(text)
            asked = np.sort(hs.values.to_numpy().view(np.uint64))
            marked = asked & np.uint64(1)
            asked &= ~np.uint64(1)  # in order still
            hot = asked[marked > 0] if marked.any() else asked[:0]
            use = (asked[np.minimum(np.searchsorted(asked, a), len(asked) - 1)] == a).nonzero()[0] if len(asked) else np.zeros(0, np.int64)
            if len(hot):
                single = np.isin(a[use], hot)
                use, alone = use[~single], use[single]
            own = [(x, f, text[f : e + LENGTH - 1]) for x, f, e in zip(a[use].view(np.int64).tolist(), first[use].tolist(), end[use].tolist())]
            if len(hot):
                for k in alone.tolist():
                    for w in range(int(first[k]), int(end[k])):
                        seg = text[w : w + LENGTH]
                        own.append((xxhash.xxh3_64_intdigest(seg, seed=1) - 2**63, w, seg))
            yield i + j, own


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the least and greatest id, combined over each batch: copies within it cost one row."""
    for batch in batches:
        ids, seen = batch["id"].to_pylist(), {}
        for row, own in _shared_segments(batch):
            i = ids[row]
            for anchor, _, seg in own:
                known = seen.get(seg)
                if known is None:
                    seen[seg] = [anchor, seg, i, i]
                else:
                    known[2], known[3] = min(known[2], i), max(known[3], i)
        if seen:
            anchor, seg, low, high = zip(*seen.values())
            yield pa.record_batch({"anchor": pa.array(anchor, pa.int64()), "seg": pa.array(seg, pa.binary()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"anchor": pa.int32(), "seg_hash": pa.int64(), "id": pa.int64(), "pk": pa.int64(), "th": pa.int32(), "at": pa.int32()}
    for batch in batches:
        key = list(zip(*(batch[c].to_pylist() for c in ("id", "pk", "th"))))
        rows = [(anchor & 0x7FFFFFFF, _seg_hash(seg), *key[row], f) for row, own in _shared_segments(batch) for anchor, f, seg in own]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (pk, id, th, text) in partitions by pk, and spans (pk, th, b, e) of bytes to remove, which may overlap.

    Equal texts are told apart from others by SHA-256; only the one with the smallest id is looked into, and
    the others go whole. Anchors are counted by the texts' 64-bit hashes. Two steps shuffle the texts by
    pk, the second drops the shuffle of the first; only lists of anchors and marks are kept between them.
    """
    spark = docs.sparkSession
    key = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_of().alias("text"))
    key = key.select(F.when(F.col("id") == LAST_ID, F.xxhash64("text")).otherwise(F.col("id")).alias("pk"), "id", F.xxhash64("text").alias("th"), "text")
    each = written(key.select("pk", "id", "th", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n")).distinct(), "repeats-keys")
    size = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES), 1)  # partitions don't grow with the input
    first = each.groupBy("sha").agg(F.min("id").alias("first"))
    ranked = each.join(first, "sha")
    own = ranked.where("id = first").select("pk", "th").distinct()
    copies = ranked.where("id > first").select("pk", short_hash().alias("th"), "n")

    anchors = key.select("th", "text").mapInArrow(_anchors, "h long, th long")
    shared = anchors.repartition(parts, "h").sortWithinPartitions("h", "th").mapInArrow(_repeated, "th long, h long")
    lists = shared.groupBy("th").agg(F.collect_list("h").alias("hs")).join(own, "th").groupBy("pk").agg(F.flatten(F.collect_list("hs")).alias("hs"))
    lists = written(lists, "repeats-anchors")
    release(spark)

    # what the texts are joined with has as many partitions: else Spark shuffles them anew for each join
    texts = key.withColumn("th", short_hash()).repartition(parts, "pk")
    found = texts.join(lists.repartition(parts, "pk").hint("shuffle_hash"), "pk").select("pk", "id", "th", "text", "hs")
    distinct = found.mapInArrow(_distinct, "anchor long, seg binary, low long, high long").repartition(parts, "anchor").sortWithinPartitions("anchor", "seg")
    marks = written(distinct.mapInArrow(_marks, "anchor int, seg_hash long, f int, t int, m long"), "repeats-marks")
    release(spark)

    places = found.mapInArrow(_places, "anchor int, seg_hash long, id long, pk long, th int, at int")
    spans = places.join(marks, ["anchor", "seg_hash"]).where("m < id").select("pk", "th", (F.col("at") + F.col("f")).cast("long").alias("b"), (F.col("at") + F.col("t") + LENGTH - 1).cast("long").alias("e"))
    return texts, spans.union(copies.where(F.col("n") >= LENGTH).select("pk", "th", F.lit(0).cast("long"), "n")).repartition(parts, "pk")


def short_hash():
    """32 bits of th: they only part texts of one pk."""
    return F.col("th").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Removes each byte that a LENGTH-byte string covers which also starts in a document with a smaller doc_id.

    Returns a row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept
    (binary) and spans (array of begin, end). A null text is empty; texts under LENGTH bytes lose
    nothing; a null doc_id comes after every id, and rows with equal or null ids don't take from each
    other; an empty table gives no rows; extra columns are ignored.
    """
    texts, spans = repeated_spans(docs)
    of = spans.groupBy("pk").agg(F.collect_list(F.struct("th", "b", "e")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                rows = []
                for doc_id, th, text, s in zip(b["doc_id"].to_pylist(), b["th"].to_pylist(), _bytes_of(b, "text"), b["spans"].to_pylist()):
                    merged: list[list[int]] = []
                    for x, y in sorted((v["b"], v["e"]) for v in s or () if v["th"] == th):
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], y)
                        else:
                            merged.append([x, y])
                    at, kept = 0, []
                    for x, y in merged:
                        kept.append(text[at:x])
                        at = y
                    kept = b"".join([*kept, text[at:]])
                    rows.append((doc_id, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), *([kept, [{"b": x, "e": y} for x, y in merged]] if with_text else [])))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + ([pa.binary(), pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))] if with_text else [])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept", "spans"] if with_text else [])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<b:long,e:long>>" if with_text else "")
    # the same columns of texts as in repeated_spans, so that Spark reuses their shuffle
    rows = texts.join(of.hint("shuffle_hash"), "pk", "left")
    return rows.select(F.when(F.col("id") < LAST_ID, F.col("id")).alias("doc_id"), "th", "text", "spans").mapInArrow(remove, schema)


def op2_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), part AS (
  SELECT doc_id, c, substr(h, CAST(2000 * c + 1 AS BIGINT), 2098) AS h FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2000 + 1 AS BIGINT))) AS c FROM d)
), w AS MATERIALIZED (
  SELECT doc_id, 1000 * c + p AS p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s
  FROM (SELECT doc_id, c, h, unnest(range(0, least(1000, CAST(length(h) // 2 - 49 AS BIGINT)))) AS p FROM part WHERE length(h) >= 100)
), f AS (
  SELECT s, min(doc_id) AS first FROM w GROUP BY s
), m AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (s) WHERE first < doc_id
), run AS (
  SELECT doc_id, min(p) AS b, max(p) + 50 AS e FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM m) GROUP BY doc_id, n
), gap AS (
  SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM run
), cut AS (
  SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (b - before) AS BIGINT)), '' ORDER BY b) AS kept
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
