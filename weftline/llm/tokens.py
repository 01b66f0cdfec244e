"""Token ids in binary shards, coded by a static range asymmetric numeral system (rANS).

A shard holds whole documents in id order. Its tokens share one frequency table, counted over all of
them; blocks of 2**18 tokens are coded independently, each by 512 interleaved states over one stream
of 32-bit words, so any block can be decoded alone. The directory has, for each block, its place, its
first token (the checkpoint) and the CRC-32 of its ids.

    magic | blocks | table | documents | directory | footer: offsets, scale, CRC-32 of what precedes it, magic
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, open_input, open_output, written

MAGIC = b"WFTOK01\n"
FOOTER = struct.Struct("<QQQQQIII8s")
BLOCK, LANES, LOW, MIN_SCALE = 1 << 18, 512, np.uint64(1 << 31), 18
#: A shard is closed once it has so many tokens, after the texts that were encoded together (SLICE_BYTES, or a single longer one).
SHARD_TOKENS = 4_000_000
#: Bytes of texts that are encoded together, at most: a word that they repeat is looked up once.
SLICE_BYTES = 4 << 20
#: Distinct words whose ids a worker keeps from one task to the next; those of the slice at hand may come on top.
CACHE = 300_000
END_ID = 2
#: Parts of a manifest whose offsets are summed together, and tasks that read shards at most.
GROUP, MOST_TASKS = 1024, 50_000


# ---- the coder


def normalised(counts: np.ndarray, scale: int) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each id that occurs."""
    target, total = 1 << scale, int(counts.sum())
    f = np.where(counts > 0, np.maximum(1, counts * target // max(total, 1)), 0).astype(np.int64)
    over = int(f.sum()) - target
    if over <= 0:
        f[int(counts.argmax())] -= over
        return f
    for i in np.argsort(-f, kind="stable"):
        cut = min(over, int(f[i]) - 1, max(1, int(f[i]) // 2))
        f[i] -= cut
        over -= cut
        if not over:
            return f
    raise ValueError("more ids than slots")


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray, scale: int) -> bytes:
    lanes = min(LANES, max(1, len(ids)))
    x = np.full(lanes, LOW, np.uint64)
    shift, low32, up = np.uint64(63 - scale), np.uint64(0xFFFFFFFF), np.uint64(scale)
    words = []
    f_all, c_all = freq[ids], cum[ids]
    for at in range((len(ids) - 1) // lanes * lanes if len(ids) else -1, -1, -lanes):
        f, c = f_all[at : at + lanes], c_all[at : at + lanes]
        y = x[: len(f)]
        full = y >= (f << shift)
        if full.any():
            words.append((y[full] & low32).astype("<u4"))
            y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[: len(f)] = (q << up) + (y - q * f) + c
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return struct.pack("<II", len(ids), lanes) + x.astype("<u8").tobytes() + stream.tobytes()


def decode_block(data: bytes, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray, scale: int) -> np.ndarray:
    n, lanes = struct.unpack_from("<II", data)
    x = np.frombuffer(data, "<u8", lanes, 8).astype(np.uint64)
    stream = np.frombuffer(data, "<u4", -1, 8 + 8 * lanes).astype(np.uint64)
    out, at, mask, up = np.empty(n, np.uint32), 0, np.uint64((1 << scale) - 1), np.uint64(scale)
    for p in range(0, n, lanes):
        y = x[: n - p]
        slot = y & mask
        s = slots[slot]
        out[p : p + lanes] = s
        y = freq[s] * (y >> up) + slot - cum[s]
        low = np.flatnonzero(y < LOW)
        if len(low):
            y[low] = (y[low] << np.uint64(32)) | stream[at : at + len(low)]
            at += len(low)
        x[: len(y)] = y
    return out


# ---- shard files


def write_shard(out, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
    counts = np.bincount(ids, minlength=1)
    scale = max(MIN_SCALE, int(np.count_nonzero(counts)).bit_length() + 2)
    freq = normalised(counts, scale)
    f, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    parts, directory, at = [MAGIC], [], len(MAGIC)
    for first in range(0, len(ids), BLOCK):
        block = ids[first : first + BLOCK]
        data = encode_block(block, f, cum, scale)
        directory.append((at, len(data), first, len(block), zlib.crc32(block.astype("<u4").tobytes())))
        parts.append(data)
        at += len(data)
    used = np.flatnonzero(freq)
    table = zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes() + freq[used].astype("<u4").tobytes())
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + lengths.astype("<u4").tobytes())
    where = zlib.compress(np.array(directory, "<u8").tobytes())
    parts += [table, docs, where]
    places = (at, at + len(table), at + len(table) + len(docs), len(doc_ids), len(directory))
    for p in parts:
        out.write(p)
    out.write(FOOTER.pack(*places, scale, len(used), zlib.crc32(table + docs + where), MAGIC))


class Shard:
    """A shard file read by ranges: the footer, then what it points to, then single blocks."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        table, docs, where, n_docs, n_blocks, self.scale, used, crc, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a token shard")
        self.file.seek(table)
        tail = self.file.read(size - FOOTER.size - table)
        if zlib.crc32(tail) != crc:
            raise ValueError(f"{uri}: its tables are damaged")
        t = np.frombuffer(zlib.decompress(tail[: docs - table]), "<u4").astype(np.int64)
        d = zlib.decompress(tail[docs - table : where - table])
        self.directory = np.frombuffer(zlib.decompress(tail[where - table :]), "<u8").reshape(n_blocks, 5).astype(np.int64)
        symbols, f = np.cumsum(t[:used]), t[used:]
        top = int(symbols[-1]) + 1 if used else 1
        self.freq, self.cum = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.freq[symbols], self.cum[symbols] = f, np.cumsum(f) - f
        self.slots = np.repeat(symbols, f).astype(np.uint32)
        known = np.frombuffer(d, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(d, "<i8", n_docs), known)]
        self.lengths = np.frombuffer(d, "<u4", n_docs, 9 * n_docs).astype(np.int64)

    def block(self, n: int) -> np.ndarray:
        at, size, _, length, crc = (int(v) for v in self.directory[n])
        self.file.seek(at)
        ids = decode_block(self.file.read(size), self.freq, self.cum, self.slots, self.scale)
        if len(ids) != length or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {n} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, first token in the shard, tokens, CRC-32 of the ids; holds one block at a time."""
        n, block, base, at = -1, np.zeros(0, "<u4"), 0, 0
        for doc_id, length in zip(self.doc_ids, self.lengths):
            crc, start, end = 0, at, at + int(length)
            while at < end:
                if at >= base + len(block):
                    base, n = base + len(block), n + 1
                    block = self.block(n).astype("<u4")
                to = min(end, base + len(block))
                crc, at = zlib.crc32(block[at - base : to - base].tobytes(), crc), to
            yield doc_id, start, int(length), crc


# ---- tokens


class Encoder:
    """Ids of texts by the tokenizers library, with the ids of pieces between spaces kept.

    This tokenizer never joins anything over a space or line feed, and takes letters apart from the
    marks after them; so a piece has the same ids wherever it stands, and so have its letters. New
    words go to the library many at a time: each has one token that ends a word, which shows where the
    next one begins (else they are encoded one by one). Any other piece is encoded as it is.
    """

    _CUT = r"^(?P<core>[^.,!?:;*#$%&]*)(?P<tail>[.,!?:;*#$%&]*)$"
    #: Words that the normalizer and the pattern of the tokenizer leave whole: lower-case letters of one code point, none of them a mark.
    _SIMPLE = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.simple = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.simple.normalizer = None
        self.simple.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.number: dict[str, int] = {"": 0}
        self.flat, self.size, self.seen = np.zeros(0, np.uint32), np.zeros(1, np.int32), np.zeros(1, np.int32)

    def forget(self) -> None:
        """Keeps the pieces that two slices at least had since the last time, and at most half of CACHE: texts share them, most others are met once."""
        self.seen[0] = 2
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > CACHE // 2:
            keep = np.r_[0, np.sort(keep[1:][np.argsort(-self.seen[keep[1:]], kind="stable")[: CACHE // 2 - 1]])]
        names = list(self.number)
        self.flat = self.flat[ranges(self.first[keep], self.size[keep])]
        self.size, self.seen = self.size[keep], np.zeros(len(keep), np.int32)
        self.number = {names[i]: n for n, i in enumerate(keep.tolist())}

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.size, dtype=np.int64) - self.size

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces))))
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.seen = np.concatenate([self.seen, np.zeros(len(pieces), np.int32)])
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self, pieces: list[str]) -> None:
        simple: list[str] = []
        words: list[str] = []
        rest: list[str] = []
        for p in pieces:
            (simple if self._SIMPLE.fullmatch(p) else words if p.isalpha() else rest).append(p)
        known: list[tuple[list[str], np.ndarray, np.ndarray]] = []
        for tokenizer, kind in ((self.simple, simple), (self.tokenizer, words)):
            for i in range(0, len(kind), 5000):
                own = kind[i : i + 5000]
                ids = np.array(tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(own) and last[-1] == len(ids) - 1:
                    known.append((own, ids, np.diff(last, prepend=-1)))
                else:
                    rest += own
        if rest:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            known.append((rest, np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)))
        names, ids, sizes = zip(*known)
        self._add([n for own in names for n in own], np.concatenate(ids), np.concatenate(sizes))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces; new ones are learnt. Each is looked up once."""
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.number.get, names, repeat(-1)), np.int32, len(names))
        new = np.flatnonzero(known < 0)
        if len(new):
            fresh = [names[i] for i in new]
            self._learn(fresh)
            known[new] = np.fromiter(map(self.number.__getitem__, fresh), np.int32, len(fresh))
        self.seen[known] += 1
        return known

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths (with the end id) and all ids of texts; a null is empty."""
        import pyarrow.compute as pc

        if len(self.number) > CACHE:
            self.forget()
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        pieces = lists.flatten().dictionary_encode()
        del lists
        found, own = pieces.indices.to_numpy(), pieces.dictionary
        cut = pc.extract_regex(own, self._CUT)
        core, tail = cut.field("core"), cut.field("tail")
        plain = pc.fill_null(pc.and_(cut.is_valid(), pc.or_(pc.equal(core, ""), pc.utf8_is_alpha(core))), False)
        core = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core)
        core, tail = pc.if_else(plain, core, own).dictionary_encode(), pc.if_else(plain, tail, "").dictionary_encode()
        # of each distinct piece, then of the end: where its ids are in flat, the core's before the tail's
        both = np.stack([self._numbers(d.dictionary)[d.indices.to_numpy()] for d in (core, tail)], 1).ravel()
        size = self.size[both]
        flat = np.append(self.flat[ranges(self.first[both], size)], np.uint32(end_id))
        size = np.append(size.reshape(-1, 2).sum(1), 1)
        # each text's pieces and then the end
        at = np.insert(found, bounds[1:], len(size) - 1)
        n = size[at]
        ids = flat[ranges((np.cumsum(size) - size)[at], n)]
        ends = np.cumsum(n, dtype=np.int64)[bounds[1:] + np.arange(len(texts))]
        return np.diff(ends, prepend=0), ids


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., size numbers, of each pair in turn."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(first.max(initial=0))) < 2**31 else np.int64
    out = np.repeat((first - (ends - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts of SLICE_BYTES of text at most, or a single longer row."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


@lru_cache(1)
def kept_encoder(path: str) -> Encoder:
    """The encoder of path, one for all tasks of a Python worker: words that a task has learnt serve those after it. A task that fails ends its worker."""
    return Encoder(path)


def write_tokens(docs: DataFrame, tokenizer_path: str | None, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes the shards of docs into folder, in ascending doc_id order, and returns their manifest.

    Manifest: part, seq (their order), uri, n_docs, n_tokens; it is a written table. A shard's name is
    new for each attempt of a task and only shards that the manifest names count, so a lost executor
    costs its own tasks. Null ids come first; a null text is empty and has the end id alone; rows that
    repeat an id are all written; an empty table gives no shards; extra columns are ignored. A long text is one array of ids of its task.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, state = TaskContext.get().partitionId(), None, {"seq": 0}
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close():
            uri = f"{folder}/{part:06d}-{state['seq']:06d}-{uuid.uuid4().hex}.tok"
            all_ids = np.concatenate(ids)
            with open_output(uri) as out:
                write_shard(out, doc_ids, np.concatenate(lengths), all_ids)
            row = pa.record_batch({"part": [part], "seq": [state["seq"]], "uri": [uri], "n_docs": [len(doc_ids)], "n_tokens": [len(all_ids)]}, schema=MANIFEST)
            state["seq"] += 1
            doc_ids.clear(), lengths.clear(), ids.clear()
            return row

        for batch in batches:
            encoder = encoder or kept_encoder(tokenizer_path or tokenizer_file())  # found where it is opened
            for b in slices(batch):
                n, tokens = encoder.encode(b["text"], end_id)
                doc_ids += b["doc_id"].to_pylist()
                lengths.append(n)
                ids.append(tokens)
                if sum(map(len, ids)) >= SHARD_TOKENS:
                    yield close()
        if doc_ids:
            yield close()
        pa.default_memory_pool().release_unused()  # the worker waits for its next task

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return written(ordered.mapInArrow(write, "part int, seq int, uri string, n_docs long, n_tokens long"), "token-manifest")


MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of the shards, decoded: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are checked against their checksums; a document is as long as it is, a block at a time is held.
    """
    spark = manifest.sparkSession
    # offsets in two levels, so that neither the driver nor a task sees a row of each shard: groups of parts, then shards within one
    grouped = manifest.withColumn("g", F.floor(F.col("part") / GROUP))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("g").agg(F.sum("n_tokens").alias("n")).select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("g").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.withColumn("at", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(groups, "g").select("uri", (F.col("base") + F.col("at")).alias("start"))
    shards = placed.repartition(max(1, min(manifest.count(), MOST_TASKS)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist()):
                rows = [(d, start + s, n, crc) for d, s, n, crc in Shard(uri).documents()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_and_read(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    manifest = write_tokens(docs, tokenizer_path, new_path(docs.sparkSession, "tokens"))
    return read_tokens(manifest)


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    return write_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
