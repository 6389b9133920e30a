"""Operator 5, token-id files: static range asymmetric numeral systems in interleaved, independent blocks.

Documents are encoded in ascending doc_id (null first, then by a hash of the text), an end id after each, and packed into files of
whole documents with about FILE_IDS ids. A file is a row of bytes in a Parquet table, so that any store that Spark
writes will do: magic, counts, one frequency table that all its blocks share, the documents' ids and lengths, then
blocks. A block has LANES interleaved coders of BLOCK ids in all, a crc32, and a checkpoint (all coders' states and
the place in the block's words) every MARK ids, from which decoding can start: a reader decodes all checkpoints of all
blocks of a file side by side. Null text is encoded as empty; repeated rows each get their own place, equal rows next to each other in any order. An
empty table gives no files and no rows. Columns other than doc_id and text are not read, whatever their names. A very
long text is encoded by one task and lies in one file, as many blocks as it needs.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bondsight.llm import shared
from bondsight.llm.arrays import flat, pieces, runs, word_hashes

END = 0
FILE_IDS, BLOCK, MARK, LANES = 1 << 21, 1 << 16, 1 << 14, 64
SCALE, LOW = 20, 1 << 31
MAGIC = b"BSRANS01"
CACHE = 400_000
FILE = "shard int, part int, n_ids long, n_docs long, data binary"
OUT = "shard int, part int, at long, doc_id long, n_tokens long, ids_crc32 long"


class Tokenizer:
    """The tokenizers library on whole batches: each distinct piece of text between its own boundaries is encoded once.

    The boundaries are those of byte-level pre-tokenization: contractions, runs of letters, numbers or other signs with
    one leading space, and white space. As in encode(text, add_special_tokens=False), the file's added tokens are cut out
    of each text before that, are one id each, and end what stands before them as a text's end does.
    """

    def __init__(self, path: str) -> None:
        import regex
        import tokenizers

        whole = tokenizers.Tokenizer.from_file(path)
        self.model = whole.model
        added = whole.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that hang on what stands around them are not built")
        self.added = {t.content.encode(): n for n, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.mark = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.cache: dict[int, bytes] = {}
        points = "".join(chr(x) if not 0xD800 <= x < 0xE000 else " " for x in range(0x110000))
        self.kind = np.zeros(0x110000, np.uint8)
        for n, of in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
            for m in regex.finditer(of, points):
                self.kind[m.start() : m.end()] = n
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        rest = [x for x in range(256) if x not in own]
        self.letters = {x: x for x in own} | {x: 256 + k for k, x in enumerate(rest)}

    def starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The byte at which each piece begins."""
        if not len(data):
            return np.zeros(0, np.int64)
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        n, kind = len(cp), self.kind[cp]
        head = np.zeros(n + 1, bool)
        head[np.searchsorted(at, off)] = True  # of a row
        head[n] = True
        new = head.copy()
        new[1:n] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(new[:n])
        end = np.append(run[1:], n)
        space = kind[run] == 3
        flag = np.zeros(n + 1, bool)
        flag[run[space]] = True
        inner = space & ~head[end]  # white space with something after it: its last sign stands alone or leads
        flag[end[inner] - 1] = True
        solid = run[~space]
        led = (solid > 0) & ~head[solid] & (cp[solid - 1] == 0x20)
        flag[solid[~led]] = True
        quote = run[(cp[run] == 0x27) & (end - run == 1)]
        quote = quote[flag[quote] & ~head[quote + 1]]
        quote = quote[kind[quote + 1] == 1] if len(quote) else quote
        for i in quote:
            two = "".join(map(chr, cp[i + 1 : i + 3])) if not head[i + 2] else chr(cp[i + 1])
            size = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if size:
                flag[i + 1] = False
                if not head[i + 1 + size] and kind[i + 1 + size] == 1:
                    flag[i + 1 + size] = True
        return at[np.flatnonzero(flag[:n])]

    def marks(self, raw: bytes, off: np.ndarray) -> np.ndarray:
        """Start and end of every added token, in order; none reaches over a row's end."""
        if not self.mark or not self.mark.search(raw):
            return np.zeros((0, 2), np.int64)
        rows = zip(off[:-1].tolist(), off[1:].tolist(), strict=True)
        return np.array([m.span() for a, b in rows for m in self.mark.finditer(raw, a, b)], np.int64).reshape(-1, 2)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each row's begin; every row has END added."""
        raw, known = data.tobytes(), []
        marks = self.marks(raw, off)
        start = self.starts(data, np.concatenate([off, marks.ravel()]))
        if len(marks):
            i = np.searchsorted(marks[:, 0], start, side="left") - 1  # the last that begins before
            start = start[(i < 0) | (start >= marks[i, 1])]
        end = np.append(start[1:], len(data)) if len(start) else start
        _, first, of = np.unique(h := word_hashes(data, start, end), return_index=True, return_inverse=True)
        for key, a, b in zip(h[first].tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            ids = self.cache.get(key)
            if ids is None:
                piece = raw[a:b]
                one = self.added.get(piece)
                ids = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))] if one is None else [one]
                ids = np.array(ids, np.uint16).tobytes()
                if len(self.cache) < CACHE:
                    self.cache[key] = ids
            known.append(ids)
        book = np.frombuffer(b"".join(known), np.uint16)
        at = np.concatenate([[0], np.cumsum([len(x) // 2 for x in known], dtype=np.int64)])
        n = np.diff(at)[of] if len(of) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(n)])
        ids = book[np.arange(begin[-1]) + np.repeat(at[of] - begin[:-1], n)] if len(of) else book
        rows = begin[np.searchsorted(start, off)]
        return np.insert(ids, rows[1:], END), rows + np.arange(len(rows))


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols present and their shares of 2 ** SCALE, none of them 0."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    share = 1 + count[symbols] * ((1 << SCALE) - len(symbols)) // count.sum()
    share[np.argmax(share)] += (1 << SCALE) - share.sum()
    return symbols.astype(np.uint16), share.astype(np.uint32)


def _laid(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids as (step, unit, lane), which of them are real, and units of `size` ids."""
    units = max(1, -(-len(ids) // size))
    full = np.zeros(units * size, ids.dtype)
    full[: len(ids)] = ids
    real = np.arange(units * size) < len(ids)
    shape = (units, size // LANES, LANES)
    return full.reshape(shape).swapaxes(0, 1), real.reshape(shape).swapaxes(0, 1), units


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bytes of one file. known: where doc_ids is not null."""
    symbols, share = frequencies(ids)
    freq, low = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
    freq[symbols], low[symbols] = share, np.cumsum(share) - share
    laid, real, units = _laid(ids, BLOCK)
    steps, per = len(laid), MARK // LANES
    state = np.full((units, LANES), LOW, np.uint64)
    put, word = np.zeros(laid.shape, bool), np.zeros(laid.shape, np.uint32)
    marks = np.zeros((steps // per, units, LANES), np.uint64)
    for t in range(steps - 1, -1, -1):
        f, c, live = freq[laid[t]], low[laid[t]], real[t]
        f = np.where(live, f, 1)
        put[t] = live & (state >= f << np.uint64(63 - SCALE))
        word[t] = state & np.uint64(0xFFFFFFFF)
        x = np.where(put[t], state >> np.uint64(32), state)
        state = np.where(live, (x // f << np.uint64(SCALE)) + x % f + c, state)
        if t % per == 0:
            marks[t // per] = state
    out = [MAGIC, struct.pack("<4I", len(ids), len(sizes), len(symbols), units), symbols.tobytes(), share.tobytes()]
    out += [doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), sizes.astype("<i8").tobytes()]
    for b in range(units):
        n = put[:, b].sum(1).cumsum()
        places = np.concatenate([[0], n[per - 1 : -1 : per]]).astype("<u4")
        crc = zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes())
        stream = word[:, b][put[:, b]]
        out += [struct.pack("<2I", len(stream), crc), places.tobytes(), marks[:, b].tobytes(), stream.tobytes()]
    return b"".join(out)


def decode_file(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, doc_ids, which of those are known, and lengths. Raises ValueError if a checksum, a checkpoint or the magic is wrong."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    n_ids, n_docs, n_sym, units = struct.unpack_from("<4I", blob, 8)
    at = 24

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    symbols, share = take("<u2", n_sym), take("<u4", n_sym)
    doc_ids, known, sizes = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<i8", n_docs)
    slot = np.repeat(np.arange(n_sym), share)
    freq, low = share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64)
    parts = BLOCK // MARK
    crcs, state, place, words, base = [], np.zeros((units, parts, LANES), np.uint64), np.zeros((units, parts), np.int64), [], 0
    for b in range(units):
        n, crc = take("<u4", 2)
        place[b] = take("<u4", parts).astype(np.int64) + base
        state[b] = take("<u8", parts * LANES).reshape(parts, LANES)
        words.append(take("<u4", n))
        base += int(n)
        crcs.append(crc)
    stream = np.append(np.concatenate(words), np.uint32(0))
    state, place = state.reshape(-1, LANES), place.reshape(-1)
    real = (np.arange(units * BLOCK) < n_ids).reshape(units * parts, MARK // LANES, LANES)
    after = np.concatenate([state.reshape(units, parts, LANES)[:, 1:], np.full((units, 1, LANES), LOW, np.uint64)], 1).reshape(-1, LANES)
    ids = np.zeros(real.shape, np.uint16)
    for t in range(MARK // LANES):
        here = (state & np.uint64((1 << SCALE) - 1)).astype(np.int64)
        s = slot[here]
        live = real[:, t]
        state = np.where(live, freq[s] * (state >> np.uint64(SCALE)) + here.astype(np.uint64) - low[s], state)
        need = live & (state < LOW)
        n = np.cumsum(need, axis=1)
        word = stream[np.minimum(place[:, None] + n - 1, len(stream) - 1)]
        state = np.where(need, state << np.uint64(32) | word.astype(np.uint64), state)
        place = place + n[:, -1]
        ids[:, t] = symbols[s]
    if (state != after).any():  # each checkpoint is where the one before it ends
        raise ValueError("a token file is damaged")
    ids = ids.reshape(-1)[:n_ids]
    for b, crc in enumerate(crcs):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {b} of a token file is damaged")
    return ids, doc_ids, known, sizes


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def _pack(path: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shard, part = tokenizer(path), TaskContext.get().partitionId(), 0
        ids, docs, known, sizes, held = [], [], [], [], 0

        def file() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            blob = encode_file(whole, np.concatenate(docs), np.concatenate(known), np.concatenate(sizes))
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "n_ids": len(whole), "n_docs": sum(map(len, docs)), "data": blob}], pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())]))

        for batch in pieces(batches):
            got, rows = of.encode(*flat(batch.column("text")))
            ids.append(got)
            sizes.append(np.diff(rows))
            known.append(batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            docs.append(batch.column("doc_id").fill_null(0).to_numpy())
            held += len(got)
            if held >= FILE_IDS:
                yield file()
                ids, docs, known, sizes, held, part = [], [], [], [], 0, part + 1
        if ids:
            yield file()

    return pack


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            ids, docs, known, sizes = decode_file(batch.column("data")[row].as_py())
            at = np.concatenate([[0], np.cumsum(sizes)])
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, batch.column("shard")[row].as_py()), pa.int32()), pa.array(np.full(n, batch.column("part")[row].as_py()), pa.int32()),
                pa.array(at[:-1], pa.int64()), pa.array(docs, pa.int64(), mask=~known), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()),
            ], names=["shard", "part", "at", "doc_id", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str) -> None:
    """Encode docs (doc_id, text) and write the files to `out`, in ascending doc_id over shards and parts."""
    shared.session(docs)
    docs = shared.documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    n = shared.bucket_count(docs, shared.text_bytes(docs), 24e6)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc()]  # hashes, as what is ordered by is sampled to the driver
    dealt = docs.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(_pack(tokenizer_path), FILE).write.parquet(out)


def read_tokens(spark, path: str) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32; every block's checksum is tested."""
    files = spark.read.schema(FILE).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_at"))
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.select("shard", "part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("part_at")).join(shards, "shard")
    docs = files.select("shard", "part", "data").mapInArrow(_unpack, OUT)
    return docs.join(parts, ["shard", "part"]).select("doc_id", (F.col("shard_at") + F.col("part_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
