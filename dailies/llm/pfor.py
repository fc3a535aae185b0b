"""Token ids in binary pages of patched frame-of-reference blocks."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dailies.llm.units import UnitTable

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Ids of a block, and the share of them that its width must hold; the rest are exceptions.
BLOCK, PERCENT = 512, 90
#: Ids after which a page ends (with the text that reaches it).
PAGE = 1 << 18
CHUNK = 1 << 20
MAGIC = b"PFOR0001"
LANES = 64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK unsigned numbers below 2^width as rows of little-endian 64-bit words; groups of 64 fill ``width`` words."""
    lanes = np.ascontiguousarray(values.astype(np.uint64).reshape(-1, LANES).T)
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for j in range(LANES):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.zeros((LANES, lanes.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(LANES):
        word, shift = divmod(j * width, 64)
        v = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (lanes[word + 1] << np.uint64(64 - shift))
        out[j] = v & mask
    return np.ascontiguousarray(out.T).reshape(len(words), BLOCK)


def write_blocks(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids as: count, number of blocks, start of each block, blocks.

    A block is its minimum (4 bytes), width (1), number of exceptions (2), the low bits of the differences, the places
    (2 bytes each) and the high bits (4 bytes each) of those that need more than ``width`` bits.
    """
    n = len(ids)
    count = -(-n // BLOCK)
    if not count:
        return struct.pack("<QI", 0, 0)
    full = np.empty(count * BLOCK, np.int64)
    full[:n], full[n:] = ids, ids[-1]
    full = full.reshape(count, BLOCK)
    base = full.min(1)
    diff = full - base[:, None]
    bits = np.frexp(diff.astype(np.float64))[1].astype(np.uint8)
    widths = np.maximum(1, np.partition(bits, BLOCK * PERCENT // 100 - 1, axis=1)[:, BLOCK * PERCENT // 100 - 1]).astype(np.int64)
    packed: list = [b""] * count
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        for r, words in zip(rows, _pack(diff[rows] & ((1 << int(w)) - 1), int(w))):
            packed[r] = words.astype("<u8").tobytes()
    over = bits > widths[:, None]
    blocks = []
    for r in range(count):
        at = np.flatnonzero(over[r])
        high = (diff[r, at] >> widths[r]).astype("<u4")
        blocks.append(struct.pack("<IBH", base[r], widths[r], len(at)) + packed[r] + at.astype("<u2").tobytes() + high.tobytes())
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]]).astype("<u4")
    return struct.pack("<QI", n, count) + starts.tobytes() + b"".join(blocks)


def read_blocks(data: bytes) -> np.ndarray:
    n, count = struct.unpack_from("<QI", data)
    starts = np.frombuffer(data, "<u4", count, 12)
    body = 12 + 4 * count
    out, widths, bases, late = np.empty((count, BLOCK), np.int64), np.empty(count, np.int64), np.empty(count, np.int64), []
    words: dict[int, list] = {}
    for r in range(count):
        at = body + int(starts[r])
        bases[r], w, patches = struct.unpack_from("<IBH", data, at)
        widths[r] = w
        words.setdefault(w, []).append((r, np.frombuffer(data, "<u8", BLOCK // 64 * w, at + 7)))
        if patches:
            late.append((r, at + 7 + BLOCK // 8 * w, patches))
    for w, rows in words.items():
        out[[r for r, _ in rows]] = _unpack(np.stack([x for _, x in rows]).astype(np.uint64), w).astype(np.int64)
    for r, at, patches in late:
        places = np.frombuffer(data, "<u2", patches, at)
        out[r, places] |= np.frombuffer(data, "<u4", patches, at + 2 * patches).astype(np.int64) << widths[r]
    return (out + bases[:, None]).reshape(-1)[:n]


def write_page(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Texts of a page: magic, number of texts, null marks, doc_ids (8 bytes), ids of each (4 bytes), then the blocks of all ids."""
    none = np.array([x is None for x in doc_ids], np.uint8)
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8")
    return MAGIC + struct.pack("<I", len(doc_ids)) + none.tobytes() + keys.tobytes() + counts.astype("<u4").tobytes() + write_blocks(ids)


def read_page(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    if data[:8] != MAGIC:
        raise ValueError("not a page of token ids")
    (n,) = struct.unpack_from("<I", data, 8)
    none = np.frombuffer(data, np.uint8, n, 12)
    keys = np.frombuffer(data, "<i8", n, 12 + n)
    counts = np.frombuffer(data, "<u4", n, 12 + 9 * n).astype(np.int64)
    return [None if x else int(k) for x, k in zip(none, keys)], counts, read_blocks(data[12 + 13 * n :])


class Words:
    """Ids of the tokenizers library, which is asked once for each distinct word met.

    The tokenizer drops white space and never joins what it separates, so a text is cut at plain blanks and line ends
    first; letters and the signs that close them are separate words to it too. Lower-casing of ASCII is its own.
    """

    #: Two signs in a row, which the tokenizer keeps together, and what only it takes for a sign, or lower-cases to a letter and a mark.
    SIGNS, HIDDEN = re.compile(r"[^\w\s][^\w\s]"), "_\x1c\x1d\x1e\x1f\u0130"
    CLOSING = "!#$%&()*+,-./:;=?]_|}~"

    def __init__(self, path: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        # the sign of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.limit = limit
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.table = UnitTable(self._encode, limit)

    def _merge(self, word: str) -> list[int]:
        """Words of Latin-1 letters are in normal form once lower-cased and go straight to the library's merges."""
        low = word.lower()
        return [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.signs))]

    def _stem(self, word: str) -> list[int]:
        """Ids of part of a word, kept for other words with that part."""
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha() and max(word) < "\u0100":
                ids = self._merge(word)
            else:
                ids = self.library.encode(word, add_special_tokens=False).ids
        if 2 * len(self.young) > self.limit:  # words not met since the last turn are forgotten
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[int] = []
        ends = []
        for w in words:
            if w.isalpha() and max(w) < "\u0100":
                out += self._merge(w)
                ends.append(len(out))
                continue
            if w.isascii() and "<|" not in w:
                w = w.lower()
            head = w.rstrip(self.CLOSING)
            if head is not w and head.isalpha() and "\u0130" not in head:
                out += self.young.get(head) or self._stem(head)
                w = w[len(head) :]
            out += self.young.get(w) or self._stem(w)
            ends.append(len(out))
        return np.array(out, np.int32), np.diff(np.array(ends, np.int64), prepend=0)

    #: Texts of these signs only are cut by Arrow, which knows their classes as Python does; others are cut one by one.
    BEYOND, PLAIN_SIGNS = r"[^\x00-\x7F\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]", r"[^0-9A-Za-z_\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}\s]"

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has. Only the distinct units of the texts are looked up."""
        odd = pc.match_substring_regex(texts, self.BEYOND).to_numpy(zero_copy_only=False)
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        for sign in "\n\t\r":
            low = pc.replace_substring(low, sign, " ")
        kept = pc.or_(pc.match_substring_regex(low, self.PLAIN_SIGNS * 2), pc.match_substring_regex(low, f"[{self.HIDDEN}]"))
        apart = pc.replace_substring(pc.replace_substring(low, ",", " ,"), ".", " .")
        lists = pc.split_pattern(pc.if_else(kept, low, apart), " ")
        if odd.any():
            slow = pa.array([self._units(t) for t in texts.filter(pa.array(odd)).to_pylist()], lists.type)
            order = np.empty(len(texts), np.int64)
            order[~odd], order[odd] = np.arange((~odd).sum()), (~odd).sum() + np.arange(odd.sum())
            lists = pa.concat_arrays([lists.filter(pa.array(~odd)), slow]).take(pa.array(order))
        coded = pc.dictionary_encode(lists.flatten())
        ids, each = self.table.ids_of(coded.dictionary.to_pylist(), coded.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(pc.list_value_length(lists).to_numpy())]
        return ids, np.diff(ends, prepend=0)

    def _units(self, text: str) -> list[str]:
        """Parts to encode apart: words, and where no two signs follow each other also the commas and full stops behind them."""
        if text.isascii() and "<|" not in text:  # special tokens keep their case
            text = text.lower()
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if not self.SIGNS.search(text) and not any(c in text for c in self.HIDDEN):
            text = text.replace(",", " ,").replace(".", " .")
        return text.split(" ")


@lru_cache(maxsize=2)
def load(path: str) -> Words:
    return Words(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 2) -> None:
    """Write the ids of every whole text of ``docs`` (doc_id, text) under ``path``, in ascending doc_id order.

    Rows are range-partitioned and sorted by doc_id (nulls first; rows of one doc_id by text), each partition is
    encoded as it streams by and becomes pages of about 2^18 ids and whole texts. A page is one row of a Parquet
    file: part and page (its place), first (ids before it in its part), n_texts, n_ids and data, which can be read
    alone (see write_page). Spark's commit makes the files whole or absent when an executor is lost. Null text is empty; every text
    is closed by ``end_id``; an empty table gives no pages. ``tokenizer`` is a path that exists on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, page, first = load(tokenizer), TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            counts, ids = np.concatenate([c for c, _ in held]), np.concatenate([i for _, i in held])
            data = write_page(keys, counts, ids)
            row = [[part], [page], [first], [len(keys)], [len(ids)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "page", "first", "n_texts", "n_ids", "data"])

        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            cuts = np.unique(np.concatenate([[0, len(texts)], np.searchsorted(sizes, np.arange(CHUNK, int(sizes[-1]) if len(sizes) else 0, CHUNK), "right")]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                ids, counts = words.ids(texts.slice(i, j - i))
                closed = np.insert(ids, np.cumsum(counts), end_id)
                keys += doc_ids[i:j]
                held.append((counts + 1, closed))
                size += len(closed)
                if size >= PAGE:
                    yield flush()
                    page, first, keys, held, size = page + 1, first + size, [], [], 0
        if keys:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "part int, page int, first bigint, n_texts bigint, n_ids bigint, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Texts from the pages under ``path``: doc_id, start (ids of all texts before it), ids (array of unsigned numbers as bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data")):
                keys, counts, ids = read_page(data.as_py())
                ends = np.cumsum(counts)
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(ids)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - counts), lists], ["doc_id", "start", "ids"])

    return _placed(spark, path).mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) of each text, read back from the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data")):
                keys, counts, ids = read_page(data.as_py())
                ends, raw = np.cumsum(counts), memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, path).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Pages with the number of ids before them; the totals are one row a file part."""
    pages = spark.read.parquet(path)
    parts = pages.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    return pages.join(F.broadcast(parts), "part").select((F.col("first") + F.col("before")).alias("start"), "data")
