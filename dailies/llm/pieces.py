"""SentencePiece encoding and decoding by a batched Viterbi search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from dailies.llm.units import UnitTable, groups

SPACE = "▁"
MUL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Scores below the least one that a character without a piece gets, as the library has it.
UNKNOWN_PENALTY = 10.0
BITMAP = 22
#: Pieces scored below are in the file for decoding and never chosen; single characters among them get the lowest other score.
RULED_OUT = -1e8
#: Characters handled at a time.
CHUNK = 1 << 21
#: Words of more characters rarely have others of their length: their substrings are looked up together, WINDOW ends at a time.
LONG, WINDOW = 64, 1 << 16
MODEL = public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces and scores of a model file, and a best-segmentation encoder over them.

    The search is that of a unigram model: of all ways to cut a text into pieces the one whose scores sum to the most;
    of equal ones the one whose last piece is longest. A character without a piece costs the least score minus 10 and
    becomes the bytes of its UTF-8 form. (A merge-type model's own encoder applies merges in order instead, so its ids
    differ; pieces, scores, special handling and decoding are the file's.)
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.text[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.bytes = {b: i for i, b in self.byte_of.items()}
        self.unknown = sp.unk_id()
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        #: Text of each id (an ASCII byte stands for itself wherever it comes), and whether it is a byte that needs its neighbours.
        self.high = np.array([self.byte_of.get(i, 0) > 127 for i in range(n)])
        plain = [chr(self.byte_of[i]) if i in self.byte_of else "" if sp.is_control(i) else self.text[i].replace(SPACE, " ") for i in range(n)]
        self.plain = np.array(plain, object)
        scores = np.array([sp.get_score(i) for i in range(n)], np.float32)
        usable = [i for i in range(n) if i not in skip and (scores[i] > RULED_OUT or len(self.text[i]) == 1)]
        lowest = min(scores[i] for i in usable if scores[i] > RULED_OUT)
        scores[scores <= RULED_OUT] = lowest
        self.least = np.float32(lowest - UNKNOWN_PENALTY)
        keys = np.array([self._key(self.text[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one key")
        self.scores = scores[self.ids]
        self.seen = np.zeros(1 << BITMAP, bool)
        self.seen[self.keys >> np.uint64(64 - BITMAP)] = True
        self.longest = max(len(self.text[i]) for i in usable)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, MUL)]), dtype=np.uint64)
        inner = [self.text[i] for i in usable if SPACE in self.text[i].lstrip(SPACE)]
        runs = [i for i in usable if len(self.text[i]) > 1 and not self.text[i].strip(SPACE)]
        single = next((scores[i] for i in usable if self.text[i] == SPACE), self.least)
        #: Whether every space begins a unit of its own: no piece reaches over one, and runs of spaces are never better whole.
        self.cut_spaces = not inner and all(scores[i] < single * len(self.text[i]) for i in runs)
        self.cut_lines = all("\n" not in self.text[i] for i in usable)

    @staticmethod
    def _key(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * MUL + np.uint64(ord(c))
        return ((h + np.uint64(len(piece))) * MIX)[0]

    def units(self, text: str) -> list[str]:
        """Parts of a text that can be encoded apart, in the model's form (spaces as U+2581, one put in front)."""
        if not text:
            return []
        if not self.cut_spaces:
            return [SPACE + text.replace(" ", SPACE)]
        if not self.cut_lines:
            return (SPACE + text.replace(" ", " " + SPACE)).split(" ")
        return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n")).split(" ")

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one after the other, and their counts. Words of one length advance together, a long one alone."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes):
            where = np.flatnonzero(sizes == n)
            if n > LONG:
                for i in where:
                    out[i] = self._alone(words[i])
                continue
            if not n:
                for i in where:
                    out[i] = []
                continue
            step = max(1, CHUNK // int(n))
            for k in range(0, len(where), step):
                own = where[k : k + step]
                for i, got in zip(own, self._equal([words[i] for i in own], int(n))):
                    out[i] = got
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((x for got in out for x in got), np.int32, int(counts.sum())), counts

    def _equal(self, words: list[str], n: int) -> list[list[int]]:
        m = len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).T.astype(np.uint64)
        hashes = np.zeros((n + 1, m), np.uint64)
        for i in range(n):
            hashes[i + 1] = hashes[i] * MUL + points[i]
        best = np.full((n + 1, m), -np.inf, np.float32)
        best[0] = 0
        back, piece = np.zeros((n + 1, m), np.int16), np.full((n + 1, m), -1, np.int32)
        for end in range(1, n + 1):
            for size in range(min(end, self.longest), 0, -1):
                keys = (hashes[end] - hashes[end - size] * self.powers[size] + np.uint64(size)) * MIX
                maybe = np.flatnonzero(self.seen[keys >> np.uint64(64 - BITMAP)])
                at = np.searchsorted(self.keys, keys[maybe])
                at[at == len(self.keys)] = 0
                good = self.keys[at] == keys[maybe]
                rows, at = maybe[good], at[good]
                if size == 1 and len(rows) < m:  # a character without a piece
                    lone = np.ones(m, bool)
                    lone[rows] = False
                    value = best[end - 1] + self.least
                    take = lone & (value > best[end])
                    best[end, take], back[end, take], piece[end, take] = value[take], 1, -1
                value = best[end - size, rows] + self.scores[at]
                better = value > best[end, rows]
                rows = rows[better]
                best[end, rows], back[end, rows], piece[end, rows] = value[better], size, self.ids[at[better]]
        ids, size = np.full((n, m), -2, np.int32), np.full((n, m), 0, np.int16)
        at, columns = np.full(m, n), np.arange(m)
        while len(columns):  # backwards; a piece is put down where it begins
            step = back[at, columns].astype(np.int64)
            got = piece[at, columns]
            at = at - step
            ids[at, columns], size[at, columns] = got, step
            columns, at = columns[at > 0], at[at > 0]
        ids = ids.T
        plain = [row[row > -2].tolist() for row in ids] if m > 1 else [ids[0][ids[0] > -2].tolist()]
        for i in np.flatnonzero((ids == -1).any(1)):
            plain[i] = [x for p in np.flatnonzero(ids[i] > -2) for x in ([int(ids[i, p])] if ids[i, p] >= 0 else self._bytes(words[i][p]))]
        return plain

    def _found(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every piece in a stretch of code points: end, size and place among the pieces (-1: a character without one), by end, longest first."""
        sub, ends, sizes, places = points.copy(), [], [], []
        for size in range(1, min(self.longest, len(points)) + 1):
            if size > 1:
                sub = sub[:-1] * MUL + points[size - 1 :]
            keys = (sub + np.uint64(size)) * MIX
            maybe = np.flatnonzero(self.seen[keys >> np.uint64(64 - BITMAP)])
            at = np.searchsorted(self.keys, keys[maybe])
            at[at == len(self.keys)] = 0
            good = self.keys[at] == keys[maybe]
            starts, at = maybe[good], at[good]
            if size == 1:
                lone = np.setdiff1d(np.arange(len(points)), starts, assume_unique=True)
                starts, at = np.concatenate([starts, lone]), np.concatenate([at, np.full(len(lone), -1)])
            ends.append(starts + size)
            sizes.append(np.full(len(starts), size))
            places.append(at)
        end, size, at = np.concatenate(ends), np.concatenate(sizes), np.concatenate(places)
        order = np.lexsort((-size, end))
        return end[order], size[order], at[order]

    def _alone(self, word: str) -> list[int]:
        """Best cut of one long word: look-ups are vectors over its places, maxima are taken from one end to the next."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, reach = len(points), self.longest
        back, piece = np.zeros(n + 1, np.int16), np.zeros(n + 1, np.int32)
        recent = [0.0]  # best sums of the places before the window, as far back as a piece reaches
        for lo in range(0, n, WINDOW):
            hi, first = min(n, lo + WINDOW), lo + 1 - len(recent)
            end, size, at = self._found(points[first:hi])
            inside = end + first > lo
            end, size, at = end[inside] + first, size[inside], at[inside]
            value = np.where(at < 0, self.least, self.scores[at]).astype(float).tolist()
            best = recent + [float("-inf")] * (hi - lo)
            steps, chosen = [0] * (hi - lo), [0] * (hi - lo)
            for k, (e, s, v) in enumerate(zip((end - first).tolist(), size.tolist(), value)):
                v += best[e - s]
                if v > best[e]:
                    best[e] = v
                    steps[e + first - lo - 1], chosen[e + first - lo - 1] = s, k
            back[lo + 1 : hi + 1] = steps
            piece[lo + 1 : hi + 1] = np.where(at < 0, -1, self.ids[at])[chosen]
            recent = best[-reach:]
        out, e = [], n
        while e:
            i = int(piece[e])
            out += [i] if i >= 0 else self._bytes(word[e - 1])[::-1]
            e -= int(back[e])
        return out[::-1]

    def _bytes(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if len(self.bytes) == 256 else [self.unknown]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, bytes put together (wrong ones become U+FFFD), U+2581 as space, the first space dropped."""
        if not self.high[ids].any():
            text = "".join(self.plain[ids].tolist())
        else:
            parts = [bytes([self.byte_of[i]]) if i in self.byte_of else self.plain[i].encode() for i in ids.tolist()]
            text = b"".join(parts).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Pieces, UnitTable]:
    pieces = Pieces(path)
    return pieces, UnitTable(pieces.viterbi, 200_000)


def encode(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ids (array of int) of the whole ``text`` of each row.

    ``model`` is a path that exists on every executor. Null and empty texts have no ids. Rows are encoded alone, so
    repeated rows give repeated results, and nothing is shuffled. Units met before in a worker are not searched again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = load(model)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in groups(texts, CHUNK):
                ids, counts = table.ids([pieces.units(t) for t in texts[i:j]])
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), pa.array(ids)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, j - i) for c in keep], lists], [*keep, "ids"])

    schema = StructType([docs.schema[c] for c in keep]).add("ids", ArrayType(IntegerType()))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the text of ``ids`` of each row; null ids give null.

    A text comes back as it was, but for U+2581 (a space) and unpaired surrogates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = load(model)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                lists = part.column("ids")
                flat, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                texts = [pieces.decode(flat[x:y]) if known else None for x, y, known in zip(cuts[:-1], cuts[1:], lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "text"])

    schema = StructType([tokens.schema[c] for c in keep]).add("text", "string")
    return tokens.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, schema)
