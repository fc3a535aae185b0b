"""Language identification with blended-spectrum presence kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dailies.llm.common import sized
from dailies.session import materialize

#: Letters are folded to 64 signs: 0 is a gap, 1-26 are a-z, other letters share 37 signs by code point.
SIGNS, OTHER = 64, 37
#: Places of the blended spectrum: single signs, pairs and triples.
WIDTH = SIGNS + SIGNS**2 + SIGNS**3
#: Bounds of the fit: labelled texts and landmarks taken for each language, texts in all, and the ridge.
SAMPLE, LANDMARKS, TOTAL, RIDGE = 400, 48, 4_000, 0.1
#: Code points of a long text that are folded at a time.
CHUNK = 1 << 20
_TABLE: np.ndarray | None = None


def _table() -> np.ndarray:
    """Sign of each code point, built once in a worker from Python's letters."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(0x110000, np.uint8)
        for c in range(128, 0x110000):
            if chr(c).isalpha():
                t[c] = 27 + c % OTHER
        for c in range(26):
            t[65 + c] = t[97 + c] = 1 + c
        _TABLE = t
    return _TABLE


def spectrum(text: str | None) -> np.ndarray:
    """Distinct places of the runs of one to three signs in the whole text, in order; empty without a letter."""
    if not text:
        return np.empty(0, np.int64)
    flags = np.zeros(WIDTH, bool)
    table, tail = _table(), np.zeros(1, np.uint8)
    for i in range(0, len(text), CHUNK):
        signs = table[np.frombuffer(text[i : i + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        signs = np.concatenate([tail, signs])
        signs = signs[np.concatenate([[True], (signs[1:] > 0) | (signs[:-1] > 0)])].astype(np.int64)  # runs of gaps count as one
        flags[signs] = True
        if len(signs) > 1:
            two = signs[:-1] * SIGNS + signs[1:]
            flags[SIGNS + two] = True
            if len(signs) > 2:
                flags[SIGNS + SIGNS**2 + two[:-1] * SIGNS + signs[2:]] = True
        tail = signs[-2:].astype(np.uint8)
    found = np.flatnonzero(flags)
    return found if (found[found < SIGNS] > 0).any() else np.empty(0, np.int64)


@dataclass
class Model:
    """What a fit keeps: the places the landmarks use, the landmarks over them, their sizes and the weights to classes."""

    classes: list[str]
    places: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def kernel(self, spectra: list[np.ndarray]) -> np.ndarray:
        """Shared runs of each text and landmark over the root of the product of their numbers."""
        column = np.full(WIDTH, -1, np.int32)
        column[self.places] = np.arange(len(self.places))
        x = np.zeros((len(spectra), len(self.places)), np.float32)
        for i, s in enumerate(spectra):
            at = column[s]
            x[i, at[at >= 0]] = 1
        own = np.sqrt(np.maximum(1, [len(s) for s in spectra])).astype(np.float32)
        return (x @ self.landmarks.T) / (own[:, None] * self.sizes[None, :])

    def scores(self, spectra: list[np.ndarray]) -> np.ndarray:
        k = self.kernel(spectra)
        return np.concatenate([k, np.ones((len(k), 1), np.float32)], axis=1) @ self.weights


def fit(spectra: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """One-versus-rest kernel ridge regression in the space that the landmarks span; None without labelled texts."""
    if not spectra:
        return None
    classes = sorted(set(labels))
    picked: list[int] = []
    for c in classes:  # the landmarks of a class are its first texts, spread over the lengths
        own = sorted((i for i, v in enumerate(labels) if v == c), key=lambda i: (len(spectra[i]), i))
        picked += [own[int(j)] for j in np.unique(np.linspace(0, len(own) - 1, landmarks).astype(int))]
    places = np.unique(np.concatenate([spectra[i] for i in picked]))
    z = np.zeros((len(picked), len(places)), np.float32)
    for r, i in enumerate(picked):
        z[r, np.searchsorted(places, spectra[i])] = 1
    model = Model(classes, places, z, np.sqrt(z.sum(1)), np.zeros(0, np.float32))
    k_zz = model.kernel([spectra[i] for i in picked]).astype(np.float64)
    values, vectors = np.linalg.eigh((k_zz + k_zz.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # k(x, z) @ root: Nyström features
    phi = np.concatenate([model.kernel(spectra).astype(np.float64) @ root, np.ones((len(spectra), 1))], axis=1)
    y = np.where(np.array(labels)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    share = np.array([1 / labels.count(v) for v in labels])[:, None]  # every language weighs the same
    penalty = ridge / len(spectra) * np.eye(phi.shape[1])
    penalty[-1, -1] = 0
    w = np.linalg.solve(phi.T @ (phi * share) + penalty * share.sum(), phi.T @ (y * share))
    model.weights = np.concatenate([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def train(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on at most ``sample`` texts of each language in ``labelled`` (doc_id, text, lang), the first ones by a digest.

    The spectra are taken on the executors; the driver gets WIDTH bits of each sampled text, however long it is. With
    many languages each gives fewer texts, TOTAL in all, but at least one.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    order = F.struct(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("d"), "doc_id")
    share = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")))
    n_languages = share.count()
    sample = max(1, min(sample, TOTAL // max(1, n_languages)))
    # a digest threshold thins each language to about twice the sample before the exact cut
    thin = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / (1 << 32)
    near = rows.join(sized(share, n_languages), "lang").filter(thin * F.col("n") <= 2 * sample + 50)
    ids = near.groupBy("lang").agg(F.slice(F.sort_array(F.collect_set(order)), 1, sample).alias("ids"))
    ids = ids.select("lang", F.explode("ids.doc_id").alias("id"))
    texts = labelled.select("doc_id", "lang", "text").join(sized(ids.select(F.col("id"), F.col("lang").alias("l")), sample * n_languages), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("l")))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for t in b.column("text").to_pylist():
                flags = np.zeros(WIDTH, bool)
                flags[spectrum(t)] = True
                packed.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(packed, pa.binary())], ["doc_id", "lang", "bits"])

    got = texts.select("doc_id", "lang", "text").dropDuplicates(["doc_id", "lang"]).mapInArrow(bits, "doc_id bigint, lang string, bits binary")
    got = sorted(got.collect(), key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0))
    spectra = [np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), count=WIDTH)) for r in got]
    full = [i for i, s in enumerate(spectra) if len(s)]
    return fit([spectra[i] for i in full], [got[i].lang for i in full], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` with lang_pred and score (0 to 1), called ``named``.

    Only ``text`` is read for the prediction. ``und`` with score 0: null, no letter, or no model. Of equal scores the
    first language in alphabetical order wins. The score is half of one plus the winning ridge value, held to 0..1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 256):  # small batches back, so that no large one is held on either side
                b = whole.slice(i, 256)
                pred, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
                if m:
                    spectra = [spectrum(t) for t in b.column("text").to_pylist()]
                    s = m.scores(spectra)
                    full = np.array([len(x) > 0 for x in spectra])
                    pred = np.where(full, np.array(m.classes, object)[s.argmax(1)], "und")
                    score = np.where(full, np.clip((1 + s.max(1).astype(float)) / 2, 0, 1), 0)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(list(pred), pa.string()), pa.array(score)], [*keep, *named])

    schema = StructType([docs.schema[c] for c in keep]).add(named[0], "string").add(named[1], "double")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
