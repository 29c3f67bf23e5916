"""Language identification by nearest centroid: hashed TF-IDF n-grams, several centroids a language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fresh_name, map_texts, texts_of

FEATURES = 1 << 13           # hashed n-grams of one to three characters
SAMPLE = 400                 # documents a language, about, that the centroids are fitted on
CENTROIDS = 4                # clusters a language
ROUNDS = 12                  # of k-means
REACH = 0.5                  # a text is rejected below this share of the lowest cosine seen in training
ROWS = 256                   # texts whose counts are held at once
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _folding() -> np.ndarray:
    """For each UTF-16 unit: itself if it is part of a letter, else a space."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((c if 0xD800 <= c < 0xE000 or chr(c).isalpha() else 32 for c in range(1 << 16)), np.uint16, 1 << 16)
    return _letters


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _counts(texts: list[str]) -> np.ndarray:
    """How often each hashed n-gram occurs in each text; anything but letters counts as one space."""
    units = []
    for t in texts:
        u = _folding()[np.frombuffer((" " + t.lower() + " ").encode("utf-16-le", "surrogatepass"), np.uint16)]
        keep = np.ones(len(u), bool)
        keep[1:] = (u[1:] != 32) | (u[:-1] != 32)
        units.append(u[keep])
    sizes = np.array([len(u) for u in units])
    flat = np.concatenate(units).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))      # units to the end of the text
    total = np.zeros(len(texts) * FEATURES)
    code = np.zeros(len(flat), np.uint32)
    for n in (1, 2, 3):
        shifted = np.zeros_like(flat)
        shifted[:len(flat) - n + 1] = flat[n - 1:]
        code = code * np.uint32(0x9E3779B1) + shifted + np.uint32(n)
        spread = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        slot = (spread >> np.uint32(19)).astype(np.int64)
        ok = left >= n
        if n == 1:
            ok &= flat != 32
        total += np.bincount(owner[ok] * FEATURES + slot[ok], minlength=len(total))
    return total.reshape(len(texts), FEATURES)


class Centroids:
    """Unit centroids, the language of each, weights of the features and lowest accepted cosines."""

    def __init__(self, vectors: np.ndarray, languages: list[str], clusters: int = CENTROIDS):
        self.weights = (np.log((1 + len(vectors)) / (1 + np.count_nonzero(vectors, 0))) + 1).astype(np.float32)
        points = _unit(np.log1p(vectors) * self.weights)
        self.names, self.owner, rows, lowest = sorted(set(languages)), [], [], []
        labels = np.array(languages)
        for k, name in enumerate(self.names):
            own = points[labels == name]
            centres = _spherical_means(own, clusters)
            rows.append(centres)
            self.owner += [k] * len(centres)
            lowest += [REACH * float((own @ centres.T).max(1).min())] * len(centres)
        self.centres = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, FEATURES), np.float32)
        self.owner, self.lowest = np.array(self.owner, np.int64), np.array(lowest)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine with the nearest centroid, and whether that is too far off."""
        names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if len(self.owner) else []
        for k in range(0, len(known), ROWS):
            part = known[k:k + ROWS]
            points = _unit(np.log1p(_counts([texts[i] for i in part])).astype(np.float32) * self.weights)
            cosine = points @ self.centres.T
            best = cosine.argmax(1)
            for row, (i, b) in enumerate(zip(part, best.tolist())):
                names[i] = self.names[self.owner[b]]
                scores[i] = min(1.0, max(0.0, float(cosine[row, b])))
                rejected[i] = scores[i] < self.lowest[b]
        return names, scores, rejected


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m))[:, None], 1e-12)


def _spherical_means(points: np.ndarray, k: int) -> np.ndarray:
    """k-means by cosine, started from the points farthest from each other; nothing is random."""
    centres = _unit(points.mean(0, keepdims=True))
    while len(centres) < min(k, len(points)):
        far = (points @ centres.T).max(1)
        if far.min() > 1 - 1e-6:
            break
        centres = np.concatenate([centres, points[far.argmin()][None]])
    for _ in range(ROUNDS):
        near = (points @ centres.T).argmax(1)
        centres = _unit(np.stack([points[near == j].mean(0) if (near == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def fit_languages(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Centroids:
    """Fit on about ``sample`` labelled documents a language, chosen by a hash of their id. Only
    their n-gram counts come to the driver: up to a few KB a document. Rows without language, or
    without a letter, teach nothing."""
    rows = docs.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Centroids(np.zeros((0, FEATURES), np.float32), [])
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sorted(counts.items())], F.lit(0.0))
    place = F.pmod(F.xxhash64(F.lit(6), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(place < share)

    def features(data, offsets, part):
        texts = part.column(1).to_pylist()
        slots, values = [], []
        for k in range(0, len(texts), ROWS):
            for row, t in zip(_counts(texts[k:k + ROWS]), texts[k:k + ROWS]):
                at = np.flatnonzero(row) if has_letter(t) else np.zeros(0, np.int64)
                slots.append(at.astype(np.int32).tobytes())
                values.append(row[at].astype(np.float32).tobytes())
        return [pa.array(slots, pa.binary()), pa.array(values, pa.binary())]

    fields = [T.StructField("slots", T.BinaryType()), T.StructField("values", T.BinaryType())]
    found = map_texts(chosen, features, fields, keep=["doc_id", "lang"]).where(F.octet_length("slots") > 0).collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"] or "", bytes(r["slots"])))
    vectors = np.zeros((len(found), FEATURES), np.float32)
    for row, r in zip(vectors, found):
        row[np.frombuffer(r["slots"], np.int32)] = np.frombuffer(r["values"], np.float32)
    return Centroids(vectors, [r["lang"] for r in found])


def identify(docs: DataFrame, model: Centroids, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The ``keep`` columns (all by default) with language, score and rejection, and the names of these
    three. Null texts and texts without a letter are ``und`` with score 0 and rejected; long
    texts count whole; repeated rows are judged one by one."""
    keep = docs.columns if keep is None else keep
    names: list[str] = []
    for n in ("lang_pred", "score", "rejected"):
        names.append(fresh_name(keep + names, n))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(data, offsets, rows):
        column = rows.column(rows.schema.get_field_index(text)).to_pylist()
        found = shared.value.predict([t or "" for t in column])
        return [pa.array(v, t) for v, t in zip(found, (pa.string(), pa.float64(), pa.bool_()))]

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return map_texts(docs, work, [T.StructField(n, k) for n, k in zip(names, kinds)], text, keep), names


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """The fold that is never learned from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def language_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score, rejected; learned from the other folds only."""
    model = fit_languages(docs.where(~held_out(doc_id)), lang, doc_id, text)
    found, (name, score, rejected) = identify(texts_of(docs, text, doc_id), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col(name).alias("lang_pred"), F.col(score).alias("score"), F.col(rejected).alias("rejected"))


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose text is rejected; the columns stay as they are."""
    found, names = identify(docs, fit_languages(docs, lang, doc_id, text), text)
    return found.where(~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
