"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained with follow-the-regularised-leader (elastic net), then calibrated by a temperature."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdiff.llm.common import arrow_rows, byte_slices, stored, unused

#: n-grams of one to three characters share 2^15 slots.
BITS, LONGEST = 15, 3
SLOTS = 1 << BITS
#: At most about so many labelled documents train and calibrate the model, evenly by language;
#: their n-gram counts are what comes to the driver. All other statistics cover all documents.
FIT_ROWS = 4000
#: Texts in an Arrow batch, and bytes of text whose n-grams are counted at once: a worker keeps what it
#: once took, and it outlives this step.
TEXT_ROWS, SLICE = 1000, 1 << 18
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slots x languages
    temperature: float


def has_letter(text: str) -> bool:
    return any(any(c.isalpha() for c in m[0]) for m in _LETTERS.finditer(text))


def slots(texts: list[str]) -> list[np.ndarray]:
    """The slots of all character n-grams of each text, lower-cased, ASCII non-letters as spaces."""
    lower = [x.lower() for x in texts]
    ends = np.cumsum([0, *map(len, lower)])
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = code < 128
    code = np.where(ascii_, _PLAIN[np.where(ascii_, code, 0)], code).astype(np.uint64)
    grams, hashes = [], np.zeros(len(code), np.uint64)
    for n in range(LONGEST):
        hashes = (hashes[: len(code) - n] + (code[n:] + np.uint64(n + 1)) * _FACTORS[n]) if n <= len(code) else hashes[:0]
        spread = hashes * _FACTORS[0]
        grams.append(((spread ^ (spread >> np.uint64(29))) * _FACTORS[1] >> np.uint64(64 - BITS)).astype(np.int64))
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        out.append(np.concatenate([g[a : max(a, b - n)] for n, g in enumerate(grams)]))
    return out


def counts(found: np.ndarray) -> np.ndarray:
    return np.bincount(found, minlength=SLOTS)


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``id, text, lang`` of the documents to learn from."""
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    return rows.filter("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL AND crc32(id) % 5 <> 0")


def document_frequencies(rows: DataFrame, batch_bytes: int = SLICE) -> np.ndarray:
    """In how many of all ``rows(text)`` each slot occurs; the last entry is the number of rows."""

    def count(batches):
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in byte_slices(batches, 0, batch_bytes):
            for found in slots([x or "" for x in batch.column(0).to_pylist()]):
                total[:SLOTS] += counts(found) > 0
                total[SLOTS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "docs"])

    out = np.zeros(SLOTS + 1, np.int64)
    for r in rows.mapInArrow(count, "slot long, docs long").groupBy("slot").agg(F.sum("docs").alias("docs")).collect():
        out[r.slot] = r.docs
    return out


def _sample(rows: DataFrame, languages: dict[str, int], limit: int) -> list:
    """N-gram counts of about ``limit`` rows, evenly by language, chosen and ordered by a hash of id and text."""
    each = limit / max(1, len(languages))
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in languages.items()], "lang string, share double")
    drawn = rows.withColumn("draw", F.expr("shiftrightunsigned(xxhash64(id, text), 11) * 1.1102230246251565e-16D"))
    some = drawn.join(F.broadcast(shares), "lang").filter("draw < share").select("lang", "draw", "id", "text")

    def count(batches):
        for batch in byte_slices(batches, 3, SLICE):
            found = [np.unique(x, return_counts=True) for x in slots(batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f"{d:.17f} {i}" for d, i in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]),
                pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in found], pa.binary()),
            ], names=["lang", "turn", "slots", "n"])

    return sorted(some.mapInArrow(count, "lang string, turn string, slots binary, n binary").collect(), key=lambda r: (r.turn, r.lang, r.slots))


def _ftrl(rows: list, n_classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """FTRL-proximal, one document at a time: per-coordinate rates, L1 keeps weights at zero."""
    z, squares = np.zeros((SLOTS, n_classes)), np.zeros((SLOTS, n_classes))

    def weights(z, squares):
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(squares)) / alpha + l2)

    for _ in range(epochs):
        for at, x, y in rows:
            old, seen = z[at], squares[at]
            w = weights(old, seen)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            new = seen + g * g
            z[at] = old + g - (np.sqrt(new) - np.sqrt(seen)) / alpha * w
            squares[at] = new
    return weights(z, squares)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log-loss, by golden section over its logarithm."""

    def loss(t):
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    if not len(labels):
        return 1.0
    lo, hi, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(
    docs: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """A model of the labelled documents whose ``crc32(id) % 5`` is not 0.

    Document frequencies come from all of them; weights and temperature (a fifth of the sample,
    kept apart) from about ``fit_rows``, the same ones in every run.
    """
    rows = _labelled(docs, id_col, text_col, lang_col)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        seen = document_frequencies(rows.select("text"))
        sample = _sample(rows, sizes, fit_rows) if languages else []
    idf = np.log((1 + seen[SLOTS]) / (1 + seen[:SLOTS])) + 1
    examples = []
    for r in sample:
        at = np.frombuffer(r.slots, "<u2").astype(np.int64)
        x = np.frombuffer(r.n, "<f4") * idf[at]
        if len(at):
            examples.append((at, x / np.sqrt(x @ x), languages.index(r.lang)))
    held = examples[::5] if len(examples) >= 10 else []
    kept = [e for n, e in enumerate(examples) if n % 5] if held else examples
    weights = _ftrl(kept, max(1, len(languages)), epochs, alpha, beta, l1, l2)
    logits = np.array([x @ weights[at] for at, x, _ in held]).reshape(-1, max(1, len(languages)))
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), _temperature(logits, np.array([y for *_, y in held], int)))


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row; trains on ``docs`` if no model is given.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null or has no
    letter, or nothing could be learned. ``score`` is the calibrated probability. ``held_out``:
    the row can't be one learned from, ``crc32(id) % 5`` is 0 (a null id is held out, too).
    Only the text counts for a prediction. Repeated rows: row by row. An empty table gives no rows.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    held = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 5 == 0, F.lit(True))
    rows = docs.select(docs[id_col], held.alias("held_out"), docs[text_col])
    schema = T.StructType([
        T.StructField(id_col, rows.schema[0].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def predict(batches):
        for batch in byte_slices(batches, 2, SLICE):
            found, scores = judge(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(predict, schema)


def judge(model: Model, texts: list) -> tuple[list[str], list[float]]:
    """The language of each text and its score."""
    texts = [x or "" for x in texts]
    found, scores = [], []
    for text, at in zip(texts, slots(texts), strict=True):
        if not model.languages or not has_letter(text):
            found.append(UNDETERMINED)
            scores.append(0.0)
            continue
        x = counts(at) * model.idf
        p = _softmax((x @ model.weights).astype(float) / (np.sqrt(float(x @ x)) * model.temperature))
        found.append(model.languages[int(p.argmax())])
        scores.append(float(p.max()))
    return found, scores


def keep_identified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is determined with at least ``min_score``.

    An eager job judges all texts; only hashes of those that are not sure, as a rule few, are
    stored, and their rows left out.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    h1, h2 = unused(docs, "_h1", "_h2")
    texts = docs.select(F.xxhash64(docs[text_col]).alias(h1), F.hash(docs[text_col]).alias(h2), docs[text_col])

    def unsure(batches):
        for part in byte_slices(batches, 2, SLICE):
            bad = [lang == UNDETERMINED or not score >= min_score for lang, score in zip(*judge(model, part.column(2).to_pylist()), strict=True)]
            yield part.select([0, 1]).filter(pa.array(bad, pa.bool_()))

    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        left_out = stored(texts.mapInArrow(unsure, f"{h1} long, {h2} int").distinct())
    same = (F.xxhash64(docs[text_col]) == left_out[h1]) & (F.hash(docs[text_col]) == left_out[h2])
    return docs.join(left_out, same, "left_anti")
