"""Language ID: a bidirectional gated recurrent network over bytes, trained here in numpy.

Every byte of a text gets a distribution over languages from the states of two
recurrences, one from each end of its window of 96 bytes; a document's
distribution is the mean over all its bytes.  Training is by backpropagation
through time with Adam, on slices of a bounded sample of labelled documents:
``SAMPLE`` documents of each language in expectation, chosen by a hash of the
id, ``SLICES`` slices each.  Prediction covers whole texts.

Rows: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if nothing is labelled; rows without an id are not learned from;
rows with the same text get the same prediction; an empty table gives no rows;
lang is read for training only, other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm._bytes import pieces, utf8
from trustloom.llm._worker import kept, lean

WINDOW = 96
HIDDEN = 8
EMBEDDING = 8
SAMPLE, SLICES, SLICE_CHARS = 250, 4, 80
MOST_LANGUAGES = 256
STEPS, BATCH, RATE = 260, 96, 0.015
BLOCK = 4096
#: Bytes of texts whose windows fill some blocks.
PIECE = 1 << 20
UNKNOWN = "und"


class ByteGru:
    """Both directions side by side: arrays have the forward half first, then the backward one.

    emb (256, E); w (2, E, 3H), u (2, H, 3H), b (2, 3H) with gates update,
    reset, candidate; out (2H, K), bias (K).
    """

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        self.languages = languages
        k, rng = max(1, len(languages)), np.random.default_rng(seed)
        init = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.p = weights or {"emb": (rng.normal(size=(256, EMBEDDING))).astype(np.float32), "w": init(2, EMBEDDING, 3 * HIDDEN), "u": init(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32), "out": init(2 * HIDDEN, k), "bias": np.zeros(k, np.float32)}

    @staticmethod
    def _gate(x: np.ndarray) -> np.ndarray:
        return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)

    def _run(self, x: np.ndarray, inside: np.ndarray | None, trace: list | None = None) -> np.ndarray:
        """States (T, 2, n, H) by position for bytes x (T, n); inside (T, n): which belong to the text."""
        t_max, n = x.shape
        table = np.einsum("be,deh->dbh", self.p["emb"], self.p["w"]) + self.p["b"][:, None]
        u, h = self.p["u"], np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((t_max, 2, n, HIDDEN), np.float32)
        for t in range(t_max):
            back = t_max - 1 - t
            given = np.stack([table[0][x[t]], table[1][x[back]]])
            kept = h @ u
            zr = self._gate(given[..., : 2 * HIDDEN] + kept[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(given[..., 2 * HIDDEN :] + r * kept[..., 2 * HIDDEN :])
            new = h + z * (c - h)
            if inside is not None:
                new = np.where(np.stack([inside[t], inside[back]])[..., None], new, h)
            if trace is not None:
                trace.append((h, z, r, c, kept[..., 2 * HIDDEN :]))
            h = new
            states[t, 0], states[back, 1] = h[0], h[1]
        return states

    def _chances(self, states: np.ndarray) -> np.ndarray:
        logits = states[:, 0] @ self.p["out"][:HIDDEN] + states[:, 1] @ self.p["out"][HIDDEN:] + self.p["bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def labels(self, raw: bytes) -> np.ndarray:
        """The distribution over languages at each byte of a text."""
        x, inside, at = _windows(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        return np.concatenate([np.swapaxes(self._chances(self._run(x.T, inside.T)), 0, 1)[inside]]) if len(at) else np.zeros((0, len(self.languages)), np.float32)

    def pooled(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The mean distribution over the bytes of each row of a piece."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        x, inside, at = _windows(offsets, data)
        full = inside[:, -1]
        for which, whole in ((np.flatnonzero(full), True), (np.flatnonzero(~full), False)):
            for k in range(0, len(which), BLOCK):
                rows = which[k : k + BLOCK]
                held = None if whole else inside[rows].T
                chances = self._chances(self._run(x[rows].T, held))
                sums = chances.sum(axis=0) if whole else (chances * held[..., None]).sum(axis=0)
                np.add.at(out, at[rows], sums)
        return out / np.maximum(np.diff(offsets), 1)[:, None]

    def gradients(self, x: np.ndarray, inside: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes (T, n), and its gradients by backpropagation through time."""
        p, trace = self.p, []
        t_max, n = x.shape
        states = self._run(x, inside, trace)
        chances = self._chances(states)
        scale = np.float32(1 / max(1, inside.sum()))
        loss = float(-(np.log(np.take_along_axis(chances, np.broadcast_to(label, (t_max, n))[..., None], -1)[..., 0] + 1e-9) * inside).sum() * scale)
        d_logits = chances.copy()
        d_logits[:, np.arange(n), label] -= 1
        d_logits *= (inside * scale)[..., None]
        both = np.concatenate([states[:, 0], states[:, 1]], axis=-1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"] = np.einsum("tnh,tnk->hk", both, d_logits)
        g["bias"] = d_logits.sum(axis=(0, 1))
        d_states = d_logits @ p["out"].T
        table_grad = np.zeros((2, 256, 3 * HIDDEN), np.float32)
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        for t in reversed(range(t_max)):
            back = t_max - 1 - t
            h, z, r, c, kept = trace[t]
            d_h = d_h + np.stack([d_states[t][:, :HIDDEN], d_states[back][:, HIDDEN:]])
            held = np.stack([inside[t], inside[back]])[..., None]
            live = d_h * held
            d_c = live * z * (1 - c * c)
            d_z = live * (c - h) * z * (1 - z)
            d_r = d_c * kept * r * (1 - r)
            d_given = np.concatenate([d_z, d_r, d_c], axis=-1)
            d_kept = np.concatenate([d_z, d_r, d_c * r], axis=-1)
            g["u"] += np.swapaxes(h, 1, 2) @ d_kept
            d_h = d_h * ~held + live * (1 - z) + d_kept @ np.swapaxes(p["u"], 1, 2)
            np.add.at(table_grad[0], x[t], d_given[0])
            np.add.at(table_grad[1], x[back], d_given[1])
        g["b"] = table_grad.sum(axis=1)
        g["w"] = np.einsum("be,dbh->deh", p["emb"], table_grad)
        g["emb"] = np.einsum("dbh,deh->be", table_grad, p["w"])
        return loss, g


def _windows(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (windows, WINDOW), which of them belong to the text, and the row of each window."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    at = np.repeat(np.arange(len(sizes)), counts)
    begin = offsets[at] + WINDOW * (np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts))
    place = begin[:, None] + np.arange(WINDOW)
    inside = place < offsets[at + 1][:, None] if len(at) else np.zeros((0, WINDOW), bool)
    x = data[np.minimum(place, max(len(data) - 1, 0))] if len(at) else np.zeros((0, WINDOW), np.uint8)
    return x, inside, at


def fit(slices: list[tuple[str, str]], languages: list[str], steps: int = STEPS, seed: int = 7) -> ByteGru:
    """Trains on (text, language) slices; each language has the same weight."""
    model = ByteGru(languages, seed=seed)
    raw = [t.encode()[:WINDOW] for t, _ in slices]
    x = np.zeros((len(raw), WINDOW), np.uint8)
    inside = np.zeros((len(raw), WINDOW), bool)
    for k, b in enumerate(raw):
        x[k, : len(b)] = np.frombuffer(b, np.uint8)
        inside[k, : len(b)] = True
    label = np.array([languages.index(lang) for _, lang in slices])
    by = [np.flatnonzero(label == k) for k in range(len(languages))]
    by = [rows for rows in by if len(rows)]
    if not by:
        return model
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(r, -(-BATCH // len(by))) for r in by])
        _, g = model.gradients(x[rows].T, inside[rows].T, label[rows])
        norm = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, d in g.items():
            d = d * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteGru:
    """A model of the documents that aren't held out; at most MOST_LANGUAGES languages."""
    usable = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return ByteGru([])
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, SAMPLE / n))).otherwise(share)
    chosen = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share * (1 << 30))
    room = F.greatest(F.length(text_col) - SLICE_CHARS, F.lit(1))
    slices = F.array(*[F.expr(f"substring(`{text_col}`, cast(pmod(xxhash64(`{id_col}`, {k}), greatest(length(`{text_col}`) - {SLICE_CHARS}, 1)) as int) + 1, {SLICE_CHARS})") for k in range(SLICES)])
    rows = chosen.where(room > 0).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.explode(slices).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    return fit([(r.text, r.lang) for r in sorted(rows.collect(), key=lambda r: (r.id, r.text))], languages)


def identify(docs: DataFrame, model: ByteGru, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score and the columns in keep, of every row."""
    held, name = docs.sparkSession.sparkContext.broadcast((model.languages, model.p)), uuid.uuid4().hex
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    # a text that is kept travels once
    names = [id_col, *keep]
    extra = [] if text_col in names else [text_col]
    rows = docs.select(letters.alias("__letters"), *names, *extra)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    at_text = 1 + [*names, *extra].index(text_col)

    def run(batches):
        languages, weights = held.value
        net = kept(f"net {name}", lambda: ByteGru(languages, weights))
        for batch in batches:
            known = batch.column(0).to_pylist()
            offsets, data = utf8(batch.column(at_text))
            for row, at, part in pieces(offsets, data, PIECE):
                pred, score = [], []
                chances = net.pooled(at, part) if languages else np.zeros((len(at) - 1, 1))
                best = chances.argmax(axis=1)
                for k, b in enumerate(best.tolist()):
                    sure = known[row + k] and bool(languages)
                    pred.append(languages[b] if sure else UNKNOWN)
                    score.append(min(1.0, float(chances[k, b])) if sure else 0.0)
                columns = batch.slice(row, len(pred)).columns[1 : 1 + len(names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(lean(run), f"{fields}, lang_pred string, score double")


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on what isn't held out and predicts every row: id, held_out, lang_pred, score."""
    found = identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
