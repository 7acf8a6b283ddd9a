"""Language identification: a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, release, ship

#: Hidden units of each direction.
UNITS = 8
#: Bytes to a window; a text is read in windows that cover all of it.
SPAN = 96
#: About so many documents of each language are learnt from, and so many windows of each.
SAMPLE = 400
WINDOWS = 3
#: Passes of the training.
STEPS = 260
#: Windows to a step of prediction.
TOGETHER = 2048
#: The label of texts that have no letter.
NONE = "und"

_letter = regex.compile(r"\p{L}").search


def init(labels: int, seed: int = 7, units: int = UNITS) -> dict[str, np.ndarray]:
    """Weights for both directions at once (first axis). Byte 256 stands for no byte."""
    draw = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    return {
        "x": normal(2, 257, 3 * units, scale=0.3),
        "u": normal(2, units, 2 * units, scale=units**-0.5),
        "n": normal(2, units, units, scale=units**-0.5),
        "w": normal(2, units, labels, scale=units**-0.5),
        "b": np.zeros(labels, np.float32),
    }


def forward(p: dict, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states [2, T, B, units] for windows [B, T]; the second direction reads from the end."""
    batch, span = windows.shape
    units = p["n"].shape[1]
    tape = np.ascontiguousarray(windows.T)
    h = np.zeros((2, batch, units), np.float32)
    states = np.empty((2, span, batch, units), np.float32)
    for t in range(span):
        ahead, back = tape[t], tape[span - 1 - t]
        x = np.stack((p["x"][0].take(ahead, axis=0), p["x"][1].take(back, axis=0)))
        gates = x[..., : 2 * units] + h @ p["u"]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[..., :units], gates[..., units:]
        m = h @ p["n"]
        c = r * m
        c += x[..., 2 * units :]
        np.tanh(c, out=c)
        new = c + z * (h - c)
        if keep is not None:
            keep.append((h, z, r, m, c, ahead, back))
        h = new
        states[0, t], states[1, span - 1 - t] = h[0], h[1]
    return states


def positions(p: dict, windows: np.ndarray) -> np.ndarray:
    """Label probabilities of every position, [T, B, labels]."""
    states = forward(p, windows)
    logits = states[0] @ p["w"][0] + states[1] @ p["w"][1] + p["b"]
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def gradients(p: dict, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
    tapes: list = []
    states = forward(p, windows, tapes)
    batch, span = windows.shape
    units = p["n"].shape[1]
    logits = states[0] @ p["w"][0] + states[1] @ p["w"][1] + p["b"]
    logits -= logits.max(axis=-1, keepdims=True)
    probs = np.exp(logits)
    probs /= probs.sum(axis=-1, keepdims=True)
    real = (windows.T != 256).astype(np.float32)
    total = max(1.0, float(real.sum()))
    rows = np.arange(batch)
    loss = float(-(np.log(probs[:, rows, labels] + 1e-9) * real).sum() / total)
    d = probs
    d[:, rows, labels] -= 1
    d *= real[..., None] / total
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["b"] = d.sum(axis=(0, 1))
    flat = d.reshape(-1, d.shape[-1])
    for way in (0, 1):
        g["w"][way] = states[way].reshape(-1, units).T @ flat
    dstates = np.stack([d @ p["w"][way].T for way in (0, 1)])
    dh = np.zeros((2, batch, units), np.float32)
    ut, nt = p["u"].transpose(0, 2, 1), p["n"].transpose(0, 2, 1)
    for t in reversed(range(span)):
        h, z, r, m, c, ahead, back = tapes[t]
        dh = dh + np.stack((dstates[0, t], dstates[1, span - 1 - t]))
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * m * r * (1 - r)
        dm = dc * r
        dg = np.concatenate((dz, dr), axis=-1)
        g["u"] += h.transpose(0, 2, 1) @ dg
        g["n"] += h.transpose(0, 2, 1) @ dm
        dx = np.concatenate((dg, dc), axis=-1)
        np.add.at(g["x"][0], ahead, dx[0])
        np.add.at(g["x"][1], back, dx[1])
        dh = dh * z + dg @ ut + dm @ nt
    return loss, g


def train(windows: np.ndarray, labels: np.ndarray, count: int, *, steps: int = STEPS, batch: int = 96, rate: float = 0.02, seed: int = 7) -> dict:
    """Weights after ``steps`` steps of Adam over shuffled windows."""
    p = init(count, seed)
    draw = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        chosen = draw.integers(0, len(windows), batch)
        _, g = gradients(p, windows[chosen], labels[chosen])
        pace = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] = p[k] - (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def windows_of(raw: bytes, span: int = SPAN) -> np.ndarray:
    """All of a text in windows, the last filled up with no-byte."""
    n = -(-len(raw) // span)
    out = np.full(n * span, 256, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, span)


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, scratch: Scratch | None = None) -> tuple[list[str], dict | None]:
    """Languages and weights from about ``sample`` labelled documents of each language, fewer where there are fewer.

    Documents are drawn by a seeded hash of id and text: those whose hash lies
    under a bound that the language's count gives, and of these the ``sample``
    lowest. So only numbers of a few times ``sample`` rows a language meet in a
    task, however many rows or tasks there are, and the driver gets
    ``WINDOWS`` windows of ``SPAN`` bytes of each document drawn. Null texts,
    texts without a letter and null labels are not learnt from; repeated rows
    count once; an empty table gives no languages and no weights.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "language")
    value, name = F.col(f"`{text}`"), F.col(f"`{lang}`").cast("string")
    place = F.shiftrightunsigned(F.xxhash64(F.col(f"`{doc_id}`").cast("string"), value, F.lit(11)), 1)
    labelled = docs.where(name.isNotNull() & value.rlike(r"\p{L}"))
    narrow = scratch.table(labelled.select(name.alias("lang"), place.alias("place")), "places")
    # One row a language, written, so that its size decides how it is joined before any row is shuffled.
    counts = scratch.table(narrow.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    bound = F.least(F.lit(1.0), F.lit(4.0) * sample / F.col("n")) * float(1 << 63)
    under = narrow.join(counts, "lang").where(F.col("place") <= bound).select("lang", "place").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    drawn = scratch.table(under.withColumn("nth", nth).where(F.col("nth") <= sample).drop("nth"), "drawn")
    found = labelled.select(name.alias("lang"), place.alias("place"), value.alias("text")).join(drawn, ["lang", "place"], "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                chosen = []
                for place, value in zip(batch.column("place").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    all_ = windows_of(value.encode())
                    chosen.append([all_[i].astype(np.int16).tobytes() for i in np.random.default_rng(place).permutation(len(all_))[:WINDOWS]])
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(chosen, pa.list_(pa.binary()))], ["lang", "place", "windows"])

    cuts = found.mapInArrow(cut, "lang string, place long, windows array<binary>").dropDuplicates(["lang", "place"])
    rows = sorted((r.lang, r.place, r.windows) for r in cuts.collect())  # sample documents a language, some hundred bytes each
    langs = sorted({r[0] for r in rows})
    if not langs:
        return [], None
    windows = np.array([np.frombuffer(w, np.int16) for _, _, chosen in rows for w in chosen])
    labels = np.array([langs.index(r[0]) for r in rows for _ in r[2]])
    by_label = [np.flatnonzero(labels == i) for i in range(len(langs))]
    most = max(map(len, by_label))
    even = np.concatenate([np.resize(places, most) for places in by_label])
    return langs, train(windows[even], labels[even], len(langs))


def document_probabilities(p: dict, texts: list[bytes]) -> np.ndarray:
    """The mean over all positions of each text, [texts, labels]."""
    count = len(p["b"])
    sums = np.zeros((len(texts), count))
    lengths = np.array([max(1, len(t)) for t in texts], np.float64)
    pieces, owners, held = [], [], 0

    def pool() -> None:
        block = np.concatenate(pieces)
        owner = np.concatenate(owners)
        for at in range(0, len(block), TOGETHER):
            part = block[at : at + TOGETHER]
            probs = positions(p, part)
            probs *= (part.T != 256)[..., None]
            np.add.at(sums, owner[at : at + TOGETHER], probs.sum(axis=0))

    for i, raw in enumerate(texts):
        made = windows_of(raw)
        pieces.append(made)
        owners.append(np.full(len(made), i))
        held += len(made)
        if held >= TOGETHER:
            pool()
            pieces, owners, held = [], [], 0
    if held:
        pool()
    return sums / lengths[:, None]


def predict(
    docs: DataFrame, langs: list[str], weights: dict | None, *, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The columns ``keep`` (all) of each row, with ``lang_pred`` and ``score``, or what ``names`` calls them.

    Every byte position of the whole text is labelled and the probabilities
    are averaged over the document. Null texts, texts without a letter, and all
    texts where nothing was learnt get ``und`` with score 0. Columns of the
    added names are replaced; repeated rows are each judged; an empty table
    gives an empty one. The weights are a few kilobytes whatever the data.
    """
    ship(docs.sparkSession)
    kept = [c for c in (keep or docs.columns) if c.lower() not in {n.lower() for n in names}]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                labels, scores = [NONE] * batch.num_rows, [0.0] * batch.num_rows
                texts = batch.column("whole").to_pylist()
                judged = [i for i, t in enumerate(texts) if t and weights is not None and _letter(t)]
                probs = document_probabilities(weights, [texts[i].encode() for i in judged]) if judged else ()
                for i, row in zip(judged, probs, strict=True):
                    best = int(np.argmax(row))
                    labels[i], scores[i] = langs[best], min(1.0, round(float(row[best]), 6))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    schema = StructType(source.schema.fields[:-1]).add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(run, schema).toDF(*kept, *names)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the training: its crc32 leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Learn from the documents that are not held out, then judge every document by its text alone.

    Nulls, repeats, empty and very long texts, empty tables and columns of the
    added names are as in :func:`learn` and :func:`predict`; a null id is not held out.
    """
    langs, weights = learn(docs.where(~held_out(F.col(f"`{doc_id}`"))), text=text, lang=lang, doc_id=doc_id)
    return predict(docs, langs, weights, text=text, keep=keep, names=names)
