"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, the maximum of each filter over a window
feeds a softmax. Training is plain numpy on a bounded sample of labelled windows. Prediction walks the whole text in
windows, in batches: as a byte has few classes, a filter's response is a sum of table entries (one table for each pair
of byte classes), so no multiplication is left. A document's language is the one whose mean probability over its
windows, by letters, is highest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_batches, byte_buffer, documents, fresh

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Windows of each language that training takes, from any number of rows.
TRAIN_WINDOWS = 1500
#: Languages that training can tell apart, so that its sample stays bounded; more are an error.
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
BATCH = 512


def _byte_classes() -> np.ndarray:
    """Letters without case, blanks, digits and marks as one class each, and every byte of longer characters; 0 pads."""
    out = np.full(256, 2, np.int64)
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[48:58] = 3
    out[97:123] = out[65:91] = np.arange(4, 30)
    out[128:] = np.arange(30, 158)
    out[0] = 0
    return out


CLASS_OF = _byte_classes()
CLASSES = 158


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # class, EMBED
    filters: list[np.ndarray]  # for each width: width * EMBED, FILTERS
    bias: list[np.ndarray]
    out: np.ndarray  # filters of all widths, languages
    out_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width the responses to a pair of classes and to what follows it (a class, or a second pair)."""
        made = []
        for width, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            each = [(self.embed @ f[j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(width)]
            pair = lambda x, y: (x[:, None] + y[None, :]).reshape(-1, FILTERS)
            made.append((pair(each[0] + b.astype(np.float32), each[1]), None if width == 2 else each[2] if width == 3 else pair(each[2], each[3])))
        return made


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 8, epochs: int = 4, batch: int = 64, rate: float = 0.01) -> Network:
    """Fit by Adam; windows: rows of byte classes. Classes count alike, whatever their number of windows."""
    rng = np.random.default_rng(seed)
    n, k = len(windows), len(languages)
    total = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.5, (CLASSES, EMBED)), *[rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS], *[np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, total**-0.5, (total, k)), np.zeros(k)]
    weight = 1 / np.maximum(1, np.bincount(labels, minlength=k))
    weight = (weight / weight[labels].mean())[labels]
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            x, y, w8 = windows[rows], labels[rows], weight[rows]
            e = p[0][x]  # rows, WINDOW, EMBED
            hidden, where, cols = [], [], []
            for i, w in enumerate(WIDTHS):
                col = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                r = col @ p[1 + i] + p[1 + len(WIDTHS) + i]
                best = r.argmax(axis=1)
                hidden.append(np.take_along_axis(r, best[:, None], 1)[:, 0])
                where.append(best)
                cols.append(col)
            h = np.maximum(0, np.concatenate(hidden, axis=1))
            prob = _softmax(h @ p[-2] + p[-1])
            d = prob.copy()
            d[np.arange(len(y)), y] -= 1
            d *= (w8 / len(y))[:, None]
            g = [np.zeros_like(q) for q in p]
            g[-2], g[-1] = h.T @ d, d.sum(axis=0)
            dh = (d @ p[-2].T) * (h > 0)
            every = np.arange(len(y))[:, None]
            for i, w in enumerate(WIDTHS):
                part = dh[:, i * FILTERS : (i + 1) * FILTERS]
                seen = cols[i][every, where[i]]  # rows, FILTERS, w * EMBED: what each filter's maximum saw
                g[1 + i] = np.einsum("rf,rfc->cf", part, seen)
                g[1 + len(WIDTHS) + i] = part.sum(axis=0)
                back = part[:, :, None] * p[1 + i].T[None]
                for j in range(w):
                    np.add.at(g[0], x[every, where[i] + j], back[:, :, j * EMBED : (j + 1) * EMBED])
            t += 1
            for q, gq, mq, vq in zip(p, g, m, v, strict=True):
                mq += 0.1 * (gq - mq)
                vq += 0.001 * (gq * gq - vq)
                q -= rate * (mq / (1 - 0.9**t)) / (np.sqrt(vq / (1 - 0.999**t)) + 1e-8)
    k = len(WIDTHS)
    return Network(languages, p[0], p[1 : 1 + k], p[1 + k : 1 + 2 * k], p[-2], p[-1])


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte classes of the windows that begin at starts, zeros beyond their ends."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], CLASS_OF[data[np.minimum(at, max(0, len(data) - 1))]], 0)


class Predictor:
    def __init__(self, net: Network) -> None:
        self.net, self.tables = net, net.tables()
        self.out, self.out_bias = net.out.astype(np.float32), net.out_bias.astype(np.float32)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each language for each window."""
        pair = x[:, :-1] * CLASSES + x[:, 1:]
        hidden = []
        for width, (first, second) in zip(WIDTHS, self.tables, strict=True):
            r = first.take(pair[:, : WINDOW - width + 1], axis=0)
            if width == 3:
                r += second.take(x[:, 2:], axis=0)
            elif width == 4:
                r += second.take(pair[:, 2:], axis=0)
            hidden.append(r.max(axis=1))
        return _softmax(np.maximum(0, np.concatenate(hidden, axis=1)) @ self.out + self.out_bias)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text, its windows weighed by their letters."""
        sizes = np.diff(offsets)
        many = -(-sizes // WINDOW)
        of = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        starts = offsets[:-1][of] + nth * WINDOW
        total = np.zeros((len(sizes), len(self.net.languages)))
        for at in range(0, len(of), BATCH):
            x = cut(data, starts[at : at + BATCH], offsets[1:][of[at : at + BATCH]])
            weight = (x >= 4).sum(axis=1)
            np.add.at(total, of[at : at + BATCH], self.windows(x) * weight[:, None])
        return total / np.maximum(1e-9, total.sum(axis=1, keepdims=True))


def fit(df: DataFrame, label_col: str = "lang", text_col: str = "text", train_windows: int = TRAIN_WINDOWS, seed: int = 8) -> Network | None:
    """Train on the rows of ``df`` with a label, every label that occurs; None without any.

    Bounded: of each language about ``train_windows`` texts, drawn by hash in proportion, and one window of each, at a place
    drawn by hash; copies count once. ValueError beyond MAX_LANGUAGES labels.
    """
    text, label = F.col(f"`{text_col}`").cast("string"), F.col(f"`{label_col}`").cast("string")
    rows = df.select(text.alias("text"), label.alias("label")).filter("text is not null and label is not null")
    counts = rows.groupBy("label").count().limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    draw = F.xxhash64(F.lit(seed), "text")
    unit = F.pmod(draw, F.lit(1_000_000)) / F.lit(1_000_000.0)
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r.label, min(1.0, train_windows / r["count"]))]), F.col("label"))
    rows = rows.filter(unit < share).withColumn("bytes", F.col("text").cast("binary"))
    begin = F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.greatest(F.lit(1), F.octet_length("text") - WINDOW + 1)).cast("int")
    cuts = rows.select("label", draw.alias("draw"), F.substring("bytes", begin + 1, F.lit(WINDOW)).alias("bytes")).distinct()
    # the draw varies little; this holds it in any case, the same way on every run
    first = F.row_number().over(W.partitionBy("label").orderBy("draw", "bytes"))
    got = cuts.withColumn("nth", first).filter(F.col("nth") <= 2 * train_windows).select("label", "bytes").toArrow()
    languages = sorted(set(got.column("label").to_pylist()))
    if not languages:
        return None
    data, offsets = byte_buffer(got.column("bytes").combine_chunks())
    x = cut(data, offsets[:-1], offsets[1:])
    y = np.array([languages.index(v) for v in got.column("label").to_pylist()])
    order = np.lexsort((*x.T[:8], y))  # the order in which rows came must not matter
    return train(x[order], y[order], languages, seed)


def predict(df: DataFrame, net: Network | None, cols: list[str], text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``cols`` of ``df`` with the predicted language and its mean probability over the whole text.

    ``und`` with score 0 where the text is null, empty or without a letter; with score 1 on any other text if nothing could
    be learned, so that a filter on scores doesn't take it for doubtful. Texts count whole, however long; repeated rows
    and ties (the first language by name) are predicted each; an empty table gives an empty result; columns of clashing
    names stay as they are.
    """
    text = F.col(f"`{text_col}`").cast("string")
    [held] = fresh(df, "__text")
    given = text_col in cols and df.schema[text_col].dataType.typeName() == "string"  # then the text need not travel twice
    rows = df.select(*[F.col(f"`{c}`") for c in cols], *([] if given else [text.alias(held)]))
    schema = df.select(*[F.col(f"`{c}`") for c in cols]).withColumns({pred: F.lit(""), score: F.lit(0.0)}).schema
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if net is None else Predictor(net)
        for b in batches:
            values = b.column(cols.index(text_col) if given else held)
            known = pc.fill_null(pc.match_substring_regex(values, r"\pL"), False).to_numpy(zero_copy_only=False)
            langs, scores = np.full(len(values), UNDETERMINED, object), np.zeros(len(values))
            if model is None:
                scores[known] = 1
            elif known.any():
                p = model.texts(*byte_buffer(values))
                names = np.array(model.net.languages, object)
                at = np.flatnonzero(known)
                langs[at], scores[at] = names[p[at].argmax(axis=1)], np.clip(p[at].max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(cols))], pa.array(langs, pa.string()), pa.array(scores)], [*cols, pred, score])

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 4 == 2


def identify(df: DataFrame, min_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``df`` without the rows whose language can't be told: no letter in the text, or a score below ``min_score``.

    Without labelled rows nothing can be learned, and only texts without a letter go.
    """
    net = fit(df.filter(~held_out(id_col)), label_col, text_col)
    pred, score = fresh(df, "__pred", "__score")
    out = predict(df, net, df.columns, text_col, pred, score)
    return out.filter(F.col(score) >= max(min_score, 1e-9)).select(*[F.col(f"`{c}`") for c in df.columns])


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit(docs.filter(~held_out()))
    out = predict(docs.withColumn("held_out", held_out()), net, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")
