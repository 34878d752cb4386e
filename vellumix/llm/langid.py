"""Language identification by a convolutional network over bytes.

Filters of several widths slide over fixed-length windows of a text's UTF-8 bytes;
each filter's greatest response goes through a bias and a ramp to a softmax over
the learned languages.  Bytes enter one-hot, so a filter is a table of 256 weights
for each of its places and a convolution is a sum of look-ups.  The network is
trained in numpy on the driver from a bounded sample of labelled texts (SAMPLE_ROWS
in proportion to the languages, and LEAST_ROWS of a rarer one, for MOST_LANGUAGES
at most; chosen by a hash of doc_id, with windows from places spread over the whole
text) and applied to every window of every whole text.

To reject, a network also learns a class of its own from noise (bytes, digits,
encoded data, scripts that no labelled text uses); labelled windows with numbers
and capitals written over parts of them keep their language.  A document goes if
its mean chance of noise passes a threshold, set between what labelled texts held
back from training reach and what noise held back does.

Nulls and ties: a null text, or one without a letter, gets "und" and score 0.
Rows without lang or doc_id are never learned from.  Equal probabilities go to the
language that sorts first.  Repeated rows get equal results.  Prediction reads
only the text; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vellumix.llm.tokens import doc_groups, released, text_buffers
from vellumix.session import ship

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE_ROWS, SAMPLE_WINDOWS = 3000, 3
LEAST_ROWS, MOST_LANGUAGES = 100, 1000
UND = "und"
_BLOCK = 256
#: First and last letters of scripts that noise is drawn from if no labelled text uses them.
SCRIPTS = ((0x0391, 0x03C9), (0x0410, 0x044F), (0x05D0, 0x05EA), (0x0621, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x3041, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


@dataclass
class ByteNet:
    languages: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    most_noise: float = 1.0

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Greatest response of each filter in each window, and where it is."""
        best, where = [], {}
        for width, table in self.tables.items():
            n = x.shape[1] - width + 1
            total = table[0][x[:, :n]]
            for j in range(1, width):
                total += table[j][x[:, j : j + n]]
            where[width] = total.argmax(1)
            best.append(np.take_along_axis(total, where[width][:, None, :], 1)[:, 0])
        return np.concatenate(best, 1), where

    def probabilities(self, hidden: np.ndarray) -> np.ndarray:
        logits = np.maximum(hidden + self.bias, 0) @ self.out + self.out_bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def paired(self) -> PairedNet:
        return PairedNet(self)


class PairedNet:
    """The same network with look-ups by pairs of bytes, for bulk prediction."""

    def __init__(self, net: ByteNet):
        self.net, self.parts = net, []
        for width, table in net.tables.items():
            looks = []
            for j in range(0, width - 1, 2):
                looks.append((j, True, (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(-1, FILTERS).astype(np.float32)))
            if width % 2:
                looks.append((width - 1, False, table[width - 1].astype(np.float32)))
            self.parts.append((width, looks))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.net.languages)))
        for lo in range(0, len(x), _BLOCK):
            one = x[lo : lo + _BLOCK].astype(np.intp)
            two = one[:, :-1] * 256 + one[:, 1:]
            best = []
            for width, looks in self.parts:
                n = one.shape[1] - width + 1
                total = None
                for j, pair, table in looks:
                    got = np.take(table, (two if pair else one)[:, j : j + n], axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                best.append(total.max(1))
            out[lo : lo + _BLOCK] = self.net.probabilities(np.concatenate(best, 1).astype(float))
        return out


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a group's texts and the text of each; the last one ends with its text, short texts are padded."""
    lens = np.diff(bounds)
    counts = -(-lens // WINDOW)
    owner = np.repeat(np.arange(len(lens)), counts)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = bounds[:-1][owner] + np.minimum(index * WINDOW, np.maximum(lens[owner] - WINDOW, 0))
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    x = padded[start[:, None] + np.arange(WINDOW)]
    x[np.arange(WINDOW) >= lens[owner][:, None]] = 0
    return x, owner


def train(texts: list[bytes], labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteNet:
    """Fit by Adam on the cross-entropy, classes weighted by the root of their rarity."""
    r = np.random.default_rng(seed)
    languages = sorted(set(labels))
    bounds = np.cumsum([0] + [len(t) for t in texts])
    x, owner = windows(np.frombuffer(b"".join(texts), np.uint8), bounds)
    y = np.array([languages.index(s) for s in labels], np.intp)[owner]
    hidden = FILTERS * len(WIDTHS)
    net = ByteNet(languages, {w: r.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS}, np.zeros(hidden), r.normal(0, 0.3, (hidden, len(languages))), np.zeros(len(languages)))
    for table in net.tables.values():
        table[:, 0] = 0
    counts = np.bincount(y, minlength=len(languages))
    weight = np.sqrt(len(y) / np.maximum(1, counts))
    weight /= (weight * counts).sum() / len(y)
    params = [*net.tables.values(), net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(x))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            xb, yb = x[at].astype(np.intp), y[at]
            h, where = net.responses(xb)
            act = np.maximum(h + net.bias, 0)
            p = net.probabilities(h)
            p[np.arange(len(at)), yb] -= 1
            p *= (weight[yb] / len(at))[:, None]
            dh = (p @ net.out.T) * (h + net.bias > 0)
            grads = []
            for k, width in enumerate(WIDTHS):
                g = np.zeros_like(net.tables[width])
                part = dh[:, k * FILTERS : (k + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), part.shape)
                for j in range(width):
                    np.add.at(g[j], (np.take_along_axis(xb, where[width] + j, 1), f), part)
                g[:, 0] = 0
                grads.append(g)
            grads += [dh.sum(0), act.T @ p, p.sum(0)]
            step += 1
            speed = rate * (1 - epoch / epochs)
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _sampled(docs: DataFrame, sample_rows: int) -> list:
    """Rows (lang, cuts) of the bounded sample, in a fixed order."""
    labelled = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null and length(text) > 0")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    total = sum(r["count"] for r in counts)
    if not total:
        return []
    quota = {r["lang"]: max(LEAST_ROWS, -(-sample_rows * r["count"] // total)) for r in counts}
    share = {r["lang"]: min(1.0, (1.5 * quota[r["lang"]] + 100) / r["count"]) for r in counts}
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.col("lang"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    n = F.length("text")
    span = F.lit(WINDOW)
    cuts = [F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(n - span, F.lit(0)) + 1) + 1).cast("int"), span) for i in range(SAMPLE_WINDOWS)]
    near = labelled.where(h < of({k: int(v * 1_000_000) + 1 for k, v in share.items()}))
    sample = near.select("lang", F.array(*cuts).alias("cuts"), h.alias("h"), "doc_id").withColumn("t", F.xxhash64("cuts"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t"))
    return sample.withColumn("place", place).where(F.col("place") <= of(quota)).orderBy("h", "doc_id", "lang", "t").select("lang", "cuts").collect()


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ByteNet | None:
    """A network learned from a bounded sample of the labelled rows; None if there are none."""
    rows = _sampled(docs, sample_rows)
    if not rows:
        return None
    return train([c.encode() for row in rows for c in row.cuts], [row.lang for row in rows for _ in row.cuts])


def noise(n: int, seed: int, used: str) -> list[bytes]:
    """Windows of no language: bytes, digits, encoded data, marks, scripts without a character in `used`."""
    r = random.Random(seed)
    present = set(used)
    free = [(lo, hi) for lo, hi in SCRIPTS if not any(lo <= ord(c) <= hi for c in present)]

    def one() -> bytes:
        kind = r.randrange(6 if free else 5)
        if kind == 0:
            return bytes(r.randrange(33, 127) for _ in range(WINDOW))
        if kind == 1:
            return " ".join("".join(r.choice("0123456789.,:-") for _ in range(r.randint(1, 12))) for _ in range(30)).encode()
        if kind == 2:
            return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(WINDOW)).encode()
        if kind == 3:
            return "".join(r.choice("0123456789abcdef") for _ in range(WINDOW)).encode()
        if kind == 4:
            return "".join(r.choice("=-_*#|<>{}[]()/\\;&%$ ") for _ in range(WINDOW)).encode()
        lo, hi = r.choice(free)
        return " ".join("".join(chr(r.randint(lo, hi)) for _ in range(r.randint(2, 8))) for _ in range(30)).encode()

    return [one()[:WINDOW] for _ in range(n)]


def _written_over(text: bytes, r: random.Random) -> bytes:
    """A window with a number or code over up to a third of it, or in capitals."""
    shown = text.decode("utf-8", "replace")
    if r.random() < 0.3:
        return shown.upper().encode()
    size = r.randint(4, max(5, len(shown) // 3))
    code = "".join(r.choice(r.choice(["0123456789", "0123456789abcdef", "0123456789 .-"])) for _ in range(size))
    at = r.randint(0, max(0, len(shown) - size))
    return (shown[:at] + code + shown[at + size :]).encode()[: 2 * WINDOW]


def fit_rejecting(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ByteNet | None:
    """A network that also knows noise, and the chance of noise from which a document is rejected.

    A fifth of the sampled documents is held back, as they are and with numbers and
    capitals written over them.  The threshold is halfway, in log odds, between the
    greatest chance of noise among these and the middle one of noise held back.
    """
    rows = _sampled(docs, sample_rows)
    if not rows:
        return None
    r = random.Random(8)
    back = [i % 5 == 4 for i in range(len(rows))]
    texts, labels = [], []
    for row, held in zip(rows, back):
        if not held:
            for cut in row.cuts:
                one = cut.encode()
                texts += [one, _written_over(one, r)]
                labels += [row.lang] * 2
    used = "".join(c for row in rows for c in row.cuts)
    junk = noise(max(30, len(texts) // 10), 3, used)
    net = train(texts + junk, labels + [UND] * len(junk))
    place = net.languages.index(UND)

    def chances(groups: list[list[bytes]]) -> np.ndarray:
        flat = [t for g in groups for t in g]
        x, owner = windows(np.frombuffer(b"".join(flat), np.uint8), np.cumsum([0] + [len(t) for t in flat]))
        document = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[owner]
        return np.bincount(document, net.paired().probabilities(x)[:, place]) / np.bincount(document)

    real = [[c.encode() for c in row.cuts] for row, held in zip(rows, back) if held] or [[t] for t in texts]
    real += [[_written_over(t, r) for t in g] for g in real]
    odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6)) - np.log1p(-np.clip(p, 1e-6, 1 - 1e-6))
    middle = (odds(chances(real).max()) + odds(np.median(chances([[t] for t in noise(200, 4, used)])))) / 2
    net.most_noise = float(1 / (1 + np.exp(-middle)))
    return net


def _means(fast: PairedNet | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have a window, and the mean probabilities of each such text's windows."""
    rows, means = [np.zeros(0, np.intp)], [np.zeros((0, len(fast.net.languages) if fast else 0))]
    if fast is not None:
        data, offsets = text_buffers(texts)
        for lo, hi in doc_groups(offsets):
            x, owner = windows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if len(x):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                rows.append(lo + owner[first])
                means.append(np.add.reduceat(fast.probabilities(x), first, axis=0) / np.bincount(owner)[owner[first], None])
    return np.concatenate(rows), np.concatenate(means)


def lettered(text: str = "text") -> Column:
    """Whether a text has a letter; false for null."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _predict(net: ByteNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = net.paired() if net else None
        for batch in batches:
            known = batch.column("lettered").to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            rows, means = _means(fast, batch.column("text"))
            if len(rows):
                best[rows], score[rows] = means.argmax(1), means.max(1)
            names = [net.languages[b] if ok and b >= 0 else UND for b, ok in zip(best, known)]
            score[~known | (best < 0)] = 0
            columns = [c for c in batch.schema.names if c not in ("text", "lettered")]
            arrays = [batch.column(c) for c in columns] + [pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score, a row for each row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", held_out().alias("held_out"), "text", lettered().alias("lettered"))
    return chosen.mapInArrow(_predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """Rows of docs, unchanged, that have a letter and whose chance of noise is not over the network's threshold."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = net.paired() if net else None
        for batch in batches:
            sure = np.zeros(batch.num_rows, bool)
            rows, means = _means(fast, batch.column("text"))
            if len(rows):
                sure[rows] = means[:, net.languages.index(UND)] <= net.most_noise if UND in net.languages else True
            yield batch.filter(pa.array(sure))

    return docs.where(lettered()).mapInArrow(released(run), docs.schema)
