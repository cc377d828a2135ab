"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads running text, across words and lines, in pieces of about ``PIECE`` bytes that end between
characters, from both ends at once, and labels every position with language probabilities. A
document's probabilities are the mean over all its positions. Long texts take no more memory than short
ones, and equal texts get equal labels.

It is trained in numpy by backpropagation through time, on the driver, over ``TRAIN_PIECES`` pieces of
passages of at most ``TRAIN_CHARS`` characters from about ``TRAIN_PER_LANG`` documents of each language, chosen by the hash of doc_id. Whole texts are
labelled. Null texts and those without a letter get `und` with score 0. With no labelled document
at all, every text gets `und`. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Texts, held_out, read, text_slices

PIECE = 64
HIDDEN = 12
#: Bounds of the training sample.
TRAIN_PER_LANG = 150
TRAIN_CHARS, TRAIN_PIECES = 4000, 4000
#: Languages at most: more distinct values are no languages, and raise an error.
MAX_LANGS = 2000
#: Bytes of text whose pieces are read at once, and pieces in one batch of the network: few enough that each product of matrices stays in one thread.
LABEL_BYTES, BATCH = 1 << 20, 512
GATES = 3 * HIDDEN


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent layer: update gate z, reset gate r, candidate n; h = (1 - z) n + z h."""

    def __init__(self, rng: np.random.Generator):
        self.inputs = rng.normal(0, 0.3, (256, GATES)).astype(np.float32)
        self.recurrent = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATES)).astype(np.float32)

    def forward(self, codes: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States (time, word, unit) for byte codes (time, word)."""
        h = np.zeros((codes.shape[1], HIDDEN), np.float32)
        states = np.empty((*codes.shape, HIDDEN), np.float32)
        for t, code in enumerate(codes):
            x, u = self.inputs[code], h @ self.recurrent
            gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            if kept is not None:
                kept.append((code, h, z, r, n, u[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            states[t] = h
        return states

    def backward(self, kept: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of inputs and recurrent weights, through all steps of time."""
        d_in, d_rec = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        carry = np.zeros_like(d_states[0])
        for t in range(len(kept) - 1, -1, -1):
            code, h, z, r, n, u = kept[t]
            d = d_states[t] + carry
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (h - n) * z * (1 - z)
            d_r = d_n * u * r * (1 - r)
            np.add.at(d_in, code, np.concatenate([d_z, d_r, d_n], 1))
            d_u = np.concatenate([d_z, d_r, d_n * r], 1)
            d_rec += h.T @ d_u
            carry = d * z + d_u @ self.recurrent.T
        return [d_in, d_rec]


class Network:
    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.out = rng.normal(0, 0.2, (2 * HIDDEN, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [self.ahead.inputs, self.ahead.recurrent, self.back.inputs, self.back.recurrent, self.out, self.bias]

    def label(self, codes: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Language probabilities (time, word, language) of every position, and the states they come from."""
        first, second = kept or (None, None)
        states = np.concatenate([self.ahead.forward(codes, first), self.back.forward(codes[::-1], second)[::-1]], 2)
        p = np.exp(states @ self.out + self.bias)
        return p / p.sum(2, keepdims=True), states

    def train(self, groups: list[tuple[np.ndarray, np.ndarray]], epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
        """groups: byte codes (time, word) and language numbers of words of one length each. Adam steps."""
        rng = np.random.default_rng(seed)
        params = self._parameters()
        mean, power, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        parts = [(g, s) for g, (codes, _) in enumerate(groups) for s in range(0, codes.shape[1], batch)]
        total = max(1, epochs * len(parts))
        for _ in range(epochs):
            order = [rng.permutation(c.shape[1]) for c, _ in groups]
            for k in rng.permutation(len(parts)):
                g, s = parts[k]
                pick = order[g][s : s + batch]
                codes, goal = groups[g][0][:, pick], groups[g][1][pick]
                kept: tuple[list, list] = ([], [])
                p, states = self.label(codes, kept)
                error = p.copy()
                error[:, np.arange(len(goal)), goal] -= 1
                error /= error.shape[0] * error.shape[1]
                d = error @ self.out.T
                grads = [*self.ahead.backward(kept[0], d[:, :, :HIDDEN]), *self.back.backward(kept[1], d[::-1, :, HIDDEN:]), np.einsum("twi,twj->ij", states, error, optimize=True), error.sum((0, 1))]
                step += 1
                now = rate * (1 - step / (total + 1))
                for x, m, v, grad in zip(params, mean, power, grads, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    x -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def sums(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Summed position probabilities of pieces of a few sizes: (piece, language)."""
        out = np.zeros((len(starts), len(self.langs)), np.float32)
        size, batch = ends - starts, max(64, BATCH * 16 // (16 + len(self.langs)))
        order = np.argsort(size, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ():
            for lo in range(0, len(part), batch):
                some = part[lo : lo + batch]
                out[some] = self.label(_codes(data, starts[some], int(size[some[0]])))[0].sum(0)
        return out

    def documents(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language and its mean probability, for each text."""
        starts, ends, of = pieces(texts)
        p = self.sums(LOWER[texts.data], starts, ends)
        total = np.stack([np.bincount(of, p[:, k], minlength=len(texts)) for k in range(p.shape[1])], 1)
        best = total.argmax(1)
        return best, total[np.arange(len(texts)), best] / np.maximum(total.sum(1), 1e-9)


def pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of pieces of about PIECE bytes that cover the texts and cut no character."""
    sizes = np.diff(texts.bounds)
    many = -(-sizes // PIECE)
    of = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    starts = texts.bounds[of] + nth * PIECE
    inside = np.append((texts.data & 0xC0) == 0x80, False)
    last = texts.bounds[1:][of]
    for _ in range(3):  # a character has at most three bytes after its first
        starts = np.where((nth > 0) & (starts < last) & inside[starts], starts + 1, starts)
    ends = np.append(starts[1:], 0)
    final = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
    ends[: len(of)][final] = last[final]
    ends = ends[: len(of)]
    keep = ends > starts
    return starts[keep], ends[keep], of[keep]


def _codes(data: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Byte codes (time, piece) of pieces of one size, with a space at either end."""
    codes = np.full((size + 2, len(begin)), 32, np.uint8)
    codes[1:-1] = data[begin + np.arange(size)[:, None]]
    return codes


def train(texts: list[str], langs: list[str], count: int = TRAIN_PIECES, seed: int = 5) -> Network:
    """Fit a network to pieces of labelled texts, equally many of each language."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    sizes: dict[int, list] = {}
    for k, name in enumerate(names):
        own = [t for t, x in zip(texts, langs, strict=True) if x == name]
        (_, _, joined), = text_slices(pa.array(["\n".join(own)]), 1 << 40)
        starts, ends, _ = pieces(joined)
        if not len(starts):
            continue
        pick = rng.choice(len(starts), min(len(starts), max(1, count // len(names))), replace=False)
        size = (ends - starts)[pick]
        for n in np.unique(size):
            codes = _codes(LOWER[joined.data], starts[pick][size == n], int(n))
            sizes.setdefault(int(n), []).append((codes, np.full(codes.shape[1], k)))
    network = Network(names)
    network.train([(np.concatenate([c for c, _ in parts], 1), np.concatenate([y for _, y in parts])) for _, parts in sorted(sizes.items())])
    return network


def training_sample(documents: DataFrame, per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], list[str]]:
    """Texts and languages of about ``per_lang`` documents of each language, none held out."""
    able = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    counts = {r["lang"]: r["count"] for r in able.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} values of lang")
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_lang / n)])
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    # A passage of each, from a place that its doc_id decides: what comes to the driver is bounded in characters, too.
    first = 1 + F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(1)).cast("long")).cast("int")
    passage = F.substring("text", first, F.lit(TRAIN_CHARS)).alias("text")
    rows = able.where(at < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0))).select("doc_id", passage, "lang").toPandas().sort_values(["doc_id", "text"])
    return rows["text"].tolist(), rows["lang"].tolist()


def identify(documents: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``documents`` (doc_id, text)."""
    schema = "doc_id long, lang_pred string, score double"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if network is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        names = np.array([*shared.value.langs, "und"], object)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text"), LABEL_BYTES):
                best, score = shared.value.documents(texts)
                letters = np.array(batch.column("letters").slice(lo, hi - lo).to_pylist(), bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(names[np.where(letters, best, len(names) - 1)], pa.string()), pa.array(np.where(letters, score, 0.0).astype(np.float64))],
                    names=["doc_id", "lang_pred", "score"],
                )

    return rows.mapInArrow(run, schema)


def language_id(documents: DataFrame) -> DataFrame:
    """Train on the labelled documents and label all."""
    texts, langs = training_sample(documents)
    return identify(documents, train(texts, langs) if texts else None)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id(read(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
