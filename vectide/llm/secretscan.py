"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a long run of token characters. Overlapping windows slide over all of it and over the characters on
both sides; each goes through an embedding, one convolution, a maximum over places and a logistic output, in numpy, and
the highest chance of a window counts. Training takes labelled findings; without any, the patterns label the
windows, and half of the positives lose the text before them, so that the network learns the look of a secret and
not only its keyword. The windows are dealt in three by hash: one part is fitted on, one calibrates the chance, with
weights that restore the true share of secrets, and one sets the threshold: the highest that still finds the wanted
share of secrets.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vectide.llm.spans import joined, sha256

KINDS = ["assign", "access", "hex", "model"]
# Windows of each label that the network is made with, picked by their hash.
SAMPLE = 4000
RECALL = 0.98
# A window: characters before its place, and all; the step between windows, and the text behind a candidate that is seen.
BEFORE, WIDTH, STEP, BEHIND = 24, 72, 24, 12
# Characters of a finding that make a window one of a secret.
SEEN = 8
SEED = 11

# fixed values: the patterns of the base findings
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}+")


def base_spans(text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The findings of the fixed patterns. Keys and hex runs of full length lie inside long tokens."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for a, b in tokens:
        found += [("access", *m.span()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
        if b - a >= 32:
            found += [("hex", *m.span()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 32]
    return found


class Spans:
    """Spans that can be asked for the largest overlap with a range, in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]
        self.reach = list(accumulate((b for _, b in self.spans), max))

    def meets(self, a: int, b: int) -> bool:
        n = bisect_left(self.starts, b)
        return n > 0 and self.reach[n - 1] > a

    def shows(self, a: int, b: int) -> bool:
        """Whether the range holds SEEN characters of a span, or all of a shorter one."""
        n = bisect_left(self.starts, b)
        while n > 0 and self.reach[n - 1] > a:
            n -= 1
            x, y = self.spans[n]
            if min(y, b) - max(x, a) >= min(SEEN, y - x) > 0:
                return True
        return False


def places(a: int, b: int) -> list[int]:
    """Where the windows of a candidate begin: together they hold all of it and BEHIND characters after it."""
    return [a, *range(a + STEP, max(a, b + BEHIND - WIDTH + BEFORE + STEP - 1) + 1, STEP)]


def window(text: str, start: int) -> bytes:
    """The characters from BEFORE places ahead of `start`, one byte each, 1 for all that is not ASCII."""
    lead = max(0, BEFORE - start)
    part = text[max(0, start - BEFORE):start - BEFORE + WIDTH]
    return (b"\0" * lead + part.encode("ascii", "replace").replace(b"\0", b"\1") if part.isascii() else
            b"\0" * lead + bytes(ord(c) if 0 < ord(c) < 128 else 1 for c in part)).ljust(WIDTH, b"\0")[:WIDTH]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Network:
    embed: np.ndarray     # character x size
    kernel: np.ndarray    # place x size x filter
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    scale: float = 1.0    # Platt: sigmoid(scale * score + offset)
    offset: float = 0.0
    threshold: float = 1.1

    def _conv(self, chars: np.ndarray):
        x = self.embed[chars]
        width = len(self.kernel)
        n = chars.shape[1] - width + 1
        columns = np.concatenate([x[:, i:i + n] for i in range(width)], axis=2)
        return columns, columns @ self.kernel.reshape(-1, self.kernel.shape[2]) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = [np.empty(0, np.float32)]
        for at in range(0, len(texts), 256):
            chars = np.frombuffer(b"".join(texts[at:at + 256]), np.uint8).reshape(-1, WIDTH)
            pooled = np.maximum(self._conv(chars)[1].max(axis=1), 0)
            out.append(pooled @ self.out + self.shift)
        return np.concatenate(out)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return _logistic(self.scale * self.scores(texts) + self.offset)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 20, size: int = 8, filters: int = 24, width: int = 5,
        recall: float = RECALL, share: float | None = None) -> Network:
    """Adam on the logistic loss over a third of the windows; the others calibrate the chance and set the threshold.

    `share` is the true share of secrets among all windows, by default that of `labels`. With fewer than ten
    windows of either label in a part nothing can be learnt, and the threshold lets nothing through.
    """
    rng = np.random.default_rng(SEED)
    net = Network(*[rng.normal(0, s, shape).astype(np.float32) for s, shape in (
        (0.3, (128, size)), (0.15, (width, size, filters)), (0.01, filters), (0.2, filters))])
    labels = np.asarray(labels, np.float32)
    part = np.array([xxhash.xxh64_intdigest(t, SEED) % 3 for t in texts], np.int64)
    if not len(texts) or min(min(labels[part == n].sum(), (1 - labels[part == n]).sum()) for n in range(3)) < 10:
        return net
    chars = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, WIDTH).copy()
    bare = (labels == 1) & (rng.random(len(labels)) < 0.5)
    chars[bare, :BEFORE] = 0
    used = np.flatnonzero(part == 0)
    names, state, step = ["embed", "kernel", "bias", "out"], {}, 0
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            columns, conv = net._conv(chars[some])
            best = conv.argmax(axis=1)
            pooled = np.take_along_axis(conv, best[:, None], 1)[:, 0]
            hidden = np.maximum(pooled, 0)
            slope = ((_logistic(hidden @ net.out + net.shift) - labels[some]) / len(some)).astype(np.float32)
            back = slope[:, None] * net.out * (pooled > 0)
            rows = np.arange(len(some))[:, None]
            picked = columns[rows, best]                        # example x filter x (place, size)
            kernel = np.einsum("nf,nfk->kf", back, picked)
            embed = np.zeros_like(net.embed)
            flow = (back[:, :, None] * net.kernel.reshape(-1, net.kernel.shape[2]).T).reshape(len(some), -1, width, size)
            for place in range(width):
                np.add.at(embed, chars[some][rows, best + place], flow[:, :, place])
            grads = [embed, kernel.reshape(net.kernel.shape), back.sum(axis=0), slope @ hidden]
            net.shift -= 0.05 * float(slope.sum())
            step += 1
            for name, grad in zip(names, grads):
                m, v = state.get(name, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
                state[name] = m, v
                setattr(net, name, (getattr(net, name) - 0.005 * (m / (1 - 0.9 ** step)) / (
                    np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32))
    texts_of = lambda mask: [chars[i].tobytes() for i in np.flatnonzero(mask)]
    net.scale, net.offset = calibrate(net.scores(texts_of(part == 1)), labels[part == 1], share)
    found = net.probabilities(texts_of((part == 2) & (labels == 1)))
    net.threshold = float(np.quantile(found, 1 - recall))
    return net


def calibrate(scores: np.ndarray, labels: np.ndarray, share: float | None = None, steps: int = 50) -> tuple[float, float]:
    """Scale and offset of a logistic chance, by Newton steps; weights give secrets the share `share` of all windows."""
    own = float(labels.mean())
    share = own if share is None else min(max(share, 1e-9), 1 - 1e-9)
    weight = np.where(labels == 1, share / own, (1 - share) / (1 - own))
    x, beta = np.stack([scores.astype(np.float64), np.ones(len(scores))], axis=1), np.array([1.0, np.log(share / (1 - share))])
    # a weak pull towards the start keeps separable scores finite
    ridge, start = 1e-3 * np.eye(2) * weight.sum() / len(scores), beta.copy()
    for _ in range(steps):
        p = _logistic(x @ beta)
        slope = x.T @ (weight * (p - labels)) + ridge @ (beta - start)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        move = np.linalg.solve(curve, slope)
        beta = beta - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _windows(text: str, labelled: list[tuple[int, int]] | None):
    """(base findings, candidates that no base finding meets, windows of all candidates with their labels)."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    base = base_spans(text, tokens)
    covered = Spans([(a, b) for _, a, b in base])
    secret = covered if labelled is None else Spans(labelled)
    free = [(a, b) for a, b in tokens if not covered.meets(a, b)]
    windows = ((window(text, s), secret.shows(max(a, s - BEFORE), min(b, s + WIDTH - BEFORE))) for a, b in tokens for s in places(a, b))
    return base, free, windows


_LEVELS = 48


def _level(text: bytes) -> int:
    """A window's level: half of all different windows have level 0, a quarter 1, and so on."""
    return min(_LEVELS, 64 - xxhash.xxh64_intdigest(text, SEED + 1).bit_length())


def _labels(batch: pa.RecordBatch):
    column = batch.column("labelled").to_pylist() if "labelled" in batch.schema.names else None
    for n, text in enumerate(batch.column("text").to_pylist()):
        yield text or "", None if column is None else [(s["start"], s["end"]) for s in column[n] or ()]


def _count_levels(batches):
    counts = np.zeros((2, _LEVELS + 1), np.int64)
    for batch in batches:
        for text, labelled in _labels(batch):
            for data, label in _windows(text, labelled)[2]:
                counts[int(label), _level(data)] += 1
    label, level = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int32()), "level": pa.array(level, pa.int32()), "n": counts[label, level]})


def _pick(least: tuple[int, int]):
    def run(batches):
        for batch in batches:
            picked = {(data, int(label)) for text, labelled in _labels(batch) for data, label in _windows(text, labelled)[2]
                      if _level(data) >= least[label]}
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in picked], pa.binary()), pa.array([x for _, x in picked], pa.int32())],
                                             names=["text", "label"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None,
          sample: int = SAMPLE) -> Network:
    """Fits on up to about `sample` different windows of each label, those with the least hashes of all.

    `findings` (doc_id, start, end: code points, end exclusive) are the secrets of the documents; without them
    the base findings are. Documents that share an id share their findings. One pass counts the windows by the
    magnitude of their hash, a second one fetches those that are wanted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if findings is not None:
        spans = findings.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy(
            F.col("doc_id").cast("long").alias("__id")).agg(F.collect_list(F.struct(
                F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("labelled"))
        rows = rows.join(spans, F.col("doc_id") == F.col("__id"), "left").select("text", "labelled")
    else:
        rows = rows.select("text")
    # at most two rows for each level
    counted = rows.mapInArrow(_count_levels, "label int, level int, n long").groupBy("label", "level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, _LEVELS + 1), np.int64)
    for row in counted:
        counts[row["label"], row["level"]] = row["n"]
    upward = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    least = tuple(int(max([0, *np.flatnonzero(side >= sample)])) for side in upward)
    got = rows.mapInArrow(_pick(least), "text binary, label int").distinct().collect()
    order = sorted((r["label"], xxhash.xxh64_intdigest(bytes(r["text"]), SEED + 1), bytes(r["text"])) for r in got)
    kept = [part for label in (0, 1) for part in [x for x in order if x[0] == label][:sample]]
    total = counts.sum(axis=1)
    return fit([t for _, _, t in kept], np.array([x for x, _, _ in kept]), share=float(total[1] / max(total.sum(), 1)))


def _classify(net: Network):
    def run(batches):
        for batch in batches:
            spans, counts, digests = [], [[] for _ in KINDS[:3]], []
            cands, data = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                base, free, _ = _windows(text or "", None)
                spans.append(base)
                digests.append(sha256(joined(base, KINDS)))
                for n, kind in zip(counts, KINDS):
                    n.append(sum(s[0] == kind for s in base))
                for a, b in free:
                    at = places(a, b)
                    cands.append((i, a, b, len(at)))
                    data += [window(text, s) for s in at]
                if len(data) >= 20_000:
                    _mark(net, cands, data, spans)
                    cands, data = [], []
            _mark(net, cands, data, spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(n, pa.int64()) for n in counts],
                 pa.array(digests, pa.string()), pa.array([joined(s, KINDS) for s in spans], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def _mark(net: Network, cands: list[tuple], data: list[bytes], spans: list[list]) -> None:
    """Adds the candidates of which a window reaches the threshold."""
    if data:
        firsts = np.cumsum([0, *[c[3] for c in cands]])[:-1]
        for (i, a, b, _), chance in zip(cands, np.maximum.reduceat(net.probabilities(data), firsts)):
            if chance >= net.threshold:
                spans[i].append(("model", a, b))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", network: Network | None = None,
         findings: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    spans lists all findings as kind:start:end (code points, end exclusive), those of the network as
    `model`. Without a network one is trained on `findings` (see `train`). A null text counts as empty. Repeated
    rows and rows without id are answered each for itself. Extra columns are ignored; an empty table gives an
    empty result.
    """
    net = network or train(docs, id_col, text_col, findings)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_classify(net), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
