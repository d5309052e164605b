"""Personal data: fixed patterns, and a skip-chain conditional random field for what they miss.

The field runs over the tokens that look like data and their neighbours. Its nodes are tokens, its labels
the kinds of data and `O`. Edges join neighbours, and each token with the next one that repeats it or has
the same digits (so a token met a thousand times has a thousand links, not half a million). Sum-product
messages go along all edges until the beliefs settle; equal tokens then pull each other to one label across
the whole document. Weights come from the pseudo-likelihood of labelled documents, by default those that the patterns
label; a share of the labelled tokens shows only what stands around it, so that the field learns more than the patterns.
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

from vectide.llm.shared import kept
from vectide.llm.spans import joined, sha256

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *(f"crf_{kind}" for kind in BASE)]
LABELS = ["O", *BASE]
# Documents the field is fitted on, picked by hash of what they hold.
SAMPLE = 1500
# Bytes of text that the sample may have, and the longest text in it.
SAMPLE_BYTES, LONGEST = 32 << 20, 4 << 20
# Share of the labelled tokens whose own features are hidden while the field is fitted.
HIDDEN = 0.3
BUCKETS = 1 << 12
ROUNDS = 12
SEED = 5

# fixed values: the patterns of the base findings
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_LOOKS = re.compile(r"[0-9@]")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ to the left as far as the pattern and the match before allow, so long runs are read once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Every four parts of a dotted run of numbers are a match, kept if none is above 255."""
    out = []
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        places = []
        for part in parts:
            places.append((at, at + len(part), part))
            at += len(part) + 1
        for i in range(0, len(places) - 3, 4):
            four = places[i:i + 4]
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for _, _, p in four):
                out.append((four[0][0], four[3][1]))
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for kind, finder in (("ip", addresses), ("card", cards), ("phone", phones)):
            found += [(kind, a, b) for a, b in finder(text)]
    return found


@dataclass
class Chain:
    """The tokens of a document that the field sees."""

    places: list[tuple[int, int]]
    features: list[np.ndarray]
    context: list[np.ndarray]  # those of the features that the token itself has no part in
    edges: np.ndarray   # pairs of token numbers
    skip: np.ndarray    # whether the edge joins distant tokens


def _shape(token: str) -> str:
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", token)))
    return shape[:24]


def _bucket(text: str) -> int:
    return xxhash.xxh32_intdigest(text.encode()) % BUCKETS


def chain(text: str, reach: int = 2) -> Chain | None:
    """None where no token looks like data."""
    if not _LOOKS.search(text):
        return None
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    looks = [i for i, (a, b) in enumerate(tokens) if _LOOKS.search(text, a, b)]
    near = sorted({j for i in looks for j in range(max(0, i - reach), min(len(tokens), i + reach + 1))})
    looks_set, numbers = set(looks), {i: n for n, i in enumerate(near)}
    features, context, edges, skip, last = [], [], [], [], {}
    for n, i in enumerate(near):
        a, b = tokens[i]
        token = text[a:b]
        digits = re.sub(r"[^0-9]", "", token)
        around = [_shape(text[slice(*tokens[j])]) if 0 <= j < len(tokens) else "^" for j in (i - 1, i + 1)]
        names = ["1", f"s:{_shape(token)}", f"d:{min(20, len(digits))}", f"p:{around[0]}|{_shape(token)}",
                 f"n:{_shape(token)}|{around[1]}", f"@{'@' in token}", f".{min(5, token.count('.'))}", f"+{token[:1] == '+'}"]
        before = text[slice(*tokens[i - 1])].lower().strip(".,;:!?()[]") if i else "^"
        outer = ["1", f"P:{around[0]}", f"N:{around[1]}", f"w:{before if before.isalpha() else ''}"]
        features.append(np.unique([_bucket(name) for name in names + outer]))
        context.append(np.unique([_bucket(name) for name in outer]))
        if numbers.get(i - 1) == n - 1 and n:
            edges.append((n - 1, n))
            skip.append(False)
        if i in looks_set:
            core = token.strip(".,;:!?()[]\"'").lower()
            for key in {f"t:{core}", f"d:{digits}" if len(digits) >= 7 else f"t:{core}"}:
                if key in last and (not edges or edges[-1] != (last[key], n)):
                    edges.append((last[key], n))
                    skip.append(True)
                last[key] = n
    return Chain([tokens[i] for i in near], features, context, np.array(edges, np.int64).reshape(-1, 2), np.array(skip, bool))


def gold(c: Chain, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """The label of each token: that of the first span, by kind, that covers a part of it."""
    out = np.zeros(len(c.places), np.int64)
    starts, ends = (np.array(side, np.int64) for side in zip(*c.places))  # both ascending
    for kind, a, b in sorted(spans, key=lambda s: -BASE.index(s[0])):
        out[np.searchsorted(ends, a, "right"):np.searchsorted(starts, b, "left")] = LABELS.index(kind)
    return out


@dataclass
class Field:
    unary: np.ndarray   # bucket x label
    step: np.ndarray    # label x label, for neighbours
    skip: np.ndarray    # label x label, for repeats

    def beliefs(self, c: Chain, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product; messages are damped by half, which keeps short cycles from swinging."""
        local = np.stack([self.unary[f].sum(axis=0) for f in c.features])
        if not len(c.edges):
            return local
        pair = np.where(c.skip[:, None, None], self.skip, self.step)
        source = np.concatenate([c.edges[:, 0], c.edges[:, 1]])
        target = np.concatenate([c.edges[:, 1], c.edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(c.edges)) + len(c.edges), np.arange(len(c.edges))])
        sent = np.zeros((len(source), len(LABELS)))
        for _ in range(rounds):
            total = local.copy()
            np.add.at(total, target, sent)
            out = (total[source] - sent[back])[:, :, None] + pair
            top = out.max(axis=1, keepdims=True)
            new = (top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - sent).max()
            sent = 0.5 * sent + 0.5 * new
            if change < 1e-3:
                break
        total = local.copy()
        np.add.at(total, target, sent)
        return total


def fit(chains: list[Chain], labels: list[np.ndarray], epochs: int = 25, decay: float = 1e-3) -> Field:
    """Pseudo-likelihood: each token's label given the labels of all tokens it has an edge with, by Adagrad.

    Weights are drawn to zero, those of repeats to agreement, which holds where the sample has few repeats.
    Without data all tokens get label O.
    """
    n = len(LABELS)
    field = Field(np.zeros((BUCKETS, n)), np.zeros((n, n)), np.eye(n))
    field.unary[_bucket("1"), 0] = 1.0
    squares = [np.full_like(w, 1e-3) for w in (field.unary, field.step, field.skip)]
    rng = np.random.default_rng(SEED)
    for _ in range(epochs if chains else 0):
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 32)):
            shift, rows, owner, gu, gs, gk = 0, [], [], [], np.zeros((n, n)), np.zeros((n, n))
            y = np.concatenate([labels[i] for i in part])
            for i in part:
                hide = (labels[i] > 0) & (rng.random(len(labels[i])) < HIDDEN)
                rows += [o if h else f for f, o, h in zip(chains[i].features, chains[i].context, hide)]
                owner.append(chains[i].edges + shift)
                gu.append(chains[i].skip)
                shift += len(chains[i].features)
            edges, skip = np.concatenate(owner), np.concatenate(gu)
            flat, mine = np.concatenate(rows), np.repeat(np.arange(shift), [len(r) for r in rows])
            scores = np.zeros((shift, n))
            np.add.at(scores, mine, field.unary[flat])
            pair = np.where(skip[:, None, None], field.skip, field.step)
            a, b = edges[:, 0], edges[:, 1]
            each = np.arange(len(edges))
            np.add.at(scores, b, pair[each, y[a], :])
            np.add.at(scores, a, pair[each, :, y[b]])
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(shift), y] -= 1
            p /= shift
            unary = np.zeros_like(field.unary)
            np.add.at(unary, flat, p[mine])
            for grad, chosen in ((gs, ~skip), (gk, skip)):
                np.add.at(grad, y[a[chosen]], p[b[chosen]])
                np.add.at(grad.T, y[b[chosen]], p[a[chosen]])
            for weights, grad, square, prior in zip(
                    (field.unary, field.step, field.skip), (unary, gs, gk), squares, (0, 0, np.eye(n))):
                grad = grad + decay * (weights - prior)
                square += grad ** 2
                weights -= 0.2 * grad / np.sqrt(square)
    return field


def added_spans(c: Chain, field: Field, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of tokens with one label that no base finding touches."""
    best = field.beliefs(c).argmax(axis=1)
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    joined_by = {(a, b) for (a, b), far in zip(c.edges.tolist(), c.skip.tolist()) if not far}
    out, n = [], 0
    while n < len(best):
        end = n + 1
        while end < len(best) and best[end] == best[n] and (end - 1, end) in joined_by:
            end += 1
        if best[n]:
            a, b = c.places[n][0], c.places[end - 1][1]
            met = bisect_left(starts, b)
            if not met or reach[met - 1] <= a:
                out.append((f"crf_{LABELS[best[n]]}", a, b))
        n = end
    return out


_FOUND = "doc_id long, base array<struct<kind:string,start:long,end:long>>, text string"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _find(batches):
    """Base findings, and the text itself only where the field has something to read."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        bases = [base_spans(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in bases], _SPAN),
             pa.array([t if _LOOKS.search(t) else None for t in texts], pa.string())], names=["doc_id", "base", "text"])


def _triples(base: list[dict]) -> list[tuple[str, int, int]]:
    return [(s["kind"], s["start"], s["end"]) for s in base]


def _first_by_hash(found: DataFrame, sample: int) -> list:
    """Up to `sample` different texts, the first by (hash, text), with their base findings and a document that has each.

    Each task sends its own first rows, so without a cut the driver would get `sample` texts of every task. Rows
    up to a hash are the first rows; the cut is widened until it holds enough of them. Texts above LONGEST bytes are left
    out, and the last ones if all together have more than SAMPLE_BYTES.
    """
    rows = found.filter(F.octet_length("text") <= LONGEST).withColumn("_hash", F.xxhash64("text"))
    share = 2.0 * sample / max(rows.count(), 1)
    while share < 1.0:
        near = rows.filter(F.col("_hash") <= int(share * 2.0**64) - 2**63)
        if near.select("_hash").distinct().limit(sample).count() == sample:
            rows = near
            break
        share *= 8
    sized = rows.groupBy("_hash").agg(F.max(F.octet_length("text")).alias("n")).orderBy("_hash").limit(sample).collect()
    total = np.cumsum([r["n"] for r in sized])
    wanted = [r["_hash"] for r, size in zip(sized, total) if size <= SAMPLE_BYTES]
    if not wanted:
        return []
    return rows.filter(F.col("_hash") <= wanted[-1]).groupBy("_hash", "text").agg(
        F.min("doc_id").alias("doc_id"), F.first("base").alias("base")).orderBy("_hash", "text").limit(sample).collect()


def train(found: DataFrame, sample: int = SAMPLE, labels: DataFrame | None = None) -> Field:
    """Fits on up to `sample` different texts with something that looks like data.

    `labels` (doc_id, kind, start, end: code points, end exclusive) are their personal data; without them the base
    findings are.
    """
    rows = _first_by_hash(found, sample)
    spans = [_triples([s.asDict() for s in r["base"]]) for r in rows]
    if labels is not None:
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        given: dict[int, list] = {}
        for r in labels.filter(F.col("doc_id").isin(ids) & F.col("kind").isin(BASE)).select("doc_id", "kind", "start", "end").collect() if ids else ():
            given.setdefault(r["doc_id"], []).append((r["kind"], r["start"], r["end"]))
        spans = [given.get(r["doc_id"], []) for r in rows]
    pairs = [(c, gold(c, mine)) for r, mine in zip(rows, spans) if (c := chain(r["text"]))]
    return fit([c for c, _ in pairs], [y for _, y in pairs])


def _label(field: Field):
    def run(batches):
        for batch in batches:
            counts, digests, spans = [[] for _ in BASE], [], []
            for base, text in zip(batch.column("base").to_pylist(), batch.column("text").to_pylist()):
                base = _triples(base)
                for n, kind in zip(counts, BASE):
                    n.append(sum(s[0] == kind for s in base))
                digests.append(sha256(joined(base, KINDS)))
                c = chain(text) if text is not None else None
                more = added_spans(c, field, base) if c else []
                spans.append(joined(base + more, KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(n, pa.int64()) for n in counts], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None,
         labels: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    Without a field one is trained, on `labels` or on the base findings (see `train`).

    spans lists all findings as kind:start:end (code points, end exclusive), those of the field as
    `crf_` and the kind. A null text counts as empty. Repeated rows and rows without id are answered each
    for itself. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = kept(rows.mapInArrow(_find, _FOUND), "findings")
    return found.mapInArrow(_label(field or train(found, labels=labels)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                                          "base_sha256 string, spans string")
