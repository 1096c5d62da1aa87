"""Operator 6: secret scans.

Three base patterns (assigned values, access keys, hex runs) give spans that always stay.  Beside them a character
convolutional network in numpy judges every other candidate: a run of 12 or more characters of the token alphabet, with
digits or without, or what base spans leave over of one, together with the characters around it.  What it takes for a
secret is added as a span of kind ``net``.  Maxima are taken over the whole candidate, however long; of a candidate of
more than 48 characters also over windows along it, so that a secret glued into a path counts; the highest score counts,
and the span is the whole candidate.  Shorter runs aren't candidates: an assigned value has 12 or more characters too.

The network is trained on the driver on labelled findings, half of them in contexts of the corpus itself: its candidates
(the base spans as secrets, the others, but for those that a network without the corpus suspects, as none), and, put in their places, credentials of many formats and what looks like
them (addresses, versions, paths, identifiers, phone and card numbers, plain long words).  The corpus gives the candidates
of at most SAMPLE documents, those with the smallest hashed ids, PER_TEXT of each; the rest is made from a seed.  Scores are
calibrated by Platt scaling on a part held out.  The threshold is recall-constrained: the highest that reaches the wanted
recall there, so precision is the best that this recall allows.  The network holds the recall and precision it has there.

Scanning is map-only: no shuffle; candidates are scored in blocks, so memory is bounded by an Arrow batch and a text.

Defined results: a null or empty text has no spans; offsets count code points, end exclusive; spans may overlap between
kinds (a hex run in an assigned value has both); an added span overlaps no base span; repeated rows give repeated results;
a null doc_id is kept; other columns are ignored; an empty table trains on made findings alone and gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import itertools
import random
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, per_document, texts

KINDS = ("assign", "access", "hex", "net")
#: re.A: "letters in either case" means A-Z, not the characters that Unicode folds to them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # greedy runs of 18 or more in all; a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{16,}")
#: Characters of the shortest candidate.
LEAST = 12
#: Documents whose candidates the network is trained on, and candidates of each.
SAMPLE, PER_TEXT = 500, 8
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end), sorted: by start, then in the order of the kinds."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(out)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs of LEAST or more characters, or the parts of runs that base spans leave over."""
    out, ends = [], []
    for start, _, end in taken:
        ends.append(max(end, ends[-1] if ends else 0))
    starts = [x[0] for x in taken]
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect.bisect_right(starts, a)  # base spans from here on start within the run; those before may reach into it
        a = max(a, min(b, ends[k - 1])) if k else a
        parts = []
        while k < len(starts) and starts[k] < b:
            parts.append((a, starts[k]))
            a = max(a, min(b, ends[k]))
            k += 1
        out += [(i, j) for i, j in [*parts, (a, b)] if j - i >= LEAST]
    return out


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- Character network -----------------------------------------------------------------------------------------------

#: Characters of context on each side, of the candidate, and in all.
CONTEXT, BODY = 24, 48
#: Characters from one window along a long candidate to the next.
STRIDE = 8
LENGTH = 2 * CONTEXT + BODY
ALPHABET = string.ascii_letters + string.digits + " \n\t\"'=:;,.!?/+-_@#$%&*()[]{}<>|\\~^`"
CODES = {c: k + 2 for k, c in enumerate(ALPHABET)}  # 0: padding, 1: any other character
EMBED, WIDTH, FILTERS = 12, 5, 32


def codes(text: str) -> list[int]:
    return [CODES.get(c, 1) for c in text]


def encoded(text: str, start: int, end: int) -> list[int]:
    """Context before, candidate of at most BODY characters, context after."""
    left, body, right = text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]
    return [0] * (CONTEXT - len(left)) + codes(left) + codes(body) + [0] * (BODY - len(body)) + codes(right) + [0] * (CONTEXT - len(right))


def views(start: int, end: int) -> Iterator[tuple[int, int]]:
    """What is scored of a candidate: all of it, and where it is longer than BODY also windows along it."""
    yield start, end
    if end - start > BODY:
        yield from ((k, k + BODY) for k in range(start, end - BODY, STRIDE))
        yield end - BODY, end


@dataclass
class Network:
    """Embedding, one convolution with rectifier, maxima over each of the three parts, logistic output."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    last: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    #: At the threshold, on the part held out.
    recall: float = 1.0
    precision: float = 1.0

    #: Where convolution windows lie that start in each part.
    PARTS = ((0, CONTEXT), (CONTEXT, CONTEXT + BODY), (CONTEXT + BODY, LENGTH - WIDTH + 1))

    def forward(self, x: np.ndarray):
        e = self.embed[x]  # (n, LENGTH, EMBED)
        windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).reshape(len(x), LENGTH - WIDTH + 1, EMBED * WIDTH)
        a = windows @ self.conv + self.bias
        at = np.stack([a[:, i:j].argmax(axis=1) + i for i, j in self.PARTS], axis=1)  # (n, 3, FILTERS)
        top = np.maximum(a[np.arange(len(x))[:, None, None], at, np.arange(FILTERS)[None, None, :]], 0)
        flat = top.reshape(len(x), -1)
        return flat @ self.out + self.last, flat, at, windows

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def long_logit(self, text: str, start: int, end: int) -> float:
        """The same for a candidate of any length: the maxima over its part are taken some thousand characters at a time."""
        x = np.array([0] * max(0, CONTEXT - start) + codes(text[max(0, start - CONTEXT) : end + CONTEXT]) + [0] * max(0, end + CONTEXT - len(text)))
        last = len(x) - WIDTH + 1
        tops = []
        for i, j in ((0, CONTEXT), (CONTEXT, CONTEXT + end - start), (CONTEXT + end - start, last)):
            top = np.full(FILTERS, -np.inf)
            for k in range(i, j, 4096):
                e = self.embed[x[k : min(j, k + 4096) + WIDTH - 1]]
                windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=0).reshape(-1, EMBED * WIDTH)
                top = np.maximum(top, (windows @ self.conv + self.bias).max(axis=0))
            tops.append(np.maximum(top, 0))
        return float(np.concatenate(tops) @ self.out + self.last)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))

    def judged(self, views: list[tuple[str, int, int]]) -> np.ndarray:
        """Scores of (text, start, end), whatever their lengths."""
        z, short = np.zeros(len(views)), [k for k, (_, i, j) in enumerate(views) if j - i <= BODY]
        if short:
            z[short] = self.logits(np.array([encoded(*views[k]) for k in short]))
        for k in set(range(len(views))).difference(short):
            z[k] = self.long_logit(*views[k])
        return self.calibrated(z)


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 0, epochs: int = 8, batch: int = 64, rate: float = 3e-3, recall: float = 0.97) -> Network:
    """Adam on three quarters; Platt scaling and the threshold on the rest."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (len(ALPHABET) + 2, EMBED)), rng.normal(0, (2 / (EMBED * WIDTH)) ** 0.5, (EMBED * WIDTH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS), 0.0)
    order = rng.permutation(len(x))
    fit, held = order[len(x) // 4 :], order[: len(x) // 4]
    names = ("embed", "conv", "bias", "out", "last")
    m, v, step = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), 0
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for i in range(0, len(fit), batch):
            xb, yb = x[fit[i : i + batch]], y[fit[i : i + batch]]
            z, flat, at, windows = net.forward(xb)
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - yb) / len(xb)
            dtop = (d[:, None] * net.out[None, :] * (flat > 0)).reshape(len(xb), 3, FILTERS)
            picked = windows[np.arange(len(xb))[:, None, None], at]  # (n, 3, FILTERS, EMBED * WIDTH)
            g = {"out": flat.T @ d, "last": d.sum(), "bias": dtop.sum(axis=(0, 1)), "conv": (picked.reshape(-1, FILTERS, EMBED * WIDTH).transpose(1, 2, 0) @ dtop.reshape(-1, FILTERS).T[:, :, None])[:, :, 0].T}
            back = (dtop[..., None] * net.conv.T[None, None]).reshape(-1, WIDTH, EMBED)
            where = xb[np.arange(len(xb))[:, None, None, None], at[..., None] + np.arange(WIDTH)].reshape(-1, WIDTH)
            back = back.reshape(-1, EMBED)
            g["embed"] = np.stack([np.bincount(where.ravel(), back[:, k], minlength=len(net.embed)) for k in range(EMBED)], axis=1)
            step += 1
            for k in names:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                setattr(net, k, getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    net.embed[0] = 0  # padding
    z, t = net.logits(x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method for the two numbers of the calibration
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        ga, gb = ((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()
        da, db = np.linalg.solve(h, [ga, gb])
        a, b = a - da, b - db
    net.scale = float(a), float(b)
    p = net.scores(x[held])
    net.threshold = float(max((c for c in np.unique(p[t == 1]) if (p[t == 1] >= c).mean() >= recall), default=0.5))
    taken = p >= net.threshold
    net.recall, net.precision = (float(taken[t == 1].mean()) if t.any() else 1.0), (float(t[taken].mean()) if taken.any() else 1.0)
    return net


#: (context before, candidate, context after, whether it is a base span).
Finding = tuple[str, str, str, bool]


def labelled_findings(n: int = 8000, seed: int = 20, corpus: Sequence[Finding] = ()) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """(text, start, end) of ``n`` candidates, and whether each is a secret: half in contexts of ``corpus``, if it has any, the others in invented ones."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, letters, hexa = string.ascii_letters + string.digits, string.ascii_letters, "0123456789abcdef"
    syllables = [pick("bcdfghlmnprst", 1) + pick("aeiou", 1) + r.choice(["", "n", "r", "s", "th"]) for _ in range(80)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(k))
    mixed = lambda k: pick(alnum, k - 3) + pick(string.digits, 1) + pick(string.ascii_lowercase, 1) + pick(string.ascii_uppercase, 1)
    secrets = [
        lambda: mixed(r.randint(16, 44)),
        lambda: pick(letters, r.randint(20, 40)),
        lambda: r.choice(["ghp_", "sk-", "xoxb-", "glpat-", "pk_live_", "npm_", "SG."]) + r.choice([mixed, lambda k: pick(letters, k)])(r.randint(20, 40)),
        lambda: "eyJ" + mixed(30) + ".eyJ" + mixed(40) + "." + mixed(40),
        lambda: base64.b64encode(r.randbytes(r.randint(18, 48))).decode(),
        lambda: pick(hexa, r.choice([32, 40, 64])).upper() if r.random() < 0.5 else mixed(32),
    ]
    lookalikes = [
        lambda: pick(string.digits, r.choice([13, 15, 18, 20])) + r.choice([".", "-", ""]),
        lambda: f"{word()}.{r.choice(['example', word()])}.{r.choice(['com', 'org', 'net'])}/{word()}/{r.randint(1, 9999)}",
        lambda: f"mail{r.randint(0, 99)}.example.{r.choice(['com', 'org'])}",
        lambda: f"/usr/{word()}/{word()}-{r.randint(1, 20)}.{r.randint(0, 9)}/{word()}",
        lambda: f"{word()}-{word()}-{r.randint(1, 40)}.{r.randint(0, 20)}.{r.randint(0, 20)}.tar",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}",
        lambda: word() + word() + word() + word() + r.choice([".", "-", "/"]) + pick(string.digits, r.randint(1, 3)),
        lambda: "-".join(pick(string.digits, 4) for _ in range(4)),
        lambda: ".".join(str(r.randint(10, 255)) for _ in range(4)),
        lambda: r.choice("=-_.") * r.randint(12, 40) + r.choice(["", pick(string.digits, 2) + "=" * 6]),
        lambda: "_".join(word() for _ in range(4)) + r.choice(["", f"_{r.randint(0, 99)}"]),
        lambda: "".join(word().capitalize() for _ in range(r.randint(2, 5))),
        lambda: r.choice([str, str.capitalize, str.upper])("".join(word() for _ in range(r.randint(3, 6)))) + r.choice(["", "", ".", "-" + word()]),
        lambda: "/".join(word() for _ in range(r.randint(3, 8))),
    ]
    before = ["key is ", "auth: ", "Authorization: Bearer ", "credential=", "export ACCESS=", "pwd ", '"private": "', "login with ", ""]
    plain = ["see ", "at ", "number ", "file ", "visit ", "order ", "card ", ""]
    own = [x[1] for x in corpus if x[3]], [x[1] for x in corpus if not x[3]]
    out, y = [], np.zeros(n)
    for k in range(n):
        y[k] = r.random() < 0.4
        here, made = own[0 if y[k] else 1], secrets if y[k] else lookalikes
        body = r.choice(here) if here and r.random() < (0.1 if y[k] else 0.5) else r.choice(made)()
        mail = not y[k] and r.random() < 0.1
        body = lookalikes[2]() if mail else body
        while len(body) < LEAST:
            body += pick(string.ascii_lowercase, 1)
        if corpus and r.random() < 0.5:
            left, _, right, _ = r.choice(corpus)
            lead = f"{word()}.{r.randint(0, 99)}@" if mail else r.choice(before) if r.random() < (0.3 if y[k] else 0.05) else ""
            left = left + lead
        else:
            lead = f"{word()}.{r.randint(0, 99)}@" if mail else r.choice(before if (r.random() < 0.6) == bool(y[k]) else plain)
            left, right = prose(r.randint(0, 6)) + r.choice([" ", "\n", " "]) + lead, r.choice([" ", "\n", '" ', ", "]) + prose(r.randint(0, 6))
        out.append((left + body + right, len(left), len(left) + len(body)))
    return out, y


def corpus_findings(docs: DataFrame, sample: int = SAMPLE, per_text: int = PER_TEXT) -> list[Finding]:
    """Candidates of the ``sample`` documents with the smallest hashed ids, ``per_text`` of each, spread over the text; both are bounds on training rows alone.

    Repeated rows can hold more candidates; then the first ``sample * per_text`` in order of their characters are taken.
    """
    chosen = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in texts(batch.column(1)):
                base = base_spans(text)
                found = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in candidates(text, base)]
                out += [(text[max(0, a - CONTEXT) : a], text[a : min(b, a + 4 * BODY)], text[b : b + CONTEXT], yes) for a, b, yes in found[:: -(-len(found) // per_text) or 1]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["before", "body", "after", "base"])

    found = id_text(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "before string, body string, after string, base boolean")
    return [tuple(r) for r in found.orderBy("body", "before", "after", "base").limit(sample * per_text).collect()]


def trained(corpus: Sequence[Finding] = (), n: int = 8000, seed: int = 20) -> Network:
    found, y = labelled_findings(n, seed, corpus)
    short = np.array([j - i <= BODY for _, i, j in found])  # longer ones are scored by windows of that length
    return train_network(np.array([encoded(*f) for f, s in zip(found, short, strict=True) if s]), y[short], seed)


@functools.lru_cache(maxsize=2)
def default_network(n: int = 5000, seed: int = 20) -> Network:
    """Without a corpus."""
    return trained((), n, seed)


def corpus_network(docs: DataFrame) -> Network:
    """Candidates that no base pattern has aren't all harmless, so those that the network without a corpus takes for secrets are no examples."""
    found, first = corpus_findings(docs), default_network()
    p = first.judged([(a + x + b, len(a), len(a) + len(x)) for a, x, b, _ in found])
    return trained([f for f, yes in zip(found, (p >= first.threshold).tolist(), strict=True) if f[3] or not yes])


def all_spans(text: str, net: Network) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    more = candidates(text, base)
    seen = ((k, i, j) for k, (a, b) in enumerate(more) for i, j in views(a, b))
    found: set[int] = set()
    while block := list(itertools.islice(seen, 1024)):
        p = net.judged([(text, i, j) for _, i, j in block])
        found.update(k for (k, _, _), yes in zip(block, (p >= net.threshold).tolist(), strict=True) if yes)
    added = [(a, 3, b) for k, (a, b) in enumerate(more) if k in found]
    return base, sorted(base + added)


def secret_spans(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_net."""
    net = net or corpus_network(docs)

    def work(text: str):
        base, spans = all_spans(text, net)
        n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        return n[0], n[1], n[2], hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(spans), n[3]

    return per_document(id_text(docs), lambda: work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long")


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """Overlapping spans go as one."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with every span of ``text`` replaced and n_chars, if there, counted anew; a null text stays null."""
    net = net or corpus_network(docs)
    names = docs.columns
    at, n = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    counted = pa.int64() if n is not None and docs.dtypes[n][1] == "bigint" else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [redacted(t, all_spans(t, net)[1]) for t in texts(batch.column(at))]
            null = batch.column(at).is_null().to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([None if no else t for t, no in zip(clean, null, strict=True)], batch.column(at).type)
            if n is not None:
                columns[n] = pa.array([len(t) for t in clean], counted)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
