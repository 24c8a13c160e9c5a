"""Secret scans: fixed patterns plus a character convolutional network.

The patterns give the base findings.  Every token that could be a secret is a candidate: a run of 8 or more
characters of the alphabet secrets are written in, with a digit or a change from lower to upper case in it.  The network
reads the whole candidate, however long, with the characters around it, and its calibrated probability is compared
with a threshold; candidates above it that touch no base finding are added with the kind ``cnn``.

The network is trained here on labelled findings from a bounded sample of ``sample_docs`` documents.  Positive are the
base findings and about ``planted`` secrets of many shapes, made at random and put into the sampled texts with
and without words that announce them; negative are all other candidates of the sample and about ``planted``
look-alikes (addresses, paths, dates, numbers, versions, identifiers) put in the same way.  At most ``per_doc`` own candidates of
a document are used.  Equal tokens are on one side of every split: of the rest a fifth calibrates the
probabilities (Platt scaling) and sets the threshold, the largest one that keeps the wanted recall there; another
fifth is held out, and the recall and the share of false findings on it are kept in the model (``report``).

Defined cases: a null text is empty; offsets are code points with the end exclusive;
equal rows get equal results; repeated ids and other columns change nothing; without positive or negative examples no network is
fitted and only the base findings are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed patterns; the kinds in the order in which equal starts are listed.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "cnn")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~$@!#%^&*.-]{8,}")
TELLING = re.compile(r"[0-9]|[a-z][A-Z]")
EDGES = ".!-_*#&%$@^~/+="
LEAST = 8

BEFORE, AFTER = 20, 8
EMBED, FILTERS, KERNEL, HIDDEN = 8, 32, 5, 16
WIDTH, STRIDE = 68, 64  # rows overlap by the kernel less one
SYMBOLS = 129  # 0: none; 1 to 127: ASCII; 128: any other character


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]  # runs below 16 fail as a whole
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the candidates, punctuation at their edges left off (but for ``=`` at the end, which pads)."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = m.group()
        if TELLING.search(token):
            a = m.start() + len(token) - len(token.lstrip(EDGES))
            b = m.start() + len(token.rstrip(EDGES[:-1]))
            if b - a >= LEAST:
                out.append((a, b))
    return out


def apart(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the areas that the spans, sorted by start, cover together."""
    starts, ends = [], []
    for a, _, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def touches(areas: tuple[list[int], list[int]], start: int, end: int) -> bool:
    k = bisect.bisect_right(areas[1], start)
    return k < len(areas[0]) and areas[0][k] < end


def codes_of(text: str, start: int, end: int) -> np.ndarray:
    """Symbol codes of a candidate with its context; candidate characters are offset by SYMBOLS."""
    a, b = max(0, start - BEFORE), min(len(text), end + AFTER)
    codes = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.where(codes < 128, np.maximum(codes, 1), 128)
    codes[start - a : end - a] += SYMBOLS
    return codes


def rows_of(examples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Examples of any length as rows of WIDTH: (codes, windows of each row, first row of each example)."""
    rows, windows, first = [], [], []
    for codes in examples:
        first.append(len(rows))
        n = len(codes) - KERNEL + 1
        for at in range(0, n, STRIDE):
            part = codes[at : at + WIDTH]
            rows.append(np.concatenate([part, np.zeros(WIDTH - len(part), np.int64)]))
            windows.append(min(STRIDE, n - at))
    return np.stack(rows), np.array(windows), np.array(first)


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    kernel_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    report: dict = field(default_factory=dict)

    def filters(self, codes: np.ndarray, windows: np.ndarray):
        x = self.embed[codes]
        view = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), -1, KERNEL * EMBED)
        z = view @ self.kernel + self.kernel_bias
        z = np.where(np.arange(z.shape[1])[None, :, None] < windows[:, None, None], np.maximum(z, 0), 0)
        return view, z

    def logits(self, examples: list[np.ndarray]) -> np.ndarray:
        """One logit per candidate; what its rows find is pooled, by the greatest and by the mean."""
        if not examples:
            return np.zeros(0)
        codes, windows, first = rows_of(examples)
        top, total = [], []
        for at in range(0, len(codes), 256):
            z = self.filters(codes[at : at + 256], windows[at : at + 256])[1]
            top.append(z.max(1))
            total.append(z.sum(1))
        top = np.maximum.reduceat(np.concatenate(top), first)
        mean = np.add.reduceat(np.concatenate(total), first) / np.add.reduceat(windows, first)[:, None]
        inner = np.maximum(np.concatenate([top, mean], 1) @ self.hidden + self.hidden_bias, 0)
        return (inner @ self.dense + self.dense_bias)[:, 0]

    def probabilities(self, examples: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(examples) + self.shift, -30, 30)))


def gradients(net: Network, examples: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted logistic loss of a batch."""
    codes, windows, first = rows_of(examples)
    view, z = net.filters(codes, windows)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))
    row_top = z.max(1)
    top = np.maximum.reduceat(row_top, first)
    count = np.add.reduceat(windows, first)[:, None]
    pooled = np.concatenate([top, np.add.reduceat(z.sum(1), first) / count], 1)
    inner = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
    out = (inner @ net.dense + net.dense_bias)[:, 0]
    g = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels) * weight / len(labels))[:, None].astype(np.float32)
    d_inner = (g @ net.dense.T) * (inner > 0)
    d_pooled = d_inner @ net.hidden.T
    d_top, d_mean = d_pooled[:, :FILTERS], d_pooled[:, FILTERS:] / count
    # the greatest value is one place of one row of the example
    chosen = row_top == top[owner]
    d_z = np.zeros_like(z)
    np.put_along_axis(d_z, z.argmax(1)[:, None, :], (d_top[owner] * chosen)[:, None, :], 1)
    d_z += d_mean[owner][:, None, :]
    d_z *= z > 0
    d_view = (d_z @ net.kernel.T).reshape(len(codes), -1, KERNEL, EMBED)
    d_x = np.zeros((len(codes), WIDTH, EMBED), np.float32)
    for k in range(KERNEL):
        d_x[:, k : k + d_view.shape[1]] += d_view[:, :, k]
    d_embed = np.stack([np.bincount(codes.ravel(), d_x[:, :, e].ravel(), 2 * SYMBOLS) for e in range(EMBED)], 1).astype(np.float32)
    return {
        "embed": d_embed,
        "kernel": view.reshape(-1, KERNEL * EMBED).T @ d_z.reshape(-1, FILTERS),
        "kernel_bias": d_z.sum((0, 1)),
        "hidden": pooled.T @ d_inner,
        "hidden_bias": d_inner.sum(0),
        "dense": inner.T @ g,
        "dense_bias": g.sum(0),
    }


def fit(examples: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, recall: float, steps: int = 700, seed: int = 5) -> Network | None:
    """``folds``: 0 calibrates, 1 is held out, the others train; equal tokens have equal folds."""
    labels, folds = np.asarray(labels, np.float32), np.asarray(folds)
    train, check, held = np.flatnonzero(folds > 1), np.flatnonzero(folds == 0), np.flatnonzero(folds == 1)
    if any(not 0 < labels[part].sum() < len(part) for part in (train, check)):
        return None
    rng = np.random.default_rng(seed)
    shapes = {"embed": (2 * SYMBOLS, EMBED), "kernel": (KERNEL * EMBED, FILTERS), "kernel_bias": (FILTERS,), "hidden": (2 * FILTERS, HIDDEN), "hidden_bias": (HIDDEN,), "dense": (HIDDEN, 1), "dense_bias": (1,)}
    p = {k: (rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    net = Network(**p)
    weight = np.where(labels == 1, 0.5 / labels[train].mean(), 0.5 / (1 - labels[train].mean())).astype(np.float32)
    step = 0
    for _ in range(-(-steps * 64 // len(train))):
        rng.shuffle(train)
        for at in range(0, len(train), 64):
            ids = train[at : at + 64]
            grads, step = gradients(net, [examples[i] for i in ids], labels[ids], weight[ids]), step + 1
            rate = 0.005 if step < steps * 0.7 else 0.001
            for k, grad in grads.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    x, y = net.logits([examples[i] for i in check]), labels[check]
    scale = max(float(np.abs(x).mean()), 1e-6)
    slope, shift = 1.0, 0.0
    for _ in range(2000):  # Platt scaling of x / scale
        q = 1 / (1 + np.exp(-np.clip(slope * x / scale + shift, -30, 30)))
        slope -= 0.5 * float(((q - y) * x / scale).mean())
        shift -= 0.5 * float((q - y).mean())
    net.slope, net.shift = slope / scale, shift
    hits = np.sort(net.probabilities([examples[i] for i in check[y == 1]]))
    net.threshold = float(hits[int((1 - recall) * len(hits))])
    found = net.probabilities([examples[i] for i in held]) >= net.threshold
    truth = labels[held] == 1
    net.report = {"examples": len(labels), "recall": float(found[truth].mean()) if truth.any() else None, "false": float(found[~truth].mean()) if (~truth).any() else None}
    return net


class Maker:
    """Random secrets and look-alikes, with words before them."""

    LETTERS, MIXED = string.ascii_letters, string.ascii_letters + string.digits
    LEADS = ["key ", "my password is ", "pwd=", "pass: ", "PASS=", "Authorization: Bearer ", "credentials: ", "access key ", "login admin ", "api key = ", "export KEY=", "private key ", "auth ", "signing ", "use ", "https://root:", "--pass ", "pin: "]
    PLAIN = ["", "see ", "at ", "version ", "file ", "call ", "id ", "on ", "from ", "mail ", "page ", "code ", "in ", "to ", "of ", "ref "]

    def __init__(self, rng: np.random.Generator, words: list[str]):
        self.rng, self.words = rng, [w for w in words if w.isascii() and w.isalpha()] or ["word"]

    def of(self, alphabet: str, low: int, high: int) -> str:
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), int(self.rng.integers(low, high + 1))))

    def pick(self, options: list[str]) -> str:
        return options[int(self.rng.integers(len(options)))]

    def word(self) -> str:
        return self.pick(self.words).lower()

    def secret(self) -> tuple[str, str]:
        """(words before, secret)."""
        of, mixed, digits = self.of, self.MIXED, string.digits
        url = mixed + "-_"
        kind = int(self.rng.integers(10))
        body = [
            lambda: of(mixed + "/+", 40, 40),
            lambda: of(self.LETTERS, 2, 5) + "_" + of(mixed, 20, 44),
            lambda: of(string.ascii_lowercase, 3, 5) + "-" + of(digits, 8, 13) + "-" + of(digits, 8, 13) + "-" + of(mixed, 20, 32),
            lambda: "eyJ" + of(url, 15, 40) + ".eyJ" + of(url, 20, 120) + "." + of(url, 27, 86),
            lambda: of(self.LETTERS, 4, 4) + of(url, 30, 38),
            lambda: of("0123456789ABCDEF", 24, 64),
            lambda: of(mixed + "!@#$%^&*", 8, 20) + of(digits, 1, 2),
            lambda: of(mixed + "/+", 60, 240) + self.pick(["", "=", "=="]),
            lambda: of(string.ascii_lowercase, 2, 4) + "_" + self.pick(["live", "test", "prod", "pat", "bot"]) + "_" + of(mixed, 16, 40),
            lambda: of(mixed, 20, 64),
        ][kind]()
        # short passwords are announced, as nothing else tells them from other short tokens
        lead = self.pick(self.LEADS) if kind == 6 or self.rng.random() < 0.5 else self.pick(self.PLAIN)
        return lead, body

    def lookalike(self) -> tuple[str, str]:
        of, word, digits, n = self.of, self.word, string.digits, lambda a, b: int(self.rng.integers(a, b))
        kinds = [
            lambda: f"{word()}.{word()}{n(1, 99)}@{word()}{n(1, 9)}.example.com",
            lambda: f"{n(1, 99)}@mail{n(1, 9)}.example.com",
            lambda: f"www.{word()}{n(1, 99)}.example.org/{word()}/{word()}-{n(1, 999)}.html",
            lambda: f"/usr/{word()}/{word()}_{n(1, 99)}/{word()}.txt",
            lambda: f"{word()}-{n(0, 20)}.{n(0, 20)}.{n(0, 99)}.tar.gz",
            lambda: f"{n(1990, 2040)}-{n(10, 13)}-{n(10, 29)}T{n(10, 24)}:{n(10, 60)}",
            lambda: f"{n(1990, 2040)}-{n(10, 13)}-{n(10, 29)}",
            lambda: f"{n(100, 999)}-{n(100, 999)}-{n(1000, 9999)}",
            lambda: f"{n(1, 255)}.{n(10, 255)}.{n(10, 255)}.{n(10, 255)}",
            lambda: f"{n(1, 999)}.{of(digits, 6, 12)}",
            lambda: of(digits, 8, 16),
            lambda: word() + "".join(word().capitalize() for _ in range(n(1, 4))),
            lambda: f"{word()}_{word()}_{n(1, 2040)}",
            lambda: f"{of(string.ascii_uppercase, 2, 4)}-{n(100, 99999)}-{of(string.ascii_uppercase, 1, 2)}",
            lambda: f"97{n(8, 10)}-{n(0, 9)}-{n(10, 99)}-{of(digits, 6, 6)}-{n(0, 9)}",
            lambda: f"{n(100, 4000)}x{n(100, 4000)}px",
            lambda: f"{word().capitalize()}{word().capitalize()}{n(1, 2040)}",
            lambda: f"{word()}{n(1, 2040)}",
            lambda: f"{word()}=={n(0, 30)}.{n(0, 30)}.{n(0, 30)}",
            lambda: f"{word()}-{word()}-{word()}-{n(1, 99)}",
        ]
        lead = self.pick(self.LEADS) if self.rng.random() < 0.15 else self.pick(self.PLAIN)
        return lead, kinds[int(self.rng.integers(len(kinds)))]()

    def planted(self, text: str, lead: str, body: str) -> tuple[str, int, int] | None:
        """The body put into a text, as the candidate that a scan would find there."""
        spots = [m.end() for m in re.finditer(r"\s", text[: 1 << 16])] or [len(text)]
        at = spots[int(self.rng.integers(len(spots)))]
        around = text[max(0, at - 40) : at] + lead
        whole = around + body + self.pick([" ", "\n", ". ", '" ', "; "]) + text[at : at + 40]
        for a, b in candidates(whole):
            if a < len(around) + len(body) and b > len(around):
                return whole, a, b
        return None


def token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def examples_of(text: str, per_doc: int, planted: int) -> list[tuple[np.ndarray, int, int]]:
    """(codes, label, hash of the token) of a document's own candidates and of those planted into it."""
    areas, own = apart(base_spans(text)), []
    for a, b in candidates(text):
        own.append((token_hash(text[a:b]), a, b))
    out = [(codes_of(text, a, b), int(touches(areas, a, b)), h) for h, a, b in sorted(own)[:per_doc]]
    maker = Maker(np.random.default_rng(token_hash(text)), text[: 1 << 16].split())
    for k in range(2 * planted):
        put = maker.planted(text, *(maker.secret() if k % 2 else maker.lookalike()))
        if put:
            out.append((codes_of(*put), k % 2, token_hash(put[0][put[1] : put[2]])))
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 4_000, per_doc: int = 8, planted: int = 3_000, recall: float = 0.95, steps: int = 700) -> Network | None:
    """Fit on examples from about ``sample_docs`` documents, chosen by a hash of id and text; the driver gets symbol codes of candidates."""
    total = docs.count()
    if not total:
        return None
    ident, body = common.long_column(docs, doc_id), common.text_column(docs, text)
    part = F.pmod(F.xxhash64(ident, body, F.lit("secrets")), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.where(part < min(1.0, sample_docs / total)).select(body.alias("text"))
    each = max(1, -(-planted // min(total, sample_docs)))
    schema = pa.schema([("codes", pa.binary()), ("label", pa.int32()), ("order", pa.int64())])

    def examples(stream):
        for batch in stream:
            out = {f.name: [] for f in schema}
            for value in batch["text"]:
                for codes, label, order in examples_of(value.as_py() or "", per_doc, each):
                    out["codes"].append(codes.astype("<i2").tobytes())
                    out["label"].append(label)
                    out["order"].append(order)
            yield common.batches(out, schema)

    got = chosen.mapInArrow(common.lean(examples), "codes binary, label int, order long")
    data = sorted((r["order"], bytes(r["codes"]), r["label"]) for r in common.materialize(got, "secrets-sample").collect())
    return fit([np.frombuffer(codes, "<i2").astype(np.int64) for _, codes, _ in data], np.array([label for _, _, label in data]), np.array([order % 5 for order, _, _ in data]), recall, steps)


def spans_of(text: str | None, net: Network | None) -> list[tuple[int, int, int]]:
    """All findings (start, kind, end), sorted by start and kind."""
    text = text or ""
    found = base_spans(text)
    if net is None:
        return found
    areas = apart(found)
    more = [(a, b) for a, b in candidates(text) if not touches(areas, a, b)]
    for at in range(0, len(more), 512):
        part = more[at : at + 512]
        p = net.probabilities([codes_of(text, a, b) for a, b in part])
        found += [(a, 3, b) for (a, b), x in zip(part, p.tolist(), strict=True) if x >= net.threshold]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan(docs: DataFrame, net: Network | None = None, doc_id: str = "doc_id", text: str = "text", **fit_args) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_cnn, base_sha256, spans: one row per input row."""
    net = net or train(docs, doc_id, text, **fit_args)
    shared = common.Shared(docs.sparkSession, net)  # a few thousand numbers
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_cnn", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(stream):
        found = shared.load()
        for batch in stream:
            out = {f.name: [] for f in schema}
            for ident, body in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                spans = spans_of(body.as_py(), found)
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                base = written([s for s in spans if s[1] < 3])
                for name, cell in zip(schema.names, (ident, *counts, hashlib.sha256(base.encode()).hexdigest(), written(spans)), strict=True):
                    out[name].append(cell)
            yield common.batches(out, schema)

    rows = docs.select(common.long_column(docs, doc_id).alias("doc_id"), common.text_column(docs, text).alias("text"))
    return rows.mapInArrow(common.lean(run), "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string")


def redact(docs: DataFrame, net: Network | None = None, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every finding replaced by ``mark``, other columns unchanged; a null text stays null."""
    net = net or train(docs, doc_id, text)
    shared = common.Shared(docs.sparkSession, net)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        found, out = shared.load(), []
        for body in texts:
            body = body.as_py()
            spans = spans_of(body, found)
            if spans:
                parts, at = [], 0
                for a, _, b in spans:
                    if a >= at:
                        parts += [body[at:a], mark]
                    at = max(at, b)
                body = "".join([*parts, body[at:]])
            out.append(body)
        return pa.array(out, pa.string())

    return docs.withColumn(text, clean(F.col(f"`{text}`")))
