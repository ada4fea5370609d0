"""Personal data (operator 7): fixed patterns, extended by a skip-chain conditional random field.

The patterns give the base spans.  The field labels tokens around digits and at signs; its
graph has the chain of tokens and skip edges between distant tokens that repeat each other
or share a key (all digits, the part before an at sign), with or without a digit.  A token
that repeats a key of a token with a digit or an at sign takes part itself.  Loopy message passing lets an
entity found once label its other mentions; a run of tokens whose label is certain enough
(``CERTAIN``) and that no base span touches becomes a span of its own.

Weights come from the pseudo-likelihood of a hash-drawn sample of at most ``TRAIN_DOCS``
texts of at most ``TRAIN_CHARS`` characters, labelled by the patterns; a drawn part of the
entities hides its pattern, so the shapes and the skip edges have to explain it.  Tokens that
are neither candidates, nor repeat a key of one, nor stand next to such a token are fixed to "no entity", so texts without a digit
or an at sign need no look.

Defined results: null and empty texts have no spans; repeated rows give equal rows; spans are
listed by start, then kind, then end; extra columns are ignored; without a training text no
spans are added; a text of any length is searched whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

KINDS = ("email", "ip", "card", "phone")
#: An address's run before the at sign is read backwards and numbers are read from their first
#: digit, so long runs cost linear time; the matches are those of the plain patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PATTERNS = {"ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
            "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
            "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}
GATE = "[0-9@]"
TOKEN = re.compile(r"\S+")
LABELS = 1 + len(KINDS)
FEATURES = 1 << 14
TRAIN_DOCS, TRAIN_CHARS, HIDDEN = 1000, 50_000, 0.4
STEPS, LEARNING, DECAY = 150, 0.1, 1e-3
SWEEPS, DAMPING, CERTAIN = 12, 0.5, 0.95
#: Characters whose tokens pass messages together.
SLICE_CHARS = 1 << 20
_CORE = re.compile(r"[^0-9a-z@.]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.split("."))
    digits = "".join(_DIGIT.findall(match))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind number, end`` of all valid matches, in that order."""
    found = [(a, 0, z) for a, z in emails(text)] if "@" in text else []
    for k, kind in enumerate(KINDS[1:], 1):
        if kind != "phone" or "+" in text:
            found += [(m.start(), k, m.end()) for m in PATTERNS[kind].finditer(text) if valid(kind, m.group())]
    return sorted(found)


def shape(token: str) -> str:
    """Character classes, runs of one class cut to two."""
    out = ""
    for c in token[:40]:
        s = "9" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c
        if out[-2:] != s * 2:
            out += s
    return out


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % FEATURES


def keys(token: str) -> set[str]:
    """What makes distant tokens similar: the bare token, its digits, the part before an at sign."""
    core = _CORE.sub("", token.lower()).strip(".")
    found = {core, core.split("@")[0]} if "@" in core else {core}
    digits = "".join(_DIGIT.findall(core))
    found = {k for k in found if len(k) >= 5}
    return found | {"#" + digits} if len(digits) >= 6 else found


class Graph:
    """Active tokens of some texts: features, chain and skip edges, spans, the labels of the patterns."""

    WIDTH = 7

    def __init__(self):
        self.features, self.spans, self.text, self.labels, self.hide = [], [], [], [], []
        self.chain, self.skip = [], []
        self.fixed = []  # chain neighbours that are fixed to "no entity": 0, 1 or 2

    def add(self, number: int, text: str, base: list[tuple[int, int, int]]) -> None:
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        words = [text[a:z] for a, z in tokens]
        candidate = [i for i, w in enumerate(words) if "@" in w or _DIGIT.search(w)]
        shared: set[str] = set().union(*(keys(words[i]) for i in candidate))
        plain = {k for k in shared if not _DIGIT.search(k)}
        if plain:  # other tokens can only repeat a key without a digit
            known = set(candidate)
            candidate += [i for i, w in enumerate(words) if i not in known and len(w) >= 5 and not plain.isdisjoint(keys(w))]
        active = sorted({j for i in candidate for j in (i - 1, i, i + 1) if 0 <= j < len(words)})
        at, seen, previous, b = len(self.features), {}, -2, 0
        shapes: dict[int, str] = {}

        def shape_of(i: int) -> str:
            if i not in shapes:
                shapes[i] = shape(words[i]) if 0 <= i < len(words) else ""
            return shapes[i]

        for n, i in enumerate(active):
            a, z = tokens[i]
            while b < len(base) and base[b][2] <= a:
                b += 1
            own = [k for s, k, e in base[b:b + 4] if s < z and e > a]
            label = 1 + own[0] if own else 0
            w = words[i]
            digits = "".join(_DIGIT.findall(w))
            check = f"c{luhn(digits)}" if 12 <= len(digits) <= 19 else "p%s" % valid("ip", w) if re.fullmatch(
                r"[0-9]+(\.[0-9]+){3}", w) else "-"
            self.features.append([_hash("b%d" % label), _hash("s" + shape_of(i)), _hash("<" + shape_of(i - 1)),
                                  _hash(">" + shape_of(i + 1)), _hash("d%d" % min(len(digits), 20)), _hash(check),
                                  _hash("@%s%s%s" % ("@" in w, "+" in w, bool(digits)))])
            self.labels.append(label)
            self.spans.append((a, z))
            self.text.append(number)
            self.fixed.append(2)
            if i == previous + 1:
                self.chain.append((at + n - 1, at + n))
                self.fixed[-1] -= 1
                self.fixed[-2] -= 1
            previous = i
            for k in keys(w) & shared:
                if k in seen:
                    self.skip.append((seen[k], at + n))
                seen[k] = at + n

    def arrays(self):
        edge = lambda x: np.array(x, np.int64).reshape(-1, 2)
        return (np.array(self.features, np.int64).reshape(-1, self.WIDTH), np.array(self.labels, np.int64),
                edge(self.chain), np.unique(edge(self.skip), axis=0), np.array(self.fixed, np.float64))


class Field:
    """Weights: unary features, chain transitions, agreement along skip edges."""

    def __init__(self):
        self.unary, self.chain, self.skip = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.ones(LABELS)
        self.trained = False

    def fit(self, graph: Graph, hidden: float = HIDDEN) -> None:
        """Pseudo-likelihood by Adam; ``hidden`` of the entity tokens lose their pattern feature."""
        feats, y, chain, skip, fixed = graph.arrays()
        if not len(y):
            return
        feats = feats.copy()
        draw = np.array([zlib.crc32(f"{t}:{s}".encode()) for t, s in zip(graph.text, graph.spans, strict=True)]) / 2.0 ** 32
        feats[(y > 0) & (draw < hidden), 0] = _hash("b0")
        n = len(y)
        left, right = np.zeros((n, LABELS)), np.zeros((n, LABELS))
        agree = np.zeros((n, LABELS))
        np.add.at(left, chain[:, 1], np.eye(LABELS)[y[chain[:, 0]]])
        np.add.at(right, chain[:, 0], np.eye(LABELS)[y[chain[:, 1]]])
        left[:, 0] += fixed
        for a, b in ((0, 1), (1, 0)):
            np.add.at(agree, skip[:, a], np.eye(LABELS)[y[skip[:, b]]])
        target = np.eye(LABELS)[y]
        params = [self.unary, self.chain, self.skip]
        rest = [np.zeros_like(p) for p in params]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        rest[2] += 1
        for step in range(1, STEPS + 1):
            s = self.unary[feats].sum(axis=1) + left @ self.chain + right @ self.chain.T + agree * self.skip
            s -= s.max(axis=1, keepdims=True)
            p = np.exp(s)
            p /= p.sum(axis=1, keepdims=True)
            d = (p - target) / n
            g = np.zeros_like(self.unary)
            np.add.at(g, feats, d[:, None, :])
            grads = [g, left.T @ d + d.T @ right, (agree * d).sum(axis=0)]
            for k, (x, gr) in enumerate(zip(params, grads, strict=True)):
                gr = gr + DECAY / n * (x - rest[k])
                m, v = moments[k]
                m += 0.1 * (gr - m)
                v += 0.001 * (gr * gr - v)
                x -= LEARNING * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-12)
        self.skip = np.maximum(self.skip, 0)
        self.trained = True

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy sum-product beliefs of every token."""
        feats, _, chain, skip, fixed = graph.arrays()
        unary = self.unary[feats].sum(axis=1) + fixed[:, None] * self.chain[0]
        tables = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(np.diag(self.skip)[None], len(skip), 0)])
        edges = np.concatenate([chain, skip])
        src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        message = np.zeros((len(src), LABELS))
        belief = unary.copy()
        for _ in range(SWEEPS if len(src) else 0):
            s = (belief[src] - message[back])[:, :, None] + tables
            top = s.max(axis=1)
            new = top + np.log(np.exp(s - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
            belief = unary.copy()
            np.add.at(belief, dst, message)
        belief -= belief.max(axis=1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(axis=1, keepdims=True)

    def added(self, graph: Graph, texts: list[str], base: list[list]) -> list[list[tuple[int, int, int]]]:
        """Spans per text beyond the base ones."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not self.trained or not graph.features:
            return out
        p = self.marginals(graph)
        best = p.argmax(axis=1)
        sure = (best > 0) & (p.max(axis=1) >= CERTAIN)
        i = 0
        while i < len(best):
            j = i + 1
            if sure[i]:
                while (j < len(best) and sure[j] and best[j] == best[i] and graph.text[j] == graph.text[i]
                       and not texts[graph.text[i]][graph.spans[j - 1][1]:graph.spans[j][0]].strip()):
                    j += 1
                t = graph.text[i]
                a, z = graph.spans[i][0], graph.spans[j - 1][1]
                while a < z and not (texts[t][a].isalnum() or texts[t][a] == "+"):
                    a += 1
                while z > a and not texts[t][z - 1].isalnum():
                    z -= 1
                if a < z and not any(s < z and e > a for s, _, e in base[t]):
                    out[t].append((a, int(best[i]) - 1, z))
            i = j
        return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    gated = F.col("text").rlike(GATE) & (F.length("text") <= TRAIN_CHARS)
    keyed = docs.select("text", F.xxhash64("text", F.lit("pii")).alias("k"))
    n = keyed.where(gated).count()
    rows, share = [], (2 * train_docs + 100) / max(n, 1)
    while True:
        # a share of the keys first, so that no task sends more than its part of the sample
        part = keyed if share >= 1 else keyed.where(F.col("k") < F.lit(int((share - 0.5) * 2 ** 64)).cast("long"))
        rows = part.where(gated).orderBy("k", "text").limit(train_docs).collect()
        if share >= 1 or len(rows) >= min(n, train_docs):
            break
        share *= 4
    graph, field = Graph(), Field()
    for i, r in enumerate(rows):  # the bounded training sample
        graph.add(i, r["text"], base_spans(r["text"]))
    field.fit(graph)
    return field


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def find(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every document; counts are of base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, train_docs))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            base: list[list] = [[] for _ in texts]
            more: list[list] = [[] for _ in texts]
            held, graph, size = [], Graph(), 0

            def settle():
                for i, spans in zip(held, field.added(graph, [texts[i] for i in held], [base[i] for i in held]), strict=True):
                    more[i] = spans

            for i, t in enumerate(texts):
                if t is None:
                    continue
                base[i] = base_spans(t)
                graph.add(len(held), t, base[i])
                held.append(i)
                size += len(t)
                if size >= SLICE_CHARS:
                    settle()
                    held, graph, size = [], Graph(), 0
            settle()
            counts = [[sum(k == n for _, k, _ in s) for s in base] for n in range(len(KINDS))]
            digests = [hashlib.sha256(listed(s).encode()).hexdigest() if s else empty for s in base]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array([listed(s + m) for s, m in zip(base, more, strict=True)], pa.string()),
                 pa.array(list(map(len, more)), pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    # texts without a digit or an at sign stay in the JVM
    gated = docs.select("doc_id", F.when(F.col("text").rlike(GATE), F.col("text")).alias("text"))
    return in_arrow(gated, run, f"doc_id {ids}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
