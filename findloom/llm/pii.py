"""Personal data: rules for certain spans, and a skip-chain CRF for the rest.

The rules find email addresses, IP addresses, card numbers and phone numbers.
A conditional random field then labels every word that holds a digit or an
``@`` (the labels of all other words are fixed to "other", so their messages
are constants and need not be sent). Neighbouring words share a transition
potential; repeated or similar words, however far apart in the document (same
core, or same digits), share a skip potential, and loopy message passing makes
their labels agree where the evidence does. Words outside the rules' spans
whose marginal reaches ``CERTAIN`` become further spans.

Training: pseudo-likelihood on at most ``MAX_EXAMPLES`` words of about
``SAMPLE_DOCS`` documents chosen by a hash of their id, labelled by the rules.
Everything else reads all documents, whole.

Defined results: a null text counts as an empty one (no spans); ids may repeat
or be null; documents without candidates cost one scan; an empty table trains
no weights and gives an empty result; other columns are not read by
``pii_spans`` and pass through ``redact`` untouched. Positions are code points,
ends exclusive. All scans are linear in the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_EXAMPLES = 40_000
SAMPLE_DOCS = 8_000
CERTAIN = 0.95
ROUNDS = 8
_SLICE = 256  # texts of one graph at most
_BYTES = 4 << 20  # and their bytes, unless one text alone has more

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match takes all digits of a run, so none can begin inside one.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>|*#“”«»…"


def luhn(digits: str) -> bool:
    """Whether a string of digits has a valid check digit."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    done, after = 0, 0
    at = text.find("@")
    while at >= 0:
        head = text[max(done, after) : at]
        start = max(done, after) + len(head.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        after = at + 1
        at = text.find("@", max(after, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans by kind as listed, then start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                spans.append(("phone", *m.span()))
    return spans


# --- words that may carry a label -----------------------------------------

FEATURES = (
    "bias", "at", "email", "four_parts", "small_parts", "plus", "paren", "letters", "digits_only", "numeric",
    "luhn", "hex", "n1", "n3", "n4", "n5", "n7", "n9", "n13", "n20", "alone_before", "alone_after", "equals",
)


def _features(core: str, raw: str) -> list[str]:
    digits = "".join(c for c in core if "0" <= c <= "9")
    n = len(digits)
    on = ["bias"]
    if "@" in core:
        on.append("at")
        if _DOMAIN.search(core, core.find("@") + 1):
            on.append("email")
    parts = core.split(".")
    if len(parts) == 4 and all(p and n == len(core) - 3 for p in parts):
        on.append("four_parts")
        if all(map(_small, parts)):
            on.append("small_parts")
    if "+" in core:
        on.append("plus")
    if "(" in raw or ")" in raw:
        on.append("paren")
    if "=" in core:
        on.append("equals")
    if any(c.isalpha() for c in core):
        on.append("letters")
    if core == digits:
        on.append("digits_only")
    elif not core.strip("0123456789-.()+ "):
        on.append("numeric")
    if n >= 13 and n <= 19 and luhn(digits):
        on.append("luhn")
    if n >= 8 and len(core) >= 16 and not core.strip("0123456789abcdef"):
        on.append("hex")
    on += [k for k, low, high in (
        ("n1", 1, 2), ("n3", 3, 3), ("n4", 4, 4), ("n5", 5, 6), ("n7", 7, 8), ("n9", 9, 12), ("n13", 13, 19),
    ) if low <= n <= high] + ["n20"] * (n >= 20)
    return on


class Graph:
    """The candidate words of some documents, their features and both kinds of links."""

    def __init__(self, texts: list[str]):
        self.doc, self.start, self.end, self.gold = [], [], [], []
        self.spans = [rule_spans(t) for t in texts]
        self.chain, self.skip, rows = [], [], []
        index = {name: i for i, name in enumerate(FEATURES)}
        for d, text in enumerate(texts):
            if "@" not in text and not _DIGIT.search(text):
                continue
            marked = sorted((a, b, k) for k, a, b in self.spans[d])
            at, before, last_by, upto = 0, None, {}, -1
            for place, m in enumerate(_WORD.finditer(text)):
                raw = m.group()
                if "@" not in raw and not _DIGIT.search(raw):
                    continue
                core = raw.strip(_EDGE)
                a = m.start() + raw.find(core)
                b = a + len(core)
                me = len(rows)
                on = _features(core, raw)
                if before is not None and before == place - 1:
                    self.chain.append((me - 1, me))
                else:
                    on.append("alone_before")
                    if me and self.doc and self.doc[-1] == d:
                        rows[-1][index["alone_after"]] = 1.0
                before = place
                row = np.zeros(len(FEATURES))
                row[[index[x] for x in on]] = 1.0
                rows.append(row)
                while at < len(marked) and marked[at][1] <= a:
                    at += 1
                label = 0
                for s, e, k in marked[at : at + 4]:
                    if s < b and e > a:
                        label = KINDS.index(k) + 1
                        break
                self.doc.append(d), self.start.append(a), self.end.append(b), self.gold.append(label)
                digits = "".join(c for c in core if "0" <= c <= "9")
                for name in {("core", core.lower()), ("digits", digits if len(digits) >= 4 else core.lower())}:
                    if name in last_by and last_by[name] != me:
                        self.skip.append((last_by[name], me))
                    last_by[name] = me
            upto = len(rows)
            if upto and self.doc and self.doc[-1] == d:
                rows[-1][index["alone_after"]] = 1.0
        self.skip = sorted(set(self.skip))
        self.x = np.array(rows).reshape(-1, len(FEATURES))
        self.gold = np.array(self.gold, dtype=np.int64)


def _pairs(pairs) -> np.ndarray:
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


Y = len(KINDS) + 1


class Model:
    """Weights of word features, of neighbouring labels and of skip-linked labels."""

    def __init__(self):
        self.word = np.zeros((len(FEATURES), Y))
        self.word[0, 0] = 2.0  # untrained: everything is "other"
        self.chain = np.zeros((Y, Y))
        self.skip = np.zeros((Y, Y))

    def fit(self, x, gold, before, after, skips, steps: int = 400, rate: float = 0.5, l2: float = 1e-3) -> Model:
        """Pseudo-likelihood: each word given the rules' labels of those around it.

        ``before`` and ``after`` hold the neighbour's label or -1, ``skips``
        the number of skip-linked words with each label.
        """
        n = len(gold)
        if not n:
            return self
        eye = np.vstack([np.eye(Y), np.zeros(Y)])
        b, a, truth = eye[before], eye[after], np.eye(Y)[gold]
        # A rare label weighs as much as its square root.
        share = np.sqrt(np.maximum(1, truth.sum(axis=0)))
        weight = (share.max() / share)[gold]
        weight /= weight.sum()
        past = [np.zeros_like(w) for w in (self.word, self.chain, self.skip)]
        for _ in range(steps):
            miss = (_softmax(x @ self.word + b @ self.chain + a @ self.chain.T + skips @ self.skip) - truth) * weight[:, None]
            grads = [
                x.T @ miss + l2 * self.word,
                b.T @ miss + (a.T @ miss).T + l2 * self.chain,
                (lambda g: (g + g.T) / 2)(skips.T @ miss) + l2 * self.skip,
            ]
            for w, g, p in zip((self.word, self.chain, self.skip), grads, past, strict=True):
                p *= 0.9
                p += g
                w -= rate * p
        return self

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy belief propagation over all of the graph's documents at once."""
        alone = graph.x @ self.word
        chain, skip = _pairs(graph.chain), _pairs(graph.skip)
        if not len(chain) + len(skip):
            return _softmax(alone) if len(alone) else alone
        a, b = np.concatenate([chain, skip]).T
        forth = np.concatenate([np.broadcast_to(self.chain, (len(chain), Y, Y)), np.broadcast_to(self.skip, (len(skip), Y, Y))])
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        table = np.concatenate([forth, forth.transpose(0, 2, 1)])
        back = np.roll(np.arange(2 * len(a)), -len(a))  # the same link, the other way
        message = np.zeros((2 * len(a), Y))
        for _ in range(ROUNDS):
            belief = alone.copy()
            np.add.at(belief, target, message)
            send = (belief[source] - message[back])[:, :, None] + table
            top = send.max(axis=1)
            new = top + np.log(np.exp(send - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        belief = alone.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


#: Features of words that hold a whole card number.
_FULL = [FEATURES.index("n13"), FEATURES.index("n20")]


def find_spans(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """For each text its rule spans and the spans that the field adds."""
    graph = Graph(texts)
    added: list[list] = [[] for _ in texts]
    if len(graph.x):
        p = model.marginals(graph)
        best = p.argmax(axis=1)
        sure = (best > 0) & (p.max(axis=1) >= CERTAIN) & (graph.gold == 0)
        linked = {b: a for a, b in graph.chain}
        open_ = None  # the last added word
        for i in np.flatnonzero(sure).tolist():
            kind, spans = KINDS[best[i] - 1], added[graph.doc[i]]
            if graph.start[i] == graph.end[i]:
                continue
            goes_on = open_ is not None and linked.get(i) == open_ and spans and spans[-1][0] == kind
            whole = kind in ("email", "ip") or any(graph.x[j, _FULL].any() for j in (i, open_ or i))
            if goes_on and not whole:  # cards and phones may be spread over several words
                spans[-1] = (kind, spans[-1][1], graph.end[i])
            else:
                spans.append((kind, graph.start[i], graph.end[i]))
            open_ = i
    return list(zip(graph.spans, added, strict=True))


def _joined(spans) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def _slices(batch: pa.RecordBatch, at: int):
    """The batch in runs of rows whose texts, in column ``at``, make a graph of bounded size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    low = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and (i - low == _SLICE or held + size > _BYTES):
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += size
    yield batch.slice(low)


_EXAMPLE = "mark long, place int, x array<double>, gold int, before int, after int, skips array<double>"


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from a bounded sample of documents; only its candidate words reach the driver."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    mark = F.xxhash64(docs[id_col].cast("string"))
    sample = docs.where(F.pmod(mark, F.lit(every)) == 0).select(mark.alias("mark"), docs[text_col].alias("text"))

    def run(batches):
        for batch in batches:
            for part in _slices(batch, 1):
                graph = Graph([t or "" for t in part.column(1).to_pylist()])
                n = len(graph.x)
                before, after, skips = np.full(n, -1), np.full(n, -1), np.zeros((n, Y))
                for a, b in graph.chain:
                    before[b], after[a] = graph.gold[a], graph.gold[b]
                for a, b in graph.skip:
                    skips[a, graph.gold[b]] += 1
                    skips[b, graph.gold[a]] += 1
                marks = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([marks[d] for d in graph.doc], pa.int64()),
                        pa.array(graph.start, pa.int32()),
                        pa.array(list(graph.x), pa.list_(pa.float64())),
                        pa.array(graph.gold, pa.int32()),
                        pa.array(before, pa.int32()),
                        pa.array(after, pa.int32()),
                        pa.array(list(skips), pa.list_(pa.float64())),
                    ],
                    [c.split()[0] for c in _EXAMPLE.split(", ")],
                )

    rows = sample.mapInArrow(run, _EXAMPLE).orderBy("mark", "place", "gold").limit(MAX_EXAMPLES).toArrow()
    stack = lambda name, width: np.array(rows.column(name).to_pylist(), dtype=float).reshape(-1, width)
    whole = lambda name: rows.column(name).to_numpy().astype(np.int64)
    return Model().fit(
        stack("x", len(FEATURES)), whole("gold"), whole("before"), whole("after"), stack("skips", Y)
    )


def pii_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``: the rules' spans and all spans, as ``kind:start:end`` lists joined by commas."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in _slices(batch, 1):
                found = find_spans([t or "" for t in part.column(1).to_pylist()], model)
                base = pa.array([_joined(rules) for rules, _ in found], pa.string())
                full = pa.array([_joined(rules + more) for rules, more in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), base, full], ["doc_id", "base", "spans"])

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, base string, spans string")


def mask(text: str, spans) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a < done:
            done = max(done, b)
            continue
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents with personal data masked; ``length_col``, if named, gets the new length."""
    at = docs.columns.index(text_col)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in _slices(batch, at):
                texts = part.column(at).to_pylist()
                found = find_spans([t or "" for t in texts], model)
                masked = [t and mask(t, rules + more) for t, (rules, more) in zip(texts, found, strict=True)]
                cols = list(part.columns)
                cols[at] = pa.array(masked, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out


