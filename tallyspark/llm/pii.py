"""Personal data: validated patterns, and further spans proposed widely and picked by boosted trees.

Base spans (e-mail, IP address, card, phone) always stay. Generators propose overlapping
candidates: pieces of longer digit runs, numbers without a prefix, spelled-out addresses.
Boosted trees score them by format and context. Examples for: validated spans, as they are and
in the disguises the generators look for (an address spelled out, a number without its prefix,
an IP address with spaces). Examples against: matches that fail validation, validated spans made
invalid, generated candidates without a context word of their kind, and ordinary words put into
the shape of a spelled-out address. On examples kept apart, scores are calibrated (Platt), and
each kind's threshold is the lowest that reaches ``precision`` in a histogram of the scores of
all of them, counted in Spark; a kind without examples on both sides adds nothing.

Bounded: at most ``sample`` examples, the same number for each kind and verdict, chosen by a
hash over all, come to the driver.

Edge cases: a NULL text is empty; empty texts have no spans; repeated rows each give a row;
NULL ids pass through; an empty table gives no rows and no model; other columns are ignored.
Patterns take time in proportion to the text, so very long runs of signs do no harm.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.sampling import hash_sample
from tallyspark.sources.workspace import settle

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GROUPS = re.compile(r"[0-9]++(?:[ ().+/-]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?: at | ?[\[(]at[\])] ?)[A-Za-z0-9-]{1,63}"
    r"(?:(?: dot | ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63})+"
)
#: Shapes of a spelled-out address: what stands for the sign and for a dot.
_SHAPES = ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "))
_WORDS = re.compile(r"([A-Za-z]{1,20}) ([A-Za-z]{1,20}) ([A-Za-z]{1,20})")
_LAST = re.compile(r"[A-Za-z]+$")
_ENDINGS = frozenset("com org net edu gov info biz io co eu de fr es it uk ch at nl".split())
_HINTS = (
    re.compile(r"mail|contact|write|courriel|correo|kontakt", re.I),
    re.compile(r"\bip\b|host|server|addr", re.I),
    re.compile(r"card|visa|credit|karte|carte|tarjeta|iban", re.I),
    re.compile(r"tel|phone|call|mobil|fax|handy", re.I),
)


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000
    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    precision: float = 0.99
    least_examples: int = 20
    histogram: int = 1000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_GROUP.findall(text))


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """All base matches, leftmost and non-overlapping per kind, and whether they are valid."""
    at, done, seen = text.find("@"), 0, 0
    while at >= 0:
        begin = max(done, seen)
        start = begin + len(text[begin:at].rstrip(LOCAL))
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end(), True
            done = found.end()
        seen = at + 1
        at = text.find("@", max(done, at + 1))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        yield "card", m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def base_spans(text: str) -> list[Span]:
    return sorted(((k, a, b) for k, a, b, fine in matches(text) if fine), key=_order)


def candidates(text: str) -> Iterator[Span]:
    """High recall, overlapping: every run of digit groups of a fitting length, spelled-out addresses."""
    if "dot" in text:
        for m in _SPELLED.finditer(text):
            yield "email", m.start(), m.end()
    if not _DIGIT.search(text):
        return
    for run in _GROUPS.finditer(text):
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, run.start(), run.end())]
        for i, (start, _) in enumerate(groups):
            size = 0
            for j in range(i, len(groups)):
                size += groups[j][1] - groups[j][0]
                if size > 19:
                    break
                end = groups[j][1]
                if 12 <= size:
                    yield "card", start, end
                if 9 <= size <= 15:
                    lead = start - 1 if start and text[start - 1] in "+(" else start
                    yield "phone", lead, end
                if j - i == 3 and size <= 12 and "." in text[groups[i][1] : groups[i][1] + 1]:
                    yield "ip", start, end


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    inner = text[start:end]
    groups = [len(g) for g in _GROUP.findall(inner)] or [0]
    digits = _digits(inner)
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    left, right = before[-1:] or " ", after[:1] or " "
    octets = [int(g[-4:]) for g in _GROUP.findall(inner)] or [0]
    signs = {c for c in inner if not c.isalnum()}
    near = before + after
    last = _LAST.search(inner)
    return [
        *[float(kind == k) for k in KINDS],
        float(end - start),
        float(len(digits)),
        float(len(groups)),
        float(max(groups)),
        float(min(groups)),
        float(len(signs)),
        float(sum(c.isalpha() for c in inner)),
        float(bool(digits) and luhn(digits)),
        float(max(octets)),
        float(inner[:1] == "+" or left == "+"),
        float("(" in inner) + float(")" in inner),
        float("." in inner),
        float(left.isspace()),
        float(left.isdigit() or before[-2:-1].isdigit()),
        float(left.isalpha()),
        float(right.isspace()),
        float(right.isdigit() or after[1:2].isdigit()),
        float(right.isalpha()),
        float(sum(c.isdigit() for c in near)),
        *[float(bool(h.search(near))) for h in _HINTS],
        float(last is not None and last.group().lower() in _ENDINGS),
    ]


WIDTH = len(features("1", ("card", 0, 1)))


class Trees:
    """Boosted trees of one depth for a yes-or-no answer, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, settings: Settings) -> None:
        self.depth = settings.depth
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, settings.bins)))[1:] for c in x.T]
        binned = self._bin(x)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.base)
        for _ in range(settings.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p) + 1e-9, settings)
            self.trees.append(tree)
            score += self._apply(tree, binned)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, x, gradient, weight, settings: Settings):
        node = np.zeros(len(x), dtype=np.int64)
        splits, wide = [], settings.bins + 1
        for level in range(self.depth):
            nodes = 1 << level
            best = np.full(nodes, -np.inf)
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, wide)
            for f in range(x.shape[1]):
                cell = node * wide + x[:, f]
                g = np.bincount(cell, gradient, nodes * wide).reshape(nodes, wide).cumsum(axis=1)
                h = np.bincount(cell, weight, nodes * wide).reshape(nodes, wide).cumsum(axis=1)
                right_g, right_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g * g / (h + 1) + right_g * right_g / (right_h + 1)
                at = gain.argmax(axis=1)
                better = gain[np.arange(nodes), at] > best + 1e-12
                best = np.where(better, gain[np.arange(nodes), at], best)
                feature, cut = np.where(better, f, feature), np.where(better, at, cut)
            splits.append((feature, cut))
            node = node * 2 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaves = 1 << self.depth
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, weight, leaves)
        return splits, settings.rate * g / (h + 1)

    def _apply(self, tree, x) -> np.ndarray:
        splits, leaves = tree
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for feature, cut in splits:
            node = node * 2 + (x[rows, feature[node]] > cut[node])
        return leaves[node]

    def scores(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + sum(self._apply(t, binned) for t in self.trees)


class Model:
    """Trees, their calibration, and the threshold of each kind (None: adds nothing)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray, settings: Settings) -> None:
        self.thresholds: dict[str, float | None] = dict.fromkeys(KINDS)
        self.trees = None
        if len(y) and 0 < y[~apart].sum() < (~apart).sum():
            self.trees = Trees(x[~apart], y[~apart], settings)
            self.slope, self.shift = _platt(self.trees.scores(x[apart]), y[apart])
            p = self.probabilities(x)
            for k, kind in enumerate(KINDS):
                chosen = apart & (x[:, k] == 1)
                least = settings.least_examples
                if y[chosen].sum() >= least and (1 - y[chosen]).sum() >= least:
                    self.thresholds[kind] = _threshold(p[chosen], y[chosen], settings.precision)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.scores(x) + self.shift, -50, 50)))


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the scores, by Newton's method."""
    w = np.array([1.0, 0.0])
    if not len(y):
        return 1.0, 0.0
    x = np.stack([score, np.ones(len(score))], axis=1)
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - goal) + 1e-3 * (w - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(curve, slope)
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


def _threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float | None:
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    fine = np.flatnonzero((right >= precision) & last)
    return max(0.5, float(p[order][fine[-1]])) if len(fine) else None


Example = tuple[str, Span, int]


def _altered(text: str, span: Span, new: str, label: int) -> Example:
    """An example with ``new`` in the place of a span, in the same surroundings."""
    before, after = text[max(0, span[1] - 24) : span[1]], text[span[2] : span[2] + 24]
    return before + new + after, (span[0], len(before), len(before) + len(new)), label


def _disguised(text: str, span: Span, luck: int) -> Iterator[Example]:
    """A validated span as only the generators find it."""
    kind, inner = span[0], text[span[1] : span[2]]
    if kind == "email":
        at, dot = _SHAPES[luck % len(_SHAPES)]
        local, domain = inner.split("@")
        new = local + at + domain.replace(".", dot)
        if _SPELLED.fullmatch(new):
            yield _altered(text, span, new, 1)
    elif kind == "ip":
        yield _altered(text, span, inner.replace(".", ". "), 1)
    elif kind == "phone":
        yield _altered(text, span, inner[1:], 1)
        rest = inner[_GROUP.match(inner, 1).end() :].lstrip(" .-)")
        if 9 <= len(_digits(rest)):
            yield _altered(text, span, rest, 1)


def _broken(text: str, span: Span, luck: int) -> Iterator[Example]:
    """A validated span changed so that its validation fails."""
    kind, inner = span[0], text[span[1] : span[2]]
    if kind == "ip":
        parts = inner.split(".")
        parts[luck % 4] = str(256 + luck % 744)
        yield _altered(text, span, (". " if luck & 64 else ".").join(parts), 0)
    elif kind == "card":
        yield _altered(text, span, inner[:-1] + str((int(inner[-1]) + 1) % 10), 0)


def _examples(text: str, luck: int) -> Iterator[Example]:
    """Texts, spans in them and verdicts; ``luck``: a hash that settles which shapes are made."""
    found = list(matches(text))
    valid = [(k, a, b) for k, a, b, fine in found if fine]
    # A match that fails, but lies in valid personal data of another kind, is no example against.
    taken, seen = Taken(valid), set()
    for span in valid:
        yield text, span, 1
        yield from _disguised(text, span, luck + span[1])
        yield from _broken(text, span, luck + span[1])
    for k, a, b, fine in found:
        if not fine and not taken.touches(a, b):
            seen.add((k, a, b))
            yield text, (k, a, b), 0
    for span in candidates(text):
        kind, a, b = span
        if span in seen or taken.touches(a, b):
            continue
        if not _HINTS[KINDS.index(kind)].search(text[max(0, a - 24) : a] + text[b : b + 24]):
            yield text, span, 0
    words = _WORDS.search(text, luck % max(1, len(text))) if (luck >> 8) % 4 == 0 else None
    if words and not taken.touches(*words.span()):
        one, two, three = words.groups()
        yield _altered(text, ("email", *words.span()), f"{one} at {two} dot {three}", 0)


def _vectors(stored: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(stored), "<f4").reshape(-1, WIDTH).astype(float)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                for seen, span, label in _examples(text or "", hash_of(str(doc))):
                    x = np.array(features(seen, span), dtype="<f4").tobytes()
                    out.append((str(doc), span[1], span[0], label, x))
            yield pd.DataFrame(out, columns=["doc", "start", "kind", "label", "x"])

    found = docs.select("doc_id", "text").mapInPandas(rows, "doc string, start long, kind string, label int, x binary")
    found = settle(found, "pii-examples")
    picked = []
    for kind in KINDS:
        for label in (0, 1):
            mine = found.where((F.col("kind") == kind) & (F.col("label") == label))
            picked += hash_sample(mine, settings.sample // (2 * len(KINDS)), "doc", "start", "x").collect()
    x = _vectors(r.x for r in picked)
    y = np.array([r.label for r in picked], dtype=float)
    apart = np.array([hash_of(r.doc) % 4 == 0 for r in picked], dtype=bool)
    model = Model(x, y, apart, settings)
    if model.trees is not None:
        model.thresholds = _thresholds(found, model, settings)
    return model


def _thresholds(found: DataFrame, model: Model, settings: Settings) -> dict[str, float | None]:
    """The threshold of each kind, from the histogram of all scores kept apart."""
    shared, bins = found.sparkSession.sparkContext.broadcast(model), settings.histogram

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = shared.value.probabilities(_vectors(batch["x"]))
            cell = np.minimum((p * bins).astype(np.int32), bins - 1)
            yield pd.DataFrame({"kind": batch["kind"], "label": batch["label"], "cell": cell})

    apart = found.where(F.crc32(F.col("doc").cast("binary")) % 4 == 0).select("kind", "label", "x")
    counted = apart.mapInPandas(scored, "kind string, label int, cell int").groupBy("kind", "label", "cell")
    counts = {kind: np.zeros((2, bins)) for kind in KINDS}
    for r in counted.agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.kind][r.label, r.cell] = r.n
    out: dict[str, float | None] = dict.fromkeys(KINDS)
    for kind, both in counts.items():
        if both.sum(axis=1).min() >= settings.least_examples:
            against, right = both[:, ::-1].cumsum(axis=1)
            fine = np.flatnonzero((right > 0) & (right >= settings.precision * (right + against)))
            if len(fine):
                out[kind] = max(0.5, (bins - 1 - int(fine[-1])) / bins)
    return out


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode())


def added_spans(text: str, base: list[Span], model: Model) -> list[tuple[str, int, int, float]]:
    """Candidates above their kind's threshold, best first, that touch no span taken before."""
    if model.trees is None:
        return []
    taken = Taken(base)
    able = [s for s in candidates(text) if model.thresholds[s[0]] is not None and not taken.touches(*s[1:])]
    if not able:
        return []
    p = model.probabilities(np.array([features(text, s) for s in able]))
    ranked = sorted(zip(able, p.tolist(), strict=True), key=lambda c: (-c[1], _order(c[0])))
    out = []
    for span, chance in ranked:
        if chance >= model.thresholds[span[0]] and not taken.touches(*span[1:]):
            out.append((*span, chance))
            taken.add(*span[1:])
    return out


class Taken:
    """Disjoint stretches of a text, in order."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def find_pii(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end (code points), whether added, and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                base = base_spans(text or "")
                more = added_spans(text or "", base, shared.value)
                every = [(*s, False, 1.0) for s in base] + [(k, a, b, True, p) for k, a, b, p in more]
                every.sort(key=_order)
                out.append([dict(zip(("kind", "start", "end", "added", "score"), s, strict=True)) for s in every])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": out})

    span = "struct<kind:string,start:bigint,end:bigint,added:boolean,score:double>"
    return docs.select("doc_id", "text").mapInPandas(rows, f"doc_id {kind}, spans array<{span}>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of spans replaced by the kind of its first span."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=_order):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
