"""Personal data by candidate gradient boosting.

Base rules find e-mail addresses, IP addresses, card and phone numbers by format. The method
adds spans: high-recall generators propose overlapping candidates of more kinds and
looser formats; boosted trees judge each by format and context features; a threshold
calibrated for precision on held-out examples selects redactions, the likelier first where candidates overlap.

The trees are fitted and their thresholds calibrated once, on the driver, and travel with the function. They learn from
candidates of two sources: of a bounded sample of the documents themselves (``SAMPLE`` rows, those with the smallest hash of
their id, at most ``PER_ROW`` candidates each), where what a base rule confirms is personal data and what looks alike but is not confirmed isn't;
and of made-up sentences from a fixed seed, for kinds and formats the sample lacks. A third of either, kept out of the trees, calibrates:
the least margin at which, and above which, precision holds for each kind.

Texts are scanned in one pass without a shuffle. Null text: empty, no spans; repeated rows give equal rows, an empty table none (and
trees of the made-up sentences). All spans are in code points, ends exclusive. Base spans always stay; an added span never overlaps a base span.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enter, to_text, tune

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
PRECISION = 0.99
#: Bound of what is learnt from documents.
SAMPLE, PER_ROW = 4000, 50
_AT_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _emails(text: str):
    """Leftmost matches of local part, @ and dotted domain, looked for around each @."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _AT_TAIL.match(text, at) if a < at else None
        if m:
            end = m.end()
            yield a, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# What may not stand before and after a number.
_GO, _STOP = r"(?<![0-9A-Za-z])(?<![0-9][.-])", r"(?![0-9A-Za-z]|[./-][0-9])"
# Generators: (kind, expression). Each is linear in the text.
_GENERATORS = (
    (0, re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z]{2,12}){1,3}(?![A-Za-z0-9])")),
    (0, re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z]{2,12}){1,3}(?![A-Za-z0-9])")),
    (1, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (0, re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}@[A-Za-z0-9-]{1,63}(?:\x20?(?:\[\.\]|\(\.\)|\x20dot\x20)\x20?[A-Za-z0-9-]{2,24}){1,3}(?![A-Za-z0-9])")),
    (1, re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20?dot\x20?)[0-9]{1,3}){3}(?![0-9A-Za-z])")),
    (3, re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+./-])\(?[0-9]{2,5}\)?(?:[\x20./-][(]?[0-9]{2,5}[)]?){1,4}" + _STOP)),
    (3, re.compile(r"(?<![0-9A-Za-z+./-])[0-9]{9,13}" + _STOP)),
    (2, re.compile(_GO + r"[0-9]{4}([\x20.-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}" + _STOP)),
    (2, re.compile(_GO + r"3[47][0-9]{2}([\x20-]?)[0-9]{6}\1[0-9]{5}" + _STOP)),
    (2, re.compile(_GO + r"[0-9]{14,19}" + _STOP)),
    (4, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    (5, re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])")),
)
_HINTS = {
    0: re.compile(r"(?i)\b(?:e-?mail|mail|contact|reach|write)\b"),
    1: re.compile(r"(?i)\b(?:ip|host|address|server|from)\b"),
    2: re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b"),
    3: re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono|handy)\b"),
    4: re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    5: re.compile(r"(?i)\b(?:ssn|social|security)\b"),
}
def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping (start, kind, end) proposals."""
    digit = _DIGIT.search(text) is not None
    at = "@" in text
    wanted = ["(at)" in text or "[at]" in text, " at " in text and " dot " in text, *[digit] * (len(_GENERATORS) - 2)]
    wanted[3], wanted[4], wanted[5] = at, digit and ("." in text or " dot " in text or "dot" in text), digit and "+" in text
    return [(m.start(), kind, m.end()) for (kind, g), go in zip(_GENERATORS, wanted) if go for m in g.finditer(text)]


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    t = s[4:] + s[:4]
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in t)) % 97 == 1


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    a, kind, b = span
    s, before, after = text[a:b], text[max(0, a - 32) : a], text[b : b + 16]
    d = _digits(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    near = [float(bool(h.search(before))) for h in _HINTS.values()]
    date = bool(re.match(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}$|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}$|(?:19|20)[0-9]{2}[-/](?:19|20)?[0-9]{2}$", s))
    return [
        kind, len(s), len(d), len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0,
        float(s.startswith("0") or s.startswith("(0")), float("(" in s), s.count("-"), s.count("."), s.count(" "), s.count("/"), s.count(":"),
        float(luhn(d)) if 12 <= len(d) <= 19 else 0.0, float(iban_ok(s)) if kind == 4 else 0.0, float(date),
        near[kind], sum(near), float(before.rstrip().endswith((":", "="))), float(before.rstrip().endswith(("#", "$", "€", "§", "%"))), float(after[:1] in "%€$"),
        float(bool(re.search(r"(?i)\b(?:order|no|nr|version|page|id|isbn|invoice|ref|lot|part|art|item|code)\b[.:#\s]*$", before))),
        float("at" in s and "dot" in s), float("(at)" in s or "[at]" in s),
    ]


def _n(r: random.Random, k: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(k))


def _good_iban(r: random.Random) -> str:
    country, n = r.choice([("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14)])
    body = _n(r, n)
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    s = f"{country}{check:02d}{body}"
    return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def _card_like(r: random.Random, valid: bool) -> str:
    d = r.choice("3456") + _n(r, 14)
    last = next(c for c in "0123456789" if luhn(d + c))
    d += last if valid else str((int(last) + r.randrange(1, 10)) % 10)
    return r.choice(["-", " ", ".", ""]).join(d[i : i + 4] for i in range(0, 16, 4))


def examples(seed: int = 7, n: int = 6000):
    """(text, start, end, kind or None): made-up sentences with one planted string each."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrstdmch") for _ in range(r.randrange(2, 9)))
    hint = {0: ["email", "mail", "contact"], 1: ["ip", "host", "server"], 2: ["card", "visa", "credit card"], 3: ["phone", "tel", "call", "mobile", "fax", "Telefon"], 4: ["iban", "account", "Konto"], 5: ["ssn", "social security number"]}
    for _ in range(n):
        kind = r.choice([0, 1, 2, 3, 3, 3, 4, 5, None, None, None, None, None])
        strong = r.random() < 0.7
        if kind == 0:
            s = f"{word()}.{word()}{r.choice([' (at) ', ' [at] ', '(at)', ' at '])}{word()}{r.choice([' dot ', ' (dot) ', '.', '[dot]'])}{r.choice(['com', 'org', 'net'])}"
            s = r.choice([s, s, f"{word()}@{word()}{r.choice(['[.]', '(.)', ' dot '])}{r.choice(['com', 'org', 'net'])}"])
            strong = strong or " at " in s
        elif kind == 1:
            s = r.choice([":".join(f"{r.randrange(65536):x}" for _ in range(8)), r.choice(["[.]", "(.)", " dot "]).join(str(r.randrange(256)) for _ in range(4))])
        elif kind == 2:
            s = _card_like(r, True)
        elif kind == 3:
            s = r.choice([f"({_n(r, 3)}) {_n(r, 3)}-{_n(r, 4)}", f"{_n(r, 3)}-{_n(r, 3)}-{_n(r, 4)}", f"0{_n(r, 2)} {_n(r, 4)} {_n(r, 4)}", f"0{_n(r, 3)}/{_n(r, 6)[:5]}", "0" + ".".join([_n(r, 1)] + [_n(r, 2) for _ in range(4)]), f"0{_n(r, 10)}", f"{_n(r, 3)}.{_n(r, 3)}.{_n(r, 4)}", f"+{r.randrange(1, 99)} ({_n(r, 3)}) {_n(r, 3)}-{_n(r, 4)} {_n(r, 16)}"[: r.choice([-17, None])]])
            strong = strong or not s.startswith(("(", "0", "+"))
        elif kind == 4:
            s = _good_iban(r)
        elif kind == 5:
            s, strong = f"{_n(r, 3)}-{_n(r, 2)}-{_n(r, 4)}", r.random() < 0.8
        else:
            s = r.choice([lambda: _n(r, r.randrange(4, 14)), lambda: f"{r.randrange(1900, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", lambda: f"{r.randrange(1, 29):02d}.{r.randrange(1, 13):02d}.{r.randrange(1900, 2030)}", lambda: _card_like(r, False), lambda: f"{_n(r, 4)} {_n(r, 4)} {_n(r, 4)}", lambda: f"{_n(r, 3)}.{_n(r, 3)}", lambda: f"{r.randrange(1900, 2000)}-{r.randrange(2000, 2030)}", lambda: f"{_n(r, 2)} {_n(r, 2)}", lambda: f"{word()} at {word()}.{r.choice(['the', 'and', 'com'])}", lambda: f"{_n(r, 5)}-{_n(r, 3)}", lambda: _n(r, 16), lambda: "GB" + _n(r, 18), lambda: ":".join(_n(r, 2) for _ in range(4))])()
            while len(_digits(s)) >= 14 and luhn(_digits(s)):
                s = s[:-1] + r.choice("0123456789")  # what the base rule would take is no counter-example
        lead = " ".join(word() for _ in range(r.randrange(0, 8)))
        if kind is not None and strong:
            lead += " " + r.choice(hint[kind]) + r.choice([" ", ": ", " = "])
        elif kind is None and r.random() < 0.4:
            lead += " " + r.choice(["order", "No.", "version", "page", "id", "ISBN", "invoice", "$", "ref:", "item", "code:"]) + " "
        else:
            lead += " "
        tail = r.choice([" ", ". ", ", ", " | "]) + " ".join(word() for _ in range(r.randrange(0, 6)))
        # A number that runs on into another one: the first is the planted one.
        own = s[:-17] if s.startswith("+") and len(_digits(s)) > 20 else s
        yield lead + s + tail, len(lead), len(lead) + len(own), kind


class BoostedTrees:
    """Gradient-boosted regression trees on logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, least: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.trees: list = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        bins = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
        p = y.mean()
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            tree = self._grow(bins, cuts, g, h, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self._apply(tree, x)
        return self

    def _grow(self, bins, cuts, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = self.rate * gs / (hs + self.ridge)
        if depth == 0 or hs < 2 * self.least:
            return leaf
        top, where = 1e-6, None
        for j in range(bins.shape[1]):
            n = len(cuts[j]) + 1
            if n < 2:
                continue
            gl = np.cumsum(np.bincount(bins[rows, j], g[rows], n))[:-1]
            hl = np.cumsum(np.bincount(bins[rows, j], h[rows], n))[:-1]
            gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
            gain[(hl < self.least) | (hs - hl < self.least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > top:
                top, where = gain[k], (j, k)
        if where is None:
            return leaf
        j, k = where
        left = bins[rows, j] <= k
        return j, cuts[j][k], self._grow(bins, cuts, g, h, rows[left], depth - 1), self._grow(bins, cuts, g, h, rows[~left], depth - 1)

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, left, right = tree
        go = x[:, j] <= cut
        out = np.empty(len(x))
        out[go], out[~go] = self._apply(left, x[go]), self._apply(right, x[~go])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._apply(t, x) for t in self.trees) if len(x) else np.zeros(0)


def _covers(c, a: int, kind: int, b: int) -> bool:
    """Is a candidate within a known span of its kind, and most of it?"""
    return kind == c[1] and a <= c[0] and c[2] <= b and 10 * (c[2] - c[0]) >= 7 * (b - a)


def weak_examples(text: str, most: int = PER_ROW) -> list[list[float]]:
    """Features of a document's candidates, each with a last number: does a base rule confirm it?

    Candidates that a base match contains in small part or overlaps otherwise say nothing and are left out.
    """
    base, out = base_spans(text), []
    for c in list(dict.fromkeys(candidates(text)))[:most]:
        near = [x for x in base if x[0] < c[2] and c[0] < x[2]]
        yes = any(_covers(c, *x) for x in near)
        if yes or not near:
            # What no rule confirms is a counter-example only where the base rules know the kind and format: a card number by its check digit.
            if yes or c[1] == 2 and not luhn(_digits(text[c[0] : c[2]])):
                out.append([*features(text, c), float(yes)])
    return out


class Detector:
    """Trees and thresholds, of made-up sentences and of examples (features and label in a row) of documents."""

    def __init__(self, own=()):
        xs, ys = [], []
        for text, a, b, kind in examples():
            for c in dict.fromkeys(candidates(text)):
                xs.append(features(text, c))
                ys.append(float(kind is not None and _covers(c, a, kind, b)))
        for *x, y in own:
            xs.append(x)
            ys.append(y)
        x, y = np.array(xs), np.array(ys)
        self.learnt_from = len(own)
        fit = np.arange(len(y)) % 3 != 0
        self.trees = BoostedTrees().fit(x[fit], y[fit])
        # Per kind the least margin at which, and above which, held-out precision is high enough.
        m, t, k = self.trees.margin(x[~fit]), y[~fit], x[~fit][:, 0]
        self.least = {}
        for kind in range(len(KINDS)):
            own = k == kind
            order = np.argsort(-m[own], kind="stable")
            right = np.cumsum(t[own][order]) / np.arange(1, own.sum() + 1)
            ok = np.flatnonzero(right >= PRECISION)
            if not len(ok):
                self.least[kind] = np.inf
                continue
            # Half-way to the first example below; every likely candidate if there is none.
            ranked = m[own][order]
            self.least[kind] = max(0.0, float(ranked[ok[-1] : ok[-1] + 2].mean())) if ok[-1] + 1 < len(ranked) else 0.0
        self.held_out = (m, t, k)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        cand = [c for c in dict.fromkeys(candidates(text))]
        if not cand:
            return []
        m = self.trees.margin(np.array([features(text, c) for c in cand]))
        taken = _Taken(base)
        out = []
        for i in sorted(range(len(cand)), key=lambda i: (-m[i], cand[i])):
            if m[i] >= self.least[cand[i][1]] and taken.add(cand[i]):
                out.append(cand[i])
        return out


class _Taken:
    """Disjoint intervals, by start."""

    def __init__(self, spans):
        self.spans: list[tuple[int, int]] = []
        top = -1
        for a, _, b in sorted(spans):
            if a >= top:
                self.spans.append((a, b))
            elif b > top:
                self.spans[-1] = (self.spans[-1][0], b)
            top = max(top, b)

    def add(self, c) -> bool:
        from bisect import bisect_left

        i = bisect_left(self.spans, (c[2],)) - 1
        if i >= 0 and self.spans[i][1] > c[0]:
            return False
        self.spans.insert(i + 1, (c[0], c[2]))
        return True


_DETECTOR: Detector | None = None


def detector() -> Detector:
    """Of the made-up sentences alone."""
    global _DETECTOR
    if _DETECTOR is None:
        _DETECTOR = Detector()
    return _DETECTOR


def fit_detector(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Detector:
    """Fitted on the driver, from at most ``sample`` rows' candidates."""
    tune(docs.sparkSession)
    ids = docs.select(F.col(doc_id).alias("__id")).filter("__id IS NOT NULL").distinct().withColumn("__h", F.xxhash64("__id", F.lit(11))).orderBy("__h", "__id").limit(sample)

    def learn(batches):
        for b in batches:
            rows = [x for t in b.column(0) for x in weak_examples(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["x"])

    chosen = docs.select(F.col(doc_id).alias("__id"), to_text(text).alias("__t")).join(F.broadcast(ids), "__id").dropDuplicates(["__id"])
    got = [r["x"] for r in chosen.select("__t").mapInArrow(learn, "x array<double>").collect()]  # at most sample * PER_ROW rows
    return Detector(sorted(got)) if got else detector()


def all_spans(text: str, found: Detector | None = None) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + (found or detector()).added(text, base))


def redact_text(text: str, found: Detector | None = None) -> str:
    """Each span (overlapping ones together) replaced by the name of its first kind in brackets."""
    spans = all_spans(text, found)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_FIELDS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def _digest(t: pa.Array, found: Detector | None = None) -> pa.Array:
    cols: list[list] = [[] for _ in _FIELDS]
    join = lambda spans: ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])
    for x in t:
        base, spans = all_spans(x.as_py(), found)
        for k in range(4):
            cols[k].append(sum(1 for s in base if s[1] == k))
        cols[4].append(hashlib.sha256(join(base).encode()).hexdigest())
        cols[5].append(join(spans))
    return pa.StructArray.from_arrays([pa.array(c, ty) for c, ty in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2)], names=list(_FIELDS))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", found: Detector | None = None) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans: a row for each input row. found: None: fitted here."""
    found = found or fit_detector(docs, doc_id, text)

    @F.arrow_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string>")
    def find(t: pa.Array) -> pa.Array:
        return _digest(t, found)

    tune(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), find(to_text(text)).alias("r")).select("doc_id", "r.*")


def redacted(text: str = "text", found: Detector | None = None) -> Column:
    """The text with all spans replaced; null stays null."""

    @F.arrow_udf("string")
    def redact(t: pa.Array) -> pa.Array:
        enter("pii")
        return pa.array([None if x is None else redact_text(x, found) for x in t.to_pylist()], pa.string())

    return redact(F.col(text))
