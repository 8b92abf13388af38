"""Personal data in text: pattern spans, and spans added by a character-level bidirectional LSTM with a CRF.

Patterns give the base spans (email, ip, card, phone); they always stay. The model is trained in numpy from labelled spans:
made-up addresses, numbers and secrets (values given to a token, key or password) in many spellings, and look-alikes
without a label, set in stretches of a bounded sample of documents whose own base spans and secrets are labelled too. It
reads windows of ``WINDOW`` characters that overlap by half. Where windows overlap their emission scores are averaged, each
weighted by the distance from its window's rim, and one Viterbi pass over each whole stretch of joined windows settles all
of them globally. Windows, weights and the last step of a stretch depend on the stretch alone, not on its batch.

By definition a model span holds a digit, an ``@`` or a spelled-out "at" (the trigger) and reaches at most half a window from
one; a window farther from every trigger cannot hold a span and is not decoded. What is a span is the model's choice.
It is added if it touches no base span, stands apart from letters and digits, and has what its kind can't be without: an
email a sign or "at" and a dot, an ip four numbers up to 255, a card 14 to 19 digits that pass Luhn, a phone 7 to 15
digits, a secret 12 characters with a letter and a digit and no white space.

Positions are code points, ends exclusive. Null text counts as empty. Extra columns pass through; own result columns
are replaced if there. Repeated rows keep a row each; an empty table gives no rows. Long texts are read whole: batches are
cut by bytes, and memory beyond the text grows with the stretches around its triggers, a bounded number at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone", "secret")  # patterns find the first four
BASE = 4
WINDOW, HALF = 128, 64
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Labels secrets in the sample that the model learns from; not used to find them.
_ASSIGNED = re.compile(r"\b(?:token|key|secret|passw(?:or)?d)\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{16,})", re.IGNORECASE)
#: A digit, a sign, or a spelled-out "at": in brackets, or between spaces before a host.
_TRIGGER = re.compile(r"[0-9@]|[(\[{<] ?at ?[)\]}>]| at [a-z0-9-]+(?: ?(?:\.|[(\[{<] ?dot ?[)\]}>]|(?<= )dot(?= )) ?[a-z0-9-]+)+", re.IGNORECASE)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The pattern spans by start, then kind, in time linear in the text."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _HOST.match(text, at + 1)):
            out.append((lo, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m[0].count(".") >= 3:
                lo, parts = m.start(), m[0].split(".")
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    hi = lo + len(".".join(four))
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        out.append((lo, 1, hi))
                    lo = hi + 1
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def possible(kind: int, span: str) -> bool:
    """Whether a span has what its kind can't be without; how it is written is the model's matter."""
    digits = "".join(_DIGIT.findall(span))
    if kind == 0:
        return bool(re.search(r"@|\bat\b", span, re.IGNORECASE)) and bool(re.search(r"\.|\bdot\b", span, re.IGNORECASE)) and "\n" not in span
    if kind == 1:
        return len(parts := re.findall("[0-9]+", span)) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 7 <= len(digits) <= 15 and len(digits) < len(span)
    return len(span) >= 12 and not re.search(r"\s", span) and bool(digits) and bool(re.search("[A-Za-z]", span))


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, other letters 128, the rest 129."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, np.where(c < 0x2000, 128, 129)).astype(np.int64)


@dataclass
class Model:
    p: dict[str, np.ndarray]

    @property
    def moves(self) -> np.ndarray:
        return np.where(_allowed(), self.p["t"], -1e9)


def _allowed() -> np.ndarray:
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def fresh(seed: int, embed: int = 12, hidden: int = 24) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"e": r.normal(0, 0.3, (130, embed)), "o": r.normal(0, 0.2, (2 * hidden, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p |= {f"x{d}": r.normal(0, embed**-0.5, (embed, 4 * hidden)), f"h{d}": r.normal(0, hidden**-0.5, (hidden, 4 * hidden)), f"b{d}": np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gates(p: dict, x: np.ndarray) -> np.ndarray:
    """What the characters add to the gates (steps, directions, windows, 4 x hidden), backward reading from the end."""
    return np.stack([(p["e"] @ p[f"x{d}"] + p[f"b{d}"])[x.T if d == "f" else x.T[::-1]] for d in "fb"], axis=1)


def _run(p: dict, gates: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Hidden states (windows, steps, both directions'); tape gets what the backward pass needs."""
    steps, two, n, w = gates.shape
    w //= 4
    weights = np.stack([p["hf"], p["hb"]])
    h = c = np.zeros((two, n, w), gates.dtype)
    out = np.empty((steps, two, n, w), gates.dtype)
    for s in range(steps):
        g = gates[s] + h @ weights
        act, u = _sigmoid(g[..., : 3 * w]), np.tanh(g[..., 3 * w :])
        i, f, o = act[..., :w], act[..., w : 2 * w], act[..., 2 * w :]
        before, c_before = h, c
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        out[s] = h
        if tape is not None:
            tape.append((i, f, o, u, c_before, tc, before))
    return np.concatenate([out[:, 0], out[::-1, 1]], axis=2).transpose(1, 0, 2)


def _back(p: dict, x: np.ndarray, tape: list, dh_all: np.ndarray, grad: dict) -> None:
    """Gradients of the LSTM and the embedding from those of the hidden states (windows, steps, both directions')."""
    n, steps, w = dh_all.shape
    w //= 2
    dh_all = np.stack([dh_all[:, :, :w].transpose(1, 0, 2), dh_all[:, ::-1, w:].transpose(1, 0, 2)], axis=1)
    weights = np.stack([p["hf"], p["hb"]]).transpose(0, 2, 1)
    dh = dc = np.zeros((2, n, w), dh_all.dtype)
    dg = np.empty((steps, 2, n, 4 * w), dh_all.dtype)
    gh = np.zeros((2, w, 4 * w), dh_all.dtype)
    for s in range(steps - 1, -1, -1):
        i, f, o, u, c_before, tc, before = tape[s]
        dh = dh + dh_all[s]
        dc = dc + dh * o * (1 - tc * tc)
        g = dg[s]
        g[..., :w], g[..., w : 2 * w] = dc * u * i * (1 - i), dc * c_before * f * (1 - f)
        g[..., 2 * w : 3 * w], g[..., 3 * w :] = dh * tc * o * (1 - o), dc * i * (1 - u * u)
        gh += before.transpose(0, 2, 1) @ g
        dh, dc = g @ weights, dc * f
    grad["hf"], grad["hb"] = gh
    grad["e"] = np.zeros_like(p["e"])
    for d, own, seen in (("f", dg[:, 0], x.T), ("b", dg[:, 1], x.T[::-1])):
        own = own.reshape(-1, 4 * w)
        grad[f"x{d}"], grad[f"b{d}"] = p["e"][seen].reshape(len(own), -1).T @ own, own.sum(axis=0)
        np.add.at(grad["e"], seen.ravel(), own @ p[f"x{d}"].T)


def emissions(model: Model, x: np.ndarray) -> np.ndarray:
    """Scores (windows, characters, tags) of character classes."""
    p = model.p
    return _run(p, _gates(p, x)) @ p["o"] + p["ob"]


def _crf(scores: np.ndarray, gold: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood by emission scores and by transitions."""
    n, steps, k = scores.shape
    e, t = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(moves)
    a, b = np.empty((steps, n, k)), np.ones((steps, n, k))
    for s in range(steps):
        v = (a[s - 1] @ t if s else 1.0) * e[:, s]
        a[s] = v / v.sum(axis=1, keepdims=True)
    for s in range(steps - 2, -1, -1):
        v = (b[s + 1] * e[:, s + 1]) @ t.T
        b[s] = v / v.sum(axis=1, keepdims=True)
    both = a * b
    marginal = (both / both.sum(axis=2, keepdims=True)).transpose(1, 0, 2)
    right = b[1:] * e.transpose(1, 0, 2)[1:]
    z = np.einsum("sni,ij,snj->sn", a[:-1], t, right, optimize=True)
    expected = np.einsum("sni,snj->ij", a[:-1] / z[:, :, None], right, optimize=True) * t
    y = np.eye(k)[gold]
    return y - marginal, np.einsum("nsi,nsj->ij", y[:, :-1], y[:, 1:], optimize=True) - expected


def gradients(p: dict, moves: np.ndarray, x: np.ndarray, gold: np.ndarray) -> dict:
    """Gradients of the log-likelihood of tags by all parameters."""
    tape, grad = [], {}
    h = _run(p, _gates(p, x), tape)
    ds, grad["t"] = _crf((h @ p["o"] + p["ob"]).astype(np.float64), gold, moves)
    ds = ds.astype(h.dtype)
    grad["o"], grad["ob"] = np.einsum("bsh,bsk->hk", h, ds, optimize=True), ds.sum(axis=(0, 1))
    _back(p, x, tape, ds @ p["o"].T, grad)
    return grad


def train(x: np.ndarray, gold: np.ndarray, epochs: int = 14, batch: int = 96, seed: int = 3, rate: float = 0.015) -> Model:
    """Adam on the CRF log-likelihood."""
    model = Model(fresh(seed))
    p, rng = model.p, np.random.default_rng(seed)
    m, v, n = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    batches = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        for rows in np.split(rng.permutation(len(x)), range(batch, len(x), batch)):
            grad = gradients(p, model.moves, x[rows], gold[rows])
            n += 1
            for k in p:
                g = (grad[k] / len(rows)).astype(np.float32)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                p[k] += rate * (1 - 0.9 * n / batches) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)
    return model


def invent(rng: np.random.Generator) -> tuple[str, int, str]:
    """A made-up item and its kind, or -1 for a look-alike that is no personal data, and what stands before it."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    word = lambda lo=3, hi=9: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(lo, hi))))
    num = lambda n: "".join(str(int(c)) for c in rng.integers(0, 10, n))
    kind = int(rng.choice(6, p=[0.18, 0.1, 0.14, 0.18, 0.14, 0.26]))
    if kind == 0:
        user = word() + pick("", "", "." + word(), "_" + num(2), num(2), "." + num(2))
        host, top = word() + pick("", num(1), "-" + word()) + pick("", "." + word()), pick("com", "org", "net", "de", "fr", "es", "io")
        form = int(rng.integers(6))
        if form < 3:
            return f"{user}@{host}.{top}", 0, ""
        at, dot = pick((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", "."), (" @ ", "."), (" at ", "."), (" at ", " (dot) "), (" at ", "(dot)"), (" AT ", " DOT "), ("{at}", "{dot}"), ("<at>", " . "))
        return user + at + host.replace(".", dot) + dot + top, 0, ""
    if kind == 1:
        return pick(".", ".", ".", " . ").join(str(int(n)) for n in rng.integers(0, 256, 4)), 1, ""
    if kind == 2:
        d = pick("4", "5", "37", "6") + num(13)
        d += next(c for c in "0123456789" if luhn(d + c))
        if pick(0, 1):
            d = num(15)
            d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick("", "", " ", "-", ".")
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)), 2, ""
    if kind == 3:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 20 {c} {num(4)}", f"+49 {a} {num(7)}", f"00 33 1 {num(2)} {num(2)} {num(2)} {num(2)}", f"+34 {a} {b} {num(3)}", f"({a}){b}-{c}"), 3, ""
    chars = pick("0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    value = "".join(chars[int(c)] for c in rng.integers(0, len(chars), int(rng.integers(16, 48))))
    at = int(rng.integers(len(value)))
    value = value[:at] + num(1) + value[at + 1 :]
    if kind == 4:
        name = pick("token", "token", "key", "api_key", "secret", "password", "access_token", "TOKEN", "API_KEY", "Password")
        return value, 4, name + pick(' = "', ' = "', '="', ': "', ": ", " = ", "=", " = '")
    alike = (value, num(1) + "." + num(1), f"v{num(1)}.{num(1)}.{num(2)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)}:{num(2)}:{num(2)}", f"${num(1)},{num(3)}.{num(2)}", num(int(rng.integers(1, 7))) + pick(".", "", "%"), f"{num(4)}, {num(4)}", num(24), f"{num(1)}. {word()} {num(1)}. {word()}", f"@{word()}", f"{word()} at {word()}. {word().capitalize()}", f"{num(3)}.{num(3)}.{num(3)}")
    return pick(*alike), -1, pick("", "", "", "commit ", "sha256: ", "version ", "id = ", "page ")


def examples(texts: list[str], n: int = 9000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: invented items set in stretches of texts, with the texts' own base spans labelled."""
    rng, rows, tags = np.random.default_rng(seed), [], []
    texts = [t for t in texts if t.strip()] or ["no text was there to learn from, so this one stands in for it. "]
    cuts = [t[max(0, m.start() - 40) : m.start() + 56] for t in texts for m in list(_TRIGGER.finditer(t))[:3]]
    while len(rows) < n:
        if cuts and rng.random() < 0.3:
            text = cuts[int(rng.integers(len(cuts)))]
            marks = [*base_spans(text), *((m.start(1), 4, m.end(1)) for m in _ASSIGNED.finditer(text))]
        else:
            text, marks = "", []
            while len(text) < 96:
                t = texts[int(rng.integers(len(texts)))]
                lo = int(rng.integers(max(1, len(t) - 40)))
                piece = _TRIGGER.sub("x", t[lo : lo + int(rng.integers(4, 40))])
                text += piece + (" ", "\n", " ", ": ")[int(rng.integers(4))]
                item, kind, lead = invent(rng)
                text += lead
                if kind >= 0:
                    marks.append((len(text), kind, len(text) + len(item)))
                quote = lead[-1:] if lead[-1:] in "\"'" else ""
                text += item + quote + (" ", ". ", ", ", "\n", "!! ", "%%% ", " ", '" ')[int(rng.integers(8))]
        row, tag = np.full(96, 32, np.int64), np.zeros(96, np.int64)
        row[: len(text[:96])] = codes(text[:96])
        for lo, k, hi in marks:
            if hi <= 96:
                tag[lo:hi] = 2 + 2 * k
                tag[lo] = 1 + 2 * k
            else:
                row[lo:] = 32
        rows.append(row)
        tags.append(tag)
    return np.stack(rows), np.stack(tags)


def sample(docs: DataFrame, size: int = 400, chars: int = 4000) -> list[str]:
    """About ``size`` texts (at most twice as many) by a hash of doc_id, at most ``chars`` characters each: the bounded
    sample that the training windows are made from."""
    total = docs.count()
    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // size))) == 0).select(F.substring("text", 1, chars).alias("text")).limit(2 * size).collect()
    return sorted(r.text for r in rows if r.text)


def fit(docs: DataFrame) -> Model:
    return train(*examples(sample(docs)))


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text within half a window of a trigger, joined where they meet, on the grid of windows."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - HALF) // HALF * HALF, min(len(text), -(-(m.end() + HALF) // HALF) * HALF)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


_RIM = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def _viterbi(scores: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags (stretches, characters) of stretches up to their ends; spans begin and end within."""
    n, steps, k = scores.shape
    best = scores[:, 0].copy()
    best[:, 2::2] = -1e9
    came, final = np.zeros((steps, n, k), np.int8), best.argmax(axis=1)
    for s in range(1, steps):
        v = best[:, :, None] + moves[None]
        came[s] = v.argmax(axis=1)
        best = v.max(axis=1) + scores[:, s]
        final = np.where(ends - 1 == s, best.argmax(axis=1), final)
    tags = np.zeros((n, steps), np.int8)
    now = final
    for s in range(steps - 1, -1, -1):
        inside = s < ends
        tags[:, s] = np.where(inside, now, 0)
        now = np.where(inside, came[s][np.arange(n), now], now)
    return tags


def scored(rows: list[np.ndarray], model: Model) -> np.ndarray:
    """Stitched emissions (stretches, characters, tags) of stretches' character classes, shortest first."""
    sizes = np.array([max(WINDOW, -(-len(r) // HALF) * HALF) for r in rows])
    x = np.full((len(rows), int(sizes.max())), 32, np.int64)
    for n, r in enumerate(rows):
        x[n, : len(r)] = r
    total, weight = np.zeros((*x.shape, TAGS), np.float32), np.zeros(x.shape, np.float32)
    for s in range(0, x.shape[1] - WINDOW + 1, HALF):
        own = int(np.searchsorted(sizes, s + WINDOW))  # the longer stretches have this window
        total[own:, s : s + WINDOW] += emissions(model, x[own:, s : s + WINDOW]) * _RIM[None, :, None]
        weight[own:, s : s + WINDOW] += _RIM
    return total / np.maximum(weight, 1)[:, :, None]


def model_spans(texts: list[str], model: Model) -> list[list[Span]]:
    """Spans that the model finds in whole texts, before any check against base spans."""
    places = [(i, lo, hi) for i, t in enumerate(texts) for lo, hi in stretches(t)]
    out: list[list[Span]] = [[] for _ in texts]
    places.sort(key=lambda x: x[2] - x[1])
    at = 0
    while at < len(places):
        size = places[min(at + 127, len(places) - 1)]
        group = places[at : at + max(1, min(128, 100_000 // max(WINDOW, size[2] - size[1])))]
        at += len(group)
        ends = np.array([hi - lo for _, lo, hi in group])
        tags = _viterbi(scored([codes(texts[i][lo:hi]) for i, lo, hi in group], model), ends, model.moves)
        for row, (i, lo, hi) in enumerate(group):
            own = tags[row, : hi - lo]
            begins = np.flatnonzero(own % 2 == 1)
            for b in begins.tolist():
                end = b + 1
                while end < len(own) and own[end] == own[b] + 1:
                    end += 1
                out[i].append((lo + b, int(own[b] - 1) // 2, lo + end))
    return [sorted(s) for s in out]


_EDGE = " \t\r\n\"'.,;:!?*&%$#|"  # what a model span may not begin or end with


def merged(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """Base spans and the possible model spans that touch none of them."""
    taken: list[list[int]] = []  # what base spans cover, without overlaps
    for lo, _, hi in base:
        if taken and lo < taken[-1][1]:
            taken[-1][1] = max(hi, taken[-1][1])
        else:
            taken.append([lo, hi])
    beside = lambda c: c.isalnum() or c in "@+"
    out, at = list(base), 0
    for lo, kind, hi in found:
        span = text[lo:hi]
        lo, hi = lo + len(span) - len(span.lstrip(_EDGE)), hi - len(span) + len(span.rstrip(_EDGE))
        while at < len(taken) and taken[at][1] <= lo:
            at += 1
        free = lo < hi and (at == len(taken) or hi <= taken[at][0])
        apart = free and not (lo and beside(text[lo - 1])) and not (hi < len(text) and beside(text[hi]))
        if apart and _TRIGGER.search(text[max(0, lo - 1) : hi + 1]) and possible(kind, text[lo:hi]):
            out.append((lo, kind, hi))
    return sorted(out)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in spans)


COLUMNS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_added", "n_spans"]


def annotate(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with the counts and digest of the base spans, all spans, and how many are secrets, added by the model, and there."""
    df = df.drop(*COLUMNS)
    place = df.columns.index(text)
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.LongType()] * 3

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in common.parts(batch, place, 1000):
                texts = [t or "" for t in part.column(place).to_pylist()]
                marked = [i for i, t in enumerate(texts) if _TRIGGER.search(t)]
                base = {i: base_spans(texts[i]) for i in marked}
                found = dict(zip(marked, model_spans([texts[i] for i in marked], model), strict=True))
                rows = []
                for i, t in enumerate(texts):
                    own = base.get(i, [])
                    every = merged(t, own, found[i]) if i in found else []
                    rows.append([*(sum(s[1] == k for s in own) for k in range(BASE)), hashlib.sha256(render(own).encode()).hexdigest(), render(every), sum(s[1] == BASE for s in every), len(every) - len(own), len(every)])
                cols = [pa.array(c, pa.int64() if isinstance(kind, T.LongType) else pa.string()) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], pa.int64() if isinstance(kind, T.LongType) else pa.string()) for kind in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *COLUMNS])

    return df.mapInArrow(common.lean(run), T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(COLUMNS, kinds, strict=True))]))


def masked(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with every span of its text replaced by the kind in capitals and brackets; rows and columns stay."""
    place = df.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in common.parts(batch, place, 1000):
                texts = part.column(place).to_pylist()
                marked = [i for i, t in enumerate(texts) if t and _TRIGGER.search(t)]
                for i, found in zip(marked, model_spans([texts[i] for i in marked], model), strict=True):
                    t, pieces, at = texts[i], [], 0
                    for start, kind, end in merged(t, base_spans(t), found):
                        if start >= at:
                            pieces += [t[at:start], f"[{KINDS[kind].upper()}]"]
                        at = max(at, end)
                    texts[i] = "".join([*pieces, t[at:]])
                columns = list(part.columns)
                columns[place] = pa.array(texts, part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return df.mapInArrow(common.lean(run), df.schema)


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return annotate(docs, fit(docs)).drop("text")
