"""Operator 5: personal data by patterns and by a character BiLSTM with CRF transitions.

Patterns find plain emails, addresses, card and phone numbers exactly. The network adds written-around
ones ("name (at) host dot org", "4111.1111..."): a bidirectional LSTM over characters gives tag scores,
a CRF layer the transitions. It is trained here, in numpy, from labelled spans: the pattern spans of a
bounded sample, and spans of every kind written in many ways into its texts.

Every span must hold a digit, an @ or a bracketed "at", so the network reads the overlapping windows of
the regions around those; nothing else of a text can become a span. Windows are decoded by Viterbi; of
the windows over a character the one in which it lies farthest from an edge decides, for the whole text.
Added spans must pass the checks of their kind and touch no pattern span. All work stays inside the rows.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + len(KINDS)  # 0 is "no personal data"
WINDOW, STRIDE, REACH = 128, 64, 64
HIDDEN = 24
#: Bytes of text worked on at a time.
CHUNK = 2_000_000
TRIGGER = re.compile(r"[0-9@]|[(\[{<]\s*(?i:at)\s*[)\]}>]")

# ---------------------------------------------------------------------------
# Patterns (fixed by the data contract)
# ---------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: if the run's first digit fails, so do the others
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def is_card(text: str) -> bool:
    number = digits(text)
    return 13 <= len(number) <= 19 and luhn(number)


def is_phone(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """As `local@domain.tld` read from the left: found from each @ outwards, so long runs without one cost nothing."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            out.append((start, end))
        else:
            end = max(end, at)  # the run before a failed @ cannot match later either
        at = text.find("@", at + 1 if not match else end)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """`(kind, start, end)` by kind, then start."""
    out = [(0, *s) for s in emails(text)]
    for kind, pattern, valid in ((1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m[0])]
    return out


# ---------------------------------------------------------------------------
# Network
# ---------------------------------------------------------------------------

#: ASCII as it is; other characters by what they are.
SYMBOLS = 128 + 4


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    for i in np.flatnonzero(codes >= 128):
        c = text[i]
        codes[i] = 128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131
    return codes


class Network(NamedTuple):
    """Weights: input and recurrent gates of both directions, output, transitions, start."""

    xf: np.ndarray
    hf: np.ndarray
    xb: np.ndarray
    hb: np.ndarray
    out: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def fresh(rng: np.random.Generator) -> Network:
    gates = 4 * HIDDEN
    network = Network(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in (
        (0.2, (SYMBOLS + 1, gates)), (0.2, (HIDDEN, gates)), (0.2, (SYMBOLS + 1, gates)), (0.2, (HIDDEN, gates)),
        (0.2, (2 * HIDDEN + 1, TAGS)), (0.1, (TAGS, TAGS)), (0.1, (TAGS,)))))
    for x in (network.xf, network.xb):
        x[-1, HIDDEN:2 * HIDDEN] += 1  # remember at first
    return network


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool = False):
    """Hidden states (time, rows, units) for symbols `x` (time, rows), and, to `keep`, what the way back needs."""
    steps, rows = x.shape
    h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    hs = np.empty((steps, rows, HIDDEN), np.float32)
    gates = np.empty((steps, rows, 4 * HIDDEN), np.float32) if keep else None
    cells = np.empty((steps + 1, rows, HIDDEN), np.float32) if keep else None
    if keep:
        cells[0] = 0
    for t in range(steps):
        z = wx[x[t]] + wx[-1] + h @ wh
        z[:, :3 * HIDDEN] = _sigmoid(z[:, :3 * HIDDEN])
        z[:, 3 * HIDDEN:] = np.tanh(z[:, 3 * HIDDEN:])
        i, f, o, g = (z[:, k * HIDDEN:(k + 1) * HIDDEN] for k in range(4))
        c = f * c + i * g
        h = o * np.tanh(c)
        hs[t] = h
        if keep:
            gates[t], cells[t + 1] = z, c
    return hs, gates, cells


def _lstm_back(x, wx, wh, hs, gates, cells, dh_out):
    """Gradients of both weight matrices."""
    steps, rows = x.shape
    dz_all = np.empty_like(gates)
    dh, dc = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * HIDDEN:(k + 1) * HIDDEN] for k in range(4))
        th = np.tanh(cells[t + 1])
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - th * th)
        dz = dz_all[t]
        dz[:, :HIDDEN] = dc * g * i * (1 - i)
        dz[:, HIDDEN:2 * HIDDEN] = dc * cells[t] * f * (1 - f)
        dz[:, 2 * HIDDEN:3 * HIDDEN] = dh * th * o * (1 - o)
        dz[:, 3 * HIDDEN:] = dc * i * (1 - g * g)
        if t:
            dwh += hs[t - 1].T @ dz
        dh, dc = dz @ wh.T, dc * f
    dwx = np.zeros_like(wx)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    order = np.argsort(x.ravel(), kind="stable")
    kinds, starts = np.unique(x.ravel()[order], return_index=True)
    dwx[kinds] = np.add.reduceat(flat[order], starts, axis=0)
    dwx[-1] = flat.sum(axis=0)
    return dwx, dwh


def tag_scores(network: Network, x: np.ndarray, keep: bool = False):
    """Scores (time, rows, tags) of symbols (time, rows)."""
    forward = _lstm(x, network.xf, network.hf, keep)
    backward = _lstm(x[::-1], network.xb, network.hb, keep)
    states = np.concatenate([forward[0], backward[0][::-1], np.ones((*x.shape, 1), np.float32)], axis=2)
    scores = states @ network.out
    return (scores, states, forward, backward) if keep else scores


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf_gradients(scores: np.ndarray, tags: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Loss (negative log-likelihood) and its gradients by scores, transitions and start; tags (time, rows)."""
    steps, rows, _ = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = start + scores[0]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + transition, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(transition + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _log_sum(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - z[None, :, None])
    d_start = d_scores[0].sum(axis=0)
    pairs = np.exp(alpha[:-1, :, :, None] + transition + (scores[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
    gold = np.take_along_axis(scores, tags[:, :, None], 2).sum() + start[tags[0]].sum() + transition[tags[:-1], tags[1:]].sum()
    np.put_along_axis(d_scores, tags[:, :, None], np.take_along_axis(d_scores, tags[:, :, None], 2) - 1, 2)
    pairs -= np.bincount((tags[:-1] * TAGS + tags[1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
    d_start = d_start - np.bincount(tags[0], minlength=TAGS)
    return z.sum() - gold, d_scores, pairs, d_start


def gradients(network: Network, x: np.ndarray, tags: np.ndarray) -> tuple[float, Network]:
    scores, states, forward, backward = tag_scores(network, x, keep=True)
    loss, d_scores, d_transition, d_start = crf_gradients(scores, tags, network.transition, network.start)
    d_out = states.reshape(-1, states.shape[2]).T @ d_scores.reshape(-1, TAGS)
    d_states = d_scores @ network.out.T
    dxf, dhf = _lstm_back(x, network.xf, network.hf, *forward, d_states[:, :, :HIDDEN])
    dxb, dhb = _lstm_back(x[::-1], network.xb, network.hb, *backward, d_states[::-1, :, HIDDEN:2 * HIDDEN])
    return float(loss), Network(dxf, dhf, dxb, dhb, d_out, d_transition, d_start)


def viterbi(scores: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags (time, rows)."""
    steps, rows, _ = scores.shape
    came = np.empty(scores.shape, np.int8)
    best = start + scores[0]
    for t in range(1, steps):
        through = best[:, :, None] + transition
        came[t] = through.argmax(axis=1)
        best = through.max(axis=1) + scores[t]
    tags = np.empty((steps, rows), np.int64)
    tags[-1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = came[t, np.arange(rows), tags[t]]
    return tags


# ---------------------------------------------------------------------------
# Labelled spans
# ---------------------------------------------------------------------------


def _card_number(rng) -> str:
    body = "".join(str(d) for d in rng.integers(0, 10, int(rng.choice([12, 14, 15, 15, 15, 18]))))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def written(rng: np.random.Generator, kind: int) -> str:
    """A made-up span of a kind, plain or written around."""
    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def word(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))

    plain = rng.random() < 0.4
    if kind == 0:
        names = [word(int(rng.integers(2, 8))) for _ in range(int(rng.integers(1, 3)))]
        local = pick(".", "_", "-", "").join(names) + pick("", str(rng.integers(1, 999)), "." + str(rng.integers(1, 99)))
        host = [word(int(rng.integers(3, 9))) + pick("", str(rng.integers(1, 99))), pick("com", "org", "net", "de", "co", "info", "example")]
        if rng.random() < 0.4:
            host.insert(0, pick("mail", "www", word(4)) + pick("", str(rng.integers(1, 9))))
        if plain:
            return local + "@" + ".".join(host)
        return local + pick("(at)", " (at) ", "[at]", " [at] ", " @ ", "{at}", " <at> ", "[AT]") + pick(".", " dot ", "(dot)", " (dot) ", "[.]", " [dot] ", " . ").join(host)
    if kind == 1:
        return (pick(".") if plain else pick("[.]", " . ", "(.)", " .", ". ", "[dot]")).join(str(v) for v in rng.integers(0, 256, 4))
    if kind == 2:
        number = _card_number(rng)
        sep = pick("", " ", "-") if plain else pick(".", "/", "  ", "_", " - ", "–", " ")
        return sep.join(number[i:i + 4] for i in range(0, len(number), 4))
    area, a, b = (str(int(rng.integers(100, 1000))), str(int(rng.integers(100, 1000))), str(int(rng.integers(1000, 10000))))
    code = str(int(rng.integers(1, 99)))
    if plain:
        return pick(f"+{code} ({area}) {a}-{b}", f"+{code} {area} {a} {b}", f"+{code}-{area}-{a}-{b}", f"+{code}{area}{a}{b}")
    return pick(f"00{code} {area} {a} {b}", f"00{code}-{area}-{a}{b}", f"({area}) {a}-{b}", f"+{code}/{area}/{a}/{b}", f"+{code}_{area}_{a}_{b}", f"+ {code} {area} {a} {b}")


def harmless(rng: np.random.Generator) -> str:
    """Digits that are no personal data."""
    def n(a, b):
        return int(rng.integers(a, b))

    return (f"Version {n(1, 9)}.{n(0, 20)}.", f"{n(1900, 2030)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 999)},{n(100, 999)}.{n(10, 99)}", f"{n(0, 24):02}:{n(0, 60):02}",
            f"{n(1, 10 ** 6)}", f"[{n(1, 99)}]", f"AB-{n(1000, 99999)}", f"{n(1, 99)} %", f"{n(1, 9)}.{n(1, 9)}.{n(1, 9)}", f"${n(1, 99999)}",
            f"@{'abcdefgh'[:n(3, 8)]}", f"p. {n(1, 99)}–{n(100, 400)}", f"{n(10 ** 6, 10 ** 7)}", f"#{n(1, 999)}", f"{n(1, 99)}, {n(1, 99)}, {n(1, 99)} and {n(1, 99)}")[n(0, 15)]


def examples(texts: list[str], rng: np.random.Generator, made: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and tags (time, rows): around pattern spans of `texts`, and with written spans put into them."""
    xs, ys = [], []

    def add(text: str, spans, at: int):
        start = max(0, min(at - int(rng.integers(0, WINDOW // 2)), len(text) - WINDOW))
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a:b] = kind + 1
        x = np.full(WINDOW, 10)
        y = np.zeros(WINDOW, np.int64)
        piece = text[start:start + WINDOW]
        x[:len(piece)], y[:len(piece)] = symbols(piece), tags[start:start + WINDOW]
        xs.append(x)
        ys.append(y)

    for text in texts:
        spans = base_spans(text)
        places = [m.start() for m in TRIGGER.finditer(text)]
        for at in {s[1] for s in spans[:3]} | ({int(rng.choice(places))} if places else set()):
            add(text, spans, at)
    source = " ".join(texts)[:2_000_000] or "no text was given to learn from "
    source = re.sub(r"[0-9@]", "", source)
    while len(source) < 4 * WINDOW:
        source += " " + source
    for _ in range(made):
        at = int(rng.integers(0, len(source) - 2 * WINDOW))
        around = source[at:at + 2 * WINDOW]
        cut = WINDOW - (0 if rng.random() < 0.3 else int(rng.integers(0, 20)))
        left, right = around[:cut], around[cut:]
        kind = int(rng.integers(0, 6))
        if kind < 4:
            value = written(rng, kind)
            spans = [(kind, len(left) + 1, len(left) + 1 + len(value))]
        else:
            value, spans = harmless(rng), []
        add(f"{left} {value}{('', '.', ',', ';')[int(rng.integers(4))]} {right}", spans, len(left) + 1)
    return np.array(xs).T, np.array(ys).T


def train(texts: list[str], steps: int = 260, rows: int = 96, made: int = 6000, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on the mean loss per window."""
    rng = np.random.default_rng(seed)
    x, y = examples(texts, rng, made)
    network = fresh(rng)
    mean, square = [np.zeros_like(w) for w in network], [np.zeros_like(w) for w in network]
    for step in range(1, steps + 1):
        some = rng.integers(0, x.shape[1], rows)
        _, grads = gradients(network, x[:, some], y[:, some])
        pace = rate * min(1.0, step / 20) * (1 if step < 0.7 * steps else 0.3)
        norm = np.sqrt(sum(float((g ** 2).sum()) for g in grads)) / rows
        for w, g, m, s in zip(network, grads, mean, square):
            g = (g / rows / max(1.0, norm / 5)).astype(np.float32)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (pace * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return network


# ---------------------------------------------------------------------------
# Finding
# ---------------------------------------------------------------------------


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows that cover all text within `REACH` of a trigger."""
    out: list[tuple[int, int]] = []
    start = end = None
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if end is not None and a <= end:
            end = max(end, b)
            continue
        if end is not None:
            out += _tiles(start, end)
        start, end = a, b
    if end is not None:
        out += _tiles(start, end)
    return out


def _tiles(start: int, end: int) -> list[tuple[int, int]]:
    out = [(start, min(end, start + WINDOW))]
    while out[-1][1] < end:
        a = out[-1][0] + STRIDE
        out.append((a, min(end, a + WINDOW)))
    return out


def decode(network: Network, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Runs of one tag `(kind, start, end)` in every text, after all windows are reconciled."""
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t)]
    tags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(0, len(places), 512):
        part = places[k:k + 512]
        x = np.full((WINDOW, len(part)), 10)
        for j, (i, a, b) in enumerate(part):
            x[:b - a, j] = symbols(texts[i][a:b])
        best = viterbi(tag_scores(network, x), network.transition, network.start)
        for j, (i, a, b) in enumerate(part):
            if i not in tags:
                tags[i] = (np.zeros(len(texts[i]), np.int8), np.full(len(texts[i]), -1, np.int32))
            tag, depth = tags[i]
            n = b - a
            own = np.minimum(np.arange(n) + (WINDOW if a == 0 else 0), np.arange(n)[::-1] + (WINDOW if b == len(texts[i]) else 0))
            mine = own > depth[a:b]
            tag[a:b][mine], depth[a:b][mine] = best[:n, j][mine], own[mine]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, (tag, _) in tags.items():
        edges = np.flatnonzero(np.diff(tag, prepend=0, append=0))
        for a, b in zip(edges, edges[1:]):
            if tag[a]:
                out[i].append((int(tag[a]) - 1, int(a), int(b)))
    return out


_AT = re.compile(r"\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s*@\s*", re.I)
_DOT = re.compile(r"\s*[(\[{<]\s*(?:dot|\.)\s*[)\]}>]\s*|\s+dot\s+|\s*\.\s*", re.I)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*)+")


def plausible(kind: int, value: str) -> bool:
    """Whether a decoded span is of its kind once its separators are written plainly."""
    if kind == 0:
        return bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", value))))
    if kind == 1:
        plain = _DOT.sub(".", value)
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain)) and is_ip(plain)
    if kind == 2:
        return is_card(value) and not re.search(r"[^\W\d]", value)
    return is_phone(value) and bool(re.match(r"\+|00|\(", value)) and not re.search(r"[^\W\d_]", value)


def added_spans(text: str, runs: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for kind, a, b in runs:
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        clear = all(b <= s or e <= a for _, s, e in base)
        # a part of a longer word or number is none of its own
        clear = clear and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
        if clear and a < b and plausible(kind, text[a:b]):
            out.append((kind, a, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(network: Network, texts: list[str | None]) -> list[tuple[list, list]]:
    """Pattern spans and added spans of every text."""
    texts = [t or "" for t in texts]
    base: list[list] = [[] for _ in texts]
    added: list[list] = [[] for _ in texts]
    some = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
    for i in some:
        base[i] = base_spans(texts[i])
    for i, runs in zip(some, decode(network, [texts[i] for i in some])):
        added[i] = added_spans(texts[i], runs, base[i])
    return list(zip(base, added))


def train_on(docs: DataFrame, sample_docs: int = 2_000) -> Network:
    """A network from about `sample_docs` of the texts that hold a digit or @, chosen by a hash of the text."""
    rows = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, sample_docs / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(max(1, int(share * (1 << 30))))).distinct()
    around = F.regexp_extract_all("text", F.lit(r"((?s).{0,120}[0-9@].{0,160})"), F.lit(1))
    pieces = rows.select(F.explode(F.slice(around, 1, 3)).alias("piece")).collect()
    return train(sorted(r.piece for r in pieces))


def personal_data(docs: DataFrame, sample_docs: int = 2_000, network: Network | None = None) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added` of every row of `docs(doc_id, text, ...)`.

    The counts and the digest are of the pattern spans, `spans` are all spans with code point offsets.
    `sample_docs` bounds the training sample (three pieces of each text at most); a given `network` is used as it is.

    Null and empty texts have no spans; null ids stay; repeated rows get equal answers; an empty table
    gives an empty result; texts of any length are read whole; other columns are ignored.
    """
    common.ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(network or train_on(docs, sample_docs))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def rows(batches):
        for batch in batches:
            for part in common.parts(batch, limit=CHUNK):
                found = find(model.value, part.column(1).to_pylist())
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                     pa.array([joined(base + added) for base, added in found], pa.string()), pa.array([len(a) for _, a in found], pa.int64())], names)

    return docs.mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, sample_docs: int = 2_000, network: Network | None = None) -> DataFrame:
    """`docs` with every span of personal data in `text` replaced by its kind in angle brackets; overlapping spans become one."""
    common.ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(network or train_on(docs, sample_docs))
    place = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            for part in common.parts(batch, limit=CHUNK):
                texts = part.column(place).to_pylist()
                clean = [_masked(t, base + added) for t, (base, added) in zip(texts, find(model.value, texts))]
                columns = list(part.columns)
                columns[place] = pa.array(clean, part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(rows, docs.schema)


def _masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not spans:
        return text
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], f"<{KINDS[kind]}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def op5_personal_data(spark, sf):
    return personal_data(common.table(spark, sf, "documents"))


def personal_data_stage(spark, docs, sf_dir):
    """All documents, with personal data masked and `n_chars`, where there is one, brought up to date.

    Null and empty texts stay as they are (a null text keeps its `n_chars`), and so do null ids, repeated rows
    (masked alike) and other columns; an empty table stays empty.
    """
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))
