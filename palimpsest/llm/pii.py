"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside fixed patterns.

The fixed patterns (email, ip, card, phone) give base spans, which always stay. The model labels each
character as outside, begin or inside of a kind. It is trained in numpy, by gradients through time and
through the CRF's forward-backward sums, on labelled spans: generated lines in which values of each
kind, and near misses that aren't any, stand among words. In use a text's windows of WINDOW
characters overlap by half, so nearly all characters are scored in two of them; the scores are blended, the
window in which a character is further from an edge counting more, and one Viterbi decodes all windows of a
stretch as one sequence: the transitions over the seams of windows are scored like any others. A decoded span is
added if it overlaps no base span, has at least what its kind can't do without (NEEDS) and breaks none of the
rules that base spans keep: parts of an ip up to 255, a card's check digit, the number of digits.

At scale: one pass without a shuffle, the model (some 20 kB) sent along. Only what matches NEEDS is added, so
blocks of half a window without a character of a possible match aren't decoded: most have no digit, no ``@`` and
nothing that stands for one (``(at)``, ``[at]``). A stretch grows while a tagged run reaches one of its ends, so no
run is cut. A stretch without an end takes memory in proportion to its characters.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import pickle
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import base

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PATTERNS = {k: re.compile(p) for k, p in PATTERNS.items()}
# matches the same, but tries a run of digits once: a failed run fails from each of its digits
_PATTERNS["ip"] = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
WINDOW = 64
HIDDEN = 16
EMBED = 8
#: Generated lines that the model learns from, and passes over them.
LINES, EPOCHS = 1200, 6
#: What no span that the model adds can do without: an at sign and a dot or what stands for them; as many digits as its kind
#: has, with any signs between them, but three in a row at most.
NEEDS = {
    "email": re.compile(r"[^\s@]+\s?(@|\[at\]|\(at\))\s?[^\s@]+\s?(\.|\[dot\]|\(dot\))\s?[A-Za-z]{2,}"),
    "ip": re.compile(r"[0-9]{1,3}([^0-9A-Za-z]{1,3}[0-9]{1,3}){3}|[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){7}"),
    "card": re.compile(r"[0-9]([^0-9A-Za-z]{0,3}[0-9]){12,18}"),
    "phone": re.compile(r"(\+|00)[^0-9A-Za-z]{0,2}[0-9]([^0-9A-Za-z]{0,3}[0-9]){6,14}"),
}
N_TAGS = 1 + 2 * len(KINDS)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in text.split("."))
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def _sound(kind: str, text: str) -> bool:
    """Whether a value that the model adds keeps the rules of its kind: an ip's parts, a card's and a phone's digits."""
    if kind == "ip":
        return ":" in text and text.count(":") == 7 or all(int(x) <= 255 for x in re.findall("[0-9]+", text))
    return kind == "email" or _valid(kind, text[2:] if kind == "phone" and text.startswith("00") else text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the email pattern matches, from each ``@`` back, so that a long run of letters is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if local else None
        if m:
            yield at - local, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans by kind, then start; a match that isn't valid is dropped and not tried again from within."""
    out = []
    for kind in KINDS:
        if kind == "email":
            out += [(kind, a, b) for a, b in _emails(text)]
            continue
        out += [(kind, m.start(), m.end()) for m in _PATTERNS[kind].finditer(text) if _valid(kind, m.group())]
    return out


def _codes(text: str) -> np.ndarray:
    """Characters as 0 to 127; beyond ASCII all letters are one symbol and all else another."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(raw < 128, raw, 1).astype(np.int64)
    for k in np.flatnonzero(raw >= 0x2000):
        out[k] = 2
    return out


# --- the network: all windows of a call side by side, time along the first axis


@dataclass
class Net:
    emb: np.ndarray  # symbol, EMBED
    wx: np.ndarray  # direction, EMBED, 4 HIDDEN
    wh: np.ndarray  # direction, HIDDEN, 4 HIDDEN
    b: np.ndarray  # direction, 4 HIDDEN
    out: np.ndarray  # 2 HIDDEN, tag
    bias: np.ndarray
    trans: np.ndarray  # tag, tag

    def parts(self) -> list[np.ndarray]:
        return [self.emb, self.wx, self.wh, self.b, self.out, self.bias, self.trans]


def new(seed: int = 3) -> Net:
    r = np.random.default_rng(seed)
    n = lambda *shape: r.normal(0, 0.3, shape)
    b = np.zeros((2, 4 * HIDDEN))
    b[:, HIDDEN : 2 * HIDDEN] = 1.0
    return Net(n(128, EMBED), n(2, EMBED, 4 * HIDDEN), n(2, HIDDEN, 4 * HIDDEN) * 0.7, b, n(2 * HIDDEN, N_TAGS), np.zeros(N_TAGS), np.zeros((N_TAGS, N_TAGS)))


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _walk(net: Net, x: np.ndarray, k: int):
    """States of one direction (x is time, window, EMBED; reversed beforehand for the second), and what its gradient needs."""
    steps, n, _ = x.shape
    h, c, hs, memo = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.empty((steps, n, HIDDEN)), []
    pre = x @ net.wx[k] + net.b[k]
    for t in range(steps):
        z = pre[t] + h @ net.wh[k]
        i, f, o, g = _sig(z[:, :HIDDEN]), _sig(z[:, HIDDEN : 2 * HIDDEN]), _sig(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        q = np.tanh(c)
        memo.append((h, before, i, f, o, g, q))
        h = o * q
        hs[t] = h
    return hs, memo


def scores(net: Net, codes: np.ndarray):
    """Tag scores of windows (window, time) as (time, window, tag), with what the gradient needs."""
    x = net.emb[codes.T]
    fwd, m0 = _walk(net, x, 0)
    back, m1 = _walk(net, x[::-1], 1)
    h = np.concatenate([fwd, back[::-1]], 2)
    return h @ net.out + net.bias, (x, h, m0, m1)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def loss(net: Net, codes: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the CRF over windows, and its gradient for each part of the net."""
    e, (x, h, m0, m1) = scores(net, codes)
    steps, n, _ = e.shape
    y = tags.T
    a = np.empty_like(e)
    a[0] = e[0]
    for t in range(1, steps):
        a[t] = e[t] + _lse(a[t - 1][:, :, None] + net.trans, 1)
    z = _lse(a[-1], 1)
    bt = np.zeros_like(e)
    for t in range(steps - 2, -1, -1):
        bt[t] = _lse((net.trans + (e[t + 1] + bt[t + 1])[:, None, :]), 2)
    p = np.exp(a + bt - z[None, :, None])
    gold = np.take_along_axis(e, y[:, :, None], 2).sum((0, 2)) + net.trans[y[:-1], y[1:]].sum(0)
    de = p / n
    np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1 / n, 2)
    dtrans = np.zeros_like(net.trans)
    for t in range(1, steps):
        dtrans += np.exp(a[t - 1][:, :, None] + net.trans + (e[t] + bt[t])[:, None, :] - z[:, None, None]).sum(0) / n
    np.add.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), -1 / n)
    dout, dbias = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, N_TAGS), de.sum((0, 1))
    dh = de @ net.out.T
    dwx, dwh, db, dx = np.zeros_like(net.wx), np.zeros_like(net.wh), np.zeros_like(net.b), np.zeros_like(x)
    for k, memo, xs, dhs in ((0, m0, x, dh[:, :, :HIDDEN]), (1, m1, x[::-1], dh[::-1, :, HIDDEN:])):
        nh, nc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        dz = np.empty((steps, n, 4 * HIDDEN))
        for t in range(steps - 1, -1, -1):
            hb, cb, i, f, o, g, q = memo[t]
            d = dhs[t] + nh
            dc = d * o * (1 - q * q) + nc
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * cb * f * (1 - f), d * q * o * (1 - o), dc * i * (1 - g * g)], 1)
            nc = dc * f
            nh = dz[t] @ net.wh[k].T
            dwh[k] += hb.T @ dz[t]
        flat = dz.reshape(-1, 4 * HIDDEN)
        dwx[k] = np.ascontiguousarray(xs).reshape(-1, EMBED).T @ flat
        db[k] = flat.sum(0)
        dxs = dz @ net.wx[k].T
        dx += dxs if k == 0 else dxs[::-1]
    demb = np.zeros_like(net.emb)
    np.add.at(demb, codes.T, dx)
    return float((z - gold).mean()), [demb, dwx, dwh, db, dout, dbias, dtrans]


def viterbi(e: np.ndarray, trans: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Best tags (sequence, time) of scores (time, sequence, tag); what lies beyond a sequence's length repeats its last tag."""
    steps, n, tags = e.shape
    lengths = np.full(n, steps) if lengths is None else lengths
    best, back, same = e[0], np.empty((steps, n, tags), np.int8), np.arange(tags, dtype=np.int8)
    for t in range(1, steps):
        s = best[:, :, None] + trans
        on = (t < lengths)[:, None]
        back[t] = np.where(on, s.argmax(1), same)
        best = np.where(on, s.max(1) + e[t], best)
    out = np.empty((n, steps), np.int8)
    out[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out


# --- labelled spans to learn from


def _value(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    if kind == "email":
        at, dot = r.choice([("@", "."), ("@", "."), (" @ ", "."), ("(at)", "."), ("[at]", "[dot]")])
        return w() + r.choice(["", ".", "_", d(2)]) + w() + at + w() + dot + r.choice(["com", "org", "net", "de", "example.com", "co.uk"])
    if kind == "ip":
        return r.choice([".", ".", ".", ",", ". "]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        first = d(15)
        full = first + next(c for c in "0123456789" if _luhn(first + c))
        sep = r.choice(["", " ", "-", ".", " - "])
        return sep.join(full[k : k + 4] for k in range(0, 16, 4)) if sep else full
    sep = r.choice([" ", "-", ".", "/"])
    return r.choice(["+", "+", "00"]) + d(r.randint(1, 2)) + sep + r.choice([d(3), f"({d(3)})"]) + sep + d(3) + sep + d(4)


def _miss(r: random.Random) -> str:
    n = lambda k: str(r.randint(0, 10**k - 1))
    return r.choice([n(4), n(2), f"{n(2)}.{n(2)}.{n(4)}", f"{n(1)}.{n(1)}.{n(2)}", f"{n(4)}-{n(2)}", f"{n(3)},{n(3)}", f"{n(6)}", f"@{n(3)}", f"{n(2)}:{n(2)}", f"v{n(1)}.{n(2)}", f"#{n(5)}"])


def labelled(lines: int, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with the spans (kind, start, end) of what was put into them."""
    r = random.Random(seed)
    out = []
    for _ in range(lines):
        text, spans = "", []
        for _ in range(r.randint(6, 22)):
            kind = r.choice(KINDS) if r.random() < 0.16 else None
            piece = _value(kind, r) if kind else _miss(r) if r.random() < 0.15 else "".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñA") for _ in range(r.randint(1, 10))) + r.choice(["", "", "", ",", ".", ":"])
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + r.choice([" ", " ", " ", "\n", ", ", " ("])
        out.append((text, spans))
    return out


def _tags(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a] = k
        out[a + 1 : b] = k + 1
    return out


def train(data: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Net:
    """Adam over windows of the labelled lines. Without a line the net is as it starts."""
    net, xs, ys = new(seed), [], []
    for text, spans in data:
        c, t = _codes(text), _tags(len(text), spans)
        for at in range(0, max(1, len(c) - WINDOW // 2), WINDOW // 2):
            x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
            x[: len(c) - at] = c[at : at + WINDOW]
            y[: len(c) - at] = t[at : at + WINDOW]
            xs.append(x)
            ys.append(y)
    if not xs:
        return net
    X, Y, r = np.stack(xs), np.stack(ys), np.random.default_rng(seed)
    parts = net.parts()
    m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(epochs):
        order = r.permutation(len(X))
        for at in range(0, len(X), batch):
            step += 1
            pick = order[at : at + batch]
            _, grads = loss(net, X[pick], Y[pick])
            lr = rate * (1 - epoch / epochs)
            for p, g, mm, vv in zip(parts, grads, m, v, strict=True):
                g = np.clip(g, -5, 5)
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p -= lr * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return net


# --- use


_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(r"@|\[at\]|\(at\)")
_HEX = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]++(?::[0-9a-fA-F]++){7,}+")
_RUN = re.compile(r"\S+")


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches outside which no span can lie: what matches one of NEEDS lies in one or in several that touch.

    In an ip, card or phone no character is further than 3 from a digit, but for an ip of hexadecimal letters alone. An
    email has an at sign or what stands for one, at most one blank before that and at most three after it.
    """
    out = [(max(0, m.start() - 3), min(len(text), m.end() + 3)) for m in _DIGITS.finditer(text)]
    out += [m.span() for m in _HEX.finditer(text)]
    runs, starts, last = [], [], -1
    for m in _AT.finditer(text):
        if not runs:
            runs = [r.span() for r in _RUN.finditer(text)]
            starts = [a for a, _ in runs]
        k = bisect.bisect_right(starts, m.start()) - 1
        if k > last:
            out.append((runs[max(0, k - 1)][0], runs[min(len(runs) - 1, k + 3)][1]))
            last = k
    return out


def blended(net: Net, codes: np.ndarray, blocks: list[int], last: int) -> np.ndarray:
    """Tag scores (time, block, tag) of blocks of half a window. Block j is the second half of window j - 1 and the first of
    window j (from 0 to ``last``); a character counts in each by its distance from that window's edge."""
    half = WINDOW // 2
    out = np.empty((half, len(blocks), N_TAGS), np.float32)
    share = (np.arange(half)[:, None] + 1) / (half + 1)
    for at in range(0, len(blocks), 512):
        js = np.array(blocks[at : at + 512])
        lo, hi = np.clip(js - 1, 0, last), np.minimum(js, last)
        windows = np.union1d(lo, hi)
        e = scores(net, codes[windows[:, None] * half + np.arange(WINDOW)])[0]
        w = np.where(js == 0, 1.0, np.where(js > last, 0.0, share))[:, :, None]
        out[:, at : at + 512] = w * e[:half, np.searchsorted(windows, hi)] + (1 - w) * e[half:, np.searchsorted(windows, lo)]
    return out


def _joined_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def tags_of(net: Net, text: str) -> np.ndarray:
    """A tag for each character: the best sequence over the blended scores of each run of blocks that stretches() touch, a run
    growing (twice as far each time) while a tag other than outside stands at an end that isn't the text's."""
    n, half = len(text), WINDOW // 2
    out = np.zeros(n, np.int8)
    runs = _joined_runs([(a // half, (b - 1) // half + 1) for a, b in stretches(text)])
    if not runs:
        return out
    count = -(-n // half)
    codes = np.zeros((count + 1) * half, np.int64)
    codes[:n] = _codes(text)
    known: dict[int, np.ndarray] = {}
    done: set[tuple[int, int]] = set()
    grow = 1
    while len(fresh := [r for r in runs if r not in done]):
        blocks = [j for a, b in fresh for j in range(a, b) if j not in known]
        e = blended(net, codes, blocks, max(0, count - 2))
        known.update((j, e[:, k]) for k, j in enumerate(blocks))
        fresh.sort(key=lambda r: r[1] - r[0])
        while fresh:  # the longest ones first, with others at least half as long, some million characters at a time
            size = fresh[-1][1] - fresh[-1][0]
            room, part = max(1, (1 << 20) // (size * half)), []
            while fresh and len(part) < room and 2 * (fresh[-1][1] - fresh[-1][0]) >= size:
                part.append(fresh.pop())
            stack = np.zeros((size * half, len(part), N_TAGS), np.float32)
            for k, (a, b) in enumerate(part):
                stack[: (b - a) * half, k] = np.concatenate([known[j] for j in range(a, b)])
            ends = np.array([min(n, b * half) - a * half for a, b in part])
            for (a, _), end, tags in zip(part, ends, viterbi(stack, net.trans, ends), strict=True):
                out[a * half : a * half + end] = tags[:end]
        done.update(runs)
        wider = [(a - grow if a and out[a * half] else a, b + grow if b < count and out[b * half - 1] else b) for a, b in runs]
        runs = _joined_runs([(max(0, a), min(count, b)) for a, b in wider])
        grow *= 2
    return out


def spans_of(net: Net, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a whole text, each by kind, then start; a null counts as empty."""
    text = text or ""
    first = base_spans(text)
    taken = np.zeros(len(text), bool)
    for _, a, b in first:
        taken[a:b] = True
    tags, extra, k = tags_of(net, text), [], 0
    for k in np.flatnonzero(tags % 2 == 1).tolist():
        end = k + 1
        while end < len(text) and tags[end] == tags[k] + 1:
            end += 1
        kind = KINDS[(int(tags[k]) - 1) // 2]
        while end > k and not text[end - 1].isalnum():
            end -= 1
        if not taken[k:end].any() and NEEDS[kind].fullmatch(text[k:end]) and _sound(kind, text[k:end]):
            extra.append((kind, k, end))
            taken[k:end] = True
    return first, sorted([*first, *extra], key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class _Find:
    def __init__(self, net: Net):
        self.net = net

    def __call__(self, batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in base.slices(batch, 1):
                got = [spans_of(self.net, t) for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(s[0] == k for s in every) for _, every in got], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(_joined(first).encode()).hexdigest() for first, _ in got], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, pa.array([_joined(every) for _, every in got], pa.string()), pa.array([_joined(first) for first, _ in got], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "base_spans"])


def find(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans, base_spans (kind:start:end in code points) of each row."""
    return docs.select("doc_id", "text").mapInArrow(base.tidied(_Find(net)), f"doc_id {base.id_type(docs)}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, base_spans string")


@functools.lru_cache(1)
def standard() -> Net:
    """The net as trained on the generated lines; the same in every process."""
    return train(labelled(LINES))


def _trained(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(standard())], pa.binary())], ["net"])


_NET: list[Net] = []


def trained(spark: SparkSession) -> Net:
    """standard(), trained in a task rather than on the driver, once in a driver's life."""
    if not _NET:
        _NET.append(pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(base.tidied(_trained), "net binary").first()["net"]))
    return _NET[0]


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_<kind> are of base spans, as base_sha256 is; all_<kind> of all spans."""
    found = find(base.table(spark, sf_dir, "documents"), trained(spark))
    counts = [F.regexp_count("base_spans", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, "base_sha256", "spans", "base_spans", *(F.col(f"n_{k}").alias(f"all_{k}") for k in KINDS))


QUERIES = {"op4_pii": op4_pii}
ORACLE: dict[str, str] = {}
