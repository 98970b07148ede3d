"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions, written and trained in numpy.

The tagger learns from labelled spans that a seeded generator puts into invented prose (data of each kind, usual variants that the patterns
miss, and look-alikes that are none). Every window of every text is decoded: windows of 256 characters overlap, each
character takes its tag from the window in which it lies farthest from an edge, and spans are read from the tags of the whole text.
A window whose every non-empty path is provably worse than the empty one skips the Viterbi pass; the bound is exact, so nothing is missed.
Base spans stay; a decoded span is added where it has the form of its kind and touches no base span.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans; repeated rows are judged alike; null ids pass
through; further columns are kept by :func:`redact` and ignored by :func:`find`.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal

KINDS = ("email", "ip", "card", "phone")
#: Pieces of the base patterns, each of which passes over a text once; possessive, so that a long run is never tried from its middle.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*+"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED, _CARD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++"), re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]+")

#: Hidden units a direction, characters of a window and of the margin that neighbours own, windows handled together.
HIDDEN, WINDOW, MARGIN, BATCH = 8, 256, 24, 1024


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    odd = [int(d) for d in digits[::-1][::2]]
    even = [2 * int(d) for d in digits[::-1][1::2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def _emails(text: str):
    """Leftmost addresses: around each ``@`` the run of name characters that begins after the address before, and a domain with a dot."""
    end, at = 0, text.find("@")
    while at >= 0:
        host = _DOMAIN.match(text, at + 1)
        size = _LOCAL.match(text[end:at][::-1]).end() if host else 0
        if size:
            yield at - size, host.end()
            end = host.end()
            at = text.find("@", end)
        else:
            end, at = at + 1, text.find("@", at + 1)


def _octet(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind, then start, in time that grows with the text's length."""
    out = [(0, s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):  # every four numbers of a dotted chain are a match of the pattern
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(map(_octet, parts[k : k + 4])):
                out.append((1, at, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- characters -------------------------------------------------------------------------------------------------------------

_SINGLE = "abcdefghijklmnopqrstuvwxyz @.+-()_%:/=\n\"#,[]"
PAD, DIGIT, ACCENTED, PUNCT, OTHER = (len(_SINGLE) + k for k in range(5))
ALPHABET = len(_SINGLE) + 5
_TABLE = np.full(592, OTHER, np.uint8)
for _c in range(592):
    _ch = chr(_c)
    _TABLE[_c] = _SINGLE.index(_ch.lower()) if _ch.lower() in _SINGLE else DIGIT if "0" <= _ch <= "9" else ACCENTED if _ch.isalpha() else PUNCT if _c < 256 else OTHER


def symbols(text: str) -> np.ndarray:
    """The tagger's symbol of each code point."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(cp, len(_TABLE) - 1)]


# --- labelled spans ---------------------------------------------------------------------------------------------------------


#: Frequent letter pairs of European languages, to invent prose from.
_PAIRS = "th he ly ux from with eu in er an re nd on en at ou ed ha to or it is hi es ng ch ei ge de ie st le nt qu ai io ti ción ment é ü ö".split()


def _example(rng: np.random.Generator, size: int) -> tuple[str, list[tuple[int, int, int]]]:
    """Invented prose of at least that many characters and the labelled spans (kind number + 1, start, end) in it."""
    letters, vowels = "bcdfghjklmnprstvwz", "aeiouéèüöäñ"
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllable = lambda: pick(letters) + pick(vowels[: 5 if rng.random() < 0.8 else 11]) + (pick(letters) if rng.random() < 0.3 else "")
    pair = lambda: pick(_PAIRS)
    mixed = lambda: "".join((syllable, pair, pair)[int(rng.integers(3))]() for _ in range(int(rng.integers(1, 6))))
    rare = lambda: "".join(mixed() if rng.random() < 0.5 else pick("abcdefghijklmnopqrstuvwxyz") * int(rng.integers(1, 3)) for _ in range(int(rng.integers(1, 5))))
    word = lambda: mixed() if (w := rng.random()) < 0.55 else rare() if w < 0.8 else pick(["a", "at", "of", "the", "to", "in", "on", "de", "la", "und", "der", "y", "é", "que"])
    busy = rng.random() < 0.5  # half of the examples are nearly all prose
    plain = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(2, 9))))
    grouped = lambda sep: sep.join(digits(4) for _ in range(4))

    def email() -> str:
        name = (plain() if rng.random() < 0.5 else word()) + (pick("._-") + (plain() if rng.random() < 0.5 else digits(2)) if rng.random() < 0.6 else "")
        host = (plain() if rng.random() < 0.5 else mixed()) + (digits(1) if rng.random() < 0.4 else "") + "." + pick(["com", "org", "net", "example.com", "co.uk", "de", "fr"])
        form = rng.random()
        if form < 0.7:
            return f"{name}@{host}"
        if form < 0.85:
            return f"{name} at {host.replace('.', ' dot ')}"
        return f"{name} {pick(['(at)', '[at]', '@'])} {host.replace('.', pick(['.', ' (dot) ', ' [dot] ']))}"

    def ip() -> str:
        return pick([".", ".", ".", ".", " . ", "-", "[.]"]).join(str(int(x)) for x in rng.integers(0, 256, 4))

    def card() -> str:
        return pick([lambda: "4" + digits(15), lambda: grouped(" "), lambda: grouped("-"), lambda: digits(15), lambda: digits(4) + "." + digits(4) + "." + digits(4) + "." + digits(4)])()

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(11)}", f"00{digits(2)} {a} {b} {digits(3)}", f"{a}.{b}.{c}"])

    def other() -> str:
        hexes = "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(12, 40))))
        return pick([f"in {1900 + int(rng.integers(150))}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"CC BY-NC {digits(1)}.0", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}:{digits(2)}", f"{digits(3)},{digits(3)}", f"password={hexes[:18]}", f'"{hexes}"', f"AKIA{hexes[:16].upper()}", f"{word()} | {word()} |", f"{word()}###", f"{word()}!! {word()}!!", f"({word()})", f"+{digits(1)}", f"#{digits(5)}", f"@{word()}", f"{digits(int(rng.integers(1, 9)))}", f"{word()} at {word()}", f"{word()}.{word()}"])

    parts, spans, n = [], [], 0
    while n < size:
        u = rng.random()
        if u < (0.72 if busy else 0.96):
            s = word()
            s = s.upper() if rng.random() < 0.05 else s.capitalize() if rng.random() < 0.1 else s
        elif u < (0.84 if busy else 0.985):
            s = other()
        else:
            kind = int(rng.integers(4))
            s = (email, ip, card, phone)[kind]()
            spans.append((kind + 1, n, n + len(s)))
        s += pick([" ", " ", " ", " ", ", ", ". ", ".\n", "\n"])
        parts.append(s)
        n += len(s)
    return "".join(parts), spans


def labelled_windows(rng: np.random.Generator, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags, (size, count) each; a few windows end early, in padding."""
    x, y = np.full((size, count), PAD, np.uint8), np.zeros((size, count), np.int64)
    for b in range(count):
        text, spans = _example(rng, 3 * size)
        shift = int(rng.integers(0, size))
        keep = int(rng.integers(8, size)) if rng.random() < 0.15 else size
        x[:keep, b] = symbols(text)[shift : shift + keep]
        tags = np.zeros(len(text), np.int64)
        for kind, s, e in spans:
            tags[s:e] = kind
        y[:keep, b] = tags[shift : shift + keep]
    return x, y


# --- the network ------------------------------------------------------------------------------------------------------------

TAGS = len(KINDS) + 1


def _initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    p = {
        "x": rng.normal(0, 0.3, (2, 4 * h, ALPHABET)),
        "w": rng.normal(0, 0.3, (2, 4 * h, h)),
        "e": rng.normal(0, 0.3, (TAGS, 2 * h)),
        "b": np.zeros((TAGS, 1)),
        "t": np.eye(TAGS),
    }
    p["x"][:, h : 2 * h] += 1.0  # remember by default
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(p: dict[str, np.ndarray], x: np.ndarray):
    """What back-propagation needs: gates, cells and outputs by time, (T, 2, rows, B); direction 1 runs backwards."""
    t_max, n = x.shape
    h = HIDDEN
    gates, cells, outs = (np.empty((t_max, 2, k * h, n), np.float32) for k in (4, 1, 1))
    state = cell = np.zeros((2, h, n), np.float32)
    for t in range(t_max):
        z = p["w"] @ state
        z[0] += p["x"][0][:, x[t]]
        z[1] += p["x"][1][:, x[t_max - 1 - t]]
        z[:, : 3 * h] = 1 / (1 + np.exp(-z[:, : 3 * h]))
        z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
        cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
        state = z[:, 2 * h : 3 * h] * np.tanh(cell)
        gates[t], cells[t], outs[t] = z, cell, state
    return gates, cells, outs


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss a character and the gradients of a CRF over the network's emissions."""
    t_max, n = x.shape
    h = HIDDEN
    gates, cells, outs = _forward(p, x)
    both = np.concatenate([outs[:, 0], outs[::-1, 1]], 1)  # (T, 2h, B)
    em = p["e"] @ both + p["b"]
    trans = p["t"][:, :, None]
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = em[0]
    for t in range(1, t_max):
        alpha[t] = em[t] + _logsum(alpha[t - 1][:, None] + trans, 0)
    for t in range(t_max - 2, -1, -1):
        beta[t] = _logsum(trans + (em[t + 1] + beta[t + 1])[None], 1)
    log_z = _logsum(alpha[-1], 0)
    d_em = np.exp(alpha + beta - log_z)
    d_trans = np.zeros_like(p["t"])
    for t in range(1, t_max):
        d_trans += np.exp(alpha[t - 1][:, None] + trans + (em[t] + beta[t])[None] - log_z).sum(2)
    np.subtract.at(d_trans, (y[:-1].ravel(), y[1:].ravel()), 1)
    tt, bb = np.meshgrid(np.arange(t_max), np.arange(n), indexing="ij")
    gold = em[tt, y, bb].sum() + p["t"][y[:-1], y[1:]].sum()
    d_em[tt, y, bb] -= 1
    loss = float((log_z.sum() - gold) / x.size)
    d_em, d_trans = d_em / x.size, d_trans / x.size
    g = {"e": np.einsum("tkb,thb->kh", d_em, both), "b": d_em.sum((0, 2))[:, None], "t": d_trans, "x": np.zeros_like(p["x"]), "w": np.zeros_like(p["w"])}
    d_both = p["e"].T @ d_em
    d_out = np.stack([d_both[:, :h], d_both[::-1, h:]], 1)
    d_state, d_cell = np.zeros((2, h, n), np.float32), np.zeros((2, h, n), np.float32)
    for t in range(t_max - 1, -1, -1):
        i, f, o, c_in = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
        before = cells[t - 1] if t else np.zeros_like(cells[0])
        d_h = d_out[t] + d_state
        tc = np.tanh(cells[t])
        d_cell = d_cell + d_h * o * (1 - tc * tc)
        dz = np.concatenate([d_cell * c_in * i * (1 - i), d_cell * before * f * (1 - f), d_h * tc * o * (1 - o), d_cell * i * (1 - c_in * c_in)], 1)
        d_cell = d_cell * f
        if t:
            g["w"] += dz @ outs[t - 1].transpose(0, 2, 1)
        d_state = p["w"].transpose(0, 2, 1) @ dz
        for d, at in ((0, t), (1, t_max - 1 - t)):
            one_hot = np.zeros((n, ALPHABET), np.float32)
            one_hot[np.arange(n), x[at]] = 1
            g["x"][d] += dz[d] @ one_hot
    return loss, g


def train(steps: int = 600, batch: int = 96, size: int = 64, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit the tagger by Adam on generated windows."""
    rng = np.random.default_rng(seed)
    p = _initial(rng)
    xs, ys = labelled_windows(rng, 4000, size)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for s in range(1, steps + 1):
        pick = rng.integers(0, xs.shape[1], batch)
        _, g = _gradients(p, xs[:, pick], ys[:, pick])
        rate = 0.03 * min(1, s / 20) * (0.5 * (1 + np.cos(np.pi * s / steps)) + 0.01)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-7)).astype(np.float32)
    return p


@functools.cache
def model() -> dict[str, np.ndarray]:
    """The tagger, trained once per driver process."""
    return train()


# --- decoding ---------------------------------------------------------------------------------------------------------------


class Tagger:
    """Decodes texts with a trained network."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.half = np.ones((2, 4 * HIDDEN, 1), np.float32)
        self.half[:, : 3 * HIDDEN] = 0.5  # sigmoid(z) = tanh(z / 2) / 2 + 1 / 2: one tanh for all gates
        self.x, self.w = np.ascontiguousarray(p["x"] * self.half), np.ascontiguousarray(p["w"] * self.half)
        self.e, self.b, self.t = p["e"], p["b"], p["t"]
        t = self.t
        self.stay = max(float((t[1:, 1:]).max() - t[0, 0]), -1e9)
        # A span pays one step in and one step out; at an edge of the window only one of them.
        enter, leave = float(t[0, 1:].max() - t[0, 0]), float(t[1:, 0].max() - t[0, 0])
        self.cross = max(enter + leave, enter, leave, 0.0 if WINDOW < 2 else max(enter, leave)) - self.stay

    def _states(self, x: np.ndarray) -> np.ndarray:
        """Both directions' outputs, (T, 2 * HIDDEN, B), for symbols (T, B)."""
        t_max, n = x.shape
        h = HIDDEN
        outs = np.empty((t_max, 2 * h, n), np.float32)
        state, cell, tmp = (np.zeros((2, h, n), np.float32) for _ in range(3))
        z, add = np.empty((2, 4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
        index = x.astype(np.intp)
        for t in range(t_max):
            np.matmul(self.w, state, out=z)
            for d, at in ((0, t), (1, t_max - 1 - t)):
                np.take(self.x[d], index[at], axis=1, out=add, mode="clip")
                z[d] += add
            np.tanh(z, out=z)
            gate = z[:, : 3 * h]
            gate *= 0.5
            gate += 0.5
            cell *= z[:, h : 2 * h]
            np.multiply(z[:, :h], z[:, 3 * h :], out=tmp)
            cell += tmp
            np.tanh(cell, out=tmp)
            np.multiply(z[:, 2 * h : 3 * h], tmp, out=state)
            outs[t, :h] = state[0]
            outs[t_max - 1 - t, h:] = state[1]
        return outs

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags, (T, B)."""
        outs = self._states(x)
        t_max, _, n = outs.shape
        # What a character can gain at most by lying in a span, against lying in none; then the best span (largest run of gains).
        over = self.e[1:] - self.e[:1]
        extra = (self.b[1:] - self.b[:1]) + np.float32(self.stay)
        best = np.full(n, -np.inf, np.float32)
        run, gain, top = np.zeros(n, np.float32), np.empty((TAGS - 1, n), np.float32), np.empty(n, np.float32)
        for t in range(t_max):
            np.matmul(over, outs[t], out=gain)
            gain += extra
            np.max(gain, axis=0, out=top)
            run += top
            np.maximum(best, run, out=best)
            np.maximum(run, 0, out=run)
        # Where that can't pay for entering and leaving, the empty path wins.
        live = np.flatnonzero(best + self.cross > 0)
        tags = np.zeros((t_max, n), np.uint8)
        if len(live):
            e = np.matmul(self.e, outs[:, :, live]) + self.b
            back = np.empty((t_max, TAGS, len(live)), np.uint8)
            score = e[0]
            for t in range(1, t_max):
                paths = score[:, None] + self.t[:, :, None]
                back[t] = paths.argmax(0)
                score = paths.max(0) + e[t]
            at = score.argmax(0)
            cols = np.arange(len(live))
            for t in range(t_max - 1, -1, -1):
                tags[t, live] = at
                if t:
                    at = back[t, at, cols]
        return tags

    def tag(self, texts: list[str], base: list[list[tuple[int, int, int]]] | None = None) -> list[np.ndarray]:
        """The tags of whole texts, windows reconciled, wherever a span of a plausible form can lie.

        A plausible span holds a mark (:data:`_MARK`) and touches no base span, so windows that own a mark outside of base spans are decoded first. A span that reaches the edge of what a decoded window owns may go on in the
        next, which then is decoded too, until none does; so every span that has a mark is the one that decoding all windows would give.
        """
        coded, tags, todo, owned = [], [], [], []
        step = WINDOW - 2 * MARGIN
        for text, known in zip(texts, base or [[]] * len(texts)):
            n = len(text)
            marks = np.fromiter((p for m in _MARK.finditer(text) for p in range(*m.span())), np.int64)
            if known and len(marks):
                held = np.zeros(n + 1, np.int64)
                np.add.at(held, [s for _, s, _ in known], 1)
                np.subtract.at(held, [e for _, _, e in known], 1)
                marks = marks[np.cumsum(held)[marks] == 0]
            if n <= WINDOW:
                starts, edges = np.zeros(min(n, 1), np.int64), np.array([0, n])
            else:
                starts = np.array([*range(0, n - WINDOW, step), n - WINDOW])
                edges = np.concatenate([[0], (starts[:-1] + WINDOW + starts[1:]) // 2, [n]])
            owned.append((starts, edges))
            todo.append(np.unique(np.searchsorted(edges, marks, side="right") - 1))
            coded.append(symbols(text) if len(marks) else None)
            tags.append(np.zeros(n, np.uint8))
        done = [np.zeros(len(s), bool) for s, _ in owned]
        while any(map(len, todo)):
            self._decode_windows([(k, int(owned[k][0][w]), *map(int, owned[k][1][w : w + 2])) for k, own in enumerate(todo) for w in own], coded, tags)
            for k, own in enumerate(todo):
                if len(own):
                    done[k][own] = True
                    edges, more = owned[k][1], []
                    for w in own:
                        more += [w - 1] if w and tags[k][edges[w]] and not done[k][w - 1] else []
                        more += [w + 1] if w + 1 < len(done[k]) and tags[k][edges[w + 1] - 1] and not done[k][w + 1] else []
                    todo[k] = np.unique(np.array(more, np.int64))
        return tags

    def _decode_windows(self, windows: list[tuple[int, int, int, int]], coded: list[np.ndarray], tags: list[np.ndarray]) -> None:
        """Decode windows (text, start, first and end of the part it owns) and put their tags where they belong."""
        groups: dict[int, list[tuple[int, int, int, int]]] = {}
        for window in windows:
            groups.setdefault(min(WINDOW, -(-len(coded[window[0]]) // 32) * 32), []).append(window)
        for size, held_windows in groups.items():
            pieces = -(-len(held_windows) // BATCH)
            for part in range(pieces):
                held = held_windows[part::pieces]
                x = np.full((len(held), size), PAD, np.uint8)
                for row, (k, s, _, _) in enumerate(held):
                    own = coded[k][s : s + size]
                    x[row, : len(own)] = own
                found = self.decode(np.ascontiguousarray(x.T))
                for row in np.flatnonzero(found.any(0)):
                    k, s, a, b = held[row]
                    tags[k][a:b] = found[a - s : b - s, row]


#: What every plausible span holds: a digit, an at sign, or an ``at`` or ``dot`` that is set apart.
_MARK = re.compile(r"[0-9@]|[(\[]at[)\]]|(?<=\s)dot(?=\s)", re.I)

#: A spelt-out address: a name, an at sign in some form, and words between dots in some form. A word takes all that it can and a name begins where a word does, so a search is one pass over the text.
_WORD, _DOT = r"[\w-]++", r"\s?+(?:\.|[(\[]dot[)\]]|dot\b)\s?+"
_SPELT = re.compile(rf"(?<![\w.%+-])[\w.%+-]++\s?+(?:(?:@|[(\[]at[)\]])\s?+{_WORD}(?:{_DOT}{_WORD})++|at\s{_WORD}(?:\sdot\s{_WORD})++)", re.I)
_BEFORE, _AFTER = re.compile(r"(?:\s?+[\w.%+()\[\]-]*+){3}"), re.compile(r"[\w-]*+")


def _addresses(text: str, s: int, e: int):
    """Spelt-out addresses that share a mark with text[s:e], from up to three words before it to the end of its last word."""
    head = 0
    while True:  # the words before lie at the end of a piece that is taken longer until they begin within it
        head = max(64, 8 * head)
        taken = _BEFORE.match(text[max(0, s - head) : s][::-1]).end()
        if taken < head or head >= s:
            break
    for m in _SPELT.finditer(text, s - taken, _AFTER.match(text, e).end()):
        if _MARK.search(text, max(s, m.start()), min(e, m.end())):
            yield m.span()


def _plausible(kind: int, text: str) -> bool:
    """Whether a decoded span has the form of its kind, which isn't an address."""
    digits = len(_NOT_DIGIT.sub("", text))
    if kind == 1:
        parts = [p for p in _NOT_DIGIT.split(text) if p]
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= digits <= 19 and luhn(_NOT_DIGIT.sub("", text))
    return 9 <= digits <= 15 and not re.search(r"[A-Za-z]", text)


def all_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the added ones, by kind, then start. Where the tagger sees an address, the addresses of a form there are added, whole; numbers are added as it sees them."""
    if not tags.any():
        return base
    edges = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    held, added = np.zeros(len(text) + 1, np.int64), set()
    for _, a, b in base:
        held[a + 1 : b + 1] = 1
    np.cumsum(held, out=held)  # characters of base spans before each place
    for s, e in zip(edges.tolist(), edges[1:].tolist()):
        kind = int(tags[s]) - 1
        if kind == 0:
            added |= {(0, a, b) for a, b in _addresses(text, s, e) if held[a] == held[b]}
        elif kind > 0:
            own = text[s:e]
            s, e = s + len(own) - len(own.lstrip(" \n,.;:")), e - len(own) + len(own.rstrip(" \n,.;:"))
            if s < e and held[s] == held[e] and _plausible(kind, text[s:e]):
                added.add((kind, s, e))
    return sorted([*base, *added])


#: Rows and characters whose windows are decoded together.
SLICE_ROWS, SLICE_CHARS = 1024, 3_000_000


def _analyse(batches, tagger: Tagger, use):
    """Apply use(rows, texts, base, spans) to slices of the batches."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and end - at < SLICE_ROWS and size + len(texts[end]) <= SLICE_CHARS:
                size += len(texts[end])
                end += 1
            own = texts[at:end]
            base = [base_spans(t) for t in own]
            yield use(batch.slice(at, end - at), own, base, [all_spans(*x) for x in zip(own, tagger.tag(own, base), base)])
            at = end


def find(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, base and spans, arrays of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model())
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def use(rows, texts, base, spans):
        cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in found], span) for found in (base, spans)]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), *cols], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(frugal(lambda b: _analyse(b, Tagger(shared.value), use)), f"doc_id {kind}, base array<struct<kind:string,start:bigint,end:bigint>>, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model())
    at = docs.columns.index("text")

    def use(rows, texts, base, spans):
        known = rows.column("text").is_valid().to_pylist()
        return rows.set_column(at, rows.schema.field(at), pa.array([redact_text(t, s) if v else None for t, s, v in zip(texts, spans, known)], rows.schema.field(at).type))

    return docs.mapInArrow(frugal(lambda b: _analyse(b, Tagger(shared.value), use)), docs.schema)
