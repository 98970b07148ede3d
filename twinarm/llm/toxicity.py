"""Toxicity by a noisy channel: obfuscated words are restored by Viterbi decoding, then the restored text is scored.

Each suspicious token (look-alike digits and symbols, letters repeated three times or more, separators inside) and each run of
single spaced-out characters becomes a lattice: a position offers the character itself and what it may stand for, a repetition one or two letters, a
separator nothing or itself. The best path under a character trigram model takes the token's place in the restored text. A token of plain letters has
one path only, so it needs no decoding. A lattice of more than ``STRETCH`` positions is decoded in stretches: after each, what all paths that are still open begin with is put out,
and the rest of each goes on, so the result is the best path over the whole lattice, in memory for a stretch and what is open.

The score is logistic in the evidence of the restored text's words: the largest of a word, and that of a prefix that several words share, with their number. Features are words, their prefixes, and prefixes that several words
of a text share; each counts by a smoothed log odds of toxic against clean training documents, kept where chance can't explain it. Near copies share one count.

The trigrams are counted over all texts. Features and weights are fitted on at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of doc_id. Scoring takes every whole text and looks at
nothing else. Defined results: null and empty texts have no evidence and get the score of that; repeated rows are scored alike; labels
that are null or disagree on a doc_id: nulls are ignored, the larger one counts; without usable labels every score is 0;
further columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most_about, frugal, materialise

#: Labelled rows to fit on, about; a fraction is chosen by hash where there are more.
TRAIN_ROWS = 24_000
#: Distinct tokens whose evidence a worker remembers, and the longest of them; longer ones are scored anew each time.
CACHE, CACHED_LETTERS = 120_000, 64
#: Features or words that a task counts before it hands them on.
COUNTED = 150_000
#: Letters whose trigrams are counted at once, and letters of features or tokens that a task holds.
COUNTED_LETTERS, HELD_LETTERS = 1 << 20, 1 << 23
#: Positions of a lattice decoded together, and transitions a position beyond which that is done on matrices.
STRETCH, DENSE = 160, 300
#: Documents of the average kind that every feature is counted in besides its own.
PRIOR = 4.0
THRESHOLD = 0.7

#: Characters and the letters they may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "§": "s", "¡": "i",
    "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz",
}
#: Letters of other scripts that look like Latin ones.
HOMOGLYPH = str.maketrans("аеорсхуіјѕԁоα", "aeopcxyijsdoa")
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
#: Costs in nats: standing for another character, dropping a separator, shortening a repetition.
SUBSTITUTE, DROP, SHORTEN = 1.0, 0.5, 0.3

SYMBOLS = {" ": 0} | {c: i + 1 for i, c in enumerate([*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xDF, 0x100))])}
OTHER = len(SYMBOLS)
SIZE = OTHER + 1
_CODES = np.array([SYMBOLS.get(chr(i), OTHER) for i in range(257)], np.int64)  # the last one stands for all beyond
_SPACED = re.compile(r"(?<!\S)\S(?: {1,2}\S){3,}(?!\S)")
_SUSPECT = re.compile(r"[0-9@$!|+*#€£§¡(]|(.)\1\1|[^\W\d_][.\-_'~/\\][^\W\d_]")
_LETTER = re.compile(r"[^\W\d_]")
_WORD, _NOT_END = re.compile(r"[\w@$€£!*#|+(]"), re.compile(r"[\W_]*+")
_WIDE = re.compile("[^\x00-\xff]|\xad")
_RUN = re.compile(r"(.)\1*", re.S)


def normalise(text: str) -> str:
    """Lower case; compatibility forms, look-alike letters of other scripts and invisible characters give way to plain ones."""
    if _WIDE.search(text):
        text = unicodedata.normalize("NFKC", text).translate(INVISIBLE).lower().translate(HOMOGLYPH)
    return text.lower()


def trigram_counts(words: dict[str, int], counts: np.ndarray) -> None:
    """Add the character trigrams of words, each between spaces and as often as it is given, to counts (flat)."""
    held, size = [], 0
    for w in words:
        held.append(w)
        size += len(w) + 2
        if size >= COUNTED_LETTERS:
            _count(held, words, counts)
            held, size = [], 0
    if held:
        _count(held, words, counts)


def _count(held: list[str], words: dict[str, int], counts: np.ndarray) -> None:
    points = np.frombuffer(("  " + "  ".join(held) + "  ").encode("utf-32-le", "surrogatepass"), "<u4")
    c = _CODES[np.minimum(points, len(_CODES) - 1)]
    times = np.repeat([words[w] for w in held], [len(w) + 2 for w in held])[1 : len(c) - 1]  # of the word at a trigram's middle
    times = np.append(times, np.zeros(len(c) - 2 - len(times), np.int64))
    at = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
    own = (c[1:-1] > 0) | (c[2:] > 0)  # not both spaces between two words
    counts += np.bincount(at[own], times[own], len(counts)).astype(np.int64)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a character after two others, interpolated with those after one and none."""
    uni = counts.sum((0, 1)) + 0.5
    uni = uni / uni.sum()
    two = counts.sum(0)
    bi = (two + 20 * uni) / (two.sum(1, keepdims=True) + 20)
    return np.log((counts + 10 * bi[None]) / (counts.sum(2, keepdims=True) + 10))


def trim(token: str) -> str:
    """The token without punctuation around it; symbols that may stand for a first letter stay."""
    first = _WORD.search(token)
    return token[first.start() : len(token) - _NOT_END.match(token[::-1]).end()] if first else ""


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Options (text, cost) by position."""
    out = []
    for m in _RUN.finditer(token):
        ch, n = m[1], len(m[0])
        if ch == " " or not ch.isalnum() and ch not in LOOKALIKE:
            out.append([(ch * n if ch != " " else " ", 0.0), ("", DROP)])
            continue
        stands = [(ch, 0.0), *((x, SUBSTITUTE) for x in LOOKALIKE.get(ch, ""))]
        gone = [] if ch.isalnum() else [("", DROP)]
        if n >= 3 or n == 2 and ch in LOOKALIKE:
            out.append([(x * k, cost + SHORTEN) for x, cost in stands for k in (1, 2)] + [(ch * n, 0.0)] + gone)
        else:
            out += [stands + gone] * n
    return out


_as_list: list = [None, None]


def _flat(model: np.ndarray) -> list[float]:
    """The model as a flat list, which is faster to read one by one; the last one is kept."""
    if _as_list[0] is not model:
        _as_list[:] = model, model.ravel().tolist()
    return _as_list[1]


#: Open paths by their last two symbols: the score, and the text since what all of them share.
Beam = dict[tuple[int, int], tuple[float, str]]


def _sparse(options: list[list[tuple[str, float]]], model: np.ndarray, beam: Beam) -> Beam:
    """The best path to each state after further positions, state by state."""
    flat = _flat(model)
    for own in options:
        own = [(piece, cost, [SYMBOLS.get(ch, OTHER) for ch in piece]) for piece, cost in own]
        reached: Beam = {}
        for (a, b), (score, text) in beam.items():
            for piece, cost, symbols in own:
                x, y, total = a, b, score - cost
                for z in symbols:
                    total += flat[(x * SIZE + y) * SIZE + z]
                    x, y = y, z
                if (x, y) not in reached or total > reached[x, y][0]:
                    reached[x, y] = (total, text + piece)
        beam = reached
    return beam


def _dense(options: list[list[tuple[str, float]]], model: np.ndarray, beam: Beam, last: bool) -> Beam:
    """As :func:`_sparse`, on matrices over all pairs of symbols; after the last positions, for the best state alone."""
    score = np.full((SIZE, SIZE), -np.inf)
    for state, (value, _) in beam.items():
        score[state] = value
    trail = []
    for own in options:
        best, choice, source = np.full((SIZE, SIZE), -np.inf), np.zeros((SIZE, SIZE), np.int16), np.zeros((SIZE, SIZE), np.int16)
        rows, cols = np.flatnonzero(np.isfinite(score).any(1)), np.flatnonzero(np.isfinite(score).any(0))
        live = score[np.ix_(rows, cols)]
        letters = [(k, SYMBOLS.get(p, OTHER), cost) for k, (p, cost) in enumerate(own) if len(p) == 1]
        if letters:
            paths = live[:, :, None] + model[np.ix_(rows, cols, [z for _, z, _ in letters])]
            top, at = paths.max(0), rows[paths.argmax(0)]
            for j, (k, z, cost) in enumerate(letters):
                more = cols[top[:, j] - cost > best[cols, z]]
                i = np.searchsorted(cols, more)
                best[more, z], choice[more, z], source[more, z] = top[i, j] - cost, k, at[i, j] * SIZE + more
        for k, (piece, cost) in enumerate(own):
            if not piece:
                more = score - cost > best
                best[more], choice[more], source[more] = score[more] - cost, k, np.flatnonzero(more)
            elif len(piece) > 1:
                z = [SYMBOLS.get(ch, OTHER) for ch in piece]
                paths = live + model[rows][:, cols, z[0]] + model[cols, z[0], z[1]][None, :]
                a, b = np.unravel_index(paths.argmax(), paths.shape)
                value = paths[a, b] - cost + sum(model[x, y, t] for x, y, t in zip(z, z[1:], z[2:]))
                if value > best[z[-2], z[-1]]:
                    best[z[-2], z[-1]], choice[z[-2], z[-1]], source[z[-2], z[-1]] = value, k, rows[a] * SIZE + cols[b]
        trail.append((choice.ravel(), source.ravel()))
        score = best
    ends = np.array([score.argmax()]) if last else np.flatnonzero(np.isfinite(score))
    # Back over all states at once; where their paths have met, one of them is followed.
    at, tails = ends, []
    for own, (choice, source) in zip(reversed(options), reversed(trail)):
        if len(at) > 1 and (at == at[0]).all():
            at = at[:1]
        tails.append([own[k][0] for k in choice[at].tolist()])
        at = source[at].astype(np.int64)
    heads = [beam[divmod(int(x), SIZE)][1] for x in at]
    shared = heads[0] + "".join(t[0] for t in reversed(tails) if len(t) == 1) if len(heads) == 1 else ""
    apart = [t for t in tails if len(t) == len(ends)] if len(ends) > 1 else []
    out: Beam = {}
    for i, x in enumerate(ends.tolist()):
        head = shared if len(heads) == 1 else heads[i]
        out[divmod(x, SIZE)] = (float(score.flat[x]), head + "".join(t[i] for t in reversed(apart)))
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The best path through the token's lattice."""
    options, done, beam = [*lattice(token), [(" ", 0.0)]], [], {(0, 0): (0.0, "")}
    for at in range(0, len(options), STRETCH):
        own, last = options[at : at + STRETCH], at + STRETCH >= len(options)
        sizes = [*map(len, own)]
        transitions = sum(x * y * z for x, y, z in zip(sizes, sizes[1:], sizes[2:]))
        beam = _dense(own, model, beam, last) if transitions > DENSE * len(own) else _sparse(own, model, beam)
        texts = [text for _, text in beam.values()]
        sure = os.path.commonprefix([min(texts), max(texts)])
        done.append(sure)
        beam = {state: (score, text[len(sure) :]) for state, (score, text) in beam.items()}
    return "".join([*done, max(beam.values())[1]]).strip()


def restored(token: str, model: np.ndarray) -> list[str]:
    """The words that take a token's place in the restored text."""
    core = trim(token)
    if _SUSPECT.search(core) and _LETTER.search(core):
        return decode(core, model).split()
    return [core] if core else []


def tokens_of(text: str, model: np.ndarray) -> set[str]:
    """Tokens of a normalised text, and what its spaced-out runs decode to."""
    tokens = set(text.split())
    for m in _SPACED.finditer(text):
        tokens.update(decode(m[0], model).split())
    return tokens


def restore(text: str | None, model: np.ndarray) -> str:
    """The restored text, its spaced-out runs decoded and each token in its place."""
    text = _SPACED.sub(lambda m: decode(m[0], model), normalise(text or ""))
    return " ".join(w for t in text.split() for w in restored(t, model))


def prefixes(word: str) -> list[str]:
    """The prefixes of 3 to 7 letters."""
    return [word[:k] for k in range(3, min(8, len(word) + 1))]


def features(words: set[str]) -> set[str]:
    """What a text's words show: themselves, their prefixes, and prefixes that two words share."""
    begun = Counter(p for w in words for p in prefixes(w))
    return {"=" + w for w in words} | {"^" + p for p in begun} | {"^^" + p for p, n in begun.items() if n > 1}


@dataclass
class Model:
    """A fitted scorer: SIZE cubed probabilities, and the features that chance doesn't explain in the rows that it was fitted on."""

    chars: np.ndarray
    lexicon: dict[str, float]
    weights: tuple[float, ...]

    def __post_init__(self) -> None:
        #: How words begin that any feature can be of.
        self.heads = {f.lstrip("=^")[:3] for f in self.lexicon}

    def shown(self, token: str, cache: dict[str, tuple]) -> tuple:
        """((word, evidence, known prefixes that count when shared), ...) of the words in a token's place that have any."""
        found = cache.get(token)
        if found is None:
            found = ()
            for w in restored(token, self.chars):
                if w[:3] not in self.heads:
                    continue
                begun = prefixes(w)
                own = max([self.lexicon.get("=" + w, 0.0), *(self.lexicon.get("^" + p, 0.0) for p in begun)])
                shared = tuple(p for p in begun if "^^" + p in self.lexicon)
                if own or shared:
                    found += ((w, own, shared),)
            if len(token) <= CACHED_LETTERS:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[token] = found
        return found

    def signals(self, text: str | None, cache: dict[str, tuple]) -> tuple[float, float, float]:
        """Of the restored text: the strongest evidence of a word, that of a prefix that words share, and the latter times the logarithm of half the words with such prefixes."""
        words = {x for token in tokens_of(normalise(text or ""), self.chars) for x in self.shown(token, cache)}
        begun = Counter(p for _, _, shared in words for p in shared)
        best = max((self.lexicon["^^" + p] for p, n in begun.items() if n > 1), default=0.0)
        n = max(2, sum(any(begun[p] > 1 for p in shared) for _, _, shared in words))
        return max((own for _, own, _ in words), default=0.0), best, best * math.log(n / 2)

    def score(self, *signals: float) -> float:
        value = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], signals))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, value))))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About that many labelled rows outside the held-out part: text, toxic and weight. Repeated rows count once, however many texts a doc_id has. Rows that share a minimal shingle hash, near copies, share one weight."""
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = marked.count()
    if n > rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    joined = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(marked), "doc_id")  # at most about rows ids

    def least(seed: int) -> Column:
        return F.array_min(F.transform("g", lambda g: F.xxhash64(g, F.lit(seed))))

    split = joined.withColumns({"w": F.split(F.lower("text"), "\\s+"), "h": F.xxhash64("doc_id", "text")})
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)))
    hashed = materialise(split.select("text", "toxic", "h", grams.alias("g")).select("text", "toxic", "h", least(1).alias("m1"), least(2).alias("m2")), "toxic-sample")
    hashed = at_most_about(hashed, "h", rows)
    weighed = hashed
    for m in ("m1", "m2"):  # at most as many rows as the sample has
        weighed = weighed.join(F.broadcast(hashed.groupBy(m, "toxic").agg(F.count("*").alias(f"n_{m}"))), [m, "toxic"])
    return weighed.select("text", "toxic", (1 / F.greatest("n_m1", "n_m2")).alias("weight"))


def _character_model(docs: DataFrame) -> np.ndarray:
    """The language model of the words of all texts; it needs no labels. Tasks send at most SIZE cubed numbers each."""

    def count(batches):
        counts, seen, size = np.zeros(SIZE**3, np.int64), Counter(), 0

        def add():
            words = Counter()
            for t, n in seen.items():
                words[trim(t)] += n
            del words[""]
            trigram_counts(words, counts)
            seen.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(normalise(text).split())
                size += len(text)
                if len(seen) >= COUNTED or size >= 4 * HELD_LETTERS:
                    add()
                    size = 0
        add()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"k": pa.array(at), "n": pa.array(counts[at])})

    counts = np.zeros(SIZE**3)
    for r in docs.select("text").where(F.col("text").isNotNull()).mapInArrow(frugal(count), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most SIZE cubed
        counts[r["k"]] = r["n"]
    return language_model(counts.reshape(SIZE, SIZE, SIZE))


def _lexicon(train: DataFrame, chars: np.ndarray, toxic: float, clean: float) -> dict[str, float]:
    """Features whose share of toxic documents chance can't explain, with smoothed log odds."""

    def count(batches):
        seen: dict[str, list[float]] = {}
        size = 0

        def counted():
            out = pa.RecordBatch.from_pydict({"f": pa.array(seen.keys(), pa.string()), "c": pa.array([v[0] for v in seen.values()], pa.float64()), "t": pa.array([v[1] for v in seen.values()], pa.float64())})
            seen.clear()
            return out

        for batch in batches:
            for text, y, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "weight"))):
                for f in features({w for t in tokens_of(normalise(text), chars) for w in restored(t, chars)}):
                    seen.setdefault(f, [0.0, 0.0])[y] += weight
                    size += len(f)
                if len(seen) >= COUNTED or size >= HELD_LETTERS:
                    yield counted()
                    size = 0
        yield counted()

    counts = train.mapInArrow(frugal(count), "f string, c double, t double").groupBy("f").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    base = toxic / (toxic + clean)
    n, rate = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    # Chernoff's bound on so many toxic documents among n, against the number of features tried.
    surprise = n * (rate * F.log(rate / base) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    odds = F.log((F.col("t") + PRIOR * base) / (F.col("c") + PRIOR * (1 - base))) - math.log(base / (1 - base))
    kept = counts.where((F.col("t") >= 2 - 1e-6) & (rate > base)).select("f", surprise.alias("s"), odds.alias("w")).where((F.col("s") > 11.5) & (F.col("w") > 1.5))
    return {r["f"]: r["w"] for r in kept.collect()}


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression of weighted rows by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-3, *[0.05] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn the character model, the lexicon and the weights."""
    train = training_rows(docs, labels, rows)
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(np.zeros((SIZE, SIZE, SIZE)), {}, (-60.0, 0.0, 0.0, 0.0))
    chars = _character_model(docs)
    model = Model(chars, _lexicon(train, chars, toxic, clean), (0.0, 0.0, 0.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def signals(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            found = [shared.value.signals(t, cache) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), *(pa.array(x, pa.float64()) for x in np.array(found).reshape(-1, 3).T)], names=["y", "weight", "a", "b", "c"])

    points = np.array([tuple(r) for r in train.mapInArrow(frugal(signals), "y int, weight double, a double, b double, c double").collect()], float)  # about rows at most
    model.weights = _logistic(points[:, 2:], points[:, 0], points[:, 1])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches):
        m, cache = shared.value, {}
        for batch in batches:
            found = [m.score(*m.signals(t, cache)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(frugal(scores), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows scored at threshold or above, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        m, cache = shared.value, {}
        for batch in batches:
            yield batch.filter(pa.array([m.score(*m.signals(t, cache)) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(frugal(kept), docs.schema)
