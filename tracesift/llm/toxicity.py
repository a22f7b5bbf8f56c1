"""Toxicity scores: a learnt lexicon in a trie, misspellings by Levenshtein automata, context windows, a logistic score."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.llm.common import fold, strings, table, training_texts
from tracesift.session import discard, written_once

#: Labelled documents that a fit reads at most, and toxic documents that a term must occur in.
SAMPLE, LEAST_TOXIC = 20_000, 3
#: Characters of the shortest and longest stem; shortest lexicon word of which misspellings are looked for.
STEM, LONGEST, FUZZY = 3, 14, 4
#: Words on either side of a term that its context takes in.
WINDOW = 6
#: Words without a hit that a worker remembers; when full it starts anew.
CACHED_WORDS = 400_000
#: What a term counts for when its context quotes it.
QUOTED = 0.3

#: By name of the model a worker process scores with: its words with a hit, and those without. Later tasks go on with it.
_LOOKED: dict[str, tuple[dict[str, tuple[float, float]], set[str]]] = {}
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¿¡"
_QUOTES = frozenset("\"«»“”„‘’'")
#: Words that report speech rather than address anyone (fixed values).
_REPORTING = frozenset("said says wrote quote quoted called term word dit écrit citation mot sagte schrieb zitat wort dijo escribió cita palabra".split())


def tokens(text: str) -> list[str]:
    """Lower-case runs without white space, without punctuation at their ends."""
    return [x.strip(_EDGES) for x in text.lower().split()]


def terms(word: str) -> list[str]:
    """The stems of a word, shortest first, and the whole word marked by a final ``$``."""
    return [word[:k] for k in range(STEM, min(len(word), LONGEST) + 1)] + [word + "$"]


class Lexicon:
    """A trie of the words whose misspellings are looked for."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.value: list[float | None] = [None]

    def add(self, word: str, value: float) -> None:
        node = 0
        for c in word:
            after = self.next[node].get(c)
            if after is None:
                after = self.next[node][c] = len(self.next)
                self.next.append({})
                self.value.append(None)
            node = after
        self.value[node] = value

    def near(self, word: str, same: int) -> float:
        """The largest value of a word that shares its first ``same`` characters with ``word`` and is within one edit of it.

        The trie is walked together with the Levenshtein automaton of ``word``:
        a state holds, for no and for one edit, the positions reached in
        ``word`` as bits; a branch ends when no position is left.
        """
        node = 0
        for c in word[:same]:
            node = self.next[node].get(c)
            if node is None:
                return 0.0
        n = len(word)
        if n < same:
            return 0.0
        masks: dict[str, int] = {}
        for i in range(same, n):
            masks[word[i]] = masks.get(word[i], 0) | 1 << i
        full = (1 << (n + 1)) - 1
        best = 0.0
        stack = [(node, 1 << same, 1 << (same + 1) & full)]
        while stack:
            node, exact, edited = stack.pop()
            value = self.value[node]
            if value is not None and value > best and (exact | edited) >> n & 1:
                best = value
            branches = self.next[node]
            if not branches:
                continue
            for c in branches if exact else masks.keys() & branches.keys():
                mask = masks.get(c, 0)
                unedited, once = (exact & mask) << 1, (edited & mask) << 1
                once = (once | exact | exact << 1 | unedited << 1) & full
                if unedited | once:
                    stack.append((branches[c], unedited, once))
        return best


class Trie:
    """Learnt terms: a value at every node, and which nodes end a lexicon word."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.value: list[float | None] = [None]
        self.word: list[bool] = [False]
        self.longest = 0
        self.forward, self.backward = Lexicon(), Lexicon()

    def add(self, term: str, value: float, word: bool) -> None:
        node = 0
        for c in term:
            after = self.next[node].get(c)
            if after is None:
                after = self.next[node][c] = len(self.next)
                self.next.append({})
                self.value.append(None)
                self.word.append(False)
            node = after
        self.value[node], self.word[node] = value, word
        if word:
            plain = term.rstrip("$")
            self.forward.add(plain, value)
            self.backward.add(plain[::-1], value)
            self.longest = max(self.longest, len(plain))

    def best(self, word: str) -> tuple[float, bool]:
        """The value at the deepest learnt stem of ``word``, and whether the whole word is known."""
        node, value = 0, 0.0
        for c in word + "$":
            node = self.next[node].get(c)
            if node is None:
                return value, False
            if self.value[node] is not None:
                value = self.value[node]
        return value, True

    def near(self, word: str) -> float:
        """The largest value of a lexicon word within one edit of ``word``.

        One edit leaves the first or the last half of the lexicon word as it
        is, so the word is followed without edits through half of the shortest
        possible match, forwards and, in a trie of reversed words, backwards;
        the automaton walks only what lies below.
        """
        half = max((len(word) - 1) // 2, FUZZY // 2)
        return max(self.forward.near(word, half), self.backward.near(word[::-1], half))


@dataclass
class Model:
    trie: Trie
    weight: np.ndarray
    bias: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def looked(self) -> tuple[dict[str, tuple[float, float]], set[str]]:
        """The words that this process has looked up for this model, with and without a hit."""
        if self.name not in _LOOKED:
            _LOOKED.clear()
            _LOOKED[self.name] = {}, set()
        return _LOOKED[self.name]

    def look(self, word: str) -> tuple[float, float]:
        """The value of the word as learnt, and of the lexicon word it may be a misspelling of."""
        value, known = self.trie.best(word)
        near = 0.0 if known or value > 1 or not FUZZY - 1 <= len(word) <= self.trie.longest + 1 else self.trie.near(word)
        return value, near

    def features(self, text: str) -> list[float]:
        """What the lexicon and the contexts say about a text; all zero without a term."""
        words = tokens(text)
        known, misses = self.looked()
        hits = {}
        for w in set(words).difference(misses):
            found = known.get(w) or self.look(w)
            if found[0] > 1 or found[1] > 1:
                hits[w] = known[w] = found
                continue
            if len(misses) >= CACHED_WORDS:
                misses.clear()
                known.clear()
            misses.add(w)
        if not hits:
            return [0.0] * len(FEATURES)
        raw = text.split()
        plain, fuzzy, quoted = [], [], 0
        places = [i for i, w in enumerate(words) if w in hits]
        for i in places:
            value, near = hits[words[i]]
            factor = QUOTED if _is_quoted(raw, words, i) else 1.0
            quoted += factor < 1
            (plain if value > 1 else fuzzy).append(max(value, near if value <= 1 else 0) * factor)
        plain.sort(reverse=True)
        close = sum(b - a <= WINDOW for a, b in zip(places, places[1:], strict=False))
        distinct = len({w for w in hits if hits[w][0] > 2})
        return [
            plain[0] if plain else 0.0, sum(plain[:5]) / 5, np.log1p(len(plain)), np.log1p(sum(v > 2 for v in plain)), np.log1p(distinct),
            100 * sum(plain) / (len(words) + 20), max(fuzzy, default=0.0), np.log1p(len(fuzzy)), np.log1p(quoted), np.log1p(close),
            np.log1p(sum(v > 3 for v in plain)), float(bool(plain) and plain[0] > 3),
        ]

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + np.dot(self.weight, self.features(text)), -30, 30))))


FEATURES = ("strongest", "five strongest", "terms", "strong terms", "distinct strong words", "density", "strongest misspelling", "misspellings",
            "quoted", "close together", "very strong terms", "any very strong")


def _is_quoted(raw: list[str], words: list[str], i: int) -> bool:
    """Whether the window around word ``i`` opens a quotation before it and closes one after it, or reports speech."""
    opened = [x[0] for x in raw[max(0, i - WINDOW) : i + 1]]
    if _QUOTES.isdisjoint(opened):
        return False
    before = sum(x in _QUOTES for x in opened)
    ended = sum(x.rstrip(".,;:!?")[-1:] in _QUOTES for x in raw[max(0, i - WINDOW) : i])
    after = any(x.rstrip(".,;:!?")[-1:] in _QUOTES for x in raw[i : i + WINDOW + 1])
    if before > ended and after:
        return True
    return any(w in _REPORTING for w in words[max(0, i - 3) : i]) and any(x[0] in _QUOTES for x in raw[max(0, i - 3) : i + 1])


def build_trie(counted: list[tuple[str, int, int]], toxic: int, other: int) -> Trie:
    """A trie of ``(term, toxic documents, other documents)``.

    A node's value is the cautious log odds of its own counts (one standard
    error below), blended with its parent's by the weight of five documents.
    Terms that are neither indicative nor below an indicative stem are left out.
    """
    trie = Trie()
    values: dict[str, float] = {}
    for term, a, b in sorted(counted, key=lambda r: (len(r[0]), r[0])):
        odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (other + 1))
        own = odds - 1.0 * (1 / (a + 0.5) + 1 / (b + 0.5)) ** 0.5
        parent = next((values[term[:k]] for k in range(len(term) - 1, 0, -1) if term[:k] in values), 0.0)
        n = a + b
        value = (n * own + 5 * parent) / (n + 5)
        values[term] = value
    kept: set[str] = set()
    for term in sorted(values, key=lambda t: (len(t), t)):
        if values[term] > 1 or any(term[:k] in kept for k in range(STEM, len(term))):
            kept.add(term)
            trie.add(term, float(values[term]), term.endswith("$") and values[term] > 1 and len(term) > FUZZY)
    return trie


def _logistic(x: np.ndarray, y: np.ndarray, shrink: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method for a regularised logistic regression with a bias."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    ridge = np.diag([shrink] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        change = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += change
        if np.abs(change).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _half() -> Column:
    """Which half of the sample, 0 or 1, a document belongs to."""
    return F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int")


def _term_counts(texts: list[str], groups: list[int]) -> tuple[list[str], np.ndarray]:
    """All terms of some texts, and in how many texts of each of four groups each occurs; the empty term stands for every text."""
    numbers: dict[str, int] = {}
    own = [[numbers.setdefault(w, len(numbers)) for w in set(tokens(text)) if w] for text in texts]
    ids: dict[str, int] = {"": 0}
    of_word = [np.array([ids.setdefault(t, len(ids)) for t in terms(w)], np.int64) for w in numbers]
    counts = np.zeros((4, len(ids)), np.int64)
    for words, group in zip(own, groups, strict=True):
        counts[group, 0] += 1
        if words:
            counts[group, np.unique(np.concatenate([of_word[w] for w in words]))] += 1
    return list(ids), counts


def _counted(chosen: DataFrame) -> list[tuple]:
    """Per term: toxic and other documents of the first half that hold it, and of the second half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = [2 * half + int(label <= 0) for label, half in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            names, counts = _term_counts(strings(batch, "text").to_pylist(), groups)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *map(pa.array, counts)], names=["term", "a0", "b0", "a1", "b1"])

    sums = chosen.select("text", "_label", _half().alias("half")).mapInArrow(run, "term string, a0 long, b0 long, a1 long, b1 long").groupBy("term").agg(
        *(F.sum(c).alias(c) for c in ("a0", "b0", "a1", "b1")))
    return [tuple(r) for r in sums.where((F.col("a0") + F.col("a1") >= LEAST_TOXIC) | (F.col("term") == "")).collect()]


def _lexicon(counted: list[tuple], halves: tuple[int, ...]) -> Trie:
    """The lexicon from the documents of some halves of the sample."""
    rows = [(r[0], sum(r[1 + 2 * h] for h in halves), sum(r[2 + 2 * h] for h in halves)) for r in counted]
    toxic, other = next(((a, b) for t, a, b in rows if t == ""), (0, 0))
    return build_trie([r for r in rows if r[0] and r[1] >= LEAST_TOXIC], toxic, other)


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, most: int = SAMPLE) -> Model:
    """Lexicon and weights from at most ``most`` labelled documents outside the held-out fold.

    Terms are counted on the executors and summed by Spark; terms of fewer than
    ``LEAST_TOXIC`` toxic documents stay there, so the driver's share is bounded
    by the sample. The weights are fitted on one half with the lexicon of the
    other half, both ways. Without toxic rows every score is the base rate.
    """
    chosen = written_once(training_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, "toxic", most, parts, held))
    counted = _counted(chosen)
    x, y = [], []
    for half in (0, 1):
        model = Model(_lexicon(counted, (half,)), np.zeros(len(FEATURES)), 0.0)
        other = chosen.where(_half() == 1 - half)

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [model.features(t) for t in strings(batch, "text").to_pylist()]
                flat = pa.array(np.array(found, float).ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32()), flat)],
                    names=["doc_id", "label", "x"])

        rows = other.select("doc_id", "text", "_label").mapInArrow(run, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
        x += rows.column("x").to_pylist()
        y += rows.column("label").to_pylist()
    trie = _lexicon(counted, (0, 1))
    discard(chosen)
    weight, bias = _logistic(np.array(x), (np.array(y) > 0).astype(float)) if x else (np.zeros(len(FEATURES)), 0.0)
    return Model(trie, weight, bias)


def scored(docs: DataFrame, model: Model, parts: int = 4, held: int = 2, least: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row, from the whole text alone.

    Null and empty texts hold no term and get the lowest score of the model's
    base. Repeated rows get equal scores; a null id stays null and is not held
    out. An empty table gives no rows; further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.score(t) for t in strings(batch, "text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= least).cast("int").alias("predicted"))


def score_documents(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scored(docs, train(docs, table(spark, folder, "labels")))
