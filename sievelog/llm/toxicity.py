"""Toxicity of documents by a learned lexicon, matched with misspellings and weighed by context.

1. Terms (words, and stems of four to nine letters) are counted in labelled documents where they are not quoted; those
   that toxic documents hold far more often than others become the lexicon; the evidence for a term alone decides.
2. The lexicon is a trie. The Levenshtein automaton of every distinct word of a text walks it, so terms are met with
   one wrong, missing, additional or swapped letter (two in long terms), and stems with any rest of the word. Words
   that clean documents use about as often as toxic ones are no misspellings.
3. A hit is weighed by the words around it: how often they surround hits of toxic rather than of other documents, and
   whether quotation marks enclose it. What is quoted is counted apart from what is said.
4. A logistic model of these sums, fitted to the labels, gives the score.

Fitting uses at most ``SAMPLE`` labelled documents of either class, chosen by a hash of the id; scoring reads whole
texts of all documents. Of the context words seen around ten hits or more of the sample, the ``CONTEXT`` most frequent in
both classes have weights; terms have three to forty letters. Null and empty texts have no hits and get the score of a
text without hits. Without labels of both classes every score is 0. Repeated rows are scored each and score alike; labels
other than 0 and 1 are left out, and of several labels of a document the greatest counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievelog.llm.encoder import _Memory
from sievelog.session import ship_package, written

SAMPLE, CONTEXT = 12_000, 300
REACH = 6
#: Log-likelihood ratio from which a term is no chance find among a hundred thousand.
EVIDENCE = 24.0
THRESHOLD = 0.3
STEMS = range(4, 10)
#: Letters from which a term is met with one edit and with two, and letters that the tests before the walks look at.
ONE_EDIT, TWO_EDITS = 4, 9
HEAD, HEAD_TWO = 8, 12
#: Log-odds below which a word, or a stem, says too little. Words that are also quoted have lower ones.
ODDS, STEM_ODDS = 1.5, 3.5
SMALL_LABELS = 2_000_000
_WORD = re.compile(r"\w+")
_QUOTES = re.compile("[\"“”«»„]")


class Trie:
    """Lexicon whose nodes are dictionaries of letters; ``ends`` maps a node to (term, weight, stem)."""

    def __init__(self, terms: list[tuple[str, float, bool]]):
        self.nodes: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[str, float, bool]] = {}
        for term, weight, stem in terms:
            at = 0
            for letter in term:
                if letter not in self.nodes[at]:
                    self.nodes.append({})
                    self.nodes[at][letter] = len(self.nodes) - 1
                at = self.nodes[at][letter]
            self.ends[at] = (term, weight, stem)

    def exact(self, word: str) -> tuple[str, float] | None:
        """The term that the word is, or whose stem it begins with; the longest counts."""
        at, found = 0, None
        for i, letter in enumerate(word):
            at = self.nodes[at].get(letter, -1)
            if at < 0:
                return found
            end = self.ends.get(at)
            if end and (end[2] or i + 1 == len(word)):
                found = end[:2]
        return found

    def near(self, word: str, edits: int, swaps: bool = False) -> tuple[str, float, int] | None:
        """The term least edits away, found by walking the word's automaton and the trie together.

        The automaton follows the word along the trie and may leave it at any letter by one edit: a letter of the
        trie is missing from the word, stands for another one, or the word has one more; with ``swaps`` also two
        neighbours in the wrong order. From there it goes on with one edit less; without any left it can only follow.
        The end of a stem is met whatever the rest of the word.
        """
        for spent in range(edits + 1):
            found = [self.ends[at] for at in self._reach(0, word, 0, spent, swaps)]
            if found:
                term, weight, _ = max(found, key=lambda e: (e[1], e[0]))
                return term, weight, spent
        return None

    def _reach(self, at: int, word: str, i: int, left: int, swaps: bool) -> list[int]:
        """Ends reached from a node and a place in the word with at most ``left`` edits."""
        nodes, ends, n, out = self.nodes, self.ends, len(word), []
        while True:
            end = ends.get(at)
            if end and (i == n or end[2]):
                out.append(at)
            children = nodes[at]
            if left:
                for letter, child in children.items():
                    below, stops = nodes[child], child in ends
                    # with one edit only a child that ends or goes on as the word does is worth a step
                    if i == n or left > 1 or stops or word[i] in below:
                        out += self._reach(child, word, i, left - 1, swaps)
                    if i < n and letter != word[i] and (i + 1 == n or left > 1 or stops or word[i + 1] in below):
                        out += self._reach(child, word, i + 1, left - 1, swaps)
                if i < n:
                    out += self._reach(at, word, i + 1, left - 1, swaps)
                if swaps and i + 1 < n and word[i] != word[i + 1] and word[i + 1] in children:
                    below = nodes[children[word[i + 1]]]
                    if word[i] in below:
                        out += self._reach(below[word[i]], word, i + 2, left - 1, swaps)
            at = children.get(word[i], -1) if i < n else -1
            if at < 0:
                return out
            i += 1


def allowed_edits(term: str) -> int:
    """Edits after which a term is still met: none in terms of three letters, two in long ones."""
    return (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)


def _reached(terms: list[tuple[str, float, bool]], edits: int, size: int) -> Callable[[str], bool]:
    """Test that no word within ``edits`` of a term fails, for words of which most do.

    If a word begins with letters so near to the first n of a term, both keep one string of n - edits letters when
    ``edits`` are taken from the first n of each; n is the length of the term, ``size`` at most.
    """
    stems: dict[int, set[tuple[str, ...]]] = {}
    every: dict[int, set[tuple[str, ...]]] = {}
    for term, _, stem in terms:
        n = min(len(term), size)
        kept = set(combinations(term[:n], n - edits))
        every.setdefault(n, set()).update(kept)
        # a shorter whole term is near no word that is longer by more than the edits
        stems.setdefault(n, set()).update(kept if stem or n == size else ())
    rows = [(n, every[n], stems[n]) for n in sorted(every)]

    def reached(word: str) -> bool:
        for n, known, of_stems in rows:
            if len(word) < n - edits:
                return False
            if not (known if len(word) <= n + edits else of_stems).isdisjoint(combinations(word[:n], n - edits)):
                return True
        return False

    return reached


@dataclass
class Model:
    terms: list[tuple[str, float, bool]]
    clean: frozenset[str] = frozenset()
    around: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def matcher(self) -> Callable[[str], tuple[float, bool] | None]:
        """Strength of a lower-case word and whether it is spelt right; None for most words."""
        trie = Trie(self.terms)
        highest = max((w for _, w, _ in self.terms), default=1.0)
        walks = []
        for edits, size in ((1, HEAD), (2, HEAD_TWO)):
            bendable = [t for t in self.terms if allowed_edits(t[0]) >= edits]
            walks.append((edits, Trie(bendable), _reached(bendable, edits, size)))

        def match(word: str) -> tuple[float, bool] | None:
            exact = trie.exact(word)
            if exact:
                return exact[1] / highest, True
            if word in self.clean:
                return None
            for edits, bent, reached in walks:
                near = bent.near(word, edits, swaps=True) if reached(word) else None
                if near:
                    return near[1] / highest / (1 + near[2]), False
            return None

        return _Memory(match).__getitem__


def hits(text: str, match: Callable) -> list[tuple[float, bool, bool, list[str]]]:
    """(strength, spelt right, quoted, words around) of each hit in a text."""
    lowered = text.lower()
    words = _WORD.findall(lowered)
    found = [(i, m) for i, m in enumerate(map(match, words)) if m]
    if not found:
        return []
    out = []
    spans = [m.start() for m in _WORD.finditer(lowered)]
    marks = np.array([m.start() for m in _QUOTES.finditer(lowered)] or [], np.int64)
    for i, (strength, right) in found:
        # an odd number of marks since the line began
        line = lowered.rfind("\n", 0, spans[i]) + 1
        quoted = bool(len(marks)) and int(np.searchsorted(marks, spans[i]) - np.searchsorted(marks, line)) % 2 == 1
        around = words[max(0, i - REACH) : i] + words[i + 1 : i + 1 + REACH]
        out.append((strength, right, quoted, around))
    return out


def features(found: list[tuple[float, bool, bool, list[str]]], around: dict[str, float]) -> np.ndarray:
    """Bias, said, quoted, misspelt and strongest."""
    said = quoted = bent = top = 0.0
    for strength, right, marked, words in found:
        lean = 1 / (1 + np.exp(-np.clip(sum(around.get(w, 0.0) for w in words), -8, 8)))
        value = strength * 2 * lean
        if marked:
            quoted += value
        elif right:
            said += value
        else:
            bent += value
        top = max(top, value * right * (not marked))
    return np.array([1.0, np.log1p(said), np.log1p(quoted), np.log1p(bent), min(top, 2.0)])


def _crc(of: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, y) of at most about ``sample`` labelled documents of either class, none of them held out.

    Labels other than 0 and 1 say nothing and are left out; of several labels of a document the greatest counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (F.coalesce(_crc(4), F.lit(2)) != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.when(F.col("y") == 1, min(1.0, sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample / max(1, counts.get(0, 0))))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))
    # bounded by the sample, twice over
    known = F.broadcast(known) if 2 * sample <= SMALL_LABELS else known
    return documents.select("doc_id", "text").join(known, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")


def _counted(rows: DataFrame, keys_of: Callable[[str], set[str]]) -> DataFrame:
    """(key, pos, neg): documents of either class that hold a key; summed within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                for key in keys_of(text.as_py()):
                    sums.setdefault(key, [0, 0])[y] += 1
            both = np.array(list(sums.values()), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array(both[:, 1]), pa.array(both[:, 0])], ["key", "pos", "neg"])

    rows = rows.select("text", F.col("y").cast("int"))
    return rows.mapInArrow(run, "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _said(text: str) -> set[str]:
    """Lower-case words of a text outside quotation marks."""
    return {w for line in text.lower().split("\n") for part in _QUOTES.split(line)[::2] for w in _WORD.findall(part)}


def _terms_of(text: str) -> set[str]:
    words = {w for w in _said(text) if 3 <= len(w) <= 40}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _half(text: str) -> str:
    return str(zlib.crc32(text.encode()) & 1)


def choose_terms(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> list[tuple[str, float, bool]]:
    """Terms that speak for label 1, strongest first; a longer stem of a kept one is left out.

    Whole words are kept beside their stem, since a misspelt word can be further from the stem than from the word.
    """
    kept: dict[str, tuple[float, bool]] = {}
    # of the words kept under a stem, in how many toxic documents the most frequent one is
    whole: dict[str, int] = {}
    covered: set[str] = set()
    scored = []
    for key, pos, neg in counts:
        odds = float(np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)))
        scored.append((odds * np.sqrt(pos), key.rstrip("*"), key.endswith("*"), odds, pos))
    # words before stems of the same letters, so that a term which is always whole stays whole
    for _, term, stem, odds, pos in sorted(scored, key=lambda s: (-round(s[0], 2), s[2], len(s[1]), s[1])):
        if term in covered or stem and any(term[:n] in covered for n in range(1, len(term))):
            continue
        if stem and whole.get(term, 0) >= 0.9 * pos and term in whole:
            continue
        kept[term] = (odds, stem)
        if stem:
            covered.add(term)
        for n in () if stem else STEMS:
            whole[term[:n]] = max(whole.get(term[:n], 0), pos)
    return [(t, w, s) for t, (w, s) in sorted(kept.items())]


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Newton steps; classes weigh alike, and weights are drawn to ``prior``."""
    w = prior.copy()
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * 100
    pull = np.full(x.shape[1], strength)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + pull * (w - prior)
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        w = w - np.linalg.solve(hess, grad)
    return w


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Lexicon, contexts and weights from the labelled documents that are not held out; None without both classes."""
    ship_package(documents.sparkSession)
    spark = documents.sparkSession
    rows = labelled(documents, labels, sample)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    if not n_pos or not n_neg:
        return None
    terms = _counted(rows, _terms_of)
    far = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    share, both = n_pos / (n_pos + n_neg), F.col("pos") + F.col("neg")
    evidence = 2 * (
        F.col("pos") * F.log(F.col("pos") / (both * share))
        + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (both * (1 - share)))).otherwise(0.0)
    )
    strong = far > F.when(F.col("key").endswith("*"), STEM_ODDS).otherwise(ODDS)
    sure = (F.col("pos") >= 3) & strong & (evidence > EVIDENCE)
    best = terms.where(sure)
    model = Model(choose_terms([tuple(r) for r in best.collect()], n_pos, n_neg))

    # words that would pass for misspellings but are hardly rarer in clean documents, then the words around hits
    match = model.matcher

    def bent(text: str) -> set[str]:
        m, half = _cached(match), _half(text)
        return {half + w for w in _said(text) if (h := m(w)) and not h[1]}

    halves = _counted(rows, bent).withColumns({"half": F.substring("key", 1, 1), "key": F.expr("substring(key, 2)")})

    def clean_words(found: DataFrame) -> frozenset[str]:
        found = found.groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        found = found.where((F.col("neg") > 0) & (far <= ODDS))
        return frozenset(r["key"] for r in found.collect())

    # for the weights, each half is judged by the clean words of the other, since the words of a new text are new too
    halves = written(halves, "bent")
    others = {half: clean_words(halves.where(F.col("half") != half)) for half in "01"}
    model.clean = clean_words(halves)
    held = spark.sparkContext.broadcast(model)

    def context(text: str) -> set[str]:
        found = hits(text, _cached(held.value.matcher))
        return {w for h in found for w in h[3]} | ({""} if found else set())

    near = _counted(rows, context).where("pos + neg >= 10").orderBy(F.desc(F.least("pos", "neg")), "key").limit(CONTEXT).collect()
    of_hits = next(((r["pos"], r["neg"]) for r in near if r["key"] == ""), (0, 0))
    if of_hits[1] >= 10:
        model.around = {
            r["key"]: float(np.clip(np.log((r["pos"] + 2) / (of_hits[0] + 2)) - np.log((r["neg"] + 2) / (of_hits[1] + 2)), -2, 2))
            for r in near
            if r["key"]
        }
    held = spark.sparkContext.broadcast({half: replace(model, clean=words) for half, words in others.items()})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {half: m.matcher() for half, m in held.value.items()}
        for batch in batches:
            texts = [(t, _half(t)) for t in batch.column(0).to_pylist()]
            x = [features(hits(t, matchers[half]), held.value[half].around).tolist() for t, half in texts]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    fitted = rows.select("text", F.col("y").cast("int").alias("y")).mapInArrow(measure, "x array<double>, y int")
    fitted = fitted.toArrow()  # at most the sample
    x, y = np.array(fitted["x"].to_pylist()), fitted["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the same order of sums in every run
    x, y = x[order], y[order]
    model.weights = fit_logistic(x, y, np.array([-3.0, 1.5, 0.3, 1.0, 1.5]))
    return model


_MATCHERS: dict[int, Callable] = {}


def _cached(make: Callable) -> Callable:
    """One matcher per model in a worker process, so that words are remembered between batches."""
    key = id(getattr(make, "__self__", make))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = make()
        _MATCHERS["owner"] = make  # type: ignore[index]  # keeps the id from being used again
    return _MATCHERS[key]


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """(row, score, n_hits) of every document; ``row`` holds its own columns."""
    spark = documents.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            scores, numbers = [], []
            for text in batch.column(0).field("text"):
                if model is None:
                    scores.append(0.0)
                    numbers.append(0)
                    continue
                found = hits(text.as_py() or "", _cached(model.matcher))
                scores.append(float(1 / (1 + np.exp(-np.clip(features(found, model.around) @ model.weights, -30, 30)))))
                numbers.append(len(found))
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(numbers, pa.int64())], ["row", "score", "n_hits"])

    return rows.mapInArrow(run, f"row {rows.schema[0].dataType.simpleString()}, score double, n_hits long")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels that are not held out and score all documents."""
    return score(documents, train(documents, labels))
