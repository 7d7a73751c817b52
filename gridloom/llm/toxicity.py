"""Toxicity: Levenshtein automata intersected with a lexicon trie, with context-window scores.

The lexicon is learned: word beginnings and whole words that labelled toxic training texts hold many times as often as
others, each with its log odds as weight. It becomes a trie. A text's word is read by the product of that trie with the
Levenshtein automaton (insertion, deletion, substitution and transposition at any letter; entries take one error from five
letters on, whole words two from nine): a set of (trie node, errors) positions, compiled to a deterministic automaton state
by state as words are met. A word that fits no entry leaves it after a few letters. An entry whose misspellings are ordinary
words (other training texts hold terms one error from it nearly as often as toxic ones) takes no errors.

Each hit is judged in a window of words on both sides: between quotation marks it counts as quotation, hits that stand
close together raise the score. A logistic regression on the weighted counts, those of exact and of misspelled hits apart,
gives the score.

The label samples are bounded (per_class rows of each class, the first by hash of doc_id); scoring reads every whole text.
A worker's memory is bounded by MAX_POSITIONS, MAX_MOVES and MAX_WORDS; beyond them states and words are forgotten and
made again when met.

Defined results: a null or empty text gets the score of a text without hits; a row without doc_id is never held out nor a
training row; rows that repeat a doc_id each get a row; without labels every score is low; an empty table gives an empty
table. Columns besides the two named ones are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, keep, label_sample, tune
from .logistic import Linear, fit_logistic

PER_CLASS, THRESHOLD, SPAN = 6_000, 0.5, 6
#: Lengths of word beginnings that may enter the lexicon, and how many entries it has at most.
SHORTEST, LONGEST, ENTRIES = 3, 9, 4_000
#: An entry's rate in toxic texts over that in others, at least; and in standard errors.
LIFT, ERRORS = 6.0, 3.5
#: Ends the entries that are whole words.
WHOLE = "$"
#: What a worker keeps: positions of automaton states, transitions, and words with their weights.
MAX_POSITIONS, MAX_MOVES, MAX_WORDS = 4_000_000, 400_000, 150_000
#: Terms that are counted in a worker before they go to Spark's aggregation.
MAX_TERMS = 50_000
#: A misspelling's rate in toxic texts over that in others below which the entry takes no errors.
TOLERATED = 2.0
OPEN, CLOSE = "\"'“‘«„‹`", "\"'”’»“›`"
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»„‹›…–—¡¿"
N_COUNTS = 10


def bare(piece: str) -> str:
    return piece.lower().strip(EDGE)


#: The state without positions.
DEAD = -1


def errors_taken(term: str) -> int:
    """How many errors an entry takes by its length."""
    t = term.removesuffix(WHOLE)
    return 0 if len(t) < 5 else 2 if len(t) >= 9 and term.endswith(WHOLE) else 1


class Automaton:
    """The product of a lexicon trie and the Levenshtein automaton, made deterministic step by step.

    strict entries take no errors. A position is node << 3 | errors << 1 | swap; with swap, the letter before node's
    is still to be read, after which the position is that node's. A state is its sorted positions as bytes.
    """

    def __init__(self, weights: dict[str, float], strict: frozenset[str] = frozenset()):
        self.child, self.letter, self.parent, self.most = [{}], [""], [0], [0]
        self.starts, self.words = {}, {}  # node -> (weight, errors taken)
        for term, weight in sorted(weights.items()):
            at, edits = 0, 0 if term in strict else errors_taken(term)
            self.most[0] = max(self.most[0], edits)
            for c in term.removesuffix(WHOLE):
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.letter.append(c)
                    self.parent.append(at)
                    self.most.append(0)
                at = self.child[at][c]
                self.most[at] = max(self.most[at], edits)
            (self.words if term.endswith(WHOLE) else self.starts)[at] = (weight, edits)
        self._reset()

    def _reset(self) -> None:
        start = self._closed([0])
        self.ids, self.sets, self.ends, self.moves = {start: 0, b"": DEAD}, [start], [self._end(start)], [{}]
        self.positions, self.n_moves = len(start) // 4, 0

    def _closed(self, positions: list[int]) -> bytes:
        """With deletions: positions that go on in the trie without reading."""
        todo, best = positions, {}
        while todo:
            p = todo.pop()
            at, e = p & ~6, p >> 1 & 3
            if best.get(at, 9) <= e:
                continue
            best[at] = e
            if not p & 1:
                todo += [n << 3 | (e + 1) << 1 for n in self.child[p >> 3].values() if e < self.most[n]]
        return array("I", sorted(at | e << 1 for at, e in best.items())).tobytes()

    def _end(self, state: bytes) -> tuple[float, float, float, float] | None:
        """Weights at a state, if any: of a beginning and a whole word without errors, of both with errors."""
        out = [0.0] * 4
        for p in array("I", state):
            if p & 1:
                continue
            node, e = p >> 3, p >> 1 & 3
            for k, of in enumerate((self.starts, self.words)):
                weight, edits = of.get(node, (0.0, 0))
                if weight and e <= edits:
                    k = k + 2 if e else k
                    out[k] = max(out[k], weight)
        return tuple(out) if any(out) else None

    def _step(self, state: int, c: str) -> int:
        new, child, most = [], self.child, self.most
        for p in array("I", self.sets[state]):
            node, e = p >> 3, p >> 1 & 3
            if p & 1:
                if c == self.letter[self.parent[node]]:
                    new.append(p & ~1)
                continue
            more = (e + 1) << 1
            for label, to in child[node].items():
                if label == c:
                    new.append(to << 3 | e << 1)
                elif e < most[to]:
                    new.append(to << 3 | more)
                    last = child[to].get(c)
                    if last is not None and e < most[last]:
                        new.append(last << 3 | more | 1)
            if e < most[node]:
                new.append(node << 3 | more)
        made = self._closed(new)
        to = self.ids.get(made)
        if to is None:
            to = self.ids[made] = len(self.sets)
            self.sets.append(made)
            self.ends.append(self._end(made))
            self.moves.append({})
            self.positions += len(made) // 4
        self.moves[state][c] = to
        self.n_moves += 1
        return to

    def read(self, word: str) -> tuple[float, float]:
        """Weights of what the word is or begins with; and without any, of what it is or begins with but for errors."""
        if self.positions > MAX_POSITIONS or self.n_moves > MAX_MOVES:
            self._reset()
        exact, near, state, end = 0.0, 0.0, 0, None
        moves, ends = self.moves, self.ends
        for c in word:
            to = moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return exact, 0.0 if exact else near
            end = ends[state]
            if end:
                exact, near = max(exact, end[0]), max(near, end[2])
        if end:
            exact, near = max(exact, end[1]), max(near, end[3])
        return exact, 0.0 if exact else near


NOTHING = (0.0, 0.0)


class Scorer:
    def __init__(self, weights: dict[str, float], strict: frozenset[str] = frozenset()):
        self.automaton, self.known = Automaton(weights, strict), {}

    def weights(self, piece: str) -> tuple[float, float]:
        w = self.known.get(piece)
        if w is None:
            w = self.automaton.read(bare(piece))
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            self.known[piece] = w if w[0] or w[1] else NOTHING
        return w

    def counts(self, text: str | None) -> list[float]:
        """Weighted hits by kind and context, their fullest window, and their share of the text."""
        pieces = (text or "").split()
        if not pieces:
            return [0.0] * N_COUNTS
        weights, kinds = self.weights, {}
        for p in set(pieces):
            w = weights(p)
            if w[0] or w[1]:
                kinds[p] = w
        if not kinds:
            return [0.0] * (N_COUNTS - 1) + [np.log1p(len(pieces))]
        spoken, quoted, near, strongest, closest = 0.0, 0.0, 0.0, 0.0, 0.0
        at, heavy, stems = [], [], set()
        for i, p in enumerate(pieces):
            if p in kinds:
                exact, close = kinds[p]
                if self.quoted(pieces, i):
                    quoted += exact or close
                    continue
                spoken += exact
                near += close
                strongest, closest = max(strongest, exact, 0.7 * close), max(closest, close)
                at.append(i)
                heavy.append(max(exact, 0.7 * close))
                stems.add(bare(p))
        fullest = max((sum(h for j, h in zip(at[max(0, x - SPAN) : x + SPAN + 1], heavy[max(0, x - SPAN) : x + SPAN + 1], strict=True) if abs(i - j) <= SPAN) for x, i in enumerate(at)), default=0.0)
        total = spoken + 0.7 * near
        return [strongest, np.log1p(total), float(strongest >= 4), np.log1p(quoted), np.log1p(fullest), np.log1p(len(stems)), min(1.0, 5 * total / (len(pieces) + 20)), np.log1p(spoken), closest, np.log1p(len(pieces))]

    @staticmethod
    def quoted(pieces: list[str], i: int) -> bool:
        """Whether a quotation opens at or before word i and closes at or after it, within the window."""
        before, after = pieces[max(0, i - SPAN) : i + 1], pieces[i : i + SPAN + 1]
        closes = lambda p: bool(q := p.rstrip(".,;:!?")) and q[-1] in CLOSE
        opened = any(p[0] in OPEN for p in before) and not any(closes(p) and p[0] not in OPEN for p in before[:-1])
        return opened and any(map(closes, after))


#: (entry, weight, whether it takes errors), sorted.
Lexicon = tuple[tuple[str, float, bool], ...]


@lru_cache(maxsize=1)
def scorer(lexicon: Lexicon) -> Scorer:
    return Scorer({t: w for t, w, _ in lexicon}, frozenset(t for t, _, lax in lexicon if not lax))


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text that entries are learned from."""
    return {w for w in map(bare, (text or "").split()) if len(w) >= SHORTEST and not w.isdecimal()}


def _term_counts(texts: DataFrame) -> DataFrame:
    """(term, toxic, other): in how many texts (text, y) of each class a word or a word's beginning is. Workers add up to MAX_TERMS terms."""

    def batch(toxic, other):
        terms = [*toxic.keys() | other.keys()]
        return pa.record_batch([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())], ["term", "toxic", "other"])

    def run(batches):
        toxic, other = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                (toxic if y else other).update({w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w + WHOLE for w in words})
                if len(toxic) + len(other) > MAX_TERMS:
                    yield batch(toxic, other)
                    toxic, other = Counter(), Counter()
        yield batch(toxic, other)

    return texts.mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _less_one(t: Column) -> Column:
    """A term and all that come of it by leaving a letter out: terms one error apart share one of these."""
    n = F.length(t)
    return F.array_distinct(F.concat(F.array(t), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n)))))


def _near_counts(counts: DataFrame, entries: list[str]) -> DataFrame:
    """(term, toxic, other) of entries that take errors: the counts of all terms of their kind one error apart, added up."""
    spark = counts.sparkSession
    whole = F.col("term").endswith(WHOLE)
    bare_term = F.when(whole, F.expr("substring(term, 1, length(term) - 1)")).otherwise(F.col("term"))
    cut = lambda df, *cols: df.select(whole.alias("whole"), bare_term.alias("t"), "term", *cols).where(F.length("t") >= 4)
    own = cut(spark.createDataFrame([(t,) for t in entries if errors_taken(t)], "term string"))
    own = F.broadcast(own.select("whole", F.col("term").alias("entry"), F.col("t").alias("e"), F.explode(_less_one(F.col("t"))).alias("d")))  # some ten rows an entry
    met = cut(counts, "toxic", "other").select("whole", "t", "toxic", "other", F.explode(_less_one(F.col("t"))).alias("d"))
    far = F.levenshtein("t", "e")
    moved = (far == 2) & (F.length("t") == F.length("e")) & (F.array_sort(F.split("t", "")) == F.array_sort(F.split("e", "")))
    pairs = met.join(own, ["whole", "d"]).where((F.col("t") != F.col("e")) & ((far <= 1) | moved))
    pairs = pairs.groupBy("entry", "t").agg(F.max("toxic").alias("toxic"), F.max("other").alias("other"))
    return pairs.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).withColumnRenamed("entry", "term")


def learn_lexicon(sample: DataFrame, entries: int = ENTRIES, lift: float = LIFT, errors: float = ERRORS) -> Lexicon:
    """The lexicon of a labelled sample (text, y): word beginnings, and whole words ending in WHOLE.

    Counts are added up on the executors over distinct texts; at most entries candidates come to the driver.
    """
    texts = keep(sample.groupBy("text").agg(F.max("y").alias("y")), "toxic-texts")
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return ()
    counts = keep(_term_counts(texts), "toxic-terms")
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1) / ((F.col("other") + 0.5) / (n0 + 1)))
    both = (F.col("toxic") + F.col("other")) / (n1 + n0)
    z = (F.col("toxic") / n1 - F.col("other") / n0) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    found = counts.where("toxic >= 4").select("term", "toxic", F.least(F.round(weight, 4), F.lit(7.0)).alias("weight"), z.alias("z"))
    found = found.where((F.col("weight") >= float(np.log(lift))) & (F.col("z") >= errors)).orderBy(F.desc("z"), "term").limit(entries)
    weights = {r["term"]: r["weight"] for r in found.collect()}

    common = _near_counts(counts, [*weights]).where((F.col("other") >= 2) & ((F.col("toxic") + 0.5) / (n1 + 1) < TOLERATED * (F.col("other") + 0.5) / (n0 + 1)))
    strict = {r["term"] for r in common.select("term").collect()}  # some of the entries
    return tuple((t, w, t not in strict) for t, w in sorted(weights.items()))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Lexicon, Linear]:
    """(lexicon, model) from at most per_class labelled training documents of each class; of rows that repeat an id, the first by text."""
    tune(docs.sparkSession)
    chosen = F.broadcast(label_sample(labels, "toxic", per_class))  # at most 2 * per_class rows
    one = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    sample = keep(one.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "toxic-sample")
    terms = learn_lexicon(sample.select("text", "y"))

    def run(batches):
        s = scorer(terms)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([s.counts(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", F.col("y").cast("long").alias("y"), "text").mapInArrow(run, f"doc_id {kind}, y long, x array<double>").orderBy("doc_id").collect()
    return terms, fit_logistic(np.array([r["x"] for r in rows], float).reshape(len(rows), N_COUNTS), np.array([r["y"] for r in rows], float))


def score_toxicity(docs: DataFrame, terms: Lexicon, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row's whole text."""

    def run(batches):
        s = scorer(terms)
        for b in batches:
            x = np.array([s.counts(t) for t in b.column(1).to_pylist()], float)
            yield pa.record_batch([b.column(0), pa.array(model.score(x) if len(x) else np.zeros(0))], ["doc_id", "score"])

    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    terms, model = fit_toxicity(docs, labels)
    out = score_toxicity(docs, terms, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
