"""Toxicity by a weighted grammar of clause patterns, composed of finite-state transducers.

Lexical transducers turn the words of a clause into signs: insults and threats with a weight, targets, negations, verbs of report.
Transducers over signs then mark what a negation excuses, what is only reported, and what is aimed at a target; they are composed
into one. Its weights over a text's clauses are the inputs of a logistic layer. Insult words and the layer are learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import chunks, with_columns
from .common import fresh, hashed_sample

# Closed-class words of the grammar, in English, German, French and Spanish, and insults known from the start.
TARGETS = ["you", "your", "yours", "yourself", "u", "ya", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "euer", "tu", "toi", "te", "ton", "ta", "vous", "votre", "vos", "usted", "ustedes", "tú", "ti", "vosotros"]
NEGATIONS = ["not", "no", "never", "nobody", "none", "cannot", "don't", "isn't", "aren't", "won't", "nicht", "kein", "keine", "nie", "niemals", "pas", "jamais", "aucun", "nunca", "jamás"]
REPORTS = ["said", "says", "say", "wrote", "writes", "called", "calls", "quoted", "reported", "claimed", "asked", "sagte", "schrieb", "nannte", "meinte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó"]
THREATS = ["kill", "hurt", "destroy", "burn", "shoot", "stab", "hang", "murder", "rape", "töten", "umbringen", "tuer", "détruire", "matar", "destruir"]
INSULTS = ["idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "jerk", "fool", "bastard", "dummkopf", "arschloch", "imbécile", "connard", "idiota", "imbécil", "estúpido"]
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = r"[^\W\d_]+(?:'[^\W\d_]+)?"
WORDS, SIGNED = re.compile(WORD), re.compile(WORD + '|["“”„«»]')
QUOTES = "\"“”„«»"
#: Words that a negation reaches.
REACH = 3
#: How often a stem stands in a text that harps on it.
BURST = 3
#: Weight of a known insult while the labels say nothing of it.
KNOWN_WEIGHT = 3.0
#: Weights of asserted, aimed and excused matches.
NONE, ASSERTED, AIMED, EXCUSED = (0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 0, 1)


@dataclass
class Transducer:
    """Arcs (state, sign) -> [(next state, sign put out, weights)], start and final states; a sign without an arc ends the path."""

    start: tuple
    final: frozenset
    arcs: dict = field(default_factory=dict)

    def add(self, state, sign: str, to, out: str, weights: tuple = NONE) -> None:
        self.arcs.setdefault((state, sign), []).append((to, out, weights))


def composed(a: Transducer, b: Transducer) -> Transducer:
    """What ``a`` puts out is read by ``b``: states are pairs, weights add up. Only pairs that a path can reach are made."""
    out = Transducer(tuple((p, q) for p in a.start for q in b.start), frozenset())
    signs = {s for _, s in a.arcs}
    todo, seen = list(out.start), set(out.start)
    while todo:
        p, q = todo.pop()
        for sign in signs:
            for p2, middle, w in a.arcs.get((p, sign), ()):
                for q2, last, v in b.arcs.get((q, middle), ()):
                    out.add((p, q), sign, (p2, q2), last, tuple(x + y for x, y in zip(w, v, strict=True)))
                    if (p2, q2) not in seen:
                        seen.add((p2, q2))
                        todo.append((p2, q2))
    out.final = frozenset((p, q) for p, q in seen if p in a.final and q in b.final)
    return out


#: Signs: I insult, H threat, T target, N negation, R report, Q quotation mark, - any other; i and h excused.
def negation(reach: int = REACH) -> Transducer:
    """Excuses insults and threats among the ``reach`` words after a negation. The state counts the words left."""
    t = Transducer((0,), frozenset(range(reach + 1)))
    for left in range(reach + 1):
        t.add(left, "N", reach, "-")
        for sign in "IHTRQ-":
            t.add(left, sign, max(0, left - (sign != "Q")), {"I": "i", "H": "h"}.get(sign, sign) if left else sign)
    return t


def reported() -> Transducer:
    """Excuses what stands in quotation marks after a verb of report, or after such a verb and its target ("he said you ...")."""
    t = Transducer(("none",), frozenset({"none", "said", "quote", "claim"}))
    for state in ("none", "said", "quote", "claim"):
        inside = state in ("quote", "claim")
        t.add(state, "R", "quote" if state == "quote" else "said", "-")
        t.add(state, "Q", {"said": "quote", "claim": "quote", "quote": "said"}.get(state, state), "-")
        t.add(state, "T", "claim" if state == "said" else state, "T")
        for sign in "IHih-":
            t.add(state, sign, state, {"I": "i", "H": "h"}.get(sign, sign) if inside else sign)
    return t


def aimed() -> Transducer:
    """Tells insults with a target in their clause (A) from those without (I); a threat counts (B) only with one.

    The target may come later, so paths begin with a guess: "no" meets no target, "yes" must meet one before the end.
    """
    t = Transducer(("no", "yes"), frozenset({"no", "met"}))
    for state, sure in (("no", False), ("yes", True), ("met", True)):
        if sure:
            t.add(state, "T", "met", "-")
        for sign, out in (("I", "A" if sure else "I"), ("H", "B" if sure else "-"), ("i", "x"), ("h", "x" if sure else "-"), ("-", "-")):
            t.add(state, sign, state, out)
    return t


def weighed() -> Transducer:
    """Weights of the matches."""
    t = Transducer((0,), frozenset({0}))
    for sign, weights in (("I", ASSERTED), ("A", AIMED), ("B", AIMED), ("x", EXCUSED), ("-", NONE)):
        t.add(0, sign, 0, sign, weights)
    return t


def grammar_transducer() -> Transducer:
    return composed(composed(composed(negation(), reported()), aimed()), weighed())


@dataclass(frozen=True)
class Grammar:
    """Learned parts: weights of insult words, of insult stems (the first ``stem`` letters of longer words) and of stems that count in texts
    that harp on them only, and the final logistic layer."""

    words: dict[str, float]
    stems: dict[str, float]
    stem: int
    layer: tuple[float, ...]  # intercept, then one weight a feature
    bursts: dict[str, float] = field(default_factory=dict)


class Clauses:
    """The whole grammar at work: lexical transducers, then the composed one."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.machine = grammar, grammar_transducer()
        self.lexicon = {w: (s, 1.0) for s, group in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS), ("Q", QUOTES)) for w in group}
        self.lexicon |= {w: ("I", v) for w, v in grammar.words.items()}
        self.threats = frozenset(THREATS)
        self.starts = frozenset(grammar.stems) | frozenset(grammar.bursts)
        self.stems = grammar.stems  # those that count in the text at hand

    def sign(self, word: str) -> tuple[str, float]:
        """Lexical transducers: a word's sign and weight; insult words and stems go before the closed classes."""
        found = self.lexicon.get(word)
        if (found is None or found[0] != "I") and len(word) > self.grammar.stem and (weight := self.stems.get(word[: self.grammar.stem])):
            return "I", weight
        return found or ("-", 1.0)

    def weights(self, signs: list[tuple[str, float]]) -> tuple[float, float, float]:
        """(asserted, aimed, excused) weight of a clause: the composed transducer's path that reaches a final state."""
        arcs, paths = self.machine.arcs, {s: (0.0, 0.0, 0.0) for s in self.machine.start}
        for sign, weight in signs:
            after: dict = {}
            for state, sums in paths.items():
                for to, _, w in arcs.get((state, sign), ()):
                    reached = tuple(x + weight * y for x, y in zip(sums, w, strict=True))
                    after[to] = max(after.get(to, reached), reached)
            paths = after
        return max((v for s, v in paths.items() if s in self.machine.final), default=(0.0, 0.0, 0.0))

    def suspicious(self, words: set[str]) -> bool:
        """Whether any word can start a match at all: most texts end here."""
        stem = self.grammar.stem
        return not words.isdisjoint(self.grammar.words) or not words.isdisjoint(self.threats) or not {w[:stem] for w in words if len(w) > stem}.isdisjoint(self.starts)

    def features(self, text: str) -> tuple[float, ...]:
        """Of a whole text: log of one plus the asserted weight, the same aimed, the same excused, and clauses with an asserted match by clause."""
        lower = text.lower()
        words = WORDS.findall(lower)
        if not self.suspicious(set(words)):
            return (0.0, 0.0, 0.0, 0.0)
        grammar = self.grammar
        harped = {s for s in often(words, grammar.stem) if s in grammar.bursts}
        self.stems = grammar.stems | {s: grammar.bursts[s] for s in harped} if harped else grammar.stems
        sums, hits, count = [0.0, 0.0, 0.0], 0, 0
        for clause in CLAUSE.split(lower):
            signs = [self.sign(w) for w in SIGNED.findall(clause)]
            count += bool(signs)
            if any(s in "IH" for s, _ in signs):
                found = self.weights(signs)
                sums, hits = [x + y for x, y in zip(sums, found, strict=True)], hits + (found[0] > 0)
        return (*map(math.log1p, sums), hits / max(count, 1))


def fit_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method with a ridge, on rows that stand ``times`` times each; a fixed number of rounds, so refits agree."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (times * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (times * (y - p)) - ridge * w)
    return tuple(float(v) for v in w)


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5, is 0. A null doc_id is written as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: The layer where labels of both kinds are missing.
UNTAUGHT = (-2.0, 2.0, 1.0, -0.5, 1.0)


def often(words: list[str], stem: int) -> set[str]:
    """Stems of longer words that a text harps on: they stand in it ``BURST`` times or more."""
    return {s for s, n in Counter(w[:stem] for w in words if len(w) > stem).items() if n >= BURST}


def terms(text: str, stem: int) -> set[str]:
    """Distinct words of a text, marked by ``=``, stems of its longer words, and those that it harps on, marked by ``*``."""
    words = WORDS.findall(text.lower())
    return {f"={w}" for w in words} | {w[:stem] for w in words if len(w) > stem} | {f"*{s}" for s in often(words, stem)}


def term_counts(rows: DataFrame, stem: int, held: int = 400_000) -> DataFrame:
    """term, toxic, n: in how many of the ``rows`` (text, toxic) each term stands; the empty term counts the rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["term", "toxic", "n"])
            found.clear()
            return batch

        for batch in batches:
            marks, done = batch.column(1).to_pylist(), 0
            for part in chunks([x or "" for x in batch.column(0).to_pylist()]):
                for text, toxic in zip(part, marks[done : done + len(part)], strict=True):
                    found.update((t, toxic) for t in ({""} | terms(text, stem)))
                    if len(found) >= held:
                        yield out()
                done += len(part)
        if found:
            yield out()

    return rows.mapInArrow(count, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, least: float = 1.0, sure: float = 2.5, sure_few: float = 1.5) -> dict[str, float]:
    """Weights (log odds) of the terms whose log odds of standing in a toxic text are surely over ``least``.

    Surely means: less ``sure`` standard errors, so that a few chance meetings don't make an insult. A stem that a text harps on is
    rarely there by chance, so ``sure_few`` of them do where ten texts are toxic (two that harp on one stem and no clean one suffice). The
    more texts, the more stems get a chance: half a standard error is added for each tenfold of toxic texts, up to ``sure``. Known insults are in with
    ``KNOWN_WEIGHT`` at least, unless the labels surely speak against them. What is returned grows with the
    vocabulary of insults only, out of a bounded sample of texts.
    """
    wide = counts.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0)).alias(c) for y, c in ((1, "p"), (0, "n"))])
    row = wide.where("term = ''").first()
    bad, good = (row.p, row.n) if row else (0, 0)
    if not bad or not good:
        return {f"={w}": KNOWN_WEIGHT for w in INSULTS}
    odds = F.log(((F.col("p") + 0.5) / F.lit(bad + 1.0)) / ((F.col("n") + 0.5) / F.lit(good + 1.0)))
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5) - F.lit(1 / (bad + 1) + 1 / (good + 1)))
    known = F.col("term").isin([f"={w}" for w in INSULTS])
    sure_burst = min(sure, max(sure_few, sure_few + 0.5 * math.log10(bad / 10)))
    sure_of = F.when(F.col("term").startswith("*"), F.lit(sure_burst)).otherwise(F.lit(sure))
    found = wide.where("term != ''").withColumns({"odds": odds, "error": error}).where((F.col("odds") - sure_of * F.col("error") >= least) | known).collect()
    out = {f"={w}": KNOWN_WEIGHT for w in INSULTS}
    for r in found:
        if r.term in out and r.odds + sure * r.error < 0:
            del out[r.term]
        elif r.term not in out or r.odds - sure * r.error >= least:
            out[r.term] = max(r.odds, out.get(r.term, 0.0))
    return out


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, stem: int = 5, holding_out: bool = True) -> Grammar:
    """Fits the grammar on about ``sample_rows`` labelled documents at most, taken by a hash of their ids: the one bound.

    With ``holding_out``, rows whose crc32(doc_id as text) mod 5 is 0 are never read. All texts of the sample are read whole. A term
    joins the lexicon by ``lexicon``'s rule; the layer is fitted to the same texts. Labels that are null or disagree count as the
    largest label; repeated rows of a doc_id count each. Without labels of both kinds the known insults and a fixed layer are used.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id"))) if holding_out else marks
    marks = hashed_sample(marks, F.xxhash64("doc_id"), sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic")
    weights = lexicon(term_counts(rows, stem))
    stems = {t: w for t, w in weights.items() if t[0] not in "=*"}
    draft = Grammar({t[1:]: w for t, w in weights.items() if t[0] == "="}, stems, stem, UNTAUGHT, {t[1:]: w for t, w in weights.items() if t[0] == "*" and t[1:] not in stems})
    sent = docs.sparkSession.sparkContext.broadcast(draft)

    def make():
        clauses = Clauses(sent.value)
        return lambda texts: [[clauses.features(x) for x in texts]]

    seen = with_columns(rows, "text", [T.StructField("f", T.ArrayType(T.DoubleType()))], make, ["toxic"])
    seen = seen.groupBy("toxic", "f").count().toPandas().sort_values(["toxic", "count"], kind="stable")
    if seen["toxic"].nunique() < 2:
        return draft
    order = np.lexsort(np.vstack([np.stack(seen["f"].to_numpy()).T, seen["toxic"].to_numpy()]))
    seen = seen.iloc[order]
    layer = fit_logistic(np.stack(seen["f"].to_numpy()), seen["toxic"].to_numpy(dtype=float), seen["count"].to_numpy(dtype=float))
    return Grammar(draft.words, draft.stems, stem, layer, draft.bursts)


def score(docs: DataFrame, grammar: Grammar, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every whole text.

    Only the text is read. Null and empty texts match nothing and get the score of the intercept; an empty table stays empty. Rows
    are independent, so ties, repeats and hot groups don't matter. Columns named as the results are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(grammar)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        clauses = Clauses(sent.value)
        w = sent.value.layer

        def work(texts: list[str]) -> list[list]:
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + sum(a * b for a, b in zip(w[1:], clauses.features(x), strict=True)))))) for x in texts]
            return [scores, [int(s >= 0.5) for s in scores]]

        return work

    return with_columns(docs, text, fields, make, keep)


def clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of ``docs`` that score under 0.5; all columns as they are, whatever their names."""
    (marked,) = fresh(docs, "_toxic")
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def make():
        clauses = Clauses(sent.value)
        w = sent.value.layer
        return lambda texts: [[w[0] + sum(a * b for a, b in zip(w[1:], clauses.features(x), strict=True)) >= 0 for x in texts]]

    return with_columns(docs, "text", [T.StructField(marked, T.BooleanType())], make).where(~F.col(marked)).select(docs.columns)
