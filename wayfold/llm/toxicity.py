"""Toxicity by a weighted finite-state pattern grammar over clauses.

Each word of a clause becomes a symbol: a strong, medium or doubtful insult, a
target, possessive, linking verb, negation, speaker, intent, threatening or
figurative verb, place, preposition, reporting verb, mention or other. Six
machines read these symbols, each a table of weighted arcs, letter for letter:
negation rewrites the insults and threats in its reach to harmless symbols,
reported speech and mention (a clause about words: "the term idiot is an
insult") end a clause with a discount, and the insult, target and threat
machines, united, match a clause by one of their paths. They are composed once
into one machine. A clause scores its best path: an insult aimed at a target,
several insults together, a bare insult, or an intent with a threatening verb
and a target. Doubtful words (they have a plain sense too) need a target just
before them or a linking verb; bare ones count only where training found them,
weigh less, make no pair among themselves, and count once a text each, as a
text about clowns or trash repeats its subject. A document's score is
the logistic of its best clause and the logarithm of what its other clauses
add; arcs are bounded such that one clause with a single bare insult stays
below the cut, as do two with bare doubtful words; two with other insults or
an aimed one do not.

The model is learned on labelled training texts. Insult words and stems are
those that a large share of their texts is toxic for, strong or medium by their
log odds; a first fit on one half of the texts finds on the other half the log
odds of every kind of path, which become the arcs' weights inside their bounds.
At most ``max_labelled`` labelled rows (the smallest id hashes) are used, a
documented bound. Texts of one label that share the smallest hash of their
three-word windows are compared with one of them; those at MIN_SIMILARITY to it
are left out, so that a copied text's rare words do not look like evidence.
Texts that merely share a passage all count.

Null and empty texts, and texts without a match, score the bias alone. Repeated
rows score each; null ids are never held out nor trained on; ids labelled twice
are toxic if any row says so. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import let, materialize, words_of

MAX_LABELLED = 40_000
#: A learned word or stem needs so many toxic texts and such a share of them among its texts.
MIN_SUPPORT, MIN_SHARE = 5, 0.85
STEMS, STEM_SHARE, STEM_SUPPORT = (7, 5), 0.9, 8
#: And such a share of all toxic texts, so that chance finds do not grow in number with the training table.
MIN_RATE = 0.01
#: Log odds from which a learned word is a strong insult.
STRONG = 5.0
#: Of three-word windows, from which two training texts count as copies.
MIN_SIMILARITY = 0.8
BIAS, REPEATS, REPORTED, MENTIONED = -4.5, 1.5, -3.0, -5.0
#: Lowest and highest weight of a path by its kind; one bare insult must stay under logit(0.7) - BIAS = 5.35.
BOUNDS = {"bare_doubtful": (3.0, 4.0), "bare_strong": (4.4, 5.0), "bare_medium": (3.4, 4.4), "chain_strong": (5.8, 7.0), "chain_medium": (4.8, 6.2), "aimed_strong": (6.2, 7.5), "aimed_medium": (5.6, 7.0), "aimed_doubtful": (5.6, 6.6), "threat": (6.0, 7.5)}

# Seed words of the grammar's classes.
SEEDS = "idiot idiots moron morons imbecile scum loser bastard bitch asshole idiota estúpido estúpida imbécil idiotin trottel abschaum connard salaud abruti".split()
DOUBTFUL = "losers clown clowns stupid dumb trash garbage filth filthy vermin worthless pathetic disgusting basura dumm ordure".split()
CLASSES = {
    "T": "you yourself u he she they them him tú usted ustedes du dich euch sie tu toi vous".split(),
    "Y": "your her his their dein deine euer eure ton ta votre vos".split(),
    "L": "are is am be being was were 're eres es son bist ist sind est êtes sont you're they're he's she's".split(),
    "N": "not never no isn't aren't ain't wasn't weren't don't won't nicht kein keine nunca pas jamais".split(),
    "R": "said says wrote writes claimed called reported quoted dijo sagte schrieb dit écrit according".split(),
    "P": "i we ich wir yo je nous".split(),
    "J": "i'll we'll i'm voy vamos".split(),
    "X": "will gonna going shall must should werde werden vais allons".split(),
    "H": "kill strangle murder stab shoot matar töten umbringen tuer".split(),
    "W": "hurt destroy beat burn crush".split(),
    "G": "at in on during by".split(),
    "V": "with for from about without".split(),
    "M": "word words term terms insult insults slur slurs dictionary synonym synonyms wort wörter schimpfwort schimpfwörter wörterbuch palabra palabras insulto insultos diccionario mot mots insulte insultes dictionnaire".split(),
}
#: Targets written in one word with their linking verb count as the target.
AIMED_LINKS = frozenset("you're they're he's she's".split())

#: O other; I, K, D, A strong, medium, doubtful but learned, and doubtful insults; lower case is what negation leaves of them.
ALPHABET = "OTYLNRPJXHWGVMIKDAikdahw"
INSULTS = "IKDA"
NEGATED = str.maketrans("IKDAHW", "ikdahw")
REACH = 4

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
CLAUSE = re.compile(r"[^.!?;\n]+")


class Machine(NamedTuple):
    """Arcs (state, symbol) -> [(symbol out, weight, state)], and the end weights of final states. All starts are 0."""

    arcs: dict[tuple, list[tuple]]
    finals: dict[object, float]

    def best(self, symbols: str) -> tuple[float, object] | None:
        """Weight and last state of the best path; ties to the smaller state. None without a path."""
        now = {0: 0.0}
        for s in symbols:
            after: dict[object, float] = {}
            for state, total in now.items():
                for _, weight, to in self.arcs.get((state, s), ()):
                    if after.get(to, -math.inf) < total + weight:
                        after[to] = total + weight
            now = after
        ends = [(total + self.finals[state], state) for state, total in now.items() if state in self.finals]
        return min(ends, key=lambda e: (-e[0], str(e[1])), default=None)


class Builder:
    """Arcs of one machine as they are drawn."""

    def __init__(self):
        self.arcs: dict[tuple, list[tuple]] = defaultdict(list)
        self.finals: dict[object, float] = {}

    def arc(self, state, symbols: str, to, weight: float = 0.0, out: str | None = None) -> None:
        for s in symbols:
            self.arcs[state, s].append((out or s, weight, to))

    def window(self, state: str, symbols: str, places: int) -> None:
        """state1 to state(places), each of these symbols moving one on; what comes later falls out."""
        for k in range(1, places):
            self.arc(f"{state}{k}", symbols, f"{state}{k + 1}")

    def made(self) -> Machine:
        return Machine(dict(self.arcs), self.finals)


def without(symbols: str) -> str:
    return "".join(s for s in ALPHABET if s not in symbols)


def negation() -> Machine:
    """Rewrites insults and threatening verbs within REACH words after a negation."""
    b = Builder()
    for k in range(REACH + 1):
        b.arc(k, "N", REACH)
        for s in without("N"):
            b.arc(k, s, max(0, k - 1), 0.0, s.translate(NEGATED) if k else s)
        b.finals[k] = 0.0
    return b.made()


def reported_speech() -> Machine:
    """A discount at the end of a clause that someone else is said to have said."""
    b = Builder()
    for state in (0, "own"):
        b.arc(state, "PJ", "own")
        b.arc(state, without("PJR"), 0)
        b.finals[state] = 0.0
    b.arc(0, "R", "told")
    b.arc("own", "R", 0)
    b.arc("told", ALPHABET, "told")
    b.finals["told"] = REPORTED
    return b.made()


def mention() -> Machine:
    """A discount at the end of a clause that is about words."""
    b = Builder()
    b.arc(0, without("M"), 0)
    b.arc(0, "M", "mentioned")
    b.arc("mentioned", ALPHABET, "mentioned")
    b.finals |= {0: 0.0, "mentioned": MENTIONED}
    return b.made()


def insults(weights: dict[str, float]) -> Machine:
    """Bare insults and several in one clause."""
    b = Builder()
    b.arc(0, ALPHABET, 0)
    for symbol, name in (("I", "strong"), ("K", "medium"), ("D", "doubtful")):
        bare = f"bare_{name}"
        b.arc(0, symbol, bare, weights[bare])
        b.arc(bare, "IDK" if name == "strong" else "I", "chain_strong", weights["chain_strong"] - weights[bare])
    b.arc("bare_medium", "KD", "chain_medium", weights["chain_medium"] - weights["bare_medium"])
    b.arc("bare_doubtful", "K", "chain_medium", weights["chain_medium"] - weights["bare_doubtful"])
    for end in ("bare_strong", "bare_medium", "bare_doubtful", "chain_strong", "chain_medium"):
        b.arc(end, ALPHABET, end)
        b.finals[end] = 0.0
    return b.made()


def targets(weights: dict[str, float]) -> Machine:
    """Insults with a target shortly before them, or right after."""
    b = Builder()
    b.arc(0, ALPHABET, 0)
    b.arc(0, "T", "near1")
    b.arc(0, "Y", "near2")  # a possessive aims at what follows, but no doubtful word
    b.window("near", without(INSULTS), 5)
    # Doubtful words need the target just before, or a linking verb between.
    b.arc("near1", "L", "linked1")
    b.window("linked", without(INSULTS + "TYPG"), 4)
    for state in ("near1", "linked1", "linked2", "linked3", "linked4"):
        b.arc(state, "AD", "aimed_doubtful", weights["aimed_doubtful"])
    for symbol, name in (("I", "strong"), ("K", "medium")):
        end = f"aimed_{name}"
        for state in ("near1", "near2", "near3", "near4", "near5"):
            b.arc(state, symbol, end, weights[end])
        b.arc(0, symbol, f"after{symbol}1")
        b.window(f"after{symbol}", without(INSULTS + "TYPG"), 3)
        for k in (1, 2, 3):
            b.arc(f"after{symbol}{k}", "T", end, weights[end])
    for end in ("aimed_strong", "aimed_medium", "aimed_doubtful"):
        b.arc(end, ALPHABET, end)
        b.finals[end] = 0.0
    return b.made()


def threats(weights: dict[str, float]) -> Machine:
    """An intent, a threatening verb and a target; figurative verbs need a speaker and no place that follows."""
    b = Builder()
    b.arc(0, ALPHABET, 0)
    b.arc(0, "P", "speaker1")
    b.window("speaker", "OLNRGV", 3)
    for k in (1, 2, 3):
        b.arc(f"speaker{k}", "X", "own1")
    b.arc(0, "J", "own1")
    b.arc(0, "X", "intent1")
    for state in ("own", "intent"):
        b.window(state, "OLXGV", 4)
        for k in (1, 2, 3, 4):
            b.arc(f"{state}{k}", "H", "deed1")
            if state == "own":
                b.arc(f"{state}{k}", "W", "figure1")
    b.window("deed", "OLP", 4)
    b.window("figure", "OLP", 4)
    for k in (1, 2, 3, 4):
        b.arc(f"deed{k}", "T", "threat", weights["threat"])
        b.arc(f"figure{k}", "T", "figured", weights["threat"])
    b.arc("figured", without("G"), "threat")
    b.arc("threat", ALPHABET, "threat")
    b.finals |= {"threat": 0.0, "figured": 0.0}
    return b.made()


def union(*machines: Machine) -> Machine:
    """Any of the machines; other states than the start are told apart by their machine's number."""
    b = Builder()
    for n, m in enumerate(machines):
        for (state, s), out in m.arcs.items():
            for o, weight, to in out:
                b.arcs[(n, state), s].append((o, weight, (n, to)))
                if state == 0:
                    b.arcs[0, s].append((o, weight, (n, to)))
        b.finals |= {(n, state): w for state, w in m.finals.items()}
    return b.made()


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that reads what first reads and gives what second makes of its output."""
    arcs, finals, seen, todo = {}, {}, {(0, 0)}, [(0, 0)]
    name = lambda a, b: 0 if (a, b) == (0, 0) else (a, b)
    while todo:
        a, b = todo.pop()
        if a in first.finals and b in second.finals:
            finals[name(a, b)] = first.finals[a] + second.finals[b]
        for s in ALPHABET:
            made = [
                (out, w1 + w2, (a2, b2))
                for middle, w1, a2 in first.arcs.get((a, s), ())
                for out, w2, b2 in second.arcs.get((b, middle), ())
            ]
            if made:
                arcs[name(a, b), s] = [(out, w, name(*to)) for out, w, to in made]
            for _, _, to in made:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
    return Machine(arcs, finals)


def kind_of(state) -> str:
    """The kind of path that a last state of the composed machine stands for."""
    while isinstance(state, tuple):
        state = state[-1]
    return "threat" if state == "figured" else state


class Model(NamedTuple):
    """Learned insults (word or stem with a trailing *, to I or K) and the weights of paths by kind."""

    words: dict[str, str]
    weights: dict[str, float]


def default_model(words: dict[str, str] | None = None) -> Model:
    return Model(words or {}, {k: (low + high) / 2 for k, (low, high) in BOUNDS.items()})


class Grammar:
    """The composed machines for one model."""

    def __init__(self, model: Model):
        self.machine = compose(negation(), compose(reported_speech(), compose(mention(), union(insults(model.weights), targets(model.weights), threats(model.weights)))))
        self.symbols = {w: s for s, listed in CLASSES.items() for w in listed}
        self.symbols |= dict.fromkeys(AIMED_LINKS, "T") | dict.fromkeys(DOUBTFUL, "A") | dict.fromkeys(SEEDS, "I")
        learned = {w: s for w, s in model.words.items() if not w.endswith("*")}
        self.symbols |= {w: "D" if w in DOUBTFUL else s for w, s in learned.items() if self.symbols.get(w, "A") in "AI"}
        self.stems = {w[:-1]: s for w, s in model.words.items() if w.endswith("*")}
        self.known: dict[str, tuple[float, str]] = {}

    def symbol(self, word: str) -> str:
        found = self.symbols.get(word)
        if found is None and self.stems:
            found = next((self.stems[word[:n]] for n in STEMS if len(word) > n and word[:n] in self.stems), None)
        return found or "O"

    def clause(self, words: list[str], seen: set[str]) -> tuple[float, str]:
        """Weight and kind of the best path through a clause; (0, none) without one or where it is no evidence.

        Doubtful words in seen no longer count bare; those of this clause join it.
        """
        symbols = "".join(map(self.symbol, words))
        if "D" in symbols:
            marked = list(symbols)
            for i, word in enumerate(words):
                if marked[i] == "D":
                    marked[i] = "A" if word in seen else "D"
                    seen.add(word)
            symbols = "".join(marked)
        if not any(s in symbols for s in INSULTS + "HW"):
            return 0.0, "none"  # every path of the matching machines needs one of these
        if symbols not in self.known:
            found = self.machine.best(symbols)
            result = (found[0], kind_of(found[1])) if found and found[0] > 0 else (0.0, "none")
            if len(self.known) < 1 << 16 and len(symbols) < 64:
                self.known[symbols] = result
            return result
        return self.known[symbols]

    def matches(self, text: str | None) -> list[tuple[float, str]]:
        parts = CLAUSE.findall((text or "").lower().replace("’", "'"))
        seen: set[str] = set()
        return [m for part in parts if (m := self.clause(WORD.findall(part), seen))[0]]

    def score(self, text: str | None) -> float:
        found = [weight for weight, _ in self.matches(text)]
        logit = BIAS
        if found:
            top = max(found)
            logit += top + REPEATS * math.log1p(sum(found) / top - 1.0)
        return 1.0 / (1.0 + math.exp(-logit))

    def kind(self, text: str | None) -> str:
        """The kind of the text's best path."""
        return max(self.matches(text), default=(0.0, "none"))[1]


def distinct_evidence(texts: DataFrame) -> DataFrame:
    """(__y, __text) without the verified near copies of another text of the same label."""
    texts = materialize(texts.distinct(), "labelled-texts")
    windows = lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    texts = texts.withColumn("__grams", F.array_distinct(let(words_of(F.col("__text")), windows)))
    texts = texts.withColumn("__sketch", F.coalesce(F.array_min("__grams"), F.lit(0)))
    first = texts.groupBy("__sketch", "__y").agg(F.max_by(F.struct("__text", "__grams"), "__text").alias("__r"))
    both = F.size(F.array_intersect("__grams", "__r.__grams"))
    alike = both >= F.lit(MIN_SIMILARITY) * (F.size("__grams") + F.size("__r.__grams") - both)
    return texts.join(first, ["__sketch", "__y"]).where((F.col("__text") == F.col("__r.__text")) | ~alike).select("__y", "__text")


def insult_words(texts: DataFrame, part: Column) -> tuple[dict[str, str], dict[str, str]]:
    """Words and stems that the support and share of toxic texts show to be insults, each strong (I) or medium (K).

    Once over all texts and once over a part of them; both come from one count.
    """
    sums = lambda y: [F.count("*").alias("n"), F.sum(y).alias("t"), F.count_if("__p").alias("n0"), F.coalesce(F.sum(F.when(F.col("__p"), F.col(y))), F.lit(0)).alias("t0")]
    texts = texts.withColumn("__p", part)
    total = texts.agg(*sums("__y")).first()
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.lower("__text"), "’", "'"), F.lit(r"([\p{L}\p{Nd}]+(?:'[\p{L}\p{Nd}]+)*)"), F.lit(1)))
    stem = lambda n: F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))
    stems = F.array_distinct(F.concat(*(stem(n) for n in STEMS)))
    counted = texts.select("__y", "__p", F.explode(F.concat(words, stems)).alias("w")).groupBy("w").agg(*sums("__y"))

    def enough(n: str, t: str, whole: int | None) -> Column:
        reach = lambda support, share: (F.col(t) >= max(support, MIN_RATE * (whole or 0))) & (F.col(t) >= share * F.col(n))
        return F.when(F.col("w").endswith("*"), reach(STEM_SUPPORT, STEM_SHARE)).otherwise(reach(MIN_SUPPORT, MIN_SHARE))

    kinds = (("n", "t", total.n, total.t), ("n0", "t0", total.n0, total.t0))
    marked = counted.select("*", *(enough(n, t, whole).alias(f"ok_{n}") for n, t, _, whole in kinds)).where("ok_n or ok_n0")
    found: tuple[dict[str, str], dict[str, str]] = ({}, {})
    for row in marked.orderBy("w").collect():
        for out, (n, t, size, toxic) in zip(found, kinds, strict=True):
            if row[f"ok_{n}"] and toxic < size:  # without clean texts nothing tells insults from other words
                odds = math.log((row[t] + 0.5) / (row[n] - row[t] + 0.5)) - math.log(toxic / (size - toxic))
                out[row.w] = "I" if odds >= STRONG else "K"
    return found


def path_weights(texts: DataFrame, model: Model) -> dict[str, float]:
    """Log odds of each kind of best path over texts that the model's words were not learned from, inside BOUNDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grammar.kind(x.as_py()) for x in batch.column(1)], pa.string())], ["y", "kind"])

    kinds = texts.select(F.col("__y").cast("long"), "__text").mapInArrow(run, "y long, kind string")
    counts = {r.kind: (r.n, r.t) for r in kinds.groupBy("kind").agg(F.count("*").alias("n"), F.sum("y").alias("t")).collect()}
    out = dict(model.weights)
    for kind, (low, high) in BOUNDS.items():
        if kind in counts:
            n, t = counts[kind]
            out[kind] = round(min(high, max(low, math.log((t + 0.5) / (n - t + 0.5)) - BIAS)), 6)
    return out


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """The model. training is a condition on the label rows' doc_id."""
    known = (
        labels.where(F.col("toxic").isNotNull() & training).groupBy(F.col("doc_id").alias("__l")).agg(F.max("toxic").alias("__y"))
        .orderBy(F.xxhash64("__l"), "__l").limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("__text")).join(F.broadcast(known), F.col("__d") == F.col("__l"))
    texts = materialize(distinct_evidence(texts.select("__y", F.coalesce("__text", F.lit("")).alias("__text"))), "evidence")
    half = F.pmod(F.xxhash64("__text"), F.lit(2))
    words, first = insult_words(texts, half == 0)
    return Model(words, path_weights(texts.where(half == 1), default_model(first)))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    plain = tuple(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(Model(*plain))
        for batch in batches:
            scores = [grammar.score(x.as_py()) for x in batch.column(1)]
            hits = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
