"""Toxicity by a weighted finite-state grammar whose words and weights are learned from labels."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:,\n]+")
STEMS = (4, 5, 6)
#: A classifier may be fitted on a bounded sample: so many labelled documents at most.
SAMPLE_ROWS = 20_000
#: Evidence (likelihood ratio) from which a word or stem can enter the lexicon.
LEAST_EVIDENCE = 15.0

# Closed word classes of the grammar.
TARGETS = frozenset("you your yours u they them he she we vous tu toi ton ta tes ils elle du dich dir ihr euch sie tú ti usted ustedes ellos".split())
NEGATIONS = frozenset("not never no isn aren don doesn didn won pas jamais ni nicht kein keine nie nunca jamás tampoco".split())
REPORTS = frozenset("said says say claimed wrote quoted according called dit disait selon écrit sagte sagt laut schrieb dijo dice según escribió".split())
COPULAS = frozenset("are is am be re es est sont suis êtes bist ist seid sind sein eres son soy sois".split())
INTENTS = frozenset("will gonna going shall ll must want wanna vais va vas vont allons werde werden wird wirst will voy vas vamos van".split())
VERBS = frozenset("kill hurt destroy burn shoot stab punch die tuer frapper brûler töten schlagen verbrennen matar golpear quemar".split())

#: What the composed grammar gives out for an insult or a threat, and for the patterns of several words.
MARKS = tuple(f"{what}{how}" for what in ("insult", "threat") for how in ("", "+target", "-negated", "-reported"))
PATTERNS = ("abuse", "menace")
MEANT = {"abuse": "insult", "menace": "threat"}


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer over word classes: (state, class) -> (state, class given out)."""

    arcs: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        """A class without an arc of its own passes unchanged."""
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        return self.arcs[state, "*"][0] if (state, "*") in self.arcs else state, symbol


def within(trigger: str, reach: int, suffix: str) -> Transducer:
    """Gives insults and threats the suffix for ``reach`` words after a trigger (0: to the clause's end)."""
    arcs: dict[tuple[int, str], tuple[int, str]] = {(0, trigger): (max(reach, 1), trigger)}
    for state in range(1, max(reach, 1) + 1):
        after = state - 1 if reach else state
        arcs[state, trigger] = (max(reach, 1), trigger)
        arcs[state, "*"] = (after, "")
        for what in ("insult", "threat", *PATTERNS):
            arcs[state, what] = (after, what + suffix)
    return Transducer(arcs)


def insults(reach: int = 3) -> Transducer:
    """Target, copula and insult ("you are such an idiot"), or target and insult side by side ("you idiot"), give abuse; a lone insult stays one.

    States: 0, 1 to ``reach`` after a target, and as many after its copula, each counting down.
    """
    arcs: dict[tuple[int, str], tuple[int, str]] = {(0, "target"): (reach, "target")}
    for left in range(1, reach + 1):
        after_target, after_copula = left, reach + left
        arcs[after_target, "target"] = arcs[after_copula, "target"] = (reach, "target")
        arcs[after_target, "copula"] = arcs[after_copula, "copula"] = (2 * reach, "copula")
        arcs[after_target, "*"] = (left - 1, "")
        arcs[after_copula, "*"] = (reach + left - 1 if left > 1 else 0, "")
        arcs[after_copula, "insult"] = (reach + left - 1 if left > 1 else 0, "abuse")
    arcs[reach, "insult"] = (0, "abuse")
    return Transducer(arcs)


def threats(reach: int = 3) -> Transducer:
    """A harmful verb is a threat; intent, verb and target ("going to kill all of you") give a menace at the target.

    States: 0, 1 to ``reach`` after an intent, and as many after its verb.
    """
    arcs: dict[tuple[int, str], tuple[int, str]] = {(0, "intent"): (reach, "intent"), (0, "verb"): (0, "threat")}
    for left in range(1, reach + 1):
        after_intent, after_verb = left, reach + left
        arcs[after_intent, "intent"] = arcs[after_verb, "intent"] = (reach, "intent")
        arcs[after_intent, "verb"] = arcs[after_verb, "verb"] = (2 * reach, "threat")
        arcs[after_intent, "*"] = (left - 1, "")
        arcs[after_verb, "*"] = (reach + left - 1 if left > 1 else 0, "")
        arcs[after_verb, "target"] = (0, "menace")
    return Transducer(arcs)


def compose(first: dict, second: Transducer, symbols: list[str]) -> dict:
    """The machine that feeds what ``first`` gives out to ``second``, over pairs of their states."""
    start = first["start"] if first else ()
    table: dict = {}
    todo, seen = [(start, 0)], {(start, 0)}
    while todo:
        one, two = todo.pop()
        for symbol in symbols:
            state, out = first["arcs"][one, symbol] if first else ((), symbol)
            after, given = second.step(two, out)
            table[(one, two), symbol] = ((state, after), given)
            if (state, after) not in seen:
                seen.add((state, after))
                todo.append((state, after))
    return {"start": (start, 0), "arcs": table}


def grammar() -> dict:
    """Insult, threat, negation, reported-speech and target transducers composed, states numbered."""
    symbols = ["word", "insult", "verb", "target", "negation", "report", "copula", "intent"]
    machine: dict = {}
    for part in (insults(), threats(), within("negation", 3, "-negated"), within("report", 0, "-reported"), within("target", 4, "+target")):
        machine = compose(machine, part, symbols)
    number = {state: i for i, state in enumerate(dict.fromkeys([machine["start"], *(s for s, _ in machine["arcs"])]))}
    return {(number[s], c): (number[t], out) for (s, c), (t, out) in machine["arcs"].items()}


GRAMMAR = grammar()
CLASSES = {**{w: ("copula", 0.0) for w in COPULAS}, **{w: ("intent", 0.0) for w in INTENTS}, **{w: ("verb", 1.0) for w in VERBS}, **{w: ("report", 0.0) for w in REPORTS}, **{w: ("negation", 0.0) for w in NEGATIONS}, **{w: ("target", 0.0) for w in TARGETS}}


def candidates(words: list[str]) -> Counter:
    """Words and stems of a text with their counts; a stem ends in a star."""
    out: Counter = Counter(words)
    for word, n in list(out.items()):
        for size in STEMS:
            if len(word) > size:
                out[word[:size] + "*"] += n
    return out


@dataclass
class Model:
    """Lexicon weights, feature scaling and logistic weights."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    bias: float = -10.0
    known: dict[str, tuple[str, float] | None] = field(default_factory=dict)

    def look(self, word: str) -> tuple[str, float] | None:
        """The lexicon transducer's arc of a word; answers are remembered, in bounded number."""
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) > 300_000:
                self.known.clear()
            weight = max((self.lexicon[k] for k in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)) if k in self.lexicon), default=0.0)
            arc = self.known[word] = ("insult", weight) if weight else CLASSES.get(word)
            return arc

    def features(self, text: str | None) -> np.ndarray:
        """Weighted marks of the matched clauses, how many matched, and how dense they are."""
        lowered = (text or "").lower()
        words = WORD.findall(lowered)
        look = self.look
        out = np.zeros(len(MARKS) + len(PATTERNS) + 4)
        if not any((arc := look(w)) and arc[1] for w in words):
            return out
        clauses, hits, distinct = 0, 0, set()
        for clause in CLAUSE.split(lowered):
            inside = [(w, look(w)) for w in WORD.findall(clause)]
            if not any(arc and arc[1] for _, arc in inside):
                continue
            clauses += 1
            state = 0
            for word, arc in inside:
                symbol, weight = arc or ("word", 0.0)
                state, given = GRAMMAR[state, symbol]
                if weight:
                    hits += 1
                    distinct.add(word)
                    out[_mark(given)] += weight
                if given in FINAL:
                    out[len(MARKS) + FINAL[given]] += weight or 1.0
        out[-4:] = clauses, hits, len(distinct), 100 * hits / max(1, len(words))
        return np.log1p(out)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), 1 / (1 + math.exp(-self.bias)))
        z = (features - self.centre) / self.spread @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Patterns that are neither negated nor reported.
FINAL = {pattern + how: place for place, pattern in enumerate(PATTERNS) for how in ("", "+target")}


def _mark(given: str) -> int:
    """The place of what came out; negation counts before report, and report before target."""
    what = MEANT.get(re.split("[-+]", given)[0], given[:6])
    for how in ("-negated", "-reported", "+target"):
        if how in given:
            return MARKS.index(what + how)
    return MARKS.index(what)


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5))


def training_rows(documents: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """``text, toxic`` of labelled documents outside the held-out fold, ``sample_rows`` at most, taken by a hash of the id."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = marks.where(place < F.lit(int(1_000_000 * min(1.0, sample_rows / max(n, 1)))))
    return documents.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic")


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon by evidence, weights by penalised logistic regression; without labelled rows nothing is toxic."""
    rows = training_rows(documents, labels, sample_rows).checkpoint(eager=True)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    model = Model()
    if not pos + neg:
        return model
    model.bias = math.log((pos + 0.5) / (neg + 0.5))
    if not pos or not neg:
        return model
    lexicon = _lexicon(rows, pos, neg)
    model.lexicon = lexicon
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(lexicon)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(held.value)
        for batch in batches:
            values = [own.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(values, pa.list_(pa.float64()))], ["toxic", "x"])

    # the sample's bound is the bound of what is collected
    seen = rows.mapInArrow(featured, "toxic int, x array<double>").groupBy("toxic", "x").count().collect()
    x, y, n = np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float), np.array([r["count"] for r in seen], float)
    model.centre, model.spread = np.average(x, 0, n), np.sqrt(np.average((x - np.average(x, 0, n)) ** 2, 0, n)) + 1e-9
    model.spread[model.spread < 1e-6] = 1.0
    model.weights, model.bias = _logistic((x - model.centre) / model.spread, y, n)
    _ordered(model)
    return model


def _ordered(model: Model) -> None:
    """What is known beforehand: with a target a mark weighs no less than without one, and a pattern adds to its words.

    The labels may hold too few such clauses to say so.
    """
    slope = model.weights / model.spread
    most = max(slope[MARKS.index("insult")], slope[MARKS.index("threat")], 0.0)
    for what, pattern in (("insult", "abuse"), ("threat", "menace")):
        plain, aimed = MARKS.index(what), MARKS.index(what + "+target")
        slope[aimed] = max(slope[aimed], slope[plain])
        place = len(MARKS) + PATTERNS.index(pattern)
        slope[place] = max(slope[place], 0.25 * most)
    model.weights = slope * model.spread


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method for penalised logistic regression on counted rows."""
    design = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(design.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (n * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _lexicon(rows: DataFrame, pos: int, neg: int) -> dict[str, float]:
    """Words and stems, each needed to explain toxic documents that stronger ones leave unexplained.

    Their evidence is counted on documents that hold them, or hold them twice or more. All that
    have enough evidence take part; the sample's bound is the bound of their number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for key, n in candidates(WORD.findall((text or "").lower())).items():
                    cell = seen[key]
                    cell[toxic] += 1
                    if n > 1:
                        cell[2 + toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in range(4))], ["key", "n0", "n1", "m0", "m1"])

    counts = rows.mapInArrow(count, "key string, n0 long, n1 long, m0 long, m1 long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "m0", "m1"))).where("n1 >= 3")
    top = counts.select("key", _evidence("n1", "n0", pos, neg).alias("once"), _evidence("m1", "m0", pos, neg).alias("twice"), "n0", "n1", "m0", "m1")
    top = top.withColumn("best", F.greatest("once", "twice")).where(F.col("best") >= LEAST_EVIDENCE).orderBy(F.desc("best"), "key").collect()
    if not top:
        return {}
    need = {r["key"]: 1 if r["once"] >= r["twice"] else 2 for r in top}
    held = rows.sparkSession.sparkContext.broadcast(need)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = held.value
        for batch in batches:
            values = [[k for k, n in candidates(WORD.findall((t or "").lower())).items() if n >= least.get(k, 1 << 60)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.string()))], ["keys"])

    explained: dict[str, set[int]] = defaultdict(set)
    for i, r in enumerate(rows.where("toxic = 1").mapInArrow(holders, "keys array<string>").collect()):
        for key in r["keys"]:
            explained[key].add(i)
    lexicon: dict[str, float] = {}
    done: set[int] = set()
    for r in top:
        key = r["key"]
        whole_word_of_stem = any(key[:n] + "*" in lexicon for n in STEMS)
        if len(explained[key] - done) >= 2 and not whole_word_of_stem:
            ratio = (r["n1"] + 0.5) / (pos + 1) / ((r["n0"] + 0.5) / (neg + 1))
            if ratio > 2:
                lexicon[key] = math.log(ratio)
                done |= explained[key]
        elif r["n0"] == 0 and r["once"] >= 2 * LEAST_EVIDENCE and not whole_word_of_stem:
            lexicon[key] = math.log((r["n1"] + 0.5) / (pos + 1) / (0.5 / (neg + 1)))
    return lexicon


def _evidence(toxic: str, clean: str, pos: int, neg: int) -> Column:
    """Likelihood ratio of a word's holders being toxic more often than all documents are."""
    a, b = F.col(toxic).cast("double"), F.col(clean).cast("double")
    expect_a, expect_b = (a + b) * (pos / (pos + neg)), (a + b) * (neg / (pos + neg))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return F.when(a > expect_a, 2 * (part(a, expect_a) + part(b, expect_b))).otherwise(0.0)


def scores(documents: DataFrame, model: Model, *kept: str) -> DataFrame:
    """The kept columns and ``score`` for every document, whatever its other columns are.

    A null or empty text has no matched clause and the score that goes with none; nulls in
    other columns change nothing; repeated rows get equal scores; no rows give no rows.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("text").alias("text"), *kept)
    names = list(kept)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            x = [own.features(t) for t in batch.column(0).to_pylist()]
            score = own.score(np.array(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(names))), pa.array(score)], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(judge, f"{schema}, score double")


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored below the threshold, with all their columns.

    A null or empty text has no matched clause and scores as such; null ids stay; repeated rows
    fare alike; no rows give no rows; other columns are not looked at, whatever their names.
    """
    model = train(documents, labels)
    held = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            x = [own.features(t) for t in batch.column(place).to_pylist()]
            if x:
                yield batch.filter(pa.array(own.score(np.array(x)) < threshold))

    return documents.mapInArrow(keep, documents.schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, verdict and fold of every document."""
    scored = scores(documents, train(documents, labels), "doc_id")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
