"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and a clause into words; a lexicon turns words into
symbols: insult, threat, target, negation, report or other.  Transducers then
rewrite the symbol string of the clause:

* negation: an insult or threat within three words after a negation becomes
  its negated form;
* reported speech: after a word of saying, what follows in the clause is
  reported;
* target: an insult or threat in a clause that has named a target before it is
  directed; a target right after it directs it as well.

The three are composed once into a single machine.  Its output events (kind,
negated, reported, directed) carry weights, and the score of a document
combines the weights of its matched clauses, not of isolated words.

What is learned, from labelled rows only: insult stems (word beginnings and
whole words that tell toxic from other documents, counted over all of those
rows) beside the fixed English list, and the weight of each event.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import sized, written

# fixed values: the grammar's English word lists
INSULTS = ("idiot idiots idiotic stupid moron morons moronic pathetic worthless clown clowns trash scum loser losers "
           "disgusting imbecile cretin dumbass bastard scumbag vermin").split()
THREATS = "kill murder hurt beat shoot stab strangle destroy hang burn".split()
TARGETS = "you your yours you're youre u he she they them him her his their".split()
NEGATIONS = "not never no isn't aren't wasn't weren't don't doesn't didn't neither nor without hardly".split()
REPORTS = "said says say wrote writes called calls quoted quotes reported reports claimed claims according".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITYNRW"

_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


# --- transducers -----------------------------------------------------------

@dataclass
class Transducer:
    """A sequential letter-to-letter transducer: ``step(state, symbol)`` gives
    the next state, the output symbol and the weight of the arc."""
    start: Hashable
    step: Callable[[Hashable, Hashable], tuple[Hashable, Hashable, float]]

    def compose(self, other: Transducer) -> Transducer:
        """Reads this one's input and writes the other's output: states are
        pairs, weights add up."""
        def step(state, symbol):
            a, middle, w = self.step(state[0], symbol)
            b, out, v = other.step(state[1], middle)
            return (a, b), out, w + v
        return Transducer((self.start, other.start), step)


@dataclass
class Machine:
    """A transducer expanded to an arc table over a finite alphabet."""
    arcs: list[dict] = field(default_factory=list)

    @classmethod
    def of(cls, t: Transducer, alphabet) -> Machine:
        number, todo, arcs = {t.start: 0}, [t.start], []
        for state in todo:                              # grows while it runs
            row = {}
            for symbol in alphabet:
                to, out, weight = t.step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row[symbol] = (number[to], out, weight)
            arcs.append(row)
        return cls(arcs)

    def run(self, symbols) -> Iterator[tuple[Hashable, float]]:
        state = 0
        for s in symbols:
            state, out, weight = self.arcs[state][s]
            yield out, weight


def _negation(reach: int = 3) -> Transducer:
    def step(left, symbol):
        if symbol == NEGATION:
            return reach, (symbol, False), 0.0
        hit = symbol in (INSULT, THREAT)
        return (max(0, left - 1), (symbol, hit and left > 0), 0.0)
    return Transducer(0, step)


def _report() -> Transducer:
    def step(seen, symbol):
        kind, negated = symbol
        return (seen or kind == REPORT, (kind, negated, seen and kind in (INSULT, THREAT)), 0.0)
    return Transducer(False, step)


def _target() -> Transducer:
    """Emits, for an insult or threat, whether a target came before; a target
    right after one emits the directing event of that one."""
    def step(state, symbol):
        seen, last = state
        kind, negated, reported = symbol
        if kind in (INSULT, THREAT):
            event = (kind, negated, reported, seen)
            return (seen, event), event, 0.0
        if kind == TARGET:
            out = (*last[:3], True) if last and not last[3] else None
            return (True, None), out, 0.0
        return (seen, None), None, 0.0
    return Transducer((False, None), step)


def grammar() -> Machine:
    return Machine.of(_negation().compose(_report()).compose(_target()),
                      (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER))


EVENTS = [(k, n, r, d) for k in (INSULT, THREAT) for n in (False, True) for r in (False, True) for d in (False, True)]
_NAMES = {e: i for i, e in enumerate(EVENTS)}


# --- lexicon and document events -------------------------------------------

@dataclass
class Lexicon:
    words: dict[str, str]
    stems: frozenset[str]
    lengths: tuple[int, ...]

    @classmethod
    def of(cls, learned: list[str]) -> Lexicon:
        """Learned entries ending in ``$`` are whole words, others beginnings."""
        words = {w: s for s, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS),
                                    (INSULT, INSULTS)) for w in ws}
        words.update({w[:-1]: INSULT for w in learned if w.endswith("$") and w[:-1] not in words})
        stems = frozenset(w for w in learned if not w.endswith("$"))
        return cls(words, stems, tuple(sorted({len(s) for s in stems})))

    def symbol(self, word: str) -> str:
        s = self.words.get(word)
        if s:
            return s
        return INSULT if any(word[:n] in self.stems for n in self.lengths) else OTHER


def events(text: str | None, lexicon: Lexicon, machine: Machine) -> Counter:
    """The events of all clauses of a whole text."""
    found: Counter = Counter()
    if not text:
        return found
    low = text.lower()
    known = {w: s for w in set(_WORD.findall(low)) if (s := lexicon.symbol(w)) != OTHER}
    if INSULT not in known.values() and THREAT not in known.values():
        return found
    for clause in _CLAUSE.split(low):
        symbols = [known.get(w, OTHER) for w in _WORD.findall(clause)]
        if INSULT in symbols or THREAT in symbols:
            for out, _ in machine.run(symbols):
                if out:
                    found[out] += 1
    return found


# --- learning ----------------------------------------------------------------

STEM, LONGEST, SUPPORT, MAX_STEMS = 5, 12, 3, 5000


def _stems(text: Column) -> Column:
    """All distinct whole words (marked ``$``) and word beginnings of a text."""
    words = F.array_distinct(_words(text))
    starts = F.transform(words, lambda w: F.when(F.length(w) >= STEM, F.transform(
        F.sequence(F.lit(STEM), F.least(F.length(w), F.lit(LONGEST))), lambda n: F.substring(w, F.lit(1), n)))
        .otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(w, F.lit("$"))), F.flatten(starts)))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}']+"), "")


def learn_stems(train: DataFrame) -> list[str]:
    """Insult stems from ``train(doc_id, text, toxic)``: beginnings of STEM to
    LONGEST letters and whole words whose documents are toxic far more often
    than chance allows for the number of candidates tried.  Copies count once:
    one document per label and set of words, all others are counted.
    Candidates come from the toxic documents (SUPPORT of them at least) and are
    then looked for in all others.  At most MAX_STEMS, the strongest first,
    reach the driver."""
    same = F.xxhash64(F.array_sort(F.array_distinct(_words(F.col("text")))))
    one = written(train.select("doc_id", "toxic", same.alias("same")).groupBy("toxic", "same")
                  .agg(F.min("doc_id").alias("doc_id")), "toxic_unique")
    total = one.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total.t or total.t == total.n:
        return []
    base = total.t / total.n
    stems = (train.join(sized(one.select("doc_id"), 1_000_000), "doc_id", "left_semi")
             .select("toxic", F.explode(_stems(F.col("text"))).alias("stem")))
    often = written(stems.where("toxic = 1").groupBy("stem").agg(F.count(F.lit(1)).alias("t")).where(F.col("t") >= SUPPORT),
                    "toxic_stems")
    other = (stems.where("toxic = 0").join(sized(often.select("stem"), 1_000_000), "stem")
             .groupBy("stem").agg(F.count(F.lit(1)).alias("m")))
    tried = often.join(other, "stem", "left").select("stem", "t", (F.col("t") + F.coalesce("m", F.lit(0))).alias("n"))
    p = (F.col("t") + 0.5) / (F.col("n") + 1.0)
    gain = F.col("t") * F.log(p / base) + (F.col("n") - F.col("t")) * F.log((1 - p) / (1 - base))
    found = (tried.withColumn("gain", gain).where((F.col("gain") >= math.log(max(1, often.count())) + 5)
                                                  & (F.col("t") >= 0.9 * F.col("n")))
             .orderBy(F.desc("gain"), "stem").limit(MAX_STEMS).select("stem").collect())
    stems = {r.stem for r in found}
    return sorted(s for s in stems if not any(s.rstrip("$")[:n] in stems for n in range(STEM, len(s))))


@dataclass
class Model:
    stems: list[str]
    weights: list[float]                # per event: log(1 - precision)
    base: float                         # chance of a document without events

    def score(self, found: Counter) -> float:
        """Noisy-or over the events; each kind counts three times at most."""
        left = math.log1p(-self.base) + sum(self.weights[_NAMES[e]] * min(3, n) for e, n in found.items())
        return min(1.0, max(0.0, -math.expm1(left)))


# prior belief about an event: chance that its document is toxic, and the
# number of documents that belief is worth
_PRIOR = {e: (0.85 - 0.45 * e[1] - 0.25 * e[2] + 0.1 * (e[3] and not e[1] and not e[2]) - 0.3 * (e[0] == THREAT and not e[3])
              if e[0] == INSULT or e[3] else 0.05) for e in EVENTS}
_WORTH = 4.0


def fit(train: DataFrame) -> Model:
    """Fit on ``train(doc_id, text, toxic)`` (toxic 0 or 1).  Without labelled
    rows the priors and the fixed lists stand."""
    stems = learn_stems(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon.of(stems), grammar()
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for e in events(text.as_py(), lexicon, machine) or [None]:
                    seen[e] += 1
                    toxic[e] += y
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([_NAMES.get(e, -1) for e in keys], pa.int32()),
                                          pa.array([seen[e] for e in keys], pa.int64()),
                                          pa.array([toxic[e] for e in keys], pa.int64())], names=["event", "n", "t"])

    got = {r.event: (r.n, r.t) for r in
           train.select("text", "toxic").mapInArrow(run, "event int, n long, t long")
           .groupBy("event").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()}
    weights = []
    for i, e in enumerate(EVENTS):
        n, t = got.get(i, (0, 0))
        weights.append(math.log1p(-min(0.999, (t + _WORTH * max(0.01, _PRIOR[e])) / (n + _WORTH))))
    n, t = got.get(-1, (0, 0))
    return Model(stems, weights, min(0.4, (t + 0.1) / (n + 2.0)))


def labelled(docs: DataFrame, labels: DataFrame, usable=None) -> DataFrame:
    """doc_id, text, toxic of the labelled documents (of repeated labels the
    higher; null labels and ids teach nothing), among those where ``usable``
    (a condition on doc_id) holds."""
    y = (labels.where("doc_id is not null and toxic is not null")
         .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("long")).alias("toxic")))
    if usable is not None:
        y = y.where(usable)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.join(sized(written(y, "labels"), 1_000_000), "doc_id")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and n_events per row, from the text alone.  Null
    and empty texts score the chance of a text without events; repeated rows
    and null ids are scored each; other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon.of(model.stems), grammar()
        for batch in batches:
            found = [events(t.as_py(), lexicon, machine) for t in batch.column(1)]
            p = [model.score(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()),
                 pa.array([sum(x.values()) for x in found], pa.int64())],
                names=["doc_id", "score", "predicted", "n_events"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double, predicted int, n_events long"))
