"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .memory import tidy
from .units import plain_columns

#: Closed word classes of the four languages. Insults are learned, not listed.
TARGETS = "you your yours he she him her they them this that these those du dein deine ihr euch er sie diese dieser tu toi ton ta vous votre il elle ils elles ce cette tú usted ustedes vosotros él ella ellos ellas este esta".split()
NEGATIONS = "not no never neither nor without isn aren wasn nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans nunca jamás ni sin tampoco".split()
REPORTS = "said says say saying wrote writes quoted quotes claimed claims called reported according sagte sagt schrieb schreibt zitierte behauptete laut dit disait écrit écrivait cité selon prétend dijo dice escribió citó según afirmó".split()
INTENTS = "i we will shall gonna going want ich wir werde werden möchte je nous vais allons veux nosotros voy vamos quiero".split()
#: Stems of verbs of violence, the endings they take in their language, and irregular forms.
VIOLENCE = {
    "kill hurt destroy stab murder punch": " s es ed ing",
    "töt schlag vernicht erschieß": "en e st est t et te ten",
    "tu frapp assassin": "er e es ent ez ons é ée erai erons",
    "mat golpe asesin": "ar o as a an amos aré aremos ado",
}
IRREGULAR = "stabbed stabbing beat beats beating shoot shoots shooting shot umbringen détruire détruirai destruir destruiré".split()
FORMS = frozenset(IRREGULAR) | {stem + end for stems, ends in VIOLENCE.items() for stem in stems.split() for end in ends.split(" ")}
WORD = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”„«»]")
BORDERS, QUOTES = frozenset(".!?;:\n"), frozenset('"“”„«»')
#: Classes of words that the small transducers read, and the marks they write. A mark's status is added to its kind.
OTHER, TARGET, NEGATION, REPORT, INTENT, VERB, QUOTE = range(7)
INSULT, THREAT = 10, 20
PLAIN, DENIED, REPORTED, AIMED = range(4)
CLASSES = dict.fromkeys(FORMS, VERB) | dict.fromkeys(INTENTS, INTENT) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(QUOTES, QUOTE)
#: What a text is scored by; see ``Scorer.features``.
FEATURES = 6


class Transducer:
    """A deterministic transducer whose weights multiply. ``arcs(state, symbol)`` gives the next state, the
    symbol written and the weight; each arc is worked out when ``run`` first takes it, and kept."""

    def __init__(self, start, arcs):
        self.start, self.arcs = start, arcs
        self.states, self.number, self.taken = [start], {start: 0}, [{}]

    def compose(self, other: "Transducer") -> "Transducer":
        """Feed what this one writes to ``other``."""

        def both(state, symbol):
            a, middle, first = self.arcs(state[0], symbol)
            b, out, second = other.arcs(state[1], middle)
            return (a, b), out, first * second

        return Transducer((self.start, other.start), both)

    def _take(self, at: int, symbol) -> tuple[int, int, float]:
        state, out, weight = self.arcs(self.states[at], symbol)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.taken.append({})
        found = self.taken[at][symbol] = (self.number[state], out, weight)
        return found

    def run(self, symbols) -> list[tuple[int, float]]:
        at, out, taken = 0, [], self.taken
        for s in symbols:
            at, symbol, weight = taken[at].get(s) or self._take(at, s)
            out.append((symbol, weight))
        return out


def insults(patterns: dict[tuple[str, ...], float]) -> Transducer:
    """Reads the words of patterns, and all others by their classes; writes INSULT with the pattern's
    strength where a sequence of words that is a pattern ends (the strongest, if several end there),
    else the word's class."""
    heads = {p[:k] for p in patterns for k in range(1, len(p) + 1)}

    def arc(state, word):
        if isinstance(word, int):
            return (), word, 1.0
        tail = (*state, word)
        strength = max((patterns[tail[k:]] for k in range(len(tail)) if tail[k:] in patterns), default=None)
        kept = next((tail[k:] for k in range(len(tail)) if tail[k:] in heads), ())
        return (kept, CLASSES.get(word, OTHER), 1.0) if strength is None else (kept, INSULT, strength)

    return Transducer((), arc)


def threats(reach: int, meant: float = 1.0, bare: float = 0.5) -> Transducer:
    """Writes THREAT at a verb of violence up to ``reach`` words after a word of intent, and at a target up
    to ``reach`` words after such a verb that stands without one."""

    def arc(state, s):
        kind, left = state
        if s == INTENT:
            return (INTENT, reach), s, 1.0
        if s == VERB:
            return ((OTHER, 0), THREAT, meant) if kind == INTENT else ((VERB, reach), s, 1.0)
        if s == TARGET and kind == VERB:
            return (OTHER, 0), THREAT, bare
        return ((kind, left - 1) if left > 1 else (OTHER, 0)), s, 1.0

    return Transducer((OTHER, 0), arc)


def near(cue: int, status: int, factor: float, reach: int) -> Transducer:
    """Gives a plain mark up to ``reach`` words after a ``cue`` the status, and its weight the factor."""

    def arc(left, s):
        if s == cue:
            return reach, s, 1.0
        marked = left > 0 and s in (INSULT, THREAT)
        return max(left - 1, 0), s + status if marked else s, factor if marked else 1.0

    return Transducer(0, arc)


def reported(factor: float) -> Transducer:
    """A verb of reporting marks what follows in its clause: all of it, or, once a quotation mark opens, what lies up to the
    one that closes. Read backwards it marks what stands before the verb."""

    def arc(scope, s):
        if s == REPORT:
            return 1, s, 1.0
        if s == QUOTE and scope:
            return (2 if scope == 1 else 0), s, 1.0
        marked = scope and s in (INSULT, THREAT)
        return scope, s + REPORTED if marked else s, factor if marked else 1.0

    return Transducer(0, arc)


class Cascade:
    """Transducers that read what the one before wrote, each in its direction."""

    def __init__(self, *machines: tuple[Transducer, int]):
        self.machines = machines

    def run(self, symbols) -> list[tuple[int, float]]:
        symbols, weights = list(symbols), [1.0] * len(symbols)
        for machine, step in self.machines:
            told = machine.run(symbols[::step])[::step]
            symbols, weights = [s for s, _ in told], [a * b for a, (_, b) in zip(weights, told)]
        return list(zip(symbols, weights))


def grammar(patterns: dict[tuple[str, ...], float], reach: int = 3) -> Cascade:
    """Insult, threat, negation and speech reported before it, composed; then, from right to left, speech reported after it;
    then target. It reads the ``symbols`` of one clause."""
    first = insults(patterns).compose(threats(reach)).compose(near(NEGATION, DENIED, 0.25, reach)).compose(reported(0.5))
    return Cascade((first, 1), (reported(0.5), -1), (near(TARGET, AIMED, 1.5, reach), 1))


def symbols(patterns: dict[tuple[str, ...], float]) -> dict[str, str | int]:
    """The symbol of each word that is not OTHER: words of patterns stand for themselves."""
    return CLASSES | {w: w for p in patterns for w in p}


class Scorer:
    """Counts of matched clauses of a text, and their logistic score."""

    def __init__(self, patterns: dict[tuple[str, ...], float], weights: np.ndarray):
        self.patterns, self.weights = patterns, weights
        self.cues = FORMS | {p[-1] for p in patterns}
        self.symbols, self.machine = symbols(patterns), None

    def __getstate__(self):
        return {**self.__dict__, "machine": None}  # arcs hold functions; each worker builds its own

    def clauses(self, text: str):
        """The words of each clause that holds a cue, and the number of words of the text."""
        tokens = WORD.findall(text.lower())
        found, end = [], 0
        if not self.cues.isdisjoint(tokens):
            for at in [i for i, t in enumerate(tokens) if t in self.cues]:
                if at < end:
                    continue
                begin = at
                while begin and tokens[begin - 1] not in BORDERS:
                    begin -= 1
                end = at + 1
                while end < len(tokens) and tokens[end] not in BORDERS:
                    end += 1
                found.append(tokens[begin:end])
        return found, len(tokens)

    def features(self, text: str) -> np.ndarray:
        """Logs of 1 + the summed weight of insults, of threats, of all marks in 1,000 words, the number of
        matched clauses, and the different words marked plain or aimed; and whether anything matched."""
        if self.machine is None:
            self.machine = grammar(self.patterns)
        clauses, size = self.clauses(text)
        if not clauses:
            return np.zeros(FEATURES)
        sums, matched, words = {INSULT: 0.0, THREAT: 0.0}, 0, set()
        for clause in clauses:
            hit = False
            for word, (symbol, weight) in zip(clause, self.machine.run([self.symbols.get(w, OTHER) for w in clause])):
                if symbol >= INSULT:
                    hit = True
                    sums[symbol // 10 * 10] += weight
                    if symbol % 10 in (PLAIN, AIMED):
                        words.add(word)
            matched += hit
        total = sums[INSULT] + sums[THREAT]
        return np.array([math.log1p(sums[INSULT]), math.log1p(sums[THREAT]), math.log1p(1000 * total / (size + 20)), math.log1p(matched), math.log1p(len(words)), float(matched > 0)])

    def score(self, features: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[0] + features @ self.weights[1:])))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge on all but the constant."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def terms(text: str, words: int, only: frozenset[str] | None = None, heads: frozenset[str] | None = None) -> set[str]:
    """The runs of up to ``words`` words inside clauses, joined by spaces; if given, only those of a set,
    whose longer runs begin with one of ``heads``."""
    tokens = WORD.findall(text.lower())
    if only is not None:
        out = set(only.intersection(tokens))
        for i in [i for i, t in enumerate(tokens) if t in heads] if heads else ():
            out.update(run for n in range(2, words + 1) if (run := " ".join(tokens[i : i + n])) in only)
        return out
    apart = BORDERS | QUOTES
    out = {t for t in tokens if t not in apart}
    for n in range(2, words + 1):
        out.update(" ".join(run) for run in zip(*(tokens[k:] for k in range(n))) if apart.isdisjoint(run))
    return out


def sliced(batches, *columns: str):
    """The columns of batches as lists, some rows at a time, so that few texts are unpacked at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            yield [part.column(c).to_pylist() for c in columns]


def _counted(sample: DataFrame, label: int, words: int, only: frozenset[str] | None = None) -> DataFrame:
    """``term, n``: in how many texts of the label each term occurs."""
    heads = frozenset(t.split(" ", 1)[0] for t in only if " " in t) if only is not None else None

    @tidy
    def count(batches):
        seen, size = Counter(), 0
        for (texts,) in sliced(batches, "text"):
            for text in texts:
                seen.update(terms(text, words, only, heads))
                size += len(text)
                if size > 1 << 19:
                    yield rows(seen)
                    seen, size = Counter(), 0
        yield rows(seen)

    def rows(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    return sample.where(F.col("y") == label).select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, words: int = 2, lift: float = 8.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", block_terms: int = 500_000) -> Scorer:
    """Fit the insult patterns and the weights on at most ``sample_rows`` labelled documents, those of the
    smallest hashed ids (of rows that share an id the least text), which are written once.

    A run of up to ``words`` words is a pattern if its share among toxic documents is ``lift`` times that
    among others and the difference cannot well be chance (log-likelihood ratio over 15), and no
    shorter pattern is part of it. Terms in fewer than two toxic texts, or than one of 400, are not looked at. All that qualify are
    kept. A null label or id teaches nothing; ties of a shared id go to the greater label and the least text. Terms of toxic texts are counted in the
    others in blocks of ``block_terms``, so what a task holds is bounded.

    Without labels of both kinds nothing is matched and each score is 0.
    """
    ids = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    sample = plain_columns(docs, id_col, text_col).where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = materialize(sample, "labelled")
    size = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Scorer({}, np.array([-30.0] + [0.0] * FEATURES))
    common = materialize(_counted(sample, 1, words).where(F.col("n") >= max(2, toxic // 400)), "terms")
    blocks = max(1, -(-common.count() // block_terms))
    strength: dict[tuple[str, ...], float] = {}
    for block in range(blocks):
        part = common.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)
        counts = {r.term: r.n for r in part.collect()}
        for r in _counted(sample, 0, words, frozenset(counts)).unionByName(part.select("term", F.lit(0).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("n")).collect():
            a, b = counts[r.term], r.n
            p, q, share = a / toxic, (b + 0.5) / (clean + 1), (a + b) / (toxic + clean)
            ratio = 2 * sum(k * math.log(k / (n * s)) for k, n, s in ((a, toxic, share), (b, clean, share), (toxic - a, toxic, 1 - share), (clean - b, clean, 1 - share)) if k > 0 and n * s > 0)
            if p >= lift * q and ratio > 15:
                strength[tuple(r.term.split(" "))] = math.log(p / q) / math.log(lift)
    patterns = {p: s for p, s in strength.items() if not any(p[i:j] in strength for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p))}
    plain = Scorer(patterns, np.zeros(FEATURES + 1))

    @tidy
    def measure(batches):
        for y, texts in sliced(batches, "y", "text"):
            x = [plain.features(t).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    measured = sample.select("y", "text").mapInArrow(measure, "y int, x array<double>").collect()
    return Scorer(patterns, _fit(np.array([r.x for r in measured]), np.array([r.y for r in measured], float)))


def score_toxicity(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, score, predicted, clauses`` for each document, from its whole text: the share
    to which its matched clauses speak for toxicity, 1 where that is a half or more, and the number
    of clauses. A clause reaches from border to border, however long. One scan, no shuffle.

    Null or empty text: the score of a text without a match. A score of exactly a half counts as toxic. Null id: returned as null. Repeated
    rows are scored each, and alike. Empty table: no rows. Columns other than the two read are
    ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @tidy
    def judge(batches):
        own = shared.value
        for ids, texts in sliced(batches, "doc_id", "text"):
            x = [own.features(t or "") for t in texts]
            scores = [own.score(f) for f in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([round(math.expm1(f[3])) for f in x], pa.int32())],
                ["doc_id", "score", "predicted", "clauses"],
            )

    return plain_columns(docs, id_col, text_col).mapInArrow(judge, "doc_id long, score double, predicted int, clauses int")
