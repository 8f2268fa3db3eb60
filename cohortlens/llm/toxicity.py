"""Toxicity by a weighted finite-state pattern grammar.

Terminals are insult stems with weights learned from labelled rows, and fixed small
lists of threat verbs, targets, negators and verbs of reported speech. One small machine
for each role reads the terminals of a clause; the machines are composed into a single
transition table, whose outputs are matched patterns: an insult, plain or beside a
target, under negation, inside reported speech; a threat against a target. A document's
features are weights summed by pattern, and a logistic model over them gives the score.

Stems are word beginnings. Their support is the number of toxic rows they stand in, or of
different words they follow there if that is less, so that a passage that is copied often
supports its words once."""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, text_rows

# Terminals of the grammar, lower case.
INSULTS = "idiot moron imbecile stupid pathetic worthless loser scum trash disgusting dumb"
THREATS = "kill hurt destroy beat smash stab shoot töten tue frapper matar golpear"
TARGETS = "you your yours he she him her they them their people du dich dir ihr sie er tu toi vous il elle ils ellos usted ella él"
NEGATORS = "not never no isn aren wasn nicht kein keine nie ne pas jamais nunca ningún"
REPORTS = "said says say called calls claimed wrote quoted sagte schrieb dit écrit dijo escribió"

FEATURES = ("direct", "plain", "negated", "reported", "threat", "clauses")
#: Lengths of stems, and the weight an unlearned insult has.
STEM_LENGTHS, PRIOR = (3, 14), 2.5
_TOKEN = r"[^\W\d_]+|[.!?;:\n\"“”«»]"
_REACH = 3  # words after a negator that it covers, and between a threat and its target
_LETTERS = r"[^\p{L}]+"


def _machines():
    """(states, step) for each role; step takes a state and a terminal."""
    negation = (_REACH + 1, lambda s, t: _REACH if t == "N" else max(0, s - 1))
    report = (2, lambda s, t: 1 if t in "RQ" else s)
    target = (2, lambda s, t: 1 if t == "Y" else s)
    threat = (_REACH + 1, lambda s, t: _REACH if t == "T" else max(0, s - 1))
    return negation, report, target, threat


def compose() -> dict[tuple[int, str], tuple[int, str]]:
    """Transition table of the composed machine: (state, terminal) -> (state, output)."""
    machines = _machines()
    states = list(product(*[range(n) for n, _ in machines]))
    number = {s: i for i, s in enumerate(states)}
    table = {}
    for s in states:
        for t in "ITYNRQo":
            after = tuple(step(x, t) for x, (_, step) in zip(s, machines))
            out = ""
            if t == "I":
                # A report outweighs a negation, a negation a target.
                out = "reported" if s[1] else "negated" if s[0] else "direct" if s[2] else "plain"
            elif t == "Y" and s[3]:
                out = "reported" if s[1] else "negated" if s[0] else "threat"
            table[number[s], t] = number[after], out
    return table


class Grammar:
    def __init__(self, stems: dict[str, float]):
        self.table = compose()
        self.weight = {w: PRIOR for w in INSULTS.split()} | stems
        self.fixed = {w: t for words, t in ((REPORTS, "R"), (NEGATORS, "N"), (TARGETS, "Y"), (THREATS, "T")) for w in words.split()}
        self.fixed |= {q: "Q" for q in "\"“”«»"}
        self.heads = {w[: STEM_LENGTHS[0]] for w in [*self.weight, *THREATS.split()]}
        self.find = re.compile(_TOKEN).findall
        self.cache: dict[str, tuple[str, float]] = {}

    def terminal(self, word: str) -> tuple[str, float]:
        """The longest stem that begins ``word`` makes it an insult."""
        got = self.cache.get(word)
        if got is None:
            got = (self.fixed.get(word, "o"), 0.0)
            for n in range(min(len(word), STEM_LENGTHS[1]), STEM_LENGTHS[0] - 1, -1):
                if word[:n] in self.weight:
                    got = ("I", self.weight[word[:n]])
                    break
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def features(self, text: str) -> list[float]:
        """Weights by pattern over all clauses; words without a terminal head are skipped."""
        words, cut = self.find(text.lower()), STEM_LENGTHS[0]
        heads = self.heads
        sums = dict.fromkeys(FEATURES, 0.0)
        done = -1
        for at in [i for i, w in enumerate(words) if w[:cut] in heads]:
            if at <= done:
                continue
            lo = at
            while lo and words[lo - 1] not in _ENDS:
                lo -= 1
            state, hit, i = 0, False, lo
            while i < len(words) and words[i] not in _ENDS:
                t, w = self.terminal(words[i])
                state, out = self.table[state, t]
                if out:
                    sums[out] += w or PRIOR
                    hit = hit or out in ("direct", "plain", "threat")
                i += 1
            done = i
            sums["clauses"] += hit
        return [math.log1p(sums[f]) for f in FEATURES]


_ENDS = frozenset(".!?;:\n")


def held_out(key: Column) -> Column:
    """The remainder of crc32(id as text) by 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``doc``, ``text``, ``y``: labelled rows that are not held out. Several labels of
    an id count as the largest; null labels and null ids are no labels."""
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    own = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(~held_out(F.col("doc")))
    # The same join at every size: labels grow with the documents.
    return own.join(known.where(~held_out(F.col("id"))).hint("merge"), F.col("doc") == F.col("id")).select("doc", "text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))


def learn_stems(train: DataFrame) -> dict[str, float]:
    """Word beginnings whose support in toxic rows is beyond chance, with log-odds
    weights. Counts cover all training rows; of beginnings with equal support the longest
    stays, and of those that begin each other the purest."""
    words = F.filter(F.split(F.lower("text"), _LETTERS), lambda w: F.length(w) > 0)
    rows = train.select("y", words.alias("w"))
    n_pos, n_neg = (rows.where(f"y = {y}").count() for y in (1, 0))
    if not n_pos or not n_neg:
        return {}
    pairs = F.array_distinct(F.zip_with(F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))), F.col("w"), lambda a, b: F.struct(b.alias("word"), a.alias("before"))))
    ahead = rows.where("y = 1 and size(w) > 0").select(F.explode(pairs).alias("p")).select("p.*").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("ctx"))
    held = rows.select("y", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    zero = F.lit(0).cast("long")
    each = ahead.select("word", "ctx", zero.alias("pos"), zero.alias("neg")).unionByName(held.select("word", zero.alias("ctx"), "pos", "neg"))
    both = each.groupBy("word").agg(F.least(F.sum("ctx"), F.sum("pos")).alias("pos"), F.sum("neg").alias("neg"))
    lo, hi = STEM_LENGTHS
    stems = both.where(F.length("word") >= lo).select(
        F.explode(F.transform(F.sequence(F.lit(lo), F.least(F.length("word"), F.lit(hi))), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("stem"), "pos", "neg"
    )
    counts = settle(stems.groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 3"))
    share = n_pos / (n_pos + n_neg)
    total = F.col("pos") + F.col("neg")
    term = lambda k, part: F.when(k > 0, k * F.log(k / (total * F.lit(part)))).otherwise(F.lit(0.0))
    gain = term(F.col("pos"), share) + term(F.col("neg"), 1 - share)
    weight = F.log((F.col("pos") + 0.5) / F.lit(n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n_neg + 1.0))
    beyond = math.log(max(1, counts.count())) + math.log(100.0)
    best = counts.where((gain >= beyond) & (weight >= 2.0)).select("stem", "pos", weight.alias("weight"))
    longer = best.groupBy(F.expr("left(stem, length(stem) - 1)").alias("stem")).agg(F.max("pos").alias("longer"))
    closed = best.join(longer, "stem", "left").where(F.coalesce("longer", F.lit(0)) < 0.98 * F.col("pos")).select("stem", "weight").collect()
    kept: dict[str, float] = {}
    inside: set[str] = set()
    # The purest first: neither what extends an accepted stem nor a looser beginning of it.
    for r in sorted(closed, key=lambda r: (-r.weight, r.stem)):
        begins = [r.stem[:n] for n in range(lo, len(r.stem))]
        if r.stem not in inside and not any(b in kept for b in begins):
            kept[r.stem] = float(r.weight)
            inside.update(begins)
    return kept


def _featured(stems: dict[str, float], *keep: str):
    """Adds ``x``, the features, to the columns ``keep``; the text goes."""

    def run(batches):
        grammar = Grammar(stems)
        for b in batches:
            x = pa.array([grammar.features(t) for t in text_rows(b.column("text"))], pa.list_(pa.float64()))
            yield pa.record_batch([*(b.column(c) for c in keep), x], names=[*keep, "x"])

    return run


def _sums(points: np.ndarray):
    """Over the task's rows, for each of several weight vectors: loss, gradient and second
    derivatives of the log likelihood."""

    def run(batches):
        k = points.shape[1]
        out = np.zeros((len(points), 1 + k + k * k))
        for b in batches:
            y, n = b.column("y").to_numpy().astype(float), b.column("n").to_numpy().astype(float)
            x = np.column_stack([np.ones(len(y)), b.column("x").flatten().to_numpy().reshape(len(y), -1)])
            for i, beta in enumerate(points):
                z = x @ beta
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                out[i, 0] += n @ (np.logaddexp(0.0, z) - y * z)
                out[i, 1 : 1 + k] += x.T @ (n * (y - p))
                out[i, 1 + k :] += ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.record_batch([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    return run


def fit(train: DataFrame, stems: dict[str, float]) -> list[float]:
    """Weights of the logistic model on all training rows, intercept first, by damped Newton
    steps with a ridge; a step is one job, which leaves a few numbers for each task. Pattern
    weights are never negative. Without rows of both kinds: fixed weights."""
    made = train.select("y", "text").mapInArrow(_featured(stems, "y"), "y int, x array<double>")
    rows = settle(made.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n")))
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if len(n) < 2:
        return [-4.0, 2.0, 2.0, 0.5, 0.5, 2.0, 1.0]
    k = 1 + len(FEATURES)
    ridge = np.full(k, 0.5)
    ridge[0] = 1e-2

    def sums(points: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        parts = [r.v for r in rows.select("y", "x", "n").mapInArrow(_sums(points), "v array<double>").collect()]
        total = np.sum(parts, axis=0).reshape(len(points), -1)
        return [(float(t[0] + 0.5 * (ridge * b * b).sum()), t[1 : 1 + k] - ridge * b, t[1 + k :].reshape(k, k)) for t, b in zip(total, points)]

    beta = np.zeros(k)
    share = n[1] / (n[0] + n[1])
    beta[0] = np.log(share / (1 - share))
    (best, grad, second), = sums(beta[None])
    for _ in range(200):
        # Weights at their bound that would fall below it stay there.
        free = (beta > 0) | (grad > 0)
        free[0] = True
        step = np.zeros_like(beta)
        step[free] = np.linalg.solve(second[np.ix_(free, free)] + np.diag(ridge[free]), grad[free])
        # The largest of the halved steps that is an improvement.
        points = beta + 0.5 ** np.arange(20)[:, None] * step
        points[:, 1:] = np.maximum(points[:, 1:], 0.0)
        found = sums(points)
        better = next((i for i, (value, _, _) in enumerate(found) if value < best - 1e-12), None)
        if better is None:
            break
        value, grad, second = found[better]
        done = best - value < 1e-9 * (1 + best)
        beta, best = points[better], value
        if done:
            break
    return [float(b) for b in beta]


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` (its columns ``keep``, or all) with
    ``held_out``, ``score`` (0 to 1) and ``predicted``.

    The whole text is read; ids, sources and languages are no inputs. A null or empty
    text matches nothing and gets the score of a text without matches. Without usable
    labels the fixed terminals and weights apply."""
    train = settle(training_rows(docs, labels, text, key))
    stems = learn_stems(train)
    beta = fit(train, stems)
    columns = docs.columns if keep is None else keep
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), held_out(F.col(key).cast("long")).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = base.schema["row"].dataType.simpleString()
    made = base.mapInArrow(_featured(stems, "row", "held_out"), f"row {kind}, held_out boolean, x array<double>")
    z = F.lit(beta[0])
    for i, b in enumerate(beta[1:]):
        z = z + F.lit(b) * F.col("x")[i]
    score = 1 / (1 + F.exp(-z))
    return made.select("row", "held_out", score.alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
