"""Toxicity by a weighted finite-state pattern grammar.

A text with insults or threats is read as symbols: insult, doubtful insult (a word with a plain sense, as
pig or trash), threat, person, owner, speaker, object before its verb, copula, link, likeness, negation,
report, other, and the end of a clause.  Transducers for each are composed; all but the last rule stay
inside a clause:

* negation damps an insult or threat up to three words after it, reported speech what follows it;
* an insult matches after a person that it is said of: within two words, or four after a copula, articles
  and degree words not counted; a doubtful one only with nothing but those between.  Owners end the reach;
* a threat needs someone who utters or carries it out before it, or the clause's beginning (at most one
  word before it), and a person for its object: in the next two words, or an object pronoun before it;
* read backwards, an insult matches before a person within two words, a doubtful one before "like you";
* a series: an insult matches beside another one in its clause, a doubtful one beside one that is not
  doubtful or that has matched;
* a text with two insults or more, one at least not doubtful, is a series as a whole, which a counting
  automaton finds before: what did not match then keeps half its weight.

A score is the sum of the lexical weights times the weights of the arcs they passed; a word without a
match adds nothing.

Fixed words match as whole words with common endings, and weigh less where the sample's clean texts hold them.  Insult stems are learned too: of a bounded sample
of labelled training rows (``max_labelled``), prefixes of words that come with label 1 far more often
than with label 0 enter the insult lexicon with their log odds, at most ``most`` of them, the most frequent first.
A learned stem matches whole words, or all words that begin with it where it was learned from three or more
different ones.  A logistic layer over three document features (sum of scores, matched clauses, score for
each word, where a text counts 100 words more than it has), fitted on the same sample, gives the score.  Labels, language, source and ids are never
inputs of a score.

Defined results: null or empty texts have no clause and get the score of features 0; without usable
labels the fixed lexicon and default weights serve; repeated rows are each answered; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .common import arrow_map, materialize, read, unused

INSULTS = """idiot moron imbecile stupid dumb fool loser scum trash garbage filth worthless pathetic disgusting vile
disgrace clown coward pig vermin parasite creep freak lunatic retard bastard bitch asshole jerk dickhead whore slut
idiota imbécil estúpid basura asqueros inútil miserable cerdo payas patétic cabrón
idiotin dumm trottel arschloch abschaum widerlich erbärmlich wertlos müll versager drecksack schwein
crétin stupide ordure racaille minable dégoûtant pathétique salaud connard abruti imbécile
""".split()
THREATS = """kill murder hurt destroy stab shoot burn strangle beat smash hang slaughter hunt punish
töten umbringen schlagen verletzen vernichten erschießen
tuer frapper détruire égorger massacrer
matar golpear destruir apuñalar quemar
""".split()
#: Insults with a plain sense.
DOUBTFUL = """fool trash garbage filth disgrace clown coward pig vermin parasite creep freak lunatic scum
basura cerdo payas müll versager ordure racaille minable
""".split()
PERSONS = """you youre yall they theyre them he him she ya du ihr sie tu vous tú usted ustedes vosotros ellos ils elles il elle
""".split()
OWNERS = "your yours their theirs his hers these those dein deine deinen ton ta votre vos vuestro".split()
#: Owners with a following word, persons without.
EITHER = frozenset(["her"])
SPEAKERS = "i we ill id im gonna someone somebody ich wir je nous on yo nosotros voy".split()
FRONTED = "dich dir euch ihn te toi os".split()
COPULAS = "are is am was were be been re s m r bist ist sind seid es eres est sont êtes son sois".split()
LINKS = """a an the such so very really total totally complete completely utter utterly absolute absolutely just all nothing but
dirty filthy little fucking damn bloody ein eine einen so total un una une des tan muy très si
""".split()
LIKENESS = "like wie comme como".split()
NEGATIONS = """not no never isnt arent dont wasnt werent doesnt wont cannot cant nobody neither nor without
nicht kein keine nie niemals ne pas jamais aucun ni nunca jamás ningún sin
""".split()
REPORTS = """said says say wrote writes called calls quoted claimed claims reported heard word term
sagte schrieb nannte dit écrit appelé dijo escribió llamó
""".split()

#: Endings of the fixed words.
ENDINGS = frozenset(["", *"s es ed d ing er ers est ly ic o a os as e en em n t st te ten".split()])

WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")
I, A, H, T, P, S, B, C, L, K, N, R, O, E = (
    "insult doubtful threat person owner speaker fronted copula link likeness negation report other end".split()
)
M, G, X = "matched insult", "matched threat", "idle threat"
SYMBOLS = (I, A, H, T, P, S, B, C, L, K, N, R, O, E)
EVERY = (*SYMBOLS, M, G, X)
INSULTING, THREATENING = (I, A, M), (H, G, X)
ALONE = -math.inf  # log weight of an insult or threat without a match
KINDS = {
    word: kind
    for kind, words in ((L, LINKS), (C, COPULAS), (K, LIKENESS), (R, REPORTS), (N, NEGATIONS), (S, SPEAKERS), (P, OWNERS), (T, PERSONS), (B, FRONTED))
    for word in words
}


class Transducer:
    """Deterministic weighted transducer: (state, symbol) -> (state, symbol, log weight); start state 0."""

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def compose(self, other: Transducer, alphabet) -> Transducer:
        """This one's output read by ``other``; pairs of states, numbered as they are reached."""
        number, queue, arcs = {(0, 0): 0}, [(0, 0)], {}
        for pair in queue:
            for symbol in alphabet:
                s, middle, w = self.arcs[pair[0], symbol]
                t, out, v = other.arcs[pair[1], middle]
                if (s, t) not in number:
                    number[s, t] = len(number)
                    queue.append((s, t))
                arcs[number[pair], symbol] = (number[s, t], out, w + v)
        return Transducer(arcs)

    def run(self, symbols: list[str], state=0) -> list[float]:
        """The log weights of the arcs that are passed."""
        return self.read(symbols, state)[1]

    def read(self, symbols: list[str], state=0) -> tuple[list[str], list[float]]:
        """The output symbols and the log weights of the arcs."""
        out, weights = [], []
        for symbol in symbols:
            state, symbol, w = self.arcs[state, symbol]
            out.append(symbol)
            weights.append(w)
        return out, weights


def _negation(scope: int = 3) -> Transducer:
    arcs = {}
    for s in range(scope + 1):
        for x in EVERY:
            left = 0 if x == E else scope if x == N else max(s - 1, 0)
            arcs[s, x] = (left, x, math.log(0.25) if x in (I, A, H) and s else 0.0)
    return Transducer(arcs)


def _report() -> Transducer:
    arcs = {}
    for s in (0, 1):
        for x in EVERY:
            after = 0 if x == E else 1 if x == R else s
            arcs[s, x] = (after, x, math.log(0.5) if x in (I, A, H) and s else 0.0)
    return Transducer(arcs)


def _said_of() -> Transducer:
    """State 0, or twice the words left in reach of a person, and one more if only links stood between."""
    arcs, near, far = {}, 2, 4
    for s in (0, *(2 * left + plain for left in range(1, far + 1) for plain in (0, 1))):
        left, plain = s // 2, s % 2
        for x in EVERY:
            out, weight = x, 0.0
            if x in (E, P):
                after = 0
            elif x in (T, B):
                after = 2 * near + 1
            elif x == C and s:
                after = 2 * far + plain
            elif x in (C, L, N, *INSULTING):
                after = s
                if x == I and s or x == A and plain:
                    out, weight = M, math.log(1.5)
            else:
                after = 2 * (left - 1) if left > 1 else 0
            arcs[s, x] = (after, out, weight)
    return Transducer(arcs)


def _agent() -> Transducer:
    """States: 0 the clause begins, 1 a word later, 2 nobody, 3 somebody, 4 somebody and an object."""
    arcs = {}
    for s in range(5):
        for x in EVERY:
            out, weight, after = x, 0.0, s if s > 2 or x == N else min(s + 1, 2)
            if x == E:
                after = 0
            elif x in (S, T):
                after = max(s, 3)
            elif x == B:
                after = 4 if s > 2 else 3
            elif x == H:
                out, weight = {2: (X, ALONE), 4: (G, 0.0)}.get(s, (H, 0.0))
            arcs[s, x] = (after, out, weight)
    return Transducer(arcs)


def _series(s: int, x: str) -> tuple[int, bool]:
    """State after ``x`` (0 no insult in the clause, 1 doubtful ones, 2 others too), and whether ``x`` has company."""
    after = 0 if x == E else 2 if x in (I, M) else max(s, 1) if x == A else s
    return after, x == I and s > 0 or x == A and s > 1


def _grammar() -> tuple[Transducer, Transducer, Transducer]:
    """The grammar for a text read forwards, the one that reads its output backwards, and the counting automaton.

    The backward states are (series of the text, words in reach of a person, likeness, insults in the clause).
    """
    series = Transducer({(s, x): (_series(s, x)[0], M if _series(s, x)[1] else x, 0.0) for s in range(3) for x in EVERY})
    forward = _negation()
    for part in (_report(), _said_of(), _agent(), series):
        forward = forward.compose(part, SYMBOLS)
    back, count = {}, {}
    for state in itertools.product((0, 1), range(3), range(3), range(3)):
        whole, reach, like, clause = state
        for x in EVERY:
            held, company = _series(clause, x)
            person = x in (T, B)
            after = (
                whole,
                2 if person else 0 if x in (E, P) else max(reach - 1, 0),
                1 if person else 2 if x == K and like == 1 else 0,
                held,
            )
            aim = math.log(1.25) if reach else 0.0
            rest = math.log(0.5) if whole else ALONE
            weight = 0.0
            if x == M:
                weight = aim
            elif x == I:
                weight = aim if reach or company else rest
            elif x == A:
                weight = 0.0 if company or like == 2 else rest
            elif x == H:
                weight = 0.0 if reach else ALONE
            back[state, x] = (after, x, weight)
    for n, sure in itertools.product(range(3), (0, 1)):
        for x in SYMBOLS:
            after = (min(n + (x in (I, A)), 2), max(sure, int(x == I)))
            count[(n, sure), x] = (after, int(after == (2, 1)), 0.0)
    return forward, Transducer(back), Transducer(count)


FORWARD, BACKWARD, COUNTING = _grammar()


@dataclass
class ToxicModel:
    stems: dict[str, float]  # insult -> weight
    threats: dict[str, float]
    prefixes: frozenset[str] = frozenset()  # stems that match all words that begin with them
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 2.0, 1.0, 0.5]))
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for kind, table in ((H, self.threats), (I, self.stems)):
                for stem, weight in table.items():
                    doubtful = kind == I and any(word.startswith(stem) or stem.startswith(word) for word in DOUBTFUL)
                    made.add_word(stem, (len(stem), A if doubtful else kind, weight, stem in self.prefixes))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def hits(self, text: str) -> dict[int, tuple[str, float]]:
        """Word start -> kind and weight of the longest matching stem there, from left to right."""
        out: dict[int, tuple[int, str, float]] = {}
        if not self.stems and not self.threats:
            return {}
        for end, (size, kind, weight, prefix) in self.automaton().iter(text):
            start = end - size + 1
            if start and text[start - 1].isalpha() or out.get(start, (0,))[0] > size:
                continue
            if not prefix:
                rest = WORD.match(text, end + 1)
                if rest and rest.group() not in ENDINGS:
                    continue
            out[start] = (size, kind, weight)
        return {k: out[k][1:] for k in sorted(out)}

    def features(self, text: str | None) -> tuple[float, float, float]:
        low = (text or "").lower()
        hits = self.hits(low)
        symbols: list[str] = []
        weights: list[float] = []
        upto = 0
        for start in hits:  # the clauses without hits change no state
            if start < upto:
                continue
            begin = max(low.rfind(c, upto, start) for c in ".!?;:\n") + 1 or upto
            stop = CLAUSE_END.search(low, start)
            upto = stop.start() if stop else len(low)
            either = False
            for word in WORD.finditer(low, begin, upto):
                kind, weight = hits.get(word.start(), (None, 0.0))
                if kind is None:
                    kind = KINDS.get(word.group(), O)
                if either and kind in (O, I, A, H):
                    symbols[-1] = P
                either = word.group() in EITHER
                symbols.append(T if either else kind)
                weights.append(weight)
            symbols.append(E)
            weights.append(0.0)
        read, ahead = FORWARD.read(symbols)
        whole = COUNTING.read(symbols, (0, 0))[0][-1] if symbols else 0
        behind = BACKWARD.run(read[::-1], (whole, 0, 0, 0))[::-1]
        total, matched, clause = 0.0, 0, False
        for symbol, w, a, b in zip(symbols, weights, ahead, behind, strict=True):
            if symbol == E:
                matched += clause
                clause = False
            elif w:
                clause |= b > ALONE and symbol != X
                total += w * math.exp(a + b)
        words = max(1, low.count(" ") + low.count("\n") + 1)
        return math.log1p(total), math.log1p(matched), math.log1p(1000 * total / (words + 100))

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + x @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(id_col: str = "doc_id", parts: int = 5):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled training rows, chosen by a hash of the id."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id")).distinct()
    total = rows.count()
    if total > most:  # a slice of the hashes first, so that the sort sees little more than it keeps
        rows = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(1.2 * (1 << 20) * most / total) + 64)
    rows = rows.orderBy(F.xxhash64("_id"), "toxic").limit(most)
    found = docs.select(id_col, text_col).join(F.broadcast(rows), F.col(id_col) == F.col("_id"))  # at most ``most`` rows
    return materialize(found.select(F.col(text_col).alias("text"), "toxic"), "labelled")


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, pos, neg): documents of either label that hold a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (pos if toxic else neg).update(set(WORD.findall((text or "").lower())))
        words = list(pos.keys() | neg.keys())
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            columns = [pa.array(part, pa.string())] + [pa.array([c[w] for w in part], pa.int64()) for c in (pos, neg)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "pos", "neg"])

    found = arrow_map(sample.select("text", "toxic"), work, "word string, pos long, neg long")
    return found.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_stems(
    sample: DataFrame, n_pos: int, n_neg: int, counts: DataFrame | None = None, odds: float = 12.0, evidence: float = 28.0, most: int = 4000
) -> tuple[dict[str, float], frozenset[str]]:
    """Prefixes of 3 to 12 letters that come with label 1, with log odds as weights; and those learned from several words.

    The smoothed odds must be at least ``odds``, and the log-likelihood ratio against the share of
    label 1 among all words at least ``evidence`` nats (about one chance in 10^12), so that words that
    happen to stand in a few toxic documents stay out.
    Of a prefix and its extension that find the same documents the longer one is kept; an extension of
    a kept prefix adds nothing and goes.  At most ``most`` stems are kept, the most frequent first.
    """
    sizes = F.explode(F.sequence(F.lit(3), F.least(F.lit(12), F.char_length("word"))))
    counts = word_counts(sample.dropDuplicates()) if counts is None else counts
    sums = counts.agg(F.sum("pos"), F.sum("neg")).first()
    share = min(max((sums[0] or 0) / max((sums[0] or 0) + (sums[1] or 0), 1), 1e-6), 1 - 1e-6)
    cut = counts.filter(F.char_length("word") >= 3).withColumn("size", sizes)
    ratio = ((F.col("pos") + 0.5) / F.lit(n_pos + 1.0)) / ((F.col("neg") + 0.5) / F.lit(n_neg + 1.0))
    n = F.col("pos") + F.col("neg")
    nats = F.col("pos") * F.log(F.greatest("pos", F.lit(1)) / (n * share)) + F.when(
        F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - share)))
    ).otherwise(0.0)
    rows = (
        cut.groupBy(F.expr("substring(word, 1, size)").alias("stem"))
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.when(F.col("pos") > 0, 1)).alias("kinds"))
        .withColumn("ratio", ratio)
        .filter((F.col("ratio") >= odds) & (nats >= evidence))
        .orderBy(F.col("pos").desc(), "stem")
        .limit(20 * most)
        .collect()
    )
    found = {r["stem"]: (r["pos"], r["ratio"], r["kinds"]) for r in rows}
    children: dict[str, list[str]] = defaultdict(list)
    for s in sorted(found):
        children[s[:-1]].append(s)
    kept: dict[str, float] = {}
    for stem in sorted(found, key=lambda s: (len(s), s)):
        if any(stem[:n] in kept for n in range(3, len(stem))):
            continue
        last = stem
        while longer := [x for x in children[last] if found[x][0] >= 0.95 * found[stem][0]]:
            last = longer[0]
        kept[last] = float(np.log(found[last][1]))
    listed = dict(sorted(kept.items(), key=lambda t: (-found[t[0]][0], t[0]))[:most])
    return listed, frozenset(s for s in listed if found[s][2] >= 3)


def listed_weights(counts: DataFrame, n_pos: int, n_neg: int, seen: int = 5) -> dict[str, float]:
    """Weights of the fixed insults: 3, or the log odds where these are less and ``seen`` documents or more hold the word."""
    rows = counts.filter(F.col("word").isin(INSULTS) & (F.col("pos") + F.col("neg") >= seen)).collect()  # fixed words
    odds = {r["word"]: math.log((r["pos"] + 0.5) / (n_pos + 1) * (n_neg + 1) / (r["neg"] + 0.5)) for r in rows}
    return {w: min(3.0, max(0.0, odds.get(w, 3.0))) for w in INSULTS}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Bias and weights by Newton steps with a ridge on the weights."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-6, *[ridge * len(x) / 100] * x.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000
) -> ToxicModel:
    """Fits on at most ``max_labelled`` labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, max_labelled, id_col, text_col)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    stems = {w: 3.0 for w in INSULTS}
    prefixes: frozenset[str] = frozenset()
    if n_pos and n_neg:
        counts = materialize(word_counts(sample.dropDuplicates()), "toxicwords")
        learned, prefixes = learn_stems(sample, n_pos, n_neg, counts)
        stems = listed_weights(counts, n_pos, n_neg) | learned
    model = ToxicModel(stems, {w: 2.0 for w in THREATS}, prefixes)
    if n_pos and n_neg:
        table = features(sample.select("toxic", "text"), model, "toxic", "text").toArrow()  # at most max_labelled rows
        x = np.stack([table[c].to_numpy() for c in ("f0", "f1", "f2")], axis=1)
        model.weights = fit_logistic(x, table["doc_id"].to_numpy().astype(float))
    return model


def features(docs: DataFrame, model: ToxicModel, id_col: str, text_col: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([model.features(t.as_py()) for t in batch.column(1)], dtype=float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T.copy())], ["doc_id", "f0", "f1", "f2"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), work, f"doc_id {kind}, f0 double, f1 double, f2 double")


def scored(docs: DataFrame, model: ToxicModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score column, in one pass and without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != out]
    at = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            x = np.array([m.features(t.as_py()) for t in batch.column(at)], dtype=float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.probability(x))], [*names, out])

    rest = docs.select(*names)
    return arrow_map(rest, work, T_.StructType([*rest.schema.fields, T_.StructField(out, T_.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, **how)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(rows, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Stage form: the documents that are not predicted toxic, with the columns of ``docs``."""
    score = unused("score", docs.columns)
    return scored(docs, train(docs, labels), out=score).filter(F.col(score) < 0.5).select(*docs.columns)
