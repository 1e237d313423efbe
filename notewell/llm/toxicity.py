"""Toxicity by a weighted grammar of finite-state transducers.

Five transducers read the words of a clause: negation, insult, threat, target and reported
speech. Negation passes the words on with a mark on those it covers; insult and threat take the weights
of their words, from a lexicon of words and stems; targets and reports are closed word classes.
``compose`` makes one machine of them, whose final state says what the clause holds; a
clause without an insult or a threat gives nothing. A matched clause scores the weights of
its words under the kind that its final state names; a text's features are its clauses'
scores by kind, and a logistic function, fitted on labelled rows, weighs the kinds.

The lexicon of insults is learned from labelled rows: words and stems (leading 4 to 6 bytes)
that toxic texts hold far more often. Isolated frequencies of other words play no part.

Defined results: null and empty texts have no clause and get the intercept's score; without
labelled rows the lexicon is the threat list alone and its kinds weigh 1; repeated rows are
scored each; other columns are ignored. Words longer than any bound are read whole.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notewell.llm import labelled, words
from notewell.llm.tables import bounded_batches

TRAIN_ROWS = 16384  # bound of the labelled sample
STEMS = (4, 5, 6)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
NEGATION_REACH = 3  # words after a negation that it still covers
LEAST_TEXTS, LEAST_SHARE = 6, 0.006  # toxic texts, and share of them, that a word of the lexicon must occur in

# Closed word classes of the four languages of the corpus.
TARGETS = "you your yours youre u they them he she du dich dir ihr euch sie er tu toi te vous ton ta il elle ils tú ti usted ustedes vosotros él ella ellos"
NEGATIONS = "not no never neither nor isnt arent nicht kein keine keinen nie niemals pas jamais aucun aucune ne ni nunca jamás ningún ninguna"
REPORTS = "said says wrote writes claimed quoted quote reportedly sagte sagt schrieb zitiert dit disait écrit déclare dijo dice escribió citó"
THREATS = "kill hurt destroy beat shoot stab attack punish töte töten umbringen verletzen schlagen tuer frapper détruire blesser matar golpear destruir herir"

_WORD = words.flags([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_STOP = words.flags([(0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)])


def hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words.mix(words.range_hash(words.prefix_hash(raw), np.array([0]), np.array([len(raw)])))[0])


class Transducer(NamedTuple):
    """A finite-state transducer with weights over word classes.

    ``step`` and ``emit`` hold, for each state and input symbol, the next state and the symbol passed on;
    ``pay`` the share of the word's weight that it takes. State 0 is the start; ``final`` says what each state means.
    """

    step: np.ndarray
    emit: np.ndarray
    pay: np.ndarray
    final: list[tuple]


SYMBOLS = 12  # a word class, and 6 more if a negation covers the word


def passing(states: int, move, final: list[tuple], pays: tuple[int, ...] = ()) -> Transducer:
    """A transducer that passes its symbols on unchanged, takes the weight of the classes ``pays`` and moves by ``move(state, class, negated)``."""
    step, emit, pay = (np.zeros((states, SYMBOLS), kind) for kind in (np.int16, np.int16, float))
    for state in range(states):
        for symbol in range(SYMBOLS):
            step[state, symbol] = move(state, symbol % 6, symbol >= 6)
            emit[state, symbol], pay[state, symbol] = symbol, float(symbol % 6 in pays)
    return Transducer(step, emit, pay, final)


def matching(wanted: int) -> Transducer:
    """Insults or threats: seen not at all, plainly only, or under a negation."""
    return passing(3, lambda state, c, negated: max(state, 1 + negated) if c == wanted else state, [(False, False), (True, False), (True, True)], (wanted,))


def seeing(wanted: int) -> Transducer:
    """Targets or reported speech: seen or not."""
    return passing(2, lambda state, c, negated: state or int(c == wanted), [(False,), (True,)])


def negating(reach: int) -> Transducer:
    """Marks the words that a negation covers; a state is the number of words still in its reach."""
    step, emit = np.zeros((reach + 1, 6), np.int16), np.zeros((reach + 1, 6), np.int16)
    for left in range(reach + 1):
        for c in range(6):
            step[left, c] = reach if c == NEGATION else max(0, left - 1)
            emit[left, c] = c + 6 * (left > 0)
    return Transducer(step, emit, np.zeros(step.shape), [()] * (reach + 1))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Both in a row: the second reads what the first passes on. Only pairs of states that can be reached are kept."""
    places, todo = {(0, 0): 0}, [(0, 0)]
    rows = []
    for one, two in todo:
        row = []
        for symbol in range(first.step.shape[1]):
            passed = first.emit[one, symbol]
            after = (int(first.step[one, symbol]), int(second.step[two, passed]))
            if after not in places:
                places[after] = len(places)
                todo.append(after)
            row.append((places[after], second.emit[two, passed], first.pay[one, symbol] + second.pay[two, passed]))
        rows.append(row)
    table = np.array(rows)
    return Transducer(table[:, :, 0].astype(np.int16), table[:, :, 1].astype(np.int16), table[:, :, 2], [first.final[one] + second.final[two] for one, two in todo])


def machine() -> Transducer:
    """Negation, insult, threat, target and reported speech, composed."""
    whole = negating(NEGATION_REACH)
    for part in (matching(INSULT), matching(THREAT), seeing(TARGET), seeing(REPORT)):
        whole = compose(whole, part)
    return whole


def kind_of(insult: bool, negated_insult: bool, threat: bool, negated_threat: bool, target: bool, reported: bool) -> int:
    """0 for an unmatched clause, else 1 + insult-or-threat, target, negated and reported as bits."""
    return 1 + 8 * threat + 4 * target + 2 * (negated_insult or negated_threat) + reported if insult or threat else 0


MACHINE = machine()
STEP, KIND = MACHINE.step, np.array([kind_of(*f) for f in MACHINE.final], np.int8)
PAYS = MACHINE.pay[0]  # the weight taken depends on the class alone
KINDS = 17


def read(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (A-Z lower-cased), stem hashes (0: none), clause of each word, first word of each text."""
    low = words.LOWER[data]
    starts, ends = words.find_words(low, at, _WORD)
    prefix = words.prefix_hash(low)
    full = words.mix(words.range_hash(prefix, starts, ends))
    stems = np.zeros((len(STEMS), len(starts)), np.uint64)
    for k, n in enumerate(STEMS):
        longer = np.flatnonzero(ends - starts > n)
        stems[k, longer] = words.mix(words.range_hash(prefix, starts[longer], starts[longer] + n), 1)
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    first = np.searchsorted(starts, at)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return full, stems, stops[starts] + text, first


def classes(lexicon: words.Lookup, stem_lexicon: words.Lookup, full: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and weight of each word; a whole word goes before a stem, a longer stem before a shorter one."""
    kind, weight = np.zeros(len(full), np.int8), np.zeros(len(full))
    for k in range(len(STEMS)):
        i, v = stem_lexicon.find(stems[k])
        kind[i], weight[i] = INSULT, v
    i, v = lexicon.find(full)
    kind[i], weight[i] = v[:, 0].astype(np.int8), v[:, 1]
    return kind, weight


def clause_scores(kind: np.ndarray, weight: np.ndarray, clause: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the weights of its matched clauses by kind."""
    n = len(first) - 1
    out = np.zeros((n, KINDS))
    hit = (kind == INSULT) | (kind == THREAT)
    if not hit.any():
        return out
    fresh = np.ones(len(clause), bool)
    fresh[1:] = clause[1:] != clause[:-1]
    fresh[first[:-1][first[:-1] < first[1:]]] = True
    at = np.flatnonzero(fresh)
    size = np.diff(np.append(at, len(clause)))
    matched = np.flatnonzero(np.logical_or.reduceat(hit, at))
    matched = matched[np.argsort(-size[matched], kind="stable")]
    begin, length = at[matched], size[matched]
    state = np.zeros(len(matched), np.int16)
    for step in range(int(length[0])):  # all matched clauses read one word at a time, the longest last
        live = int(np.searchsorted(-length, -step, side="left"))
        state[:live] = STEP[state[:live], kind[begin[:live] + step]]
    total = np.concatenate(([0.0], np.cumsum(weight * PAYS[kind])))
    text = np.searchsorted(first, begin, side="right") - 1
    np.add.at(out, (text, KIND[state]), total[begin + length] - total[begin])
    return out


def shape(scores: np.ndarray) -> np.ndarray:
    return np.log1p(scores)


def closed_classes() -> dict[int, tuple[int, float]]:
    out = {}
    for kind, text, weight in ((TARGET, TARGETS, 0.0), (NEGATION, NEGATIONS, 0.0), (REPORT, REPORTS, 0.0), (THREAT, THREATS, 1.0)):
        out |= {hash_of(w): (kind, weight) for w in text.split()}
    return out


def lexicons(known: dict[int, tuple[int, float]], stems: dict[int, float]) -> tuple[words.Lookup, words.Lookup]:
    return (
        words.Lookup(np.array(list(known), np.uint64), np.array(list(known.values()) or np.zeros((0, 2)))),
        words.Lookup(np.array(list(stems), np.uint64), np.array(list(stems.values()))),
    )


def telling(ids: list[np.ndarray], label: np.ndarray) -> dict[int, float]:
    """Hashes that toxic texts hold far more often than others, with their log odds."""
    n = np.array([(label == 0).sum(), (label == 1).sum()])
    if not n.all():
        return {}
    seen = [np.unique(np.concatenate([x for x, y in zip(ids, label, strict=True) if y == k]), return_counts=True) for k in (0, 1)]
    common = seen[1][1] >= max(LEAST_TEXTS, LEAST_SHARE * n[1])
    key, toxic = seen[1][0][common], seen[1][1][common]
    place = np.minimum(np.searchsorted(seen[0][0], key), max(0, len(seen[0][0]) - 1))
    clean = np.where(seen[0][0][place] == key, seen[0][1][place], 0) if len(seen[0][0]) else np.zeros(len(key))
    odds = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
    good = (odds > 3) & (clean <= 0.05 * toxic)
    return {int(k): float(o) for k, o in zip(key[good], odds[good], strict=True) if k}


def train(batches: list[pa.RecordBatch]) -> bytes:
    """Lexicons and the weights of the kinds, pickled."""
    parts, label, ids, stem_ids = [], [], [], []
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, at in words.chunks(batch.column(0)):
            full, stems, clause, first = read(data, at)
            parts.append((full, stems, clause, first))
            label += list(y[lo:hi])
            for a, b in zip(first[:-1], first[1:], strict=True):
                ids.append(np.unique(full[a:b]))
                stem_ids.append(np.unique(stems[:, a:b]))
    label = np.array(label, int)
    stems = telling(stem_ids, label)
    known = {k: (INSULT, v) for k, v in telling(ids, label).items()} | closed_classes()
    lexicon, stem_lexicon = lexicons(known, stems)
    w, b = np.ones(KINDS), 0.0
    if len(label) and 0 < label.sum() < len(label):
        x = shape(np.concatenate([clause_scores(*classes(lexicon, stem_lexicon, f, s), c, at) for f, s, c, at in parts]))
        w, b = np.zeros(KINDS), float(np.log(label.mean() / (1 - label.mean())))
        hessian = np.zeros((KINDS + 1, KINDS + 1))
        x1 = np.column_stack((x, np.ones(len(x))))
        theta = np.append(w, b)
        for _ in range(30):  # Newton steps with a ridge: few features, one bounded sample
            p = 1 / (1 + np.exp(-np.clip(x1 @ theta, -30, 30)))
            ridge = np.append(np.full(KINDS, 0.1), 1e-6)
            hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge)
            theta = theta - np.linalg.solve(hessian, x1.T @ (p - label) + ridge * theta)
        w, b = theta[:-1], theta[-1]
    return pickle.dumps({"known": known, "stems": stems, "weights": w, "intercept": b})


def score_texts(model: dict, lookups: tuple[words.Lookup, words.Lookup], column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for lo, hi, data, at in words.chunks(column):
        full, stems, clause, first = read(data, at)
        x = shape(clause_scores(*classes(*lookups, full, stems), clause, first))
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(x @ model["weights"] + model["intercept"], -30, 30)))
    return out


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> bytes:
    """Model from ``labels`` (``doc_id``, ``label``) of the texts in ``docs``."""
    return labelled.fit(labelled.sample(docs, labels, limit), train)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id`` and ``score``, the probability of being toxic, for every row of ``docs``."""

    def run(batches):
        known = pickle.loads(model)
        lookups = lexicons(known["known"], known["stems"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(known, lookups, batch.column(1)))], ["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
