"""Language identification by a linear-chain conditional random field over words.

Each word has features: itself (lexicon), its leading and trailing three bytes (affixes) and
its byte trigrams with the word's borders. Their weights and the weights of label changes
between neighbours are learned together by maximum likelihood, with gradients from
forward-backward. Training sequences switch language every few words, as code-switched text
does, so that changes are learned from examples. A text's words get label probabilities by
forward-backward over the whole text; its language is the label with the largest expected
share of its words.

The recursion over a text is cut into blocks of words whose transfer matrices are multiplied
for all blocks of a batch at once, so that long texts cost no more per word than short ones
and the result is that of the plain recursion.

Defined results: a null text or one without letters is ``und`` with score 0; ties go to the
label that sorts first; with no labelled rows every text is ``und``; null labels are not
learned from; repeated rows are labelled each; other columns are ignored.

Shares of known labels sum to 1 for any text, also for one in a language that was never learned.
``keep`` therefore asks for evidence: the share of a text's trigrams, word by word, that the learned
texts of the word's language hold (sets of 2**24 bits, exact), expected over the word's label probabilities.
Letters that touch a digit are parts of keys and codes and say nothing of a language, unless a text has no others.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm import labelled, words
from notewell.llm.tables import bounded_batches, lean

TRAIN_ROWS = 2000  # bound of the labelled sample
UNKNOWN = "und"
BITS = 17  # rows of the weight table
BLOCK = 32  # words whose transfer matrices are multiplied before blocks are chained
SEQUENCE, BATCH, STEPS, RATE = 64, 32, 600, 0.3  # training: words a sequence, sequences a step, steps, step size
SEGMENT = (3, 24)  # words before a training sequence changes to another text
GRAMS = 3.0  # weight of a word's trigrams together
_LETTER = words.flags([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_FOLD = np.where(_LETTER, words.LOWER, 0x20).astype(np.uint8)


def _row(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def features(data: np.ndarray, at: np.ndarray):
    """Byte ranges of the words in the texts, their lexicon and affix rows, the trigram of each byte and the words' ranges in those, and each text's first word."""
    n = len(at) - 1
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(at))
    low = np.full(len(data) + n + 2, 0x20, np.uint8)  # a space between texts, so that no trigram sees two texts
    low[place] = _FOLD[data]
    starts, ends = words.find_words(low, np.array([0, len(low)]), _LETTER)
    prefix = words.prefix_hash(low)
    rows = np.empty((len(starts), 3), np.int32)
    rows[:, 0] = _row(words.mix(words.range_hash(prefix, starts, ends)))
    rows[:, 1] = _row(words.mix(words.range_hash(prefix, starts, np.minimum(starts + 3, ends)), 1))
    rows[:, 2] = _row(words.mix(words.range_hash(prefix, np.maximum(ends - 3, starts), ends), 2))
    wide = low.astype(np.uint32)
    gram = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    first = np.searchsorted(starts, at + np.arange(n + 1))
    shift = np.repeat(np.arange(1, n + 1), np.diff(first))
    return starts - shift, ends - shift, rows, gram, starts - 1, ends - 1, first


def gram_rows(gram: np.ndarray) -> np.ndarray:
    return ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)


def emissions(weights: np.ndarray, rows: np.ndarray, gram: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = weights[rows].sum(axis=1, dtype=np.float64)
    total = np.zeros((len(gram) + 1, weights.shape[1]))
    np.cumsum(weights[gram_rows(gram)], axis=0, dtype=np.float64, out=total[1:])
    return out + (total[b] - total[a]) * (GRAMS / (b - a))[:, None]


def marginals(emit: np.ndarray, change: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; ``first`` holds each text's first word, and the total at the end."""
    n_words, n_labels = emit.shape
    out = np.zeros((n_words, n_labels))
    if not n_words:
        return out
    size = np.diff(first)
    texts = np.flatnonzero(size)
    n_blocks = -(-size[texts] // BLOCK)
    base = np.cumsum(n_blocks) - n_blocks
    total = int(n_blocks.sum())
    begin = np.repeat(first[texts], n_blocks) + words.runs(n_blocks) * BLOCK
    width = np.minimum(BLOCK, np.repeat(first[texts] + size[texts], n_blocks) - begin)
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    step = np.exp(change - change.max())
    at = np.minimum(begin[:, None] + np.arange(BLOCK), n_words - 1)
    held = np.arange(BLOCK) < width[:, None]
    local = e[at]  # (blocks, words, labels)

    transfer = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
    for k in range(BLOCK):
        new = (transfer @ step) * local[:, k, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        transfer = np.where(held[:, k, None, None], new, transfer)

    enter, leave = np.ones((total, n_labels)), np.ones((total, n_labels))  # what stands before and after a block
    order = np.argsort(-n_blocks, kind="stable")
    ranked, ranked_base = n_blocks[order], base[order]
    for k in range(1, int(ranked[0])):
        live = int(np.searchsorted(-ranked, -k, side="left"))
        here = ranked_base[:live] + k
        v = np.einsum("bi,bij->bj", enter[here - 1], transfer[here - 1])
        enter[here] = v / v.max(axis=1, keepdims=True)
        back = ranked_base[:live] + ranked[:live] - 1 - k
        v = np.einsum("bij,bj->bi", transfer[back + 1], leave[back + 1])
        leave[back] = v / v.max(axis=1, keepdims=True)

    ahead = np.empty((BLOCK, total, n_labels))
    v, start = enter, np.zeros(total, bool)
    start[base] = True
    for k in range(BLOCK):
        moved = v @ step
        if not k:
            moved[start] = 1.0  # a text's first word has no label before it
        v = moved * local[:, k]
        v /= v.max(axis=1, keepdims=True)
        ahead[k] = v
    v = leave
    for k in range(BLOCK - 1, -1, -1):
        both = ahead[k] * v
        live = held[:, k]
        out[at[live, k]] = both[live] / both[live].sum(axis=1, keepdims=True)
        new = (local[:, k] * v) @ step.T
        new /= new.max(axis=1, keepdims=True)
        v = np.where(live[:, None], new, v)
    return out


def _gradient(emit: np.ndarray, change: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed labels and label pairs for sequences of equal length (sequences, words, labels)."""
    b, t, n = emit.shape
    e, step = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(change - change.max())
    ahead, back = np.empty((t, b, n)), np.ones((t, b, n))
    ahead[0] = e[:, 0]
    for k in range(1, t):
        v = (ahead[k - 1] @ step) * e[:, k]
        ahead[k] = v / v.sum(axis=1, keepdims=True)
    for k in range(t - 2, -1, -1):
        v = (back[k + 1] * e[:, k + 1]) @ step.T
        back[k] = v / v.sum(axis=1, keepdims=True)
    own = ahead * back
    own /= own.sum(axis=2, keepdims=True)
    pair = ahead[:-1, :, :, None] * step * (e.transpose(1, 0, 2)[1:] * back[1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    pairs = pair.sum(axis=(0, 1))
    np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1.0)
    own = own.transpose(1, 0, 2).copy()
    own[np.arange(b)[:, None], np.arange(t), gold] -= 1.0
    return own, pairs


def train(labels: list[str]):
    """A training function for texts labelled with positions in ``labels``."""

    def run(batches: list[pa.RecordBatch]) -> bytes:
        rows_of, grams, a_of, b_of, text_label, text_range, n, at_gram = [], [], [], [], [], [], 0, 0
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in words.chunks(batch.column(0)):
                _, _, rows, gram, a, b, first = features(data, at)
                rows_of.append(rows)
                grams.append(gram)
                a_of.append(a + at_gram)
                b_of.append(b + at_gram)
                full = np.flatnonzero(np.diff(first))
                text_label += list(y[lo:hi][full])
                text_range += [(n + first[k], n + first[k + 1]) for k in full]
                n, at_gram = n + len(rows), at_gram + len(gram)
        size = len(labels)
        known = [np.zeros(0, np.uint32)] * size  # the trigrams of each label's texts
        weights, change = np.zeros((1 << BITS, size), np.float32), np.zeros((size, size))
        if text_range and size:
            rows, gram, a, b = np.concatenate(rows_of), np.concatenate(grams), np.concatenate(a_of), np.concatenate(b_of)
            text_label = np.array(text_label, int)
            of = [np.flatnonzero(text_label == k) for k in range(size)]
            word_label = np.repeat(text_label, [hi - lo for lo, hi in text_range])
            for k in range(size):
                lo, hi = a[word_label == k], b[word_label == k]
                known[k] = np.unique(gram[words.runs(hi - lo) + np.repeat(lo, hi - lo)])
            gram = gram_rows(gram)
            del rows_of, grams, a_of, b_of
            seen = [k for k in range(size) if len(of[k])]
            square, square_change = np.full(weights.shape, 1e-6, np.float32), np.full(change.shape, 1e-6)
            draw = np.random.default_rng(7)
            for _ in range(STEPS):
                pick, gold = np.empty((BATCH, SEQUENCE), np.int64), np.empty((BATCH, SEQUENCE), np.int64)
                for s in range(BATCH):
                    k = 0
                    while k < SEQUENCE:
                        label = seen[draw.integers(len(seen))]
                        lo, hi = text_range[of[label][draw.integers(len(of[label]))]]
                        m = min(int(draw.integers(*SEGMENT)), SEQUENCE - k, hi - lo)
                        w = lo + int(draw.integers(hi - lo - m + 1))
                        pick[s, k : k + m], gold[s, k : k + m] = np.arange(w, w + m), label
                        k += m
                flat = pick.ravel()
                count = b[flat] - a[flat]
                index = np.repeat(a[flat], count) + words.runs(count)
                word_of = np.repeat(np.arange(len(flat)), count)
                share = GRAMS / count
                emit = weights[rows[flat]].sum(axis=1, dtype=np.float64) + np.add.reduceat(weights[gram[index]].astype(np.float64), np.cumsum(count) - count) * share[:, None]
                own, pairs = _gradient(emit.reshape(BATCH, SEQUENCE, size), change, gold)
                own = own.reshape(-1, size) / BATCH
                ids = np.concatenate((rows[flat].ravel(), gram[index]))
                grads = np.concatenate((np.repeat(own, 3, axis=0), (own * share[:, None])[word_of]))
                uniq, inverse = np.unique(ids, return_inverse=True)
                g = np.column_stack([np.bincount(inverse, grads[:, k], len(uniq)) for k in range(size)]) + 1e-4 * weights[uniq]
                square[uniq] += g * g
                weights[uniq] -= RATE * g / np.sqrt(square[uniq])
                pairs = pairs / BATCH + 1e-4 * change
                square_change += pairs * pairs
                change -= RATE * pairs / np.sqrt(square_change)
        return pickle.dumps({"labels": labels, "weights": weights.tobytes(), "change": change, "grams": known})

    return run


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> bytes:
    """Model from ``labels`` (``doc_id``, ``label`` as text) of the texts in ``docs``."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
    names = sorted(r["label"] for r in known.select("label").distinct().collect())  # the languages
    number = F.coalesce(*[F.when(F.col("label") == name, k) for k, name in enumerate(names)], F.lit(None).cast("int")) if names else F.lit(None).cast("int")
    return labelled.fit(labelled.sample(docs, known.select("doc_id", number.alias("label")), limit, len(names)), train(names))


def _flags(grams: list[np.ndarray]) -> np.ndarray:
    seen = np.zeros(1 << 24, bool)
    for some in grams:
        seen[some] = True
    return np.packbits(seen)


def known_grams(model: bytes) -> np.ndarray:
    """Flags of all trigrams, eight in a byte, set for those of the learned texts."""
    return _flags(pickle.loads(model)["grams"])


def known_grams_of_labels(model: bytes) -> list[np.ndarray]:
    """As ``known_grams``, for the learned texts of each label."""
    return [_flags([some]) for some in pickle.loads(model)["grams"]]


def _known_share(grams: np.ndarray, gram: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of known trigrams of each word."""
    known = grams[gram >> np.uint32(3)] >> (7 - (gram & np.uint32(7))).astype(np.uint8) & 1
    seen = np.concatenate(([0], np.cumsum(known, dtype=np.int32)))
    return (seen[b] - seen[a]) / (b - a)


def _mean(of_words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean over the words of each text; 0 without words."""
    total = np.concatenate((np.zeros((1, *of_words.shape[1:])), np.cumsum(of_words, axis=0)))
    size = np.maximum(1, np.diff(first)).reshape(-1, *[1] * (of_words.ndim - 1))
    return (total[first[1:]] - total[first[:-1]]) / size


def evidence(grams: np.ndarray, column: pa.Array) -> np.ndarray:
    """The mean share of known trigrams over the words of each text; 0 without words."""
    out = np.zeros(len(column))
    for lo, hi, data, at in words.chunks(column):
        _, _, _, gram, a, b, first = features(data, at)
        out[lo:hi] = _mean(_known_share(grams, gram, a, b), first)
    return out


def unpack(model: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    known = pickle.loads(model)
    return known["labels"], np.frombuffer(known["weights"], np.float32).reshape(1 << BITS, len(known["labels"])) if known["labels"] else None, known["change"]


def _labelled(labels: list[str], weights, change, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Label (-1: none) and share of each text."""
    best, score = np.full(len(column), -1), np.zeros(len(column))
    for lo, hi, data, at in words.chunks(column) if labels else ():
        _, _, rows, gram, a, b, first = features(data, at)
        mass = np.round(_mean(marginals(emissions(weights, rows, gram, a, b), change, first), first), 9)  # sums of a batch differ in the last digits
        best[lo:hi] = np.where(np.diff(first) > 0, mass.argmax(axis=1), -1)
        score[lo:hi] = np.clip(mass.max(axis=1), 0, 1)
    return best, np.where(best < 0, 0.0, score)


def _touch_digits(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words (byte ranges in their texts) have a digit right before or behind them."""
    digit = np.append((data >= 0x30) & (data <= 0x39), False)
    return (digit[starts - 1] & (starts > at[text])) | (digit[ends] & (ends < at[text + 1]))


def labelled_evidence(labels: list[str], weights, change, grams: list[np.ndarray], column: pa.Array) -> np.ndarray:
    """As ``evidence``, over the words that touch no digit (all, if there are no others), each word's trigrams judged by the texts of each label (``grams``) in the proportion of the word's label probabilities."""
    out = np.zeros(len(column))
    for lo, hi, data, at in words.chunks(column) if labels else ():
        starts, ends, rows, gram, a, b, first = features(data, at)
        p = marginals(emissions(weights, rows, gram, a, b), change, first)
        of_words = sum(p[:, k] * _known_share(known, gram, a, b) for k, known in enumerate(grams))
        text = np.repeat(np.arange(hi - lo), np.diff(first))
        counts = ~_touch_digits(data, at, starts, ends, text)
        size = np.bincount(text, counts, hi - lo)
        counts |= size[text] == 0
        total = np.bincount(text, of_words * counts, hi - lo)
        out[lo:hi] = np.round(total / np.maximum(1, np.bincount(text, counts, hi - lo)), 9)  # sums of a batch differ in the last digits
    return out


def _with_letters(docs: DataFrame) -> DataFrame:
    """``docs`` and, last, whether the text has a letter."""
    bounded_batches(docs.sparkSession)
    return docs.select("*", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def predict(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: the label with the largest expected share of the words, and that share."""

    def run(batches):
        known = unpack(model)
        for batch in batches:
            best, score = _labelled(*known, batch.column(1))
            best = np.where(batch.column(2).to_numpy(zero_copy_only=False), best, -1)
            names = pa.array([known[0][k] if k >= 0 else UNKNOWN for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(np.where(best < 0, 0.0, score))], ["doc_id", "lang_pred", "score"])

    rows = _with_letters(docs.select("doc_id", "text"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep(docs: DataFrame, model: bytes, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have a language and, of their trigrams, at least the share ``least`` in common with the learned texts of the languages of their words."""
    text = docs.columns.index("text")

    def run(batches):
        known, grams = unpack(model), known_grams_of_labels(model)
        for batch in batches:
            good = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) & (len(known[0]) > 0)
            good = good & (labelled_evidence(*known, grams, batch.column(text)) >= least)
            yield batch.filter(pa.array(good)).select(list(range(batch.num_columns - 1)))

    return _with_letters(docs).mapInArrow(lean(run), docs.schema)


def spans(docs: DataFrame, model: bytes) -> DataFrame:
    """Runs of words of one language: ``doc_id, start, end`` (UTF-8 bytes), ``lang`` and the mean probability of its words."""

    def run(batches):
        labels, weights, change = unpack(model)
        for batch in batches:
            source, begin, end, lang, score = [], [], [], [], []
            for lo, _, data, at in words.chunks(batch.column(1)) if labels else ():
                starts, ends, rows, gram, a, b, first = features(data, at)
                p = marginals(emissions(weights, rows, gram, a, b), change, first)
                best, text = p.argmax(axis=1), np.repeat(np.arange(len(at) - 1), np.diff(first))
                if not len(best):
                    continue
                new = np.ones(len(best), bool)
                new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
                run_at = np.flatnonzero(new)
                stop = np.append(run_at[1:], len(best)) - 1
                mean = np.add.reduceat(p.max(axis=1), run_at) / (stop - run_at + 1)
                source += list(text[run_at] + lo)
                begin += list(starts[run_at] - at[text[run_at]])
                end += list(ends[stop] - at[text[run_at]])
                lang += [labels[k] for k in best[run_at]]
                score += list(mean)
            ids = batch.column(0).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "start", "end", "lang", "probability"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, end long, lang string, probability double")
