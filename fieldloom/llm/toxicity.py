"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling.

A text is cut into windows of WINDOW words, each STEP words after the one before and the last one at the end of
the text, so all words are read and neighbours share words.  A word enters by two inputs: an embedding of the word and
the scaled sum of the embeddings of its characters' n-grams and affixes.  One recurrent layer reads a window
forwards, one backwards; attention weighs the places; a logistic unit scores the window.  A
text's score is that of its most toxic window.

Learning, in numpy on the driver, from a bounded sample (at most SAMPLE rows of each label, SPAN
characters from the middle of each).  A label says that some window of the text is toxic,
not which: the highest window of each text is searched for, then learned from, several times over;
those that were once the highest of a clean text stay among the examples.  The first coordinate of an embedding starts at
the log odds of its word or n-gram among the sampled texts; those in fewer than
LEAST texts stay at zero, so rare words say nothing.  Gradients are exact (the tests compare differences).

Scoring runs where the rows are, without a shuffle; the network has a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldloom.llm.common import query, slices, table, unused
from fieldloom.llm.language import words_of
from fieldloom.llm.shingles import mix, shingle_sets

#: Words of a window, words from one window to the next, width of each word's two inputs, units of a direction.
WINDOW, STEP, WIDTH, UNITS = 20, 10, 8, 8
#: Numbers for words and for n-grams, bytes of an n-gram, of the longest prefix and suffix (a word's ends count as bytes).
FEATURES, GRAM, PREFIX, SUFFIX = 1 << 17, 3, 9, 6
#: Rows a label is learned from, characters of each, texts a word or n-gram must be in, words of a shingle by which copies are told.
SAMPLE, SPAN, LEAST, SHINGLE = 2500, 3000, 4, 5
#: Searches for the highest windows, passes after each, windows of a step, step sizes, share of words left to their n-grams, standard errors taken off log odds, seed.
SEARCHES, PASSES, GROUP, RATE, WORD_RATE, DROP, DOUBT, SEED = 4, 2, 64, 0.01, 0.003, 0.3, 1.2, 11
#: A text is predicted toxic from this score on.
THRESHOLD = 0.7
#: Windows read at a time, words whose n-grams are held at a time, texts counted at a time, bytes of text a task holds as words.
AT_ONCE, WORDS_AT_ONCE, TEXTS_AT_ONCE, RUN_BYTES = 2048, 1 << 14, 128, 2 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of each window, over texts of so many words put after each other."""
    over = np.maximum(counts - WINDOW, 0)
    each = np.where(counts > 0, 1 + -(-over // STEP), 0)
    text = np.repeat(np.arange(len(counts)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    start = np.minimum(nth * STEP, over[text]) + (np.cumsum(counts) - counts)[text]
    return text, start, np.minimum(counts, WINDOW)[text]


def read(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of windows, place by place, and which places are words."""
    place = np.arange(WINDOW)[:, None]
    held = place < size[None, :]
    return codes[np.where(held, start[None, :] + place, start[None, :])], held


def _recur(inputs: np.ndarray, held: np.ndarray, weights: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (places, windows, units) of one direction; a place that is no word keeps the state."""
    units = weights.shape[0]
    gates, new = weights[:, : 2 * units], weights[:, 2 * units :]
    state, out = np.zeros((inputs.shape[1], units), inputs.dtype), np.empty((*inputs.shape[:2], units), inputs.dtype)
    for t in range(len(inputs)):
        both = _sigmoid(inputs[t, :, : 2 * units] + state @ gates)
        keep, reset = both[:, :units], both[:, units:]
        cut = reset * state
        fresh = np.tanh(inputs[t, :, 2 * units :] + cut @ new)
        if trace is not None:
            trace.append((state, keep, reset, cut, fresh))
        state = np.where(held[t][:, None], fresh + keep * (state - fresh), state)
        out[t] = state
    return out


def _recur_back(grad: np.ndarray, held: np.ndarray, weights: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the recurrent weights from those of the states."""
    units = weights.shape[0]
    gates, new = weights[:, : 2 * units], weights[:, 2 * units :]
    to_inputs, to_weights = np.zeros((*grad.shape[:2], 3 * units)), np.zeros_like(weights)
    carried = np.zeros(grad.shape[1:])
    for t in range(len(grad) - 1, -1, -1):
        state, keep, reset, cut, fresh = trace[t]
        total = grad[t] + carried
        moved = np.where(held[t][:, None], total, 0)
        to_fresh = moved * (1 - keep) * (1 - fresh * fresh)
        to_cut = to_fresh @ new.T
        to_gates = np.concatenate([moved * (state - fresh) * keep * (1 - keep), to_cut * state * reset * (1 - reset)], axis=1)
        carried = total - moved + moved * keep + to_cut * reset + to_gates @ gates.T
        to_inputs[t] = np.concatenate([to_gates, to_fresh], axis=1)
        to_weights[:, : 2 * units] += state.T @ to_gates
        to_weights[:, 2 * units :] += cut.T @ to_fresh
    return to_inputs, to_weights


def read_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word numbers of all texts in order, words per text, the distinct words; a word repeated in a row is read once."""
    codes, counts, words = words_of(texts)
    text = np.repeat(np.arange(len(counts)), counts)
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
    return codes[fresh], np.bincount(text[fresh], minlength=len(counts)), words


def without_copies(texts: list[str], toxic: list[int]) -> tuple[list[str], list[int]]:
    """One text of those with the same label and the same smallest shingle, which most near copies share."""
    values, counts = shingle_sets(pa.array(texts, pa.string()), SHINGLE)
    first = np.cumsum(counts) - counts
    seen, out = set(), []
    for k, y in enumerate(toxic):
        key = (y, int(values[first[k]]) if counts[k] else k)
        if key not in seen:
            seen.add(key)
            out.append(k)
    return [texts[k] for k in out], [toxic[k] for k in out]


class Network:
    """Embeddings of words and n-grams and the dense weights."""

    DENSE = ("in_ahead", "in_back", "bias_ahead", "bias_back", "re_ahead", "re_back", "look", "out", "offset")

    def __init__(self, words: np.ndarray, grams: np.ndarray, dense: dict[str, np.ndarray]):
        self.words, self.grams, self.dense = words, grams, dense

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        def normal(rows: int, columns: int) -> np.ndarray:
            return rng.standard_normal((rows, columns)) / np.sqrt(rows)

        dense = {
            "in_ahead": normal(2 * WIDTH, 3 * UNITS), "in_back": normal(2 * WIDTH, 3 * UNITS), "bias_ahead": np.zeros(3 * UNITS), "bias_back": np.zeros(3 * UNITS),
            "re_ahead": normal(UNITS, 3 * UNITS), "re_back": normal(UNITS, 3 * UNITS), "look": normal(2 * UNITS, 1)[:, 0], "out": normal(2 * UNITS, 1)[:, 0], "offset": np.zeros(1),
        }
        return cls(np.zeros((FEATURES, WIDTH)), np.zeros((FEATURES, WIDTH)), dense)

    def small(self) -> Network:
        """The same in single precision."""
        return Network(self.words.astype(np.float32), self.grams.astype(np.float32), {k: v.astype(np.float32) for k, v in self.dense.items()})

    def inputs(self, whole: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Both inputs of each word: its own embedding, the sum of its n-grams' by the root of their number."""
        out = np.zeros((len(whole), 2 * WIDTH), self.words.dtype)
        out[:, :WIDTH] = self.words[whole]
        first = np.concatenate([[0], np.cumsum(counts)])
        for at in range(0, len(whole), WORDS_AT_ONCE):
            end = min(at + WORDS_AT_ONCE, len(whole))
            sums = np.add.reduceat(self.grams[grams[first[at] : first[end]]], first[at:end] - first[at], axis=0)
            out[at:end, WIDTH:] = sums / np.sqrt(counts[at:end], dtype=self.grams.dtype)[:, None]
        return out

    def project(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each word gives to the gates of both directions."""
        return inputs @ self.dense["in_ahead"] + self.dense["bias_ahead"], inputs @ self.dense["in_back"] + self.dense["bias_back"]

    def forward(self, ahead: np.ndarray, back: np.ndarray, word: np.ndarray, held: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Log odds of windows, from the projected words."""
        own: tuple[list, list] | tuple[None, None] = ([], []) if trace is not None else (None, None)
        states = np.concatenate([
            _recur(ahead[word], held, self.dense["re_ahead"], own[0]),
            _recur(back[word[::-1]], held[::-1], self.dense["re_back"], own[1])[::-1],
        ], axis=2)
        look = np.where(held, states @ self.dense["look"], -np.inf)
        share = np.exp(look - look.max(axis=0))
        share = share / share.sum(axis=0)
        pooled = (share[:, :, None] * states).sum(axis=0)
        if trace is not None:
            trace.update(ahead=own[0], back=own[1], states=states, share=share, pooled=pooled)
        return pooled @ self.dense["out"] + self.dense["offset"][0]

    def backward(self, inputs: np.ndarray, word: np.ndarray, held: np.ndarray, trace: dict, error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense weights and of the words' inputs, from those of the log odds."""
        states, share, d = trace["states"], trace["share"], self.dense
        to_pooled = error[:, None] * d["out"][None, :]
        to_share = (states * to_pooled[None]).sum(axis=2)
        to_look = share * (to_share - (share * to_share).sum(axis=0))
        to_states = share[:, :, None] * to_pooled[None] + to_look[:, :, None] * d["look"][None, None, :]
        grads = {"out": error @ trace["pooled"], "offset": np.array([error.sum()]), "look": np.einsum("tb,tbu->u", to_look, states)}
        to_ahead, grads["re_ahead"] = _recur_back(to_states[:, :, :UNITS], held, d["re_ahead"], trace["ahead"])
        to_back, grads["re_back"] = _recur_back(to_states[::-1, :, UNITS:], held[::-1], d["re_back"], trace["back"])
        to_back = to_back[::-1]
        to_inputs = np.zeros_like(inputs)
        for name, grad in (("ahead", to_ahead), ("back", to_back)):
            by_word = np.zeros((len(inputs), 3 * UNITS))
            np.add.at(by_word, word[held], grad[held])
            grads[f"in_{name}"], grads[f"bias_{name}"] = inputs.T @ by_word, by_word.sum(axis=0)
            to_inputs += by_word @ d[f"in_{name}"].T
        return grads, to_inputs

    def score(self, texts: pa.Array) -> np.ndarray:
        """Each text's score; 0 for a text without words."""
        codes, counts, words = read_words(texts)
        text, start, size = windows_of(counts)
        out = np.zeros(len(counts))
        if not len(text):
            return out
        top = highest(odds := self.odds(codes, start, size, *split_features(words)), text)
        out[text[top]] = _sigmoid(odds[top])
        return out

    def odds(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of all windows, a number of them at a time; words are projected once."""
        ahead, back = self.project(self.inputs(whole, grams, counts))
        out = np.empty(len(start))
        for at in range(0, len(start), AT_ONCE):
            out[at : at + AT_ONCE] = self.forward(ahead, back, *read(codes, start[at : at + AT_ONCE], size[at : at + AT_ONCE]))
        return out


def highest(odds: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The place of the first highest window of each text that has one."""
    order = np.lexsort((np.arange(len(text)), -odds, text))
    return order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for so many places, one span after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def split_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words, of their n-grams and affixes word after word, and of these per word."""
    some = [_split_features(words[i : i + WORDS_AT_ONCE]) for i in range(0, max(1, len(words)), WORDS_AT_ONCE)]
    return tuple(np.concatenate(x) for x in zip(*some, strict=True))


def _split_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw) + bytes(max(PREFIX, SUFFIX)), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    number = np.arange(len(raw))

    def coded(at: np.ndarray, length: int, kind: int) -> np.ndarray:
        value = np.full(len(at), 16 * length + kind, np.uint64)
        for k in range(length):
            value = value * np.uint64(257) + data[at + k]
        return (mix(value) % np.uint64(FEATURES)).astype(np.int64)

    inner = np.maximum(size - GRAM + 1, 1)  # a word has a character, so three bytes with its ends; the empty word is never read
    rows, values = [np.repeat(number, inner)], [coded(_spans(start, inner), GRAM, 0)]
    for kind, most in ((1, PREFIX), (2, SUFFIX)):
        for length in range(GRAM + 1, most + 1):
            some = number[size >= length]
            rows.append(some)
            values.append(coded(start[some] + (0 if kind == 1 else size[some] - length), length, kind))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(row, kind="stable")
    whole = np.fromiter((zlib.crc32(r) % FEATURES for r in raw), np.int64, len(raw))
    return whole, value[order].astype(np.int32), np.bincount(row, minlength=len(raw))


def _odds(row: np.ndarray, word: np.ndarray, features: np.ndarray, each: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each feature by the texts that hold it, and which are in at least LEAST texts.

    ``row``, ``word``: the distinct words of the texts in order; ``features``: those of the words, ``each`` of them.
    """
    yes, total = np.zeros(FEATURES), np.zeros(FEATURES, np.int64)
    first = np.cumsum(each) - each
    for low in range(0, len(toxic), TEXTS_AT_ONCE):
        a, b = np.searchsorted(row, [low, low + TEXTS_AT_ONCE])
        own, text = word[a:b], row[a:b] - low
        pairs = np.unique(np.repeat(text, each[own]) * FEATURES + features[_spans(first[own], each[own])])
        yes += np.bincount(pairs % FEATURES, weights=toxic[low + pairs // FEATURES], minlength=FEATURES)
        total += np.bincount(pairs % FEATURES, minlength=FEATURES)
    share = toxic.mean()
    log_odds = np.log((yes + LEAST * share) / (total - yes + LEAST * (1 - share))) - np.log(share / (1 - share))
    known = total >= LEAST
    # what a few texts of either kind give by chance says nothing
    sure = np.sign(log_odds) * np.maximum(np.abs(log_odds) - DOUBT * np.sqrt(1 / (yes + 1) + 1 / (total - yes + 1)), 0)
    return np.where(known, np.clip(sure, -3, 3), 0), known


def train(texts: list[str], toxic: list[int], seed: int = SEED) -> Network | float:
    """A network for these texts; the share of toxic ones where only one label occurs (0 without any text)."""
    texts, toxic = without_copies(texts, toxic)
    marks = np.array(toxic, float)
    codes, counts, words = read_words(pa.array(texts, pa.string()))
    if not len(codes) or marks.min() == marks.max():
        return float(marks.mean()) if len(marks) else 0.0
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    whole, grams, each = split_features(words)
    first_gram = np.cumsum(each) - each
    pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * len(words) + codes)
    row, word = pairs // len(words), pairs % len(words)
    net.words[:, 0], known_words = _odds(row, word, whole, np.ones(len(whole), np.int64), marks)
    net.grams[:, 0], known_grams = _odds(row, word, grams, each, marks)
    for held, some in ((net.words, known_words), (net.grams, known_grams)):
        held[some, 1:] = 0.1 * rng.standard_normal((int(some.sum()), WIDTH - 1))
    text, start, size = windows_of(counts)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.dense.items()}
    squares = (np.full(net.words.shape, 1e-6), np.full(net.grams.shape, 1e-6))
    step, clean = 0, np.empty(0, np.int64)
    for _ in range(SEARCHES):
        top = highest(net.small().odds(codes, start, size, whole, grams, each), text)
        is_toxic = marks[text[top]] == 1
        clean = np.union1d(clean, top[~is_toxic])
        examples = np.concatenate([top[is_toxic], clean])
        for _ in range(PASSES):
            for some in np.array_split(rng.permutation(examples), max(1, len(examples) // GROUP)):
                step += 1
                word, held = read(codes, start[some], size[some])
                local, inverse = np.unique(word, return_inverse=True)
                word, sizes = inverse.reshape(word.shape), each[local]
                gram = _spans(first_gram[local], sizes)
                inputs = net.inputs(whole[local], grams[gram], sizes)
                inputs[rng.random(len(local)) < DROP, :WIDTH] = 0  # so that n-grams learn what words would say alone
                trace: dict = {}
                odds = net.forward(*net.project(inputs), word, held, trace)
                grads, to_inputs = net.backward(inputs, word, held, trace, (_sigmoid(odds) - marks[text[some]]) / len(some))
                for name, grad in grads.items():
                    mean, square = moments[name]
                    mean += 0.1 * (grad - mean)
                    square += 0.001 * (grad * grad - square)
                    net.dense[name] -= RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
                to_inputs[~inputs[:, :WIDTH].any(axis=1), :WIDTH] = 0
                to_grams = np.repeat(to_inputs[:, WIDTH:] / np.sqrt(sizes)[:, None], sizes, axis=0)
                for table_, square, known, number, grad in (
                    (net.words, squares[0], known_words, whole[local], to_inputs[:, :WIDTH]), (net.grams, squares[1], known_grams, grams[gram], to_grams)
                ):
                    touched, place = np.unique(number, return_inverse=True)
                    total = np.zeros((len(touched), WIDTH))
                    np.add.at(total, place, grad)
                    total[~known[touched]] = 0
                    square[touched] += total * total
                    table_[touched] -= WORD_RATE * total / np.sqrt(square[touched])
    return net.small()


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, span: int = SPAN) -> Network | float:
    """A network learned from at most ``sample`` texts of each label, of ids that are not held out.

    Ids are drawn by a digest.  An id with several labels is toxic if one says so, one with several texts gives the
    smallest; null ids, labels and texts are not learned from.  Only ``span`` characters from the middle of each reach the driver.
    """
    key = F.col(id_col)
    marks = labels.filter(key.isNotNull() & ~is_held_out(key) & F.col(label_col).isNotNull())
    marks = marks.groupBy(key.alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
    drawn = None
    for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows
        share = min(1.0, 1.2 * sample / r["n"])
        draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("id")), F.lit(1_000_000)) / 1_000_000
        some = marks.filter((F.col("toxic") == r["toxic"]) & (draw < share)).limit(sample)
        drawn = some if drawn is None else drawn.unionByName(some)
    if drawn is None:
        return 0.0
    middle = F.substr(F.col(text_col), F.greatest(F.lit(1), F.floor((F.length(text_col) - span) / 2).cast("int")), F.lit(span))
    rows = docs.select(key.alias("id"), middle.alias("text")).filter(F.col("text").isNotNull())
    # at most 2 * sample ids
    found = rows.join(F.broadcast(drawn), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()
    found = sorted((str(r["id"]), r["toxic"], r["text"]) for r in found)
    return train([t for *_, t in found], [y for _, y, _ in found])


def predict(docs: DataFrame, model: Network | float, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """The rows with the score of their whole text; a column of this name is replaced, all others are kept.

    A null text or one without letters scores 0.  Rows that repeat get the same score, an empty table gives no rows.
    """
    base = docs.select(*[c for c in docs.columns if c != score_out or c == text_col])
    out = unused(base.columns, "_score") if score_out in base.columns else score_out
    shared = base.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, text_col, RUN_BYTES):
                scores = own.score(batch.column(text_col)) if isinstance(own, Network) else np.full(batch.num_rows, own)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    done = base.mapInArrow(run, StructType([*base.schema.fields, StructField(out, DoubleType())]))
    return done if out == score_out else done.drop(score_out).withColumnRenamed(out, score_out)


@query()
def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every whole text of ``documents``, learned from ``labels`` that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = predict(docs, learn(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
