"""Language of words and documents by a linear-chain conditional random field.

Each word of a text gets a language.  Features of a word are its affixes, its
character n-grams and itself (the lexicon), hashed into one table of weights per
language; neighbouring words are tied by learned transitions.  Forward-backward gives
the probability of each language at each word, so a text that switches languages is
labelled piece by piece.  A document gets the language with the largest sum over its
words, weighted by letters; that share is the score.

Training.  Documents carry one language each.  A bounded sample of them is drawn per
language (SAMPLE rows of about SPAN characters from their middle), and training
sequences are made by putting pieces of several documents after each other, so that
switches occur and transitions are learned.  Maximum likelihood by AdaGrad with
numpy on the driver; the model has a fixed size.

Prediction runs where the rows are, without a shuffle.  Words are coded once per
batch, all sequences of a batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fieldloom.llm.common import materialize, query, slices, table
from fieldloom.llm.shingles import mix

#: Rows a language is learned from, characters of each, hashed features, longest affix and n-gram in bytes.
SAMPLE, SPAN, FEATURES, AFFIX, GRAM = 300, 1500, 1 << 17, 4, 3
#: Passes, sequences of a step, pieces and words of a sequence, step size, weight of the prior.
PASSES, STEP, PIECES, PIECE_WORDS, RATE, PRIOR, SEED = 3, 32, 4, 15, 0.5, 1e-6, 7
UNKNOWN = "und"
#: What is no letter (nor a mark on one) ends a word.
NO_LETTER = r"[^\p{L}\p{M}]+"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of the words of all texts in order, words per text, the distinct words."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), NO_LETTER, " ")
    lists = pc.split_pattern(pc.utf8_trim(clean, " "), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" not in words:
        return codes, counts, words
    keep = codes != words.index("")
    row = np.repeat(np.arange(len(counts)), counts)[keep]
    return codes[keep], np.bincount(row, minlength=len(counts)).astype(np.int64), words


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words one after the other, and how many each has."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    lengths = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw) + b"\x00" * (AFFIX + 2), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(row)) - starts[row]
    left = lengths[row] - place
    rows, values = [], []
    for size in range(1, AFFIX + 2):
        value = np.full(len(row), size, np.uint64)
        for k in range(size):
            value = mix(value * np.uint64(257) + data[: len(row) + k][k:])
        # n-grams anywhere; longer ones only at the start or the end, as affixes
        fits = (left >= size) & ((size <= GRAM) | (place == 0) | (left == size))
        rows.append(row[fits])
        values.append(value[fits])
    whole = np.zeros(len(words), np.uint64)
    sums = np.concatenate([[0], np.cumsum(mix(data[: len(row)] + np.uint64(1) + place.astype(np.uint64) * np.uint64(1 << 32)), dtype=np.uint64)]).astype(np.uint64)
    if len(words):
        whole = mix(sums[starts + lengths] - sums[starts])
    rows.append(np.arange(len(words)))
    values.append(whole)
    row, value = np.concatenate(rows), (np.concatenate(values) % np.uint64(FEATURES)).astype(np.int64)
    order = np.argsort(row, kind="stable")
    return value[order], np.bincount(row, minlength=len(words))


def emissions(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Scores of each word for each language: the mean weight of its features, sharpened by their number's root."""
    values, counts = features_of(words)
    if not len(words):
        return np.zeros((0, weights.shape[1]))
    sums = np.add.reduceat(weights[values], np.cumsum(counts) - counts, axis=0)
    return sums / np.sqrt(counts)[:, None]


def forward_backward(scores: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward values and emissions, all sequences at once; scores: those of all words, sequence after sequence."""
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    starts, sizes = starts[order], counts[order]
    jump = np.exp(transition - transition.max())
    local = scores - scores.max(axis=1, keepdims=True) if len(scores) else scores
    np.exp(local, out=local)
    ahead, back = np.empty_like(local), np.ones_like(local)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences longer than each place
    state = None
    for t in range(longest):
        at = starts[: active[t]] + t
        state = local[at] if t == 0 else (state[: active[t]] @ jump) * local[at]
        state = state / state.sum(axis=1, keepdims=True)
        ahead[at] = state
    state = None
    for t in range(longest - 1, 0, -1):
        at = starts[: active[t]] + t
        now = np.ones((active[t], local.shape[1]))
        if state is not None:
            now[: len(state)] = state
        state = (now * local[at]) @ jump.T
        state = state / state.sum(axis=1, keepdims=True)
        back[at - 1] = state
    return ahead, back, local


def posteriors(scores: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability of each language at each word."""
    both, back, _ = forward_backward(scores, counts, transition)
    both *= back
    if len(both):
        both /= both.sum(axis=1, keepdims=True)
    return both


def expected_transitions(scores: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities at each word, and how often each language is expected to follow each other one."""
    ahead, back, local = forward_backward(scores, counts, transition)
    inner = np.ones(len(scores), bool)
    inner[np.cumsum(counts)[counts > 0] - 1] = False
    i = np.nonzero(inner)[0]
    pair = ahead[i][:, :, None] * np.exp(transition)[None] * (local[i + 1] * back[i + 1])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True), pair.sum(axis=0)


class Model:
    """Weights of features and transitions for a list of languages."""

    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray):
        self.languages, self.weights, self.transition = languages, weights, transition

    def word_posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of each word, words per text, letters of each word."""
        codes, counts, words = words_of(texts)
        scores = emissions(self.weights, words)
        letters = np.array([len(w) for w in words], float)
        return posteriors(scores[codes], counts, self.transition), counts, letters[codes] if len(words) else np.empty(0)

    def label(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        found, counts, letters = self.word_posteriors(texts)
        row = np.repeat(np.arange(len(counts)), counts)
        sums = np.stack([np.bincount(row, weights=found[:, k] * letters, minlength=len(counts)) for k in range(len(self.languages))], axis=1)
        total = np.maximum(sums.sum(axis=1), 1e-300)
        best = sums.argmax(axis=1)
        names = np.array(self.languages, object)[best]
        names[counts == 0] = UNKNOWN
        return names.tolist(), np.where(counts > 0, np.minimum(1.0, sums[np.arange(len(best)), best] / total), 0.0)


def sequences(codes: np.ndarray, counts: np.ndarray, label: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences: pieces of documents in a random order, each word with its document's language."""
    starts = np.cumsum(counts) - counts
    pieces = [(codes[s + i : s + min(i + PIECE_WORDS, n)], y) for s, n, y in zip(starts, counts, label, strict=True) for i in range(0, n, PIECE_WORDS)]
    # neighbours from one document stay together more often than not
    blocks = [pieces[i : i + 2] for i in range(0, len(pieces), 2)]
    flat = [p for k in rng.permutation(len(blocks)) for p in blocks[k]]
    out = []
    for i in range(0, len(flat), PIECES):
        some = flat[i : i + PIECES]
        out.append((np.concatenate([c for c, _ in some]), np.concatenate([np.full(len(c), y) for c, y in some])))
    return out


def train(texts: list[str], labels: list[str], seed: int = SEED) -> Model:
    """Maximum likelihood of the label sequences; the gradient is the difference of observed and expected counts."""
    languages = sorted(set(labels))
    size = len(languages)
    weights, transition = np.zeros((FEATURES, size)), np.zeros((size, size))
    if size < 2:
        return Model(languages or [UNKNOWN], weights[:, : max(size, 1)] if size else np.zeros((FEATURES, 1)), np.zeros((max(size, 1),) * 2))
    codes, counts, words = words_of(pa.array(texts, pa.string()))
    values, per = features_of(words)
    first = np.cumsum(per) - per
    rng = np.random.default_rng(seed)
    made = sequences(codes, counts, np.array([languages.index(y) for y in labels]), rng)
    squares, tsquares = np.full(weights.shape, 1e-2), np.full(transition.shape, 1e-2)
    for _ in range(PASSES):
        for some in np.array_split(rng.permutation(len(made)), max(1, len(made) // STEP)):
            batch = [made[k] for k in some]
            word = np.concatenate([c for c, _ in batch])
            gold = np.concatenate([y for _, y in batch])
            sizes = np.array([len(c) for c, _ in batch])
            local, inverse = np.unique(word, return_inverse=True)
            at = np.concatenate([np.arange(first[w], first[w] + per[w]) for w in local])
            feats, root = values[at], np.sqrt(per[local])
            bounds = np.cumsum(per[local]) - per[local]
            scores = (np.add.reduceat(weights[feats], bounds, axis=0) / root[:, None])[inverse]
            found, expected = expected_transitions(scores, sizes, transition)
            error = found.copy()
            error[np.arange(len(gold)), gold] -= 1
            by_word = np.stack([np.bincount(inverse, weights=error[:, k], minlength=len(local)) for k in range(size)], axis=1) / root[:, None] / len(gold)
            touched, place = np.unique(feats, return_inverse=True)
            spread = np.repeat(by_word, per[local], axis=0)
            grad = np.stack([np.bincount(place, weights=spread[:, k], minlength=len(touched)) for k in range(size)], axis=1) + PRIOR * weights[touched]
            squares[touched] += grad * grad * len(gold)
            weights[touched] -= RATE * grad * np.sqrt(len(gold)) / np.sqrt(squares[touched])
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(sizes) - 1] = False
            i = np.nonzero(inner)[0]
            observed = np.zeros_like(transition)
            np.add.at(observed, (gold[i], gold[i + 1]), 1)
            tgrad = (expected - observed) / max(1, len(i))
            tsquares += tgrad * tgrad
            transition -= 0.1 * tgrad / np.sqrt(tsquares)
    return Model(languages, weights.astype(np.float32), transition)


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, span: int = SPAN) -> Model:
    """A model of the labelled documents that are not held out.

    About ``sample`` rows of each language are drawn by a digest of the id, and ``span`` characters
    of each from the middle.  Only those reach the driver.  Without any such row the only language is ``und``.
    """
    key, lang = F.col(id_col), F.col(lang_col)
    rows = docs.filter(~is_held_out(key) & lang.isNotNull() & F.col(text_col).isNotNull())
    sizes = materialize(rows.groupBy(lang.alias("_of")).agg(F.count(F.lit(1)).alias("_rows")))  # one row a language
    share = F.least(F.lit(1.0), 1.2 * sample / F.col("_rows"))
    draw = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1_000_000)) / 1_000_000
    middle = F.substr(F.col(text_col), F.greatest(F.lit(1), F.floor((F.length(text_col) - span) / 2).cast("int")), F.lit(span))
    some = rows.select(key.cast("string").alias("id"), lang.alias("lang"), middle.alias("text"), draw.alias("_draw")).join(F.broadcast(sizes), F.col("lang") == F.col("_of")).filter(F.col("_draw") < share).select("id", "lang", "text")
    drawn = sorted(some.limit(2 * sample * max(1, sizes.count())).collect(), key=lambda r: (r["lang"], r["id"] or "", r["text"]))  # the documented bound
    return train([r["text"] for r in drawn], [r["lang"] for r in drawn])


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``; columns of these names are replaced.

    A null text or one without a letter is ``und`` with score 0.  Rows that repeat get the
    same result, an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    base = docs.select(*kept)
    shared = base.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.transition))  # of a fixed size

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for batch in slices(whole, text_col, (4 << 20) // max(4, len(own.languages))):  # words times languages are held
                names, scores = own.label(batch.column(text_col))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_out, score_out])

    schema = StructType([*base.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())])
    return base.mapInArrow(label, schema)


@query()
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = table(spark, folder, "documents")
    model = learn(docs)
    rows = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, model).drop("text")
