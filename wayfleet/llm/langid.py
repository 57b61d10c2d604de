"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one. Each language has a probability for every piece of it, and the
probability of a word is the sum over all ways to cut it into pieces, which a forward pass adds up.
A text's score is the product over its words. The piece probabilities are fitted by expectation
maximisation: forward and backward passes give how often each piece is expected in the words of a
language, and those counts, added up by Spark, are the next probabilities.

Words are runs of letters in lower case, of any length: words of up to ``SHORT`` letters are scored many at
a time, longer ones each by itself and in logarithms, where no product can get too small. Texts are taken
as white-space separated tokens, whose scores, sums over their words, a worker remembers.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import cut, text_or_empty

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
ROUNDS = 3
SHORT = 24            # letters up to which the product of a word's piece probabilities is a normal number
FLOOR = 1e-6          # probability of a letter that is no piece, in every language
SMOOTH = 0.05         # added to each expected count
MEMO_TOKENS = 1 << 17 # tokens whose scores a worker remembers, also while it works on other stages
CHUNK = 1 << 21       # characters of text that are scored at a time
LOCAL_TOKENS = 1 << 20  # tokens that a task counts before it hands on its counts
SLOTS = 20            # bits of a hash that say whether any piece may have it
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
BASE = np.uint64(1_000_003)


@cache
def vocabulary(path: str) -> list[str]:
    """The pieces that can occur in lower-case words, word starts marked, in natural order."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p == p.lower() and (p.lstrip(START).isalpha() or p == START) and START not in p[1:])


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of ``words``, each behind the mark of a word start, padded with zeros."""
    joined = "".join((START + w).ljust(width + 1, "\0") for w in words)
    return np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(words), width + 1).astype(np.uint64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)


@cache
def _lookup(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes of the pieces in order, the piece each belongs to, the slots that are taken, and the greatest length."""
    hashes = []
    for piece in vocabulary(path):
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) % 2**64
        hashes.append(h)
    hashes = np.array(hashes, np.uint64)
    order = np.argsort(hashes)
    taken = np.zeros(1 << SLOTS, bool)
    taken[_slot(hashes)] = True
    return hashes[order], order, taken, max(map(len, vocabulary(path)))


def _pieces(hashes: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``hashes`` are those of pieces, and of which."""
    known, order, taken, _ = _lookup(path)
    rows = np.flatnonzero(taken[_slot(hashes)])
    at = np.minimum(np.searchsorted(known, hashes[rows]), len(known) - 1)
    found = known[at] == hashes[rows]
    return rows[found], order[at[found]]


def _matches(codes: np.ndarray, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, words, pieces) for all words that have a piece there, by end; the last piece number
    stands for a single character that is no piece."""
    _, order, _, longest = _lookup(path)
    n, width = codes.shape
    unknown = len(order)
    rolling = np.zeros((width, n), np.uint64)   # by begin: the hash from there to the current end
    for end in range(1, width + 1):
        last = codes[:, end - 1]
        inside = last > 0
        for begin in range(max(0, end - longest), end):
            rolling[begin] = rolling[begin] * BASE + last + np.uint64(1)
            rows, pieces = _pieces(rolling[begin], path)
            if end - begin == 1:
                single = np.full(n, unknown)
                single[rows] = pieces
                yield begin, end, np.flatnonzero(inside), single[inside]
            elif len(rows):
                inner = inside[rows]
                if inner.any():
                    yield begin, end, rows[inner], pieces[inner]


def _forward(codes: np.ndarray, probabilities: np.ndarray, path: str) -> tuple[np.ndarray, list]:
    """Sums over all segmentations up to each place, [word, place, language], and the matches used."""
    n, width = codes.shape
    alpha = np.zeros((n, width + 1, probabilities.shape[1]))
    alpha[:, 0] = 1
    used = list(_matches(codes, path))
    for begin, end, rows, pieces in used:
        alpha[rows, end] += alpha[rows, begin] * probabilities[pieces]
    return alpha, used


def _long_matches(word: str, path: str) -> list[list[tuple[int, int]]]:
    """For each end of a word of any length, where pieces that end there begin, and which they are."""
    _, order, _, longest = _lookup(path)
    codes = _codes([word], len(word))[0]
    rolling, by_end = np.zeros(len(codes), np.uint64), [[] for _ in range(len(codes) + 1)]
    for size in range(1, min(longest, len(codes)) + 1):
        begins = len(codes) - size + 1
        rolling = rolling[:begins] * BASE + codes[size - 1:] + np.uint64(1)
        at, pieces = _pieces(rolling, path)
        if size == 1:
            single = np.full(begins, len(order))
            single[at] = pieces
            at, pieces = np.arange(begins), single
        for begin, piece in zip(at.tolist(), pieces.tolist()):
            by_end[begin + size].append((begin, piece))
    return by_end


def _long_forward(by_end: list, log_probabilities: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations up to each place, [place, language]."""
    alpha = np.zeros((len(by_end), log_probabilities.shape[1]))
    for end in range(1, len(by_end)):
        begins, pieces = map(list, zip(*by_end[end]))
        alpha[end] = np.logaddexp.reduce(alpha[begins] + log_probabilities[pieces], axis=0)
    return alpha


def _groups(words: list[str]) -> tuple[list[np.ndarray], list[int]]:
    """Places of short words, by length to pad little, some thousand at a time; and those of long ones."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    short = np.flatnonzero(lengths <= SHORT)
    short = short[np.argsort(lengths[short], kind="stable")]
    return [at for at in np.array_split(short, max(1, len(short) // 8192)) if len(at)], np.flatnonzero(lengths > SHORT).tolist()


def word_scores(words: list[str], probabilities: np.ndarray, path: str) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), probabilities.shape[1]))
    groups, long_words = _groups(words)
    for at in groups:
        lengths = np.array([len(words[i]) for i in at])
        alpha, _ = _forward(_codes([words[i] for i in at], int(lengths.max())), probabilities, path)
        out[at] = np.log(alpha[np.arange(len(at)), lengths + 1])
    logs = np.log(probabilities) if long_words else None
    for i in long_words:
        out[i] = _long_forward(_long_matches(words[i], path), logs)[-1]
    return out


def expected_pieces(words: list[str], counts: np.ndarray, probabilities: np.ndarray, path: str) -> np.ndarray:
    """Expected number of each piece in ``words``, which occur ``counts[word, language]`` times."""
    total = np.zeros(probabilities.shape)
    groups, long_words = _groups(words)
    for at in groups:
        lengths = np.array([len(words[i]) for i in at])
        codes = _codes([words[i] for i in at], int(lengths.max()))
        alpha, used = _forward(codes, probabilities, path)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(at)), lengths + 1] = 1
        for begin, end, rows, pieces in reversed(used):
            beta[rows, begin] += beta[rows, end] * probabilities[pieces]
        weight = counts[at] / beta[:, 0]
        shares = np.concatenate([alpha[rows, begin] * probabilities[pieces] * beta[rows, end] * weight[rows] for begin, end, rows, pieces in used])
        numbers = np.concatenate([pieces for *_, pieces in used])
        for lang in range(total.shape[1]):
            total[:, lang] += np.bincount(numbers, shares[:, lang], len(total))
    logs = np.log(probabilities) if long_words else None
    for i in long_words:
        by_end = _long_matches(words[i], path)
        alpha, beta = _long_forward(by_end, logs), np.full((len(by_end), total.shape[1]), -np.inf)
        beta[-1] = 0
        for end in range(len(by_end) - 1, 0, -1):
            begins, pieces = map(list, zip(*by_end[end]))   # each begins at another place
            beta[begins] = np.logaddexp(beta[begins], beta[end] + logs[pieces])
            np.add.at(total, pieces, np.exp(alpha[begins] + logs[pieces] + beta[end] - alpha[-1]) * counts[i])
    return total


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case."""
    return LETTERS.findall(text.lower())


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits of other forms, such as superscripts, are none."""
    return any(map(str.isalpha, text))


class Scores(dict):
    """Tokens and their rows in ``known``; new ones are numbered as they come and wait for their scores."""

    def __init__(self, languages: int):
        super().__init__()
        self.known = np.zeros((0, languages))
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self.known) + len(self.new)
        self.new.append(token)
        return n

    def settle(self, probabilities: np.ndarray, path: str) -> None:
        """Score the tokens that are new."""
        inside = [LETTERS.findall(t) for t in self.new]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for found in inside for w in found))}
        scores = word_scores(list(words), probabilities, path)
        sizes = np.fromiter(map(len, inside), np.int64, len(inside))
        rows = np.fromiter((words[w] for found in inside for w in found), np.int64, int(sizes.sum()))
        made, some = np.zeros((len(inside), self.known.shape[1])), np.flatnonzero(sizes)
        if len(some):
            made[some] = np.add.reduceat(scores[rows], (np.cumsum(sizes) - sizes)[some], axis=0)
        self.known = np.concatenate([self.known, made])
        self.last, self.new = self.new, []

    def trim(self) -> None:
        """Forget the tokens that came last once there are enough, as common ones come early; and very long ones."""
        full = len(self.known) > MEMO_TOKENS
        for token in self.last:
            if full or len(token) > 64:
                del self[token]
        if full:
            self.known = self.known[:len(self.known) - len(self.last)]


_remembered: dict[str, Scores] = {}   # of a worker process, for the model it worked with last


@dataclass
class Model:
    """Piece probabilities by language; ``languages`` in natural order."""

    languages: list[str]
    probabilities: np.ndarray
    path: str = VOCABULARY
    key: str = field(default_factory=lambda: uuid.uuid4().hex, repr=False)

    def scores(self) -> Scores:
        if self.key not in _remembered:
            _remembered.clear()
            _remembered[self.key] = Scores(len(self.languages))
        return _remembered[self.key]

    def text_scores(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text in each language: the sum over its words."""
        tokens, sizes, scores = [], [], self.scores()
        for t in texts:
            found = t.lower().split()
            tokens += found
            sizes.append(len(found))
        rows, sizes = np.fromiter(map(scores.__getitem__, tokens), np.int64, len(tokens)), np.array(sizes, np.int64)
        scores.settle(self.probabilities, self.path)
        out, some = np.zeros((len(texts), len(self.languages))), np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(scores.known[rows], (np.cumsum(sizes) - sizes)[some], axis=0)
        scores.trim()
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The most probable language, the first of equals, and its posterior probability."""
        if not texts or not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        scores = self.text_scores(texts)
        top = scores.argmax(1)
        posterior = 1 / np.exp(scores - scores.max(1)[:, None]).sum(1)
        known = [has_letter(t) for t in texts]
        return ([self.languages[b] if k else UNKNOWN for b, k in zip(top, known)],
                [float(p) if k else 0.0 for p, k in zip(posterior, known)])


def _predicted(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """Predictions for many texts, about ``CHUNK`` characters of them at a time."""
    langs, scores, begin, size = [], [], 0, 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= CHUNK or i == len(texts):
            more = model.predict(texts[begin:i])
            langs += more[0]
            scores += more[1]
            begin, size = i, 0
    return langs, scores


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id counts as learned neither from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts per language: tokens are counted first and taken apart once each."""
    counts: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        words: dict[tuple[str, str], int] = {}
        for lang, c in counts.items():
            for token, n in c.items():
                for w in LETTERS.findall(token):
                    words[lang, w] = words.get((lang, w), 0) + n
        counts.clear()
        langs, found = zip(*words) if words else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(list(words.values()), pa.int64())],
                                          names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update(text.lower().split())
        if sum(map(len, counts.values())) > LOCAL_TOKENS:
            yield flush()
    yield flush()


def _expect_batches(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, place = np.zeros(model.probabilities.shape), {lang: i for i, lang in enumerate(model.languages)}
    for batch in batches:
        words = batch.column("word").to_pylist()
        at = {w: i for i, w in enumerate(dict.fromkeys(words))}
        counts = np.zeros((len(at), len(place)))
        np.add.at(counts, ([at[w] for w in words], [place[x] for x in batch.column("lang").to_pylist()]), batch.column("n").to_numpy())
        total += expected_pieces(list(at), counts, model.probabilities, model.path)
    pieces, langs = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.int32()), pa.array(pieces, pa.int32()), pa.array(total[pieces, langs])],
                                     names=["lang", "piece", "expected"])


def fit(docs: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """A model of every language among the non-null ``lang`` of rows that are not held out.

    It is fitted on the words of all those rows. No labelled row gives a model without languages.
    """
    labelled = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), text_or_empty(docs).alias("text"))
    labelled = labelled.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    unknown = len(vocabulary(path))
    model = Model(languages, np.full((unknown + 1, len(languages)), 1 / unknown), path)
    model.probabilities[unknown] = FLOOR
    if not languages:
        return model
    counts = labelled.select("lang", "text").mapInArrow(_count_batches, "lang string, word string, n long")
    stored = cut(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):
        expected = (stored.mapInArrow(partial(_expect_batches, model), "lang int, piece int, expected double")
                          .groupBy("lang", "piece").agg(F.sum("expected").alias("expected")).toPandas())
        total = np.full((unknown + 1, len(languages)), SMOOTH)
        total[expected["piece"], expected["lang"]] += expected["expected"]
        total = total[:unknown]
        model = Model(languages, np.vstack([total / total.sum(0), np.full(len(languages), FLOOR)]), path)
    return model


def _predict_batches(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = _predicted(model, batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                         names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row; only the text decides.

    A null text, or one without any letter, is ``und`` with score 0, as is every text if no language was
    learned. Equal rows get equal results; of languages with equal probability the first by name is
    taken. No rows give no rows; other columns are not read.
    """
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return (narrow.withColumn("held_out", held_out(F.col("doc_id")))
                  .mapInArrow(partial(_predict_batches, model), "doc_id long, held_out boolean, lang_pred string, score double"))


def _keep_batches(model: Model, column: int, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        langs, scores = _predicted(model, texts)
        keep = [has_letter(t) if not model.languages else lang != UNKNOWN and s >= least for t, lang, s in zip(texts, langs, scores)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is clear: a learned one with a posterior of at least ``least``.

    All columns stay as they are. If no language was learned, rows with a letter stay.
    """
    column = docs.columns.index("text")
    return docs.mapInArrow(partial(_keep_batches, model, column, least), docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, then identify every row."""
    return identify(docs, fit(docs))
