"""Toxicity of texts whose words may be disguised: restore, then score.

A disguised word is seen as the output of a noisy channel: letters are replaced by
look-alikes, repeated, or set apart by spaces and marks. Each suspicious token gives a
lattice of the letters it may stand for, and Viterbi finds the path with the highest
probability under the channel and a character trigram model of all documents. Words and
their beginnings, as they stand and as restored, are the features of a logistic model.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import sub
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldhaul.llm.common import stored

#: What a sign may stand for; the letter l is left out where i is far likelier in writing.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i",
    "&": "a", "%": "o", "#": "h", "*": "aeiou", "v": "vu", "µ": "u", "ø": "o",
}
MARKS = ".-_*~'·,/"
LOG_KEPT, LOG_SWAPPED, LOG_DOUBLED, LOG_DROPPED = math.log(0.9), math.log(0.1), math.log(0.3), math.log(0.05)

SYMBOLS = 28  # 0 word edge, 1-26 letters, 27 any other letter
EDGE_MARKS = ".,;:?!\"'()[]{}<>|*&%#$-_~/+=“”„«»…"
# Four and more single signs set apart by white space, each with a mark behind it or none.
SPACED = re.compile(r"(?<!\S)\S[^\w\s]?(?:\s+\S[^\w\s]?){2,}\s+\S[^\w\s]*(?!\S)")
SIGNS = re.compile(r"[0-9@$!|+(<{€£¡&%#*µø]")
LETTERS = re.compile(r"[^\W\d_]")
REPEATED = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"([^\W\d_])\1")
TWICE_DOUBLED = re.compile(r"([^\W\d_])\1.*([^\W\d_])\2")
RUN = re.compile(r"(.)\1+")
END_MARKS = re.compile(r"(?<=\S)[.,;:?!\"']+$")
BETWEEN = re.compile(r"[^\w]+")
SPLIT_BY_MARKS = re.compile(r"(?:[^\W_][.\-_*~'·,/]+){2,}[^\W_]")
EDGE_RUN = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
END_SIGNS = ".,;:?!\"'"
SETTLED = 64
#: Letters that stand for others, as one letter.
ONE_LETTER = str.maketrans("vµø", "uuo")
CACHED_TOKENS = 300_000
NOTHING: dict[str, list[int]] = {}


def code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of letter trigrams over the purely alphabetic words of a task's whole texts."""
    total = np.zeros(SYMBOLS**3, np.int64)
    words: Counter[str] = Counter()

    def flush() -> None:
        plain = {w: n for w, n in words.items() if w.isalpha()}
        words.clear()
        if not plain:
            return
        joined = " " + " ".join(plain) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        codes = np.where((points >= 97) & (points <= 122), points - 96, np.where(points == 32, 0, 27)).astype(np.int64)
        lengths = np.array([len(w) + 1 for w in plain])
        weight = np.repeat(np.array(list(plain.values()), np.int64), lengths)
        before = np.concatenate(([0], codes[:-2]))
        before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = 0
        # The letter at each place with the two before it; at the start of a word both are edges.
        triple = (before * SYMBOLS + codes[:-1]) * SYMBOLS + codes[1:]
        total[:] += np.bincount(triple, weight, SYMBOLS**3).astype(np.int64)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words.update(text.lower().split())
        if len(words) > 100_000:
            flush()
    flush()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["trigram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | two before), from all documents; the driver gets at most 28 ** 3 counts."""
    counted = docs.select(F.col("text").cast("string")).mapInArrow(trigram_counts, "trigram int, n long")
    n = np.zeros(SYMBOLS**3)
    for r in counted.groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        n[r["trigram"]] = r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = n.sum(axis=0) + 1
    back_off = pairs / pairs.sum(axis=1, keepdims=True)
    smoothed = (n + 5 * back_off[None]) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(smoothed)


def _arcs(sign: str, run: int, narrow: int) -> list[tuple[str, float]]:
    """What a run of one sign may stand for, with the cost; a space is a border of words."""
    if sign == " ":
        # Equal gaps say nothing; a wider one is rather a border.
        return [("", 0.0 if run == narrow else LOG_SWAPPED), (" ", 0.0)]
    options: list[tuple[str, float]] = []
    if LETTERS.match(sign):
        options.append((sign, LOG_KEPT))
    options += [(x, LOG_SWAPPED if sign.isalpha() else LOG_KEPT) for x in LOOK_ALIKES.get(sign, "") if x != sign]
    # A letter is written once or twice, however often its sign stands there.
    arcs = [(x, c + (LOG_DROPPED if run == 2 else 0)) for x, c in options]
    if run >= 2:
        arcs += [(x + x, c + (0 if run == 2 else LOG_DOUBLED)) for x, c in options]
    if sign in MARKS or not options:
        dropped = LOG_DROPPED if options else 0.0
        arcs += [("", dropped), (" ", dropped + LOG_SWAPPED)]
    return arcs


def restore(token: str, model: list[list[list[float]]]) -> str:
    """The likeliest words behind a token or a run of spaced signs, by Viterbi.

    A state is the last two letters; each run of one sign is a step. White space and marks
    are dropped or end a word. What all paths agree on is put aside from time to time, so
    the work is linear in the length.
    """
    token = re.sub(r"\s", " ", token)
    narrow = min((len(g) for g in re.findall(" +", token)), default=0)
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    done: list[str] = []
    for n, found in enumerate(re.finditer(r"(?s)(.)\1*", token), 1):
        arcs = _arcs(found[1], len(found[0]), narrow)
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, word) in paths.items():
            for letters, cost in arcs:
                x, y, s = a, b, score + cost
                if letters == " ":
                    if y:
                        s += model[x][y][0]
                    x = y = 0
                else:
                    for letter in letters:
                        z = code(letter)
                        s += model[x][y][z]
                        x, y = y, z
                if (x, y) not in step or step[x, y][0] < s:
                    step[x, y] = (s, word + letters)
        paths = step
        if n % SETTLED == 0:
            common = commonprefix([w for _, w in paths.values()])
            done.append(common)
            paths = {k: (s, w[len(common) :]) for k, (s, w) in paths.items()}
    return "".join(done) + max((s + (model[a][b][0] if b else 0.0), w) for (a, b), (s, w) in paths.items())[1]


def suspicious(token: str) -> bool:
    if not LETTERS.search(token):
        return False
    return bool(SIGNS.search(token) or REPEATED.search(token) or SPLIT_BY_MARKS.search(token))


def skeleton(word: str) -> str:
    """The same for a purely alphabetic word and for all that the decoder may read it as."""
    return RUN.sub(r"\1", word.translate(ONE_LETTER))


def features_of(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *["^" + word[:k] for k in range(3, 8) if len(word) > k]]


class Reader:
    """The distinct words of texts, as they stand and restored."""

    def __init__(self, model: np.ndarray) -> None:
        self.table = model.tolist()
        self.known: dict[str, tuple[str, ...]] = {}

    def tokens(self, text: str) -> tuple[set[str], int]:
        """Distinct tokens, the words behind signs set apart by spaces, and the number of tokens."""
        lower = text.lower()
        parts = lower.split()
        found = set(parts)
        short = [i for i, n in enumerate(map(len, parts)) if n <= 2]
        # No run of four is without three short tokens in a row.
        if 2 in map(sub, short[2:], short):
            for run in SPACED.finditer(lower):
                if len(LETTERS.findall(run[0])) >= 2:
                    signs = END_MARKS.sub("", run[0])
                    found.update(w for w in restore(signs, self.table).split() if len(w) >= 3)
        return found, len(parts)

    def worth_decoding(self, word: str) -> bool:
        """Whether a purely alphabetic word with doubled letters goes to the decoder."""
        return bool(REPEATED.search(word) or TWICE_DOUBLED.search(word))

    def forms(self, token: str) -> tuple[str, ...]:
        """The word of a token without its punctuation, and what it may disguise."""
        if token.isalpha() and not DOUBLED.search(token):
            return (token,)
        plain = token.strip(EDGE_MARKS)
        if plain.isalpha() and plain == token:
            if not DOUBLED.search(plain) or not self.worth_decoding(plain):
                return (plain,)
            return tuple(dict.fromkeys([plain, *restore(plain, self.table).split()]))
        # A word with one mark behind it is the same in both shapes below.
        if token[:-1] == plain and token[-1] in END_SIGNS and plain.isalpha() and not (DOUBLED.search(plain) or SIGNS.search(plain)):
            return (plain,)
        out = [plain] if plain else []
        if not plain.isalpha():
            out += [w for w in BETWEEN.split(plain) if len(w) >= 3 and w != plain]
        # A single sign at an edge may be a letter, a run of signs is decoration.
        signed = EDGE_RUN.sub("", token).rstrip(END_SIGNS).lstrip("\"'(")
        for shape in dict.fromkeys((plain, signed)):
            if suspicious(shape) or (shape.isalpha() and DOUBLED.search(shape) and self.worth_decoding(shape)):
                out += restore(shape, self.table).split()
        return tuple(dict.fromkeys(out))

    def words(self, text: str) -> set[str]:
        found: set[str] = set()
        for token in self.tokens(text)[0]:
            forms = self.known.get(token)
            if forms is None:
                if len(self.known) > CACHED_TOKENS:
                    self.known.clear()
                forms = self.known[token] = self.forms(token)
            found.update(forms)
        return found


class FeatureReader(Reader):
    """A reader that knows which words count: doubled letters are only decoded where a feature may come out."""

    def __init__(self, model: np.ndarray, features: Iterable[str]) -> None:
        super().__init__(model)
        self.skeletons = {skeleton(f.removeprefix("^")) for f in features}
        self.lengths = sorted({len(s) for s in self.skeletons if 1 <= len(s) < 8})

    def worth_decoding(self, word: str) -> bool:
        bare, skeletons = skeleton(word), self.skeletons
        if bare in skeletons:
            return True
        for k in self.lengths:
            if bare[:k] in skeletons:
                return True
        return False


class Vectors:
    """Feature values of texts: distinct words that carry a feature, as a count and by length of text."""

    def __init__(self, model: np.ndarray, index: dict[str, int]) -> None:
        self.reader, self.index = FeatureReader(model, index), index
        # How words with a feature start; all features of a word have at least three letters or are the word.
        self.starts = {start for f in index for start in (f[:3], f.removeprefix("^")[:3])}
        # Most tokens carry no feature, so the answer per token is kept: word -> features.
        self.known: set[str] = set()
        self.carrying: dict[str, dict[str, list[int]]] = {}

    def of_token(self, token: str) -> dict[str, list[int]]:
        index, starts = self.index, self.starts
        if token[:3] not in starts and token.isalpha() and not DOUBLED.search(token):
            return NOTHING
        found = {}
        for word in self.reader.forms(token):
            if word[:3] in starts and (at := [index[f] for f in features_of(word) if f in index]):
                found[word] = at
        return found or NOTHING

    def __call__(self, text: str) -> dict[int, float]:
        tokens, n = self.reader.tokens(text)
        known, carrying = self.known, self.carrying
        if len(known) > CACHED_TOKENS:
            known.clear()
            carrying.clear()
        fresh = tokens - known
        for token in fresh:
            if found := self.of_token(token):
                carrying[token] = found
        known |= fresh
        carried: dict[str, list[int]] = {}
        for token in carrying.keys() & tokens:
            carried.update(carrying[token])
        hits = Counter(at for features in carried.values() for at in features)
        scale = 1.0 / (1.0 + n / 100.0)
        out: dict[int, float] = {}
        for at in sorted(hits):
            out[2 * at] = min(hits[at], 4.0)
            out[2 * at + 1] = 4.0 * out[2 * at] * scale
        return out


def _train_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic) of at most ``sample_rows`` labelled ids of least hash that are not held out.

    An id is one row however many rows have it: the one whose text has the least hash.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(chosen), "doc_id").select("*", F.struct(F.xxhash64("text").alias("h"), "text").alias("hashed"))
    # The rows of an id are reduced in each task before they are sent.
    least = labelled.groupBy("doc_id").agg(F.min("hashed").alias("least"), F.first("toxic").alias("toxic"))
    return least.select("least.text", "toxic")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _feature_counts(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """(feature, toxic documents, other documents) over the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model)
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[int(toxic == 1)].update({f for w in read.words(text) for f in features_of(w)})
        names = list(dict.fromkeys([*seen[0], *seen[1]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *[pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0)]],
            ["feature", "p", "n"],
        )

    counted = rows.mapInArrow(count, "feature string, p long, n long")
    return counted.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def fit(rows: list[tuple[int, dict[int, float]]], width: int, ridge: float = 1e-4, steps: int = 600) -> np.ndarray:
    """Weights of a logistic model, the intercept last, by full gradient steps (Adam)."""
    y = np.array([r[0] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([c for r in rows for c in r[1]], np.int64)
    val = np.array([v for r in rows for v in r[1].values()], float)
    w, m, s = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[col], len(y)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(col, val * error[row], width), error.sum()) / len(y)
        g[:-1] += ridge * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample_rows: int, n_features: int) -> tuple[dict[str, int], np.ndarray]:
    """Feature numbers and weights. Without rows of both labels the score is constant."""
    rows = stored(_train_rows(docs, labels, sample_rows), "toxic-sample")
    size = {bool(r["toxic"] == 1): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = size.get(True, 0), size.get(False, 0)
    if not p or not n:
        return {}, np.array([math.log((p + 0.5) / (n + 0.5))])
    odds = F.log((F.col("p") + 0.5) / (p - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (n - F.col("n") + 0.5))
    z = odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    best = _feature_counts(rows, model).where("p >= 3").withColumn("z", z).where("z > 2.5")
    index = {r["feature"]: i for i, r in enumerate(best.orderBy(F.desc("z"), "feature").limit(n_features).collect())}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = Vectors(model, index)
        for batch in batches:
            found = [vector(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([list(v) for v in found], pa.list_(pa.int32())),
                    pa.array([list(v.values()) for v in found], pa.list_(pa.float64())),
                ],
                ["toxic", "at", "value"],
            )

    sample = rows.mapInArrow(vectors, "toxic int, at array<int>, value array<double>").collect()
    # One order, so that the sums of the fit do not depend on the partitions.
    found = sorted((int(r["toxic"] == 1), tuple(zip(r["at"], r["value"]))) for r in sample)
    return index, fit([(y, dict(x)) for y, x in found], 2 * len(index))


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, n_features: int = 1500, cut: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted.

    Learns from at most ``sample_rows`` labelled rows whose crc32(doc_id) mod 3 is not 1;
    the character model rests on all documents. A null or empty text has no features
    and gets the base rate; equal texts get equal scores. Without labels the score is
    0.5. Empty tables give no rows, other columns are ignored.
    """
    model = language_model(docs)
    index, weights = train(docs, labels, model, sample_rows, n_features)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = Vectors(model, index)
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                z = weights[-1] + sum(weights[c] * v for c, v in vector(text or "").items())
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(score, f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
