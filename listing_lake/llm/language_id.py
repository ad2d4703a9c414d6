"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from listing_lake.llm.common import pack, text
from listing_lake.session import materialize

UNKNOWN = "und"
ORDERS = (1, 2, 3)
# N-grams hash to this many columns, so the model's size is fixed.
LOG_COLUMNS = 17
COLUMNS = 1 << LOG_COLUMNS
# Largest number of languages one model may have.
MOST_LANGUAGES = 500
# Characters measured at a time.
WINDOW = 1 << 20


# --- n-grams ------------------------------------------------------------------------------------
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Lower-case code point of every code point, a blank for all that are no letters; made once per process."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _FOLD.append(table)
    return _FOLD[0]


def has_letter(value: str | None) -> bool:
    return value is not None and any(map(str.isalpha, value))


def _columns(codes: np.ndarray, orders: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(order, column of the n-gram that begins at each code point)."""
    rolled = np.zeros(len(codes), np.uint32)
    for order in range(1, max(orders) + 1):
        if len(codes) < order:
            return
        rolled = rolled[:len(codes) - order + 1] * np.uint32(0x01000193) + (codes[order - 1:] + np.uint32(1)) * np.uint32(0x9E3779B1)
        if order in orders:
            mixed = (rolled ^ rolled >> np.uint32(15)) * np.uint32(0x85EBCA6B)
            yield order, mixed >> np.uint32(32 - LOG_COLUMNS)


def _measure(texts: list[str], orders: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, count) of the n-grams of some texts. Runs of other characters than letters are one blank, and a text stands between blanks."""
    joined = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
    folded = _fold()[joined]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (owner[1:] != owner[:-1])
    codes, owner = folded[keep], owner[keep]
    found = [np.zeros(0, np.uint32)]
    for order, column in _columns(codes, orders):
        inner = owner[:len(column)] == owner[order - 1:]
        if order == 1:
            inner = inner & (codes != 32)
        found.append(owner[:len(column)][inner] << np.uint32(LOG_COLUMNS) | column[inner])
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return (keys >> np.uint32(LOG_COLUMNS)).astype(np.int64), (keys & np.uint32(COLUMNS - 1)).astype(np.int64), counts


def count_grams(texts: list[str | None], orders: Sequence[int] = ORDERS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, text, column, count) for groups of texts of about `WINDOW` characters, texts numbered within their group.

    A longer text is counted window by window.
    """
    values = [t or "" for t in texts]
    start, size, most = 0, 0, 1 << 32 - LOG_COLUMNS
    for i, value in enumerate([*values, None]):
        if i > start and (value is None or size + len(value) > WINDOW or i - start >= most):
            counted = _in_parts(values[start], orders) if size > WINDOW else _measure(values[start:i], orders)
            yield start, i - start, *counted
            start, size = i, 0
        size += len(value or "")


def _in_parts(value: str, orders: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of one long text: folded as a whole, its n-grams counted by where they begin, a window at a time."""
    codes = _fold()[np.frombuffer(f" {value} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    total = np.zeros(COLUMNS, np.int64)
    for at in range(0, len(codes), WINDOW):
        part = codes[at:at + WINDOW + max(orders) - 1]
        for order, column in _columns(part, orders):
            column = column[:WINDOW]
            total += np.bincount(column[part[:len(column)] != 32] if order == 1 else column, minlength=COLUMNS)
    columns = np.flatnonzero(total)
    return np.zeros(len(columns), np.int64), columns, total[columns]


def _unit(owner: np.ndarray, n: int, columns: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values, the vector of each text scaled to length 1."""
    value = (1 + np.log(counts)) * idf[columns]
    return value / np.maximum(np.sqrt(np.bincount(owner, value * value, n)), 1e-12)[owner]


# --- model --------------------------------------------------------------------------------------
@dataclass(frozen=True)
class LanguageModel:
    """Languages, inverse document frequencies per column, sparse weights (language x column), intercepts and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.tile(self.bias.astype(np.float64), (len(texts), 1))
        for start, n, owner, columns, counts in count_grams(texts):
            value = _unit(owner, n, columns, counts, self.idf)
            for k, weights in enumerate(self.weights):
                out[start:start + n, k] += np.bincount(owner, value * weights[columns], n)
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(content: DataFrame) -> np.ndarray:
    """How many of the content rows hold each column, over all rows and whole texts; each task sends one count per column."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COLUMNS, np.int64)
        for batch in batches:
            for _, _, _, columns, _ in count_grams(batch.column(0).to_pylist()):
                total += np.bincount(columns, minlength=COLUMNS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["column", "n"])

    found = content.select(text().alias("summary")).mapInArrow(count, "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COLUMNS, np.int64)
    out[found.column("column").to_numpy()] = found.column("n").to_numpy()
    return out


def training_sample(content: DataFrame, language: str, shares: dict[str, float]) -> DataFrame:
    """This share of the rows of each language (`lang`, `summary`, `at`), by a hash of id and text.

    Rows of one hash and language count once, so that repeated rows do not fill the sample. `at` is an order that has nothing to do
    with the texts. Only one number per language is broadcast.
    """
    rows = content.select(
        F.col(f"`{language}`").cast("string").alias("lang"), text().alias("summary"),
        F.xxhash64(F.col("content_id").cast("string"), F.col("summary")).alias("at"))
    table = content.sparkSession.createDataFrame(list(shares.items()), "lang string, share double")
    chosen = rows.join(F.broadcast(table), "lang").where(F.col("at") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    return chosen.groupBy("lang", "at").agg(F.first("summary").alias("summary"))


def _sparse_rows(sample: DataFrame, idf: np.ndarray) -> DataFrame:
    """(lang, at, columns, weights): the vectors of the sample, as packed 32-bit numbers."""
    shared = sample.sparkSession.sparkContext.broadcast(idf)
    names = ["lang", "at", "columns", "weights"]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, owner, columns, counts in count_grams(batch.column("summary").to_pylist()):
                value = _unit(owner, n, columns, counts, shared.value).astype(np.float32)
                ends = np.searchsorted(owner, np.arange(1, n))
                part = batch.slice(start, n)
                packed = [[v.tobytes() for v in np.split(a, ends)] for a in (columns.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("at"), *[pa.array(v, pa.binary()) for v in packed]], names)

    return sample.select("lang", "at", "summary").mapInArrow(vectors, "lang string, at long, columns binary, weights binary")


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates: weights of one row per language, zero where the pull is below `l1`."""

    def __init__(self, languages: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # The last column is the intercept, which no penalty holds down.
        self.z, self.n = np.zeros((languages, COLUMNS + 1)), np.zeros((languages, COLUMNS + 1))

    def weights(self, columns: np.ndarray) -> np.ndarray:
        z, rate = self.z[:, columns], (self.beta + np.sqrt(self.n[:, columns])) / self.alpha
        free = columns == COLUMNS
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(free, 0.0, self.l1), 0.0)
        return -shrunk / (rate + np.where(free, 0.0, self.l2))

    def learn(self, language: int, columns: np.ndarray, values: np.ndarray) -> None:
        columns, values = np.append(columns, COLUMNS), np.append(values, 1.0)
        w = self.weights(columns)
        error = softmax(w @ values)
        error[language] -= 1.0
        gradient = error[:, None] * values
        before = self.n[:, columns]
        after = before + gradient * gradient
        self.z[:, columns] += gradient - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w
        self.n[:, columns] = after


def best_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature between 0.05 and 20 that makes the true languages likeliest, by golden sections of its logarithm.

    As if one more row had been seen in every language, so that rows without any error do not make the scores certain.
    """
    if not len(truth) or logits.shape[1] < 2:
        return 1.0
    n, k = logits.shape
    target = np.full((n, k), 1.0 / (n + k))
    target[np.arange(n), truth] = (n + 1.0) / (n + k)

    def loss(log_t: float) -> float:
        return -(target * np.log(np.maximum(softmax(logits / np.exp(log_t)), 1e-300))).sum(1).mean()

    low, high, golden = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(
    content: DataFrame, language: str = "sourceLanguage", most: int = 2_000, passes: int = 2, calibration: int = 5,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01,
) -> LanguageModel:
    """Learns from the rows of `content` whose `language` is known; other rows and columns than id, text and language are not looked at.

    Inverse document frequencies cover all these rows. Weights are learnt on a sample of about `most` rows of each language (all
    rows of a language that has no more), row by row in an order without meaning, `passes` times: this bounds what the driver reads,
    one partition at a time. About every `calibration`-th row of the sample is kept from that and sets the temperature.

    No known rows give a model without languages; rows of one language give that language everywhere. Null and empty texts
    teach the intercept only. The weights are languages x `COLUMNS` numbers: more than `MOST_LANGUAGES` languages are refused.
    """
    known = content.where(F.col(f"`{language}`").isNotNull())
    sizes = known.groupBy(F.col(f"`{language}`").cast("string").alias("lang")).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{language} has more than {MOST_LANGUAGES} values")
    languages = sorted(r.lang for r in sizes)
    if not languages:
        return LanguageModel([], np.ones(COLUMNS), np.zeros((0, COLUMNS), np.float32), np.zeros(0))
    idf = np.log((1 + sum(r.n for r in sizes)) / (1 + document_frequencies(known))) + 1.0
    shares = {r.lang: min(1.0, most / r.n) for r in sizes}
    sample = materialize(_sparse_rows(training_sample(known, language, shares), idf), "language_rows").orderBy("at", "lang")
    number = {name: i for i, name in enumerate(languages)}

    def rows(kept: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        chosen = (F.pmod(F.xxhash64("at", F.lit(1)), F.lit(calibration)) == 0) == F.lit(kept)
        for row in sample.where(chosen).toLocalIterator():
            yield number[row["lang"]], np.frombuffer(row["columns"], np.int32), np.frombuffer(row["weights"], np.float32).astype(np.float64)

    leader = Ftrl(len(languages), alpha, beta, l1, l2)
    for _ in range(passes):
        for k, columns, values in rows(kept=False):
            leader.learn(k, columns, values)
    weights = leader.weights(np.arange(COLUMNS + 1))
    checked = [(k, weights[:, columns] @ values + weights[:, COLUMNS]) for k, columns, values in rows(kept=True)]
    temperature = best_temperature(np.array([v for _, v in checked]), np.array([k for k, _ in checked], np.int64))
    return LanguageModel(languages, idf, weights[:, :COLUMNS].astype(np.float32), weights[:, COLUMNS], temperature)


def predict(content: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds `lang_pred`, the likeliest language of the whole summary, and `score`, its calibrated probability.

    A null or empty summary, one without any letter and a model without languages give `und` and 0. Only the summary decides, row by
    row, so equal texts get equal answers; other columns stay. The model, a few megabytes, is sent to each worker once.
    """
    packed, others = pack(content, "lang_pred", "score")
    shared = content.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("summary").to_pylist()
            at = np.flatnonzero(np.array([has_letter(t) for t in texts], bool)) if model.languages else []
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if len(at):
                chances = model.probabilities([texts[i] for i in at])
                scores[at] = chances.max(1)
                for i, k in zip(at, chances.argmax(1)):
                    names[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*packed.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return packed.mapInArrow(judge, schema).select("content_id", "summary", *others, "lang_pred", "score")
