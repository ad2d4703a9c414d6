"""Phrases that stand together more often than their parts would by chance, found by Rabin-Karp fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from listing_lake.llm.common import text
from listing_lake.session import materialize

PIECE_ENDS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
UNKNOWN = "und"
# Odd bases of the polynomials over bytes and over words, modulo 2 ** 64. Weak fingerprints would cost time, not correctness.
LETTER_BASE, WORD_BASE = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
# The same for the check that tells whether all runs of one fingerprint were the same; its sums must fit 64 bits.
CHECK_LETTER_BASE, CHECK_WORD_BASE, CHECK_BITS = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 20
# Bits of the filter that tells tasks which shorter phrases are frequent; its size does not depend on the data.
FILTER_BITS = 26
# Bytes of text hashed at a time.
WINDOW = 2 << 20

_KINDS = np.zeros(256, np.uint8)
_KINDS[[ord(c) for c in BLANKS]] = 1
_KINDS[[ord(c) for c in PIECE_ENDS]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Merged rows and distinct words that a task holds before it passes them on.
HELD_ROWS, HELD_WORDS = 250_000, 300_000

COUNTS = "lang string, n_words int, fingerprint long, n long, checks long, seen_in long"
SPELLED = "lang string, fingerprint long, phrase string, n_words int, check long"
OCCURRENCES = "lang string, fingerprint long, phrase string, n_words int, n long, seen_in long"


# --- one window of text -------------------------------------------------------------------------
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of the base modulo 2 ** 64; grown by doubling and kept."""
    known = _POWERS.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    _POWERS[base] = known
    return known[:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of the polynomial with these coefficients."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=out[1:])
    return out


def _slices(prefix: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of slices, the same wherever in the window a slice stands: the sum between two places over the power of the first."""
    inverse = _powers(pow(base, -1, 1 << 64), len(prefix))
    out = (prefix[end] - prefix[first]) * inverse[first]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


class Words:
    """The words of one window: where they are, their piece, and fingerprints of all runs of words."""

    def __init__(self, data: np.ndarray, tags: np.ndarray, owner_of, hash_bits: int):
        kinds = _KINDS[data]
        word = np.zeros(len(data) + 2, np.int8)
        word[1:-1] = kinds == 0
        edges = np.diff(word)
        self.data = _LOWER[data]
        self.first, self.end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.piece = np.searchsorted(np.flatnonzero(kinds == 2), self.first)
        self.owner = owner_of(self.first)
        self.tag = tags[self.owner]
        self.mask = np.uint64((1 << hash_bits) - 1)
        self.code = _slices(_prefix(self.data + np.uint64(1), LETTER_BASE), self.first, self.end, LETTER_BASE) & self.mask
        self.sums = _prefix(self.code, WORD_BASE)
        check = _slices(_prefix(self.data + np.uint64(1), CHECK_LETTER_BASE), self.first, self.end, CHECK_LETTER_BASE)
        self.check_sums = _prefix(check, CHECK_WORD_BASE)

    def __len__(self) -> int:
        return len(self.first)

    def whole(self, length: int) -> np.ndarray:
        """Which words begin a run of this many words within one piece."""
        last = len(self) - length + 1
        return self.piece[:last] == self.piece[length - 1:] if last > 0 else np.zeros(0, bool)

    def fingerprints(self, length: int, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the runs of `length` words that begin at the given words; language and length are mixed in."""
        mixed = _slices(self.sums, at, at + length, WORD_BASE) + np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64))
        return ((mixed ^ self.tag[at]) & self.mask).view(np.int64)

    def checks(self, length: int, at: np.ndarray) -> np.ndarray:
        """A second, unrelated hash of the same runs, of `CHECK_BITS` bits."""
        return (_slices(self.check_sums, at, at + length, CHECK_WORD_BASE) >> np.uint64(64 - CHECK_BITS)).view(np.int64)

    def spell(self, length: int, at: int) -> str:
        parts = [self.data[self.first[i]:self.end[i]].tobytes() for i in range(at, at + length)]
        return b" ".join(parts).decode(errors="replace")

    def exact_ids(self, known: dict[bytes, int]) -> np.ndarray:
        """A number per word, equal for equal bytes only and kept in `known`: words of one code are compared with the first of them,
        byte by byte."""
        _, first, of = np.unique(self.code, return_index=True, return_inverse=True)
        like = first[of]
        sizes = self.end - self.first
        differs = sizes != sizes[like]
        same = np.flatnonzero(~differs)
        span = sizes[same]
        within = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
        unlike = self.data[np.repeat(self.first[same], span) + within] != self.data[np.repeat(self.first[like[same]], span) + within]
        differs[np.repeat(same, span)[unlike]] = True

        def number(i: int) -> int:
            return known.setdefault(self.data[self.first[i]:self.end[i]].tobytes(), len(known))

        ids = np.fromiter(map(number, first), np.int32, len(first))[of]
        for i in np.flatnonzero(differs):
            ids[i] = number(i)
        return ids


class Tally:
    """Counts of runs of words by fingerprint, each with its words and one row that holds it. Runs of one fingerprint are only added up
    where all their words are the same."""

    def __init__(self, longest: int):
        self.longest, self.parts, self.rows = longest, [], 0

    def add(self, fingerprints: np.ndarray, language: np.ndarray, runs: np.ndarray, n: np.ndarray, row: np.ndarray) -> None:
        if len(fingerprints):
            self.parts.append(self._merge(fingerprints, language, runs, n, row))
            self.rows += len(self.parts[-1][0])

    def _merge(self, fingerprints, language, runs, n, row):
        _, first, of = np.unique(fingerprints, return_index=True, return_inverse=True)
        like = first[of]
        odd = (language != language[like]) | (runs != runs[like]).any(1)
        total = np.bincount(of[~odd], n[~odd], len(first)).astype(np.int64)
        keep = np.concatenate([first, np.flatnonzero(odd)])
        return fingerprints[keep], language[keep], runs[keep], np.concatenate([total, n[odd]]), row[keep]

    def take(self, words: list[bytes], languages: list[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        """All counts so far, with the phrases spelled, some rows at a time; nothing is left."""
        if self.parts:
            columns = [np.concatenate(column) for column in zip(*self.parts)]
            self.parts, self.rows = [], 0
            merged, spoken = self._merge(*columns), pa.array(languages, pa.string())
            del columns
            for at in range(0, len(merged[0]), rows):
                fingerprints, language, runs, n, row = [column[at:at + rows] for column in merged]
                size = (runs >= 0).sum(1)
                phrases = [b" ".join([words[i] for i in run[:k]]).decode(errors="replace") for run, k in zip(runs.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([
                    spoken.take(pa.array(language)), pa.array(fingerprints), pa.array(phrases, pa.string()), pa.array(size, pa.int32()),
                    pa.array(n), pa.array(row)], ["lang", "fingerprint", "phrase", "n_words", "n", "seen_in"])


def _windows(texts: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(bytes, where they begin, where texts begin) of runs of whole pieces, about `limit` bytes each; a line end follows every text."""
    flat = texts.fill_null("").cast(pa.large_binary())
    if not len(flat):
        return
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    begins = offsets[:-1] - offsets[0] + np.arange(len(flat))
    size = int(offsets[-1] - offsets[0])
    data = np.full(size + len(flat), 10, np.uint8)
    ends = offsets[1:] - offsets[0] + np.arange(len(flat))
    place = np.ones(len(data), bool)
    place[ends] = False
    if size:
        data[place] = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    stops = np.flatnonzero(_KINDS[data] == 2)
    start = 0
    while start < len(data):
        # The last piece end within the limit, else the next one: pieces are never cut.
        at = int(np.searchsorted(stops, start + limit, "right")) - 1
        if at < 0 or stops[at] < start:
            at += 1
        stop = int(stops[at]) + 1
        yield data[start:stop], start, begins
        start = stop


def _read(batch: pa.RecordBatch, hash_bits: int, limit: int) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """(words, languages, language number per text) of each window of a batch that has words."""
    names = batch.column("lang").dictionary_encode()
    languages = names.dictionary.to_pylist()
    number = names.indices.to_numpy(zero_copy_only=False)
    marks = np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in languages] or [0], np.uint64)
    tags = marks[number] if len(number) else np.zeros(0, np.uint64)
    for data, start, begins in _windows(batch.column("summary"), limit):
        words = Words(data, tags, lambda at: np.searchsorted(begins, at + start, "right") - 1, hash_bits)
        if len(words):
            yield words, languages, number


class Filter:
    """A set of fingerprints as a fixed number of bits: never misses one, now and then takes a stranger."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.int64(len(bits) * 64 - 1)

    def holds(self, fingerprints: np.ndarray) -> np.ndarray:
        at = fingerprints & self.mask
        return self.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) != 0


def _filter(fingerprints: DataFrame, log_bits: int) -> Filter:
    """The filter of a column `fingerprint`, or'ed together on the cluster; at most 2 ** (log_bits - 6) numbers reach the driver."""
    at = F.col("fingerprint").bitwiseAND((1 << log_bits) - 1)
    found = (
        fingerprints.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    bits = np.zeros(1 << (log_bits - 6), np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(bits)


def _frequent_runs(words: Words, lengths: Sequence[int], known) -> Iterator[tuple[int, np.ndarray]]:
    """(length, first words) of runs whose shorter runs may be frequent; `known` is the filter of the runs one word shorter than the
    least of `lengths`, if any."""
    alive = None
    for length in range(lengths[0], lengths[-1] + 1):
        whole = words.whole(length)
        if known is not None:
            if alive is None:
                shorter = words.whole(length - 1)
                alive = np.zeros(len(shorter), bool)
                at = np.flatnonzero(shorter)
                alive[at] = known.holds(words.fingerprints(length - 1, at))
            whole = whole & alive[:len(whole)] & alive[1:len(whole) + 1]
            alive = whole
        yield length, np.flatnonzero(whole)


# --- passes over all texts ----------------------------------------------------------------------
def _count_pass(texts: DataFrame, lengths: Sequence[int], shorter: Filter | None, hash_bits: int, window: int) -> DataFrame:
    """(lang, n_words, fingerprint, n, checks, seen_in): every window's runs of these lengths by fingerprint: how many, the sum of their checks, and
    a pointer to one. In the pass over single words, rows without a fingerprint count the words of a language."""
    shared = None if shorter is None else texts.sparkSession.sparkContext.broadcast(shorter)
    names = ["lang", "n_words", "fingerprint", "n", "checks", "seen_in"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("row_key").to_numpy()
            for words, languages, number in _read(batch, hash_bits, window):
                for length, at in _frequent_runs(words, lengths, shared and shared.value):
                    if not len(at):
                        continue
                    prints = words.fingerprints(length, at)
                    order = np.argsort(prints)
                    prints, at = prints[order], at[order]
                    begin = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
                    yield pa.RecordBatch.from_arrays([
                        pa.nulls(len(begin), pa.string()), pa.array(np.full(len(begin), length, np.int32)), pa.array(prints[begin]), pa.array(np.diff(np.append(begin, len(at)))),
                        pa.array(np.add.reduceat(words.checks(length, at), begin)),
                        pa.array(np.minimum.reduceat(key[words.owner[at]], begin))], names)
                if lengths[0] == 1:
                    n = np.bincount(number[words.owner], minlength=len(languages))
                    none = pa.nulls(len(languages), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), none.cast(pa.int32()), none, pa.array(n), none, none], names)

    return texts.mapInArrow(count, COUNTS)


def _spell_pass(pointed: DataFrame, longest: int, hash_bits: int, window: int) -> DataFrame:
    """(lang, fingerprint, phrase, n_words, check): the text of the wanted runs, read where their pointers point. `pointed` has the texts and the
    fingerprints wanted from each."""
    names = ["lang", "fingerprint", "phrase", "n_words", "check"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.unique(batch.column("wanted").flatten().to_numpy())
            for words, languages, number in _read(batch, hash_bits, window):
                for length in range(1, longest + 1):
                    at = np.flatnonzero(words.whole(length))
                    prints = words.fingerprints(length, at)
                    held = np.isin(prints, wanted)
                    at, prints, checks = at[held], prints[held], words.checks(length, at[held])
                    # Runs of one fingerprint with unlike checks are all spelled, so that none hides behind another.
                    _, first = np.unique(np.stack([prints, checks], 1), axis=0, return_index=True)
                    at, prints, checks = at[first], prints[first], checks[first]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(languages, pa.string()).take(pa.array(number[words.owner[at]])), pa.array(prints),
                        pa.array([words.spell(length, i) for i in at.tolist()], pa.string()), pa.array(np.full(len(at), length, np.int32)),
                        pa.array(checks)], names)

    return pointed.select("lang", "summary", "wanted").mapInArrow(spell, SPELLED)


def _occurrence_pass(texts: DataFrame, longest: int, frequent: Filter, hash_bits: int, window: int) -> DataFrame:
    """Counts of the runs in the filter, told apart word by word within each task, with their text and a row that holds them."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        spoken: dict[str, int] = {}
        tally = Tally(longest)
        for batch in batches:
            key = batch.column("row_key").to_numpy()
            for words, languages, number in _read(batch, hash_bits, window):
                ids = words.exact_ids(known)
                language = np.array([spoken.setdefault(v, len(spoken)) for v in languages], np.int32)[number]
                for length in range(1, longest + 1):
                    at = np.flatnonzero(words.whole(length))
                    prints = words.fingerprints(length, at)
                    held = shared.value.holds(prints)
                    at, prints = at[held], prints[held]
                    runs = np.full((len(at), longest), -1, np.int32)
                    for k in range(length):
                        runs[:, k] = ids[at + k]
                    owner = words.owner[at]
                    tally.add(prints, language[owner], runs, np.ones(len(at), np.int64), key[owner])
                if tally.rows > HELD_ROWS or len(known) > HELD_WORDS:
                    yield from tally.take(list(known), list(spoken))
                    if len(known) > HELD_WORDS:
                        known = {}
        yield from tally.take(list(known), list(spoken))

    return texts.mapInArrow(look, OCCURRENCES)


def frequent_phrases(
    content: DataFrame, language: str = "sourceLanguage", min_count: int = 100, longest: int = 5,
    hash_bits: int = 64, filter_bits: int = FILTER_BITS, window: int = WINDOW,
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): `lang, phrase, n_words, n, seen_in` of all phrases of 1 to `longest` words that occur `min_count` times or more in
    their language, and `lang, total` words.

    A-Z are lower-cased, pieces end at `.,;:!?` and line ends, words at blanks and tabs; a phrase lies within one piece, and overlapping
    occurrences all count. A null language is `und`, a null text empty. `seen_in` points to a row that holds the phrase: the upper
    half of the `xxhash64` of its id and text.

    Prefix polynomials give every run of words its fingerprint and a second hash, its check. Single words, pairs, then longer runs
    are counted by fingerprint; a run is only counted where its shorter runs may be frequent, by a filter of a fixed number of bits
    that never misses one. The shuffle brings fingerprints together with their counts, the sums of their checks and a pointer to an
    occurrence. Only frequent ones are then looked up and spelled, and a phrase stands if the sum of the checks is its own check times
    its count. Where it is not, different phrases met in one fingerprint: their texts are counted apart, word by word.
    """
    texts = content.select(
        F.coalesce(F.col(f"`{language}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), text().alias("summary"),
        F.shiftrightunsigned(F.xxhash64("content_id", text()), 32).alias("row_key"))

    def frequent(lengths: Sequence[int], shorter: Filter | None) -> DataFrame:
        counted = _count_pass(texts, lengths, shorter, hash_bits, window).groupBy("lang", "n_words", "fingerprint").agg(
            F.sum("n").alias("n"), F.sum("checks").alias("checks"), F.min("seen_in").alias("seen_in"))
        return materialize(counted.where((F.col("n") >= min_count) | F.col("fingerprint").isNull()), "frequent")

    single = frequent([1], None)
    totals = single.where("fingerprint is null and n > 0").select("lang", F.col("n").alias("total"))
    known = last = single.where("fingerprint is not null").drop("lang")
    for lengths in ([2], list(range(3, longest + 1))):
        if lengths and lengths[0] <= longest:
            last = frequent(lengths, _filter(last.select("fingerprint"), filter_bits)).drop("lang")
            known = known.unionByName(last)
    run = ["n_words", "fingerprint"]
    # A text has no more fingerprints than runs of words, so the lists are bounded by the texts.
    wanted = known.groupBy("seen_in").agg(F.collect_list("fingerprint").alias("wanted"))
    pointed = texts.join(wanted, F.col("row_key") == F.col("seen_in")).dropDuplicates(["row_key", "summary", "lang"])
    spelled = _spell_pass(pointed, longest, hash_bits, window).distinct().join(known, run).where(
        F.col("checks") == F.col("check") * F.col("n"))
    phrases = materialize(spelled.select("fingerprint", "lang", "phrase", "n_words", "n", "seen_in"), "phrases")
    # Two phrases that fit one fingerprint are as undecided as none.
    sure = phrases.groupBy(*run).agg(F.count("*").alias("fits")).where("fits = 1")
    unsure = materialize(known.select(*run).join(sure, run, "left_anti"), "collisions")
    out = phrases.join(sure, run, "left_semi").drop("fingerprint")
    if not unsure.isEmpty():
        apart = (
            _occurrence_pass(texts, longest, _filter(unsure, filter_bits), hash_bits, window)
            .join(unsure, run, "left_semi")
            .groupBy("lang", "fingerprint", "phrase", "n_words").agg(F.sum("n").alias("n"), F.min("seen_in").alias("seen_in"))
            .where(F.col("n") >= min_count).drop("fingerprint")
        )
        out = materialize(out.unionByName(apart.select(*out.columns)), "phrases")
    return out, totals


def mine_phrases(
    content: DataFrame, language: str = "sourceLanguage", min_count: int = 100, longest: int = 5, share: int = 100, top: int = 2000, **passes,
) -> DataFrame:
    """The `top` collocations of each language: `lang, rank, phrase, a, l, r, n, score`.

    Candidates are the phrases of 2 to `longest` words of `frequent_phrases`, which says how texts are read. Cutting a candidate that
    occurs `a` times into two parts that occur `l` and `r` times among the language's `n` words gives floor(1000 * a * n / (l * r)); the cut
    with the lowest score counts, of equal ones the one after the fewest words. A candidate within a longer one that occurs at least
    `share` per cent as often is left out. Ranks go by score and `a` descending, then by phrase bytewise. Numbers are exact
    (decimals of 38 digits). No texts or no frequent phrases give no rows.
    """
    phrases, totals = frequent_phrases(content, language, min_count, longest, **passes)
    candidates = phrases.where("n_words > 1").select("lang", "phrase", "n_words", F.col("n").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - n_words)").alias("tail"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))

    def big(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * big("a") * big("total"), big("l") * big("r"))
    scored = (
        cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
        .groupBy("lang", "phrase", "a", F.col("total").alias("n"))
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    word = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("n_words") - size + 1), lambda at: F.array_join(F.slice(word, at, size), " "))))
    covered = (
        candidates.where("n_words > 2").select("lang", "a", F.explode(inner).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    )
    left = scored.join(covered, ["lang", "phrase"], "left").where(
        F.col("cover").isNull() | (F.lit(100).cast("decimal(19,0)") * big("cover") < F.lit(share).cast("decimal(19,0)") * big("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
