"""Texts that stop inside a word or a sentence because the rest was lost.

A backward n-gram model is trained on the whole corpus and asked, at the end of
every text, whether a unit (word, sentence, line, text) ends there or goes on:

* characters: how often the last three and five letters, the last word back to its
  beginning, and that word on to the one before it are the end of a word, against
  how often the word goes on;
* words: how often a unit ends behind the last one to four words (or signs, or
  ideographs), against how often it goes on. A run of digits is one class, and so are
  capitalised words below a relative frequency (in a second reading: all
  capitalised words), so names share their contexts.

The end of a unit is a line break, the end of a text, a closing sign or whatever
a closing sign follows; the author who leaves out the last full stop thus ends
where others end. A text's own end is taken out of the counts it is judged by. The
log-odds of "ends" against "goes on" are compared with a threshold for each
language and source: the place that best divides their histogram (Otsu), kept
within the valley between the two modes of the histogram of all texts, which is
learned anew from every corpus.

Only words of a relative frequency of at least ``COMMON`` travel to the tasks; of
those there can be no more than 1 / ``COMMON``, whatever the corpus. All counts
cover all texts. Tokens are looked up in a table of the worker and everything
behind that works on arrays.

Defined cases: null, empty and blank texts are whole; blanks at the end are
ignored; a text that ends in a replacement character lost bytes and is cut; a
text in capitals only is read in small letters; repeated texts are judged alike.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut

#: Relative frequency from which a word is a context of its own; at most 1 / COMMON words have it.
COMMON = 1e-4
#: Words of context, and letters of the contexts of characters within a word.
ORDERS, LETTERS = 4, (3, 5)
#: Tokens whose contexts a task counts before it hands on the counts, and distinct tokens a worker keeps.
COUNTED_TOKENS, KEPT_TOKENS = 300_000, 400_000
#: Bins of the histogram of log-odds and its span on either side of zero; a bin belongs to the floor of the valley up to so many times the lowest one.
BINS, _SPAN, VALLEY = 64, 8.0, 2.0
#: Keys of a final context: orders of words in both readings, the word behind its neighbour, the word, its last letters.
_KEYS = 2 * ORDERS + 2 + len(LETTERS)

_CJK = "぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"
_TOKEN = re.compile(
    rf"[{_CJK}]|[\w/:+.#-]*\d[\w/:+.-]*(?:[\w]|[:/+-](?=\s*\Z))|\d|[^\W\d_{_CJK}]\.(?=\s+[^\W\d_])|[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)*|\n|[.!?…][^\S\n]|[^\w\s]|_"
)
_HEX = re.compile(r"(?<![0-9a-zA-Z])(?=[0-9a-f]*\d)[0-9a-f]{6,}(?![g-zG-Z])")
_LETTERS = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"\s+")
_CJK_SIGN = re.compile(rf"[{_CJK}]")
_CLOSING, _CJK_CLOSING = frozenset(".!?。！？…"), frozenset("。！？")
_RARE, _START, _NAME = "\x01", "\x02", "\x03"
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def shape(token: str) -> str:
    """The token with digits and hexadecimal runs as zeros, and without the blank behind a closing sign."""
    t = token.rstrip() if token != "\n" else token
    t = _HEX.sub(lambda m: "0" * len(m.group()), t) if len(t) > 5 else t
    return re.sub(r"\d", "0", t)


def _code(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _is_word(token: str) -> bool:
    return token[:1].isalnum() and not _CJK_SIGN.match(token)


class Tokens(dict):
    """Number of each token that was met; arrays tell about it by number. Number 0 stands before a text."""

    LINE, CLOSES, ENDS, WORD = 1, 2, 4, 8

    def __init__(self, common: frozenset[int] = frozenset()):
        self.common, self.shapes = common, [""]
        self.rare, self.names, self.kind = array("Q", [_code(_START)]), array("Q", [_code(_START)]), array("B", [0])
        self.first, self.size, self.letters = array("q", [0]), array("q", [0]), array("I")

    def __missing__(self, token: str) -> int:
        t = shape(token)
        low = re.sub("0+", "0", t).lower()
        code, capital, closes = _code(low), t[:1].isupper() and t.isalpha(), t in _CLOSING
        self.rare.append(_code(_RARE) if capital and code not in self.common else code)
        self.names.append(_code(_NAME) if capital else code)
        ends = t == "\n" or (closes and (t in _CJK_CLOSING or token != t))
        word = _is_word(t)
        self.kind.append(self.LINE * (t == "\n") + self.CLOSES * closes + self.ENDS * ends + self.WORD * word)
        self.first.append(len(self.letters))
        self.size.append(len(t) if word else 0)
        if word:
            self.letters.extend(map(ord, t))
        self.shapes.append(t)
        self[token] = number = len(self.shapes) - 1
        return number

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        """Numbers of the tokens of some texts, ORDERS zeros before each text."""
        flat: list[str | None] = []
        pad = [None] * ORDERS
        for tokens in texts:
            flat += pad
            flat += tokens
        self[None] = 0
        return np.fromiter(map(self.__getitem__, flat), dtype=np.int64, count=len(flat))

    def about(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers without the repetitions of line breaks, their kinds, whether a unit ends behind each)."""
        kinds = np.frombuffer(self.kind, dtype=np.uint8)
        line = (kinds[numbers] & self.LINE) > 0
        numbers = numbers[~np.concatenate([[False], line[1:] & line[:-1]])]
        kind = kinds[numbers]
        text = numbers != 0
        ends = (kind & self.ENDS) > 0
        closed_next = np.concatenate([(kind[1:] & (self.LINE | self.CLOSES)) > 0, [False]])
        last = np.concatenate([~text[1:], [True]])
        return numbers, kind, (ends | closed_next | last) & text

    def codes(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the classes of tokens, twice: rare capitalised words are one class; all capitalised words are one class."""
        return np.frombuffer(self.rare, dtype=np.uint64)[numbers], np.frombuffer(self.names, dtype=np.uint64)[numbers]

    def heads(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of all beginnings of the words ``numbers``: the word's place in ``numbers``, is it the whole word, code of the beginning, codes of its last letters."""
        first, size = np.frombuffer(self.first, dtype=np.int64)[numbers], np.frombuffer(self.size, dtype=np.int64)[numbers]
        of = np.repeat(np.arange(len(numbers)), size)
        within = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        letter = (np.frombuffer(self.letters, dtype=np.uint32).astype(np.uint64)[within + first[of]] + np.uint64(1)) * _MIX
        letter ^= letter >> np.uint64(31)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=1)), _BASE, dtype=np.uint64)]), dtype=np.uint64)
        sums = np.cumsum(letter * powers[within], dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), sums])[np.arange(len(of)) - within]
        last = []
        for n in LETTERS:
            code = np.zeros(len(of), dtype=np.uint64)
            for back in range(n):
                there = within >= back
                code[there] += letter[np.flatnonzero(there) - back] * powers[min(back, len(powers) - 1)]
            last.append(_salted(code, 10 + n))
        return of, within == size[of] - 1, sums - before, last


def _salted(codes: np.ndarray, salt: int) -> np.ndarray:
    out = (codes ^ np.uint64(salt)) * _MIX
    return out ^ (out >> np.uint64(29))


def _contexts(codes: np.ndarray) -> list[np.ndarray]:
    """Codes of the last 1 to ORDERS tokens at each place."""
    out, acc = [], np.zeros(len(codes), dtype=np.uint64)
    padded = np.concatenate([np.full(ORDERS, _code(_START), dtype=np.uint64), codes])
    for k in range(ORDERS):
        acc = _salted(acc ^ (padded[ORDERS - k : ORDERS - k + len(codes)] + np.uint64(k + 1)), 0)
        out.append(acc)
    return out


def _split(text: str, small: bool) -> list[str]:
    return _TOKEN.findall(text.lower() if small else text)


def tokens_of(text: str) -> tuple[list[str], np.ndarray]:
    """Shapes of the tokens of a text, and whether a unit ends behind each."""
    text, table = text.rstrip(), Tokens()
    numbers, _, ends = table.about(table.numbers([_split(text, text.isupper())]))
    return [table.shapes[i] for i in numbers[ORDERS:]], ends[ORDERS:]


def _last_tokens(text: str) -> list[str]:
    """The tokens of a text that its final contexts reach back to, split where the whole text would be."""
    text = text.rstrip()
    small, size = text.isupper(), 300
    while True:
        start = len(text) - size
        if start <= 0:
            return _split(text, small)
        if blank := _BLANK.search(text, start):
            tokens = _split(text[blank.end() :], small)
            if sum(a != "\n" or b != "\n" for a, b in zip(tokens, tokens[1:])) > ORDERS:
                return tokens
        size *= 4


def word_counts(documents: DataFrame) -> DataFrame:
    """word (its code), n: all words of all texts; counts are added up per batch before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch["text"]:
                if text:
                    counts.update(_LETTERS.findall(text.lower()))
            codes = np.fromiter(map(_code, counts), dtype=np.uint64, count=len(counts))
            yield pd.DataFrame({"word": codes.view(np.int64), "n": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))})

    return documents.select("text").where("text is not null").mapInPandas(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(documents: DataFrame) -> frozenset[int]:
    """Codes of the words of relative frequency COMMON and more: at most 1 / COMMON of them."""
    counts = cut(word_counts(documents))
    everything = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r[0] % (1 << 64) for r in counts.where(F.col("n") >= F.lit(COMMON * everything)).select("word").collect())


def _counted(table: Tokens, texts: list[list[str]]) -> pd.DataFrame:
    """key, n, ends of the contexts of some texts: of tokens in both readings, and of the beginnings of words behind their neighbours, alone and by their last letters."""
    numbers, kind, ends = table.about(table.numbers(texts))
    here = np.flatnonzero(numbers)
    rare, names = table.codes(numbers)
    keys, n, e = [], [], []
    # the lowest bit of a key says whether a unit ends, so that plain sorting counts both
    for reading, codes in enumerate((rare, names)):
        for order, context in enumerate(_contexts(codes)):
            key, count = np.unique((_salted(context[here], 100 * reading + order) & ~np.uint64(1)) | ends[here].astype(np.uint64), return_counts=True)
            keys.append(key & ~np.uint64(1))
            n.append(count)
            e.append(np.where(key & np.uint64(1), count, 0))
    words = here[(kind[here] & Tokens.WORD) > 0]
    behind, at, count = np.unique(_salted(rare[words - 1], 7) ^ _salted(numbers[words].astype(np.uint64), 8), return_index=True, return_counts=True)
    at = words[at]
    of, whole, head, _ = table.heads(numbers[at])
    keys.append(_salted(head ^ rare[at - 1][of], 1) & ~np.uint64(1))
    n.append(count[of])
    e.append(np.where(whole, count[of], 0))
    word, count = np.unique(numbers[words], return_counts=True)
    of, whole, head, last = table.heads(word)
    for codes in (_salted(head, 2), *last):
        keys.append(codes & ~np.uint64(1))
        n.append(count[of])
        e.append(np.where(whole, count[of], 0))
    key, n, e = np.concatenate(keys), np.concatenate(n), np.concatenate(e)
    order = np.argsort(key)
    key, n, e = key[order], n[order], e[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(starts):
        return pd.DataFrame({"key": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "ends": np.zeros(0, np.int64)})
    return pd.DataFrame({"key": key[starts].view(np.int64), "n": np.add.reduceat(n, starts), "ends": np.add.reduceat(e, starts)})


def model_counts(documents: DataFrame, common: frozenset[int]) -> DataFrame:
    """key, n, ends: how often each context occurs, and how often a word or unit ends there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Tokens(common)
        held: list[list[str]] = []
        size = 0
        for batch in batches:
            for text in batch["text"]:
                text = text.rstrip() if text else ""
                if text:
                    held.append(_split(text, text.isupper()))
                    size += len(held[-1])
                if size >= COUNTED_TOKENS:  # counts of a part at a time, so that memory doesn't follow the partition
                    yield _counted(table, held)
                    held, size = [], 0
                    if len(table) > KEPT_TOKENS:
                        table = Tokens(common)
        if held:
            yield _counted(table, held)

    return documents.select("text").where("text is not null").mapInPandas(run, "key bigint, n bigint, ends bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def _final_keys(table: Tokens, texts: list[list[str]]) -> list[np.ndarray]:
    """Keys by which the ends of some texts are judged, those of characters only where the last token is a word."""
    numbers, kind, _ = table.about(table.numbers(texts))
    last = np.flatnonzero(np.concatenate([numbers[1:] == 0, [True]]) & (numbers != 0))
    rare, names = table.codes(numbers)
    keys = np.zeros((len(last), _KEYS), dtype=np.uint64)
    for reading, codes in enumerate((rare, names)):
        for order, context in enumerate(_contexts(codes)):
            keys[:, reading * ORDERS + order] = _salted(context[last], 100 * reading + order)
    word = (kind[last] & Tokens.WORD) > 0
    at = last[word]
    of, whole, head, letters = table.heads(numbers[at])
    keys[word, 2 * ORDERS] = _salted(head[whole] ^ rare[at - 1], 1)
    keys[word, 2 * ORDERS + 1] = _salted(head[whole], 2)
    for i, codes in enumerate(letters):
        keys[word, 2 * ORDERS + 2 + i] = codes[whole]
    keys = (keys & ~np.uint64(1)).view(np.int64)
    return [k if w else k[: 2 * ORDERS] for k, w in zip(keys, word)]


def _text_id() -> list:
    return [F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")]


def end_scores(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, score: log-odds that a unit ends where the text ends, for all texts that aren't blank.

    Equal texts are judged once, and the ends of all of them are taken out of the
    counts they are judged by, so a cut text doesn't become usual by repetition.
    """
    common = common_words(documents)
    counts = model_counts(documents, common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Tokens(common)
        for batch in batches:
            copies: Counter[tuple[int, int]] = Counter()
            asked: list[list[str]] = []
            for h1, h2, text in batch.itertuples(index=False, name=None):
                if (h1, h2) not in copies:
                    tokens = _last_tokens(text)
                    if not tokens:
                        continue
                    asked.append(tokens)
                copies[h1, h2] += 1
            yield pd.DataFrame({
                "h1": np.array([k[0] for k in copies], dtype=np.int64), "h2": np.array([k[1] for k in copies], dtype=np.int32), "copies": np.array(list(copies.values()), dtype=np.int64),
                "keys": pd.Series(_final_keys(table, asked) if asked else [], dtype="object"),
            })
            if len(table) > KEPT_TOKENS:
                table = Tokens(common)

    filled = documents.where("text is not null and trim(text) <> ''")
    asked = (
        filled.select(*_text_id(), "text").mapInPandas(run, "h1 bigint, h2 int, copies bigint, keys array<bigint>")
        .groupBy("h1", "h2").agg(F.sum("copies").alias("copies"), F.any_value("keys").alias("keys"))
        .select("h1", "h2", "copies", F.posexplode("keys").alias("at", "key"))
    )
    # a context that many texts share is one row of the counts; AQE splits its texts
    answered = asked.join(counts, "key").groupBy("h1", "h2", "copies").agg(*[
        F.max(F.when(F.col("at") == i, F.struct(F.col("n").alias("n"), F.col("ends").alias("e")))).alias(f"k{i}") for i in range(_KEYS)
    ])

    def interpolated(first: float, parts: list[tuple[int, float]]):
        p = F.lit(first)
        for i, weight in parts:
            n, e = F.greatest(F.col(f"k{i}.n") - F.col("copies"), F.lit(0)), F.greatest(F.col(f"k{i}.e") - F.col("copies"), F.lit(0))
            p = F.when(F.col(f"k{i}").isNull(), p).otherwise((e + weight * p) / (n + weight))
        return p

    p_end = F.greatest(*[interpolated(0.1, [(first + k, 2.0) for k in range(ORDERS)]) for first in (0, ORDERS)])
    word = 2 * ORDERS
    p_word = F.when(F.col(f"k{word}").isNull(), F.lit(1.0)).otherwise(interpolated(0.2, [*[(word + 2 + i, 4.0) for i in range(len(LETTERS))], (word + 1, 3.0), (word, 2.0)]))
    p = F.least(F.greatest(p_end * p_word, F.lit(1e-6)), F.lit(1 - 1e-6))
    scored = answered.select("h1", "h2", F.log(p / (1 - p)).alias("score"))
    about = filled.select("doc_id", "source", F.lower(F.substring(F.coalesce("lang", F.lit("und")), 1, 2)).alias("lang"), (F.substring(F.rtrim("text"), -1, 1) == "\ufffd").alias("lost"), *_text_id())
    return about.join(scored, ["h1", "h2"]).drop("h1", "h2")


_WIDTH = 2 * _SPAN / BINS


def _dividing(counts: np.ndarray) -> float:
    """The place that divides a histogram with the largest variance between its sides; the middle of a histogram of one bin."""
    mids = -_SPAN + (np.arange(BINS) + 0.5) * _WIDTH
    below, total = np.cumsum(counts), counts.sum()
    mean = np.cumsum(counts * mids)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((mean[-1] * below / total - mean) ** 2 / (below * (total - below)), nan=0.0, posinf=0.0)
    if between.max() <= 0:
        return float("nan")
    return float(-_SPAN + (np.flatnonzero(between >= between.max() * (1 - 1e-9)).mean() + 1) * _WIDTH)


def valley(counts: np.ndarray) -> tuple[float, float]:
    """The bounds of the floor of the valley between the two modes of a histogram: around its lowest place, the bins up to VALLEY times as high.

    A histogram without two sides has no valley (minus infinity twice: nothing lies below).
    """
    at = _dividing(counts)
    if np.isnan(at):
        return float("-inf"), float("-inf")
    split = int(round((at + _SPAN) / _WIDTH))
    left, right = int(np.argmax(counts[:split])), split + int(np.argmax(counts[split:]))
    smooth = np.convolve(counts, np.ones(5) / 5, mode="same")
    lowest = left + int(np.argmin(smooth[left : right + 1]))
    most = VALLEY * smooth[lowest]
    a = b = lowest
    while a - 1 > left and smooth[a - 1] <= most:
        a -= 1
    while b + 1 < right and smooth[b + 1] <= most:
        b += 1
    return -_SPAN + a * _WIDTH, -_SPAN + (b + 1) * _WIDTH


def thresholds(scores: DataFrame) -> DataFrame:
    """lang, source, threshold: the dividing place of each histogram of at most BINS bins, within the valley of the histogram of all texts."""
    bins = scores.select("lang", "source", F.least(F.greatest(F.floor((F.col("score") + _SPAN) / _WIDTH), F.lit(0)), F.lit(BINS - 1)).cast("int").alias("bin"))
    histogram = bins.groupBy("lang", "source", "bin").count()
    everything = np.zeros(BINS)
    for r in histogram.groupBy("bin").agg(F.sum("count").alias("n")).collect():  # at most BINS rows
        everything[r["bin"]] = r["n"]
    low, high = valley(everything) if everything.sum() else (float("-inf"), float("-inf"))

    def divide(h: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(BINS)
        counts[h["bin"].to_numpy()] = h["count"].to_numpy()
        at = _dividing(counts)
        at = min(max(at, low), high) if at == at else (low + high) / 2
        return pd.DataFrame({"lang": [h["lang"].iloc[0]], "source": [h["source"].iloc[0]], "threshold": [float(at)]})

    return histogram.groupBy("lang", "source").applyInPandas(divide, "lang string, source string, threshold double")


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, score, threshold, is_cut for every text that isn't blank."""
    scores = cut(end_scores(documents))
    joined = scores.withColumn("source_key", F.coalesce("source", F.lit("")))
    limits = thresholds(joined.select("lang", F.col("source_key").alias("source"), "score")).withColumnRenamed("source", "source_key")
    return joined.join(limits, ["lang", "source_key"]).withColumn("is_cut", (F.col("score") < F.col("threshold")) | F.col("lost")).drop("source_key")


def found(documents: DataFrame) -> DataFrame:
    """doc_id of the cut texts."""
    return judged(documents).where("is_cut").select("doc_id")


def shares(documents: DataFrame) -> DataFrame:
    """source, documents, cut_documents, cut_share over all documents; null and blank texts count as whole."""
    cut_rows = judged(documents).where("is_cut").groupBy("source").agg(F.count(F.lit(1)).alias("cut_documents"))
    return (
        documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents")).join(cut_rows.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .withColumn("cut_documents", F.coalesce("cut_documents", F.lit(0))).withColumn("cut_share", F.col("cut_documents") / F.col("documents"))
    )
