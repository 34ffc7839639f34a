"""Modified Kneser-Ney model of order 4 over the running characters of texts, counted and solved by Spark.

A text is its words with a space after each, behind two start marks and a space; the model predicts every character of
the words and every space after a word. The first two predictions of a word look back into the word before it, so word
order enters. What is gathered and remembered is bounded by distinct things:
 * the inside of a word: the n-grams that begin at its space or later, once for each distinct word;
 * an edge: the two n-grams that reach into the word before, once for each pair of (last two characters, first two).

Every n-gram of the corpus is a row (context: three characters of 21 bits, d: the last one), n its count in learned
texts (0 where only others hold it). Lower orders count different characters before, by groupBy. All probabilities are
solved by joins, so that scoring is one look-up of each n-gram.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import POLY, keep, mix64

ORDER, CHAR_BITS = 4, 21
SPACE, START = 32, 0x110000
#: Words whose n-grams are spread out at once.
PIECE = 30_000


class Words:
    """Numbers words; keeps, by number, the classes of their last two and first two characters."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.numbers = defaultdict(count().__next__)
        self.suffix, self.prefix = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.suffixes, self.prefixes = _Classes(), _Classes()
        self.suffixes.of(np.array([START << CHAR_BITS | START]))  # class 0: before the first word

    @property
    def full(self) -> bool:
        return len(self.numbers) > self.limit

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The numbers of the words of each text."""
        return [np.fromiter(map(self.numbers.__getitem__, w), np.int64, len(w)) for w in texts]

    def new(self) -> list[bytes]:
        """Words that have come since this was last called; learns their classes."""
        words = list(islice(self.numbers, len(self.suffix), None))
        for at in range(0, len(words), PIECE):
            chars, start, end = spelled(words[at : at + PIECE])
            self.suffix = np.concatenate([self.suffix, self.suffixes.of(chars[end - 2] << CHAR_BITS | chars[end - 1])])
            self.prefix = np.concatenate([self.prefix, self.prefixes.of(chars[start + 1] << CHAR_BITS | chars[start + 2])])
        return words

    def edges(self, numbers: list[np.ndarray]) -> np.ndarray:
        """For all words of the texts, the pair (class of the word before, its own class)."""
        flat = np.concatenate(numbers)
        before = np.zeros(len(flat), np.int64)
        before[1:] = self.suffix[flat[:-1]]
        ends = np.cumsum([len(x) for x in numbers])
        first = (ends - [len(x) for x in numbers])[[len(x) > 0 for x in numbers]]
        before[first] = 0
        return before << 31 | self.prefix[flat]

    def edge_grams(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, d) of the two n-grams of each edge: those of all first ones, then those of all second ones."""
        s, p = self.suffixes.names()[edges >> 31], self.prefixes.names()[edges & ((1 << 31) - 1)]
        low = (1 << CHAR_BITS) - 1
        first, second = s << CHAR_BITS | SPACE, ((s & low) << 2 * CHAR_BITS) | (SPACE << CHAR_BITS) | (p >> CHAR_BITS)
        return np.concatenate([first, second]), np.concatenate([p >> CHAR_BITS, p & low])


class _Classes:
    def __init__(self):
        self.numbers = defaultdict(count().__next__)

    def of(self, names: np.ndarray) -> np.ndarray:
        uniq, inverse = np.unique(names, return_inverse=True)
        return np.fromiter(map(self.numbers.__getitem__, uniq.tolist()), np.int64, len(uniq))[inverse]

    def names(self) -> np.ndarray:
        return np.fromiter(self.numbers, np.int64, len(self.numbers))


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all words, each between two spaces, and the places of these two."""
    chars = np.frombuffer((b" " + b"  ".join(words) + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    spaces = np.flatnonzero(chars == SPACE)
    return chars, spaces[::2], spaces[1::2]


def inner_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, d, place of the word) of the n-grams inside words; then how many characters each word has, with its space."""
    chars, start, end = spelled(words)
    word = np.repeat(np.arange(len(words)), end - start + 1)
    p = np.flatnonzero(np.arange(len(chars)) - start[word] >= ORDER - 1)
    return chars[p - 3] << 2 * CHAR_BITS | chars[p - 2] << CHAR_BITS | chars[p - 1], chars[p], word[p], end - start


def summed(context: np.ndarray, d: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (context, d, n) with each n-gram once."""
    low = (1 << CHAR_BITS) - 1
    columns = [context >> 2 * CHAR_BITS, context >> CHAR_BITS & low, context & low, d]
    alphabet = np.unique(np.concatenate(columns))
    if len(alphabet) > 1 << 16:  # four numbers of 16 bits are a name; with more characters, half the rows at a time
        half = len(d) // 2
        yield from summed(context[:half], d[:half], n[:half])
        yield from summed(context[half:], d[half:], n[half:])
        return
    name = np.zeros(len(d), np.uint64)
    for c in columns:
        name = name << np.uint64(16) | np.searchsorted(alphabet, c).astype(np.uint64)
    _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
    yield context[first], d[first], np.bincount(inverse, weights=n).astype(np.int64)


def gram_hash(context: np.ndarray, d: np.ndarray) -> np.ndarray:
    return mix64(context.astype(np.uint64) * np.uint64(POLY) + mix64(d.astype(np.uint64) + np.uint64(1)))


@dataclass
class Model:
    """The sorted hashes of all n-grams of the corpus and their log10 probabilities."""

    hashes: np.ndarray
    logs: np.ndarray

    def look(self, context: np.ndarray, d: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(d))
        h = gram_hash(context, d)
        return self.logs[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)].astype(np.float64)

    def inner(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of the inside of each word, and its characters with the space."""
        scores, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), PIECE):
            context, d, word, size = inner_grams(words[at : at + PIECE])
            scores.append(np.bincount(word, weights=self.look(context, d), minlength=len(size)))
            sizes.append(size)
        return np.concatenate(scores), np.concatenate(sizes)


def sorted_arrays(rows) -> Model:
    """rows: an Arrow table (context, d, log_p)."""
    h = gram_hash(rows.column("context").to_numpy(), rows.column("d").to_numpy())
    order = np.argsort(h)
    return Model(h[order], rows.column("log_p").to_numpy()[order].astype(np.float32))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken from counts of 1, 2, and 3 or more, given how many n-grams have the counts 1 to 4."""
    n1, n2, n3, n4 = (max(1, n or 0) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.1), k - 0.1) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def log_probabilities(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """counts(context, d, n) -> context, d, log_p (log10) for every row, also those whose n is 0.

    Of the lower orders, a count is how many different characters stand before the n-gram. Unknown characters share
    the mass of the lowest order evenly with the known ones. All is joins and groupings of tables of n-grams.
    """

    def shorter(order: int) -> Column:
        return F.col("context").bitwiseAND(F.lit((1 << CHAR_BITS * (order - 1)) - 1)).alias("context")

    grams, wanted = {ORDER: counts.where("n > 0")}, {ORDER: counts.select("context", "d")}
    for order in range(ORDER - 1, 0, -1):
        grams[order] = keep(spark, grams[order + 1].groupBy(shorter(order), "d").agg(F.count("*").alias("n")), f"grams{order}")
        wanted[order] = wanted[order + 1].select(shorter(order), "d").distinct()
    sums = None
    for order, table in grams.items():
        row = table.agg(F.lit(order).alias("order"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count_if(F.col("n") > 2).alias("more"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds"))
        sums = row if sums is None else sums.union(row)
    sums = {r["order"]: r for r in sums.collect()}  # a row for each order
    cut = {order: discounts(*r[1:5]) for order, r in sums.items()}

    def taken(order: int) -> Column:
        return F.when(F.col("n") == 1, cut[order][0]).when(F.col("n") == 2, cut[order][1]).otherwise(cut[order][2])

    one = sums[1]
    rest = sum(a * b for a, b in zip(cut[1], (one["n1"], one["n2"], one["more"]), strict=True)) / max(1, one["total"]) if one["total"] else 1.0
    p = wanted[1].join(grams[1], ["context", "d"], "left").select("context", "d", (F.coalesce((F.col("n") - taken(1)) / max(1, one["total"]), F.lit(0.0)) + rest / (one["kinds"] + 1)).alias("p"))
    for order in range(2, ORDER + 1):
        left = grams[order].groupBy("context").agg(F.sum("n").alias("total"), (F.sum(taken(order)) / F.sum("n")).alias("left"))
        own = wanted[order].join(grams[order], ["context", "d"], "left").join(left, "context", "left")
        own = own.withColumn("below", shorter(order - 1)).join(p.select(F.col("context").alias("below"), "d", F.col("p").alias("lower")), ["below", "d"])
        p = own.select("context", "d", (F.coalesce((F.col("n") - taken(order)) / F.col("total"), F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("lower")).alias("p"))
    return p.select("context", "d", F.log10("p").alias("log_p"))
