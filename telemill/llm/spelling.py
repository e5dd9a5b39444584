"""Groups of spelling variants: words one edit apart, each with its most frequent neighbour and the end of that chain.

Two words one edit apart keep all but two of their positional bigrams.  Bigrams are put in one order, rare ones first,
so of each word only the three rarest are joined: two of them can be lost, and of what is left at least one is among the
three of the other word too.  A bigram that outlives an edit stands wholly on one side of it, so what lies on its other
side is the same in both words.  That limits its position more sharply than a distance would: a bigram is joined with
all that stands before it (the edit comes later) and with all that follows it (the edit came earlier).  Keys that still
hold many words are parted once more, by the half of the rest that the edit left alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .workspace import materialise, renamed

#: Letters of a word once A to Z are lower-cased, and what is none of them.
RUN, OTHER = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
#: Code points of a word at least, its occurrences at least, times that a form is as frequent, one in so many runs loses a letter.
LEAST, OFTEN, TIMES, LOSES = 7, 2, 10, 31
#: Bigrams of a word that are joined; words of a key that is not parted again; words that a task counts before it hands them on; characters of a text taken at once.
RAREST, HOT, HELD, BLOCK = 3, 256, 1 << 17, 1 << 20
#: Code points up to which a bounded edit distance verifies; its time grows with the square.
LONG = 64
#: Numbers of bigrams: one to one for code points below 256, the alphabet of words; others share them, which is allowed.
GRAMS = 1 << 16


def runs(text: str) -> Iterator[str]:
    """The maximal runs of letters of a whole text, with A to Z lower-cased."""
    low = text.encode().lower().decode()
    start = 0
    while len(low) - start > BLOCK:
        found = OTHER.search(low, start + BLOCK)
        if not found:
            break
        yield from RUN.findall(low, start, found.start())
        start = found.start()
    yield from RUN.findall(low, start)


def add_words(totals: dict[str, int], doc_id: int | None, text: str, least: int = LEAST, loses: int = LOSES) -> None:
    """Count a document's words; the checksum of id and run decides which run loses a letter, and which letter."""
    before = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    before = zlib.crc32(b":", before)
    for run, n in Counter(r for r in runs(text) if len(r) >= least).items():
        h = zlib.crc32(run.encode(), before)
        if h % loses == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        totals[run] = totals.get(run, 0) + n


def words(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word and n (occurrences over all rows) of words of at least ``least`` code points that occur ``often`` or more.

    A null text has no words, a null id counts as empty in the checksum, repeated rows count as often as they stand.
    Tasks add up what they meet before it is shuffled, in memory of fixed size.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], schema=schema)
            totals.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for key, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                    add_words(totals, key, text.as_py() or "", least)
                    if len(totals) >= HELD:
                        yield flush()
        if totals:
            yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _grams(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, word and position of every bigram of a list of words."""
    codes = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(w) for w in some], dtype=np.int64)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(some)), sizes)
    place = np.arange(len(codes)) - (ends - sizes)[of]
    inner = np.ones(len(codes), dtype=bool)
    inner[ends[sizes > 0] - 1] = False
    at = np.flatnonzero(inner)
    return ((codes[at] << np.uint32(8)) ^ codes[at + 1]) % np.uint32(GRAMS), of[at], place[at]


def gram_ranks(vocabulary: DataFrame) -> np.ndarray:
    """The place of each bigram's number in the order of frequency among words, rarest first: an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(_grams(part["word"].to_pylist())[0], minlength=GRAMS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["gram", "n"])

    counts = vocabulary.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(GRAMS, dtype=np.int64)
    total[counts["gram"].to_numpy()] = counts["n"].to_numpy()
    ranks = np.empty(GRAMS, dtype=np.int64)
    ranks[np.argsort(total, kind="stable")] = np.arange(GRAMS)
    return ranks


def rarest(some: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    """The positions of the rarest bigrams of each word; the first of equal ones."""
    gram, of, place = _grams(some)
    order = np.lexsort((place, ranks[gram], of))
    of, place = of[order], place[order]
    begins = np.searchsorted(of, np.arange(len(some)))
    use = np.arange(len(of)) - begins[of] < RAREST
    return np.split(place[use], np.searchsorted(of[use], np.arange(1, len(some))))


def _keys(vocabulary: DataFrame) -> DataFrame:
    """word, n, size, key, rest: the parts of a word that a neighbour may share around one of its rarest bigrams."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(gram_ranks(vocabulary))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = rarest(part["word"].to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part["word"], part["n"], pa.array(found, pa.list_(pa.int32()))], schema=schema)

    placed = vocabulary.select("word", "n").mapInArrow(run, "word string, n long, places array<int>")
    sides = "transform(places, p -> struct(xxhash64('<', substring(word, 1, p + 2)) AS key, substring(word, p + 3) AS rest)), transform(places, p -> struct(xxhash64('>', substring(word, p + 1)) AS key, substring(word, 1, p) AS rest))"
    return placed.select("word", "n", F.length("word").alias("size"), F.explode(F.expr(f"array_distinct(concat({sides}))")).alias("k")).select("word", "n", "size", "k.key", "k.rest")


def near_pairs(vocabulary: DataFrame, least: int = LEAST) -> DataFrame:
    """a, n_a, b, n_b (a < b): all pairs of words that differ by one inserted, deleted or replaced code point.

    Words must have four code points or more, so that three bigrams are there.  Only pairs found near leave the join.
    """
    if least < RAREST + 1:
        raise ValueError("words need more code points than bigrams are joined")
    keyed = materialise(_keys(vocabulary), "spelling-keys")
    hot, k = renamed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > HOT))
    # One edit leaves either the first half of the shorter rest, or what follows it, as it is.
    halves = "array_distinct(flatten(transform(array(greatest(length(rest) - 1, 0), length(rest)), m -> array(xxhash64(m, '<', substring(rest, 1, m div 2)), xxhash64(m, '>', right(rest, m - m div 2))))))"
    parted = keyed.join(hot, keyed["key"] == k["key"], "left").select("word", "n", "size", "key", F.explode(F.expr(f"if({list(hot.columns)[0]} IS NULL, array(0L), {halves})")).alias("part"))
    parted = materialise(parted, "spelling-parts")
    short = _joined(parted.where(F.col("size") <= LONG + 1), lambda a, b: (F.least(a["size"], b["size"]) <= LONG) & (F.levenshtein(a["word"], b["word"], 1) == 1))
    return short.unionByName(_joined(parted.where(F.col("size") > LONG), _one_edit)).distinct()


def _joined(parted: DataFrame, near: Callable[[dict[str, Column], dict[str, Column]], Column]) -> DataFrame:
    other, b = renamed(parted)
    a = {c: F.col(c) for c in parted.columns}
    same = (a["key"] == b["key"]) & (a["part"] == b["part"]) & (a["word"] < b["word"]) & (F.abs(a["size"] - b["size"]) <= 1)
    return parted.join(other, same & near(a, b)).select(a["word"].alias("a"), a["n"].alias("n_a"), b["word"].alias("b"), b["n"].alias("n_b"))


def _one_edit(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two different words are one edit apart, in time that grows with their length, not with its square.

    Bisection finds how far they agree from the beginning; what follows the next letter must then be the same.
    """
    x, y = a["word"], b["word"]

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        same = F.substring(x, F.lit(1), middle) == F.substring(y, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(middle - 1).alias("high"))

    span = F.struct(F.lit(0).alias("low"), F.least(a["size"], b["size"]).alias("high"))
    at = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(a["size"] + 1)).cast("int") + 1), span, halve, lambda s: s["low"])
    rest = lambda word, begin: F.substring(word, begin, F.lit((1 << 31) - 1))
    return rest(x, at + F.when(a["size"] >= b["size"], 2).otherwise(1)) == rest(y, at + F.when(b["size"] >= a["size"], 2).otherwise(1))


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus.

    ``form`` is the near word that occurs most (the smallest of equals) if it is ``times`` as frequent, else null;
    ``root`` is the end of the chain of forms, or the word itself.  Repeated rows count as often as they stand, null and
    empty texts have no words, other columns are ignored, and an empty table gives an empty result.
    """
    vocabulary = materialise(words(docs, least, often), "spelling-words")
    pairs = materialise(near_pairs(vocabulary, least), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    out = vocabulary.join(best, "word", "left")
    follows = F.col("near_n") >= times * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("near")).alias("form"), F.when(follows, F.col("near_n")).alias("form_n"))
    out = materialise(out, "spelling-forms")
    roots, r = renamed(_ends(out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))))
    return out.join(roots, F.col("word") == r["word"], "left").select("word", "form", F.coalesce(r["root"], F.col("word")).alias("root"), "n", "n_near", "form_n")


def _ends(links: DataFrame) -> DataFrame:
    """word and root: the last word of each chain.  Each round doubles the steps, and chains have few, as n grows ``times``."""
    links = materialise(links, "spelling-roots")
    while True:
        after, r = renamed(links)
        joined = links.join(after, F.col("root") == r["word"], "left")
        moved = materialise(joined.select("word", F.coalesce(r["root"], F.col("root")).alias("root"), r["word"].isNotNull().alias("moved")), "spelling-roots")
        links = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return links
