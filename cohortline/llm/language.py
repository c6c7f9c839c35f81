"""Language identification by rank-order profiles of character n-grams and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from cohortline.llm.common import row_function, utf8, values

PROFILE = 300
#: Expected number of learning documents per language, drawn by a hash of the id: a bound on learning only
LEARN = 4000
UNKNOWN = "und"
#: Stands for a word's edge in an n-gram
EDGE = 95
NO_GRAMS = np.empty(0, np.int64)


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, letter: np.ndarray) -> np.ndarray:
    """The n-grams of 1 to 3 characters within the lower-cased words of letters, as numbers of up to 63 bits.

    A word's edges take part in pairs and triples. Numbers of longer n-grams are greater.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.concatenate(([0], codes, [0]))
    is_letter = letter[codes]
    if not is_letter.any():
        return NO_GRAMS
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:-1] |= is_letter[1:]
    line, inner = np.where(is_letter, codes, EDGE)[keep], is_letter[keep]
    pairs = inner[:-1] | inner[1:]
    middle = inner[1:-1]
    return np.concatenate((line[inner], ((line[:-1] << 21) | line[1:])[pairs], ((line[:-2] << 42) | (line[1:-1] << 21) | line[2:])[middle]))


def ranked(found: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams, most frequent first, ties by number."""
    distinct, counts = np.unique(found, return_counts=True)
    return distinct[np.argsort(-counts, kind="stable")[:k]]


def profiles(docs: DataFrame, text_col: str, lang_col: str, draw: Column, learn: int = LEARN, k: int = PROFILE) -> DataFrame:
    """lang, gram, rank: the k most frequent n-grams of each non-null language.

    draw: a long per row, uniform over all longs. Of a language with n documents those with the lowest learn / n of
    the draws are read, so about `learn` documents; with fewer, all. Tasks count on their own before the shuffle.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(learn)) / F.col("n"))
    drawn = known.select(F.col(lang_col).cast("string").alias("lang"), utf8(text_col).alias("text"), ((draw / F.lit(2.0**64)) + 0.5).alias("at"))
    drawn = drawn.join(F.broadcast(sizes), F.col("lang") == F.col("_lang")).where(F.col("at") <= share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, held, size = letters(), {}, 0
        for batch in batches:
            for lang, raw in zip(values(batch.column("lang")), values(batch.column("text")), strict=True):
                held.setdefault(lang, []).append(found := grams(raw.decode("utf-8", "replace"), letter))
                size += len(found)
                if size > 2_000_000:
                    yield from counted(held)
                    held, size = {}, 0
        yield from counted(held)

    def counted(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            distinct, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct), pa.array(n)], names=["lang", "gram", "n"])

    totals = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return totals.withColumn("rank", place - 1).where(F.col("rank") < k).select("lang", "gram", "rank")


class Nearest:
    """Finds the profile with the least out-of-place distance: the sum over a text's ranked n-grams of how far each is from
    its place in the profile, the profile's length if it isn't there."""

    def __init__(self, rows: list[tuple[str, int, int]], k: int = PROFILE):
        self.letter, self.k = letters(), k
        self.langs = sorted({r[0] for r in rows})
        self.known = np.array(sorted({r[1] for r in rows}), np.int64)
        self.place = np.full((len(self.langs), len(self.known)), -1, np.int64)
        for lang, gram, rank in rows:
            self.place[self.langs.index(lang), np.searchsorted(self.known, gram)] = rank

    def __call__(self, raw: bytes) -> tuple[str, float]:
        top = ranked(grams(raw.decode("utf-8", "replace"), self.letter), self.k)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.known, top), len(self.known) - 1)
        there = self.known[at] == top
        place = self.place[:, at[there]]
        far = np.where(place < 0, self.k, np.abs(place - np.flatnonzero(there))).sum(axis=1) + self.k * int((~there).sum())
        best = int(far.argmin())
        second = int(np.delete(far, best).min()) if len(far) > 1 else self.k * len(top)
        return self.langs[best], 1.0 if far[best] == 0 else second / (int(far[best]) + second)


FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, learned: DataFrame, text_col: str = "text", k: int = PROFILE) -> Column:
    """A column struct of lang_pred and score for each text of docs.

    The score is the runner-up's distance over the sum of both, from one half up to 1 (against the greatest distance if
    there is one language). Null texts, texts without letters, and all texts if no language was learned: `und`, 0. Ties go to
    the first language by code point. Profiles are broadcast: k rows for each language code.
    """
    rows = [tuple(r) for r in learned.collect()]
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    return row_function(lambda: Nearest(sent.value, k), FOUND)(utf8(text_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: int = LEARN, k: int = PROFILE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A document is held out if crc32 of its id as text leaves 2 when divided by 4; the others with a language are learned
    from. A null id is not held out and not learned from. Repeated rows stay. Other columns are not read.
    """
    part = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    learned = profiles(docs.where(part != 2), text_col, lang_col, F.xxhash64(F.col(id_col).cast("string")), learn, k)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(part == 2, F.lit(False)).alias("held_out"), predict(docs, learned, text_col, k).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
