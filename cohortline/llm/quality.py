"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, perplexities, and quantiles per language.

The model predicts the characters of a word, and its end, from up to ORDER - 1 characters before them in the word. Its
counts come from all trusted text. A document's perplexity is that of its words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from cohortline.llm.common import row_function, unused, utf8, values, words
from cohortline.llm.substrings import bitmap
from cohortline.session import cut

ORDER = 5
#: Mark a word's start and end, and a piece that goes on in a long word; none is a character of a word
START, END, ON = "\x02", "\x03", "\x01"
#: n-grams, the most used ones, whose costs are sent to all scoring tasks; a document's others are joined with theirs
HELD = 200_000
#: Distinct words that a task counts before it spreads them, and symbols that it spreads into n-grams at a time
WORDS, SYMBOLS = 200_000, 1 << 19
#: Longer words are handled in pieces of so many symbols, each with the ORDER - 1 symbols before it: no n-gram is lost or added
LONGEST = 64
#: Bytes of text whose words a task counts at a time
ROOM = 32 << 20
#: Share of a language's trusted documents that a threshold lets pass, and what is added to its log perplexity
QUANTILE, SLACK = 0.99, 0.10
#: Symbols of the language's usual perplexity that each document is mixed with, so that few words decide nothing
PRIOR = 100.0
#: Bits of the bitmap of trusted ids, 2 MB
FILTER_BITS = 24
#: Log perplexities are ordered in steps of this size
STEP = 0.001
NO_LANG = "und"


def pieces_of(word: bytes, order: int = ORDER) -> list[str]:
    """The marked word, or a long one's pieces: all but the first begin with ON and the symbols that its first one follows."""
    text = word.decode("utf-8", "replace")
    if START in text or END in text or ON in text:
        for mark in (START, END, ON):
            text = text.replace(mark, "\ufffd")
    whole = START + text + END
    if len(text) <= LONGEST:
        return [whole]
    return [whole[:LONGEST]] + [ON + whole[k - order + 1:k + LONGEST] for k in range(LONGEST, len(whole), LONGEST)]


def marked(piece: str) -> str:
    return piece if piece[:1] in (START, ON) else START + piece + END


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[Counter]:
    """Counts of words, WORDS of them or the words of ROOM bytes at a time."""
    held, seen = Counter(), 0
    for batch in batches:
        for raw in values(batch.column("text")):
            held.update(words(raw))
            seen += len(raw)
            if len(held) > WORDS or seen > ROOM:
                yield held
                held, seen = Counter(), 0
    yield held


def word_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """word, n over the column `text` (bytes) of all rows; each task counts on its own first, in bounded memory.

    Words are marked, long ones in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(counted, lots(batches))

    def counted(held: Counter) -> pa.RecordBatch:
        found: Counter = Counter()
        for word, n in held.items():
            for piece in pieces_of(word, order):
                found[piece] += n
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ngram_counts(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n, length: raw counts of the longest n-gram before each predicted symbol, and continuation counts of shorter ones.

    An n-gram that starts a word has no symbol before it and keeps its raw count at its own length. Any other, shorter one
    counts the distinct symbols seen before it: the rows one symbol longer that end in it. Each length is one shuffle on
    the n-gram.
    """
    whole = counted.select(F.col("word").alias("w"), "n")
    ends = F.explode(F.sequence(F.when(F.startswith("w", F.lit(ON)), order + 1).otherwise(2), F.length("w"))).alias("end")
    longest = whole.select("w", "n", ends).select(F.expr(f"substring(w, greatest(1, end - {order - 1}), least(end, {order}))").alias("gram"), "n")
    longest = cut(longest.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("length", F.length("gram")))
    levels = [longest.where(F.col("length") == order)]
    for length in range(order - 1, 0, -1):
        shorter = levels[-1].select(F.expr("substring(gram, 2)").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        starts = longest.where(F.col("length") == length).select("gram", "n")
        levels.append(cut(shorter.union(starts).withColumn("length", F.lit(length))))
    return reduce(DataFrame.union, levels)


def discounts(grams: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, per length, from the number of n-grams seen 1 to 4 times."""
    seen = {(r["length"], r["n"]): r["k"] for r in grams.where("n <= 4").groupBy("length", "n").agg(F.count(F.lit(1)).alias("k")).collect()}
    found = {}
    for length in {a for a, _ in seen} | set(range(1, ORDER + 1)):
        n1, n2, n3, n4 = (seen.get((length, k), 0) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        more = [k + 1 - (k + 2) * y * b / a if a and b else k * 0.5 + 0.25 for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)))]
        found[length] = tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(more))
    return found


def model(trusted: DataFrame, text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Two written tables: gram, length, own (its discounted share among those of its context); context, rest (what that
    leaves to the next shorter context). Counts cover all trusted rows; none is left out. They meet their contexts' totals in
    shuffled joins.
    """
    grams = cut(ngram_counts(word_counts(trusted.select(utf8(text_col).alias("text")), order), order))
    table = discounts(grams)
    grams = grams.withColumn("context", F.expr("substring(gram, 1, length - 1)"))
    off = [F.coalesce(*(F.when(F.col("length") == length, d[k]) for length, d in sorted(table.items()))) for k in range(3)]
    once, twice = F.col("n") == 1, F.col("n") == 2
    contexts = grams.groupBy("context", "length").agg(
        F.sum("n").alias("total"), F.count_if(once).alias("ones"), F.count_if(twice).alias("twos"), F.count_if(F.col("n") > 2).alias("more"))
    contexts = cut(contexts.select("context", "total", ((F.col("ones") * off[0] + F.col("twos") * off[1] + F.col("more") * off[2]) / F.col("total")).alias("rest")))
    own = (F.col("n") - F.when(once, off[0]).when(twice, off[1]).otherwise(off[2])) / F.col("total")
    return cut(grams.join(contexts.drop("rest"), "context").select("gram", "length", own.alias("own"))), contexts.drop("total")


def probabilities(needed: DataFrame, own: DataFrame, rest: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, p for each needed n-gram and its ends: the probability of its last symbol after the others.

    From one symbol up to `order`, each length joins its counts, its contexts and the length below, all on keys that few
    n-grams share. An unseen symbol has what a single one keeps back, dealt evenly.
    """
    ends = needed.select(F.explode(F.expr("transform(sequence(1, length(gram)), k -> substring(gram, k))")).alias("gram"))
    ends = cut(ends.distinct().withColumn("length", F.length("gram")))
    left = rest.where("context = ''").agg(F.coalesce(F.max("rest"), F.lit(1.0))).first()[0]
    flat = F.lit(left / (1 + own.where("length = 1").count()))
    share = F.coalesce("own", F.lit(0.0))
    levels: list[DataFrame] = []
    for length in range(1, order + 1):
        now = ends.where(F.col("length") == length).select("gram").join(own.where(F.col("length") == length).select("gram", "own"), "gram", "left")
        if length == 1:
            now = now.select("gram", (share + flat).alias("p"))
        else:
            now = now.withColumn("context", F.expr(f"substring(gram, 1, {length - 1})")).withColumn("end", F.expr("substring(gram, 2)"))
            below = levels[-1].select(F.col("gram").alias("end"), F.col("p").alias("below"))
            now = now.join(rest, "context", "left").join(below, "end")
            now = now.select("gram", (share + F.coalesce("rest", F.lit(1.0)) * F.col("below")).alias("p"))
        levels.append(cut(now))
    return reduce(DataFrame.union, levels)


def grams_of(piece: str, order: int) -> list[str]:
    """The longest n-gram up to each symbol of a marked word or piece, its end included."""
    held = marked(piece)
    size = len(held)
    if held[0] == ON:
        return [held[k:k + order] for k in range(1, size - order + 1)]
    return [held[:k] for k in range(2, min(order, size + 1))] + [held[k:k + order] for k in range(size - order + 1)]


def most_used(priced: DataFrame, most: int) -> DataFrame:
    """About `most` rows of those with the most uses, all of them if there are no more.

    Uses are counted in classes of 64 to the octave, a few thousand at most; of the last class that finds room a share by hash is
    taken. So nothing is sorted, and no row but the chosen ones goes to the driver.
    """
    step = F.floor(F.log2(F.col("uses").cast("double")) * 64)
    room = most
    for at, n in sorted(map(tuple, priced.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if n > room:
            share = F.pmod(F.xxhash64("gram"), F.lit(1 << 20)) < (room << 20) // n
            return priced.where((step > at) | ((step == at) & share))
        room -= n
    return priced


def spread_grams(pieces: list[str], times: list[int], order: int) -> Iterator[tuple[str, int]]:
    """Each distinct n-gram that grams_of() gives for the pieces, with the sum of their times.

    An n-gram is packed in one number, symbol by symbol, over the symbols that occur; where no further symbol would fit, the
    numbers so far are replaced by their ranks. So equal numbers are equal n-grams.
    """
    joined = "".join(map(marked, pieces))
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    rank = np.zeros(0x110000, np.int64)
    rank[codes] = 1
    base = int(rank.sum()) + 1
    rank = rank.cumsum()  # from 1 for those that occur; 0 is left of a word
    on = codes == ord(ON)
    starts = (codes == ord(START)) | on
    word = starts.cumsum() - 1
    first = np.flatnonzero(starts)
    place = np.arange(len(codes)) - first[word]
    ends = np.flatnonzero((place > 0) & ((place >= order) | ~on[first][word]))
    place, word = place[ends], word[ends]
    key, span = np.zeros(len(ends), np.int64), 1
    for back in range(order - 1, -1, -1):
        if span * base >= 1 << 63:
            held, key = np.unique(key, return_inverse=True)
            span = len(held)
        key, span = key * base + np.where(place >= back, rank[codes[ends - np.minimum(place, back)]], 0), span * base
    sort = key.argsort()
    key = key[sort]
    tops = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    uses = np.add.reduceat(np.array(times, np.int64)[word[sort]], tops)
    last = ends[sort[tops]]
    first = last - np.minimum(place[sort[tops]], order - 1)
    for a, b, n in zip(first.tolist(), last.tolist(), uses.tolist(), strict=True):
        yield joined[a:b + 1], n


def gram_uses(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, uses over the column `text` (bytes) of all rows.

    A task counts words first and gives away the n-grams of each lot of words as they are spread; the sums are Spark's, before
    the shuffle and after it. So Python holds one lot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in lots(batches):
            yield from spread(held)

    def spread(held: Counter) -> Iterator[pa.RecordBatch]:
        pieces, times, size = [], [], 0
        for word, n in held.items():
            for piece in pieces_of(word, order):
                pieces.append(piece)
                times.append(n)
                size += len(piece)
                if size > SYMBOLS:
                    yield counted(pieces, times)
                    pieces, times, size = [], [], 0
        if pieces:
            yield counted(pieces, times)

    def counted(pieces: list[str], times: list[int]) -> pa.RecordBatch:
        grams, uses = zip(*spread_grams(pieces, times, order), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(uses, pa.int64())], names=["gram", "uses"])

    return texts.select("text").mapInArrow(run, "gram string, uses long").groupBy("gram").agg(F.sum("uses").alias("uses"))


class Scorer(dict):
    """A text's cost over held n-grams, its number of symbols, and the n-grams that aren't held with their times.

    As a dict it holds, by word, cost and number of symbols as the two parts of a complex number (whole numbers both, so
    sums are exact), for words of held n-grams alone. Its memory is bounded: words longer than LONGEST bytes aren't held, and
    it starts anew at `limit` others, which it keeps as the older half.
    """

    def __init__(self, held: dict[str, int], order: int = ORDER, limit: int = 160_000, limit_mixed: int = 50_000):
        super().__init__()
        self.held, self.order, self.limit, self.limit_mixed = held, order, limit, limit_mixed
        self.cost, self.starts = held.__getitem__, range(2, order)
        #: The same, with the n-grams that aren't held, for the other words
        self.mixed: dict[bytes, tuple[complex, list[str]]] = {}
        self.older: dict[bytes, complex] = {}
        self.rare: Counter = Counter()

    def parts(self, word: bytes) -> tuple[complex, list[str]]:
        order, pieces = self.order, pieces_of(word, self.order)
        if len(pieces) == 1 and len(held := pieces[0]) >= order:  # most words: what grams_of() gives, without its cases
            grams = [held[k:k + order] for k in range(len(held) - order + 1)]
            grams += [held[:k] for k in self.starts]
        else:
            grams = [g for piece in pieces for g in grams_of(piece, order)]
        try:
            return complex(sum(map(self.cost, grams)), len(grams)), []
        except KeyError:
            return complex(sum(self.held.get(g, 0) for g in grams), len(grams)), [g for g in grams if g not in self.held]

    def __missing__(self, word: bytes) -> complex:
        if (value := self.older.get(word)) is not None:
            self.hold(word, value)
            return value
        found = self.mixed.get(word)
        value, rare = found or self.parts(word)
        if rare:
            self.rare.update(rare)
        if len(word) > LONGEST:
            return value
        if rare:
            if len(self.mixed) >= self.limit_mixed:
                self.mixed.clear()
            self.mixed[word] = value, rare
        else:
            self.hold(word, value)
        return value

    def hold(self, word: bytes, value: complex) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = value

    def __call__(self, raw: bytes) -> tuple[int, int, list[tuple[str, int]]]:
        self.rare = Counter()
        found = sum(map(self.__getitem__, words(raw)), 0j)
        return int(found.real), int(found.imag), list(self.rare.items())


COST = T.StructType([T.StructField("cost", T.LongType()), T.StructField("symbols", T.LongType()), T.StructField("rare", T.MapType(T.StringType(), T.LongType()))])


def scores(docs: DataFrame, own: DataFrame, rest: DataFrame, keep: list[Column], text_col: str = "text", order: int = ORDER, most_held: int = HELD) -> DataFrame:
    """keep, nll, symbols for each row of docs, in shuffled joins of n-grams with their probabilities.

    Every n-gram of every document gets its probability by join. Those used most are added up where the text is, from a
    broadcast table of `most_held` rows; a document's other n-grams are joined with the whole table. Which way an n-gram
    goes changes no sum: costs are whole millionths.
    """
    needed = cut(gram_uses(docs.select(utf8(text_col).alias("text")), order))
    cost = F.round(-F.log("p") * 1_000_000).cast("long")
    priced = cut(needed.join(probabilities(needed.select("gram"), own, rest, order), "gram").select("gram", "uses", cost.alias("cost")))
    # as columns: as Python objects they would weigh many times as much in the driver
    sent = docs.sparkSession.sparkContext.broadcast(most_used(priced, most_held).select("gram", "cost").toArrow())

    def make() -> Scorer:
        return Scorer(dict(zip(*(column.to_pylist() for column in sent.value.columns), strict=True)), order)

    column = row_function(make, COST, ("costs", uuid.uuid4().hex))(utf8(text_col))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("_row"), *keep, column.alias("s")))
    late = rows.select("_row", F.explode("s.rare").alias("gram", "n")).join(priced.select("gram", "cost"), "gram").groupBy("_row").agg(F.sum(F.col("n") * F.col("cost")).alias("late"))
    joined = rows.withColumns({"cost": F.col("s.cost"), "symbols": F.col("s.symbols")}).drop("s").join(late, "_row", "left")
    return cut(joined.withColumn("nll", (F.col("cost") + F.coalesce("late", F.lit(0))) / 1e6).drop("_row", "cost", "late"))


def limits(scored: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, prior: float = PRIOR) -> dict[str | None, tuple[float, float]]:
    """For each language code the trusted mean log perplexity and the highest that passes; at None those of all together.

    scored: lang (not null), nll, symbols, trusted. Every trusted document counts, ordered in steps of STEP. The result has
    a row per language code; it is empty without trusted documents.
    """
    trusted = scored.where("trusted and symbols > 0")
    both = trusted.withColumn("lang", F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))))
    usual = both.groupBy("lang").agg((F.sum(F.round("nll", 3).cast("decimal(28,3)")).cast("double") / F.sum("symbols")).alias("usual"))
    placed = both.join(F.broadcast(usual.withColumnRenamed("lang", "_lang")), F.col("lang").eqNullSafe(F.col("_lang")))
    bins = placed.groupBy("lang", "usual", F.ceil(log_perplexity(F.col("nll"), F.col("symbols"), F.col("usual"), prior) / STEP).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    ranked = bins.withColumn("below", F.sum("n").over(Window.partitionBy("lang").orderBy("step"))).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    known = ranked.where(F.col("below") >= F.col("all") * quantile).groupBy("lang", "usual").agg((F.min("step") * STEP + slack).alias("most"))
    return {r["lang"]: (r["usual"], r["most"]) for r in known.collect()}


def log_perplexity(nll: Column, symbols: Column, usual: Column, prior: float = PRIOR) -> Column:
    return (nll + F.lit(prior) * usual) / (symbols + F.lit(prior))


def verdict(score: Column, lang: Column, known: dict[str | None, tuple[float, float]], prior: float = PRIOR) -> tuple[Column, Column, Column]:
    """Columns: log perplexity, the language's limit, whether the document stays. Without limits all stay, with nulls."""
    if not known:
        none = F.lit(None).cast("double")
        return none, none, F.lit(True)
    lookup = F.create_map(*(F.lit(x) for code, (usual, most) in sorted((k, v) for k, v in known.items() if k is not None) for x in (code, f"{usual!r} {most!r}")))
    found = F.split(F.coalesce(F.get(F.map_values(F.map_filter(lookup, lambda k, _: k == lang)), F.lit(0)), F.lit(f"{known[None][0]!r} {known[None][1]!r}")), " ")
    usual, most = (F.get(found, F.lit(k)).cast("double") for k in (0, 1))
    value = log_perplexity(score["nll"], score["symbols"], usual, prior)
    return value, most, value <= most


def labelled(good: DataFrame, own: Column, bits: int = FILTER_BITS) -> Column:
    """False for most ids that aren't among the good ones, so that their texts don't move; never false for one that is.

    A bitmap of hashes, of one size whatever the number of ids, is broadcast; the join that follows is exact.
    """
    sent = good.sparkSession.sparkContext.broadcast(bitmap(good.select(F.xxhash64(F.col("_id").cast("string")).alias("anchor")), bits))

    def maybe():
        held, last = sent.value, (1 << bits) - 1
        return lambda h: bool(held[(h & last) >> 3] >> (7 - (h & 7)) & 1)

    return row_function(maybe, T.BooleanType())(F.xxhash64(own.cast("string")))


def fit(docs: DataFrame, labels: DataFrame, keep: list[Column], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE,
        slack: float = SLACK, prior: float = PRIOR, order: int = ORDER, most_held: int = HELD) -> DataFrame:
    """Train, score every document, and judge it: keep, id, lang, symbols, log_perplexity, limit, kept for each row.

    Trusted are documents labelled quality 1 and not toxic, by their id; an id with contrary labels is not.
    """
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("_id")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(labelled(good, F.col(id_col)))
    trusted = plain.join(good.hint("merge"), F.col("id") == F.col("_id"), "left_semi")
    scored = scores(docs, *model(trusted, "text", order), [*keep, F.col(id_col).alias("id"), language(lang_col).alias("lang")], text_col, order, most_held)
    marked = scored.join(good.withColumn("trusted", F.lit(True)), F.col("id") == F.col("_id"), "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    value, most, kept = verdict(F.struct("nll", "symbols"), F.col("lang"), limits(marked, quantile, slack, prior), prior)
    return scored.withColumns({"log_perplexity": value, "limit": most, "kept": kept | (F.col("symbols") == 0)}).drop("nll")


def language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, lang, symbols, log_perplexity, limit, kept.

    Null texts and texts without words have no symbols and pass; a null language is `und`; a language without trusted
    documents has the limit of all together; null ids and repeated rows stay. Other columns are not read.
    """
    return fit(docs, labels, [], **options).withColumnRenamed("id", "doc_id")


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that pass, with all their columns.

    A document is judged by its text and language, so those that go are found again by a digest of the two.
    """
    key = F.concat(F.md5(utf8(text_col)), language(lang_col))
    judged = fit(docs, labels, [key.alias("key")], text_col=text_col, lang_col=lang_col, **options)
    own = unused(docs, "_gone")
    gone = judged.where(~F.col("kept")).select(F.col("key").alias(own)).distinct()
    return docs.join(gone, key == F.col(own), "left_anti")
