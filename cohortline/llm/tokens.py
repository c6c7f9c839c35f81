"""Token counts and ids of a given BPE tokenizer, with a shortcut for vocabulary strings that stay whole."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType

from cohortline.llm.common import Memo, row_function, utf8, words

T = TypeVar("T")
#: How the tokenizer cuts lower-case words of printable ASCII and Latin letters; fixed by the vocabulary file's own pre-tokenizer
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9\\x20\\x09-\\x0D]+"
#: Words that its normalizer changes by lower-casing alone: no character here composes with another, and İ, which becomes two, is out
PLAIN = "[!-~À-ÖØ-įı-ſ]*"
#: Texts of such words
PLAIN_TEXT = "[\\x20\\x09-\\x0D!-~À-ÖØ-įı-ſ]*"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


def load(path: str):
    """The library's tokenizer at its defaults, without truncation or padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def whole_tokens(path: str) -> frozenset[str]:
    """The proof, made once per vocabulary: the strings that the tokenizer encodes, alone, as one token.

    Each vocabulary entry that ends a word is decoded and encoded again; it is kept if one token results and its normalized
    form is itself, so that a pre-token equal to it counts one. The set is bounded by the vocabulary.
    """
    tokenizer, bytes_of = load(path), {c: b for b, c in byte_letters().items()}
    able = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(bytes_of[c] for c in entry[:-4]).decode() if entry.endswith("</w>") else ""
        except UnicodeDecodeError:
            continue
        if text and re.fullmatch(PLAIN, text) and text == text.lower():
            able.append(text)
    encoded = tokenizer.encode_batch(able, add_special_tokens=False)
    return frozenset(x for x, e in zip(able, encoded, strict=True) if len(e.ids) == 1)


class Pieces:
    """Cuts a lower-cased text as the tokenizer does, or says that the library has to."""

    def __init__(self, tokenizer):
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.plain, self.cut, self.letters = re.compile(PLAIN_TEXT).fullmatch, re.compile(PIECES).findall, byte_letters()

    def known(self, text: str) -> bool:
        return self.plain(text) is not None and ("<" not in text or not any(s in text for s in self.special))

    def coded(self, piece: str) -> str:
        return piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))


def by_piece(tokenizer, one: Callable[[str], T], joined: Callable[[Iterable[T]], T], other: Callable[[str], T]) -> Callable[[bytes], T]:
    """A function from a text's bytes to what its pre-tokens give, joined: `one` of each, or `other` of a word that can't be cut here.

    White space parts words for every rule of the tokenizer. A text of printable ASCII and Latin letters without special strings
    is lower-cased and cut in one go; in another, words with other characters or a special string go to `other` as they are.
    Pre-tokens are held, not words: lower-cased and without marks few are new.
    """
    pieces = Pieces(tokenizer)
    core, odd = Memo(one, 100_000), Memo(other, 50_000)
    each = lambda text: map(core.__getitem__, pieces.cut(text.lower()))

    def of(raw: bytes) -> T:
        text = raw.decode("utf-8", "replace")
        if pieces.known(text):
            return joined(each(text))
        found = (word.decode("utf-8", "replace") for word in words(raw))
        return joined(joined(each(word)) if pieces.known(word) else odd[word] for word in found)

    return of


def counter(path: str, whole: frozenset[str]):
    """A function from a text's bytes to its number of tokens: pre-tokens in `whole` count one, only the rest is merged."""
    tokenizer = load(path)
    pieces, merge = Pieces(tokenizer), tokenizer.model.tokenize
    return by_piece(tokenizer, lambda piece: 1 if piece in whole else len(merge(pieces.coded(piece))), sum,
                   lambda word: len(tokenizer.encode(word, add_special_tokens=False).ids))


def n_tokens(spark: SparkSession, text: str | Column, path: str) -> Column:
    """Tokens of each text; null and empty texts have none. The proven set is broadcast, its size is the vocabulary's."""
    proven = spark.sparkContext.broadcast(whole_tokens(path))
    return row_function(lambda: counter(path, proven.value), LongType(), ("token counts", path))(utf8(text))


def encoder(path: str):
    """A function from a text's bytes to its ids as little-endian unsigned 32-bit numbers, word by word and piece by piece."""
    tokenizer = load(path)
    pieces, merge = Pieces(tokenizer), tokenizer.model.tokenize
    packed = lambda ids: array("I", ids).tobytes()
    return by_piece(tokenizer, lambda piece: packed([t.id for t in merge(pieces.coded(piece))]), b"".join,
                   lambda word: packed(tokenizer.encode(word, add_special_tokens=False).ids))


def token_ids(text: str | Column, path: str) -> Column:
    return row_function(lambda: encoder(path), BinaryType(), ("token ids", path))(utf8(text))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: id, UTF-8 bytes, tokens and whether they exceed `limit`.

    Null texts count as empty; null ids and repeated rows stay as they are; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(utf8(text_col)).cast("long").alias("n_bytes"),
                       n_tokens(docs.sparkSession, text_col, path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
