"""Byte-level BPE by monoid tree reduction.

A node of the tree is a span of the text with the token ids of that span alone. Leaves are
short spans. Two neighbours join by encoding a window around their boundary anew: it grows
outwards, on either side, to the nearest place where the pre-tokeniser always breaks, whatever
stands around it (a word character before white space, or a letter before a mark). Matches
never cross such a place and start afresh there, so tokens outside the window are those of
the joined text. Where a side has no such place (one unbroken run) the window takes all of
that side. Joining is associative; a text is encoded by halves within its task. Decoding concatenates
bytes up the same tree.

Texts are rows that Spark deals out; nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RANKS = "byte_bpe_50k.tiktoken"
LEAF = 1024
#: Where a match of the pattern always ends: before white space after a word character, and before
#: these marks after a letter of these ranges (parts of Unicode that no version will change).
ALWAYS_BREAKS = re.compile(
    "(?<=\\w)(?=[ \\t\\n\\r])"
    "|(?<=[A-Za-zÀ-ÖØ-öø-ɏА-яぁ-ゖァ-ヺ一-鿿가-힣])"
    "(?=[.,;:!?()、。，！？])")


def default_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TreeCodec:
    """Encodes and decodes by halves. ``path``: a file of ranks; ``pattern``: the pre-tokeniser's."""

    def __init__(self, path: str, pattern: str | None = None, leaf: int = LEAF):
        import tiktoken

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.span_ids = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.length = list(map(len, self.bytes_of))
        self.leaf = leaf

    def _break_before(self, text: str, lo: int, at: int) -> int:
        """The last place in (lo, at) that always breaks, else lo; at itself if it breaks."""
        reach = 32
        while True:
            start, found = max(lo + 1, at - reach), lo
            for m in ALWAYS_BREAKS.finditer(text, start, at + 1):
                found = m.start()
            if found > lo or start == lo + 1:
                return found
            reach *= 4

    def join(self, text: str, lo: int, at: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of text[lo:at] and text[at:hi]; changes ``left``."""
        p = self._break_before(text, lo, at)
        if p == at:
            left += right
            return left
        m = ALWAYS_BREAKS.search(text, at, hi)
        q = m.start() if m else hi
        length, n = self.length, len(text[p:at].encode())
        while n:
            n -= length[left.pop()]
        n, drop = len(text[at:q].encode()), 0
        while n:
            n -= length[right[drop]]
            drop += 1
        left += self.span_ids(text[p:q])
        left += right[drop:]
        return left

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf:
            return self.span_ids(text[lo:hi])
        at = (lo + hi) // 2
        return self.join(text, lo, at, hi, self.encode(text, lo, at), self.encode(text, at, hi))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        at = len(ids) // 2
        return self.decode(ids[:at]) + self.decode(ids[at:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str | None, leaf: int) -> TreeCodec:
    """One codec for each Python worker."""
    return TreeCodec(path, pattern, leaf)


def encode_udf(path: str | None = None, pattern: str | None = None, leaf: int = LEAF):
    """text -> binary, the ids as little-endian unsigned 32-bit integers (null: no ids)."""
    path = path or default_path()

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        c = codec(path, pattern, leaf)
        return pd.Series([np.array(c.encode(t or ""), dtype="<u4").tobytes() for t in texts], dtype=object)

    return encode


def decode_udf(path: str | None = None, pattern: str | None = None, leaf: int = LEAF):
    """binary ids -> binary, the bytes that they stand for (null: none)."""
    path = path or default_path()

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        c = codec(path, pattern, leaf)
        return pd.Series([c.decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in ids], dtype=object)

    return decode


def encode(docs: DataFrame, *, text_col: str = "text", path: str | None = None, pattern: str | None = None, ids_name: str = "token_ids", leaf: int = LEAF) -> DataFrame:
    """``docs`` with its ids as a binary column ``ids_name`` (of a new name if that is taken). Null and
    empty texts have no ids; one row in, one row out, whatever the other columns hold."""
    common.small_batches(docs.sparkSession)
    (name,) = common.fresh(docs, ids_name)
    return docs.withColumn(name, encode_udf(path, pattern, leaf)(F.col(text_col)))


def decode(df: DataFrame, *, ids_col: str = "token_ids", path: str | None = None, pattern: str | None = None, bytes_name: str = "decoded") -> DataFrame:
    common.small_batches(df.sparkSession)
    (name,) = common.fresh(df, bytes_name)
    return df.withColumn(name, decode_udf(path, pattern)(F.col(ids_col)))


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of (doc_id, text)."""
    done = decode(encode(docs.select("doc_id", "text")).drop("text"))
    return done.select(
        "doc_id", token_count(F.col("token_ids")).alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
