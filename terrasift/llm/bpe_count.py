"""Operator 7: token counts by byte-pair merging with a heap over a linked list, no identifiers emitted."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plus, table

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Word counts that a worker remembers; when full it forgets all of them. Changes speed only.
CACHE_WORDS = 400_000
SPACE = "▁"


class PieceCounter:
    """Counts the tokens that a sentencepiece BPE model with byte fallback gives a text.

    The text gets one leading space if it is not empty and the model asks for it, spaces become U+2581, and its code points are
    the initial symbols. The adjacent pair whose joined piece has the best score (ties: leftmost) merges until none does; a
    symbol that is no piece counts its UTF-8 bytes. No piece has U+2581 after another character, and no piece has a line
    feed, so words are merged apart and remembered."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, int] = {}
        self.known: set[str] = set()
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
                piece = model.id_to_piece(i)
                self.known.add(piece)
                if len(piece) > 1:
                    self.rank[piece] = -int(model.get_score(i))
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.known):
            raise ValueError("a piece spans words; this model can't be counted word by word")
        if model.normalize("a  b ").lstrip(SPACE) != f"a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("the model normalises text; only identity is counted here")
        self.lead = SPACE if model.normalize("a").startswith(SPACE) else ""
        self.parts = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        self.cache: dict[str, int] = _Counts(self.merge)

    def merge(self, word: str) -> int:
        """Initial symbols minus merges, each unknown symbol at its number of bytes."""
        rank, n = self.rank, len(word)
        if word in self.known and n == 1:
            return 1
        symbols: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, length = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != length:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = joined, _ = left + symbols[j], None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank.get(joined + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, length + len(symbols[k])))
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] + joined)) is not None:
                heapq.heappush(heap, (r, h, length + len(symbols[h])))
        unknown = sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in symbols if s is not None and len(s) == 1 and s not in self.known)
        return n - merges + unknown

    def count(self, text: str) -> int:
        """Tokens of the whole text; "" has none."""
        if not text:
            return 0
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return sum(map(self.cache.__getitem__, self.parts(self.lead + text.replace(" ", SPACE))))


class _Counts(dict):
    def __init__(self, count):
        self.of = count

    def __missing__(self, word: str) -> int:
        n = self.of(word)
        if len(word) < 64:
            self[word] = n
        return n


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One counter per worker and model file."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_count(text: Column, path: str) -> Column:
    """Tokens of text under the model at path (readable on every executor); null counts as empty."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for batch in batches:
            yield batch.map(lambda t: own.count(t or ""))

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, text: str = "text") -> DataFrame:
    """docs plus n_bytes, n_tokens and over_limit (n_tokens > limit). Null text is empty: no bytes, no tokens. One task
    holds one batch of texts at a time; nothing is shuffled."""
    counted = plus(docs, n_bytes=F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), n_tokens=token_count(F.col(text), path))
    return plus(counted, over_limit=F.col("n_tokens") > limit)


def op7_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 32k piece model."""
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(MODEL))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
