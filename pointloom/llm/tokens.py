"""Encoding of a corpus with a public byte-level BPE vocabulary, in Spark's own expressions.

A text falls into words by the vocabulary's pattern. A word is an array of byte pieces (hex), and a higher-order fold joins
the neighbours of lowest rank until no pair has a rank. The rank map is a literal in the plan, cut into small maps by
checksum so that a look-up compares a dozen keys. The distinct words that stand most often in the corpus are encoded once
and put into the plan as a second such literal; the words of a text are looked up there, any other word is folded where it
stands. So a text never leaves its row: nothing but distinct words is shuffled. Decoding looks pieces up in a literal array
and joins their bytes.
"""

from __future__ import annotations

import base64
import copy
import heapq
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space, and the pattern that cuts texts into words.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
BUCKETS = 8192
#: Texts with a word longer than this many bytes are merged by a heap in Python, since the fold copies the word each step.
FOLD_BYTES = 1024
#: Encoded words in the plan, bytes of them, and how often a word must stand: the most frequent ones. The rest is folded in
#: place, with the same result.
CACHE_WORDS, CACHE_BYTES, OFTEN = 50_000, 2_000_000, 3
_NONE = 2**31 - 1


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Piece -> rank of a .tiktoken file (default: byte_bpe_50k)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


class RankMap:
    """The literal rank map and the expressions on it."""

    def __init__(self, ranks: dict[bytes, int]):
        cut: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        self.pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            h = piece.hex().upper()
            cut[zlib.crc32(h.encode()) % BUCKETS][h] = rank
            self.pieces[rank] = h
        # a constant expression: the optimizer turns it into a literal once
        self.table = F.from_json(F.lit(json.dumps(cut)), "array<map<string,int>>")

    def within(self, use) -> Column:
        """use(ranks) with the literal named once for all its look-ups, so that the plan holds it once."""

        def bound(table: Column) -> Column:
            named = copy.copy(self)
            named.table = table
            return use(named)

        return _bind(self.table, bound)

    def rank(self, piece: Column) -> Column:
        return F.try_element_at(F.get(self.table, (F.crc32(piece) % BUCKETS).cast("int")), piece)

    def _pair(self, x: Column, y: Column) -> Column:
        return F.coalesce(self.rank(F.concat(x, y)), F.lit(_NONE))

    def _merge_once(self, state: Column, _: Column) -> Column:
        """Joins the first pair of lowest rank; only the ranks beside it are looked up anew. ranks[i] is that of the pieces
        i and i + 1."""

        def join(low: Column, at: Column) -> Column:
            parts, ranks = state["parts"], state["ranks"]
            n, none = F.size(parts), F.array().cast("array<int>")

            def with_piece(piece: Column) -> Column:
                left = F.when(at > 1, F.array(self._pair(F.get(parts, at - 2), piece))).otherwise(none)
                right = F.when(at + 1 < n, F.array(self._pair(piece, F.get(parts, at + 1)))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(parts, F.lit(1), at - 1), F.array(piece), F.slice(parts, at + 2, F.greatest(n - at - 1, F.lit(0)))).alias("parts"),
                    F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(ranks, at + 2, F.greatest(n - at - 2, F.lit(0)))).alias("ranks"),
                )

            return F.when(low == _NONE, state).otherwise(_bind(F.concat(F.get(parts, at - 1), F.get(parts, at)), with_piece))

        low = F.coalesce(F.array_min(state["ranks"]), F.lit(_NONE))
        place = F.array_position(state["ranks"], low).cast("int")
        return _bind(F.struct(low.alias("low"), place.alias("at")), lambda m: join(m["low"], m["at"]))

    def word_ids(self, word: Column) -> Column:
        """Ids of a word by folding ranked merges; a word that is a piece itself needs none."""
        h = F.hex(word)

        def fold(bytes_: Column) -> Column:
            n = F.size(bytes_)
            start = F.struct(bytes_.alias("parts"), F.zip_with(F.slice(bytes_, F.lit(1), n - 1), F.slice(bytes_, F.lit(2), n - 1), self._pair).alias("ranks"))
            return F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), start, self._merge_once, lambda s: F.transform(s["parts"], self.rank))

        whole = self.rank(h)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(_bind(F.regexp_extract_all(h, F.lit(".."), 0), fold))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and a linked list: for words of any length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], nxt[i], alive[j] = stop, nxt[j], False
        if nxt[i] < n:
            prev[nxt[i]] = i
        for a in (prev[i], i):
            if a >= 0 and nxt[a] < n and (r := ranks.get(word[a : end[nxt[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[nxt[a]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), 0)


def _frequent(counts: DataFrame, words: int, size: int) -> Column:
    """Which words of (word, n) to keep: those above the lowest count at which no more than ``words`` words of ``size`` bytes
    in all are left. Counts are taken in steps of an eighth of a power of two, so few numbers come to the driver."""
    level = F.floor(F.log2("n") * 8).cast("int")
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    least, held, weight = 1 << 30, 0, 0
    for r in sorted(steps, key=lambda r: -r["level"]):
        held, weight = held + r["words"], weight + r["bytes"]
        if held > words or weight > size:
            break
        least = r["level"]
    return (level >= least) & (F.col("n") >= OFTEN)


class WordCache:
    """Encoded words as a literal of small maps by checksum."""

    def __init__(self, coded: DataFrame, n: int):
        self.buckets = max(1, n // 4)
        bucket = F.pmod(F.crc32("word"), F.lit(self.buckets)).cast("int")
        maps = coded.groupBy(bucket.alias("b")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "ids")))).alias("m")).collect()
        told = {r["b"]: r["m"] for r in maps}
        self.literal = F.from_json(F.lit("[" + ",".join(told.get(k, "{}") for k in range(self.buckets)) + "]"), "array<map<string,array<int>>>")

    def ids(self, word: Column) -> Column:
        return F.try_element_at(F.get(self.literal, F.pmod(F.crc32(word), F.lit(self.buckets)).cast("int")), word)


def encode_texts(
    spark: SparkSession, texts: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, cache_words: int = CACHE_WORDS, fold_bytes: int = FOLD_BYTES
) -> DataFrame:
    """(key, ids): the ids of every row's text, without special tokens.

    Null and empty texts have the empty list; blank texts the ids of their blanks. Strings that look like special tokens
    are ordinary text. A repeated row is encoded as often as it stands there. The distinct words of all texts are counted
    once and kept in the checkpoint folder.
    """
    from ..core import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    ranks = load_ranks(path)
    known = RankMap(ranks)
    rows = texts.select(F.col(key).alias(key), F.col(text).alias("__text"))
    words = split_words(F.col("__text"))
    counts = rows.filter("__text <> ''").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).checkpoint()
    longest = counts.agg(F.max(F.octet_length("word"))).first()[0] or 0
    often = counts.filter(_frequent(counts, cache_words, CACHE_BYTES) & (F.octet_length("word") <= fold_bytes))
    cache = WordCache(often.select("word", known.within(lambda r: r.word_ids(F.col("word"))).alias("ids")), often.count())
    none = F.array().cast("array<int>")
    ids = known.within(lambda r: F.flatten(F.transform(words, lambda w: F.coalesce(cache.ids(w), r.word_ids(w)))))
    empty = F.col("__text").isNull() | (F.col("__text") == "")
    if longest <= fold_bytes:
        return rows.select(key, F.when(empty, none).otherwise(ids).alias("ids"))
    shared = spark.sparkContext.broadcast(ranks)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ids": [[i for w in ws for i in merge_word(w.encode(), shared.value)] for ws in pdf["words"]]})

    has_long = ~empty & F.exists(words, lambda w: F.octet_length(w) > fold_bytes)
    long = rows.filter(has_long).select(key, words.alias("words"))
    done = long.mapInPandas(merge, f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>")
    return rows.filter(~F.coalesce(has_long, F.lit(False))).select(key, F.when(empty, none).otherwise(ids).alias("ids")).unionByName(done)


def decode_ids(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with a column text: the ids' pieces, their bytes joined. Null ids give null, no ids the empty text, an id
    outside the vocabulary null."""
    pieces = RankMap(load_ranks(path)).pieces
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    found = F.transform(F.col(ids), lambda i: F.get(table, i))
    bad = F.exists(found, lambda x: x.isNull())
    return df.withColumn("text", F.when(~bad, F.decode(F.unhex(F.array_join(found, "")), "UTF-8")))


def token_counts(spark: SparkSession, texts: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every document."""
    return encode_texts(spark, texts, path=path).select("doc_id", F.size("ids").alias("tokens"))
