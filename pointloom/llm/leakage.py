"""Evaluation texts in training text: suffix arrays over shards of the corpus, searched with every suffix of every item.

Texts become words without case, accents, marks and forms (single characters in scripts without blanks). A shard is some
millions of characters of documents; its suffix array orders the suffixes that begin with words some item has in a row, to
their full length. Every suffix of every item narrows its stretch of the array by binary search, word by word, to the
longest match; the common lengths of neighbours in the array then give the match with each other place of the stretch.
Matches that go on to the left belong to a longer one. Matches of a document and item on nearby diagonals are chained over
altered words into pieces; the document carries the item when the pieces cover enough of it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a verbatim match at least; matches this near (words left out or altered) belong to one piece.
SEED, BRIDGE = 4, 4
#: Words of a piece at least ("about a sentence"), single characters where the item is written in them; part of the
#: item's words that pieces must cover.
PIECE, PIECE_SINGLE, COVER = 9, 16, 0.6
#: Part of a piece that must be verbatim: texts made from one pattern share phrases, copies differ here and there.
DENSE = 0.7
#: Characters of the documents of one shard; a longer document is a shard of its own.
SHARD_CHARS = 4_000_000
#: Places of the array that are paired with item suffixes at a time.
SLICE = 1_000_000
#: Items are held by every task; more characters than this are refused rather than broadcast.
MAX_ITEM_CHARS = 25_000_000

_SINGLE = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff"
_WORD = re.compile(f"[{_SINGLE}]|[^\\W_{_SINGLE}]+")
_ONE = re.compile(f"[{_SINGLE}]")
_INNER = re.compile(r"(?<=\d)[.,'’](?=\d)|(?<=\w)['’](?=\w)")
_MARKS = re.compile("[\\u0300-\\u036f\\u00ad\\u200b-\\u200f\\u2060\\ufeff\\u1ab0-\\u1aff\\u20d0-\\u20ff]")


def text_words(text: str | None) -> list[str]:
    """The words that matching sees; none for null, empty and blank texts."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_INNER.sub("", text.casefold()))


class Items:
    """The evaluation items as one array of word numbers, with a shared dictionary; number 0 is any other word."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        by_words: dict[tuple[str, ...], list[int]] = {}
        for i, t in rows:
            if w := tuple(text_words(t)):
                by_words.setdefault(w, []).append(i)
        self.texts = list(by_words)
        self.ids = [sorted(set(v)) for v in by_words.values()]
        self.number: dict[str, int] = {}
        for w in self.texts:
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
        self.length = np.array([len(w) for w in self.texts], "int64")
        self.start = np.append(0, np.cumsum(self.length))
        self.words = np.array([self.number[x] for w in self.texts for x in w], "int32")
        single = np.array([sum(bool(_ONE.fullmatch(x)) for x in w) * 2 > len(w) for w in self.texts], bool)
        self.piece = np.minimum(np.where(single, PIECE_SINGLE, PIECE), self.length)
        self.item_of = np.repeat(np.arange(len(self.texts)), self.length)

    def size(self) -> int:
        return len(self.words)


def _grams(words: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A number for the ``seed`` words from each place (equal words, equal number)."""
    h = np.zeros(len(at), "uint64")
    for k in range(seed):
        h = (h + words[at + k].astype("uint64")) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def suffix_array(words: np.ndarray, live: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``live`` in the order of the words from there on, and the number of words each shares with the one before
    it. 0 ends a suffix and must stand at the end; words beyond ``deepest`` are not looked at.

    Groups of equal beginnings are split by the next word until they are of one or at their end.
    """
    order = live[np.argsort(words[live], kind="stable")]
    key = words[order]
    same = np.zeros(len(order), bool)
    same[1:] = key[1:] == key[:-1]
    lcp = np.zeros(len(order), "int64")
    group = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    active = np.flatnonzero(same | np.append(same[1:], False))
    depth = 1
    while len(active):
        at, g = order[active], group[active]
        key = words[at + depth] if depth < deepest else np.zeros(len(at), words.dtype)
        o = np.lexsort((key, g))
        order[active], key = at[o], key[o]
        joined = np.zeros(len(active), bool)
        joined[1:] = g[1:] == g[:-1]
        same = joined.copy()
        same[1:] &= key[1:] == key[:-1]
        # what parts here, or ends here, shares so many words
        lcp[active[joined & (~same | (key == 0))]] = depth
        group[active] = active[np.maximum.accumulate(np.where(same, 0, np.arange(len(active))))]
        active = active[(same | np.append(same[1:], False)) & (key != 0)]
        depth += 1
    return order, lcp


def _narrow(column, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search in each stretch [lo, hi): first place whose word is not less (greater, with upper) than wanted."""
    lo, hi = lo.copy(), hi.copy()
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) >> 1
        word = column(live, mid)
        up = word <= want[live] if upper else word < want[live]
        lo[live[up]], hi[live[~up]] = mid[up] + 1, mid[~up]
    return lo


def matches(items: Items, docs: list[list[str]], seed: int = SEED):
    """Arrays (doc, item, doc word, item word, length) of the longest verbatim matches of at least ``seed`` words.

    The item suffixes meet the places of the array in slices, so memory is linear in items and documents however many
    places a phrase has; suffixes of fewer than ``seed`` words can't begin a match.
    """
    get, spans, parts, at = items.number.get, [], [], 0
    for d in docs:
        spans.append(at)
        parts += [np.fromiter((get(w, 0) for w in d), "int32", len(d)), np.zeros(seed, "int32")]
        at += len(d) + seed
    empty = tuple(np.zeros(0, "int64") for _ in range(5))
    if not at or not items.size():
        return empty
    words = np.concatenate(parts)
    bounds = np.array(spans)
    queries = np.flatnonzero(np.arange(items.size()) + seed <= items.start[items.item_of + 1])
    if not len(queries):
        return empty
    known = np.unique(_grams(items.words, queries, seed))
    live = np.flatnonzero(words)
    grams = _grams(words, live, seed)
    place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    live = live[known[place] == grams]
    if not len(live):
        return empty
    order, lcp = suffix_array(words, live, int(items.length.max()))
    # every suffix narrows its stretch word by word; first and last stretch that hold anything are kept
    lo, hi = np.zeros(len(queries), "int64"), np.full(len(queries), len(order), "int64")
    left, right, depth = lo.copy(), lo.copy(), np.zeros(len(queries), "int64")
    end = items.start[items.item_of[queries] + 1]
    alive, k = np.arange(len(queries)), 0
    while len(alive):
        want = items.words[queries[alive] + k]
        column = lambda i, mid, k=k: words[order[mid] + k]
        a = _narrow(column, lo[alive], hi[alive], want, False)
        b = _narrow(column, a, hi[alive], want, True)
        held = b > a
        alive = alive[held]
        lo[alive], hi[alive], depth[alive] = a[held], b[held], k + 1
        k += 1
        if k == seed:
            left[alive], right[alive] = lo[alive], hi[alive]
        alive = alive[queries[alive] + k < end[alive]]
    found = np.flatnonzero(depth >= seed)
    n = right[found] - left[found]
    out = []
    for part in np.split(found, np.searchsorted(np.cumsum(n), np.arange(SLICE, n.sum(), SLICE))):
        for lo_, hi_ in _blocks(left[part], right[part]):
            out.append(_located(items, words, order, lcp, queries[part], lo_, hi_, lo[part], hi[part], depth[part]))
    p, q, length = (np.concatenate(x) for x in zip(*out)) if out else empty[:3]
    doc, item = np.searchsorted(bounds, p, "right") - 1, items.item_of[q]
    p, q = p - bounds[doc], q - items.start[item]
    o = np.lexsort((q, p - q, item, doc))
    return doc[o], item[o], p[o], q[o], length[o]


def _blocks(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stretches as they are, or, if there are too many places in one, cut into blocks."""
    if len(lo) and (hi - lo).sum() <= 2 * SLICE:
        yield lo, hi
        return
    for cut in range(int(lo.min()) if len(lo) else 0, int(hi.max()) if len(hi) else 0, SLICE):
        yield np.clip(cut, lo, hi), np.clip(cut + SLICE, lo, hi)


def _located(items, words, order, lcp, q, lo, hi, best_lo, best_hi, depth):
    """(place, item word, length) of the matches of item suffixes with the places [lo, hi) of the array that don't go on to
    the left. Away from its longest match a suffix shares with a place the least that neighbours on the way share."""
    n = hi - lo
    k = np.repeat(np.arange(len(q)), n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[k]
    p, at = order[i], q[k]
    first = at == items.start[items.item_of[at]]
    open_ = first | (p == 0) | (words[p - 1] != items.words[at - 1])
    i, p, at, k = i[open_], p[open_], at[open_], k[open_]
    length = depth[k].copy()
    for side, step in ((i >= best_hi[k], 1), (i < best_lo[k], -1)):
        part = np.flatnonzero(side)
        if len(part):
            length[part] = _least(lcp, *((best_hi[k[part]], i[part] + 1) if step > 0 else (i[part] + 1, best_lo[k[part]] + 1)))
    return p, at, length


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for many stretches, each not empty, by halving tables."""
    size = hi - lo
    out = np.empty(len(lo), "int64")
    table, width = values, 1
    while True:
        here = np.flatnonzero((size >= width) & (size < 2 * width))
        out[here] = np.minimum(table[lo[here]], table[hi[here] - width])
        if not (size >= 2 * width).any():
            return out
        table = np.minimum(table[: len(table) - width], table[width:])
        width *= 2


def chain(p: list[int], q: list[int], n: list[int], bridge: int, piece: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item from, item to, doc from, doc to, verbatim words) of one document and item: matches in order of place,
    each joined to an earlier piece that ends at most ``bridge`` words before it on both sides. Only pieces of ``piece``
    words, DENSE of them verbatim."""
    open_: list[list[int]] = []
    done: list[list[int]] = []
    for a, b, m in sorted(zip(p, q, n)):
        best = None
        still = []
        for c in open_:
            if a - c[3] > bridge:
                done.append(c)
                continue
            still.append(c)
            gap_p, gap_q = a - c[3], b - c[1]
            if -m < gap_q <= bridge and gap_p > -m and abs(gap_p - gap_q) <= 2 and b >= c[0] and (best is None or c[1] > best[1]):
                best = c
        open_ = still
        if best is None:
            open_.append([b, b + m, a, a + m, m])
        else:
            best[4] += max(0, b + m - max(best[1], b))
            best[1], best[3] = max(best[1], b + m), max(best[3], a + m)
    return [tuple(c) for c in done + open_ if c[1] - c[0] >= piece and c[4] >= DENSE * (c[1] - c[0])]


def _covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, b in sorted(spans):
        a = max(a, end)
        if b > a:
            total, end = total + b - a, b
    return total


def leaked_items(
    spark: SparkSession, documents: DataFrame, items: DataFrame, seed: int = SEED, bridge: int = BRIDGE, cover: float = COVER
) -> DataFrame:
    """(doc_id, item_id, covered, matched_words, pieces): the items that stand in each document, with the part of their words that
    the pieces cover, the words of the longest verbatim match and the number of pieces.

    Null, empty and blank texts and items match nothing; items of equal words each give a row; a repeated doc_id gives
    its rows once. Documents are searched whole, in shards of SHARD_CHARS characters; there is no shuffle before the rows
    found. Items of more than MAX_ITEM_CHARS characters in all are refused.
    """
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > MAX_ITEM_CHARS:
        raise ValueError(f"{chars} characters of items; search them in blocks of at most {MAX_ITEM_CHARS}")
    held = Items([(r[0], r[1]) for r in items.select("item_id", "text").filter("item_id is not null").toLocalIterator()])
    shared = spark.sparkContext.broadcast(held)

    def shard(pdf: pd.DataFrame) -> list[tuple]:
        it = shared.value
        texts = pdf["text"].tolist()
        doc, item, p, q, n = matches(it, [text_words(t if isinstance(t, str) else None) for t in texts], seed)
        if not len(doc):
            return []
        # a document and item whose matches can't cover enough even together need no chaining
        pair = doc * len(it.texts) + item
        cut = np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(pair))
        # bridged words count as covered, so the bound adds them
        most = np.add.reduceat(n + bridge, cut[:-1])
        rows = []
        for k in np.flatnonzero(most >= cover * it.length[item[cut[:-1]]]):
            lo, hi = cut[k], cut[k + 1]
            i, length = item[lo], it.length[item[lo]]
            got = chain(p[lo:hi].tolist(), q[lo:hi].tolist(), n[lo:hi].tolist(), bridge, int(it.piece[i]))
            share = _covered([(c[0], c[1]) for c in got]) / length
            if share >= cover:
                d = int(pdf["doc_id"].iat[doc[lo]])
                rows += [(d, x, float(share), int(n[lo:hi].max()), len(got)) for x in it.ids[i]]
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["doc_id", "item_id", "covered", "matched_words", "pieces"]
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            ends = pdf["text"].str.len().cumsum().to_numpy()
            at = 0
            while at < len(pdf):
                # as many documents as fill the shard, one at least
                stop = max(at + 1, int(np.searchsorted(ends, SHARD_CHARS - size + (ends[at - 1] if at else 0), "right")))
                held.append(pdf.iloc[at:stop])
                size += int(ends[stop - 1] - (ends[at - 1] if at else 0))
                at = stop
                if at < len(pdf) or size >= SHARD_CHARS:
                    yield pd.DataFrame(shard(pd.concat(held, ignore_index=True)), columns=cols)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(shard(pd.concat(held, ignore_index=True)), columns=cols)

    rows = documents.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id is not null and text is not null")
    found = rows.mapInPandas(run, "doc_id bigint, item_id bigint, covered double, matched_words int, pieces int")
    return found.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("matched_words").alias("matched_words"), F.max("pieces").alias("pieces"))


def clean_documents(spark: SparkSession, documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that carry no item."""
    return documents.join(leaked_items(spark, documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
