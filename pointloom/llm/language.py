"""Languages of documents and of their segments, by cross-parsing entropy.

A suffix automaton per language holds labelled text. A sentence is parsed greedily into the longest phrases that an
automaton knows; the language that needs the fewest phrases wins, and the lead over the next gives the confidence.
Which labelled sentences an automaton is built from is settled while fitting, on a bounded sample: character grams of
one half of it find the wrong labels of the other half.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The classifier is fitted on about this many labelled documents a language (chosen by hash of doc_id), and each
#: automaton on at most so many characters of them. Every document is classified.
SAMPLE_DOCS, AUTOMATON_CHARS = 250, 25_000
#: Words (letters in scripts without blanks) of a whole sentence, with and without its final mark.
MIN_WORDS, MIN_WORDS_OPEN, MIN_LETTERS, MIN_LETTERS_OPEN = 4, 5, 6, 8
#: A sentence leaves its document's main language only if that needs so much more than the best.
LEAD, LEAD_PHRASES = 1.08, 0.5
#: A label that keeps less of its sample's sentences than this, after those that resemble other labels, is no language.
KEPT = 0.3
#: Nats a gram by which a label must explain its own text better than any commoner label does, or a single sentence.
AS_WELL, NEAR = 0.25, 0.05
#: Other codes and names of languages, besides those that the locale data of the platform lists.
ALIASES = {
    "en": "anglais inglés 英语 英語", "zh": "chi cmn mandarin putonghua 中文 汉语 漢語 普通话 国语 cn", "ja": "日本語 日本 jp", "ko": "한국어 kr korean", "es": "castellano castilian", "nl": "dut flemish vlaams", "de": "ger", "fr": "fre",
    "el": "gre greek", "fa": "per farsi persian", "cs": "cze", "eu": "baq", "hy": "arm", "is": "ice", "ka": "geo", "mi": "mao", "mk": "mac", "ms": "may", "my": "bur", "ro": "rum mo moldavian", "sk": "slo", "sq": "alb", "bo": "tib", "cy": "wel",
    "he": "iw hebrew", "id": "in indonesian", "yi": "ji yiddish", "sr": "scr serbian", "hr": "scc croatian", "pt": "brazilian", "nb": "bokmål",
}
#: Languages in whose words the names of all languages are known, besides each language's own.
NAMED_IN = ("en", "zh", "ja", "de", "fr", "es", "pt", "it", "nl", "ru", "ko")


def _plain(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.casefold())
    return unicodedata.normalize("NFC", "".join(c for c in s if not unicodedata.combining(c)))


def language_names(spark: SparkSession) -> dict[str, str]:
    """Written form -> two-letter code: every ISO 639-1 code, its three-letter code, its names in itself and in NAMED_IN, and
    ALIASES. The list is the platform's locale data; a form that two languages share means the first by code, codes before
    names, ALIASES before all."""
    java = spark._jvm.java.util.Locale
    codes = sorted(set(java.getISOLanguages()) - {"iw", "in", "ji", "mo", "sh"})
    names = {_plain(n): c for c, text in ALIASES.items() for n in (c, *text.split())}
    for c in codes:
        names.setdefault(c, c)
    shown = [java.forLanguageTag(t) for t in NAMED_IN]
    for c in codes:
        of = java.forLanguageTag(c)
        for n in (of.getISO3Language(), of.getDisplayLanguage(of), *[of.getDisplayLanguage(x) for x in shown]):
            if n:
                names.setdefault(_plain(n), c)
    return names


def language_code(label: str | None, names: dict[str, str]) -> str | None:
    """The two-letter code that a label means, None for null, blank and what names no language."""
    if not isinstance(label, str):
        return None
    s = _plain(label.strip())
    return names.get(s) or names.get(re.split(r"[-_\s(]", s)[0]) if s else None


_JOINED = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff"
_CJK = re.compile(f"[{_JOINED}\\uac00-\\ud7a3]")
_WORD = re.compile(f"[^\\W\\d_{_JOINED}]{{2,}}")
_ZERO = "\\u00ad\\u200b-\\u200f\\u2060\\ufeff"
_DROP = re.compile(f"[{_ZERO}]")
_MARK = re.compile(r"^[\s>|/*•\-–—]+")
_LINE = re.compile("[^\\r\\n\\v\\f\\x85\\u2028\\u2029]+")
# one set of marks in front, so that the search skips all else at once
_END = re.compile(r"[。！？.!?…](?:(?<=[。！？])[」』”’）)]*|(?<=[.!?…])[\"'”’»)\]]*(?=[\s" + _ZERO + "]|$)|(?<=[.!?])(?=[" + _JOINED + "]))")
_TWO_WORDS = re.compile(f"[^\\W\\d_{_JOINED}]{{2,}}+.*?[^\\W\\d_{_JOINED}]{{2,}}", re.S)
_THREE_WIDE = re.compile(f"[{_JOINED}\uac00-\ud7a3](?:[^{_JOINED}\uac00-\ud7a3]*[{_JOINED}\uac00-\ud7a3]){{2}}")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> str:
    """What the automata read: lower-case letters without accents, words apart by one blank."""
    s = _DROP.sub("", text)
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        s = unicodedata.normalize("NFC", "".join(c for c in s if not unicodedata.combining(c) or c in "\u3099\u309a"))
    return _NOT_LETTERS.sub(" ", s.casefold()).strip()


def _is_prose(line: str) -> bool:
    """Not a heading, and words rather than readings."""
    if line.lstrip("\ufeff \t").startswith("#"):
        return False
    return bool(_TWO_WORDS.search(line)) or (not line.isascii() and bool(_THREE_WIDE.search(line)))


def _whole(text: str, ended: bool) -> bool:
    wide = 0 if text.isascii() else len(_CJK.findall(text))
    if wide >= (MIN_LETTERS if ended else MIN_LETTERS_OPEN):
        return True
    words = _WORD.findall(text)
    return len(words) >= (MIN_WORDS if ended else MIN_WORDS_OPEN) and sum(map(len, words)) >= 0.4 * len("".join(text.split()))


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """(from, to, words) of the whole sentences of a text. Lines of one paragraph that don't end a sentence go on in the
    next one; headings, lines of readings, single words and phrases are left out."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    begin = end = -1

    def close(ended: bool) -> None:
        nonlocal held
        if held:
            s = " ".join(held)
            if _whole(s, ended):
                out.append((begin, end, s))
        held = []

    last = 0
    for m in _LINE.finditer(text):
        if text.count("\n", last, m.start()) > 1 or text.count("\r", last, m.start()) > 1:
            close(False)
        last = m.end()
        line = m.group()
        if not _is_prose(line) and not (held and (_WORD.search(line) or _CJK.search(line)) and not re.search(r"[=;#\[\]]", line)):
            close(False)
            continue
        mark = _MARK.match(line)
        at = mark.end() if mark else 0
        for e in [*_END.finditer(line, at), None]:
            stop = e.end() if e else len(line)
            piece = line[at:stop].strip()
            if piece:
                if not held:
                    begin = m.start() + at
                held.append(piece)
                end = m.start() + stop
            if e:
                close(True)
            at = stop
    close(False)
    return out


class Automaton:
    """Suffix automaton of a text: per state its transitions by character; state 0 is the start."""

    __slots__ = ("alphabet", "next")

    def __init__(self, text: str):
        nxt: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for ch in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(ch) == q:
                        nxt[p][ch] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.next, self.alphabet = nxt, frozenset(nxt[0])

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse by longest matches; a character that is unknown is one."""
        nxt, count, state = self.next, 0, None
        for ch in text:
            state = nxt[state].get(ch) if state is not None else None
            if state is None:
                count, state = count + 1, nxt[0].get(ch)
        return count


class Languages:
    """The automata of all languages in one table of arrays, through which the sentences of a whole batch step together.

    A state's transitions lie at its base plus the number of the character (row displacement), each with the state it
    belongs to, so a step is three look-ups and the table is hardly larger than the number of transitions.
    """

    def __init__(self, texts: dict[str, str], names: dict[str, str] | None = None):
        self.codes, self.names = sorted(texts), names or {}
        built = [Automaton(texts[c]) for c in self.codes]
        chars = sorted(set().union(*[a.alphabet for a in built]))
        #: character -> number from 1; 0 is any other
        self.chars = {ch: k + 1 for k, ch in enumerate(chars)}
        width = len(chars) + 1
        rows = [[(self.chars[ch], t) for ch, t in d.items()] for a in built for d in a.next]
        start = np.cumsum([0, *[len(a.next) for a in built]])
        #: the state that knows nothing; transitions of the start states; which automaton knows which character
        self.none = len(rows)
        self.begin = np.full((len(built), width), self.none, "int32")
        self.knows = np.zeros((width, len(built)), "float32")
        offset = np.repeat(start[:-1], np.diff(start))
        rows = [[(c, t + int(offset[k])) for c, t in r] for k, r in enumerate(rows)]
        for k in range(len(built)):
            for c, t in rows[start[k]]:
                self.begin[k, c], self.knows[c, k] = t, 1
        self._pack(rows, width)

    def _pack(self, rows: list[list[tuple[int, int]]], width: int) -> None:
        """Rows of several transitions are placed where they fit next, the fullest first; rows of one fill the holes."""
        size = 4 * sum(map(len, rows)) + 4 * width
        taken, base, owner, to = bytearray(size), np.zeros(len(rows) + 1, "int32"), np.full(size, -1, "int32"), np.zeros(size, "int32")
        at, end, hole = width, width, width
        for s in sorted(range(len(rows)), key=lambda s: -len(rows[s])):
            row = rows[s]
            if len(row) > 1:
                # a few places behind the last one are tried again; the search goes from one free first place to the next
                c0, rest = row[0][0], [c for c, _ in row[1:]]
                b = at = max(width, at - 32)
                while True:
                    b = taken.find(0, b + c0) - c0
                    for c in rest:
                        if taken[b + c]:
                            break
                    else:
                        break
                    b += 1
                at = b
            elif row:
                hole = taken.find(0, hole)
                b = hole - row[0][0]
            else:
                continue
            base[s] = b
            for c, t in row:
                taken[b + c], owner[b + c], to[b + c] = 1, s, t
            end = max(end, b + width)
        self.base, self.owner, self.to = base, owner[: end + width].copy(), to[: end + width].copy()

    def phrase_counts(self, texts: list[str]) -> np.ndarray:
        """(text, language) phrases of each text by each automaton; infinite for languages that lack its script."""
        n, width = len(texts), self.knows.shape[0]
        out = np.full((n, len(self.codes)), np.inf)
        if not n or not self.codes:
            return out
        size = np.fromiter(map(len, texts), "int64", n)
        number = np.zeros(0x110000, "int32")
        number[list(map(ord, self.chars))] = list(self.chars.values())
        codes = number[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        first = np.cumsum(size) - size
        # languages whose alphabet holds about as many of a text's characters as the best one's
        fits = np.zeros((n, len(self.codes)), bool)
        step = max(1, 16_000_000 // width)
        for lo in range(0, n, step):
            hi = min(lo + step, n)
            seen = np.zeros((hi - lo, width), "float32")
            seen[np.repeat(np.arange(hi - lo), size[lo:hi]), codes[first[lo] : first[hi - 1] + size[hi - 1]]] = 1
            if " " in self.chars:
                seen[:, self.chars[" "]] = 0
            share = seen @ self.knows
            most = share.max(1)
            fits[lo:hi] = (most[:, None] > 0) & (share >= (most - 0.3 * seen.sum(1))[:, None])
        text, lang = np.nonzero(fits)
        order = np.argsort(-size[text], kind="stable")
        text, lang = text[order], lang[order]
        length, at, row = size[text], first[text], lang * width
        count, state, begin = np.zeros(len(text), "int64"), np.full(len(text), self.none, "int32"), self.begin.ravel()
        # texts are longest first, so those with a k-th character come before the others
        live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        k, few = 0, 8
        while k < len(live) and live[k] >= few:
            m = live[k]
            c, s = codes[at[:m] + k], state[:m]
            i = self.base[s] + c
            lost = self.owner[i] != s
            s = self.to[i]
            new = np.flatnonzero(lost)
            s[new] = begin[row[new] + c[new]]
            state[:m] = s
            count[new] += 1
            k += 1
        for j in range(live[k] if k < len(live) else 0):  # the few longest go on one by one
            s, m = int(state[j]), int(count[j])
            for c in codes[at[j] + k : at[j] + length[j]].tolist():
                i = int(self.base[s]) + c
                if self.owner[i] == s:
                    s = int(self.to[i])
                else:
                    s, m = int(begin[row[j] + c]), m + 1
            count[j] = m
        out[text, lang] = count
        return out

    def read(self, texts: Iterable[str | None]) -> tuple[np.ndarray, ...]:
        """Arrays (text, from, to, language, confidence) of the whole sentences of many texts, in order. language is the
        place in ``codes``; sentences in no known script are left out."""
        where, lo, hi, told = [], [], [], []
        for d, t in enumerate(texts):
            for a, b, s in sentences(t if isinstance(t, str) else None):
                where.append(d)
                lo.append(a)
                hi.append(b)
                told.append(s)
        distinct = {s: k for k, s in enumerate(dict.fromkeys(told))}
        letters = list(map(letters_of, distinct))
        plain = {s: k for k, s in enumerate(dict.fromkeys(letters))}
        pick = np.array([plain[s] for s in letters], "int64")[[distinct[s] for s in told]] if told else np.zeros(0, "int64")
        cost = self.phrase_counts(list(plain))[pick]
        doc, lo, hi, n = (np.array(x, "int64") for x in (where, lo, hi, list(map(len, told))))
        known = np.isfinite(cost).any(1) if self.codes else np.zeros(len(told), bool)
        doc, lo, hi, n, cost = doc[known], lo[known], hi[known], n[known], cost[known]
        if not len(doc):
            return doc, lo, hi, doc, np.zeros(0)
        lang, least, me = cost.argmin(1), cost.min(1), np.arange(len(doc))
        # the main language is the one that wins the most characters
        heads, at = np.unique(doc, return_inverse=True)
        width = len(self.codes)
        main = np.bincount(at * width + lang, n, len(heads) * width).reshape(-1, width).argmax(1)[at]
        lang = np.where(cost[me, main] <= least * LEAD + LEAD_PHRASES, main, lang)
        own = cost[me, lang]
        cost[me, lang] = np.inf
        rest = cost.min(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            sure = np.where(rest > 0, np.maximum(0.0, 1 - own / rest), 0.0)
        return doc, lo, hi, lang, sure


def _grams(s: str) -> list[str]:
    """Trigrams; in scripts without blanks, whose alphabet is large, single characters and pairs."""
    if len(_CJK.findall(s)) * 2 > len(s):
        s = s.replace(" ", "")
        return [*s, *map("".join, zip(s, s[1:]))]
    s = f" {s} "
    return [s[i : i + 3] for i in range(len(s) - 2)]


def _clean(labelled: dict[str, Counter], total: dict[str, int]) -> dict[str, list[str]]:
    """Sentences of each label whose character grams agree with it; ``total``: documents a label has in the corpus.

    Labels are wrong or incomplete at times, and a foreign sentence in an automaton would match itself. Models of one half
    of the sentences judge the other half. A label whose text a commoner label explains about as well is that language
    under a wrong name and is dropped; each sentence goes to the label that explains it best (ties: the commoner); a label
    that keeps less than KEPT of its text is dropped too, and the rest judge again.
    """
    labels = sorted(labelled, key=lambda c: (-total.get(c, 0), c))
    sents = sorted({s for held in labelled.values() for s in held})
    if not sents:
        return {}
    # sentences as runs of (gram, times); a row of n per sentence and label tells how often it is labelled so
    number: dict[str, int] = {}
    runs = [Counter(_grams(s)) for s in sents]
    ids = np.array([number.setdefault(g, len(number)) for r in runs for g in r])
    times = np.array([m for r in runs for m in r.values()], "float64")
    first = np.concatenate([[0], np.cumsum([len(r) for r in runs])[:-1]])
    of = np.repeat(np.arange(len(sents)), [len(r) for r in runs])
    size = np.add.reduceat(times, first)
    half = np.array([zlib.crc32(s.encode()) & 1 for s in sents])
    told = np.array([[labelled[c].get(s, 0) for c in labels] for s in sents], "float64")
    seen = told * np.array([total.get(c, 1) for c in labels])
    share = seen / seen.sum(1, keepdims=True)
    trust = np.minimum(20, told.sum(1))
    kept, live = told.copy(), list(range(len(labels)))
    for _ in range(3):
        scores = np.zeros((len(sents), len(labels)))
        for f in (0, 1):
            mine = half == f
            counts = {c: np.bincount(ids, times * np.where(mine, 0.0, kept[:, c])[of], len(number)) for c in live}
            vocab = int((sum(counts.values()) > 0).sum()) + 1
            for c, n in counts.items():
                logs = np.log((n + 0.1) / (n.sum() + 1 + 0.1 * vocab))
                scores[mine, c] = np.add.reduceat(times * logs[ids], first)[mine]
        # the rarest first: is it explained by a commoner one?
        for k in range(len(live) - 1, 0, -1):
            own = kept[:, live[k]] @ scores[:, live[: k + 1]]
            if own[:k].max() >= own[k] - AS_WELL * (kept[:, live[k]] @ size):
                del live[k]
        wrong = math.log(0.15 / max(1, len(live) - 1))
        # how the sentence itself is labelled across the corpus, in documents and as if 15 % of labels were wrong
        x = scores[:, live] + trust[:, None] * (wrong + share[:, live] * (math.log(0.85) - wrong))
        vote = np.array(live)[(x >= (x.max(1) - NEAR * size)[:, None]).argmax(1)]
        kept = told * (vote[:, None] == np.arange(len(labels))[None])
        live = [c for c in live if kept[:, c].sum() >= KEPT * told[:, c].sum()]
        if not live:
            return {}
    return {labels[c]: [sents[k] for k in sorted(np.flatnonzero(kept[:, c]), key=lambda k: (-told[k, c], sents[k]))] for c in live}


def fit_languages(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, chars: int = AUTOMATON_CHARS) -> Languages:
    """Automata from a bounded sample of labelled documents: about ``sample_docs`` a language, taken by hash of doc_id,
    at most ``chars`` characters each. A language without a labelled document can't be found.

    Labels become codes in the tasks; only one number a code comes to the driver, then the sample.
    """
    spark = documents.sparkSession
    names = language_names(spark)
    shared = spark.sparkContext.broadcast(names)

    @F.pandas_udf("string")
    def code(label: pd.Series) -> pd.Series:
        known = {x: language_code(x, shared.value) for x in label.dropna().unique()}
        return label.map(known).astype(object).where(label.notna(), None)

    told = documents.filter("lang is not null and text is not null")
    total = Counter({r["code"]: r["n"] for r in told.select(code("lang").alias("code")).filter("code is not null").groupBy("code").agg(F.count("*").alias("n")).collect()})
    if not total:
        return Languages({}, names)
    u = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    rates = F.create_map(*[F.lit(x) for c in sorted(total) for x in (c, min(1.0, sample_docs / total[c]))])
    most = min(1.0, sample_docs / min(total.values()))
    sample = told.filter(u < most).withColumn("code", code("lang")).filter(F.col("code").isNotNull()).filter(u < F.try_element_at(rates, F.col("code"))).select("code", "text")
    labelled: dict[str, Counter] = defaultdict(Counter)
    for r in sample.toLocalIterator():
        for _, _, s in sentences(r["text"]):
            if x := letters_of(s):
                labelled[r["code"]][x] += 1
    texts = {}
    for c, sents in _clean(labelled, total).items():
        # spread over all sentences rather than the most frequent ones only
        out, n = [], 0
        for s in sents:
            if n > chars:
                break
            out.append(s)
            n += len(s) + 1
        if out:
            texts[c] = "\x00".join(out)
    return Languages(texts, names)


def language_segments(spark: SparkSession, documents: DataFrame, languages: Languages | None = None) -> DataFrame:
    """(doc_id, segment, start, end, lang_code, sentences, confidence): stretches of whole sentences of one language, by
    character offsets in the text; confidence is the mean of 1 - phrases of the language / phrases of the next best.

    Null, empty and blank texts, and texts without a whole sentence, give no row.
    """
    shared = spark.sparkContext.broadcast(languages or fit_languages(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, lo, hi, lang, sure = shared.value.read(pdf["text"])
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(doc)))
            at = doc[head]
            place = np.arange(len(head))
            begins = np.ones(len(head), bool)
            begins[1:] = at[1:] != at[:-1]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].to_numpy()[at], "segment": place - np.maximum.accumulate(np.where(begins, place, 0)), "start": lo[head], "end": hi[head + n - 1],
                    "lang_code": np.array(shared.value.codes, object)[lang[head]], "sentences": n, "confidence": np.add.reduceat(sure, head) / n if len(head) else sure,
                }
            )

    rows = documents.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id is not null and text is not null")
    return rows.mapInPandas(run, "doc_id bigint, segment int, start int, end int, lang_code string, sentences int, confidence double")


def document_languages(spark: SparkSession, documents: DataFrame, languages: Languages | None = None) -> DataFrame:
    """(doc_id, label_code, lang_code, sentences, share, confidence, is_case): the languages in which each document has a
    whole sentence. is_case: the label is missing, names another language, or there are several languages."""
    shared = spark.sparkContext.broadcast(languages or fit_languages(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        width, names = max(len(held.codes), 1), np.array([*held.codes, None], object)
        for pdf in batches:
            doc, lo, hi, lang, sure = held.read(pdf["text"])
            pair, at = np.unique(doc * width + lang, return_inverse=True)
            d, c = pair // width, pair % width
            size = np.bincount(at, hi - lo, len(pair))
            n = np.bincount(at, minlength=len(pair))
            labels = {x: language_code(x, held.names) for x in pdf["lang"].dropna().unique()}
            label = np.array([labels.get(x) for x in pdf["lang"]], object)[d] if len(d) else np.zeros(0, object)
            several = np.bincount(d, minlength=len(pdf))[d] > 1
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].to_numpy()[d], "label_code": label, "lang_code": names[c], "sentences": n, "share": size / np.maximum(np.bincount(d, size, len(pdf))[d], 1),
                    "confidence": np.bincount(at, sure, len(pair)) / np.maximum(n, 1), "is_case": several | (label != names[c]),
                }
            )

    rows = documents.select(F.col("doc_id").cast("bigint"), "text", "lang").filter("doc_id is not null and text is not null")
    return rows.mapInPandas(run, "doc_id bigint, label_code string, lang_code string, sentences int, share double, confidence double, is_case boolean")
