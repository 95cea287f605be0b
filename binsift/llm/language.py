"""Language identification of mixed-language text.

A word's script (from its Unicode ranges) narrows the candidate languages to those written in it: no other can win the
word. Character n-grams give a log-likelihood per candidate; Viterbi over the words, with a penalty for every switch, labels spans. The document's
language is the one whose spans hold most letters, its score their share times the posterior of that language.

Where, in every prefix, suffix and stretch of a document, no language gains more on the best one than the switching
penalty, the best path never switches. That is tested on cumulative sums first, so only texts that may switch run the
word-by-word recurrence; both ways give the same path.

Defined results: a null text, or one without a letter, is `und` with score 0. A language without letters in its learned
texts can't be predicted. Scripts that no language was learned in score 0 for every language. Ties go to the language that
sorts first. Repeated rows are labelled alike. Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import arrow_map, fold, trim

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the training sample: rows of each language, characters of a row, n-grams kept of a language.
ROWS_PER_LANG, MAX_CHARS, GRAMS = 1000, 20_000, 50_000
#: The same of all languages together, which many share: rows of the sample and n-grams of the model.
ALL_ROWS, ALL_GRAMS = 20_000, 1_000_000
#: Values of a model that tasks unfold into a table of n-grams by languages.
TABLE = 4_000_000
#: Nats that a change of language costs.
PENALTY = 12.0
#: Nats at most that one word tells a language from others, and what a language costs that isn't written in its script.
MOST, BARRED = 8.0, 1000.0
#: New words that are scored together.
TOGETHER = 4096
#: Words remembered, and characters of them.
CACHE, CACHE_CHARS = 200_000, 4_000_000
SCHEMA = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
#: First code points of script ranges (Unicode blocks) and their names.
_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_STARTS = [s for s, _ in _RANGES]


def script(word: str) -> str:
    """Script of a word's first letter; kana and han count as one, for words mix them."""
    name = _RANGES[bisect_right(_STARTS, ord(word[0])) - 1][1]
    return "han" if name == "kana" else name


def grams(word: str) -> list[str]:
    """Character trigrams of the word between its ends, and the word itself."""
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)] + [w]


@dataclass
class Likelihoods:
    """Log-likelihoods of n-grams by language, less their mean: a value of unseen n-grams for each language, and of each
    n-gram the languages it was seen in (`of[starts[i]:starts[i + 1]]`) with what they gain, and its mean gain. Grows with
    the n-grams kept of all languages together, not with n-grams times languages."""

    unseen: np.ndarray
    starts: np.ndarray
    of: np.ndarray
    gain: np.ndarray
    shift: np.ndarray

    def table(self) -> np.ndarray | None:
        """All of it as a table, for fewer look-ups a word; None if it has more than TABLE values."""
        n, k = len(self.shift), len(self.unseen)
        if n * k > TABLE:
            return None
        out = self.unseen[None, :] - self.shift[:, None]
        out[np.repeat(np.arange(n), np.diff(self.starts)), self.of] += self.gain
        return out

    def added(self, grams: list[int]) -> np.ndarray:
        """Sum over n-grams."""
        parts = [slice(self.starts[i], self.starts[i + 1]) for i in grams]
        out = len(grams) * self.unseen - self.shift[grams].sum()
        for p in parts:
            out[self.of[p]] += self.gain[p]
        return out


@dataclass
class Model:
    langs: list[str]
    index: dict[str, int]
    likelihoods: Likelihoods
    scripts: dict[str, np.ndarray]


def fit(rows: list[tuple[str, str]], keep: int = GRAMS) -> Model:
    """Learn n-gram log-likelihoods and scripts from (text, language)."""
    langs = sorted({lang for text, lang in rows if WORD.search(text)})
    keep = max(1, min(keep, ALL_GRAMS // max(1, len(langs))))
    counts: dict[str, Counter] = {lang: Counter() for lang in langs}
    seen: dict[str, Counter] = {lang: Counter() for lang in langs}
    words: dict[str, Counter] = {lang: Counter() for lang in langs}
    for text, lang in rows:
        if lang in words:
            words[lang].update(WORD.findall(text.lower()))
    for lang in langs:
        for w, n in words[lang].items():
            seen[lang][script(w)] += n
            for g in grams(w):
                counts[lang][g] += n
        counts[lang] = Counter(dict(sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:keep]))
    index = {g: i for i, g in enumerate(sorted(set().union(*counts.values())))} if langs else {}
    n = len(index)
    # An n-gram's likelihood is that of one never seen plus log(2 count + 1) where it was: only those are kept.
    at = np.array([index[g] for lang in langs for g in counts[lang]], dtype=np.int64)
    of = np.repeat(np.arange(len(langs)), [len(counts[lang]) for lang in langs])
    gain = np.log(2 * np.array([c for lang in langs for c in counts[lang].values()], dtype=np.float64) + 1)
    order = np.argsort(at, kind="stable")
    unseen = np.log(0.5 / np.array([sum(counts[lang].values()) + 0.5 * n for lang in langs])) if n else np.zeros(len(langs))
    # Each n-gram tells the languages apart only by its differences; unseen ones tell nothing.
    shift = np.bincount(at, gain, n) / max(1, len(langs))
    likelihoods = Likelihoods((unseen - unseen.mean()) / 3 if n else unseen, np.searchsorted(at[order], np.arange(n + 1)), of[order].astype(np.int32), gain[order] / 3, shift / 3)
    scripts: dict[str, np.ndarray] = {}
    for name in {s for lang in langs for s in seen[lang]}:
        scripts[name] = np.array([seen[lang][name] > 0.01 * sum(seen[lang].values()) for lang in langs])
    return Model(langs, index, likelihoods, {k: v for k, v in scripts.items() if v.any()})


class Words(dict):
    """Row of each word met so far in `scores`. full() turns the cache between texts, so that rows of one text stay valid:
    what was there becomes the older half, from which words still in use come back."""

    def __init__(self, model: Model):
        self.m = model
        self.table = model.likelihoods.table()
        self.scores = np.zeros((1024, len(model.langs)))
        self.old: dict[str, int] = {}
        self.old_scores = self.scores
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self._learn([word])
        return self[word]

    def rows(self, found: list[str]) -> np.ndarray:
        """Row of each word; words not met so far are scored together."""
        new = [w for w in dict.fromkeys(found) if w not in self]
        for lo in range(0, len(new), TOGETHER):
            self._learn(new[lo : lo + TOGETHER])
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))

    def _learn(self, new: list[str]) -> None:
        m, row = self.m, len(self)
        while row + len(new) > len(self.scores):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
        at, allowed, flat, sizes = [], [], [], []
        get = m.index.get
        for row, w in enumerate(new, row):
            self[w] = row
            self.chars += len(w)
            before = self.old.get(w)
            if before is not None:
                self.scores[row] = self.old_scores[before]
            elif (may := m.scripts.get(script(w))) is not None:  # words in a script that nothing was learned in tell nothing
                known = [i for g in grams(w) if (i := get(g)) is not None]
                at.append(row)
                allowed.append(may)
                flat += known
                sizes.append(len(known))
        if not at:
            return
        size = np.array(sizes)
        value = np.zeros((len(at), len(m.langs)))
        ends = np.cumsum(size)
        if self.table is None:
            for k in np.flatnonzero(size).tolist():
                value[k] = m.likelihoods.added(flat[ends[k] - size[k] : ends[k]])
        elif flat:
            some = size > 0
            value[some] = np.add.reduceat(self.table[flat], (ends - size)[some], axis=0)
        self.scores[at] = np.where(np.array(allowed), np.clip(value, -MOST, MOST), -BARRED)

    def full(self) -> None:
        if len(self) >= CACHE // 2 or self.chars > CACHE_CHARS:
            self.old, self.old_scores, self.chars = ({}, self.scores, 0) if self.chars > CACHE_CHARS else (dict(self), self.scores, 0)
            self.clear()
            self.scores = np.zeros((1024, len(self.m.langs)))


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Language index of each word on the path of the highest score less penalty for each switch; earlier languages win ties."""
    n, k = scores.shape
    best = list(scores[0])
    back = []
    for row in scores[1:].tolist():
        top = max(range(k), key=best.__getitem__)
        high = best[top] - penalty
        back.append([j if best[j] >= high else top for j in range(k)])
        best = [(b if b >= high else high) + s for b, s in zip(best, row)]
    at = max(range(k), key=best.__getitem__)
    out = [at]
    for step in reversed(back):
        at = step[at]
        out.append(at)
    return np.array(out[::-1])


def label(text: str, words: Words, penalty: float = PENALTY) -> tuple[str, float, list[tuple[int, int, str]]]:
    """Language, score and labelled spans (character offsets in the lower-cased text)."""
    langs = words.m.langs
    low = text.lower()
    found = WORD.findall(low)
    if not found or not langs:
        return "und", 0.0, []
    words.full()
    rows = words.rows(found)
    scores = words.scores[rows]
    size = np.fromiter(map(len, found), np.int64, len(found))
    sums = np.cumsum(scores, axis=0)
    top = int(np.argmax(sums[-1]))
    gain = np.vstack((np.zeros((1, len(langs))), sums - sums[:, top : top + 1]))
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty:
        path, mass = None, np.zeros(len(langs))
        mass[top] = size.sum()
    else:
        path = viterbi(scores, penalty)
        mass = np.bincount(path, size, len(langs))
    best = int(np.argmax(mass))
    own = sums[-1] if path is None else scores[path == best].sum(0)
    posterior = 1 / np.exp(np.clip(own - own[best], -50, 50)).sum()
    if path is None:
        return langs[best], float(posterior), [(0, len(low), langs[best])]
    spans, starts = [], [m.start() for m in WORD.finditer(low)]
    cuts = np.flatnonzero(np.diff(path)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(path)]):
        spans.append((starts[lo] if lo else 0, starts[hi] if hi < len(path) else len(low), langs[path[lo]]))
    return langs[best], float(mass[best] / mass.sum() * posterior), spans


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, carry: list[str] | None = None) -> DataFrame:
    """lang_pred, score, spans for every row of docs, after its doc_id or the columns that `carry` names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "score", "spans"]
    own = docs.select(*[c for c in carry if c not in added], F.col("text").cast("string").alias("_text")) if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    kept = own.columns[:-1]
    schema = T.StructType([*own.schema.fields[:-1], *T._parse_datatype_string(SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for b in batches:
            got = [label(t or "", words, penalty) for t in b.column("_text").to_pylist()]
            spans = [[{"start": s, "end": e, "lang": x} for s, e, x in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(spans, kind)], [*kept, *added])

    return arrow_map(own, run, schema)


def train(docs: DataFrame, where: Column | None = None, rows_per_lang: int = ROWS_PER_LANG, max_chars: int = MAX_CHARS) -> Model:
    """Fit on about rows_per_lang rows of each language, drawn by a hash of id and text, of the rows that `where` holds for.

    Every language is learned. Rows of at most max_chars characters are drawn; of a language that has a letter in none of
    those, the longer rows, of which the stretch of max_chars characters from the first letter on teaches. The rows of the
    least hash are drawn in any case. Rows that repeat id, text and language count once.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if where is None else where))
    draw, long = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)), F.length("text") > max_chars
    lettered = known.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang", draw.alias("_draw"), long.alias("_long"))
    of = lettered.groupBy("lang", "_long").agg(F.count("*").alias("n"), F.min("_draw").alias("least")).collect()
    if not of:
        return fit([])
    used = {r.lang: r for r in sorted(of, key=lambda r: not r["_long"])}  # short ones replace long ones
    rows_per_lang = max(1, min(rows_per_lang, ALL_ROWS // len(used)))
    plan = [(r.lang, r["_long"], max(int(min(1.0, rows_per_lang / r.n) * 1_000_000), r.least + 1)) for r in used.values()]
    bounds = docs.sparkSession.createDataFrame(plan, "lang string, _long boolean, _bound long")
    taken = lettered.join(F.broadcast(bounds), ["lang", "_long"]).filter("_draw < _bound")
    stretch = F.when(F.col("_long"), F.substr(F.regexp_replace("text", r"^\P{L}+", ""), F.lit(1), F.lit(max_chars))).otherwise(F.col("text"))
    taken = taken.dropDuplicates(["lang", "doc_id", "text"])  # however many rows one text has, one of each task goes on
    # The share is a mean; the limit keeps the stated bound for each language.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "doc_id", F.xxhash64("text")))
    got = taken.select("doc_id", stretch.alias("text"), "lang", "_draw").withColumn("_nth", nth).filter(F.col("_nth") <= 2 * rows_per_lang).select("doc_id", "text", "lang").collect()
    model = fit([(r.text, r.lang) for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, r.text))])
    del got
    trim()  # the sample and its counts leave the driver before later stages need the room
    return model


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans; learns only from rows that are not held out."""
    held_out = fold() == 1
    found = identify(docs, train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")
