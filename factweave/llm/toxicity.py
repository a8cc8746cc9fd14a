"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

The lexicon, its weights, the exception phrases and the calibration are learned on the driver from at most
`sample_rows` labelled documents of each class, of whole texts and of bounded total size (chosen by the md5 of their id, so
runs agree); scoring is one pass over
the documents in Arrow batches without a shuffle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied

#: Labelled documents of each class that the model is fitted on, at most, and bytes of their texts, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 8 << 20
#: A document is taken for toxic from this score.
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ӏ": "l", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ɡ": "g", "ı": "i", "ℓ": "l", "α": "a", "ο": "o",
    "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = {"@": "a", "$": "s", "!": "i"}

_LOOKS = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_CODED, _TOKEN = re.compile("[013457@$!]"), re.compile(r"[\w@$!]+")
_DECODE = str.maketrans(DIGITS | SIGNS)
_BREAK = re.compile(r"[\W_]+")


def _decoded(m: re.Match) -> str:
    """A token with coded letters replaced, if it holds a letter as well; signs at its end are punctuation."""
    token = m[0].rstrip("@$!").lstrip("!")
    if _CODED.search(token) and not token.isalpha() and any(map(str.isalpha, token)):
        token = token.translate(_DECODE)
    return f"{token} "


#: The combining marks of European letters; anything above these may be another mark or invisible.
_MARKS, _FURTHER = re.compile("[\u0300-\u036f]+"), re.compile("[\u00ad\u0483-\U0010ffff]")


def _plain(text: str) -> str:
    """Compatible forms decomposed, marks that stand on a letter and format characters (which have no width) dropped."""
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if _FURTHER.search(text):
        text = "".join(c for c in text if c < "\x80" or unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    return text


def fold(text: str | None) -> str:
    """Lower case, look-alikes and coded letters replaced, words parted by one space with one at either end.

    Compatible forms (full-width, mathematical, ligatures, superscripts) become plain letters; accents and invisible characters go.
    """
    text = text or ""
    if not text.isascii():
        text = _plain(text)
    text = _LOOKS.sub(lambda m: HOMOGLYPHS[m[0]], text.lower())
    if _CODED.search(text):
        text = _TOKEN.sub(_decoded, text)
    return f" {_BREAK.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Patterns over folded text with weights; phrases that excuse the pattern inside them; calibration of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    excused: tuple[str, ...] = ()
    slope: float = 1.0
    bias: float = 0.0
    prior: float = 0.0
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    def machine(self):
        if self._machine is None and self.weights:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for p in {*self.weights, *self.excused}:
                self._machine.add_word(p, p)
            self._machine.make_automaton()
        return self._machine

    def strength(self, folded: str) -> float:
        """Weights of the patterns met outside exception phrases, over the logarithm of the length in words."""
        if not self.weights:
            return 0.0
        hits, free = [], []
        for end, p in self.machine().iter(folded):
            (hits if p in self.weights else free).append((end - len(p) + 1, end, p))
        free.sort()
        starts = [x for x, _, _ in free]
        reach = list(accumulate((y for _, y, _ in free), max))  # furthest end of the phrases begun so far
        total = 0.0
        for a, b, p in hits:
            k = bisect_right(starts, a)
            if not k or reach[k - 1] < b:
                total += self.weights[p]
        return total / (1.0 + math.log(1.0 + max(1, folded.count(" ") - 1))) if hits else 0.0

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.prior
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * self.strength(fold(text)) + self.bias))))


def _terms(word: str, shortest: int = 4, longest: int = 8):
    """A word as a whole, and its beginnings: inflected forms share those."""
    yield f" {word} "
    for k in range(shortest, min(longest, len(word)) + 1):
        yield f" {word[:k]}"


def fit_lexicon(toxic: list[str], clean: list[str], least: int = 4) -> Lexicon:
    """A lexicon from texts of both classes; without toxic texts an empty one that scores everything as prior 0.

    Copies of a text count once. A term enters if at least `least` toxic documents (twice that for a beginning of words)
    and at least a fortieth of them hold it and its share among them is 50 times that among clean ones; of terms where one
    begins the other, the one that tells more documents apart enters.
    """
    bad, good = ([fold(t) for t in sorted(set(texts))] for texts in (toxic, clean))
    if not bad:
        return Lexicon()
    words = Counter(w for t in bad for w in set(t.split()) if len(w) > 2)
    plain = Counter(w for t in good for w in set(t.split()) if w in words)
    # A word in no more toxic than clean documents (by share) cannot mark toxicity; that leaves few to extend.
    share = len(bad) / max(1, len(good))
    marked = {w for w, n in words.items() if n > 4 * share * plain.get(w, 0)}
    with_term = Counter(t for doc in bad for t in {t for w in marked.intersection(doc.split()) for t in _terms(w)})
    enough = lambda t: max(least * (1 if t[-1] == " " else 2), 0.025 * len(bad))
    wanted = {t for t, n in with_term.items() if n >= enough(t)}
    against = Counter(t for doc in good for t in {t for w in set(doc.split()) for t in _terms(w)} & wanted)

    def weight(t: str) -> float:
        return math.log((with_term[t] + 0.5) / (len(bad) + 1)) - math.log((against[t] + 0.5) / (len(good) + 1))

    gain = lambda t: (with_term[t] - 2 * against[t] * share, len(t), t)
    weights: dict[str, float] = {}
    for t in sorted((t for t in wanted if weight(t) >= math.log(50)), key=gain, reverse=True):
        if not any(t.startswith(x) or x.startswith(t) for x in weights):
            weights[t] = weight(t)
    model = Lexicon(weights)
    model.excused = _excuses(model, bad, good)
    model._machine = None
    return _calibrate(model, bad, good)


def _excuses(model: Lexicon, toxic: list[str], clean: list[str], least: int = 3) -> tuple[str, ...]:
    """Two-word phrases around a term that clean documents (folded, as the toxic ones) use and toxic ones do not."""
    seen = []
    for texts in (toxic, clean):
        found: Counter = Counter()
        for folded in texts:
            phrases = set()
            for end, p in model.machine().iter(folded) if model.weights else ():
                start = end - len(p) + 1
                stop = end if p.endswith(" ") else folded.index(" ", end)
                if start > 0:
                    phrases.add(folded[folded.rindex(" ", 0, start) : stop + 1])
                if stop + 1 < len(folded):
                    phrases.add(folded[start : folded.index(" ", stop + 1) + 1])
            found.update(phrases)
        seen.append(found)
    return tuple(sorted(p for p, n in seen[1].items() if n >= least and not seen[0][p]))


def _calibrate(model: Lexicon, toxic: list[str], clean: list[str], rounds: int = 50) -> Lexicon:
    """Logistic regression of the class on the strength of folded texts, by damped Newton steps with a small ridge."""
    x = [model.strength(t) for t in (*toxic, *clean)]
    y = [1] * len(toxic) + [0] * len(clean)
    a, b = 1.0, -2.0
    for _ in range(rounds):
        ga, gb, haa, hab, hbb = -0.01 * a, 0.0, 0.01, 0.0, 1e-6
        for v, t in zip(x, y):
            p = 1 / (1 + math.exp(-max(-30, min(30, a * v + b))))
            w = max(p * (1 - p), 1e-9)
            ga, gb, haa, hab, hbb = ga + (t - p) * v, gb + t - p, haa + w * v * v, hab + w * v, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db), 1.0)
        a, b = a + da / size, b + db / size
        if abs(da) + abs(db) < 1e-6:
            break
    model.slope, model.bias = max(a, 0.0), b
    return model


def marked(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, mark) of the labels outside the held-out fold; of repeated label rows the largest label counts."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("mark"))
    return marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, size: int) -> list[tuple[int, str]]:
    """(label, text) of at most `rows` labelled documents of each class outside the held-out fold, in a stable order.

    Texts are whole; a class's texts make at most `size` bytes: its ids are taken in the order of their md5 up to the first text
    that does not fit, so that long texts are as likely as short ones. Only label rows are ranked; the bounded choice of ids is then broadcast to the documents, and
    sizes are known before any text leaves its executor. Of the rows of one doc_id the least text counts. Null labels and
    ids and unlabelled documents take no part.
    """
    marks = marked(labels, label, folds, held)
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    picks = [marks.where(F.col("mark") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    chosen = [r for p in picks for r in p.collect()]
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def of(ids: list):
        wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], f"doc_id {id_type}"))
        return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    if not chosen:
        return []
    sizes = {r.doc_id: r.size for r in of([r.doc_id for r in chosen]).select("doc_id", F.octet_length("text").alias("size")).collect()}
    left, mark = {0: size, 1: size}, {}
    for r in chosen:
        left[r.mark] -= sizes.get(r.doc_id, 0)
        if r.doc_id in sizes and left[r.mark] >= 0:
            mark[r.doc_id] = r.mark
    texts = of(list(mark)).collect() if mark else []
    return [(mark[r.doc_id], r.text) for r in sorted(texts, key=lambda r: (str(r.doc_id), r.text))]


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Lexicon:
    """A lexicon from labels(doc_id, toxic) whose crc32(doc_id as text) mod 4 is not 2; without any, an empty one."""
    rows = labelled_sample(docs, labels, "toxic", 4, 2, sample_rows, sample_bytes)
    return fit_lexicon([t for k, t in rows if k == 1], [t for k, t in rows if k == 0])


def scorer(model: Lexicon):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(pd.Series([model.score(t) for t in texts], dtype="float64") for texts in batches)

    return score


def score_toxicity(docs: DataFrame, model: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text.

    Null and empty texts score as a text without a hit. Repeated rows and equal ids are scored row by row; null ids stay
    null; other columns are ignored whatever their names; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", scorer(model)("text").alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole table of documents; a null doc_id has held_out null and is scored like any other row."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
