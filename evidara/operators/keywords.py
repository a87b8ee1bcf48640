"""Keyword extraction and cleaning."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions import scalars

#: English words that carry no topic.
STOPWORDS = tuple(
    "a about above after again against all also although among an and any are as at be because been before being below between both but by can could did do does doing down during each either few for from further had has have having he her here hers him his how however i if in into is it its itself just may me might more most must my near no nor not now of off on once only or other our out over own per same she should since so some such than that the their them then there these they this those through to too under unless until up upon very was we were what when where whether which while who whom whose why will with within without would yet you your".split()
)
_STOPWORDS = frozenset(STOPWORDS)
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD, _TOKEN, _NAME = re.compile(r"\w\w+"), re.compile(r"[\w'-]+|[^\w\s'-]+"), re.compile(r"[^\W_][\w'-]*")
Scores = dict[str, float]


def _grams(words: list[str]) -> Iterator[str]:
    return (" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def _scaled(scores: Scores) -> Scores:
    most = max(scores.values(), default=0.0)
    return {k: v / most for k, v in scores.items()} if most else scores


def tfidf_of(text: str) -> Scores:
    """One- to three-word terms by the sum of their TF-IDF over the text's sentences, each of length 1, over the greatest.
    Sentences are the "documents" of the measure; a text of one sentence is split at commas and semicolons."""
    sentences = [s for s in _SENTENCES.split(text) if s.strip()]
    if len(sentences) < 2:
        sentences = [s for s in re.split("[,;]", text) if s.strip()]
    found = [[w for w in _WORD.findall(s.lower()) if w not in _STOPWORDS] for s in sentences]
    counts = [Counter(_grams(words)) for words in found if words]
    df = Counter(t for c in counts for t in c)
    total: Counter[str] = Counter()
    for c in counts:
        weights = {t: n * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, n in c.items()}
        length = math.sqrt(sum(x * x for x in weights.values()))
        for t, x in weights.items():
            total[t] += x / length
    return _scaled(total)


def rake_of(text: str) -> Scores:
    """Runs of words between stop words and punctuation, by the sum of their words' degree over frequency, over the
    greatest."""
    runs: list[list[str]] = [[]]
    for token in _TOKEN.findall(text.lower()):
        if token in _STOPWORDS or not any(c.isalnum() or c == "_" for c in token):
            runs.append([])
        else:
            runs[-1].append(token)
    frequency, degree = Counter(), Counter()
    for run in runs:
        for w in run:
            frequency[w] += 1
            degree[w] += len(run)
    return _scaled({" ".join(run): sum(degree[w] / frequency[w] for w in run) for run in runs if run})


def yake_of(text: str) -> Scores:
    """One- to three-word terms by the published measure of unsupervised keyword extraction from a single document: casing,
    position, frequency, relatedness to context and spread over sentences make a word's score, whose product over a term,
    against its frequency, makes the term's; small is good, given as 1 / (1 + s)."""
    sentences = [s for s in _SENTENCES.split(text) if s.strip()]
    words = [w for s in sentences if (w := _NAME.findall(s))]
    tf, upper, acronym = Counter(), Counter(), Counter()
    places: dict[str, list[int]] = defaultdict(list)
    right, left = defaultdict(list), defaultdict(list)
    for at, found in enumerate(words):
        low = [w.lower() for w in found]
        for i, (w, t) in enumerate(zip(found, low, strict=True)):
            tf[t] += 1
            upper[t] += i > 0 and w[0].isupper()
            acronym[t] += len(w) > 1 and w.isupper()
            places[t].append(at)
            if i + 1 < len(low):
                right[t].append(low[i + 1])
                left[low[i + 1]].append(t)
    content = [t for t in tf if t not in _STOPWORDS and len(t) > 2]
    if not content:
        return {}
    mean = sum(tf[t] for t in content) / len(content)
    norm = mean + math.sqrt(sum((tf[t] - mean) ** 2 for t in content) / len(content))
    most, score = max(tf.values()), {}
    for t in content:
        around = sum(len(set(x[t])) / len(x[t]) for x in (right, left) if x[t])
        relation = 1 + around * tf[t] / most
        case = max(upper[t], acronym[t]) / (1 + math.log(tf[t]))
        position = math.log(3 + math.log(2 + places[t][(len(places[t]) - 1) // 2]))
        score[t] = position * relation / (case + tf[t] / norm / relation + len(set(places[t])) / len(words) / relation)
    terms = Counter(g for found in words for g in _grams([w.lower() for w in found]))
    out = {}
    for term, n in terms.items():
        parts = term.split(" ")
        if all(p in score for p in parts):
            s = math.prod(max(score[p], 1e-9) for p in parts) / (n * (1 + sum(score[p] for p in parts)))
            out[term] = 1 / (1 + s)
    return out


METHODS: dict[str, Callable[[str], Scores]] = {"tfidf": tfidf_of, "rake": rake_of, "yake": yake_of}


def extract(documents: DataFrame, doc: str, text: str, method: str, k: int | None = None) -> DataFrame:
    """(doc, keyword, score): the terms of each document by a method of METHODS, all or the ``k`` best, ties by the term.

    All measures are within one document, so each text is read once, in Arrow batches, and nothing is shuffled. Null texts
    give no row, nor do texts without a term. An extractor that fails on a text is passed over for it, not for others.
    """
    measure = METHODS[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc"], b["text"], strict=True):
                try:
                    scores = measure(t)
                except (ValueError, ArithmeticError, RecursionError):
                    continue
                best = scores.items() if k is None else heapq.nsmallest(k, scores.items(), key=lambda x: (-round(x[1], 9), x[0]))
                rows += [(d, w, s) for w, s in best]
            yield pd.DataFrame(rows, columns=["doc", "keyword", "score"])

    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc {dict(rows.dtypes)['doc']}, keyword string, score double").withColumnRenamed("doc", doc)


def extract_all(documents: DataFrame, doc: str, text: str, methods: Sequence[str], k: int) -> DataFrame:
    """(doc, method, keyword, score): the best terms of each document by each method."""
    parts = [extract(documents, doc, text, m, k).withColumn("method", F.lit(m)) for m in methods]
    return reduce(DataFrame.unionByName, parts).select(doc, "method", "keyword", "score")


def clean(keywords: DataFrame, keyword: str, score: str) -> DataFrame:
    """(key, keyword, score): terms of 3 to 80 characters that are no numbers or single letters, the best spelling of each
    singular form without endings and abbreviations."""
    key = scalars.without_suffix(scalars.singular(F.lower(scalars.without_abbreviation(F.col(keyword)))))
    fit = keywords.where(F.length(keyword).between(3, 80) & ~F.col(keyword).rlike(r"^[\d\W_]+$") & ~F.col(keyword).rlike(r"^(\w\s)+\w$"))
    return fit.groupBy(key.alias("key")).agg(F.max_by(keyword, F.struct(F.round(F.col(score), 9).alias("s"), F.col(keyword).alias("k"))).alias("keyword"), F.max(score).alias("score"))


def deduplicated(terms: DataFrame, term: str, order: str, score: str | None = None) -> DataFrame:
    """(key, term, score): terms once for each normal key (lower case, singular, without abbreviation or ending), in the
    form that came first; the score is that form's, or 1 without scores."""
    key = scalars.without_suffix(scalars.singular(F.lower(scalars.without_abbreviation(F.col(term)))))
    value = F.col(score).cast("double") if score else F.lit(1.0)
    first = terms.where(F.col(term).isNotNull()).groupBy(key.alias("key")).agg(F.min_by(F.struct(F.col(term).alias(term), value.alias("score")), order).alias("f"))
    return first.select("key", f"f.{term}", "f.score")
