"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon, nearness of its words to the second person, capitals, punctuation, and
rates of obfuscation (digits and signs inside words, drawn-out letters, single spaced letters) with what the lexicon finds
once those are undone. The lexicon is learned from labelled texts: words and word stems (leading 4 to 8 letters) that
are far more frequent in toxic texts than in others; how often a text repeats one of them is a feature of its own. Trees are fitted on two of four folds of the documents' ids, the
calibration on a third, and the fourth is held out of everything.

Fitting uses a sample of at most ``most_labelled`` labelled rows, the ones of smallest id hash; only their ids are sent to
every executor. Scoring reads every document once, shuffles nothing and keeps nothing but the model.

Defined results: null and empty texts are scored on features of 0; unlabelled, null and clashing labels (the highest
counts) are no error; without both labels every score is the share of label 1, 0 if there is none; a null id is never
held out; repeated rows are scored one by one; other columns travel only inside ``row``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from watchgrid.llm.common import SLICE_BYTES, slices, texts_of, with_row
from watchgrid.llm.vocabulary import Remembered
from watchgrid.session import cut_lineage

FOLDS = 4
HELD_OUT = 2
CALIBRATION = 3
MOST_LABELLED = 20_000
LEAST_ODDS = 1.5
#: Terms that may enter the lexicon by chance, of all that are tried.
CHANCE_TERMS = 2.0
#: Words that a worker remembers its findings of.
REMEMBERED = 100_000
THRESHOLD = 0.3

#: Second-person words of the four languages, and signs that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure sie ihnen "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro su sus".split()
)
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_EDGES = " \t\n.,;:!?\"'()[]{}<>-_*#~`´“”„«»…"
_INNER_SIGN = re.compile(r"(?<=\w)[^\w\s'’-]+(?=\w)|(?<=[^\W\d_])\d+(?=[^\W\d_])")
_DRAWN = re.compile(r"(.)\1{2,}")
_SEPARATORS = re.compile(r"[^\w]+|_")
_CAPITALS = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b"!?,.")
FEATURES = 16


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS)), F.lit(0)).cast("int")


def terms_of(word: str) -> list[str]:
    """The word itself, and its stems, marked by a trailing star."""
    return [word, *[word[:n] + "*" for n in range(4, 9) if len(word) >= n]] if len(word) > 2 else []


def plain_words(text: str) -> list[str]:
    return [w for t in text.lower().split() if (w := t.strip(_EDGES))]


class Token(NamedTuple):
    term: str
    undone: str
    signs: int
    drawn: int
    person: int
    single: int


class Scorer:
    """Features of texts under one lexicon (term -> log odds, the surest terms first)."""

    def __init__(self, lexicon: dict[str, float]):
        self._lexicon, self._rank = lexicon, {term: i for i, term in enumerate(lexicon)}
        self._longest = max((len(term) for term in lexicon if not term.endswith("*")), default=0)
        self._tokens = Remembered(self._token, REMEMBERED)

    def _term(self, *words: str) -> str:
        """The surest term that one of the words stands for, or nothing."""
        known = [t for word in words for t in terms_of(word) if t in self._rank]
        return min(known, key=self._rank.__getitem__, default="")

    def _token(self, token: str) -> Token | bool:
        lower = token.lower()
        word = lower.strip(_EDGES)
        term = self._term(word)
        signs, drawn = bool(_INNER_SIGN.search(word)), bool(_DRAWN.search(word))
        undone = ""
        if (signs or drawn or not word.isalpha()) and not term:
            plain = _SEPARATORS.sub("", lower.translate(_LEET))
            undone = self._term(plain, _SEPARATORS.sub("", lower), _DRAWN.sub(r"\1", plain), _DRAWN.sub(r"\1\1", plain))
        single = len(word) == 1 and word.isalpha()
        found = Token(term, undone, int(signs), int(drawn), int(word in SECOND_PERSON), int(single))
        return found if any(found) else False

    def _spaced(self, tokens: list[str], singles: list[int]) -> float:
        """The best lexicon weight of letters written apart."""
        best, run = 0.0, []
        for i in [*singles, None]:
            if run and (i is None or i != run[-1] + 1):
                said = "".join(tokens[j].lower().strip(_EDGES) for j in run)
                for start in range(len(said) - 3):
                    for end in range(start + 4, min(start + self._longest, len(said)) + 1):
                        best = max(best, self._lexicon.get(said[start:end], 0.0))
                run = []
            if i is not None:
                run.append(i)
        return best

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        if not tokens:
            return [0.0] * FEATURES
        count, data = len(tokens), text.encode("utf-8")
        marked = [(i, t) for i, t in enumerate(map(self._tokens.__getitem__, tokens)) if t]
        terms = [(i, t.term or t.undone) for i, t in marked if t.term or t.undone]
        hits = [(i, self._lexicon[term]) for i, term in terms]
        most = max(Counter(term for _, term in terms).values(), default=0)
        persons = [i for i, t in marked if t.person]
        near, k = 0, 0
        for i, _ in hits:
            while k < len(persons) and persons[k] < i - 5:
                k += 1
            near += k < len(persons) and persons[k] <= i + 5
        size = len(data)
        letters = size - len(data.translate(None, _LETTERS))
        capitals = size - len(data.translate(None, _CAPITALS))
        singles = [i for i, t in marked if t.single]
        return [
            len(hits) / count,
            math.log1p(len(hits)),
            sum(w for _, w in hits) / count,
            max((w for _, w in hits), default=0.0),
            near / count,
            near / max(1, len(hits)),
            capitals / max(1, letters),
            data.count(b"!") / count,
            data.count(b"?") / count,
            (size - len(data.translate(None, _SIGNS))) / count,
            sum(t.signs for _, t in marked) / count,
            sum(t.drawn for _, t in marked) / count,
            max(max((self._lexicon[t.undone] for _, t in marked if t.undone), default=0.0), self._spaced(tokens, singles) if len(singles) > 3 else 0.0),
            math.log1p(count),
            float(most),
            most / count,
        ]


def _term_counts(texts: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """In how many of the texts each term stands (of the wanted ones, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 * SLICE_BYTES):
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                terms = {t for w in set(plain_words(text)) for t in terms_of(w)}
                seen.update(terms if wanted is None else terms & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def likelihood_ratio(t: int, toxic: int, c: int, clean: int) -> float:
    """Twice the log likelihood ratio (G2) of "one rate in both" against "a rate each", for t of toxic and c of clean texts."""

    def part(seen: int, size: int) -> float:
        rate = (t + c) / (toxic + clean)
        terms = ((seen, size * rate), (size - seen, size * (1 - rate)))
        return sum(o * math.log(o / e) for o, e in terms if o)

    return 2 * (part(t, toxic) + part(c, clean))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms of toxic texts with their smoothed log odds; ``sample`` has ``text`` and ``toxic``.

    A term belongs if it is commoner in toxic texts by a likelihood ratio that chance alone would give no more than
    ``CHANCE_TERMS`` of all terms tried, so the bar rises with their number. Terms under ``LEAST_ODDS`` say too little to
    be worth finding."""
    sizes = {bool(r.toxic): r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return {}
    least = max(3, toxic // 200)
    in_toxic = {r.term: r.n for r in _term_counts(sample.where("toxic")).where(F.col("n") >= least).collect()}
    in_clean = {r.term: r.n for r in _term_counts(sample.where("NOT toxic"), frozenset(in_toxic)).collect()}
    scored = []
    for term, t in in_toxic.items():
        c = in_clean.get(term, 0)
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        certainty = likelihood_ratio(t, toxic, c, clean)
        # The upper tail of chi-square with one degree of freedom, one-sided.
        by_chance = len(in_toxic) * math.erfc(math.sqrt(max(0.0, certainty) / 2)) / 2
        if odds > LEAST_ODDS and by_chance <= CHANCE_TERMS:
            scored.append((certainty, term, odds))
    return {term: odds for _, term, odds in sorted(scored, reverse=True)}


def with_features(docs: DataFrame, lexicon: dict[str, float], carry: tuple[str, ...]) -> DataFrame:
    """Per row: ``row`` (the carried columns) and ``dense``."""
    narrow = with_row(docs, carry)
    schema = narrow.select("row", F.array(F.lit(0.0)).alias("dense")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in slices(batches):
            dense = pa.array([scorer.features(t or "") for t in texts_of(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), dense], names=["row", "dense"])

    return narrow.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """``doc_id``, ``text``, ``toxic``, ``part`` (the fold) of the bounded sample, none of it held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    ours = known.withColumn("part", fold(F.col("doc_id"))).where(F.col("part") != HELD_OUT)
    ids = ours.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    # At most ``most_labelled`` rows of three small columns: a fixed bound.
    chosen = F.broadcast(ids.withColumnRenamed("doc_id", "of_id"))
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("of_id"))
    return met.select("doc_id", "text", "toxic", "part")


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Callable[..., DataFrame]:
    """A scorer: ``score(docs, carry)`` gives ``row``, ``held_out``, ``score``, ``predicted``."""
    sample = cut_lineage(labelled_sample(docs, labels, most_labelled))
    fitted = sample.where(F.col("part") != CALIBRATION)
    lexicon = learn_lexicon(fitted)
    known = with_features(sample, lexicon, ("doc_id", "toxic", "part")).select("row.*", array_to_vector("dense").alias("features"))
    known = cut_lineage(known.withColumn("label", F.col("toxic").cast("double")))
    counts = {(r.c, r.toxic) for r in known.groupBy((F.col("part") == CALIBRATION).alias("c"), "toxic").count().collect()}
    share = known.agg(F.avg("label")).first()[0] or 0.0
    model = isotonic = None
    if {(False, True), (False, False)} <= counts:
        model = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=7, maxBins=64).fit(known.where(F.col("part") != CALIBRATION))
        if {(True, True), (True, False)} <= counts:
            rated = model.transform(known.where(F.col("part") == CALIBRATION))
            margin = rated.select("label", vector_to_array("probability")[1].alias("margin"))
            isotonic = IsotonicRegression(featuresCol="margin", predictionCol="calibrated").fit(margin)

    def score(rows: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        found = with_features(rows, lexicon, carry)
        if model is None:
            found = found.withColumn("score", F.lit(share))
        else:
            found = found.withColumn("features", array_to_vector("dense"))
            found = model.transform(found).withColumn("margin", vector_to_array("probability")[1])
            # The trees' own order decides among texts of one calibrated level.
            found = isotonic.transform(found) if isotonic else found.withColumn("calibrated", F.col("margin"))
            found = found.withColumn("score", F.lit(0.99) * F.col("calibrated") + F.lit(0.01) * F.col("margin"))
        bounded = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
        return found.select(
            "row",
            (fold(F.col("row.doc_id")) == HELD_OUT).alias("held_out"),
            bounded.alias("score"),
            (bounded >= THRESHOLD).cast("int").alias("predicted"),
        )

    return score
