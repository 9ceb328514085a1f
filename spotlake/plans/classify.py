"""Party classifier over transcripts: tokens, TF-IDF, multinomial Naive Bayes.

Counts, weights and scores are tables, so no vocabulary is gathered or cut.
`mllib_pipeline` builds the same stages from MLlib for comparison; its counting
stage gathers at most `vocabulary` words on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StopWordsRemover, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlake.functions.keys import bucket_of
from spotlake.functions.text import stop_words
from spotlake.operators.aggregates import accuracy, confusion_matrix
from spotlake.operators.columns import quoted
from spotlake.operators.features import document_frequencies, term_counts, with_facts
from spotlake.operators.sizing import by_key, parts_by_key
from spotlake.sources.scratch import materialise


def in_training(key: Column | str, share_pct: int = 80) -> Column:
    """Whether a row belongs to the training part; depends on the key alone."""
    return bucket_of(key) < share_pct


def hash_split(df: DataFrame, key: str, share_pct: int = 80) -> tuple[DataFrame, DataFrame]:
    """(training, test), the same on every run and on every cluster size."""
    return df.where(in_training(key, share_pct)), df.where(~in_training(key, share_pct))


def exact_split(df: DataFrame, key: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(training, test) with exactly floor(share * rows) training rows, the same on any partitioning.

    Rows are in the order of the MD5 of their key, then of their content, and the last
    training row is found by refinement: a histogram of 16 bits of the hash, then one
    of the next 16 bits within the bin that holds it. A histogram has at most 65,536
    rows; no row of the table is sorted or moved. Rows that are equal in all columns are
    parted by number.
    """
    content = F.md5(F.to_json(F.struct(*[quoted(c) for c in df.columns])))
    # A NULL key is ahead of all others.
    place = F.concat(F.coalesce(F.md5(quoted(key).cast("string")), F.lit("-" * 32)), content)
    placed = df.select("*", place.alias("_place"))
    wanted = math.floor(share * df.count())
    if wanted == 0:
        return df.limit(0), df
    # Places from `prefix` on are still undecided; `before` rows lie ahead of them.
    prefix, before, inside = "", 0, 0
    for digits in range(4, 65, 4):
        bins = placed.where(F.col("_place").startswith(prefix)).groupBy(F.substring("_place", 1, digits).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        upto = before + F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        cut = bins.withColumn("upto", upto).where(F.col("upto") >= wanted).orderBy("bin").first()
        prefix, before, inside = cut["bin"], cut["upto"] - cut["n"], cut["n"]
        if before + inside == wanted:
            break
    here = F.substring("_place", 1, len(prefix))
    if before + inside == wanted:
        return placed.where(here <= prefix).drop("_place"), placed.where(here > prefix).drop("_place")
    # What is left of both sides are equal rows, so any of them will do.
    equal = placed.where(here == prefix).drop("_place")
    return (placed.where(here < prefix).drop("_place").unionByName(equal.limit(wanted - before)),
            placed.where(here > prefix).drop("_place").unionByName(equal.limit(before + inside - wanted)))


def random_split(df: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, test) by Spark's seeded sampling; depends on how `df` is partitioned."""
    train, test = df.randomSplit([share, 1 - share], seed=seed)
    return train, test


@dataclass(frozen=True)
class Classifier:
    """A fitted model as tables.

    `weights` has (term, idf, gains): for each label that has the term, by its
    number, how much one unit of TF-IDF speaks for it beyond a term it lacks.
    `priors` has (number, prior, floor), one row per label.
    """

    weights: DataFrame
    priors: list[tuple[int, float, float]]
    labels: list[str]
    text: str
    label: str
    key: str
    words_out: list[str]
    unicode_words: bool
    width: int | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with `label` and `prediction` as numbers and the predicted text in `predicted`; the key identifies a row."""
        terms = term_counts(df, self.key, self.text, self.words_out, self.unicode_words, self.width)
        known = with_facts(terms, self.weights, F.col("idf"), F.size("gains") + 1).withColumn("_x", F.col("tf") * F.col("idf"))
        # Per text: its whole weight, and what its terms add for each label that has them.
        mass = known.groupBy(quoted(self.key)).agg(F.sum("_x").alias("_mass"))
        each = known.select(quoted(self.key), "_x", F.explode("gains").alias("g")).groupBy(quoted(self.key), "g.number").agg(
            F.sum(F.col("_x") * F.col("g.gain")).alias("_gain"))
        gains = each.groupBy(quoted(self.key)).agg(F.map_from_entries(F.collect_list(F.struct("number", "_gain"))).alias("_gains"))
        found = mass.join(gains, self.key, "left")
        # One entry per label, the order of which breaks ties.
        priors = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(p).alias("p"), F.lit(f).alias("f")) for n, p, f in self.priors))
        scores = F.transform(priors, lambda c: F.struct(
            (c["p"] + F.coalesce("_mass", F.lit(0.0)) * c["f"] + F.coalesce(F.try_element_at("_gains", c["n"]), F.lit(0.0))).alias("score"),
            (-c["n"]).alias("number")))
        names = F.array(*map(F.lit, self.labels))
        number = (-F.array_max(scores)["number"]).cast("double")
        place = F.array_position(names, quoted(self.label)) - 1
        return df.join(found, self.key, "left").withColumns({
            "prediction": number, "label": F.when(place >= 0, place.cast("double")),
            "predicted": F.get(names, number.cast("int"))}).drop("_mass", "_gains")


def fit_classifier(
    train: DataFrame, text: str, label: str, key: str, fit_features_on: DataFrame | None = None,
    language: str = "english", unicode_words: bool = False, smoothing: float = 1.0, width: int | None = None,
) -> Classifier:
    """Fit features and model on the training rows; `key` identifies a row.

    `fit_features_on` takes a wider table for document frequencies and labels,
    such as all rows before the split; test rows then leak into both. Labels are
    the classes of the model, numbered by falling frequency, then by name. With
    `width` terms are hashed to that many buckets.
    """
    words_out = stop_words(language)
    basis = train if fit_features_on is None else fit_features_on
    texts = basis.agg(F.count(F.lit(1))).first()[0]
    # The labels of a key lie in the same parts as its terms; a key of several rows has each of their labels.
    parts = parts_by_key(train.select(quoted(key), quoted(text)))
    counts = term_counts(train, key, text, words_out, unicode_words, width, parts)
    first = F.row_number().over(W.partitionBy(quoted(key)).orderBy("name")) == 1
    named = by_key(train.select(quoted(key), quoted(label).cast("string").alias("name")), [key], parts).withColumn("first", first)
    # Per term and label: its occurrences, and the texts that hold it, each counted under one label. No row per text is kept.
    by_label = materialise(counts.join(named.hint("shuffle_hash"), key, "left").groupBy("term", "name").agg(
        F.sum("tf").alias("tf"), F.count_if(F.coalesce("first", F.lit(True))).alias("df")), "label_counts")
    frequencies = by_label.groupBy("term").agg(F.sum("df").alias("df")) if fit_features_on is None else document_frequencies(
        term_counts(basis, key, text, words_out, unicode_words, width))
    idf = F.log((F.lit(texts) + 1) / (F.col("df") + 1))
    vocabulary = materialise(frequencies.select("term", idf.alias("idf")), "vocabulary")

    per_label = basis.where(quoted(label).isNotNull()).groupBy(quoted(label).cast("string").alias("name")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").collect()
    names = [r["name"] for r in per_label]
    rows = {r["name"]: r["n"] for r in train.groupBy(quoted(label).cast("string").alias("name")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    number = (F.array_position(F.array(*map(F.lit, names)), F.col("name")) - 1).cast("int")

    weighed = by_label.where(F.col("name").isNotNull()).join(vocabulary, "term").select(
        "name", "term", (F.col("tf") * F.col("idf")).alias("x"), "idf", number.alias("number"))
    weighed = materialise(weighed, "label_terms")
    size = vocabulary.count()
    mass = {r["number"]: r["x"] for r in weighed.groupBy("number").agg(F.sum("x").alias("x")).collect()}
    # The chance of a term is (x + smoothing) / (mass + smoothing * terms); its logarithm splits into a gain and a floor.
    gain = F.log((F.col("x") + smoothing) / smoothing)
    gains = weighed.groupBy("term").agg(
        F.collect_list(F.struct("number", gain.alias("gain"))).alias("gains"))
    weights = materialise(vocabulary.join(gains, "term", "left").withColumn(
        "gains", F.coalesce("gains", F.array().cast("array<struct<number:int,gain:double>>"))), "weights")
    total = sum(rows.get(n, 0) for n in names)
    priors = [(i, math.log(rows.get(n, 0) + smoothing) - math.log(total + smoothing * len(names)),
               math.log(smoothing) - math.log(mass.get(i, 0.0) + smoothing * size) if size else 0.0) for i, n in enumerate(names)]
    return Classifier(weights, priors, names, text, label, key, words_out, unicode_words, width)


def accuracy_of(predictions: DataFrame) -> float:
    return accuracy(predictions, "label", "prediction").first()["accuracy"]


def confusion_of(predictions: DataFrame, classifier: Classifier) -> DataFrame:
    """Confusion matrix with label and class numbers as in the model."""
    classes = [float(i) for i in range(len(classifier.labels))]
    return confusion_matrix(predictions, "label", "prediction", classes)


def mllib_pipeline(
    text: str, label: str, language: str = "english", vocabulary: int = 1 << 18, unicode_words: bool = False, min_df: float = 1.0,
) -> Pipeline:
    """The feature stages and the model as one MLlib pipeline, for vocabularies that fit the driver."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"(?U)\W" if unicode_words else r"\W"),
        StopWordsRemover(inputCol="tokens", outputCol="content", stopWords=stop_words(language)),
        CountVectorizer(inputCol="content", outputCol="counts", vocabSize=vocabulary, minDF=min_df),
        IDF(inputCol="counts", outputCol="tfidf"),
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="frequencyDesc"),
        NaiveBayes(featuresCol="tfidf", labelCol="label", predictionCol="prediction", smoothing=1.0),
    ])
