"""License scans: a sparse n-gram logistic regression names each paragraph's licence family, and templates confirm it.

DataFrame functions and Spark's own JVM estimators only. The classifier is
trained on paragraphs made from public licence wording and on a class of others;
its probabilities are calibrated by a temperature fitted on paragraphs that it
hasn't seen, and a family that isn't likely enough is unknown. A named family
counts once the paragraph covers enough of one of its templates.

Every paragraph is classified. As the model is sparse, most are by a bound: each
n-gram's gain for a family is booked on one of its words, so a paragraph whose
words can't lift any family over the unknown class is unknown whatever its
n-grams, which then needn't be made.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.license_texts import IDENTIFIERS, TEMPLATES, UNKNOWN, examples

#: Paragraphs of each family for training (three times as many of none); as many again, otherwise drawn, for calibration.
EXAMPLES, VOCABULARY = 240, 6000
#: Least calibrated probability of a family, and least share of a template's n-grams, or of the paragraph's own if it has fewer.
LIKELY, COVERED = 0.5, 0.6
#: A paragraph counts as of so many n-grams at least (eight words have 15), so that a few common words don't confirm a family.
LEAST = 16
#: A line break within a sentence, and marks of a comment before the next line: what was wrapped is one paragraph. It stands after a letter, digit, comma
#: or bracket and before a lower-case letter, bracket or quote, or between capitals.
WRAPPED = r"""(?<=[\p{Ll}\p{N},;"')-])[ \t\r]*\n[ \t*#/;]*(?=[\p{Ll}("'])|(?<=\p{Lu}[\p{Lu},])[ \t\r]*\n[ \t*#/;]*(?=\p{Lu}\p{Lu})"""


def paragraphs_of(text: Column) -> Column:
    """A text's lines, those wrapped in a sentence joined, without blank ones."""
    return F.filter(F.split(F.regexp_replace(text, WRAPPED, " "), "\n"), lambda x: x.rlike(r"\S"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def ngrams_of(words: Column, n: int) -> Column:
    """Distinct word n-grams of 1 to n words."""
    def of_size(k: int) -> Column:
        places = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(words, i, k), " "))

    grams = [of_size(k) for k in range(1, n + 1)]
    return F.when(F.size(words) > 0, F.array_distinct(F.concat(*grams))).otherwise(F.array().cast("array<string>"))


def literal_rows(spark: SparkSession, rows: list[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    """A small table from literals, without Python on the executors."""
    text = json.dumps([dict(zip(names, row)) for row in rows])
    table = F.from_json(F.lit(text), f"array<struct<{names[0]}:string,{names[1]}:string>>")
    return spark.range(0, 1, 1, 1).select(F.inline(table))


@dataclass(frozen=True)
class Model:
    vectors: CountVectorizerModel
    regression: LogisticRegressionModel
    families: list[str]
    temperature: float

    def evidence(self) -> tuple[dict[str, list[float]], list[float]]:
        """Per word the most that it, and n-grams booked on it, add to each family's lead over unknown; and those leads without any."""
        weights, start = self.regression.coefficientMatrix.toArray(), self.regression.interceptVector.toArray()
        u = self.families.index(UNKNOWN)
        others = [f for f in range(len(self.families)) if f != u]
        leads = weights[others] - weights[u]
        own: dict[str, list[float]] = {}
        for i, gram in enumerate(self.vectors.vocabulary):
            words = gram.split(" ")
            # a word's own weight counts as it is; a longer n-gram needn't be there, so only what it adds does
            most = leads[:, i] if len(words) == 1 else leads[:, i].clip(min=0)
            if most.any():
                word = max(words, key=lambda w: (len(w), w))  # long words are rare
                own[word] = (most + own.get(word, 0.0)).tolist()
        return own, (start[others] - start[u]).tolist()

    def possible(self, words: Column) -> Column:
        """Whether a paragraph of these words may be named; if not, it is unknown."""
        own, leads = self.evidence()
        if not own:
            return F.lit(max(leads) >= 0)
        weight = F.create_map(*(x for word, most in own.items() for x in (F.lit(word), F.lit(most))))
        most = F.aggregate(F.array_intersect(words, F.lit(list(own))), F.lit(leads), lambda total, w: F.zip_with(total, F.element_at(weight, w), lambda x, y: x + y))
        return F.array_max(most) >= -1e-6

    def classified(self, paragraphs: DataFrame, grams: str) -> DataFrame:
        """Adds family and probability from the n-grams column; family is unknown below LIKELY."""
        out = self.regression.transform(self.vectors.transform(paragraphs.withColumnRenamed(grams, self.vectors.getInputCol())))
        p = calibrated(vector_to_array("raw_score"), self.temperature)
        out = out.withColumn("p", p).withColumn("best", F.array_max("p"))
        name = F.element_at(F.lit(self.families), F.array_position("p", F.col("best")).cast("int"))
        return out.withColumn("family", F.when(F.col("best") >= LIKELY, name).otherwise(UNKNOWN)).withColumn("probability", F.col("best")).drop("p", "best", "raw_score", "vector")


def calibrated(raw: Column, temperature: float | Column) -> Column:
    """Softmax of raw scores over a temperature."""
    scaled = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / temperature))
    return F.transform(scaled, lambda x: x / F.aggregate(scaled, F.lit(0.0), lambda a, y: a + y))


def fit(spark: SparkSession, each: int = EXAMPLES) -> Model:
    families = [*TEMPLATES, UNKNOWN]
    number = lambda df: df.withColumn("label", (F.array_position(F.lit(families), F.col("name")) - 1).cast("double")).withColumn("license_grams", ngrams_of(words_of(F.col("words")), 3))
    train = number(literal_rows(spark, examples(each, 11), ("name", "words")))
    vectors = CountVectorizer(inputCol="license_grams", outputCol="vector", vocabSize=VOCABULARY, minDF=3, binary=True).fit(train)
    regression = LogisticRegression(featuresCol="vector", labelCol="label", rawPredictionCol="raw_score", probabilityCol="", predictionCol="", family="multinomial", elasticNetParam=1.0, regParam=1e-4, maxIter=50, standardization=False).fit(vectors.transform(train))
    held = regression.transform(vectors.transform(number(literal_rows(spark, examples(each, 12), ("name", "words"))))).select("label", vector_to_array("raw_score").alias("raw"))
    grid = [0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0]
    losses = held.select("label", "raw", F.explode(F.lit(grid)).alias("t"))
    losses = losses.groupBy("t").agg(F.sum(-F.log(F.greatest(F.element_at(calibrated(F.col("raw"), F.col("t")), (F.col("label") + 1).cast("int")), F.lit(1e-12)))).alias("loss"))
    return Model(vectors, regression, families, losses.orderBy("loss", "t").first().t)


def coverage(grams: Column, family: Column) -> Column:
    """The largest share of one of the family's templates' n-grams that the paragraph has; of its own, if it has fewer."""
    best = F.lit(0.0)
    for name, texts in TEMPLATES.items():
        shares = []
        for text in texts + IDENTIFIERS.get(name, []):
            template = ngrams_of(words_of(F.lit(text)), 2)
            shares.append(F.size(F.array_intersect(grams, template)) / F.greatest(F.least(F.size(template), F.greatest(F.size(grams), F.lit(LEAST))), F.lit(1)))
        best = F.when(family == name, F.greatest(*shares, F.lit(0.0))).otherwise(best)
    return best


def license_scan(docs: DataFrame, *, model: Model | None = None) -> DataFrame:
    """The licences that each document's paragraphs state.

    A paragraph is a line, or several that were wrapped within a sentence. Takes `doc_id` and `text`, ignores other columns.
    Returns doc_id, n_candidates (paragraphs, all classified), n_licensed (of them named and confirmed), n_unconfirmed (named, but
    not like a template), families (distinct confirmed ones, sorted, comma-joined) and best_probability (of a confirmed one, else null).
    Defined for odd inputs: a null, empty or blank text has no paragraph and counts of 0; repeated rows are scanned one by one;
    doc_id may be null. An empty table gives an empty one.
    """
    model = model or fit(docs.sparkSession)
    docs = docs.select(F.monotonically_increasing_id().alias("license_row"), "doc_id", paragraphs_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("paragraphs"))
    # of the paragraphs that the bound leaves n-grams are made; each document keeps one empty row at least, so that it comes out
    possible = F.filter("paragraphs", lambda p: model.possible(words_of(p)))
    rows = docs.select("license_row", "doc_id", F.size("paragraphs").alias("n"), F.explode_outer(possible).alias("paragraph"))
    rows = rows.withColumn("license_words", words_of(F.coalesce("paragraph", F.lit(""))))
    rows = rows.select("license_row", "doc_id", "n", F.col("paragraph").isNotNull().alias("candidate"), ngrams_of(F.col("license_words"), 3).alias("license_grams"))
    named = model.classified(rows, "license_grams")
    grams = F.filter("license_grams", lambda g: F.size(F.split(g, " ")) <= 2)
    named = named.select("license_row", "doc_id", "n", "probability", F.when(F.col("candidate"), F.col("family")).otherwise(UNKNOWN).alias("family"), grams.alias("short"))
    named = named.withColumn("confirmed", (F.col("family") != UNKNOWN) & (coverage(F.col("short"), F.col("family")) >= COVERED))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return (
        named.groupBy("license_row", "doc_id")
        .agg(
            F.max("n").cast("long").alias("n_candidates"),
            one(F.col("confirmed")).alias("n_licensed"),
            one((F.col("family") != UNKNOWN) & ~F.col("confirmed")).alias("n_unconfirmed"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
            F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("best_probability"),
        )
        .drop("license_row")
    )
