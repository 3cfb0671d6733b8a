"""Topics of texts: token filter, bag of words, online LDA, topics above a share."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def topic_words(text: Column, stop: list[str], share: float = 0.8) -> Column:
    """Lower-case words of the first share of a text without stop words, image marks, hexadecimal names and chapter numbers."""
    head = F.substring(text, F.lit(1), F.floor(F.length(text) * share).cast("int"))
    words = F.split(F.lower(head), "[^\\p{L}\\p{N}_]+")
    return F.filter(words, lambda w: (w != "") & (w != "images") & ~w.rlike("^[0-9a-f]{6,}$") & ~w.rlike("^[0-9]+(\\.[0-9]+)*$") & ~F.array_contains(F.array(*map(F.lit, stop or [""])), w))


def long_enough(docs: DataFrame, least: int = 300) -> DataFrame:
    """docs (words) whose words, joined by spaces, have at least least characters."""
    return docs.where(F.length(F.array_join("words", " ")) >= least)


def topic_sources(topics: DataFrame, names: DataFrame) -> DataFrame:
    """topics (name, topic, share) with the source path that stands behind each hashed name. names: name, path."""
    return topics.join(names, "name")


def fit_topics(docs: DataFrame, topics: int = 100, rounds: int = 5, words: int = 2048, seed: int = 7) -> tuple[CountVectorizerModel, LDAModel]:
    """Models over docs (doc_id, words)."""
    bag = CountVectorizer(inputCol="words", outputCol="features", minDF=2, maxDF=0.95, vocabSize=words).fit(docs)
    model = LDA(k=topics, maxIter=rounds, optimizer="online", learningOffset=50.0, seed=seed).fit(bag.transform(docs))
    return bag, model


def topics_of(docs: DataFrame, bag: CountVectorizerModel, model: LDAModel, least: float = 0.1) -> DataFrame:
    """doc_id, topic, share for each topic that has more than least of a document."""
    shares = model.transform(bag.transform(docs)).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "share"))
    return shares.where(F.col("share") > least)


def topic_terms(bag: CountVectorizerModel, model: LDAModel, n: int = 100) -> DataFrame:
    """topic, rank, term, weight: the n heaviest words of each topic."""
    rows = model.describeTopics(n)
    words = F.array(*map(F.lit, bag.vocabulary))
    flat = rows.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    return flat.select("topic", "rank", F.get(words, F.col("t.termIndices")).alias("term"), F.col("t.termWeights").alias("weight"))
