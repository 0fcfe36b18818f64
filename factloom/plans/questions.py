"""Questions in natural language to queries on the movie graph."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.movies import INTENTS, MovieGraph, Question
from factloom.operators.vector import top_k
from factloom.plans.models import Embedder, embed_column

#: Confidence below this is refused.
LEAST_CONFIDENCE = 0.6
#: A name this similar to a mention is taken if nothing else fits.
LEAST_SIMILARITY = 0.60

# The genre words that are looked for, in the order in which they are looked for.
GENRE_WORDS = ("action", "drama", "comedy", "thriller", "horror", "sci-fi", "science fiction", "romance", "documentary", "fantasy", "adventure")
#: Genre words whose genre is not the word with a capital.
GENRE_NAMES = {"sci-fi": "Sci-Fi", "science fiction": "Sci-Fi"}
#: Words before a year that ask for the years from then on.
SINCE = re.compile(r"\b(?:since|after|from)\s+(?:19|20)\d{2}\b", re.IGNORECASE)


class IntentClassifier:
    """Multinomial logistic regression over hashed words and word pairs."""

    def __init__(self, model: PipelineModel):
        self.model = model

    @classmethod
    def fit(cls, examples: DataFrame, features: int = 1 << 12) -> IntentClassifier:
        """Fit on (``question``, ``intent``); rows without either are left out."""
        rows = examples.select("question", "intent").dropna().distinct()
        index = StringIndexer(inputCol="intent", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
        stages = [
            RegexTokenizer(inputCol="question", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True),
            index,
            LogisticRegression(maxIter=100, regParam=0.001),
            IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels),
        ]
        index.setHandleInvalid("keep")
        return cls(Pipeline(stages=stages).fit(rows))

    def predict(self, questions: DataFrame) -> DataFrame:
        """``questions`` with ``predicted`` intent and ``confidence``, its probability."""
        rows = questions if "intent" in questions.columns else questions.withColumn("intent", F.lit(None).cast("string"))
        scored = self.model.transform(rows)
        return scored.select(*questions.columns, "predicted", F.array_max(vector_to_array("probability")).alias("confidence"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> IntentClassifier:
        return cls(PipelineModel.load(path))


@dataclass
class Mentions:
    years: list[int] = field(default_factory=list)
    genres: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)


def find_mentions(question: str) -> Mentions:
    """Years, genres, quoted strings and all phrases of three, two and one words, in this order."""
    out = Mentions([int(y) for y in re.findall(r"\b(?:19|20)\d{2}\b", question)])
    lower = question.lower()
    out.genres = [GENRE_NAMES.get(word, word.capitalize()) for word in GENRE_WORDS if word in lower]
    phrases = re.findall(r'"([^"]+)"', question)
    words = re.sub(r"[?!.,]", "", question).split()
    for at in range(len(words)):
        phrases += [" ".join(words[at : at + n]) for n in (3, 2, 1) if at + n <= len(words)]
    out.phrases = list(dict.fromkeys(phrases))
    return out


def match_entity(phrase: str, names: list[str]) -> str | None:
    """The first name that equals the phrase, then ignoring case, then by containment where one of the two has four letters."""
    if phrase in names:
        return phrase
    lower = phrase.lower()
    for name in names:
        if name.lower() == lower:
            return name
    for name in names:
        other = name.lower()
        if max(len(lower), len(other)) >= 4 and (lower in other or other in lower):
            return name
    return None


def match_phrases(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """(``question_id``, ``nth``, ``name``) of phrases found among many names: exactly or ignoring case, by one equi-join."""
    left = phrases.withColumn("k", F.lower("phrase"))
    right = names.select("name", F.lower("name").alias("k"))
    hit = left.join(right, "k").withColumn("order", F.struct((F.col("name") != F.col("phrase")).cast("int"), "name"))
    return hit.groupBy("question_id", "nth").agg(F.min_by("name", "order").alias("name"))


def contained_phrases(phrases: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """(``question_id``, ``nth``, ``name``) of phrases that hold a name or are part of one, case ignored; the first name by the alphabet.

    The phrases are those of the questions asked, a stated set that is broadcast against all names; shorter ones than ``least`` letters
    are left out, as they are part of almost any name.
    """
    p, n = F.lower("phrase"), F.lower("name")
    asked = phrases.filter(F.length("phrase") >= least)
    hit = names.select("name").join(F.broadcast(asked), F.contains(n, p) | (F.contains(p, n) & (F.length("name") >= least)))
    return hit.groupBy("question_id", "nth").agg(F.min("name").alias("name"))


def similar_entity(mentions: DataFrame, names: DataFrame, embedder: Embedder) -> DataFrame:
    """The most similar name of every mention, if its similarity is above the bound."""
    asked = embed_column(mentions.select(F.col("phrase").alias("query_id"), F.col("phrase").alias("text")).distinct(), embedder)
    held = embed_column(names.select(F.col("name").alias("item"), F.col("name").alias("text")).distinct(), embedder)
    return top_k(asked.select("query_id", "embedding"), held, 1, item_id="item").filter(F.col("score") > LEAST_SIMILARITY)


@dataclass
class Outcome:
    question: str
    intent: str | None = None
    confidence: float = 0.0
    entities: dict = field(default_factory=dict)
    query: DataFrame | None = None
    success: bool = False
    message: str = ""


class QuestionPipeline:
    """Intent, gate, entities, query. A query is a DataFrame that was analysed and not run."""

    def __init__(self, graph: MovieGraph, classifier: IntentClassifier, embedder: Embedder | None = None):
        self.graph, self.classifier, self.embedder = graph, classifier, embedder
        self.spark: SparkSession = graph.person.sparkSession

    def convert(self, question: str) -> Outcome:
        row = self.classifier.predict(self.spark.createDataFrame([(question,)], "question string")).first()
        out = Outcome(question, row.predicted, float(row.confidence))
        if out.confidence < LEAST_CONFIDENCE:
            out.message = f"confidence {out.confidence:.2f} is below {LEAST_CONFIDENCE}"
            return out
        out.entities = self.entities(question)
        chosen = choose((out.intent or "").lower(), out.entities, since=SINCE.search(question) is not None)
        if chosen is None:
            known = (out.intent or "").lower() in INTENTS
            out.message = f"the question names nothing that {out.intent} needs" if known else f"no query for intent {out.intent}"
            return out
        way, values = chosen
        out.query, out.success = way.build(self.graph, *values), True
        return out

    def entities(self, question: str) -> dict[str, list]:
        """Persons and movies named in the question: by equality, else by containment, else by similarity, where an embedder is given."""
        found = find_mentions(question)
        phrases = self.spark.createDataFrame([(0, k, p) for k, p in enumerate(found.phrases)], "question_id int, nth int, phrase string")
        persons, movies = self.graph.person.select("name"), self.graph.movie.select(F.col("title").alias("name"))
        return {"actors": self._matched(phrases, persons), "movies": self._matched(phrases, movies), "years": found.years, "genres": found.genres}

    def _matched(self, phrases: DataFrame, names: DataFrame) -> list[str]:
        for step in (match_phrases, contained_phrases):
            hits = list(dict.fromkeys(r.name for r in step(phrases, names).orderBy("nth").collect()))
            if hits:
                return hits
        if self.embedder is None:
            return []
        return [r.item for r in similar_entity(phrases, names, self.embedder).orderBy(F.desc("score"), "item").limit(5).collect()]

    def ask(self, question: str, rows: int = 50) -> tuple[Outcome, list[dict]]:
        out = self.convert(question)
        return out, [r.asDict(recursive=True) for r in out.query.limit(rows).collect()] if out.success else []


def choose(intent: str, entities: dict[str, list], since: bool = False) -> tuple[Question, list] | None:
    """The first way to answer an intent whose entities are all named, with their values; null if there is none.

    With ``since`` the way that takes years from the named one on comes first.
    """
    ways = INTENTS.get(intent, ())
    if since and intent == "find_movies_by_year":
        ways = ways[::-1]
    for way in ways:
        values = bind(way.needs, entities)
        if values is not None:
            return way, values
    return None


def bind(needed: tuple[str, ...], entities: dict[str, list]) -> list | None:
    """Values for a query's parameters, bound as values and never as text; null if one is missing."""
    pools = {"movie": entities.get("movies", []), "actor": entities.get("actors", []), "director": entities.get("actors", []), "actor2": entities.get("actors", [])[1:], "year": entities.get("years", []), "genre": entities.get("genres", [])}
    values = [pools[n][0] if pools.get(n) else None for n in needed]
    return None if any(v is None for v in values) else values


def augmented(examples: DataFrame) -> DataFrame:
    """(``question``, ``cypher``) pairs for translation: each as it is; with RETURN * where it returns; in lower case; with a question mark.

    Rows without a query are left out; the variant with a question mark only where there is none.
    """
    rows = examples.filter("question is not null and cypher is not null")
    pair = lambda q, c: F.struct(q.alias("question"), c.alias("cypher"))
    q, c = F.col("question"), F.col("cypher")
    star = F.regexp_replace(c, r"(?s)RETURN .*", "RETURN *")
    variants = F.array(
        pair(q, c),
        F.when(F.contains(c, F.lit("RETURN")), pair(q, star)),
        F.when(F.contains(c, F.lit("RETURN")), pair(F.lower(q), c)),
        F.when(F.contains(c, F.lit("RETURN")) & ~q.endswith("?"), pair(F.concat(q, F.lit("?")), c)),
    )
    return rows.select(F.inline(F.array_compact(variants)))


def split_examples(examples: DataFrame, held_out: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, evaluation) by a hash of the question, so a question and its repeats are on one side, whatever the partitions."""
    place = F.abs(F.xxhash64("question", F.lit(seed)) % 10_000)
    return examples.filter(place >= int(held_out * 10_000)), examples.filter(place < int(held_out * 10_000))
