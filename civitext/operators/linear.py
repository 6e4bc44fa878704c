"""A logistic regression on hashed words and word pairs, as a stored Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.functions import scores as sc
from civitext.functions.text import WORD
from civitext.operators import evaluate, split
from civitext.operators.model_store import Version, latest, publish
from civitext.session import materialise
from civitext.tasks import Task, get_task

_KIND = "linear"


@dataclass(frozen=True)
class LinearConfig:
    """Training settings. ``features`` bounds the model whatever the vocabulary.

    The optimiser is deterministic; ``seed`` decides the split of ``train``.
    """

    features: int = 1 << 16
    iterations: int = 10
    weight_decay: float = 0.01
    pairs: bool = True
    seed: int = 42
    test_size: float = 0.15
    val_size: float = 0.15


@dataclass(frozen=True)
class LinearModel:
    """A fitted pipeline with its task, settings, and the metrics of its held-out parts."""

    task: Task | None
    pipeline: PipelineModel = field(repr=False)
    config: LinearConfig = LinearConfig()
    metrics: dict[str, float] = field(default_factory=dict)
    train_rows: int = 0

    def save(self, path: str, mode: str = "append") -> Version:
        """Publish a version with settings and metrics; see ``model_store.publish`` for the modes."""
        return publish(
            SparkSession.getActiveSession(),
            path,
            _KIND,
            self.task.name,
            lambda folder: self.pipeline.save(f"{folder}/pipeline"),
            asdict(self.config),
            self.metrics,
            {"train_rows": self.train_rows},
            mode,
        )


def load(spark: SparkSession, path: str) -> LinearModel:
    """Load the newest saved model; a missing one is an error with its path."""
    found = latest(spark, path, _KIND)
    pipeline = PipelineModel.load(f"{found.folder}/pipeline")
    return LinearModel(get_task(found.task), pipeline, LinearConfig(**found.config), found.metrics, found.counts["train_rows"])


def _hashing(config: LinearConfig) -> list:
    """Text to one sparse vector of hashed words and, after them, pairs of neighbouring words."""
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=f"[{WORD}]+", gaps=False)
    if not config.pairs:
        return [words, HashingTF(inputCol="words", outputCol="tf", numFeatures=config.features)]
    return [
        words,
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        HashingTF(inputCol="terms", outputCol="tf", numFeatures=config.features),
    ]


def fit(
    train: DataFrame,
    config: LinearConfig = LinearConfig(),
    task: str | Task | None = None,
    held_out: Mapping[str, DataFrame] | None = None,
) -> LinearModel:
    """Fit on normalised ``text`` and ``label_id``.

    The hashed vectors are made once, as a table that the document frequencies
    and every step of the optimiser read. ``held_out`` names parts (``val``,
    ``test``) whose macro F1 and accuracy are kept with the model; they need the task.
    """
    task = task and get_task(task)
    hashing = PipelineModel(_hashing(config))
    vectors = materialise(hashing.transform(train).select("label_id", "tf"), "hashed-terms")
    idf = IDF(inputCol="tf", outputCol="features").fit(vectors)
    regression = LogisticRegression(
        labelCol="label_id", family="multinomial", regParam=config.weight_decay, maxIter=config.iterations
    ).fit(idf.transform(vectors))
    pipeline = PipelineModel([*hashing.stages, idf, regression])
    model = LinearModel(task, pipeline, config, {}, vectors.count())
    metrics = {}
    for name, part in (held_out or {}).items():
        judged = predict(part.withColumnRenamed("label_id", "y_true"), model, carry=("y_true",))
        report = evaluate.full_report(judged, dict(enumerate(task.labels)), task.name, y_pred="label_id").first()
        metrics |= {f"{name}_{k}": float(report[k]) for k in ("f1_macro", "accuracy")}
    return LinearModel(task, pipeline, config, metrics, model.train_rows)


def train(table: DataFrame, task: str | Task, config: LinearConfig = LinearConfig(), key: str = "doc_id") -> LinearModel:
    """Split a cleaned table by ``config.seed``, fit on its training part, judge the other two."""
    parted = split.stratified_split(table.drop("split"), config.test_size, config.val_size, config.seed, key)
    parts = {name: parted.filter(F.col("split") == name) for name in ("train", "val", "test")}
    return fit(parts.pop("train"), config, task, parts)


def predict(
    df: DataFrame,
    model: LinearModel,
    task: str | Task | None = None,
    key: str = "doc_id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """The prediction record for normalised ``text``; each row is scored by itself."""
    labels = (get_task(task) if task else model.task).labels
    names = F.array(*(F.lit(label) for label in labels))
    scored = model.pipeline.transform(df.select(key, *carry, "text")).withColumn("p", vector_to_array("probability"))
    chosen = F.col("prediction").cast("int")
    return scored.select(
        key,
        *carry,
        chosen.alias("label_id"),
        F.get(names, chosen).alias("label"),
        F.round(F.get(F.col("p"), chosen), 4).alias("confidence"),
        sc.score_map(F.col("p"), labels).alias("scores"),
    )
