"""The registered queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.functions import labels as lb
from civitext.functions import scores as sc
from civitext.functions import text as tx
from civitext.operators import evaluate as ev
from civitext.operators import explain as ex
from civitext.operators import linear, model_store, naive_bayes, prepare, profile, selection, vocabulary
from civitext.operators import predict as pr
from civitext.operators import split as sp
from civitext.plans import corpora
from civitext.session import materialise, scan_parts, scratch_path
from civitext.sources import readers, writers
from civitext.streaming import score_stream
from civitext.tasks import HARM, VERACITY, Task

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# Sources and sinks


@query
def ingest_union_splits(spark, sf_dir):
    frames = {
        "train": corpora.documents(spark, sf_dir).select("doc_id", "text"),
        "validation": corpora.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"),
        "test": readers.harmonise(corpora.roles(spark, sf_dir)).drop("split"),
    }
    return readers.union_splits(frames).select("doc_id", "text", "label", "split")


@query
def ingest_harmonised(spark, sf_dir):
    return readers.harmonise(corpora.roles(spark, sf_dir), lower_labels=True)


@query
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.write_csv(ingest_harmonised(spark, sf_dir).select("doc_id", "text", "label", "split"), path)
    return readers.read_csv(spark, path)


@query
def splits_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "splits")
    prepared = _prepared(spark, sf_dir, HARM)
    writers.write_splits(prepared.select("doc_id", "text", "label", "label_id", "split"), path)
    parts = [readers.read_splits(spark, path, name) for name in ("train", "val", "test")]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.select("doc_id", "text", "label", "label_id", "split")


def _datasets(spark, sf_dir) -> dict[str, DataFrame]:
    return {
        corpora.HARM_NAME: corpora.harm(spark, sf_dir),
        corpora.ROLES_NAME: ingest_harmonised(spark, sf_dir),
        "amharic_documents": corpora.documents(spark, sf_dir).filter(F.col("lang") == "am"),
    }


@query
def dataset_manifest(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    writers.write_json(writers.dataset_manifest(_datasets(spark, sf_dir)), path)
    stored = spark.read.schema("dataset string, rows long, columns array<string>").json(path)
    return stored.select("dataset", "rows", F.array_join("columns", ",").alias("column_names"))


# Profiling


def _stacked(spark, sf_dir, *columns: str) -> DataFrame:
    named = {n: d for n, d in _datasets(spark, sf_dir).items() if n != "amharic_documents"}
    return profile.stack(named, list(columns))


@query
def dataset_summary(spark, sf_dir):
    summary = profile.dataset_summary(_datasets(spark, sf_dir))
    return summary.select("dataset", "status", "rows", F.array_join("columns", ",").alias("column_names"))


@query
def label_distribution(spark, sf_dir):
    return profile.label_distribution(_stacked(spark, sf_dir, "label"))


@query
def split_distribution(spark, sf_dir):
    return profile.split_distribution(_stacked(spark, sf_dir, "split"))


@query
def split_label_report(spark, sf_dir):
    def report(task: Task) -> DataFrame:
        prepared = _prepared(spark, sf_dir, task)
        rows = sp.split_label_report(prepared, lb.decode(F.col("label_id"), task))
        return rows.select(F.lit(task.name).alias("task"), "*")

    return report(HARM).unionByName(report(VERACITY))


@query
def text_length(spark, sf_dir):
    return profile.text_lengths(corpora.sparse(spark, sf_dir))


@query
def text_length_histogram(spark, sf_dir):
    return profile.length_histogram(profile.length_frequencies(_stacked(spark, sf_dir, "text")))


@query
def text_length_median(spark, sf_dir):
    return profile.length_median(profile.length_frequencies(_stacked(spark, sf_dir, "text")))


@query
def text_length_sketch(spark, sf_dir):
    """Medians from sketches of each split, merged by dataset, and whether their rank is as near as the sketch promises."""
    stacked = _stacked(spark, sf_dir, "split", "label", "text")
    merged = profile.merge_sketches(profile.length_sketches(stacked, ["dataset", "split", "label"]), ["dataset"])
    estimated = profile.sketch_quantile(merged, 0.5)
    return profile.rank_error(estimated, profile.length_frequencies(stacked)).select(
        "dataset", "n", (F.col("rank_error") <= profile.RANK_ERROR).alias("within_bound")
    )


@query
def sample_per_class(spark, sf_dir):
    return profile.sample_per_class(corpora.harm(spark, sf_dir))


@query
def script_coverage(spark, sf_dir):
    return profile.script_coverage(corpora.sparse(spark, sf_dir), "lang")


@query
def normalise_preview(spark, sf_dir):
    return profile.normalise_preview(corpora.noisy(spark, sf_dir))


# Normalisation


def _text_query(name: str, corpus: Query, step: Callable[[Column], Column]) -> None:
    def run(spark, sf_dir):
        return corpus(spark, sf_dir).select("doc_id", step(F.col("text")).alias("text"))

    _REGISTRY[name] = run


_text_query("normalise_null", corpora.sparse, tx.null_to_empty)
_text_query("normalise_nfc", corpora.noisy, tx.nfc)
_text_query("strip_urls", corpora.noisy, tx.strip_urls)
_text_query("strip_mentions", corpora.noisy, tx.strip_mentions)
_text_query("unwrap_hashtags", corpora.noisy, tx.unwrap_hashtags)
_text_query("strip_emoji", corpora.noisy, tx.strip_emoji)
_text_query("collapse_punct", corpora.noisy, tx.collapse_punctuation)
_text_query("collapse_ws", corpora.noisy, tx.collapse_whitespace)
_text_query("normalise_text", corpora.sparse, tx.normalise)
_text_query("unify_equivalents", corpora.noisy, tx.unify_equivalents)
_text_query("strip_emoji_strict", corpora.noisy, lambda text: tx.strip_emoji(text, strict=True))
_text_query("normalise_text_strict", corpora.sparse, lambda text: tx.normalise(text, strict_emoji=True))


@query
def drop_near_empty(spark, sf_dir):
    return prepare.normalise_texts(corpora.sparse(spark, sf_dir).select("doc_id", "text"))


# Labels


@query
def project_clean(spark, sf_dir):
    return prepare.project(corpora.messy_labels(spark, sf_dir), "content", "tag")


@query
def encode_labels(spark, sf_dir):
    rows = corpora.messy_labels(spark, sf_dir).select("doc_id", F.col("tag").alias("label"))
    return prepare.encode_labels(rows, HARM)


@query
def unknown_labels(spark, sf_dir):
    rows = corpora.messy_labels(spark, sf_dir).select(F.col("tag").alias("label"))
    return prepare.unknown_labels(rows, HARM)


@query
def preprocess_report(spark, sf_dir):
    counts = prepare.DropCounts()
    prepare.preprocess(corpora.dirty(spark, sf_dir), HARM, counts=counts)
    found = counts.dropped()
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{name} long" for name in found))


@query
def encode_label_table(spark, sf_dir):
    words = vocabulary.tokenise(corpora.table(spark, sf_dir, "documents"))
    labelled = words.select("doc_id", F.concat(F.lit(" "), "token", F.lit("\t")).alias("label"))
    encoded = prepare.encode_labels_by_table(labelled, corpora.label_words(spark, sf_dir), "words")
    return encoded.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("label_id").cast("long")).alias("label_ids"))


@query
def harmonise_labels(spark, sf_dir):
    encoded = prepare.encode_labels(_stacked(spark, sf_dir, "label"), HARM)
    counts = encoded.groupBy("dataset", "label_id").agg(F.count("*").alias("n"))
    return counts.select("dataset", "label_id", lb.decode(F.col("label_id"), HARM).alias("label"), "n")


# Splits


def _corpus(spark, sf_dir, task: Task) -> DataFrame:
    return corpora.harm(spark, sf_dir) if task is HARM else corpora.veracity(spark, sf_dir)


def _prepared(spark, sf_dir, task: Task) -> DataFrame:
    return prepare.preprocess(_corpus(spark, sf_dir, task), task)


@query
def stratified_split(spark, sf_dir):
    return _prepared(spark, sf_dir, HARM).select("doc_id", "label_id", "split")


@query
def predefined_split(spark, sf_dir):
    prepared = prepare.preprocess(corpora.harm(spark, sf_dir), HARM, mode="predefined")
    return prepared.select("doc_id", "label_id", "split")


@query
def carve_validation(spark, sf_dir):
    prepared = prepare.preprocess(corpora.harm_without_validation(spark, sf_dir), HARM, mode="predefined")
    return prepared.select("doc_id", "label_id", "split")


@query
def split_disjoint(spark, sf_dir):
    return sp.overlapping_keys(_prepared(spark, sf_dir, HARM))


@query
def split_leakage(spark, sf_dir):
    return sp.shared_texts(_prepared(spark, sf_dir, HARM))


# Tokens


def _normal_texts(spark, sf_dir) -> DataFrame:
    return corpora.documents(spark, sf_dir).select("doc_id", tx.normalise(F.col("text")).alias("text"))


@query
def tokenise(spark, sf_dir):
    return vocabulary.tokenise(_normal_texts(spark, sf_dir))


@query
def pad_and_mask(spark, sf_dir):
    rows = vocabulary.pad_and_mask(_normal_texts(spark, sf_dir), HARM.max_length)
    return rows.select(
        "doc_id",
        F.array_join("tokens", " ").alias("tokens"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("attention_mask"),
    )


@query
def vocab_encode(spark, sf_dir):
    prepared = _prepared(spark, sf_dir, VERACITY)
    words = vocabulary.fit_vocabulary(prepared.filter(F.col("split") == "train"))
    rows = vocabulary.encode(prepared, words, VERACITY.max_length)
    return rows.select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("attention_mask"),
    )


@query
def term_frequencies(spark, sf_dir):
    return vocabulary.term_frequencies(_normal_texts(spark, sf_dir))


# Training


def _fit(prepared: DataFrame, task: Task) -> naive_bayes.NaiveBayes:
    return naive_bayes.fit(prepared.filter(F.col("split") == "train"), task)


def _model(spark, sf_dir, task: Task) -> naive_bayes.NaiveBayes:
    return _fit(_prepared(spark, sf_dir, task), task)


def _both_tasks(spark, sf_dir) -> DataFrame:
    """The labelled texts cleaned once for the harm and the veracity task."""
    return prepare.preprocess_tasks(corpora.both_tasks(spark, sf_dir), {HARM.name: "harm", VERACITY.name: "veracity"})


def _weight_rows(model: naive_bayes.NaiveBayes) -> DataFrame:
    columns = [F.round(F.col("w")[c] / naive_bayes.SCALE, 4).alias(f"w_{model.task.labels[c]}") for c in model.task.ids]
    return model.weights().table.select("token", F.col("total").alias("n"), *columns)


@query
def nb_train_harm(spark, sf_dir):
    return _weight_rows(_model(spark, sf_dir, HARM))


@query
def nb_train_veracity(spark, sf_dir):
    return _weight_rows(_model(spark, sf_dir, VERACITY))


@query
def lr_train_score(spark, sf_dir):
    """A fit by an optimiser has no SQL; what every scored text promises has."""
    prepared = _prepared(spark, sf_dir, HARM)
    model = linear.fit(prepared.filter(F.col("split") == "train"), task=HARM)
    scored = linear.predict(prepared.filter(F.col("split") == "test"), model)
    shares = F.map_values("scores")
    return scored.select(
        "doc_id",
        F.size("scores").alias("n_scores"),
        (F.col("confidence") == F.array_max(shares)).alias("confidence_is_highest"),
        (F.abs(F.aggregate(shares, F.lit(0.0), lambda a, b: a + b) - 1) < 2e-4).alias("sums_to_one"),
        (F.try_element_at("scores", F.col("label")) == F.col("confidence")).alias("label_has_it"),
    )


@query
def linear_roundtrip(spark, sf_dir):
    """Train, judge, save, load: the loaded model scores every text as the fitted one does."""
    path = scratch_path(spark, "linear-model")
    # one table for training and both scorings, so that texts are cleaned once
    cleaned = materialise(prepare.clean(corpora.harm(spark, sf_dir), HARM), "cleaned")
    model = linear.train(cleaned, HARM)
    model.save(path)
    loaded = linear.load(spark, path)
    texts = cleaned.select("doc_id", "text")
    first, second = (linear.predict(texts, m).select("doc_id", "label", "confidence", F.map_entries("scores").alias("scores")) for m in (model, loaded))
    both = first.toDF("doc_id", "label", "confidence", "scores").join(second.toDF("doc_id", "label2", "confidence2", "scores2"), "doc_id")
    same = (F.col("label") == F.col("label2")) & (F.col("confidence") == F.col("confidence2")) & (F.col("scores") == F.col("scores2"))
    known = loaded.metrics == model.metrics and all(0 <= v <= 1 for v in loaded.metrics.values())
    return both.select(
        "doc_id",
        same.alias("same"),
        F.lit(",".join(sorted(loaded.metrics))).alias("metrics"),
        F.lit(known).alias("metrics_kept"),
        F.lit(loaded.config.seed).alias("seed"),
        F.lit(loaded.train_rows).cast("long").alias("train_rows"),
    )


GRID = [selection.Candidate(a, m) for a in (0.1, 0.5, 1.0, 2.0) for m in (1, 2)]
SCHEDULE = [selection.Candidate(a) for a in (10.0, 5.0, 2.0, 1.0, 0.5, 0.1, 0.05, 0.01)]


def _validated(spark, sf_dir, candidates) -> dict[str, DataFrame]:
    table = _both_tasks(spark, sf_dir)
    models = naive_bayes.fit_tasks(table, [HARM.name, VERACITY.name])
    validation = {t: prepare.of_task(table, t).filter(F.col("split") == "val") for t in models}
    return {t: selection.evaluate_candidates(validation[t], m, candidates) for t, m in models.items()}


@query
def select_best_candidate(spark, sf_dir):
    validated = _validated(spark, sf_dir, GRID)

    def marked(task: Task) -> DataFrame:
        scored = selection.mark_best(validated[task.name])
        rows = scored.select(F.lit(task.name).alias("task"), "*")
        return rows.withColumn("f1", F.round("f1", 4))

    return marked(HARM).unionByName(marked(VERACITY))


@query
def early_stopping(spark, sf_dir):
    """The validation metric along a falling smoothing, with patience 2."""
    validated = _validated(spark, sf_dir, SCHEDULE)

    def history(task: Task) -> DataFrame:
        return validated[task.name].select(F.lit(task.name).alias("task"), F.col("candidate").alias("step"), "f1")

    stopped = selection.early_stopping(history(HARM).unionByName(history(VERACITY)))
    return stopped.withColumns({c: F.round(c, 4) for c in ("f1", "best_so_far")})


# Prediction


def _flat(predictions: DataFrame, task: Task, suffix: str = "") -> DataFrame:
    """The score map as one column per label."""
    cols = [F.try_element_at(f"scores{suffix}", F.lit(label)).alias(f"p_{label}") for label in task.labels]
    return predictions.select(
        "doc_id", F.col(f"label{suffix}").alias("label"), F.col(f"confidence{suffix}").alias("confidence"), *cols
    )


@query
def softmax_scores(spark, sf_dir):
    scored = pr.class_scores(corpora.documents(spark, sf_dir), [_model(spark, sf_dir, HARM)])
    shares = scored.select("doc_id", "scores0", sc.softmax(F.col("scores0")).alias("p"))
    logs = [F.round(F.get("scores0", F.lit(c)), 4).alias(f"score_{HARM.labels[c]}") for c in HARM.ids]
    return shares.select("doc_id", *logs, *(F.round(F.get("p", F.lit(c)), 4).alias(f"p_{HARM.labels[c]}") for c in HARM.ids))


@query
def predict_label(spark, sf_dir):
    scored = pr.class_scores(corpora.documents(spark, sf_dir), [_model(spark, sf_dir, HARM)])
    chosen = sc.argmax(F.col("scores0"))
    return scored.select("doc_id", chosen.alias("label_id"), lb.decode(chosen, HARM).alias("label"))


@query
def predict_harm(spark, sf_dir):
    return _flat(pr.predict(corpora.documents(spark, sf_dir), _model(spark, sf_dir, HARM)), HARM)


@query
def predict_veracity(spark, sf_dir):
    return _flat(pr.predict(corpora.documents(spark, sf_dir), _model(spark, sf_dir, VERACITY)), VERACITY)


@query
def model_roundtrip(spark, sf_dir):
    """Train, judge on the validation part, save with settings and metrics, load and score."""
    path = scratch_path(spark, "model")
    prepared = _prepared(spark, sf_dir, HARM)
    model = _fit(prepared, HARM)
    validation = prepared.filter(F.col("split") == "val").withColumnRenamed("label_id", "y_true")
    judged = pr.predict(validation, model, carry=["y_true"], normalise=False)
    report = ev.full_report(judged, _names(HARM), y_pred="label_id").first()
    model.save(path, {"seed": 42}, {"val_f1_macro": report.f1_macro, "val_accuracy": report.accuracy})
    stored = model_store.latest(spark, path, "naive_bayes")
    scored = _flat(pr.predict(corpora.documents(spark, sf_dir), naive_bayes.load(spark, path)), HARM)
    kept = {"version": F.lit(stored.number).cast("long"), "alpha": F.lit(stored.config["alpha"]), "seed": F.lit(stored.config["seed"])}
    return scored.withColumns(kept | {k: F.lit(v) for k, v in stored.metrics.items()})


@query
def score_breakdown(spark, sf_dir):
    return pr.score_breakdown(pr.predict(corpora.documents(spark, sf_dir), _model(spark, sf_dir, HARM)))


@query
def predict_status(spark, sf_dir):
    predicted = pr.predict(corpora.sparse(spark, sf_dir), _model(spark, sf_dir, HARM))
    return predicted.select("doc_id", "status", "label", "confidence")


@query
def predict_repeated_keys(spark, sf_dir):
    predicted = pr.predict(corpora.repeated_keys(spark, sf_dir), _model(spark, sf_dir, HARM))
    return predicted.select("doc_id", "status", "label", "confidence")


@query
def predict_combined(spark, sf_dir):
    models = naive_bayes.fit_tasks(_both_tasks(spark, sf_dir), [HARM.name, VERACITY.name])
    both = pr.predict_combined(corpora.sparse(spark, sf_dir), list(models.values()))
    return both.select(
        "doc_id",
        "status",
        "label_hate_speech",
        "confidence_hate_speech",
        "label_fake_news",
        "confidence_fake_news",
    )


@query
def stream_score(spark, sf_dir):
    model = _model(spark, sf_dir, HARM)
    # Written as a pattern, because a stream takes a plain path for a folder and the table may be one file.
    stream = spark.readStream.schema(corpora.SCHEMAS["documents"]).parquet(f"{sf_dir}/documents.parque[t]")
    output, checkpoint = scratch_path(spark, "scored"), scratch_path(spark, "stream-checkpoint")
    score_stream(stream, model, output, checkpoint, parts=scan_parts(spark)).awaitTermination()
    return _flat(spark.read.parquet(output), HARM)


# Evaluation


def _synthetic(spark, sf_dir, mark: str, task: Task) -> DataFrame:
    rows = _corpus(spark, sf_dir, task).select("doc_id", "label")
    encoded = prepare.encode_labels(rows, task)
    return corpora.synthetic_predictions(spark, sf_dir, mark, len(task.labels), encoded)


def _names(task: Task) -> dict[int, str]:
    return dict(enumerate(task.labels))


@query
def eval_accuracy(spark, sf_dir):
    return ev.accuracy(_synthetic(spark, sf_dir, "p", HARM))


@query
def eval_full_report(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    report = ev.full_report(_synthetic(spark, sf_dir, "p", HARM), _names(HARM), HARM.name)
    writers.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


@query
def eval_class_report(spark, sf_dir):
    return ev.class_report(_synthetic(spark, sf_dir, "p", HARM), _names(HARM))


@query
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(_synthetic(spark, sf_dir, "p", HARM), _names(HARM))


@query
def confusion_matrix_normalised(spark, sf_dir):
    return ev.confusion_matrix_normalised(_synthetic(spark, sf_dir, "p", HARM), _names(HARM))


@query
def compare_models(spark, sf_dir):
    encoded = prepare.encode_labels(corpora.harm(spark, sf_dir).select("doc_id", "label"), HARM)
    predictions = {f"model_{m}": corpora.synthetic_prediction(m, len(HARM.labels)).alias(f"y_{m}") for m in ("p", "q")}
    judged = encoded.select(F.col("label_id").alias("y_true"), *predictions.values())
    return ev.compare_models(ev.model_reports(judged, _names(HARM), {"model_p": "y_p", "model_q": "y_q"}))


@query
def eval_f1_binary(spark, sf_dir):
    return ev.f1_binary(_synthetic(spark, sf_dir, "p", VERACITY), (1, 0))


@query
def eval_from_scores(spark, sf_dir):
    prepared = _prepared(spark, sf_dir, HARM)
    validation = prepared.filter(F.col("split") == "val")
    scored = pr.class_scores(validation, [_fit(prepared, HARM)], carry=["label_id"], normalise=False)
    judged = scored.select(F.col("label_id").alias("y_true"), sc.argmax(F.col("scores0")).alias("y_pred"))
    return ev.full_report(judged, _names(HARM)).select("f1_macro", "accuracy")


def _test_report(prepared: DataFrame, model: naive_bayes.NaiveBayes) -> DataFrame:
    test = prepared.filter(F.col("split") == "test").withColumnRenamed("label_id", "y_true")
    predicted = pr.predict(test, model, carry=["y_true"], normalise=False)
    return ev.full_report(predicted, _names(model.task), model.task.name, y_pred="label_id")


def _train_evaluate(spark, sf_dir, task: Task) -> DataFrame:
    prepared = _prepared(spark, sf_dir, task)
    return _test_report(prepared, _fit(prepared, task))


@query
def harm_train_evaluate(spark, sf_dir):
    return _train_evaluate(spark, sf_dir, HARM)


@query
def veracity_train_evaluate(spark, sf_dir):
    return _train_evaluate(spark, sf_dir, VERACITY)


@query
def best_model_evaluate(spark, sf_dir):
    """Train, keep the best candidate by its validation metric, report on the test part."""

    def report(task: Task) -> DataFrame:
        prepared = _prepared(spark, sf_dir, task)
        model = _fit(prepared, task)
        scored = selection.evaluate_candidates(prepared.filter(F.col("split") == "val"), model, GRID)
        return _test_report(prepared, selection.best_model(scored, model))

    return report(HARM).unionByName(report(VERACITY))


# Explanation


def _attributed(spark, sf_dir) -> DataFrame:
    return ex.attributions(corpora.documents(spark, sf_dir), _model(spark, sf_dir, HARM))


@query
def attribute_tokens(spark, sf_dir):
    rows = ex.with_margin(_attributed(spark, sf_dir))
    return rows.select(
        "doc_id", "token", "n", "label", F.round("phi", 4).alias("phi"), F.round("margin", 4).alias("margin")
    )


@query
def top_tokens(spark, sf_dir):
    rows = ex.top_tokens(_attributed(spark, sf_dir), 10)
    return rows.select("doc_id", "label", "confidence", "side", "rank", "token", F.round("phi", 4).alias("score"))


@query
def explanation_records(spark, sf_dir):
    records = ex.explanation_records(corpora.sparse(spark, sf_dir), _model(spark, sf_dir, HARM), 10)
    sides = [F.array_join(F.col(f"{side}.token"), " ").alias(side) for side in ("top_tokens", "bottom_tokens")]
    return records.select("doc_id", "label", "confidence", *sides)


@query
def token_importance(spark, sf_dir):
    rows = ex.token_importance(_attributed(spark, sf_dir))
    return rows.select("doc_id", "label", "token", F.round("score", 4).alias("score"))


@query
def attribution_plot_data(spark, sf_dir):
    rows = ex.plot_data(_attributed(spark, sf_dir), 15)
    return rows.select("doc_id", "rank", "token", F.round("phi", 4).alias("score"), "direction")
