import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from civitext import HARM, VERACITY
from civitext.operators import linear, naive_bayes, selection, vocabulary
from civitext.operators import predict as pr
from civitext.plans import queries
from civitext.session import scratch_path
from civitext.streaming import score_stream

WORDS = [f"w{i}" for i in range(40)] + ["ሰላም", "ዓለም"]
# Every table is "too large" under these limits: the head has at most 5 tokens.
TIGHT = {"max_rows": 5, "max_bytes": 100, "salts": 3}


def corpus(classes, n=120, seed=6):
    """Texts in which one word is a third of all tokens."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = rng.randrange(classes)
        words = [rng.choice(["the", *rng.choices(WORDS[c * 7 :], k=2)]) for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(words), c))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label_id int")


def words(text):
    return re.findall(r"\w+", text.lower())


class Brute:
    """Naive Bayes over Python dictionaries."""

    def __init__(self, rows, k, alpha=1.0, min_count=1):
        self.k, self.alpha = k, alpha
        self.n = [Counter() for _ in range(k)]
        for _, text, c in rows:
            self.n[c].update(words(text))
        total = sum(self.n, Counter())
        self.vocab = {t for t, m in total.items() if m >= min_count}
        self.rows = Counter(c for _, _, c in rows)
        self.tokens = [sum(m for t, m in self.n[c].items() if t in self.vocab) for c in range(k)]

    def weight(self, token, c):
        return math.log(self.n[c][token] + self.alpha) - math.log(self.tokens[c] + self.alpha * len(self.vocab))

    def scores(self, text):
        total = sum(self.rows.values())
        return [
            math.log(self.rows[c] / total) + sum(self.weight(t, c) for t in words(text) if t in self.vocab)
            for c in range(self.k)
        ]


@pytest.fixture(scope="module")
def harm(spark):
    rows = corpus(3)
    return rows, naive_bayes.fit(frame(spark, rows), HARM), Brute(rows, 3)


@pytest.fixture(scope="module")
def veracity(spark):
    rows = corpus(2, seed=7)
    return rows, naive_bayes.fit(frame(spark, rows), VERACITY), Brute(rows, 2)


NEW = [(1000, "the the unseen W3 w39!"), (1001, ""), (1002, "nothing known"), (1003, None), (1004, "ሰላም the https://w1.x")]


def new_texts(spark, rows):
    return spark.createDataFrame([(k, t) for k, t, _ in rows] + NEW, "doc_id long, text string")


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_scores_equal_brute_force(spark, harm, limits):
    rows, model, brute = harm
    out = pr.class_scores(new_texts(spark, rows), [model], **limits).collect()
    texts = {k: t for k, t, _ in rows} | {k: t or "" for k, t in NEW}
    texts[1004] = "ሰላም the"
    assert len(out) == len(texts)
    for r in out:
        assert r.scores0 == pytest.approx(brute.scores(texts[r.doc_id]), abs=1e-6)


def test_prediction_record(spark, harm):
    rows, model, brute = harm
    out = {r.doc_id: r for r in pr.predict(new_texts(spark, rows), model).collect()}
    for key, text, _ in rows:
        r = out[key]
        if not text:
            continue
        scores = brute.scores(text)
        exps = [math.exp(s - max(scores)) for s in scores]
        shares = [e / sum(exps) for e in exps]
        assert r.label == HARM.labels[shares.index(max(shares))]
        assert r.confidence == pytest.approx(max(shares), abs=6e-5) == max(r.scores.values())
        assert sum(r.scores.values()) == pytest.approx(1, abs=2e-4)
    assert out[1001].status == out[1003].status == "empty_input"
    assert out[1001].label is out[1001].confidence is out[1001].scores is None
    prior = [brute.rows[c] / len(rows) for c in range(3)]
    assert out[1002].confidence == pytest.approx(max(prior), abs=6e-5)


def test_same_bits_under_any_partitioning(spark, harm):
    rows, model, _ = harm
    df = new_texts(spark, rows)
    wanted = None
    for n in (1, 4, 200):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            for limits in ({}, TIGHT):
                got = sorted(map(tuple, pr.class_scores(df.repartition(n), [model], **limits).collect()))
                wanted = wanted or got
                assert got == wanted
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_repeated_and_null_keys_keep_every_row(spark, harm, limits):
    rows, model, _ = harm
    texts = [t for _, t, _ in rows] + [t for _, t in NEW]
    keys = [1, 1, None, None, *range(10, 6 + len(texts))]
    table = list(zip(keys, texts)) + [(1, texts[0])] * 2 + [(None, None)] * 3 + [(1, "")] * 2
    single = {r.text: r for r in pr.predict(spark.createDataFrame(list(enumerate({t for _, t in table})), "doc_id long, text string"), model, carry=["text"]).collect()}
    out = pr.predict(spark.createDataFrame(table, "doc_id long, text string"), model, carry=["text"], **limits).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(table)
    assert all((r.label, r.confidence, r.scores) == (single[r.text].label, single[r.text].confidence, single[r.text].scores) for r in out)


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_combined_equals_single(spark, harm, veracity, limits):
    df = new_texts(spark, harm[0])
    both = {r.doc_id: r for r in pr.predict_combined(df, [harm[1], veracity[1]], **limits).collect()}
    for task, model in (("hate_speech", harm[1]), ("fake_news", veracity[1])):
        for r in pr.predict(df, model).collect():
            b = both[r.doc_id]
            assert (b[f"label_{task}"], b[f"confidence_{task}"], b[f"scores_{task}"]) == (r.label, r.confidence, r.scores)


def test_save_and_load(spark, harm):
    rows, model, _ = harm
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = naive_bayes.load(spark, path)
    df = new_texts(spark, rows)
    assert sorted(map(str, pr.predict(df, loaded).collect())) == sorted(map(str, pr.predict(df, model).collect()))
    with pytest.raises(naive_bayes.ModelNotFound):
        naive_bayes.load(spark, scratch_path(spark, "no-model"))


def test_class_without_rows_is_never_chosen(spark):
    rows = [(1, "a b", 0), (2, "c d", 2)]
    model = naive_bayes.fit(frame(spark, rows), HARM)
    out = pr.predict(spark.createDataFrame([(1, "zzz"), (2, "c")], "doc_id long, text string"), model).collect()
    assert all(r.scores["abusive"] == 0.0 and r.label != "abusive" for r in out)


def test_score_breakdown(spark, harm):
    rows, model, _ = harm
    predicted = pr.predict(new_texts(spark, rows), model)
    records = {r.doc_id: r.scores for r in predicted.collect() if r.scores}
    lines = pr.score_breakdown(predicted).collect()
    assert len(lines) == 3 * len(records)
    for key, scores in records.items():
        mine = sorted((r for r in lines if r.doc_id == key), key=lambda r: r.rank)
        assert [(r.label, r.score) for r in mine] == sorted(scores.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_vocabulary_and_encoding(spark, harm, limits):
    rows, _, _ = harm
    df = frame(spark, rows)
    fitted = vocabulary.fit_vocabulary(df)
    counts = Counter(t for _, text, _ in rows for t in words(text))
    wanted = {t: i + 1 for i, t in enumerate(sorted(counts, key=lambda t: (-counts[t], t.encode())))}
    assert {r.token: r.token_id for r in fitted.table.collect()} == wanted
    assert (fitted.rows, fitted.occurrences) == (len(wanted), sum(counts.values()))
    fresh = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(999, "the unseen the")], "doc_id long, text string")
    for r in vocabulary.encode(fresh, fitted, 12, **limits).collect():
        text = "the unseen the" if r.doc_id == 999 else rows[r.doc_id][1]
        ids = [wanted.get(t, 0) for t in words(text)][:12]
        assert r.input_ids == ids + [0] * (12 - len(ids))
        assert r.attention_mask == [1] * len(ids) + [0] * (12 - len(ids))


def test_pad_and_mask(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "x"), (3, "")], "doc_id long, text string")
    out = {r.doc_id: (r.tokens, r.attention_mask) for r in vocabulary.pad_and_mask(df, 3).collect()}
    pad = "[PAD]"
    assert out == {1: (["a", "b", "c"], [1, 1, 1]), 2: (["x", pad, pad], [1, 0, 0]), 3: ([pad] * 3, [0, 0, 0])}


@pytest.mark.parametrize("task, fixture", [(HARM, "harm"), (VERACITY, "veracity")])
@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_candidates_equal_brute_force(spark, request, task, fixture, limits):
    rows, model, _ = request.getfixturevalue(fixture)
    k = len(task.labels)
    held = corpus(k, 60, seed=8)
    grid = [selection.Candidate(0.1), selection.Candidate(1.0, 2), selection.Candidate(5.0, 10_000)]
    out = selection.evaluate_candidates(frame(spark, held), model, grid, **limits).collect()
    for r in out:
        c = grid[r.candidate - 1]
        brute = Brute(rows, k, c.alpha, c.min_count)
        pred = [(true, max(range(k), key=lambda i, s=brute.scores(t): (s[i], -i))) for _, t, true in held]

        def f1(i):
            tp = sum(t == p == i for t, p in pred)
            both = sum(t == i for t, _ in pred) + sum(p == i for _, p in pred)
            return 2 * tp / both if both else 0.0

        wanted = f1(1) if task is VERACITY else sum(map(f1, range(k))) / k
        assert r.f1 == pytest.approx(wanted, abs=1e-6)
    best = [r for r in selection.mark_best(spark.createDataFrame(out)).collect() if r.is_best]
    assert [r.candidate for r in best] == [min(out, key=lambda r: (-r.f1, r.candidate)).candidate]


def test_best_model_is_the_restricted_one(spark, harm):
    rows, model, _ = harm
    held = frame(spark, corpus(3, 60, seed=8))
    scored = selection.evaluate_candidates(held, model, [selection.Candidate(0.3, 40)])
    best = selection.best_model(scored, model)
    brute = Brute(rows, 3, 0.3, 40)
    assert best.vocabulary_size == len(brute.vocab) < model.vocabulary_size
    for r in pr.class_scores(held, [best]).collect():
        text = next(t for k, t, _ in corpus(3, 60, seed=8) if k == r.doc_id)
        assert r.scores0 == pytest.approx(brute.scores(text), abs=1e-6)


@pytest.mark.parametrize(
    "metrics, stop, kept",
    [
        ([0.5, 0.6, 0.7], None, 3),
        ([0.5, 0.4, 0.3, 0.9], 3, 1),
        ([0.5, 0.5, 0.6, 0.6, 0.6, 0.9], 5, 3),
        ([0.5, 0.4, 0.6, 0.5, 0.7], None, 5),
    ],
)
def test_early_stopping(spark, metrics, stop, kept):
    history = spark.createDataFrame([("t", i + 1, f) for i, f in enumerate(metrics)], "task string, step int, f1 double")
    out = selection.early_stopping(history, 2).collect()
    assert {r.stop_step for r in out} == {stop}
    assert [r.step for r in out if r.kept] == [kept]


def test_linear_model(spark, harm):
    rows, _, _ = harm
    train = frame(spark, rows)
    model = linear.fit(train, linear.LinearConfig(features=1 << 12, iterations=10))
    out = linear.predict(train, model, HARM).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.confidence == max(r.scores.values()) and sum(r.scores.values()) == pytest.approx(1, abs=2e-4)
        assert r.label == HARM.labels[r.label_id]
    accuracy = sum(r.label_id == rows[r.doc_id][2] for r in out) / len(out)
    assert accuracy > 0.8


def test_stream_equals_batch(spark, harm):
    rows, model, _ = harm
    source, output, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    df = new_texts(spark, rows)
    df.filter("doc_id < 60").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    score_stream(stream(), model, output, checkpoint).awaitTermination()
    df.filter("doc_id >= 60").coalesce(1).write.mode("append").parquet(source)
    score_stream(stream(), model, output, checkpoint).awaitTermination()
    got = spark.read.parquet(output)
    assert got.select("batch").distinct().count() == 2
    scored = got.drop("batch").select(pr.predict(df, model).columns)
    assert sorted(map(str, scored.collect())) == sorted(map(str, pr.predict(df, model).collect()))


@pytest.mark.parametrize("files", [1, 3])
def test_a_stream_reads_a_table_of_one_file_or_a_folder(spark, tmp_path, files):
    texts = [(i, f"{text} w{i} text", "en", "web", 1) for i, text, _ in corpus(3, 40)]
    documents = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for name, table in (("documents", documents), ("labels", labels)):
        target = tmp_path / f"{name}.parquet"
        if files > 1:
            table.repartition(files).write.parquet(str(target))
        else:
            table.toPandas().astype({"doc_id": "int64"}).to_parquet(target)
    streamed, batch = (queries()[name](spark, str(tmp_path)).collect() for name in ("stream_score", "predict_harm"))
    assert len(streamed) == 40 and sorted(map(str, streamed)) == sorted(map(str, batch))


def test_a_difference_below_the_printed_places_decides(spark):
    rows = [(1, 0.5, 1, 0.8123456), (2, 1.0, 1, 0.8123456 + 4e-7), (3, 2.0, 1, 0.8123456 + 4e-7)]
    scored = spark.createDataFrame(rows, "candidate int, alpha double, min_count int, f1 double")
    assert [r.candidate for r in selection.mark_best(scored).collect() if r.is_best] == [2]
