import pytest

from civitext import HARM
from civitext.operators import explain as ex
from civitext.operators import naive_bayes
from civitext.operators import predict as pr
from tests.test_models import TIGHT, Brute, corpus, frame, new_texts, words


@pytest.fixture(scope="module")
def case(spark):
    rows = corpus(3, 60, seed=10)
    return rows, naive_bayes.fit(frame(spark, rows), HARM), Brute(rows, 3)


def brute_phi(brute, n_rows, text, c):
    out = {}
    for token in set(words(text)) & brute.vocab:
        logs = [brute.weight(token, i) for i in range(3)]
        mean = sum(brute.n[i][token] for i in range(3)) / n_rows
        weight = logs[c] - sum(logs) / 3
        out[token] = (weight, weight * (words(text).count(token) - mean))
    return out


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_contributions_equal_brute_force(spark, case, limits):
    rows, model, brute = case
    df = new_texts(spark, rows)
    label = {r.doc_id: r.label for r in pr.predict(df, model).collect()}
    confidence = {r.doc_id: r.confidence for r in pr.predict(df, model).collect()}
    got = {}
    for r in ex.attributions(df, model, **limits).collect():
        got.setdefault(r.doc_id, {})[r.token] = (r.weight, r.phi)
        assert (r.label, r.confidence) == (label[r.doc_id], confidence[r.doc_id])
    for key, text, _ in rows:
        c = HARM.labels.index(label[key]) if label[key] else 0
        wanted = brute_phi(brute, len(rows), text, c)
        assert set(got.get(key, {})) == set(wanted)
        for token, pair in wanted.items():
            assert got[key][token] == pytest.approx(pair, abs=1e-9)


def test_ranked_views(spark, case):
    rows, model, _ = case
    attributed = ex.attributions(frame(spark, rows), model)
    phi = {}
    weight = {}
    for r in attributed.collect():
        phi.setdefault(r.doc_id, {})[r.token] = r.phi
        weight.setdefault(r.doc_id, {})[r.token] = abs(r.weight)
    order = lambda items: [t for t, _ in sorted(items, key=lambda x: (-round(abs(x[1]), 8), x[0]))]
    records = {r.doc_id: r for r in ex.explanation_records(frame(spark, rows), model, 4).collect()}
    assert set(records) == {key for key, _, _ in rows}
    plots = ex.plot_data(attributed, 5).collect()
    scaled = ex.token_importance(attributed).collect()
    margins = {r.doc_id: r.margin for r in ex.with_margin(attributed).collect()}
    for key, tokens in phi.items():
        r = records[key]
        assert [t.token for t in r.top_tokens] == order([x for x in tokens.items() if x[1] > 0])[:4]
        assert [t.token for t in r.bottom_tokens] == order([x for x in tokens.items() if x[1] < 0])[:4]
        mine = sorted((p for p in plots if p.doc_id == key), key=lambda p: p.rank)
        assert [p.token for p in mine] == order(tokens.items())[:5]
        assert all((p.direction == "increases") == (p.phi > 0) for p in mine)
        top = max(weight[key].values())
        for s in scaled:
            if s.doc_id == key:
                assert s.score == pytest.approx(weight[key][s.token] / top)
        assert margins[key] == pytest.approx(sum(tokens.values()))


def test_every_text_has_a_record(spark, case):
    _, model, _ = case
    texts = [(1, "qqxyzzy unseenword"), (2, ""), (3, None), (4, " \t ")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    prior = model.task.labels[max(model.task.ids, key=lambda c: (model.priors()[c], -c))]
    got = sorted((r.doc_id, r.label, r.top_tokens, r.bottom_tokens) for r in ex.explanation_records(df, model).collect())
    assert got == [(k, prior, [], []) for k, _ in texts]
