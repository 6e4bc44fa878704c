"""Toxicity scores: the kernel against all subsequences, held-out accuracy, gapped insults, odd input."""

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from civitext.llm import toxicity_kernel as tk

SF_DIR = "/root/testdata/sf0.1"


def symbols(word):
    table = tk._symbols()
    return [tk._EDGE, *(int(table[ord(c)]) for c in word), tk._EDGE]


def counted(word):
    """Every subsequence within the span, and the length norm, by loops."""
    s, found, squares = symbols(word), {}, 0.0
    for places in combinations(range(len(s)), tk.ORDER):
        if places[-1] - places[0] < tk.SPAN:
            weight = tk.DECAY ** (places[-1] - places[0] + 1 - tk.ORDER)
            key = tuple(s[p] for p in places)
            found[key] = found.get(key, 0) + weight
            squares += weight * weight
    return found, max(squares, 1e-12) ** 0.5


def brute(a, b):
    (x, n), (y, m) = counted(a), counted(b)
    return sum(w * y.get(k, 0) for k, w in x.items()) / (n * m)


WORDS = ["idiot", "idxiot", "riot", "pathetic", "sympathetic", "réeuxment", "réeux", "aa", "ab1c", "aaaaaaaaaaaa", "x"]


def test_kernels_and_margins_equal_all_subsequences():
    words = tk.Words.of(pa.array([" ".join(WORDS)]))
    marks = tk.Words.of(pa.array(["idiot pathetic réeuxment aaaa"]))
    names = ["idiot", "pathetic", "réeuxment", "aaaa"]
    got = tk.kernels(words, marks)[words.word][:, marks.word]
    wanted = np.array([[brute(a, b) for b in names] for a in WORDS])
    assert np.allclose(got, wanted, atol=1e-5) and wanted[1, 0] > 2 * wanted[2, 0] > 0
    alphas = np.zeros(4)
    alphas[marks.word] = [1.5, -2.0, 0.5, 0.25]
    model = tk.Model(marks, alphas, 0.3, np.zeros(1), np.ones(1), np.zeros(1), 0.0)
    margin = tk.margins(model.table(), model.offset, words)[words.word]
    assert np.allclose(margin, wanted @ [1.5, -2.0, 0.5, 0.25] + 0.3, atol=1e-5)


def test_words_of_texts():
    words = tk.Words.of(pa.array(["Go, Go! i d i o t now.\nA b", None, "", "I.D-iot É漢 \U0001f600", "a 1 2 3 4"]))
    texts = [bytes(words.symbols[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
    of = lambda *ws: [bytes(symbols(w)) for w in ws]
    read = [(int(t), texts[w]) for t, w in zip(words.text, words.word)]
    assert [w for t, w in read if t == 0] == of("go", "go", "idiot", "now", "a", "b")
    assert [w for t, w in read if t == 3][:1] == of("idiot") and len([w for t, w in read if t == 3]) == 3
    assert len([1 for t, _ in read if t == 4]) == 5 and not [1 for t, _ in read if t in (1, 2)]
    first = words.sentence[words.text == 0] - words.sentence[0]
    assert first.tolist() == [0, 0, 1, 1, 2, 2]


@pytest.fixture(scope="module")
def model(spark):
    return tk.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))


def test_held_out_accuracy_and_whole_result(spark, model):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scored = tk.score_toxicity(docs, model).select("doc_id", tk.held_out().alias("held_out"), "score", "predicted").collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    judged = [(labels[r.doc_id], r.predicted) for r in scored if r.held_out and r.doc_id in labels]
    toxic, clean = [p for t, p in judged if t == 1], [p for t, p in judged if t == 0]
    # about one in twenty toxic labels lies on a text without any marked word
    assert np.mean(toxic) >= 0.88 and np.mean(clean) <= 0.02


PLAIN = "The thand inthe was eronan thati. Onthe re stond, erea the {} inan thouti. Anere thin the {} hathe ered. {} "


@pytest.mark.parametrize("insults", [("idiot", "stupid", "loser"), ("i d i o t", "s t u p i d", "l o s e r"), ("idi.ot", "stu*pid", "l-o-s-e-r"), ("idxiot", "worthxless", "disguxsting"), ("IDIOT!!", "St_upid", "disgustiing")])
def test_gapped_and_inserted_insults(model, insults):
    table = model.table()
    score = lambda *words: model.score(table, pa.array([PLAIN.format(*words)]))[0]
    assert score(*insults) >= 0.3 > score("thati", "onthe", "eronat")


def test_one_text_scores_as_in_a_batch(model):
    texts = [PLAIN.format("idiot", "x", "moron") * 40, None, "", " \n ", "?!", "a" * 100000, "İ" * 50, "ok"]
    together = model.score(model.table(), pa.array(texts, pa.string()))
    alone = [model.score(model.table(), pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(together, alone) and len(set(together[1:5])) == 1
    assert not len(model.score(model.table(), pa.array([], pa.string())))


def test_odd_tables(spark, model):
    docs = spark.createDataFrame([(1, "You idiot.", "s", 9), (1, "You idiot.", "s", 9), (None, None, "s", 9), (3, "", None, 9)], "doc_id long, text string, source string, score int")
    rows = tk.score_toxicity(docs, model).collect()
    assert len(rows) == 4 and rows[0] == rows[1] and "text" not in rows[0].asDict() and isinstance(rows[0].score, float)
    none = spark.createDataFrame([], docs.schema)
    assert tk.score_toxicity(none, model).count() == 0
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for untaught in (tk.train(docs, labels), tk.train(none, labels.limit(0))):
        assert len({r.score for r in tk.score_toxicity(docs, untaught).collect()}) == 1
