"""The pipeline's stages against brute force on their own input."""

import numpy as np

import __spark_entry__
import corpus_pipeline
from tests.llm.test_byte_bpe import ids_of
from tests.llm.test_hyperminhash import brute
from tests.llm.test_secret_scan import ENCODING
from civitext.llm import mixing, quality_cnn, secret_scan
from civitext.session import materialise

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "secrets", "mix", "tokens"]
    columns = docs.columns

    good = materialise(stages["quality"](spark, docs, SF_DIR), "t")
    net = quality_cnn.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    texts = {d: r.text.encode() for d, r in rows(docs).items()}
    score = {d: quality_cnn.score(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for d, t in texts.items()}
    assert good.columns == columns and set(rows(good)) == {d for d, s in score.items() if s >= 0.3}
    assert 0.8 < len(rows(good)) / len(texts) < 1

    single = materialise(stages["near_dedup"](spark, good, SF_DIR), "t")
    kept = {d for d, _, _, keep in brute([(d, r.text) for d, r in rows(good).items()], 80) if keep}
    assert single.columns == columns and set(rows(single)) == kept and len(kept) < good.count()

    masked = materialise(stages["secrets"](spark, single, SF_DIR), "t")
    assert masked.columns == columns and set(rows(masked)) == kept
    before = rows(single)
    for d, r in rows(masked).items():
        text, at, out = before[d].text, 0, ""
        for a, b, _ in secret_scan.spans(text, ENCODING):
            out += text[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        assert r.text == out + text[at:]

    mixed = materialise(stages["mix"](spark, masked, SF_DIR), "t")
    taken = {r.doc_id: r.taken for r in mixing.mix(mixing.sizes_of(masked).cache()).collect() if r.taken}
    assert mixed.columns == columns and {d: len(mixing_words(r.text)) for d, r in rows(mixed).items()} == taken

    coded = rows(stages["tokens"](spark, mixed, SF_DIR))
    assert {d: bytes(r.ids) for d, r in coded.items()} == {d: ids_of(r.text) for d, r in rows(mixed).items()}
    whole = rows(__spark_entry__.queries()["pipeline"](spark, SF_DIR))
    assert whole == coded


def mixing_words(text):
    return text.encode().split()


def test_rows_without_ids_and_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "these are words of a text that has no number at all and goes on"
    data = [(None, text, None, None, 1), (None, text, "en", "s", 1), (None, None, None, None, None), (1, "", "en", "s", 0), (2, text + " x", "en", "s", 2)]
    for table in (spark.createDataFrame(data, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = materialise(stage(spark, docs, SF_DIR), "t")
        assert docs.count() <= table.count() and (docs.count() > 0) == (table.count() > 0)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["key", "words", "ranges", "spans", "its_id", "its_doc_id", "row", "score", "predicted", "own_id", "place", "its_source", "none"]


def words_from(start, n):
    return " ".join(f"w{i}" for i in range(start, start + n))


def run_stages(spark, docs, names):
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        if name in names:
            out = materialise(stage(spark, out, SF_DIR), "t")
            assert out.columns == docs.columns or name == "tokens"
    return out


def test_near_duplicates_from_eighty_percent_on_go(spark):
    """104 words have 100 shingles; with 11 to 30 others at the end they share from 90 to 77 percent."""
    base = words_from(0, 104)
    texts = [base] + [base + " " + words_from(1000 * k, extra) for k, extra in enumerate((11, 17, 20, 24, 25, 26, 30), 1)]
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    out = rows(run_stages(spark, spark.createDataFrame(data, SCHEMA), ["near_dedup"]))
    wanted = {d for d, _, _, keep in brute([(i, t) for i, t, *_ in data], 80) if keep}
    assert set(out) == wanted and 0 in out and 4 not in out and 7 in out


def test_texts_under_one_id_are_documents_each(spark):
    a, b, c = words_from(0, 40), words_from(100, 40), words_from(200, 40)
    data = [(2, a, "en", "s", 1), (2, b, "en", "s", 1), (2, a, "en", "s", 1), (2, a, "de", "s", 1), (3, c, "en", "s", 1), (3, c, "en", "s", 1), (4, a, "en", "s", 1), (None, b, "en", "s", 1), (None, c + " x", "en", "s", 1)]
    for _ in range(2):  # the same rows whatever the order
        out = [tuple(r) for r in run_stages(spark, spark.createDataFrame(data, SCHEMA).repartition(3), ["near_dedup"]).collect()]
        kept = sorted((r[1][:4], r[0]) for r in out)
        # a: id 4 names one text and comes before the ambiguous id 2; b: an id with several texts and none tie by hash
        assert len(out) == 3 and ("w0 w", 4) in kept and ("w200", 3) in kept
        data.reverse()


def test_clashing_columns_and_odd_rows_pass_all_stages(spark):
    secret = words_from(0, 50) + " password = hunter2secret " + words_from(300, 30)
    data = [(i, f"{words_from(50 * i, 40)}\t {secret if i == 3 else ''}", "en", f"s{i % 2}", 1, *[f"{c}{i}" for c in CLASHES]) for i in range(6)]
    data += [(9, None, None, None, None, *[None] * len(CLASHES)), (None, "", "en", None, 0, *[None] * len(CLASHES)), data[2], data[2]]
    docs = spark.createDataFrame(data, SCHEMA + "".join(f", {c} string" for c in CLASHES))
    out = run_stages(spark, docs, ["near_dedup", "secrets"])
    found = [r.asDict() for r in out.collect()]
    assert len(found) == 8 and all(r[c] == (f"{c}{r['doc_id']}" if r["doc_id"] in range(6) else None) for r in found for c in CLASHES)
    assert next(r for r in found if r["doc_id"] == 3)["text"].count("[SECRET]") == 1
    mixed = run_stages(spark, out, ["mix"])
    assert all(r[c] == f"{c}{r['doc_id']}" and r["n_chars"] == len(r["text"]) for r in (x.asDict() for x in mixed.collect()) for c in CLASHES)
    assert {r.doc_id for r in run_stages(spark, mixed, ["tokens"]).collect()} == {r.doc_id for r in mixed.collect()}
    judged = corpus_pipeline.quality(spark, docs, SF_DIR)
    assert judged.columns == docs.columns and all(r["score"] in (None, f"score{r['doc_id']}") for r in (x.asDict() for x in judged.collect()))


def test_texts_are_not_shuffled_to_find_repeated_ids(spark):
    data = [(i, words_from(i, 5), "en", "s", 1) for i in range(50)]
    for more in [], [(3, "x", "en", "s", 1), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), data[4]]:
        keyed = corpus_pipeline._keyed(spark.createDataFrame(data + more, SCHEMA))
        assert "hashpartitioning(doc_id" not in keyed._jdf.queryExecution().executedPlan().toString()
        found = keyed.collect()
        assert len({r.key for r in found}) == len(found) == 50 + 2 * bool(more)
        assert sorted((r.doc_id, r.text) for r in found if r.doc_id is not None) == sorted((r[0], r[1]) for r in data + more[:1])
