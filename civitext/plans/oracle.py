"""The registered queries once more, as SQL for another engine.

Each entry states its result from the definitions, over whole tables, with
plain windows and joins; nothing here is shared with the Spark operators.
"""

from __future__ import annotations

# The patterns are stated here by themselves, not taken from the Spark side, so
# that a mistake in one of the two shows.
# White space, characters of a word, and the ranges removed as emoji.
_BLANK = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}-\x{2029}\x{202f}\x{205f}\x{3000}"
_LETTER = r"_\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Nl}\p{No}"
_WIDE_EMOJI = r"\x{24C2}-\x{1F251}\x{2702}-\x{27B0}\x{1F1E0}-\x{1F1FF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}"
_PICTOGRAPHS = r"\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F7E0}-\x{1F7EB}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}"
_STRICT_EMOJI = rf"[{_PICTOGRAPHS}][{_PICTOGRAPHS}\x{{200D}}\x{{FE0F}}]*"

_STEPS = [
    (rf"http(?:s|)://[^{_BLANK}]+|www[.][^{_BLANK}]+", " "),
    (rf"@[{_LETTER}]+", " "),
    (rf"#([{_LETTER}]+)", r" \1 "),
    (f"[{_WIDE_EMOJI}]+", " "),
    ("[!-/:-@[-`{-~][!-/:-@[-`{-~]+", " "),
    (f"[{_BLANK}]+", " "),
]


def _replace(text: str, step: int) -> str:
    pattern, by = _STEPS[step]
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def _normal(text: str = "text", strict: bool = False) -> str:
    result = f"nfc_normalize(coalesce({text}, ''))"
    for step in range(len(_STEPS)):
        emoji = strict and step == 3
        result = f"regexp_replace({result}, '{_STRICT_EMOJI}', ' ', 'g')" if emoji else _replace(result, step)
    return f"trim({result})"


def _words(text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), '[{_LETTER}]+')"


_SPLIT_OF = "CASE WHEN {0} % 10 <= 6 THEN 'train' WHEN {0} % 10 = 7 THEN 'validation' ELSE 'test' END"

_HARM = f"""harm AS (
  SELECT d.doc_id, d.text, d.lang,
         CASE WHEN l.toxic = 1 THEN 'hate' WHEN l.quality = 0 THEN 'abusive' ELSE 'normal' END AS label,
         {_SPLIT_OF.format('d.doc_id')} AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

_VERACITY = """veracity AS (
  SELECT d.doc_id, d.text, d.lang, CASE WHEN l.quality = 1 THEN 'real' ELSE 'fake' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

_ROLES = f"""roles AS (
  SELECT conv_id * 1000 + turn AS doc_id, text,
         CASE role WHEN 'user' THEN 'hate' WHEN 'assistant' THEN 'offensive' ELSE 'normal' END AS label,
         {_SPLIT_OF.format('conv_id')} AS split
  FROM conversations)"""

_NOISY = """noisy AS (
  SELECT doc_id, lang, text || CASE doc_id % 7
      WHEN 0 THEN ' https://ex.org/' || doc_id || '?a=b'
      WHEN 1 THEN ' @user' || doc_id || ' a.b@example.com'
      WHEN 2 THEN ' #ሰላም' || doc_id || ' \u1215\u1206\u1a00'
      WHEN 3 THEN ' 😊🚀 漢字'
      WHEN 4 THEN ' !!!?? ok...'
      WHEN 5 THEN '\u00a0' || chr(9) || ' x \u3000'
      ELSE ' cafe\u0301' END AS text
  FROM documents)"""

_SPARSE = f"""{_NOISY}, sparse AS (
  SELECT doc_id, lang, CASE WHEN doc_id % 23 = 0 THEN NULL
                            WHEN doc_id % 19 = 0 THEN ' ' || chr(9) || '\u00a0'
                            WHEN doc_id % 11 = 0 THEN ' @u ab' ELSE text END AS text
  FROM noisy)"""

_MESSY = f"""{_HARM}, messy AS (
  SELECT doc_id, text, split,
         CASE WHEN doc_id % 17 = 0 THEN NULL
              WHEN doc_id % 13 = 0 THEN 'UNKNOWN'
              WHEN doc_id % 3 = 0 THEN upper(label)
              WHEN doc_id % 2 = 0 THEN ' ' || label || chr(9)
              ELSE label END AS label
  FROM harm)"""

_ID = {
    "harm": "CASE {0} WHEN 'hate' THEN 0 WHEN 'abusive' THEN 1 WHEN 'offensive' THEN 1 WHEN 'normal' THEN 2 END",
    "veracity": "CASE {0} WHEN 'fake' THEN 0 WHEN 'real' THEN 1 END",
}
_LABELS = {"harm": ("hate", "abusive", "normal"), "veracity": ("fake", "real")}
_SOURCE = {"harm": _HARM, "veracity": _VERACITY}
_TASK_NAME = {"harm": "hate_speech", "veracity": "fake_news"}


def _name(task: str, label_id: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(_LABELS[task]))
    return f"CASE {label_id} {cases} END"


def _clean(task: str) -> str:
    return f"""{_SOURCE[task]}, {task}_clean AS (
  SELECT * FROM (SELECT * REPLACE ({_normal()} AS text), CAST({_ID[task].format('label')} AS INTEGER) AS label_id
                 FROM {task}) WHERE length(text) > 2)"""


def _quota(task: str, name: str, source: str, size: str) -> str:
    """Largest remainder apportionment of ``size`` seats over the rows of ``source``."""
    return f"""{name} AS (
  SELECT label_id, n, n * k // total + CASE WHEN place <= k - given THEN 1 ELSE 0 END AS seats
  FROM (SELECT *, sum(n * k // total) OVER () AS given,
               row_number() OVER (ORDER BY (n * k) % total DESC, label_id) AS place
        FROM (SELECT *, {size} AS k FROM (
              SELECT label_id, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM {source}))))"""


def _split(task: str) -> str:
    return f"""{_clean(task)},
{task}_counts AS (SELECT label_id, count(*) AS n FROM {task}_clean GROUP BY label_id),
{_quota(task, f'{task}_test', f'{task}_counts', '(15 * total + 99) // 100')},
{task}_rest AS (SELECT label_id, n - seats AS n FROM {task}_test),
{_quota(task, f'{task}_val', f'{task}_rest', '(15 * total + 84) // 85')},
{task}_split AS (
  SELECT c.doc_id, c.text, c.label, c.label_id,
         CASE WHEN c.place <= t.seats THEN 'test' WHEN c.place <= t.seats + v.seats THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || doc_id)) AS place
        FROM {task}_clean) c
  JOIN {task}_test t ON c.label_id = t.label_id JOIN {task}_val v ON c.label_id = v.label_id)"""


def _counts(task: str) -> str:
    per_class = ", ".join(f"count(*) FILTER (label_id = {c}) AS n{c}" for c in range(len(_LABELS[task])))
    return f"""{_split(task)},
{task}_tokens AS (
  SELECT token, {per_class}, count(*) AS total
  FROM (SELECT label_id, unnest({_words()}) AS token FROM {task}_split WHERE split = 'train') GROUP BY token),
{task}_rows AS (SELECT {per_class}, count(*) AS total FROM {task}_split WHERE split = 'train')"""


def _log_weight(task: str, c: int, alpha: str = "1", where: str = "") -> str:
    totals = f"(SELECT sum(n{c}) + {alpha} * count(*) FROM {task}_tokens {where})"
    return f"(ln(n{c} + {alpha}) - ln({totals}))"


def _model(task: str) -> str:
    k = range(len(_LABELS[task]))
    weights = ", ".join(f"CAST(round({_log_weight(task, c)} * 1000000000) AS BIGINT) AS w{c}" for c in k)
    priors = ", ".join(f"CAST(round((ln(n{c}) - ln(total)) * 1000000000) AS BIGINT) AS b{c}" for c in k)
    return f"""{_counts(task)},
{task}_weights AS (SELECT token, total, {weights} FROM {task}_tokens),
{task}_prior AS (SELECT {priors} FROM {task}_rows)"""


def _argmax(names: list[str]) -> str:
    best = f"greatest({', '.join(names)})"
    return "CASE " + " ".join(f"WHEN {n} = {best} THEN {i}" for i, n in enumerate(names)) + " END"


def _scored(task: str, source: str, text: str) -> str:
    """Scores ``s<c>``, shares ``p<c>`` and the chosen ``pred`` for each row of ``source``."""
    k = range(len(_LABELS[task]))
    sums = ", ".join(f"CAST(coalesce(sum(w{c}), 0) AS BIGINT) AS q{c}" for c in k)
    scores = ", ".join(f"(q{c} + b{c}) / 1000000000.0::DOUBLE AS s{c}" for c in k)
    names = [f"s{c}" for c in k]
    exps = ", ".join(f"exp(s{c} - greatest({', '.join(names)})) AS e{c}" for c in k)
    total = " + ".join(f"e{c}" for c in k)
    return f"""{task}_summed AS (
  SELECT doc_id, {sums}
  FROM (SELECT doc_id, unnest({_words(text)}) AS token FROM {source}) LEFT JOIN {task}_weights USING (token)
  GROUP BY doc_id),
{task}_logs AS (
  SELECT doc_id, {scores}
  FROM (SELECT d.doc_id, {', '.join(f'coalesce(q{c}, 0) AS q{c}' for c in k)}
        FROM {source} d LEFT JOIN {task}_summed x ON d.doc_id = x.doc_id), {task}_prior),
{task}_scored AS (
  SELECT *, {', '.join(f'e{c} / ({total}) AS p{c}' for c in k)}, {_argmax(names)} AS pred
  FROM (SELECT *, {exps} FROM {task}_logs))"""


def _predictions(task: str) -> str:
    shares = ", ".join(f"round(p{c}, 4) AS p_{label}" for c, label in enumerate(_LABELS[task]))
    confidence = f"round(greatest({', '.join(f'p{c}' for c in range(len(_LABELS[task])))}), 4)"
    return f"""WITH {_model(task)}, {_scored(task, 'documents', _normal())}
SELECT doc_id, {_name(task, 'pred')} AS label, {confidence} AS confidence, {shares} FROM {task}_scored"""


def _candidates(task: str, grid: list[tuple[float, int]]) -> str:
    """Validation F1 of every (alpha, fewest occurrences) pair."""
    k = range(len(_LABELS[task]))
    grid_rows = ", ".join(f"({i + 1}, {a}::DOUBLE, {m})" for i, (a, m) in enumerate(grid))
    totals = ", ".join(f"sum(n{c}) FILTER (total >= min_count) AS t{c}" for c in k)
    weights = ", ".join(
        f"CAST(round((ln(n{c} + alpha) - ln(t{c} + alpha * size)) * 1000000000) AS BIGINT) AS w{c}" for c in k
    )
    sums = ", ".join(f"CAST(coalesce(sum(w{c}), 0) AS BIGINT) + any_value(b{c}) AS s{c}" for c in k)
    priors = ", ".join(f"CAST(round((ln(n{c}) - ln(total)) * 1000000000) AS BIGINT) AS b{c}" for c in k)

    def f1(c: int) -> str:
        return (
            f"coalesce(2 * count(*) FILTER (label_id = {c} AND pred = {c}) / nullif("
            f"count(*) FILTER (label_id = {c}) + count(*) FILTER (pred = {c}), 0), 0.0)"
        )

    metric = f1(1) if task == "veracity" else f"({' + '.join(f1(c) for c in k)}) / {len(k)}"
    return f"""{_counts(task)},
{task}_grid(candidate, alpha, min_count) AS (VALUES {grid_rows}),
{task}_sizes AS (
  SELECT candidate, alpha, min_count, count(*) FILTER (total >= min_count) AS size, {totals}
  FROM {task}_grid CROSS JOIN {task}_tokens GROUP BY ALL),
{task}_prior AS (SELECT {priors} FROM {task}_rows),
{task}_cand AS (
  SELECT candidate, token, {weights} FROM {task}_sizes JOIN {task}_tokens ON total >= min_count),
{task}_val_tokens AS (
  SELECT doc_id, label_id, unnest({_words()}) AS token FROM {task}_split WHERE split = 'val'),
{task}_val_sums AS (
  SELECT g.candidate, d.doc_id, d.label_id, {sums}
  FROM {task}_grid g CROSS JOIN (SELECT doc_id, label_id FROM {task}_split WHERE split = 'val') d
  CROSS JOIN {task}_prior
  LEFT JOIN {task}_val_tokens t ON t.doc_id = d.doc_id
  LEFT JOIN {task}_cand w ON w.token = t.token AND w.candidate = g.candidate
  GROUP BY g.candidate, d.doc_id, d.label_id),
{task}_f1 AS (
  SELECT candidate, {metric} AS f1
  FROM (SELECT *, {_argmax([f's{c}' for c in k])} AS pred FROM {task}_val_sums) GROUP BY candidate)"""


def _best(task: str, grid: list[tuple[float, int]]) -> str:
    return f"""{_candidates(task, grid)},
{task}_best AS (
  SELECT '{_TASK_NAME[task]}' AS task, CAST(candidate AS INTEGER) AS candidate, alpha,
         CAST(min_count AS INTEGER) AS min_count, round(f1, 4) AS f1,
         row_number() OVER (ORDER BY f1 DESC, candidate) = 1 AS is_best
  FROM {task}_f1 JOIN {task}_grid USING (candidate))"""


def _best_report(task: str) -> str:
    """CTEs that end in ``<task>_report``: the best candidate judged on the test part."""
    chosen = f"(SELECT candidate FROM {task}_best WHERE is_best)"
    weights = f"SELECT * FROM {task}_cand WHERE candidate = {chosen}"
    return f"""{_best(task, _GRID)},
{task}_weights AS ({weights}),
{task}_held AS (SELECT * FROM {task}_split WHERE split = 'test'),
{_scored(task, f'{task}_held', 'text')},
{task}_judged AS (
  SELECT h.label_id AS y_true, s.pred AS y_pred FROM {task}_held h JOIN {task}_scored s USING (doc_id)),
{_class_figures(task, f'{task}_judged', f'{task}_figures')},
{task}_report AS ({_report(_TASK_NAME[task], f'{task}_judged', f'{task}_figures')})"""


def _synthetic(task: str, mark: str, name: str = "judged") -> str:
    k = len(_LABELS[task])
    return f"""{name} AS (
  SELECT doc_id, label_id AS y_true,
         CASE WHEN substr(md5('{mark}:' || doc_id), 1, 1) < '4' THEN (label_id + 1) % {k} ELSE label_id END AS y_pred
  FROM (SELECT doc_id, {_ID[task].format('label')} AS label_id FROM {task}))"""


def _class_figures(task: str, source: str, name: str = "figures") -> str:
    ids = ", ".join(f"({c}, '{label}')" for c, label in enumerate(_LABELS[task]))
    return f"""{name} AS (
  SELECT label_id, label, support,
         coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
         coalesce(tp / nullif(support, 0), 0.0) AS recall,
         coalesce(2 * tp / nullif(support + predicted, 0), 0.0) AS f1
  FROM (SELECT i.label_id, i.label,
               count(*) FILTER (y_true = i.label_id) AS support,
               count(*) FILTER (y_pred = i.label_id) AS predicted,
               count(*) FILTER (y_true = i.label_id AND y_pred = i.label_id) AS tp
        FROM {source} CROSS JOIN (VALUES {ids}) i(label_id, label) GROUP BY i.label_id, i.label))"""


def _report(task_name: str, source: str, figures: str = "figures") -> str:
    return f"""SELECT '{task_name}' AS task,
       round((SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM {source}), 4) AS accuracy,
       round(avg(f1), 4) AS f1_macro, round(sum(f1 * support) / sum(support), 4) AS f1_weighted,
       round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall
FROM {figures}"""


def _train_evaluate(task: str) -> str:
    return f"""WITH {_model(task)}, held AS (SELECT * FROM {task}_split WHERE split = 'test'),
{_scored(task, 'held', 'text')},
judged AS (SELECT h.label_id AS y_true, s.pred AS y_pred FROM held h JOIN {task}_scored s USING (doc_id)),
{_class_figures(task, 'judged')}
{_report(_TASK_NAME[task], 'judged')}"""


def _attributed(source: str = "documents", before: str = "") -> str:
    return f"""WITH {_model('harm')}, {before}{_scored('harm', source, _normal())},
terms AS (
  SELECT doc_id, token, count(*) AS n
  FROM (SELECT doc_id, unnest({_words(_normal())}) AS token FROM {source}) GROUP BY doc_id, token),
logs AS (
  SELECT token, total / (SELECT total FROM harm_rows) AS mean_n,
         {', '.join(f'{_log_weight("harm", c)} AS l{c}' for c in range(3))}
  FROM harm_tokens),
attributed AS (
  SELECT *, weight * (n - mean_n) AS phi, sum(weight * (n - mean_n)) OVER (PARTITION BY doc_id) AS margin
  FROM (SELECT doc_id, token, n, mean_n, {_name('harm', 'pred')} AS label,
               round(greatest(p0, p1, p2), 4) AS confidence,
               CASE pred WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END - (l0 + l1 + l2) / 3 AS weight
        FROM terms JOIN logs USING (token) JOIN harm_scored USING (doc_id)))"""


_ATTRIBUTED = _attributed()


def _datasets() -> str:
    return f"""WITH {_HARM}, {_ROLES}, stacked AS (
  SELECT 'labelled_documents' AS dataset, text, label, split FROM harm
  UNION ALL SELECT 'conversation_roles', text, label, split FROM roles)"""


_FREQUENCIES = f"""{_datasets()},
lengths AS (SELECT dataset, length(text) AS len FROM stacked WHERE text IS NOT NULL)"""


def _text(source: str, name: str, expression: str) -> str:
    return f"WITH {source} SELECT doc_id, {expression} AS text FROM {name}"


_GRID = [(a, m) for a in (0.1, 0.5, 1.0, 2.0) for m in (1, 2)]
_SCHEDULE = [(a, 1) for a in (10.0, 5.0, 2.0, 1.0, 0.5, 0.1, 0.05, 0.01)]


def oracle_sql() -> dict[str, str]:
    harm_judged = f"WITH {_HARM}, {_synthetic('harm', 'p')}, {_class_figures('harm', 'judged')}"
    cells = """cells AS (
  SELECT t.label AS true_label, p.label AS pred_label,
         count(*) FILTER (y_true = t.label_id AND y_pred = p.label_id) AS n
  FROM judged CROSS JOIN figures t CROSS JOIN figures p GROUP BY t.label, p.label)"""
    sql: dict[str, str] = {}

    # Sources and sinks
    sql["ingest_union_splits"] = f"""WITH {_ROLES}
SELECT doc_id, text, CAST(NULL AS VARCHAR) AS label, 'train' AS split FROM documents
UNION ALL SELECT item_id, text, NULL, 'validation' FROM benchmark
UNION ALL SELECT doc_id, text, {_proper('label')}, 'test' FROM roles"""
    sql["ingest_harmonised"] = f"WITH {_ROLES} SELECT doc_id, text, label, split FROM roles"
    sql["csv_roundtrip"] = sql["ingest_harmonised"]
    sql["splits_roundtrip"] = f"""WITH {_split('harm')}
SELECT doc_id, text, label, label_id, split FROM harm_split"""
    sql["dataset_manifest"] = f"""WITH {_HARM}, {_ROLES}
SELECT 'labelled_documents' AS dataset, count(*) AS rows, 'doc_id,text,lang,label,split' AS column_names FROM harm
UNION ALL SELECT 'conversation_roles', count(*), 'doc_id,text,label,split' FROM roles"""

    # Profiling
    sql["dataset_summary"] = f"""WITH {_HARM}, {_ROLES}
SELECT 'labelled_documents' AS dataset, 'LOADED' AS status, count(*) AS rows,
       'doc_id,text,lang,label,split' AS column_names FROM harm
UNION ALL SELECT 'conversation_roles', 'LOADED', count(*), 'doc_id,text,label,split' FROM roles
UNION ALL SELECT 'amharic_documents', CASE WHEN count(*) > 0 THEN 'LOADED' ELSE 'NOT LOADED' END, count(*),
                 CASE WHEN count(*) > 0 THEN 'doc_id,text,lang' END FROM documents WHERE lang = 'am'"""
    sql["label_distribution"] = f"""{_datasets()}
SELECT dataset, label, n, round(n / sum(n) OVER (PARTITION BY dataset) * 100, 1) AS pct
FROM (SELECT dataset, label, count(*) AS n FROM stacked GROUP BY dataset, label)"""
    sql["split_distribution"] = f"{_datasets()} SELECT dataset, split, count(*) AS n FROM stacked GROUP BY dataset, split"
    sql["split_label_report"] = f"""WITH {_split('harm')}, {_split('veracity')}
SELECT 'hate_speech' AS task, split, label_id, {_name('harm', 'label_id')} AS label, count(*) AS n
FROM harm_split GROUP BY split, label_id
UNION ALL SELECT 'fake_news', split, label_id, {_name('veracity', 'label_id')}, count(*)
FROM veracity_split GROUP BY split, label_id"""
    sql["text_length"] = f"WITH {_SPARSE} SELECT doc_id, length(text) AS length FROM sparse WHERE text IS NOT NULL"
    sql["text_length_histogram"] = f"""{_FREQUENCIES},
ends AS (SELECT dataset, CAST(min(len) AS DOUBLE) AS lo, CAST(max(len) AS DOUBLE) AS hi FROM lengths GROUP BY dataset),
placed AS (
  SELECT dataset, least(CAST(floor(40 * (len - lo) / (hi - lo)) AS INTEGER) + 1, 40) AS bin, count(*) AS n
  FROM lengths JOIN ends USING (dataset) GROUP BY 1, 2)
SELECT e.dataset, CAST(b.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 40.0::DOUBLE * (b.bin - 1), 4) AS lower,
       round(lo + (hi - lo) / 40.0::DOUBLE * b.bin, 4) AS upper, coalesce(p.n, 0) AS n
FROM ends e CROSS JOIN (SELECT unnest(range(1, 41)) AS bin) b
LEFT JOIN placed p ON p.dataset = e.dataset AND p.bin = b.bin"""
    sql["text_length_median"] = f"""{_FREQUENCIES}
SELECT dataset, count(*) AS n, median(len) AS median_length FROM lengths GROUP BY dataset"""
    sql["text_length_sketch"] = f"{_FREQUENCIES} SELECT dataset, count(*) AS n, true AS within_bound FROM lengths GROUP BY dataset"
    sql["sample_per_class"] = f"""WITH {_HARM}
SELECT label, CAST(place AS INTEGER) AS rank, doc_id, substr(text, 1, 120) AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS place FROM harm
      WHERE text IS NOT NULL) WHERE place <= 2"""
    only = "regexp_replace(text, '[^\\x{1200}-\\x{137F}]', '', 'g')"
    sql["script_coverage"] = f"""WITH {_SPARSE}, letters AS (SELECT lang, text, {only} AS ethiopic FROM sparse WHERE text IS NOT NULL),
marks AS (SELECT lang, unnest(regexp_extract_all(ethiopic, '.')) AS mark FROM letters)
SELECT l.lang, count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       CAST(sum(length(ethiopic)) AS BIGINT) AS n_ethiopic,
       round(sum(length(ethiopic)) / sum(length(text)), 6) AS coverage,
       coalesce(any_value(d.k), 0) AS distinct_ethiopic
FROM letters l LEFT JOIN (SELECT lang, count(DISTINCT mark) AS k FROM marks GROUP BY lang) d ON d.lang = l.lang
GROUP BY l.lang"""
    sql["normalise_preview"] = f"""WITH {_NOISY}
SELECT doc_id, text, {_normal()} AS normalised, text <> {_normal()} AS changed FROM noisy"""

    # Normalisation
    sql["normalise_null"] = _text(_SPARSE, "sparse", "coalesce(text, '')")
    sql["normalise_nfc"] = _text(_NOISY, "noisy", "nfc_normalize(text)")
    for step, name in enumerate(
        ["strip_urls", "strip_mentions", "unwrap_hashtags", "strip_emoji", "collapse_punct", "collapse_ws"]
    ):
        replaced = _replace("text", step)
        sql[name] = _text(_NOISY, "noisy", f"trim({replaced})" if name == "collapse_ws" else replaced)
    sql["normalise_text"] = _text(_SPARSE, "sparse", _normal())
    sql["unify_equivalents"] = _text(
        _NOISY, "noisy", "replace(replace(replace(text, '\u1215', '\u1200'), '\u1206', '\u1200'), '\u1a00', '\u12a0')"
    )
    sql["strip_emoji_strict"] = _text(_NOISY, "noisy", f"regexp_replace(text, '{_STRICT_EMOJI}', ' ', 'g')")
    sql["normalise_text_strict"] = _text(_SPARSE, "sparse", _normal(strict=True))
    sql["drop_near_empty"] = f"""WITH {_SPARSE}
SELECT * FROM (SELECT doc_id, {_normal()} AS text FROM sparse) WHERE length(text) > 2"""

    # Labels
    encoded = _ID["harm"].format(f"regexp_replace(lower(label), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')")
    sql["project_clean"] = f"""WITH {_MESSY}
SELECT doc_id, text, label, split FROM messy WHERE text IS NOT NULL AND label IS NOT NULL"""
    sql["encode_labels"] = f"""WITH {_MESSY}
SELECT * FROM (SELECT doc_id, label, CAST({encoded} AS INTEGER) AS label_id FROM messy) WHERE label_id IS NOT NULL"""
    sql["unknown_labels"] = f"""WITH {_MESSY}, ids AS (SELECT {encoded} AS label_id FROM messy)
SELECT count(*) AS n_rows, count(label_id) AS n_known, count(*) - count(label_id) AS n_unknown FROM ids"""
    sql["preprocess_report"] = f"""WITH {_MESSY}, {_SPARSE}, dirty AS (
  SELECT s.doc_id, {_normal('s.text')} AS text, s.text IS NULL OR m.label IS NULL AS missing, {encoded.replace('(label)', '(m.label)')} AS label_id
  FROM sparse s JOIN messy m ON s.doc_id = m.doc_id)
SELECT count(*) AS n_rows, count(*) FILTER (missing) AS n_missing, count(*) FILTER (NOT missing AND label_id IS NULL) AS n_unknown,
       count(*) FILTER (NOT missing AND label_id IS NOT NULL AND length(text) <= 2) AS n_near_empty,
       count(*) FILTER (NOT missing AND label_id IS NOT NULL AND length(text) > 2) AS n_kept FROM dirty"""
    sql["encode_label_table"] = f"""WITH spellings AS (
  SELECT DISTINCT unnest({_words()}) AS label FROM conversations),
numbered AS (SELECT label, ('0x' || md5(label)[1:7])::INTEGER AS label_id FROM spellings),
words AS (SELECT doc_id, unnest({_words()}) AS label FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(label_id) AS BIGINT) AS label_ids FROM words JOIN numbered USING (label) GROUP BY doc_id"""
    sql["harmonise_labels"] = f"""{_datasets()}
SELECT dataset, label_id, {_name('harm', 'label_id')} AS label, count(*) AS n
FROM (SELECT dataset, CAST({_ID['harm'].format('label')} AS INTEGER) AS label_id FROM stacked)
GROUP BY dataset, label_id"""

    # Splits
    sql["stratified_split"] = f"WITH {_split('harm')} SELECT doc_id, label_id, split FROM harm_split"
    sql["predefined_split"] = f"""WITH {_clean('harm')}
SELECT doc_id, label_id, CASE split WHEN 'validation' THEN 'val' ELSE split END AS split FROM harm_clean"""
    sql["carve_validation"] = f"""WITH {_clean('harm')},
pool AS (SELECT * FROM harm_clean WHERE split <> 'test'),
pool_counts AS (SELECT label_id, count(*) AS n FROM pool GROUP BY label_id),
{_quota('harm', 'pool_val', 'pool_counts', '(15 * total + 99) // 100')}
SELECT doc_id, label_id, 'test' AS split FROM harm_clean WHERE split = 'test'
UNION ALL
SELECT p.doc_id, p.label_id, CASE WHEN p.place <= v.seats THEN 'val' ELSE 'train' END
FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || doc_id)) AS place FROM pool) p
JOIN pool_val v USING (label_id)"""
    sql["split_disjoint"] = f"""WITH {_split('harm')}
SELECT count(*) AS n_keys, count(*) FILTER (k > 1) AS n_overlapping
FROM (SELECT doc_id, count(DISTINCT split) AS k FROM harm_split GROUP BY doc_id)"""

    sql["split_leakage"] = f"""WITH {_split('harm')}
SELECT count(*) AS n_texts, count(*) FILTER (k > 1) AS n_shared,
       CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS n_rows_shared
FROM (SELECT text, count(DISTINCT split) AS k, count(*) AS n FROM harm_split GROUP BY text)"""

    # Tokens
    numbered = "SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos"
    sql["tokenise"] = f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, token
FROM ({numbered} FROM (SELECT doc_id, {_words(_normal())} AS w FROM documents))"""
    sql["pad_and_mask"] = f"""SELECT doc_id,
       array_to_string(list_concat(w[1:128], list_transform(range(greatest(0, 128 - len(w))), lambda x: '[PAD]')), ' ') AS tokens,
       repeat('1', least(len(w), 128)) || repeat('0', greatest(0, 128 - len(w))) AS attention_mask
FROM (SELECT doc_id, {_words(_normal())} AS w FROM documents)"""
    sql["vocab_encode"] = f"""WITH {_split('veracity')},
ids AS (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id
  FROM (SELECT unnest({_words()}) AS token FROM veracity_split WHERE split = 'train') GROUP BY token),
cut AS (SELECT doc_id, {_words()}[1:256] AS w FROM veracity_split),
coded AS (
  SELECT doc_id, string_agg(CAST(coalesce(id, 0) AS VARCHAR), ',' ORDER BY pos) AS listed
  FROM ({numbered} FROM cut) LEFT JOIN ids USING (token) GROUP BY doc_id)
SELECT doc_id,
       array_to_string(list_concat(CASE WHEN len(w) = 0 THEN [] ELSE string_split(listed, ',') END,
                                   list_transform(range(256 - len(w)), lambda x: '0')), ',') AS input_ids,
       repeat('1', len(w)) || repeat('0', 256 - len(w)) AS attention_mask
FROM cut LEFT JOIN coded USING (doc_id)"""
    sql["term_frequencies"] = f"""SELECT doc_id, token, count(*) AS n
FROM (SELECT doc_id, unnest({_words(_normal())}) AS token FROM documents) GROUP BY doc_id, token"""

    # Training
    for task in ("harm", "veracity"):
        columns = ", ".join(f"round(w{c} / 1000000000.0::DOUBLE, 4) AS w_{n}" for c, n in enumerate(_LABELS[task]))
        sql[f"nb_train_{task}"] = f"WITH {_model(task)} SELECT token, total AS n, {columns} FROM {task}_weights"
        sql[f"predict_{task}"] = _predictions(task)
        sql[f"{task}_train_evaluate"] = _train_evaluate(task)
    sql["select_best_candidate"] = f"""WITH {_best('harm', _GRID)}, {_best('veracity', _GRID)}
SELECT * FROM harm_best UNION ALL SELECT * FROM veracity_best"""
    sql["best_model_evaluate"] = f"""WITH {_best_report('harm')}, {_best_report('veracity')}
SELECT * FROM harm_report UNION ALL SELECT * FROM veracity_report"""
    sql["early_stopping"] = f"""WITH {_candidates('harm', _SCHEDULE)}, {_candidates('veracity', _SCHEDULE)},
history AS (
  SELECT 'hate_speech' AS task, candidate AS step, f1 FROM harm_f1
  UNION ALL SELECT 'fake_news', candidate, f1 FROM veracity_f1),
climbs AS (
  SELECT *, coalesce(f1 > max(f1) OVER (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up
  FROM history),
waits AS (SELECT *, step - max(CASE WHEN up THEN step END) OVER (PARTITION BY task ORDER BY step) AS waited FROM climbs),
stops AS (SELECT task, min(step) FILTER (waited >= 2) AS stop_step FROM waits GROUP BY task),
keeps AS (
  SELECT c.task, max(c.step) AS kept_step FROM climbs c JOIN stops s ON c.task = s.task
  WHERE c.up AND (s.stop_step IS NULL OR c.step <= s.stop_step) GROUP BY c.task)
SELECT h.task, CAST(h.step AS INTEGER) AS step, round(h.f1, 4) AS f1,
       round(max(h.f1) OVER (PARTITION BY h.task ORDER BY h.step), 4) AS best_so_far,
       CAST(s.stop_step AS INTEGER) AS stop_step, h.step = k.kept_step AS kept
FROM history h JOIN stops s ON h.task = s.task JOIN keeps k ON h.task = k.task"""

    # Prediction
    scored = f"WITH {_model('harm')}, {_scored('harm', 'documents', _normal())}"
    logs = ", ".join(f"round(s{c}, 4) AS score_{n}" for c, n in enumerate(_LABELS["harm"]))
    shares = ", ".join(f"round(p{c}, 4) AS p_{n}" for c, n in enumerate(_LABELS["harm"]))
    sql["softmax_scores"] = f"{scored} SELECT doc_id, {logs}, {shares} FROM harm_scored"
    sql["predict_label"] = f"{scored} SELECT doc_id, CAST(pred AS INTEGER) AS label_id, {_name('harm', 'pred')} AS label FROM harm_scored"
    sql["stream_score"] = sql["predict_harm"]
    sql["lr_train_score"] = f"""WITH {_split('harm')}
SELECT doc_id, 3 AS n_scores, true AS confidence_is_highest, true AS sums_to_one, true AS label_has_it FROM harm_split WHERE split = 'test'"""
    sql["linear_roundtrip"] = f"""WITH {_split('harm')}
SELECT doc_id, true AS same, 'test_accuracy,test_f1_macro,val_accuracy,val_f1_macro' AS metrics, true AS metrics_kept, 42 AS seed,
       (SELECT count(*) FROM harm_split WHERE split = 'train') AS train_rows FROM harm_split"""
    sql["score_breakdown"] = f"""{scored}, long AS (
  SELECT doc_id, unnest(['hate', 'abusive', 'normal']) AS label, unnest([round(p0, 4), round(p1, 4), round(p2, 4)]) AS score
  FROM harm_scored)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS INTEGER) AS rank, label, score FROM long"""
    blank = f"NOT regexp_matches(coalesce(text, ''), '[^{_BLANK}]')"
    sql["predict_status"] = f"""WITH {_model('harm')}, {_SPARSE}, {_scored('harm', 'sparse', _normal())}
SELECT s.doc_id, CASE WHEN {blank} THEN 'empty_input' ELSE 'ok' END AS status,
       CASE WHEN NOT ({blank}) THEN {_name('harm', 'pred')} END AS label,
       CASE WHEN NOT ({blank}) THEN round(greatest(p0, p1, p2), 4) END AS confidence
FROM sparse s JOIN harm_scored USING (doc_id)"""
    sql["predict_repeated_keys"] = f"""WITH {_model('harm')}, {_scored('harm', 'documents', _normal())},
repeated AS (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 7 = 0)
SELECT CASE WHEN doc_id % 11 <> 0 THEN doc_id END AS doc_id, 'ok' AS status,
       {_name('harm', 'pred')} AS label, round(greatest(p0, p1, p2), 4) AS confidence
FROM repeated JOIN harm_scored USING (doc_id)"""
    given = f"CASE WHEN NOT ({blank}) THEN"
    sql["predict_combined"] = f"""WITH {_model('harm')}, {_model('veracity')}, {_SPARSE},
{_scored('harm', 'sparse', _normal())}, {_scored('veracity', 'sparse', _normal())}
SELECT h.doc_id, CASE WHEN {blank} THEN 'empty_input' ELSE 'ok' END AS status,
       {given} {_name('harm', 'h.pred')} END AS label_hate_speech, {given} round(greatest(h.p0, h.p1, h.p2), 4) END AS confidence_hate_speech,
       {given} {_name('veracity', 'v.pred')} END AS label_fake_news, {given} round(greatest(v.p0, v.p1), 4) END AS confidence_fake_news
FROM harm_scored h JOIN veracity_scored v ON h.doc_id = v.doc_id JOIN sparse s ON s.doc_id = h.doc_id"""

    # Evaluation
    sql["eval_accuracy"] = f"""WITH {_HARM}, {_synthetic('harm', 'p')}
SELECT count(*) AS n, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM judged"""
    sql["eval_full_report"] = f"{harm_judged} {_report('hate_speech', 'judged')}"
    sql["eval_class_report"] = f"""{harm_judged},
overall AS (SELECT count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM judged)
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM figures
UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 4), n FROM overall
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM figures
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
                 round(sum(f1 * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM figures"""
    sql["confusion_matrix"] = f"{harm_judged}, {cells} SELECT true_label, pred_label, n FROM cells"
    sql["confusion_matrix_normalised"] = f"""{harm_judged}, {cells}
SELECT true_label, pred_label, round(n / nullif(sum(n) OVER (PARTITION BY true_label), 0), 4) AS share FROM cells"""
    sql["compare_models"] = f"""WITH {_HARM}, {_synthetic('harm', 'p', 'judged_p')}, {_synthetic('harm', 'q', 'judged_q')},
{_class_figures('harm', 'judged_p', 'figures_p')}, {_class_figures('harm', 'judged_q', 'figures_q')},
reports AS ({_report('model_p', 'judged_p', 'figures_p')} UNION ALL {_report('model_q', 'judged_q', 'figures_q')})
SELECT *, CAST(row_number() OVER (ORDER BY f1_macro DESC, task) AS INTEGER) AS rank FROM reports"""
    sql["eval_f1_binary"] = f"""WITH {_VERACITY}, {_synthetic('veracity', 'p')}, {_class_figures('veracity', 'judged')}
SELECT label_id AS pos_label, round(f1, 4) AS f1_binary FROM figures"""
    sql["eval_from_scores"] = f"""WITH {_model('harm')}, held AS (SELECT * FROM harm_split WHERE split = 'val'),
{_scored('harm', 'held', 'text')},
judged AS (SELECT h.label_id AS y_true, s.pred AS y_pred FROM held h JOIN harm_scored s USING (doc_id)),
{_class_figures('harm', 'judged')}
SELECT f1_macro, accuracy FROM ({_report('hate_speech', 'judged')})"""

    sql["model_roundtrip"] = f"""SELECT p.*, 1::BIGINT AS version, 1.0::DOUBLE AS alpha, 42 AS seed, e.f1_macro AS val_f1_macro, e.accuracy AS val_accuracy
FROM ({sql['predict_harm']}) p, ({sql['eval_from_scores']}) e"""

    # Explanation
    sql["attribute_tokens"] = f"""{_ATTRIBUTED}
SELECT doc_id, token, n, label, round(phi, 4) AS phi, round(margin, 4) AS margin FROM attributed"""
    sql["top_tokens"] = f"""{_ATTRIBUTED}, sided AS (
  SELECT *, CASE WHEN phi > 0 THEN 'top' ELSE 'bottom' END AS side FROM attributed WHERE round(phi, 8) <> 0)
SELECT doc_id, label, confidence, side, CAST(place AS INTEGER) AS rank, token, round(phi, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY round(abs(phi), 8) DESC, token) AS place FROM sided)
WHERE place <= 10"""
    sql["explanation_records"] = f"""{_attributed('sparse', _SPARSE + ', ')}, sided AS (
  SELECT *, CASE WHEN phi > 0 THEN 'top' ELSE 'bottom' END AS side FROM attributed WHERE round(phi, 8) <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY round(abs(phi), 8) DESC, token) AS place FROM sided),
listed AS (
  SELECT doc_id, string_agg(token, ' ' ORDER BY place) FILTER (side = 'top') AS top_tokens,
         string_agg(token, ' ' ORDER BY place) FILTER (side = 'bottom') AS bottom_tokens
  FROM placed WHERE place <= 10 GROUP BY doc_id)
SELECT s.doc_id, {_name('harm', 's.pred')} AS label, round(greatest(s.p0, s.p1, s.p2), 4) AS confidence,
       coalesce(l.top_tokens, '') AS top_tokens, coalesce(l.bottom_tokens, '') AS bottom_tokens
FROM harm_scored s LEFT JOIN listed l ON s.doc_id = l.doc_id"""
    sql["token_importance"] = f"""{_ATTRIBUTED}
SELECT doc_id, label, token,
       round(abs(weight) / coalesce(nullif(max(abs(weight)) OVER (PARTITION BY doc_id), 0), 1), 4) AS score
FROM attributed"""
    sql["attribution_plot_data"] = f"""{_ATTRIBUTED}
SELECT doc_id, CAST(place AS INTEGER) AS rank, token, round(phi, 4) AS score,
       CASE WHEN phi > 0 THEN 'increases' ELSE 'decreases' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(phi), 8) DESC, token) AS place FROM attributed)
WHERE place <= 15"""
    return sql


def _proper(label: str) -> str:
    return f"upper({label}[1]) || {label}[2:]"
