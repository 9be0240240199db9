"""DuckDB oracle: the same definitions written independently in SQL.

Each entry of ``oracle_sql()`` runs on the pre-registered views (documents,
labels, embeddings...) and returns the same columns as the Spark query of the
same name.  Counts are BIGINT, ids INTEGER, ratios rounded to 6 digits, log
scores integer micro-nats.
"""

from __future__ import annotations

# pandas' default null strings, and the separator between language and text.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
SEPARATOR = " </s> "

NA = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
SEP = SEPARATOR.replace("'", "''")
SEED = "42"
TEST_SIZE = 0.2
N_FOLDS = 5
MAX_TOKENS = 512
ALPHAS = (1, 2, 5)
# log prior of a class without a training row: predicted only if no other class exists
NO_ROWS = "CAST(-1000000000000000 AS BIGINT)"
WORDS_RE = r"'[ \t\r\n]+'"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes if c.strip())


CORPUS = f"""
corpus AS (
  SELECT d.doc_id, d.text,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
         d.lang AS language
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.text IS NOT NULL AND d.text NOT IN ({NA}) AND d.lang IS NOT NULL AND d.lang NOT IN ({NA})
),
labels_k AS (
  SELECT label AS cls, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT label FROM corpus)
),
langs_k AS (
  SELECT language AS cls, CAST(row_number() OVER (ORDER BY language) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT language FROM corpus)
)"""


def split_ctes(name: str = "assign", cls_col: str = "label", src: str = "corpus") -> str:
    return f"""
{name}_cls AS (SELECT {cls_col} AS cls, count(*) AS n FROM {src} GROUP BY {cls_col}),
{name}_tot AS (
  SELECT sum(n) AS n_all, sum(n) - CAST(ceil(CAST({TEST_SIZE} AS DOUBLE) * sum(n)) AS BIGINT) AS n_train
  FROM {name}_cls
),
{name}_q0 AS (
  SELECT c.cls, c.n, (CAST(c.n AS HUGEINT) * t.n_train) // t.n_all AS fl, (CAST(c.n AS HUGEINT) * t.n_train) % t.n_all AS rem, t.n_train,
         coalesce(sum(c.n) OVER (ORDER BY c.cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM {name}_cls c, {name}_tot t
),
{name}_q1 AS (
  SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, cls) AS ord FROM {name}_q0
),
{name}_quota AS (SELECT cls, fl + CASE WHEN ord <= need THEN 1 ELSE 0 END AS quota, off FROM {name}_q1),
{name}_rk AS (
  SELECT doc_id, {cls_col} AS cls,
         row_number() OVER (PARTITION BY {cls_col}
                            ORDER BY md5('{SEED}' || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS rk
  FROM {src}
),
{name} AS (
  SELECT r.doc_id, CASE WHEN r.rk <= q.quota THEN 'train' ELSE 'test' END AS split,
         CAST((q.off + r.rk - 1) % {N_FOLDS} AS INTEGER) AS fold
  FROM {name}_rk r JOIN {name}_quota q ON r.cls = q.cls
)"""


def gram_ctes(name: str, src: str) -> str:
    """(doc_id, gram, n) of every document of ``src`` (doc_id, text)."""
    return f"""
{name}_w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), {WORDS_RE})) AS w FROM {src}),
{name}_p AS (SELECT doc_id, '<' || w || '>' AS pw, unnest(range(1, length(w) + 1)) AS i FROM {name}_w WHERE w <> ''),
{name} AS (
  SELECT doc_id, substring(pw, i, 3) AS gram, CAST(count(*) AS BIGINT) AS n
  FROM {name}_p GROUP BY doc_id, substring(pw, i, 3)
)"""


BASE = _with(CORPUS, split_ctes(), gram_ctes("feats", "corpus"), """
docs AS (SELECT c.doc_id, c.label, c.language, a.split, a.fold FROM corpus c JOIN assign a USING (doc_id)),
fa AS (SELECT f.doc_id, f.gram, f.n, d.label, d.language, d.split, d.fold FROM feats f JOIN docs d USING (doc_id)),
train AS (SELECT * FROM fa WHERE split = 'train'),
test AS (SELECT * FROM fa WHERE split = 'test'),
train_docs AS (SELECT * FROM docs WHERE split = 'train'),
test_docs AS (SELECT * FROM docs WHERE split = 'test')""")


def nb_ctes(name: str, train: str, train_docs: str, class_col: str, keys: list[str], classes: str,
            alpha=1) -> str:
    """Fitted table ``name(keys..., cls, s)`` and ``name_prior(cls, p)``."""
    k = ", ".join(keys)
    on = " AND ".join(f"c.{x} = g.{x}" for x in keys)
    gk = ", ".join(f"g.{x}" for x in keys)
    return f"""
{name}_cnt AS (SELECT {k}, {class_col} AS cls, sum(n) AS c FROM {train} GROUP BY {k}, {class_col}),
{name}_keys AS (SELECT DISTINCT {k} FROM {name}_cnt),
{name}_v AS (SELECT count(*) AS v FROM {name}_keys),
{name}_nk AS (
  SELECT k.cls, coalesce(sum(c.c), 0) AS nk FROM {classes} k LEFT JOIN {name}_cnt c ON c.cls = k.cls GROUP BY k.cls
),
{name} AS (
  SELECT {gk}, k.cls,
         CAST(round(ln(CAST(coalesce(c.c, 0) + {alpha} AS DOUBLE) / CAST(k.nk + {alpha} * v.v AS DOUBLE)) * 1e6)
              AS BIGINT) AS s
  FROM {name}_keys g CROSS JOIN {name}_nk k CROSS JOIN {name}_v v
  LEFT JOIN {name}_cnt c ON {on} AND c.cls = k.cls
),
{name}_prior AS (
  SELECT k.cls,
         CASE WHEN coalesce(d.cnt, 0) = 0 THEN {NO_ROWS}
              ELSE CAST(round(ln(CAST(d.cnt AS DOUBLE) / CAST(t.tot AS DOUBLE)) * 1e6) AS BIGINT) END AS p
  FROM {classes} k
  LEFT JOIN (SELECT {class_col} AS cls, count(*) AS cnt FROM {train_docs} GROUP BY {class_col}) d ON d.cls = k.cls
  CROSS JOIN (SELECT count(*) AS tot FROM {train_docs}) t
)"""


def score_ctes(name: str, model: str, feats: str, docs: str, classes: str, keys: list[str]) -> str:
    """``name(doc_id, cls, idx, score)`` and ``name_pred(doc_id, pred, pred_id)`` (first maximum)."""
    on = " AND ".join(f"m.{x} = f.{x}" for x in keys)
    return f"""
{name}_e AS (SELECT f.doc_id, m.cls, sum(f.n * m.s) AS e FROM {feats} f JOIN {model} m ON {on} GROUP BY f.doc_id, m.cls),
{name} AS (
  SELECT d.doc_id, k.cls, k.idx, CAST(p.p + coalesce(e.e, 0) AS BIGINT) AS score
  FROM (SELECT DISTINCT doc_id FROM {docs}) d CROSS JOIN {classes} k
  JOIN {model}_prior p ON p.cls = k.cls
  LEFT JOIN {name}_e e ON e.doc_id = d.doc_id AND e.cls = k.cls
),
{name}_pred AS (
  SELECT doc_id, cls AS pred, idx AS pred_id FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r FROM {name}) WHERE r = 1
)"""


LANG_MODEL = nb_ctes("lm", "train", "train_docs", "language", ["gram"], "langs_k")
SENT_MODEL = nb_ctes("sm", "train", "train_docs", "label", ["language", "gram"], "labels_k")
BASE_MODEL = nb_ctes("bm", "train", "train_docs", "label", ["gram"], "labels_k")

CASCADE = ",\n".join([
    LANG_MODEL, SENT_MODEL,
    score_ctes("ls", "lm", "test", "test_docs", "langs_k", ["gram"]),
    """stage2 AS (SELECT t.doc_id, t.gram, t.n, p.pred AS language FROM test t JOIN ls_pred p USING (doc_id))""",
    score_ctes("ss", "sm", "stage2", "test_docs", "labels_k", ["language", "gram"]),
    """ev AS (
  SELECT d.doc_id, d.language, lp.pred AS predicted_language, d.label, sp.pred AS predicted_label,
         lk.idx AS language_id, lp.pred_id AS predicted_language_id, sk.idx AS label_id, sp.pred_id AS predicted_label_id
  FROM test_docs d JOIN ls_pred lp USING (doc_id) JOIN ss_pred sp USING (doc_id)
  JOIN langs_k lk ON lk.cls = d.language JOIN labels_k sk ON sk.cls = d.label
)"""])

BASELINE = ",\n".join([
    BASE_MODEL,
    score_ctes("bs", "bm", "test", "test_docs", "labels_k", ["gram"]),
    """bev AS (
  SELECT d.doc_id, d.label, bp.pred AS predicted_label, sk.idx AS label_id, bp.pred_id AS predicted_label_id
  FROM test_docs d JOIN bs_pred bp USING (doc_id) JOIN labels_k sk ON sk.cls = d.label
)"""])


def fold_nb_ctes(name: str, class_col: str, keys: list[str], classes: str) -> str:
    """Model of fold tf fitted on all other folds: ``name(tf, keys..., cls, s)``, ``name_prior(tf, cls, p)``."""
    k = ", ".join(keys)
    ck = ", ".join(f"c.{x}" for x in keys)
    on = " AND ".join(f"c.{x} = g.{x}" for x in keys)
    gk = ", ".join(f"g.{x}" for x in keys)
    return f"""
{name}_fc AS (SELECT {k}, fold, {class_col} AS cls, sum(n) AS c FROM fa GROUP BY {k}, fold, {class_col}),
{name}_folds AS (SELECT DISTINCT fold AS tf FROM docs),
{name}_cnt AS (
  SELECT t.tf, {ck}, c.cls, sum(c.c) AS c FROM {name}_fc c JOIN {name}_folds t ON c.fold <> t.tf
  GROUP BY t.tf, {ck}, c.cls
),
{name}_keys AS (SELECT DISTINCT tf, {k} FROM {name}_cnt),
{name}_v AS (SELECT tf, count(*) AS v FROM {name}_keys GROUP BY tf),
{name}_nk AS (
  SELECT t.tf, k.cls, coalesce(sum(c.c), 0) AS nk
  FROM {name}_folds t CROSS JOIN {classes} k LEFT JOIN {name}_cnt c ON c.tf = t.tf AND c.cls = k.cls
  GROUP BY t.tf, k.cls
),
{name} AS (
  SELECT g.tf, {gk}, k.cls,
         CAST(round(ln(CAST(coalesce(c.c, 0) + 1 AS DOUBLE) / CAST(k.nk + v.v AS DOUBLE)) * 1e6) AS BIGINT) AS s
  FROM {name}_keys g JOIN {name}_nk k ON k.tf = g.tf JOIN {name}_v v ON v.tf = g.tf
  LEFT JOIN {name}_cnt c ON c.tf = g.tf AND {on} AND c.cls = k.cls
),
{name}_dc AS (
  SELECT t.tf, d.{class_col} AS cls, count(*) AS cnt FROM docs d JOIN {name}_folds t ON d.fold <> t.tf
  GROUP BY t.tf, d.{class_col}
),
{name}_prior AS (
  SELECT t.tf, k.cls,
         CASE WHEN coalesce(d.cnt, 0) = 0 THEN {NO_ROWS}
              ELSE CAST(round(ln(CAST(d.cnt AS DOUBLE) / CAST(tt.tot AS DOUBLE)) * 1e6) AS BIGINT) END AS p
  FROM {name}_folds t CROSS JOIN {classes} k
  LEFT JOIN {name}_dc d ON d.tf = t.tf AND d.cls = k.cls
  JOIN (SELECT tf, sum(cnt) AS tot FROM {name}_dc GROUP BY tf) tt ON tt.tf = t.tf
)"""


def fold_score_ctes(name: str, model: str, feats: str, classes: str, keys: list[str]) -> str:
    on = " AND ".join(f"m.{x} = f.{x}" for x in keys)
    return f"""
{name}_e AS (
  SELECT f.doc_id, m.cls, sum(f.n * m.s) AS e FROM {feats} f JOIN {model} m ON m.tf = f.fold AND {on}
  GROUP BY f.doc_id, m.cls
),
{name} AS (
  SELECT d.doc_id, k.cls, k.idx, CAST(p.p + coalesce(e.e, 0) AS BIGINT) AS score
  FROM docs d CROSS JOIN {classes} k
  JOIN {model}_prior p ON p.tf = d.fold AND p.cls = k.cls
  LEFT JOIN {name}_e e ON e.doc_id = d.doc_id AND e.cls = k.cls
),
{name}_pred AS (
  SELECT doc_id, cls AS pred, idx AS pred_id FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r FROM {name}) WHERE r = 1
)"""


CV_BASE = ",\n".join([
    fold_nb_ctes("fb", "label", ["gram"], "labels_k"),
    fold_score_ctes("cb", "fb", "fa", "labels_k", ["gram"]),
    """cvb AS (
  SELECT d.doc_id, d.fold, d.label, p.pred AS predicted_label, k.idx AS label_id, p.pred_id AS predicted_label_id
  FROM docs d JOIN cb_pred p USING (doc_id) JOIN labels_k k ON k.cls = d.label
)"""])

CV_CASCADE = ",\n".join([
    fold_nb_ctes("fl", "language", ["gram"], "langs_k"),
    fold_nb_ctes("fs", "label", ["language", "gram"], "labels_k"),
    fold_score_ctes("cl", "fl", "fa", "langs_k", ["gram"]),
    """cstage2 AS (SELECT f.doc_id, f.fold, f.gram, f.n, p.pred AS language FROM fa f JOIN cl_pred p USING (doc_id))""",
    fold_score_ctes("cs", "fs", "cstage2", "labels_k", ["language", "gram"]),
    """cvc AS (
  SELECT d.doc_id, d.fold, d.language, lp.pred AS predicted_language, d.label, sp.pred AS predicted_label
  FROM docs d JOIN cl_pred lp USING (doc_id) JOIN cs_pred sp USING (doc_id)
)"""])


def metric_ctes(name: str, src: str, y: str, yhat: str, by: list[str] = ()) -> str:
    b = "".join(f"{x}, " for x in by)
    return f"""
{name}_conf AS (SELECT {b}{y} AS y, {yhat} AS yhat, count(*) AS n FROM {src} GROUP BY {b}{y}, {yhat}),
{name}_cc AS (
  SELECT {b}y AS class, sum(CASE WHEN y = yhat THEN n ELSE 0 END) AS tp, sum(n) AS support, 0 AS predicted
  FROM {name}_conf GROUP BY {b}y
  UNION ALL
  SELECT {b}yhat AS class, 0 AS tp, 0 AS support, sum(n) AS predicted FROM {name}_conf GROUP BY {b}yhat
),
{name}_per AS (
  SELECT {b}class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted
  FROM {name}_cc GROUP BY {b}class
),
{name} AS (
  SELECT {b}class, tp, support, predicted,
         CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / CAST(predicted AS DOUBLE) ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) ELSE 0.0 END AS recall,
         CASE WHEN support + predicted > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(support + predicted AS DOUBLE)
              ELSE 0.0 END AS f1
  FROM {name}_per
)"""


def weighted_select(name: str, by: list[str] = ()) -> str:
    b = "".join(f"{x}, " for x in by)
    g = f" GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {b}
  round(CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE), 6) AS accuracy,
  round(sum(precision * support) / CAST(sum(support) AS DOUBLE), 6) AS precision,
  round(sum(recall * support) / CAST(sum(support) AS DOUBLE), 6) AS recall,
  round(sum(f1 * support) / CAST(sum(support) AS DOUBLE), 6) AS f1
FROM {name}{g}"""


def report_select(name: str) -> str:
    return f"""SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM {name}"""


def full_select(name: str, classes: str, by: str | None = None) -> str:
    """Report over all dictionary classes, for each value of ``by``."""
    b = f"g.{by}, " if by else ""
    grid = f"(SELECT * FROM (SELECT DISTINCT {by} FROM {name}) CROSS JOIN {classes})" if by else classes
    on = f" AND r.{by} = g.{by}" if by else ""
    return f"""
SELECT {b}g.cls AS class, coalesce(round(r.precision, 6), 0.0) AS precision, coalesce(round(r.recall, 6), 0.0) AS recall,
       coalesce(round(r.f1, 6), 0.0) AS f1, CAST(coalesce(r.support, 0) AS BIGINT) AS support, r.tp IS NOT NULL AS in_data
FROM {grid} g LEFT JOIN {name} r ON r.class = g.cls{on}"""


def totals_select(name: str) -> str:
    return f"""
SELECT 'accuracy' AS "row", CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall,
       round(CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE), 6) AS f1, CAST(sum(support) AS BIGINT) AS support
FROM {name}
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT)
FROM {name}
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / CAST(sum(support) AS DOUBLE), 6),
       round(sum(recall * support) / CAST(sum(support) AS DOUBLE), 6),
       round(sum(f1 * support) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT)
FROM {name}"""


def margin_ovr(scores: str, truth: str) -> str:
    """One-vs-rest rows with the margin score: ``s_k - max(other s)``."""
    return f"""
ovr AS (
  SELECT s.doc_id, s.idx AS class,
         s.score - max(s.score) OVER (PARTITION BY s.doc_id ORDER BY s.idx
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING
                                      EXCLUDE CURRENT ROW) AS score,
         CAST(CASE WHEN t.label_id = s.idx THEN 1 ELSE 0 END AS BIGINT) AS pos
  FROM {scores} s JOIN {truth} t USING (doc_id)
)"""


CURVE = """
merged AS (SELECT class, score, sum(pos) AS p, sum(1 - pos) AS ng FROM ovr GROUP BY class, score),
cum AS (
  SELECT *, sum(p) OVER w AS tp, sum(ng) OVER w AS fp, row_number() OVER w AS idx,
         lead(p) OVER w AS p_next, lead(ng) OVER w AS ng_next
  FROM merged
  WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
tot AS (SELECT class, sum(pos) AS P, sum(1 - pos) AS N FROM ovr GROUP BY class)"""

ROC_POINTS = """
pts AS (
  SELECT class, CAST(score AS DOUBLE) AS threshold, tp, fp FROM cum
  WHERE idx = 1 OR p_next IS NULL OR p_next <> p OR ng_next <> ng
  UNION ALL
  SELECT class, CAST(NULL AS DOUBLE), 0, 0 FROM tot
)
SELECT pts.class, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CASE WHEN N > 0 THEN round(CAST(fp AS DOUBLE) / CAST(N AS DOUBLE), 6) END AS fpr,
       CASE WHEN P > 0 THEN round(CAST(tp AS DOUBLE) / CAST(P AS DOUBLE), 6) END AS tpr
FROM pts JOIN tot USING (class)"""

ROC_AUC = """
SELECT c.class,
       CASE WHEN t.P > 0 AND t.N > 0 THEN
         round(sum(c.ng * (c.tp - c.p / CAST(2 AS DOUBLE))) / (CAST(t.P AS DOUBLE) * CAST(t.N AS DOUBLE)), 6) END AS auc
FROM cum c JOIN tot t USING (class)
GROUP BY c.class, t.P, t.N"""

EMBED_OVR = """
ks AS (SELECT CAST(range AS INTEGER) AS idx FROM range(0, (SELECT max(label) + 1 FROM embeddings))),
ovr AS (
  SELECT e.vec_id AS doc_id, k.idx AS class, CAST(e.embedding[k.idx + 1] AS DOUBLE) AS score,
         CAST(CASE WHEN e.label = k.idx THEN 1 ELSE 0 END AS BIGINT) AS pos
  FROM embeddings e CROSS JOIN ks k
)"""


# nearest class centroid (squared distance over every component), first class on ties
NEAREST_CENTROID = """
WITH ex AS (
  SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings
),
cent AS (SELECT label AS c, i, avg(x) AS m FROM ex GROUP BY label, i),
dist AS (
  SELECT ex.vec_id, ex.label, cent.c, sum((ex.x - cent.m) * (ex.x - cent.m)) AS d
  FROM ex JOIN cent ON ex.i = cent.i
  GROUP BY ex.vec_id, ex.label, cent.c
)
SELECT vec_id, label, arg_min(c, (d, c)) AS predicted_label FROM dist GROUP BY vec_id, label"""


def _q(*parts: str) -> str:
    return "\n".join(parts)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["corpus_clean"] = _q(_with(CORPUS), "SELECT doc_id, text, label, language FROM corpus")
    q["tsv_rejects"] = '''
WITH r AS (
  SELECT doc_id, text, lang, doc_id % 5 AS k,
         CAST(doc_id AS VARCHAR) || chr(9) || '"' || replace(text, '"', '""') || '"' AS head
  FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL
)
SELECT doc_id, CAST(CASE k WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 2 ELSE 3 END AS INTEGER) AS n_fields,
       k NOT IN (1, 2, 3) AS kept,
       md5(CASE k WHEN 1 THEN head || chr(9) || lang || chr(9)
                  WHEN 2 THEN head || chr(9) || lang || chr(9) || chr(9) || '"a' || chr(9) || 'b"' || chr(9) || 'c'
                  WHEN 3 THEN head ELSE text || chr(9) || lang END) AS content_md5
FROM r'''
    q["label_dictionary"] = _q(_with(CORPUS), """
SELECT 'label' AS field, idx, cls AS value FROM labels_k
UNION ALL SELECT 'language' AS field, idx, cls AS value FROM langs_k""")
    q["label_encode"] = _q(BASE, """
SELECT d.doc_id, sk.idx AS label_id, lk.idx AS language_id
FROM docs d JOIN labels_k sk ON sk.cls = d.label JOIN langs_k lk ON lk.cls = d.language""")
    q["langid_target"] = _q(BASE, "SELECT doc_id, language AS label FROM docs")
    q["prefix_gold"] = _q(_with(CORPUS), f"""
SELECT doc_id, md5(language || '{SEP}' || text) AS prefixed_md5,
       CAST(length(language || '{SEP}' || text) AS BIGINT) AS prefixed_chars FROM corpus""")
    q["tokens_truncated"] = _q(_with(CORPUS, f"""
tk AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), {WORDS_RE}), lambda x: x <> ''))
                          AS BIGINT) AS n FROM corpus)"""), f"""
SELECT doc_id, n AS n_tokens, least(n, {MAX_TOKENS}) AS n_kept, greatest(n - {MAX_TOKENS}, 0) AS n_cut FROM tk""")
    q["token_sequences"] = _q(_with(CORPUS, f"""
tk AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(language || '{SEP}'), {WORDS_RE}), lambda x: x <> '')
         || list_filter(regexp_split_to_array(lower(text), {WORDS_RE}), lambda x: x <> '') AS t
  FROM corpus
)"""), f"""
SELECT doc_id, CAST(least(len(t), {MAX_TOKENS}) AS BIGINT) AS n_kept, CAST(len(t) AS BIGINT) AS n_tokens,
       CAST(greatest(len(t) - {MAX_TOKENS}, 0) AS BIGINT) AS n_cut,
       md5(array_to_string(t[1:{MAX_TOKENS}], ' ')) AS tokens_md5
FROM tk""")
    q["shuffle_seeded"] = _q(_with(CORPUS), f"""
SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}' || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS position
FROM corpus""")
    q["split_stratified"] = _q(BASE, "SELECT doc_id, label, split FROM docs")
    q["split_sizes"] = _q(BASE, "SELECT split, count(*) AS n FROM docs GROUP BY split")
    q["split_by_language"] = _q(BASE + ",\n" + split_ctes("lassign", "language", "docs"), """
SELECT d.doc_id, d.language, a.split FROM docs d JOIN lassign a USING (doc_id)""")
    q["kfold_stratified"] = _q(BASE, "SELECT doc_id, label, fold FROM docs")
    q["kfold_sizes"] = _q(BASE, "SELECT fold, label, count(*) AS n FROM docs GROUP BY fold, label")
    q["gram_counts"] = _q(BASE, "SELECT doc_id, gram, n FROM feats")
    q["langid_model"] = _q(BASE + ",\n" + LANG_MODEL, "SELECT gram, cls AS class, s AS score FROM lm")
    q["conditioned_model"] = _q(BASE + ",\n" + SENT_MODEL, "SELECT language, gram, cls AS class, s AS score FROM sm")
    q["baseline_model"] = _q(BASE + ",\n" + BASE_MODEL, "SELECT gram, cls AS class, s AS score FROM bm")

    casc = BASE + ",\n" + CASCADE
    q["class_scores"] = _q(casc, "SELECT doc_id, cls AS class, score FROM ls")
    q["argmax_label"] = _q(casc, "SELECT doc_id, predicted_language_id, predicted_label_id FROM ev")
    q["cascade_eval"] = _q(casc, "SELECT doc_id, language, predicted_language, label, predicted_label FROM ev")
    q["label_decode"] = _q(casc, """
SELECT doc_id, predicted_label_id, predicted_label, predicted_language_id, predicted_language FROM ev""")
    q["prefix_predicted"] = _q(casc, f"""
SELECT e.doc_id, md5(e.predicted_language || '{SEP}' || c.text) AS prefixed_md5,
       CAST(length(e.predicted_language || '{SEP}' || c.text) AS BIGINT) AS prefixed_chars
FROM ev e JOIN corpus c USING (doc_id)""")
    q["cascade_gold_vs_pred"] = _q(casc + ",\n" + score_ctes("gs", "sm", "test", "test_docs", "labels_k",
                                                            ["language", "gram"]), """
SELECT e.doc_id, e.label, e.predicted_label, g.pred AS predicted_label_gold
FROM ev e JOIN gs_pred g USING (doc_id)""")
    q["predict"] = _q(casc + ",\n" + """
unl AS (SELECT d.doc_id, d.text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
""".strip() + ",\n" + gram_ctes("uf", "unl") + ",\n" + score_ctes("ul", "lm", "uf", "unl", "langs_k", ["gram"])
                     + ",\n" + """
ustage2 AS (SELECT f.doc_id, f.gram, f.n, p.pred AS language FROM uf f JOIN ul_pred p USING (doc_id))""".strip()
                     + ",\n" + score_ctes("us", "sm", "ustage2", "unl", "labels_k", ["language", "gram"]), """
SELECT u.doc_id, lp.pred AS predicted_language, sp.pred AS predicted_sentiment
FROM unl u JOIN ul_pred lp USING (doc_id) JOIN us_pred sp USING (doc_id)""")

    cand = []
    for j, a in enumerate(ALPHAS):
        cand.append(nb_ctes(f"cm{j}", "train", "train_docs", "label", ["gram"], "labels_k", alpha=a))
        cand.append(score_ctes(f"cs{j}", f"cm{j}", "test", "test_docs", "labels_k", ["gram"]))
    union = "\nUNION ALL\n".join(
        f"SELECT {j} AS candidate, d.label, p.pred AS predicted_label FROM test_docs d JOIN cs{j}_pred p USING (doc_id)"
        for j in range(len(ALPHAS)))
    alpha_case = "CASE candidate " + " ".join(f"WHEN {j} THEN {a}" for j, a in enumerate(ALPHAS)) + " END"
    q["best_candidate"] = _q(BASE + ",\n" + ",\n".join(cand) + f",\ncand AS ({union}),\n"
                             + metric_ctes("cmx", "cand", "label", "predicted_label", ["candidate"])
                             + ",\nper AS (" + weighted_select("cmx", ["candidate"]) + ")", f"""
SELECT candidate, {alpha_case} AS alpha, accuracy, f1,
       candidate = first(candidate ORDER BY f1 DESC, candidate) OVER () AS is_best
FROM per""")

    # candidates fitted on the training rows outside fold 0, judged on those inside; the chosen one fitted on all
    held = ["""fit AS (SELECT * FROM train WHERE fold <> 0), fit_docs AS (SELECT * FROM train_docs WHERE fold <> 0),
val AS (SELECT * FROM train WHERE fold = 0), val_docs AS (SELECT * FROM train_docs WHERE fold = 0)"""]
    for j, a in enumerate(ALPHAS):
        held += [nb_ctes(f"hm{j}", "fit", "fit_docs", "label", ["gram"], "labels_k", alpha=a),
                 score_ctes(f"hs{j}", f"hm{j}", "val", "val_docs", "labels_k", ["gram"])]
    held.append("hcand AS (" + "\nUNION ALL\n".join(
        f"SELECT {j} AS candidate, d.label, k.idx AS label_id, p.pred AS predicted_label, "
        f"(SELECT list(s.score ORDER BY s.idx) FROM hs{j} s WHERE s.doc_id = d.doc_id) AS s "
        f"FROM val_docs d JOIN hs{j}_pred p USING (doc_id) JOIN labels_k k ON k.cls = d.label"
        for j in range(len(ALPHAS))) + """),
hloss AS (
  SELECT candidate, round(avg(CAST(round((list_max(s) / 1e6
           + ln(list_sum(list_transform(s, lambda x: exp(CAST(x - list_max(s) AS DOUBLE) / 1e6))))
           - CAST(s[label_id + 1] AS DOUBLE) / 1e6) * 1e6) AS BIGINT)) / 1e6, 6) AS eval_loss
  FROM hcand GROUP BY candidate
)""")
    held.append(metric_ctes("hmx", "hcand", "label", "predicted_label", ["candidate"]))
    held.append("hper AS (" + weighted_select("hmx", ["candidate"]) + f"""),
hbest AS (
  SELECT l.candidate, CAST({alpha_case.replace("candidate", "l.candidate")} AS DOUBLE) AS alpha, l.eval_loss, p.accuracy, p.f1,
         l.candidate = first(l.candidate ORDER BY l.eval_loss, l.candidate) OVER () AS is_best
  FROM hloss l JOIN hper p USING (candidate)
)""")
    chosen = BASE + ",\n" + ",\n".join(held)
    q["best_candidate_loss"] = _q(chosen, "SELECT candidate, alpha, eval_loss, accuracy, f1, is_best FROM hbest")
    q["predict_best"] = _q(chosen + ",\n" + ",\n".join(cand), "\nUNION ALL\n".join(
        f"SELECT d.doc_id, d.label, p.pred AS predicted_label, b.alpha FROM test_docs d JOIN cs{j}_pred p USING (doc_id) "
        f"JOIN hbest b ON b.candidate = {j} AND b.is_best" for j in range(len(ALPHAS))))

    base_ctes = BASE + ",\n" + BASELINE
    q["confusion"] = _q(casc, "SELECT label AS y, predicted_label AS yhat, count(*) AS n FROM ev "
                              "GROUP BY label, predicted_label")
    base = BASE + ",\n" + BASELINE
    q["accuracy"] = _q(base, """
SELECT round(avg(CASE WHEN label = predicted_label THEN 1 ELSE 0 END), 6) AS accuracy FROM bev""")
    q["weighted_prf"] = _q(base + ",\n" + metric_ctes("bmx", "bev", "label", "predicted_label"),
                           weighted_select("bmx"))
    cm = casc + ",\n" + metric_ctes("cmx", "ev", "label", "predicted_label")
    q["class_report"] = _q(cm, report_select("cmx"))
    q["class_report_full"] = _q(casc + ",\n" + metric_ctes("lmx", "ev", "label", "predicted_label", ["language"]),
                                full_select("lmx", "labels_k", "language"))
    q["language_report"] = _q(casc + ",\n" + metric_ctes("glx", "ev", "language", "predicted_language"),
                              full_select("glx", "langs_k"))
    q["baseline_report"] = _q(base_ctes + ",\n" + metric_ctes("blx", "bev", "label", "predicted_label"),
                              full_select("blx", "labels_k"))
    langid = BASE + ",\n" + ",\n".join([
        split_ctes("la", "language", "docs"),
        """lfa AS (SELECT f.doc_id, f.gram, f.n, d.language, a.split FROM feats f JOIN docs d USING (doc_id) JOIN la a USING (doc_id)),
ltrain AS (SELECT * FROM lfa WHERE split = 'train'), ltest AS (SELECT * FROM lfa WHERE split = 'test'),
ltrain_docs AS (SELECT d.* FROM docs d JOIN la a USING (doc_id) WHERE a.split = 'train'),
ltest_docs AS (SELECT d.* FROM docs d JOIN la a USING (doc_id) WHERE a.split = 'test')""",
        nb_ctes("xm", "ltrain", "ltrain_docs", "language", ["gram"], "langs_k"),
        score_ctes("xs", "xm", "ltest", "ltest_docs", "langs_k", ["gram"]),
        "xev AS (SELECT d.doc_id, d.language, p.pred AS predicted_language FROM ltest_docs d JOIN xs_pred p USING (doc_id))"])
    q["langid_run"] = _q(langid, "SELECT doc_id, language, predicted_language FROM xev")
    q["langid_metrics"] = _q(langid + ",\n" + metric_ctes("xmx", "xev", "language", "predicted_language")
                             + ",\nxw AS (" + weighted_select("xmx") + ")", """
SELECT unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric, unnest([accuracy, precision, recall, f1]) AS value FROM xw""")
    q["report_totals"] = _q(cm, totals_select("cmx"))
    q["metrics_by_key"] = _q(casc + ",\n" + metric_ctes("kmx", "ev", "label", "predicted_label", ["language"]),
                             weighted_select("kmx", ["language"]))
    q["eval_loss"] = _q(base + ",\n" + """
arr AS (SELECT doc_id, list(score ORDER BY idx) AS s FROM bs GROUP BY doc_id),
nll AS (
  SELECT a.doc_id,
         CAST(round((list_max(a.s) / 1e6
                     + ln(list_sum(list_transform(a.s, lambda x: exp(CAST(x - list_max(a.s) AS DOUBLE) / 1e6))))
                     - CAST(a.s[b.label_id + 1] AS DOUBLE) / 1e6) * 1e6) AS BIGINT) AS l
  FROM arr a JOIN bev b USING (doc_id)
)""", "SELECT round(avg(l) / 1e6, 6) AS eval_loss FROM nll")
    q["cascade_summary"] = _q(casc, """
SELECT round(avg(CASE WHEN language = predicted_language THEN 1 ELSE 0 END), 6) AS lang_accuracy,
       round(avg(CASE WHEN label = predicted_label THEN 1 ELSE 0 END), 6) AS sent_accuracy,
       count(*) AS n_test
FROM ev""")

    cvb = BASE + ",\n" + CV_BASE
    q["cv_baseline"] = _q(cvb, "SELECT doc_id, fold, label, predicted_label FROM cvb")
    q["oof_predictions"] = _q(cvb, "SELECT doc_id, label_id, predicted_label_id FROM cvb")
    fm = cvb + ",\n" + metric_ctes("fmx", "cvb", "label", "predicted_label", ["fold"]) + ",\nfw AS (" \
        + weighted_select("fmx", ["fold"]) + """),
fl AS (
  SELECT fold, 'accuracy' AS metric, accuracy AS value FROM fw
  UNION ALL SELECT fold, 'precision', precision FROM fw
  UNION ALL SELECT fold, 'recall', recall FROM fw
  UNION ALL SELECT fold, 'f1', f1 FROM fw
)"""
    q["cv_fold_metrics"] = _q(fm, "SELECT fold, metric, value FROM fl")
    q["cv_mean_metrics"] = _q(fm, "SELECT metric, round(avg(value), 6) AS value FROM fl GROUP BY metric")
    cvc = BASE + ",\n" + CV_CASCADE
    q["cv_cascade"] = _q(cvc, "SELECT doc_id, fold, language, predicted_language, label, predicted_label FROM cvc")
    q["cv_pooled_report"] = _q(cvc + ",\n" + metric_ctes("pmx", "cvc", "label", "predicted_label"),
                               report_select("pmx"))

    q["cv_pooled_report_baseline"] = _q(cvb + ",\n" + metric_ctes("pbx", "cvb", "label", "predicted_label"),
                                        full_select("pbx", "labels_k"))
    q["cv_pooled_report_language"] = _q(cvc + ",\n" + metric_ctes("plx", "cvc", "language", "predicted_language"),
                                        full_select("plx", "langs_k"))
    q["cascade_results"] = _q(casc, """
SELECT doc_id, language_id, predicted_language_id, label_id, predicted_label_id, language, predicted_language, label,
       predicted_label FROM ev""")
    q["cascade_results_metrics"] = _q(casc, """
SELECT 'lang_accuracy' AS metric, round(avg(CASE WHEN language = predicted_language THEN 1 ELSE 0 END), 6) AS value FROM ev
UNION ALL
SELECT 'sent_accuracy', round(avg(CASE WHEN label = predicted_label THEN 1 ELSE 0 END), 6) FROM ev""")
    q["baseline_reload"] = _q(base_ctes, "SELECT doc_id, predicted_label FROM bev")
    q["lr_slots"] = _q(BASE + """,
slots AS (
  SELECT doc_id, CAST('0x' || substring(md5(gram), 1, 8) AS BIGINT) % 262144 AS slot, sum(n) AS n FROM feats GROUP BY ALL
)""", """
SELECT d.doc_id, count(s.slot) AS n_slots, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS n_grams,
       md5(coalesce(string_agg(CAST(s.slot AS VARCHAR) || ':' || CAST(s.n AS VARCHAR), ',' ORDER BY s.slot), '')) AS slots_md5
FROM docs d LEFT JOIN slots s USING (doc_id) GROUP BY d.doc_id""")
    q["lr_losses"] = _q(BASE, """
SELECT round(-sum(n / total * ln((n + 1) / (total + k))), 6) AS first_loss, true AS falling
FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total, count(*) OVER () AS k
      FROM train_docs GROUP BY label)""")

    ovr = casc + ",\n" + margin_ovr("ss", "ev")
    q["one_vs_rest"] = _q(ovr, "SELECT doc_id, class, score, pos FROM ovr")
    q["roc_points"] = _q(ovr + ",\n" + CURVE + ",\n" + ROC_POINTS)
    q["roc_auc"] = _q(ovr + ",\n" + CURVE, ROC_AUC)
    bovr = base_ctes + ",\n" + margin_ovr("bs", "bev")
    q["roc_points_baseline"] = _q(bovr + ",\n" + CURVE + ",\n" + ROC_POINTS)
    q["roc_auc_baseline"] = _q(bovr + ",\n" + CURVE, ROC_AUC)
    q["roc_points_embeddings"] = _q(_with(EMBED_OVR, CURVE) + ",\n" + ROC_POINTS)
    q["roc_auc_embeddings"] = _q(_with(EMBED_OVR, CURVE), ROC_AUC)
    q["user_model_scores"] = NEAREST_CENTROID
    q["tsv_roundtrip"] = "SELECT doc_id, text, lang AS language FROM documents"
    q["union_languages"] = q["corpus_clean"]
    q["many_file_scan"] = q["corpus_clean"]
    q["results_tables"] = _q(base, "SELECT doc_id, label_id, predicted_label_id, label, predicted_label FROM bev")
    q["results_metrics"] = _q(base + ",\n" + metric_ctes("bmx", "bev", "label", "predicted_label") + ",\nw AS ("
                              + weighted_select("bmx") + ")", """
SELECT 'accuracy' AS metric, accuracy AS value FROM w UNION ALL SELECT 'precision', precision FROM w
UNION ALL SELECT 'recall', recall FROM w UNION ALL SELECT 'f1', f1 FROM w""")
    q["model_reload_predict"] = q["predict"]
    q["predict_stream"] = q["predict"]
    q["predict_conversations"] = _q(casc + ",\n" + """
unl AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS doc_id, conv_id, turn, text FROM conversations)
""".strip() + ",\n" + gram_ctes("uf", "unl") + ",\n" + score_ctes("ul", "lm", "uf", "unl", "langs_k", ["gram"])
                                    + ",\n" + """
ustage2 AS (SELECT f.doc_id, f.gram, f.n, p.pred AS language FROM uf f JOIN ul_pred p USING (doc_id))""".strip()
                                    + ",\n" + score_ctes("us", "sm", "ustage2", "unl", "labels_k",
                                                         ["language", "gram"]), """
SELECT u.conv_id, u.turn, lp.pred AS predicted_language, sp.pred AS predicted_sentiment
FROM unl u JOIN ul_pred lp USING (doc_id) JOIN us_pred sp USING (doc_id)""")
    return q
