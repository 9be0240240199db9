"""Multinomial naive Bayes over gram counts, fitted and scored as Spark jobs.

Fit is one aggregation: sums per model key (gram, or language and gram) and
slot - a class, or a class of a fold - pre-aggregated map-side, so a gram found
in every document is still one row per task before the shuffle.  A key is one
row with one array: K counts, or folds x K.  The fitted table is its
element-wise image, K scores per fold or candidate in one array, so scoring
joins each (document, gram) row once, whatever the number of classes, folds
and candidates, and takes the slice it needs.

Scores are integer micro-nats: ``round(ln((count + alpha) / (N_class + alpha V)) * 1e6)``
with V the vocabulary of the training rows, plus the log prior of the class.
A gram unseen in training adds nothing.

Folds: counts are taken once per (key, fold); the training counts of fold f
are the totals minus fold f, so all folds are fitted in one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelcask.functions.scores import MICRO, argmax, micro_log
from babelcask.operators.encode import ClassDictionary, literal_array
from babelcask.session import cut_lineage, shuffle_partitions

# Largest fitted table that is broadcast to every task: the exact row count
# is known after fitting, so the broadcast is behind a size check.
MAX_BROADCAST_BYTES = 128 << 20

# Log prior (micro-nats) of a class without a training row: below what any
# text can make up for, so the class is predicted only if no other exists.
NO_ROWS_PRIOR = -10**15

# Array elements summed as plan columns of their own (generated code); longer
# arrays are summed as (position, value) rows.
WIDE_SLOTS = 64


def slot_sums(df: DataFrame, keys, slot: Column, value: Column, n_slots: int, out: str = "counts") -> DataFrame:
    """(keys..., out array<bigint>): sums of ``value`` per key and ``slot`` (0 to ``n_slots`` - 1)."""
    keys = list(keys)
    if n_slots <= WIDE_SLOTS:
        wide = df.withColumn("_slot", slot).groupBy(*keys).agg(
            *[F.sum(F.when(F.col("_slot") == s, value)).alias(f"_s{s}") for s in range(n_slots)])
        return wide.select(*keys, _bigints([F.col(f"_s{s}") for s in range(n_slots)]).alias(out))
    long = df.withColumn("_slot", slot.cast("int")).groupBy(*keys, "_slot").agg(F.sum(value).alias("_v"))
    packed = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slot", "_v"))).alias("_e"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("bigint"), n)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("_e", i - 1)["_slot"])
    filled = F.flatten(F.transform("_e", lambda e, i: F.concat(
        zeros(e["_slot"] - before(i) - 1), F.array(e["_v"].cast("bigint")))))
    return packed.select(*keys, F.concat(filled, zeros(n_slots - 1 - F.element_at("_e", -1)["_slot"])).alias(out))


def array_sums(df: DataFrame, ids, n: int, out: str, at: Callable[[int], Column], whole: Callable[[], Column],
               weight: Column | None = None) -> DataFrame:
    """(ids..., out array<bigint>): element-wise sums of an array of ``n`` elements, zeros where it is null.

    ``at(i)``: element i; ``whole()``: the array itself, for more than ``WIDE_SLOTS`` elements.
    """
    ids = list(ids)
    times = (lambda x: x) if weight is None else (lambda x: weight * x)
    if n <= WIDE_SLOTS:
        sums = df.groupBy(*ids).agg(*[F.sum(times(at(i))).alias(f"_s{i}") for i in range(n)])
        return sums.select(*ids, _bigints([F.col(f"_s{i}") for i in range(n)]).alias(out))
    w = F.lit(1).cast("bigint") if weight is None else weight
    rows = df.select(*ids, w.alias("_w"), F.posexplode_outer(whole()).alias("_slot", "_x"))
    sums = rows.groupBy(*ids, "_slot").agg(F.sum(F.col("_w") * F.col("_x")).cast("bigint").alias("_v"))
    some = F.col("_slot").isNotNull()
    packed = sums.groupBy(*ids).agg(F.array_sort(F.collect_list(F.when(some, F.struct("_slot", "_v")))).alias("_e"))
    return packed.select(*ids, F.when(F.size("_e") > 0, F.transform("_e", lambda e: e["_v"]))
                         .otherwise(F.array_repeat(F.lit(0).cast("bigint"), n)).alias(out))


def _bigints(cols) -> Column:
    return F.array(*[F.coalesce(c, F.lit(0)).cast("bigint") for c in cols])


@dataclass
class NaiveBayesModel:
    """Scores of ``slices`` models (one, or one per fold or candidate) side by side in one array per key."""
    classes: tuple[str, ...]
    keys: tuple[str, ...]
    table: DataFrame                       # keys..., scores array<bigint>: slices x K
    rows: int                              # rows of ``table``
    vocab: tuple[int, ...]                 # V per slice
    priors: tuple[tuple[int, ...], ...]    # K log priors per slice
    slice_col: str | None = None           # the row's column that picks its slice (fold)

    @property
    def k(self) -> int:
        return len(self.classes)

    @property
    def slices(self) -> int:
        return len(self.priors)

    def size_bytes(self) -> int:
        return self.rows * (8 * self.k * self.slices + 24 * len(self.keys) + 48)

    def prior_column(self, which=None) -> Column:
        """Array of K micro-nat log priors of a slice (the first, or that of a column)."""
        flat = literal_array([x for p in self.priors for x in p], "bigint")
        which = F.lit(0) if which is None else F.col(which) if isinstance(which, str) else which
        return F.slice(flat, which.cast("int") * self.k + 1, self.k)


def _ln_micro_many(spark: SparkSession, pairs: list[tuple[float, float]]) -> list[int]:
    """Spark-evaluated micro-nat logs of constant ratios (same log as the table).

    The same expression as ``micro_log``, written as SQL text: one call into
    the JVM for all values instead of several per value.
    """
    if not pairs:
        return []
    if any(a <= 0 or b <= 0 for a, b in pairs):
        known = iter(_ln_micro_many(spark, [(a, b) for a, b in pairs if a > 0 and b > 0]))
        return [next(known) if a > 0 and b > 0 else NO_ROWS_PRIOR for a, b in pairs]
    def d(x):
        return f"CAST('{float(x)!r}' AS DOUBLE)"
    exprs = [f"CAST(ROUND(LN({d(a)} / {d(b)}) * {d(MICRO)}) AS BIGINT) AS v{i}" for i, (a, b) in enumerate(pairs)]
    row = spark.range(1).selectExpr(*exprs).first()
    return [int(v) for v in row]


def _logs(counts: Column, alpha, den: list) -> Column:
    """Micro-nat logs of ``(counts[i] + alpha) / den[i]``."""
    if len(den) <= WIDE_SLOTS:
        return F.array(*[micro_log(counts[i] + F.lit(alpha), F.lit(float(d))) for i, d in enumerate(den)])
    return F.zip_with(counts, literal_array([float(d) for d in den], "double"), lambda c, d: micro_log(c + F.lit(alpha), d))


@dataclass
class NaiveBayesCounts:
    """Fitted counts, before smoothing: one pass over the training rows."""
    classes: tuple[str, ...]
    keys: tuple[str, ...]
    counts: DataFrame                      # keys..., counts array<bigint>: K
    vocab: int
    n_class: tuple[int, ...]
    priors: tuple[int, ...]

    def _den(self, alpha) -> list:
        return [n + alpha * self.vocab for n in self.n_class]

    def model(self, alpha: int | float = 1) -> NaiveBayesModel:
        table = self.counts.select(*self.keys, _logs(F.col("counts"), alpha, self._den(alpha)).alias("scores"))
        return NaiveBayesModel(self.classes, self.keys, table, self.vocab, (self.vocab,), (self.priors,))

    def candidates(self, alphas) -> NaiveBayesModel:
        """One model of many smoothing values: a slice per value in each key's array."""
        scores = F.concat(*[_logs(F.col("counts"), a, self._den(a)) for a in alphas])
        return NaiveBayesModel(self.classes, self.keys, self.counts.select(*self.keys, scores.alias("scores")),
                               self.vocab, (self.vocab,) * len(alphas), (self.priors,) * len(alphas))


def _totals(counts: DataFrame, n: int) -> tuple[int, list[int]]:
    """(rows, element sums) of a counts table."""
    one = counts.select("counts", F.lit(1).cast("bigint").alias("_one"))
    sums = array_sums(one, [], n + 1, "s", lambda i: F.col("counts")[i] if i < n else F.col("_one"),
                      lambda: F.concat("counts", F.array("_one"))).first()
    s = [int(x) for x in sums["s"]]
    return s[n], s[:n]


def _finish_counts(counts: DataFrame, classes: tuple, keys: tuple, docs: DataFrame,
                   class_col: str) -> NaiveBayesCounts:
    """Materialise a (keys..., counts) table; add its totals and the class priors."""
    spark = counts.sparkSession
    counts = cut_lineage(counts, "nbcounts")
    v, n_class = _totals(counts, len(classes))
    doc_rows = {r[0]: int(r[1]) for r in docs.groupBy(class_col).agg(F.count(F.lit(1))).collect()}
    n_docs = sum(doc_rows.values())
    priors = tuple(_ln_micro_many(spark, [(doc_rows.get(c, 0), n_docs) for c in classes]))
    return NaiveBayesCounts(classes, keys, counts, v, tuple(n_class), priors)


def count(features: DataFrame, docs: DataFrame, class_col: str, classes, keys=("gram",)) -> NaiveBayesCounts:
    """Counts per key and class on training rows, materialised once.

    ``features``: (doc_id, keys..., class, n); ``docs``: one row per training
    document with its class (for the priors).  This is the one pass over the
    large count table; models with coarser keys derive from its result.
    """
    classes, keys = tuple(classes), tuple(keys)
    feats = features.where(F.col("gram").isNotNull())
    counts = slot_sums(feats, keys, ClassDictionary(classes).encode(class_col), F.col("n"), len(classes))
    return _finish_counts(counts, classes, keys, docs, class_col)


def _by_key(counts: DataFrame, keys: tuple, key: str, key_classes: tuple, k: int, folds: int) -> DataFrame:
    """Counts (folds x K) -> counts whose classes are the values of ``key``: row sums per fold."""
    per_fold = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.aggregate(
        F.slice("counts", f * k + 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x))
    rows = counts.select(*[c for c in keys if c != key], ClassDictionary(key_classes).encode(key).alias("_cls"),
                         F.posexplode(per_fold).alias("_fold", "_n"))
    return slot_sums(rows, [c for c in keys if c != key], F.col("_fold") * len(key_classes) + F.col("_cls"), F.col("_n"),
                     folds * len(key_classes))


def _marginal(counts: DataFrame, keys: tuple, n: int) -> DataFrame:
    return array_sums(counts, keys, n, "counts", lambda i: F.col("counts")[i], lambda: F.col("counts"))


def count_by_key(src: NaiveBayesCounts, key: str, key_classes, docs: DataFrame,
                 class_col: str | None = None) -> NaiveBayesCounts:
    """Counts whose classes are the values of one of ``src``'s keys.

    (gram -> language) counts are the row sums of ((language, gram) -> label)
    counts: one aggregation over the fitted table (vocabulary-sized) instead
    of another pass over every (document, gram) row.
    """
    key_classes = tuple(key_classes)
    keys = tuple(k for k in src.keys if k != key)
    counts = _by_key(src.counts, src.keys, key, key_classes, len(src.classes), 1)
    return _finish_counts(counts, key_classes, keys, docs, class_col or key)


def count_marginal(src: NaiveBayesCounts, drop_key: str, docs: DataFrame, class_col: str) -> NaiveBayesCounts:
    """Same classes, one key summed out: (gram -> label) from ((language, gram) -> label)."""
    keys = tuple(k for k in src.keys if k != drop_key)
    return _finish_counts(_marginal(src.counts, keys, len(src.classes)), src.classes, keys, docs, class_col)


def fit(features: DataFrame, docs: DataFrame, class_col: str, classes, keys=("gram",),
        alpha: int | float = 1) -> NaiveBayesModel:
    """Fit on training rows (see ``count``), add-``alpha`` smoothing."""
    return count(features, docs, class_col, classes, keys).model(alpha)


@dataclass
class FoldCounts:
    """Counts per key (array: folds x K), materialised."""
    classes: tuple[str, ...]
    keys: tuple[str, ...]
    counts: DataFrame
    n_folds: int
    fold_col: str = "fold"


def fold_counts(features: DataFrame, class_col: str, classes, n_folds: int, fold_col: str = "fold",
                keys=("gram",)) -> FoldCounts:
    """One pass over all rows: counts of every fold side by side."""
    classes, keys = tuple(classes), tuple(keys)
    feats = features.where(F.col("gram").isNotNull())
    slot = F.col(fold_col) * len(classes) + ClassDictionary(classes).encode(class_col)
    counts = slot_sums(feats, keys, slot, F.col("n"), n_folds * len(classes))
    return FoldCounts(classes, keys, cut_lineage(counts, "nbfolds"), n_folds, fold_col)


def fold_counts_by_key(src: FoldCounts, key: str, key_classes) -> FoldCounts:
    """Fold counts whose classes are the values of one of ``src``'s keys (row sums per fold)."""
    key_classes = tuple(key_classes)
    keys = tuple(k for k in src.keys if k != key)
    counts = _by_key(src.counts, src.keys, key, key_classes, len(src.classes), src.n_folds)
    return FoldCounts(key_classes, keys, cut_lineage(counts, "nbfolds"), src.n_folds, src.fold_col)


def fold_counts_marginal(src: FoldCounts, drop_key: str) -> FoldCounts:
    """Same classes and folds, one key summed out: (gram -> label) from ((language, gram) -> label).

    Aggregates the vocabulary-sized fold table instead of passing over the
    count table again; a key is in a fold's vocabulary exactly when it was
    before summing, so the fold models are the same as from a direct count.
    """
    keys = tuple(k for k in src.keys if k != drop_key)
    counts = _marginal(src.counts, keys, src.n_folds * len(src.classes))
    return FoldCounts(src.classes, keys, cut_lineage(counts, "nbfolds"), src.n_folds, src.fold_col)


def fold_model(fc: FoldCounts, docs: DataFrame, class_col: str, alpha: int | float = 1) -> NaiveBayesModel:
    """Model of fold f = all counts minus fold f, all folds in one array per key.

    A key whose training counts in fold f are all zero is not in that fold's
    vocabulary: its scores there are 0, which adds nothing to any class.
    """
    classes, keys, n_folds, K = fc.classes, fc.keys, fc.n_folds, len(fc.classes)
    spark = fc.counts.sparkSession
    per_class = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda i: F.aggregate(
        F.sequence(F.lit(0), F.lit(n_folds - 1)), F.lit(0).cast("bigint"), lambda a, f: a + F.get("counts", f * K + i)))
    train = fc.counts.withColumn("_all", per_class).select(
        *keys, F.transform("counts", lambda c, s: F.get("_all", s % K) - c).alias("_train"))
    live = F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)),
                       lambda f: F.exists(F.slice("_train", f * K + 1, K), lambda x: x > 0))
    train = train.withColumn("_live", live)
    known = train.select(F.concat("_train", F.transform("_live", lambda x: x.cast("bigint"))).alias("counts"))
    rows, sums = _totals(known, n_folds * K + n_folds)
    n_class, vocab = sums[: n_folds * K], sums[n_folds * K:]
    den = literal_array([float(n_class[f * K + i] + alpha * vocab[f]) for f in range(n_folds) for i in range(K)], "double")
    # the denominators and the row's counts side by side, then one logarithm per slot
    scores = F.transform(F.arrays_zip(F.col("_train").alias("c"), den.alias("d")), lambda x, s: F.when(
        F.get("_live", F.floor(s / K).cast("int")), micro_log(x["c"] + F.lit(alpha), x["d"])).otherwise(F.lit(0).cast("bigint")))
    table = train.select(*keys, scores.alias("scores"))

    dc = docs.groupBy(fc.fold_col, class_col).agg(F.count(F.lit(1)).alias("n")).collect()
    per = {(int(r[0]), r[1]): int(r[2]) for r in dc}
    pairs = []
    for f in range(n_folds):
        own = [sum(per.get((g, c), 0) for g in range(n_folds) if g != f) for c in classes]
        pairs += [(x, sum(own)) for x in own]
    logs = _ln_micro_many(spark, pairs)
    priors = tuple(tuple(logs[f * K:(f + 1) * K]) for f in range(n_folds))
    return NaiveBayesModel(classes, keys, table, rows, tuple(vocab), priors, fc.fold_col)


def fit_folds(features: DataFrame, docs: DataFrame, class_col: str, classes, n_folds: int,
              fold_col: str = "fold", keys=("gram",), alpha: int | float = 1) -> NaiveBayesModel:
    """All fold models in one pass: model of fold f is fitted on every other fold."""
    return fold_model(fold_counts(features, class_col, classes, n_folds, fold_col, keys), docs, class_col, alpha)


def hot_keys(features: DataFrame, key_cols: list, n_parts: int) -> DataFrame:
    """Join keys holding more than 1/``n_parts`` of the rows, as a table (``_hk0``...).

    One aggregation, pre-aggregated map-side, materialised (vocabulary-sized);
    at most ``n_parts`` keys can pass the threshold, so the result has a
    proven bound and may be broadcast.
    """
    agg = cut_lineage(features.groupBy(*[c.alias(f"_hk{i}") for i, c in enumerate(key_cols)])
                      .agg(F.count(F.lit(1)).alias("_rows")), "hotkeys")
    total = agg.agg(F.sum("_rows")).first()[0] or 0
    return agg.where(F.col("_rows") * F.lit(n_parts) > F.lit(total)).drop("_rows")


def _salt_hot_keys(feats: DataFrame, m: DataFrame, cond_pairs, id_col: str):
    """Spread each hot key over all shuffle partitions; other keys keep salt 0.

    Only the few hot rows of the fitted table are repeated (once per salt);
    a feature row of a hot key takes the salt from its document's hash.
    """
    n = shuffle_partitions(feats.sparkSession)
    hot = F.broadcast(hot_keys(feats, [fc for fc, _ in cond_pairs], n).withColumn("_hot", F.lit(True)))
    hk = [f"_hk{i}" for i in range(len(cond_pairs))]
    # null-safe: a document with a blank end has a null gram, which may be the hottest key of all
    f_on = [fc.eqNullSafe(F.col(h)) for (fc, _), h in zip(cond_pairs, hk)]
    feats = (feats.join(hot, f_on, "left")
             .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)))
                         .otherwise(F.lit(0)).cast("int"))
             .drop(*hk, "_hot"))
    m_on = [F.col(mc) == F.col(h) for (_, mc), h in zip(cond_pairs, hk)]
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))).cast("array<int>")
    m = (m.join(hot, m_on, "left")
         .withColumn("_m_salt", F.explode(salts))
         .drop(*hk, "_hot"))
    return feats, m


def join_model(feats: DataFrame, m: DataFrame, cond_pairs, id_col: str, size_bytes: int,
               broadcast_limit: int | None = None) -> DataFrame:
    """Left join of (document, key) rows with a fitted table ``m``.

    ``cond_pairs``: (feature column, name of m's column).  The table is
    broadcast when its size (known after fitting) is at most
    ``broadcast_limit`` (default ``MAX_BROADCAST_BYTES``); above it the join
    shuffles, with hot keys salted and AQE's skew join on top.
    """
    cond = [fc == F.col(mc) for fc, mc in cond_pairs]
    if size_bytes <= (MAX_BROADCAST_BYTES if broadcast_limit is None else broadcast_limit):
        return feats.join(F.broadcast(m), cond, "left")
    feats, m = _salt_hot_keys(feats, m, cond_pairs, id_col)
    return feats.join(m.hint("merge"), [*cond, F.col("_salt") == F.col("_m_salt")], "left")


def score(model: NaiveBayesModel, features: DataFrame, key_map: dict[str, str] | None = None,
          id_cols=("doc_id",), out: str = "scores", passthrough=(), broadcast_limit: int | None = None,
          all_slices: bool = False) -> DataFrame:
    """(id_cols..., out array<bigint>): prior plus gram evidence for every document.

    ``key_map`` maps a model key to the feature column that plays it (for
    example the predicted language for ``language``).  Every document of
    ``features`` keeps a row, even if none of its grams is known.  A model of
    folds scores each row with the slice of its ``slice_col``, which must be
    among ``id_cols``; ``all_slices`` gives a row per document and slice, with
    the slice's number in ``candidate``.
    """
    key_map, id_cols, k = dict(key_map or {}), list(id_cols), model.k
    m = model.table.select(*[F.col(c).alias(f"_m_{c}") for c in model.keys], F.col("scores").alias("_ms"))
    pairs = [(F.col(key_map.get(c, c)), f"_m_{c}") for c in model.keys]
    joined = join_model(features, m, pairs, id_cols[0], model.size_bytes(), broadcast_limit)
    ms = F.col("_ms")
    if all_slices or model.slice_col is None:
        n, at, whole = (model.slices if all_slices else 1) * k, (lambda i: ms[i]), (lambda: ms)
    else:
        first = F.col(model.slice_col).cast("int") * k
        n, at, whole = k, (lambda i: ms[first + i]), (lambda: F.slice(ms, first + 1, k))
    # passthrough columns depend on the document only: as extra grouping keys
    # they change no group and keep the aggregation hash-based
    ids = [*id_cols, *passthrough]
    sums = array_sums(joined, ids, n, "_evidence", at, whole, F.col("n"))
    add = lambda a, b: a + b
    if not all_slices:
        return sums.select(*ids, F.zip_with(model.prior_column(model.slice_col), "_evidence", add).alias(out))
    each = F.transform(F.sequence(F.lit(0), F.lit(model.slices - 1)), lambda c: F.struct(
        c.alias("candidate"), F.zip_with(model.prior_column(c), F.slice("_evidence", c * k + 1, k), add).alias(out)))
    return (sums.select(*ids, F.explode(each).alias("_c"))
            .select(*id_cols, F.col("_c.candidate").alias("candidate"), *passthrough, F.col(f"_c.{out}").alias(out)))


def predict_ids(scores_col: str = "scores") -> Column:
    return argmax(F.col(scores_col))
