"""Model-backed operators: nearest vectors, warping, covariance distances, clusters, hidden states,
walk-forward regressions, bootstrap.  Python runs over Arrow batches or one entity at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from chronoframe.functions.expr import corr
from chronoframe.functions.workers import ship
from chronoframe.operators.stats import kept, quantiles


def nearest(vectors: DataFrame, key: str, column: str, is_query: Column, k: int, queries_at_once: int = 2048, rows_at_once: int = 32_768) -> DataFrame:
    """(query_id, <key>, rank, cosine): the k nearest other rows of every query row; ties by id.

    Queries and rows are dealt over blocks by a hash of their ids and every query block meets every row
    block in a task of its own: one pass, whatever the number of either, and k rows a query and block
    are what is ranked in the end.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    n = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    across, down = max(1, -(-n.q // queries_at_once)), max(1, -(-n.n // rows_at_once))
    block = lambda name, of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int").alias(name)
    every = lambda name, of: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(name)
    asked = rows.where("q").select("id", "v", F.lit(True).alias("q"), block("a", across), every("b", down))
    seen = rows.select("id", "v", F.lit(False).alias("q"), block("b", down), every("a", across))

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = np.array(column.to_pylist(), float)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 0, size, np.nan)

    def scan(table: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        width = pa.compute.list_value_length(table["v"])
        for dim in pa.compute.unique(width.filter(table["q"])).to_pylist():
            part = table.filter(pa.compute.equal(width, dim))
            some, all_ = part.filter(part["q"]), part.filter(pa.compute.invert(part["q"]))
            if not len(all_):
                continue
            qid, rid, q, r = some["id"].to_numpy(), all_["id"].to_numpy(), unit(some["v"]), unit(all_["v"])
            for at in range(0, len(qid), 256):
                near = np.round(q[at:at + 256] @ r.T, 9)
                near[(qid[at:at + 256, None] == rid[None, :]) | np.isnan(near)] = -np.inf
                least = np.partition(near, -min(k, len(rid)), axis=1)[:, -min(k, len(rid))]
                i, j = np.nonzero((near >= least[:, None]) & np.isfinite(near))
                order = np.lexsort((rid[j], -near[i, j], i))
                i, j = i[order], j[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[first], j[first]
                out.append(pa.table({"query_id": qid[at:at + 256][i], "id": rid[j], "cosine": near[i, j]}))
        none = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        return pa.concat_tables([none, *out])

    found = asked.unionByName(seen).groupBy("a", "b").applyInArrow(scan, "query_id long, id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("id", key)


def warping(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic time warping distances with absolute costs of rows of a to rows of b, all at once."""
    last = np.full((b.shape[1] + 1, len(a)), np.inf)
    last[0] = 0.0
    for i in range(a.shape[1]):
        row = np.full_like(last, np.inf)
        for j in range(1, b.shape[1] + 1):
            row[j] = np.abs(a[:, i] - b[:, j - 1]) + np.minimum(np.minimum(last[j], row[j - 1]), last[j - 1])
        last = row
    return last[-1]


def dtw_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds dtw, the warping distance of two array columns; null where one is null or empty."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = batch.column(batch.schema.get_field_index(a)).to_pylist(), batch.column(batch.schema.get_field_index(b)).to_pylist()
            out, groups = [None] * len(p), {}
            for k, (x, y) in enumerate(zip(p, q)):
                if x and y:
                    groups.setdefault((len(x), len(y)), []).append(k)
            for some in groups.values():
                for k, d in zip(some, warping(np.array([p[k] for k in some], float), np.array([q[k] for k in some], float)).tolist()):
                    out[k] = d
            yield pa.record_batch([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "dtw"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("dtw", DoubleType())]))


def moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of an array column: each task sends one small matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(float)
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "p": [p.ravel().tolist()]})

    rows = df.select(F.col(column).cast("array<double>").alias("v")).mapInPandas(run, "n long, s array<double>, p array<double>")
    sums = rows.select("n", F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "p")).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    x = np.array([r.x for r in sums])
    d = int(round((-1 + np.sqrt(1 + 4 * (len(x) - 1))) / 2))
    n, s, p = int(x[0]), x[1:1 + d], x[1 + d:].reshape(d, d)
    mean = s / n
    return n, mean, p / n - np.outer(mean, mean)


def shrunk(cov: np.ndarray, intensity: float) -> np.ndarray:
    """Covariance pulled towards a multiple of the identity."""
    return (1 - intensity) * cov + intensity * np.trace(cov) / len(cov) * np.eye(len(cov))


def fitted_intensity(n: int, cov: np.ndarray, fourth: float) -> float:
    """How far to pull for the least expected squared error (Ledoit and Wolf, 2004): n rows, their
    covariance with divisor n, and the mean fourth power of the centred rows' lengths."""
    p = len(cov)
    mu = np.trace(cov) / p
    spread = float(((cov - mu * np.eye(p)) ** 2).sum()) / p
    noise = (fourth - float((cov * cov).sum())) / (p * n)
    return 0.0 if spread <= 0 else float(min(max(noise, 0.0), spread) / spread)


def covariance_distances(df: DataFrame, key: str, column: str, components: int, intensity: float | None = None, state: Sequence[float] | None = None, worst: float = 1e12) -> DataFrame:
    """(key, mahalanobis, pca): distances to a state (the mean unless given) under the shrunk covariance, and
    in the leading principal components scaled by their deviations.  The intensity is fitted unless
    given; a matrix whose condition is over `worst` gives no Mahalanobis distance.  The matrices are
    dimension-sized."""
    n, mean, cov = moments(df, column)
    vectors_ = df.select(F.col(column).cast("array<double>").alias("v"))
    if intensity is None:
        centre = F.array(*[F.lit(float(m)) for m in mean])
        square = F.aggregate(F.zip_with("v", centre, lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x)
        intensity = fitted_intensity(n, cov, vectors_.agg(F.avg(square * square)).first()[0])
    pulled = shrunk(cov, intensity)
    sound = np.linalg.cond(pulled) <= worst
    inverse = np.linalg.inv(pulled) if sound else np.full_like(pulled, np.nan)
    values, vectors = np.linalg.eigh(cov)
    lead = vectors[:, ::-1][:, :components] / np.sqrt(np.maximum(values[::-1][:components], 1e-12))
    target = mean if state is None else np.asarray(state, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = np.stack(b["v"].to_numpy()).astype(float) - target
                far = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, inverse, z), 0)) if sound else [None] * len(b)
                yield pd.DataFrame({key: b["id"], "mahalanobis": pd.array(far, "Float64"), "pca": np.linalg.norm(z @ lead, axis=1)})

    return df.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).mapInPandas(run, f"{key} long, mahalanobis double, pca double")


def cluster_states(df: DataFrame, columns: Sequence[str], algorithm: str, ks: Sequence[int], seed: int = 7) -> DataFrame:
    """Adds cluster: k-means or a Gaussian mixture on standardized columns, k by silhouette; clusters
    are numbered by the mean of the first column."""
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(df)
    rows = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(rows).transform(rows).drop("_raw")
    best = None
    for k in ks:
        model = (KMeans(k=k, seed=seed) if algorithm == "kmeans" else GaussianMixture(k=k, seed=seed)).fit(rows)
        out = model.transform(rows)
        sizes = out.select("prediction").distinct().count()
        score = ClusteringEvaluator().evaluate(out) if sizes > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, out)
    out = best[1]
    order = out.groupBy("prediction").agg(F.avg(columns[0]).alias("m")).withColumn("cluster", F.row_number().over(Window.orderBy("m")) - 1)
    return out.join(F.broadcast(order.select("prediction", "cluster")), "prediction").drop("prediction", "features", "probability")


def viterbi(log_emission: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    score, back = np.log(start) + log_emission[0], np.zeros(log_emission.shape, int)
    log_t = np.log(transition)
    for i in range(1, len(log_emission)):
        step = score[:, None] + log_t
        back[i] = step.argmax(0)
        score = step.max(0) + log_emission[i]
    path = np.zeros(len(log_emission), int)
    path[-1] = score.argmax()
    for i in range(len(path) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def viterbi_by_entity(df: DataFrame, entity: str, time: str, value: str, states: int, rounds: int = 15) -> DataFrame:
    """Adds state: hidden states of each entity's series (one series a task call, a row a session)."""
    ship(df.sparkSession)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(time)
        v = x[value].to_numpy(float)
        mean = np.quantile(v, (np.arange(states) + 0.5) / states)
        sd = np.full(states, max(v.std(), 1e-9))
        t = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        path = np.zeros(len(v), int)
        for _ in range(rounds):
            emission = -0.5 * ((v[:, None] - mean) / sd) ** 2 - np.log(sd)
            after = viterbi(emission, t, np.full(states, 1 / states))
            counts = np.ones((states, states))
            np.add.at(counts, (after[:-1], after[1:]), 1)
            t = counts / counts.sum(1, keepdims=True)
            for k in range(states):
                own = v[after == k]
                if len(own) > 1:
                    mean[k], sd[k] = own.mean(), max(own.std(), 1e-6)
            if (after == path).all():
                break
            path = after
        rank = np.argsort(np.argsort(mean))
        return x.assign(state=rank[path].astype("int32"))

    return df.groupBy(entity).applyInPandas(run, StructType([*df.schema.fields, StructField("state", IntegerType())]))


def walk_forward_ridge(df: DataFrame, entity: str, time: str, features: Sequence[str], target: str, horizon: int, folds: int = 4, alpha: float = 1.0, kind: str = "ridge") -> DataFrame:
    """Adds fold and prediction: expanding training windows, the last `horizon` rows before a fold
    purged, scaling from training rows only; kind ridge or logistic (probability of a positive target)."""
    ship(df.sparkSession)

    def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if kind == "ridge":
            return np.linalg.solve(x.T @ x + alpha * np.diag([0.0] + [1.0] * (x.shape[1] - 1)), x.T @ y)
        w, label = np.zeros(x.shape[1]), (y > 0).astype(float)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + alpha * np.eye(x.shape[1])
            w -= np.linalg.solve(h, x.T @ (p - label) + alpha * w)
        return w

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(time).reset_index(drop=True)
        x["fold"], x["prediction"] = np.int32(-1), np.nan
        edges = np.linspace(len(x) * 0.4, len(x), folds + 1).astype(int)
        f = x[list(features)].to_numpy(float)
        y = x[target].to_numpy(float)
        for k in range(folds):
            a, b = edges[k], edges[k + 1]
            train = np.arange(max(0, a - horizon))
            train = train[np.isfinite(f[train]).all(1) & np.isfinite(y[train])]
            if len(train) < 20:
                continue
            m, s = f[train].mean(0), np.maximum(f[train].std(0), 1e-9)
            z = np.hstack([np.ones((len(f), 1)), np.nan_to_num((f - m) / s)])
            w = fit(z[train], y[train])
            p = z[a:b] @ w
            x.loc[a:b - 1, "fold"] = np.int32(k)
            x.loc[a:b - 1, "prediction"] = p if kind == "ridge" else 1 / (1 + np.exp(-p))
        return x[x["fold"] >= 0]

    schema = StructType([*df.schema.fields, StructField("fold", IntegerType()), StructField("prediction", DoubleType())])
    out = df.groupBy(entity).applyInPandas(run, schema)
    return out.withColumn("prediction", F.nanvl("prediction", F.lit(None).cast("double")))


BOOTSTRAPS = ("circular", "moving", "stationary")


def block_positions(n: int, block: int, draws: int, kind: str, random: np.random.Generator) -> np.ndarray:
    """draws x n positions in blocks: circular ones run on past the end from the start, moving ones begin
    where they fit whole, stationary ones have geometric lengths of that mean and run on."""
    if kind == "stationary":
        fresh = random.random((draws, n)) < 1 / block
        fresh[:, 0] = True
        starts = random.integers(0, n, (draws, n))
        since = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
        first = np.take_along_axis(starts, np.arange(n) - since, axis=1)
        return (first + since) % n
    top = n if kind == "circular" else max(n - block + 1, 1)
    starts = random.integers(0, top, (draws, -(-n // block)))
    return ((starts[:, :, None] + np.arange(block)) % n).reshape(draws, -1)[:, :n]


def block_bootstrap(df: DataFrame, entity: str, time: str, value: str, block: int, draws: int = 300, seed: int = 3, kind: str = "circular") -> DataFrame:
    """(entity, n, mean, low, high): block bootstrap of the mean, 95 %, by one of BOOTSTRAPS.  For the gain of
    a model, value is the baseline's error less the model's."""
    if kind not in BOOTSTRAPS:
        raise ValueError(f"kind must be one of {', '.join(BOOTSTRAPS)}")
    ship(df.sparkSession)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        v = x.sort_values(time)[value].dropna().to_numpy(float)
        if not len(v):
            return pd.DataFrame({entity: [], "n": [], "mean": [], "low": [], "high": []})
        means = v[block_positions(len(v), block, draws, kind, np.random.default_rng([seed, len(v)]))].mean(1)
        return pd.DataFrame({entity: [x[entity].iloc[0]], "n": [len(v)], "mean": [v.mean()], "low": [np.quantile(means, 0.025)], "high": [np.quantile(means, 0.975)]})

    types = dict(df.dtypes)[entity]
    return df.groupBy(entity).applyInPandas(run, f"{entity} {types}, n long, mean double, low double, high double")


def clustered_bootstrap(df: DataFrame, cluster: str, value: str, draws: int = 300, seed: int = 3) -> DataFrame:
    """(n, clusters, mean, low, high): whole clusters (days) are drawn, so that rows of one day stay
    together.  A draw is a Poisson weight a cluster, made from its hash: one aggregation, no resampling."""
    per = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    per = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    u = (F.xxhash64(F.col(cluster), F.col("draw"), F.lit(seed)).cast("double") / 2.0**64) + 0.5
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist()
    weight = F.when(F.col("draw") == 0, 1).otherwise(sum(((u >= c).cast("int") for c in cuts), F.lit(0)))
    each = per.withColumn("w", weight).groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"), F.sum("n").alias("n"), F.count("*").alias("clusters"))
    drawn = F.when(F.col("draw") > 0, F.col("m"))
    return each.agg(F.max("n").alias("n"), F.max("clusters").alias("clusters"), F.max(F.when(F.col("draw") == 0, F.col("m"))).alias("mean"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"))


def platt(df: DataFrame, probability: str, label: str, train: Column, strength: float = 1.0) -> DataFrame:
    """Adds calibrated: a logistic fit of the label on the probability's logit over the train rows, with an
    L2 penalty of 1 / (2 * strength) on the slope and none on the intercept; and slope and intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    p = F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), F.col(probability)))
    rows = VectorAssembler(inputCols=["_x"], outputCol="_f").transform(df.withColumn("_x", F.log(p / (1 - p))).withColumn("_y", F.col(label).cast("double")))
    known = rows.where(train)
    n = known.count()
    fit = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=1 / (strength * max(n, 1)), standardization=False, maxIter=200, tol=1e-10).fit(known)
    slope, intercept = float(fit.coefficients[0]), float(fit.intercept)
    return rows.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(slope) * F.col("_x") + F.lit(intercept))))).withColumns({"slope": F.lit(slope), "intercept": F.lit(intercept)}).drop("_x", "_y", "_f")


def regime_candidates(df: DataFrame, columns: Sequence[str], order: str, algorithms: Sequence[str] = ("kmeans", "gmm"), ks: Sequence[int] = (2, 3, 4, 5, 6), train_share: float = 0.7, seed: int = 7) -> DataFrame:
    """(algorithm, k, silhouettes, persistence, smallest share, reproducibility, score) of clusterings fitted
    on the first train_share of the rows in order, which the rest checks.

    score = 0.35 test silhouette + 0.25 persistence (rows with their predecessor's label) + 0.25
    reproducibility (1 less the silhouettes' difference, 0 at least) + 0.15 min(1, smallest share * k).
    Silhouettes are by squared distance; one label alone has -1.  A row a day is expected.
    """
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    w = Window.orderBy(order)
    rows = df.select(*columns, F.row_number().over(w).alias("_n"))
    cut = int(rows.count() * train_share)
    rows = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(rows)
    rows = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(rows.where(F.col("_n") <= cut)).transform(rows).select("_n", "features").persist()
    found = []
    for algorithm in algorithms:
        for k in ks:
            out = (KMeans(k=k, seed=seed) if algorithm == "kmeans" else GaussianMixture(k=k, seed=seed)).fit(rows.where(F.col("_n") <= cut)).transform(rows).select("_n", "features", "prediction")
            parts = [out.where(F.col("_n") <= cut), out.where(F.col("_n") > cut)]
            silhouettes = [ClusteringEvaluator().evaluate(x) if x.select("prediction").distinct().count() > 1 else -1.0 for x in parts]
            same = out.select((F.col("prediction") == F.lag("prediction").over(Window.orderBy("_n"))).cast("double").alias("s")).agg(F.avg("s")).first()[0]
            sizes = {r.prediction: r["count"] for r in out.groupBy("prediction").count().collect()}
            least = min(sizes.get(c, 0) for c in range(k)) / max(1, sum(sizes.values()))
            again = max(0.0, 1 - abs(silhouettes[0] - silhouettes[1]))
            score = 0.35 * silhouettes[1] + 0.25 * (same or 0.0) + 0.25 * again + 0.15 * min(1.0, least * k)
            found.append((algorithm, k, *map(float, silhouettes), float(same or 0.0), float(least), float(again), float(score)))
    rows.unpersist()
    return df.sparkSession.createDataFrame(found, "algorithm string, k int, silhouette_train double, silhouette_test double, persistence double, smallest_share double, reproducibility double, score double")


def elastic_net(df: DataFrame, features: Sequence[str], target: str, train: Column, alpha: float = 0.5, strength: float = 0.01) -> DataFrame:
    """Adds prediction of a pooled elastic net learnt on the train rows only, scaling included."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.na.drop(subset=list(features))
    steps = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
             LinearRegression(featuresCol="_x", labelCol=target, elasticNetParam=alpha, regParam=strength)]
    model = Pipeline(stages=steps).fit(rows.where(train & F.col(target).isNotNull()))
    return model.transform(rows).drop("_raw", "_x")


def nearest_pairs(df: DataFrame, key: str, features: Sequence[str], neighbours: int) -> DataFrame:
    """(src, dst, weight), src < dst: each row and its nearest by squared distance, ties by key.  A pair
    that is near from either side is kept once.  The weight is exp(-distance / scale), the scale the
    median distance of a row to its last kept neighbour.  All pairs are compared: for bounded tables."""
    from chronoframe.operators import windows as W

    a = df.select(F.col(key).alias("src"), *[F.col(c).alias(f"_a{k}") for k, c in enumerate(features)])
    b = df.select(F.col(key).alias("dst"), *[F.col(c).alias(f"_b{k}") for k, c in enumerate(features)])
    gap = sum(((F.col(f"_a{k}") - F.col(f"_b{k}")) ** 2 for k in range(len(features))), F.lit(0.0))
    near = W.top_k(a.join(b, F.col("src") != F.col("dst")).select("src", "dst", gap.alias("gap")), ["src"], [F.col("gap"), F.col("dst")], neighbours, "k")
    scale = near.groupBy("src").agg(F.max("gap").alias("gap")).agg((F.percentile("gap", 0.5) + 1e-8).alias("scale"))
    pairs = near.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("gap").alias("gap"))
    return pairs.join(F.broadcast(scale)).select("src", "dst", F.greatest(F.exp(-F.col("gap") / F.col("scale")), F.lit(1e-12)).alias("weight"))


def spectral_clusters(pairs: DataFrame, k: int, seed_iterations: int = 30) -> DataFrame:
    """(id, cluster) of similarity rows (src, dst, weight > 0) by power iteration."""
    from pyspark.ml.clustering import PowerIterationClustering

    return PowerIterationClustering(k=k, maxIter=seed_iterations, weightCol="weight").assignClusters(pairs)


def select_features(df: DataFrame, features: Sequence[str], train: Column, missing: float = 0.4, floor: float = 1e-9, limit: float = 0.9, cap: int = 35) -> list[str]:
    """Features that are rarely missing, vary (median absolute deviation) and don't repeat a better
    one, by train rows only; the better of two has the larger deviation.  Statistics are one row."""
    pairs = [(a, b) for k, a in enumerate(features) for b in features[:k]]
    with kept(df.where(train).select(*features)) as rows:
        mid = {c: v[0] for c, (_, v) in quantiles(rows, {c: (F.col(c), [0.5]) for c in features}).items()}
        known = [c for c in features if mid[c] is not None]
        gap = {c: v[0] for c, (_, v) in quantiles(rows, {c: (F.abs(F.col(c) - F.lit(mid[c])), [0.5]) for c in known}).items()} if known else {}
        stats = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in features], *[corr(a, b).alias(f"c_{a}|{b}") for a, b in pairs]).first().asDict()
    stats |= {f"d_{c}": gap.get(c) for c in features}
    fit = [c for c in features if stats[f"m_{c}"] is not None and stats[f"m_{c}"] <= missing and (stats[f"d_{c}"] or 0) > floor]
    chosen: list[str] = []
    for c in sorted(fit, key=lambda c: (-stats[f"d_{c}"], c)):
        near = [stats.get(f"c_{c}|{o}", stats.get(f"c_{o}|{c}")) for o in chosen]
        if all(x is None or abs(x) <= limit for x in near) and len(chosen) < cap:
            chosen.append(c)
    return chosen


def tournament(df: DataFrame, entity: str, time: str, features: Sequence[str], target: str, horizon: int) -> DataFrame:
    """(entity, model, n, validation_mae, holdout_mae, winner): zero, mean, ridge models of three
    strengths; the winner has the least validation error, the last 15 % only score it."""
    names = ("zero", "mean", "ridge_0.1", "ridge_1", "ridge_10")
    ship(df.sparkSession)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(time)
        f, y = x[list(features)].to_numpy(float), x[target].to_numpy(float)
        ok = np.isfinite(f).all(1) & np.isfinite(y)
        f, y = f[ok], y[ok]
        n = len(y)
        a, b = int(n * 0.6), int(n * 0.85)
        if a - horizon < 20 or n - b < 5:
            return pd.DataFrame(columns=[entity, "model", "n", "validation_mae", "holdout_mae", "winner"])

        def predict(name: str, end: int) -> np.ndarray:
            t = slice(0, max(0, end - horizon))
            if name == "zero":
                return np.zeros(n)
            if name == "mean":
                return np.full(n, y[t].mean())
            m, s = f[t].mean(0), np.maximum(f[t].std(0), 1e-9)
            z = np.hstack([np.ones((n, 1)), (f - m) / s])
            penalty = float(name.split("_")[1]) * np.diag([0.0] + [1.0] * f.shape[1])
            return z @ np.linalg.solve(z[t].T @ z[t] + penalty, z[t].T @ y[t])

        rows = [(x[entity].iloc[0], k, n, np.abs(y[a:b] - predict(k, a)[a:b]).mean(), np.abs(y[b:] - predict(k, b)[b:]).mean()) for k in names]
        out = pd.DataFrame(rows, columns=[entity, "model", "n", "validation_mae", "holdout_mae"])
        return out.assign(winner=out.index == out["validation_mae"].idxmin())

    return df.groupBy(entity).applyInPandas(run, f"{entity} {dict(df.dtypes)[entity]}, model string, n long, validation_mae double, holdout_mae double, winner boolean")


def permutation_sanity(df: DataFrame, entity: str, time: str, x: str, y: str, draws: int = 200, seed: int = 5) -> DataFrame:
    """(entity, n, correlation, p_value): how often a shuffled series correlates as strongly."""
    ship(df.sparkSession)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(time)
        ok = b[[x, y]].dropna()
        if len(ok) < 10:
            return pd.DataFrame(columns=[entity, "n", "correlation", "p_value"])
        p, q = ok[x].to_numpy(float), ok[y].to_numpy(float)
        p, q = (p - p.mean()) / max(p.std(), 1e-12), (q - q.mean()) / max(q.std(), 1e-12)
        random = np.random.default_rng([seed, len(p)])
        real = float((p * q).mean())
        null = np.array([(random.permutation(p) * q).mean() for _ in range(draws)])
        return pd.DataFrame({entity: [b[entity].iloc[0]], "n": [len(p)], "correlation": [real], "p_value": [(1 + (np.abs(null) >= abs(real)).sum()) / (draws + 1)]})

    return df.groupBy(entity).applyInPandas(run, f"{entity} {dict(df.dtypes)[entity]}, n long, correlation double, p_value double")


def distribution_methods(df: DataFrame, entity: str, time: str, target: str, spread: str, horizon: int, quantiles: Sequence[float] = (0.1, 0.5, 0.9), seed: int = 9) -> DataFrame:
    """(entity, method, n, pinball, coverage): historical, rolling-volatility, residual-bootstrap,
    regime, analog and linear quantile forecasts on the last 30 % of each entity's rows, learnt on
    what was known before."""
    ship(df.sparkSession)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(time)[[entity, target, spread]].dropna()
        y, s = b[target].to_numpy(float), b[spread].to_numpy(float)
        n = len(y)
        a = int(n * 0.7)
        t = slice(0, max(0, a - horizon))
        columns = [entity, "method", "n", "pinball", "coverage"]
        if t.stop < 40 or n - a < 10:
            return pd.DataFrame(columns=columns)
        ty, ts, qs = y[t], s[t], np.array(quantiles)
        random = np.random.default_rng([seed, n])
        test = n - a
        z = np.array([-1.2816, 0.0, 1.2816]) if len(qs) == 3 else np.zeros(len(qs))
        cut = np.median(ts)
        halves = [np.quantile(ty[ts <= cut], qs), np.quantile(ty[ts > cut], qs) if (ts > cut).any() else np.quantile(ty, qs)]
        near = np.argsort(np.abs(s[a:, None] - ts[None, :]), axis=1, kind="stable")[:, :50]
        design = lambda v: np.column_stack([np.ones(len(v)), (v - ts.mean()) / max(ts.std(), 1e-9)])

        def linear(q: float) -> np.ndarray:
            w, x = np.array([np.quantile(ty, q), 0.0]), design(ts)
            rate = 0.05 * max(ty.std(), 1e-9)
            for k in range(400):
                e = ty - x @ w
                w = w + rate / np.sqrt(1 + k) * (x * np.where(e > 0, q, q - 1)[:, None]).mean(0) * 2
            return design(s[a:]) @ w

        forecasts = {
            "historical": np.tile(np.quantile(ty, qs), (test, 1)),
            "rolling_volatility": ty.mean() + s[a:, None] * z * (ty.std() / max(ts.mean(), 1e-9)),
            "residual_bootstrap": np.tile(np.quantile(ty.mean() + random.choice(ty - ty.mean(), 2000), qs), (test, 1)),
            "regime": np.where((s[a:] <= cut)[:, None], halves[0], halves[1]),
            "analog": np.quantile(ty[near], qs, axis=1).T,
            "linear_quantile": np.column_stack([linear(q) for q in qs]),
        }
        rows = []
        for name, f in forecasts.items():
            e = y[a:, None] - f
            rows.append((b[entity].iloc[0], name, test, float(np.maximum(qs * e, (qs - 1) * e).mean()), float(((y[a:] >= f[:, 0]) & (y[a:] <= f[:, -1])).mean())))
        return pd.DataFrame(rows, columns=columns)

    return df.groupBy(entity).applyInPandas(run, f"{entity} {dict(df.dtypes)[entity]}, method string, n long, pinball double, coverage double")
