"""Risk models, severity tiers, similarity search and exact tree attributions."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.operators.aggregates import precision_recall
from caseweave.operators.filters import tier
from caseweave.operators.history import severity_scores
from caseweave.operators.scale import exact_quantiles, top_per_group
from caseweave.session import materialise, scratch_path

TEST_PERCENT = 20  # fixed values
TOP_CATEGORIES = 12
TREES, DEPTH, SEED = 200, 6, 42
STARTS = 10
TIER_QUANTILES = (0.65, 0.90)
TOLERANCE = 1e-6
#: Rows of a task that trains (a forest keeps about a kilobyte a row between its passes), and of one that attributes.
FIT_ROWS, EXPLAIN_ROWS = 100_000, 20_000
#: Units that ``units`` cuts rows into, about. No model is trained on them: a forest draws its bags row by row.
FOREST_UNITS = 400_000


# ---- severity tiers --------------------------------------------------------

def severity_tiers(groups: DataFrame, key: list[str], volume: str, ratio: str, features: list[str], k: int = 3) -> DataFrame:
    """Group rows with PCA coordinates, cluster and tier; empty if there are fewer groups than tiers.

    Features are scaled, clustered into k groups, and the groups are named by the
    mean of 0.6 z(log volume) + 0.4 z(ratio), lowest first.
    """
    groups = materialise(groups.withColumn("_log_volume", F.log1p(F.col(volume).cast("double"))), "groups")
    names = ["LOW", "MEDIUM", "HIGH"] if k == 3 else [f"TIER_{i}" for i in range(k)]
    if groups.limit(k).count() < k:
        return groups.drop("_log_volume").withColumns({
            "pca_x": F.lit(0.0), "pca_y": F.lit(0.0), "severity_score": F.lit(0.0), "severity_tier": F.lit("")
        }).limit(0)
    columns = ["_log_volume" if f == volume else f for f in features]
    model = Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        PCA(k=2, inputCol="_scaled", outputCol="_pca"),
    ]).fit(groups)
    loadings = model.stages[2].pc.toArray()
    size = groups.count()
    # the scaler divides by the sample deviation, the scores by that of the population
    spread = (size / (size - 1)) ** 0.5 if size > 1 else 1.0
    signs = [spread * float(np.sign(loadings[np.argmax(np.abs(loadings[:, j])), j])) for j in range(2)]
    scored = severity_scores(groups, volume, ratio)
    scaled = materialise(model.transform(scored), "scaled")
    starts = [KMeans(k=k, seed=SEED + i, featuresCol="_scaled", predictionCol="_cluster").fit(scaled) for i in range(STARTS)]
    placed = materialise(min(starts, key=lambda m: m.summary.trainingCost).transform(scaled), "tiers")
    ranked = [r["_cluster"] for r in placed.groupBy("_cluster").agg(F.avg("severity_score").alias("m")).orderBy("m", "_cluster").collect()]
    label = F.lit(names[0])
    for rank, cluster in enumerate(ranked):
        label = F.when(F.col("_cluster") == cluster, names[rank]).otherwise(label)
    coords = vector_to_array("_pca")
    return placed.select(
        *[c for c in groups.columns if c != "_log_volume"],
        F.round(coords[0] * signs[0], 4).alias("pca_x"), F.round(coords[1] * signs[1], 4).alias("pca_y"),
        "severity_score", label.alias("severity_tier"),
    )


# ---- similarity ------------------------------------------------------------

def attribute_similarity(pairs: list[tuple[Column, Column]], same_place: Column, same_super: Column) -> Column:
    """Cosine of equally sized one-hot blocks is the share of equal attributes; nulls are
    a value of their own. Bonus 0.05 for the place and 0.02 for the super-place, at most 1; a
    missing place is nobody's neighbour."""
    none = F.lit("NONE")
    equal = sum(((F.coalesce(a, none) == F.coalesce(b, none)).cast("double") for a, b in pairs), F.lit(0.0)) / len(pairs)
    here, near = (F.coalesce(same, F.lit(False)).cast("double") for same in (same_place, same_super))
    return F.least(F.lit(1.0), equal + here * 0.05 + near * 0.02)


def facing(df: DataFrame, few: DataFrame, limit: int = 500) -> DataFrame:
    """Each row of ``df`` beside each row (as struct ``q``) of a small request table.

    The requests travel as one array value of at most ``limit`` rows. More requests are
    cut into that many rows per pass, so what is shipped to a task stays bounded.
    """
    few = materialise(few, "requests")
    passes = max(1, -(-few.count() // limit))
    frames = []
    for i in range(passes):
        chosen = few if passes == 1 else few.where(F.pmod(F.xxhash64(*few.columns), F.lit(passes)) == i)
        array = chosen.agg(F.collect_list(F.struct(*few.columns)).alias("q")).scalar()
        frames.append(df.withColumn("q", F.explode(array)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def similar_cases(cases: DataFrame, requests: DataFrame, key: str, attributes: list[str], place: str, super_place: str, n: int = 10) -> DataFrame:
    """(source, key, similarity, rank) of the ``n`` most similar other cases per request.

    A score only depends on the combination of attributes and place, and ties go to the
    smaller key. So the first n+1 cases of each combination are enough, and requests are
    answered once per combination.
    """
    kind = [*attributes, place, super_place]
    shortlist = top_per_group(cases.select(key, *kind), kind, [F.col(key)], n + 1, "_rk").drop("_rk")
    asked = cases.join(requests.select(key).distinct(), key, "left_semi").select(F.col(key).alias("source"), *kind)
    both = facing(shortlist, asked.select(*kind).distinct())
    score = attribute_similarity(
        [(F.col(a), F.col(f"q.{a}")) for a in attributes],
        F.col(place) == F.col(f"q.{place}"), F.col(super_place) == F.col(f"q.{super_place}"),
    )
    best = top_per_group(
        both.select(key, "q", F.round(score, 4).alias("similarity"), *[F.col(a).alias(f"_{a}") for a in kind]),
        ["q"], [F.col("similarity").desc(), F.col(key)], n + 1, "_rk",
    ).drop("_rk")
    same_kind = [F.col(c).eqNullSafe(F.col(f"q.{c}")) for c in kind]
    condition = same_kind[0]
    for part in same_kind[1:]:
        condition = condition & part
    answered = asked.join(best, condition).where(F.col("source") != F.col(key))
    return top_per_group(answered, ["source"], [F.col("similarity").desc(), F.col(key)], n, "rank").drop("q")


# ---- vectors ---------------------------------------------------------------

def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.try_divide(dot, norm(a) * norm(b))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, key: str, vector: str, n: int = 5) -> DataFrame:
    """(query, key, similarity, rank): cosine top ``n`` for each row of a small query table."""
    both = facing(vectors.select(key, vector), queries.select(F.col(key).alias("query"), F.col(vector).alias("qv")))
    scored = both.where(F.col("q.query") != F.col(key)).select(
        F.col("q.query").alias("query"), key, cosine(F.col("q.qv"), F.col(vector)).alias("similarity")
    )
    return top_per_group(scored, ["query"], [F.col("similarity").desc(), F.col(key)], n, "rank")


# ---- risk model ------------------------------------------------------------

def top_categories(df: DataFrame, column: str, n: int = TOP_CATEGORIES) -> list[str]:
    """The ``n`` most frequent values (name breaks ties): a list of at most n strings."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), column).limit(n).collect()
    return [r[column] for r in rows]


def bucket_rare(df: DataFrame, column: str, keep: list[str], other: str = "OTHER") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(keep), F.col(column)).otherwise(F.lit(other)))


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}_{v}": (F.col(column) == v).cast("int") for v in values})


def in_test_split(entity: Column, percent: int = TEST_PERCENT) -> Column:
    """Entity-level split by hash, so that all rows of an entity fall on one side."""
    return F.pmod(F.xxhash64(entity), F.lit(100)) < percent


def class_weights(df: DataFrame, label: str) -> DataFrame:
    n, positive = df.agg(F.count("*"), F.sum(label)).first()
    positive = positive or 0
    up = n / (2.0 * positive) if positive else 1.0
    down = n / (2.0 * (n - positive)) if n > positive else 1.0
    return df.withColumn("class_weight", F.when(F.col(label) == 1, up).otherwise(down))


def evenly(df: DataFrame, rows: int) -> DataFrame:
    """``df``, written before, dealt and ordered by its columns into tasks of about ``rows`` rows, but one a core at least.

    Files of few bytes a row would otherwise be read by as many tasks as there are cores, however many rows they hold."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *df.columns).sortWithinPartitions(*df.columns)


def train_risk_models(rows: DataFrame, features: list[str], label: str, entity: str, trees: int = TREES, depth: int = DEPTH) -> dict[str, PipelineModel]:
    """Balanced logistic regression and random forest on the training entities.

    Rows alike in features and label count as one weighted row, which changes nothing of the regression. A forest
    draws bags: its rows stay apart, so that each is drawn by itself into the bag of each tree, at any number of rows.
    """
    train = materialise(class_weights(rows.where(~in_test_split(F.col(entity))), label).select(entity, label, "class_weight", *features), "train")
    kinds = materialise(train.groupBy(label, "class_weight", *features).agg(F.count("*").alias("_n")), "trainkinds")
    n = train.count()
    alike_rows = kinds.withColumn("class_weight", F.col("class_weight") * F.col("_n")).drop("_n")
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    shared = {"featuresCol": "features", "labelCol": label, "weightCol": "class_weight"}
    learners = {
        "LOGISTIC_REGRESSION": (alike_rows, LogisticRegression(maxIter=1000, regParam=1.0 / max(n, 1), standardization=False, **shared)),
        "RANDOM_FOREST": (train, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, **shared)),
    }
    return {name: Pipeline(stages=[assembler, learner]).fit(evenly(own, FIT_ROWS)) for name, (own, learner) in learners.items()}


def units(kinds: DataFrame, n: int) -> DataFrame:
    """``_n`` alike rows of each of ``kinds``, ``n`` in all, as equal units with a weight of up to n / ``FOREST_UNITS`` rows each."""
    size = -(-n // FOREST_UNITS)
    parts = F.ceil(F.col("_n") / size)
    cut = kinds.withColumns({"_unit": F.explode(F.sequence(F.lit(1).cast("long"), parts)), "class_weight": F.col("class_weight") * F.col("_n") / parts})
    return materialise(cut.drop("_n"), "units")


def score(model: PipelineModel, rows: DataFrame, out: str = "probability") -> DataFrame:
    drop = [c for c in ("features", "rawPrediction", "prediction") if c not in rows.columns]
    scored = model.transform(rows)
    return scored.withColumn("_p", vector_to_array("probability")[1]).drop("probability").withColumnRenamed("_p", out).drop(*drop)


def evaluate_risk_models(models: dict[str, PipelineModel], rows: DataFrame, label: str, entity: str, prior: str) -> DataFrame:
    """Precision, recall, F1 and AUC on the held-out entities, with the rule prior >= 1 as baseline.

    Rows alike in features, prior and label are scored once and count as often as they occur.
    """
    names = dict.fromkeys([label, prior, *[c for model in models.values() for c in model.stages[0].getInputCols()]])
    test = materialise(rows.where(in_test_split(F.col(entity))).groupBy(*names).agg(F.count("*").alias("_n")), "testkinds")
    truth = F.col(label) == 1
    evaluator = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability", weightCol="_n")
    parts = []
    for name, model in models.items():
        scored = materialise(score(model, evenly(test, EXPLAIN_ROWS)).select(label, "_n", "probability"), "tested")
        auc = evaluator.evaluate(scored)
        parts.append(precision_recall(scored, F.col("probability") >= 0.5, truth, name, "_n").withColumn("roc_auc", F.round(F.lit(auc), 4)))
    parts.append(precision_recall(test, F.col(prior) >= 1, truth, "BASELINE_PRIOR_CASE_RULE", "_n").withColumn("roc_auc", F.lit(None).cast("double")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def select_model(evaluation: DataFrame) -> str:
    """Highest AUC, name breaks ties."""
    return evaluation.where(F.col("roc_auc").isNotNull()).orderBy(F.col("roc_auc").desc(), "rule").first()["rule"]


def feature_importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted model, by magnitude; as long as the feature list."""
    names = model.stages[0].getInputCols()
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else last.coefficients.toArray()
    return sorted(zip(names, map(float, values)), key=lambda kv: (-abs(kv[1]), kv[0]))


def risk_tiers(scored: DataFrame, probability: str) -> DataFrame:
    """Tiers at the 65th and 90th percentile of the scores themselves."""
    medium, high = exact_quantiles(scored, probability, list(TIER_QUANTILES))
    return scored.withColumn("risk_tier", tier(F.col(probability), [(high, "HIGH"), (medium, "MEDIUM")]))


# ---- exact attributions ----------------------------------------------------

# A leaf is (value, {feature: (interval low, interval high, weight share)}).
Leaf = tuple[float, dict[int, tuple[float, float, float]]]
# A packed tree is (features, low, high, share) as leaf x slot arrays, and the leaves' values.
Packed = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Entries (row x leaf x slot) worked on at a time.
ENTRIES_AT_ONCE = 2_000_000


def forest_leaves(model: PipelineModel, spark) -> tuple[list[list[Leaf]], float]:
    """Per tree, each leaf as a box over the features on its path; and the base value.

    A box keeps, per feature, the open-closed interval that leads to the leaf and the
    share of training weight that follows the path at that feature's splits. The
    forest's size is bounded by its tree count and depth, not by the data.
    """
    path = scratch_path(spark, "forest")
    model.stages[-1].write().save(path)
    trees: dict[int, dict[int, dict]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        node = row["nodeData"].asDict(recursive=True)
        trees.setdefault(row["treeID"], {})[node["id"]] = node
    forest, base = [], 0.0
    for nodes in trees.values():
        def weight(i: int) -> float:
            return float(sum(nodes[i]["impurityStats"]))

        def positive(i: int) -> float:
            return float(nodes[i]["impurityStats"][1]) / weight(i)

        leaves, stack = [], [(0, {})]
        while stack:
            i, box = stack.pop()
            node = nodes[i]
            if node["leftChild"] < 0:
                leaves.append((positive(i), box))
                continue
            f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            low, high, share = box.get(f, (-np.inf, np.inf, 1.0))
            left, right = node["leftChild"], node["rightChild"]
            stack.append((left, {**box, f: (low, min(high, cut), share * weight(left) / weight(i))}))
            stack.append((right, {**box, f: (max(low, cut), high, share * weight(right) / weight(i))}))
        forest.append(leaves)
        base += sum(value * float(np.prod([cell[2] for cell in box.values()])) for value, box in leaves)
    return forest, base / len(forest)


def pack_tree(leaves: list[Leaf]) -> Packed:
    """Leaf boxes as arrays, as wide as the longest path. Leaves with fewer features are filled up
    with slots that are always followed and change nothing."""
    slots = max(1, max(len(box) for _, box in leaves))
    features = np.zeros((len(leaves), slots), dtype=np.int64)
    low, high, share = np.full(features.shape, -np.inf), np.full(features.shape, np.inf), np.ones(features.shape)
    for row, (_, box) in enumerate(leaves):
        for slot, feature in enumerate(sorted(box)):
            features[row, slot] = feature
            low[row, slot], high[row, slot], share[row, slot] = box[feature]
    return features, low, high, share, np.array([value for value, _ in leaves])


def alike(x: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each kind, kind of each row): rows between the same cuts of a tree in all its features are of one kind
    and have the same Shapley values."""
    codes, room = np.zeros(len(x), dtype=np.int64), 1
    for f in np.unique(features).tolist():
        cuts = np.concatenate([low[features == f], high[features == f]])
        cuts = np.unique(cuts[np.isfinite(cuts)])
        kinds = len(cuts) + 2
        if room > 2**62 // kinds:
            codes = np.unique(codes, return_inverse=True)[1]
            room = len(x)
        codes = codes * kinds + np.searchsorted(cuts, x[:, f], side="left") + np.isnan(x[:, f])
        room *= kinds
    _, first, same = np.unique(codes, return_index=True, return_inverse=True)
    return first, same


def attribute_rows(x: np.ndarray, trees: list[Packed]) -> np.ndarray:
    """Shapley values of every row, averaged over the trees.

    A leaf contributes value * prod_j (follows_j or share_j): a product game over the features of
    its path. The Shapley value of feature i is value * (follows_i - share_i) times the integral
    over t from 0 to 1 of prod_{j != i} (share_j (1 - t) + follows_j t), as the integrals of
    t^k (1 - t)^(m - 1 - k) are the weights of the subsets of k among m - 1. The integrand is a
    polynomial of degree m - 1, which Gauss-Legendre quadrature with m / 2 nodes integrates exactly.
    Rows that a tree can't tell apart are worked out once.
    """
    phi = np.zeros_like(x)
    for features, low, high, share, values in trees:
        first, same = alike(x, features, low, high)
        nodes, weights = np.polynomial.legendre.leggauss(-(-features.shape[1] // 2))
        target = np.zeros((features.size, x.shape[1]))
        target[np.arange(features.size), features.ravel()] = 1.0
        step = max(1, ENTRIES_AT_ONCE // features.size)
        own = np.zeros((len(first), x.shape[1]))
        for start in range(0, len(first), step):
            cells = x[first[start : start + step]][:, features]
            follows = ((cells > low) & (cells <= high)).astype(float)
            integral = np.zeros_like(follows)
            for t, w in zip((nodes + 1) / 2, weights / 2):
                # shares are above 0, so no factor is 0 inside the interval
                factor = share * (1 - t) + follows * t
                integral += w * factor.prod(axis=2, keepdims=True) / factor
            own[start : start + step] = (values[:, None] * (follows - share) * integral).reshape(len(cells), -1) @ target
        phi += own[same]
    return phi / len(trees)


def forest_cuts(forest: list[list[Leaf]], features: int) -> list[list[float]]:
    """All cuts of a forest, for each feature in order: fewer than the bins it was grown on."""
    cuts: list[set[float]] = [set() for _ in range(features)]
    for leaves in forest:
        for _, box in leaves:
            for f, (low, high, _) in box.items():
                cuts[f] |= {float(c) for c in (low, high) if np.isfinite(c)}
    return [sorted(own) for own in cuts]


def attributions(model: PipelineModel, rows: DataFrame, entity: str) -> DataFrame:
    """(entity, x array, probability, phi array, base_value, reconstructed, reconstruction_error).

    Exact attributions of the forest's positive-class probability, batch by batch in
    Arrow; base + sum(phi) must give the prediction back. Rows between the same cuts of the whole forest
    have the same probability and attributions: they are worked out for one of them and joined to all.
    """
    spark = rows.sparkSession
    names = model.stages[0].getInputCols()
    forest, base = forest_leaves(model, spark)
    shipped = spark.sparkContext.broadcast([pack_tree(leaves) for leaves in forest])

    def place(i: int, own: list[float]) -> Column:
        return F.size(F.filter(F.lit(own), lambda cut: cut < F.col("x")[i]))

    places = [place(i, own) for i, own in enumerate(forest_cuts(forest, len(names))) if own]
    assembled = model.stages[0].transform(rows.select(*names, entity)).select(entity, vector_to_array("features").alias("x"))
    held = materialise(assembled.withColumn("_cell", F.array(*places).cast("array<int>")), "current")
    # the least of each feature lies between the same cuts
    kinds = materialise(held.groupBy("_cell").agg(F.array(*[F.min(F.col("x")[i]) for i in range(len(names))]).alias("x")), "kinds")
    scored = model.stages[-1].transform(evenly(kinds, EXPLAIN_ROWS).withColumn("features", array_to_vector("x")))
    scored = scored.select("_cell", "x", vector_to_array("probability")[1].alias("probability"))
    schema = T.StructType([T.StructField("_cell", T.ArrayType(T.IntegerType())), T.StructField("probability", T.DoubleType()), T.StructField("phi", T.ArrayType(T.DoubleType()))])

    def explain(batches):
        for pdf in batches:
            if len(pdf):
                phi = attribute_rows(np.stack(pdf["x"].to_numpy()).astype(float), shipped.value)
                yield pdf[["_cell", "probability"]].assign(phi=list(phi))

    worked_out = materialise(scored.mapInPandas(explain, schema), "explainedkinds")
    out = evenly(held, EXPLAIN_ROWS).join(worked_out, "_cell").drop("_cell")
    rebuilt = F.lit(base) + F.aggregate("phi", F.lit(0.0), lambda s, v: s + v)
    return out.withColumn("base_value", F.lit(base)).withColumn("reconstructed", rebuilt).withColumn(
        "reconstruction_error", F.abs(F.col("reconstructed") - F.col("probability"))
    )


def check_reconstruction(explained: DataFrame, tolerance: float = TOLERANCE) -> float:
    """Largest reconstruction error; raises above the tolerance."""
    worst = explained.agg(F.max("reconstruction_error")).first()[0] or 0.0
    if worst > tolerance:
        raise RuntimeError(f"attributions miss the prediction by {worst:.2e}")
    return worst


def contributions(explained: DataFrame, features: list[str]) -> Column:
    """array<struct<feature, value, phi>> by magnitude, feature order on ties."""
    names = F.array(*[F.lit(f) for f in features])
    entries = F.transform(
        F.arrays_zip(names.alias("f"), F.col("x").alias("v"), F.col("phi").alias("p")),
        lambda e: F.struct((-F.abs(e["p"])).alias("k"), e["f"].alias("feature"), e["v"].alias("value"), e["p"].alias("phi")),
    )
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"), e["phi"].alias("phi")))


def global_importance(explained: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): mean |phi| over all rows, in one pass."""
    means = explained.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f) for i, f in enumerate(features)])
    return means.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in features])).alias("e")).select("e.*")

