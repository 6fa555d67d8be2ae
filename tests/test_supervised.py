import numpy as np
from pyspark.sql import functions as F

from patronage.operators import explain as EX
from patronage.operators import supervised as SU


def _data(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    r, f, m = rng.exponential(30, n), rng.poisson(5, n) + 1.0, rng.lognormal(3, 1, n)
    age = rng.integers(18, 70, n).astype(float)
    ltv = np.maximum(5 * f + 1.2 * m - 0.3 * r + 0.5 * age + rng.normal(0, 10, n), 1)
    logit = 0.04 * r - 0.35 * f - 0.08 * np.log1p(m) - 1
    churn = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    rows = [(i, float(a), float(b), float(c), float(d), float(e), int(g))
            for i, (a, b, c, d, e, g) in enumerate(zip(r, f, m, age, ltv, churn))]
    return spark.createDataFrame(rows, "customer_id long, recency double, frequency double, monetary double, "
                                       "age double, ltv double, churn int")


FEATS = ["recency", "frequency", "monetary", "age"]


def test_ridge_matches_closed_form(spark):
    df = _data(spark)
    tr = SU.train_regression(df, FEATS, "ltv", name="ridge", alpha=1.0)
    d = SU.split(df, "customer_id").where(~F.col("is_test")).toPandas()
    X = d[FEATS].to_numpy(float)
    X = (X - X.mean(axis=0)) / X.std(axis=0)
    y = d["ltv"].to_numpy(float)
    w = np.linalg.solve(X.T @ X + np.eye(len(FEATS)), X.T @ (y - y.mean()))
    assert np.allclose(tr.model.coefficients.toArray(), w, rtol=1e-6, atol=1e-6)
    assert tr.metrics["test_r2"] > 0.5


def test_split_fraction_and_classifier(spark):
    df = _data(spark)
    frac = SU.split(df, "customer_id").agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert 0.12 < frac < 0.28
    tr = SU.train_classifier(df, FEATS, "churn", name="logistic_regression")
    assert tr.metrics["roc_auc"] >= 0.5
    p = SU.predict_churn(tr, df, 0.5).toPandas()
    assert set(p.churn_prediction) <= {0, 1} and p.churn_probability.between(0, 1).all()
    hr = SU.high_risk(tr, df, 0.7).toPandas()
    assert (hr.churn_probability >= 0.7).all()


def test_explanations(spark):
    df = _data(spark, 300, 1)
    tr = SU.train_classifier(df, FEATS, "churn", name="random_forest", n_estimators=20)
    sv = EX.shapley_sampling(tr, df, n_permutations=8, background=50).toPandas()
    fx = SU.churn_probability(tr, df).toPandas().set_index("customer_id").churn_probability
    total = sv.set_index("customer_id")[FEATS].sum(axis=1)
    assert abs((fx[total.index] - total).mean() - sv.expected_value.iloc[0]) < 0.05
    pi = EX.permutation_importance(tr, df, "churn", n_repeats=3).toPandas()
    assert set(pi.feature) == set(FEATS) and (pi.importance_std >= 0).all()
    top = EX.contributions(df, FEATS, {"recency": 1.0, "frequency": -2.0, "monetary": 0.5, "age": 0.0}, top_k=2)
    assert all(len(r.top_features) == 2 for r in top.collect())


def test_exact_stratified_split(spark):
    df = _data(spark, 400, 3)
    s = SU.split(df, "customer_id", 0.2, exact=True).toPandas()
    assert s.is_test.sum() == 80
    st = SU.split(df, "customer_id", 0.2, exact=True, stratify="churn").toPandas()
    assert st.is_test.sum() == 80
    for c, grp in st.groupby("churn"):
        assert abs(grp.is_test.sum() - 0.2 * len(grp)) <= 1


def test_permutation_scorings(spark):
    df = _data(spark, 300, 4)
    tr = SU.train_classifier(df, FEATS, "churn", name="logistic_regression")
    for scoring in ("accuracy", "f1"):
        pi = EX.permutation_importance(tr, df, "churn", n_repeats=2, scoring=scoring).toPandas()
        assert len(pi) == len(FEATS) and np.isfinite(pi.importance_mean).all()


def test_models_share_a_preparation(spark, monkeypatch):
    """Several models cost one preparation and come out as if trained alone."""
    from patronage.operators import supervised as module
    df = spark.createDataFrame([(i, float(i % 13), float(i * 7 % 11), float(i % 13 + i % 3), int(i % 13 > 6)) for i in range(200)],
                               "customer_id long, a double, b double, ltv double, churn int")
    alone = [module.train_regression(df, ["a", "b"], name=n) for n in ("ridge", "linear")]
    fitted, fit = [], module.fit_preparation
    monkeypatch.setattr(module, "fit_preparation", lambda *args: fitted.append(1) or fit(*args))
    both = module.train_regressions(df, ["a", "b"], names=("ridge", "linear"))
    assert [(t.name, t.metrics, t.weights) for t in both] == [(t.name, t.metrics, t.weights) for t in alone]
    kinds = module.train_classifiers(df, ["a", "b"], names=("logistic_regression", "gradient_boosting"), n_estimators=2)
    assert [t.name for t in kinds] == ["logistic_regression", "gradient_boosting"] and len(fitted) == 2


def test_fits_read_few_tasks(spark, monkeypatch):
    """However many partitions the rows come in, a fit scans them in two tasks a core, and all of them."""
    df = _data(spark).repartition(150)
    most, met = 2 * spark.sparkContext.defaultParallelism, []
    for kind in ("classifier", "regressor"):
        def estimator(*a, make=getattr(SU, kind), **kw):
            model = make(*a, **kw)
            fit = model.fit
            model.fit = lambda tr: met.append((tr.rdd.getNumPartitions(), tr.count())) or fit(tr)
            return model
        monkeypatch.setattr(SU, kind, estimator)
    SU.train_classifier(df, FEATS, "churn")
    SU.train_regression(df, FEATS, "ltv")
    rows = [SU.split(df, "customer_id", exact=True, stratify="churn"), SU.split(df, "customer_id")]
    assert [n for _, n in met] == [x.where("NOT is_test").count() for x in rows]
    assert all(parts <= most for parts, _ in met)
    assert SU.held(df, 151 * SU.FIT_ROWS).rdd.getNumPartitions() == 150  # many rows stay as many tasks
