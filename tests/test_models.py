"""Ridge, smoothing, space and the composed encoder against dense numpy, and round trips."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmap.operators import estimators, encoder, ranking, ridge, smoothing, space, vectors
from textmap.sources import coordinates, nifti


def long(spark, m, key="study_id", column="term", names=None):
    names = names or list(range(m.shape[1]))
    kind = "string" if isinstance(names[0], str) else "long"
    rows = [(int(i), names[j], float(m[i, j])) for i, j in np.argwhere(m != 0)]
    return spark.createDataFrame(rows, f"{key} long, {column} {kind}, value double")


def dense(df, rows, columns, key="study_id", column="term"):
    out, at = np.zeros((rows, len(columns))), {c: i for i, c in enumerate(columns)}
    for r in df.collect():
        out[r[key], at[r[column]]] = r["value"]
    return out


def ridge_oracle(x, y, alphas, d):
    """Plain formulas: leave one out by the hat matrix of centred data."""
    n = len(x)
    xc, yc = (x - x.mean(0)) / np.sqrt(d), y - y.mean(0)
    errors = []
    for a in alphas:
        hat = xc @ np.linalg.solve(xc.T @ xc + a * np.eye(x.shape[1]), xc.T) + 1 / n
        errors.append((((yc - hat @ yc) / (1 - np.diag(hat))[:, None]) ** 2).sum(1))
    mean = np.mean(errors, axis=1)
    a = alphas[int(np.argmin(mean))]
    m = np.linalg.solve(xc.T @ xc + a * np.eye(x.shape[1]), xc.T) / np.sqrt(d)[:, None]
    coef = m @ yc
    return a, coef, y.mean(0) - x.mean(0) @ coef, mean, m


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.binomial(3, 0.3, (40, 12)).astype(float)
    true = np.zeros((12, 5))
    true[:2] = rng.normal(size=(2, 5)) * 3
    y = x @ true + rng.normal(size=(40, 5)) * 0.3 + 7
    terms = [f"t{i:02d}" for i in range(12)]
    studies = spark.range(40).select(F.col("id").alias("study_id"))
    m = ridge.moments(long(spark, x, names=terms), long(spark, y, column="target"), studies, terms, list(range(5)))
    return x, y, terms, studies, m


def test_ridge_matches_the_dense_formulas(data):
    x, y, _, _, m = data
    fit = ridge.fit(m)
    a, coef, intercept, mean, filt = ridge_oracle(x, y, ridge.ALPHAS, np.ones(12))
    assert fit.alpha == a
    np.testing.assert_allclose(fit.coef, coef, atol=1e-9)
    np.testing.assert_allclose(fit.intercept, intercept, atol=1e-9)
    np.testing.assert_allclose(fit.loo_error, mean, rtol=1e-9)
    np.testing.assert_allclose(fit.filter_gram, filt @ filt.T, atol=1e-9)
    np.testing.assert_allclose(fit.residual_var, ((x @ coef + intercept - y) ** 2).mean(0), rtol=1e-9)
    d = np.linspace(1, 9, 12)
    fit = ridge.fit(m, penalty=d)
    a, coef, intercept, _, filt = ridge_oracle(x, y, ridge.ALPHAS, d)
    assert fit.alpha == a
    np.testing.assert_allclose(fit.coef, coef, atol=1e-9)
    np.testing.assert_allclose(fit.filter_gram, filt @ filt.T, atol=1e-9)


def test_more_features_than_rows(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(8, 15)), rng.normal(size=(8, 3))
    terms = [f"t{i:02d}" for i in range(15)]
    m = ridge.moments(long(spark, x, names=terms), long(spark, y, column="target"), spark.range(8).withColumnRenamed("id", "study_id"), terms, [0, 1, 2])
    a, coef, *_ = ridge_oracle(x, y, ridge.ALPHAS, np.ones(15))
    fit = ridge.fit(m)
    assert fit.alpha == a
    np.testing.assert_allclose(fit.coef, coef, atol=1e-8)


def test_adaptive_and_selective(spark, data):
    x, y, terms, studies, m = data
    d = ridge.adaptive_penalty(ridge.fit(m))
    assert d.min() == 1 and d.argmin() in (0, 1)
    fit = ridge.fit_selective(m)
    keep = [terms.index(t) for t in fit.terms]
    assert keep == np.flatnonzero(d < d.max()).tolist()
    _, coef, *_ = ridge_oracle(x[:, keep], y, ridge.ALPHAS, d[keep])
    np.testing.assert_allclose(fit.coef, coef, atol=1e-8)
    assert fit.z_maps().shape == (12, 5) and fit.z_maps(full=False).shape == (len(keep), 5)
    assert ridge.fit_adaptive(m).coef.shape == (12, 5)
    model = encoder.LinearModel.of(fit, spark)
    rows = long(spark, x[:6], "doc_id", names=terms)
    got = dense(model.predict(rows), 6, range(5), "doc_id", "target")
    np.testing.assert_allclose(got, x[:6][:, keep] @ coef + fit.intercept, atol=1e-8)
    var = np.einsum("ij,jk,ik->i", x[:6][:, keep], fit.filter_gram, x[:6][:, keep])[:, None] * fit.residual_var
    z = dense(model.z_maps(rows), 6, range(5), "doc_id", "target")
    np.testing.assert_allclose(z, x[:6][:, keep] @ coef / np.maximum(np.sqrt(var), 1e-24), rtol=1e-6)


def test_model_without_variance(spark):
    model = encoder.import_arrays(spark, ["a", "b"], [0, 1, 2], np.ones((3, 2)), 1.0)
    rows = spark.createDataFrame([(0, "a", 2.0)], "doc_id long, term string, value double")
    assert {r.target: r.value for r in model.predict(rows).collect()} == {0: 3.0, 1: 3.0, 2: 3.0}
    for f in (model.prediction_variance, model.z_maps):
        with pytest.raises(ValueError):
            f(rows)
    with pytest.raises(ValueError):
        ridge.Ridge(["a"], [0], np.ones((1, 1)), np.zeros(1)).z_maps()


def test_smoothing(spark):
    rng = np.random.default_rng(0)
    x = rng.binomial(3, 0.3, (30, 7)).astype(float)
    terms = [f"t{i}" for i in range(7)]
    xs = long(spark, x, "doc_id", names=terms)
    v = smoothing.factor(xs, terms, n_components=3, max_rounds=15)
    assert v.shape == (7, 3) and (v >= 0).all() and v.sum() > 0
    table = smoothing.factor_table(spark, v, terms)
    vn = np.zeros_like(v)
    for r in smoothing.normalized_factor(table).collect():
        vn[terms.index(r.term), r.component] = r.value
    norms = np.linalg.norm(vn @ v.T, axis=1)
    assert np.allclose(norms[v.any(axis=1)], 1)
    got = dense(smoothing.smoothed(xs, table, 0.3), 30, terms, "doc_id")
    np.testing.assert_allclose(got, 0.3 * x @ vn @ v.T + 0.7 * x, atol=1e-9)
    np.testing.assert_allclose(dense(smoothing.smoothed(xs, table, 0.0), 30, terms, "doc_id"), x, atol=1e-12)


def test_space(spark):
    grid = space.Grid.regular((8, 9, 10), 2.0, (-4.0, -6.0, 0.0))
    pts = [(1, -4.0, -6.0, 0.0), (1, -3.9, -6.0, 0.1), (1, 12.0, 0.0, 0.0), (2, -4.1, 0.0, 0.0), (2, 5.0, 5.0, 5.0), (None, 0.0, 0.0, 0.0)]
    coords = spark.createDataFrame(pts, "study_id long, x double, y double, z double")
    peaks = {(r.study_id, r.i, r.j, r.k): r.value for r in space.peaks(coords, grid).collect()}
    assert peaks == {(1, 0, 0, 0): 2.0, (2, 4, 5, 2): 1.0, (None, 2, 3, 0): 1.0}
    mask = space.ellipsoid_mask(spark, grid)
    vol = np.zeros(grid.shape)
    vol[0, 0, 0] = 2
    for axis, n in enumerate(grid.shape):
        out = np.zeros_like(vol)
        for k, w in space.gaussian_weights(5.0 / (space.FWHM_PER_SIGMA * 2.0)):
            for i in range(n):
                p = (i + k) % (2 * n)
                src = [slice(None)] * 3
                dst = [slice(None)] * 3
                src[axis], dst[axis] = i, p if p < n else 2 * n - 1 - p
                out[tuple(dst)] += vol[tuple(src)] * w
        vol = out
    got = np.zeros(grid.shape)
    for r in space.smoothed(space.peaks(coords.filter("study_id = 1"), grid), grid, 5.0).collect():
        got[r.i, r.j, r.k] = r.value
    np.testing.assert_allclose(got, vol, atol=1e-12)
    assert got.sum() == pytest.approx(2.0)
    maps = space.coordinates_to_maps(coords, mask, grid, 5.0)
    assert {r.study_id for r in maps.select("study_id").distinct().collect()} == {1, 2}
    full = space.unmasked(maps, mask, spark.createDataFrame([(1,), (3,)], "study_id long"))
    assert full.count() == 2 * mask.count() and full.filter("study_id = 3 AND value <> 0").isEmpty()
    assert grid.resampled(4.0).shape == (5, 5, 6) and np.allclose(grid.resampled((1, 1, 1)).voxel_sizes, 1)


def test_nifti_and_coordinate_files(spark, tmp_path):
    values, affine = np.arange(24, dtype=np.float32).reshape(2, 3, 4), np.diag([2.0, 3.0, 4.0, 1.0])
    affine[:3, 3] = (-1, -2, -3)
    (tmp_path / "m.nii.gz").write_bytes(nifti.dumps(values, affine))
    back, a = nifti.loads((tmp_path / "m.nii.gz").read_bytes())
    np.testing.assert_array_equal(back, values)
    np.testing.assert_allclose(a, affine)
    mask, grid = nifti.read_mask(spark, str(tmp_path / "m.nii.gz"))
    assert mask.count() == 23 and grid.shape == (2, 3, 4)
    with pytest.raises(ValueError):
        nifti.loads(b"\0" * 400)
    (tmp_path / "c.tsv.gz").write_bytes(gzip.compress(b"id\ttable\tx\ty\tz\n7\t1\t1.5\t-2\t3\n"))
    assert [tuple(r) for r in coordinates.read_coordinates(spark, str(tmp_path / "c.tsv.gz")).collect()] == [(7, 1.5, -2.0, 3.0)]
    assert coordinates.data_dir(str(tmp_path / "d")) == str(tmp_path / "d") and (tmp_path / "d").is_dir()


def test_maps_command(spark, tmp_path):
    from textmap.plans import maps_cli

    (tmp_path / "m.nii.gz").write_bytes(nifti.dumps(np.ones((5, 5, 5), np.uint8), np.diag([2.0, 2.0, 2.0, 1.0])))
    (tmp_path / "c.csv").write_text("id,x,y,z\n7,4,4,4\n8,0,0,0\n9,99,0,0\n")
    maps_cli.main([str(tmp_path / "c.csv"), str(tmp_path / "m.nii.gz"), str(tmp_path / "out"), "--fwhm", "3"], spark)
    maps = spark.read.parquet(str(tmp_path / "out"))
    by = dict(space.iter_maps(maps))
    assert set(by) == {7, 8, 9} and by[9] == {0: 0.0} and sum(by[7].values()) == pytest.approx(1.0) and max(by[7], key=by[7].get) == 62


def test_maps_command_writes_volumes(spark, tmp_path):
    from textmap.plans import maps_cli

    (tmp_path / "m.nii.gz").write_bytes(nifti.dumps(np.ones((5, 5, 5), np.uint8), np.diag([2.0, 2.0, 2.0, 1.0])))
    (tmp_path / "c.csv").write_text("id,x,y,z\n7,4,4,4\n9,99,0,0\n")
    maps_cli.main([str(tmp_path / "c.csv"), str(tmp_path / "m.nii.gz"), str(tmp_path / "out"), "--fwhm", "3", "--volumes"], spark)
    found = {p.name: nifti.loads(p.read_bytes()) for p in (tmp_path / "out").iterdir()}
    assert set(found) == {"7.nii.gz", "9.nii.gz"}
    values, affine = found["7.nii.gz"]
    assert values.sum() == pytest.approx(1.0) and values.argmax() == 62 and affine[0, 0] == 2.0 and not found["9.nii.gz"][0].any()


def test_array_files(spark, tmp_path):
    for name, value in {"coef": np.ones((2, 1)), "intercept": np.array([1.0, 2.0]), "selected_features": np.array([1])}.items():
        np.save(tmp_path / f"{name}.npy", value)
    model = encoder.load_arrays(spark, str(tmp_path), ["a", "b"], [0, 1])
    rows = spark.createDataFrame([(0, "a", 5.0), (0, "b", 2.0)], "doc_id long, term string, value double")
    assert {r.target: r.value for r in model.predict(rows).collect()} == {0: 3.0, 1: 4.0}


def test_encoder_finds_its_own_terms(spark, tmp_path):
    terms = [f"feature{i}" for i in range(10, 22)]
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(30, 12)))
    y = x @ (np.eye(12, 6) * 4) + rng.normal(size=(30, 6)) * 0.05
    studies = spark.range(30).withColumnRenamed("id", "study_id")
    model = encoder.SmoothedModel.fit(long(spark, x, names=terms), long(spark, y, column="target"), studies, terms, list(range(6)), n_components=4, max_rounds=4)
    corpus = spark.createDataFrame([(i, terms[i], 1.0) for i in range(4)], "doc_id long, term string, value double")
    meta = spark.createDataFrame([(i, f"title {i}") for i in range(4)], "doc_id long, title string")
    enc = encoder.Encoder(vectors.Vectorizer.from_vocabulary(terms), model, None, corpus, meta)
    queries = spark.createDataFrame([(i, f"about {terms[i]} & more") for i in range(4)], "query_id long, text string")

    def answers(e):
        out = e.explain(queries)
        best = out["similar_documents"].filter("rank = 1").orderBy("query_id").collect()
        shown = out["highlighted_text"].orderBy("query_id").first().highlighted_text
        maps = sorted((r.query_id, r.target, round(r.value, 6)) for r in out["brain_map"].collect())
        return [(r.query_id, r.doc_id, r.title) for r in best], shown, maps, out["similar_words"].count()

    first = answers(enc)
    assert [(q, d) for q, d, _ in first[0]] == [(i, i) for i in range(4)]
    assert "&amp; more" in first[1] and 'standardized_form="feature10" in_model=' in first[1]
    assert sum(r.n_documents for r in enc.document_frequencies().collect()) == 4
    enc.save(str(tmp_path / "model"))
    assert answers(encoder.Encoder.load(spark, str(tmp_path / "model"))) == first
    simple = encoder.SimpleEncoder(enc.vectorizer, model.regression)
    simple.save(str(tmp_path / "simple"))
    again = encoder.SimpleEncoder.load(spark, str(tmp_path / "simple"))
    one = [sorted((r.query_id, r.target, round(r.value, 9)) for r in e.transform(queries)["brain_map"].collect()) for e in (simple, again)]
    assert one[0] == one[1]


def test_ties_rank_by_key(spark):
    rows = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 4, 2.0)], "query_id long, doc_id long, s double")
    assert [(r.doc_id, r["rank"]) for r in ranking.top_per(rows, "query_id", "s", "doc_id", 2).orderBy("rank").collect()] == [(4, 1), (3, 2)]


@pytest.mark.parametrize("make", [lambda: estimators.RidgeEstimator(), lambda: estimators.RidgeEstimator("adaptive"), lambda: estimators.RidgeEstimator("selective"), lambda: estimators.SmoothedEstimator(n_components=3, weight=0.0)])
def test_estimators_share_a_protocol(spark, make):
    rng = np.random.default_rng(8)
    values = np.abs(rng.normal(size=(60, 8)))
    weights = np.zeros((8, 2))
    weights[2, 0], weights[5, 1] = 4.0, -3.0
    out = values @ weights + 0.1 * rng.normal(size=(60, 2))
    terms = [f"t{k}" for k in range(8)]
    x = spark.createDataFrame([(i, terms[j], float(values[i, j])) for i in range(60) for j in range(8)], "study_id long, term string, value double")
    y = spark.createDataFrame([(i, j, float(out[i, j])) for i in range(60) for j in range(2)], "study_id long, target long, value double")
    model = make()
    with pytest.raises(ValueError):
        model.predict(x)
    with pytest.raises(ValueError):
        model.set_params(nothing=1)
    model.set_params(alphas=(0.01, 1.0))
    again = model.clone()
    assert again.get_params() == model.get_params() and model.fit(x, y, terms) is model and not hasattr(again, "model_")
    assert model.score(x, y) > 0.4
    got = {(r.study_id, r.target): r.value for r in model.predict(x, "study_id").collect()}
    assert len(got) == 120 and model.z_maps(x, "study_id").count() > 0
