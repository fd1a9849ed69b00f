import numpy as np
import pytest

from braidwork.llm.mixing import SourceClassifier, features, make_plan, mix_sources

DOC = "doc_id bigint, text string, lang string, source string, copies int"
ASK = "mix_name string, source string, weight double, max_repeats int"


def documents(spark, null_every=0):
    rows = []
    for i in range(1200):
        s = "big" if i % 12 else "small"
        word = "apple pear " if s == "big" else "stone iron "
        source = None if null_every and i % null_every == 0 else s
        rows.append((i, word * (3 + i % 17), "en", source, 9))
    rows += [(5000, None, None, "big", 9), (5001, "", "en", None, 9), (5002, "orphan", "en", "unasked", 9)]
    return spark.createDataFrame(rows, DOC).repartition(4)


@pytest.mark.parametrize("null_every", [0, 7])
def test_shares_are_met_and_repeats_kept(spark, null_every):
    ask = spark.createDataFrame(
        [("m", "big", 3.0, 1), ("m", "small", 1.0, 3), ("m", "absent", 1.0, 2), ("z", "big", 1.0, 2), ("z", "small", 0.0, 2)], ASK
    )
    docs = documents(spark, null_every)
    taken, shares = mix_sources(docs, ask)
    got = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    assert abs(got["m", "big"]["actual_share"] - 0.75) < 0.005
    assert abs(got["m", "small"]["actual_share"] - 0.25) < 0.005
    assert got["m", "absent"]["tokens_taken"] == 0 and abs(got["m", "absent"]["target_share"] - 0.2) < 1e-9
    assert got["z", "big"]["actual_share"] == 1 and got["z", "small"]["docs_taken"] == 0
    rows = taken.collect()
    limit = {("m", "big"): 1, ("m", "small"): 3, ("z", "big"): 2}
    assert all(1 <= r["copies"] <= limit[r["mix_name"], r["source"]] for r in rows)
    assert len({(r["mix_name"], r["doc_id"]) for r in rows}) == len(rows)
    assert not any(r["doc_id"] == 5002 for r in rows)
    for key, r in got.items():
        assert r["tokens_taken"] == sum(x["tokens"] * x["copies"] for x in rows if (x["mix_name"], x["source"]) == key)


def test_size_beyond_what_a_source_holds(spark):
    ask = spark.createDataFrame([("m", "big", 1.0, 1), ("m", "small", 1.0, 2)], ASK)
    taken, shares = mix_sources(documents(spark), ask, total=10**7)
    got = {r["source"]: r for r in shares.collect()}
    assert got["small"]["tokens_taken"] == 2 * got["small"]["tokens_held"]
    assert got["big"]["tokens_taken"] == got["big"]["tokens_held"]


def test_empty_tables(spark):
    docs, ask = documents(spark), spark.createDataFrame([("m", "big", 1.0, 1)], ASK)
    taken, shares = mix_sources(docs.limit(0), ask)
    assert taken.count() == 0 and shares.first()["actual_share"] == 0
    taken, shares = mix_sources(docs, ask.limit(0))
    assert taken.count() == 0 and shares.count() == 0


def test_steps_settle_with_soft_members_and_caps():
    rng = np.random.default_rng(3)
    p, c = rng.dirichlet([1, 1, 1], 500), rng.integers(1, 50, 500)
    ask = [{"mix_name": "m", "source": s, "weight": w, "max_repeats": 2} for s, w in zip("abc", (1.0, 2.0, 3.0))]
    plan = make_plan(ask, {}, (p * c[:, None]).sum(axis=0), list("abc"), None)
    plan.target[:] = np.array([0.1, 0.2, 0.3]) * c.sum()
    for _ in range(400):
        r = plan.rates(p, np.zeros(500, int))
        plan.steps.append((r * c[:, None]).T @ p - plan.target)
    assert (r >= 0).all() and (r <= 2).all()
    sizes = [float((x**2).sum()) for x in plan.steps]
    assert all(b <= a + 1e-6 for a, b in zip(sizes, sizes[1:]))
    assert np.abs(plan.steps[-1]).max() < 1e-3 * c.sum()


def test_classifier_on_held_out_rows():
    rng = np.random.default_rng(5)
    words = [["alpha", "beta", "gamma"], ["delta", "omega", "sigma"]]
    made = [(" ".join(rng.choice(words[i % 2], 12)), i % 2) for i in range(400)]
    x, y = np.stack([features(t, "en") for t, _ in made]).astype(float), np.array([k for _, k in made])
    model = SourceClassifier.fit(x[:200], y[:200], ["a", "b"], np.array([1.0, 1.0]))
    assert (model.posterior(x[200:]).argmax(axis=1) == y[200:]).mean() > 0.95


def test_sizes_alone_tell_sources_apart_and_cells_are_calibrated():
    rng = np.random.default_rng(6)
    sizes = {0: 5, 1: 60}
    made = [(" ".join(rng.choice([f"w{j}x" for j in range(500)], rng.poisson(sizes[k]) + 1)), k) for k in rng.choice(2, 3000, p=[0.8, 0.2])]
    x, y = np.stack([features(t, "en") for t, _ in made]).astype(float), np.array([k for _, k in made])
    model = SourceClassifier.fit(x[:1500], y[:1500], ["a", "b"], np.bincount(y[:1500]).astype(float))
    got = model.shares[model.cells(x[1500:])]
    assert (got.argmax(axis=1) == y[1500:]).mean() > 0.95
    assert abs(got.mean(axis=0)[1] - (y[1500:] == 1).mean()) < 0.03
    assert len(model.centres) <= 64 and np.allclose(model.shares.sum(axis=1), 1)


def test_unlabelled_documents_count_by_their_cell(spark):
    ask = spark.createDataFrame([("m", "big", 1.0, 1), ("m", "small", 1.0, 2)], ASK)
    taken, shares = mix_sources(documents(spark, 7), ask)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["big"]["expected_share"] - 0.5) < 0.01 and abs(got["small"]["expected_share"] - 0.5) < 0.01  # the rest is of the source not asked for
    assert taken.where("copies > 2 or (source = 'big' and copies > 1)").count() == 0
