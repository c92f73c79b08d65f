import math
import random

import numpy as np
import pytest
from making import NOW, catalog, entry, values
from pyspark.sql import functions as F

from trigrove.model import FEATURES, UNIX, WINDOWS
from trigrove.operators import rank as R
from trigrove.operators.usage import access_counts, daily_frecency, file_type_popularity, merge_usage, with_usage
from trigrove.plans.workload import TWO_LEAVES
from trigrove.sources import treemodel


def model_of(spark, text, profile=UNIX):
    return treemodel.tree_model(spark.createDataFrame([(text,)], "value string"), profile)


def report_row(spark, **changes):
    row = {
        "text": "report", "name": "report.pdf", "terms": ["report.pdf"], "entry_type": "File", "path": "/docs/report.pdf", "file_type": "pdf",
        "access_count": 42, "last_accessed": 1_699_999_000, "frecency_score": 42.0, "timestamp": 1_700_000_000, "hour_of_day": 12,
        "day_of_week": 3, "active_app": "Evince", "cwd": "/docs", "share": 0.5, **changes,
    }
    kinds = {"terms": "array<string>", "access_count": "long", "last_accessed": "long", "frecency_score": "double",
             "timestamp": "long", "hour_of_day": "int", "day_of_week": "int", "share": "double"}
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row)
    return R.match_features(spark.createDataFrame([tuple(row.values())], schema))


def features(spark, profile=UNIX, switches=R.FeatureSwitches(), **changes):
    return report_row(spark, **changes).select(R.features_struct(profile, switches).alias("f")).first()["f"].asDict()


def test_twelve_features(spark):
    got = features(spark)
    assert list(got) == list(FEATURES) and all(0.0 <= v <= 1.0 for v in got.values())
    assert got["is_exact_prefix"] == got["active_app_match"] == got["same_directory"] == 1.0
    raw = 42 * 0.8 ** (1000 / 86400)
    assert math.isclose(got["frecency"], raw / (raw + 10))
    assert math.isclose(got["access_count"], math.log(43) / math.log(1001))
    assert got["edit_distance"] == 4 / 999 and got["time_hour_bucket"] == 12 / 23 and got["day_of_week"] == 0.5
    assert got["file_type_popularity"] == 0.5 and got["recency_hours"] == 1000 / 3600 / 720
    unused = features(spark, access_count=0, last_accessed=0, frecency_score=5.0, hour_of_day=99, cwd=None, active_app=None)
    assert unused["recency_hours"] == 1.0 and math.isclose(unused["frecency"], 5 / 15) and unused["time_hour_bucket"] == 1.0
    assert unused["same_directory"] == unused["active_app_match"] == 0.0


def test_switches_and_dialects(spark):
    off = features(spark, switches=R.FeatureSwitches(False, False, False, False))
    assert [off[n] for n in FEATURES[7:]] == [0.0] * 5
    windows = features(spark, WINDOWS, active_app="Microsoft Edge - PDF", cwd="C:\\Docs\\", path="c:\\docs\\report.pdf")
    assert windows["active_app_match"] == windows["same_directory"] == 1.0
    command = dict(entry_type="Command", name="Paint", active_app="paint window", file_type=None)
    assert features(spark, WINDOWS, **command)["active_app_match"] == 1.0
    assert features(spark, UNIX, **command)["active_app_match"] == 0.0


def test_decay_and_counters(spark):
    rows = spark.createDataFrame([(10, 100_000, 0.0), (0, 0, 3.0)], "access_count long, last_accessed long, frecency_score double")
    got = rows.select(daily_frecency(186_400).alias("a"), daily_frecency(186_400, True).alias("b")).collect()
    assert [tuple(r) for r in got] == [(8.0, 8.0), (0.0, 3.0)]
    picks = spark.createDataFrame([(1, 10, 1), (1, 30, 2), (2, 20, 3)], "entry_id long, ts long, seq long")
    counted = access_counts(picks)
    merged = merge_usage(counted, spark.createDataFrame([(1, 1, 25)], counted.schema))
    assert sorted(map(tuple, merged.collect())) == [(1, 3, 25), (2, 1, 20)]
    rows = catalog(spark, entry(1, "a.txt", file_type="txt", count=9, last=1), entry(3, "b.MD", count=1, last=1), entry(4, "none", count=1, last=1))
    used = {r["id"]: (r["access_count"], r["last_accessed"], r["frecency_score"]) for r in with_usage(rows, merged).collect()}
    assert used == {1: (3, 25, 3.0), 3: (1, 1, 0.0), 4: (1, 1, 0.0)}
    shares = {r["file_type"]: r["share"] for r in file_type_popularity(rows, merged).collect()}
    assert shares == {"txt": 3 / 5, "md": 1 / 5}
    assert file_type_popularity(catalog(spark, entry(1, "a.txt"))).count() == 0


def test_fallback_prefers_matches(spark):
    both = spark.createDataFrame(
        [({"is_exact_prefix": 1.0},), ({"frecency": 1.0},), ({"is_levenshtein_match": 1.0},), ({"is_trigram_match": 1.0},)], "m map<string,double>"
    ).select(F.struct(*[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0.0)).alias(n) for n in FEATURES]).alias("features"))
    assert [round(r[0], 9) for r in both.select(R.fallback_score()).collect()] == [0.85, 0.15, 0.765, 0.595]


def test_tree_model(spark):
    model = model_of(spark, TWO_LEAVES)
    rows = spark.createDataFrame([(0.0,), (1.0,)], "x double").select(
        F.struct(*[(F.col("x") if n == "is_exact_prefix" else F.lit(0.0)).alias(n) for n in FEATURES]).alias("features")
    )
    low, high = [r["score"] for r in model.score(rows).orderBy("score").collect()]
    assert math.isclose(low, 0.119203, abs_tol=1e-6) and math.isclose(high, 0.880797, abs_tol=1e-6)
    nan = np.full((1, 12), np.nan, dtype=np.float32)
    assert model.predict(nan)[0] == low  # decision 2: a missing value goes left
    short = TWO_LEAVES.replace("decision_type=2\n", "decision_type=\n")
    assert model_of(spark, short).predict(nan)[0] == low
    assert model_of(spark, short, WINDOWS).predict(nan)[0] == high
    category = model_of(spark, TWO_LEAVES.replace("decision_type=2", "decision_type=1").replace("threshold=0.5", "threshold=1"))
    assert category.predict(np.ones((1, 12), dtype=np.float32))[0] == low
    averaged = model_of(spark, TWO_LEAVES.replace("tree\n", "tree\naverage_output\nsigmoid:0.5\n", 1) + "\nTree=1\nleaf_value=0\n")
    assert math.isclose(averaged.predict(np.ones((1, 12), dtype=np.float32))[0], 1 / (1 + math.exp(-0.5)), rel_tol=1e-6)
    assert model_of(spark, TWO_LEAVES.replace("tree\n", "tree\nsigmoid:0\n", 1), WINDOWS).slope == 1.0


@pytest.mark.parametrize("wrong", [
    TWO_LEAVES.replace("is_exact_prefix ", "", 1), TWO_LEAVES.split("\nTree=")[0], TWO_LEAVES.replace("leaf_value=-2 2", "leaf_value="),
    TWO_LEAVES.replace("threshold=0.5", "threshold=0.5 0.6"), TWO_LEAVES.replace("threshold=0.5", "threshold=abc"),
])
def test_unusable_models(spark, wrong):
    with pytest.raises(treemodel.ModelError):
        model_of(spark, wrong)


def test_missing_model_falls_back(spark, tmp_path):
    assert treemodel.usable_model(spark, str(tmp_path / "none.txt")) is None
    good = tmp_path / "ranker.txt"
    good.write_text(TWO_LEAVES)
    assert treemodel.check_model(spark, str(good)).first()["valid"] is True
    assert treemodel.check_model(spark, str(tmp_path / "none.txt")).first()["valid"] is False


def test_display_and_types(spark):
    got = values(spark, types=F.array(*[R.normal_type(F.lit(t)) for t in ("app", "FILE", "Setting", "cOMMAND")]),
                 stale=R.is_stale(F.lit(10), 12), fresh=R.is_stale(F.lit(10), 11))
    assert got == {"types": ["App", "File", "Setting", "Command"], "stale": True, "fresh": False}
    with pytest.raises(Exception, match="unknown entry type"):
        values(spark, x=R.normal_type(F.lit("unknown")))
    results = spark.createDataFrame(
        [("q", 1, 2**63 - 1, "App", "A", "a.id", None, None, "Tools", 1.0, 0.5), ("q", 2, 2, "File", "b", "/x/b", None, True, None, 0.0, 0.4),
         ("q", 3, 3, "Command", "c", "run c", None, None, "Cat", 0.0, 0.3)],
        "query_id string, rank int, id long, entry_type string, name string, path string, icon_path string, is_dir boolean, category string, frecency_score double, score double",
    )
    shown = R.display_rows(results).orderBy("rank").collect()
    assert [(r["id"], r["subtitle"], r["is_dir"]) for r in shown] == [(str(2**63 - 1), "Tools", False), ("2", "/x", True), ("3", "", False)]
    assert R.class_counts(results).first().asDict() == {"query_id": "q", "apps": 1, "files": 1, "settings": 1, "filled_classes": 3}
    folders = R.containing_folder(catalog(spark, entry(1, "d", path="/x/d", is_dir=True), entry(2, "f", path="/x/f"), entry(3, "a", "App")))
    assert {r["id"]: r["folder"] for r in folders.collect()} == {1: "/x/d", 2: "/x"}


def test_masks_give_the_leaves_of_a_walk(spark):
    """Random trees of up to 64 leaves, with categories, missing values and features that are not there."""
    rng = random.Random(5)

    def grown(n_leaves):
        tree = {k: [] for k in treemodel.ARRAYS}

        def grow(n):
            if n == 1:
                tree["leaf_value"].append(rng.uniform(-2, 2))
                return -len(tree["leaf_value"])
            node = len(tree["split_feature"])
            tree["split_feature"].append(rng.randrange(-1, 14))
            tree["threshold"].append(rng.choice([0.0, 0.25, 0.5, 1.0]))
            tree["decision_type"].append(rng.randrange(4))
            tree["left_child"].append(0)
            tree["right_child"].append(0)
            left = rng.randrange(1, n)
            tree["left_child"][node] = grow(left)
            tree["right_child"][node] = grow(n - left)
            return node

        grow(n_leaves)
        if rng.random() < 0.3:
            tree["decision_type"] = tree["decision_type"][: n_leaves // 2]
        return {k: np.array(v, dtype=np.float32 if treemodel.ARRAYS[k] == "float" else np.int64) for k, v in tree.items()}

    rows = [tuple(rng.choice([0.0, 0.25, 0.3, 0.5, 1.0, float("nan"), None]) for _ in FEATURES) for _ in range(200)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in FEATURES)).select(F.struct(*FEATURES).alias("features"))
    inputs = np.array([[np.nan if v is None else v for v in r] for r in rows], dtype=np.float32)
    for averaged, left in ((False, True), (True, False)):
        model = treemodel.TreeModel([grown(n) for n in (1, 2, 3, 17, 63, 64)], averaged, 0.3, left)
        scored = model.score(frame)
        assert "Python" not in scored._jdf.queryExecution().toString()
        assert np.allclose([r["score"] for r in scored.collect()], model.predict(inputs), atol=1e-12)
    large = treemodel.TreeModel([grown(65)])
    assert np.allclose([r["score"] for r in large.score(frame).collect()], large.predict(inputs))
    looped = {k: np.array(v) for k, v in zip(treemodel.ARRAYS, ([0, 0], [0.5, 0.5], [1, 0], [-1, -1], [0, 0], [1.0]), strict=True)}
    assert treemodel.leaf_masks(looped, True) is None
