import itertools

from pyspark.sql import functions as F

from tidalspan import config
from tidalspan.ml import metrics as M
from tidalspan.ml.automata import learn_mealy
from tidalspan.ml.boosting import AdaBoost
from tidalspan.sources.recordings import load_recordings


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "config.yaml").write_text("a: {x: 1, y: 2}\nb: 1\n")
    (tmp_path / "p.yaml").write_text("a: {y: 3}\n")
    assert config.load("app", {"a": {"x": 0}, "c": 9}, {"b": 5}, None, tmp_path / "p.yaml") == {"a": {"x": 1, "y": 3}, "c": 9, "b": 5}
    assert config.initialize_random(7) == 7 == config.get_seed()


def test_recordings(spark, tmp_path):
    def reader(path):
        for k in range(3):
            yield "/pose", float(k), {"position": {"x": k, "y": -k}}
            yield "/other", float(k), {"z": 1}
        yield "/count", 0.5, {"data": 4}

    topics = {"/pose": ["position.x"], "/count": ["data"]}
    for _ in range(2):  # the second time from the cache
        row = load_recordings(spark, ["a"], topics, reader, f"{tmp_path}/cache").first()
        assert [(s["time"], s["value"]["position.x"]) for s in row["/pose"]] == [(0, 0), (1, 1), (2, 2)]
        assert row["/count"][0]["value"]["data"] == 4


def test_adaboost(spark):
    df = spark.range(200).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", ((F.col("a") > 9) & (F.col("b") > 2)).cast("long"))
    model = AdaBoost(30).learn(df, ["a", "b"], ["y"])
    assert M.Accuracy().compute(model.predict(df), [("y", "y_predicted")]) > 0.95


def test_mealy():
    """Parity of ones seen so far."""
    words = [w for n in range(1, 6) for w in itertools.product((0, 1), repeat=n)]
    say = lambda w: [sum(w[: k + 1]) % 2 for k in range(len(w))]
    machine = learn_mealy((w, say(w)) for w in words)
    assert len(machine.delta) == 2 and machine.run([1, 0, 1, 1, 0, 1, 1, 1]) == say([1, 0, 1, 1, 0, 1, 1, 1])


def test_selector_inspection(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    from tidalspan.sim import selector

    df = spark.range(40).select(F.col("id").cast("double").alias("a"), (F.col("id") > 20).cast("double").alias("y"))
    model = DecisionTreeClassifier(maxDepth=1, featuresCol="f", labelCol="y").fit(VectorAssembler(inputCols=["a"], outputCol="f").transform(df))
    found = selector.nodes(model.toDebugString, ["a"])
    assert [n["condition"] is None for n in found] == [False, True, True] and "a <= 20" in found[0]["condition"]
    assert "If (a <= 20" in selector.as_text(model.toDebugString, ["a"]) and selector.as_dot(model.toDebugString, ["a"]).count("->") == 2


def test_selector_accuracies(spark):
    from tidalspan.sim import selector

    df = spark.createDataFrame([(g, k, float(k), k % 2) for g in range(3) for k in range(10)], "g long, k long, v double, m long")
    flip = lambda samples, before: 1 - before[-1]
    got = {r["kind"]: r["accuracy"] for r in selector.accuracies(df, "g", "k", ["v"], "m", 1, flip).collect()}
    assert got == {"oracle": 1.0, "autoregressive": 1.0}


def test_stream_recorder(spark, tmp_path):
    from tidalspan.streaming.retention import SCHEMA, record

    rows = [(1, 0.0, 1.0, False), (1, 5.0, 1.0, False), (1, 6.0, 1.0, True), (1, 9.0, 1.0, False), (2, 1.0, 1.0, False)]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = record(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 2.0)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["t"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [5.0, 6.0, 9.0]
