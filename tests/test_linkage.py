"""Linkage queries against their SQL, invariants of the operators, and the whole pipeline."""

import os
import subprocess
import sys
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from rowkin import queries
from rowkin.operators import blocking, context, decide, evaluate, features, folds
from rowkin.plans import models, pipeline
from rowkin.sources import tables
from rowkin.sources.fixture import Records, Vectors
from rowkin.streaming.records import normalise_stream

SF = "/root/testdata/sf0.001"
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, oracle, name):
    got = queries.QUERIES[name](spark, SF)
    want = oracle.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    other = sorted((tuple(plain(v) for v in r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()), key=str)
    assert len(rows) == len(other)
    for a, b in zip(rows, other, strict=True):
        assert a == b or all(x == y or abs(x - y) < 2e-5 for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_tiles_do_not_change_retrieval(spark):
    v = Vectors(spark, SF)
    both = [sorted(map(tuple, blocking.scored_pairs(v.entities, v.records, 5, tile).select("x", "s", F.round("sim", 9)).collect())) for tile in (7, 4096)]
    assert both[0] == both[1]


def test_ranks_and_exclusivity(spark):
    v = Vectors(spark, SF)
    rows = v.dense.collect()
    of_x = {}
    for r in rows:
        of_x.setdefault(r.x, []).append(r.rx)
    assert all(sorted(k) == list(range(len(k))) for k in of_x.values())
    best = decide.exclusive(v.pairs).collect()
    assert len(best) == len({r.x for r in best}) == len(of_x)
    picked = decide.expected_f05(decide.exclusive(v.pairs))
    scores = {(r.s, r.x): r.q for r in best}
    kept = {}
    for r in picked.collect():
        kept.setdefault(r.s, set()).add(r.x)
    for s, xs in kept.items():
        least = min(scores[s, x] for x in xs)
        assert all(x in xs for (t, x), q in scores.items() if t == s and q > least)


def test_expected_f05_by_enumeration(spark):
    from itertools import product

    qs = [0.9, 0.55, 0.5, 0.1]
    best = spark.createDataFrame([(1, k, q) for k, q in enumerate(qs)] + [(2, 9, 0.01)], "s int, x int, q double")
    got = decide.expected_scores(best).collect()
    assert len(got) == 1
    for k in range(5):
        want = 0.0
        for truth in product((0, 1), repeat=4):
            chance = 1.0
            for q, t in zip(qs, truth, strict=True):
                chance *= q if t else 1 - q
            tp = sum(truth[:k])
            want += chance * ((1.0 if not sum(truth) else 0.0) if k == 0 else 1.25 * tp / (k + 0.25 * sum(truth)))
        assert abs(got[0].e[k] - want) < 1e-12


def test_macro_f05_cases(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "s int, x int")
    truth, predicted = pairs([(1, 1), (1, 2), (2, 3)]), pairs([(1, 1), (1, 1), (3, 9)])
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "s int")
    got = evaluate.macro_f05(predicted, truth, keys).first()
    assert got.n == 4 and abs(got.f05 - (1.25 / (1 + 0.25 * 2) + 0 + 0 + 1) / 4) < 1e-12


def test_pseudo_label_caps(spark):
    rows = [(s, x, 0.99 if s == 0 else 0.1, "A" if x % 2 else "B") for x in range(20) for s in range(4)]
    scores = spark.createDataFrame(rows, "s int, x int, q double, country string")
    assert folds.pseudo_labels(scores).groupBy("y").count().orderBy("y").collect() == [(0.0, 40), (1.0, 20)]
    assert folds.pseudo_labels(scores, "A", 7, 5).count() == 12


def test_feature_contract():
    assert [len(features.STAGE2[v]) for v in ("v1", "v2", "v3", "v4", "v5", "v6")] == [25, 40, 49, 53, 62, 66] and len(features.STAGE1) == 48


def test_tsv_keeps_quotes_and_empties(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta "b" \\x\t\t US\nS1-2\t"open\té\tFR\n')
    got = tables.read_tsv(spark, str(path))
    assert list(map(tuple, got.collect())) == [("S1-1", 'a "b" \\x', "", " US"), ("S1-2", '"open', "é", "FR")]
    tables.write_tsv(got, str(tmp_path / "b"))
    assert sorted(map(tuple, tables.read_tsv(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, got.collect()))


def test_materialised_is_repeated_for_other_inputs(spark, tmp_path):
    path = str(tmp_path / "m")
    assert not tables.done(spark, path)
    assert tables.materialised(spark.range(3), path, "a").count() == 3 and tables.materialised(spark.range(9), path, "a").count() == 3
    assert tables.materialised(spark.range(9), path, "b").count() == 9
    assert tables.fingerprint(spark.range(3), 1) == tables.fingerprint(spark.range(3).repartition(2), 1) != tables.fingerprint(spark.range(4), 1)


def test_lists_in_one_file(spark, tmp_path):
    lists = spark.createDataFrame([("S1-2", "", 1), ("S1-1", "S2-1,S3-4", 2), ("S1-3", None, 3)], "source1_entity_id string, matched_entity_ids string, k int").drop("k").repartition(3)
    tables.write_lists(lists, str(tmp_path / "out.tsv"))
    assert (tmp_path / "out.tsv").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-4\nS1-2\t\nS1-3\t\n"
    assert tables.read_tsv(spark, str(tmp_path / "out.tsv"), tables.TRUTH).count() == 3


def test_extra_round_and_missing_scores(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7), (1, 2, 0.1)], "s int, x int, p double")
    out = context.assembled(rows.select("s", "x"), rows, {"ce": rows.limit(0).select("s", "x", F.col("p").alias("ce"))}, [])
    assert {r.ce for r in out.collect()} == {-12.0}
    got = {(r.s, r.x): (r.ce_rank_x, r.ce_hi_s) for r in context.extra_round(out.withColumn("ce", F.col("p") - 0.4), "ce").collect()}
    assert got == {(1, 1): (2, 1), (2, 1): (1, 1), (1, 2): (1, 1)}


def test_rounds_together_are_rounds_apart(spark):
    pairs = Vectors(spark, SF).pairs.select("s", "x", "p", (F.col("sim") * 10 - 1).alias("ce"), F.col("sim").alias("ce2")).persist()
    together = context.all_rounds(pairs, "p", ("ce", "ce2"))
    apart = context.extra_round(context.scorer_competition(context.competition(pairs), "ce"), "ce2")
    columns = sorted(apart.columns)
    rows = [sorted(tuple(round(r[c], 9) for c in columns) for r in df.collect()) for df in (together, apart)]
    assert sorted(together.columns) == columns and rows[0] == rows[1]


def test_places_are_dense(spark):
    got = blocking.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7), "k").collect()
    assert sorted((r.place, r.k) for r in got) == [(k, k) for k in range(1000)]


def test_empty_inputs(spark):
    v = Vectors(spark, SF)
    none = v.pairs.limit(0)
    assert decide.exclusive(none).count() == context.competition(none.select("s", "x", "p")).count() == decide.expected_f05(none).count() == 0
    assert evaluate.macro_f05(none, v.truth.limit(0), v.keys).first().f05 == 1.0
    assert blocking.block_topk(v.entities.limit(0), v.records).count() == 0


def test_stream(spark, tmp_path):
    r = Records(spark, SF)
    r.primary.select(*tables.RECORD.names).write.parquet(str(tmp_path / "in"))
    normalise_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == r.primary.count()


@pytest.fixture(scope="module")
def rounds(spark, tmp_path_factory):
    """The loop up to v3 with few trees."""
    r = Records(spark, SF)
    columns = tables.RECORD.names
    primary, secondary = r.primary.select(*columns), r.secondary.select(*columns)
    config = pipeline.Config(str(tmp_path_factory.mktemp("work")), top=5, trees={"maxIter": 3, "maxDepth": 3, "minInstancesPerNode": 5}, hot="France")
    base = primary, secondary, r.lists
    trained, scores = pipeline.rounds(base, (primary, secondary), config, "v3")
    return base, config, trained, scores


def test_rounds(rounds):
    (primary, secondary, lists), config, trained, scores = rounds
    assert trained.version == "v3" and list(trained.scorers) == ["ce", "ce2"] and trained.scorers["ce2"].start is trained.scorers["ce"]
    assert trained.method in decide.METHODS and len(trained.stage1.importances(5)) == 5 and trained.stage2.columns == list(features.STAGE2["v3"])
    for df in (trained.report, trained.validation):
        assert df.count() == len(decide.METHODS) and df.filter("score >= 0 AND score <= 1").count() == len(decide.METHODS)
    matches, candidates = pipeline.results(scores, primary, trained.method)
    n = primary.count()
    assert matches.count() == candidates.count() == n
    found, possible = ({(q.s, q.x) for q in tables.truth_pairs(df.toDF("source1_entity_id", "matched_entity_ids")).collect()} for df in (matches, candidates))
    assert found <= possible and len({x for _, x in found}) == len(found)
    truth = {(q.s, q.x) for q in tables.truth_pairs(lists).collect()}
    assert len(found & truth) > 0.5 * len(truth) and len(found & truth) > 0.7 * len(found)
    again, report = pipeline.decide_again(scores, primary, {"US": 0.5})
    assert again.count() == n and {q.country for q in report.collect()} == {"US", "India", "France"}


@pytest.mark.parametrize("version", ["v1", "v4", "v6"])
def test_columns_of_every_version(spark, rounds, version):
    _, config, trained, _ = rounds
    read = lambda name: spark.read.parquet(f"{config.work}/train_{name}")
    split = pipeline.Split(read("norm_s"), read("norm_x"), read("embed_s"), read("embed_x"), read("cand"))
    logits = {c: read("v3_ce").withColumnRenamed("ce", c) for c in pipeline.SCORERS[version]}
    full = pipeline.stage2_columns(read("feat"), read("p1"), logits, version, split)
    assert set(features.STAGE2[version]) <= set(full.columns) and ("sib_rank_x" in full.columns) == (version != "v1")
    assert full.count() == read("p1").count()


def test_missing_scorers(rounds):
    base, config, _, _ = rounds
    with pytest.raises(ValueError, match="ce2"):
        pipeline.train(*base, replace(config, version="v3"))


def test_saved_model_scores_alike_in_another_process(spark, rounds, tmp_path):
    _, config, trained, _ = rounds
    trained.save(str(tmp_path / "model"))
    spark.createDataFrame([("acme group", "acme grp"), ("blue bolt", "red nut")], "text_s string, text_x string").write.parquet(str(tmp_path / "pairs"))
    want = [round(r.ce, 9) for r in trained.scorers["ce2"].score(spark.read.parquet(str(tmp_path / "pairs"))).orderBy("text_s").collect()]
    code = f"""
from pyspark.sql import SparkSession
from rowkin.plans import pipeline
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
trained = pipeline.Trained.load("{tmp_path}/model")
assert trained.method == "{trained.method}" and trained.report.count() == trained.validation.count() == 7 and trained.embed.weights == {trained.embed.weights}
q = trained.stage2.score(spark.read.parquet("{config.work}/train_v3_full"), "q2").select("s", "x", "q2")
both = spark.read.parquet("{config.work}/train_v3_best").join(q, ["s", "x"])
assert both.count() > 0 and both.filter("abs(q - q2) > 1e-9").count() == 0
assert [round(r.ce, 9) for r in trained.scorers["ce2"].score(spark.read.parquet("{tmp_path}/pairs")).orderBy("text_s").collect()] == {want}
print("alike")
"""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=600)
    assert "alike" in done.stdout, done.stderr[-3000:]


def test_out_of_fold(spark):
    df = spark.createDataFrame([(3, 0.1, 0.9), (4, 0.1, 0.9), (0, 0.1, 0.9)], "f int, a double, b double")
    assert [round(r[0], 6) for r in df.select(models.out_of_fold(F.col("f"), F.col("a"), F.col("b"))).collect()] == [0.9, 0.1, 0.5]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(SF)
