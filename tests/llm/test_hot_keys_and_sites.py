"""Site posteriors against plain Python, and keys that many rows share."""

import random

import pytest
from pyspark.sql import functions as F

from panelforge.llm import common, quality_classifier, sharding, tokencount


def sigmoid(x):
    from math import exp

    return 1 / (1 + exp(-x))


def test_posteriors_by_hand(spark):
    """site_sums and posterior against sums of squares and posteriors worked out row by row; null sites are sites."""
    from math import log

    r = random.Random(3)
    level = {h: r.gauss(0, 1.5) for h in ("a", "b", "c", None)}
    rows = [(h, p, level[h] + r.gauss(0, 1) + (p == "x"), r.gauss(-1, 1)) for h in level for p in ("x", "y", None) for _ in range(r.randint(1, 40))]
    scored = spark.createDataFrame(rows, "_host string, _path string, _q double, _t double")
    site = [F.col("_host").eqNullSafe(F.col("h")), F.col("_path").eqNullSafe(F.col("p"))]
    sites = quality_classifier.site_sums(scored).withColumnsRenamed({"_host": "h", "_path": "p"})
    got = scored.join(sites, site).select("_host", "_path", "_q", "_t", *[quality_classifier.posterior(c).alias(f"post_{c}") for c in "qt"]).collect()
    assert len(got) == len(rows)
    mean = lambda v: sum(v) / len(v)
    square = lambda v: sum((x - mean(v)) ** 2 for x in v)
    logit = lambda p: log(p / (1 - p))
    for which, at in (("q", 2), ("t", 3)):
        hosts, paths = {}, {}
        for row in rows:
            hosts.setdefault(row[0], []).append(sigmoid(row[at]))
            paths.setdefault(row[:2], []).append(sigmoid(row[at]))
        every = [x for v in hosts.values() for x in v]
        n, h, p, overall = len(every), len(hosts), len(paths), mean(every)

        def weight(within, freedom, between, sites, spread):
            variance = within / freedom
            excess = (between - sites * variance) / spread
            return min(max(variance / excess, 1.0), 1e6) if excess > 0 else 1e6

        of_host = weight(sum(map(square, hosts.values())), n - h, sum(len(v) * (mean(v) - overall) ** 2 for v in hosts.values()), h - 1, n - sum(len(v) ** 2 for v in hosts.values()) / n)
        of_path = weight(
            sum(map(square, paths.values())),
            n - p,
            sum(len(v) * (mean(v) - mean(hosts[k[0]])) ** 2 for k, v in paths.items()),
            p - h,
            n - sum(sum(len(v) ** 2 for k, v in paths.items() if k[0] == name) / len(hosts[name]) for name in hosts),
        )
        for x in got:
            own = sigmoid(x[f"_{which}"])
            host, path = hosts[x["_host"]], paths[x["_host"], x["_path"]]
            of = (sum(host) - own + of_host * overall) / (len(host) - 1 + of_host)
            rate = (sum(path) - own + of_path * of) / (len(path) - 1 + of_path)
            assert x[f"post_{which}"] == pytest.approx(x[f"_{which}"] + logit(rate) - logit(overall), abs=1e-9)


def test_one_site_takes_the_given_weights(spark):
    found = quality_classifier.site_sums(spark.createDataFrame([("a", "x", 0.5, -1.0), ("a", "x", 1.5, -2.0)], "_host string, _path string, _q double, _t double")).first()
    assert (found["_host_kq"], found["_path_kq"]) == (quality_classifier.HOST_WEIGHT, quality_classifier.PATH_WEIGHT)
    assert quality_classifier.site_sums(spark.createDataFrame([], "_host string, _path string, _q double, _t double")).count() == 0


def test_many_sites_join_alike(spark, monkeypatch):
    """The join of site tables too large to broadcast gives the same rows; so do repeated rows and a very long text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("text", F.repeat("text", 3000)))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    read = lambda: sorted(quality_classifier.classify(docs, labels, keep=["doc_id"]).select("doc_id", F.round("quality_score", 9), F.round("toxicity_score", 9), "kept").collect())
    few = read()
    monkeypatch.setattr(quality_classifier, "BROADCAST_SITES", 0)
    assert read() == few and len(few) == docs.count()


@pytest.mark.parametrize("crowd", [10_000, 500])
def test_rows_with_one_key_are_dealt_out(spark, monkeypatch, crowd):
    monkeypatch.setattr(sharding, "CROWD", crowd)
    docs = spark.range(3000).select(F.when(F.col("id") >= 2000, F.col("id")).alias("doc_id"), F.when(F.col("id") >= 2000, F.col("id").cast("string")).alias("text"))
    slim = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    sizes = [r["n"] for r in sharding._shuffled(slim, ["doc_id", "crc"], ["doc_id", "crc"], 16, 1).groupBy("_bucket").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and (max(sizes) < 400 if crowd == 500 else max(sizes) >= 2000)
    plan = sharding.shard_plan(docs).collect()
    shards = {}
    for r in plan:
        shards.setdefault(r.shard, []).append(r.slot)
    assert len(plan) == 3000 and all(sorted(v) == list(range(len(v))) for v in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_texts_are_encoded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    lengths = spark.range(1000).select((F.col("id") % 17).alias("n_tokens")).mapInArrow(run, "n_tokens long")
    assert tokencount.length_histogram(lengths).count() == 17 and calls.value == 1000


def test_no_private_folder_on_a_cluster(spark):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_folder(Session())
