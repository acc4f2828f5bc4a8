"""A quality and toxicity classifier with hierarchical empirical-Bayes priors by site.

Evidence: two logistic models over text statistics and over a lexicon of words
and word beginnings, fitted on a bounded sample of labelled documents. The
lexicon holds the features whose smoothed log-odds of the toxic class are
certain enough; its counts come from a grouped aggregation.

Priors: a document's host and path (here its source, and source with language)
have posteriors of their own. Sums over all documents give each host's rate,
shrunk toward the global rate, and each path's, shrunk toward its host's; sparse
sites keep close to the prior. A document's log-odds are its evidence plus its
path's shift from the global rate, made without the document itself.

How many rows a prior weighs as much as comes from the data too: the variance of
probabilities within sites over that between them, for hosts and for paths.

Scale: texts are read twice and never shuffled, and scored once; sites are
aggregated map-side. The model is a few thousand numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint, for_workers
from panelforge.llm.components import skew_join

#: Labelled documents that the models are fitted on, at most: those with the least hash of their id.
SAMPLE = 20_000
#: Features of the lexicon at most, best evidence first.
LEXICON = 4_000
#: Rows that a site's prior weighs as much as, where the sites are too few to estimate it.
HOST_WEIGHT = 50.0
PATH_WEIGHT = 20.0
#: Bounds of the estimate: sites that don't differ at all would give an infinite one.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6
#: Sites (about 100 bytes each) up to which their table is broadcast.
BROADCAST_SITES = 200_000
#: Reject where the posterior of the good class is lower, or that of the toxic class higher.
LEAST_QUALITY = 0.5
MOST_TOXICITY = 0.5
WORD = re.compile(r"[^\W\d_]+")
FEATURES = 12


def statistics(text: str) -> list[float]:
    """Numbers that tell prose from symbol runs, shouting, tables and loops; whole text."""
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(data.sum()))
    words = text.split()
    n = max(1, len(words))
    upper = int(data[65:91].sum()) / size
    symbol = int(data[[ord(c) for c in "#*$%&|<>!"]].sum()) / size
    digit = int(data[48:58].sum()) / size
    fresh = len(set(words)) / n
    loop = sum(map(eq, words, words[1:])) / n
    lines = text.split("\n")
    dup = 1 - len(set(lines)) / len(lines)
    long = np.log1p(n)
    return [np.log(upper + 0.003), np.log(symbol + 0.001), np.log(digit + 0.001), fresh, np.log(loop + 0.003), dup, long, float(symbol > 0.02), float(upper > 0.1), float(loop > 0.05), float(fresh < 0.5), float(n < 10)]


def lexicon_features(text: str) -> list[str]:
    """Words of a text, and their first four and five letters, as they occur."""
    words = WORD.findall(text.lower())
    return [*words, *(w[:5] + "*" for w in words if len(w) > 5), *(w[:4] + "*" for w in words if len(w) > 4)]


@dataclass
class Model:
    """Standardisation, weights and lexicon of the two logistic models."""

    mean: np.ndarray
    scale: np.ndarray
    quality: np.ndarray
    toxicity: np.ndarray
    words: frozenset
    starts: frozenset

    def hits(self, text: str) -> int:
        """Words of the text that the lexicon has, or whose beginning it has."""
        words = WORD.findall(text.lower())
        starts = self.starts
        return sum(1 for w in words if w in self.words or (len(w) > 4 and (w[:4] in starts or w[:5] in starts)))

    def rows(self, stats: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.c_[np.ones(len(stats)), (stats - self.mean) / self.scale]
        t = toxic_features(hits, stats)
        return x @ self.quality, t @ self.toxicity


def toxic_features(hits: np.ndarray, stats: np.ndarray) -> np.ndarray:
    n = np.expm1(stats[:, 6])
    return np.c_[np.ones(len(hits)), np.log1p(hits), np.minimum(hits, 4), hits >= 1, hits >= 2, np.log(hits + 0.5) - np.log(n + 10)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, quality, toxic of at most ``sample`` labelled rows, those with the least hash of their id."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").alias("_id"), "quality", "toxic")
    known = known.orderBy(F.xxhash64("_id"), "_id", "quality", "toxic").limit(sample)
    joined = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "_id")
    return joined.select("text", "quality", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon: int = LEXICON, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model from a bounded sample of labelled rows; None without any."""
    rows = labelled_sample(docs, labels, sample, id_col, text_col)

    def count(batches):
        """How many toxic and other documents of a task have a feature twice, or once."""
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, t in zip(batch.column(0), batch.column(2).to_pylist(), strict=True):
                (toxic if t else clean).update(set(lexicon_features(text.as_py())))
                n[t] += 1
        keys = [None, *(toxic.keys() | clean.keys())]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1], *(toxic[k] for k in keys[1:])], pa.int64()), pa.array([n[0], *(clean[k] for k in keys[1:])], pa.int64())], ["f", "a", "b"])

    counts = rows.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = counts.where("f is null").first()
    if not totals or not totals["a"] + totals["b"]:
        return None
    n_toxic, n_clean = totals["a"], totals["b"]
    # log-odds with half a document more on either side, less two standard errors
    odds = F.log((F.col("a") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("b") + 0.5) / F.lit(n_clean + 1.0))
    sure = odds - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.where("f is not null and a >= 3").withColumn("s", sure).where("s > 1.5").orderBy(F.desc("s"), "f").limit(lexicon).collect()
    words = frozenset(r["f"] for r in best if not r["f"].endswith("*"))
    starts = frozenset(r["f"][:-1] for r in best if r["f"].endswith("*"))
    model = Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), np.zeros(6), words, starts)

    def measure(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            x = np.array([[*statistics(t), model.hits(t)] for t in texts]).reshape(-1, FEATURES + 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.int32())], ["x", "quality", "toxic"])

    # at most ``sample`` rows of a few numbers
    table = rows.mapInArrow(measure, "x array<double>, quality int, toxic int").toArrow()
    # canonical order: sums of floats must not depend on which task ended first
    x = np.array(table.column("x").to_pylist()).reshape(-1, FEATURES + 1)
    quality, toxic = (table.column(c).to_numpy() for c in ("quality", "toxic"))
    order = np.lexsort((*x.T, quality, toxic))
    x, quality, toxic = x[order], quality[order], toxic[order]
    stats, hits = x[:, :FEATURES], x[:, FEATURES]
    model.mean, model.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    model.quality = logistic(np.c_[np.ones(len(x)), (stats - model.mean) / model.scale], quality)
    model.toxicity = logistic(toxic_features(hits, stats), toxic)
    return model


def evidence(docs: DataFrame, model: Model | None, keep: list[str], host: Column, path: Column, text_col: str = "text") -> DataFrame:
    """_row (a struct of the columns ``keep``, if any), _host, _path, _q and _t: log-odds of the good and of the toxic class."""
    own = [F.struct(*keep).alias("_row")] if keep else []
    chosen = for_workers(docs).select(*own, host.alias("_host"), path.alias("_path"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = chosen.schema[:-1].add("_q", "double").add("_t", "double")

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(batch.num_columns - 1)]
            if model is None or not texts:
                q = t = np.zeros(len(texts))
            else:
                q, t = model.rows(np.array([statistics(x) for x in texts]), np.array([model.hits(x) for x in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(q), pa.array(t)], [f.name for f in schema])

    return chosen.mapInArrow(run, schema)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _weight(within: float, freedom: float, between: float, sites: float, spread: float, default: float) -> float:
    """Rows that a prior weighs as much as: the variance within sites over that between them, by the method of moments.

    ``within`` and ``between`` are sums of squares, ``spread`` what a unit of
    variance between sites adds to the latter beyond the former's share.
    """
    if freedom <= 0 or sites <= 0 or spread <= 0 or within <= 0:
        return default
    variance = within / freedom
    excess = (between - sites * variance) / spread
    return min(max(variance / excess, LEAST_WEIGHT), MOST_WEIGHT) if excess > 0 else MOST_WEIGHT


def site_sums(scored: DataFrame) -> DataFrame:
    """_host, _path, and the rows and summed probabilities of the path, its host and all documents.

    Beside them _host_k and _path_k of either class: how many rows the prior of
    a host and of a path weighs as much as, estimated from how much sites differ.
    """
    rows = {"q": _sigmoid(F.col("_q")), "t": _sigmoid(F.col("_t"))}
    sums = [F.count(F.lit(1)).alias("_path_n")]
    sums += [x for c, p in rows.items() for x in (F.sum(p).alias(f"_path_{c}"), F.sum(p * p).alias(f"_path_{c}{c}"))]
    paths = checkpoint(scored.groupBy("_host", "_path").agg(*sums))
    hosts = paths.groupBy(F.col("_host").alias("_h")).agg(*[F.sum(f"_path_{c}").alias(f"_host_{c}") for c in ("n", "q", "t", "qq", "tt")], F.count(F.lit(1)).alias("_paths"), F.sum(F.col("_path_n") * F.col("_path_n")).alias("_path_nn"))
    hosts = checkpoint(hosts)
    joined = paths.join(hosts.select("_h", "_host_n", "_host_q", "_host_t"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    off = lambda c: F.sum(F.col("_path_n") * (F.col(f"_path_{c}") / F.col("_path_n") - F.col(f"_host_{c}") / F.col("_host_n")) ** 2)
    lone = lambda level, c: F.sum(F.col(f"_{level}_{c}{c}") - F.col(f"_{level}_{c}") ** 2 / F.col(f"_{level}_n"))
    some = joined.agg(*[x for c in rows for x in (off(c).alias(f"off_{c}"), lone("path", c).alias(f"lone_{c}"))]).first()
    total = hosts.agg(
        *[F.coalesce(F.sum(f"_host_{c}"), F.lit(0)).alias(c) for c in ("n", *rows)],
        *[x for c in rows for x in (lone("host", c).alias(f"lone_{c}"), F.sum(F.col(f"_host_{c}") ** 2 / F.col("_host_n")).alias(f"square_{c}"))],
        F.count(F.lit(1)).alias("hosts"),
        F.coalesce(F.sum("_paths"), F.lit(0)).alias("paths"),
        F.sum(F.col("_host_n") * F.col("_host_n")).alias("nn"),
        F.sum(F.col("_path_nn") / F.col("_host_n")).alias("inner"),
    ).first()
    known = []
    for c in rows:
        n, h, p = total["n"], total["hosts"], total["paths"]
        apart = total[f"square_{c}"] - total[c] ** 2 / n if n else 0.0
        host = _weight(total[f"lone_{c}"] or 0.0, n - h, apart, h - 1, n - total["nn"] / n if n else 0.0, HOST_WEIGHT)
        path = _weight(some[f"lone_{c}"] or 0.0, n - p, some[f"off_{c}"] or 0.0, p - h, n - (total["inner"] or 0.0), PATH_WEIGHT)
        known += [F.lit(host).alias(f"_host_k{c}"), F.lit(path).alias(f"_path_k{c}")]
    return joined.drop("_path_qq", "_path_tt").select("*", *[F.lit(float(total[c])).alias(f"_all_{c}") for c in ("n", *rows)], *known)


def posterior(which: str) -> Column:
    """The class's log-odds with the path's prior in place of the global one; the document itself is taken out of its site's sums."""
    own = _sigmoid(F.col(f"_{which}"))
    overall = F.try_divide(F.col(f"_all_{which}"), F.col("_all_n"))
    of_host, of_path = F.col(f"_host_k{which}"), F.col(f"_path_k{which}")
    host = (F.col(f"_host_{which}") - own + of_host * overall) / (F.col("_host_n") - 1 + of_host)
    path = (F.col(f"_path_{which}") - own + of_path * host) / (F.col("_path_n") - 1 + of_path)
    return F.col(f"_{which}") + _logit(path) - _logit(overall)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` (all columns by default) of every row with quality_score, toxicity_score and kept.

    ``host`` and ``path`` default to ``source`` and to ``lang`` within it; null
    ones are sites like any others. Null texts count as empty. Without labels
    the evidence is even and every row is kept. Rows of unlabelled documents
    count in their sites' sums like labelled ones; repeated rows each count.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("quality_score", "toxicity_score", "kept")]
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    site = F.xxhash64(F.col("_host").isNull(), "_host", F.col("_path").isNull(), "_path")
    # scored once: the sums of the sites and the documents' own posteriors both read it
    scored = checkpoint(evidence(docs, model, keep, host, path, text_col).withColumn("_site", site))
    sites = checkpoint(site_sums(scored).withColumn("_site", site).drop("_host", "_path"))
    scored = scored.drop("_host", "_path")
    # rows stay where they are as long as the sites are few
    joined = scored.join(F.broadcast(sites), "_site", "left") if sites.count() <= BROADCAST_SITES else skew_join(scored, sites, "_site", "left")
    found = joined.withColumns({"quality_score": _sigmoid(posterior("q")), "toxicity_score": _sigmoid(posterior("t"))})
    verdict = (F.col("quality_score") >= LEAST_QUALITY) & (F.col("toxicity_score") <= MOST_TOXICITY) if model else F.lit(True)
    return found.select("_row.*", "quality_score", "toxicity_score", verdict.alias("kept"))
