"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic), each with a probability that its documents
stay: ``BUDGET`` at first. Raking multiplies it by a factor for each source, each language and each
topic in turn, with 1 as the upper bound of the product, until the expected tokens of every level are
the target share of ``BUDGET`` of all tokens. Since the bound is inside the loop, the sample has the
target marginals, not only the weights before a cut. If that is not reached in ``ROUNDS`` rounds to
``TOLERANCE``, the targets ask for more tokens than there are: given targets then raise ValueError.
Whether a document stays depends only on its doc_id and its probability.

Targets are shares by level value (None: null), for any of the three marginals. Those not given are
tempered shares of tokens, share ** exponent, made to sum to 1, or as many tenths of the way there from the
shares of the corpus as the bound allows. Topics are
clusters of hashed words (spherical k-means over all documents, from seeds among ``TOPIC_SAMPLE``
distinct ones); every document gets one. Tokens are words between white space. Cells are counted over all documents. They are raked on
the driver up to ``MAX_CELLS``, beyond that by Spark joins on the stored table of cells: the same steps to the same tolerance.

A null source or language is a level of its own. Null and empty texts have no tokens and topic 0;
they stay by the probability of their cell, or by ``BUDGET`` where its levels have none. Rows that repeat are decided alike. An empty table gives an
empty result. Other columns are kept by mix_documents().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Texts, Words, read, scratch, store, text_slices

BUDGET = 0.75
#: Exponents of the default targets: 1 keeps the shares of the corpus, 0 makes all levels equal.
EXPONENTS = {"source": 0.5, "lang": 0.8, "topic": 0.7}
TOPICS = 8
TOPIC_SAMPLE = 2000
FEATURES = 256
MAX_CELLS = 200_000
ROUNDS = 400
TOLERANCE = 1e-7
#: Odds stay below this where targets can't be met.
MOST = 1e100
MARGINS = ("source", "lang", "topic")


def _word_shares(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(square-rooted, normed counts of hashed words by text, words by text)."""
    words = Words(texts, SPACE)
    bucket = (words.hashes >> np.uint64(56)).astype(np.int64)
    counts = np.bincount(words.text_of() * FEATURES + bucket, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)
    vectors = np.sqrt(counts)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), np.diff(words.first)


def _vectors(documents: DataFrame) -> DataFrame:
    """v: the vector of each text with words, as the bytes of FEATURES float32 numbers."""

    def run(batches):
        for batch in batches:
            for _, _, texts in text_slices(batch.column("text")):
                vectors, n = _word_shares(texts)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors[n > 0].astype(np.float32)], pa.binary())], names=["v"])

    return documents.select("text").mapInArrow(run, "v binary")


def _sums(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Sum of the vectors nearest to each centre, in units of 2^-30: whole numbers, so that their order doesn't matter."""

    def run(batches):
        total = np.zeros((len(centres), FEATURES), np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)
            near = (x @ centres.T).argmax(1)
            whole = np.rint(x * (1 << 30)).astype(np.int64)
            for k in np.unique(near):
                total[k] += whole[near == k].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = [np.frombuffer(r["s"], np.int64) for r in vectors.mapInArrow(run, "s binary").collect()]
    return np.sum(parts, axis=0).reshape(len(centres), FEATURES)


def fit_topics(documents: DataFrame, topics: int = TOPICS, sample: int = TOPIC_SAMPLE, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """Centres (topic by hashed word): k-means over all documents, from distinct vectors with the smallest hashes."""
    with scratch():
        return _k_means(store(_vectors(documents)), topics, sample, rounds, seed)


def _k_means(vectors: DataFrame, topics: int, sample: int, rounds: int, seed: int) -> np.ndarray:
    hashed = vectors.select(F.xxhash64("v", F.lit(seed)).alias("h"), "v")
    first = hashed.select("h").distinct().orderBy("h").limit(sample)
    seeds = [np.frombuffer(r["v"], np.float32).astype(float) for r in hashed.join(F.broadcast(first), "h").groupBy("h").agg(F.min("v").alias("v")).orderBy("h").collect()]
    if len(seeds) < topics:
        return np.eye(topics, FEATURES)
    centres = np.stack(seeds)[np.random.default_rng(seed).choice(len(seeds), topics, replace=False)]
    for _ in range(rounds):
        sums = _sums(vectors, centres).astype(float)
        new = np.where(sums.any(1, keepdims=True), sums, centres)
        new /= np.linalg.norm(new, axis=1, keepdims=True)
        if (new == centres).all():
            break
        centres = new
    return centres


def with_topics(documents: DataFrame, centres: np.ndarray) -> DataFrame:
    """``documents`` with topic and n_tokens (replaced, if they are there)."""
    documents = documents.drop("topic", "n_tokens")
    schema = documents.withColumn("topic", F.lit(0)).withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text")):
                vectors, n = _word_shares(texts)
                topic = np.where(n > 0, (vectors @ centres.T).argmax(1), 0).astype(np.int32)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(topic), pa.array(n.astype(np.int64))], names=[*part.schema.names, "topic", "n_tokens"])

    return documents.mapInArrow(run, schema)


def _check_targets(targets: dict[str, dict]) -> None:
    for m, shares in targets.items():
        if m not in MARGINS or any(not x >= 0 for x in shares.values()) or abs(sum(shares.values()) - 1) > 1e-6:
            raise ValueError(f"targets of {m} must be shares by level that sum to 1, of one of {MARGINS}")


def _plain(level):
    return None if pd.isna(level) else level


def _local_goals(cells: pd.DataFrame, budget: float, targets: dict[str, dict], part: float) -> dict[str, pd.Series]:
    """Expected tokens of each level, by margin; ``part`` of the way from the shares of the corpus to tempered ones."""
    goals, total = {}, float(cells["tokens"].sum())
    for m in MARGINS:
        have = cells.groupby(m, dropna=False)["tokens"].sum().astype(float)
        if m in targets:
            missing = [k for k, x in targets[m].items() if x > 0 and k not in {_plain(v) for v in have[have > 0].index}]
            if missing:
                raise ValueError(f"no tokens of {m} {missing}")
            share = pd.Series([targets[m].get(_plain(v), 0.0) for v in have.index], have.index, dtype=float)
        else:
            raised = have ** EXPONENTS[m] * (have > 0)
            share = part * raised / max(raised.sum(), 1e-300) + (1 - part) * have / max(total, 1e-300)
        goals[m] = budget * total * share
    return goals


def _rake_here(cells: pd.DataFrame, budget: float, goals: dict[str, pd.Series]) -> tuple[np.ndarray, bool]:
    """The probability of each cell, and whether all goals are met."""
    tokens, odds = cells["tokens"].to_numpy(float), np.full(len(cells), float(budget))
    levels = {}
    for m in MARGINS:
        code, names = pd.factorize(cells[m], use_na_sentinel=False)
        goal = {_plain(k): g for k, g in goals[m].items()}
        levels[m] = code, np.array([goal[_plain(v)] for v in names], float)
    for _ in range(ROUNDS):
        off = 0.0
        for code, goal in levels.values():
            have = np.bincount(code, tokens * np.minimum(odds, 1), len(goal))
            factor = np.divide(goal, have, out=np.ones_like(have), where=have > 0)
            off = max(off, float(np.abs(factor - 1)[goal > 0].max(initial=0)))
            odds = np.minimum(odds * factor[code], MOST)
        if off < TOLERANCE:
            return np.minimum(odds, 1), True
    return np.minimum(odds, 1), False


def _spark_goals(cells: DataFrame, budget: float, targets: dict[str, dict], part: float) -> dict[str, DataFrame]:
    """As _local_goals(): (level, goal) by margin."""
    goals, total = {}, float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for m in MARGINS:
        have = cells.groupBy(F.col(m).alias("level")).agg(F.sum("tokens").cast("double").alias("have"))
        if m in targets:
            want = cells.sparkSession.createDataFrame([(k, float(x)) for k, x in targets[m].items()], cells.select(F.col(m).alias("_level"), F.lit(0.0).alias("share")).schema)
            both = have.join(want, F.col("level").eqNullSafe(F.col("_level")), "full")
            missing = both.where("share > 0 AND coalesce(have, 0) = 0").limit(5).collect()
            if missing:
                raise ValueError(f"no tokens of {m} {[r['_level'] for r in missing]}")
            shares = both.where("have IS NOT NULL").select("level", F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            raised = have.withColumn("raised", F.when(F.col("have") > 0, F.col("have") ** EXPONENTS[m]).otherwise(0.0))
            norm = max(raised.agg(F.sum("raised")).first()[0] or 0.0, 1e-300)
            shares = raised.select("level", (part * F.col("raised") / norm + (1 - part) * F.col("have") / max(total, 1e-300)).alias("share"))
        goals[m] = store(shares.select("level", (F.col("share") * (budget * total)).alias("goal")))
    return goals


def _rake_in_spark(cells: DataFrame, budget: float, goals: dict[str, DataFrame]) -> tuple[DataFrame, bool]:
    """As _rake_here(), for tables of cells that are too large for the driver: ``cells`` with probability."""
    now = cells.withColumn("odds", F.lit(float(budget)))
    done = lambda: now.withColumn("probability", F.least(F.lit(1.0), "odds")).drop("odds")
    for _ in range(ROUNDS):
        off = 0.0
        for m in MARGINS:
            have = now.groupBy(F.col(m).alias("_level")).agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), "odds")).alias("have")).where("have > 0")
            factor = store(have.join(goals[m], F.col("level").eqNullSafe(F.col("_level"))).select("level", (F.col("goal") / F.col("have")).alias("factor"), "goal"))
            off = max(off, factor.where("goal > 0").agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            now = store(now.join(factor.drop("goal"), now[m].eqNullSafe(F.col("level")), "left").withColumn("odds", F.least(F.lit(MOST), F.col("odds") * F.coalesce("factor", F.lit(1.0)))).drop("level", "factor"))
        if off < TOLERANCE:
            return done(), True
    return done(), False


def _first_met(budget: float, given: dict[str, dict], attempt):
    """The outcome of attempt(part) for the largest part, in tenths, that meets its goals."""
    for tenths in range(10, -1, -1):
        made, met = attempt(tenths / 10)
        if met:
            return made
        if given.keys() >= set(MARGINS):
            break
    raise ValueError(f"targets {sorted(given)} can't be met with {budget:.0%} of the tokens: they ask for more of some levels, jointly, than there is")


def rake(cells: pd.DataFrame, budget: float = BUDGET, targets: dict[str, dict] | None = None) -> np.ndarray:
    """Probabilities of cells (source, lang, topic, tokens): expected tokens have the target marginals."""
    targets = targets or {}
    _check_targets(targets)
    if not len(cells) or not cells["tokens"].sum():
        return np.full(len(cells), float(budget))
    return _first_met(budget, targets, lambda part: _rake_here(cells, budget, _local_goals(cells, budget, targets, part)))


def cell_probabilities(rows: DataFrame, budget: float = BUDGET, targets: dict[str, dict] | None = None) -> tuple[DataFrame, bool]:
    """(source, lang, topic, tokens, weight, probability), and whether its size is bounded by MAX_CELLS.

    weight, the probability over ``budget``, is the factor by which the sample changes a cell's share of tokens.
    """
    cells, targets = store(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))), targets or {}
    weight = (F.col("probability") / float(budget)).alias("weight")
    if cells.count() > MAX_CELLS:
        _check_targets(targets)
        made = _first_met(budget, targets, lambda part: _rake_in_spark(cells, budget, _spark_goals(cells, budget, targets, part)))
        return made.select(*MARGINS, "tokens", weight, "probability"), False
    local = pd.DataFrame([r.asDict() for r in cells.orderBy(*MARGINS).collect()], columns=[*MARGINS, "tokens"])
    made = [(*[_plain(x) for x in key], int(t), float(q)) for key, t, q in zip(local[list(MARGINS)].astype(object).itertuples(index=False), local["tokens"], rake(local, budget, targets), strict=True)]
    schema = cells.withColumn("probability", F.lit(1.0)).schema
    return cells.sparkSession.createDataFrame(made, schema).select(*MARGINS, "tokens", weight, "probability"), True


def decide(rows: DataFrame, cells: DataFrame, bounded: bool, seed: int = 7) -> DataFrame:
    """``rows`` with weight, probability and kept."""
    right = cells.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], "weight", "probability")
    same = [rows[m].eqNullSafe(right[f"_{m}"]) for m in MARGINS]
    out = rows.join(F.broadcast(right) if bounded else right, same[0] & same[1] & same[2], "left").drop(*[f"_{m}" for m in MARGINS])
    at = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)
    return out.withColumn("kept", at < F.col("probability"))


def mix_table(documents: DataFrame, budget: float = BUDGET, targets: dict[str, dict] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept for every row."""
    rows = store(with_topics(documents.select("doc_id", "source", "lang", "text"), fit_topics(documents)).drop("text"))
    return decide(rows, *cell_probabilities(rows, budget, targets))


def mix_documents(documents: DataFrame, budget: float = BUDGET, targets: dict[str, dict] | None = None) -> DataFrame:
    """The documents, with all their columns, that the sampling keeps."""
    centres = fit_topics(documents)
    rows = store(with_topics(documents.select("doc_id", "source", "lang", "text"), centres).drop("text"))
    cells = cell_probabilities(rows, budget, targets)
    full = with_topics(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", "source", "lang", "text"), centres)
    return decide(full.drop("text"), *cells).where("kept").select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(read(spark, sf_dir, "documents"))
