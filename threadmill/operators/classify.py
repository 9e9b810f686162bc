"""Scores, classifiers and their metrics, as joins and aggregates.

Curves (precision above a threshold, AUC) work on counts per distinct score,
so the ordered window sees one row per score value, not one per example.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_survival
from ..storage import settle
from .order import numbered, prefix_sums


def nb_counts(examples: DataFrame) -> DataFrame:
    """Documents per token and class: token, pos, neg.  ``examples``: id, label (boolean), tokens (distinct)."""
    t = examples.select("label", F.explode("tokens").alias("token"))
    return t.groupBy("token").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))


def token_probability(counts: DataFrame, totals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Robinson's smoothed share of positives per token (and ``keys``): token, keys, p, seen; 0.5 if a class is empty."""
    j = counts.join(F.broadcast(totals), list(keys) or F.lit(True))  # one row (one per keys)
    a, b = F.col("pos") / F.col("n_pos"), F.col("neg") / F.col("n_neg")
    raw = a / (a + b)
    seen = F.col("pos") + F.col("neg")
    p = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0) | (seen == 0), 0.5).otherwise((0.5 + seen * raw) / (1 + seen))
    return j.select("token", *keys, p.alias("p"), seen.alias("seen"))


def class_totals(examples: DataFrame) -> DataFrame:
    return examples.agg(F.count_if("label").alias("n_pos"), F.count_if(~F.col("label")).alias("n_neg"))


def fisher_scores(docs: DataFrame, probabilities: DataFrame, clues: int = 150, keys: tuple[str, ...] = ()) -> DataFrame:
    """Combined probability of every document: id, p, n_clues.

    The strongest ``clues`` tokens at least 0.1 away from 0.5 are combined by
    Fisher's method; a document without clues gets 0.5.  Documents meet
    probabilities of their own ``keys`` only.
    """
    t = docs.select("id", *keys, F.explode("tokens").alias("token")).join(probabilities, ["token", *keys])
    t = t.withColumn("strength", F.abs(F.col("p") - 0.5)).where("strength >= 0.1 - 1e-12")
    w = Window.partitionBy("id").orderBy(F.desc("strength"), F.desc("token"))
    t = t.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= clues)
    # Sums of logarithms are rounded so that the order of summation can't be seen.
    g = t.groupBy("id").agg(F.round(-F.sum(F.log(1 - F.col("p"))), 9).alias("h"), F.round(-F.sum(F.log("p")), 9).alias("s"), F.count("*").alias("n_clues"))
    p = (1 + chi2_survival(F.col("s"), F.col("n_clues")) * -1 + chi2_survival(F.col("h"), F.col("n_clues"))) / 2
    combined = g.select("id", (1 - p).alias("p"), "n_clues")
    return docs.select("id").join(combined, "id", "left").select("id", F.coalesce("p", F.lit(0.5)).alias("p"), F.coalesce("n_clues", F.lit(0)).alias("n_clues"))


def curve(scored: DataFrame) -> DataFrame:
    """Counts per distinct score with those at or above it: score, pos, neg, pos_above, neg_above."""
    c = scored.where("score IS NOT NULL").groupBy("score").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    return prefix_sums(c, [], "score", ["pos", "neg"], descending=True).withColumnsRenamed({"pos_upto": "pos_above", "neg_upto": "neg_above"})


def auc(scored: DataFrame) -> DataFrame:
    """Mann-Whitney AUC with ties averaged; null if a class is empty: auc, n_pos, n_neg."""
    c = curve(scored)
    # Of the pairs with a negative at this score, positives above count fully, equal ones half.
    won = F.sum(F.col("neg") * (F.col("pos_above") - F.col("pos") + F.col("pos") / 2))
    g = c.agg(won.alias("won"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return g.select(F.when(pairs > 0, F.col("won") / pairs).alias("auc"), "n_pos", "n_neg")


def threshold_table(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts, precision, recall and F1 at each threshold (score >= t is positive)."""
    aggs = []
    for i, t in enumerate(thresholds):
        at = F.col("score") >= t
        aggs.append(F.struct(F.lit(t).alias("threshold"), F.count_if(at & F.col("label")).alias("tp"), F.count_if(at & ~F.col("label")).alias("fp"), F.count_if(~at & F.col("label")).alias("fn"), F.count_if(~at & ~F.col("label")).alias("tn")).alias(f"t{i}"))
    one = scored.agg(*aggs)
    rows = one.select(F.explode(F.array(*(F.col(f"t{i}") for i in range(len(thresholds))))).alias("r")).select("r.*")
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    rows = rows.withColumn("precision", F.coalesce(p, F.lit(0.0))).withColumn("recall", F.coalesce(r, F.lit(0.0)))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.withColumn("f1", f1)


def tune_high(scored: DataFrame, target: float) -> DataFrame:
    """The smallest score above 0 from which precision meets the target, else 1.01: t_high."""
    c = curve(scored).where("score > 0")
    ok = F.col("pos_above") / (F.col("pos_above") + F.col("neg_above")) >= target
    return c.agg(F.coalesce(F.min(F.when(ok, F.col("score"))), F.lit(1.01)).alias("t_high"))


def best_cutoff(rows: DataFrame, precision: float, least: int) -> DataFrame:
    """The largest limit (size + 1) below which enough rows are negative with the wanted precision: cutoff, n."""
    c = rows.groupBy("size").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    c = prefix_sums(c.where("size IS NOT NULL"), [], "size", ["pos", "neg"]).withColumnsRenamed({"pos_upto": "p", "neg_upto": "n"})
    ok = (F.col("p") + F.col("n") >= least) & (F.col("n") / (F.col("p") + F.col("n")) >= precision)
    return c.where(ok).agg(F.max(F.struct((F.col("size") + 1).alias("cutoff"), (F.col("p") + F.col("n")).alias("n"))).alias("b")).select("b.cutoff", "b.n").where("cutoff IS NOT NULL")


def stratified_folds(labels: DataFrame, folds: int, seed: str) -> DataFrame:
    """Folds of equal class mix by hash order: id, label, fold."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col("id").cast("string")), 256)
    d = labels.withColumn("__h", h).withColumn("__n", F.conv(F.substring("__h", 1, 14), 16, 10).cast("long"))
    return numbered(d, ["label"], ["__n", "__h"]).withColumn("fold", F.pmod("no", F.lit(folds)).cast("int")).select(*labels.columns, "fold")


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, l2: float | None = None) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent from zero; the intercept isn't penalised (l2 defaults to 1/n)."""
    n, d = x.shape
    w, b = np.zeros(d), 0.0
    l2 = 1.0 / n if l2 is None else l2
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-np.clip(x @ w + b, -500, 500))) - y
        w, b = w - rate * (x.T @ e / n + l2 * w), b - rate * e.mean()
    return w, b


def _slope(batch, features: list[str], w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Sum of the gradients over the rows of an Arrow batch or table: weights, intercept."""
    x, y, n = np.column_stack([batch.column(c).to_numpy() for c in features]), batch.column("y").to_numpy(), batch.column("n").to_numpy()
    e = n * (1 / (1 + np.exp(-np.clip(x @ w + b, -500, 500))) - y)
    return x.T @ e, float(e.sum())


def fit_logistic_rows(rows: DataFrame, features: list[str], rounds: int = 200, rate: float = 0.1, held: int = 1_000_000) -> tuple[np.ndarray, float] | None:
    """``fit_logistic`` on every row of a table of ``features`` and label; None without rows.

    Equal rows are folded with their number.  Up to ``held`` different rows are
    fitted here; more stay where they are, and every round is one pass over
    them of which only sums come back.
    """
    x = rows.where("label IS NOT NULL").groupBy(*(F.col(c).cast("double").alias(c) for c in features), F.col("label").cast("double").alias("y")).agg(F.count("*").cast("double").alias("n"))
    x = settle(x, "examples")
    different, total = x.agg(F.count("*"), F.sum("n")).first()
    if not different:
        return None
    here = x.toArrow() if different <= held else None
    w, b = np.zeros(len(features)), 0.0
    for _ in range(rounds):
        if here is not None:
            g, h = _slope(here, features, w, b)
        else:

            def run(batches, w=w, b=b):
                import pyarrow as pa

                g, h = np.zeros(len(features)), 0.0
                for batch in batches:
                    dg, dh = _slope(batch, features, w, b)
                    g, h = g + dg, h + dh
                yield pa.RecordBatch.from_pydict({"g": pa.array([g.tolist()], pa.list_(pa.float64())), "h": pa.array([h])})

            parts = x.mapInArrow(run, "g array<double>, h double").collect()
            g, h = np.sum([r["g"] for r in parts], axis=0), sum(r["h"] for r in parts)
        w, b = w - rate * (g + w) / total, b - rate * h / total  # l2 is 1/n
    return w, b


def fit_head(vectors: DataFrame, most: int = 20_000, rounds: int = 300, rate: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and intercept of a logistic head on z-scored vectors (id, label, v).

    Fitted on at most ``most`` labelled rows, taken by hash (a documented
    bound of what the driver holds).
    """
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "label", "v").collect()
    rows.sort(key=lambda r: r["id"])
    x, y = np.array([r["v"] for r in rows], float), np.array([r["label"] for r in rows], float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    w, b = fit_logistic((x - mean) / scale, y, rounds, rate)
    return mean, scale, w, b


def head_score(v: Column, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: float) -> Column:
    """The head's probability as an expression."""
    k = w / scale
    weights = F.array(*(F.lit(float(x)) for x in k))
    z = F.aggregate(F.zip_with(F.transform(v, lambda x: x.cast("double")), weights, lambda p, q: p * q), F.lit(float(b - (mean * k).sum())), lambda s, x: s + x)
    return 1 / (1 + F.exp(-z))


def summarize(scored: DataFrame, floor: float = 0.95) -> DataFrame:
    """One row: n_pos, n_neg, best_threshold (greatest F1; the smallest of equal ones), f1, and at the greatest threshold with recall >= ``floor``: floor_threshold, negative_recall.

    Null and zero where a class is empty.
    """
    c = curve(scored)
    n = F.broadcast(c.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg")))  # one row
    j = c.join(n, F.lit(True))
    recall = F.col("pos_above") / F.nullif(F.col("n_pos"), F.lit(0))
    f1 = 2 * F.col("pos_above") / (F.col("pos_above") + F.col("neg_above") + F.col("n_pos"))
    ok = recall >= floor
    g = j.agg(F.max(F.struct(F.round(f1, 12).alias("f1"), (-F.col("score")).alias("m"))).alias("b"), F.max(F.when(ok, F.struct("score", (1 - F.col("neg_above") / F.nullif(F.col("n_neg"), F.lit(0))).alias("r")))).alias("f"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return n.join(g, F.lit(True)).select("n_pos", "n_neg", F.when(both, -F.col("b.m")).alias("best_threshold"), F.when(both, F.col("b.f1")).otherwise(0.0).alias("f1"), F.when(both, F.col("f.score")).alias("floor_threshold"), F.when(both, F.col("f.r")).alias("negative_recall"))


def irrelevant_threshold(scored: DataFrame, recall: float) -> DataFrame:
    """The positives' score below which at most 1 - ``recall`` of them lie: threshold (no row without positives)."""
    from .relational import index_quantile

    p = scored.where("label AND score IS NOT NULL").select(F.lit(0).alias("one"), "score")
    return index_quantile(p, ["one"], "score", F.floor((1 - recall) * F.col("n") + 1e-9)).select(F.col("quantile").alias("threshold"))


def side_stats(scored: DataFrame, low: float, high: float) -> DataFrame:
    """Count, precision and recall of what lies below ``low`` (as negatives) and from ``high`` on (as positives): side, n, precision, recall."""
    a = scored.agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("q"), F.count_if(F.col("score") < low).alias("ln"), F.count_if((F.col("score") < low) & ~F.col("label")).alias("lh"), F.count_if(F.col("score") >= high).alias("hn"), F.count_if((F.col("score") >= high) & F.col("label")).alias("hh"))
    part = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    side = lambda s, n, h, t: F.struct(F.lit(s).alias("side"), F.col(n).alias("n"), part(F.col(h), F.col(n)).alias("precision"), part(F.col(h), F.col(t)).alias("recall"))
    return a.select(F.explode(F.array(side("irrelevant", "ln", "lh", "q"), side("relevant", "hn", "hh", "p"))).alias("r")).select("r.*")


def discard_pile(scored: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """Which share of the good (label) and of the bad lies at or above each threshold: threshold, keep_lost, trash_caught."""
    share = lambda t, y: F.count_if((F.col("score") >= t) & y) / F.nullif(F.count_if(y), F.lit(0))
    cells = [F.struct(F.lit(t).alias("threshold"), share(t, F.col("label")).alias("keep_lost"), share(t, ~F.col("label")).alias("trash_caught")) for t in thresholds]
    return scored.agg(*(c.alias(f"c{i}") for i, c in enumerate(cells))).select(F.explode(F.array(*(F.col(f"c{i}") for i in range(len(cells))))).alias("r")).select("r.*")


def tune_check(items: DataFrame, grid: list[float]) -> DataFrame:
    """The threshold of least overlap at which flags fit reviews best: threshold, caught, positives, false_alarms, negatives, f1.

    ``items``: overlap, has_missing, bad (boolean).  Flagged is what misses a
    fact or overlaps less than the threshold; the greatest F1 counts, among
    equal ones the smallest threshold.
    """
    cells = []
    for t in grid:
        hit = F.col("has_missing") | (F.col("overlap") < t)
        cells.append(F.struct(F.lit(float(t)).alias("threshold"), F.count_if(hit & F.col("bad")).alias("caught"), F.count_if("bad").alias("positives"), F.count_if(hit & ~F.col("bad")).alias("false_alarms"), F.count_if(~F.col("bad")).alias("negatives")))
    r = items.agg(*(c.alias(f"c{i}") for i, c in enumerate(cells))).select(F.explode(F.array(*(F.col(f"c{i}") for i in range(len(cells))))).alias("r")).select("r.*")
    f1 = F.when(F.col("caught") > 0, 2 * F.col("caught") / (F.col("caught") + F.col("false_alarms") + F.col("positives"))).otherwise(0.0)
    return r.withColumn("f1", f1).orderBy(F.desc(F.round("f1", 12)), "threshold").limit(1)


def bucket_table(rows: DataFrame, edges: list[tuple[int, str]], over: str) -> DataFrame:
    """Labelled exchanges by size and tech: bucket, tech, n, and counts of positives and negatives inside and outside the held-out part.

    ``rows``: chars, hits, held (boolean), label (boolean, null: not labelled).
    """
    b = F.when(F.col("chars") < edges[0][0], edges[0][1])
    for limit, name in edges[1:]:
        b = b.when(F.col("chars") < limit, name)
    yes, no, held = F.coalesce("label", F.lit(False)), F.coalesce(~F.col("label"), F.lit(False)), F.col("held")
    return rows.groupBy(b.otherwise(over).alias("bucket"), (F.col("hits") > 0).alias("tech")).agg(
        F.count("*").alias("n"), F.count_if(yes & ~held).alias("pos"), F.count_if(no & ~held).alias("neg"), F.count_if(yes & held).alias("held_pos"), F.count_if(no & held).alias("held_neg")
    )


def top_tokens(probabilities: DataFrame, n: int) -> DataFrame:
    """The tokens furthest from a half: token, p (ties by token)."""
    return probabilities.orderBy(F.desc(F.round(F.abs(F.col("p") - 0.5), 9)), "token").limit(n).select("token", "p")


def out_of_fold_bayes(docs: DataFrame, labels: DataFrame, folds: int = 2) -> DataFrame:
    """Every document scored by the model of the other folds: id, p.  ``docs``: id, tokens; ``labels``: id, label.

    All models are counted and applied in one pass, each fold's as what is
    left of all counts without its own.
    """
    from ..functions.stats import fold

    f = docs.withColumn("fold", fold(F.col("id"), folds))
    known = f.join(labels.select(F.col("id").alias("l_id"), "label"), F.col("id") == F.col("l_id")).select("label", "tokens", F.col("fold").alias("own"))
    others = lambda test: [F.count_if(test & (F.col("own") != k)) for k in range(folds)]
    model = lambda a, b: F.explode(F.array(*(F.struct(F.lit(k).alias("fold"), F.col(f"p{k}").alias(a), F.col(f"q{k}").alias(b)) for k in range(folds)))).alias("m")
    sums = [c.alias(f"{n}{k}") for n, test in (("p", F.col("label")), ("q", ~F.col("label"))) for k, c in enumerate(others(test))]
    counts = known.select("label", "own", F.explode("tokens").alias("token")).groupBy("token").agg(*sums).select("token", model("pos", "neg")).select("token", "m.*")
    totals = known.agg(*sums).select(model("n_pos", "n_neg")).select("m.*")
    return fisher_scores(f, token_probability(counts, totals, ("fold",)), keys=("fold",)).select("id", "p")


def logit(p: Column, bound: float = 10.0) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), F.log(F.greatest(F.lit(1e-9), p) / F.greatest(F.lit(1e-9), 1 - p))))


def outcomes(decided: DataFrame, version: int) -> DataFrame:
    """The rows that a cascade run writes: xid, scorer, label, version; one for the stage that decided, and a lexicon row for all that reached it."""
    stage = F.col("stage")
    late = stage.isin("lexicon", "short_no_tech", "embed", "residue")
    lexicon = F.when(late, F.struct(F.lit("lexicon").alias("scorer"), F.when(stage == "lexicon", F.col("decision")).alias("label")))
    own = F.when(stage != "lexicon", F.struct(stage.alias("scorer"), F.when(F.col("decision") != "undecided", F.col("decision")).alias("label")))
    r = decided.select(F.col("id").alias("xid"), F.explode(F.array_compact(F.array(lexicon, own))).alias("r"))
    return r.select("xid", "r.scorer", "r.label", F.lit(version).cast("long").alias("version"))


def rule_score(messages: DataFrame, patterns: dict[str, tuple[str, float]], terms: str, agreed: Column | None = None) -> DataFrame:
    """A score from 0 to 1 of every exchange with the reasons that made it: xid, score, reasons.

    Weights are fixed values: terms 0.15 each up to 0.45, the given patterns,
    0.2 for an answered question, 0.05 where a message is ``agreed`` to, 0.05
    for a thread, 0.1 from 400 characters, -0.2 for mostly tiny messages, then
    patterns of negative weight, -0.1 for laughter.
    """
    from .relational import answered

    c = F.col("content")
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(terms), F.lit(0)))
    tiny, laugh = F.length(F.trim(c)) < 20, F.lower(F.trim(c)).rlike(r"^[^\p{L}\p{N}_]*(?:lol+|lmao+|rofl|ha(?:ha)+|hehe+|xd+|kek)[^\p{L}\p{N}_]*$")
    g = messages.groupBy("xid").agg(
        F.count("*").alias("n"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.size(found) > 0, found))))).alias("terms"),
        F.sum(F.length(c)).alias("chars"),
        F.count_if(tiny).alias("tiny"),
        F.count_if(laugh).alias("laugh"),
        F.max(F.col("thread_id").isNotNull()).alias("thread"),
        F.max(F.lit(False) if agreed is None else agreed).alias("agreed"),
        *(F.max(c.rlike(p)).alias(f"p_{name}") for name, (p, _) in patterns.items()),
    )
    g = g.join(answered(messages).withColumn("answered", F.lit(True)), "xid", "left")
    signals = [
        (F.col("terms") > 0, "domain_terms", F.least(F.lit(0.45), F.col("terms") * 0.15)),
        *((F.col(f"p_{name}"), name, F.lit(w)) for name, (_, w) in patterns.items() if w >= 0),
        (F.coalesce("answered", F.lit(False)), "answered_question", F.lit(0.2)),
        (F.col("agreed"), "agreed_answer", F.lit(0.05)),
        (F.col("thread"), "thread", F.lit(0.05)),
        (F.col("chars") + F.col("n") - 1 >= 400, "substantial", F.lit(0.1)),
        ((F.col("n") > 1) & (F.col("tiny") / F.col("n") > 0.7), "mostly_tiny_messages", F.lit(-0.2)),
        *((F.col(f"p_{name}"), name, F.lit(w)) for name, (_, w) in patterns.items() if w < 0),
        (F.col("laugh") / F.col("n") > 0.3, "laughter", F.lit(-0.1)),
    ]
    reasons = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("name"), w.alias("weight"))) for test, name, w in signals)))
    g = g.withColumn("r", reasons)
    raw = F.aggregate("r", F.lit(0.0), lambda s, x: s + x["weight"])
    return g.select("xid", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4).alias("score"), F.array_join(F.transform("r", lambda x: x["name"]), " ").alias("reasons"))


def cascade(subjects: DataFrame, t_high: Column | float, short_limit: int | None, t_irrelevant: float, t_relevant: float) -> DataFrame:
    """Stage and decision of every subject: id, stage, decision.

    ``subjects``: id, denied, chars, hits, share, p.  The first stage that
    decides counts: denylist, no_text, lexicon, short_no_tech, embed; what is
    left is residue.  All stages are cheap columns here; an expensive scorer
    belongs on the rows that the earlier stages leave.
    """
    short = F.lit(False) if short_limit is None else (F.col("hits") == 0) & (F.col("chars") < short_limit)
    stages = [
        (F.col("denied"), "denylist", "irrelevant"),
        (F.col("chars") == 0, "no_text", "no_text"),
        ((F.col("hits") > 0) & (F.col("share") >= t_high), "lexicon", "relevant"),
        (short, "short_no_tech", "irrelevant"),
        (F.col("p") < t_irrelevant, "embed", "irrelevant"),
        (F.col("p") >= t_relevant, "embed", "relevant"),
    ]
    stage = decision = None
    for test, s, d in stages:
        test = F.coalesce(test, F.lit(False))
        stage = F.when(test, s) if stage is None else stage.when(test, s)
        decision = F.when(test, d) if decision is None else decision.when(test, d)
    return subjects.select("id", stage.otherwise("residue").alias("stage"), decision.otherwise("undecided").alias("decision"))
