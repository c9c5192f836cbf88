"""Outcome analysis over region tables: ROC, Kaplan-Meier, log-rank cut-points, Cox and logistic coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.simplex import ilr
from loomgraph.operators.running import number_rows, running
from loomgraph.shared import materialise, release


def auc(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the area under the ROC curve as a rank sum over distinct scores; ties count half; null with one class only."""
    by = scores.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    wins = running(by, [score], ["q"]).select("p", "q", (F.col("p") * (F.col("before_q") + F.col("q") / 2)).alias("w"))
    total = wins.agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return total.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).alias("auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def roc(scores: DataFrame, score: str = "score", label: str = "label", grid: int = 26) -> DataFrame:
    """(sensitivity, specificity): the best specificity among thresholds that reach each of `grid` sensitivities."""
    by = scores.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    total = scores.agg(F.sum(F.col(label).cast("long")).alias("all_p"), F.sum(1 - F.col(label).cast("long")).alias("all_q"))
    own = running(by, [score], ["p", "q"], descending=True)
    points = own.select((F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_q") + F.col("q")).alias("fp")).crossJoin(F.broadcast(total))  # one row on the right
    points = points.select((F.col("tp") / F.col("all_p")).alias("sens"), (1 - F.col("fp") / F.col("all_q")).alias("spec"))
    reached = points.select(F.explode(F.sequence(F.lit(0), F.floor(F.col("sens") * (grid - 1) + 1e-9).cast("int"))).alias("i"), "spec")
    return reached.groupBy("i").agg(F.max("spec").alias("specificity")).select((F.col("i") / (grid - 1)).alias("sensitivity"), "specificity")


def kaplan_meier(rows: DataFrame, time: str = "time", event: str = "event", *groups: str) -> DataFrame:
    """(groups, time, at_risk, events, survival) at each time with an event. event: 1 or 0; equal times: events first."""
    at = rows.where(F.col(time).isNotNull() & F.col(event).isNotNull()).groupBy(*groups, time).agg(F.sum(F.col(event).cast("long")).alias("events"), F.count("*").alias("n"))
    later = Window.partitionBy(*groups).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    risk = at.withColumn("at_risk", F.sum("n").over(later)).where("events > 0")
    w = Window.partitionBy(*groups).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    # where all die, the logarithm is taken of a number so small that the product is zero
    step = F.when(F.col("events") == F.col("at_risk"), F.lit(-745.0)).otherwise(F.log(1 - F.col("events") / F.col("at_risk")))
    return risk.select(*groups, time, "at_risk", "events", F.exp(F.sum(step).over(w)).alias("survival"))


def hazards(rows: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """(at, hazard, spread, square): at each distinct time, sums over the event times up to it of d/n, d(n-d)/(n(n-1)) and that by n."""
    by = rows.groupBy(F.col(time).alias("at")).agg(F.sum(F.col(event).cast("long")).alias("d"), F.count("*").alias("c"))
    risk = running(by, ["at"], ["c"], descending=True).withColumn("n", F.col("before_c") + F.col("c"))
    d, n = F.col("d").cast("double"), F.col("n").cast("double")
    a = F.when(F.col("n") > 1, d * (n - d) / (n * (n - 1))).otherwise(0.0)
    own = risk.select("at", (d / n).alias("h"), a.alias("a"), (a / n).alias("b"))
    return running(own, ["at"], ["h", "a", "b"]).select("at", (F.col("before_h") + F.col("h")).alias("hazard"), (F.col("before_a") + F.col("a")).alias("spread"), (F.col("before_b") + F.col("b")).alias("square"))


def _later_pairs(rank: np.ndarray, value: np.ndarray, count: np.ndarray, block: int = 256) -> np.ndarray:
    """For rows in order: the sum of value[min(rank of the row, rank of an earlier one)] over the earlier rows.

    rank: places among the distinct times; value: one number for each of these, rising; count: earlier rows of each place.
    Rows are taken in blocks: those before the block come from running sums, those within by pairs.
    """
    out, count = np.zeros(len(rank)), count.astype(float)
    for lo in range(0, len(rank), block):
        own = rank[lo : lo + block]
        below, above = np.cumsum(count * value) - count * value, np.cumsum(count[::-1])[::-1]
        both = value[np.minimum(own[:, None], own[None, :])]
        out[lo : lo + block] = below[own] + above[own] * value[own] + np.tril(both, -1).sum(1)
        np.add.at(count, own, 1.0)
    return out


def logrank_scan(rows: DataFrame, value: str, time: str = "time", event: str = "event", strip: int = 100_000) -> DataFrame:
    """(cut, n_low, n, o, v): for every distinct value, the rows up to it, all rows, and observed less expected events and variance of the log-rank test.

    Observed less expected is a running sum over the rows in the order of value, of the event less the cumulative hazard.
    The variance holds the square of the number at risk, a sum over pairs of rows of a rising function of the earlier of
    their times: rows are dealt into strips by value; a strip knows of those before it the counts at each distinct time, and
    adds up the pairs within it in blocks. Distinct times have to fit a task. Nulls take no part.
    """
    known = rows.select(F.col(value).cast("double").alias("cut"), F.col(time).alias("at"), F.col(event).cast("long").alias("e")).where("cut IS NOT NULL AND NOT isnan(cut) AND at IS NOT NULL AND e IS NOT NULL")
    known = materialise(known, "logrank-rows")
    steps = materialise(number_rows(hazards(known, "at", "e"), "at", name="rank"), "logrank-times")
    each = number_rows(known.join(steps, "at"), "cut", "at", "e", name="pos")  # rows that are alike in all three may change places
    each = materialise(each.withColumn("strip", F.floor(F.col("pos") / strip)), "logrank-each")
    held = materialise(each.groupBy("strip", "rank").agg(F.count("*").alias("c"), F.first("square").alias("square")), "logrank-strips")
    # the counts in the strips before: strips times distinct times
    own = held.select(F.col("strip").alias("own")).distinct()
    later = own.join(held, F.col("own") > F.col("strip")).groupBy("own", "rank").agg(F.sum("c").alias("c"), F.first("square").alias("square"))
    later, times = materialise(later.withColumnRenamed("own", "strip"), "logrank-before"), steps.count()

    def pairs(key: tuple, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        value, count = np.zeros(times), np.zeros(times)
        for part in (before, pdf):
            value[part["rank"].to_numpy(np.int64)] = part["square"].to_numpy(float)
        # places without rows here or before need a value no greater than the next one's; nothing is asked of them
        count[before["rank"].to_numpy(np.int64)] = before["c"].to_numpy(float)
        return pd.DataFrame({"pos": pdf["pos"].to_numpy(np.int64), "pairs": _later_pairs(pdf["rank"].to_numpy(np.int64), value, count)})

    found = each.groupBy("strip").cogroup(later.groupBy("strip")).applyInPandas(pairs, "pos long, pairs double")
    found = materialise(found, "logrank-pairs")
    own = each.join(found, "pos").select("cut", "pos", (F.col("e") - F.col("hazard")).alias("o"), (F.col("spread") - F.col("square") - 2 * F.col("pairs")).alias("v"))
    by = own.groupBy("cut").agg(F.sum("o").alias("o"), F.sum("v").alias("v"), F.count("*").alias("c"))
    sums = running(by, ["cut"], ["o", "v", "c"])
    return sums.select("cut", (F.col("before_c") + F.col("c")).alias("n_low"), F.lit(known.count()).alias("n"), (F.col("before_o") + F.col("o")).alias("o"), (F.col("before_v") + F.col("v")).alias("v"))


def logrank_cutpoint(rows: DataFrame, value: str, time: str = "time", event: str = "event", least: float = 0.1) -> DataFrame:
    """One row: the cut, among all distinct values that leave at least the share `least` of rows on either side, whose log-rank statistic is greatest; ties to the smallest."""
    fits = (F.col("n_low") >= least * F.col("n")) & (F.col("n") - F.col("n_low") >= least * F.col("n")) & (F.col("v") > 1e-9)
    found = logrank_scan(rows, value, time, event).where(fits).select("cut", (F.col("o") * F.col("o") / F.col("v")).alias("statistic"))
    return found.orderBy(F.desc(F.round("statistic", 9)), "cut").limit(1)


def dichotomised(rows: DataFrame, value: str, cut: float, name: str = "group") -> DataFrame:
    return rows.withColumn(name, F.when(F.col(value) <= cut, "low").otherwise("high"))


def logistic(rows: DataFrame, features: list[str], label: str = "label", ridge: float = 1e-6, rounds: int = 25) -> np.ndarray:
    """Intercept and coefficients by Newton's method; each round is one aggregation of a small Hessian."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    beta, k = np.zeros(len(x)), len(x)
    for _ in range(rounds):
        z = sum((xi * float(b) for xi, b in zip(x, beta, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        r = rows.agg(*[F.sum((F.col(label) - p) * xi) for xi in x], *[F.sum(p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(i, k)]).first()
        g, h, at = np.array([v or 0.0 for v in r[:k]]) - ridge * beta, np.zeros((k, k)), k
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = r[at] or 0.0
                at += 1
        step = np.linalg.solve(h + ridge * np.eye(k), g)
        beta = beta + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def cox(x: np.ndarray, time: np.ndarray, event: np.ndarray, ridge: float = 1e-6, rounds: int = 50) -> np.ndarray:
    """Proportional-hazards coefficients (Breslow ties) by Newton's method over sorted risk sets, for a table of regions."""
    order = np.argsort(-time, kind="stable")
    x, time, event = x[order] - x.mean(0), time[order], event[order].astype(float)
    last = np.searchsorted(-time, -time, side="right") - 1  # the end of each row's risk set
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        w = np.exp(np.clip(x @ beta, -50, 50))
        s0, s1 = np.cumsum(w)[last], np.cumsum(w[:, None] * x, axis=0)[last]
        s2 = np.cumsum(w[:, None, None] * x[:, :, None] * x[:, None, :], axis=0)[last]
        m = s1 / s0[:, None]
        g = (event[:, None] * (x - m)).sum(0) - ridge * beta
        h = (event[:, None, None] * (s2 / s0[:, None, None] - m[:, :, None] * m[:, None, :])).sum(0) + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta = beta + step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return beta


def cox_sums(rows: DataFrame, features: list[str], beta: np.ndarray, time: str = "time", event: str = "event") -> tuple[np.ndarray, np.ndarray]:
    """Gradient and information of the partial likelihood (Breslow ties) at beta.

    Rows are summed by time first; the sums over risk sets are running totals over ranges of times, latest first. Only the
    two small results reach the driver.
    """
    k = len(features)
    x = [F.col(f).cast("double") for f in features]
    w = F.exp(sum((c * float(b) for c, b in zip(x, beta, strict=True)), F.lit(0.0)))
    e = F.col(event).cast("double")
    both = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(w).alias("s0"), F.sum(e).alias("d")]
    sums += [F.sum(w * x[i]).alias(f"s_{i}") for i in range(k)] + [F.sum(e * x[i]).alias(f"x_{i}") for i in range(k)]
    sums += [F.sum(w * x[i] * x[j]).alias(f"s_{i}_{j}") for i, j in both]
    by = rows.groupBy(F.col(time).alias("at")).agg(*sums)
    held = ["s0", *[f"s_{i}" for i in range(k)], *[f"s_{i}_{j}" for i, j in both]]
    risk = running(by, ["at"], held, descending=True).where("d > 0")
    total = {c: F.col(f"before_{c}") + F.col(c) for c in held}
    mean = [total[f"s_{i}"] / total["s0"] for i in range(k)]
    out = risk.agg(*[F.sum(F.col(f"x_{i}") - F.col("d") * mean[i]) for i in range(k)], *[F.sum(F.col("d") * (total[f"s_{i}_{j}"] / total["s0"] - mean[i] * mean[j])) for i, j in both]).first()
    g, h = np.array([v or 0.0 for v in out[:k]]), np.zeros((k, k))
    for (i, j), v in zip(both, out[k:], strict=True):
        h[i, j] = h[j, i] = v or 0.0
    return g, h


def cox_model(rows: DataFrame, features: list[str], time: str = "time", event: str = "event", ridge: float = 1e-6, rounds: int = 25) -> DataFrame:
    """(name, value, error): proportional-hazards coefficients of a table of any size and their standard errors, by Newton's method.

    Features are centred and scaled for the iterations. Rows with a null in a feature, time or event take no part; a feature
    that does not vary has the coefficient 0 if ridge is positive.
    """
    known = rows.select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(time).alias("at"), F.col(event).cast("long").alias("e")).na.drop()
    k = len(features)
    m = known.agg(*[F.avg(f"x{i}") for i in range(k)], *[F.stddev_pop(f"x{i}") for i in range(k)]).first()
    mean, size = [v or 0.0 for v in m[:k]], [v if v else 1.0 for v in m[k:]]
    scaled = materialise(known.select(*[((F.col(f"x{i}") - float(mean[i])) / float(size[i])).alias(f"x{i}") for i in range(k)], "at", "e"), "cox")
    names, beta = [f"x{i}" for i in range(k)], np.zeros(k)
    for _ in range(rounds):
        g, h = cox_sums(scaled, names, beta, "at", "e")
        step = np.linalg.solve(h + ridge * np.eye(k), g - ridge * beta)
        beta = beta + step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    error = np.sqrt(np.diag(np.linalg.inv(cox_sums(scaled, names, beta, "at", "e")[1] + ridge * np.eye(k))))
    release(scaled)
    return rows.sparkSession.createDataFrame([(f, float(beta[i] / size[i]), float(error[i] / size[i])) for i, f in enumerate(features)], "name string, value double, error double")


def ilr_columns(regions: DataFrame, topics: list[str], prefix: str = "z") -> DataFrame:
    """regions with the log-ratio coordinates of their topic shares, z1..z(K-1)."""
    z = regions.withColumn("_z", ilr(F.array(*[F.col(t).cast("double") for t in topics]), len(topics)))
    return z.select(*regions.columns, *[F.col("_z")[i].alias(f"{prefix}{i + 1}") for i in range(len(topics) - 1)])


def repeated_auc(rows: DataFrame, features: list[str], label: str = "label", key: str = "id", repeats: int = 10, share: float = 0.7) -> DataFrame:
    """(repeat, auc): logistic models on a hashed 70 % of the rows, scored on the rest."""
    spark, out = rows.sparkSession, []
    for i in range(repeats):
        train = F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1000)) < int(1000 * share)
        beta = logistic(rows.where(train), features, label)
        z = sum((F.col(f).cast("double") * float(b) for f, b in zip(features, beta[1:], strict=True)), F.lit(float(beta[0])))
        out.append((i, auc(rows.where(~train).select(z.alias("score"), F.col(label).alias("label"))).first()["auc"]))
    return spark.createDataFrame(out, "repeat int, auc double")
