"""Mixing sources to target weights of tokens.

Entropy balancing over documents: of all document rates r_d with 0 <= r_d <= max_repeats of the source and
sum(n_d r_d) = share_s * T for each source, take those nearest to the prior rates q_d (1 each unless given), by the relative
entropy sum(r_d ln(r_d / q_d) - r_d + q_d). The total T is given, or free: then it is the one at which the mixture
stays nearest to the priors, which couples the sources. The convex dual has one variable a source, and its solution is
the exponential tilt r_d = min(max_repeats, q_d exp(lambda_s n_d)); with a free total the lambdas, weighted by the
shares, sum to 0. A source that must shrink so keeps its short documents and one that must grow repeats its long ones
first, which is what changes the fewest documents. weight="tokens" takes the entropy per token instead (each document
counts n_d times), which tilts all documents of a source alike.

The dual is solved by damped Newton steps. Documents enter as counts by (source, n_tokens, prior), one aggregate that is
written once; each step is a pass over those counts for several step lengths at once, and brings a few numbers per
source to the driver. A solution that doesn't settle is an error.

Rates become whole copies: floor(r_d) each, and one more for the documents whose hash, divided by the rest of their
rate, lies under a threshold of the source. The threshold is found on two nested histograms, so that the tokens of a
source miss its target by about one document.

Defined cases: a source of `targets` without tokens stays empty, is reported with share 0, and the others keep their
proportions among themselves; documents of other sources, with null source, or without text don't enter the mixture
(documents without tokens have no size); repeated ids are separate documents with the same number of extra copies;
targets whose share or max_repeats is null or not positive count as share 0; a total beyond what the caps allow is
lowered to it; null priors count as 1, and documents with a prior of 0 or less don't enter; several rows of one source in
`targets` are refused. The sources of `targets` are at most MAX_SOURCES, so their parameters can be broadcast.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quern import runtime
from quern.llm import bpe
from quern.llm.encode import count_tokens

MAX_SOURCES = 10_000
_BINS = 1024
#: Step lengths tried in one pass.
_STEPS = [2.0**-k for k in range(8)]
_FULL = 700.0  # an exponent at which every document is at its cap


def _per_source(spark, **columns: dict[str, object]) -> DataFrame:
    """A broadcast table of the sources' numbers or lists of numbers."""
    names = list(columns)
    kinds = ", ".join(f"{c} {'array<double>' if isinstance(next(iter(v.values()), 0.0), list) else 'double'}" for c, v in columns.items())
    rows = [(s, *[columns[c][s] for c in names]) for s in sorted(columns[names[0]])]
    return F.broadcast(spark.createDataFrame(rows, f"source string, {kinds}"))


def solve_rates(counts: DataFrame, shares: dict[str, float], caps: dict[str, float], total: float | None = None, weight: str = "documents", tolerance: float = 1e-9, steps: int = 100) -> tuple[dict[str, float], float, int]:
    """(lambda_s, total, passes) of the dual. counts: source, n (tokens of a document), prior, c (documents). With
    weight "documents" the rate is min(cap, prior * exp(lambda * n)), with "tokens" min(cap, prior * exp(lambda))."""
    spark, names = counts.sparkSession, sorted(shares)
    share = np.array([shares[s] for s in names])
    unit = F.lit(1.0) if weight == "documents" else F.col("n")  # how often a document counts in the entropy
    scale = {r["source"]: r["m"] for r in counts.groupBy("source").agg((F.sum(F.col("n") * F.col("n") / unit * F.col("c") * F.col("prior")) / F.sum(F.col("n") * F.col("c") * F.col("prior"))).alias("m")).collect()}
    inverse = 1 / np.array([scale[s] for s in names])  # of a lambda that moves rates by about e

    def evaluate(tries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dual value, tokens and their slope by source and try."""
        table = _per_source(spark, cap={s: float(caps[s]) for s in names}, tried={s: [float(x) for x in row] for s, row in zip(names, tries)})
        rows = counts.join(table, "source").select("source", "n", "prior", "c", "cap", unit.alias("w"), F.posexplode("tried").alias("k", "t"))
        x, top = F.col("t") * F.col("n") / F.col("w"), F.log(F.col("cap") / F.col("prior"))
        free = x < top
        rate = F.when(free, F.col("prior") * F.exp(F.least(x, F.lit(_FULL)))).otherwise(F.col("cap"))
        value = F.when(free, rate - F.col("prior")).otherwise(F.col("cap") * (x - top) + F.col("cap") - F.col("prior"))
        got = rows.select("source", "k", (value * F.col("w") * F.col("c")).alias("f"), (rate * F.col("n") * F.col("c")).alias("g"), F.when(free, rate * F.col("n") * F.col("n") / F.col("w") * F.col("c")).otherwise(0.0).alias("h"))
        f, g, h = (np.zeros(tries.shape) for _ in range(3))
        at = {s: i for i, s in enumerate(names)}
        for r in got.groupBy("source", "k").agg(F.sum("f").alias("f"), F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            i, k = at[r["source"]], r["k"]
            f[i, k], g[i, k], h[i, k] = r["f"], r["g"], r["h"]
        return f, g, h

    lam = np.zeros(len(names))
    f, g, h = (x[:, 0] for x in evaluate(lam[:, None]))
    for passes in range(2, steps + 2):
        # a flat slope (all at their caps, or all but gone) is lifted, and no step moves rates by more than e^3
        slope = np.maximum(h, 1e-6 * g / inverse + 1e-300)
        t = total if total is not None else max((share @ (g / slope) - share @ lam) / (share @ (share / slope)), 1e-300)
        if np.max(np.abs(g - share * t) / (share * t)) <= tolerance:
            return dict(zip(names, lam.tolist())), float(t), passes - 1
        step = (share * t - g) / slope
        step *= min(1.0, 3 / max(1e-300, float(np.max(np.abs(step) / inverse))))
        linear = total * (share @ step) if total is not None else 0.0
        tries = lam[:, None] + step[:, None] * np.array(_STEPS)
        values, tokens, slopes = evaluate(tries)
        gain = values.sum(axis=0) - f.sum() - linear * np.array(_STEPS)
        wanted = 1e-4 * np.array(_STEPS) * float((g @ step) - linear)  # Armijo; at the end rounding hides the gain
        good = np.flatnonzero(gain <= wanted + 1e-12 * abs(f).sum())
        k = int(good[0]) if len(good) else len(_STEPS) - 1
        lam, f, g, h = tries[:, k], values[:, k], tokens[:, k], slopes[:, k]
    raise RuntimeError(f"the mixture didn't settle in {steps} steps")


def _thresholds(docs: DataFrame, goals: dict[str, float]) -> dict[str, float]:
    """theta_s with sum of n_tokens over docs (source, n_tokens, v) with v < theta_s next to the goal; v is in [0, inf)."""
    spark = docs.sparkSession
    low, width, below = {s: 0.0 for s in goals}, {s: 2.0 / _BINS for s in goals}, {s: 0.0 for s in goals}
    for _ in range(2):
        bin_ = F.floor((F.col("v") - F.col("low")) / F.col("width"))
        placed = docs.join(_per_source(spark, low=low, width=width), "source").select("source", "n_tokens", bin_.alias("bin"))
        rows = placed.where((F.col("bin") >= 0) & (F.col("bin") < _BINS)).groupBy("source", "bin").agg(F.sum("n_tokens").alias("n")).collect()  # at most _BINS a source
        by: dict[str, list[tuple[int, float]]] = {}
        for r in rows:
            by.setdefault(r["source"], []).append((r["bin"], r["n"]))
        for s, goal in goals.items():
            total, chosen = below[s], None
            for k, n in sorted(by.get(s, [])):
                if total + n > goal:
                    chosen = k
                    break
                total += n
            if chosen is None:
                low[s], width[s], below[s] = low[s] + width[s] * _BINS, width[s] / _BINS, total
            else:
                low[s], width[s], below[s] = low[s] + chosen * width[s], width[s] / _BINS, total
    # the last bin, of about one document, is taken where that comes nearer to the goal
    edge = docs.join(_per_source(spark, low=low, width=width), "source").where("v >= low and v < low + width").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    for r in edge:
        s = r["source"]
        if abs(below[s] + r["n"] - goals[s]) < abs(below[s] - goals[s]):
            low[s] += width[s]
    return low


def mix(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    total_tokens: float | None = None,
    seed: int = 7,
    vocabulary: str = bpe.DEFAULT_VOCABULARY,
    prior: str | None = None,
    weight: str = "documents",
) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares): mixture has (id, source, n_tokens, copies) for each document that occurs; shares has the
    target, the reached share and the sizes of each source of `targets`. prior names a column of prior rates."""
    if weight not in ("documents", "tokens"):
        raise ValueError("weight must be documents or tokens")
    wanted = targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES or len({r["source"] for r in wanted}) < len(wanted):
        raise ValueError(f"targets must name each source once, and at most {MAX_SOURCES} of them")
    share = {r["source"]: float(r["target_share"] or 0) for r in wanted if (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    caps = {r["source"]: float(r["max_repeats"]) for r in wanted if r["source"] in share}
    spark = docs.sparkSession
    rated = docs.select(F.col(id_col), F.col("source"), F.col(text_col).alias("_text"), (F.coalesce(F.col(prior), F.lit(1)) if prior else F.lit(1)).cast("double").alias("prior"))
    listed = rated.join(_per_source(spark, cap=caps), "source", "left_semi") if share else rated.where(F.lit(False))
    sized = runtime.cut(count_tokens(listed.where("prior > 0"), "_text", [id_col, "source", "prior"], vocabulary=vocabulary).where("n_tokens > 0"))
    # a document's own cap may lie below its prior
    counts = runtime.cut(sized.groupBy("source", F.col("n_tokens").cast("double").alias("n"), "prior").agg(F.count("*").cast("double").alias("c")))
    sizes = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("c")).cast("long").alias("n")).collect()}
    live = {s: share[s] for s in share if s in sizes}
    whole = sum(live.values())
    live = {s: x / whole for s, x in live.items()}
    columns = [F.col(id_col), F.col("source"), F.col("n_tokens")]
    if live:
        largest = min(caps[s] * sizes[s] / live[s] for s in live)
        total = total_tokens and min(total_tokens, largest)
        # a source that the total needs whole is at its caps; the others are solved for
        full = {s for s in live if total and live[s] * total >= caps[s] * sizes[s] * (1 - 1e-9)}
        dual = {s: math.inf for s in full}
        if len(full) < len(live):
            rest = {s: x for s, x in live.items() if s not in full}
            part = sum(rest.values())
            open_ = counts.join(_per_source(spark, cap={s: caps[s] for s in rest}), "source", "left_semi")
            solved, found, _ = solve_rates(open_, {s: x / part for s, x in rest.items()}, caps, total and total * part, weight)
            dual |= solved
            total = total or found
        goals = {s: x * total for s, x in live.items()}
        known = _per_source(spark, cap={s: caps[s] for s in live}, lam={s: min(dual[s], 1e300) for s in live})
        x = F.col("lam") * (F.col("n_tokens") if weight == "documents" else F.lit(1.0))
        rate = F.least(F.col("cap"), F.col("prior") * F.exp(F.least(x, F.lit(_FULL))))
        rated = sized.join(known, "source").withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("rest", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
        unit = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) / float(1 << 52)
        rated = rated.withColumn("v", F.when(F.col("rest") > 0, unit / F.col("rest")))
        floors = {r["source"]: r["n"] for r in rated.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("base")).alias("n")).collect()}
        theta = _thresholds(rated.where("rest > 0").select("source", "n_tokens", "v"), {s: max(0.0, goals[s] - floors[s]) for s in live})
        copies = (F.col("base") + F.when(F.col("v") < F.col("theta"), 1).otherwise(0)).cast("int")
        mixture = rated.join(_per_source(spark, theta=theta), "source").withColumn("copies", copies).where("copies > 0").select(*columns, "copies")
    else:
        mixture = sized.where(F.lit(False)).select(*columns, F.lit(0).alias("copies"))
    reached = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("mixed_documents"), F.max("copies").alias("most_copies"))
    listing = spark.createDataFrame([(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0), int(sizes.get(r["source"], 0))) for r in wanted], "source string, target_share double, max_repeats int, source_tokens long")
    shares = (
        listing.join(reached, "source", "left")
        .fillna(0, ["mixed_tokens", "mixed_documents", "most_copies"])
        .join(reached.agg(F.sum("mixed_tokens").alias("all_tokens")))
        .select("source", "target_share", "max_repeats", "source_tokens", "mixed_documents", "most_copies", "mixed_tokens", F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"))
    )
    return mixture, shares
