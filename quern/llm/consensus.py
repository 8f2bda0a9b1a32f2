"""Consensus of several annotators by message passing on the graph of items and annotators.

Each answer of an annotator on a field of an item is an edge. Messages in both directions are repeated until no
annotator's rates move by more than the tolerance; a run that doesn't settle is an error:
- item to annotator: the log-odds that the class (one label against the rest) is right, from the class's frequency and the
  messages of the item's other annotators. The annotator joins its own answer to it, under its present rates, and has
  its share in right and wrong answers; together that is the item's belief, the same for all its annotators, so an
  item's messages are kept as one number;
- annotator to item: the weight of the answer, as a log-likelihood ratio, from the annotator's rates on all other
  items: the item's own share is taken out, so an answer doesn't confirm itself. A first phase takes one rate of right
  answers per annotator and no class frequency, which tells careful from careless and contrary annotators. From there
  the second phase takes a rate where the class holds and one where it doesn't, per annotator and field, which also
  finds those who always give the same answer; few answers are drawn towards the annotator's rate over all fields,
  and that towards 0.7.
The label is the sign of the sum of all messages of an item.

Edges are gathered by item once, as arrays of a row per item and field (an item has few annotators; one of more than
`item_rows` answers is a row for each part, whose weights are added up). A round is a narrow pass that writes a belief per
item and field, and one aggregate of sums per annotator and field; nothing else is shuffled. Up to MAX_BROADCAST
annotators their rates are broadcast; beyond, edges and rates are joined by shuffle.

Of an annotator's submissions for an item the one with the latest time counts, as a whole (null times count as the
earliest, ties go to the largest answers). Defined cases: answers that are neither yes nor no are no edges; an item's
field without any edge gets the more frequent label and agreement null; a tie goes to the more frequent label; rows
with null item or annotator are left out; exact duplicates count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern import runtime

#: Annotators up to which their rates are broadcast (some 60 bytes each and field); beyond, they are joined by shuffle.
MAX_BROADCAST = 50_000
_PRIOR_RATE, _PRIOR_WEIGHT, _FIELD_WEIGHT, _LEAST = 0.7, 4.0, 12.0, 0.02
_RATES = ["n1", "n0", "t1", "t0", "care", "all_t", "all_n", "r1", "r0"]


def as_yes(column):
    """1 for yes, 0 for no in any spelling, else null."""
    bare = F.upper(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(bare.isin("YES", "Y"), 1).when(bare.isin("NO", "N"), 0)


def latest(df: DataFrame, item: str, annotator: str, time: str, fields: list[str]) -> DataFrame:
    last = F.max(F.struct(F.col(time).isNotNull().alias("_has"), F.col(time).alias("_at"), *[as_yes(F.col(f)).alias(f) for f in fields])).alias("last")
    rows = df.where(F.col(item).isNotNull() & F.col(annotator).isNotNull()).groupBy(F.col(item).alias("item"), F.col(annotator).alias("annotator")).agg(last)
    return rows.select("item", "annotator", *[F.col(f"last.{f}").alias(f) for f in fields])


class Rates:
    """What annotators' answers weigh, by annotator (its hash) and field; for the workers."""

    def __init__(self, stats: list, fields: list[str]) -> None:
        self.fields = {f: k for k, f in enumerate(fields)}
        self.annotators = np.unique(np.array([r["annotator"] for r in stats], np.int64))
        self.values = np.full((len(_RATES), len(self.annotators) * len(fields)), np.nan)
        self.frequency = np.full(len(fields), 0.5)
        if stats:
            at = np.searchsorted(self.annotators, [r["annotator"] for r in stats]) * len(fields) + [self.fields[r["field"]] for r in stats]
            self.values[:, at] = np.array([[r[c] for c in _RATES] for r in stats]).T
            for r in stats:
                self.frequency[self.fields[r["field"]]] = r["frequency"]

    def weights(self, annotator: np.ndarray, field: np.ndarray, y: np.ndarray, p: np.ndarray, fine: bool) -> np.ndarray:
        """The message of each answer to its item, without what the item itself (p) gave to the annotator's rates."""
        n1, n0, t1, t0, care, all_t, all_n, _, _ = self.values[:, np.searchsorted(self.annotators, annotator) * len(self.fields) + field]
        if fine:
            r1 = (t1 - p * y + care * _FIELD_WEIGHT) / (n1 - p + _FIELD_WEIGHT)
            r0 = (t0 - (1 - p) * (1 - y) + care * _FIELD_WEIGHT) / (n0 - (1 - p) + _FIELD_WEIGHT)
        else:
            r1 = r0 = (all_t - np.where(y == 1, p, 1 - p) + _PRIOR_RATE * _PRIOR_WEIGHT) / (all_n - 1 + _PRIOR_WEIGHT)
        r1, r0 = np.clip(r1, _LEAST, 1 - _LEAST), np.clip(r0, _LEAST, 1 - _LEAST)
        return np.where(y == 1, np.log(r1 / (1 - r0)), np.log((1 - r1) / r0))


class Consensus:
    def __init__(self, df: DataFrame, item: str, annotator: str, time: str, fields: list[str], rounds: int = 300, tolerance: float = 1e-3, item_rows: int = 10_000) -> None:
        self.fields, self.item, self.annotator, self.spark = fields, item, annotator, df.sparkSession
        runtime.ship(self.spark)
        answers = latest(df, item, annotator, time, fields)
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("y")) for f in fields])).alias("e")
        self.slots = runtime.cut(answers.select("item", F.col("annotator").alias("name"), F.xxhash64("annotator").alias("annotator"), each).select("item", "name", "annotator", "e.field", "e.y"))
        edges = self.slots.where("y is not null").select("item", "field", "annotator", "y")
        self.few = edges.select("annotator").distinct().limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        sizes = edges.groupBy("item", "field").agg(F.count("*").alias("n"), F.sum("y").alias("yes"))
        flat = edges.limit(0)
        if not self.few:
            edges, flat = flat, edges
        elif (large := runtime.cut(sizes.where(F.col("n") > item_rows).select("item", "field"))).count():
            flat, edges = edges.join(large, ["item", "field"], "left_semi"), edges.join(large, ["item", "field"], "left_anti")
        answer = F.collect_list(F.struct("annotator", "y")).alias("e")
        packed = edges.groupBy("item", "field").agg(answer, F.count("*").alias("n"), F.sum("y").alias("yes"))
        packed = runtime.cut(packed.select("item", "field", "n", "yes", F.col("e.annotator").alias("a"), F.col("e.y").alias("y"), F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("s")))
        self.has_flat = bool(flat.limit(1).count())
        if self.has_flat:
            flat = flat.join(sizes, ["item", "field"]).select("item", "field", "annotator", "y", self._others().alias("p"))
        self.rounds = 0
        for fine in (False, True):
            before = None
            while True:
                self.rounds += 1
                if self.has_flat:
                    flat = runtime.cut(flat)
                stats = runtime.cut(self._stats(self._edges(packed, flat)))
                rates = Rates(stats.collect(), fields) if self.few else None  # at most MAX_BROADCAST annotators
                if before is not None and self._moved(before, (stats, rates)) <= tolerance:
                    break
                if self.rounds > rounds:
                    raise RuntimeError(f"the annotators' rates didn't settle in {rounds} rounds")
                before = (stats, rates)
                packed = runtime.cut(self._pass_packed(packed, rates, fine)) if self.few else packed
                flat = self._pass(flat, stats, fine)[0] if self.has_flat else flat
        self.packed, self.flat, self.stats, self.rates = packed, flat, stats, rates

    @staticmethod
    def _others():
        """The share of yes in the other answers of an item; a half where there are none."""
        return F.when(F.col("n") > 1, (F.col("yes") - F.col("y")) / (F.col("n") - 1)).otherwise(F.lit(0.5))

    def _edges(self, packed: DataFrame, flat: DataFrame) -> DataFrame:
        """(annotator, field, y, p) of all edges."""
        some = packed.select("field", "n", "yes", "p", F.explode(F.arrays_zip("a", "y")).alias("e")).select("field", "n", "yes", "p", F.col("e.a").alias("annotator"), F.col("e.y").alias("y"))
        some = some.select("annotator", "field", "y", F.coalesce("p", self._others()).alias("p"))
        return some.unionByName(flat.select("annotator", "field", "y", "p")) if self.has_flat else some

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def _moved(self, before: tuple, now: tuple) -> float:
        """The largest change of a rate."""
        if self.few:
            a, b = (x[1].values[-2:] for x in (before, now))
            return float(np.nanmax(np.abs(a - b), initial=0.0)) if a.size and not np.isnan(a).all() else 0.0
        old = before[0].select("annotator", "field", F.col("r1").alias("o1"), F.col("r0").alias("o0"))
        return now[0].join(old, ["annotator", "field"]).agg(F.max(F.greatest(F.abs(F.col("r1") - F.col("o1")), F.abs(F.col("r0") - F.col("o0")))).alias("m")).collect()[0]["m"] or 0.0

    def _stats(self, edges: DataFrame) -> DataFrame:
        """Per annotator and field: sums of beliefs and right answers, and the rates they are drawn towards."""
        right = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
        own = edges.groupBy("annotator", "field").agg(
            F.sum("p").alias("n1"), F.sum(1 - F.col("p")).alias("n0"), F.sum(F.col("p") * F.col("y")).alias("t1"),
            F.sum((1 - F.col("p")) * (1 - F.col("y"))).alias("t0"), F.sum(right).alias("t"), F.count("*").alias("n"),
        )
        own = runtime.cut(own)
        whole = own.groupBy("annotator").agg(F.sum("t").alias("all_t"), F.sum("n").alias("all_n")).withColumn("care", (F.col("all_t") + _PRIOR_RATE * _PRIOR_WEIGHT) / (F.col("all_n") + _PRIOR_WEIGHT))
        base = own.groupBy("field").agg(((F.sum("n1") + 1) / (F.sum("n1") + F.sum("n0") + 2)).alias("frequency"))
        out = own.join(self._small(whole), "annotator").join(F.broadcast(base), "field")
        rate = lambda t, n: (F.col(t) + F.col("care") * _FIELD_WEIGHT) / (F.col(n) + _FIELD_WEIGHT)
        return out.withColumn("r1", rate("t1", "n1")).withColumn("r0", rate("t0", "n0"))

    def _pass_packed(self, packed: DataFrame, rates: Rates, fine: bool) -> DataFrame:
        """The same rows with the next belief p and sum of messages s."""
        shared, kind = self.spark.sparkContext.broadcast(rates), packed.schema.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                field = np.array([known.fields[f] for f in b.column(1).to_pylist()], np.int64)
                n, yes, lists = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4)
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                a, y = lists.flatten().to_numpy(), b.column(5).flatten().to_numpy().astype(float)
                p = b.column(6).to_numpy(zero_copy_only=False).astype(float)[row]
                first = np.isnan(p)
                p[first] = np.where(n > 1, 0, 0.5)[row][first] + (((yes[row] - y) / np.maximum(n - 1, 1)[row]) * (n > 1)[row])[first]
                s = np.bincount(row, known.weights(a, field[row], y, p, fine), b.num_rows)
                odds = np.log(known.frequency / (1 - known.frequency))[field] if fine else 0.0
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(1 / (1 + np.exp(-(s + odds)))), pa.array(s)], names=b.schema.names)

        return packed.mapInArrow(run, packed.schema)

    def _pass(self, state: DataFrame, stats: DataFrame, fine: bool) -> tuple[DataFrame, DataFrame]:
        """As _pass_packed, for flat edges: (next edges, sums of messages per item and field)."""
        e = state.join(self._small(stats.select("annotator", "field", "n1", "n0", "t1", "t0", "care", "all_t", "all_n", "frequency")), ["annotator", "field"])
        clip = lambda c: F.greatest(F.lit(_LEAST), F.least(F.lit(1 - _LEAST), c))
        r1 = clip((F.col("t1") - F.col("p") * F.col("y") + F.col("care") * _FIELD_WEIGHT) / (F.col("n1") - F.col("p") + _FIELD_WEIGHT))
        r0 = clip((F.col("t0") - (1 - F.col("p")) * (1 - F.col("y")) + F.col("care") * _FIELD_WEIGHT) / (F.col("n0") - (1 - F.col("p")) + _FIELD_WEIGHT))
        if not fine:
            own = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
            r1 = r0 = clip((F.col("all_t") - own + _PRIOR_RATE * _PRIOR_WEIGHT) / (F.col("all_n") - 1 + _PRIOR_WEIGHT))
            e = e.withColumn("frequency", F.lit(0.5))
        e = e.select("item", "field", "annotator", "y", "frequency", r1.alias("r1"), r0.alias("r0"))
        e = e.withColumn("w", F.when(F.col("y") == 1, F.log(F.col("r1") / (1 - F.col("r0")))).otherwise(F.log((1 - F.col("r1")) / F.col("r0"))))
        sums = e.groupBy("item", "field").agg(F.sum("w").alias("s"), F.max(F.log(F.col("frequency") / (1 - F.col("frequency")))).alias("base"), F.count("*").alias("n"), F.sum("y").alias("yes"))
        new = e.select("item", "field", "annotator", "y").join(sums.select("item", "field", "s", "base"), ["item", "field"])
        new = new.select("item", "field", "annotator", "y", (1 / (1 + F.exp(-(F.col("base") + F.col("s"))))).alias("p"))
        return new, sums.select("item", "field", "s", "n", "yes")

    def labels(self) -> DataFrame:
        """(item, field_name, label, belief, n_answers, agreement) of each item and field."""
        parts = [self._pass_packed(self.packed, self.rates, True).select("item", "field", "s", "n", "yes")] if self.few else []
        parts += [self._pass(self.flat, self.stats, True)[1]] if self.has_flat else []
        sums = reduce(DataFrame.unionByName, parts) if parts else self.packed.select("item", "field", "s", "n", "yes")
        base = F.broadcast(self.stats.groupBy("field").agg(F.max("frequency").alias("frequency")))
        slots = self.slots.select("item", "field").distinct()
        out = slots.join(sums, ["item", "field"], "left").join(base, "field", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.5)))
        z = F.coalesce(F.col("s"), F.lit(0.0)) + F.log(F.col("frequency") / (1 - F.col("frequency")))
        out = out.withColumn("z", z).withColumn("label", F.when(F.col("z") > 0, "YES").when(F.col("z") < 0, "NO").otherwise(F.when(F.col("frequency") > 0.5, "YES").otherwise("NO")))
        same = F.when(F.col("label") == "YES", F.col("yes")).otherwise(F.col("n") - F.col("yes"))
        return out.select(F.col("item").alias(self.item), F.col("field").alias("field_name"), "label", (1 / (1 + F.exp(-F.abs("z")))).alias("belief"), F.coalesce("n", F.lit(0)).cast("long").alias("n_answers"), (same / F.col("n")).alias("agreement"))

    def reliability(self) -> DataFrame:
        """(annotator, reliability, n_answers, rates of right answers by field) of each annotator."""
        rates = reduce(lambda a, f: a + [F.max(F.when(F.col("field") == f, F.col("r1"))).alias(f"yes_{f}"), F.max(F.when(F.col("field") == f, F.col("r0"))).alias(f"no_{f}")], self.fields, [])
        names = self.slots.where("y is not null").groupBy("annotator").agg(F.first("name").alias(self.annotator))
        own = self.stats.groupBy("annotator").agg(F.max("care").alias("reliability"), F.sum("n").alias("n_answers"), *rates)
        return own.join(self._small(names), "annotator").select(self.annotator, *[c for c in own.columns if c != "annotator"])
