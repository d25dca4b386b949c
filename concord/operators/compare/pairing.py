"""D8 — residual rows of a key paired by most equal columns.

The rule: of all rows that are left on both sides of a key, the pair with the
most equal columns (D5 equality) goes first; then the next, until one side is
used up.  Ties go to the first row in value order.

Two ways to the same rule:

* *Few rows* (at most ``PAIRS`` possible pairs of distinct rows in a key;
  nearly all keys): one aggregation brings a key's distinct rows together as
  two sorted arrays; the possible pairs are scored and taken in order inside
  the row.  A key with one row a side is a pair without scoring.
* *Hot keys*: nothing of a key is brought together.  Rows that agree in all
  columns, then in all but one, in canonical form, are paired by shuffles on
  the key *and* what agrees, since no other pair can have more equal columns.
  The rest meets in blocks of ``BLOCK`` by ``BLOCK`` distinct rows, each block
  pair a task of its own: every row proposes to its best partner, mutual bests
  pair, and so on until one side of each key is used up.  A block pair returns
  one best partner per row, never its pairs.  Ties go by a hash of the two
  rows, which lets many pairs form in one round.

Copies are counts: a pair takes as many copies as both sides have left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...session import written

PAIRS = 4096
BLOCK = 512


@dataclass
class Pairing:
    """``rows``: keys, columns, ``_side`` (0 source, 1 target), ``_n`` copies;
    one row for each distinct residual row of a key that both sides have."""

    keys: list[str]
    cols: list[str]
    types: dict[str, T.DataType]
    equal: Callable[[str, Column, Column], Column]     # column, source cell, target cell
    canonical: Callable[[str], Column]                 # text that tells a cell's value
    order: list[Column]                                # a row's value order
    max_pairs: int = PAIRS
    block: int = BLOCK

    def pairs(self, rows: DataFrame) -> DataFrame:
        """keys, ``s_<c>``, ``t_<c>``, ``_has_s``, ``_has_t``, ``_n``."""
        rows = written(rows, "residual")
        count = lambda side: F.count(F.when(F.col("_side") == side, 1))
        hot = rows.groupBy(*self.keys).agg(count(0).alias("_ns"), count(1).alias("_nt")).filter(F.col("_ns") * F.col("_nt") > self.max_pairs)
        hot = written(hot, "residual-hot")
        if hot.isEmpty():
            return self.few(rows)
        return self.few(self._of(rows, hot, "left_anti")).unionByName(self.many(self._of(rows, hot, "left_semi")))

    def _of(self, rows: DataFrame, keyed: DataFrame, how: str, extra: list[str] | None = None) -> DataFrame:
        r = keyed.select(*[F.col(k).alias("_r_" + k) for k in self.keys], *[F.col(c) for c in extra or []])
        return rows.join(r, self._same({k: (F.col(k), F.col("_r_" + k)) for k in self.keys}), how).drop(*["_r_" + k for k in self.keys])

    @staticmethod
    def _same(by: dict[str, tuple[Column, Column]]) -> Column:
        return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in by.values()])

    def n_equal(self, cell: Callable[[str, str], Column]) -> Column:
        """How many columns agree; ``cell(side, column)`` gives a value."""
        return reduce(lambda a, b: a + b, [F.when(self.equal(c, cell("s", c), cell("t", c)), 1).otherwise(0) for c in self.cols], F.lit(0))

    # ------------------------------------------------------------ few rows
    def few(self, rows: DataFrame) -> DataFrame:
        row = F.struct(*self.cols, "_n")
        side = lambda s: F.sort_array(F.collect_list(F.when(F.col("_side") == s, row)))
        met = rows.groupBy(*self.keys).agg(side(0).alias("_s"), side(1).alias("_t"))
        score = lambda s, t: self.n_equal(lambda p, c: (s if p == "s" else t)[c])
        edges = F.flatten(F.transform("_s", lambda s, i: F.transform("_t", lambda t, j: F.struct((-score(s, t)).alias("d"), i.alias("i"), j.alias("j")))))
        one = (F.size("_s") == 1) & (F.size("_t") == 1)
        edges = F.when(one, F.array(F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.array_sort(edges))
        copies = lambda side: F.transform(side, lambda r: r["_n"])
        spent = lambda left, at, n: F.transform(left, lambda x, k: F.when(k == at, x - n).otherwise(x))
        start = F.struct(F.array().cast("array<struct<i:int,j:int,n:bigint>>").alias("p"), copies("_s").alias("s"), copies("_t").alias("t"))

        def take(state: Column, e: Column) -> Column:
            n = F.least(F.get(state["s"], e["i"]), F.get(state["t"], e["j"]))
            pair = F.array(F.struct(e["i"].alias("i"), e["j"].alias("j"), n.alias("n")))
            return F.when(n > 0, F.struct(F.concat(state["p"], pair).alias("p"), spent(state["s"], e["i"], n).alias("s"),
                                          spent(state["t"], e["j"], n).alias("t"))).otherwise(state)

        end = met.withColumn("_e", F.aggregate(edges, start, take))
        none = F.lit(None).cast("int")
        rest = lambda side, i, j: F.filter(F.transform(F.col("_e")[side], lambda n, k: F.struct(i(k).alias("i"), j(k).alias("j"), n.alias("n"))), lambda r: r["n"] > 0)
        out = F.concat(F.col("_e.p"), rest("s", lambda k: k, lambda k: none), rest("t", lambda k: none, lambda k: k))
        end = end.withColumn("_p", F.explode(out))
        cell = lambda side, at, c: F.get(F.col(side), F.col("_p." + at))[c]
        return end.select(*self.keys, *[cell("_s", "i", c).alias("s_" + c) for c in self.cols], *[cell("_t", "j", c).alias("t_" + c) for c in self.cols],
                          F.col("_p.i").isNotNull().alias("_has_s"), F.col("_p.j").isNotNull().alias("_has_t"), F.col("_p.n").alias("_n"))

    # ------------------------------------------------------------ hot keys
    def many(self, rows: DataFrame) -> DataFrame:
        out = []
        if self.cols:
            canon = [self.canonical(c) for c in self.cols]
            met = self._meet(rows.withColumn("_group", F.xxhash64(*canon)), [*self.keys, "_group"])
            out.append(self._paired(met))
            rows = self._left(met)
        if len(self.cols) > 1:
            one = self._all_but_one(rows)
            met = self._meet(one.filter(F.col("_group").isNotNull()), [*self.keys, "_group"])
            out.append(self._paired(met))
            rows = self._left(met).unionByName(one.filter(F.col("_group").isNull()).drop("_group"))
        out.append(self._proposals(rows))
        return reduce(DataFrame.unionByName, out)

    def _meet(self, rows: DataFrame, group: list[str]) -> DataFrame:
        """Both sides of a group laid out in order, copies as intervals:
        every interval start opens a segment; the rows that cover it on both
        sides are a pair with as many copies as the segment is long.
        ``_left`` copies of the row itself lie beyond the shorter side."""
        whole = Window.partitionBy(*group)
        before = Window.partitionBy(*group, "_side").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        along = Window.partitionBy(*group).orderBy("_from", "_side")
        of = lambda side: F.when(F.col("_side") == side, F.struct(*self.cols, "_to"))
        r = rows.withColumn("_m", F.least(*[F.sum(F.when(F.col("_side") == s, F.col("_n")).otherwise(0)).over(whole) for s in (0, 1)]))
        r = r.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_to", F.col("_from") + F.col("_n"))
        r = r.withColumns({"_s": F.last(of(0), ignorenulls=True).over(along), "_t": F.last(of(1), ignorenulls=True).over(along),
                           "_next": F.lead("_from").over(along)})
        return r.withColumns({
            "_pairs": F.greatest(F.lit(0), F.when(F.col("_s").isNotNull() & F.col("_t").isNotNull(),
                                                  F.least("_next", "_s._to", "_t._to") - F.col("_from")).otherwise(0)),
            "_left": F.greatest(F.lit(0), F.col("_to") - F.greatest("_from", "_m"))})

    def _left(self, met: DataFrame) -> DataFrame:
        return met.filter("_left > 0").select(*self.keys, *self.cols, "_side", F.col("_left").alias("_n"))

    def _paired(self, met: DataFrame) -> DataFrame:
        return met.filter("_pairs > 0").select(
            *self.keys, *[F.col("_s." + c).alias("s_" + c) for c in self.cols], *[F.col("_t." + c).alias("t_" + c) for c in self.cols],
            F.lit(True).alias("_has_s"), F.lit(True).alias("_has_t"), F.col("_pairs").alias("_n"))

    def _all_but_one(self, rows: DataFrame) -> DataFrame:
        """Each row under the first column without which the other side of
        its key has an agreeing row (``_group``; null: none).  The hash
        without a column is the hash of all columns less that column's."""
        each = F.array(*[F.xxhash64(F.lit(j), self.canonical(c)) for j, c in enumerate(self.cols)])
        rows = written(rows.withColumn("_h", each).withColumn("_all", F.aggregate("_h", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))), "all-but-one")
        names = F.transform("_h", lambda x, j: F.struct(j.alias("j"), x.bitwiseXOR(F.col("_all")).alias("h")))
        found = rows.select(*self.keys, "_side", F.explode(names).alias("_c")).groupBy(*self.keys, "_c").agg(
            F.min("_side").alias("a"), F.max("_side").alias("b")).filter("a <> b").select(*self.keys, "_c")
        row_id = F.xxhash64(*self.cols, "_side")
        ids = rows.select(*self.keys, row_id.alias("_row"), F.explode(names).alias("_c"))
        found = found.select(*[F.col(k).alias("_r_" + k) for k in self.keys], F.col("_c").alias("_r__c"))
        first = ids.join(found, self._same({k: (F.col(k), F.col("_r_" + k)) for k in [*self.keys, "_c"]})).groupBy(*self.keys, "_row").agg(F.min("_c").alias("_c"))
        first = first.select(*[F.col(k).alias("_r_" + k) for k in self.keys], F.col("_row").alias("_r__row"), F.xxhash64("_c.j", "_c.h").alias("_group"))
        return (rows.drop("_h", "_all").withColumn("_row", row_id)
                .join(first, self._same({k: (F.col(k), F.col("_r_" + k)) for k in [*self.keys, "_row"]}), "left")
                .select(*self.keys, *self.cols, "_side", "_n", "_group"))

    def _proposals(self, rows: DataFrame) -> DataFrame:
        """Mutual best partners, round after round, in blocks."""
        keys, rows = self.keys, written(rows.withColumn("_id", F.xxhash64(*self.keys, *self.cols, "_side")), "proposals")
        left, taken = rows, []
        count = lambda side: F.count(F.when(F.col("_side") == side, 1))
        while True:
            blocks = left.groupBy(*keys).agg(count(0).alias("_b0"), count(1).alias("_b1")).filter("_b0 > 0 AND _b1 > 0")
            blocks = written(blocks.withColumns({b: F.ceil(F.col(b) / self.block).cast("int") for b in ("_b0", "_b1")}), "proposal-blocks")
            if blocks.isEmpty():
                break
            dealt = self._of(left, blocks, "inner", ["_b0", "_b1"])
            own = lambda b: F.pmod(F.xxhash64("_id", F.lit(b)), F.col(b)).cast("int")
            every = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
            s = dealt.filter("_side = 0").withColumn("_p0", own("_b0")).withColumn("_p1", every("_b1"))
            t = dealt.filter("_side = 1").withColumn("_p1", own("_b1")).withColumn("_p0", every("_b0"))
            names = [*keys, "_p0", "_p1", *self.cols, "_id", "_n"]
            s, t = (d.select(*[F.col(c).alias(p + c) for c in names]) for d, p in ((s, "s"), (t, "t")))
            met = s.join(t, self._same({c: (F.col("s" + c), F.col("t" + c)) for c in [*keys, "_p0", "_p1"]}))
            met = met.withColumn("_e", F.struct(self.n_equal(lambda p, c: F.col(p + c)).alias("n"), F.xxhash64("s_id", "t_id").alias("h")))
            best = lambda mine, other, name: met.groupBy(*["s" + k for k in keys], mine).agg(F.max(F.struct("_e", other, "s_n", "t_n")).alias(name))
            of_s = best("s_id", "t_id", "_bs").select("s_id", F.col("_bs.t_id").alias("to"), F.least("_bs.s_n", "_bs.t_n").alias("n"))
            of_t = best("t_id", "s_id", "_bt").select("t_id", F.col("_bt.s_id").alias("from"))
            pairs = written(of_s.join(of_t, (F.col("to") == F.col("t_id")) & (F.col("from") == F.col("s_id"))).select("s_id", "t_id", "n"), "proposal-pairs")
            taken.append(pairs)
            spent = pairs.select(F.explode(F.array("s_id", "t_id")).alias("_sid"), F.col("n").alias("_spent"))
            left = written(left.join(spent, F.col("_id") == F.col("_sid"), "left").withColumn("_n", F.col("_n") - F.coalesce("_spent", F.lit(0)))
                           .filter("_n > 0").select(*rows.columns), "proposals")
        null = lambda c: F.lit(None).cast(self.types[c])
        out = [left.filter(F.col("_side") == side).select(
            *keys, *[(F.col(c) if p == has else null(c)).alias(p + c) for p in ("s_", "t_") for c in self.cols],
            F.lit(side == 0).alias("_has_s"), F.lit(side == 1).alias("_has_t"), "_n") for side, has in ((0, "s_"), (1, "t_"))]
        if taken:
            pairs = reduce(DataFrame.unionByName, taken)
            s = rows.filter("_side = 0").select(*keys, F.col("_id").alias("_s"), *[F.col(c).alias("s_" + c) for c in self.cols])
            t = rows.filter("_side = 1").select(F.col("_id").alias("_t"), *[F.col(c).alias("t_" + c) for c in self.cols])
            out.append(pairs.join(s, F.col("s_id") == F.col("_s")).join(t, F.col("t_id") == F.col("_t")).select(
                *keys, *["s_" + c for c in self.cols], *["t_" + c for c in self.cols], F.lit(True).alias("_has_s"), F.lit(True).alias("_has_t"), F.col("n").alias("_n")))
        return reduce(DataFrame.unionByName, out)
