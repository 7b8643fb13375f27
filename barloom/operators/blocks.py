"""One series over many tasks.

A window by symbol puts a whole symbol into one task. Here rows are dealt to blocks of a symbol instead, in two ways:

- `scan`: running sums, products, extremes and last values over all rows so far. Each block is reduced to one row, the rows of the
  blocks are scanned, and what stands before a block is applied to its rows: a prefix scan over an associative operator.
- `in_blocks`: windows of a bounded number of rows. Blocks have equal numbers of rows, and each also gets the rows before it that its frames reach into.

No window here has a partition key without a block, but for those over one row a block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import windows as win
from ..sources.shared import written

#: Rows of a block.
BLOCK_ROWS = 100_000
#: Long series whose spans are broadcast, of some 60 bytes each; past that they are joined.
BROADCAST_SPANS = 1_000_000


def time_blocks(df: DataFrame, keys: Sequence[str] = win.KEYS, order: str = win.ORDER, rows: int = BLOCK_ROWS) -> DataFrame:
    """df with _block: series of more than `rows` rows are cut into equal stretches of `order`, as many as give `rows` rows on average.

    `order` is a time or a number. Bars of one interval have at most one row in it, so a block of theirs is bounded by its stretch. Where rows come in bursts a
    block holds more of them; number_rows and in_blocks then deal by number.
    """
    timed = df.schema[order].dataType.typeName().startswith("timestamp")
    at = (lambda a, b: F.expr(f"cast(timestampdiff(microsecond, {a}, {b}) as double)")) if timed else (lambda a, b: (F.col(b) - F.col(a)).cast("double"))
    spans = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count("*").alias("_n"))
    spans = spans.where(F.col("_n") > rows).select(*keys, "_lo", F.ceil(F.col("_n") / rows).alias("_parts"), at("_lo", "_hi").alias("_span"))
    spans = written(spans, "spans")
    few = spans.count() <= BROADCAST_SPANS
    out = df.join(F.broadcast(spans) if few else spans, list(keys), "left")
    place = F.floor(at("_lo", order) * F.col("_parts") / F.greatest("_span", F.lit(1e-9)))
    block = F.coalesce(F.least(place, F.col("_parts") - 1), F.lit(0)).cast("long")
    return out.withColumn("_block", block).drop("_lo", "_parts", "_span")


@dataclass(frozen=True)
class Running:
    """A running value: kind is sum, product, max, min or last (the last that is not null)."""

    value: Column
    kind: str


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


_OVER: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min, "last": _last}


def _together(kind: str, before: Column, here: Column) -> Column:
    """What a running value is where `before` stands ahead of the block and `here` is its part within; nulls are nothing."""
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(before, here)
    if kind == "last":
        return F.coalesce(here, before)
    return F.coalesce(before + here if kind == "sum" else before * here, before, here)


def scan(blocked: DataFrame, running: dict[str, Running], keys: Sequence[str] = win.KEYS, order: str = win.ORDER) -> DataFrame:
    """blocked (of time_blocks) with the running values up to each row. `order` is unique within a series."""
    w = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({name: _OVER[r.kind](r.value).over(w) for name, r in running.items()})
    ends = local.groupBy(*keys, "_block").agg(F.max_by(F.struct(*running), order).alias("_end"))
    past = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "_block", *[_OVER[r.kind](F.col(f"_end.{name}")).over(past).alias(f"_before_{name}") for name, r in running.items()])
    out = local.join(before, [*keys, "_block"])
    whole = {name: _together(r.kind, F.col(f"_before_{name}"), F.col(name)) for name, r in running.items()}
    return out.withColumns(whole).select(*blocked.columns, *running)


def number_rows(df: DataFrame, keys: Sequence[str] = win.KEYS, order: str = win.ORDER, rows: int = BLOCK_ROWS, name: str = "t") -> DataFrame:
    """df with the number of each row within its series, from 0."""
    counted = scan(time_blocks(df, keys, order, rows), {name: Running(F.lit(1).cast("long"), "sum")}, keys, order)
    return counted.withColumn(name, F.col(name) - 1).drop("_block")


def equity_path(df: DataFrame, ret: str = "ret", keys: Sequence[str] = win.KEYS, order: str = win.ORDER, rows: int = BLOCK_ROWS) -> DataFrame:
    """df with equity (the product of 1 + ret, nulls being no return), peak and drawdown so far.

    One scan over the triple of a block's product and the highest and lowest of its running products: the peak of a block that begins at equity e is e times the
    highest, or the lowest where e is negative.
    """
    blocked = time_blocks(df, keys, order, rows)
    w = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("_eq", F.product(F.coalesce(ret, F.lit(0.0)) + 1).over(w))
    local = local.withColumns({"_top": F.max("_eq").over(w), "_low": F.min("_eq").over(w)})
    ends = local.groupBy(*keys, "_block").agg(F.max_by(F.struct("_eq", "_top", "_low"), order).alias("_end"))
    past = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("_e", F.coalesce(F.product("_end._eq").over(past), F.lit(1.0)))
    before = before.withColumn("_p", F.max(F.when(F.col("_e") >= 0, F.col("_e") * F.col("_end._top")).otherwise(F.col("_e") * F.col("_end._low"))).over(past)).drop("_end")
    peak = F.greatest("_p", F.when(F.col("_e") >= 0, F.col("_e") * F.col("_top")).otherwise(F.col("_e") * F.col("_low")))
    out = local.join(before, [*keys, "_block"]).withColumns({"equity": F.col("_e") * F.col("_eq"), "peak": peak})
    out = out.withColumn("drawdown", F.col("equity") / F.nullif("peak", F.lit(0.0)) - 1)
    kept = [c for c in df.columns if c not in ("equity", "peak", "drawdown")]
    return out.select(*kept, "equity", "peak", "drawdown")


def in_blocks(df: DataFrame, before: int, add: Callable[[DataFrame, WindowSpec], DataFrame], keys: Sequence[str] = win.KEYS, order: str = win.ORDER, rows: int = BLOCK_ROWS) -> DataFrame:
    """add(df, w) as over whole series, for windows that reach back `before` rows at most; w is a window ordered within a block.

    Every block gets copies of the `before` rows ahead of it, which are dropped in the end. With blocks of far more rows than that the copies are few.
    """
    dealt = number_rows(df, keys, order, rows, "_t")
    own, upto = F.floor(F.col("_t") / rows), F.floor((F.col("_t") + before) / rows)
    dealt = dealt.withColumn("_piece", F.explode(F.sequence(own, upto))).withColumn("_own", F.floor(F.col("_t") / rows) == F.col("_piece"))
    out = add(dealt, Window.partitionBy(*keys, "_piece").orderBy(order))
    return out.where("_own").drop("_t", "_piece", "_own")


def with_ema(df: DataFrame, columns: dict[str, tuple[str, int]], w: WindowSpec | None = None) -> DataFrame:
    """df with exponential means, name -> (column, span): weights normalised over the values there are, from the first row on.

    A row is the affine map that a mean goes through there, x -> d x + v; maps of 1, 2, 4, ... rows are composed by doubling, so that the last map
    covers every row whose weight counts in double precision, after log2 of their number of steps. Nulls are the identity: a value's weight falls with the
    values after it, not with the rows.
    """
    w = w or win.spec()
    steps = {name: win.ema_span(n).bit_length() for name, (_, n) in columns.items()}
    keep = {name: 1 - 2 / (n + 1) for name, (_, n) in columns.items()}
    state = {f"_{name}": F.struct(F.coalesce(c, F.lit(0.0)).cast("double").alias("num"), F.col(c).isNotNull().cast("double").alias("den")) for name, (c, _) in columns.items()}
    out = df.withColumns(state)
    for k in range(max(steps.values())):
        live = [name for name in columns if k < steps[name]]
        out = out.withColumns({f"_before_{name}": F.lag(f"_{name}", 1 << k).over(w) for name in live})
        for name in live:
            here, old = F.col(f"_{name}"), F.col(f"_before_{name}")
            # The maps' factor, d to the number of values, follows from the sum of the weights.
            factor = F.lit(1.0) - here["den"] * (1 - keep[name])
            joined = F.struct((here["num"] + factor * old["num"]).alias("num"), (here["den"] + factor * old["den"]).alias("den"))
            out = out.withColumn(f"_{name}", F.when(old.isNull(), here).otherwise(joined))
        out = out.drop(*[f"_before_{name}" for name in live])
    means = {name: F.col(f"_{name}.num") / F.nullif(F.col(f"_{name}.den"), F.lit(0.0)) for name in columns}
    return out.withColumns(means).drop(*[f"_{name}" for name in columns])


def with_rolling_drawdown(df: DataFrame, n: int, ret: str = "ret", name: str = "rolling_max_drawdown", w: WindowSpec | None = None) -> DataFrame:
    """df with the deepest fall from a peak within each frame of n returns; equity starts anew in each frame, at its first return. Null until a frame is full.

    A sparse table over a monoid: of 1, 2, 4, ... rows the product, the highest and the lowest running product, and the least ratio to a peak. A frame is put together from
    the table's entries for the bits of n, so a row costs log2(n) lags and holds no list.
    """
    w = w or win.spec()
    one = F.coalesce(ret, F.lit(0.0)).cast("double") + 1
    out = df.withColumns({"_full": F.count(ret).over(w.rowsBetween(1 - n, 0)) == n, "_m0": F.struct(one.alias("p"), one.alias("hi"), one.alias("lo"), F.lit(1.0).alias("d"))})

    def joined(old: Column, new: Column) -> Column:
        fall = old["p"] * new["lo"] / F.nullif(old["hi"], F.lit(0.0))
        parts = {"p": old["p"] * new["p"], "hi": F.greatest(old["hi"], old["p"] * new["hi"]), "lo": F.least(old["lo"], old["p"] * new["lo"]), "d": F.least(old["d"], new["d"], fall)}
        return F.when(old.isNotNull() & new.isNotNull(), F.struct(*[c.alias(k) for k, c in parts.items()]))

    levels = n.bit_length()
    for k in range(levels - 1):
        out = out.withColumn("_old", F.lag(f"_m{k}", 1 << k).over(w)).withColumn(f"_m{k + 1}", joined(F.col("_old"), F.col(f"_m{k}"))).drop("_old")
    bits, behind, places = [k for k in reversed(range(levels)) if n >> k & 1], 0, {}
    for k in bits:
        places[f"_b{k}"] = F.lag(f"_m{k}", behind).over(w) if behind else F.col(f"_m{k}")
        behind += 1 << k
    out = out.withColumns(places).withColumn("_all", F.col(f"_b{bits[0]}"))
    for k in bits[1:]:
        out = out.withColumn("_all", joined(F.col(f"_b{k}"), F.col("_all")))
    return out.withColumn(name, F.when(F.col("_full"), F.least(F.lit(0.0), F.col("_all.d") - 1))).drop("_full", "_all", *places, *[f"_m{k}" for k in range(levels)])
