"""Bootstrap, permutation and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import indicators as ind
from ..operators import metrics as m
from ..operators import resample as rs
from ..operators import tests as ts
from . import sql
from .q_metrics import rd
from .q_windows import damped_weekly, r
from .registry import query

N = LONG = 1000  # paths of each query
KERNEL = 100  # paths whose kernel distance SQL can find in time; bst08_full_analysis takes LONG
FLIPS = 10_000

SERIES = "s as (select symbol as series, row_number() over (partition by symbol order by ts) - 1 as t, ret from r where ret is not null), z as (select series, count(*) as n, avg(ret) as mu from s group by 1)"


def grid(n_sims: int) -> str:
    return f"g as (select series, n, mu, sim, t from z, (select unnest(range({n_sims})) as sim), (select unnest(range(2000)) as t) where t < n)"


_INDEX = {
    "iid": f"{rng.draw_sql('sim', 't', 7)} % n",
    "block": f"{rng.draw_sql('sim', 't // 20', 7)} % (n - 20 + 1) + t % 20",
    "circular": f"({rng.draw_sql('sim', 't // 20', 7)} % n + t % 20) % n",
    "stationary": f"({rng.draw_sql('sim', 'at_', 7)} % n + t - at_) % n",
    "wild": "t",
}


def samples(method: str, n_sims: int = N) -> str:
    """CTEs up to p: (series, sim, t, ret)."""
    value = f"mu + (s.ret - mu) * ({rng.draw_sql('sim', 'i.t', 7)} % 2 * 2 - 1)" if method == "wild" else "s.ret"
    at = f"last_value(case when t = 0 or {rng.uniform_sql('sim', 't', 7 + 15485863)} < 1.0::double / 20 then t end ignore nulls) over (partition by series, sim order by t rows unbounded preceding)" if method == "stationary" else "0"
    return f"{SERIES}, {grid(n_sims)}, g1 as (select *, {at} as at_ from g), i as (select *, {_INDEX[method]} as idx from g1), p as (select i.series, i.sim, i.t, {value} as ret from i join s on s.series = i.series and s.t = i.idx)"


def series(spark, sf):
    return rs.series_of(ind.with_returns(damped_weekly(spark, sf)))


def paths(spark, sf, method, n_sims=N):
    return rs.resample(series(spark, sf), n_sims, method, 20, 7)


def _stats_sql() -> str:
    return """pq as (select *, product(1 + ret) over w as eq from p window w as (partition by series, sim order by t rows unbounded preceding)), pd as (select *, eq / max(eq) over (partition by series, sim order by t rows unbounded preceding) - 1 as dd from pq),
    st as (select series, sim, product(1 + ret) - 1 as total_return, stddev_samp(ret) * sqrt(52) as volatility, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52) as sharpe, min(dd) as max_drawdown from pd group by 1, 2)"""


def path_stats(p):
    full = m.simulation_metrics(p, ("series", "sim"), "t", 52)
    return full.select("series", "sim", F.col("cumulative_return").alias("total_return"), "volatility", "sharpe", "max_drawdown")


_METRICS = ["total_return", "volatility", "sharpe", "max_drawdown"]

for _k, _method in enumerate(rs.METHODS, 1):

    def _one(method):
        def run(spark, sf):
            return rd(path_stats(paths(spark, sf, method)), ["series", "sim"])

        return run

    query(f"bst{_k:02d}_{_method}_bootstrap", sql.bars("y", samples(_method) + ", " + _stats_sql()) + f"select series, sim, {', '.join(f'round({c}, 6) as {c}' for c in _METRICS)} from st")(_one(_method))


@query("bst06_09_10_11_intervals", sql.bars("y", samples("block") + ", " + _stats_sql()) + " union all ".join(f"select series, '{c}' as metric, round(avg({c}), 6) as mean, round(quantile_cont({c}, 0.025), 6) as lo, round(quantile_cont({c}, 0.975), 6) as hi, round(avg(({c} > 0)::double), 6) as p_positive from st group by 1" for c in _METRICS))
def _(spark, sf):
    return rd(rs.intervals(path_stats(paths(spark, sf, "block")), _METRICS), ["series", "metric"])


@query("viz01_02_equity_fan", sql.bars("y", samples("iid") + ", " + _stats_sql()) + f"select series, t, {', '.join(f'round(quantile_cont(eq, {q}), 6) as q{int(q * 100):02d}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))}, round(quantile_cont(dd, 0.5), 6) as median_drawdown from pd group by 1, 2")
def _(spark, sf):
    p = m.with_path(paths(spark, sf, "iid"), ("series", "sim"), "t")
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    out = p.groupBy("series", "t").agg(F.percentile("equity", F.array(*map(F.lit, qs))).alias("q"), r(F.percentile("drawdown", F.lit(0.5))).alias("median_drawdown"))
    return out.select("series", "t", "median_drawdown", *[r(F.col("q")[i]).alias(f"q{int(q * 100):02d}") for i, q in enumerate(qs)])


@query("viz03_histogram", sql.bars("y", samples("iid") + ", " + _stats_sql() + ", b as (select series, min(sharpe) as lo, max(sharpe) as hi from st group by 1)") + "select series, cast(least(floor((sharpe - lo) / (hi - lo) * 50), 49) as bigint) as bin, count(*) as n from st join b using (series) group by 1, 2")
def _(spark, sf):
    st = path_stats(paths(spark, sf, "iid"))
    ends = st.groupBy("series").agg(F.min("sharpe").alias("lo"), F.max("sharpe").alias("hi"))
    b = F.least(F.floor((F.col("sharpe") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 50), F.lit(49))
    return st.join(ends, "series").groupBy("series", b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("dst01_wasserstein", sql.bars("y", samples("iid") + ", a as (select series, ret as x, row_number() over (partition by series order by ret, t) as k from s), b as (select series, sim, ret as y, row_number() over (partition by series, sim order by ret, t) as k from p)") + "select b.series, sim, round(avg(abs(x - y)), 6) as distance from b join a on a.series = b.series and a.k = b.k group by 1, 2")
def _(spark, sf):
    return rd(rs.wasserstein(series(spark, sf), paths(spark, sf, "iid")), ["series", "sim"])


_MMD = """d as (select u.series, median(pow(u.ret - v.ret, 2)) / (2 * ln(max(n))) as s2 from s u join s v on u.series = v.series and u.t < v.t join z on z.series = u.series group by 1),
    xx as (select u.series, sum(exp(-pow(u.ret - v.ret, 2) / (2 * s2))) as v from s u join s v on u.series = v.series join d on d.series = u.series group by 1),
    yy as (select u.series, u.sim, sum(exp(-pow(u.ret - v.ret, 2) / (2 * s2))) as v from p u join p v on u.series = v.series and u.sim = v.sim join d on d.series = u.series group by 1, 2),
    xy as (select u.series, v.sim, sum(exp(-pow(u.ret - v.ret, 2) / (2 * s2))) as v from s u join p v on u.series = v.series join d on d.series = u.series group by 1, 2)"""


@query("dst02_mmd", sql.bars("y", samples("iid", KERNEL) + ", " + _MMD) + "select yy.series, yy.sim, round(sqrt(greatest(0, (xx.v - n) / (n * (n - 1)) + (yy.v - n) / (n * (n - 1)) - 2 * xy.v / (n * n))), 6) as mmd from yy join xx using (series) join xy using (series, sim) join z using (series)")
def _(spark, sf):
    return rd(rs.mmd(series(spark, sf), paths(spark, sf, "iid", KERNEL)), ["series", "sim"])


_FLIPS = f"""sg as (select series, count(*) filter (where ret > 0) as positive, count(*) as m from s where ret <> 0 group by 1), fl as (select series, sim, positive, m, sum({rs.flips_sql('sim', 'w', '(m - w * 64)', 11)}) as heads
    from sg, (select unnest(range({FLIPS})) as sim), (select unnest(range(32)) as w) where w * 64 < m group by 1, 2, 3, 4)"""


@query("prm01_sign_permutation", sql.bars("y", SERIES + ", " + _FLIPS) + "select series, positive, m, round((count(*) filter (where heads >= positive) + 1) / (count(*) + 1), 6) as p_greater, round((count(*) filter (where heads <= positive) + 1) / (count(*) + 1), 6) as p_less, round((count(*) filter (where abs(heads - m / 2) >= abs(positive - m / 2)) + 1) / (count(*) + 1), 6) as p_two_sided from fl group by 1, 2, 3")
def _(spark, sf):
    return rd(rs.sign_permutation(series(spark, sf), FLIPS, 11), ["series", "positive", "m"])


for _block in (1, 20):
    _PERM = f"""pm as (select s.series, sim, row_number() over (partition by s.series, sim order by {rng.draw_sql('sim', f't // {_block}', 13)}, t // {_block}, t) - 1 as t, ret from s, (select unnest(range({N})) as sim)), p as (select * from pm)"""

    def _perm(block):
        def run(spark, sf):
            st = path_stats(rs.permute(series(spark, sf), N, block, 13))
            own = path_stats(series(spark, sf).withColumn("sim", F.lit(0).cast("long"))).select("series", F.col("max_drawdown").alias("observed"))
            return st.join(own, "series").groupBy("series").agg(r(F.first("observed")).alias("observed"), r((F.count_if(F.col("max_drawdown") <= F.col("observed") + 1e-12) + 1) / (F.count("*") + 1)).alias("p_value"))

        return run

    _OBS = "o0 as (select *, product(1 + ret) over (partition by series order by t rows unbounded preceding) as eq from s), o1 as (select series, eq / max(eq) over (partition by series order by t rows unbounded preceding) - 1 as dd from o0), o as (select series, min(dd) as observed from o1 group by 1)"
    query(f"prm02_metric_permutation_block{_block}", sql.bars("y", SERIES + ", " + _PERM + ", " + _stats_sql() + ", " + _OBS) + "select series, round(max(observed), 6) as observed, round((count(*) filter (where max_drawdown <= observed + 1e-12) + 1) / (count(*) + 1), 6) as p_value from st join o using (series) group by 1")(_perm(_block))


@query("prm03_mean_difference_permutation", sql.bars("y", SERIES + f""", q as (select series, ret, t * 2 + (series = 'N')::int as k from s where series in ('A', 'N')), ob as (select count(*) filter (where series = 'A') as n, avg(ret) filter (where series = 'A') - avg(ret) filter (where series = 'N') as observed from q),
    dr as (select sim, ret, row_number() over (partition by sim order by {rng.draw_sql('sim', 'k', 17)}, k) as rk from q, (select unnest(range({N})) as sim)), df as (select sim, observed, avg(ret) filter (where rk <= n) - avg(ret) filter (where rk > n) as d from dr, ob group by 1, 2)""")
    + "select round(observed, 8) as observed, round(avg((abs(d) >= abs(observed))::double), 6) as p_value, count(*) as n_sims from df group by observed")
def _(spark, sf):
    out = rs.mean_difference_permutation(series(spark, sf), "A", "N", N, 17)
    return out.select(r(F.col("observed"), 8).alias("observed"), r(F.col("p_value")).alias("p_value"), "n_sims")


_OWN = "ow0 as (select *, product(1 + ret) over (partition by series order by t rows unbounded preceding) as eq from s), ow1 as (select *, eq / max(eq) over (partition by series order by t rows unbounded preceding) - 1 as dd from ow0), ow as (select series, product(1 + ret) - 1 as total_return, stddev_samp(ret) * sqrt(52) as volatility, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52) as sharpe, min(dd) as max_drawdown from ow1 group by 1)"


def _p_sql(c: str) -> str:
    return f"""select st.series, '{c}' as metric, round(max(ow.{c}), 6) as benchmark_value, round(avg(st.{c}), 6) as sim_mean, round(stddev_pop(st.{c}), 6) as sim_std, count(*) filter (where st.{c} <= ow.{c} + 1e-12) as rank, round((count(*) filter (where st.{c} <= ow.{c} + 1e-12) + 1) / (count(*) + 1), 6) as p_left,
    round((count(*) filter (where st.{c} >= ow.{c} - 1e-12) + 1) / (count(*) + 1), 6) as p_right, round((max(ow.{c}) - avg(st.{c})) / stddev_pop(st.{c}), 6) as effect_size from st join ow using (series) group by 1"""


@query("tst01_empirical_p_values", sql.bars("y", samples("stationary") + ", " + _stats_sql() + ", " + _OWN) + " union all ".join(map(_p_sql, _METRICS)))
def _(spark, sf):
    own = path_stats(series(spark, sf).withColumn("sim", F.lit(0).cast("long")))
    out = ts.empirical_p(path_stats(paths(spark, sf, "stationary")), own, _METRICS)
    return rd(out.drop("p_two_sided", "p_mid"), ["series", "metric", "rank"])


@query("tst02_benchmark_stats", sql.bars("y", SERIES) + "select series, round(avg(ret) * 252, 6) as annual_mean, round(stddev_pop(ret) * sqrt(252), 6) as volatility, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 6) as sharpe from s group by 1")
def _(spark, sf):
    c = F.col("ret")
    return series(spark, sf).groupBy("series").agg(r(F.avg(c) * 252).alias("annual_mean"), r(F.stddev_pop(c) * 252**0.5).alias("volatility"), r(m.sharpe(c, 252, 0.0, True)).alias("sharpe"))


_PV = [("metric1", 0.01), ("metric2", 0.03), ("metric3", 0.05), ("metric4", 0.10), ("metric5", 0.20)]


@query("tst03_multiple_comparisons", f"""with p as (select * from (values {', '.join(map(str, _PV))}) v(metric, p_value)), k as (select *, row_number() over (order by p_value, metric) as k, count(*) over () as m from p), f as (select *, min(p_value * m / k) over (order by k desc rows unbounded preceding) as q, sum(1.0::double / k) over () as h from k)
    select metric, p_value::double as p_value, round(least(p_value::double * m, 1), 6) as bonferroni, round(least(q::double, 1), 6) as bh, round(least(q::double * h, 1), 6) as by from f""")
def _(spark, sf):
    p = spark.createDataFrame(_PV, "metric string, p_value double")
    return rd(ts.adjust(p, order=["metric"]), ["metric", "p_value"])


@query("tst04_05_07_09_10_15_kernel_tests")
def _(spark, sf):
    return rd(ts.kernel_tests(series(spark, sf)), ["series", "test"])


@query("tst06_jarque_bera", sql.bars("y", SERIES) + f"select series, round(count(*) / 6.0 * (pow({sql.skew_pop('ret')}, 2) + pow(kurtosis_pop(ret), 2) / 4), 6) as statistic, round(exp(-count(*) / 6.0 * (pow({sql.skew_pop('ret')}, 2) + pow(kurtosis_pop(ret), 2) / 4) / 2), 6) as p_value from s group by 1")
def _(spark, sf):
    return rd(ts.jarque_bera(series(spark, sf)), ["series"])


_ACF = ", ".join(f"sum(x * l{k}) as c{k}" for k in range(1, 11))


@query("tst08_viz04_autocorrelation", sql.bars("y", SERIES + ", x as (select s.series, t, ret - mu as x from s join z using (series)), l as (select series, x, " + ", ".join(f"lag(x, {k}) over (partition by series order by t) as l{k}" for k in range(1, 11)) + f" from x), c as (select series, count(*) as n, sum(x * x) as v, {_ACF} from l group by 1), a as (" + " union all ".join(f"select series, n, {k} as lag, c{k} / v as acf from c" for k in range(1, 11)) + ")")
    + "select series, cast(lag as int) as lag, round(acf, 6) as acf, round(n * (n + 2) * sum(acf * acf / (n - lag)) over (partition by series order by lag), 6) as ljung_box from a")
def _(spark, sf):
    return rd(ts.autocorrelation(series(spark, sf)).drop("p_value"), ["series", "lag"])


_WRC = "f0 as (select series as strategy, avg(ret) as f from s group by 1), fs as (select series as strategy, sim, avg(ret) as f from p group by 1, 2)"


@query("tst11_reality_check", sql.bars("y", samples("stationary") + ", " + _WRC + ", v as (select sim, max(fs.f - f0.f) as v from fs join f0 using (strategy) group by 1), b as (select max(f) as statistic, arg_max(strategy, f) as best from f0)") + "select best, round(statistic, 8) as statistic, round(avg((v >= statistic)::double), 6) as p_value, count(*) as n_sims from v, b group by best, statistic")
def _(spark, sf):
    f0 = series(spark, sf).groupBy(F.col("series").alias("strategy")).agg(F.avg("ret").alias("f"))
    fs = paths(spark, sf, "stationary").groupBy(F.col("series").alias("strategy"), "sim").agg(F.avg("ret").alias("f"))
    out = ts.reality_check(f0, fs)
    return out.select("best", r(F.col("statistic"), 8).alias("statistic"), r(F.col("p_value")).alias("p_value"), "n_sims")


def _step_sql(k: int) -> str:
    """One step: the cut that the best of those left reaches by chance, and what exceeds it. A step without a rejection repeats itself, so three do for three series."""
    left = "f0" if k == 1 else f"l{k}"
    return f"v{k} as (select sim, max(fs.f - x.f) as v from fs join {left} x using (strategy) group by 1), c{k} as (select quantile_cont(v, 0.95) as c from v{k}), l{k + 1} as (select * from {left} where not coalesce(f > (select c from c{k}), false))"


@query("tst12_step_m", sql.bars("y", samples("stationary") + ", " + _WRC + ", " + ", ".join(map(_step_sql, (1, 2, 3)))) + "select strategy, round(f, 8) as f, strategy not in (select strategy from l4) as rejected from f0")
def _(spark, sf):
    f0 = series(spark, sf).groupBy(F.col("series").alias("strategy")).agg(F.avg("ret").alias("f"))
    fs = paths(spark, sf, "stationary").groupBy(F.col("series").alias("strategy"), "sim").agg(F.avg("ret").alias("f"))
    found = ts.step_m(f0, fs)
    return f0.select("strategy", r(F.col("f"), 8).alias("f"), F.col("strategy").isin(found).alias("rejected") if found else F.lit(False).alias("rejected"))


_HALVES = "h as (select series, ret, case when t < n * 0.7 then 'in' else 'out' end as part from s join z using (series))"


@query("tst14_two_sample_ks", sql.bars("y", SERIES + ", " + _HALVES + ", c as (select series, ret, count(*) filter (where part = 'in') as a, count(*) filter (where part = 'out') as b from h group by 1, 2), d as (select series, abs(sum(a) over w / sum(a) over (partition by series) - sum(b) over w / sum(b) over (partition by series)) as d from c window w as (partition by series order by ret))") + "select series, round(max(d), 6) as statistic from d group by 1")
def _(spark, sf):
    s = series(spark, sf)
    n = s.groupBy("series").agg(F.count("*").alias("n"))
    h = s.join(n, "series").withColumn("part", F.when(F.col("t") < F.col("n") * 0.7, "in").otherwise("out"))
    return rd(ts.ks_two_sample(h, "part", "in", "out", keys=["series"]), ["series"])


@query("tst14_mann_whitney")
def _(spark, sf):
    s = series(spark, sf)
    n = s.groupBy("series").agg(F.count("*").alias("n"))
    h = s.join(n, "series").withColumn("part", F.when(F.col("t") < F.col("n") * 0.7, "in").otherwise("out"))
    return rd(ts.mann_whitney_two_sample(h, "part", "in", "out", keys=["series"]), ["series"])


@query("tst16_edge_score_10", sql.bars("y", samples("block") + ", " + _stats_sql() + ", " + _OWN + ", ps as (select series, avg((total_return > 0)::double) as pp, avg((sharpe <= 0)::double) as pv from st group by 1), wr as (select series, avg((ret > 0)::double) as wr from s group by 1), e as (select series, (pv < 0.05)::int * 3 + (sharpe > 1)::int * 2 + (wr > 0.55)::int * 2 + (pp > 0.7)::int * 2 + (max_drawdown > -0.2)::int as sc from ow join ps using (series) join wr using (series))")
    + "select series, sc as edge_score, case when sc >= 8 then 'strong' when sc >= 6 then 'moderate' when sc >= 4 then 'weak' else 'none' end as band from e")
def _(spark, sf):
    own = path_stats(series(spark, sf).withColumn("sim", F.lit(0).cast("long")))
    sims = path_stats(paths(spark, sf, "block")).groupBy("series").agg(F.avg((F.col("total_return") > 0).cast("double")).alias("p_positive"), F.avg((F.col("sharpe") <= 0).cast("double")).alias("p_value"))
    won = series(spark, sf).groupBy("series").agg(m.win_rate(F.col("ret")).alias("win_rate"))
    return ts.edge_score(own.join(sims, "series").join(won, "series")).select("series", "edge_score", "band")


@query("tst18_19_out_of_sample", sql.bars("y", SERIES + ", " + _HALVES + ", k as (select series, avg(ret) filter (where part = 'in') / stddev_samp(ret) filter (where part = 'in') * sqrt(52) as a, avg(ret) filter (where part = 'out') / stddev_samp(ret) filter (where part = 'out') * sqrt(52) as b from h group by 1)") + "select series, round(a, 6) as in_sample, round(b, 6) as out_of_sample, round((a - b) / abs(a), 6) as degradation from k")
def _(spark, sf):
    s = series(spark, sf)
    n = s.groupBy("series").agg(F.count("*").alias("n"))
    h = s.join(n, "series")
    part = lambda c: F.when(c, F.col("ret"))
    inside = F.col("t") < F.col("n") * 0.7
    k = h.groupBy("series").agg((F.avg(part(inside)) / F.stddev_samp(part(inside)) * 52**0.5).alias("a"), (F.avg(part(~inside)) / F.stddev_samp(part(~inside)) * 52**0.5).alias("b"))
    return k.select("series", r(F.col("a")).alias("in_sample"), r(F.col("b")).alias("out_of_sample"), r((F.col("a") - F.col("b")) / F.abs("a")).alias("degradation"))
