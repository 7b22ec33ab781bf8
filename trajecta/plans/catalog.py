"""Registered queries: each operator on the driver's tables, with the same result as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions import renal, sequences, times
from trajecta.operators import alignment, blocks, cleaning, clustering, cohort, evaluation, extracts, joins, modelling, outcomes, scores, series, tables, trajectories
from trajecta.plans.stages import measurements, peak_stages, stages_of, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def r6(c: str | Column) -> Column:
    """Six places as SQL rounds a double: of its product with a million, which a decimal that prints as the double may miss by one at a half."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.round(c * F.lit(1e6), 0) / F.lit(1e6)
    return F.when(F.abs(whole) < float("inf"), whole).otherwise(c) + F.lit(0.0)  # no negative zero


EV = "ev as (select user_id id, ts, value, event_id tie, cast(event_type = 'error' as int) mask from events)"
ROLLED = f"""{EV}, l as (select *, lead(ts) over w lt, lead(value) over w lv, lead(mask) over w lm, count(*) over (partition by id) n from ev window w as (partition by id order by ts, tie)),
 rolled as (select id, tie, case when n > 2 and near then ts + to_microseconds(gap // 2) else ts end ts, case when n > 2 and near then (value + lv) / 2 else value end as value,
  case when n > 2 and near then greatest(mask, lm) else mask end mask from (select *, epoch_us(lt) - epoch_us(ts) gap, coalesce(epoch_us(lt) - epoch_us(ts) <= 86400000000, false) near from l))"""


def grid_sql(source: str) -> str:
    return f"""a as (select *, date_trunc('day', m) + to_hours(hour(m) // 6 * 6) anchor from (select *, min(ts) over (partition by id) m from {source})),
 b as (select id, anchor, bin, max(value) top, avg(value) mean, max(mask) oncnt from (select *, cast(floor((epoch_us(ts) - epoch_us(anchor)) / 21600000000) as int) bin from a) group by all),
 c as (select *, lead(bin) over w nx, lead(top) over w nt, count(*) over (partition by id) nb from b window w as (partition by id order by bin)),
 d as (select *, unnest(range(bin, coalesce(nx, bin + 1))) as at_ from c),
 g as (select id, anchor, cast(at_ as int) bin, case when nb = 1 then mean when at_ = bin then top else top + (nt - top) * (at_ - bin) / (nx - bin) end as value, at_ = bin is_real, case when at_ = bin then oncnt else 0 end o from d),
 grid as (select id, anchor, bin, value, is_real, max(o) over (partition by id order by bin rows between 7 preceding and current row) > 0 on_mask from g)"""


STAGES = f"""with {ROLLED}, {grid_sql("rolled")},
 bs as (select distinct id, first_value(value) over (partition by id order by ts, tie) base, min(ts) over (partition by id) + interval 1 day admit from ev),
 j as (select grid.*, base, admit, cast(floor((epoch_us(admit) - epoch_us(anchor)) / 21600000000) as int) ab, hour(admit) // 6 ah from grid join bs using (id)),
 k as (select *, cast(case when bin >= ab + ah then (bin - ab - ah) // 4 + 1 when anchor < admit and bin < ab and not (bin = 0 and (ab - 1) % 4 = 0) then -((ab - 1 - bin) // 4 + 1) else 0 end as int) as day from j),
 p as (select x.id, x.bin, min(y.value) least_ from k x join k y on x.id = y.id and y.bin < x.bin and y.bin >= x.bin - 16 and y.is_real and y.day >= x.day - 2 group by 1, 2),
 stages as (select k.id, k.bin, k.value, k.is_real, k.on_mask, k.base, k.day, cast(case when on_mask then 4 when value <= 1.5 * base then case when k.bin > 7 and value >= least_ + 0.3 then 1 else 0 end when value < 2 * base then 1 when value < 3 * base then 2 else 3 end as int) stage
  from k left join p on k.id = p.id and k.bin = p.bin)
"""


def stages(spark: SparkSession, d: str) -> DataFrame:
    return stages_of(measurements(spark, d))


@query("q_peak_stage", STAGES + "select id, max(stage) peak, count(*) bins, " + ", ".join(f"count(*) filter (stage = {k}) bins_{k}" for k in range(5)) + " from stages group by id")
def q_peak_stage(spark, d):
    return peak_stages(spark, d)


@query("q_stage", STAGES + "select id, bin, day, is_real, on_mask, stage, round(value, 6) as value from stages")
def q_stage(spark, d):
    return stages(spark, d).select("id", "bin", "day", "is_real", "on_mask", "stage", r6("value").alias("value"))


@query("q_roll2", f"with {ROLLED} select id, tie, ts, round(value, 6) as value, mask from rolled")
def q_roll2(spark, d):
    return series.forward_mean(measurements(spark, d), mask="mask", tie="tie").select("id", "tie", "ts", r6("value").alias("value"), "mask")


@query("q_roll3", f"""with {EV}, l as (select *, [lead(value, 1) over w, lead(value, 2) over w] vs, lead(ts, 1) over w t1, lead(ts, 2) over w t2, count(*) over (partition by id) n from ev window w as (partition by id order by ts, tie)),
 o as (select *, coalesce(epoch_us(t1) - epoch_us(ts) <= 86400000000, false) a1, coalesce(epoch_us(t2) - epoch_us(ts) <= 86400000000, false) a2 from l)
 select id, tie, round(case when n <= 3 then value when a1 and a2 then (value + vs[1] + vs[2]) / 3 when a1 then (value + vs[1]) / 2 else value end, 6) as value from o""")
def q_roll3(spark, d):
    return series.forward_mean(measurements(spark, d), tie="tie", window=3).select("id", "tie", r6("value").alias("value"))


@query("q_bin_max", f"with {EV}, {grid_sql('ev')} select id, bin, round(top, 6) top from b")
def q_bin_max(spark, d):
    return series.to_grid(measurements(spark, d), mask="mask").where("is_real").join(_single_bins(measurements(spark, d)), "id", "left").select("id", "bin", r6(F.coalesce("top", "value")).alias("top"))


def _single_bins(ms: DataFrame) -> DataFrame:
    """Series that lie within one bin: their largest value."""
    anchor = times.floor_to_bin(F.col("ts"), 6)
    return ms.groupBy("id").agg(F.count_distinct(anchor).alias("n"), F.max("value").alias("top")).where("n = 1").select("id", "top")


@query("q_grid_interp", f"with {EV}, {grid_sql('ev')} select id, bin, round(value, 6) as value, is_real from grid")
def q_grid_interp(spark, d):
    return series.to_grid(measurements(spark, d), mask="mask").select("id", "bin", r6("value").alias("value"), "is_real")


@query("q_ffill48", f"with {EV}, {grid_sql('ev')} select id, count(*) bins, count(*) filter (on_mask) masked_bins from grid group by id")
def q_ffill48(spark, d):
    return series.to_grid(measurements(spark, d), mask="mask").groupBy("id").agg(F.count("*").alias("bins"), F.count(F.when(F.col("on_mask"), 1)).alias("masked_bins"))


@query("q_relative", STAGES + "select id, bin, round(value / base, 6) + 0.0 relative, round(value - base, 6) + 0.0 as change from stages")
def q_relative(spark, d):
    return series.relative_change(stages(spark, d)).select("id", "bin", r6("relative").alias("relative"), r6("change").alias("change"))


@query("q_episodes", STAGES + ", e as (select id, bin - lag(bin) over (partition by id order by bin) gap from stages where stage > 0), f as (select id, count(*) filter (gap >= 8) + 1 n from e group by id) select distinct s.id, coalesce(n, 0) n_episodes from stages s left join f using (id)")
def q_episodes(spark, d):
    return series.episodes(stages(spark, d))


TURNS = """, mv as (select id, bin, nullif(sign(stage - lag(stage) over (partition by id order by bin)), 0) s from stages),
 tn as (select *, last_value(s ignore nulls) over (partition by id order by bin rows between unbounded preceding and 1 preceding) p, last_value(s ignore nulls) over (partition by id order by bin rows between unbounded preceding and unbounded following) e from mv),
 turns as (select id, count(*) filter (s = 1 and coalesce(p, 0) < 1) - max(case when e = 1 then 1 else 0 end) n_peaks, count(*) filter (s = -1 and p = 1) up_down, count(*) filter (s = 1 and p = -1) down_up from tn group by id)
"""


@query("q_peaks", STAGES + TURNS + "select id, n_peaks, up_down, down_up from turns")
def q_peaks(spark, d):
    return series.directions(stages(spark, d))


@query("q_traj17", STAGES + TURNS + """, dd as (select *, stage - lag(stage) over (partition by id order by bin) df, bin - lag(bin) over (partition by id, stage > 0 order by bin) gap from stages)
 select id, max(stage)::bigint peak, arg_min(stage, bin)::bigint "first", arg_max(stage, bin)::bigint "last", min(stage)::bigint least, coalesce(max(stage) filter (day <= 3), 0)::bigint peak_to_day3, coalesce(max(stage) filter (day > 3), 0)::bigint peak_after_day3,
 """ + ", ".join(f"(count(*) filter (stage = {s}) >= 4)::bigint stage{s}_day" for s in (1, 2, 3, 4)) + """, (max(stage) = min(stage))::bigint flat, (count(*) filter (df > 0) > 0 and count(*) filter (df < 0) = 0)::bigint only_up, (count(*) filter (df < 0) > 0 and count(*) filter (df > 0) = 0)::bigint only_down,
 case when count(*) filter (stage > 0) = 0 then 0 else count(*) filter (stage > 0 and gap >= 4) + 1 end n_episodes, any_value(up_down) turns_down, any_value(down_up) turns_up, any_value(n_peaks) n_peaks from dd join turns using (id) group by id""")
def q_traj17(spark, d):
    return trajectories.described(stages(spark, d))


TRANS = ", tr as (select id, lag(stage) over (partition by id order by bin) previous, stage as current_ from stages)"


@query("q_transitions", STAGES + TRANS + "select id, previous, current_ as \"current\", count(*) n from tr where previous is not null group by all")
def q_transitions(spark, d):
    return trajectories.transitions(stages(spark, d))


@query("q_tweights", STAGES + TRANS + ", st as (select least(previous, current_) step, count(*) n from tr where abs(previous - current_) = 1 group by 1), w as (select step, log10(sum(n) over () / n) w from st) select step, round(w / min(w) over (), 6) weight from w")
def q_tweights(spark, d):
    return trajectories.transition_weights(trajectories.transitions(stages(spark, d))).select("step", r6("weight").alias("weight"))


@query("q_templates", STAGES + ", t as (select id, concat_ws('-', stage, lead(stage, 1) over w, lead(stage, 2) over w) template, lead(stage, 2) over w e from stages window w as (partition by id order by bin)) select id, template, count(*) n from t where e is not null group by all")
def q_templates(spark, d):
    return trajectories.templates(stages(spark, d))


@query("q_slopes", STAGES + ", t as (select id, lead(stage) over (partition by id order by bin) - stage slope from stages) select id, " + ", ".join(f"count(*) filter (slope = {k}) slope_{k}".replace("slope_-", "slope_m") for k in range(-4, 5)) + " from t where slope is not null group by id")
def q_slopes(spark, d):
    wide = trajectories.pivoted(trajectories.slopes(stages(spark, d)), "id", "slope", list(range(-4, 5)), "slope_")
    return wide.select("id", *(F.col(f"`slope_{k}`").alias(f"slope_{k}".replace("_-", "_m")) for k in range(-4, 5)))


# joins


@query("q_first_match_left", "select c.c_custkey, o.o_orderkey, o.o_orderdate from customer c left join (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from orders) o on c.c_custkey = o.o_custkey and rn = 1")
def q_first_match_left(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return joins.first_match_left(c, o, "c_custkey", "o_orderdate", "o_orderkey")


@query("q_fold_all", "select c_custkey, max(case when o_orderstatus = 'F' then 1 else 0 end) any_final, count(o_orderkey) n_orders, round(sum(o_totalprice), 2) spent from customer join orders on c_custkey = o_custkey group by 1 union all select c_custkey, null, null, null from customer where c_custkey not in (select o_custkey from orders)")
def q_fold_all(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.fold_all(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("any_final"), F.count("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("q_stab_join", f"with {EV} select a.id, a.tie, count(*) n_spans from ev a join ev b on a.id = b.id and b.mask = 1 and a.ts between b.ts and b.ts + interval 48 hours group by 1, 2")
def q_stab_join(spark, d):
    ms = measurements(spark, d)
    spans = ms.where("mask = 1").select("id", F.col("ts").alias("start"), F.col("ts").alias("stop"))
    return joins.stab(ms.select("id", "tie", "ts"), spans, "id", "ts", "start", "stop").groupBy("id", "tie").agg(F.count("*").alias("n_spans"))


@query("q_overlap_clip", """with o as (select o_custkey k, o_orderkey, o_orderdate a, o_orderdate + interval 60 day b from orders), l as (select l_orderkey, min(l_shipdate) s, max(l_shipdate) + interval 5 day e from lineitem group by 1)
 select o_orderkey, round(epoch_us(least(b, e)) / 86400e6 - epoch_us(greatest(a, s)) / 86400e6, 6) n_days from o join l on o_orderkey = l_orderkey where least(b, e) > greatest(a, s)""")
def q_overlap_clip(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("a"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 60 days")).alias("b"))
    ships = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").cast("timestamp").alias("s"), (F.max("l_shipdate").cast("timestamp") + F.expr("interval 5 days")).alias("e"))
    met = joins.overlap(o, ships, "o_orderkey", ("a", "b"), ("s", "e"))
    return met.select("o_orderkey", r6(times.difference(F.col("w_start"), F.col("w_stop"), "d")).alias("n_days"))


@query("q_asof", f"""with {EV}, p as (select a.id, a.tie, b.value v, b.tie bt, row_number() over (partition by a.id, a.tie order by b.ts desc, b.tie desc) rn, epoch_us(a.ts) - epoch_us(b.ts) age from ev a join ev b on a.id = b.id and epoch_us(a.ts) - epoch_us(b.ts) >= 86400000000)
 select ev.id, ev.tie, p.bt, round(p.v, 6) base from ev left join p on ev.id = p.id and ev.tie = p.tie and rn = 1 and age < 7 * 86400000000""")
def q_asof(spark, d):
    ms = measurements(spark, d)
    right = ms.select("id", F.col("ts").alias("seen"), F.col("value").alias("base"), F.col("tie").alias("bt"))
    return joins.as_of(ms.select("id", "tie", "ts"), right, "id", "ts", "seen", 1.0, 7.0, tie="bt").select("id", "tie", "bt", r6("base").alias("base"))


@query("q_nearest_k", """with f as (select o_custkey k, min(o_orderdate) + interval 90 day t from orders group by 1), n as (select k, o_orderkey, abs(epoch_us(o_orderdate::timestamp) - epoch_us(t)) / 86400e6 apart, row_number() over (partition by k order by abs(epoch_us(o_orderdate::timestamp) - epoch_us(t)), o_orderkey) rk from f join orders on o_custkey = k)
 select k c_custkey, o_orderkey, round(apart, 6) apart_days, cast(rk as int) as rank from n where rk <= 2""")
def q_nearest_k(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("seen"))
    first = o.groupBy("c_custkey").agg((F.min("seen") + F.expr("interval 90 days")).alias("t"))
    return joins.nearest(first, o, "c_custkey", F.col("t"), "seen", 2, "o_orderkey").select("c_custkey", "o_orderkey", r6("apart_days").alias("apart_days"), "rank")


@query("q_pairs_theta", "select a.vec_id, b.vec_id vec_id2, a.label = b.label same from embeddings a join embeddings b on a.vec_id < b.vec_id")
def q_pairs_theta(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return joins.all_pairs(e, "vec_id").select("vec_id", "vec_id2", (F.col("label") == F.col("label2")).alias("same"))


@query("q_full_outer_tag", """with a as (select c_custkey k, c_acctbal v from customer where c_acctbal > 0), b as (select o_custkey k, max(o_totalprice) v from orders group by 1)
 select coalesce(a.k, b.k) k, round(case when a.k is not null then a.v else b.v end, 2) v, case when a.k is not null and b.k is not null then 'both' when a.k is not null then 'account' else 'order' end source from a full join b on a.k = b.k""")
def q_full_outer_tag(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return joins.tagged_full_outer(a, b, "k", "v", ("account", "order")).withColumn("v", F.round("v", 2))


@query("q_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def q_semi(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("q_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def q_anti(spark, d):
    return joins.misses(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("q_lookup", "select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_name like '%A%'")
def q_lookup(spark, d):
    n = table(spark, d, "nation").where(F.contains("n_name", F.lit("A"))).select("n_nationkey", "n_name")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")


@query("q_setops", "with c as (select distinct user_id from events where event_type = 'click'), p as (select distinct user_id from events where event_type = 'purchase' and value > 400) select 'union' op, count(*) n from (select * from c union select * from p) union all select 'intersect', count(*) from (select * from c intersect select * from p) union all select 'except', count(*) from (select * from c except select * from p)")
def q_setops(spark, d):
    e = table(spark, d, "events")
    c, p = e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'purchase' and value > 400").select("user_id")
    ops = {"union": c.union(p).distinct(), "intersect": c.intersect(p), "except": c.subtract(p)}
    out = None
    for name, df in ops.items():
        one = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


# dates and formulas


@query("q_date_units", """select o_orderkey, round(epoch_us(x) / 3600e6 - epoch_us(o_orderdate::timestamp) / 3600e6, 6) n_hours, round((epoch_us(x) - epoch_us(o_orderdate::timestamp)) / (365 * 86400e6), 6) n_years, date_diff('day', o_orderdate, x::date)::int ordinal, floor((epoch_us(x) - epoch_us(o_orderdate::timestamp)) / 86400e6)::bigint whole
 from orders join (select l_orderkey, min(l_shipdate)::timestamp + interval 7 hour x from lineitem group by 1) on o_orderkey = l_orderkey""")
def q_date_units(spark, d):
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.min("l_shipdate").cast("timestamp") + F.expr("interval 7 hours")).alias("x"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t")).join(first, "o_orderkey")
    t, x = F.col("t"), F.col("x")
    return o.select("o_orderkey", r6(times.difference(t, x, "h")).alias("n_hours"), r6(times.difference(t, x, "y")).alias("n_years"), times.calendar_days(t, x).alias("ordinal"), times.whole_days(t, x).alias("whole"))


@query("q_parse_dates", "select event_id, date_trunc('second', ts) a, date_trunc('minute', ts) b, ts::date::timestamp c, null::timestamp e from events")
def q_parse_dates(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("a"), F.date_format("ts", "MM/dd/yy HH:mm").alias("b"), F.date_format("ts", "M/d/yyyy").alias("c"), F.lit("n/a").alias("e"))
    return e.select("event_id", *(times.parse_timestamp(F.col(c)).cast("timestamp_ntz").alias(c) for c in "abce"))


@query("q_gfr", """with p as (select p_partkey, 0.5 + p_retailprice / 1000 scr, (p_partkey % 2)::double m, (p_partkey % 3 = 0)::int b, (20 + p_size)::double age from part),
 f as (select *, 175 * pow(age, -0.203) * (case when m = 1 then 1 else 0.742 end) * (case when b = 1 then 1.212 else 1 end) k from p)
 select p_partkey, round(k * pow(scr, -1.154), 6) gfr, round(pow(75 / k, 1 / -1.154), 6) back from f""")
def q_gfr(spark, d):
    p = table(spark, d, "part").select("p_partkey", (0.5 + F.col("p_retailprice") / 1000).alias("scr"), (F.col("p_partkey") % 2).alias("m"), (F.col("p_partkey") % 3 == 0).cast("int").alias("b"), (20 + F.col("p_size")).cast("double").alias("age"))
    who = (F.col("m"), F.col("b"), F.col("age"))
    return p.select("p_partkey", r6(renal.gfr_mdrd(F.col("scr"), *who)).alias("gfr"), r6(renal.creatinine_at_gfr_mdrd(F.lit(75.0), *who)).alias("back"))


@query("q_gfr_epi", """with p as (select p_partkey, p_partkey % 2 m, (p_partkey % 3 = 0)::int b, (20 + p_size)::double age from part),
 f as (select *, 75 / (141 * pow(0.993, age) * (case when m = 1 then 1 else 1.018 end) * (case when b = 1 then 1.159 else 1 end)) q, case when m = 1 then 0.9 else 0.7 end k, case when m = 1 then -0.411 else -0.329 end a from p)
 select p_partkey, round(k * case when q > 1 then pow(q, 1 / a) else pow(q, 1 / -1.209) end, 6) scr from f""")
def q_gfr_epi(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 2).alias("m"), (F.col("p_partkey") % 3 == 0).cast("int").alias("b"), (20 + F.col("p_size")).cast("double").alias("age"))
    return p.select("p_partkey", r6(renal.creatinine_at_gfr_epi(F.lit(75.0), F.col("m"), F.col("b"), F.col("age"))).alias("scr"))


# cleaning


@query("q_clamp", "select l_orderkey, l_linenumber, case when l_quantity between 5 and 45 then l_quantity end qty, case when l_extendedprice >= 2000 then l_extendedprice end price from lineitem")
def q_clamp(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    return cleaning.clamped(f, {"qty": (5, 45), "price": (2000, None)})


@query("q_trim", """with s as (select avg(p_retailprice) m, stddev_pop(p_retailprice) s from part), a as (select p_partkey, case when p_retailprice >= m - 1.96 * s then p_retailprice end v from part, s), t as (select avg(v) m, stddev_pop(v) s from a)
 select p_partkey, round(case when v <= m + 1.96 * s then v end, 6) v from a, t""")
def q_trim(spark, d):
    f = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    return cleaning.trimmed(f, ["v"], ["v"]).select("p_partkey", r6("v").alias("v"))


@query("q_impute", "with a as (select l_orderkey, l_linenumber, case when l_discount > 0.05 then l_quantity end v, case when l_tax > 0.04 then l_tax end hd_days from lineitem) select l_orderkey, l_linenumber, round(coalesce(v, (select quantile_cont(v, 0.5) from a)), 6) v, coalesce(hd_days, 0) hd_days from a")
def q_impute(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("v"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("hd_days"))
    return cleaning.imputed(f, ["v", "hd_days"]).withColumn("v", r6("v"))


@query("q_impute_by", "with a as (select l_orderkey, l_linenumber, l_returnflag g, case when l_discount > 0.05 then l_quantity end v from lineitem), m as (select g, quantile_cont(v, 0.5) q from a group by 1) select l_orderkey, l_linenumber, g, round(coalesce(v, q), 6) v from a join m using (g)")
def q_impute_by(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("g"), F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("v"))
    return cleaning.imputed_by(f, "g", ["v"]).withColumn("v", r6("v"))


@query("q_minmax", "select c_custkey, round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) v from customer")
def q_minmax(spark, d):
    f = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    return cleaning.scaled(f, ["v"]).withColumn("v", r6("v"))


@query("q_exclusions", "select c_custkey from customer where greatest((c_acctbal < 0)::int, (c_nationkey > 20)::int, (c_mktsegment = 'BUILDING')::int) = 0")
def q_exclusions(spark, d):
    c = table(spark, d, "customer").withColumns({"x1": F.col("c_acctbal") < 0, "x2": F.col("c_nationkey") > 20, "x3": F.col("c_mktsegment") == "BUILDING"})
    return c.where(cleaning.none_set(["x1", "x2", "x3"])).select("c_custkey")


@query("q_first_reason", "select c_custkey, case when c_acctbal < 0 then 'balance' when c_nationkey > 20 then 'nation' when c_mktsegment = 'BUILDING' then 'segment' end reason from customer")
def q_first_reason(spark, d):
    flags = [("balance", F.col("c_acctbal") < 0), ("nation", F.col("c_nationkey") > 20), ("segment", F.col("c_mktsegment") == "BUILDING")]
    return table(spark, d, "customer").select("c_custkey", cleaning.first_reason(flags).alias("reason"))


@query("q_recode", "select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else o_orderstatus end status from orders")
def q_recode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cleaning.recoded(F.col("o_orderstatus"), {"F": "final", "O": "open"}).alias("status"))


# grouped tables

SEG = "s as (select c_mktsegment seg, o_totalprice price, (o_orderstatus = 'F')::int fin from orders join customer on o_custkey = c_custkey)"


def _segments(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("double").alias("price"), (F.col("o_orderstatus") == "F").cast("int").alias("fin"))
    return o.join(c, "c_custkey").drop("c_custkey")


@query("q_rollup_count", f"with {SEG} select case when grouping(seg) = 1 then 'Total' else seg end seg, count(*) n, sum(fin)::bigint n_fin, round(avg(fin), 6) share_fin from s group by rollup (seg)")
def q_rollup_count(spark, d):
    return tables.counts(_segments(spark, d), "seg", ["fin"]).withColumn("share_fin", r6("share_fin"))


@query("q_rowpct", f"with {SEG} select seg, sum(fin)::bigint n, round(sum(fin) / sum(sum(fin)) over (), 6) share from s group by seg")
def q_rowpct(spark, d):
    return tables.row_shares(_segments(spark, d), "seg", "fin").withColumn("share", r6("share"))


@query("q_mean_sd", f"with {SEG} select case when grouping(seg) = 1 then 'Total' else seg end seg, count(price) n, round(avg(price), 4) mean, round(stddev_pop(price), 4) sd from s group by rollup (seg)")
def q_mean_sd(spark, d):
    return tables.mean_sd(_segments(spark, d), "seg", "price").select("seg", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query("q_iqr", f"with {SEG} select case when grouping(seg) = 1 then 'Total' else seg end seg, count(price) n, round(quantile_cont(price, 0.25), 4) q1, round(quantile_cont(price, 0.5), 4) median, round(quantile_cont(price, 0.75), 4) q3 from s group by rollup (seg)")
def q_iqr(spark, d):
    return tables.median_iqr(_segments(spark, d), "seg", "price").select("seg", "n", *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3")))


@query("q_long_table", f"""with {SEG}, t as (select seg, 'fin' as row, 'count' kind, fin::double v from s union all select seg, 'price', 'median', price from s), a as (select coalesce(seg, 'Total') seg, row, kind, count(v) n, sum(v) sm, avg(v) m, quantile_cont(v, 0.5) q2, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 from t group by grouping sets ((seg, row, kind), (row, kind)))
 select seg, row, kind, n, round(case when kind = 'count' then sm else q2 end, 4) a, round(case when kind = 'count' then m else q1 end, 4) b, round(case when kind <> 'count' then q3 end, 4) c from a""")
def q_long_table(spark, d):
    return tables.long_table(_segments(spark, d), "seg", ["fin"], ["price"]).select("seg", "row", "kind", "n", *(F.round(c, 4).alias(c) for c in "abc"))


@query("q_mortality_spread", f"with {SEG}, r as (select seg, avg(fin) r from s group by 1), p as (select abs(x.r - y.r) d from r x join r y on x.seg < y.seg) select round(max(d), 6) max_spread, round(min(d), 6) min_spread, round(avg(d), 6) mean_spread from p")
def q_mortality_spread(spark, d):
    return tables.rate_spread(_segments(spark, d), "seg", "fin").select(*(r6(c).alias(c) for c in ("max_spread", "min_spread", "mean_spread")))


@query("q_disposition", """with t as (select upper(p_type) u from part) select case when u like '%EXP%' then case when u like '%LESS%' then 'expired_early' when u like '%MORE%' then 'expired_late' end when u like '%ALIVE%' then 'alive' when u like '%XFER%' or u like '%TRANS%' then 'transferred' when u like '%AMA%' then 'against_advice' when trim(u) = '' then 'blank' else 'other' end kind, count(*) n from t group by 1""")
def q_disposition(spark, d):
    return table(spark, d, "part").groupBy(tables.disposition(F.col("p_type")).alias("kind")).agg(F.count("*").alias("n"))


@query("q_pivot_eav", "select user_id, " + ", ".join(f"round(max(value) filter (event_type = '{t}' and day(ts) = {k}), 6) {t}_d{k}" for t in ("click", "error", "view") for k in (1, 2, 3)) + " from events group by user_id")
def q_pivot_eav(spark, d):
    e = table(spark, d, "events")
    terms = [f"{t}_d{k}" for t in ("click", "error", "view") for k in (1, 2, 3)]
    return e.withColumn("term", F.concat("event_type", F.lit("_d"), F.dayofmonth("ts"))).groupBy("user_id").pivot("term", terms).agg(r6(F.max("value")))


#: A normal variable's chance to exceed z, by the series of the distribution function.
def _above_sql(z: str) -> str:
    series = f"list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-12)) - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi())))))"
    return f"case when abs({z}) > 8 then ({z} < 0)::int::double else 0.5 - sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series} end"


def _t_quantile_sql(n: str) -> str:
    """The deviate of a t variable that it stays within with a chance of 95 %, for many degrees of freedom, by powers of 1/n."""
    z = "1.959963984540054"
    terms = [(4, ((1, 3), (1, 1))), (96, ((5, 5), (16, 3), (3, 1))), (384, ((3, 7), (19, 5), (17, 3), (-15, 1))), (92160, ((79, 9), (776, 7), (1482, 5), (-1920, 3), (-945, 1)))]
    return f"({z} + " + " + ".join(f"({' + '.join(f'{c} * pow({z}, {k})' for c, k in of)}) / ({d} * pow({n}, {i}))" for i, (d, of) in enumerate(terms, 1)) + ")"


def _t_as_normal_sql(t: str, n: str) -> str:
    """The normal deviate of a t variable's value, for many degrees of freedom."""
    return f"({t} * (1 - (pow({t}, 2) + 1) / (4 * {n}) + (13 * pow({t}, 4) + 8 * pow({t}, 2) + 3) / (96 * pow({n}, 2)) - (35 * pow({t}, 6) + 19 * pow({t}, 4) + pow({t}, 2) - 15) / (384 * pow({n}, 3))))"


@query("q_mean_ci", f"with {SEG}, g as (select seg, count(price) n, avg(price) m, stddev_samp(price) / sqrt(count(price)) e from s group by 1) select seg, n, round(m, 4) mean, round(m - e * {_t_quantile_sql('(n - 1)')}, 3) low, round(m + e * {_t_quantile_sql('(n - 1)')}, 3) high from g")
def q_mean_ci(spark, d):
    return evaluation.mean_interval(_segments(spark, d), "price", "seg").select("seg", "n", F.round("mean", 4).alias("mean"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


# evaluation: a made score of the labelled documents

SCORED = "x as (select l.doc_id, quality y, (n_chars % 97) / 97.0 p1, (n_chars % 89 + 8 * quality) / 97.0 p2 from labels l join documents d on l.doc_id = d.doc_id)"


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    both = table(spark, d, "labels").join(docs, "doc_id")
    return both.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") % 97 / 97.0).alias("p1"), ((F.col("n_chars") % 89 + 8 * F.col("quality")) / 97.0).alias("p2"))


@query("q_confusion", f"with {SCORED}, c as (select count(*) filter (y = 1 and p1 > 0.5) tp, count(*) filter (y = 0 and p1 > 0.5) fp, count(*) filter (y = 0 and p1 <= 0.5) tn, count(*) filter (y = 1 and p1 <= 0.5) fn from x) select tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) accuracy, round(tp / (tp + fn), 6) sensitivity, round(tn / (tn + fp), 6) specificity, round(tp / (tp + fp), 6) ppv, round(tn / (tn + fn), 6) npv, round(2 * tp / (2 * tp + fp + fn), 6) f1 from c")
def q_confusion(spark, d):
    r = evaluation.rates(_scored(spark, d), "y", "p1")
    return r.select("tp", "fp", "tn", "fn", *(r6(c).alias(c) for c in r.columns[4:]))


@query("q_auc", f"with {SCORED} select round(sum(case when a.p1 > b.p1 then 1 when a.p1 = b.p1 then 0.5 else 0 end) / count(*), 6) auc, count(distinct a.doc_id) n_pos, count(distinct b.doc_id) n_neg from x a join x b on a.y = 1 and b.y = 0")
def q_auc(spark, d):
    return evaluation.auc(_scored(spark, d), "y", "p1").withColumn("auc", r6("auc"))


@query("q_delong", f"""with {SCORED}, v as (select a.doc_id, a.y, avg(case when (a.y = 1 and a.p1 > b.p1) or (a.y = 0 and a.p1 < b.p1) then 1 when a.p1 = b.p1 then 0.5 else 0 end) v1, avg(case when (a.y = 1 and a.p2 > b.p2) or (a.y = 0 and a.p2 < b.p2) then 1 when a.p2 = b.p2 then 0.5 else 0 end) v2 from x a join x b on a.y <> b.y group by 1, 2),
 g as (select y, count(*) n, avg(v1) m1, avg(v2) m2, var_samp(v1 - v2) s, var_samp(v1) s1, var_samp(v2) s2 from v group by 1),
 o as (select max(m1) filter (y = 1) a1, max(m2) filter (y = 1) a2, sum(s / n) v, sum(s1 / n) v1, sum(s2 / n) v2 from g), z as (select *, (a1 - a2) / sqrt(v) z, 1.959963984540054 k from o)
 select round(a1, 6) auc1, round(a1 - k * sqrt(v1), 6) low1, round(a1 + k * sqrt(v1), 6) high1, round(a2, 6) auc2, round(a2 - k * sqrt(v2), 6) low2, round(a2 + k * sqrt(v2), 6) high2, round(a1 - a2, 6) + 0.0 difference,
  round(a1 - a2 - k * sqrt(v), 6) + 0.0 low, round(a1 - a2 + k * sqrt(v), 6) + 0.0 high, round(v, 6) variance, round(2 * ({_above_sql("abs(z)")}), 5) p from z""")
def q_delong(spark, d):
    got = evaluation.delong(_scored(spark, d))
    return got.select(*(r6(c).alias(c) for c in got.columns if c not in ("z", "p")), F.round("p", 5).alias("p"))


LEVEL = "((case when {p} >= 0.05 then 1 else 0 end) + (case when {p} >= 0.1 then 1 else 0 end) + (case when {p} >= 0.2 then 1 else 0 end))"


@query("q_nri", f"with {SCORED}, l as (select y, {LEVEL.format(p='p1')} a, {LEVEL.format(p='p2')} b from x), s as (select avg(case when b > a then 1 else 0 end) filter (y = 1) - avg(case when b < a then 1 else 0 end) filter (y = 1) e, avg(case when b < a then 1 else 0 end) filter (y = 0) - avg(case when b > a then 1 else 0 end) filter (y = 0) n from l) select round(e, 6) events, round(n, 6) nonevents, round(e + n, 6) nri from s")
def q_nri(spark, d):
    return evaluation.reclassification(_scored(spark, d)).select(*(r6(c).alias(c) for c in ("events", "nonevents", "nri")))


@query("q_idi", f"with {SCORED}, s as (select avg(case when p2 > p1 then 1 else 0 end) filter (y = 1) - avg(case when p2 < p1 then 1 else 0 end) filter (y = 1) e, avg(case when p2 < p1 then 1 else 0 end) filter (y = 0) - avg(case when p2 > p1 then 1 else 0 end) filter (y = 0) n, avg(p2 - p1) filter (y = 1) - avg(p2 - p1) filter (y = 0) idi from x) select round(e, 6) events, round(n, 6) nonevents, round(e + n, 6) nri, round(idi, 6) idi from s")
def q_idi(spark, d):
    return evaluation.continuous_reclassification(_scored(spark, d)).select(*(r6(c).alias(c) for c in ("events", "nonevents", "nri", "idi")))


@query("q_fold_slope", f"with {SCORED} select round(avg(p2) filter (y = 1) - avg(p2) filter (y = 0), 6) slope, round(avg(p2) filter (y = 0), 6) intercept from x")
def q_fold_slope(spark, d):
    return evaluation.fold_slope(_scored(spark, d), "y", "p2").select(r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("q_roc", f"with {SCORED}, t as (select distinct p1 p from x) select round(p, 6) p, round((select count(*) from x where y = 1 and p1 >= p) / (select count(*) from x where y = 1), 6) tpr, round((select count(*) from x where y = 0 and p1 >= p) / (select count(*) from x where y = 0), 6) fpr from t")
def q_roc(spark, d):
    return evaluation.roc(_scored(spark, d), "y", "p1").select(*(r6(c).alias(c) for c in ("p", "tpr", "fpr")))


@query("q_welch", f"""with {SEG}, m as (select seg l, count(*) n, avg(price) m, var_samp(price) v from s group by 1),
 w as (select a.l label1, b.l label2, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) t, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) df from m a join m b on a.l < b.l), z as (select *, {_t_as_normal_sql("abs(t)", "df")} z from w)
 select label1, label2, round(t, 4) t, round(df, 2) df, round(2 * ({_above_sql("z")}), 5) p from z""")
def q_welch(spark, d):
    return evaluation.welch(_segments(spark, d), "seg", "price").select("label1", "label2", F.round("t", 4).alias("t"), F.round("df", 2).alias("df"), F.round("p", 5).alias("p"))


@query("q_kruskal", f"with {SEG}, r as (select seg, price, (rank() over (order by price) + rank() over (order by price) + count(*) over (partition by price) - 1) / 2 rk from s), n as (select count(*)::double n from s), ti as (select sum(pow(c, 3) - c) t from (select count(*) c from s group by price)), g as (select sum(r * r / c) v, count(*) - 1 df from (select sum(rk) r, count(*) c from r group by seg)), k as (select (12 / (n * (n + 1)) * v - 3 * (n + 1)) / (1 - t / (n * n * n - n)) h, df::double df from g, n, ti) select round(h, 4) h, df, round(exp(-h / 2) * (1 + h / 2), 6) p from k")
def q_kruskal(spark, d):
    return evaluation.kruskal(_segments(spark, d), "seg", "price").select(F.round("h", 4).alias("h"), "df", r6("p").alias("p"))


def _moments_sql(by: str) -> str:
    """k2 and p of D'Agostino's test for rows (by, n, g1, g2) of mo."""
    return f"""d1 as (select *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) b, (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) be from mo), d2 as (select *, sqrt(2 * (b - 1)) - 1 w2, 6 + 8 / be * (2 / be + sqrt(1 + 4 / (be * be))) a from d1),
 d3 as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) zs, 1 + x * sqrt(2 / (a - 4)) un from d2), d4 as (select *, (1 - 2 / (9 * a) - sign(un) * pow((1 - 2 / a) / abs(un), 1 / 3)) / sqrt(2 / (9 * a)) zk from d3),
 dag as (select {by}, n, zs, zk, zs * zs + zk * zk k2, exp(-(zs * zs + zk * zk) / 2) p from d4)"""


_MOMENTS = "mu as (select g, avg(x) m from src group by 1), mo as (select src.g, count(*)::double n, avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) g1, avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3 g2 from src join mu using (g) group by 1)"


@query("q_moment_normality", f"with src as (select c_nationkey g, c_acctbal::double x from customer), {_MOMENTS}, {_moments_sql('g')} select g as nation, n::bigint n, round(zs, 5) z_skewness, round(zk, 5) z_kurtosis, round(p, 6) p from dag where n >= 8 union all select g, n::bigint, null, null, null from dag where n < 8")
def q_moment_normality(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast("double").alias("x"))
    return evaluation.moment_normality(c, "x", "nation").select("nation", "n", F.round("z_skewness", 5).alias("z_skewness"), F.round("z_kurtosis", 5).alias("z_kurtosis"), r6("p").alias("p"))


def _shapiro_sql() -> str:
    """sh (g, n, w, p) of the rows (g, x) of src, for groups of 12 and more."""
    step = lambda z: f"greatest({z} + (({_above_sql(z)}) - h) * sqrt(2 * pi()) * exp({z} * {z} / 2), 1e-12)"
    outer = lambda k: f"m{k} / sqrt(q) + " + " + ".join(f"({c}) * pow(u, {i})" for i, c in enumerate(evaluation.WEIGHTS[k - 1], 1))
    powers = lambda c: " + ".join(f"({v}) * pow(ln(n), {i})" for i, v in enumerate(c))
    return f"""s1 as (select g, x, row_number() over (partition by g order by x) i, count(*) over (partition by g) n from src), s2 as (select *, (i - 0.375) / (n + 0.25) pr, least(pr, 1 - pr) h, sqrt(-2 * ln(h)) t from s1),
 s3 as (select *, greatest(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t), 1e-12) z from s2), s4 as (select * replace ({step("z")} as z) from s3), s5 as (select *, {step("z")} * sign(pr - 0.5) m from s4),
 s6 as (select g, n::double n, sum(m * m) q, sum(m * x) s, max(x) filter (i = 1) x1, max(x) filter (i = 2) x2, max(x) filter (i = n - 1) x3, max(x) filter (i = n) x4, max(m) filter (i = n) m1, max(m) filter (i = n - 1) m2, var_pop(x) * n ss, 1 / sqrt(n) u from s5 group by g, n),
 s7 as (select *, {outer(1)} a1, {outer(2)} a2 from s6), s8 as (select *, pow(a1 * (x4 - x1) + a2 * (x3 - x2) + (s - m1 * (x4 - x1) - m2 * (x3 - x2)) / sqrt((q - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss w from s7),
 s9 as (select *, (ln(1 - w) - ({powers(evaluation.LARGE[0])})) / exp({powers(evaluation.LARGE[1])}) z from s8), sh as (select g, n, w, {_above_sql("z")} p from s9)"""


@query("q_shapiro", f"with src as (select c_mktsegment || '-' || (c_nationkey % 2)::varchar g, c_acctbal::double x from customer), {_shapiro_sql()} select g as part, n::bigint n, round(w, 6) w, round(p, 5) p from sh where n >= 12")
def q_shapiro(spark, d):
    c = table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit("-"), (F.col("c_nationkey") % 2).cast("string")).alias("part"), F.col("c_acctbal").cast("double").alias("x"))
    return evaluation.shapiro(c, "x", "part").where("n >= 12").select("part", "n", r6("w").alias("w"), F.round("p", 5).alias("p"))


@query("q_chosen", f"""with {SEG}, src as (select 1 g, price x from s), {_shapiro_sql()}, how as (select p < 0.05 m from sh),
 rk as (select fin, (rank() over (order by price) + rank() over (order by price) + count(*) over (partition by price) - 1) / 2 r from s), nn as (select count(*)::double n from s), ti as (select sum(pow(c, 3) - c) t from (select count(*) c from s group by price)), kr as (select sum(r * r / c) v from (select sum(r) r, count(*) c from rk group by fin)),
 h as (select sqrt((12 / (n * (n + 1)) * v - 3 * (n + 1)) / (1 - t / (n * n * n - n))) z from kr, nn, ti), p as (select 2 * ({_above_sql("z")}) p from h),
 t as (select coalesce(fin::varchar, 'Total') fin, count(*) n, case when any_value(m) then 'mean' else 'median' end kind, case when any_value(m) then avg(price) else quantile_cont(price, 0.5) end a, case when any_value(m) then stddev_pop(price) else quantile_cont(price, 0.25) end b, case when not any_value(m) then quantile_cont(price, 0.75) end c from s, how group by rollup (fin))
 select t.fin, n, kind, round(a, 4) a, round(b, 4) b, round(c, 4) c, case when fin = '1' then round(p, 5) end p, case when fin = '1' then case when p < 0.01 then '**' when p < 0.05 then '*' else '' end end mark from t, p""")
def q_chosen(spark, d):
    """Mean or median of the prices of final and other orders, as their normality tells."""
    return tables.chosen(_segments(spark, d), "fin", "price").select("fin", "n", "kind", *(F.round(c, 4).alias(c) for c in "abc"), F.round("p", 5).alias("p"), "mark")


# distances of arrays

PAIRS = "p as (select a.vec_id i, b.vec_id j, list_transform(a.embedding, lambda x: abs(x)::double) a, list_transform(b.embedding, lambda x: abs(x)::double) b from embeddings a join embeddings b on a.vec_id < b.vec_id)"


def _absolute(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x)).alias("v"))


def _vector_pairs(spark, d, how, places=None):
    return blocks.pair_distances(_absolute(spark, d), "vec_id", "v", how, places).toDF("i", "j", "d")


@query("q_braycurtis", f"with {PAIRS} select i, j, round(list_sum(list_transform(range(1, 65), lambda k: abs(a[k] - b[k]))) / list_sum(list_transform(range(1, 65), lambda k: abs(a[k] + b[k]))), 5) d from p")
def q_braycurtis(spark, d):
    return _vector_pairs(spark, d, "braycurtis", 5)


@query("q_euclid", f"with {PAIRS} select i, j, round(sqrt(list_sum(list_transform(range(1, 65), lambda k: (a[k] - b[k]) * (a[k] - b[k])))) / sqrt(64 * 16), 5) d from p")
def q_euclid(spark, d):
    return _vector_pairs(spark, d, "euclidean", 5)


@query("q_cityblock", f"with {PAIRS} select i, j, round(list_sum(list_transform(range(1, 65), lambda k: abs(a[k] - b[k]))) / (64 * 4), 5) d from p")
def q_cityblock(spark, d):
    return _vector_pairs(spark, d, "cityblock", 5)


# clusters, folds, alignments

LABELLED = f"""with {PAIRS}, d as (select i, j, list_sum(list_transform(range(1, 65), lambda k: abs(a[k] - b[k]))) / 256 d from p), e as materialized (select i x, j y, d from d union all select j, i, d from d),
 l as (select e.x, e.y, e.d, u.label lx, v.label ly from e join embeddings u on e.x = u.vec_id join embeddings v on e.y = v.vec_id)"""


def _label_sums(spark, d):
    e = _absolute(spark, d).where("vec_id is not null")
    n, ids = e.agg(F.count("*"), F.count_distinct("vec_id")).first()
    if n == ids:
        return blocks.label_sums(e, "vec_id", "v", "label", "cityblock")
    # rows that share an id have each other's labels, as the joins of the SQL have it
    edges = clustering.both_ways(_vector_pairs(spark, d, "cityblock"), "i", "j")
    return clustering.label_sums(edges, e.select(F.col("vec_id").alias("id"), "label"))


@query("q_intra_inter", LABELLED + " select x id, lx as label, round(avg(d) filter (lx = ly), 6) intra, round(avg(d) filter (lx <> ly), 6) inter from l group by 1, 2")
def q_intra_inter(spark, d):
    return clustering.intra_inter(_label_sums(spark, d)).select("id", "label", r6("intra").alias("intra"), r6("inter").alias("inter"))


@query("q_silhouette", LABELLED + ", m as (select x, lx, ly, avg(d) m from l group by all), s as (select x, lx, max(m) filter (lx = ly) a, min(m) filter (lx <> ly) b from m group by all) select x id, lx as label, round(coalesce((b - a) / greatest(a, b), 0), 5) + 0.0 silhouette from s")
def q_silhouette(spark, d):
    return clustering.silhouette(_label_sums(spark, d)).select("id", "label", (F.round("silhouette", 5) + 0.0).alias("silhouette"))


@query("q_medoid", LABELLED + ", t as (select lx, x, sum(d) total from l where lx = ly group by all) select lx as label, arg_min(x, total) id, round(min(total), 5) total from t group by lx")
def q_medoid(spark, d):
    return clustering.medoids(_label_sums(spark, d)).withColumn("total", F.round("total", 5))


@query("q_nmi", "with c as (select c_mktsegment a, (o_orderkey % 3)::int b, count(*) n from orders join customer on o_custkey = c_custkey group by all), p as (select n / sum(n) over () p, sum(n) over (partition by a) / sum(n) over () pa, sum(n) over (partition by b) / sum(n) over () pb from c) select round(2 * sum(p * ln(p / (pa * pb))) / (-sum(p * ln(pa)) - sum(p * ln(pb))), 8) nmi from p")
def q_nmi(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("a"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 3).alias("b")).join(c, "c_custkey")
    return clustering.agreement(o, "a", "b").select(F.round("nmi", 8).alias("nmi"))


@query("q_folds", "select doc_id, quality, ((row_number() over (partition by quality order by md5('1:' || doc_id), doc_id) - 1) % 5)::int fold from labels")
def q_folds(spark, d):
    return modelling.folds(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 5)


@query("q_balance", "with r as (select doc_id, quality, row_number() over (partition by quality order by md5('1:' || doc_id), doc_id) rn from labels) select doc_id, quality from r where rn <= least((select count(*) from labels where quality = 1), (select count(*) from labels where quality = 0))")
def q_balance(spark, d):
    return modelling.balanced(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("q_class_vector", STAGES + ", s as (select id, list(stage::double order by bin) v from stages where day <= 7 group by id) select id, array_to_string(list_transform(v[1:32] || list_transform(range(0, greatest(32 - len(v), 0)), lambda i: 0.0), lambda x: x::int), ',') as vec from s")
def q_class_vector(spark, d):
    arrays = _stage_arrays(spark, d)
    return arrays.select("id", F.array_join(F.transform(sequences.class_vector(F.col("values"), 8, 4), lambda x: x.cast("int").cast("string")), ",").alias("vec"))


def _stage_arrays(spark, d):
    s = stages(spark, d).where("day <= 7")
    return s.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "stage"))), lambda x: x["stage"].cast("double")).alias("values"))


@query("q_dtw_membership")
def q_dtw_membership(spark, d):
    """Each user's first week against five shapes, by warped distance."""
    shapes = {"flat": [1.0] * 4, "rise": [0.0, 1.0, 2.0, 3.0], "fall": [3.0, 2.0, 1.0, 0.0], "peak": [0.0, 3.0, 3.0, 0.0], "high": [3.0] * 4}
    centers = spark.createDataFrame(list(shapes.items()), "label string, values array<double>")
    costs = alignment.Costs.of_weights([1.0, 1.2, 1.5, 1.3], 0.35)
    return clustering.membership(_stage_arrays(spark, d), centers, costs).withColumn("distance", r6("distance"))


@query("q_dtw_pairs")
def q_dtw_pairs(spark, d):
    """Warped distance of every two users' trajectories."""
    pairs = alignment.all_aligned(_stage_arrays(spark, d), "id", "values", alignment.Costs.of_weights([1.0, 1.2, 1.5, 1.3], 0.35))
    return pairs.select(F.col("key").alias("id"), F.col("key2").alias("id2"), *(r6(c).alias(c) for c in ("distance", "extension_a", "extension_b")))


def _whole_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, v): embeddings as whole numbers, so that no order of a sum shows."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x * 1000)).alias("v"))


@query("q_ward")
def q_ward(spark, d):
    """Ward tree of all embeddings, cut into 8: the label and size of each one's cluster."""
    v = _whole_vectors(spark, d)
    got = clustering.flat(clustering.vector_linkage(v, "id", "v"), v, 8)
    return got.join(got.groupBy("label").agg(F.count("*").alias("size")), "label").select("id", "label", "size")


@query("q_ward_tree")
def q_ward_tree(spark, d):
    """Merges of the Ward tree of all embeddings."""
    return clustering.vector_linkage(_whole_vectors(spark, d), "id", "v").select("a", "b", r6("height").alias("height"), "size")


@query("q_merged_centers")
def q_merged_centers(spark, d):
    """Distinct first weeks of the users, with how many have each, merged while pairs are nearest to each other."""
    weeks = _stage_arrays(spark, d).groupBy("values").agg(F.min("id").alias("label"), F.count("*").alias("size"))
    left, merges = clustering.merged_centers(weeks, alignment.Costs.of_weights([1.0, 1.2, 1.5, 1.3], 0.35), 0.25, 20.0)
    return left.select("label", "size", F.transform("values", lambda x: F.round(x, 6) + F.lit(0.0)).alias("values"))


@query("q_position_means", STAGES + f""", pv as (select id, stage, row_number() over (partition by id order by bin) - 1 place, max(stage) over (partition by id) peak from stages where day <= 7),
 pm as (select peak, place, count(*) n, avg(stage) m, stddev_pop(stage) s, stddev_samp(stage) / sqrt(count(*)) e from pv group by 1, 2) select peak, place::int place, n, round(m, 6) mean, round(s, 6) sd, case when n > 60 then round(e * {_t_quantile_sql("(n - 1)")}, 4) end half from pm""")
def q_position_means(spark, d):
    """Users' first weeks by peak stage, place by place; SQL has the width of an interval by its series, for over 60 values."""
    weeks = _stage_arrays(spark, d).withColumn("peak", F.array_max("values").cast("int"))
    got = trajectories.position_statistics(weeks, "values", "peak")
    return got.select("peak", "place", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), F.when(F.col("n") > 60, F.round("half", 4)).alias("half"))


@query("q_dba")
def q_dba(spark, d):
    """Barycenters of the users' trajectories by peak stage, from constant seeds."""
    s = _stage_arrays(spark, d).withColumn("label", F.array_max("values").cast("int"))
    seeds = s.select("label").distinct().select("label", F.array_repeat(F.col("label").cast("double"), 8).alias("values"))
    got = clustering.barycenters(s.select("label", "values"), seeds, alignment.Costs(alpha=0.0), rounds=3)
    return got.select("label", F.transform("values", lambda x: F.round(x, 6)).alias("values"))


@query("q_categories", STAGES + """, ce as (select id, greatest(min(day), 0) f, least(max(day), 7) t, max(stage) peak, max(stage) * 2 + arg_max(stage, bin) % 2 label from stages group by id),
 cm as (select s.id, label, peak, max(case when s.day = f then stage end) a, max(case when s.day = t then stage end) b from stages s join ce using (id) group by 1, 2, 3),
 cg as (select label, max(peak) peak, avg(a) a, avg(b) b from cm group by label),
 cn as (select label, case when peak >= 4 then '3D' else peak::varchar end || '-' || case when b > a + 0.5 then 'Ws' when b < a - 0.5 then 'Im' else 'St' end name from cg),
 cr as (select *, row_number() over (partition by name order by label) - 1 i from cn) select label, case when i = 0 then name else name || '-' || i end name from cr""")
def q_categories(spark, d):
    s = stages(spark, d)
    of = s.groupBy("id").agg((F.max("stage") * 2 + F.max_by("stage", "bin") % 2).alias("label"), F.max("stage").alias("peak"))
    return clustering.categories(s.select("id", "day", "stage"), of.select("id", "label"), of.select("id", "peak"))


@query("q_center_categories", STAGES + """, v as (select id, arg_min(stage, bin) a, arg_max(stage, bin) b, max(stage) m from stages where day <= 7 group by id)
 select id as label, case when m = 4 then '3D' else m::varchar end || '-' || case when b > a then 'Ws' when b < a then case when b = 0 then 'compIm' else 'partIm' end when m > a then 'Tr' else 'St' end name from v""")
def q_center_categories(spark, d):
    return clustering.center_categories(_stage_arrays(spark, d), "id", transient=True, stratified=True)


@query("q_normality", f"with {SEG}, m as (select seg, avg(price) mu, count(*) n from s group by 1), k as (select s.seg, n, avg(pow(price - mu, 2)) m2, avg(pow(price - mu, 3)) m3, avg(pow(price - mu, 4)) m4 from s join m using (seg) group by all), j as (select seg, n, m3 / pow(m2, 1.5) a, m4 / (m2 * m2) - 3 b from k) select seg, n, round(a, 5) skewness, round(b, 5) kurtosis, round(exp(-n / 6 * (a * a + b * b / 4) / 2), 6) p from j")
def q_normality(spark, d):
    return evaluation.normality(_segments(spark, d), "price", "seg").select("seg", "n", F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"), r6("p").alias("p"))


@query("q_class_weights", "select doc_id, quality, round(count(*) over () / count(*) over (partition by quality), 6) weight from labels")
def q_class_weights(spark, d):
    return modelling.class_weights(table(spark, d, "labels").select("doc_id", "quality"), "quality").withColumn("weight", r6("weight"))


@query("q_stays", """with o as (select o_custkey id, o_orderdate::timestamp a, o_orderdate::timestamp + to_days((o_orderkey % 40)::int) b from orders), p as (select *, max(b) over (partition by id order by a, b rows between unbounded preceding and 1 preceding) e from o),
 n as (select *, sum(case when e is null or epoch_us(a) - epoch_us(e) >= 2 * 86400000000 then 1 else 0 end) over (partition by id order by a, b rows unbounded preceding) n from p) select id, min(a)::timestamp admit, max(b)::timestamp disch from n group by id, n""")
def q_stays(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("admit"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=(F.col("o_orderkey") % 40).cast("int"))).alias("disch"))
    return cohort.merged_stays(o).select("id", F.col("admit").cast("timestamp_ntz").alias("admit"), F.col("disch").cast("timestamp_ntz").alias("disch"))


@query("q_dialysis_mask", f"with {EV} select a.tie, a.id, coalesce(bit_or(case b.event_type when 'error' then 1 when 'signup' then 2 when 'view' then 4 end), 0)::int mask from ev a left join events b on a.id = b.user_id and b.event_type in ('error', 'signup', 'view') and a.ts between b.ts and b.ts + interval 48 hours group by 1, 2")
def q_dialysis_mask(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "HD").when(F.col("event_type") == "signup", "CRRT").when(F.col("event_type") == "view", "PD")
    t = e.select(F.col("user_id").alias("id"), kind.alias("kind"), F.col("ts").alias("start"), F.col("ts").alias("stop")).where("kind is not null")
    v = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("tie"), "ts")
    return cohort.dialysis_mask(v, t, row="tie").select("tie", "id", F.col("mask").cast("int").alias("mask"))


# further shapes


@query("q_extremes", f"with {EV}, s as (select id, min(ts) + interval 1 day st from ev group by 1), i as (select ev.id, ts, tie, value from ev join s on ev.id = s.id and ts >= st and ts <= st + interval 5 day) select s.id, round(arg_min(value, ts), 6) \"first\", round(arg_max(value, ts), 6) \"last\", round(max(value), 6) most, round(min(value), 6) least from s left join i using (id) group by s.id")
def q_extremes(spark, d):
    ms = measurements(spark, d)
    starts = ms.groupBy("id").agg((F.min("ts") + F.expr("interval 1 day")).alias("start"))
    return series.extremes(ms, starts, max_days=5).select("id", *(r6(c).alias(c) for c in ("first", "last", "most", "least")))


@query("q_masked", "select event_id, user_id from events where event_type in ('error', 'view')")
def q_masked(spark, d):
    return series.masked(table(spark, d, "events"), "event_type", ["error", "view"]).select("event_id", "user_id")


@query("q_within", f"with {EV}, w as (select id, min(ts) a, min(ts) + interval 10 day b from ev where mask = 1 group by 1) select ev.id, ev.tie from ev join w on ev.id = w.id and ts >= a - interval 1 day and ts <= b")
def q_within(spark, d):
    ms = measurements(spark, d)
    windows = ms.where("mask = 1").groupBy("id").agg(F.min("ts").alias("a"), (F.min("ts") + F.expr("interval 10 days")).alias("b"))
    return joins.within(ms, windows, "id", "ts", "a", "b", 1).select("id", "tie")


@query("q_location", f"with {EV}, w as (select id, min(ts) a, max(ts) z from ev group by 1) select ev.tie, case when ts between a + interval 2 day and a + interval 6 day then 2 when ts between a + interval 1 day and z - interval 3 day then 1 else 0 end place from ev join w using (id)")
def q_location(spark, d):
    ms = measurements(spark, d)
    w = ms.groupBy("id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    day = lambda n: F.expr(f"interval {n} days")
    at = series.location(F.col("ts"), (F.col("a") + day(2), F.col("a") + day(6)), (F.col("a") + day(1), F.col("z") - day(3)))
    return ms.join(w, "id").select("tie", at.alias("place"))


@query("q_containing", "with l as (select l_orderkey k, l_linenumber n, l_shipdate s from lineitem), w as (select o_orderkey k, o_orderdate a, o_orderdate + interval 45 day b from orders) select l.k, l.n, w.a::date a from l join w on l.k = w.k and s between a and b")
def q_containing(spark, d):
    inner = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_shipdate").alias("s"))
    outer = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("interval 45 days")).alias("b"))
    return joins.containing(inner, outer, "k", "s", "a", "b").select("k", "n", F.col("a").cast("date").alias("a"))


@query("q_codes", "select p_partkey, max((contains(p_type, 'A'))::int) with_a, max((contains(p_type, 'STE'))::int) with_ste from part group by 1")
def q_codes(spark, d):
    codes = spark.createDataFrame([("with_a", "Ax"), ("with_ste", "STE")], "name string, pattern string")
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return joins.has_codes(p.select("p_partkey"), p, codes, "p_partkey", "p_type", "name", "pattern", ["with_a", "with_ste"])


@query("q_balance_over", "with r as (select doc_id, quality, row_number() over (partition by quality order by md5('1:' || doc_id), doc_id) rn from labels), c as (select count(*) filter (quality = 1) p, count(*) filter (quality = 0) n from labels), t as (select doc_id, case when (quality = 1) = (p <= n) then greatest(p, n) // least(p, n) + (rn <= greatest(p, n) % least(p, n))::int else 1 end k from r, c) select doc_id, k::bigint copies from t")
def q_balance_over(spark, d):
    more = modelling.balanced(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", "rand_over")
    return more.groupBy("doc_id").agg(F.count("*").alias("copies"))


@query("q_similarity", LABELLED + ", w as materialized (select pow(stddev_pop(d), 2) v from e) select x, y, round(exp(-d * d / v), 5) s from e, w")
def q_similarity(spark, d):
    return clustering.vector_similarity(_absolute(spark, d), "vec_id", "v", "cityblock", 5)


@query("q_category_counts", "with c as (select unnest(['BRASS', 'STEEL', 'PROMO']) category) select category, count(distinct p_type) n from c join part on contains(p_type, category) group by 1")
def q_category_counts(spark, d):
    return clustering.category_counts(table(spark, d, "part"), ["BRASS", "STEEL", "PROMO"], "p_type")


@query("q_free_days", "with s as (select o_custkey id, sum(o_orderkey % 5) n, max((o_orderstatus = 'F')::int) f from orders group by 1) select id, case when f = 1 and n > 20 then 0.0 else greatest(0, 28.0 - n)::double end free from s")
def q_free_days(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.col("o_orderkey") % 5).alias("n"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    return s.select("id", outcomes.free_days(F.col("n").cast("double"), ((F.col("f") == 1) & (F.col("n") > 20)).cast("int")).alias("free"))


# extracts: customers as patients, their orders as rows of the raw tables

IDS = "ids as (select o_custkey id, min(o_orderdate)::timestamp + interval 365 day admit, min(o_orderdate)::timestamp + interval 385 day disch from orders group by 1)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").cast("timestamp").alias("first"))
    return first.select("id", (F.col("first") + F.expr("interval 365 days")).alias("admit"), (F.col("first") + F.expr("interval 385 days")).alias("disch"))


def _rows(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_custkey as id", "o_orderkey as place", *(f"{x} as {c}" for c, x in columns.items()))


@query("q_mortality", f"""with {IDS}, s as (select o_custkey id, max(o_orderkey % 11 = 0) said from orders group by 1), r as (select o_custkey id, max(case when o_orderkey % 3 = 0 then o_orderdate end)::timestamp recorded from orders group by 1),
 f as (select id, admit, disch, coalesce(said, false) said, coalesce(recorded, case when said then disch end) death from ids left join s using (id) left join r using (id))
 select id, (said or coalesce(death::date <= disch::date, false))::int died_inp, coalesce(death - admit < interval 90 day, false)::int died_90_admit, (said or coalesce(death - disch < interval 90 day, false))::int died_90_disch,
 coalesce(death - admit < interval 120 day, false)::int died_120_admit, (said or coalesce(death - disch < interval 120 day, false))::int died_120_disch, round((epoch_us(death) - epoch_us(admit)) / 86400000000, 6) as days from f""")
def q_mortality(spark, d):
    said = _rows(spark, d, DISCHARGE_DISPOSITION="case when o_orderkey % 11 = 0 then 'Expired - less than 48h' when o_orderkey % 5 > 0 then 'Home' end")
    died = _rows(spark, d, DECEASED_DATE="cast(case when o_orderkey % 3 = 0 then o_orderdate end as timestamp)")
    return extracts.mortality(_ids(spark, d), said, died).withColumn("days", r6("days")).drop("death")


@query("q_medications", f"""with {IDS}, o as (select o_custkey id, o_orderdate::timestamp s, o_orderdate::timestamp + to_days((o_orderkey % 400)::int) e, ['Dopamine 5', 'norepinephrine', 'EPINEPHRINE', 'aspirin', 'x'][o_orderkey % 5 + 1] drug, ['ACEI', 'arb', 'Presor', 'statin', null, 'nsaid'][o_orderkey % 6 + 1] kind from orders where o_orderkey % 7 > 0),
 m as (select id, lower(drug) n, lower(kind) k from ids join o using (id) where s <= admit and (e > admit or date_diff('day', admit, s) <= 1)),
 g as (select id, max(coalesce(k in ('acei', 'arb', 'nsaid'), false)::int) nephrotoxic, max((coalesce(k = 'presor', false) or contains(n, 'dopamine') or contains(n, 'epinephrine'))::int) vasoactive, max(contains(n, 'dopamine')::int) dopamine,
  max(contains(n, 'norepinephrine')::int) norepinephrine, max((n = 'epinephrine')::int) epinephrine from m group by 1)
 select id, coalesce(nephrotoxic, 0) nephrotoxic, coalesce(vasoactive, 0) vasoactive, coalesce(dopamine, 0) dopamine, coalesce(norepinephrine, 0) norepinephrine, coalesce(epinephrine, 0) epinephrine from ids left join g using (id)""")
def q_medications(spark, d):
    drug, kind = "array('Dopamine 5', 'norepinephrine', 'EPINEPHRINE', 'aspirin', 'x')", "array('ACEI', 'arb', 'Presor', 'statin', null, 'nsaid')"
    raw = _rows(spark, d, ORDER_ENTERED_DATE="cast(o_orderdate as timestamp)", MEDICATION_NAME=f"get({drug}, cast(o_orderkey % 5 as int))", MEDICATION_TYPE=f"get({kind}, cast(o_orderkey % 6 as int))", DAYS_ON_MEDICATION="case when o_orderkey % 7 > 0 then cast(o_orderkey % 400 as double) end")
    return extracts.medications(_ids(spark, d), raw).select("id", "nephrotoxic", "vasoactive", "dopamine", "norepinephrine", "epinephrine")


@query("q_comorbidities", f"""with {IDS}, o as (select o_custkey id, min(o_orderkey) k from orders group by 1)
 select id, nullif(k % 5, 0) charlson, list_sum(list_transform(range(1, 32), lambda i: ((k + i) % 2) * (i % 3)))::double elixhauser, greatest((k + 10) % 2, (k + 11) % 2)::int diabetic, greatest((k + 5) % 2, (k + 6) % 2)::int hypertensive, (k % 4 = 0 or coalesce(k % 6 = 1, false))::int smoker from ids join o using (id)""")
def q_comorbidities(spark, d):
    charlson = _rows(spark, d, CHARLSON_INDEX="o_orderkey % 5", **{f"CC_GRP_{i}": f"cast((o_orderkey + {i}) % 2 as int)" for i in range(1, 15)})
    elixhauser = _rows(spark, d, **{f"ELX_GRP_{i}": f"cast((o_orderkey + {i}) % 2 as int)" for i in range(1, 32)})
    smoking = _rows(spark, d, SMOKING_HISTORY_STATUS="case when o_orderkey % 4 = 0 then 'FORMER SMOKER' when o_orderkey % 4 = 1 then 'YES' end", SMOKING_CURRENT_STATUS="case when o_orderkey % 6 = 1 then 'YES' when o_orderkey % 6 = 2 then 'NO' end")
    got = extracts.comorbidities(_ids(spark, d), charlson, elixhauser, smoking, [float(i % 3) for i in range(1, 32)])
    return got.select("id", "charlson", F.col("elixhauser").cast("double").alias("elixhauser"), "diabetic", "hypertensive", "smoker")


@query("q_fluids", f"""with {IDS}, o as (select o_custkey id, arg_min(o_totalprice, o_orderkey) p, min(o_orderkey) k from orders group by 1), w as (select id, p, k, 50.0 + k % 60 weight from o),
 x as (select id, unnest([{{i: p % 5000, o: p % 3000}}, {{i: case when k % 3 > 0 then p % 4000 end, o: p % 2000}}]) v from w), g as (select id, avg(v.i - v.o) / 1000 net, avg(v.i + v.o) / 1000 gross, sum(v.i - v.o) / 1000 balance from x where v.i > 0 and v.o > 0 group by 1)
 select id, round(net, 6) + 0.0 net, round(gross, 6) gross, round(net / weight * 100, 6) + 0.0 overload, round(balance, 6) + 0.0 balance from ids left join g using (id) left join w using (id)""")
def q_fluids(spark, d):
    day = {"D0_IN": "o_totalprice % 5000", "D0_OUT": "o_totalprice % 3000", "D1_IN": "case when o_orderkey % 3 > 0 then o_totalprice % 4000 end", "D1_OUT": "o_totalprice % 2000"}
    raw = _rows(spark, d, **{f"IO_TOTALS_{c}VALUE": x for c, x in day.items()})
    weights = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.min("o_orderkey") % 60 + 50.0).alias("weight"))
    return extracts.fluids(_ids(spark, d), raw, weights).select("id", *(r6(c).alias(c) for c in ("net", "gross", "overload", "balance")))


FLOW = {
    "TERM_GRP_NAME": "case o_orderkey // 4 % 9 when 0 then 'HEIGHT' when 1 then 'WEIGHT' when 2 then 'UOP' when 3 then 'IN' when 4 then 'Out' when 5 then 'TEMPERATURE' when 6 then 'MAP' when 7 then 'HEART RATE' else 'GLASGOW SCORE' end",
    "DAY_NO": "'D' || cast(o_orderkey // 7 % 5 as varchar)", "D_MIN_VAL": "case when o_orderkey % 5 > 0 then 40.0 + o_orderkey % 60 end", "D_MAX_VAL": "50.0 + o_orderkey % 90", "D_SUM_VAL": "o_orderkey % 1700 - 100.0",
}


def _flow_sql() -> str:
    cells = "select id, term, day, arg_min_null(lo, place) lo, arg_min_null(hi, place) hi, arg_min_null(su, place) su, count(*) n from r where day in ('D0', 'D1', 'D2', 'D3') group by 1, 2, 3"
    at = lambda term, k, c, one="": f"max(case when term = '{term}' and day = 'D{k}'{one} then {c} end)"
    sums = ", ".join(f"{at(t, k, 'su', ' and n = 1')} {n}{k}" for t, n in (("IN", "i"), ("Out", "o")) for k in range(4))
    vital = lambda term: "[" + ", ".join(f"{at(term, k, c)}" for k in range(3) for c in ("lo", "hi")) + "]"
    vitals = ", ".join(f"{vital(t)} {n}" for n, t in extracts.VITALS.items())
    urine = "[" + ", ".join(at("UOP", k, "su") for k in range(3)) + "]"
    both = lambda sign, days: " + ".join(f"coalesce(i{k} {sign} o{k}, 0)" for k in range(days))
    count = " + ".join(f"(i{k} - o{k} is not null)::int" for k in range(4))
    made = ", ".join(f"{x} as {n}" if n in ("term", "day") else f"({x})::double as {n}" for x, n in zip(FLOW.values(), ("term", "day", "lo", "hi", "su")))
    return f"""with {IDS}, r as (select o_custkey id, o_orderkey place, {made} from orders), c as ({cells}),
 z as (select id, arg_min(lo, place) filter (term = 'HEIGHT' and lo is not null) h, arg_min(lo, place) filter (term = 'WEIGHT' and lo is not null) w from r where day in ('D0', 'D1', 'D2', 'D3') group by 1),
 m as (select id, {sums}, {vitals}, {urine} urine from c group by 1), k as (select ids.*, h / 39.37 height, w weight, m.* exclude (id), {both("-", 4)} bal, {both("+", 3)} gro, {count} nd from ids left join z using (id) left join m using (id))
 select id, round(height, 6) height, weight, round(weight / (height * height), 6) bmi, {", ".join(f"coalesce({n}, [null, null, null, null, null, null]) {n}" for n in extracts.VITALS)}, coalesce(urine, [null, null, null]) urine,
  [round(urine[1] / weight / 24, 6), round(urine[2] / weight / 24, 6), round(urine[3] / weight / 24, 6)] urine_flow, case when gro >= 0 and nd > 0 then round(bal / nd, 6) end net, case when gro >= 0 then gro end gross, bal as balance, round(bal / weight / ((24 - hour(admit)) + 3 * 24) * 100, 6) overload from k"""


@query("q_flow_sheet", _flow_sql().replace("'D' || cast(o_orderkey // 7 % 5 as varchar)", "'D' || (o_orderkey // 7 % 5)::varchar"))
def q_flow_sheet(spark, d):
    raw = _rows(spark, d, **{c: (x if c in ("TERM_GRP_NAME", "DAY_NO") else f"cast({x} as double)").replace("o_orderkey // 4", "(o_orderkey div 4)").replace("o_orderkey // 7", "(o_orderkey div 7)").replace("as varchar", "as string") for c, x in FLOW.items()})
    got = extracts.flow_sheet(_ids(spark, d), raw)
    flat = [F.flatten(F.transform(n, lambda x: F.array(x["low"], x["high"]))).alias(n) for n in extracts.VITALS]
    return got.select("id", r6("height").alias("height"), "weight", r6("bmi").alias("bmi"), *flat, "urine", F.transform("urine_flow", lambda x: F.round(x, 6) + F.lit(0.0)).alias("urine_flow"), r6("net").alias("net"), "gross", "balance", r6("overload").alias("overload"))


@query("q_baseline", """with v as (select user_id id, ts::timestamp ts, value, event_type in ('view', 'click') inside, timestamp '2024-01-25' + to_days((user_id % 5)::int) admit from events),
 c as (select id, inside, ts, avg(value) as value, min(epoch_us(admit) - epoch_us(ts)) / 86400e6 age from v where epoch_us(admit) - epoch_us(ts) >= case when inside then 7 else 1 end * 86400000000 group by 1, 2, 3),
 r as (select *, row_number() over (partition by id, inside order by ts desc) n from c), k as (select * from r where n = 1 and age > case when inside then 7 else 1 end and age < 365),
 p as (select distinct user_id id from events)
 select id, case when o.ts is not null then 'OUTPATIENT' when i.ts is not null then 'INPATIENT' else 'mdrd' end kind, round(coalesce(o.value, i.value), 6) base, coalesce(o.ts, i.ts) base_at
 from p left join (select * from k where not inside) o using (id) left join (select * from k where inside) i using (id)""")
def q_baseline(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value", F.when(F.col("event_type").isin("view", "click"), "Inpatient ward").otherwise("Clinic").alias("kind"))
    patients = e.select("id").distinct().selectExpr("id", "timestamp'2024-01-25' + make_dt_interval(cast(id % 5 as int)) as admit", "cast(id % 2 as int) as male", "cast(id % 3 = 0 as int) as black", "20 + id % 60 as age")
    got = cohort.baselines(e, patients)
    return got.select("id", "kind", F.when(F.col("kind") != "mdrd", r6("base")).alias("base"), F.col("base_at").cast("timestamp_ntz").alias("base_at"))


@query("q_late_values", """with o as (select o_custkey id, min(o_orderdate)::timestamp ref from orders group by 1), v as (select id, o_orderkey tie, epoch_us(o_orderdate::timestamp) - epoch_us(ref) us, o_orderdate::timestamp ts from o join orders on o_custkey = id),
 w as (select *, us / 86400e6 after, floor(90 - us / 86400e6)::int off from v where us > 0 and us < 120 * 86400e6 and floor(us / 86400e6) > 7), r as (select *, row_number() over (partition by id order by abs(off), ts, tie) n from w qualify n <= 3),
 s as (select *, max(off) over u - min(off) over u span from r window u as (partition by id order by n rows unbounded preceding))
 select id, max(n)::int n_used, arg_min(off, n) nearest from s where span <= 30 or n = 1 group by 1""")
def q_late_values(spark, d):
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.lit(1.0) + F.col("o_orderkey") / 1e9).alias("creatinine"))
    patients = v.groupBy("id").agg(F.min("ts").alias("ref")).selectExpr("id", "ref", "cast(id % 2 as int) as male", "cast(id % 3 = 0 as int) as black", "cast(20 + id % 60 as int) as age")
    return outcomes.late_gfr(patients, v, 30, 3, 7).select("id", F.col("n_used").cast("int").alias("n_used"), "nearest")


SOFA_OF = {
    "po2": "case when c_custkey % 7 > 0 then 40.0 + c_custkey % 300 end", "fio2": "case when c_custkey % 5 > 0 then 0.2 + c_custkey % 8 / 10.0 end", "ventilated": "c_custkey % 2", "gcs": "case when c_custkey % 11 > 0 then 3.0 + c_custkey % 13 end", "map": "50.0 + c_custkey % 60",
    "dopamine": "cast(c_custkey % 17 = 0 as int)", "epinephrine": "cast(c_custkey % 23 = 0 as int)", "bilirubin": "c_custkey % 150 / 10.0", "platelets": "c_custkey % 300", "creatinine": "case when c_custkey % 13 > 0 then c_custkey % 70 / 10.0 end",
}


def _points(cases: list[tuple[int, str]]) -> str:
    return "case " + " ".join(f"when {c} then {n}" for n, c in cases) + " else 0 end"


def _sofa_sql() -> str:
    parts = {
        "respiration": [(4, "ventilated = 1 and po2 / fio2 < 100"), (3, "ventilated = 1 and po2 / fio2 < 200"), (2, "ventilated = 0 and po2 / fio2 < 300"), (1, "ventilated = 0 and po2 / fio2 < 400")],
        "coma": [(4, "gcs < 6"), (3, "gcs < 10"), (2, "gcs < 13"), (1, "gcs < 15")],
        "circulation": [(3, "epinephrine = 1"), (2, "dopamine = 1"), (1, "map < 70")],
        "liver": [(4, "bilirubin > 12"), (3, "bilirubin > 6"), (2, "bilirubin > 2"), (1, "bilirubin > 1.2")],
        "coagulation": [(4, "platelets < 20"), (3, "platelets < 50"), (2, "platelets < 100"), (1, "platelets < 150")],
        "kidney": [(4, "creatinine > 5"), (3, "creatinine > 3.5"), (2, "creatinine > 2"), (1, "creatinine > 1.2")],
    }
    made = ", ".join(f"({x})::double {c}" for c, x in SOFA_OF.items())
    filled = ", ".join(f"coalesce({c}, median({c}) over (partition by ventilated)) {c}" for c in ("po2", "fio2", "gcs"))
    scored = ", ".join(f"{_points(cases)} {name}" for name, cases in parts.items())
    return f"with p as (select c_custkey id, {made} from customer), f as (select * exclude (po2, fio2, gcs), {filled} from p), s as (select id, {scored} from f) select *, {' + '.join(parts)} sofa from s"


@query("q_sofa", _sofa_sql())
def q_sofa(spark, d):
    p = table(spark, d, "customer").selectExpr("c_custkey as id", *(f"cast({x} as double) as {c}" for c, x in SOFA_OF.items()))
    return scores.sofa(p)


APACHE_OF = {
    "temp": (29, 13, 1), "map": (40, 130, 1), "hr": (40, 130, 1), "rr": (3, 50, 1), "ph": (700, 90, 100), "na": (105, 80, 1), "k": (20, 55, 10), "hct": (15, 50, 1), "wbc": (0, 45, 1),
}


def _apache_of() -> dict[str, str]:
    out = {f"{c}_low": f"cast({a} + c_custkey % {m} as double) / {s}" for c, (a, m, s) in APACHE_OF.items()}
    out |= {f"{c}_high": f"case when c_custkey % 9 > 0 then cast({a} + c_custkey % {m} + c_custkey % 6 as double) / {s} end" for c, (a, m, s) in APACHE_OF.items()}
    return out | {"fio2": "cast(20 + c_custkey % 75 as double) / 100", "po2": "cast(40 + c_custkey % 90 as double)", "pco2": "cast(30 + c_custkey % 31 as double)", "creatinine": "cast(c_custkey % 50 as double) / 10", "gcs": "case when c_custkey % 11 > 0 then cast(3 + c_custkey % 13 as double) end", "age": "cast(18 + c_custkey % 75 as double)"}


def _apache_sql() -> str:
    g = "(fio2 * 713 - pco2 / 0.8 - po2)"
    pressure = lambda n: [(4, f"{n}_low < 49 or {n}_high > 160"), (3, f"{n}_high > 130"), (2, f"{n}_low < 70 or {n}_high > 110")]
    parts = {
        "temperature": [(4, "temp_low < 30 or temp_high > 40"), (3, "temp_low < 32 or temp_high > 39"), (2, "temp_low < 34"), (1, "temp_low < 36 or temp_high > 38.5")], "pressure": pressure("map"), "heart": pressure("hr"),
        "respiration": [(4, "rr_low <= 5 or rr_high >= 50"), (3, "rr_high >= 35"), (2, "rr_low <= 10"), (1, "rr_low < 12 or rr_high >= 25")],
        "oxygen": [(4, f"fio2 >= 0.5 and {g} >= 500"), (3, f"fio2 >= 0.5 and {g} > 350"), (2, f"fio2 >= 0.5 and {g} > 200"), (4, "fio2 < 0.5 and po2 < 55"), (3, "fio2 < 0.5 and po2 < 60"), (1, "fio2 < 0.5 and po2 < 70")],
        "acidity": [(4, "ph_low <= 7.15 or ph_high >= 7.7"), (3, "ph_low < 7.25 or ph_high >= 7.6"), (2, "ph_low < 7.33"), (1, "ph_high >= 7.5")],
        "sodium": [(4, "na_low <= 110 or na_high >= 180"), (3, "na_low < 120 or na_high >= 160"), (2, "na_low < 130 or na_high >= 155"), (1, "na_high >= 150")],
        "potassium": [(4, "k_low < 2.5 or k_high >= 7"), (3, "k_high >= 6"), (2, "k_low < 3"), (1, "k_low < 3.5 or k_high >= 5.5")], "kidney": [(4, "creatinine >= 3.5"), (3, "creatinine >= 2"), (2, "creatinine >= 1.5 or creatinine < 0.6")],
        "hematocrit": [(4, "hct_low < 20 or hct_high >= 60"), (2, "hct_low < 30 or hct_high >= 50"), (1, "hct_high >= 46")], "leukocytes": [(4, "wbc_low < 1 or wbc_high >= 40"), (2, "wbc_low < 3 or wbc_high >= 20"), (1, "wbc_high >= 15")],
    }
    made = ", ".join(f"({x})::double {c}" for c, x in _apache_of().items())
    scored = ", ".join(f"{_points(cases)} {name}" for name, cases in parts.items()) + ", coalesce((15 - gcs)::int, 0) coma, " + _points([(6, "age >= 75"), (5, "age >= 65"), (3, "age >= 55"), (2, "age >= 45")]) + " age_points"
    return f"with p as (select c_custkey id, {made} from customer), s as (select id, {scored} from p) select *, {' + '.join([*parts, 'coma', 'age_points'])} apache from s"


@query("q_apache", _apache_sql())
def q_apache(spark, d):
    return scores.apache(table(spark, d, "customer").selectExpr("c_custkey as id", *(f"{x} as {c}" for c, x in _apache_of().items())))


OUTCOMES = ("died_inp", "died_90", "died_window", "esrd_review", "esrd_status", "esrd_90", "esrd_window", "dialysis_review", "dialysis")


def _outcomes_sql() -> str:
    mdrd = "175 * pow(c, -1.154) * pow(age, -0.203) * (case when male = 1 then 1 else 0.742 end) * (case when black = 1 then 1.212 else 1 end)"
    flags = ", ".join(f"case when died_90 = 0 then coalesce({x}, 0) else 0 end {n}" for n, x in (("esrd_review", "er"), ("dialysis_review", "dr"), ("esrd_status", "es"), ("esrd_90", "(ra > 0 and ra < 90)::int"), ("esrd_window", "(ra > 0 and ra < 120)::int"), ("dialysis", "dia")))
    drops = ", ".join(f"case when coalesce(dia, 0) = 0 and died_90 = 0 then coalesce((gfr90 / bg * 100 < {100 - k})::int, 0) else 0 end drop_{k}" for k in (25, 30, 50))
    return f"""with f as (select o_custkey id, min(o_orderdate)::timestamp f from orders group by 1),
 p as (select id, f + interval 20 day ref, f + interval 25 day hosp, (id % 13 = 0)::int died_inp, case when id % 4 = 0 then f + to_days((id % 200)::int) end death, (id % 2)::int male, (id % 3 = 0)::int black, (20 + id % 60)::int age, 60.0 + id % 40 bg from f),
 d as (select *, coalesce(epoch_us(death) - epoch_us(ref) < 90 * 86400e6, false)::int died_90, coalesce(epoch_us(death) - epoch_us(ref) < 120 * 86400e6, false)::int died_window from p),
 rv as (select o_custkey id, max((o_orderkey % 2 = 1)::int) er, max((o_orderkey % 3 = 0)::int) dr from orders where o_orderkey % 17 = 0 group by 1), st as (select o_custkey id, max((o_orderkey % 2 = 0)::int) es from orders where o_orderkey % 11 = 0 group by 1), rg as (select o_custkey id, min(o_orderdate)::timestamp failed from orders where o_orderkey % 23 = 0 group by 1),
 di as (select id, max(((s < hosp - interval 2 day and e > hosp - interval 2 day) or (s >= hosp - interval 2 day and s < hosp))::int) dia from (select o_custkey id, o_orderdate::timestamp s, o_orderdate::timestamp + to_days((o_orderkey % 9)::int) e from orders where o_orderkey % 6 = 0) join p using (id) group by 1),
 v as (select id, o_orderdate::timestamp ts, 0.6 + o_orderkey % 40 / 10.0 c, (epoch_us(o_orderdate::timestamp) - epoch_us(ref)) / 86400e6 a, male, black, age from orders join p on o_custkey = id),
 w as (select *, floor(90 - a)::int off, {mdrd} gfr from v where a > 0 and a < 120 and floor(a) > 7), r as (select *, row_number() over (partition by id order by abs(off), ts, c) n from w qualify n <= 3),
 s as (select *, max(off) over u - min(off) over u span, avg(gfr) over u m from r window u as (partition by id order by n rows unbounded preceding)), g as (select id, arg_max(m, n) gfr90, max(n) n_used, arg_min(off, n) nearest from s where span <= 30 or n = 1 group by 1),
 j as (select d.*, er, dr, es, dia, gfr90, n_used, nearest, (epoch_us(failed) - epoch_us(ref)) / 86400e6 ra from d left join rv using (id) left join st using (id) left join rg using (id) left join di using (id) left join g using (id)),
 o as (select id, died_inp, died_90, died_window, {flags}, {drops}, n_used::int n_used, nearest from j)
 select *, {", ".join(f"greatest({', '.join(OUTCOMES)}, drop_{k}) d{k}" for k in (25, 30, 50))} from o"""


@query("q_kidney_outcomes", _outcomes_sql())
def q_kidney_outcomes(spark, d):
    """Outcomes at 90 days of customers as patients, their orders as values, treatments, reviews and registry."""
    rows = table(spark, d, "orders").selectExpr("o_custkey as id", "o_orderkey as k", "cast(o_orderdate as timestamp) as ts")
    p = rows.groupBy("id").agg(F.min("ts").alias("f")).selectExpr(
        "id", "f + interval 10 days as icu_admit", "f + interval 20 days as icu_disch", "f + interval 25 days as hosp_disch", "cast(id % 13 = 0 as int) as died_inp", "case when id % 4 = 0 then f + make_dt_interval(cast(id % 200 as int)) end as death",
        "cast(id % 2 as int) as male", "cast(id % 3 = 0 as int) as black", "cast(20 + id % 60 as int) as age", "60.0D + id % 40 as baseline_gfr",
    )
    got = outcomes.kidney_outcomes(
        p, rows.selectExpr("id", "ts", "0.6D + (k % 40) / 10.0D as creatinine"), rows.where("k % 6 = 0").selectExpr("id", "ts as start", "ts + make_dt_interval(cast(k % 9 as int)) as stop"),
        rows.where("k % 17 = 0").selectExpr("id", "cast(k % 2 as int) as during", "cast(k % 3 = 0 as int) as rrt_dependent"), rows.where("k % 11 = 0").selectExpr("id", "if(k % 2 = 0, 'Y', 'N') as during"), rows.where("k % 23 = 0").selectExpr("id", "ts as failed_on"), buffer=30, count=3,
    )
    return got.withColumn("n_used", F.col("n_used").cast("int"))


@query("q_cohort_exclusions", STAGES + f""", pt as (select distinct user_id id, case when user_id % 10 > 0 then (user_id % 2)::int end male, (user_id % 3 = 0)::int black, case when user_id % 17 > 0 then date '1950-01-01' end birth, (10 + user_id % 80)::int age, case when user_id % 41 > 0 then timestamp '2024-01-10' end admit,
  case when user_id % 19 > 0 then 0.5 + user_id % 50 / 10.0 end base, case when user_id % 3 = 0 then timestamp '2024-01-10' + to_days((user_id % 40)::int) end death, (user_id % 29 = 0)::int st, (user_id % 31 = 0)::int rg, case when user_id % 2 = 0 then (user_id % 4 = 0)::int end rv from events),
 vv as (select id, count(ts) n, epoch_us(max(ts)) - epoch_us(min(ts)) sp from ev group by 1), ww as (select id, max(stage) worst from stages where day <= 3 group by 1), gr as (select user_id id, max((event_id % 97 = 0 or event_id % 89 = 0)::int) t1, max((event_id % 83 = 0)::int) t2 from events group by 1),
 jj as (select *, case when st <> rg and rv is not null then rv else greatest(st, rg) end es, 175 * pow(base, -1.154) * pow(age, -0.203) * (case when male = 1 then 1 else 0.742 end) * (case when black = 1 then 1.212 else 1 end) gfr from pt left join vv using (id) left join ww using (id) left join gr using (id)),
 fl as (select id, (n = 0)::int no_values, (n = 1)::int one_value, (n > 1 and sp < 6 * 3600e6)::int short_span, (male is null or black is null)::int no_sex_or_race, (birth is null)::int no_birth_date, (admit is null or base is null)::int no_admission_or_base, coalesce(base >= 4, false)::int high_base, (age < 18)::int minor,
  coalesce(date_diff('day', admit::date, death::date) <= 3, false)::int early_death, (es = 1)::int esrd, coalesce(gfr < 15, false)::int low_gfr, (t1 + t2 > 0)::int transplant, (coalesce(worst, 0) = 0)::int no_injury from jj)
 select *, {"case " + " ".join(f"when {n} = 1 then '{n}'" for n in cohort.EXCLUSIONS) + " end"} reason, greatest({", ".join(cohort.EXCLUSIONS)}) = 0 kept from fl""")
def q_cohort_exclusions(spark, d):
    """The thirteen exclusions of users as patients, with their series' stages and made diagnoses and surgeries."""
    e = table(spark, d, "events").selectExpr("user_id as id", "event_id as k")
    p = e.select("id").distinct().selectExpr(
        "id", "case when id % 10 > 0 then cast(id % 2 as int) end as male", "cast(id % 3 = 0 as int) as black", "case when id % 17 > 0 then date'1950-01-01' end as birth", "cast(10 + id % 80 as int) as age", "case when id % 41 > 0 then timestamp'2024-01-10' end as admit",
        "case when id % 19 > 0 then 0.5D + (id % 50) / 10.0D end as base", "case when id % 3 = 0 then timestamp'2024-01-10' + make_dt_interval(cast(id % 40 as int)) end as death", "cast(id % 29 = 0 as int) as esrd_status", "cast(id % 31 = 0 as int) as esrd_registry", "case when id % 2 = 0 then cast(id % 4 = 0 as int) end as esrd_review",
    )
    diagnoses = e.selectExpr("id", "if(k % 97 = 0, 'Transplanted kidney', null) as text", "if(k % 89 = 0, 'V42.0', '401') as code")
    surgeries = e.selectExpr("id", "if(k % 83 = 0, 'renal transplant', 'other') as text")
    return cohort.exclusions(p, measurements(spark, d).select("id", "ts"), stages(spark, d), diagnoses, surgeries)


@query("q_paired_gfr", """with f as (select o_custkey id, min(o_orderdate)::timestamp ref from orders group by 1), v as (select id, 0.6 + o_orderkey % 40 / 10.0 c, o_orderdate::timestamp + to_hours((o_orderkey % 5)::int) ts, ref from f join orders on o_custkey = id),
 w as (select *, (epoch_us(ts) - epoch_us(ref)) / 86400e6 d from v), l as (select id, list(c order by abs(90 - d), ts, c) c, list(d order by abs(90 - d), ts, c) d from w where d > 7 and d < 720 group by 1),
 a as (select *, len(c) n, len(c) > 1 and abs(d[1] - d[2]) * 24 <= 2 p, case when p then 3 else 2 end j from l), b as (select *, case when p then (c[1] + c[2]) / 2 else c[1] end x, n >= j and d[1] - d[j] < 30 q, case when n > j and abs(d[j] - d[j + 1]) * 24 <= 2 then (c[j] + c[j + 1]) / 2 else c[j] end y from a),
 m as (select id, case when q then (x + y) / 2 else x end m, 1 + q::int n_used from b)
 select id, round(m, 6) creatinine90, round(175 * pow(m, -1.154) * pow(20 + id % 60, -0.203) * (case when id % 2 = 1 then 1 else 0.742 end) * (case when id % 3 = 0 then 1.212 else 1 end), 6) gfr90, n_used from m""")
def q_paired_gfr(spark, d):
    v = table(spark, d, "orders").selectExpr("o_custkey as id", "cast(o_orderdate as timestamp) as day", "cast(o_orderdate as timestamp) + make_dt_interval(0, cast(o_orderkey % 5 as int)) as ts", "0.6D + (o_orderkey % 40) / 10.0D as creatinine")
    p = v.groupBy("id").agg(F.min("day").alias("ref")).selectExpr("id", "ref", "cast(id % 2 as int) as male", "cast(id % 3 = 0 as int) as black", "cast(20 + id % 60 as int) as age")
    return outcomes.paired_gfr(p, v, buffer=630, count=2).select("id", r6("creatinine90").alias("creatinine90"), r6("gfr90").alias("gfr90"), "n_used")


@query("q_located_values", f"""with {EV}, w as (select id, min(ts) a, max(ts) z from ev group by 1), t as (select user_id id, case event_type when 'error' then 1 when 'signup' then 2 when 'view' then 4 end b, ts s from events where event_type in ('error', 'signup', 'view')),
 m as (select ev.tie, coalesce(bit_or(b), 0) mask from ev left join t on ev.id = t.id and ev.ts between s and s + interval 48 hours group by 1)
 select ev.tie, case when ts between a + interval 2 day and a + interval 6 day then 2 when ts between a + interval 1 day and z - interval 3 day then 1 else 0 end place, (m.mask & 1)::int on_hd, ((m.mask & 2) > 0)::int on_crrt, ((m.mask & 4) > 0)::int on_pd, (m.mask > 0)::int on_any from ev join w using (id) join m using (tie)""")
def q_located_values(spark, d):
    ms = measurements(spark, d)
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "HD").when(F.col("event_type") == "signup", "CRRT").when(F.col("event_type") == "view", "PD")
    treatments = e.select(F.col("user_id").alias("id"), kind.alias("kind"), F.col("ts").alias("start"), F.col("ts").alias("stop")).where("kind is not null")
    w = ms.groupBy("id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    icu = w.select("id", (F.col("a") + F.expr("interval 2 days")).alias("start"), (F.col("a") + F.expr("interval 6 days")).alias("stop"))
    hospital = w.select("id", (F.col("a") + F.expr("interval 1 day")).alias("start"), (F.col("z") - F.expr("interval 3 days")).alias("stop"))
    return cohort.located_values(ms.select("id", "tie", "ts"), icu, hospital, treatments, row="tie").select("tie", "place", "on_hd", "on_crrt", "on_pd", "on_any")


@query("q_feature_pairs", f"""with {SEG}, t as (select seg, fin, f, v from (select seg, fin, unnest(['price', 'root']) f, unnest([price::double, sqrt(price::double)]) v from s)), r as (select seg, row_number() over (order by avg(fin), seg) k from s group by 1),
 m as (select f, t.seg, k, count(*)::double n, avg(v) m, var_samp(v) v from t join r using (seg) group by 1, 2, 3), w as (select a.f feature, a.seg label1, b.seg label2, a.m mean1, b.m mean2, a.n + b.n - 2 df, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) t from m a join m b on a.f = b.f and a.k < b.k),
 z as (select *, {_t_as_normal_sql("abs(t)", "df")} z from w) select feature, label1, label2, round(mean1, 4) mean1, round(mean2, 4) mean2, round(t, 5) t, round(2 * ({_above_sql("z")}), 5) p from z""")
def q_feature_pairs(spark, d):
    s = _segments(spark, d).withColumn("root", F.sqrt("price"))
    return tables.feature_pairs(s, "seg", "fin", ["price", "root"]).select("feature", "label1", "label2", F.round("mean1", 4).alias("mean1"), F.round("mean2", 4).alias("mean2"), F.round("t", 5).alias("t"), F.round("p", 5).alias("p"))


@query("q_cartesian", "select p_partkey, [[p_size, 0, p_partkey], [p_size, 1, p_partkey], [p_size + 1, 0, p_partkey], [p_size + 1, 1, p_partkey]] combos from (select p_partkey::bigint p_partkey, p_size::bigint p_size from part)")
def q_cartesian(spark, d):
    p = table(spark, d, "part").selectExpr("cast(p_partkey as long) as p_partkey", "cast(p_size as long) as p_size")
    combos = sequences.cartesian(F.array("p_size", F.col("p_size") + 1), F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), F.array("p_partkey"))
    return p.select("p_partkey", combos.alias("combos"))
