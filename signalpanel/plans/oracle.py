"""DuckDB SQL for the correctness gate: for each registered query the same
result written independently in plain SQL over the driver tables (the
fixture views of FIXTURES.md part B are inlined as CTEs). Doubles are
rounded to 6 decimals in both engines by the query wrappers."""

from __future__ import annotations

import math

from ..config import threshold_grid

R = 6  # decimals


def rnd(expr: str) -> str:
    return f"(round(cast({expr} as double), {R}) + 0.0e0)"


# ---------------------------------------------------------------- fixtures
B1_BASE = """
b1_ev as (select *, floor((day(ts) - 1) / 10) as blk from events),
b1 as (
  select concat(case when user_id % 3 = 0 then 'C' else 'P' end,
                lpad(cast(user_id as varchar), 5, '0')) as subject_id,
         cast(blk * 10 as int) as win_from,
         cast(blk * 10 + 10 as int) as win_to,
         cast(row_number() over (partition by user_id, blk order by ts, event_id) - 1 as int) as frame_idx,
         event_id, user_id,
         value as d_value,
         cast(json_extract_string(props, '$.k') as double) as d_k,
         case when event_type = 'signup' and value > 250 then 2
              when user_id % 3 <> 0 and event_type = 'error' and value > 150 then 1 else 0 end as lab_a,
         case when user_id % 3 <> 0 and event_type = 'purchase' and value > 120 then 1 else 0 end as lab_b,
         case when user_id % 3 <> 0 and event_type = 'click' and value > 200 then 1 else 0 end as lab_c
  from b1_ev)"""

B3_BASE = """
b3 as (
  select doc_id,
         concat(case when (doc_id // 10) % 4 = 0 then 'C' else 'P' end,
                lpad(cast(doc_id // 10 as varchar), 6, '0')) as subject_id,
         label,
         cast(case when (doc_id // 10) % 4 = 0 then 0
                   when label = 'low' then 1 - quality else toxic end as int) as y,
         cast(((doc_id // 10) % 3) as int) as fold
  from labels cross join (values ('low'), ('toxic')) l(label)),
b3s as (select *, 0.3e0 * y + 0.7e0 * ((doc_id * 37) % 101) / 101.0e0 as p from b3)"""


def b1_frames_cte(variant: str = "plain") -> str:
    """CTE ``fr`` with the B1 frames in one of the fixture variants."""
    if variant == "centred":
        body = ("select subject_id, win_from, win_to, frame_idx, d_value - 50.0e0 as d_value, d_k, "
                "lab_a, lab_b, lab_c from b1")
    else:
        body = "select subject_id, win_from, win_to, frame_idx, d_value, d_k, lab_a, lab_b, lab_c from b1"
    return B1_BASE + f",\nfr as ({body})"


B6_CTE = """
fr as (
  select concat('P', lpad(cast(l_partkey as varchar), 6, '0')) as subject_id,
         0 as win_from, 1 as win_to,
         cast(row_number() over (partition by l_partkey
                                 order by l_shipdate, l_orderkey, l_linenumber) - 1 as int) as frame_idx,
         l_quantity
  from lineitem)"""


# ---------------------------------------------------------------- features
def features_sql(frames_cte: str, channels: list[str], key: list[str], fps: float = 30.0,
                 variant: str = "multilabel") -> str:
    """Per (window, channel) features, written from the definitions: window
    frames for rolling means, a lag self-reference per Higuchi step, an
    explicit DFT over all bins."""
    k = ", ".join(key)
    kq = ", ".join(f"r.{c}" for c in key)
    lf = "\n  union all ".join(
        f"select {k}, frame_idx, '{c}' as channel, cast({c} as double) as x from fr" for c in channels)
    hig_terms = []
    for kk in range(1, 6):
        hig_terms.append(
            f"case when frame_idx // {kk} >= 1 and frame_idx // {kk} <= (n - frame_idx % {kk} - 1) // {kk} - 1 "
            f"then abs(x - lag(x, {kk}) over w) end as t{kk}")
    hig_cols = ",\n         ".join(hig_terms)
    hsums = ",\n         ".join(
        f"sum(case when frame_idx % {kk} = {m} then t{kk} end) as s{kk}_{m}"
        for kk in range(1, 6) for m in range(kk))
    lkc = []
    for kk in range(1, 6):
        parts, cnts = [], []
        for m in range(kk):
            nm = f"((n - {m} - 1) // {kk})"
            parts.append(f"case when {nm} > 1 then coalesce(s{kk}_{m}, 0) * ((n - 1) / ({kk} * {nm} * {kk})) else 0 end")
            cnts.append(f"case when {nm} > 1 then 1 else 0 end")
        lk = f"(case when ({' + '.join(cnts)}) > 0 then ({' + '.join(parts)}) / ({' + '.join(cnts)}) else 0 end)"
        lkc.append(f"ln(case when {lk} <= 1e-12 then 1e-12 else {lk} end) as v{kk}")
    lk_sql = ",\n         ".join(lkc)
    us = [math.log(i) for i in range(1, 6)]
    ub = sum(us) / 5
    den = sum((u - ub) ** 2 for u in us)
    vbar = "(v1 + v2 + v3 + v4 + v5) / 5.0e0"
    num = " + ".join(f"(v{i} - {vbar}) * cast({repr(us[i - 1] - ub)} as double)" for i in range(1, 6))
    pe = " + ".join(
        f"case when c{j} > 0 then (c{j} / (a.n - 2.0e0)) * ln(c{j} / (a.n - 2.0e0) + 1e-10) else 0 end"
        for j in range(8))
    pec = ",\n         ".join(f"sum(case when pe = {j} then 1 else 0 end) as c{j}" for j in range(8))
    hist_h = " + ".join([f"(h{j} / wd / a.n + 1e-6)" for j in range(10)])
    hist_ent = " + ".join(
        f"((h{j} / wd / a.n + 1e-6) / ({hist_h})) * ln((h{j} / wd / a.n + 1e-6) / ({hist_h}))" for j in range(10))
    hcnt = ",\n         ".join(f"sum(case when bin = {j} then 1 else 0 end) as h{j}" for j in range(10))
    d = 1.0 / fps
    zc = ("sum(case when d1 * d0 < 0 then 1 else 0 end) as zero_crossings_delta" if variant == "multilabel"
          else "sum(case when x * lag1 < 0 then 1 else 0 end) as zero_crossings")
    zc_name = "zero_crossings_delta" if variant == "multilabel" else "zero_crossings"
    roll_w = [3, 5, 7] if variant != "subject" else []
    roll_sel = ",\n         ".join(
        f"avg(x) over (partition by {k}, channel order by frame_idx rows between {w // 2} preceding and {w // 2} following) as r{w}"
        for w in roll_w)
    roll_agg = ",\n         ".join(f"avg(r{w}) as mean_w{w}" for w in roll_w)
    roll_out = []
    for w in roll_w:
        if variant == "window":
            roll_out.append(f"{rnd(f'case when a.n >= {w} then mean_w{w} end')} as mean_w{w}")
        else:
            roll_out.append(f"{rnd(f'mean_w{w}')} as mean_w{w}")
    peak_idx = "p.k as fft_peak, " if variant != "multilabel" else ""
    return f"""
with {frames_cte},
lf as ({lf}),
r0 as (
  select *, count(*) over wa as n, min(x) over wa as lo, max(x) over wa as hi
  from lf where x is not null
  window wa as (partition by {k}, channel)),
r1 as (
  select *,
         lag(x, 1) over w as lag1, lag(x, 2) over w as lag2,
         lead(x, 1) over w as lead1, lead(x, 2) over w as lead2,
         {hig_cols}
         {',' if roll_sel else ''}{roll_sel}
  from r0 where n >= 2
  window w as (partition by {k}, channel order by frame_idx)),
r2 as (
  select *, x - lag1 as d0, lag1 - lag2 as d1,
         case when frame_idx = 0 then 0.0e0
              when frame_idx = 1 then abs(x - lag1)
              else abs((x - lag1) - (lag1 - lag2)) end as acc,
         case when lead2 is not null then
              (case when x <= lead1 then 4 else 0 end) + (case when x <= lead2 then 2 else 0 end)
              + (case when lead1 <= lead2 then 1 else 0 end) end as pe,
         least(9, cast(floor((x - (case when lo = hi then lo - 0.5 else lo end))
                  / ((case when lo = hi then hi + 0.5 else hi end) - (case when lo = hi then lo - 0.5 else lo end)) * 10) as int)) as bin
  from r1),
a0 as (
  select {k}, channel, count(*) as n, avg(x) as mean, stddev_pop(x) as std, min(x) as mn, max(x) as mx,
         quantile_cont(x, [0.25, 0.5, 0.75]) as q, var_pop(x) as var, sum(x * x) as energy,
         regr_slope(x, cast(frame_idx as double)) as slope,
         avg(x) as m1, avg(x * x) as m2raw,
         kurtosis_pop(x) as kurt,
         {zc}, sum(acc) as acc_sum,
         {hsums},
         {pec},
         {hcnt}
         {',' if roll_agg else ''}{roll_agg}
  from r2 group by {k}, channel),
mom as (
  select r.{key[0]}, {', '.join(f'r.{c}' for c in key[1:])}{',' if len(key) > 1 else ''} r.channel,
         avg(power(r.x - a.mean, 3)) as mc3, avg(power(r.x - a.mean, 2)) as mc2
  from r2 r join a0 a using ({k}, channel) group by {kq}, r.channel),
dft as (
  select {k}, channel, k, sqrt(power(sum(x * cos(2 * pi() * ((k * frame_idx) % n) / n)), 2)
                             + power(sum(x * sin(2 * pi() * ((k * frame_idx) % n) / n)), 2)) as amp, max(n) as n
  from (select {k}, channel, frame_idx, x, n, unnest(range(1, n // 2 + 1)) as k from r0 where n >= 2)
  group by {k}, channel, k),
peak as (
  select {k}, channel, k, amp, n from (
    select *, row_number() over (partition by {k}, channel order by round(amp, 9) desc, k) as rn from dft)
  where rn = 1),
a1 as (
  select a0.*, (mx - mn) as rng,
         (case when mx = mn then 1.0e0 else mx - mn end) / 10.0e0 as wd,
         {lk_sql}
  from a0)
select {', '.join(f'a.{c}' for c in key)}, a.channel, cast(a.n as int) as n,
       {rnd('a.mean')} as mean, {rnd('a.std')} as std, {rnd('a.mn')} as min, {rnd('a.mx')} as max,
       {rnd('a.q[2]')} as median, {rnd('a.rng')} as range,
       {rnd('coalesce(case when m.mc2 > 0 then m.mc3 / power(m.mc2, 1.5) end, 0)')} as skew,
       {rnd('coalesce(case when m.mc2 > 0 then a.kurt end, 0)')} as kurtosis,
       {rnd('a.energy')} as energy, {rnd('a.slope')} as slope, {rnd('a.q[3] - a.q[1]')} as iqr,
       {rnd('-(' + hist_ent + ')')} as entropy, {rnd('a.var')} as var,
       {peak_idx}{rnd(f'case when 2 * p.k = p.n then -(p.n // 2) * (1.0e0 / (p.n * {d!r})) else p.k * (1.0e0 / (p.n * {d!r})) end')} as fft_peak_freq,
       {rnd('p.amp')} as fft_peak_amp,
       cast(a.{zc_name} as bigint) as {zc_name},
       {rnd('a.acc_sum / a.n')} as abs_accel_mean,
       {rnd(f'case when a.n < 6 then 0 else -(({num}) / {den!r}) end')} as higuchi_fd,
       {rnd(f'case when a.n < 3 then 0 else -({pe}) end')} as perm_entropy
       {',' if roll_out else ''}{', '.join(roll_out)}
from a1 a join mom m using ({k}, channel) left join peak p using ({k}, channel)
"""


def grid_values_sql() -> str:
    g = threshold_grid()
    return ", ".join(f"({i}, {repr(v)})" for i, v in enumerate(g))


B4_CTE = B3_BASE + """,
b4 as (
  select c.scaler, c.model, f.fold, case when b.fold = f.fold then 'test' else 'train' end as part,
         b.subject_id, b.doc_id, b.label, b.y,
         case c.model when 'cfg_a' then b.p when 'cfg_b' then b.p * b.p
              else 1.0e0 - (1.0e0 - b.p) * (1.0e0 - b.p) end as p
  from b3s b
  cross join (values ('StandardScaler', 'cfg_a'), ('MinMaxScaler', 'cfg_b'), ('RobustScaler', 'cfg_c')) c(scaler, model)
  cross join (values (0), (1), (2)) f(fold))"""


def subj_cte(source: str = "b4", by: str = "scaler, model, fold, part", mode: str = "p90") -> str:
    agg = {"p90": "quantile_cont(p, 0.9)", "max": "max(p)",
           "noisy_or": "1.0e0 - product(1.0e0 - least(greatest(p, 1e-6), 1.0e0 - 1e-6))"}[mode]
    return f"""subj as (
  select {by}{',' if by else ''} subject_id, label, round({agg}, 12) as p, cast(max(y) as int) as y,
         starts_with(subject_id, 'C') as is_control
  from {source} group by {by}{',' if by else ''} subject_id, label)"""


def cfg_cte(rows) -> str:
    vals = ", ".join(f"('{r[0]}', {r[1]}, {r[2]!r}, {r[3]}, {r[4]!r}, {r[5]!r}, {r[6]!r})" for r in rows)
    return f"cfg(label, k_best, alpha, fp_max, fpr_target, spec_target, recall_min) as (values {vals})"


def grid_cte() -> str:
    return f"grid(i, t) as (values {grid_values_sql()})"


def naive_counts_cte(src: str = "subj", by: str = "scaler, model, fold", where: str = "part = 'train'") -> str:
    """Confusion counts at every grid point by brute force (rows × grid)."""
    w = f"where {where}" if where else ""
    return f"""cnt as (
  select {by}{',' if by else ''} s.label, g.i, g.t,
         sum(case when y = 1 and p >= g.t then 1 else 0 end) as tp,
         sum(case when y = 0 and p >= g.t then 1 else 0 end) as fp,
         sum(case when y = 1 and p < g.t then 1 else 0 end) as fn,
         sum(case when y = 0 and p < g.t then 1 else 0 end) as tn,
         sum(case when is_control and y = 0 and p >= g.t then 1 else 0 end) as c_fp,
         sum(case when is_control and y = 0 then 1 else 0 end) as c_n,
         sum(case when is_control then 1 else 0 end) as n_ctrl,
         count(distinct y) as ncls
  from {src} s cross join grid g {w}
  group by {by}{',' if by else ''} s.label, g.i, g.t),
rates as (
  select c.*, f.alpha, f.fp_max, f.fpr_target, f.spec_target, f.recall_min,
         tp + fn as P, tn + fp as N,
         case when tp + fn > 0 then tp / (tp + fn) else 0.0e0 end as recall,
         case when tn + fp > 0 then tn / (tn + fp) end as spec,
         case when tn + fp > 0 then fp / (tn + fp) end as fpr,
         case when tp + fn > 0 then fn / (tp + fn) end as fnr,
         case when 2 * tp + fp + fn > 0 then 2.0e0 * tp / (2 * tp + fp + fn) else 0.0e0 end as f1,
         case when c_n > 0 then c_fp / c_n end as c_fpr,
         (fp + fn) / greatest(1, tp + fp + fn + tn) as err,
         (n_ctrl = 0 or (c_fp <= f.fp_max and (c_n = 0 or c_fp / c_n <= f.fpr_target))) as ctrl_ok
  from cnt c join cfg f using (label))"""


B2_CTE = """
b2 as (
  select concat(case when (vec_id // 4) % 4 = 0 then 'C' else 'P' end, lpad(cast(vec_id // 4 as varchar), 5, '0')) as subject_id,
         cast(vec_id % 4 as int) as win_from, cast(vec_id % 4 + 1 as int) as win_to,
         list_transform(embedding, lambda e: cast(e as double)) as x,
         case when (vec_id // 4) % 4 = 0 then 0 else cast(label < 3 as int) end as lo,
         case when (vec_id // 4) % 4 = 0 then 0 else cast(label in (3, 4) as int) end as mid,
         case when (vec_id // 4) % 4 = 0 then 0 else cast(label % 2 = 0 as int) end as even
  from embeddings),
b2s as (select subject_id, cast(max(lo) as int) as lo, cast(max(mid) as int) as mid, cast(max(even) as int) as even
        from b2 group by subject_id),
b2f as (select subject_id,
               cast((row_number() over (order by concat(cast(lo as varchar), cast(mid as varchar), cast(even as varchar)),
                                        md5('42:' || subject_id)) - 1) % 3 as int) as fold
        from b2s)"""


def min_error_ctes(by: list[str], subj: str = "subj", train_where: str = "part = 'train'") -> str:
    """CTEs ``cnt, rates, lv, f, best, base, thr`` — T9 by brute force."""
    b = ", ".join(by)
    return f"""{naive_counts_cte(subj, b, train_where)},
lv(level) as (values (0), (1), (2), (3), (4)),
f as (select r.*, lv.level from rates r cross join lv
      where (lv.level = 4)
         or (lv.level = 3 and (n_ctrl = 0 or c_fp <= fp_max))
         or (lv.level = 2 and (n_ctrl = 0 or c_fp <= fp_max) and (P = 0 or recall >= recall_min))
         or (lv.level = 1 and (n_ctrl = 0 or (c_fp <= fp_max and (c_fpr is null or c_fpr <= fpr_target)))
                          and (P = 0 or recall >= recall_min))
         or (lv.level = 0 and (n_ctrl = 0 or (c_fp <= fp_max and (c_fpr is null or c_fpr <= fpr_target)))
                          and (P = 0 or recall >= recall_min) and (spec is null or spec >= spec_target))),
best as (select * from (select *, row_number() over (partition by {b}, label order by level, err, i) as rk from f)
         where rk = 1),
base as (select {b}, label, count(distinct y) as ncls from {subj} where {train_where} group by all),
thr as (select {b}, label,
               case when base.ncls < 2 then 0.5e0 else coalesce(best.t, 0.5e0) end as threshold,
               case when base.ncls < 2 then 0 else best.level end as relax_level
        from base left join best using ({b}, label))"""
