"""The trainer of plans/boosting.py as SQL, to test it: every round and level is a common table
expression over rows numbered `rid`. Sums are of whole numbers and divisions are those of doubles, so
another engine comes to the same trees."""

from __future__ import annotations

_UNIT = "1048576.0"
#: Gain of each relevance level, from 0.
_GAIN = "[0, 1, 3, 5, 7, 10, 14, 19, 25, 32, 40, 50][case when rnk between 1 and 10 then 12 - rnk when rnk between 11 and 20 then 1 else 0 end + 1]"


def _binary(p: str, r: int) -> str:
    return f"""{p}g{r} as materialized (select rid, cast(round(weight * (label - chance) * {_UNIT}) as bigint) as g, cast(round(weight * chance * (1 - chance) * {_UNIT}) as bigint) as h
  from (select *, 1 / (1 + exp(-score)) as chance from {p}s{r} where not held) c)"""


def _lambdas(p: str, r: int, truncation: int = 20) -> str:
    up = "case when a.gain > b.gain then {} else {} end"
    return f"""{p}o{r} as materialized (select *, row_number() over (partition by yr, type_id order by score desc, to_city) as place,
  row_number() over (partition by yr, type_id order by gain desc, to_city) as ideal from (select *, {_GAIN} as gain from {p}s{r} where not held) x),
{p}i{r} as materialized (select yr, type_id, round(sum(case when ideal <= {truncation} then gain * (1 / log2(ideal + 1.0)) else 0 end), 9) as best from {p}o{r} group by 1, 2),
{p}p{r} as materialized (select a.rid as ra, b.rid as rb, a.gain > b.gain as up, cast(round(moved * chance * {_UNIT}) as bigint) as pull, cast(round(moved * chance * (1 - chance) * {_UNIT}) as bigint) as bend
  from (select a, b, abs((a.gain - b.gain) * (1 / log2(a.place + 1.0) - 1 / log2(b.place + 1.0))) / best as moved, 1 / (1 + exp({up.format('a.score - b.score', 'b.score - a.score')})) as chance
    from {p}o{r} a join {p}o{r} b on a.yr = b.yr and a.type_id = b.type_id and a.place <= {truncation} and b.place > a.place and a.gain <> b.gain
    join {p}i{r} i on i.yr = a.yr and i.type_id = a.type_id where best > 0) z),
{p}g{r} as materialized (select o.rid, cast(coalesce(sum(u.g), 0) as bigint) as g, cast(coalesce(sum(u.h), 0) as bigint) as h from {p}o{r} o left join (
  select ra as rid, case when up then pull else -pull end as g, bend as h from {p}p{r} union all select rb, case when up then -pull else pull end, bend from {p}p{r}) u on u.rid = o.rid group by 1)"""


def boosted(p: str, rows: str, features: list[str], objective: str, rounds: int, depth: int, rate: float = 0.1, bins: int = 16, penalty: float = 1.0, least: float = 1e-3) -> str:
    """Common table expressions that end in {p}s0 .. {p}s<rounds>: the rows with the score of so many trees;
    {p}b<r>_<level> are the best splits. rows: rid, yr, type_id, to_city, held, the features and what the objective reads."""
    columns = ", ".join(f"coalesce(cast({f} as double), 0)" for f in features)
    value = lambda g, h: f"{rate} * (cast({g} as double) / {_UNIT}) / (cast({h} as double) / {_UNIT} + {penalty})"
    share = lambda g, h: f"(cast({g} as double) / {_UNIT}) * (cast({g} as double) / {_UNIT}) / (cast({h} as double) / {_UNIT} + {penalty})"
    out = [
        f"{p}v as materialized (select rid, held, unnest(range({len(features)})) as fi, unnest([{columns}]) as v from {rows})",
        f"""{p}c as materialized (select fi, list_sort(list_distinct(list(v))) as cuts from (select fi, v, row_number() over (partition by fi order by v) as k, count(*) over (partition by fi) as n
  from {p}v where not held) q where k in ({', '.join(f'cast(ceil({j / bins} * n) as bigint)' for j in range(1, bins))}) group by fi)""",
        f"{p}x as materialized (select rid, v.fi, len(list_filter(cuts, lambda c: c < v)) as bin from {p}v v join {p}c c on c.fi = v.fi)",
        f"{p}s0 as materialized (select *, cast(0 as double) as score from {rows})",
    ]
    for r in range(rounds):
        out.append(_binary(p, r) if objective == "binary" else _lambdas(p, r))
        out.append(f"{p}n{r}_0 as (select rid, 1 as node from {rows})")
        values = []
        for d in range(depth):
            at = f"{r}_{d}"
            out.append(f"""{p}h{at} as materialized (select node, fi, bin, sum(sum(g)) over w as gl, sum(sum(h)) over w as hl, sum(sum(g)) over (partition by node, fi) as ga, sum(sum(h)) over (partition by node, fi) as ha
  from {p}n{at} n join {p}g{r} using (rid) join {p}x using (rid) where node is not null group by node, fi, bin window w as (partition by node, fi order by bin rows unbounded preceding))""")
            out.append(f"""{p}b{at} as materialized (select *, row_number() over (partition by node order by gain desc nulls last, fi, bin) as k from (
  select *, case when hl / {_UNIT} >= {least} and (ha - hl) / {_UNIT} >= {least} then {share('gl', 'hl')} + {share('(ga - gl)', '(ha - hl)')} - {share('ga', 'ha')} end as gain from {p}h{at}) s qualify k = 1)""")
            out.append(f"""{p}m{at} as materialized (select n.rid, n.node, b.ga, b.ha, b.gl, b.hl, coalesce(b.gain > 1e-6, false) as splits, x.bin <= b.bin as low
  from {p}n{at} n join {p}b{at} b on b.node = n.node left join {p}x x on x.rid = n.rid and x.fi = b.fi)""")
            out.append(f"{p}n{r}_{d + 1} as (select rid, case when low then 2 * node else 2 * node + 1 end as node from {p}m{at} where splits)")
            values.append(f"select rid, {value('ga', 'ha')} as value from {p}m{at} where not splits")
        values.append(f"select rid, case when low then {value('gl', 'hl')} else {value('(ga - gl)', '(ha - hl)')} end from {p}m{r}_{depth - 1} where splits")
        out.append(f"{p}s{r + 1} as materialized (select s.* exclude (score), s.score + coalesce(u.value, 0) as score from {p}s{r} s left join ({' union all '.join(values)}) u on u.rid = s.rid)")
    return ",\n".join(out)


def splits(p: str, rounds: int, depth: int) -> str:
    """(fi, gain) of every split of the trees."""
    return " union all ".join(f"select fi, gain from {p}b{r}_{d} where gain > 1e-6" for r in range(rounds) for d in range(depth))


def best_round(p: str, rounds: int, patience: int, measure: str) -> str:
    """Expressions that end in {p}best (best): the round kept when training stops after `patience` rounds that
    didn't better the measure, a query over `{s}` that gives one number."""
    taken = " union all ".join(f"select {r} as r, round(({measure.format(s=f'{p}s{r}')}), 9) as m" for r in range(1, rounds + 1))
    return f"""{p}t as materialized (select *, max(m) over (order by r) as top from ({taken}) t),
{p}y as materialized (select r, (select min(z.r) from {p}t z where z.m = a.top) as best from {p}t a),
{p}best as materialized (select best from {p}y where r = coalesce((select min(r) from {p}y where r - best >= {patience}), {rounds}))"""
