"""SQL with the same results as the registered queries, for a plain database over the same tables."""

from __future__ import annotations

RANK = 8
LINES = "lineitem join orders on l_orderkey = o_orderkey"
A = f"a as (select o_custkey i, l_partkey j, sum(l_quantity) v from {LINES} group by 1, 2)"
SIZE = f"""size as (select max(o_custkey) + 1 as row_count, max(l_partkey) + 1 as col_count from {LINES})"""


def flagged(name: str, flag: str, test: str = "=") -> str:
    return (
        f"{name} as (select o_custkey i, l_partkey j, sum(l_quantity) v from {LINES} "
        f"where l_returnflag {test} '{flag}' group by 1, 2)"
    )


def supply(name: str, column: str) -> str:
    return f"{name} as (select l_suppkey i, cast(l_linenumber as bigint) j, sum({column}) v from lineitem group by 1, 2)"


def uniform(places: str, seed: int) -> str:
    return f"((({places}) + {seed * 104729}) % 1000003) / 1000003.0E0"


def ranks(rank: int) -> str:
    return f"ks as (select unnest(range({rank})) k)"


def start_w(k: str = "k") -> str:
    return f"((i*31 + {k}*17) % 97 + 1) / 97.0E0"


def start_h(k: str = "k") -> str:
    return f"(({k}*13 + j*29) % 89 + 1) / 89.0E0"


def ieee(a: str, b: str) -> str:
    return (
        f"case when {b} <> 0 then {a} / {b} when {a} > 0 then 'Infinity'::double "
        f"when {a} < 0 then '-Infinity'::double else 'NaN'::double end"
    )


def update(name: str, w: str, h: str) -> str:
    """CTEs for one H update; ``name`` becomes the new (k, j, v)."""
    return f"""
{name}x as (select w.k, a.j, sum(w.v*a.v) v from {w} w join a on w.i = a.i group by 1, 2),
{name}g as (select p.k, q.k l, sum(p.v*q.v) v from {w} p join {w} q on p.i = q.i group by 1, 2),
{name}y as (select g.k, h.j, sum(g.v*h.v) v from {name}g g join {h} h on g.l = h.k group by 1, 2),
{name} as (select h.k, h.j, case when h.v * coalesce(x.v, 0) = 0 then 0.0E0 else h.v * x.v / y.v end v
  from {h} h join {name}y y on h.k = y.k and h.j = y.j left join {name}x x on h.k = x.k and h.j = x.j)"""


def update_w(name: str, w: str, h: str) -> str:
    return f"""
{name}x as (select a.i, h.k, sum(a.v*h.v) v from a join {h} h on h.j = a.j group by 1, 2),
{name}g as (select p.k, q.k l, sum(p.v*q.v) v from {h} p join {h} q on p.j = q.j group by 1, 2),
{name}y as (select w.i, g.k, sum(w.v*g.v) v from {w} w join {name}g g on g.l = w.k group by 1, 2),
{name} as (select w.i, w.k, case when w.v * coalesce(x.v, 0) = 0 then 0.0E0 else w.v * x.v / y.v end v
  from {w} w join {name}y y on w.i = y.i and w.k = y.k left join {name}x x on w.i = x.i and w.k = x.k)"""


def dense_starts(rank: int) -> str:
    """The ratings and start factors for all ids up to the largest."""
    return f"""{A}, {ranks(rank)},
w0 as (select i, k, {start_w()} v from (select unnest(range(max(i) + 1)) i from a) cross join ks),
h0 as (select k, j, {start_h()} v from (select unnest(range(max(j) + 1)) j from a) cross join ks)"""


def both(w: str, h: str) -> str:
    return f"""select 'W' as factor, i as id, k, round(v, 6) v from {w}
union all select 'H', j, k, round(v, 6) from {h}"""


def one_pass(rank: int) -> str:
    return f"with {dense_starts(rank)}, {update('h1', 'w0', 'h0')}, {update_w('w1', 'w0', 'h1')} {both('w1', 'h1')}"


TWO_PASSES = f"""with {dense_starts(RANK)},
{update('h1', 'w0', 'h0')}, {update_w('w1', 'w0', 'h1')}, {update('h2', 'w1', 'h1')}, {update_w('w2', 'w1', 'h2')}
{both('w2', 'h2')}"""


# Sample blocks are 128 x 32 over the 64 features.
X = """x as (select vec_id i, generate_subscripts(embedding, 1) - 1 j, cast(unnest(embedding) as double) v
from embeddings)"""
SAMPLE_ROWS = "n as (select max(vec_id) + 1 as row_count from embeddings)"
SAMPLE_BLOCKS = f"""{X}, {SAMPLE_ROWS},
k as (select cast(i // 128 as integer) bi, cast(j // 32 as integer) bj,
  cast(least(128, row_count - (i // 128) * 128) as integer) nr, 32 nc, i, j, v from x, n)"""


def small_blocks(*columns: str) -> str:
    """Dense supplier matrices m0, m1, ... on the whole grid."""
    parts = [supply(f"s{n}", c) for n, c in enumerate(columns)]
    parts.append("i as (select unnest(range((select max(i) + 1 from s0))) i)")
    parts.append("j as (select unnest(range((select max(j) + 1 from s0))) j)")
    for n in range(len(columns)):
        parts.append(
            f"m{n} as (select i.i, j.j, coalesce(s.v, 0.0E0) v from i cross join j "
            f"left join s{n} s on s.i = i.i and s.j = j.j)"
        )
    return ", ".join(parts)


# --- classifier: 64-16-10 with formula weights ---------------------------------------------------

STACK = 48
#: Groups of stacks from which a fit draws.
GROUPS = 8
STEP = "0.5E0"
CELLS = """
cells as (select 1 as layer, o, f, ((o*31 + f*17) % 97 / 97.0E0 * 4.8E0 - 2.4E0) / sqrt(64.0E0) w
    from (select unnest(range(16)) o) cross join (select unnest(range(-1, 64)) f)
  union all
  select 2 as layer, o, f, ((o*29 + f*13) % 89 / 89.0E0 * 4.8E0 - 2.4E0) / sqrt(16.0E0) w
    from (select unnest(range(10)) o) cross join (select unnest(range(-1, 16)) f))"""
INPUTS = f"""{X},
x1 as (select i n, j f, v x from x union all select vec_id, -1, 1.0E0 from embeddings)"""
SHARES = {
    "row": "t as (select vec_id n, label, 1.0E0 share, 1.0E0 * count(*) over () total from embeddings)",
    "stack": f"""t0 as (select vec_id n, label, (row_number() over (order by vec_id) - 1) // {STACK} s from embeddings),
t as (select n, label, 1.0E0 / count(*) over (partition by s) share,
  1.0E0 * (select count(distinct s) from t0) total from t0)""",
}
#: About half of the stacks, by the rule of the first iteration.
SHARES["drawn"] = f"""t1 as (select vec_id n, label, (row_number() over (order by vec_id) - 1) // {STACK} s from embeddings),
t0 as (select * from t1 where ((s * 386117) + {43 * 104729}) % 1000003 / 1000003.0E0 < 0.5E0),
t as (select n, label, 1.0E0 / count(*) over (partition by s) share,
  1.0E0 * (select count(distinct s) from t0) total from t0)"""


def drawn_groups(name: str, iteration: int, groups: int) -> str:
    """Shares of the samples in the groups of stacks that an iteration draws, about half."""
    return f"""{name}0 as (select vec_id n, label, (row_number() over (order by vec_id) - 1) // {STACK} s from embeddings),
{name}1 as (select * from {name}0 where ((s % {groups}) * 386117 + {(42 + iteration) * 104729}) % 1000003 / 1000003.0E0 < 0.5E0),
{name} as (select n, label, 1.0E0 / count(*) over (partition by s) share,
  1.0E0 * (select count(distinct s) from {name}1) total from {name}1)"""


def network(name: str, weights: str, shares: str = "t") -> str:
    """CTEs of one forward and backward pass; ``{name}g`` is the mean gradient (layer, o, f, g)."""
    p = name
    return f"""
{p}u1 as (select n, o, sum(w*x) u from x1 join {weights} c on c.layer = 1 and c.f = x1.f group by 1, 2),
{p}z1 as (select n, o, 1.0E0 / (1.0E0 + exp(-u)) z from {p}u1),
{p}x2 as (select n, o f, z x from {p}z1 union all select vec_id, -1, 1.0E0 from embeddings),
{p}u2 as (select n, o, sum(w*x) u from {p}x2 b join {weights} c on c.layer = 2 and c.f = b.f group by 1, 2),
{p}e as (select n, o, u, exp(u - max(u) over (partition by n)) e, max(u) over (partition by n) m from {p}u2),
{p}p as (select n, o, u, e / sum(e) over (partition by n) p, u - m - ln(sum(e) over (partition by n)) lp from {p}e),
{p}d2 as (select n, o, (p - case when o = label then 1 else 0 end) * share d from {p}p join {shares} t using (n)),
{p}l as (select sum(-lp * share) loss_sum, max(total) n, sum(-lp * share) / max(total) mean_loss
  from {p}p join {shares} t using (n) where o = label),
{p}d1 as (select q.n, q.f o, q.d * (1 - z) * z d from
  (select n, f, sum(w*d) d from {p}d2 d join {weights} c on c.layer = 2 and c.o = d.o and c.f >= 0 group by 1, 2) q
  join {p}z1 z on z.n = q.n and z.o = q.f),
{p}g as (select 1 as layer, d.o, b.f, sum(d*x) / max(total) g from {p}d1 d join x1 b on b.n = d.n join {shares} t on t.n = d.n group by 2, 3
  union all
  select 2 as layer, d.o, b.f, sum(d*x) / max(total) g from {p}d2 d join {p}x2 b on b.n = d.n join {shares} t on t.n = d.n group by 2, 3)"""


def stepped(name: str, weights: str, gradient: str) -> str:
    return f"""{name} as (select c.layer, c.o, c.f, w - {STEP} * g w from {weights} c
  join {gradient} g on g.layer = c.layer and g.o = c.o and g.f = c.f)"""


def group_fit(select: str, steps: int, groups: int) -> str:
    """Steps that each draw groups of stacks anew."""
    ctes, weights = [CELLS, INPUTS], "cells"
    for n in range(steps):
        ctes += [drawn_groups(f"t{n}_", n + 1, groups), network(f"s{n}", weights, f"t{n}_"), stepped(f"w{n + 1}", weights, f"s{n}g")]
        weights = f"w{n + 1}"
    return "with " + ",\n".join([*ctes, f"final_w as (select * from {weights})"]) + "\n" + select


def classifier(select: str, share: str = "row", steps: int = 0) -> str:
    """A query over ``steps`` gradient steps and one more pass on the last weights (named ``last``)."""
    ctes = [CELLS, INPUTS, SHARES[share]]
    weights = "cells"
    for n in range(steps):
        ctes += [network(f"s{n}", weights), stepped(f"w{n + 1}", weights, f"s{n}g")]
        weights = f"w{n + 1}"
    ctes.append(f"final_w as (select * from {weights})")
    if "last" in select:
        ctes.append(network("last", weights))
    return "with " + ",\n".join(ctes) + "\n" + select


WEIGHTS = "select cast(layer as integer) layer, o as out, f as \"in\", round(w, 6) + 0.0E0 w from final_w"
STACKS = f"""with s as (select vec_id, embedding, label, (row_number() over (order by vec_id) - 1) // {STACK} stack_id,
  (row_number() over (order by vec_id) - 1) % {STACK} place from embeddings),
s1 as (select *, cast(count(*) over (partition by stack_id) as integer) n from s),
f as (select *, generate_subscripts(embedding, 1) - 1 f, cast(unnest(embedding) as double) v from s1)"""
LEAST_SQUARES = """lg{n} as (select q.f, sum(q.x * gap.d) / max(gap.total) g from
  (select i n, j f, v x from x) q join
  (select i n, sum(v * w) - any_value(label) d, max(total) total from x join l{p} w on w.f = x.j join t on t.n = x.i group by 1) gap
  on gap.n = q.n group by 1)"""


def linear(*steps: str) -> str:
    ctes = [X, SHARES["row"], "l0 as (select f, f / 64.0E0 w from (select unnest(range(64)) f))"]
    for n, expression in enumerate(steps, start=1):
        ctes.append(LEAST_SQUARES.format(n=n, p=n - 1))
        ctes.append(f"l{n} as (select l.f, {expression} w from l{n - 1} l join lg{n} g on g.f = l.f)")
    return "with " + ",\n".join(ctes) + f"\nselect f, round(w, 6) + 0.0E0 w from l{len(steps)}"


def oracle_sql() -> dict[str, str]:
    return {
        "ratings_entries": f"with {A} select i, j, round(v, 6) v from a",
        "matrix_shape": f'with {SIZE} select row_count as "rows", col_count as "cols" from size',
        "matrix_profile": f"""with {A}, {SIZE},
s as (select row_count r, col_count c, (row_count + 127) // 128 rb, (col_count + 255) // 256 cb, (select count(*) from a) n from size)
select r as "rows", c as "cols", rb as row_blocks, cb as col_blocks, r // rb as block_rows, c // cb as block_cols,
  n as stored from s""",
        "matrix_transpose": f"with {A} select j as i, i as j, round(v, 6) v from a",
        "dense_to_sparse": f"with {supply('a', 'l_quantity')} select i, j, round(v, 6) v from a where v <> 0",
        "sparse_to_dense": f"with {small_blocks('l_quantity')} select i, j, round(v, 6) v from m0",
        "matrix_multiply": f"""with {A}, {ranks(RANK)},
h as (select k, j, {start_h()} v from (select p_partkey j from part) cross join ks)
select a.i, h.k as j, round(sum(a.v * h.v), 6) v from a join h on a.j = h.j group by 1, 2""",
        "gram_matrix": f"""with {ranks(RANK)},
w as (select i, k, {start_w()} v from (select c_custkey i from customer) cross join ks)
select p.k as i, q.k as j, round(sum(p.v * q.v), 6) v from w p join w q on p.i = q.i group by 1, 2""",
        "gram_entry_form": f"""with {supply('a', 'l_discount')}, k as (select unnest(range((select max(j) + 1 from a))) j),
m as (select i, k.j, coalesce(a.v, 0.0E0) v from (select distinct i from a) cross join k left join a using (i, j))
select p.j as i, q.j as j, round(sum(p.v * q.v), 6) v from m p join m q on p.i = q.i group by 1, 2""",
        "elementwise_product": f"""with {A}, {flagged('r', 'R')}
select i, j, round(a.v * r.v, 6) v from a join r using (i, j)""",
        "elementwise_division": f"""with {A}, {flagged('r', 'R')},
q as (select i, j, a.v p, coalesce(r.v, 0.0E0) q from a left join r using (i, j))
select i, j, round({ieee('p', 'q')}, 6) v from q""",
        "multiply_divide": f"""with {A}, {flagged('r', 'R')},
c as (select o_custkey i, l_partkey j, sum(l_extendedprice / 1000.0E0) v from {LINES} group by 1, 2),
q as (select i, j, a.v * coalesce(r.v, 0.0E0) p, c.v q from a left join r using (i, j) left join c using (i, j))
select i, j, round(case when p = 0 then 0.0E0 else p / q end, 6) v from q""",
        "matrix_cogroup": f"""with {flagged('p', 'R')}, {flagged('q', 'R', '<>')}
select i, j, round(p.v, 6) a, round(q.v, 6) b from p full join q using (i, j)""",
        "matrix_cogroup3": f"""with {flagged('p', 'R')}, {flagged('q', 'A')}, {flagged('s', 'N')},
pq as (select i, j, p.v a, q.v b from p full join q using (i, j))
select i, j, round(a, 6) a, round(b, 6) b, round(s.v, 6) c from pq full join s using (i, j)""",
        "to_blocks": f"""with {SAMPLE_BLOCKS}
select bi, bj, nr, nc, cast((j % 32) * nr + i % 128 as integer) pos, round(v, 6) + 0.0E0 v from k""",
        "from_blocks": f"with {X} select i, j, round(v, 6) + 0.0E0 v from x",
        "keyed_blocks": f"with {X} select i, j, round(v, 6) + 0.0E0 v from x",
        "block_transpose": f"with {X} select j as i, i as j, round(v, 6) + 0.0E0 v from x",
        "block_multiply": f"""with {X}, {CELLS}
select i, o as j, round(sum(v * w), 6) + 0.0E0 v from x join cells on layer = 1 and f = x.j group by 1, 2""",
        "sparse_blocks": f"""with {A}, {SIZE}
select cast(i // 512 as integer) bi, cast(j // 1024 as integer) bj,
  cast(least(512, row_count - (i // 512) * 512) as integer) nr, cast(least(1024, col_count - (j // 1024) * 1024) as integer) nc,
  cast(j % 1024 as integer) as col, cast(i % 512 as integer) as "row", v from a, size""",
        "block_sparse_multiply": f"""with {A}, {ranks(RANK)},
h as (select k, j, {start_h()} v from (select distinct j from a) cross join ks)
select a.i, h.k, round(sum(a.v * h.v), 6) v from a join h on a.j = h.j group by 1, 2""",
        "block_sparse_project": f"""with {A}, {ranks(RANK)},
w as (select i, k, {start_w()} v from (select distinct i from a) cross join ks)
select a.j, w.k, round(sum(a.v * w.v), 6) v from a join w on a.i = w.i group by 1, 2""",
        "block_gram": f"""with {X}
select p.j as i, q.j as j, round(sum(p.v * q.v), 6) + 0.0E0 v from x p join x q on p.i = q.i group by 1, 2""",
        "gram_large_rank": f"""with {X}
select p.j as i, q.j as j, round(sum(p.v * q.v), 6) + 0.0E0 v from x p join x q on p.i = q.i group by 1, 2""",
        "gram_apply": f"""with {X}, g as (select p.j as a, q.j as b, sum(p.v * q.v) v from x p join x q on p.i = q.i group by 1, 2)
select x.i, g.b as j, round(sum(x.v * g.v), 4) + 0.0E0 v from x join g on x.j = g.a group by 1, 2""",
        "block_product": f"""with {small_blocks('l_quantity', 'l_discount')}
select i, j, round(m0.v * m1.v, 6) v from m0 join m1 using (i, j)""",
        "block_division": f"""with {small_blocks('l_extendedprice', 'l_quantity')}
select i, j, round(case when m0.v = 0 and m1.v = 0 then -1.0E0 else {ieee('m0.v', 'm1.v')} end, 6) v
from m0 join m1 using (i, j)""",
        "block_multiply_divide": f"""with {small_blocks('l_quantity', 'l_discount', 'l_tax')},
q as (select i, j, m0.v * m1.v p, m2.v q from m0 join m1 using (i, j) join m2 using (i, j))
select i, j, round(case when p = 0 then 0.0E0 else {ieee('p', 'q')} end, 6) v from q""",
        "block_profile": """with s as (select max(l_suppkey) + 1 r, cast(max(l_linenumber) + 1 as bigint) c from lineitem),
b as (select r, c, (r + 47) // 48 rb, (c + 2) // 3 cb from s)
select r as "rows", c as "cols", rb as row_blocks, cb as col_blocks, r // rb as block_rows, c // cb as block_cols,
  r * c as stored from b""",
        "block_validate": f"""with {SAMPLE_BLOCKS},
b as (select bi, bj, nr * nc as n, max(bi) over () as last from k group by bi, bj, nr, nc),
m as (select bi, bj, case when bi = last then bi + 7 else bi end as place, last, case when bi % 3 = 1 then n - 1 else n end as stored,
  bi % 3 = 1 as cut from b),
c as (select *, case when place % 2 = 0 and bj = 0 then 2 else 1 end as copies from m)
select 'duplicate block' as rule, cast(place as integer) bi, bj, cast(copies as bigint) detail from c where copies > 1
union all select 'block outside the grid', cast(place as integer), bj, cast(copies as bigint) from c where place > last
union all select 'wrong block size', cast(place as integer), bj, cast(stored as bigint) from c where place <= last and cut""",
        "block_grid": f"""with {SIZE}
select cast(bi as integer) bi, cast(bj as integer) bj from
  (select unnest(range((row_count + 127) // 128)) bi from size) cross join (select unnest(range((col_count + 255) // 256)) bj from size)""",
        "grid_placement": f"""with {SAMPLE_ROWS}, g as (select (row_count + 127) // 128 r, 2 c from n),
p as (select r, c, cast(floor(greatest(0.5E0 * r, 1.0E0) + 0.5E0) as bigint) rp,
  cast(floor(greatest(0.5E0 * c, 1.0E0) + 0.5E0) as bigint) cp from g)
select cast(bi as integer) bi, cast(bj as integer) bj, cast(bi // rp + bj // cp * ((r + rp - 1) // rp) as integer) part
from p, (select unnest(range((select r from g))) bi), (select unnest(range(2)) bj)""",
        "factor_init": f"""with {A}, {ranks(RANK)}
select i, k as j, round({start_w()}, 6) v from (select distinct i from a) cross join ks""",
        "random_factor": f"""with {A}, {ranks(RANK)}
select i, k as j, round({uniform('i * 386117 + k * 50021', 7)}, 6) v from (select distinct i from a) cross join ks""",
        "random_blocks": """with s as (select max(l_suppkey) + 1 r, max(l_linenumber) + 1 c from lineitem),
i as (select unnest(range(r)) i from s), j as (select unnest(range(cast(c as bigint))) j from s)
select i, j, round(""" + uniform("i * 386117 + j * 50021", 7) + """, 6) v from i cross join j""",
        "nmf_update_h": f"""with {A}, {ranks(RANK)},
w0 as (select i, k, {start_w()} v from (select distinct i from a) cross join ks),
h0 as (select k, j, {start_h()} v from (select distinct j from a) cross join ks),
{update('h1', 'w0', 'h0')}
select k, j, round(v, 6) v from h1""",
        "nmf_update_w": f"""with {A}, {ranks(RANK)},
w0 as (select i, k, {start_w()} v from (select distinct i from a) cross join ks),
h0 as (select k, j, {start_h()} v from (select distinct j from a) cross join ks),
{update_w('w1', 'w0', 'h0')}
select i, k, round(v, 6) v from w1""",
        "nmf_fit_2iter": TWO_PASSES,
        "nmf_fit_resumed": TWO_PASSES,
        "nmf_fit_rank16": one_pass(16),
        "nmf_fit_hot": one_pass(RANK),
        "nmf_fit_occurring": f"""with a as (select o_custkey * 1000000007 + 5 i, l_partkey * 70001 j, sum(l_quantity) v from {LINES} group by 1, 2),
{ranks(RANK)}, ids as (select i, dense_rank() over (order by i) - 1 n from (select distinct i from a)),
jds as (select j, dense_rank() over (order by j) - 1 n from (select distinct j from a)),
w0 as (select i, k, {uniform("n * 386117 + k * 50021", 11)} v from ids cross join ks),
h0 as (select k, j, {uniform("n * 386117 + k * 50021", 12)} v from jds cross join ks),
{update('h1', 'w0', 'h0')}, {update_w('w1', 'w0', 'h1')}
{both('w1', 'h1')}""",
        "nmf_objective": f"""with {dense_starts(RANK)},
p as (select w.i, h.j, sum(w.v * h.v) v from w0 w join h0 h on w.k = h.k group by 1, 2),
d as (select coalesce(a.v, 0.0E0) - p.v d from p left join a on a.i = p.i and a.j = p.j)
select round(sum(d * d) / 1.0E6, 3) error from d""",
        "fit_summary": f"""with {A}, s as (select max(i) + 1 m, max(j) + 1 n, count(*) c from a),
p as (select 'A' as matrix, m r, n c, c as stored from s union all select 'W', m, {RANK}, m * {RANK} from s
  union all select 'H', {RANK}, n, n * {RANK} from s),
b as (select *, (r + 511) // 512 rb, (c + 1023) // 1024 cb from p)
select matrix, cast(r as bigint) as "rows", cast(c as bigint) as "cols", cast(rb as bigint) as row_blocks, cast(cb as bigint) as col_blocks,
  cast(r // rb as bigint) as block_rows, cast(c // cb as bigint) as block_cols, cast(stored as bigint) as stored from b""",
        "one_hot_labels": """select vec_id, cast(k as integer) k, case when k = label then 1.0E0 else 0.0E0 end t
from embeddings cross join (select unnest(range(10)) k)""",
        "argmax_label": f"""with {X}, p as (select i, v, j, row_number() over (partition by i order by v desc, j) r from x)
select vec_id, cast(label as double) decoded, cast(j as double) peak from embeddings join p on p.i = vec_id and r = 1""",
        "topology_layout": """with s as (select cast(max(len(embedding)) as bigint) d, cast(max(label) + 1 as bigint) c from embeddings)
select 1 as layer, d as n_in, cast(16 as bigint) as n_out, d * 16 + 16 as size, cast(0 as bigint) as first from s
union all select 2, 16, c, 16 * c + c, d * 16 + 16 from s""",
        "weight_init": """with s as (select cast(max(len(embedding)) as bigint) d, cast(max(label) + 1 as bigint) c from embeddings),
l as (select 1 as layer, d as n_in, cast(16 as bigint) as n_out, cast(0 as bigint) as first from s
  union all select 2, 16, c, d * 16 + 16 from s),
p as (select layer, n_in, n_out, first, unnest(range(n_in * n_out + n_out)) place from l)
select first + place as pos, layer, place % n_out as out, case when place // n_out = n_in then -1 else place // n_out end as "in",
  round((""" + uniform("(first + place) * 386117", 11) + """ * 4.8E0 - 2.4E0) / sqrt(n_in), 6) + 0.0E0 w from p""",
        "stack_rows": f"""{STACKS}
select stack_id, n, 'input' as part, cast(place * 64 + f as integer) pos, round(v, 6) + 0.0E0 v from f
union all select stack_id, n, 'target', cast(place * 10 + k as integer), case when k = label then 1.0E0 else 0.0E0 end
from s1 cross join (select unnest(range(10)) k)""",
        "unstack_rows": f"""{STACKS}
select stack_id, cast(place as integer) stack_pos, cast(label as double) label, cast(f as integer) f, round(v, 6) + 0.0E0 v from f""",
        "mlp_affine": classifier("select n as i, o as j, round(u, 6) + 0.0E0 v from lastu1"),
        "mlp_sigmoid": classifier("select n as i, o as j, round(z, 6) v from lastz1"),
        "mlp_forward": classifier("select n as i, o as j, round(u, 6) + 0.0E0 v from lastu2"),
        "mlp_softmax": classifier("select n as i, o as j, round(p, 6) p from lastp"),
        "mlp_loss": classifier(
            "select round(loss_sum, 6) loss_sum, cast(n as bigint) n, round(mean_loss, 6) mean_loss from lastl"
        ),
        "mlp_delta": classifier(
            "select 1 as layer, n as i, o as j, round(d, 6) + 0.0E0 v from lastd1 "
            "union all select 2, n, o, round(d, 6) + 0.0E0 from lastd2"
        ),
        "mlp_gradient": classifier(
            'select layer, o as out, f as "in", round(g, 6) + 0.0E0 g from lastg'
        ),
        "mlp_gradient_blocked": classifier(
            'select layer, o as out, f as "in", round(g, 6) + 0.0E0 g from lastg', "stack"
        ),
        "mlp_sgd_step": classifier(WEIGHTS, "stack", 1),
        "mlp_sgd_fit_2iter": classifier(WEIGHTS, "stack", 2),
        "mlp_sgd_fraction_step": classifier(WEIGHTS, "drawn", 1),
        "mlp_sgd_fraction_fit": group_fit(WEIGHTS, 3, GROUPS),
        "mlp_sgd_row_fit_2iter": classifier(WEIGHTS, "row", 2),
        "mlp_relational_fit_2iter": classifier(WEIGHTS, "row", 2),
        "mlp_relational_fraction_step": classifier(WEIGHTS, "drawn", 1),
        "mlp_blocked_sgd_fit": classifier(WEIGHTS, "stack", 2),
        "lbfgs_relational": f"with {X} select j as f, round(avg(v), 4) + 0.0E0 w from x group by 1",
        "loss_history": classifier(
            "select 1 as iteration, round(loss_sum, 6) loss_sum, round(n, 6) n, round(mean_loss, 6) mean_loss from s0l "
            "union all select 2, round(loss_sum, 6), round(n, 6), round(mean_loss, 6) from s1l",
            "stack", 2,
        ),
        "weight_norm": classifier(
            "select round(sqrt(sum((a.w - b.w) * (a.w - b.w))), 6) change, round(sqrt(sum(b.w * b.w)), 6) as size, "
            "sqrt(sum((a.w - b.w) * (a.w - b.w))) < 1e-3 * greatest(sqrt(sum(b.w * b.w)), 1.0E0) converged "
            "from cells a join w1 b on a.layer = b.layer and a.o = b.o and a.f = b.f",
            "stack", 1,
        ),
        "mlp_raw_scores": classifier("select n as vec_id, cast(o as integer) k, round(u, 6) + 0.0E0 v from lastu2"),
        "mlp_probability": classifier("select n as vec_id, cast(o as integer) k, round(p, 6) p from lastp"),
        "mlp_predict": classifier(
            "select vec_id, label, cast(o as double) prediction from embeddings join "
            "(select n, o, row_number() over (partition by n order by u desc, o) r from lastu2) q on q.n = vec_id and r = 1"
        ),
        "mlp_blocked_predict": classifier(
            "select n as vec_id, cast(o as double) prediction from "
            "(select n, o, row_number() over (partition by n order by u desc, o) r from lastu2) q where r = 1"
        ),
        "mlp_predict_relational": classifier(
            "select n as i, cast(o as double) prediction from "
            "(select n, o, row_number() over (partition by n order by u desc, o) r from lastu2) q where r = 1"
        ),
        "mlp_accuracy": classifier(
            "select count(*) n, round(avg(case when o = label then 1.0E0 else 0.0E0 end), 6) accuracy from embeddings join "
            "(select n, o, row_number() over (partition by n order by u desc, o) r from lastu2) q on q.n = vec_id and r = 1"
        ),
        "train_accuracy": classifier(
            "select count(*) n, round(avg(case when o = label then 1.0E0 else 0.0E0 end), 6) train_accuracy from embeddings join "
            "(select n, o, row_number() over (partition by n order by u desc, o) r from lastu2) q on q.n = vec_id and r = 1",
            "stack", 2,
        ),
        "hash_sample": "select vec_id from embeddings where (vec_id % 1000003 * 7919 + 43 * 104729) % 1000003 / 1000003.0E0 < 0.3E0",
        "lbfgs_least_squares": """with s as (select cast(embedding[1] as double) x, cast(label as double) y from embeddings)
select cast(0 as bigint) f, round(regr_slope(y, x), 4) + 0.0E0 w from s
union all select cast(1 as bigint), round(regr_intercept(y, x), 4) + 0.0E0 from s""",
        "custom_gradient": linear("l.w - 0.5E0 * g.g", "l.w - 0.5E0 * g.g"),
        "custom_updater": linear(
            "l.w * (1 - 0.5E0 * 0.1E0) - 0.5E0 * g.g",
            "l.w * (1 - 0.5E0 / sqrt(2.0E0) * 0.1E0) - 0.5E0 / sqrt(2.0E0) * g.g",
        ),
        "csv_roundtrip": f"with {A} select i, j, round(v, 6) v from a",
        "libsvm_roundtrip": f"""with {X}
select cast(label as double) label, cast(j as integer) f, count(*) n, round(sum(v), 6) + 0.0E0 x
from x join embeddings on vec_id = i group by 1, 2""",
    }
