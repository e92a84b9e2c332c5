"""SQL of the registered queries, for DuckDB; written independently of the DataFrame operators."""

H1 = "1.2::double as h00, 0.1::double as h01, 5::double as h02, 0.05::double as h10, 90::double as h11, (-3)::double as h12, 0.001::double as h20, 0.002::double as h21, 1::double as h22"
H2 = "1.05::double as h00, 0.02::double as h01, 1::double as h02, 0.01::double as h10, 1.1::double as h11, (-0.5)::double as h12, 0.0005::double as h20, 0.001::double as h21, 1::double as h22"


def _projected(h: str) -> str:
    return f"""(select *, (h00 * x + h01 * y + h02) / (h20 * x + h21 * y + h22) as u, (h10 * x + h11 * y + h12) / (h20 * x + h21 * y + h22) as v
    from (select l_orderkey, l_linenumber, l_suppkey, l_quantity::float::double as x, l_discount::float::double as y, (l_quantity + l_tax)::float::double as dx, (l_discount * 2)::float::double as dy from lineitem), (select {h}))"""


def _errors(h: str) -> str:
    return f"(select *, sqrt((u - dx) * (u - dx) + (v - dy) * (v - dy)) as e from {_projected(h)})"


PIXELS = "px as (select vec_id // 250 as image_id, (vec_id % 250)::int as y, i::int as x, floor(least(255, greatest(0, (embedding[i + 1]::double + 0.5) * 255)))::int as v from embeddings, unnest(range(64)) as t(i))"
BOTH = PIXELS + ", f as (select image_id // 2 as pair_id, y, x, coalesce(max(v) filter (where image_id % 2 = 0), 0) as v1, coalesce(max(case when x >= 12 then v else 0 end) filter (where image_id % 2 = 1), 0) as v2, count(*) as n from px group by 1, 2, 3)"
PAIR = BOTH + ", p as (select pair_id, y, x, v1, v2 from f where n = 2)"
MASKED = PAIR + ", m as (select *, v1 > 5 as m1, v2 > 5 as m2, abs(v1 - v2) as d from p)"


def _blurred(source: str, value: str, image: str = "") -> str:
    by = f"{image}, " if image else ""

    def taps(col: str, axis: str, last: int, other: str) -> str:
        w = f"over (partition by {by}{other} order by {axis})"
        left1, right1 = f"lag({col}, 1) {w}", f"lead({col}, 1) {w}"
        left2, right2 = f"lag({col}, 2) {w}", f"lead({col}, 2) {w}"
        return f"""6 * {col} + 4 * (case when {axis} = 0 then {right1} else {left1} end) + 4 * (case when {axis} = {last} then {left1} else {right1} end)
          + (case when {axis} = 0 then {right2} when {axis} = 1 then {col} else {left2} end) + (case when {axis} = {last} then {left2} when {axis} = {last} - 1 then {col} else {right2} end)"""

    return f"hb as (select *, {taps(value, 'x', 63, 'y')} as hs from {source}), bl as (select *, ((vs + 128) // 256)::int as blur from (select *, {taps('hs', 'y', 249, 'x')} as vs from hb))"


SEAM = (
    MASKED
    + ", "
    + _blurred("m", "d", "pair_id")
    + """, sp as (select pair_id, y, min(x) as xs, max(x) as xe from bl where m1 and m2 group by pair_id, y),
best as (select pair_id, y, xs, xe, bx, bd from (select bl.pair_id as pair_id, bl.y as y, xs, xe, x as bx, blur as bd, row_number() over (partition by bl.pair_id, bl.y order by blur, x) as rn from bl join sp on bl.pair_id = sp.pair_id and bl.y = sp.y where x between xs and xe) where rn = 1),
tot as (select pair_id, count(*) filter (where m1 and m2) as n, (avg(x) filter (where m1) + avg(x) filter (where m2)) / 2 as mid from bl group by pair_id),
sm as (select bl.*, xs, xe, case when n = 0 then (case when mid is null then m1 else x < floor(mid) end) when xe - xs > 5 and x >= xs and x < bx then true else m1 and not m2 end::int as seam from bl left join best on bl.pair_id = best.pair_id and bl.y = best.y join tot on bl.pair_id = tot.pair_id)"""
)

QUADS = """q as (select vec_id * 8 + j as quad_id, vec_id % 10 as camera_id, k, embedding[8 * j + 2 * k + 1]::double * 1000 as x, embedding[8 * j + 2 * k + 2]::double * 1000 as y
from embeddings, unnest(range(8)) as a(j), unnest(range(4)) as b(k))"""
NORMAL = """st as (select *, first_value(k) over (partition by quad_id order by y, x, k) as s from q),
ro as (select *, (k - s + 4) % 4 as pos from st),
pv as (select quad_id, any_value(camera_id) as camera_id, max(x) filter (where pos = 0) as x0, max(y) filter (where pos = 0) as y0, max(x) filter (where pos = 1) as x1, max(y) filter (where pos = 1) as y1 from ro group by quad_id),
nq as (select ro.quad_id as quad_id, ro.camera_id as camera_id, pos, (x - x0) * cos(-t) - (y - y0) * sin(-t) as nx, (x - x0) * sin(-t) + (y - y0) * cos(-t) as ny from ro join (select *, atan2(y1 - y0, x1 - x0) as t from pv) pv on ro.quad_id = pv.quad_id)"""
METRIC = "me as (select quad_id, camera_id, sum(case pos when 1 then sqrt((nx - 100) * (nx - 100) + (ny - 100) * (ny - 100)) when 2 then sqrt((nx - 100) * (nx - 100) + ny * ny) else 0 end) + 100 as e from nq group by quad_id, camera_id)"
MOVED = f"qh as (select quad_id, camera_id, k, ((h00 * fx + h01 * fy + h02) / w)::float::double as x, ((h10 * fx + h11 * fy + h12) / w)::float::double as y from (select *, h20 * fx + h21 * fy + h22 as w from (select *, x::float::double as fx, y::float::double as fy from q), (select {H2})))"

ROLES = "r as (select * from (values ('optimization', [1, 5, 9, 9, 13, 40]), ('anchor', [2, 4, 4, 31]), ('reprojection', [2, 31])) t(role, ids)), rr as (select role, (i - 1)::int as pos, ids[i]::bigint as idx from r, unnest(range(1, len(ids) + 1)) as t(i))"
RESULTS = "res as (select 'camera' || (p_partkey % 5)::varchar as camera_id, p_partkey as trial_id, p_partkey % 7 <> 0 as success, case when p_partkey % 7 <> 0 then (p_size + 1)::double end as initial_error, case when p_partkey % 7 <> 0 then (p_size + 1)::double * (p_partkey % 11) / 10 end as optimized_error from part)"

BEST = f"{RESULTS}, top as (select * from (select *, row_number() over (partition by camera_id order by optimized_error, trial_id) as rn from res where success) where rn = 1)"
RECORDS = "rec as (select s_nationkey as experiment, s_suppkey, 'camera' || s_suppkey as camera_id, (s_suppkey % 9 + 1)::double as i, (s_suppkey % 9 + 1)::double * (s_suppkey % 5) / 4 as o from supplier)"
CORNERS = f"{QUADS}, c as (select quad_id, {', '.join(f'max({a}) filter (where k = {k}) as {a}{k}' for a in 'xy' for k in range(4))} from q group by quad_id)"
TURNS = [f"(x{(i + 1) % 4} - x{i}) * (y{(i + 2) % 4} - y{(i + 1) % 4}) - (y{(i + 1) % 4} - y{i}) * (x{(i + 2) % 4} - x{(i + 1) % 4})" for i in range(4)]
HIT = "hit as (select distinct s_suppkey % 8 as image_id, s_suppkey * 13 % 250 + i as y, s_suppkey * 7 % 64 + j as x from supplier, unnest(range(-6, 7)) as a(i), unnest(range(-6, 7)) as b(j) where i * i + j * j <= 36)"

CANDIDATES = f"cd as (select c + 2 as candidate, {', '.join(f'{n} * (1 + c * 0.004 * {i + 1}) as p{i}' for i, n in enumerate(('h00', 'h01', 'h02', 'h10', 'h11', 'h12', 'h20', 'h21')))} from unnest(range(-2, 3)) as t(c), (select {H2}))"


def _drawn(key: str) -> str:
    return f"(('0x' || substr(md5('42:' || {key}), 1, 8))::bigint / 4294967296.0::double)"


# The homography of q31 has 1.1, 0.05, 3, -0.02, 0.9, 2, 0.0001, 0, 1; places are told by the minors of that matrix.
WARPED = """src as (select image_id, y, x, (0.9 * x - 0.05 * y + (0.05 * 2 - 3 * 0.9)) as nu, ((0.02 + 2 * 0.0001) * x + (1.1 - 3 * 0.0001) * y + (3 * -0.02 - 1.1 * 2)) as nv, ((-0.02 * 0 - 0.9 * 0.0001) * x + 0.05 * 0.0001 * y + (1.1 * 0.9 + 0.05 * 0.02)) as w
  from (select distinct image_id from px), unnest(range(240)) as a(y), unnest(range(80)) as b(x)),
o as (select image_id, y::int as y, x::int as x, floor(nv / w)::bigint as i, floor(nu / w)::bigint as j, nv / w - floor(nv / w) as a, nu / w - floor(nu / w) as b from src)""".replace("select image_id, y, x, (", "select image_id, y::double as y, x::double as x, (")


def _multiband(levels: int = 5) -> str:
    """Levels g0 to g4 by joins of each output place with its two neighbours, then the bands from the last to the first."""
    values = ["v1", "v2", "m"]
    steps = [SEAM, "s0 as (select pair_id, max(y) + 1 as h, max(x) + 1 as w from sm group by 1)", "g0 as materialized (select pair_id, y, x, v1::double as v1, v2::double as v2, seam::double as m from sm)"]

    def resized(name: str, source: str, axis: str, other: str, size: str, to: str, at: str, cols: list) -> str:
        """size and to: columns of the table `at` with the lengths along the axis before and after."""
        mixed = ", ".join(f"a.{c} * (1 - t) + b.{c} * t as {c}" for c in cols)
        grid = f"(select pair_id, k, least(floor(p), greatest(m - 2, 0))::bigint as i, p - least(floor(p), greatest(m - 2, 0)) as t, m from (select pair_id, k, m, greatest(0.0::double, least(m - 1.0::double, (k + 0.5::double) * m / n - 0.5::double)) as p from (select pair_id, {size} as m, {to} as n, unnest(range({to})) as k from {at})))"
        return f"{name} as materialized (select a.pair_id as pair_id, k as {axis}, a.{other} as {other}, {mixed} from {grid} g join {source} a on a.pair_id = g.pair_id and a.{axis} = i join {source} b on b.pair_id = g.pair_id and b.{axis} = least(i + 1, g.m - 1) and b.{other} = a.{other})"

    def blurred(name: str, source: str, axis: str, other: str) -> str:
        w = f"over (partition by pair_id, {other} order by {axis})"

        def tap(c: str) -> str:
            at = lambda f, n: f"{f}({c}, {n}) {w}"
            one = f"coalesce({at('lag', 1)}, {at('lead', 1)}, {c}) + coalesce({at('lead', 1)}, {at('lag', 1)}, {c})"
            two = f"coalesce({at('lag', 2)}, case when {at('lag', 1)} is null then {at('lead', 2)} end, {c}) + coalesce({at('lead', 2)}, case when {at('lead', 1)} is null then {at('lag', 2)} end, {c})"
            return f"({c} * 6 + ({one}) * 4 + ({two})) / 16 as {c}"

        return f"{name} as (select pair_id, y, x, {', '.join(map(tap, values))} from {source})"

    for i in range(levels - 1):
        steps.append(f"s{i + 1} as (select pair_id, h // 2 as h, w // 2 as w, h as ph, w as pw from s{i} where h > 1 and w > 1)")
        steps += [blurred(f"bx{i}", f"g{i}", "x", "y"), resized(f"rx{i}", f"bx{i}", "x", "y", "pw", "w", f"s{i + 1}", values)]
        steps += [blurred(f"by{i}", f"rx{i}", "y", "x"), resized(f"g{i + 1}", f"by{i}", "y", "x", "ph", "h", f"s{i + 1}", values)]
    last = levels - 1
    steps.append(f"o{last} as (select *, v1 * (1 - m) + v2 * m as o from g{last})")
    for i in range(last - 1, -1, -1):
        steps += [resized(f"ux{i}", f"o{i + 1}", "x", "y", "w", "pw", f"s{i + 1}", ["v1", "v2", "o"]), resized(f"u{i}", f"ux{i}", "y", "x", "h", "ph", f"s{i + 1}", ["v1", "v2", "o"])]
        steps.append(f"o{i} as materialized (select g.*, coalesce(u.o, 0) + ((g.v1 - coalesce(u.v1, 0)) * (1 - m) + (g.v2 - coalesce(u.v2, 0)) * m) as o from g{i} g left join u{i} u on g.pair_id = u.pair_id and g.y = u.y and g.x = u.x)")
    return f"with {', '.join(steps)} select pair_id, y::int as y, x::int as x, (case when v1 > 10 and v2 > 10 then floor(least(255, greatest(0, o))) when v1 > 10 then v1 when v2 > 10 then v2 else 0 end)::int as v from o0"


ORACLES = {
    "q01_project_points": f"select l_orderkey, l_linenumber, round(u, 6) + 0.0 as u, round(v, 6) + 0.0 as v from {_projected(H1)}",
    "q02_reprojection_mean": f"select l_suppkey as camera_id, round(avg(e), 6) as mean_error, count(*) as n from {_errors(H1)} group by 1",
    "q03_angle": "select l_orderkey, l_linenumber, round(degrees(acos(greatest(-1, least(1, (l_quantity * l_tax + l_discount * 3) / nullif(sqrt(l_quantity * l_quantity + l_discount * l_discount) * sqrt(l_tax * l_tax + 9), 0))))), 6) as angle from lineitem",
    "q04_improvement": f"with a as (select l_suppkey, avg(e) as i from {_errors(H1)} group by 1), b as (select l_suppkey, avg(e) as o from {_errors(H2)} group by 1) select a.l_suppkey as camera_id, round(i - o, 6) as improvement, round(case when i > 0 then (i - o) / i * 100 else 0 end, 6) as improvement_percent from a join b using (l_suppkey)",
    "q05_gather_roles": f"with {ROLES} select role, pos, idx, p_size::double as src_x, p_retailprice as src_y from rr join part on p_partkey = idx",
    "q06_holdout_anti": f"with {ROLES} select p_partkey as idx, p_size::double as src_x, p_retailprice as src_y from part where p_partkey not in (select idx from rr where role = 'optimization')",
    "q07_sort_corners": f"""with {QUADS}, c as (select *, x < avg(x) over w as l, atan2(y - avg(y) over w, x - avg(x) over w) as a from q window w as (partition by quad_id)),
n as (select *, count(*) filter (where l) over (partition by quad_id) as nl, row_number() over (partition by quad_id, l order by y, k) as rs, row_number() over (partition by quad_id order by a, k) as ra from c)
select quad_id, (case when nl = 2 then (case when l and rs = 1 then 0 when rs = 1 then 1 when l then 3 else 2 end) else ra - 1 end)::int as pos, round(x, 6) as x, round(y, 6) as y from n""",
    "q08_normalize_quad": f"with {QUADS}, {NORMAL} select quad_id, pos::int as pos, round(nx, 6) + 0.0 as x, round(ny, 6) + 0.0 as y from nq",
    "q09_square_metric": f"with {QUADS}, {NORMAL}, {METRIC} select quad_id, round(e, 6) as metric from me",
    "q10_total_metric": f"with {QUADS}, {NORMAL}, {METRIC} select camera_id, round(sum(e), 4) as total, count(*) as n from me group by 1",
    "q11_objective": f"""with {QUADS}, {MOVED}, {NORMAL.replace('from q)', 'from qh)')}, {METRIC},
an as (select p_partkey % 10 as camera_id, sum(sqrt(pow((h00 * p_size + h01 * p_retailprice + h02) / w - p_size * 2, 2) + pow((h10 * p_size + h11 * p_retailprice + h12) / w - p_retailprice, 2))) as s from (select *, h20 * p_size + h21 * p_retailprice + h22 as w from part, (select {H2})) group by 1)
select camera_id, round(sum(e) + 0.3 * any_value(s), 4) as objective from me join an using (camera_id) group by 1""",
    "q12_raster": f"with {PIXELS} select image_id::int as image_id, y, x, v from px",
    "q13_threshold_mask": f"with {PIXELS} select image_id::int as image_id, y, x, (case when v > 140 then 0 else 255 end)::int as t, v > 10 as above_10, v > 5 as above_5, v > 0 as above_0 from px",
    "q14_blur": f"with {PIXELS}, {_blurred('px', 'v', 'image_id')} select image_id::int as image_id, y, x, blur from bl",
    "q15_absdiff_overlap": f"with {MASKED} select pair_id, y, x, d as diff, m1 and m2 as overlap, m1 and not m2 as only1, m2 and not m1 as only2 from m",
    "q16_seam": f"with {SEAM} select pair_id, y, xs as x_start, xe as x_end, bx as best_x from best",
    "q17_seam_mask": f"with {SEAM} select pair_id, y, x, seam from sm",
    "q18_blend": f"with {PAIR} select pair_id, y, x, floor(least(255, greatest(0, case when v1 > 0 and v2 > 0 then v1::float * 0.5::float + v2::float * 0.5::float when v1 > 0 then v1::float * 0.5::float when v2 > 0 then v2::float * 0.5::float else 0 end)))::int as v from p",
    "q19_first_wins": f"with {BOTH}, b as (select pair_id, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from f where v1 > 10 or v2 > 10 group by pair_id) select f.pair_id as pair_id, y - y0 as y, x - x0 as x, case when v1 > 10 then v1 when v2 > 10 then v2 else 0 end as v from f join b on f.pair_id = b.pair_id where y between y0 and y1 and x between x0 and x1",
    "q20_fixed_overlap": f"with {PIXELS}, u as (select image_id // 2 as pair_id, y, x, v as v1, 0 as v2 from px where image_id % 2 = 0 union all select image_id // 2, y, x + 44, 0, case when x >= 12 then v else 0 end from px where image_id % 2 = 1) select pair_id, y, x, case when max(v2) > 0 then max(v2) else max(v1) end as v from u group by 1, 2, 3",
    "q21_feather": f"""with {SEAM}, tr as (select pair_id, y, min(x) as sx from (select pair_id, y, x, seam, lag(seam) over (partition by pair_id, y order by x) as was from sm) where seam <> was group by pair_id, y),
rp as (select sm.*, case when x >= greatest(xs, sx - 20) and x < least(xe, sx + 20) then (case when x < sx then greatest(0, 1 - (sx - x)::double / 20) else least(1, (x - sx)::double / 20) end) else 0 end::float as m from sm left join tr on sm.pair_id = tr.pair_id and sm.y = tr.y)
select pair_id, y, x, floor(least(255, greatest(0, (case when m > 0 then v1::float * (1::float - m) + v2::float * m when seam = 1 then v1::float else v2::float end)::double)))::int as v from rp""",
    "q22_bbox_centroid": f"with {PIXELS} select image_id::int as image_id, min(y) as y_min, max(y) as y_max, min(x) as x_min, max(x) as x_max, round(avg(x), 6) as x_mean, round(avg(y), 6) as y_mean, count(*) as n from px where v > 140 group by 1",
    "q23_pooled_error": f"with e1 as (select l_suppkey % 10 as pair_id, e from {_errors(H1)}), e2 as (select l_suppkey % 10 as pair_id, e from {_errors(H2)}), b as (select pair_id, 'l' as s, e from e1 union all select pair_id, 'r', e from e2) select pair_id, round(avg(e), 6) as mean_error, round(avg(e) filter (where s = 'l'), 6) as left_error, round(avg(e) filter (where s = 'r'), 6) as right_error, count(*) as n from b group by 1",
    "q24_in_canvas": f"select l_orderkey, l_linenumber, trunc(u)::bigint as u, trunc(v)::bigint as v from {_projected(H1)} where trunc(u) >= 0 and trunc(u) < 40 and trunc(v) >= 0 and trunc(v) < 5",
    "q25_best_trial": f"with {RESULTS} select camera_id, trial_id, optimized_error from (select *, row_number() over (partition by camera_id order by optimized_error, trial_id) as rn from res where success) where rn = 1",
    "q26_summary_pivot": f"with {RESULTS} select camera_id, count(*) as trials, count(*) filter (where not success) as failed, round(avg(initial_error), 6) as initial_error, round(avg(optimized_error), 6) as optimized_error from res group by 1",
    "q27_similarity_points": "select l_orderkey, l_linenumber, round(a * x + b * y + (1 - a) * 300 - b * 400 + 12, 6) as u, round(-b * x + a * y + b * 300 + (1 - a) * 400 - 7, 6) as v from (select l_orderkey, l_linenumber, l_quantity::float::double as x, l_discount::float::double as y, 1.5 * cos(radians(30)) as a, 1.5 * sin(radians(30)) as b from lineitem)",
    "q28_dlt_sums": "with p as (select l_suppkey as camera_id, l_quantity::float::double as x, l_discount::float::double as y, (l_quantity + l_tax)::float::double as u, (l_discount * 2)::float::double as v from lineitem) select camera_id, count(*) as n, round(sum(x * x), 4) as xx, round(sum(x * y), 4) as xy, round(sum(y * y), 4) as yy, round(sum(x * u), 4) as xu, round(sum(x * v), 4) as xv, round(sum(x * x * u), 4) as xxu, round(sum((x * x + y * y) * (u * u + v * v)), 2) as cross from p group by 1",
    "q36_wide_summary": f"with {BEST} select 'all' as experiment, {', '.join(f"round(max({m}) filter (where camera_id = 'camera{i}'), 6) as camera{i}_{m}" for i in range(5) for m in ('initial_error', 'optimized_error'))} from top",
    "q37_merged_summary": f"""with {RECORDS}, l as (select experiment, unnest([camera_id || '_initial_error', camera_id || '_optimized_error', camera_id || '_improvement']) as key, unnest([i, o, i - o]) as value from rec),
r as (select n_nationkey as experiment, unnest(['camera' || n_nationkey || '_improvement', 'num_images']) as key, unnest([-1.0, 2.0])::double as value from nation where n_nationkey in (select experiment from rec))
select experiment, key, round(value, 6) as value from (select * from r union all select * from l anti join r using (experiment, key))""",
    "q38_level_lists": "select p_partkey, (l - 1)::int as level, chr((97 + least(l - 1, p_partkey % 3))::int) || (p_partkey % 7) as method from part, unnest(range(1, 6)) as t(l) where l <= p_partkey % 5 + 1",
    "q39_annotations": f"""select l_suppkey as camera_id, l_orderkey * 10 + l_linenumber as idx, trunc(rx)::bigint as real_x, trunc(ry)::bigint as real_y, trunc(u)::bigint as proj_x, trunc(v)::bigint as proj_y,
round(sqrt((u - rx) * (u - rx) + (v - ry) * (v - ry)), 6) as error, 'L' || (l_orderkey * 10 + l_linenumber) as label
from (select * replace (u::float::double as u, v::float::double as v) from {_projected(H1).replace('from lineitem', ', l_quantity + l_tax as rx, l_discount * 2 as ry from lineitem')}) where trunc(u) >= 0 and trunc(u) < 40 and trunc(v) >= 0 and trunc(v) < 5""",
    "q40_draw_points": f"with {PIXELS}, {HIT} select px.image_id::int as image_id, px.y as y, px.x as x, case when hit.y is null then v else 255 end as v from px left join hit on px.image_id = hit.image_id and px.y = hit.y and px.x = hit.x",
    "q41_params": "select vec_id, 1.0::double as h22, (i - 1)::int as pos, round(embedding[i]::double, 6) as value from embeddings, unnest(range(1, 9)) as t(i)",
    "q42_quad_filters": f"""with {CORNERS} select quad_id, round(abs({' + '.join(f'(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})' for i in range(4))}) / 2, 3) as area, least({', '.join(TURNS)}) >= 0 or greatest({', '.join(TURNS)}) <= 0 as convex,
round((floor(greatest(x0, x1, x2, x3)) - floor(least(x0, x1, x2, x3)) + 1)::double / (floor(greatest(y0, y1, y2, y3)) - floor(least(y0, y1, y2, y3)) + 1), 6) as aspect from c""",
    "q43_gray": f"with {PIXELS} select image_id::int as image_id, y, x, ((v * 1868 + (v * 3 % 256) * 9617 + (v * 7 % 256) * 4899 + 8192) // 16384)::int as gray, ((v * 4899 + (v * 3 % 256) * 9617 + (v * 7 % 256) * 1868 + 8192) // 16384)::int as swapped from px",
    "q44_report_lines": f"with {BEST} select printf('%s: initial %.4f, optimized %.4f, improvement %.2f%%', camera_id, initial_error, optimized_error, case when initial_error > 0 then (initial_error - optimized_error) / initial_error * 100 else 0.0 end) as line from top",
    "q45_camera_names": f"with {RECORDS} select experiment, count(*) as total_cameras, string_agg(camera_id, ', ' order by s_suppkey) as names from rec group by 1",
    "q46_run_stamps": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso, strftime(ts, '%Y-%m-%d %H:%M:%S') as shown from events",
    "q47_candidate_objectives": f"""with {CANDIDATES}, {QUADS.replace('quad_id, vec_id % 10 as camera_id', 'square_id, vec_id % 10 as camera_id')},
qh as (select square_id * 5 + candidate as quad_id, camera_id, candidate, k, ((p0 * fx + p1 * fy + p2) / w)::float::double as x, ((p3 * fx + p4 * fy + p5) / w)::float::double as y
  from (select *, p6 * fx + p7 * fy + 1 as w from (select *, x::float::double as fx, y::float::double as fy from q, cd))),
{NORMAL.replace('from q)', 'from qh)')}, {METRIC}, sq as (select camera_id, quad_id % 5 as candidate, sum(e) as e from me group by 1, 2),
an as (select p_partkey % 10 as camera_id, candidate, sum(sqrt(pow((p0 * p_size + p1 * p_retailprice + p2) / w - p_size * 2, 2) + pow((p3 * p_size + p4 * p_retailprice + p5) / w - p_retailprice, 2))) as s
  from (select *, p6 * p_size + p7 * p_retailprice + 1 as w from part, cd) group by 1, 2)
select camera_id, candidate::int as candidate, round(e + 0.3 * s, 4) as value from sq join an using (camera_id, candidate)""",
    "q48_trials": f"""with u as (select s_suppkey as camera_id, t::int as trial_id, floor({_drawn("s_suppkey || ':' || t || ':levels'")} * 4)::int + 1 as levels from supplier, unnest(range(10)) as a(t)),
l as (select camera_id, trial_id, levels, (i - 1)::int as level, camera_id || ':' || trial_id || ':' || i || ':' as k from u, unnest(range(1, 5)) as b(i) where i <= levels)
select camera_id, trial_id, levels, level, ['Powell', 'L-BFGS-B', 'TNC'][floor({_drawn("k || 'method'")} * 3)::int + 1] as method, ['none', 'strict', 'adaptive'][floor({_drawn("k || 'bounds'")} * 3)::int + 1] as bounds,
round(0.05 * pow(40, {_drawn("k || 'weight'")}), 9) as weight from l""",
    "q31_warp": f"""with {PIXELS}, {WARPED} select o.image_id::int as image_id, o.y as y, o.x as x,
  round_even((coalesce(p.v, 0) * (1 - b) + coalesce(q.v, 0) * b) * (1 - a) + (coalesce(r.v, 0) * (1 - b) + coalesce(s.v, 0) * b) * a, 0)::int as v
from o left join px p on p.image_id = o.image_id and p.y = i and p.x = j left join px q on q.image_id = o.image_id and q.y = i and q.x = j + 1
  left join px r on r.image_id = o.image_id and r.y = i + 1 and r.x = j left join px s on s.image_id = o.image_id and s.y = i + 1 and s.x = j + 1""",
    "q32_multiband": _multiband(),
    "q49_mask_runs": f"with {PIXELS}, l as (select image_id, y, x, x - row_number() over (partition by image_id, y order by x) as r from px where v > 140) select image_id::int as image_id, y, min(x) as start, max(x) + 1 as \"end\" from l group by image_id, y, r",
    "q50_mask_algebra": f"""with {BOTH}, k as (select pair_id, y, x, unnest([case when v1 > 130 and v2 > 130 then 'both' end, case when v1 > 130 or v2 > 130 then 'either' end, case when v1 > 130 and v2 <= 130 then 'first' end, case when (v1 > 130) <> (v2 > 130) then 'one' end]) as kind from f)
select pair_id, kind, min(y) as y_min, max(y) as y_max, min(x) as x_min, max(x) as x_max, round(avg(x), 6) as x_mean, round(avg(y), 6) as y_mean, count(*) as n from k where kind is not null group by 1, 2""",
    "q51_seam_runs": f"with {SEAM}, l as (select pair_id, y, x, x - row_number() over (partition by pair_id, y order by x) as r from sm where seam = 1) select pair_id, y, min(x) as start, max(x) + 1 as \"end\" from l group by pair_id, y, r",
}

ORACLES["q54_draw_reprojections"] = f"""with {PIXELS}, n as (select s_suppkey as k, s_suppkey % 8 as image_id, s_suppkey % 3 = 0 as r, s_suppkey * 13 % 250 as y0, s_suppkey * 7 % 64 as x0, s_suppkey * 13 % 250 + s_suppkey % 17 - 8 as y1, s_suppkey * 7 % 64 + s_suppkey % 23 - 11 as x1 from supplier),
d as (select image_id, r, k, 0 as part, y0 + i as y, x0 + j as x, 256 as c from n, unnest(range(-4, 5)) as a(i), unnest(range(-4, 5)) as b(j) where i * i + j * j <= 16
  union all select image_id, r, k, 1, y1 + i, x1 + j, 257 from n, unnest(range(-2, 3)) as a(i), unnest(range(-2, 3)) as b(j) where i * i + j * j <= 4
  union all select image_id, r, k, 2, y0 + floor((y1 - y0) * s / m + 0.5)::bigint + i, x0 + floor((x1 - x0) * s / m + 0.5)::bigint + j, case when r then 259 else 258 end
    from (select *, greatest(abs(y1 - y0), abs(x1 - x0), 1)::double as m, unnest(range(greatest(abs(y1 - y0), abs(x1 - x0), 1) + 1)) as s from n), unnest(range(-1, 2)) as a(i), unnest(range(-1, 2)) as b(j)),
t as (select image_id, y, x, c from d qualify row_number() over (partition by image_id, y, x order by r desc, k desc, part desc) = 1)
select px.image_id::int as image_id, px.y as y, px.x as x, coalesce(t.c, v)::int as v from px left join t on px.image_id = t.image_id and px.y = t.y and px.x = t.x"""

# All pairs of quads, compared by the sides of both; sides from 32-bit corners as the points of images are.
ORACLES["q56_overlapping_views"] = """with f as (select s_suppkey as k, (s_suppkey * 37 % 601 + 0.25)::double as tx, (s_suppkey * 53 % 433 + 0.5)::double as ty, (s_suppkey % 12)::double / 8 as a from supplier),
c as (select k, i, cos(a) * px - sin(a) * py + tx as x, sin(a) * px + cos(a) * py + ty as y from f, (values (0, 0.0::double, 0.0::double), (1, 63.0, 0.0), (2, 63.0, 47.0), (3, 0.0, 47.0)) as t(i, px, py)),
s as (select a.k as k, a.i as i, b.y - a.y as nx, a.x - b.x as ny from c a join c b on a.k = b.k and b.i = (a.i + 1) % 4),
box as (select k from c group by k having max(x) >= 0 and min(x) <= 639 and max(y) >= 0 and min(y) <= 479),
p as (select a.k as one, b.k as two from box a, box b where a.k < b.k),
ax as (select one, two, s.k as owner, s.i as i, nx, ny from p join s on s.k = p.one or s.k = p.two),
pr as (select one, two, owner, ax.i as i, min(case when c.k = one then x * nx + y * ny end) as lo1, max(case when c.k = one then x * nx + y * ny end) as hi1, min(case when c.k = two then x * nx + y * ny end) as lo2, max(case when c.k = two then x * nx + y * ny end) as hi2 from ax join c on c.k = one or c.k = two group by all)
select one as first, two as second from pr group by one, two having not bool_or(hi1 < lo2 or hi2 < lo1)"""
ORACLES["q57_mosaic"] = f"""with {PIXELS}, w as (select image_id as pos, y + image_id * 9 as y, x + image_id * 20 as x, v from px where (x + y) % 3 > 0 and v > 100),
t as (select y, x, v from w qualify row_number() over (partition by y, x order by pos) = 1), b as (select min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from w),
g as (select y0, x0, y, x from b, unnest(range(y0, y1 + 1)) as a(y), unnest(range(x0, x1 + 1)) as e(x))
select (g.y - y0)::int as y, (g.x - x0)::int as x, coalesce(v, 0)::int as v from g left join t on g.y = t.y and g.x = t.x"""

# Sums in whole steps of 2^-40; nothing is rounded in the result.
FIXED = "(sum(floor({0} * 1099511627776.0::double)::hugeint)::double / 1099511627776.0::double)"
ORACLES["q58_exact_means"] = f"select l_suppkey as camera_id, {FIXED.format('e')} as total, {FIXED.format('e')} / count(*) as mean_error, count(*) as n from {_errors(H1)} group by 1"
ORACLES["q59_exact_dlt_sums"] = f"""with p as (select l_suppkey as camera_id, l_quantity::float::double as x, l_discount::float::double as y, (l_quantity + l_tax)::float::double as u, (l_discount * 2)::float::double as v from lineitem)
select camera_id, count(*) as n, {', '.join(f"{FIXED.format('(' + e + ')')} as {n}" for n, e in (('xx', 'x * x'), ('xy', 'x * y'), ('yy', 'y * y'), ('xu', 'x * u'), ('xv', 'x * v'), ('xxu', 'x * x * u'), ('cross', '(x * x + y * y) * (u * u + v * v)')))} from p group by 1"""

# The same pixels, whatever tables they are read from.
ORACLES |= {"q52_stored_seam": ORACLES["q17_seam_mask"], "q53_stored_feather": ORACLES["q21_feather"]}
