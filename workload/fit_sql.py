"""SQL of peak search and Gaussian fits: a recursive table of parameters, one row a group and step."""

from __future__ import annotations


def _slopes(p: str, count: int) -> str:
    """The list of a point's residual and slopes, all by its error."""
    values, slopes = [], []
    for k in range(count):
        area, mean, sigma = (f"{p}[{3 * k + i}]" for i in (1, 2, 3))
        z = f"((q.x - {mean}) / {sigma})"
        unit = f"(exp(-0.5::DOUBLE * {z} * {z}) / (sqrt(2 * pi()) * {sigma}))"
        values.append(f"{area} * {unit}")
        slopes += [f"{unit} / q.e", f"{area} * {unit} * {z} / {sigma} / q.e", f"{area} * {unit} * ({z} * {z} - 1) / {sigma} / q.e"]
    return f"list_transform(pts, lambda q: [(q.y - ({' + '.join(values)})) / q.e, {', '.join(slopes)}])"


def _system(w: str, n: int) -> str:
    """Sum of squares, upper triangle of the normal matrix, gradient."""
    pairs = [(1, 1), *((i, j) for i in range(2, n + 2) for j in range(i, n + 2)), *((i, 1) for i in range(2, n + 2))]
    return "[" + ", ".join(f"list_sum(list_transform({w}, lambda v: v[{i}] * v[{j}]))" for i, j in pairs) + "]"


def _damped(n: int) -> str:
    at, rows = {}, []
    for i in range(n):
        for j in range(i, n):
            at[i, j] = at[j, i] = 2 + len({frozenset(k) for k in at})
    for i in range(n):
        d = f"s[{at[i, i]}]"
        cells = [f"{d} + damping * (CASE WHEN {d} = 0 THEN 1 ELSE {d} END)" if i == j else f"s[{at[i, j]}]" for j in range(n)]
        rows.append(f"[{', '.join([*cells, f's[{2 + n * (n + 1) // 2 + i}]'])}]")
    return f"[{', '.join(rows)}]"


def fit_ctes(hist: str, bins: int, low: float, high: float, min_peak: int, cb: int = 8, finder: str = "max", count: int = 1) -> str:
    """Tables up to ``fitted`` (sm, mm, p, chi2_ndf, problem) from ``hist`` (sm, mm, bin, count); they need WITH RECURSIVE."""
    n, width = 3 * count, (high - low) / bins
    centre = lambda i: f"({low}::DOUBLE + ({i} + 0.5::DOUBLE) * {width}::DOUBLE)"
    peak = "SELECT sm, mm, CAST(NULL AS INTEGER) AS peak FROM dense"
    peaks = ""
    if finder == "peak":
        peaks = f""", y AS (
  SELECT sm, mm, unnest(range(0, {bins})) AS i, unnest(counts) AS y, list_max(counts) AS top FROM dense
), sides AS (
  SELECT a.*, (SELECT max(b.i) FROM y AS b WHERE b.sm = a.sm AND b.mm = a.mm AND b.i < a.i AND b.y <> a.y) AS before,
         (SELECT min(b.i) FROM y AS b WHERE b.sm = a.sm AND b.mm = a.mm AND b.i > a.i AND b.y <> a.y) AS after
  FROM y AS a
), high AS (
  SELECT s.sm, s.mm, s.i, s.y, row_number() OVER (PARTITION BY s.sm, s.mm ORDER BY s.y DESC, s.i DESC) AS place
  FROM sides AS s JOIN y AS b ON b.sm = s.sm AND b.mm = s.mm AND b.i = before JOIN y AS a ON a.sm = s.sm AND a.mm = s.mm AND a.i = after
  WHERE b.y < s.y AND a.y < s.y AND (before + after) // 2 = s.i AND s.y >= s.top / 2
), chosen AS (
  SELECT sm, mm, place, CASE WHEN place = 1 THEN [i] END AS kept FROM high WHERE place = 1
  UNION ALL
  SELECT c.sm, c.mm, h.place, CASE WHEN len(list_filter(c.kept, lambda k: abs(k - h.i) < {cb})) = 0 THEN list_append(c.kept, h.i) ELSE c.kept END
  FROM chosen AS c JOIN high AS h ON h.sm = c.sm AND h.mm = c.mm AND h.place = c.place + 1
), isolated AS (
  SELECT sm, mm, unnest(arg_max(kept, place)) AS k FROM chosen GROUP BY sm, mm
), bases AS (
  SELECT s.sm, s.mm, s.k, p.y AS yk,
         coalesce((SELECT max(i) FROM y WHERE y.sm = s.sm AND y.mm = s.mm AND y.i < s.k AND y.y > p.y) + 1, 0) AS l,
         coalesce((SELECT min(i) FROM y WHERE y.sm = s.sm AND y.mm = s.mm AND y.i > s.k AND y.y > p.y) - 1, {bins - 1}) AS r
  FROM isolated AS s JOIN y AS p ON p.sm = s.sm AND p.mm = s.mm AND p.i = s.k
), rises AS (
  SELECT *, yk - greatest(low_left, low_right) AS rise FROM (
    SELECT b.*, min(y.y) FILTER (y.i BETWEEN l AND k) AS low_left, min(y.y) FILTER (y.i BETWEEN k AND r) AS low_right
    FROM bases AS b JOIN y ON y.sm = b.sm AND y.mm = b.mm GROUP BY ALL)
), crossed AS (
  SELECT r.*, max(y.i) FILTER (y.i >= l AND y.i < k AND y.y <= yk - rise / 2) AS a, min(y.i) FILTER (y.i > k AND y.i <= r AND y.y <= yk - rise / 2) AS b
  FROM rises AS r JOIN y ON y.sm = r.sm AND y.mm = r.mm GROUP BY ALL
), widths AS (
  SELECT c.sm, c.mm, c.k, c.rise,
         coalesce(CASE WHEN d.counts[b + 1] < yk - rise / 2 THEN b - (yk - rise / 2 - d.counts[b + 1]) / (d.counts[b] - d.counts[b + 1]) ELSE b END, r)
         - coalesce(CASE WHEN d.counts[a + 1] < yk - rise / 2 THEN a + (yk - rise / 2 - d.counts[a + 1]) / (d.counts[a + 2] - d.counts[a + 1]) ELSE a END, l) AS width
  FROM crossed AS c JOIN dense AS d ON d.sm = c.sm AND d.mm = c.mm
)"""
        peak = f"""SELECT d.sm, d.mm, max(k) FILTER (rise >= {min_peak // 2} AND width >= {cb // 2}) AS peak
  FROM dense AS d LEFT JOIN widths AS w ON w.sm = d.sm AND w.mm = d.mm GROUP BY d.sm, d.mm"""
    start = "[total, mean, sqrt(spread)]"
    if count == 2:
        part = lambda c: f"{c}.total, coalesce({c}.mean, m.mean), CASE WHEN {c}.spread > 0 THEN sqrt({c}.spread) ELSE sqrt(m.spread) / 2 END"
        start = f"[{part('l')}, {part('r')}]"
    moments = lambda pts: (
        f"sum(y) AS total, sum(x * y) / sum(y) AS mean FROM (SELECT sm, mm, unnest(pts, recursive := true) FROM {pts}) GROUP BY sm, mm"
    )
    spread = "sum((x - mean) * (x - mean) * y) / total * (CASE WHEN total > 1 THEN total / (total - 1) ELSE 1 END)"
    sides = ""
    for name, sign in (("l", "<"), ("r", ">=")):
        sides += f""", {name}0 AS (SELECT p.sm, p.mm, sum(y) AS total, sum(x * y) / sum(y) AS mean FROM flat AS p JOIN m ON m.sm = p.sm AND m.mm = p.mm WHERE x {sign} m.mean GROUP BY p.sm, p.mm),
  {name} AS (SELECT p.sm, p.mm, a.total, a.mean, sum((x - a.mean) * (x - a.mean) * y) / a.total * (CASE WHEN a.total > 1 THEN a.total / (a.total - 1) ELSE 1 END) AS spread
        FROM flat AS p JOIN m ON m.sm = p.sm AND m.mm = p.mm JOIN {name}0 AS a ON a.sm = p.sm AND a.mm = p.mm WHERE x {sign} m.mean GROUP BY p.sm, p.mm, a.total, a.mean)"""
    joined = "m JOIN l ON l.sm = m.sm AND l.mm = m.mm JOIN r ON r.sm = m.sm AND r.mm = m.mm" if count == 2 else "m"
    stages = f"(SELECT *, {_damped(n)} AS m0 FROM fit WHERE NOT done AND step < 500)"
    for c in range(1, n + 1):
        stages = f"(SELECT *, list_transform(m{c - 1}[{c}], lambda v: v / m{c - 1}[{c}][{c}]) AS r{c} FROM {stages})"
        other = f"list_transform(row, lambda v, k: v - row[{c}] * r{c}[k])"
        stages = f"(SELECT *, list_transform(m{c - 1}, lambda row, i: CASE WHEN i = {c} THEN r{c} ELSE {other} END) AS m{c} FROM {stages})"
    stages = f"(SELECT *, list_transform(m{n}, lambda row: row[{n + 1}]) AS move FROM {stages})"
    stages = f"(SELECT *, list_transform(move, lambda v, i: v + p[i]) AS t FROM {stages})"
    positive = " AND ".join(f"t[{3 * k}] > 0" for k in range(1, count + 1))
    stages = f"(SELECT *, CASE WHEN {positive} THEN {_slopes('t', count)} END AS w FROM {stages})"
    stages = f"(SELECT *, CASE WHEN w IS NOT NULL THEN {_system('w', n)} END AS ts FROM {stages})"
    small = "len(list_filter(list_transform(move, lambda v, i: abs(v) <= 1e-9 * (abs(p[i]) + 1e-9)), lambda ok: NOT ok)) = 0"
    stages = f"(SELECT *, coalesce(ts[1] <= s[1] AND NOT isnan(ts[1]), false) AS better, {small} AS small FROM {stages})"
    return f""", dense AS (
  SELECT sm, mm, list_transform(range(0, {bins}), lambda i: coalesce(m[i], 0)) AS counts
  FROM (SELECT sm, mm, map(list(CAST(bin AS BIGINT)), list(CAST(count AS DOUBLE))) AS m FROM {hist} WHERE bin IS NOT NULL GROUP BY sm, mm)
){peaks}, peaks AS (
  {peak}
), middles AS (
  SELECT d.*, peak, coalesce(peak, list_position(counts, list_max(counts)) - 1) AS middle FROM dense AS d JOIN peaks AS p ON p.sm = d.sm AND p.mm = d.mm
  WHERE list_max(counts) >= {min_peak}
), points AS (
  SELECT sm, mm, peak, list_filter(list_transform(range(greatest(middle - {cb}, 0), least(middle + {cb}, {bins})),
         lambda i: {{'x': {centre("i")}, 'y': counts[i + 1], 'e': sqrt(counts[i + 1])}}), lambda q: q.y > 0) AS pts
  FROM middles
), flat AS (
  SELECT sm, mm, unnest(pts, recursive := true) FROM points
), first AS (
  SELECT sm, mm, {moments("points")}
), centred AS (
  SELECT f.sm, f.mm, total, coalesce({centre("peak")}, f.mean) AS mean, pts FROM first AS f JOIN points AS p ON p.sm = f.sm AND p.mm = f.mm
), m AS (
  SELECT c.sm, c.mm, total, mean, pts, {spread} AS spread FROM centred AS c JOIN flat AS q ON q.sm = c.sm AND q.mm = c.mm GROUP BY c.sm, c.mm, total, mean, pts
){sides if count == 2 else ""}, begun AS (
  SELECT m.sm, m.mm, pts, {start} AS p FROM {joined} WHERE m.spread > 0
), fit AS (
  SELECT sm, mm, pts, p, {_system("w", n)} AS s, 1e-3::DOUBLE AS damping, false AS done, 0 AS step FROM (SELECT *, {_slopes("p", count)} AS w FROM begun)
  UNION ALL
  SELECT sm, mm, pts, CASE WHEN better THEN t ELSE p END, CASE WHEN better THEN ts ELSE s END,
         CASE WHEN better THEN greatest(damping / 10, 1e-12::DOUBLE) ELSE damping * 10 END,
         CASE WHEN better THEN s[1] - ts[1] <= 1e-12 * greatest(s[1], 1e-300::DOUBLE) AND small ELSE damping * 10 > 1e12 END, step + 1
  FROM {stages}
), ended AS (
  SELECT sm, mm, pts, p, s FROM fit QUALIFY row_number() OVER (PARTITION BY sm, mm ORDER BY step DESC) = 1
), fitted AS (
  SELECT d.sm, d.mm, p, CASE WHEN len(pts) > 3 THEN s[1] / (len(pts) - 3) END AS chi2_ndf,
         CASE WHEN list_max(counts) < {min_peak} THEN 'maximum below the required height' WHEN p IS NULL THEN 'no width to fit' END AS problem
  FROM dense AS d LEFT JOIN ended AS e ON e.sm = d.sm AND e.mm = d.mm
)"""


def fit_rows() -> str:
    return """SELECT sm, mm, round(p[1], 3) AS area, round(p[2], 3) AS mean, round(p[3], 3) AS sigma, round(chi2_ndf, 3) AS chi2_ndf, problem FROM fitted"""
