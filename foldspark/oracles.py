"""The queries of ``foldspark.queries`` as DuckDB SQL, put together from common tables."""

from __future__ import annotations

H, GAP, ALPHA = 20, 20, 1.0

BARS = """bars AS (
  SELECT event_type AS asset, date_trunc('hour', ts) AS bar_ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, sum(value) AS volume, count(*) AS n_trades
  FROM events GROUP BY 1, 2)"""

PANEL = f"""{BARS},
panel AS (SELECT *, CAST(dense_rank() OVER (ORDER BY bar_ts) - 1 AS INTEGER) AS t_idx FROM bars),
r1 AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY bar_ts), 0) - 1 AS ret1 FROM panel)"""


def _trail(x: str, n: int, what: str) -> str:
    w = f"OVER (PARTITION BY asset ORDER BY bar_ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {what}({x}) {w} END"


_ROW = "PARTITION BY asset ORDER BY bar_ts"
_NEXT = f"OVER ({_ROW} ROWS BETWEEN 1 FOLLOWING AND {{h}} FOLLOWING)"

_BASE = f"""ret1, close / nullif(lag(close, 5) OVER ({_ROW}), 0) - 1 AS ret5, close / nullif(lag(close, 20) OVER ({_ROW}), 0) - 1 AS ret20,
  {_trail("close", 20, "avg")} AS mean20, {_trail("ret1", 20, "stddev_samp")} AS vol20,
  close / nullif({_trail("close", 20, "avg")}, 0) - 1 AS mom20, (high - low) / nullif(close, 0) AS range1,
  (volume - {_trail("volume", 20, "avg")}) / nullif({_trail("volume", 20, "stddev_samp")}, 0) AS volz20"""

TARGETS = {
    "ret": f"lead(close, {{h}}) OVER ({_ROW}) / nullif(close, 0) - 1",
    "vol": f"CASE WHEN count(ret1) {_NEXT} = {{h}} THEN stddev_samp(ret1) {_NEXT} END",
    "updown": f"CAST(CASE WHEN lead(close, {{h}}) OVER ({_ROW}) / nullif(close, 0) - 1 IS NULL THEN NULL WHEN lead(close, {{h}}) OVER ({_ROW}) / nullif(close, 0) - 1 > 0 THEN 1 ELSE 0 END AS DOUBLE)",
    "upside": f"CASE WHEN count(high) {_NEXT} = {{h}} THEN max(high) {_NEXT} / nullif(close, 0) - 1 END",
    "drawdown": f"CASE WHEN count(low) {_NEXT} = {{h}} THEN min(low) {_NEXT} / nullif(close, 0) - 1 END",
}


def rows(target: str = "ret", h: int = H, name: str = "rows_") -> str:
    y = TARGETS[target].format(h=h)
    return f"{name} AS (SELECT asset, bar_ts, t_idx, {_BASE}, {y} AS y, lead(t_idx, {h}) OVER ({_ROW}) AS label_end_idx FROM r1)"


FOLDS = """folds AS (
  SELECT CAST(k AS INTEGER) AS outer_fold_id, CAST(0 AS INTEGER) AS train_start, CAST(300 + 100 * k AS INTEGER) AS train_end,
         CAST(320 + 100 * k AS INTEGER) AS test_start, CAST(least(420 + 100 * k, n) AS INTEGER) AS test_end
  FROM (SELECT max(t_idx) + 1 AS n FROM panel) AS s, range(0, 1000) AS g(k) WHERE 320 + 100 * k < n)"""
ROLLING = FOLDS.replace("CAST(0 AS INTEGER) AS train_start", "CAST(greatest(0, 50 + 100 * k) AS INTEGER) AS train_start")
INNER = """inner_folds AS (
  SELECT outer_fold_id, CAST(k AS INTEGER) AS inner_fold_id, train_start AS train_start, CAST(train_start + 120 + 50 * k AS INTEGER) AS train_end,
         CAST(train_start + 140 + 50 * k AS INTEGER) AS test_start, CAST(least(train_start + 190 + 50 * k, train_end) AS INTEGER) AS test_end
  FROM folds, range(0, 1000) AS g(k) WHERE train_start + 140 + 50 * k < train_end)"""
E_ = f"greatest(t_idx + {GAP}, label_end_idx)"


def fit(src: str, folds: str, keys: list[str], a: str, b: str, alphas: tuple[float, ...] = (ALPHA,), name: str = "fits", own: str = "", partition: str = "") -> str:
    """Ridge on two inputs in closed form. ``own`` is a further condition on the row's fold."""
    k = ", ".join(f"f.{x}" for x in keys)
    ks = ", ".join(keys)
    values = ", ".join(f"({x}::DOUBLE)" for x in alphas)
    return f"""{name}_m AS (
  SELECT {k}, count(*)::DOUBLE AS n, avg({a}) AS ma, avg({b}) AS mb, avg(y) AS my,
         covar_pop({a}, {a}) * count(*) AS aa, covar_pop({b}, {b}) * count(*) AS bb, covar_pop({a}, {b}) * count(*) AS ab, covar_pop({a}, y) * count(*) AS ay, covar_pop({b}, y) * count(*) AS by_
  FROM {src} AS r JOIN {folds} AS f ON r.t_idx >= f.train_start AND greatest(r.t_idx + {GAP}, r.label_end_idx) < f.test_start {own}
  WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND y IS NOT NULL AND label_end_idx IS NOT NULL GROUP BY {k}),
{name} AS (
  SELECT {ks}, alpha, CAST(n AS BIGINT) AS n_train, ((bb + alpha) * ay - ab * by_) / ((aa + alpha) * (bb + alpha) - ab * ab) AS b1, ((aa + alpha) * by_ - ab * ay) / ((aa + alpha) * (bb + alpha) - ab * ab) AS b2, ma, mb, my
  FROM {name}_m, (VALUES {values}) AS v(alpha))"""


def pred(src: str, folds: str, keys: list[str], a: str, b: str, name: str = "scored", fits: str = "fits", extra: str = "", cond: str = "", where: str = "AND y IS NOT NULL") -> str:
    on = " AND ".join(f"f.{x} = c.{x}" for x in keys)
    k = ", ".join(f"f.{x}" for x in keys)
    return f"""{name} AS (
  SELECT {k}, asset, bar_ts, t_idx, y, label_end_idx, vol20, c.my - c.b1 * c.ma - c.b2 * c.mb + c.b1 * {a} + c.b2 * {b} AS pred {extra}
  FROM {src} AS r JOIN {folds} AS f ON r.t_idx >= f.test_start AND r.t_idx < f.test_end {cond} JOIN {fits} AS c ON {on}
  WHERE {a} IS NOT NULL AND {b} IS NOT NULL {where})"""


def scored(target: str = "ret", h: int = H, a: str = "ret5", b: str = "vol20", name: str = "scored", first: bool = True) -> str:
    head = f"{PANEL}, {FOLDS}, " if first else ""
    return f"{head}{rows(target, h, name + '_r')}, {fit(name + '_r', 'folds', ['outer_fold_id'], a, b, name=name + '_f')}, {pred(name + '_r', 'folds', ['outer_fold_id'], a, b, name, name + '_f')}"


def _rd(cols: str, digits: int = 6) -> str:
    """Comma-separated columns rounded under their own names."""
    return ", ".join(f"round({c.strip()}, {digits}) + 0.0::DOUBLE AS {c.strip()}" for c in cols.split(","))


def roles(columns: list[str]) -> str:
    has = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""{PANEL}, {FOLDS}, {rows()},
roles AS (
  SELECT r.*, f.outer_fold_id, CASE WHEN t_idx >= test_start AND t_idx < test_end THEN 'test' WHEN {E_} < test_start THEN 'train' ELSE 'embargo' END AS split_role
  FROM rows_ AS r JOIN folds AS f ON t_idx >= train_start AND t_idx < test_end WHERE {has} AND y IS NOT NULL)"""


DRIFT = ["ret5", "vol20", "range1"]
WIDE = ["ret1", "ret5", "ret20", "vol20", "mom20", "range1"]
_LONG = f"long_ AS ({' UNION ALL '.join(f'''SELECT outer_fold_id, split_role, '{f}' AS feature, {f} AS x FROM roles''' for f in DRIFT)})"
_TR, _TE = "FILTER (WHERE split_role = 'train')", "FILTER (WHERE split_role = 'test')"

BOTH = f"""{roles(["ret5", "vol20"])}, {fit("rows_", "folds", ["outer_fold_id"], "ret5", "vol20")},
both_ AS (SELECT r.*, c.my - c.b1 * c.ma - c.b2 * c.mb + c.b1 * ret5 + c.b2 * vol20 AS pred FROM roles AS r JOIN fits AS c USING (outer_fold_id) WHERE split_role <> 'embargo')"""
GAPS = f"{BOTH}, gaps AS (SELECT outer_fold_id, avg((y - pred) ^ 2) {_TE} - avg((y - pred) ^ 2) {_TR} AS value, max(label_end_idx) AS known_at FROM both_ GROUP BY 1)"

CANDIDATES = f"""{scored(name="sa")}, {scored(a="ret1", b="mom20", name="sb", first=False)},
candidates AS (SELECT *, 'a' AS candidate FROM sa UNION ALL SELECT *, 'b' AS candidate FROM sb)"""
SCORES = f"""{CANDIDATES},
scores AS (SELECT candidate, outer_fold_id, avg((y - pred) ^ 2) AS score, max(label_end_idx) AS known_at, any_value(test_start) AS test_start FROM candidates JOIN folds USING (outer_fold_id) GROUP BY 1, 2)"""


def recent(scores: str, name: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    same = f"AND a.{by} = b.{by}" if by else ""
    ga = f"a.{by}, " if by else ""
    return f"""{name} AS (
  SELECT {g}candidate, outer_fold_id, avg(s) AS score, count(*) AS n_folds FROM (
    SELECT {ga}a.candidate, a.outer_fold_id, b.score AS s, row_number() OVER (PARTITION BY {ga}a.candidate, a.outer_fold_id ORDER BY b.outer_fold_id DESC) AS r
    FROM {scores} AS a JOIN {scores} AS b ON a.candidate = b.candidate {same} AND b.known_at < a.test_start) AS x
  WHERE r <= 2 GROUP BY {g}candidate, outer_fold_id)"""


def ranked(src: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {g}outer_fold_id ORDER BY round(score, 12), candidate) AS INTEGER) AS rank FROM {src}"


_PSI = " + ".join(
    f"(greatest(coalesce(max(b) FILTER (WHERE bin = {i}), 0) / sum(b), 1e-4::DOUBLE) - greatest(coalesce(max(a) FILTER (WHERE bin = {i}), 0) / sum(a), 1e-4::DOUBLE)) * ln(greatest(coalesce(max(b) FILTER (WHERE bin = {i}), 0) / sum(b), 1e-4::DOUBLE) / greatest(coalesce(max(a) FILTER (WHERE bin = {i}), 0) / sum(a), 1e-4::DOUBLE))"
    for i in range(10)
)
_CORRS = [(a, b) for i, a in enumerate(DRIFT) for b in DRIFT[i + 1 :]]

_META_PARTS = []
for _n, _t in (("p_ret", "ret"), ("p_vol", "vol")):
    _META_PARTS.append(
        f"{rows(_t, H, _n + '_r')}, {fit(_n + '_r', 'inner_folds', ['outer_fold_id', 'inner_fold_id'], 'ret5', 'vol20', name=_n + '_if')}, {pred(_n + '_r', 'inner_folds', ['outer_fold_id', 'inner_fold_id'], 'ret5', 'vol20', _n + '_oof', _n + '_if', where='')},"
        f" {fit(_n + '_r', 'folds', ['outer_fold_id'], 'ret5', 'vol20', name=_n + '_of')}, {pred(_n + '_r', 'folds', ['outer_fold_id'], 'ret5', 'vol20', _n + '_test', _n + '_of', where='')},"
        f" {_n} AS (SELECT outer_fold_id, asset, bar_ts, 'oof' AS role, pred FROM {_n}_oof UNION ALL SELECT outer_fold_id, asset, bar_ts, 'test' AS role, pred FROM {_n}_test)"
    )
META = f"""{PANEL}, {FOLDS}, {INNER}, {', '.join(_META_PARTS)}, {rows('ret', 40)},
meta AS (SELECT r.*, a.outer_fold_id AS fold, a.role, a.pred AS p_ret, b.pred AS p_vol FROM rows_ AS r JOIN p_ret AS a USING (asset, bar_ts) JOIN p_vol AS b ON b.asset = a.asset AND b.bar_ts = a.bar_ts AND b.outer_fold_id = a.outer_fold_id AND b.role = a.role),
oof AS (SELECT * FROM meta WHERE role = 'oof'),
{fit('oof', 'folds', ['outer_fold_id'], 'p_ret', 'p_vol', name='mf', own='AND r.fold = f.outer_fold_id')},
out_ AS (SELECT c.outer_fold_id, asset, bar_ts, y, c.my - c.b1 * c.ma - c.b2 * c.mb + c.b1 * p_ret + c.b2 * p_vol AS pred FROM meta JOIN mf AS c ON c.outer_fold_id = fold WHERE role = 'test' AND y IS NOT NULL)"""

_COEF = "SELECT {k}, alpha, n_train, 'intercept' AS feature, my - b1 * ma - b2 * mb AS coef FROM fits UNION ALL SELECT {k}, alpha, n_train, 'ret5' AS feature, b1 AS coef FROM fits UNION ALL SELECT {k}, alpha, n_train, 'vol20' AS feature, b2 AS coef FROM fits"
_METRICS = """count(*) AS n, sqrt(avg((y - pred) ^ 2)) AS rmse, avg(abs(y - pred)) AS mae, 1 - avg((y - pred) ^ 2) / var_pop(y) AS r2,
  covar_pop(y, pred) / (sqrt(var_pop(y)) * sqrt(var_pop(pred))) AS ic, avg(CAST(sign(y) = sign(pred) AS DOUBLE)) AS hit_rate"""


def _avg_rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY outer_fold_id ORDER BY {c}) + (count(*) OVER (PARTITION BY outer_fold_id, {c}) - 1) / 2.0::DOUBLE"


def _tgt(y: str) -> str:
    return f"WITH {PANEL} SELECT asset, bar_ts, round({y}, 6) + 0.0::DOUBLE AS y, CAST(lead(t_idx, {H}) OVER ({_ROW}) AS DOUBLE) AS label_end_idx FROM r1"


_FIT_BY = lambda folds_: f"WITH {PANEL}, {folds_}, {rows()}, {fit('rows_', 'folds', ['outer_fold_id'], 'ret5', 'vol20')}"
_NEST = f"WITH {PANEL}, {FOLDS}, {INNER}, {rows()}, {fit('rows_', 'inner_folds', ['outer_fold_id', 'inner_fold_id'], 'ret5', 'vol20', (0.01, 1.0, 100.0))}"
_INNER_SCORES = f"""{_NEST},
inner_scores AS (
  SELECT f.outer_fold_id, f.inner_fold_id, c.alpha, count(*) AS n_test, avg((y - (c.my - c.b1 * c.ma - c.b2 * c.mb + c.b1 * ret5 + c.b2 * vol20)) ^ 2) AS mse
  FROM rows_ AS r JOIN inner_folds AS f ON r.t_idx >= f.test_start AND r.t_idx < f.test_end JOIN fits AS c ON c.outer_fold_id = f.outer_fold_id AND c.inner_fold_id = f.inner_fold_id
  WHERE ret5 IS NOT NULL AND vol20 IS NOT NULL AND y IS NOT NULL AND label_end_idx IS NOT NULL GROUP BY ALL)"""

_NO = _NEST.replace("avg(ret5) AS ma, avg(vol20) AS mb, avg(y) AS my", "0.0::DOUBLE AS ma, 0.0::DOUBLE AS mb, 0.0::DOUBLE AS my")
for _x, _y in (("ret5", "ret5"), ("vol20", "vol20"), ("ret5", "vol20"), ("ret5", "y"), ("vol20", "y")):
    _NO = _NO.replace(f"covar_pop({_x}, {_y}) * count(*)", f"sum({_x} * {_y})")
_NO = _NO[_NO.index("fits_m AS (") :].replace("fits", "raw")
_LOSS = """SELECT f.outer_fold_id, f.inner_fold_id, c.alpha, {w} AS other, count(*) AS n_test, {loss} AS score
  FROM rows_ AS r JOIN inner_folds AS f ON r.t_idx >= f.test_start AND r.t_idx < f.test_end JOIN {fits} AS c ON c.outer_fold_id = f.outer_fold_id AND c.inner_fold_id = f.inner_fold_id
  WHERE ret5 IS NOT NULL AND vol20 IS NOT NULL AND y IS NOT NULL AND label_end_idx IS NOT NULL GROUP BY ALL"""
_ERROR = "y - (c.my - c.b1 * c.ma - c.b2 * c.mb + c.b1 * ret5 + c.b2 * vol20)"
TWO = f"""{_NEST}, {_NO}, two AS ({_LOSS.format(w=0, loss=f"avg(({_ERROR}) ^ 2)", fits="fits")} UNION ALL {_LOSS.format(w=1, loss=f"avg(({_ERROR}) ^ 2)", fits="raw")})
  SELECT outer_fold_id, inner_fold_id, CAST(CASE alpha WHEN 0.01 THEN 0 WHEN 1.0 THEN 2 ELSE 4 END + other AS INTEGER) AS candidate, {{n}}round(score, 4) AS score FROM two"""

OWN = f"""{PANEL}, {rows(name='wide')}, rows_ AS (SELECT * REPLACE (CAST(row_number() OVER ({_ROW}) - 1 AS INTEGER) AS t_idx, CASE WHEN label_end_idx IS NOT NULL THEN CAST(row_number() OVER ({_ROW}) - 1 + {H} AS INTEGER) END AS label_end_idx) FROM wide),
  s AS (SELECT asset AS fa, count(*) AS n FROM rows_ GROUP BY 1),
  folds AS (SELECT fa, CAST(k AS INTEGER) AS outer_fold_id, 0 AS train_start, 320 + 100 * k AS test_start, least(420 + 100 * k, n) AS test_end FROM s, range(0, 1000) AS g(k) WHERE 320 + 100 * k < n),
  {fit('rows_', 'folds', ['fa', 'outer_fold_id'], 'ret5', 'vol20', own='AND r.asset = f.fa')}, {pred('rows_', 'folds', ['fa', 'outer_fold_id'], 'ret5', 'vol20', cond='AND r.asset = f.fa')}"""
_PER_ASSET = f"WITH {OWN} SELECT asset, bar_ts, outer_fold_id, {_rd('y, pred', 5)} FROM scored"


def _solved(src: str, names: list[str], k: str) -> str:
    """Ridge on any inputs: normal equations of the rows in ``src`` by ``k``, eliminated step by step; tables mom and beta."""
    n = len(names)
    all_ = [*names, "y"]
    made = [f"SELECT {k}, {i} AS i, {j} AS j, c{i}_{j}{f' + {ALPHA}::DOUBLE' if i == j else ''} AS v FROM mom" for i in range(n) for j in range(n + 1)]
    moments = [f"covar_pop({a}, {b}) * count(*) AS c{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(all_)]
    out = [f"mom AS (SELECT {k}, {', '.join(f'avg({c}) AS m_{c}' for c in all_)}, {', '.join(moments)} FROM {src} GROUP BY {k})", f"e0 AS ({' UNION ALL '.join(made)})"]
    for s in range(n):
        out.append(
            f"e{s + 1} AS (SELECT a.{k}, a.i, a.j, CASE WHEN a.i = {s} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v FROM e{s} AS a JOIN e{s} AS p ON p.{k} = a.{k} AND p.i = {s} AND p.j = {s}"
            f" JOIN e{s} AS r ON r.{k} = a.{k} AND r.i = {s} AND r.j = a.j JOIN e{s} AS c ON c.{k} = a.{k} AND c.i = a.i AND c.j = {s})"
        )
    out.append(f"beta AS (SELECT {k}, {', '.join(f'max(v) FILTER (WHERE i = {i}) AS b_{c}' for i, c in enumerate(names))} FROM e{n} WHERE j = {n} GROUP BY {k})")
    return ", ".join(out)


_FULL = ["ret5", "vol20", "p_ret", "p_vol", "gap_health", "has_health"]
_ALL_THERE = " AND ".join(f"{c} IS NOT NULL" for c in [*_FULL, "y"])
META_FULL = f"""{GAPS}, {INNER}, {', '.join(_META_PARTS)}, {rows('upside', 40, 'mrows')},
known AS (SELECT known_at AS ka, arg_max(value, outer_fold_id) AS gv FROM gaps GROUP BY 1),
meta AS (SELECT r.*, a.outer_fold_id AS fold, a.role, a.pred AS p_ret, b.pred AS p_vol FROM mrows AS r JOIN p_ret AS a USING (asset, bar_ts) JOIN p_vol AS b ON b.asset = a.asset AND b.bar_ts = a.bar_ts AND b.outer_fold_id = a.outer_fold_id AND b.role = a.role),
full_ AS (SELECT meta.*, coalesce(g.gv, 0.0::DOUBLE) AS gap_health, CAST(g.ka IS NOT NULL AS INTEGER) AS has_health FROM meta ASOF LEFT JOIN known AS g ON meta.t_idx > g.ka),
tr AS (SELECT m.* FROM full_ AS m JOIN folds AS f ON m.fold = f.outer_fold_id AND m.t_idx >= f.train_start AND greatest(m.t_idx + {GAP}, m.label_end_idx) < f.test_start WHERE role = 'oof' AND label_end_idx IS NOT NULL AND {_ALL_THERE}),
{_solved('tr', _FULL, 'fold')},
out_ AS (SELECT fold AS outer_fold_id, asset, bar_ts, y, m_y + {' + '.join(f'b_{c} * ({c} - m_{c})' for c in _FULL)} AS pred, gap_health, has_health FROM full_ JOIN mom USING (fold) JOIN beta USING (fold) WHERE role = 'test' AND {_ALL_THERE})"""


def irls(src: str, keys: str, features: list[str], name: str = "logit", rounds: int = 14) -> str:
    """Newton's steps of a logistic regression on one or two inputs by ``keys``, from zero; the last table has b0, b1 (and b2)."""
    k, x = len(features), ["1.0::DOUBLE", *features]
    on = " AND ".join(f"r.{c} = c.{c}" for c in keys.split(", "))
    own = ", ".join(f"r.{c}" for c in keys.split(", "))
    out = [f"{name}_0 AS MATERIALIZED (SELECT {keys}, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k + 1))} FROM {src} GROUP BY {keys})"]
    solved = {
        1: ["(g0 * h11 - h01 * g1) / (h00 * h11 - h01 * h01)", "(h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)"],
        2: [
            "(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det",
            "(h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det",
            "(h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det",
        ],
    }[k]
    det = "h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02)" if k == 2 else "1"
    for n in range(rounds):
        eta = " + ".join(f"c.b{i} * {v}" for i, v in enumerate(x))
        sums = [f"sum((y - p) * {v}) AS g{i}" for i, v in enumerate(x)] + [f"sum(p * (1 - p) * {x[i]} * {x[j]}) AS h{i}{j}" for i in range(k + 1) for j in range(i, k + 1)]
        bs = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(k + 1))
        out.append(
            f"{name}_s{n} AS (SELECT {keys}, {', '.join(sums)}, {bs} FROM (SELECT {own}, y, {', '.join(features)}, {', '.join(f'c.b{i}' for i in range(k + 1))}, 1 / (1 + exp(-({eta}))) AS p FROM {src} AS r JOIN {name}_{n} AS c ON {on}) GROUP BY {keys})"
        )
        out.append(f"{name}_{n + 1} AS MATERIALIZED (SELECT {keys}, {', '.join(f'b{i} + {v} AS b{i}' for i, v in enumerate(solved))} FROM (SELECT *, {det} AS det FROM {name}_s{n}))")
    out.append(f"{name} AS (SELECT * FROM {name}_{rounds})")
    return ", ".join(out)


def monotone(fit_rows: str, rows_: str, key: str, columns: str, name: str = "curved") -> str:
    """Isotonic regression by its formula (the largest over starts of the smallest over ends of a span's mean), and a line between its points."""
    return f"""pts AS (SELECT {key}, pred, count(*)::DOUBLE AS n, sum(y) AS s FROM {fit_rows} GROUP BY ALL),
cum AS MATERIALIZED (SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs, row_number() OVER w AS i FROM pts WINDOW w AS (PARTITION BY {key} ORDER BY pred)),
spans AS (SELECT a.{key}, a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM cum AS a JOIN cum AS b ON a.{key} = b.{key} AND b.i >= a.i),
low AS (SELECT {key}, b AS i, min(m) OVER (PARTITION BY {key}, a ORDER BY b DESC) AS m FROM spans),
g AS (SELECT {key}, i, max(m) AS g FROM low GROUP BY ALL),
knots AS MATERIALIZED (SELECT {key}, pred AS x, g, lead(pred) OVER w AS nx, lead(g) OVER w AS ng FROM cum JOIN g USING ({key}, i) WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{name} AS (
  SELECT {columns}, CASE WHEN k.x IS NULL THEN (SELECT arg_min(f.g, f.x) FROM knots AS f WHERE f.{key} = r.{key}) WHEN k.nx IS NULL THEN k.g ELSE k.g + (k.ng - k.g) * (r.pred - k.x) / (k.nx - k.x) END AS proba
  FROM {rows_} AS r ASOF LEFT JOIN knots AS k ON r.{key} = k.{key} AND r.pred >= k.x)"""


_LOGIT = f"""{roles(["ret5", "vol20"]).replace(rows(), rows("updown"))}, tr AS (SELECT * FROM roles WHERE split_role = 'train'), {irls("tr", "outer_fold_id", ["ret5", "vol20"])},
both_ AS (SELECT r.*, 1 / (1 + exp(-(b0 + b1 * ret5 + b2 * vol20))) AS pred FROM roles AS r JOIN logit USING (outer_fold_id) WHERE split_role = 'test'), ranks AS (SELECT *, {_avg_rank("pred")} AS k FROM both_)"""
_OOF = f"""{PANEL}, {FOLDS}, {INNER}, {rows("updown")}, {fit("rows_", "inner_folds", ["outer_fold_id", "inner_fold_id"], "ret5", "vol20", name="inf")}, {pred("rows_", "inner_folds", ["outer_fold_id", "inner_fold_id"], "ret5", "vol20", "oof", "inf")},
{fit("rows_", "folds", ["outer_fold_id"], "ret5", "vol20", name="of_")}, {pred("rows_", "folds", ["outer_fold_id"], "ret5", "vol20", "test_", "of_", where="")}"""


_OWN_ROLES = f"""{PANEL}, {rows(name='wide')}, rows_ AS (SELECT *, CAST(row_number() OVER ({_ROW}) - 1 AS INTEGER) AS own, CASE WHEN label_end_idx IS NOT NULL THEN CAST(row_number() OVER ({_ROW}) - 1 + {H} AS INTEGER) END AS own_end FROM wide),
  s AS (SELECT asset AS fa, count(*) AS n FROM rows_ GROUP BY 1),
  folds AS (SELECT fa, CAST(k AS INTEGER) AS outer_fold_id, 320 + 100 * k AS test_start, least(420 + 100 * k, n) AS test_end FROM s, range(0, 1000) AS g(k) WHERE 320 + 100 * k < n),
  roles AS (SELECT r.*, f.outer_fold_id, CASE WHEN own >= test_start THEN 'test' WHEN greatest(own + {GAP}, own_end) < test_start THEN 'train' ELSE 'embargo' END AS split_role FROM rows_ AS r JOIN folds AS f ON r.asset = f.fa AND own < test_end)"""
_OWN_BY = "asset, outer_fold_id"
_OWN_DRIFT = f"""{_OWN_ROLES}, long_ AS ({' UNION ALL '.join(f"SELECT {_OWN_BY}, split_role, '{f}' AS feature, {f} AS x FROM roles" for f in ('ret5', 'vol20'))}),
  m AS (SELECT {_OWN_BY}, feature, avg(x) {_TR} AS m1, stddev_samp(x) {_TR} AS s1, avg(x) {_TE} AS m2, stddev_samp(x) {_TE} AS s2, {', '.join(f'quantile_cont(x, {p / 100}) {_TE} - quantile_cont(x, {p / 100}) {_TR} AS d{p}' for p in (10, 50, 90))} FROM long_ GROUP BY ALL),
  e AS (SELECT {_OWN_BY}, feature, {', '.join(f'quantile_cont(x, {i / 10}) {_TR} AS q{i}' for i in range(1, 10))} FROM long_ GROUP BY ALL),
  b AS (SELECT l.asset, l.outer_fold_id, l.feature, split_role, {' + '.join(f'CAST(q{i} < x AS INTEGER)' for i in range(1, 10))} AS bin FROM long_ AS l JOIN e ON e.asset = l.asset AND e.outer_fold_id = l.outer_fold_id AND e.feature = l.feature WHERE x IS NOT NULL),
  c AS (SELECT {_OWN_BY}, feature, bin, (count(*) {_TR})::DOUBLE AS a, (count(*) {_TE})::DOUBLE AS b FROM b GROUP BY ALL),
  both2 AS (SELECT * FROM roles WHERE ret5 IS NOT NULL AND vol20 IS NOT NULL),
  told AS (
    SELECT {_OWN_BY}, feature, 'mean_shift' AS metric, (m2 - m1) / nullif(s1, 0) AS value FROM m UNION ALL SELECT {_OWN_BY}, feature, 'std_ratio', s2 / nullif(s1, 0) FROM m
    UNION ALL {' UNION ALL '.join(f"SELECT {_OWN_BY}, feature, 'shift_{p}', d{p} / nullif(s1, 0) FROM m" for p in (10, 50, 90))}
    UNION ALL SELECT {_OWN_BY}, feature, 'psi', {_PSI} FROM c GROUP BY {_OWN_BY}, feature
    UNION ALL SELECT {_OWN_BY}, '*', 'corr_change', abs(covar_pop(ret5, vol20) {_TE} / (sqrt(var_pop(ret5) {_TE}) * sqrt(var_pop(vol20) {_TE})) - covar_pop(ret5, vol20) {_TR} / (sqrt(var_pop(ret5) {_TR}) * sqrt(var_pop(vol20) {_TR}))) FROM both2 GROUP BY {_OWN_BY}),
  known AS (SELECT {_OWN_BY}, max(t_idx) AS known_at FROM roles WHERE split_role = 'test' GROUP BY ALL)"""

def _checks(p: str) -> str:
    """Deviance gap by fold and residual deviation by fold and asset of the base model ``p``, as {p}_gap and {p}_res with known_at as ka."""
    error = f"y - (c.my - c.b1 * c.ma - c.b2 * c.mb + c.b1 * ret5 + c.b2 * vol20)"
    return f"""{p}_both AS (
  SELECT f.outer_fold_id, asset, label_end_idx, t_idx >= test_start AS tested, {error} AS e FROM {p}_r AS r JOIN folds AS f ON t_idx >= train_start AND t_idx < test_end JOIN {p}_of AS c ON c.outer_fold_id = f.outer_fold_id
  WHERE ret5 IS NOT NULL AND vol20 IS NOT NULL AND y IS NOT NULL AND (t_idx >= test_start OR {E_} < test_start)),
{p}_gap0 AS (SELECT outer_fold_id, avg(e * e) FILTER (WHERE tested) - avg(e * e) FILTER (WHERE NOT tested) AS v, max(label_end_idx) AS ka FROM {p}_both GROUP BY 1),
{p}_gap AS (SELECT ka, arg_max(v, outer_fold_id) AS v FROM {p}_gap0 GROUP BY 1),
{p}_res0 AS (SELECT outer_fold_id, asset, stddev_samp(e) AS v, max(label_end_idx) AS ka FROM {p}_both WHERE tested GROUP BY 1, 2),
{p}_res AS (SELECT asset, ka, arg_max(v, outer_fold_id) AS v FROM {p}_res0 GROUP BY 1, 2)"""


_REQUIRED = ["ret5", "vol20", "p_ret", "p_vol", "psi_ret5", "psi_vol20", "shift_ret5", "shift_vol20", "g_ret", "s_ret", "g_vol", "s_vol", "drift_known"]
_REQUIRED_THERE = " AND ".join(f"{c} IS NOT NULL" for c in [*_REQUIRED, "y"])
REQUIRED = f"""{PANEL}, {FOLDS}, {INNER}, {', '.join(_META_PARTS)}, {_checks('p_ret')}, {_checks('p_vol')}, {rows('ret', 40, 'mrows')},
roles AS (SELECT r.*, f.outer_fold_id, CASE WHEN t_idx >= test_start THEN 'test' WHEN {E_} < test_start THEN 'train' ELSE 'embargo' END AS split_role FROM p_ret_r AS r JOIN folds AS f ON t_idx >= train_start AND t_idx < test_end),
long_ AS ({' UNION ALL '.join(f"SELECT outer_fold_id, split_role, '{f}' AS feature, {f} AS x FROM roles" for f in ('ret5', 'vol20'))}),
shifts AS (SELECT outer_fold_id, feature, (avg(x) {_TE} - avg(x) {_TR}) / nullif(stddev_samp(x) {_TR}, 0) AS shift FROM long_ GROUP BY 1, 2),
e AS (SELECT outer_fold_id, feature, {', '.join(f'quantile_cont(x, {i / 10}) {_TR} AS q{i}' for i in range(1, 10))} FROM long_ GROUP BY 1, 2),
b AS (SELECT l.outer_fold_id, l.feature, split_role, {' + '.join(f'CAST(q{i} < x AS INTEGER)' for i in range(1, 10))} AS bin FROM long_ AS l JOIN e ON e.outer_fold_id = l.outer_fold_id AND e.feature = l.feature WHERE x IS NOT NULL),
c AS (SELECT outer_fold_id, feature, bin, (count(*) {_TR})::DOUBLE AS a, (count(*) {_TE})::DOUBLE AS b FROM b GROUP BY 1, 2, 3),
psis AS (SELECT outer_fold_id, feature, {_PSI} AS psi FROM c GROUP BY 1, 2),
known AS (SELECT outer_fold_id, max(t_idx) AS ka FROM roles WHERE split_role = 'test' GROUP BY 1),
drift0 AS (SELECT outer_fold_id, any_value(ka) AS ka, {', '.join(f"max(psi) FILTER (WHERE feature = '{f}') AS psi_{f}, max(shift) FILTER (WHERE feature = '{f}') AS shift_{f}" for f in ('ret5', 'vol20'))} FROM psis JOIN shifts USING (outer_fold_id, feature) JOIN known USING (outer_fold_id) GROUP BY 1),
drift AS (SELECT * FROM drift0 QUALIFY row_number() OVER (PARTITION BY ka ORDER BY outer_fold_id DESC) = 1),
h1 AS (SELECT m.*, {', '.join(f'coalesce(d.{c}, 0.0::DOUBLE) AS {c}' for c in _REQUIRED[4:8])}, CAST(d.ka IS NOT NULL AS INTEGER) AS drift_known FROM mrows AS m ASOF LEFT JOIN drift AS d ON m.t_idx > d.ka),
h2 AS (SELECT m.*, coalesce(g.v, 0.0::DOUBLE) AS g_ret FROM h1 AS m ASOF LEFT JOIN p_ret_gap AS g ON m.t_idx > g.ka),
h3 AS (SELECT m.*, coalesce(g.v, 0.0::DOUBLE) AS g_vol FROM h2 AS m ASOF LEFT JOIN p_vol_gap AS g ON m.t_idx > g.ka),
h4 AS (SELECT m.*, coalesce(g.v, 0.0::DOUBLE) AS s_ret FROM h3 AS m ASOF LEFT JOIN p_ret_res AS g ON m.asset = g.asset AND m.t_idx > g.ka),
h5 AS (SELECT m.*, coalesce(g.v, 0.0::DOUBLE) AS s_vol FROM h4 AS m ASOF LEFT JOIN p_vol_res AS g ON m.asset = g.asset AND m.t_idx > g.ka),
meta AS (SELECT r.*, a.outer_fold_id AS fold, a.role, a.pred AS p_ret, b.pred AS p_vol FROM h5 AS r JOIN p_ret AS a USING (asset, bar_ts) JOIN p_vol AS b ON b.asset = a.asset AND b.bar_ts = a.bar_ts AND b.outer_fold_id = a.outer_fold_id AND b.role = a.role),
tr AS (SELECT m.* FROM meta AS m JOIN folds AS f ON m.fold = f.outer_fold_id AND m.t_idx >= f.train_start AND greatest(m.t_idx + {GAP}, m.label_end_idx) < f.test_start WHERE role = 'oof' AND label_end_idx IS NOT NULL AND {_REQUIRED_THERE}),
{_solved('tr', _REQUIRED, 'fold')},
out_ AS (SELECT fold AS outer_fold_id, asset, bar_ts, y, m_y + {' + '.join(f'b_{c} * ({c} - m_{c})' for c in _REQUIRED)} AS pred FROM meta JOIN mom USING (fold) JOIN beta USING (fold) WHERE role = 'test' AND {_REQUIRED_THERE})"""


ORACLES: dict[str, str] = {
    "run_required": f"WITH {REQUIRED}, m AS (SELECT outer_fold_id, {_METRICS} FROM out_ WHERE y IS NOT NULL GROUP BY 1) SELECT outer_fold_id, n, {_rd('rmse, mae, ic, hit_rate', 2)}, {_rd('r2', 1)} FROM m",
    "scale_per_asset": f"""WITH {_OWN_ROLES}, k AS (SELECT {_OWN_BY}, {', '.join(f'avg({f}) {_TR} AS m_{f}, stddev_samp({f}) {_TR} AS s_{f}' for f in ('ret5', 'vol20'))} FROM roles GROUP BY ALL)
  SELECT asset, bar_ts, outer_fold_id, {', '.join(f'round(({f} - m_{f}) / nullif(s_{f}, 0), 5) + 0.0::DOUBLE AS {f}' for f in ('ret5', 'vol20'))} FROM roles JOIN k USING (asset, outer_fold_id) WHERE split_role = 'test'""",
    "drift_per_asset": f"WITH {_OWN_DRIFT} SELECT asset, outer_fold_id, feature, metric, round(value, 5) + 0.0::DOUBLE AS value, known_at FROM told JOIN known USING (asset, outer_fold_id)",
    "logit_by_fold": f"""WITH {_LOGIT} SELECT outer_fold_id, count(*) AS n, round(avg(-(y * ln(least(greatest(pred, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) + (1 - y) * ln(1 - least(greatest(pred, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)))), 4) AS log_loss, round(avg((y - pred) ^ 2), 4) AS brier, round(avg(CAST(CAST(pred >= 0.5 AS DOUBLE) = y AS DOUBLE)), 4) AS accuracy,
    round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 4) AS auc FROM ranks GROUP BY 1""",
    "isotonic": f"""WITH {scored("updown")}, one AS (SELECT *, 0 AS k FROM scored), first_ AS (SELECT * FROM one WHERE outer_fold_id = 0), {monotone("first_", "one", "k", "r.*")}
  SELECT asset, bar_ts, outer_fold_id, {_rd("y, pred, proba", 5)} FROM curved WHERE outer_fold_id > 0""",
    "calibrated_by_fold": f"""WITH {_OOF}, {monotone("oof", "test_", "outer_fold_id", "r.*")} SELECT asset, bar_ts, outer_fold_id, {_rd("pred, proba", 5)} FROM curved""",
    "meta_full": f"WITH {META_FULL} SELECT outer_fold_id, asset, bar_ts, {_rd('y, pred, gap_health', 4)}, has_health FROM out_",
    "grid_two_params": TWO.replace("{n}", "n_test, "),
    "grid_by_mae": f"""{_NEST}, s AS ({_LOSS.format(w=0, loss=f"avg(abs({_ERROR}))", fits="fits")}), m AS (SELECT outer_fold_id, CAST(CASE alpha WHEN 0.01 THEN 0 WHEN 1.0 THEN 1 ELSE 2 END AS INTEGER) AS candidate, avg(score) AS score, count(*) AS n_inner FROM s GROUP BY 1, 2)
  SELECT outer_fold_id, candidate, round(score, 4) AS score, n_inner FROM m QUALIFY row_number() OVER (PARTITION BY outer_fold_id ORDER BY round(score, 12), candidate) = 1""",
    "predict_ridge_per_asset": _PER_ASSET,
    "run_per_asset": _PER_ASSET,
    "run_single_model": f"WITH {scored()} SELECT asset, bar_ts, outer_fold_id, {_rd('y, pred', 5)} FROM scored",
    "run_nested_tuning": TWO.replace("{n}", ""),
    "run_stacked": f"WITH {META} SELECT outer_fold_id, asset, bar_ts, {_rd('y, pred', 4)} FROM out_",
    "run_selector": f"WITH {SCORES}, {recent('scores', 'rec')}, k AS ({ranked('rec')}) SELECT outer_fold_id, candidate, round(score, 4) AS score, n_folds, rank, rank = 1 AS chosen, CAST(rank = 1 AS DOUBLE) AS weight FROM k",

    "bars_event_hourly": f"WITH {BARS} SELECT asset, bar_ts, {_rd('open, high, low, close, volume', 4)}, n_trades FROM bars",
    "bars_order_daily": f"""SELECT c_mktsegment AS asset, date_trunc('day', o_orderdate) AS bar_ts, round(arg_min(o_totalprice, (o_orderdate, o_orderkey)), 2) AS open, round(max(o_totalprice), 2) AS high,
  round(min(o_totalprice), 2) AS low, round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 2) AS close, round(sum(o_totalprice), 2) AS volume, count(*) AS n_trades
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "bars_part_daily": f"""WITH l AS (SELECT p_brand AS asset, date_trunc('day', l_shipdate) AS bar_ts, l_shipdate, l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
  b AS (SELECT asset, bar_ts, arg_min(price, (l_shipdate, l_orderkey, l_linenumber)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (l_shipdate, l_orderkey, l_linenumber)) AS close, sum(price) AS volume, count(*) AS n FROM l GROUP BY 1, 2)
  SELECT asset, count(*) AS n_bars, CAST(sum(n) AS BIGINT) AS n_trades, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts, {', '.join(f'round(sum({c}), 2) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM b GROUP BY 1""",
    "feat_field": f"""WITH {BARS}, f AS (SELECT asset, bar_ts, (open / nullif(lag(close) OVER ({_ROW}), 0) - 1) * 100.0::DOUBLE AS gap1, close / nullif(open, 0) - 1 AS body1 FROM bars)
  SELECT asset, bar_ts, {_rd('gap1, body1')} FROM f""",
    "last_known": f"WITH {BARS} SELECT asset, bar_ts, round(last_value(CASE WHEN n_trades > 1 THEN close END IGNORE NULLS) OVER ({_ROW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS known_close FROM bars",
    "regression_by_asset": f"WITH {PANEL}, {rows()} SELECT asset, CAST(regr_count(y, ret5) AS BIGINT) AS n, round(regr_slope(y, ret5), 6) AS slope, round(regr_intercept(y, ret5), 6) AS intercept, round(regr_r2(y, ret5), 6) AS r2 FROM rows_ WHERE ret5 IS NOT NULL AND y IS NOT NULL GROUP BY 1",
    "schema_normalise": """SELECT asset, bar_ts, round(value, 4) AS close, CAST(event_id AS DOUBLE) AS volume FROM (
  SELECT event_type AS asset, date_trunc('hour', ts) AS bar_ts, value, event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS r FROM events) AS x WHERE r = 1""",
    "universe_filter": f"WITH {BARS} SELECT asset, count(*) AS n, CAST(sum(n_trades) AS BIGINT) AS trades FROM bars WHERE asset IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY 1",
    "time_index": f"WITH {PANEL} SELECT asset, bar_ts, t_idx FROM panel",
    "feat_baseline": f"WITH {PANEL}, f AS (SELECT asset, bar_ts, {_BASE} FROM r1) SELECT asset, bar_ts, {_rd('ret1, ret5, ret20, mean20, vol20, mom20, range1, volz20')} FROM f",
    "feat_cross_asset": f"""WITH {PANEL}, m AS (SELECT *, avg(ret1) OVER (PARTITION BY bar_ts) AS market FROM r1),
  p AS (SELECT *, CASE WHEN ret1 IS NOT NULL AND market IS NOT NULL THEN ret1 * market END AS rm, market * market AS mm FROM m),
  v AS (SELECT *, {_trail('rm', 20, 'avg')} - {_trail('ret1', 20, 'avg')} * {_trail('market', 20, 'avg')} AS cov, {_trail('mm', 20, 'avg')} - {_trail('market', 20, 'avg')} * {_trail('market', 20, 'avg')} AS var FROM p)
  SELECT asset, bar_ts, round(ret1 - market, 5) AS xs_demeaned, CASE WHEN ret1 IS NOT NULL THEN round(percent_rank() OVER (PARTITION BY bar_ts ORDER BY ret1 NULLS FIRST), 5) END AS xs_rank,
    count(ret1) OVER (PARTITION BY bar_ts) AS xs_count, CASE WHEN abs(var) > 1e-18 THEN round(cov / var, 5) END AS beta20 FROM v""",
    "feat_regime": f"""WITH {PANEL}, v AS (SELECT *, {_trail('ret1', 20, 'stddev_samp')} AS vol, {_trail('close', 20, 'avg')} AS mean FROM r1),
  e AS (SELECT *, CASE WHEN count(vol) OVER w = 60 THEN quantile_cont(vol, 0.75) OVER w END AS vol_edge FROM v WINDOW w AS ({_ROW} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
  SELECT asset, bar_ts, round(vol_edge, 6) AS vol_edge, CASE WHEN vol_edge IS NOT NULL AND vol IS NOT NULL THEN CAST(CAST(vol > vol_edge AS INTEGER) AS DOUBLE) END AS high_vol, CASE WHEN mean IS NOT NULL THEN CAST(sign(close - mean) AS DOUBLE) END AS trend FROM e""",
    "feat_combined": f"""WITH {PANEL}, v AS (SELECT *, {_trail('ret1', 20, 'stddev_samp')} AS vol, {_trail('close', 20, 'avg')} AS mean, close / nullif(lag(close, 5) OVER ({_ROW}), 0) - 1 AS ret5 FROM r1),
  e AS (SELECT *, CASE WHEN count(vol) OVER w = 60 THEN quantile_cont(vol, 0.75) OVER w END AS vol_edge FROM v WINDOW w AS ({_ROW} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
  SELECT asset, bar_ts, round(ret5, 6) AS ret5, round(vol, 6) AS vol20, CASE WHEN vol_edge IS NOT NULL AND vol IS NOT NULL THEN CAST(CAST(vol > vol_edge AS INTEGER) AS DOUBLE) END AS high_vol, CASE WHEN mean IS NOT NULL THEN CAST(sign(close - mean) AS DOUBLE) END AS trend FROM e""",
    **{f"tgt_{n}": _tgt(TARGETS[k].format(h=H)) for n, k in (("fwd_return", "ret"), ("fwd_vol", "vol"), ("updown", "updown"), ("max_upside", "upside"), ("max_drawdown", "drawdown"))},
    "tgt_peak_to_trough": f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER ({_ROW}) AS i, count(*) OVER (PARTITION BY asset) AS c FROM r1),
  top AS (SELECT a.asset, a.bar_ts, b.i, b.close, max(b.close) OVER (PARTITION BY a.asset, a.bar_ts ORDER BY b.i) AS high_ FROM n AS a JOIN n AS b ON a.asset = b.asset AND b.i BETWEEN a.i AND a.i + {H} WHERE a.i + {H} <= a.c),
  d AS (SELECT asset, bar_ts, least(0.0::DOUBLE, min(close / nullif(high_, 0) - 1)) AS y FROM top GROUP BY 1, 2)
  SELECT n.asset, n.bar_ts, round(d.y, 6) + 0.0::DOUBLE AS y, CAST(lead(t_idx, {H}) OVER (PARTITION BY n.asset ORDER BY n.bar_ts) AS DOUBLE) AS label_end_idx FROM n LEFT JOIN d ON n.asset = d.asset AND n.bar_ts = d.bar_ts""",
    "folds_expanding": f"WITH {PANEL}, {FOLDS} SELECT * FROM folds",
    "folds_rolling": f"WITH {PANEL}, {ROLLING} SELECT * FROM folds",
    "folds_nested": f"WITH {PANEL}, {FOLDS}, {INNER} SELECT * FROM inner_folds",
    "folds_per_asset": f"""WITH {BARS}, s AS (SELECT asset, count(*) AS n FROM bars GROUP BY 1)
  SELECT asset, CAST(k AS INTEGER) AS outer_fold_id, CAST(0 AS INTEGER) AS train_start, CAST(300 + 100 * k AS INTEGER) AS train_end, CAST(320 + 100 * k AS INTEGER) AS test_start, CAST(least(420 + 100 * k, n) AS INTEGER) AS test_end
  FROM s, range(0, 1000) AS g(k) WHERE 320 + 100 * k < n""",
    "split_assign": f"""WITH {PANEL}, {FOLDS}, {rows()}
  SELECT outer_fold_id, CASE WHEN t_idx >= test_start AND t_idx < test_end THEN 'test' WHEN {E_} < test_start THEN 'train' ELSE 'embargo' END AS split_role, count(*) AS n, max(label_end_idx) AS last_label
  FROM rows_ JOIN folds ON t_idx >= train_start AND t_idx < test_end WHERE label_end_idx IS NOT NULL GROUP BY 1, 2""",
    "fit_ridge_by_fold": f"{_FIT_BY(FOLDS)}, o AS ({_COEF.format(k='outer_fold_id')}) SELECT outer_fold_id, alpha, n_train, feature, round(coef, 5) AS coef FROM o",
    "fit_ridge_rolling": f"{_FIT_BY(ROLLING)}, o AS ({_COEF.format(k='outer_fold_id')}) SELECT outer_fold_id, alpha, n_train, feature, round(coef, 5) AS coef FROM o",
    "fit_ridge_per_asset": f"""WITH {PANEL}, {rows(name='wide')}, rows_ AS (SELECT * REPLACE (CAST(row_number() OVER ({_ROW}) - 1 AS INTEGER) AS t_idx, CASE WHEN label_end_idx IS NOT NULL THEN CAST(row_number() OVER ({_ROW}) - 1 + {H} AS INTEGER) END AS label_end_idx) FROM wide),
  s AS (SELECT asset AS fa, count(*) AS n FROM rows_ GROUP BY 1),
  folds AS (SELECT fa AS asset, CAST(k AS INTEGER) AS outer_fold_id, 0 AS train_start, 320 + 100 * k AS test_start FROM s, range(0, 1000) AS g(k) WHERE 320 + 100 * k < n),
  {fit('rows_', 'folds', ['asset', 'outer_fold_id'], 'ret5', 'vol20', own='AND r.asset = f.asset')},
  o AS ({_COEF.format(k='asset, outer_fold_id')}) SELECT asset, outer_fold_id, alpha, n_train, feature, round(coef, 5) AS coef FROM o""",
    "predict_ridge_by_fold": f"WITH {scored()} SELECT asset, bar_ts, outer_fold_id, {_rd('y, pred', 5)} FROM scored",
    "scale_train_only": f"""WITH {roles(DRIFT)}, s AS (SELECT outer_fold_id, {', '.join(f'avg({f}) {_TR} AS m_{f}, stddev_samp({f}) {_TR} AS s_{f}' for f in DRIFT)} FROM roles GROUP BY 1)
  SELECT asset, bar_ts, outer_fold_id, {', '.join(f'round(({f} - m_{f}) / nullif(s_{f}, 0), 5) + 0.0::DOUBLE AS {f}' for f in DRIFT)} FROM roles JOIN s USING (outer_fold_id) WHERE split_role = 'test'""",
    "clip_train_only": f"""WITH {roles(DRIFT)}, s AS (SELECT outer_fold_id, {', '.join(f'quantile_cont({f}, 0.01) {_TR} AS l_{f}, quantile_cont({f}, 0.99) {_TR} AS h_{f}' for f in DRIFT)} FROM roles GROUP BY 1)
  SELECT asset, bar_ts, outer_fold_id, {', '.join(f'round(least(greatest({f}, l_{f}), h_{f}), 6) AS {f}' for f in DRIFT)} FROM roles JOIN s USING (outer_fold_id) WHERE split_role = 'test'""",
    "select_topk_corr": f"""WITH {roles(WIDE)}, l AS ({' UNION ALL '.join(f"SELECT outer_fold_id, '{f}' AS feature, {f} AS x, y FROM roles WHERE split_role = 'train'" for f in WIDE)}),
  c AS (SELECT outer_fold_id, feature, covar_pop(x, y) / (sqrt(var_pop(x)) * sqrt(var_pop(y))) AS corr FROM l GROUP BY 1, 2),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY outer_fold_id ORDER BY round(abs(corr), 9) DESC, feature) AS INTEGER) AS rank FROM c)
  SELECT outer_fold_id, feature, round(corr, 6) AS corr, rank FROM k WHERE rank <= 3""",
    "grid_inner_scores": f"{_INNER_SCORES} SELECT outer_fold_id, inner_fold_id, round(alpha, 4) AS alpha, n_test, round(mse, 4) AS mse FROM inner_scores",
    "grid_best": f"""{_INNER_SCORES}, m AS (SELECT outer_fold_id, alpha, avg(mse) AS mse, count(*) AS n_inner FROM inner_scores GROUP BY 1, 2)
  SELECT outer_fold_id, round(alpha, 4) AS alpha, round(mse, 4) AS mse, n_inner, CAST(row_number() OVER (PARTITION BY outer_fold_id ORDER BY round(mse, 12), alpha DESC) AS INTEGER) AS rank FROM m""",
    "oof_predictions": f"""WITH {PANEL}, {FOLDS}, {INNER}, {rows()}, {fit('rows_', 'inner_folds', ['outer_fold_id', 'inner_fold_id'], 'ret5', 'vol20')},
  {pred('rows_', 'inner_folds', ['outer_fold_id', 'inner_fold_id'], 'ret5', 'vol20', where='')} SELECT outer_fold_id, inner_fold_id, asset, bar_ts, round(pred, 5) AS pred FROM scored""",
    "meta_required": f"WITH {META} SELECT outer_fold_id, asset, bar_ts, {_rd('y, pred', 4)} FROM out_",
    "diag_gap": f"WITH {GAPS} SELECT outer_fold_id, round(value, 4) AS value, known_at, 'train_test_deviance_gap' AS metric FROM gaps",
    "diag_drift_moments": f"""WITH {roles(DRIFT)}, {_LONG}, s AS (SELECT outer_fold_id, feature, avg(x) {_TR} AS m1, stddev_samp(x) {_TR} AS s1, avg(x) {_TE} AS m2, stddev_samp(x) {_TE} AS s2 FROM long_ GROUP BY 1, 2)
  SELECT outer_fold_id, feature, round((m2 - m1) / nullif(s1, 0), 6) AS mean_shift, round(s2 / nullif(s1, 0), 6) AS std_ratio FROM s""",
    "diag_drift_quantile": f"""WITH {roles(DRIFT)}, {_LONG}, s AS (SELECT outer_fold_id, feature, stddev_samp(x) {_TR} AS s1, {', '.join(f'quantile_cont(x, {p / 100}) {_TE} - quantile_cont(x, {p / 100}) {_TR} AS d{p}' for p in (10, 50, 90))} FROM long_ GROUP BY 1, 2)
  SELECT outer_fold_id, feature, {', '.join(f'round(d{p} / nullif(s1, 0), 6) AS shift_{p}' for p in (10, 50, 90))} FROM s""",
    "diag_psi": f"""WITH {roles(DRIFT)}, {_LONG}, e AS (SELECT outer_fold_id, feature, {', '.join(f'quantile_cont(x, {i / 10}) {_TR} AS q{i}' for i in range(1, 10))} FROM long_ GROUP BY 1, 2),
  b AS (SELECT l.outer_fold_id, l.feature, split_role, {' + '.join(f'CAST(q{i} < x AS INTEGER)' for i in range(1, 10))} AS bin FROM long_ AS l JOIN e ON e.outer_fold_id = l.outer_fold_id AND e.feature = l.feature),
  c AS (SELECT outer_fold_id, feature, bin, (count(*) {_TR})::DOUBLE AS a, (count(*) {_TE})::DOUBLE AS b FROM b GROUP BY 1, 2, 3)
  SELECT outer_fold_id, feature, round({_PSI}, 6) AS psi FROM c GROUP BY 1, 2""",
    "diag_drift_corr": f"""WITH {roles(DRIFT)}, s AS (SELECT outer_fold_id, {', '.join(f"abs(covar_pop({a}, {b}) {_TE} / (sqrt(var_pop({a}) {_TE}) * sqrt(var_pop({b}) {_TE})) - covar_pop({a}, {b}) {_TR} / (sqrt(var_pop({a}) {_TR}) * sqrt(var_pop({b}) {_TR}))) AS d{i}" for i, (a, b) in enumerate(_CORRS))} FROM roles GROUP BY 1)
  SELECT outer_fold_id, round((d0 + d1 + d2) / 3, 6) AS corr_change FROM s""",
    "diag_resid_std": f"WITH {scored()} SELECT outer_fold_id, asset, round(stddev_samp(y - pred), 4) AS value, count(*) AS n, max(label_end_idx) AS known_at FROM scored GROUP BY 1, 2",
    "diag_disagreement": f"""WITH {CANDIDATES}, w AS (SELECT *, avg(pred) OVER r AS mean, stddev_pop(pred) OVER r AS spread, count(*) OVER r AS n FROM candidates WINDOW r AS (PARTITION BY outer_fold_id, asset, bar_ts)),
  c AS (SELECT outer_fold_id, candidate, covar_pop(pred, mean) / (sqrt(var_pop(pred)) * sqrt(var_pop(mean))) AS corr FROM w WHERE n > 1 GROUP BY 1, 2),
  d AS (SELECT outer_fold_id, avg(spread) AS value, CAST(count(DISTINCT (asset, bar_ts)) AS BIGINT) AS n_rows FROM w WHERE n > 1 GROUP BY 1)
  SELECT outer_fold_id, round(any_value(value), 5) AS value, round(1 - avg(corr), 5) AS one_less_corr, any_value(n_rows) AS n_rows FROM c JOIN d USING (outer_fold_id) GROUP BY 1""",
    "diag_coef_stability": f"""{_FIT_BY(FOLDS)}, o AS ({_COEF.format(k='outer_fold_id')}), l AS (SELECT *, lag(coef) OVER w AS last_, stddev_samp(coef) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS std FROM o WHERE feature <> 'intercept' WINDOW w AS (PARTITION BY feature ORDER BY outer_fold_id))
  SELECT outer_fold_id, round(sqrt(sum((coef - last_) ^ 2)), 5) AS change, round(avg(CAST(sign(coef) <> sign(last_) AS DOUBLE)), 5) AS sign_flips, round(avg(std), 5) AS mean_std FROM l WHERE last_ IS NOT NULL GROUP BY 1""",
    "diag_calibration": f"""WITH {scored('updown')}, c AS (SELECT outer_fold_id, y, least(greatest(pred, 0.0::DOUBLE), 1.0::DOUBLE) AS p FROM scored), b AS (SELECT outer_fold_id, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM c GROUP BY 1, 2)
  SELECT outer_fold_id, round(sum(n * abs(mp - my)) / sum(n), 5) AS value FROM b GROUP BY 1""",
    "diag_calibration_regression": f"WITH {scored()} SELECT outer_fold_id, round(abs(avg(pred) - avg(y)), 5) AS value FROM scored GROUP BY 1",
    "diag_residual_profile": f"""WITH {scored()}, e AS (SELECT *, y - pred AS e, lag(y - pred) OVER (PARTITION BY outer_fold_id, asset ORDER BY bar_ts) AS e1 FROM scored)
  SELECT outer_fold_id, round(avg(e), 4) AS bias, round(quantile_cont(e, 0.05), 4) AS q05, round(quantile_cont(e, 0.95), 4) AS q95,
    round(covar_pop(e, e1) / (sqrt(var_pop(e) FILTER (WHERE e1 IS NOT NULL)) * sqrt(var_pop(e1))), 4) AS autocorr FROM e GROUP BY 1""",
    "metrics_by_fold": f"WITH {scored()}, m AS (SELECT outer_fold_id, {_METRICS} FROM scored GROUP BY 1) SELECT outer_fold_id, n, {_rd('rmse, mae, r2, ic, hit_rate', 5)} FROM m",
    "metrics_rank_ic": f"WITH {scored()}, r AS (SELECT outer_fold_id, {_avg_rank('y')} AS a, {_avg_rank('pred')} AS b FROM scored) SELECT outer_fold_id, round(covar_pop(a, b) / (sqrt(var_pop(a)) * sqrt(var_pop(b))), 5) AS rank_ic FROM r GROUP BY 1",
    "metrics_classification": f"""WITH {scored('updown')}, c AS (SELECT outer_fold_id, y, least(greatest(pred, 0.01::DOUBLE), 0.99::DOUBLE) AS pred FROM scored), r AS (SELECT *, {_avg_rank('pred')} AS k FROM c)
  SELECT outer_fold_id, count(*) AS n, round(avg(-(y * ln(pred) + (1 - y) * ln(1 - pred))), 4) AS log_loss, round(avg((y - pred) ^ 2), 4) AS brier, round(avg(CAST(CAST(pred >= 0.5 AS DOUBLE) = y AS DOUBLE)), 4) AS accuracy,
    round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 4) AS auc FROM r GROUP BY 1""",
    "derived_resid_std": f"WITH {scored()} SELECT asset, bar_ts, CASE WHEN count(y - pred) OVER w >= 2 THEN round(stddev_samp(y - pred) OVER w, 4) END AS resid_std FROM scored WINDOW w AS ({_ROW} ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)",
    "derived_health": f"WITH {scored()} SELECT asset, bar_ts, CASE WHEN count(y - pred) OVER w >= 2 THEN round(avg(abs(y - pred)) OVER w, 4) END AS health FROM scored WINDOW w AS ({_ROW} ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)",
    "derived_disagreement": f"WITH {CANDIDATES} SELECT asset, bar_ts, outer_fold_id, round(stddev_pop(pred), 5) AS disagreement, round(max(pred) - min(pred), 5) AS pred_range FROM candidates GROUP BY 1, 2, 3",
    "project_health": f"WITH {GAPS} SELECT p.asset, p.bar_ts, p.t_idx, round(g.value, 4) AS gap_health, CAST(g.known_at IS NOT NULL AS INTEGER) AS has_health FROM panel AS p ASOF LEFT JOIN gaps AS g ON p.t_idx > g.known_at",
    "project_by_asset": f"""WITH {scored()}, g AS (SELECT outer_fold_id, asset, stddev_samp(y - pred) AS v, max(label_end_idx) AS known_at FROM scored GROUP BY 1, 2)
  SELECT p.asset, p.bar_ts, p.t_idx, round(g.v, 4) AS resid_std, CAST(g.known_at IS NOT NULL AS INTEGER) AS has_health FROM panel AS p ASOF LEFT JOIN g ON p.asset = g.asset AND p.t_idx > g.known_at""",
    "select_best_recent": f"WITH {SCORES}, {recent('scores', 'rec')}, k AS ({ranked('rec')}) SELECT outer_fold_id, candidate, round(score, 4) AS score, n_folds, rank, rank = 1 AS chosen, CAST(rank = 1 AS DOUBLE) AS weight FROM k",
    "blend_weights": f"WITH {SCORES}, {recent('scores', 'rec')}, k AS ({ranked('rec')}) SELECT outer_fold_id, candidate, round(score, 4) AS score, n_folds, rank, rank = 1 AS chosen, round((1 / score) / sum(1 / score) OVER (PARTITION BY outer_fold_id), 4) AS weight FROM k",
    "select_diag_aware": f"""WITH {SCORES}, {recent('scores', 'rec')}, pen AS (SELECT candidate, outer_fold_id, abs(avg(y - pred)) AS score, max(label_end_idx) AS known_at, any_value(test_start) AS test_start FROM candidates JOIN folds USING (outer_fold_id) GROUP BY 1, 2),
  {recent('pen', 'prec')}, b AS (SELECT a.candidate, a.outer_fold_id, a.score + coalesce(p.score, 0) AS score, a.n_folds, p.score AS penalty FROM rec AS a LEFT JOIN prec AS p ON p.candidate = a.candidate AND p.outer_fold_id = a.outer_fold_id), k AS ({ranked('b')})
  SELECT outer_fold_id, candidate, round(score, 4) AS score, n_folds, round(penalty, 4) AS penalty, rank, rank = 1 AS chosen, CAST(rank = 1 AS DOUBLE) AS weight FROM k""",
    "select_regime": f"""WITH {CANDIDATES}, scores AS (SELECT CAST(vol20 > 1.0 AS INTEGER) AS regime, candidate, outer_fold_id, avg((y - pred) ^ 2) AS score, max(label_end_idx) AS known_at, any_value(test_start) AS test_start FROM candidates JOIN folds USING (outer_fold_id) GROUP BY 1, 2, 3),
  {recent('scores', 'rec', 'regime')}, k AS ({ranked('rec', 'regime')}) SELECT outer_fold_id, regime, candidate, round(score, 4) AS score, n_folds, rank, rank = 1 AS chosen, CAST(rank = 1 AS DOUBLE) AS weight FROM k""",
    "blend_predictions": f"""WITH {SCORES}, {recent('scores', 'rec')}, w AS (SELECT outer_fold_id, candidate, (1 / score) / sum(1 / score) OVER (PARTITION BY outer_fold_id) AS weight FROM rec)
  SELECT outer_fold_id, asset, bar_ts, round(max(y), 4) AS y, round(sum(weight * pred) / sum(weight), 4) AS pred FROM candidates JOIN w USING (outer_fold_id, candidate) GROUP BY 1, 2, 3""",
    "subgroup_rollup": f"WITH {scored()} SELECT CAST(outer_fold_id AS DOUBLE) AS outer_fold_id, asset, count(*) AS n, round(sqrt(avg((y - pred) ^ 2)), 4) AS rmse, round(avg(abs(y - pred)), 4) AS mae FROM scored GROUP BY ROLLUP (outer_fold_id, asset)",
    "residuals_by_day": f"WITH {scored()} SELECT asset, date_trunc('day', bar_ts) AS period, round(avg(y - pred), 4) AS bias, round(stddev_pop(y - pred), 4) AS std, count(*) AS n FROM scored GROUP BY 1, 2",
    "compare_feature_sets": f"""WITH {CANDIDATES}, m AS (SELECT outer_fold_id, candidate, sqrt(avg((y - pred) ^ 2)) AS rmse FROM candidates GROUP BY 1, 2)
  SELECT m.outer_fold_id, m.candidate, round(m.rmse, 4) AS rmse, round(m.rmse - b.rmse, 4) AS delta FROM m LEFT JOIN m AS b ON b.outer_fold_id = m.outer_fold_id AND b.candidate = 'a'""",
    "corr_assets": f"""WITH {PANEL}, p AS (SELECT a.asset, b.asset AS other, a.ret1 AS x, b.ret1 AS y FROM r1 AS a JOIN r1 AS b ON a.bar_ts = b.bar_ts AND a.asset < b.asset WHERE a.ret1 IS NOT NULL AND b.ret1 IS NOT NULL)
  SELECT asset, other, count(*) AS n, round(covar_pop(x, y) / (sqrt(var_pop(x)) * sqrt(var_pop(y))), 5) AS corr FROM p GROUP BY 1, 2""",
    "lineage": """WITH RECURSIVE e AS (
    SELECT concat('n', n_nationkey) AS artifact_id, concat('r', n_regionkey) AS upstream_id FROM nation UNION ALL SELECT concat('s', s_suppkey) AS artifact_id, concat('n', s_nationkey) AS upstream_id FROM supplier UNION ALL SELECT concat('r', r_regionkey) AS artifact_id, 'root' AS upstream_id FROM region),
  a AS (SELECT artifact_id, upstream_id AS ancestor_id, 1 AS depth FROM e UNION ALL SELECT a.artifact_id, e.upstream_id AS ancestor_id, a.depth + 1 AS depth FROM a JOIN e ON e.artifact_id = a.ancestor_id)
  SELECT artifact_id, ancestor_id, CAST(min(depth) AS INTEGER) AS depth FROM a GROUP BY 1, 2""",
}
