"""The queries once more as SQL over the same tables, for comparison in DuckDB."""

from __future__ import annotations

from collections.abc import Iterable

from panelmill.operators import features as feat
from workload.queries import CORR_COLUMNS

# --- the two feeds --------------------------------------------------------------

HOURLY_FEEDS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              CAST(61000 + ascii(event_type) AS INTEGER) AS ptid FROM events),
prices AS (SELECT CASE WHEN k <> 97 THEN ts END AS "timestamp", event_type AS "Name", ptid AS "PTID",
                  CASE WHEN k <> 89 THEN value * 10 - 505 END AS "LBMP",
                  CAST(user_id % 10 AS DOUBLE) / 10 AS "Marginal_Cost_Losses",
                  CAST(k * 40 - 2000 AS DOUBLE) AS "Marginal_Cost_Congestion" FROM ev),
loads AS (SELECT ts AS "timestamp", CASE WHEN event_id % 2 = 0 THEN 'EST' ELSE 'EDT' END AS time_zone,
                 event_type AS "Name", ptid AS "PTID",
                 CASE WHEN k <> 83 THEN CAST(k * 100 - 300 AS DOUBLE) END AS "Load" FROM ev)"""

DAILY_FEEDS = """
prices AS (SELECT l_shipdate AS "timestamp", n_name AS "Name", n_nationkey AS "PTID",
                  l_extendedprice / l_quantity AS "LBMP", l_tax AS "Marginal_Cost_Losses",
                  l_discount AS "Marginal_Cost_Congestion"
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
loads AS (SELECT o_orderdate AS "timestamp", 'EST' AS time_zone, n_name AS "Name", n_nationkey AS "PTID",
                 o_totalprice AS "Load"
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

CLEANED = """
clean_p AS (SELECT "timestamp", "Name", "PTID", coalesce("LBMP", 0.0) AS "LBMP",
                   coalesce("Marginal_Cost_Losses", 0.0) AS "Marginal_Cost_Losses",
                   coalesce("Marginal_Cost_Congestion", 0.0) AS "Marginal_Cost_Congestion",
                   coalesce("LBMP", 0.0) < -500 OR coalesce("LBMP", 0.0) > 2000 AS is_extreme_price
            FROM prices WHERE "timestamp" IS NOT NULL),
clean_l AS (SELECT "timestamp", time_zone, "Name", "PTID", coalesce("Load", 0.0) AS "Load",
                   coalesce("Load", 0.0) < 0 AS is_negative_load
            FROM loads WHERE "timestamp" IS NOT NULL)"""

COMPONENT_MEANS = """avg("Marginal_Cost_Losses") AS "Marginal_Cost_Losses_avg",
        avg("Marginal_Cost_Congestion") AS "Marginal_Cost_Congestion_avg\""""


def slot(grain: str, alias: str = "timestamp") -> str:
    return f"""date_trunc('{grain}', "timestamp") AS "{alias}\""""


def price_rollup(source: str, stats: str, grain: str = "hour", alias: str = "timestamp") -> str:
    extras = {
        "count": "count(*) AS price_count",
        "std": 'stddev_samp("LBMP") AS "LBMP_std"',
        "full": 'min("LBMP") AS "LBMP_min", max("LBMP") AS "LBMP_max", stddev_samp("LBMP") AS "LBMP_std", '
        "count(*) AS price_readings",
    }[stats]
    return f"""SELECT {slot(grain, alias)}, "Name", "PTID", avg("LBMP") AS "LBMP_avg", {COMPONENT_MEANS}, {extras}
        FROM {source} GROUP BY ALL"""


def load_rollup(source: str, grain: str = "hour", alias: str = "timestamp", labelled: bool = False) -> str:
    extra = ', arg_min(time_zone, ("timestamp", time_zone)) AS "Time_Zone"' if labelled else ""
    key = ', "PTID"' if labelled else ""
    return f"""SELECT {slot(grain, alias)}, "Name"{key}, avg("Load") AS "Load_MW"{extra}
        FROM {source} GROUP BY {slot(grain, alias).split(" AS ")[0]}, "Name"{key}"""


FIRST_LOAD = """SELECT date_trunc('hour', "timestamp") AS "timestamp", "Name", "PTID", "Load" AS "Load_MW", time_zone
    FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', "timestamp"), "Name"
          ORDER BY "timestamp", "PTID", "Load", time_zone) AS rn FROM clean_l) WHERE rn = 1"""


def calendar(ts: str, extras: Iterable[str] = ()) -> str:
    hour, month, dow = f"hour({ts})", f"month({ts})", f"(dayofweek({ts}) + 1)"
    parts = [
        f"CAST({hour} AS INTEGER) AS hour",
        f"CAST({dow} AS INTEGER) AS day_of_week",
        f"CAST(day({ts}) AS INTEGER) AS day_of_month",
        f"CAST({month} AS INTEGER) AS month",
        f"CAST(year({ts}) AS INTEGER) AS year",
        f"CASE WHEN {dow} IN (1, 7) THEN 1 ELSE 0 END AS is_weekend",
        f"sin(2 * pi() * {hour} / 24) AS hour_sin",
        f"cos(2 * pi() * {hour} / 24) AS hour_cos",
        f"sin(2 * pi() * {month} / 12) AS month_sin",
        f"cos(2 * pi() * {month} / 12) AS month_cos",
    ]
    if "peak" in extras:
        parts.append(f"CASE WHEN {hour} BETWEEN 7 AND 22 THEN 1 ELSE 0 END AS is_peak_hour")
    if "week" in extras:
        parts += [f"CAST(weekofyear({ts}) AS INTEGER) AS week_of_year", f"dayname({ts}) AS day_name"]
    return ", ".join(parts)


# --- panels ---------------------------------------------------------------------


def panel_ctes(feed: str = HOURLY_FEEDS, grain: str = "hour") -> str:
    return f"""{feed},{CLEANED},
hp AS ({price_rollup("clean_p", "count", grain)}),
hl AS ({load_rollup("clean_l", grain)}),
panel AS (SELECT hp.*, hl."Load_MW", {calendar('hp."timestamp"')}
          FROM hp JOIN hl ON hp."timestamp" = hl."timestamp" AND hp."Name" = hl."Name")"""


def window_ctes(ts: str, ties: str = '"PTID"') -> str:
    order = f'PARTITION BY "Name" ORDER BY "{ts}", {ties}'
    return f"""WINDOW w AS ({order}),
        w24 AS ({order} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
        w168 AS ({order} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)"""


SQL_STAT = {"ma": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def rolled(value: str, n: int, stats: Iterable[str], name: str) -> list[str]:
    return [f'{SQL_STAT[s]}("{value}") OVER w{n} AS "{name.format(stat=s, n=n)}"' for s in stats]


def lagged(value: str, steps: Iterable[int], name: str) -> list[str]:
    return [f'lag("{value}", {k}) OVER w AS "{name.format(k=k)}"' for k in steps]


def moved(value: str, k: int, name: str) -> str:
    return f'"{value}" - lag("{value}", {k}) OVER w AS "{name}"'


FOUR = ("ma", "std", "min", "max")
MODULAR_WINDOWS = [
    *[c for v in ("LBMP_avg", "Load_MW") for n in (24, 168) for c in rolled(v, n, FOUR, v + "_{stat}_{n}")],
    *[c for v in ("LBMP_avg", "Load_MW") for c in lagged(v, (1, 2, 3, 6, 12, 24), v + "_lag_{k}")],
    moved("LBMP_avg", 24, "price_momentum_24h"),
    moved("Load_MW", 1, "load_change_1h"),
]


def ratio(numerator: str, denominator: str, default: int) -> str:
    return f"CASE WHEN {denominator} <> 0 THEN {numerator} / {denominator} ELSE {default}.0 END"


IMPACT = ratio('abs("Marginal_Cost_Congestion_avg")', 'abs("LBMP_avg")', 0)
PEAK = 'CASE WHEN "Load_MW" > "Load_MW_ma_24" + "Load_MW_std_24" THEN 1 ELSE 0 END'
VOLATILITY = ratio('"LBMP_avg_std_24"', 'abs("LBMP_avg_ma_24")', 0)
ZSCORE = ratio('("LBMP_avg" - "LBMP_avg_ma_24")', '"LBMP_avg_std_24"', 0)
LOAD_RATIO = ratio('"Load_MW"', '"Load_MW_ma_24"', 1)


def threshold(k: float) -> str:
    return f'"LBMP_avg_ma_24" + {float(k)} * "LBMP_avg_std_24"'


def spike(k: float) -> str:
    return f'CASE WHEN "LBMP_avg" > {threshold(k)} THEN 1 ELSE 0 END'


def cause(k: float) -> str:
    return f"""CASE WHEN {spike(k)} = 1 AND abs("Marginal_Cost_Congestion_avg") > abs("LBMP_avg") * 0.5 THEN 'congestion'
        WHEN {spike(k)} = 1 AND {PEAK} = 1 THEN 'high_demand'
        WHEN {spike(k)} = 1 THEN 'other' ELSE 'none' END"""


def feature_ctes(feed: str = HOURLY_FEEDS, grain: str = "hour") -> str:
    return f"""{panel_ctes(feed, grain)},
win AS (SELECT *, {", ".join(MODULAR_WINDOWS)} FROM panel {window_ctes("timestamp")}),
feats AS (SELECT * FROM (SELECT *, {VOLATILITY} AS price_volatility_ratio, {IMPACT} AS congestion_impact,
            {ZSCORE} AS price_deviation_24h, {LOAD_RATIO} AS load_ratio_24h, {PEAK} AS is_peak_load,
            {threshold(3)} AS spike_threshold, {spike(3)} AS is_price_spike, {cause(3)} AS spike_cause FROM win)
          WHERE COLUMNS(*) IS NOT NULL),
naive AS (SELECT *, "LBMP_avg_lag_24" AS predicted_price, "Load_MW_lag_24" AS predicted_load,
            {spike(2)} AS predicted_spike FROM feats)"""


def day_stat_ctes() -> str:
    windows = [c for v in ("LBMP_avg", "Load_MW") for c in rolled(v, 24, ("ma", "std"), v + "_{stat}_{n}")]
    return f"""{panel_ctes()},
win AS (SELECT *, {", ".join(windows)} FROM panel {window_ctes("timestamp")})"""


SHORT_DERIVED = f"""{ratio('price_std_24h', 'abs(price_ma_24h)', 0)} AS price_volatility,
    {ratio('"Load_MW"', 'load_ma_24h', 1)} AS load_ratio_24h, {IMPACT} AS congestion_impact,
    CASE WHEN "LBMP_avg" > price_ma_24h + 3.0 * price_std_24h THEN 1 ELSE 0 END AS is_price_spike"""


def flat_ctes() -> str:
    ts = "hour_timestamp"
    windows = [
        *rolled("LBMP_avg", 24, ("ma", "std"), "price_{stat}_{n}h"),
        *rolled("Load_MW", 24, ("ma", "std"), "load_{stat}_{n}h"),
        *lagged("LBMP_avg", (1, 24), "price_lag_{k}h"),
        *lagged("Load_MW", (1, 24), "load_lag_{k}h"),
    ]
    return f"""{HOURLY_FEEDS},
hp AS ({price_rollup("prices", "std", alias=ts)}),
hl AS ({load_rollup("loads", alias=ts)}),
panel AS (SELECT hp.*, hl."Load_MW", {calendar("hp.hour_timestamp", ("peak",))}
          FROM hp JOIN hl ON hp.{ts} = hl.{ts} AND hp."Name" = hl."Name"),
win AS (SELECT *, {", ".join(windows)} FROM panel {window_ctes(ts)}),
flat AS (SELECT * FROM (SELECT *, {SHORT_DERIVED} FROM win) WHERE COLUMNS(*) IS NOT NULL)"""


def extended_ctes() -> str:
    ts = "hour_timestamp"
    windows = [
        *rolled("LBMP_avg", 24, FOUR, "price_{stat}_{n}h"),
        *rolled("LBMP_avg", 168, ("ma",), "price_{stat}_{n}h"),
        *rolled("Load_MW", 24, FOUR, "load_{stat}_{n}h"),
        *rolled("Load_MW", 168, ("ma",), "load_{stat}_{n}h"),
        *lagged("LBMP_avg", (1, 2, 6, 12, 24), "price_lag_{k}h"),
        *lagged("Load_MW", (1, 24), "load_lag_{k}h"),
        moved("LBMP_avg", 1, "price_change_1h"),
        moved("Load_MW", 1, "load_change_1h"),
    ]
    deviation = ratio('("LBMP_avg" - price_ma_24h)', "price_std_24h", 0)
    return f"""{HOURLY_FEEDS},
hp AS ({price_rollup("prices", "full", alias=ts)}),
hl AS ({load_rollup("loads", alias=ts, labelled=True)}),
panel AS (SELECT hp.*, hl."Load_MW", hl."Time_Zone", {calendar("hp.hour_timestamp", ("peak", "week"))}
          FROM hp JOIN hl ON hp.{ts} = hl.{ts} AND hp."Name" = hl."Name"),
win AS (SELECT *, {", ".join(windows)} FROM panel {window_ctes(ts, '"PTID", "Load_MW"')}),
extended AS (SELECT * FROM (SELECT *, {deviation} AS price_deviation, {SHORT_DERIVED} FROM win)
             WHERE COLUMNS(*) IS NOT NULL)"""


# --- output ---------------------------------------------------------------------


def r6(expression: str, name: str, digits: int = 6) -> str:
    return f'round({expression} + 1e-{digits + 2}, {digits}) AS "{name}"'


def plain(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def settled(ctes: str, source: str, keep: Iterable[str], doubles: Iterable[str], digits: int = 6) -> str:
    columns = [f'"{c}"' for c in keep] + [r6(f'"{c}"', c, digits) for c in doubles]
    return plain(ctes, f"SELECT {', '.join(columns)} FROM {source}")


KEYS = ["timestamp", "Name"]
CALENDAR_INTS = ["hour", "day_of_week", "day_of_month", "month", "year", "is_weekend"]
CYCLES = ["hour_sin", "hour_cos", "month_sin", "month_cos"]
MEANS = ["LBMP_avg", "Marginal_Cost_Losses_avg", "Marginal_Cost_Congestion_avg"]
MODULAR_DOUBLES = [
    *MEANS,
    "Load_MW",
    *CYCLES,
    *[f"{v}_{s}_{n}" for v in ("LBMP_avg", "Load_MW") for n in (24, 168) for s in FOUR],
    *[f"{v}_lag_{k}" for v in ("LBMP_avg", "Load_MW") for k in (1, 2, 3, 6, 12, 24)],
    "price_momentum_24h",
    "load_change_1h",
    "price_volatility_ratio",
    "congestion_impact",
    "price_deviation_24h",
    "load_ratio_24h",
    "spike_threshold",
]
MODULAR_KEEP = [*KEYS, "PTID", "price_count", *CALENDAR_INTS, "is_peak_load", "is_price_spike", "spike_cause"]
FLAT_DOUBLES = [
    *MEANS,
    "LBMP_std",
    "Load_MW",
    *CYCLES,
    *[f"{p}_{s}_24h" for p in ("price", "load") for s in ("ma", "std")],
    *[f"{p}_lag_{k}h" for p in ("price", "load") for k in (1, 24)],
    "price_volatility",
    "load_ratio_24h",
    "congestion_impact",
]
FLAT_KEEP = ["hour_timestamp", "Name", "PTID", *CALENDAR_INTS, "is_peak_hour", "is_price_spike"]
EXTENDED_DOUBLES = [
    *FLAT_DOUBLES,
    "LBMP_min",
    "LBMP_max",
    *[f"{p}_{s}_24h" for p in ("price", "load") for s in ("min", "max")],
    "price_ma_168h",
    "load_ma_168h",
    "price_lag_2h",
    "price_lag_6h",
    "price_lag_12h",
    "price_change_1h",
    "load_change_1h",
    "price_deviation",
]
EXTENDED_KEEP = [*FLAT_KEEP, "price_readings", "Time_Zone", "week_of_year", "day_name"]


def series_sql(columns: list[str], names: list[str], ctes: str | None = None, digits: int = 6) -> str:
    body = f"win AS (SELECT *, {', '.join(columns)} FROM panel {window_ctes('timestamp')})"
    return settled(
        f"{ctes or panel_ctes()},\n{body}", "win", [*KEYS, "PTID"], ["LBMP_avg", "Load_MW", *names], digits
    )


def windowed(stats: tuple[str, ...]) -> str:
    both = ("LBMP_avg", "Load_MW")
    columns = [c for v in both for n in (24, 168) for c in rolled(v, n, stats, v + "_{stat}_{n}")]
    return series_sql(columns, [f"{v}_{s}_{n}" for v in both for n in (24, 168) for s in stats])


def pivot(rows: str, across: str, values: Iterable[int], measure: str, fill: bool = False) -> str:
    cells = []
    for v in values:
        cell = f'avg("{measure}") FILTER (WHERE {across} = {v})'
        cells.append(r6(f"coalesce({cell}, 0.0)" if fill else cell, f"{across}_{v}"))
    return plain(panel_ctes(), f"SELECT {rows}, {', '.join(cells)} FROM panel GROUP BY {rows}")


def means(ctes: str, source: str, key: str, measures: Iterable[str] = ("LBMP_avg", "Load_MW"), where: str = "") -> str:
    cells = ", ".join(r6(f'avg("{m}")', m) for m in measures)
    return plain(ctes, f"SELECT {key}, {cells} FROM {source} {where} GROUP BY ALL")


def bins(source: str, x: str, low: str = "min(x)", high: str = "max(x)") -> str:
    clipped = "greatest(least(x, hi), lo)"
    return f"""vals AS (SELECT round({x}, 6) AS x FROM {source}),
edges AS (SELECT {low} AS lo, {high} AS hi FROM vals),
binned AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor(({clipped} - lo) / ((hi - lo) / 50)), 49) ELSE 0 END
             AS INTEGER) AS bin, count(*) AS "count" FROM vals, edges GROUP BY 1)"""


def pearson(x: str, y: str) -> str:
    constant = f'min("{x}") = max("{x}") OR min("{y}") = max("{y}")'
    return f'CASE WHEN {constant} THEN NULL ELSE corr("{x}", "{y}") END'


def box(measure: str) -> str:
    cells = ", ".join(
        r6(f'quantile_cont("{measure}", {p})', n)
        for n, p in (("low", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1.0))
    )
    return f"""SELECT dayname("timestamp") AS day_name, '{measure}' AS measure, {cells} FROM panel GROUP BY 1"""


def share(ts: str = '"timestamp"') -> str:
    token = f"""CAST({ts} AS VARCHAR) || '|' || "Name" || '|42'"""
    return f"CAST(('0x' || substr(md5({token}), 1, 8)) AS UBIGINT) % 100"


def sampled(ctes: str, source: str, doubles: list[str]) -> str:
    token = """md5(CAST("timestamp" AS VARCHAR) || '|' || "Name" || '|42')"""
    picked = f'picked AS (SELECT * FROM {source} ORDER BY {token}, "timestamp", "Name" LIMIT 2000)'
    return settled(f"{ctes},\n{picked}", "picked", KEYS, doubles)


def measures(y: str, p: str) -> dict[str, str]:
    mape = f"avg(CASE WHEN {y} <> 0 THEN abs(({y} - {p}) / {y}) * 100 ELSE 0 END)"
    return {
        "rmse": f"sqrt(avg(({y} - {p}) * ({y} - {p})))",
        "mae": f"avg(abs({y} - {p}))",
        "r2": f"1 - avg(({y} - {p}) * ({y} - {p})) / nullif(var_pop({y}), 0)",
        "mape": f"coalesce({mape}, 0)",
    }


def grouped_error(key: str, y: str, p: str) -> str:
    m = measures(y, p)
    return plain(
        feature_ctes(),
        f'SELECT "{key}", {r6(m["mae"], "mae")}, {r6(m["mape"], "mape")}, count(*) AS "count" FROM naive GROUP BY 1',
    )


def history() -> str:
    rows = []
    for p in ("LBMP_avg_lag_1", "LBMP_avg_lag_24"):
        for name, expression in measures('"LBMP_avg"', f'"{p}"').items():
            rows.append(
                f"SELECT '{p}' AS model_name, count(*) AS test_size, CAST(1 AS BIGINT) AS features, "
                f"'{name}' AS metric, {r6(expression, 'value')} FROM naive"
            )
    return "\nUNION ALL\n".join(rows)


CLASSIFICATION = f"""classes AS (SELECT c, count(*) FILTER (WHERE is_price_spike = c) AS support,
    count(*) FILTER (WHERE is_price_spike = c AND predicted_spike = c) AS hits,
    count(*) FILTER (WHERE predicted_spike = c) AS claimed
    FROM naive, (VALUES (0), (1)) AS v(c) GROUP BY c),
rates AS (SELECT *, coalesce(hits / nullif(claimed, 0), 0) AS prec, coalesce(hits / nullif(support, 0), 0) AS rec
          FROM classes)
SELECT {r6("sum(hits) / sum(support)", "accuracy")}, {r6("sum(prec * support) / sum(support)", "precision")},
       {r6("sum(rec * support) / sum(support)", "recall")},
       {r6("sum(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) * support) / sum(support)", "f1")} FROM rates"""

AUC = f"""scored AS (SELECT is_price_spike AS y, round("LBMP_avg_lag_1", 4) AS score FROM naive),
ranked AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored)
SELECT {r6("(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))", "auc_roc")}
FROM ranked"""

PROFILE = f"""hits AS (SELECT * FROM naive WHERE predicted_spike = 1),
by_hour AS (SELECT hour, count(*) AS n FROM hits GROUP BY hour)
SELECT (SELECT count(*) FROM naive) AS total_predictions, count(*) AS predicted_spikes,
       {r6('avg("LBMP_avg")', "avg_spike_price")}, {r6('max("LBMP_avg")', "max_spike_price")},
       {r6('avg("Load_MW")', "avg_spike_load")}, {r6("avg(congestion_impact)", "avg_congestion_impact")},
       (SELECT string_agg(hour || ':' || n, ',' ORDER BY hour) FROM by_hour) AS hourly_distribution FROM hits"""


def predictions(p_price: str, p_load: str, p_spike: str) -> str:
    return f"""named AS (SELECT *, {p_price} AS predicted_price, {p_load} AS predicted_load, {p_spike} AS predicted_spike
        FROM flat)"""


# Means of the training rows by hour, a rule over the hour, and whether the price is above 20.
HOUR_MODELS = f"""by_hour AS (SELECT hour AS h, avg("LBMP_avg") AS p, avg("Load_MW") AS l FROM panel
    WHERE {share()} < 80 GROUP BY hour),
naive AS (SELECT "timestamp", "Name", "LBMP_avg", "Load_MW", p AS predicted_price, l AS predicted_load,
    CASE WHEN hour BETWEEN 7 AND 22 THEN 1 ELSE 0 END AS predicted_spike,
    CASE WHEN "LBMP_avg" > 20 THEN 1 ELSE 0 END AS is_price_spike
    FROM panel JOIN by_hour ON hour = h WHERE {share()} >= 80)"""


def hour_reports(panel: str) -> str:
    scored = CLASSIFICATION.split("\nSELECT")
    ranked = AUC.replace('round("LBMP_avg_lag_1", 4)', "predicted_spike").split("\nSELECT")
    names = {"price_predictor": ('"LBMP_avg"', "predicted_price"), "demand_forecaster": ('"Load_MW"', "predicted_load")}
    rows = [
        f"SELECT '{model}' AS model_name, (SELECT count(*) FROM naive) AS test_size, CAST(1 AS BIGINT) AS features, "
        f"'{metric}' AS metric, {r6(expression, 'value')} FROM naive"
        for model, sides in names.items()
        for metric, expression in measures(*sides).items()
    ]
    spike = "SELECT 'spike_detector', (SELECT count(*) FROM naive), CAST(1 AS BIGINT), "
    rows += [f"{spike}'{m}', {m} FROM marks" for m in ("accuracy", "precision", "recall", "f1")]
    rows += [f"{spike}'auc_roc', auc_roc FROM area", f"{spike}'spike_rate', {r6('avg(is_price_spike)', 'value')} FROM naive"]
    marks = f"{scored[0]},\nmarks AS (SELECT{scored[1]})"
    area = f"{ranked[0]},\narea AS (SELECT{ranked[1]})"
    return f"WITH {panel},\n{HOUR_MODELS},\n{marks},\n{area}\n" + "\nUNION ALL\n".join(rows)


# The feature sets in full and in order, written out here apart from the library.
CALENDAR_SET = "hour day_of_week day_of_month month is_weekend hour_sin hour_cos month_sin month_cos"
MODULAR_SET = f"""{CALENDAR_SET}
LBMP_avg_ma_24 LBMP_avg_std_24 LBMP_avg_min_24 LBMP_avg_max_24 LBMP_avg_ma_168 LBMP_avg_std_168
Load_MW_ma_24 Load_MW_std_24 Load_MW_min_24 Load_MW_max_24 Load_MW_ma_168 Load_MW_std_168
LBMP_avg_lag_1 LBMP_avg_lag_2 LBMP_avg_lag_3 LBMP_avg_lag_6 LBMP_avg_lag_12 LBMP_avg_lag_24
Load_MW_lag_1 Load_MW_lag_2 Load_MW_lag_3 Load_MW_lag_6 Load_MW_lag_12 Load_MW_lag_24
price_momentum_24h price_volatility_ratio congestion_impact price_deviation_24h
load_change_1h load_ratio_24h is_peak_load Marginal_Cost_Losses_avg Marginal_Cost_Congestion_avg"""
FLAT_START = "hour day_of_week month is_weekend is_peak_hour"
FLAT_TURNS = f"{FLAT_START} hour_sin hour_cos month_sin month_cos"
FEATURE_SETS = {
    "price": ("feats", f"{MODULAR_SET} Load_MW"),
    "demand": ("feats", f"{MODULAR_SET} LBMP_avg"),
    "spike": ("feats", f"{MODULAR_SET} Load_MW"),
    "other": ("feats", MODULAR_SET),
    "flat_price": (
        "flat",
        f"{FLAT_TURNS} Load_MW load_ma_24h price_lag_1h price_lag_24h price_ma_24h "
        "Marginal_Cost_Losses_avg Marginal_Cost_Congestion_avg",
    ),
    "flat_demand": (
        "flat",
        f"{FLAT_TURNS} LBMP_avg price_ma_24h load_lag_1h load_lag_24h load_ma_24h Marginal_Cost_Congestion_avg",
    ),
    "flat_spike": (
        "flat",
        f"{FLAT_START} Load_MW load_ma_24h load_ratio_24h price_lag_1h price_ma_24h price_volatility congestion_impact",
    ),
    "extended_price": (
        "extended",
        f"{FLAT_TURNS} Load_MW load_ma_24h load_std_24h load_ratio_24h price_lag_1h price_lag_24h price_ma_24h "
        "price_std_24h Marginal_Cost_Losses_avg Marginal_Cost_Congestion_avg price_volatility congestion_impact",
    ),
}


def feature_set_sql(wide: dict[str, str]) -> str:
    """Means of all features; each panel is a subquery of its own, as their common table names clash."""
    rows = []
    for name, (source, features) in FEATURE_SETS.items():
        for place, feature in enumerate(features.split()):
            mean = r6(f'avg(CAST("{feature}" AS DOUBLE))', "mean", 4)
            rows.append((source, f"SELECT '{name}' AS feature_set, {place} AS place, '{feature}' AS feature, {mean} FROM {source}"))
    parts = []
    for source, ctes in wide.items():
        own = "\nUNION ALL\n".join(row for s, row in rows if s == source)
        parts.append(f"SELECT * FROM (WITH {ctes}\n{own})")
    return "\nUNION ALL\n".join(parts)


def oracle_sql() -> dict[str, str]:
    feeds = HOURLY_FEEDS
    cleaned = f"{HOURLY_FEEDS},{CLEANED}"
    panel, feats, flat = panel_ctes(), feature_ctes(), flat_ctes()
    price_doubles = ["LBMP", "Marginal_Cost_Losses", "Marginal_Cost_Congestion"]
    panel_keep, panel_doubles = [*KEYS, "PTID", "price_count", *CALENDAR_INTS], [*MEANS, "Load_MW", *CYCLES]
    leak_free = feat.feature_columns("price", leak_free=True)
    ints = {"hour", "day_of_week", "day_of_month", "month", "is_weekend", "is_peak_load"}
    second = """date_trunc('second', "timestamp")"""
    both = ("LBMP_avg", "Load_MW")
    first_panel = f"""first_load AS ({FIRST_LOAD}),
first_panel AS (SELECT hp.*, f."Load_MW", f.time_zone, {calendar('hp."timestamp"')}
                FROM hp JOIN first_load f ON hp."timestamp" = f."timestamp" AND hp."Name" = f."Name")"""
    blocks = [
        *[c for n in (24, 168) for c in rolled("LBMP_avg", n, FOUR, "LBMP_avg_{stat}_{n}")],
        *lagged("Load_MW", (1, 2, 3, 6, 12, 24), "Load_MW_lag_{k}"),
    ]
    block_names = [f"LBMP_avg_{s}_{n}" for n in (24, 168) for s in FOUR]
    block_names += [f"Load_MW_lag_{k}" for k in (1, 2, 3, 6, 12, 24)]
    flat_spikes = "CASE WHEN price_lag_1h > price_ma_24h THEN 1 ELSE 0 END"
    standardized = [
        f'CASE WHEN stddev_samp("{c}") OVER () <> 0 THEN ("{c}" - avg("{c}") OVER ()) / stddev_samp("{c}") OVER () '
        f'ELSE 0.0 END AS "{c}_scaled"'
        for c in (*both, "price_count")
    ]
    corr_pairs = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {r6(pearson(a, b), 'r')} FROM flat" for a in CORR_COLUMNS for b in CORR_COLUMNS
    )
    hours = """(date_diff('hour', TIMESTAMP '1970-01-01', "timestamp"))"""
    cut = f"(SELECT min{hours} + floor((max{hours} - min{hours} + 1) * 0.8) FROM panel)"
    found = {
        # sources and sinks
        "scan_price_csv": plain(
            feeds,
            f"""SELECT {second} AS "timestamp", "Name", "PTID", {", ".join(r6(f'"{c}"', c) for c in price_doubles)}
            FROM prices""",
        ),
        "scan_load_csv": plain(
            feeds, f"""SELECT {second} AS "timestamp", time_zone, "Name", "PTID", {r6('"Load"', "Load")} FROM loads"""
        ),
        "scan_csv_glob": plain(
            feeds,
            f"""SELECT "Name", count(*) AS rows, count("timestamp") AS stamped, {r6('avg("LBMP")', "avg_price")}
            FROM prices GROUP BY "Name\"""",
        ),
        "scan_reordered_csv": plain(
            feeds,
            f"""SELECT "Name", count(*) AS rows, count("timestamp") AS stamped, {r6('avg("LBMP")', "avg_price")}
            FROM prices GROUP BY "Name\"""",
        ),
        "parse_timestamp": plain(
            feeds,
            f"""SELECT "Name", coalesce(strftime("timestamp", '%m/%d/%Y %H:%M:%S'), 'bad') AS stamp,
            {second} AS "timestamp" FROM prices""",
        ),
        "sink_parquet_roundtrip": settled(
            panel, "panel", [*KEYS, "PTID", "price_count", "year", "month"], ["LBMP_avg", "Load_MW"]
        ),
        "sink_predictions": settled(
            f"{flat},\n{predictions('price_lag_24h', 'load_lag_24h', flat_spikes)}",
            "named",
            ["hour_timestamp", "Name", "is_price_spike", "predicted_spike", "hour", "day_of_week", "month", "is_weekend"],
            [*both, "predicted_price", "predicted_load", "price_ma_24h", "load_ma_24h", "Marginal_Cost_Congestion_avg"],
        ),
        "profile_table": """SELECT 'orders' AS name, count(*) AS row_count, 6 AS column_count,
            'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders""",
        # cleaning
        "clean_price": settled(cleaned, "clean_p", [*KEYS, "PTID", "is_extreme_price"], price_doubles),
        "clean_load": settled(cleaned, "clean_l", [*KEYS, "PTID", "time_zone", "is_negative_load"], ["Load"]),
        "dedup_first_in_bucket": settled(
            f"{cleaned},\nf AS ({FIRST_LOAD})", "f", [*KEYS, "PTID", "time_zone"], ["Load_MW"]
        ),
        "drop_incomplete": settled(
            f"{feeds},\nhp AS ({price_rollup('prices', 'std')}),\nkept AS (SELECT * FROM hp WHERE COLUMNS(*) IS NOT NULL)",
            "kept",
            [*KEYS, "PTID"],
            [*MEANS, "LBMP_std"],
        ),
        "slice_entity_month": settled(panel, "panel", [*KEYS, "month"], both)
        + """ WHERE "Name" = 'click' AND month = 1""",
        "distinct_entities": plain(DAILY_FEEDS, 'SELECT DISTINCT "Name" FROM loads'),
        # roll-ups and joins
        "rollup_price_hourly": settled(
            f"{cleaned},\nhp AS ({price_rollup('clean_p', 'count')})", "hp", [*KEYS, "PTID", "price_count"], MEANS
        ),
        "rollup_price_hourly_std": settled(
            f"{feeds},\nhp AS ({price_rollup('prices', 'std')})", "hp", [*KEYS, "PTID"], [*MEANS, "LBMP_std"]
        ),
        "rollup_price_hourly_full": settled(
            f"{feeds},\nhp AS ({price_rollup('prices', 'full')})",
            "hp",
            [*KEYS, "PTID", "price_readings"],
            [*MEANS, "LBMP_min", "LBMP_max", "LBMP_std"],
        ),
        "rollup_load_hourly": settled(f"{feeds},\nhl AS ({load_rollup('loads')})", "hl", KEYS, ["Load_MW"]),
        "rollup_load_hourly_tz": settled(
            f"{feeds},\nhl AS ({load_rollup('loads', labelled=True)})", "hl", [*KEYS, "PTID", "Time_Zone"], ["Load_MW"]
        ),
        "rollup_price_daily_full": settled(
            f"{DAILY_FEEDS},\nhp AS ({price_rollup('prices', 'full', 'day')})",
            "hp",
            [*KEYS, "PTID", "price_readings"],
            [*MEANS, "LBMP_min", "LBMP_max", "LBMP_std"],
        ),
        "join_feeds": settled(panel, "panel", [*KEYS, "PTID", "price_count"], [*MEANS, "Load_MW"]),
        "join_predictions": settled(
            feats, "naive", [*KEYS, "predicted_spike"], ["LBMP_avg", "predicted_price", "predicted_load"]
        ),
        "processed_panel": settled(panel, "panel", panel_keep, panel_doubles),
        "processed_panel_first_load": settled(
            f"{panel},\n{first_panel}", "first_panel", [*panel_keep, "time_zone"], panel_doubles
        ),
        # featured panels
        "featured_panel": settled(feats, "feats", MODULAR_KEEP, MODULAR_DOUBLES),
        "featured_panel_daily": settled(
            feature_ctes(DAILY_FEEDS, "day"), "feats", MODULAR_KEEP, MODULAR_DOUBLES, 4
        ),
        "featured_panel_flat": settled(flat, "flat", FLAT_KEEP, FLAT_DOUBLES),
        "featured_panel_extended": settled(extended_ctes(), "extended", EXTENDED_KEEP, EXTENDED_DOUBLES),
        "feature_projection": settled(
            feats,
            "feats",
            [*KEYS, *[c for c in leak_free if c in ints]],
            ["LBMP_avg", *[c for c in leak_free if c not in ints]],
        ),
        "calendar_features": plain(
            f"{panel},\ncal AS (SELECT \"timestamp\", \"Name\", {calendar('\"timestamp\"', ('peak', 'week'))} FROM panel)",
            "SELECT * EXCLUDE (hour_sin, hour_cos, month_sin, month_cos) FROM cal",
        ),
        "cyclical_features": settled(panel, "panel", KEYS, CYCLES),
        # window columns
        "lag_features": series_sql(
            [c for v in both for c in lagged(v, (1, 2, 3, 6, 12, 24), v + "_lag_{k}")],
            [f"{v}_lag_{k}" for v in both for k in (1, 2, 3, 6, 12, 24)],
        ),
        "rolling_mean": windowed(("ma",)),
        "rolling_std": windowed(("std",)),
        "rolling_min_max": windowed(("min", "max")),
        "momentum": series_sql(
            [
                moved("LBMP_avg", 24, "price_momentum_24h"),
                moved("LBMP_avg", 1, "price_change_1h"),
                moved("Load_MW", 1, "load_change_1h"),
            ],
            ["price_momentum_24h", "price_change_1h", "load_change_1h"],
        ),
        "rolling_blocks": series_sql(blocks, block_names, panel_ctes(DAILY_FEEDS, "day"), 4),
        # derived columns and labels
        "volatility_ratio": plain(
            day_stat_ctes(), f'SELECT "timestamp", "Name", {r6(VOLATILITY, "price_volatility_ratio")} FROM win'
        ),
        "congestion_impact": plain(panel, f'SELECT "timestamp", "Name", {r6(IMPACT, "congestion_impact")} FROM panel'),
        "price_zscore": plain(
            day_stat_ctes(), f'SELECT "timestamp", "Name", {r6(ZSCORE, "price_deviation_24h")} FROM win'
        ),
        "load_ratio": plain(
            day_stat_ctes(), f'SELECT "timestamp", "Name", {r6(LOAD_RATIO, "load_ratio_24h")} FROM win'
        ),
        "peak_load_flag": plain(day_stat_ctes(), f'SELECT "timestamp", "Name", {PEAK} AS is_peak_load FROM win'),
        "spike_labels": plain(
            day_stat_ctes(),
            f"""SELECT "timestamp", "Name", {r6(threshold(3), "spike_threshold")}, {spike(3)} AS is_price_spike
            FROM win""",
        ),
        "spike_cause": plain(
            day_stat_ctes(),
            f"""SELECT "timestamp", "Name", {spike(2)} AS is_price_spike, {PEAK} AS is_peak_load,
            {cause(2)} AS spike_cause FROM win""",
        ),
        # SQL reports and summaries
        "sql_price_stats": plain(
            feeds,
            """SELECT "Name" AS "Zone", count(*) AS "Records", round(avg("LBMP"), 2) AS "Avg_Price",
            round(min("LBMP"), 2) AS "Min_Price", round(max("LBMP"), 2) AS "Max_Price",
            round(stddev_samp("LBMP"), 2) AS "Std_Dev", round(quantile_cont("LBMP", 0.5), 2) AS "Median_Price"
            FROM prices GROUP BY 1 ORDER BY "Avg_Price" DESC, "Zone\"""",
        ),
        "sql_load_stats": plain(
            feeds,
            """SELECT "Name" AS "Zone", count(*) AS "Records", round(avg("Load"), 2) AS "Avg_Load_MW",
            round(min("Load"), 2) AS "Min_Load_MW", round(max("Load"), 2) AS "Max_Load_MW",
            round(stddev_samp("Load"), 2) AS "Std_Dev"
            FROM loads WHERE "Load" IS NOT NULL GROUP BY 1 ORDER BY "Avg_Load_MW" DESC, "Zone\"""",
        ),
        "sql_time_range": plain(
            feeds,
            "\nUNION ALL\n".join(
                f"""SELECT '{label}' AS "Dataset", min("timestamp") AS "Start_Date", max("timestamp") AS "End_Date",
                CAST(date_diff('day', min("timestamp"), max("timestamp")) AS INTEGER) AS "Days_Covered"
                FROM {source} WHERE "timestamp" IS NOT NULL"""
                for label, source in (("Prices", "prices"), ("Loads", "loads"))
            ),
        ),
        "class_balance": plain(feats, 'SELECT is_price_spike, count(*) AS "count" FROM feats GROUP BY 1'),
        "spike_label_profile": plain(
            feats,
            f"""SELECT is_price_spike, count(*) AS "count", {r6('avg("LBMP_avg")', "avg_price")},
            {r6('avg("Load_MW")', "avg_load")}, {r6('avg("Marginal_Cost_Congestion_avg")', "avg_congestion")}
            FROM feats GROUP BY 1""",
        ),
        "spike_rate": plain(
            feats,
            f"""SELECT count(*) AS total, count(*) FILTER (WHERE is_price_spike = 1) AS spikes,
            {r6("coalesce(avg(is_price_spike), 0)", "spike_rate")} FROM feats""",
        ),
        "spike_by_hour": plain(
            feats, 'SELECT hour, count(*) AS "count" FROM feats WHERE is_price_spike = 1 GROUP BY hour ORDER BY hour'
        ),
        "spike_profile": f"WITH {feats},\n{PROFILE}",
        "pivot_dow_hour": pivot("day_of_week", "hour", range(24), "LBMP_avg", fill=True),
        "pivot_hour_month_load": pivot("hour", "month", range(1, 13), "Load_MW"),
        "pivot_hour_month_price": pivot("hour", "month", range(1, 13), "LBMP_avg"),
        "entity_comparison": means(panel_ctes(DAILY_FEEDS, "day"), "panel", '"Name"', where="WHERE month = 6"),
        "daily_trend": means(panel, "panel", 'CAST("timestamp" AS DATE) AS date'),
        "daily_trend_by_entity": means(
            panel_ctes(DAILY_FEEDS, "day"),
            "panel",
            'CAST("timestamp" AS DATE) AS date, "Name"',
            where='WHERE "Name" IN (SELECT DISTINCT "Name" FROM panel ORDER BY "Name" LIMIT 6)',
        ),
        "hourly_pattern": means(panel, "panel", "hour"),
        "hourly_volatility": means(flat, "flat", "hour", ("price_volatility",)),
        "kpi_summary": plain(
            feats,
            f"""SELECT {r6('coalesce(avg("LBMP_avg"), 0)', "avg_price")}, {r6('coalesce(max("Load_MW"), 0)', "max_load")},
            CAST(coalesce(sum(is_price_spike), 0) AS BIGINT) AS spike_count, count(*) AS total_records FROM feats""",
        ),
        "histogram_price": plain(
            f"{panel_ctes(DAILY_FEEDS, 'day')},\n{bins('panel', '\"LBMP_avg\"')}", "SELECT * FROM binned ORDER BY bin"
        ),
        "histogram_volatility": plain(
            f"{flat},\n{bins('flat', 'price_volatility', '0.0::DOUBLE', '2.0::DOUBLE').replace('FROM vals)', 'FROM (SELECT 1))')}",
            f"""SELECT bin, "count", {r6("(SELECT quantile_cont(price_volatility, 0.5) FROM flat)", "median")}
            FROM binned ORDER BY bin""",
        ),
        "histogram_residuals": plain(
            f"{feats},\n{bins('naive', '\"LBMP_avg\" - predicted_price')}", "SELECT * FROM binned ORDER BY bin"
        ),
        "global_threshold": plain(
            feats, f"""SELECT {r6('avg("LBMP_avg_ma_24") + 3.0 * stddev_samp("LBMP_avg")', "threshold")} FROM feats"""
        ),
        "box_stats_by_day": plain(panel, f"{box('Load_MW')}\nUNION ALL\n{box('LBMP_avg')}"),
        "corr_by_month": plain(
            panel_ctes(DAILY_FEEDS, "day"),
            f"SELECT month, {r6(pearson('Load_MW', 'LBMP_avg'), 'correlation')} FROM panel GROUP BY month ORDER BY month",
        ),
        "corr_matrix": plain(flat, corr_pairs),
        # previews, samples, splits
        "preview_rows": settled(panel, "panel", KEYS, both) + ' ORDER BY "timestamp", "Name" LIMIT 10',
        "sample_n": sampled(panel, "panel", list(both)),
        "split_hash": plain(
            panel, f"""SELECT "timestamp", "Name", CASE WHEN {share()} < 80 THEN 'train' ELSE 'test' END AS part FROM panel"""
        ),
        "split_time": plain(
            panel,
            f"""SELECT "timestamp", "Name", CASE WHEN {hours} < {cut} THEN 'train' ELSE 'test' END AS part FROM panel""",
        ),
        # quality metrics
        "regression_metrics_gaps": plain(
            feats,
            "SELECT "
            + ", ".join(r6(e, n) for n, e in measures('"LBMP_avg"', "predicted_price").items())
            + " FROM naive WHERE hour NOT IN (3, 5)",
        ),
        "regression_metrics": plain(
            feats,
            "SELECT "
            + ", ".join(r6(e, n) for n, e in measures('"LBMP_avg"', "predicted_price").items())
            + " FROM naive",
        ),
        "classification_metrics": f"WITH {feats},\n{CLASSIFICATION}",
        "roc_auc": f"WITH {feats},\n{AUC}",
        "error_by_hour": grouped_error("hour", '"LBMP_avg"', "predicted_price"),
        "error_by_entity": grouped_error("Name", '"Load_MW"', "predicted_load"),
        "actual_vs_predicted": sampled(feats, "naive", ["LBMP_avg", "predicted_price"]),
        "model_report": plain(feats, history()),
        "scan_metrics_json": plain(feats, history()),
        "sink_metrics_json": plain(
            feats,
            "\nUNION ALL\n".join(
                f"SELECT '{p}' AS model_name, count(*) AS test_size FROM naive"
                for p in ("LBMP_avg_lag_1", "LBMP_avg_lag_24")
            ),
        ),
        "compare_models": plain(
            feats,
            "\nUNION ALL\n".join(
                f"SELECT '{p}' AS model, {r6(measures('\"LBMP_avg\"', f'\"{p}\"')['rmse'], 'rmse')} FROM naive"
                for p in ("LBMP_avg_lag_1", "LBMP_avg_lag_24")
            ),
        ),
        # models
        "ml_assemble": plain(
            flat,
            'SELECT hour_timestamp, "Name", '
            + ", ".join(r6(f'CAST("{c}" AS DOUBLE)', c) for c in feat.FLAT_FEATURES["spike"])
            + " FROM flat",
        ),
        "standardize": settled(
            f"{panel_ctes(DAILY_FEEDS, 'day')},\nz AS (SELECT *, {', '.join(standardized)} FROM panel)",
            "z",
            KEYS,
            [f"{c}_scaled" for c in (*both, "price_count")],
        ),
        "predict_intervals": plain(
            feats,
            f"""SELECT "timestamp", "Name", {r6("predicted_price", "predicted_price")},
            {r6("predicted_price - 1.96 * 20.0::DOUBLE", "price_lower")},
            {r6("predicted_price + 1.96 * 20.0::DOUBLE", "price_upper")} FROM naive""",
        ),
        "forecast_horizon": plain(
            panel,
            f"""SELECT o."timestamp", o."Name", o."PTID", CAST(h.horizon AS INTEGER) AS horizon,
            o."timestamp" + to_hours(CAST(h.horizon AS INTEGER)) AS target_time, {r6('p."Load_MW"', "actual")}, true AS forecast
            FROM (SELECT *, row_number() OVER (PARTITION BY "Name" ORDER BY "timestamp", "PTID") AS place FROM panel) o
            CROSS JOIN range(1, 25) AS h(horizon)
            LEFT JOIN panel p ON p."Name" = o."Name" AND p."PTID" = o."PTID"
                AND p."timestamp" = o."timestamp" + to_hours(CAST(h.horizon AS INTEGER))
            WHERE o.place >= 24 AND {hours.replace('"timestamp"', 'o."timestamp"')} >= {cut}""",
        ),
        "ml_score_by_hour": plain(
            f"{panel},\n{HOUR_MODELS}",
            f"""SELECT "timestamp", "Name", {r6('"LBMP_avg"', "LBMP_avg")}, {r6('"Load_MW"', "Load_MW")},
            {r6("predicted_price", "predicted_price")}, {r6("predicted_load", "predicted_load")}, predicted_spike,
            {r6("CAST(predicted_spike AS DOUBLE)", "spike_chance")} FROM naive""",
        ),
        "ml_reports_by_hour": hour_reports(panel),
        "feature_importance_by_hour": plain(
            panel,
            f"""SELECT feature, model, {r6("importance", "importance")} FROM (SELECT count(*) AS n FROM panel),
            (VALUES ('constant', 0.0::DOUBLE), ('hour', 1.0::DOUBLE)) AS f(feature, importance),
            (VALUES ('price'), ('spike')) AS m(model) WHERE n > 0""",
        ),
        "top_features_by_hour": plain(
            panel,
            f"""SELECT 'hour' AS feature, {r6("1.0::DOUBLE", "importance")} FROM (SELECT count(*) AS n FROM panel) WHERE n > 0""",
        ),
        "model_save_load": plain(
            feats, f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches FROM feats WHERE {share()} >= 80"
        ),
    }
    found["scan_mixed_csv"] = plain(
        feeds,
        f"""SELECT {second} AS "timestamp", "Name", "PTID", {", ".join(r6(f'"{c}"', c) for c in price_doubles)}
        FROM prices WHERE "timestamp" IS NOT NULL AND "Marginal_Cost_Losses" NOT IN (0.3, 0.7)""",
    )
    found["rejected_lines"] = plain(
        feeds,
        """SELECT CASE WHEN "Marginal_Cost_Losses" = 0.7 THEN 'fields'
               WHEN "Marginal_Cost_Losses" = 0.3 AND "timestamp" IS NULL THEN 'timestamp+LBMP'
               WHEN "Marginal_Cost_Losses" = 0.3 THEN 'LBMP' WHEN "timestamp" IS NULL THEN 'timestamp' ELSE 'none' END
           AS reason, count(*) AS lines FROM prices GROUP BY 1""",
    )
    found["feature_sets"] = feature_set_sql({"feats": feats, "flat": flat, "extended": extended_ctes()})
    first_feats = feats.replace("win AS (SELECT *, ", f"{first_panel},\nwin AS (SELECT *, ", 1)
    found["featured_panel_first_load"] = settled(
        first_feats.replace("FROM panel WINDOW w", "FROM first_panel WINDOW w"),
        "feats",
        [*MODULAR_KEEP, "time_zone"],
        MODULAR_DOUBLES,
    )
    found["predict_intervals_calibrated"] = f"""WITH {feats},
errors AS (SELECT "Name", abs("LBMP_avg" - predicted_price) AS e, row_number() OVER (PARTITION BY "Name"
           ORDER BY abs("LBMP_avg" - predicted_price)) AS rk, count(*) OVER (PARTITION BY "Name") AS n
           FROM naive WHERE {share()} < 80),
widths AS (SELECT "Name", max(e) FILTER (WHERE rk = ((n + 1) * 9 + 9) // 10) AS half_width FROM errors GROUP BY "Name")
SELECT t."Name", {r6("half_width", "half_width")}, count(*) AS rows,
       {r6("avg(CASE WHEN abs(\"LBMP_avg\" - predicted_price) <= half_width THEN 1.0 ELSE 0.0 END)", "coverage")}
FROM naive t JOIN widths w ON t."Name" = w."Name" WHERE {share().replace('"timestamp"', 't."timestamp"').replace('"Name"', 't."Name"')} >= 80
GROUP BY t."Name", half_width"""
    # Increments give what one run over all files gives.
    found["rollup_price_incremental"] = found["rollup_price_hourly_full"]
    found["rollup_load_incremental"] = found["rollup_load_hourly_tz"]
    return found
