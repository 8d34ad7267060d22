"""Registration of queries, and the SQL that states the shared fixtures."""

from __future__ import annotations

from ..sources.fixtures import EVENT_CODES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: The fixtures of ``sources.fixtures`` in SQL, by name of the common table expression.
X = "x AS (SELECT o_custkey AS sample_id, CAST(substr(p_brand, 7) AS INT) AS feature_id, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
SAMPLES = "samples AS (SELECT c_custkey AS sample_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1.0::DOUBLE WHEN c_mktsegment = 'HOUSEHOLD' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM customer)"
V = "x AS (SELECT vec_id AS sample_id, CAST(i - 1 AS INT) AS feature_id, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] <> 0)"
V_SAMPLES = "samples AS (SELECT vec_id AS sample_id, CASE WHEN label < 4 THEN 1.0::DOUBLE WHEN label < 9 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS y FROM embeddings)"
_CODE = "CASE event_type " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(EVENT_CODES)) + " ELSE 4 END"
A = f"x AS (SELECT * FROM (SELECT user_id AS sample_id, CAST({_CODE} AS INT) AS feature_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value FROM events GROUP BY 1, 2) WHERE value <> 0)"
A_SAMPLES = "samples AS (SELECT user_id AS sample_id, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS y FROM events GROUP BY 1)"


def terms(n: int) -> str:
    return f"terms AS (SELECT m AS model_id, f, CASE WHEN (m * 31 + f * 17) % 7 < 3 THEN 1 ELSE -1 END AS c FROM range({n}) t(m), (SELECT DISTINCT feature_id AS f FROM x) WHERE (m * 13 + f * 29) % 11 < 3)"


def g_sql(data_type: str) -> str:
    v = "coalesce(x.value, 0)"
    return {"raw": v, "prevalence": f"CASE WHEN {v} > eps THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "log": "CASE WHEN x.value IS NULL THEN 0 ELSE ln(x.value / eps) END", "zscore": f"({v} - coalesce(z.mean, 0)) / coalesce(z.std, 1)"}[data_type]


STATS = "stats AS (SELECT feature_id, s / n AS mean, CASE WHEN q / n - (s / n) * (s / n) > 0 THEN sqrt(q / n - (s / n) * (s / n)) ELSE 1.0::DOUBLE END AS std FROM (SELECT feature_id, sum(value) AS s, sum(value * value) AS q FROM x SEMI JOIN samples USING (sample_id) GROUP BY 1), (SELECT count(*)::DOUBLE AS n FROM samples))"


def scores(language: str = "ternary", data_type: str = "raw", epsilon: float = 1e-5, source: str = "terms", betas=(1.0, 1.0, 0.0), digits: int | None = None) -> str:
    """``sc(model_id, sample_id, y, score)`` of the terms in ``source``."""
    g = g_sql(data_type).replace("eps", f"{epsilon!r}::DOUBLE")
    weight = f"abs(t.c) * ({g})" if data_type == "log" else f"({g})"
    expr = {
        "linear": f"coalesce(sum(t.c * ({g})), 0)",
        "ratio": f"coalesce(sum(CASE WHEN t.c > 0 THEN {weight} END), 0) / (coalesce(sum(CASE WHEN t.c <= 0 THEN {weight} END), 0) + {epsilon!r}::DOUBLE)",
        "mcmc_generic": f"1 / (1 + exp(-({betas[0]}::DOUBLE * coalesce(sum(CASE WHEN t.c = 1 THEN {g} END), 0) + {betas[1]}::DOUBLE * coalesce(sum(CASE WHEN t.c = -1 THEN {g} END), 0) + {betas[2]}::DOUBLE)))",
    }[language if language in ("ratio", "mcmc_generic") else "linear"]
    if digits is not None:
        expr = f"round({expr}, {digits})"
    z = "LEFT JOIN stats z ON z.feature_id = t.f" if data_type == "zscore" else ""
    return f"sc AS (SELECT mm.model_id, ss.sample_id, ss.y, CAST({expr} AS DOUBLE) AS score FROM (SELECT DISTINCT model_id FROM {source}) mm CROSS JOIN samples ss LEFT JOIN {source} t ON t.model_id = mm.model_id LEFT JOIN x ON x.feature_id = t.f AND x.sample_id = ss.sample_id {z} GROUP BY 1, 2, 3)"


def auc(source: str = "sc", name: str = "aucs", key: str = "model_id") -> str:
    return f"""{name} AS (SELECT {key}, CASE WHEN sum(p) * sum(n) > 0 THEN sum(n * pb + 0.5::DOUBLE * n * p) / (sum(p) * sum(n)) ELSE 0.5::DOUBLE END AS auc FROM (
  SELECT *, coalesce(sum(p) OVER (PARTITION BY {key} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS pb FROM (
    SELECT {key}, score, (count(*) FILTER (y = 1))::DOUBLE AS p, (count(*) FILTER (y = 0))::DOUBLE AS n FROM {source} WHERE y IN (0, 1) GROUP BY {key}, score)) GROUP BY {key})"""


def objective(fit: str, penalties: tuple[float, float] | None = None) -> str:
    sens, spec = "(tp / (tp + fn))", "(tn / (tn + fp))"
    if fit in ("sensitivity", "specificity") and penalties:
        return f"({penalties[0]}::DOUBLE * {spec} + {penalties[1]}::DOUBLE * {sens}) / {sum(penalties)}::DOUBLE"
    pr = "(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END)"
    root = "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"
    return {
        "mcc": f"CASE WHEN {root} = 0 THEN 0 ELSE (tp * tn - fp * fn) / {root} END",
        "f1_score": f"CASE WHEN {pr} + {sens} > 0 THEN 2 * ({pr} * {sens}) / ({pr} + {sens}) ELSE 0 END",
        "npv": "CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END",
        "ppv": pr,
        "g_mean": f"sqrt({sens} * {spec})",
    }.get(fit, f"{sens} + {spec} - 1.0::DOUBLE")


def roc(fit: str = "auc", penalties: tuple[float, float] | None = None, source: str = "sc", name: str = "best", key: str = "model_id") -> str:
    """``best``: chosen threshold per model."""
    return f"""g_{name} AS (SELECT *, sum(p) OVER (PARTITION BY {key} ORDER BY score) AS cfn, sum(n) OVER (PARTITION BY {key} ORDER BY score) AS ctn, sum(p) OVER (PARTITION BY {key}) AS pp, sum(n) OVER (PARTITION BY {key}) AS nn,
    lead(score) OVER (PARTITION BY {key} ORDER BY score) AS nxt, row_number() OVER (PARTITION BY {key} ORDER BY score) AS place FROM (
    SELECT {key}, score, (count(*) FILTER (y = 1))::DOUBLE AS p, (count(*) FILTER (y = 0))::DOUBLE AS n FROM {source} WHERE y IN (0, 1) GROUP BY {key}, score)),
c_{name} AS (SELECT {key}, score AS threshold, 0 AS place, pp AS tp, nn AS fp, 0::DOUBLE AS tn, 0::DOUBLE AS fn FROM g_{name} WHERE place = 1
  UNION ALL SELECT {key}, coalesce(nxt, score + 1), place, pp - cfn, nn - ctn, ctn, cfn FROM g_{name}),
{name} AS (SELECT {key}, threshold, (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity, obj AS objective, tp, fp, tn, fn FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(obj, 12) DESC, place) AS r FROM (SELECT *, {objective(fit, penalties)} AS obj FROM c_{name})) WHERE r = 1)"""


def rounded(columns: str, digits: int = 9) -> str:
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))
