"""Guarded preprocessing: statistics from train rows only, applied as one projection.

The order is fixed: encode, winsorize, impute, normalize, filter, select.
A fitted model is a list of column expressions with literal statistics, so
transform() is a single select that Catalyst compiles.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import FallbackWarning, InputError, warn

NUMBER = r"^\s*-?\d+(\.\d+)?\s*$"
ROBUST = 1.4826
REFERENCE_ROWS = 50_000  # train rows in a cell, and rows with holes that meet it at once
ASKING_ROWS = 20_000
CUT_ROWS = 64  # of a sample, for each cell
CUT_VALUES = 4_000_000  # of a sample at most
EXACT_ROWS = 1_000_000  # whose distinct values one aggregate may hold for each column
SKETCH = 10_000  # accuracy of quantile sketches
LEVEL_LIMIT = 10_000  # distinct levels of one categorical column


@dataclass
class GuardConfig:
    winsorize: bool = True
    winsor_k: float = 5.0
    impute: str = "median"  # median, knn, missforest, none
    knn_k: int = 5
    normalize: str = "zscore"  # zscore, robust, none
    var_thresh: float = 0.0
    iqr_thresh: float = 0.0
    min_keep: int | None = None
    select: str = "none"  # none, ttest, lasso, pca
    top_k: int | None = None
    forest_rounds: int = 10
    forest_trees: int = 100
    task: str | None = None  # multiclass: y holds class numbers; else two values are classes, and more are numbers


@dataclass
class GuardModel:
    config: GuardConfig
    numeric: list[str]
    categorical: list[str]
    levels: dict[str, list[str]]
    stats: dict[str, dict]
    columns: list[str]
    diagnostics: dict = field(default_factory=dict)
    rotation: np.ndarray | None = None
    reference: DataFrame | None = None
    forests: dict = field(default_factory=dict)

    def steps(self) -> list[dict]:
        """What each step did: the number of columns before and after it, and of values that it had to fill."""
        c, d = self.config, self.diagnostics
        kept = d["p_after_encode"] - d["removed_by_filter"]
        return [
            {"step": "encode", "method": "levels", "p_in": d["p_in"], "p_out": d["p_after_encode"]}, {"step": "winsorize", "method": f"{c.winsor_k} MAD" if c.winsorize else "none", "p_in": d["p_after_encode"], "p_out": d["p_after_encode"]},
            {"step": "impute", "method": c.impute, "p_in": d["p_after_encode"], "p_out": d["p_after_encode"]}, {"step": "normalize", "method": c.normalize, "p_in": d["p_after_encode"], "p_out": d["p_after_encode"]},
            {"step": "filter", "method": f"variance {c.var_thresh}, IQR {c.iqr_thresh}", "p_in": d["p_after_encode"], "p_out": kept}, {"step": "select", "method": c.select, "p_in": kept, "p_out": d["p_out"]},
        ]

    def fingerprint(self) -> str:
        """Equal for models of equal settings and statistics."""
        told = {"config": self.config.__dict__, "columns": self.columns, "levels": self.levels, "stats": self.stats}
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()

    def describe(self) -> str:
        return "\n".join(f"{s['step']} ({s['method']}): {s['p_in']} -> {s['p_out']}" for s in self.steps())

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep and the final columns; columns that df lacks are taken as null, so as 0 after normalization."""
        out = encode(df, keep, self.numeric, self.categorical, self.levels)
        names = list(self.stats)
        out = out.select(*keep, *[winsorized(F.col(c), self.stats[c], self.config) if self.config.winsorize else F.col(c) for c in names])
        if self.config.impute == "knn":
            out = knn_fill(out, keep, self.reference, names, self.stats, self.config.knn_k)
        elif self.config.impute == "missforest":
            out = forest_fill(out, keep, names, self.stats, self.forests)
        out = out.select(*keep, *[e for c in names for e in self._finish(c)])
        if self.rotation is not None:
            scores = [sum((F.col(c) * float(w) for c, w in zip(self.columns, self.rotation[:, j])), F.lit(0.0)).alias(f"PC{j + 1}") for j in range(self.rotation.shape[1])]
            return out.select(*keep, *scores)
        return out.select(*keep, *self.columns)

    def _finish(self, c: str) -> list[Column]:
        s, x = self.stats[c], F.col(c)
        made = [x.isNull().cast("double").alias(f"{c}__missing")] if s["indicator"] else []
        filled = F.coalesce(x, F.lit(s["fill"])) if s["fill"] is not None else x
        return [F.coalesce((filled - F.lit(s["centre"])) / F.lit(s["scale"]), F.lit(0.0)).alias(c) if self.config.normalize != "none" else filled.alias(c), *made]


def clean(c: str) -> Column:
    """A number, with NaN and infinities as null; text that isn't a plain decimal as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def looks_numeric(df: DataFrame, columns: list[str]) -> list[str]:
    """Of text columns, those all of whose values are plain decimals."""
    if not columns:
        return []
    r = df.agg(*[F.bool_and(F.col(c).rlike(NUMBER)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r[i]]


def ensure_levels(df: DataFrame, columns: list[str], levels: dict[str, list[str]] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """(df, levels): text columns with values outside the levels as null; missing columns as null.

    Levels that aren't given are df's own, sorted; a single level gets a dummy beside it.
    """
    levels = dict(levels or {})
    for c in columns:
        if c not in levels:
            rows = df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().limit(LEVEL_LIMIT + 1).collect()
            if len(rows) > LEVEL_LIMIT:
                raise InputError(f"{c} has over {LEVEL_LIMIT} levels")
            own = sorted(r["v"] for r in rows)
            levels[c] = own if len(own) != 1 else [*own, f"__dummy__{c}"]
    aligned = {c: F.when(F.col(c).cast("string").isin(levels[c]), F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string") for c in columns}
    return df.withColumns(aligned) if aligned else df, levels


def encode(df: DataFrame, keep: list[str], numeric: list[str], categorical: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """keep, numbers, and dummies named column + level: all levels of the first categorical column, all but the first of the others."""
    df, _ = ensure_levels(df, categorical, levels)
    numbers = [(clean(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in numeric]
    dummies = [F.when(F.col(c).isNotNull(), (F.col(c) == v).cast("double")).alias(f"{c}{v}") for i, c in enumerate(categorical) for v in (levels[c] if i == 0 else levels[c][1:])]
    return df.select(*keep, *numbers, *dummies)


def winsorized(x: Column, s: dict, config: GuardConfig) -> Column:
    """Clamped to the train median and k times the train MAD (constant 1); untouched where the MAD is 0."""
    name = x._jc.toString()
    if not s.get("mad"):
        return x
    lo, hi = s["median"] - config.winsor_k * s["mad"], s["median"] + config.winsor_k * s["mad"]
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))).alias(name)


def quantiles(df: DataFrame, values: list[Column], shares: list[float], n: int) -> list[list[float | None]]:
    """Exact quantiles (linear between neighbours) of each column expression; n: rows of df.

    Up to EXACT_ROWS rows one aggregate holds the distinct values. Beyond, a
    sketch brackets each quantile, the values below the bracket are counted, and
    only those within it (some hundredths of a percent) are held.
    """
    if n <= EXACT_ROWS:
        row = df.agg(*[F.percentile(v, F.array(*[F.lit(p) for p in shares])) for v in values]).first()
        return [list(x) if x is not None else [None] * len(shares) for x in row]
    slack = 4 / SKETCH
    ends = [min(1.0, max(0.0, p + d)) for p in shares for d in (-slack, slack)]
    brackets = df.agg(*[F.percentile_approx(v, F.array(*[F.lit(e) for e in ends]), F.lit(SKETCH)) for v in values]).first()
    asked = [(i, j, brackets[i][2 * j], brackets[i][2 * j + 1]) for i in range(len(values)) if brackets[i] is not None for j in range(len(shares))]
    inside = {(i, j): F.when(values[i].between(F.lit(lo), F.lit(hi)), values[i]) for i, j, lo, hi in asked}
    counts = df.agg(*[e for i, j, lo, _ in asked for e in (F.count(values[i]), F.count_if(values[i] < lo), F.count(inside[i, j]))]).first() if asked else ()
    out, take = [[None] * len(shares) for _ in values], []
    for k, (i, j, *_) in enumerate(asked):
        total, below, held = counts[3 * k : 3 * k + 3]
        place = (total - 1) * shares[j] - below
        if not 0 <= place <= held - 1:
            raise InputError("a quantile lies outside its sketch's bracket")
        take.append((i, j, place / (held - 1) if held > 1 else 0.0))
    found = df.agg(*[F.percentile(inside[i, j], F.lit(p)) for i, j, p in take]).first() if take else ()
    for (i, j, _), v in zip(take, found):
        out[i][j] = v
    return out


def column_stats(df: DataFrame, columns: list[str], n: int | None = None) -> dict[str, dict]:
    """n, missing, mean, sd, var, median, iqr and mad (constant 1) of each column; two passes for all columns, more for large tables. n: df's rows, if known."""
    if not columns:
        return {}
    n = df.count() if n is None else n
    shares = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    small = n <= EXACT_ROWS
    first = df.agg(*[e.alias(f"{k}_{i}") for i, c in enumerate(columns) for k, e in (("n", F.count(c)), ("missing", F.count_if(F.col(c).isNull())), ("mean", F.avg(c)), ("sd", F.stddev_samp(c)), ("var", F.var_samp(c)), ("q", F.percentile(F.col(c).cast("double"), shares) if small else F.lit(None)))]).first()
    stats = {c: {k: first[f"{k}_{i}"] for k in ("n", "missing", "mean", "sd", "var")} for i, c in enumerate(columns)}
    quarters = [first[f"q_{i}"] or [None] * 3 for i in range(len(columns))] if small else quantiles(df, [F.col(c).cast("double") for c in columns], [0.25, 0.5, 0.75], n)
    for c, (lo, median, hi) in zip(columns, quarters):
        stats[c] |= {"median": median, "iqr": None if lo is None else hi - lo, "mad": None}
    known = [c for c in columns if stats[c]["median"] is not None]
    spread = quantiles(df, [F.abs(F.col(c).cast("double") - F.lit(stats[c]["median"])) for c in known], [0.5], n) if known else []
    for c, (mad,) in zip(known, spread):
        stats[c]["mad"] = mad
    return stats


def fit(train: DataFrame, numeric: list[str], categorical: list[str] = (), config: GuardConfig | None = None, y: str | None = None, id_col: str | None = None) -> GuardModel:
    """A model of train rows only."""
    config = config or GuardConfig()
    if config.impute == "mice":
        raise InputError("mice isn't supported: it has no transform for new rows")
    if config.impute not in ("median", "knn", "missforest", "none") or config.normalize not in ("zscore", "robust", "none") or config.select not in ("none", "ttest", "lasso", "pca"):
        raise InputError("unknown step")
    text = [c for c in numeric if isinstance(train.schema[c].dataType, T.StringType)]
    numbers = set(looks_numeric(train, text))
    numeric, categorical = [c for c in numeric if c not in text or c in numbers], [*categorical, *[c for c in text if c not in numbers]]
    _, levels = ensure_levels(train, categorical)
    keep = [c for c in (id_col, y) if c]
    x = encode(train, keep, numeric, categorical, levels)
    names = [c for c in x.columns if c not in keep]
    n = train.count()
    raw = column_stats(x, names, n)
    stats = {c: {"median": raw[c]["median"], "mad": raw[c]["mad"]} for c in names}
    if config.winsorize:
        x = x.select(*keep, *[winsorized(F.col(c), stats[c], config) for c in names])
    after = column_stats(x, names, n) if config.winsorize else raw
    any_missing = any(s["missing"] for s in after.values())
    if config.impute == "none" and any_missing:
        warn("missing values: medians with indicators are used", FallbackWarning)
    for c in names:
        stats[c] |= {"fill": after[c]["median"] if any_missing else None, "indicator": config.impute == "none" and bool(after[c]["missing"]), "sd": after[c]["sd"], "after_median": after[c]["median"]}
    model = GuardModel(config, numeric, categorical, levels, stats, names)
    if config.impute == "knn":
        model.reference = x
        x = knn_fill(x, keep, x, names, stats, config.knn_k)
    elif config.impute == "missforest" and any_missing:
        model.forests = forest_fit(x, names, stats, config)
        x = forest_fill(x, keep, names, stats, model.forests)
    filled = x.select(*keep, *[F.coalesce(F.col(c), F.lit(stats[c]["fill"])).alias(c) for c in names])
    done = column_stats(filled, names, n) if config.normalize != "none" else after
    for c in names:
        s, d = stats[c], done[c]
        centre, scale = {"zscore": (d["mean"], d["sd"]), "robust": (d["median"], (d["mad"] or 0.0) * ROBUST), "none": (0.0, 1.0)}[config.normalize]
        s |= {"centre": centre or 0.0, "scale": scale if scale and scale >= 1e-12 else 1.0}
    scaled = filled.select(*keep, *[e for c in names for e in model._finish(c)])
    narrow = config.var_thresh > 0 or config.iqr_thresh > 0
    kept = filtered(column_stats(scaled, names, n), config) if narrow else names
    model.columns = kept + [f"{c}__missing" for c in kept if stats[c]["indicator"]]
    model.diagnostics = {"n_train": n, "p_in": len(numeric) + len(categorical), "p_after_encode": len(names), "removed_by_filter": len(names) - len(kept)}
    if config.select == "ttest" and y:
        top = config.top_k or max(50, -(-len(model.columns) // 10))
        model.columns = [r["feature"] for r in welch(scaled, model.columns, y).where(F.col("rank") <= top).orderBy("rank").collect()]
    elif config.select == "lasso" and y:
        model.columns = lasso_columns(scaled, model.columns, y, config.task)
    elif config.select == "pca":
        model.rotation = principal_axes(scaled, model.columns, min(50, len(model.columns)))
    model.diagnostics["p_out"] = model.rotation.shape[1] if model.rotation is not None else len(model.columns)
    return model


def filtered(stats: dict[str, dict], config: GuardConfig) -> list[str]:
    """Columns whose variance and IQR reach the thresholds that are above 0; min_keep brings the best others back."""
    ok = lambda s: (config.var_thresh <= 0 or (s["var"] or 0.0) >= config.var_thresh) and (config.iqr_thresh <= 0 or (s["iqr"] or 0.0) >= config.iqr_thresh)
    kept = {c for c, s in stats.items() if ok(s)}
    if config.min_keep and len(kept) < config.min_keep:
        rank = sorted(stats, key=lambda c: (-((stats[c]["var"] or 0.0) + (stats[c]["iqr"] or 0.0)), c))
        kept |= set([c for c in rank if c not in kept][: config.min_keep - len(kept)])
    return [c for c in stats if c in kept]


def long_form(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """keep, feature, x: one row for each column."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select(*keep, "f.*")


def welch(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """feature, t, rank: Welch's t of each column between y = 1 and y = 0 (infinite without spread), ranked by size."""
    g = long_form(df, columns, y).where(F.col("x").isNotNull()).groupBy("feature").agg(*[e.alias(n) for k in (0, 1) for n, e in ((f"m{k}", F.avg(F.when(F.col(y) == k, F.col("x")))), (f"v{k}", F.var_samp(F.when(F.col(y) == k, F.col("x")))), (f"n{k}", F.count_if(F.col(y) == k)))])
    se = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    t = F.when((F.col("n1") < 2) | (F.col("n0") < 2), None).when(se == 0, float("inf")).otherwise((F.col("m1") - F.col("m0")) / se)
    return g.select("feature", t.alias("t")).withColumn("rank", F.row_number().over(Window.orderBy(F.abs("t").desc_nulls_last(), "feature")))  # one row for each feature


def knn_fill(df: DataFrame, keep: list[str], reference: DataFrame, columns: list[str], stats: dict[str, dict], k: int) -> DataFrame:
    """Nulls as the mean over the k nearest other reference rows of their median-filled values.

    Distances are Euclidean on median-filled columns over their train standard
    deviations, rounded to nine digits, ties by the reference rows' order in
    keep[0]. Reference rows fall into the cells of a kd tree, whose cuts are
    those of a sample (they settle the work, not the result). A row with holes
    is compared within its own cell, then within all others that may hold a row
    as near as its k-th so far; of equal reference rows only those are sent
    that can be among the k nearest. No task holds more than a cell and
    ASKING_ROWS rows with holes, unless very many reference rows can't be cut.
    In many columns most cells are in reach, and the work grows with the product
    of the two tables' rows.
    """
    from larkspur.functions.neighbours import Cells
    from larkspur.operators.splits import checkpointed

    key = keep[0] if keep and keep[0] in reference.columns else None
    if key is None:
        raise InputError("kNN imputation needs an id column")
    fills = {c: stats[c].get("after_median", stats[c]["median"]) for c in columns}
    hole = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns}
    rows = df.select(*keep, *columns).withColumn("__ask", F.when(F.greatest(*hole.values(), F.lit(False)), F.struct(F.col(key).alias("k"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])))
    names = [f"x{j}" for j in range(len(columns))]
    full = [F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(n) for n, c in zip(names, columns)]
    known = reference.select(F.col(key).alias("id"), *full)
    sd = np.array([stats[c]["sd"] if stats[c].get("sd") else 1.0 for c in columns])
    middle = np.array([fills[c] for c in columns], dtype=float)
    n = known.count()
    n_cells = max(1, -(-n // REFERENCE_ROWS))
    sampled = min(CUT_ROWS * n_cells, max(CUT_ROWS, CUT_VALUES // len(columns)))
    sample = known.where(F.pmod(F.xxhash64("id", *names), F.lit(max(1, n // sampled))) == 0).select(*names).limit(2 * sampled).toPandas().to_numpy(dtype=float).reshape(-1, len(columns)) / sd if n_cells > 1 else np.empty((0, len(columns)))
    cells = Cells(sample[np.isfinite(sample).all(axis=1)], n_cells, len(columns))
    asked = rows.where("__ask is not null").select("__ask").distinct().select("__ask.*")
    asked = checkpointed(asked.mapInPandas(_asking(cells, names, sd, middle), T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())])))
    own = _near(asked, known, cells, names, sd, middle, k, True)
    own = checkpointed(own)
    far = own.where(F.size("more") > 0)
    others = _near(checkpointed(far.select("k", *names, F.explode("more").alias("cell"))), known, cells, names, sd, middle, k, False)
    merged = far.select("k", *names, "near").unionByName(others.select("k", *names, "near")).groupBy(F.struct("k", *names).alias("__ask")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    best = own.where(F.size("more") == 0).select(F.struct("k", *names).alias("__ask"), "near").unionByName(merged).where(F.size("near") > 0)
    mean = lambda j: F.aggregate("near", F.lit(0.0), lambda s, r: s + F.element_at(r["v"], j + 1)) / F.size("near")
    best = best.select("__ask", F.array(*[mean(j) for j in range(len(columns))]).alias("__mean"))
    filled = [F.when(hole[c], F.coalesce(F.element_at("__mean", j + 1), F.lit(fills[c])).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) for j, c in enumerate(columns)]
    holed = rows.where("__ask is not null")
    holed = holed.join(best, holed["__ask"].eqNullSafe(best["__ask"]), "left").select(*keep, *filled)
    return rows.where("__ask is null").select(*keep, *columns).unionByName(holed)


def _asking(cells, names: list[str], sd: np.ndarray, middle: np.ndarray):
    def place(batches):
        for pdf in batches:
            values = pdf[names].to_numpy(dtype=float)
            at = cells.of(np.where(np.isnan(values), middle, values) / sd)
            yield pdf.assign(cell=at)[at >= 0]  # a row that isn't finite is near to none

    return place


def _near(asked: DataFrame, known: DataFrame, cells, names: list[str], sd: np.ndarray, middle: np.ndarray, k: int, first: bool) -> DataFrame:
    """k, names, near, more: each asking row's k nearest rows of its cell as (d, id, v), and the other cells that may hold nearer ones (if first). asked: k, names, cell, written."""
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from larkspur.functions import neighbours as N

    parts = {r["cell"]: -(-r["count"] // ASKING_ROWS) for r in asked.groupBy("cell").count().collect()}  # a row for each cell
    times = np.array([parts.get(c, 0) for c in range(len(cells.lo))])
    dealt = F.create_map(*[F.lit(v) for c, m in parts.items() if m > 1 for v in (c, m)]) if any(m > 1 for m in parts.values()) else None
    salt = F.pmod(F.xxhash64("k", *names), F.coalesce(dealt[F.col("cell")], F.lit(1))).cast("int") if dealt is not None else F.lit(0)
    left = asked.withColumn("part", salt)

    def place(batches):
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            at = cells.of(x / sd)
            some = np.flatnonzero((at >= 0) & (np.where(at >= 0, times[at], 0) > 0))
            some = some[N.needed(x[some], _codes(pdf["id"].iloc[some])[0], k)]
            again = times[at[some]]
            some, part = np.repeat(some, again), np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
            yield pdf.iloc[some].assign(cell=at[some], part=part.astype(np.int32))

    right = known.mapInPandas(place, T.StructType([*known.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType())]))
    one = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("id", known.schema["id"].dataType), T.StructField("v", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([asked.schema["k"], *[asked.schema[c] for c in names], T.StructField("near", T.ArrayType(one)), T.StructField("more", T.ArrayType(T.IntegerType()))])
    told = to_arrow_schema(schema)
    matrix = lambda t: np.column_stack([t.column(c).to_numpy().astype(float) for c in names])

    def near_of(ask: pa.Table, block: pa.Table) -> pa.Table:
        values, table = matrix(ask), matrix(block)
        code, known_ids = _codes(block.column("id").to_pandas())
        rows = N.needed(table, code, k)
        table, code, x = table[rows], code[rows], table[rows] / sd
        filled = np.where(np.isnan(values), middle, values) / sd
        at, found, d = N.k_nearest(x, code, filled, known_ids.get_indexer(pd.Index(ask.column("k").to_pandas())), k)
        starts = np.searchsorted(at, np.arange(len(ask) + 1))
        flat = pa.array(table[found].ravel())
        near = pa.StructArray.from_arrays([pa.array(d), block.column("id").combine_chunks().take(pa.array(rows[found])), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(names)), flat)], ["d", "id", "v"])
        more, ends = np.empty(0, np.int32), np.zeros(len(ask) + 1, np.int32)
        if first:
            bound = np.full(len(ask), np.inf)
            whole = np.diff(starts) == k
            bound[whole] = d[starts[1:][whole] - 1]
            who, more = cells.others(ask.column("cell")[0].as_py() if len(ask) else -1, filled, bound)
            ends = np.searchsorted(who, np.arange(len(ask) + 1))
        lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), v) for o, v in ((starts, near), (ends, pa.array(more.astype(np.int32))))]
        return pa.Table.from_arrays([*[ask.column(c) for c in ("k", *names)], *lists], names=["k", *names, "near", "more"]).cast(told)

    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(near_of, schema)


def _codes(ids):
    """(each id's place in order, the distinct ids); nulls come last."""
    import pandas as pd

    code, distinct = pd.factorize(ids, sort=True)
    return np.where(code < 0, len(distinct), code), pd.Index(distinct)


def forest_fit(df: DataFrame, columns: list[str], stats: dict[str, dict], config: GuardConfig) -> dict:
    """Random forests of each column with nulls on all others, refitted for some rounds from median fills; the last round's are kept."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    holes = [c for c in columns if stats[c]["fill"] is not None and df.where(F.col(c).isNull()).limit(1).count()]
    marked = df.select(*[F.coalesce(F.col(c), F.lit(stats[c]["fill"] or 0.0)).alias(c) for c in columns], *[F.col(c).isNull().alias(f"__null_{c}") for c in holes])
    models = {}
    for _ in range(config.forest_rounds):
        for c in holes:
            others = [o for o in columns if o != c]
            rows = VectorAssembler(inputCols=others, outputCol="__x").transform(marked)
            models[c] = RandomForestRegressor(featuresCol="__x", labelCol=c, predictionCol="__p", numTrees=config.forest_trees, seed=1).fit(rows.where(f"not `__null_{c}`"))
            marked = models[c].transform(rows).withColumn(c, F.when(F.col(f"__null_{c}"), F.col("__p")).otherwise(F.col(c))).drop("__x", "__p")
    return models


def forest_fill(df: DataFrame, keep: list[str], columns: list[str], stats: dict[str, dict], forests: dict) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    out = df.select(*keep, *[F.coalesce(F.col(c), F.lit(stats[c]["fill"] if stats[c]["fill"] is not None else stats[c]["median"])).alias(c) for c in columns], *[F.col(c).isNull().alias(f"__null_{c}") for c in forests])
    for c, model in forests.items():
        rows = VectorAssembler(inputCols=[o for o in columns if o != c], outputCol="__x", handleInvalid="keep").transform(out)
        out = model.transform(rows).withColumn(c, F.when(F.col(f"__null_{c}"), F.col("__p")).otherwise(F.col(c))).drop("__x", "__p")
    return out.select(*keep, *columns)


def lasso_columns(df: DataFrame, columns: list[str], y: str, task: str | None = None) -> list[str]:
    """Columns with a weight in an almost unpenalised lasso (of any class, for several); the 50 heaviest if none has. Constant columns have none."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=columns, outputCol="__x").transform(df.where(F.col(y).isNotNull()).withColumn("__y", F.col(y).cast("double")))
    settings = {"featuresCol": "__x", "labelCol": "__y", "elasticNetParam": 1.0, "regParam": 1e-3, "standardization": False}
    if task == "multiclass":
        weights = np.abs(LogisticRegression(family="multinomial", **settings).fit(rows).coefficientMatrix.toArray()).sum(axis=0)
    else:
        binary = rows.select("__y").distinct().limit(3).count() == 2
        weights = np.abs((LogisticRegression if binary else LinearRegression)(**settings).fit(rows).coefficients.toArray())
    order = np.argsort(-weights, kind="stable")
    return [columns[i] for i in order if weights[i] > 0] or [columns[i] for i in order[:50]]


def second_moments(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of each two columns, nulls as 0: a matrix for each partition, whose rows are added by their number."""
    import pandas as pd

    p = len(columns)

    def products(batches):
        total = np.zeros((p, p))
        for pdf in batches:
            x = np.nan_to_num(pdf.to_numpy(dtype=float))
            total += x.T @ x
        yield pd.DataFrame({"i": range(p), "g": [row.tobytes() for row in total]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "g": [np.sum([np.frombuffer(g) for g in pdf["g"]], axis=0).tobytes()]})

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInPandas(products, "i int, g binary").groupBy("i").applyInPandas(add, "i int, g binary").collect()
    out = np.zeros((p, p))
    for r in rows:
        out[r["i"]] = np.frombuffer(r["g"])
    return out


def principal_axes(df: DataFrame, columns: list[str], k: int) -> np.ndarray:
    """(columns, k): axes of the uncentred second-moment matrix; the sign makes the largest weight positive."""
    values, vectors = np.linalg.eigh(second_moments(df, columns))
    out = vectors[:, np.argsort(-values, kind="stable")[:k]]
    return out * np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])


def design_matrix(train: DataFrame, test: DataFrame, id_col: str, numeric: list[str], categorical: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both tables encoded by train's levels, without the columns that are constant in train; what test lacks is 0."""
    _, levels = ensure_levels(train, list(categorical))
    x = encode(train, [id_col], numeric, list(categorical), levels)
    names = [c for c in x.columns if c != id_col]
    sd = x.agg(*[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(names)]).first()
    kept = [c for i, c in enumerate(names) if sd[i]]
    out = encode(test, [id_col], numeric, list(categorical), levels)
    return x.select(id_col, *kept), out.select(id_col, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in kept])


def na_counts(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """by, feature, n, n_missing; NaN and infinities count as missing."""
    clean_df = df.select(*by, *[clean(c).alias(c) for c in columns])
    return long_form(clean_df, columns, *by).groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("n_missing"))


def impute_guarded(train: DataFrame, test: DataFrame, columns: list[str], id_col: str, method: str = "median", k: int = 5, winsorize: bool = True, winsor_thresh: float = 3.0) -> dict:
    """Imputation alone: train and test filled by a model of train; summary counts the missing values of both."""
    model = fit(train, columns, config=GuardConfig(winsorize=winsorize, winsor_k=winsor_thresh, impute=method, knn_k=k, normalize="none"), id_col=id_col)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")), allowMissingColumns=True)
    return {"train": model.transform(train, [id_col]), "test": model.transform(test, [id_col]), "model": model, "summary": na_counts(both, columns, ["part"])}


def to_pipeline(config: GuardConfig, columns: list[str]):
    """An unfitted pyspark.ml Pipeline of the nearest stages; what has none is told and left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler

    stages = []
    if config.impute != "none":
        if config.impute != "median":
            warn(f"{config.impute} imputation has no pipeline stage: medians are used", FallbackWarning)
        stages.append(Imputer(strategy="median", inputCols=columns, outputCols=columns))
    stages.append(VectorAssembler(inputCols=columns, outputCol="features0"))
    at = "features0"
    if config.normalize != "none":
        if config.normalize == "robust":
            warn("robust scaling has no pipeline stage: z-scores are used", FallbackWarning)
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol=at, outputCol="features1"))
        at = "features1"
    if config.var_thresh > 0:
        stages.append(VarianceThresholdSelector(varianceThreshold=config.var_thresh, featuresCol=at, outputCol="features2"))
        at = "features2"
    if config.select == "pca":
        stages.append(PCA(k=min(50, len(columns)), inputCol=at, outputCol="features3"))
    elif config.select in ("ttest", "lasso"):
        warn(f"{config.select} selection has no pipeline stage and is left out", FallbackWarning)
    return Pipeline(stages=stages)
