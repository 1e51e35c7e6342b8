"""Fold tables from and to other tools, and plans from a separate specification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.errors import InputError
from larkspur.operators.splits import SplitPlan, make_split_plan

#: Names that a foreign table's columns are recognised by, first match first.
ROLES = {"group": ("group", "subject"), "batch": ("batch",), "study": ("study",), "time": ("time", "date", "index")}


def import_folds(folds: DataFrame, samples: DataFrame, id_col: str, repeat: str = "id", fold: str = "id2", levels: dict[str, list[str]] | None = None, split_cols: dict[str, str] | None = None) -> SplitPlan:
    """A plan from assessment rows (id_col, fold labels). Labels are numbered in the order of levels (column -> labels), or sorted.

    With only one label column it is the fold and there is one repeat. The mode
    follows from split_cols (role -> column) or else from the columns that
    samples has; none or several are an error.
    """
    two = fold in folds.columns
    levels = levels or {}
    if unknown := set(split_cols or {}) - set(ROLES):
        raise InputError(f"unknown roles: {sorted(unknown)}")
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in levels[c]]), F.col(c)) if c in levels else F.col(c)
    number = lambda c: F.dense_rank().over(Window.orderBy(place(c))).cast("int")  # noqa: E731  of the distinct labels
    labels = folds.select(*([repeat, fold] if two else [repeat])).distinct()
    if two:
        repeats = labels.select(repeat).distinct().withColumn("repeat_id", number(repeat))
        named = labels.join(repeats, repeat).withColumn("fold_no", F.dense_rank().over(Window.partitionBy(repeat).orderBy(place(fold))).cast("int"))
    else:
        named = labels.withColumns({"repeat_id": F.lit(1), "fold_no": number(repeat)})
    assign = folds.join(named, [repeat, fold] if two else [repeat]).select(id_col, "repeat_id", F.col("fold_no").alias("fold"))
    if split_cols:
        found = {role: split_cols.get(role) for role in ROLES}
    else:
        found = {role: next((c for c in names if c in samples.columns), None) for role, names in ROLES.items()}
    modes = {"group": "subject_grouped", "batch": "batch_blocked", "study": "study_loocv", "time": "time_series"}
    have = [r for r in found if found[r]]
    if len(have) != 1:
        raise InputError("the plan's mode can't be told from the columns: " + (", ".join(have) or "none is known"))
    info = {"v": None, "repeats": assign.agg(F.max("repeat_id")).first()[0] or 0, "seed": None, "stratify": False, "horizon": 0, "purge": 0, "embargo": 0, "exclude": []} | {r: found[r] for r in ROLES}
    return SplitPlan(modes[have[0]], samples, id_col, assign, info)


def export_folds(plan: SplitPlan) -> DataFrame:
    """(id_col, id, id2, role): folds as labels; with one repeat id is the fold and id2 is null."""
    index = plan.fold_index()
    fold, rep = F.concat(F.lit("Fold"), "fold"), F.concat(F.lit("Repeat"), "repeat_id")
    one = plan.repeats == 1
    return index.select(plan.id_col, (fold if one else rep).alias("id"), (F.lit(None).cast("string") if one else fold).alias("id2"), "role")


def plan_from_spec(df: DataFrame, spec: DataFrame, sample_id: str, mode: str, **settings) -> SplitPlan:
    """A plan of df's rows with the group, batch, study or time columns of a specification, matched by sample id.

    Every row must be matched exactly once. Modes: subject, batch, study, time,
    composite; another counts as subject. composite takes the specification's
    grouping columns as its axes.
    """
    joined = df.join(spec, sample_id, "inner")
    n, m = df.count(), joined.count()
    if n != m:
        raise InputError(f"{n} rows, {m} after the join with the specification")
    kind = {"subject": "subject_grouped", "batch": "batch_blocked", "study": "study_loocv", "time": "time_series", "composite": "combined"}.get(mode, "subject_grouped")
    roles = {role: next((c for c in names if c in spec.columns), None) for role, names in ROLES.items()}
    if kind == "combined" and "constraints" not in settings:
        settings["constraints"] = [roles[r] for r in ("group", "batch", "study") if roles[r]]
    return make_split_plan(joined, kind, id_col=sample_id, **{r: c for r, c in roles.items() if c} | settings)
