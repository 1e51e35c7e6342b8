"""Leakage-safe split plans.

A plan is a table of test folds, ``(id, repeat_id, fold)``; train rows follow
from it by a condition: another fold of the same repeat, and for time plans an
inequality against the test block's times, for combined plans anti-joins on
the other axes. That compact form is what is kept; ``fold_index()`` spells out
both roles where an operator needs them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.errors import FallbackWarning, FoldWarning, InputError, OverlapError, SplitError, is_strict, strict_checks, warn
from larkspur.ids import hash_order, hash_ranked, need_columns, value_ranked

MODES = ("subject_grouped", "batch_blocked", "study_loocv", "time_series", "combined")


@dataclass
class SplitPlan:
    mode: str
    samples: DataFrame  # id, metadata columns
    id_col: str
    assign: DataFrame  # id, repeat_id, fold
    info: dict = field(default_factory=dict)

    @property
    def repeats(self) -> int:
        return self.info["repeats"]

    def test(self) -> DataFrame:
        return self.assign.select(self.id_col, "repeat_id", "fold")

    def train(self) -> DataFrame:
        """(id, repeat_id, fold): the rows each fold may learn from."""
        if self.mode == "time_series":
            return self._train_before()
        folds = self.assign.groupBy("repeat_id").agg(F.collect_set("fold").alias("folds"))  # at most v for each repeat
        other = self.assign.withColumnRenamed("fold", "own").join(F.broadcast(folds), "repeat_id")
        rows = other.select(self.id_col, "repeat_id", F.explode(F.array_except("folds", F.array("own"))).alias("fold"))
        for axis in self.info.get("exclude", []):
            levels = self.assign.join(self.samples.select(self.id_col, axis), self.id_col).select("repeat_id", "fold", axis).distinct()
            rows = rows.join(self.samples.select(self.id_col, axis), self.id_col).join(levels, ["repeat_id", "fold", axis], "left_anti").drop(axis)
        return rows.select(self.id_col, "repeat_id", "fold")

    def blocks(self) -> DataFrame:
        """Each time fold's first and last test time; at most v rows for each repeat."""
        t = self.samples.select(self.id_col, as_number(F.col(self.info["time"]), self._kind()).alias("__t"))
        return self.assign.join(t, self.id_col).groupBy("repeat_id", "fold").agg(F.min("__t").alias("tmin"), F.max("__t").alias("tmax"), F.count(F.lit(1)).alias("test_n"))

    def _train_before(self) -> DataFrame:
        i, t, unit = self.info, as_number(F.col(self.info["time"]), self._kind()), 1_000_000 if self._kind().startswith("timestamp") else 1
        gap = i["horizon"] + i["purge"]
        allowed = t < F.col("tmin") if gap == 0 else t <= F.col("tmin") - gap * unit
        if i["embargo"] > 0:
            allowed = allowed & (t <= F.col("tmax") - i["embargo"] * unit)
        return self.samples.join(F.broadcast(self.blocks()), allowed).select(self.id_col, "repeat_id", "fold")

    def _kind(self) -> str:
        return self.samples.schema[self.info["time"]].dataType.typeName()

    def fold_index(self) -> DataFrame:
        """(id, repeat_id, fold, role), of the folds that have both roles."""
        both = self.test().withColumn("role", F.lit("test")).unionAll(self.train().withColumn("role", F.lit("train")))
        return both.join(self.valid_folds(), ["repeat_id", "fold"], "left_semi").select(self.id_col, "repeat_id", "fold", "role")

    def summary(self) -> DataFrame:
        """(repeat_id, fold, train_n, test_n); folds without train rows, and time folds of under 3 test rows, are left out."""
        test = self.test().groupBy("repeat_id", "fold").agg(F.count(F.lit(1)).alias("test_n"))
        train = self.train().groupBy("repeat_id", "fold").agg(F.count(F.lit(1)).alias("train_n"))
        out = test.join(train, ["repeat_id", "fold"]).select("repeat_id", "fold", "train_n", "test_n")
        return out.where("test_n >= 3") if self.mode == "time_series" else out

    def valid_folds(self) -> DataFrame:
        return F.broadcast(self.summary().select("repeat_id", "fold"))

    def validate(self) -> SplitPlan:
        """An action: at least one fold is valid; time folds left out are told."""
        made = self.summary().count()
        if not made:
            raise SplitError("No valid folds")
        if self.mode == "time_series" and made < self.assign.select("repeat_id", "fold").distinct().count():
            warn("time folds without train rows or with under 3 test rows are left out", FoldWarning)
        if is_strict(self.samples.sparkSession):
            check_split_overlap(self, stop_on_fail=True)
        return self

    def plan_hash(self) -> DataFrame:
        """(repeat_id, plan_hash): equal plans have equal hashes, whatever the partitioning.

        Rows' digests are combined by fold and value range, so no task holds all of them.
        """
        row = self.assign.select("repeat_id", "fold", F.md5(F.concat_ws("|", "fold", F.col(self.id_col).cast("string"))).alias("h"))
        word = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("long")
        sums = row.groupBy("repeat_id").agg(*[F.sum(word(a)).alias(f"s{a}") for a in (1, 9, 17, 25)], F.count(F.lit(1)).alias("n"))
        return sums.select("repeat_id", F.sha2(F.concat_ws("|", "s1", "s9", "s17", "s25", "n"), 256).alias("plan_hash"))


def as_number(t: Column, kind: str) -> Column:
    """Microseconds of timestamps, days of dates, other times as they are. Gaps are in seconds, days, or the column's unit."""
    return F.unix_micros(t.cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(t) if kind == "date" else t


def make_split_plan(
    df: DataFrame, mode: str, *, id_col: str, group: str | None = None, batch: str | None = None, study: str | None = None, time: str | None = None, outcome: str | None = None,
    constraints: list[str] | None = None, v: int = 5, repeats: int = 1, stratify: bool = False, seed: int | None = 1, horizon: float = 0, purge: float = 0, embargo: float = 0, components: bool = True, check: bool = True,
) -> SplitPlan:
    """A plan over the rows of df, which id_col identifies.

    combined mode takes the axes in constraints, the first of which drives the
    folds. Repeat r is seeded apart from the others.
    """
    if mode not in MODES:
        raise InputError(f"mode is one of {', '.join(MODES)}")
    if v < 2 or repeats < 1:
        raise InputError("v is at least 2 and repeats at least 1")
    strict_checks(is_strict(df.sparkSession), seed, False, mode)
    seed = 1 if seed is None else seed
    if mode != "time_series" and (purge or embargo):
        warn("purge and embargo only matter for time_series", FallbackWarning)
    axes = list(constraints or [])
    need = {"subject_grouped": [group], "batch_blocked": [batch], "study_loocv": [study], "time_series": [time], "combined": axes}[mode]
    if None in need or (mode == "combined" and len(axes) < 2):
        raise InputError(f"{mode} needs its columns" if mode != "combined" else "combined needs two axes or more")
    if check:
        need_columns(df, id_col, *need)
    keep = list(dict.fromkeys(c for c in [id_col, group, batch, study, time, outcome, *axes] if c))
    samples = df.select(*keep)
    info = {"v": v, "repeats": repeats, "seed": seed, "stratify": stratify, "group": group, "batch": batch, "study": study, "time": time, "horizon": horizon, "purge": purge, "embargo": embargo, "exclude": []}
    label = outcome if stratify else None
    if stratify and outcome is None:
        raise InputError("stratify needs an outcome")
    if mode == "subject_grouped":
        assign = _by_level(samples, id_col, group, label, v, repeats, seed)
    elif mode == "batch_blocked":
        n = samples.select(batch).distinct().count()
        assign = _by_level(samples, id_col, batch, None if v >= n else label, min(v, n), repeats, seed)
    elif mode == "study_loocv":
        info["repeats"] = 1
        levels = samples.select(study).distinct()
        folds = levels.withColumn("fold", F.dense_rank().over(Window.orderBy(study)).cast("int"))  # one row for each study
        assign = samples.join(folds, study).select(id_col, F.lit(1).alias("repeat_id"), "fold")
    elif mode == "time_series":
        info["repeats"] = 1
        assign = _time_blocks(samples, id_col, time, v)
    else:
        info["exclude"] = axes[1:]
        packed = _component_folds(samples, axes, label, v, repeats, seed) if components else None
        assign = samples.join(packed, axes[0]).select(id_col, "repeat_id", "fold") if packed is not None else _by_level(samples, id_col, axes[0], label, v, repeats, seed)
    return SplitPlan(mode, samples, id_col, assign, info)


def majority(df: DataFrame, by: str, label: str) -> DataFrame:
    """(by, label): each level's most frequent label, ties to the smallest."""
    counts = df.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def _by_level(samples: DataFrame, id_col: str, level: str, label: str | None, v: int, repeats: int, seed: int) -> DataFrame:
    """Levels in random order, dealt to folds in turn; with a label, within each majority label."""
    levels = majority(samples, level, label).withColumnRenamed(label, "__label") if label else samples.select(level).distinct()
    each = levels.withColumn("repeat_id", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    by = ["repeat_id", "__label"] if label else ["repeat_id"]
    ranked = hash_ranked(each, by, hash_order(seed, "split", "repeat_id", level), level)
    folds = ranked.select(level, "repeat_id", ((F.col("rn") - 1) % v + 1).cast("int").alias("fold"))
    return samples.select(id_col, level).join(folds, level).select(id_col, "repeat_id", "fold")


def _time_blocks(samples: DataFrame, id_col: str, time: str, v: int) -> DataFrame:
    """Equal-width bins over the rank by time, closed at the right: block i is max(1, ceil((i - 1) v / (n - 1)))."""
    kind = samples.schema[time].dataType.typeName()
    n = samples.count()
    ranked = value_ranked(samples.select(id_col, as_number(F.col(time), kind).alias("__t")), [], "__t", id_col)
    steps = F.expr(f"((rn - 1) * {v} + {max(n - 2, 0)}) div {max(n - 1, 1)}")
    return ranked.select(id_col, F.lit(1).alias("repeat_id"), F.greatest(F.lit(1), steps).cast("int").alias("fold"))


def constraint_components(samples: DataFrame, axes: list[str], rounds: int = 50) -> DataFrame:
    """(level of the first axis, component): levels linked through any level of another axis.

    Least labels spread over the distinct (level, axis value) pairs until they
    settle; each round is written, so the plan doesn't grow.
    """
    first = axes[0]
    links = None
    for axis in axes[1:]:
        part = samples.select(F.col(first).cast("string").alias("g"), F.concat(F.lit(axis + "="), F.col(axis).cast("string")).alias("c")).distinct()
        links = part if links is None else links.unionAll(part)
    links = links.where("c is not null")
    links = checkpointed(links)
    labels = checkpointed(samples.select(F.col(first).cast("string").alias("g")).distinct().withColumn("component", F.col("g")))
    for _ in range(rounds):
        by_value = links.join(labels, "g").groupBy("c").agg(F.min("component").alias("m"))
        better = links.join(by_value, "c").groupBy("g").agg(F.min("m").alias("m"))
        nxt = labels.join(better, "g", "left").select("g", F.least("component", F.coalesce("m", "component")).alias("nxt"), "component")
        # a label is itself a level: its own label is at least as good
        hop = nxt.select(F.col("g").alias("nxt"), F.col("nxt").alias("hop"))
        nxt = checkpointed(nxt.join(hop, "nxt", "left").select("g", F.least("nxt", F.coalesce("hop", "nxt")).alias("n"), "component"))
        changed = nxt.where("n != component").limit(1).count()
        labels = nxt.select("g", F.col("n").alias("component"))
        if not changed:
            break
    else:
        raise SplitError(f"the components of {', '.join(axes)} didn't settle in {rounds} rounds")
    return samples.select(first).distinct().join(labels, F.col(first).cast("string") == F.col("g")).select(first, "component")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only sessions with a local master may leave that unset: then it's a temporary folder."""
    import tempfile

    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise InputError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="larkspur-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _component_folds(samples: DataFrame, axes: list[str], label: str | None, v: int, repeats: int, seed: int) -> DataFrame | None:
    """(level, repeat_id, fold): components go to the fold with the fewest levels (of their label, if stratified) so far.

    Each repeat and label is packed in hash order by one task, which holds v
    counters and a batch of rows. None where there are fewer components than
    folds: levels are then dealt at random.
    """
    spark, first = samples.sparkSession, axes[0]
    comps = checkpointed(constraint_components(samples, axes))
    own = comps.join(majority(samples, first, label).withColumnRenamed(label, "__label"), first, "left") if label else comps.withColumn("__label", F.lit(""))
    sized = own.groupBy("component", "__label").agg(F.count(F.lit(1)).alias("k")).groupBy("component").agg(F.min_by("__label", F.struct(-F.col("k"), F.col("__label"))).alias("__label"), F.sum("k").alias("n"))
    sized = checkpointed(sized)
    total = sized.count()
    if total < v:
        warn(f"{total} constraint-linked components for {v} folds: levels are dealt at random", FallbackWarning)
        return None
    each = sized.withColumn("repeat_id", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("h", hash_order(seed, "pack", "repeat_id", "component"))
    strata = F.coalesce(F.concat(F.lit("="), F.col("__label").cast("string")), F.lit("")).alias("stratum")
    rows = each.select("component", "repeat_id", "n", "h", strata).repartition("repeat_id", "stratum").sortWithinPartitions("repeat_id", "stratum", "h", "component")

    def pack(batches):
        load: dict[tuple, list[int]] = {}
        for pdf in batches:
            folds = []
            for repeat, stratum, n in zip(pdf["repeat_id"], pdf["stratum"], pdf["n"]):
                counts = load.setdefault((repeat, stratum), [0] * v)
                k = counts.index(min(counts))
                counts[k] += int(n)
                folds.append(k + 1)
            yield pdf[["component", "repeat_id"]].assign(fold=folds)

    folds = rows.mapInPandas(pack, "component string, repeat_id int, fold int")
    return comps.join(folds, "component").select(first, "repeat_id", "fold")


def nested_plan(plan: SplitPlan, v: int = 3, seed: int | None = None) -> DataFrame:
    """(outer_repeat, outer_fold, id, inner_fold): inner folds of every outer fold's train rows, at once.

    Ids are global. The level that drove the outer plan drives the inner one;
    train rows of time plans are cut into v blocks of time again.
    """
    strict_checks(is_strict(plan.samples.sparkSession), plan.info["seed"], True, plan.mode)
    if plan.mode == "time_series":
        when = as_number(F.col(plan.info["time"]), plan.samples.schema[plan.info["time"]].dataType.typeName()).cast("double")
        rows = plan.train().join(plan.samples.select(plan.id_col, when.alias("__t")), plan.id_col)
        ranked = value_ranked(rows, ["repeat_id", "fold"], "__t", plan.id_col)
        sizes = rows.groupBy("repeat_id", "fold").agg(F.count(F.lit(1)).alias("__n"))
        block = F.greatest(F.lit(1), F.expr(f"((rn - 1) * {v} + __n - 2) div greatest(__n - 1, 1)")).cast("int")
        return ranked.join(F.broadcast(sizes), ["repeat_id", "fold"]).select(F.col("repeat_id").alias("outer_repeat"), F.col("fold").alias("outer_fold"), plan.id_col, block.alias("inner_fold"))
    level = plan.info["group"] or plan.info["batch"] or plan.info["study"]
    if level is None:
        raise InputError("nested plans need a grouped outer plan")
    seed = plan.info["seed"] + 1 if seed is None else seed
    train = plan.train().join(plan.samples.select(plan.id_col, level), plan.id_col)
    levels = train.select("repeat_id", "fold", level).distinct()
    ranked = hash_ranked(levels, ["repeat_id", "fold"], hash_order(seed, "inner", "repeat_id", "fold", level), level)
    folds = ranked.select("repeat_id", "fold", level, ((F.col("rn") - 1) % v + 1).cast("int").alias("inner_fold"))
    joined = train.join(folds, ["repeat_id", "fold", level])
    return joined.select(F.col("repeat_id").alias("outer_repeat"), F.col("fold").alias("outer_fold"), plan.id_col, "inner_fold")


def overlap_columns(plan: SplitPlan) -> list[str]:
    i = plan.info
    return {"subject_grouped": [i["group"]], "batch_blocked": [i["batch"]], "study_loocv": [i["study"]], "time_series": [], "combined": i["exclude"]}[plan.mode]


def check_split_overlap(plan: SplitPlan, columns: list[str] | None = None, stop_on_fail: bool = False) -> DataFrame:
    """(repeat_id, fold, col, n_overlap, n_train, n_test, pass): the levels that train and test share, of each column.

    One aggregate for all columns: levels are unpivoted, and each counts by the
    roles it is seen in.
    """
    columns = overlap_columns(plan) if columns is None else columns
    if not columns:
        raise InputError("no columns to check")
    roles = plan.fold_index().join(plan.samples.select(plan.id_col, *[F.col(c).cast("string").alias(c) for c in columns]), plan.id_col)
    long = roles.select("repeat_id", "fold", "role", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("level")) for c in columns])).alias("x")).select("repeat_id", "fold", "role", "x.col", "x.level")
    seen = long.where("level is not null").groupBy("repeat_id", "fold", "col", "level").agg(F.max((F.col("role") == "train").cast("int")).alias("tr"), F.max((F.col("role") == "test").cast("int")).alias("te"))
    out = seen.groupBy("repeat_id", "fold", "col").agg(F.sum(F.col("tr") * F.col("te")).alias("n_overlap"), F.sum("tr").alias("n_train"), F.sum("te").alias("n_test")).withColumn("pass", F.col("n_overlap") == 0)
    if stop_on_fail and (bad := out.where("not pass").limit(1).collect()):
        raise OverlapError(f"{bad[0]['n_overlap']} levels of {bad[0]['col']} are in train and test of fold {bad[0]['fold']}")
    return out
