"""Management scenarios on cell-day effort.

All scenarios of a sweep run in one plan: effort rows are exploded by a scenario
index and each rule is a column expression on literal parameter arrays. Only
the reallocation of displaced effort needs aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.nulls import later_of, require_columns
from ..session import staged
from .effort import METRICS

REGIONS = ("CenCA", "NorCA", "OR", "WA")

@dataclass(frozen=True)
class Scenario:
    """One parameter row. Dates are (month, day) anchors placed in each crab year; None switches a rule off."""

    scenario: str
    scenario_number: int = 1
    preseason_days: int = 3
    early_method: str = "remove"
    delay: tuple[int, int] | None = None
    delay_regions: tuple[str, ...] = ("All",)
    delay_method: str | None = None
    delay_fidelity: str = "spatial"
    closure: tuple[int, int] | None = None
    closure_regions: tuple[str, ...] = ("All",)
    closure_method: str | None = None
    closure_pct: float = 100.0
    depth_shallow: float | None = None
    depth_deep: float | None = None
    before: tuple[int, int] | None = None
    before_pct: float = 0.0
    before_regions: tuple[str, ...] = ("All",)
    after: tuple[int, int] | None = None
    after_pct: float = 0.0
    after_regions: tuple[str, ...] = ("All",)
    after_redist: bool = False
    after_redist_pct: float = 100.0

    def check(self) -> "Scenario":
        """Refuse parameter combinations that have no meaning."""
        for name, regions in (
            ("delay", self.delay_regions), ("closure", self.closure_regions),
            ("before", self.before_regions), ("after", self.after_regions),
        ):
            allowed = {*REGIONS, "All"} | ({"BIA"} if name == "closure" else set())
            if not set(regions) <= allowed:
                raise ValueError(f"{name}: unknown region in {regions}")
            if len(regions) > 1 and ({"All", "BIA"} & set(regions)):
                raise ValueError(f"{name}: 'All' and 'BIA' stand alone")
        for name, pct in (
            ("closure", self.closure_pct), ("before", self.before_pct), ("after", self.after_pct),
            ("after_redist", self.after_redist_pct),
        ):
            if not 0 <= pct <= 100:
                raise ValueError(f"{name}: percent outside 0..100")
        if self.early_method not in ("pile", "remove"):
            raise ValueError("early_method is pile or remove")
        if self.delay and self.delay_method not in ("remove", "depth", "lag", "pile"):
            raise ValueError("a delay needs delay_method remove, depth, lag or pile")
        if self.closure and self.closure_method not in ("remove", "depth", "temporal", "depth+temporal"):
            raise ValueError("a closure needs closure_method remove, depth, temporal or depth+temporal")
        if self.closure_method == "temporal" and self.closure_regions not in (("BIA",), ("CenCA",), ("NorCA",)):
            raise ValueError("a temporal closure covers exactly one of BIA, CenCA, NorCA")
        if self.delay and self.before and self.delay_method != "depth":
            raise ValueError("delay and early reduction go together only for delay_method depth")
        if self.closure and self.after and self.closure_method not in ("depth", "depth+temporal"):
            raise ValueError("closure and late reduction go together only for depth methods")
        if self.after_redist and (not self.after or self.after_regions not in (("CenCA",), ("NorCA",))):
            raise ValueError("after_redist needs a late reduction in exactly one of CenCA, NorCA")
        order = lambda md: ((md[0] + 1) % 12, md[1])
        if self.delay and self.closure and order(self.delay) >= order(self.closure):
            raise ValueError("the delay must end before the closure")
        for name, v in (("depth_shallow", self.depth_shallow), ("depth_deep", self.depth_deep)):
            if v is not None and v > 0:
                raise ValueError(f"{name} must be at or below 0")
        if self.preseason_days < 0:
            raise ValueError("preseason_days must not be negative")
        return self


def scenario_grid(bases: list[Scenario], variants: dict[str, list]) -> list[Scenario]:
    """Base rows times variants of their fields, numbered per base as a base-variant name."""
    out = []
    for number, base in enumerate(bases, start=1):
        combos = [{}]
        for name, values in variants.items():
            combos = [{**c, name: v} for c in combos for v in values]
        for c in combos:
            tag = "_".join(f"{k}_{v}" for k, v in c.items())
            out.append(replace(base, scenario="_".join(x for x in (base.scenario, tag) if x), scenario_number=number, **c).check())
    return out


#: A parameter table describes a sweep, so it has tens of rows; more is taken for a wrong table.
MOST_SCENARIOS = 5000
ABSENT = "NULL"


def _to_text(v) -> str:
    if v is None:
        return ABSENT
    if isinstance(v, tuple):
        return "-".join(f"{x:02d}" for x in v) if isinstance(v[0], int) else "|".join(v)
    return str(v)


def _from_text(field_type: str, text: str):
    if "tuple[int" in field_type:
        month, day = text.split("-")
        return int(month), int(day)
    if "tuple[str" in field_type:
        return tuple(x.strip() for x in text.split("|"))
    if field_type == "bool":
        if text.lower() not in ("true", "false"):
            raise ValueError(f"not true or false: {text}")
        return text.lower() == "true"
    if "float" in field_type:
        return float(text)
    return int(text) if field_type == "int" else text


def scenario_table(spark, scenarios: list[Scenario]) -> DataFrame:
    """Parameter table: one text column per parameter, absent values as the word NULL, dates as MM-DD, regions joined by |."""
    names = [f.name for f in fields(Scenario)]
    rows = [tuple(_to_text(getattr(s, n)) for n in names) for s in scenarios]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def scenarios_from_table(table: DataFrame) -> list[Scenario]:
    """Validated scenarios of a parameter table, in order of name; missing columns, nulls and NULL take the defaults.

    Only parameters come to the driver. Unknown columns, repeated names and meaningless combinations are errors.
    """
    kinds = {f.name: str(f.type) for f in fields(Scenario)}
    unknown = set(table.columns) - set(kinds)
    if unknown or "scenario" not in table.columns:
        raise ValueError(f"unknown parameters {sorted(unknown)}" if unknown else "a parameter table needs the column scenario")
    rows = table.limit(MOST_SCENARIOS + 1).collect()
    if len(rows) > MOST_SCENARIOS:
        raise ValueError(f"more than {MOST_SCENARIOS} scenarios")
    given = [{k: str(v).strip() for k, v in r.asDict().items() if v is not None and str(v).strip() != ABSENT} for r in rows]
    out = [Scenario(**{k: _from_text(kinds[k], v) for k, v in g.items()}).check() for g in given]
    if len({s.scenario for s in out}) < len(out):
        raise ValueError("scenario names repeat")
    return sorted(out, key=lambda s: s.scenario)


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v).lower()


class Sweep:
    """Parameter look-ups by the row's scenario index ``sidx``.

    Each parameter is a literal array with one entry per scenario, so rows carry a
    single integer and rules stay plain column expressions.
    """

    def __init__(self, scenarios: list[Scenario]):
        self.scenarios = [s.check() for s in scenarios]

    def of(self, value, kind: str) -> Column:
        """Column of ``value(scenario)`` for the row's scenario."""
        values = [_sql_literal(value(s)) for s in self.scenarios]
        if len(set(values)) == 1:
            return F.expr(f"cast({values[0]} as {kind})")
        return F.expr(f"element_at(cast(array({', '.join(values)}) as array<{kind}>), sidx + 1)")

    def param(self, name: str, kind: str = "double") -> Column:
        return self.of(lambda s: getattr(s, name), kind)

    def which(self, test) -> list[int]:
        return [i for i, s in enumerate(self.scenarios) if test(s)]

    def anchor(self, rule: str) -> Column:
        """The rule's month and day inside the row's crab year, null where the rule is off."""
        at = lambda f: lambda s: f(*getattr(s, rule)) if getattr(s, rule) else None
        offset = self.of(at(lambda m, d: 0 if m >= 11 else 1), "int")
        return F.make_date(F.col("start_year") + offset, self.of(at(lambda m, d: m), "int"), self.of(at(lambda m, d: d), "int"))

    def region_hit(self, rule: str) -> Column:
        out = F.lit(False)
        for r in REGIONS:
            hit = self.of(lambda s: bool({"All", r} & set(getattr(s, f"{rule}_regions"))), "boolean")
            out = F.when(F.col("region") == r, hit).otherwise(out)
        return out

    def in_depth(self) -> Column:
        deep, shallow = F.coalesce(self.param("depth_deep"), F.lit(-1e9)), F.coalesce(self.param("depth_shallow"), F.lit(0.0))
        return F.coalesce(F.col("depth").between(deep, shallow), F.lit(False))


def with_scenarios(effort: DataFrame, sweep: Sweep) -> DataFrame:
    """One copy of the effort per scenario."""
    ids = F.sequence(F.lit(0), F.lit(len(sweep.scenarios) - 1))
    return effort.withColumns({"sidx": F.explode(ids), "start_year": F.substring("crab_year", 1, 4).cast("int")})


def _scaled(df: DataFrame, flag: Column, factor: Column) -> DataFrame:
    return df.withColumns({m: F.when(flag, F.col(m) * factor).otherwise(F.col(m)) for m in METRICS})


def _sure(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def season_starts(effort: DataFrame, key: DataFrame | None = None, backstop: DataFrame | None = None) -> DataFrame:
    """First date and earliest lawful start per crab year and region.

    ``key`` (crab_year, region, first_date) replaces the observed first dates;
    ``backstop`` (crab_year, region, backstop) replaces November 10 and 26.
    """
    first = key if key is not None else effort.groupBy("crab_year", "region").agg(F.min("date").alias("first_date"))
    if backstop is not None:
        return first.join(backstop, ["crab_year", "region"], "left")
    day = F.when(F.col("region") == "CenCA", 10).otherwise(26)
    year = F.substring("crab_year", 1, 4).cast("int")
    return first.withColumn("backstop", F.make_date(year, F.lit(11), day))


def early_data(df: DataFrame, sweep: Sweep) -> DataFrame:
    """Effort before the season start: moved onto it, or removed.

    Needs first_date and backstop; the start is the later of the first date minus the preseason days
    and the backstop.
    """
    pile = sweep.of(lambda s: s.early_method == "pile", "boolean")
    started = df.withColumn(
        "season_start", later_of(F.date_sub("first_date", sweep.param("preseason_days", "int")), "backstop")
    )
    kept = started.where(pile | (F.col("date") >= F.col("season_start")))
    return kept.withColumn("date", F.when(pile, later_of("date", "season_start")).otherwise(F.col("date")))


def reduce_before(df: DataFrame, sweep: Sweep) -> DataFrame:
    hit = _sure(sweep.region_hit("before") & (F.col("date") < sweep.anchor("before")))
    return _scaled(df, hit, 1 - sweep.param("before_pct") / 100)


def delay_dates(df: DataFrame, sweep: Sweep) -> DataFrame:
    """Delayed opening: drop closed rows (remove, depth) or shift dates (lag, pile).

    Adds ``date_old``, ``days_shifted`` and ``open_date``.
    """
    is_ = lambda m: sweep.of(lambda s: s.delay_method == m, "boolean")
    opened = df.withColumn("open_date", F.when(sweep.region_hit("delay"), sweep.anchor("delay")))
    before = _sure(F.col("date") < F.col("open_date"))
    gone = before & (is_("remove") | (is_("depth") & ~sweep.in_depth()))
    late = F.greatest(F.datediff("open_date", "season_start"), F.lit(0))
    shift = F.when(is_("lag") | (is_("pile") & (F.col("date") <= F.col("open_date"))), late)
    return (
        opened.where(~gone)
        .withColumns({"date_old": F.col("date"), "days_shifted": F.coalesce(shift, F.lit(0))})
        .withColumn("date", F.date_add("date_old", F.col("days_shifted")))
    )


def redistribute(df: DataFrame, group=("sidx",)) -> DataFrame:
    """Spread displaced effort over base effort of the target region and month.

    Needs ``to_shift`` and ``is_base`` (booleans), ``target_region``, ``pct``, ``date`` and ``date_old``.
    Displaced totals per (target region, new month), times ``pct``, go to base rows of that region and
    old month in proportion to their pings. Displaced rows whose target has no base stay where they
    are, scaled and flagged ``nobase``. Rows are additive: a base row and its gain are two rows.
    """
    group = list(group)
    month = lambda c: F.trunc(c, "month")
    d = df.withColumns({"_ym_old": month("date_old"), "_ym": month("date")})
    base = (
        d.where("is_base")
        .groupBy(*group, "region", "_ym_old")
        .agg(F.sum("pings").alias("_base_pings"))
    )
    gain = (
        d.where("to_shift")
        .groupBy(*group, F.col("target_region").alias("region"), F.col("_ym").alias("_ym_old"))
        .agg(*[F.sum(F.col(m) * F.col("pct")).alias(f"_add_{m}") for m in METRICS])
    )
    slot = [*group, "region", "_ym_old"]
    # At most scenarios x regions x months rows each, whatever the effort table holds.
    receive = F.broadcast(base.join(gain, slot))
    based = F.broadcast(
        base.select(*group, F.col("region").alias("target_region"), F.col("_ym_old").alias("_ym"), F.lit(True).alias("_has_base"))
    )
    j = d.join(receive, slot, "left").join(based, [*group, "target_region", "_ym"], "left")
    share = F.col("pings") / F.col("_base_pings")

    def piece(nobase: bool, values: dict[str, Column]) -> Column:
        return F.struct(F.lit(nobase).alias("nobase"), *[values[m].cast("double").alias(m) for m in METRICS])

    pieces = F.array(
        F.when(~F.col("to_shift"), piece(False, {m: F.col(m) for m in METRICS})),
        F.when(F.col("is_base") & F.col("_base_pings").isNotNull(), piece(False, {m: F.col(f"_add_{m}") * share for m in METRICS})),
        F.when(F.col("to_shift") & F.col("_has_base").isNull(), piece(True, {m: F.col(m) * F.col("pct") for m in METRICS})),
    )
    keep = [c for c in df.columns if c not in {*METRICS, "nobase", "to_shift", "is_base", "target_region", "pct", "date_old"}]
    return j.withColumn("_piece", F.explode(F.array_compact(pieces))).select(*keep, "_piece.*")


def _redistributed(df: DataFrame, sweep: Sweep, test, flag) -> DataFrame:
    """Run ``flag`` and the redistribution on the scenarios that need it; the others pass by.

    Rows already without a base are final and pass by as well. The flagged rows are checkpointed because
    the redistribution reads them three times.
    """
    ids = sweep.which(test)
    mine = F.col("sidx").isin(ids) & ~F.col("nobase")
    return df.where(~mine).unionByName(redistribute(staged(flag(df.where(mine)))))


def delay_opening(df: DataFrame, sweep: Sweep) -> DataFrame:
    extra = ["date_old", "days_shifted", "open_date"]
    temporal = lambda s: bool(s.delay) and s.delay_fidelity == "temporal" and s.delay_method in ("lag", "pile")
    if not sweep.which(temporal):
        return delay_dates(df, sweep).drop(*extra)

    def flag(d: DataFrame) -> DataFrame:
        return delay_dates(d, sweep).withColumns(
            {
                "to_shift": F.col("days_shifted") > 0,
                "is_base": _sure(F.col("date_old") >= F.col("open_date")),
                "target_region": F.col("region"),
                "pct": F.lit(1.0),
            }
        ).drop("days_shifted", "open_date")

    ids = sweep.which(temporal)
    spatial = delay_dates(df.where(~F.col("sidx").isin(ids)), sweep).drop(*extra)
    return spatial.unionByName(redistribute(staged(flag(df.where(F.col("sidx").isin(ids))))))


def reduce_after(df: DataFrame, sweep: Sweep) -> DataFrame:
    """Percentage reduction after a date, optionally handing the cut effort to the other California region."""
    after = _sure(F.col("date") >= sweep.anchor("after"))
    hit = after & sweep.region_hit("after") & ~F.col("nobase")
    cut = sweep.param("after_pct") / 100
    plain = lambda d: _scaled(d, hit, 1 - cut)

    def flag(d: DataFrame) -> DataFrame:
        copies = F.when(hit, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        other = sweep.of(lambda s: "NorCA" if s.after_regions == ("CenCA",) else "CenCA", "string")
        factor = F.when(F.col("_moved"), cut).when(hit, 1 - cut).otherwise(F.lit(1.0))
        # Flags first: they look at the dates, not at the metrics that are scaled next.
        return (
            d.withColumn("_moved", F.explode(copies))
            .withColumns(
                {
                    "to_shift": F.col("_moved"),
                    "is_base": ~F.col("_moved") & after & ~hit,
                    "target_region": F.when(F.col("_moved"), other),
                    "pct": sweep.param("after_redist_pct") / 100,
                    "date_old": F.col("date"),
                    **{m: F.col(m) * factor for m in METRICS},
                }
            )
            .drop("_moved")
        )

    redist = lambda s: bool(s.after) and s.after_redist
    ids = sweep.which(redist)
    if not ids:
        return plain(df)
    mine = F.col("sidx").isin(ids) & ~F.col("nobase")
    return plain(df.where(~mine)).unionByName(redistribute(staged(flag(df.where(mine)))))


def close_early(df: DataFrame, sweep: Sweep) -> DataFrame:
    """Early closure: remove, depth, temporal or both, for all, listed regions or the protected areas."""
    is_ = lambda *m: sweep.of(lambda s: s.closure_method in m, "boolean")
    in_bia = sweep.of(lambda s: s.closure_regions == ("BIA",), "boolean")
    post = _sure(F.col("date") >= sweep.anchor("closure"))
    closed = post & ((in_bia & _sure(F.col("bia"))) | (~in_bia & sweep.region_hit("closure"))) & ~F.col("nobase")
    gone = closed & (is_("remove") | (is_("depth") & ~sweep.in_depth()))

    def flag(d: DataFrame) -> DataFrame:
        moves = closed & (is_("temporal") | (is_("depth+temporal") & ~sweep.in_depth()))
        other = F.when(F.col("region") == "CenCA", "NorCA").when(F.col("region") == "NorCA", "CenCA")
        target = F.when(is_("temporal") & ~in_bia, other).otherwise(F.col("region"))
        return d.withColumns(
            {
                "to_shift": moves,
                "is_base": ~moves & post,
                "target_region": F.when(moves, target),
                "pct": sweep.param("closure_pct") / 100,
                "date_old": F.col("date"),
            }
        )

    spreads = lambda s: bool(s.closure) and s.closure_method in ("temporal", "depth+temporal")
    if not sweep.which(spreads):
        return df.where(~gone)
    return _redistributed(df.where(~gone), sweep, spreads, flag)


def season_ends(effort: DataFrame) -> DataFrame:
    """Last observed date and lawful end (June 30 for CenCA, July 15 else) per crab year and region."""
    ends = effort.groupBy("crab_year", "region").agg(F.max("date").alias("season_end"))
    return ends.withColumn("region_end", region_end(F.substring("crab_year", 6, 4).cast("int")))


def region_end(year: Column) -> Column:
    cen = F.col("region") == "CenCA"
    return F.make_date(year, F.when(cen, 6).otherwise(7), F.when(cen, 30).otherwise(15))


def end_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "past_season_end": F.col("date") > F.col("season_end"),
            "past_region_end": F.col("date") > F.col("region_end"),
        }
    )


NEEDED = ["crab_year", "date", "cell_id", "region", "depth", "bia", *METRICS]


def prepare_effort(effort: DataFrame) -> DataFrame:
    """Cell-day effort cut to the needed columns, spread evenly and checkpointed for many readers.

    Spread by the unique cell and date: every scenario multiplies these rows, and a small staged
    table would otherwise sit in one partition.
    """
    return staged(require_columns(effort, NEEDED).select(*NEEDED).repartition("cell_id", "date"))


def run_scenarios(
    effort: DataFrame, scenarios: list[Scenario], season_key=None, backstop=None, compact: bool = False, prepared: bool = False
) -> DataFrame:
    """Shift, cut and spread the effort of every scenario in one plan.

    ``effort`` needs crab_year, date, cell_id, region, depth, bia and the metrics. The result is
    additive: a scenario, cell and date may have several rows, unless ``compact`` merges them at the price
    of a shuffle. Rows flagged ``nobase`` could not be placed and are left to the caller.
    """
    sweep = Sweep(scenarios)
    base = effort if prepared else prepare_effort(effort)
    # One row per crab year and region.
    starts = season_starts(base, season_key, backstop)
    ends = base.groupBy("crab_year", "region").agg(F.max("date").alias("season_end"))
    small = F.broadcast(starts.join(ends, ["crab_year", "region"]))
    d = early_data(with_scenarios(base.join(small, ["crab_year", "region"]), sweep), sweep)
    d = d.withColumns(
        {
            "nobase": F.lit(False),
            "season_end": F.when(
                sweep.of(lambda s: s.early_method == "pile", "boolean"), F.greatest("season_end", "season_start")
            ).otherwise(F.col("season_end")),
            **{m: F.col(m).cast("double") for m in METRICS},
        }
    ).drop("first_date", "backstop")
    if sweep.which(lambda s: s.before):
        d = reduce_before(d, sweep)
    if sweep.which(lambda s: s.delay):
        d = delay_opening(d, sweep)
    if sweep.which(lambda s: s.after):
        d = reduce_after(d, sweep)
    if sweep.which(lambda s: s.closure):
        d = close_early(d, sweep)
    if compact:
        keys = ["sidx", "start_year", "crab_year", "date", "cell_id", "region", "nobase", "season_end"]
        d = d.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in METRICS], F.first("depth").alias("depth"), F.first("bia").alias("bia"))
    named = d.withColumns(
        {
            "scenario": sweep.param("scenario", "string"),
            "scenario_number": sweep.param("scenario_number", "int"),
            "year_month": cal.year_month("date"),
            "region_end": region_end(F.col("start_year") + 1),
        }
    )
    return end_flags(named).drop("sidx", "start_year", "season_start")


def season_drop_report(scenario_effort: DataFrame) -> DataFrame:
    """Per scenario: rows kept and dropped for lying past the lawful end, and percent of pings dropped."""
    late = F.col("past_region_end")
    return scenario_effort.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(late).alias("n_late"),
        (100.0 * F.coalesce(F.sum(F.when(late, F.col("pings"))), F.lit(0.0)) / F.sum("pings")).alias("pct_pings_late"),
    )
