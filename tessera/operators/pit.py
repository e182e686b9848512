"""Point-in-time records: snapshots, revisions and projections on announcement dates.

A record is instrument, field, ann_date, period (YYYYQQ), value. A NaN value is a revision that takes the
value back, unlike no record; so values travel in structs and become missing only at the end."""

from __future__ import annotations

import ast
import copy
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import expression as E

KEY = ("instrument", "field", "period", "ann_date")


def ordinal(period: Column) -> Column:
    """Quarters counted through: 202301 and 202302 are neighbours, and so are 202304 and 202401."""
    return (F.floor(period / 100) * 4 + period % 100 - 1).cast("int")


def valid(records: DataFrame) -> DataFrame:
    """The records; one of an impossible period, without a date or with an infinite value raises when read."""
    ok = F.col("period").between(190001, 999904) & (F.col("period") % 100).between(1, 4) & F.col("ann_date").isNotNull() & ~F.coalesce(F.abs("value") == E.INF, F.lit(False))
    return records.withColumn("period", F.when(ok, F.col("period")).otherwise(F.raise_error(F.lit("not a record")).cast("int")))


def keep_last(records: DataFrame, order: str = "seq") -> DataFrame:
    """One record of each key: the last by order."""
    one = records.groupBy(*KEY).agg(F.max_by(F.struct("value"), order)["value"].alias("value"))
    return one.select("instrument", "field", "ann_date", "period", "value")


def write(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old and new records together; of equal keys the new one stays, of equal new ones that of the greater seq."""
    rows = valid(new).select(*KEY, "value", F.lit(1).alias("batch"), "seq")
    if old is not None:
        rows = rows.unionByName(old.select(*KEY, "value", F.lit(0).alias("batch"), F.lit(0).cast("long").alias("seq")))
    return keep_last(rows.withColumn("at", F.struct("batch", "seq")), "at")


def resolve(names: Sequence[str], asked: str) -> str:
    """A field by its name, or by the last part of a dotted one if only one fits."""
    if asked in names:
        return asked
    fit = [n for n in names if n.endswith(f".{asked}")]
    if len(fit) != 1:
        raise KeyError(f"no such field, or several: {asked}")
    return fit[0]


def snapshot(records: DataFrame, fields: Sequence[str], asof, periods: Sequence[int] | None = None) -> DataFrame:
    """instrument, period and a column for each field: the last version announced up to a date."""
    rows = records.where(F.col("field").isin(list(fields)) & (F.col("ann_date") <= F.lit(asof).cast("date")))
    last = rows.groupBy("instrument", "period", "field").agg(F.max_by(F.struct("value"), "ann_date")["value"].alias("value"))
    wide = last.groupBy("instrument", "period").pivot("field", list(fields)).agg(F.first("value"))
    if periods is not None:
        asked = F.explode(F.array(*(F.lit(p) for p in periods))).alias("period")
        wide = rows.select("instrument").distinct().select("instrument", asked).join(wide, ["instrument", "period"], "left")
    return wide


def history(records: DataFrame, instruments: Sequence[str], field: str, asof) -> DataFrame:
    """All revisions of a field up to a date."""
    return records.where(F.col("instrument").isin(list(instruments)) & (F.col("field") == field) & (F.col("ann_date") <= F.lit(asof).cast("date")))


def _events(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Announcement dates of any of the fields, with the first and last quarter seen so far."""
    rows = records.where(F.col("field").isin(list(fields))).withColumn("ord", ordinal(F.col("period")))
    days = rows.groupBy("instrument", "ann_date").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    w = Window.partitionBy("instrument").orderBy("ann_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("instrument", F.col("ann_date").alias("event"), F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))


def _versions(events: DataFrame, records: DataFrame, field: str) -> DataFrame:
    """For events with a quarter ord: the field's last version of that quarter as of the event."""
    rows = records.where(F.col("field") == field).select("instrument", ordinal(F.col("period")).alias("ord"), "ann_date", "value")
    hit = events.join(rows, ["instrument", "ord"]).where("ann_date <= event")
    return hit.groupBy("instrument", "event", "ord").agg(F.max_by(F.struct("value"), "ann_date")["value"].alias("value"))


def on_calendar(series: dict[str, DataFrame], grid: DataFrame) -> DataFrame:
    """The grid with a column for each series of events (instrument, event, value): the last event's value on or before each calendar row.

    An event without a value takes the value before it back; one on a day without trade counts on the next. All series are
    laid into the grid at once, so that it moves once however many they are."""
    rest = [c for c in grid.columns if c not in ("instrument", "datetime")]
    both = grid.select("instrument", "datetime", F.lit(1).alias("__kind"), F.struct(F.lit(True).alias("__there"), *rest).alias("__row"))
    for name, events in series.items():
        told = events.select("instrument", F.col("event").alias("datetime"), F.lit(0).alias("__kind"), F.struct(F.col("value").cast("double").alias("value")).alias(name))
        both = both.unionByName(told, allowMissingColumns=True)
    w = Window.partitionBy("instrument").orderBy("datetime", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("instrument", "datetime", "__kind", "__row", *(F.last(n, ignorenulls=True).over(w).alias(n) for n in series)).where("__kind = 1")
    return both.select("instrument", "datetime", *(F.col(f"__row.`{c}`") for c in rest), *(E.finite(E.no_nan(F.col(n)["value"])).alias(n) for n in series))


@dataclass(frozen=True)
class Cells:
    """The dense grid of instruments (instrument, each once) and calendar (datetime and pos), not laid out yet."""

    instruments: DataFrame
    calendar: DataFrame

    def laid(self) -> DataFrame:
        return self.instruments.crossJoin(F.broadcast(self.calendar))


def in_runs(series: dict[str, DataFrame], cells: Cells, values: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that values would make of on_calendar(series, cells.laid()), if it takes each row by itself.

    values: of a frame with instrument, __lo, __next and a column for each series; it keeps these three. It sees one row for
    each run of calendar rows between events. Only events move and are sorted; a run becomes rows as the last step, in its own task."""
    cal = cells.calendar.select("datetime")
    order = Window.orderBy("datetime")
    axis = cal.select("datetime", F.row_number().over(order).alias("__lo"), F.lag("datetime").over(order).alias("__b"))
    # every day from the row before to this one, which an event on it reaches first; events after the last row reach none
    axis = axis.select("__lo", F.explode(F.sequence(F.coalesce(F.date_add("__b", 1), "datetime"), "datetime")).alias("event"))
    first = F.broadcast(cal.agg(F.min("datetime").alias("__first")))
    both = cells.instruments.select("instrument", F.lit(None).cast("date").alias("event"), F.lit(1).alias("__lo"))
    for name, events in series.items():
        told = events.select("instrument", "event", F.struct(F.col("value").cast("double").alias("value")).alias(name))
        told = told.join(F.broadcast(axis), "event", "left").crossJoin(first).withColumn("__lo", F.when(F.col("event") < F.col("__first"), 1).otherwise(F.col("__lo")))
        both = both.unionByName(told.where("__lo is not null").drop("__first"), allowMissingColumns=True)
    w = Window.partitionBy("instrument").orderBy("event")
    now = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = both.select("instrument", "__lo", F.lead("__lo").over(w).alias("__next"), *(F.last(n, ignorenulls=True).over(now).alias(n) for n in series))
    runs = runs.where("__next is null or __next > __lo").select("instrument", "__lo", "__next", *(E.finite(E.no_nan(F.col(n)["value"])).alias(n) for n in series))
    done = values(runs)
    days = cal.agg(F.array_sort(F.collect_list("datetime")).alias("__days"))
    run = F.slice("__days", F.col("__lo"), F.coalesce("__next", F.size("__days") + 1) - F.col("__lo"))
    rest = [c for c in done.columns if c not in ("instrument", "__lo", "__next")]
    return done.crossJoin(F.broadcast(days)).select("instrument", F.explode(run).alias("datetime"), *rest)


def _by_row(tree: ast.AST) -> bool:
    """Whether an expression, outside of P and PRef, takes each row by itself and reads no daily field."""
    if isinstance(tree, ast.Call):
        name = tree.func.id
        if name in ("P", "PRef", "pitfield"):
            return True
        if name in ("field", "Ref", "Delta") or E.OPERATORS[name].window is not None:
            return False
    return all(_by_row(c) for c in ast.iter_child_nodes(tree) if isinstance(c, ast.expr))


def projection(records: DataFrame, node: ast.Call) -> DataFrame:
    """instrument, event, value of P(...) or PRef(..., k) at each announcement date.

    Of a plain field: the value of the greatest quarter ever announced, plus k. Of an expression: it runs
    on the quarters from the first to the last one seen, as known on that date, and its value there is taken."""
    inner = node.args[0] if node.func.id in ("P", "PRef") else node
    k = E._integer(node.args[1]) if node.func.id == "PRef" else 0
    names = sorted({n.args[0].value for n in E.calls(inner, "pitfield")})
    events = _events(records, names)
    if isinstance(inner, ast.Call) and inner.func.id == "pitfield":
        asked = events.select("instrument", "event", (F.col("hi") + k).alias("ord"))
        return asked.join(_versions(asked, records, names[0]), ["instrument", "event", "ord"], "left").select("instrument", "event", "value")
    grid = events.select("instrument", "event", "hi", F.explode(F.sequence("lo", "hi")).alias("ord"))
    special = {}
    for i, n in enumerate(names):
        v = _versions(grid.select("instrument", "event", "ord"), records, n).select("instrument", "event", "ord", E.no_nan(F.col("value")).alias(f"__p{i}"))
        grid = grid.join(v, ["instrument", "event", "ord"], "left")
        special.update({ast.dump(c): f"__p{i}" for c in E.calls(inner, "pitfield") if c.args[0].value == n})
    c = E.Context(grid.withColumn("pos", F.col("ord").cast("double")), ("instrument", "event"), "pos", special)
    value = c.lower(inner).num
    at = c.df.withColumn("value", value).where(F.col("ord") == F.col("hi") + k).select("instrument", "event", "value")
    return events.select("instrument", "event").join(at, ["instrument", "event"], "left")


class _Resolved(ast.NodeTransformer):
    """Names of $$ fields as the registry has them."""

    def __init__(self, names: Sequence[str]):
        self.names = names

    def visit_Call(self, node: ast.Call) -> ast.AST:
        self.generic_visit(node)
        if isinstance(node.func, ast.Name) and node.func.id == "pitfield":
            node.args[0].value = resolve(self.names, node.args[0].value)
        return node


def project(records: DataFrame, grid: DataFrame | Cells, expressions: dict[str, str], names: Sequence[str] | None = None) -> DataFrame:
    """Expressions that hold P, PRef or bare $$ fields over a dense grid (instrument, datetime, pos, fields).

    Cells are not laid out before they have to be: expressions that take each row by itself run on the runs between events.
    names: those of the registry, by which the last part of a dotted name finds its field."""
    special: dict[str, str] = {}
    series: dict[str, DataFrame] = {}
    for text in expressions.values():
        tree = E.parse(text)
        E.check_pit(tree)
        inside = {id(x) for c in E.calls(tree, "P", "PRef") for x in ast.walk(c.args[0])}
        for node in (n for n in E.calls(tree, "P", "PRef", "pitfield") if id(n) not in inside):
            if (key := ast.dump(node)) not in special:
                special[key] = f"__s{len(special)}"
                asked = node if names is None else _Resolved(names).visit(copy.deepcopy(node))
                series[special[key]] = projection(records, asked)
    if isinstance(grid, Cells):
        if series and all(_by_row(E.parse(t)) for t in expressions.values()):
            return in_runs(series, grid, lambda d: E.evaluate(d, expressions, ("instrument", "__lo", "__next"), special))
        grid = grid.laid()
    return E.evaluate(on_calendar(series, grid) if series else grid, expressions, special=special)


def register_fields(old: DataFrame | None, new: DataFrame, replace: bool = False) -> DataFrame:
    """The registry field_id, name, unit, basis with new names added; ids are stable, other metadata of a
    known name raises. replace: names that are not in new go."""
    meta = ("unit", "basis")
    if old is None:
        return new.select(F.row_number().over(Window.orderBy("name")).alias("field_id"), "name", *meta)
    both = old.join(new.select("name", *(F.col(m).alias(f"new_{m}") for m in meta), F.lit(True).alias("given")), "name", "full_outer")
    differs = F.col("given") & F.col("field_id").isNotNull() & ~(F.col("unit").eqNullSafe(F.col("new_unit")) & F.col("basis").eqNullSafe(F.col("new_basis")))
    both = both.withColumn("name", F.when(F.coalesce(differs, F.lit(False)), F.raise_error(F.lit("metadata of a field don't change"))).otherwise(F.col("name")))
    top = old.agg(F.coalesce(F.max("field_id"), F.lit(0)).alias("top"))
    fresh = Window.partitionBy(F.col("field_id").isNull()).orderBy("name")
    out = both.crossJoin(F.broadcast(top)).select(
        F.when(F.col("field_id").isNull(), F.col("top") + F.row_number().over(fresh)).otherwise(F.col("field_id")).alias("field_id"), "name", *(F.coalesce(m, f"new_{m}").alias(m) for m in meta), "given"
    )
    return (out.where("given") if replace else out).drop("given")
