"""Check suites compiled by table: one scan a table serves all rules of all suites on it; a suite that fails becomes a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from granary.sources.tables import written

RESULTS = "suite string, category string, check string, description string, result string, actual_value double"


@dataclass(frozen=True)
class Rule:
    """A check on one table: `value` is an aggregate, and `low` to `high` is where it may lie (by default it must be 0; with low None it is only told)."""

    check: str
    table: str
    description: str
    value: Callable[[], Column]
    low: float | None = 0.0
    high: float | None = 0.0
    category: str = "quality"


@dataclass(frozen=True)
class Keys:
    """A check on the different values of key columns: `kind` is repeated, null or orphan (of parent.parent_key)."""

    check: str
    table: str
    keys: tuple[str, ...]
    kind: str
    parent: str = ""
    parent_keys: tuple[str, ...] = ()

    @property
    def description(self) -> str:
        names = ", ".join(self.keys)
        return {"repeated": f"repeated {names}", "null": f"null {names}", "orphan": f"{names} without a row of {self.parent}"}[self.kind]


def bad(check: str, table: str, description: str, condition: Callable[[], Column]) -> Rule:
    """No row may meet the condition."""
    return Rule(check, table, description, lambda: F.count(F.when(condition(), 1)))


def share(check: str, table: str, description: str, condition: Callable[[], Column], low: float, high: float) -> Rule:
    """The share of rows that meet the condition lies between two bounds; a table without rows has none, and fails."""
    return Rule(check, table, description, lambda: F.round(F.count(F.when(condition(), 1)) / F.nullif(F.count("*"), F.lit(0)), 6), low, high)


def info(check: str, table: str, description: str, value: Callable[[], Column]) -> Rule:
    return Rule(check, table, description, value, None, None)


def _spec(keys: tuple[str, ...]) -> Column:
    """Key columns as one text; null if any is."""
    return F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0, F.to_json(F.struct(*[F.col(k).cast("string").alias(str(i)) for i, k in enumerate(keys)])))


def _scan(df: DataFrame, rules: list[Rule], keys: set[tuple[str, ...]]) -> tuple[list[float | None], DataFrame | None]:
    """All rules' values and the counts of all key values, from one pass over a table.

    Rules are measured while the key values are counted; these are combined before they are shuffled.
    """
    seen, order = Observation(), sorted(keys)
    measures = [r.value().cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    rows = df.observe(seen, *measures) if rules else df
    specs = F.array(*[F.struct(F.lit("\x1f".join(k)).alias("keys"), _spec(k).alias("value")) for k in order]) if order else F.array(F.struct(F.lit("").alias("keys"), F.lit("").alias("value")))
    counted = written(rows.select(F.explode(specs).alias("s")).select("s.*").groupBy("keys", "value").agg(F.count("*").alias("n")))
    try:
        found = seen.get if rules else {}
    except Py4JJavaError:  # of a table that is known to be empty Spark plans no scan and measures nothing
        found = df.agg(*measures).first().asDict()
    return [found[f"r{i}"] for i in range(len(rules))], counted if order else None


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).strip().splitlines()[0][:200]}"


def run_suites(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], suites: dict[str, list[Rule | Keys]], summary: bool = True) -> DataFrame:
    """suite, category, check, description, result, actual_value of all suites, failures first, then passes, then what is only told.

    Each table is scanned once, whatever the number of suites. A suite whose table cannot be made, or whose
    rule cannot be computed, gives one row of category error in the place of its checks, and the others go on:
    where a table's common scan fails, the suites on it are tried one by one. The last row tells how many
    checks were made and failed. What comes to the driver is one number a rule.
    """
    errors: dict[str, str] = {}
    frames: dict[str, DataFrame] = {}
    for name, checks in suites.items():
        try:
            for c in checks:
                for t in filter(None, (c.table, getattr(c, "parent", ""))):
                    frames[t] = frames[t] if t in frames else tables[t]()
                if isinstance(c, Rule):
                    frames[c.table].agg(c.value())
                else:
                    frames[c.table].select(*c.keys)
                    if c.parent:
                        frames[c.parent].select(*c.parent_keys)
        except Exception as e:
            errors[name] = _reason(e)
    values: dict[tuple[str, int], float | None] = {}
    counted: dict[str, DataFrame] = {}

    def needs(names: list[str], table: str) -> tuple[list[tuple[str, int]], set[tuple[str, ...]]]:
        rules = [(s, i) for s in names for i, c in enumerate(suites[s]) if isinstance(c, Rule) and c.table == table]
        keys = {c.keys for s in names for c in suites[s] if isinstance(c, Keys) and c.table == table}
        return rules, keys | {c.parent_keys for s in names for c in suites[s] if isinstance(c, Keys) and c.parent == table}

    for table, df in frames.items():
        live = [s for s in suites if s not in errors]
        rules, keys = needs(live, table)
        if not rules and not keys:
            continue
        try:
            found, counted[table] = _scan(df, [suites[s][i] for s, i in rules], keys)
            values |= dict(zip(rules, found))
        except Exception:
            parts = []
            for s in live:
                own, own_keys = needs([s], table)
                try:
                    found, part = _scan(df, [suites[x][i] for x, i in own], own_keys)
                    values |= dict(zip(own, found))
                    parts += [part] if part is not None else []
                except Exception as e:
                    errors[s] = _reason(e)
            if parts:
                counted[table] = parts[0]
                for p in parts[1:]:
                    counted[table] = counted[table].unionByName(p)
                counted[table] = counted[table].distinct()
    for s, checks in suites.items():
        for i, c in enumerate(checks):
            if isinstance(c, Keys) and s not in errors:
                try:
                    values[s, i] = _of_keys(c, counted)
                except Exception as e:
                    errors[s] = _reason(e)
    rows = []
    for s, checks in suites.items():
        if s in errors:
            rows.append((s, "error", "EXECUTION ERROR", errors[s], "FAIL", None))
            continue
        for i, c in enumerate(checks):
            v = values[s, i]
            low, high = (c.low, c.high) if isinstance(c, Rule) else (0, 0)
            result = "INFO" if low is None else "PASS" if v is not None and low <= v <= high else "FAIL"
            rows.append((s, c.category if isinstance(c, Rule) else "keys", c.check, c.description, result, v))
    rows.sort(key=lambda r: ("FAIL PASS INFO".split().index(r[4]), *r[:3]))
    if summary:
        bad_rows = sum(r[4] == "FAIL" for r in rows)
        rows.append(("summary", "summary", "verdict", f"{len(rows)} checks", "FAIL" if bad_rows else "PASS", float(bad_rows)))
    return spark.createDataFrame(rows, RESULTS)


def _of_keys(c: Keys, counted: dict[str, DataFrame]) -> float:
    own = counted[c.table].where(F.col("keys") == "\x1f".join(c.keys))
    if c.kind == "null":
        return float(own.where("value is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    own = own.where("value is not null")
    if c.kind == "repeated":
        return float(own.where("n > 1").count())
    parents = counted[c.parent].where(F.col("keys") == "\x1f".join(c.parent_keys)).select("value")
    return float(own.join(parents, "value", "left_anti").count())
