"""A pipeline as one lazy plan: every row gets a status, its error, warnings, changes and output.

Rows are (row_number, fields): the record number, counting the header as 1, and its cells. The order
of evaluation is part of the meaning: blank rows, exact duplicates, arity, cleaning of every expected
column, skip rules, then fields in target order. Warnings of cleaning count for every row that has the
right arity; warnings of a field's steps count up to the row's first error (with annotate: to the
field's). Nothing depends on how rows are spread over partitions.

A cell's chain is built from native expressions that bind each intermediate value once; only Unicode
normalization and ``expr`` with Python text leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import numbers, text, times, values
from tidemill.functions.outcome import Outcome, let
from tidemill.functions.pyexpr import python_expr
from tidemill.plans.spec import Field, Pipeline, Step

WARNS = "array<struct<column:string,code:string>>"
CHANGES = "array<struct<field:string,change:string,reason:string>>"


def _warn(column: str, code: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(column).alias("column"), F.lit(code).alias("code")))


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java: matched at the start, with Unicode classes."""
    return "^(?U)(?:" + pattern.replace("(?P<", "(?<").replace("\\Z", "\\z") + ")"


def first_seen(rows: DataFrame) -> DataFrame:
    """Adds first_row (least row number with equal cells) where rows repeat; null for others.

    Rows are grouped by two 64-bit hashes of their cells, so that only hashes and row numbers move, with
    partial sums; the few groups of several rows are then compared by their cells. A row that is repeated
    very often meets others of its kind only in sums.
    """
    whole = F.to_json("fields")
    keyed = rows.withColumns({"_h": F.xxhash64("fields"), "_g": F.xxhash64(whole, F.lit(1))})
    twice = keyed.where(~F.col("blank")).groupBy("_h", "_g").agg(F.count("*").alias("_n")).where("_n > 1").select("_h", "_g")
    again = keyed.where(~F.col("blank")).join(twice, ["_h", "_g"], "left_semi")
    same = again.groupBy("_h", "_g", "fields").agg(F.min("row_number").alias("first_row"), F.count("*").alias("_n")).where("_n > 1")
    # a pair of hashes stands for one row but in theory: the first of each kind is kept by its cells
    kinds = same.groupBy("_h", "_g").agg(F.collect_list(F.struct("fields", "first_row")).alias("_kinds"))
    found = keyed.join(kinds, ["_h", "_g"], "left")
    first = F.when(~F.col("blank"), F.get(F.filter("_kinds", lambda x: x["fields"] == F.col("fields")), F.lit(0))["first_row"])
    return found.withColumn("first_row", first).drop("_h", "_g", "_kinds")


def cleaned(c: Column, raw: Column, plan: Pipeline, column: str) -> Column:
    """struct<v, warns>: a normalized cell after text cleaning and null resolution."""
    p = plan.policies
    none = F.array().cast("array<string>")
    as_is = F.struct(raw.alias("v"), none.alias("warns"))
    x = F.struct(c.alias("v"), F.when(c != raw, F.array(F.lit("ENC-03"))).otherwise(none).alias("warns"))

    def stage(f: Callable[[Column], Column], code: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def run(x: Column) -> Column:
            return let(f(x["v"]), lambda y: F.struct(y.alias("v"), F.when(x["v"] != F.coalesce(y, F.lit("\0")), F.concat(x["warns"], F.array(code(y)))).otherwise(x["warns"]).alias("warns")))

        return run

    if p.strip_control_chars:
        x = let(x, stage(text.strip_control, lambda y: F.lit("ENC-04")))
    if p.normalize_unicode_whitespace:
        x = let(x, stage(text.map_spaces, lambda y: F.lit("ENC-05")))
    if p.trim_whitespace:
        x = let(x, stage(text.trim, lambda y: F.when(y == "", F.lit("NUL-02")).otherwise(F.lit("TYP-10"))))
    if plan.sentinels.get(column):
        x = let(x, stage(lambda v: F.when(~v.isin(*plan.sentinels[column]), v), lambda y: F.lit("NUL-03")))
    if p.empty_string_is_null:
        x = let(x, lambda x: F.struct(F.nullif(x["v"], F.lit("")).alias("v"), x["warns"].alias("warns")))
    # most cells are printable ASCII without outer spaces, which no rule but the sentinels changes
    plain = raw.rlike("^[!-~]([ -~]*[!-~])?\\z")
    if plan.sentinels.get(column):
        plain = plain & ~raw.isin(*plan.sentinels[column])
    return F.when(raw.isNull() | plain, as_is).otherwise(x)


def step_outcome(step: Step, c: Column) -> Outcome:
    """One transform on a cell."""
    a = step.args
    if step.op == "to_int":
        return numbers.to_int(c, **a)
    if step.op == "to_decimal":
        return numbers.to_decimal(c, **a)
    if step.op == "to_date":
        return times.to_date(c, [str(f) for f in a["formats"]])
    if step.op == "to_datetime":
        return times.to_datetime(c, [str(f) for f in a["formats"]], a.get("assume_tz"), a.get("to_utc", True))
    if step.op == "to_bool":
        return values.to_bool(c, {str(k): bool(v) for k, v in a["mapping"].items()})
    if step.op == "repair_mojibake":
        return text.repair_mojibake(c)
    if step.op == "check_range":
        return numbers.check_range(c, *(None if a.get(k) is None else str(a[k]) for k in ("low", "high")))
    return values.keep(c)  # format_datetime: datetimes are rendered already


def render_literal(value: object) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def chain(f: Field, cells: dict[str, Column]) -> Column:
    """struct<v, code, message, col, warns> of a field: its transforms from left to right, then length, then null."""
    steps = list(f.steps)
    name = f.source or f.target
    empty = F.array().cast("array<string>")

    def start(v: Column) -> Column:
        return F.struct(v.cast("string").alias("v"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message"), F.lit(name).alias("col"), empty.alias("warns"))

    def scripted(x: Column) -> Column:
        return F.struct(x["v"].alias("v"), x["code"].alias("code"), x["message"].alias("message"), F.coalesce(x["col"], F.lit(name)).alias("col"), F.coalesce(x["warns"], empty).alias("warns"))

    if not f.filled:
        x = start(F.lit(None))
    elif steps and steps[0].op == "constant":
        x = start(F.lit(render_literal(steps.pop(0).args["value"])))
    elif steps and steps[0].op == "concat":
        a = steps.pop(0).args
        name = f.target
        x = start(values.concat([cells[c] for c in a["sources"]], str(a.get("sep", ""))).value)
    elif steps and steps[0].op == "expr":
        sql = steps.pop(0).args.get("sql")
        x = start(F.expr(str(sql)).cast("string")) if sql is not None else let(F.col(f"_x_{f.target}"), scripted)
    else:
        x = start(cells[f.source])

    def then(make: Callable[[Column], Outcome], column: str) -> Callable[[Column], Column]:
        def run(x: Column) -> Column:
            o = make(x["v"])
            after = let(
                o.cell,
                lambda y: F.struct(
                    y["v"].alias("v"), y["code"].alias("code"), y["message"].alias("message"), F.when(y["code"] == "ERR-07", F.lit("<row>")).otherwise(F.lit(column)).alias("col"),
                    F.when(y["warn"], F.concat(x["warns"], F.array(F.lit(o.warn_code)))).otherwise(x["warns"]).alias("warns"),
                ),
            )
            return F.when(x["code"].isNotNull(), x).otherwise(after)

        return run

    for s in steps:
        if s.op == "to_decimal" and f.type == "decimal" and f.scale is not None and s.args.get("scale") is None:
            s = Step(s.op, {**s.args, "scale": f.scale})
        x = let(x, then(_bound(s), name))
    if f.max_length is not None:
        x = let(x, then(lambda c: values.check_length(c, int(f.max_length)), name))
    if not f.nullable:
        x = let(x, then(values.not_null, name))
    return x


def _bound(s: Step) -> Callable[[Column], Outcome]:
    return lambda c: step_outcome(s, c)


def classify(rows: DataFrame, plan: Pipeline, header: list[str] | None = None) -> DataFrame:
    """Columns row_number, fields, status, first_row, error, skip_code, warns, changes, out.

    status: blank, duplicate, skipped, quarantined or out. out: struct of rendered target columns.
    """
    header = list(header) if header is not None else list(plan.columns)
    index = {c: header.index(c) for c in plan.columns}
    p = plan.policies
    d = rows.select("row_number", "fields").withColumn("blank", F.forall("fields", lambda x: text.is_blank(F.coalesce(x, F.lit("")))))
    d = first_seen(d)
    again = F.col("first_row").isNotNull() & (F.col("row_number") > F.col("first_row"))
    d = d.withColumn("again", F.coalesce(again & ~F.col("blank"), F.lit(False)))
    drop = F.col("again") if p.duplicate_rows == "drop_exact" else F.lit(False)
    ragged = F.size("fields") != len(header)
    d = d.withColumn("early", F.when(F.col("blank"), "blank").when(drop, "duplicate").when(ragged, "quarantined"))
    live = F.col("early").isNull()

    raws = {c: F.when(live, F.coalesce(F.get("fields", F.lit(i)), F.lit(""))) for c, i in index.items()}
    d = d.withColumns({f"_r{i}": raws[c] for i, c in enumerate(plan.columns)})
    if p.unicode_normalization:
        d = d.withColumns({f"_n{i}": text.normalize(F.col(f"_r{i}"), p.unicode_normalization) for i in range(len(plan.columns))})
    got = "_n" if p.unicode_normalization else "_r"
    d = d.withColumn("_cells", F.struct(*[cleaned(F.col(f"{got}{i}"), F.col(f"_r{i}"), plan, c).alias(f"c{i}") for i, c in enumerate(plan.columns)]))

    scripts = [f for f in plan.fields if f.steps and f.steps[0].op == "expr" and "python" in f.steps[0].args]
    if scripts:
        row = F.struct(*[F.col(f"_cells.c{i}.v").alias(c) for i, c in enumerate(plan.columns)])
        skipped = _skip(plan, lambda c: F.col(f"_cells.c{plan.columns.index(c)}.v"))
        d = d.withColumns({f"_x_{f.target}": python_expr(str(f.steps[0].args["python"]))(F.when(live & skipped.isNull(), row)) for f in scripts})
    if any(f.steps and f.steps[0].op == "expr" and "sql" in f.steps[0].args for f in plan.fields):
        # SQL text names source columns
        d = d.withColumns({c: F.col(f"_cells.c{i}.v") for i, c in enumerate(plan.columns) if c not in d.columns})

    # cells, skip code and fields are each bound once: the row's expression stays linear in the spec
    def from_cells(cells: Column) -> Column:
        value = {c: cells[f"c{i}"]["v"] for i, c in enumerate(plan.columns)}
        skip = _skip(plan, value.__getitem__)
        for f in scripts:
            skip = F.coalesce(skip, F.col(f"_x_{f.target}")["skip"])

        def from_skip(skip: Column) -> Column:
            on = live & skip.isNull()
            fields = F.struct(*[F.when(on, chain(f, value)).alias(f"f{j}") for j, f in enumerate(plan.fields)])
            return let(fields, lambda fields: _judged(plan, len(header), cells, value, skip, on, fields))

        return let(F.when(live, skip), from_skip)

    # a condition on rand() keeps the planner from computing the row again in every filter above it
    d = d.withColumn("_row", F.when(F.rand(0) >= 0, let(F.col("_cells"), from_cells)))
    return d.select("row_number", "fields", "_row.status", F.when(F.col("again"), F.col("first_row")).alias("first_row"), "_row.error", "_row.skip_code", "_row.warns", "_row.changes", "_row.out")


def _skip(plan: Pipeline, value: Callable[[str], Column]) -> Column:
    """The code of the first skip rule that matches, null if none does."""
    skip = F.lit(None).cast("string")
    for s in reversed(plan.skips):
        skip = F.when(F.coalesce(value(s.column), F.lit("")).rlike(java_pattern(s.pattern)), F.lit(s.code)).otherwise(skip)
    return skip


def _judged(plan: Pipeline, width: int, cells: Column, value: dict[str, Column], skip: Column, on: Column, fields: Column) -> Column:
    """struct<status, error, skip_code, warns, changes, out> of a row, from its cleaned cells and its fields."""
    p = plan.policies
    early = F.col("early")
    annotate = p.error_disposition == "annotate"
    x = [fields[f"f{j}"] for j in range(len(plan.fields))]
    hard = [F.coalesce(c["code"].isin("NUL-04", "ERR-07") if annotate else c["code"].isNotNull(), F.lit(False)) for c in x]
    error = F.lit(None).cast("struct<code:string,column:string,value:string,message:string>")
    for j in reversed(range(len(plan.fields))):
        f = plan.fields[j]
        bad = value[f.source] if f.source else F.lit(None).cast("string")
        error = F.when(hard[j], F.struct(x[j]["code"].alias("code"), x[j]["col"].alias("column"), F.substring(bad, 1, 500).alias("value"), x[j]["message"].alias("message"))).otherwise(error)
    ragged = F.struct(F.lit("STR-02").alias("code"), F.lit("<row>").alias("column"), F.lit(None).cast("string").alias("value"), F.concat(F.size("fields").cast("string"), F.lit(f" fields instead of {width}")).alias("message"))
    error = F.when(early == "quarantined", ragged).when(on, error)

    def with_error(error: Column) -> Column:
        status = F.coalesce(early, F.when(skip.isNotNull(), "skipped").when(error.isNotNull(), "quarantined").otherwise("out"))
        return let(status, lambda status: with_status(error, status))

    def with_status(error: Column, status: Column) -> Column:
        done = status == "out"
        rendered = {f.target: x[j]["v"] for j, f in enumerate(plan.fields)}
        notes = []
        if p.formula_injection == "neutralize":
            notes = [_warn(t, "ENC-08", done & F.coalesce(text.formula_leading(c, "=@\t\r"), F.lit(False))) for t, c in rendered.items()]
            rendered = {t: text.neutralize_formula(c).value for t, c in rendered.items()}
        parts = [
            F.array_compact(F.array(_warn("<row>", "STR-06", F.col("blank")), _warn("<row>", "STR-05", F.col("again")))),
            F.when(skip.isNotNull(), F.array(F.struct(F.lit("<row>").alias("column"), skip.alias("code")))),
        ]
        parts += [F.when(early.isNull(), _tagged(cells[f"c{i}"]["warns"], c)) for i, c in enumerate(plan.columns)]
        reached = on
        for j, f in enumerate(plan.fields):
            parts.append(F.when(reached, _tagged(x[j]["warns"], f.source or f.target)))
            reached = reached & ~hard[j]
        if notes:
            parts.append(F.array_compact(F.array(*notes)))
        warns = F.concat(*[F.coalesce(part, F.array().cast(WARNS)) for part in parts])
        changes = F.array().cast(CHANGES)
        if annotate:
            changed = [F.when(done & x[j]["code"].isNotNull(), F.struct(F.lit(f.target).alias("field"), F.lit("NULLED").alias("change"), x[j]["code"].alias("reason"))) for j, f in enumerate(plan.fields)]
            changes = F.array_compact(F.array(*changed))
        out = F.when(done, F.struct(*[c.alias(t) for t, c in rendered.items()]))
        return F.struct(status.alias("status"), error.alias("error"), skip.alias("skip_code"), warns.alias("warns"), changes.alias("changes"), out.alias("out"))

    return let(error, with_error)


def _tagged(codes: Column, column: str) -> Column:
    return F.transform(codes, lambda c: F.struct(F.lit(column).alias("column"), c.alias("code")))


SQL_TYPES = {"string": "string", "integer": "decimal(38,0)", "date": "date", "datetime": "timestamp", "boolean": "boolean"}


def typed(classified: DataFrame, plan: Pipeline) -> DataFrame:
    """The rows that reached output, with the target types."""
    columns = []
    for f in plan.fields:
        kind = f"decimal(38,{f.scale if f.scale is not None else 18})" if f.type == "decimal" else SQL_TYPES[f.type]
        c = F.col(f"out.{f.target}")
        columns.append((c if kind == "string" else c.try_cast(kind)).alias(f.target))
    return classified.where("status = 'out'").select("row_number", *columns)
