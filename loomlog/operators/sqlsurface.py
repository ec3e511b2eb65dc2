"""One guarded SELECT over the log table, checked and adapted on its parsed plan."""

from __future__ import annotations

import re
import uuid

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.args import page_limit
from loomlog.schema import LOGS
from loomlog.session import prepare

#: Names a statement may read: the rows, and (rowid, body) under the text table's name.
READABLE = ("logs", "logs_fts")

#: Kinds of plan nodes a statement may be made of.
PLAN_NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Union Intersect Except Distinct "
    "SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedHaving UnresolvedWith "
    "WithWindowDefinition OneRowRelation".split()
)

#: Functions a statement may call; operators and casts are not functions.
FUNCTIONS = frozenset(
    "count count_if sum avg mean min max min_by max_by first last any_value stddev stddev_pop stddev_samp "
    "variance var_pop var_samp median percentile percentile_approx approx_percentile approx_count_distinct "
    "collect_list collect_set array_agg listagg string_agg bool_and bool_or every some corr "
    "row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value "
    "abs sign round bround floor ceil ceiling sqrt power pow exp ln log log2 log10 mod pmod greatest least "
    "lower upper lcase ucase length char_length octet_length substr substring left right trim ltrim rtrim "
    "replace translate reverse repeat lpad rpad instr position locate concat concat_ws split split_part "
    "contains startswith endswith regexp regexp_like regexp_extract regexp_replace regexp_count format_string "
    "printf initcap ascii hex unhex md5 sha1 sha2 crc32 size cardinality array_contains element_at "
    "coalesce ifnull nvl nvl2 nullif if iff isnull isnotnull between typeof "
    "date to_date to_timestamp date_trunc trunc date_add date_sub date_format datediff year month day "
    "dayofmonth dayofweek dayofyear hour minute second quarter weekofyear unix_timestamp unix_seconds "
    "unix_millis timestamp_seconds timestamp_millis from_unixtime current_timestamp current_date now "
    "get_json_object json_array_length json_extract json_number strftime datetime group_concat total".split()
)

_SELECT = re.compile(r"\s*select\b", re.IGNORECASE)
_COMPARISONS = frozenset("EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual In".split())
#: Functions that hand on one of their arguments as it is.
_PASSING = frozenset("coalesce ifnull nvl nullif min max min_by max_by first last any_value first_value last_value".split())
_ARITHMETIC = frozenset("Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive Abs".split())
#: Text of a JSON value, numbers and booleans first: what the reference dialect orders by.
_RANKED = T.StructType().add("kind", "integer").add("number", "double").add("text", "string")

#: The number of a ranked value: a text counts as the number it begins with, else as 0.
_LEAD = r"regexp_extract(value_['text'], '^\\s*[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?', 0)"
_NUMBER = (
    "CASE WHEN value_ IS NULL THEN NULL WHEN value_['kind'] = 0 THEN value_['number'] "
    f"ELSE coalesce(try_cast({_LEAD} AS DOUBLE), 0D) END"
)

#: strftime's letters as patterns of date_format; %s and %w are no patterns.
_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "ss.SSS", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm"}


class SqlRefused(ValueError):
    """The statement is not one the guard lets through."""


def _items(seq: JavaObject) -> list[JavaObject]:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


class _Guard:
    """Checks every node of a parsed plan, then rebuilds the parts that need typed JSON values."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.parser = spark._jsparkSession.sessionState().sqlParser()

    # -- checks

    def check(self, plan: JavaObject, names: frozenset[str], parent: JavaObject | None = None) -> None:
        kind = _kind(plan)
        if kind not in PLAN_NODES:
            raise SqlRefused(f"the statement has a part that is not allowed: {kind}")
        if kind == "UnresolvedRelation":
            parts = [str(part) for part in _items(plan.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in names:
                raise SqlRefused(f"only {READABLE[0]} can be read, not {'.'.join(parts)}")
        if kind == "UnresolvedWith":
            for relation in _items(plan.cteRelations()):
                self.check(relation._2(), names)
                names = names | {str(relation._1()).lower()}
        if kind == "Join":
            self.check_join(plan, parent)
        for expression in _items(plan.expressions()):
            self.check_expression(expression, names)
        for child in _items(plan.children()):
            self.check(child, names, plan)

    def check_join(self, join: JavaObject, parent: JavaObject | None) -> None:
        """A join needs an equality of columns, in its condition, by USING, or in the WHERE above."""
        kind = join.joinType().toString()
        if "Using" in kind or "Natural" in kind:
            return
        found = [join.condition().get()] if join.condition().isDefined() else []
        if parent is not None and _kind(parent) == "Filter" and "Inner" in kind:
            found.append(parent.condition())
        if not any(self.has_equality(condition) for condition in found):
            raise SqlRefused("a join needs an equality of columns")

    def has_equality(self, condition: JavaObject) -> bool:
        parts = _items(condition.children())
        if _kind(condition) == "And":
            return any(self.has_equality(part) for part in parts)
        return _kind(condition) == "EqualTo" and all(self.has_column(part) for part in parts)

    def has_column(self, expression: JavaObject) -> bool:
        return _kind(expression) == "UnresolvedAttribute" or any(self.has_column(c) for c in _items(expression.children()))

    def check_expression(self, expression: JavaObject, names: frozenset[str]) -> None:
        kind = _kind(expression)
        if kind == "UnresolvedFunction":
            parts = [str(part) for part in _items(expression.nameParts())]
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise SqlRefused(f"the function {'.'.join(parts)} is not allowed")
        elif "Identifier" in kind or "Subquery" in kind and kind not in ("ScalarSubquery", "InSubquery"):
            raise SqlRefused(f"the statement has a part that is not allowed: {kind}")
        elif kind in ("ScalarSubquery", "Exists", "ListQuery"):
            self.check(expression.plan(), names)
        for child in _items(expression.children()):
            self.check_expression(child, names)

    def check_analysed(self, plan: JavaObject, known: tuple[JavaObject, ...] = ()) -> None:
        """Every join must have an equality between its two sides, in its condition or in a filter above
        it; what counts is which side a column comes from, not how it is written.
        """
        kind = _kind(plan)
        below: tuple[JavaObject, ...] = ()
        if kind == "Filter":
            below = (*known, *self.conjuncts(plan.condition()))
        elif kind == "Join":
            own = tuple(self.conjuncts(plan.condition().get())) if plan.condition().isDefined() else ()
            inner = plan.joinType().toString() in ("Inner", "Cross")
            if not any(self.joins(part, plan) for part in (*own, *(known if inner else ()))):
                raise SqlRefused("a join needs an equality between its two sides")
            below = (*own, *known) if inner else ()
        elif kind == "SubqueryAlias":
            below = known
        for expression in _items(plan.expressions()):
            self.check_inside(expression)
        for child in _items(plan.children()):
            self.check_analysed(child, below)

    def check_inside(self, expression: JavaObject) -> None:
        if _kind(expression) in ("ScalarSubquery", "Exists", "ListQuery"):
            self.check_analysed(expression.plan())
        for child in _items(expression.children()):
            self.check_inside(child)

    def conjuncts(self, condition: JavaObject) -> list[JavaObject]:
        if _kind(condition) != "And":
            return [condition]
        return [part for side in _items(condition.children()) for part in self.conjuncts(side)]

    def joins(self, condition: JavaObject, join: JavaObject) -> bool:
        """Whether a condition is an equality of something of the left with something of the right."""
        if _kind(condition) not in ("EqualTo", "EqualNullSafe"):
            return False
        sides = [side.references() for side in _items(condition.children())]
        left, right = join.left().outputSet(), join.right().outputSet()

        def of(references: JavaObject, output: JavaObject) -> bool:
            return not references.isEmpty() and references.subsetOf(output)

        a, b = sides
        return of(a, left) and of(b, right) or of(a, right) and of(b, left)

    # -- typed JSON values

    def parsed(self, text: str, **holes: JavaObject) -> JavaObject:
        """An expression of SQL text in which the named columns are replaced."""
        return self.fill(self.parser.parseExpression(text), holes)

    def fill(self, expression: JavaObject, holes: dict[str, JavaObject]) -> JavaObject:
        if _kind(expression) == "UnresolvedAttribute" and expression.name() in holes:
            return holes[expression.name()]
        return self.with_children(expression, [self.fill(c, holes) for c in _items(expression.children())])

    def seq(self, items: list[JavaObject]) -> JavaObject:
        held = self.jvm.java.util.ArrayList()
        for item in items:
            held.add(item)
        return self.jvm.PythonUtils.toSeq(held)

    def with_children(self, node: JavaObject, children: list[JavaObject]) -> JavaObject:
        return node.withNewChildren(self.seq(children)) if children else node

    def function(self, expression: JavaObject) -> str:
        return str(expression.nameParts().apply(0)).lower() if _kind(expression) == "UnresolvedFunction" else ""

    def is_json(self, expression: JavaObject) -> bool:
        return self.function(expression) == "json_extract"

    def json(self, expression: JavaObject, form: str) -> JavaObject:
        """A json_extract call as ``text``, ``number`` or ``ranked`` value."""
        arguments = _items(expression.arguments())
        if len(arguments) != 2:
            raise SqlRefused("json_extract takes a body and a path")
        body, path = (self.expression(a) for a in arguments)
        text = "get_json_object(body_, path_)"
        if form == "text":
            return self.parsed(text, body_=body, path_=path)
        number = f"try_cast({text} AS DOUBLE)"
        if form == "number":
            return self.parsed(number, body_=body, path_=path)
        value = "try_variant_get(try_parse_json(body_), path_, 'variant')"
        kind = f"schema_of_variant({value})"
        number = f"CASE WHEN {kind} = 'BOOLEAN' THEN CAST({text} = 'true' AS DOUBLE) ELSE {number} END"
        return self.parsed(
            f"CASE WHEN {text} IS NULL THEN NULL WHEN {kind} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)' "
            f"THEN named_struct('kind', 0, 'number', {number}, 'text', '') "
            f"ELSE named_struct('kind', 1, 'number', 0D, 'text', {text}) END", body_=body, path_=path,
        )

    def is_dynamic(self, expression: JavaObject) -> bool:
        """Whether an expression has the type of a JSON value, which each row decides: json_extract, and
        what hands such a value on.
        """
        kind = _kind(expression)
        if kind in ("UnresolvedFunction", "CaseWhen"):
            return self.is_json(expression) or any(self.is_dynamic(part) for part in self.handed_on(expression))
        if kind == "ScalarSubquery":
            plan = expression.plan()
            while _kind(plan) in ("Sort", "GlobalLimit", "LocalLimit", "Distinct", "UnresolvedHaving", "Offset"):
                plan = plan.children().apply(0)
            shown = {"Project": "projectList", "Aggregate": "aggregateExpressions"}.get(_kind(plan))
            return bool(shown) and any(self.is_dynamic(part) for part in _items(getattr(plan, shown)()))
        return kind in ("Alias", "UnresolvedAlias") and self.is_dynamic(expression.children().apply(0))

    def handed_on(self, expression: JavaObject) -> list[JavaObject]:
        """The parts one of which is the expression's value."""
        parts = _items(expression.children())
        if _kind(expression) == "CaseWhen":
            return [part for i, part in enumerate(parts) if i % 2 or i == len(parts) - 1]
        name = self.function(expression)
        if name in ("if", "iff"):
            return parts[1:]
        if name in ("min_by", "max_by", "nullif"):
            return parts[:1]
        return parts if name in _PASSING else []

    def ranked(self, expression: JavaObject) -> JavaObject:
        """Any expression as a ranked value: its kind, number and text."""
        if self.is_json(expression):
            return self.json(expression, "ranked")
        kind = _kind(expression)
        if kind == "ScalarSubquery" and self.is_dynamic(expression):
            return self.expression(expression)
        if self.is_dynamic(expression):
            handed = self.handed_on(expression)
            if self.function(expression) == "nullif":
                value, other = (self.ranked(part) for part in _items(expression.children()))
                return self.parsed("nullif(value_, other_)", value_=value, other_=other)
            values = [self.ranked(p) if any(p is h for h in handed) else self.expression(p) for p in self.parts(expression, handed)]
            return self.with_children(expression, values)
        value = self.expression(expression)
        number = "CASE WHEN typeof(value_) = 'boolean' THEN CAST(CAST(value_ AS STRING) = 'true' AS DOUBLE) ELSE try_cast(CAST(value_ AS STRING) AS DOUBLE) END"
        return self.parsed(
            f"CASE WHEN value_ IS NULL THEN NULL WHEN typeof(value_) RLIKE '^(tinyint|smallint|int|bigint|decimal|double|float|boolean)' "
            f"THEN named_struct('kind', 0, 'number', {number}, 'text', '') "
            f"ELSE named_struct('kind', 1, 'number', 0D, 'text', CAST(value_ AS STRING)) END", value_=value,
        )

    def parts(self, expression: JavaObject, handed: list[JavaObject]) -> list[JavaObject]:
        """The children of an expression, those of ``handed`` as the same objects."""
        every, left = _items(expression.children()), list(handed)
        out = []
        for part in every:
            if left and part.equals(left[0]):
                out.append(left.pop(0))
            else:
                out.append(part)
        return out

    def number(self, expression: JavaObject) -> JavaObject:
        """A JSON value in arithmetic: numbers, booleans as 1 and 0, the number a text begins with, else 0."""
        return self.parsed(_NUMBER, value_=self.ranked(expression))

    def cast(self, expression: JavaObject) -> JavaObject:
        """A cast of a JSON value: numbers lose their fraction in whole types, texts give the number they begin with."""
        child, target = expression.children().apply(0), expression.dataType()
        value, wanted = self.ranked(child), target.simpleString()
        if wanted == "string":
            return self.text(value)
        if not re.match("(tinyint|smallint|int|bigint|decimal|double|float)", wanted):
            raise SqlRefused(f"json_extract cannot be cast to {wanted}")
        return self.parsed(f"try_cast({_NUMBER} AS {wanted})", value_=value)

    def text(self, ranked: JavaObject) -> JavaObject:
        """A ranked value as text; whole numbers without a fraction."""
        whole = "value_['number'] = floor(value_['number']) AND abs(value_['number']) < 1e15"
        return self.parsed(
            f"CASE WHEN value_ IS NULL THEN NULL WHEN value_['kind'] = 1 THEN value_['text'] "
            f"WHEN {whole} THEN CAST(CAST(value_['number'] AS BIGINT) AS STRING) ELSE CAST(value_['number'] AS STRING) END", value_=ranked,
        )

    def comparable(self, expression: JavaObject) -> JavaObject:
        """One side of a comparison with a JSON value."""
        inner = expression
        while _kind(inner) in ("UnaryMinus", "UnaryPositive"):
            inner = inner.children().apply(0)
        if _kind(inner) != "Literal":
            return self.ranked(expression)
        if inner.dataType().simpleString() == "string":
            return self.parsed("named_struct('kind', 1, 'number', 0D, 'text', value_)", value_=expression)
        return self.parsed("named_struct('kind', 0, 'number', CAST(value_ AS DOUBLE), 'text', '')", value_=expression)

    def expression(self, expression: JavaObject) -> JavaObject:
        """The expression with its compatibility functions in native form."""
        kind, name, children = _kind(expression), self.function(expression), _items(expression.children())
        if self.is_json(expression):
            return self.json(expression, "text")
        if name == "json_number":
            return self.json(expression, "number")
        if name == "strftime":
            return self.strftime(_items(expression.arguments()))
        if name == "datetime":
            return self.parsed("date_format(at_, 'yyyy-MM-dd HH:mm:ss')", at_=self.instant(_items(expression.arguments())))
        if kind in ("ScalarSubquery", "Exists", "ListQuery"):
            return expression.withNewPlan(self.rebuilt(expression.plan()))
        if name == "group_concat":
            value, *separator = _items(expression.arguments())
            if len(separator) > 1:
                raise SqlRefused("group_concat takes a value and a separator")
            value = self.text(self.ranked(value)) if self.is_dynamic(value) else self.expression(value)
            once = "DISTINCT " if expression.isDistinct() else ""
            parts = {"value_": value} | ({"by_": separator[0]} if separator else {})
            return self.parsed(f"listagg({once}CAST(value_ AS STRING), {'by_' if separator else repr(',')})", **parts)
        if name == "total":
            (value,) = _items(expression.arguments())
            value = self.number(value) if self.is_dynamic(value) else self.expression(value)
            return self.parsed("coalesce(sum(CAST(value_ AS DOUBLE)), 0D)", value_=value)
        if kind == "Cast" and self.is_dynamic(children[0]):
            return self.cast(expression)
        if self.is_dynamic(expression) and kind not in ("Alias", "UnresolvedAlias"):
            return self.ranked(expression)
        holds_json = any(self.is_dynamic(child) for child in children)
        if holds_json and (kind in _COMPARISONS or name == "between"):
            return self.with_children(expression, [self.comparable(child) for child in children])
        if kind == "UnresolvedAlias" and holds_json:
            shown = children[0].sql().replace("`", "``")
            return self.parsed(f"value_ AS `{shown}`", value_=self.ranked(children[0]))
        if kind in ("SortOrder", "Alias"):
            form = self.ranked
        elif name in ("sum", "avg", "mean") or kind in _ARITHMETIC:
            form = self.number
        elif kind in ("IsNull", "IsNotNull") or name in ("count", "isnull", "isnotnull"):
            form = self.ranked
        else:
            form = lambda part: self.json(part, "text") if self.is_json(part) else self.text(self.ranked(part))
        rebuilt = [form(c) if self.is_dynamic(c) else self.expression(c) for c in children]
        return self.with_children(expression, rebuilt)

    def instant(self, arguments: list[JavaObject]) -> JavaObject:
        """A time value: a timestamp or text, or seconds where the modifier says so."""
        at, *modifiers = arguments
        for modifier in modifiers:
            if _kind(modifier) != "Literal" or str(modifier.value()).lower() not in ("unixepoch", "utc"):
                raise SqlRefused("of the time modifiers only 'unixepoch' is known")
        seconds = any(str(m.value()).lower() == "unixepoch" for m in modifiers)
        return self.parsed("timestamp_seconds(CAST(at_ AS DOUBLE))" if seconds else "CAST(at_ AS TIMESTAMP)", at_=self.expression(at))

    def strftime(self, arguments: list[JavaObject]) -> JavaObject:
        """strftime with a constant format: its letters as patterns, all else as it stands."""
        if len(arguments) < 2 or _kind(arguments[0]) != "Literal":
            raise SqlRefused("strftime takes a constant format and a time")
        parts, text = [], str(arguments[0].value())
        for found in re.finditer(r"%(.?)|[^%]+", text, re.DOTALL):
            letter = found[1]
            if letter is None or letter == "%":
                parts.append("'" + (found[0] if letter is None else "%").replace("\\", "\\\\").replace("'", "\\'") + "'")
            elif letter == "s":
                parts.append("CAST(unix_seconds(at_) AS STRING)")
            elif letter == "w":
                parts.append("CAST(dayofweek(at_) - 1 AS STRING)")
            elif letter in _LETTERS:
                parts.append(f"date_format(at_, '{_LETTERS[letter]}')")
            else:
                raise SqlRefused(f"strftime does not know %{letter}")
        return self.parsed(f"concat({', '.join(parts) or repr('')})", at_=self.instant(arguments[1:]))

    def rebuilt(self, plan: JavaObject) -> JavaObject:
        """The plan with the expressions of its nodes adapted, from the leaves up."""
        if _kind(plan) == "UnresolvedWith":
            raise SqlRefused("WITH is not allowed inside the statement")
        plan = self.with_children(plan, [self.rebuilt(child) for child in _items(plan.children())])
        kind = _kind(plan)

        def each(seq: JavaObject) -> JavaObject:
            return self.seq([self.ranked(e) if self.is_dynamic(e) and "Alias" not in _kind(e) else self.expression(e) for e in _items(seq)])

        if kind == "Project":
            return plan.copy(each(plan.projectList()), plan.child())
        if kind == "Filter":
            return plan.copy(self.expression(plan.condition()), plan.child())
        if kind == "UnresolvedHaving":
            return plan.copy(self.expression(plan.havingCondition()), plan.child())
        if kind == "Aggregate":
            return plan.copy(each(plan.groupingExpressions()), each(plan.aggregateExpressions()), plan.child(), plan.hint())
        if kind == "Sort":
            return plan.copy(each(plan.order()), getattr(plan, "global")(), plan.child(), plan.hint())
        if kind == "Join" and plan.condition().isDefined():
            condition = self.jvm.scala.Option.apply(self.expression(plan.condition().get()))
            return plan.copy(plan.left(), plan.right(), plan.joinType(), condition, plan.hint())
        return plan


def _parsed(spark: SparkSession, sql: str) -> tuple[_Guard, JavaObject]:
    statement = sql.strip()
    if not _SELECT.match(statement):
        raise SqlRefused("only SELECT statements are allowed")
    if ";" in statement:
        raise SqlRefused("semicolons are not allowed")
    guard = _Guard(spark)
    plan = guard.parser.parsePlan(statement)
    guard.check(plan, frozenset(READABLE))
    return guard, plan


def check_select(spark: SparkSession, sql: str) -> str:
    """Return the statement if it is a single SELECT over readable tables.

    Every node of the parsed plan, sub-queries included, must be of an allowed kind, every
    relation one of the two names, every function one of ``FUNCTIONS``, and every join must have
    an equality, so that quoting, comments, nesting and computed names do not get past the check.
    On the analysed plan, over a table without rows, the equality must be one between the two
    sides of the join.
    """
    _analysed(prepare(spark).createDataFrame([], LOGS).drop("body_hash"), sql)
    return sql.strip()


def refusal(spark: SparkSession, sql: str) -> str | None:
    """Why a statement does not pass, None if it does."""
    try:
        check_select(spark, sql)
    except SqlRefused as refused:
        return str(refused)
    except (AnalysisException, ParseException) as wrong:
        return str(wrong).splitlines()[0]
    return None


def query_sql(df: DataFrame, sql: str, limit: int | str | None = None) -> DataFrame:
    """Run a guarded SELECT; ``logs`` is ``df``.  At most ``limit`` rows, 100 by default.

    A value of ``json_extract`` has the type it has in the body, row by row, and keeps it through
    COALESCE, CASE, MIN, MAX and sub-queries: it orders and compares by type, numbers before text,
    counts as a number in arithmetic and casts, and as a column of the result it is text.
    ``json_number``, ``strftime``, ``datetime``, ``group_concat`` and ``total`` are there too.
    Nothing is registered in the session.
    """
    return _plain(_analysed(df, sql)).limit(page_limit(limit, 100))


def _analysed(df: DataFrame, sql: str) -> DataFrame:
    """The checked statement over ``df``, analysed but not run."""
    spark = prepare(df.sparkSession)
    guard, plan = _parsed(spark, sql)
    view = f"_logs_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        tables = {
            "logs": f"SELECT * FROM {view}",
            "logs_fts": f"SELECT id AS rowid, body FROM {view}",
        }
        bound = _bound(guard, guard.rebuilt(plan), tables)
        frame = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bound)
        guard.check_analysed(frame.queryExecution().analyzed())
        return DataFrame(frame, spark)
    finally:
        # The analysed plan no longer needs the name.
        spark.catalog.dropTempView(view)


def _bound(guard: _Guard, plan: JavaObject, tables: dict[str, str]) -> JavaObject:
    """The plan with its relations replaced by what they stand for, in sub-queries too."""

    def inside(expression: JavaObject) -> JavaObject:
        if _kind(expression) in ("ScalarSubquery", "Exists", "ListQuery"):
            return expression.withNewPlan(_bound(guard, expression.plan(), tables))
        return guard.with_children(expression, [inside(c) for c in _items(expression.children())])

    kind = _kind(plan)
    if kind == "UnresolvedRelation":
        name = str(plan.multipartIdentifier().apply(0)).lower()
        return guard.parser.parsePlan(f"SELECT * FROM ({tables[name]}) AS {name}").child()
    plan = guard.with_children(plan, [_bound(guard, child, tables) for child in _items(plan.children())])
    if kind == "Project":
        return plan.copy(guard.seq([inside(e) for e in _items(plan.projectList())]), plan.child())
    if kind in ("Filter", "UnresolvedHaving"):
        condition = plan.condition() if kind == "Filter" else plan.havingCondition()
        return plan.copy(inside(condition), plan.child())
    if kind == "Aggregate":
        grouping, shown = ([inside(e) for e in _items(s)] for s in (plan.groupingExpressions(), plan.aggregateExpressions()))
        return plan.copy(guard.seq(grouping), guard.seq(shown), plan.child(), plan.hint())
    return plan


def _plain(df: DataFrame) -> DataFrame:
    """Ranked JSON values as their text."""
    fields = df.schema.fields
    if not any(_is_ranked(field.dataType) for field in fields):
        return df
    numbered, shown = df.toDF(*[f"c{i}" for i in range(len(fields))]), []
    for i, field in enumerate(fields):
        column = F.col(f"c{i}")
        if not _is_ranked(field.dataType):
            shown.append(column.alias(field.name))
            continue
        number = column["number"]
        whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        text = F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))
        shown.append(F.when(column["kind"] == 0, text).otherwise(column["text"]).alias(field.name))
    return numbered.select(*shown)


def _is_ranked(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.simpleString() == _RANKED.simpleString()
