"""Conditions of rules as text: a whitelist of names, comparisons, arithmetic and boolean operators becomes columns.

Nothing is evaluated but column expressions that are built here. A name is a fact, `x_changed` or `x_delta` of a fact
x (against the row before of its series), or `thresholds.x`. A condition that can't be read, or names anything else, is
false and is reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators.rules import Rule, evaluate

#: A rule table may have so many rules: each becomes a part of one plan, on the driver.
MAX_RULES = 1000
MAX_LENGTH, MAX_DEPTH = 2000, 50

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|('[^'\\]*'|\"[^\"\\]*\")|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(===|!==|==|!=|<=|>=|&&|\|\||[<>!+\-*/%()]))")
_ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_SAME = {"==": False, "===": False, "!=": True, "!==": True}
_ADD = {"+": F.try_add, "-": F.try_subtract}
_MULTIPLY = {"*": F.try_multiply, "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "%": F.try_mod}


class BadCondition(ValueError):
    """A condition that isn't in the language."""


@dataclass(frozen=True)
class Named:
    """A column with its kind: number, text, truth, or nothing (null)."""

    column: Column
    kind: str


def _constant(word: str) -> Named | None:
    return {"true": lambda: Named(F.lit(True), "truth"), "false": lambda: Named(F.lit(False), "truth"), "null": lambda: Named(F.lit(None), "nothing")}.get(word, lambda: None)()


def _needs(kind: str, *parts: Named) -> None:
    for p in parts:
        if p.kind not in (kind, "nothing"):
            raise BadCondition(f"a {p.kind} where a {kind} is needed")


class _Reader:
    """Tokens of a condition, read by precedence: ||, &&, comparison, + -, * / %, ! and -."""

    def __init__(self, text: str, names: dict[str, Named]):
        if len(text) > MAX_LENGTH:
            raise BadCondition("too long")
        self.names, self.tokens, at = names, [], 0
        text = text.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise BadCondition(f"unknown at {at}: {text[at:at + 10]!r}")
            self.tokens.append(found)
            at = found.end()
        self.at = self.depth = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][4] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][4]

    def whole(self) -> Named:
        out = self.either()
        if self.at < len(self.tokens):
            raise BadCondition("more than one condition")
        return out

    def either(self) -> Named:
        out = self.both()
        while self.peek() == "||":
            self.take()
            out = Named(_truth(out) | _truth(self.both()), "truth")
        return out

    def both(self) -> Named:
        out = self.compared()
        while self.peek() == "&&":
            self.take()
            out = Named(_truth(out) & _truth(self.compared()), "truth")
        return out

    def compared(self) -> Named:
        out = self.numbers(self.multiplied, _ADD)
        while self.peek() in _ORDER or self.peek() in _SAME:
            operator = self.take()
            right = self.numbers(self.multiplied, _ADD)
            if operator in _ORDER:
                _needs("number", out, right)
                out = Named(_ORDER[operator](out.column, right.column), "truth")
            else:
                if "nothing" not in (out.kind, right.kind) and out.kind != right.kind:
                    raise BadCondition(f"a {out.kind} beside a {right.kind}")
                same = out.column.eqNullSafe(right.column)
                out = Named(~same if _SAME[operator] else same, "truth")
        return out

    def multiplied(self) -> Named:
        return self.numbers(self.one, _MULTIPLY)

    def numbers(self, below, operators) -> Named:
        out = below()
        while self.peek() in operators:
            operator = operators[self.take()]
            right = below()
            _needs("number", out, right)
            out = Named(operator(out.column, right.column), "number")
        return out

    def one(self) -> Named:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise BadCondition("too deep")
        try:
            if self.at >= len(self.tokens):
                raise BadCondition("ends early")
            if self.peek() == "!":
                self.take()
                return Named(~_truth(self.one()), "truth")
            if self.peek() == "-":
                self.take()
                below = self.one()
                _needs("number", below)
                return Named(F.try_subtract(F.lit(0), below.column), "number")
            if self.peek() == "(":
                self.take()
                out = self.either()
                if self.peek() != ")":
                    raise BadCondition("no closing bracket")
                self.take()
                return out
            token = self.tokens[self.at]
            self.at += 1
            if token[1]:
                return Named(F.lit(float(token[1])), "number")
            if token[2]:
                return Named(F.lit(token[2][1:-1]), "text")
            named = token[3] and (_constant(token[3]) or self.names.get(token[3]))
            if not named:
                raise BadCondition(f"unknown name or misplaced operator: {token[0].strip()!r}")
            return named
        finally:
            self.depth -= 1


def _truth(part: Named) -> Column:
    """A number holds if it isn't zero, a text if it isn't empty; null doesn't."""
    empty = {"truth": part.column, "number": part.column != 0, "text": part.column != "", "nothing": F.lit(False)}[part.kind]
    return F.coalesce(empty, F.lit(False))


def condition(text: str, names: dict[str, Named]) -> Column:
    """The column of a condition's text; BadCondition if it isn't in the language. What can't be judged is false."""
    return _truth(_Reader(text, names).whole())


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _named(df: DataFrame, name: str, column: Column | None = None) -> Named | None:
    kind = dict(df.dtypes)[name].split("(")[0]
    kind = "number" if kind in _NUMBERS else {"string": "text", "boolean": "truth"}.get(kind)
    return kind and Named(F.col(name) if column is None else column, kind)


def names_of(facts: DataFrame, thresholds: dict[str, float], by: list[str], order: list[str]) -> tuple[DataFrame, dict[str, Named]]:
    """facts with the values of the row before in each series, and all names that conditions may use. Columns that are no
    numbers, texts or truth values have no name."""
    w = W.partitionBy(*by).orderBy(*order)
    plain = {c: n for c in facts.columns if (n := _named(facts, c))}
    own = [c for c in plain if c not in (*by, *order)]
    wide = facts.withColumns({f"_before_{c}": F.lag(c).over(w) for c in own} | {"_nth": F.row_number().over(w)})
    changed = {f"{c}_changed": Named((F.col("_nth") > 1) & ~F.col(c).eqNullSafe(F.col(f"_before_{c}")), "truth") for c in own}
    delta = {f"{c}_delta": Named(F.try_subtract(F.col(c), F.col(f"_before_{c}")), "number") for c in own if plain[c].kind == "number"}
    return wide, plain | changed | delta | {f"thresholds.{k}": Named(F.lit(float(v)), "number") for k, v in thresholds.items()}


def rules_of(table: DataFrame, names: dict[str, Named]) -> tuple[list[Rule], list[tuple[str, str]]]:
    """The rules of a table (rule, kind, priority, page, condition), and those that were refused, with the reason."""
    rows = table.select("rule", "kind", "priority", "page", "condition").orderBy("rule").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rules, refused = [], []
    for r in rows:
        try:
            rules.append(Rule(r["rule"], r["kind"], r["priority"], condition(r["condition"] or "", names), r["page"] or ""))
        except BadCondition as e:
            refused.append((r["rule"], str(e)))
    return rules, refused


def evaluate_table(facts: DataFrame, table: DataFrame, thresholds: dict[str, float], by: list[str], order: list[str]) -> DataFrame:
    """The facts with one row for each rule of a table that holds: rule, kind, priority, page. Refused rules hold nowhere."""
    wide, names = names_of(facts, thresholds, by, order)
    rules, _ = rules_of(table, names)
    if not rules:
        return facts.limit(0).selectExpr("*", "'' AS rule", "'' AS kind", "0 AS priority", "'' AS page")
    return evaluate(wide, rules).select(*facts.columns, "rule", "kind", "priority", "page")
