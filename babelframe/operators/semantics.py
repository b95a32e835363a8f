"""The one place where a dialect's meaning turns into Spark columns.

Every choice at which engines differ is spelled out here; Spark's own default is never relied on at such a point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from ..config import SemanticConfig
from ..errors import BindError


@dataclass
class Bound:
    """A column and the kind of its values: INT FLOAT TEXT BOOL DATE TIMESTAMP NULL, or OTHER."""

    col: Column
    kind: str
    literal: object = None


SPARK_TYPE = {"INT": "bigint", "FLOAT": "double", "TEXT": "string", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "TEXT"
    if isinstance(t, T.BooleanType):
        return "BOOL"
    if isinstance(t, T.DateType):
        return "DATE"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    return "NULL" if isinstance(t, T.NullType) else "OTHER"


def common_kind(kinds: list[str]) -> str:
    """The kind that values of several kinds are brought to: numbers widen, anything with text is text."""
    found = {k for k in kinds if k != "NULL"}
    if not found:
        return "NULL"
    if len(found) == 1:
        return found.pop()
    if found <= {"INT", "FLOAT"}:
        return "FLOAT"
    if found <= {"DATE", "TIMESTAMP"}:
        return "TIMESTAMP"
    return "TEXT" if "TEXT" in found else "OTHER"


def to_kind(b: Bound, kind: str) -> Column:
    if b.kind == kind or kind not in SPARK_TYPE:
        return b.col
    return b.col.cast(SPARK_TYPE[kind])


class Semantics:
    def __init__(self, config: SemanticConfig, effects: dict | None = None):
        self.c, self.effects = config, effects or {}

    # --- coercion -----------------------------------------------------------------------------------------------

    def check_pair(self, a: Bound, b: Bound, what: str) -> None:
        for rule in self.c.implicit_coercion:
            if rule.get("rule") in ("forbidden", "explicit_only") and {rule["from"].upper(), rule["to"].upper()} == {a.kind, b.kind} and a.kind != b.kind:
                raise BindError(f"{what} of {a.kind} and {b.kind} needs an explicit cast in this dialect")

    def truth(self, b: Bound) -> Column:
        """A value at a predicate's place."""
        if b.kind in ("BOOL", "NULL", "OTHER"):
            return b.col.cast("boolean") if b.kind == "NULL" else b.col
        if self.c.boolean_truthiness == "c_style":
            if b.kind in ("INT", "FLOAT"):
                return b.col != F.lit(0)
            if b.kind == "TEXT":
                return F.length(b.col) > 0
        raise BindError(f"a {b.kind} value stands where a condition is needed")

    # --- arithmetic ---------------------------------------------------------------------------------------------

    def arithmetic(self, op: str, a: Bound, b: Bound) -> Bound:
        self.check_pair(a, b, "arithmetic")
        for x in (a, b):
            if x.kind == "BOOL":
                raise BindError("arithmetic on a condition")
        if op == "div":
            return self.divide(a, b)
        if op == "mod":
            return self.modulo(a, b)
        kind = "INT" if {a.kind, b.kind} <= {"INT", "NULL"} else "FLOAT"
        if a.kind == "DATE" and b.kind == "INT" and op in ("add", "sub"):
            return Bound(F.date_add(a.col, (b.col if op == "add" else -b.col).cast("int")), "DATE")
        if a.kind == b.kind == "DATE" and op == "sub":
            return Bound(F.datediff(a.col, b.col).cast("bigint"), "INT")
        x, y = (to_kind(v, kind) if v.kind in ("INT", "FLOAT", "NULL") else v.col.try_cast("double") for v in (a, b))
        if kind == "INT":
            x, y = x.cast("bigint"), y.cast("bigint")
        return Bound({"add": x + y, "sub": x - y, "mul": x * y}[op], kind)

    def divide(self, a: Bound, b: Bound) -> Bound:
        mode, ints = self.c.division_by_zero, {a.kind, b.kind} <= {"INT", "NULL"} and a.kind == "INT"
        if ints and self.c.integer_division == "truncate":
            whole = F.call_function("div", a.col.cast("bigint"), b.col.cast("bigint"))
            return Bound(F.when(b.col != 0, whole) if mode == "null" else whole, "INT")
        x, y = a.col.try_cast("double") if a.kind == "TEXT" else a.col.cast("double"), b.col.try_cast("double") if b.kind == "TEXT" else b.col.cast("double")
        if mode == "null":
            return Bound(F.try_divide(x, y), "FLOAT")
        if mode == "error" or ints:
            return Bound(x / y, "FLOAT")
        inf, nan = F.lit(float("inf")), F.lit(float("nan"))
        zero = F.when(x > 0, inf).when(x < 0, -inf).when(x.isNotNull(), nan)
        return Bound(F.when(y == 0, zero).otherwise(F.try_divide(x, y)), "FLOAT")

    def modulo(self, a: Bound, b: Bound) -> Bound:
        kind = "INT" if {a.kind, b.kind} <= {"INT", "NULL"} else "FLOAT"
        x, y = to_kind(a, kind).cast(SPARK_TYPE[kind]), to_kind(b, kind).cast(SPARK_TYPE[kind])
        return Bound(x % y if self.c.division_by_zero == "error" else F.try_mod(x, y), kind)

    def concat(self, a: Bound, b: Bound) -> Bound:
        return Bound(F.concat(a.col.cast("string"), b.col.cast("string")), "TEXT")

    # --- comparison ---------------------------------------------------------------------------------------------

    def compare(self, op: str, a: Bound, b: Bound) -> Bound:
        self.check_pair(a, b, "comparison")
        if op in ("eq", "neq") and a.kind == b.kind == "TEXT" and (handler := self.effects.get(f"text_{op}")) is not None:
            out = handler(a.col, b.col, self.c)
            if out is not None:
                return Bound(out, "BOOL")
        x, y = a.col, b.col
        if {a.kind, b.kind} == {"TEXT", "INT"} or {a.kind, b.kind} == {"TEXT", "FLOAT"}:
            x, y = (v.col.try_cast("double") if v.kind == "TEXT" else v.col.cast("double") for v in (a, b))
        elif {a.kind, b.kind} in ({"TEXT", "DATE"}, {"TEXT", "TIMESTAMP"}):
            to = SPARK_TYPE[a.kind if b.kind == "TEXT" else b.kind]
            x, y = (v.col.try_cast(to) if v.kind == "TEXT" else v.col for v in (a, b))
        out = {
            "eq": lambda: x == y, "neq": lambda: x != y, "lt": lambda: x < y, "lte": lambda: x <= y, "gt": lambda: x > y, "gte": lambda: x >= y,
            "null_safe_eq": lambda: x.eqNullSafe(y), "null_safe_neq": lambda: ~x.eqNullSafe(y),
        }[op]()
        return Bound(out, "BOOL")

    def like(self, a: Bound, pattern: Bound, insensitive: bool) -> Bound:
        loose = insensitive or not self.c.like_case_sensitive
        if (handler := self.effects.get("text_in_pattern")) is not None:
            out = handler(a.col, pattern.col, self.c, not loose)
            if out is not None:
                return Bound(out, "BOOL")
        return Bound(F.call_function("ilike" if loose else "like", a.col.cast("string"), pattern.col.cast("string")), "BOOL")

    def cast(self, a: Bound, kind: str) -> Bound:
        """Bad input is NULL in every dialect."""
        if a.kind == "DATE" and kind in ("INT", "FLOAT", "BOOL") or a.kind == "TIMESTAMP" and kind in ("INT", "FLOAT", "BOOL"):
            raise BindError(f"{a.kind} cannot be cast to {kind}")
        col = a.col
        if a.kind == "TEXT" and kind == "INT":
            col = F.coalesce(col.try_cast("bigint"), col.try_cast("double").try_cast("bigint"))
            return Bound(col, kind)
        return Bound(col.try_cast(SPARK_TYPE[kind]), kind)

    # --- ordering and windows -----------------------------------------------------------------------------------

    def order(self, col: Column, descending: bool, nulls: str | None) -> Column:
        nulls = nulls or (self.c.null_order_default_desc if descending else self.c.null_order_default_asc)
        if descending:
            return col.desc_nulls_first() if nulls == "first" else col.desc_nulls_last()
        return col.asc_nulls_first() if nulls == "first" else col.asc_nulls_last()

    def default_frame(self, w: WindowSpec, ordered: bool) -> WindowSpec:
        far, now = (Window.unboundedPreceding, Window.unboundedFollowing), Window.currentRow
        if not ordered or self.c.window_default_frame == "rows_unbounded_to_unbounded":
            return w.rowsBetween(*far)
        if self.c.window_default_frame == "rows_unbounded_to_current":
            return w.rowsBetween(far[0], now)
        return w.rangeBetween(far[0], now)

    # --- aggregates ---------------------------------------------------------------------------------------------

    def total(self, col: Column) -> Column:
        return col if self.c.sum_of_empty_returns_null else F.coalesce(col, F.lit(0))
