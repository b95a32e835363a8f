"""Scalar functions: a name, its surface aliases, and a builder from bound arguments to a bound column.

Built-ins come first; a dialect's own FUNCTIONS are asked for names that no built-in has. A user's function
gets plain Columns, and a Python or pandas UDF is one such function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BindError
from ..operators.semantics import SPARK_TYPE, Bound, Semantics, common_kind, to_kind

#: Surface names that mean a canonical function in every dialect.
ALIASES = {
    "UCASE": "UPPER", "LCASE": "LOWER", "LEN": "LENGTH", "CHAR_LENGTH": "LENGTH", "CHARACTER_LENGTH": "LENGTH", "SUBSTRING": "SUBSTR", "MID": "SUBSTR",
    "BTRIM": "TRIM", "STRIP": "TRIM", "IIF": "IF", "CEILING": "CEIL", "EXTRACT": "DATE_PART", "DATEPART": "DATE_PART", "DATEDIFF": "DATE_DIFF",
    "IFNULL": "COALESCE", "NVL": "COALESCE", "ISNULL": "COALESCE", "VALUE": "COALESCE", "FIRSTNONNIL": "COALESCE", "IFNONE": "COALESCE",
    "ABSOLUTE": "ABS", "POW": "POWER", "GETDATE": "NOW", "SYSDATE": "NOW", "CURRENT_TIMESTAMP": "NOW",
}

_PARTS = {"yyyy": "year", "year": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "second": "second", "dow": "dow", "dayofweek": "dow", "doy": "doy", "dayofyear": "doy", "quarter": "quarter", "week": "week"}


def _text(b: Bound) -> Column:
    return b.col if b.kind == "TEXT" else b.col.cast("string")


def _part(b: Bound, allowed: set[str], name: str) -> str:
    part = str(b.literal).lower() if b.literal is not None else ""
    part = _PARTS.get(part, part)
    if part not in allowed:
        raise BindError(f"{name} needs one of {', '.join(sorted(allowed))}, not {b.literal!r}")
    return part


def _same_kind(args: list[Bound]) -> tuple[list[Column], str]:
    kind = common_kind([a.kind for a in args])
    return [to_kind(a, kind) for a in args], kind


def _time(b: Bound) -> Column:
    return b.col.try_cast("timestamp_ntz") if b.kind == "TEXT" else b.col


def _date_part(a: list[Bound], s: Semantics) -> Bound:
    part = _part(a[0], {"year", "month", "day", "hour", "minute", "second", "dow", "doy", "quarter", "week"}, "DATE_PART")
    x = _time(a[1])
    out = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
        "dow": lambda c: F.weekday(c) + 1, "doy": F.dayofyear, "quarter": F.quarter, "week": F.weekofyear,
    }[part](x)
    return Bound(out.cast("bigint"), "INT")


def _date_trunc(a: list[Bound], s: Semantics) -> Bound:
    part = _part(a[0], {"year", "quarter", "month", "week", "day", "hour", "minute", "second"}, "DATE_TRUNC")
    if a[1].kind == "DATE":
        return Bound(a[1].col if part in ("day", "hour", "minute", "second") else F.trunc(a[1].col, part), "DATE")
    x = _time(a[1]).cast("timestamp_ntz")
    if part in ("hour", "minute", "second"):  # Spark's own goes through the session's time zone
        second = F.extract(F.lit("second"), x)  # with its fraction
        over = {"second": F.pmod(second, F.lit(1)), "minute": second, "hour": second + 60 * F.minute(x)}[part]
        return Bound(x - F.make_dt_interval(secs=over), "TIMESTAMP")
    day = x.cast("date") if part == "day" else F.trunc(x.cast("date"), part)
    return Bound(day.cast("timestamp_ntz"), "TIMESTAMP")


def _shift(sign: int) -> Callable[[list[Bound], Semantics], Bound]:
    def build(a: list[Bound], s: Semantics) -> Bound:
        days = (a[1].col if sign > 0 else -a[1].col).cast("int")
        if a[0].kind == "TIMESTAMP":
            return Bound(a[0].col + F.make_dt_interval(days), "TIMESTAMP")
        return Bound(F.date_add(a[0].col.try_cast("date") if a[0].kind == "TEXT" else a[0].col, days), "DATE")

    return build


def _date_diff(a: list[Bound], s: Semantics) -> Bound:
    """Second minus first. Months, quarters and years count calendar boundaries; shorter units are elapsed time cut towards zero."""
    unit = "day"
    if len(a) == 3:
        unit = str(a[0].literal).lower().rstrip("s") if a[0].literal is not None else ""
        a = a[1:]
    x, y = (_time(b) for b in a)
    months = (F.year(y) * 12 + F.month(y)) - (F.year(x) * 12 + F.month(x))
    cut = lambda n, d: F.call_function("div", n.cast("bigint"), F.lit(d).cast("bigint"))
    if unit == "day":
        out = F.datediff(y, x)
    elif unit == "week":
        out = cut(F.datediff(y, x), 7)
    elif unit == "month":
        out = months
    elif unit == "quarter":
        out = cut(months, 3)
    elif unit == "year":
        out = F.year(y) - F.year(x)
    elif unit in ("hour", "minute", "second"):
        gap = y.cast("timestamp_ntz") - x.cast("timestamp_ntz")  # an interval of days to seconds, whatever the time zone
        seconds = F.extract(F.lit("day"), gap) * 86400 + F.extract(F.lit("hour"), gap) * 3600 + F.extract(F.lit("minute"), gap) * 60 + F.extract(F.lit("second"), gap)
        out = cut(seconds, {"hour": 3600, "minute": 60, "second": 1}[unit])
    else:
        raise BindError(f"unknown unit {unit!r} in DATE_DIFF")
    return Bound(out.cast("bigint"), "INT")


def _round(a: list[Bound], s: Semantics) -> Bound:
    n = 0
    if len(a) > 1:
        if not isinstance(a[1].literal, int):
            raise BindError("the second argument of ROUND must be a whole number")
        n = a[1].literal
    if a[0].kind == "INT":
        return Bound(F.round(a[0].col, n).cast("bigint"), "INT")
    return Bound(F.round(a[0].col.cast("double"), n), "FLOAT")


def _whole(f: Callable) -> Callable[[list[Bound], Semantics], Bound]:
    def build(a: list[Bound], s: Semantics) -> Bound:
        return Bound(a[0].col, "INT") if a[0].kind == "INT" else Bound(f(a[0].col.cast("double")).cast("double"), "FLOAT")

    return build


def _substr(a: list[Bound], s: Semantics) -> Bound:
    """1-based. A start before the first character takes from the first on, with what is left of the length."""
    x, start = _text(a[0]), a[1].col.cast("int")
    first = F.greatest(start, F.lit(1))
    if len(a) == 2:
        return Bound(F.substr(x, first), "TEXT")
    end = start + a[2].col.cast("int")
    return Bound(F.substr(x, first, F.greatest(end - first, F.lit(0))), "TEXT")


def _pick(f: Callable) -> Callable[[list[Bound], Semantics], Bound]:
    def build(a: list[Bound], s: Semantics) -> Bound:
        cols, kind = _same_kind(a)
        return Bound(f(*cols) if len(cols) > 1 else cols[0], kind)

    return build


def _if(a: list[Bound], s: Semantics) -> Bound:
    cols, kind = _same_kind(a[1:] if len(a) > 2 else [a[1], Bound(F.lit(None), "NULL")])
    return Bound(F.when(s.truth(a[0]), cols[0]).otherwise(cols[1]), kind)


def _nullif(a: list[Bound], s: Semantics) -> Bound:
    return Bound(F.when(F.coalesce(s.compare("eq", a[0], a[1]).col, F.lit(False)), F.lit(None)).otherwise(a[0].col), a[0].kind)


def _decode(a: list[Bound], s: Semantics) -> Bound:
    pairs, rest = a[1:], None
    if len(pairs) % 2:
        pairs, rest = pairs[:-1], pairs[-1]
    results = [*pairs[1::2], *([rest] if rest else [])]
    kind = common_kind([r.kind for r in results])
    out = None
    for test, value in zip(pairs[::2], pairs[1::2], strict=True):
        c = a[0].col.eqNullSafe(test.col)
        out = F.when(c, to_kind(value, kind)) if out is None else out.when(c, to_kind(value, kind))
    return Bound(out.otherwise(to_kind(rest, kind)) if rest else out, kind)


def _float(f: Callable) -> Callable[[list[Bound], Semantics], Bound]:
    return lambda a, s: Bound(f(*(x.col.cast("double") for x in a)), "FLOAT")


#: name -> (fewest arguments, most arguments, builder)
SCALARS: dict[str, tuple[int, int, Callable[[list[Bound], Semantics], Bound]]] = {
    "COALESCE": (1, 99, _pick(F.coalesce)),
    "UPPER": (1, 1, lambda a, s: Bound(F.upper(_text(a[0])), "TEXT")),
    "LOWER": (1, 1, lambda a, s: Bound(F.lower(_text(a[0])), "TEXT")),
    "LENGTH": (1, 1, lambda a, s: Bound(F.length(_text(a[0])).cast("bigint"), "INT")),
    "CONCAT": (1, 99, lambda a, s: Bound(F.concat(*map(_text, a)), "TEXT")),
    "ABS": (1, 1, lambda a, s: Bound(F.abs(a[0].col), a[0].kind)),
    "TRIM": (1, 1, lambda a, s: Bound(F.regexp_replace(_text(a[0]), r"^\s+|\s+$", ""), "TEXT")),
    "SUBSTR": (2, 3, _substr),
    "REPLACE": (3, 3, lambda a, s: Bound(F.replace(*map(_text, a)), "TEXT")),
    "IF": (2, 3, _if),
    "NULLIF": (2, 2, _nullif),
    "GREATEST": (1, 99, _pick(F.greatest)),
    "LEAST": (1, 99, _pick(F.least)),
    "DATE_PART": (2, 2, _date_part),
    "DATE_TRUNC": (2, 2, _date_trunc),
    "DATE_ADD": (2, 2, _shift(1)),
    "DATE_SUB": (2, 2, _shift(-1)),
    "DATE_DIFF": (2, 3, _date_diff),
    "ROUND": (1, 2, _round),
    "FLOOR": (1, 1, _whole(F.floor)),
    "CEIL": (1, 1, _whole(F.ceil)),
    "MOD": (2, 2, lambda a, s: s.modulo(a[0], a[1])),
    "LIKE": (2, 2, lambda a, s: s.like(a[0], a[1], False)),
    "ILIKE": (2, 2, lambda a, s: s.like(a[0], a[1], True)),
    # beyond the reference's executable functions: names that its dialects advertise
    "POWER": (2, 2, _float(F.pow)),
    "SQRT": (1, 1, _float(lambda x: F.when(x >= 0, F.sqrt(x)))),
    "LN": (1, 1, _float(F.log)),
    "LOG10": (1, 1, _float(F.log10)),
    "EXP": (1, 1, _float(F.exp)),
    "SIGN": (1, 1, lambda a, s: Bound(F.signum(a[0].col).cast("bigint"), "INT")),
    "INSTR": (2, 2, lambda a, s: Bound(F.call_function("instr", _text(a[0]), _text(a[1])).cast("bigint"), "INT")),
    "CONCAT_WS": (2, 99, lambda a, s: Bound(F.call_function("concat_ws", *map(_text, a)), "TEXT")),
    "TO_DATE": (1, 1, lambda a, s: Bound(a[0].col.try_cast("date"), "DATE")),
    "TYPEOF": (1, 1, lambda a, s: Bound(F.lit(a[0].kind.lower()), "TEXT")),
    "NOW": (0, 0, lambda a, s: Bound(F.current_timestamp().cast("timestamp_ntz"), "TIMESTAMP")),
    "NVL2": (3, 3, lambda a, s: Bound(F.when(a[0].col.isNotNull(), _same_kind(a[1:])[0][0]).otherwise(_same_kind(a[1:])[0][1]), _same_kind(a[1:])[1])),
    "DECODE": (3, 99, _decode),
}

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "STDDEV", "VARIANCE", "GROUP_CONCAT"}
AGGREGATE_ALIASES = {"TOTAL": "SUM", "STDDEV_SAMP": "STDDEV", "VAR_SAMP": "VARIANCE", "LISTAGG": "GROUP_CONCAT", "STRING_AGG": "GROUP_CONCAT"}
WINDOW_ONLY = {"ROW_NUMBER", "RANK", "DENSE_RANK", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "NTILE", "PERCENT_RANK", "CUME_DIST"}


class Library:
    """Names of one dialect: its own aliases before the general ones, built-ins before its own functions."""

    def __init__(self, semantics: Semantics, aliases: dict[str, list[str]], functions: dict | None = None, operators: dict | None = None):
        self.s = semantics
        self.own = {a.upper(): k.upper() for k, names in aliases.items() for a in ([names] if isinstance(names, str) else names)}
        self.functions = {k.upper(): f for k, f in (functions or {}).items()}
        self.operators = {k.upper(): f for k, f in (operators or {}).items()}

    def canonical(self, name: str) -> str:
        name = name.upper()
        if name in self.own and self.own[name] != name:
            name = self.own[name]
        name = ALIASES.get(name, name) if name not in SCALARS else name
        return AGGREGATE_ALIASES.get(name, name)

    def scalar(self, surface: str, args: list[Bound], type_of: Callable[[Column], str]) -> Bound:
        name = self.canonical(surface)
        if name in SCALARS:
            least, most, build = SCALARS[name]
            if not least <= len(args) <= most:
                raise BindError(f"{surface} takes {least if least == most else f'{least} to {most}'} arguments, not {len(args)}")
            return build(args, self.s)
        for table in (self.functions, self.operators):
            if (f := table.get(surface.upper()) or table.get(name)) is not None:
                col = f([a.col for a in args], self.s.c)
                return Bound(col, type_of(col))
        raise BindError(f"there is no function {surface}")


__all__ = ["AGGREGATES", "ALIASES", "Library", "SCALARS", "SPARK_TYPE", "WINDOW_ONLY"]
