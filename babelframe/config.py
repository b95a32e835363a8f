"""What a dialect is: its surface (how SQL is written) and its semantics (what SQL means)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class SemanticConfig:
    """Runtime meaning. The defaults are those of the reference dialect."""

    identifier_case_fold: str = "lower"  # lower, upper, preserve
    quoted_identifiers_case_sensitive: bool = True
    null_order_default_asc: str = "last"  # first, last
    null_order_default_desc: str = "first"
    null_safe_eq_supported: bool = True
    division_by_zero: str = "null"  # null, error, inf
    integer_division: str = "promote"  # truncate, promote
    implicit_coercion: tuple = ()  # rows of {from, to, rule: allowed | forbidden | explicit_only}
    like_case_sensitive: bool = True
    ilike_supported: bool = True
    string_concat_op: str = "||"  # ||, +, CONCAT_only
    set_op_default: str = "distinct"  # distinct, all
    set_op_precedence: str = "ansi"  # ansi (equal, left to right), except_intersect_tighter
    boolean_truthiness: str = "strict"  # strict, c_style
    count_distinct_null: str = "excluded"  # excluded, included
    sum_of_empty_returns_null: bool = True
    group_by_accepts_select_aliases: bool = True
    select_resolves_through_group_by: bool = True
    window_default_frame: str = "range_unbounded_to_current"  # or rows_unbounded_to_current, rows_unbounded_to_unbounded
    array_base_index: int = 1  # accepted, without effect: there are no arrays
    function_aliases: dict = field(default_factory=dict)  # canonical name -> surface names
    keyword_aliases: dict = field(default_factory=dict)  # keyword -> surface keyword

    CHOICES = {
        "identifier_case_fold": ("lower", "upper", "preserve"),
        "null_order_default_asc": ("first", "last"),
        "null_order_default_desc": ("first", "last"),
        "division_by_zero": ("null", "error", "inf"),
        "integer_division": ("truncate", "promote"),
        "string_concat_op": ("||", "+", "CONCAT_only"),
        "set_op_default": ("distinct", "all"),
        "set_op_precedence": ("ansi", "except_intersect_tighter"),
        "boolean_truthiness": ("strict", "c_style"),
        "count_distinct_null": ("excluded", "included"),
        "window_default_frame": ("range_unbounded_to_current", "rows_unbounded_to_current", "rows_unbounded_to_unbounded"),
    }

    def __post_init__(self) -> None:
        for name, allowed in self.CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")


#: Role of a keyword -> its words in the reference dialect.
KEYWORDS = {
    "select": "SELECT", "from": "FROM", "where": "WHERE", "group_by": "GROUP BY", "having": "HAVING", "order_by": "ORDER BY",
    "limit": "LIMIT", "distinct": "DISTINCT", "union": "UNION", "intersect": "INTERSECT", "except": "EXCEPT", "with": "WITH",
    "as": "AS", "join_inner": "JOIN", "join_left": "LEFT JOIN", "join_right": "RIGHT JOIN", "join_full": "FULL JOIN",
    "join_cross": "CROSS JOIN", "case": "CASE", "when": "WHEN", "then": "THEN", "else": "ELSE", "end": "END", "cast": "CAST",
    "is": "IS", "not": "NOT", "null": "NULL", "in": "IN", "between": "BETWEEN", "like": "LIKE", "ilike": "ILIKE",
    "exists": "EXISTS", "nulls_first": "NULLS FIRST", "nulls_last": "NULLS LAST",
}

#: Role of an operator -> its spellings in the reference dialect.
OPERATORS = {"eq": ["="], "neq": ["<>", "!="], "lt": ["<"], "lte": ["<="], "gt": [">"], "gte": [">="], "add": ["+"], "sub": ["-"], "mul": ["*"], "div": ["/"], "mod": ["%"], "concat": ["||"], "null_safe_eq": ["IS NOT DISTINCT FROM"]}


#: Settings by which a dialect describes itself, with the values that there are. Whatever they say, joins are written FROM a JOIN b
#: ON or USING and conditions CASE WHEN: no dialect has another form. Of the order's places only before_select is read. Other values are refused at load.
LABELS = {
    "join_syntax": {"ansi", "keyword_filter", "pipelined"},
    "case_syntax": {"case_when", "pipeline"},
    "order_by_position": {"after_select", "before_select", "inside_from_brace"},
}


@dataclass(frozen=True)
class SurfaceSpec:
    """How SQL is written. keywords and operators hold only what differs from KEYWORDS and OPERATORS."""

    string_quote: str = "single"  # single, double, backtick
    identifier_quote: str = "double"  # double, backtick, bracket
    comments: tuple[str, ...] = ("--", "/**/")  # --, #, //, /**/
    null_literal: str = "NULL"
    wildcard: str = "*"  # *, ., @
    keywords: dict = field(default_factory=dict)
    operators: dict = field(default_factory=dict)  # a list of spellings; an empty one drops the operator
    join_syntax: str = "ansi"  # a label: see LABELS
    order_by_position: str = "after_select"
    limit_syntax: str = "limit_offset"  # limit_offset, offset_fetch, top_n, sample_n, head_n
    cast_syntax: str = "cast_as"  # cast_as, double_colon, convert_fn, as_fn
    case_syntax: str = "case_when"  # a label: see LABELS
    function_aliases: dict = field(default_factory=dict)
    requires_terminator: bool = False
    terminator: str = ";"

    def keyword(self, role: str) -> tuple[str, ...]:
        return tuple(self.keywords.get(role, KEYWORDS[role]).upper().split())

    def spellings(self, role: str) -> list[str]:
        found = self.operators.get(role, OPERATORS[role])
        return [found] if isinstance(found, str) else list(found)


@dataclass(frozen=True)
class Dialect:
    name: str = "reference"
    surface: SurfaceSpec = field(default_factory=SurfaceSpec)
    semantics: SemanticConfig = field(default_factory=SemanticConfig)
    description: str = ""

    @staticmethod
    def from_dict(d: dict[str, Any]) -> Dialect:
        surface = dict(d.get("surface", {}))
        if "comments" in surface:
            surface["comments"] = tuple(surface["comments"])
        known = {f.name for f in fields(SurfaceSpec)}
        if extra := set(surface) - known:
            raise ValueError(f"unknown surface settings: {', '.join(sorted(extra))}")
        for k, values in LABELS.items():
            if surface.get(k) is not None and surface[k] not in values:
                raise ValueError(f"{k} is one of {', '.join(sorted(values))}, not {surface[k]!r}")
        semantics = dict(d.get("semantics", {}))
        known = {f.name for f in fields(SemanticConfig)}
        if extra := set(semantics) - known:
            raise ValueError(f"unknown semantic settings: {', '.join(sorted(extra))}")
        if "implicit_coercion" in semantics:
            semantics["implicit_coercion"] = tuple(semantics["implicit_coercion"])
        return Dialect(d["name"], SurfaceSpec(**surface), SemanticConfig(**semantics), d.get("description", ""))

    def to_dict(self) -> dict[str, Any]:
        """Only what differs from the reference dialect."""
        out: dict[str, Any] = {"name": self.name}
        if self.description:
            out["description"] = self.description
        for part, base in (("surface", SurfaceSpec()), ("semantics", SemanticConfig())):
            own = asdict(getattr(self, part))
            differs = {k: v for k, v in own.items() if v != getattr(base, k)}
            if differs:
                out[part] = differs
        return out

    def with_semantics(self, **changes: Any) -> Dialect:
        return replace(self, semantics=replace(self.semantics, **changes))

    def with_surface(self, **changes: Any) -> Dialect:
        return replace(self, surface=replace(self.surface, **changes))


REFERENCE = Dialect()
FOLDER = Path(__file__).parent / "dialects"


def load_dialect(name: str, folder: Path | str = FOLDER) -> Dialect:
    path = Path(folder) / f"{name}.json"
    if not path.exists():
        raise KeyError(f"no dialect {name!r}; there are: {', '.join(list_dialects(folder))}")
    return Dialect.from_dict(json.loads(path.read_text()))


def save_dialect(dialect: Dialect, folder: Path | str) -> Path:
    path = Path(folder) / f"{dialect.name}.json"
    path.write_text(json.dumps(dialect.to_dict(), indent=1, default=list) + "\n")
    return path


def list_dialects(folder: Path | str = FOLDER) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.json"))
