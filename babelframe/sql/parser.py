"""One hand-written parser for every surface: precedence climbing over roles, not over fixed keywords."""

from __future__ import annotations

from ..config import KEYWORDS, Dialect
from ..errors import ParseError
from .lexer import Token, tokens
from .tree import (
    Between, Binary, Call, Case, Cast, Col, Cte, Derived, Exists, Frame, InList, InQuery, IsNull, Item, Join, Like, Lit, Name, Node,
    OrderKey, Over, Query, Scalar, Select, SetOp, Star, Table, Unary,
)

#: Type names and the kinds they mean.
TYPES = {
    "INT": "INT", "INTEGER": "INT", "BIGINT": "INT", "SMALLINT": "INT", "SIGNED": "INT", "UNSIGNED": "INT",
    "FLOAT": "FLOAT", "DOUBLE": "FLOAT", "REAL": "FLOAT", "NUMERIC": "FLOAT", "NUMBER": "FLOAT", "DECIMAL": "FLOAT",
    "VARCHAR": "TEXT", "TEXT": "TEXT", "STRING": "TEXT", "CHAR": "TEXT",
    "BOOLEAN": "BOOL", "BOOL": "BOOL", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "DATETIME": "TIMESTAMP",
}

_FIXED = {"AND", "OR", "ON", "USING", "ASC", "DESC", "OFFSET", "OVER", "FILTER", "QUALIFY", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "JOIN", "NATURAL"}
_COMPARISONS = ("null_safe_eq", "lte", "gte", "neq", "eq", "lt", "gt")


class Parser:
    def __init__(self, sql: str, dialect: Dialect):
        self.d, self.s = dialect, dialect.surface
        self.t = tokens(sql, self.s)
        self.i = 0
        self.words = {role: self.s.keyword(role) for role in KEYWORDS}
        self.words |= {role: (v.upper(),) for role, v in dialect.semantics.keyword_aliases.items() if role in KEYWORDS}
        # words that can't be a bare alias: the first words of all keywords, in place here
        self.reserved = _FIXED | {w[0] for w in self.words.values()} | {w.upper() for o in ("mod", "null_safe_eq", "concat") for w in (x.split()[0] for x in self.s.spellings(o)) if w[0].isalpha()}
        if self.s.limit_syntax == "offset_fetch":
            self.reserved.add("FETCH")
        elif self.s.limit_syntax in ("top_n", "sample_n", "head_n"):
            self.reserved |= {{"top_n": "TOP", "sample_n": "SAMPLE", "head_n": "HEAD"}[self.s.limit_syntax]}

    # --- tokens -------------------------------------------------------------------------------------------------

    def peek(self, k: int = 0) -> Token:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def fail(self, wanted: str) -> ParseError:
        t = self.peek()
        return ParseError(f"expected {wanted} but found {t.text!r} at character {t.at + 1}" if t.kind != "end" else f"expected {wanted} but the text ends")

    def at_words(self, words: tuple[str, ...], k: int = 0) -> bool:
        return all(self.peek(k + j).upper == w for j, w in enumerate(words))

    def take_words(self, *words: str) -> bool:
        if self.at_words(words):
            self.i += len(words)
            return True
        return False

    def kw(self, role: str) -> bool:
        return self.take_words(*self.words[role])

    def at_kw(self, role: str, k: int = 0) -> bool:
        return self.at_words(self.words[role], k)

    def need_kw(self, role: str) -> None:
        if not self.kw(role):
            raise self.fail(" ".join(self.words[role]))

    def op(self, text: str) -> bool:
        if self.peek().kind == "op" and self.peek().text == text:
            self.i += 1
            return True
        return False

    def at_op(self, text: str, k: int = 0) -> bool:
        return self.peek(k).kind == "op" and self.peek(k).text == text

    def need_op(self, text: str) -> None:
        if not self.op(text):
            raise self.fail(repr(text))

    def role_op(self, role: str) -> bool:
        """Takes any spelling of an operator; spellings may be words."""
        for o in self.s.spellings(role):
            if o[0].isalpha():
                if self.take_words(*o.upper().split()):
                    return True
            elif self.op(o):
                return True
        return False

    def integer(self) -> int:
        t = self.peek()
        if t.kind != "number" or not t.text.isdigit():
            raise self.fail("a whole number")
        self.i += 1
        return int(t.text)

    def name(self) -> Name:
        t = self.peek()
        if t.kind == "quoted":
            self.i += 1
            return Name(t.text, True)
        if t.kind == "word" and t.upper not in self.reserved:
            self.i += 1
            return Name(t.text)
        raise self.fail("a name")

    # --- statements ---------------------------------------------------------------------------------------------

    def statement(self) -> Query:
        q = self.query()
        ended = bool(self.s.terminator) and self.op(self.s.terminator)
        if self.s.requires_terminator and not ended:
            raise self.fail(repr(self.s.terminator))
        if self.peek().kind != "end":
            raise self.fail("the end")
        return q

    def query(self) -> Query:
        ctes, recursive = [], False
        if self.kw("with"):
            recursive = self.take_words("RECURSIVE")
            while True:
                n = self.name()
                self.need_kw("as")
                self.need_op("(")
                ctes.append(Cte(n, self.query()))
                self.need_op(")")
                if not self.op(","):
                    break
        before = self.order() if self.s.order_by_position == "before_select" and self.at_kw("order_by") else ()
        body, top = self.set_ops()
        order = self.order() or before
        limit, offset, ties = self.limit()
        if top is not None:
            limit = top
        return Query(body, order, limit, offset, ties, tuple(ctes), recursive)

    def set_ops(self) -> tuple[Select | SetOp | Query, int | None]:
        first, top = self.operand()
        rest = []
        while True:
            kind = next((k for k in ("union", "intersect", "except") if self.at_kw(k)), None)
            if kind is None:
                break
            self.kw(kind)
            every = self.take_words("ALL")
            explicit = not every and self.kw("distinct")
            rest.append((kind, every or (not explicit and self.d.semantics.set_op_default == "all"), self.operand()[0]))
        if not rest:
            return first, top
        if self.d.semantics.set_op_precedence == "except_intersect_tighter":
            # INTERSECT and EXCEPT first, left to right; UNIONs between what they leave
            groups, unions = [first], []
            for kind, every, right in rest:
                if kind == "union":
                    unions.append(every)
                    groups.append(right)
                else:
                    groups[-1] = SetOp(kind, groups[-1], right, every)
            out = groups[0]
            for every, right in zip(unions, groups[1:], strict=True):
                out = SetOp("union", out, right, every)
            return out, None
        out = first
        for kind, every, right in rest:
            out = SetOp(kind, out, right, every)
        return out, None

    def operand(self) -> tuple[Select | Query, int | None]:
        if self.at_op("("):
            self.need_op("(")
            q = self.query()
            self.need_op(")")
            return q, None
        return self.select()

    def select(self) -> tuple[Select, int | None]:
        self.need_kw("select")
        distinct = self.kw("distinct")
        if not distinct:
            self.take_words("ALL")
        top = None
        if self.s.limit_syntax == "top_n" and self.take_words("TOP"):
            top = self.integer()
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
        self.need_kw("from")
        source, joins = self.table(), []
        while (j := self.join()) is not None:
            joins.append(j)
        where = self.expr() if self.kw("where") else None
        group: list[Node] = []
        if self.kw("group_by"):
            group = self.exprs()
        having = self.expr() if self.kw("having") else None
        qualify = self.expr() if self.s.keyword("limit") != ("QUALIFY",) and self.take_words("QUALIFY") else None
        return Select(tuple(items), source, tuple(joins), where, tuple(group), having, qualify, distinct), top

    def wild(self) -> bool:
        return self.op(self.s.wildcard)

    def item(self) -> Item:
        if self.wild():
            return Item(Star())
        if self.peek().kind in ("word", "quoted") and self.at_op(".", 1) and self.at_op(self.s.wildcard, 2):
            n = self.name()
            self.i += 2
            return Item(Star(n))
        e = self.expr()
        if self.kw("as"):
            return Item(e, self.name())
        return Item(e)

    def table(self) -> Table | Derived:
        lateral = self.take_words("LATERAL") if self.at_op("(", 1) else False
        if self.op("("):
            q = self.query()
            self.need_op(")")
            return Derived(q, self.alias(), lateral)
        return Table(self.name(), self.alias())

    def alias(self) -> Name | None:
        if self.kw("as"):
            return self.name()
        t = self.peek()
        if t.kind == "quoted" or (t.kind == "word" and t.upper not in self.reserved and not any(self.at_kw(r) for r in KEYWORDS)):
            if self.s.limit_syntax == "limit_offset" or t.upper not in ("FETCH", "OFFSET"):
                return self.name()
        return None

    def join(self) -> Join | None:
        kind = None
        for k in ("left", "right", "full", "cross"):
            words = self.words[f"join_{k}"]
            if self.at_words(words):
                self.i += len(words)
                kind = k
            elif k != "cross" and words[0] == k.upper() and self.at_words((words[0], "OUTER", *words[1:])):
                self.i += len(words) + 1
                kind = k
            elif k == "left" and words == ("LEFT", "JOIN"):
                for semi in ("SEMI", "ANTI"):
                    if self.take_words("LEFT", semi, "JOIN"):
                        kind = semi.lower()
            if kind:
                break
        if kind is None:
            inner = self.words["join_inner"]
            if self.at_words(inner) or self.at_words(("INNER", *inner)):
                self.i += len(inner) + (not self.at_words(inner))
                kind = "inner"
        if kind is None:
            return None
        right, on, using = self.table(), None, ()
        if self.take_words("ON"):
            on = self.expr()
        elif self.take_words("USING"):
            self.need_op("(")
            using = [self.name()]
            while self.op(","):
                using.append(self.name())
            self.need_op(")")
        if kind != "cross" and on is None and not using and not (isinstance(right, Derived) and right.lateral):
            raise self.fail("ON or USING")
        return Join(kind, right, on, tuple(using))

    def order(self) -> tuple[OrderKey, ...]:
        if not self.kw("order_by"):
            return ()
        keys = [self.order_key()]
        while self.op(","):
            keys.append(self.order_key())
        return tuple(keys)

    def order_key(self) -> OrderKey:
        e = self.expr()
        down = False
        if self.take_words("DESC"):
            down = True
        else:
            self.take_words("ASC")
        nulls = "first" if self.kw("nulls_first") else "last" if self.kw("nulls_last") else None
        return OrderKey(e, down, nulls)

    def limit(self) -> tuple[int | None, int, bool]:
        style, limit, offset, ties = self.s.limit_syntax, None, 0, False
        if style == "offset_fetch":
            if self.take_words("OFFSET"):
                offset = self.integer()
                self.take_words("ROWS") or self.take_words("ROW")
            own = self.s.keyword("limit")
            if self.take_words("FETCH", "NEXT") or self.take_words("FETCH", "FIRST") or (own != ("LIMIT",) and self.take_words(*own)):
                limit = self.integer()
                if not (self.take_words("ROWS") or self.take_words("ROW")):
                    raise self.fail("ROWS")
                ties = self.take_words("WITH", "TIES")
                if not ties and not self.take_words("ONLY"):
                    raise self.fail("ONLY")
            return limit, offset, ties
        own = self.words["limit"]
        if style == "limit_offset":
            found = self.take_words(*own)
        elif style == "head_n":
            self.op("|")
            found = self.take_words("HEAD") or (own != ("LIMIT",) and self.take_words(*own))
        else:
            default = {"top_n": "TOP", "sample_n": "SAMPLE"}[style]
            found = self.take_words(*own) if own != ("LIMIT",) else self.take_words(default)
        if found:
            limit = self.integer()
            ties = self.take_words("WITH", "TIES")
            if self.take_words("OFFSET"):
                offset = self.integer()
        elif style == "limit_offset" and self.take_words("OFFSET"):
            offset = self.integer()
        return limit, offset, ties

    # --- expressions --------------------------------------------------------------------------------------------

    def exprs(self) -> list[Node]:
        out = [self.expr()]
        while self.op(","):
            out.append(self.expr())
        return out

    def expr(self) -> Node:
        e = self.conjunction()
        while self.take_words("OR"):
            e = Binary("or", e, self.conjunction())
        return e

    def conjunction(self) -> Node:
        e = self.negation()
        while self.take_words("AND"):
            e = Binary("and", e, self.negation())
        return e

    def negation(self) -> Node:
        if self.kw("not"):
            return Unary("not", self.negation())
        return self.comparison()

    def comparison(self) -> Node:
        e = self.additive()
        while True:
            if self.d.semantics.null_safe_eq_supported and self.role_op("null_safe_eq"):
                e = Binary("null_safe_eq", e, self.additive())
            elif self.at_kw("is"):
                self.kw("is")
                negated = self.kw("not")
                if self.take_words("DISTINCT", "FROM"):
                    if not self.s.spellings("null_safe_eq") or not self.d.semantics.null_safe_eq_supported:
                        raise ParseError("this dialect has no null-safe comparison")
                    e = Binary("null_safe_eq" if negated else "null_safe_neq", e, self.additive())
                elif self.kw("null") or self.take_words(self.s.null_literal.upper()):
                    e = IsNull(e, negated)
                else:
                    raise self.fail(" ".join(self.words["null"]))
            elif (role := next((r for r in _COMPARISONS[1:] if self.role_op(r)), None)) is not None:
                e = Binary(role, e, self.additive())
            else:
                n = len(self.words["not"]) if self.at_kw("not") else 0
                role = next((r for r in ("between", "in", "like", "ilike") if self.at_kw(r, n)), None)
                if role is None:
                    return e
                self.i += n
                self.kw(role)
                e = self.tail(role, e, bool(n))

    def tail(self, role: str, e: Node, negated: bool) -> Node:
        if role == "between":
            low = self.additive()
            if not self.take_words("AND"):
                raise self.fail("AND")
            return Between(e, low, self.additive(), negated)
        if role == "in":
            self.need_op("(")
            if self.at_query():
                out: Node = InQuery(e, self.query(), negated)
            else:
                out = InList(e, () if self.at_op(")") else tuple(self.exprs()), negated)
            self.need_op(")")
            return out
        if role == "ilike" and not self.d.semantics.ilike_supported:
            raise ParseError("this dialect has no " + " ".join(self.words["ilike"]))
        return Like(e, self.additive(), role == "ilike", negated)

    def at_query(self) -> bool:
        return self.at_kw("select") or self.at_kw("with")

    def additive(self) -> Node:
        e = self.multiplicative()
        while True:
            if self.role_op("concat"):
                # where one spelling serves both, the operands' types decide
                e = Binary("add_or_concat" if set(self.s.spellings("concat")) & set(self.s.spellings("add")) else "concat", e, self.multiplicative())
            elif self.role_op("add"):
                e = Binary("add_or_concat" if self.d.semantics.string_concat_op == "+" else "add", e, self.multiplicative())
            elif self.role_op("sub"):
                e = Binary("sub", e, self.multiplicative())
            else:
                return e

    def multiplicative(self) -> Node:
        e = self.unary()
        while True:
            role = next((r for r in ("mul", "div", "mod") if self.role_op(r)), None)
            if role is None:
                return e
            e = Binary(role, e, self.unary())

    def unary(self) -> Node:
        if self.role_op("sub"):
            e = self.unary()
            return Lit(-e.value, e.kind) if isinstance(e, Lit) and e.kind in ("INT", "FLOAT") else Unary("neg", e)
        if self.role_op("add"):
            return Unary("pos", self.unary())
        e = self.primary()
        while self.s.cast_syntax == "double_colon" and self.op("::"):
            e = Cast(e, self.type_name())
        return e

    def primary(self) -> Node:
        t = self.peek()
        if t.kind == "number":
            self.i += 1
            return Lit(int(t.text), "INT") if t.text.isdigit() else Lit(float(t.text), "FLOAT")
        if t.kind == "string":
            self.i += 1
            return Lit(t.text, "TEXT")
        if self.op("("):
            if self.at_query():
                out: Node = Scalar(self.query())
            else:
                out = self.expr()
            self.need_op(")")
            return out
        if self.kw("case"):
            return self.case()
        if self.at_kw("exists") and self.at_op("(", len(self.words["exists"])):
            self.kw("exists")
            self.need_op("(")
            q = self.query()
            self.need_op(")")
            return Exists(q)
        for words in dict.fromkeys((self.words["cast"], ("CAST",), ("TRY_CAST",), ("CONVERT",))):
            if self.at_words(words) and self.at_op("(", len(words)) and (words in (self.words["cast"], ("TRY_CAST",)) or (words == ("CONVERT",) and self.s.cast_syntax == "convert_fn")):
                self.i += len(words) + 1
                return self.cast()
        if self.s.cast_syntax == "as_fn" and t.upper == "AS" and self.at_op("(", 1):
            self.i += 2
            return self.cast()
        if t.kind == "word":
            if self.take_words(self.s.null_literal.upper()) or self.kw("null"):
                return Lit(None, "NULL")
            if t.upper in ("TRUE", "FALSE"):
                self.i += 1
                return Lit(t.upper == "TRUE", "BOOL")
            if t.upper in ("DATE", "TIMESTAMP") and self.peek(1).kind == "string":
                self.i += 2
                return Lit(self.t[self.i - 1].text, t.upper)
            if self.at_op("(", 1):
                return self.call()
        first = self.name()
        if self.at_op(".") and self.peek(1).kind in ("word", "quoted"):
            self.i += 1
            t = self.peek()
            self.i += 1
            return Col(Name(t.text, t.kind == "quoted"), first)
        return Col(first)

    def case(self) -> Case:
        subject = None if self.at_kw("when") else self.expr()
        branches, otherwise = [], None
        while self.kw("when"):
            test = self.expr()
            self.need_kw("then")
            branches.append((Binary("eq", subject, test) if subject is not None else test, self.expr()))
        if not branches:
            raise self.fail(" ".join(self.words["when"]))
        if self.kw("else"):
            otherwise = self.expr()
        self.need_kw("end")
        return Case(tuple(branches), otherwise)

    def cast(self) -> Cast:
        e = self.expr()
        if not (self.kw("as") or (self.s.cast_syntax in ("convert_fn", "as_fn") and self.op(","))):
            raise self.fail(" ".join(self.words["as"]))
        kind = self.type_name()
        self.need_op(")")
        return Cast(e, kind)

    def type_name(self) -> str:
        t = self.peek()
        if t.upper not in TYPES:
            raise self.fail("a type name")
        self.i += 1
        self.take_words("PRECISION")
        if self.op("("):
            self.integer()
            if self.op(","):
                self.integer()
            self.need_op(")")
        return TYPES[t.upper]

    def call(self) -> Call:
        name = self.peek().upper
        self.i += 2
        star = distinct = False
        args: list[Node] = []
        if (self.at_op(self.s.wildcard) or self.at_op("*")) and self.at_op(")", 1):
            self.i += 1
            star = True
        elif name == "EXTRACT" and self.at_words((self.words["from"][0],), 1):
            args = [Lit(self.peek().text, "TEXT")]
            self.i += 1
            self.need_kw("from")
            args.append(self.expr())
        elif not self.at_op(")"):
            distinct = self.kw("distinct")
            args = self.exprs()
        valued = name in ("FIRST_VALUE", "LAST_VALUE", "LAG", "LEAD")
        ignore = valued and self.take_words("IGNORE", "NULLS")
        self.need_op(")")
        ignore = ignore or (valued and self.take_words("IGNORE", "NULLS"))
        if valued and not ignore:
            self.take_words("RESPECT", "NULLS")
        where = over = None
        if self.at_words(("FILTER",)) and self.at_op("(", 1):
            self.i += 2
            self.need_kw("where")
            where = self.expr()
            self.need_op(")")
        if self.take_words("OVER"):
            over = self.over()
        return Call(name, tuple(args), star, distinct, where, over, ignore)

    def over(self) -> Over:
        self.need_op("(")
        partition: list[Node] = []
        if self.take_words("PARTITION", "BY"):
            partition = self.exprs()
        order, frame = self.order(), None
        unit = next((u for u in ("ROWS", "RANGE", "GROUPS") if self.take_words(u)), None)
        if unit:
            if self.kw("between"):
                start = self.bound()
                if not self.take_words("AND"):
                    raise self.fail("AND")
                frame = Frame(unit.lower(), start, self.bound())
            else:
                frame = Frame(unit.lower(), self.bound(), ("current", None))
        self.need_op(")")
        return Over(tuple(partition), order, frame)

    def bound(self) -> tuple[str, int | None]:
        if self.take_words("UNBOUNDED", "PRECEDING"):
            return ("unbounded_preceding", None)
        if self.take_words("UNBOUNDED", "FOLLOWING"):
            return ("unbounded_following", None)
        if self.take_words("CURRENT", "ROW"):
            return ("current", None)
        n = self.integer()
        if self.take_words("PRECEDING"):
            return ("preceding", n)
        if self.take_words("FOLLOWING"):
            return ("following", n)
        raise self.fail("PRECEDING or FOLLOWING")


def parse(sql: str, dialect: Dialect) -> Query:
    if not sql.strip():
        raise ParseError("the query is empty")
    return Parser(sql, dialect).statement()
