"""Binds a syntax tree to DataFrames.

Every relation's columns get names of their own on entry, so that joins, self joins and correlated queries never clash;
names that users see return at the outermost select. A block is bound clause by clause: FROM, WHERE, aggregation, HAVING,
windows, QUALIFY, DISTINCT, ORDER BY, LIMIT. Nothing runs while binding, but for recursion, whose rounds do. Catalyst sees one
declarative plan.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Dialect
from ..errors import BindError, RunError
from ..functions.library import AGGREGATES, WINDOW_ONLY, Library
from ..operators.semantics import SPARK_TYPE, Bound, Semantics, common_kind, kind_of, to_kind
from ..sql import tree as t
from .store import store

_RESOLVED = t.Name("\0")
MAX_ROUNDS = 10_000


@dataclass
class ScopeCol:
    table: t.Name | None
    name: str
    internal: str
    kind: str
    hidden: bool = False  # reachable by its table's name only


@dataclass
class Relation:
    """A DataFrame under internal column names, and the names that users know."""

    df: DataFrame
    cols: list[ScopeCol]


@dataclass
class Context:
    """Where an expression is bound: its scope, what stands for aggregates, keys and windows, and the query around it."""

    cols: list[ScopeCol]
    ready: dict = field(default_factory=dict)  # canonical expression -> Bound
    grouped: bool = False
    parent: Context | None = None
    correlated: bool = False  # an expression bound here named a column of the query around it


class Binder:
    def __init__(self, spark, dialect: Dialect, catalog: Callable[[str], DataFrame | None], functions: dict | None = None, operators: dict | None = None, effects: dict | None = None, max_recursive_rows: int | None = None):
        self.spark, self.d, self.c = spark, dialect, dialect.semantics
        self.max_recursive_rows = max_recursive_rows
        self.scalar_body: t.Select | None = None  # of the scalar query being bound
        self.catalog = catalog
        self.s = Semantics(self.c, effects)
        aliases = {k: list(v) if not isinstance(v, str) else [v] for k, v in {**dialect.surface.function_aliases, **self.c.function_aliases}.items()}
        self.lib = Library(self.s, aliases, functions, operators)
        self.count = itertools.count()

    def fresh(self, hint: str = "c") -> str:
        return f"{hint}{next(self.count)}__"

    # --- names --------------------------------------------------------------------------------------------------

    def shown(self, n: t.Name) -> str:
        if n.quoted or self.c.identifier_case_fold == "preserve":
            return n.text
        return n.text.lower() if self.c.identifier_case_fold == "lower" else n.text.upper()

    def same(self, asked: t.Name, have: str) -> bool:
        if asked.quoted and self.c.quoted_identifiers_case_sensitive:
            return asked.text == have
        return asked.text.lower() == have.lower()

    def find(self, col: t.Col, cols: list[ScopeCol]) -> ScopeCol | None:
        hits = [c for c in cols if self.same(col.name, c.name) and (not c.hidden if col.table is None else c.table is not None and self.same(col.table, c.table.text))]
        if len({h.internal for h in hits}) > 1:
            raise BindError(f"{(col.table.text + '.') if col.table else ''}{col.name.text} is ambiguous")
        return hits[0] if hits else None

    def canonical(self, node, cols: list[ScopeCol]):
        def change(n):
            if isinstance(n, t.Col) and n.table != _RESOLVED:
                try:
                    hit = self.find(n, cols)
                except BindError:
                    hit = None
                return t.Col(t.Name(hit.internal), _RESOLVED) if hit else n
            if isinstance(n, t.Call):
                return t.Call(self.lib.canonical(n.name), n.args, n.star, n.distinct, n.where, n.over, n.ignore_nulls)
            return n

        return t.rebuild(node, change)

    # --- queries ------------------------------------------------------------------------------------------------

    def query(self, q: t.Query, env: dict[str, Relation], parent: Context | None = None) -> Relation:
        env = dict(env)
        for cte in q.ctes:
            recursive = q.recursive and self.mentions(cte)
            env[cte.name.text.lower()] = self.recursion(cte, env) if recursive else self.query(cte.query, env, parent)
        if isinstance(q.body, t.Select):
            return self.select(q.body, q, env, parent)
        out = self.body(q.body, env, parent)
        if q.order or q.limit is not None or q.offset:
            ctx = Context(out.cols, parent=parent)
            keys = []
            for k in q.order:
                b = self.expr(k.expr, ctx, env)
                keys.append((b.col, k.descending, k.nulls))
            out = Relation(self.ordered(out.df, keys, q), out.cols)
        return out

    def body(self, b, env: dict, parent: Context | None) -> Relation:
        if isinstance(b, t.Select):
            return self.select(b, t.Query(b), env, parent)
        if isinstance(b, t.Query):
            return self.query(b, env, parent)
        left, right = self.body(b.left, env, parent), self.body(b.right, env, parent)
        if len(left.cols) != len(right.cols):
            raise BindError(f"{b.kind} of {len(left.cols)} and {len(right.cols)} columns")
        kinds = [common_kind([x.kind, y.kind]) for x, y in zip(left.cols, right.cols, strict=True)]
        names = [self.fresh() for _ in kinds]
        x, y = (r.df.select(*(to_kind(Bound(F.col(c.internal), c.kind), k).alias(n) for c, k, n in zip(r.cols, kinds, names, strict=True))) for r in (left, right))
        if b.kind == "union":
            df = x.union(y) if b.all else x.union(y).distinct()
        elif b.kind == "intersect":
            df = x.intersectAll(y) if b.all else x.intersect(y)
        else:
            df = x.exceptAll(y) if b.all else x.subtract(y)
        return Relation(df, [ScopeCol(None, c.name, n, k) for c, n, k in zip(left.cols, names, kinds, strict=True)])

    @staticmethod
    def mentions(cte: t.Cte) -> bool:
        return any(isinstance(n, t.Table) and n.name.text.lower() == cte.name.text.lower() for n in t.walk(cte.query.body, into_queries=True))

    def recursion(self, cte: t.Cte, env: dict) -> Relation:
        """Seed, then the step over the rows that were new in the last round, until there are none.

        UNION keeps distinct rows, UNION ALL all of them. Every round is a stored table, so plans stay short
        and a lost executor costs a re-read.
        """
        body = cte.query.body
        if not isinstance(body, t.SetOp) or body.kind != "union":
            raise BindError("a recursive query is a seed UNION [ALL] a step")
        seed = self.body(body.left, env, None)
        names = [self.fresh("r") for _ in seed.cols]

        def aligned(r: Relation) -> DataFrame:
            if len(r.cols) != len(seed.cols):
                raise BindError("seed and step differ in width")
            return r.df.select(*(to_kind(Bound(F.col(c.internal), c.kind), k.kind).cast(SPARK_TYPE.get(k.kind, "string")).alias(n) for c, k, n in zip(r.cols, seed.cols, names, strict=True)))

        cols = [ScopeCol(None, c.name, n, c.kind if c.kind != "NULL" else "TEXT") for c, n in zip(seed.cols, names, strict=True)]
        new, rows = store(aligned(seed) if body.all else aligned(seed).distinct())
        every = new
        for _ in range(MAX_ROUNDS):
            step = aligned(self.body(body.right, {**env, cte.name.text.lower(): Relation(new, cols)}, None))
            if not body.all:
                match = [F.col(f"n.{n}").eqNullSafe(F.col(f"o.{n}")) for n in names]
                step = step.distinct().alias("n").join(every.alias("o"), match, "left_anti")
            new, n = store(step)
            if not n:
                return Relation(every, cols)
            rows += n
            if self.max_recursive_rows is not None and rows > self.max_recursive_rows:
                raise RunError(f"recursion made over {self.max_recursive_rows} rows")
            every = every.union(new)
        raise RunError(f"recursion did not end in {MAX_ROUNDS} rounds")

    # --- FROM ---------------------------------------------------------------------------------------------------

    def source(self, s, env: dict, ctx: Context | None) -> Relation:
        if isinstance(s, t.Derived):
            r = self.query(s.query, env, ctx)
            return Relation(r.df, [ScopeCol(s.alias, c.name, c.internal, c.kind) for c in r.cols])
        label = s.alias or s.name
        r = env.get(s.name.text.lower())
        if r is not None:
            names = [self.fresh() for _ in r.cols]
            df = r.df.select(*(F.col(c.internal).alias(n) for c, n in zip(r.cols, names, strict=True)))
            return Relation(df, [ScopeCol(label, c.name, n, c.kind) for c, n in zip(r.cols, names, strict=True)])
        df = self.catalog(s.name.text)
        if df is None:
            raise BindError(f"there is no table {s.name.text}")
        cols = []
        out = []
        for f in df.schema.fields:
            n, kind = self.fresh(), kind_of(f.dataType)
            col = F.col(f"`{f.name}`")
            if kind in ("INT", "FLOAT") and f.dataType.simpleString() != SPARK_TYPE[kind]:
                pass  # narrow numbers stay as they are stored; arithmetic widens them
            out.append(col.alias(n))
            cols.append(ScopeCol(label, f.name, n, kind))
        return Relation(df.select(*out), cols)

    def joined(self, left: Relation, j: t.Join, env: dict, parent: Context | None) -> Relation:
        lateral = isinstance(j.right, t.Derived) and j.right.lateral
        right = self.source(j.right, env, Context(left.cols, parent=parent) if lateral else parent)
        cols = left.cols + right.cols
        if lateral:
            cond = self.predicate(j.on, Context(cols, parent=parent), env) if j.on is not None else None
            df = left.df.lateralJoin(right.df, cond, "left" if j.kind == "left" else "inner")
            return Relation(df, cols)
        if j.kind == "cross":
            return Relation(left.df.crossJoin(right.df), cols)
        how = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}[j.kind]
        if not j.using:
            df = left.df.join(right.df, self.predicate(j.on, Context(cols, parent=parent), env), how)
            return Relation(df, left.cols if j.kind in ("semi", "anti") else cols)
        pairs = []
        for n in j.using:
            a, b = (self.find(t.Col(n), r.cols) for r in (left, right))
            if a is None or b is None:
                raise BindError(f"USING column {n.text} is not on both sides")
            pairs.append((n, a, b))
        cond = None
        for _, a, b in pairs:
            c = self.s.compare("eq", Bound(F.col(a.internal), a.kind), Bound(F.col(b.internal), b.kind)).col
            cond = c if cond is None else cond & c
        df = left.df.join(right.df, cond, how)
        if j.kind in ("semi", "anti"):
            return Relation(df, left.cols)
        merged, gone = [], set()
        for n, a, b in pairs:
            gone |= {a.internal, b.internal}
            if j.kind == "full":
                m = self.fresh()
                df = df.withColumn(m, F.coalesce(F.col(a.internal), F.col(b.internal)))
                merged.append(ScopeCol(None, a.name, m, a.kind))
            else:
                side = b if j.kind == "right" else a
                merged.append(ScopeCol(None, a.name, side.internal, side.kind))
        rest = [ScopeCol(c.table, c.name, c.internal, c.kind, c.hidden or c.internal in gone) for c in cols]
        return Relation(df, merged + rest)

    # --- SELECT -------------------------------------------------------------------------------------------------

    def star(self, item: t.Star, cols: list[ScopeCol]) -> list[tuple[str, t.Node]]:
        out, seen = [], set()
        for c in cols:
            if item.table is not None:
                if c.table is None or not self.same(item.table, c.table.text):
                    continue
            elif c.hidden or c.name.lower() in seen:
                continue  # the first of equal names wins
            seen.add(c.name.lower())
            out.append((c.name, t.Col(t.Name(c.internal), _RESOLVED)))
        if not out:
            raise BindError(f"there are no columns for {item.table.text if item.table else ''}*")
        return out

    def select(self, s: t.Select, q: t.Query, env: dict, parent: Context | None) -> Relation:
        rel = self.source(s.source, env, parent)
        for j in s.joins:
            rel = self.joined(rel, j, env, parent)
        base = Context(rel.cols, parent=parent)
        df = rel.df
        if s.where is not None:
            if any(self.is_aggregate(n) for n in t.walk(s.where)):
                raise BindError("an aggregate stands in WHERE")
            df = df.where(self.predicate(s.where, base, env))

        items: list[tuple[str, t.Node]] = []
        for it in s.items:
            if isinstance(it.expr, t.Star):
                items += self.star(it.expr, rel.cols)
            elif it.alias is not None:
                items.append((self.shown(it.alias), it.expr))
            elif isinstance(it.expr, t.Col):
                items.append((self.shown(it.expr.name), it.expr))
            else:
                items.append(("_col", it.expr))
        aliases = {self.shown(it.alias).lower(): it.expr for it in s.items if it.alias is not None}

        def by_alias(e: t.Node, cols: list[ScopeCol]) -> t.Node:
            if isinstance(e, t.Col) and e.table is None and e.name.text.lower() in aliases and self.find(e, cols) is None:
                return aliases[e.name.text.lower()]
            return e

        group = [by_alias(g, rel.cols) if self.c.group_by_accepts_select_aliases else g for g in s.group]
        used = [e for _, e in items] + [s.having, s.qualify] + [k.expr for k in q.order]
        calls = [n for n in t.walk(tuple(x for x in used if x is not None)) if self.is_aggregate(n)]
        grouped = bool(group or calls or s.having is not None)
        ctx = base
        if grouped and group and base.correlated and s is self.scalar_body:
            df, ctx = self.only_group(df, group, calls, s, base, env)
        elif grouped:
            df, ctx = self.aggregate(df, group, calls, base, env)
            if s.having is not None:
                df = df.where(self.predicate(s.having, ctx, env))

        def order_expr(e: t.Node) -> t.Node:
            if isinstance(e, t.Col) and e.table is None and e.name.text.lower() in aliases:
                if grouped and self.canonical(e, rel.cols) in ctx.ready:
                    return e
                if grouped or self.find(e, rel.cols) is None:
                    return aliases[e.name.text.lower()]
            return e

        order = [(order_expr(k.expr), k) for k in q.order]
        roots = [e for _, e in items] + [e for e, _ in order] + ([s.qualify] if s.qualify is not None else [])
        qualify = t.rebuild(s.qualify, lambda n: by_alias(n, rel.cols)) if s.qualify is not None else None
        if qualify is not None:
            roots.append(qualify)
        for w in [n for n in t.walk(tuple(roots)) if isinstance(n, t.Call) and n.over is not None]:
            key = self.canonical(w, rel.cols)
            if key not in ctx.ready:
                df, b = self.window(df, w, ctx, env)
                if ctx is base:
                    ctx = Context(base.cols, dict(base.ready), False, parent)
                ctx.ready[key] = b
        if qualify is not None:
            df = df.where(self.predicate(qualify, ctx, env))

        outs, names = [], {}
        for name, e in items:
            b = self.expr(e, ctx, env)
            n = names.get(name.lower(), 0)
            names[name.lower()] = n + 1
            shown = name if not n else f"{name}_{n}"
            outs.append((ScopeCol(None, shown, self.fresh("o"), b.kind), b.col, self.canonical(e, rel.cols)))
        cols = [c for c, _, _ in outs]
        if s.distinct:
            df = df.select(*(x.alias(c.internal) for c, x, _ in outs)).distinct()
            keys = []
            for e, k in order:
                hit = next((c for c, _, can in outs if can == self.canonical(e, rel.cols)), None)
                if hit is None and isinstance(k.expr, t.Col):
                    hit = self.find(t.Col(k.expr.name), cols) if k.expr.table is None else None
                if hit is None:
                    raise BindError("with DISTINCT, ORDER BY must name a selected expression")
                keys.append((F.col(hit.internal), k.descending, k.nulls))
            return Relation(self.ordered(df, keys, q), cols)
        keys, hidden = [], []
        for e, k in order:
            hit = next((c for c, _, can in outs if can == self.canonical(e, rel.cols)), None)
            if hit is None:
                n = self.fresh("k")
                hidden.append(self.expr(e, ctx, env).col.alias(n))
            else:
                n = hit.internal
            keys.append((F.col(n), k.descending, k.nulls))
        df = df.select(*(x.alias(c.internal) for c, x, _ in outs), *hidden)
        df = self.ordered(df, keys, q)
        return Relation(df.select(*(c.internal for c in cols)) if hidden else df, cols)

    def ordered(self, df: DataFrame, keys: list[tuple[Column, bool, str | None]], q: t.Query) -> DataFrame:
        by = [self.s.order(c, down, nulls) for c, down, nulls in keys]
        if q.ties and q.limit is not None:
            if not by or q.offset:
                raise BindError("WITH TIES needs ORDER BY and no OFFSET")
            df = self.with_ties(df, keys, by, q.limit)
        if by:
            df = df.orderBy(*by)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None and not q.ties:
            df = df.limit(q.limit)
        return df

    def with_ties(self, df: DataFrame, keys: list, by: list[Column], n: int) -> DataFrame:
        """The first n rows and those that tie with the n-th: a top-n finds the n-th row's keys, and all rows up to it pass."""
        if n == 0:
            return df.limit(0)
        names = [self.fresh("e") for _ in keys]
        top = df.select(*(c.alias(x) for (c, _, _), x in zip(keys, names, strict=True)))
        order = [self.s.order(F.col(x), down, nulls) for x, (_, down, nulls) in zip(names, keys, strict=True)]
        flip = []
        for x, (_, down, nulls) in zip(names, keys, strict=True):
            nulls = nulls or (self.c.null_order_default_desc if down else self.c.null_order_default_asc)
            flip.append(self.s.order(F.col(x), not down, "last" if nulls == "first" else "first"))
        edge = top.orderBy(*order).limit(n).orderBy(*flip).limit(1)
        cond, equal = F.lit(False), F.lit(True)
        for x, (c, down, nulls) in zip(names, keys, strict=True):
            first = (nulls or (self.c.null_order_default_desc if down else self.c.null_order_default_asc)) == "first"
            e = F.col(x)
            before = F.coalesce(c > e if down else c < e, F.lit(False)) | ((c.isNull() & e.isNotNull()) if first else (c.isNotNull() & e.isNull()))
            cond, equal = cond | (equal & before), equal & c.eqNullSafe(e)
        return df.join(F.broadcast(edge), cond | equal, "inner").drop(*names)  # one row

    # --- aggregation and windows --------------------------------------------------------------------------------

    def is_aggregate(self, n) -> bool:
        return isinstance(n, t.Call) and n.over is None and self.lib.canonical(n.name) in AGGREGATES

    def aggregate(self, df: DataFrame, group: list[t.Node], calls: list[t.Call], base: Context, env: dict) -> tuple[DataFrame, Context]:
        ready: dict = {}
        keys, aggs = [], []
        for g in group:
            b, n = self.expr(g, base, env), self.fresh("g")
            keys.append(b.col.alias(n))
            can = self.canonical(g, base.cols)
            if isinstance(g, t.Col) or self.c.select_resolves_through_group_by:
                ready[can] = Bound(F.col(n), b.kind)
        for call in calls:
            can = self.canonical(call, base.cols)
            if can not in ready:
                if any(self.is_aggregate(x) for x in t.walk((call.args, call.where) if call.where is not None else call.args)):
                    raise BindError("an aggregate stands inside an aggregate")
                b, n = self.aggregate_column(call, base, env), self.fresh("a")
                aggs.append(b.col.alias(n))
                ready[can] = Bound(F.col(n), b.kind)
        if not group:
            df = df.select(*(aggs or [F.count(F.lit(1)).alias(self.fresh("a"))]))  # select keeps a correlated block lazy, agg would not
        elif aggs:
            df = df.groupBy(*keys).agg(*aggs)
        else:
            df = df.select(*keys).distinct()
        return df, Context(base.cols, ready, True, base.parent)

    def only_group(self, df: DataFrame, group: list[t.Node], calls: list[t.Call], s: t.Select, base: Context, env: dict) -> tuple[DataFrame, Context]:
        """A correlated scalar query with GROUP BY has one group or none for each outer row, or it is an error.

        So it is one aggregate over the rows that correlate, which Catalyst can decorrelate: no row where there are none, and an
        error where the least and the greatest of the keys differ.
        """
        if s.having is not None:
            raise BindError("HAVING in a correlated scalar query with GROUP BY")
        keys = [self.expr(g, base, env) for g in group]
        names = [self.fresh("g") for _ in keys]
        both = F.struct(*(b.col.alias(f"k{i}") for i, b in enumerate(keys)))
        low, high, n = self.fresh("g"), self.fresh("g"), self.fresh("g")
        ready = {self.canonical(g, base.cols): Bound(F.col(x), b.kind) for g, x, b in zip(group, names, keys, strict=True)}
        aggs = [F.min(b.col).alias(x) for b, x in zip(keys, names, strict=True)] + [F.min(both).alias(low), F.max(both).alias(high), F.count(F.lit(1)).alias(n)]
        for call in calls:
            can = self.canonical(call, base.cols)
            if can not in ready:
                b, x = self.aggregate_column(call, base, env), self.fresh("a")
                aggs.append(b.col.alias(x))
                ready[can] = Bound(F.col(x), b.kind)
        one = F.when(F.col(low) == F.col(high), F.lit(True)).otherwise(F.raise_error(F.lit("a scalar query made more than one row")).cast("boolean"))
        return df.select(*aggs).where((F.col(n) > 0) & one), Context(base.cols, ready, True, base.parent)

    def aggregate_column(self, call: t.Call, ctx: Context, env: dict) -> Bound:
        name = self.lib.canonical(call.name)
        where = self.predicate(call.where, ctx, env) if call.where is not None else None
        keep = (lambda c: F.when(where, c)) if where is not None else (lambda c: c)
        if call.star or (name == "COUNT" and not call.args):
            if name != "COUNT":
                raise BindError(f"{name}(*) has no meaning")
            return Bound(F.count(keep(F.lit(1))), "INT")
        if len(call.args) != 1 and not (name == "GROUP_CONCAT" and len(call.args) == 2):
            raise BindError(f"{name} takes one argument")
        arg = self.expr(call.args[0], ctx, env)
        if name == "COUNT":
            if not call.distinct:
                return Bound(F.count(keep(arg.col)), "INT")
            n = F.count_distinct(keep(arg.col))
            if self.c.count_distinct_null == "included":
                null = (arg.col.isNull() & where if where is not None else arg.col.isNull()).cast("bigint")
                n = n + F.coalesce(F.max(null), F.lit(0))
            return Bound(n, "INT")
        if name in ("MIN", "MAX"):
            return Bound((F.min if name == "MIN" else F.max)(keep(arg.col)), arg.kind)
        if name == "GROUP_CONCAT":
            sep = self.expr(call.args[1], ctx, env).literal if len(call.args) == 2 else ","
            f = F.listagg_distinct if call.distinct else F.listagg
            return Bound(f(keep(arg.col.cast("string")), F.lit(str(sep))), "TEXT")
        if arg.kind in ("TEXT", "BOOL", "DATE", "TIMESTAMP"):
            if arg.kind != "TEXT":
                raise BindError(f"{name} of a {arg.kind}")
            arg = Bound(arg.col.try_cast("double"), "FLOAT")
        x = keep(to_kind(arg, arg.kind) if arg.kind == "FLOAT" else arg.col.cast("bigint"))
        if name == "SUM":
            return Bound(self.s.total(F.sum_distinct(x) if call.distinct else F.sum(x)), "INT" if arg.kind in ("INT", "NULL") else "FLOAT")
        if name == "AVG":
            if call.distinct:
                return Bound(F.try_divide(F.sum_distinct(x).cast("double"), F.count_distinct(x).cast("double")), "FLOAT")
            return Bound(F.avg(x), "FLOAT")
        return Bound((F.stddev_samp if name == "STDDEV" else F.var_samp)(x), "FLOAT")

    def window(self, df: DataFrame, w: t.Call, ctx: Context, env: dict) -> tuple[DataFrame, Bound]:
        name = self.lib.canonical(w.name)
        if name not in AGGREGATES and name not in WINDOW_ONLY:
            raise BindError(f"{w.name} is not a window function")
        if w.distinct:
            raise BindError("DISTINCT in a window function")
        partition = [self.expr(p, ctx, env).col for p in w.over.partition]
        keys = [(self.expr(k.expr, ctx, env).col, k) for k in w.over.order]
        order = [self.s.order(c, k.descending, k.nulls) for c, k in keys]
        spec = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
        args = [self.expr(a, ctx, env) for a in w.args]
        if name in AGGREGATES and not partition and not order and w.over.frame is None:
            # over the whole table: a row of its own, aggregated in parts, instead of all rows in one task
            plain, out = self.aggregate_window(name, w, args, ctx, env), self.fresh("w")
            one = df.select(plain.col.alias(out))
            return df.crossJoin(F.broadcast(one)), Bound(self.s.total(F.col(out)) if name == "SUM" else F.col(out), plain.kind)
        if name in ("RANK", "DENSE_RANK", "PERCENT_RANK", "CUME_DIST") and not order:
            b = Bound(F.lit(1).cast("bigint"), "INT") if "RANK" in name and name != "PERCENT_RANK" else Bound(F.lit(0.0 if name == "PERCENT_RANK" else 1.0), "FLOAT")
        elif name in ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "PERCENT_RANK", "CUME_DIST"):
            f = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank, "PERCENT_RANK": F.percent_rank, "CUME_DIST": F.cume_dist}.get(name)
            col = F.ntile(self.constant(args[0])) if name == "NTILE" else f()
            col = col.over(spec.orderBy(*(order or [F.lit(0)])))
            b = Bound(col, "FLOAT") if name in ("PERCENT_RANK", "CUME_DIST") else Bound(col.cast("bigint"), "INT")
        elif name in ("LAG", "LEAD"):
            if not order:
                raise BindError(f"{name} needs ORDER BY")
            n = self.constant(args[1]) if len(args) > 1 else 1
            if n < 0:
                raise BindError(f"{name} needs a distance of 0 or more")
            s, x, kind = spec.orderBy(*order), args[0].col, args[0].kind
            if len(args) > 2:
                kind = common_kind([args[0].kind, args[2].kind])
                x = to_kind(args[0], kind)
            if w.ignore_nulls and n:
                # Spark's own keeps the last n values that aren't NULL; a frame to the partition's end is gone through for each row
                value, default = self.fresh("v"), self.fresh("d")
                df = df.withColumns({value: x, default: to_kind(args[2], kind)} if len(args) > 2 else {value: x, default: F.lit(None)})
                col = F.expr(f"{name.lower()}(`{value}`, {n}, `{default}`) IGNORE NULLS").over(s)
            else:
                col = (F.lag if name == "LAG" else F.lead)(x, n).over(s)
                if len(args) > 2:  # only where there is no such row: a NULL that a row holds stays NULL
                    there = (F.row_number().over(s) > n) if name == "LAG" else (F.row_number().over(s) + n <= F.count(F.lit(1)).over(spec))
                    col = F.when(there, col).otherwise(to_kind(args[2], kind))
            args[0] = Bound(x, kind)
            b = Bound(col, args[0].kind)
        else:
            df, spec = self.framed(df, spec, w.over.frame, keys, order)
            if name == "FIRST_VALUE":
                b = Bound(F.first(args[0].col, ignorenulls=w.ignore_nulls).over(spec), args[0].kind)
            elif name == "LAST_VALUE":
                b = Bound(F.last(args[0].col, ignorenulls=w.ignore_nulls).over(spec), args[0].kind)
            else:
                plain = self.aggregate_window(name, w, args, ctx, env)
                b = Bound(plain.col.over(spec), plain.kind)
                if name == "SUM":
                    b = Bound(self.s.total(b.col), b.kind)
        out = self.fresh("w")
        return df.withColumn(out, b.col), Bound(F.col(out), b.kind)

    def aggregate_window(self, name: str, w: t.Call, args: list[Bound], ctx: Context, env: dict) -> Bound:
        where = self.predicate(w.where, ctx, env) if w.where is not None else None
        keep = (lambda c: F.when(where, c)) if where is not None else (lambda c: c)
        if w.star or not args:
            return Bound(F.count(keep(F.lit(1))), "INT")
        x = args[0]
        if name == "COUNT":
            return Bound(F.count(keep(x.col)), "INT")
        if name in ("MIN", "MAX"):
            return Bound((F.min if name == "MIN" else F.max)(keep(x.col)), x.kind)
        num = keep(x.col.cast("bigint") if x.kind in ("INT", "NULL") else x.col.cast("double"))
        if name == "SUM":
            return Bound(F.sum(num), "INT" if x.kind in ("INT", "NULL") else "FLOAT")
        return Bound({"AVG": F.avg, "STDDEV": F.stddev_samp, "VARIANCE": F.var_samp}[name](num), "FLOAT")

    def framed(self, df: DataFrame, spec, frame: t.Frame | None, keys: list, order: list[Column]):
        if frame is None:
            return df, self.s.default_frame(spec.orderBy(*order) if order else spec, bool(order))
        edge = {"unbounded_preceding": Window.unboundedPreceding, "unbounded_following": Window.unboundedFollowing, "current": Window.currentRow}
        at = lambda b: edge[b[0]] if b[0] in edge else (-b[1] if b[0] == "preceding" else b[1])
        start, end = at(frame.start), at(frame.end)
        if not order and frame.unit != "rows":
            raise BindError(f"{frame.unit.upper()} needs ORDER BY")
        if frame.unit == "groups":  # peers' number, then a range over it
            n = self.fresh("p")
            df = df.withColumn(n, F.dense_rank().over(spec.orderBy(*order)))
            return df, spec.orderBy(F.col(n)).rangeBetween(start, end)
        spec = spec.orderBy(*order) if order else spec
        return df, spec.rowsBetween(start, end) if frame.unit == "rows" else spec.rangeBetween(start, end)

    @staticmethod
    def constant(b: Bound) -> int:
        if not isinstance(b.literal, int):
            raise BindError("a whole number is needed")
        return b.literal

    # --- expressions --------------------------------------------------------------------------------------------

    def predicate(self, e: t.Node, ctx: Context, env: dict) -> Column:
        return self.s.truth(self.expr(e, ctx, env))

    def expr(self, e: t.Node, ctx: Context, env: dict) -> Bound:
        if ctx.ready:
            hit = ctx.ready.get(self.canonical(e, ctx.cols))
            if hit is not None:
                return hit
        return getattr(self, "_" + type(e).__name__.lower())(e, ctx, env)

    def _lit(self, e: t.Lit, ctx, env) -> Bound:
        if e.kind == "NULL":
            return Bound(F.lit(None), "NULL")
        if e.kind in ("DATE", "TIMESTAMP"):
            return Bound(F.lit(e.value).try_cast(SPARK_TYPE[e.kind]), e.kind, e.value)
        if e.kind == "INT" and not -(1 << 63) <= e.value < 1 << 63:
            return Bound(F.lit(float(Decimal(e.value))), "FLOAT", e.value)
        return Bound(F.lit(e.value).cast(SPARK_TYPE[e.kind]), e.kind, e.value)

    def _col(self, e: t.Col, ctx: Context, env) -> Bound:
        if e.table == _RESOLVED:
            c = next(c for c in ctx.cols if c.internal == e.name.text)
            if ctx.grouped:
                raise BindError(f"{c.name} is neither grouped nor aggregated")
            return Bound(F.col(c.internal), c.kind)
        depth, at = 0, ctx
        while at is not None:
            c = self.find(e, at.cols)
            if c is not None:
                ctx.correlated = ctx.correlated or depth > 0
                if at.grouped:
                    hit = at.ready.get(t.Col(t.Name(c.internal), _RESOLVED))
                    if hit is None:
                        raise BindError(f"{e.name.text} is neither grouped nor aggregated")
                    return Bound(hit.col.outer() if depth else hit.col, hit.kind)
                return Bound(F.col(c.internal).outer() if depth else F.col(c.internal), c.kind)
            at, depth = at.parent, depth + 1
        raise BindError(f"there is no column {(e.table.text + '.') if e.table else ''}{e.name.text}")

    def _unary(self, e: t.Unary, ctx, env) -> Bound:
        if e.op == "not":
            return Bound(~self.predicate(e.arg, ctx, env), "BOOL")
        b = self.expr(e.arg, ctx, env)
        return b if e.op == "pos" else Bound(-b.col, b.kind)

    def _binary(self, e: t.Binary, ctx, env) -> Bound:
        if e.op in ("and", "or"):
            a, b = self.predicate(e.left, ctx, env), self.predicate(e.right, ctx, env)
            return Bound(a & b if e.op == "and" else a | b, "BOOL")
        a, b = self.expr(e.left, ctx, env), self.expr(e.right, ctx, env)
        op = e.op
        if op == "add_or_concat":
            op = "concat" if "TEXT" in (a.kind, b.kind) else "add"
        elif op == "concat" and self.c.string_concat_op == "CONCAT_only":
            raise BindError("this dialect concatenates with CONCAT only")
        if op == "concat":
            return self.s.concat(a, b)
        if op in ("add", "sub", "mul", "div", "mod"):
            return self.s.arithmetic(op, a, b)
        return self.s.compare(op, a, b)

    def _isnull(self, e: t.IsNull, ctx, env) -> Bound:
        b = self.expr(e.arg, ctx, env)
        return Bound(b.col.isNotNull() if e.negated else b.col.isNull(), "BOOL")

    def _between(self, e: t.Between, ctx, env) -> Bound:
        x, low, high = (self.expr(n, ctx, env) for n in (e.arg, e.low, e.high))
        c = self.s.compare("gte", x, low).col & self.s.compare("lte", x, high).col
        return Bound(~c if e.negated else c, "BOOL")

    def _inlist(self, e: t.InList, ctx, env) -> Bound:
        if not e.items:
            return Bound(F.lit(e.negated), "BOOL")
        x, items = self.expr(e.arg, ctx, env), [self.expr(i, ctx, env) for i in e.items]
        if all(i.kind == x.kind and i.literal is not None for i in items) and x.kind in ("INT", "FLOAT", "TEXT") and "text_eq" not in self.s.effects:
            c = x.col.isin([i.literal for i in items])
        else:
            c = None
            for i in items:
                one = self.s.compare("eq", x, i).col
                c = one if c is None else c | one
        return Bound(~c if e.negated else c, "BOOL")

    def _inquery(self, e: t.InQuery, ctx, env) -> Bound:
        x, r = self.expr(e.arg, ctx, env), self.query(e.query, env, ctx)
        if len(r.cols) != 1:
            raise BindError("IN needs a query of one column")
        kind = common_kind([x.kind, r.cols[0].kind])
        inner = r.df.select(to_kind(Bound(F.col(r.cols[0].internal), r.cols[0].kind), kind).alias(self.fresh("i")))
        c = to_kind(x, kind).isin(inner)
        return Bound(~c if e.negated else c, "BOOL")

    def _exists(self, e: t.Exists, ctx, env) -> Bound:
        c = self.query(e.query, env, ctx).df.exists()
        return Bound(~c if e.negated else c, "BOOL")

    def _scalar(self, e: t.Scalar, ctx, env) -> Bound:
        outside, self.scalar_body = self.scalar_body, e.query.body
        try:
            r = self.query(e.query, env, ctx)
        finally:
            self.scalar_body = outside
        if len(r.cols) != 1:
            raise BindError("a scalar query has one column")
        return Bound(r.df.scalar(), r.cols[0].kind)

    def _like(self, e: t.Like, ctx, env) -> Bound:
        b = self.s.like(self.expr(e.arg, ctx, env), self.expr(e.pattern, ctx, env), e.insensitive)
        return Bound(~b.col, "BOOL") if e.negated else b

    def _case(self, e: t.Case, ctx, env) -> Bound:
        branches = [(self.predicate(c, ctx, env), self.expr(v, ctx, env)) for c, v in e.branches]
        other = self.expr(e.otherwise, ctx, env) if e.otherwise is not None else Bound(F.lit(None), "NULL")
        kind = common_kind([v.kind for _, v in branches] + [other.kind])
        out = None
        for c, v in branches:
            out = F.when(c, to_kind(v, kind)) if out is None else out.when(c, to_kind(v, kind))
        return Bound(out.otherwise(to_kind(other, kind)), kind)

    def _cast(self, e: t.Cast, ctx, env) -> Bound:
        return self.s.cast(self.expr(e.arg, ctx, env), e.kind)

    def _star(self, e: t.Star, ctx, env) -> Bound:
        raise BindError("* stands where an expression is needed")

    def _call(self, e: t.Call, ctx: Context, env) -> Bound:
        if e.over is not None:
            raise BindError(f"the window function {e.name} stands where none may")
        if self.is_aggregate(e):
            raise BindError(f"the aggregate {e.name} stands where none may")
        if e.where is not None:
            raise BindError(f"FILTER on {e.name}, which is not an aggregate")
        args = [self.expr(a, ctx, env) for a in e.args]
        return self.lib.scalar(e.name, args, lambda col: "OTHER")
