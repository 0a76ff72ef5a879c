"""Policies and protected sets that several queries start from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binding as B
from ..operators import profile as P
from ..operators.protect import Protected, protect, protect_related
from ..policy import PolicyBuilder
from ..sources.rows import ROW

BALANCE_EDGES = (-1000, 0, 5000, 10000)
LOOSE = "controlled_pseudonymisation"


def customer_policy(source, k: int = 5, spare: tuple[str, ...] = ()):
    return (
        PolicyBuilder(k)
        .key("c_custkey")
        .drop("c_name", "direct_identifier")
        .code("c_nationkey", P.categories(source, "c_nationkey"))
        .code("c_mktsegment", [*P.categories(source, "c_mktsegment"), *spare])
        .bins("c_acctbal", BALANCE_EDGES)
        .build()
    )


def orders_policy(source, k: int = 5, numbers: bool = False):
    b = (
        PolicyBuilder(k)
        .drop("o_orderkey")
        .key("o_custkey")
        .keep("o_orderstatus", P.categories(source, "o_orderstatus"))
        .code("o_orderpriority", P.categories(source, "o_orderpriority"))
        .drop("o_orderdate")
    )
    return (b.numeric("o_totalprice", 0, 1_000_000) if numbers else b.drop("o_totalprice")).build()


def protected_customer(c, k: int = 5) -> tuple:
    source = c.kept("customer")
    p = protect(source, customer_policy(source, k), c.ws, profile=LOOSE)
    return source, p


def bound_customer(c) -> tuple:
    source, p = protected_customer(c)
    B.bind_source(p.keymap, {"table": source})
    return source, p


def related(c, k: int = 5, numbers: bool = False, editable: bool = False) -> tuple[dict, Protected]:
    """Customers and their orders, linked by customer."""
    sources = {"customer": c.kept("customer"), "orders": c.kept("orders")}
    policies = {
        "customer": customer_policy(sources["customer"], k),
        "orders": orders_policy(sources["orders"], k, numbers),
    }
    fields = {"customer": [], "orders": ["o_orderstatus", "o_orderpriority", "o_totalprice"]} if editable else None
    p = protect_related(sources, policies, c.ws, profile=LOOSE, editable=fields)
    B.bind_source(p.keymap, sources)
    return sources, p


def returned(p: Protected, name: str = "table", **new):
    """Protected rows as they come back, numbered, with new result columns."""
    columns = p.keymap.protected_columns(name)
    return p.stages[name].select(*columns, *[v.alias(n) for n, v in new.items()], F.col(ROW))
