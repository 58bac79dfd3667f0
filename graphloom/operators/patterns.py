"""Property-graph pattern queries: each pattern is data, and two small compilers run it.

A pattern starts at a filtered node and walks hops; an optional hop is a left join with
the test of the target's labels inside. Outputs are names, sorted sets of names, edge
types, labels and distinct counts; the outputs that aren't aggregates are the group.
`run` gives a DataFrame, `sql` the text of the same question.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.store import stored


@dataclass(frozen=True)
class Hop:
    """From node `at` along edges of `types` (none: any type) to node `to` with any of `labels`."""

    at: str
    types: tuple[str, ...]
    to: str
    labels: tuple[str, ...] = ()
    optional: bool = True
    back: bool = False
    reach: int = 1


@dataclass(frozen=True)
class Pattern:
    start: str
    labels: tuple[str, ...]
    hops: tuple[Hop, ...]
    out: tuple[tuple[str, str, str], ...]  # (column, kind, node)
    order: tuple[tuple[str, bool], ...]  # (column, descending)
    limit: int | None
    filter_at: str = ""  # node whose name is searched, the start by default
    param: str = "entity"
    words: tuple[str, ...] = field(default=())  # further words that may match

    @property
    def searched(self) -> str:
        return self.filter_at or self.start


def _t(s: str) -> tuple[str, ...]:
    return tuple(s.split("|")) if s else ()


def hop(at: str, types: str, to: str, labels: str = "", must: bool = False, back: bool = False, reach: int = 1) -> Hop:
    return Hop(at, _t(types), to, _t(labels), not must, back, reach)


def _out(spec: str) -> tuple[tuple[str, str, str], ...]:
    """'column=kind(node), ...'; a bare 'column=node' is the node's name."""
    out = []
    for x in spec.split(", "):
        column, e = x.split("=")
        kind, _, node = e.rstrip(")").rpartition("(")
        out.append((column, kind or "name", node))
    return tuple(out)


def _order(spec: str) -> tuple[tuple[str, bool], ...]:
    return tuple((x.lstrip("-"), x[0] == "-") for x in spec.split(", ")) if spec else ()


def pattern(start, labels, hops, out, order, limit, **more) -> Pattern:
    return Pattern(start, _t(labels), tuple(hops), _out(out), _order(order), limit, **more)


P, D = "Person|Technician", "Date|Time"
#: The pattern library. Every order is completed by the remaining columns, so limits are total.
PATTERNS: dict[str, Pattern] = {
    "gp01_wo_maintenance": pattern(
        "asset", "", [hop("asset", "PERFORMED_ON", "wo", "", True, True), hop("wo", "ASSIGNED_TO", "person", "", True),
         hop("wo", "USED_PART|REQUIRES|INCLUDES", "part", "Part|Component"), hop("wo", "COMPLETED_ON|SCHEDULED_FOR", "date", D)],
        "asset_name=asset, work_order=wo, assigned_personnel=person, parts_used=set(part), work_dates=set(date), part_relationship=type(part), date_relationship=type(date)",
        "work_order", 15, param="asset"),
    "gp02_person_assignments": pattern(
        "person", P, [hop("person", "ASSIGNED_TO", "wo", "", True, True), hop("wo", "PERFORMED_ON", "asset", "", True),
         hop("wo", "USED_PART|REQUIRES", "part", "Part|Component"), hop("wo", "COMPLETED_ON|SCHEDULED_FOR", "date", D)],
        "personnel_name=person, work_order=wo, asset_worked_on=asset, parts_used=set(part), work_dates=set(date), total_work_orders=count(wo)",
        "-total_work_orders, work_order", 15, param="person"),
    "gp03_wo_details": pattern(
        "wo", "WorkOrder|Task|Activity", [hop("wo", "ASSIGNED_TO", "person", P), hop("wo", "PERFORMED_ON", "asset", "Equipment|Machine"),
         hop("wo", "USED_PART|REQUIRES|INCLUDES", "part", "Part|Component"), hop("wo", "HAS_TOTAL_COST|ESTIMATED_COST", "cost", "Cost|Value"),
         hop("wo", "COMPLETED_ON|SCHEDULED_FOR|ISSUED_ON", "date", D)],
        "work_order_name=wo, assigned_personnel=set(person), assets_affected=set(asset), parts_materials=set(part), costs=set(cost), important_dates=set(date)",
        "work_order_name", 10, param="work_order"),
    "gp04_asset_history": pattern(
        "asset", "", [hop("asset", "PERFORMED_ON", "wo", "", True, True), hop("wo", "ASSIGNED_TO", "person", P),
         hop("wo", "COMPLETED_ON|SCHEDULED_FOR", "date", D), hop("wo", "HAS_TOTAL_COST|ESTIMATED_COST", "cost", "Cost|Value")],
        "asset_name=asset, work_order=wo, technician=person, work_date=date, work_cost=cost, total_work_orders=count(wo)",
        "-work_date, work_order", 20, param="asset"),
    "gp05_wo_status": pattern(
        "wo", "WorkOrder|Task|Activity", [hop("wo", "APPROVED_BY", "approver", "Person|Manager"), hop("wo", "ASSIGNED_TO", "person", P),
         hop("wo", "PERFORMED_ON", "asset"), hop("wo", "HAS_STATUS|STATUS_OF", "status", "Status|State")],
        "work_order=wo, approved_by=approver, assigned_to=person, target_asset=asset, current_status=status",
        "work_order", 15, param="work_order", words=("work", "wo")),
    "gp06_wo_by_approver": pattern(
        "approver", "Person|Manager", [hop("approver", "APPROVED_BY", "wo", "", True, True), hop("wo", "ASSIGNED_TO", "person", P),
         hop("wo", "PERFORMED_ON", "asset"), hop("wo", "COMPLETED_ON|SCHEDULED_FOR", "date", D)],
        "approved_by=approver, work_order=wo, assigned_to=person, target_asset=asset, work_date=date, total_approved=count(wo)",
        "-work_date, work_order", 15, param="approver"),
    "gp07_asset_maintenance": pattern(
        "asset", "", [hop("asset", "ASSIGNED_TO|PERFORMED_BY|USED_IN|RELATED_TO", "work", "WorkOrder|Task|Activity|Service"),
         hop("work", "ASSIGNED_TO|PERFORMED_BY|OPERATED_BY", "person", "Person|Technician|Operator"),
         hop("work", "USED_PART|INCLUDES|REQUIRES", "part", "Part|Component|Material")],
        "asset_name=asset, maintenance_work=set(work), personnel=set(person), parts_materials=set(part), work_relationships=types(work)",
        "asset_name", 20, param="asset"),
    "gp08_cost": pattern(
        "item", "Invoice|Project|WorkOrder|Service", [hop("item", "HAS_TOTAL_COST|ESTIMATED_COST|RENTAL_COST|COST_OF_SERVICE", "cost", "Cost|Value|Amount"),
         hop("item", "BILLED_TO|INVOICED_FOR|ASSIGNED_TO|RELATED_TO", "party", "Company|Person|Vendor"),
         hop("item", "ISSUED_ON|COMPLETED_ON|SCHEDULED_FOR", "date", D)],
        "item_name=item, cost_breakdown=set(cost), associated_parties=set(party), relevant_dates=set(date)", "item_name", 15),
    "gp09_personnel": pattern(
        "person", "Person|Technician|Operator|Employee", [hop("person", "ASSIGNED_TO|PERFORMED_BY|OPERATED_BY|MANAGED_BY", "work", "WorkOrder|Task|Activity|Project"),
         hop("work", "PERFORMED_ON|USED_IN|RELATED_TO", "asset", "Equipment|Vehicle|Instrument|Machine"), hop("work", "COMPLETED_ON|SCHEDULED_FOR", "date", D)],
        "personnel_name=person, assigned_work=set(work), assets_worked_on=set(asset), work_dates=set(date), total_assignments=count(work)",
        "-total_assignments", 15, param="person"),
    "gp10_inventory": pattern(
        "item", "Part|Component|Material|SparePart|Inventory", [hop("item", "HAS_QUANTITY|STOCK_LEVEL|QUANTITY_USED", "quantity", "Value|Measurement|Integer"),
         hop("item", "LOCATED_AT|STORED_IN|LOCATED_IN", "place", "Location|Building|Site"), hop("item", "USED_IN|REQUIRED_FOR|PART_OF", "equipment", "Equipment|Vehicle|Machine")],
        "item_name=item, quantities=set(quantity), storage_locations=set(place), used_in_equipment=set(equipment)", "item_name", 20, param="item_type"),
    "gp11_location": pattern(
        "location", "Location|Building|Site|Facility", [hop("location", "LOCATED_AT|CONTAINS|HOUSES", "asset", "Equipment|Vehicle|Instrument"),
         hop("location", "PERFORMED_AT|SCHEDULED_AT", "activity", "Activity|Service|WorkOrder"), hop("location", "ASSIGNED_TO|MANAGED_BY", "person", P)],
        "location_name=location, assets=set(asset), activities=set(activity), personnel=set(person), asset_count=count(asset), activity_count=count(activity)",
        "-asset_count, -activity_count", 15, param="location"),
    "gp12_temporal": pattern(
        "date", D, [hop("date", "", "item", "", True, True), hop("item", "HAS_TOTAL_COST|ESTIMATED_COST|RENTAL_COST", "cost", "Cost|Value|Amount"),
         hop("item", "RELATED_TO|ASSIGNED_TO|PERFORMED_BY", "other", "Service|WorkOrder|Activity")],
        "item_name=item, time_period=date, costs=set(cost), associated_items=set(other), time_relationship=type(item)", "item_name", 20, param="time_period"),
    "gp13_hierarchy": pattern(
        "parent", "", [hop("parent", "CONTAINS|PART_OF|INCLUDES|LOCATED_IN", "child", "", reach=2), hop("child", "HAS_TOTAL_COST|ESTIMATED_COST", "cost", "Cost|Value|Amount")],
        "parent_entity=parent, child_entity=child, relationship_path=type(child), associated_costs=set(cost), parent_types=labels(parent), child_types=labels(child)",
        "child_entity", 20, param="parent"),
    "gp14_vendor": pattern(
        "vendor", "Company|Vendor|Supplier|Contractor", [hop("vendor", "PROVIDES|SUPPLIES|CONTRACTS", "service", "Service|WorkOrder"),
         hop("service", "COST_OF_SERVICE|HAS_TOTAL_COST|BILLED_TO", "cost", "Value|Invoice|Cost"), hop("service", "PERFORMED_AT|LOCATED_AT", "place", "Location|Site")],
        "vendor_name=vendor, services_provided=set(service), service_costs=set(cost), service_locations=set(place), service_count=count(service)",
        "-service_count", 15, param="vendor"),
    "gl01_entity_lookup": pattern("entity", "", [], "name=entity, labels=labels(entity)", "name", 10),
    "gl02_wo_technician": pattern(
        "asset", "", [hop("asset", "", "wo", "WorkOrder", True), hop("wo", "", "tech", "Technician")],
        "asset=asset, work_order=wo, technician=tech, work_relationship=type(wo), tech_relationship=type(tech)", "", None, param="asset"),
    "gl03_contains_path": pattern("parent", "", [hop("parent", "CONTAINS", "child", "", True, reach=3)], "parent=parent, child=child, depth=depth(child)", "depth, child", None, param="parent"),
    "gl04_compliance": pattern(
        "asset", "", [hop("asset", "", "inspection", "Inspection", True)],
        "asset=asset, inspection=inspection, inspection_date=when(inspection), inspection_status=status(inspection)", "-inspection_date", None, param="asset"),
}

GROUPED = ("set", "types", "count")


def _labelled(nodes: DataFrame, labels) -> DataFrame:
    return nodes.filter(F.arrays_overlap("labels", F.array(*map(F.lit, labels)))) if labels else nodes


def _steps(edges: DataFrame, h: Hop, starts: DataFrame | None = None) -> DataFrame:
    """f, t, type, depth, when, status of one hop, from the nodes of `starts` (f) if given.

    Longer reaches walk trails: a node may come again, an edge (its ends and type) may not.
    """
    e = edges.filter(F.col("type").isin(*h.types)) if h.types else edges
    a, b = ("dst", "src") if h.back else ("src", "dst")
    own = F.struct("src", "dst", "type")
    one = e.select(F.col(a).alias("f"), F.col(b).alias("t"), "type", F.lit(1).alias("depth"), "when", "status", F.array(own).alias("trail"))
    walks = [one if starts is None else one.join(starts, "f", "left_semi")]
    for depth in range(2, h.reach + 1):
        step = e.select(F.col(a).alias("t"), F.col(b).alias("n"), F.col("type").alias("y"), F.col("when").alias("w"), F.col("status").alias("s"), own.alias("edge"))
        last = walks[-1].join(step, "t").filter(~F.array_contains("trail", F.col("edge")))
        walks.append(
            last.select(
                "f", F.col("n").alias("t"), F.concat_ws("|", "type", "y").alias("type"), F.lit(depth).alias("depth"),
                F.col("w").alias("when"), F.col("s").alias("status"), F.array_append("trail", F.col("edge")).alias("trail"),
            )
        )
    return reduce(DataFrame.unionByName, walks).drop("trail")


def _column(kind: str, node: str) -> Column:
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return {
        "name": lambda: F.col(f"{node}_name"),
        "type": lambda: F.col(f"{node}_type"),
        "when": lambda: F.col(f"{node}_when"),
        "status": lambda: F.col(f"{node}_status"),
        "depth": lambda: F.col(f"{node}_depth").cast("long"),
        "labels": lambda: F.array_join(F.col(f"{node}_labels"), "|"),
        "set": lambda: distinct(f"{node}_name"),
        "types": lambda: distinct(f"{node}_type"),
        "count": lambda: F.count_distinct(f"{node}_id"),
    }[kind]()


def _named(nodes: DataFrame, v: str) -> DataFrame:
    return nodes.select(F.col("id").alias(f"{v}_id"), F.col("name").alias(f"{v}_name"), F.col("labels").alias(f"{v}_labels"))


def _foldable(p: Pattern, h: Hop) -> bool:
    """Whether only sets and counts of an optional hop's nodes, and of those behind them, are asked for."""
    own = all(k in GROUPED for _, k, n in p.out if n == h.to)
    return h.optional and own and all(_foldable(p, c) for c in p.hops if c.at == h.to)


FOLDED = {"set": "names", "types": "types", "count": "ids"}


def _fold(p: Pattern, h: Hop, nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """f and, per output of the hop and of those behind it, the distinct values as an array, for the nodes of `starts` (f).

    Hops that leave one node don't multiply each other's rows: each is folded for itself,
    from the nodes that are reached and no others.
    """
    rows = _steps(edges, h, starts).select("f", F.col("t").alias("id"), "type").join(_labelled(nodes, h.labels).select("id", "name"), "id")
    behind = [c for c in p.hops if c.at == h.to]
    if behind:
        rows = stored(rows, "pattern-fold")
    parts = {"names": F.collect_set("name"), "types": F.collect_set("type"), "ids": F.collect_set("id")}
    asked = {FOLDED[k] for _, k, n in p.out if n == h.to}
    aggregates = [parts[k].alias(f"{h.to}_{k}") for k in sorted(asked)]
    reached = rows.select(F.col("id").alias("f")).distinct()
    for c in behind:
        further = _fold(p, c, nodes, edges, reached).withColumnRenamed("f", "id")
        rows = rows.join(further, "id", "left")
        aggregates += [_union(x).alias(x) for x in further.columns if x != "id"]
    return rows.groupBy("f").agg(*aggregates) if aggregates else rows.select("f").distinct()


def _union(column: str) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(column)))


def _first(p: Pattern) -> list[Column]:
    """The order of a pattern's rows, completed by the remaining columns."""
    columns = [c for c, _, _ in p.out]
    first = [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in p.order]
    return first + [F.col(c).asc_nulls_last() for c in columns if c not in dict(p.order)]


def run(p: Pattern, nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """The pattern's answer for nodes whose name contains `value`, whatever the case."""
    low = F.lower("name")
    asked = reduce(lambda a, b: a | b, [low.contains(F.lower(F.lit(w))) for w in (value, *p.words)])
    rows = _walk(p, nodes, edges, _named(_labelled(nodes, p.labels).filter(asked), p.start), [])
    return rows if p.limit is None else rows.orderBy(*_first(p)).limit(p.limit)


def run_all(p: Pattern, nodes: DataFrame, edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """ask, rank and the pattern's columns: the first `most` rows for each of many asks at once, from the nodes of `starts` (ask, id)."""
    begun = _named(_labelled(nodes, p.labels), p.start).join(starts.select("ask", F.col("id").alias(f"{p.start}_id")).distinct(), f"{p.start}_id")
    rows = _walk(p, nodes, edges, begun, ["ask"])
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(*_first(p)))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= min(most, p.limit or most))


def _walk(p: Pattern, nodes: DataFrame, edges: DataFrame, rows: DataFrame, keep: list[str]) -> DataFrame:
    """The pattern's columns, and those to keep, from rows of its start nodes."""
    folds, folded = [], set()
    for h in p.hops:
        if h.at in folded or _foldable(p, h):
            folds += [] if h.at in folded else [h]
            folded.add(h.to)
            continue
        starts = None
        if h.reach > 1:  # walks begin at the nodes that are reached, which a table keeps out of the walks' plan
            rows = stored(rows, "pattern-rows")
            starts = rows.select(F.col(f"{h.at}_id").alias("f")).distinct()
        steps = _steps(edges, h, starts).select(
            F.col("f").alias(f"{h.at}_id"), F.col("t").alias(f"{h.to}_id"),
            *[F.col(c).alias(f"{h.to}_{c}") for c in ("type", "depth", "when", "status")],
        )
        ends = steps.join(_named(_labelled(nodes, h.labels), h.to), f"{h.to}_id")
        rows = rows.join(ends, f"{h.at}_id", "left" if h.optional else "inner")
    if folds:
        rows = reached = stored(rows, "pattern-rows")
        for h in folds:
            starts = reached.select(F.col(f"{h.at}_id").alias("f")).distinct()
            rows = rows.join(_fold(p, h, nodes, edges, starts).withColumnRenamed("f", f"{h.at}_id"), f"{h.at}_id", "left")

    def grouped(kind: str, node: str) -> Column:
        if node not in folded:
            return _column(kind, node)
        values = _union(f"{node}_{FOLDED[kind]}")
        return F.size(values).cast("long") if kind == "count" else F.array_join(F.array_sort(values), "|")

    plain = [*map(F.col, keep), *[_column(k, n).alias(c) for c, k, n in p.out if k not in GROUPED]]
    if any(k in GROUPED for _, k, _ in p.out):
        rows = rows.groupBy(*plain).agg(*[grouped(k, n).alias(c) for c, k, n in p.out if k in GROUPED])
    else:
        rows = rows.select(*plain)
    return rows.select(*keep, *[c for c, _, _ in p.out])


def sql(p: Pattern, value: str) -> str:
    """The pattern as SQL over CTEs nodes(id, name, labels) and edges(src, dst, type, when, status)."""
    ctes, body = _sql(p, value, "")
    if p.limit is not None:
        body = f"SELECT * FROM ({body}) ORDER BY {_order_sql(p)} LIMIT {p.limit}"
    return ((", " + ", ".join(ctes)) if ctes else "") + " " + body


def sql_all(p: Pattern, asks: str, most: int, name: str) -> tuple[list[str], str]:
    """(CTEs with names of their own, rows of run_all()) for a relation asks(ask)."""
    ctes, body = _sql(p, None, name, asks)
    ranked = f"SELECT *, row_number() OVER (PARTITION BY ask ORDER BY {_order_sql(p)}) AS rank FROM ({body})"
    return ctes, f"SELECT * FROM ({ranked}) WHERE rank <= {min(most, p.limit or most)}"


def _order_sql(p: Pattern) -> str:
    order = [f"{c} {'DESC NULLS FIRST' if down else 'ASC NULLS LAST'}" for c, down in p.order]
    return ", ".join(order + [f"{c} ASC NULLS LAST" for c, _, _ in p.out if c not in dict(p.order)])


def _sql(p: Pattern, value: str | None, name: str, asks: str = "") -> tuple[list[str], str]:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    has = lambda v, labels: " AND list_has_any({}.labels, [{}])".format(v, ", ".join(map(q, labels))) if labels else ""
    ctes, joins = [], []
    for i, h in enumerate(p.hops):
        where = f"WHERE type IN ({', '.join(map(q, h.types))})" if h.types else ""
        a, b = ("dst", "src") if h.back else ("src", "dst")
        body = [f'SELECT {a} AS f, {b} AS t, type, 1 AS depth, "when", status FROM edges {where}']
        other = lambda v, w: "(v.src, v.dst, v.type) IS DISTINCT FROM (w.src, w.dst, w.type)".replace("v.", f"{v}.").replace("w.", f"{w}.")
        step = f"(SELECT * FROM edges {where})"
        if h.reach >= 2:
            body.append(f"SELECT x.{a}, y.{b}, x.type || '|' || y.type, 2, y.\"when\", y.status FROM {step} x JOIN {step} y ON x.{b} = y.{a} WHERE {other('x', 'y')}")
        if h.reach >= 3:
            body.append(f"SELECT x.{a}, z.{b}, x.type || '|' || y.type || '|' || z.type, 3, z.\"when\", z.status FROM {step} x JOIN {step} y ON x.{b} = y.{a} JOIN {step} z ON y.{b} = z.{a} WHERE {other('x', 'y')} AND {other('x', 'z')} AND {other('y', 'z')}")
        ctes.append(f"{name}s{i} AS (SELECT s.*, n.name, n.labels FROM ({' UNION ALL '.join(body)}) s JOIN nodes n ON n.id = s.t{has('n', h.labels)})")
        joins.append(f"{'LEFT ' if h.optional else ''}JOIN {name}s{i} AS {h.to} ON {h.to}.f = {h.at}.{'id' if h.at == p.start else 't'}")
    one = lambda n: n + (".id" if n == p.start else ".t")
    text = {
        "name": "{n}.name", "type": "{n}.type", "when": '{n}."when"', "status": "{n}.status", "depth": "{n}.depth::BIGINT",
        "labels": "array_to_string({n}.labels, '|')",
        "set": "coalesce(array_to_string(list_sort(list(DISTINCT {n}.name) FILTER ({n}.name IS NOT NULL)), '|'), '')",
        "types": "coalesce(array_to_string(list_sort(list(DISTINCT {n}.type) FILTER ({n}.type IS NOT NULL)), '|'), '')",
        "count": "count(DISTINCT {id})",
    }
    exprs = [(c, k, text[k].format(n=n, id=one(n))) for c, k, n in p.out]
    group = [e for _, k, e in exprs if k not in GROUPED]
    words = [q(w.lower()) for w in ((value,) if value is not None else ()) + p.words] + (["lower(asks.ask)"] if asks else [])
    asked = " OR ".join(f"contains(lower({p.start}.name), {w})" for w in words)
    if asks:
        group, exprs = ["asks.ask", *group], [("ask", "name", "asks.ask"), *exprs]
    source = f"{asks} AS asks JOIN nodes AS {p.start} ON {asked}" if asks else f"nodes AS {p.start}"
    where = "true" if asks else asked
    body = f"SELECT {', '.join(f'{e} AS {c}' for c, _, e in exprs)} FROM {source} {' '.join(joins)} WHERE ({where}){has(p.start, p.labels)}"
    if len(group) < len(exprs):
        body += " GROUP BY " + ", ".join(group)
    return ctes, body
