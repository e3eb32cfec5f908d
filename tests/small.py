"""Small hand-made graphs."""

import json

from tidegraph.model import ASSERTIONS, EDGES, NODES
from tidegraph.plans.view import Graph


class Maker:
    """Collects nodes, edges and assertions; ids are the given names."""

    def __init__(self):
        self.nodes, self.edges, self.log = {}, {}, []

    def node(self, name, kind, value=None, key=None, **facts):
        self.nodes[name] = (name, kind, json.dumps(key or {"name": name}))
        if value is not None:
            self.claim("node", name, value, **facts)
        return name

    def edge(self, kind, src, dst, context="default", name=None, **facts):
        name = name or f"{src}-{kind}-{dst}"
        self.edges[name] = (name, kind, src, dst, context)
        self.claim("edge", name, {"exists": True}, context=context, **facts)
        return name

    def claim(self, kind, target, value, at=100.0, until=None, observed=None, provenance=3, confidence=0.95, source="scan", context="default",
              evidence=("ev",), ttl=None, name=None):
        name = name or f"a{len(self.log):04d}"
        self.log.append((name, kind, target, json.dumps(value, sort_keys=True), provenance, float(confidence), source, context, float(at),
                         None if until is None else float(until), float(at if observed is None else observed), sorted(evidence), 0, None if ttl is None else float(ttl)))

    def graph(self, spark, order=None):
        log = self.log if order is None else order(self.log)
        return Graph(spark.createDataFrame(list(self.nodes.values()), NODES), spark.createDataFrame(list(self.edges.values()), EDGES) if self.edges else spark.createDataFrame([], EDGES),
                     spark.createDataFrame(log, ASSERTIONS))


def eight_nodes():
    """Two zones, four hosts (one of them late), a service and a datastore."""
    m = Maker()
    m.node("zi", "ZONE", {"name": "Internet", "classification": "external"}, {"name": "Internet"})
    m.node("zn", "ZONE", {"name": "Internal"}, {"name": "Internal"})
    m.node("web", "ASSET", {"business_importance": 0.6, "public_ip": True})
    m.node("app", "ASSET", {"business_importance": 0.5})
    m.node("db", "ASSET", {"business_importance": 0.9})
    m.claim("node", "db", {"business_importance": 0.9}, at=110)
    m.node("late", "ASSET", {"business_importance": 0.2}, at=200)
    m.node("svc", "SERVICE", {"port": 443})
    m.node("ds", "DATASTORE", {"name": "orders"})
    for kind, a, b in [("IN_ZONE", "web", "zi"), ("IN_ZONE", "app", "zn"), ("IN_ZONE", "db", "zn"), ("HOSTS", "web", "svc"), ("HOSTS", "db", "ds"),
                       ("DEPENDS_ON", "web", "app"), ("DEPENDS_ON", "app", "db"), ("CONNECTS_TO", "web", "app")]:
        m.edge(kind, a, b)
    return m


def rows(df, *columns):
    """Sorted tuples of the named columns."""
    return sorted(tuple(r) for r in df.select(*columns).collect())
