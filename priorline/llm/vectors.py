"""Near-duplicate vectors by range search on robust-pruned neighbour graphs."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import stage
from priorline.llm.graph import components

SHARD_ROWS = 1500  # a label gets one shard centre for so many distinct vectors
OVERLAP = 2  # shards each vector belongs to
SAMPLE = 4096  # vectors per label from which its centres are picked
POOL, DEGREE, ALPHA = 40, 16, 1.2
BEAM, ENTRIES = 24, 12
SLACK = 0.03  # range search also walks through vectors this far below the threshold
AUDIT = 64  # queries per shard that are compared with all its vectors
BLOCK = 512  # queries searched in step


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, vector (double) and a key of (label, vector); null where a vector can link with nothing.

    That is a null, zero or empty vector, a null or non-finite component, or a null label.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull(), F.lit(False))
    out = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(usable, v).alias("v"))
    return out.withColumn("k", F.when(F.col("v").isNotNull(), F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",")))))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow for large, no underflow for small values
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    return _unit(np.stack(list(column)).astype(np.float64))


def spread_out(x: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other, each the farthest from those before it; the first is the medoid."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return np.array(chosen)


def robust_prune(x: np.ndarray, node: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Out-edges of each node from its pool (-1: none), nearest first, leaving out what an edge already covers.

    A candidate is covered by a kept neighbour when ALPHA times its distance to that neighbour is at most its
    distance to the node.
    """
    near = np.einsum("nd,ncd->nc", x[node], x[pool])
    near[(pool == node[:, None]) | (pool < 0)] = -2
    order = np.argsort(-near, axis=1, kind="stable")
    pool, near = np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1)
    away = np.sqrt(np.maximum(0, 2 - 2 * near))
    inside = x[pool]
    alive, out = near > -2, np.full((len(node), DEGREE), -1, np.int64)
    rows = np.arange(len(node))
    for edge in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        out[some, edge] = pool[rows[some], first[some]]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ncd->nc", inside[rows, first], inside)))
        alive &= ~((ALPHA * between <= away) & some[:, None])
        alive[rows[some], first[some]] = False
    return out


def shard_graph(x: np.ndarray) -> np.ndarray:
    """Robust-pruned adjacency of one shard: pools are near vectors and a few spread-out ones, then reversed edges."""
    n = len(x)
    far = spread_out(x, ENTRIES)
    adjacency = np.full((n, DEGREE), -1, np.int64)
    for at in range(0, n, BLOCK):
        node = np.arange(at, min(n, at + BLOCK))
        near = x[node] @ x.T
        take = min(POOL, n)
        pool = np.argpartition(-near, take - 1, axis=1)[:, :take]
        adjacency[node] = robust_prune(x, node, np.concatenate([pool, np.tile(far, (len(node), 1))], axis=1))
    # reversed edges join the pool, so that what points at a node can be reached from it
    source, target = np.repeat(np.arange(n), DEGREE), adjacency.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, DEGREE), -1, np.int64)
    ok = place < DEGREE
    back[target[ok], place[ok]] = source[ok]
    both = np.concatenate([adjacency, back], axis=1)
    for at in range(0, n, BLOCK):
        node = np.arange(at, min(n, at + BLOCK))
        adjacency[node] = robust_prune(x, node, both[node])
    return adjacency


def range_search(x: np.ndarray, adjacency: np.ndarray, entries: np.ndarray, queries: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, found row) of graph vectors with cosine >= reach, by greedy search and then range expansion."""
    n, q = len(x), len(queries)
    target = x[queries]
    seen = np.zeros((q, n + 1), bool)  # column n takes the missing neighbours
    seen[:, n] = True
    rows = np.arange(q)
    width = beam + adjacency.shape[1]
    ids = np.full((q, max(width, len(entries))), n)
    sims = np.full(ids.shape, -2.0)
    done = np.ones(ids.shape, bool)
    ids[:, : len(entries)], done[:, : len(entries)] = entries, False
    sims[:, : len(entries)] = target @ x[entries].T
    seen[rows[:, None], ids[:, : len(entries)]] = True
    while True:
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims, done = (np.take_along_axis(z, order, 1) for z in (ids, sims, done))
        first = (~done).argmax(axis=1)
        open_ = ~done[rows, first]
        if not open_.any():
            break
        done[rows, first] = True
        near = np.where(open_[:, None], adjacency[ids[rows, first] % n], -1)
        near[near < 0] = n
        new = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        score = np.where(new, np.einsum("qd,qrd->qr", target, x[np.minimum(near, n - 1)]), -2.0)
        ids, sims, done = np.concatenate([ids, np.where(new, near, n)], 1), np.concatenate([sims, score], 1), np.concatenate([done, ~new], 1)
    # range expansion: walk on from everything in or just outside the range
    found_q, found_n = [], []
    expanded = np.zeros((q, n + 1), bool)
    at_q, at_n = np.nonzero(sims >= reach - SLACK)
    at_n = ids[at_q, at_n]
    seen[:] = False
    seen[:, n] = True
    seen[at_q, at_n] = True
    while len(at_q):
        inside = np.einsum("id,id->i", target[at_q], x[at_n])
        found_q.append(at_q[inside >= reach])
        found_n.append(at_n[inside >= reach])
        walk = inside >= reach - SLACK
        at_q, at_n = at_q[walk], at_n[walk]
        expanded[at_q, at_n] = True
        near = adjacency[at_n]
        near = np.where(near < 0, n, near)
        to_q, to_n = np.repeat(at_q, near.shape[1]), near.ravel()
        fresh = ~seen[to_q, to_n]
        to_q, to_n = to_q[fresh], to_n[fresh]
        pair = np.unique(to_q * (n + 1) + to_n)
        at_q, at_n = pair // (n + 1), pair % (n + 1)
        seen[at_q, at_n] = True
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_n)


def _centres(reps: DataFrame) -> DataFrame:
    """Shard centres per label: spread-out vectors of a bounded sample, one for SHARD_ROWS vectors."""
    ranked = reps.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("k"), "k"))).filter(F.col("r") <= SAMPLE)
    sizes = reps.groupBy("label").agg(F.count("*").alias("n"))

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(frame["v"])
        count = -(-int(frame["n"].iloc[0]) // SHARD_ROWS)
        rows = spread_out(x, count)
        return pd.DataFrame({"label": frame["label"].iloc[rows].to_numpy(), "shard": np.arange(len(rows)), "c": list(x[rows])})

    label = reps.schema["label"].dataType.simpleString()
    return ranked.join(sizes, "label").select("label", "v", "n").groupBy("label").applyInPandas(pick, f"label {label}, shard int, c array<double>")


def _assign(reps: DataFrame, centres: DataFrame) -> DataFrame:
    """The OVERLAP nearest shards of each vector; the first is its home."""
    by_label = centres.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("shard", "c"))).alias("cs"))  # at most SAMPLE centres a label

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series, cs: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(v)
        groups: dict[bytes, list[int]] = {}
        sets = {}
        for i, c in enumerate(cs):
            m = np.stack([r["c"] for r in c])
            key = m.tobytes()
            sets[key] = m
            groups.setdefault(key, []).append(i)
        for key, rows in groups.items():
            near = _matrix(v.iloc[rows]) @ sets[key].T
            order = np.argsort(-near, axis=1, kind="stable")[:, :OVERLAP]
            for i, o in zip(rows, order, strict=True):
                out[i] = o.astype(np.int32)
        return pd.Series(out)

    return reps.join(F.broadcast(by_label), "label").select("k", "label", "v", "m", nearest("v", "cs").alias("shards"))


def build(placed: DataFrame) -> DataFrame:
    """Adjacency lists (label, k, out) of all vectors, united over the shards each belongs to."""

    def graph(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        keys = frame["k"].to_numpy()
        adjacency = shard_graph(_matrix(frame["v"]))
        return pd.DataFrame({"label": frame["label"].to_numpy(), "k": keys, "near": [keys[a[a >= 0]] for a in adjacency]})

    label = placed.schema["label"].dataType.simpleString()
    shards = placed.select("label", "k", "v", F.explode("shards").alias("shard")).groupBy("label", "shard")
    edges = shards.applyInPandas(graph, f"label {label}, k string, near array<string>")
    return edges.groupBy("label", "k").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # OVERLAP lists


def search(placed: DataFrame, graph: DataFrame, reach: float, audit: int = AUDIT) -> DataFrame:
    """Links of every vector, searched from its home shard on the united graph.

    A home's task holds the vectors of its shard and those their united lists point at.  Each row is
    either a vector with the number of its links inside the home (``links``), its least such link and
    how many audited links were there and missed, or one link that leaves the home (``out``).
    """
    label = placed.schema["label"].dataType.simpleString()
    member = placed.select("label", "k", F.explode("shards").alias("shard"), F.col("shards")[0].alias("home"))
    lists = member.join(graph, ["label", "k"]).select("label", "shard", "k", "home", "near")
    halo = lists.select("label", "shard", F.explode("near").alias("k")).distinct().join(member.select("label", "shard", "k"), ["label", "shard", "k"], "left_anti")
    outer = halo.join(placed.select("label", "k", F.col("shards")[0].alias("home")), ["label", "k"]).join(graph, ["label", "k"])
    nodes = lists.unionByName(outer.select("label", "shard", "k", "home", "near")).join(placed.select("label", "k", "v", "m"), ["label", "k"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k").reset_index(drop=True)
        shard, label_value = int(frame["shard"].iloc[0]), frame["label"].iloc[0]
        x, keys, copies = _matrix(frame["v"]), frame["k"].to_numpy(), frame["m"].to_numpy()
        home = frame["home"].to_numpy()
        place = {k: i for i, k in enumerate(keys)}
        lists = [[place[k] for k in near if k in place] for near in frame["near"]]
        adjacency = np.full((len(x), max(1, max(map(len, lists)))), -1, np.int64)
        for i, near in enumerate(lists):
            adjacency[i, : len(near)] = near
        inner = home == shard
        queries = np.flatnonzero(inner)
        entries = spread_out(x, ENTRIES)
        beam, missed, audited = BEAM, 0, 0
        while True:
            pairs = [(q + at, n) for at in range(0, len(queries), BLOCK) for q, n in [range_search(x, adjacency, entries, queries[at : at + BLOCK], reach, beam)]]
            q = queries[np.concatenate([p[0] for p in pairs])] if pairs else np.zeros(0, np.int64)
            n = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
            check = queries[np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int)] if len(queries) else queries
            there = {(int(check[i]), int(j)) for i, j in zip(*np.nonzero(x[check] @ x.T >= reach), strict=True) if check[i] != j}
            audited = len(there)
            missed = len(there - set(zip(q.tolist(), n.tolist(), strict=True))) if there else 0
            if missed <= 0.02 * audited or beam >= 8 * BEAM:  # the audit widens the search until it holds
                break
            beam *= 2
        keep = q != n
        q, n = q[keep], n[keep]
        same = inner[n]
        a, b = np.concatenate([q[same], n[same]]), np.concatenate([n[same], q[same]])
        links = np.unique(a * len(x) + b)  # found from either end
        a, b = links // len(x), links % len(x)
        count = np.bincount(a, weights=copies[b], minlength=len(x)).astype(np.int64)
        least = np.arange(len(x))
        np.minimum.at(least, a, b)
        lead = least.copy()
        while True:  # follow to the least vector reachable inside the home
            np.minimum.at(lead, a, lead[b])
            if (lead == lead[lead]).all() and (lead[a] == lead[b]).all():
                break
            lead = np.minimum(lead, lead[lead])
        rows = [pd.DataFrame({"label": [label_value] * len(queries), "k": keys[queries], "links": count[queries], "lead": keys[lead[queries]], "out": None, "found": audited, "missed": missed})]
        leave_q, leave_n = q[~same], n[~same]
        rows.append(pd.DataFrame({"label": [label_value] * len(leave_q), "k": keys[leave_q], "links": 0, "lead": None, "out": keys[leave_n], "found": 0, "missed": 0}))
        return pd.concat([r for r in rows if len(r)] or rows[:1])

    return nodes.groupBy("label", "shard").applyInPandas(run, f"label {label}, k string, links bigint, lead string, out string, found int, missed int")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", reach: float = 0.98) -> DataFrame:
    """One row per row: id, n_links, component_id (least id reachable) and kept, for links of cosine >= reach.

    Only vectors of one label are compared.  Equal vectors are one node of the graph with a number of
    copies, so a group of copies is never expanded; links between shards are single rows, those inside a
    shard are counted there.  Vectors that cannot link (see ``unit_vectors``) have no links and are their own
    component.  Null ids stay, with a null component unless linked with an id.
    """
    units = stage(unit_vectors(rows, id_col, vector_col, label_col), "units")
    reps = stage(units.filter("k IS NOT NULL").groupBy("k").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("m"), F.min("id").alias("least")), "reps")
    placed = stage(_assign(reps, _centres(reps)), "placed")
    found = stage(search(placed, stage(build(placed), "graph"), reach), "found")
    crossing = found.filter("out IS NOT NULL").select(F.least("k", "out").alias("a"), F.greatest("k", "out").alias("b")).distinct()
    ends = crossing.select(F.col("a").alias("k"), F.col("b").alias("o")).union(crossing.select("b", "a"))
    outside = ends.join(reps.select(F.col("k").alias("o"), "m"), "o").groupBy("k").agg(F.sum("m").alias("outside"))
    inside = found.filter("out IS NULL").select("k", "links", "lead")
    label = components(crossing.union(inside.filter("lead <> k").select("k", "lead")))
    node = reps.join(inside, "k").join(outside, "k", "left").join(label.withColumnRenamed("node", "k"), "k", "left")
    node = node.select("k", "least", (F.col("links") + F.coalesce("outside", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "k").alias("c"))
    node = stage(node, "nodes")
    best = node.groupBy("c").agg(F.min("least").alias("best"))
    final = node.join(best, "c").select("k", "n", "best")
    out = units.join(final, "k", "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("best")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
