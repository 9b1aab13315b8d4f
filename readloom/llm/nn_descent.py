"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Equal vectors are one graph node. Nodes are dealt into buckets by a hash of their
id; whatever moves between nodes moves as packed arrays between buckets, in a
shuffle of one row for each pair of buckets that have something to say.

A round of descent joins neighbours of neighbours. Every node learns who lists
it, pushes its vector to the buckets of its neighbours in both directions, and
each node scores the pairs among the vectors it was sent of which one is new; those
that an end would list go back to it. Rounds go on until few links change. Search starts from a query's own neighbours (a
query is a node), asks the best nodes it has not asked for their links in both
directions of the graph, and has those scored where their vectors live. Vectors
and links stay in staged tables of their own, so they move only where needed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_staged, release, staged
from .textkit import mix

NEIGHBOURS, FIRST = 32, 8
#: Rounds of descent run until no more than this share of the links is new.
CHANGED = 0.01
#: Members that one comparison around a pivot holds at most; the members of a larger pivot are dealt anew in every round.
GROUP = 256
#: Most nodes of a bucket that tell one node in a round that they list it, or push their vectors for it; others do so in later rounds.
TOLD = 16
#: Buckets whose nodes the first lists of a bucket draw on; every bucket draws on others.
DRAWN = 32
#: Search: best nodes held, expanded in one step, steps, and links of a node followed.
HELD, EXPAND, STEPS, FOLLOWED = 256, 80, 4, 64
BUCKET_ROWS = 1024
_MESSAGE = "bucket bigint, kind int, body binary"


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _row(bucket: int, kind: int, **arrays) -> tuple[int, int, bytes]:
    return int(bucket), kind, pickle.dumps(arrays, protocol=5)


def _exchange(messages: DataFrame, work: Callable[[int, list[tuple[int, dict]]], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Bring each bucket's messages together and turn them into new ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = sorted(((int(k), bytes(b)) for k, b in zip(pdf["kind"], pdf["body"], strict=True)), key=lambda x: (x[0], x[1][:64], len(x[1])))
        rows = work(int(pdf["bucket"].iloc[0]), [(k, pickle.loads(b)) for k, b in got])
        return pd.DataFrame(rows, columns=["bucket", "kind", "body"])

    return messages.groupBy("bucket").applyInPandas(run, _MESSAGE)


def _cut(order_by: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices by home bucket of the ids."""
    home = _home(order_by, buckets)
    order = np.argsort(home, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        if len(part):
            yield int(home[part[0]]), part


def _find(sorted_ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in ``sorted_ids``, -1 where missing."""
    if not len(sorted_ids):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_ids, wanted), len(sorted_ids) - 1)
    return np.where(sorted_ids[at] == wanted, at, -1)


def _top(owner: np.ndarray, other: np.ndarray, score: np.ndarray, flag: np.ndarray, k: int):
    """Each owner's k best distinct others; of equal ones the earliest given stays."""
    order = np.lexsort((np.arange(len(owner)), other, owner))
    owner, other, score, flag = owner[order], other[order], score[order], flag[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, score, flag = owner[first], other[first], score[first], flag[first]
    order = np.lexsort((other, -score, owner))
    owner, other, score, flag = owner[order], other[order], score[order], flag[order]
    keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
    return owner[keep], other[keep], score[keep], flag[keep]


VECTORS, LISTS, LISTED, PUSHED, PROPOSED, LINKS, BEAM, ASKED, LINKED, NAMED, SCORED, OFFERED, NEW = range(13)


def _one(got: list[tuple[int, dict]], kind: int) -> dict | None:
    return next((m for k, m in got if k == kind), None)


def _all(got: list[tuple[int, dict]], kind: int) -> list[dict]:
    return [m for k, m in got if k == kind]


def _cat(messages: list[dict], name: str, dtype) -> np.ndarray:
    return np.concatenate([m[name] for m in messages] or [np.zeros(0, dtype)])


def _turn(owner: np.ndarray, other: np.ndarray, fresh: np.ndarray, seed: int) -> np.ndarray:
    """Whether each link takes part in this round: all but those to hubs, of which each bucket sends TOLD, new ones first."""
    lot = mix(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + other.view(np.uint64) + np.uint64(seed))
    order = np.lexsort((lot, ~fresh, other))
    sent = np.zeros(len(other), bool)
    sorted_ = other[order]
    sent[order] = np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < TOLD
    return sent


def _lists(bucket: int, ids, owner, other, score, fresh, buckets: int, seed: int) -> list:
    """A bucket's lists with the links that take part in the next round, and these told to whom they name."""
    sent = _turn(owner, other, fresh, seed)
    told = [_row(b, LISTED, by=ids[owner[sent][p]], whom=other[sent][p], fresh=fresh[sent][p]) for b, p in _cut(other[sent], buckets)]
    return [_row(bucket, LISTS, ids=ids, owner=owner, other=other, score=score, fresh=fresh, sent=sent), *told]


def _push(buckets: int):
    """Vectors go to the buckets of their neighbours in both directions.

    A hub's listers come in shares, by their bucket, so that no bucket takes them all.
    """
    shares = max(1, TOLD * buckets // 4096)

    def work(bucket: int, got: list[tuple[int, dict]]) -> list:
        v, s, listed = _one(got, VECTORS), _one(got, LISTS), _all(got, LISTED)
        if v is None or s is None:
            return []
        ids, sent = v["ids"], s["sent"]
        to, back, times = np.unique(s["other"][sent], return_inverse=True, return_counts=True)
        share = mix(to.view(np.uint64) + np.uint64(1 + bucket % shares)).view(np.int64)
        to = np.where((times >= TOLD) & (shares > 1), share, to)[back]
        member = np.concatenate([s["owner"][sent], _find(ids, _cat(listed, "whom", np.int64))])
        pivot, new = np.concatenate([to, _cat(listed, "by", np.int64)]), np.concatenate([s["fresh"][sent], _cat(listed, "fresh", bool)])
        ok = member >= 0
        member, pivot, new = member[ok], pivot[ok], new[ok]
        size = np.bincount(s["owner"], minlength=len(ids))
        worst = np.full(len(ids), np.inf, np.float32)
        np.minimum.at(worst, s["owner"], s["score"])
        least = np.where(size >= NEIGHBOURS, worst, -np.inf).astype(np.float32)
        # half floats of vectors scaled to 1, and their scales beside the largest
        half, scale = (v["vectors"] / v["peaks"][:, None]).astype(np.float16), (v["peaks"] / v["most"]).astype(np.float32)
        out = []
        for b, p in _cut(pivot, buckets):
            own, back = np.unique(member[p], return_inverse=True)
            out.append(_row(b, PUSHED, ids=ids[own], vectors=half[own], scale=scale[own], least=least[own], pivot=pivot[p], member=back.astype(np.int32), fresh=new[p]))
        return out

    return work


def _join(buckets: int, seed: int):
    def work(bucket: int, got: list[tuple[int, dict]]) -> list:
        pushed = _all(got, PUSHED)
        start = np.cumsum([0] + [len(m["ids"]) for m in pushed])
        ids = np.concatenate([m["ids"] for m in pushed])
        vectors = np.concatenate([m["vectors"] for m in pushed]).astype(np.float32) * np.concatenate([m["scale"] for m in pushed])[:, None]
        least = np.concatenate([m["least"] for m in pushed])
        pivot, fresh = (np.concatenate([m[x] for m in pushed]) for x in ("pivot", "fresh"))
        member = np.concatenate([m["member"] + a for m, a in zip(pushed, start, strict=False)])
        # each pivot's members in both directions, once each, new if either link is
        lot = mix(ids[member].view(np.uint64) * np.uint64(31) + pivot.view(np.uint64) + np.uint64(seed))
        order = np.lexsort((~fresh, ids[member], lot, pivot))
        pivot, member, fresh = pivot[order], member[order], fresh[order]
        again = np.zeros(len(pivot), bool)
        again[1:] = (pivot[1:] == pivot[:-1]) & (ids[member[1:]] == ids[member[:-1]])
        pivot, member, fresh = pivot[~again], member[~again], fresh[~again]
        # all of them take part: the many of a hub are dealt into groups
        _, which, count = np.unique(pivot, return_inverse=True, return_counts=True)
        groups = -(-count // GROUP)
        nth = np.arange(len(pivot)) - np.searchsorted(pivot, pivot)
        unit = (np.cumsum(groups) - groups)[which] + nth % groups[which]
        order = np.lexsort((~fresh, unit))
        unit, member, fresh = unit[order], member[order], fresh[order]
        size, new = np.bincount(unit), np.bincount(unit, fresh).astype(np.int64)
        begin = np.cumsum(size) - size
        queue = np.lexsort((new, -(-size // 16)))
        queue = queue[(new[queue] > 0) & (size[queue] > 1)]
        a, b, score, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], 0
        while at < len(queue):
            # new members against all of their unit; units of like size together
            step = max(1, 400_000 // int(size[queue[at]] + 16) ** 2)
            own = queue[at : at + step]
            at += step
            wide, high = int(size[own].max()), int(new[own].max())
            place = np.arange(wide)
            held = place < size[own][:, None]
            t = member[np.where(held, begin[own][:, None] + place, 0)]
            v, least_of = vectors[t], least[t]
            g = v[:, :high] @ v.transpose(0, 2, 1)
            ok = held[:, None, :] & (place[:high] < new[own][:, None])[:, :, None] & (place[:high, None] != place)
            old = place >= new[own][:, None]
            for i, x, y, turned in ((*np.nonzero(ok & (g > least_of[:, :high, None])), False), (*np.nonzero(ok & old[:, None, :] & (g > least_of[:, None, :])), True)):
                one, two = ids[t[i, x]], ids[t[i, y]]
                a.append(two if turned else one)
                b.append(one if turned else two)
                score.append(g[i, x, y])
        a, b, score = np.concatenate(a), np.concatenate(b), np.concatenate(score)
        a, b, score, _ = _top(a, b, score, np.zeros(len(a), bool), NEIGHBOURS)
        return [_row(to, PROPOSED, a=a[p], b=b[p], score=score[p].astype(np.float32)) for to, p in _cut(a, buckets)]

    return work


def _update(buckets: int, seed: int):
    """Lists take in proposals; who lists whom is told again. A link is new until it took part in a round."""

    def work(bucket: int, got: list[tuple[int, dict]]) -> list:
        s, proposed = _one(got, LISTS), _all(got, PROPOSED)
        if s is None:
            return []
        a = _cat(proposed, "a", np.int64)
        owner = np.concatenate([s["owner"], _find(s["ids"], a)])
        other = np.concatenate([s["other"], _cat(proposed, "b", np.int64)])
        score = np.concatenate([s["score"], _cat(proposed, "score", np.float32)])
        # 2: of this round, 1: of an earlier one that it has not taken part in yet
        fresh = np.concatenate([(s["fresh"] & ~s["sent"]).astype(np.int8), np.full(len(a), 2, np.int8)])
        ok = owner >= 0
        owner, other, score, fresh = _top(owner[ok], other[ok], score[ok], fresh[ok], NEIGHBOURS)
        return [(bucket, NEW, b"%d %d" % ((fresh == 2).sum(), len(fresh))), *_lists(bucket, s["ids"], owner, other, score, fresh > 0, buckets, seed)]

    return work


def _begin(nodes: DataFrame, buckets: int, dims: int, most: float) -> DataFrame:
    """Buckets of vectors, and each bucket's ids offered to those that draw on it; ``most`` is the largest component of all."""
    steps = np.unique(np.concatenate([[0], np.random.default_rng(buckets).choice(buckets, min(buckets, DRAWN), replace=False)]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_node")
        ids = pdf["_node"].to_numpy(dtype=np.int64)
        vectors = np.zeros((len(ids), dims))
        for k, v in enumerate(pdf["_v"]):
            vectors[k, : len(v) // 8] = np.frombuffer(v, np.float64)
        bucket = int(pdf["_bucket"].iloc[0])
        rows = [_row(bucket, VECTORS, ids=ids, vectors=vectors, peaks=np.abs(vectors).max(axis=1), most=most, asks=pdf["_asks"].to_numpy(dtype=bool))]
        return pd.DataFrame([*rows, *(_row((bucket + s) % buckets, OFFERED, by=bucket, ids=ids) for s in steps)], columns=["bucket", "kind", "body"])

    return nodes.groupBy("_bucket").applyInPandas(run, _MESSAGE)


def _first(buckets: int):
    """Lists to begin with: some of the nodes that other buckets and the own one offered."""

    def work(bucket: int, got: list[tuple[int, dict]]) -> list:
        offered = _all(got, OFFERED)
        own = [m["ids"] for m in offered if m["by"] == bucket]
        if not own:
            return []
        ids, pool = own[0], np.sort(np.concatenate([m["ids"] for m in offered]))
        owner = np.repeat(np.arange(len(ids)), FIRST)
        other = pool[np.random.default_rng(bucket).integers(0, len(pool), len(owner))]
        ok = other != ids[owner]
        owner, other, score, fresh = _top(owner[ok], other[ok], np.full(int(ok.sum()), -np.inf, np.float32), np.ones(int(ok.sum()), bool), NEIGHBOURS)
        return _lists(bucket, ids, owner, other, score, fresh, buckets, 0)

    return work


def _name_rows(b: dict, who: np.ndarray, node: np.ndarray, buckets: int) -> list:
    """Nodes that a bucket's queries want scored, with those queries' vectors."""
    out = []
    for to, p in _cut(node, buckets):
        own, back = np.unique(who[p], return_inverse=True)
        out.append(_row(to, NAMED, query=b["ids"][own], vectors=b["vectors"][own], least=b["least"][own], who=back.astype(np.int32), node=node[p]))
    return out


def _search_begin(buckets: int):
    """Links of both directions of every node; the queries' beams; their own links to be scored."""

    def work(bucket: int, got: list[tuple[int, dict]]) -> list:
        v, s, listed = _one(got, VECTORS), _one(got, LISTS), _all(got, LISTED)
        if v is None or s is None:
            return []
        by = _cat(listed, "by", np.int64)
        owner = np.concatenate([s["owner"], _find(v["ids"], _cat(listed, "whom", np.int64))])
        other = np.concatenate([s["other"], by])
        back = np.concatenate([np.zeros(len(s["owner"]), bool), np.ones(len(by), bool)])
        ok = owner >= 0
        owner, other, back = owner[ok], other[ok], back[ok]
        lot = (mix(other.view(np.uint64)) >> np.uint64(40)).astype(np.float64)
        owner, other, _, _ = _top(owner, other, np.where(back, -lot, 1.0), back, FOLLOWED)
        at = np.flatnonzero(v["asks"])
        place = np.full(len(v["ids"]), -1)
        place[at] = np.arange(len(at))
        mine = place[owner] >= 0
        none = np.zeros(0, np.int64)
        b = {"ids": v["ids"][at], "vectors": v["vectors"][at], "least": np.full(len(at), -np.inf), "owner": none, "node": none, "score": np.zeros(0), "asked": np.zeros(0, bool)}
        who, node = np.concatenate([place[owner[mine]], np.arange(len(at))]), np.concatenate([other[mine], b["ids"]])
        return [_row(bucket, LINKS, ids=v["ids"], owner=owner.astype(np.int32), other=other), _row(bucket, BEAM, **b), *_name_rows(b, who, node, buckets)]

    return work


def _score(buckets: int):
    """Named nodes are scored where their vectors live; scores from a query's least on go home."""

    def work(bucket: int, got: list[tuple[int, dict]]) -> list:
        v, named = _one(got, VECTORS), _all(got, NAMED)
        if v is None or not named:
            return []
        base = np.cumsum([0] + [len(m["query"]) for m in named])
        query, vectors, least = _cat(named, "query", np.int64), np.concatenate([m["vectors"] for m in named]), _cat(named, "least", float)
        who = np.concatenate([m["who"] + a for m, a in zip(named, base, strict=False)])
        node = _find(v["ids"], _cat(named, "node", np.int64))
        who, node = who[node >= 0], node[node >= 0]
        parts = (slice(k, k + 20_000) for k in range(0, len(who), 20_000))
        score = np.concatenate([np.einsum("ij,ij->i", vectors[who[p]], v["vectors"][node[p]]) for p in parts] or [np.zeros(0)])
        ok = score >= least[who]
        who, node, score = who[ok], node[ok], score[ok]
        return [_row(to, SCORED, query=query[who[p]], node=v["ids"][node[p]], score=score[p]) for to, p in _cut(query[who], buckets)]

    return work


def _gather(buckets: int, expand: int):
    """Queries take in scores, keep their best, and ask the best unasked nodes for their links."""

    def work(bucket: int, got: list[tuple[int, dict]]) -> list:
        b, scored = _one(got, BEAM), _all(got, SCORED)
        if b is None:
            return []
        new = _cat(scored, "node", np.int64)
        owner = np.concatenate([b["owner"], _find(b["ids"], _cat(scored, "query", np.int64))])
        node, score = np.concatenate([b["node"], new]), np.concatenate([b["score"], _cat(scored, "score", float)])
        asked = np.concatenate([b["asked"], np.zeros(len(new), bool)])
        owner, node, score, asked = _top(owner, node, score, asked, HELD)
        size = np.bincount(owner, minlength=len(b["ids"]))
        worst = np.full(len(b["ids"]), np.inf)
        np.minimum.at(worst, owner, score)
        waiting = np.flatnonzero(~asked)
        nth = np.arange(len(waiting)) - np.searchsorted(owner[waiting], owner[waiting])
        go = waiting[nth < expand]
        asked[go] = True
        b = b | {"least": np.where(size >= HELD, worst, -np.inf), "owner": owner, "node": node, "score": score, "asked": asked, "go_owner": owner[go], "go_node": node[go]}
        return [_row(bucket, BEAM, **b), *(_row(to, ASKED, node=np.unique(node[go[p]]), home=np.array([bucket])) for to, p in _cut(node[go], buckets))]

    return work


def _answer(buckets: int):
    """Asked nodes send their links to the buckets that asked."""

    def work(bucket: int, got: list[tuple[int, dict]]) -> list:
        s, asked = _one(got, LINKS), _all(got, ASKED)
        if s is None:
            return []
        start = np.searchsorted(s["owner"], np.arange(len(s["ids"]) + 1))
        out = []
        for m in asked:
            at = _find(s["ids"], m["node"])
            at = at[at >= 0]
            size = start[at + 1] - start[at]
            links = s["other"][np.repeat(start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            out.append(_row(int(m["home"][0]), LINKED, node=s["ids"][at], size=size.astype(np.int32), links=links))
        return out

    return work


def _request(buckets: int):
    """Queries have the links that they do not hold yet scored."""

    def work(bucket: int, got: list[tuple[int, dict]]) -> list:
        b, linked = _one(got, BEAM), _all(got, LINKED)
        if b is None:
            return []
        node, size, links = _cat(linked, "node", np.int64), _cat(linked, "size", np.int32).astype(np.int64), _cat(linked, "links", np.int64)
        order = np.argsort(node, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        at = _find(node[order], b["go_node"])
        who, at = b["go_owner"][at >= 0], at[at >= 0]
        n = size[order][at]
        spots = np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        who, named = np.repeat(who, n), links[spots]
        held = np.concatenate([np.zeros(len(who), bool), np.ones(len(b["owner"]), bool)])
        who, named = np.concatenate([who, b["owner"]]), np.concatenate([named, b["node"]])
        order = np.lexsort((~held, named, who))
        who, named, held = who[order], named[order], held[order]
        first = np.ones(len(who), bool)
        first[1:] = (who[1:] != who[:-1]) | (named[1:] != named[:-1])
        go = first & ~held
        return [_row(bucket, BEAM, **{k: v for k, v in b.items() if not k.startswith("go_")}), *_name_rows(b, who[go], named[go], buckets)]

    return work


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int | None = None, steps: int = STEPS, expand: int = EXPAND) -> DataFrame:
    """The k nearest rows found for every query row, nearest first: query_id, rank, vec_id, score.

    Every row is in the graph. ``score`` is the inner product in double precision
    of the vectors as given; shorter ones count as padded with zeros. Null, empty
    and zero vectors and those with a null or non-finite component take no part,
    nor do rows with a null id. Rows with equal vectors share one graph node and
    are told apart again at the end, smaller ids first; a query never finds a row
    with its own id. Rounds run until few links change, or as many as ``rounds``.
    Each of ``steps`` search steps asks ``expand`` nodes for their links. Only the two
    named columns are read, so ``is_query`` can use the id column alone.
    """
    valid = df.select(df[id_col].cast("long").alias(id_col), df[vector_col].cast("array<double>").alias("_a")).filter(
        F.col(id_col).isNotNull() & F.col("_a").isNotNull() & (F.size("_a") > 0) & ~F.exists("_a", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_a", lambda x: x != 0)
    )
    asking = valid.withColumn("_asks", F.coalesce(is_query, F.lit(False))).withColumnRenamed(id_col, "_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy() + 0.0
            at = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            peaks = np.maximum.reduceat(np.abs(flat), at[:-1]) if len(flat) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), batch.column(2), pa.array(peaks)], ["_id", "_v", "_asks", "_peak"])

    rows = staged(asking.select("_id", "_a", "_asks").mapInArrow(pack, "_id bigint, _v binary, _asks boolean, _peak double"))
    groups = staged(rows.groupBy("_v").agg(F.min("_id").alias("_node"), F.max("_asks").alias("_asks"), F.max("_peak").alias("_peak")))
    own = rows.join(groups.select("_v", "_node"), "_v").select("_id", "_asks", "_node").distinct()
    same = staged(own.withColumn("_nth", F.row_number().over(Window.partitionBy("_node").orderBy("_id"))).filter(F.col("_nth") <= k + 1))
    spark = df.sparkSession
    sizes = groups.agg(F.count("*").alias("n"), F.max(F.length("_v")).alias("bytes"), F.max("_peak").alias("peak")).first()
    dims, buckets = int(sizes["bytes"] or 8) // 8, max(1, -(-sizes["n"] // BUCKET_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_home(batch.column(0).to_numpy(), buckets)), *batch.columns], ["_bucket", "_node", "_v", "_asks"])

    placed = groups.select("_node", "_v", "_asks").mapInArrow(place, "_bucket bigint, _node bigint, _v binary, _asks boolean")
    start = staged(_begin(placed, buckets, dims, float(sizes["peak"] or 1)))
    only = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds))
    fixed, lists = only(start, VECTORS), staged(_exchange(only(start, OFFERED), _first(buckets)))

    def turn(new: DataFrame, *old: DataFrame) -> DataFrame:
        """Finish a round: write its result, delete what it replaces and the shuffle files behind it."""
        new = staged(new)
        for df in old:
            drop_staged(df)
        release(spark)
        return new

    r, moving = 0, True
    while moving if rounds is None else r < rounds:
        pushed = _exchange(fixed.unionByName(lists), _push(buckets))
        proposed = _exchange(pushed, _join(buckets, 101 + r))
        lists = turn(_exchange(only(lists, LISTS).unionByName(proposed), _update(buckets, 1 + r)), lists)
        part = F.split(F.col("body").cast("string"), " ")
        told = only(lists, NEW).agg(F.sum(part[0].cast("bigint")).alias("new"), F.sum(part[1].cast("bigint")).alias("all")).first()
        r, moving = r + 1, (told["new"] or 0) > CHANGED * (told["all"] or 0)
        lists = only(lists, LISTS, LISTED)
    begun = turn(_exchange(fixed.unionByName(lists), _search_begin(buckets)), lists)
    links, beams = only(begun, LINKS), begun
    for step in range(steps + 1):
        scored = _exchange(fixed.unionByName(only(beams, NAMED)), _score(buckets))
        got = turn(_exchange(only(beams, BEAM).unionByName(scored), _gather(buckets, expand)), *([beams] if step else []))
        beams = got
        if step < steps:
            linked = _exchange(links.unionByName(only(got, ASKED)), _answer(buckets))
            beams = turn(_exchange(only(got, BEAM).unionByName(linked), _request(buckets)), got)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for body in pdf["body"]:
                b = pickle.loads(body)
                owner, node, score, _ = _top(b["owner"], b["node"], b["score"], b["asked"], k + 1)
                yield pd.DataFrame({"_query": b["ids"][owner], "_node": node, "score": score})

    nodes = only(beams, BEAM).select("body").mapInPandas(found, "_query bigint, _node bigint, score double")
    askers = own.filter("_asks").select(F.col("_id").alias("query_id"), F.col("_node").alias("_query"))
    hits = nodes.join(askers, "_query").join(same.select(F.col("_id").alias("vec_id"), "_node"), "_node").filter(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
