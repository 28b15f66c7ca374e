"""Constrained least squares for conversion weights, many groups at a time.

A fit is min tr(B'MB) - 2 tr(B'N) over weights B >= 0 on the allowed links, each
code's weights summing to one. Per link that is x'Hx - 2 n'x with H between links of
the same target, so H is as sparse as the links are. Three ways, by what a group needs:

- one code with several links (all others have one): closed form in SQL;
- few links: groups of equal numbers of links are stacked into one batch of dense
  arrays and solved exactly by active sets, all groups of a batch at once;
- many links: sparse block steps, one block a code, all blocks at once.

Where the least value has several solutions, the one nearest to equal weights
is taken, so a result does not depend on the start. Codes without trade have equal weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.sources.storage import checkpointed

#: Links up to which a group is solved in a dense batch, and numbers in a batch's largest array.
FEW, BATCH = 24, 1 << 21
#: Eigenvalues under this share of the largest are 0.
FLAT = 1e-13


# ------------------------------------------------------------- dense batches
def _sum_free(keep: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Projections (groups, links, links) on changes of the kept links that
    leave every code's sum as it is."""
    same = (row[:, :, None] == row[:, None, :]) & keep[:, :, None] & keep[:, None, :]
    size = np.maximum(same.sum(axis=2), 1)
    return np.eye(row.shape[1]) * keep[:, :, None] - same / size[:, :, None]


def _row_means(values: np.ndarray, keep: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of each link, the mean of its code's kept links."""
    same = (row[:, :, None] == row[:, None, :]) & keep[:, None, :]
    return (same * values[:, None, :]).sum(axis=2) / np.maximum(same.sum(axis=2), 1)


def _split(h: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pseudo-inverse of php, and the projection on its flat directions within p."""
    values, vectors = np.linalg.eigh(p @ h @ p)
    steep = values > FLAT * np.maximum(np.trace(h, axis1=1, axis2=2), 1e-300)[:, None]
    inverse = (vectors * np.where(steep, 1 / np.where(steep, values, 1), 0)[:, None, :]) @ vectors.transpose(0, 2, 1)
    inside = (vectors * steep[:, None, :]) @ vectors.transpose(0, 2, 1)
    return inverse, p - inside


def dense_fits(h: np.ndarray, n: np.ndarray, row: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, solved) of groups with as many links each: ``h`` (groups,
    links, links), ``n`` and ``row`` (the link's code) (groups, links).

    A primal active-set method: from a feasible point, step to the least value on
    the links in use or to the first link that would turn negative, which is put
    out of use; at the least value, the link out of use that most wants in is put in
    use, until none does. ``start`` saves the steps if it already is the solution."""
    g, m = n.shape
    scale = np.maximum(np.trace(h, axis1=1, axis2=2), 1e-300)
    h, n = h / scale[:, None, None], n / scale[:, None]
    every = np.ones((g, m), bool)
    equal = 1 / (row[:, :, None] == row[:, None, :]).sum(axis=2)
    x = equal.copy() if start is None else start.copy()
    keep = x > 1e-9
    x = np.where(keep, x, 0)
    x = x / np.maximum(_row_means(x, every, row) / equal, 1e-300)
    solved, todo = np.zeros(g, bool), np.arange(g)
    for _ in range(8 * m + 20):
        if not len(todo):
            break
        hh, nn, rr, kk, xx = h[todo], n[todo], row[todo], keep[todo], x[todo]
        grad = nn - np.einsum("gij,gj->gi", hh, xx)
        inverse, _ = _split(hh, _sum_free(kk, rr))
        step = np.einsum("gij,gj->gi", inverse, grad)
        down = kk & (step < -1e-15)
        reach = np.where(down, xx / np.where(down, -step, 1), np.inf)
        first = reach.argmin(axis=1)
        alpha = np.minimum(reach[np.arange(len(todo)), first], 1.0)
        xx = np.where(kk, np.maximum(xx + alpha[:, None] * step, 0), 0)
        blocked = alpha < 1
        kk[np.flatnonzero(blocked), first[blocked]] = False
        xx = np.where(kk, xx, 0)
        grad = np.einsum("gij,gj->gi", hh, xx) - nn
        wish = np.where(kk, 0, _row_means(grad, kk, rr) - grad)
        most = wish.argmax(axis=1)
        wants = ~blocked & (wish[np.arange(len(todo)), most] > 1e-12)
        kk[np.flatnonzero(wants), most[wants]] = True
        x[todo], keep[todo] = xx, kk
        done = ~blocked & ~wants
        solved[todo[done]] = True
        todo = todo[~done]
    return _nearest_to_equal(h, n, row, x, keep, equal), solved


def _nearest_to_equal(h: np.ndarray, n: np.ndarray, row: np.ndarray, x: np.ndarray, keep: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Among the weights with the same least value the nearest to equal ones:
    Dykstra's alternation between the flat directions and x >= 0, for the groups that have any."""
    grad = np.einsum("gij,gj->gi", h, x) - n
    free = keep | (grad - _row_means(grad, keep, row) < 1e-10)
    _, flat = _split(h, _sum_free(free, row))
    some = np.flatnonzero(np.trace(flat, axis1=1, axis2=2) > 0.5)
    if not len(some):
        return x
    flat, base, goal, free = flat[some], x[some], equal[some], free[some]
    now, owed = goal.copy(), np.zeros_like(goal)
    for _ in range(2000):
        on = base + np.einsum("gij,gj->gi", flat, now - base)
        new = np.where(free, np.maximum(on + owed, 0), 0)
        owed = on + owed - new
        moved = np.abs(new - now).max()
        now = new
        if moved < 1e-14:
            break
    x[some] = now
    return x


# ------------------------------------------------------------------- sparse
def project_rows(z: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each code's links projected on the simplex; links are sorted by code, and
    ``start`` has where each code's begin."""
    order = np.lexsort((-z, row))
    size = np.diff(np.append(start, len(z)))
    u = z[order]
    total = np.cumsum(u)
    before = np.repeat(total[start] - u[start], size)
    k = np.arange(len(z)) - np.repeat(start, size) + 1
    theta = (total - before - 1) / k
    ok = u > theta
    last = np.maximum.reduceat(np.where(ok, np.arange(len(z)), 0), start)
    return np.maximum(z - np.repeat(theta[last], size), 0)


def sparse_fit(i: np.ndarray, k: np.ndarray, value: np.ndarray, n: np.ndarray, row: np.ndarray, target: np.ndarray, start: np.ndarray | None = None, tol: float = 1e-10, most: int = 50_000) -> tuple[np.ndarray, bool]:
    """(weights, solved) of one large group: moments (i, k, value) between codes,
    ``n`` of each link, links sorted by ``row``.

    H is kept as its entries between links of one target. A diagonal of its row
    sums majorises it, as moments are not negative; so all codes step at once,
    each by its own length, and the value does not rise; steps gather speed and
    start afresh when they point uphill."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
    links_of = {int(r): np.arange(s, e) for r, s, e in zip(row[first], first, np.append(first[1:], len(row)))}
    a, b, v = [], [], []
    by_target: dict[int, dict[int, int]] = {}
    for link, (r, t) in enumerate(zip(row.tolist(), target.tolist())):
        by_target.setdefault(t, {})[r] = link
    for p, q, m in zip(i.tolist(), k.tolist(), value.tolist()):
        for link in links_of.get(p, ()):
            other = by_target[int(target[link])].get(q)
            if other is not None:
                a.append(link), b.append(other), v.append(m)
    a, b, v = np.array(a, np.int64), np.array(b, np.int64), np.array(v)
    weight = np.maximum.reduceat(np.bincount(a, v, len(row)), first)  # of the target with the largest sum
    step = np.repeat(np.divide(1, weight, out=np.zeros(len(first)), where=weight > 0), np.diff(np.append(first, len(row))))
    gradient = lambda x: np.bincount(a, v * x[b], len(row)) - n
    x = 1 / np.repeat(np.diff(np.append(first, len(row))), np.diff(np.append(first, len(row)))) if start is None else start
    y, t = x, 1.0
    for _ in range(most):
        new = project_rows(y - step * gradient(y), at, first)
        if np.sum((y - new) * (new - x)) > 0:
            y, t = x, 1.0
            new = project_rows(y - step * gradient(y), at, first)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, moved, x, t = new + (t - 1) / s * (new - x), np.abs(new - x).max(), new, s
        if moved < tol:
            return x, True
    return x, False


# -------------------------------------------------------------------- Spark
GROUP = ["period", "direction", "group_id"]


def link_table(oriented: DataFrame) -> DataFrame:
    """GROUP..., from_code, to_code, n_to (links of the code), n_free (codes of
    the group with several), n_links."""
    of = oriented.select(*GROUP, "from_code", "to_code")
    codes = of.groupBy(*GROUP, "from_code").agg(F.count(F.lit(1)).alias("n_to"))
    sizes = codes.groupBy(*GROUP).agg(F.count(F.when(F.col("n_to") > 1, 1)).alias("n_free"), F.sum("n_to").alias("n_links"))
    return of.join(codes, [*GROUP, "from_code"]).join(sizes, GROUP)


def fixed_links(links: DataFrame, key: list[str]) -> DataFrame:
    """key..., from_code, to_code, weight of the codes with one link."""
    return links.where("n_to = 1").select(*key, "from_code", "to_code", F.lit(1.0).alias("weight"))


def one_free_code(links: DataFrame, moments: DataFrame, key: list[str]) -> DataFrame:
    """The weights of groups where one code has several links, in SQL: what the
    fixed codes explain is taken from N, and the rest over M projected on the simplex."""
    single = links.where("n_free = 1")
    free = single.where("n_to > 1").select(*key, "from_code", "to_code")
    code = free.select(*key, F.col("from_code").alias("i")).distinct()
    own = moments.where("kind <> 'y'").join(code, [*key, "i"])
    of_n = own.where("kind = 'n'").select(*key, F.col("j").alias("to_code"), "value")
    others = single.where("n_to = 1").select(*key, F.col("from_code").alias("j"), "to_code")
    of_m = own.where("kind = 'm' and i <> j").join(others, [*key, "j"]).select(*key, "to_code", (-F.col("value")).alias("value"))
    term = of_n.unionByName(of_m).groupBy(*key, "to_code").agg(F.sum("value").alias("term"))
    m = own.where("kind = 'm' and i = j").select(*key, F.col("value").alias("m"))
    z = free.join(m, key, "left").join(term, [*key, "to_code"], "left")
    z = z.withColumn("z", F.when(F.col("m") > 0, F.coalesce("term", F.lit(0.0)) / F.col("m")))
    own_row = [*key, "from_code"]
    w = W.partitionBy(*own_row).orderBy(F.desc("z"), "to_code")
    z = z.withColumns({"k": F.row_number().over(w), "css": F.sum("z").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1})
    used = F.col("z") * F.col("k") > F.col("css")
    theta = F.max_by(F.when(used, F.col("css") / F.col("k")), F.when(used, F.col("k"))).over(W.partitionBy(*own_row))
    n = F.count(F.lit(1)).over(W.partitionBy(*own_row))
    weight = F.when(F.col("z").isNull(), 1.0 / n).otherwise(F.greatest(F.col("z") - theta, F.lit(0.0)))
    free = z.select(*key, "from_code", "to_code", weight.alias("weight"))
    return free.unionByName(fixed_links(single, key))


def several_free_codes(links: DataFrame, moments: DataFrame, key: list[str], start: DataFrame | None = None) -> DataFrame:
    """key..., from_code, to_code, weight, status of groups where more codes have
    several links. ``start`` (key..., from_code, to_code, weight) is where the search begins."""
    hard = links.where("n_free > 1")
    fits = checkpointed(hard.select(*key).distinct().withColumn("fit", F.monotonically_increasing_id()))
    hard = hard.join(fits, key)
    order = W.partitionBy("fit").orderBy("from_code", "to_code")
    # numbers of codes in order, of both ends of each link; a group's links are one window
    hard = hard.withColumns({"row": F.dense_rank().over(W.partitionBy("fit").orderBy("from_code")), "target": F.dense_rank().over(W.partitionBy("fit").orderBy("to_code")), "link": F.row_number().over(order)})
    if start is not None:
        hard = hard.join(start.select(*key, "from_code", "to_code", F.col("weight").alias("start")), [*key, "from_code", "to_code"], "left")
    else:
        hard = hard.withColumn("start", F.lit(None).cast("double"))
    hard = checkpointed(hard.select("fit", *key, "from_code", "to_code", "n_links", "row", "target", "link", "start"))
    size = hard.select("fit", "n_links").distinct()
    rows = moments.where("kind <> 'y'").join(fits, key).select("fit", "kind", "i", "j", "value")
    froms = hard.select("fit", F.col("from_code").alias("i"), F.col("row").alias("a")).distinct()
    other = hard.select("fit", F.col("from_code").alias("j"), F.col("row").alias("b")).distinct()
    to = hard.select("fit", F.col("to_code").alias("j"), F.col("target").alias("b")).distinct()
    rows = rows.join(froms, ["fit", "i"])
    rows = rows.where("kind = 'm'").join(other, ["fit", "j"]).unionByName(rows.where("kind = 'n'").join(to, ["fit", "j"]))
    rows = rows.join(size, "fit").select("n_links", "fit", F.when(F.col("kind") == "m", 1).otherwise(2).alias("kind"), "a", "b", "value")
    own = hard.select("n_links", "fit", F.lit(0).alias("kind"), F.col("row").alias("a"), F.col("target").alias("b"), F.col("start").alias("value"))
    every = own.unionByName(rows).repartition("fit").sortWithinPartitions("n_links", "fit", "kind", "a", "b")
    found = every.mapInPandas(_solve, "fit long, link int, weight double, solved boolean")
    out = hard.join(found, ["fit", "link"])
    return out.select(*key, "from_code", "to_code", "weight", F.when(F.col("solved"), "solved").otherwise("max_iter").alias("status"))


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fits from rows sorted by number of links and fit; whole fits at a time."""
    held = None
    for b in batches:
        held = b if held is None else pd.concat([held, b], ignore_index=True)
        last = (held["fit"] == held["fit"].iloc[-1]).to_numpy()
        ready = held[~last]
        if len(ready) * FEW > BATCH:
            yield from _solved(ready)
            held = held[last]
    if held is not None and len(held):
        yield from _solved(held)


def _solved(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for m, part in rows.groupby("n_links", sort=False):
        if m > FEW:
            for _, one in part.groupby("fit", sort=False):
                yield _solved_sparse(one)
            continue
        fits = part["fit"].to_numpy()
        cut = np.flatnonzero(np.diff(fits, prepend=fits[0] - 1))
        at_once = max(1, BATCH // (m * m))
        for s in range(0, len(cut), at_once):
            stop = cut[s + at_once] if s + at_once < len(cut) else len(fits)
            yield _solved_batch(part.iloc[cut[s] : stop], m)


def _solved_batch(part: pd.DataFrame, m: int) -> pd.DataFrame:
    fit, at = np.unique(part["fit"].to_numpy(), return_inverse=True)
    kind, a, b, value = (part[c].to_numpy() for c in ("kind", "a", "b", "value"))
    own, g = kind == 0, len(fit)
    row, target = a[own].reshape(g, m), b[own].reshape(g, m)
    start = value[own].astype(float).reshape(g, m)
    moment, cross = np.zeros((g, m + 1, m + 1)), np.zeros((g, m + 1, m + 1))
    moment[at[kind == 1], a[kind == 1], b[kind == 1]] = value[kind == 1]
    cross[at[kind == 2], a[kind == 2], b[kind == 2]] = value[kind == 2]
    i = np.arange(g)[:, None]
    h = moment[i[:, :, None], row[:, :, None], row[:, None, :]] * (target[:, :, None] == target[:, None, :])
    x, solved = dense_fits(h, cross[i, row, target], row, None if np.isnan(start).any() else start)
    return pd.DataFrame({"fit": np.repeat(fit, m), "link": np.tile(np.arange(1, m + 1), g), "weight": x.ravel(), "solved": np.repeat(solved, m)})


def _solved_sparse(one: pd.DataFrame) -> pd.DataFrame:
    kind, a, b, value = (one[c].to_numpy() for c in ("kind", "a", "b", "value"))
    own, m, n = kind == 0, kind == 1, kind == 2
    row, target, start = a[own], b[own], value[own].astype(float)
    place = {p: k for k, p in enumerate(zip(row.tolist(), target.tolist()))}
    cross = np.zeros(len(row))
    for i, j, v in zip(a[n].tolist(), b[n].tolist(), value[n].tolist()):
        if (i, j) in place:
            cross[place[i, j]] = v
    x, solved = sparse_fit(a[m], b[m], value[m], cross, row, target, None if np.isnan(start).any() else start)
    return pd.DataFrame({"fit": one["fit"].iloc[0], "link": np.arange(1, len(row) + 1), "weight": x, "solved": solved})


# ------------------------------------------------------------ refits by bin
#: Rows of sums that a task takes at a time.
ROWS = 1 << 19


def bin_fits(sums: DataFrame, key: list[str], runs: list[int]) -> DataFrame:
    """key..., from_code, to_code, weights, solved of groups of few links: the weight without
    each bin of ``runs``, null where a side is then left without trade. ``sums`` (key..., kind, bin,
    i, j, v) has whole groups in a partition, sorted by key: links (kind 0), sums by
    bin of raw products (1: from by from, 2: from by to) and of values (3: from, 4: to)."""
    out = ", ".join([*[f"{k} string" for k in (*key, "from_code", "to_code")], "weights array<double>", "solved boolean"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                table = pa.Table.from_batches(held)
                cut = int(_groups_of(table, key)[1][-1])  # the last group may go on
                if cut:
                    yield from _bins_solved(table.slice(0, cut), key, runs)
                held = table.slice(cut).combine_chunks().to_batches()
                n = table.num_rows - cut
        if n:
            yield from _bins_solved(pa.Table.from_batches(held), key, runs)

    return sums.mapInArrow(solve, out)


def _groups_of(table: pa.Table, key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group, and where groups start; rows are sorted by key."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in key:
        at = table[k].combine_chunks().dictionary_encode()
        at = (at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at).indices.to_numpy()
        new[1:] |= at[1:] != at[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _bins_solved(table: pa.Table, key: list[str], runs: list[int]) -> Iterator[pa.RecordBatch]:
    group, first = _groups_of(table, key)
    kind, bins, v = (table[c].to_numpy() for c in ("kind", "bin", "v"))
    codes = pa.chunked_array(table["i"].chunks + table["j"].chunks, pa.string()).combine_chunks().dictionary_encode()
    place = np.argsort(np.argsort(np.array(codes.dictionary.to_pylist(), dtype=object)))[codes.indices.to_numpy()]
    i, j, wide = place[: len(v)], place[len(v) :], len(codes.dictionary)
    traded = np.zeros(len(first), bool)
    traded[group[kind > 0]] = True
    own = np.flatnonzero((kind == 0) & traded[group])
    if not len(own):
        return
    own = own[np.lexsort((j[own], i[own], group[own]))]
    side = {}  # numbers of codes within their group, from 0
    for name, at in (("from", i), ("to", j)):
        names = np.unique(group[own].astype(np.int64) * wide + at[own])
        start = np.searchsorted(names, np.arange(len(first), dtype=np.int64) * wide)
        side[name] = lambda r, x, names=names, start=start: np.searchsorted(names, group[r].astype(np.int64) * wide + x[r]) - start[group[r]]
    row, target = side["from"](own, i), side["to"](own, j)
    n_links = np.bincount(group[own], minlength=len(first))
    link = np.concatenate([[0], np.cumsum(n_links)])  # where a group's links start
    run = np.searchsorted(runs, bins)
    weights, solved = np.full((len(own), len(runs)), np.nan), np.zeros(len(own), bool)
    for m in np.unique(n_links[n_links > 0]):
        every = np.flatnonzero(n_links == m)
        codes_of = int(max(row[(n_links == m)[group[own]]].max(), target[(n_links == m)[group[own]]].max())) + 1
        at_once = max(1, BATCH // (len(runs) * max(m * m, codes_of * codes_of)))
        for s in range(0, len(every), at_once):
            some = every[s : s + at_once]
            number = np.full(len(first), -1)
            number[some] = np.arange(len(some))
            lo, hi = first[some[0]], first[some[-1] + 1] if some[-1] + 1 < len(first) else len(v)
            r = lo + np.flatnonzero((number[group[lo:hi]] >= 0) & (kind[lo:hi] > 0))
            shape = (len(some), len(runs), codes_of, codes_of)
            moment, cross, sums = np.zeros(shape), np.zeros(shape), np.zeros((2, len(some), len(runs)))
            for k, into, other in ((1, moment, ("from", j)), (2, cross, ("to", j))):
                e = r[kind[r] == k]
                into[number[group[e]], run[e], side["from"](e, i), side[other[0]](e, other[1])] = v[e]
            for k in (3, 4):
                e = r[kind[r] == k]
                sums[k - 3, number[group[e]], run[e]] = v[e]
            held = np.zeros((len(some), len(runs)), bool)
            held[number[group[r]], run[r]] = True
            links = link[some][:, None] + np.arange(m)
            x, ok = _without_each(moment, cross, sums[0], sums[1], held, row[links], target[links])
            weights[links] = x.transpose(0, 2, 1)
            solved[links] = ok[:, None]
    out = {k: table[k].take(pa.array(own)) for k in key} | {"from_code": table["i"].take(pa.array(own)), "to_code": table["j"].take(pa.array(own))}
    flat = pa.array(weights.ravel(), pa.float64(), from_pandas=True)  # NaN is null
    out["weights"] = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(runs)), flat)
    yield from pa.table(out | {"solved": pa.array(solved)}).to_batches()


def _others(x: np.ndarray) -> np.ndarray:
    """Sums over the other bins (axis 1): what is before and what is after, not a difference,
    whose rounding would hide that codes can't be told apart."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    np.cumsum(x[:, :-1], axis=1, out=before[:, 1:])
    after[:, :-1] = np.cumsum(x[:, :0:-1], axis=1)[:, ::-1]
    return before + after


def _without_each(moment: np.ndarray, cross: np.ndarray, tx: np.ndarray, ty: np.ndarray, held: np.ndarray, row: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights (groups, bins, links), solved (groups)): the full fit, and from there the fits
    without each bin that holds pairs of the group; NaN where a side is left without trade."""
    g, n_bins = held.shape
    m = row.shape[1]
    at = np.arange(g)[:, None]
    same = target[:, :, None] == target[:, None, :]

    def terms(mom: np.ndarray, cro: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.arange(len(mom))[:, None]
        h = mom[n[:, :, None], row[of][:, :, None], row[of][:, None, :]] * same[of] / (a * a)[:, None, None]
        return h, cro[n, row[of], target[of]] / (a * b)[:, None]

    full, solved = _fits_of(*terms(moment.sum(axis=1), cross.sum(axis=1), tx.sum(axis=1), ty.sum(axis=1), at[:, 0]), row)
    weights = np.repeat(full[:, None, :], n_bins, axis=1)
    other_x, other_y = _others(tx), _others(ty)
    emptied = held & ~((other_x > 0) & (other_y > 0))
    weights[emptied] = np.nan
    of, b = np.nonzero(held & ~emptied)
    if len(of):
        h, n = terms(_others(moment)[of, b], _others(cross)[of, b], other_x[of, b], other_y[of, b], of)
        x, ok = _fits_of(h, n, row[of], full[of])
        weights[of, b] = x
        np.logical_and.at(solved, of, ok)
    return weights, solved


def _fits_of(h: np.ndarray, n: np.ndarray, row: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Groups where one code has several links in closed form, as ``one_free_code``; others by ``dense_fits``."""
    several = (row[:, :, None] == row[:, None, :]).sum(axis=2) > 1
    lowest = np.where(several, row, row.max() + 1).min(axis=1)
    single = ~(several & (row != lowest[:, None])).any(axis=1)
    x, solved = np.ones(n.shape), np.ones(len(n), bool)
    if single.any():
        x[single] = _one_free(h[single], n[single], several[single])
    if not single.all():
        rest = ~single
        x[rest], solved[rest] = dense_fits(h[rest], n[rest], row[rest], None if start is None else start[rest])
    return x, solved


def _one_free(h: np.ndarray, n: np.ndarray, free: np.ndarray) -> np.ndarray:
    own = np.where(free, np.diagonal(h, axis1=1, axis2=2), 0).max(axis=1)  # the code's own moment, on each of its links
    z = n - (h * ~free[:, None, :]).sum(axis=2)
    z = np.where(free, z / np.where(own > 0, own, 1)[:, None], -np.inf)
    u = -np.sort(-z, axis=1)
    k = np.arange(1, z.shape[1] + 1)
    css = np.cumsum(np.where(np.isfinite(u), u, 0), axis=1) - 1
    used = np.isfinite(u) & (u * k > css)
    last = np.where(used, k, 1).max(axis=1)
    theta = css[np.arange(len(z)), last - 1] / last
    equal = 1 / np.maximum(free.sum(axis=1), 1)
    fitted = np.where(own[:, None] > 0, np.maximum(z - theta[:, None], 0), equal[:, None])
    return np.where(free, fitted, 1.0)
