"""Plain single-machine versions of the clustering steps, to compare with on small inputs."""

import numpy as np


def distances(x):
    return np.abs(x[:, None, :] - x[None, :, :]).max(axis=2)


def tree_weight(x):
    """Total weight of the minimum spanning tree, by Kruskal over all pairs."""
    d = distances(x)
    n = len(x)
    edges = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    comp = list(range(n))
    total = 0.0
    for w, i, j in edges:
        if comp[i] != comp[j]:
            old, new = comp[j], comp[i]
            comp = [new if c == old else c for c in comp]
            total += w
    return total


def optics_plot(x):
    """Order, reachability and predecessor position; rows must be sorted as the operator sorts them.

    Reachability is max(core distance of the predecessor, distance), as defined
    for two samples per core point. Ties go to the smaller pair of rows.
    """
    d = distances(x)
    n = len(x)
    core = np.array([np.delete(d[i], i).min() for i in range(n)]) if n > 1 else np.zeros(1)
    order, reach, pred = [0], [np.inf], [-1]
    where = {0: 0}
    while len(order) < n:
        best = min(
            (max(core[p], d[p, o]), min(p, o), max(p, o), p, o)
            for p in order
            for o in range(n)
            if o not in where
        )
        w, _, _, p, o = best
        where[o] = len(order)
        order.append(o)
        reach.append(w)
        pred.append(where[p])
    return order, np.array(reach), np.array(pred)


def _areas(r, xi, gap):
    """Steep areas found by walking the plot one point at a time."""
    n = len(r) - 1

    def kind(i):
        if r[i] == r[i + 1]:
            return "flat"
        if r[i] > r[i + 1]:
            return "DOWN" if r[i + 1] == 0 or r[i] / r[i + 1] >= 1 / (1 - xi) else "down"
        return "UP" if r[i] / r[i + 1] <= 1 - xi else "up"

    kinds = [kind(i) for i in range(n)]
    out, i = [], 0
    while i < n:
        if kinds[i] not in ("DOWN", "UP"):
            i += 1
            continue
        steep = kinds[i]
        bad = ("up", "UP") if steep == "DOWN" else ("down", "DOWN")
        end, quiet, j = i, 0, i + 1
        while j < n and kinds[j] not in bad:
            quiet = 0 if kinds[j] == steep else quiet + 1
            if quiet > gap:
                break
            if kinds[j] == steep:
                end = j
            j += 1
        out.append((i, end, steep))
        i = end + 1
    return out


def xi_clusters(reach, pred, xi=0.05, gap=2, min_size=2):
    """Labels by trying every pair of a steep-down and a later steep-up area."""
    r = np.append(reach, np.inf)
    n = len(reach)
    areas = _areas(r, xi, gap)
    labels = np.full(n, -1)
    label = 0
    for k, (us, ue, kind) in enumerate(areas):
        if kind != "UP":
            continue
        for ds, de, other in reversed(areas[:k]):
            if other != "DOWN":
                continue
            level, top = r[ue + 1], r[ds]
            # still open: at every later area the points since then stay low enough
            high = max(r[de + 1 : us + 1])
            if high > top * (1 - xi) or high > level * (1 - xi):
                continue
            c0, c1 = ds, ue
            if top * (1 - xi) >= level:
                while r[c0 + 1] > level and c0 < de:
                    c0 += 1
            elif level * (1 - xi) >= top:
                while r[c1 - 1] > top and c1 > us:
                    c1 -= 1
            while c1 > c0 and not (r[c0] > r[c1] or c0 <= pred[c1] < c1):
                c1 -= 1
            if c1 <= c0 or c1 - c0 + 1 < min_size or c0 > de or c1 < us:
                continue
            if (labels[c0 : c1 + 1] == -1).all():
                labels[c0 : c1 + 1] = label
                label += 1
    return labels
