"""Numeric kernels that run inside tasks, on one sample or a batch of cells."""

from __future__ import annotations

import numpy as np

from cohortlens.functions.sparse import DENSE, SparseRows


#: Columns up to which the sweeps of ``mixture_em`` run on dense rows.
NARROW = 256


def average_ranks(rows: np.ndarray) -> np.ndarray:
    """Ranks from 1 along each row, ties at their mean."""
    out = np.empty(rows.shape)
    for r, row in zip(out, rows):
        _, inverse, counts = np.unique(row, return_inverse=True, return_counts=True)
        r[:] = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return out


def rank_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spearman similarity of each row of ``a`` with each row of ``b``; constant rows give 0."""

    def scaled(x: np.ndarray) -> np.ndarray:
        r = average_ranks(x)
        r -= r.mean(1, keepdims=True)
        norm = np.sqrt((r * r).sum(1, keepdims=True))
        return np.divide(r, norm, out=np.zeros_like(r), where=norm > 0)

    return scaled(a) @ scaled(b).T


def assignment(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the one-to-one matching with the largest total gain; ``-inf`` is forbidden.

    Shortest augmenting paths with potentials, a row at a time.
    """
    if gain.shape[0] > gain.shape[1]:
        columns, rows = assignment(gain.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    finite = gain[np.isfinite(gain)]
    span = (finite.max() - finite.min() + 1) * (len(gain) + 1) if len(finite) else 1.0
    cost = np.where(np.isfinite(gain), -gain, span + abs(finite).max(initial=0.0))
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        shortest, back, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, reach = start, -1, 0.0
        visited = [(start, -1, 0.0)]
        while True:
            through = reach + cost[row] - u[row] - v
            better = ~used & (through < shortest)
            shortest[better], back[better] = through[better], column
            column = int(np.where(used, np.inf, shortest).argmin())
            used[column], reach = True, shortest[column]
            if owner[column] < 0:
                break
            row = owner[column]
            visited.append((row, column, reach))
        for r, c, at in visited:
            u[r] += reach - at
            if c >= 0:
                v[c] -= reach - at
        while column >= 0:
            before = back[column]
            owner[column] = start if before < 0 else owner[before]
            column = before
    rows = owner[owner >= 0]
    columns = np.flatnonzero(owner >= 0)
    order = np.argsort(rows)
    return rows[order], columns[order]


def thresholded_assignment(similarity: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Best matching in which each row may stay unmatched for a gain of ``least``."""
    n = len(similarity)
    dummies = np.full((n, n), -np.inf)
    np.fill_diagonal(dummies, least)
    rows, columns = assignment(np.hstack([similarity, dummies]))
    real = columns < similarity.shape[1]
    return rows[real], columns[real]


def _solved_alike(gram: np.ndarray, linear: np.ndarray, free: np.ndarray, total: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Minima over the free variables of each row, and the prices of the sum; rows with the same free variables are solved together."""
    out, price = np.zeros(linear.shape), np.zeros(len(linear))
    bits = np.packbits(free, axis=1)
    words = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8 if bits.shape[1] else 8))).view(np.uint64)  # one number sorts faster than a row of booleans
    _, first, kind = np.unique(words[:, 0] if words.shape[1] == 1 else words, axis=None if words.shape[1] == 1 else 0, return_index=True, return_inverse=True)
    patterns, order = free[first], np.argsort(kind.ravel(), kind="stable")
    for pattern, rows in zip(patterns, np.split(order, np.cumsum(np.bincount(kind.ravel(), minlength=len(patterns)))[:-1])):
        at = np.flatnonzero(pattern)
        if not len(at):
            continue
        system, right = gram[np.ix_(at, at)], linear[np.ix_(rows, at)]
        if total is not None:
            system = np.block([[system, np.ones((len(at), 1))], [np.ones((1, len(at))), np.zeros((1, 1))]])
            right = np.column_stack([right, np.full(len(rows), total)])
        found = np.linalg.lstsq(system, right.T, rcond=None)[0].T
        out[np.ix_(rows, at)] = found[:, : len(at)]
        if total is not None:
            price[rows] = found[:, -1]
    return out, price


def nonnegative_quadratics(gram: np.ndarray, linear: np.ndarray, total: float | None = None) -> np.ndarray:
    """min h'Gh/2 - b'h over h >= 0 (and sum(h) = total if given) for every row b of ``linear``: an active-set method on all rows in step.

    In each round every unfinished row either frees its steepest variable or
    moves to the minimum of its free ones, as far as none turns negative.
    """
    n, k = linear.shape
    free, h, price = np.zeros((n, k), bool), np.zeros((n, k)), np.zeros(n)
    if total is not None and n:
        free[np.arange(n), np.argmin(total * total * np.diag(gram) / 2 - total * linear, axis=1)] = True
        h, price = _solved_alike(gram, linear, free, total)
    scale = 1e-10 * np.maximum(1.0, np.abs(linear).max(1, initial=0.0))
    rounds = np.zeros(n, int)
    choosing, moving = np.arange(n), np.zeros(0, int)
    while len(choosing) or len(moving):
        if len(choosing):
            slope = linear[choosing] - h[choosing] @ gram - price[choosing][:, None]
            slope[free[choosing]] = -np.inf
            steepest = slope.argmax(1)
            going = (slope[np.arange(len(choosing)), steepest] > scale[choosing]) & (rounds[choosing] < 10 * k + 10)
            choosing, steepest = choosing[going], steepest[going]
            free[choosing, steepest] = True
            rounds[choosing] += 1
            moving = np.concatenate([moving, choosing])
        new, price[moving] = _solved_alike(gram, linear[moving], free[moving], total)
        falling = free[moving] & (new <= 0)
        inside = ~falling.any(1)
        h[moving[inside]] = new[inside]
        rows, new, falling = moving[~inside], new[~inside], falling[~inside]
        step = np.where(falling, h[rows] / np.maximum(h[rows] - new, 1e-300), np.inf).min(1, initial=np.inf)
        h[rows] += np.where(np.isfinite(step), step, 0.0)[:, None] * (new - h[rows])
        free[rows] &= ~(falling & (h[rows] <= 1e-14 * np.maximum(1.0, h[rows].max(1, initial=0.0))[:, None]))
        h[rows] = np.where(free[rows], h[rows], 0.0)
        some = free[rows].any(1)
        choosing, moving = np.concatenate([moving[inside], rows[~some]]), rows[some]
    return h


def nonnegative_quadratic(gram: np.ndarray, linear: np.ndarray, total: float | None = None) -> np.ndarray:
    """The same for one row."""
    return nonnegative_quadratics(gram, linear[None], total)[0]


def _dense_em(counts: np.ndarray, scale: np.ndarray, depth: np.ndarray, share: np.ndarray, max_iter: int, tol: float, dispersion: float | None) -> None:
    """The sweeps of ``mixture_em`` on few columns, in place; rows that have stopped leave once they are a quarter."""
    at, going = np.arange(len(counts)), np.ones(len(counts), bool)
    for _ in range(max_iter):
        now = share[at]
        mean = np.maximum(now @ scale.T, 1e-12)
        pull = counts / mean
        if dispersion is not None:
            pull /= 1 + dispersion * mean * np.maximum(depth, 1.0)[:, None]
        new = now * (pull @ scale)
        sums = new.sum(1, keepdims=True)
        new = np.divide(new, sums, out=now.copy(), where=sums > 0)
        share[at[going]] = new[going]
        going &= np.abs(new - now).max(1) > tol
        if not going.any():
            return
        if going.sum() < 0.75 * len(at):
            at, counts, depth, going = at[going], counts[going], depth[going], going[going]


def mixture_em(counts: SparseRows | np.ndarray, basis: np.ndarray, max_iter: int, tol: float, dispersion: float | None = None) -> np.ndarray:
    """Multiplicative EM for the shares of K programs in each row of counts; each row stops on its own.

    ``basis`` is genes x programs; with a dispersion, residuals are weighted by
    a negative-binomial variance. Only counts above 0 pull, so means are made
    there alone. Returns usages (shares times depth).
    """
    counts = SparseRows.of(counts) if isinstance(counts, np.ndarray) else counts
    scale = basis / np.maximum(basis.sum(0, keepdims=True), 1e-12)
    depth, k = counts.totals(), basis.shape[1]
    share = np.full((len(counts), k), 1.0 / k)
    if counts.width <= NARROW and len(counts) * counts.width <= DENSE:
        dense, step = np.asarray(counts), max(1, DENSE // 32 // max(1, counts.width))
        for i in range(0, len(dense), step):
            _dense_em(dense[i : i + step], scale, depth[i : i + step], share[i : i + step], max_iter, tol, dispersion)
        return share * depth[:, None]
    rows, places, found = counts.rows, counts.places, counts.found
    for _ in range(max_iter):
        if not len(rows):
            break
        mean = np.maximum(np.einsum("ij,ij->i", share[rows], scale[places]), 1e-12)
        weight = 1.0 if dispersion is None else 1 / (1 + dispersion * mean * np.maximum(depth[rows], 1.0))
        pull = SparseRows(len(share), len(scale), rows, places, found * weight / mean)
        going = np.unique(rows)
        new = share[going] * (pull @ scale)[going]
        sums = new.sum(1, keepdims=True)
        new = np.divide(new, sums, out=share[going].copy(), where=sums > 0)
        still = np.zeros(len(share), bool)
        still[going] = np.abs(new - share[going]).max(1) > tol
        share[going] = new
        if not still[going].all():
            rows, places, found = (x[still[rows]] for x in (rows, places, found))
    return share * depth[:, None]


def randomized_svd(x: np.ndarray, k: int, rng: np.random.Generator, power: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` singular triples (fewer, if the rank is lower); of x's height it makes the left vectors only."""
    step = max(1, DENSE // 4 // x.shape[1])

    def products(t: np.ndarray) -> np.ndarray:
        return sum(x[i : i + step].T @ (x[i : i + step] @ t) for i in range(0, len(x), step))

    sketch = rng.standard_normal((x.shape[1], min(min(x.shape), k + 10)))
    for _ in range(power):
        sketch = np.linalg.qr(products(sketch))[0]
    image = products(sketch)
    values, vectors = np.linalg.eigh(sketch.T @ image)  # x sketch / root has orthonormal columns
    kept = values > 1e-14 * max(values.max(), 1e-300)
    inverse = vectors[:, kept] / np.sqrt(values[kept])
    left, s, vt = np.linalg.svd(inverse.T @ image.T, full_matrices=False)
    return x @ (sketch @ inverse @ left)[:, :k], s[:k], vt[:k]


def start_halves(plus: np.ndarray, minus: np.ndarray, s: np.ndarray, vt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which signed half of each singular pair starts a program: signs of the left vectors (0: absolute), their scales, and the weights.

    ``plus`` and ``minus`` are the norms of the halves of the left vectors.
    """
    signs, scales, h = np.zeros(len(s)), np.zeros(len(s)), np.zeros(vt.shape)
    for j in range(len(s)):
        if j:
            halves = [(own * np.linalg.norm(np.maximum(sign * vt[j], 0)), own, sign) for own, sign in ((plus[j], 1), (minus[j], -1))]
            size, own, signs[j] = max(halves, key=lambda t: t[0])
            b = np.maximum(signs[j] * vt[j], 0)
        else:
            size, own, b = 1.0, np.hypot(plus[0], minus[0]), abs(vt[0])
        if size > 0:
            scales[j] = np.sqrt(s[j] * size) / max(own, 1e-300)
            h[j] = np.sqrt(s[j] * size) * b / max(np.linalg.norm(b), 1e-300)
    return signs, scales, h


def coordinate_sweep(target: np.ndarray, gram: np.ndarray, cross: np.ndarray, penalty: float, l1_ratio: float) -> float:
    """One sweep over the columns of ``target`` >= 0, in place, towards the least squares of cross - target gram; how far the slopes were from rest."""
    moved = 0.0
    gram = gram + penalty * (1 - l1_ratio) * np.eye(len(gram))
    for j in range(len(gram)):
        slope = target @ gram[:, j] - cross[:, j] + penalty * l1_ratio
        held = np.where(target[:, j] == 0, np.minimum(slope, 0), slope)
        moved += np.abs(held).sum()
        if gram[j, j] > 0:
            target[:, j] = np.maximum(target[:, j] - slope / gram[j, j], 0)
    return moved


def nmf(x: np.ndarray, k: int, seed: int, max_iter: int = 500, tol: float = 1e-4, alpha_w: float = 0.0, alpha_h: float = 0.0, l1_ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Non-negative factors W (rows x k) and H (k x columns) by cyclic coordinate descent, and the sweeps made.

    Starts from the signed halves of a seeded randomised SVD, with zeros filled by the mean.
    Penalties: ``alpha_w`` a column of x on W, ``alpha_h`` a row on H; ``l1_ratio`` of each is absolute, the rest squared.
    """
    rng = np.random.default_rng(seed)
    u, s, vt = randomized_svd(x, k, rng)
    u, s, vt = (np.pad(a, pad) for a, pad in ((u, ((0, 0), (0, k - len(s)))), (s, (0, k - len(s))), (vt, ((0, k - len(s)), (0, 0)))))
    plus, minus = (np.linalg.norm(np.maximum(a, 0), axis=0) for a in (u, -u))
    signs, scales, h = start_halves(plus, minus, s, vt)
    w = np.where(signs == 0, abs(u), np.maximum(signs * u, 0)) * scales
    w[w < 1e-12], h[h < 1e-12] = x.mean() / 100, x.mean() / 100
    on_w, on_h = alpha_w * x.shape[1], alpha_h * x.shape[0]

    first, done = None, 0
    ht = h.T.copy()
    for done in range(1, max_iter + 1):
        moved = coordinate_sweep(w, ht.T @ ht, x @ ht, on_w, l1_ratio) + coordinate_sweep(ht, w.T @ w, x.T @ w, on_h, l1_ratio)
        first = moved if first is None else first
        if first == 0 or moved / first <= tol:
            break
    return w, ht.T, done


def network_start(sizes: list[int], seed: int) -> np.ndarray:
    """Seeded first weights of a network, all layers in one array."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.r_[(rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b))), np.zeros(b)] for a, b in zip(sizes, sizes[1:])])


def network_layers(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and offsets of each layer."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def network_gradient(x: np.ndarray, y: np.ndarray, flat: np.ndarray, sizes: list[int], tanh: bool = False) -> np.ndarray:
    """Half the squared error summed over the rows, and its gradient by the weights, in one array."""
    layers = network_layers(flat, sizes)
    outs = [x]
    for i, (w, b) in enumerate(layers):
        z = outs[-1] @ w + b
        outs.append(z if i == len(layers) - 1 else np.tanh(z) if tanh else np.maximum(z, 0))
    error = outs[-1] - y
    loss, parts = float((error * error).sum()) / 2, []
    for i in range(len(layers) - 1, -1, -1):
        parts.append(np.r_[(outs[i].T @ error).ravel(), error.sum(0)])
        if i:
            error = (error @ layers[i][0].T) * (1 - outs[i] ** 2 if tanh else outs[i] > 0)
    return np.concatenate([[loss], *reversed(parts)])


def limited_memory_descent(evaluate, start: np.ndarray, max_iter: int, tol: float = 1e-4, memory: int = 10) -> np.ndarray:
    """Minimum of a smooth function near ``start``; ``evaluate`` gives value and gradient. Curvature comes from the last steps.

    Ends when the slope is at most ``tol``, or two steps in a row gain less than that share of the value.
    """
    at, (value, slope) = start, evaluate(start)
    slow = 0
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(slope).max() <= tol:
            break
        way, back = slope.copy(), []
        for s, y in reversed(steps):
            back.append(s @ way / (s @ y))
            way -= back[-1] * y
        if steps:
            way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1])
        for (s, y), b in zip(steps, reversed(back)):
            way += (b - y @ way / (s @ y)) * s
        size, drop = 1.0 if steps else min(1.0, 1 / np.abs(slope).sum()), way @ slope
        while True:
            new = at - size * way
            new_value, new_slope = evaluate(new)
            if new_value <= value - 1e-4 * size * drop or size < 1e-8:
                break
            size /= 2
        if size < 1e-8:
            break
        if (new - at) @ (new_slope - slope) > 1e-12:
            steps = [*steps, (new - at, new_slope - slope)][-memory:]
        slow = slow + 1 if value - new_value <= tol * abs(value) else 0
        at, value, slope = new, new_value, new_slope
        if slow > 1:
            break
    return at


def network_output(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], tanh: bool = False) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.tanh(x) if tanh else np.maximum(x, 0)
    return x
