"""The additive model against plain loops over rows, bins and cuts: tables, pairs and scores."""

from itertools import pairwise
from math import exp, log

import numpy as np
import pytest

from millrace.llm import gam


def quantiles(values, bins):
    ordered, out = sorted(values), set()
    for i in range(1, bins):
        at = (len(ordered) - 1) * (i / bins)
        low = int(at)
        high = min(low + 1, len(ordered) - 1)
        out.add(ordered[low] + (ordered[high] - ordered[low]) * (at - low))
    return sorted(out)


def bin_of(edges, value):
    return sum(e <= value for e in edges)


def worth(g, h):
    return g * g / (h + gam.RIDGE)


def best_cut(g, h):
    """(gain, cut) of a line of bins; a cut of 0 is none."""
    best = (worth(sum(g), sum(h)), 0)
    for c in range(1, len(g)):
        gain = worth(sum(g[:c]), sum(h[:c])) + worth(sum(g) - sum(g[:c]), sum(h) - sum(h[:c]))
        if gain > best[0]:
            best = (gain, c)
    return best


def leaves(g, h, cuts):
    out = []
    for a, b in pairwise([0, *sorted(c for c in cuts if 0 < c < len(g)), len(g)]):
        out += [sum(g[a:b]) / (sum(h[a:b]) + gam.RIDGE)] * (b - a)
    return out


def line(g, h):
    cut = best_cut(g, h)[1]
    cuts = {cut}
    for a, b in ((0, cut), (cut, len(g))):
        if b - a > 1:
            cuts.add(a + best_cut(g[a:b], h[a:b])[1])
    return leaves(g, h, cuts)


def plane(g, h):
    best, out = -1.0, None
    for turned in (False, True):
        a, b = ([list(r) for r in zip(*m, strict=True)] for m in (g, h)) if turned else (g, h)
        for c in range(1, len(a)):
            sides = [([sum(col) for col in zip(*a[s], strict=True)], [sum(col) for col in zip(*b[s], strict=True)], len(a[s])) for s in (slice(c), slice(c, None))]
            cuts = [best_cut(x, y) for x, y, _ in sides]
            if cuts[0][0] + cuts[1][0] > best + 1e-12:
                best = cuts[0][0] + cuts[1][0]
                rows = [leaves(x, y, [cut]) for (x, y, n), (_, cut) in zip(sides, cuts, strict=True) for _ in range(n)]
                out = [list(r) for r in zip(*rows, strict=True)] if turned else rows
    return out


def plain_fit(x, y):
    n, width = len(x), len(x[0])
    odds = [log((sum(y) + 1) / (n - sum(y) + 1))] * n
    base = odds[0]

    def slopes(cells, size):
        g, h = [0.0] * size, [0.0] * size
        for i, c in enumerate(cells):
            p = 1 / (1 + exp(-odds[i]))
            g[c] += y[i] - p
            h[c] += p * (1 - p)
        return g, h

    fine = [quantiles([r[f] for r in x], gam.BINS) for f in range(width)]
    rough = [quantiles([r[f] for r in x], gam.PAIR_BINS) for f in range(width)]
    tables = [[0.0] * (len(e) + 1) for e in fine]
    bins = [[bin_of(e, r[f]) for r in x] for f, e in enumerate(fine)]
    for _ in range(gam.CYCLES):
        for f in range(width):
            step = [gam.RATE * s for s in line(*slopes(bins[f], len(tables[f])))]
            tables[f] = [a + b for a, b in zip(tables[f], step, strict=True)]
            odds[:] = [o + step[b] for o, b in zip(odds, bins[f], strict=True)]
    coarse = [[bin_of(e, r[f]) for r in x] for f, e in enumerate(rough)]
    size = [len(e) + 1 for e in rough]
    cells = {(a, b): [i * size[b] + j for i, j in zip(coarse[a], coarse[b], strict=True)] for a in range(width) for b in range(a + 1, width)}
    strength = {p: sum(map(worth, *slopes(c, size[p[0]] * size[p[1]]))) for p, c in cells.items()}
    pairs = sorted(strength, key=lambda p: (-strength[p], p))[: gam.PAIRS]
    planes = {p: [[0.0] * size[p[1]] for _ in range(size[p[0]])] for p in pairs}
    for _ in range(gam.PAIR_CYCLES):
        for p in pairs:
            g, h = ([s[i : i + size[p[1]]] for i in range(0, len(s), size[p[1]])] for s in slopes(cells[p], size[p[0]] * size[p[1]]))
            step = plane(g, h)
            planes[p] = [[v + gam.RATE * s for v, s in zip(vs, ss, strict=True)] for vs, ss in zip(planes[p], step, strict=True)]
            odds[:] = [o + gam.RATE * step[i][j] for o, i, j in zip(odds, coarse[p[0]], coarse[p[1]], strict=True)]

    filled = {p: {(coarse[p[0]][i], coarse[p[1]][i]) for i in range(n)} for p in pairs}
    return base, fine, rough, tables, pairs, planes, filled


def plain_score(row, base, fine, rough, tables, pairs, planes):
    total = base + sum(t[bin_of(e, v)] for t, e, v in zip(tables, fine, row, strict=True))
    total += sum(planes[a, b][bin_of(rough[a], row[a])][bin_of(rough[b], row[b])] for a, b in pairs)
    return 1 / (1 + exp(-total))


@pytest.mark.parametrize("seed", [2, 5])
def test_tables_and_scores_are_those_of_plain_loops(seed, monkeypatch):
    """200 rows of five numbers: one nearly constant, one of many ties; a dozen cycles, as loops over rows are slow."""
    monkeypatch.setattr(gam, "CYCLES", 12)
    monkeypatch.setattr(gam, "PAIR_CYCLES", 6)
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=200), rng.integers(0, 9, 200), rng.normal(size=200), rng.exponential(size=200), rng.random(200) < 0.02]).astype(float)
    y = (np.abs(x[:, 0]) + (x[:, 1] > 4) * (x[:, 2] > 0) + rng.normal(size=200) / 3 > 1.2).astype(float)
    model = gam.fit(x, y)
    base, fine, rough, tables, pairs, planes, filled = plain_fit(x.tolist(), y.tolist())
    assert model.pairs == pairs
    for mine, plain in zip(model.tables, tables, strict=True):
        assert np.allclose(mine, plain, atol=1e-9)
    for mine, pair in zip(model.planes, pairs, strict=True):  # cells without rows may be on either side of cuts of equal gain
        assert all(abs(mine[i, j] - planes[pair][i][j]) < 1e-9 for i, j in filled[pair])
    assert np.allclose(model.score(x), [plain_score(r, base, fine, rough, tables, pairs, planes) for r in x.tolist()], atol=1e-9)
    other, own = rng.normal(size=(50, 5)) * 3, dict(zip(model.pairs, model.planes, strict=True))
    assert np.allclose(model.score(other), [plain_score(r, base, fine, rough, tables, pairs, own) for r in other.tolist()], atol=1e-9)
