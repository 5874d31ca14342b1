import collections
import random
from functools import lru_cache

import numpy as np
import pytest

from pairloom.operators import kernels


def brute(n, edges):
    near = [0] * n
    for a, b in edges:
        near[a] |= 1 << b
        near[b] |= 1 << a

    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        v = (left & -left).bit_length() - 1
        rest = left & ~(1 << v)
        out, x = best(rest), near[v] & rest
        while x:
            w = x & -x
            x ^= w
            out = max(out, 1 + best(rest & ~w))
        return out

    return best((1 << n) - 1)


def arrays(edges):
    return np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int)


MICRO = [
    (5, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)], 2),
    (3, [(0, 1), (1, 2), (0, 2)], 1),
    (5, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)], 2),
    (4, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], 2),
    (6, [(0, k) for k in range(1, 6)], 1),
    (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)], 3),
    (6, [(0, 1), (1, 2), (2, 3), (3, 4), (2, 4), (4, 5)], 3),
    (10, [(k, (k + 1) % 5) for k in range(5)] + [(k, k + 5) for k in range(5)] + [(5 + k, 5 + (k + 2) % 5) for k in range(5)], 5),
    (5, [], 0),
    (1000, [(k, k + 1) for k in range(999)], 500),
]
STRATEGIES = ("single_root", "forest", "forest_uf", "phased", "phased_ddfs")


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("init", ["none", "greedy", "greedy-md"])
def test_small_graphs(strategy, init):
    for n, edges, size in MICRO:
        mate, _ = kernels.solve(n, *arrays(edges), strategy, init)
        assert sum(m >= 0 for m in mate) == 2 * size


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_random_graphs_against_brute_force_with_certificates(strategy):
    r = random.Random(5)
    for _ in range(150):
        n = r.randint(2, 11)
        edges = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randint(0, 18))})
        for init in ("none", "greedy", "greedy-md"):
            mate, label = kernels.solve(n, *arrays(edges), strategy, init)
            size = sum(m >= 0 for m in mate) // 2
            assert size == brute(n, tuple(edges))
            assert all(m < 0 or mate[m] == v and tuple(sorted((v, m))) in set(edges) for v, m in enumerate(mate))
            odd = {v for v in range(n) if label[v] == kernels.ODD}
            root = list(range(n))

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in edges:
                if a not in odd and b not in odd:
                    root[find(a)] = find(b)
            comps = collections.Counter(find(v) for v in range(n) if v not in odd)
            assert size == (n + len(odd) - sum(c % 2 for c in comps.values())) // 2


def test_bipartite_against_brute_force_with_covers():
    r = random.Random(6)
    for _ in range(300):
        nl, nr = r.randint(1, 7), r.randint(1, 7)
        edges = sorted({(r.randrange(nl), r.randrange(nr)) for _ in range(r.randint(0, 14))})
        want = brute(nl + nr, tuple((a, nl + b) for a, b in edges))
        for init in ("none", "greedy", "greedy-md"):
            ml, mr, zl, zr = kernels.solve_bipartite(nl, nr, *arrays(edges), init)
            assert sum(m >= 0 for m in ml) == want == sum(m >= 0 for m in mr)
            assert all(not zl[a] or zr[b] for a, b in edges)
            assert want == sum(not z and m >= 0 for z, m in zip(zl, ml, strict=True)) + sum(zr)


def test_unknown_names_are_refused():
    with pytest.raises(ValueError):
        kernels.solve(1, *arrays([]), "nonsense")
    with pytest.raises(ValueError):
        kernels.solve(1, *arrays([]), "phased", "nonsense")


def test_only_layered_search_claims_fewer_phases():
    from pairloom.plans.benchmark import ALGORITHMS

    assert [name for name, _, cost, _ in ALGORITHMS if cost == "sqrt(V) E"] == ["layered"]
