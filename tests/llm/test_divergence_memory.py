import tracemalloc

import numpy as np
import pyarrow as pa

from flowseg.llm import divergence


def _shard_of(n_sources, n_terms, seed):
    rng = np.random.default_rng(seed)
    names = [f"s{i:03d}" for i in range(n_sources)]
    term = np.repeat(np.arange(n_terms), 2)
    source = np.stack([rng.permutation(n_sources)[:2] for _ in range(n_terms)]).ravel()
    n = rng.integers(1, 50, len(term))
    entries = pa.table({"lang": ["x"] * len(term), "source": [names[s] for s in source], "term": [f"t{t:06d}" for t in term], "n": n})
    totals = np.bincount(source, weights=n, minlength=n_sources).astype(np.int64)
    groups = pa.table({"lang": ["x"] * n_sources, "source": names, "total": totals, "vocabulary": np.full(n_sources, n_terms)})
    return entries, groups


def _sorted(table):
    return sorted(tuple(r.values()) for r in table.to_pylist())


def test_runs_of_terms_give_the_same_shard(monkeypatch):
    entries, groups = _shard_of(7, 90, 1)
    whole = _sorted(divergence._shard(None, entries, groups))
    monkeypatch.setattr(divergence, "CELLS", 30)
    assert _sorted(divergence._shard(None, entries, groups)) == whole


def test_many_sources_do_not_fill_a_task():
    entries, groups = _shard_of(80, 30_000, 2)
    tracemalloc.start()
    divergence._shard(None, entries, groups)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
