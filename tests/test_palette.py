"""Contrasting colours against the rule applied step by step, and the benchmark summary after failures."""

import os
import random

import numpy as np
import pytest

from loomgrid.operators import palette
from loomgrid.sources import writers


def by_rule(names, near, lab):
    dist = lambda i, j: float(np.linalg.norm(np.array(lab[i]) - np.array(lab[j])))
    done = {}
    while len(done) < len(names):
        key = lambda n: (-sum(m in done for m in near.get(n, ())), -len(near.get(n, ())), n)
        name = min((n for n in names if n not in done), key=key)
        around = [done[n] for n in near.get(name, ()) if n in done]
        free = [k for k in range(len(names)) if k not in done.values()]
        done[name] = max(free, key=lambda k: (min((dist(k, j) for j in around), default=0.0), min((dist(k, j) for j in done.values()), default=0.0), -k))
    return done


def test_colours(spark):
    rng, names, edges, want = random.Random(1), [], [], {}
    lab = [(rng.uniform(0, 100), rng.uniform(-80, 80), rng.uniform(-80, 80)) for _ in range(12)]
    for c in range(20):
        own = [f"r{k}" for k in range(rng.randrange(1, 13))]
        near: dict = {}
        for a in own:
            for b in own:
                if a < b and rng.random() < 0.3:
                    edges.append((c, a, b))
                    near.setdefault(a, set()).add(b)
                    near.setdefault(b, set()).add(a)
        names += [(c, n) for n in own]
        want.update({(c, n): k for n, k in by_rule(own, near, lab).items()})
    regions, shared = spark.createDataFrame(names, "case_id int, region string"), spark.createDataFrame(edges, "case_id int, a string, b string")
    got = palette.contrast_colours(regions, shared, lab).collect()
    assert {(r.case_id, r.region): r.colour for r in got} == want and len(got) == len(want)
    with pytest.raises(Exception, match="palette"):
        palette.contrast_colours(regions, shared, lab[:2]).collect()


def test_summary_is_whole_after_a_failed_move(spark, tmp_path):
    folder = str(tmp_path / "summary")
    rows = lambda *r: spark.createDataFrame(list(r), "case_id int, v int")
    writers.summary(rows((1, 1), (2, 2)), folder)
    assert sorted(map(tuple, writers.summary(rows((2, 5), (3, 3)), folder).collect())) == [(1, 1), (2, 5), (3, 3)]
    os.rename(folder, folder + "-old")  # as a run leaves it that fails between the moves
    assert sorted(map(tuple, writers.summary(rows((4, 4)), folder).collect())) == [(1, 1), (2, 5), (3, 3), (4, 4)]
    assert not os.path.exists(folder + "-old") and not os.path.exists(folder + "-new")
