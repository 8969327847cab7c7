"""Repetition limits decide texts that the base rule lets through."""

import numpy as np
import pyarrow as pa

from gaitline.llm import repetition
from gaitline.llm.kernel import rolling, run_hashes, words_of


def _once(n, first=0):
    return [f"w{first + k:04d}" for k in range(n)]


def test_limits_fire_below_the_base_rule(spark):
    # 18 of 100 words in repeated runs of 9; pairs in every order, so that no run of 5 words comes twice; no repeat
    nine = _once(9) + _once(82, 100) + _once(9)
    pairs = [w for a in "abcd" for b in "efgh" for w in (f"{a}1", f"{a}2", f"{b}1", f"{b}2")]
    docs = spark.createDataFrame([(1, " ".join(nine)), (2, " ".join(pairs)), (3, " ".join(_once(100)))], "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition.judge(repetition.coverage(docs)).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (False, True)}


def test_lengths_in_one_pass_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = [[f"v{k}" for k in rng.integers(0, 6, n)] for n in (0, 1, 5, 40, 200)]
    for w in words_of(pa.array([" ".join(t) for t in texts], pa.large_string()), lower=False):
        for n, inside in repetition.in_repeats_of(w, range(2, 11)).items():
            want = []
            for t in texts:
                runs = [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]
                hit = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + n)}
                want += [i in hit for i in range(len(t))]
            assert inside.tolist() == want


def test_coverage_alone_rejects_texts(spark):
    """Of the tables' texts past the base rule some break a limit of coverage; symbols are reported and decide nothing."""
    out = repetition.judge(repetition.coverage(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))).toPandas()
    past = out[~out.base_failed]
    alone = past[past.coverage_failed]
    assert len(alone) > 0 and not alone.kept.any()
    assert past[~past.coverage_failed].kept.all() and past[past.symbol_failed].kept.any()


def test_run_hashes_are_the_same_wherever_a_run_is():
    words = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    both = np.concatenate((words, words[::-1], words))
    for n in (1, 2, 5, 10):
        got = run_hashes(rolling(both), np.arange(len(both) - n + 1), n)
        assert (got[: 51 - n] == got[100 : 151 - n]).all() and len(set(got.tolist())) == len({tuple(both[i : i + n]) for i in range(len(got))})
