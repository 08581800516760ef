"""Property tests (hypothesis) on the cleaning and the identity assignment."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import P1, P2, T1, T2, row, silver_rows
from lakestar.operators import keys as K
from lakestar.operators import quality as Q
from lakestar.operators import star as G

_cfg = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

_slice_rows = st.lists(
    st.tuples(
        st.sampled_from(["A", "B", None]),      # first_name (NULL = invalid)
        st.sampled_from(["F", "M"]),            # sex
        st.sampled_from([-1, 0, 3, 5, None]),   # count (<= 0 or NULL = invalid)
        st.sampled_from([T1, T2]),              # file time
        st.sampled_from(["a.csv", "b.csv"]),    # file name
    ),
    max_size=12,
)


@_cfg
@given(items=_slice_rows)
def test_survivors_and_errors_partition_the_distinct_slice(spark, items):
    df = silver_rows(spark, [row(name=n, sex=x, count=c, mod=m, file=f) for n, x, c, m, f in items])
    survivors, errors = Q.clean(df)
    distinct = {tuple(r) for r in df.distinct().collect()}
    s = [tuple(r) for r in survivors.collect()]
    e = [tuple(r) for r in errors.collect()]
    assert len(set(s)) == len(s) and len(set(e)) == len(e)
    assert set(s) | set(e) == distinct
    assert not set(s) & set(e)
    # One survivor per natural key, and it is valid.
    keys = [(r[0], r[1], r[2], r[3]) for r in s]
    assert len(keys) == len(set(keys))
    assert all(r[1] is not None and r[4] is not None and r[4] > 0 for r in s)


_names = st.lists(st.sampled_from(list("ABCDEFGH")), min_size=1, max_size=6)


@_cfg
@given(first=_names, second=_names)
def test_identity_is_unique_dense_and_stable(spark, first, second):
    b1 = silver_rows(spark, [row(name=n, run="run-1", pd=P1) for n in first])
    b2 = silver_rows(spark, [row(name=n, run="run-2", pd=P2) for n in second])
    v1 = G.merge_star(None, G.delta(b1, G.DIM_NAMES), G.DIM_NAMES)
    v1_rows = {r["first_name"]: r["sid"] for r in v1.collect()}
    v2 = G.merge_star(v1, G.delta(b2, G.DIM_NAMES), G.DIM_NAMES)
    v2_rows = {r["first_name"]: r["sid"] for r in v2.collect()}
    # Unique and dense from 0.
    assert sorted(v2_rows.values()) == list(range(len(v2_rows)))
    # Stable: names of the first batch keep their ids.
    assert all(v2_rows[n] == sid for n, sid in v1_rows.items())
    # New names get ids after the first batch's, in name order.
    new = sorted(set(second) - set(first))
    assert [v2_rows[n] for n in new] == list(range(len(v1_rows), len(v1_rows) + len(new)))


def test_large_numbering_has_no_single_partition_exchange(spark):
    df = spark.range(0, 1000).selectExpr("id % 97 AS k", "id")
    numbered = K.assign_sid(df, ["k", "id"], num_partitions=4)
    numbered.collect()
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert numbered.select("sid").distinct().count() == 1000
