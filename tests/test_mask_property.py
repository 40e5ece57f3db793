"""Property: IPv4 masking equals a Python implementation of the rule on random texts."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetlens.operators.shape import mask_ipv4

# Python reference of the rule: four dot-separated groups of 1-3 ASCII digits,
# not glued to an ASCII word character; the first two groups are hidden.
RULE = re.compile(r"(?<![0-9A-Za-z_])[0-9]{1,3}\.[0-9]{1,3}\.([0-9]{1,3})\.([0-9]{1,3})(?![0-9A-Za-z_])", re.ASCII)

pieces = st.one_of(
    st.from_regex(r"[0-9]{1,4}(\.[0-9]{1,4}){2,4}", fullmatch=True),
    st.sampled_from([" ", "v", "_", ".", ":", "ip=", "\n", "é", "中"]),
    st.text(alphabet="ab1. ", max_size=4),
)
texts = st.lists(pieces, max_size=12).map("".join)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batch=st.lists(texts, min_size=1, max_size=30))
def test_mask_matches_rule(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", mask_ipv4("t").alias("m")).collect()}
    for i, t in enumerate(batch):
        assert got[i] == RULE.sub(r"*.*.\1.\2", t)
