"""Physical-plan checks: the properties the design relies on at scale."""

import re

from conftest import SMALL
from varietas.plans import sampling_plans, topic_plans


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draw_has_partial_top_k_before_the_shuffle(spark):
    plan = _plan(sampling_plans.uniform_members_df(spark, SMALL))
    assert "WindowGroupLimit" in plan


def test_member_draw_does_not_read_texts(spark):
    plan = _plan(sampling_plans.q_uniform_members(spark, SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("text:" not in s for s in schemas)


def test_no_inferred_tokenization_filter_in_the_scan(spark):
    plan = _plan(topic_plans.q_c_tf_idf(spark, SMALL))
    assert "size(regexp_extract_all" not in plan
