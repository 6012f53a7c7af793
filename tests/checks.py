"""What several test modules share: the small input folder and the text of a physical plan."""

SF_SMALL = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
