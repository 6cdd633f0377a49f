"""Reading physical plans."""

import re


def initial_plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame) -> str:
    """The plan AQE ended with, after running the frame."""
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def count(plan: str, operator: str) -> int:
    return len(re.findall(rf"\b{operator}\b", plan))
