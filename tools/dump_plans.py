"""Print the physical plan (operator tree only) of selected registered queries."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from retentia.plans.registry import load_all  # noqa: E402
from retentia.session import build_session  # noqa: E402


def tree(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.split("\n"):
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: [^,\]]*", "", line)
        out.append(line[:160])
    return "\n".join(out)


if __name__ == "__main__":
    sf = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session()
    reg = load_all()
    for name in sys.argv[1:]:
        print(f"### {name}\n```")
        print(tree(reg[name][0](spark, sf)))
        print("```\n")
