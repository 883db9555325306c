"""Write the final (adaptive) physical plan trees of the main queries to PLANS.md.

Usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES = ("label_sections", "flagship", "group_folds", "auc_note", "sum_pool")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from notelab.plans.queries import QUERIES as Q
    from notelab.session import get_session
    spark = get_session()
    out = ["# Physical plans", "",
           f"Final adaptive plans after execution on `{sf_dir}` (local[8]); generated by `tools/plans.py`.",
           "Only the operator tree and the scan schemas are kept (expressions are long).", ""]
    for name in QUERIES:
        df = Q[name](spark, sf_dir)
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n\n")[0]
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", text)))
        pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\n]*\])", text)))
        out += [f"## {name}", "", "```", tree.strip(), "```", "",
                "Scans read: " + "; ".join(f"`{s}`" for s in schemas), "",
                "Pushed filters: " + "; ".join(f"`{p}`" for p in pushed), ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
