"""Write the coverage table of README.md from the registered queries."""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from plumbline.plans import load_all  # noqa: E402

AREAS = {"S": "Sources and sinks", "F": "Filters and projection", "J": "Joins", "A": "Grouping", "P": "Profiles", "C": "Conversion", "M": "Missing values",
         "R": "Table resampling", "E": "Encoding", "N": "Scaling", "T": "Whole cleaning, splits, windows", "D": "Distributions and correlation",
         "O": "Outliers", "K": "Clusters and reduction", "V": "Display projections", "G": "Features", "X": "Time series", "L": "Models",
         "Z": "Streams", "B": "Row checks", "Y": "Order and paging", "U": "Snapshot updates", "H": "Images and user functions"}


def main() -> None:
    rows: dict[str, list[str]] = {}
    for name, q in load_all().items():
        for row in q.rows.split():
            rows.setdefault(row, []).append(f"`{name}`" + ("" if q.sql else " (rows only)"))
    lines = []
    for letter, title in AREAS.items():
        ids = sorted((r for r in rows if re.fullmatch(rf"{letter}\d+", r)), key=lambda r: int(r[1:]))
        lines += [f"**{title}**", ""] + [f"- {i}: " + ", ".join(rows[i]) for i in ids] + [""]
    path = os.path.join(ROOT, "README.md")
    text = open(path).read()
    head, rest = text.split("<!-- coverage -->")[0], text.split("<!-- end -->")[1]
    with open(path, "w") as f:
        f.write(head + "<!-- coverage -->\n" + "\n".join(lines) + "<!-- end -->" + rest)


if __name__ == "__main__":
    main()
