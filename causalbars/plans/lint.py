"""A lint for causality: plans of signals, universes and metrics must not look ahead."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def looks_ahead(df: DataFrame, allow: tuple[str, ...] = ()) -> list[str]:
    """Window expressions of ``df`` whose frame goes past the current row, but for aliases named in ``allow``.

    Frames over a whole partition without an order are totals, not look-aheads, only where allowed by name too.
    """
    found = []
    for line in plan_text(df).splitlines():
        for m in re.finditer(r"(\w+)\((?:[^()]|\([^()]*\))*\) windowspecdefinition\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\) AS (\S+?)#", line):
            body, name = m[0], m[2]
            frame = re.search(r"specifiedwindowframe\((\w+), (.+?), (.+?)\)", body)
            upper = frame[3].strip("$() ") if frame else ""
            ahead = "unboundedfollowing" in upper or bool(re.fullmatch(r"[1-9]\d*", upper))
            if (ahead or m[1] == "lead") and name not in allow:
                found.append(f"{m[1]} AS {name}: {frame[0] if frame else 'no frame'}")
    return found
