"""Choosing items that together cover the most parts."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def cover(df: DataFrame, limit: int = 5) -> DataFrame:
    """(claim_id, evidence_id, pick): greedy set cover of each claim's parts.

    *df*: claim_id, evidence_id, parts array<int>, web boolean, authority. Each pick covers the most parts
    not yet covered, web items first, then authority, then the smaller id; picks without a new part follow
    in that order. A claim has few items by design, so a group is one claim's items.
    """

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        left = [(set(p if p is not None else ()), bool(w), float(a if a == a and a is not None else 0), e) for p, w, a, e in zip(g["parts"], g["web"], g["authority"], g["evidence_id"])]
        seen, out = set(), []
        while left and len(out) < limit:
            best = min(left, key=lambda x: (-len(x[0] - seen), not x[1], -x[2], x[3]))
            left.remove(best)
            seen |= best[0]
            out.append(best[3])
        return pd.DataFrame({"claim_id": g["claim_id"].iloc[0], "evidence_id": out, "pick": range(1, len(out) + 1)})

    return df.groupBy("claim_id").applyInPandas(pick, "claim_id string, evidence_id string, pick int")
