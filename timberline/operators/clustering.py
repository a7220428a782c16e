"""Choosing leaders among the generalised lines of a bucket.

This is the only Python that sees data. Forms take part in a fixed order, heaviest first; a form
leads if no earlier leader is at least ``sim_th`` alike, any other joins the leader it is most alike
(the earlier of equals). That has one answer however the forms are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from timberline.functions.templates import WILD

MEMBER_SCHEMA = "bucket string, source string, leader string"
LEADER_SCHEMA = "bucket string, source string, turn int"
STATE_SCHEMA = (
    "bucket string, n int, source string, weight bigint, open boolean, same int, leader string"
)


def _codes(texts: list[str]) -> tuple[np.ndarray, int]:
    """Lines of equal length as rows of token numbers, and the wildcard's number."""
    lines = [t.split(" ") for t in texts]
    codes, values = pd.factorize(np.array([t for line in lines for t in line], dtype=object))
    wild = np.flatnonzero(values == WILD)
    return codes.astype(np.int32).reshape(len(lines), -1), int(wild[0]) if len(wild) else -1


def _shared(row: np.ndarray, leaders: np.ndarray, wild: int) -> np.ndarray:
    return ((leaders == row) & (row != wild)).sum(axis=1)


def _choose(rows: np.ndarray, wild: int, sim_th: float) -> list[int]:
    chosen: list[int] = []
    leaders = np.empty_like(rows)
    for i, row in enumerate(rows):
        near = _shared(row, leaders[: len(chosen)], wild)
        if not len(near) or near.max() / len(row) < sim_th:
            leaders[len(chosen)] = row
            chosen.append(i)
    return chosen


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["weight", "source"], ascending=[False, True], kind="mergesort")


def bucket_clusterer(sim_th: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Leader of each form of a whole bucket."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        texts = pdf["source"].tolist()
        rows, wild = _codes(texts)
        chosen = _choose(rows, wild, sim_th)
        leaders, leads = rows[chosen], set(chosen)
        found = [
            texts[i] if i in leads else texts[chosen[int(_shared(row, leaders, wild).argmax())]]
            for i, row in enumerate(rows)
        ]
        return pd.DataFrame({"bucket": pdf["bucket"].to_numpy(), "source": texts, "leader": found})

    return cluster


def head_chooser(sim_th: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """New leaders among the heaviest open forms of a bucket, in order."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        rows, wild = _codes(pdf["source"].tolist())
        chosen = pdf.iloc[_choose(rows, wild, sim_th)]
        return pd.DataFrame(
            {"bucket": chosen["bucket"], "source": chosen["source"], "turn": range(len(chosen))}
        )

    return choose


def comparer(sim_th: float) -> Callable[..., pd.DataFrame]:
    """Forms of a slice after a comparison with the bucket's new leaders."""

    def compare(forms: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        forms = forms[["bucket", "n", "source", "weight", "open", "same", "leader"]].copy()
        if not len(forms) or not len(leaders):
            return forms
        names = leaders.sort_values("turn")["source"].tolist()
        rows, wild = _codes([*names, *forms["source"]])
        new, own, leads = rows[: len(names)], rows[len(names) :], set(names)
        same, leader, still = forms["same"].tolist(), forms["leader"].tolist(), forms["open"].tolist()
        for i, (row, text) in enumerate(zip(own, forms["source"])):
            if text in leads or leader[i] == text:
                leader[i], still[i] = text, False
                continue
            near = _shared(row, new, wild)
            best = int(near.argmax())
            if near[best] > same[i]:
                same[i] = int(near[best])
                leader[i] = names[best]
            still[i] = bool(still[i] and same[i] / len(row) < sim_th)
        return forms.assign(same=same, leader=leader, open=still)

    return compare
