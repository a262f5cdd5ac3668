"""Whole groups out of a sorted stream of batches: many small groups cost no task of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups only, from batches in which equal non-null keys are neighbours.

    A group that fills several batches is held until it ends; the caller bounds its size.
    """
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        same = np.ones(len(b), bool)
        for k in keys:
            same &= (b[k] == b[k].iloc[-1]).to_numpy()
        other = np.flatnonzero(~same)
        start = other[-1] + 1 if len(other) else 0
        if start:
            yield pd.concat([*held, b.iloc[:start]]) if held else b.iloc[:start]
            held = [b.iloc[start:]]
        elif held and any(held[-1][k].iloc[-1] != b[k].iloc[0] for k in keys):
            yield pd.concat(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pd.concat(held)


def slices(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, int]]:
    """Where each group of a frame begins and ends."""
    new = np.zeros(len(frame), bool)
    new[0] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(new)
    return zip(at.tolist(), np.r_[at[1:], len(frame)].tolist())
