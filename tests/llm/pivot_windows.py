"""How large the windows of document pivots are: python tests/llm/pivot_windows.py FOLDER [PIVOTS ...].

For documents (distinct sets of 3-word shingles, links within distance 0.1) and
random documents as pivots: the mean share of all pivots that lie in a
document's window of the triangle inequality, and the share of documents whose
window is every pivot.  Once over all documents, once with pivots of the
document's own size band (sizes that share a power of two), once by the distance
of 64 min-hashes instead of the sets'.
"""

import os
import sys

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from cpgspark.llm.textkernel import mix, shingle_sets, text_buffers  # noqa: E402


def window_shares(sets: list[np.ndarray], pivots: list[int], reach: float = 0.1) -> np.ndarray:
    """Of each set, the share of pivots in its window."""
    chosen = [sets[p] for p in pivots]
    flat = np.concatenate(chosen)
    owner = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    size = np.array([len(c) for c in chosen])
    out = np.empty(len(sets))
    for i, s in enumerate(sets):
        lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
        both = np.bincount(owner[np.concatenate([np.arange(a, b) for a, b in zip(lo[hi > lo], hi[hi > lo])] or [np.zeros(0, int)])], minlength=len(chosen))
        away = 1 - both / (len(s) + size - both)
        out[i] = (away <= away.min() + 2 * reach + 1e-9).mean()
    return out


def main(folder: str, counts: list[int]) -> None:
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).combine_chunks()
    offsets, raw = text_buffers(texts)
    sets = list({s.tobytes(): s for s in shingle_sets(offsets, raw, 3) if len(s)}.values())
    rng = np.random.default_rng(0)
    seeds = mix(np.arange(1, 65, dtype=np.uint64))
    hashed = [np.unique(mix((s[:, None] ^ seeds)).min(axis=0) ^ seeds) for s in sets]
    band = np.array([len(s).bit_length() for s in sets])
    print(f"{len(sets)} distinct sets")
    for n in counts:
        every = window_shares(sets, rng.permutation(len(sets))[:n].tolist())
        inner = np.empty(len(sets))
        for b in np.unique(band):
            own = np.flatnonzero(band == b)
            inner[own] = window_shares([sets[i] for i in own], rng.permutation(len(own))[:n].tolist())
        by_hash = window_shares(hashed, rng.permutation(len(sets))[:n].tolist())
        row = [f"{x.mean():.3f} and {(x == 1).mean():.3f}" for x in (every, inner, by_hash)]
        print(f"{n} pivots: all {row[0]}; by size band {row[1]}; min-hashes {row[2]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], [int(x) for x in sys.argv[2:]] or [16, 64, 256, 1024])
